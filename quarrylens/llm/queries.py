"""The queries of this subpackage, and their SQL twins where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, exact_dedup, html_extract, jaccard, minhash, packing, periodic, pii, quality, secrets, sharding, spelling
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: For the synthetic tables alone: a real table needs a key that is not public.
PII_KEY = "the public key of the synthetic tables"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", *[f"n_{k}" for k in pii.KINDS])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), cache=1_200_000)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals: the older half of the history by doc_id, then all of it, of which only blobs that the ledger lacks are scanned."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("m")).first()["m"]
    ledger = secrets.update(docs.where(F.col("doc_id") <= F.lit(middle)))
    ledger = ledger.unionByName(secrets.update(docs, ledger))
    return secrets.digest_columns(secrets.findings(docs, ledger))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.labelled(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=("doc_id",))
    return done.select("doc_id", F.col("_evidence").alias("evidence"), F.col("_host").alias("host_posterior"), F.col("_path").alias("path_posterior"), F.col("_posterior").alias("posterior"), F.col("_keep").alias("keep"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(chat.linear(rows.unionByName(extra))))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with repetitions planted by their ids."""
    return periodic.digests(periodic.found(table(spark, sf_dir, "documents"), periodic.planted))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.labelled(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.grouped(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_packing, op3_html, op4_sharding, op5_exact_dedup, op6_decontamination, op7_secrets, op8_jaccard, op9_quality, op10_chat, op11_periodic, op12_minhash, op13_spelling)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (norm)""",
    "op8_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i::BIGINT, (i + 4)::BIGINT) END AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
        h AS (SELECT doc_id, md5(array_to_string(g, chr(10))) AS g FROM s),
        n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x),
        t AS (SELECT doc_id, md5(string_agg(g, '' ORDER BY g)) AS k FROM h GROUP BY doc_id),
        f AS (SELECT k, min(doc_id) AS class_id FROM t GROUP BY k)
        SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(class_id, m.doc_id) AS class_id
        FROM m LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN f USING (k)""",
    "op10_chat": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        d AS (SELECT *, 24 + length(role) + length(text)
                     + len(regexp_extract_all(role || chr(9) || text, '\\\\|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<\\|startoftext\\|>|<<SYS>>|<</SYS>>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<unk>|<pad>'))
                     + len(regexp_extract_all(role, chr(10))) AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
        FROM d GROUP BY conv_id""",
    "op11_periodic": """
        WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tbl),
        d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        c AS (SELECT id, doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda r, b: xor(r >> 8, tbl[1 + (xor(r, b) & 255)]), 4294967295)) AS h FROM d, tbl),
        a AS (SELECT id, doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM c),
        t AS (SELECT id, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE w END AS w FROM a),
        u AS (SELECT id, n, unnest(w) AS w, unnest(range(n)) AS i FROM t),
        m AS (SELECT x.id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.id = y.id AND x.w = y.w AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
        j AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM m),
        l AS (SELECT id, q, min(i) AS start, count(*) + q AS length FROM j GROUP BY id, q, island HAVING count(*) >= greatest(24 - q, 2 * q)),
        r AS (SELECT id, start, length, min(q) AS period FROM l GROUP BY id, start, length),
        s AS (SELECT id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
                     first({'start': start, 'length': length, 'period': period} ORDER BY length::DOUBLE / period DESC, start, period) AS best FROM r GROUP BY id),
        gone AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
        k AS (SELECT id, sha256(string_agg(w, ' ' ORDER BY i)) AS collapsed_sha256 FROM u ANTI JOIN gone USING (id, i) GROUP BY id)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
               coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
        FROM t LEFT JOIN s USING (id) LEFT JOIN k USING (id)""",
    "op12_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        h AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN md5(w[1]) ELSE md5(w[i] || chr(10) || w[i + 1]) END AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y),
        m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op13_spelling": """
        WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tbl),
        t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
        u AS (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS x FROM t WHERE length(run) >= 6 GROUP BY doc_id, run),
        b AS (SELECT run, c, list_transform(range(len(x) // 2), lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS bytes FROM u),
        h AS (SELECT run, c, xor(4294967295, list_reduce(bytes, lambda r, v: xor(r >> 8, tbl[1 + (xor(r, v) & 255)]), 4294967295)) AS h FROM b, tbl),
        d AS (SELECT c, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h),
        w AS (SELECT word, sum(c)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
        x AS (SELECT word, i, word[1:i] || word[i + 2:] AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
        p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
              UNION SELECT x.word, w.word FROM x JOIN w ON x.less = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.less = w.word),
        f AS (SELECT a AS word, count(*) AS n_near, first({'w': b, 'n': w.n} ORDER BY w.n DESC, b) AS best FROM p JOIN w ON w.word = b GROUP BY a),
        v AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * n THEN best.w END AS form, CASE WHEN best.n >= 5 * n THEN best.n END AS form_n FROM w LEFT JOIN f USING (word)),
        r AS (SELECT word, word AS root, form AS up FROM v UNION ALL SELECT r.word, v.word, v.form FROM r JOIN v ON v.word = r.up)
        SELECT v.word, form, r.root, n, n_near::BIGINT AS n_near, form_n FROM v JOIN r ON r.word = v.word AND r.up IS NULL""",
}
