"""Queries by operator over the driver's tables, and their SQL twins.

Names start with the inventory's identifiers of the operators that they run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import measures, parsers, paths
from . import dsl
from ..operators import bands, changes_since, clones, externals, folders, graph, history, layout, owners, rollups, signals, tests_map, text
from ..sources import repo, sinks, snapshots, storage, synthetic
from ..sources.tables import ALL_FACTS_SQL, FACTS_SQL, TableFacts
from ..streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FUNCTIONS: dict[str, Callable[[TableFacts], DataFrame]] = {}


def query(sql: str | None = None, facts: bool = True):
    """Registers a function of TableFacts under its name, with its SQL twin after the common facts."""

    def register(f):
        FUNCTIONS[f.__name__] = f
        QUERIES[f.__name__] = lambda spark, sf_dir: f(TableFacts(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {FACTS_SQL},\n{sql.strip()}" if sql.strip().startswith("--cte") is False and facts else sql).replace("--cte", "")
        return f

    return register


def select(sql: str) -> str:
    """A statement after the facts without tables of its own."""
    return f"one AS (SELECT 1)\n{sql}"


def log(t: TableFacts) -> DataFrame:
    return history.log(t.changes, t.commits)


def bulk(t: TableFacts) -> int:
    return history.bulk_limit(t.files.count())


def coupling(t: TableFacts) -> DataFrame:
    return history.coupling(t.changes, bulk(t), t.tasks)


# -- history ---------------------------------------------------------------------

HIST = """
h AS (SELECT fid, count(*) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, sum(added + deleted)::BIGINT AS churn, min(t) AS first_t, max(t) AS last_t,
    sum((is_fix AND NOT is_revert)::INT)::BIGINT AS fixes, sum(is_revert::INT)::BIGINT AS reverts,
    arg_max(author, {'a': -t, 'b': commit_id}) AS first_author, arg_max(author, {'a': t, 'b': commit_id}) AS last_author, arg_max(subject, {'a': t, 'b': commit_id}) AS last_subject
    FROM cc GROUP BY fid),
fa AS (SELECT fid, author, sum(added)::BIGINT AS lines, max(t) AS last_t FROM cc GROUP BY 1, 2),
ow0 AS (SELECT fid, author, lines, row_number() OVER w AS n, sum(lines) OVER (w ROWS UNBOUNDED PRECEDING) AS run, sum(lines) OVER (PARTITION BY fid) AS total FROM fa WINDOW w AS (PARTITION BY fid ORDER BY lines DESC, author DESC)),
ow AS (SELECT fid, max(author) FILTER (n = 1) AS primary_author, max(lines) / max(total) AS share, count(*) AS authors, min(n) FILTER (run * 2 >= total) AS bus_factor FROM ow0 GROUP BY fid),
act AS (SELECT fid, least(23, floor((head - t) / 2592000.0))::INT AS bucket, count(*) AS commits FROM cc, head GROUP BY 1, 2),
heat AS (SELECT fid, sum((added + deleted) * pow(0.5, (head - t) / 86400.0 / 30.0)) AS recent_churn FROM cc, head GROUP BY 1),
sizes AS (SELECT commit_id, count(*) AS entries FROM changes GROUP BY 1),
lim AS (SELECT greatest(8, least(floor(count(*) * 0.2), 200)) AS bulk FROM part),
small AS (SELECT c.* FROM changes c JOIN sizes USING (commit_id), lim WHERE entries <= bulk),
cp AS (SELECT x.fid AS a, y.fid AS b, count(*) AS n FROM small x JOIN small y ON x.commit_id = y.commit_id AND x.fid < y.fid GROUP BY 1, 2),
tr AS (SELECT fid, sum(CASE WHEN bucket < 3 THEN commits ELSE 0 END)::BIGINT AS recent, sum(CASE WHEN bucket >= 3 AND bucket < 6 THEN commits ELSE 0 END)::BIGINT AS before FROM act GROUP BY fid),
deg AS (SELECT coalesce(i.fid, o.fid) AS fid, coalesce(in_degree, 0)::BIGINT AS in_degree, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out
    FROM (SELECT dst AS fid, sum(mult) AS in_degree, count(*) AS fan_in FROM imports GROUP BY 1) i FULL JOIN (SELECT src AS fid, count(*) AS fan_out FROM imports GROUP BY 1) o ON i.fid = o.fid)
"""


@query(HIST + "SELECT * FROM h")
def a1_a2_file_history(t: TableFacts) -> DataFrame:
    return history.file_history(log(t))


@query(HIST + "SELECT author, sum(lines)::BIGINT AS lines, count(DISTINCT fid) AS files, max(last_t) AS last_t FROM fa GROUP BY author")
def a3_a14_author_totals(t: TableFacts) -> DataFrame:
    return history.author_totals(history.file_authors(log(t)))


@query(HIST + "SELECT * FROM ow")
def a4_a5_a11_ownership(t: TableFacts) -> DataFrame:
    return history.ownership(history.file_authors(log(t)))


@query(HIST + """, e AS (SELECT commit_id, entries, t, author, is_fix AND NOT is_revert AS is_fix, is_revert FROM sizes JOIN (SELECT commit_id, epoch(ts) AS t, author, subject ~* 'fix|bug' AS is_fix, subject LIKE 'revert%' AS is_revert FROM commits) USING (commit_id))
SELECT count(*) AS commits, sum((entries > bulk)::INT)::BIGINT AS bulk, sum((entries <= bulk)::INT)::BIGINT AS eligible, max(entries) FILTER (entries <= bulk) AS max_eligible,
    count(DISTINCT floor(t / 86400)) AS active_dates, sum(is_fix::INT)::BIGINT AS fixes, sum(is_revert::INT)::BIGINT AS reverts, min(t) AS first_t, max(t) AS last_t, count(DISTINCT author) AS authors FROM e, lim""")
def a6_repo_stats(t: TableFacts) -> DataFrame:
    return history.repo_stats(log(t), bulk(t))


@query(HIST + "SELECT * FROM act")
def a7_activity(t: TableFacts) -> DataFrame:
    return history.activity(log(t))


@query(HIST + "SELECT fid, round(recent_churn, 4) AS recent_churn FROM heat")
def a8_recent_churn(t: TableFacts) -> DataFrame:
    return history.recent_churn(log(t)).withColumn("recent_churn", F.round("recent_churn", 4))


@query(HIST + "SELECT DISTINCT fid, author, floor((head - t) / 2592000.0)::INT AS bucket FROM cc, head WHERE floor((head - t) / 2592000.0) < 24")
def a9_author_buckets(t: TableFacts) -> DataFrame:
    return history.author_buckets(log(t))


@query(HIST + "SELECT * FROM cp")
def a10_j5_coupling(t: TableFacts) -> DataFrame:
    return coupling(t)


@query(HIST + "SELECT commit_id, is_fix AND NOT is_revert AS is_fix, is_revert FROM (SELECT DISTINCT commit_id, is_fix, is_revert FROM cc)")
def pr18_commit_kinds(t: TableFacts) -> DataFrame:
    return log(t).select("commit_id", "is_fix", "is_revert").distinct()


@query(HIST + "SELECT fid, recent, before, CASE WHEN recent >= 2 AND recent >= before * 1.5 + 1 THEN 1 WHEN before >= 2 AND recent * 2 <= before THEN -1 ELSE 0 END AS trend FROM tr")
def w15_trend(t: TableFacts) -> DataFrame:
    return history.trend(history.activity(log(t)))


ERA = """, ag AS (SELECT fid, greatest(0, (max(last_t) OVER () - first_t) / 86400.0) AS age_days, (max(last_t) OVER () - min(first_t) OVER ()) / 86400.0 AS life, count(*) OVER () AS n FROM h),
agr AS (SELECT *, row_number() OVER (ORDER BY age_days, fid) - 1 AS p FROM ag)
"""


@query(HIST + ERA + "SELECT fid, age_days, age_days <= greatest(30.0, life * 0.1) AS is_new, CASE WHEN p < greatest(1, n // 3) THEN 'new' WHEN p < 2 * greatest(1, n // 3) THEN 'mid' ELSE 'old' END AS era FROM agr")
def w4_pr12_pr13_eras(t: TableFacts) -> DataFrame:
    return history.eras(history.file_history(log(t)))


@query(HIST + """, e AS (SELECT commit_id, entries, t, author, is_fix AND NOT is_revert AS is_fix FROM sizes JOIN (SELECT DISTINCT commit_id, t, author, is_fix, is_revert FROM cc) USING (commit_id))
SELECT count(DISTINCT author) >= 2 AS authorship, count(DISTINCT floor(t / 86400)) >= 3 AS recency, count(*) >= 5 AND max(entries) FILTER (entries <= bulk) >= 2 AS churn,
    (SELECT count(*) > 0 FROM cp) AS coupling, (SELECT count(DISTINCT floor(first_t / 86400)) >= 2 FROM h) AS age, count(*) FILTER (is_fix) >= 1 AS defects FROM e, lim GROUP BY bulk""")
def r1_flags(t: TableFacts) -> DataFrame:
    rows = log(t)
    limit = bulk(t)
    return history.flags(history.repo_stats(rows, limit), history.file_history(rows), coupling(t))


# -- signals of files --------------------------------------------------------------

HOT = HIST + """,
hc AS (SELECT f.fid, f.rel, f.loc, coalesce(h.commits, 0) AS commits FROM files f LEFT JOIN h USING (fid)),
hr AS (SELECT *, CASE WHEN commits > 0 THEN cume_dist() OVER (PARTITION BY commits > 0 ORDER BY commits) ELSE 0 END AS cpct, CASE WHEN loc > 0 THEN cume_dist() OVER (PARTITION BY loc > 0 ORDER BY loc) ELSE 0 END AS size_pct FROM hc),
hs AS (SELECT *, cpct * size_pct AS hotspot, greatest(1, round_even(count(*) OVER () * 0.05, 0)) AS cut FROM hr),
hot AS (SELECT *, row_number() OVER (ORDER BY hotspot DESC, commits DESC, rel) AS hotspot_rank FROM hs WHERE hotspot > 0)
"""


@query(HOT + "SELECT fid, commits, loc, size_pct, hotspot, hotspot_rank, hotspot_rank <= cut AS is_hotspot FROM hot")
def w6_hotspots(t: TableFacts) -> DataFrame:
    return signals.hotspots(t.files, history.file_history(log(t)))


@query(HOT + "SELECT fid, loc, size_pct, size_pct >= 0.95 AND loc >= 40 AS is_oversized FROM hr")
def w1_w7_oversized(t: TableFacts) -> DataFrame:
    return signals.oversized(t.files, least_loc=40)


@query(HIST + ", b AS (SELECT fid, commits, fixes, fixes / commits AS fix_ratio FROM h WHERE commits >= 5), r AS (SELECT *, CASE WHEN fix_ratio > 0 THEN cume_dist() OVER (PARTITION BY fix_ratio > 0 ORDER BY fix_ratio) ELSE 0 END AS p FROM b) SELECT fid, commits, fixes, fix_ratio FROM r WHERE p >= 0.9 AND fixes >= 2 AND fix_ratio >= 0.3")
def w8_defects(t: TableFacts) -> DataFrame:
    return signals.defects(history.file_history(log(t)))


@query(HIST + ", b AS (SELECT fid, rel, fixes, fixes / commits AS fix_ratio, (SELECT greatest(1, round_even(count(*) * 0.05, 0)) FROM files) AS cut FROM h JOIN files USING (fid) WHERE fixes >= 2 AND fixes / commits >= 0.25), r AS (SELECT *, row_number() OVER (ORDER BY fixes DESC, fix_ratio DESC, rel) AS rank FROM b) SELECT fid, fixes, fix_ratio, rank FROM r WHERE rank <= cut")
def w9_bugprone(t: TableFacts) -> DataFrame:
    return signals.bugprone(t.files, history.file_history(log(t)))


@query(HIST + ", r AS (SELECT *, CASE WHEN in_degree > 0 THEN cume_dist() OVER (PARTITION BY in_degree > 0 ORDER BY in_degree) ELSE 0 END AS in_pct, CASE WHEN fan_out > 0 THEN cume_dist() OVER (PARTITION BY fan_out > 0 ORDER BY fan_out) ELSE 0 END AS out_pct FROM deg) SELECT fid, in_degree, fan_out, in_pct, out_pct, in_degree >= 3 AND fan_out >= 3 AND in_pct >= 0.9 AND out_pct >= 0.9 AS is_hub FROM r")
def w10_hubs(t: TableFacts) -> DataFrame:
    return signals.hubs(t.imports)


@query(HIST + "SELECT fid, CASE WHEN coalesce(fan_out, 0) + coalesce(in_degree, 0) > 0 THEN round(fan_out / (fan_out + in_degree), 4) ELSE -1.0 END AS instability FROM files LEFT JOIN deg USING (fid)")
def pr15_instability(t: TableFacts) -> DataFrame:
    return signals.instability(t.files, t.imports)


CENTRAL = HIST + """,
ce0 AS (SELECT fid, rel, coalesce(k.c, 0) AS a, coalesce(in_degree, 0) AS b, coalesce(recent_churn, 0) AS c, coalesce(authors, 0) AS d FROM files
    LEFT JOIN (SELECT fid, count(*) AS c FROM (SELECT a AS fid FROM cp UNION ALL SELECT b FROM cp) GROUP BY 1) k USING (fid) LEFT JOIN deg USING (fid) LEFT JOIN heat USING (fid) LEFT JOIN ow USING (fid)),
ce1 AS (SELECT *, row_number() OVER (PARTITION BY a > 0 ORDER BY a, rel) / count(*) OVER (PARTITION BY a > 0) AS pa, row_number() OVER (PARTITION BY b > 0 ORDER BY b, rel) / count(*) OVER (PARTITION BY b > 0) AS pb,
    row_number() OVER (PARTITION BY c > 0 ORDER BY c, rel) / count(*) OVER (PARTITION BY c > 0) AS pc, row_number() OVER (PARTITION BY d > 0 ORDER BY d, rel) / count(*) OVER (PARTITION BY d > 0) AS pd FROM ce0),
ce AS (SELECT fid, rel, round((CASE WHEN a > 0 THEN pa ELSE 0 END * 0.35::DOUBLE + CASE WHEN b > 0 THEN pb ELSE 0 END * 0.35::DOUBLE + CASE WHEN c > 0 THEN pc ELSE 0 END * 0.2::DOUBLE + CASE WHEN d > 0 THEN pd ELSE 0 END * 0.1::DOUBLE) / 1.0, 6) AS centrality FROM ce1)
"""


def _centrality(t: TableFacts) -> DataFrame:
    rows = log(t)
    return signals.centrality(t.files, coupling(t), t.imports, history.recent_churn(rows), history.ownership(history.file_authors(rows)))


@query(CENTRAL + "SELECT * FROM ce")
def w2_w11_centrality(t: TableFacts) -> DataFrame:
    return _centrality(t)


@query(CENTRAL + ", r AS (SELECT *, row_number() OVER (ORDER BY centrality DESC, rel) AS rank, (SELECT greatest(3, round_even(count(*) * 0.05, 0)) FROM ce) AS cut FROM ce WHERE centrality > 0) SELECT fid, rel, centrality, rank FROM r WHERE rank <= cut")
def w11_downtown(t: TableFacts) -> DataFrame:
    return signals.downtown(_centrality(t))


@query(HIST + ", r AS (SELECT fid, recent_churn, row_number() OVER (ORDER BY round(recent_churn, 6), fid) / count(*) OVER () AS heat FROM heat WHERE recent_churn > 0) SELECT fid, heat, heat >= 0.9 AS top_churn FROM r")
def w3_w12_heat(t: TableFacts) -> DataFrame:
    heat = history.recent_churn(log(t)).where("recent_churn > 0").withColumn("recent_churn", F.round("recent_churn", 6))
    # All of these rows count, those that rounding takes to zero as well.
    placed = measures.numbered(heat, [F.col("recent_churn"), F.col("fid")], "place").withColumn("heat", F.col("place") / F.col("_total"))
    return placed.select("fid", "heat", (F.col("heat") >= 0.9).alias("top_churn"))


@query("""x AS (SELECT fid, loc, 6.0 + 3.2::DOUBLE * sqrt(loc) AS height FROM files), r AS (SELECT *, row_number() OVER (ORDER BY height, loc) AS n, count(*) OVER () AS c FROM x),
k AS (SELECT max(height) FILTER (n = floor(c * 0.75)) AS tower, max(height) FILTER (n = floor(c * 0.4)) AS slab FROM r)
SELECT fid, round(height, 6) AS height, CASE WHEN height >= tower THEN 'tower' WHEN height >= slab THEN 'slab' ELSE 'warehouse' END AS archetype FROM x, k""")
def w5_pr7_archetypes(t: TableFacts) -> DataFrame:
    no = F.lit(False)
    h = t.files.select("fid", measures.height(F.col("language"), F.col("loc"), F.lit(None).cast("long"), no).alias("height"), "loc", F.lit(1).alias("floors"))
    return signals.code_archetypes(h).withColumn("height", F.round("height", 6))


@query(HIST + ", seen AS (SELECT author, max(last_t) AS seen FROM fa GROUP BY 1) SELECT fid, primary_author, share, (head - seen) / 86400.0 AS away_days FROM ow JOIN seen ON author = primary_author, head WHERE (head - seen) / 86400.0 >= 1 AND share >= 0.2")
def r7_j21_knowledge_risk(t: TableFacts) -> DataFrame:
    rows = log(t)
    authors = history.file_authors(rows)
    return signals.knowledge_risk(history.ownership(authors), authors, history.head(rows), away_days=1, share=0.2)


@query(HIST + "SELECT fid, primary_author, share, commits FROM ow JOIN h USING (fid) WHERE share >= 0.2 AND commits >= 3")
def pr14_sole_tenants(t: TableFacts) -> DataFrame:
    rows = log(t)
    return signals.sole_tenants(history.ownership(history.file_authors(rows)), history.file_history(rows), share=0.2)


@query(HIST + """SELECT a, b, x.rel AS rel_a, y.rel AS rel_b, n FROM cp JOIN files x ON x.fid = a JOIN files y ON y.fid = b JOIN h p ON p.fid = a JOIN h q ON q.fid = b
WHERE n >= 3 AND x.district <> y.district AND n / greatest(1, least(p.commits, q.commits)) >= 0.05 AND NOT EXISTS (SELECT 1 FROM imports WHERE (src = a AND dst = b) OR (src = b AND dst = a)) ORDER BY n DESC, rel_a, rel_b LIMIT 200""")
def r9_j7_hidden_coupling(t: TableFacts) -> DataFrame:
    return signals.hidden_coupling(coupling(t), t.files, history.file_history(log(t)), t.imports, share=0.05, tasks=t.more_tasks)


@query(HIST + ", g AS (SELECT fid, rel, loc, commits FROM files JOIN h USING (fid)), b AS (SELECT *, (loc >= 40)::BIGINT + (commits >= 35)::BIGINT * 2 + (rel LIKE 'promo%')::BIGINT * 4 AS bits FROM g) SELECT bits, count(*) AS files, sum(loc)::BIGINT AS loc FROM b GROUP BY bits")
def pr21_pr22_bitmask(t: TableFacts) -> DataFrame:
    g = t.files.join(history.file_history(log(t)).select("fid", "commits"), "fid")
    bits = measures.bitmask(F.col("loc") >= 40, F.col("commits") >= 35, F.col("rel").startswith("promo"))
    return g.withColumn("bits", bits).groupBy("bits").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


# -- folders -----------------------------------------------------------------------

EDGES = """
ed AS (SELECT src, dst, s.subfolder AS sf, d.subfolder AS df FROM imports JOIN files s ON s.fid = src JOIN files d ON d.fid = dst),
mx AS (SELECT sf, df, count(*) AS n FROM ed WHERE sf <> df GROUP BY 1, 2)
"""


def _edges(t: TableFacts) -> DataFrame:
    return folders.edges(t.files, t.imports, "subfolder")


@query("d AS (SELECT 1 AS depth, district AS k FROM files UNION ALL SELECT unnest([2, 3, 4, 5, 6, 7, 8]), subfolder FROM files), c AS (SELECT depth, k, count(*) AS n FROM d GROUP BY 1, 2) SELECT depth, count(*) AS folders, sum((n = 1)::INT)::BIGINT AS singletons FROM c GROUP BY depth")
def r14_depth_counts(t: TableFacts) -> DataFrame:
    return folders.depth_counts(t.files)


@query("one AS (SELECT 1) SELECT district, count(*) AS files, sum(loc)::BIGINT AS loc, sum(greatest(1.0, loc))::DOUBLE AS weight, max(loc) AS largest, 0::BIGINT AS tests, 0::BIGINT AS docs FROM files GROUP BY 1")
def a15_pr11_pr16_rollup(t: TableFacts) -> DataFrame:
    return folders.rollup(t.files)


@query("a AS (SELECT district AS region, loc FROM files UNION ALL SELECT subfolder, loc FROM files) SELECT region, count(*) AS files, sum(loc)::BIGINT AS loc FROM a GROUP BY 1")
def a23_region_totals(t: TableFacts) -> DataFrame:
    return folders.region_totals(t.files)


@query(HIST + ", s AS (SELECT district, author, sum(lines)::BIGINT AS lines FROM files JOIN fa USING (fid) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY lines DESC, author) AS rank FROM s) SELECT district, author, lines, rank FROM r WHERE rank <= 3")
def a16_a20_leading_authors(t: TableFacts) -> DataFrame:
    return folders.leading_author(t.files, history.file_authors(log(t)), top=3)


@query(HIST + "SELECT district, least(23, floor((head - t) / 2592000.0))::INT AS bucket, count(*) AS changes, count(DISTINCT author) AS authors FROM cc JOIN files USING (fid), head GROUP BY 1, 2")
def a19_folder_trend(t: TableFacts) -> DataFrame:
    rows = history.with_head(log(t)).withColumn("bucket", F.least(F.lit(23), F.floor((F.col("head") - F.col("t")) / 2592000.0)).cast("int"))
    return folders.folder_trend(t.files, rows)


@query(EDGES + "SELECT sf AS src_folder, df AS dst_folder, n FROM mx")
def a24_j8_folder_matrix(t: TableFacts) -> DataFrame:
    return folders.matrix(_edges(t))


MEASURES = EDGES + """, fm AS (SELECT folder, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 4) END AS instability, coalesce(ei, 0) AS edges_in, coalesce(eo, 0) AS edges_out
FROM (SELECT DISTINCT subfolder AS folder FROM files) LEFT JOIN (SELECT df AS folder, count(DISTINCT src) AS ca, count(*) AS ei FROM ed WHERE sf <> df GROUP BY 1) USING (folder) LEFT JOIN (SELECT sf AS folder, count(DISTINCT src) AS ce, count(*) AS eo FROM ed WHERE sf <> df GROUP BY 1) USING (folder))
"""


@query(MEASURES + "SELECT * FROM fm")
def a24_folder_measures(t: TableFacts) -> DataFrame:
    return folders.folder_coupling_measures(t.files, _edges(t), "subfolder")


@query(MEASURES + """, k AS (SELECT subfolder AS folder, sum(loc % 5)::BIGINT AS classes, sum(CASE WHEN loc % 7 = 0 THEN loc % 5 ELSE 0 END)::BIGINT AS abstract FROM files GROUP BY 1),
z AS (SELECT folder, classes, abstract, round(abstract / classes, 4) AS abstractness, instability, ca, ce FROM k JOIN fm USING (folder) WHERE classes > 0)
SELECT folder, classes, abstract, abstractness, instability, round(abs(abstractness + instability - 1.0), 4) AS distance, CASE WHEN round(abs(abstractness + instability - 1.0), 4) >= 0.2 AND classes >= 2 AND ca + ce >= 3 THEN CASE WHEN abstractness + instability < 1.0 THEN 'pain' ELSE 'uselessness' END ELSE '' END AS zone FROM z""")
def a25_main_sequence(t: TableFacts) -> DataFrame:
    from dataclasses import replace

    classes = t.files.groupBy(F.col("subfolder").alias("folder")).agg(F.sum(F.col("loc") % 5).alias("classes"), F.sum(F.when(F.col("loc") % 7 == 0, F.col("loc") % 5).otherwise(0)).alias("abstract"))
    return folders.main_sequence(folders.folder_coupling_measures(t.files, _edges(t), "subfolder"), classes, replace(DEFAULT, zone_distance=0.2))


@query(EDGES + "SELECT src, dst, ed.sf AS src_folder, ed.df AS dst_folder, f.n AS forward, b.n AS backward FROM ed JOIN mx f ON f.sf = ed.sf AND f.df = ed.df JOIN mx b ON b.sf = ed.df AND b.df = ed.sf WHERE f.n <= b.n")
def r2_j9_majority_violations(t: TableFacts) -> DataFrame:
    return folders.majority_violations(_edges(t))


@query("""e AS (SELECT src, dst, s.rel AS src_rel, d.rel AS dst_rel FROM imports JOIN files s ON s.fid = src JOIN files d ON d.fid = dst),
l AS (SELECT *, CASE WHEN starts_with(src_rel, 'promo/') THEN 0 WHEN starts_with(src_rel, 'economy/') OR starts_with(src_rel, 'standard/') THEN 1 END AS a, CASE WHEN starts_with(dst_rel, 'promo/') THEN 0 WHEN starts_with(dst_rel, 'economy/') OR starts_with(dst_rel, 'standard/') THEN 1 END AS b FROM e),
r AS (SELECT *, CASE WHEN regexp_full_match(src_rel, 'small/.*1[0-9].*') AND starts_with(dst_rel, 'large/') THEN 'forbidden: small/*1[0-9]* must not import large' WHEN b < a THEN 'layer ' || (a + 1) || ' imports layer ' || (b + 1) || ', which sits above it' END AS reason FROM l)
SELECT src, dst, src_rel, dst_rel, reason FROM r WHERE reason IS NOT NULL""")
def r2_j10_pr30_rule_violations(t: TableFacts) -> DataFrame:
    return folders.rule_violations(_edges(t), [["promo"], ["economy/**", "standard"]], [(["small/*1[0-9]*"], ["large"])])


@query(HIST + """, m AS (SELECT rel, loc, coalesce(fan_out, 0) AS fan_out, coalesce(in_degree, 0) AS in_degree FROM files LEFT JOIN deg USING (fid)),
u AS (SELECT rel, 'max_fanin' AS key, in_degree AS value, 3.0::DOUBLE AS lim FROM m UNION ALL SELECT rel, 'max_fanout', fan_out, CASE WHEN starts_with(rel, 'promo/') THEN 2.0 ELSE 3.0 END FROM m UNION ALL SELECT rel, 'max_loc', loc, CASE WHEN starts_with(rel, 'promo/') THEN 30.0::DOUBLE END FROM m)
SELECT rel, key, value::DOUBLE AS value, lim::DOUBLE AS "limit" FROM u WHERE value > lim""")
def r3_j11_building_codes(t: TableFacts) -> DataFrame:
    m = t.files.join(signals.degrees(t.imports), "fid", "left").na.fill(0).select("rel", F.col("loc").alias("max_loc"), F.col("fan_out").alias("max_fanout"), F.col("in_degree").alias("max_fanin"))
    return folders.code_limits(m, [([], {"max_fanout": 3, "max_fanin": 3}), (["promo"], {"max_loc": 30, "max_fanout": 2})])


@query(HIST + """, m AS (SELECT rel, loc, coalesce(fan_out, 0) AS fan_out FROM files LEFT JOIN deg USING (fid))
SELECT rel, 'max_fanout' AS budget, fan_out::DOUBLE AS value, 3.0::DOUBLE AS "limit" FROM m WHERE fan_out > 3 UNION ALL SELECT rel, 'max_file_loc', loc::DOUBLE, 45.0::DOUBLE FROM m WHERE loc > 45""")
def r4_budgets(t: TableFacts) -> DataFrame:
    m = t.files.join(signals.degrees(t.imports), "fid", "left").na.fill(0).select("rel", F.col("loc").alias("max_file_loc"), F.col("fan_out").alias("max_fanout"))
    return folders.budgets(m, {"max_file_loc": 45, "max_fanout": 3})


@query(HIST + ", p AS (SELECT least(x.district, y.district) AS folder_a, greatest(x.district, y.district) AS folder_b, n FROM cp JOIN files x ON x.fid = a JOIN files y ON y.fid = b WHERE x.district <> y.district) SELECT folder_a, folder_b, count(*) AS pairs, sum(n)::BIGINT AS commits FROM p GROUP BY 1, 2 ORDER BY commits DESC, pairs DESC, folder_a, folder_b LIMIT 12")
def a26_j6_cochange(t: TableFacts) -> DataFrame:
    return folders.cochange(t.files, coupling(t), tasks=t.more_tasks)


# -- graph -------------------------------------------------------------------------

REACH = """
rc AS (SELECT src, dst FROM imports UNION SELECT rc.src, i.dst FROM rc JOIN imports i ON i.src = rc.dst),
cy AS (SELECT a.src AS node, least(min(a.dst), a.src) AS cycle FROM rc a JOIN rc b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
"""


@query(REACH + "SELECT src, dst FROM rc")
def g3_closure(t: TableFacts) -> DataFrame:
    return graph.closure(t.imports)


@query(REACH + "SELECT node, cycle, count(*) OVER (PARTITION BY cycle) AS size FROM cy")
def g1_g2_cycles(t: TableFacts) -> DataFrame:
    return graph.cycles(t.imports)


@query(REACH + "SELECT f.fid, count(s.fid) AS impact, count(DISTINCT s.subfolder) AS impact_folders FROM files f LEFT JOIN rc ON rc.dst = f.fid AND rc.src <> f.fid LEFT JOIN files s ON s.fid = rc.src GROUP BY f.fid")
def g3_u6_impact(t: TableFacts) -> DataFrame:
    return graph.impact(t.imports, t.files)


@query(REACH + """, nd AS (SELECT n AS node, coalesce(cycle, n) AS c FROM (SELECT src AS n FROM imports UNION SELECT dst FROM imports) LEFT JOIN cy ON node = n),
dg AS (SELECT DISTINCT x.c AS a, y.c AS b FROM imports JOIN nd x ON x.node = src JOIN nd y ON y.node = dst WHERE x.c <> y.c),
dp AS (SELECT a, b, 1 AS d FROM dg UNION SELECT dp.a, dg.b, d + 1 FROM dp JOIN dg ON dg.a = dp.b)
SELECT node AS fid, coalesce(max(d), 0)::INT AS depth FROM nd LEFT JOIN dp ON a = c GROUP BY node""")
def g4_import_depth(t: TableFacts) -> DataFrame:
    return graph.import_depth(t.imports)


@query("bl AS (SELECT * FROM (SELECT dst AS fid, 0 AS hop FROM imports GROUP BY dst ORDER BY count(DISTINCT src) DESC, dst LIMIT 1) UNION SELECT src, hop + 1 FROM bl JOIN imports ON dst = fid WHERE hop < 4) SELECT fid, min(hop)::INT AS hop FROM bl GROUP BY fid")
def g5_blast_radius(t: TableFacts) -> DataFrame:
    """Of the file that most others import."""
    most = t.imports.groupBy("dst").agg(F.countDistinct("src").alias("n")).orderBy(F.desc("n"), "dst").first()
    return graph.blast_radius(t.imports, [most["dst"]] if most else [])


@query(HIST + "SELECT fid, rel, (head - last_t) / 86400.0 AS idle_days FROM files JOIN h USING (fid), head WHERE (head - last_t) / 86400.0 >= 180 AND fid NOT IN (SELECT dst FROM imports)")
def g7_orphans(t: TableFacts) -> DataFrame:
    rows = log(t)
    return graph.orphans(t.files, t.imports, history.file_history(rows), history.head(rows))


@query("""m AS (SELECT rel AS dst, replace(replace(rel, '.py', ''), '/', '.') AS module FROM files),
s AS (SELECT rel, spec, list_filter(str_split(spec, '.'), lambda x: x <> '') AS names FROM (SELECT f.rel, replace(replace(g.rel, '.py', ''), '/', '.') || '.name' AS spec FROM imports JOIN files f ON f.fid = src JOIN files g ON g.fid = dst)),
p AS (SELECT rel, spec, unnest(range(1, len(names) + 1)) AS n, names FROM s),
q AS (SELECT p.rel, spec, n, dst FROM p JOIN m ON module = array_to_string(list_slice(names, 1, n), '.') WHERE dst <> p.rel)
SELECT rel AS src, spec, arg_max(dst, n) AS dst FROM q GROUP BY 1, 2""")
def j3_python_imports(t: TableFacts) -> DataFrame:
    side = lambda c: t.files.select(F.col("fid").alias(c), F.col("rel").alias(f"{c}_rel"))
    spec = F.concat(F.replace(F.regexp_replace("dst_rel", r"\.py$", ""), F.lit("/"), F.lit(".")), F.lit(".name"))
    raw = t.imports.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_rel").alias("rel"), spec.alias("spec"))
    return graph.resolve_python(raw, t.files, t.tasks if t.all_rows else None)


@query("one AS (SELECT 1) SELECT f.rel AS src, '../../' || regexp_replace(g.rel, '\\.py$', '') AS spec, g.rel AS dst FROM imports JOIN files f ON f.fid = src JOIN files g ON g.fid = dst")
def j4_relative_imports(t: TableFacts) -> DataFrame:
    side = lambda c: t.files.select(F.col("fid").alias(c), F.col("rel").alias(f"{c}_rel"))
    raw = t.imports.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_rel").alias("rel"), F.concat(F.lit("../../"), F.regexp_replace("dst_rel", r"\.py$", "")).alias("spec"))
    js = t.files.select(F.regexp_replace("rel", r"\.py$", ".ts").alias("rel"))
    found = graph.resolve_relative(raw.select(F.regexp_replace("rel", r"\.py$", ".ts").alias("rel"), "spec"), js, t.tasks if t.all_rows else None)
    return found.select(F.regexp_replace("src", r"\.ts$", ".py").alias("src"), "spec", F.regexp_replace("dst", r"\.ts$", ".py").alias("dst"))


# -- owners ------------------------------------------------------------------------

EXPERT = HIST + ", sc AS (SELECT fid, author, lines * pow(0.5, greatest(0, (head - last_t) / 86400.0) / 180.0) AS score FROM fa, head)"


@query(EXPERT + ", r AS (SELECT fid, author, round(score / sum(score) OVER (PARTITION BY fid), 4) AS share, row_number() OVER (PARTITION BY fid ORDER BY round(score, 6) DESC, author) AS rank FROM sc WHERE score > 0) SELECT * FROM r WHERE rank <= 3")
def w13_experts(t: TableFacts) -> DataFrame:
    rows = log(t)
    return owners.experts(owners.expert_scores(history.file_authors(rows), history.head(rows)))


@query(HIST + ", r AS (SELECT fid, author, lines / sum(lines) OVER (PARTITION BY fid) AS share, row_number() OVER (PARTITION BY fid ORDER BY lines DESC, author) AS rank FROM fa) SELECT * FROM r WHERE rank <= 5")
def w14_author_shares(t: TableFacts) -> DataFrame:
    return owners.author_shares(history.file_authors(log(t)))


RULES = "# nobody has medium\n[Types] @NATION_9\n/small/ @NATION_3\nlarge/ @NATION_3\n*#*.py @NATION_9\n/promo/ @org/team @NATION_7\neconomy/Brand11/ @NATION_11\n*_7*.py @NATION_17 # sevens\n/standard/**/Brand2?/ @NATION_18\n"
DECLARED = r""", dc AS (SELECT fid, rel, CASE WHEN regexp_full_match(rel, 'standard/(?:.*/)?Brand2[^/]/.*') THEN ['@NATION_18'] WHEN regexp_matches(rel, '(?:^|.*/)[^/]*_7[^/]*\.py(?:/.*)?$') THEN ['@NATION_17']
    WHEN regexp_full_match(rel, 'economy/Brand11/.*') THEN ['@NATION_11'] WHEN regexp_full_match(rel, 'promo/.*') THEN ['@org/team', '@NATION_7'] WHEN regexp_full_match(rel, '(?:.*/)?large/.*|small/.*') THEN ['@NATION_3'] END AS owners FROM files)"""


@query(HIST + DECLARED + " SELECT fid, array_to_string(owners, ' ') AS owners FROM dc")
def j12_pr31_declared_owners(t: TableFacts) -> DataFrame:
    return owners.declared(t.files, owners.parse_codeowners(RULES)).select("fid", F.array_join("owners", " ").alias("owners"))


@query(HIST + DECLARED + """, kn AS (SELECT DISTINCT fid, replace(o, '@', '') AS author FROM (SELECT fid, unnest(owners) AS o FROM dc) WHERE o NOT LIKE '@%/%' AND replace(o, '@', '') IN (SELECT author FROM fa)),
tt AS (SELECT fid, sum(lines) AS total FROM fa GROUP BY 1),
al AS (SELECT kn.fid, max((kn.author = primary_author OR coalesce(lines, 0) / total >= 0.1)::INT) AS aligned FROM kn JOIN tt USING (fid) LEFT JOIN ow USING (fid) LEFT JOIN fa ON fa.fid = kn.fid AND fa.author = kn.author GROUP BY 1)
SELECT fid, owners IS NULL AS unowned, coalesce(aligned = 0, false) AS drift FROM dc LEFT JOIN al USING (fid)""")
def r8_j13_pr32_owner_drift(t: TableFacts) -> DataFrame:
    authors = history.file_authors(log(t))
    names = authors.select("author").distinct()
    mails = names.select("author", F.concat(F.lower("author"), F.lit("@example.com")).alias("email"))
    return owners.drift(owners.declared(t.files, owners.parse_codeowners(RULES)), owners.identities(names, mails), authors, history.ownership(authors))


@query(EXPERT + """, tc AS (SELECT DISTINCT commit_id, subfolder AS folder FROM changes JOIN files USING (fid)), wd AS (SELECT commit_id, count(*) AS width FROM tc GROUP BY 1),
cm AS (SELECT folder, count(*) AS commits, round(avg((width > 1)::INT), 4) AS cross_share FROM tc JOIN wd USING (commit_id) GROUP BY 1),
rc AS (SELECT subfolder AS folder, count(DISTINCT author) AS recent_authors FROM cc JOIN files USING (fid), head WHERE floor((head - t) / 2592000.0) < 3 GROUP BY 1),
es AS (SELECT subfolder AS folder, author, sum(score) AS score FROM sc JOIN files USING (fid) GROUP BY 1, 2), tp AS (SELECT folder, round(max(score) / sum(score), 4) AS top_share FROM es GROUP BY 1)
SELECT folder, commits, cross_share, coalesce(recent_authors, 0) AS recent_authors, top_share, coalesce(recent_authors, 0) > 5 AND top_share < 0.4 AS many_cooks FROM cm LEFT JOIN rc USING (folder) LEFT JOIN tp USING (folder)""")
def a27_teams(t: TableFacts) -> DataFrame:
    rows = log(t)
    return folders.teams(t.files, rows, history.author_buckets(rows), owners.expert_scores(history.file_authors(rows), history.head(rows)), by="subfolder", tasks=t.tasks)


# -- tests and sources ---------------------------------------------------------------


@query("""tf AS (SELECT CASE fid % 3 WHEN 0 THEN district || '/tests/test_mod' || (fid % 40) || '.py' WHEN 1 THEN subfolder || '/mod' || (fid % 40) || '.py' ELSE district || '/Mod' || (fid % 40) || 'Test.java' END AS rel, CASE fid % 3 WHEN 2 THEN 'java' ELSE 'python' END AS language FROM files),
d AS (SELECT DISTINCT rel, language FROM tf), te AS (SELECT rel AS test, language, regexp_extract(rel, 'test_(mod[0-9]+)\\.py$', 1) AS stem, str_split(rel, '/')[1] AS top FROM d WHERE language = 'python' AND rel LIKE '%/tests/%'),
so AS (SELECT rel AS source, language, regexp_extract(rel, '/(mod[0-9]+)\\.py$', 1) AS stem, str_split(rel, '/')[1] AS top FROM d WHERE language = 'python' AND rel NOT LIKE '%/tests/%'),
p AS (SELECT test, source, rank() OVER (PARTITION BY test ORDER BY (te.top = so.top)::INT DESC) AS r FROM te JOIN so USING (language, stem)) SELECT test, source FROM p WHERE r = 1""")
def r5_j15_pr20_test_links(t: TableFacts) -> DataFrame:
    rel = F.expr("CASE fid % 3 WHEN 0 THEN district || '/tests/test_mod' || (fid % 40) || '.py' WHEN 1 THEN subfolder || '/mod' || (fid % 40) || '.py' ELSE district || '/Mod' || (fid % 40) || 'Test.java' END")
    files = t.files.select(rel.alias("rel"), F.expr("CASE fid % 3 WHEN 2 THEN 'java' ELSE 'python' END").alias("language")).distinct()
    return tests_map.links(files)


# -- clones --------------------------------------------------------------------------

KEYS = ", ".join(f"'{k}'" for k in clones.KEYWORDS)
PRINTS = f"""
ln AS (SELECT doc_id AS fid, list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ls FROM documents),
nm AS (SELECT fid, list_filter(list_transform(ls, lambda x: CASE WHEN starts_with(x, '#') OR starts_with(x, '//') OR starts_with(x, '/*') OR starts_with(x, '*') OR starts_with(x, '--') OR starts_with(x, '<!--') THEN ''
    ELSE regexp_replace(array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(x, '("(?:[^"\\\\\\\\]|\\\\\\\\.)*"|''(?:[^''\\\\\\\\]|\\\\\\\\.)*''|`[^`]*`)', 'S', 'g'), '\\b\\d[\\d_.xXa-fA-F]*\\b', 'N', 'g'), '[\\p{{L}}_$][\\p{{L}}\\p{{N}}_$]*|[^\\p{{L}}_$]'),
        lambda w: CASE WHEN regexp_matches(w, '^[\\p{{L}}_$]') AND w NOT IN ({KEYS}) THEN 'I' ELSE w END), ''), '\\s+', '', 'g') END), lambda y: length(y) >= 6) AS ls FROM ln),
gr AS (SELECT fid, list_transform(range(1, len(ls) - 4), lambda i: md5(array_to_string(list_slice(ls, i, i + 5), chr(10)))) AS g FROM nm WHERE len(ls) >= 6),
fp AS (SELECT DISTINCT fid, unnest(list_transform(range(1, greatest(1, len(g) - 3) + 1), lambda i: list_min(list_slice(g, i, i + 3)))) AS fp FROM gr)
""".replace("\\\\\\\\", "\\\\")


def _prints(t: TableFacts) -> DataFrame:
    return clones.fingerprints(t.table("documents").select(F.col("doc_id").alias("fid"), "text"), F.md5)


@query(PRINTS + "SELECT fid, fp FROM fp")
def cl1_cl2_w17_fingerprints(t: TableFacts) -> DataFrame:
    return _prints(t)


@query(PRINTS + """, fw AS (SELECT fp FROM fp GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12), sh AS (SELECT a.fid AS a, b.fid AS b, count(*) AS shared FROM fp a JOIN fp b ON a.fp = b.fp AND a.fid < b.fid WHERE a.fp IN (SELECT fp FROM fw) GROUP BY 1, 2),
sz AS (SELECT fid, count(*) AS n FROM fp GROUP BY 1) SELECT a, b, shared, round(least(1.0, shared / least(x.n, y.n)), 3) AS ratio FROM sh JOIN sz x ON x.fid = a JOIN sz y ON y.fid = b WHERE (shared / least(x.n, y.n) >= 0.5 AND shared >= 2) OR shared >= 12""")
def cl3_j16_clone_pairs(t: TableFacts) -> DataFrame:
    return clones.clone_pairs(_prints(t))


# -- snapshots, grades, lists ----------------------------------------------------------

SNAP = HIST + """,
s0 AS (SELECT fid AS key, sum(added) FILTER (t < 946684800)::BIGINT AS loc, (sum(added) FILTER (t < 946684800) >= 600)::BIGINT + (count(*) FILTER (is_fix AND NOT is_revert AND t < 946684800) >= 6)::BIGINT * 2 AS bits FROM cc WHERE fid % 10 <> 0 GROUP BY 1 HAVING count(*) FILTER (t < 946684800) > 0),
s1 AS (SELECT fid AS key, sum(added)::BIGINT AS loc, (sum(added) >= 600)::BIGINT + (count(*) FILTER (is_fix AND NOT is_revert) >= 6)::BIGINT * 2 AS bits FROM cc WHERE fid % 7 <> 0 GROUP BY 1),
dl AS (SELECT coalesce(n.key, o.key) AS key, CASE WHEN o.loc IS NULL THEN 'added' WHEN n.loc IS NULL THEN 'removed' WHEN abs(n.loc - o.loc) >= 10 AND abs(n.loc - o.loc) >= 0.1 * greatest(1, o.loc) THEN CASE WHEN n.loc > o.loc THEN 'grown' ELSE 'shrunk' END ELSE '' END AS delta,
    coalesce(n.loc - o.loc, 0) AS loc_delta, coalesce(n.bits & ~o.bits, 0) AS became, coalesce(o.bits & ~n.bits, 0) AS resolved FROM s1 n FULL JOIN s0 o ON n.key = o.key)
"""


def _delta(t: TableFacts) -> DataFrame:
    def snapshot(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(F.col("fid").alias("key")).agg(F.sum("added").alias("loc"), F.sum(F.col("is_fix").cast("long")).alias("fixes"))
        return sums.select("key", "loc", measures.bitmask(F.col("loc") >= 600, F.col("fixes") >= 6).alias("bits"))

    rows = log(t)
    return changes_since.delta(snapshot(rows.where("fid % 7 <> 0")), snapshot(rows.where("fid % 10 <> 0 and t < 946684800")))


@query(SNAP + "SELECT * FROM dl")
def r11_j18_u3_delta(t: TableFacts) -> DataFrame:
    return _delta(t)


@query(SNAP + "SELECT 'large' AS signal, sum(became & 1)::BIGINT AS became, sum(resolved & 1)::BIGINT AS resolved FROM dl UNION ALL SELECT 'buggy', sum(became >> 1 & 1)::BIGINT, sum(resolved >> 1 & 1)::BIGINT FROM dl")
def r11_signal_moves(t: TableFacts) -> DataFrame:
    return changes_since.signal_moves(_delta(t), ("large", "buggy"))


GRADE = HOT + """,
de AS (SELECT fid FROM (SELECT fid, fixes, fixes / commits AS fr, commits, CASE WHEN fixes > 0 THEN cume_dist() OVER (PARTITION BY fixes > 0 ORDER BY fixes / commits) ELSE 0 END AS p FROM h WHERE commits >= 5) WHERE p >= 0.9 AND fixes >= 2 AND fr >= 0.3),
sg AS (SELECT f.district, f.loc, coalesce(hotspot_rank <= cut, false) AS hotspot, de.fid IS NOT NULL AS defect, coalesce(in_degree >= 2 AND fan_out >= 2, false) AS hub FROM files f LEFT JOIN hot USING (fid) LEFT JOIN de ON de.fid = f.fid LEFT JOIN deg ON deg.fid = f.fid),
gs AS (SELECT *, hotspot::INT * 1.0::DOUBLE + defect::INT * 1.0::DOUBLE + hub::INT * 0.5::DOUBLE AS raw, sqrt(greatest(0, loc)) AS w FROM sg)
"""


def _signals(t: TableFacts) -> DataFrame:
    h = history.file_history(log(t))
    hot = signals.hotspots(t.files, h).select("fid", F.col("is_hotspot").alias("hotspot"))
    bad = signals.defects(h).select("fid", F.lit(True).alias("defect"))
    hub = signals.degrees(t.imports).select("fid", ((F.col("in_degree") >= 2) & (F.col("fan_out") >= 2)).alias("hub"))
    return t.files.join(hot, "fid", "left").join(bad, "fid", "left").join(hub, "fid", "left").na.fill(False, ["hotspot", "defect", "hub"])


@query(GRADE + "SELECT district, round(greatest(0.0, 100.0 * (1.0 - sum(least(1.0, raw) * w) / sum(w))), 1) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM gs GROUP BY district")
def a32_grades(t: TableFacts) -> DataFrame:
    return changes_since.grades(_signals(t), "district")


@query(GRADE + """, e AS (SELECT district, w, raw, 'hotspot' AS signal, 1.0 AS k FROM gs WHERE hotspot UNION ALL SELECT district, w, raw, 'defect', 1.0 FROM gs WHERE defect UNION ALL SELECT district, w, raw, 'hub', 0.5 FROM gs WHERE hub)
SELECT district, signal, round(sum(least(1.0, raw) * w * k / raw) / (SELECT sum(w) FROM gs g WHERE g.district = e.district) * 100, 1) AS points FROM e GROUP BY district, signal""")
def a32_grade_points(t: TableFacts) -> DataFrame:
    return changes_since.grade_points(_signals(t), "district")


@query(HOT + """, a AS (SELECT 'hotspots' AS list, row_number() OVER (ORDER BY hotspot_rank) AS rank, fid FROM hot WHERE hotspot_rank <= cut), b AS (SELECT 'largest', row_number() OVER (ORDER BY loc DESC, rel), fid FROM files WHERE loc >= 40), c AS (SELECT 'fixed', row_number() OVER (ORDER BY fixes DESC, rel), fid FROM h JOIN files USING (fid) WHERE fixes > 0)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE rank <= 15""")
def t1_t3_review_lists(t: TableFacts) -> DataFrame:
    h = history.file_history(log(t))
    wide = t.files.join(h.select("fid", "fixes"), "fid", "left").join(signals.hotspots(t.files, h).select("fid", "hotspot_rank", "is_hotspot"), "fid", "left")
    return changes_since.top_lists(wide, {"hotspots": (F.col("is_hotspot"), [F.col("hotspot_rank")]), "largest": (F.col("loc") >= 40, [F.desc("loc"), F.col("rel")]), "fixed": (F.col("fixes") > 0, [F.desc("fixes"), F.col("rel")])}, DEFAULT.list_limit)


@query("s AS (SELECT date_trunc('month', ts) AS m, count(*) AS commits, count(DISTINCT author) AS authors FROM commits GROUP BY 1) SELECT strftime(m, '%Y-%m') AS generated, epoch(m) AS head_t, commits, authors FROM s ORDER BY head_t DESC LIMIT 30")
def t9_census(t: TableFacts) -> DataFrame:
    m = F.date_trunc("month", F.col("ts").cast("timestamp"))
    rows = t.commits.groupBy(m.alias("m")).agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))
    return changes_since.census(rows.select(F.date_format("m", "yyyy-MM").alias("generated"), history.seconds(F.col("m")).alias("head_t"), "commits", "authors"))


# -- filter language and bands -----------------------------------------------------------

INDEX = HOT + """,
ix AS (SELECT f.fid, f.rel, str_split(f.rel, '/')[-1] AS name, '.py' AS ext, f.language, f.district, f.loc, ow.primary_author AS owner, coalesce(fan_in, 0) AS fanin, coalesce(fan_out, 0) AS fanout, h.fixes, h.commits, h.fixes / h.commits AS fix_ratio,
    (coalesce(hotspot_rank <= cut, false)::BIGINT * 512 + (f.loc >= 45)::BIGINT * 1024) AS flags, coalesce(hotspot_rank <= cut, false) AS hotspot,
    CASE WHEN tr.recent >= 2 AND tr.recent >= tr.before * 1.5 + 1 THEN 1 WHEN tr.before >= 2 AND tr.recent * 2 <= tr.before THEN -1 ELSE 0 END AS trend
    FROM files f LEFT JOIN hot USING (fid) LEFT JOIN ow ON ow.fid = f.fid LEFT JOIN deg ON deg.fid = f.fid LEFT JOIN h ON h.fid = f.fid LEFT JOIN tr ON tr.fid = f.fid)
"""


def _index(t: TableFacts) -> DataFrame:
    rows = log(t)
    h = history.file_history(rows)
    out = t.files.select("fid", "rel", "language", "district", "loc", paths.name_of(F.col("rel")).alias("name"), paths.extension(F.col("rel")).alias("ext"))
    out = out.join(signals.hotspots(t.files, h).select("fid", F.col("is_hotspot").alias("hotspot")), "fid", "left").na.fill(False, ["hotspot"])
    out = out.join(history.ownership(history.file_authors(rows)).select("fid", F.col("primary_author").alias("owner")), "fid", "left")
    out = out.join(signals.degrees(t.imports).select("fid", F.col("fan_in").alias("fanin"), F.col("fan_out").alias("fanout")), "fid", "left").na.fill(0, ["fanin", "fanout"])
    out = out.join(signals.fix_ratios(h), "fid", "left").join(history.trend(history.activity(rows)).select("fid", "trend"), "fid", "left")
    return out.withColumn("flags", F.when(F.col("hotspot"), dsl.BITS["hotspot"]).otherwise(0) + F.when(F.col("loc") >= 45, dsl.BITS["oversized"]).otherwise(0))


DSL_QUERIES = {
    "q3_q4_q12_flags": ("is:hotspot loc>=30 OR is:oversized -is:hotspot", "(flags & 512 <> 0 AND loc >= 30) OR (flags & 1024 <> 0 AND NOT flags & 512 <> 0)"),
    "q5_q8_owner_trend": ('is:cooling owner:"nation_1"', "trend < 0 AND contains(lower(owner), 'nation_1')"),
    "q6_q7_path": ("path:Promo/* ext:py lang:python", "starts_with(lower(rel), 'promo/') AND ext = '.py' AND lower(language) = 'python'"),
    "q9_q11_district": ("district:economy fanin>2 | _77 -district:promo | unknown:x", "(lower(district) = 'economy' AND fanin > 2) OR (contains(lower(name), '_77') AND NOT lower(district) = 'promo')"),
    "q10_j20_imports": ("imports:small/ -importedby:large/", "EXISTS (SELECT 1 FROM imports JOIN files g ON g.fid = dst WHERE src = ix.fid AND starts_with(lower(g.rel), 'small/')) AND NOT EXISTS (SELECT 1 FROM imports JOIN files g ON g.fid = src WHERE dst = ix.fid AND starts_with(lower(g.rel), 'large/'))"),
    "q13_j19_fixes": ("fixes>=8 heat>0 || fixes>=10", "fixes >= 10"),
}
for _name, (_text, _where) in DSL_QUERIES.items():

    def _run(t: TableFacts, text: str = _text) -> DataFrame:
        return dsl.run(_index(t), text, t.imports).select("fid", "rel", "loc")

    _run.__name__ = _name
    query(INDEX + f"SELECT fid, rel, loc FROM ix WHERE {_where}")(_run)


@query(INDEX + "SELECT 'hot' AS name, count(*) FILTER (flags & 512 <> 0) AS n FROM ix UNION ALL SELECT 'large', count(*) FILTER (loc > 40) FROM ix UNION ALL SELECT 'all', count(*) FROM ix")
def q14_legend_counts(t: TableFacts) -> DataFrame:
    return dsl.counts(_index(t), {"hot": "is:hotspot", "large": "loc>40", "all": ""})


@query(INDEX + "SELECT count(*) AS files, count(DISTINCT district) AS districts, coalesce(sum(loc), 0)::BIGINT AS loc FROM ix WHERE flags & 512 <> 0")
def a35_query_summary(t: TableFacts) -> DataFrame:
    return dsl.summary(dsl.run(_index(t), "is:hotspot"))


@query(INDEX + "SELECT 'district' AS facet, district AS value, count(*) AS n FROM ix GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM ix GROUP BY 2 UNION ALL SELECT 'trend', trend::VARCHAR, count(*) FROM ix GROUP BY 2")
def a12_a13_a34_facets(t: TableFacts) -> DataFrame:
    return dsl.facets(_index(t), ["district", "language", "trend"])


@query(INDEX + "SELECT 'defects' AS lens, CASE WHEN fixes >= 2 AND fix_ratio >= 0.5 THEN 'half fixes' WHEN fixes > 0 THEN 'some fixes' ELSE 'none' END AS band, count(*) AS n FROM ix GROUP BY 2 UNION ALL SELECT 'trend', CASE WHEN hotspot AND trend > 0 THEN 'rising hotspot' WHEN trend > 0 THEN 'rising' WHEN trend < 0 THEN 'cooling' ELSE 'steady' END, count(*) FROM ix GROUP BY 2")
def pr24_a38_lens_counts(t: TableFacts) -> DataFrame:
    ix = _index(t).withColumns({"rising": F.col("hotspot") & (F.col("trend") > 0), "defect": F.lit(False), "bugprone": F.lit(False)})
    return bands.lens_counts(ix, "defects").select(F.lit("defects").alias("lens"), "band", "n").unionByName(bands.lens_counts(ix, "trend").select(F.lit("trend").alias("lens"), "band", "n"))


@query(INDEX + "SELECT CASE WHEN hotspot THEN 'hotspot' WHEN fanin >= 3 AND fanout >= 3 THEN 'hub' WHEN loc >= 45 THEN 'oversized' ELSE 'healthy' END AS signal, count(*) AS n FROM ix GROUP BY 1")
def pr26_pressing_signal(t: TableFacts) -> DataFrame:
    ix = _index(t).withColumns({"hub": (F.col("fanin") >= 3) & (F.col("fanout") >= 3), "oversized": F.col("loc") >= 45, "orphan": F.lit(True)})
    return ix.groupBy(bands.pressing({"hotspots", "hubs"}, ix.columns).alias("signal")).agg(F.count("*").alias("n"))


@query(HIST + ERA + "SELECT ag.fid, coalesce(commits, 0) / (SELECT max(commits) FROM act) AS burn FROM ag LEFT JOIN (SELECT fid, commits FROM act WHERE bucket = 12) b ON b.fid = ag.fid WHERE age_days >= 365")
def r16_timeline(t: TableFacts) -> DataFrame:
    rows = log(t)
    return bands.timeline(history.eras(history.file_history(rows)), history.activity(rows), 365)


# -- texts -------------------------------------------------------------------------------


@query(r"""l AS (SELECT doc_id, text, regexp_split_to_array(text, '\r\n|[\n\r]') AS a FROM documents), m AS (SELECT *, list_transform(CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END, lambda x: trim(x)) AS b FROM l)
SELECT doc_id, len(list_filter(b, lambda x: x <> ''))::INT AS logical_loc, len(list_filter(b, lambda x: starts_with(x, 'Das')))::INT AS comment_lines, (CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END)::INT AS physical_lines FROM m""", facts=True)
def pa3_sc15_generic_parse(t: TableFacts) -> DataFrame:
    return text.generic_parse(t.table("documents").select("doc_id", "text"), "Das").select("doc_id", "logical_loc", "comment_lines", "physical_lines")


@query(r"""x AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS s FROM pages) SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) AS body FROM x""")
def pa19_page_text(t: TableFacts) -> DataFrame:
    return t.table("pages").select("page_id", text.page_text(F.col("html")).alias("body"))


@query(r"""x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>')) AS h FROM pages), y AS (SELECT page_id, regexp_extract(h, '(?i)^<h([1-6])', 1)::INT AS level, regexp_replace(h, '<[^>]+>', ' ', 'g') AS s FROM x)
SELECT page_id, level, trim(regexp_replace(replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) AS title FROM y""")
def pa18_headings(t: TableFacts) -> DataFrame:
    return text.headings(t.table("pages"))


@query(r"""l AS (SELECT doc_id AS id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) AS l, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r]'), 1) AS line FROM documents),
m AS (SELECT id, line, regexp_extract(l, '^(The|La|Die)[: ]+([^\n]*)', 1) AS marker, regexp_extract(l, '^(The|La|Die)[: ]+([^\n]*)', 2) AS note FROM l WHERE l <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS r FROM m WHERE marker <> '')
SELECT id, line::INT AS line, marker, length(note) AS note_chars FROM n WHERE r <= 5""")
def pa22_debt_scan(t: TableFacts) -> DataFrame:
    docs = t.table("documents").select(F.col("doc_id").alias("id"), "text")
    first = r"^(The|La|Die)[: ]+([^\n]*)"
    from pyspark.sql import Window

    rows = docs.select("id", F.posexplode(text.lines(F.col("text"))).alias("n", "l")).select("id", (F.col("n") + 1).alias("line"), F.regexp_extract("l", first, 1).alias("marker"), F.length(F.regexp_extract("l", first, 2)).cast("long").alias("note_chars")).where("marker <> ''")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("line"))).where("r <= 5").drop("r")


# In the twin letters with accents are made plain before the search, as DuckDB would see the end of a word before one.
DEBT_FIRST, DEBT_LATER = r"^\s*@?(The|La|Die)\b(?:\([^)]*\))?[:\s]*([^\n]*)", r"^[^\n]*?\b(The|La|Die)(?:\([^)]*\))?:\s*([^\n]*)"


@query(rf"""l AS (SELECT doc_id AS id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) AS l, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r]'), 1) AS line FROM documents),
z AS (SELECT id, line, l, regexp_replace(l, '[\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{24F}}]', 'z', 'g') AS z FROM l),
m AS (SELECT id, line, regexp_extract(z, '{DEBT_FIRST}', 1) AS a, right(l, length(regexp_extract(z, '{DEBT_FIRST}', 2))) AS x, regexp_extract(z, '{DEBT_LATER}', 1) AS b, right(l, length(regexp_extract(z, '{DEBT_LATER}', 2))) AS y FROM z),
n AS (SELECT id, line, CASE WHEN a <> '' THEN a ELSE b END AS marker, trim(regexp_replace(regexp_replace(trim(CASE WHEN a <> '' THEN x ELSE y END), '[*/\-> ]+$', ''), '\s+', ' ', 'g')) AS s FROM m WHERE a <> '' OR b <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS r FROM n)
SELECT id, line::INT AS line, marker, CASE WHEN length(s) > 100 THEN rtrim(s[:99]) || '…' ELSE s END AS note FROM r WHERE r <= 50""")
def pa22_debt_in_texts(t: TableFacts) -> DataFrame:
    """The whole scan, with words that the texts have in the place of the markers, and each line in that of a comment."""
    return text.debt(t.table("documents").select(F.col("doc_id").alias("id"), "text"), ("The", "La", "Die"), "^", DEFAULT.debt_per_file)


@query(r"""x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 60 THEN rtrim(s[:59]) || '…' ELSE s END AS short FROM x""")
def pa24_shorten(t: TableFacts) -> DataFrame:
    return t.table("documents").select("doc_id", text.shorten(F.col("text"), 60).alias("short"))


@query("x AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) AS events FROM events GROUP BY 1) SELECT * FROM x")
def a43_conditional_counts(t: TableFacts) -> DataFrame:
    return t.table("events").groupBy("user_id").agg(F.sum((F.col("event_type") == "error").cast("long")).alias("errors"), F.count("*").alias("events"))


@query("""im AS (SELECT f.rel, f.district, CASE src % 3 WHEN 0 THEN 'os.path' WHEN 1 THEN 'Pkg_' || (dst % 25) || '.x' ELSE 'yaml' END AS spec FROM imports JOIN files f ON f.fid = src),
us AS (SELECT DISTINCT rel, district, CASE WHEN spec = 'yaml' THEN 'pyyaml' ELSE lower(replace(str_split(spec, '.')[1], '_', '-')) END AS package FROM im WHERE spec <> 'os.path'),
de AS (SELECT 'pkg-' || i AS package FROM range(10, 30) r(i))
SELECT package, count(DISTINCT rel) AS files, count(DISTINCT district) AS folders, package IN (SELECT package FROM de) AS declared FROM us GROUP BY 1 ORDER BY files DESC, package LIMIT 40""")
def a30_r10_packages(t: TableFacts) -> DataFrame:
    used, declared = _packages(t)
    return externals.usage(used, declared, t.files)


@query("""im AS (SELECT f.rel, CASE src % 3 WHEN 0 THEN 'os.path' WHEN 1 THEN 'Pkg_' || (dst % 25) || '.x' ELSE 'yaml' END AS spec FROM imports JOIN files f ON f.fid = src),
us AS (SELECT DISTINCT CASE WHEN spec = 'yaml' THEN 'pyyaml' ELSE lower(replace(str_split(spec, '.')[1], '_', '-')) END AS package FROM im WHERE spec <> 'os.path'), de AS (SELECT 'pkg-' || i AS package FROM range(10, 30) r(i))
SELECT package, 'undeclared' AS kind FROM us WHERE package NOT IN (SELECT package FROM de) UNION ALL SELECT package, 'unused' FROM de WHERE package NOT IN (SELECT package FROM us)""")
def j17_u2_mismatches(t: TableFacts) -> DataFrame:
    return externals.mismatches(*_packages(t))


def _packages(t: TableFacts) -> tuple[DataFrame, DataFrame]:
    spec = F.expr("CASE src % 3 WHEN 0 THEN 'os.path' WHEN 1 THEN 'Pkg_' || (dst % 25) || '.x' ELSE 'yaml' END")
    raw = t.imports.join(t.files.select(F.col("fid").alias("src"), "rel"), "src").select("rel", spec.alias("spec"))
    used = externals.python_packages(raw, externals.local_names(t.files))
    return used, t.spark.range(10, 30).select(F.concat(F.lit("pkg-"), F.col("id").cast("string")).alias("package"))


# -- sinks, streams, layout ------------------------------------------------------------------


@query(HIST + "SELECT a, b, n FROM cp ORDER BY n DESC, a, b LIMIT 2000")
def sk8_j22_bridges(t: TableFacts) -> DataFrame:
    return sinks.bridges(coupling(t), t.files, tasks=t.more_tasks)


@query(EDGES + ", w AS (SELECT src, dst FROM ed JOIN mx f ON f.sf = ed.sf AND f.df = ed.df JOIN mx b ON b.sf = ed.df AND b.df = ed.sf WHERE f.n <= b.n) SELECT i.src, i.dst, (w.src IS NOT NULL)::INT AS violates FROM imports i LEFT JOIN w ON w.src = i.src AND w.dst = i.dst")
def sk9_import_edges(t: TableFacts) -> DataFrame:
    return sinks.import_edges(t.imports, folders.majority_violations(_edges(t)))


@query(INDEX + "SELECT rel, loc, trim(CASE WHEN flags & 512 <> 0 THEN 'hotspot ' ELSE '' END || CASE WHEN flags & 1024 <> 0 THEN 'oversized' ELSE '' END) AS signals FROM ix")
def sk14_csv_rows(t: TableFacts) -> DataFrame:
    return sinks.csv_rows(_index(t), ["rel", "loc"], {"hotspot": dsl.BITS["hotspot"], "oversized": dsl.BITS["oversized"]})


@query(r"""l AS (SELECT doc_id AS id, str_split(text, chr(10)) AS a FROM documents), u AS (SELECT id, unnest(range(1, len(a) + 1)) AS line, a FROM l), z AS (SELECT id, line, a[line] || CASE WHEN line < len(a) THEN chr(10) ELSE '' END AS s FROM u)
SELECT id, line::INT AS line, coalesce(sum(octet_length(encode(s))) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", octet_length(encode(s))::BIGINT AS bytes FROM z WHERE s <> ''""")
def sk7_w18_line_offsets(t: TableFacts) -> DataFrame:
    return text.line_offsets(t.table("documents").select(F.col("doc_id").alias("id"), "text"))


@query(select("SELECT rel, rel AS body FROM files"))
def sk16_encrypted_round_trip(t: TableFacts) -> DataFrame:
    """Bodies encrypted and read back, with a key of all rounds; every frame is longer than its body by nonce and tag."""
    key = sinks.derive_key("a passphrase", b"salt" * 4)
    files = t.files.select(F.col("fid").alias("id"), "rel")
    frames = sinks.encrypted(files.withColumnRenamed("rel", "body"), key)
    back = sinks.decrypted(frames, key).join(frames.select("id", F.octet_length("frame").alias("size")), "id")
    return back.join(files, "id").select("rel", F.when(F.col("size") == F.octet_length("rel") + 28, F.col("body")).alias("body"))


@query()
def l1_l4_layout(t: TableFacts) -> DataFrame:
    rects, _ = layout.districts(folders.rollup(t.files))
    heights = t.files.withColumn("height", measures.height(F.col("language"), F.col("loc"), F.lit(None).cast("long"), F.lit(False)))
    return layout.placements(heights, rects)


@query()
def sc20_synthetic_repository(t: TableFacts) -> DataFrame:
    """Its log: every file with the commits that change it."""
    files, log_ = synthetic.files(t.spark, 10_000, 400), synthetic.changes(t.spark, 10_000, 40)
    return files.join(log_, "fid", "left").join(synthetic.commits(t.spark, 40), "commit_id", "left").select(*files.columns, "commit_id", "author", "ts", "subject", "added", "deleted")


@query("""w AS (SELECT event_type AS path, time_bucket(INTERVAL '10 days', ts, TIMESTAMP '1970-01-01') AS s, user_id, value FROM events) SELECT path, epoch(s)::BIGINT AS start, count(*) AS commits FROM w GROUP BY 1, 2""")
def a7_streaming_activity(t: TableFacts) -> DataFrame:
    """The streaming plan itself, run over the stored events until all are taken."""
    spark = t.spark
    schema = t.table("events").schema
    stream = spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parque[t]")
    rows = stream.select(F.col("event_type").alias("path"), F.col("user_id").alias("author"), F.col("ts").cast("timestamp").alias("ts"))
    out = storage.fresh_folder(spark)
    activity.run_once(activity.windowed(rows, width="10 days"), out, storage.fresh_folder(spark)).awaitTermination()
    return spark.read.parquet(out).select("path", F.unix_seconds("start").alias("start"), "commits")


# -- totals and short lists ------------------------------------------------------------------


@query("d AS (SELECT district, subfolder, loc FROM files) SELECT district, str_split(subfolder, '/')[2] AS subfolder, count(*) AS files, sum(loc)::BIGINT AS loc FROM d GROUP BY 1, 2")
def a22_subfolders(t: TableFacts) -> DataFrame:
    return rollups.subfolders(t.files, 1)


@query(INDEX + "SELECT count(*) AS files, sum(loc)::BIGINT AS loc, sum(hotspot::INT)::BIGINT AS hotspots, sum((loc >= 45)::INT)::BIGINT AS large, sum(fixes)::BIGINT AS fixes, sum((fanin = 0)::INT)::BIGINT AS unimported FROM ix")
def a28_a41_a42_totals(t: TableFacts) -> DataFrame:
    return rollups.totals(_index(t), {"files": "1", "loc": "loc", "hotspots": "hotspot", "large": "loc >= 45", "fixes": "fixes", "unimported": "fanin = 0"})


@query(CENTRAL + ", r AS (SELECT fid, row_number() OVER (ORDER BY centrality DESC, rel) <= (SELECT greatest(3, round_even(count(*) * 0.05, 0)) FROM ce) AND centrality > 0 AS dt FROM ce), s AS (SELECT district, avg(dt::INT) AS share FROM files JOIN r USING (fid) GROUP BY 1) SELECT district, share, share > 0 AND share >= 2.0 * (SELECT avg(dt::INT) FROM r) AS is_cbd FROM s")
def a36_central_districts(t: TableFacts) -> DataFrame:
    town = signals.downtown(_centrality(t)).select("fid", F.lit(True).alias("downtown"))
    return rollups.central_districts(t.files.join(town, "fid", "left").na.fill(False, ["downtown"]))


@query(HIST + "SELECT district, round(avg(recent_churn), 4) AS heat FROM files JOIN heat USING (fid) GROUP BY 1")
def a37_district_heat(t: TableFacts) -> DataFrame:
    return t.files.join(history.recent_churn(log(t)), "fid").groupBy("district").agg(F.round(F.avg("recent_churn"), 4).alias("heat"))


@query(EDGES + "SELECT ed.sf AS src_folder, ed.df AS dst_folder, count(*) AS n FROM ed JOIN mx f ON f.sf = ed.sf AND f.df = ed.df JOIN mx b ON b.sf = ed.df AND b.df = ed.sf WHERE f.n <= b.n GROUP BY 1, 2")
def a40_violating_pairs(t: TableFacts) -> DataFrame:
    return folders.majority_violations(_edges(t)).groupBy("src_folder", "dst_folder").agg(F.count("*").alias("n"))


@query(MEASURES + ", b AS (SELECT folder, coalesce(instability, 0.5) AS i FROM fm ORDER BY edges_in + edges_out DESC, folder LIMIT 12), p AS (SELECT folder, row_number() OVER (ORDER BY i DESC, folder) AS place FROM b) SELECT sf AS src_folder, df AS dst_folder, n, p.place FROM mx JOIN p ON p.folder = sf JOIN p q ON q.folder = df")
def t5_dependency_matrix(t: TableFacts) -> DataFrame:
    e = _edges(t)
    return rollups.dependency_matrix(folders.matrix(e), folders.folder_coupling_measures(t.files, e, "subfolder"))


@query(EDGES + ", a AS (SELECT * FROM mx ORDER BY n DESC, sf, df LIMIT 15), b AS (SELECT f.* FROM mx f JOIN mx k ON k.sf = f.df AND k.df = f.sf WHERE f.n <= k.n) SELECT sf AS src_folder, df AS dst_folder, n FROM a UNION SELECT sf, df, n FROM b")
def t6_t14_flows(t: TableFacts) -> DataFrame:
    e = _edges(t)
    return rollups.flows(folders.matrix(e), folders.majority_violations(e))


@query("""fz AS (SELECT rel, lower(rel) AS hay, length(rel) - length(str_split(rel, '/')[-1]) AS nm, 0 AS i, 0 AS nx, 0 AS run, 0 AS points FROM files
UNION ALL SELECT rel, hay, nm, i + 1, p + 1, r, points + CASE WHEN r > 0 THEN 4 + r ELSE 1 END + CASE WHEN p = 0 OR substr(hay, p, 1) IN ('/', '_', '-', '.') THEN 3 ELSE 0 END + CASE WHEN p >= nm THEN 2 ELSE 0 END
    FROM (SELECT *, CASE WHEN p = nx AND i > 0 THEN run + 1 ELSE 0 END AS r FROM (SELECT *, nx + instr(substr(hay, nx + 1), 'ecobr.py'[i + 1]) - 1 AS p FROM fz WHERE i < 8) WHERE p >= nx))
SELECT rel, round(points - length(hay) * 0.02::DOUBLE, 6) AS score FROM fz WHERE i = 8 ORDER BY score DESC, length(rel), rel LIMIT 12""")
def t7_find_files(t: TableFacts) -> DataFrame:
    return rollups.find_files(t.files, "ecobr.py")


@query(HIST + "SELECT CASE WHEN a = 5 THEN b ELSE a END AS partner, n FROM cp WHERE a = 5 OR b = 5 ORDER BY n DESC, partner LIMIT 30")
def t11_co_change_partners(t: TableFacts) -> DataFrame:
    return rollups.co_change_partners(t.changes, 5, bulk(t))


@query("""s AS (SELECT l_orderkey AS key, CASE l_returnflag WHEN 'R' THEN 'function' WHEN 'A' THEN 'class' ELSE 'heading' END AS kind, l_partkey::VARCHAR AS name, l_quantity::BIGINT AS loc, l_linenumber * 100000 + l_partkey AS line FROM lineitem),
r AS (SELECT *, CASE kind WHEN 'function' THEN 2 WHEN 'class' THEN 1 END AS r FROM s WHERE kind <> 'heading'), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r DESC, loc DESC, line) AS n FROM r) SELECT key, name, loc FROM n WHERE n = 1""")
def w16_longest_definition(t: TableFacts) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "function").when(F.col("l_returnflag") == "A", "class").otherwise("heading")
    rows = t.table("lineitem").select(F.col("l_orderkey").alias("key"), kind.alias("kind"), F.col("l_partkey").cast("string").alias("name"), F.col("l_quantity").cast("long").alias("loc"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("line"))
    return rollups.longest_definition(rows)


@query(INDEX + "SELECT rel, 'warn' AS level, 'Changes often and is large: look here first.' AS note FROM ix WHERE hotspot UNION ALL SELECT rel, 'note', 'Imported by many and importing many.' FROM ix WHERE fanin >= 3 AND fanout >= 3")
def pr27_pr28_notes(t: TableFacts) -> DataFrame:
    ix = _index(t).withColumns({"is_hotspot": F.col("hotspot"), "is_hub": (F.col("fanin") >= 3) & (F.col("fanout") >= 3), "bus_factor": F.lit(2), **{c: F.lit(False) for c in ("is_defect", "in_cycle", "is_orphan", "is_clone", "violates", "untested")}})
    return rollups.notes(ix)


@query("""x AS (SELECT fid, loc, (fid % 7)::INT AS k, loc * 40 AS size FROM files), y AS (SELECT fid, CASE WHEN k > 0 THEN 3.5::DOUBLE + 1.45::DOUBLE * sqrt(loc / k) ELSE 4.0::DOUBLE + 0.055::DOUBLE * sqrt(size) END AS s,
    CASE WHEN k > 0 THEN CASE WHEN k = 1 THEN 1.0 ELSE greatest(3, loc + 1) * k / (3 * (k - 1) + loc + 1) END ELSE pow(size / (loc + 3 * greatest(0, k - 1)) / 45.0, 2) END AS spread FROM x),
z AS (SELECT fid, least(40.0, greatest(3.5, s)) AS s, sqrt(least(2.6, greatest(0.5, pow(spread, 0.25)))) AS r FROM y) SELECT fid, round(least(46.0, greatest(2.5, s * r)), 6) AS w, round(least(46.0, greatest(2.5, s / r)), 6) AS d FROM z""")
def pr8_footprints(t: TableFacts) -> DataFrame:
    k = (F.col("fid") % 7).cast("int")
    starts = F.when(k == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), k - 1)), lambda i: (i * 3 + 1).cast("long")))
    plan = rollups.footprint(F.col("loc") * 40, F.col("loc"), starts, F.col("loc") + F.greatest(F.lit(0), k - 1) * 3 + F.when(k > 0, 1).otherwise(0))
    return t.files.select("fid", plan.alias("p")).select("fid", F.round("p.w", 6).alias("w"), F.round("p.d", 6).alias("d"))


# -- scans, parsers and predicates over tables that stand in for files -----------------------------


@query(r"""l AS (SELECT doc_id, text, regexp_split_to_array(text, '\r\n|[\n\r]') AS a FROM documents), n AS (SELECT doc_id, len(list_filter(a, lambda x: trim(x) <> '')) AS k FROM l) SELECT doc_id, k::BIGINT AS logical_loc, k::BIGINT AS doc_lines, 'high' AS confidence FROM n""")
def pa1_pa17_parse_markdown(t: TableFacts) -> DataFrame:
    """The documents as Markdown files through the parser that repositories go through."""
    files = t.table("documents").select(F.col("doc_id").cast("string").alias("rel"), F.lit("x.md").alias("name"), F.lit(False).alias("is_binary"), F.encode("text", "UTF-8").alias("content"))
    return repo.parsed(files).select(F.col("rel").cast("long").alias("doc_id"), "logical_loc", "doc_lines", "confidence")


@query("x AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<h[1-6]\\b')) AS h FROM pages) SELECT page_id, h::BIGINT AS headings FROM x")
def pa18_parse_html(t: TableFacts) -> DataFrame:
    files = t.table("pages").select(F.col("page_id").cast("string").alias("rel"), F.lit("x.html").alias("name"), F.lit(False).alias("is_binary"), F.encode("html", "UTF-8").alias("content"))
    records = repo.parsed(files)
    return records.select(F.col("rel").cast("long").alias("page_id"), F.size(F.filter("floors", lambda f: f["kind"] == "heading")).cast("long").alias("headings"))


#: The properties of events as they are, as an array of as many entries as the id ends in, inside an object, as a number, and cut off.
JSON_CASES = """CASE event_id % 5 WHEN 1 THEN '[' || repeat('{},', (event_id % 10)::INT) || '0]' WHEN 2 THEN '{"a": "x", "rows": [' || repeat('[1, "]"], ', (event_id % 10)::INT) || 'null]}' WHEN 3 THEN '17' WHEN 4 THEN '{"a": [1, 2' ELSE props END"""


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN event_id % 10 + 1 WHEN 2 THEN greatest(2, event_id % 10 + 1) WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE len(json_keys(props)) END::BIGINT AS rows FROM events""")
def sc13_sc14_json_rows(t: TableFacts) -> DataFrame:
    return t.table("events").select("event_id", text.json_rows(F.expr(JSON_CASES.replace("::INT", ""))).alias("rows"))


@query("x AS (SELECT doc_id, len(list_filter(str_split(text, chr(10)), lambda x: trim(x) <> '')) AS rows FROM documents) SELECT doc_id, rows::INT AS rows FROM x")
def sc12_jsonl_rows(t: TableFacts) -> DataFrame:
    return t.table("documents").select("doc_id", text.jsonl_rows(F.col("text")).alias("rows"))


CASES = "CASE fid % 9 WHEN 0 THEN district || '/tests/a' || fid || '.py' WHEN 1 THEN 'Vendor/' || fid || '.js' WHEN 2 THEN district || '/test_' || fid || '.py' WHEN 3 THEN district || '/README.md' WHEN 4 THEN district || '/x' || fid || '.spec.ts' WHEN 5 THEN '__pycache__/' || fid || '.txt' WHEN 6 THEN district || '/package.json' WHEN 7 THEN district || '/x' || fid || '.min.js' ELSE district || '/contest_' || fid || '.pyc' END"


@query(f"c AS (SELECT fid, fid % 9 AS k, {CASES} AS rel FROM files) SELECT rel, k IN (0, 2, 4) AS is_test, k = 3 AS is_doc, k IN (1, 7) AS is_vendored, k IN (5, 8) AS is_noise, k = 6 AS is_config, '.' || str_split(rel, '.')[-1] AS ext FROM c")
def pr1_pr5_pr17_path_kinds(t: TableFacts) -> DataFrame:
    rel = F.col("rel")
    return t.files.select(F.expr(CASES).alias("rel")).select("rel", paths.is_test(rel).alias("is_test"), paths.is_doc(rel).alias("is_doc"), paths.is_vendored(rel).alias("is_vendored"), paths.is_noise(rel).alias("is_noise"), paths.is_config(rel).alias("is_config"), paths.extension(rel).alias("ext"))


@query("x AS (SELECT DISTINCT p_type FROM part) SELECT p_type, lower(regexp_replace(trim(' ' || p_type || '__x.-y '), '[-_.]+', '-', 'g')) AS name FROM x")
def pr19_package_names(t: TableFacts) -> DataFrame:
    return t.table("part").select("p_type").distinct().select("p_type", paths.package_name(F.concat(F.lit(" "), "p_type", F.lit("__x.-y "))).alias("name"))


@query(HIST + "SELECT f.fid, f.rel, h.commits, CASE WHEN h.fid IS NULL THEN 'unknown' ELSE 'git' END AS authorship FROM files f LEFT JOIN (SELECT * FROM h WHERE fid % 4 <> 0) h ON h.fid = f.fid")
def j1_j2_files_with_history(t: TableFacts) -> DataFrame:
    told = history.file_history(log(t).where("fid % 4 <> 0")).select("fid", "commits", F.lit("git").alias("authorship"))
    return t.files.select("fid", "rel").join(told, "fid", "left").na.fill("unknown", ["authorship"])


@query(REACH + """, sg AS (SELECT district, count(*) AS files, sum((loc >= 45)::INT)::BIGINT AS large, count(DISTINCT cycle) AS cycles, sum((node IS NOT NULL)::INT)::BIGINT AS in_cycle FROM files LEFT JOIN cy ON node = fid GROUP BY 1) SELECT * FROM sg""")
def a17_a18_district_health(t: TableFacts) -> DataFrame:
    c = graph.cycles(t.imports).select(F.col("node").alias("fid"), "cycle")
    return t.files.join(c, "fid", "left").groupBy("district").agg(F.count("*").alias("files"), F.sum((F.col("loc") >= 45).cast("long")).alias("large"), F.countDistinct("cycle").alias("cycles"), F.sum(F.col("cycle").isNotNull().cast("long")).alias("in_cycle"))


@query(HIST + "SELECT subfolder, author, lines, share, rank FROM (SELECT subfolder, author, sum(lines)::BIGINT AS lines, sum(lines) / sum(sum(lines)) OVER (PARTITION BY subfolder) AS share, row_number() OVER (PARTITION BY subfolder ORDER BY sum(lines) DESC, author) AS rank FROM files JOIN fa USING (fid) GROUP BY 1, 2) WHERE rank <= 2")
def a16_a20_folder_mayors(t: TableFacts) -> DataFrame:
    from pyspark.sql import Window

    sums = t.files.select("fid", "subfolder").join(history.file_authors(log(t)), "fid").groupBy("subfolder", "author").agg(F.sum("lines").alias("lines"))
    whole = Window.partitionBy("subfolder")
    return sums.select("subfolder", "author", "lines", (F.col("lines") / F.sum("lines").over(whole)).alias("share"), F.row_number().over(whole.orderBy(F.desc("lines"), "author")).alias("rank")).where("rank <= 2")


@query(MEASURES + "SELECT folder, ca, ce FROM fm WHERE ca + ce > 0 ORDER BY ca + ce DESC, folder LIMIT 20")
def t4_district_table(t: TableFacts) -> DataFrame:
    m = folders.folder_coupling_measures(t.files, _edges(t), "subfolder")
    return m.where("ca + ce > 0").orderBy(F.desc(F.col("ca") + F.col("ce")), "folder").select("folder", "ca", "ce").limit(20)


@query(EDGES + """, l AS (SELECT sf AS folder, 'depends on' AS way, df AS other, n FROM mx UNION ALL SELECT df, 'depended on by', sf, n FROM mx), r AS (SELECT *, row_number() OVER (PARTITION BY folder, way ORDER BY n DESC, other) AS rank FROM l) SELECT * FROM r WHERE rank <= 8""")
def t12_folder_links(t: TableFacts) -> DataFrame:
    return rollups.folder_links(folders.matrix(_edges(t)))


@query(select("SELECT fid, least(1.0, (loc % 9) / greatest(1, loc)) AS doc_ratio, CASE WHEN fid % 5 < 2 AND fid % 11 <> 0 AND fid % 13 <> 0 THEN round(CASE WHEN fid % 3 = 0 THEN greatest(2.0, 0.25::DOUBLE * (6.0 + 3.2::DOUBLE * sqrt(greatest(0, loc - (fid % 17 - 8))))) ELSE 6.0 + 3.2::DOUBLE * sqrt(greatest(0, loc - (fid % 17 - 8))) END, 2) END AS before FROM files"))
def pr10_pr29_then(t: TableFacts) -> DataFrame:
    """Ratios of documentation, and heights before files grew or shrank; deltas and kinds stand in by number."""
    delta = F.when(F.col("fid") % 5 == 0, "grown").when(F.col("fid") % 5 == 1, "shrunk").otherwise("")
    kind = F.when(F.col("fid") % 13 == 0, "monument").when(F.col("fid") % 3 == 0, "park").otherwise("tower")
    then = measures.baseline_height(F.col("language"), F.col("loc"), F.col("fid") % 17 - 8, F.lit(None).cast("long"), F.col("fid") % 11 == 0, delta, kind)
    return t.files.select("fid", measures.doc_ratio(F.col("loc") % 9, F.col("loc")).alias("doc_ratio"), then.alias("before"))


@query(MEASURES + """, k AS (SELECT subfolder AS folder, sum(loc % 5)::BIGINT AS classes, sum(CASE WHEN loc % 7 = 0 THEN loc % 5 ELSE 0 END)::BIGINT AS abstract FROM files GROUP BY 1),
z AS (SELECT folder, classes, round(abstract / classes, 4) AS abstractness, instability, ca, ce, round(abs(round(abstract / classes, 4) + instability - 1.0), 4) AS distance FROM k JOIN fm USING (folder) WHERE classes > 0),
b AS (SELECT CASE WHEN distance >= 0.2 AND classes >= 2 AND ca + ce >= 3 THEN CASE WHEN abstractness + instability < 1.0 THEN 'pain' ELSE 'uselessness' END WHEN distance > 0.5 THEN 'far' WHEN distance >= 0 THEN 'near' ELSE 'too few types' END AS band FROM z) SELECT band, count(*) AS n FROM b GROUP BY 1""")
def pr25_main_sequence_bands(t: TableFacts) -> DataFrame:
    return a25_main_sequence(t).groupBy(measures.main_sequence_band(F.col("zone"), F.col("distance")).alias("band")).agg(F.count("*").alias("n"))


@query(select("""SELECT '/' AS id, false AS leaf, sum(loc)::BIGINT AS weight, '' AS parent FROM files HAVING count(DISTINCT district) > 1
UNION ALL SELECT '/' || district, false, sum(loc)::BIGINT, CASE WHEN (SELECT count(DISTINCT district) FROM files) > 1 THEN '/' ELSE '' END FROM files GROUP BY district HAVING count(DISTINCT subfolder) > 1
UNION ALL SELECT subfolder, true, sum(loc)::BIGINT, CASE WHEN (SELECT count(DISTINCT g.subfolder) FROM files g WHERE g.district = f.district) > 1 THEN '/' || district WHEN (SELECT count(DISTINCT district) FROM files) > 1 THEN '/' ELSE '' END FROM files f GROUP BY district, subfolder"""))
def g8_folder_tree(t: TableFacts) -> DataFrame:
    return folders.folder_tree(t.files.groupBy(F.col("subfolder").alias("key")).agg(F.sum("loc").alias("weight")))


@query("""p AS (SELECT subfolder AS key, sqrt(pow(sum(loc) % 100 - 50, 2) + pow(sum(fid) % 100 - 50, 2)) AS distance, count(*) AS files FROM files GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY distance, key) AS n FROM p WHERE distance <= 40),
w AS (SELECT n, key, distance, files AS total, true AS taken FROM o WHERE n = 1 UNION ALL SELECT o.n, o.key, o.distance, CASE WHEN w.total + o.files <= 60 THEN w.total + o.files ELSE w.total END, w.total + o.files <= 60 FROM w JOIN o ON o.n = w.n + 1)
SELECT key, distance FROM w WHERE taken""")
def t10_resident_districts(t: TableFacts) -> DataFrame:
    """Districts placed by their sums; those near the middle that a budget of files has room for."""
    places = t.files.groupBy(F.col("subfolder").alias("key")).agg((F.sum("loc") % 100).alias("x"), (F.sum("fid") % 100).alias("z"), F.count("*").alias("files"))
    return layout.resident(places, 50.0, 50.0, 40.0, 60)


@query(INDEX + REACH.replace("rc AS", ", rc AS", 1) + """, v AS (SELECT DISTINCT src FROM imports JOIN files s ON s.fid = src JOIN files d ON d.fid = dst WHERE starts_with(s.rel, 'small/') AND starts_with(d.rel, 'large/'))
SELECT count(*) FILTER (hotspot) AS hotspots, count(*) FILTER (hotspot AND trend > 0) AS rising, count(*) FILTER (flags & 1024 <> 0) AS oversized, count(*) FILTER (fanin >= 3 AND fanout >= 3) AS hubs, count(*) FILTER (fixes >= 2 AND fix_ratio >= 0.25) AS bugprone,
(SELECT count(*) FROM v) AS violations, (SELECT count(DISTINCT cycle) FROM cy) AS cycles, (SELECT count(*) FROM cp WHERE n >= 3) AS "coupled" FROM ix""")
def a29_review_totals(t: TableFacts) -> DataFrame:
    """Counts of files over the index in one pass, and of the tables beside it."""
    conditions = {"hotspots": "hotspot", "rising": "hotspot and trend > 0", "oversized": f"flags & {dsl.BITS['oversized']} <> 0", "hubs": "fanin >= 3 and fanout >= 3", "bugprone": "fixes >= 2 and fix_ratio >= 0.25"}
    violations = folders.rule_violations(folders.edges(t.files, t.imports, "subfolder"), [], [(["small"], ["large"])]).agg(F.countDistinct("src").alias("violations"))
    cycles = graph.cycles(t.imports).agg(F.countDistinct("cycle").alias("cycles"))
    coupled = coupling(t).where("n >= 3").agg(F.count("*").alias("coupled"))
    return rollups.totals(_index(t), conditions).crossJoin(violations).crossJoin(cycles).crossJoin(coupled)


@query("""n AS (SELECT count(DISTINCT fid) FILTER (ts < TIMESTAMP '1995-01-01') AS a, count(DISTINCT fid) FILTER (ts < TIMESTAMP '1997-01-01') AS b FROM cc)
SELECT 1 AS step, 'first' AS head, NULL AS baseline, NULL::BIGINT AS files_before, a AS files, 1 AS census FROM n UNION ALL SELECT 2, 'second', 'first', a, b, 2 FROM n UNION ALL SELECT 3, 'second', 'first', a, b, 2 FROM n UNION ALL SELECT 4, 'first', 'second', b, a, 2 FROM n""")
def sc19_r12_sk10_sk11_builds(t: TableFacts) -> DataFrame:
    """Four builds into a fresh folder, the third of the second's commit: what each compares itself to, and the census after it."""
    spark, out, lines = t.spark, storage.fresh_folder(t.spark), log(t)
    done = []
    for step, (head, until) in enumerate((("first", "1995-01-01"), ("second", "1997-01-01"), ("second", "1997-01-01"), ("first", "1995-01-01")), 1):
        files = lines.where(F.col("t") < F.unix_timestamp(F.lit(f"{until} 00:00:00"))).groupBy(F.col("fid").alias("key")).agg(F.sum("added").alias("loc"), F.lit(0).cast("long").alias("bits"))
        rows = snapshots.builds(spark, out)
        before = snapshots.baseline(rows, "r", "path", head).first()
        n_before = before and snapshots.files_of(spark, out, before["build"]).count()
        build = snapshots.append(spark, out, {"root": "r", "keying": "path", "head": head, "head_t": float(head == "second"), "generated": str(step), "totals": {"files": step}}, files)
        census = snapshots.census(snapshots.builds(spark, out), "r", "path")
        done.append((step, head, before and before["head"], n_before, snapshots.files_of(spark, out, build).count(), census.count()))
    return spark.createDataFrame(done, "step int, head string, baseline string, files_before long, files long, census int")


@query()
def j23_files_placed(t: TableFacts) -> DataFrame:
    """Every file, with its place in the plan where it has one."""
    placed = l1_l4_layout(t)
    return t.files.select("fid", "rel").join(placed.drop("rel"), "fid", "left")


@query("one AS (SELECT 1) SELECT fid, rel, loc FROM files WHERE starts_with(rel, 'promo/') ORDER BY loc DESC, rel LIMIT 20")
def t12_folder_report(t: TableFacts) -> DataFrame:
    return t.files.where(F.col("rel").startswith("promo/")).orderBy(F.desc("loc"), "rel").select("fid", "rel", "loc").limit(20)


@query("n AS (SELECT unnest([district, str_split(rel, '/')[2], regexp_replace(str_split(rel, '/')[3], '\\.[^.]*$', '')]) AS name FROM files) SELECT DISTINCT lower(regexp_replace(trim(name), '[-_.]+', '-', 'g')) AS name FROM n")
def u5_local_names(t: TableFacts) -> DataFrame:
    return externals.local_names(t.files)


@query()
def sk17_path_keys(t: TableFacts) -> DataFrame:
    return t.files.select("fid", F.substring(sinks.hmac_column(b"a passphrase", F.col("rel")), 1, 24).alias("key"))


@query("o AS (SELECT fid, row_number() OVER (ORDER BY district, rel) - 1 AS id FROM files) SELECT * FROM o")
def w19_building_ids(t: TableFacts) -> DataFrame:
    """Dense ids by district and path: numbers inside a district, moved by the districts before it."""
    from pyspark.sql import Window

    n = t.files.groupBy("district").agg(F.count("*").alias("n"))
    before = n.select("district", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("district")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("district").orderBy("rel")) - 1
    return t.files.select("fid", "district", nth.alias("nth")).join(before, "district").select("fid", (F.col("before") + F.col("nth")).alias("id"))


@query("x AS (SELECT district, 6.0 + 3.2::DOUBLE * sqrt(loc) AS h FROM files) SELECT district, round(max(h), 6) AS highest, round(avg(h), 6) AS mean FROM x GROUP BY 1")
def a31_skyline(t: TableFacts) -> DataFrame:
    h = measures.height(F.col("language"), F.col("loc"), F.lit(None).cast("long"), F.lit(False))
    return t.files.groupBy("district").agg(F.round(F.max(h), 6).alias("highest"), F.round(F.avg(h), 6).alias("mean"))


@query(SNAP + """, g AS (SELECT district, s0.loc, s0.bits & 1 <> 0 AS hotspot, s0.bits & 2 <> 0 AS defect FROM files JOIN s0 ON s0.key = fid), r AS (SELECT district, sqrt(loc) AS w, least(1.0, hotspot::INT + defect::INT) AS taken FROM g)
SELECT district, round(greatest(0.0, 100.0 * (1.0 - sum(taken * w) / sum(w))), 1) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM r GROUP BY 1""")
def a33_grades_at_baseline(t: TableFacts) -> DataFrame:
    """The folders of now, graded on the files that the earlier snapshot knows, as they stood then."""
    rows = log(t).where("fid % 10 <> 0 and t < 946684800")
    old = rows.groupBy("fid").agg(F.sum("added").alias("old_loc"), F.sum(F.col("is_fix").cast("long")).alias("old_fixes"))
    then = t.files.select("fid", "district").join(old, "fid").select("district", F.col("old_loc").alias("loc"), (F.col("old_loc") >= 600).alias("hotspot"), (F.col("old_fixes") >= 6).alias("defect"))
    return changes_since.grades(then, "district")


@query("s AS (SELECT date_trunc('month', ts) AS m, count(*) AS commits, count(DISTINCT author) AS authors FROM commits GROUP BY 1) SELECT arg_max(commits, m) - arg_min(commits, m) AS commits, arg_max(authors, m) - arg_min(authors, m) AS authors FROM s")
def a39_census_change(t: TableFacts) -> DataFrame:
    m = F.date_trunc("month", F.col("ts").cast("timestamp")).alias("m")
    s = t.commits.groupBy(m).agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))
    return s.agg(*[(F.max_by(c, "m") - F.min_by(c, "m")).alias(c) for c in ("commits", "authors")])


@query(INDEX + ", r AS (SELECT str_split(rel, '/')[1] AS region, hotspot, fixes FROM ix UNION ALL SELECT str_split(rel, '/')[1] || '/' || str_split(rel, '/')[2], hotspot, fixes FROM ix) SELECT region, sum(hotspot::INT)::BIGINT AS hotspots, sum(fixes)::BIGINT AS fixes FROM r GROUP BY 1")
def a44_region_health(t: TableFacts) -> DataFrame:
    return _index(t).select(F.explode(paths.ancestors(F.col("rel"))).alias("region"), F.col("hotspot").cast("long").alias("hotspot"), "fixes").groupBy("region").agg(F.sum("hotspot").alias("hotspots"), F.sum("fixes").alias("fixes"))


@query(HIST + ", b AS (SELECT a, b, n FROM cp WHERE n >= 2 UNION ALL SELECT b, a, n FROM cp WHERE n >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM b) SELECT a, b, n AS shared, k AS n FROM r WHERE k <= 8")
def t8_partners_per_file(t: TableFacts) -> DataFrame:
    pairs = coupling(t).where("n >= 2").withColumnRenamed("n", "shared")
    return clones.partners(pairs, ["shared"], DEFAULT.per_file)


@query(MEASURES + """, k AS (SELECT subfolder AS folder, sum(loc % 5)::BIGINT AS classes, sum(CASE WHEN loc % 7 = 0 THEN loc % 5 ELSE 0 END)::BIGINT AS abstract FROM files GROUP BY 1),
z AS (SELECT folder, round(abs(round(abstract / classes, 4) + instability - 1.0), 4) AS distance FROM k JOIN fm USING (folder) WHERE classes > 0 AND ca + ce >= 3) SELECT folder, distance FROM z ORDER BY distance DESC, folder LIMIT 10""")
def t13_zone_list(t: TableFacts) -> DataFrame:
    classes = t.files.groupBy(F.col("subfolder").alias("folder")).agg(F.sum(F.col("loc") % 5).alias("classes"), F.sum(F.when(F.col("loc") % 7 == 0, F.col("loc") % 5).otherwise(0)).alias("abstract"))
    m = folders.folder_coupling_measures(t.files, _edges(t), "subfolder").where("ca + ce >= 3")
    return folders.main_sequence(m, classes).orderBy(F.desc("distance"), "folder").limit(10).select("folder", "distance")


@query("m AS (SELECT src AS fid, dst AS other, 'imports' AS way FROM imports UNION ALL SELECT dst, src, 'importedby' FROM imports) SELECT fid, way, count(*) AS n FROM m GROUP BY 1, 2")
def g6_edge_maps(t: TableFacts) -> DataFrame:
    out = t.imports.select(F.col("src").alias("fid"), F.lit("imports").alias("way"))
    back = t.imports.select(F.col("dst").alias("fid"), F.lit("importedby").alias("way"))
    return out.unionByName(back).groupBy("fid", "way").agg(F.count("*").alias("n"))


@query("""im AS (SELECT f.rel, f.district, CASE src % 3 WHEN 0 THEN 'os.path' WHEN 1 THEN 'Pkg_' || (dst % 25) || '.x' ELSE 'yaml' END AS spec FROM imports JOIN files f ON f.fid = src),
us AS (SELECT DISTINCT rel, district, CASE WHEN spec = 'yaml' THEN 'pyyaml' ELSE lower(replace(str_split(spec, '.')[1], '_', '-')) END AS package FROM im WHERE spec <> 'os.path'),
c AS (SELECT district, package, count(*) AS files FROM us GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY files DESC, package) AS rank FROM c) SELECT * FROM r WHERE rank <= 8""")
def a21_folder_packages(t: TableFacts) -> DataFrame:
    from pyspark.sql import Window

    used, _ = _packages(t)
    counts = used.join(t.files.select("rel", "district"), "rel").groupBy("district", "package").agg(F.count("*").alias("files"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("district").orderBy(F.desc("files"), "package"))).where("rank <= 8")


@query("""x AS (SELECT fid, CASE fid % 4 WHEN 0 THEN district || '/tests/test_' || fid || '.py' ELSE rel END AS rel FROM files) SELECT s.rel AS test, d.rel AS source FROM imports JOIN x s ON s.fid = src JOIN x d ON d.fid = dst WHERE src % 4 = 0 AND dst % 4 <> 0""")
def j14_tests_by_import(t: TableFacts) -> DataFrame:
    files = t.files.select("fid", F.expr("CASE fid % 4 WHEN 0 THEN district || '/tests/test_' || fid || '.py' ELSE rel END").alias("rel"), "language")
    side = lambda c: files.select(F.col("fid").alias(c), F.col("rel").alias(f"{c}_rel"))
    named = t.imports.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_rel").alias("src"), F.col("dst_rel").alias("dst"))
    return tests_map.links(files, named)


#: Queries over import edges that are offered over the edges of all line items, too. Closures are not: a dense graph's has the square of its files.
ALL_ROWS = "w10_hubs pr15_instability r9_j7_hidden_coupling a24_j8_folder_matrix r2_j9_majority_violations r2_j10_pr30_rule_violations r3_j11_building_codes r4_budgets g5_blast_radius g6_edge_maps g7_orphans j3_python_imports j4_relative_imports j14_tests_by_import q10_j20_imports sk9_import_edges t5_dependency_matrix t6_t14_flows".split()


def over_all_rows(name: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query and its twin, over the import edges of all line items."""
    return lambda spark, sf_dir: FUNCTIONS[name](TableFacts(spark, sf_dir, all_rows=True)), ORACLES[name].replace(FACTS_SQL, ALL_FACTS_SQL)


for _name in ALL_ROWS:
    QUERIES[f"{_name}_all_rows"], ORACLES[f"{_name}_all_rows"] = over_all_rows(_name)
