"""The filter language, compiled to a Column.

Terms side by side must all hold; ``OR``, ``|`` or ``||`` starts another group; ``-`` negates a term;
quotes keep blanks. ``is:flag``, ``ext:``, ``lang:``, ``name:``, ``path:``, ``archetype:``, ``owner:``,
``district:``, ``zone:``, ``imports:``, ``importedby:``, comparisons such as ``loc>=500``, and bare words
(a flag of that name, or part of the file name).

The file index has a column for each name below; edges give the two import terms, as semi-joins.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The flags of the index, by bit.
FLAGS = ("test", "doc", "binary", "ruin", "data", "hot", "new", "downtown", "soletenant", "hotspot", "oversized", "orphan", "cycle", "knowledge", "violation", "untested", "untestedrisk", "drift", "added", "grown", "shrunk", "braced", "unowned", "bugprone", "debt", "codes", "defect", "rising", "hub", "clone", "hiddencoupling")
BITS = {name: 1 << i for i, name in enumerate(FLAGS)} | {"codeviolation": 1 << FLAGS.index("codes")}
#: Query words of numeric columns.
NUMBERS = {"loc": "loc", "age": "age", "heat": "heat", "cx": "cx", "complexity": "cx", "fanin": "fanin", "fanout": "fanout", "delta": "delta", "impact": "impact", "fixes": "fixes", "trend": "trend", "debt": "debt", "todo": "debt", "depth": "depth"}
_NUMERIC = re.compile(r"([a-z]+)(>=|<=|>|<|=)(.*)")
_OPERATORS = {">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__, "=": Column.__eq__}


def tokens(text: str) -> list[str]:
    """Runs without blanks, where quotes hide blanks and vanish."""
    out, current, quoted = [], "", False
    for c in text:
        if c == '"':
            quoted = not quoted
        elif c.isspace() and not quoted:
            out.append(current)
            current = ""
        else:
            current += c
    return [t for t in [*out, current] if t]


def groups(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in tokens(text):
        if t in ("OR", "|", "||"):
            out.append([])
        else:
            out[-1].append(t)
    return [g for g in out if g]


class Compiler:
    """Terms to columns over an index with the given columns; terms on columns it lacks hold nowhere."""

    def __init__(self, columns: list[str]):
        self.columns = set(columns)
        self.edges: dict[str, tuple[str, str]] = {}  # marker column -> (key, path prefix)

    def has(self, name: str) -> bool:
        return name in self.columns

    def flag(self, name: str) -> Column | None:
        if name in BITS and self.has("flags"):
            return F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(BITS[name])) != 0
        return None

    def derived(self, name: str) -> Column | None:
        rules = {"debt": ("debt", lambda c: c > 0), "todo": ("debt", lambda c: c > 0), "warming": ("trend", lambda c: c > 0), "cooling": ("trend", lambda c: c < 0), "deep": ("depth", lambda c: c >= 5)}
        if name in rules and self.has(rules[name][0]):
            column, test = rules[name]
            return test(F.coalesce(F.col(column), F.lit(0)))
        return None

    def text(self, name: str) -> Column | None:
        return F.lower(F.coalesce(F.col(name), F.lit(""))) if self.has(name) else None

    def term(self, raw: str) -> Column:
        if raw.startswith("-") and len(raw) > 1:
            return ~self.term(raw[1:])
        if (m := _NUMERIC.fullmatch(raw.lower())) and m[1] in NUMBERS:
            try:
                value = float(m[3] or 0)
            except ValueError:
                value = 0.0
            column = NUMBERS[m[1]]
            return _OPERATORS[m[2]](F.coalesce(F.col(column).cast("double"), F.lit(0.0)), F.lit(value)) if self.has(column) else F.lit(False)
        key, colon, value = raw.partition(":")
        key, low = key.lower(), value.lower()
        if not colon:
            word = raw.lower()
            options = [c for c in (self.flag(word), F.contains(self.text("name"), F.lit(word)) if self.has("name") else None) if c is not None]
            return reduce(Column.__or__, options) if options else F.lit(False)
        found = self.keyed(key, low)
        return F.lit(False) if found is None else found

    def keyed(self, key: str, value: str) -> Column | None:
        if key == "is":
            found = self.derived(value)
            return self.flag(value) if found is None else found
        if key == "ext" and self.has("ext"):
            return self.text("ext") == (value if value.startswith(".") or value == "(none)" else f".{value}")
        if key in ("lang", "name", "archetype", "zone"):
            column = {"lang": "language"}.get(key, key)
            # Both names of one zone are taken.
            value = "uselessness" if (key, value) == ("zone", "useless") else value
            return self.text(column) == value if self.has(column) else None
        if key == "path" and self.has("rel"):
            return F.startswith(self.text("rel"), F.lit(value.rstrip("*")))
        if key in ("owner", "author") and self.has("owner"):
            return F.contains(self.text("owner"), F.lit(value))
        if key in ("district", "folder") and self.has("district"):
            d = self.text("district")
            return (d == value) | F.startswith(d, F.lit(f"{value.rstrip('/')}/"))
        if key in ("imports", "importedby"):
            marker = f"_edge{len(self.edges)}"
            self.edges[marker] = (key, value.rstrip("*"))
            return F.coalesce(F.col(marker), F.lit(False))
        return None

    def compile(self, text: str) -> Column | None:
        """None for a blank query: no filter."""
        found = [reduce(Column.__and__, [self.term(t) for t in g]) for g in groups(text)]
        return reduce(Column.__or__, found) if found else None


def run(index: DataFrame, text: str, edges: DataFrame | None = None) -> DataFrame:
    """The rows of the index that the query selects. edges: src, dst (fid)."""
    compiler = Compiler(index.columns)
    where = compiler.compile(text)
    if where is None:
        return index
    out = index
    for marker, (key, prefix) in compiler.edges.items():
        ids = index.where(F.startswith(F.lower("rel"), F.lit(prefix))).select("fid")
        if edges is None:
            out = out.withColumn(marker, F.lit(False))
            continue
        near, far = ("src", "dst") if key == "imports" else ("dst", "src")
        hit = edges.join(ids, edges[far] == ids["fid"], "left_semi").select(F.col(near).alias("fid")).distinct().withColumn(marker, F.lit(True))
        out = out.join(hit, "fid", "left")
    return out.where(where).select(*index.columns)


def counts(index: DataFrame, queries: dict[str, str]) -> DataFrame:
    """name, n: how many rows each query selects, all in one pass. Import terms need run()."""
    compiler = Compiler(index.columns)
    found = {name: compiler.compile(q) for name, q in queries.items()}
    if compiler.edges:
        raise ValueError("import terms are joins; use run()")
    one = index.agg(*[F.sum((F.lit(True) if c is None else c).cast("long")).alias(f"c{i}") for i, c in enumerate(found.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("n")) for i, n in enumerate(found)])).alias("x")).select("x.*")


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.countDistinct("district").alias("districts"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))


def facets(index: DataFrame, by: list[str]) -> DataFrame:
    """facet, value, n: counts by each column, with GROUPING SETS in one pass."""
    sets = index.groupingSets([[F.col(c)] for c in by], *[F.col(c) for c in by]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, c in enumerate(by):
        mine = F.col("g").bitwiseAND(F.lit(1 << (len(by) - 1 - i))) == 0
        which = F.when(mine, c).otherwise(which)
        value = F.when(mine, F.col(c).cast("string")).otherwise(value)
    return sets.select(which.alias("facet"), value.alias("value"), "n")
