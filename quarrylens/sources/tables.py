"""Facts from the driver's tables: orders as commits, line items as changes, parts as files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .storage import dealt, tasks_for


@dataclass(eq=False)
class TableFacts:
    """files, commits, changes and imports as lazy DataFrames; nothing is read until an action."""

    spark: SparkSession
    sf_dir: str
    #: Import edges of all line items. Without it they are those of 2.9 % of them, which keeps closures and their SQL small.
    all_rows: bool = False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> int:
        """How many tasks the line items are dealt to; their number is in the files' footers."""
        return tasks_for(self.spark, self.table("lineitem").count())

    @cached_property
    def more_tasks(self) -> int | None:
        """The same where they are more than the session's shuffles have; None leaves a join to Spark, which may broadcast its small side."""
        return self.tasks if self.tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else None

    @cached_property
    def commits(self) -> DataFrame:
        nations = self.table("customer").join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
        subject = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("fix: "), "o_orderstatus")).when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("revert "), "o_orderstatus")).otherwise(F.concat(F.lit("update "), "o_orderstatus"))
        return self.table("orders").join(nations, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("commit_id"), F.col("n_name").alias("author"), F.col("o_orderdate").alias("ts"), subject.alias("subject"))

    @cached_property
    def changes(self) -> DataFrame:
        """One row per commit and file. Dealt by commit first: nearly all keys differ, so that sums before the shuffle would only fill memory."""
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("fid"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").alias("deleted"))
        return dealt(rows, self.tasks, "commit_id").groupBy("commit_id", "fid").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))

    @cached_property
    def files(self) -> DataFrame:
        rel = F.concat(F.lower("p_type"), F.lit("/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey"), F.lit(".py"))
        flat = self.table("part").select(F.col("p_partkey").alias("fid"), rel.alias("rel"), F.col("p_size").cast("long").alias("loc"), F.col("p_retailprice").alias("price"))
        return flat.select("*", paths.district(F.col("rel"), 1).alias("district"), paths.district(F.col("rel"), 2).alias("subfolder"), F.lit("python").alias("language"))

    @cached_property
    def imports(self) -> DataFrame:
        n = self.table("part").select(F.count("*").alias("n"))
        rows = self.table("lineitem") if self.all_rows else self.table("lineitem").where("l_discount >= 0.09 and l_linenumber <= 4 and l_returnflag = 'R'")
        # Edges of all rows are as many as the line items; the others are few, and are left to Spark.
        edges = rows.crossJoin(F.broadcast(n)).select(F.col("l_partkey").alias("src"), F.expr("(l_partkey * 7 + l_suppkey * 13) % n").alias("dst")).where("src <> dst")
        return dealt(edges, self.tasks if self.all_rows else None, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("mult"))


#: The same facts for DuckDB, as common table expressions.
FACTS_SQL = """
commits AS (SELECT o_orderkey AS commit_id, n_name AS author, o_orderdate AS ts,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'fix: ' || o_orderstatus WHEN '2-HIGH' THEN 'revert ' || o_orderstatus ELSE 'update ' || o_orderstatus END AS subject
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
changes AS (SELECT l_orderkey AS commit_id, l_partkey AS fid, sum(CAST(l_quantity AS BIGINT))::BIGINT AS added, sum(l_linenumber)::BIGINT AS deleted FROM lineitem GROUP BY 1, 2),
files AS (SELECT *, split_part(rel, '/', 1) AS district, split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2) AS subfolder, 'python' AS language FROM (
    SELECT p_partkey AS fid, lower(p_type) || '/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.py' AS rel, p_size::BIGINT AS loc, p_retailprice AS price FROM part)),
imports AS (SELECT src, dst, count(*) AS mult FROM (SELECT l_partkey AS src, (l_partkey * 7 + l_suppkey * 13) % (SELECT count(*) FROM part) AS dst
    FROM lineitem WHERE l_discount >= 0.09 AND l_linenumber <= 4 AND l_returnflag = 'R') WHERE src <> dst GROUP BY 1, 2),
cc AS (SELECT c.*, k.author, k.ts, k.subject, epoch(k.ts) AS t, k.subject ~* 'fix|bug' AS is_fix, k.subject LIKE 'revert%' AS is_revert FROM changes c JOIN commits k USING (commit_id)),
head AS (SELECT max(t) AS head, min(t) AS tail FROM cc)"""

#: The same with the import edges of all line items.
ALL_FACTS_SQL = FACTS_SQL.replace(" WHERE l_discount >= 0.09 AND l_linenumber <= 4 AND l_returnflag = 'R'", "")
