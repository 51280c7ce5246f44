"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, table


def _two_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest of the node and its neighbours."""
    both = _two_ways(edges)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def of_one_id(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that make one component of everything that rows (id, rep) of one
    id belong to.  rep names a row's class; a row without rep has none but its
    id.  Ids whose rows have one class give no edges."""
    named = rows.filter("id IS NOT NULL")
    mixed = named.groupBy(F.col("id").alias("own")).agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count("*").alias("n"), F.count("rep").alias("m")).filter("m > 0 AND (a <> z OR m < n)").drop("z", "n", "m")
    classes = named.filter("rep IS NOT NULL").distinct().join(mixed, F.col("id") == F.col("own")).select("a", F.col("rep").alias("b"))
    return classes.unionByName(mixed.select("a", F.col("own").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for all nodes of edges
    (a, b, of long).  Rounds of large and small stars, O(log n) in practice; every
    round is written to the shared folder, where it replaces the one before.
    Edges with a null end or equal ends are none; a table without edges has no
    nodes.  The result is a star: (node, label) with label < node, and (label,
    label) for the centres."""
    now = table(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        last, now = now, table(_small_star(_large_star(now)), "stars")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.hash("b", "a").cast("long"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
