"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableguard.session import cut_lineage

#: Rounds after which the search gives up; their number grows with the logarithm of the nodes.
MOST_ROUNDS = 100
#: Links of a node that is not spread by its neighbours any more, and most such nodes.
HOT_LINKS, MOST_HOT = 1000, 10_000


def _told(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """Rows (a, b) with the ``m`` of their ``a``.

    Nodes of very many links are told by broadcast, so their rows stay where they are; the threshold
    rises with the links, so there are never more than ``MOST_HOT`` such nodes.
    """
    hot = F.broadcast(least.where(F.col("n") > max(HOT_LINKS, 2 * links // MOST_HOT)).select("a", "m"))
    rest = rows.join(hot.drop("m"), "a", "left_anti").join(least.select("a", "m"), "a")
    return rows.join(hot, "a").unionByName(rest)


def _least(rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))


def _large_star(links: DataFrame, count: int) -> DataFrame:
    """Each node hands its larger neighbours over to its smallest one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).withColumn("m", F.least("a", "m"))
    return _told(both.where("b > a"), least, count).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, count: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, over to the smallest of them."""
    least = _least(links)
    handed = _told(links, least, count).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return handed.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links(a, b)``: root is the smallest node of its component.

    Neighbours are never gathered: each step is a minimum per node and a join. Links of a node to
    itself, nulls and repeated links are ignored; no links give no rows. The links are written to
    the shared checkpoint folder after each step, so a lost executor costs one step.
    """
    oriented = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = cut_lineage(oriented.distinct())
    mark, count = None, current.count()
    for _ in range(MOST_ROUNDS):
        wide = cut_lineage(_large_star(current, count).distinct())
        current = cut_lineage(_small_star(wide, count).distinct())
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            roots = current.select(F.col("b").alias("node")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        mark, count = now, now[0]
    raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
