"""Connected components of a list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripewise.llm.common import cut


MOST_SENT = 100_000  # rows of two numbers, a few megabytes, that go to every task at most
HOT_KEYS = 1000  # keys at most that hold more than this part of all rows


def meet(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with values (one row for each key, with n, the rows that have it; dropped).

    Up to MOST_SENT values are sent to the rows where they lie. Of more, only keys with more than
    a thousandth of all rows, of which there are a thousand at most, are sent; the others are
    shuffled, so that no task gets more of a key than that part. rows and values should be cut,
    as both are read twice."""
    if values.count() <= MOST_SENT:
        return rows.join(F.broadcast(values.drop("n")), key)
    hot = F.broadcast(values.where(F.col("n") * HOT_KEYS > total).drop("n"))
    cold = values.where(F.col("n") * HOT_KEYS <= total).drop("n")
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def _large(links: DataFrame, total: int) -> DataFrame:
    """Each node hands its larger neighbours to the least node that it sees."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")), 2 * total)
    return meet(both, least, "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame, total: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    least = cut(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), total)
    moved = meet(links, least, "a", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of links (a, b: long), component its least reachable
    node; nodes without links are not listed. The rounds needed grow with the logarithm of a
    component's size; each is cut into the shared folder. A node of many links is split (see
    meet). Null ends and loops are left out."""
    links = cut(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state, total = None, links.count()
    for _ in range(most_rounds):
        links = cut(_large(links, total), 2 * total)
        total = links.count()
        links = cut(_small(links, total), 2 * total)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            least = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least)
        state, total = now, now[0]
    raise RuntimeError("the components did not settle")
