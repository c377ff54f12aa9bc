"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpometer.session import stored

MAX_ROUNDS = 200


def connected(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b), both long; the root is the smallest id reachable.

    Every round, each id takes its smallest neighbour that is smaller than itself as parent, parents
    are followed to their tops, and the links are rewritten between tops. Ids in a chain or a star of
    any size are settled in a few rounds, every step is an equality join or a grouped minimum, and each
    result is written to the shared folder. Null ends and links of an id to itself change nothing.
    """
    links = stored(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "links")
    roots = None
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
        parents = stored(parents.select("id", F.least("id", "low").alias("root")), "parents")
        if parents.isEmpty():
            break
        parents = _tops(parents)
        if roots is None:
            roots = parents
        else:
            step = parents.select(F.col("id").alias("root"), F.col("root").alias("top"))
            roots = stored(
                roots.join(step, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots"
            )
        links = stored(
            links.join(parents.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a")
            .join(parents.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
    else:
        raise RuntimeError("components did not settle")
    if roots is None:
        return links.sparkSession.createDataFrame([], "id long, root long")
    return roots


def _tops(parents: DataFrame) -> DataFrame:
    """Follow parents until every id points at an id that is its own parent."""
    while True:
        up = parents.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = stored(parents.join(up, "root").select("id", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")), "tops")
        parents = new.select("id", "root")
        if new.where("moved").isEmpty():
            return parents
