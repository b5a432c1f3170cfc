"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that can be reached) for every node of ``links`` (a long, b long).

    A round hooks larger neighbours, then smaller ones, to the smallest known; the rounds end when nothing changes, which
    takes about the logarithm of the longest chain.  Each round writes its links to the shared folder, so
    that a lost executor costs a part of one round.  Nothing but a count and a checksum reaches the driver.
    """
    stars = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = materialize(stars, "links")
    mark = _mark(stars)
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u")
        small = hooked.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        stars = materialize(small, "links")
        last, mark = mark, _mark(stars)
        if mark == last:
            break
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
