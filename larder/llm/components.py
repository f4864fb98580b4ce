"""Connected components by alternating star contractions; links never reach the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import stage


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not its component's smallest.

    Large star: each node hands its larger neighbours to the smallest neighbour; small star: each
    node hands its smaller neighbours and itself to the smallest. Both keep the components and the
    number of rows bounded by the links; the depth halves at each round. A hub is a row per
    neighbour in a plain join of two staged tables, which adaptive execution splits.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stage(links, "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large, "large-stars")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct("a", F.col("m").alias("b")))).alias("l")).select("l.*")
        links = stage(small.where("a <> b").distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
