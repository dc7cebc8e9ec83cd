"""Distributed connected components and blocked counting inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import discard, store


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge table (a, b) of longs; component is the smallest node.

    Alternating large-star and small-star rewiring: every step aggregates the
    smallest neighbour and joins it back, so no vertex's edges are collected
    anywhere and a hub's edges may be split by adaptive execution. Each round
    is written to the shared folder. Self loops are allowed and give single
    components; null ends are ignored; an empty table gives an empty result.
    """
    e = store(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    nodes = store(e.select(F.col("a").alias("node")).union(e.select("b")).distinct())
    for _ in range(rounds):
        # large star: every larger neighbour of u is linked to u's smallest neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = store(small.where("a <> b").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == print_of:
            break
        print_of = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def block_pairs(members: DataFrame, group: str, node: str, block: int) -> DataFrame:
    """Members dealt to pairs of blocks of their group, so that any two of a group meet in exactly one pair.

    Adds (pair_i, pair_j, own): the pair's block numbers and the row's own.
    A group of n rows is cut into ceil(n / block) blocks by a hash of the node
    and each row is sent to one task row a block: no group is ever in one task.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("group_n"))
    blocks = F.ceil(F.col("group_n") / block).cast("int")
    dealt = members.join(sizes.where("group_n > 1"), group).withColumn("own", F.pmod(F.xxhash64(F.lit(11), node), blocks.cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("*", F.least("own", "other").alias("pair_i"), F.greatest("own", "other").alias("pair_j")).drop("other", "group_n")
