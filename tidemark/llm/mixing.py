"""Mixing sources to target weights with a multivariate hypergeometric splitting tree.

Each source is cut into blocks of its documents in random order. Its target says how many words of
its endlessly repeated tape of blocks the mix takes: an exact quota of blocks, the last one cut off at
the target. The quotas of all sources are split over the output shards by halving the shards again
and again: a half gets a fixed number of blocks, drawn without replacement from its node's urn, so
that its quotas are a multivariate hypergeometric draw. A shard then takes as many blocks of every
source's tape as its quota says, disjoint from all other shards', and orders its rows at random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import staged

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(
    sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0
) -> DataFrame:
    """Add ``target`` to rows of (source, size), one per source.

    Weights repeat over the sources by code point, null last. Targets share the sum of all sizes by
    weight; none is above ``most`` times its source's size, and what is cut off is shared by weight
    among the others. That is the water level of the caps: with sources by cap per weight, the
    highest level that any prefix of capped sources leaves.
    """
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    given = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(given, (F.col("rank") % len(weights)).cast("int") + 1)
    )
    cap = F.col("size") * F.lit(most)
    by_cap = Window.partitionBy().orderBy("per_weight", "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("cap", cap)
        .withColumn("per_weight", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("share", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.col("left") / F.col("share")).over(everything))
    )
    target = F.least(F.col("cap"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return levels.select(*sources.columns, target.alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Split rows of (source_key, quota) over shards: rows of (source_key, shard, quota).

    Each level halves every node's shards. The left half gets its share of the node's blocks,
    rounded; which sources they come from is drawn from an urn with a ball for each block: the balls
    first in random order go left. Sums over shards equal the quotas, and shards differ by at most a
    block per level. The balls (one per block of documents, not per document) are all that is sorted.
    """
    nodes = quotas.select(
        F.lit(0).alias("low"), F.lit(shards).alias("high"), "source_key", "quota"
    )
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        middle = F.col("low") + F.ceil((F.col("high") - F.col("low")) / 2).cast("int")
        node = Window.partitionBy("low", "high")
        ball = F.xxhash64(F.lit(seed), F.lit(level), "low", "source_key", "ball")
        balls = nodes.withColumn("ball", F.explode(F.sequence(F.lit(1).cast("long"), "quota")))
        drawn = (
            balls.withColumn("middle", middle)
            .withColumn("place", F.row_number().over(node.orderBy(ball, "source_key", "ball")))
            .withColumn("all", F.count(F.lit(1)).over(node))
        )
        share = (F.col("middle") - F.col("low")) / (F.col("high") - F.col("low"))
        left = F.col("place") <= F.round(F.col("all") * share)
        nodes = (
            drawn.select(
                F.when(left, F.col("low")).otherwise(F.col("middle")).alias("low"),
                F.when(left, F.col("middle")).otherwise(F.col("high")).alias("high"),
                "source_key",
            )
            .groupBy("low", "high", "source_key")
            .agg(F.count(F.lit(1)).alias("quota"))
        )
    return nodes.select("source_key", F.col("low").alias("shard"), "quota")


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = 3.0,
    shards: int = 16,
    rows_per_block: int = 1024,
    seed: int = 0,
) -> DataFrame:
    """Every document once: ``doc`` (all its columns), ``size``, ``source_size``, ``target``, and
    ``draws``, an array of (epoch, shard, place): one entry for each time the mix takes the document.

    ``docs`` needs ``doc_id`` and ``source``; ``size`` is a column over it (null: 0). The words a
    source gives differ from its target by at most half of one document. A null source is a source
    of its own. Documents without words are drawn with the place they stand at. The draw depends on the
    rows and ``seed`` only, not on their order or partitioning: places come from a hash of the whole row
    (maps excepted), so rows that share an id are told apart. Rows alike in every column are documents
    of their own, in one block. An empty table gives no rows, clashing column names stay inside ``doc``.

    A source may hold any part of all rows, and so may an id: sources and blocks are reduced to one row each
    before they are joined back, sources by a salted key. Sizes are worked out once and written apart from
    the texts for the counts, and once more where the texts are placed.
    """
    salts = 16
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.col("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key"),
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"),
        F.xxhash64(F.lit(seed), *hashed).alias("order"),
    )
    sizes = staged(rows.drop("doc"), "sizes")
    sources = sizes.groupBy("source", "source_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    )
    known = staged(
        source_targets(sources, weights, most).select(
            "source_key",
            F.col("size").alias("source_size"),
            "target",
            F.ceil(F.col("n") / rows_per_block).alias("n_blocks"),
        ),
        "sources",
    )
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def in_blocks(some: DataFrame) -> DataFrame:
        return (
            some.withColumn("salt", F.pmod("order", F.lit(salts)).cast("int"))
            .join(salted, ["source_key", "salt"])
            .withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.col("n_blocks")))
        )

    placed = in_blocks(rows)
    blocks = in_blocks(sizes).groupBy("source_key", "block").agg(F.sum("size").alias("words"))
    in_tape = Window.partitionBy("source_key").orderBy(
        F.xxhash64(F.lit(seed + 2), "source_key", "block"), "block"
    )
    taped = blocks.withColumn("block_start", F.sum("words").over(in_tape) - F.col("words"))
    epochs = math.ceil(most)
    tokens = staged(
        taped.join(known, "source_key")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .where(F.col("epoch") * F.col("source_size") + F.col("block_start") < F.col("target"))
        .withColumn(
            "turn",
            F.row_number().over(
                Window.partitionBy("source_key").orderBy(
                    "epoch", "block_start", F.xxhash64(F.lit(seed + 2), "source_key", "block"), "block"
                )
            )
            - 1,
        )
        .select("source_key", "block", "block_start", "epoch", "turn"),
        "tokens",
    )
    quotas = tokens.groupBy("source_key").agg(F.count(F.lit(1)).alias("quota"))
    by_shard = Window.partitionBy("source_key").orderBy("shard")
    dealt = (
        split_quotas(quotas, shards, seed)
        .withColumn("first", F.sum("quota").over(by_shard) - F.col("quota"))
        .select(
            "source_key",
            "shard",
            F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("turn"),
        )
    )
    plan = staged(
        tokens.join(dealt, ["source_key", "turn"])
        .groupBy("source_key", "block", "block_start")
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("drawn")),
        "draws",
    )
    in_block = Window.partitionBy("source_key", "block").orderBy("order", "size")
    begins = placed.withColumn(
        "start",
        F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    ).join(plan, ["source_key", "block"], "left")
    offset = F.col("block_start") + F.col("start") + F.col("size") / 2
    taken = F.filter(
        F.coalesce("drawn", F.array().cast("array<struct<epoch:int,shard:int>>")),
        lambda d: d["epoch"] * F.col("source_size") + offset <= F.col("target"),
    )
    return begins.select(
        "doc",
        "size",
        "source_size",
        "target",
        F.transform(
            taken,
            lambda d: F.struct(
                d["epoch"].alias("epoch"),
                d["shard"].alias("shard"),
                F.xxhash64(F.lit(seed + 3), F.col("order"), d["epoch"]).alias("place"),
            ),
        ).alias("draws"),
    )


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """A row for each draw: ``doc`` (the document's own columns), ``epoch``, ``shard`` and ``place``."""
    return mixed.select("doc", F.explode("draws").alias("draw")).select("doc", "draw.*")


def shuffled(mixed: DataFrame) -> DataFrame:
    """The documents as often as they are drawn, with their own columns only, whatever their names: those
    of one shard together, in the order of their places."""
    drawn = mixed_rows(mixed)
    local = drawn.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    return local.select("doc.*")
