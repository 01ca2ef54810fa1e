"""Document fingerprints: the k smallest hashes of a text's shingles.

Sketches merge by taking the k smallest of their union, and estimate resemblance, containment and
the number of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import EXACT, cut_points, place_among
from .common import blank_words, let

K = 128
SHINGLE = 5
MOST_BLOCKS = 65_536


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sorted array of the k smallest distinct 64-bit hashes of shingles of words.

    A text of fewer words has one shingle of all of them; a null, empty or blank text has none.
    """

    def shingles(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(shingle))))

    hashes = let(
        F.transform(blank_words(text), lambda w: F.xxhash64(w)),
        lambda words: F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(
            shingles(words)
        ),
    )
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, group: str, sketches: str, k: int = K) -> DataFrame:
    """Sketch of each group's rows, as (group, ``sketch``); a group column of that name comes back as
    ``group``.

    Equal hashes are merged before the shuffle and again after it; of each group only its k smallest
    go on, cut off on the map side too, so a group of any size costs k rows a task.
    """
    hashes = df.select(F.struct(F.col(f"`{group}`").alias("of")).alias("group"), F.explode(f"`{sketches}`").alias("hash"))
    smallest = Window.partitionBy("group").orderBy("hash")
    few = hashes.distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k)
    merged = few.groupBy("group").agg(F.sort_array(F.collect_list("hash")).alias("sketch"))
    return merged.select(F.col("group.of").alias("group" if group == "sketch" else group), "sketch")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest of the union that both hold; 1 for two texts without shingles."""

    def share(union: Column) -> Column:
        both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))

    return let(merge(a, b, k), share).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    largest = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds; 1 if ``a`` has none."""
    union = distinct_shingles(merge(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_next(
    df: DataFrame, order: str, columns: list[str], tie: Column, rows_per_block: int = 1000
) -> DataFrame:
    """Add ``next_<column>``: the values of the row that follows by descending ``order``, then ``tie``.

    After the last row comes the first; null order comes last. The order is cut into blocks of about
    ``rows_per_block`` rows (more rows, more blocks, up to ``MOST_BLOCKS``; beyond, a task sorts more rows a
    block, and spills them). Blocks are cut between rows of one order too, by their tie, so an id that holds
    a third of all rows is many blocks. Every cut is the least row of its block, and follows the last of the
    block below: it stands there once more, so that windows over single blocks suffice. The least of all
    follows the highest of all, in the last block.
    """
    keyed = df.withColumn("_key", F.struct(F.col(f"`{order}`").alias("k"), tie.alias("tie")))
    keys = keyed.select(F.col("_key").alias("key"))
    n, least = keyed.agg(F.count(F.lit(1)), F.to_json(F.min("_key"), EXACT)).first()
    blocks = min(MOST_BLOCKS, max(1, math.ceil(n / rows_per_block)))
    above, cuts = cut_points(keys, blocks, 4) if blocks > 1 else (None, 0)
    lowest = F.from_json(F.lit(least or "{}"), keys.schema["key"].dataType, EXACT)
    own = place_among(F.col("_key"), above, cuts) if cuts else F.lit(0)
    placed = keyed.withColumn("_own", own)
    cut = F.when(F.col("_own") == 0, lowest)
    if cuts:
        cut = cut.otherwise(F.get(above, F.col("_own") - 1))
    here = F.struct(F.col("_own").alias("block"), F.lit(0).alias("copied"))
    below = F.struct(F.pmod(F.col("_own") - 1, F.lit(cuts + 1)).alias("block"), F.lit(1).alias("copied"))
    is_cut = F.col("_key") == cut
    places = placed.withColumn("_is_cut", is_cut).withColumn(
        "_place", F.explode(F.when(F.col("_is_cut"), F.array(here, below)).otherwise(F.array(here)))
    )
    rising = Window.partitionBy("_place.block").orderBy("_place.copied", F.col("_key.k").asc_nulls_first(), "_key.tie")
    following = {f"next_{c}": F.lag(f"`{c}`").over(rising) for c in columns}
    found = places.withColumns(following).where((F.col("_place.copied") == 1) | ~F.col("_is_cut"))
    return found.drop("_key", "_own", "_is_cut", "_place")


def fingerprint_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint every text, and the text with its last third replaced by the next one's beginning.

    Columns ``doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next``. A null text is
    empty; two empty texts are alike (1), an empty and another are not (0). Next is by descending
    ``doc_id`` (null last), after the last the first; equal ids go by a hash of the text, falling, and rows
    repeated follow each other. A single row follows itself. Other columns are ignored.
    """
    base = docs.select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("sketch", sketch(F.col("text"), k, shingle))
    paired = with_next(base, "doc_id", ["text", "sketch"], F.xxhash64("text"))
    n = F.length("text")
    moved = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.col("next_text"), F.lit(1), moved))
    parts = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        edited.alias("edited"),
        "sketch",
        "next_sketch",
    ).withColumn("edited_sketch", sketch(F.col("edited"), k, shingle))
    return parts.select(
        "doc_id",
        "n_chars",
        "edited",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
