"""Benchmark decontamination: which words of a document lie inside a window of a benchmark item.

A prefix-filtered set join. Texts are sets of word shingles with positions. A window of an item occurs
in a document only if all of its shingles do, so one shingle is a sufficient prefix: the rarest one, by
counts over all documents. Documents join that prefix only; the position of the shingle in the window
says where the window would begin, which bounds it to the document's length; then the shingles at the
window's beginning and end, which together spell all of its words, are looked up at their exact places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, staged

WINDOW = 10
SHINGLE = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR_CHARACTERS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def plain_words(text: Column) -> Column:
    """Runs of digits, letters and all characters beyond ASCII, A-Z in lower case."""
    low = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(SEPARATOR_CHARACTERS))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, SEPARATORS))


def _at(words: Column, start: Column, length: int | Column) -> Column:
    return F.xxhash64(F.slice(words, start, F.lit(length) if isinstance(length, int) else length))


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows of the items: ``item_ids``, ``length``, ``width`` of its shingles, ``shingles``.

    An item of fewer words than a window is one window; an item without words has none.
    """
    words = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        plain_words(F.col("text")).alias("words"),
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    spelled = words.select("item", F.explode(starts).alias("start"), "words").select(
        "item", F.slice("words", F.col("start"), F.lit(window)).alias("words")
    )
    length, width = F.size("words"), F.least(F.size("words"), F.lit(shingle))
    return spelled.select("item", F.struct("words").alias("spelling")).groupBy("spelling").agg(
        F.collect_set("item").alias("item_ids")
    ).select("item_ids", F.col("spelling.words").alias("words")).select(
        F.xxhash64("words").alias("window"),
        "item_ids",
        length.alias("length"),
        width.alias("width"),
        F.transform(
            F.sequence(F.lit(1), length - width + 1), lambda i: _at(F.col("words"), i, F.least(F.size("words"), F.lit(shingle)))
        ).alias("shingles"),
    )


def _document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each place and width where a shingle begins, and one at place -1 for the document."""

    def wide(words: Column, width: int) -> Column:
        starts = F.when(
            F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda i: F.struct(i.alias("place"), _at(words, i, width).alias("shingle"))
        )

    def places(words: Column) -> Column:
        own = F.array(F.struct(F.lit(-1).alias("place"), F.xxhash64("doc_id", "text").alias("shingle")))
        lists = (wide(words, width) for width in widths)
        return F.struct(F.size(words).alias("n_words"), F.flatten(F.array(own, *lists)).alias("places"))

    found = docs.select("doc_id", "copy", let(plain_words(F.col("text")), places).alias("found"))
    return found.select(
        "doc_id", "copy", F.col("found.n_words").alias("n_words"), F.explode("found.places").alias("at")
    ).select("doc_id", "copy", "n_words", "at.place", "at.shingle")


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: ``doc_id, copy, n_words, n_hit, item_ids``.

    ``n_hit`` counts the words inside any occurrence of a window, ``item_ids`` are the items (as
    strings, sorted) with an occurring window. A null text has no words. Repeated ids with different
    texts are documents of their own (``copy`` is the hash of the text); rows equal in id and text
    give as many equal rows. A null ``item_id`` is the empty string. Other columns are ignored; empty
    tables give no rows, or rows without hits. Shingles are compared by 64-bit hashes, and a window of
    ten words by two of them.

    The documents are read and cut into shingles once: only the places that hold some shingle of some
    item are kept, in a table from which rarity is counted, candidates are made and windows verified.
    The items' shingles are broadcast if Spark finds their table below its threshold, else shuffled.
    """
    windows = staged(item_windows(items, window, shingle), "windows")
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # shingle at most
    known = staged(
        windows.select(F.explode("shingles").alias("shingle")).distinct().withColumn("known", F.lit(True)),
        "shingles",
    )
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    matched = staged(
        _document_shingles(texts, widths)
        .join(known, "shingle", "left")
        .where(F.col("known") | (F.col("place") < 0))
        .select("doc_id", "copy", "n_words", "place", "shingle"),
        "matched",
    )
    hits = matched.where("place > 0")
    rarity = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    in_windows = windows.select(
        "window", "length", "width", F.posexplode("shingles").alias("offset", "shingle")
    )
    prefixes = staged(
        in_windows.join(rarity, "shingle", "left")
        .groupBy("window", "length", "width")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rarest"))
        .where("rarest.n > 0")
        .select("window", "length", "width", "rarest.offset", "rarest.shingle"),
        "prefixes",
    )
    ends = windows.select(
        "window",
        F.array_distinct(
            F.array(
                F.struct(F.lit(0).alias("offset"), F.col("shingles")[0].alias("shingle")),
                F.struct(
                    (F.size("shingles") - 1).alias("offset"),
                    F.element_at("shingles", -1).alias("shingle"),
                ),
            )
        ).alias("ends"),
    )
    candidates = (
        hits.join(prefixes, "shingle")
        .withColumn("start", F.col("place") - F.col("offset"))
        .where((F.col("start") >= 1) & (F.col("start") + F.col("length") - 1 <= F.col("n_words")))
        .select("doc_id", "copy", "start", "window", "length")
        .distinct()
    )
    wanted = (
        candidates.join(ends, "window")
        .withColumn("end", F.explode("ends"))
        .select(
            F.coalesce("doc_id", F.lit(0)).alias("doc"),
            F.col("doc_id").isNull().alias("nameless"),
            "copy",
            "start",
            "window",
            "length",
            F.size("ends").alias("needed"),
            (F.col("start") + F.col("end.offset")).alias("place"),
            F.col("end.shingle").alias("shingle"),
        )
    )
    there = hits.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc"),
        F.col("doc_id").isNull().alias("nameless"),
        "copy",
        "place",
        "shingle",
    ).distinct()
    verified = (
        wanted.join(there, ["doc", "nameless", "copy", "place", "shingle"])
        .groupBy("doc", "nameless", "copy", "start", "window", "length", "needed")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n = needed")
    )
    covered = F.size(
        F.array_distinct(
            F.flatten(
                F.transform(
                    F.collect_set(F.struct("start", "length")),
                    lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1),
                )
            )
        )
    )
    found = (
        verified.join(windows.select("window", "item_ids"), "window")
        .groupBy("doc", "nameless", "copy")
        .agg(
            covered.cast("long").alias("n_hit"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        )
    )
    rows = matched.where("place < 0").select(
        F.coalesce("doc_id", F.lit(0)).alias("doc"),
        F.col("doc_id").isNull().alias("nameless"),
        "doc_id",
        "copy",
        F.col("n_words").cast("long").alias("n_words"),
    )
    return rows.join(found, ["doc", "nameless", "copy"], "left").select(
        "doc_id",
        "copy",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", F.xxhash64("text").alias("copy"))
    bad = (
        find_contamination(docs, items)
        .where("n_hit > 0")
        .select(F.col("doc_id").alias("bad_id"), F.col("copy").alias("bad_copy"))
        .distinct()
    )
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("copy") == F.col("bad_copy"))
    return rows.join(bad, same, "left_anti").select("doc.*")
