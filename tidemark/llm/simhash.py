"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most two bits, one
segment is equal and one of the other two differs in at most one bit (pigeonhole). A segment, padded to
23 bits, is decoded with the perfect binary Golay code to the codewords within distance four, 1 or 6 of
them; segments that differ in at most two bits share one of these. A key is an equal segment with
a codeword's index of another; fingerprints that share a key are verified by their bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes of 23-bit words: their remainder by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error (at most three bits), how many codewords lie within distance four, and
    their indices relative to that of the nearest.

    An index is a codeword's upper 12 bits. Beside the nearest codeword, a word at distance three
    has those that differ from it by a codeword of weight 7 over all three error bits.
    """
    patterns = [sum(1 << b for b in bits) for n in range(4) for bits in itertools.combinations(range(23), n)]
    errors = np.zeros(2048, dtype=np.int64)
    errors[_remainder(np.array(patterns))] = patterns
    messages = np.arange(4096, dtype=np.int64) << 11
    codewords = messages | _remainder(messages)
    light = codewords[np.bitwise_count(codewords) == 7]
    counts = np.ones(2048, dtype=np.int64)
    indices = np.zeros((2048, 6), dtype=np.int64)
    for syndrome, error in enumerate(errors):
        if int(error).bit_count() == 3:
            over = light[(light & error) == error]
            counts[syndrome] = 1 + len(over)
            indices[syndrome, 1 : 1 + len(over)] = over >> 11
    return errors, counts, indices


class Golay:
    """Decoder tables, built once in each Python worker."""

    tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def nearby(cls, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, codeword indices): the codewords within distance four of each word."""
        if cls.tables is None:
            cls.tables = _golay_tables()
        errors, counts, indices = cls.tables
        syndromes = _remainder(words)
        nearest = (words.astype(np.int64) ^ errors[syndromes]) >> 11
        n = counts[syndromes]
        rows = np.repeat(np.arange(len(words)), n)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        return rows, nearest[rows] ^ indices[syndromes[rows], nth]


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys): every pair of an equal segment and a codeword near another one."""
    parts = [(fingerprints >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    near = [Golay.nearby(p) for p in parts]
    rows, keys = [], []
    for which, (same, other) in enumerate(itertools.permutations(range(3), 2)):
        at, index = near[other]
        rows.append(at)
        keys.append((which << 34) | (parts[same][at].astype(np.int64) << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits of a text in UTF-8: those that are set in over half of the hashes of the shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(len(words) - shingle, 0)
    spans = zip(starts[: last + 1].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``copy`` (hash of the text) and ``fingerprint`` (64 bits, a signed long) of every row.

    Words are runs of characters other than blanks, A-Z in lower case; shingles count as often as they
    stand in the text. Fewer words are one shingle; a null or blank text has fingerprint zero.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([fingerprint(t.as_py(), shingle) for t in part.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found.view(np.int64))],
                ["doc_id", "copy", "fingerprint"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("copy"), F.col("text").cast("binary")).mapInArrow(
        batches, f"doc_id {kind}, copy long, fingerprint long"
    )


def _keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        values = part.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(values), 4096):
            some = values[at : at + 4096]
            rows, keys = keys_of(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows])], ["key", "fingerprint"])


def close_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, most: int = 64) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints: enough to connect all that are linked.

    Keys that up to ``most`` fingerprints share are verified pair by pair. Fingerprints under any
    fuller key go the exact way for the rest: each is sent to itself and its 64 neighbours at one bit.
    Two fingerprints within two bits meet at one of these, and all that meet are within two bits of each
    other, so each is linked to the smallest there: work in proportion to the fingerprints, not to pairs.
    With at most one bit, meeting pairs are verified as well, so nothing beyond ``max_bits`` links.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("three segments find at most two differing bits")
    keys = distinct.select("fingerprint").mapInArrow(_keyed, "key long, fingerprint long")
    shared = staged(
        keys.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("fingerprint").alias("a"),
            F.max("fingerprint").alias("b"),
        )
        .where("n > 1"),
        "shared-keys",
    )
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = shared.where(F.col("n") == 2).where(differ).select("a", "b")
    more = staged(
        keys.join(shared.where("n > 2").select("key", "n"), "key").select("key", "n", "fingerprint"),
        "keyed",
    )
    groups = (
        more.where(F.col("n") <= most)
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("fingerprint")).alias("all"))
        .withColumn("b", F.explode("all"))
        .select(
            "b",
            F.explode(
                F.filter(
                    "all",
                    lambda x: (x < F.col("b"))
                    & (F.bit_count(x.bitwiseXOR(F.col("b"))) <= max_bits),
                )
            ).alias("a"),
        )
        .select("a", "b")
    )
    full = more.where(F.col("n") > most).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)))
    meeting = full.select(
        "fingerprint", F.explode(F.transform(flips, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("at")
    )
    if max_bits == 2:
        first = meeting.groupBy("at").agg(F.min("fingerprint").alias("a"), F.count(F.lit(1)).alias("n"))
        stars = (
            meeting.join(first.where("n > 1"), "at")
            .where("a < fingerprint")
            .select("a", F.col("fingerprint").alias("b"))
        )
    else:
        stars = (
            meeting.join(full.select(F.col("fingerprint").alias("at")), "at")
            .where("at < fingerprint")
            .where(F.bit_count(F.col("at").bitwiseXOR(F.col("fingerprint"))) <= max_bits)
            .select(F.col("at").alias("a"), F.col("fingerprint").alias("b"))
        )
    return pairs.union(groups).union(stars).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, root) for every node with a link; the root is the smallest node of its component.

    Alternating large and small stars: each round links every node to the smallest one it sees, so
    rounds grow with the logarithm of a component's diameter. Hubs are aggregated before the shuffle.
    """
    edges = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), label)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label
        )
        large = staged(
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct(),
            label,
        )
        parents = staged(
            large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), label
        )
        child = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        edges = staged(
            large.join(parents.select("u", "m"), "u")
            .select(child.alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct(),
            label,
        )
        chained = large.join(parents.select(F.col("u").alias("v")), "v", "left_semi")
        if parents.where("n > 1").isEmpty() and chained.isEmpty():
            return large.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, salts: int = 16, most: int = 64
) -> DataFrame:
    """``doc_id, copy, fingerprint, root, component_id`` of every row; ``copy`` is the text's hash.

    The component is all documents that can be reached by links of at most ``max_bits`` differing bits;
    its id is the smallest ``doc_id`` in it. Null ids are members but never name a component, unless
    all of it is null. Repeated rows give equal rows. Texts without words all have fingerprint
    zero and are linked. Other columns are ignored; an empty table gives no rows.

    Copies meet in one row per fingerprint before anything is joined, and the result is joined back
    by fingerprint and salt, so a fingerprint may hold any part of all rows.
    """
    marked = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(close_pairs(distinct, max_bits, most))
    named = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = staged(
        named.join(smallest, "root").select("fingerprint", "root", "component_id"), "classes"
    )
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .join(salted, ["fingerprint", "salt"])
        .select("doc_id", "copy", "fingerprint", "root", "component_id")
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest id.

    Null ids come last; of rows with one id and text, and of different texts with the smallest
    id, one stays.
    """
    stays = (
        near_duplicates(docs, shingle, max_bits)
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "copy")).alias("one"))
        .select(
            F.coalesce("one.doc_id", F.lit(0)).alias("kept"), "one.nameless", F.col("one.copy").alias("copy")
        )
    )
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce("doc_id", F.lit(0)).alias("kept"),
        F.col("doc_id").isNull().alias("nameless"),
        F.xxhash64("text").alias("copy"),
    )
    keys = ["kept", "nameless", "copy"]
    return rows.join(stays, keys, "left_semi").dropDuplicates(keys).select("doc.*")
