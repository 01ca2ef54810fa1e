"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One vector of weights is shared by all grades; ordered thresholds cut its score into grades:
P(grade >= k) = sigmoid(score - threshold k). The model gives the expected grade and the tail
probability of the grade to select by.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest

BITS = 18
SAMPLE = 8000
GRADES = 3
CACHE = 300_000
MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())
MASK = (1 << BITS) - 1
WORD, BEGINNING, MARK, UPPER = (crc32(kind) for kind in (b"w", b"p", b"m", b"u"))
LENGTHS = (20, 100, 500, 2500, 12_500)


class TokenFeatures(dict):
    """Token -> feature numbers, as bytes of int32: the bare word, its beginnings, and the marks and case
    around it. The first ``CACHE`` tokens of a task are kept, frequent ones soon among them."""

    def __missing__(self, token: bytes) -> bytes:
        bare = token.strip(MARKS)
        word = bare.lower()
        found = [crc32(word, WORD)]
        if len(word) > 4:
            begun = crc32(word[:4], BEGINNING)
            found.append(begun)
            for n in range(4, min(len(word) - 1, 6)):
                begun = crc32(word[n : n + 1], begun)
                found.append(begun)
        if len(bare) < len(token):
            found.append(crc32(token.replace(bare, b"", 1)[:8], MARK))
        if len(bare) > 1 and bare.isupper():
            found.append(UPPER)
        numbers = array("i", [x & MASK for x in found]).tobytes()
        if len(self) < CACHE:
            self[token] = numbers
        return numbers


def features(text: bytes | str | None, cache: TokenFeatures) -> np.ndarray:
    """Sorted numbers of the features a text has, the whole text considered."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    tokens = data.split()
    distinct = set(tokens)
    n = max(len(tokens), 1)
    rare = sum(map(eq, tokens, tokens[1:]))
    ends = bytes([t[-1] for t in tokens])
    marked = len(ends) - len(ends.translate(None, NOT_ALNUM))
    upper = sum([len(t) > 1 for t in tokens if t.isupper()])
    shape = [
        b"distinct%d" % (10 * len(distinct) // n),
        b"again%d" % (20 * rare // n),
        b"marked%d" % (10 * marked // n),
        b"upper%d" % (10 * upper // n),
        b"length%d" % sum(len(tokens) > x for x in LENGTHS),
    ]
    found = list(map(cache.__getitem__, distinct))
    found.append(array("i", [crc32(b"s" + s) & MASK for s in shape]).tobytes())
    numbers = np.sort(np.frombuffer(b"".join(found), dtype=np.int32))
    return numbers[np.append(True, numbers[1:] != numbers[:-1])]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by column."""
        z = np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)
        return 1 / (1 + np.exp(-z))


def fit(
    rows: list[np.ndarray],
    grades: list[int],
    n_grades: int = GRADES,
    epochs: int = 6,
    rate: float = 0.1,
    l1: float = 0.6,
    l2: float = 1.0,
    seed: int = 7,
) -> OrdinalModel:
    """Maximum likelihood with sparse weights: each coordinate has its own falling rate (FTRL-proximal),
    thresholds go by plain gradient steps and stay in order. No rows: every tail is almost 1."""
    weights = np.zeros(1 << BITS)
    if not rows:
        return OrdinalModel(weights.astype(np.float32), np.full(n_grades - 1, -20.0))
    z, n = np.zeros_like(weights), np.zeros_like(weights)
    counts = np.bincount(grades, minlength=n_grades) + 0.5
    above = counts[::-1].cumsum()[::-1][1:] / counts.sum()
    thresholds = np.log((1 - above) / above)
    shuffled = np.random.default_rng(seed)
    step = 0
    for _ in range(epochs):
        for i in shuffled.permutation(len(rows)):
            x, y = rows[i], grades[i]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((1 + root) / rate + l2))
            tail = 1 / (1 + np.exp(-np.clip(w.sum() - thresholds, -30, 30)))
            bounds = np.concatenate([[1.0], tail, [0.0]])
            likely = max(bounds[y] - bounds[y + 1], 1e-9)
            g = -(1 - bounds[y] - bounds[y + 1])
            nx = nx + g * g
            z[x] = zx + (g - (np.sqrt(nx) - root) / rate * w)
            n[x] = nx
            step += 1
            slope = np.zeros(n_grades + 1)
            slope[y] += bounds[y] * (1 - bounds[y]) / likely
            slope[y + 1] -= bounds[y + 1] * (1 - bounds[y + 1]) / likely
            thresholds = np.sort(thresholds - 0.5 / np.sqrt(100 + step) * slope[1:n_grades])
    seen = np.nonzero(n)[0]
    weights[seen] = np.where(
        np.abs(z[seen]) <= l1,
        0.0,
        -(z[seen] - np.sign(z[seen]) * l1) / ((1 + np.sqrt(n[seen])) / rate + l2),
    )
    return OrdinalModel(weights.astype(np.float32), thresholds)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for toxic texts, 1 for other texts of low quality, 2 for the rest; null if a rating is."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic != 0, 0).otherwise(
        F.when(quality == 0, 1).otherwise(2)
    )


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, n_grades: int = GRADES) -> OrdinalModel:
    """Fit on rated documents: ``ratings`` has ``doc_id`` and ``grade`` from 0 to ``n_grades - 1``.

    At most ``sample`` rows, the first by a hash of id and text and by grade, are fitted on. Rows that tie
    are copies: they come to the driver once, as the numbers of their features, and count as often as they
    occur. The hash is known before the join, so that no other texts are joined. Ratings and texts that are
    null, and other grades, are left out.
    """
    rated = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where(
        F.col("grade").between(0, n_grades - 1)
    )
    chosen = (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", "text", F.xxhash64(F.lit(1), "doc_id", "text").alias("order"))
        .join(rated, "doc_id")
        .select("grade", F.col("text").cast("binary"), "order")
    )
    copies = chosen.groupBy("order", "grade").agg(F.count(F.lit(1)).alias("n"))
    some = {(r["order"], r["grade"]): r["n"] for r in lowest(copies, "order", sample).collect()}
    if not some:
        return fit([], [], n_grades)
    totals = accumulate(some.values())
    limit = next((key for key, total in zip(some, totals) if total >= sample), max(some))[0]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = TokenFeatures(), set()
        for part in parts:
            keys = zip(part.column(2).to_pylist(), part.column(0).to_pylist())
            first = {key: i for i, key in enumerate(keys) if key not in seen}
            seen.update(first)
            part = part.take(pa.array(first.values(), pa.int64()))
            found = [features(t.as_py(), cache) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(found, pa.list_(pa.int32())), part.column(2)],
                ["grade", "features", "order"],
            )

    rows = (
        chosen.where(F.col("order") <= limit)
        .mapInArrow(batches, "grade int, features array<int>, order long")
        .dropDuplicates(["order", "grade"])
        .toArrow()
        .sort_by([("order", "ascending"), ("grade", "ascending")])
    )
    texts, grades = [], []
    for x, grade, order in zip(rows.column("features"), *(rows.column(c).to_pylist() for c in ("grade", "order"))):
        n = min(some.get((order, grade), 0), sample - len(texts))
        texts += [np.array(x.as_py(), dtype=np.int32)] * n
        grades += [grade] * n
    return fit(texts, grades, n_grades)


def _judged(texts: pa.Array, model: OrdinalModel, cache: TokenFeatures) -> np.ndarray:
    return model.tails(np.array([model.score(features(t.as_py(), cache)) for t in texts]))


def grade_documents(
    docs: DataFrame, model: OrdinalModel, least: int = GRADES - 1, threshold: float = 0.5
) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, selected`` of every row.

    The tail probability is P(grade >= ``least``); rows at ``threshold`` or above are selected. Null and
    empty texts have only the features of their length and shape. Rows are judged alone: repeated rows
    get equal results, other columns are ignored, an empty table gives no rows.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenFeatures()
        for part in parts:
            tails = _judged(part.column(1), model, cache)
            tail = tails[:, least - 1]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= threshold)],
                ["doc_id", "expected_grade", "tail_probability", "selected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        batches, f"doc_id {kind}, expected_grade double, tail_probability double, selected boolean"
    )


def select_documents(
    docs: DataFrame, model: OrdinalModel, least: int = GRADES - 1, threshold: float = 0.5
) -> DataFrame:
    """The selected documents, with all their columns. Narrow: nothing is shuffled or joined back."""
    at = docs.columns.index("text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenFeatures()
        for part in parts:
            tails = _judged(part.column(at), model, cache)
            yield part.filter(pa.array(tails[:, least - 1] >= threshold))

    return docs.mapInArrow(batches, docs.schema)
