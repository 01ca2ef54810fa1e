"""Language-model scoring by context-tree weighting over bytes.

Texts are spelled in bytes, each byte in eight binary decisions. A decision's context is the bytes before
it, nearest first, ``DEPTH`` of them; there is one context tree for each of the 255 places in a byte where a
decision can stand. Every node of a tree holds the counts of both outcomes in training and their
Krichevsky-Trofimov estimate, and weighs it evenly against the product of what its children (contexts one
byte longer) say. After training, a decision's probability mixes the estimates of all depths on its path by
the weights that the training data gave them; where training never saw a longer context, the path ends.

An event is a context of ``DEPTH`` bytes with the byte that follows. Training counts events; trees fall
apart below their first three context bytes, so a task takes whole subtrees of them, some at a time, and
Spark tables join them above. Between tasks events travel as lists, one for each such context and task. A text's score sums those of its events.

The text scored is that of the tokens: lower-cased words, a blank after each, and one end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Bytes of context, from three to six: what an event has besides its shared context fits into 32 bits.
DEPTH = 6
SHARED = 3
#: Words sent to tasks are no longer than this, in bytes.
WORD_BYTES = 64
#: Events of whole contexts a task works on at a time.
SUBTREE_EVENTS = 1 << 18
FREQUENT_WORDS = 1 << 17
FREQUENT_EVENTS = 1 << 20
END = b"\n"
WORDS_HELD = 200_000
EVENTS_HELD = 1 << 21
PIECE_BYTES = 1 << 20
#: Places of a text worked on at a time: many where events are sorted, few where they are looked up.
CHUNK, LOOKUP_CHUNK = 1 << 19, 1 << 16
LOG_HALF = math.log(0.5)


def tokens_of(data: bytes | None) -> list[bytes]:
    words = (data or b"").lower().split()
    words.append(END)
    return words


def _slices(part: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about a megabyte of text, a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(text)), 0).to_numpy(zero_copy_only=False) + 8)
    at = 0
    while at < part.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES)))
        yield part.slice(at, to - at)
        at = to


def events_of(
    texts: list[list[bytes]], depth: int, chunk: int = CHUNK
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, events) of lists of tokens, in pieces of ``chunk`` places. An event has its byte lowest, then the
    context's bytes, nearest first."""
    before = b"\0" * (depth - 1) + b" "
    each = [before + b" ".join(tokens) for tokens in texts]
    lengths = np.array([len(x) for x in each])
    ends = np.cumsum(lengths)
    data = b"\0" * 7 + b"".join(each)
    # Eight bytes from every place on, the last of them lowest: the byte at the place, and what is before it.
    windows = np.ndarray(int(ends[-1]), dtype=">u8", buffer=data, strides=(1,))
    mask = np.uint64((1 << 8 * (depth + 1)) - 1)
    for low in range(0, len(windows), chunk):
        high = min(low + chunk, len(windows))
        first, last = np.searchsorted(ends, (low, high - 1), side="right")
        stops = np.minimum(ends[first : last + 1], high)
        text = np.repeat(np.arange(first, last + 1), np.diff(stops, prepend=low))
        inside = np.ones(high - low, dtype=bool)
        for start in (ends - lengths)[first : last + 1].tolist():
            inside[max(start - low, 0) : max(start + depth - low, 0)] = False
        yield text[inside], (windows[low:high].astype(np.uint64) & mask).view(np.int64)[inside]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _context(events: np.ndarray) -> np.ndarray:
    return (events >> 8 & (1 << 8 * SHARED) - 1).astype(np.int32)


def _by_context(events: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Events and counts as one list for each shared context: contexts, the rest of the events, counts."""
    contexts = _context(events)
    order = np.argsort(contexts, kind="stable")
    contexts = contexts[order]
    first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
    offsets = pa.array(np.append(first, len(contexts)), pa.int32())
    rest = (events >> 8 * (SHARED + 1) << 8 | events & 255).astype(np.uint32).view(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in (rest, n)]
    return contexts[first].astype(np.int64), *lists


def _events(table: pa.Table) -> np.ndarray:
    """The events of rows made by ``_by_context``."""
    sizes = pc.list_value_length(table.column("events")).to_numpy()
    contexts = np.repeat(table.column("context").to_numpy(), sizes)
    rest = _flat(table.column("events")).view(np.uint32).astype(np.int64)
    return rest >> 8 << 8 * (SHARED + 1) | contexts << 8 | rest & 255


def count_events(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``context, events, n``: the events of ``docs`` (``text`` in bytes, ``train``) and how often training
    has them, lists by their shared context. Each task's own counts: a context has several rows."""
    if not SHARED <= depth <= 6:
        raise ValueError(f"a depth from {SHARED} to 6 is needed, not {depth}")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            whole = pa.RecordBatch.from_arrays(list(map(_array, _by_context(keys, n))), ["context", "events", "n"])
            for at in range(0, whole.num_rows, 4096):
                yield whole.slice(at, 4096)

        for part in (some for whole in parts for some in _slices(whole, 0)):
            for train in (True, False):
                texts = [
                    tokens_of(t.as_py())
                    for t, used in zip(part.column(0), part.column(1).to_pylist())
                    if used == train
                ]
                for _, events in events_of(texts, depth) if texts else ():
                    keys, n = np.unique(events, return_counts=True)
                    held.append((keys, n if train else np.zeros_like(n)))
                    size += len(keys)
                    if size > EVENTS_HELD:
                        keys, n = merged()
                        held, size = [(keys, n)], len(keys)
                        if size > EVENTS_HELD * 3 // 4:
                            yield from rows(keys, n)
                            held, size = [], 0
        if held:
            yield from rows(*merged())

    return docs.select("text", "train").mapInArrow(batches, "context long, events array<int>, n array<long>")


def _log_gamma(x):
    """Stirling's series, eight up from the argument; over numpy arrays and Spark columns."""
    log = F.log if isinstance(x, Column) else np.log
    y = x + 8.0
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    series = 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * y * y * y * y * y)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(product)


def _log_kt(n0, n1):
    """Log of the Krichevsky-Trofimov probability of any order of so many zeros and ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Subtrees:
    """The nodes of depth ``SHARED`` and more that the events of one task have at one place of their byte.

    Whole contexts of ``SHARED`` bytes have to be in one task. A node is its context's bytes, nearest
    lowest, above the place (1 for the first decision, then the bits decided so far after a leading 1).
    """

    def __init__(self, events: np.ndarray, n: np.ndarray, bit: int, depth: int):
        byte = events & 255
        self.depth, self.outcome = depth, (byte >> bit & 1).astype(bool)
        deepest = (events >> 8 << 8) | (1 << (7 - bit)) | (byte >> (bit + 1))
        nodes, self.of_event = np.unique(deepest, return_inverse=True)
        ones = np.bincount(self.of_event, n * self.outcome, len(nodes))
        zeros = np.bincount(self.of_event, n * ~self.outcome, len(nodes))
        own = _log_kt(zeros, ones)
        self.levels = [(nodes, zeros, ones, own, np.ones(len(nodes)))]
        self.parents: list[np.ndarray] = []
        for d in range(depth - 1, SHARED - 1, -1):
            below, zeros, ones, weighted, _ = self.levels[0]
            nodes, parent = np.unique(below & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            zeros, ones, longer = (np.bincount(parent, x, len(nodes)) for x in (zeros, ones, weighted))
            own = _log_kt(zeros, ones)
            weighted = np.logaddexp(own, longer) + LOG_HALF
            self.levels.insert(0, (nodes, zeros, ones, weighted, np.exp(own + LOG_HALF - weighted)))
            self.parents.insert(0, parent)

    def chances(self, mixed: np.ndarray, rest: np.ndarray, estimate: np.ndarray) -> np.ndarray:
        """Probability of every event's outcome, given the path to each node of depth ``SHARED``: what is
        mixed already, the weight that is left, and the estimate above."""
        for d in range(SHARED, self.depth + 1):
            _, zeros, ones, _, stop = self.levels[d - SHARED]
            if d > SHARED:
                parent = self.parents[d - SHARED - 1]
                mixed, rest, estimate = mixed[parent], rest[parent], estimate[parent]
            seen = zeros + ones > 0
            stop = np.where(seen, stop, 1.0)
            estimate = np.where(seen, (ones + 0.5) / (zeros + ones + 1.0), estimate)
            mixed, rest = mixed + rest * stop * estimate, rest * (1 - stop)
        one = mixed[self.of_event]
        return np.where(self.outcome, one, 1 - one)


def _flat(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy()


def _array(values: np.ndarray | pa.Array) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def _whole_contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``context``, in tables of whole contexts: as many as hold ``SUBTREE_EVENTS`` events, or
    one that holds more."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for part in parts:
        contexts = part.column("context").to_numpy()
        sizes = pc.list_value_length(part.column("events")).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(contexts):
            if n >= SUBTREE_EVENTS and contexts[at] != last:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            # Rows up to where enough are held, then on to the end of that context.
            to = at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), SUBTREE_EVENTS - n))
            last = contexts[min(to, len(contexts)) - 1]
            to = int(np.searchsorted(contexts, last, side="right"))
            held.append(part.slice(at, to - at))
            n += int(sizes[at:to].sum())
            at = to
    if held:
        yield pa.Table.from_batches(held)


_NODE = {"node": pa.int64(), "n0": pa.float64(), "n1": pa.float64(), "weighted": pa.float64()}


def event_scores(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``event, n, score``: every event, its count, and log10 of its mixed probability, from ``count_events``."""

    def summaries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _whole_contexts(parts):
            keys, n = _summed(_events(own), _flat(own.column("n")))
            contexts, events, counts = _by_context(keys, n)
            tops = [Subtrees(keys, n, bit, depth).levels[0][:4] for bit in range(8)]
            columns = [np.concatenate(c) for c in zip(*tops)]
            order = np.argsort(columns[0] >> 8, kind="stable")
            of_node = (columns[0] >> 8)[order]
            offsets = pa.array(np.append(np.searchsorted(of_node, contexts), len(of_node)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order], t)) for c, t in zip(columns, _NODE.values())]
            whole = pa.RecordBatch.from_arrays([pa.array(contexts), events, counts, *lists], ["context", "events", "n", *_NODE])
            for at in range(0, whole.num_rows, 256):
                yield whole.slice(at, 256)

    summed = staged(
        counted.repartition("context")
        .sortWithinPartitions("context")
        .mapInArrow(
            summaries,
            "context long, events array<int>, n array<long>, node array<long>, n0 array<double>, n1 array<double>, "
            "weighted array<double>",
        ),
        "events",
        "zstd",
    )
    subtrees = summed.select(F.inline(F.arrays_zip(*_NODE)))
    levels = [subtrees]
    own = _log_kt(F.col("n0"), F.col("n1"))
    for d in range(SHARED - 1, -1, -1):
        above = (
            levels[0]
            .groupBy(F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("node"))
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("longer"))
            .withColumn("own", own)
            .withColumn("most", F.greatest("own", "longer"))
            .withColumn(
                "weighted",
                F.log(F.exp(F.col("own") - F.col("most")) + F.exp(F.col("longer") - F.col("most")))
                + F.col("most")
                + LOG_HALF,
            )
            .withColumn("stop", F.exp(F.col("own") + LOG_HALF - F.col("weighted")))
        )
        levels.insert(0, staged(above.select("node", "n0", "n1", "weighted", "stop"), f"context-{d}"))
    seen = F.col("n0") + F.col("n1") > 0
    here = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    path = levels[0].select(F.col("node").alias("above"), F.lit(0.0).alias("mixed"), F.lit(1.0).alias("rest"), F.lit(0.5).alias("estimate"))
    for d in range(SHARED):
        stop = F.when(seen, F.col("stop")).otherwise(F.lit(1.0))
        above = F.col("node").bitwiseAND(F.lit((1 << 8 * max(d, 1)) - 1)) if d else F.col("node")
        path = (
            levels[d]
            .withColumn("above", above)
            .join(path, "above")
            .withColumn("estimate", F.when(seen, here).otherwise(F.col("estimate")))
            .select(
                F.col("node").alias("above"),
                (F.col("mixed") + F.col("rest") * stop * F.col("estimate")).alias("mixed"),
                (F.col("rest") * (1 - stop)).alias("rest"),
                "estimate",
            )
        )
    tops = (
        subtrees.select("node", F.col("node").bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).alias("above"))
        .join(path, "above")
        .groupBy(F.shiftright("node", 8).alias("context"))
        .agg(F.sort_array(F.collect_list(F.struct("node", "mixed", "rest", "estimate"))).alias("tops"))
    )

    def scores(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _whole_contexts(parts):
            keys, n = _events(own), _flat(own.column("n"))
            top = pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in map(pc.list_flatten, own.column("tops").chunks)])
            top = top.sort_by("node")
            nodes = top.column("node").to_numpy()
            path = [top.column(c).to_numpy() for c in ("mixed", "rest", "estimate")]
            total = np.zeros(len(keys))
            for bit in range(8):
                trees = Subtrees(keys, n, bit, depth)
                at = np.searchsorted(nodes, trees.levels[0][0])
                total += np.log10(trees.chances(*(x[at] for x in path)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(total)], ["event", "n", "score"])

    # A context is one row here: no order is needed for whole contexts.
    return summed.select("context", "events", "n").join(tops, "context").mapInArrow(scores, "event long, n long, score double")


def frequent(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """The rows of highest weight, whole classes of like weight (16 to a doubling), at most ``most`` rows."""
    level = F.floor(F.log2(F.col(weight).cast("double")) * 16)
    sizes = rows.where(F.col(weight) > 0).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    least, total = None, 0
    for found in sorted(sizes.collect(), key=lambda r: -r["level"]):  # at most 16 * 64 classes
        total += found["n"]
        if total > most:
            break
        least = found["level"]
    return rows.where((F.col(weight) > 0) & (level >= F.lit(least).cast("long")))


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: every token of ``docs`` (``text`` in bytes, ``train``) and how often training has it."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words, n = list(counts), list(counts.values())
            for at in range(0, len(words), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[some], pa.binary()), pa.array(n[some], pa.int64())], ["word", "n"]
                )
            counts.clear()

        for part in parts:
            for text, train in zip(part.column(0), part.column(1).to_pylist()):
                tokens = tokens_of(text.as_py())
                if train:
                    counts.update(tokens)
                else:
                    for word in tokens:
                        if word not in counts:
                            counts[word] = 0
                if len(counts) > WORDS_HELD:
                    yield from rows()
        yield from rows()

    partial = docs.select("text", "train").mapInArrow(batches, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


class EventTable:
    """Scores of frequent events: two hash tables with one place a key, the second for keys whose place in
    the first is another's, and binary search among the few left over. Key and score lie side by side."""

    NONE = -1  # of eight bytes, of which an event has seven

    def __init__(self, events: np.ndarray, scores: np.ndarray):
        self.tables = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):  # fixed values: odd numbers that mix well
            bits = max(len(events), 1).bit_length() + 1
            table = np.empty(1 << bits, dtype=[("event", np.int64), ("score", np.float64)])
            table["event"], table["score"] = self.NONE, 0.0
            shift = np.uint64(64 - bits)
            at = self._place(events, factor, shift)
            table["event"][at] = events
            own = table["event"][at] == events
            table["score"][at[own]] = scores[own]
            events, scores = events[~own], scores[~own]
            self.tables.append((factor, shift, table))
        order = np.argsort(events)
        self.others, self.other_scores = events[order], scores[order]

    @staticmethod
    def _place(events: np.ndarray, factor: int, shift: np.uint64) -> np.ndarray:
        return events.view(np.uint64) * np.uint64(factor) >> shift

    def find(self, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each event, zero if it is none of them; and where those are that are none."""
        (factor, shift, table), (factor2, shift2, table2) = self.tables
        found = table[self._place(events, factor, shift)]
        scores = found["score"]
        missed = np.flatnonzero(found["event"] != events)
        wanted = events[missed]
        found = table2[self._place(wanted, factor2, shift2)]
        wrong = found["event"] != wanted
        scores[missed] = np.where(wrong, 0.0, found["score"])
        missed, wanted = missed[wrong], wanted[wrong]
        if len(self.others):
            at = np.minimum(np.searchsorted(self.others, wanted), len(self.others) - 1)
            there = self.others[at] == wanted
            scores[missed[there]] = self.other_scores[at[there]]
            missed = missed[~there]
        return scores, missed


def _by_row(
    rows: list[np.ndarray], events: list[np.ndarray], n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different events of each of ``n`` rows: how many a row has, the events, and how often each is there."""
    if not rows:
        return np.zeros(n, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row, event = np.concatenate(rows), np.concatenate(events)
    order = np.lexsort((event, row))
    row, event = row[order], event[order]
    first = np.append(True, (row[1:] != row[:-1]) | (event[1:] != event[:-1]))[: len(row)]
    places = np.flatnonzero(first)
    return np.bincount(row[places], minlength=n), event[places], np.diff(places, append=len(row))


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def score_documents(
    docs: DataFrame,
    held_out: Column,
    depth: int = DEPTH,
    frequent_words: int = FREQUENT_WORDS,
    frequent_events: int = FREQUENT_EVENTS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from the rows where ``held_out`` (a column over ``docs``) is false (null: false); scores all,
    whole. Null and blank texts have the end as their only token. ``base_score`` is the smoothed unigram
    score. Repeated rows are scored and, if not held out, learned from as often as they stand there; null
    ids stay null. With nothing to learn from, all estimates are one half. Other columns are ignored; an
    empty table gives no rows.

    Counts, trees and scores are Spark tables that grow with the corpus. Only the most frequent words of at
    most ``WORD_BYTES`` bytes and events, fixed numbers of them at most (under 20 MB each), travel to the
    tasks; whatever else a document has is counted there and joined.
    """
    texts = docs.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    counted = texts.select("text", (~F.col("held_out")).alias("train"))
    words = staged(count_words(counted), "words")
    total, distinct = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, True))
    ).first()
    base = F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    known = words.withColumn("base", base)
    scored = staged(event_scores(count_events(counted, depth), depth), "event-scores", "zstd")
    short = known.where(F.octet_length("word") <= WORD_BYTES)
    word_table = frequent(short, "n", frequent_words).select("word", "base").toArrow()
    event_table = frequent(scored, "n", frequent_events).select("event", "score").toArrow()
    common_words = word_table.column("word").to_pylist()
    bases = np.append(word_table.column("base").to_numpy(), 0.0)
    common = EventTable(event_table.column("event").to_numpy(), event_table.column("score").to_numpy())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(common_words)}
        other = len(place)
        for part in (some for whole in parts for some in _slices(whole, 2)):
            texts = [tokens_of(t.as_py()) for t in part.column(2)]
            n = part.num_rows
            n_known, base, sizes = [], [], []
            rare: list[bytes] = []
            times: list[int] = []
            for tokens in texts:
                at = np.fromiter(map(place.get, tokens, repeat(other)), np.int64, len(tokens))
                away = np.flatnonzero(at == other).tolist()
                rest = Counter([tokens[i] for i in away])
                n_known.append(len(tokens) - len(away))
                base.append(bases[at].sum())
                sizes.append(len(rest))
                rare.extend(rest)
                times.extend(rest.values())
            score = np.zeros(n)
            lost, lost_of = [], []
            for row, found in events_of(texts, depth, LOOKUP_CHUNK) if texts else ():
                own, missing = common.find(found)
                score += np.bincount(row, own, n)
                lost.append(found[missing])
                lost_of.append(row[missing])
            row, rest, often = _by_row(lost_of, lost, n)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(n_known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(score),
                    _lists(sizes, pa.array(rare, pa.binary())),
                    _lists(sizes, pa.array(times, pa.int64())),
                    _lists(row, pa.array(rest)),
                    _lists(row, pa.array(often)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times", "events", "often"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    started = staged(
        texts.mapInArrow(
            batches,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, "
            "rare array<binary>, times array<long>, events array<long>, often array<long>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "started-documents",
        "zstd",
    )
    rare = started.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times")
    )
    by_words = rare.join(known, "word").select(
        "row",
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("more_known"),
        (F.col("times") * F.col("base")).alias("more_base"),
        F.lit(0.0).alias("more_score"),
    )
    by_events = (
        started.select("row", F.explode(F.arrays_zip("events", "often")).alias("e"))
        .select("row", F.col("e.events").alias("event"), F.col("e.often").alias("often"))
        .join(scored, "event")
        .select(
            "row",
            F.lit(0).cast("long").alias("more_known"),
            F.lit(0.0).alias("more_base"),
            (F.col("often") * F.col("score")).alias("more_score"),
        )
    )
    added = by_words.unionByName(by_events).groupBy("row").agg(
        *(F.sum(c).alias(c) for c in ("more_known", "more_base", "more_score"))
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return started.join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("n_known", "more_known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        plus("score", "more_score").alias("score"),
    )
