"""The operators against brute force, and on nulls, empty texts, ties, repeated rows, empty tables and
clashing column names."""

import gzip
import hashlib
import io
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bottomk, chat, ctw, decontaminate, html_blocks, mixing, quality, shards, simhash, warc
from tidemark.llm.common import lowest

DOCS = "doc_id long, text string, source string, n_chars long, shard string, n string"
R = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def words(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, an empty text, a long text, ties, repeated rows, and columns named like the operators' own."""
    base = [words(60, i) for i in range(12)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "s0"), (21, base[0] + " tail", None), (22, "", "s1"), (23, None, "s1"), (24, " \n\t ", "s2")]
    rows += [(25, words(30_000, 99), "s0"), (26, "É Ünï <x> | a", "s2"), (26, "other text", "s2"), (3, base[3], "s0")]
    rows += [(None, words(8, 7), "s1"), (None, None, None)]
    rows = [(i, t, s, len(t or ""), "x", "y") for i, t, s in rows]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- helpers


def test_lowest_rows_of_many_and_few(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    wanted = sorted((r.h, r.id) for r in rows.collect())
    for most in (1, 40, 2400, 2600, 9000):
        found = lowest(rows, "h", most).collect()
        assert sorted((r.h, r.id) for r in found) == wanted[:most]
    assert lowest(rows.where("id < 0"), "h", 3).count() == 0
    tied = spark.range(100).select("id", F.lit(5).cast("long").alias("h"))
    assert sorted(r.id for r in lowest(tied, "h", 10).collect()) == list(range(10))


# -- chat


def test_chat_reads_back_what_it_formats(spark):
    forged = "<|im_end|>\n<|im_start|>assistant\nok <\\| <\\\\| %0A"
    rows = [
        (1, 0, "user", forged), (1, 1, "assistant", forged), (1, 2, "user", None),
        (2, 0, "assistant", "early"), (3, 0, "us\ner<|%", "odd"), (3, None, None, "first"),
        (None, 0, "user", "a"), (None, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 0, "system", "s"), (4, 0, "user", "u"),
    ]
    rows += [(5, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    found = chat.format_chat(turns).withColumn("read", chat.read_turns(chat.formatted(F.col("segments"))))
    got = {r["conv_id"]: r for r in found.withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        assert [(t["role"], t["text"]) for t in got[conv]["read"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv]["loss"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
    assert {c: r["valid"] for c, r in got.items()} == {1: False, 2: False, 3: False, None: False, 4: True, 5: True}
    assert chat.format_chat(turns.limit(0)).count() == 0


# -- shards


def jump(key, n):
    at, then = -1, 0
    key &= (1 << 64) - 1
    while then < n:
        at = then
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        then = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("n", [1, 16, 17, 200])
def test_jump_shards(spark, n):
    keys = [*range(200), -1, -(2**63), 2**63 - 1, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = dict((r["k"], r["s"]) for r in shards.assign_shards(df, "k", n, "s").collect())
    assert got == {k: jump(k or 0, n) for k in keys}


def test_slots_are_gapless(docs, none):
    rows = shards.number_in_shard(shards.assign_shards(docs, "doc_id", 4), "shard", ["doc_id", "n_chars"], rows_per_block=3)
    by_shard = defaultdict(list)
    for r in rows.collect():
        by_shard[r["shard"]].append(r["slot"])
    assert sum(map(len, by_shard.values())) == docs.count()
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert set(docs.columns) <= set(rows.columns)
    assert shards.number_in_shard(shards.assign_shards(none, "doc_id", 4), "shard", ["doc_id"]).count() == 0


# -- fingerprints


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def test_edits_and_likeness(docs, none):
    rows = sorted(bottomk.fingerprint_edits(docs).collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"], reverse=True)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    assert len(rows) == docs.count()
    ids = sorted({i for i in texts if i is not None}, reverse=True) + [None]
    for r in rows:
        if r["doc_id"] is None or len(texts[r["doc_id"]]) > 1:
            continue
        text = texts[r["doc_id"]][0]
        after = texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        moved = len(text) // 3
        edits = {text[: len(text) - moved] + a[:moved] for a in after}
        assert r["n_chars"] == len(text) and r["edited"] in edits
        a, b = shingles(text), shingles(r["edited"])
        exact = len(a & b) / len(a | b) if a | b else 1.0
        assert r["near_edited"] == pytest.approx(exact, abs=0.2 if len(a) > 128 else 1e-9)
    assert bottomk.fingerprint_edits(none).count() == 0
    assert bottomk.fingerprint_edits(docs.where("doc_id = 25")).first()["near_next"] == 1.0


def test_next_goes_over_block_borders(spark):
    ids = R.sample(range(10_000), 500)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "id long, v string")
    got = {r["id"]: int(r["next_v"]) for r in bottomk.with_next(df, "id", ["v"], F.col("v"), 7).collect()}
    down = sorted(ids, reverse=True)
    assert got == dict(zip(down, [*down[1:], down[0]]))


def test_next_under_one_id(spark):
    """A third of the rows share one id, another part has none, some are repeated; any cut gives one ring."""
    rows = [(7, f"t{i % 150}") for i in range(200)] + [(i, "x") for i in range(100, 300)] + [(None, f"n{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v string").withColumn("shard", F.lit(1))
    down = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = Counter((a, b[1]) for a, b in zip(down, [*down[1:], down[0]]))
    for size in (3, 40, 1000):
        found = bottomk.with_next(df.repartition(5), "id", ["v"], F.col("v"), size)
        assert found.columns == ["id", "v", "shard", "next_v"]
        assert Counter(((r["id"], r["v"]), r["next_v"]) for r in found.collect()) == want
    blocks = bottomk.with_next(df, "id", ["v"], F.col("v"), 20)
    assert bottomk.with_next(df.limit(0), "id", ["v"], F.col("v")).count() == 0 and blocks.count() == 600
    one = bottomk.with_next(df.limit(1), "id", ["v"], F.col("v")).first()
    assert one["next_v"] == one["v"]


@pytest.mark.parametrize("name", ["hash", "sketch", "n", "group", "of"])
def test_sketches_of_groups_by_any_name(spark, name):
    df = spark.createDataFrame([(1, [3, 1]), (1, [2, 3]), (None, [5]), (2, [])], f"`{name}` int, s array<long>")
    found = bottomk.merge_groups(df, name, "s", 2)
    assert {tuple(r)[0]: tuple(r)[1] for r in found.collect()} == {1: [1, 2], None: [5]}


def test_sketches_merge(spark):
    text = words(3000, 1)
    parts = [" ".join(text.split()[i : i + 600]) for i in range(0, 3000, 596)]
    df = spark.createDataFrame([(1, p) for p in parts] + [(2, None)], "g int, t string").withColumn("s", bottomk.sketch(F.col("t")))
    merged = bottomk.merge_groups(df, "g", "s")
    whole = spark.createDataFrame([(text,)], "t string").select(bottomk.sketch(F.col("t")).alias("w"))
    row = merged.crossJoin(whole).select(
        F.col("sketch") == F.col("w"), bottomk.distinct_shingles(F.col("w")), bottomk.containment(df_part := F.col("sketch"), F.col("w"))
    ).first()
    assert row[0] and row[1] == pytest.approx(len(shingles(text)), rel=0.3) and row[2] == pytest.approx(1, abs=0.01)


# -- mixing


def test_mix_hits_targets(spark, none):
    r = random.Random(2)
    rows = [(i, s, r.randint(1, 40)) for i, s in enumerate(r.choices(["a", "b", "c", "d", None], [60, 30, 5, 4, 1], k=4000))]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("clash"))
    mixed = mixing.mix(df, F.col("size"), shards=5, rows_per_block=50)
    got = mixed.collect()
    assert sorted(x["doc"]["doc_id"] for x in got) == list(range(4000))
    sizes, taken, targets, quotas = Counter(), Counter(), {}, defaultdict(Counter)
    for x in got:
        s = x["doc"]["source"]
        sizes[s] += x["size"]
        taken[s] += x["size"] * len(x["draws"])
        targets[s] = x["target"]
        assert len(x["draws"]) <= 3
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(names, itertools.cycle((5, 2, 1))))
    want, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            free.discard(s)
            left -= want[s]
    want |= share
    assert targets == pytest.approx(want)
    assert all(abs(taken[s] - targets[s]) <= 41 for s in names)
    again = {x["doc"]["doc_id"]: x["draws"] for x in mixing.mix(df.repartition(7), F.col("size"), shards=5, rows_per_block=50).collect()}
    assert again == {x["doc"]["doc_id"]: x["draws"] for x in got}
    assert mixing.shuffled(mixed).columns == df.columns
    assert mixing.mix(none, F.length("text")).count() == 0


def test_mix_reruns_agree_under_one_id(spark):
    """Texts that share an id are drawn alike whatever the order of rows, and spread over blocks."""
    rows = [(7, words(1 + i % 9, i) + f" t{i}", "a", 1, 2, "x") for i in range(600)]
    rows += [(None if i % 2 else i, words(5, 900 + i), "bc"[i % 2], 1, 2, "x") for i in range(500)]
    names = "doc_id long, text string, source string, place int, _place int, doc string"
    size = F.size(F.split("text", " "))
    seen = []
    for order, parts in ((rows, 3), (rows[::-1], 8)):
        mixed = mixing.mix(spark.createDataFrame(order, names).repartition(parts), size, shards=4, rows_per_block=50)
        drawn = mixing.mixed_rows(mixed).select("doc.text", "epoch", "shard", "place").collect()
        seen.append(sorted(map(tuple, drawn)))
        again = mixing.shuffled(mixed)
        assert again.columns == ["doc_id", "text", "source", "place", "_place", "doc"]
        assert sorted(r.text for r in again.collect()) == sorted(r.text for r in drawn)
    assert seen[0] == seen[1]


def test_splitting_tree_keeps_quotas(spark):
    quotas = {"a": 700, "b": 90, "c": 10}
    df = spark.createDataFrame(list(quotas.items()), "source_key string, quota long")
    rows = mixing.split_quotas(df, 6).collect()
    by_source, by_shard = Counter(), Counter()
    for x in rows:
        by_source[x["source_key"]] += x["quota"]
        by_shard[x["shard"]] += x["quota"]
    assert by_source == quotas and max(by_shard.values()) - min(by_shard.values()) <= 3


# -- SimHash


def test_golay_keys_are_shared_within_two_bits():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for n in (0, 1, 2):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, n, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        sets = []
        for x in (base, other):
            own = defaultdict(set)
            for r, k in zip(*simhash.keys_of(x)):
                own[r].add(k)
            sets.append(own)
        assert all(sets[0][i] & sets[1][i] for i in range(len(base)))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 3, 0) + 1)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=2):
    label = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("most", [64, 2])
def test_close_fingerprints_are_found(spark, most):
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(30)]
    for base in prints[:6]:
        for _ in range(25):
            base ^= 1 << r.randrange(64)
            prints.append(base)
    prints += [prints[0] ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 64, 5), 2)]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.close_pairs(df, most=most)).collect()}
    groups = lambda labels: sorted(sorted(s for s, x in zip(signed, labels) if x == y) for y in set(labels))
    assert groups([roots.get(s, s) for s in signed]) == groups(brute_components(prints))


def test_near_duplicates(docs, none):
    rows = docs.collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    label = brute_components(prints)
    first = {x: min((r["doc_id"] for r, y in zip(rows, label) if x == y and r["doc_id"] is not None), default=None) for x in set(label)}
    want = sorted(map(repr, ((r["doc_id"], p, first[x]) for r, p, x in zip(rows, prints, label))))
    found = simhash.near_duplicates(docs).collect()
    assert sorted(map(repr, ((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in found))) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(none).count() == 0


# -- decontamination


def test_contamination_equals_brute_force(spark, docs, none):
    long = words(30_000, 99).split()
    items = [
        (1, " ".join(long[500:530])), (2, words(60, 0)), (3, "É ünï"), (4, "ünï  <x>"), (5, None), (6, "..."),
        (7, words(12, 999)), (2, words(60, 1)), (None, words(60, 2)), (8, "w1"), (9, " ".join(long[-11:])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))

    def split(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c > "\x7f" else " " for c in low).split(" ")

    own = [(("" if i is None else str(i)), [w for w in split(t) if w]) for i, t in items]
    windows = {(i, tuple(w[k : k + 10])) for i, w in own if w for k in range(max(len(w) - 10, 0) + 1)}
    want = []
    for r in docs.collect():
        w = [x for x in split(r["text"]) if x]
        hit, names = set(), set()
        for i, span in windows:
            for k in range(len(w) - len(span) + 1):
                if w[k] == span[0] and tuple(w[k : k + len(span)]) == span:
                    hit.update(range(k, k + len(span)))
                    names.add(i)
        want.append((r["doc_id"], len(w), len(hit), sorted(names)))
    found = decontaminate.find_contamination(docs, bench)
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()))) == sorted(map(repr, want))
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[2] for x in want)
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# -- quality


def test_quality_learns_grades(spark, none):
    r = random.Random(4)
    rows, grades = [], []
    for i in range(900):
        g = i % 3
        extra = {0: ["foul" + r.choice("abc") for _ in range(3)], 1: [w.upper() + "!!" for w in r.choices(WORDS, k=30)], 2: []}[g]
        text = r.choices(WORDS, k=60) + extra
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        grades.append((i, g))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string").withColumn("grade", F.lit("z"))
    ratings = spark.createDataFrame([*[g for g in grades if g[0] < 600], (1, None), (5000, 2), (2, 9)], "doc_id long, grade int")
    model = quality.train(docs, ratings)
    assert (np.diff(model.thresholds) >= 0).all()
    found = {r["doc_id"]: r for r in quality.grade_documents(docs, model).collect()}
    right = np.mean([found[i]["selected"] == (g == 2) for i, g in grades if i >= 600])
    assert right > 0.97 and len(found) == 903
    means = [np.mean([found[i]["expected_grade"] for i, g in grades if g == k and i >= 600]) for k in range(3)]
    assert means == sorted(means)
    kept = quality.select_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["selected"] for r in found.values())
    blank = quality.train(docs, ratings.limit(0))
    assert quality.select_documents(docs, blank).count() == docs.count()
    assert quality.grade_documents(none, model).count() == 0


@pytest.mark.parametrize("copies", [False, True])
def test_a_frequent_id_sends_no_more_than_the_sample(spark, monkeypatch, copies):
    rows = [(1, "same text" if copies else f"text {i}", 2) for i in range(600)] + [(i, f"other {i}", 1) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(8)
    ratings = spark.createDataFrame([(1, 2)] + [(i, 1) for i in range(2, 30)], "doc_id long, grade long")
    ratings = ratings.union(ratings.where("doc_id = 2").withColumn("grade", F.lit(0).cast("long")))
    sent, fitted, arrow = [], [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: sent.append(arrow(df)) or sent[-1])
    monkeypatch.setattr(quality, "fit", lambda texts, grades, n: fitted.append((texts, grades)))
    for sample in (50, 5000):
        quality.train(docs, ratings, sample)
        quality.train(docs.repartition(3), ratings, sample)
        (texts, grades), (again, _) = fitted[-2:]
        assert sent[-1].num_rows <= min(sample, 30 if copies else 629) + (sample < 100)
        assert len(texts) == len(grades) == min(sample, 629)
        assert list(map(bytes, texts)) == list(map(bytes, again))
    assert Counter(grades) == {2: 600, 1: 28, 0: 1}


# -- WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [
        (5, "http://a/é", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (7, None, None), (8, "http://c\r\nx", ""),
        (9, "http://d", "é" * 100_000), (9, "http://d", "é" * 100_000), (None, "http://e", "<p>one</p>"), (10, "u", "a\r\n\r\nb"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = str(tmp_path / "warc")
    warc.write_pages(pages, folder)
    got = warc.read_pages(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((h or "") for i, u, h in rows if i == r["page_id"])
        data = text.encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == warc.base32_sha1(data)
        first = {"<p>one</p>": 3, "": 7}.get(text, r["page_id"])
        assert (r["type"], r["refers_to"]) == (("revisit", first) if r["page_id"] != first else ("response", None))
        assert r["payload"] == (data if r["type"] == "response" else None)
    least = str(tmp_path / "least")
    warc.write_pages(pages, least, least_bytes=5)
    assert {r["page_id"] for r in warc.read_pages(spark, least).where("type = 'revisit'").collect()} == {5, None}
    empty = str(tmp_path / "empty")
    warc.write_pages(pages.limit(0), empty)
    assert warc.read_pages(spark, empty).count() == 0


def test_warc_pushdown_and_foreign_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f"page {i % 10}") for i in range(60)], "page_id long, url string, html string")
    folder = tmp_path / "warc"
    warc.write_pages(pages.coalesce(2), str(folder))
    (folder / "part-lost.warc.gz").write_bytes(b"left behind by a lost task")
    read = spark.read.format("warc").option("payload", "false").load(str(folder))
    some = read.where("type = 'revisit' AND target_uri LIKE 'http://h1/%'")
    assert "warc-type" not in (plan := some._jdf.queryExecution().executedPlan().toString()) and plan.count("Filter") <= 1
    assert some.count() == sum(1 for i in range(10, 60) if i % 3 == 1)
    assert read.where("payload IS NOT NULL").count() == 0
    raw = b"".join(warc.record(i, "u", b"body %d" % i, None) for i in range(5))
    (tmp_path / "x.warc").write_bytes(raw)
    (tmp_path / "y.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(i, "u", b"body %d" % i, None)) for i in range(5, 8)))
    both = spark.read.format("warc").load(str(tmp_path)).where("type = 'response'")
    assert sorted(bytes(r["payload"]) for r in both.collect()) == [b"body %d" % i for i in range(8)]
    inflated = warc.gzip_member(raw)
    assert gzip.decompress(inflated) == raw
    cut = warc.gzip_member(warc.record(1, "u", b"x" * 9000, None))[:-200]
    with pytest.raises(EOFError):
        [r.payload() for r in warc.records(io.BufferedReader(io.BytesIO(cut)))]


# -- HTML


def test_blocks_of_broken_markup():
    page = "<p>a &amp; b\n<b>c</b>d<br>e<p class='x y'>f<!-- no --><script>var t='</p>';</script> g<ul><li>h<li><a href=#>i</a></ul></div>j<"
    blocks = html_blocks.blocks_of(page)
    assert [b.text for b in blocks] == ["a & b cd e", "f", "g", "h", "i", "j<"]
    assert blocks[1].path == ("p", "x", "y") and blocks[4].linked == 1 and blocks[5].path == ()
    assert html_blocks.blocks_of(None) == [] == html_blocks.blocks_of("<!-- open <p>x")


@pytest.mark.parametrize(
    "page, texts",
    [
        # Names that only begin like a raw element.
        ("<svg-icon>a</svg-icon><object-view>b</object-view><title-bar>c<p>d", ["abc", "d"]),
        ("<select-box><p>a</select-box><math-field>b</math-field><script-x>c", ["abc"]),
        ("<title>no</title><script>no</script ><style>no</style x><p>a", ["a"]),
        # Elements with text of their own, closed or not.
        ("<div><svg><text>a</text></div><p>b", ["a", "b"]),
        ("<object data=x>a<p>b</object><p>c", ["a", "b", "c"]),
        ("<object>a<p>b", ["a", "b"]),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then<p>b", ["if x=1 then", "b"]),
        ("<p>a<math><mi>x<p>b", ["ax", "b"]),
        ("<select><option>a<option>b</select><p>c", ["a", "b", "c"]),
        ("<select><option>a<p>b", ["a", "b"]),
        # Quotes open a value only after an equals sign.
        ("<a title=don't href=x>a</a><p>b<p>it's<p>c", ["a", "b", "it's", "c"]),
        ("<p 5\">a<p title=\"x>y\" id = '>'>b \"c\"", ["a", 'b "c"']),
        ("<p title=\"open>a<p>b", ["a", "b"]),
        ("<iframe srcdoc=\"<p>no/>no\">no</iframe>a", ["a"]),
        # Comments that end at once, and comments ended in the other way.
        ("<!-->a<p>b<!-- no -->c", ["a", "bc"]),
        ("<!--->a<p>b<!-- no --!>c<!---->d", ["a", "bcd"]),
    ],
)
def test_tags_take_no_text_with_them(page, texts):
    assert [b.text for b in html_blocks.blocks_of(page)] == texts


def test_shapes_of_a_drawing_do_not_nest():
    blocks = html_blocks.blocks_of("<a href=x><svg class=icon>" + "<path d='M0'/>" * 50 + "<text>a</text></svg>b</a><p>c")
    assert [(b.text, b.path, b.linked) for b in blocks] == [("a", ("svg", "icon", "text"), 1), ("b", (), 1), ("c", ("p",), 0)]


def test_labeller_on_unseen_layouts_and_pages(spark):
    prose = [words(60, i) + "." for i in range(300)]
    small = [words(5, i + 1000) for i in range(300)]
    layout = html_blocks._Layout(prose, small, 1)
    pages = [layout.page().replace("\x00", "") for _ in range(60)]
    pages = [(i, f"u{i}", p) for i, p in enumerate(pages)] + [(100, None, None), (101, "u", ""), (None, "u", "<p>"), (102, "u", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    labeller = html_blocks.train(df)
    fresh = html_blocks._Layout(prose, small, 2)
    vectors, right = html_blocks.Vectors(), []
    for _ in range(80):
        blocks, labels = html_blocks._marked_blocks(fresh.page())
        right += list((labeller.logits([vectors.matrix(blocks)])[0] > 0) == np.array(labels))
    assert np.mean(right) > 0.95
    out = {r["page_id"]: r for r in html_blocks.extract(df, labeller).collect()}
    assert len(out) == 64 and out[100]["text"] == "" and out[101]["n_chars"] == 0
    assert html_blocks.extract(df.limit(0), labeller).count() == 0


# -- language model


def brute_ctw(texts, train, depth):
    """Context-tree weighting written down directly: log10 probabilities of all texts."""
    spell = lambda t: b"\0" * (depth - 1) + b" " + b" ".join(ctw.tokens_of(t))
    counts = defaultdict(lambda: [0, 0])
    decide = lambda byte: [((1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]
    for t, used in zip(texts, train):
        data = spell(t)
        for i in range(depth, len(data) if used else 0):
            for place, bit in decide(data[i]):
                for d in range(depth + 1):
                    counts[data[i - d : i], place][bit] += 1
    children = defaultdict(set)
    for context, place in counts:
        if context:
            children[context[1:], place].add((context, place))
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    weighted, stop = {}, {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(counts[node])
        if len(node[0]) == depth:
            weighted[node], stop[node] = own, 1.0
        else:
            longer = sum(weighted[c] for c in children[node])
            weighted[node] = np.logaddexp(own, longer) + math.log(0.5)
            stop[node] = math.exp(own + math.log(0.5) - weighted[node])

    def chance(data, i, place, bit):
        mixed, rest, estimate = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            node = (data[i - d : i], place)
            if node not in counts:
                return mixed + rest * estimate
            n = counts[node]
            estimate = (n[bit] + 0.5) / (sum(n) + 1)
            mixed, rest = mixed + rest * stop[node] * estimate, rest * (1 - stop[node])
        return mixed

    out = []
    for t in texts:
        data = spell(t)
        out.append(sum(math.log10(chance(data, i, *x)) for i in range(depth, len(data)) for x in decide(data[i])))
    return out


@pytest.mark.parametrize(("some_words", "some_events"), [(1 << 17, 1 << 20), (3, 40)])
def test_context_tree_weighting_equals_brute_force(spark, none, some_words, some_events):
    texts = ["the cat sat on the mat", "The dog sat", None, "", "unseen wörds zzz the", "the cat sat on the mat"] + [words(20, i) for i in range(4)]
    held = [False, False, False, True, True, False, True, False, False, None]
    df = spark.createDataFrame([(i if i != 7 else None, t, h) for i, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, h boolean").withColumn("row", F.lit(1))
    train = [not h for h in held]
    raw = [None if t is None else t.encode() for t in texts]
    tokens = [ctw.tokens_of(t) for t in raw]
    counts = Counter(w for t, used in zip(tokens, train) if used for w in t)
    total, kinds = sum(counts.values()), len(counts)
    want = brute_ctw(raw, train, ctw.DEPTH)
    got = ctw.score_documents(df, F.col("h"), frequent_words=some_words, frequent_events=some_events).collect()
    assert len(got) == len(texts)
    for r in got:
        i = 7 if r["doc_id"] is None else r["doc_id"]
        assert r["score"] == pytest.approx(want[i], abs=1e-6)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens[i])
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]))
    assert ctw.score_documents(none, F.lit(False)).count() == 0


def test_events_in_pieces():
    texts = [ctw.tokens_of(words(n, n).encode()) for n in (0, 1, 5, 90, 2, 300)] + [[b"\n"]] * 3
    whole = [np.concatenate(x) for x in zip(*ctw.events_of(texts, 6))]
    spelled = [b"\0" * 5 + b" " + b" ".join(t) for t in texts]
    want = [(i, int.from_bytes(x[p - 6 : p + 1], "big")) for i, x in enumerate(spelled) for p in range(6, len(x))]
    assert list(zip(*(x.tolist() for x in whole))) == want
    for chunk in (1, 5, 64):
        pieces = [np.concatenate(x) for x in zip(*ctw.events_of(texts, 6, chunk))]
        assert all((a == b).all() for a, b in zip(whole, pieces))


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_event_table_finds_all_and_nothing_else(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 62, n))
    keys = np.random.default_rng(1).permutation(keys)
    table = ctw.EventTable(keys, keys.astype(float))
    scores, missing = table.find(keys)
    assert (scores == keys.astype(float)).all() and not len(missing)
    scores, missing = table.find(np.arange(1000) - (1 << 61))
    assert (scores == 0).all() and len(missing) == 1000
    scores, missing = table.find(np.concatenate([[-5], keys, [-6]]))
    assert scores[0] == 0 and missing.tolist() == [0, len(keys) + 1]


def test_subtrees_come_in_whole_contexts(monkeypatch):
    monkeypatch.setattr(ctw, "SUBTREE_EVENTS", 10)
    r = random.Random(3)
    contexts = sorted(r.choices(range(12), [1, 30, 2, 2, 2, 1, 1, 40, 1, 1, 1, 3], k=200))
    lists = [list(range(r.randrange(1, 4))) for _ in contexts]
    keys = np.random.default_rng(5).integers(0, 1 << 56, 999)
    packed = pa.table(list(map(ctw._array, ctw._by_context(keys, keys % 7))), ["context", "events", "n"])
    assert sorted(zip(ctw._events(packed), ctw._flat(packed.column("n")))) == sorted(zip(keys, keys % 7))
    most = max(sum(len(x) for c, x in zip(contexts, lists) if c == d) for d in range(12))
    for size in (1, 3, 64, 500):
        batches = pa.table({"context": contexts, "events": lists}).to_batches(max_chunksize=size)
        tables = list(ctw._whole_contexts(iter(batches)))
        assert sum((t.column("context").to_pylist() for t in tables), []) == contexts
        assert sum((t.column("events").to_pylist() for t in tables), []) == lists
        edges = [(t.column("context")[0].as_py(), t.column("context")[-1].as_py()) for t in tables]
        assert all(a[1] != b[0] for a, b in zip(edges, edges[1:]))
        assert max(len(ctw._flat(t.column("events"))) for t in tables) < 10 + most
        assert len(tables) >= 4
    assert list(ctw._whole_contexts(iter([]))) == []


def test_the_model_beats_the_unigram_base(spark):
    """Unseen texts of phrases that training has too; one text without a blank is one long word."""
    r = random.Random(6)
    parts = "the tion ing er an re on at en nd st or".split()
    word = lambda: "".join(r.choices(parts, k=r.choice([1, 1, 2, 3])))
    phrases = [" ".join(word() for _ in range(6)) for _ in range(60)]
    rows = [(i, " ".join(r.choice(phrases) for _ in range(20))) for i in range(300)] + [(300, "x" * 50_000)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ctw.score_documents(docs, F.col("doc_id") % 5 == 1, frequent_words=20, frequent_events=50)
    unseen = found.where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert unseen["score"] > unseen["base"]
    assert found.where("doc_id = 300 and n_known = 2").count() == 3
