"""The pipeline's stages against brute force on the smallest tables, each on its own input."""

import os
from collections import Counter

import pytest
from test_operators import brute_components, brute_fingerprint, jump

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, inputs = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, FOLDER)
        assert i == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    rated, deduplicated, clean, mixed = inputs[1:]
    cache = quality.TokenFeatures()
    model = quality.train(inputs[0], corpus_pipeline.rated(spark, FOLDER))
    keep = {r["doc_id"] for r in inputs[0].collect() if model.tails(
        quality.np.array([model.score(quality.features(r["text"], cache))]))[0, 1] >= 0.5}
    assert {r["doc_id"] for r in rated.collect()} == keep
    rows = rated.collect()
    label = brute_components([brute_fingerprint(r["text"]) for r in rows])
    first = {x: min(r["doc_id"] for r, y in zip(rows, label) if x == y) for x in set(label)}
    assert sorted(r["doc_id"] for r in deduplicated.collect()) == sorted(first.values())
    found = QUERIES["op9_decontaminate"](spark, FOLDER)
    bad = {r["doc_id"] for r in found.where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in deduplicated.collect()} - bad
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in clean.collect()}
    out = docs.collect()
    assert len(out) == sum(times.values())
    assert all(r["shard"] == jump(r["doc_id"], 16) for r in out)
    slots = Counter((r["shard"], r["slot"]) for r in out)
    assert max(slots.values()) == 1


def test_run_is_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and set(QUERIES) <= set(entry.queries())


def edge_rows(docs):
    """Documents with nulls in every column, empty and long texts, repeated rows and one id with two texts."""
    rows = [tuple(r) for r in docs.limit(120).collect()]
    rows += rows[:3] + [rows[5]] * 4
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows += [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, " \n ", None, "src1", 3)]
    rows += [(None, rows[7][1], "en", None, 1), (None, None, None, None, None), (9004, long, "en", "src2", len(long))]
    return rows + [(9005, "one text of its own kind", "en", "src3", 24), (9005, "another text, quite unlike the first", "en", "src3", 36)]


def test_stages_on_nulls_repeats_and_empty_tables(spark, tmp_path):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = spark.createDataFrame(edge_rows(given), given.schema).repartition(5)
    whole = Counter(map(tuple, docs.collect()))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        rows = [tuple(r[c] for c in given.columns) for r in out.collect()]
        kept = Counter(rows)
        assert set(kept) <= set(whole), name
        if i < 3:
            assert all(kept[r] <= whole[r] for r in kept), name
            assert stage(spark, out, FOLDER).count() == len(rows) or i == 0, name
        if name == "simhash near-dedup":
            label = dict(zip(whole, brute_components([brute_fingerprint(r[1]) for r in whole])))
            assert len(rows) == len(set(label.values())) == len({label[r] for r in rows})
        if name == "mixing sources to target weights":
            assert mixing_taken(rows, whole)
        if i == 4:
            assert kept == whole and {r.shard for r in out.select("shard").collect()} <= set(range(16))
        empty = stage(spark, given.limit(0), FOLDER)
        assert empty.count() == 0 and empty.columns[: len(given.columns)] == given.columns, name


def mixing_taken(rows, whole):
    """Words taken of each source against targets worked out by raising the level until none is above its cap."""
    words = lambda r: len((r[1] or "").split())
    sizes, taken = Counter(), Counter()
    for r, n in whole.items():
        sizes[r[3]] += words(r) * n
    for r in rows:
        taken[r[3]] += words(r)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, left = {}, set(names), sum(sizes.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]:
        for s in over:
            want[s] = 3 * sizes[s]
            free.discard(s)
            left -= want[s]
        if not free:
            break
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    longest = {s: max(words(r) for r in whole if r[3] == s) for s in names}
    return all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in names)


def test_mixing_reruns_agree_within_the_pipeline(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(5 if i % 3 else r[0], *r[1:]) for i, r in enumerate(map(tuple, given.collect()))]
    mixed = []
    for order, parts in ((rows, 3), (rows[::-1], 7)):
        docs = spark.createDataFrame(order, given.schema).repartition(parts)
        mixed.append(Counter(map(tuple, corpus_pipeline.mix_sources(spark, docs, FOLDER).collect())))
    assert mixed[0] == mixed[1]
