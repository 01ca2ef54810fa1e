"""Fill-in-the-middle, conversation repair and adaptive rules against brute force, and on nulls, empty and
long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim, repair, rules
from tidemark.llm.queries import damaged

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
R = random.Random(11)


# -- fill in the middle


def brute_middle(doc_id, text):
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_text(n, seed):
    r = random.Random(seed)
    return "".join(r.choices(["a", "é", "日", "𝔘", " ", "\n", "\t", " ", "<", "P", ">", "S"], k=n))


def test_middle_against_brute_force(spark):
    rows = [(i, random_text(R.randrange(60), i)) for i in range(400)]
    rows += [(i, random_text(30_000, i)) for i in range(400, 430)]
    rows += [(1001, None), (1002, ""), (1003, " \n "), (1004, "a <P> b"), (None, "x y z"), (7, "other"), (7, "other")]
    rows += [(i, "<P <S <M\n>P> " * 3) for i in range(2000, 2020)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, form string")
    found = fim.fill_in_middle(docs).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: str(r)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key)
    assert got == sorted(((i, *brute_middle(i, t or "")) for i, t in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert all(r.again == r.text for r in found)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_cuts_do_not_depend_on_blocks(block):
    for seed in range(60):
        text = random_text(seed * 3, seed)
        units = UNITS.findall(text)
        for first, second in ((0, len(units)), (R.randrange(99), R.randrange(99))):
            n, prefix, middle = fim.cut(text.encode(), first, second, block)
            a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
            assert (n, prefix, middle) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))


def test_tree_descends_to_the_block_of_each_unit():
    for n in range(1, 40):
        units = [R.randrange(4) for _ in range(n)]
        chars = [R.randrange(9) for _ in range(n)]
        tree, sums = fim.Fenwick(units, chars), np.cumsum([0, *units])
        for k in range(1, sum(units) + 1):
            at = int(np.searchsorted(sums, k)) - 1
            assert tree.descend(k) == (at, sums[at], sum(chars[:at]))


# -- repair

COSTS = repair.Costs()


def brute_repair(rows, costs):
    """The cheapest edits of a few rows by trying all: cost, audit."""
    best = None

    def finish(initials, cost, audit):
        nonlocal best
        if re.fullmatch(r"(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
            best = cost, audit

    def walk(i, initials, cost, audit, run):
        if run < 2:
            for x in "ua":
                walk(i, initials + x, cost + costs.insert, audit + "I", run + 1)
        if i == len(rows):
            return finish(initials, cost, audit)
        role, _, must_go, truncated = rows[i]
        walk(i + 1, initials, cost + costs.delete, audit + "D", 0)
        if not must_go:
            more = costs.truncated if truncated else 0
            walk(i + 1, initials + (role[:1] or "?"), cost + costs.keep + more, audit + "K", 0)
            for x in "ua":
                walk(i + 1, initials + x, cost + costs.rerole + more, audit + "R", 0)

    walk(0, "", 0, "", 0)
    return best


@pytest.mark.parametrize(
    "costs", [COSTS, repair.Costs(0, 3, 7, 1, 2), repair.Costs(1, 1, 9, 2, 0), repair.Costs(0, 4, 4, 2, 0)]
)
def test_weights_settle_cost_and_audit(costs):
    for n in range(4):
        for roles in product(("system", "user", "assistant", "tool"), repeat=n):
            rows = [(r, "x", R.random() < 0.2, R.random() < 0.3) for r in roles]
            wanted = brute_repair(rows, costs)
            for cut in range(n + 1):
                blocks = [rows[:cut], rows[cut:]]
                rest, leaves = repair.Rest.end(costs), []
                weights = [repair.block_weights(b, repair.STATES, costs) for b in blocks]
                for block, w in zip(reversed(blocks), reversed(weights)):
                    rest, out = rest.before(w, len(block))
                    leaves.insert(0, out)
                state, audit, turns = repair.BEGIN, "", []
                for i, block in enumerate(blocks):
                    to = leaves[i][state]
                    piece = repair.letters(weights[i][state, to], len(block)) + "I" * (i * repair.CLOSING[to])
                    turns += repair.edited(block, piece, state)
                    audit, state = audit + piece, to
                assert (rest.cost[repair.BEGIN], audit) == wanted
                assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in turns))


def brute_findings(rows):
    """Everything ``repair`` says of one conversation, from its rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    cells = [(role, text, f in ("blank", "duplicate"), f == "truncated") for (_, role, text), f in zip(rows, faults)]
    rest, leaves = repair.Rest.end(COSTS).before(weights := repair.block_weights(cells, [0], COSTS), len(cells))
    audit = repair.letters(weights[0, leaves[0]], len(cells)) + "I" * repair.CLOSING[leaves[0]]
    turns = "\n".join(f"{r}:{t}" for r, t in repair.edited(cells, audit, 0))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    count = Counter(faults)
    return (
        gaps, count["blank"], count["duplicate"], count["truncated"], repair.illegal_pairs([r[1][:1] for r in rows]),
        rest.cost[0], audit, hashlib.sha256(turns.encode()).hexdigest(),
    )


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_of_short_and_long_conversations(spark, monkeypatch):
    r = random.Random(3)
    roles, texts = ["system", "user", "assistant", "tool", ""], ["a.", "b!", "c", " ", "", "d? ", "é", "long " * 50]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(100, t // 2, ("user", "assistant")[t % 2 if r.random() < 0.9 else 0], f"t{t % 700}.") for t in range(3000)]
    rows += [(101, None, "user", "a."), (101, None, "user", "a."), (101, 3, "assistant", "b."), (None, 5, "user", "q?")]
    rows += [(102, 1, "user", "same.")] * 500 + [(103, t, None, None) for t in range(3)]
    turns = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, said string")
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((t, " " if role is None else role, " " if text is None else text))
    spelled = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()
    for c in own:
        own[c].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], spelled(x)))
    parts, found = repair.repair(turns.repartition(5))
    got = {x.conv_id: tuple(x[c] for c in FOUND) for x in found.collect()}
    assert got == {c: brute_findings(x) for c, x in own.items()}
    assert parts.where("conv_id = 100").count() >= 24
    assert parts.where("not whole").select("conv_id").distinct().count() >= 3
    assert repair.repair(turns.limit(0))[1].count() == 0


def test_a_conversation_is_cut_by_its_text_too():
    rows = [(1, 0, ("user", "x" * 400_000, False, False)) for _ in range(7)]
    sizes = [len(block) for _, _, block, _ in repair._cut(rows)]
    assert sizes == [2, 2, 2, 1]


def test_damage(spark):
    turns = spark.createDataFrame(
        [(c, t, "assistant", "a. b!") for c in range(40) for t in range(5)] + [(None, None, None, None)],
        "conv_id long, turn long, role string, text string",
    )
    kinds = Counter((r.role, r.text) for r in damaged(turns).collect())
    assert kinds["user", "a. b!"] and kinds["assistant", ""] and kinds["assistant", "a b"]
    assert sum(kinds.values()) != 200


# -- rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered), len(lines),
    )


DOCS = "doc_id long, text string, lang string, source string, n_words int, salt string, doc string, class int"


def test_counts_against_brute_force(spark):
    r = random.Random(8)
    texts = ["".join(r.choices(["a ", "b ", "é ", "x\n", "| ", "<", " \n", "\t"], k=r.randrange(80))) for _ in range(300)]
    texts += [None, "", " \n ", "a a a a", "one two three one two three", "w " * 30_000, "a\r\nb\r\na\r\n", "𝔘 𝔘 𝔘 𝔘"]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "s", "d", 2) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: tuple(x[c] for c in rules.COUNTS) for x in rules.measured(docs).collect()}
    assert got == {i: brute_counts(t or "") for i, t in enumerate(texts)}
    assert rules.judge(docs).count() == len(texts) and rules.judge(docs.limit(0)).count() == 0


def test_sketches_merge_and_are_near(spark):
    values = [R.randrange(10 ** R.randrange(1, 7)) for _ in range(5000)]
    rows = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "part int, v long")
    rule = [rules.Rule("v", F.col("v"), 1)]
    whole = rules.sketch(rows, [], rule)
    merged = rules.merged(rules.sketch(rows, ["part"], rule), [])
    order = lambda s: sorted((x["rule"], x["class"], x["n"]) for x in s.collect())
    assert order(whole) == order(merged)
    found = rules.quantiles(merged, [], {f"q{p}": p for p in (1, 10, 50, 90, 99)}).first()
    for p in (1, 10, 50, 90, 99):
        true = sorted(values)[-(-len(values) * p // 100) - 1]
        assert true - true / 32 <= found[f"q{p}"] <= true


def test_cutoffs_follow_the_source(spark):
    """A source full of tables keeps them; the same share of signs is refused elsewhere, even where a third
    of a source is like that; small sources are judged by their language."""
    plain = lambda i: " ".join(f"w{(i * 37 + k * k) % 9973}" for k in range(80))
    table = lambda i: " ".join(f"w{(i * 37 + k * k) % 9973} |" for k in range(80))
    rows = [(i, table(i), "en", "tables") for i in range(150)]
    rows += [(1000 + i, table(i) if i % 3 == 0 else plain(i), "en", "prose") for i in range(900)]
    rows += [(2000, plain(1), "en", "small"), (2001, table(2), "en", "small"), (2002, plain(5), None, None)]
    rows += [(3000, "too short", "en", "prose"), (3001, "a b c " * 40, "en", "prose"), (3002, None, "en", "prose")]
    docs = spark.createDataFrame([(*x, 1, "s", "d", 2) for x in rows], DOCS)
    found = {x.doc_id: x for x in rules.judge(docs).collect()}
    assert all(found[i].kept for i in range(150))
    assert all(found[1000 + i].kept == (i % 3 != 0) for i in range(900))
    assert found[1000].failed_rules == ["symbols"]
    assert found[2000].kept and not found[2001].kept and found[2002].kept
    assert all(found[i].base_failed and not found[i].kept for i in (3000, 3001, 3002))
    doubled = docs.union(docs.where("doc_id in (0, 2001)"))
    chosen = rules.select_documents(doubled)
    assert chosen.columns == docs.columns
    kept = Counter(x.doc_id for x in chosen.collect())
    assert kept == Counter({i: 1 + (i == 0) for i, x in found.items() if x.kept})
