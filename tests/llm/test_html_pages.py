"""The page labeller where names tell nothing: layouts in disguise, sites of another generator, pages by
hand; pages that are hard to read; and the gradients it is trained by."""

import os
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pages_apart import BY_HAND, Site

from tidemark.llm import html_blocks as pages_of

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables not present")
    return [p for p in pq.read_table(f"{FOLDER}/pages.parquet").column("html").to_pylist() if p]


@pytest.fixture(scope="module")
def labeller(given):
    return pages_of.fit(pages_of.training_pages(given[: pages_of.SAMPLE]))


def precision_and_recall(labeller, items):
    vectors, right, chosen, wanted = pages_of.Vectors(), 0, 0, 0
    for blocks, labels in items:
        y, found = np.array(labels, bool), labeller.logits([vectors.matrix(blocks)])[0] > 0
        right, chosen, wanted = right + (y & found).sum(), chosen + found.sum(), wanted + y.sum()
    return right / chosen, right / wanted


@pytest.mark.parametrize("names, landmarks", [(False, False), (True, False), (False, True), (True, True)])
def test_layouts_in_disguise(given, labeller, names, landmarks):
    own = [b for p in given for b in pages_of.blocks_of(p)]
    main = [b.text for b in own if pages_of._is_main(b.element)]
    other = [b.text for b in own if not pages_of._is_main(b.element)]
    layout, r = pages_of._Layout(main, other, 77), random.Random(9)
    items = [pages_of._marked_blocks(pages_of.disguised(layout.page(), r, names, landmarks)) for _ in range(120)]
    precision, recall = precision_and_recall(labeller, items)
    assert precision > 0.93 and recall > 0.93, (precision, recall)


@pytest.mark.parametrize("landmarks", [False, True])
def test_sites_of_another_generator(labeller, landmarks):
    items = []
    for seed in range(60):
        site = Site(seed, landmarks)
        for _ in range(3):
            page, main = site.page()
            blocks = pages_of.blocks_of(page)
            items.append((blocks, [b.text in set(main) for b in blocks]))
    precision, recall = precision_and_recall(labeller, items)
    assert precision > 0.9 and recall > 0.9, (precision, recall)


@pytest.mark.parametrize("page, keep, drop", BY_HAND)
def test_pages_by_hand(labeller, page, keep, drop):
    blocks = pages_of.blocks_of(page)
    found = labeller.logits([pages_of.Vectors().matrix(blocks)])[0] > 0
    text = " ".join(b.text for b, x in zip(blocks, found) if x)
    assert [x for x in keep if x not in text] == [] and [x for x in drop if x in text] == []


def test_given_pages_come_out_as_their_article(given, labeller):
    vectors = pages_of.Vectors()
    for page in given:
        blocks = pages_of.blocks_of(page)
        own = [pages_of._is_main(b.element) for b in blocks]
        assert ((labeller.logits([vectors.matrix(blocks)])[0] > 0) == own).all()


@pytest.mark.parametrize(
    "page, n",
    [
        ("</x " * 262_144, 1), ("<a " * 349_526, 1), ("<div>x " * 149_797, 149_797), ("<b>x " * 209_716, 1),
        ("</p>" * 100_000 + "<div>" * 100_000, 0), ("<p a='" * 174_763, 1), ("<!--" * 262_144, 0), ("&am" * 349_526, 1),
        ("<div></b></p></i>" * 61_681, 0), ("<a b=\"" * 174_763 + ">", 0), ("<p>a</div>" * 104_858, 104_858),
    ],
)
def test_a_megabyte_of_broken_markup_takes_seconds(page, n):
    start = time.process_time()
    blocks = pages_of.blocks_of(page)
    pages_of.Vectors().matrix(blocks)
    assert time.process_time() - start < 10
    assert len(blocks) == n


@pytest.mark.parametrize(
    "page, texts",
    [
        ("&am<b>p;</b>", ["&amp;"]),
        ("&lt<!-- c -->;&amp;lt;", ["<;&lt;"]),
        ("a<x-y>b</x-y>c<unknown>d", ["abcd"]),
        ("<p>a<custom-x>b</custom-x>c<p>d", ["abc", "d"]),
        ("a<b", ["a<b"]),
        ("a<!-- x", ["a"]),
        ("a < b > c <p>d", ["a < b > c", "d"]),
        ("x" * 300_000 + "<p>y", ["x" * 300_000, "y"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "flat", ["deep", "flat"]),
    ],
)
def test_text_is_read_as_browsers_do(page, texts):
    assert [b.text for b in pages_of.blocks_of(page)] == texts


def test_gradients():
    rng = np.random.default_rng(1)
    lengths, width = np.array([5, 3, 1]), pages_of.WIDTH
    x, y = rng.standard_normal((5, 3, width)), (rng.random((5, 3)) < 0.5).astype(float)
    h = pages_of.HIDDEN
    shapes = {"W": (width, 4 * h), "U": (h, 4 * h), "b": (4 * h,)}
    p = {k + side: 0.2 * rng.standard_normal(s) for side in "fb" for k, s in shapes.items()}
    p |= {"V": 0.5 * rng.standard_normal((2 * h, 1)), "d": np.zeros(1)}
    _, grads = pages_of.loss_and_gradients(p, x, lengths, y)
    for name, value in p.items():
        for at in rng.choice(value.size, min(value.size, 12), replace=False):
            each = []
            for step in (1e-5, -1e-5):
                moved = {**p, name: value.copy()}
                moved[name].flat[at] += step
                each.append(pages_of.loss_and_gradients(moved, x, lengths, y)[0])
            assert grads[name].flat[at] == pytest.approx((each[0] - each[1]) / 2e-5, abs=1e-7, rel=1e-4)


def test_training_never_goes_without_blocks():
    assert len(pages_of.training_pages([], 8)) == 8 and len(pages_of.training_pages(["<script>x", ""], 4)) == 4
    with pytest.raises(ValueError, match="no block"):
        pages_of.fit([])
