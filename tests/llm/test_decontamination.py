"""Decontamination: recall of the sampled walks, long texts, short and repeated items."""

import random

import numpy as np
import pytest

from amperline.llm import decontam
from tests.llm import plain

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def edited(r, words, edits, evenly):
    w, n = list(words), len(words)
    at = [(i + 1) * n // (edits + 1) for i in range(edits)] if evenly else r.sample(range(n), edits)
    for p in sorted(at, reverse=True):
        w[p : p + 1] = r.choice([[], ["new"], [w[p], "more"]])
    return w


def found(spark, docs, items):
    got = decontam.contaminated(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS))
    return {(x.doc_id, x.item_id): (x.n_words, x.distance, x.start, x.end) for x in got.collect()}


@pytest.mark.parametrize("evenly", [False, True])
def test_recall_of_windows_with_all_edits(spark, evenly):
    """Against plain edit distances, for items of 5 to 60 words with as many edits as allowed, in words of which a third are very common."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    common = ["the", "of", "and", "to"]
    draw = lambda: r.choice(common) if r.random() < 0.35 else r.choice(words)
    lengths = [5, 6, 7, 8, 10, 12, 15, 16, 17, 20, 25, 40, 60]
    items = [(i, [draw() for _ in range(lengths[i % len(lengths)])]) for i in range(10 * len(lengths))]
    docs = [(i, [draw() for _ in range(40)] + edited(r, w, len(w) * 20 // 100, evenly) + [draw() for _ in range(40)]) for i, w in items]
    got = found(spark, [(d, " ".join(w)) for d, w in docs], [(i, " ".join(w)) for i, w in items])
    missed = [len(w) for i, w in items if (i, i) not in got and plain.nearest(w, docs[i][1]) <= len(w) * 20 // 100]
    assert len(missed) <= 0.02 * len(items), missed
    for (d, i), (n, distance, _, _) in got.items():
        assert n == len(items[i][1]) and distance == plain.nearest(items[i][1], docs[d][1]) <= n * 20 // 100


def test_long_text(spark):
    """Passages anywhere in a text of many segments, and the bytes where they stand."""
    r = random.Random(3)
    words = [f"v{i}" for i in range(20_000)]
    items = [(i, [r.choice(words) for _ in range(n)]) for i, n in enumerate([9, 16, 30, 200])]
    text = [r.choice(words) for _ in range(300_000)]
    for i, at in enumerate([0, 131_065, 262_140, len(text)]):
        text[at:at] = [x.upper() + "," for x in items[i][1]]
    whole = " ".join(text)
    got = found(spark, [(1, whole), (2, " ".join(text[1000:3000]))], [(i, " ".join(w)) for i, w in items])
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3)]
    for (_, i), (n, distance, start, end) in got.items():
        assert distance == 0 and n == len(items[i][1])
        assert plain.plain_words(whole.encode()[start:end].decode()) == items[i][1]


def test_short_items_are_matched_whole(spark):
    docs = [(1, "alpha beta gamma"), (2, "Alpha, beta!"), (3, "beta alpha"), (4, "alpha x beta gamma delta"), (None, "alpha beta"), (5, None), (6, "")]
    items = [(1, "alpha beta"), (2, "gamma"), (3, "beta gamma delta epsilon"), (4, None), (5, " ,. "), (None, "delta")]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (2, 1), (None, 1), (1, 2), (4, 2), (4, None)}


def test_repeated_rows_are_reported_each(spark):
    text = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other"), (2, f"{text} {text}")], DOCS)
    items = spark.createDataFrame([(7, text), (7, text), (8, text)], ITEMS)
    got = sorted((x.doc_id, x.item_id) for x in decontam.contaminated(docs, items).collect())
    assert got == sorted([(1, 7)] * 4 + [(1, 8)] * 2 + [(2, 7)] * 2 + [(2, 8)])


def test_bitmaps_let_all_of_the_index_through(spark, monkeypatch):
    """However full they are."""
    monkeypatch.setattr(decontam, "MAX_BITS", 1 << 19)
    r = random.Random(5)
    items = [(i, " ".join(f"u{r.randrange(10**6)}" for _ in range(20))) for i in range(1500)]
    index = decontam.index_items(spark.createDataFrame([(i, t, i) for i, t in items], "item_id long, text string, item_row long"))
    own = decontam.Filter(index)
    keys = np.array([x.key for x in index.select("key").collect()], np.int64).view(np.uint64)
    assert own.bits == 1 << 19 and own.known(keys).all() and own.classes == [16]
    docs = [(i, f"before {t} after") for i, t in items[::50]]
    assert set(found(spark, docs, items)) == {(i, i) for i, _ in docs}
