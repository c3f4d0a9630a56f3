"""The sort of op7 by itself, and rows of op7 that share a doc_id."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from amperline.llm import suffix
from tests.llm import plain


@pytest.mark.parametrize("letters, repeat", [(2, 1), (4, 1), (26, 1), (26, 6), (1, 1)])
def test_equal_windows(letters, repeat):
    r = np.random.default_rng(letters + repeat)
    text = np.tile(r.integers(97, 97 + letters, 3000).astype(np.uint8), repeat)
    at = r.permutation(len(text) - suffix.LENGTH + 1)
    want = defaultdict(set)
    for i, a in enumerate(at):
        want[text[a : a + suffix.LENGTH].tobytes()].add(i)
    rows, begin = suffix.equal_windows(text, at)
    got = [set(x.tolist()) for x in np.split(rows, begin[1:])] if len(rows) else []
    assert sorted(map(sorted, got)) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_quicksort_leaves_small_or_deep_groups():
    r = np.random.default_rng(9)
    text = r.integers(97, 101, 20000).astype(np.uint8)
    w = suffix.Windows(text, np.arange(len(text) - suffix.LENGTH))
    rows, group = suffix.multikey_quicksort(w)
    depth = 8 * suffix.SHALLOW
    for g in np.split(rows, suffix._begins(group)[1:]):
        assert len(g) <= suffix.SMALL or len({text[x : x + depth].tobytes() for x in g}) == 1


def test_runs_with_one_hash_and_other_bytes():
    text = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    lead = suffix._leads(np.zeros(3, np.uint64), np.array([4, 5, 6]), text, np.array([0, 60, 120]), np.array([60, 60, 60]))
    assert lead.tolist() == [0, 1, 0]


def test_rows_with_one_id_and_other_texts(spark):
    a = "a passage of well over fifty bytes that stands in more than one document here"
    b = "quite another passage that nobody else has, also longer than fifty bytes and unique"
    rows = [(1, a), (5, a + " tail"), (5, b), (5, b), (7, b), (None, a), (None, None)]
    got = suffix.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("sha", F.sha2("kept_text", 256)).collect()
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("", a, b, " tail")}
    assert sorted((r.doc_id or 9, r.n_bytes, r.n_removed, r.sha) for r in got) == sorted(
        [(1, len(a), 0, sha[a]), (5, len(a) + 5, len(a), sha[" tail"]), (5, len(b), 0, sha[b]), (5, len(b), 0, sha[b]), (7, len(b), len(b), sha[""]), (9, len(a), 0, sha[a]), (9, 0, 0, sha[""])]
    )
    assert plain.cut_repeats([(1, a), (5, a + " tail"), (7, b)])[1][2] == len(a)


def test_too_long_text_is_refused(monkeypatch):
    from amperline.llm.kernel import Text

    monkeypatch.setattr(suffix, "_PLACE_BITS", 10)
    with pytest.raises(ValueError, match="do not fit"):
        suffix.Runs(Text(np.zeros(1024, np.uint8), np.array([0, 1024])))
