"""Importance resampling against a plain version, and the ring of CRC states against CRCs of whole runs."""

import hashlib
import math
import re
import zlib

import pytest

from amperline.llm import resample, words
from tests.llm.plain import lower
from tests.llm.test_operators import SCHEMA, SF, odd_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall(lower(text or ""))
    return [" ".join(w[i : i + n]) for i in range(len(w)) for n in (1, 2, 3) if i + n <= len(w)], len(w)


def plain_resample(docs, target, buckets=10_000, percent=5, min_words=20):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in plain_features(t)[0]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for d, text in docs:
        f, n = plain_features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, n, len(f), weight, score))
    able = sorted((r for r in rows if r[0] is not None and r[1] >= min_words), key=lambda r: (-r[4], r[0], r[2], r[3]))
    drawn = able[: percent * len(able) // 100]
    left = list(drawn)
    out = [(*r, i + 1) for i, r in enumerate(drawn)]
    for r in rows:
        if r in left:
            left.remove(r)
        else:
            out.append((*r, None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def odd_docs():
    texts = odd_texts()
    return [(i * 3 - 4, t) for i, t in enumerate(texts)] + [(5, texts[-1]), (5, texts[-1]), (None, texts[13]), (None, None), (8, "x " * 30), (8, "y " * 30)]


@pytest.mark.parametrize("percent", [5, 60])
def test_same_as_plain(spark, odd_docs, percent):
    target = [None, "", "alpha beta same five words", "日本語 go here"] + [odd_texts()[13]]
    frame = spark.createDataFrame([(d, t, "en", None, None, "clash", None, "k") for d, t in odd_docs], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert got(resample.importance_resample(frame, bench, percent=percent)) == plain_resample(odd_docs, target, percent=percent)


def test_given_table(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(resample.importance_resample(docs, bench)) == plain_resample(rows, [r.text for r in bench.collect()])


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert got(resample.importance_resample(none, bench)) == []
    some = [(1, "one two three"), (2, "four " * 25)]
    assert got(resample.importance_resample(spark.createDataFrame(some, "doc_id long, text string"), bench)) == plain_resample(some, [])


def test_ring_goes_on_over_pieces():
    text = " ".join(f"w{i} Ünï" for i in range(500)).encode()
    states, found = [], []
    for part in words.word_lists(text, resample.WORD_BYTES, limit=97):
        crcs, states = resample.ring(part, 3, states)
        found += crcs
    assert sorted(found) == sorted(zlib.crc32(f.encode()) for f in plain_features(text.decode())[0])
