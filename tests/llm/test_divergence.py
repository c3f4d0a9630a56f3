"""Divergence of sources against a plain version over odd rows, blocks and flushed tables."""

import re
from collections import Counter, defaultdict

import pytest

from amperline.llm import divergence
from tests.llm.plain import lower
from tests.llm.test_operators import SF, odd_texts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "text string, lang string, source string, n long, count long, term string"


def plain_divergence(docs, min_docs, top):
    docs = [(lower(t or ""), a or "", b or "") for t, a, b in docs]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall(text)
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        sources = [s for a, s in counts if a == lang]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[x][t]) for t in kept), x.encode()) for x in sources if x != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, x.decode(), -value, i) for i, (value, x) in enumerate(rows, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def odd_rows():
    texts = odd_texts()
    rows = [(t, ["en", None, "", "de"][i % 4 if i % 5 else 0], [None, "a", "b", "é", "z"][i % 5]) for i, t in enumerate(texts)]
    return rows + [("only here", "xx", "s1"), (None, "xx", "s2"), ("", "yy", "s1")] + [("same words again", "en", "hot")] * 9


@pytest.mark.parametrize("min_docs", [1, 3, 10_000])
def test_odd_rows(spark, monkeypatch, min_docs):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], KIND).repartition(3)
    monkeypatch.setattr(divergence, "PAIR_CELLS", 50)
    assert got(divergence.divergence(frame, min_docs, 5)) == plain_divergence(rows, min_docs, 5)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert got(divergence.divergence(docs, 5, 50)) == plain_divergence(rows, 5, 50)


def test_tables_are_sent_on_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "TABLE_TERMS", 3)
    batch = pa.record_batch([pa.array(["en"] * 4), pa.array(["s"] * 4), pa.array(["a b c", "a d", None, "a a A"])], names=["lang", "source", "text"])
    sums, docs, sent = Counter(), Counter(), 0
    for part in divergence._count(iter([batch])):
        sent += 1
        for t, n, d in zip(part["term"].to_pylist(), part["n"].to_pylist(), part["docs"].to_pylist(), strict=True):
            sums[t] += n
            docs[t] += d
    assert sums == {"a": 5, "b": 1, "c": 1, "d": 1} and docs == {"a": 3, "b": 1, "c": 1, "d": 1} and sent > 1


def test_empty_table(spark):
    assert got(divergence.divergence(spark.createDataFrame([], KIND))) == []


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence.share(F.lit(9 * 10**15), F.lit(9 * 10**15 + 7), F.lit(3)).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**15 + 5) // (9 * 10**15 + 7 + 15)
