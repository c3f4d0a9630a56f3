"""Quality rules: counted statistics of each document and boosted trees over them.

`statistics` counts every document in one pass of array operations per batch. `fit` learns two
things from at most `max_labelled` labelled documents (those with the smallest hash of their id;
6000 unless told otherwise, and nothing else is bounded):
a word list whose words mark toxic documents, and trees over the statistics for the label
"good and not toxic". Symbols, repeated lines, repeated words, capitals and listed words can only
lower a score. `score` applies both to every document.

Defined cases: null text is empty (fails the base rule); without labels of both kinds the trees
say yes to what the base rule keeps; repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from amperline.llm import boosting
from amperline.llm.encoder import forget
from amperline.llm.kernel import Text, chunks, mix, ngram_hashes, u64

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Base statistics in the order of the output.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "mark_share", "bar_share", "digit_share", "short_line_share", "listed_words", "listed_share"]
SIGNS = [0, 0, -1, -1, -1, -1, -1, -1, -1, 0, -1, -1]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL, _MARK, _BAR = _table("#*$%&|<>"), _table("!?"), _table("|")
_CAPITAL, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_OUTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def plain_word_hashes(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word in lower case, cut at everything in ASCII that is no letter or digit."""
    low = t.lower_ascii()
    buf = low.buf.copy()
    buf[_OUTER[buf]] = 32
    plain = Text(buf, t.off)
    start, end = plain.word_bounds()
    return plain.hashes(start, end), plain.doc_of(start)


def plain_word_hashes_at(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """The same words' hashes with their byte positions."""
    low = t.lower_ascii()
    low.buf[_OUTER[low.buf]] = 32
    start, end = low.word_bounds()
    return low.hashes(start, end), start


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def statistics(t: Text, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of a chunk's documents; `listed`: sorted hashes of marked words."""
    start, end = t.word_bounds()
    doc = t.doc_of(start)
    n_words = np.bincount(doc, minlength=t.n)
    points = np.zeros(len(t.buf) + 1, np.int64)
    np.cumsum((t.buf & 0xC0) != 0x80, out=points[1:])
    word_chars = np.bincount(doc, points[end] - points[start], t.n).astype(np.int64)
    n_symbols = t.count_by_doc(_SYMBOL[t.buf])

    ls, le, ld = t.line_bounds()
    has_word = np.searchsorted(start, le, side="left") > np.searchsorted(start, ls, side="left")
    ls, le, ld = ls[has_word], le[has_word], ld[has_word]
    n_lines = np.bincount(ld, minlength=t.n)
    line_key = np.unique(mix(t.hashes(ls, le) + ld.astype(u64) * u64(0x9E3779B97F4A7C15)), return_index=True)[1]
    n_dup_lines = n_lines - np.bincount(ld[line_key], minlength=t.n)
    short = np.bincount(ld, (le - ls) < 30, t.n)

    at, gram = ngram_hashes(t.hashes(start, end), doc, 5)
    hit = at[_repeated(mix(gram + doc[at].astype(u64) * u64(0x9E3779B97F4A7C15)))]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    n_repeat = np.bincount(doc, np.cumsum(cover)[:-1] > 0, t.n).astype(np.int64)

    words, wdoc = plain_word_hashes(t)
    if len(listed):
        place = np.minimum(np.searchsorted(listed, words), len(listed) - 1)
        marked = np.bincount(wdoc, listed[place] == words, t.n)
    else:
        marked = np.zeros(t.n)
    base = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], axis=1).astype(np.int64)
    x = np.stack(
        [
            n_words, _share(word_chars, n_words), _share(n_symbols, word_chars), _share(n_dup_lines, n_lines), _share(n_repeat, n_words),
            _share(t.count_by_doc(_CAPITAL[t.buf]), word_chars), _share(t.count_by_doc(_MARK[t.buf]), n_words), _share(t.count_by_doc(_BAR[t.buf]), n_words),
            _share(t.count_by_doc(_DIGIT[t.buf]), word_chars), _share(short, n_lines), marked, _share(marked, n_words),
        ],
        axis=1,
    )
    return base, x


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])


@dataclass(frozen=True)
class Model:
    listed: np.ndarray
    trees: boosting.Trees


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, text, quality, toxic) of at most `max_labelled` labelled documents."""
    chosen = labels.select("doc_id", "quality", "toxic").dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the sample's size is the bound


def marked_words(sample: DataFrame) -> np.ndarray:
    """Hashes of the words that are far more usual in toxic documents of the sample than in its others: in at least 5 of them, and 10 times the share."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for lo, _, t in chunks(batch.column(0)):
                h, d = plain_word_hashes(t)
                first = np.unique(mix(h + d.astype(u64)), return_index=True)[1]
                yield pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(toxic[lo + d[first]].astype(np.int64))], names=["word", "toxic"])

    sizes = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, bad = int(sizes[0]), int(sizes[1])
    if not bad or bad == n:
        return np.zeros(0, u64)
    counted = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(words, "word long, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    ratio = (F.col("t") / bad) / ((F.col("n") - F.col("t") + 0.5) / (n - bad))
    rows = counted.where((F.col("t") >= 5) & (ratio >= 10)).select("word").collect()  # words of the bounded sample
    return np.sort(np.array([r[0] for r in rows], np.int64).view(u64))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> Model:
    sample = _sample(docs, labels, max_labelled)
    listed = marked_words(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, t in chunks(batch.column(0)):
                base, x = statistics(t, listed)
                ok = ~base_failed(base)
                yield pa.record_batch([pa.array(list(x[ok]), pa.list_(pa.float64())), batch.column(1).slice(lo, hi - lo).filter(pa.array(ok))], names=["x", "good"])

    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    rows = sample.select("text", good.alias("good")).mapInArrow(features, "x array<double>, good int").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows["good"].to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the order in which rows arrive doesn't matter
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():
        x, y = x[:0], y[:0]
    return Model(listed, boosting.train(x, y, SIGNS))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """All columns of `docs` that are not named like a result, then the base counts, score, base_failed and kept."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    docs = docs.select([c for c in docs.columns if c not in added])
    text_at = docs.columns.index("text")
    schema = StructType(docs.schema.fields.copy())
    for c in BASE:
        schema = schema.add(c, "long")
    schema = schema.add("score", "double").add("base_failed", "boolean").add("kept", "boolean")
    empty_model = not len(model.trees.roots)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo, hi, t in chunks(batch.column(text_at)):
                base, x = statistics(t, model.listed)
                p = np.ones(len(x)) if empty_model else 1 / (1 + np.exp(-model.trees.score(x)))
                failed = base_failed(base)
                own = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns)]
                yield pa.record_batch([*own, *map(pa.array, base.T), pa.array(p), pa.array(failed), pa.array(~failed & (p >= threshold))], names=[*batch.schema.names, *BASE, "score", "base_failed", "kept"])

    return docs.mapInArrow(rate, schema)
