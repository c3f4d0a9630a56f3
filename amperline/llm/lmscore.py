"""Cross-entropy difference of two matched n-gram models, both counted over the whole corpus.

Both are interpolated bigram models over one vocabulary, all words of all documents. The
background model counts every document, the target model those that the target table names
(labelled good and not toxic, say). With c counts, N all words and V the vocabulary and one
place for what it lacks:

    p1(w) = (c(w) + 1) / (N + V)        p(w | u) = (c(u, w) + MASS * p1(w)) / (c(u) + MASS)

A document's score is the mean over its words of log p_target - log p_background: above 0 it
reads more like the target.

The models grow with the corpus, so no task and no driver holds one. Blocks of documents send
their distinct words, contexts and pairs with counts to buckets; a bucket adds them up and answers
each block with the totals of that block's own entries; blocks then score their documents. A
word that every document has arrives once per block. Keys travel sorted and as differences, counts
as compressed bytes. A target document is scored with its own words in both models, as the others
are in the background model.

Defined cases: null, empty or blank text has no words and null losses and score; a document
named more than once in the target table counts once; without target documents the target
model is flat; repeated rows are counted each; an empty table gives no rows; other columns are
not read; rows without a doc_id are no target. Words and pairs are told apart by the high 48 bits
of 64-bit hashes: of n distinct ones about n / 2**48 share theirs with another (4 in 10,000 at 1e11).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperline.llm.kernel import Text, chunks, mix, pack_numbers, u64, unpack_numbers
from amperline.llm.quality import plain_word_hashes
from amperline.llm.store import save

MASS = 5.0
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20
_SPARE = u64(16)  # low bits of a hash that are not kept
_SENT = "bucket int, block int, keys binary, n binary, n_target binary"
_ANSWERS = "block int, n binary, n_target binary, bucket int, vocabulary long, words long, target_words long"
_SCORES = "doc_id long, n_words long, loss_target double, loss_background double, score double"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64()), ("score", pa.float64())])


class Grams:
    """A chunk's words and pairs as places in `keys`: first its words, then contexts, then pairs."""

    def __init__(self, t: Text):
        h, self.doc = plain_word_hashes(t)
        vocabulary, word = np.unique(h, return_inverse=True)
        size = len(vocabulary)
        before = np.full(len(word), size)  # a document's first word follows no word
        follows = self.doc[1:] == self.doc[:-1]
        before[1:][follows] = word[:-1][follows]
        code, self.pair = np.unique(before * (size + 1) + word, return_inverse=True)
        self.pair_context, self.pair_word = code // (size + 1), code % (size + 1)
        names = np.append(vocabulary, u64(0))
        pair_key = mix(names[self.pair_context] * u64(0xD1342543DE82EF95) + names[self.pair_word] + u64(3))
        # the low bit of what is kept: a word, not a context or pair
        keys = np.concatenate([mix(vocabulary + u64(1)), mix(names + u64(2)), pair_key]) >> _SPARE
        self.keys = (keys & ~u64(1)) | (np.arange(len(keys)) < size).astype(u64)
        self.size = size
        self.places = [word, size + before, 2 * size + 1 + self.pair]

    def counts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each key, and those in documents that are wanted."""
        flag = wanted[self.doc]
        n, of_target = (sum(np.bincount(p[keep], minlength=len(self.keys)) for p in self.places) for keep in (slice(None), flag))
        return n, of_target


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, first bytes first; the planes of zeros vanish."""
    return pack_numbers(np.diff(keys, prepend=u64(0)).view(np.int64))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(raw)).view(u64)


def _block(table: pa.Table) -> tuple[list[tuple[int, int, Grams]], np.ndarray]:
    """The block's chunks and its distinct keys in order."""
    parts = [(lo, hi, Grams(t)) for lo, hi, t in chunks(table["text"])]
    return parts, np.unique(np.concatenate([g.keys for _, _, g in parts]))


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts among sorted keys."""
    return np.searchsorted(((keys >> (u64(32) - _SPARE)) * u64(buckets)) >> u64(32), np.arange(buckets + 1, dtype=u64))


def _send(buckets: int):
    def send(key, docs, target):
        if not docs.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("keys", "n", "n_target")}})
        named = target["target_id"].combine_chunks() if target.num_rows else pa.array([], pa.int64())
        wanted = pc.is_in(docs["doc_id"], named).to_numpy()
        parts, keys = _block(docs)
        n = np.zeros((2, len(keys)), np.int64)
        for lo, hi, g in parts:
            at = np.searchsorted(keys, g.keys)
            for row, own in zip(n, g.counts(wanted[lo:hi]), strict=True):
                np.add.at(row, at, own)
        cut = _cut(keys, buckets)
        some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.table(
            {
                "bucket": pa.array(some, pa.int32()),
                "block": pa.array([docs["block"][0].as_py()] * len(some), pa.int32()),
                "keys": pa.array([_pack_keys(keys[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
                **{c: pa.array([pack_numbers(v[cut[b] : cut[b + 1]]) for b in some], pa.binary()) for c, v in zip(("n", "n_target"), n, strict=True)},
            }
        )

    return send


def _add_up(key, table):
    """The totals of each block's keys in its order; one more row has the bucket's part of V and N."""
    parts = [_unpack_keys(x.as_py()) for x in table["keys"]]
    end = np.cumsum([len(x) for x in parts])
    flat = np.concatenate(parts)
    del parts
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    is_word = (flat[at] & u64(1)).astype(bool)
    size = np.diff(np.append(at, len(flat)))
    del flat
    answers, words = [], []
    for c in ("n", "n_target"):
        n = np.concatenate([unpack_numbers(x.as_py()) for x in table[c]])
        total = np.add.reduceat(n[order], at)
        words.append(int(total[is_word].sum()))
        n[order] = np.repeat(total, size)
        answers.append([pack_numbers(x) for x in np.split(n, end[:-1])])
    n_rows = len(end)
    return pa.table(
        {
            "block": pa.array([*table["block"].to_pylist(), -1], pa.int32()),
            "n": pa.array([*answers[0], None], pa.binary()),
            "n_target": pa.array([*answers[1], None], pa.binary()),
            "bucket": pa.array([*table["bucket"].to_pylist(), -1], pa.int32()),
            "vocabulary": pa.array([0] * n_rows + [int(is_word.sum())], pa.int64()),
            "words": pa.array([0] * n_rows + [words[0]], pa.int64()),
            "target_words": pa.array([0] * n_rows + [words[1]], pa.int64()),
        }
    )


def log_p(n: np.ndarray, g: Grams, total: int, vocabulary: int) -> np.ndarray:
    """Log probability of each distinct pair of a chunk; `n`: the model's counts of the chunk's keys."""
    p1 = (n[: g.size] + 1.0) / (total + vocabulary + 1)
    context, pair = n[g.size : 2 * g.size + 1], n[2 * g.size + 1 :]
    return np.log((pair + MASS * p1[g.pair_word]) / (context[g.pair_context] + MASS))


def _rate(buckets: int, vocabulary: int, totals: tuple[int, int]):
    def rate(key, docs, answers):
        if not docs.num_rows:
            return _SCORES_ARROW.empty_table()
        parts, keys = _block(docs)
        cut = _cut(keys, buckets)
        n = np.zeros((2, len(keys)), np.int64)
        for b, *raw in zip(answers["bucket"].to_pylist(), answers["n"], answers["n_target"], strict=True):
            for row, x in zip(n, raw, strict=True):
                row[cut[b] : cut[b + 1]] = unpack_numbers(x.as_py())
        out = []
        for lo, hi, g in parts:
            own = n[:, np.searchsorted(keys, g.keys)]
            words = np.bincount(g.doc, minlength=hi - lo)
            background, target = (-np.bincount(g.doc, log_p(own[i], g, totals[i], vocabulary)[g.pair], hi - lo) / np.maximum(words, 1) for i in (0, 1))
            losses = [pa.array(x, mask=words == 0) for x in (target, background, background - target)]
            out.append(pa.table([docs["doc_id"].slice(lo, hi - lo), pa.array(words.astype(np.int64)), *losses], schema=_SCORES_ARROW))
        return pa.concat_tables(out)

    return rate


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, loss_target, loss_background, score) per row; `target` names documents by doc_id."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    blocks, buckets = max(1, -(-size // BLOCK_BYTES)), max(24, -(-size // BUCKET_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    keyed = docs.select("*", block)
    named = target.select("doc_id").dropna().distinct().select(F.col("doc_id").alias("target_id"), block)

    sent = keyed.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(_send(buckets), _SENT)
    answers = save(sent.groupBy("bucket").applyInArrow(_add_up, _ANSWERS), "gram-totals")
    vocabulary, *totals = (x or 0 for x in answers.agg(*(F.sum(c) for c in ("vocabulary", "words", "target_words"))).first())
    answers = answers.where("block >= 0").select("block", "bucket", "n", "n_target")
    return keyed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_rate(buckets, vocabulary, tuple(totals)), _SCORES)
