"""Target-distribution importance resampling over hashed runs of words.

Words are runs of 0-9, a-z and characters beyond ASCII, A-Z in lower case. A document's features
are its runs of 1 to `n` words, joined by one space; a feature's bucket is its CRC-32 modulo
`buckets`.

* A document is scanned once. A ring keeps the running zlib states of the last `n` starts; a new
  word opens a state of its own and extends the others by a space and the word, so each feature
  costs one step over its last word and no run is ever put together.
* Bucket counts are added up inside a task before they travel: a task sends `buckets` rows.
* A bucket's gain is floor(1000 * ln(share in the target / share in the documents)) with one
  added to each count. The `buckets` gains are all that goes to the tasks of the second scan.
* Scores are the sum of a document's gains and a Gumbel number from its id: the `percent` highest
  are a draw without replacement in proportion to exp(sum of gains / 1000). Places come from
  written ranges of scores, no task holds all of them.

Defined cases: null, empty and wordless texts have no features and weight 0; documents of fewer
than `min_words` words have a score and are never drawn; rows that share a doc_id are each scored,
and their order among each other follows n_features and weight; a row without a doc_id has no score, is not
drawn and does not count among the candidates; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperline.llm.words import keeping, raw_texts, word_lists
from amperline.operators import ranked

WORD_BYTES = keeping(b"0123456789abcdefghijklmnopqrstuvwxyz")


def ring(words: list[bytes], n: int, states: list[int]) -> tuple[array, list[int]]:
    """CRC-32 of each run of 1 to n words that ends in `words`, and the states for the words that follow."""
    crc, out, keep = zlib.crc32, array("I"), n - 1
    for w in words:
        tail = b" " + w
        states = [crc(w), *[crc(tail, s) for s in states[:keep]]]
        out.extend(states)
    return out, states


def buckets_of(raw: bytes | None, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end in them) for each piece of a text."""
    states: list[int] = []
    for words in word_lists(raw, WORD_BYTES):
        found, states = ring(words, n, states)
        yield len(words), np.frombuffer(found, np.uint32) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                for _, own in buckets_of(raw, n, buckets):
                    total += np.bincount(own, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, total in sums:
        out[bucket] = total
    return out


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    m, all_own, all_target = len(own), float(own.sum()), float(target.sum())
    pairs = zip(own.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_own + m) / ((s + 1.0) * (all_target + m)))) for s, t in pairs], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for i, raw in enumerate(raw_texts(batch.column(1))):
                for n_words, own in buckets_of(raw, n, len(gains)):
                    rows[i] += n_words, len(own), gains[own].sum()
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in rows.T)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of `docs`; rank is null where the row is not drawn."""
    gains = bucket_gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(docs, gains, n).withColumn("score", F.col("weight") + gumbel)
    in_draw = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = ranked.placed(scored.withColumn("candidate", in_draw), ["candidate"], order)
    drawn = F.col("candidate") & (F.col("_place") < F.expr(f"{percent} * _n div 100"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("_place") + 1).cast("long").alias("rank"))
