"""Substring dedup by unit hashing: lines cut into sentences, digests grouped over all documents.

1. Each line is cut after `.`, `!` or `?` before a space. A unit's digest is over its words in
   lower case without ASCII punctuation; units of fewer than `min_unit_words` words get none.
2. Digests are grouped globally with a partial aggregate; the earliest occurrence, ranked by
   (doc_id, hash of the row's text, unit), stays.
3. In each document, later occurrences that follow each other (only units without a digest stand
   between two of them, and go along) form a run; a run of at least `min_run_words` words is removed. With
   `lone`, of a shorter run each later occurrence is removed by itself, without what lies between,
   so that only the first of each group stays. The original byte offsets of what is removed stay
   with the document.

Defined cases: null text is empty; units that repeat inside a document count like those between
documents; rows that share a doc_id but not their text are ranked by a hash of the text and lose
only their own repeats; rows with the same doc_id and text are not told apart, so both keep the
first occurrence; rows without a doc_id rank first and lose nothing; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperline.llm.kernel import chunks, mix, powers, u64
from amperline.llm.quality import plain_word_hashes_at
from amperline.llm.store import save

_UNITS = "doc_id long, row long, d1 long, d2 long, unit int, start int, end int, n_words int"


def unit_bounds(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each sentence inside each line."""
    ls, le, ld = t.line_bounds()
    stop = np.zeros(len(t.buf), bool)
    stop[:-1] = ((t.buf[:-1] == 46) | (t.buf[:-1] == 33) | (t.buf[:-1] == 63)) & (t.buf[1:] == 32)
    cut = np.flatnonzero(stop) + 1
    # a cut belongs to the line that holds it; documents' borders are line borders too
    line = np.searchsorted(ls, cut, side="right") - 1
    inside = cut < le[line]
    cut, line = cut[inside], line[inside]
    start, doc = np.concatenate([ls, cut]), np.concatenate([ld, ld[line]])
    end_of = np.concatenate([le, le[line]])
    order = np.lexsort((start, doc))
    start, doc, end_of = start[order], doc[order], end_of[order]
    end = end_of.copy()
    same_line = (doc[1:] == doc[:-1]) & (start[1:] <= end_of[:-1]) & (end_of[1:] == end_of[:-1])
    end[:-1][same_line] = start[1:][same_line]
    return start, end, doc


def unit_digests(docs: DataFrame, min_unit_words: int) -> DataFrame:
    """Units with a digest; `unit` numbers them within their row, so neighbours have only undigested text between them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column(0), batch.column(1)
            for lo, _, t in chunks(batch.column(2)):
                words, at = plain_word_hashes_at(t)
                start, end, doc = unit_bounds(t)
                up, down = powers(len(words) + 1)
                a, b = np.searchsorted(at, start), np.searchsorted(at, end)
                ok = b - a >= min_unit_words
                start, end, doc, a, b = (x[ok] for x in (start, end, doc, a, b))
                d = []
                for w in (words, mix(words + u64(1))):
                    p = np.zeros(len(words) + 1, u64)
                    np.cumsum(w * up[:-1], out=p[1:])
                    d.append(mix((p[b] - p[a]) * down[a] + (b - a).astype(u64)))
                unit = np.arange(len(doc)) - np.searchsorted(doc, doc)
                place = pa.array(lo + doc)
                own = [d[0].view(np.int64), d[1].view(np.int64), *(x.astype(np.int32) for x in (unit, start - t.off[doc], end - t.off[doc], b - a))]
                yield pa.record_batch([ids.take(place), row.take(place), *map(pa.array, own)], names=["doc_id", "row", "d1", "d2", "unit", "start", "end", "n_words"])

    return docs.select("doc_id", "row", "text").mapInArrow(digest, _UNITS)


def repeated_units(docs: DataFrame, min_unit_words: int = 3) -> DataFrame:
    """(doc_id, row, repeats): for rows with units seen before, these (unit, start, end, n_words) in order."""
    units = save(unit_digests(docs, min_unit_words), "units")
    rank = F.struct("doc_id", "row", "unit")
    first = units.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first")
    later = units.join(first, ["d1", "d2"]).where(rank != F.col("first"))
    item = F.struct("unit", "start", "end", "n_words")
    return later.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(item)).alias("repeats"))


def removal_runs(repeats: list[dict], min_run_words: int, lone: bool = False) -> list[tuple[int, int]]:
    """[start, end) of runs of neighbouring repeats (unit numbers that follow each other) with enough words; with `lone` also of each repeat of the others."""
    runs, at = [], 0
    while at < len(repeats):
        k, words = at, repeats[at]["n_words"]
        while k + 1 < len(repeats) and repeats[k + 1]["unit"] - repeats[k]["unit"] <= 1:
            k += 1
            words += repeats[k]["n_words"]
        if words >= min_run_words:
            runs.append((repeats[at]["start"], repeats[k]["end"]))
        elif lone:
            for x in repeats[at : k + 1]:
                if runs and runs[-1][1] == x["start"]:
                    runs[-1] = (runs[-1][0], x["end"])
                else:
                    runs.append((x["start"], x["end"]))
        at = k + 1
    return runs


def dedup_substrings(docs: DataFrame, min_unit_words: int = 3, min_run_words: int = 20, lone: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_text) per row; spans: removed byte ranges of the original text."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    repeats = save(repeated_units(docs, min_unit_words), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": batch.column(0).to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept_text": []}
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                raw, found = text.as_py() or b"", found.as_py() or []
                runs = removal_runs(found, min_run_words, lone)
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(b - a for a, b in runs))
                out["n_spans"].append(len(runs))
                out["spans"].append([{"start": a, "end": b} for a, b in runs])
                out["kept_text"].append(b"".join(kept).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", span), ("kept_text", pa.string())])
    return docs.join(repeats.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "repeats").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_text string")
