"""Language of texts by string kernels: blended spectra, Nyström landmarks, one-versus-rest kernel ridge regression.

* A text is read as letters in lower case and blanks for everything else. Its blended spectrum is
  the set of its runs of 1 to MAX_N code points that hold no two blanks in a row and are no lone blank. The kernel of two
  texts is the number of runs that both have, divided by the geometric mean of how many each has
  (runs that no landmark has are left out of all three).
* `per_language` texts of each language, those with the smallest hashes of their ids, are the
  training rows, and `landmarks` of them for each language the landmarks; both bounds are parameters. Tasks send
  their spectra, not their texts. Nyström features are the kernel's values with the landmarks times
  the inverse root of the landmarks' own kernel matrix; a ridge regression on them for each
  language against the rest gives weights of landmarks.
* Texts are scored in batches: a matrix of which runs a text has, times the matrix of the landmarks'
  runs, times the weights. The product of the latter two does not depend on the texts and is made once.

Defined cases: null texts and texts without a letter are `und` with score 0; a text that shares no
run with any landmark goes to the first language in order, with score 0; with no row to learn from, all texts are `und`
with score 0; with one language, all others are of that one; rows that share a doc_id are judged each by itself; a row without a doc_id is no
training row and not held out; an empty table gives no rows; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.llm.kernel import mix, u64

MAX_N = 4
PIECE = 1 << 19
_STEP = u64(0x9E3779B97F4A7C15)


@functools.cache
def _folded() -> np.ndarray:
    """For each code point that of its lower case, or a blank where it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each code point, folded code points) of texts put together in pieces of about PIECE; a long text's pieces overlap so that no run is lost."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            part = text[at : at + PIECE + MAX_N - 1]
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield _piece(rows, parts)
                rows, parts, size = [], [], 0
    if parts:
        yield _piece(rows, parts)


def _piece(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.repeat(np.array(rows), [len(p) for p in parts]), _folded()[codes]


def _runs(row: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, 64-bit hash) of the runs of each length."""
    wide = codes.astype(u64)
    h, blank = wide.copy(), codes == 32
    ok = ~blank  # runs so far that hold no two blanks in a row; a blank alone tells nothing
    yield row[ok], mix(h[ok] * _STEP + u64(1))
    ok = np.ones(len(codes), bool)
    for n in range(2, MAX_N + 1):
        if len(codes) < n:
            return
        m = len(codes) - n + 1
        h = h[:m] * _STEP + wide[n - 1 :]
        ok = ok[:m] & ~(blank[n - 2 : -1] & blank[n - 1 :]) & (row[:m] == row[n - 1 :])
        yield row[:m][ok], mix(h[ok] * _STEP + u64(n))


def spectra(texts: list[str | None]) -> list[np.ndarray]:
    """The set of each text's runs, as sorted hashes."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for row, codes in _pieces(texts):
        for own, h in _runs(row, codes):
            cut = np.searchsorted(own, np.arange(own[0], own[-1] + 2)) if len(own) else []
            for i in range(len(cut) - 1):
                found[own[0] + i].append(np.unique(h[cut[i] : cut[i + 1]]))
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, u64) for x in found]


@dataclass
class Model:
    """languages, the landmarks' runs (sorted hashes) and for each run the weight that it adds for each language."""

    languages: list[str]
    runs: np.ndarray
    weights: np.ndarray

    def maybe(self) -> np.ndarray:
        """Whether a hash with these low bits can be one of `runs`; a search confirms it."""
        out = np.zeros(1 << max(16, int(len(self.runs) * 8).bit_length()), bool)
        out[(self.runs & u64(len(out) - 1)).astype(np.int64)] = True
        return out


def presence(texts: list[str | None], runs: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, runs) of which run a text has, and whether it has letters."""
    has, letters = np.zeros((len(texts), len(runs)), bool), np.zeros(len(texts), bool)
    low = u64(len(maybe) - 1)
    for row, codes in _pieces(texts):
        letters[np.unique(row[codes != 32])] = True
        for own, h in _runs(row, codes):
            near = maybe[(h & low).astype(np.int64)]
            own, h = own[near], h[near]
            at = np.minimum(np.searchsorted(runs, h), len(runs) - 1)
            real = runs[at] == h
            has[own[real], at[real]] = True
    return has, letters


def _kernel(has: np.ndarray, marks: np.ndarray) -> np.ndarray:
    x, m = has.astype(np.float32), marks.astype(np.float32)
    return (x @ m.T) / np.sqrt(np.maximum(x.sum(1), 1)[:, None] * np.maximum(m.sum(1), 1)[None, :])


def regress(languages: list[str], labels: list[str], found: list[np.ndarray], landmarks: int, ridge: float) -> Model:
    """Weights from training rows: their labels and spectra."""
    order = [i for lang in languages for i in [k for k, x in enumerate(labels) if x == lang][:landmarks]]
    runs = np.unique(np.concatenate([found[i] for i in order]))
    has = np.zeros((len(found), len(runs)), bool)
    for i, own in enumerate(found):
        has[i] = np.isin(runs, own, assume_unique=True)
    marks = has[order]
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström: features = kernel with the landmarks @ root
    z = _kernel(has, marks).astype(np.float64) @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    alpha = root @ np.linalg.solve(z.T @ z + ridge * len(z) / len(languages) * np.eye(z.shape[1]), z.T @ y)
    scaled = marks.astype(np.float64) / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    return Model(languages, runs, (scaled.T @ alpha).astype(np.float32))


def held_out_rows(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = 200, landmarks: int = 48, ridge: float = 1e-3) -> Model | None:
    """A model from rows with a language and an id that are not held out: `per_language` of each language, the smallest hashes of their ids first."""
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out_rows(F.col("doc_id"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = docs.where(usable).select("lang", "doc_id", "text").withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_language)

    def spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.view(np.int64) for x in spectra(batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["lang", "place", "runs"])

    rows = chosen.select("lang", "place", "text").mapInArrow(spectrum, "lang string, place int, runs array<long>").where("size(runs) > 0").toArrow()
    order = sorted(range(len(rows)), key=lambda i: (rows["lang"][i].as_py(), rows["place"][i].as_py()))
    labels = [rows["lang"][i].as_py() for i in order]
    if not labels:
        return None
    found = [np.asarray(rows["runs"][i].values).view(u64) for i in order]
    return regress(sorted(set(labels)), labels, found, landmarks, ridge)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = model.maybe() if model else None
        rows_at_once = max(1, (1 << 24) // max(1, len(model.runs))) if model else 1
        for batch in batches:
            texts, names, scores = batch.column(1).to_pylist(), [], []
            for lo in range(0, len(texts), rows_at_once):
                part = texts[lo : lo + rows_at_once]
                if model is None:
                    names += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                has, letters = presence(part, model.runs, maybe)
                x = has.astype(np.float32)
                size = x.sum(1)
                f = x @ model.weights / np.sqrt(np.maximum(size, 1))[:, None]
                best = f.argmax(1)
                value = np.where(size > 0, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1), 0)
                best[size == 0] = 0
                names += [model.languages[b] if has_letter else "und" for b, has_letter in zip(best, letters, strict=True)]
                scores += np.where(letters, value, 0).tolist()
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", held_out_rows(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = 200, landmarks: int = 48) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): languages of all rows by a model of the rows that are not held out."""
    return predict(docs, fit(docs, per_language, landmarks))
