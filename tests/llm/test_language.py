"""Language identification: spectra and kernel against plain sets, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from amperline.llm import language
from tests.llm.test_operators import SCHEMA, odd_texts


def plain_spectrum(text):
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    return {folded[i : i + n] for n in range(1, 5) for i in range(len(folded) - n + 1) if "  " not in folded[i : i + n] and folded[i : i + n] != " "}


@pytest.mark.parametrize("piece", [5, 1 << 19])
def test_spectra(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    texts = odd_texts()[:13] + ["ǅ İstanbul ß", "a1b2  c", "Straße.\n\nHaus"]
    sets = [plain_spectrum(t) for t in texts]
    found = language.spectra(texts)
    assert [len(x) for x in found] == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(sets[i] & sets[j])


def test_scores_are_the_kernel_regression(monkeypatch):
    """The product made once gives what kernels with each landmark give."""
    texts = ["the cat and the dog", "le chat et le chien", "cats and dogs there", "les chiens et les chats", "the end"]
    labels, found = ["en", "fr", "en", "fr", "en"], language.spectra(texts)
    model = language.regress(["en", "fr"], labels, found, 2, 1e-3)
    marks = [plain_spectrum(texts[i]) for i in (0, 2, 1, 3)]
    every = set().union(*marks)
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a & every)) * max(1, len(b & every)))
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    k = np.array([[kernel(plain_spectrum(t), b) for b in marks] for t in texts])
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors / np.sqrt(values)
    z, y = k @ root, np.array([[1.0, -1.0] if x == "en" else [-1.0, 1.0] for x in labels])
    want = z @ np.linalg.solve(z.T @ z + 1e-3 * 5 / 2 * np.eye(4), z.T @ y)
    has, letters = language.presence(texts, model.runs, model.maybe())
    got = has @ model.weights / np.sqrt(has.sum(1))[:, None]
    assert letters.all() and np.allclose(got, want, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)


def test_prediction_reads_only_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    plain = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    blind = {r.doc_id: r.lang_pred for r in language.predict(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source"), model).collect()}
    assert plain == blind


def test_odd_rows(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None, "clash", None, "k") for i, t in enumerate(odd_texts())]
    rows += [(None, "words", "fr", None, None, None, None, None), (7, "123 !!", "de", None, None, None, None, None)]
    out = language.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id not in (None, 7)}
    assert by[0].lang_pred == by[1].lang_pred == by[3].lang_pred == "und" and by[0].score == 0
    assert {r.lang_pred for r in out} == {"und", "en"}
    assert [r.held_out for r in out if r.doc_id is None] == [False]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert language.identify(none).collect() == []
    unlabelled = spark.createDataFrame([(1, "text", None, None, None, None, None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in language.identify(unlabelled).collect()] == [("und", 0.0)]


def test_bound_of_the_sample(spark):
    rows = [(i, f"the word number {i} here", "en") for i in range(300)] + [(1000 + i, f"le mot {i} ici", "fr") for i in range(50)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20, landmarks=5)
    assert model.languages == ["en", "fr"] and model.weights.shape == (len(model.runs), 2)
