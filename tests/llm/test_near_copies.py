"""op2 on groups that LSH puts into one bucket: linked and not, split into units, and rows that share a doc_id."""

import random

from amperline.llm import superminhash
from tests.llm import plain

SCHEMA = "doc_id long, text string"


def found(spark, rows, n=2):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), n=n).collect()}


def template(r, number, words, changed):
    base = [f"t{i}" for i in range(words)]
    out = []
    for i in range(number):
        w = list(base)
        for at in r.sample(range(words), changed):
            w[at] = f"x{i}_{at}"
        out.append(" ".join(w))
    return out


def test_template_without_links(spark, monkeypatch):
    """Documents of one template, alike at about 0.6: all in common buckets, none linked."""
    monkeypatch.setattr(superminhash, "UNIT", 64)
    rows = list(enumerate(template(random.Random(1), 300, 100, 13)))
    assert found(spark, rows) == plain.near_components(rows, 2, 80)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "UNIT", 50)
    r = random.Random(2)
    rows = list(enumerate(template(r, 200, 100, 4) + template(r, 100, 90, 7)))
    assert found(spark, rows) == plain.near_components(rows, 2, 80)


def test_chains(spark):
    """Each text is near its neighbour only."""
    w = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join(w[k * 8 : k * 8 + 120])) for k in range(10)]
    assert found(spark, rows) == plain.near_components(rows, 2, 80)


def test_rows_with_one_id_and_other_texts(spark):
    a, b, c = ("a b c d e f g h", "p q r s t u v w", "k l m n o")
    rows = [(1, a), (2, b), (5, a), (5, b), (7, c), (8, c), (8, "nothing like it here")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), n=2).collect())
    assert got == [(1, 1, True), (2, 1, False), (5, 1, False), (5, 1, False), (7, 7, True), (8, 7, False), (8, 7, False)]


def test_rows_without_id(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (4, "a b c d")]
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), n=2).collect())
    assert got == [(0, None, True), (0, None, True), (3, 3, True), (4, 3, False)]
