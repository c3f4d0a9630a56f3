"""op1_substring_dedup removes every later occurrence of a sentence, not only long runs of them."""

import re

import pytest

from amperline.llm import queries
from tests.llm import plain

SF = "/root/testdata/sf0.001"
NOTICE = "All rights reserved by the authors here."


def later_units(docs, min_unit=3):
    """doc_id -> (bytes of all later occurrences, whether each, its surrounding space apart, is one removed span or inside one)."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        at, found = 0, []
        for line in (t or "").encode().split(b"\n"):
            ends = [m.end() for m in re.finditer(rb"[.!?](?= )", line)] + [len(line)]
            for a, b in zip([0, *ends], ends):
                w = tuple(plain.plain_words(line[a:b].decode()))
                if len(w) >= min_unit:
                    if w in seen:
                        found.append((at + a, at + b))
                    seen.add(w)
            at += len(line) + 1
        out[d] = found
    return out


@pytest.fixture
def written(spark, tmp_path):
    rows = [(i, f"own words of document {i} and more\n{NOTICE}\nYes {i}!\n{NOTICE.upper()} Nothing else follows in number {i}") for i in range(1, 6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_short_line_between_own_lines_goes(spark, written):
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, written).collect()}
    for i in range(1, 6):
        first = f"{NOTICE}\n" if i == 1 else "\n"
        assert got[i].kept_text == f"own words of document {i} and more\n{first}Yes {i}!\n Nothing else follows in number {i}"
        assert got[i].n_spans == (1 if i == 1 else 2)


def test_every_later_occurrence_goes(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, short = later_units(docs), {d: n for d, n, _, _ in plain.cut_units(docs)}
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, SF).collect()}
    assert sum(map(len, want.values())) > 0 and any(short[d] < got[d].n_removed for d in short)
    for d, t in docs:
        spans = [(x.start, x.end) for x in got[d].spans]
        assert all(any(a <= s and e <= b for a, b in spans) for s, e in want[d])
        assert got[d].n_removed == sum(b - a for a, b in spans) and bool(spans) == bool(want[d])
        raw = (t or "").encode()
        # what goes besides the repeats are sentences too short for a digest, between repeats of a long run
        held = bytearray(len(raw))
        for s, e in want[d]:
            held[s:e] = b"\1" * (e - s)
        assert all(len(plain.plain_words(g)) < 20 for a, b in spans for g in bytes(c if not h else 10 for c, h in zip(raw[a:b], held[a:b])).decode("utf-8", "replace").split("\n"))


def test_text_that_occurs_once_stays(spark):
    """A unit with a digest between two repeats ends their run, whatever marks it holds."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda.", "one two three four five six seven eight nine ten eleven twelve."
    rows = [(1, f"{a} {b}"), (2, f"{a} one-off-fact. {b}"), (3, f"{a} x y. {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from amperline.llm import substring

    got = sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_text) for r in substring.dedup_substrings(docs).collect())
    assert got == plain.cut_units(rows)
    assert got[1][1] == 0 and got[2][1] == len(rows[2][1])


def test_rows_with_one_id_and_other_texts(spark):
    from amperline.llm import substring

    a, b = "alpha beta gamma delta epsilon zeta eta theta.", "one two three four five six seven eight."
    rows = [(1, a), (5, f"{a} own words here."), (5, f"{b} other words are here and all stay."), (None, b), (None, None)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), lone=True).collect()}
    assert got == {(1, len(a)): 0, (5, len(rows[1][1])): len(a), (5, len(rows[2][1])): len(b), (None, len(b)): 0, (None, 0): 0}
