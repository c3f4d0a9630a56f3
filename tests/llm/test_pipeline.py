"""Every stage of the pipeline against brute force, on odd rows, and the whole of it on a small table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from amperline.llm import decontam, quality
from tests.llm import plain
from tests.llm.test_operators import check_packing, odd_texts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, kept string, kept_text string, n_words string, row string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    rows = [(i * 3 - 4, t, "en", "kept", "clash", "n", None, 7) for i, t in enumerate(texts)]
    rows += [rows[13], (5, "another text of document five that nobody else has in this table", "en", "", "", "", "", 0), (None, texts[13], "en", "", "", "", "", 0), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_quality_stage(spark, odd):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (small, odd, odd.limit(0)):
        out = cp.quality_rules(spark, docs, SF)
        assert out.columns == docs.columns
        model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        kept = {(r.doc_id, r.text) for r in quality.score(docs.select("doc_id", "text"), model).where("kept").collect()}
        want = sorted((tuple(r) for r in docs.collect() if not plain.base_statistics(r.text)[5] and (r.doc_id, r.text) in kept), key=key)
        assert rows(out) == want


def test_line_stage(spark, odd):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd, odd.limit(0)):
        out = cp.line_dedup(spark, docs, SF)
        assert out.columns == docs.columns
        known = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
        new = {(d, t): k for (d, t), k in ((x, plain.cut_lines_of(known, x)) for x in set(known))}
        at, n = docs.columns.index("text"), docs.columns.index("n_chars")
        want = []
        for r in docs.collect():
            text = new.get((r.doc_id, r.text), r.text or "")
            own = list(r)
            own[at], own[n] = text, len(text)
            want.append(tuple(own))
        assert rows(out) == sorted(want, key=key)


def test_near_stage(spark, odd):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd, odd.limit(0)):
        out = cp.near_dedup(spark, docs, SF)
        assert out.columns == docs.columns
        all_rows = docs.collect()
        comp = plain.near_components([(r.doc_id, r.text) for r in all_rows if r.doc_id is not None], 5, 80)
        want, seen = [], set()
        for r in all_rows:
            if r.doc_id is None or (comp[r.doc_id][1] == r.doc_id and (r.doc_id, r.text or "") not in seen):
                seen.add((r.doc_id, r.text or ""))
                want.append((r.doc_id, r.text))
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(want, key=key)


def test_decontamination_stage(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.first().text
    docs = odd.unionByName(spark.createDataFrame([(5, "before " + item + " after", "en", "", "", "", "", 1), (None, item, "en", "", "", "", "", 1)], SCHEMA))
    out = cp.decontamination(spark, docs, SF)
    assert out.columns == docs.columns
    assert rows(out) == rows(odd)  # only the two rows that hold the item go, not the others with their doc_id
    assert decontam.contaminated(docs, bench).count() == 2
    assert cp.decontamination(spark, odd.limit(0), SF).count() == 0


def test_packing_stage(spark, odd):
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(cp.packed(spark, once, SF).collect(), [(r.doc_id, r.text) for r in once.collect()], 4096)
    assert cp.packed(spark, odd, SF).where("piece = 0").count() == odd.count()


def test_run(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = cp.run(spark, SF)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert ids < set(docs) and len(ids) > len(docs) // 3
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()
