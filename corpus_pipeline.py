"""A corpus pipeline: quality rules, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. Filtering stages return the columns of `documents`.

Defined cases, in every stage: a null text is an empty one (it fails the quality rules, and packs
as its end id); rows that share a doc_id but not their text are judged each by itself, but for
near copies, where they stay or go together; of rows that repeat in doc_id and text near dedup
keeps one; rows without a doc_id lose no lines and are nobody's copy; an empty table gives an
empty one; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amperline.llm import decontam, linededup, packing, quality, superminhash
from amperline.llm.store import discard, save

#: No SQL: tokenizers, trees and signatures are outside it; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def _own(docs: DataFrame) -> DataFrame:
    """doc_id and text, with all columns as `whole`, so that no name clashes with a stage's."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the trees keep."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(_own(docs), model).where("kept").select("whole.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another document keeps; n_chars follows the text."""
    bitmaps = save(linededup.keep_bitmaps(docs), "keep-bitmaps")
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return linededup.apply_bitmaps(_own(docs), bitmaps).select(*(new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    kept = superminhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    own = _own(docs).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    stay = own.join(kept.hint("merge"), F.col("doc_id") == F.col("kept_id"), "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("doc_id"))
    stay = stay.withColumn("copy", once).where("copy = 1").drop("copy")
    return stay.unionByName(own.where("doc_id IS NULL")).select("whole.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    hits = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = save(hits.select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row")).distinct(), "contaminated")
    own = _own(docs).withColumn("row", F.xxhash64("text"))
    return own.join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")), "left_anti").select("whole.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
