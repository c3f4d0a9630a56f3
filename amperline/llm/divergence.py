"""How the sources of each language differ in the words they use, by joint count histograms.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case. A language keeps
the V terms that at least `min_docs` of its documents hold. A group (language, source), and a
language as a whole, gives a kept term with `count` occurrences the share
p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N being its occurrences of all kept terms; all
of it in whole numbers. Two sources differ by the sum over the kept terms of |p - q|.

* Tasks count the terms of their rows by group before anything travels; a task's tables are sent
  on and emptied at TABLE_TERMS entries.
* |p - q| depends on a term only through its two counts. For each pair of sources of a language
  the distinct pairs of counts are tallied with their multiplicity, and the difference is
  evaluated once for each. Kept terms are dealt to blocks by a hash, so that a block holds about
  PAIR_CELLS pairs of counts however many terms or sources a language has, and a block sends each
  of its pairs of counts once.
* Only counts that both sources have come from blocks. Cells where one or both counts are zero
  follow from each source's own histogram of counts: what a source has in all, less what it shares.

Defined cases: null text, language and source are ''; a language without kept terms has
differences of 0 between its sources and no terms; rows that share a doc_id are documents of
their own; an empty table gives no rows; columns other than text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperline.llm.store import save
from amperline.llm.words import keeping, raw_texts, word_lists

TABLE_TERMS = 400_000
PAIR_CELLS = 1 << 20
TERM_BYTES = keeping(b"abcdefghijklmnopqrstuvwxyz")
UNIT = 1_000_000_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in tables.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=names)
        tables.clear()

    for batch in batches:
        for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
            n, docs = tables[lang, source]
            before, own = len(n), set()
            for words in word_lists(raw, TERM_BYTES):
                n.update(words)
                own.update(words)
            docs.update(own)
            held += len(n) - before
            if held >= TABLE_TERMS:
                yield from sent()
                held = 0
    yield from sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that hold it."""
    seen = _groups(docs).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_cells(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, sources, leads) of the kept terms: occurrences in the group and the language, groups that hold the term, whether the group is the first of them."""
    w = Window.partitionBy("lang", "term")
    cells = term_counts(docs).select("lang", "source", "term", "n", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("in_docs"), F.count("*").over(w).alias("sources"), (F.col("source") == F.min("source").over(w)).alias("leads"))
    return cells.where(F.col("in_docs") >= min_docs).drop("in_docs")


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count, exact in decimals."""
    wide = (count + 5).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, F.nullif(n + 5 * v, F.lit(0)).cast("decimal(20,0)")) + 1


def totals(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, total, v, lang_total, pair_cells) of every group."""
    groups = _groups(docs).select("lang", "source").distinct()
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    lang = cells.groupBy("lang").agg(F.count_if("leads").alias("v"), F.sum("n").alias("lang_total"), F.sum("sources").alias("pair_cells"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "v", "lang_total", "pair_cells")}
    return groups.join(own, ["lang", "source"], "left").join(lang, ["lang"], "left").withColumns(zero)


def _tally(table: pa.Table) -> pa.Table:
    """(lang, a, b, count_a, count_b, n): the pairs of counts of each two sources a < b that share terms of one block."""
    names, source = np.unique(np.array(table["source"].to_pylist(), object), return_inverse=True)
    _, term = np.unique(np.array(table["term"].to_pylist(), object), return_inverse=True)
    values, count = np.unique(table["n"].to_numpy(), return_inverse=True)
    order = np.lexsort((source, term))
    term, source, count = term[order], source[order], count[order]
    last = np.searchsorted(term, term, side="right")  # of each cell's term
    by_source = np.argsort(source, kind="stable")
    cut = np.searchsorted(source[by_source], np.arange(len(names) + 1))
    found, k = [], len(values)
    for a in range(len(names)):
        at = by_source[cut[a] : cut[a + 1]]
        more = last[at] - at - 1  # cells of the same term with a later source
        mine = np.repeat(at, more)
        other = mine + 1 + np.arange(len(mine)) - np.repeat(np.cumsum(more) - more, more)
        key, n = np.unique((source[other].astype(np.int64) * k + count[mine]) * k + count[other], return_counts=True)
        found.append(np.stack([np.full(len(key), a), key // (k * k), key // k % k, key % k, n]))
    a, b, x, y, n = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    lang = table["lang"][0].as_py()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(names[a], pa.string()), "b": pa.array(names[b], pa.string()), "count_a": pa.array(values[x], pa.int64()), "count_b": pa.array(values[y], pa.int64()), "n": pa.array(n, pa.int64())})


def joint_histograms(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, count_a, count_b, n): for each two sources a < b of a language, how many of its kept terms have these counts; zeros included."""
    blocks = groups.select("lang", F.ceil(F.col("pair_cells") / PAIR_CELLS).alias("blocks")).distinct()
    dealt = cells.join(blocks, ["lang"]).withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    kind = "lang string, a string, b string, count_a long, count_b long, n long"
    both = dealt.select("lang", "block", "source", "term", "n").groupBy("lang", "block").applyInArrow(_tally, kind)
    both = save(both.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("n").alias("n")), "joint-counts")
    own = save(cells.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).withColumnRenamed("n", "count"), "own-counts")
    left, right = (groups.select("lang", F.col("source").alias(x), "v") for x in "ab")
    pairs = left.join(right.drop("v"), ["lang"]).where("a < b")
    zero, none = F.lit(0).cast("long"), -F.col("terms")
    of_a = own.withColumnRenamed("source", "a").join(pairs, ["lang", "a"])
    of_b = own.withColumnRenamed("source", "b").join(pairs, ["lang", "b"])
    parts = [
        both,
        # a term that one source has is in the cell of the other's zero, unless the other has it too
        of_a.select("lang", "a", "b", F.col("count").alias("count_a"), zero.alias("count_b"), F.col("terms").alias("n")),
        of_b.select("lang", "a", "b", zero.alias("count_a"), F.col("count").alias("count_b"), F.col("terms").alias("n")),
        both.groupBy("lang", "a", "b", "count_a").agg((-F.sum("n")).alias("n")).withColumn("count_b", zero),
        both.groupBy("lang", "a", "b", "count_b").agg((-F.sum("n")).alias("n")).withColumn("count_a", zero),
        # a term that neither has is in the cell of zeros
        pairs.select("lang", "a", "b", zero.alias("count_a"), zero.alias("count_b"), F.col("v").alias("n")),
        of_a.unionByName(of_b).groupBy("lang", "a", "b").agg(F.sum(none).alias("n")).withColumns({"count_a": zero, "count_b": zero}),
        both.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).withColumns({"count_a": zero, "count_b": zero}),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("n").alias("n"))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair`: every other source of the language; `term`: the `top` terms the source has more of than its language."""
    cells = save(kept_cells(docs, min_docs), "kept-cells")
    groups = save(totals(docs, cells), "group-totals")
    joint = joint_histograms(cells, groups)
    a, b = (groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}")) for x in "ab")
    shares = joint.join(a.join(groups.select("lang", "v").distinct(), ["lang"]), ["lang", "a"]).join(b, ["lang", "b"])
    f = F.abs(share(F.col("count_a"), F.col("total_a"), F.col("v")) - share(F.col("count_b"), F.col("total_b"), F.col("v")))
    sums = shares.groupBy("lang", "a", "b").agg(F.coalesce(F.sum(f * F.col("n")), F.lit(0)).cast("long").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = sums.select("lang", sides.alias("side"), "value").select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    with_totals = cells.join(groups, ["lang", "source"])
    more = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    term = with_totals.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).where("value > 0")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = [pair.withColumn("rank", F.row_number().over(w)), term.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1])

