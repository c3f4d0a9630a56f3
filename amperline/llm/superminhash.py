"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find by label passing.

A document's set holds the hashes of its distinct word n-grams (A-Z in lower case). SuperMinHash
gives each element a random permutation of the m signature places and writes rank + fraction at
its j-th place, so places of one element exclude each other and estimates vary less than with m
independent hashes. Step j runs for the elements of all documents at once and a document stops
as soon as all its places are filled, which long documents reach after two or three steps.

1. Documents with equal sets are one class from then on. Classes that share a band meet in a bucket.
2. Every member of a bucket is verified against its smallest member, on full sets; the links give
   components. This is one row a member, and joins nearly all near copies.
3. Buckets whose members are still of several components are compared inside: members outside the
   bucket's largest component with all others. A crowded bucket is split into units of about UNIT
   members; such a member visits every unit, the others live in one. Pairs are formed and dropped
   inside a task (components, sizes, sketches, then full sets; in the first band they share only)
   and a unit returns at most one link for each two components it joins, so what leaves a task
   is linear in the members even where a template's documents are all unlike.

No link inside a bucket is lost but by a sketch 3.5 standard deviations too low; bands of 5 rows,
32 of them, leave a pair at 0.8 without a common bucket with probability 3e-6.

Defined cases: null or empty text, or text without words, has an empty set and no link; with
fewer words than n the whole sequence is the one element; rows with the same doc_id are one
document whose texts all count (their links unite); rows without a doc_id are linked with nothing
and kept; an empty table gives no rows; other columns are not read. Sets are compared by the high
48 bits of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperline.llm.encoder import forget
from amperline.llm.kernel import Text, blobs, chunks, mix, ngram_hashes, rows_of_counts, u64
from amperline.llm.store import discard, save

BANDS, ROWS = 32, 5
SET_BYTES = 6
UNIT, PART_BYTES = 512, 16 << 20
_PERMUTATION_BYTES = 1 << 24


def shingle_sets(t: Text, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each document's distinct shingles, sorted by document and hash."""
    t = t.lower_ascii()
    start, end = t.word_bounds()
    doc = t.doc_of(start)
    words = t.hashes(start, end)
    at, h = ngram_hashes(words, doc, n)
    d = doc[at]
    n_words = np.bincount(doc, minlength=t.n)
    first = np.searchsorted(doc, np.arange(t.n))
    for i in np.flatnonzero((n_words > 0) & (n_words < n)):  # short documents: one element
        own = words[first[i] : first[i] + n_words[i]]
        key = np.full(1, n_words[i], u64)
        for w in own:
            key = key * u64(0xD1342543DE82EF95) + w
        h, d = np.append(h, mix(key)), np.append(d, i)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def superminhash(h: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs, m); a value's top byte is the rank j, the rest the fraction."""
    sig = np.full(n_docs * m, np.iinfo(np.uint64).max, u64)
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    lo, most = 0, _PERMUTATION_BYTES // m
    while lo < n_docs:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, side="right")) - 1)
        _fill(h[bounds[lo] : bounds[hi]], doc[bounds[lo] : bounds[hi]], sig, m)
        lo = hi
    return sig.reshape(n_docs, m)


def _fill(h: np.ndarray, doc: np.ndarray, sig: np.ndarray, m: int) -> None:
    place = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
    live, grid = np.arange(len(h)), sig.reshape(-1, m)
    docs = np.unique(doc)
    for j in range(m):
        x = mix(h[live] + u64((j + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        k = j + ((x & u64(0xFFFFFFFF)) * u64(m - j) >> u64(32)).astype(np.int64)
        p = place[live, k]
        place[live, k] = place[live, j]
        np.minimum.at(sig, doc[live] * m + p, (x >> u64(8)) | u64(j << 56))
        # places that an element of rank j or less has reached stay as they are
        docs = docs[(grid[docs] >> u64(56) > u64(j)).any(axis=1)]
        if not len(docs):
            return
        still = np.zeros(docs[-1] + 1, bool)
        still[docs] = True
        live = live[(doc[live] <= docs[-1])]
        live = live[still[doc[live]]]


def signatures(docs: DataFrame, n: int, bands: int = BANDS, rows: int = ROWS, full: bool = False) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands) per row: set size, 128-bit digest of the set, band keys (null for an empty set).

    With `full` also `sketch`, the low byte of each signature value, and `set`, the sorted shingle hashes.
    """
    m = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo, hi, t in chunks(batch.column(1)):
                h, d = shingle_sets(t, n)
                sizes = np.bincount(d, minlength=t.n)
                some = np.flatnonzero(sizes)
                sums = np.zeros((2, t.n), u64)
                if len(some):
                    at = np.searchsorted(d, some)
                    for i in range(2):
                        sums[i, some] = np.add.reduceat(mix(h + u64(i + 1)), at)
                flat = superminhash(h, d, t.n, m)
                sig = flat.reshape(t.n, bands, rows)
                key = np.zeros((t.n, bands), u64) + np.arange(1, bands + 1, dtype=u64)
                for r in range(rows):
                    key = mix(key * u64(0xD1342543DE82EF95) + sig[:, :, r])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (t.n + 1) * bands, bands), pa.int32()), pa.array(key.view(np.int64).ravel()), mask=pa.array(sizes == 0))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), lists]
                if full:
                    columns += [blobs(flat.astype(np.uint8).ravel(), np.arange(0, (t.n + 1) * m, m)), blobs(_packed(h).ravel(), SET_BYTES * rows_of_counts(d, t.n))]
                yield pa.record_batch(columns, names=names)

    names = ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch", "set"][: 7 if full else 5]
    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>" + ", sketch binary, set binary" * full)


def _packed(h: np.ndarray) -> np.ndarray:
    """The high SET_BYTES bytes of sorted hashes, which keep their order."""
    return (h >> u64(64 - 8 * SET_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]


def _unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").ravel()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the Jaccard similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs: one merge
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of `pairs` whose sets reach the Jaccard similarity, by their full sets."""
    sets = sets.select("doc_id", "set")
    sides = pairs.join(sets.withColumnsRenamed({"doc_id": "b", "set": "set_b"}), "b").join(sets.withColumnsRenamed({"doc_id": "a", "set": "set_a"}), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(*(_unpacked(batch.column(c)[i].as_buffer()) for c in (2, 3)), percent) for i in range(batch.num_rows)]
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return sides.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def unit_links(key: int, doc, comp, resident, loose, sketch, bands, sets, percent: int) -> list[tuple[int, int]]:
    """Links between components among one unit's members, at most one for each two that they join.

    A pair is compared if its components differ, one of the two lives in this unit and `key` is the
    first band that they share, so no pair is compared twice. Sketches far under the similarity
    (3.5 standard deviations) end it; full sets decide.
    """
    m = sketch.shape[1]
    p = percent / 100
    least = m * (p - 3.5 * (p * (1 - p) / m) ** 0.5)
    label = np.unique(comp, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    out = []
    place = np.arange(len(doc))
    for i in np.flatnonzero(loose).tolist():
        near = (label != label[i]) & (resident | resident[i]) & (~loose | (place > i))
        near &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
        at = np.flatnonzero(near)
        score = (sketch[at] == sketch[i]).sum(axis=1)
        at, score = at[score >= least], score[score >= least]
        if not len(at):
            continue
        first = bands[i][(bands[at] == bands[i]).argmax(axis=1)] == key
        at = at[first][np.argsort(-score[first], kind="stable")]
        for j in at.tolist():
            if label[j] != label[i] and _similar(sets[i], sets[j], percent):
                out.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
                label[label == label[j]] = label[i]
    return out


def bucket_links(bucket: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components inside the buckets."""
    rows = bucket.select("key", "doc", "n_shingles").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    rows = save(rows.select("key", "doc", "n_shingles", F.coalesce("comp", "doc").alias("comp")), "bucket-labels")
    parts = rows.groupBy("key", "comp").count().groupBy("key")
    mixed = parts.agg(F.max_by("comp", F.struct("count", "comp")).alias("top"), F.sum("count").alias("n"), F.count("*").alias("k")).where("k > 1").select("key", "top", "n")
    units, loose = F.ceil(F.col("n") / UNIT).cast("int"), F.col("comp") != F.col("top")
    home = F.pmod(F.xxhash64("doc"), F.col("units")).cast("int")
    placed = rows.join(mixed, "key").select("key", "doc", "n_shingles", "comp", units.alias("units"), loose.alias("loose"))
    placed = placed.withColumn("home", home).withColumn("unit", F.explode(F.when(F.col("loose"), F.sequence(F.lit(0), F.col("units") - 1)).otherwise(F.array("home"))))
    placed = save(placed.select("key", "unit", "doc", "n_shingles", "comp", "loose", (F.col("unit") == F.col("home")).alias("resident")), "units")
    size = placed.agg(F.sum(F.col("n_shingles") * SET_BYTES + 600)).first()[0] or 0
    part = F.pmod(F.xxhash64("key", "unit"), F.lit(max(64, -(-size // PART_BYTES)))).cast("int")

    def compare(key, table):
        table = table.sort_by([("key", "ascending"), ("unit", "ascending"), ("doc", "ascending")])
        number = {c: table[c].to_numpy() for c in ("key", "unit", "doc", "comp")}
        flag = {c: table[c].to_numpy(zero_copy_only=False) for c in ("loose", "resident")}
        turn = (number["key"][1:] != number["key"][:-1]) | (number["unit"][1:] != number["unit"][:-1])
        cut = [0, *(np.flatnonzero(turn) + 1).tolist(), len(table)]
        out = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = table.slice(lo, hi - lo)
            sketch = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in own["sketch"]])
            bands = own["bands"].combine_chunks().flatten().to_numpy().reshape(hi - lo, -1)
            sets = [_unpacked(x.as_buffer()) for x in own["set"]]
            out += unit_links(number["key"][lo], number["doc"][lo:hi], number["comp"][lo:hi], flag["resident"][lo:hi], flag["loose"][lo:hi], sketch, bands, sets, percent)
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    whole = placed.withColumn("part", part).join(sets.select(F.col("doc_id").alias("doc"), "bands", "sketch", "set"), "doc").drop("n_shingles")
    found = save(whole.groupBy("part").applyInArrow(compare, "a long, b long"), "bucket-links")
    discard(rows, placed)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for each node of the links (a, b)."""
    ends = save(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct(), "ends", tidy=False)
    labels = save(ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels", tidy=False)
    while True:
        near = ends.join(labels, ends.v == labels.node).groupBy("u").agg(F.min("comp").alias("m"))
        lower = save(labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "lower", tidy=False)
        jump = lower.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        new = save(lower.join(jump, lower.comp == jump.via).select("node", F.least("comp", "far").alias("comp"), (F.least("comp", "far") != F.col("old")).alias("moved")), "labels", tidy=False)
        discard(labels, lower)
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            discard(ends)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: components of the components that the links join."""
    of_a, of_b = (labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
    tops = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    tops = components(save(tops.distinct(), "joined", tidy=False))
    moved = labels.join(tops.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return save(moved.unionByName(tops.join(labels, "node", "left_anti")), "components", tidy=False)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; kept: the smallest doc_id of its component."""
    docs = docs.select("doc_id", "text")
    signed = save(signatures(docs, n, bands, rows), "signatures")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = save(classes, "classes")

    member = classes.select(F.col("rep").alias("doc"), "n_shingles", F.explode("bands").alias("key"))
    # members of a bucket of one never meet anyone
    shared = member.groupBy("key").agg(F.min(F.struct("doc", "n_shingles")).alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    bucket = save(member.join(shared, "key"), "buckets")

    wanted = bucket.select(F.col("doc").alias("doc_id")).distinct()
    sets = save(signatures(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), n, bands, rows, full=True).where("n_shingles > 0"), "sets")

    na, nb = F.col("least.n_shingles"), F.col("n_shingles")
    star = bucket.where((F.col("doc") != F.col("least.doc")) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb)))
    links = verified(star.select(F.col("least.doc").alias("a"), F.col("doc").alias("b")).distinct(), sets, percent)
    # rows with one doc_id are one document: the classes of their texts are joined
    reps = some.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.collect_set("rep").alias("b"))
    same = reps.where("a != z").select("a", F.explode("b").alias("b")).where("a != b")
    labels = components(links.unionByName(same))
    found = bucket_links(bucket, labels, sets, percent)
    if not found.isEmpty():
        labels = joined(labels, found)
    discard(bucket, sets, found)

    out = signed.drop("bands").join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "rep", "doc_id")).otherwise(F.col("doc_id"))
    comp = F.when(F.col("doc_id").isNotNull(), comp)
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))
