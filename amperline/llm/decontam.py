"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact check.

Texts are words in lower case without ASCII punctuation; the distance is the edit distance in
words, and a document is contaminated by an item of n words if some window of it lies within
k = n * (100 - percent) // 100 edits.

* CGK: a random walk reads a text; at each step it gives the word it stands on and moves on if a
  random bit of (walk, step, word) is set. Edit distance becomes Hamming distance: walks over two
  similar texts come together again after an edit. An item-sized window is embedded by WALKS walks
  from each of its words, STEPS steps each.
* LSH: a table samples a few steps of one walk. An item's index has the sampled words of each
  table from each of its words; longer items sample more (`TABLES`), so that a sample is as rare
  as the length allows. Samples that stand on one word twice or beyond the item's end are left out.
* Search: each word of a document starts the same walks. What two bitmaps of the index do not
  rule out joins the index by its sample. A hit places an item-sized window; windows that at least
  `need` samples place within SPREAD words of each other are candidates.
* Candidates are verified by the edit distance itself (best match inside the window's surroundings),
  which also gives the place.

The index is a table and the join is Spark's: items of any number take one pass to search and one
to verify, and only the bitmaps, at most MAX_BITS bits, go to all tasks. Beyond that many samples they rule out less and more
rows reach the join; none are lost.

`tests/llm/test_decontamination.py` holds the search against a search that loses nothing: of
windows with as many edits as allowed, evenly spread or at random, at least 0.98 are found for
each length; those with fewer edits are found more often.

Defined cases: null or empty texts match nothing, nor do items without words; items of fewer than
5 words have no edits to spare and are matched whole; repeated items or documents are reported
each; an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperline.llm.kernel import chunks, mix, u64
from amperline.llm.quality import plain_word_hashes_at
from amperline.llm.store import save

WALKS, STEPS = 4, 10
#: Items of at least so many words: (steps to sample from, samples, tables a walk).
TABLES = {16: (10, 4, 6), 8: (8, 3, 4), 5: (6, 2, 4)}
#: Words that one array of walks starts from.
SEGMENT = 1 << 17
SPREAD = 32
NEED = 2
MAX_BITS = 1 << 27
_FIRST_BITS = 22
_SCHEMA = "doc_id long, item_id long, n_words int, distance int, start long, end long, row long"
_DRAWN = np.random.default_rng(20)
#: Odd multipliers: the top bit of word * move is the step's random bit; give and wide make a sample's key of its words.
_MOVE, _GIVE = (_DRAWN.integers(0, 1 << 32, (WALKS, STEPS), dtype=u64).astype(np.uint32) | np.uint32(1) for _ in range(2))
_WIDE = _DRAWN.integers(0, 1 << 63, (WALKS, STEPS), dtype=u64) * u64(2) + u64(1)


def _samples(least: int) -> list[tuple[int, tuple[int, ...]]]:
    """(walk, steps) of the tables of a class of items."""
    steps, size, tables = TABLES[least]
    draw = np.random.default_rng(least)
    out = []
    for walk in range(WALKS):
        own: set[tuple[int, ...]] = set()
        while len(own) < tables:
            own.add(tuple(sorted(map(int, draw.choice(steps, size, replace=False)))))
        out += [(walk, s) for s in sorted(own)]
    return out


_TABLES_OF = {least: _samples(least) for least in TABLES}


def walks(words: np.ndarray, starts: np.ndarray, used: set[int]) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(walk, places, their words in 32 bits) at each step of the walks from `starts`; `words` end with STEPS words that stand for none."""
    short = (words >> u64(32)).astype(np.uint32)
    for walk in sorted(used):
        at, places, given = starts.astype(np.int32), [], []
        for step in range(STEPS):
            w = short[at]
            places.append(at)
            given.append(w)
            at = at + ((w * _MOVE[walk, step]) >> np.uint32(31)).astype(np.int32)
        yield walk, places, given


def short_keys(walk: int, given: list[np.ndarray]) -> list[np.ndarray]:
    """For each step, what its word adds to the 32-bit key of a sample."""
    return [g * m for g, m in zip(given, _GIVE[walk], strict=True)]


def wide_keys(words: np.ndarray, walk: int, steps: tuple[int, ...], places: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The 64-bit keys of a sample for some rows of the walks."""
    key = np.full(len(rows), len(steps) + 16 * walk, u64)
    for s in steps:
        key = key + words[places[s][rows]] * _WIDE[walk, s]
    return mix(key)


def _class_of(n: int) -> int:
    return next((least for least in TABLES if n >= least), n)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    g = np.full(max(0, len(words) - size + 1), size, u64)
    for j in range(size):
        g = g * u64(0xD1342543DE82EF95) + words[j : j + len(g)]
    return mix(g)


def item_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit key, 32-bit key, word that the walk starts from) of an item's samples."""
    n, least = len(words), _class_of(len(words))
    if n < 5:
        key = grams(words, n)
        return key, (key >> u64(32)).astype(np.uint32), np.zeros(len(key), np.int64)
    padded = np.concatenate([words, np.zeros(STEPS, u64)])
    key, short, start = [], [], []
    for walk, places, given in walks(padded, np.arange(n), {w for w, _ in _TABLES_OF[least]}):
        adds = short_keys(walk, given)
        for own, steps in _TABLES_OF[least]:
            if own == walk:
                at = np.stack([places[s] for s in steps])
                good = np.flatnonzero((np.diff(at, axis=0) > 0).all(0) & (at[-1] < n))
                key.append(wide_keys(padded, walk, steps, places, good))
                short.append(sum(adds[s][good] for s in steps[1:]) + adds[steps[0]][good])
                start.append(good)
    return np.concatenate(key), np.concatenate(short), np.concatenate(start)


def index_items(items: DataFrame) -> DataFrame:
    """(key, short, item_row, n_words, start, class) of every sample of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "short", "item_row", "n_words", "start", "class"]
        for batch in batches:
            for lo, hi, t in chunks(batch.column(0)):
                words, at = plain_word_hashes_at(t)
                cut = np.searchsorted(at, t.off)
                for i in range(hi - lo):
                    own = words[cut[i] : cut[i + 1]]
                    if len(own) == 0:
                        continue
                    key, short, start = item_keys(own)
                    same = [np.full(len(key), x, np.int64) for x in (batch.column(1)[lo + i].as_py(), len(own), _class_of(len(own)))]
                    columns = [key.view(np.int64), short.astype(np.int64), same[0], same[1], start, same[2]]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    return items.select("text", "item_row").mapInArrow(run, "key long, short long, item_row long, n_words long, start long, class long")


def _bitmap(index: DataFrame, bit, bits: int) -> np.ndarray:
    """A bit for each value of the column `bit`, made in slices of 2**16 bytes by the tasks and put together here; `bits` bounds its size."""
    slice_bits = min(bits, 1 << 19)

    def run(table: pa.Table) -> pa.Table:
        at = table["at"].to_numpy()
        own = np.zeros(slice_bits, np.uint8)
        own[at % slice_bits] = 1
        return pa.table({"part": pa.array([int(at[0]) // slice_bits], pa.int64()), "own": pa.array([np.packbits(own).tobytes()], pa.binary())})

    at = index.select(bit.alias("at")).distinct().withColumn("part", F.floor(F.col("at") / slice_bits))
    out = np.zeros(bits // 8, np.uint8)
    for r in at.groupBy("part").applyInArrow(run, "part long, own binary").collect():
        out[r.part * slice_bits // 8 :][: slice_bits // 8] = np.frombuffer(r.own, np.uint8)
    return out


class Filter:
    """What of a document can be in the index: two bitmaps, by the 32-bit and by the 64-bit keys."""

    def __init__(self, index: DataFrame):
        n, kinds = index.agg(F.count("*"), F.collect_set("class")).first()
        self.classes = sorted(kinds)
        wanted = 1 << max(20, (64 * max(n, 1)).bit_length())
        self.bits = min(MAX_BITS, wanted)
        self.first = _bitmap(index, F.shiftrightunsigned("short", 32 - _FIRST_BITS), 1 << _FIRST_BITS)
        self.second = _bitmap(index, F.col("key").bitwiseAND(self.bits - 1), self.bits)

    def known(self, key: np.ndarray) -> np.ndarray:
        at = (key & u64(self.bits - 1)).astype(np.int64)
        return (self.second[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _search(words: np.ndarray, own: Filter, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, word that the walk starts from) of the samples that the bitmaps let through; `first`: the first bitmap, a byte a bit."""
    keys, starts = [], []
    padded = np.concatenate([words, np.zeros(STEPS, u64)])
    tables = [x for c in own.classes if c in TABLES for x in _TABLES_OF[c]]
    shift = np.uint32(32 - _FIRST_BITS)
    for lo in range(0, len(words) if tables else 0, SEGMENT):
        part = padded[lo : lo + SEGMENT + STEPS]
        for walk, places, given in walks(part, np.arange(len(part) - STEPS), {w for w, _ in tables}):
            adds = short_keys(walk, given)
            for w, steps in tables:
                if w == walk:
                    short = adds[steps[0]] + adds[steps[1]]
                    for s in steps[2:]:
                        short += adds[s]
                    near = np.flatnonzero(first[short >> shift])
                    key = wide_keys(part, walk, steps, places, near)
                    real = own.known(key)
                    keys.append(key[real])
                    starts.append(near[real] + lo)
    for size in (c for c in own.classes if c < 5):
        key = grams(words, size)
        real = np.flatnonzero(own.known(key))
        keys.append(key[real])
        starts.append(real)
    return (np.concatenate(keys), np.concatenate(starts)) if keys else (np.zeros(0, u64), np.zeros(0, np.int64))


def _hits(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, row, item_row, n_words, at): windows that a sample places, by their first word in the document."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        first = np.unpackbits(own.first).astype(bool)
        for batch in batches:
            for lo, _, t in chunks(batch.column(1)):
                words, at = plain_word_hashes_at(t)
                key, start = _search(words, own, first)
                if not len(key):
                    continue
                doc = t.doc_of(at[start])
                place = start - np.searchsorted(at, t.off)[doc]
                tiny = place * 0
                if any(c < 5 for c in own.classes):  # one place of a whole item says all
                    order = np.lexsort((place, key, doc))
                    doc, key, place = doc[order], key[order], place[order]
                    tiny = np.concatenate([[0], (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])]).astype(np.int64)
                rows = pa.array(doc + lo)
                columns = [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(key.view(np.int64)), pa.array(place, pa.int64()), pa.array(tiny, pa.int64())]
                yield pa.record_batch(columns, names=["doc_id", "row", "key", "place", "again"])

    found = docs.select("doc_id", "text", "row").mapInArrow(run, "doc_id long, row long, key long, place long, again long")
    return found.join(index.drop("short"), ["key"]).where("class >= 5 OR again = 0").select("doc_id", "row", "item_row", "n_words", (F.col("place") - F.col("start")).alias("at"))


def candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, row, item_row, lo, hi): where windows of an item that enough samples place begin."""
    half = SPREAD // 2
    both = F.explode(F.array(F.floor(F.col("at") / SPREAD) * 2, F.floor((F.col("at") + half) / SPREAD) * 2 + 1))
    near = _hits(docs, index).withColumn("near", both).groupBy("doc_id", "row", "item_row", "near").agg(F.count("*").alias("n"), F.max("n_words").alias("n_words"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    return near.where((F.col("n") >= NEED) | (F.col("n_words") < 5)).select("doc_id", "row", "item_row", "lo", "hi")


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the substring of `text` nearest to `item`, in words."""
    end_row = _edit_row(item, text, free_start=True)
    end = int(end_row.argmin())
    start_row = _edit_row(item[::-1], text[:end][::-1], free_start=False)
    return int(end_row[end]), end - int(start_row.argmin()), end


def _edit_row(item: np.ndarray, text: np.ndarray, free_start: bool) -> np.ndarray:
    """Last row of the edit table: distance of the item to what ends at each place of the text."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64) if free_start else place.copy()
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    return row


def _verified(words: np.ndarray, item: np.ndarray, k: int, spans: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """The nearest match (distance, first word, word after the last) of at most k edits in the surroundings of the spans."""
    best, n, reach = None, len(item), -1
    for lo, hi in sorted(spans):
        a, b = max(0, lo - k), min(len(words), hi + n + k)
        a = max(a, reach - n - k) if reach >= 0 else a  # what an earlier span has covered is not looked at again
        reach = max(reach, b)
        near = words[a:b]
        if len(near) and np.isin(item, near).sum() >= n - k:
            distance, first, last = best_match(item, near)
            if distance <= k and (best is None or (distance, a + first) < best[:2]):
                best = (distance, a + first, a + last)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_words, distance, start, end, row): the best window of each contaminated pair, in bytes of the text; row: hash of the text."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    items = benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("item_row")).groupBy("item_id", "text", "item_row").agg(F.count("*").cast("int").alias("copies"))
    found = save(candidates(docs, save(index_items(items), "item-samples")), "candidate-windows")
    spans = found.groupBy("doc_id", "row", "item_row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    texts = items.select("item_row", F.col("item_id").alias("of_item"), F.col("text").alias("item_text"), "copies")
    of_doc = spans.join(texts, ["item_row"]).groupBy(F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row")).agg(F.collect_list(F.struct("of_item", "item_text", "copies", "spans")).alias("windows"))
    own = docs.join(of_doc, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row") == F.col("of_row"))).select("doc_id", "text", "row", "windows")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "n_words", "distance", "start", "end", "row"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for lo, hi, t in chunks(batch.column(1)):
                words, at = plain_word_hashes_at(t)
                cut = np.searchsorted(at, t.off)
                out = []
                for i in range(hi - lo):
                    mine = words[cut[i] : cut[i + 1]]
                    doc_id, row = batch.column(0)[lo + i].as_py(), batch.column(2)[lo + i].as_py()
                    for w in batch.column(3)[lo + i].as_py():
                        _, _, text = next(chunks(pa.array([w["item_text"]], pa.string())))
                        item = plain_word_hashes_at(text)[0]
                        best = _verified(mine, item, len(item) * (100 - percent) // 100, [(s["lo"], s["hi"]) for s in w["spans"]])
                        if best:
                            distance, a, b = best
                            start, end = int(at[cut[i] + a]), int(at[cut[i] + b]) if b < len(mine) else int(t.off[i + 1])
                            out += [(doc_id, w["of_item"], len(item), distance, start - int(t.off[i]), end - int(t.off[i]), row)] * w["copies"]
                columns = list(zip(*out, strict=True)) or [[]] * 7
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return own.mapInArrow(verify, _SCHEMA)
