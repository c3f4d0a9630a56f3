"""Exact substring dedup: bytes covered by a 50-byte string that an earlier document also has.

Sorting every suffix of the corpus would move each byte fifty times, so suffixes are first thinned
without losing any match, then sorted.

1. Every 50-byte window picks its anchor, the 24-byte gram of least hash inside it. Equal windows
   have equal anchors at equal places, and neighbouring windows mostly share one: a run.
2. Blocks of documents send their distinct anchors (32 bits each, by bucket); a bucket answers
   with one bit per anchor: does another document have it? Most runs end here.
3. Blocks send the bytes of the remaining runs to the route of their anchor. Of equal runs in one
   block only the smallest document's is sent; the others are repeats already, so a passage that
   a third of all documents hold arrives once per block. Anchors that more than HOT_BLOCKS blocks
   hold are taken apart into single windows, each with a route of its own, so no route grows with
   them; the result is the same.
4. A route sorts the suffixes of its runs to depth 50 by deep-shallow sorting: multikey quicksort
   (several pivots a pass, over all groups at once) on 8-byte characters down to a shallow depth
   or to small groups, then a blind trie for what still shares its prefix: it stores the byte at
   which a group's members first differ, skips what they share and branches on that byte. Leaves
   with more than one suffix are equal windows; those not of the smallest document are repeats.
5. The repeats' byte ranges meet their rows, which are cut.

Defined cases: null text is empty; documents under 50 bytes lose nothing; rows with the same
doc_id are one document's, they never take from each other, and each loses only its own bytes;
rows without a doc_id take nothing and lose nothing; a text of 2**28 bytes or more is refused with an error; an empty table gives no rows; other columns
are not read. Hashes only bring candidates together: equal runs and windows are told by their
bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperline.llm.kernel import Text, chunks, mix, pack_bytes, pack_numbers, powers, u64, unpack_bytes, unpack_numbers
from amperline.llm.store import discard, save

LENGTH, GRAM = 50, 24
GRAMS = LENGTH - GRAM + 1
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
HOT_BLOCKS = 64
CHARACTERS = -(-LENGTH // 8)  # of 8 bytes
SHALLOW, SMALL, PIVOTS = 2, 24, 7
TRIE_ROWS = 1 << 18
_PLACE_BITS = 28
_BITS = "block int, bucket int, bits binary"
_RUNS = "kind int, route int, block int, doc binary, row binary, start binary, n binary, bytes binary"
_RANGES = "block int, row binary, start binary, end binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_text binary"


class Runs:
    """Runs of windows with one anchor: document row, first and last window (in the chunk), anchor hash."""

    def __init__(self, t: Text):
        n = len(t.buf) - LENGTH + 1
        if len(t.buf) >> _PLACE_BITS:
            raise ValueError(f"a text of {len(t.buf)} bytes: places in texts of 2**{_PLACE_BITS} bytes and more do not fit beside their hashes")
        self.text, self.first = t, np.zeros(0, np.int64)
        self.last, self.doc, self.anchor = self.first, self.first, np.zeros(0, u64)
        if n <= 0:
            return
        up, down = powers(len(t.buf) + 1)
        prefix = np.zeros(len(t.buf) + 1, u64)
        np.cumsum((t.buf.astype(u64) + u64(1)) * up[:-1], out=prefix[1:])
        gram = prefix[GRAM:] - prefix[:-GRAM]
        gram *= down[: len(gram)]
        gram = mix(gram)
        low = u64((1 << _PLACE_BITS) - 1)
        key = (gram & ~low) | np.arange(len(gram), dtype=u64)
        span = 1
        while span * 2 <= GRAMS:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[: n], key[GRAMS - span : GRAMS - span + n])
        at = (key & low).astype(np.int64)
        ok = np.ones(n, bool)
        for a, b in zip(np.maximum(t.off[1:] - LENGTH + 1, t.off[:-1]), t.off[1:], strict=True):
            ok[a:b] = False
        begins = ok.copy()
        begins[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
        ends = ok.copy()
        ends[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends)
        self.doc, self.anchor = t.doc_of(self.first), gram[at[self.first]]


def _sorted_block(table: pa.Table) -> pa.Table:
    """The block's rows in an order of their own; rows without a doc_id come last."""
    return table.select(["doc_id", "h", "text"]).sort_by([("doc_id", "ascending"), ("h", "ascending")])


def _split(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket starts among sorted anchor keys."""
    return keys, np.searchsorted(keys >> u64(32), np.arange(n + 1, dtype=u64))


def _anchor_key(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (((anchor >> u64(32)) % u64(buckets)) << u64(32)) | (anchor & u64(0xFFFFFFFF))


def _block_anchors(table: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct anchor keys, sorted, and which of them several of its documents have."""
    key, doc, base = [], [], 0
    ids = table["doc_id"].to_numpy()
    for lo, _, t in chunks(table["text"]):
        r = Runs(t)
        key.append(_anchor_key(r.anchor, buckets))
        doc.append(ids[lo + r.doc])
    if not key:
        return np.zeros(0, u64), np.zeros(0, bool)
    key, doc = np.concatenate(key), np.concatenate(doc)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
    return key[at], several


def _send_anchors(buckets: int):
    def send(key, table):
        block = key[0].as_py()
        keys, several = _block_anchors(_sorted_block(table), buckets)
        keys, cut = _split(keys, buckets)
        some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.table(
            {
                "bucket": pa.array(some, pa.int32()),
                "block": pa.array([block] * len(some), pa.int32()),
                "keys": pa.array([keys[cut[b] : cut[b + 1]].astype(np.uint32).tobytes() for b in some], pa.binary()),
                "several": pa.array([np.packbits(several[cut[b] : cut[b + 1]]).tobytes() for b in some], pa.binary()),
            }
        )

    return send


def _answer(key, table):
    """For each block of the bucket: two bit rows, shared and hot, in the order of its anchors."""
    keys = [np.frombuffer(x.as_py(), np.uint32) for x in table["keys"]]
    sizes = np.array([len(k) for k in keys])
    flat = np.concatenate(keys)
    several = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(table["several"], sizes, strict=True)])
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(at, len(s)))
    shared = (n > 1) | (np.add.reduceat(several[order].astype(np.int64), at) > 0)
    bits = np.zeros((2, len(s)), bool)
    bits[0, order], bits[1, order] = np.repeat(shared, n), np.repeat(n > HOT_BLOCKS, n)
    end = np.cumsum(sizes)
    out = [np.packbits(bits[:, e - k : e], axis=1).tobytes() for e, k in zip(end, sizes, strict=True)]
    return pa.table({"block": table["block"].cast(pa.int32()), "bucket": table["bucket"].cast(pa.int32()), "bits": pa.array(out, pa.binary())})


def _send_runs(buckets: int, routes: int):
    def send(key, left, right):
        block = key[0].as_py() if len(key) else None
        if not left.num_rows:
            return _run_table([])
        table = _sorted_block(left)
        block = left["block"][0].as_py() if block is None else block
        keys, _ = _block_anchors(table, buckets)
        keys, cut = _split(keys, buckets)
        shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for b, raw in zip(right["bucket"].to_pylist(), right["bits"], strict=True):
            n = cut[b + 1] - cut[b]
            two = np.frombuffer(raw.as_py(), np.uint8).reshape(2, -1)
            shared[cut[b] : cut[b + 1]], hot[cut[b] : cut[b + 1]] = np.unpackbits(two, axis=1, count=n)
        rows = _shared_runs(table, keys, shared, hot, buckets, routes)
        return _run_table(_local_and_sent(rows, block, routes))

    return send


def _shared_runs(table: pa.Table, keys, shared, hot, buckets: int, routes: int) -> dict:
    """The block's text and its runs whose anchors others have: doc_id, row, start in the row, windows, place in the text, digest, route."""
    ids = table["doc_id"].to_numpy()
    got: dict[str, list] = {k: [] for k in ("doc", "row", "start", "n", "at", "digest", "route")}
    text, base = [], 0
    for lo, _, t in chunks(table["text"]):
        text.append(t.buf)
        base += len(t.buf)
        r = Runs(t)
        if not len(r.first):
            continue
        at = np.searchsorted(keys, _anchor_key(r.anchor, buckets))
        use = shared[at]
        first, last, doc, anchor, is_hot = r.first[use], r.last[use], r.doc[use], r.anchor[use], hot[at][use]
        route_key = mix(anchor + u64(1))
        if is_hot.any():
            n = np.where(is_hot, last - first + 1, 1)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first, last, doc, is_hot, route_key = (np.repeat(x, n) for x in (first, last, doc, is_hot, route_key))
            first = first + step
            last = np.where(is_hot, first, last)
        digest = t.hashes(first, last + LENGTH)
        route_key = np.where(is_hot, digest, route_key)
        got["doc"].append(ids[lo + doc])
        got["row"].append(lo + doc)
        got["start"].append(first - t.off[doc])
        got["n"].append(last - first + 1)
        got["at"].append(base - len(t.buf) + first)
        got["digest"].append(digest)
        got["route"].append((route_key >> u64(20)) % u64(routes))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in got.items()} | {"text": np.concatenate(text) if text else np.zeros(0, np.uint8)}


def _leads(digest: np.ndarray, doc: np.ndarray, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run the first run of the smallest document with the same bytes; itself where there is none."""
    me = np.arange(len(doc))
    if not len(doc):
        return me
    order = np.lexsort((doc, digest))
    head = np.concatenate([[True], digest[order][1:] != digest[order][:-1]])
    lead = np.empty(len(doc), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(head, me, 0))]
    other = np.flatnonzero(lead != me)
    alike = size[other] == size[lead[other]]
    lead[other[~alike]] = other[~alike]
    other = other[alike]
    lo, total = 0, np.cumsum(size[other])
    while lo < len(other):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 21))))
        some = other[lo:hi]
        differ = text[_ranges(at[some], size[some])] != text[_ranges(at[lead[some]], size[some])]
        odd = some[np.logical_or.reduceat(differ, np.cumsum(size[some]) - size[some])]
        lead[odd] = odd
        lo = hi
    return lead


def _local_and_sent(got: dict, block: int, routes: int) -> list[tuple]:
    doc, row, start, n, at, digest, route, text = (got[k] for k in ("doc", "row", "start", "n", "at", "digest", "route", "text"))
    if not len(doc):
        return []
    size = n + LENGTH - 1
    later = doc > doc[_leads(digest, doc, text, at, size)]
    # what is known already goes along to the block's own cut
    rows = [(1, block % routes, block, b"", *map(pack_numbers, (row[later], start[later], (start + size)[later])), b"")] if later.any() else []
    sent = np.flatnonzero(~later)
    sent = sent[np.argsort(route[sent], kind="stable")]
    cut = np.searchsorted(route[sent], np.arange(routes + 1, dtype=u64))
    for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        own = sent[cut[k] : cut[k + 1]]
        rows.append((0, k, block, *map(pack_numbers, (doc[own], row[own], start[own], n[own])), pack_bytes(text[_ranges(at[own], size[own])])))
    return rows


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] numbers each, one after the other."""
    begin = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(begin - start, size)


def _run_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "route", "block", "doc", "row", "start", "n", "bytes"])


class Windows:
    """The windows text[at:at+LENGTH] as CHARACTERS big-endian characters of 8 bytes; the last one is zero behind the window."""

    def __init__(self, text: np.ndarray, at: np.ndarray):
        self.wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
        self.at = at

    def character(self, k, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.wide[self.at[rows] + 8 * k]).view(">u8").ravel().astype(u64)

    def whole(self, rows: np.ndarray) -> np.ndarray:
        x = np.stack([self.character(k, rows) for k in range(CHARACTERS)], axis=1)
        x[:, -1] &= u64(2**64 - 2 ** (8 * (8 * CHARACTERS - LENGTH)))
        return x


def _begins(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def _without_singles(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among sorted keys of the rows whose key another row has, and the number of their group."""
    begin = _begins(key)
    size = np.diff(np.append(begin, len(key)))
    several = size > 1
    return np.flatnonzero(np.repeat(several, size)), np.repeat(np.arange(several.sum()), size[several])


def multikey_quicksort(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(rows, group) of windows that agree in SHALLOW characters, or stand with few others between pivots.

    Each pass takes PIVOTS pivots of every group and splits it into what lies between them, at the
    group's present character, and what equals one of them, which moves on to the next character.
    """
    rows, group, level = np.arange(len(w.at)), np.zeros(len(w.at), np.int64), np.zeros(1, np.int64)
    done_rows, done_group, n_done = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(rows):
        begin = _begins(group)
        size = np.diff(np.append(begin, len(rows)))
        ends = (size <= SMALL) | (level >= SHALLOW)
        at_end = np.repeat(ends, size)
        done_rows.append(rows[at_end])
        done_group.append(n_done + np.repeat(np.arange(ends.sum()), size[ends]))
        n_done += int(ends.sum())
        rows, size, level = rows[~at_end], size[~ends], level[~ends]
        if not len(rows):
            break
        group = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        c = w.character(level[group], rows)
        pivots = c[begin[:, None] + size[:, None] * np.arange(1, 2 * PIVOTS, 2) // (2 * PIVOTS)]
        pivots.sort(axis=1)
        below, equal = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for k in range(PIVOTS):
            p = pivots[:, k][group]
            below += p < c
            equal |= p == c
        key = group * (2 * PIVOTS + 1) + 2 * below + equal
        order = np.argsort(key, kind="stable")
        key = key[order]
        kept, new = _without_singles(order, key)
        level = (level[group] + equal)[order[kept]][_begins(new)]
        rows, group = rows[order[kept]], new
    return np.concatenate(done_rows), np.concatenate(done_group)


def blind_trie(w: Windows, rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, begin of each leaf): the leaves of at least two equal windows of a blind trie over each group."""
    steps = u64(1) << (u64(8) * np.arange(1, 8, dtype=u64))
    leaves, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = _begins(group)
    end = np.append(begin[1:], len(rows))
    g = 0
    while g < len(begin):
        stop = max(g + 1, int(np.searchsorted(end, begin[g] + TRIE_ROWS, side="right")))
        own = rows[begin[g] : end[stop - 1]]
        text, node, who = w.whole(own), group[begin[g] : end[stop - 1]], np.arange(len(own))
        while len(who):
            first = _begins(node)
            size = np.diff(np.append(first, len(who)))
            differ = text[who] ^ text[np.repeat(who[first], size)]
            column = (differ != 0).argmax(axis=1)
            differ = differ[np.arange(len(who)), column]
            place = np.where(differ == 0, LENGTH, 8 * column + 7 - np.searchsorted(steps, differ, side="right"))
            branch = np.minimum.reduceat(place, first)  # what all members share up to here is skipped
            leaf = branch >= LENGTH
            leaves.append(own[who[np.repeat(leaf, size)]])
            sizes.append(size[leaf])
            who, at = who[np.repeat(~leaf, size)], np.repeat(branch[~leaf], size[~leaf])
            byte = (text[who, at // 8] >> (u64(56) - u64(8) * (at % 8).astype(u64))) & u64(255)
            key = np.repeat(np.arange((~leaf).sum()), size[~leaf]) * 256 + byte.astype(np.int64)
            order = np.argsort(key, kind="stable")
            kept, node = _without_singles(order, key[order])
            who = who[order[kept]]
        g = stop
    size = np.concatenate(sizes)
    return np.concatenate(leaves), np.cumsum(size) - size


def equal_windows(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort of the windows text[at:at+LENGTH]: (windows, group starts) of groups of at least two equal ones."""
    w = Windows(text, at)
    return blind_trie(w, *multikey_quicksort(w))


def _sort_route(key, table):
    """Byte ranges of the repeats among a route's runs, by block; what blocks knew already goes through."""
    known = table.filter(pc.equal(table["kind"], 1))
    table = table.filter(pc.equal(table["kind"], 0))
    known = pa.table([known[c].combine_chunks() for c in ("block", "row", "start", "n")], names=["block", "row", "start", "end"])
    if not table.num_rows:
        return known
    doc, row, start, n = (np.concatenate([unpack_numbers(x.as_py()) for x in table[c]]) for c in ("doc", "row", "start", "n"))
    block = np.repeat(table["block"].to_numpy(), [len(unpack_numbers(x.as_py())) for x in table["n"]])
    buf = np.frombuffer(b"".join(unpack_bytes(x.as_py()) for x in table["bytes"]), np.uint8)
    size = n + LENGTH - 1
    begin = np.cumsum(size) - size
    digest = np.empty(len(doc), u64)
    lo = 0
    while lo < len(doc):  # digests over pieces of the buffer
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + (1 << 21))))
        stop = begin[hi - 1] + size[hi - 1]
        piece = Text(buf[begin[lo] : stop], np.array([0, stop - begin[lo]]))
        digest[lo:hi] = piece.hashes(begin[lo:hi] - begin[lo], begin[lo:hi] + size[lo:hi] - begin[lo])
        lo = hi
    lead = _leads(digest, doc, buf, begin, size)
    repeat_run = doc > doc[lead]
    # of equal runs the first of the smallest document is sorted; its windows' answer holds for that document's others
    kept = np.flatnonzero(lead == np.arange(len(doc)))
    at = _ranges(begin[kept], n[kept])
    owner = np.repeat(kept, n[kept])
    rows, g = equal_windows(buf, at)
    flagged = np.zeros(len(at), bool)
    if len(rows):
        least = np.minimum.reduceat(doc[owner[rows]], g)
        flagged[rows] = doc[owner[rows]] > np.repeat(least, np.diff(np.append(g, len(rows))))
    # windows flagged one after the other make one range
    where = np.flatnonzero(flagged)
    turn = np.concatenate([[True], (where[1:] != where[:-1] + 1) | (owner[where[1:]] != owner[where[:-1]])]) if len(where) else np.zeros(0, bool)
    a, z = where[turn], where[np.concatenate([turn[1:], [True]])] if len(where) else where
    run = owner[a]
    a, z = at[a] - begin[run], at[z] - begin[run] + LENGTH
    # the same ranges for the other runs equal to a sorted one in the same document
    same = np.flatnonzero((lead != np.arange(len(doc))) & ~repeat_run)
    first = np.searchsorted(run, lead[same], side="left")
    k = np.searchsorted(run, lead[same], side="right") - first
    pick = _ranges(first, k)
    other = np.repeat(same, k)
    whole = np.flatnonzero(repeat_run)
    who = np.concatenate([whole, run, other])
    lo_at = np.concatenate([start[whole], start[run] + a, start[other] + a[pick]])
    hi_at = np.concatenate([start[whole] + size[whole], start[run] + z, start[other] + z[pick]])
    order = np.argsort(block[who], kind="stable")
    who, lo_at, hi_at = who[order], lo_at[order], hi_at[order]
    blocks, cut = np.unique(block[who], return_index=True)
    cut = np.append(cut, len(who))
    ranges = [[*map(pack_numbers, (row[who[x:y]], lo_at[x:y], hi_at[x:y]))] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    columns = list(zip(*ranges, strict=True)) or [[]] * 3
    found = pa.table([pa.array(blocks.astype(np.int32), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["block", "row", "start", "end"])
    return pa.concat_tables([known, found])


def _cut_block(key, left, right):
    """Each document of the block without the ranges."""
    if not left.num_rows:
        return pa.table([pa.array([], f.type) for f in _RESULT_ARROW], schema=_RESULT_ARROW)
    table = _sorted_block(left)
    row, start, end = (np.concatenate([np.zeros(0, np.int64), *(unpack_numbers(x.as_py()) for x in right[c])]) for c in ("row", "start", "end"))
    order = np.lexsort((end, start, row))
    row, start, end = row[order], start[order], end[order]
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept_text": []}
    lo, hi = (np.searchsorted(row, np.arange(table.num_rows), side=x) for x in ("left", "right"))
    for text, x, y in zip(table["text"].cast(pa.binary()), lo, hi, strict=True):
        raw = text.as_py() or b""
        spans: list[tuple[int, int]] = []
        for a, z in zip(start[x:y].tolist(), end[x:y].tolist(), strict=True):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
            else:
                spans.append((a, z))
        kept, at = [], 0
        for a, z in spans:
            kept.append(raw[at:a])
            at = z
        kept.append(raw[at:])
        out["n_bytes"].append(len(raw))
        out["n_removed"].append(sum(z - a for a, z in spans))
        out["n_spans"].append(len(spans))
        out["spans"].append([{"start": a, "end": z} for a, z in spans])
        out["kept_text"].append(b"".join(kept))
    return pa.table({"doc_id": table["doc_id"], **out}, schema=_RESULT_ARROW)


_RESULT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.binary())]
)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_text as bytes) per row."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(24, -(-total // BUCKET_BYTES))
    routes = max(24, blocks)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    named = keyed.where("doc_id IS NOT NULL")

    anchors = named.groupBy("block").applyInArrow(_send_anchors(buckets), "bucket int, block int, keys binary, several binary")
    bits = save(anchors.groupBy("bucket").applyInArrow(_answer, _BITS), "anchor-bits")
    runs = named.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_send_runs(buckets, routes), _RUNS)
    ranges = save(runs.groupBy("route").applyInArrow(_sort_route, _RANGES), "ranges")
    discard(bits)
    return keyed.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(_cut_block, _RESULT)
