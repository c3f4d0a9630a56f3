"""Brute-force versions of the operators, one document at a time in plain Python."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_words(s):
    return WORD.findall(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", lower(s)))


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def near_components(docs, n, percent):
    """doc_id -> (set size, smallest doc_id reachable); documents of at most two ids' worth of pairs are all compared."""
    sets = [(d, shingles(t, n)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


def base_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def cut_repeats(docs, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) by a table of all windows."""
    first = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cut_lines(docs, min_chars=40, min_docs=5, ordered=True):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    common = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out) if ordered else out


def cut_lines_of(docs, row):
    """The kept text of one row."""
    return next(k for d, t, k in ((d, t, k) for (d, t), (_, _, _, k) in zip(docs, cut_lines(docs, ordered=False), strict=True)) if (d, t) == row)


def cut_units(docs, min_unit=3, min_run=20):
    """doc_id -> (n_removed, n_spans, kept) for repeated sentences."""
    def units(raw):
        at = 0
        for line in raw.split(b"\n"):
            begin = 0
            for m in re.finditer(rb"[.!?](?= )", line):
                yield at + begin, at + m.end()
                begin = m.end()
            yield at + begin, at + len(line)
            at += len(line) + 1

    seen, out = set(), []
    for d, t in sorted(docs):
        raw = (t or "").encode()
        runs, open_run, own = [], None, []
        for a, b in units(raw):
            w = tuple(plain_words(raw[a:b].decode()))
            if len(w) < min_unit:
                continue
            if w in seen:
                open_run = (open_run[0], b, open_run[2] + len(w)) if open_run else (a, b, len(w))
            else:
                own.append(w)
                if open_run:
                    runs.append(open_run)
                open_run = None
                seen.add(w)
        if open_run:
            runs.append(open_run)
        runs = [r for r in runs if r[2] >= min_run]
        kept, at = b"", 0
        for a, b, _ in runs:
            kept += raw[at:a]
            at = b
        out.append((d, sum(b - a for a, b, _ in runs), len(runs), (kept + raw[at:]).decode()))
    return out


def nearest(item, text):
    """Edit distance in words of `item` to the nearest substring of `text`."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
