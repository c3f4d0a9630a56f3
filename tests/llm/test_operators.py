"""The ten operators against brute force on a small table and on planted and odd rows."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from amperline.llm import decontam, htmltext, linededup, lmscore, packing, quality, queries, substring, suffix, superminhash, tokenbin
from tests.llm import plain

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, key string"


def odd_texts():
    r = random.Random(5)
    words = ["Alpha", "beta", "gämma", "delta", "eps.", "zeta!", "Eta", "theta?", "iota", "日本語", "naïve", "x"]
    long = " ".join(r.choice(words) + str(r.randrange(400)) for _ in range(9000))
    passage = " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(70))
    line = "This very common line has more than forty code points, ÄÖÜ and all"
    texts = [None, "", " ", "\n", "\n\n\n", "one", "ONE", "two words", "a" * 49, "b" * 50, "b" * 50, "c" * 120, "é" * 60, long, long, long + " tail"]
    texts += [f"{line}\n{i} {passage}\nend {i}" for i in range(6)] + [f"  {line.upper()}\t\n{i}\n\t{line.lower()}\r" for i in range(4)]
    texts += [passage, passage + "\n", "start " + passage, "x\ty\x0bz \x0c w\r\n", "tab\tone  two   three four five", "🙂 " * 40, "same five words go here " * 12]
    near = passage.split()
    for i in range(5):
        w = list(near)
        w[i * 3] = "changed"
        texts.append(" ".join(w))
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i * 3 - 4, t, "en", None, None, "clash", None, "k") for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def tables(small, odd, none):
    return [small, odd, none]


def test_substring_dedup(small, odd, none):
    for docs in (small, odd, none):
        got = sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_text) for r in substring.dedup_substrings(docs).collect())
        assert got == sorted(plain.cut_units(pairs(docs)))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(small, odd, none, n):
    for docs in (small, odd, none):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(docs, n=n).collect()}
        assert got == plain.near_components(pairs(docs), n, 80)


def test_near_duplicates_of_equal_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None), (3, "")]
    got = sorted(tuple(r) for r in superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect())
    assert got == [(1, 5, 1, True)] * 2 + [(2, 5, 1, False)] + [(3, 0, 3, True)] * 2


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:700], r.integers(0, 1 << 63, 300).astype(np.uint64)]))
    h, d = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
    sig = superminhash.superminhash(h, d, 2, 160)
    assert abs((sig[0] == sig[1]).mean() - 700 / 1300) < 0.12


def test_quality_statistics(spark, small, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(small, labels)
    for docs in (small, odd, none):
        got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score(docs, model).collect())
        assert got == sorted((d, *plain.base_statistics(t)) for d, t in pairs(docs))
        assert quality.score(docs, model).where("base_failed AND kept").isEmpty()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rated = quality.score(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = rated.select("toxic", "quality", "kept").collect()
    toxic = [r.kept for r in rows if r.toxic]
    clean = [r.kept for r in rows if not r.toxic and r.quality]
    assert sum(toxic) <= 0.1 * len(toxic)
    assert sum(clean) >= 0.95 * len(clean)


def test_quality_trees_are_monotonic(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality.fit(small, labels).trees
    x = np.abs(np.random.default_rng(1).normal(size=(200, len(quality.FEATURES))))
    for k, sign in enumerate(quality.SIGNS):
        more = x.copy()
        more[:, k] += 0.5
        if sign < 0:
            assert (trees.score(more) <= trees.score(x) + 1e-9).all()


def test_quality_without_labels(spark, small):
    model = quality.fit(small, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.score(small, model).where("kept = base_failed").isEmpty()


def check_packing(rows, docs, capacity):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {d for d, _ in docs}
    total = 0
    for d, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        cuts = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        total += len(ids)
        assert [(p, r.start, r.length, r.ids_crc32) for p, r in sorted(pieces[d].items())] == [(i, i * capacity, len(c), plain.crc(c)) for i, c in enumerate(cuts)]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), total


def test_packing(small, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    for docs in (small, odd, none):
        rows = packing.pack_documents(docs, path, 1, 4096).collect()
        n, total = check_packing(rows, pairs(docs), 4096)
        assert n <= -(-total // 4096) + 2


def test_packing_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAF_ITEMS", 50)
    r = random.Random(2)
    rows = [(i, 0, 0, r.choice([3, 40, 99, 100, r.randrange(1, 101)]), 0) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, packing._PIECES), 100, slack=1).collect()
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    assert len(got) == 3000
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    lengths = np.array([x[3] for x in rows])
    assert len(bins) <= len(set(packing.best_fit(lengths, 100)[0].tolist())) * 1.03


def test_decontamination(spark, small, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, plain.plain_words(r.text)) for r in bench.collect()]
    short = [(d, t) for d, t in pairs(small) if len(plain.plain_words(t or "")) < 1500]
    docs = small.join(spark.createDataFrame(short, "doc_id long, t string").select("doc_id"), "doc_id")
    want = set()
    for d, t in short:
        w = plain.plain_words(t)
        grams = set(w)
        for i, item in items:
            k = len(item) * 20 // 100
            # an item with more than k words that the document lacks is further away
            if len(item) >= 5 and sum(x not in grams for x in item) <= k and plain.nearest(item, w) <= k:
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == want
    assert decontam.contaminated(none, bench).count() == decontam.contaminated(odd, bench.limit(0)).count() == 0


def test_decontamination_finds_edits(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([5, 8, 13, 21, 40, 80])]
    docs, want = [], set()
    for n in range(300):
        i, text = r.choice(items)
        w = text.split()
        for _ in range(r.randrange(len(w) * 20 // 100 + 1)):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["new"], [w[at], "more"]])
        docs.append((n, " ".join([r.choice(words) for _ in range(30)] + w + [r.choice(words) for _ in range(30)])))
        want.add((n, i))
    docs += [(1000, None), (1001, "")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (90, None), (91, "a b")], "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} >= want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p>First&nbsp;para
 with <b>bold</b> text.<br>More<p>Second <a href="x">link</a></p><div id="comments"><p>A reader says no</p></div></article>
<form><input value=1>Search</form><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>broken <b"), (5, "u", "plain text " * 20), (1, "u", PAGE)]
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "A & B\nFirst para with bold text. More\nSecond link"
    assert got[1] == (text, len(text)) and got[2] == got[3] == ("", 0)
    assert got[5][0] == " ".join(["plain text"] * 20)
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_html_of_pages(spark):
    """The generated pages keep all of the article and nothing else."""
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op6_html_extraction(spark, SF).collect()}
    for p in pages.collect():
        inside = p.html[p.html.index("<article>") : p.html.index("</article>")]
        blocks = (" ".join(unescape(re.sub(r"<br>|<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1|article|ul|li|div)\b[^>]*>", inside))
        assert got[p.page_id] == "\n".join(b for b in blocks if b)


def test_suffix_dedup(small, odd, none):
    for docs in (small, odd, none):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in suffix.dedup_bytes(docs).withColumn("sha", F.sha2("kept_text", 256)).collect())
        assert got == plain.cut_repeats(pairs(docs))


def test_suffix_dedup_over_blocks_and_hot_anchors(monkeypatch, odd, small):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(suffix, "HOT_BLOCKS", 2)
    for docs in (odd, small):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in suffix.dedup_bytes(docs).withColumn("sha", F.sha2("kept_text", 256)).collect())
        assert got == plain.cut_repeats(pairs(docs))


def test_line_dedup(small, odd, none):
    for docs in (small, odd, none):
        got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.dedup_lines(docs).collect())
        assert got == plain.cut_lines(pairs(docs))


def test_token_files(spark, small, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for docs in (small, odd, none):
        want, at = [], 0
        for d, t in sorted(pairs(docs), key=lambda x: x[0]):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((d, at, len(ids), plain.crc(ids)))
            at += len(ids)
        assert sorted(tuple(r) for r in tokenbin.token_stream(docs, path, 2).collect()) == want


def test_token_files_random_access(spark, small, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    shards = tokenbin.write_token_files(small, path, 2, f"file://{tmp_path}/files", seq_len=128).collect()
    stream = [i for _, t in sorted(pairs(small)) for i in (*tok.encode(t or "", add_special_tokens=False).ids, 2)]
    assert len(shards) == 1 and shards[0].n_ids == len(stream)
    for i in (0, 7, len(stream) // 128):
        ids, mask = tokenbin.sequence(f"{tmp_path}/files/ids-000000-{shards[0].attempt}.arrow", i)
        assert ids[mask].tolist() == stream[i * 128 : (i + 1) * 128]


def test_cross_entropy(spark, small, odd, none):
    for docs in (small, odd):
        target = docs.where("doc_id % 3 = 0").select("doc_id")
        want = plain_scores(pairs(docs), {r.doc_id for r in target.collect()})
        got = {r.doc_id: (r.n_words, r.loss_target, r.loss_background, r.score) for r in lmscore.cross_entropy_difference(docs, target).collect()}
        assert set(got) == set(want)
        for d, (n, *losses) in want.items():
            assert got[d][0] == n
            assert got[d][1:] == (None, None, None) if n == 0 else np.allclose(got[d][1:], losses, rtol=1e-5, atol=1e-6)
    assert lmscore.cross_entropy_difference(none, none.select("doc_id")).count() == 0


def plain_scores(docs, target):
    from collections import Counter
    from math import log

    words = {d: plain.plain_words(t or "") for d, t in docs}
    counts = []
    for own in (target, set(words)):
        single, pair, context = Counter(), Counter(), Counter()
        for d in own:
            before = ""
            for w in words[d]:
                single[w] += 1
                pair[before, w] += 1
                context[before] += 1
                before = w
        counts.append((single, pair, context))
    size = len(counts[1][0]) + 1
    out = {}
    for d, own in words.items():
        losses = []
        for single, pair, context in counts:
            total, before, loss = sum(single.values()), "", 0.0
            for w in own:
                p1 = (single[w] + 1) / (total + size)
                loss -= log((pair[before, w] + lmscore.MASS * p1) / (context[before] + lmscore.MASS))
                before = w
            losses.append(loss / max(1, len(own)))
        out[d] = (len(own), *losses, losses[1] - losses[0])
    return out


def test_added_tokens_in_texts(spark):
    """The literal of an added token gets the id that the library gives it."""
    from amperline.llm.encoder import Encoder

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tok, enc = Tokenizer.from_file(path), Encoder(path)
        for text in ("one two <|endoftext|> three", "<|ENDOFTEXT|>", "a<|endoftext|>b\nc", "no literal | <| here", "</w> <s> x"):
            assert np.frombuffer(enc.blob(text.encode()), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_words_of_letters(spark):
    """Pieces of letters, with and without a mark, get the ids that the library gives, whatever stands before them."""
    from amperline.llm.encoder import Encoder

    rng = random.Random(7)
    letters = [chr(c) for c in range(0x41, 0x460)]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(3000)] + ["Straße", "unglaublich", "x×y", "a÷b", "ß", "слово", "Ünïcödé", "don't", "it's", "e\u0301te"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tok, enc = Tokenizer.from_file(path), Encoder(path)
        for w in words:
            for text in (w, f"one {w}, {w}\n{w}."):
                assert np.frombuffer(enc.blob(text.encode()), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_files_of_lost_attempts_go(spark, small, tmp_path):
    out = f"file://{tmp_path}/files"
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "ids-000000-999999.arrow").write_bytes(b"half a file")
    tokenbin.write_token_files(small, public_tokenizers.path("byte_bpe_50k.json"), 2, out)
    assert not (tmp_path / "files" / "ids-000000-999999.arrow").exists() and len([f for f in (tmp_path / "files").iterdir() if f.suffix == ".arrow"]) == 2
