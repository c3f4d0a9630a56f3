"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks at block-level tags. A block knows its words and the share of them in
links, the same of the blocks before and after it, and what its elements say: how much it looks
like part of an article (`article`), like part of an element for other purposes by tag or role
(`chrome`) and by class or id (`named`), whether a text element holds it, whether it is a heading.
A decision tree learned from the small table LAYOUTS says which blocks are content; no single
sign decides outside the tree.

* Attributes are taken apart into names and values, so a word counts only where it stands as a
  class, id, role or style.
* `article`: 3 inside article or main, 2 inside an element named like one, 1 on pages without
  either, 0 outside of it on pages with one.
* `named`: 3 for a name that leaves no doubt (`sidebar`, `comments`), 2 for one with such a part
  (`comment-list`, `ad_slot`) or a likely name (`related`) on a container, 1 for a likely name on
  a text element or as a part. Names that tell of the article or of what a page lacks
  (`article-header`, `no-sidebar`) say nothing. An article or main element starts anew, unless
  what is around it leaves no doubt.
* LAYOUTS gives labelled blocks: three pages of the public table as they are, with numbers of
  words for their texts, and hand-made ones. Each is learned from as it stands and with its article
  tags taken off, so that neighbours, text elements and lengths have to decide, and with longer and shorter texts.

Defined cases: null or empty html, and pages without content, give an empty text; an unclosed
comment or tag at the end of a page is dropped; repeated pages are treated each; an empty table
gives no rows; columns other than page_id, url and html are not read; a page is one task's work
whatever its length, in time linear in it.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ["words", "link_share", "words_before", "links_before", "words_after", "links_after", "article", "chrome", "named", "text_element", "heading"]

#: A label for each block (1: content), and the page; {n} stands for a text of n words.
LAYOUTS = [
    # three pages of the public table
    ("0000000 1111111 0", "<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a></ul></nav><div class=ad>{8}</div><article><h1>{9}</h1><p><b>{55}<br><p>{122}</p><p>{33}</p><p>{2}</p><p>{7}</p><p>{58}</p></article><footer>{13}</footer>"),
    ("0000000 111111 0", "<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a></ul></nav><div class=ad>{11}</div><article><h1>{10}</h1><p><b>{77}<br><p>{10}</p><p>{17}</p><p>{151}</p><p>{1}</p></article><footer>{13}</footer>"),
    ("0000000 1111 0", "<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a></ul></nav><div class=ad>{8}</div><article><h1>{11}</h1><p>{24}<p>{3}<p>{9}</article><footer>{9}</footer>"),
    # articles with other things in and around them
    ("00 11101110 00", "<header><a>{2}</a></header><nav><a>{1}</a></nav><article><h1>{7}</h1><p>{40}</p><p>{12}</p><div class=ad-slot>{6}</div><h2>{3}</h2><p>{90}</p><p>{5}</p><aside>{30}</aside></article><aside><p>{25}</p></aside><footer><p>{20}</p></footer>"),
    ("0 1111 000000", "<div class=navbar><a>{3}</a></div><article><h1>{5}</h1><p>{30}</p><ul><li>{6}<li>{8}</ul></article><div class=comments><h3>{2}</h3><p>{40}</p><p>{9}</p><p>{120}</p><form>{3}</form></div><div class=sidebar>{80}</div>"),
    ("11111 0000", "<main><h1>{6}</h1><p>{20}</p><p><a>{9}</a></p><p>{2}</p><blockquote>{60}</blockquote><div class=share><a>{1}</a></div><section class=related><h3>{2}</h3><p><a>{8}</a></p></section></main><div class=newsletter>{15}</div>"),
    ("1111 000", "<article><div class=header><h1>{4}</h1></div><h2 class=banner>{3}</h2><p>{35}</p><p class=menu-item>{9}</p><div class=comment-list><p>{60}</p><p>{4}</p></div><p class=ad>{7}</p></article>"),
    ("000 111 0 11", "<div class=cookie-banner>{20}</div><div class=notice>{12}</div><div class=menu><a>{2}</a></div><article><h1>{8}</h1><p>{22}</p><p>{3}</p><div class=promo>{14}</div><p>{45}</p><pre>{30}</pre></article>"),
    ("0 11111 0 1", "<form>{4}</form><article><p>{1}</p><p>{1}</p><div>{3}</div><div>{20}</div><table><tr><td>{2}</td></tr></table><div class=widget><a>{5}</a></div><p><a>{4}</a></p></article>"),
    ("0000 1 0000", "<ul class=tags><li><a>{1}</a></ul><div>{4}</div><p>{9}</p><div>{30}</div><article><p>{70}</p></article><p>{12}</p><div>{3}</div><p><a>{7}</a></p><div>{45}</div>"),
    ("111 0 00", "<article><p>{50}</p><p class=share-price>{5}</p><h2 class=search>{4}</h2><div class=search>{2}</div></article><section class=comments><article><p>{50}</p></article><article><p>{6}</p></article></section>"),
    # pages without an article
    ("11", "<p>{5}</p><p>{7}</p>"),
    ("1", "<p>{3}</p>"),
    ("1", "{20}"),
    ("1", "{40}"),
    ("1", "<div>{30}</div>"),
    ("0", "<div><a>{2}</a></div>"),
    ("0", "<p><a>{3}</a></p>"),
    ("00000 1111 000", "<div><a>{1}</a></div><div><a>{2}</a></div><div><a>{1}</a></div><div>{8}</div><div><a>{3}</a></div><h1>{8}</h1><p>{30}</p><p>{2}</p><p>{55}</p><div>{4}</div><div><a>{2}</a></div><div>{6}</div>"),
    ("000 11111 00", "<div><a>{1}</a></div><div><a>{1}</a></div><div>{3}</div><h1>{10}</h1><div>{80}</div><div>{26}</div><div>{14}</div><div>{60}</div><div><a>{1}</a></div><div>{5}</div>"),
    ("00 1111 00", "<ul><li><a>{2}</a><li><a>{3}</a></ul><h2>{5}</h2><p>{9}</p><ul><li>{7}<li>{5}</ul><ul><li><a>{2}</a><li><a>{1}</a></ul>"),
    ("0 1111 0", "<div>{2}</div><p>{18}</p><p>{60}</p><h3>{2}</h3><p>{25}</p><div>{3}</div>"),
    ("1111", "<form><h1>{6}</h1><p>{50}</p><p>{70}</p><p>{45}</p></form>"),
    ("0000", "<form><label>{2}</label><p>{4}</p><button>{1}</button><div>{3}</div></form>"),
    ("0 111 0", "<div class=menu>{9}</div><div class=post><h1>{4}</h1><p>{6}</p><div>{3}</div></div><div class=login>{5}</div>"),
    ("111 00", "<div id=content><p>{30}</p><p><a>{6}</a></p><p>{1}</p></div><div>{2}</div><div><a>{2}</a></div>"),
    ("00 111", "<aside>{90}</aside><dialog><p>{50}</p></dialog><h1>{2}</h1><p>{2}</p><p>{40}</p>"),
]

#: Texts of the layouts are learned at these multiples of their lengths.
SCALES = (0.25, 0.5, 0.8, 1, 1.3, 2, 3.5)
#: A side of a split holds so many blocks at least.
MIN_BLOCKS = 10

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe noframes".split())
#: Elements and roles for other purposes than text: 2; those that may also wrap a whole page: 1.
_CHROME = dict.fromkeys("nav aside footer menu dialog button select search head navigation banner complementary contentinfo alert alertdialog menubar tablist toolbar".split(), 2) | {"form": 1, "fieldset": 1}
#: Names of elements for other purposes, as a whole class or id or as a part of one.
_CLEAR = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs captcha comment comments commentlist cookie cookies consent disqus footer gdpr login "
    "masthead modal nav navbar navigation newsletter pagination paywall popup sidebar signup sponsor sponsored subscribe subscription".split()
)
#: Names that may mean such an element.
_LIKELY = frozenset("banner banners discussion dropdown form header menu menus notice notices overlay pager promo promos promotion related reply replies respond responses search share sharing skip social tags toolbar topbar widget widgets".split())
#: A name of these parts alone tells of the article.
_ARTICLE_NAME = frozenset("article articlebody entry post content story main text body page single blog".split())
#: A name with one of these parts tells of the article or of what a page lacks.
_ARTICLE_PART = frozenset("article entry post content story main no not without hide has".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption caption".split())
_INLINE_TEXT = _TEXT | {"span", "a", "b", "i", "em", "strong"}
_CLOSES_P = _BLOCK - {"html", "body", "head"}
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_IMPLIED_STOP = frozenset("ul ol dl table tbody thead tfoot select menu".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _hidden(own: dict[str, str]) -> bool:
    styles = dict(part.partition(":")[::2] for part in own.get("style", "").lower().replace(" ", "").split(";"))
    return "hidden" in own or styles.get("display", "").startswith("none") or styles.get("visibility", "").startswith("hidden")


@functools.lru_cache(4096)
def _name_signs(name: str, in_article: bool, text: bool) -> tuple[int, int]:
    """(how much a class or id speaks for another purpose, for an article)."""
    parts = [w.lower() for w in _CAMEL.split(name) if w]
    whole = name.lower()
    article = 2 if parts and all(w in _ARTICLE_NAME for w in parts) and any(w in _ARTICLE_PART for w in parts) else 0
    if in_article and "header" in parts:
        return 0, article
    if whole in _CLEAR:
        return 3, article
    if any(w in ("comment", "comments") for w in parts):
        return 2, article
    if any(w in _ARTICLE_PART for w in parts):
        return 0, article
    if whole in _LIKELY:
        return 1 if text else 2, article
    if any(w in _CLEAR for w in parts):
        return 2, article
    return int(not text and any(w in _LIKELY for w in parts)), article


class Element:
    """An open element, with what it and those around it say."""

    __slots__ = ("article", "chrome", "heading", "link", "named", "tag", "text")

    def __init__(self, tag: str, raw: str, around: "Element | None"):
        self.tag = tag
        self.article, self.chrome, self.named = (around.article, around.chrome, around.named) if around else (0, 0, 0)
        self.heading = (around is not None and around.heading) or (tag[0] == "h" and tag[1:].isdigit())
        self.link = (around is not None and around.link and around.tag not in _BLOCK) or tag == "a"
        self.text = tag in _TEXT or (around is not None and around.text and tag not in _BLOCK)
        own = attributes(raw) if raw and not raw.isspace() else {}
        roles = own.get("role", "").lower().split()
        if tag in ("article", "main") or "main" in roles or "article" in roles:
            if self.chrome < 2 and self.named < 3:
                self.article, self.chrome, self.named = 3, 0, 0
            return
        if tag in ("html", "body"):
            return
        names = [x for key in ("class", "id") for x in own.get(key, "").split()]
        header = tag == "header" and self.article < 3 and not any(w in _ARTICLE_PART for x in names for w in x.lower().split("-"))
        self.chrome = max(self.chrome, _CHROME.get(tag, 2 * (header or _hidden(own))), *(_CHROME.get(x, 0) for x in roles))
        for x in names:
            named, article = _name_signs(x, self.article == 3, tag in _INLINE_TEXT)
            self.named, self.article = max(self.named, named), max(self.article, article)


class Block:
    __slots__ = ("article", "chrome", "heading", "link_words", "named", "text", "text_element", "words")


def blocks(html: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[Element] = []

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            b = Block()
            b.text, b.words = text, text.count(" ") + 1
            b.link_words = min(b.words, len(unescape(" ".join(linked)).split()))
            e = stack[-1] if stack else None
            b.article, b.chrome, b.named, b.text_element, b.heading = (e.article, e.chrome, e.named, e.text, e.heading) if e else (0, 0, 0, False, False)
            out.append(b)
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if stack and stack[-1].link:
            linked.append(text)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _RAW and not closing:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        for k in range(len(stack) - 1, -1, -1) if tag in _IMPLIED else ():
            if stack[k].tag in _IMPLIED[tag]:
                del stack[k:]
                break
            if stack[k].tag in _IMPLIED_STOP:
                break
        stack.append(Element(tag, m[3], stack[-1] if stack else None))
    flush()
    if not any(b.article for b in out):
        for b in out:
            b.article = 1
    return out


def block_features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found) + 2, len(FEATURES)))
    for i, b in enumerate(found, 1):
        x[i, [0, 1, 6, 7, 8, 9, 10]] = b.words, b.link_words / b.words, b.article, b.chrome, b.named, b.text_element, b.heading
    x[1:-1, 2:4], x[1:-1, 4:6] = x[:-2, :2], x[2:, :2]
    return x[1:-1]


def labelled_blocks() -> np.ndarray:
    """Features and label of each block of LAYOUTS with texts of each of SCALES, as they stand and without their article and main tags."""
    rows = []
    for labels, layout in LAYOUTS:
        want = [int(c) for c in labels if c != " "]
        bare = re.sub("<(/?)(?:article|main)>", r"<\1div>", layout)
        for html, scale in itertools.product(dict.fromkeys((layout, bare)), SCALES):
            x = block_features(blocks(re.sub(r"{(\d+)}", lambda m, k=scale: " ".join(["w"] * max(1, round(int(m[1]) * k))), html)))
            if len(x) != len(want):
                raise ValueError(f"{len(x)} blocks and {len(want)} labels: {layout}")
            rows.append(np.column_stack([x, want]))
    return np.concatenate(rows)


@functools.cache
def learned_tree() -> tuple:
    return grow_tree(labelled_blocks())


def grow_tree(rows: np.ndarray, depth: int = 12) -> tuple:
    """A Gini tree as nested (feature, threshold, low side, high side) with class leaves."""
    x, y = rows[:, :-1], rows[:, -1]
    leaf = (int(y.mean() >= 0.5),)
    if depth == 0 or y.min() == y.max():
        return leaf
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(v))
        p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(v) - n)
        impurity = n * p * (1 - p) + (len(v) - n) * q * (1 - q)
        impurity[(v[1:] == v[:-1]) | (n < MIN_BLOCKS) | (len(v) - n < MIN_BLOCKS)] = np.inf
        i = int(impurity.argmin())
        if np.isfinite(impurity[i]) and (best is None or impurity[i] < best[0] - 1e-9):
            best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow_tree(rows[low], depth - 1), grow_tree(rows[~low], depth - 1)


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), bool(tree[0]))
    low = x[:, tree[0]] <= tree[1]
    return np.where(low, classify(tree[2], x), classify(tree[3], x))


def main_text(html: str | None, tree: tuple) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    return "\n".join(b.text for b, content in zip(found, classify(tree, block_features(found)), strict=True) if content)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages`."""
    tree = learned_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
