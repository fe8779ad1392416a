"""Main text of web pages: flat blocks, features of neighbours, a decision tree.

A page becomes a flat list of text blocks in page order. Each block has its word count and link
density, those of the blocks before and after it, its tag, and the nearest enclosing element
that says what it is for (by its tag, class, id or role). A decision tree, trained when the
extractor is built on the small labelled table below, says which blocks are main text.

Cases: null and empty pages have empty text. Broken markup (tags not closed, pages cut off) is
read as far as it goes: a head without end tag ends where the body begins, and elements that are
never text are skipped only if they are closed. Long pages are read in whole. Equal splits of the
tree go to the first feature and threshold. Repeated rows each get their result. An empty table gives
an empty result. Extra columns pass through ``with_main_text``.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import blocks, prepare

#: Plain characters up to the end tag, or else to the end of the page; never text.
RAW = "script style textarea title"
#: Never text. Their content is skipped up to their own end tag, if there is one.
SKIPPED = "noscript template svg math iframe object select canvas audio video"
#: What can stand in a head. Anything else, or text, ends it.
HEAD = "base basefont bgsound link meta noframes noscript script style template title head html"
#: Elements that begin and end a block.
BLOCK = (
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html input label "
    "legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul"
)
#: Elements that stay open until closed and may tell what is in them.
CONTAINER = (
    "article aside blockquote body details dialog div dl fieldset figure footer form header main "
    "menu nav ol section table ul"
)
CONTENT_TAGS = "article main"
CHROME_TAGS = "nav footer aside header form menu dialog button fieldset"
#: Parts of class, id and role names, as whole words between separators.
CONTENT_NAMES = "article articlebody content entry main maincontent post postbody story text body"
CHROME_NAMES = (
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "contentinfo cookie cookies copyright disqus footer form gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notification outbrain pager pagination popup promo "
    "promoted related replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe taboola teaser toolbar topbar widget complementary alert disclaimer byline meta tags"
)

_RAW, _SKIPPED, _HEAD, _BLOCK, _CONTAINER = ({*s.split()} for s in (RAW, SKIPPED, HEAD, BLOCK, CONTAINER))
_CONTENT_TAGS, _CHROME_TAGS = {*CONTENT_TAGS.split()}, {*CHROME_TAGS.split()}
_CONTENT_NAMES, _CHROME_NAMES = {*CONTENT_NAMES.split()}, {*CHROME_NAMES.split()}
_HEADINGS = {f"h{i}" for i in range(1, 7)}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# Words of a name: between separators, and from a small to a capital letter.
_WORD = re.compile(r"(?:[A-Z]+(?![a-z])|[^\W\d_](?:(?![A-Z])[^\W\d_])*)")
_ANCHOR = re.compile(r"<(/?)a(?=[\s>/])", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_VOID = {"hr", "input", "br", "img"}

CONTENT, UNKNOWN, CHROME = 1, 0, -1


@dataclass
class Block:
    text: str
    words: int
    linked: int
    tag: int  # 0 other, 1 paragraph, 2 heading, 3 list item, 4 table cell
    inside: int  # CONTENT, CHROME or UNKNOWN
    hidden: bool


#: A name without separators that begins with a word of at least this length is taken for that word.
_LONG = 7


def _is_chrome(word: str) -> bool:
    return word in _CHROME_NAMES or any(word.startswith(c) for c in _CHROME_NAMES if len(c) >= _LONG)


def purpose(tag: str, attributes: str) -> int:
    """What an element is for: by a whole name, by its tag, or by a word within a name.

    ``story`` says more than the ``social`` of ``social-issues``, and so does the tag ``article``.
    """
    names = [n for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()]
    if any(n.lower() in _CHROME_NAMES for n in names):
        return CHROME
    if tag in _CONTENT_TAGS or any(n.lower() in _CONTENT_NAMES for n in names) and tag not in _CHROME_TAGS:
        return CONTENT
    words = {w.lower() for n in names for w in _WORD.findall(n)}
    if tag in _CHROME_TAGS or any(map(_is_chrome, words)):
        return CHROME
    return CONTENT if words & _CONTENT_NAMES else UNKNOWN


def ends(page: str, at: int) -> dict[int, int]:
    """Where each closed element that is skipped ends, by the place behind its start tag."""
    found: dict[int, int] = {}
    going: dict[str, list[int]] = {name: [] for name in _SKIPPED}
    while m := _TAG.search(page, at):
        at = m.end()
        name = (m["name"] or "").lower()
        if name in _RAW and not m["end"] and not m["rest"].endswith("/"):
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else len(page)
        elif name in _SKIPPED and m["end"]:
            if going[name]:
                found[going[name].pop()] = at
        elif name in _SKIPPED and not m["rest"].endswith("/"):
            going[name].append(at)
    return found


def _in_its_header(stack: list[tuple[str, int, bool]]) -> bool:
    """Whether a heading stands in the header of what is content."""
    told = [(name, p) for name, p, _ in stack if p]
    return len(told) > 1 and told[-1] == ("header", CHROME) and told[-2][1] == CONTENT


def flat_blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked: list[str] = []
    link, tag, at, own = 0, 0, 0, UNKNOWN
    anchor = None  # the next tag of a link, once it was looked for
    head, closed = False, None

    def add(raw: str) -> None:
        nonlocal head
        head = head and not raw.strip()
        if raw and not head:
            text.append(raw)
            if link:
                linked.append(raw)

    def close() -> None:
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            inside = own or next((p for _, p, _ in reversed(stack) if p), UNKNOWN)
            if tag == 2 and not own and _in_its_header(stack):
                inside = CONTENT
            n, k = len(whole.split()), len(html.unescape("".join(linked)).split())
            out.append(Block(whole, n, k, tag, inside, any(h for _, _, h in stack)))
        text.clear()
        linked.clear()

    length = len(page)
    while at < length:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
            continue
        if m["name"] is None:
            continue
        name, end, rest = m["name"].lower(), bool(m["end"]), m["rest"]
        if name == "head":
            head = not end
        elif name not in _HEAD and (not end or name == "body") or name == "html" and end:
            head = False
        if name in _RAW and not end and not rest.endswith("/"):
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else length
            if name == "title":
                close()
        elif name in _SKIPPED:
            if not end and not rest.endswith("/"):
                if closed is None:
                    closed = ends(page, m.start())
                at = closed.get(at, at)
        elif name == "a":
            link = 0 if end else 1
        elif name == "br":
            add(" ")
        elif name in _BLOCK:
            close()
            tag, own = 0, UNKNOWN
            if link:
                # A link goes on over blocks if it is closed before another one begins.
                if anchor is None or anchor.start() < at:
                    anchor = _ANCHOR.search(page, at)
                link = int(anchor is not None and anchor[1] == "/")
            if name in _CONTAINER:
                if not end and not rest.endswith("/"):
                    stack.append((name, purpose(name, rest), bool(_HIDDEN.search(rest))))
                elif end:
                    depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                    if depth is not None:
                        del stack[depth:]
            elif not end and name not in _VOID:
                own = purpose(name, rest)
                tag = 1 if name == "p" else 2 if name in _HEADINGS else 3 if name == "li" else 4 if name in ("td", "th") else 0
    close()
    return out


FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "tag", "inside", "hidden")


def features(found: list[Block]) -> np.ndarray:
    """One row per block: own numbers and those of the blocks before and after."""
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(b.linked / b.words for b in found), 0])
    more = np.array([(b.tag, b.inside, b.hidden) for b in found], float).reshape(-1, 3)
    sides = [words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]]
    return np.column_stack([*sides, more])


# --- the tree ---------------------------------------------------------------------------

Tree = tuple[int, float, "Tree", "Tree"] | bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """A binary tree by Gini impurity; ties go to the first feature and threshold."""
    share = y.mean() if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return bool(share > 0.5)
    best, choice = 2 * share * (1 - share) - 1e-9, None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bar in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= bar
            if least <= low.sum() <= len(y) - least:
                p, q, w = y[low].mean(), y[~low].mean(), low.mean()
                impurity = w * 2 * p * (1 - p) + (1 - w) * 2 * q * (1 - q)
                if impurity < best:
                    best, choice = impurity, (f, float(bar), low)
    if choice is None:
        return bool(share > 0.5)
    f, bar, low = choice
    return f, bar, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree: Tree, row: np.ndarray) -> bool:
    while not isinstance(tree, bool):
        f, bar, low, high = tree
        tree = low if row[f] <= bar else high
    return tree


#: The labelled table: pages in short notation, one block a line. A line is the label (``+`` main
#: text, ``-`` not), the path of elements (``tag.name``), the number of words and of linked words.
LABELLED = """
- nav/ul/li 1 1
- nav/ul/li 2 2
- nav/ul/li 1 1
- div.ad 9 0
+ article/h1 8 0
+ article/p 6 0
+ article/p 80 2
+ article/p 35 0
- footer 12 0
=
- header/div.masthead 3 3
- div.menu/ul/li 1 1
- div.menu/ul/li 2 2
- div.cookie/p 24 2
+ div.content/h1 7 0
+ div.content/p 55 3
+ div.content/p 4 0
+ div.content/ul/li 9 0
+ div.content/ul/li 12 1
- div.share 4 4
- div.comments/p 40 0
- div.comments/p 11 0
- div.footer 15 2
=
- div/ul/li 2 2
- div/ul/li 1 1
- div/ul/li 3 3
- div 5 5
+ div/h1 9 0
+ div/p 62 0
+ div/p 47 5
+ div/p 30 0
+ div/p 71 0
- div/ul/li 4 4
- div/ul/li 6 6
- div 7 3
=
- nav 6 6
- aside/p 30 0
- aside/h3 3 0
+ main/h2 5 0
+ main/p 12 0
+ main/p 25 1
+ main/blockquote/p 33 0
- main/form/p 14 0
- main/div.related/ul/li 8 8
- main/div.newsletter/p 20 0
- aside.sidebar/ul/li 3 3
- footer/p 18 1
=
- div.banner/p 16 1
- div.nav 8 8
+ article 3 0
+ article/div 90 0
+ article/table/td 2 0
+ article/table/td 3 0
+ article/pre 40 0
+ article/p 14 14
- article/aside/p 28 0
- article/div.ad/p 22 0
- article/footer/p 9 0
- section.comments/div/p 65 0
- section.comments/div/p 8 0
- form/p 6 0
- div.notice 31 0
=
- div 4 4
- div 3 3
+ div/p 120 6
+ div/p 44 0
+ div 28 0
+ div/p 52 0
- div 3 0
- div 2 2
- p 2 0
=
- ul/li 2 2
- ul/li 2 2
+ h1 6 0
+ p 18 0
+ p 27 0
+ p 66 4
+ p 21 0
- p 5 5
- p 3 3
=
- div.header/h1 3 3
- div.header/p 8 0
+ div.post/h1 10 0
+ div.post/p 7 0
+ div.post/p 5 0
+ div.post/h2 3 0
+ div.post/p 16 0
- div.tags 4 4
- div.author/p 12 12
- div.widget/p 26 1
- div.subscribe/p 13 0
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``LABELLED``, through the same parser as real pages."""
    rows, labels = [], []
    for page in LABELLED.strip().split("\n=\n"):
        source = []
        for line in page.splitlines():
            label, path, words, linked = line.split()
            labels.append(label == "+")
            parts = [(e.split(".") + [""])[:2] for e in path.split("/")]
            n, k = int(words), int(linked)
            text = "<a>" + "w " * k + "</a>" + "w " * (n - k)
            source.append("".join(f'<{t} class="{c}">' for t, c in parts) + text + "".join(f"</{t}>" for t, _ in reversed(parts)))
        rows.append(features(flat_blocks("".join(source))))
    return np.vstack(rows), np.array(labels)


@functools.cache
def trained() -> Tree:
    return grow(*labelled_table())


def main_blocks(page: str, tree: Tree) -> list[str]:
    found = flat_blocks(page)
    if not found:
        return []
    return [b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row)]


def _texts(pages: pa.Array, tree: Tree) -> Iterable[str]:
    for first, last in blocks(pages):
        for page in pages.slice(first, last - first).to_pylist():
            yield "\n\n".join(main_blocks(page or "", tree))


def with_main_text(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of an HTML column."""
    prepare(pages.sparkSession)
    tree = trained()

    @F.arrow_udf(T.StringType())
    def text_of(source: pa.Array) -> pa.Array:
        return pa.array(list(_texts(source, tree)), pa.string())

    return pages.withColumn(into, text_of(F.col(column)))


def main_text(pages: DataFrame) -> DataFrame:
    found = with_main_text(pages.select("page_id", "url", "html")).drop("html")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
