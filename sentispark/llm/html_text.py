"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. Each block is described by its word count and link density, those of the
blocks before and after it, and where it stands (in an article, in a part such as a menu, footer, advert,
form or comment list, or in neither). A decision tree trained on the small labelled table below
decides which blocks are article text: where the page marks its article, mostly by that; elsewhere by the counts and
densities of a block and its neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.llm.common import slices

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "place", "page_has_article", "heading"]

#: Labelled pages, one per line: their blocks in order. A block is the letter of where it stands (A article, S surroundings,
#: N neither), its words, "/" and how many of them are links, "h" for a heading, and "+" if it is article text, else "-".
LABELLED = """
S1/1- S1/1- S2/2- A7h+ A80+ A45+ A60/4+ S8- S3/3- S12-
S2- S3/3- S1/1- A12h+ A2+ A120+ A1+ A90+ A4+ S40- S2/2- S2/2- S20-
S20- S1/1- S1/1- A6h+ A30+ A4h+ A55/8+ A3+ A2+ A5+ A70+ S15/2- S80- S60- S9-
S1/1- A5/5h+ A60+ A40/40+ A50+ A30/30+ A80+ S6-
S1/1- A3h+ A20+ A1/1+ A2/2+ A2/2+ A1/1+ A3/3+ A30+ A2h+ A45+ S5-
A4h+ A60/2+ A3/3+ A2/2+ A4/4+ A70+ A25+ S3/3- S90- S200- S30-
A1/1h+ A25+ A9/9h+ A40+ A130+ A6/1+ A12/6+ A20/5+ S70- S3- S2/2-
A8h+ A90+ A110+ A2/2-
A9h+ A50+ A3/3- S5- S1/1-
A60+ A1/1- S2/2-
A25+ A40+ A4/4-
A70+ A20+ A2/2- S3/3- S12-
A5/5h+ A60+ A70+ A2/2- S3-
A2/2h+ A30+ A90+ A1/1h+ A60+ A12+
A8/8h+ A4+ A40+
A3/3h+ A9/9+ A80+ A3/3+ A70+ A15/15+ A25+
S4/4- A10/10+ A60+ A2/2+ A90+ A1/1+ A50+
A5h+ A4+
A3+
A1+ S2-
A2h+ A3h+ A8+ A200/12+ A9+ A150+ A2+ S12- S60- S45- S100-
S4- S130- S90- A11h+ A14+ A22+ A18+ A16+ S18/2- S20/20- S7/7-
N3/3- N5- A10h+ A100+ A1+ A90+ N9- N40- N2/2- N2/2-
N20- N2- A6h+ A60+ A70/3+ N60- N150- N12- S5-
N1/1- N1/1- A8h+ A25+ A3+ A80+ N6h- N30- N45- N80-
N130- A4h+ A20+ A20+ N9/9- N70/2- N110- S30-
N1/1- N1/1- N1/1- N1/1- N8h+ N60+ N75/6+ N40+ N3-
N4- N1/1- N1/1- N2/2- N9h+ N45+ N3+ N80+ N60+ N10/9- N2/2- N2/2- N5-
N2/2- N3/3- N6h+ N4+ N70+ N2+ N50+ N30+ N3/3- N2/2- N7-
N1/1- N2/2- N1/1- N40+ N50+ N2/2- N3/3- N1/1- N12-
N18- N1/1- N1/1- N2/2- N10h+ N25+ N90+ N6+ N45+ N4-
N22- N2/2- N2/2- N1/1- N30+ N80/5+ N60+ N1/1- N2/2- N9-
N8h+ N1+ N90+ N70+ N2-
N6h+ N20+ N8+ N15+ N12+ N30+
N5h+ N60+ N50/6+ N4h+ N45+ N3h+ N80+ N70+ N2-
N200+
N45+
N9+
N14+
N6+
N3+
N1+
N5h+ N3+
N7h+ N40+
N4h+ N12+ N9+
N3h- N2/2- N2/2- N3/3- N90+ N60+ N2h- N3/3- N2/2- N3/3-
N12/12- N8/8- N10/9- N9h+ N35+ N50/3+ N65+ N12/12- N30/25- N14/14-
N2/2- N20/18- N2/2- N7h+ N55+ N40/40- N60+ N4- N2/2- N2/2-
N5/5- N1/1- N11h+ N100+ N15+ N120+ N9/9- N8/8-
N2- N1/1- N1/1- N5h+ N6+ N7+ N5+ N8+ N2/2- N2/2- N4-
S2/2- S3/3- N10h+ N60+ N4+ N75+ N2- S9-
S1/1- S2/2- N5h+ N20+ N30/2+ N9+ N40+ S50- S80- S3/3-
S30- N6h+ N45+ N70+ S6h- S25- S40- S60- N3-
S1/1- N4+ N3+ S2/2-
S2/2- N50+ S90- N60+ S20/4- N8+ N45+ S12-
N1/1- N2/2- N1/1- N3/3- N2/2-
N3- N2/2- N3/3- N2/2- N4-
S12- S3/3- S40- S5-
"""

# A quoted value may hold a ">" but no "<"; a tag for which that fails ends at the next ">".
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?:(?P<quoted>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|(?P<plain>[^>]*)>)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>",
    re.S,
)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noframes", "xmp", "template", "noembed"}
_BREAKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th "
    "thead title tr ul option".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_AROUND = set("nav footer aside form dialog menu select button datalist svg object audio video canvas head map math".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot advertorial sponsor sponsored sponsors promo promotion promoted banner banners cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars sidenav aside rail widget widgets menu "
    "menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commentlist replies reply disqus respond share "
    "sharing social related recommended recommendations trending popular search pagination pager copyright colophon disclaimer form hidden toc tags".split()
)
_COMMENTS = {"comment", "comments", "commentlist", "replies", "reply", "disqus", "respond"}
#: A name with one of these says how its element is laid out ("has-comments", "with-sidebar"), not what it is.
_MODIFIERS = {"has", "with", "no", "without", "open", "closed", "enabled", "disabled"}
_CONTENT = {"post", "entry", "hentry", "article", "story", "content", "main"}
#: Words of a name that only frame what the others say.
_FRAMES = set(
    "box block area bar list lists item items link links button buttons container wrapper wrap inner outer section panel unit slot group module row col column "
    "posts post articles article stories news bottom top left right small large icon icons text field input the site page main js".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def _place(tag: str, attributes: str, above: int) -> int:
    """Where an element stands: 1 article, 0 neither, -1 surroundings, -2 reader comments."""
    if above == -2:
        return -2
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    names: list[set[str]] = []
    if tag not in ("html", "body"):
        given = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower()
        names = [{w for w in re.split(r"[^a-z]+", name) if w} for name in given.split()]
        names = [name for name in names if not name & _MODIFIERS]
    named = set().union(*names)
    role = found.get("role", "").lower()
    # An element that is also named as content is no list of comments.
    if named & _COMMENTS and not any(name & _CONTENT and not name & _COMMENTS for name in names):
        return -2
    if tag in ("article", "main") or role in ("article", "main"):
        return 1
    if tag in _AROUND or role in _ROLES or (tag == "header" and above != 1):
        return -1
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return -1
    if above == 1 and any(name & _WORDS and name <= _WORDS | _FRAMES for name in names):
        # Inside an article only a whole name says so: "related-posts" does, "related-work" does not.
        return -1
    if above != 1 and tag not in _HEADINGS and tag != "p" and named & _WORDS:
        return -1
    # A paragraph or heading is surroundings only if its whole name says so.
    if named and named <= _WORDS:
        return -1
    return above


def text_blocks(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, words, linked words, place, heading) of every non-empty block in page order."""
    blocks: list[tuple[str, int, int, int, bool]] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, with their places
    pieces: list[tuple[str, bool]] = []
    place, anchors, heading, at, end = 0, 0, False, 0, len(page)

    def flush() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                words = text.count(" ") + 1
                linked = sum(len(p.split()) for p, a in pieces if a)
                blocks.append((text, words, min(linked, words), place, heading))
            pieces.clear()

    while at < end:
        found = _TOKEN.search(page, at)
        # A tag that the page ends in is no text.
        stop = found.start() if found else at + len(_UNFINISHED.split(page[at:], maxsplit=1)[0])
        if stop > at:
            pieces.append((html.unescape(page[at:stop]), anchors > 0))
        if not found:
            break
        at = found.end()
        opened, closed = found["open"], found["close"]
        attributes = found["quoted"] or found["plain"] or ""
        if opened:
            tag = opened.lower()
            if tag in _RAW:
                # The text up to its end tag is no text of the page.
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = over.end() if over else end
                if tag in _BREAKS:
                    flush()
                continue
            if tag == "br":
                pieces.append((" ", False))
            if tag == "a":
                anchors = 1  # links do not nest
            if tag in _BREAKS:
                flush()
                anchors = 0 if tag in ("p", "li", "td", "article", "main") else anchors
            if tag in _HEADINGS:
                heading = True
            elif tag in _BREAKS:
                heading = False
            if tag in _VOID or attributes.rstrip().endswith("/"):
                continue
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()
                place = stack[-1][1] if stack else 0
            new = _place(tag, attributes, place)
            if tag in _BREAKS or new != place:
                if new != place:
                    flush()
                stack.append((tag, new))
                place = new
        elif closed:
            tag = closed.lower()
            if tag == "a":
                anchors = 0
            if tag in _BREAKS:
                flush()
                heading = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    # An inline end tag does not close blocks around it.
                    if tag in _BREAKS or k == len(stack) - 1:
                        flush()
                        del stack[k:]
                        place = stack[-1][1] if stack else 0
                    break
                if stack[k][0] in ("article", "main", "body", "html") and tag in ("p", "li", "div", "span", "td"):
                    break
    flush()
    return blocks


def features(blocks: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    words = np.array([b[1] for b in blocks], float)
    density = np.array([b[2] for b in blocks], float) / np.maximum(words, 1)
    place = np.clip([b[3] for b in blocks], -1, 1)
    before = lambda x: np.concatenate([[0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0]])
    has = np.full(len(blocks), float((place == 1).any()))
    return np.stack(
        [words, density, before(words), before(density), after(words), after(density), place, has, np.array([b[4] for b in blocks], float)], axis=1
    )


def train_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 12) -> dict:
    """A binary tree by Gini impurity: {feature, cut, low, high} or {label}."""
    share = labels.mean()
    if depth == 0 or share in (0, 1):
        return {"label": bool(share >= 0.5)}
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            impurity = sum(part.sum() * labels[part].mean() * (1 - labels[part].mean()) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None:
        return {"label": bool(share >= 0.5)}
    _, f, cut = best
    low = rows[:, f] <= cut
    return {"feature": f, "cut": float(cut), "low": train_tree(rows[low], labels[low], depth - 1), "high": train_tree(rows[~low], labels[~low], depth - 1)}


def classify(tree: dict, rows: np.ndarray) -> np.ndarray:
    if "label" in tree:
        return np.full(len(rows), tree["label"])
    low = rows[:, tree["feature"]] <= tree["cut"]
    out = np.empty(len(rows), bool)
    out[low], out[~low] = classify(tree["low"], rows[low]), classify(tree["high"], rows[~low])
    return out


_BLOCK = re.compile(r"([ASN])(\d+)(?:/(\d+))?(h?)([+-])")


def labelled_table(pages: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled pages; neighbours are those of the page."""
    rows, labels = [], []
    for line in pages.strip().splitlines():
        found = [_BLOCK.fullmatch(b).groups() for b in line.split()]
        blocks = [("", int(words), int(linked or 0), {"A": 1, "S": -1, "N": 0}[place], bool(heading)) for place, words, linked, heading, _ in found]
        rows.append(features(blocks))
        labels += [label == "+" for *_, label in found]
    return np.concatenate(rows), np.array(labels, float)


def main_text(page: str, tree: dict) -> str:
    blocks = text_blocks(page)
    if not blocks:
        return ""
    kept = classify(tree, features(blocks))
    return "\n\n".join(b[0] for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame, tree: dict | None = None, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(id, url, text) of every row: its article blocks in page order, joined by an empty line.

    A null or empty page has the empty text. White space inside a block is one space. Ids and urls pass
    as they are, null included.
    """
    tree = tree or train_tree(*labelled_table())
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "source", 4 << 20):
            texts = [main_text(p, tree) for p in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string())], schema=schema)

    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    return rows.mapInArrow(run, "id long, url string, text string")
