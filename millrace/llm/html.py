"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  The first pass decides each block from its length, its stop-word
density, its link density and the sections it stands in: ``good``, ``bad``, or undecided (``near``, ``short``).  Few stop
words make no block bad: it may be a table, code, or of another language.  On a page where no block is good, all
that are near are.

Sections that are never the article (menus, footers, asides, forms, adverts, comments; by tag, role, class or id) make
their blocks bad.  Words that an article may use itself (legal, notice, related, side, tags) are doubtful: such a block
is bad unless it stands in the article and its density makes it good, or unless the page has nothing else.  ``article`` and ``main`` win
over the rest of a page if they hold at least as much text that may be the article's; a teaser in one does not.

The second pass lets undecided blocks take the label of the nearest decided block of the same section
(distance in characters of text, the block before on a tie); a section without decided
blocks is good if it is the article itself, else its near blocks decide it.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import as_text

#: Characters of a short block, of a long one; link density from which a block is bad; stop-word density of good.
SHORT, LONG, LINKS, STOP_HIGH = 70, 200, 0.34, 0.30

STOP_WORDS = frozenset(
    (
        "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you "
        "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für ich im in ist mit nach nicht noch oder sich sie sind über um und von vor war wie zu zum zur "
        "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
        "al como con cuando del desde donde el ella en entre era es esta este ha hay la las lo los más me mi muy no nos o para pero por porque que se según ser si sin sobre son su sus también un una y ya "
        "che da di e gli i il non per più sono una uno da do dos em não os para por um uma het een van dat niet op te zijn"
    ).split()
)

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text.
RAW = frozenset("script style template noscript iframe object svg math canvas audio video select textarea title".split())
#: Of these, the ones that may stand in one another.
NESTED = frozenset("template object svg math canvas audio video select".split())
#: Sections that are never the article.
BAD_TAGS = frozenset("nav footer aside form menu dialog button fieldset label".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or an id: of sections that are never the article, and doubtful ones.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar widget cookie cookies consent gdpr notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus footer masthead topbar toolbar pagination pager".split()
)
DOUBTFUL_WORDS = frozenset("legal copyright notice notices related recommended promotion side skip search form tags".split())
BAD, DOUBTFUL = 2, 1
ARTICLE = frozenset("article main".split())
CLOSES_P = BLOCK - {"br"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("text", "linked", "bad", "section", "article", "heading", "label")

    def __init__(self, text: str, linked: int, bad: int, section: int, article: bool, heading: bool):
        self.text, self.linked, self.bad, self.section, self.article, self.heading, self.label = text, linked, bad, section, article, heading, ""


def _badness(tag: str, attributes: str, in_article: bool) -> int:
    """BAD, DOUBTFUL or 0, by the element's tag and attributes."""
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return BAD
    if not attributes or tag in ("html", "body"):
        return 0
    worst = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in BAD_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return BAD
        if name in ("class", "id") and tag not in ARTICLE:
            own = set(re.split(r"[^a-z]+", value))
            if own & BAD_WORDS:
                return BAD
            worst = max(worst, DOUBTFUL * bool(own & DOUBTFUL_WORDS))
    return worst


def _end_of_raw(page: str, tag: str, at: int) -> int:
    """Where the element ends whose start tag ends at ``at``, with those of its kind inside it; the page's end if it isn't closed."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*?(/?)>", re.IGNORECASE).finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag in NESTED and not m[2]:
            depth += 1
        if not depth:
            return m.end()
    return len(page)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with their text; raw sections left out."""
    blocks: list[Block] = []
    #: Open elements: tag, whether bad, section, whether in the article.
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    n_open: Counter[str] = Counter()
    parts: list[str] = []
    linked = in_link = sections = at = 0
    heading = False

    def close(k: int) -> None:
        n_open.subtract(t[0] for t in stack[k:])
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", references.unescape("".join(parts))).strip()
        if text:
            _, bad, section, article = stack[-1]
            blocks.append(Block(text, min(linked, len(text)), bad, section, article, heading))
        parts.clear()
        linked = 0

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        piece = page[at : m.start()]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(references.unescape(piece))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                flush()
                at = _end_of_raw(page, tag, at)
            continue
        if tag in BLOCK:
            flush()
            in_link = 0
        if tag == "a":
            in_link = not closing
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1) if n_open[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html", "section", "div"):
                    break  # a stray end tag doesn't close what it stands in
        else:
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            _, bad, section, article = stack[-1]
            own = max(bad, _badness(tag, attributes, article))
            inner = article or tag in ARTICLE
            if own != bad or inner != article:
                sections += 1
                section = sections
            stack.append((tag, own, section, inner))
            n_open[tag] += 1
        heading = any(t[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for t in stack[-4:])
    flush()
    return blocks


def _first_pass(b: Block, stop: float) -> str:
    if b.bad == BAD or b.linked > LINKS * len(b.text) and not (b.article and b.linked < len(b.text)):
        return "bad"
    if len(b.text) < SHORT or b.heading:
        return "short"
    return "good" if stop >= STOP_HIGH and (len(b.text) > LONG or b.article) else "near"


def classify(blocks: list[Block]) -> None:
    """Gives every block its label: good or bad."""
    stops = []
    for b in blocks:
        words = WORD.findall(b.text.lower())
        stops.append(sum(w in STOP_WORDS for w in words) / max(1, len(words)))
        b.label = _first_pass(b, stops[-1])
    # Text that may be the article's, in article or main and elsewhere; doubtful sections only where there is no other.
    inside, outside = (sum(len(b.text) for b in blocks if b.label in ("good", "near") and b.article == x and not b.bad) for x in (True, False))
    doubtful = inside + outside == 0
    chosen = any(b.article and b.label != "bad" for b in blocks) and inside >= outside
    for b, stop in zip(blocks, stops, strict=True):
        dense = b.label == "good" or b.article and b.label == "near" and stop >= STOP_HIGH
        if chosen and not b.article or b.bad == DOUBTFUL and not doubtful and not (b.article and dense):
            b.label = "bad"
    if not any(b.label == "good" for b in blocks):
        # No known language, or no prose: length alone decides, and the links that made blocks bad above; short blocks
        # only on a page of nothing else.
        best = "near" if any(b.label == "near" for b in blocks) else "short"
        for b in blocks:
            if b.label == best:
                b.label = "good"
    by_section: dict[int, list[int]] = {}
    for k, b in enumerate(blocks):
        by_section.setdefault(b.section, []).append(k)
    places = np.cumsum([0] + [len(b.text) for b in blocks])
    for own in by_section.values():
        if not any(blocks[k].label in ("good", "bad") for k in own):
            for k in own:
                if blocks[k].label == "near" or blocks[k].article:
                    blocks[k].label = "good"
        decided = [k for k in own if blocks[k].label in ("good", "bad")]
        labels = [blocks[k].label for k in decided]
        for k in own:
            b = blocks[k]
            if b.label in ("good", "bad"):
                continue
            if not decided:
                b.label = "bad"
                continue
            i = int(np.searchsorted(decided, k))
            before = places[k] - places[decided[i - 1] + 1] if i else None
            after = places[decided[i]] - places[k + 1] if i < len(decided) else None
            nearest = labels[i - 1] if after is None or before is not None and before <= after else labels[i]
            # A heading goes with what follows it.
            b.label = labels[i] if b.heading and after is not None else nearest


def extract(page: str) -> str:
    """The good blocks of a page, in its order, by one space."""
    blocks = blocks_of(page)
    classify(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long"


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row: page_id, url, text, n_chars, n_blocks.

    Null or empty html, and a page without article text, give the empty text and 0.  Null ids and urls stay null;
    repeated rows give a row each; an empty table gives none; other columns are not read.  Unclosed markup ends with the
    page.
    """

    def run(batches):
        for batch in batches:
            texts, n = [], []
            for page in batch.column(2):
                blocks = blocks_of(page.as_py() or "")
                classify(blocks)
                texts.append(" ".join(b.text for b in blocks if b.label == "good"))
                n.append(len(blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), as_text(url_column).alias("url"), as_text(html_column).alias("html")).mapInArrow(run, SCHEMA)
