"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass rates each block: blocks inside
menus, headers, footers, sidebars, adverts, notices, forms and comments are out; of the rest,
link density, length and the density of stop words say good, bad, or ambiguous. The second
pass gives ambiguous blocks the label of their nearest decided neighbours. Names of classes are only
hints: a part that they would put out is kept if it holds most of the page's good text.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Frequent function words of the languages covered.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "le la les de des et en un une du dans que qui est pour pas au sur par il elle ne se ce avec plus son sont "
    "el los las del y que se por con no una su para es al lo como más o pero sus le ha".split()
)
# Tags whose content is no text, tags that part blocks, and tags outside an article's text.
SILENT = ("script", "style", "noscript", "template", "svg", "head", "title", "iframe", "object", "canvas", "math")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul caption textarea button".split()
)
OUTSIDE = frozenset("nav footer aside form menu dialog select option button textarea fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names in class, id or role of parts of a page that are not the article, of readers' comments, and
# words that go with such names in compounds (site-header, comment-list, ad-slot-2).
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead banner sidebar side aside ad ads advert "
    "advertisement sponsor sponsored promo cookie cookies consent notice gdpr popup modal newsletter subscribe share sharing "
    "social related search complementary contentinfo login signup".split()
)
COMMENTS = frozenset("comment comments disqus replies reply".split())
WITH_MARKS = frozenset(
    "site page main top bottom left right upper lower primary secondary global inner outer mobile desktop list item items box "
    "block wrapper wrap container widget widgets section area region bar strip row column col panel overlay dialog link links icon icons "
    "button buttons form field input toolbar tools posts articles stories news thread text title slot unit zone skin media us".split()
)
NAME = re.compile(r"[^\s]+")
PARTS = re.compile(r"[-_]+")
SIZE = re.compile(r"\d+(?:x\d+)?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# A quote opens a value only behind an equals sign.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"
#: Limits of the first pass: link density, characters of a short and of a long block, stop-word density.
LINKED, SHORT_CHARS, LONG_CHARS, FEW_STOPS, MANY_STOPS = 0.35, 70, 200, 0.10, 0.18
#: Good blocks of a part from which its names may be taken for misleading.
MISLED = 3


def _marked(names: str, marks: frozenset) -> bool:
    """Whether one of the names is a mark, or is put together from marks and what goes with them alone."""
    for name in NAME.findall(names.lower()):
        if name in marks:
            return True
        parts = [p for p in PARTS.split(name) if p and not SIZE.fullmatch(p)]
        if any(p in marks for p in parts) and all(p in marks or p in MARKS or p in WITH_MARKS for p in parts):
            return True
    return False


NO, HINTED, SURE = 0, 1, 2


def _outside(tag: str, attributes: str, in_article: bool) -> int:
    """Whether a tag begins a part outside the article: for SURE, or by its names (HINTED), which may mislead."""
    if tag in OUTSIDE:
        return SURE
    out = HINTED if tag == "header" and not in_article else NO
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return SURE
        if name in ("class", "id", "role") and tag not in ("body", "html"):
            if _marked(value, COMMENTS):
                return SURE
            if tag not in ("article", "main") and _marked(value, MARKS):
                out = HINTED
    return out


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, outside the article, heading) of each block with text.

    Where the parts that a page marks as article or main hold most of its good text, all blocks beside them
    are outside. A part put out by its names alone stays in if it holds most of the good text, in
    ``MISLED`` blocks or more: an advert in a short page is no article.
    """
    found, hints = _cut(page)
    good = [len(text) if rate(text, links, sure) in (GOOD, NEAR) and not sure else 0 for text, links, sure, _, _, _ in found]
    # Good text below each hint, whatever other hints say; a hint inside another counts for both.
    below: dict[int, list[int]] = {}
    for size, (_, _, _, _, _, hint) in zip(good, found):
        while size and hint:
            below.setdefault(hint, []).append(size)
            hint = hints[hint]
    misleading = {h for h, sizes in below.items() if len(sizes) >= MISLED and 2 * sum(sizes) > sum(good)}

    def hinted(hint):
        while hint:
            if hint not in misleading:
                return True
            hint = hints[hint]
        return False

    away = [sure or hinted(hint) for _, _, sure, _, _, hint in found]
    left = [0 if a else size for a, size in zip(away, good)]
    inside = sum(size for size, x in zip(left, found) if x[4])
    marked = inside > 0 and 2 * inside >= sum(left) or any(x[4] and not a for x, a in zip(found, away)) and not any(left)
    return [(x[0], x[1], a or marked and not x[4], x[3]) for x, a in zip(found, away)]


def _cut(page: str):
    """Blocks as (text, characters in links, surely outside, heading, inside an article, innermost hint) and,
    for each hint, the one around it. Hints count from 1."""
    out, parts, linked = [], [], 0
    hints: dict[int, int] = {}
    stack: list[tuple[str, bool, bool, int]] = []  # tag, surely outside, article, hint
    nothing = ("", False, False, 0)
    anchors = at = 0
    heading = False

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                above = stack[-1] if stack else nothing
                out.append((text, linked, above[1], heading, above[2], above[3]))
        parts, linked = [], 0

    def text_until(end):
        nonlocal linked
        if end > at:
            parts.append(page[at:end])
            if anchors:
                linked += len(page[at:end].strip())

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            break
        text_until(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in SILENT:
            if not m[1] and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if tag == "head" and close is None:
                    continue
                at = close.end() if close else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            anchors = 0 if m[1] else 1
        inline = tag not in BLOCKS
        if inline and not m[1] and (tag in VOID or not m[3]):
            continue
        if not inline:
            flush()
            anchors = 0
            heading = not m[1] and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag in VOID:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if inline and (stack[i][1] or stack[i][3]):
                        flush()
                    del stack[i:]
                    break
        elif not m[3].endswith("/") or not inline:
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            above = stack[-1] if stack else nothing
            own = _outside(tag, m[3], above[2])
            if inline and own:
                flush()
            if not inline or own:
                hint = above[3]
                if own == HINTED:
                    hint = len(hints) + 1
                    hints[hint] = above[3]
                stack.append((tag, above[1] or own == SURE, above[2] or tag in ("article", "main"), hint))
    text_until(n) if at < n else None
    flush()
    return out, hints


def rate(text: str, linked: int, outside: bool) -> str:
    if outside or linked > LINKED * len(text):
        return BAD
    if text.startswith(("©", "\xa9")):
        return BAD
    if len(text) < SHORT_CHARS:
        return SHORT
    tokens = text.lower().split()
    stops = sum(t.strip(".,;:!?%&$#*\"'()") in STOP_WORDS for t in tokens) / len(tokens)
    if stops >= MANY_STOPS:
        return GOOD if len(text) > LONG_CHARS else NEAR
    return NEAR if stops >= FEW_STOPS or len(text) > LONG_CHARS else SHORT


def labels(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Which blocks are main text. Blocks outside the article are not, and are nobody's neighbours."""
    kept = iter(_inner([x for x in found if not x[2]]))
    return [not x[2] and next(kept) for x in found]


def _inner(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """The labels of the blocks that the markup leaves open. Near-good blocks are kept unless both neighbours are bad; other
    ambiguous ones follow the nearest decided neighbour, the good one of two equally near.
    Without any decided block all ambiguous ones are kept."""
    rated = [rate(t, n, o) for t, n, o, _ in found]
    n = len(rated)

    def nearest(good_bad):
        before, after = [(n + 1, "")] * n, [(n + 1, "")] * n
        for i in range(n):
            before[i] = (0, good_bad[i]) if good_bad[i] in (GOOD, BAD) else (before[i - 1][0] + 1, before[i - 1][1]) if i else (n + 1, "")
        for i in range(n - 1, -1, -1):
            after[i] = (0, good_bad[i]) if good_bad[i] in (GOOD, BAD) else (after[i + 1][0] + 1, after[i + 1][1]) if i < n - 1 else (n + 1, "")
        return before, after

    before, after = nearest(rated)
    first = [
        GOOD if r == NEAR and not (b[1] == BAD and a[1] == BAD and any(x == GOOD for x in rated)) else r
        for r, b, a in zip(rated, before, after)
    ]
    inside = [not o and r != BAD for (_, _, o, _), r in zip(found, rated)]
    before, after = nearest(first)
    out = []
    for i, r in enumerate(first):
        if r in (GOOD, BAD):
            out.append(r == GOOD)
            continue
        (b, kind_b), (a, kind_a) = before[i], after[i]
        if not kind_a and not kind_b or GOOD not in (kind_a, kind_b) and GOOD not in first:
            out.append(inside[i])
        elif b == a:
            out.append(GOOD in (kind_a, kind_b))
        else:
            out.append((kind_b if b < a else kind_a) == GOOD)
    # A heading or short run right before good text belongs to it.
    for i in range(n - 2, -1, -1):
        if not out[i] and inside[i] and out[i + 1] and (found[i][3] or rated[i] == SHORT):
            out[i] = True
    return out


def main_text(page: str | None) -> str:
    """The kept blocks of a page, joined by an empty line; empty for NULL."""
    found = blocks(page) if page else []
    return "\n\n".join(b[0] for b, keep in zip(found, labels(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; pages are read whole, whatever their length.

    A NULL or empty page has an empty text. Equal rows give equal rows; other columns are left aside.
    """
    def run(page_id, url, page):
        texts = [main_text(p) for p in page.to_pylist()]
        return page_id, url, texts, [len(t) for t in texts]

    return map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), ["page_id", "url", "html"],
                     "page_id long, url string, text string, n_chars long", run)
