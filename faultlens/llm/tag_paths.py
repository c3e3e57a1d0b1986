"""Main text of web pages by tag-path ratios.

A page is read once, tag by tag. Every piece of text belongs to the path of open tags from the root
to it; over all pieces of a path, text length and punctuation are summed and divided by the number of
pieces. Both ratios are smoothed over the pieces in page order, fused (length times punctuation), and the
paths that reach a share of the page's best fused value are content. The content node is the
deepest element that holds nearly all content, or the article around it; all of its blocks are
returned but those in parts that are never article text (menus, forms, adverts, reader comments, ...). Names of parts
are evidence: whole names of a known kind, and words that tell of comments or adverts in longer names, the
latter weighed against where the page's text and heading are.

Cases: null or empty html, and pages without content, give empty text. References are decoded once,
after the tags are found; unknown ones stay as written. Unclosed and stray tags, tags cut off at the
end, and any depth are read without recursion. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultlens.llm.blocks import text_slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover"
    " munderover mmultiscripts mtable mtr mtd mpadded mphantom semantics annotation annotation-xml".split()
)
NEVER = frozenset("head nav footer aside form script style noscript template iframe button select option svg dialog menu object".split())
#: Words of class, id and role names of parts that are not the article. They count in names made of them and
#: of PLACES only ("sidebar-left", not "no-sidebar"), and never for an element around an article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices"
    " alert popup modal overlay newsletter subscribe signup sidebar side aside menu navigation nav navbar breadcrumb breadcrumbs"
    " footer foot comment comments reply replies disqus discussion share sharing social related recommended widget login".split()
)
#: Those that also name parts of articles: dropped only if no text in them has a tag path of the content.
UNSURE = frozenset("discussion related recommended side foot notice notices alert social share sharing menu login promotion sponsor widget".split())
PLACES = frozenset("left right top bottom box list section area wrapper container inner slot block panel bar links buttons unit".split())
#: Words that tell of comments and adverts in names with any other words ("user-comments", "google-ads"): such a block
#: goes if the rest of the page has its heading or most of its text.
TELLING = frozenset("comment comments commenter commentlist disqus respond reply replies ads adsbygoogle advert adverts advertisement advertising sponsored".split())
DENIED = frozenset("no not non without has have with hide disable disabled open closed off".split())
HEADS = frozenset("header masthead topbar".split())  # not article text, unless they stand inside the article
ARTICLE = frozenset(("article", "main"))
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?…。、，！？；：]")

SHARE = 0.1  # of the best fused value: a path with at least so much is content
HOLDS = 0.8  # of the content's length: an element with at least so much holds the article


def _smooth(values: np.ndarray) -> np.ndarray:
    """Weights 1, 2, 1 over neighbours in page order."""
    padded = np.concatenate((values[:1], values, values[-1:]))
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def _marked(words: list[str], known: frozenset[str]) -> bool:
    return any(w in known for w in words) and all(w in MARKED or w in PLACES for w in words)


def _tells(words: list[str]) -> bool:
    return any(w in TELLING for w in words) and not any(w in DENIED for w in words)


def main_text(page: str | None, share: float = SHARE, holds: float = HOLDS) -> str:
    if not page:
        return ""
    tags, parents, never, mark, path_of = ["#"], [0], [False], [0], [0]  # elements; mark 1: not article text, 2: perhaps not, 3: a telling name
    paths: dict[tuple[int, str], int] = {}
    stack, open_tags = [0], {}
    blocks: list[tuple[str, int, list[tuple[int, int, int]]]] = []  # text, element, its pieces
    buffer: list[str] = []
    pieces: list[tuple[int, int, int]] = []  # path, length, punctuation
    owner = 0

    def flush() -> None:
        nonlocal buffer, pieces
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((text, owner, pieces))
            buffer, pieces = [], []

    def say(text: str) -> None:
        nonlocal owner
        if text:
            text = entities.unescape(text)
            if not buffer:
                owner = stack[-1]
            buffer.append(text)
            size = len(text.strip())
            if size:
                pieces.append((path_of[stack[-1]], size, len(_MARKS.findall(text))))

    def close(upto: int) -> None:
        for element in stack[upto:]:
            open_tags[tags[element]] -= 1
        del stack[upto:]

    def close_last(names: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if tags[stack[i]] in names:
                close(i)
                return

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m[1] or m[4]:
            if open_tags.get(name):
                close_last({name})
            continue
        if name in PARAGRAPH_ENDS and open_tags.get("p"):
            close_last({"p"})
        if (ends := SAME_ENDS.get(name)) and any(open_tags.get(x) for x in ends):
            top = tags[stack[-1]]
            if top in ends or top in INLINE or top == "p":
                close_last(ends)
        if name in VOID:
            continue
        above = stack[-1]
        own = len(tags)
        tags.append(name)
        parents.append(above)
        path_of.append(paths.setdefault((path_of[above], name), len(paths) + 1))
        inside = any(open_tags.get(x) for x in ARTICLE)
        tokens = [_WORDS.findall(x) for v in _NAMES.findall(m[3] or m[6] or "") for x in v.strip("\"'").lower().split()]
        never.append(name in NEVER or (not inside and name in HEADS))
        kind = 0
        if name not in ARTICLE:
            if name not in ("body", "html") and any(_marked(t, MARKED) for t in tokens):
                kind = 1 if any(_marked(t, MARKED - UNSURE) for t in tokens) else 2
            if not inside and any(w in HEADS for t in tokens for w in t):
                kind = 1
            if kind != 1 and name not in INLINE and name not in ("body", "html") and any(_tells(t) for t in tokens):
                kind = 3
        mark.append(kind)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if (m[3] or m[6] or "").endswith("/") and name in ("svg", "path", "math"):
            continue
        stack.append(own)
        open_tags[name] = open_tags.get(name, 0) + 1
    flush()

    around = [name in ARTICLE and not never[e] for e, name in enumerate(tags)]
    for e in range(len(tags) - 1, 0, -1):
        around[parents[e]] |= around[e] and not never[e]
    mark = [0 if around[e] else k for e, k in enumerate(mark)]
    if 3 in mark:
        # Telling names are weighed: length and headings below each element, of text that may be the article's.
        gone, below, heads = [False] * len(tags), np.zeros(len(tags)), np.zeros(len(tags))
        for e in range(1, len(tags)):
            gone[e] = gone[parents[e]] or never[e] or mark[e] == 1
        for text, e, _ in blocks:
            below[e] += 0 if gone[e] else len(text)
            heads[e] += tags[e] == "h1" and not gone[e]
        for e in range(len(tags) - 1, 0, -1):
            below[parents[e]] += below[e]
            heads[parents[e]] += heads[e]
        mark = [k if k != 3 else int(2 * below[e] < below[0] or (heads[0] > 0 and not heads[e])) for e, k in enumerate(mark)]

    def left_out() -> list[bool]:
        out = [False] * len(tags)
        for e in range(1, len(tags)):
            out[e] = out[parents[e]] or never[e] or mark[e] > 0
        return out

    outside = left_out()
    held = [i for i, (_, element, _) in enumerate(blocks) if not outside[element]]
    if not held:
        # Names alone don't empty a page.
        mark = [0] * len(tags)
        outside = left_out()
        held = [i for i, (_, element, _) in enumerate(blocks) if not outside[element]]
    if not held:
        return ""
    # Ratios of the paths over the whole page, then smoothed over the pieces in page order.
    path = np.array([p for _, _, own in blocks for p, _, _ in own], np.int64)
    length = np.array([n for _, _, own in blocks for _, n, _ in own], float)
    marks = np.array([k for _, _, own in blocks for _, _, k in own], float)
    block = np.repeat(np.arange(len(blocks)), [len(own) for _, _, own in blocks])
    if not len(path):
        return ""
    number = np.bincount(path)[path]
    fused = _smooth(np.bincount(path, length)[path] / number) * (1 + _smooth(np.bincount(path, marks)[path] / number))
    total = np.bincount(path, fused)[path] / number
    usable = ~np.array([outside[e] for _, e, _ in blocks])[block]
    if 2 in mark:
        if not usable.any():
            return ""
        content_paths = set(path[usable & (total >= share * total[usable].max())].tolist())
        kept = [False] * len(tags)
        for _, e, own in blocks:
            kept[e] |= any(p in content_paths for p, _, _ in own)
        for e in range(len(tags) - 1, 0, -1):
            kept[parents[e]] |= kept[e] and mark[e] != 1 and not never[e]
        mark = [0 if k == 2 and kept[e] else k for e, k in enumerate(mark)]
        outside = left_out()
        held = [i for i, (_, element, _) in enumerate(blocks) if not outside[element]]
        usable = ~np.array([outside[e] for _, e, _ in blocks])[block]
    chosen = usable & (total >= share * total[usable].max())
    content = np.bincount(block, np.where(chosen, length, 0), len(blocks))
    # Content length under each element; children come after their parents.
    weight = np.zeros(len(tags))
    for i in held:
        weight[blocks[i][1]] += content[i]
    for e in range(len(tags) - 1, 0, -1):
        weight[parents[e]] += weight[e]
    node = 0
    for e in range(1, len(tags)):
        # An element's parent is the node so far: go down as long as one child holds nearly all.
        if parents[e] == node and weight[e] >= holds * weight[0]:
            node = e
    up, lifted = node, False
    while up:
        if tags[up] in ARTICLE:
            node, lifted = up, True
        up = parents[up]
    under = [False] * len(tags)
    under[node] = True
    for e in range(node + 1, len(tags)):
        under[e] = under[parents[e]]
    inside = [i for i in held if under[blocks[i][1]]]
    if not lifted and tags[node] in ("#", "html", "body"):
        # No element of its own: from the first to the last content block, with headings above.
        spans = [k for k, i in enumerate(inside) if content[i]]
        first = spans[0]
        while first and tags[blocks[inside[first - 1]][1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            first -= 1
        inside = inside[first : spans[-1] + 1]
    return "\n".join(blocks[i][0] for i in inside)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", share: float = SHARE) -> DataFrame:
    """Key, url, text and n_chars (code points) of every page."""
    kinds = f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` {pages.schema[url].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "_page"):
            texts = [main_text(x, share) for x in piece.column("_page").to_pylist()]
            columns = [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [key, url, "text", "n_chars"])

    narrow = pages.select(pages[key].alias("_key"), pages[url].alias("_url"), pages[page].alias("_page"))
    return narrow.mapInArrow(run, f"{kinds}, text string, n_chars long")
