"""Main text of web pages by a site style tree: one tree per host, entropy decides what is noise."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import map_batches, stored

#: A host needs so many pages for its tree to tell noise from text.
MIN_PAGES = 5
#: Branches below this importance go; the node's own content weighs GAMMA, its parent's layout the rest.
MIN_IMPORTANCE = 0.3
GAMMA = 0.9
#: Steps of a path that tell nodes apart.
DEPTH = 8

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

_RAW = frozenset("script style textarea noscript template iframe svg math title xmp object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_NOISE_TAGS = frozenset("nav aside form footer button select dialog menu head fieldset option input".split())
_MAIN_TAGS = frozenset(("article", "main"))
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted "
    "banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments "
    "commentlist disqus reply replies respond discussion cookie cookies notice notices consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "widgets toolbar pagination pager disclaimer legal copyright skip search hidden".split()
)
#: Start tags that end an open element of the same group.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


@dataclass
class Page:
    """Elements in document order (parents first) and blocks of text pieces."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    step: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    noise: list[bool] = field(default_factory=lambda: [False])
    holds_main: list[bool] = field(default_factory=lambda: [False])
    children: list[list[str]] = field(default_factory=lambda: [[]])
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)

    def path(self, node: int) -> str:
        steps = []
        while node > 0 and len(steps) < DEPTH:
            steps.append(self.step[node])
            node = self.parent[node]
        return ">".join(reversed(steps))


def _look(tag: str, attrs: str) -> tuple[str, bool]:
    """Style step of an element, and whether tag, role or names say it is no article text."""
    if not attrs:
        return tag, tag in _NOISE_TAGS or tag == "header"
    names, noise = [], tag in _NOISE_TAGS or tag == "header"
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            noise = True
        elif key == "role":
            noise |= value.lower() in _NOISE_ROLES
        elif key in ("class", "id"):
            noise |= any(w.lower() in _NOISE_WORDS for w in _PART.findall(value))
            if key == "class":
                names = sorted(_DIGITS.sub("0", value).split())
    return ".".join([tag, *names]), noise and tag not in ("html", "body")


def parse(source: str) -> Page:
    """Elements and blocks of a page; unclosed and stray tags as browsers take them, roughly."""
    page, stack, block, at = Page(), [0], [], 0

    def flush() -> None:
        nonlocal block
        if block:
            page.blocks.append(block)
            block = []

    def text(piece: str) -> None:
        if piece:
            block.append((stack[-1], html.unescape(piece) if "&" in piece else piece))

    def close(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if page.tag[stack[i]] in names:
                del stack[i:]
                return True
            if page.tag[stack[i]] in scope:
                return False
        return False

    while True:
        m = _TAG.search(source, at)
        text(source[at : m.start() if m else len(source)])
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, end, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _RAW:  # no text of the page; what stands around it stays one block
            if not end:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = stop.end() if stop else len(source)
            continue
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            text(" ")
        if end:
            if tag not in _VOID:
                close((tag,), ("td", "th", "table") if tag in ("p", "b", "i", "a", "span") else ())
            continue
        if tag not in _INLINE:
            # a new block ends an open paragraph, with what is open inside it
            close(("p",), ("div", "article", "section", "main", "td", "th", "li", "body", "blockquote", "table", "ul", "ol", "form", "aside", "nav"))
        if tag in _ENDS:
            close(_ENDS[tag], _SCOPE[tag])
        step, noise = _look(tag, attrs)
        page.children[stack[-1]].append(tag)
        if tag in _VOID or attrs.endswith("/"):
            continue
        page.tag.append(tag)
        page.step.append(step)
        page.parent.append(stack[-1])
        page.noise.append(noise)
        page.holds_main.append(False)
        page.children.append([])
        node = len(page.tag) - 1
        if tag in _MAIN_TAGS and not noise:
            up = stack[-1]
            while up >= 0 and not page.holds_main[up]:
                page.holds_main[up] = True
                up = page.parent[up]
        stack.append(node)
    flush()
    return page


def zones(page: Page) -> tuple[list[bool], list[bool]]:
    """Per element: inside what its look calls noise; inside an article or main element."""
    dropped, main = [False], [False]
    for i in range(1, len(page.tag)):
        up = page.parent[i]
        main.append(main[up] or page.tag[i] in _MAIN_TAGS)
        # a wrapper named after its side column, and the head of an article, are no noise
        own = page.noise[i] and not page.holds_main[i] and not (page.tag[i] == "header" and main[up] and page.step[i] == "header")
        dropped.append(dropped[up] or own)
    return dropped, main


def _squeezed(pieces: Iterator[str]) -> str:
    return " ".join("".join(pieces).split())


def has_article(page: Page, dropped: list[bool], main: list[bool]) -> bool:
    return any(m and not d for m, d in zip(main, dropped, strict=True))


def lines_of(page: Page) -> Iterator[tuple[list[tuple[int, str]], str]]:
    """Blocks with the text that the look leaves of them: that of articles, or all where there are none."""
    dropped, main = zones(page)
    inside = has_article(page, dropped, main)
    for block in page.blocks:
        yield block, _squeezed(t for node, t in block if not dropped[node] and (main[node] or not inside))


def text_of(page: Page) -> str:
    """Text blocks of the article by the look alone, one per line.

    With an article or main element (outside noise), its text; else all text.
    """
    return "\n".join(line for _, line in lines_of(page) if line)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _parsed(batch: pa.RecordBatch) -> Iterator[dict]:
    """Per page its elements (path, parent's path, children) and blocks (path, parent's path, content, line).

    ``judged`` blocks are those the tree may leave out. ``lead`` is the smallest sentence hash
    of an article, null on pages without one; ``sign`` names the host and its judged paths.
    """
    names = ("page_id", "url", "host", "path", "parent", "children", "at", "above", "content", "line", "judged", "lead", "sign")
    out = {k: [] for k in names}
    for row in batch.to_pylist():
        page = parse(row["html"] or "")
        dropped, main = zones(page)
        paths = [_hash(page.path(i)) for i in range(len(page.tag))]
        blocks = [(b[0][0], _squeezed(t for _, t in b), line) for b, line in lines_of(page)]
        blocks = [b for b in blocks if b[1]]
        judged = [bool(line) and not dropped[node] for node, _, line in blocks]
        asked = sorted({paths[node] for (node, _, _), j in zip(blocks, judged, strict=True) if j})
        told = (_hash(x) for _, _, line in blocks if line for x in _SENTENCE.split(line))
        lead = min(told, default=0) if has_article(page, dropped, main) else None
        for k, v in zip(names, (
            row["page_id"], row["url"], row["host"], paths[1:], [paths[i] for i in page.parent[1:]],
            [_hash(" ".join(c)) for c in page.children[1:]], [paths[node] for node, _, _ in blocks],
            [paths[max(0, page.parent[node])] for node, _, _ in blocks], [_hash(whole) for _, whole, _ in blocks],
            [line for _, _, line in blocks], judged, lead,
            xxhash.xxh3_128_digest(f"{row['host']} {asked}"),
        ), strict=True):
            out[k].append(v)
        if len(out["host"]) >= 200:
            yield out
            out = {k: [] for k in names}
    yield out


_PARSED = {
    "page_id": "long", "url": "string", "host": "string", "path": "longs", "parent": "longs", "children": "longs", "at": "longs",
    "above": "longs", "content": "longs", "line": "strings", "judged": "booleans", "lead": "long", "sign": "binary",
}


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, path, shown, importance) of the content nodes that the tree may leave out.

    Same-host pages are merged by path. A node's importance is the entropy of what it shows
    over all its appearances, as a share of the largest possible (1 for one appearance):
    GAMMA of its content's, the rest of its parent's layout's. Articles with the same smallest
    sentence hash are (near) copies, so what they share is shown once: a copied article is no
    noise, a box that stands in many different articles is. Counts are combined in the map tasks, so a host with
    a third of all pages weighs no more than its distinct nodes.
    """
    layout = parsed.select("host", F.explode(F.arrays_zip("path", "parent", "children")).alias("e")).select(
        "host", "e.path", "e.parent", F.lit("layout").alias("kind"), F.col("e.children").alias("feature"),
        F.lit(False).alias("open"), F.lit(None).cast("bigint").alias("lead"),
    )
    content = parsed.select("host", "lead", F.explode(F.arrays_zip("at", "above", "content", "judged")).alias("e")).select(
        "host", F.col("e.at").alias("path"), F.col("e.above").alias("parent"), F.lit("content").alias("kind"),
        F.col("e.content").alias("feature"), F.col("e.judged").alias("open"),
        F.when(F.col("e.judged"), F.col("lead")).alias("lead"),
    )
    seen = (
        layout.unionByName(content).groupBy("host", "path", "parent", "kind", "feature", "lead")
        .agg(F.count("*").alias("n"), F.max("open").alias("open"))
        .withColumn("n", F.when(F.col("lead").isNull(), F.col("n")).otherwise(1))
        .groupBy("host", "path", "parent", "kind", "feature").agg(F.sum("n").alias("n"), F.max("open").alias("open"))
    )
    n = F.sum("n")
    entropy = F.when(n <= 1, 1.0).otherwise((F.log(n) - F.sum(F.col("n") * F.log("n")) / n) / F.log(n))
    nodes = seen.groupBy("host", "path", "parent", "kind").agg(entropy.alias("entropy"), n.alias("shown"), F.max("open").alias("open"))
    content = nodes.filter("kind = 'content' and open")
    layout = (
        nodes.filter("kind = 'layout'").groupBy("host", "path")
        .agg((F.sum(F.col("entropy") * F.col("shown")) / F.sum("shown")).alias("around"))
        .select("host", F.col("path").alias("parent"), "around")
    )
    return content.join(layout, ["host", "parent"], "left").select(
        "host", "path", "shown",
        (GAMMA * F.col("entropy") + (1 - GAMMA) * F.coalesce("around", F.col("entropy"))).alias("importance"),
    )


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Two passes: the first parses each page once, stores its elements and blocks and merges the
    pages of each host into a style tree; the second leaves out of each page the blocks of low
    importance, inside articles as outside. What tags, roles and class names call navigation,
    header, footer, side column, notice, advert, form or comments goes whatever its importance.
    Copies of an article stay whole: the tree counts what they share once.

    Null html is empty: empty text, 0 characters. Null or odd urls share the host of none.
    Repeated pages and a null page_id are extracted row by row. Other columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn(
        "host", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    )
    parsed = stored(map_batches(base, _parsed, _PARSED))
    low = (
        style_tree(parsed).filter((F.col("shown") >= MIN_PAGES) & (F.col("importance") < MIN_IMPORTANCE) & (F.col("host") != ""))
        .select("host", "path").distinct()
    )
    # pages of a host with the same judged paths lose the same ones: told once for all of them
    paths = F.array_distinct(F.transform(F.filter(F.arrays_zip("at", "judged"), lambda b: b["judged"]), lambda b: b["at"]))
    asked = parsed.select("sign", "host", F.explode(paths).alias("path")).distinct()
    noise = stored(asked.join(low, ["host", "path"]).groupBy("sign").agg(F.collect_set("path").alias("low")))
    gone = F.coalesce("low", F.array().cast("array<bigint>"))
    stay = F.filter(
        F.arrays_zip("at", "judged", "line"), lambda b: (b["line"] != "") & ~(b["judged"] & F.array_contains(gone, b["at"]))
    )
    return (
        parsed.select("page_id", "url", "at", "judged", "line", "sign").join(noise, "sign", "left")
        .select("page_id", "url", F.array_join(F.transform(stay, lambda b: b["line"]), "\n").alias("text"))
        .withColumn("n_chars", F.char_length("text").cast("bigint"))
    )
