"""Web pages: noise removal, blocks, Markdown, links, and lines that recur over a group.

Noise subtrees and blocks are found by passes over a page's tags, in Arrow batches and in time linear in the
page; all else is expressions. An unclosed inline element ends with its block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.arrow import text_slices
from textmill.functions.markup import Mark, Marks, Open
from textmill.functions.measures import sealed

# What marks noise, and the steps that its removal is recorded as. Fixed values.
DROPPED = "script style noscript template svg canvas iframe object embed applet param link meta base head audio video source track map area".split()
CHROME = "nav aside footer menu dialog".split()
ROLES = "navigation banner dialog alertdialog complementary search contentinfo".split()
NOISE_WORDS = (
    "ad|ads|adbox|advert|advertisement|adsense|doubleclick|banner|cookie|cookies|consent|gdpr|cmp|nav|navbar|navigation|menu|sidebar|side-bar"
    "|social|share|sharing|newsletter|subscribe|popup|modal|overlay|promo|promotion|sponsored|breadcrumb|breadcrumbs|pagination|skip-link|screen-reader-text"
)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0\s*(?:;|$)|font-size\s*:\s*0", re.I)
STEP_OF_TAG = {"script": "removed_scripts", "style": "removed_styles", "link": "removed_styles", "svg": "removed_svg"}
EMBEDS, NAVIGATION, HIDDEN, NOISE = "removed_embedded_media", "removed_navigation", "removed_hidden_elements", "removed_ads_and_banners"
CONVERTED, TITLE, DATA_URIS = "converted_to_markdown", "preserved_document_title", "dropped_data_uri_images"
# end of fixed values

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
#: Elements whose start ends an open one of these.
ENDS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
STARTS = frozenset("p div ul ol table pre blockquote h1 h2 h3 h4 h5 h6 hr section article main header form nav aside footer".split())
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOISE_NAME = re.compile(rf"(?:^|[\s_-])(?:{NOISE_WORDS})(?:[\s_-]|$)", re.I)
MARKUP = r"<\s*+(?:/\s*+)?[a-zA-Z]"


def noise_step(tag: str, attributes: str, in_article: bool) -> str | None:
    """The step that removes an element, or None if it stays."""
    if tag in DROPPED:
        return STEP_OF_TAG.get(tag, EMBEDS)
    if tag in CHROME or tag == "header" and not in_article:
        return NAVIGATION
    if not attributes:
        return None
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or tag == "input" and a.get("type", "").lower() == "hidden" or HIDDEN_STYLE.search(a.get("style", "")):
        return HIDDEN
    return NOISE if a.get("role", "").lower() in ROLES or NOISE_NAME.search(a.get("class", "")) or NOISE_NAME.search(a.get("id", "")) else None


def without_noise(page: str) -> tuple[str, list[str]]:
    """A page's markup without noise subtrees, at any depth, and the sorted steps; noise within noise counts too."""
    kept, steps, at = [], set(), 0
    marks, stack = Marks(page), Open()
    depth = -1  # of the noise element that is open, in the stack

    def leave(i: int) -> None:
        nonlocal depth
        stack.cut(i)
        if i <= depth:
            depth = -1

    while m := marks.next(at):
        if depth < 0:
            kept.append(page[at : m.begin])
        at, tag, whole = m.end, m.name, page[m.begin : m.end]
        if not tag:
            continue
        if m.closing:
            shown = depth < 0
            if (i := stack.innermost((tag,))) >= 0:
                leave(i)
            if shown:
                kept.append(whole)
            continue
        if tag in STARTS and "p" in stack.names[-3:]:
            leave(stack.innermost(("p",)))
        elif stack.names and stack.names[-1] in ENDS.get(tag, ()):
            leave(len(stack) - 1)
        step = noise_step(tag, m.attributes, stack.innermost(("article", "section")) >= 0)
        if step:
            steps.add(step)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stop = end.end() if end else len(page)
            if not step and depth < 0:
                kept.append(page[m.begin : stop])
            at = stop
            continue
        if depth < 0 and not step:
            kept.append(whole)
        if tag not in VOID and not m.attributes.endswith("/"):
            stack.push(tag)
            if depth < 0 and step:
                depth = len(stack) - 1
    if depth < 0:
        kept.append(page[at:])
    return "".join(kept), sorted(steps)


def noise_free(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for pages in text_slices(batch):
            found = [without_noise(p) if p is not None else (None, None) for p in pages.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string()))], ["content", "steps"])


def strip_page_noise(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with content (html without noise) and steps; both null for a null page."""
    return pages.withColumn("noise_free", F.arrow_udf(noise_free, "content string, steps array<string>")(F.col(html))).select(*pages.columns, "noise_free.steps", "noise_free.content")


#: Character references by name, of one character each.
NAMED = {name: text for name, text in html5.items() if name.endswith(";") and len(text) == 1}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});"
#: Names that texts use; others are looked up only where one of them occurs.
COMMON = ["amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "reg;", "trade;", "middot;", "bull;", "mdash;", "ndash;", "hellip;", "lsquo;", "rsquo;", "ldquo;", "rdquo;", "laquo;", "raquo;", "euro;", "pound;", "deg;", "times;"]


def references(names: list[str]) -> Column:
    """A constant map from references to characters."""
    return F.str_to_map(F.lit("\u0001".join(f"&{n}\u0002{NAMED[n]}" for n in names)), F.lit("\u0001"), F.lit("\u0002"))


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of c with c computed once, within lambdas too."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def replaced(c: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """c with each match of pattern (without groups) replaced by fn of it."""

    def each(x: Column) -> Column:
        parts, found = F.split(x, pattern, -1), F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), fn)
        return F.array_join(F.zip_with(parts, found, lambda p, q: F.concat(p, F.coalesce(q, F.lit("")))), "")

    return let(c, each)


def decoded(c: Column) -> Column:
    """c with character references decoded once, named and numeric ones; unknown ones stay."""

    def one(t: Column) -> Column:
        code = F.when(t.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(t, "([0-9]+);", 1)).try_cast("int")
        fine = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        number = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(t.startswith("&#"), number).otherwise(F.coalesce(F.element_at(references(COMMON), t), F.element_at(references(list(NAMED)), t))), t)

    return let(c, lambda x: F.when(F.contains(x, F.lit("&")), replaced(x, REFERENCE, one)).otherwise(x))


def decode(text: str) -> str:
    """The same of one text."""

    def one(m: re.Match[str]) -> str:
        t = m[0]
        if not t.startswith("&#"):
            return NAMED.get(t[1:], t)
        code = int(t[3:-1], 16) if t[2] in "xX" else int(t[2:-1])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else t

    return ANY_REFERENCE.sub(one, text) if "&" in text else text


ANY_REFERENCE = re.compile(REFERENCE)
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = re.compile(f"[{BLANKS}]+")
BLOCK_NAMES = frozenset("h1 h2 h3 h4 h5 h6 p li pre blockquote hr tr ul ol table div article section main header body html".split())
#: Elements that Markdown has a mark for, and links that it may keep.
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
SAFE_LINK = re.compile(rf"(?i)(?:^|[{BLANKS}])href[{BLANKS}]*=[{BLANKS}]*[\"']?[{BLANKS}]*((?:https?://|mailto:|ftp://)[^\"'{BLANKS}>]*)")
#: Within the text of a block: a line break, and marks that take the blanks after and before them.
BREAK, AFTER, BEFORE = "\u0002", "\u0003", "\u0004"
BLOCK_ROW = "kind string, level int, text string, line string, near boolean"
BLOCK_TYPE = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("line", pa.string()), ("near", pa.bool_())])


class Inline:
    """The text of a block as Markdown, from its text and tags in order: bold, emphasis, code, safe links, images, line breaks.

    A mark needs its end in the same block and some text between; other tags leave no trace.
    """

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.open: dict[str, tuple[int, str]] = {}

    def tag(self, m: Mark) -> None:
        if m.name == "br" and not m.closing:
            self.parts.append(BREAK)
        elif m.name == "img" and not m.closing:
            a = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in reversed(list(ATTRIBUTE.finditer(m.attributes)))}
            alt, src = BLANK_RUN.sub(" ", a.get("alt", "")).strip(" "), a.get("src", "").strip(" ")
            self.parts.append(alt if not src or src.lower().startswith("data:") else f"![{alt}]({src})")
        elif m.name in MARKS or m.name == "a":
            mark = MARKS.get(m.name, "a")
            if not m.closing:
                link = SAFE_LINK.search(m.attributes) if mark == "a" else None
                if mark not in self.open and (mark != "a" or link):
                    self.open[mark] = len(self.parts), link[1] if link else ""
                    self.parts.append("")
            elif mark in self.open:
                at, link = self.open.pop(mark)
                if "".join(self.parts[at + 1 :]).strip(BLANKS):
                    self.parts[at] = ("[" if mark == "a" else mark) + AFTER
                    self.parts.append(BEFORE + (f"]({link})" if mark == "a" else mark))

    def text(self) -> str:
        c = BLANK_RUN.sub(" ", "".join(self.parts))
        for mark, side in ((AFTER, AFTER + " "), (BEFORE, " " + BEFORE)):
            c = c.replace(side, "").replace(mark, "")
        for side in (" " + BREAK + " ", " " + BREAK, BREAK + " ", BREAK):
            c = c.replace(side, "\n")
        return decode(c.strip(BLANKS))


def block_rows(content: str) -> list[tuple[str, int | None, str, str, bool]]:
    """kind, level, text, line and near of a page's blocks in order: headings, paragraphs, items, table rows, preformatted text, quotes, rules and loose text.

    One pass over the tags, which keeps count of the open lists and quotes; line is a block as Markdown, and near
    says that it follows the one before without a blank line (items of a list, rows of a table).
    """
    found: list[dict] = []
    lists = quotes = tables = outer = opened = 0
    list_of: dict[int, tuple[int, str]] = {}
    number: dict[tuple[int, int], int] = {}
    tag, inline, raw = "", Inline(), []
    cells: list[Inline] | None = None
    cell: Inline | None = None

    def flush() -> None:
        nonlocal tag, inline, raw, cells, cell
        kind = "heading" if tag[:1] == "h" and tag[1:].isdigit() else "item" if tag == "li" and lists > 0 else "row" if tag == "tr" else tag if tag in ("pre", "hr") else "blockquote" if quotes > 0 else "p"
        row = {"kind": kind, "level": int(tag[1]) if kind == "heading" else None, "lists": lists, "tables": tables, "outer": outer, "cells": None}
        if kind == "row":
            row["cells"] = [x.text().replace("\n", " ").replace("|", "\\|") for x in cells or []]
            row["text"] = " | ".join(row["cells"])
        else:
            row["text"] = decode("".join(raw).strip("\n")) if kind == "pre" else inline.text()
        if kind == "item":
            row["text"] = row["text"].replace("\n", " ")
            at, row["list"] = list_of.get(lists, (0, "ul"))
        if row["text"] or kind == "hr" or row["cells"]:
            if kind == "item":
                row["number"] = number[lists, at] = number.get((lists, at), 0) + 1
            found.append(row)
        tag, inline, raw, cells, cell = "", Inline(), [], None, None

    marks, at, some = Marks(content), 0, False
    while True:
        m = marks.next(at)
        more = content[at : m.begin if m else len(content)]
        if more:
            some = some or bool(more.strip(BLANKS))
            raw.append(more)
            (inline if tag != "tr" else cell or Inline()).parts.append(more)
        if not m:
            break
        at = m.end
        if m.name in BLOCK_NAMES:
            if m.closing:
                if some or tag:
                    flush()
                lists -= m.name in ("ul", "ol")
                quotes -= m.name == "blockquote"
                some = False
                continue
            if some or tag:
                flush()
            tag, some, opened = m.name, False, opened + 1
            quotes += tag == "blockquote"
            tables += tag == "table"
            if tag in ("ul", "ol"):
                lists += 1
                list_of[lists] = opened, tag
                outer += lists == 1
            if tag == "hr":  # has no content: what follows is a block of its own
                flush()
        elif m.name in ("td", "th") and tag == "tr":
            cell = None
            if not m.closing:
                cell = Inline()
                cells = cells or []
                cells.append(cell)
        elif m.name:
            (inline if tag != "tr" else cell or Inline()).tag(m)
            some = some or m.name == "img"
    if some or tag:
        flush()
    return lines_of(found)


def lines_of(found: list[dict]) -> list[tuple[str, int | None, str, str, bool]]:
    width: dict[int, int] = {}
    for r in found:
        if r["kind"] == "row":
            width[r["tables"]] = max(width.get(r["tables"], 0), len(r["cells"]))
    out, begun, before = [], set(), None
    for r in found:
        kind, text, line = r["kind"], r["text"], r["text"]
        if kind == "heading":
            line = "#" * r["level"] + " " + text
        elif kind == "item":
            line = "  " * (r["lists"] - 1) + (f"{r['number']}. " if r["list"] == "ol" else "- ") + text
        elif kind == "row":
            n = width[r["tables"]]
            line = "| " + " | ".join([*r["cells"], *[""] * (n - len(r["cells"]))]) + " |"
            if r["tables"] not in begun:
                line += "\n|" + "---|" * n
            begun.add(r["tables"])
        elif kind == "blockquote":
            line = "> " + text.replace("\n", "\n> ")
        elif kind == "pre":
            line = "```\n" + text + "\n```"
        elif kind == "hr":
            line = "---"
        same = before is not None and before["kind"] == kind
        near = same and (kind == "item" and before["outer"] == r["outer"] or kind == "row" and before["tables"] == r["tables"])
        out.append((kind, r["level"], text, line, near))
        before = r
    return out


def rows_of_blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for contents in text_slices(batch):
            yield pa.array([None if c is None else [dict(zip(BLOCK_TYPE.names, r, strict=True)) for r in block_rows(c)] for c in contents.to_pylist()], pa.list_(BLOCK_TYPE))


def page_blocks(pages: DataFrame, content: str = "content", key: str = "page_id") -> DataFrame:
    """key, block_ix, kind, level, text and, for Markdown, line and near; see block_rows()."""
    found = F.arrow_udf(rows_of_blocks, f"array<struct<{BLOCK_ROW}>>")(F.col(content))
    return pages.select(key, F.posexplode(found).alias("block_ix", "b")).select(key, "block_ix", "b.*")


def page_markdown(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """key and markdown: blocks in order with a blank line between, items of a list and rows of a table without one."""
    each = F.concat(F.when(F.col("block_ix") == 0, "").when(F.col("near"), "\n").otherwise("\n\n"), F.col("line")).alias("line")
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", each))), lambda x: x["line"]), "").alias("markdown"))


def title_of(html: Column) -> Column:
    return decoded(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)\A(?:(?!<title\b).)*+<title\b[^>]*+>((?:(?!</title).)*+)</title", 1), r"\s+", " ")))


def with_title(pages: DataFrame, html: str = "html", markdown: str = "markdown") -> DataFrame:
    """markdown with the page's title before it unless it starts with a first-level heading."""
    titled = F.when((F.col("title") == "") | F.col(markdown).startswith("# "), F.col(markdown)).otherwise(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col(markdown)))
    return pages.withColumn("title", title_of(F.col(html))).withColumn(markdown, titled)


def clean_page(c: Column, cleaned: Column) -> Column:
    """Text without a tag-like token stays as it is."""
    return F.when(c.rlike(MARKUP), cleaned).otherwise(c)


def cleaned_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each page the steps that took noise out, and its blocks as Markdown."""
    for batch in batches:
        for pages in text_slices(batch):
            found = []
            for page in pages.to_pylist():
                content, steps = without_noise(page or "")
                rows = block_rows(content)
                found.append((steps, "".join(("" if not i else "\n" if near else "\n\n") + line for i, (*_, line, near) in enumerate(rows))))
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.string())], ["steps", "markdown"])


def pages_to_markdown(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key, cleaned and steps: pages as normalized Markdown with their titles. A page without a tag keeps its text but for the normalization."""
    from textmill.functions.text import normalize_text

    found = F.arrow_udf(cleaned_pages, "steps array<string>, markdown string")(F.col(html))
    j = with_title(pages.select(key, html, found.alias("found")).select(key, html, "found.*"), html)
    step = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    marked = F.col(html).rlike(MARKUP)
    titled = (F.col("title") != "") & F.col("markdown").startswith(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n")))
    own = F.concat(F.when(marked, F.col("steps")).otherwise(F.array().cast("array<string>")), step(marked, CONVERTED), step(marked & titled, TITLE), step(marked & F.col(html).rlike(r"(?i)<img\b[^<>]*\ssrc\s*+=\s*+[\"']?\s*+data:"), DATA_URIS))
    j = j.select(key, own.alias("own"), clean_page(F.col(html), F.col("markdown")).alias("m"))
    return normalize_text(j, "m").select(key, "cleaned", F.concat("own", "steps").alias("steps"))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, kind (link or image), target and how often; a row for each of a page's targets, quoted either way or not at all."""
    value = lambda tag, a: rf"(?is)<{tag}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\s{a}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"

    def of(tag: str, a: str, kind: str) -> DataFrame:
        found = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(value(tag, a)), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3)])
        return pages.select("page_id", F.lit(kind).alias("kind"), F.explode(found).alias("g")).select("page_id", "kind", F.concat("g.g1", "g.g2", "g.g3").alias("target"))

    return of("a", "href", "link").union(of("img", "src", "image")).groupBy("page_id", "kind", "target").agg(F.count("*").alias("n"))


def remove_recurring_lines(rows: DataFrame, group: str, member: str, line: str = "text", least: int = 3, share: float = 0.5, place: str | None = None, band: float = 0.12) -> DataFrame:
    """rows without lines that, digits folded and white space collapsed, stand on more than ``share`` of a group's members.

    With place (a row's number within its member), only rows in the first and last ``band`` of a member count and go.
    """
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"\d+", "#"), r"\s+", " ")))
    k = rows.withColumn("line_key", key)
    if place:
        own = Window.partitionBy(group, member)
        low, high = F.min(place).over(own), F.max(place).over(own)
        at = (F.col(place) - low) / F.greatest(high - low, F.lit(1))
        k = k.withColumn("in_band", (at <= band) | (at >= 1 - band))
    else:
        k = k.withColumn("in_band", F.lit(True))
    pairs = k.where("in_band").select(group, "line_key", member).distinct()
    on = pairs.groupBy(group, "line_key").agg(F.count("*").alias("on_members"))
    sizes = rows.select(group, member).distinct().groupBy(group).agg(F.count("*").alias("members"))
    chrome = on.join(sizes, group).where((F.col("members") >= least) & (F.col("on_members") > share * F.col("members"))).select(group, "line_key", F.lit(True).alias("in_band"))
    return k.join(chrome, [group, "line_key", "in_band"], "left_anti").drop("line_key", "in_band")
