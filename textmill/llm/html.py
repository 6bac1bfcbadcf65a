"""Operator 1: main text of web pages, with boilerplate found by a suffix array over each host's pages.

A page is cut into blocks in page order; each is core (inside an article or main element), loose
(elsewhere) or noise (inside menus, page headers, footers, sidebars, notices, adverts, forms, reader
comments or hidden elements). Scripts, styles, markup and comments are gone by then. Noise within a
paragraph leaves it, and the paragraph stays one block. An article within an element that only its class
makes noise (a wrapper, say) is core if it is the page's only one and outweighs the loose text.

Token streams of a host's loose text are concatenated and their suffixes sorted up to ``least`` tokens:
substrings of that length on at least ``pages`` pages and ``LOOSE_SHARE`` of the host's pages are
boilerplate, and so are whole shorter blocks; covered tokens go, the unique runs stay. Core text is the
article's own, and articles quote each other and are copied, so there a block goes only as a whole, if it
stands on at least ``pages`` pages and more than ``CORE_SHARE`` of the host's, and if less than ``COPIED``
of the page's core text goes that way (else the article is a copy and stays whole). Loose text that
outweighs the core text is the page's body and stays with it, in page order; otherwise a page's text is
its core text, if any, or its loose one.

Pages are parsed once, in runs that are written as tables. A run's suffixes are sorted there, which counts
each passage's pages within the run; passages then travel as 64-bit hashes of host and text with these
counts, and the sums over all runs decide (see tallies.py). A passage is one entry for each run, however
many pages hold it, so a large host is no larger task.

Defined cases: a null html is empty; a null or unusable url makes a host of its own; null and repeated
page_ids are rows like any others, one row out for each row in; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.markup import Marks, Open
from textmill.llm import common, hashing, tallies

LEAST, PAGES = 8, 3
#: Shares of the host's pages on which boilerplate stands, and of the core text that goes if the article is a copy.
LOOSE_SHARE, CORE_SHARE, COPIED = 0.1, 0.5, 0.8
ASKED, SAID = [("key", "<u8"), ("pages", "<u4")], [("pages", "<u4")]
#: Kinds of text by the elements, roles and names that HTML and common page templates use. Fixed values.
RAW = "script style noscript template iframe textarea title svg object select xmp noembed annotation".split()
NOISE = set("nav footer aside form menu dialog button".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
WORDS = set(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header footer masthead sidebar aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login "
    "comment comments disqus share sharing social related recommended pagination pager toolbar search".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option optgroup".split()
)
#: Of the names, those that mark text of its own in any element, and those of parts that a page's articles are not in.
ADS = set("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion cookie cookies newsletter subscribe".split())
FIRM = ADS | set("comment comments disqus related recommended".split())
#: What a compound name may have after its first part, and first parts that say what the element is beside or without.
BESIDE = set("box container wrapper wrap area block section list bar item items button buttons link links slot unit zone panel group row column inner outer left right top bottom main site page global form reply thread".split())
NEGATED = set("no not has have with without is in after before".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open one of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARS = set("ul ol dl table div article section main body nav aside footer header form blockquote".split())
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CORE, LOOSE, JUNK, BURIED = 0, 1, 2, 3
FIRMLY, BY_NAME = 1, 2


@lru_cache(4096)
def noisy(names: str) -> frozenset[str]:
    """The noise words that an element's classes and id say it is: alone, last in a compound name, or first before a word like box."""
    found = set()
    for name in names.split():
        parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if parts and parts[0] not in NEGATED:
            if parts[-1] in WORDS:
                found.add(parts[-1])
            elif parts[0] in WORDS and all(x in BESIDE or x in WORDS for x in parts):
                found.add(parts[0])
    return frozenset(found)


def noise_of(tag: str, attributes: str, core: bool) -> int:
    """FIRMLY if an element's content is noise by its name, role or hiding, BY_NAME if only by class or id, else 0; core: inside an article or main."""
    if tag in NOISE or tag == "header" and not core:
        return FIRMLY
    if not attributes or tag in ("html", "body", "main", "article"):
        return 0
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")) or a.get("role", "").lower() in ROLES:
        return FIRMLY
    found = noisy(f"{a.get('class', '')} {a.get('id', '')}")
    if core:
        found = found & ADS if tag in PROSE else found - {"header"}
    return FIRMLY if found & FIRM else BY_NAME if found else 0


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order, white space collapsed, empty ones left out."""
    out: list[tuple[int, str]] = []
    stack = Open()  # each with the kind of its text, whether it is inside article or main, and whether it is noise by its class
    stack.push("", (LOOSE, False, False))
    text: dict[int, list[str]] = {}

    def flush() -> None:
        for kind, parts in text.items():
            if found := " ".join(html.unescape("".join(parts)).split()):
                out.append((kind, found))
        text.clear()

    def leave(names: set[str], bars: set[str]) -> None:
        i = stack.innermost(names)
        if i > 0 and i >= stack.innermost(bars):
            stack.cut(i)

    marks, at, head = Marks(page), 0, False
    while at < len(page):
        m = marks.next(at)
        if not head and (more := page[at : m.begin if m else len(page)]):
            text.setdefault(stack.kept[-1][0], []).append(more)
        if not m:
            break
        at, tag = m.end, m.name
        if not tag:
            continue
        if tag in RAW and not m.closing:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("head", "body"):
            head = tag == "head" and not m.closing
        elif tag in BLOCKS and tag != "html":
            head = False
        if tag == "br":
            text.setdefault(stack.kept[-1][0], []).append(" ")
        if tag in BLOCKS:
            flush()
        if m.closing:
            leave({tag}, set() if tag in BLOCKS else BARS)
        elif tag not in VOID:
            if tag in BLOCKS:
                leave({"p"}, BARS | {"td", "th", "li"})
            if tag in ENDS:
                leave(ENDS[tag], BARS - {tag})
            kind, core, named = stack.kept[-1]
            main = tag == "main" or bool(re.search(r"role\s*=\s*[\"']?main\b", m.attributes))
            core = core or main or tag == "article"
            if kind != JUNK:
                noise = noise_of(tag, m.attributes, core)
                kind, named = (JUNK, noise == BY_NAME) if noise else (kind if kind == BURIED else CORE if core else LOOSE, False)
            elif named and (main or tag == "article"):
                kind, named = CORE if main else BURIED, False
            stack.push(tag, (kind, core, named))
    flush()
    return unburied(out)


def unburied(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks with those of articles in noise as core, if the page has no other core text and less loose text, or as noise."""
    size = [sum(len(t) for k, t in found if k == kind) for kind in range(4)]
    to = CORE if not size[CORE] and size[BURIED] > size[LOOSE] else JUNK
    return [(to if k == BURIED else k, t) for k, t in found] if size[BURIED] else found


def passages(tokens: np.ndarray, page: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where substrings of ``least`` tokens start, equal ones together; a number for each substring; whether its page is new to it.

    tokens: positive numbers, with 0 after each block. The suffixes are sorted by prefix doubling up to
    ``least`` tokens; runs of equal prefixes in that order are the repeated substrings.
    """
    n = len(tokens)
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while depth < least:
        step = min(depth, least - depth)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else []
        rank, depth = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64), depth + step
    ends = np.flatnonzero(tokens == 0)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    order = np.lexsort((page, rank))
    order = order[room[order] >= least]
    r, p = rank[order], page[order]
    other = np.ones(len(order), bool)
    other[1:] = r[1:] != r[:-1]
    fresh = other.copy()
    fresh[1:] |= p[1:] != p[:-1]
    return order, np.cumsum(other) - 1, fresh


def boilerplate(tokens: np.ndarray, page: np.ndarray, least: int, pages: int) -> np.ndarray:
    """Whether each token lies in a substring of ``least`` tokens that stands on ``pages`` distinct pages."""
    order, number, fresh = passages(tokens, page, least)
    hit = order[np.bincount(number[fresh])[number] >= pages] if len(order) else order
    return hashing.covered(len(tokens), hit, hit + least)


class Run(NamedTuple):
    """A run of pages: begin and end of each token in raw, each block's first token (one more at the end), and its passages.

    lo, hi, name: first token, the one after the last, and the passage's place in asked; host: of each page, the place of its host's pages.
    """

    raw: bytes
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    name: np.ndarray
    host: np.ndarray
    asked: list[np.ndarray]


def run_of(table: pa.RecordBatch, least: int) -> Run:
    """The passages of a run of pages, from host (hashes), kinds and texts (the blocks of each page): substrings of loose text, whole short blocks of it and whole blocks of core text."""
    host, texts = hashing.mixed(table.column("host").to_numpy().astype(np.uint64), 1), table.column("texts")
    kind = table.column("kinds").flatten().to_numpy()
    raw = ("\n".join(texts.flatten().to_pylist()) + "\n").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    at = np.concatenate([[0], np.flatnonzero(data == 10) + 1]) if len(kind) else np.zeros(1, np.int64)
    begin, end, first = hashing.words(data, at)
    sums, count = hashing.prefix_sums(data), np.diff(first)
    page = np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy())
    own = host[page] if len(page) else np.zeros(0, np.uint64)
    # the stream of loose blocks, with 0 after each
    loose = np.flatnonzero(kind == LOOSE)
    n = count[loose]
    token = np.repeat(first[loose], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.arange(n.sum()) + np.repeat(np.arange(len(n)), n)
    stream = np.zeros(n.sum() + len(n), np.int64)
    stream[place] = np.unique(hashing.stretch(sums, begin[token], end[token]) + np.repeat(own[loose], n), return_inverse=True)[1] + 1
    order, _, _ = passages(stream, np.repeat(page[loose], n + 1), least)
    lo = token[np.searchsorted(place, order)]
    lo_page = np.repeat(page[loose], n)[np.searchsorted(place, order)]
    keys = hashing.mixed(hashing.stretch(sums, begin[lo], end[lo + least - 1] if len(lo) else lo) + host[lo_page], 2)
    whole = np.flatnonzero((count > 0) & ((kind == CORE) | (kind == LOOSE) & (count < least)))
    blocks_ = hashing.mixed(hashing.stretch(sums, begin[first[whole]], end[first[whole + 1] - 1]) + own[whole] + kind[whole].astype(np.uint64), 3)
    pages = np.concatenate([lo_page, page[whole], np.arange(len(host))])
    order, head, name = tallies.grouped(np.concatenate([keys, blocks_, hashing.mixed(host, 4)]))
    on = np.unique(name * (len(host) + 1) + pages) // (len(host) + 1)
    asked = [np.concatenate([keys, blocks_, hashing.mixed(host, 4)])[order[head]], np.bincount(on, minlength=len(head)).astype(np.uint32)]
    k = len(keys) + len(blocks_)
    return Run(raw, begin, end, first, np.concatenate([lo, first[whole]]), np.concatenate([lo + least, first[whole + 1]]), name[:k], name[k:], asked)


def counted(keys: np.ndarray, pages: np.ndarray) -> list[np.ndarray]:
    order, head, place = tallies.grouped(keys)
    return [np.minimum(np.add.reduceat(pages[order].astype(np.int64), head), (1 << 32) - 1)[place].astype(np.uint32)]


def chosen(kinds: list[int], words: list[int], kept: list[int]) -> tuple[bool, bool, bool]:
    """Whether a page's core text stays whole, whether it counts, and whether its loose text does; by each block's words and those not covered."""
    core, core_kept, loose = (sum(n for k, n in zip(kinds, of, strict=True) if k == kind) for kind, of in ((CORE, words), (CORE, kept), (LOOSE, kept)))
    whole = core > 0 and core - core_kept >= COPIED * core and core >= loose
    return whole, core > 0, loose > (core if whole else core_kept)


def main_texts(run: Run, kinds: pa.ListArray, said: np.ndarray, pages: int) -> list[str]:
    """The text of each page of a run; said: the pages of each key asked about."""
    flat = kinds.flatten().to_numpy()
    block = np.searchsorted(run.first, run.lo, "right") - 1
    page = np.repeat(np.arange(len(kinds)), kinds.value_lengths().to_numpy())[block]
    on, of = said[run.name].astype(np.int64), said[run.host].astype(np.int64)[page]
    again = (on >= pages) & np.where(flat[block] == CORE, on > CORE_SHARE * of, on >= LOOSE_SHARE * of)
    gone = hashing.covered(len(run.begin), run.lo[again], run.hi[again])
    words = np.diff(run.first)
    kept = words - np.diff(np.concatenate([[0], np.cumsum(gone)])[run.first])
    out, b = [], 0
    begin, end = run.begin.tolist(), run.end.tolist()
    for own in kinds.to_pylist():
        n = len(own)
        whole, core, loose = chosen(own, words[b : b + n].tolist(), kept[b : b + n].tolist())
        parts = []
        for k, i in zip(own, range(b, b + n), strict=True):
            if not words[i] or not (core if k == CORE else loose and k == LOOSE):
                continue
            x, y = run.first[i], run.first[i + 1]
            if kept[i] == words[i] or whole and k == CORE:
                parts.append(run.raw[begin[x] : end[y - 1]])
            elif kept[i]:
                parts += [run.raw[begin[t] : end[t]] for t in (x + np.flatnonzero(~gone[x:y])).tolist()]
        out.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
        b += n
    return out


def parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [blocks(x) for x in batch.column("html").to_pylist()]
    kinds, texts = (pa.array([[b[i] for b in f] for f in found], t) for i, t in enumerate((pa.list_(pa.int8()), pa.list_(pa.string()))))
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), kinds, texts], names=["page_id", "url", "host", "kinds", "texts"])


def extract(pages_: DataFrame, least: int = LEAST, pages: int = PAGES) -> DataFrame:
    """page_id, url, text and n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    p = pages_.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host).alias("host"))
    runs = tallies.packed_runs(p, "html", 4, parsed)
    said = tallies.tally(runs, lambda t: run_of(t, least).asked, ASKED, counted, SAID, tallies.buckets_for(runs))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, answers in zip(batch.column("data"), batch.column("said"), strict=True):
                table = tallies.opened(data.as_buffer())
                text = main_texts(run_of(table, least), table.column("kinds"), tallies.heard(SAID, answers)[0], pages)
                cols = [table.column("page_id"), table.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    done = tallies.by_run(runs.select("run", "data"), said).select("data", "said")
    return done.mapInArrow(finish, f"page_id {dict(p.dtypes)['page_id']}, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
