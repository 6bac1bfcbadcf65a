"""Content classification: one confidence for each rule as a column, the greatest wins, the first at a tie."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.measures import sealed
from textmill.functions.text import is_json

TRUST, DECLARED = 0.7, 0.5
#: MIME types that name a content type. Fixed values.
MIME = {
    "application/json": "json",
    "text/json": "json",
    "text/html": "html",
    "application/xhtml+xml": "html",
    "application/xml": "xml",
    "text/xml": "xml",
    "text/csv": "csv",
    "text/plain": "text",
    "text/markdown": "text",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/octet-stream": "binary",
}
#: First characters that settle the type. Fixed values.
MAGIC = [("%PDF-", "pdf"), ("PK\x03\x04", "binary"), ("\x89PNG", "image"), ("\xff\xd8\xff", "image"), ("GIF87a", "image"), ("GIF89a", "image")]
#: Elements that count as markup. Fixed values.
TAGS = (
    "html head body div span p a img br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "script style link meta title noscript svg nav header footer aside main article section form input button select option textarea label "
    "strong b em i u code pre blockquote figure figcaption picture source iframe video audio"
).split()
#: Lines that read as code, a log record or a stack frame. Fixed values.
CODE_LINE = (
    r"^\s*(?:at\s+\S+|File\s+\"[^\"]+\",\s+line\s+\d+|Traceback\s+\(most\s+recent\s+call|(?:ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL)\b"
    r"|\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}|(?:import|from|def|class|function|const|let|var|public|private|return|if|for|while)\b|[#@}/*])"
)


def mime_type_of(c: Column) -> Column:
    """The content type that a MIME type declares, or null."""
    m = F.lower(F.trim(F.split_part(c, F.lit(";"), F.lit(1))))
    out = F.when(m.startswith("image/"), "image").when(m.startswith("multipart/"), "binary")
    for name, kind in MIME.items():
        out = out.when(m == name, kind)
    return out


def magic(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for head, kind in reversed(MAGIC):
        out = F.when(c.startswith(head), kind).otherwise(out)
    return out


def html_confidence(c: Column) -> Column:
    """Markup used as content, not quoted: a document's tags, or known closing tags after an opening tag or in dense markup."""
    quoted = F.contains(c, F.lit("`")) | F.contains(c, F.lit("~~~"))
    prose = F.when(quoted, F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```|~~~.*?~~~", " "), r"`[^`\n]*`", " ")).otherwise(c)
    # no tag ends behind the last >, so none is looked for there
    upto = F.substring(prose, F.lit(1), F.length(prose) - F.length(F.substring_index(prose, ">", -1)))
    pieces = F.regexp_extract_all(upto, F.lit(r"(<\s*+(?:/\s*+)?[a-zA-Z][a-zA-Z0-9]{0,14}\b[^>]*+>)"), F.lit(1))
    name = lambda t: F.lower(F.regexp_extract(t, r"^<\s*/?\s*([a-zA-Z][a-zA-Z0-9]{0,14})", 1))
    known = F.filter(pieces, lambda t: name(t).isin(TAGS))
    distinct = F.array_distinct(F.transform(known, name))
    closing = F.size(F.filter(known, lambda t: t.rlike(r"^<\s*/")))
    chars = F.aggregate(known, F.lit(0), lambda a, t: a + F.length(t))
    opens = F.regexp_replace(prose, r"(?s)\A(?:\s|<!--.*?-->)*+", "").rlike(r"^<\s*[a-zA-Z][a-zA-Z0-9]{0,14}\b")
    document = F.arrays_overlap(distinct, F.array(*map(F.lit, ("html", "body", "head"))))
    dense = chars > 0.5 * F.greatest(F.length(F.regexp_replace(prose, r"^\s++|(?<!\s)\s++$", "")), F.lit(1))
    loose = (closing >= 2) & (opens | dense)
    return F.when(~F.contains(c, F.lit("<")), F.lit(None)).when(prose.rlike(r"(?i)<!doctype\s+html") | document, 0.99).when(loose, F.least(F.lit(0.95), 0.8 + 0.02 * F.size(distinct)))


def prompt_confidence(c: Column, min_chars: int = 240, min_ratio: float = 0.15) -> Column:
    """Long prose whose lines repeat; code, logs and stack traces are refused."""
    rows = F.filter(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), lambda x: F.regexp_replace(x, r"\s", "") != "")
    code = F.size(F.filter(rows, lambda x: x.rlike(CODE_LINE)))
    again = F.size(rows) - F.size(F.array_distinct(F.transform(rows, lambda x: F.regexp_replace(x, r"^\s++|(?<!\s)\s++$", ""))))
    good = (F.size(rows) >= 2) & ~c.rlike(r"(?m)^[ \t]*Traceback \(most recent call last\):") & (code <= 0.6 * F.size(rows)) & (again >= min_ratio * F.size(rows))
    return F.when((F.length(c) >= min_chars) & good, 0.8)


def csv_delimiter(c: Column) -> Column:
    """The delimiter that each of the first 20 lines that are not blank has equally often, or null."""
    rows = F.slice(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), 1, 20)
    table = F.exists(rows, lambda x: x.rlike(r"^\s*\|?\s*:?-{3,}"))

    def fits(d: str) -> Column:
        counts = F.array_distinct(F.transform(rows, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))))
        return (F.size(rows) >= 2) & (F.size(counts) == 1) & (F.element_at(counts, 1) >= 1)

    return F.when(table, F.lit(None)).when(fits(","), ",").when(fits("\t"), "\t").when(fits(";"), ";")


def detect(df: DataFrame, text: str = "text", mime: str | None = None, prompts: bool = False, csv: bool = False, extra: list | None = None) -> DataFrame:
    """df with content_type, confidence and source. extra: (name, type, fn from text Column to confidence) of registered rules."""
    c = F.col(text)
    rules = [("magic-bytes", magic(c), F.when(magic(c).isNotNull(), 1.0)), ("json-parse", F.lit("json"), F.when(is_json(c), 0.99)),
             ("xml-declaration", F.lit("xml"), F.when(c.rlike(r"(?i)^\s*<\?xml\s"), 0.95)), ("html-structure", F.lit("html"), html_confidence(c))]
    if csv:
        rules.append(("csv-structure", F.lit("csv"), F.when(csv_delimiter(c).isNotNull(), 0.85)))
    if prompts:
        rules.append(("prompt-structure", F.lit("prompt"), prompt_confidence(c)))
    rules += [(name, F.lit(kind), fn(c)) for name, kind, fn in extra or []]
    rules.append(("fallback", F.lit("text"), F.lit(0.1)))
    every = [F.struct(F.coalesce(conf, F.lit(-1.0)).cast("double").alias("confidence"), F.lit(-k).alias("order"), kind.alias("content_type"), F.lit(name).alias("source")) for k, (name, kind, conf) in enumerate(rules)]
    out = df.withColumn("best", F.array_max(F.array(*every)))
    if mime:
        said = mime_type_of(F.col(mime))
        use = (F.col("best.confidence") < TRUST) & said.isNotNull()
        out = out.withColumn("best", F.when(use, F.struct(F.lit(DECLARED).alias("confidence"), F.lit(-99).alias("order"), said.alias("content_type"), F.lit("content-type-header").alias("source"))).otherwise(F.col("best")))
    return sealed(out.select(*df.columns, "best.content_type", "best.confidence", "best.source"), "content_type", "confidence", "source")


def route(c: Column) -> Column:
    """The cleaner for a content type, by priority, or null where the text stays as it is."""
    return F.when(c == "html", "html").when(c == "json", "json").when(c == "csv", "csv").when(c == "prompt", "prompt").when(c.isin("text", "unknown"), "text")


#: Document formats by media type and by extension. Fixed values.
MEDIA_FORMATS = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "text/csv": "csv",
    "application/xml": "xml",
    "text/xml": "xml",
    "text/html": "html",
    "text/markdown": "markdown",
    "text/plain": "text",
}
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "csv": "csv", "tsv": "csv", "xml": "xml", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text"}
BINARY = ("pdf", "docx", "xlsx", "pptx")
#: Folders that tell the office formats' archives apart. Fixed values.
OFFICE = {"docx": b"word/", "xlsx": b"xl/", "pptx": b"ppt/"}


def little_endian(b: Column, at: Column | int, n: int) -> Column:
    """The number in n bytes of b from an offset on."""
    each = [F.substring(b, (F.lit(at) if isinstance(at, int) else at) + 1 + k, F.lit(1)) for k in reversed(range(n))]
    return F.conv(F.hex(F.concat(*each)), 16, 10).try_cast("long")


def office_format(data: Column) -> Column:
    """docx, xlsx or pptx by the names in a ZIP archive's central directory, or null.

    The end record is the last one in the final 65,557 bytes (its comment has 65,535 at most); the directory's
    entries, of which each says how long it is, are folded over.
    """
    tail = F.hex(F.substring(data, F.greatest(F.octet_length(data) - 65_556, F.lit(1)), F.lit(65_557)))
    end = F.unhex(F.regexp_extract(tail, "^(?:..)*(504B0506(?:..){18}).*$", 1))

    def listed(end: Column) -> Column:
        size, offset = little_endian(end, 12, 4), little_endian(end, 16, 4)
        fine = (F.octet_length(end) == 22) & (size + offset <= F.octet_length(data))
        directory = F.substring(data, (offset + 1).cast("int"), size.cast("int"))
        return F.when(fine, let(F.struct(directory.alias("bytes"), little_endian(end, 10, 2).cast("int").alias("entries")), named))

    def named(directory: Column) -> Column:
        def entry(state: Column, _: Column) -> Column:
            head = F.substring(directory["bytes"], state["at"] + 1, F.lit(46))
            name = F.substring(directory["bytes"], state["at"] + 47, F.lit(5))
            fine = F.startswith(head, F.lit(b"PK\x01\x02")) & (F.octet_length(head) == 46)
            after = state["at"] + 46 + little_endian(head, 28, 2) + little_endian(head, 30, 2) + little_endian(head, 32, 2)
            found = [(state[kind] | fine & F.startswith(F.substring(name, F.lit(1), little_endian(head, 28, 2).cast("int")), F.lit(folder))).alias(kind) for kind, folder in OFFICE.items()]
            return F.struct(F.when(fine, after).otherwise(state["at"]).cast("int").alias("at"), *found)

        none = F.struct(F.lit(0).alias("at"), *[F.lit(False).alias(kind) for kind in OFFICE])
        names = F.aggregate(F.sequence(F.lit(1), F.greatest(directory["entries"], F.lit(1))), none, entry)
        return let(names, lambda n: F.coalesce(*[F.when(n[kind], kind) for kind in OFFICE]))

    return let(end, listed)


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of c with c computed once."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def detect_format(data: Column, media: Column, filename: Column) -> Column:
    """A document's format from its first bytes, else from its media type and extension; ZIP archives by the names in their directory.

    Text is UTF-8 without NUL in its first 4096 bytes, of which the last character may be cut.
    """
    head = F.substring(data, 1, 4096)
    starts = lambda x: F.startswith(head, F.lit(x))
    whole = F.is_valid_utf8(head.cast("string"))
    for k in range(1, 4):
        whole |= (F.octet_length(data) > 4096) & F.is_valid_utf8(F.substring(head, F.lit(1), F.octet_length(head) - k).cast("string"))
    textual = whole & ~F.contains(head, F.lit(b"\x00"))
    text = F.lower(F.make_valid_utf8(head.cast("string")))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    declared = F.element_at(table(MEDIA_FORMATS), F.lower(F.trim(F.split_part(F.coalesce(media, F.lit("")), F.lit(";"), F.lit(1)))))
    by_name = F.element_at(table(EXTENSIONS), F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^.]*)$", 1)))
    binary = F.when(declared.isin(*BINARY), declared).otherwise("unknown")
    return (
        F.when(F.coalesce(F.octet_length(data), F.lit(0)) == 0, "unknown").when(starts(b"%PDF-"), "pdf").when(starts(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), "unknown")
        .when(starts(b"PK\x03\x04"), F.coalesce(office_format(data), F.when(declared.isin(*BINARY[1:]), declared), F.lit("unknown")))
        .when(textual & text.rlike(r"^\s*\x{feff}?<\?xml"), "xml").when(textual & text.rlike(r"^\s*(<!doctype html|<html)"), "html")
        .when(textual, F.coalesce(declared, by_name, F.lit("text"))).otherwise(binary)
    )
