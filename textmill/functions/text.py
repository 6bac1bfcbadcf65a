"""Text cleaning as column expressions: line ends, trailing blanks, blank lines, repeated paragraphs, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.measures import sealed, token_count

#: Names of steps as they appear in results, and what people read. Fixed values.
LABELS = {
    "removed_scripts": "Removed scripts",
    "removed_styles": "Removed styles",
    "removed_svg": "Removed SVG graphics",
    "removed_embedded_media": "Removed embedded media",
    "removed_navigation": "Removed navigation",
    "removed_ads_and_banners": "Removed ads and cookie banners",
    "removed_hidden_elements": "Removed hidden elements",
    "converted_to_markdown": "Converted HTML to Markdown",
    "preserved_document_title": "Preserved document title",
    "dropped_data_uri_images": "Dropped data-URI images",
    "minified_json": "Minified JSON",
    "removed_empty_containers": "Removed empty containers",
    "collapsed_duplicate_keys": "Collapsed duplicate keys",
    "normalized_line_endings": "Normalized line endings",
    "stripped_trailing_whitespace": "Stripped trailing whitespace",
    "collapsed_blank_lines": "Collapsed blank lines",
    "collapsed_inline_whitespace": "Collapsed duplicated whitespace",
    "removed_duplicate_paragraphs": "Removed duplicated paragraphs",
    "removed_duplicate_list_items": "Removed duplicate instructions",
    "removed_duplicate_blocks": "Removed duplicate instruction block",
    "removed_duplicate_sentences": "Removed repeated sentence",
    "extracted_document": "Extracted document to Markdown",
}
ACRONYMS = {"html": "HTML", "json": "JSON", "csv": "CSV", "xml": "XML", "pdf": "PDF", "docx": "DOCX"}
#: Where a paragraph that is not blank begins; blank ones stay with the one before them.
PARAGRAPH = r"\n\n(?=[\s&&[^\n]]*(?:\n(?!\n)[\s&&[^\n]]*)*\S)"


def distinct_paragraphs(c: Column) -> Column:
    """c without a paragraph that equals, stripped, the last one kept; blank ones stay."""
    keyed = F.transform(F.split(c, PARAGRAPH, -1), lambda p: F.struct(p.alias("text"), F.regexp_replace(p, r"(?U)^\s++|(?<!\s)\s++$", "").alias("key")))

    def own(rows: Column) -> Column:
        """What stays of each paragraph: all, or the blank ones after it, or nothing."""

        def one(x: Column, i: Column) -> Column:
            same = (i > 0) & (x["key"] != "") & (x["key"] == F.element_at(rows, F.greatest(i, F.lit(1)))["key"])
            return F.when(same, F.nullif(F.regexp_replace(x["text"], r"(?s)\A(?:(?!\n\n).)*+(?:\n\n)?", ""), F.lit(""))).otherwise(x["text"])

        return F.array_join(F.array_compact(F.transform(rows, one)), "\n\n")

    return F.element_at(F.transform(F.array(keyed), own), 1)


def normalize_text(df: DataFrame, column: str = "text", inline: bool = False, max_blank_lines: int = 1, paragraphs: bool = True) -> DataFrame:
    """df with cleaned and steps: the steps that changed the text, in order.

    Each stage is a projection of its own over the last one's column, so that no expression is repeated.
    """
    stages = [("normalized_line_endings", lambda c: F.regexp_replace(c, "\r\n|\r", "\n")), ("stripped_trailing_whitespace", lambda c: F.regexp_replace(c, "(?m)(?<![ \t])[ \t]++$", ""))]
    if inline:
        stages.append(("collapsed_inline_whitespace", lambda c: F.regexp_replace(c, "[ \t]{2,}", " ")))
    stages.append(("collapsed_blank_lines", lambda c: F.regexp_replace(c, f"\n{{{max_blank_lines + 2},}}", "\n" * (max_blank_lines + 1))))
    if paragraphs:
        stages.append(("removed_duplicate_paragraphs", distinct_paragraphs))
    out = df.withColumn("cleaned", F.col(column)).withColumn("steps", F.array().cast("array<string>"))
    for name, fn in stages:
        out = out.withColumn("next", fn(F.col("cleaned")))
        out = out.withColumn("steps", F.when(F.col("next") != F.col("cleaned"), F.concat("steps", F.array(F.lit(name)))).otherwise(F.col("steps")))
        out = out.withColumn("cleaned", F.col("next")).drop("next")
    out = out.withColumn("next", F.regexp_replace("cleaned", r"(?U)\A\s++|(?<!\s)\s++\z", ""))
    only = (F.size("steps") == 0) & (F.col("next") != F.col("cleaned"))
    out = out.withColumn("steps", F.when(only, F.array(F.lit("stripped_trailing_whitespace"))).otherwise(F.col("steps"))).withColumn("cleaned", F.col("next")).drop("next")
    return sealed(out, "cleaned", "steps")


def json_kind(c: Column) -> Column:
    """1 for a JSON object or array, 2 for one of which some object repeats a key, else 0; the cheap look at the ends comes before the parse.

    The strict parse refuses a repeated key; the lenient one then decides, for texts that use nothing else
    it is lenient about (single quotes, control characters in strings). Each step is taken once.
    """

    def one(t: Column) -> Column:
        ends = (F.length(t) >= 2) & F.substring(t, 1, 1).isin("{", "[") & F.substring(t, -1, 1).isin("}", "]")
        bare = F.regexp_replace(t, r'"[^"\\\x00-\x1f]*+(?:\\.[^"\\\x00-\x1f]*+)*+"', "")
        lenient = F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$").isNotNull()
        return F.when(~ends, 0).when(F.try_parse_json(t).isNotNull(), 1).when(~bare.rlike("['\"]") & lenient, 2).otherwise(0)

    begins = c.rlike(r"\A\s*+[{\[]")  # what does not is not stripped: that would read all of it
    return F.coalesce(F.when(begins, F.element_at(F.transform(F.array(stripped(c)), one), 1)), F.lit(0))


def is_json(c: Column) -> Column:
    """Whether c is a JSON object or array, keys repeated or not."""
    return json_kind(c) > 0


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s++|(?<!\s)\s++$", "")


def minify_json(c: Column) -> Column:
    """c without insignificant white space if it is JSON, key order and literals as written."""
    return F.when(is_json(c), F.regexp_replace(c, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+', "$1")).otherwise(c)


def decode_base64(c: Column) -> Column:
    """White space stripped, padded to a multiple of four, strict alphabet; null where invalid or empty."""
    bare = F.regexp_replace(c, r"\s+", "")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    return F.when(bare != "", F.try_to_binary(padded, F.lit("base64")))


def decode_text(c: Column) -> Column:
    """Bytes to text: by the byte order mark, else lenient UTF-8."""
    head = F.hex(F.substring(c, 1, 3))
    utf16 = F.decode(c, "UTF-16")
    lenient = lambda b: F.make_valid_utf8(b.cast("string"))
    return F.when(head == "EFBBBF", lenient(F.substring(c, 4, (1 << 31) - 1))).when(head.rlike("^(FFFE|FEFF)"), utf16).otherwise(lenient(c))


def humanize_step(c: Column) -> Column:
    """The reading label of a step's name: a known one, a format's, or its words, acronyms in capitals and the first letter, too."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    of_format = F.substring(c, 8, 10_000)
    extracted = F.concat(F.lit("Extracted "), F.coalesce(F.element_at(table(ACRONYMS), of_format), F.upper(of_format)))
    words = F.filter(F.split(c, "_"), lambda w: w != "")
    words = F.transform(words, lambda w, i: F.coalesce(F.element_at(table(ACRONYMS), w), F.when(i == 0, F.when(w == F.upper(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))).otherwise(w)))
    plain = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(c)
    return F.coalesce(F.element_at(table(LABELS), c), F.when(c.startswith("format_"), extracted).otherwise(plain))


def cleaned_documents(df: DataFrame) -> DataFrame:
    """df with cleaned, steps, and tokens and bytes before and after, growth undone."""
    from textmill.functions.measures import never_grow, with_savings

    out = normalize_text(df)
    out = out.withColumn("tokens_before", token_count(F.col("text"))).withColumn("tokens_after", token_count(F.col("cleaned")))
    return with_savings(never_grow(out))
