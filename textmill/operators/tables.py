"""Delimited tables: delimiter inference, empty rows and columns, Markdown rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")
MAX_COLUMNS, MAX_ROWS = 12, 50


def infer_delimiter(lines: DataFrame, first: int = 20) -> DataFrame:
    """file and delimiter from (file, ix, line): width times one more than the rows as wide as the header, best first."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy("ix"))
    head = lines.withColumn("n", rank).where(F.col("n") <= first)
    each = head.select("file", "n", "line", F.posexplode(F.array(*map(F.lit, DELIMITERS))).alias("order", "delimiter"))
    width = F.length("line") - F.length(F.replace("line", F.col("delimiter"), F.lit(""))) + 1
    each = each.withColumn("width", width)
    top = F.max_by("width", -F.col("n")).over(Window.partitionBy("file", "order"))
    each = each.withColumn("head", top)
    s = each.groupBy("file", "order", "delimiter").agg(F.max("head").alias("head"), F.count("*").alias("n_rows"), F.count_if(F.col("width") == F.col("head")).alias("agree"))
    score = F.when((F.col("n_rows") >= 2) & (F.col("head") >= 2), F.col("head") * (1 + F.col("agree"))).otherwise(0)
    best = s.groupBy("file").agg(F.max(F.struct(score.alias("score"), (-F.col("order")).alias("o"), "delimiter")).alias("b"))
    return best.select("file", F.when(F.col("b.score") > 0, F.col("b.delimiter")).otherwise(",").alias("delimiter"))


def drop_empty(df: DataFrame, header_counts: bool = True) -> DataFrame:
    """Rows with a cell that is not blank; columns with one, or (header_counts) with a header."""
    full = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    out = df.where(F.expr(" or ".join(f"coalesce(trim(cast(`{c}` as string)) <> '', false)" for c in df.columns)))
    if header_counts:
        return out
    kept = df.agg(*[F.bool_or(full(c)).alias(c) for c in df.columns]).first()
    return out.select(*[c for c in df.columns if kept and kept[c]])


def table_to_markdown(df: DataFrame, group: str, order: str, columns: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """group and markdown of each group's rows; more than max_rows rows or 12 columns become fenced compact CSV."""
    cell = lambda c: F.replace(F.replace(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    flat = F.concat_ws(",", *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"), flat.alias("f")))).alias("r"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    md = F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["l"]), "\n"))
    csv = F.concat(F.lit("```csv\n" + ",".join(columns) + "\n"), F.array_join(F.transform("r", lambda x: x["f"]), "\n"), F.lit("\n```"))
    wide = (F.size("r") > max_rows) | F.lit(len(columns) > MAX_COLUMNS)
    return rows.select(group, F.when(wide, csv).otherwise(md).alias("markdown"))


def csv_cells(line: Column, delimiter: Column) -> Column:
    """The trimmed cells of a line; a quoted cell may hold the delimiter, and a doubled quote stands for one."""
    pattern = F.concat(F.lit(r'("(?:[^"]|"")*"|[^'), F.when(delimiter == "\t", r"\t").otherwise(F.concat(F.lit("\\"), delimiter)), F.lit("]*)(?:"), F.when(delimiter == "\t", r"\t").otherwise(F.concat(F.lit("\\"), delimiter)), F.lit("|$)"))
    cells = F.regexp_extract_all(F.concat(line, delimiter), pattern, F.lit(1))
    cells = F.slice(cells, 1, F.size(cells) - 1)
    return F.transform(cells, lambda x: F.trim(F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)))


def csv_to_markdown(text: Column, delimiter: Column) -> Column:
    """struct(cleaned, steps): a delimited text as a Markdown table without empty rows and columns (a header alone fills none); null if it has under two rows."""
    raw = F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n", -1)
    raw = F.when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    blank = lambda cells: F.forall(cells, lambda c: c == "")
    table = F.transform(raw, lambda x: csv_cells(x, delimiter))

    def kept(every: Column) -> Column:
        def columns(rows: Column) -> Column:
            width = F.array_max(F.transform(rows, F.size))
            body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
            filled = F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists(body, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
            return F.struct(rows.alias("rows"), filled.alias("filled"), (F.size(filled) < width).alias("narrower"), (F.size(rows) < F.size(every)).alias("fewer"))

        rows = F.filter(every, lambda r: ~blank(r))
        return F.element_at(F.transform(F.array(rows), lambda r: F.when(F.size(r) >= 2, columns(r))), 1)

    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))

    def rendered(t: Column) -> Column:
        row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(t["filled"], lambda i: cell(F.get(r, i))), " | "), F.lit(" |"))
        lines = F.transform(t["rows"], row)
        rule = F.concat(F.lit("|"), F.array_join(F.transform(t["filled"], lambda i: F.lit("---|")), ""))
        steps = F.array_compact(F.array(F.when(t["fewer"], "removed_empty_rows"), F.when(t["narrower"], "removed_empty_columns"), F.lit("converted_to_markdown_table")))
        done = F.struct(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n").alias("cleaned"), steps.alias("steps"))
        return F.when(F.size(t["filled"]) > 0, done)

    found = F.element_at(F.transform(F.array(table), kept), 1)
    return F.element_at(F.transform(F.array(found), rendered), 1)
