"""All registered queries of the library, each over whole tables, and their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill import views
from textmill.functions import json_text, measures, text
from textmill.operators import dedupe, detect, json_rows, pages, policy, rules, segments, store, tables
from textmill.plans import analytics, optimize, report
from textmill.sources import requests as sources
from textmill.streaming import state, streams
from textmill.views import DIRTY, EVENTS, spread, table, tokens_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB text."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return put


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{views.shared_folder(spark)}/textmill-{name}-{uuid.uuid4().hex}"


# Texts -----------------------------------------------------------------------------------------

#: normalize_text in DuckDB over ``dirty``: t1 to t6, then what the first four steps changed.
NORMAL = DIRTY + r""",
n1 as (select doc_id, lang, text, regexp_replace(text, '\r\n|\r', chr(10), 'g') as t1 from dirty),
n2 as (select *, regexp_replace(t1, '[ \t]+(\n|$)', '\1', 'g') as t2 from n1),
n4 as (select *, regexp_replace(t2, '\n{3,}', chr(10) || chr(10), 'g') as t4 from n2),
pp as (select doc_id, i, p, trim(p, chr(32) || chr(9) || chr(10)) as k from (select doc_id, unnest(string_split(t4, chr(10) || chr(10))) as p, generate_subscripts(string_split(t4, chr(10) || chr(10)), 1) as i from n4)),
pk as (select *, lag(k) over (partition by doc_id order by i) as before from (select * from pp where k <> '')),
pj as (select doc_id, string_agg(p, chr(10) || chr(10) order by i) as t5 from (select doc_id, i, p from pp where k = '' union all select doc_id, i, p from pk where before is null or before <> k) group by doc_id),
n6 as (select n4.*, coalesce(t5, '') as t5, trim(coalesce(t5, ''), chr(32) || chr(9) || chr(10)) as t6 from n4 left join pj using (doc_id)),
normal as (select *, list_filter([case when t1 <> text then 'normalized_line_endings' end, case when t2 <> t1 then 'stripped_trailing_whitespace' end,
  case when t4 <> t2 then 'collapsed_blank_lines' end, case when t5 <> t4 then 'removed_duplicate_paragraphs' end], lambda x: x is not null) as fired from n6),
normalized as (select doc_id, lang, text, t6 as cleaned, case when len(fired) = 0 and t6 <> t5 then ['stripped_trailing_whitespace'] else fired end as steps from normal)"""
CASES = NORMAL + f""",
counted as (select *, {tokens_sql("text")} as before, {tokens_sql("cleaned")} as after from normalized),
cases as (select doc_id, lang, lang as kind, case when after > before then text else cleaned end as cleaned, case when after > before then [] else steps end as steps, before as tokens_before,
  least(before, after) as tokens_after, strlen(text) as bytes_before, strlen(case when after > before then text else cleaned end) as bytes_after from counted)"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    return text.cleaned_documents(views.dirty_documents(spark, d)).withColumn("case_id", F.col("doc_id")).withColumn("kind", F.col("lang"))


@query(f"with {CASES} select lang, count(*) as documents, cast(sum(tokens_before) as bigint) as tokens_before, cast(sum(tokens_after) as bigint) as tokens_after, cast(sum(tokens_before - tokens_after) as bigint) as tokens_saved from cases group by lang")
def text_savings_by_lang(spark, d):
    """The flagship: documents cleaned, measured, growth undone, by language."""
    return cases(spark, d).groupBy("lang").agg(F.count("*").alias("documents"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"), F.sum("tokens_saved").alias("tokens_saved"))


@query(f"with {NORMAL} select doc_id, length(cleaned) as n_chars, md5(cleaned) as cleaned_md5, array_to_string(steps, ',') as steps from normalized")
def text_normalize(spark, d):
    c = text.normalize_text(views.dirty_documents(spark, d))
    return c.select("doc_id", F.length("cleaned").cast("long").alias("n_chars"), F.md5("cleaned").alias("cleaned_md5"), F.array_join("steps", ",").alias("steps"))


@query(f"""select 'documents' as kind, count(*) as n, cast(sum({tokens_sql("text")}) as bigint) as tokens, cast(sum(strlen(text)) as bigint) as bytes from documents
union all select 'pages', count(*), cast(sum({tokens_sql("html")}) as bigint), cast(sum(strlen(html)) as bigint) from pages
union all select 'turns', count(*), cast(sum({tokens_sql("text")}) as bigint), cast(sum(strlen(text)) as bigint) from conversations""")
def measure_tokens_bytes(spark, d):
    def of(kind, name, c):
        t = spread(table(spark, d, name).select(c))
        return t.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(measures.token_count(F.col(c))).alias("tokens"), F.sum(F.octet_length(c).cast("long")).alias("bytes"))

    return of("documents", "documents", "text").union(of("pages", "pages", "html")).union(of("turns", "conversations", "text"))


@query(f"with {CASES} select doc_id, tokens_before, tokens_after, tokens_before - tokens_after as tokens_saved, bytes_before - bytes_after as bytes_saved, len(steps) > 0 as changed from cases")
def measure_savings(spark, d):
    return cases(spark, d).select("doc_id", "tokens_before", "tokens_after", "tokens_saved", "bytes_saved", "changed")


@query(f"select conv_id, turn, case conv_id % 3 when 1 then 'cl100k_base' else 'o200k_base' end as encoding, {tokens_sql('text')} as tokens, false as exact from conversations")
def measure_counters(spark, d):
    known = spark.createDataFrame([("gpt-4o", "o200k_base"), ("gpt-4", "cl100k_base")], "model_name string, encoding string")
    turns = table(spark, d, "conversations").withColumn("model", F.expr("case conv_id % 3 when 0 then 'gpt-4o' when 1 then 'gpt-4' else 'other' end"))
    return measures.with_counter(turns, known).select("conv_id", "turn", "encoding", "tokens", "exact")


@query(f"with {CASES} select case step when 'removed_duplicate_paragraphs' then 'Removed duplicated paragraphs' else upper(step[1]) || replace(step[2:], '_', ' ') end as label, count(*) as n from (select unnest(steps) as step from cases) group by 1")
def text_step_labels(spark, d):
    return cases(spark, d).select(F.explode("steps").alias("step")).select(text.humanize_step(F.col("step")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""select event_id, case k % 4 when 0 then '{"k":' || k || ',"s":"a  b\\" c",  "t":[ ]}' when 1 then '{"k":' || k || ',"k":[1.50,"x y"]}' when 2 then '{"k" : ' || k || ',, }' else '{"k":' || k || '}' end as minified
from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events)""".replace('",  "t":[ ]}', '","t":[]}'))
def json_minify(spark, d):
    """Properties written with blanks, with a repeated key, or broken; only what is JSON is compacted."""
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    wide = F.expr("""case k % 4 when 0 then concat('{\\n "k" : ', k, ' , "s": "a  b\\\\" c",  "t": [ ] }') when 1 then concat('{"k": ', k, ', "k" : [1.50, "x y"]}\\n') when 2 then concat('{"k" : ', k, ',, }') else concat(' { "k": ', k, '} ') end""")
    return e.select("event_id", text.minify_json(wide).alias("minified"))


@query("select s_suppkey, s_name as decoded from supplier")
def base64_decode(spark, d):
    s = table(spark, d, "supplier").withColumn("b", F.regexp_replace(F.base64(F.col("s_name").cast("binary")), "=+$", ""))
    return s.select("s_suppkey", text.decode_text(text.decode_base64(F.col("b"))).alias("decoded"))


# Duplicates ------------------------------------------------------------------------------------

LINES = DIRTY + r""",
ln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ix from dirty),
lf as (select *, trim(line, chr(32) || chr(9) || chr(13)) as k, regexp_matches(line, '^\s{0,3}#{1,6}\s+\S|^[A-Za-z][A-Za-z0-9 _/&-]{0,40}:\s*$') as is_heading from ln),
li as (select *, not is_heading and regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s+\S') as is_item, coalesce(last_value(case when is_heading then k end ignore nulls) over (partition by doc_id order by ix), '') as heading from lf)"""


@query(f"with {LINES} select doc_id, count(*) as n_lines, cast(sum(case when is_item and n > 1 then 1 else 0 end) as bigint) as n_removed from (select *, row_number() over (partition by doc_id, heading, is_item, k order by ix) as n from li) group by doc_id")
def dedupe_list_items(spark, d):
    docs = views.dirty_documents(spark, d)
    kept = dedupe.dedupe_list_items(docs).groupBy("doc_id").agg(F.count("*").alias("kept"))
    n = docs.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    return n.join(kept, "doc_id", "left").select("doc_id", "n_lines", (F.col("n_lines") - F.coalesce("kept", F.lit(0))).alias("n_removed"))


@query(f"""with {LINES}, bl as (select *, sum(case when k = '' then 1 else 0 end) over (partition by doc_id order by ix) as block from li),
bb as (select doc_id, block, string_agg(rtrim(line, chr(32) || chr(9) || chr(13)), chr(10) order by ix) as key, bool_and(is_item) as items_only, count(*) = 1 as single,
  first(case when is_heading then k end order by ix) as opens from bl where k <> '' group by doc_id, block),
br as (select *, not items_only and row_number() over (partition by doc_id, items_only, key order by block) > 1 as again, single and opens is not null as bare from bb),
bc as (select *, min(case when not again or bare then block end) over (partition by doc_id, opens) < block as claimed from br)
select doc_id, count(*) as n_blocks, cast(sum(case when case when bare then claimed else again end then 1 else 0 end) as bigint) as n_removed from bc group by doc_id""")
def dedupe_blocks(spark, d):
    docs = views.dirty_documents(spark, d)
    n = dedupe.blocks(dedupe.lines(docs)).groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
    kept = dedupe.dedupe_blocks(docs).groupBy("doc_id").agg(F.count("*").alias("kept"))
    return n.join(kept, "doc_id", "left").select("doc_id", "n_blocks", (F.col("n_blocks") - F.coalesce("kept", F.lit(0))).alias("n_removed"))


@query(r"""with ln as (select doc_id, unnest(string_split(replace(text, '. ', '. Yes. Yes. '), chr(10))) as line from documents),
p as (select doc_id, line, string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as parts, not contains(line, '`') and not regexp_matches(line, '^\s{0,3}#{1,6}\s+\S|^[A-Za-z][A-Za-z0-9 _/&-]{0,40}:\s*$')
  and not regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s+\S') as eligible from ln),
k as (select doc_id, line, eligible, parts, list_filter(parts, lambda x, i: i = 1 or x <> parts[i - 1] or x = '') as own from p)
select doc_id, count(*) filter (where eligible and len(own) < len(parts)) as changed_lines, cast(sum(length(case when eligible and len(own) < len(parts) then array_to_string(own, ' ') else line end)) as bigint) as n_chars from k group by doc_id""")
def dedupe_sentences(spark, d):
    """Documents with a sentence said twice after each of theirs."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.replace("text", F.lit(". "), F.lit(". Yes. Yes. ")).alias("text"))
    return dedupe.dedupe_sentences(docs).groupBy("doc_id").agg(F.count_if("changed").alias("changed_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(None)
def dedupe_prompts(spark, d):
    """Rows only, as it iterates to a fixed point; the tests hold it against a loop over lines."""
    return dedupe.dedupe_prompts(views.dirty_documents(spark, d)).select("doc_id", F.length("cleaned").alias("n_chars"), F.array_join("steps", ",").alias("steps"))


@query("select sha256(text) as digest, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def dedupe_exact(spark, d):
    return dedupe.dedupe_exact(table(spark, d, "documents"))


@query("with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '') as k from documents) select doc_id, len(k) as n_lines, len(k) - len(list_distinct(k)) as n_repeats from l")
def dedupe_line_ratio(spark, d):
    return dedupe.duplicate_line_ratio(table(spark, d, "documents")).select("doc_id", F.col("n_lines").cast("long"), F.col("n_repeats").cast("long"))


@query("""select event_id, cast(1 + k % 3 as bigint) as duplicates from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events)""")
def json_duplicate_keys(spark, d):
    """Events' properties with one key repeated, twice to four times over two levels."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    extra = F.when(k >= 1, ',"k": 1').otherwise("")
    inner = F.when(k >= 2, '{"a": 1, "b": ["a"], "a": "x\\"}, {"}').otherwise('{"a": {"a": 1}}')
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"k": "k:", "k": 2'), extra, F.lit(', "o": '), inner, F.lit("}")).alias("text"))
    return json_rows.duplicate_keys(e, "event_id", "text")


@query("select s_suppkey, to_json(struct_pack(name := s_name, kept := [struct_pack(n := s_nationkey)])) as pruned from supplier")
def json_prune_empty(spark, d):
    s = table(spark, d, "supplier")
    v = F.struct(F.col("s_name").alias("name"), F.array(F.struct(F.col("s_nationkey").alias("n")), F.struct(F.lit(None).cast("int").alias("n"))).alias("kept"), F.struct(F.array().cast("array<int>").alias("x")).alias("gone"))
    return s.select("s_suppkey", F.to_json(json_rows.prune_empty(v, s.select(v.alias("v")).schema["v"].dataType)).alias("pruned"))


@query("""select event_id, case k % 3 when 0 then '{"a":{"x":' || event_id || '},"b":[{"k":[' || k || ',{"z":2}]},[]],"c":{}}' when 1 then '{"a":{"d":' || event_id || '},"b":{"c":1}}' else '{"a":[' || k || ',2],"b":"é \\" /"}' end as compacted,
case k % 3 when 2 then 'minified_json' else 'collapsed_duplicate_keys,minified_json' end as steps from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events)""".replace("\\\\", "\\"))
def json_collapse(spark, d):
    """Events as JSON that repeats keys at several depths, within arrays, and after unescaping; the last value stays, where the first one stood."""
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    wide = F.expr("""case k % 3 when 0 then concat('{"a": {"x": 1, "\\\\u0078": ', event_id, '}, "b": [{"k": {"k": 3}, "k": [', k, ', {"z": 1, "z": 2}]}, []], "c": {}}')
      when 1 then concat('{"a":1,"b":{"c":0,"c":1},"a":{"d":', event_id, '}}') else concat('{"a":[', k, ', 2], "b":"\\\\u00e9 \\\\" \\\\/"}') end""")
    found = measures.sealed(e.select("event_id", wide.alias("wide")), "wide").select("event_id", json_text.compact_json(F.col("wide")).alias("j"))
    return found.select("event_id", F.col("j.cleaned").alias("compacted"), F.array_join("j.steps", ",").alias("steps"))


@query("""select event_id, case k % 3 when 0 then '{"n":' || event_id || ',"s":"","z":null}' when 1 then '[' || event_id || ',"{}"]' else '{}' end as pruned, 'removed_empty_containers,minified_json' as steps
from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events)""")
def json_prune_any(spark, d):
    """Empty containers go from JSON of any shape, bottom-up."""
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    wide = F.expr("""case k % 3 when 0 then concat('{"a":{"b":[]},"n":', event_id, ',"s":"","z":null}') when 1 then concat('[[],[{}],{"x":[{"y":{}}]},', event_id, ',"{}"]') else '{"a":{"b":{"c":{}}},"d":[[[]]]}' end""")
    found = measures.sealed(e.select("event_id", wide.alias("wide")), "wide").select("event_id", json_text.compact_json(F.col("wide"), prune=True).alias("j"))
    return found.select("event_id", F.col("j.cleaned").alias("pruned"), F.array_join("j.steps", ",").alias("steps"))


# Classification and policy ---------------------------------------------------------------------


def contents(spark: SparkSession, d: str) -> DataFrame:
    of = lambda k, name, i, c: spread(table(spark, d, name).select(F.lit(k).alias("kind"), F.col(i).cast("long").alias("id"), F.col(c).alias("text")))
    return of("document", "documents", "doc_id", "text").union(of("page", "pages", "page_id", "html")).union(of("event", "events", "event_id", "props"))


@query("""with c as (select 'document' as kind, doc_id as id, text from documents union all select 'page', page_id, html from pages union all select 'event', event_id, props from events)
select kind, id, case when regexp_matches(text, '(?i)<!doctype\\s+html') then 'html' when json_valid(text) and text[1] in ('{', '[') then 'json' else 'text' end as content_type,
case when regexp_matches(text, '(?i)<!doctype\\s+html') or json_valid(text) and text[1] in ('{', '[') then 0.99::double else 0.1::double end as confidence,
case when regexp_matches(text, '(?i)<!doctype\\s+html') then 'html' when json_valid(text) and text[1] in ('{', '[') then 'json' else 'text' end as transformer from c""".replace("\\\\", "\\"))
def detect_contents(spark, d):
    return detect.detect(contents(spark, d)).withColumn("transformer", detect.route(F.col("content_type"))).select("kind", "id", "content_type", "confidence", "transformer")


@query(f"""with {DIRTY}, r as (select doc_id, text, list_filter(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: trim(x, chr(32) || chr(9)) <> '') as l from dirty)
select doc_id, length(text) >= 240 and len(l) >= 2 and len(l) - len(list_distinct(list_transform(l, lambda x: trim(x, chr(32) || chr(9))))) >= 0.15 * len(l)
and len(list_filter(l, lambda x: regexp_matches(x, '^\\s*(?:at\\s+\\S+|(?:ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL)\\b|(?:import|from|def|class|function|const|let|var|public|private|return|if|for|while)\\b|[#@}}/*])'))) <= 0.6 * len(l) as is_prompt from r""".replace("\\\\", "\\"))
def detect_prompts(spark, d):
    docs = views.dirty_documents(spark, d)
    return docs.select("doc_id", F.coalesce(detect.prompt_confidence(F.col("text")) > 0, F.lit(False)).alias("is_prompt"))


@query("select o_orderkey, case o_orderkey % 6 when 0 then ',' when 1 then ';' when 2 then chr(9) when 5 then ',' end as delimiter from orders")
def detect_csv(spark, d):
    """Orders as three lines of text: by four delimiters, one of which is none of the known, ragged, as a Markdown table, and with a semicolon within."""
    o = table(spark, d, "orders")
    sep = F.expr("case o_orderkey % 6 when 1 then ';' when 2 then chr(9) when 3 then '|' else ',' end")
    row = lambda *c: F.concat_ws(",", *c)
    t = F.concat_ws("\n", row(F.lit("key"), F.lit("status"), F.lit("day")), F.when(F.col("o_orderkey") % 6 == 4, "| --- | --- |").otherwise(F.lit("")), row("o_orderkey", "o_orderstatus", F.to_date("o_orderdate")), F.when(F.col("o_orderkey") % 6 == 5, "a,b;c,d").otherwise("x,y,z"))
    return o.select("o_orderkey", detect.csv_delimiter(F.replace(t, F.lit(","), sep)).alias("delimiter"))


DECLARED = {"Text/HTML; charset=utf-8": "html", " application/json": "json", "image/webp": "image", "x/y": None, "multipart/form-data; boundary=x": "binary", "application/zip": None, "text/markdown": "text", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "": None, "application/xml ; q": "xml"}


@query("select page_id, case page_id % 10 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(DECLARED.values()) if v) + " end as declared from pages")
def detect_mime(spark, d):
    p = table(spark, d, "pages").withColumn("mime", F.element_at(F.array(*map(F.lit, DECLARED)), F.pmod(F.col("page_id"), F.lit(10)).cast("int") + 1))
    return p.select("page_id", detect.mime_type_of(F.col("mime")).alias("declared"))


def stored_zip(name: Column, data: Column) -> Column:
    """A ZIP archive with one member that is stored as it is, and a comment."""
    number = lambda n, size: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n.cast("long")), 2 * size, "0"), F.lit("(..)"), F.lit(1))), ""))
    n, size = number(F.octet_length(name), 2), number(F.octet_length(data), 4)
    zeros = lambda k: F.lit(bytes(k))
    head = F.concat(zeros(16), size, size, n)  # versions, method, time and checksum, then the sizes
    local = F.concat(F.lit(b"PK\x03\x04"), zeros(10), zeros(4), size, size, n, zeros(2), name, data)
    entry = F.concat(F.lit(b"PK\x01\x02"), head, zeros(16), name)
    end = F.concat(F.lit(b"PK\x05\x06"), zeros(4), number(F.lit(1), 2), number(F.lit(1), 2), number(F.octet_length(entry), 4), number(F.octet_length(local), 4), number(F.lit(7), 2), F.lit(b"PK\x05word"))
    return F.concat(local, entry, end)


@query("select page_id, case page_id % 8 when 0 then 'html' when 1 then 'pdf' when 2 then case when page_id % 16 = 2 then 'docx' else 'unknown' end when 3 then 'csv' when 4 then 'text' when 7 then 'xml' else 'unknown' end as format from pages")
def detect_document_format(spark, d):
    """Pages as documents: as they are, behind the heads of other formats, cut as text with zeros and blanks, with bytes that are no text, and
    stored in ZIP archives with a comment, as the document of an office file or as text next to which its name is only content."""
    p = table(spark, d, "pages").withColumn("data", F.expr(r"""case page_id % 8 when 0 then cast(concat(' \n', html) as binary) when 1 then cast(concat('%PDF-1.7 ', html) as binary) when 2 then cast('' as binary)
        when 3 then cast(concat('page,n\n', page_id, ',10\n') as binary) when 4 then cast(concat('hello \n', regexp_replace(substring(html, 16), '<', ' ')) as binary)
        when 5 then concat(unhex('FFFE8199C328'), cast(html as binary)) when 6 then concat(cast(html as binary), unhex('00'), cast(html as binary)) else cast(concat('<?xml version="1.0"?>', html) as binary) end"""))
    office = F.col("page_id") % 16 == 2
    name, other = (F.lit(x.encode()) for x in ("word/document.xml", "notes/any-file.xml"))
    p = p.withColumn("data", F.when(F.col("page_id") % 8 == 2, F.when(office, stored_zip(name, F.col("html").cast("binary"))).otherwise(stored_zip(other, F.concat(name, F.col("html").cast("binary"))))).otherwise(F.col("data")))
    p = p.withColumn("data", F.when(F.col("page_id") % 8 == 6, F.concat(F.lit(b"\x00"), F.col("data"))).otherwise(F.col("data")))
    return p.select("page_id", detect.detect_format(F.col("data"), F.lit(None).cast("string"), F.when(F.col("page_id") % 8 == 3, "t.CSV").otherwise("t")).alias("format"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """A request log from conversations: some requests are not eligible, by rules on the id."""
    r = sources.conversations_to_requests(table(spark, d, "conversations"))
    return r.withColumn("method", F.when(F.col("request_id") % 11 == 0, "get").otherwise("post")).withColumn("content_type", F.when(F.col("request_id") % 13 == 0, "text/plain").otherwise("Application/JSON; charset=utf-8"))


@query("""select conv_id as request_id, case when conv_id % 11 = 0 then 'method_not_eligible' when conv_id % 13 = 0 then 'content_type_not_eligible' when conv_id % 4 = 3 then 'endpoint_not_eligible' end as skip_reason
from conversations group by conv_id""")
def policy_requests(spark, d):
    return policy.policy_decide(log(spark, d)).select("request_id", "skip_reason")


@query("select conv_id as request_id, case conv_id % 4 when 0 then 'chat' when 1 then 'messages' when 2 then 'responses' end as adapter from conversations group by conv_id")
def policy_adapters(spark, d):
    return log(spark, d).select("request_id", policy.route_adapter(F.col("path")).alias("adapter"))


@query("select user_id, case user_id % 3 when 0 then 'api_key' when 1 then 'oauth_token' end as kind, count(*) as n from events group by 1, 2")
def policy_auth_kind(spark, d):
    h = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("X-API-Key"), F.lit("k"))).when(F.col("user_id") % 3 == 1, F.create_map(F.lit("authorization"), F.lit("Bearer t"))).otherwise(F.create_map(F.lit("Authorization"), F.lit("Basic t")))
    return table(spark, d, "events").select("user_id", policy.auth_kind(h).alias("kind")).groupBy("user_id", "kind").agg(F.count("*").alias("n"))


@query("""select doc_id, case when doc_id % 5 = 0 then 'disabled_or_empty' when strlen(text) > 4000 then 'over_size_limit' when doc_id % 5 = 1 then 'unsupported_format' when doc_id % 5 = 2 then 'no_extractor' end as detail from documents""")
def policy_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text")).cast("binary").alias("data"), F.expr("case doc_id % 5 when 1 then 'unknown' when 2 then 'pdf' else 'text' end").alias("format"))
    return policy.document_eligibility(docs, limit=4000).select("doc_id", "detail")


# Segments and the whole chain ------------------------------------------------------------------


@query("select conv_id as request_id, count(*) as segments, cast(sum(length(text)) as bigint) as n_chars from conversations where conv_id % 4 <> 3 and text <> '' group by conv_id")
def segments_of_requests(spark, d):
    s = segments.segments(segments.parsed(log(spark, d)))
    return s.groupBy("request_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("n_chars"))


@query("select conv_id as request_id, case conv_id % 5 when 0 then 'gpt-4o' when 1 then 'm' || conv_id end as model, count(*) as turns from conversations group by conv_id")
def segments_models(spark, d):
    """Models as given, renamed, as a number, absent, and within a message only."""
    body = F.expr("""case request_id % 5 when 0 then body when 1 then replace(body, '"model":"gpt-4o"', concat('"model":"m', request_id, '"')) when 2 then replace(body, '"model":"gpt-4o"', '"model":4')
        when 3 then replace(body, '"model":"gpt-4o",', '') else replace(replace(body, '"model":"gpt-4o",', ''), '"role":', '"model":"x","role":') end""")
    r = segments.parsed(log(spark, d).drop("model").withColumn("body", body))
    n = F.coalesce(F.expr("size(try_variant_get(payload, '$.messages', 'array<variant>'))"), F.expr("size(try_variant_get(payload, '$.input', 'array<variant>'))"))
    return r.select("request_id", "model", n.cast("long").alias("turns"))


@query("select doc_id as request_id, 'text/plain' as media_type, sha256(text) as data_sha256 from documents where text <> ''")
def segments_documents(spark, d):
    docs = table(spark, d, "documents").where("text <> ''")
    source = F.struct(F.lit("base64").alias("type"), F.lit("text/plain").alias("media_type"), F.base64(F.col("text").cast("binary")).alias("data"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("document").alias("type"), source.alias("source"))).alias("content"))).alias("messages")))
    s = segments.document_segments(segments.parsed(docs.select(F.col("doc_id").alias("request_id"), body.alias("body"))))
    return s.select("request_id", "media_type", F.sha2("data", 256).alias("data_sha256"))


#: What the chain does with the turns of eligible conversations, as DuckDB's normal texts.
TURNS = NORMAL.replace(DIRTY, "dirty as (select conv_id * 100000 + turn as doc_id, role as lang, replace(text, '. ', '.  ' || chr(10)) as text from conversations where text <> '' and conv_id % 4 <> 3 and conv_id % 11 <> 0 and conv_id % 13 <> 0)") + f""",
counted as (select doc_id // 100000 as conv_id, *, {tokens_sql("text")} as before, {tokens_sql("cleaned")} as after, doc_id <> min(doc_id) over (partition by text) as hit from normalized),
done as (select *, after <= before and len(steps) > 0 as changed, case when after > before then text else cleaned end as kept from counted)"""


@query(f"""with {TURNS}, r as (select conv_id, count(*) as segments, sum(before) as tokens_before, sum(least(before, after)) as tokens_after, sum(strlen(text)) as bytes_before, sum(strlen(kept)) as bytes_after, count(*) filter (where hit) as hits,
  bool_or(changed) as applied, coalesce(string_agg(distinct case when changed then array_to_string(steps, ',') end), '') as steps from done group by conv_id),
c as (select distinct conv_id from conversations)
select c.conv_id as request_id, cast(coalesce(segments, 0) as bigint) as segments, cast(coalesce(tokens_before, 0) as bigint) as tokens_before, cast(coalesce(tokens_after, 0) as bigint) as tokens_after, cast(coalesce(bytes_before, 0) as bigint) as bytes_before,
  cast(coalesce(bytes_after, 0) as bigint) as bytes_after, cast(coalesce(hits, 0) as bigint) as cache_hits, case when hits = 0 then 'miss' when hits >= segments then 'hit' when hits > 0 then 'partial' end as cache_status, coalesce(applied, false) as applied, coalesce(steps, '') as steps,
  case when c.conv_id % 11 = 0 then 'method_not_eligible' when c.conv_id % 13 = 0 then 'content_type_not_eligible' when c.conv_id % 4 = 3 then 'endpoint_not_eligible' when not applied then 'content_already_optimal' end as skip_reason
from c left join r using (conv_id)""")
def chain_reports(spark, d):
    """Requests through policy, segments, cleaning and measures to one event for each."""
    r = log(spark, d).withColumn("body", F.replace("body", F.lit(". "), F.lit(".  \\n")))
    event = optimize.optimize(r)[1]
    return event.select("request_id", "segments", "tokens_before", "tokens_after", "bytes_before", "bytes_after", "cache_hits", "cache_status", "applied", F.array_join("steps", ",").alias("steps"), "skip_reason")


@query(f"""with {TURNS}, e as (select c.conv_id, count(d.conv_id) as lookups, coalesce(bool_or(changed), false) as applied, coalesce(sum(case when changed is not null then before end), 0) as b, coalesce(sum(least(before, after)), 0) as a, count(*) filter (where hit) as hits
  from (select distinct conv_id from conversations) c left join done d using (conv_id) group by c.conv_id)
select case conv_id % 2 when 0 then 'even' else 'odd' end as provider, count(*) as requests, count(*) filter (where applied) as optimized, cast(coalesce(sum(b) filter (where applied), 0) as bigint) as tokens_before, cast(coalesce(sum(a) filter (where applied), 0) as bigint) as tokens_after,
  cast(sum(hits) as bigint) as cache_hits, cast(sum(lookups - hits) as bigint) as cache_misses from e group by 1""")
def chain_statistics(spark, d):
    """The chain's own events through the window statistics."""
    r = log(spark, d).withColumn("body", F.replace("body", F.lit(". "), F.lit(".  \\n")))
    e = optimize.optimize(r)[1].withColumn("provider", F.when(F.col("request_id") % 2 == 0, "even").otherwise("odd"))
    return analytics.window_stats(e, "provider").select("provider", "requests", "optimized", "tokens_before", "tokens_after", "cache_hits", "cache_misses")


@query("select conv_id as request_id, bool_or(contains(text, '. ')) as any_changed, cast(sum(length(text)) as bigint) as n_chars from conversations where conv_id % 4 <> 3 and conv_id % 11 <> 0 and conv_id % 13 <> 0 group by conv_id")
def chain_bodies(spark, d):
    """Cleaned bodies, read again: the lengths of their texts."""
    r = log(spark, d).withColumn("body", F.replace("body", F.lit(". "), F.lit(".  \\n")))
    new = optimize.optimize(r)[0].join(r.select("request_id", "path"), "request_id")
    s = segments.segments(segments.parsed(new.withColumnRenamed("new_body", "body")))
    n = s.groupBy("request_id").agg(F.sum(F.length("text")).alias("n_chars"))
    return new.select("request_id", "any_changed").join(n, "request_id", "left")


@query(f"""with c as (select 'document' as kind, doc_id as id, text, trim(text, chr(32) || chr(9) || chr(10)) as cleaned from documents where text is not null union all select 'event', event_id, props, replace(props, ' ', '') from events)
select kind, id, {tokens_sql("text")} as tokens_before, {tokens_sql("cleaned")} as tokens_after, strlen(text) - strlen(cleaned) as bytes_saved, text <> cleaned as changed from c""")
def chain_preview(spark, d):
    """Texts and JSON classified, cleaned by their type's rule and measured, nothing stored."""
    out = optimize.clean(contents(spark, d).where("text is not null and kind <> 'page'"))
    return out.select("kind", "id", "tokens_before", "tokens_after", "bytes_saved", "changed")


@query(None)
def chain_pages(spark, d):
    """Pages through the same chain. Rows only: what Markdown a page gives is tested on small pages."""
    out = optimize.clean(contents(spark, d).where("text is not null and kind = 'page'"))
    return out.select("kind", "id", "content_type", "transformer", "tokens_before", "tokens_after", "bytes_saved", "changed", F.array_join("steps", ",").alias("steps"), F.md5("cleaned").alias("cleaned_md5"))


@query("select conv_id as request_id, case when conv_id % 4 = 3 then 'no_payload_adapter' when not bool_or(contains(text, '. ')) then 'content_already_optimal' end as skip_reason from conversations group by conv_id")
def chain_skip_reasons(spark, d):
    r = segments.parsed(log(spark, d).drop("model").withColumn("body", F.replace("body", F.lit(". "), F.lit(".  \\n"))))
    segs = segments.segments(r)
    return segments.skip_reason(r, segs, optimize.results(segs))


# Pages -----------------------------------------------------------------------------------------


#: Noise of the given pages in DuckDB, one element of each kind without another of its name within.
BARE = "html"
for _tag in ("script", "style", "head", "nav", "footer", "aside"):
    BARE = f"regexp_replace({BARE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
BARE = f"""regexp_replace(regexp_replace({BARE}, '(?s)<!--.*?-->', '', 'g'), '(?is)<div class="ad">.*?</div>', '', 'g')"""


@query(rf"""select page_id, array_to_string(list_sort(list_filter([case when regexp_matches(html, '(?i)<head\b') then 'removed_embedded_media' end, case when regexp_matches(html, '(?i)<script\b') then 'removed_scripts' end, case when regexp_matches(html, '(?i)<(style|link)\b') then 'removed_styles' end,
  'removed_ads_and_banners', 'removed_navigation', 'removed_hidden_elements'], lambda x: x is not null)), ',') as steps, md5(regexp_replace(regexp_replace({BARE}, '<[^>]*>', '', 'g'), '\s+', '', 'g')) as content_md5 from pages""")
def pages_noise(spark, d):
    """Pages with nested advertisements, menus in menus, a hidden element and a script with a tag in it worked in; all of it goes."""
    more = '<div class="ad"><div>Buy</div> now</div><nav>a<nav>b<nav>c</nav></nav>d</nav><p hidden>x<b>y</b></p><aside><script>"</aside>"</script>z</aside>'
    p = spread(table(spark, d, "pages")).withColumn("html", F.regexp_replace("html", "(?i)(<article\\b[^>]*>)", "$1" + more))
    p = pages.strip_page_noise(p)
    return p.select("page_id", F.array_join("steps", ",").alias("steps"), F.md5(F.regexp_replace(F.regexp_replace("content", "<[^>]*>", ""), r"\s+", "")).alias("content_md5"))


@query(r"""with t as (select page_id, regexp_replace(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1)), '\s+', ' ', 'g') as h from pages)
select page_id, md5(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) as heading_md5 from t where h <> ''""")
def pages_headings(spark, d):
    b = pages.page_blocks(pages.strip_page_noise(spread(table(spark, d, "pages"))))
    return b.where("kind = 'heading'").select("page_id", F.md5("text").alias("heading_md5"))


@query(r"""with t as (select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g')) as h from pages)
select page_id, md5('# ' || replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) as title_md5 from t""")
def pages_titles(spark, d):
    p = table(spark, d, "pages").select("page_id", "html", F.lit("").alias("markdown"))
    return pages.with_title(p).select("page_id", F.md5(F.regexp_replace("markdown", r"\n\n\z", "")).alias("title_md5"))


@query(None)
def pages_markdown(spark, d):
    """Rows only: what Markdown a page gives is tested on small pages."""
    m = pages.pages_to_markdown(spread(table(spark, d, "pages")))
    return m.select("page_id", F.length("cleaned").alias("n_chars"), F.md5("cleaned").alias("markdown_md5"), measures.token_count(F.col("cleaned")).alias("tokens"), F.array_join("steps", ",").alias("steps"))


@query(r"""with a as (select page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\shref="([^"]*)"', 1)) as u from pages)
select page_id, 'link' as kind, u as target, count(*) as n from a group by page_id, u union all select page_id, 'image', 'pic ' || page_id || '.png', 1 from pages""")
def pages_links(spark, d):
    """Links in single quotes on some pages and without on others, and an image on each."""
    html = F.expr(r"""concat(case page_id % 3 when 0 then html when 1 then regexp_replace(html, '(?i)(<a\\b[^>]*\\shref=)"([^"]*)"', "$1'$2'") else regexp_replace(html, '(?i)(<a\\b[^>]*\\shref=)"([^"\\s]+)"', '$1 $2') end, '<img alt="a > b" src=\'pic ', page_id, '.png\'>')""")
    return pages.page_links(table(spark, d, "pages").select("page_id", html.alias("html")))


@query("""with l as (select doc_id, source, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) as line from documents where text is not null),
m as (select source, doc_id, line from l union all select source, doc_id, 'page ' || doc_id || ' of ' || source from documents where doc_id % 3 > 0),
k as (select *, lower(trim(regexp_replace(line, '\\d+', '#', 'g'))) as key from m),
s as (select source, count(distinct doc_id) as members from m group by source),
c as (select source, key from k join s using (source) group by source, key, members having members >= 3 and count(distinct doc_id) > 0.5 * members)
select source, count(*) as kept from k anti join c using (source, key) group by source""".replace("\\\\", "\\"))
def pages_recurring_lines(spark, d):
    """Lines of documents by source, with a page line worked in that recurs but for its number."""
    docs = table(spark, d, "documents").where("text is not null")
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n", -1)).alias("text"))
    page = docs.where("doc_id % 3 > 0").select("source", "doc_id", F.concat(F.lit("page "), "doc_id", F.lit(" of "), "source").alias("text"))
    return pages.remove_recurring_lines(lines.union(page), "source", "doc_id").groupBy("source").agg(F.count("*").alias("kept"))


# Content-addressed results ---------------------------------------------------------------------

RULESET = store.fingerprint([("text", "1"), ("json", "1"), ("html", "1")])
OPTIONS = store.options_fingerprint({"max_blank_lines": 1, "inline": False})


@query(f"select doc_id, sha256('text' || chr(31) || coalesce(sha256(text), chr(30)) || chr(31) || '{RULESET}' || chr(31) || '1' || chr(31) || '{OPTIONS}' || chr(31) || 'heuristic' || chr(31) || coalesce(source, chr(30))) as digest from documents")
def store_digest(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", store.digest(F.col("text"), RULESET, OPTIONS, qualifier=F.col("source")).alias("digest"))


@query("select substr(sha256(string_agg(distinct lang || '@' || length(lang), ';' order by lang || '@' || length(lang))), 1, 16) as fingerprint from documents where lang is not null")
def store_fingerprint(spark, d):
    r = table(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("name"), F.length("lang").cast("string").alias("version")).distinct()
    return store.fingerprint_table(r)


@query(f"select doc_id, {tokens_sql('text')} as tokens, doc_id <> min(doc_id) over (partition by text) as cache_hit from documents where text is not null")
def store_compute_distinct(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    out = store.compute_distinct(docs, "text", lambda t: t.select("digest", measures.token_count(F.col("text")).alias("tokens")), "doc_id")
    return out.select("doc_id", "tokens", "cache_hit")


@query(f"""with old as (select distinct text from documents where doc_id % 2 = 0 and length(text) % 10 <> 0)
select doc_id, {tokens_sql('d.text')} as tokens, old.text is not null as hit from documents d left join old on old.text = d.text where d.text is not null""")
def store_incremental(spark, d):
    """Even documents are in the store, a tenth of them in an older form; all documents are asked for."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("digest", F.sha2("text", 256)).select("doc_id", "digest", "text")
    fn = lambda t: t.select("digest", measures.token_count(F.col("text")).alias("tokens"))
    even = docs.where("doc_id % 2 = 0").dropDuplicates(["digest"])
    old = fn(even).join(even.select("digest", F.length("text").alias("n")), "digest").select("digest", "tokens", F.when(F.col("n") % 10 == 0, 0).otherwise(1).alias("schema_version"))
    return store.incremental(docs, old, fn)[0].select("doc_id", "tokens", "hit")


def access(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access"), F.min("ts").alias("created_at"), F.sum(F.floor(F.col("value") * 100)).cast("long").alias("bytes"))


ACCESS = "a as (select user_id as key, max(ts) as last_access, min(ts) as created_at, cast(sum(floor(value * 100)) as bigint) as bytes from events group by user_id)"


@query(f"with {ACCESS} select key from a where epoch(created_at) + 864000 > epoch((select max(last_access) from a)) - 1728000")
def store_live_entries(spark, d):
    a = access(spark, d)
    now = F.col("top") - F.expr("interval 20 days")
    return store.live_entries(a.crossJoin(F.broadcast(a.agg(F.max("last_access").alias("top")))), now, 864000).select("key")


@query(f"with {ACCESS}, b as (select * from a where bytes <= 20000000), r as (select key, bytes, row_number() over (order by last_access desc, key) as rank, sum(bytes) over (order by last_access desc, key rows unbounded preceding) as total from b) select key, bytes, rank from r where rank <= 200 and total <= 20000000")
def store_evict(spark, d):
    return store.evict(access(spark, d), 200, 20_000_000).select("key", "bytes", F.col("rank").cast("long").alias("rank"))


@query("""select count(*) filter (where event_type in ('view', 'click')) as hits, count(*) filter (where event_type = 'purchase') as misses, count(*) filter (where event_type = 'signup') as stores,
count(*) filter (where event_type = 'error') as errors, 0::bigint as corrupted, count(*) filter (where event_type in ('view', 'click', 'purchase')) as lookups,
round(count(*) filter (where event_type in ('view', 'click')) / count(*) filter (where event_type in ('view', 'click', 'purchase')), 4) as hit_rate from events""")
def store_stats(spark, d):
    e = table(spark, d, "events").select(F.expr("case event_type when 'view' then 'hit' when 'click' then 'hit' when 'purchase' then 'miss' when 'signup' then 'store' else 'error' end").alias("outcome"))
    return store.cache_stats(e)


@query("select doc_id as name, case when doc_id % 7 = 0 then 'added' when doc_id % 11 = 0 then 'removed' else 'changed' end as status from documents where text is not null and (doc_id % 7 = 0 or doc_id % 11 = 0 or doc_id % 13 = 0)")
def store_drift(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("name"), "text")
    lock = docs.where("name % 7 <> 0").select("name", store.checksum(F.when(F.col("name") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r\n")))).alias("checksum"))
    return store.checksum_drift(docs.where("name % 7 = 0 or name % 11 <> 0"), lock)


@query(ORACLE["store_drift"])
def store_drift_by_bucket(spark, d):
    """The same against a lock in buckets with a digest each, of which equal ones are not read."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("name"), "text")
    path = shared(spark, "lock")
    store.write_lock(docs.where("name % 7 <> 0").withColumn("text", F.when(F.col("name") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r\n")))), path)
    return store.lock_drift(docs.where("name % 7 = 0 or name % 11 <> 0"), path)


# Analytics -------------------------------------------------------------------------------------

STATS = """count(*) as requests, count(*) filter (where applied) as optimized, count(*) filter (where not applied) as skipped,
cast(coalesce(sum(tokens_before) filter (where applied), 0) as bigint) as tokens_before, cast(coalesce(sum(tokens_after) filter (where applied), 0) as bigint) as tokens_after,
cast(coalesce(sum(bytes_before) filter (where applied), 0) as bigint) as bytes_before, cast(coalesce(sum(bytes_after) filter (where applied), 0) as bigint) as bytes_after,
cast(sum(cache_hits) as bigint) as cache_hits, cast(sum(greatest(0, cache_lookups - cache_hits)) as bigint) as cache_misses, cast(sum(cast(round(execution_time_ms * 1000) as bigint)) as bigint) as latency_us"""
NAMES = ["requests", "optimized", "skipped", "tokens_before", "tokens_after", "bytes_before", "bytes_after", "cache_hits", "cache_misses", "latency_us", "tokens_saved", "bytes_saved", "avg_latency_us"]
DERIVED = "tokens_before - tokens_after as tokens_saved, bytes_before - bytes_after as bytes_saved, cast(floor(latency_us / requests) as bigint) as avg_latency_us"


@query(f"with {EVENTS}, s as (select provider, {STATS} from oe group by provider) select *, {DERIVED} from s")
def analytics_by_provider(spark, d):
    return analytics.window_stats(views.optimization_events(spark, d), "provider").select("provider", *NAMES)


@query(f"with {EVENTS}, s as (select cast(ts as date) as day, {STATS} from oe group by rollup (cast(ts as date))) select *, {DERIVED} from s")
def analytics_rollup(spark, d):
    return analytics.window_stats_rollup(views.optimization_events(spark, d)).select("day", *NAMES)


TALLY = EVENTS + ", x as (select unnest(string_split(transformers_csv, ',')) as transformer, (tokens_before - tokens_after) // len(string_split(transformers_csv, ',')) as share, ts, event_id from oe where applied and transformers_csv <> '')"


@query(f"with {TALLY} select transformer, count(*) as uses, cast(sum(share) as bigint) as tokens_saved from x group by transformer")
def analytics_tallies(spark, d):
    return analytics.transformer_tallies(views.optimization_events(spark, d)).select("transformer", "uses", "tokens_saved")


@query(f"with {TALLY} select transformer, count(*) as uses, cast(sum(share) as bigint) as tokens_saved from x group by transformer order by tokens_saved desc, min(ts) limit 1")
def analytics_top_transformer(spark, d):
    return analytics.top_transformer(views.optimization_events(spark, d))


@query(f"with {EVENTS} select event_id, provider, applied from oe order by ts desc, event_id desc limit 100")
def analytics_recent(spark, d):
    return analytics.recent(views.optimization_events(spark, d), 500).select("event_id", "provider", "applied")


@query(f"with {EVENTS} select event_id, provider, applied, tokens_before from oe order by ts desc, event_id desc limit 1")
def analytics_last(spark, d):
    return analytics.last_event(views.optimization_events(spark, d)).select("event_id", "provider", "applied", F.col("tokens_before"))


@query(f"with {EVENTS}, s as (select provider, {STATS} from oe group by provider) select provider, round((tokens_before - tokens_after) / 1e6 * 2.5, 4) as saved_usd from s")
def analytics_cost(spark, d):
    return analytics.with_cost(analytics.window_stats(views.optimization_events(spark, d), "provider"), 2.5).select("provider", "saved_usd")


@query(f"with {EVENTS}, r as (select * from oe order by ts desc, event_id desc limit 100) select provider, count(*) as seen, bool_or(applied) as any_applied, arg_max(auth_method, struct_pack(ts := ts, event_id := event_id)) filter (where auth_method is not null) as auth_method from r group by provider")
def analytics_providers(spark, d):
    return analytics.provider_observations(views.optimization_events(spark, d))


@query(f"with {EVENTS} select skip_reason, count(*) as skipped from oe where not applied group by skip_reason")
def analytics_skips(spark, d):
    return analytics.skip_breakdown(views.optimization_events(spark, d))


@query(f"""with {EVENTS}, l as (select * from oe order by ts desc, event_id desc limit 1)
select event_id, case when cache_lookups = 0 then null when cache_hits = 0 then 'miss' when cache_hits >= cache_lookups then 'hit' else 'partial' end as cache_status, tokens_before - tokens_after as tokens_saved,
  case when transformers_csv <> '' then i - 1 end as ix, nullif(t, '') as step, case t when 'json' then 'JSON' when 'html' then 'HTML' else nullif(upper(t[1]) || t[2:], '') end as label
from (select *, unnest(string_split(transformers_csv, ',')) as t, generate_subscripts(string_split(transformers_csv, ','), 1) as i from l)""")
def analytics_explain(spark, d):
    return analytics.explain(views.optimization_events(spark, d)).select("event_id", "cache_status", "tokens_saved", F.col("ix").cast("long").alias("ix"), "step", "label")


@query(f"""with {EVENTS}, s as (select cast(ts as date) as day, {STATS} from oe group by rollup (cast(ts as date))), t as (select *, tokens_before - tokens_after as tokens_saved, bytes_before - bytes_after as bytes_saved from s),
u as (unpivot (select day, requests, optimized, skipped, tokens_before, tokens_after, tokens_saved, bytes_saved, cache_hits, cache_misses from t) on columns(* exclude day) into name measure value v)
select measure, max(v) filter (where day = (select max(day) from t)) as today, max(v) filter (where day is null) as all_time from u group by measure""")
def analytics_stats_view(spark, d):
    return analytics.stats_view(views.optimization_events(spark, d))


# Report ----------------------------------------------------------------------------------------


@query(f"""with {CASES} select count(*) as cases, count(*) filter (where len(steps) > 0 and tokens_before > tokens_after) as cases_helped, cast(sum(tokens_before) as bigint) as tokens_before, cast(sum(tokens_after) as bigint) as tokens_after, cast(sum(bytes_before) as bigint) as bytes_before, cast(sum(bytes_after) as bigint) as bytes_after, round(100.0::double * sum(tokens_before - tokens_after) / sum(tokens_before), 2) as overall_pct, round(avg(case when tokens_before > 0 then round(100.0::double * (tokens_before - tokens_after) / tokens_before, 2) else 0 end), 2) as mean_pct,
round((select avg(case when doc_id <> first then 1 else 0 end) from (select doc_id, min(doc_id) over (partition by text) as first from dirty)), 4) as hit_rate from cases""")
def report_totals(spark, d):
    """The suite's sums; a case whose text another case has had before is served from the store."""
    c = cases(spark, d)
    own = Window.partitionBy(F.sha2("text", 256))
    return report.suite_totals(c.withColumn("cache_hit", F.col("doc_id") != F.min("doc_id").over(own)))


@query(f"with {CASES}, s as (select kind, count(*) as cases, cast(sum(floor((tokens_before - tokens_after) * 10000 / greatest(tokens_before, 1))) as bigint) as pct_points from cases group by kind) select *, cast(floor(pct_points / cases) as bigint) as avg_points from s")
def report_by_kind(spark, d):
    return report.file_type_stats(cases(spark, d))


@query(f"with {CASES} select step, count(*) as n from (select unnest(steps) as step from cases) group by step order by n desc, step limit 8")
def report_top_steps(spark, d):
    return report.top_steps(cases(spark, d))


PRICES_SQL = "p as (select * from (values ('gpt-4o', 2.50::double), ('claude-sonnet-4', 3.00::double), ('gpt-4o-mini', 0.15::double)) v(model, usd))"


@query(f"with {CASES}, {PRICES_SQL}, t as (select sum(tokens_before) as b, sum(tokens_after) as a from cases), c as (select model, round(b * usd / 1e6, 6) as usd_before, round(a * usd / 1e6, 6) as usd_after from t, p) select *, round(usd_before - usd_after, 6) as usd_saved, round(100 * (1 - usd_after / usd_before), 2) as pct from c")
def report_cost(spark, d):
    return report.cost_by_provider(report.suite_totals(cases(spark, d)), spark.createDataFrame(report.PRICES, "model string, usd double"))


@query("select event_type, count(value) as n, count(*) - count(value) as errors, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, max(value) as worst from events group by event_type")
def report_latency(spark, d):
    return report.latency_stats(table(spark, d, "events"), "event_type", "value")


@query("select event_type, count(value) as n, count(*) - count(value) as errors, round(avg(value), 6) as mean, max(value) as worst, true as p50_holds, true as p95_holds, true as p99_holds from events group by event_type")
def report_latency_sketches(spark, d):
    """Quantile sketches of each day and leg, merged to all time, and whether their ranks hold among all values."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    merged = report.merged_latency(report.latency_sketches(e, "day", "event_type", value="value"), "event_type").withColumn("mean", F.round("mean", 6))
    return merged.join(report.ranks_hold(e, merged, "event_type", "value"), "event_type").drop("p50", "p95", "p99")


@query("select event_type, median(value) as median_ms, min(value) as least_ms, cast(sum(length(props)) as bigint) as bytes, count(*) as runs from events group by event_type")
def report_timing(spark, d):
    t = report.timing_stats(table(spark, d, "events").withColumn("size", F.length("props").cast("long")), "event_type", "value", "size")
    return t.select("event_type", "median_ms", "least_ms", "bytes", "runs")


@query("select case when strlen(text) > 8000 then 'over_limit' when strlen(text) >= 2000 then 'large' when strlen(text) >= 500 then 'medium' else 'small' end as size_class, count(*) as n, cast(sum(strlen(text)) as bigint) as bytes, count(*) filter (where strlen(text) > 8000) as passed_through from documents where text is not null group by 1")
def report_size_classes(spark, d):
    return report.size_classes(table(spark, d, "documents").where("text is not null"), 8000)


@query(f"with {CASES} select doc_id as case_id, kind, tokens_before, tokens_after, tokens_before - tokens_after as tokens_saved, array_to_string(steps, ',') as steps from cases")
def report_cases(spark, d):
    return report.case_table(cases(spark, d))


@query("select 1::bigint as pass, count(*) as lookups, count(*) - count(distinct text) as hits from documents where text is not null union all select 2, count(*), count(*) from documents where text is not null")
def report_cold_warm(spark, d):
    """Two runs against a stored table of results: the first computes each content once, the second nothing."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    fn = lambda t: t.select("digest", measures.token_count(F.col("text")).alias("tokens"))
    return report.cold_warm(docs, f"{shared(spark, 'results')}/store", fn, "digest string, tokens long, schema_version int")


# Tables, rules, streams ------------------------------------------------------------------------


@query("select n_regionkey, '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as markdown from nation group by n_regionkey")
def tables_markdown(spark, d):
    return tables.table_to_markdown(table(spark, d, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"])


@query("select c_nationkey as file, case c_nationkey % 3 when 0 then ';' when 1 then '|' else chr(9) end as delimiter from customer group by c_nationkey having count(*) >= 2")
def tables_delimiter(spark, d):
    c = table(spark, d, "customer")
    sep = F.expr("case c_nationkey % 3 when 0 then ';' when 1 then '|' else chr(9) end")
    lines = c.select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("ix"), F.concat(F.col("c_custkey").cast("string"), sep, F.lit("x"), sep, F.lit("y")).alias("line"))
    many = lines.groupBy("file").agg(F.count("*").alias("n")).where("n >= 2").select("file")
    return tables.infer_delimiter(lines).join(many, "file")


@query("select case when s_suppkey % 5 <> 1 then s_suppkey end as s_suppkey, case when s_suppkey % 5 <> 2 then s_name else ' ' end as s_name from supplier where s_suppkey % 5 <> 0")
def tables_drop_empty(spark, d):
    """Rows that are empty as a whole go, those with one empty cell stay; so do columns."""
    k = F.col("s_suppkey") % 5
    s = table(spark, d, "supplier").select(F.when(~k.isin(0, 1), F.col("s_suppkey")).alias("s_suppkey"), F.when(~k.isin(0, 2), F.col("s_name")).otherwise(" ").alias("s_name"), F.lit("").alias("nothing"), F.lit(None).cast("string").alias("null"))
    return tables.drop_empty(s, header_counts=False)


@query("select count(*) as checked, count(*) filter (where text like '%a%') as not_idempotent, count(*) filter (where text like '%q%') as grown from documents")
def rules_check(spark, d):
    """A rule that adds a mark to texts with an a each time, and a second one of its own to texts with a q: both are found out."""
    q = F.lit("###### ~~~~~~~ ")
    once = lambda c: F.when(F.contains(c, F.lit("q")) & ~c.startswith("###### "), F.concat(q, c)).otherwise(c)
    longer = lambda c: F.when(F.contains(c, F.lit("a")), F.regexp_replace(c, "a", "aa")).otherwise(c)
    docs = table(spark, d, "documents")
    checked = rules.check_rule(docs, once)
    return checked.select("checked", "grown").crossJoin(rules.check_rule(docs, longer).select("not_idempotent")).select("checked", "not_idempotent", "grown")


@query("select doc_id, case when text like '%' || chr(10) || '%' then 'trailing' else 'lower' end as rule, length(case when text like '%' || chr(10) || '%' then text else lower(text) end) as n_chars from documents where text is not null")
def rules_apply(spark, d):
    """Two rules by type: the first takes the blanks that were put before line ends, the second changes case."""
    r = rules.Rules().register(rules.Rule("trailing", "1", ("text",), 100, lambda c: F.regexp_replace(c, "(?m)[ \t]+$", ""))).register(rules.Rule("lower", "1", ("line", "text"), 200, F.lower))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.replace("text", F.lit("\n"), F.lit("  \n")).alias("text"), F.when(F.contains("text", F.lit("\n")), "text").otherwise("line").alias("content_type"))
    return r.apply(docs).select("doc_id", "rule", F.length("cleaned").cast("long").alias("n_chars"))


@query(f"with {EVENTS}, s as (select cast(ts as date) as day, {STATS} from oe group by 1) select day, requests, optimized, tokens_before, tokens_after, cache_hits, tokens_before - tokens_after as tokens_saved from s")
def stream_daily(spark, d):
    s = streams.stream_daily(streams.event_stream(spark, f"{d}/[e]vents.parquet"))
    return streams.run_to_table(s, shared(spark, "daily"), shared(spark, "daily-state")).select("day", "requests", "optimized", "tokens_before", "tokens_after", "cache_hits", "tokens_saved")


@query(f"with {EVENTS}, s as (select {STATS} from oe) select *, {DERIVED} from s")
def stream_totals(spark, d):
    s = streams.stream_totals(streams.event_stream(spark, f"{d}/[e]vents.parquet"))
    return streams.run_to_table(s, shared(spark, "totals"), shared(spark, "totals-state")).select(*NAMES)


@query(ORACLE["analytics_tallies"])
def stream_tallies(spark, d):
    s = streams.stream_tallies(streams.event_stream(spark, f"{d}/[e]vents.parquet"))
    return streams.run_to_table(s, shared(spark, "tallies"), shared(spark, "tallies-state"))


@query("select count(*) as contents from (select distinct provider, transformers_csv, tokens_before from (with " + EVENTS + " select * from oe))")
def stream_reuse(spark, d):
    e = streams.event_stream(spark, f"{d}/[e]vents.parquet").withColumn("content", F.concat_ws("|", "provider", "transformers_csv", "tokens_before"))
    once = streams.stream_dedupe(e, "content", "60 days").select("digest")
    folder = shared(spark, "reuse")
    return streams.run_to_folder(once, f"{folder}/out", f"{folder}/ck").agg(F.count("*").alias("contents"))


@query(ORACLE["analytics_recent"])
def stream_recent(spark, d):
    """The newest events, held in a stream's state and read back from it alone."""
    ck = shared(spark, "recent")
    state.keep_newest(streams.event_stream(spark, f"{d}/[e]vents.parquet"), ck).awaitTermination()
    return state.newest(spark, ck, 100).select("event_id", "provider", "applied")


@query("with " + EVENTS + """, c as (select *, concat_ws('|', provider, transformers_csv, tokens_before) as content from oe)
select event_id, min(event_id) over (partition by content) as first_id, event_id <> min(event_id) over (partition by content) as hit from c""")
def stream_hits(spark, d):
    """Which event's content was met before, from a stream with one remembered event for each content."""
    e = streams.event_stream(spark, f"{d}/[e]vents.parquet").withColumn("content", F.concat_ws("|", "provider", "transformers_csv", "tokens_before"))
    out = shared(spark, "hits")
    state.reuse(e, "content", f"{out}/ck", f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "first_id", "hit")
