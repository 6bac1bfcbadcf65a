"""Request payloads to text segments and back; payloads are Variant, wrong shapes are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import decode_base64
from textmill.operators.json_rows import pieces
from textmill.operators.policy import route_adapter

PART = "struct<type:string,text:string>"


def parsed(requests: DataFrame) -> DataFrame:
    """requests with payload (Variant) and model; a body that is no JSON object has a null payload."""
    v = F.try_parse_json("body")
    out = requests.withColumn("v", v).withColumn("payload", F.when(F.expr("schema_of_variant(v) like 'OBJECT%'"), F.col("v"))).drop("v")
    return out.withColumn("model", model_of())


def model_of() -> Column:
    """payload.model if it is a string."""
    return F.expr("case when schema_of_variant(variant_get(payload, '$.model')) = 'STRING' then try_variant_get(payload, '$.model', 'string') end")


def text_or_parts(df: DataFrame, value: str, origin: str, keys: list[str]) -> DataFrame:
    """Rows of one Variant column: its string, or the text of each of its parts; empty texts and other shapes give none."""
    kind = f"schema_of_variant({value})"
    texts = (
        f"case when {kind} = 'STRING' then array(named_struct('part_ix', -1, 'text', try_variant_get({value}, '$', 'string'))) "
        f"when {kind} like 'ARRAY%' then transform(try_variant_get({value}, '$', 'array<variant>'), (x, i) -> named_struct('part_ix', i, 'text', "
        f"case when schema_of_variant(x) like 'OBJECT%' and schema_of_variant(try_variant_get(x, '$.text', 'variant')) = 'STRING' then try_variant_get(x, '$.text', 'string') end)) end"
    )
    out = df.select(*keys, F.expr(origin).alias("origin"), F.explode(F.expr(texts)).alias("s"))
    return out.select(*keys, "origin", F.col("s.part_ix").alias("part_ix"), F.col("s.text").alias("text")).where("text <> ''")


def listed(requests: DataFrame, field: str, inner: str = "content") -> DataFrame:
    """request_id, seg_ix, role and value: the inner Variant of each element of payload.field."""
    r = requests.select("request_id", F.posexplode(F.expr(f"try_variant_get(payload, '$.{field}', 'array<variant>')")).alias("seg_ix", "m"))
    return r.select("request_id", "seg_ix", F.expr("try_variant_get(m, '$.role', 'string')").alias("role"), F.expr(f"try_variant_get(m, '$.{inner}', 'variant')").alias("value"))


#: For each payload shape its top-level text fields, its list of messages, and whether parts count. Fixed values.
SHAPES = {
    "chat": ((), "messages", True),
    "responses": (("instructions", "input"), "input", True),
    "assistants": (("instructions", "additional_instructions", "content"), "messages", False),
    "messages": (("system",), "messages", True),
}


def values(shape: str) -> str:
    """An array of (seg_ix, origin, value) of a payload: fields count from -1 down, messages from 0 up."""
    names, field, _ = SHAPES[shape]
    own = [f"named_struct('seg_ix', {-1 - k}, 'origin', '{n}', 'value', try_variant_get(payload, '$.{n}', 'variant'))" for k, n in enumerate(names) if n != field]
    if field in names:  # a field that is a text or a list of messages
        k = names.index(field)
        own.append(f"named_struct('seg_ix', {-1 - k}, 'origin', '{field}', 'value', case when schema_of_variant(try_variant_get(payload, '$.{field}', 'variant')) = 'STRING' then try_variant_get(payload, '$.{field}', 'variant') end)")
    each = f"(m, i) -> named_struct('seg_ix', i, 'origin', concat('{field}[', i, '].content'), 'value', try_variant_get(m, '$.content', 'variant'))"
    listed_ = f"coalesce(transform(try_variant_get(payload, '$.{field}', 'array<variant>'), {each}), array())"
    return f"concat(array({', '.join(own)}), {listed_})" if own else listed_


def shaped(requests: DataFrame, adapter: Column) -> DataFrame:
    """Segments by an adapter column, from one pass over the payloads."""
    case = " ".join(f"when adapter = '{s}' then {values(s)}" for s in SHAPES)
    r = requests.withColumn("adapter", adapter).where("adapter is not null and payload is not null")
    r = r.select("request_id", "adapter", F.explode(F.expr(f"case {case} end")).alias("v")).select("request_id", "adapter", "v.*")
    out = text_or_parts(r, "value", "origin", ["request_id", "adapter", "seg_ix"])
    whole_only = [s for s, (_, _, parts) in SHAPES.items() if not parts]
    return out.where(~F.col("adapter").isin(whole_only) | (F.col("part_ix") == -1)).select("request_id", "seg_ix", "origin", "part_ix", "text")


def chat_segments(requests: DataFrame) -> DataFrame:
    """request_id, seg_ix, origin, part_ix, text of chat payloads."""
    return shaped(requests, F.lit("chat"))


def responses_segments(requests: DataFrame) -> DataFrame:
    return shaped(requests, F.lit("responses"))


def assistants_segments(requests: DataFrame) -> DataFrame:
    return shaped(requests, F.lit("assistants"))


def messages_segments(requests: DataFrame) -> DataFrame:
    return shaped(requests, F.lit("messages"))


def segments(requests: DataFrame, least: int = 0) -> DataFrame:
    """All segments of at least so many characters of parsed requests (request_id, path, payload) by the adapter of their path."""
    out = shaped(requests, route_adapter(F.col("path")))
    return out.where(F.length("text") >= least) if least else out


class SegmentRows:
    """A table function's handler: the messages' texts of one JSON body as rows of (seg_ix, role, text), for use in SQL by lateral joins."""

    def eval(self, body: str):
        import json

        try:
            found = json.loads(body or "")
        except ValueError:
            return
        for i, m in enumerate(found.get("messages") or [] if isinstance(found, dict) else []):
            content = m.get("content") if isinstance(m, dict) else None
            for part in [content] if isinstance(content, str) else [p.get("text") for p in content if isinstance(p, dict)] if isinstance(content, list) else []:
                if isinstance(part, str) and part:
                    yield i, m.get("role"), part


def register_segment_rows(spark: SparkSession, name: str = "segment_rows") -> None:
    """Makes SegmentRows callable in SQL: select ... from requests, lateral segment_rows(body)."""
    spark.udtf.register(name, F.udtf(SegmentRows, returnType="seg_ix int, role string, text string"))


def document_segments(requests: DataFrame) -> DataFrame:
    """request_id, seg_ix, part_ix, data, media_type, filename, cache_control (JSON) of inline documents; URLs are skipped."""
    blocks = listed(requests, "messages").select("request_id", "seg_ix", F.posexplode(F.expr("try_variant_get(value, '$', 'array<variant>')")).alias("part_ix", "b"))
    get = lambda p: F.expr(f"try_variant_get(b, '{p}', 'string')")
    b = blocks.where(get("$.type").isin("document", "file", "input_file"))
    url = F.coalesce(get("$.file.file_data"), get("$.file_data"))
    inline = F.regexp_extract(url, r"(?s)^data:([^;,]*)(?:;[^,]*)?;base64,(.*)$", 2)
    data = F.when(get("$.source.type") == "base64", get("$.source.data")).when(inline != "", inline)
    media = F.coalesce(get("$.source.media_type"), F.nullif(F.regexp_extract(url, r"^data:([^;,]*)", 1), F.lit("")))
    out = b.select("request_id", "seg_ix", "part_ix", decode_base64(data).alias("data"), media.alias("media_type"), F.coalesce(get("$.file.filename"), get("$.filename")).alias("filename"), F.expr("to_json(try_variant_get(b, '$.cache_control', 'variant'))").alias("cache_control"))
    return out.where("data is not null")


def quoted(c: Column) -> Column:
    """c as a JSON string."""
    j = F.to_json(F.array(c))
    return F.substring(j, 2, F.length(j) - 2)


def reassemble(requests: DataFrame, results: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """request_id, new_body, any_changed: changed texts put back at their place; a body without one keeps its bytes.

    results: request_id, origin, part_ix, text, cleaned, changed, one row for each segment. documents:
    request_id, seg_ix, part_ix, text of blocks that become a text block, keeping cache_control. A changed
    body comes out without white space between its parts; keys keep their order, other values their spelling.
    """
    new = results.where("changed").select(F.col("request_id").alias("r"), F.col("origin").alias("o"), F.col("part_ix").alias("p"), F.col("text").alias("old"), "cleaned")
    wanted = new.select("r")
    if documents is not None:
        docs = documents.select(F.col("request_id").alias("dr"), F.col("seg_ix").alias("ds"), F.col("part_ix").alias("dp"), F.col("text").alias("doc"), "cache_control")
        wanted = wanted.union(docs.select(F.col("dr").alias("r")))
    live = requests.select("request_id", "body").join(wanted.distinct(), F.col("request_id") == F.col("r"), "left_semi")
    rows = pieces(live, "request_id", "body")
    content = F.concat("k1", F.lit("["), F.col("i2").cast("string"), F.lit("].content"))
    at = F.when(F.col("depth") == 1, F.struct(F.col("k1").alias("o"), F.lit(-1).alias("p"))).when((F.col("depth") == 3) & (F.col("k3") == "content"), F.struct(content.alias("o"), F.lit(-1).alias("p")))
    at = at.when((F.col("depth") == 3) & (F.col("k3") == "text"), F.struct(F.col("k1").alias("o"), F.col("i2").alias("p"))).when((F.col("depth") == 5) & (F.col("k3") == "content") & (F.col("k5") == "text"), F.struct(content.alias("o"), F.col("i4").alias("p")))
    rows = rows.withColumn("at", F.when(F.col("piece").startswith('"') & ~F.col("is_key"), at))
    here = (F.col("request_id") == F.col("r")) & (F.col("at.o") == F.col("o")) & (F.col("at.p") == F.col("p"))
    own = F.expr("try_variant_get(try_parse_json(piece), '$', 'string')")
    rows = rows.join(new, here, "left")
    rows = rows.withColumn("hit", F.coalesce(own == F.col("old"), F.lit(False))).withColumn("piece", F.when(F.col("hit"), quoted(F.col("cleaned"))).otherwise(F.col("piece")))
    if documents is not None:
        inside = (F.col("request_id") == F.col("dr")) & (F.col("k1") == "messages") & (F.col("k3") == "content") & (F.col("depth") >= 5) & (F.col("i2") == F.col("ds")) & (F.col("i4") == F.col("dp"))
        rows = rows.join(docs, inside, "left")
        block = F.concat(F.lit('{"type":"text","text":'), quoted(F.col("doc")), F.coalesce(F.concat(F.lit(',"cache_control":'), "cache_control"), F.lit("")), F.lit("}"))
        whole = F.col("dr").isNotNull()
        rows = rows.withColumn("hit", F.col("hit") | whole).withColumn("piece", F.when(whole & (F.col("piece") == "{") & (F.col("depth") == 5), block).when(whole, "").otherwise(F.col("piece")))
    put = rows.groupBy(F.col("request_id").alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "piece"))), lambda x: x["piece"]), "").alias("put"), F.bool_or("hit").alias("hit"))
    j = requests.select("request_id", "body").join(put, F.col("request_id") == F.col("r"), "left")
    changed = F.coalesce("hit", F.lit(False))
    return j.select("request_id", F.when(changed, F.col("put")).otherwise(F.col("body")).alias("new_body"), changed.alias("any_changed"))


def skip_reason(requests: DataFrame, segs: DataFrame, results: DataFrame) -> DataFrame:
    """request_id and skip_reason after extraction: no adapter, no segments, or nothing changed."""
    n = segs.groupBy("request_id").agg(F.count("*").alias("n_segments"))
    c = results.groupBy("request_id").agg(F.count_if("changed").alias("n_changed"), F.count("*").alias("n_results"))
    j = requests.select("request_id", route_adapter(F.col("path")).alias("adapter")).join(n, "request_id", "left").join(c, "request_id", "left")
    reason = F.when(F.col("adapter").isNull(), "no_payload_adapter").when((F.coalesce("n_segments", F.lit(0)) == 0) & (F.coalesce("n_results", F.lit(0)) == 0), "no_optimizable_segments").when(F.coalesce("n_changed", F.lit(0)) == 0, "content_already_optimal")
    return j.select("request_id", reason.alias("skip_reason"))
