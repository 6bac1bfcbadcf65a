"""JSON by structure, stored results by prefix, streams with state, sketches, rules that fail, archives, and long hostile texts."""

import io
import json
import random
import tempfile
import time
import zipfile
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill.functions import json_text, text
from textmill.functions.markup import Marks, Open
from textmill.operators import detect, pages, policy, rules, segments, store
from textmill.plans import analytics, optimize, report
from textmill.streaming import state

folder = lambda: tempfile.mkdtemp(prefix="spark-", dir="/tmp")


# Long texts ---------------------------------------------------------------------------------------

MANY = 5_000_000
HOSTILE = {"closed by other names": "<b>x</i>", "open quotes": '<a href="x ', "quotes in turn": '<a "> "', "both quotes": "<a \"'> '", "sections": "<![CDATA[ ", "other closes": "<div></p></span>", "names": "<a<", "comments": "<!-", "blanks": "<p          >", "nested": "<i>"}


@pytest.mark.parametrize("name", HOSTILE)
def test_pages_are_read_in_linear_time(name):
    part = HOSTILE[name]
    page = part * (MANY // len(part)) + "</div>>"
    began = time.time()
    pages.without_noise(page)
    assert time.time() - began < 30


def test_marks_agree_with_a_search_from_each_place():
    """A tag ends at the first > outside quotes; if there is none, at the first >."""
    rnd = random.Random(1)

    def tag_end(page, at):
        k, quote = at, ""
        while k < len(page):
            if quote:
                quote = "" if page[k] == quote else quote
            elif page[k] == ">":
                return k + 1
            elif page[k] in "\"'":
                quote = page[k]
            k += 1
        return page.find(">", at) + 1

    for _ in range(3000):
        page = "".join(rnd.choices(["<a", ">", '"', "'", " x", "</b", "y"], k=rnd.randint(1, 25)))
        marks, at = Marks(page), 0
        while m := marks.next(at):
            name_end = m.begin + 1 + m.closing + len(m.name)
            assert m.end == tag_end(page, name_end) and m.end > at
            at = m.end


def test_open_elements():
    rnd, o, plain = random.Random(2), Open(), []
    for _ in range(2000):
        if rnd.random() < 0.6 or not plain:
            name = rnd.choice("abcd")
            o.push(name)
            plain.append(name)
        else:
            k = rnd.randrange(len(plain))
            o.cut(k)
            del plain[k:]
        for names in ("a", "bc"):
            assert o.innermost(names) == max((i for i, n in enumerate(plain) if n in names), default=-1)


@pytest.mark.parametrize("hard", ['{"a": "x", "b' + '": 1, "k' * 200_000 + "}", "{" + '"a" : ' * 300_000 + "}", "x" + " " * 2_000_000 + "y", "<a " * 400_000, "<" + " " * 1_000_000, "> <img " * 200_000, "<title>" * 150_000 + ">", "[" * 500_000 + "]" * 500_000, '{"a' + "\\\\" * 700_000 + '": 1}'])
def test_texts_are_detected_and_cleaned_in_linear_time(spark, hard):
    d = spark.createDataFrame([(1, hard)], "id long, text string")
    began = time.time()
    text.normalize_text(detect.detect(d)).collect()
    pages.pages_to_markdown(d.select(F.col("id").alias("page_id"), F.col("text").alias("html"))).collect()
    assert time.time() - began < 30


MIXED = "<p>a <b>b</b> <i> c<b>d</i>e</b> <a href='http://x/?a=1&amp;b'>l <img src=s alt=t></a> <a href=/r>r</a><b></b><br>z", "<ul><li>a<ol><li>b<li>c</ol>d<li>e</ul><ul><li>f", "<table><tr><td>a<td>b<tr><td>c|d</table><table><tr><th>x</table>", "</p></li>a<h2>b</h2><hr>c<pre> x\n <b>y</b></pre><blockquote>q<p>r</blockquote>"
MARKDOWN = "a **b** *c**d*e** [l ![t](s)](http://x/?a=1&b) r\nz", "- a\n  1. b\n  2. c\n\nd\n\n- e\n\n- f", "| a | b |\n|---|---|\n| c\\|d |  |\n\n| x |\n|---|", "a\n\n## b\n\n---\n\nc\n\n```\n x\n y\n```\n\n> q\n\n> r"


@pytest.mark.parametrize(("page", "want"), list(zip(MIXED, MARKDOWN, strict=True)))
def test_blocks_of_nested_and_open_elements(spark, page, want):
    rows = pages.block_rows(page)
    assert "".join(("" if not i else "\n" if near else "\n\n") + line for i, (*_, line, near) in enumerate(rows)) == want
    d = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, content string")
    assert [(r.page_id, r.block_ix, r.line) for r in pages.page_blocks(d).orderBy("page_id", "block_ix").collect()] == [(1, i, r[3]) for i, r in enumerate(rows)]


# JSON ---------------------------------------------------------------------------------------------


def compacted(spark, texts, prune=False):
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", json_text.compact_json(F.col("text"), prune).alias("j"))
    return {r.id: (r.j.cleaned, r.j.steps) for r in d.collect()}


def test_repeated_keys_collapse_at_any_depth(spark):
    cases = {
        '{"a":1,"b":{"c":1,"c":2},"a":[{"x":0,"\\u0078":{"y":1,"y":2}}]}': ('{"a":[{"x":{"y":2}}],"b":{"c":2}}', ["collapsed_duplicate_keys", "minified_json"]),
        '{"a" : 1.50}': ('{"a":1.50}', ["minified_json"]), '{"a":1}': ('{"a":1}', []), '{"a":"caf\\u00e9"}': ('{"a":"café"}', ["minified_json"]),
        '{"a":1,"a":}': ('{"a":1,"a":}', []), "{'a':1,'a':2}": ("{'a':1,'a':2}", []), "plain": ("plain", []), '{"a":"\\ud800","a":1 }': ('{"a":1}', ["collapsed_duplicate_keys", "minified_json"]),
        '{"a":"\\ud800" }': ('{"a":"\\ud800"}', ["minified_json"]), '[{"k":1,"k":1}]': ('[{"k":1}]', ["collapsed_duplicate_keys", "minified_json"]), "": ("", []), "{}": ("{}", []),
        '{"a":[],"b":{}}': ('{"a":[],"b":{}}', []),
    }
    found = compacted(spark, [*cases, None])
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    assert found[len(cases)][0] is None


def test_empty_containers_go_from_json_of_any_shape(spark):
    found = compacted(spark, ['{"a":{"b":[]},"n":null,"s":""}', "[[],[{}],[[[]],0]]", '{"a":{"b":{}}}', '{"a":[],"a":[1]}', "no"], True)
    assert [found[i] for i in range(5)] == [
        ('{"n":null,"s":""}', ["removed_empty_containers", "minified_json"]), ("[[0]]", ["removed_empty_containers", "minified_json"]), ("{}", ["removed_empty_containers", "minified_json"]),
        ('{"a":[1]}', ["collapsed_duplicate_keys", "minified_json"]), ("no", []),
    ]


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab\"\\é", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", max_size=2), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(VALUES.filter(lambda v: isinstance(v, dict | list)))
def test_compaction_keeps_values_and_is_idempotent(value):
    once, repeated, _ = json_text.compact(json.dumps(value, indent=1), False)
    assert json.loads(once) == value and not repeated and json_text.compact(once, False)[0] == once
    small = json_text.compact(once, True)[0]
    assert json_text.compact(small, True) == (small, False, False)


def test_the_chain_collapses_and_prunes(spark):
    d = spark.createDataFrame([(1, '{"a": 1, "a": 2, "b": []}')], "id long, text string")
    kept, gone = optimize.clean(d).first(), optimize.clean(d, prune=True).first()
    assert (kept.cleaned, kept.steps) == ('{"a":2,"b":[]}', ["collapsed_duplicate_keys", "minified_json"])
    assert (gone.cleaned, gone.steps) == ('{"a":2}', ["collapsed_duplicate_keys", "removed_empty_containers", "minified_json"])


# Stored results -----------------------------------------------------------------------------------

SCHEMA = "digest string, n int, schema_version int"


def results(spark, names, version=1):
    d = spark.createDataFrame([(x,) for x in names], "text string")
    return d.select(F.sha2("text", 256).alias("digest"), F.length("text").alias("n"), F.lit(version).alias("schema_version"))


def test_a_run_reads_the_folders_of_its_digests_only(spark):
    at = folder() + "/store"
    own = store.Store(spark, at, SCHEMA)
    own.add(results(spark, [f"text {i}" for i in range(600)]))
    digest = results(spark, ["text 7"]).first().digest
    found = own.read(own.last()[1], [digest[:2]])
    assert found.where(F.col("digest") == digest).count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "prefix#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"prefix={digest[:2]}" in f for f in files)


def test_two_writers_leave_one_row_for_a_digest(spark, monkeypatch):
    at = folder() + "/store"
    one, two = store.Store(spark, at, SCHEMA), store.Store(spark, at, SCHEMA)
    plain, raced = two.commit, []

    def late(number, runs):
        if not raced:  # the other writer commits between this one's reading and its commit
            raced.append(one.add(results(spark, ["a", "b"])).count())
        return plain(number, runs)

    monkeypatch.setattr(two, "commit", late)
    added = two.add(results(spark, ["b", "c"]))
    rows = one.read(one.last()[1])
    assert raced == [2] and added.count() == 1 and rows.count() == rows.select("digest").distinct().count() == 3
    one.compact()
    assert len(one.last()[1]) == 1 and one.read(one.last()[1]).count() == 3


def test_a_half_written_entry_does_not_count(spark):
    at = folder() + "/store"
    own = store.Store(spark, at, SCHEMA)
    own.add(results(spark, ["a"]))
    fs, p = own.at("_log/1")
    fs.create(p, False).close()
    assert own.last()[0] == 1 and own.read(own.last()[1]).count() == 1
    own.add(results(spark, ["b"]))
    assert own.last()[0] == 2 and own.read(own.last()[1]).count() == 2


def test_rows_of_an_old_version_are_computed_anew(spark):
    at = folder() + "/store"
    d = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "doc_id long, text string").withColumn("digest", F.sha2("text", 256))
    store.run_incremental(d, at, lambda t: t.select("digest", F.lit(7).alias("n")), SCHEMA)
    stale = spark.read.option("basePath", at).parquet(at).withColumn("schema_version", F.lit(0)).withColumn("n", F.lit(-1)).drop("run")
    stale.write.mode("append").partitionBy("prefix").parquet(f"{at}/{store.Store(spark, at, SCHEMA).last()[1][0]}")
    again = store.run_incremental(d, at, lambda t: t.select("digest", F.lit(8).alias("n")), SCHEMA)
    assert {(r.n, r.hit) for r in again.collect()} == {(7, True)}


def test_null_parts_of_a_key_do_not_shift(spark):
    d = spark.createDataFrame([("x", None), ("x", ""), (None, "x"), (None, None)], "t string, q string")
    keys = [r[0] for r in d.select(store.digest(F.col("t"), "r", "o", qualifier=F.col("q"))).collect()]
    assert None not in keys and len(set(keys)) == 4


def test_equal_buckets_of_a_lock_are_not_read(spark):
    at = folder() + "/lock"
    files = spark.createDataFrame([(f"f{i}", f"text {i}") for i in range(500)], "name string, text string")
    store.write_lock(files, at)
    assert store.lock_drift(files, at).count() == 0 and store.locked(files, at)[0] == []
    now = files.where("name <> 'f7'").union(spark.createDataFrame([("new", "x")], files.schema)).withColumn("text", F.when(F.col("name") == "f9", "changed").otherwise(F.concat(F.col("text"))))
    assert {(r.name, r.status) for r in store.lock_drift(now, at).collect()} == {("f7", "removed"), ("f9", "changed"), ("new", "added")}
    buckets, rows = store.locked(now, at)
    read = {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert len(buckets) <= 3 and all(any(f"bucket={b}/" in f for b in buckets) for f in read) and len(read) <= 3


# Streams ------------------------------------------------------------------------------------------

EVENT = "ts timestamp, event_id long, provider string, applied boolean, content string"


def put(spark, at, k, ids):
    rows = [(datetime(2024, 1, 1, 0, i // 60, i % 60), i, "p", i % 2 == 0, f"c{i % 5}") for i in ids]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{at}/in/{k}")


def test_the_newest_events_survive_a_restart(spark):
    at = folder()
    for k, ids in enumerate([range(0, 40), range(100, 130), range(50, 60)]):
        put(spark, at, k, ids)
        stream = spark.readStream.schema(EVENT).parquet(f"{at}/in/*")
        state.keep_newest(stream, f"{at}/ck", 10, slots=2).awaitTermination()
    found = [r.event_id for r in state.newest(spark, f"{at}/ck", 10).collect()]
    held = spark.read.format("statestore").option("stateVarName", "newest").option("flattenCollectionTypes", "true").load(f"{at}/ck").count()
    assert found == list(range(129, 119, -1)) and held <= 20
    batch = analytics.recent(spark.read.schema(EVENT).parquet(f"{at}/in/*"), 10)
    assert [r.event_id for r in batch.collect()] == found


@pytest.mark.parametrize(("ttl", "again"), [(None, True), (1, False)])
def test_contents_are_remembered_until_they_expire(spark, ttl, again):
    at = folder()
    for k, ids in enumerate([range(0, 5), range(10, 20)]):
        put(spark, at, k, ids)
        stream = spark.readStream.schema(EVENT).parquet(f"{at}/in/*")
        state.reuse(stream, "content", f"{at}/ck", f"{at}/out", ttl).awaitTermination()
        time.sleep(0.1)
    found = {r.event_id: (r.first_id, r.hit) for r in spark.read.parquet(f"{at}/out").collect()}
    assert [found[i] for i in range(5)] == [(i, False) for i in range(5)]
    first = [i if again else i + 10 for i in range(5)]
    assert [found[i] for i in range(10, 15)] == [(first[i], again) for i in range(5)]
    assert all(found[i] == (first[i - 15], True) for i in range(15, 20))


# Reports ------------------------------------------------------------------------------------------


def test_sketches_keep_their_size_and_error(spark):
    sizes = []
    for n in (20_000, 200_000):
        d = spark.range(n).select((F.col("id") % 7).alias("day"), F.lit("leg").alias("leg"), F.when(F.col("id") % 10 > 0, F.pow(F.rand(3), 3)).alias("v"))
        d = d.checkpoint() if spark.sparkContext.getCheckpointDir() else d.cache()
        s = report.latency_sketches(d, "day", "leg", value="v")
        sizes.append(max(r[0] for r in s.select(F.octet_length("sketch")).collect()))
        m = report.merged_latency(s, "leg")
        r = m.first()
        assert (r.n, r.errors) == (d.where("v is not null").count(), n // 10) and all(report.ranks_hold(d, m, "leg", "v").first()[1:])
    assert sizes[1] < 1.5 * sizes[0] < 30_000
    empty = report.merged_latency(report.latency_sketches(d.where("false"), "leg", value="v"), "leg")
    assert empty.count() == 0
    nulls = report.merged_latency(report.latency_sketches(spark.createDataFrame([("a", None)], "leg string, v double"), "leg", value="v"), "leg").first()
    assert (nulls.n, nulls.errors, nulls.p50) == (0, 1, None)


def test_the_time_of_a_job_is_shared_out(spark):
    body = lambda *texts: json.dumps({"messages": [{"role": "user", "content": t} for t in texts]})
    rows = [("1", "POST", "v1/messages", "application/json", body("a  \nb", "long text  \n" * 40)), ("2", "POST", "v1/messages", "application/json", body("c  \nd")), ("3", "GET", "v1/messages", "application/json", "{}")]
    r = spark.createDataFrame(rows, "request_id string, method string, path string, content_type string, body string")
    began = time.monotonic()
    _, events = optimize.optimize(r)
    spent = {x.request_id: x.execution_time_ms for x in events.collect()}
    assert spent["1"] > spent["2"] > 0 == spent["3"] and sum(spent.values()) <= 1000 * (time.monotonic() - began)


# Rules, archives, policy --------------------------------------------------------------------------


def test_a_rule_that_raises_leaves_its_rows(spark):
    bad = lambda c: F.element_at(F.split(c, ","), 2)
    r = rules.Rules().register(rules.Rule("second", "1", ("text",), 50, bad)).register(rules.Rule("never", "1", ("json",), 50, lambda c: F.raise_error(c).cast("string")))
    d = spark.createDataFrame([(1, "a,b", "text"), (2, "plain", "text"), (3, "{}", "json"), (4, None, "text")], "id long, text string, content_type string")
    assert {x.id: x.cleaned for x in r.apply(d).collect()} == {1: "b", 2: "plain", 3: "{}", 4: None}
    assert {x.id: x.cleaned for x in optimize.clean(d.select("id", "text").where("text is not null"), rules=r).collect()} == {1: "b", 2: "plain", 3: "{}"}


def archive(names, comment=b"", method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for n in names:
            z.writestr(n, "word/document.xml " * 50)
    return out.getvalue()


@pytest.mark.parametrize(("data", "want"), [
    (archive(["[Content_Types].xml", "word/document.xml"]), "docx"), (archive([f"xl/sheet{i}.xml" for i in range(300)]), "xlsx"), (archive(["a", "ppt/x"], b"c" * 60_000), "pptx"), (archive(["notes.txt", "my/word/a"], method=zipfile.ZIP_STORED), None),
    (archive([]), None), (archive(["word/a"])[:-30], None), (b"PK\x03\x04" + b"word/" * 100, None), (archive(["xl/a", "word/b"], b"PK"), "docx"), (b"PK\x05\x06" + b"\xff" * 18, None), (b"", None),
])
def test_archives_by_their_directory(spark, data, want):
    d = spark.createDataFrame([(bytearray(data),)], "data binary")
    assert d.select(detect.office_format(F.col("data"))).first()[0] == want


def test_policy_refuses_by_size_media_and_switch(spark):
    rows = [("POST", "v1/messages", "application/json", "x" * 11), ("POST", "v1/messages", "application/json; charset=utf-8", "x" * 10), ("POST", "v1/messages", "text/plain", "x"), ("POST", "v1/messages", None, "x"), ("post", "v1/messages", " Application/JSON ", "x"), ("POST", "v1/messages", "application/json", None)]
    d = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "request_id string, method string, path string, content_type string, body string")
    reasons = {r.request_id: r.skip_reason for r in policy.policy_decide(d, max_body=10).collect()}
    assert reasons["0"] == "body_too_large" and reasons["1"] is None and reasons["2"] == "content_type_not_eligible" and reasons["4"] is None and reasons["5"] == "empty_body"
    assert {r.skip_reason for r in policy.policy_decide(d, enabled=False).collect()} == {"optimization_disabled"}


def test_blank_lines_keep_to_their_number(spark):
    d = spark.createDataFrame([("a\n\n\n\nb\n \n\t\nc",)], "text string")
    assert text.normalize_text(d).first().cleaned == "a\n\nb\n\nc"
    assert text.normalize_text(d, max_blank_lines=2).first().cleaned == "a\n\n\nb\n\n\nc"
    wide = text.normalize_text(spark.createDataFrame([("a  \t b   c",)], "text string"), inline=True).first()
    assert (wide.cleaned, wide.steps) == ("a b c", ["collapsed_inline_whitespace"])


def test_short_segments_are_left_out(spark):
    body = json.dumps({"messages": [{"role": "user", "content": "12345"}, {"role": "user", "content": "1234"}]})
    r = segments.parsed(spark.createDataFrame([(1, "v1/messages", body)], "request_id long, path string, body string"))
    assert [x.text for x in segments.segments(r, 5).collect()] == ["12345"] and segments.segments(r).count() == 2
