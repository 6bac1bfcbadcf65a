"""Steps whose memory or time must not grow with the rows of a task: results of each row, and what a plan has."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.functions import arrow, json_text, measures, text
from textmill.operators import dedupe, detect, json_rows, pages
from textmill.plans import report


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_keys_row_by_row(spark):
    texts = ['{"a":1,"a" :2,"b":{"a":1}}', '{"a":[{"a":1,"a":2},{"a":3,"\\"a":4}],"a":{}}', '{"k": "k:", "x": "{\\"k\\": 1, \\"k\\": 2}"}', "", None, '[{"a":1},{"a":1}]', '{"a":{"b":1,"b":1,"b":1},"b":{"b":1}}']
    want = [1, 2, 0, 0, 0, 0, 2]
    rows = [(None if i == 1 else 7, t) for i, t in enumerate(texts)]  # neither a null key nor a repeated one may mix rows
    found = json_rows.duplicate_keys(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", "text")
    assert [(r.id, r.duplicates) for r in found.collect()] == [(k, n) for (k, _), n in zip(rows, want, strict=True)]
    assert "Exchange" not in plan(found) and "Sort" not in plan(found)


def test_repeated_keys_of_a_long_text_in_linear_time():
    n = 200_000
    assert json_rows.repeats("{" + ",".join(f'"k{i % (n // 2)}":{{"a":1}}' for i in range(n)) + "}") == n // 2
    assert json_rows.repeats("[" * n + '{"a":1,"a":1}' + "]" * n) == 1


def test_parts_lie_end_to_end():
    rnd = random.Random(1)
    texts = pa.array([None if rnd.random() < 0.1 else "é" * rnd.choice([0, 1, 10_000, arrow.PART_BYTES]) for _ in range(200)] + ["x"] * 5_000)
    parts = list(arrow.text_slices(texts))
    assert pa.concat_arrays(parts).equals(texts) and max(map(len, parts)) <= arrow.PART_ROWS
    assert all(len(p) == 1 or sum(len(t.as_py() or "") * 2 for t in p) <= 2 * arrow.PART_BYTES for p in parts)
    assert [len(p) for p in arrow.text_slices(pa.array([], pa.string()))] == [0]


# Pages: a worker holds a part of a batch at a time, in each of the steps over them.

HTML = "<html><head><title>t</title></head><body><nav>n</nav><h1>H {0}</h1><p>text {0}</p></body></html>"
STEPS = {"noise": (pages.noise_free, HTML), "blocks": (pages.rows_of_blocks, "<h1>H {0}</h1><p>text {0}</p>"), "markdown": (pages.cleaned_pages, HTML)}


@pytest.mark.parametrize("step", list(STEPS))
def test_pages_of_a_batch_in_parts(step):
    fn, html = STEPS[step]
    n = 2 * arrow.PART_ROWS + 7
    batches = [pa.array([None if i == 3 else html.format(i) for i in range(n)]), pa.array([], pa.string()), pa.array([html.format(i) + " " * arrow.PART_BYTES for i in range(4)])]
    found = list(fn(iter(batches)))
    assert [len(x) for x in found] == [arrow.PART_ROWS, arrow.PART_ROWS, 7, 0, 1, 1, 1, 1]
    last = found[2].to_pylist()[-1]
    want = {"noise": lambda: "removed_navigation" in last["steps"] and f"<h1>H {n - 1}</h1>" in last["content"], "blocks": lambda: [b["text"] for b in last] == [f"H {n - 1}", f"text {n - 1}"], "markdown": lambda: last["markdown"] == f"# H {n - 1}\n\ntext {n - 1}"}
    assert want[step]()


@pytest.mark.parametrize("step", list(STEPS))
def test_memory_of_pages_does_not_grow_with_the_batch(step):
    fn, html = STEPS[step]

    def most(n):
        batch = pa.array([html.format(i) + "<p>" + "words of the page " * 100 + "</p>" for i in range(n)])
        tracemalloc.start()
        try:
            assert sum(map(len, fn(iter([batch])))) == n
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert most(arrow.PART_ROWS) < 2 * most(arrow.PART_ROWS // 4)


# Cases


def test_cases_are_computed_once_for_their_table(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    n = F.udf(count, "long")(F.col("id"))
    cases = spark.range(0, 400, numPartitions=4).select(F.col("id").alias("case_id"), F.lit("k").alias("kind"), n.alias("tokens_before"), F.lit(1).alias("tokens_after"), F.lit(0).alias("tokens_saved"), F.array(F.lit("a"), F.lit("b")).alias("steps"))
    found = report.case_table(cases).collect()
    assert [(r.case_id, r.tokens_before, r.steps) for r in found] == [(i, i, "a,b") for i in range(400)]
    assert seen.value == 400


def test_tokens_equal_those_of_plain_classes(spark):
    plain = r"(?U)(?<![^\s\w])'(?:[sdmt]|ll|ve|re)|(?:(?<!\s) )?(?:[^\W\d_]{1,6}|\d{1,6}|[^\s\w]{1,6})|\s{1,16}"
    rnd = random.Random(4)
    signs = [chr(i) for i in range(1, 0x250)] + list("\u0300\u0660\u200d\u2028\u203f\u2160\u3000\u4e00\U0001f600") + list(" '   ''sltvedm1_\n") * 20
    d = spark.createDataFrame([("".join(rnd.choices(signs, k=rnd.randint(0, 60))),) for _ in range(3_000)], "text string")
    assert d.where(F.regexp_count("text", F.lit(plain)) != measures.token_count(F.col("text"))).isEmpty()


# JSON


def test_the_kind_of_a_text_is_found_once(spark):
    texts = [' {"a": 1} ', '{"a":1,"a":2}', '{"a":"\\u0041"}', "[1, 2]", "{'a':1}", "{", "", None, "plain", '{"a":"x\ty","a":1}', '[{"b":1,"b": [ ]}]']
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert [r[0] for r in d.select(text.json_kind(F.col("text"))).collect()] == [1, 2, 1, 1, 0, 0, 0, 0, 0, 0, 2]
    j = d.select(json_text.compact_json(F.col("text")).alias("j"))
    assert [r.j.cleaned for r in j.collect()] == ['{"a":1}', '{"a":2}', '{"a":"A"}', "[1,2]", *texts[4:10], '[{"b":[]}]']
    assert [r.j.steps for r in j.collect()][:4] == [["minified_json"], ["collapsed_duplicate_keys", "minified_json"], ["minified_json"], ["minified_json"]]
    found = j.select("j.cleaned", "j.steps")._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("get_json_object") == 1 and found.lower().count("parse_json") + found.count("parseJson") <= 2


def test_only_texts_that_begin_as_json_are_stripped(spark):
    d = spark.createDataFrame([("<p>" + "a b\n" * 250_000,)] * 8, "text string").coalesce(1).cache()
    d.count()

    def seconds(c):
        began = time.monotonic()
        d.select(c).write.format("noop").mode("overwrite").save()
        return time.monotonic() - began

    c = F.col("text")
    assert min(seconds(text.is_json(c)) for _ in range(3)) < min(seconds(text.stripped(c)) for _ in range(3)) / 2
    blanks = ["{}", " \n\t\x0b\f\r[1] ", "\u00a0{}", "\u2028{}", "\x1c{}", "x{}", " ", "\n", "<{}"]
    assert [r[0] for r in spark.createDataFrame([(b,) for b in blanks], "text string").coalesce(1).select(text.is_json(c)).collect()] == [True, True, *[False] * 7]


def test_markup_in_quotes_of_any_kind_is_not_markup(spark):
    page = "<ul><li>a</li><li>b</li></ul>"
    texts = [page, f"```\n{page}\n```", f"~~~{page}~~~", f"`{page}`", f"~~{page}~~", f"``{page}", f"~~~{page}", f"```{page}~~~ {page}", f"a `b` {page}", f"~~~ ` ~~~ {page} `"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(detect.html_confidence(F.col("text"))).collect()
    assert [r[0] is not None for r in found] == [True, False, False, False, True, True, True, True, True, True]


def test_json_of_a_batch_in_parts():
    n = arrow.PART_ROWS + 3
    asked = pa.StructArray.from_arrays([pa.array([2] * n, pa.int32()), pa.array([None if i == 5 else f'{{"a":1,"a":{i}}}' for i in range(n)])], ["kind", "text"])
    found = list(json_text.compact_texts(iter([(asked, pa.array([False] * n))])))
    assert [len(x) for x in found] == [arrow.PART_ROWS, 3]
    assert found[1].to_pylist()[-1] == {"kind": 2, "text": f'{{"a":{n - 1}}}', "collapsed": True, "emptied": False} and found[0].to_pylist()[5]["text"] is None


# Prompts


def test_texts_in_which_nothing_can_go_take_no_round(spark, monkeypatch):
    taken, lines = [], dedupe.lines
    monkeypatch.setattr(dedupe, "lines", lambda d, *a, **b: taken.append({r.doc_id for r in d.select("doc_id").collect()}) or lines(d, *a, **b))
    texts = ["\n \t\n  a\n \n\n\tb\n- c\n\f\n\n", "one\ntwo", "", " ", "\r\n\r\n", None, "x", "Same. Same.", "- a\n- a", "```\n\n\nx\n```", "a \n\n a"]
    found = {r.doc_id: (r.cleaned, r.steps) for r in dedupe.dedupe_prompts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert set().union(*taken) == {7, 8, 9, 10}
    assert found[1] == ("one\ntwo", []) and found[2] == ("", []) and found[3][0] == found[4][0] == "" and found[5] == (None, []) and found[7][0] == "Same." and found[8][0] == "- a" and found[10][0] == "a"
    assert found[0] == ("a\n\n\tb\n- c", ["stripped_trailing_whitespace"])
