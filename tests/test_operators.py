"""Operators on small inputs with known results."""

import tempfile

import pytest
from pyspark.sql import functions as F

from textmill.functions import measures, text
from textmill.operators import dedupe, detect, pages, policy, rules, segments, store, tables
from textmill.plans import analytics, optimize, report
from textmill.sources import requests as sources
from textmill.streaming import streams


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("value", "tokens"), [(None, 0), ("", 0), ("hello world", 2), ("internationalization", 4), (" " * 17 + "a", 3), ("it's", 2), ("!!!!!!'s", 3), ("a_b", 2), ("12345678", 2), ("\n\n", 1)])
def test_token_count(spark, value, tokens):
    assert one(spark, value, measures.token_count) == tokens


def test_normalize_text(spark):
    raw = "a  \r\n\r\n\r\n\r\nb\n\nb\n\nc \n"
    r = text.normalize_text(spark.createDataFrame([(raw,), ("  x",), ("clean",)], "text string")).collect()
    assert r[0].cleaned == "a\n\nb\n\nc" and r[0].steps == ["normalized_line_endings", "stripped_trailing_whitespace", "collapsed_blank_lines", "removed_duplicate_paragraphs"]
    assert (r[1].cleaned, r[1].steps, r[2].steps) == ("x", ["stripped_trailing_whitespace"], [])


def test_json_and_base64(spark):
    assert one(spark, '{ "b": [1.50, 2],\n "a b": "x  y" }', text.minify_json) == '{"b":[1.50,2],"a b":"x  y"}'
    assert one(spark, "{not json}", text.minify_json) == "{not json}"
    assert bytes(one(spark, "aGVs bG8", text.decode_base64)) == b"hello"
    assert one(spark, "a*b", text.decode_base64) is None
    assert one(spark, b"\xef\xbb\xbfhi", text.decode_text, "binary") == "hi"


def test_never_grow(spark):
    d = spark.createDataFrame([("a b", "a b c d", ["s"], 2, 4), ("a b", "a", ["s"], 2, 1)], "text string, cleaned string, steps array<string>, tokens_before long, tokens_after long")
    a, b = sorted(measures.never_grow(d).collect(), key=lambda r: r.tokens_after, reverse=True)
    assert (a.cleaned, a.steps, a.tokens_after) == ("a b", [], 2) and (b.cleaned, b.steps) == ("a", ["s"])


def test_detection(spark):
    texts = ["<!DOCTYPE html><p>x", '{"a": 1}', "<?xml version='1.0'?><a/>", "what does `<p>x</p><b>y</b>` do?", "<div><p>a</p><p>b</p></div>", "%PDF-1.4", "plain", "To bold use <b>text</b> or <p>para</p> in prose that goes on and on and on"]
    found = {r.text: r for r in detect.detect(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert [found[t].content_type for t in texts] == ["html", "json", "xml", "text", "html", "pdf", "text", "text"]
    assert found[texts[4]].confidence == pytest.approx(0.84)
    declared = detect.detect(spark.createDataFrame([("x", "text/csv")], "text string, mime string"), mime="mime").first()
    assert (declared.content_type, declared.confidence, declared.source) == ("csv", 0.5, "content-type-header")


@pytest.mark.parametrize(("data", "media", "name", "want"), [
    (b"a,b\n1,10\n", None, "t.csv", "csv"), (b"hello \nworld", None, None, "text"), (b"\xff\xfe\x81\x99\xc3\x28", None, "x.txt", "unknown"), (b"a\x00b", "text/plain", None, "unknown"),
    (b"x" * 4095 + "é".encode() + b"y" * 10, None, None, "text"), (b"PK\x03\x04..word/document.xml", None, None, "unknown"), (b"PK\x03\x04..zip", "text/plain", None, "unknown"),
    (b"\xef\xbb\xbf<?xml version='1.0'?>", None, None, "xml"), (b"  <!DOCTYPE HTML>", "text/plain", None, "html"), (b"a", "text/markdown; x", "t.csv", "markdown"), (b"", "text/plain", None, "unknown"), (b"\x80\x81", "application/pdf", None, "pdf"),
])
def test_document_formats(spark, data, media, name, want):
    d = spark.createDataFrame([(bytearray(data), media, name)], "data binary, media string, name string")
    assert d.select(detect.detect_format(F.col("data"), F.col("media"), F.col("name")).alias("f")).first().f == want


@pytest.mark.parametrize(("value", "valid"), [('{"a": 1, "a": 2}', True), ('[{"a":{"b":1,"b":2}}]', True), ("{'a': 1, 'a': 2}", False), ('{"a": 1, "a": 2,}', False), ('{"a": "x\ty", "a": 2}', False), ("{}", True), ("[1, 2", False)])
def test_json_with_repeated_keys_is_json(spark, value, valid):
    assert one(spark, value, text.is_json) is valid
    assert one(spark, value, text.minify_json) == (value.replace(" ", "") if valid else value)


@pytest.mark.parametrize(("step", "label"), [("removed_svg", "Removed SVG graphics"), ("format_docx", "Extracted DOCX"), ("format_odt", "Extracted ODT"), ("parsed_html_twice", "Parsed HTML twice"), ("json_split", "JSON split"), ("x", "X"), ("_", "_")])
def test_step_labels(spark, step, label):
    assert one(spark, step, text.humanize_step) == label


def test_endpoints_by_provider(spark):
    cases = [("openai", "v1/assistants", True), ("openai", "v1/uploads", False), ("openai", "v1/messages", False), ("openai", "threads/t/runs", True), ("anthropic", "/v1/messages/", True), ("anthropic", "v1/messages/batches", False), ("groq", "chat/completions", True), ("groq", "responses", False), ("other", "chat/completions", False)]
    d = spark.createDataFrame(cases, "provider string, path string, want boolean")
    assert all(r.got == r.want for r in d.select("*", policy.endpoint_permits(F.col("path"), F.col("provider")).alias("got")).collect())


def test_policy_and_auth(spark):
    r = spark.createDataFrame([("POST", "/v1/chat/completions", "application/json; x", "{}"), ("GET", "v1/messages", "application/json", "{}"), ("post", "v1/messages", "application/json", ""), ("POST", "v1/messages/batches", "application/json", "{}")], "method string, path string, content_type string, body string")
    assert [x.skip_reason for x in policy.policy_decide(r).collect()] == [None, "method_not_eligible", "empty_body", "endpoint_not_eligible"]
    assert one(spark, {"X-Api-Key": "s"}, policy.auth_kind, "map<string,string>") == "api_key"
    assert one(spark, {"Authorization": "Bearer s"}, policy.auth_kind, "map<string,string>") == "oauth_token"


def test_segments_and_write_back(spark):
    bodies = {
        1: ("v1/chat/completions", '{"model":"m","messages":[{"role":"user","content":"a  \\nb"},{"role":"user","content":[{"type":"text","text":"p"},{"type":"image_url"}]},{"content":null}],"n":1}'),
        2: ("v1/responses", '{"instructions":"i","input":"q"}'), 3: ("v1/responses", '{"input":[{"content":"z"}]}'), 4: ("threads/t", '{"instructions":"i","messages":[{"content":"c"},{"content":[{"text":"no"}]}]}'),
        5: ("v1/messages", '{"system":[{"type":"text","text":"s"}],"messages":[{"content":"u"}]}'), 6: ("v1/messages", "[1]"), 7: ("v1/messages", "broken"),
    }
    r = segments.parsed(spark.createDataFrame([(k, p, b) for k, (p, b) in bodies.items()], "request_id long, path string, body string"))
    got = sorted((s.request_id, s.origin, s.part_ix, s.text) for s in segments.segments(r).collect())
    assert got == [(1, "messages[0].content", -1, "a  \nb"), (1, "messages[1].content", 0, "p"), (2, "input", -1, "q"), (2, "instructions", -1, "i"), (3, "input[0].content", -1, "z"), (4, "instructions", -1, "i"), (4, "messages[0].content", -1, "c"), (5, "messages[0].content", -1, "u"), (5, "system", 0, "s")]
    res = optimize.results(segments.segments(r))
    new = {x.request_id: x for x in segments.reassemble(r, res).collect()}
    assert new[1].new_body == bodies[1][1].replace("a  \\nb", "a\\nb") and new[2].new_body == bodies[2][1] and not new[2].any_changed
    reasons = {x.request_id: x.skip_reason for x in segments.skip_reason(r, segments.segments(r), res).collect()}
    assert (reasons[1], reasons[2], reasons[6]) == (None, "content_already_optimal", "no_optimizable_segments")


def test_write_back_is_at_the_place_of_the_text(spark):
    body = '{ "model": "x  ", "messages": [{"role": "x  ", "content": "x  "}, {"content": [{"type": "tool_use", "args": "x  "}, {"type": "text", "text": "caf\\u00e9  "}]}], "n": [1, {"content": "x  "}] }'
    r = segments.parsed(spark.createDataFrame([(1, "v1/messages", body), (2, "v1/messages", '{"messages": [ ]}')], "request_id long, path string, body string"))
    res = optimize.results(segments.segments(r))
    new = {x.request_id: (x.new_body, x.any_changed) for x in segments.reassemble(r, res).collect()}
    assert new[1] == ('{"model":"x  ","messages":[{"role":"x  ","content":"x"},{"content":[{"type":"tool_use","args":"x  "},{"type":"text","text":"café"}]}],"n":[1,{"content":"x  "}]}', True)
    assert new[2] == ('{"messages": [ ]}', False)


def test_documents_in_bodies_become_text(spark):
    import base64

    csv = "name,note" + ",empty" * 12 + "\n" + "\n".join(f"row {i},some text" + "," * 12 for i in range(40))
    doc = lambda data, media: '{"type":"document","cache_control":{"type":"ephemeral"},"source":{"type":"base64","media_type":"%s","data":"%s"}}' % (media, base64.b64encode(data).decode())
    page = b"<html><body><nav>menu</nav><h1>Head</h1><p>" + b"words of the page " * 30 + b"</p></body></html>"
    body = '{"messages":[{"content":[%s,{"type":"text","text":"see  \\nhere"},%s,%s]}]}' % (doc(csv.encode(), "text/csv"), doc(page, "text/html"), doc(b"%PDF-1.4", "application/pdf"))
    r = spark.createDataFrame([("1", "POST", "v1/messages", "application/json", body), ("2", "POST", "v1/messages", "text/plain", "{}")], sources.REQUEST)
    new, events = optimize.optimize(r)
    import json

    parts = json.loads(new.first().new_body)["messages"][0]["content"]
    assert parts[0] == {"type": "text", "text": "| name | note |\n|---|---|\n" + "\n".join(f"| row {i} | some text |" for i in range(40)), "cache_control": {"type": "ephemeral"}}
    assert parts[1]["text"] == "see\nhere" and parts[2]["text"].startswith("# Head\n\nwords of") and parts[3]["type"] == "document"
    e = {x.request_id: x for x in events.collect()}
    assert (e["1"].applied, e["1"].segments, e["1"].skip_reason) == (True, 3, None) and e["1"].bytes_before > e["1"].bytes_after
    assert set(e["1"].steps) == {"extracted_document", "format_csv", "format_html", "stripped_trailing_whitespace"}
    assert (e["2"].applied, e["2"].segments, e["2"].skip_reason) == (False, 0, "content_type_not_eligible")


def test_pages_prompts_and_tables_are_cleaned_in_the_chain(spark):
    prompt = "Requirements:\n" + "- be short and to the point, always\n" * 8 + "\nGo on."
    texts = {1: '<!DOCTYPE html><html><body><div class="ad"><div>Buy</div> now</div><h1>T</h1><p>some words</p></body></html>', 2: prompt, 3: "a,b,c\n1,,2\n3,,4\n", 4: '{"a" : 1}', 5: "plain", 6: None}
    d = spark.createDataFrame(list(texts.items()), "id long, text string")
    found = {r.id: r for r in optimize.clean(d, prompts=True, csv=True).collect()}
    assert {k: r.transformer for k, r in found.items()} == {1: "html", 2: "prompt", 3: "csv", 4: "json", 5: "text", 6: "text"}
    assert found[1].cleaned == "# T\n\nsome words" and found[1].steps == ["removed_ads_and_banners", "converted_to_markdown"]
    assert found[2].cleaned == "Requirements:\n- be short and to the point, always\n\nGo on." and found[2].steps == ["removed_duplicate_list_items"]
    assert found[3].cleaned == "a,b,c\n1,,2\n3,,4\n" and found[4].cleaned == '{"a":1}'
    assert one(spark, "a,b,c\n1,,2\n,,\n3,,\"x,|y\"\n", lambda c: tables.csv_to_markdown(c, F.lit(","))).cleaned == "| a | c |\n|---|---|\n| 1 | 2 |\n| 3 | x,\\|y |"
    off = {r.id: r.transformer for r in optimize.clean(d).collect()}
    assert off[2] == off[3] == "text"


def test_rules_of_others_feed_the_chain_and_a_failing_one_leaves_its_row(spark):
    def shout(x):
        if "bad" in x:
            raise ValueError(x)
        return x.upper()

    r = rules.Rules().register(rules.Rule("shout", "1", ("loud",), 50, shout, lambda c: F.when(c.startswith("!"), 0.9), each_text=True))
    d = spark.createDataFrame([(1, "!go"), (2, "!bad go"), (3, "go")], "id long, text string")
    found = {x.id: x for x in optimize.clean(d, rules=r).collect()}
    assert [(found[i].cleaned, found[i].transformer, found[i].steps) for i in (1, 2, 3)] == [("!GO", "shout", ["shout"]), ("!bad go", "shout", []), ("go", "text", [])]
    off = {x.id: x.transformer for x in optimize.clean(d, rules=r.with_rules(set())).collect()}
    assert off[1] == "text" and r.with_rules(set()).fingerprint() != r.fingerprint()


def test_table_function_gives_segments(spark):
    segments.register_segment_rows(spark)
    spark.createDataFrame([(1, '{"messages":[{"role":"user","content":"a"},{"content":[{"text":"b"},{"x":1}]}]}'), (2, "broken"), (3, None)], "request_id long, body string").createOrReplaceTempView("bodies")
    got = spark.sql("select request_id, s.* from bodies, lateral segment_rows(body) s").collect()
    assert sorted(tuple(x) for x in got) == [(1, 0, "user", "a"), (1, 1, None, "b")]


def test_inline_documents(spark):
    b = '{"messages":[{"content":[{"type":"document","source":{"type":"base64","media_type":"text/csv","data":"YSxi"}},{"type":"file","file":{"filename":"f.txt","file_data":"data:text/plain;base64,aGk="}},{"type":"document","source":{"type":"url","url":"u"}}]}]}'
    d = segments.document_segments(segments.parsed(spark.createDataFrame([(1, b)], "request_id long, body string"))).collect()
    assert sorted((bytes(x.data), x.media_type, x.filename) for x in d) == [(b"a,b", "text/csv", None), (b"hi", "text/plain", "f.txt")]


def test_prompt_dedupe(spark):
    t = "Requirements:\n- be short\n- be short\n\nNotes:\n- be short\n\n```\nx\n\nx\n```\n\nSame. Same. Other.\n\nRequirements:\n- be short"
    r = dedupe.dedupe_prompts(spark.createDataFrame([(1, t), (2, "plain")], "doc_id long, text string")).collect()
    found = {x.doc_id: x.cleaned for x in r}
    assert found == {1: "Requirements:\n- be short\n\nNotes:\n- be short\n\n```\nx\n\nx\n```\n\nSame. Other.", 2: "plain"}


def brute_prompt(text):
    """De-duplication of a prompt, a line at a time, until nothing goes; then the normalisation. Returns text and steps."""
    import re

    first, steps = text, []
    text = text.replace("\r\n", "\n").replace("\r", "\n")

    def marked(text):
        fences, heading, out = 0, "", []
        for line in text.split("\n"):
            is_fence = bool(re.match(dedupe.FENCE, line))
            fences += is_fence
            fenced = fences % 2 == 1 or is_fence
            is_heading = not fenced and bool(re.match(dedupe.HEADING, line))
            heading = line.strip() if is_heading else heading
            out.append((line, fenced, not fenced and not is_heading and bool(re.match(dedupe.ITEM, line)), is_heading, heading))
        return out

    while True:
        fired, seen, kept = [], set(), []
        for line, _, item, _, heading in marked(text):
            if item and (heading, line.strip()) in seen:
                fired.append("removed_duplicate_list_items")
                continue
            seen |= {(heading, line.strip())} if item else set()
            kept.append(line)
        blocks, new = [], True
        for line, fenced, item, is_heading, _ in marked("\n".join(kept)):
            if not fenced and not line.strip():
                new = True
                continue
            if new:
                blocks.append([])
            blocks[-1].append((line, item, is_heading))
            new = False
        seen, opened, kept = set(), set(), []
        for b in blocks:
            key, only = "\n".join(x[0].rstrip() for x in b), all(x[1] for x in b)
            opens = b[0][0].strip() if b[0][2] else None
            bare, again = len(b) == 1 and opens is not None, not only and key in seen
            gone = opens in opened if bare else again
            if opens is not None and (not again or bare):
                opened.add(opens)
            if not only:
                seen.add(key)
            if gone:
                fired.append("removed_duplicate_blocks")
            else:
                kept.append("\n".join(x[0] for x in b))
        out = []
        for line, fenced, item, is_heading, _ in marked("\n\n".join(kept)):
            parts = re.split(r"(?<=[.!?])\s+", line)
            own = [x for i, x in enumerate(parts) if i == 0 or x != parts[i - 1] or x == ""]
            if len(own) < len(parts) and not (fenced or item or is_heading or "`" in line):
                fired.append("removed_duplicate_sentences")
                line = " ".join(own)
            out.append(line)
        text = "\n".join(out)
        steps += [x for x in ("removed_duplicate_list_items", "removed_duplicate_blocks", "removed_duplicate_sentences") if x in fired and x not in steps]
        if not fired:
            break
    stages = [("stripped_trailing_whitespace", lambda t: re.sub(r"(?m)[ \t]+$", "", t)), ("collapsed_blank_lines", lambda t: re.sub("\n{3,}", "\n\n", t))]
    normal = []
    for name, fn in stages:
        if fn(text) != text:
            normal.append(name)
        text = fn(text)
    paragraphs = text.split("\n\n")
    kept = [p for i, p in enumerate(paragraphs) if not p.strip() or i == 0 or p.strip() != paragraphs[i - 1].strip()]
    if kept != paragraphs:
        normal.append("removed_duplicate_paragraphs")
    text = "\n\n".join(kept)
    if not normal and text.strip() != text:
        normal = ["stripped_trailing_whitespace"]
    return text.strip(), [] if text.strip() == first else steps + normal


def test_prompts_equal_a_loop_over_lines(spark):
    import random

    rnd = random.Random(3)
    bits = ["Rules:", "# Head", "- one", "- two", "* one", "1. a", "Same. Same. Other.", "Go on. Go on.", "plain text", "plain text  ", "```", "", "", "x `c` x. x `c` x."]
    data = [(i, rnd.choice(["\n", "\n", "\r\n"]).join(rnd.choices(bits, k=rnd.randint(1, 25)))) for i in range(150)] + [(900, ""), (901, " \n\n "), (902, None)]
    found = {r.doc_id: (r.cleaned, r.steps) for r in dedupe.dedupe_prompts(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert len(found) == len(data) and found[902] == (None, [])
    wrong = [(t, found[i], brute_prompt(t)) for i, t in data if t is not None and found[i] != brute_prompt(t)]
    assert not wrong, wrong[0]


def test_pages(spark):
    h = '<html><head><title>T &amp; t</title></head><body><nav>n</nav><h2>H</h2><p>one <b>two</b> <a href="http://x/">l</a><p>three<ul><li>i</li></ul><div class="ad">x</div><script>"</p>"</script></body></html>'
    p = pages.strip_page_noise(spark.createDataFrame([(1, h)], "page_id long, html string"))
    md = pages.page_markdown(pages.page_blocks(p)).join(p.select("page_id", "html"), "page_id")
    assert pages.with_title(md).first().markdown == "# T & t\n\n## H\n\none **two** [l](http://x/)\n\nthree\n\n- i"


@pytest.mark.parametrize(("page", "want", "steps"), [
    ('<div class="ad"><div>Buy</div> now</div>a', "a", ["removed_ads_and_banners"]), ("<nav>1<nav>2<nav>3<nav>4</nav></nav></nav></nav>a", "a", ["removed_navigation"]),
    ('<nav><script>x="</nav>"</script></nav>a<p style="opacity: 0">b</p>', "a", ["removed_hidden_elements", "removed_navigation", "removed_scripts"]),
    ("<article><header>by</header>a</article><header>top</header>", "<article><header>by</header>a</article>", ["removed_navigation"]), ('<p class="download">a', '<p class="download">a', []),
    ("<svg><p>x</svg>a<img src=x hidden><!-- c -->", "a", ["removed_hidden_elements", "removed_svg"]), ("</div></nav>a<aside>open", "</div></nav>a", ["removed_navigation"]),
])
def test_noise_goes_at_any_depth(page, want, steps):
    assert pages.without_noise(page) == (want, steps)


@pytest.mark.parametrize(("html", "want"), [
    ("<p>&#8212;&#x41;&eacute;&amp;lt;&nope; &#0;</p>", "—Aé&lt;&nope; &#0;"), ("<p>a<br>b</p>", "a\nb"), ('<p><img src="a.png" alt="x"><img alt=\'y\' src="data:z"></p>', "![x](a.png)y"),
    ("<ol><li>a<li>b<ul><li>c</ul><li>d</ol><ul><li>e</ul>", "1. a\n2. b\n  - c\n3. d\n\n- e"), ("<table><tr><th>h<th>i|j<tr><td>1</table>", "| h | i\\|j |\n|---|---|\n| 1 |  |"),
    ("<pre>\n a &lt;\n  b</pre>", "```\n a <\n  b\n```"), ("<blockquote>a<br>b</blockquote><hr>", "> a\n> b\n\n---"), ("<p><a href='/r'>r</a> <a href='mailto:a@b'>m</a></p>", "r [m](mailto:a@b)"),
])
def test_markdown_of_blocks(spark, html, want):
    d = spark.createDataFrame([(1, html)], "page_id long, content string")
    assert pages.page_markdown(pages.page_blocks(d)).first().markdown == want


def test_recurring_lines_in_bands_only(spark):
    rows = [("h", m, i, "Page 1 of 9" if i == 0 else "same in the middle" if i == 10 else f"own {'abcdefgh'[m]} {'xyz' * i}") for m in range(4) for i in range(21)]
    d = spark.createDataFrame(rows, "host string, page long, ix int, text string")
    kept = pages.remove_recurring_lines(d, "host", "page", place="ix").collect()
    assert len(kept) == 80 and sum(r.text == "same in the middle" for r in kept) == 4


def test_store(spark):
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, text string")
    fn = lambda t: t.select("digest", F.length("text").alias("n"))
    assert sorted((r.doc_id, r.cache_hit) for r in store.compute_distinct(d, "text", fn, "doc_id").collect()) == [(1, False), (2, True), (3, False)]
    s = spark.createDataFrame([("x", 1, "e")], "key string, bytes long, t string").select("key", "bytes", F.to_timestamp(F.lit("2024-01-01")).alias("last_access"))
    assert store.evict(s, 1, 0).count() == 0 and store.evict(s, 1, 1).count() == 1
    at, schema = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store", "digest string, n int, schema_version int"
    keyed, some = d.withColumn("digest", F.sha2("text", 256)), lambda t: t.select("digest", F.when(F.col("text") != "y", F.length("text")).alias("n"))
    first = store.run_incremental(keyed.where("doc_id < 3"), at, some, schema).collect()
    second = {r.doc_id: (r.n, r.hit) for r in store.run_incremental(keyed, at, some, schema).collect()}
    assert all(r.n == 1 and not r.hit for r in first) and second == {1: (1, True), 2: (1, True), 3: (None, False)}
    assert spark.read.parquet(at).count() == 1
    assert store.fingerprint([("a", "1"), ("b", "2")]) == store.fingerprint([("b", "2"), ("a", "1")]) != store.fingerprint([("a", "1")])


EVENT = "ts timestamp, event_id long, provider string, applied boolean, skip_reason string, transformers array<string>, tokens_before long, tokens_after long, cache_hits long, cache_lookups long, execution_time_ms double, auth_method string, bytes_before long, bytes_after long"


def events(spark, rows):
    from datetime import datetime

    full = [(datetime(2024, 1, 1, 0, 0, i), i, "p", a, None, t, b, c, h, n, ms, None, 4 * b, 4 * c) for i, (a, t, b, c, h, n, ms) in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def test_statistics(spark):
    e = events(spark, [(True, ["html"], 100, 40, 1, 2, 2.0), (True, ["json"], 200, 50, 0, 0, 4.0), (False, [], 0, 0, 0, 0, 3.0)])
    s = analytics.window_stats(e).first()
    assert (s.requests, s.optimized, s.skipped, s.tokens_before, s.tokens_after, s.tokens_saved, s.token_pct, s.hit_rate, s.avg_latency_us) == (3, 2, 1, 300, 90, 210, 70.0, 0.5, 3000)
    assert (s.bytes_before, s.bytes_saved) == (1200, 840)
    assert analytics.top_transformer(e).first().transformer == "json"
    assert [r.event_id for r in analytics.recent(e, 2).collect()] == [2, 1]


def test_report(spark):
    c = spark.createDataFrame([("a", "html", 100, 20, 80, 1000, 200, ["s", "t"]), ("b", "text", 50, 50, 0, 500, 500, [])], "case_id string, kind string, tokens_before long, tokens_after long, tokens_saved long, bytes_before long, bytes_after long, steps array<string>")
    t = report.suite_totals(c).first()
    assert (t.cases, t.cases_helped, t.overall_pct) == (2, 1, 53.33)
    assert [r.step for r in report.top_steps(c).collect()] == ["s", "t"]
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    report.write_report(c, at)
    r = spark.read.json(f"{at}/results.json").first()
    assert r.totals.cases == 2 and [x.kind for x in r.by_type] == ["html", "text"] and spark.read.option("header", True).csv(f"{at}/summary.csv").count() == 2
    w = spark.read.json(f"{at}/website-stats.json").first()
    assert [x.step for x in w.top_steps] == ["s", "t"] and {x.model for x in w.cost} == {m for m, _ in report.PRICES}
    assert open(f"{at}/report.md").read().startswith("# Report\n\n2 cases, 1 helped")
    legs = spark.createDataFrame([("direct", float(i)) for i in range(1, 101)] + [("via", i + 0.5) for i in range(1, 101)] + [("via", None)], "leg string, ms double")
    stats = report.latency_stats(legs, "leg", "ms")
    assert {x.leg: (x.n, x.errors, x.p50) for x in stats.collect()} == {"direct": (100, 0, 50.5), "via": (100, 1, 51.0)}
    assert report.overhead(stats, "leg", "via", "direct").first().p95 == 0.5


def test_case_files_and_xml(spark):
    import os

    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.mkdir(f"{at}/files")
    for name in ("a.txt", "b.txt"):
        open(f"{at}/files/{name}", "w").write(f"text of {name}\nmore")
    open(f"{at}/manifest.json", "w").write('{"cases": [{"id": "2", "project": "Two", "file": "b.txt"},\n {"id": "1", "project": "one", "file": "a.txt"}]}')
    assert [(r.id, r.text) for r in sources.read_cases(spark, f"{at}/manifest.json", f"{at}/files").collect()] == [("1", "text of a.txt\nmore"), ("2", "text of b.txt\nmore")]
    assert [r.id for r in sources.read_cases(spark, f"{at}/manifest.json", f"{at}/files", "TWO").collect()] == ["2"]
    open(f"{at}/x.xml", "w").write("<rows><row><a>1</a></row><row><a>2</a></row></rows>")
    assert sorted(r.a for r in sources.read_xml(spark, f"{at}/x.xml", "row").collect()) == [1, 2]


def test_a_day_closes_and_late_rows_are_dropped(spark):
    from datetime import datetime

    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k, days in enumerate([[1, 1], [4], [1, 4], [9]]):
        full = [(datetime(2024, 1, d, 1), d, "p", True, None, ["html"], 10, 4, 0, 1, 1.0, None, 40, 16) for d in days]
        spark.createDataFrame(full, EVENT).coalesce(1).write.parquet(f"{at}/in/{k}")
    for k in range(4):
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/[0-{k}]")
        streams.run_to_folder(streams.stream_daily(stream), f"{at}/out", f"{at}/ck")
    found = {r.day.day: r.requests for r in spark.read.parquet(f"{at}/out").collect()}
    assert found == {1: 2, 4: 2}
    totals = streams.run_to_table(streams.stream_totals(spark.readStream.schema(EVENT).parquet(f"{at}/in/*")), f"{at}/totals", f"{at}/ck2").first()
    assert totals.requests == 6


def test_stream_reuses_stored_results(spark):
    at, schema = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "digest string, n int, schema_version int"
    fn = lambda t: t.select("digest", F.length("text").alias("n"))
    for k, texts in enumerate([["a", "bb"], ["bb", "ccc"]]):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{at}/in/{k}")
    for k in range(2):
        stream = spark.readStream.schema("text string").parquet(f"{at}/in/[0-{k}]").withColumn("digest", F.sha2("text", 256))
        streams.stream_reuse(stream, f"{at}/store", fn, schema, f"{at}/out", f"{at}/ck").awaitTermination()
    found = sorted((r.batch, r.n, r.hit) for r in spark.read.parquet(f"{at}/out").collect())
    assert found == [(0, 1, False), (0, 2, False), (1, 2, True), (1, 3, False)] and spark.read.parquet(f"{at}/store").count() == 3


def test_tables(spark):
    rows = spark.createDataFrame([("f", i, line) for i, line in enumerate(["a\tb\tc,", "1\t2\t3", "4\t5\t6"])], "file string, ix int, line string")
    assert tables.infer_delimiter(rows).first().delimiter == "\t"
    t = spark.createDataFrame([("1", "", "2"), ("", "", ""), ("3", "", "4")], "a string, x string, b string")
    kept = tables.drop_empty(t, header_counts=False)
    assert kept.columns == ["a", "b"]
    md = tables.table_to_markdown(kept.withColumn("g", F.lit(1)), "g", "a", ["a", "b"]).first().markdown
    assert md == "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"


def test_rules(spark):
    r = rules.Rules().register(rules.Rule("up", "1", ("text",), 10, F.upper))
    with pytest.raises(ValueError, match="already"):
        r.register(rules.Rule("up", "2", ("text",), 10, F.upper))
    with pytest.raises(ValueError, match="loses"):
        r.register(rules.Rule("low", "1", ("text",), 10, F.lower), lossy=True)
    d = spark.createDataFrame([("ab", "text"), ("ab", "pdf")], "text string, content_type string")
    assert [x.cleaned for x in r.apply(d).collect()] == ["AB", "ab"]
    bad = rules.check_rule(d, lambda c: F.concat(c, F.lit(" x"))).first()
    assert (bad.checked, bad.not_idempotent, bad.grown) == (2, 2, 2)


def test_sources_and_stream(spark):
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    log = spark.createDataFrame([("1", "POST", "v1/messages", "application/json", '{"messages":[{"content":"a  \\nb"}]}'), ("2", "POST", "v1/messages", "application/json", "[]")], sources.REQUEST)
    log.write.json(f"{at}/log")
    assert sorted((r.request_id, r.malformed) for r in sources.read_requests(spark, f"{at}/log").collect()) == [("1", False), ("2", True)]
    stream = spark.readStream.schema(sources.REQUEST).json(f"{at}/log")
    streams.stream_optimize(stream, f"{at}/bodies", f"{at}/events", f"{at}/ck").awaitTermination()
    new = {r.request_id: r.new_body for r in spark.read.parquet(f"{at}/bodies").collect()}
    assert new == {"1": '{"messages":[{"content":"a\\nb"}]}', "2": "[]"}
    assert "text" not in spark.read.parquet(f"{at}/events").columns
    spark.createDataFrame([("a;b",), ("1;2",)], "v string").coalesce(1).write.text(f"{at}/csv")
    assert sources.read_table_auto(spark, f"{at}/csv").columns == ["a", "b"]
    sources.write_events(events(spark, [(True, ["html"], 100, 40, 1, 2, 2.0)]), f"{at}/e")
    assert sources.replay(spark, f"{at}/e").count() == 1
    assert sources.read_documents(spark, f"{at}/csv").count() >= 1
