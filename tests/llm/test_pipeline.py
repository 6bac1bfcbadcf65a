"""The corpus pipeline: each stage on its own input against a brute-force version, then the whole."""

import random
import re

import pytest

import corpus_pipeline as cp
from textmill.llm import secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(9)
    vocab = {"en": "the and ing with that wh".split(), "de": "sch keit ung über und ei".split()}
    data = []
    for i in range(160):
        lang = "de" if i % 3 else "en"
        t = " ".join("".join(rnd.choices(vocab[lang], k=3)) for _ in range(rnd.choice([5, 30, 80])))
        if i % 10 == 0 and data:
            t = data[-1][1] + (" extra" if len(data[-1][1].split()) > 60 else "")
        if i % 17 == 0:
            t += " password=hunter2hunter2"
        data.append((i, t, lang, f"s{i % 3}", len(t), 1))
    data += [(500, None, "en", "s0", 0, 1), (501, "  ", "en", "s0", 2, 1), (502, "12 34", "de", None, 5, 1)]
    return spark.createDataFrame(data, SCHEMA)


def run(spark, docs):
    out, d = [], docs
    for _, stage in cp.STAGES:
        d = stage(spark, d, "").cache()
        out.append(d)
    return out


def shingles(t):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}


def test_stages(spark, docs):
    known, unique, clean, mixed, ids = (x.collect() for x in run(spark, docs))
    assert {r.doc_id for r in known} == set(range(160))
    sets, label = {r.doc_id: shingles(r.text) for r in known}, {r.doc_id: r.doc_id for r in known}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                p, q = label[i], label[j]
                label = {x: min(p, q) if c in (p, q) else c for x, c in label.items()}
    assert sorted(r.doc_id for r in unique) == sorted(set(label.values()))
    assert len(unique) < len(known)
    assert {r.doc_id for r in clean} == {r.doc_id for r in unique}
    assert not any(secrets.base_spans(r.text) for r in clean) and any("[assign]" in r.text for r in clean)
    before = {r.doc_id: r.text for r in unique}
    assert all(r.text == before[r.doc_id] for r in clean if "[" not in r.text) and all(r.n_chars == len(r.text) for r in clean)
    size = {r.doc_id: len(WORD.findall(r.text)) for r in clean}
    took, source, texts = {}, {r.doc_id: r.source for r in clean}, {r.doc_id: r.text for r in clean}
    for r in mixed:
        took[r.doc_id] = took.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text)
    assert all(n <= 3 * size[i] for i, n in took.items())
    total = {s: sum(n for i, n in took.items() if source[i] == s) for s in ("s0", "s1", "s2")}
    whole = sum(size.values())
    assert all(abs(total[f"s{k}"] - whole * (k + 1) / 6) <= 16 for k in range(3))
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in mixed)
    assert all(len(r.ids) == r.n_tokens > 0 for r in ids)


def test_columns_and_empty_table(spark, docs):
    d = docs.limit(0)
    for k, (_, stage) in enumerate(cp.STAGES):
        d = stage(spark, d, "")
        assert d.count() == 0
        if k < len(cp.STAGES) - 1:
            assert d.columns == cp.COLUMNS


def test_null_and_repeated_ids_pass_every_stage(spark):
    rnd = random.Random(4)
    text = lambda: " ".join("".join(rnd.choices("the and ing with that wh".split(), k=3)) for _ in range(40))
    same = text()
    data = [(None, text(), "en", None, 0), (None, same, "en", "a", 0), (7, same, "en", "a", 0), (7, same, "en", "a", 0), (8, same, "en", "b", 0), (9, text(), None, "b", 0), (9, text(), "en", "b", 0), (10, "", "en", "b", 0)]
    data += [(100 + i, text(), "en", "a", 0) for i in range(30)]
    d = spark.createDataFrame([(*r, 1, "x", "y") for r in data], "doc_id long, text string, lang string, source string, n_chars long, held_out int, cell string, kept string")
    known, unique, clean, mixed, ids = (x.collect() for x in run(spark, d))
    assert len(known) == len(data) - 1
    ids_of = lambda rows: sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    assert ids_of(unique) == ids_of(clean) == [None, None, 7, 7, 9, 9, *range(100, 130)]
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and len(ids) == len(mixed)
