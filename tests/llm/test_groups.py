"""Spelling variants, exact duplicates and centroid clusters against brute-force versions."""

import hashlib
import math
import random
import re
import zlib

import pytest

from textmill.llm import exact, spelling, tournament

SCHEMA = "doc_id long, text string, word string, n int, digest string, salt int, rows int, node int"


def table(spark, data):
    return spark.createDataFrame([(i, t, "w", 1, "d", 2, 3, 4) for i, t in data], SCHEMA).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def variants(data, least_length=7, factor=10):
    n = {}
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if k > 1}
    near = {w: [x for x in n if distance_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


def words_of(seed=3):
    """Documents of words at one and more edits from each other, of frequent and rare ones, of long shared prefixes and of runs of one letter."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcdeéÀ÷", k=rnd.randint(6, 14))) for _ in range(60)]
    base += ["a" * k for k in range(6, 15)] + ["sharedprefix" * 4 + "".join(rnd.choices("xyz", k=rnd.randint(1, 3))) for _ in range(20)] + ["ab" * 5, "ba" * 5, "ab" * 5 + "a", "b" + "ab" * 5]
    every = list(base)
    for w in base * 3:
        k = rnd.randrange(len(w))
        every.append(rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("abcÿ") + w[k + 1 :]]))
    out = []
    for i in range(150):
        out.append((i, " ".join(rnd.choice(base) if rnd.random() < 0.6 else rnd.choice(every) for _ in range(40)) + " " + "frequent " * 5 + ("frequend, FREQUENT" if i % 11 == 0 else "")))
    for w, k in (("rootword", 400), ("rootwort", 30), ("rotwort", 3)):
        out += [(1000 + j, f"1{w}_") for j in range(k)]
    return [*out, (None, None), (901, None), (902, ""), (None, "null null nullnull nullnull"), out[3], out[3], (-5, "Ünïcode ünïcode ÜNÏCODE 日本語日本語日本語")]


def test_variants_equal_brute_force(spark):
    data = words_of()
    want = variants(data)
    assert any(r[2] != r[1] and r[1] for r in want) and sum(r[4] for r in want) > 200
    assert rows(spelling.spelling_variants(table(spark, data))) == sorted(want, key=repr)


def test_variants_of_short_words_and_other_parameters(spark):
    rnd = random.Random(8)
    data = [(i, " ".join("".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(30))) for i in range(40)]
    assert rows(spelling.spelling_variants(table(spark, data), least_length=1, factor=2)) == sorted(variants(data, 1, 2), key=repr)


def test_variants_of_empty_tables_and_long_words(spark):
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, None), (2, "no words of that length twice here")])).count() == 0
    long = "abcdefgh" * 100_000
    data = [(i, t) for i, t in enumerate([long, long, long + "x", long + "x", "y" + long, "y" + long, "ab " * 50_000])]
    found = {(len(r.word), r.n_near) for r in spelling.spelling_variants(table(spark, data), one_in=1 << 40).collect()}
    assert found == {(800_000, 2), (800_001, 1)}


def same_texts(seed=5):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choices(["a", "b", "ç"], k=rnd.randint(0, 4))) for _ in range(60)]
    data = [(i, rnd.choice(texts)) for i in range(400)] + [(500 + i, "hot text") for i in range(300)]
    data += [(900, None), (901, ""), (None, None), (None, "only null ids"), (None, "only null ids"), (None, "hot text"), data[3], data[3], (902, "a "), (903, "A"), (904, "x" * 3_000_000), (905, "x" * 3_000_000)]
    rnd.shuffle(data)
    return data


def exact_rows(data):
    out = []
    for i, t in data:
        same = [j for j, u in data if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("digits", "hot", "salts"), [(64, 1000, 1024), (64, 3, 2), (1, 4, 3), (1, 1000, 1), (0, 1000, 5)])
def test_exact_duplicates_equal_brute_force(spark, digits, hot, salts):
    """Digests of one or no digit put different texts under one digest."""
    data = same_texts()
    assert rows(exact.exact_duplicates(table(spark, data), digits, hot, salts)) == exact_rows(data)


def test_exact_duplicates_run_no_python_and_take_an_empty_table(spark):
    assert exact.exact_duplicates(table(spark, [])).count() == 0
    plan = exact.exact_duplicates(table(spark, same_texts()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def cluster_rows(data, k=16, rounds=3, dim=64):
    kept = []
    for i, v in data:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [(64 * (r := float(x).as_integer_ratio())[0]) // r[1] for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    of = [nearest(v) for _, v in kept]
    dist = [far(v, centroids[c]) for (_, v), c in zip(kept, of, strict=True)]
    own = [sum(d for d, o in zip(dist, of, strict=True) if o == c) for c in range(len(centroids))]
    fits = lambda x: x if x < 1 << 63 else None
    some = lambda ds: None if any(d >= 1 << 63 for d in ds) else fits(sum(ds))
    return [
        (i, c, fits(d), some([x for x, o in zip(dist, of, strict=True) if o == c]), some(dist), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), c, d in zip(kept, of, dist, strict=True)
    ], own


def vectors_of(n=300, seed=2, large=()):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 0.3) for _ in range(64)] for _ in range(20)]
    data = [(i, [x + rnd.gauss(0, 0.1) for x in rnd.choice(middle)]) for i in range(n)]
    data += [(1000, None), (1001, []), (1002, [0.1] * 63), (1003, [0.1] * 65), (1004, [None] + [0.1] * 63), (1005, [math.nan] + [0.1] * 63), (1006, [math.inf] * 64), (1007, [0.0] * 64), (1008, [-1 / 64] * 64)]
    data += [(None, data[4][1]), (None, data[5][1]), data[6], data[6], (6, data[7][1])]
    return data + [(2000 + i, [v] * 64) for i, v in enumerate(large)]


CASES = {"few": vectors_of(0), "equal": [(i, [0.5] * 64) for i in range(40)], "usual": vectors_of(), "large": vectors_of(60, 3, (1e6, -1e6, 3e38, 1e300, 1.7e308, -2e9))}


@pytest.mark.parametrize("name", CASES)
def test_clusters_equal_brute_force(spark, name, monkeypatch):
    monkeypatch.setattr(tournament, "ROWS", 7)
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in CASES[name]], "vec_id long, embedding array<double>, label int, cluster string").repartition(3)
    want, _ = cluster_rows([(r.vec_id, r.embedding) for r in df.collect()])
    assert rows(tournament.clusters(df)) == sorted(want, key=repr)


def test_clusters_of_an_empty_table(spark):
    assert tournament.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ties_go_to_the_smaller_number():
    own = tournament.Bisectors([[0, 0], [2, 0], [0, 0], [1, 1]])
    import numpy as np

    assert own.winners(np.array([[1, 0], [0, 0], [2, 0], [1, 1], [1, 5]])).tolist() == [0, 0, 1, 3, 3]
