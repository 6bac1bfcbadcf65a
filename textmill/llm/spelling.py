"""Operator 11: spelling variants by a relational trie frontier.

Words are counted over all texts, and the words that count are written as a compressed trie: a table of edges,
each with the node it leaves, the first character of its label, the label's length and the hash of the label's
rest, the node it reaches and the characters that go on from there (0: a word ends). Nodes are hashes of prefixes;
a node exists where prefixes of words fork or a word ends.

There are two tries, of the words and of the reversed words, and a word spends its edit in its second half only,
where few branches are left; an edit in the first half is found in the other trie. So the tries hold the
prefixes of at least half a word's length, and no node near a root is a hot key. What follows an edit is equal in
both words, so each trie is one of its own for each pair of last characters; edits at the last two places
have a trie (``tail``) of the prefixes that leave at most two characters.

The frontier is a table of states (word, position, node, edits). It starts with each word at each fork of its own
path, without an edit. A state without an edit spends it, by replacing its character with another that the node
offers, or by leaving it out; then it goes on along its word. Level by level the frontier is joined with the edges
on (node, character). A state with an edit that ends where a word ends is a pair of neighbours. A pair is found
from one side: by a replacement from the word with the smaller character, or by leaving a character (the last of a
run of equal ones) out of the longer word. The found word is looked up in the table of words, so that hashes of
nodes and labels only guide the search: a collision may add states, but neither adds nor loses a pair.

(node, character) has one edge, so where many states want one, Spark splits their partition. The number of
levels is that of the forks on a path of the trie, not the length of words. Each level's states are written to
the shared folder.

A word's form is its most frequent neighbour, if that has FACTOR times the word's count; its root is found by
following forms, which takes no more rounds than the counts have powers of FACTOR.

Defined cases: a null text has no words; a null doc_id counts as empty in the hash; rows that share a doc_id are
read like any others; a row that is repeated counts again; words may be of any length; an empty table, or one without
words, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import common, hashing

LEAST_LENGTH, LEAST_COUNT, FACTOR, ONE_IN = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks the nodes of the trie of reversed words.
BACK = np.uint64(0x5851F42D4C957F2D)
#: Lower-cased words have a to z and the letters from U+00C0 to U+00FF; the end of a word counts as 0.
ALPHABET = (*range(97, 123), *range(0xC0, 0x100))
#: Characters that follow a prefix, as bits: the end and a to z, then the others.
MASKS = {
    "low": "case when follow < 192 then shiftleft(1L, greatest(follow - 96, 0)) else 0L end",
    "high": "case when follow >= 192 then shiftleft(1L, follow - 192) else 0L end",
}


def lower_case_ascii(c: Column) -> Column:
    """c with A to Z lower-cased; most words have no capital, and take no look-up of their characters."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, UPPER, LOWER))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """word and n: the lower-cased runs of letters of all texts, one in ``one_in`` with a character left out."""
    run = F.explode(F.regexp_extract_all("text", F.lit(rf"([A-Za-zÀ-ÿ]{{{least_length},}})"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    runs = runs.select("doc", lower_case_ascii(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def stretches(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers from lo[i] on, n[i] of them: i and number."""
    of = np.repeat(np.arange(len(lo)), n)
    return of, np.arange(len(of)) + np.repeat(lo - np.cumsum(n) + n, n)


def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The prefixes of each word that the tries hold: id, tail, depth, node and the character that follows (0 after the whole word)."""
    raw = [w.encode("utf-32-le") for w in batch.column("word").to_pylist()]
    size = np.array([len(x) // 4 for x in raw], np.int64)
    code = np.frombuffer(b"".join(raw), np.uint32)
    start, half, every = np.cumsum(size) - size, size // 2, np.arange(len(size))
    inner, inner_depth = stretches(half, np.maximum(size - 1 - half, 0))
    tail, tail_depth = stretches(np.maximum(size - 2, 0), np.minimum(size, 2) + 1)
    of, depth = np.concatenate([inner, every, tail]), np.concatenate([inner_depth, size, tail_depth])
    in_tail = np.arange(len(of)) >= len(of) - len(tail)
    last = code[start + size - 1].astype(np.uint64) * np.uint64(0x110000) + np.where(size > 1, code[start + np.maximum(size - 2, 0)], 0).astype(np.uint64)
    mark = np.where(in_tail, np.uint64(0), hashing.mixed(last, 1)[of]) ^ (batch.column("back").to_numpy(zero_copy_only=False) * BACK)[of]
    lo = start[of]
    node = (hashing.stretch(hashing.prefix_sums(code), lo, lo + depth) ^ mark).view(np.int64)
    follow = np.where(depth == size[of], 0, np.append(code, 0)[lo + depth])
    columns = [pa.array(batch.column("id").to_numpy()[of]), pa.array(in_tail), pa.array(depth, pa.int32()), pa.array(node), pa.array(follow, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "tail", "depth", "node", "follow"])


def offered(c: Column) -> Column:
    """Whether the masks low and high have a character."""
    low = F.getbit("low", F.greatest(c - 96, F.lit(0)))
    return F.when(c < 192, low).otherwise(F.getbit("high", F.greatest(c - 192, F.lit(0)))) == 1


def several() -> Column:
    return F.bit_count("low") + F.bit_count("high") > 1


def ends_here() -> Column:
    return F.getbit("low", F.lit(0)) == 1


def paths(both: DataFrame) -> DataFrame:
    """From id, back and word: word, back, tail and path, the nodes of the second half of each word: depth, node, and the masks of what follows."""
    steps = common.by_batch(both.select("id", "back", "word"), prefixes, "id long, tail boolean, depth int, node long, follow int", "word")
    nodes = steps.groupBy("node").agg(*(F.expr(f"bit_or({bits})").alias(name) for name, bits in MASKS.items())).where(several())
    end = F.col("follow") == 0
    met = steps.join(nodes.hint("shuffle_hash"), "node", "left").where(end | F.col("low").isNotNull())
    met = met.select("id", "tail", F.struct("depth", "node", F.coalesce("low", F.lit(1).cast("long")).alias("low"), F.coalesce("high", F.lit(0).cast("long")).alias("high")).alias("place"))
    return both.join(met.groupBy("id", "tail").agg(F.array_sort(F.collect_list("place")).alias("path")), "id").select("word", "back", "tail", "path")


def trie_edges(known: DataFrame) -> DataFrame:
    """From paths(): node, first (a code point), size, rest (hash of the label without its first character), child and the masks of what follows the child, of every edge."""
    hops = F.transform(F.slice("path", F.lit(2), F.size("path")), lambda b, i: F.struct(F.get("path", i).alias("a"), b.alias("b")))
    hops = known.select("word", F.explode(hops).alias("hop")).select("word", "hop.*")
    label = lambda skip: F.substring("word", F.col("a.depth") + 1 + skip, F.col("b.depth") - F.col("a.depth") - skip)
    edges = hops.select(F.col("a.node").alias("node"), F.ascii(F.substring(label(0), 1, 1)).alias("first"), (F.col("b.depth") - F.col("a.depth")).alias("size"),
                        F.xxhash64(label(1)).alias("rest"), F.col("b.node").alias("child"), "b.low", "b.high")
    return edges.distinct()


def character(at: Column) -> Column:
    """The code point of word at a position counted from 0."""
    return F.ascii(F.substring("word", at + 1, F.lit(1)))


NEXT = ["word", "back", "node", "position", "first", "place", "put"]


def forks(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the words, without an edit yet, want of the next edges by spending it; and the states that end here by leaving out their last character."""
    p, w, none = F.col("position"), F.length("word"), F.lit(None).cast("int")
    fresh = known.select("word", "back", "tail", F.explode("path").alias("at")).select("word", "back", "tail", "at.*").withColumnRenamed("depth", "position")
    # a word that is read backward is cut in the same place
    late = (p < w) & (F.col("tail") == (p >= w - 2)) & (p >= F.when(F.col("back"), w - F.floor(w / 2)).otherwise(F.floor(w / 2)))
    fresh = fresh.where(late & (several() | ends_here())).withColumn("own", character(p)).withColumn("after", F.when(p + 1 < w, character(p + 1)).otherwise(0))
    want = lambda position, first, put: F.struct(position.alias("position"), first.alias("first"), put.alias("put"))
    some = lambda mask, zero, letters: F.when(F.col(mask) != 0, F.filter(F.array(*map(F.lit, letters)), lambda c: (c > F.col("own")) & (F.getbit(mask, c - zero) == 1))).otherwise(F.array().cast("array<int>"))
    replaced = F.transform(F.concat(some("low", 96, ALPHABET[:26]), some("high", 192, ALPHABET[26:])), lambda c: want(p, c, c))
    left_out = F.when((F.col("after") != F.col("own")) & (F.col("after") != 0) & offered(F.col("after")), F.array(want(p + 1, F.col("after"), none))).otherwise(F.array())
    more = fresh.select("word", "back", "node", p.alias("place"), F.explode(F.concat(replaced, left_out)).alias("want")).select("word", "back", "node", "place", "want.*")
    ended = fresh.where((F.col("after") == 0) & ends_here()).select("word", "back", "node", w.alias("position"), F.lit(True).alias("ends"), p.alias("place"), none.alias("put"))
    return more.select(NEXT), ended


def neighbours(words: DataFrame) -> DataFrame:
    """word and near: each pair of words at one inserted, deleted or replaced character, in both directions."""
    both = words.select("id", F.lit(False).alias("back"), "word").union(words.select(-1 - F.col("id"), F.lit(True), F.reverse("word")))
    known = common.materialize(paths(both), "paths")
    edges = common.materialize(trie_edges(known), "edges")
    wants, ended = forks(known)
    places, over = [], F.col("position") == F.length("word")
    while True:
        moved = wants.join(edges, ["node", "first"])
        rest = F.substring("word", F.col("position") + 2, F.col("size") - 1)
        moved = moved.where((F.col("position") + F.col("size") <= F.length("word")) & (F.xxhash64(rest) == F.col("rest")))
        moved = moved.select("word", "back", F.col("child").alias("node"), (F.col("position") + F.col("size")).alias("position"), ends_here().alias("ends"), "place", "put")
        moved = moved.where(~over | F.col("ends"))
        states = common.materialize(moved if places else moved.unionByName(ended), "states")
        places.append(states.textmill_path)
        wants = states.where(~over).withColumn("first", character(F.col("position"))).select(NEXT)
        if wants.isEmpty():
            break
    found = words.sparkSession.read.schema(states.schema).parquet(*places).where(over)
    put = F.when(F.col("put").isNull(), F.lit("")).otherwise(F.char("put"))
    near = F.concat(F.substring("word", F.lit(1), F.col("place")), put, F.substring("word", F.col("place") + 2, F.length("word")))
    turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(c)
    found = found.select(turned(F.col("word")).alias("word"), turned(near).alias("near")).join(words.select(F.col("word").alias("near")), "near")
    return found.select("word", "near").union(found.select("near", "word")).distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form."""
    links = forms.select(F.col("word").alias("from"), F.col("form").alias("to"))
    out = forms.select("word", F.col("form").alias("root"))
    while True:
        further = out.join(links, out.root == F.col("from"), "left")
        moved = common.materialize(further.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        out = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return out


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, one_in: int = ONE_IN) -> DataFrame:
    """word, form, root, n, n_near and form_n."""
    counted = word_counts(docs, least_length, least_count, one_in)
    words = common.materialize(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = common.materialize(neighbours(words), "pairs")
    near = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    good = F.col("form_n") >= factor * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    found = common.materialize(found, "forms")
    roots = with_roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(common.read(spark, sf_dir, "documents"))
