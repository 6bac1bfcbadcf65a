"""Operator 2: mixing sources to target weights by Sainte-Laguë apportionment.

The mix has as many words as all documents together, dealt in blocks of ``block`` words: the house. A
source's target is its weight's share, at most ``cap`` times its own size; what is above is shared again
by weight. Seats of the house, each a block, go to the highest quotients target / (2k + 1), ties to the
source that comes first. The output's shards fill one after the other, so a source's quota in a shard is
the number of its seats that fall into the shard's part of that order; the quotas are integers and sum up
to the shard's size. A source's blocks are then chosen by a seeded order: its documents are laid end to
end in the order of a seeded digest, and each shard takes its quota of blocks from where the last one
ended, beginning anew after the last document. A source that has more seats than blocks is repeated.

A source's words differ from its target by the apportionment's rounding: at most ``block`` times
(1 + its share of the mix times half the number of sources), so a target of less than half a block may get
nothing. Only quotients near a source's share of the seats can decide, so these are all that is ranked:
about seven rows a source and shard, a task for each shard.

Sums per source and per (source, cell) are aggregated before any window; a source's documents are
ordered within cells of about equal count, so that no task holds a whole source.

Defined cases: a null text has size 0 and nothing is taken from it; documents without a source are a
source of their own, ordered last; rows that share a doc_id are rows of their own, with ties in the
seeded order broken by size and a 64-bit hash of the text; a corpus without words gives targets of 0;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm import common

BLOCK, CAP, SEED, SHARDS = 16, 3, "mix-1", 16
#: Leading hex digits of a document's seeded key that name its cell: 4096 cells a source.
CELL_DIGITS = 3


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, place (from 1), source_size, target and mixed (words of the whole mix) from rows of (source, source_size), one for each source.

    A source is at its cap if its size by weight is at or below the level at which the others would
    share what the capped ones before it leave; sorted by size over weight, that is a prefix.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("place", place).withColumn("weight", (F.col("place") - 1) % 3 + 1)
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("gone"),
        F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"),
    )
    w = w.withColumn("capped", F.lit(cap) * F.col("source_size") * F.col("left") <= F.col("weight") * (F.col("total") - F.col("gone")))
    capped = F.coalesce(F.sum(F.when(F.col("capped"), F.lit(cap) * F.col("source_size"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * (F.col("total") - capped)).cast("double") / open_weight.cast("double")
    )
    mixed = F.when(open_weight > 0, F.col("total")).otherwise(capped)
    return w.select("source", "place", "source_size", target.alias("target"), mixed.cast("long").alias("mixed"))


def shard_seats(targets: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """place and upto, an array: the source's seats among those of the first shard, the first two and so on, by highest quotients."""
    everything = Window.partitionBy()
    t = targets.where("target > 0").select("place", "target", "mixed", (F.col("target") / F.col("mixed")).alias("share"), F.count("*").over(everything).alias("sources"))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("house", F.floor(F.floor(F.col("mixed") / block) * F.col("shard") / shards))
    # a source's seats differ from its share of them by at most share * sources / 2 + 1 / 2
    room = F.floor(F.col("share") * F.col("sources") / 2) + 2
    t = t.withColumn("base", F.greatest(F.lit(0).cast("long"), F.floor(F.col("share") * F.col("house")) - room))
    t = t.withColumn("free", F.col("house") - F.sum("base").over(Window.partitionBy("shard"))).withColumn("k", F.explode(F.sequence(F.col("base"), F.col("base") + 2 * room + 2)))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "place"))
    t = t.withColumn("won", (rank <= F.col("free")).cast("long")).groupBy("place", "shard").agg((F.first("base") + F.sum("won")).alias("seats"))
    return t.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "seats"))), lambda x: x["seats"]).alias("upto"))


def mix(docs: DataFrame, cap: int = CAP, block: int = BLOCK, seed: str = SEED, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words of it that the mix takes, repeats counted), shard_words (these by shard); and the columns in keep."""
    key: Column = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    d = docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.xxhash64("text").alias("th"), *keep).withColumn("cell", F.substring("key", 1, CELL_DIGITS))
    cells = d.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    sources = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), cap)
    sources = sources.join(shard_seats(sources, shards, block), "place", "left")
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
    # where each shard's last block ends in the source's words, laid end to end as often as needed
    most = cap * F.col("source_size")
    ends = F.coalesce(F.transform("upto", lambda x: F.least(x * block, most)), F.array_repeat(F.lit(0).cast("long"), shards))
    cells = cells.join(sources, cells.source.eqNullSafe(sources.source)).select(cells.source.alias("c_source"), F.col("cell").alias("c_cell"), "cell_before", "source_size", "target", ends.alias("ends"))
    j = d.join(cells, d.source.eqNullSafe(F.col("c_source")) & (d.cell == F.col("c_cell")))
    within = Window.partitionBy("c_source", "c_cell").orderBy("key", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("start", F.col("cell_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    def before(end: Column) -> Column:
        """The document's words in all passes before an end: whole passes, and what the last one holds."""
        whole = F.greatest(F.col("source_size"), F.lit(1))
        return F.floor(end / whole) * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), end % whole - F.col("start")))

    j = j.withColumn("upto", F.transform("ends", before))
    by_shard = F.transform("upto", lambda x, i: x - F.when(i > 0, F.element_at("upto", F.greatest(i, F.lit(1)))).otherwise(0))
    return j.select("doc_id", "size", "source", "source_size", "target", F.element_at("upto", -1).alias("taken"), by_shard.alias("shard_words"), *keep)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shard_words").cast("array<string>"), ",").alias("shard_words"))


OP2_SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')) as key from documents),
s as (select source, cast(sum(size) as hugeint) as source_size, row_number() over (order by source nulls last) as place from d group by source),
v as (select *, (place - 1) % 3 + 1 as weight from s),
w as (select *, sum(source_size) over () as total,
    {CAP} * coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as gone,
    sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as remain from v),
c as (select *, {CAP} * source_size * remain <= weight * (total - gone) as capped from w),
b as (select *, coalesce(sum(case when capped then {CAP} * source_size end) over (), 0) as full_words, sum(case when not capped then weight end) over () as open_weight from c),
t as (select *, case when capped then cast({CAP} * source_size as double) else cast(weight * (total - full_words) as double) / cast(open_weight as double) end as target,
    case when open_weight > 0 then total else full_words end // {BLOCK} as house from b),
k as (select place, house, target / (2 * unnest(range(0, cast(target / {BLOCK} as bigint) + (select count(*) from s) + 2)) + 1) as quotient from t where target > 0),
r as (select place, house, row_number() over (order by quotient desc, place) as seat from k),
u as (select place, shard, count(*) filter (where seat <= house * shard // {SHARDS}) as seats from r, (select unnest(range(1, {SHARDS} + 1)) as shard) group by place, shard),
q as (select t.*, coalesce(upto, list_transform(range({SHARDS}), lambda x: 0)) as upto from t left join (select place, list(seats order by shard) as upto from u group by place) using (place)),
x as (select *, least(upto[{SHARDS}] * {BLOCK}, {CAP} * source_size) as words, case when source_size > 0 then least(upto[{SHARDS}] * {BLOCK}, {CAP} * source_size) // source_size else 0 end as passes from q),
e as (select d.doc_id, d.size, x.source_size, x.target, x.words, x.passes, x.upto,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and 1 preceding), 0) as start
    from d join x on d.source is not distinct from x.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
    cast(passes * size + greatest(0, least(size, words - passes * source_size - start)) as bigint) as taken,
    array_to_string(list_transform(range({SHARDS}), lambda i: cast(list_sum(list_transform(range(cast(passes + 1 as bigint)), lambda p:
      greatest(0, least(upto[i + 1] * {BLOCK}, words, p * source_size + start + size) - greatest(case when i > 0 then upto[i] * {BLOCK} else 0 end, p * source_size + start)))) as bigint)), ',') as shard_words
from e
"""
