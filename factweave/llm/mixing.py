"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into a fixed number of blocks of documents. A source's target is met
by whole passes over its blocks plus a drawn part of one more pass; every (pass, block)
is a ticket, and the tickets of a source are its exact quota. A binary tree splits the
quotas among the output shards: at each node the left half receives, source by source, a
hypergeometric draw from what is left, so shards are equally long and each one is a
uniform sample of the mix, while no ticket is lost or doubled. A shard then takes the next
tickets of each source's permuted sequence, and its rows are shuffled inside the shard.

Only counts travel through the tree: a source has at most `blocks` x 3 tickets, so the
tree's rows grow with the number of sources and shards, never with the documents.
Documents meet the tickets by (source, block), which splits a hot source into `blocks`
keys. All randomness is a hash of the seed: reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; a null id falls in one block; rows repeated with one id are drawn together; sources
without words have target 0; an empty table gives an empty mix. A source's words taken
differ from its target by less than its smallest block left out. Column names of the
documents cannot clash with helper columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from factweave.llm.text import read_table, word_count
from factweave.session import stage


@dataclass(frozen=True)
class Mix:
    """`shards` must be a power of two; `weights` repeat over the sources in order."""

    doc_id: str = "doc_id"
    text: str = "text"
    source: str = "source"
    weights: Sequence[float] = (5, 2, 1)
    max_passes: int = 3
    blocks: int = 1024
    shards: int = 64
    seed: int = 20


SOURCE = ("no_source", "source")


def _key(source: Column) -> list[Column]:
    return [source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source")]


def _block(mix: Mix, doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(mix.seed), doc_id), F.lit(mix.blocks)).cast("int")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def sizes(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, source key, size in words and block of every document."""
    return docs.select(
        F.col(mix.doc_id).alias("doc_id"), *_key(F.col(mix.source)), word_count(F.col(mix.text)).alias("size"), _block(mix, F.col(mix.doc_id)).alias("block"))


def targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """Per source: its words, its target and its blocks with their words.

    Weighted shares capped at `max_passes` times a source's words, the excess reshared by
    weight: with the sources in order of cap per weight, the water level is the largest of
    the levels reached when all sources before are full.
    """
    blocks = sized.groupBy(*SOURCE, "block").agg(F.sum("size").alias("words"))
    sources = blocks.groupBy(*SOURCE).agg(F.sum("words").alias("source_size"), F.sort_array(F.collect_list(F.struct("block", "words"))).alias("blocks"))
    rank = F.row_number().over(W.orderBy(*SOURCE)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (rank % len(mix.weights) + 1).cast("int"))
    cap = F.col("source_size") * float(mix.max_passes)
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), *SOURCE)
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    after = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", level)
    return filled.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everything))).select(*SOURCE, "source_size", "target", "blocks")


def tickets(goals: DataFrame, mix: Mix) -> DataFrame:
    """Per source: its tickets (pass, block) in permuted order."""
    hashed = lambda salt, b: F.xxhash64(F.lit(mix.seed), salt, *SOURCE, b)
    passes = F.least(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0), F.lit(mix.max_passes)).cast("int")
    staged = goals.withColumn("passes", passes).withColumn("short", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    order = F.array_sort(F.transform("blocks", lambda b: F.struct(hashed(F.lit("part"), b["block"]).alias("h"), b["block"].alias("block"), b["words"].cast("double").alias("words"))))
    staged = staged.withColumn("order", order)
    # The part of one more pass: blocks in permuted order, each taken if it still fits.
    none = F.array().cast("array<int>")
    fill = F.aggregate(
        "order", F.struct(F.col("short").alias("short"), none.alias("picked")),
        lambda a, b: F.when((b["words"] > 0) & (b["words"] <= a["short"]), F.struct((a["short"] - b["words"]).alias("short"), F.array_append(a["picked"], b["block"]).alias("picked"))).otherwise(a))
    staged = staged.withColumn("fill", fill)
    # One block more where that comes nearer to the target.
    spare = F.array_min(F.filter(F.transform("order", lambda b: F.struct(b["words"].alias("words"), b["block"].alias("block"))),
                                 lambda b: (b["words"] > 0) & ~F.array_contains(F.col("fill.picked"), b["block"])))
    staged = staged.withColumn("spare", spare)
    nearer = (F.col("passes") < mix.max_passes) & (F.col("spare.words") - F.col("fill.short") < F.col("fill.short"))
    picked = F.when(nearer, F.array_append(F.col("fill.picked"), F.col("spare.block"))).otherwise(F.col("fill.picked"))
    rounds = F.when(F.col("passes") > 0, F.sequence(F.lit(1), F.col("passes"))).otherwise(none)
    whole = F.flatten(F.transform(rounds, lambda p: F.transform("blocks", lambda b: F.struct(hashed(p, b["block"]).alias("h"), p.alias("pass"), b["block"].alias("block")))))
    part = F.transform(picked, lambda b: F.struct(hashed(F.col("passes") + 1, b).alias("h"), (F.col("passes") + 1).alias("pass"), b.alias("block")))
    return staged.withColumn("whole", whole).withColumn("part", part).select(*SOURCE, F.array_sort(F.concat("whole", "part")).alias("tickets"))


def hypergeometric(u: Column, good: Column, total: Column, drawn: Column) -> Column:
    """The draw that belongs to `u`: how many of `good` among `total` are in `drawn` ones.

    Weights relative to the mode by their recurrence, upwards and then downwards, summed
    once for the total and once until `u` times it is reached; each walk has at most
    `good` steps.
    """
    low, high = F.greatest(F.lit(0), drawn - (total - good)), F.least(good, drawn)
    mode = F.least(F.greatest(F.floor((drawn + 1.0) * (good + 1.0) / (total + 2.0)).cast("long"), low), high)
    real = lambda c: c.cast("double")
    up = lambda k, w: w * real(good - k + 1) * real(drawn - k + 1) / (real(k) * real(total - good - drawn + k))  # noqa: E731  from k-1 to k
    down = lambda k, w: w * real(k + 1) * real(total - good - drawn + k + 1) / (real(good - k) * real(drawn - k))  # noqa: E731  from k+1 to k
    rising = F.when(mode < high, F.sequence(mode + 1, high)).otherwise(F.array().cast("array<bigint>"))
    falling = F.when(mode > low, F.sequence(mode - 1, low, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def walk(start: Column, steps: Column, ratio) -> Column:
        """start: weight at the mode, sum so far, bound of the sum, value found or null."""
        def step(a, k):
            w = ratio(k, a["w"])
            sum_ = a["sum"] + w
            return F.struct(w.alias("w"), sum_.alias("sum"), a["bound"].alias("bound"), F.coalesce(a["found"], F.when(sum_ > a["bound"], k)).alias("found"))
        return F.aggregate(steps, start, step)

    def from_mode(bound: Column) -> Column:
        first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), bound.alias("bound"), F.when(bound < 1.0, mode).alias("found"))
        above = walk(first, rising, up)
        again = F.transform(F.array(above), lambda a: F.struct(F.lit(1.0).alias("w"), a["sum"].alias("sum"), a["bound"].alias("bound"), a["found"].alias("found")))[0]
        return walk(again, falling, down)

    return F.coalesce(from_mode(u * from_mode(F.lit(float("inf")))["sum"])["found"], low)


def splitting_tree(quotas: DataFrame, mix: Mix) -> DataFrame:
    """quotas: source key and n. Returns source key, shard and the number of tickets n it gets."""
    if mix.shards < 1 or mix.shards & (mix.shards - 1):
        raise ValueError("shards must be a power of two")
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct(*SOURCE, "n"))).alias("quota")).select(F.lit(0).alias("shard"), "quota")
    for level in range(mix.shards.bit_length() - 1):
        count = F.aggregate("quota", F.lit(0).cast("long"), lambda a, q: a + q["n"])
        node = node.withColumn("count", count)
        # The left side takes half of the tickets; an odd one goes to a side by chance.
        odd = F.pmod(F.xxhash64(F.lit(mix.seed), F.lit(level), "shard"), F.lit(2)) * (F.col("count") % 2)
        half = F.shiftright("count", 1) + odd
        empty = F.array().cast("array<struct<no_source:boolean,source:string,n:bigint>>")

        def give(a, q):
            u = _uniform(F.lit(mix.seed), F.lit(level), F.col("shard"), q["no_source"], q["source"])
            drawn = F.transform(F.array(hypergeometric(u, q["n"], a["total"], a["open"])), lambda x: F.struct(
                (a["total"] - q["n"]).alias("total"), (a["open"] - x).alias("open"),
                F.array_append(a["out"], F.struct(q["no_source"].alias("no_source"), q["source"].alias("source"), x.alias("n"))).alias("out")))
            return drawn[0]

        left = F.aggregate("quota", F.struct(F.col("count").alias("total"), half.cast("long").alias("open"), empty.alias("out")), give)["out"]
        node = node.withColumn("left", left)
        right = F.zip_with("quota", "left", lambda q, x: F.struct(q["no_source"].alias("no_source"), q["source"].alias("source"), (q["n"] - x["n"]).alias("n")))
        node = node.select("shard", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("quota")), F.struct(F.lit(1).alias("side"), right.alias("quota")))).alias("child")) \
            .select((F.col("shard") * 2 + F.col("child.side")).alias("shard"), F.col("child.quota").alias("quota"))
    return node.select("shard", F.inline("quota"))


def deal(sized: DataFrame, mix: Mix) -> DataFrame:
    """Source key, source_size, target and the dealt tickets as an array of (shard, pass, block)."""
    goals = stage(targets(sized, mix), "mix-targets")
    sequence = stage(tickets(goals, mix), "mix-tickets")
    shares = splitting_tree(sequence.select(*SOURCE, F.size("tickets").cast("long").alias("n")), mix)
    runs = shares.groupBy(*SOURCE).agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("runs"))
    # Shard by shard, the next n tickets of the source's sequence.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<int>>").alias("out"))
    cut = F.aggregate("runs", start, lambda a, r: F.struct((a["at"] + r["n"]).alias("at"), F.array_append(a["out"], F.array_repeat(r["shard"], r["n"].cast("int"))).alias("out")))
    placed = F.arrays_zip(F.flatten(cut["out"]).alias("shard"), F.col("tickets.pass").alias("pass"), F.col("tickets.block").alias("block"))
    return sequence.join(runs, list(SOURCE)).select(*SOURCE, placed.alias("dealt")).join(goals.select(*SOURCE, "source_size", "target"), list(SOURCE), "right")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix: `row` (the document's columns), shard and pass, shuffled inside each shard.

    A shard is spread over several tasks by a hash of the document, each locally shuffled,
    so that no task holds a whole shard.
    """
    sized = stage(sizes(docs, mix), "mix-sizes")
    dealt = deal(sized, mix).select(*SOURCE, F.explode("dealt").alias("t")).select(*SOURCE, "t.shard", "t.pass", "t.block")
    rows = docs.select(F.struct("*").alias("row"), *_key(F.col(mix.source)), _block(mix, F.col(mix.doc_id)).alias("block"))
    mixed_rows = rows.join(dealt, [*SOURCE, "block"])
    place = F.xxhash64(F.lit(mix.seed), F.col("shard"), F.col("pass"), F.col("row").getField(mix.doc_id))
    return (
        mixed_rows.select("row", "shard", "pass", place.alias("place")).repartition("shard", F.pmod("place", F.lit(16)))
        .sortWithinPartitions("shard", "place").select("row", "shard", "pass")
    )


def op10_mix(spark: SparkSession, sf_dir: str, mix: Mix = Mix()) -> DataFrame:
    sized = stage(sizes(read_table(spark, sf_dir, "documents"), mix), "mix-sizes")
    dealt = stage(deal(sized, mix), "mix-dealt")
    # inline_outer keeps sources without tickets, which have a target too.
    drawn = dealt.select(*SOURCE, F.explode("dealt").alias("t")).groupBy(*SOURCE, F.col("t.block").alias("block")).agg(
        F.count(F.lit(1)).alias("passes"), F.sort_array(F.collect_list("t.shard")).alias("shards"))
    goals = dealt.select(*SOURCE, "source_size", "target")
    return (
        sized.join(drawn, [*SOURCE, "block"], "left").join(goals, list(SOURCE))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("passes", F.lit(0))).alias("taken"), "shards")
    )
