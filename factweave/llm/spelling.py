"""Spelling variants by a trie-node pair dictionary.

Words are counted over all texts. Their prefixes are the nodes of a forward trie, their suffixes
the nodes of a reversed one, and every node gets a number. Cut before character i, a word is the pair
(node of what stands before i, node of what stands from i); with character i skipped, it is
(node before i, node after i). Numbers name strings exactly, so

- two words that differ by one replaced character share a skipped pair,
- a word with one character more shares a skipped pair with a cut pair of the shorter word,

and nothing else does. A skipped pair is a group of words that differ in one place, bounded by the
alphabet. Groups are reduced to their number of words and the two best of them, cut pairs join the
reduced groups, and no pair of words is ever listed. A doubled letter can be skipped at several
places with one result; only the first of a run counts as the place of an insertion.

A word's form is its most frequent neighbour if that is frequent enough. Following forms, n at least
doubles at every step for a `ratio` of two, so chains are short; they are followed by pointer jumping.

A word has as many prefixes as characters, so runs of hundreds of letters are not put into the tries
whole. Words above `longest` characters meet by halves: one edit leaves the first or the last half of
the shorter word unharmed, so neighbours share the hash of a half and its place; the few pairs that do
are decided by their edit distance. Both ways are exact and split the pairs between them by length.

Everything is built-in functions and equi-joins; after counting, all work is on the vocabulary.

Defined results: null and empty texts have no words; a null id is written as nothing before the colon;
rows repeated in full count each; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.llm.text import lower_ascii, read_table
from factweave.session import stage

RUN = "[A-Za-zÀ-ÿ]+"


@dataclass(frozen=True)
class Spelling:
    """`least_length` and `least_count`: what makes a word; `ratio`: how much more frequent a form is; `dropped`: one run in so many loses a character (0: none); `longest`: length up to which words are put into tries."""

    least_length: int = 5
    least_count: int = 3
    ratio: float = 2.0
    dropped: int = 97
    longest: int = 64


def _with_slips(doc_id: Column, run: Column, spec: Spelling) -> Column:
    """The run, or by a hash of id and run the run without one of its characters."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % spec.dropped == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def words(docs: DataFrame, doc_id: str, text: str, spec: Spelling) -> DataFrame:
    """word, n."""
    runs = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    word = _with_slips(F.col("id"), F.col("run"), spec) if spec.dropped else F.col("run")
    # A run one character too short can be no word, and a slip only shortens it.
    counted = runs.filter(F.length("run") >= spec.least_length).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= spec.least_length) & (F.col("n") >= spec.least_count))


def _numbered(parts: DataFrame, name: str) -> DataFrame:
    """A number from one on for every distinct non-empty `part`: a trie node each."""
    return stage(parts.filter("part <> ''").distinct().select("part", (F.monotonically_increasing_id() + 1).alias(name)), name)


def trie_pairs(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cuts: word, n, p, s for every place between characters; skips: word, n, p, s, canonical for every character left out."""
    length = F.length("word")
    spots = vocabulary.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("i"))
    split = spots.select("word", "n", "i", F.substr("word", F.lit(1), F.col("i")).alias("before"), F.substr("word", F.col("i") + 1).alias("after"))
    forward = _numbered(split.select(F.col("before").alias("part")), "p")
    backward = _numbered(split.select(F.col("after").alias("part")), "s")
    placed = split.join(forward.withColumnRenamed("part", "before"), "before", "left").join(backward.withColumnRenamed("part", "after"), "after", "left")
    nodes = stage(placed.select("word", "n", "i", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("s", F.lit(0)).alias("s")), "spelling-nodes")
    following = nodes.select("word", (F.col("i") - 1).alias("i"), F.col("s").alias("next"))
    here, last = F.substr("word", F.col("i") + 1, F.lit(1)), F.substr("word", F.col("i"), F.lit(1))
    skips = nodes.join(following, ["word", "i"]).select("word", "n", "p", F.col("next").alias("s"), ((F.col("i") == 0) | (here != last)).alias("canonical"))
    return nodes.select("word", "n", "p", "s"), stage(skips, "spelling-skips")


def _long_neighbours(vocabulary: DataFrame, longest: int) -> DataFrame:
    """word, k and best for pairs of which one word at least has more than `longest` + 1 characters."""
    word, length = F.col("word"), F.length("word")
    long = vocabulary.filter(length > longest).select("word", "n", F.xxhash64("word").alias("w"), length.alias("size"))

    def halves(shorter: Column) -> Column:
        """Hashes of the halves, where the shorter word of a pair has `shorter` characters."""
        half = F.floor(shorter / 2).cast("int")
        return F.array(F.xxhash64(shorter, F.lit("first"), F.substr(word, F.lit(1), half)), F.xxhash64(shorter, F.lit("last"), F.substr(word, length - (shorter - half) + 1)))

    own = stage(long.select("word", "n", "w", "size", F.explode(halves(length)).alias("half")), "spelling-halves")
    more = long.select("word", "n", "w", "size", F.explode(halves(length - 1)).alias("half"))
    named = lambda df, side: df.select("half", *[F.col(c).alias(f"{c}_{side}") for c in ("word", "n", "w", "size")])
    a, b, c = named(own, "a"), named(own, "b"), named(more, "b")
    met = a.join(b, "half").filter("w_a < w_b").union(a.join(c, "half")).filter(F.greatest("size_a", "size_b") > longest + 1)
    pairs = met.filter((F.col("word_a") != F.col("word_b")) & (F.levenshtein("word_a", "word_b", 1) == 1)).dropDuplicates(["word_a", "word_b"])
    side = lambda x, y: pairs.select(F.col(f"word_{x}").alias("word"), F.lit(1).cast("long").alias("k"), F.struct((-F.col(f"n_{y}")).alias("minus"), F.col(f"word_{y}").alias("word")).alias("best"))
    return side("a", "b").union(side("b", "a"))


def neighbours(vocabulary: DataFrame, longest: int) -> DataFrame:
    """word, n_near and best, a struct (minus n, word) of its most frequent neighbour, for words that have one."""
    cuts, skips = trie_pairs(vocabulary.filter(F.length("word") <= longest + 1))
    rank = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    inserted = F.when(F.col("canonical"), rank)
    groups = skips.groupBy("p", "s").agg(
        F.count(F.lit(1)).alias("size"), F.min(rank).alias("first"), F.min(inserted).alias("longest"), F.count_if("canonical").alias("longer"))
    groups = stage(groups, "spelling-groups")
    # One replaced: all others of the group; the best of them is the first, or for the first itself the second.
    crowded = groups.filter("size > 1").select("p", "s", "size", "first")
    shared = skips.join(crowded, ["p", "s"]).select("word", "n", "p", "s", "size", "first")
    second = shared.filter(F.col("word") != F.col("first.word")).groupBy("p", "s").agg(F.min(rank).alias("second"))
    replaced = shared.join(second, ["p", "s"]).select("word", (F.col("size") - 1).alias("k"), F.when(F.col("word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    # One more: a cut of the shorter word meets the words that have a character there.
    met = stage(cuts.join(groups.filter("longer > 0").select("p", "s", "longest", "longer"), ["p", "s"]), "spelling-met")
    longer = met.select("word", F.col("longer").alias("k"), F.col("longest").alias("best"))
    shorter = skips.filter("canonical").join(met.select("p", "s", rank.alias("best")), ["p", "s"]).select("word", F.lit(1).cast("long").alias("k"), "best")
    return replaced.union(longer).union(shorter).union(_long_neighbours(vocabulary, longest)).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: Spelling = Spelling()) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    vocabulary = stage(words(docs, doc_id, text, spec), "spelling-words")
    near = vocabulary.join(neighbours(vocabulary, spec.longest), "word", "left")
    frequent = -F.col("best.minus") >= spec.ratio * F.col("n")
    formed = stage(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    # A pointer twice as far each round; words that have no form are ends.
    links = formed.filter("form is not null").select("word", F.col("form").alias("to"))
    ends = stage(links, "spelling-links")
    while True:
        ahead = ends.select(F.col("word").alias("to"), F.col("to").alias("further"))
        moved = stage(ends.join(ahead, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "spelling-links")
        ends = moved.select("word", "to")
        if moved.filter("moved").isEmpty():
            break
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))
