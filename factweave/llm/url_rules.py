"""URL filter: explicit host and path rules first, mined association rules for the rest.

Labels come from the explicit rules (a page that one fits is labelled by it) and from the
label table (toxic: block). Spark's FP-growth mines token combinations together with the
label from all labelled pages. Tokens that stand on exactly the same labelled pages, like the
parameters of one form, are one item to the miner, so that it does not list their subsets; a page that
holds any of them holds the item, just as if there were a rule for each. Combinations that imply `block`
with enough support and confidence stay, unless one with a token less is as sure. A page is matched through an
inverted index: each rule is filed under its rarest token, a page looks up its tokens and
checks the rest of the rule. Equal token sets are looked up once. What the miner lists is still all frequent
combinations of items: many tokens that occur together in many different selections remain many.

Defined results: a null url or one without `://` has an empty host and path, no tokens,
fits no rule and gets the default verdict `allow`; repeated page rows each get a row; an
empty table gives an empty result; no labels or none of one kind give no mined rules.
Other columns of the tables are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.llm.text import lower_ascii, read_table
from factweave.session import stage

# --- fixed values: the explicit rules (host, path, verdict) ---------------------
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
PLACE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BLOCK, ALLOW = "label=block", "label=allow"


@dataclass(frozen=True)
class Mining:
    support: float = 0.002
    confidence: float = 0.8


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PLACE, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PLACE, 2), F.lit(""))


def explicit_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), null if none fits. A rule fits its host and all subdomains."""
    rule = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(rule)
    return rule


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: labels of the host, path segments, file ending, query names; digits are masked."""
    mask = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    some = lambda parts: F.filter(parts, lambda x: x != "")
    tagged = lambda tag, parts: F.transform(some(parts), lambda x: F.concat(F.lit(tag), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    known = F.concat(
        tagged("host:", F.split(mask(host), r"\.")), tagged("path:", F.split(mask(path), "/")),
        tagged("end:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))),
        tagged("query:", F.transform(F.split(query, "&"), lambda x: mask(F.regexp_extract(x, "^([^=]*)", 1)))))
    return F.array_sort(F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(known)))


def judged_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, tokens and explicit rule of every page row."""
    placed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return placed.select("page_id", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), explicit_rule(F.col("host"), F.col("path")).alias("explicit"))


def transactions(urls: DataFrame, labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """Tokens and label of every labelled page."""
    given = labels.groupBy(F.col(doc_id).alias("page_id")).agg(F.max(toxic).alias("toxic"))
    labelled = urls.join(given, "page_id", "left")
    label = F.coalesce(F.concat(F.lit("label="), F.col("explicit.verdict")), F.when(F.col("toxic") == 1, F.lit(BLOCK)).when(F.col("toxic") == 0, F.lit(ALLOW)))
    return labelled.withColumn("label", label).filter(F.col("label").isNotNull()).select("tokens", "label")


def merged_tokens(labelled: DataFrame, mining: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """Of labelled pages (tokens, label): token and item of every token with enough support, equal items for tokens of the same pages; and the `items` of every page."""
    pages = stage(labelled.withColumn("page", F.monotonically_increasing_id()), "url-transactions")
    least = mining.support * pages.count()
    held = pages.select("page", F.explode("tokens").alias("token"))
    # The set of a token's pages by its size and two hashes.
    signed = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("page")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "page")).alias("b")).filter(F.col("n") >= least)
    named = signed.groupBy("n", "a", "b").agg(F.min("token").alias("item"), F.collect_list("token").alias("of")).select("item", F.explode("of").alias("token"))
    items_of = stage(named, "url-items")
    found = held.join(items_of, "token").groupBy("page").agg(F.collect_set("item").alias("found"))
    joined = pages.join(found, "page", "left")
    return items_of, joined.select(F.array_append(F.coalesce("found", F.array().cast("array<string>")), F.col("label")).alias("items"))


def mine(items: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules: antecedent (sorted items), confidence, support and the `key` item of the index."""
    model = FPGrowth(itemsCol="items", minSupport=mining.support, minConfidence=mining.confidence).fit(items)
    implied = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK))).filter(~F.array_contains("antecedent", ALLOW))
    sure = stage(implied.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "url-rules")
    shorter = sure.filter(F.size("antecedent") > 1).select(
        F.col("antecedent").alias("longer"), "confidence", F.explode("antecedent").alias("token")
    ).select("longer", "confidence", F.array_remove("longer", F.col("token")).alias("antecedent"))
    covered = shorter.join(sure.select("antecedent", F.col("confidence").alias("as_sure")), "antecedent").filter("as_sure >= confidence")
    kept = sure.join(covered.select(F.col("longer").alias("antecedent")).distinct(), "antecedent", "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    keyed = kept.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(single, "token")
    return stage(keyed.groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("key")), "url-index")


def match(urls: DataFrame, rules: DataFrame, items_of: DataFrame) -> DataFrame:
    """tokens, and the surest rule whose items are all held, shown by the page's own tokens; one row per matched token set."""
    sets = urls.select("tokens").distinct()
    named = sets.select("tokens", F.explode("tokens").alias("token")).join(items_of, "token").groupBy("tokens").agg(
        F.collect_set("item").alias("held"), F.collect_list(F.struct("item", "token")).alias("named"))
    hits = named.select("tokens", "held", "named", F.explode("held").alias("key")).join(rules, "key").filter(F.size(F.array_except("antecedent", "held")) == 0)
    best = hits.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "antecedent", "named")).alias("m"))
    shown = F.transform("m.antecedent", lambda i: F.array_min(F.transform(F.filter("m.named", lambda x: x["item"] == i), lambda x: x["token"])))
    return best.select("tokens", F.struct(F.col("m.confidence").alias("confidence"), F.col("m.support").alias("support"), F.array_sort(shown).alias("antecedent")).alias("mined"))


def filter_urls(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict and, where mined rules decided, the rule's tokens and confidence."""
    urls = stage(judged_urls(pages), "urls")
    items_of, items = merged_tokens(transactions(urls, labels), mining)
    rules = mine(items, mining)
    verdicts = urls.join(match(urls.filter("explicit is null"), rules, items_of), "tokens", "left")
    free = F.col("explicit").isNull()
    return verdicts.select(
        "page_id", "host", "path", F.col("explicit.rule").alias("rule"),
        F.coalesce("explicit.verdict", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(free, F.col("mined.antecedent")).alias("mined_tokens"), F.when(free, F.col("mined.confidence")).alias("confidence"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))
