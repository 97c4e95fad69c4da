"""Line dedup by a log-template tree.

Lines are parsed at fixed depth: by their number of words, then by their leading words,
words with a digit counting as a variable field at every level. In a leaf, lines of equal
length share a template if they agree in all words after masking, or in all but one of
five equal spans, the variable field; either way at least four fifths of the words are
fixed. A template that recurs across documents is dropped from all of them but its first
(smallest id). No document is exempt: a template stays only if all its occurrences lie in
documents with the same set of masked lines, copies of one another, which document dedup
handles; it goes from all documents but its first otherwise.

Words, lines and documents are compared by 128-bit hashes, so only hashes are shuffled
until the texts are rebuilt. What is computed from a whole text (its key, the hash of its
line set) is computed below the explode, once per document and not once per line. Leaves that too few documents reach are not generalised,
since no template in them can recur. Counts are aggregated map-side; a hot template is a
hot key only beside its one-row decision, where the adaptive skew join splits it.

Defined results: a null text is an empty text and stays null; blank lines are never
dropped; lines without any fixed word (digits only) are never dropped; a line repeated
inside one document counts once for it and stays or goes as a whole; rows repeated with
the same id and text count as one document and get equal results; null ids come last in
order; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.llm.text import read_table
from factweave.session import stage

_BLANK = r"[\x20\x09-\x0D]"
# A word with a digit; the look-behind lets a match start at a word only, so that a long word is walked once.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
MASK = "<*>"
SPANS = 5


@dataclass(frozen=True)
class LineDedup:
    """`min_documents`: where a template recurs; `leading`: depth of the tree."""

    min_documents: int = 3
    leading: int = 3


def _document(doc_id: Column, text: Column) -> list[Column]:
    """128-bit key of a document row: equal rows share it."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(doc_id.isNull(), doc_id, body).alias("d1"), F.xxhash64(F.lit(1), body, doc_id, doc_id.isNull()).alias("d2")]


def _line_set(body: Column) -> Column:
    """Hash of the set of masked lines of a text with a fixed word; documents with equal sets are copies of one another."""
    masked = F.regexp_replace(F.regexp_replace(body, _VARIABLE, MASK), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(masked, "\n"), F.btrim), lambda line: ~line.rlike(rf"^(?:{re.escape(MASK)} ?)*+$"))
    return F.xxhash64(F.array_sort(F.array_distinct(lines)))


def parsed_lines(docs: DataFrame, doc_id: str, text: str, spec: LineDedup) -> DataFrame:
    """d1, d2, id order `doc`, hash `copy` of the document's line set, line number, words n, fixed words, leaf, span hashes and template hash of every line with words."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(*_document(F.col(doc_id), F.col(text)), F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id")).alias("doc"),
                        _line_set(body).alias("copy"), body.alias("body"))
    lines = whole.select("d1", "d2", "doc", "copy", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    bare = lines.select("d1", "d2", "doc", "copy", "line_no", F.btrim("line", F.lit(" \t\n\v\f\r")).alias("line")).filter("line <> ''")
    variable = F.col("line").rlike("[0-9]")
    masked = F.when(variable, F.regexp_replace("line", _VARIABLE, MASK)).otherwise(F.col("line"))
    worded = bare.select("d1", "d2", "doc", "copy", "line_no", variable.alias("variable"), F.split(masked, f"{_BLANK}+").alias("words"))
    n = F.size("words")
    bound = lambda i: F.floor(n * i / F.lit(SPANS)).cast("int")
    spans = [F.xxhash64(F.slice("words", bound(i) + 1, bound(i + 1) - bound(i))) for i in range(SPANS)]
    hashed = worded.select(
        "d1", "d2", "doc", "copy", "line_no", n.alias("n"), F.when(F.col("variable"), n - F.size(F.filter("words", lambda w: w == MASK))).otherwise(n).alias("fixed"),
        F.xxhash64(n, F.slice("words", 1, spec.leading)).alias("leaf"), F.array(*spans).alias("spans"))
    return hashed.withColumns({"t1": F.xxhash64("n", "spans"), "t2": F.xxhash64(F.lit(1), "spans", "n")})


def busy_lines(lines: DataFrame, spec: LineDedup) -> DataFrame:
    """Lines of leaves that enough lines reach: no template elsewhere can recur."""
    busy = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= spec.min_documents).select("leaf")
    return stage(lines.filter("fixed > 0").join(busy, "leaf", "left_semi"), "busy-lines")


def templates(lines: DataFrame, spec: LineDedup) -> DataFrame:
    """lines: of busy leaves. t1, t2 and first (document) for every masked line whose template recurs."""
    once = lines.groupBy("t1", "t2", "d1", "d2").agg(*[F.any_value(c).alias(c) for c in ("doc", "copy", "leaf", "n", "fixed", "spans")])
    at = F.struct("doc", "d1", "d2")
    exact = stage(once.groupBy("t1", "t2").agg(
        F.count(F.lit(1)).alias("documents"), F.min(at).alias("first"), F.max(at).alias("last"), F.min("copy").alias("low"), F.max("copy").alias("high"), *[F.any_value(c).alias(c) for c in ("leaf", "n", "fixed", "spans")]), "line-templates")
    # One key per span taken as the variable field; lines with masked words have theirs already.
    others = lambda i: F.filter("spans", lambda _, at: at != i)
    keyed = exact.filter((F.col("fixed") == F.col("n")) & (F.col("n") >= SPANS)).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(SPANS - 1)))).select(
        "t1", "t2", "documents", "first", "last", "low", "high", "leaf", "span",
        F.xxhash64("leaf", "span", others(F.col("span"))).alias("w1"), F.xxhash64(F.lit(1), "span", others(F.col("span"))).alias("w2"))
    wild = keyed.groupBy("leaf", "span", "w1", "w2").agg(
        F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("k"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    apart = F.col("low") != F.col("high")
    # A template of one document's own lines does not recur across documents.
    wild = wild.filter(apart & (F.col("k") > 1) & (F.col("documents") >= spec.min_documents) & (F.col("first") != F.col("last")))
    rare = keyed.filter(F.col("documents") < spec.min_documents).select("t1", "t2", "leaf", "span", "w1", "w2")
    generalised = rare.join(wild.select("leaf", "span", "w1", "w2", "first"), ["leaf", "span", "w1", "w2"]).groupBy("t1", "t2").agg(F.min(F.struct("span", "first")).alias("best"))
    return exact.filter(apart & (F.col("documents") >= spec.min_documents)).select("t1", "t2", "first").union(generalised.select("t1", "t2", "best.first"))


def dropped_lines(lines: DataFrame, spec: LineDedup) -> DataFrame:
    """d1, d2 and the numbers of the lines to drop, for every document that loses some."""
    busy = busy_lines(lines, spec)
    recurring = busy.join(templates(busy, spec), ["t1", "t2"]).filter(F.col("first") != F.struct("doc", "d1", "d2"))
    return recurring.groupBy("d1", "d2").agg(F.collect_set("line_no").alias("numbers"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: LineDedup = LineDedup()) -> DataFrame:
    """`row` (all columns of the document), the text without dropped lines, and lines_dropped."""
    # Rows repeated in full have equal keys: they count as one document, and repeat all their words alike.
    lines = stage(parsed_lines(docs, doc_id, text, spec), "lines")
    drops = dropped_lines(lines, spec)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("body"), *_document(F.col(doc_id), F.col(text)))
    kept = F.filter(F.split("body", "\n"), lambda _, at: ~F.array_contains("numbers", at))
    joined = rows.join(drops, ["d1", "d2"], "left")
    return joined.select("row", F.when(F.col("numbers").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("clean"),
                         F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("lines_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_lines(read_table(spark, sf_dir, "documents"))
    return clean.select("row.doc_id", "lines_dropped", F.sha2(F.coalesce("clean", F.lit("")), 256).alias("text_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents
), parsed AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM split
), lines AS (
  SELECT doc_id, line_no, w, len(w) AS n, len(list_filter(w, lambda x: x <> '<*>')) AS fixed FROM parsed WHERE len(w) > 0
), sets AS (
  SELECT doc_id, md5(array_to_string(list_sort(list(DISTINCT array_to_string(w, ' '))), chr(10))) AS copy FROM lines WHERE fixed > 0 GROUP BY doc_id
), usable AS (SELECT * FROM lines JOIN sets USING (doc_id) WHERE fixed > 0
), exact AS (
  SELECT w, n, fixed, count(DISTINCT doc_id) AS documents, min(doc_id) AS first, max(doc_id) AS last, min(copy) AS low, max(copy) AS high FROM usable GROUP BY w, n, fixed
), keyed AS (
  SELECT w, documents, first, last, low, high, n, w[1:3] AS lead, span,
         list_concat(w[1:CAST(floor(n * span / 5) AS INT)], ['<field>'], w[CAST(floor(n * (span + 1) / 5) AS INT) + 1:n]) AS wild
  FROM exact, range(5) AS r(span) WHERE n >= 5 AND fixed = n
), templates AS (
  SELECT n, lead, span, wild, min(first) AS first FROM keyed GROUP BY n, lead, span, wild
  HAVING count(*) > 1 AND sum(documents) >= 3 AND min(first) <> max(last) AND min(low) <> max(high)
), generalised AS (
  SELECT k.w, arg_min(t.first, k.span) AS first FROM keyed k JOIN templates t ON k.n = t.n AND k.lead = t.lead AND k.span = t.span AND k.wild = t.wild WHERE k.documents < 3 GROUP BY k.w
), recurring AS (SELECT w, first FROM exact WHERE documents >= 3 AND low <> high UNION ALL SELECT w, first FROM generalised
), drops AS (
  SELECT doc_id, list(line_no) AS numbers FROM usable JOIN recurring USING (w) WHERE doc_id <> first GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(numbers), 0) AS BIGINT) AS lines_dropped,
       sha256(CASE WHEN numbers IS NULL THEN coalesce(text, '') ELSE coalesce((
         SELECT string_agg(line, chr(10) ORDER BY line_no) FROM split s WHERE s.doc_id = d.doc_id AND NOT list_contains(numbers, s.line_no)), '') END) AS text_sha256
FROM documents d LEFT JOIN drops USING (doc_id)
"""
