"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, row string, clean string, node long, fp long, h long, at string, "
    "place string, block int, size long, label int, digest string, d1 long, uid long, component_id long"
)


def documents(spark):
    texts = [
        (1, "The quick  brown\tfox.\nAll rights reserved.", "a"), (2, None, "b"), (3, "", None), (4, " \n\t ", "b"), (5, "x" * 300_000, "a"), (6, "word " * 60_000, None),
        (7, "The quick brown fox. All rights reserved.", "a"), (7, "The quick brown fox. All rights reserved.", "a"), (None, "no id here at all today", "c"),
        (None, "no id here at all today", "c"), (8, "héllo wörld ▁▁ 日本語 😀 \x00 end", "c"), (9, "trash idiot", None), (10, "a", "a"), (11, "a", "b"), (None, None, None),
    ]
    rows = [(i, t, "en", s, None if t is None else len(t), 0.5, True, "r", "c", 1, 2, 3, "at", "p", 4, 5, 6, "d", 7, 8, 9) for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2, "x") for i in range(1, 12)] + [(None, 1, 1, "x"), (3, None, None, "x"), (4, 1, 1, "x"), (4, 0, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def empty(df):
    return df.filter("1 = 0")
