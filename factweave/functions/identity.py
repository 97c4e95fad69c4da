"""Deterministic content ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

NULL_TOKEN = "-;"


def number_token(c: Column) -> Column:
    """Text of a double, equal exactly for equal numbers; +0 and -0 agree.

    Numbers with up to six decimals use plain decimal text, all others the full
    scientific form.
    """
    x = c.cast("double")
    plain = x.try_cast("decimal(38,6)")
    return F.when(plain.cast("double") == x, F.concat(F.lit("d"), plain.cast("string"))).otherwise(
        F.concat(F.lit("e"), F.format_string("%.17e", x)))


def field_token(c: Column) -> Column:
    """Length-prefixed text, so field boundaries and nulls cannot collide."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(NULL_TOKEN))


def content_id(fields: Iterable[Column | str], namespace: str = "", explicit: Column | None = None) -> Column:
    """SHA-256 over a fixed field order; a non-blank explicit id wins."""
    columns = [F.col(f) if isinstance(f, str) else f for f in fields]
    digest = F.sha2(F.concat(F.lit(namespace + "|"), *[field_token(c) for c in columns]), 256)
    if explicit is None:
        return digest
    return F.when(F.trim(F.coalesce(explicit, F.lit(""))) != "", explicit).otherwise(digest)


def packed_id(c: Column) -> Column:
    """An id in half the bytes: a SHA-256 in hex as its 32 bytes, any other text as it is, told apart by the first byte. Equal exactly for equal ids."""
    return F.when(c.rlike(r"\A[0-9a-f]{64}\z"), F.concat(F.lit(b"\x01"), F.unhex(c))).otherwise(F.concat(F.lit(b"\x00"), c.cast("binary")))


def unpacked_id(c: Column) -> Column:
    rest = F.substring(c, 2, 2_147_483_647)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
