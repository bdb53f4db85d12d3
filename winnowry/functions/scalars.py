"""Scalar functions: offsets, cursors, progress, validation, encodings."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import GZIP_OVER_BYTES, MAX_SOURCE_BYTES


def utf16_length(s: Column) -> Column:
    """UTF-16 units: code points, those beyond the basic plane twice (they have 4 bytes in UTF-8)."""
    return (F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def utf16_offset(s: Column, byte: Column) -> Column:
    """UTF-16 index of a byte offset; inside a character it is that character's start."""
    b = s.cast("binary")
    # step back over continuation bytes
    cont = lambda i: F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(0xC0) == 0x80
    at = F.least(byte.cast("int"), F.octet_length(s))
    back = F.when(at >= F.octet_length(s), 0).when(~cont(at), 0).when(~cont(at - 1), 1).when(~cont(at - 2), 2).otherwise(3)
    return utf16_length(F.decode(F.substring(b, F.lit(1), at - back), "UTF-8"))


def encoding_label(s: Column) -> Column:
    return F.when(F.octet_length(s) > GZIP_OVER_BYTES, "gzip").otherwise("utf8")


def fits(s: Column) -> Column:
    return F.octet_length(s) <= MAX_SOURCE_BYTES


def hash_key(h1: Column, h2: Column) -> Column:
    return F.concat_ws(":", h1, h2)


def percent(sim: Column) -> Column:
    return F.floor(sim * 100 + 0.5).cast("long")


def progress(done: Column, total: Column, low: int, span: int) -> Column:
    """low + done's share of span, rounded half up, under low + span."""
    return (F.lit(low) + F.least(F.lit(span - 1), F.floor(F.lit(float(span)) * done / total + 0.5))).cast("long")


def encode_cursor(value: Column, row_id: Column) -> Column:
    """URL-safe base64 of a JSON object without padding."""
    text = F.to_json(F.struct(value.alias("v"), row_id.alias("id")))
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: str, number: bool = True) -> tuple:
    """(value, id) of a cursor; ValueError if its shape is wrong."""
    import base64

    try:
        got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        value, row_id = got["v"], got["id"]
    except Exception as e:
        raise ValueError("malformed cursor") from e
    if not isinstance(value, (int, float) if number else str) or isinstance(value, bool):
        raise ValueError("malformed cursor")
    return value, row_id


def filename_id(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^(sol\d+|var_[a-f]|evasion_\d+)", 1)


def marked_span(s: Column, begin: str, end: str) -> Column:
    """(start, end) bytes of what stands between two markers."""
    a, z = F.locate(begin, s), F.locate(end, s)
    size = lambda n: F.octet_length(F.substring(s, F.lit(1), n)).cast("long")
    return F.struct(size(a - 1 + len(begin)).alias("start"), size(z - 1).alias("end"))


def submission_errors() -> Column:
    """array<string>: what is wrong with a submission row."""
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    return F.filter(F.array(
        *[F.when(blank(c), f"{c} is empty") for c in ("external_id", "user_ref", "problem_ref", "source")],
        F.when(~F.coalesce(F.col("language").isin("cpp", "python", "prose"), F.lit(False)), "language is unknown"),
        F.when(~F.coalesce(fits(F.col("source")), F.lit(True)), "source is too long"),
    ), lambda x: x.isNotNull())


def callback_ok(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def signature(body: str, secret: str) -> str:
    """HMAC-SHA256 of a webhook's body, in hex (made on the driver)."""
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
