"""Column helpers: globs, time to live, hash slots, vectors and stream ids. Pure expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16384


def glob_regex(pattern: str) -> str:
    """A path-style glob as a Java regex: * and ? stop at a slash, [..] classes, backslash escapes.
    An open class or a backslash at the end makes a pattern that nothing matches."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return "(?!)"
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return "(?!)"
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            body = re.sub(r"([\[\]&\\])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def glob(key: Column, pattern: str, prefix_fallback: bool = True) -> Column:
    """Keys that a pattern selects. With the fallback, a pattern with a star also
    selects by prefix, its last star taken off; that part is pushed to the scan."""
    if pattern in ("", "*"):
        return F.lit(True)
    hit = key.rlike(glob_regex(pattern))
    return hit | key.startswith(pattern.removesuffix("*")) if prefix_fallback and "*" in pattern else hit


def is_live(expires_at_ms: Column, now_ms: int) -> Column:
    """Not expired at a given time; 0 is no expiry. Time is a parameter, never the clock."""
    return (expires_at_ms == 0) | (expires_at_ms > F.lit(now_ms))


def pttl(expires_at_ms: Column, now_ms: int) -> Column:
    """Milliseconds to live: -2 for a missing or expired key (null), -1 without expiry."""
    return F.when(expires_at_ms.isNull() | ~is_live(expires_at_ms, now_ms), F.lit(-2)).when(expires_at_ms == 0, F.lit(-1)).otherwise(expires_at_ms - now_ms).cast("bigint")


def ttl(expires_at_ms: Column, now_ms: int) -> Column:
    """Whole seconds to live."""
    ms = pttl(expires_at_ms, now_ms)
    return F.when(ms < 0, ms).otherwise(F.floor(ms / 1000)).cast("bigint")


def hash_tag(key: Column) -> Column:
    """The part of a key that decides its slot: between the first { and the next }, if not empty."""
    return F.coalesce(F.nullif(F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1), F.lit("")), key)


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1 ^ 0x1021 if r & 0x8000 else r << 1) & 0xFFFF
        out.append(r)
    return out


def crc16(value: Column) -> Column:
    """CRC-16/XMODEM of a string's UTF-8 bytes: one table step a byte."""
    table = F.array(*[F.lit(x) for x in _crc_table()])
    digits = F.hex(F.encode(value, "utf-8"))
    codes = F.transform(F.filter(F.split(F.regexp_replace(digits, "(..)", "$1,"), ","), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.aggregate(codes, F.lit(0), lambda c, b: F.shiftleft(c, 8).bitwiseAND(0xFFFF).bitwiseXOR(F.get(table, F.shiftright(c, 8).bitwiseXOR(b).bitwiseAND(0xFF))))


def key_slot(key: Column) -> Column:
    return crc16(hash_tag(key)).bitwiseAND(SLOTS - 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either side has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def similarity(metric: str):
    """The kernel of a metric's name and whether less is nearer; unknown names are cosine."""
    if metric.lower() in ("l2", "euclidean"):
        return l2, True
    if metric.lower() in ("dot", "innerproduct"):
        return dot, False
    return cosine, False


def stream_id(text: Column) -> Column:
    """`ms-seq` or `ms` as a struct of unsigned 64-bit numbers; null if malformed."""
    ok = text.rlike("^[0-9]{1,20}(-[0-9]{1,20})?$")
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, "^([0-9]+)(?:-([0-9]+))?$", i), F.lit("")), F.lit("0")).cast("decimal(20,0)")
    return F.when(ok, F.struct(part(1).alias("ms"), part(2).alias("seq")))


def counter(text: Column) -> Column:
    """A stored string as a 64-bit integer; null where it is none (blanks are not trimmed)."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def fnv1a(value: Column) -> Column:
    """32-bit FNV-1a of a string's UTF-8 bytes, as a bigint."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(value, "utf-8")), "(..)", "$1,"), ","), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))
