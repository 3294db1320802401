"""Scalar functions as Column expressions, and a vectorised UUIDv7 generator."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def relative_time(text: Column, now: Column) -> Column:
    """Microseconds of `5m`, `2h ago`, `1d` (before now), digits (seconds, or milliseconds from 1e11 on) or an ISO time; else null."""
    number = F.try_to_number(F.regexp_extract(text, r"^\s*(\d+)\s*[smhdw](?:\s+ago)?\s*$", 1), F.lit("999999999999"))
    unit = F.regexp_extract(text, r"^\s*\d+\s*([smhdw])(?:\s+ago)?\s*$", 1)
    seconds = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])[F.nullif(unit, F.lit(""))]
    digits = F.when(text.rlike(r"^\s*\d{1,18}\s*$"), F.trim(text).cast("long"))
    absolute = F.when(digits >= 10**11, digits * 1000).otherwise(digits * 10**6)
    iso = F.unix_micros(F.try_to_timestamp(text))
    return F.coalesce(now - number.cast("long") * seconds * 10**6, absolute, iso)


def uuid7_boundary(micros: Column) -> Column:
    """The smallest UUIDv7 of a time: its milliseconds, the version and zeros."""
    ms = F.lpad(F.lower(F.hex(F.floor(micros / 1000).cast("long"))), 12, "0")
    return F.concat_ws("-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.lit("7000-8000-000000000000"))


def uuid7_micros(uuid: Column) -> Column:
    """The time in a UUIDv7, at millisecond precision."""
    return F.conv(F.substring(F.replace(uuid, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long") * 1000


@F.pandas_udf(T.StringType())
def uuid7(micros: pd.Series) -> pd.Series:
    """A fresh UUIDv7 for each time; ids of one batch keep the order of their rows within a millisecond. Write them once and read them back: recomputation makes others."""
    import secrets

    out, last, n = [], None, 0
    for ms in (micros // 1000).astype("int64"):
        n = n + 1 if ms == last else 0
        last = ms
        tail = (0x8000 | secrets.randbits(14)) << 48 | secrets.randbits(48)
        h = f"{ms & (1 << 48) - 1:012x}{0x7000 | n & 0xFFF:04x}{tail:016x}"
        out.append("-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])))
    return pd.Series(out)


def json_path(payload: Column, path: str) -> Column:
    """A dotted path into JSON text: `a.b[0]`."""
    return F.get_json_object(payload, f"$.{path}")


def iso_millis(micros: Column) -> Column:
    """ISO time with milliseconds and Z, the form of window keys; made of the UTC civil date, whatever the session's zone."""
    ms = F.floor(micros / 1000)
    day, rest = F.floor(ms / 86400000).cast("int"), F.pmod(ms, F.lit(86400000)).cast("long")
    two = lambda c, n=2: F.lpad(F.floor(c).cast("string"), n, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("timestamp_ntz"), "yyyy-MM-dd")
    return F.concat(date, F.lit("T"), two(rest / 3600000), F.lit(":"), two(rest / 60000 % 60), F.lit(":"), two(rest / 1000 % 60), F.lit("."), two(rest % 1000, 3), F.lit("Z"))


def encrypt(payload: Column, key: Column) -> Column:
    """AES-256-GCM over the payload's JSON text: base64 of nonce, cipher text and tag."""
    return F.base64(F.aes_encrypt(payload, key, F.lit("GCM")))


def decrypt(sealed: Column, key: Column) -> Column:
    """The JSON text, or null if key or tag don't fit."""
    return F.try_aes_decrypt(F.unbase64(sealed), key, F.lit("GCM")).cast("string")


def config_hash(operators: list[dict]) -> str:
    """SHA-256 of the operators' structure as compact JSON; callables are not part of it."""
    return hashlib.sha256(json.dumps(operators, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
