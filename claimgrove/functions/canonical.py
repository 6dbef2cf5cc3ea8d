"""Canonical JSON and content hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _escape(encoded: pd.Series) -> pd.Series:
    import json

    return encoded.map(
        lambda v: json.dumps(
            json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=True
        ),
        na_action="ignore",
    )


def canonical_json(**fields: Column) -> Column:
    """Key-sorted JSON with explicit nulls and ASCII escapes.

    Printable ASCII is already canonical in the native encoding; only rows with
    other characters are re-encoded in an Arrow batch.
    """
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    native = F.to_json(ordered, {"ignoreNullFields": "false"})
    special = native.rlike(r"[^\x20-\x7e]|\\u")
    return F.coalesce(_escape(F.when(special, native)), native)


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of the named fields."""
    return F.sha2(canonical_json(**fields), 256)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed hash composed of two SHA-256 rounds (no built-in exists)."""
    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in block).hex()
    outer = bytes(b ^ 0x5C for b in block).hex()
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)
