"""Content identity, stable ids and deterministic sampling keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodmill.functions.text import as_col, normalize_text

# Version of normalize_text that content hashes were made with. Hashes of
# different versions are never compared.
HASH_VERSION = 1

UNIT_SEPARATOR = "\x1f"


def content_sha256(text: Column | str) -> Column:
    return F.sha2(normalize_text(text), 256)


def doc_hash(value: Column | str) -> Column:
    """Short id of a harvested item (64 bits of sha256)."""
    return F.substring(F.sha2(as_col(value), 256), 1, 16)


def search_hash(value: Column | str) -> Column:
    """Short id of an item found by a topic search (64 bits of sha1)."""
    return F.substring(F.sha1(as_col(value)), 1, 16)


def unit_interval(key: Column | str) -> Column:
    """First 64 bits of sha256(key) as a fraction of their range."""
    bits = F.conv(F.substring(F.sha2(as_col(key), 256), 1, 16), 16, 10)
    return bits.cast("double") / F.lit(float(2**64))


def in_sample(key: Column | str, rate: float) -> Column:
    """Deterministic membership of ``key`` in a sample of the given rate."""
    if rate >= 1:
        return F.lit(True)
    if rate <= 0:
        return F.lit(False)
    return unit_interval(key) < F.lit(float(rate))


def order_hash(separator: str, *keys: Column | str) -> Column:
    """md5 of the joined keys: the order all deterministic caps use."""
    return F.md5(F.concat_ws(separator, *[as_col(k) for k in keys]))
