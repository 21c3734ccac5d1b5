"""Small scalar rules as column expressions (JVM side throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What boolean text parses as, and cache lifetimes in seconds.
TRUE_TEXT = ("1", "t", "T", "TRUE", "true", "True")
FALSE_TEXT = ("0", "f", "F", "FALSE", "false", "False")
DEFAULT_CACHE_S, MOST_CACHE_S = 3600, 86400


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    """base * 2^attempt, at most ``most``; the exponent is bounded first, so nothing overflows."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.greatest(attempt, F.lit(0)), F.lit(62)))).cast("long")


def base64_url(value: Column) -> Column:
    """URL alphabet, no padding, no line breaks."""
    return F.translate(F.regexp_replace(F.base64(value), "[\r\n=]", ""), "+/", "-_")


def stream_key(prefix: str, topic: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:stream:"), base64_url(topic.cast("binary")))


def gender(value: Column) -> Column:
    """Trimmed and lower-cased: blank is NULL, male and female stay, all else is other."""
    v = F.lower(F.trim(value))
    return F.when(value.isNull() | (v == ""), F.lit(None).cast("string")).when(v.isin("male", "female"), v).otherwise("other")


def boolean(value: Column) -> Column:
    """Text that is a boolean; any other is NULL."""
    return F.when(value.isin(*TRUE_TEXT), True).when(value.isin(*FALSE_TEXT), False)


def cache_seconds(cache_control: Column) -> Column:
    """The first positive max-age of a Cache-Control value, at most a day; an hour without one."""
    parts = F.transform(F.split(cache_control, ","), lambda p: F.regexp_extract(F.trim(p), r'^(?i:max-age)="*([0-9]{1,18})"*$', 1).try_cast("long"))
    found = F.get(F.filter(parts, lambda s: s > 0), F.lit(0))
    return F.least(F.coalesce(found, F.lit(DEFAULT_CACHE_S)), F.lit(MOST_CACHE_S)).cast("long")


def base_url(url: Column) -> Column:
    """Trimmed, without slashes at the end; NULL unless it is http(s) with a host and without query or fragment."""
    u = F.regexp_replace(F.trim(url), "/+$", "")
    return F.when(u.rlike(r"^(?i:https?)://[^/?#\s]+(/[^?#\s]*)?$"), u)


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC with SHA-256 as lowercase hex, of two inner hashes; key and message are binary."""
    block = F.when(F.length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    padded = F.rpad(F.hex(block), 128, "0")
    pad = lambda byte: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0")), "")
    inner = F.sha2(F.unhex(F.concat(pad(0x36), F.hex(message))), 256)
    return F.sha2(F.unhex(F.concat(pad(0x5C), F.upper(inner))), 256)
