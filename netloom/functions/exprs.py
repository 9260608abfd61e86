"""Column expressions that several operators share. All are JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.schema import FLAG_NAMES


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (read as UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def window_id(us: Column, t0: Column | int, seconds: float) -> Column:
    """The tumbling window of a time, counted from t0; times before t0 have negative windows."""
    t0 = F.lit(t0) if isinstance(t0, int) else t0
    return F.floor((us - t0) / F.lit(int(seconds * 1_000_000))).cast("long")


def number(x: Column) -> Column:
    """A number, 0.0 for null, what doesn't parse, NaN and infinities."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1.0))


def entropy_of_counts(n: Column) -> Column:
    """Shannon entropy in bits of groups with n members each, as an aggregate; never -0.0."""
    total = F.sum(n)
    return F.greatest(F.lit(0.0), F.log2(total) - F.sum(n * F.log2(n)) / total) + 0.0


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def flags_text(flags: Column) -> Column:
    """`SYN|ACK`; `-` if no bit is set."""
    return F.coalesce(F.nullif(F.concat_ws("|", *(F.when(has_flag(flags, b), n) for b, n in FLAG_NAMES)), F.lit("")), F.lit("-"))


def uniform(seed: int, *key: Column) -> Column:
    """A deterministic number in [0, 1) for a key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") / float(1 << 53)


def portable(seed: int, *key: Column) -> Column:
    """A deterministic number in [0, 1) for a key that any SQL with MD5 can repeat: the first 13
    hexadecimal digits of the seed and the key's parts as text, joined by bars."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def portable_sql(seed: int, *key: str) -> str:
    """portable() in DuckDB's SQL."""
    text = " || '|' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in key)])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def char_entropy(s: Column) -> Column:
    """Bits per character of one string; 0 if it is empty."""
    cs = chars(s)
    n = F.size(cs).cast("double")
    of = lambda c: F.size(F.filter(cs, lambda d: d == c)).cast("double")
    parts = F.transform(F.array_distinct(cs), lambda c: of(c) / n * F.log2(of(c) / n))
    return F.when(n > 0, F.greatest(F.lit(0.0), -F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) + 0.0).otherwise(0.0)


def digit_ratio(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit(r"(?U)\d")) / F.length(s)).otherwise(0.0)


def longest_label(s: Column) -> Column:
    return F.array_max(F.transform(F.split(s, r"\."), F.length))


def registrable(s: Column) -> Column:
    return F.substring_index(s, ".", -2)


def is_close(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
