"""Scalar expressions: parsing, clocks, decay, formatting, vector arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
LOCAL_OFFSET_MS = 8 * HOUR_MS  # the reporting calendar is UTC+8 all year

CATEGORY_COUNT = 50


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_int(c: Column | str, default: int = 0) -> Column:
    """Whole-number parse; anything else, '3.0' included, gives the default."""
    c = _col(c)
    digits = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c)
    return F.coalesce(F.trim(digits).try_cast("int"), F.lit(default))


def safe_double(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(_col(c).try_cast("double"), F.lit(default))


def derive_category(item_id: Column | str) -> Column:
    """Category from the numeric part of the item id, 0 when there is none."""
    item_id = _col(item_id)
    tail = F.substring(item_id, 2, 1_000)
    number = F.when(tail.rlike("^[+-]?[0-9]+$"), tail).try_cast("int")
    return F.coalesce(((number.cast("long") - 1) % CATEGORY_COUNT + 1).cast("int"), F.lit(0))


def minute_floor(ts: Column | str) -> Column:
    ts = _col(ts)
    return ts - F.pmod(ts, F.lit(MINUTE_MS))


def minute_index(ts: Column | str) -> Column:
    ts = _col(ts)
    return F.floor((ts - F.pmod(ts, F.lit(MINUTE_MS))) / MINUTE_MS).cast("long")


def local_day(ts: Column | str) -> Column:
    """Calendar day (UTC+8) of an epoch-millisecond stamp, as days since 1970."""
    shifted = _col(ts) + F.lit(LOCAL_OFFSET_MS)
    return F.floor((shifted - F.pmod(shifted, F.lit(DAY_MS))) / DAY_MS).cast("int")


def local_date(ts: Column | str) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), local_day(ts))


def decay_factor(delta_ms: Column | str, half_life_days: float = 7.0) -> Column:
    rate = -math.log(2.0) / (half_life_days * DAY_MS)
    return F.exp(F.greatest(_col(delta_ms), F.lit(0)).cast("double") * F.lit(rate))


def fixed_decimal(c: Column | str, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(_col(c).cast("double"), F.lit(0.0)))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, 0.0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(_col(num).cast("double"), _col(den).cast("double")), F.lit(0.0))


def split_list(c: Column | str) -> Column:
    """';'-separated text to an array; null counts as the empty text."""
    return F.split(F.coalesce(_col(c), F.lit("")), ";")


def event_kind(bhv_type: str = "bhv_type", bhv_value: str = "bhv_value") -> Column:
    """pv, click, cart, fav or buy; null for anything else."""
    t, v = F.col(bhv_type), F.col(bhv_value)
    return (
        F.when(t == "show", F.lit("pv"))
        .when((t == "click") & v.isNull(), F.lit("click"))
        .when((t == "click") & v.isin("cart", "fav", "buy"), v)
    )


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column | str) -> Column:
    v = _col(v)
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def fusion(click, cart, buy, forward) -> Column:
    """Multi-task score; the exponents are fixed values of the scoring rule."""
    return (
        F.pow(_col(click), F.lit(0.7))
        * F.pow(_col(cart), F.lit(0.6))
        * F.pow(_col(buy), F.lit(0.5))
        * F.pow(_col(forward), F.lit(0.5))
    )


def rating(click="click", cart="cart", forward="forward", buy="buy") -> Column:
    return sum((_col(c).cast("int") for c in (cart, forward, buy)), _col(click).cast("int"))


def clip_text(c: Column | str, length: int) -> Column:
    return F.substring(_col(c), 1, length)


def hash_number(*parts: Column | str) -> Column:
    """A 60-bit number from the md5 of the parts; the same in any SQL engine.

    Taken modulo a table size, the bias is below size / 2**60.
    """
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
