"""Money, margins, taxes and dates as column expressions. Null means unknown and is never taken for zero."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """Cents, rounded half up."""
    return F.round(x, 2)


def half_even(x: Column) -> Column:
    """Cents, rounded half to even."""
    return F.bround(x, 2)


def exact_sum(x: Column) -> Column:
    """Sum of cents without floating error."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def lookup(key: Column, values: dict[str, object], default: object = None) -> Column:
    """Value of key in a small fixed map."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def line_error(cost: Column, margin: Column, qty: Column) -> Column:
    """Why a line has no price, null where it has one: unpriced, bad quantity, cost or margin."""
    return (
        F.when(cost.isNull(), "unpriced")
        .when(qty.isNull(), "no quantity")
        .when((cost < 0) | F.isnan(cost), "bad cost")
        .when((qty < 0) | F.isnan(qty), "bad quantity")
        .when(margin.isNull() | (margin < 0) | (margin >= 1), "bad margin")
    )


def sale_each(cost: Column, margin: Column) -> Column:
    return money(cost / (1 - margin))


def extended(cost: Column, margin: Column, qty: Column) -> Column:
    """Rounded once, from the exact sale price."""
    return money(cost / (1 - margin) * qty)


def margin_status(applied: Column, floor: Column) -> Column:
    """pass, below_band, or unknown_type where there is no band."""
    return F.when(floor.isNull(), "unknown_type").when(applied < floor - 1e-9, "below_band").otherwise("pass")


def cost_from_list(price: Column, multiplier: Column, adders: Column) -> Column:
    """Adders (an array) are list values too; null where the multiplier is not in (0, 1]."""
    whole = F.aggregate(adders, price, lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when((multiplier > 0) & (multiplier <= 1), money(whole * multiplier))


def state_code(name: Column, names: dict[str, str]) -> Column:
    """Two-letter code: known names by map, two letters as they are, NONE kept, anything else null."""
    upper = F.upper(F.trim(name))
    return F.coalesce(lookup(upper, names), F.when(upper.isin("NONE") | upper.rlike("^[A-Z]{2}$"), upper))


def tax_rate(code: Column, rates: dict[str, float]) -> Column:
    """Rate of a code; 0 for NONE, unresolved (null) and codes without a rate."""
    return F.coalesce(lookup(code, rates), F.lit(0.0))


def freshness(age_days: Column, fresh: int, discard: int) -> Column:
    """future_dated, fresh, unreliable or stale; both edges belong to the better class."""
    return (
        F.when(age_days < 0, "future_dated").when(age_days <= fresh, "fresh").when(age_days <= discard, "unreliable").when(age_days > discard, "stale")
    )


def lapsed(age_days: Column, stale: int) -> Column:
    """Undated is never lapsed."""
    return F.coalesce(age_days > stale, F.lit(False))


def grid_key(value: Column, keys: Column) -> Column:
    """Ceiling, up to even, then the smallest key not below; above all keys the largest."""
    whole = F.ceil(value).cast("long")
    even = whole + F.abs(whole % 2)
    return F.coalesce(F.array_min(F.filter(keys, lambda k: k >= even)), F.array_max(keys))


def first_of(pairs: Iterable[tuple[str, Column]]) -> tuple[Column, Column]:
    """(source, value) of the first value that is not null, in order; manual and null where all are."""
    source, value = F.lit("manual"), F.lit(None).cast("double")
    for name, x in reversed(list(pairs)):
        source, value = F.when(x.isNotNull(), F.lit(name)).otherwise(source), F.when(x.isNotNull(), x).otherwise(value)
    return source, value
