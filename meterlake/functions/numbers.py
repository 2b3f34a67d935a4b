"""Token arithmetic, rates, shares and how they are shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SUCCESS, CLIENT_ERROR, SERVER_ERROR, OTHER = "2xx", "4xx", "5xx", "other"


def total_tokens(i: Column, o: Column, create: Column, read: Column) -> Column:
    return i + o + create + read


def minus(a: Column, b: Column) -> Column:
    """a - b, but not below 0."""
    return F.greatest(a - b, F.lit(0))


def without_cache(raw_input: Column, cached: Column, clamp: bool) -> Column:
    """struct(input, cache_read): cached tokens taken out of the input; with ``clamp`` never more than the input."""
    read = F.least(cached, raw_input) if clamp else cached
    return F.struct(minus(raw_input, read).alias("input"), read.alias("cache_read"))


def rate_per_second(tokens: Column, ms: Column) -> Column:
    return F.when(ms > 0, tokens / (ms / 1000.0))


def safe_ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    return ratio if otherwise is None else F.coalesce(ratio, F.lit(otherwise))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


def cost(i: Column, o: Column, create: Column, read: Column, in_price: Column, out_price: Column, read_price: Column, write_price: Column) -> Column:
    """Dollars at prices a million tokens. Unset: reads cost a tenth of input, writes nothing; no price at all: 0."""
    reads = F.coalesce(read_price, in_price * 0.1, F.lit(0.0))
    return (i * F.coalesce(in_price, F.lit(0.0)) + o * F.coalesce(out_price, F.lit(0.0)) + create * F.coalesce(write_price, F.lit(0.0)) + read * reads) / 1_000_000.0


def status_class(code: Column) -> Column:
    return F.when(code.between(200, 299), SUCCESS).when(code.between(400, 499), CLIENT_ERROR).when(code >= 500, SERVER_ERROR).otherwise(OTHER)


def cache_hit_percent(i: Column, create: Column, read: Column) -> Column:
    return percent(read, i + create + read)


def split_cost(total: Column, i: Column, o: Column) -> Column:
    """struct(input_cost, output_cost) in proportion to the tokens."""
    share = safe_ratio(i, i + o, 0.0)
    return F.struct((total * share).alias("input_cost"), F.when(i + o > 0, total * (1 - share)).otherwise(0.0).alias("output_cost"))


def share_of(total: Column, place: Column, parts: Column) -> Column:
    """What the part at ``place`` (from 0) gets of a whole number that is dealt out evenly, the remainder to the first."""
    rest = F.pmod(total, parts)
    return ((total - rest) / parts).cast("long") + F.when(place < rest, 1).otherwise(0)


def spread_between(start: Column, end: Column, place: Column, parts: Column) -> Column:
    """The time of the part at ``place`` when ``parts`` lie evenly from start to end, both included."""
    return F.when(parts <= 1, start).otherwise(start + F.floor((end - start) * place / F.greatest(parts - 1, F.lit(1))).cast("long"))


def heat_level(value: Column, most: Column) -> Column:
    """0 for none, else 1 to 4 by quarters of the most."""
    r = safe_ratio(value, most, 0.0)
    return F.when((value <= 0) | (most <= 0), 0).when(r < 0.25, 1).when(r < 0.5, 2).when(r < 0.75, 3).otherwise(4)


def _one_decimal(n: Column, size: int, mark: str) -> Column:
    """A whole number of so many to one, with one decimal, halves up: in whole numbers, so that it depends on no float's last bit."""
    n = n.cast("long") + size // 20
    tenths = (n - F.pmod(n, F.lit(size // 10))) / (size // 10)
    tenths = tenths.cast("long")
    return F.concat(((tenths - F.pmod(tenths, F.lit(10))) / 10).cast("long").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(mark))


def short_number(n: Column) -> Column:
    """Thousands, millions and billions with one decimal and K, M, B."""
    out = n.cast("long").cast("string")
    for size, mark in ((1_000, "K"), (1_000_000, "M"), (1_000_000_000, "B")):
        out = F.when(n >= size, _one_decimal(n, size, mark)).otherwise(out)
    return out


def short_duration(ms: Column) -> Column:
    return F.when(ms >= 1000, _one_decimal(ms, 1000, "s")).otherwise(F.concat(ms.cast("long").cast("string"), F.lit("ms")))


def converted(usd: Column, rates: dict[str, float], currency: Column) -> Column:
    """Dollars in another currency; a currency without a rate counts as dollars."""
    rate = F.lit(1.0)
    for name, r in rates.items():
        rate = F.when(currency == name, float(r)).otherwise(rate)
    return usd * rate


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def first_number(json: Column, paths: Sequence[str]) -> Column:
    """The first path that holds a number (or text of one); negatives are 0, fractions are cut; null without any."""
    found = [F.get_json_object(json, p).try_cast("double") for p in paths]
    value = F.coalesce(*found)
    return F.when(value < 0, 0.0).otherwise(value).cast("long")


def first_time(json: Column, paths: Sequence[str]) -> Column:
    """Epoch seconds of the first path that holds a time: seconds, milliseconds (over 1e10) or RFC 3339 text."""
    ways = []
    for p in paths:
        raw = F.get_json_object(json, p)
        n = raw.try_cast("double")
        ways.append(F.when(n > 1e10, F.floor(n / 1000)).otherwise(F.floor(n)).cast("long"))
        ways.append(F.unix_timestamp(F.try_to_timestamp(raw)))
    return F.coalesce(*ways)


def window_name(seconds: Column) -> Column:
    """Name of a quota window by its length."""
    hours = F.floor(seconds / 3600).cast("long")
    return (
        F.when(seconds == 18_000, "five_hour")
        .when(seconds == 604_800, "seven_day")
        .when(hours >= 24, F.concat(F.floor(hours / 24).cast("string"), F.lit("_day")))
        .otherwise(F.concat(hours.cast("string"), F.lit("_hour")))
    )
