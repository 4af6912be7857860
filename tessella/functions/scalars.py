"""Scalar rules as column expressions: clamping, parsing with defaults, names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low, high) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(low), F.least(lit(high), v))


def half_even(v: Column) -> Column:
    """Round half to even, as a long."""
    return F.bround(v, 0).cast("long")


def half_away(v: Column) -> Column:
    return F.round(v, 0).cast("long")


def to_double(v: Column, default: float) -> Column:
    return F.coalesce(v.try_cast("double"), F.lit(float(default)))


def to_int(v: Column, default: int) -> Column:
    """Parsed as a number and cut off, so '1.7' is 1."""
    return F.coalesce(v.try_cast("double").try_cast("int"), F.lit(int(default)))


def to_bool(v: Column, default: bool) -> Column:
    word = F.lower(F.trim(v))
    return F.when(v.isNull(), F.lit(default)).otherwise(word.isin("1", "true", "yes", "on"))


def words(v: Column, separator: str) -> Column:
    """A delimited list, trimmed and without empty items."""
    return F.filter(F.transform(F.split(v, separator), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def trailing_number(name: Column) -> Column:
    """(prefix, number) of a name that ends in digits, else null. The number is text without leading
    zeros, so it may have any length."""
    digits = F.regexp_extract(name, "([0-9]+)$", 1)
    prefix = F.substring(name, F.lit(1), F.length(name) - F.length(digits))
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(digits) > 0, F.struct(prefix.alias("prefix"), plain.alias("number")))


def one_less(digits: Column) -> Column:
    """A positive whole number of any length, as text without leading zeros, less one; null for 0."""
    head, zeros = F.regexp_extract(digits, "^(.*?)(0*)$", 1), F.length(F.regexp_extract(digits, "(0*)$", 1))
    last = F.substring(head, -1, 1).cast("int")
    less = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), (last - 1).cast("string"), F.repeat(F.lit("9"), zeros))
    return F.when(F.length(head) > 0, F.regexp_replace(less, "^0+(?=.)", ""))


def yaml_key(name: Column) -> Column:
    """Option names as configuration keys. Fixed order: degree sign and brackets go, then / & - blank."""
    v = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    for old, new in (("°", ""), ("(", ""), (")", ""), ("/", "_"), ("&", "and"), ("-", "_"), (" ", "_")):
        v = F.replace(v, F.lit(old), F.lit(new))
    return v


def seed_hash(name: Column) -> Column:
    """Multiply-by-31 hash of the UTF-16 units from 17, wrapped to 32 bits, as a non-negative int.
    Characters beyond the basic plane count as their two units."""
    wrap = lambda h: F.pmod(h + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    raw = F.encode(F.coalesce(name, F.lit("")), "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(raw, 2 * i + 1, F.lit(2))), 16, 10).cast("long")
    places = F.when(F.octet_length(raw) > 0, F.sequence(F.lit(0), (F.octet_length(raw) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(places, F.lit(17).cast("long"), lambda h, i: wrap(h * 31 + unit(i)))
    return F.when(h == -(2**31), F.lit(123456789)).otherwise(F.abs(h)).cast("long")


def confidence_tag(confidence: Column) -> Column:
    tens = half_even(confidence * 10)
    return F.when(confidence.isNull(), "conf00").otherwise(F.concat(F.lit("conf"), F.when(tens.between(0, 9), F.concat(F.lit("0"), tens.cast("string"))).otherwise(tens.cast("string"))))


def detection_name(stamp: Column, tile_size: Column, confidence: Column, model: Column) -> Column:
    return F.concat_ws("_", stamp, F.concat(tile_size.cast("int").cast("string"), F.lit("px")), confidence_tag(confidence), model)


def dataset_name(stamp: Column, tile_size: Column, kind: Column, augmented: Column, debug: Column) -> Column:
    base = F.concat_ws("_", stamp, tile_size.cast("string"), F.lower(F.trim(F.coalesce(kind, F.lit("dataset")))))
    return F.concat(base, F.when(augmented, "_aug").otherwise(""), F.when(debug, "_debug").otherwise(""))


def detection_root(tiles: Column) -> Column:
    """Where detections of a tiles folder go: beside `tiles`, or beside its parent for tiles/<n>px."""
    parts = F.split(F.regexp_replace(tiles, "/+$", ""), "/")
    up = lambda k: F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - k, F.lit(0))), "/")
    name = lambda k: F.lower(F.try_element_at(parts, F.lit(-k)))
    deep = name(1).endswith("px") & (F.coalesce(name(2), F.lit("")) == "tiles")
    return F.concat(F.when(deep, up(2)).otherwise(up(1)), F.lit("/Detection_Results"))


def mask_mode(v: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(v, F.lit(""))))
    return F.when(word.isin("largest", "union"), word).otherwise("largest")


def balance_method(v: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(v, F.lit(""))))
    return F.when(word.isin("minimum", "average"), word).otherwise("median")


def rebalance(changed: Column, other1: Column, other2: Column) -> Column:
    """The two other shares after one of three percentages was set: in proportion, halves away from
    zero, what is missing to the larger."""
    left = F.greatest(100 - changed, F.lit(0))
    total = other1 + other2
    ratio = F.when(total > 0, other1.cast("double") / F.when(total > 0, total).otherwise(1)).otherwise(0.5)
    a, b = half_away(left * ratio), half_away(left * (1 - ratio))
    delta = 100 - (changed + a + b)
    limit = lambda v: clamp(v, 0, 100)
    return F.struct(limit(F.when(a >= b, a + delta).otherwise(a)).alias("first"), limit(F.when(a >= b, b).otherwise(b + delta)).alias("second"))


def estimate(tiles: Column, flips: Column, stochastic: Column) -> Column:
    """Copies per tile (8 at most by flips and turns, and one if any random option is on), images,
    seconds at 20 images a second, and the size warning."""
    copies = F.greatest(F.lit(1), F.when(flips > 0, F.least(F.lit(8), 1 + flips)).otherwise(1) + F.when(stochastic > 0, 1).otherwise(0))
    images = tiles * copies
    return F.struct(copies.alias("copies"), images.alias("images"), (images / 20.0).alias("seconds"), (images > 100_000).alias("warn"))


def hms(seconds: Column) -> Column:
    """hh:mm:ss of a span; whole days aren't shown."""
    s = F.floor(seconds).cast("long")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600) % 24), two(F.floor(s / 60) % 60), two(s % 60))


def fixed(v: Column, places: int = 6) -> Column:
    """A finite number with that many decimals, rounded as its binary value asks and ties to even.
    Twice the scaled value is computed with its rounding error (the factor has few bits, so halves of
    the value times it are exact): only where that is an odd whole number does the error decide."""
    factor, a = float(2 * 10**places), F.abs(v)
    high = (a * 134217729.0) - ((a * 134217729.0) - a)
    p = a * factor
    error = (high * factor - p) + (a - high) * factor
    half = F.floor(p / 2)
    odd = (p == F.floor(p)) & (F.pmod(p, F.lit(2.0)) == 1)
    up = F.when(odd, F.when(error > 0, 1).when(error < 0, 0).otherwise(F.pmod(half, F.lit(2)))).otherwise(F.floor((p + 1) / 2) - half)
    n = (half + up).cast("long")
    scale = 10**places
    text = F.concat(F.floor(n / scale).cast("long").cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))
    return F.concat(F.when(v < 0, "-").otherwise(""), text)


def shortest(v: Column, places: int) -> Column:
    """A number with at most that many decimals, halves away from zero, without trailing zeros."""
    text = F.round(v.cast("decimal(28,12)"), places).cast(f"decimal(28,{places})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def spin_step(low: Column, high: Column) -> Column:
    """The step of an input field by the width of its range."""
    span = F.abs(high - low)
    return F.when(span <= 0.01, 0.0001).when(span <= 1.0, 0.001).when(span <= 10.0, 0.1).otherwise(1.0)


def spin_precision(low: Column, high: Column) -> Column:
    """The decimals that its step needs."""
    step = spin_step(low, high)
    return F.when(step >= 1, 0).when(step >= 0.1, 1).when(step >= 0.01, 2).when(step >= 0.001, 3).otherwise(4)


def rounded_away(v: Column, places: Column) -> Column:
    """Halves away from zero at a number of places that is itself a column (0 to 4)."""
    out = F.round(v, 0)
    for k in (1, 2, 3, 4):
        out = F.when(places == k, F.round(v, k)).otherwise(out)
    return out


def settle_option(value: Column, value_min: Column, value_max: Column, prob: Column, low: Column, high: Column, prob_low: Column, prob_high: Column) -> Column:
    """An option's numbers brought into its limits, at the field's precision: the lower end first (it
    can't pass the upper one), then the upper end, then the value. An end that moves takes along a value
    beyond it, and a value that moves takes along an end. The probability has two decimals."""
    step = lambda s, f: F.element_at(F.transform(F.array(s), f), 1)  # noqa: E731  names a stage's numbers once
    digits = spin_precision(low, high)
    s = F.struct(digits.alias("digits"), value.alias("v"), value_min.alias("low"), value_max.alias("high"))
    s = step(s, lambda s: F.struct(s["digits"].alias("digits"), s["v"].alias("v"), s["low"].alias("low"), s["high"].alias("high"), rounded_away(F.least(clamp(s["low"], low, high), s["high"]), s["digits"]).alias("a")))
    s = step(s, lambda s: F.struct(s["digits"].alias("digits"), F.when((s["a"] != s["low"]) & (s["v"] < s["a"]), s["a"]).otherwise(s["v"]).alias("v"), s["high"].alias("high"), s["a"].alias("a"), rounded_away(F.greatest(clamp(s["high"], low, high), s["a"]), s["digits"]).alias("b")))
    s = step(s, lambda s: F.struct(s["digits"].alias("digits"), F.when((s["b"] != s["high"]) & (s["v"] > s["b"]), s["b"]).otherwise(s["v"]).alias("v"), s["a"].alias("a"), s["b"].alias("b")))
    s = step(s, lambda s: F.struct(s["v"].alias("v"), s["a"].alias("a"), s["b"].alias("b"), rounded_away(clamp(s["v"], low, high), s["digits"]).alias("z")))
    ends = lambda s: (F.when((s["z"] != s["v"]) & (s["a"] > s["z"]), s["z"]).otherwise(s["a"]), F.when((s["z"] != s["v"]) & (s["b"] < s["z"]), s["z"]).otherwise(s["b"]))
    return step(s, lambda s: F.struct(s["z"].alias("value"), ends(s)[0].alias("value_min"), ends(s)[1].alias("value_max"), F.round(clamp(prob, prob_low, prob_high), 2).alias("prob")))


def project_path(path: Column) -> Column:
    """A project file's path: no file scheme, back slashes; empty ones are null."""
    v = F.trim(path)
    bare = F.when(F.lower(v).startswith("file:///"), F.substring(v, F.lit(9), F.length(v))).otherwise(v)
    return F.when(F.length(path) > 0, F.replace(bare, F.lit("/"), F.lit("\\")))


def project_key(path: Column) -> Column:
    """Under which a project's settings are kept."""
    return F.replace(F.lower(F.trim(F.coalesce(path, F.lit("")))), F.lit("/"), F.lit("\\"))


def stamp(time: Column) -> Column:
    """yyyyMMdd_HHmmss, as names carry it."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def recent(history: Column, item: Column, limit: int = 20) -> Column:
    """A list of recent items with one in front: each spelling by case once, `limit` at most, no blanks."""
    whole = F.filter(F.concat(F.array(item), history), lambda x: x.isNotNull() & (F.length(F.trim(x)) > 0))
    low = F.transform(whole, lambda x: F.lower(x))
    first = F.filter(whole, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.slice(first, 1, limit)
