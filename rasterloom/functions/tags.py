"""Tags: an array of (name, code, data) structs in the header row, duplicates allowed, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<name:string,code:int,data:string>>"

#: A tag is asked for by its name or by its code.
Key = str | int


def _is(tag: Column, key: Key) -> Column:
    return tag["name" if isinstance(key, str) else "code"].eqNullSafe(F.lit(key))


def _held(tags: Column) -> Column:
    return F.coalesce(tags, F.array().cast(KIND))


def add(tags: Column, key: Key, value) -> Column:
    named = isinstance(key, str)
    data = value if isinstance(value, Column) else F.lit(value)
    one = F.struct(F.lit(key if named else None).cast("string").alias("name"), F.lit(0 if named else key).alias("code"), data.cast("string").alias("data"))
    return F.concat(_held(tags), F.array(one))


def delete(tags: Column, key: Key) -> Column:
    return F.filter(tags, lambda t: ~_is(t, key))


def delete_at(tags: Column, index: int) -> Column:
    """All but the tag of this index, from 0."""
    return F.filter(tags, lambda t, k: k != index)


def put(tags: Column, key: Key, value) -> Column:
    """All tags of the key go, then one is added."""
    return add(delete(_held(tags), key), key, value)


def put_float(tags: Column, key: Key, value: Column | float, places: int = 30) -> Column:
    """A number as text of so many digits, from 17 on as many as it takes to read the same number back."""
    number = (value if isinstance(value, Column) else F.lit(value)).cast("double")
    if 0 <= places < 17:
        number = F.format_string(f"%.{max(1, places) - 1}e", number).cast("double")
    return put(tags, key, number)


def put_colour(tags: Column, key: Key, r, g, b, a=255) -> Column:
    parts = [(v if isinstance(v, Column) else F.lit(v)).cast("int").cast("string") for v in (r, g, b, a)]
    return put(tags, key, F.concat(F.lit("color("), F.concat_ws(",", *parts), F.lit(")")))


def find(tags: Column, key: Key) -> Column:
    """All values of a key, in order."""
    return F.transform(F.filter(tags, lambda t: _is(t, key)), lambda t: t["data"])


def get(tags: Column, key: Key) -> Column:
    """The first value of a key, as text."""
    return F.get(find(tags, key), F.lit(0))


def get_float(tags: Column, key: Key) -> Column:
    """The leading number; text that is none gives 0."""
    digits = F.regexp_extract(get(tags, key), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.when(get(tags, key).isNotNull(), F.when(digits != "", digits.try_cast("double")).otherwise(F.lit(0.0)))


def get_int(tags: Column, name: Key) -> Column:
    """The leading whole number; text that is none gives 0."""
    digits = F.regexp_extract(get(tags, name), r"^\s*([-+]?\d{1,18})", 1)
    return F.when(get(tags, name).isNotNull(), F.coalesce(F.try_to_number(F.when(digits != "", F.regexp_replace(digits, r"\+", "")), F.lit("S" + "9" * 18)).cast("long"), F.lit(0)))


def get_colour(tags: Column, name: Key) -> Column:
    """(r, g, b, a) of text like color(1,2,3) or color(1,2,3,4); null for others."""
    m = lambda k: F.regexp_extract(get(tags, name), r"^color\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)$", k)
    parts = [F.when(m(k) != "", m(k)).cast("int") for k in (1, 2, 3)] + [F.coalesce(F.when(m(4) != "", m(4)).cast("int"), F.lit(255))]
    return F.when(m(1) != "", F.struct(*(p.alias(n) for p, n in zip(parts, "rgba", strict=True))))


def background(tags: Column) -> Column:
    """(r, g, b, a) that files without alpha are flattened on: the tag i_background, black without a valid one; always opaque."""
    got = get_colour(tags, "i_background")
    return F.struct(*(F.coalesce(got[n], F.lit(0)).alias(n) for n in "rgb"), F.lit(255).alias("a"))
