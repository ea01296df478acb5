"""Small helpers: logarithms, text positions, sizes and differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrella.functions.geometry import Value, col


def log_base(value: Value, base: float) -> Column:
    return F.log(base, col(value))


def nth_index(text: Value, mark: str, n: int) -> Column:
    """Place, from 0, of the n-th mark (from 1) in a text; -1 if there are fewer."""
    head = F.substring_index(col(text), mark, n)
    return F.when(F.length(head) == F.length(col(text)), -1).otherwise(F.length(head))


def floor_text(text: Value) -> Column:
    """Whole part of a number in a text, towards minus infinity; null where it is none."""
    return F.floor(F.expr("try_cast(0 as double)") + F.when(col(text).rlike(r"^[-+]?\d+(\.\d*)?$"), col(text).cast("double")))


def size_bytes(text: str) -> int:
    """Bytes of a size such as 2g: each step is a thousand."""
    units = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4}
    text = text.strip().lower().removesuffix("b")
    unit = text[-1] if text[-1:].isalpha() else ""
    return int(float(text.removesuffix(unit)) * 1000 ** units[unit])


def half_up(value: Value) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(col(value) + 0.5).cast("long")


def spread(a: Value, b: Value) -> Column:
    """Smaller, larger and absolute difference."""
    return F.struct(F.least(col(a), col(b)).alias("least"), F.greatest(col(a), col(b)).alias("most"), F.abs(col(a) - col(b)).alias("apart"))


def fixed(value: Value, places: int = 2) -> Column:
    """A double as a decimal of 12 digits, rounded as SQL engines do that scale doubles first: 1028.995 is 1028.99, as 1028.995 * 100 is below 102899.5. Spark's own cast rounds the shortest text of the number."""
    scaled = F.round(col(value) * float(10**places)).cast("decimal(20,0)")
    return (scaled / F.lit(10**places).cast("decimal(20,0)")).cast(f"decimal(12,{places})")


def number_text(value: Value) -> Column:
    """A double's shortest text: digits alone from 1e-4 to below 1e16, else an exponent of two digits or more (1e-05)."""
    v = col(value)
    text = v.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    power = F.regexp_extract(text, r"E-?(\d+)$", 1)
    short = F.concat(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.when(text.contains("E-"), "e-").otherwise("e+"), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
    return F.when(~text.contains("E"), text).when(F.abs(v).between(1e-4, 9999999999999998.0), plain).otherwise(short)
