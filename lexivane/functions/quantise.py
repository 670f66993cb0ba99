"""Value types narrower than 32 bits, as expressions that give the value a type would hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Significant bits beyond the first, lowest normal exponent, largest value.
FLOATS = {"f16": (10, -14, 65504.0), "bf16": (7, -126, 3.3895313892515355e38)}
FIXED_BITS = {"fixedu8": 8, "fixedu16": 16, "packed8": 8}


def _exponent(x: Column) -> Column:
    """The exponent of a DOUBLE from 0 on; of 0 some very low one."""
    guess = F.floor(F.log2(F.greatest(x, F.lit(1e-300))))
    return F.when(F.pow(F.lit(2.0), guess + 1) <= x, guess + 1).when(F.pow(F.lit(2.0), guess) > x, guess - 1).otherwise(guess)


_UNIT = float(1 << 23)  # the last places of a FLOAT below its first bit


def float_place(value: Column) -> Column:
    """The place of a FLOAT among all of them as BIGINT, 0 for 0: ordered as the values are. Null stays; NaN has no place."""
    x = F.abs(value.cast("double"))
    e = F.greatest(_exponent(x), F.lit(-126))
    bits = (e + 126) * F.lit(_UNIT) + x / F.pow(F.lit(2.0), e) * F.lit(_UNIT)
    place = F.when(x > F.lit(3.4028235e38), F.lit(255 * _UNIT)).otherwise(bits)
    return (F.signum(value.cast("double")) * place).cast("long")


def place_float(place: Column) -> Column:
    """The FLOAT at a place that float_place gives."""
    p = F.abs(place)
    e = F.greatest(F.floor(p / F.lit(_UNIT)) - 127, F.lit(-126))
    x = (p - (e + 126) * F.lit(_UNIT)) * F.pow(F.lit(2.0), e - 23)
    return (F.signum(place) * F.when(p == F.lit(int(255 * _UNIT)), F.lit(float("inf"))).otherwise(x)).cast("float")


def round_float(value: Column, kind: str) -> Column:
    """value rounded half to even to f16 or bf16, saturating; as DOUBLE. Null and NaN stay, f32 is the value as FLOAT."""
    if kind == "f32":
        return value.cast("float").cast("double")
    bits, lowest, largest = FLOATS[kind]
    x = F.abs(value.cast("double"))
    unit = F.pow(F.lit(2.0), F.greatest(_exponent(x), F.lit(lowest)) - bits)
    rounded = F.least(F.rint(x / unit) * unit, F.lit(largest))
    return F.when(F.isnan(value.cast("double")), value.cast("double")).otherwise(F.signum(value.cast("double")) * rounded)


def fixed_scale(df: DataFrame, value: str, kind: str) -> float:
    """The collection's one scale: the largest value over the largest code; 1 for a collection without positive values."""
    largest = df.agg(F.max(value)).first()[0] or 0.0
    return float(largest) / (2 ** FIXED_BITS[kind] - 1) or 1.0


def fixed_code(value: Column, scale: float, kind: str) -> Column:
    return F.least(F.greatest(F.round(value / F.lit(scale)), F.lit(0.0)), F.lit(float(2 ** FIXED_BITS[kind] - 1))).cast("int")


def quantise(df: DataFrame, value: str, kind: str) -> DataFrame:
    """df with value as kind (f32, f16, bf16, fixedu8, fixedu16 or packed8) would hold it."""
    if kind in FIXED_BITS:
        scale = fixed_scale(df, value, kind)
        return df.withColumn(value, fixed_code(F.col(value), scale, kind) * F.lit(scale))
    return df.withColumn(value, round_float(F.col(value), kind))
