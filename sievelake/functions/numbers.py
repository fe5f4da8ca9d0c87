"""Numbers as Columns: rounding on a double's exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double in two halves whose products are exact (2^27 + 1).
_SPLIT = float((1 << 27) + 1)
#: From here on a double has no fraction.
_WHOLE = float(1 << 52)


def round_half_even(value: Column, digits: int = 1) -> Column:
    """A double rounded to ``digits`` (0 to 7) places, ties to even, as its exact value says: 62.25 gives 62.2, 62.45 (which lies above the tie) 62.5.

    ``bround`` rounds the shortest decimal text of a double instead. Here the product with the power of ten is taken without error, as a sum of two
    doubles. Null, NaN and infinities stay.
    """
    if not 0 <= digits <= 7:
        raise ValueError("digits must be 0 to 7")
    power, unit = F.lit(float(10**digits)), 10**digits

    def product(v):
        x = F.when(F.abs(v) < _WHOLE, F.abs(v)).otherwise(0.0)  # what stays as it is needs no arithmetic
        high = x * _SPLIT - (x * _SPLIT - x)
        p = x * power
        return F.struct(v.alias("v"), p.alias("p"), ((high * power - p) + (x - high) * power).alias("e"))

    def parts(s):
        p, e = s["p"], s["e"]
        large = p >= _WHOLE  # then the product is whole, and all of the fraction is in the error
        base = F.floor(p) + F.when(large, F.floor(e)).otherwise(F.lit(0))  # whole numbers of 64 bits
        above = F.when(large, e - F.floor(e).cast("double")).otherwise(p - F.floor(p).cast("double"))
        return F.struct(s["v"].alias("v"), base.alias("base"), above.alias("above"), F.when(large, F.lit(0.0)).otherwise(e).alias("rest"))

    def whole(s):
        up = (s["above"] > 0.5) | (s["above"] == 0.5) & ((s["rest"] > 0) | (s["rest"] == 0) & (s["base"] % 2 == 1))
        return F.struct(s["v"].alias("v"), F.when(up, s["base"] + 1).otherwise(s["base"]).alias("n"))

    def result(s):
        v, n = s["v"], s["n"]
        in_parts = ((n - F.pmod(n, F.lit(unit))) / F.lit(unit).cast("decimal(20,0)")).cast("double") + F.pmod(n, F.lit(unit)) / power  # for whole numbers that no double is
        rounded = F.when(n <= 1 << 53, n / power).otherwise(in_parts)
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) >= _WHOLE), v).when(v < 0, -rounded).otherwise(rounded)

    steps = F.array(value.cast("double"))  # every step is computed once and handed on
    for step in (product, parts, whole, result):
        steps = F.transform(steps, step)
    return F.get(steps, 0)
