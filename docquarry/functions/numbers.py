"""Numbers of any size and precision, by their text.

VARIANT holds 38 digits at most, and doubles 17. Here a JSON number is read off its spelling
into a key of sign, magnitude and digits that orders and equals as the number does: ``1``, ``1.0``
and ``10e-1`` are one, ``1e400`` is more than ``9e399``, and of two with 40 digits
the last one counts. All is string work in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variant import bound

#: A number as JSON spells it: sign, whole part, fraction, exponent.
_NUMBER = r"^(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"
_LONGEST = 30  # digits of a plain exponent


def _parts(text: Column) -> Column:
    """Struct of sign, digits without zeros around, and the power of ten of the place before the first digit; NULL for no number."""
    part = lambda n: F.regexp_extract(text, _NUMBER, n)
    raw = F.struct(part(1).alias("sign"), F.concat(part(2), part(3)).alias("all"), F.length(part(2)).alias("whole"), F.when(part(4) == "", "0").otherwise(part(4)).alias("e"))

    def read(x: Column) -> Column:
        led = F.regexp_replace(x["all"], "^0+", "")
        digits = F.regexp_replace(led, "0+$", "")
        power = F.regexp_replace(x["e"], r"^\+", "").try_cast(f"decimal({_LONGEST},0)") + (x["whole"] - (F.length(x["all"]) - F.length(led))).cast(f"decimal({_LONGEST},0)")
        sign = F.when(digits == "", 0).when(x["sign"] == "-", -1).otherwise(1)
        return F.struct(sign.alias("sign"), digits.alias("digits"), F.when(digits == "", F.lit(0)).otherwise(power).alias("power"))

    return F.when(text.rlike(_NUMBER), bound(raw, read))


def number_key(text: Column) -> Column:
    """A struct that compares, sorts and groups as the number does; NULL for no number, and for an exponent of over 30 digits."""

    def key(x: Column) -> Column:
        low = F.concat(F.translate(x["digits"], "0123456789", "9876543210"), F.lit("~"))  # of two negative ones the longer is less
        return F.struct(x["sign"].alias("sign"), (x["power"] * x["sign"]).alias("power"), F.when(x["sign"] < 0, low).otherwise(x["digits"]).alias("digits"))

    return bound(_parts(text), lambda x: F.when(x["power"].isNotNull(), key(x)))


def exact_long(text: Column) -> Column:
    """The number as long if it is whole and in range, however it is spelled; else NULL."""

    def whole(x: Column) -> Column:
        size = F.length(x["digits"])
        fits = (x["power"] >= size) & (x["power"] <= 19)
        digits = F.rpad(x["digits"], F.when(fits, x["power"]).otherwise(1).cast("int"), F.lit("0"))
        signed = F.concat(F.when(x["sign"] < 0, "-").otherwise(""), digits)
        return F.when(x["sign"] == 0, F.lit(0).cast("bigint")).when(fits, signed.try_cast("decimal(38,0)").try_cast("bigint"))

    return bound(_parts(text), whole)


def same_number(a: Column, b: Column) -> Column:
    """Whether two texts are one number; NULL if either is none."""
    return number_key(a) == number_key(b)
