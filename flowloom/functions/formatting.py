"""Number-to-text expressions with the printing rules of the text datasets.

Two column expressions replace what would otherwise be a per-row Python
function: the shortest round-trip form of a double, and the fixed four-decimal
form rounded on the exact binary value.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_repr(x: Column) -> Column:
    """Shortest decimal text of a double; an exponent only below 1e-4 or from 1e16 on.

    Spark prints an exponent below 1e-3 and from 1e7 on. In the stretch between
    the two rules the digits are laid out by a decimal, which takes them from
    the same shortest form; outside it only the spelling of the exponent differs.
    """
    size = F.abs(x)
    shown = x.cast("string")
    plain = F.rtrim(x.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    exponent = F.regexp_replace(F.regexp_replace(shown, r"\.0E", "E"), r"E-(\d)$", "E-0$1")
    exponent = F.regexp_replace(F.regexp_replace(exponent, "E-", "e-"), r"E(\d+)$", "e+$1")
    return (
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), shown)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def fixed(x: Column, places: int) -> Column:
    """``places`` decimals (1 to 9), rounded on the exact binary value, ties to even; NULL stays NULL.

    The pattern form of ``format_number`` rounds like that, with two
    exceptions: half a unit of the last decimal, whose double lies above the tie for 1, 2 and 4 places, and
    numbers so large that their shortest digits end before the last decimal.
    Those are put together from the whole part and the exact binary fraction.

    A pattern takes a microsecond a value. Where ``x * 10**places``, which is off by less than 2**-53 of itself, is no nearer than that to a
    half, its whole number has the digits and is printed as a decimal. The others are few; their rules stay in a lambda, out of the generated code.
    """
    scaled = F.abs(x) * float(10**places)
    digits = F.rint(scaled)
    plain = float(10 ** max(places - 6, 0))  # a smaller decimal may be printed with an exponent
    sure = (digits >= plain) & (scaled < 1e15) & (F.abs(scaled - digits) + scaled * 1.2e-16 < 0.5)
    signed = F.when(x < 0, -digits).otherwise(digits).cast("bigint").cast("decimal(15,0)")
    unit = F.expr(f"{10**-places:.{places}f}BD")
    rest = F.get(F.transform(F.array(x), lambda v: _by_pattern(v, places)), F.lit(0))
    return F.when(sure, (signed * unit).cast("string")).otherwise(rest)


def _by_pattern(x: Column, places: int) -> Column:
    text = F.call_function("format_number", x, F.lit("0." + "0" * places))
    size = F.abs(x)
    fraction = F.bround((size - F.floor(size)).try_cast("decimal(38,18)"), places)
    exact = (F.floor(size).cast("decimal(28,0)") + fraction).cast(f"decimal({28 + places},{places})").cast("string")
    half = float(f"5e-{places + 1}")
    unit = "0." + "0" * (places - 1) + "1" if Fraction(half) > Fraction(5, 10 ** (places + 1)) else "0." + "0" * places
    return (
        F.when(size == half, F.when(x > 0, unit).otherwise(f"-{unit}"))
        .when(size < 4e11, text)
        .otherwise(F.concat(F.when(x < 0, "-").otherwise(""), exact))
    )


def rounded(x: Column, places: int) -> Column:
    """``round(x, places)`` of a double, which reads its shortest text, without the text where the whole number of units is sure.

    That text and the product lie within 2**-52 of each other; the quotient of two whole numbers is the double next to the decimal.
    """
    scaled = x * float(10**places)
    digits = F.rint(scaled)
    sure = (F.abs(scaled) < 1e15) & (F.abs(scaled - digits) + F.abs(scaled) * 2.3e-16 < 0.5)
    return F.when(sure, digits / float(10**places) + 0.0).otherwise(F.round(x, places))  # no negative zero


def fmt4(x: Column) -> Column:
    """Four decimals, see :func:`fixed`."""
    return fixed(x, 4)
