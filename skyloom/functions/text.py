"""String and number helpers with web-script semantics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of web scripts. Spark's trim strips only U+0020.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Leading numeric prefix accepted by a lenient float parser.
FLOAT_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


# Splits a double into halves whose products are exact.
SPLITTER = 134217729.0


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def js_upper_trim(c: Column) -> Column:
    return F.upper(js_trim(c))


def js_round(c: Column) -> Column:
    """Round half up, also for negative numbers; returns BIGINT."""
    return F.floor(c + F.lit(0.5))


def round1(c: Column) -> Column:
    """One decimal, half up."""
    return F.floor(c * 10 + F.lit(0.5)) / F.lit(10.0)


def to_fixed(c: Column, digits: int) -> Column:
    """Decimal text used as a rounding key: the stored binary value, half up; keeps the sign of a negative zero.

    ``round`` and formatting start from the shortest printed decimal. The product by a power of ten is
    inexact, so its rounding error, taken from the split factors, decides about the half. NaN is NaN.
    """
    scale = 10**digits
    x = F.abs(c.cast("double"))
    product = x * float(scale)
    high = x * SPLITTER - (x * SPLITTER - x)
    error = (high * float(scale) - product) + (x - high) * float(scale)
    whole = F.floor(product)
    up = (product - whole - 0.5) + error >= 0
    n = whole + F.when(up, 1).otherwise(0)
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.floor(n / scale).cast("string"))
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
    return F.when(F.isnan(c.cast("double")), F.lit("NaN")).otherwise(text)


def parse_float_prefix(c: Column) -> Column:
    """Leading number of a string as DOUBLE, NULL when there is none (`12.5abc` -> 12.5)."""
    return F.regexp_extract(c, FLOAT_PREFIX, 1).try_cast("double")


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def strip_nan(c: Column) -> Column:
    """NaN compares greater than every number in Spark, so it has to become NULL before a `>`."""
    return F.when(~F.isnan(c), c)


def title_case(c: Column) -> Column:
    """Upper-case the first word character of each blank-separated token, lower-case the rest."""

    def one(tok: Column) -> Column:
        head = F.regexp_extract(tok, r"^[^A-Za-z0-9_]*", 0)
        word = F.substring(tok, F.length(head) + 1, F.length(tok))
        return F.concat(
            head,
            F.upper(F.substring(word, 1, 1)),
            F.lower(F.substring(word, F.lit(2), F.length(word))),
        )

    tokens = F.regexp_extract_all(c, F.lit(r"(\s+|\S+)"), F.lit(1))
    return F.array_join(F.transform(tokens, one), "")


def moa_ident(c: Column) -> Column:
    return F.upper(js_trim(F.regexp_replace(c, r"(?i)\s*MOA$", "")))


def moa_spoken(c: Column) -> Column:
    no_suffix = F.regexp_replace(c, r"(?i)\s*MOA$", "")
    no_digits = F.regexp_replace(no_suffix, "[0-9]+", "")
    return F.lower(js_trim(F.regexp_replace(no_digits, f"{SPACE}+", " ")))


def name_letters(c: Column) -> Column:
    """Case-sensitive: keeps only A-Z of the text as it is."""
    return F.regexp_replace(c, "[^A-Z]", "")


# First letters of four-letter codes that are left out in comparisons.
REGION_LETTERS = "^[KCEPYL]"


def norm_airport_code(c: Column) -> Column:
    """Four-letter codes with a known region prefix lose it, so KLAX and LAX compare equal."""
    u = js_upper_trim(F.coalesce(c, F.lit("")))
    return F.when(
        (F.length(u) == 4) & u.rlike(REGION_LETTERS), F.substring(u, 2, 3)
    ).otherwise(u)
