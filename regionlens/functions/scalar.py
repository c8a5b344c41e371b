"""Column expressions used across the library.

Every helper returns a native ``Column`` so that plans stay inside whole-stage
codegen; nothing here is a Python UDF. Spark 4 runs with ANSI mode on, so
division and casts use the ``try_`` forms, which give null instead of raising.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning rules of the attribute files. Thousands separators
# and the dollar sign are removed from every value; these texts mean "missing".
STRIP_CHARS_PATTERN = "[,$]"
MISSING_TEXTS = ("None", "nan", "NaN", "")
HEADER_DATE_FORMAT = "M/d/yy"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_number_text(c: str | Column) -> Column:
    """Remove thousands commas and ``$`` in one pass (``'$1,250.50'`` -> ``'1250.50'``)."""
    return F.regexp_replace(_col(c).cast("string"), STRIP_CHARS_PATTERN, "")


def is_missing_text(c: str | Column) -> Column:
    """True for null and for the texts that stand for a missing value."""
    t = F.trim(_col(c).cast("string"))
    return t.isNull() | t.isin(*MISSING_TEXTS)


def clean_text(c: str | Column) -> Column:
    """Stripped text, or null where the value is missing (never a sentinel)."""
    return F.when(is_missing_text(c), F.lit(None).cast("string")).otherwise(strip_number_text(c))


def to_number(c: str | Column) -> Column:
    """Cleaned text as double; unparsable text gives null rather than an error."""
    return clean_text(c).try_cast("double")


def pad_key(c: str | Column, width: int = 5) -> Column:
    """Zero-padded integer key, e.g. 1001.0 -> '01001'; null stays null.

    ``format_string`` turns null into the text ' null', hence the guard. Wider
    numbers keep all their digits (``lpad`` would truncate them).
    """
    v = _col(c).try_cast("long")
    return F.when(v.isNotNull(), F.format_string(f"%0{width}d", v))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, null when den is 0 or null."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def round_half_even(c: str | Column, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to even (same as DuckDB ``round_even``)."""
    scale = float(10**digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def format_round(c: str | Column, digits: int) -> Column:
    """Parity form: fixed-decimal text then back to double.

    Values of 1000 or more carry a thousands comma and become null.
    """
    return F.format_number(_col(c), digits).try_cast("double")


def rate(num: str | Column, den: str | Column, digits: int, method: str = "rint") -> Column:
    """Ratio rounded to ``digits``; a zero or missing denominator gives 0."""
    r = ratio(num, den)
    r = format_round(r, digits) if method == "format_number" else round_half_even(r, digits)
    return F.coalesce(r, F.lit(0.0))


def log10_positive(c: str | Column) -> Column:
    """log10 for x > 0, null otherwise."""
    x = _col(c).cast("double")
    return F.when(x > 0, F.log10(x))


def log10_1p(c: str | Column) -> Column:
    """log10(1 + x)."""
    return F.log10(F.lit(1.0) + _col(c).cast("double"))


def logistic(t: str | Column, a: str | Column, n: str | Column, tau: str | Column) -> Column:
    """a / (1 + n * exp(-t / tau))."""
    return _col(a) / (F.lit(1.0) + _col(n) * F.exp(-_col(t) / _col(tau)))


def threshold_label(c: str | Column, threshold: float) -> Column:
    """1 when c >= threshold, else 0 (null stays null)."""
    return (_col(c) >= F.lit(threshold)).cast("int")


def clamp(c: str | Column, lo: float | Column, hi: float | Column) -> Column:
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(_col(c), lo_c), hi_c)


def parse_header_date(c: str | Column) -> Column:
    """Parse a date column header such as '1/22/20'."""
    return F.try_to_date(_col(c), HEADER_DATE_FORMAT)


def hash_unit(key: str | Column, seed: int | str) -> Column:
    """Deterministic number in [0, 2^32) from md5('<seed>:<key>').

    Unlike ``randomSplit`` it does not depend on partitioning, and DuckDB
    computes the same value: ('0x' || substr(md5(s), 1, 8))::bigint.
    """
    s = F.concat(F.lit(f"{seed}:"), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def hash_bits(key: str | Column, seed: int | str) -> Column:
    """Like ``hash_unit``, in [0, 2^60): the first 15 digits of the md5."""
    s = F.concat(F.lit(f"{seed}:"), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def round_to(c: str | Column, digits: int) -> Column:
    """Output rounding used for values compared across engines."""
    return round_half_even(c, digits)
