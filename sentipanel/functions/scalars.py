"""Column -> Column helpers (projections and scalar functions).

All helpers are built-in Spark expressions, so they stay inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b with NULL instead of an ANSI error on a zero divisor."""
    return F.try_divide(_c(a), _c(b))


# ---------------------------------------------------------------- time ----

def utc_ms_to_day(ms: ColumnOrName) -> Column:
    """Epoch milliseconds -> UTC calendar date (session TZ is UTC)."""
    return F.to_date(F.timestamp_millis(_c(ms)))


def trading_day_roll(ms: ColumnOrName, hours: int = 5) -> Column:
    """Shift by ``hours`` before taking the day: late posts count for the next day."""
    return F.to_date(F.timestamp_millis(_c(ms)) + F.make_dt_interval(F.lit(0), F.lit(hours)))


def ts_trading_day_roll(ts: ColumnOrName, hours: int = 5) -> Column:
    """``trading_day_roll`` for a timestamp column instead of epoch ms."""
    return F.to_date(_c(ts) + F.make_dt_interval(F.lit(0), F.lit(hours)))


def shift_days(d: ColumnOrName, n: int) -> Column:
    """Event-time delay of a date key."""
    return F.date_add(_c(d), n)


def strip_timezone_day(s: ColumnOrName) -> Column:
    """Timezone-aware timestamp text -> UTC date."""
    return F.to_date(F.to_timestamp(_c(s)))


# ---------------------------------------------------------------- text ----

# Fixed values (must equal the reference): literal removals of the domain slug,
# applied in this order, then lower-casing.
DOMAIN_SLUG_STEPS = [(" ", "_"), (",", ""), ("'", ""), (".com", ""), ("+", ""),
                     ("-", "_"), ("/", ""), ("!", "")]


def slug_domain(c: ColumnOrName) -> Column:
    """Literal (not regex) replacements, in order, then lower case."""
    out = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), DOMAIN_SLUG_STEPS, _c(c))
    return F.lower(out)


def slug_terms(c: ColumnOrName) -> Column:
    """Every non alphanumeric character -> ``_``."""
    return F.regexp_replace(_c(c), r"[^\p{L}\p{N}]", "_")


# Fixed values (must equal the reference): literal edits turning a security
# name into search terms, applied in this order.
SECURITY_NAME_STEPS = [("(The)", ""), ("Inc.", ""), ("(Class A)", ""), ("(Class B)", ""),
                       ("(Class C)", ""), ("Company", ""), ("Corporation", ""), ("Group", ""),
                       (",", ""), (" of ", " "), ("plc", ""), (" & ", " "), ("'", ""),
                       ("  ", " "), ("Companies", ""), (".", "")]


def clean_security_name(c: ColumnOrName) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), SECURITY_NAME_STEPS, _c(c))


def tokenize_words(c: ColumnOrName) -> Column:
    """Unicode ``\\w+`` runs of the lower-cased text, re-joined by single spaces."""
    return F.array_join(word_array(c), " ")


def word_array(c: ColumnOrName) -> Column:
    # Python's unicode \w: letters, numbers and underscore (no combining marks)
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"([\p{L}\p{N}_]+)"), 1)


# ------------------------------------------------------------- numbers ----

def log_return(a: ColumnOrName, b: ColumnOrName) -> Column:
    """ln(a / b); NULL for non-positive ratios or zero divisors."""
    return F.log(safe_div(a, b))


def clip(c: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    out = _c(c)
    if lo is not None:
        out = F.when(out.isNull(), out).otherwise(F.greatest(out, F.lit(lo)))
    if hi is not None:
        out = F.when(out.isNull(), out).otherwise(F.least(out, F.lit(hi)))
    return out


def threshold_signal(c: ColumnOrName, t: float) -> Column:
    """1.0 where the prediction exceeds the threshold, else 0.0."""
    return F.when(_c(c) > F.lit(t), F.lit(1.0)).otherwise(F.lit(0.0))


def rescale_rating(c: ColumnOrName) -> Column:
    """[-1, 1] -> [1, 5]."""
    return (_c(c) + 1) * 2 + 1


def compound(pos: ColumnOrName, neg: ColumnOrName) -> Column:
    return _c(pos) - _c(neg)


def normalised_compound(c: ColumnOrName, k: float = 20.0) -> Column:
    """c / sqrt(c^2 + k): squashes an unbounded score into (-1, 1)."""
    x = _c(c)
    return x / F.sqrt(x * x + F.lit(float(k)))


def abs_col(c: ColumnOrName) -> Column:
    return F.abs(_c(c))
