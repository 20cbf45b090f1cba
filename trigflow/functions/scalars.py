"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_blank(col: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(F.trim(col.cast("string")), F.lit(""))


def number(col: Column) -> Column:
    """Number or NULL; text that does not parse and NaN are NULL."""
    return F.nanvl(non_blank(col).try_cast("double"), F.lit(None).cast("double"))


def first_number(*cols: Column) -> Column:
    """First alias that holds anything, read as a number."""
    return number(F.coalesce(*[non_blank(c) for c in cols]))


def first_text(*cols: Column, default: str | None = None) -> Column:
    options = [non_blank(c) for c in cols]
    return F.coalesce(*options, F.lit(default)) if default is not None else F.coalesce(*options)


def normalise_ids(col: Column) -> Column:
    """Sorted distinct integers of an array of strings (``int(float(s))``), or NULL when none."""
    ids = F.transform(col, lambda v: F.trim(v.cast("string")).try_cast("double").try_cast("int"))
    ids = F.array_sort(F.array_distinct(F.filter(ids, lambda v: v.isNotNull())))
    return F.when(F.size(ids) > 0, ids)


def session_subject(name: Column) -> Column:
    """``A_B_C…`` gives ``A_B``; a shorter name is its own subject; a missing one is unknown."""
    parts = F.split(name, "_")
    return F.when(name.isNull(), "unknown").when(
        F.size(parts) >= 3, F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    ).otherwise(name)


def session_label(name: Column) -> Column:
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise("unknown")


def session_date(name: Column) -> Column:
    """First run of 8 digits (ddMMyyyy), else of 6 (ddMMyy in the 2000s); invalid gives NULL."""
    token = F.regexp_extract(name, r"(\d{8}|\d{6})", 1)
    day, month = F.substring(token, 1, 2), F.substring(token, 3, 2)
    year = F.when(F.length(token) == 8, F.substring(token, 5, 4)).otherwise(
        F.concat(F.lit("20"), F.substring(token, 5, 2)))
    iso = F.concat_ws("-", year, month, day)
    return F.when(F.length(token) > 0, iso.try_cast("date"))


def response_class(latency_ms: Column, reliability: Column, max_latency_ms: float = 6.0,
                  min_reliability: float = 0.5) -> Column:
    return F.when(
        latency_ms.isNotNull() & (latency_ms <= max_latency_ms) & (reliability >= min_reliability), "opto"
    ).otherwise("none")


def waveform_class(width_us: Column, valley_us: Column, rate_hz: Column) -> Column:
    """SPN: wide and slow to repolarise, at most 10 Hz. FSI: narrow, at least 0.1 Hz."""
    return (
        F.when((width_us > 150) & (valley_us > 500) & (rate_hz <= 10), "SPN")
        .when((width_us <= 150) & (valley_us <= 500) & (rate_hz >= 0.1), "FSI")
        .otherwise("Other")
    )


def poisson_upper_tail(k: Column, lam: Column, terms: int = 400) -> Column:
    """P[X >= k] for a Poisson mean.

    Summed from the smaller side so nothing cancels: upward from k when k exceeds the
    mean, else one minus the sum downward from k-1. Terms shrink by a ratio below one,
    so the sum ends once a term no longer changes it; ``terms`` is the longest run
    near the mean and grows with its root.
    """
    n = F.greatest(F.lit(terms), F.ceil(F.sqrt(lam) * 14).cast("int"))

    def log_pmf(i: Column) -> Column:
        return i * F.log(lam) - lam - log_factorial(i)

    def run(start: Column, ratio) -> Column:
        first = F.exp(log_pmf(start))
        zero = F.struct(first.alias("term"), first.alias("total"))

        def step(acc: Column, i: Column) -> Column:
            term = acc["term"] * ratio(start, i)
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        return F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda acc: acc["total"])

    upper = run(k, lambda s, i: lam / (s + i))
    lower = run(k - 1, lambda s, i: F.greatest(s - i + 1, F.lit(0)) / lam)
    tail = F.when(k > lam, upper).otherwise(1.0 - lower)
    return F.when(k <= 0, F.lit(1.0)).when(lam <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def log_factorial(n: Column) -> Column:
    """ln n! : a summed product up to 20, Stirling's series beyond (error below 1e-13)."""
    x = n.cast("double") + 1.0
    series = (
        (x - 0.5) * F.log(x) - x + 0.9189385332046727
        + 1.0 / (12 * x) - 1.0 / (360 * x * x * x) + 1.0 / (1260 * F.pow(x, F.lit(5)))
        - 1.0 / (1680 * F.pow(x, F.lit(7)))
    )
    exact = F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))
    return F.when(n <= 20, exact).otherwise(series)
