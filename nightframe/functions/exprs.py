"""Scalar expressions. What the domain calls not-a-number is NULL here, so aggregates skip it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightframe import params as P


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Doubles; NaN and the infinities become NULL."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(c: Column | str) -> Column:
    """Text to a finite double, else NULL."""
    return finite(col(c).try_cast("double"))


def leading_number(c: Column | str) -> Column:
    """The number that a text begins with: ``6.5abc`` is 6.5."""
    return finite(F.regexp_extract(col(c).cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def exact_mean(c: Column | str) -> Column:
    """Aggregate: the mean of the finite values, the same in whatever order and grouping they come.

    Every value is cut into four whole numbers of 30 bits, whose sums are exact; what a value has below 2**-60 is dropped.
    Sums of 2**61 and more are left to the usual mean.
    """
    x = finite(c)
    y, unit, mask = F.when(F.abs(x) < 2.0**61, x), 2.0**30, F.lit((1 << 30) - 1)
    top, rest = F.floor(y / unit), (y - F.floor(y)) * unit
    ends = F.sum(F.floor((rest - F.floor(rest)) * unit))
    fits = F.sum(F.abs(x)) < 2.0**61
    middle = F.sum(F.floor(rest)) + F.shiftright(ends, 30)
    whole = F.when(fits, F.sum(top)) * F.lit(1 << 30) + F.sum(F.floor(y - top * unit)) + F.shiftright(middle, 30)
    part = middle.bitwiseAND(mask) * F.lit(1 << 30) + ends.bitwiseAND(mask)
    total = whole.cast("double") + part * 2.0**-60
    return F.when(fits, total / F.nullif(F.count(x), F.lit(0))).otherwise(F.avg(x))


def clamp(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL, which ``greatest`` and ``least`` alone would skip."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def r6(c: Column | str) -> Column:
    """Six decimals, for comparing results; minus zero becomes zero."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def duration_seconds(c: Column | str) -> Column:
    """``H:MM:SS``, ``MM:SS`` or ``SS`` in seconds; anything else NULL."""
    text = F.trim(col(c).cast("string"))
    part = r"\d+(?:\.\d+)?"
    parts = F.split(text, ":")
    total = F.aggregate(F.transform(parts, lambda p: p.try_cast("double")), F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(text.rlike(rf"^{part}(?::{part}){{0,2}}$"), total)


def hours(c: Column | str) -> Column:
    return duration_seconds(c) / 3600


# Coefficients of the usual rational approximation of the normal quantile and of the normal distribution.
_QA = (2.50662823884, -18.61500062529, 41.39119773534, -25.44106049637)
_QB = (-8.4735109309, 23.08336743743, -21.06224101826, 3.13082909833)
_QC = (0.3374754822726147, 0.9761690190917186, 0.1607979714918209, 0.0276438810333863, 0.0038405729373609, 0.0003951896511919, 0.0000321767881768, 0.0000002888167364, 0.0000003960315187)
_CDF = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_quantile(p: Column | str) -> Column:
    p = col(p)
    y = p - 0.5
    middle = y * _poly(_QA, y * y) / _poly((1.0, *_QB), y * y)
    tail = _poly(_QC, F.ln(-F.ln(F.when(y > 0, 1 - p).otherwise(p))))
    return F.when(F.abs(y) < 0.42, middle).when(y < 0, -tail).otherwise(tail)


def normal_cdf(z: Column | str) -> Column:
    z = col(z)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    upper = 0.3989423 * F.exp(-z * z / 2) * t * _poly(_CDF, t)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def wilson(p: Column, n: Column, z: float = P.Z) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion."""
    n = n.cast("double")
    scale = 1 + F.lit(z * z) / F.nullif(n, F.lit(0.0))
    centre = (p + z * z / 2 / F.nullif(n, F.lit(0.0))) / scale
    half = z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / F.nullif(n, F.lit(0.0)) + z * z / 4 / F.nullif(n * n, F.lit(0.0)))) / scale
    return clamp(centre - half, 0.0, 1.0), clamp(centre + half, 0.0, 1.0)


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """From moments about a centre; NULL where a side doesn't vary."""
    cov, vx, vy = sxy - sx * sy / F.nullif(n, F.lit(0)), sxx - sx * sx / F.nullif(n, F.lit(0)), syy - sy * sy / F.nullif(n, F.lit(0))
    product = F.when((vx > 1e-12 * F.abs(sxx)) & (vy > 1e-12 * F.abs(syy)), F.sqrt(vx * vy))
    return clamp(ratio(cov, product), -1.0, 1.0)


def severity_band(ahi: Column | str) -> Column:
    x, (a, b, c) = col(ahi), P.AHI_BANDS
    return F.when(x.isNull(), None).when(x <= a, "normal").when(x <= b, "mild").when(x <= c, "moderate").otherwise("severe")


def effect_band(effect: Column | str) -> Column:
    x = F.abs(col(effect))
    return F.when(x.isNull(), "unknown").when(x < 0.1, "negligible").when(x < 0.3, "small").when(x < 0.5, "medium").otherwise("large")


def strength_label(r: Column | str) -> Column:
    x = F.abs(col(r))
    return F.when(x.isNull(), None).when(x >= 0.9, "very strong").when(x >= 0.7, "strong").when(x >= 0.5, "moderate").when(x >= 0.3, "weak").otherwise("very weak")


def p_stars(p: Column | str) -> Column:
    x = col(p)
    return F.when(x.isNull(), "").when(x < 0.001, "***").when(x < 0.01, "**").when(x < 0.05, "*").otherwise("")


def cluster_severity(total_sec: Column, density: Column, extension_sec: Column) -> Column:
    return 1.5 * total_sec / 60 + 0.5 * density + extension_sec / 30


def density(count: Column, span_sec: Column) -> Column:
    """Events a minute over at least a second."""
    return count / (F.greatest(span_sec, F.lit(1.0)) / 60)


# --- dates --------------------------------------------------------------------------------------------------------


def plausible(ts: Column) -> Column:
    """Instants before 2000 are clock errors."""
    return F.when(F.year(ts) >= 2000, ts)


def us_timestamp(c: Column | str) -> Column:
    """``M/D/YY`` or ``M/D/YYYY``, with or without ``H:MM`` or ``H:MM:SS``, as wall-clock time."""
    text = F.trim(col(c))
    tries = [F.try_to_timestamp(text, F.lit(f"{d}{t}")) for d in ("M/d/yy", "M/d/y") for t in (" H:mm:ss", " H:mm", "")]
    two = F.regexp_extract(text, r"^\d{1,2}/\d{1,2}/(\d+)", 1)
    short = F.coalesce(*tries[:3])
    return plausible(F.when(F.length(two) == 2, short).when(F.length(two) == 4, F.coalesce(*tries[3:]))).cast("timestamp_ntz")


def iso_wall(c: Column | str) -> Column:
    """ISO date and time read literally, whatever zone it names."""
    text = F.regexp_extract(F.trim(col(c).cast("string")), r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?)", 1)
    return plausible(F.nullif(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("")).try_cast("timestamp_ntz"))


def iso_instant(c: Column | str) -> Column:
    """ISO date and time that names its zone (``Z`` or an offset); NULL without one."""
    text = F.trim(col(c).cast("string"))
    return plausible(F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp")))


def epoch_seconds(c: Column | str) -> Column:
    return plausible(F.timestamp_seconds(number(c)))


def offset_minutes(c: Column | str) -> Column:
    """``±HH:MM`` or ``±HHMM``."""
    text = F.trim(col(c))
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    pattern = r"^[+-](\d{2}):?(\d{2})$"
    return F.when(text.rlike(pattern), sign * (F.regexp_extract(text, pattern, 1).try_cast("int") * 60 + F.regexp_extract(text, pattern, 2).try_cast("int")))


def wall_minutes(ts: Column | str) -> Column:
    """Minutes of a wall-clock time since 1970, as if it were UTC."""
    return F.unix_seconds(col(ts).cast("timestamp")) / 60


def day_number(d: Column | str) -> Column:
    return F.datediff(col(d).cast("date"), F.lit("1970-01-01").cast("date"))


def fixed(c: Column | str, decimals: int = 2) -> Column:
    """A number as text with fixed decimals, a dash where there is none."""
    return F.coalesce(F.replace(F.format_number(col(c), decimals), F.lit(","), F.lit("")), F.lit("—"))


def maybe_date(c: Column | str) -> Column:
    """A timestamp out of a text, null for what is none; empty texts are none."""
    c = col(c)
    return F.coalesce(iso_instant(c), c.try_cast("timestamp"))


def range_texts(start: Column | str, end: Column | str) -> Column:
    """The two ends of a range as ISO texts in UTC, null where an end is open."""
    text = lambda c: F.date_format(col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.struct(text(start).alias("start"), text(end).alias("end"))
