"""Ordered work on series of any length: no task sees a whole series.

The order key's range is cut by a sketch of its quantiles into slices of about as many rows each. Windows run within a
slice, and what a slice hands on to those after it (its last row, a sum, a maximum) is a row of a table of slices. Equal
keys share a slice. The cuts are those of all rows together, so no slice of a series has more rows than one of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Slices at most, and rows that are worth one.
SLICES = 256
ROWS = 4096


def cuts_of(df: DataFrame, key: str | Column, rows: int | None = None) -> DataFrame:
    """One row, ``_cuts``: the sorted borders of slices of about ``rows`` rows, ``SLICES`` slices at most."""
    k = (F.col(key) if isinstance(key, str) else key).cast("double")
    found = df.agg(F.count(k).alias("_n"), F.percentile_approx(k, [i / SLICES for i in range(1, SLICES)], 10_000).alias("_all"))
    step = F.greatest(F.lit(1), F.ceil(F.lit(SLICES * (rows or ROWS)) / F.greatest(F.col("_n"), F.lit(1))))
    kept = F.filter(F.coalesce("_all", F.array().cast("array<double>")), lambda c, i: (i + 1) % step == 0)
    return found.select(F.array_distinct(kept).alias("_cuts"))


def matched(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``right``, which has a row for each of the keys; null keys meet. Without keys it is one row."""
    if not keys:
        return df.join(F.broadcast(right))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(right.withColumnsRenamed({k: f"_k_{k}" for k in keys}), same, "left").drop(*[f"_k_{k}" for k in keys])


def order_statistics(x: DataFrame, asked: dict, g: str = "_g", v: str = "_x") -> DataFrame:
    """``g``, ``n`` (values) and a map ``_m`` of pairs of order statistics by name, exact, for series of any length.

    ``asked`` gives by name a function of the number of values that returns two places from 0. A sketch of each series brackets
    them, which leaves about a hundredth of the rows; those within a bracket are counted by value, those below it are only
    counted. A series without values has no entries.
    """
    probs = [i / SLICES for i in range(1, SLICES)]
    known = x.groupBy(g).agg(F.count(v).alias("n"), F.percentile_approx(v, probs, 10_000).alias("_all"))

    def bracket(name: str) -> Column:
        lo, hi = asked[name](F.col("n"))
        # half a cell more than needed, as the sketch may be off by a fortieth of one
        below = F.floor(SLICES * lo / F.col("n") - 0.5).cast("int") - 2
        above = F.ceil(SLICES * (hi + 1) / F.col("n") + 0.5).cast("int") - 1
        at = lambda i: F.when(i >= 0, F.get("_all", i))
        return F.struct(F.lit(name).alias("what"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), at(below).alias("a"), at(above).alias("z"))

    brackets = known.filter("n > 0").select(F.col(g).alias("_of"), F.array(*[bracket(a) for a in asked]).alias("_asked"))
    met = x.filter(F.col(v).isNotNull()).join(brackets, F.col(g).eqNullSafe(F.col("_of")))
    reached = F.filter("_asked", lambda a: a["z"].isNull() | (F.col(v) <= a["z"]))
    each = met.select(g, F.explode(F.transform(reached, lambda a: F.struct(a["what"].alias("what"), a["lo"].alias("lo"), a["hi"].alias("hi"), F.when(a["a"].isNull() | (F.col(v) >= a["a"]), F.col(v)).alias("v")))).alias("e"))
    counts = each.groupBy(g, "e.what", "e.lo", "e.hi", "e.v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(g, "what").orderBy(F.asc_nulls_first("v")))
    first = lambda place: F.min(F.when(F.col("_upto") > F.col(place), F.col("v")))
    found = counts.withColumn("_upto", upto).groupBy(g, "what").agg(F.struct(first("lo").alias("lo"), first("hi").alias("hi")).alias("_v"))
    found = found.groupBy(F.col(g).alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct("what", "_v"))).alias("_m"))
    return known.join(found, F.col(g).eqNullSafe(F.col("_of")), "left").select(g, "n", "_m")


def slice_of(cuts: str | Column, key: Column) -> Column:
    """How many cuts are smaller than the key, by binary search; 0 without a key."""
    cuts, key = F.col(cuts) if isinstance(cuts, str) else cuts, key.cast("double")
    steps = F.array(*[F.lit(1 << b) for b in range(SLICES.bit_length() - 2, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < key, at + step).otherwise(at))


def sliced(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """``df`` with the slice ``_s`` of each row."""
    # the cuts are one row
    return df.join(F.broadcast(cuts_of(df, key, rows))).withColumn("_s", slice_of("_cuts", F.col(key))).drop("_cuts")


def _handed_on(df: DataFrame, by: list[str], pieces: dict[str, Column], fold: dict[str, str]) -> DataFrame:
    """``by, _s`` and, by name, the fold (sum, max, last) of the pieces of all earlier slices of the series."""
    each = df.groupBy(*by, "_s").agg(*[c.alias(n) for n, c in pieces.items()])
    rows = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_s", *pieces))).alias("_all"))
    rows = rows.select(*by, "_all", F.posexplode("_all").alias("_k", "_e"))
    earlier = F.slice("_all", F.lit(1), F.col("_k"))

    def folded(name: str) -> Column:
        if fold[name] == "sum":
            return F.aggregate(F.transform(earlier, lambda e: e[name]), F.lit(0).cast(each.schema[name].dataType), lambda acc, v: acc + F.coalesce(v, F.lit(0)))
        if fold[name] == "max":
            return F.array_max(F.transform(earlier, lambda e: e[name]))
        return F.get(F.col("_all"), F.col("_k") - 1)[name]

    return rows.select(*by, F.col("_e._s").alias("_s"), *[folded(n).alias(n) for n in pieces])


def _joined(df: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of ``right`` by series and slice; null series count like any other."""
    names = {c: f"_r_{c}" for c in [*by, "_s"]}
    right = right.withColumnsRenamed(names)
    same = F.col("_s") == F.col("_r__s")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(names[b]))
    # without ``by`` the right side has as many rows as there are slices
    return df.join(right if by else F.broadcast(right), same, "left").drop(*names.values())


def preceding(df: DataFrame, order: list[str], columns: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """``df`` (with slices ``_s``) and, by name, values of the row before; null in a series' first row."""
    by = list(by)
    own = F.struct(*[c.alias(n) for n, c in columns.items()])
    last = _handed_on(df.withColumn("_row", own), by, {"_handed": F.max_by("_row", F.struct(*order))}, {"_handed": "last"})
    x = _joined(df.withColumn("_lag", F.lag(own).over(W.partitionBy(*by, "_s").orderBy(*order))), last, by)
    x = x.withColumn("_lag", F.coalesce("_lag", "_handed"))
    return x.withColumns({n: F.col("_lag")[n] for n in columns}).drop("_lag", "_handed")


def running(df: DataFrame, order: list[str], sums: dict[str, Column] = {}, maxima: dict[str, Column] = {}, by: list[str] = (), ties: bool = False) -> DataFrame:
    """``df`` (with slices ``_s``) and, by name, sums and maxima over all rows up to the present one; with ``ties`` also over
    those that have the same key."""
    by = list(by)
    w = W.partitionBy(*by, "_s").orderBy(*order)
    w = w.rangeBetween(W.unboundedPreceding, 0) if ties else w.rowsBetween(W.unboundedPreceding, 0)
    pieces = {f"_b_{n}": F.sum(c) for n, c in sums.items()} | {f"_b_{n}": F.max(c) for n, c in maxima.items()}
    before = _handed_on(df, by, pieces, {f"_b_{n}": "sum" for n in sums} | {f"_b_{n}": "max" for n in maxima})
    x = df.withColumns({f"_w_{n}": F.sum(c).over(w) for n, c in sums.items()} | {f"_w_{n}": F.max(c).over(w) for n, c in maxima.items()})
    x = _joined(x, before, by)
    x = x.withColumns({n: F.col(f"_w_{n}") + F.col(f"_b_{n}") for n in sums} | {n: F.greatest(f"_w_{n}", f"_b_{n}") for n in maxima})
    return x.drop(*[f"{p}{n}" for n in (*sums, *maxima) for p in ("_w_", "_b_")])


def numbered(df: DataFrame, order: str, by: list[str] = (), rows: int | None = None) -> DataFrame:
    """``df`` and ``_i``, the place of each row in its series from 0; rows of one key are in any order."""
    x = running(sliced(df, order, rows), [order], {"_i": F.lit(1).cast("bigint")}, by=by)
    return x.withColumn("_i", F.col("_i") - 1).drop("_s")


def with_halo(df: DataFrame, place: str, back: int, ahead: int, size: int) -> DataFrame:
    """Each row in the block ``_at`` of ``size`` places that owns it (``_own``), and in those whose frames reach it: frames go
    from ``back`` places before a row to ``ahead`` after it."""
    block = lambda c: F.floor(c / size).cast("bigint")
    reached = F.sequence(block(F.col(place) - ahead), block(F.col(place) + back))
    return df.withColumn("_at", F.explode(reached)).withColumn("_own", F.col("_at") == block(F.col(place)))
