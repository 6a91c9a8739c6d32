"""The correlation engine: a registry of pairs, all tested from one long table, with false-discovery control by family."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nightframe import params as P
from nightframe.functions.exprs import effect_band, finite, ratio
from nightframe.operators import inference as I
from nightframe.operators import series as S


@dataclass(frozen=True)
class Pair:
    id: int
    x: str
    y: str
    sign: str
    family: str
    two_sided: bool = False


# The pairs, their expected signs and families; group contrasts.
PAIRS = (
    Pair(1, "ahi", "spo2.min_pct", "-", "primary"),
    Pair(2, "ahi", "spo2.pct_time_below_90", "+", "primary"),
    Pair(3, "ahi", "hrv.rmssd_ms", "-", "primary"),
    Pair(4, "ahi", "hr.sleeping_avg", "+", "primary"),
    Pair(5, "ahi", "rr_nightly", "±", "exploratory", True),
    Pair(6, "ahi", "snore.snore_minutes", "+", "primary"),
    Pair(7, "ahi", "efficiency_pct", "-", "primary"),
    Pair(8, "median_epap", "spo2.min_pct", "±", "exploratory", True),
    Pair(9, "usage_hours", "readiness_score", "+", "primary"),
    Pair(10, "usage_hours", "hrv.rmssd_ms", "+", "exploratory"),
    Pair(11, "leak_median", "efficiency_pct", "-", "exploratory"),
    Pair(12, "ahi", "stress_score", "+", "exploratory"),
)
HIGH_AHI, LOW_AHI, WRONG_SIGN_RHO, ATTENUATION, NOT_INFERRED, SERIAL, Q_EXPLORATORY = 15.0, 5.0, 0.5, 0.3, 0.2, 0.3, 0.10


def registry(spark: SparkSession, pairs: tuple[Pair, ...] = PAIRS) -> DataFrame:
    rows = [(p.id, p.x, p.y, p.sign, p.family, p.two_sided) for p in pairs]
    return spark.createDataFrame(rows, "pair_id int, x string, y string, sign string, family string, two_sided boolean")


def _has(df: DataFrame, path: str) -> bool:
    schema = df.schema
    for part in path.split("."):
        if not isinstance(schema, StructType) or part not in schema.names:
            return False
        schema = schema[part].dataType
    return True


def pairs_long(nights: DataFrame, pairs: tuple[Pair, ...] = PAIRS, day: str = "night") -> DataFrame:
    """``pair_id, night, x_value, y_value, ahi, y_insufficient``: the nights once for each pair whose columns exist.

    A night whose measure fell short of its gate (its group is named in ``insufficient``) is told from one without it.
    """
    have = [p for p in pairs if _has(nights, p.x) and _has(nights, p.y)]
    short = lambda p: F.array_contains("insufficient", p.y.split(".")[0]) if "insufficient" in nights.columns else F.lit(False)
    source = F.col("window_source") if "window_source" in nights.columns else F.lit(None).cast("string")
    ahi = finite("ahi") if "ahi" in nights.columns else F.lit(None).cast("double")
    parts = [F.struct(F.lit(p.id).alias("pair_id"), finite(p.x).alias("x_value"), finite(p.y).alias("y_value"), F.coalesce(short(p), F.lit(False)).alias("y_insufficient")) for p in have]
    if not parts:
        parts = [F.struct(F.lit(-1).alias("pair_id"), F.lit(None).cast("double").alias("x_value"), F.lit(None).cast("double").alias("y_value"), F.lit(False).alias("y_insufficient"))]
    return nights.select(F.col(day).alias("night"), ahi.alias("ahi"), source.alias("window_source"), F.explode(F.array(*parts)).alias("p")).select("night", "ahi", "window_source", "p.*").filter("pair_id >= 0")


def coverage_selection(long: DataFrame) -> DataFrame:
    """AHI of the nights a pair keeps against those it loses for want of coverage."""
    seen = long.filter(F.col("x_value").isNotNull()).withColumn("_kept", F.col("y_value").isNotNull())
    judged = seen.filter("_kept or y_insufficient")
    test = I.mann_whitney(judged, "ahi", F.col("_kept"), ["pair_id"], spread=False).select("pair_id", F.col("p").alias("selection_p"))
    medians = judged.groupBy("pair_id").agg(
        F.count(F.when(F.col("_kept"), 1)).alias("n_kept"), F.count(F.when(~F.col("_kept"), 1)).alias("n_dropped"),
        F.percentile(F.when(F.col("_kept"), F.col("ahi")), F.lit(0.5)).alias("kept_ahi"), F.percentile(F.when(~F.col("_kept"), F.col("ahi")), F.lit(0.5)).alias("dropped_ahi"),
        (1 - F.avg(F.col("window_source").isin("inferred", "userSleeps-hint").cast("double"))).alias("not_inferred"),
    )
    return medians.join(test, "pair_id", "left")


def run_pairs(long: DataFrame, pairs: DataFrame, rounds: int = P.PERMUTATIONS, seed: int = 5) -> DataFrame:
    """One row per pair: Spearman's rho, its p by t or, under heavy ties, by permutation, the p at the effective number
    of nights, the descriptive lag profile, and flags. Under ten nights a pair is not tested and has no profile."""
    both = long.filter("x_value is not null and y_value is not null")
    rho = I.spearman(both, "x_value", "y_value", ["pair_id"], spread=False)
    ties = I.heavy_ties(both, ["x_value", "y_value"], ["pair_id"]).select("pair_id", "heavy")
    a = S.first_lag(both, "night", "x_value", ["pair_id"]).withColumnRenamed("r1", "r1x")
    b = S.first_lag(both, "night", "y_value", ["pair_id"]).withColumnRenamed("r1", "r1y")
    span = both.groupBy("pair_id").agg(F.min("night").alias("from_night"), F.max("night").alias("to_night"))
    tied = both.join(F.broadcast(ties.filter("heavy").select("pair_id")), "pair_id")
    permuted = I.permutation_tests(tied, "x_value", "y_value", ["pair_id"], rounds, seed, spread=False).select("pair_id", F.col("p").alias("_perm"))
    lags = S.lag_profile(both, "night", "x_value", "y_value", by=["pair_id"])
    seen = F.map_from_entries(F.collect_list(F.struct("lag", F.struct("lag", "rho", "n"))))
    every = F.transform(F.sequence(F.lit(-P.LAGS), F.lit(P.LAGS)), lambda k: F.coalesce(F.try_element_at(seen, k), F.struct(k.alias("lag"), F.lit(None).cast("double").alias("rho"), F.lit(0).cast("bigint").alias("n"))))
    profile = lags.groupBy("pair_id").agg(every.alias("lag_profile"))
    out = pairs.join(rho.withColumnRenamed("r", "rho"), "pair_id", "left")
    for part in (ties, a, b, span, permuted, coverage_selection(long), profile):
        out = out.join(part, "pair_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    enough = n >= P.MIN_PAIRS
    rho_ = F.when(enough, F.col("rho"))
    neff = F.coalesce(S.effective_n(n, F.col("r1x"), F.col("r1y")), n.cast("double"))
    heavy = F.coalesce("heavy", F.lit(False))
    out = out.withColumns({"n": n, "rho": rho_, "lag_profile": F.when(enough, F.col("lag_profile")), "n_eff": F.when(enough, neff).otherwise(n.cast("double"))})
    out = out.withColumn("p_value", F.when(enough & heavy, F.col("_perm")).when(enough, I.correlation_p("rho", (F.col("n") - 2).cast("double"))))
    out = out.withColumn("p_value_adj", F.when(enough, I.correlation_p("rho", F.col("n_eff") - 2)))
    method = F.when(~enough, "none").when(heavy, "permutation").otherwise("t")
    return out.withColumns({"p_method": method, "effect": F.when(enough, effect_band("rho")).otherwise("insufficient-n")}).drop("_perm", "heavy")


def flagged(results: DataFrame) -> DataFrame:
    """Warnings: neighbouring nights that hang together, selection by coverage, a strong wrong sign, attenuation."""
    sign = F.when(F.col("rho") < 0, "-").otherwise("+")
    selection = (F.col("selection_p") < P.BH_Q) & (F.col("dropped_ahi") > F.col("kept_ahi"))
    wrong = ~F.col("two_sided") & (F.abs("rho") >= WRONG_SIGN_RHO) & (F.col("p_value_adj") < P.BH_Q) & F.col("sign").isin("+", "-") & (F.col("sign") != sign)
    lost = ratio(F.col("n_dropped"), F.col("n_kept") + F.col("n_dropped"))
    weak = (F.col("family") == "primary") & (F.coalesce(selection, F.lit(False)) | F.coalesce(lost > ATTENUATION, F.lit(False)) | F.coalesce(F.col("not_inferred") > NOT_INFERRED, F.lit(False)))
    tested = F.col("p_method") != "none"
    flags = {"serial-correlation": F.greatest("r1x", "r1y") > SERIAL, "coverage-selection": selection, "gross-wrong-sign": wrong, "attenuation-risk": weak}
    return results.withColumn("flags", F.array_compact(F.array(*[F.when(tested & F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()])))


def group_contrasts(nights: DataFrame) -> DataFrame:
    """HRV of high-AHI against low-AHI nights; readiness of nights with four hours of use against the rest."""
    parts = []
    if _has(nights, "hrv.rmssd_ms"):
        side = F.when(F.col("ahi") >= HIGH_AHI, True).when(F.col("ahi") < LOW_AHI, False)
        parts.append(nights.select(F.lit("hrv-by-ahi").alias("contrast"), finite("hrv.rmssd_ms").alias("v"), side.alias("g")))
    if _has(nights, "readiness_score"):
        parts.append(nights.select(F.lit("readiness-by-use").alias("contrast"), finite("readiness_score").alias("v"), (F.col("usage_hours") >= P.USAGE_HOURS).alias("g")))
    if not parts:
        parts = [nights.sparkSession.createDataFrame([], "contrast string, v double, g boolean")]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return I.mann_whitney(long, "v", F.col("g"), ["contrast"], spread=False).withColumn("family", F.lit("primary"))


def pair_matrix(results: DataFrame) -> DataFrame:
    """``x, y, rho, p`` of every pair in both orders, and of every measure with itself (1 and 0)."""
    one = results.select("x", "y", "rho", F.col("p_value_adj").alias("p"))
    axes = one.select("x").union(one.select("y")).distinct().select("x", F.col("x").alias("y"), F.lit(1.0).alias("rho"), F.lit(0.0).alias("p"))
    return one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"), "rho", "p")).unionByName(axes)


def run_engine(nights: DataFrame, pairs: tuple[Pair, ...] = PAIRS, rounds: int = P.PERMUTATIONS) -> dict[str, DataFrame]:
    """``pairs``, ``group_tests`` and ``summary``. The tests of each family are corrected together, pairs by their p at the
    effective number of nights; under seven nights nothing is reported as surviving. ``long`` is the table that every
    statistic reads; it is persisted, and ``long.unpersist()`` releases it when the results have been used, as are the few rows
    of tests."""
    spark = nights.sparkSession
    long = pairs_long(nights, pairs).persist()
    tested = flagged(run_pairs(long, registry(spark, pairs), rounds)).persist()  # a row for each pair
    groups = group_contrasts(nights).persist()  # a row for each contrast
    family = tested.select(F.concat(F.lit("pair-"), F.col("pair_id").cast("string")).alias("test"), "family", F.col("p_value_adj").alias("p"))
    family = family.unionByName(groups.select(F.col("contrast").alias("test"), "family", "p"))
    primary = I.benjamini_hochberg(family.filter("family = 'primary'"), "p", "test", ["family"], P.BH_Q, spread=False)
    other = I.benjamini_hochberg(family.filter("family <> 'primary'"), "p", "test", ["family"], Q_EXPLORATORY, spread=False)
    corrected = primary.unionByName(other)
    few = nights.agg(F.count(F.lit(1)).alias("nights"))
    enough = few.select("nights", (F.col("nights") >= P.MIN_NIGHTS).alias("_enough"))
    corrected = corrected.join(F.broadcast(enough.select("_enough"))).withColumn("survives", F.col("survives") & F.col("_enough")).drop("_enough")
    pairs_out = tested.join(corrected.select("test", "q_value", "survives"), F.concat(F.lit("pair-"), F.col("pair_id").cast("string")) == F.col("test"), "left").drop("test")
    groups_out = groups.join(corrected.select(F.col("test").alias("contrast"), "q_value", "survives"), "contrast", "left")
    sizes = corrected.groupBy("family").agg(F.count("p").alias("tests"), F.count(F.when(F.col("survives"), 1)).alias("surviving"))
    warning = F.when(~F.col("_enough"), F.lit("insufficient-nights"))
    return {"long": long, "pairs": pairs_out, "group_tests": groups_out, "summary": sizes.join(F.broadcast(enough)).select("family", "tests", "surviving", "nights", warning.alias("warning"))}
