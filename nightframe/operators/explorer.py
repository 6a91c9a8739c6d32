"""The raw-data explorer: filters, search, sort, export of any table, and how its columns are found."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nightframe import params as P
from nightframe.functions.exprs import finite

NUMERIC = re.compile(r"int|bigint|smallint|tinyint|double|float|decimal.*")


def find_column(df: DataFrame, pattern: str) -> str | None:
    """The first column whose name matches, without regard to case."""
    return next((c for c in df.columns if re.search(pattern, c, re.IGNORECASE)), None)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if NUMERIC.fullmatch(k)]


def any_date(c: Column | str) -> Column:
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10)), F.to_date(F.try_to_timestamp(text, F.lit("M/d/y"))))


def date_filter(df: DataFrame, day: str, start: str | None, end: str | None, keep_undated: bool = True) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; rows without a date stay unless ``keep_undated`` is off."""
    d = any_date(day)
    ok = F.lit(True)
    if start:
        ok &= d >= F.lit(start).cast("date")
    if end:
        ok &= d <= F.lit(end).cast("date")
    return df.filter(F.coalesce(ok, F.lit(keep_undated)) if keep_undated else F.coalesce(ok & d.isNotNull(), F.lit(False)))


def last_days(df: DataFrame, day: str, days: int) -> DataFrame:
    """The last ``days`` calendar days up to the latest date in the table."""
    latest = df.agg(F.max(F.to_date(day)).alias("_end"))
    return df.join(F.broadcast(latest)).filter(F.to_date(day).between(F.date_sub("_end", days - 1), F.col("_end"))).drop("_end")


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with ``text`` in any of the columns, without regard to case; null never matches."""
    hit = F.lit(False)
    for c in columns or df.columns:
        hit |= F.coalesce(F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(text.lower())), F.lit(False))
    return df.filter(hit)


def sort_rows(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Missing values last in either direction."""
    c = F.col(f"`{column}`")
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())


def page(df: DataFrame, order: list[str], offset: int, rows: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(rows)


def select_rows(df: DataFrame, order: list, positions: list[int]) -> DataFrame:
    """The rows at ``positions`` (from 0) of the table in the given order, in that order; all rows if none is chosen, as what
    is exported without a selection is everything. Only rows up to the last position are numbered."""
    if not positions:
        return df.orderBy(*order)
    upto = df.orderBy(*order).limit(max(positions) + 1)
    numbered = upto.withColumn("_at", F.row_number().over(W.orderBy(*order)) - 1)
    return numbered.filter(F.col("_at").isin(sorted(set(positions)))).orderBy("_at").drop("_at")


def validate_epap(df: DataFrame, epap: str) -> DataFrame:
    """Values untouched, and whether each lies outside what devices give."""
    x = finite(epap)
    return df.withColumn("epap_suspicious", F.coalesce(~x.between(*P.EPAP_RANGE), F.lit(False)))


def csv_cell(c: Column, kind: str) -> Column:
    """A cell as RFC 4180 text: quoted where it holds a comma, a quote or a line break; dates in ISO form."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kind.startswith("timestamp") else c.cast("string")
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`"), kinds[c]) for c in columns or df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
