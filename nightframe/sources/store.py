"""The keyed store: nights and intraday series as Parquet by month, and what has been read already.

A store is a folder of versions, each with the months that one upsert wrote, and of numbered states. A state is a small JSON
file that says which version each month is read from. It appears under its number by one rename, which fails if that number
is taken, so readers see all of an upsert or nothing of it, and of two writers at a time the later one merges again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from nightframe.sources.files import children, claim, exists, read_text, remove, write_text


def last_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    newest = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(newest)).filter("_k = 1").drop("_k")


def merge_activity(steps: DataFrame, azm: DataFrame) -> DataFrame:
    return steps.join(azm, "night", "full_outer")


def month_of(night: str) -> Column:
    return F.date_format(night, "yyyy-MM")


def _states(spark: SparkSession, path: str) -> list[int]:
    folder = f"{path}/states"
    names = [n for n, _, is_folder, _ in children(spark, folder) if not is_folder] if exists(spark, folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def _state(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict[str, str], StructType | None]:
    """The number of the newest state (0 if there is none), the version of each month, and the columns."""
    known = _states(spark, path) if number is None else [number]
    if not known:
        return 0, {}, None
    held = json.loads(read_text(spark, f"{path}/states/{known[-1]:012d}.json"))
    return known[-1], held["months"], StructType.fromJson(held["columns"])


def _read(spark: SparkSession, path: str, months: dict[str, str], columns: StructType) -> DataFrame:
    """The rows of months, with the column ``month``; columns that a month was written without are null."""
    folders = [f"{path}/version={v}/month={m}" for m, v in sorted(months.items())]
    schema = StructType([*columns.fields, StructField("version", StringType()), StructField("month", StringType())])
    if not folders:
        return spark.createDataFrame([], schema).drop("version")
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).drop("version")


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], night: str = "night", order: list[str] | None = None) -> None:
    """Writes rows by key: new ones replace old ones, all at once. Only the months that ``rows`` touches are read and written
    again; rows without a night make up a month of their own.

    Of rows that repeat a key the last one in ``order`` counts (the values of all other columns, if none is named). A run that
    is broken off leaves the store as it was, and folders that ``tidy`` removes.
    """
    path = path.rstrip("/")
    rest = order or [c for c in sorted(rows.columns) if c not in key]
    fresh = last_writer(rows, key, rest) if rest else rows.dropDuplicates(key)
    fresh = fresh.withColumn("month", F.coalesce(month_of(night), F.lit("none")))
    while True:
        version = uuid.uuid4().hex
        number, months, columns = _state(spark, path)
        names = {f.name for f in columns.fields} if columns else set()
        touched = [r[0] for r in fresh.select("month").distinct().collect()]
        merged = fresh
        if old := {m: months[m] for m in touched if m in months}:
            same = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key])
            kept = _read(spark, path, old, columns).alias("old").join(fresh.select(*key).alias("new"), same, "left_anti")
            merged = kept.unionByName(fresh, allowMissingColumns=True)
        merged.write.partitionBy("month").parquet(f"{path}/version={version}")
        fields = [*(columns.fields if columns else []), *[f for f in rows.schema.fields if f.name not in names]]
        state = {"months": months | dict.fromkeys(touched, version), "columns": json.loads(StructType([StructField(f.name, f.dataType) for f in fields]).json())}
        if _commit(spark, path, number + 1, state):
            return
        remove(spark, f"{path}/version={version}")


def _commit(spark: SparkSession, path: str, number: int, state: dict) -> bool:
    """Makes a state the newest one; False if another writer was first."""
    draft = f"{path}/states/.{uuid.uuid4().hex}"
    write_text(spark, draft, json.dumps(state))
    if claim(spark, draft, f"{path}/states/{number:012d}.json"):
        return True
    remove(spark, draft)
    return False


def tidy(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes all states but the newest ``keep``, and what none of those reads, as when no reader and no writer is at work."""
    path = path.rstrip("/")
    known = _states(spark, path)
    if not known:
        return
    for number in known[:-keep]:
        remove(spark, f"{path}/states/{number:012d}.json")
    used = {v for n in known[-keep:] for v in _state(spark, path, n)[1].values()}
    for name, folder, _, _ in [*children(spark, path)]:
        if name.startswith("version=") and name.removeprefix("version=") not in used:
            remove(spark, folder)


def read_store(spark: SparkSession, path: str, months: tuple[str, str] | None = None) -> DataFrame:
    """All rows as the newest state has them, or those of an inclusive range of months; other months are not listed."""
    path = path.rstrip("/")
    _, held, columns = _state(spark, path)
    if columns is None:
        raise FileNotFoundError(f"no store at {path}")
    return _read(spark, path, {m: v for m, v in held.items() if not months or months[0] <= m <= months[1]}, columns)


def set_meta(spark: SparkSession, path: str, key: str, value: str) -> None:
    """One value beside the store, by key; replaces what the key had."""
    spark.createDataFrame([(key, value)], "key string, value string").coalesce(1).write.mode("overwrite").json(_meta(path, key))


def get_meta(spark: SparkSession, path: str, key: str) -> str | None:
    if not exists(spark, _meta(path, key)):
        return None
    return spark.read.schema("key string, value string").json(_meta(path, key)).first()["value"]


def _meta(path: str, key: str) -> str:
    return f"{path.rstrip('/')}-meta/{hashlib.sha256(key.encode()).hexdigest()[:32]}"


def clear_all(spark: SparkSession, *paths: str) -> None:
    """Forgets stores: their rows and their metadata."""
    for path in paths:
        remove(spark, path)
        remove(spark, f"{path.rstrip('/')}-meta")


def nights_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Nights of an inclusive range; the months outside it are not read."""
    table = read_store(spark, path, (start[:7], end[:7]))
    return table.filter(F.col("night").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).drop("month")


def intraday(spark: SparkSession, path: str, night: str, metric: str) -> DataFrame:
    return nights_between(spark, path, night, night).filter(F.col("metric") == metric)


def unread(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path and size the manifest doesn't have."""
    return files.join(manifest.select("relative", "size"), ["relative", "size"], "left_anti")


def high_water(nights: DataFrame, metric: str = "metric", night: str = "night") -> DataFrame:
    return nights.groupBy(metric).agg(F.max(night).alias("high_water"))


def lowest_mark(marks: DataFrame) -> DataFrame:
    """From where a run has to go on so that no metric has a gap: the lowest of the marks."""
    return marks.agg(F.min("high_water").alias("high_water"))


def ingest_totals(series: DataFrame, malformed: DataFrame, metric: str = "metric", night: str = "night") -> DataFrame:
    """For each metric its first and last night, how many rows it has and how many of its rows were malformed."""
    ranges = series.groupBy(metric).agg(F.min(night).alias("first_night"), F.max(night).alias("last_night"), F.count(F.lit(1)).alias("rows_kept"))
    bad = malformed.groupBy(metric).agg(F.sum("malformed").alias("malformed"))
    return ranges.join(bad, metric, "full_outer").withColumns({"rows_kept": F.coalesce("rows_kept", F.lit(0)), "malformed": F.coalesce("malformed", F.lit(0))})


def since(rows: DataFrame, mark: str | None, night: str = "night") -> DataFrame:
    return rows if mark is None else rows.filter(F.col(night) > F.lit(mark).cast("date"))


def save_session(spark: SparkSession, path: str, summary: DataFrame, details: DataFrame, settings: dict[str, str]) -> None:
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    details.write.mode("overwrite").parquet(f"{path}/details")
    spark.createDataFrame([(k, v) for k, v in sorted(settings.items())] or [("", "")], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load_session(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    settings = spark.read.schema("name string, value string").json(f"{path}/settings").collect()
    return spark.read.parquet(f"{path}/summary"), spark.read.parquet(f"{path}/details"), {r["name"]: r["value"] for r in settings if r["name"]}


# --- protected export ----------------------------------------------------------------------------------------------

ROUNDS, SALT = 100_000, 16
# The length a passphrase needs, lengths that count, and how many points make it moderate and strong.
LEAST, COUNTED, MODERATE, STRONG = 8, (12, 16), 3, 5


def passphrase_strength(passphrase: str) -> tuple[bool, str, list[str]]:
    """Whether a passphrase may be used, how strong it is (weak, moderate, strong), and what would make it stronger. Lengths
    and kinds of characters give a point each."""
    if len(passphrase) < LEAST:
        return False, "weak", [f"at least {LEAST} characters"]
    kinds = {
        "lower-case letters": any(c.isascii() and c.islower() for c in passphrase), "upper-case letters": any(c.isascii() and c.isupper() for c in passphrase),
        "digits": any(c.isascii() and c.isdigit() for c in passphrase), "symbols": any(not (c.isascii() and c.isalnum()) for c in passphrase),
    }
    points = sum(kinds.values()) + sum(len(passphrase) >= n for n in COUNTED)
    strength = "strong" if points >= STRONG else "moderate" if points >= MODERATE else "weak"
    advice = [f"{COUNTED[0]} or more characters"] if len(passphrase) < COUNTED[0] else []
    return True, strength, advice + [name for name, there in kinds.items() if not there and name != "lower-case letters"]


def _key(passphrase: str, salt: bytes) -> Column:
    return F.unbase64(F.lit(base64.b64encode(hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ROUNDS, 32)).decode()))


def encrypt_rows(df: DataFrame, passphrase: str, salt: bytes | None = None) -> DataFrame:
    """Each row as JSON under AES-256-GCM with a key from the passphrase; ``salt`` goes along, the nonce is inside."""
    salt = salt or os.urandom(SALT)
    body = F.base64(F.aes_encrypt(F.to_json(F.struct(*df.columns)), _key(passphrase, salt), F.lit("GCM")))
    return df.select(F.lit(base64.b64encode(salt).decode()).alias("salt"), body.alias("payload"))


def decrypt_rows(df: DataFrame, passphrase: str, schema: str) -> DataFrame:
    """The rows back; fails on a wrong passphrase or a changed payload."""
    first = df.select("salt").limit(1).collect()
    if not first:
        return df.sparkSession.createDataFrame([], schema)
    key = _key(passphrase, base64.b64decode(first[0]["salt"]))
    text = F.aes_decrypt(F.unbase64("payload"), key, F.lit("GCM")).cast("string")
    return df.select(F.from_json(text, schema).alias("r")).select("r.*")
