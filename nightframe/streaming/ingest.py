"""An export folder that grows, read as a stream of files: each file once, into a store of its metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nightframe.sources import export_tree, store
from nightframe.sources import parsers as R
from nightframe.sources.files import children, exists, hadoop_path

#: Metrics that come as series, and where their time stands.
SERIES = {"spo2_minute": "utc_min", "hrv_details": "local_min", "snore": "local_min", "heart_rate": "local_min"}

#: Metrics of which a date has several rows that are added up.
SUMS = {"azm": "azm_minutes", "steps": "steps", "active_minutes": "active_minutes"}


def keyed(metric: str, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with their ``night``, and the columns that tell them apart."""
    if metric in SUMS:
        return rows.groupBy("night", "file").agg(F.sum(SUMS[metric]).alias(SUMS[metric])), ["night", "file"]
    if metric in SERIES:
        return rows.withColumn("night", F.to_date(F.timestamp_seconds(F.col(SERIES[metric]) * 60))), [SERIES[metric]]
    if metric == "sleep":
        return rows.withColumn("night", F.col("date_of_sleep")), ["log_id"]
    if metric == "sleep_score":
        return rows.withColumn("night", F.lit(None).cast("date")), ["log_id"]
    return rows, ["night"]


def ingest_stream(spark: SparkSession, root: str, out: str, checkpoint: str, opt_in: bool = False, files_at_once: int = 500) -> StreamingQuery:
    """Reads all files under ``root`` that no run with this ``checkpoint`` has read, and ends; the next run reads new ones.

    What a reader keeps is put into the store ``out``/(metric) by key, rows of later files replacing earlier ones; how many
    rows of a file were malformed goes to ``out``/malformed. Files are told by their paths: a file that is written again under
    its old name is not read again. Denied and unknown files are never opened. A run that is broken off repeats its last
    batch of at most ``files_at_once`` files, which gives the same rows.
    """
    plain = lambda path: hadoop_path(spark, path)[0].toUri().getPath().rstrip("/")
    top = plain(root)
    # only the names are read here, not what is in the files
    named = "path string, modificationTime timestamp, length bigint, content binary"
    listing = spark.readStream.schema(named).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(root).select("path")

    def take(batch: DataFrame, number: int) -> None:
        by_metric: dict[str, list[str]] = {}
        for row in batch.collect():  # at most ``files_at_once`` names
            relative = plain(row["path"]).removeprefix(f"{top}/")
            if export_tree.classify(relative, opt_in) == "allowed":
                by_metric.setdefault(export_tree.describe(relative).metric, []).append(row["path"])
        session = batch.sparkSession
        for metric, paths in sorted(by_metric.items()):
            rows = R.PARSERS[metric](session, sorted(paths)).persist()
            good, key = keyed(metric, R.kept(rows))
            store.upsert(session, f"{out}/{metric}", good, key, order=["file", *[c for c in sorted(good.columns) if c not in (*key, "file")]])
            R.malformed(rows).write.mode("overwrite").parquet(f"{out}/malformed/metric={metric}/batch={number}")
            rows.unpersist()

    query = listing.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def malformed_files(spark: SparkSession, out: str) -> DataFrame:
    """``metric, file, malformed, rows`` of all files that have been read."""
    folder = f"{out}/malformed"
    if not exists(spark, folder):
        return spark.createDataFrame([], "metric string, file string, malformed bigint, rows bigint")
    return spark.read.schema("file string, malformed bigint, rows bigint, metric string, batch bigint").parquet(folder).select("metric", "file", "malformed", "rows")


def marks(spark: SparkSession, out: str) -> DataFrame:
    """``metric, high_water``: the last night of each metric that has nights."""
    held = [n for n, _, is_folder, _ in children(spark, out) if is_folder and n in R.PARSERS]
    found = spark.createDataFrame([], "metric string, high_water date")
    for metric in held:
        found = found.unionByName(store.high_water(store.read_store(spark, f"{out}/{metric}").select(F.lit(metric).alias("metric"), "night")))
    return found.filter("high_water is not null")


def nightly_sums(spark: SparkSession, out: str, metric: str) -> DataFrame:
    """The sum of each date over all files."""
    return R.summed(store.read_store(spark, f"{out}/{metric}").withColumn("ok", F.lit(True)), SUMS[metric])
