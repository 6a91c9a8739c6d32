"""What stands behind a path, on any file system that Spark can read, and CSV files with headers of their own."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> Iterator[tuple[str, str, bool, int]]:
    """``name, path, is folder, size`` of what a folder holds, by name."""
    p, fs = hadoop_path(spark, folder)
    found = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p)]
    return iter(sorted(found))


def remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = hadoop_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claim(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file in one step; False, and nothing is done, if there is a file of the new name already."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(a, b, none)
    except Py4JJavaError as failed:
        if "FileAlreadyExists" in str(failed.java_exception):
            return False
        raise
    return True


def files_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files that a path, a pattern or a folder names; a list is taken as it is. Only names are read."""
    if isinstance(path, list):
        return path
    p, fs = hadoop_path(spark, path)
    if fs.exists(p) and not fs.getFileStatus(p).isDirectory():
        return [path]
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, compressed or not; None for an empty one."""
    p, fs = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(p)
        source = codec.createInputStream(stream) if codec is not None else stream
        return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(source, "UTF-8")).readLine()
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str | list[str], typed: bool = False) -> DataFrame:
    """CSV files by the names in their headers, with the file of each row in ``_file``.

    Files of one header are read together, those of different headers apart, and joined by name: columns that a file lacks
    are null. All columns are text unless ``typed``. Malformed lines fill what they can; files are split and read in
    parallel. Empty files give no rows; without any file there are no columns but ``_file``.
    """
    from pyspark.sql import functions as F

    files = files_of(spark, path)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: first_line(spark, f), files)) if len(files) > 1 else [""] * len(files)
    groups: dict[str, list[str]] = {}
    for file, header in zip(files, headers, strict=True):
        if header is not None:
            groups.setdefault(header, []).append(file)
    read = lambda own: spark.read.csv(own, header=True, mode="PERMISSIVE", quote='"', escape='"', inferSchema=typed).select("*", F.col("_metadata.file_path").alias("_file"))
    parts = [read(own) for own in groups.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], "_file string")
