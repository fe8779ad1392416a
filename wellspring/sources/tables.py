"""Parquet tables, intermediate tables in the shared folder, Spark session settings."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def use_utc(spark: SparkSession) -> SparkSession:
    """Zone-less and zoned timestamps convert one to one only in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; the current version where ``path`` has versions."""
    version = current_version(spark, path)
    if version is not None:
        path = f"{path}/{version[0]}"
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite ``path``. The silver table is written with ``partition_by=("year", "month")``.

    Rows are first dealt out by the partition columns and the station, so that a task opens a
    few files instead of one for every month.
    """
    if partition_by:
        df = df.repartition(*partition_by, *[c for c in df.columns if c == "station_id"])
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose tasks run in
    the driver's process, gets a temporary one; a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or "cluster" in context.master:
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="wellspring-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_name(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later steps prune columns and rows at the scan, know the size, and survive lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_key(source: DataFrame) -> tuple[str, int]:
    """A name for the files that ``source`` reads and for this code, and the bytes of the files.

    Paths, sizes and times of the files come from the scan's own metadata, summed up by the tasks;
    no column is read.
    """
    file = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    listing = source.select(F.xxhash64(*file).alias("h"), file[1].alias("size")).distinct()
    count, total, size = listing.agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.sum("size")).first()
    return hashlib.sha256(f"{code_version()} {count} {total}".encode()).hexdigest()[:24], size or 0


#: Input bytes that a bucket of a layer and a shuffle partition stand for, if there are enough of them:
#: about fifty thousand readings, whose hours are some 100 MB with all columns.
BUCKET_BYTES = 1 << 20
#: Bytes of a shuffle that one task gets. Readings shrink much on the way and grow to hundreds of columns after.
ADVISED_BYTES = 4 << 20


def bucket_count(spark: SparkSession, size: int) -> int:
    """One bucket a core, up to the session's shuffle partitions; more for large inputs."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, spark.sparkContext.defaultParallelism), size // BUCKET_BYTES)


def spread(spark: SparkSession, path: str) -> SparkSession:
    """Shuffle partitions in proportion to the bytes at ``path``, so that a task's share stays the same.

    Settings that are finer already stay.
    """
    files, where = _file_system(spark, path)
    partitions, advised = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    needed = files.getContentSummary(where).getLength() // BUCKET_BYTES
    if needed > int(spark.conf.get(partitions)):
        spark.conf.set(partitions, str(needed))
    # Else small shuffles would be put together again, to 64 MB a task.
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if needed > spark.sparkContext.defaultParallelism and bytes_of(spark.conf.get(advised)) > ADVISED_BYTES:
        spark.conf.set(advised, str(ADVISED_BYTES))
    return spark


@contextlib.contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """Rows that lie by a part of the join's keys stay there; the other side comes to them.

    For hours in buckets by station, joined by station and hour: else both sides are shuffled.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@functools.cache
def code_version() -> str:
    """Hash of the package's sources: changed code makes new layers."""
    package = Path(__file__).resolve().parent.parent
    content = hashlib.sha256()
    for path in sorted(package.rglob("*.py")):
        content.update(f"{path.relative_to(package)}\n".encode() + path.read_bytes())
    return content.hexdigest()


def layer_path(name: str, source: DataFrame) -> str:
    return f"{shared_folder(source.sparkSession)}/{name}-{content_key(source)[0]}"


def stored_once(
    name: str,
    source: DataFrame,
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
    bucket_by: tuple[str, str] | None = None,
) -> DataFrame:
    """A layer built from ``source``, written when first asked for; in buckets by key and order.

    Its name holds the input's file listing and the code's version: other files or changed code
    make a new table. It is put in place whole, whoever else builds it at the same time.
    """
    spark = source.sparkSession
    key, size = content_key(source)
    path = f"{shared_folder(spark)}/{name}-{key}"
    if bucket_by:
        if current_version(spark, path) is None:
            write_buckets(build(), path, *bucket_by, partition_by, bucket_count(spark, size))
        return read_buckets(spark, path)
    if current_version(spark, path) is None:
        write_version(build(), path, partition_by=partition_by)
    return read_version(spark, path)[0]


POINTER = "current"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _pointed(spark: SparkSession, path: str) -> str | None:
    """What the pointer file of ``path`` says; None where there is none."""
    files, pointer = _file_system(spark, f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text.rstrip("\n")


def _point(spark: SparkSession, path: str, text: str) -> None:
    """Put a pointer file in place by one rename: readers see the old text or the new one."""
    files, draft = _file_system(spark, f"{path}/{POINTER}-{uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(f"{text}\n".encode()))
    out.close()
    _, pointer = _file_system(spark, f"{path}/{POINTER}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    replace = spark.sparkContext._gateway.new_array(options, 1)
    replace[0] = options.OVERWRITE
    context.rename(files.makeQualified(draft), files.makeQualified(pointer), replace)


def current_version(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """Folder and label of the version that readers of ``path`` are to see."""
    text = _pointed(spark, path)
    return None if text is None else tuple(text.split(" ", 1))


def write_version(df: DataFrame, path: str, label: str = "", partition_by: tuple[str, ...] = ()) -> None:
    """Replace the table at ``path`` in one step.

    The files go to a folder of their own; then a pointer file is put in place by one rename, and
    the version that it named before is kept, older ones deleted. A writer that dies before the
    rename leaves what readers see as it was; of two writers the later rename wins, whole.
    """
    spark = df.sparkSession
    files, root = _file_system(spark, path)
    before = current_version(spark, path)
    folder = f"v{uuid4().hex}"
    write_table(df, f"{path}/{folder}", partition_by)
    _point(spark, path, f"{folder} {label}")
    for status in files.listStatus(root) if before else ():
        name = status.getPath().getName()
        # Another writer's folder, newer than the version before, may still be in the making.
        old = status.getModificationTime() < _time_of(files, root, before[0])
        if status.isDirectory() and old and name not in (folder, before[0]):
            files.delete(status.getPath(), True)


def _time_of(files, root, name: str) -> int:
    for status in files.listStatus(root):
        if status.getPath().getName() == name:
            return status.getModificationTime()
    return 0


def read_version(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The table that ``write_version`` put at ``path`` last, and its label."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version of a table at {path}")
    return spark.read.parquet(f"{path}/{version[0]}"), version[1]


# --- tables in buckets ------------------------------------------------------------------


def write_buckets(df: DataFrame, path: str, key: str, order: str, partition_by: tuple[str, ...] = (), buckets: int | None = None) -> None:
    """``write_version`` of a table in buckets by ``key``: what groups by it needs no shuffle.

    Within a folder of ``partition_by`` each bucket is one file, sorted by ``order``.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"v{uuid4().hex}"
    columns = [c for c in df.columns if c not in partition_by] + list(partition_by)
    layout = {
        "columns": [[c, df.schema[c].dataType.simpleString()] for c in columns],
        "key": key,
        "order": order,
        "partition_by": list(partition_by),
        "buckets": buckets,
    }
    dealt = df.select(*columns).repartition(buckets, key)
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, order)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("path", f"{path}/{folder}").saveAsTable(_table_name(f"{path}/{folder}"))
    _point(spark, path, f"{folder} {json.dumps(layout)}")


def _table_name(path: str) -> str:
    return f"layer_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_buckets`` put at ``path`` last; Spark knows its buckets.

    A session that didn't write it declares it from the layout that the pointer file holds.
    """
    folder, text = current_version(spark, path)
    name, at, layout = _table_name(f"{path}/{folder}"), f"{path}/{folder}", json.loads(text)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{c}` {kind}" for c, kind in layout["columns"])
        parts = f"PARTITIONED BY ({', '.join(layout['partition_by'])})" if layout["partition_by"] else ""
        spark.sql(
            f"""CREATE TABLE {name} ({columns}) USING parquet {parts}
            CLUSTERED BY ({layout['key']}) SORTED BY ({layout['key']}, {layout['order']}) INTO {layout['buckets']} BUCKETS
            LOCATION '{at}'"""
        )
        if parts:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


# --- tables in parts by key -------------------------------------------------------------

PART = "part"


def part_of(key: str, parts: int):
    """The part that a key's rows are in, a column."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def write_parts(df: DataFrame, path: str, key: str, parts: int = 256) -> None:
    """Replace the table at ``path`` by ``df`` in parts by hash of ``key``, in one step."""
    folder = f"v{uuid4().hex}"
    _write_parts(df, f"{path}/{folder}", key, parts)
    _point(df.sparkSession, path, json.dumps({"key": key, "parts": parts, "folders": {str(i): folder for i in range(parts)}}))


def _write_parts(df: DataFrame, path: str, key: str, parts: int) -> None:
    rows = df.withColumn(PART, part_of(key, parts))
    rows.repartition(PART).write.partitionBy(PART).parquet(path)


def _manifest(spark: SparkSession, path: str) -> dict:
    text = _pointed(spark, path)
    if text is None:
        raise FileNotFoundError(f"no table in parts at {path}")
    return json.loads(text)


def touched_parts(changed: DataFrame, path: str) -> list[int]:
    """The parts that the keys of ``changed`` are in; no more numbers than parts."""
    manifest = _manifest(changed.sparkSession, path)
    found = changed.select(part_of(manifest["key"], manifest["parts"]).alias(PART)).distinct().collect()
    return sorted(r[0] for r in found)


def in_parts(rows: DataFrame, path: str, parts: list[int]) -> DataFrame:
    """The rows whose keys are in these parts of the table at ``path``."""
    manifest = _manifest(rows.sparkSession, path)
    return rows.where(part_of(manifest["key"], manifest["parts"]).isin(parts))


def replace_parts(df: DataFrame, path: str, parts: list[int]) -> None:
    """Replace these parts by ``df``, which has all of their rows; the others stay as files.

    New files go to a folder of their own, then the list of folders is put in place by one rename.
    Files that the new list doesn't name stay until ``clean_parts``, for readers on their way.
    """
    spark = df.sparkSession
    manifest = _manifest(spark, path)
    folder = f"v{uuid4().hex}"
    _write_parts(df, f"{path}/{folder}", manifest["key"], manifest["parts"])
    manifest["folders"] |= {str(p): folder for p in parts}
    _point(spark, path, json.dumps(manifest))


def _part_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of the current parts that have rows."""
    files, _ = _file_system(spark, path)
    folders = _manifest(spark, path)["folders"]
    there = {}
    for folder in set(folders.values()):
        _, at = _file_system(spark, f"{path}/{folder}")
        there[folder] = {s.getPath().getName() for s in files.listStatus(at)}
    return [f"{path}/{f}/{PART}={p}" for p, f in folders.items() if f"{PART}={p}" in there[f]]


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folders = _part_folders(spark, path)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def clean_parts(spark: SparkSession, path: str) -> None:
    """Delete the files of parts that were replaced. No reader of an older list may be running."""
    files, root = _file_system(spark, path)
    kept = set(_part_folders(spark, path))
    used = set(_manifest(spark, path)["folders"].values())
    for status in files.listStatus(root):
        folder = status.getPath().getName()
        if not status.isDirectory():
            continue
        if folder not in used:
            files.delete(status.getPath(), True)
            continue
        for part in files.listStatus(status.getPath()):
            name = part.getPath().getName()
            if name.startswith(f"{PART}=") and f"{path}/{folder}/{name}" not in kept:
                files.delete(part.getPath(), True)
