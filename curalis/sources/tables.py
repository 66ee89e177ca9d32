"""Readers and writers of manifests, listings, predictions, reports and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of image files.
SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
# The order of splits in manifests.
SPLIT_ORDER = {"train": 0, "val": 1, "val_id": 2, "val_dg": 3, "test": 4}


def read_manifest(spark: SparkSession, path: str, schema: str, split: str, required: list[str]) -> DataFrame:
    """JSON lines of one split; blank lines are skipped, missing required values or no rows at all are errors."""
    rows = spark.read.schema(schema).json(path).where(F.coalesce(*[F.col(c).isNotNull() for c in ("split",)]) & (F.col("split") == split))
    bad, n = rows.agg(F.count_if(F.lit(False) if not required else F.greatest(*[F.col(c).isNull().cast("int") for c in required], F.lit(0)) == 1), F.count("*")).first()
    if not n:
        raise ValueError(f"{path} has no rows of split {split}")
    if bad:
        raise ValueError(f"{bad} rows of {path} lack one of {required}")
    return rows


def read_metadata_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with header, all columns text; a byte-order mark before the first name is dropped, missing columns are errors."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks {missing}")
    return df


def payload(c: Column, kind: str) -> Column:
    """Bytes of a payload column: binary itself, or the field ``bytes`` of a struct; null fails the job."""
    found = c["bytes"] if kind.startswith("struct") else c.cast("binary")
    return F.coalesce(found, F.raise_error(F.lit("payload missing")).cast("binary"))


def has_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*SUFFIXES)


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Image files of a folder by lower-case path: path, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    return files.where(has_suffix(F.col("path"))).orderBy(F.lower("path"))


def suspicious(df: DataFrame, size: str, packed: str, least: int = 1024, ratio: float = 0.02) -> DataFrame:
    """Listing rows of a useful size that pack too well."""
    return df.where((F.col(size) >= least) & (F.col(packed) / F.col(size) < ratio))


def sorted_manifest(df: DataFrame) -> DataFrame:
    """Rows by split, label, source and id."""
    order = F.create_map(*[F.lit(x) for kv in SPLIT_ORDER.items() for x in kv])
    return df.orderBy(F.coalesce(F.element_at(order, F.col("split")), F.lit(99)), "label", "source", "id")


def write_features(df: DataFrame, path: str, rows: int = 2048) -> None:
    df.write.partitionBy("split", "variant").option("maxRecordsPerFile", rows).parquet(path)


def merge_features(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """All row-range files of a feature table; a key twice in one split and variant, or missing from a variant of its split, is an error."""
    rows = spark.read.schema(schema).parquet(path)
    repeated = rows.groupBy("split", "variant", key).count().where("count > 1")
    counts = rows.groupBy("split", "variant").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key)).alias("ids"))
    uneven = counts.groupBy("split").agg(F.count_distinct("n", "ids").alias("kinds")).where("kinds > 1")
    if repeated.limit(1).count() or uneven.limit(1).count():
        raise ValueError(f"{path}: repeated or missing keys")
    return rows


def write_report(df: DataFrame, path: str) -> None:
    """A report, a table of bounded size, as JSON lines and as CSV with a header: ``path``/json and ``path``/csv."""
    one = df.coalesce(1)
    one.write.mode("overwrite").json(f"{path}/json")
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def json_array(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows as one JSON array in the order of ``order``: column ``json``, for each group of ``by`` if given.

    An array is one value, so a group must fit a row; JSON lines are the form for large results.
    """
    fields = [c for c in df.columns if c not in (by or [])]
    item = F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.to_json(F.struct(*fields)).alias("_json"))
    rows = df.groupBy(*(by or [])).agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    return rows.select(*(by or []), F.concat(F.lit("["), F.concat_ws(",", F.transform("_rows", lambda x: x["_json"])), F.lit("]")).alias("json"))


def append_metric(df: DataFrame, path: str, version: int = 1) -> None:
    df.withColumn("schema_version", F.lit(version)).withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def object_path(digest: Column, suffix: Column) -> Column:
    """Place of a payload by its digest; unknown suffixes are ``bin``."""
    return F.concat_ws("/", F.lit("objects"), F.substring(digest, 1, 2), F.concat_ws(".", digest, F.coalesce(suffix, F.lit("bin"))))


def write_objects(df: DataFrame, root: str, payload_: Column, suffix: Column, digest: Column | None = None) -> DataFrame:
    """Payloads as files under ``root``, each once, at the place that its SHA-256 gives: digest, path, bytes, written.

    Files go through the file system of ``root`` (any that pyarrow opens: local or mounted folders, HDFS, object stores). Tasks write where the
    payloads lie, to a name of the digest alone, and only digests and paths are shuffled; then each file is moved to its place. All writes end in
    a move, so a task that is retried or runs twice leaves one whole file; a file of the right size is not written again, so a second run moves nothing.
    Null payloads are left out; of equal payloads with different suffixes the first suffix in order counts.
    With ``digest``, a payload that has another one fails the job. The write happens when the result is worked out: stage it.
    """
    rows = df.select(payload_.cast("binary").alias("data"), suffix.alias("suffix"), (digest if digest is not None else F.lit(None).cast("string")).alias("declared")).where("data IS NOT NULL")
    rows = rows.withColumn("digest", F.sha2("data", 256))
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), "declared")).cast("string")
    rows = rows.withColumn("digest", F.when(F.col("declared").isNull() | (F.col("declared") == F.col("digest")), F.col("digest")).otherwise(wrong))

    def stage(batches):
        import contextlib
        import uuid

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(root)
        whole = lambda info, size: info.type == fs.FileType.File and info.size == size
        made = set()
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).cast(pa.int64())
            places = files.get_file_info([f"{top}/{p}" for p in batch.column(1).to_pylist()])
            for k, (name, size, there) in enumerate(zip(batch.column(0).to_pylist(), sizes.to_pylist(), places, strict=True)):
                staged = f"{top}/objects/{name[:2]}/{name}~"
                if whole(there, size) or whole(files.get_file_info(staged), size):
                    continue
                if name[:2] not in made:
                    files.create_dir(f"{top}/objects/{name[:2]}", recursive=True)
                    made.add(name[:2])
                beside = staged + uuid.uuid4().hex
                try:
                    with files.open_output_stream(beside, compression=None) as out:
                        out.write(batch.column(2)[k].as_buffer())
                    files.move(beside, staged)
                except OSError:
                    with contextlib.suppress(OSError):
                        files.delete_file(beside)
                    if not whole(files.get_file_info(staged), size):  # else another task was faster
                        raise
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["digest", "path", "bytes"])

    def place(batches):
        import contextlib

        import pyarrow as pa
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(root)
        whole = lambda info, size: info.type == fs.FileType.File and info.size == size
        for batch in batches:
            places, made = [f"{top}/{p}" for p in batch.column(1).to_pylist()], []
            staged = [f"{top}/objects/{name[:2]}/{name}~" for name in batch.column(0).to_pylist()]
            for to, there, at, left, size in zip(places, files.get_file_info(places), staged, files.get_file_info(staged), batch.column(2).to_pylist(), strict=True):
                fresh = not whole(there, size)
                with contextlib.suppress(OSError):  # another attempt of this task may be at it
                    if fresh and there.type == fs.FileType.File:
                        files.delete_file(to)  # torn
                    if fresh:
                        files.move(at, to)
                    elif left.type == fs.FileType.File:
                        files.delete_file(at)
                if fresh and not whole(files.get_file_info(to), size):
                    raise OSError(f"{to} could not be written")
                made.append(fresh)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.bool_())], ["digest", "path", "bytes", "written"])

    staged = rows.select("digest", object_path(F.col("digest"), F.col("suffix")).alias("path"), "data").mapInArrow(stage, "digest string, path string, bytes long")
    once = staged.groupBy("digest").agg(F.min("path").alias("path"), F.min("bytes").alias("bytes"))
    return once.mapInArrow(place, "digest string, path string, bytes long, written boolean")


def stored_objects(spark: SparkSession, root: str) -> DataFrame:
    """Files that ``write_objects`` put under ``root``: path (below ``root``) and length. Empty files count; parts that a lost task left beside their place do not.

    The folders of digests are listed in tasks, so neither the driver nor a task holds the whole listing.
    """

    def found(batches):
        import re

        import pyarrow as pa
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                there = files.get_file_info(fs.FileSelector(f"{top}/objects/{folder}", allow_not_found=True))
                whole = [f for f in there if f.type == fs.FileType.File and re.match(r"[0-9a-f]{64}\.(?!.*\.[0-9a-f]{32}\.part$)", f.base_name)]
                yield pa.RecordBatch.from_arrays([pa.array([f"objects/{folder}/{f.base_name}" for f in whole], pa.string()), pa.array([f.size for f in whole], pa.int64())], ["path", "length"])

    return _digest_folders(spark).mapInArrow(found, "path string, length long")


def _digest_folders(spark: SparkSession) -> DataFrame:
    """The 256 folders that ``object_path`` deals files to, four to a task."""
    return spark.range(0, 256, 1, 64).select(F.lpad(F.lower(F.hex("id")), 2, "0").alias("folder"))


def flatten_results(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Rows (scenario, metrics) of a map column of metric structs."""
    return df.select(*by, F.explode(column).alias("scenario", "_m")).select(*by, "scenario", "_m.*")
