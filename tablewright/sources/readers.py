"""Reading and writing tables: CSV, Parquet, JSON, ORC and Arrow IPC (Feather)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extension -> format.
FORMATS = {
    ".csv": "csv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "jsonl",
    ".orc": "orc",
    ".feather": "feather",
}


def format_of(path: str) -> str:
    """The format named by the extension; unknown ones are an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in FORMATS:
        raise ValueError(f"unsupported extension {suffix!r}; known: {sorted(FORMATS)}")
    return FORMATS[suffix]


def clean_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with word characters only; repeats get ``_1, _2``."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        base = re.sub(r"[^\w]", "_", column).strip("_").lower()
        repeat = seen.get(base, 0)
        seen[base] = repeat + 1
        names.append(f"{base}_{repeat}" if repeat else base)
    return df.toDF(*names)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; keep only NULL."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns
    ])


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    sanitize: bool = False,
    **options: object,
) -> DataFrame:
    """Read a file or folder; the format comes from the extension unless given.

    With a ``schema`` CSV and JSON need no inference pass. Missing values are NULL.
    """
    fmt = fmt or format_of(path)
    if fmt == "feather":
        df = read_feather(spark, path, schema)
    else:
        reader = spark.read
        defaults: dict[str, object] = {}
        if fmt == "csv":
            defaults = {"header": True, "sep": ",", "encoding": "UTF-8"}
            if schema is None:
                defaults["inferSchema"] = True
        elif fmt == "json":          # one array of objects; "jsonl" splits over tasks
            defaults = {"multiLine": True}
        elif fmt not in ("jsonl", "parquet", "orc"):
            raise ValueError(f"unsupported format {fmt!r}")
        if schema is not None:
            reader = reader.schema(schema)
        reader = reader.options(**{**defaults, **options})
        df = reader.format("json" if fmt == "jsonl" else fmt).load(path)
    df = clean_names(df) if sanitize else df
    return nan_to_null(df)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite",
                partition_by: list[str] | None = None, **options: object) -> None:
    """Write as the format of the extension; Feather gives one file per Arrow batch.

    Missing values are written as NULL, also where they were NaN.
    """
    fmt = fmt or format_of(path)
    df = nan_to_null(df)
    if fmt == "feather":
        write_feather(df, path)
        return
    if fmt == "csv":
        options = {"header": True, **options}
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format("json" if fmt == "jsonl" else fmt).save(path)


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_feather(df: DataFrame, path: str) -> None:
    """Each task writes its Arrow batches as Feather files of its own name.

    A file appears under its final name only when complete, so a task that is
    repeated or lost leaves no half-written file for readers; the names returned
    by the finished tasks form the manifest that readers go by.
    """
    filesystem, root = _filesystem(path)
    filesystem.create_dir(root, recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import feather

        task_fs, task_root = _filesystem(path)
        for batch in batches:
            name = f"part-{uuid.uuid4().hex}.feather"
            hidden = f"{task_root}/_{name}"
            with task_fs.open_output_stream(hidden) as sink:
                feather.write_feather(pa.Table.from_batches([batch]), sink, compression="lz4")
            task_fs.move(hidden, f"{task_root}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    df.mapInArrow(save, "name string").write.mode("overwrite").parquet(f"{path}/_manifest")


def read_feather(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Many Feather files as one table, decoded in the tasks.

    Each file is one unit of work, so large data must be many files. Folders written
    by :func:`write_feather` are read through their manifest, which leaves out files
    of tasks that were repeated.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    )
    if _exists(path + "/_manifest"):
        files = files.join(spark.read.parquet(path + "/_manifest"), "name", "left_semi")
    if schema is None:
        first = files.select("content").limit(1).collect()
        if not first:
            raise ValueError(f"no Feather file under {path}; give a schema to read none")
        from pyspark.sql.pandas.types import from_arrow_schema

        schema = from_arrow_schema(pa.ipc.open_file(pa.BufferReader(first[0]["content"])).schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                reader = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    return files.select("content").mapInArrow(decode, schema)


def _exists(path: str) -> bool:
    from pyarrow import fs

    filesystem, root = _filesystem(path)
    return filesystem.get_file_info(root).type != fs.FileType.NotFound
