"""Typed staging scans and simple sinks."""
from __future__ import annotations

import csv
import os
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


class MissingInput(FileNotFoundError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    """Path check through the session's Hadoop filesystem (works for HDFS/S3
    as well as local paths)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def require_inputs(spark: SparkSession, base: str, tables: Sequence[str] = tuple(schemas.STAGING)) -> list[str]:
    """Fail before planning when an expected staging file is absent."""
    paths = [os.path.join(base, f"{t}.csv") for t in tables]
    missing = [p for p in paths if not _exists(spark, p)]
    if missing:
        raise MissingInput("missing staging input: " + ", ".join(missing))
    return paths


class HeaderMismatch(ValueError):
    """A staging file whose header lacks declared columns or repeats a name."""


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Header -> files of a CSV file or folder.  Only first lines are read
    (also of compressed files), as many as there are files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(status) -> tuple[str, tuple[str, ...] | None]:
        stream = fs.open(status.getPath())
        try:
            codec = codecs.getCodec(status.getPath())
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
            line = reader.readLine()
        finally:
            stream.close()
        names = None if line is None else tuple(n.strip() for n in next(csv.reader([line.lstrip("\ufeff")]), []))
        return status.getPath().toString(), names

    found = [f for f in fs.listStatus(root) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    out: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(8) as pool:
        for file, names in pool.map(first_line, found):
            if names is not None:  # an empty file has no rows either
                out.setdefault(names, []).append(file)
    return out


def read_staging(spark: SparkSession, base: str, table: str, *, rescue: bool = False, allow_missing: Sequence[str] = ()) -> DataFrame:
    """CSV bound by the names in each file's header, in whatever order, with
    the declared types (never inferred) and ISO dates; malformed rows are kept
    with their text in ``_corrupt`` (PERMISSIVE; all columns are parsed, so
    that a column the query does not need cannot hide one).

    A declared column that a header lacks is an error that names the file and
    the columns, or null if listed in ``allow_missing``; so is a name that a
    header holds twice.  Columns that are not declared are left out, or kept as text in the
    map ``_rescued`` (null if a file has none).  Files that share a header are read together."""
    want = schemas.STAGING[table]
    path = os.path.join(base, f"{table}.csv")
    parts = []
    for names, files in sorted(headers(spark, path).items()):
        missing = [c for c in want.names if c not in names and c not in allow_missing]
        twice = sorted({n for n in names if names.count(n) > 1})
        if missing or twice:
            what = [f"no column {', '.join(missing)}"] * bool(missing) + [f"column {', '.join(twice)} repeated"] * bool(twice)
            raise HeaderMismatch(f"{files[0]}: {'; '.join(what)}")
        types = {f.name: f.dataType for f in want.fields}
        as_read = schemas.with_corrupt(T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names]))
        rows = (spark.read.schema(as_read).option("header", True).option("dateFormat", "yyyy-MM-dd")
                .option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_corrupt").csv(files))
        cols = [F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]
        if rescue:
            other = [n for n in names if n not in types]
            kept = F.create_map(*[x for n in other for x in (F.lit(n), F.col(f"`{n}`"))]) if other else F.lit(None)
            cols.append(kept.cast("map<string,string>").alias("_rescued"))
        parts.append(rows.select(*cols, "_corrupt"))
    if not parts:
        extra = [T.StructField("_rescued", T.MapType(T.StringType(), T.StringType()))] if rescue else []
        return spark.createDataFrame([], schemas.with_corrupt(T.StructType([*want.fields, *extra])))
    return reduce(DataFrame.unionByName, parts)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project to exactly ``cols``; the error names every missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header and ISO dates, written in parallel by partition."""
    df.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def insert_ignore(target: DataFrame | Callable[[DataFrame], DataFrame], batch: DataFrame, keys: Sequence[str],
                  order: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``batch`` to insert: in-batch duplicates collapse to the first
    by ``order`` (default: the keys themselves, then every column), keys
    already in ``target`` are skipped.  ``target`` may be a function from the
    batch's keys to the rows that may hold them (``Store.rows_that_may_hold``)."""
    from ..operators.windows import first_per
    k = list(keys)
    ordering = list(order) if order else [c for c in batch.columns if c not in k]
    dedup = first_per(batch, k, ordering) if ordering else batch.dropDuplicates(k)
    have = target(batch.select(*k)) if callable(target) else target
    return dedup.join(have.select(*k), k, "left_anti")


def run_sql(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Parametrised SQL: ``:name`` markers bound from ``args``; ``{name}``
    placeholders replaced by the given DataFrames."""
    return spark.sql(sql, args=args, **frames)

