"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of an Arrow batch on its way to a task's Python code.
ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package's source, once per Spark context, so
    that tasks can import it where it is not installed.  Also lowers Spark's
    64 MB default for an Arrow batch, unless the session sets its own: the
    batch is held several times, in the JVM's direct memory and in Python, by
    every running task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(key, str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_starloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="starloom-src-"), "starloom_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._starloom_shipped = True


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, so a
    lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a ``written`` table that is no longer read."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict[str, list] = {}


def holds(owner: str, *caches) -> None:
    """Register a module's per-process caches (anything with ``clear``)."""
    _HELD.setdefault(owner, []).extend(caches)


def only(owner: str) -> None:
    """Called when a task starts: a reused Python worker drops what the tasks
    of other operators left in their caches, and gives memory that is free
    back to the system: workers live on beside the JVM within one limit."""
    for name, caches in _HELD.items():
        if name != owner:
            for c in caches:
                c.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def fold_of(col: Column, mod: int) -> Column:
    """crc32 of an id written as text, modulo ``mod`` (null for a null id)."""
    return F.crc32(col.cast("string")) % F.lit(mod)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def batches(it, max_bytes: int, col: str = "text"):
    """Cut incoming Arrow batches so that one slice holds at most
    ``max_bytes`` of ``col`` (one row at least): memory per step is bounded
    by the longest text, not by the batch size."""
    for b in it:
        n = b.num_rows
        if not n:
            continue
        arr = b.column(b.schema.get_field_index(col))
        size = pc.fill_null(pc.binary_length(arr), 0).to_pylist()
        lo, run = 0, 0
        for i, s in enumerate(size):
            if i > lo and run + s > max_bytes:
                yield b.slice(lo, i - lo)
                lo, run = i, 0
            run += s
        yield b.slice(lo, n - lo)


#: Bits of the map behind ``maybe_in``: 2 MB at any size.
MAP_BITS = 1 << 24


def maybe_in(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """``df`` with ``__maybe``: false only where ``col`` is surely not among
    the values of ``ids``.  A bit map of their hashes, of fixed size, is
    broadcast; where it fills up, more rows are true and an exact join after
    it has more to do."""
    h = F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(MAP_BITS))
    bit = F.expr("shiftleft(1L, cast(__h % 64 as int))")
    words = ids.select(h.alias("__h")).groupBy(F.floor(F.col("__h") / 64).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    out = df.withColumn("__h", h).withColumn("__word", F.floor(F.col("__h") / 64)).join(F.broadcast(words), "__word", "left")
    return out.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__h", "__word", "__bits")


def unit_of(seed: Column) -> Column:
    """A number from 0 to 1 by the hash of ``seed``."""
    return F.xxhash64(seed, F.lit("sample")).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))


def one_sample(df: DataFrame, strata: Column, seed_col: Column, per_stratum: int) -> DataFrame:
    """At most about ``per_stratum`` rows of each stratum, picked by a hash of
    ``seed_col``: one counting pass, then a filter per stratum (no shuffle of
    rows).  The strata must be few (labels, languages)."""
    d = df.withColumn("__s", strata.cast("string"))
    counts = {r["__s"]: r["n"] for r in d.groupBy("__s").agg(F.count("*").alias("n")).collect()
              if r["__s"] is not None}
    keep = F.lit(False)
    unit = unit_of(seed_col)
    for s, n in sorted(counts.items()):
        keep = keep | ((F.col("__s") == F.lit(s)) & (unit < F.lit(min(1.0, per_stratum / n))))
    return d.filter(keep).drop("__s")
