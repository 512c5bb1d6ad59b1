"""Structured Streaming feeds.

* :func:`dedup_stream` drops repeated keys that arrive within a lateness
  bound (``withWatermark`` + ``dropDuplicatesWithinWatermark``).
* :func:`start_fact_stream` appends reviews to the fact table.  Window and
  anti-join logic is not allowed on a stream directly, so every micro-batch
  runs the batch fact load in ``foreachBatch``.
* :func:`start_scd2_stream` applies a job-history change feed to the Type 2
  dimension: each batch appends its history rows and writes the versions of
  the touched employees only.

Any number of feeds, each with its own checkpoint, may run at the same time
into one output folder.  The folder is a :class:`~starloom.sources.store.Store`:
a batch becomes visible in one commit, which also notes how far its feed has
come, so a retried batch that was committed does nothing.
"""
from __future__ import annotations

import hashlib
from functools import partial
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.windows import first_per
from ..plans import fact as factmod
from ..plans import scd2
from ..session import materialize
from ..sources.store import Conflict, Store


def read_file_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                     max_files: int | None = None) -> DataFrame:
    """Parquet file stream over a directory (a single file is not a valid
    stream source: point at its folder and filter by name)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


def dedup_stream(df: DataFrame, keys: Sequence[str], event_time: str, lateness: str) -> DataFrame:
    return df.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))


def _feed(checkpoint: str) -> str:
    """Name of a feed in the notes of its output."""
    return "feed-" + hashlib.sha1(checkpoint.encode()).hexdigest()[:16]


def _started(query: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = query.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _fact_store(spark: SparkSession, out_dir: str) -> Store:
    return Store(spark, out_dir)


#: dim_employee, dim_department, dim_date and dim_project, or what gives them as they are now.
Dims = dict | Callable[[], dict]


def _load_batch(spark: SparkSession, dims: Dims, out_dir: str, batch: DataFrame, mark: Callable[[dict], dict], done: Callable[[dict], bool]) -> None:
    """One load of ``batch`` and of the waiting reviews, in one commit, again
    and again until no other feed has committed in between."""
    while True:
        store = _fact_store(spark, out_dir)
        if done(store.notes()):
            return
        now = dims() if callable(dims) else dims
        d = (now["dim_employee"], now["dim_department"], now["dim_date"], now["dim_project"])
        there = store.tables()
        waiting = batch.unionByName(store.read("waiting").select(*batch.columns)) if "waiting" in there else batch
        cand = materialize(first_per(waiting, ["review_id"], [F.struct(*batch.columns)]))
        known = partial(store.rows_that_may_hold, "fact") if "fact" in there else None
        loaded = store.stage("fact", factmod.load_fact(cand, *d, known=known), append=True)
        late = factmod.new_reviews(cand, None, known=known).join(loaded.select("review_id"), "review_id", "left_anti")
        store.stage("waiting", late.select(*batch.columns))
        try:
            store.commit(mark)
            return
        except Conflict:
            continue


def start_fact_stream(spark: SparkSession, reviews: DataFrame, dims: Dims, out_dir: str,
                      checkpoint: str, trigger_available_now: bool = True) -> StreamingQuery:
    """``reviews`` is a streaming DataFrame; ``dims`` holds dim_employee,
    dim_department, dim_date, dim_project (batch frames), or is a function
    that gives them anew for each batch, for dimensions that grow meanwhile.

    A batch loads its own reviews and those that still wait, and leaves what
    it cannot resolve (no employee version on the date) as the new set of
    waiting reviews, so that set never holds a loaded one.  Of one review id
    with several texts the first in the order of all columns counts.  Facts
    and waiting reviews change in one commit; it fails if another feed has
    committed since this batch read them, and the batch then starts over, so
    feeds act one after the other, whatever their order in time.  The guard
    reads only fact units whose zone map and Bloom filter may hold a key of
    the batch."""
    feed = _feed(checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        _load_batch(spark, dims, out_dir, batch, lambda notes: notes | {feed: batch_id}, lambda notes: notes.get(feed, -1) >= batch_id)

    return _started(reviews.writeStream.foreachBatch(run), checkpoint, trigger_available_now)


def load_waiting(spark: SparkSession, dims: Dims, out_dir: str) -> int:
    """Try the waiting reviews again (their versions may have come since the
    last batch); the number that still waits."""
    store = _fact_store(spark, out_dir)
    if "waiting" not in store.tables():
        return 0
    _load_batch(spark, dims, out_dir, store.read("waiting").limit(0), lambda notes: notes, lambda notes: False)
    return read_waiting(spark, out_dir).count()


def unresolved_by(spark: SparkSession, dims: Dims, out_dir: str, watermark: str) -> DataFrame:
    """Waiting reviews dated up to the history's watermark (no version for
    them is expected any more), with the reason that ``fact.unresolved`` gives."""
    now = dims() if callable(dims) else dims
    old = read_waiting(spark, out_dir).filter(F.col("review_date") <= F.to_date(F.lit(watermark)))
    return factmod.unresolved(old, now["dim_employee"], now["dim_department"], now["dim_date"])


def read_fact(spark: SparkSession, out_dir: str) -> DataFrame:
    return _fact_store(spark, out_dir).read("fact")


def read_waiting(spark: SparkSession, out_dir: str) -> DataFrame:
    """Reviews that no batch could resolve yet."""
    return _fact_store(spark, out_dir).read("waiting")


#: Parts of a level of the dimension and of the history that become one of the next.
FANOUT = 4


def _dim_store(spark: SparkSession, out_dir: str) -> Store:
    key = [("employee_id",)]
    return Store(spark, out_dir, bucketed={}, indexed={"history": key, "dim_employee": key})


def start_scd2_stream(spark: SparkSession, history: DataFrame, employees: DataFrame, departments: DataFrame,
                      out_dir: str, checkpoint: str, trigger_available_now: bool = True) -> StreamingQuery:
    """``history`` is a streaming DataFrame of job-history rows.

    A batch first commits its history rows and takes the next number of the
    sequence in the same commit.  It then recomputes the versions of the
    employees it touches from all history of that version or a later one, and
    commits those employees' rows with its number.  The highest number that
    holds an employee is that employee's state: its batch saw the history of
    every lower number.  Parts of the history and of the dimension are merged
    level by level, the latter without rows of a number that a higher one shadows.  A
    retried batch keeps its number."""
    feed = _feed(checkpoint)

    def claim(batch_id: int):
        return lambda notes: notes | {"seq": notes.get("seq", 0) + 1, feed: {"batch": batch_id, "seq": notes.get("seq", 0) + 1, "done": False}}

    def run(batch: DataFrame, batch_id: int) -> None:
        store = _dim_store(spark, out_dir)
        mine = store.notes().get(feed, {"batch": -1})
        if mine["batch"] > batch_id or mine["batch"] == batch_id and mine["done"]:
            return
        if mine["batch"] < batch_id:
            store.stage("history", batch, append=True)
            store.commit(claim(batch_id))
            mine = store.notes()[feed]
        keys = materialize(batch.select("employee_id").distinct())
        so_far = store.rows_that_may_hold("history", keys, ["employee_id"]).join(keys, "employee_id", "left_semi")
        versions = materialize(scd2.timeline(so_far.select(*batch.columns).dropDuplicates(), employees, departments))
        before = None
        if "dim_employee" in store.tables():
            rows = store.rows_that_may_hold("dim_employee", keys, ["employee_id"]).join(keys, "employee_id", "left_semi")
            before = _newest(rows.filter(F.col("seq") < mine["seq"])).drop("seq")
        store.stage("dim_employee", scd2.refresh_dim_employee(versions, before).withColumn("seq", F.lit(mine["seq"]).cast("long")), append=True)
        store.commit(lambda notes: notes | {feed: mine | {"done": True}})
        store.compact_levels("dim_employee", _newest, FANOUT)
        store.compact_levels("history", lambda df: df.dropDuplicates(), FANOUT)

    return _started(history.writeStream.foreachBatch(run), checkpoint, trigger_available_now)


def _newest(rows: DataFrame) -> DataFrame:
    """Each employee's rows of the highest number that holds the employee."""
    last = rows.groupBy("employee_id").agg(F.max("seq").alias("seq"))
    return rows.join(last, ["employee_id", "seq"], "left_semi").select(*rows.columns)


def read_latest_dim(spark: SparkSession, out_dir: str) -> DataFrame:
    return _newest(_dim_store(spark, out_dir).read("dim_employee")).drop("seq")
