"""Streaming queries: each runs its stream to completion (availableNow) in a
fresh folder under the session's checkpoint directory and returns the
resulting table as a batch DataFrame."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..session import ensure_checkpoint_dir, materialize
from ..sources.fixtures import Fixture, fixture_core, fixture_warehouse
from ..sources.testdata import table
from ..streaming import feeds
from .warehouse import EMP_COLS, EMP_SQL, FACT_BIZ, _fact_business


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


@query("stream_dedup_reviews", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS \"day\" FROM events")
def stream_dedup_reviews(spark, sf):
    """Events stream (one row per user, type and day kept) with a 1-day
    lateness bound."""
    base = _scratch(spark)
    schema = table(spark, sf, "events").schema
    src = feeds.read_file_stream(spark, sf, schema, glob="events.parquet")
    # the test tables carry local (NTZ) timestamps; event time must be a TIMESTAMP
    keyed = src.select("user_id", "event_type", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"))
    out = feeds.dedup_stream(keyed, ["user_id", "event_type", "day"], "ts", "1 day")
    q = (out.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type", "day")


@query("stream_fact_append", f"SELECT {', '.join(FACT_BIZ)} FROM o_fact")
def stream_fact_append(spark, sf):
    """Reviews fed as one file per review year; the streamed fact must equal
    the batch fact."""
    base = _scratch(spark)
    core = fixture_core(spark, sf)
    dw = fixture_warehouse(spark, sf)
    dims = {"dim_employee": materialize(dw.dim_employee), "dim_department": materialize(dw.dim_department),
            "dim_date": materialize(dw.dim_date), "dim_project": materialize(dw.dim_project)}
    reviews = core.reviews
    reviews.repartition(8, F.year("review_date")).write.parquet(f"{base}/feed")
    src = feeds.read_file_stream(spark, f"{base}/feed", reviews.schema, max_files=1)
    q = feeds.start_fact_stream(spark, src, dims, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    fact = feeds.read_fact(spark, f"{base}/out")
    return _fact_business(dw.with_(dim_employee=dims["dim_employee"], dim_project=dims["dim_project"]), fact)


@query("stream_scd2_apply", f"SELECT {EMP_SQL} FROM o_dim_employee")
def stream_scd2_apply(spark, sf):
    """Job history fed as one file per start year, applied batch by batch to
    the Type 2 dimension; the result must equal the batch build."""
    base = _scratch(spark)
    f = Fixture(spark, sf)
    hist = f.history()
    hist.repartition(8, F.year("effective_start")).write.parquet(f"{base}/feed")
    src = feeds.read_file_stream(spark, f"{base}/feed", hist.schema, max_files=1)
    emp, dep = materialize(f.employee()), materialize(f.department())
    q = feeds.start_scd2_stream(spark, src, emp, dep, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return feeds.read_latest_dim(spark, f"{base}/out").select(*EMP_COLS)

