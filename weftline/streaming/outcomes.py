"""The log of requests and their outcomes, from two streams, and its join.

Requests (request_id, requested_at, ...) and outcomes (request_id, delivered_at, accepted, ...) arrive in any order; a source may send a row again. The join
keeps a request until its outcome can no longer count, and writes the pair as soon as both are there. What it keeps are tables beside the stream's progress, so a batch
is deduplicated and joined as tables are, by sorting, and its size is bounded by disk, not by memory.
Every batch has its own folder, which is overwritten when the batch is run again, so a replay adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from weftline.streaming.requests import _start

# The streams of a pair, and the column of each that tells its time.
TIMES = {"asked": "requested_at", "done": "delivered_at"}


def batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch below ``out`` in a folder of its number, in place of what an earlier run of that batch has left there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def append_log(rows: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to the log at ``out``."""
    return _start(rows.writeStream.foreachBatch(batch_writer(out)), checkpoint, available_now)


def deliveries(requests: DataFrame, outcomes: DataFrame, wait: str) -> DataFrame:
    """Requests with their outcome: all columns of the requests, and those of the outcomes but the id.

    An outcome counts if it is delivered between the request and ``wait`` after it. Rows on either side that came in an earlier batch are marked ``_known``; pairs of two such are not given again.
    """
    asked, done = requests.withColumnRenamed("_known", "asked_before"), outcomes.withColumnsRenamed({"request_id": "outcome_of", "_known": "done_before"})
    in_time = F.col("delivered_at").between(F.col("requested_at"), F.col("requested_at") + F.expr(f"INTERVAL {wait}"))
    met = (F.col("request_id") == F.col("outcome_of")) & in_time & ~(F.col("asked_before") & F.col("done_before"))
    return asked.join(done, met).drop("outcome_of", "asked_before", "done_before")


def _reaches(time: str, span: str, watermark: Column) -> Column:
    """Whether a row's time and the span after it lie beyond the watermark; rows without a time are as old as can be."""
    return F.coalesce(F.col(time).cast("timestamp"), F.timestamp_micros(F.lit(0))) + F.expr(f"INTERVAL {span}") > watermark


def _unseen(rows: DataFrame, seen: DataFrame, key: list[str], time: str) -> DataFrame:
    """The earliest row for each key of ``rows`` that ``seen`` does not hold, by one grouping of both."""
    rest = [c for c in rows.columns if c not in key]
    new = rows.select(*key, F.struct(*(rest or key)).alias("_row"), F.lit(False).alias("_known"))
    old = seen.select(*key, F.lit(None).cast(new.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_known"))
    earliest = [F.min_by("_row", F.struct(F.col(f"_row.{time}").isNull(), F.col(f"_row.{time}"))).alias("_row")] if rest else []
    found = new.unionAll(old).groupBy(*key).agg(F.bool_or("_known").alias("_known"), *earliest).filter("not _known")
    return found.select(*(F.col(c if c in key else f"_row.{c}") for c in rows.columns))


def outcome_stream(
    requests: DataFrame, outcomes: DataFrame, out: str, checkpoint: str, wait: str, lateness: str, available_now: bool = True
) -> StreamingQuery:
    """Write ``deliveries`` to the log at ``out`` as they become known.

    ``lateness`` is how far behind the latest time that earlier batches have seen (on both streams) a row may be; what comes later than that is left out (``request_log``
    still has it). Of a request sent again within that time one row is taken, and of equal outcome rows one; different outcomes of a request are all written, and
    ``first_outcomes`` takes the earliest. Kept are the rows of about ``wait`` and ``lateness`` on either side, and no more, in tables below ``checkpoint``: two by
    turns, so that a batch which is run again finds what the one before it has left. Each batch reads and writes them, so its cost is that of the rows it has and those kept.
    """
    spark, streams = requests.sparkSession, {"asked": requests, "done": outcomes}

    def place(batch_id: int, name: str) -> str:
        return f"{checkpoint}/pending/{batch_id % 2}/{name}"

    def kept(batch_id: int, side: str) -> DataFrame:
        schema = StructType([*streams[side].schema.fields, StructField("_known", BooleanType())])
        return spark.read.schema(schema).parquet(place(batch_id, side)) if batch_id >= 0 else spark.createDataFrame([], schema)

    def latest(batch_id: int) -> dict[str, int]:
        """The latest time of either stream up to that batch, in microseconds."""
        if batch_id < 0:
            return dict.fromkeys(streams, 0)
        row = spark.read.parquet(place(batch_id, "latest")).first()
        if row.batch_id != batch_id:
            raise ValueError(f"{checkpoint} keeps the rows of batch {row.batch_id}, not those of batch {batch_id}")
        return {side: row[side] for side in streams}

    def join(batch: DataFrame, batch_id: int) -> None:
        before = latest(batch_id - 1)
        watermark = F.greatest(F.timestamp_micros(F.lit(min(before.values()))) - F.expr(f"INTERVAL {lateness}"), F.timestamp_micros(F.lit(0)))
        for side, time in TIMES.items():
            rows = batch.filter(f"{side}.request_id is not null").select(f"{side}.*")
            rows = rows.filter(F.col(time).isNull() | (F.col(time) > watermark))
            sent_again = _reaches(time, lateness, watermark)
            old = kept(batch_id - 1, side).filter(sent_again | _reaches(time, wait, watermark) if side == "asked" else sent_again)
            new = _unseen(rows, old.filter(sent_again).drop("_known"), ["request_id"] if side == "asked" else rows.columns, time)
            both = new.withColumn("_known", F.lit(False)).unionByName(old.withColumn("_known", F.lit(True)))
            both.write.mode("overwrite").parquet(place(batch_id, side))
        times = batch.agg(*(F.max(F.unix_micros(F.col(f"{side}.{time}").cast("timestamp"))).alias(side) for side, time in TIMES.items())).first()
        now = [max(before[side], times[side] or 0) for side in streams]
        spark.createDataFrame([(batch_id, *now)], "batch_id long, asked long, done long").write.mode("overwrite").parquet(place(batch_id, "latest"))
        batch_writer(out)(deliveries(kept(batch_id, "asked"), kept(batch_id, "done"), wait), batch_id)

    def side_of(side: str) -> DataFrame:
        named = {s: F.struct("*") if s == side else F.lit(None).cast(rows.schema) for s, rows in streams.items()}
        return streams[side].select(*(c.alias(s) for s, c in named.items()))

    return _start(side_of("asked").unionByName(side_of("done")).writeStream.foreachBatch(join), checkpoint, available_now)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """What has been appended so far, without the numbers of batches."""
    return spark.read.parquet(path).drop("batch_id")


def first_outcomes(delivered: DataFrame) -> DataFrame:
    """(request_id, requested_at, delivered_at, accepted) of the earliest outcome of every request in a log of deliveries; of ones delivered at one time, an accepted one."""
    by = F.struct("delivered_at", ~F.coalesce("accepted", F.lit(False)), F.col("accepted").isNull())
    return delivered.groupBy("request_id").agg(F.min("requested_at").alias("requested_at"), F.min_by(F.struct("delivered_at", "accepted"), by).alias("o")).select(
        "request_id", "requested_at", "o.*")


def request_log(requests: DataFrame, outcomes: DataFrame, wait: str) -> DataFrame:
    """The finished log from the two logs: every request once, with its outcome or nulls while it is open.

    For stored logs, whatever order their rows came in. Of a request's rows the earliest counts, and of its outcomes in time the earliest (of ones delivered at one time, an accepted
    one). Both logs are reduced by id before the join, so a row that was sent very often is one row there. Requests without an id cannot be told to be sent again: each stays, open.
    """
    rest = [c for c in requests.columns if c != "request_id"]
    named, nameless = requests.filter("request_id is not null"), requests.filter("request_id is null")
    first = F.min_by(F.struct(*rest), F.struct(F.col("requested_at").isNull(), F.col("requested_at")))
    asked = named.groupBy("request_id").agg(first.alias("r")).select("request_id", "r.*")
    # A request's distinct outcomes; which one is in time is known only next to the request.
    done = outcomes.filter("request_id is not null").groupBy("request_id", "delivered_at").agg(F.max("accepted").alias("accepted"))
    in_time = F.col("delivered_at").between(F.col("requested_at"), F.col("requested_at") + F.expr(f"INTERVAL {wait}"))
    both = asked.join(done, "request_id", "left").withColumn("outcome", F.when(in_time, F.struct("delivered_at", "accepted")))
    finished = both.groupBy("request_id").agg(*[F.any_value(c).alias(c) for c in rest], F.min("outcome").alias("outcome")).select(
        "request_id", *rest, "outcome.delivered_at", "outcome.accepted")
    still_open = [F.lit(None).cast(finished.schema[c].dataType).alias(c) for c in ("delivered_at", "accepted")]
    return finished.unionByName(nameless.select("request_id", *rest, *still_open))
