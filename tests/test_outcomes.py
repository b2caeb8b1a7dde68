import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators.dataset import request_outcomes
from weftline.streaming import outcomes as O
from weftline.streaming.requests import read_request_stream

START = datetime(2024, 1, 1)
REQUESTS = "request_id bigint, requested_at timestamp"
OUTCOMES = "request_id bigint, delivered_at timestamp, accepted boolean"


def at(hours):
    return START + timedelta(hours=hours)


class Streams:
    """Two folders that rows are added to, and the job that joins them."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def add(self, requests=(), outcomes=()):
        self.spark.createDataFrame([(i, at(h)) for i, h in requests], REQUESTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in/requests")
        self.spark.createDataFrame([(i, at(h), a) for i, h, a in outcomes], OUTCOMES).coalesce(1).write.mode("append").parquet(f"{self.folder}/in/outcomes")

    def run(self, progress="progress"):
        asked = read_request_stream(self.spark, f"{self.folder}/in/requests", REQUESTS)
        done = read_request_stream(self.spark, f"{self.folder}/in/outcomes", OUTCOMES)
        O.outcome_stream(asked, done, f"{self.folder}/log", f"{self.folder}/{progress}", "2 days", "1 day").awaitTermination()
        return sorted((r.request_id, r.delivered_at, r.accepted) for r in O.read_log(self.spark, f"{self.folder}/log").collect())


@pytest.fixture
def streams(spark, tmp_path):
    return Streams(spark, str(tmp_path))


def test_late_outcomes_join(streams):
    streams.add([(1, 0), (2, 0), (3, 0)], [(1, 1, True)])
    assert streams.run() == [(1, at(1), True)]
    streams.add([(4, 20)], [(2, 30, False)])  # the request came in an earlier batch
    assert streams.run() == [(1, at(1), True), (2, at(30), False)]
    streams.add([], [(3, 49, True)])  # after the time that an outcome may take
    assert [r[0] for r in streams.run()] == [1, 2]


def test_outcome_before_request_and_rows_sent_again(streams):
    streams.add([], [(1, 5, True), (1, 5, True)])
    assert streams.run() == []
    streams.add([(1, 4), (1, 4)], [(1, 5, True)])
    assert streams.run() == [(1, at(5), True)]


def test_rows_are_kept_in_tables_until_their_time_is_over(streams):
    streams.add([(1, 0), (2, 100)], [(1, 1, True), (2, 101, True)])
    assert streams.run() == [(1, at(1), True), (2, at(101), True)]  # both have come as far as hour 100, less a day
    streams.add([(1, 77), (3, 50)], [(1, 78, False), (3, 78, True), (2, 101, True)])  # asked anew; too late; sent again
    assert streams.run() == [(1, at(1), True), (1, at(78), False), (2, at(101), True)]
    kept = streams.spark.read.parquet(f"{streams.folder}/progress/pending/1/asked").collect()
    assert sorted((r.request_id, r.requested_at) for r in kept) == [(1, at(77)), (2, at(100))]


def test_no_row_is_held_in_memory_between_batches(streams):
    streams.add([(1, 0)], [(1, 1, True)])
    asked, done = (read_request_stream(streams.spark, f"{streams.folder}/in/{name}", schema) for name, schema in (("requests", REQUESTS), ("outcomes", OUTCOMES)))
    query = O.outcome_stream(asked, done, f"{streams.folder}/log", f"{streams.folder}/progress", "2 days", "1 day")
    query.awaitTermination()
    assert query.recentProgress and not any(p.stateOperators for p in query.recentProgress)


def test_replay_adds_nothing(streams):
    streams.add([(1, 0), (2, 0)], [(1, 1, True)])
    streams.run()
    shutil.copytree(f"{streams.folder}/progress", f"{streams.folder}/as-before")
    streams.add([(3, 2)], [(2, 3, False), (3, 4, True)])
    once = streams.run()
    # A job that was lost before it noted its last batch runs that batch again.
    assert streams.run("as-before") == once and len(once) == 3


def test_batches_are_overwritten(spark, tmp_path):
    write = O.batch_writer(str(tmp_path / "log"))
    for batch_id in (0, 1, 1):
        write(spark.range(batch_id * 10, batch_id * 10 + 5), batch_id)
    assert sorted(r.id for r in O.read_log(spark, str(tmp_path / "log")).collect()) == [*range(5), *range(10, 15)]


def test_finished_log(spark):
    asked = spark.createDataFrame([(1, at(0), "a"), (1, at(0), "a"), (2, at(0), "b"), (3, at(0), "c"), (4, at(9), "d"), (5, None, "e")], REQUESTS + ", who string")
    done = spark.createDataFrame(
        [(1, at(2), False), (1, at(2), False), (1, at(3), True), (2, at(100), True), (4, at(8), True), (4, at(10), None), (4, at(10), True), (9, at(1), True), (5, at(1), True), (3, None, True)],
        OUTCOMES)
    log = O.request_log(asked, done, "2 days")
    rows = {r.request_id: (r.who, r.delivered_at, r.accepted) for r in log.collect()}
    assert rows == {1: ("a", at(2), False), 2: ("b", None, None), 3: ("c", None, None), 4: ("d", at(10), True), 5: ("e", None, None)}
    nameless = spark.createDataFrame([(None, at(0), "f"), (None, at(0), "f")], asked.schema)
    assert O.request_log(nameless, spark.createDataFrame([(None, at(1), True)], OUTCOMES), "2 days").filter("accepted is null").count() == 2
    assert O.request_log(asked.limit(0), done, "2 days").count() == 0
    assert request_outcomes(log, log.who).count() == 5


def test_mean_lead_of_sums_beyond_a_long(spark):
    """Four leads of 100,000 years: their microseconds add up to more than 2^63."""
    log = spark.range(4).select(
        F.lit("a").alias("who"), F.timestamp_micros(F.lit(0)).alias("requested_at"),
        F.timestamp_micros(F.lit(100_000 * 31_536_000_000_000)).alias("delivered_at"), F.lit(True).alias("accepted"))
    row = request_outcomes(log, log.who).first()
    assert row.requests == 4 and row.mean_lead_seconds == 100_000 * 31_536_000.0
