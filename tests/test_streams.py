"""Late and idle sequences of streams."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import frames as R
from tessella.plans.catalog import QUERIES
from tessella.streaming import frames as S

SCHEMA = "seq string, frame long, hist array<long>, at timestamp"


@pytest.fixture
def stream(spark, tmp_path):
    """A stream of batches, each a list of (seq, frame, day of arrival's watermark or the frame's own)."""

    def of(batches):
        for n, rows in enumerate(batches):
            df = spark.createDataFrame([(s, f, h) for s, f, h in rows], "seq string, frame long, hist array<long>")
            df.withColumn("at", F.timestamp_seconds((F.col("frame") + 1) * 86400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return of


def ran(spark, df, tmp_path):
    S.appended(df, str(tmp_path / "out"), str(tmp_path / "state"))
    return sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect())


def test_late_frames_come_in_their_place(spark, stream, tmp_path):
    rng = random.Random(4)
    rows = [(s, f, [rng.randrange(9), rng.randrange(9)]) for s in "abc" for f in range(30) if rng.random() < 0.8]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(6))
    batches = [arrival[i : i + 12] for i in range(0, len(arrival), 12)] + [[("a", 60, None)]]
    got = ran(spark, S.shots(stream(batches), 5, "8 days"), tmp_path)
    expected = R.shots(spark.createDataFrame(rows, "seq string, frame long, hist array<long>"), 5).select("seq", "frame", "diff", "changed", "shot")
    assert got == sorted(tuple(r) for r in expected.collect()) and len(got) == len(rows)


def test_what_waits_is_not_put_out(spark, stream, tmp_path):
    got = ran(spark, S.shots(stream([[("a", 0, [1]), ("a", 5, [1])], [("a", 20, [9])]]), 5, "8 days"), tmp_path)
    assert [r[1] for r in got] == [0, 5]


def test_idle_sequences_leave(spark, stream, tmp_path):
    day = 86_400_000
    batches = [[("a", 0, [1]), ("b", 0, [1])], [("b", 10, [1])], [("b", 20, [1])], [("b", 40, [1])], [("a", 45, [1])], [("b", 80, None)]]
    got = ran(spark, S.shots(stream(batches), 5, "2 days", idle=15 * day), tmp_path)
    # the first sequence was forgotten, so its last frame is a first one again
    assert [r for r in got if r[0] == "a"] == [("a", 0, 0, True, 0), ("a", 45, 0, True, 0)]
    assert [r[4] for r in got if r[0] == "b"] == [0] * 4


def test_steps_far_on_have_times_that_python_has(spark, tmp_path):
    rows = [(10**9 + i, i % 2, float(i % 7)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id int, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in QUERIES["t3_rolling_medians"](spark, str(tmp_path)).collect())
    last = lambda n: sorted([v for i, u, v in rows[: n + 1] if u == n % 2][-20:])
    assert got == [(i, last(n)[(len(last(n)) - 1) // 2]) for n, (i, _, _) in enumerate(rows)]
