"""A stream read to its end gives what the batch form gives."""

import random
import time

import pytest
from pyspark.sql import functions as F
from wayline.operators import decoding, tracking
from wayline.streaming import events as streams
from wayline.streaming import tracks


@pytest.mark.parametrize("name", ["windowed_counts", "sessions"])
def test_stream_equals_batch(spark, sf_dir, tmp_path, name):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    cols = [F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("tet"), F.col("user_id").alias("cell"), F.col("value").alias("v")]
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")).select(*cols)
    make = getattr(streams, name)
    q = make(stream).writeStream.format("memory").queryName(f"q_{name}").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    rounded = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    assert rounded(spark.table(f"q_{name}")) == rounded(make(raw.select(*cols)))


def streamed(spark, frames, tmp_path, make, name):
    """What ``make`` gives for a stream of one file after the other."""
    for part in frames:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_jump_filter_keeps_its_state(spark, tmp_path):
    rng = random.Random(1)
    rows = [(t, i, None if rng.random() < 0.2 else rng.uniform(0, 20), rng.uniform(0, 20)) for t in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "trial int, i long, x double, y double")
    want = {(r.trial, r.i): r.ok for r in tracking.jump_filter(df, 2.0, ("trial",)).collect()}
    parts = [df.where(f"i between {a} and {a + 19}") for a in (0, 20, 40)]
    got = {(r.trial, r.i): r.ok for r in streamed(spark, parts, tmp_path, lambda s: tracks.jump_filter(s, 2.0), "q_jump")}
    assert got == want and any(got.values())


def test_posterior_keeps_its_state(spark, tmp_path):
    rng = random.Random(2)
    moves = [[0.8, 0.2], [0.3, 0.7]]
    df = spark.createDataFrame([(s, t, [rng.gauss(0, 2), rng.gauss(0, 2)]) for s in (1, 2) for t in range(30)], "session int, t long, l array<double>")
    want = {(r.session, r.t): r.p for r in decoding.forward_filter(df, moves).collect()}
    parts = [df.where(f"t between {a} and {a + 9}") for a in (0, 10, 20)]
    got = {(r.session, r.t): r.p for r in streamed(spark, parts, tmp_path, lambda s: tracks.causal_posterior(s, moves), "q_posterior")}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k]))


def test_pairs_of_a_stream(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("i"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("tet"), F.col("user_id").alias("cell"))
    want = sorted(tuple(r) for r in tracks.lag_pairs(e, 20_000).collect())
    parts = [e.where(f"i between {a} and {a + 499}") for a in (0, 500)]
    assert sorted(tuple(r) for r in streamed(spark, parts, tmp_path, lambda s: tracks.lag_pairs(s, 20_000), "q_pairs")) == want and want


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_late_and_shuffled_samples_give_the_batch_result(spark, tmp_path, rocks):
    rng = random.Random(5)
    rows = [(t, i, None if rng.random() < 0.2 else rng.uniform(0, 20), rng.uniform(0, 20)) for t in range(3) for i in range(45)]
    df = spark.createDataFrame(rows, "trial int, i long, x double, y double").withColumn("at", F.timestamp_seconds(F.col("i") + 1_700_000_000))
    want = {(r.trial, r.i): r.ok for r in tracking.jump_filter(df, 2.0, ("trial",)).collect()}
    # each file holds samples of two stretches: what belongs to one may come with the next
    early = (F.col("i") + 7 * F.col("trial")) % 3 == 0
    parts = [df.where(F.floor(F.col("i") / 15) + F.when(early, 0).otherwise(F.lit(1)) == k) for k in range(4)]
    end = spark.createDataFrame([(9, 10**6, 0.0, 0.0)], df.drop("at").schema).withColumn("at", F.timestamp_seconds(F.lit(1_800_000_000)))
    make = lambda s: tracks.jump_filter_in_time(s, 2.0, late="31 seconds", expire_s=60)
    got = {(r.trial, r.i): r.ok for r in streamed(spark, [*parts, end], tmp_path, make, "q_late")}
    assert got == want and any(got.values())
    left = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "carried").load()
    assert {r.key[0] for r in left.select("key").collect()} <= {9}


def test_posterior_of_late_time_bins(spark, tmp_path, rocks):
    rng = random.Random(6)
    moves = [[0.8, 0.2], [0.3, 0.7]]
    rows = [(s, t, [rng.gauss(0, 2), rng.gauss(0, 2)]) for s in (1, 2) for t in range(20)]
    df = spark.createDataFrame(rows, "session int, t long, l array<double>").withColumn("at", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    want = {(r.session, r.t): r.p for r in decoding.forward_filter(df, moves).collect()}
    parts = [df.where("t % 2 = 1"), df.where("t % 2 = 0")]
    end = spark.createDataFrame([(9, 10**6, [0.0, 0.0])], df.drop("at").schema).withColumn("at", F.timestamp_seconds(F.lit(1_800_000_000)))
    got = {(r.session, r.t): r.p for r in streamed(spark, [*parts, end], tmp_path, lambda s: tracks.causal_posterior_in_time(s, moves, late="30 seconds"), "q_late_p")}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-12 for k in want for a, b in zip(got[k], want[k]))
