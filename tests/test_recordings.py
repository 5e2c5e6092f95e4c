import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.sources import catalog, recordings

RNG = np.random.default_rng(5)


def put(path, head, data=None):
    text = "".join(f"{k} {v}\r\n" for k, v in head).encode("latin-1")
    with open(path, "wb") as f:
        f.write(text if data is None else text + b"data_start" + data + b"\r\ndata_end\r\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("rec"))
    put(f"{d}/r1.set", [("duration", "12"), ("colactive_1", "1"), ("colactive_2", "1"), ("experimenter", "é x"), ("empty", ""), ("duration", "13")])
    pos = np.zeros(70, recordings.POSITION)
    pos["ts"], pos["c"] = np.arange(70), RNG.integers(0, 600, (70, 8))
    pos["c"][3, :2] = 1023
    head = [("num_pos_samples", 68), ("sample_rate", "50.0 hz"), ("pixels_per_metre", 300), ("window_min_x", 10), ("window_max_x", 700), ("window_min_y", 0), ("window_max_y", 500)]
    put(f"{d}/r1.pos", head, pos.tobytes())
    tet = np.zeros(40, recordings.SPIKE)
    tet["ts"], tet["waveform"] = np.repeat(np.arange(10) * 960, 4), RNG.integers(-128, 128, (40, 50))
    put(f"{d}/r1.2", [("timebase", "96000 hz")], tet.tobytes())
    eeg = RNG.integers(-50, 50, 3000).astype("i1")
    eeg[1000] = 127
    put(f"{d}/r1.eeg", [("sample_rate", "250.0 hz"), ("bytes_per_sample", 1), ("num_EEG_samples", 2990)], eeg.tobytes())
    with open(f"{d}/r1_2.cut", "w") as f:
        f.write("n_clusters: 3\nExact_cut_for: r1 spikes: 10\n" + " ".join(str(k % 3) for k in range(10)) + "\n")
    with open(f"{d}/r1.clu.2", "w") as f:
        f.write("4\n" + "\n".join(str(k % 4) for k in range(10)) + "\n")
    os.utime(f"{d}/r1_2.cut", (time.time() - 100,) * 2)
    put(f"{d}/empty.pos", [("num_pos_samples", 0)], b"")
    return d, pos, tet, eeg


def test_positions_and_trials(spark, folder):
    d, pos, *_ = folder
    got = {(r.i, r.led): (r.px, r.py, r.npix) for r in recordings.leds(recordings.contents(spark, d, "*.pos"), 2).collect()}
    assert len(got) == 136 and got[3, 0][:2] == (None, None) and got[3, 1] == tuple(map(float, pos["c"][3, [2, 3, 5]]))
    assert got[67, 0] == tuple(map(float, pos["c"][67, [0, 1, 4]]))
    one = recordings.leds(recordings.contents(spark, d, "*.pos"), 1)
    assert one.count() == 68
    t = recordings.trials(recordings.contents(spark, d, "*.set"), recordings.contents(spark, d, "*.pos")).collect()
    assert [tuple(r) for r in t] == [("r1", 13.0, 2, 50.0, 68, 300.0, 690.0, 500.0)]
    head = recordings.with_header(recordings.contents(spark, d, "*.set")).first().header
    assert head["experimenter"] == "é x" and head["empty"] == ""


def test_spikes_and_cuts(spark, folder):
    d, _, tet, _ = folder
    s = recordings.spikes(recordings.contents(spark, d, "r1.*"), waves=True).orderBy("k").collect()
    assert [r.tick for r in s] == [k * 960 for k in range(10)] and s[1].t_s == 0.01 and {r.tet for r in s} == {2}
    assert s[4].waveform == tet["waveform"][16:20].reshape(-1).tolist()
    cut = {r.k: r.cell for r in recordings.cuts(recordings.contents(spark, d, "*.cut")).collect()}
    assert cut == {k: k % 3 for k in range(10)}
    newest = recordings.newest_cuts(recordings.listing(spark, d)).collect()
    assert [(r.trial, r.tet, r.name) for r in newest] == [("r1", 2, "r1.clu.2")]
    assert recordings.newest_cuts(recordings.listing(spark, d), "cut").first().name == "r1_2.cut"
    cells = recordings.sorted_spikes(recordings.spikes(recordings.contents(spark, d, "r1.2")), recordings.cuts(recordings.contents(spark, d, "*.clu.2")))
    assert {r.k: r.cell for r in cells.collect()} == {k: k % 4 for k in range(10)}


def test_signal(spark, folder):
    d, *_, eeg = folder
    rows = recordings.signal(recordings.contents(spark, d, "*.eeg"), 250.0).orderBy("i").collect()
    assert [r.v for r in rows] == eeg[:2990].astype(float).tolist()
    assert [r.i for r in rows if r.is_bad] == list(range(1000 - 375, 1000 + 376))


@pytest.mark.parametrize("records", [7, 1000, 1 << 20])
def test_ranges_give_the_rows_of_whole_files(spark, folder, records):
    d = folder[0]
    same = lambda a, b: sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).collect()))
    leds = recordings.read_leds(spark, d, 2, records=records)
    assert same(leds, recordings.leds(recordings.contents(spark, d, "*.pos"), 2)) and leds.count() == 136
    assert leds.rdd.getNumPartitions() >= 68 // records
    for waves in (False, True):
        got = recordings.read_spikes(spark, f"file://{d}", "r1.*", waves=waves, records=records)
        assert same(got, recordings.spikes(recordings.contents(spark, d, "r1.*"), waves=waves)) and got.count() == 10
    got = recordings.read_signal(spark, d, 250.0, records=records)
    assert same(got, recordings.signal(recordings.contents(spark, d, "*.eeg"), 250.0)) and got.count() == 2990
    assert recordings.read_leds(spark, d, 1, "*.none").count() == 0
    assert recordings.read_leds(spark, f"{d}/r1.pos", 1).count() == 68


def test_a_file_larger_than_a_row_may_be(spark, tmp_path):
    n = 10_200_000  # spikes of 216 bytes: 2.2 GB, most of them a hole in the file
    with open(tmp_path / "long.3", "wb") as f:
        f.write(b"timebase 96000 hz\r\ndata_start")
        start = f.tell()
        f.seek(start + (n - 1) * 216)
        f.write(np.array([(960, [1] * 50)] * 4, recordings.SPIKE).tobytes() + b"\r\ndata_end\r\n")
    got = recordings.read_spikes(spark, str(tmp_path / "long.3"), records=1 << 22)
    assert tuple(got.agg(F.count("*"), F.max("k"), F.max("tick"), F.sum("tick"), F.max("t_s")).first()) == (n, n - 1, 960, 960, 0.01)
    assert got.rdd.getNumPartitions() > 4


def test_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_text("2,CM,1,a,b,c,d,e,f,g\n1,MC,2,a,b,c,d,e,f,g\nnotes,,,,,,,,,\n")
    got = catalog.experiments(spark, str(tmp_path / "c.csv")).orderBy("Animal").collect()
    assert [(r.Animal, r.E1inCA1, r.E2inCA1) for r in got] == [("1", False, True), ("2", True, False)]
    for s in ("ann/2020-02-03", "ann/2020-02-04", "bob/2021-12-31", "bob/old"):
        (tmp_path / "tree" / s).mkdir(parents=True)
        (tmp_path / "tree" / s / "x.set").write_text("a b")
    days = catalog.sessions(recordings.listing(spark, str(tmp_path / "tree")))
    assert sorted((r.Animal, r.Year, r.Month, r.Day) for r in days.collect()) == [("ann", 2020, 2, 3), ("ann", 2020, 2, 4), ("bob", 2021, 12, 31)]
    assert catalog.resolve(days, "ann", 20, 2, 4).count() == 1
    name = days.where("Animal = 'bob'").select(catalog.session_name(F.col("Animal"), F.col("Year"), F.col("Month"), F.col("Day"), F.lit(1))).first()[0]
    assert name == "bob-31122101"


def test_resampled_and_stored(spark, tmp_path):
    df = spark.createDataFrame([(0.04 * k, None if k == 3 else 5.0 + k, 2.0 * k) for k in range(6)], "t_s double, x double, y double")
    got = catalog.resampled(df, 50.0).orderBy("i").collect()
    assert [round(r.x, 6) for r in got] == [0.5 * k for k in range(11)] and [round(r.y, 6) for r in got] == [float(k) for k in range(11)]
    out = str(tmp_path / "r")
    catalog.save(df.withColumn("animal", F.lit("ann")), out)
    assert catalog.load(spark, out, animal="ann").count() == 6
    plain = str(tmp_path / "p")
    df.write.parquet(plain)
    assert catalog.restored(spark, plain, catalog.manifest(df)).schema == df.schema
