import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import components as cp
from tessera.operators import statistics as st
from tessera.operators import vectors as vx
from tessera.sources import tables as src
from tessera.streaming import frames as sf


def test_manifests_pairs_and_logs(spark, tmp_path):
    (tmp_path / "m.csv").write_text("filename,speaker_id,dataset_source\na.wav,s1,d\nb.wav,s2,d\n")
    assert [tuple(r) for r in src.read_manifest(spark, f"{tmp_path}/m.csv").orderBy("filename").collect()] == [("a.wav", "s1", "d"), ("b.wav", "s2", "d")]
    (tmp_path / "t.tsv").write_text("client_id\tpath\nc1\tx y.wav\n")
    assert src.read_tsv(spark, f"{tmp_path}/t.tsv", "client_id string, path string").collect()[0].path == "x y.wav"
    (tmp_path / "p.txt").write_text("1 a b\n0  c d\nbroken line\n2 a b\n\n")
    good, bad = src.read_pair_list(spark, f"{tmp_path}/p.txt")
    assert sorted(tuple(r) for r in good.collect()) == [(0, "c", "d"), (1, "a", "b")] and bad.count() == 2
    (tmp_path / "log.txt").write_text("start\n[120/4000] done 2.5 files/s\n240/4000 at 2.4 files/s\n")
    assert [tuple(r) for r in src.read_progress(spark, f"{tmp_path}/log.txt").orderBy("done").collect()] == [(120, 4000, 2.5), (240, 4000, 2.4)]


def test_reports_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    for form in ("parquet", "csv", "json"):
        src.write_report(d, f"{tmp_path}/{form}", form)
        back = spark.read.option("header", True).format(form).load(f"{tmp_path}/{form}")
        assert sorted((int(r.k), r.s) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_recordings_are_listed_with_their_speaker(spark, tmp_path):
    for name in ("sp0001/a.wav", "sp0002/deep/b.wav", "sp0002/c.txt"):
        p = tmp_path / "wav" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    assert sorted(r.speaker_id for r in src.read_recordings(spark, f"{tmp_path}/wav").collect()) == ["sp0001", "sp0002"]


def test_embedding_interface_pads_and_skips(spark):
    def load():
        return lambda x, lengths: np.stack([x.sum(axis=1), lengths * x.shape[1]], axis=1)

    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, None), (4, [])], "rec_id int, samples array<float>")
    assert {r.rec_id: r.embedding for r in vx.embed(d, load, 4).collect()} == {1: [3.0, 2.0], 2: [3.0, 1.0], 3: None, 4: None}


def test_permuted_blocks_keep_blocks_and_break_rows(spark):
    d = spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("a"), (F.col("id") * 2).alias("x"), (F.col("id") * 3).alias("y"))
    rows = st.permuted_block(d, "k", ["x", "y"], 1).collect()
    assert len(rows) == 500 and sorted(r.x for r in rows) == list(range(0, 1000, 2))
    assert all(r.a == r.k and 3 * r.x == 2 * r.y for r in rows) and sum(r.x == 2 * r.a for r in rows) < 20


def test_parallel_analysis_counts_the_real_components(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 1))
    x = np.hstack([base + 0.3 * rng.normal(size=(400, 1)) for _ in range(3)] + [rng.normal(size=(400, 1))])
    d = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    for block in (None, 50):
        found = cp.parallel_analysis(d, list("abcd"), draws=20, block=block).orderBy("component").collect()
        assert [r.retained for r in found] == [True, False, False, False]
        assert np.allclose([r.eigenvalue for r in found], np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1])


def test_features_of_embeddings_cast_numbers_and_not_arrays(spark, small):
    """64 features out of one array: no feature casts the whole array, and all values are those of the array."""
    from tessera.plans import modelling as ml
    from tessera.sources import tables as src

    d = ml._dimensions(spark, small)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan and "as double" in plan
    assert sorted(tuple(r) for r in d.collect()) == sorted(tuple(r.v) for r in src.embeddings(spark, small).collect())


def test_streams_drop_late_events_and_agree_with_batch(spark, tmp_path):
    events = tmp_path / "in"
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)

    def put(name, rows):
        schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
        spark.createDataFrame([(k, t, 1, "x", v, None) for k, (t, v) in enumerate(rows)], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        events.mkdir(exist_ok=True)
        part = next((tmp_path / name).glob("part-*"))
        part.rename(events / f"events-{name}.parquet")

    stream = lambda: sf.windowed_histogram(sf.read_events(spark, str(events), 1), [10.0, 20.0], late="2 days")
    for name, rows in (("a", [(day(1), 5.0), (day(1, 5), 15.0)]), ("b", [(day(9), 25.0)]), ("c", [(day(1, 6), 5.0), (day(8), 5.0)])):
        put(name, rows)
        sf.run_to_end(stream(), f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    got = {(r.start.day, r.bin): r.n for r in sf.latest(spark, f"file://{tmp_path}/out", ["start", "bin"]).collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (9, 2): 1, (8, 0): 1}, "the event of day 1 came after the watermark"
    s = spark.createDataFrame([(day(1), 1, 1.0), (day(1, 3), 1, 3.0), (day(1, 12), 1, 9.0), (day(1), 2, 4.0)], "ts timestamp, rec_id long, value double")
    assert sorted((r.rec_id, r.n, r.peak) for r in sf.sessions(s).collect()) == [(1, 1, 9.0), (1, 2, 3.0), (2, 1, 4.0)]
