import numpy as np
from pyspark.sql import functions as F

from corelev.operators import scores as S
from corelev.streaming import online as ST

SF = "/root/testdata/sf0.001"


def test_stream_online_leverage_equals_batch_per_key(spark):
    rows = ST.events_vectors(ST.event_stream(spark, SF))
    out = {r["id"]: r["score"] for r in ST.run_to_table(ST.online_leverage_stream(rows, 2), "t1").collect()}
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for uid in [r["user_id"] for r in ev.select("user_id").distinct().limit(3).collect()]:
        sub = ev.filter(F.col("user_id") == uid).orderBy("event_id").collect()
        M = np.zeros((2, 2))
        for r in sub:
            x = np.array([r["value"], 1.0])
            M += np.outer(x, x)
            ref = min(max(x @ np.linalg.pinv(M) @ x, 0), 1)
            assert abs(out[r["event_id"]] - ref) < 1e-8


def test_stream_countsketch_equals_batch(spark):
    rows = ST.events_vectors(ST.event_stream(spark, SF))
    st = {(r["bucket"], r["j"]): r["value"]
          for r in ST.run_to_table(ST.countsketch_stream(rows, 8, 2), "t2", mode="complete").collect()}
    batch = ST.events_vectors(spark.read.parquet(f"{SF}/events.parquet"), watermark=None)
    bt = {(r["bucket"], r["j"]): r["value"] for r in S.countsketch_table(batch, 8, 2).collect()}
    assert st.keys() == bt.keys()
    for k in st:
        assert abs(st[k] - bt[k]) < 1e-9


def test_stream_reservoir_and_sgd(spark, tmp_path):
    rows = ST.events_vectors(ST.event_stream(spark, SF)).withColumn("wt", F.lit(1.0))
    res = ST.run_to_table(ST.reservoir_stream(rows, 3, "wt"), "t3", mode="update", keys=["key", "slot"]).collect()
    per = {}
    for r in res:
        per.setdefault(r["key"], set()).add(r["id"])
    assert all(1 <= len(v) <= 3 for v in per.values())
    sgd = ST.StreamingSGD(2, state_path=str(tmp_path / "sgd"))
    b = sgd.run(ST.events_vectors(ST.event_stream(spark, SF)))
    assert np.all(np.isfinite(b))
    assert spark.read.parquet(str(tmp_path / "sgd")).count() >= 1


def _batches(spark, tmp_path, files):
    """One parquet file a batch: rows (event_id, user_id, event_type, value, ts)."""
    import os
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, ts STRING")
        df.withColumn("ts", F.col("ts").cast("timestamp")).toPandas().to_parquet(folder / f"events_{k}.parquet", coerce_timestamps="us")
        os.utime(folder / f"events_{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return str(folder)


def _three(spark, tmp_path):
    days = ["2024-02-01", "2024-03-01", "2024-03-02"]
    files = [[(100 * b + i, i % 2, "error" if i % 3 else "view", 0.0 if i % 4 == 0 else float(i), f"{d} 0{i}:00:00") for i in range(8)]
             for b, d in enumerate(days)]
    return files


def test_late_rows_are_dropped(spark, tmp_path):
    files = _three(spark, tmp_path)
    files[2].append((999, 0, "view", 5.0, "2024-01-15 00:00:00"))
    rows = ST.events_vectors(ST.event_stream(spark, _batches(spark, tmp_path, files), max_files=1))
    got = {r["id"] for r in ST.run_to_table(ST.online_leverage_stream(rows, 2), "late").collect()}
    assert got == {r[0] for f in files for r in f} - {999}
    res = ST.run_to_table(ST.reservoir_stream(rows.withColumn("wt", F.lit(1.0)), 50, "wt"), "late2", mode="update", keys=["key", "slot"])
    assert {r["id"] for r in res.collect()} == got


def test_stream_reservoir_over_three_batches_equals_batch(spark, tmp_path):
    from corelev.operators import sampling as SM

    files = _three(spark, tmp_path)
    rows = ST.events_vectors(ST.event_stream(spark, _batches(spark, tmp_path, files), max_files=1)).withColumn("wt", F.col("x")[0])
    out = ST.run_to_table(ST.reservoir_stream(rows, 3, "wt", columns=("id", "y", "wt")), "s2b", mode="update", keys=["key", "slot"])
    got = out.collect()
    assert len(got) == 6 and {c: t for c, t in out.dtypes}["wt"] == "double"  # 2 keys x 3 slots
    batch = spark.createDataFrame([(r[0], r[0], r[1], r[3]) for f in files for r in f], "id BIGINT, ord BIGINT, key BIGINT, wt DOUBLE")
    want = {(r["key"], r["id"]) for r in SM.reservoir_sample(batch, 3, weight="wt", key="key").collect()}
    assert {(r["key"], r["id"]) for r in got} == want


def test_sgd_restart_and_replay(spark, tmp_path):
    files = _three(spark, tmp_path)
    folder, state = _batches(spark, tmp_path, files), str(tmp_path / "state")
    rows = lambda: ST.events_vectors(ST.event_stream(spark, folder, max_files=1))
    first = ST.StreamingSGD(2, state_path=state)
    beta = first.run(rows())
    assert first.t == 3
    again = ST.StreamingSGD(2, state_path=state)
    np.testing.assert_allclose(again.run(rows()), beta)  # no new data: nothing applied again
    assert again.t == 3 and spark.read.parquet(state).count() == 3
    again.process(spark.createDataFrame([([1.0, 1.0], 1, 1.0)], "x ARRAY<DOUBLE>, y INT, w DOUBLE"), 2)  # a replayed batch
    np.testing.assert_allclose(again.beta, beta)


def test_table_restart_takes_only_new_files(spark, tmp_path):
    files = _three(spark, tmp_path)
    folder, path = _batches(spark, tmp_path, files[:2]), str(tmp_path / "out")
    rows = lambda: ST.events_vectors(ST.event_stream(spark, folder, max_files=1))
    assert ST.run_to_table(ST.online_leverage_stream(rows(), 2), "r", path=path).count() == 16
    assert ST.run_to_table(ST.online_leverage_stream(rows(), 2), "r", path=path).count() == 16


def _by_key(pdf):
    return {k: rows for k, rows in pdf.groupby("key")}


def test_ridge_stream_over_batches_and_restart_equals_batch(spark, tmp_path):
    """Three batches with a restart between them give the batch operator's (D7) reservoir and slots."""
    import shutil

    from corelev.operators import sampling as SM

    rnd = np.random.default_rng(8)
    days = ["2024-02-01", "2024-03-01", "2024-03-02"]
    files = [[(100 * b + i, int(rnd.integers(3)), "view", float(rnd.normal()), f"{d} 00:00:{i:02d}") for i in range(40)] for b, d in enumerate(days)]
    folder = _batches(spark, tmp_path, files)
    held_back = tmp_path / "later"
    held_back.mkdir()
    shutil.move(f"{folder}/events_2.parquet", held_back)
    path = str(tmp_path / "table")

    def run():
        rows = ST.events_vectors(ST.event_stream(spark, folder, max_files=1))
        return ST.run_to_table(ST.ridge_reservoir_stream(rows, 4, 2, c=0.05), "ridge", mode="update", keys=["key", "slot"], path=path)

    run()
    shutil.move(str(held_back / "events_2.parquet"), folder)
    got = {(r["key"], r["id"]) for r in run().collect()}
    static = ST.events_vectors(spark.read.parquet(folder), watermark=None)
    want = {(r["key"], r["id"]) for r in SM.online_ridge_sample(static, 4, "key", c=0.05, d=2).collect()}
    assert got == want and len(want) == 12


def test_hot_key_is_merged_from_spilled_runs(spark, tmp_path, monkeypatch):
    """Rows of a key beyond what is sorted in memory come in order from spilled runs, merged in several levels."""
    from corelev.streaming import keyed as K

    class State(dict):
        def updateValue(self, k, v):
            self[k] = v

        def getValue(self, k):
            return self[k]

        def removeKey(self, k):
            del self[k]

    monkeypatch.setattr(K, "HOLD", 50)
    monkeypatch.setattr(K, "PART", 7)
    monkeypatch.setattr(K, "RUNS", 3)
    import pandas as pd

    rnd = np.random.default_rng(0)
    pdf = pd.DataFrame({"ord": rnd.integers(0, 40, 2000), "id": rnd.permutation(2000)})
    pdf["x"] = [[float(i), 1.0] for i in pdf["id"]]
    state, most = State(), 0
    frames = [pdf.iloc[a:a + 20] for a in range(0, 2000, 20)]
    got = []
    for f in K.SortedRows(state).ordered(iter(frames)):
        got.append(f)
        most = max(most, len(f))
    out = pd.concat(got)
    want = pdf.sort_values(["ord", "id"])
    assert out["id"].tolist() == want["id"].tolist() and not state and most < 200
    assert [list(v) for v in out["x"]] == [list(v) for v in want["x"]]


def test_hot_key_stream_spills(spark, tmp_path):
    """One key with 150,000 rows in one batch: more than HOLD, through the state store, as the batch operator scores them."""
    from corelev.operators import online as O

    n = 150_000
    src = spark.range(n).select(F.col("id"), ((F.col("id") * 7919) % 150_001).alias("ord"), F.lit(1).alias("key"),
                                F.array(F.sin("id"), F.lit(1.0)).alias("x"))
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = ST.run_to_table(ST.online_leverage_stream(stream, 2), "hot")
    want = O.online_leverage_scores(src, d=2, n=n).select("id", F.col("score").alias("want"))
    far = out.join(want, "id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("score") - F.col("want"))).alias("far")).first()
    assert far["n"] == n and far["far"] < 1e-9


def test_idle_keys_end(spark, tmp_path):
    """A key idle for longer than ``idle_ms`` behind the watermark starts anew."""
    files = [[(i, 0, "view", float(i), f"2024-02-01 0{i}:00:00") for i in range(4)],
             [(10 + i, 1, "view", float(i), f"2024-03-0{i + 1} 00:00:00") for i in range(4)],
             [(20 + i, 1, "view", float(i), f"2024-03-0{i + 1} 01:00:00") for i in range(3, 5)],
             [(30 + i, 0, "view", float(i), f"2024-04-01 0{i}:00:00") for i in range(4)]]
    rows = ST.events_vectors(ST.event_stream(spark, _batches(spark, tmp_path, files), max_files=1))
    day = 24 * 3600 * 1000
    got = {r["id"]: r["score"] for r in ST.run_to_table(ST.online_leverage_stream(rows, 2, idle_ms=day), "idle").collect()}
    assert got[30] == 1.0  # the first row of a new state
    kept = {r["id"]: r["score"] for r in ST.run_to_table(ST.online_leverage_stream(rows, 2), "kept").collect()}
    assert kept[30] < 1.0
