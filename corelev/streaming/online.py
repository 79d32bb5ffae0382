"""Structured Streaming forms of the one-pass algorithms.

S1  online leverage per key: state = (prefix Gram, count); rows of a key inside a
    micro-batch are scored in (ord, id) order, by the batch operator's chunks.
S2  reservoirs per key: state = k slots with the rows' columns, the sum of weights and the
    rows seen (Chao); the ridge form also keeps the d x d matrix of accepted rows, which its
    next weights use.
S3  probit SGD: one gradient aggregate per micro-batch (``foreachBatch``); beta, step and
    batch number go to a parquet table after every batch, beside a checkpoint of the
    same name, so a restarted query goes on with the next batch and a replayed batch
    isn't applied again.
S4  CountSketch: a plain streaming ``groupBy(bucket).agg(sum)`` (linear, mergeable).

S1 and S2 are stateful processors on the RocksDB store (``keyed``). With a watermark, rows older than it
are dropped before they reach the state, and with ``idle_ms`` an event-time timer ends a key's state when the
watermark is that far past its last row. Results are written by batch into a table of files (``run_to_table``).
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import random as R
from . import keyed as K

# Spark sets a processor up in a Python process of its own on the driver, which has no path to this package
cloudpickle.register_pickle_by_value(K)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ckpt(spark: SparkSession, name: str) -> str:
    from ..session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def event_stream(spark: SparkSession, folder: str, table: str = "events", max_files: int | None = None) -> DataFrame:
    """Parquet files of one table in ``folder`` as a stream (schema from the files)."""
    glob = f"{table}*.parquet"
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(folder)


def events_vectors(stream: DataFrame, watermark: str | None = "1 hour") -> DataFrame:
    """EV rows for streams: id, ord, key, y, x = (value, 1) (no global standardisation)."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    s = s.withWatermark("ts", watermark) if watermark else s
    return s.select(F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.col("user_id").alias("key"),
                    F.when(F.col("event_type") == "error", 1).otherwise(-1).alias("y"), "ts",
                    F.array(F.col("value").cast("double"), F.lit(1.0)).alias("x"))


def _watermark(rows: DataFrame):
    """The column with a watermark, or None."""
    for f in rows.schema.fields:
        if "spark.watermarkDelayMs" in (f.metadata or {}):
            return f.name
    return None


def _keyed(rows: DataFrame, make, schema: str, mode: str, idle_ms: int | None) -> DataFrame:
    """``rows`` by key through a processor; with a watermark late rows are dropped, and ``idle_ms`` ends idle keys."""
    time_col = _watermark(rows)
    if idle_ms is not None and not time_col:
        raise ValueError("idle needs a watermark")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy("key").transformWithStateInPandas(
        make(idle_ms=idle_ms, time_col=time_col), schema, mode, "EventTime" if time_col else "None")


# -- S1 ----------------------------------------------------------------------

def online_leverage_stream(rows: DataFrame, d: int, method: str = "pinv", idle_ms: int | None = None) -> DataFrame:
    """Per-key online leverage; output (key, id, score) rows in append mode."""
    t = dict((f.name, f.dataType.simpleString()) for f in rows.schema.fields)
    time_col = _watermark(rows)
    src = rows.select("key", "ord", "id", "x", *([time_col] if time_col else []))
    return _keyed(src, lambda **kw: K.OnlineLeverage(d, method, **kw), f"key {t['key']}, id {t['id']}, score DOUBLE", "append", idle_ms)


# -- S2 ----------------------------------------------------------------------

def _reservoir(rows: DataFrame, make, used, seed: int, columns, idle_ms) -> DataFrame:
    """Emits the whole reservoir (key, slot, ``columns``) of every updated key, in update mode: of each (key, slot)
    the last batch's row holds (``run_to_table`` with ``keys``). Only what the processor reads travels to it."""
    t = dict((f.name, f.dataType.simpleString()) for f in rows.schema.fields)
    time_col = _watermark(rows)
    src = rows.select("key", "ord", "id", R.uniform("id", seed, "res1").alias("u1"), R.uniform("id", seed, "res2").alias("u2"), used,
                      F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("held"), *([time_col] if time_col else []))
    out = _keyed(src, make, f"key {t['key']}, slot INT, held STRING", "update", idle_ms)
    parsed = F.from_json("held", ", ".join(f"`{c}` {t[c]}" for c in columns))
    return out.select("key", "slot", parsed.alias("held")).select("key", "slot", "held.*")


def reservoir_stream(rows: DataFrame, k: int, weight: str, seed: int = 0, columns=("id", "y"),
                     idle_ms: int | None = None) -> DataFrame:
    """Chao reservoir per key. Decisions are those of the batch operator: from a row's position in its key, the
    weight sum up to it and its hash uniforms."""
    used = F.col(weight).cast("double").alias("weight")
    return _reservoir(rows, lambda **kw: K.ChaoReservoir(k, **kw), used, seed, columns, idle_ms)


def ridge_reservoir_stream(rows: DataFrame, k: int, d: int, c: float = 0.0, lam: float = 1e-6, seed: int = 0,
                           columns=("id", "y"), idle_ms: int | None = None) -> DataFrame:
    """S2, adaptive: ridge-leverage reservoir per key, the batch operator D7's rule carried over batches and restarts."""
    return _reservoir(rows, lambda **kw: K.RidgeReservoir(k, d, c, lam, **kw), F.col("x"), seed, columns, idle_ms)


# -- S4 ----------------------------------------------------------------------

def countsketch_stream(rows: DataFrame, s: int, d: int, seed: int = 0, stream: str = "cs") -> DataFrame:
    """Streaming CountSketch (bucket, j, value) - an ordinary stateful aggregate."""
    b = R.bucket("id", s, seed, stream + ":f")
    sg = R.sign("id", seed, stream + ":g")
    return (rows.select(b.alias("bucket"), F.posexplode(F.transform("x", lambda v: v * sg)).alias("j", "v"))
            .groupBy("bucket", "j").agg(F.sum("v").alias("value")))


# -- S3 ----------------------------------------------------------------------

class StreamingSGD:
    """S3: mini-batch probit SGD over a stream with a durable parameter table.

    With ``state_path`` the table and the query's checkpoint (``<state_path>_checkpoint``) stay
    between runs: a new process goes on where the last one committed.
    """

    def __init__(self, d: int, p: float = 2.0, eta0: float = 0.1, power_t: float = 0.5,
                 state_path: str | None = None):
        self.d, self.p, self.eta0, self.power_t = d, p, eta0, power_t
        self.state_path = state_path
        self.beta = np.zeros(d)
        self.t, self.last_batch = 0, -1

    def _restore(self, spark):
        from ..sources.files import missing_path

        try:
            last = spark.read.parquet(self.state_path).orderBy(F.col("batch").desc()).limit(1).collect()
        except AnalysisException as e:
            if not missing_path(e):
                raise
            return
        if last:
            self.t, self.last_batch = int(last[0]["t"]), int(last[0]["batch"])
            self.beta = np.asarray(last[0]["beta"], dtype=float)

    def process(self, batch: DataFrame, batch_id: int):
        from ..operators.probit import evaluate

        if self.state_path and self.last_batch < 0:
            self._restore(batch.sparkSession)
        if batch_id <= self.last_batch:  # replayed after a failure; its step is in the table
            return
        f, g, _, n = evaluate(batch, self.beta, self.p, self.d, want_hess=False)
        if n:
            self.t += 1
            self.beta = self.beta - self.eta0 / self.t ** self.power_t * (g / n)
        if self.state_path:
            batch.sparkSession.createDataFrame([(int(self.t), int(batch_id), list(map(float, self.beta)))],
                                               "t BIGINT, batch BIGINT, beta ARRAY<DOUBLE>") \
                .write.mode("append").parquet(self.state_path)
        self.last_batch = batch_id

    def run(self, rows: DataFrame, name: str = "sgd"):
        spark = rows.sparkSession
        if self.state_path:
            self._restore(spark)
        where = f"{self.state_path}_checkpoint" if self.state_path else _ckpt(spark, name)
        q = (rows.select("x", "y", F.lit(1.0).alias("w")).writeStream
             .foreachBatch(self.process).option("checkpointLocation", where)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return self.beta


def run_to_table(df: DataFrame, name: str, mode: str = "append", keys=None, path: str | None = None) -> DataFrame:
    """Run a streaming query over all available input into a table of files, one folder a batch.

    The table is ``path`` (its checkpoint beside it, so a second call goes on where the first
    ended), or a new folder below the session's checkpoint folder. A replayed batch writes its
    own folder anew. ``keys`` (update mode): of each key the last batch's row. Complete mode: the last batch.
    """
    spark = df.sparkSession
    path = path or _ckpt(spark, f"{name}-table")
    cols = df.columns

    def put(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = (df.writeStream.foreachBatch(put).outputMode(mode)
         .option("checkpointLocation", f"{path}_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    from ..sources.files import missing_path

    try:
        out = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(path)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        return out.where(F.col("batch") == F.lit(last)).drop("batch")
    if keys:
        row = F.max_by(F.struct(*cols), "batch").alias("_r")
        return out.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(row).select("_r.*")
    return out.drop("batch")
