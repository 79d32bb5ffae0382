"""File sources and result sinks.

Result tables are parquet folders partitioned by ``run`` so later reads prune by
run, and appends never rewrite existing files.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def missing_path(error: Exception) -> bool:
    """Whether Spark says that a path doesn't exist (any file system); other errors are not swallowed."""
    cond = getattr(error, "getCondition", getattr(error, "getErrorClass", lambda: ""))() or ""
    return "PATH_NOT_FOUND" in cond or "UNABLE_TO_INFER_SCHEMA" in cond


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A3: CSV with header; pass a schema in production (no inference pass)."""
    r = spark.read.option("header", "true")
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", "true").csv(path)


def read_run_files(spark: SparkSession, pattern: str, schema=None) -> DataFrame:
    """A4: many ``..._run_<k>.csv`` files; the run number is parsed from each file name."""
    df = read_csv(spark, pattern, schema)
    # "..._run_7.csv" (one file per run) or Spark's "run=7/" partition folders
    parts = [F.regexp_extract(F.input_file_name(), e, 1) for e in (r"/run=(\d+)/[^/]*$", r"run_(\d+)\.[^/]*$")]
    run = F.coalesce(*[F.when(c != "", c.cast("int")) for c in parts])
    return df.withColumn("run", run) if "run" not in df.columns else df.withColumn("file_run", run)


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None,
                label_map=None) -> DataFrame:
    """A5: svmlight / libsvm file -> (id, y, w, x ARRAY<DOUBLE>) dense rows."""
    from pyspark.ml.functions import vector_to_array

    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", str(num_features))
    df = r.load(path)
    y = F.when(F.col("label") > 0, F.lit(1)).otherwise(F.lit(-1)) if label_map is None else label_map(F.col("label"))
    rows = df.select(y.cast("int").alias("y"), F.lit(1.0).alias("w"), vector_to_array("features").alias("x"),
                     F.xxhash64("label", vector_to_array("features")).alias("_h"))
    # ids come from the rows, so they don't depend on how the file is split; equal rows are numbered
    same = Window.partitionBy("_h").orderBy("_h")
    return rows.select(F.xxhash64("_h", F.row_number().over(same)).alias("id"), "y", "w", "x")


def _number(t: str) -> float:
    """A double as SQL's cast reads it: blanks around it, Java's d and f suffixes, NaN and infinities; else an error."""
    m = re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[dDfF]?|[+-]?(?:inf|infinity)|nan", t.strip(), re.I | re.A)
    if m is None:
        raise ValueError(f"not a number in svmlight text: {t!r}")
    return float(t.strip().rstrip("dDfF") if t.strip()[-1:] in "dDfF" and t.strip()[-2:-1] in "0123456789." else t.strip())


def _place(t: str) -> int:
    if re.fullmatch(r"[+-]?\d+", t.strip(), re.A) is None or not -2**31 <= int(t) < 2**31:
        raise ValueError(f"not a place in svmlight text: {t!r}")
    return int(t)


def _parsed(lines):
    """(y, idx, val) of an Arrow array of svmlight lines; numbers that Arrow doesn't read go one by one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def cast(text, kind, one):
        try:
            return pc.cast(text, kind)
        except pa.ArrowInvalid:
            return pa.array([one(t) for t in text.to_pylist()], kind)

    v = lines.cast(pa.large_string())
    if pc.any(pc.match_substring(v, "#")).as_py():
        v = pc.replace_substring_regex(v, r"(?s)#.*", "")
    v = pc.utf8_trim(v, " ")
    v = v.filter(pc.invert(pc.match_substring_regex(v, r"^(?:[\t\n\x0b\f\r]|$)")))
    if pc.any(pc.match_substring_regex(v, r"[\t\n\x0b\f\r]")).as_py():
        v = pc.replace_substring_regex(v, r"[\t\n\x0b\f\r]", " ")
    words = pc.split_pattern(v, " ")
    at, flat = words.offsets.to_numpy() - words.offsets[0].as_py(), words.flatten()
    pair = pc.and_not(pc.match_substring(flat, ":"), pc.starts_with(flat, "qid:")).to_numpy(zero_copy_only=False)
    pair[at[:-1]] = False  # the label
    y = np.where(~(cast(flat.take(pa.array(at[:-1])), pa.float64(), _number).to_numpy() <= 0), 1, -1)  # NaN is above all numbers
    ends = np.r_[0, np.cumsum(pair)][at].astype(np.int32)
    both = pc.split_pattern(flat.filter(pa.array(pair)), ":")
    cut, parts = both.offsets.to_numpy() - both.offsets[0].as_py(), both.flatten()
    idx = cast(parts.take(pa.array(cut[:-1])), pa.int32(), _place).to_numpy() - np.int32(1)
    val = cast(parts.take(pa.array(cut[1:] - 1)), pa.float64(), _number)
    return pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(idx, pa.int32())), pa.ListArray.from_arrays(ends, val)],
                                      names=["y", "idx", "val"])


def read_libsvm_sparse(spark: SparkSession, path: str) -> DataFrame:
    """A5 kept sparse: svmlight text -> (id, y, w, idx, val), places from 0, as in ``operators.sparse``; Arrow's
    string kernels on batches of lines, whatever the number of columns. Comments (#) and ``qid`` are left out, blank
    lines and those that begin with a blank other than a space too."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield _parsed(b.column(0))

    rows = spark.read.text(path).mapInArrow(run, "y int, idx array<int>, val array<double>").withColumn("w", F.lit(1.0))
    rows = rows.withColumn("_h", F.xxhash64("y", "idx", "val"))
    same = Window.partitionBy("_h").orderBy("_h")  # equal rows are numbered
    return rows.select(F.xxhash64("_h", F.row_number().over(same)).alias("id"), "y", "w", "idx", "val")


def write_libsvm(df: DataFrame, path: str) -> None:
    """(y, x) rows as svmlight text: the label, then ``index:value`` (from 1) of every non-zero entry."""
    pairs = F.transform("x", lambda v, i: F.when(v != 0, F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string"))))  # nulls aren't joined
    df.select(F.concat_ws(" ", F.col("y").cast("string"), F.array_join(pairs, " ")).alias("value")).write.text(path)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Reuse a design between runs.

    With a path: written once as parquet and read back (survives executor loss and
    cuts lineage). Without: ``checkpoint()`` into the session's checkpoint folder.
    """
    if path is None:
        return df.checkpoint(eager=True)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_beta(spark: SparkSession, path: str, dataset: str, p: float, beta) -> None:
    """Store beta_opt for (dataset, p) as rows (dataset, p, j, beta), partitioned by dataset."""
    rows = [(dataset, float(p), j, float(b)) for j, b in enumerate(beta)]
    df = spark.createDataFrame(rows, "dataset STRING, p DOUBLE, j INT, beta DOUBLE")
    df.write.mode("append").partitionBy("dataset").parquet(path)


def load_beta(spark: SparkSession, path: str, dataset: str, p: float):
    """The stored beta_opt (latest write wins per j is not needed: one write per key)."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return None
    rows = (stored.filter((F.col("dataset") == dataset) & (F.col("p") == float(p)))
            .select("j", "beta").collect())
    if not rows:
        return None
    import numpy as np

    out = np.zeros(max(r["j"] for r in rows) + 1)
    for r in rows:
        out[r["j"]] = r["beta"]
    return out


def max_run(spark: SparkSession, path: str, fmt: str = "parquet") -> int:
    try:
        r = spark.read.option("header", "true") if fmt == "csv" else spark.read
        v = r.format(fmt).load(path).agg(F.max("run")).collect()[0][0]
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return 0
    return int(v or 0)


def _hadoop(spark: SparkSession, path: str):
    """(file system, Path class) of ``path``."""
    jvm = spark.sparkContext._jvm
    cls = jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), cls


def _create_new(fs, at) -> bool:
    """Make an empty file; False if it is there already. One of several writers succeeds: local and mounted files by an
    exclusive open, others by the store's own create without overwriting (atomic on HDFS)."""
    import os

    from py4j.protocol import Py4JJavaError

    uri = at.toUri()
    if (uri.getScheme() or fs.getUri().getScheme()) == "file":
        try:
            os.close(os.open(uri.getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(at, False).close()
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    return True


def claim_runs(spark: SparkSession, path: str, runs, fmt: str = "parquet") -> int:
    """The offset m under which all run numbers m + r are this writer's alone.

    A run number is claimed by an empty file of its name in ``path/_claims``. The offset starts from the largest run
    written or claimed; if another writer takes one of the numbers meanwhile, the next try starts above its claims,
    and the numbers claimed in vain stay unused.
    """
    fs, cls = _hadoop(spark, path)
    folder = cls(f"{path}/_claims")
    fs.mkdirs(folder)
    while True:
        taken = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
        m = max([max_run(spark, path, fmt), *taken])
        if all(_create_new(fs, cls(folder, str(m + r))) for r in sorted(runs)):
            return m


def append_with_run_offset(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Run += largest run so far, then append (one folder a run; parquet or csv with header).

    Safe with several writers: the run numbers are claimed first (``claim_runs``), the rows written to a folder of
    their own, and each finished run folder renamed into place, where nobody else's can be.
    """
    import uuid

    spark = df.sparkSession
    runs = [r["run"] for r in df.select(F.col("run").cast("int").alias("run")).distinct().collect()]
    m = claim_runs(spark, path, runs, fmt) if runs else max_run(spark, path, fmt)
    out = df.withColumn("run", (F.col("run") + F.lit(m)).cast("int"))
    if not runs:
        return out
    staging = f"{path}/_staging-{uuid.uuid4().hex[:12]}"
    w = out.write.partitionBy("run")
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(staging)
    fs, cls = _hadoop(spark, path)
    for r in sorted(runs):
        if not fs.rename(cls(f"{staging}/run={m + r}"), cls(f"{path}/run={m + r}")):
            raise OSError(f"run {m + r} could not be moved into {path}")
    fs.delete(cls(staging), True)
    return out


def write_runs(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """One folder per run, the next run numbers after the ones present."""
    return append_with_run_offset(df, path, fmt)
