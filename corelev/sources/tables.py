"""Design specs over the driver's test tables (FIXTURES.md part 2).

Each function reads only the columns it needs (pruned at the parquet scan) and
returns a ``Design``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .design import Design, DesignSpec, build_design, rounded

LINEITEM_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "_ship", "_price"]  # unique together only
L4_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_keys(df: DataFrame) -> DataFrame:
    """The ship time in microseconds and the price in cents, which the row id takes with four keys."""
    return df.withColumn("_ship", F.unix_micros(F.col("l_shipdate").cast("timestamp"))).withColumn(
        "_price", rounded(F.col("l_extendedprice") * 100, 0).cast("long"))


def lineitem_id():
    """The row id as one string column over ``lineitem``."""
    parts = [F.col(c) for c in LINEITEM_ID[:4]]
    parts += [F.unix_micros(F.col("l_shipdate").cast("timestamp")), F.round(F.col("l_extendedprice") * 100).cast("long")]
    return F.concat_ws(":", *[c.cast("string") for c in parts])


def lineitem_design(spark, sf_dir, features=None, intercept=True) -> Design:
    """L4: standardised lineitem measures + intercept, y = +1 iff returnflag 'R'."""
    feats = list(features or L4_FEATURES)
    df = lineitem_keys(table(spark, sf_dir, "lineitem")).withColumn(
        "_ord", F.col("l_orderkey") * F.lit(8) + F.col("l_linenumber"))
    spec = DesignSpec(id=LINEITEM_ID, features={f: f for f in feats}, order="_ord",
                      label=F.col("l_returnflag") == "R", intercept=intercept)
    return build_design(df, spec)


def orders_design(spark, sf_dir) -> Design:
    """O1: standardised total price + intercept, y = +1 iff status 'F'."""
    df = table(spark, sf_dir, "orders")
    spec = DesignSpec(id="o_orderkey", features={"o_totalprice": "o_totalprice"},
                      label=F.col("o_orderstatus") == "F")
    return build_design(df, spec)


MKT_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def customer_design(spark, sf_dir, drop_constant=True, drop_single_nonzero=True) -> Design:
    """Nation key (scaled) + one-hot market segment (unscaled) + intercept; rank deficient."""
    df = table(spark, sf_dir, "customer")
    feats = {"c_nationkey": "c_nationkey"}
    for s in MKT_SEGMENTS:
        feats[f"seg_{s.lower()}"] = (F.col("c_mktsegment") == s).cast("double")
    spec = DesignSpec(id="c_custkey", features=feats, label=F.col("c_acctbal") > 0,
                      standardize=["c_nationkey"], drop_constant=drop_constant,
                      drop_single_nonzero=drop_single_nonzero)
    return build_design(df, spec)


def events_design(spark, sf_dir, key: bool = False) -> Design:
    """EV: standardised value + intercept ordered by event_id, y = +1 iff 'error'."""
    df = table(spark, sf_dir, "events")
    spec = DesignSpec(id="event_id", order="event_id", features={"value": "value"},
                      label=F.col("event_type") == "error", extra=(["user_id"] if key else []))
    return build_design(df, spec)


def embeddings_design(spark, sf_dir, intercept=False) -> Design:
    """64-wide embedding as is, y = +1 iff label 3 (the Arrow path)."""
    from .design import label_pm1, validate_design

    df = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    if intercept:
        x = F.concat(x, F.array(F.lit(1.0)))
    out = df.select(F.col("vec_id").alias("id"), label_pm1(F.col("label") == 3).alias("y"),
                    F.lit(1.0).alias("w"), x.alias("x"))
    info = validate_design(out)
    return Design(out, [f"e{i}" for i in range(info["d"] - (1 if intercept else 0))], info["n"],
                  info["n_pos"], info["n_neg"], intercept=intercept)


LANGS = ["de", "en", "es", "fr"]


def documents_design(spark, sf_dir) -> Design:
    """DL: documents joined to labels; n_chars (scaled) + one-hot lang; y = 2 quality - 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    df = docs.join(labels, "doc_id")
    feats = {"n_chars": "n_chars"}
    for lg in LANGS:
        feats[f"lang_{lg}"] = (F.col("lang") == lg).cast("double")
    from .design import label_from01

    spec = DesignSpec(id="doc_id", features=feats, label=label_from01(F.col("quality")),
                      label_is_condition=False, standardize=["n_chars"], intercept=False)
    return build_design(df, spec)
