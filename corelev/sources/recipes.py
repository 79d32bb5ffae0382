"""Design recipes of the reference's public datasets (A10-A13), as DesignSpecs.

The recipes apply to any DataFrame with these columns (downloading is not part
of the library; read the files with ``files.read_csv`` / ``files.read_libsvm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .design import Design, DesignSpec, build_design

# fixed values: continuous columns of the cover type table (scaled); all other
# columns except Cover_Type are 0/1 indicators kept as they are
COVERTYPE_CONTINUOUS = [
    "Elevation", "Aspect", "Slope", "Horizontal_Distance_To_Hydrology",
    "Vertical_Distance_To_Hydrology", "Horizontal_Distance_To_Roadways", "Hillshade_9am",
    "Hillshade_Noon", "Hillshade_3pm", "Horizontal_Distance_To_Fire_Points",
]

# fixed values: continuous columns of the intrusion-detection table (num_outbound_cmds is dropped)
KDD_CONTINUOUS = [
    "duration", "src_bytes", "dst_bytes", "wrong_fragment", "urgent", "hot", "num_failed_logins",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
    "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]
KDD_DROP = ["num_outbound_cmds"]


def covertype_design(df: DataFrame, id_col: str, intercept: bool = True) -> Design:
    """Scale the 10 continuous columns, keep binary ones (schema order), y = +1 iff class 2."""
    binary = [c for c in df.columns if c not in COVERTYPE_CONTINUOUS and c not in ("Cover_Type", id_col)]
    feats = {c: c for c in COVERTYPE_CONTINUOUS + binary}
    spec = DesignSpec(id=id_col, features=feats, label=F.col("Cover_Type") == 2,
                      standardize=COVERTYPE_CONTINUOUS, intercept=intercept)
    return build_design(df, spec)


def kddcup_design(df: DataFrame, id_col: str, label_col: str = "labels", intercept: bool = True) -> Design:
    """33 scaled continuous columns; y = -1 iff label 'normal.'."""
    spec = DesignSpec(id=id_col, features={c: c for c in KDD_CONTINUOUS}, drop=KDD_DROP,
                      label=F.col(label_col) != "normal.", intercept=intercept)
    return build_design(df, spec)


def webspam_design(df: DataFrame, id_col: str, label_col: str = "LABEL", drop_sparse_columns: bool = True,
                   intercept: bool = True) -> Design:
    """Numeric table; drop constant (and single-non-zero) columns; scale."""
    feats = {c: c for c in df.columns if c not in (label_col, id_col)}
    spec = DesignSpec(id=id_col, features=feats, label=F.col(label_col) > 0, drop_constant=True,
                      drop_single_nonzero=drop_sparse_columns, intercept=intercept)
    return build_design(df, spec)


# fixed values: the 2-D example's cluster centres, sizes and spreads
EXAMPLE_CENTERS = [(-1.0, -1.0), (1.0, 1.0), (4.5, 5.0)]
EXAMPLE_SIZES = [80, 80, 15]
EXAMPLE_STD = [1.0, 1.0, 0.5]


def example_2d(spark: SparkSession, seed: int = 1, scale: int = 1) -> DataFrame:
    """A10: three Gaussian clusters (sizes x scale); cluster 2 joins class 0; y = 2c - 1; + intercept."""
    from ..functions import random as R

    sizes = [s * scale for s in EXAMPLE_SIZES]
    total = sum(sizes)
    ids = spark.range(total).withColumnRenamed("id", "id")
    c = F.when(F.col("id") < sizes[0], 0).when(F.col("id") < sizes[0] + sizes[1], 1).otherwise(2)
    df = ids.withColumn("c", c)
    cx = F.element_at(F.array(*[F.lit(v[0]) for v in EXAMPLE_CENTERS]), F.col("c") + 1)
    cy = F.element_at(F.array(*[F.lit(v[1]) for v in EXAMPLE_CENTERS]), F.col("c") + 1)
    sd = F.element_at(F.array(*[F.lit(v) for v in EXAMPLE_STD]), F.col("c") + 1)
    x0 = cx + sd * R.normal("id", seed, "ex:x")
    x1 = cy + sd * R.normal("id", seed, "ex:y")
    lab = F.when(F.col("c") == 2, 0).otherwise(F.col("c"))
    return df.select("id", (F.lit(2) * lab - 1).cast("int").alias("y"), F.lit(1.0).alias("w"),
                     F.array(x0, x1, F.lit(1.0)).alias("x"))
