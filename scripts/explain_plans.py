"""Print the physical plans of the main jobs (scan pruning, partial aggregation, top-k)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from corelev.functions import random as R  # noqa: E402
from corelev.operators import moments as MO  # noqa: E402
from corelev.operators import sampling as SM  # noqa: E402
from corelev.operators import scores as S  # noqa: E402
from corelev.session import get_session  # noqa: E402
from corelev.sources import tables as T  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = get_session("local[8]", 8)
des = T.lineitem_design(spark, sf)
df = des.df


def show(title, d):
    print("=" * 20, title)
    d.explain("formatted")


show("gram (native)", MO.gram_table(df, des.d))
show("leverage projection", S.leverage_scores(df, d=des.d).select("id", "score"))
sc = S.leverage_scores(df, d=des.d)
key = SM.race_key(F.col("score"), 0, "lev")
show("race candidates -> top-k", sc.withColumn("_k", key).filter(F.col("_k") <= 1e4).orderBy("_k", "id").limit(500))
show("countsketch", S.countsketch_table(df, 25, des.d))
ex = sc.withColumn("run", F.explode(F.array(*[F.lit(r) for r in (1, 2, 3)])))
from pyspark.sql import Window  # noqa: E402
w = Window.partitionBy("run").orderBy("_k", "id")
show("multi-sample window", ex.withColumn("_k", key).filter(F.col("_k") <= 1e4)
     .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 300))
