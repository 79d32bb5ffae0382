"""Shards by balanced label propagation: linked documents move to their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelev.llm.common import table, written


def equal_text_links(rows: DataFrame) -> DataFrame:
    """Star links (a, b): b is the first row of a's group of equal texts. ``rows``: _rid, _text_key."""
    hub = rows.groupBy("_text_key").agg(F.min("_rid").alias("_hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return (rows.join(hub, "_text_key").where("_rid <> _hub").select(F.col("_rid").alias("a"), F.col("_hub").alias("b")))


def propagate(nodes: DataFrame, links: DataFrame, shards: int, max_rounds: int = 400, slack: float = 0.02) -> DataFrame:
    """Labels (_rid, _shard) of balanced label propagation, run until no node gains by a move.

    ``nodes``: _rid, _start (first shard). ``links``: a, b (undirected). Each round joins the links
    with the labels, counts every node's links into each shard, and lets a node move to the shard
    with most of its links if that is more than in its own. About half of the nodes (by a hash of node and
    round) may move in a round, so that two ends of a link don't swap for ever. Per (from, to) pair
    the opposite flow plus ``slack`` of a shard's fair size is the quota; where more want to move, a
    hash decides, with a threshold that makes the expected number the quota. No group is collected.
    A quota admits one node at least, so whoever gains by a move gets it in some round: with star
    links every group ends whole. ``max_rounds`` only stops links on which labels go in circles:
    RuntimeError if nodes still want to move then.
    """
    labels = written(nodes.select("_rid", F.col("_start").alias("_shard")), "shard0")
    total = labels.count()
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    for r in range(max_rounds + 1):
        near = (both.join(labels.withColumnRenamed("_rid", "b").withColumnRenamed("_shard", "to"), "b")
                .groupBy("a", "to").agg(F.count(F.lit(1)).alias("n")))
        best = near.groupBy("a").agg(F.max(F.struct("n", -F.col("to"))).alias("m"), F.map_from_entries(
            F.collect_list(F.struct("to", "n"))).alias("by"))  # at most one entry a shard
        want = (labels.join(best, F.col("_rid") == F.col("a"))
                .select("_rid", F.col("_shard").alias("frm"), (-F.col("m.col2")).alias("to"),
                        (F.col("m.n") - F.coalesce(F.expr("by[_shard]"), F.lit(0))).alias("gain"))
                .where("gain > 0").withColumn("now", F.pmod(F.xxhash64("_rid", F.lit(r)), F.lit(2)) == 0))
        want = written(want, f"want{r}")
        asked = want.groupBy("frm", "to").agg(F.count(F.lit(1)).alias("all"), F.count_if("now").alias("c")).collect()
        if not asked:
            return labels
        if r == max_rounds:
            raise RuntimeError(f"{sum(x['all'] for x in asked)} nodes still want to move after {max_rounds} rounds")
        want = want.where("now")
        flow = {(x["frm"], x["to"]): x["c"] for x in asked if x["c"]}
        if not flow:
            continue
        room = max(1.0, slack * total / shards)
        share = {p: min(1.0, (flow.get((p[1], p[0]), 0) + room) / c) for p, c in flow.items()}
        quota = F.create_map(*[F.lit(v) for (f, t), s in share.items() for v in (f"{f}>{t}", float(s))])
        dice = F.pmod(F.xxhash64("_rid", F.lit(-1 - r)), F.lit(1_000_003)) / 1_000_003.0
        move = want.where(dice < quota[F.concat_ws(">", "frm", "to")]).select("_rid", F.col("to").alias("_to"))
        labels = written(labels.join(move, "_rid", "left").select("_rid", F.coalesce("_to", "_shard").alias("_shard")), f"shard{r + 1}")


def shard(docs: DataFrame, shards: int = 8, max_rounds: int = 400, id_col: str = "doc_id", text_col: str = "text",
          links: DataFrame | None = None) -> DataFrame:
    """Put every row of ``docs`` into a shard, law ``rows``: sizes at most one row apart, few cut links.

    Links join equal texts (null counts as a text of its own) or come as ``links`` (a, b: ids).
    After ``propagate`` the rows are ordered by (label, group, id, text checksum) and cut into even
    ranges, which moves only what is over a shard's quota and splits at most one group a border:
    all other groups of equal texts are whole.

    Returns the id column, size (UTF-8 bytes plus 1, null 1), text_crc32, law, shard, slot (gapless
    from 0 in each shard), grown_shard (null under this law). Null ids are allowed and sort first;
    repeated rows are rows of their own; an empty table gives an empty result; other columns,
    whatever their names, are not read. Texts are read once; only ids, sizes and checksums move.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    raw = docs.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"),
                      F.crc32(text.cast("binary")).alias("_crc"),
                      F.unhex(F.md5(F.concat(F.when(F.col(f"`{text_col}`").isNull(), "n").otherwise("t"), text).cast("binary"))).alias("_text_key"))
    rows = written(raw.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    if links is None:
        links = equal_text_links(rows)
    else:
        ids = rows.select("_id", "_rid")
        links = (links.join(ids.toDF("a", "_a"), "a").join(ids.toDF("b", "_b"), "b")
                 .select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    start = F.pmod(F.xxhash64("_rid"), F.lit(shards)).cast("int")
    labels = propagate(rows.select("_rid", start.alias("_start")), links, shards, max_rounds)
    placed = rows.join(labels, "_rid")
    order = ["_shard", "_text_key", F.col("_id").asc_nulls_first(), "_rid"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    line = (placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .withColumn("_at", F.monotonically_increasing_id()))
    line = written(line, "line")
    at, part = F.col("_at"), F.shiftright("_at", 33)
    counts = sorted((x["p"], x["c"]) for x in line.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    before, total = {}, 0
    for p, c in counts:
        before[p], total = total, total + c
    spark = rows.sparkSession
    start = F.broadcast(spark.createDataFrame([(p, b) for p, b in before.items()] or [(0, 0)], "_p long, _before long"))
    rank = F.col("_before") + at.bitwiseAND(F.lit((1 << 33) - 1))
    base, extra = divmod(total, shards)
    edge = extra * (base + 1)
    shard_of = F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / F.lit(base + 1))).otherwise(
        F.lit(extra) + F.floor((F.col("_rank") - edge) / F.lit(max(1, base)))).cast("int")
    first = F.when(F.col("shard") <= extra, F.col("shard") * (base + 1)).otherwise(F.lit(edge) + (F.col("shard") - extra) * base)
    return (line.join(start, part == F.col("_p")).withColumn("_rank", rank).withColumn("shard", shard_of)
            .select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                    F.lit("rows").alias("law"), "shard", (F.col("_rank") - first).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7 under the law ``rows``."""
    return shard(table(spark, sf_dir, "documents"))
