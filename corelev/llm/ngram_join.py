"""Exact n-gram Jaccard self-join with set-relation skipping.

Candidates come from prefix lists: a set's rarest shingles, by the number of blocks' sets that hold
them. Lists are read in blocks of similar set size, and by position; and a set's answers follow,
where they can, from those of a similar set that has been answered before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelev.llm.common import WordHash, sliced, table, utf8, written

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: A block's shingle held by more of its sets than this keeps its list in the block and sends only its count.
_HOT = 64
_NONE = 65535


def shingles(text: bytes, hashes: WordHash, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased).

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    words = text.lower().split()  # of bytes: exactly these blanks, and only A-Z
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(a))
    with np.errstate(over="ignore"):
        z = np.full(len(a) - k + 1, k, np.uint64) if k < width else np.zeros(len(a) - k + 1, np.uint64)
        for j in range(k):
            z += a[j: j + len(z)] * (_MIX[j % len(_MIX)] + np.uint64(2 * (j // len(_MIX))))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.unique(z ^ (z >> np.uint64(31)))


def set_id(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _short(tokens: np.ndarray) -> bytes:
    """The low 40 bits of each, in 5 bytes."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


_PARTS = "bucket long, block long, ids array<long>, keys array<long>, x0 binary, x1 binary, x2 binary, x3 binary"


def _row(bucket, block, ids, keys, *x):
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                       pa.array([keys], pa.list_(pa.int64()))] + [pa.array([v], pa.binary()) for v in x],
                                      ["bucket", "block", "ids", "keys", "x0", "x1", "x2", "x3"])


def _block_parts(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """Each block's documents (bucket < 0: ids, text keys, sets, sizes, lists of the block's hot shingles), and for each bucket its sets' shingles."""

    def run(batches):
        from pyspark import TaskContext

        hashes, part = WordHash(), TaskContext.get().partitionId()
        for seq, b in enumerate(sliced(batches, 10_000, 8 << 20)):
            block = (part << 32) + seq
            seen, tok, doc, nodes, sizes = set(), [], [], [], []
            for d, t in enumerate(utf8(b.column(2))):
                s = shingles(t, hashes, width)
                nodes.append(set_id(s) if len(s) else 0)
                sizes.append(len(s))
                if len(s) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    tok.append(s)
                    doc.append(d)
            hashes.tidy()
            own = np.repeat(np.array(doc, np.uint16), [len(s) for s in tok])
            tok = np.concatenate(tok) if tok else np.zeros(0, np.uint64)
            o = np.argsort(tok, kind="stable")
            tok, own = tok[o], own[o]
            first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])) if len(tok) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(tok)))
            hot = np.repeat(count > _HOT, count)
            yield _row(-1 - (hash(block) % 1_000_003), block, b.column(0).to_pylist(), b.column(1).to_pylist(), np.array(nodes, np.int64).tobytes(),
                       np.array(sizes, np.int32).tobytes(), tok[hot].tobytes(), own[hot].tobytes())
            many, times = tok[first[count > _HOT]], count[count > _HOT]
            tok, own = tok[~hot], own[~hot]
            at, at_many = (tok >> np.uint64(40)) % np.uint64(buckets), (many >> np.uint64(40)) % np.uint64(buckets)
            o, om = np.lexsort((own, at)), np.argsort(at_many, kind="stable")
            edge, edge_m = np.searchsorted(at[o], np.arange(buckets + 1)), np.searchsorted(at_many[om], np.arange(buckets + 1))
            for k in range(buckets):
                i, j = o[edge[k]: edge[k + 1]], om[edge_m[k]: edge_m[k + 1]]
                if len(i) or len(j):
                    yield _row(k, block, None, None, _short(tok[i]), np.diff(own[i], prepend=np.uint16(0)).tobytes(), _short(many[j]), times[j].astype(np.uint16).tobytes())

    return docs.mapInArrow(run, _PARTS)


def _shared(parts: DataFrame) -> DataFrame:
    """For each bucket, the shingles that several blocks' sets hold: block, their keys, document numbers, counts. Other rows pass."""

    def count(bucket, rows):
        blocks = np.array([r["block"] for r in rows], np.int64)
        cold, hot = [_long(r["x0"]) for r in rows], [_long(r["x2"]) for r in rows]
        doc = [np.cumsum(np.frombuffer(r["x1"], np.uint16), dtype=np.uint16) for r in rows]
        times = [np.frombuffer(r["x3"], np.uint16) for r in rows]
        at = np.repeat(np.tile(np.arange(len(rows), dtype=np.int32), 2), [len(x) for x in cold + hot])
        tok = np.concatenate(cold + hot)
        doc = np.concatenate(doc + [np.full(len(h), _NONE, np.uint16) for h in hot])
        weight = np.concatenate([np.ones(len(x), np.uint16) for x in cold] + times)
        o = np.argsort(tok, kind="stable")
        tok, at, doc = tok[o], at[o], doc[o]
        first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        level = np.minimum(np.add.reduceat(weight[o], first, dtype=np.int64), 255).astype(np.uint8)  # orders the shingles; ties go by key
        level = np.repeat(level, np.diff(np.append(first, len(tok))))
        del cold, hot, weight, o
        keep = np.flatnonzero(level > 1)
        keep = keep[np.argsort(at[keep], kind="stable")]
        edge = np.searchsorted(at[keep], np.arange(len(rows) + 1))
        for r in range(len(rows)):
            i = keep[edge[r]: edge[r + 1]]
            if len(i):
                yield _row(bucket, int(blocks[r]), None, None, _short(tok[i]), doc[i].tobytes(), level[i].tobytes(), b"")

    def run(batches):
        bucket, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] < 0:
                    yield _row(*r.values())
                    continue
                if r["bucket"] != bucket and rows:
                    yield from count(bucket, rows)
                    rows = []
                bucket = r["bucket"]
                rows.append(r)
        if rows:
            yield from count(bucket, rows)

    return parts.mapInArrow(run, _PARTS)


def _postings(shared: DataFrame, percent: int) -> DataFrame:
    """Prefix lists: key, node (set), n (its size), m (its shingles that several sets hold), pos (the shingle's rank in it: rarest first, shingles of one set before all others)."""

    def one(rows):
        meta = next(r for r in rows if r["bucket"] < 0)
        nodes, n = np.frombuffer(meta["x0"], np.int64), np.frombuffer(meta["x1"], np.int32).astype(np.int64)
        got = [r for r in rows if r["bucket"] >= 0]
        key = np.concatenate([_long(r["x0"]) | np.uint64(r["bucket"] << 40) for r in got]) if got else np.zeros(0, np.uint64)
        doc = np.concatenate([np.frombuffer(r["x1"], np.uint16) for r in got]) if got else np.zeros(0, np.uint16)
        df = np.concatenate([np.frombuffer(r["x2"], np.uint8) for r in got]) if got else np.zeros(0, np.uint8)
        hot_tok, hot_doc = np.frombuffer(meta["x2"], np.uint64), np.frombuffer(meta["x3"], np.uint16)
        if len(hot_tok):  # spread the block's hot shingles over its documents
            spread = np.flatnonzero(doc == _NONE)
            hk = key[spread] & np.uint64((1 << 40) - 1)
            o = np.argsort(hk, kind="stable")
            low = hot_tok & np.uint64((1 << 40) - 1)
            a, z = np.searchsorted(hk[o], low, "left"), np.searchsorted(hk[o], low, "right")
            reps = z - a
            src = np.repeat(a, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            add = spread[o[src]]
            key2, df2, doc2 = key[add], df[add], np.repeat(hot_doc, reps)
            keep = doc != _NONE
            key, df, doc = np.concatenate([key[keep], key2]), np.concatenate([df[keep], df2]), np.concatenate([doc[keep], doc2])
        o = np.lexsort((key, df, doc))
        key, doc = key[o], doc[o].astype(np.int64)
        shared_n = np.bincount(doc, minlength=len(n))
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(shared_n) - shared_n, shared_n) + np.repeat(np.maximum(n - shared_n, 0), shared_n)
        keep = rank < (n - -(-percent * n // 100) + 1)[doc]
        d = doc[keep]
        return pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(nodes[d]), pa.array(n[d]), pa.array(shared_n[d]), pa.array(rank[keep])], ["key", "node", "n", "m", "pos"])

    def run(batches):
        block, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != block and rows:
                    yield one(rows)
                    rows = []
                block = r["block"]
                rows.append(r)
        if rows:
            yield one(rows)

    post = shared.mapInArrow(run, "key long, node long, n long, m long, pos long")
    return post.groupBy("key", "node").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.min("pos").alias("pos"))


def _useful(post: DataFrame, percent: int) -> DataFrame:
    """The lists of several sets, without the entries too late in their set for any size in the list.

    Two sets that link meet in the first shingle they share, and none of what either holds before it
    counts for the overlap: so it is enough that a pair finds each other there.
    """
    lists = post.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("key", "least")
    return post.join(lists, "key").where((100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + F.col("least"))).drop("least")


def connected(links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root): the least node that links (a, b) reach, for nodes with links.

    Each round every node points to its least neighbour, pointers are followed twice, and the links
    are drawn anew between what they point to; links within one are done. So each round's links are
    at most the last one's, and usually far fewer. Rounds are written.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    lab = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        to = written(to, name)
        for _ in range(2):
            to = to.join(to.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        to = written(to, name)
        if lab is None:
            lab = to.select("node", F.col("to").alias("root"))
        else:
            lab = lab.join(to.toDF("root", "far"), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
        lab = written(lab, name)
        x = edges.join(to.toDF("a", "ta"), "a").join(to.toDF("b", "tb"), "b").where("ta <> tb")
        edges = written(x.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), name)
    if lab is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return lab


def _verified(pairs: DataFrame, sets: DataFrame, small: int = 400_000) -> DataFrame:
    """Pairs (a, b, na, nb) with their overlap. Only sets that stand in a pair are moved: up to ``small`` names of
    them are broadcast to find these, more are joined."""
    names = written(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().toDF("node"), "names")
    sets = sets.join(F.broadcast(names) if names.count() <= small else names, "node", "left_semi").select("node", "tokens")
    both = (pairs.join(sets.toDF("a", "_ta"), "a").join(sets.toDF("b", "_tb"), "b").select("a", "b", "na", "nb", "_ta", "_tb"))

    def run(batches):
        for b in sliced(batches, 4000):
            n = []
            for x, y in zip(utf8(b.column(4)), utf8(b.column(5))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                i = np.searchsorted(y, x)
                n.append(int((y[i.clip(max=len(y) - 1)] == x).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64())], ["a", "b", "na", "nb", "ov"])

    return both.mapInArrow(run, "a long, b long, na long, nb long, ov long")


def _links(post: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (node, comp) of the sets in the prefix lists.

    In each round some sets of each list lead (1, then 4, 16, ...; those first whose lists hold most)
    and are held against the list's other sets that aren't in their component yet; so when a list is
    through, each two of its sets are linked through others or have been compared. Before, each set
    is held against one of the first leaders only, that of most of its lists: a large group of near copies
    becomes one component by about one comparison a set. Lists that are through, or within one
    component, stay so and are not read again. Skipped are
      * blocks of sets whose size can't fit (lists are keyed by shingle and size block),
      * entries whose positions in the two sets leave too little room behind them for the overlap
        (``_useful``), and sets with too few shingles that other sets hold,
      * pairs whose answer follows from those of a set that both have been compared with: with the
        overlaps o(p, x) and o(p, y) known, o(x, y) is at least o(p, x) + o(p, y) - |p| and at most
        min(o(p, x), o(p, y)) + min(m(x) - o(p, x), m(y) - o(p, y)), where m counts a set's shingles
        that other sets hold too.
    The others are compared on their whole sets. A set's ``p`` is the leader of its first round that
    it shares most with, so all near copies of a text have the same one.
    """
    t, u = percent, 100 + percent
    size_block = F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int")
    lists = post.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    heavy = post.join(lists, "key").groupBy("node").agg(F.sum("c").alias("wt"))
    post = written(post.join(lists.select("key"), "key").withColumn("s", size_block).join(heavy, "node"), "lists")
    comps = written(post.select("node", F.col("node").alias("comp")).distinct(), "comp")
    known = written(comps.select("node", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("pn"), F.lit(None).cast("long").alias("po")).limit(0), "known")
    done, lead, one = 0, 1, True
    while True:
        cur = post.join(comps, "node").join(known, "node", "left")
        live = cur.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where((F.col("lo") != F.col("hi")) & (F.col("c") > done + 1))
        cur = written(cur.join(live.select("key", "c"), "key"), "live")
        if not cur.limit(1).count():
            return comps
        post = cur.select(*post.columns)
        order = Window.partitionBy("key").orderBy(F.desc("wt"), "node")
        front = cur.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= done + lead).where(F.col("rn") > done)
        side = ["node", "n", "m", "pos", "comp", "p", "pn", "po"]
        front = front.select("key", *[F.col(c).alias(f"l_{c}") for c in side], F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)).alias("s"))
        room = F.least(F.col("l_n") - F.col("l_pos"), F.col("n") - F.col("pos"))
        need = t * (F.col("n") + F.col("l_n"))
        shared = F.coalesce(F.col("p") == F.col("l_p"), F.lit(False))
        most = F.least("po", "l_po") + F.greatest(F.lit(0), F.least(F.col("m") - F.col("po"), F.col("l_m") - F.col("l_po")))
        sure = shared & (u * (F.col("po") + F.col("l_po") - F.col("pn")) >= need)
        fit = ((F.col("comp") != F.col("l_comp")) & (100 * F.least("n", "l_n") >= t * F.greatest("n", "l_n")) & (u * room >= need) & (u * F.least("m", "l_m") >= need)
               & (~shared | (u * most >= need)))
        swap = F.col("node") < F.col("l_node")
        met = cur.join(front, ["key", "s"]).where(fit)
        if one:
            met = (met.groupBy("node", "l_node", "n", "l_n", sure.alias("sure")).count()
                   .groupBy("node").agg(F.max(F.struct("count", "l_node", "n", "l_n", "sure")).alias("x")).select("node", "x.*"))
        pairs = (met.select(F.when(swap, F.col("node")).otherwise(F.col("l_node")).alias("a"), F.when(swap, F.col("l_node")).otherwise(F.col("node")).alias("b"),
                         F.when(swap, F.col("n")).otherwise(F.col("l_n")).alias("na"), F.when(swap, F.col("l_n")).otherwise(F.col("n")).alias("nb"), (F.col("sure") if one else sure).alias("sure"))
                 .distinct())
        pairs = written(pairs, "pairs")
        found = written(_verified(pairs.where("not sure").select("a", "b", "na", "nb"), sets), "overlaps")
        edges = found.where(u * F.col("ov") >= t * (F.col("na") + F.col("nb"))).select("a", "b").unionByName(pairs.where("sure").select("a", "b"))
        leads = front.select(F.col("l_node").alias("p")).distinct()
        two = (found.select(F.col("a").alias("node"), F.col("b").alias("p"), F.col("nb").alias("pn"), F.col("ov").alias("po"))
               .unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("p"), F.col("na").alias("pn"), F.col("ov").alias("po")))
               .join(leads, "p", "left_semi").join(known, "node", "left_anti"))
        own = found.select(F.col("a").alias("node"), F.col("na").alias("pn")).unionByName(found.select(F.col("b").alias("node"), F.col("nb").alias("pn"))).distinct()
        own = own.join(leads.withColumnRenamed("p", "node"), "node", "left_semi").join(known, "node", "left_anti").select("node", F.col("node").alias("p"), "pn", F.col("pn").alias("po"))
        best = two.unionByName(own).groupBy("node").agg(F.max(F.struct("po", "p", "pn")).alias("m")).select("node", "m.p", "m.pn", "m.po")
        known = written(known.unionByName(best), "known")
        merged = (edges.join(comps.toDF("a", "ca"), "a").join(comps.toDF("b", "cb"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        merged = written(merged, "edges")
        if merged.limit(1).count():
            comps = written(comps.join(connected(merged).toDF("comp", "root"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "comp")
        if one:
            one = False  # the same leaders again, now all of them
        else:
            done, lead = done + lead, lead * 4


def set_components(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 12 << 20, small: int = 400_000) -> DataFrame:
    """One row a document: doc_id, text_key, n_shingles, component_id (least id reachable by links), component, representative.

    Documents with equal sets are one node; two nodes link when 100 * overlap >= percent * union.
    Texts without words (null and empty ones too) have no shingles and are alone: component is null
    and component_id their own id. Null ids don't count for the least id; a component of null ids
    only has a null one. ``representative`` marks one row a component, the one with the least id
    (repeated rows: all of that id and text). Repeated rows share their component; an empty table
    gives no rows; other columns are not read.

    Shingle counts are gathered by bucket (``bucket_bytes`` of text each), so the number of buckets
    grows with the input; a shingle that very many documents hold is counted in its block first.
    Up to ``small`` documents that share a prefix shingle with another set (24 bytes each) are
    broadcast to fetch their texts; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("t"))
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = _block_parts(src, buckets, width).repartition(max(parts, buckets), "bucket").sortWithinPartitions("bucket")
    shared = written(_shared(dealt), "shared")

    def members(batches):
        for b in batches:
            for r in b.to_pylist():
                n = np.frombuffer(r["x1"], np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["keys"], pa.int64()), pa.array(np.frombuffer(r["x0"], np.int64), mask=n == 0), pa.array(n)],
                                                 ["doc_id", "text_key", "node", "n_shingles"])

    of = written(shared.where("bucket < 0").select("ids", "keys", "x0", "x1").mapInArrow(members, "doc_id long, text_key long, node long, n_shingles long"), "members")
    post = _postings(shared.repartition(parts, "block").sortWithinPartitions("block"), percent)
    post = written(post, "post")
    post = written(_useful(post, percent), "post2")
    wanted = post.select("node").distinct()
    first = (of.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")).alias("m"))
             .select("node", F.col("m.doc_id").alias("_id"), F.col("m.text_key").alias("_key")))
    first = written(first, "first")
    if first.count() <= small:
        first = F.broadcast(first)
    texts = (src.join(first, F.col("i").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_key"))).select("node", "t"))

    def tokens(batches):
        hashes = WordHash()
        for b in sliced(batches, 2000):
            s = [shingles(x, hashes, width) for x in utf8(b.column(1))]
            hashes.tidy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in s], pa.binary())], ["node", "tokens"])

    sets = written(texts.mapInArrow(tokens, "node long, tokens binary").dropDuplicates(["node"]), "sets")
    comps = _links(post, sets, percent)
    rows = of.join(comps, "node", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("comp", "node").alias("component"))
    rows = written(rows, "rows")
    least = (rows.where("component is not null").groupBy("component")
             .agg(F.min("doc_id").alias("_least"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")).alias("_m")))
    return (rows.join(least, "component", "left")
            .select("doc_id", "text_key", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"), "component",
                    (F.col("component").isNull() | (F.col("doc_id").eqNullSafe(F.col("_m.doc_id")) & (F.col("text_key") == F.col("_m.text_key")))).alias("representative")))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: shingle set sizes and components of links at 0.75."""
    return set_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
l2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS d, doc_id AS root FROM n UNION SELECT c.d, l2.b FROM c JOIN l2 ON c.root = l2.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(c.root) AS component_id FROM n JOIN c ON c.d = n.doc_id GROUP BY ALL
"""
