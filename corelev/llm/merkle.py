"""Merkle manifest of a data set: an append log of tree nodes in postorder, and proofs read from it by position.

Rows are leaves of one tree a group (its *tree*), ordered by id; the trees' roots, in order of their
names, are the leaves of the top tree. A node is ``H`` of its two children, the last node of an odd level
``H`` of its only child; a tree of one leaf is that leaf. ``H`` is sha256 over the hex digests, as hex text.

Builders are aligned: each takes 2^``BITS`` consecutive nodes of a tree and appends the nodes of that subtree in
the order in which they complete (postorder, as a binary counter carries), one log row a builder. The roots of a
round's builders are the next round's leaves, so a tree of n leaves takes log(n) / ``BITS`` rounds and no task
holds more than 2^(``BITS`` + 1) nodes. Where a node stands follows from subtree sizes alone (``position``), so
siblings are read from the log by address, from the top round down: no path is searched or stored in the tree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelev.llm.common import table, written

BITS = 10
DIGEST = 64  # hex characters of a node


def position(level: int, index: int, leaves: int) -> int:
    """Place in the postorder log of node ``index`` of ``level`` in a tree of ``leaves`` leaves.

    Before the subtree of a whole node stand 2m - popcount(m) nodes (m = its first leaf): those that the first m
    leaves complete. The subtree has 2^(level + 1) - 1 nodes and ends with the node itself. Nodes over fewer
    leaves (one a level, on the right edge) are completed last, from the lowest level up.
    """
    first = index << level
    if first + (1 << level) <= leaves:
        return 2 * first - first.bit_count() + (2 << level) - 2
    whole = (leaves & -leaves).bit_length() - 1  # the highest level without a node over fewer leaves
    return 2 * leaves - leaves.bit_count() + level - whole - 1


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def append_nodes(leaves: list[str], height: int) -> list[str]:
    """The log of one builder: its leaves' tree up to ``height``, each node appended when it is complete."""
    log, open_ = [], []  # open_: (level, digest) of nodes that wait for a sibling
    for leaf in leaves:
        log.append(leaf)
        level, node = 0, leaf
        while level < height and open_ and open_[-1][0] == level:
            node = _sha(open_.pop()[1] + node)
            log.append(node)
            level += 1
        open_.append((level, node))
    if open_ and len(leaves) < 1 << height:
        level, node = open_.pop()
        while level < height:
            left = open_.pop()[1] if open_ and open_[-1][0] == level else ""
            node = _sha(left + node)
            log.append(node)
            level += 1
    return log


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 (hex) over the fields: '-' for null, else the length in UTF-8 bytes, ':' and the value as text."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def numbered(rows: DataFrame, tree: str, order: list[str], out: str = "idx") -> DataFrame:
    """``rows`` with their place (from 0) in their tree in ``order``, written as a table.

    Sorted range partitions of (tree, order), so a tree may spread over any number of tasks; a row's place is its
    place in its partition plus the rows of the tree in earlier partitions (one count a partition and tree).
    Rows that are alike in tree and order are alike in everything a digest sees, so their order doesn't matter.
    """
    at = F.monotonically_increasing_id()
    cols = rows.columns
    rows = written(rows, "merkle_leaves")  # range partitions are found by a pass of their own
    ranged = written(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", at), "merkle_rows")
    part = F.shiftright("_at", 33)
    runs = ranged.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    both = ranged.join(runs, F.col(tree).eqNullSafe(F.col("_tree")) & (part == F.col("_part")))
    return both.select(*cols, (F.col("_at") - F.col("_from") + F.col("_before")).alias(out))


@dataclass
class Log:
    """The written log of a forest.

    rounds: tables (tree, block, n, items, nodes); a row is one builder: ``n`` of the round's leaves (the first
    round has the ids and spare digests of its leaves in ``items``), ``nodes`` its appended hex digests.
    trees: (tree, leaves, root).
    """
    rounds: list[DataFrame]
    trees: DataFrame
    bits: int


def _builders(leaves: DataFrame, bits: int, tall: DataFrame, done: int, item: str) -> DataFrame:
    """One row a builder: the nodes of its aligned run of leaves, in the order of their completion."""
    import pyarrow as pa

    def build(key, group):
        t = group.sort_by("idx")
        digests = t["digest"].to_pylist()
        size = t["leaves"][0].as_py()
        up = min(bits, max(0, height(size) - done))
        nodes = append_nodes(digests, up)
        return pa.table({"tree": t["tree"].slice(0, 1).combine_chunks(), "block": pa.array([key[1].as_py()], pa.int64()),
                         "n": pa.array([len(digests)], pa.int32()), "leaves": pa.array([size], pa.int64()),
                         "items": pa.array([t["item"].to_pylist()], pa.list_(t.schema.field("item").type)),
                         "nodes": pa.array(["".join(nodes)], pa.string()), "top": pa.array([nodes[-1]], pa.string())})

    rows = (leaves.join(tall, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
            .withColumn("block", F.shiftright("idx", bits)))
    tree_t = leaves.schema["tree"].dataType.simpleString()
    schema = f"tree {tree_t}, block long, n int, leaves long, items array<{item}>, nodes string, top string"
    return rows.groupBy("tree", "block").applyInArrow(build, schema)


def append_log(leaves: DataFrame, bits: int = BITS) -> Log:
    """The log of a forest. ``leaves``: (tree, idx from 0 without gaps, digest, item); each round is a written table.

    A tree's size is its count of leaves; an empty table gives no rounds' rows and no trees.
    """
    item = leaves.schema["item"].dataType.simpleString()
    tall = written(leaves.groupBy(F.col("tree").alias("_t")).agg(F.count(F.lit(1)).alias("leaves")), "merkle_trees")
    most = tall.agg(F.max("leaves")).first()[0] or 0
    rounds, done, level = [], 0, leaves
    while True:
        rounds.append(written(_builders(level, bits, tall, done, item), f"merkle_log{len(rounds)}"))
        done += bits
        if done >= height(most):
            break
        # of trees that go on: those with more leaves than this round's builders span
        level = rounds[-1].where(F.col("leaves") > (1 << done)).select(
            "tree", F.col("block").alias("idx"), F.col("top").alias("digest"), F.lit(None).cast(item).alias("item"))
    roots = None
    for r, t in enumerate(rounds):
        last = F.col("leaves") <= (1 << (bits * (r + 1)))
        first = F.col("leaves") > (1 << (bits * r)) if r else F.lit(True)
        part = t.where(last & first).select("tree", "leaves", F.col("top").alias("root"))
        roots = part if roots is None else roots.unionByName(part)
    return Log(rounds, written(roots, "merkle_roots"), bits)


def siblings(nodes: str, index: int, n: int, up: int) -> list[str]:
    """Per level from 0, the sibling of leaf ``index``'s ancestor in a builder's log: 'L' or 'R' and the digest, '' for none."""
    out = []
    for level in range(up):
        at = index >> level
        other = at ^ 1
        if other << level < n:
            p = position(level, other, n) * DIGEST
            out.append(("L" if other < at else "R") + nodes[p:p + DIGEST])
        else:
            out.append("")
    return out


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    node = leaf
    for s in path:
        node = _sha(s[1:] + node if s[:1] == "L" else node + s[1:])
    return node


def join_path(path: list[str]) -> str:
    return ",".join(path)


def split_path(text: str) -> list[str]:
    """A path as text: per level its side and sibling, nothing for none, '/' where there is no level at all."""
    return [] if text == "/" else text.split(",")


def paths(log: Log, top: DataFrame | None = None) -> DataFrame:
    """(tree, item, digest, path, subroot) for every leaf, from the last round down: a builder's row is joined to
    the path of its root and gives the paths of its leaves. ``top``: (tree, path, subroot) from the trees' roots on."""
    above = None
    for r in range(len(log.rounds) - 1, -1, -1):
        t, span = log.rounds[r], F.lit(1 << (log.bits * (r + 1)))
        if top is None:
            rows = t.where(F.col("leaves") <= span).withColumns({"above": F.lit("/"), "subroot": F.col("top")})
        else:
            own = top.select(F.col("tree").alias("_t"), F.col("path").alias("above"), "subroot")
            rows = t.where(F.col("leaves") <= span).join(own, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
        if above is not None:
            from_above = above.select(F.col("tree").alias("_t"), F.col("block").alias("_b"), F.col("path").alias("above"), "subroot")
            rows = rows.unionByName(t.where(F.col("leaves") > span).join(
                from_above, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).drop("_t", "_b"))
        above = _down(rows, log.bits, r)
    return above.drop("block")


def _down(rows: DataFrame, bits: int, r: int) -> DataFrame:
    """One row a leaf of the round's builders, with its place in the round (``block``: the builder below it)."""
    import pyarrow as pa

    tree_t, item_t = rows.schema["tree"].dataType.simpleString(), rows.schema["items"].dataType.elementType.simpleString()
    schema = f"tree {tree_t}, block long, item {item_t}, digest string, path string, subroot string"

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                block, n, leaves, nodes, above = (b.column(c)[i].as_py() for c in ("block", "n", "leaves", "nodes", "above"))
                rest, up = split_path(above), min(bits, max(0, height(leaves) - bits * r))
                digests = [nodes[p:p + DIGEST] for p in (position(0, j, n) * DIGEST for j in range(n))]
                found = [join_path(p) if p else "/" for p in (siblings(nodes, j, n, up) + rest for j in range(n))]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(b.column("tree")[i], n), pa.array(range(block << bits, (block << bits) + n), pa.int64()),
                     b.column("items").slice(i, 1).flatten(), pa.array(digests, pa.string()), pa.array(found, pa.string()),
                     pa.repeat(b.column("subroot")[i], n)], names=["tree", "block", "item", "digest", "path", "subroot"])

    return rows.select("tree", "block", "n", "leaves", "items", "nodes", "above", "subroot").mapInArrow(read, schema)


def manifest(rows: DataFrame, fields: list[str], tree_col: str, id_col: str, forged: Column | None = None,
             forged_fields: list[Column] | None = None, bits: int = BITS) -> tuple[DataFrame, Log, Log]:
    """Digest, proof and check of every row of a table, and the logs of its trees and of the top tree.

    Returns (proofs, log, top log). proofs: (id, leaf, subroot, root, path, folded_root): ``path`` holds a side and
    sibling a level, from the leaf to the root; ``folded_root`` is what the path gives for the row as it would be
    after tampering (``forged_fields`` where ``forged`` holds), else for the row itself.

    Trees are the values of ``tree_col``, null first, then in UTF-8 byte order; within a tree rows ascend by id, null
    first; rows alike in id and digest may swap places, which changes nothing but which of the two has which path.
    Nulls in any field have their own mark, so null and empty differ. An empty table gives no rows, no tree
    and no root. Other columns, whatever their names, take no part.
    """
    col = lambda c: F.col(f"`{c}`")
    leaf = leaf_digest([col(c) for c in fields])
    fake = F.when(forged, leaf_digest(forged_fields)) if forged is not None else F.lit(None).cast("string")
    leaves = rows.select(col(tree_col).alias("tree"), col(id_col).alias("id"), leaf.alias("digest"), fake.alias("fake"))
    leaves = numbered(leaves, "tree", ["id", "digest"])
    log = append_log(leaves.select("tree", "idx", "digest", F.struct("id", "fake").alias("item")), bits)
    names = log.trees.select(F.lit(0).alias("one"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    top = append_log(numbered(names, "one", ["name"]).select(
        F.col("one").alias("tree"), "idx", "digest", F.struct("name").alias("item")), bits)
    root = (top.trees.select("root").first() or [None])[0]
    above = paths(top).select(F.col("item.name").alias("tree"), "path", F.col("digest").alias("subroot"))
    found = paths(log, written(above, "merkle_top")).withColumn("root", F.lit(root).cast("string"))
    return _folded(found), log, top


def _folded(found: DataFrame) -> DataFrame:
    import pyarrow as pa

    id_t = found.schema["item"].dataType["id"].dataType.simpleString()

    def check(batches):
        for b in batches:
            item, leaf = b.column("item"), b.column("digest").to_pylist()
            fake = item.field("fake").to_pylist()
            path = [split_path(p) for p in b.column("path").to_pylist()]
            folded = [fold(g or h, p) for g, h, p in zip(fake, leaf, path)]
            proof = [_sha("".join(s[1:] for s in p)) for p in path]
            yield pa.RecordBatch.from_arrays(
                [item.field("id"), b.column("digest"), b.column("subroot"), b.column("root"), b.column("path"),
                 pa.array(proof, pa.string()), pa.array(folded, pa.string())],
                names=["id", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root"])

    return found.select("item", "digest", "subroot", "root", "path").mapInArrow(
        check, f"id {id_t}, leaf string, subroot string, root string, path string, proof_sha256 string, folded_root string")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all ``documents``, one tree a language; every seventh document (by checksum of its id) tampered with."""
    forged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    out = manifest(table(spark, sf_dir, "documents"), FIELDS, "lang", "doc_id", forged, fields)[0]
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 over the digits of the id by its polynomial; the trees level by level and the paths by recursion.
ORACLE = r"""
WITH RECURSIVE
crc(i, v, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, c: xor(a // 256, t[(xor(a, c) % 256 + 1)::INT])), 4294967295) AS crc FROM documents, tab),
f AS (SELECT doc_id, lang, crc % 7 = 0 AS forged,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS pre,
  n_chars, coalesce(strlen(text) || ':' || text, '-') AS post FROM d),
l AS (SELECT doc_id, lang, sha256(pre || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || post) AS leaf,
  CASE WHEN forged THEN sha256(pre || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || post) END AS fake FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
up AS (SELECT lang, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS m FROM r UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(h || coalesce(nxt, '')), (m + 1) // 2 FROM
  (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY idx) AS nxt FROM up WHERE m > 1) WHERE idx % 2 = 0),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM up WHERE m = 1),
tops AS (SELECT 0 AS level, idx, subroot AS h, count(*) OVER () AS m FROM subs UNION ALL
  SELECT level + 1, idx // 2, sha256(h || coalesce(nxt, '')), (m + 1) // 2 FROM
  (SELECT *, lead(h) OVER (ORDER BY idx) AS nxt FROM tops WHERE m > 1) WHERE idx % 2 = 0),
walk AS (SELECT doc_id, lang, leaf, coalesce(fake, leaf) AS h, idx, 0 AS level, '' AS proof, false AS over FROM r UNION ALL
  SELECT w.doc_id, w.lang, w.leaf,
    CASE WHEN n.m > 1 THEN CASE WHEN w.idx % 2 = 1 THEN sha256(s.h || w.h) ELSE sha256(w.h || coalesce(s.h, '')) END ELSE w.h END,
    CASE WHEN n.m > 1 THEN w.idx // 2 ELSE w.idx END, w.level + 1, w.proof || CASE WHEN n.m > 1 THEN coalesce(s.h, '') ELSE '' END, n.m = 1
  FROM walk w JOIN up n ON n.lang IS NOT DISTINCT FROM w.lang AND n.level = w.level AND n.idx = w.idx
  LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.idx = xor(w.idx, 1)
  WHERE NOT w.over),
high AS (SELECT w.doc_id, w.leaf, b.subroot, w.h, w.proof, b.idx, 0 AS level, false AS over FROM walk w JOIN subs b
    ON b.lang IS NOT DISTINCT FROM w.lang WHERE w.over UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot,
    CASE WHEN n.m > 1 THEN CASE WHEN w.idx % 2 = 1 THEN sha256(s.h || w.h) ELSE sha256(w.h || coalesce(s.h, '')) END ELSE w.h END,
    w.proof || CASE WHEN n.m > 1 THEN coalesce(s.h, '') ELSE '' END,
    CASE WHEN n.m > 1 THEN w.idx // 2 ELSE w.idx END, w.level + 1, n.m = 1
  FROM high w JOIN tops n ON n.level = w.level AND n.idx = w.idx LEFT JOIN tops s ON s.level = w.level AND s.idx = xor(w.idx, 1)
  WHERE NOT w.over),
root AS (SELECT h AS root FROM tops WHERE m = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM high, root WHERE over
"""
