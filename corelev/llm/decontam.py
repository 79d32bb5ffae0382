"""Benchmark decontamination with a positional inverted index that is spread over document blocks.

A block holds the postings of all words of some documents: the sorted distinct word hashes, and
for each the sorted positions in the block. Blocks are rows of a Parquet table, so the index is as
distributed as the documents. A search sends the benchmark's windows (in bounded parts) to all
blocks and, in each, intersects offset-adjusted position lists from the rarest word on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelev.llm.common import WordHash, sliced, table, utf8, written

#: A-Z to a-z; every other ASCII byte that is no letter or digit to a blank.
_FOLD = bytes((c + 32) if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = ("doc_ids array<long>, rows array<long>, keys array<long>, n_words binary, terms binary, starts binary, positions binary")


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 10, block_docs: int = 2000) -> DataFrame:
    """One row a block of documents: ids, row numbers, word counts and the postings of every word.

    Documents lie one after another in the block's positions, at least ``gap`` apart, so a window of
    up to ``gap`` words can't reach from one into the next.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.monotonically_increasing_id().alias("r"), F.col(f"`{text_col}`").alias("t"),
                      F.xxhash64(F.col(f"`{text_col}`")).alias("h"))

    def blocks(batches):
        hashes = WordHash()
        for b in sliced(batches, block_docs, 8 << 20):
            ids = []
            for x in utf8(b.column(2)):  # one document's words at a time: as objects they take some ten times their bytes
                ws = words(x)
                ids.append(np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws)))
            hashes.tidy()
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            first = np.concatenate([[0], np.cumsum(n + gap)[:-1]])
            ids = np.concatenate(ids)
            at = np.arange(len(ids), dtype=np.int32)
            at += np.repeat((first - np.cumsum(n) + n).astype(np.int32), n)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            terms = ids[starts]
            yield pa.RecordBatch.from_arrays([
                pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([b.column(1).to_pylist()], pa.list_(pa.int64())),
                pa.array([b.column(3).to_pylist()], pa.list_(pa.int64())), pa.array([n.tobytes()]), pa.array([terms.tobytes()]), pa.array([np.append(starts, len(ids)).astype(np.int32).tobytes()]),
                pa.array([at[order].tobytes()])], ["doc_ids", "rows", "keys", "n_words", "terms", "starts", "positions"])

    return src.mapInArrow(blocks, INDEX)


class Block:
    """An index row, read for searching."""

    def __init__(self, row: dict, gap: int):
        self.doc_ids, self.rows, self.keys = row["doc_ids"], row["rows"], row["keys"]
        self.n = np.frombuffer(row["n_words"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n + gap)[:-1]])
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.at = np.frombuffer(row["positions"], np.int32)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Each term's place in the block's list, -1 where the block lacks it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        k = np.searchsorted(self.terms, terms).clip(max=len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def postings(self, k: int) -> np.ndarray:
        return self.at[self.starts[k]: self.starts[k + 1]]

    def phrase(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the phrase whose words are at ``places``, given rarest first with their offsets."""
        found = self.postings(places[0]) - offsets[0]
        for k, o in zip(places[1:], offsets[1:]):
            if not len(found):
                break
            p, want = self.postings(k), found + o
            i = np.searchsorted(p, want).clip(max=len(p) - 1)
            found = found[p[i] == want]
        return found

    def near(self, places: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest word (first of ``places``) with every other word at most ``within`` words away."""
        found = self.postings(places[0])
        for k in places[1:]:
            p = self.postings(k)
            i = np.searchsorted(p, found - within).clip(max=len(p) - 1)
            found = found[np.abs(p[i] - found) <= within]
        return found


def item_windows(items, width: int):
    """(window words as hashes, item id) for every item; an item of fewer words, but not none, is one window."""
    hashes = WordHash()
    for item, text in items:
        h = [hashes[w] for w in words((text or "").encode())]
        for i in range(max(1, len(h) - width + 1) if h else 0):
            yield h[i: i + width], "" if item is None else str(item)
        hashes.tidy()


def parts_of(rows, width: int, windows: int):
    """The benchmark's distinct windows in parts of at most about ``windows``: [(hashes, sorted item ids)]."""
    part: dict = {}
    for h, item in item_windows(rows, width):
        part.setdefault(tuple(h), set()).add(item)
        if len(part) >= windows:
            yield [(k, sorted(v)) for k, v in part.items()]
            part = {}
    if part:
        yield [(k, sorted(v)) for k, v in part.items()]


def search(index: DataFrame, part: list, width: int, within: int | None = None) -> DataFrame:
    """Hits of one part of the windows: row (of the index), doc_id, text_key, n_words, hits (start, end runs), items.

    Exact phrases, or with ``within`` proximity matches: all words of the window within that many
    words of the rarest one, which then is the hit. Documents without hits come too.
    """
    spark = index.sparkSession
    terms = np.unique(np.array([t for h, _ in part for t in h], np.uint64))
    known = spark.sparkContext.broadcast(terms)

    def count(batches):
        total = np.zeros(len(known.value), np.int64)
        for b in batches:
            for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(total) else ():
                have, n = np.frombuffer(t, np.uint64), np.diff(np.frombuffer(s, np.int32))
                i = np.searchsorted(known.value, have).clip(max=len(known.value) - 1)
                same = known.value[i] == have
                total[i[same]] += n[same]
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(total[k])], ["k", "n"])

    df = np.zeros(len(terms), np.int64)
    for x in index.select("terms", "starts").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        df[x["k"]] = x["n"]
    size = np.array([len(h) for h, _ in part], np.int64)
    flat = np.searchsorted(terms, np.array([t for h, _ in part for t in h], np.uint64))
    start = np.cumsum(size) - size
    w = np.zeros((len(part), width), np.int64)  # words of each window, rarest first; short ones repeat their rarest
    off = np.zeros((len(part), width), np.int64)
    for i, (s, n) in enumerate(zip(start, size)):
        t = flat[s: s + n]
        o = np.argsort(df[t], kind="stable")
        w[i], off[i] = np.pad(t[o], (0, width - n), mode="edge"), np.pad(o, (0, width - n), mode="edge")
    possible = (df[w] > 0).all(axis=1)
    sent = spark.sparkContext.broadcast((w[possible], off[possible], size[possible], [part[i][1] for i in np.flatnonzero(possible)]))

    def look(batches):
        w, off, size, items = sent.value
        for b in batches:
            for r in range(b.num_rows):  # a block at a time: they are large
                x = Block(b.slice(r, 1).to_pylist()[0], _gap(width, within))
                place = x.find(known.value)[w] if len(w) else np.zeros((0, width), int)
                step = np.zeros(int(x.first[-1] + x.n[-1]) + 1, np.int32)
                at: dict = {}
                for i in np.flatnonzero((place >= 0).all(axis=1)):
                    if within is None:
                        p, n = x.phrase(place[i], off[i]), size[i]
                    else:
                        p, n = x.near(place[i], within), 1
                    if len(p):
                        np.add.at(step, p, 1)
                        np.add.at(step, p + n, -1)
                        for d in np.unique(np.searchsorted(x.first, p, side="right") - 1):
                            at.setdefault(int(d), set()).update(items[i])
                edge = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0, append=0)
                a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                d = np.searchsorted(x.first, a, side="right") - 1
                runs: dict = {}
                for k, s, e in zip(d.tolist(), (a - x.first[d]).tolist(), (z - x.first[d]).tolist()):
                    runs.setdefault(k, []).append({"s": s, "e": e})
                yield pa.RecordBatch.from_arrays([
                    pa.array(x.rows, pa.int64()), pa.array(x.doc_ids, pa.int64()), pa.array(x.keys, pa.int64()), pa.array(x.n),
                    pa.array([runs.get(k, []) for k in range(len(x.n))], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                    pa.array([sorted(at.get(k, ())) for k in range(len(x.n))], pa.list_(pa.string()))], ["row", "doc_id", "text_key", "n_words", "hits", "items"])

    return index.mapInArrow(look, "row long, doc_id long, text_key long, n_words long, hits array<struct<s:long,e:long>>, items array<string>")


def _gap(width: int, within: int | None) -> int:
    """Positions between documents: no window or neighbourhood reaches from one into the next."""
    return max(width, within or 0)


def _union(runs: list, items: list):
    """Joined runs and distinct items of a document's results from several parts."""
    out: list = []
    for s, e in sorted((r["s"], r["e"]) for rs in runs for r in rs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [{"s": s, "e": e} for s, e in out], sorted({x for xs in items for x in xs})


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, within: int | None = None, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text", part_windows: int = 200_000) -> DataFrame:
    """Per row of ``docs``: row, doc_id, text_key (hash of the text), n_words, hits (runs of hit words, end exclusive), items (sorted ids as strings).

    The index over all words of all documents is written once; the benchmark's windows are searched
    in parts of ``part_windows`` (about 40 MB sent to each task), as many as it takes, and the hits
    united. Null or empty texts have no words and no hits. Repeated rows and repeated ids stay rows
    of their own. Items with a null id count as the id ''; items without words match nothing; repeated
    item ids count once. Empty tables give no rows (documents) or no hits (benchmark). Other columns are not read.
    """
    index = written(build_index(docs, id_col, text_col, gap=_gap(width, within)), "postings")
    rows = ((x[0], x[1]) for x in benchmark.select(F.col(f"`{item_col}`"), F.col(f"`{item_text}`")).toLocalIterator())
    found = [search(index, p, width, within) for p in parts_of(rows, width, part_windows)] or [search(index, [], width)]
    if len(found) == 1:
        return found[0]
    found = [written(x, "hits") for x in found]
    all_hits = found[0]
    for x in found[1:]:
        all_hits = all_hits.unionByName(x)
    one = all_hits.groupBy("row", "doc_id", "text_key", "n_words").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))

    def unite(batches):
        for b in batches:
            out = [_union(h, i) for h, i in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4],
                                              pa.array([x[0] for x in out], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                                              pa.array([x[1] for x in out], pa.list_(pa.string()))], ["row", "doc_id", "text_key", "n_words", "hits", "items"])

    return one.mapInArrow(unite, "row long, doc_id long, text_key long, n_words long, hits array<struct<s:long,e:long>>, items array<string>")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items, windows of 10 words."""
    x = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])
    return x.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1),
    lambda i: array_to_string(ws[i:i + 9], ' '))) AS g FROM b WHERE len(ws) > 0),
dw AS (SELECT doc_id, ks.k, unnest(range(1, len(ws) - ks.k + 2)) AS i, ws FROM d, (SELECT DISTINCT k FROM bw) ks WHERE len(ws) >= ks.k),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.g = array_to_string(dw.ws[dw.i:dw.i + dw.k - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
    sha256(coalesce(it.items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
