"""Language identification by nearest centroid on character n-grams.

A text is a vector of its 1- to 3-grams (letters lower-cased, everything else one blank between words), counted in
hashed slots, weighted by log(1 + count) and inverse document frequency, of length one. Every language has several
centroids (spherical k-means over its sampled texts). A text takes the language of the centroid of the largest cosine;
if it lies further from it than that centroid's own texts do, the prediction is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corelev.llm.common import sliced, table, written

SLOTS = 1 << 14       # hashed n-gram slots
CENTROIDS = 4         # at most, per language
PER_LANGUAGE = 1000   # labelled texts a language that the centroids are fitted on
ROUNDS = 12           # of k-means
SLACK = 1.25          # a text is rejected beyond SLACK times the distance that 99 % of a centroid's own texts keep
PIECE = 1 << 20       # characters of a text taken at once

_TABLES: list = []


def _tables():
    """Per code point: whether it is a letter, and its lower-case form where that is one code point."""
    if not _TABLES:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                low = c.lower()
                if len(low) == 1:
                    lower[i] = ord(low)
        _TABLES.extend((letter, lower))
    return _TABLES


def _pieces(texts):
    """(row, piece, characters of it that an earlier piece ended with) of padded texts."""
    for i, t in enumerate(texts):
        t = f" {t} " if t else ""
        for s in range(0, len(t), PIECE):
            yield i, t[max(0, s - 2):s + PIECE], min(s, 2)


def _piece_counts(todo):
    """(place in ``todo``, slot, count) of the n-grams that end in each piece's own characters."""
    letter, lower = _tables()
    sizes = np.array([len(p) for _, p, _ in todo])
    codes = np.frombuffer("".join(p for _, p, _ in todo).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(todo)), sizes)
    own = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= np.repeat([o for _, _, o in todo], sizes)
    is_letter = letter[codes]
    a = np.where(is_letter, lower[codes], 32).astype(np.uint64)
    keys = []
    for n, some in ((1, is_letter), (2, is_letter[1:] | is_letter[:-1]), (3, is_letter[1:-1])):  # which n-grams count
        if len(a) < n:
            continue
        gram = np.full(len(a) - n + 1, n, np.uint64)
        for j in range(n):
            gram = (gram << np.uint64(20)) ^ a[j:len(a) - n + 1 + j]
        ok = some & own[n - 1:] & (row[n - 1:] == row[:len(row) - n + 1])
        slot = (gram[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SLOTS.bit_length())
        keys.append(row[n - 1:][ok] * SLOTS + slot.astype(np.int64))
    flat = np.bincount(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    at = np.flatnonzero(flat)
    return at // SLOTS, at % SLOTS, flat[at]


def gram_counts(texts):
    """Blocks (row, slot, count) of the n-grams of whole texts, by row and slot; a text is whole within its block.

    Texts are counted at most 64 and about ``PIECE`` characters at a time; longer ones by pieces, whose counts (at
    most ``SLOTS`` each) are added up, so memory stays bounded. Texts without letters have no n-grams.
    """
    def counted(todo):
        place, slot, n = _piece_counts(todo)
        rows = np.array([i for i, _, _ in todo])
        key = rows[place] * SLOTS + slot
        if len(todo) > 1 and (rows[1:] == rows[:-1]).any():
            key, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, n).astype(np.int64)
        return key, n

    todo, held, rest = [], 0, None
    for piece in _pieces(texts):
        if todo and (len(todo) >= 64 or held >= PIECE):
            key, n = counted(todo)
            if todo[-1][0] == piece[0] or rest is not None:  # the last text goes on
                if rest is not None:
                    key, back = np.unique(np.concatenate([rest[0], key]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([rest[1], n])).astype(np.int64)
                stay = key // SLOTS == piece[0]
                rest = (key[stay], n[stay]) if stay.any() else None
                key, n = key[~stay], n[~stay]
            yield key // SLOTS, key % SLOTS, n
            todo, held = [], 0
        todo.append(piece)
        held += len(piece[1])
    if todo:
        key, n = counted(todo)
        if rest is not None:
            key, back = np.unique(np.concatenate([rest[0], key]), return_inverse=True)
            n = np.bincount(back, np.concatenate([rest[1], n])).astype(np.int64)
        yield key // SLOTS, key % SLOTS, n


@dataclass
class Model:
    """languages: one name a centroid, in order of the names; centroids: (centroids, SLOTS), each of length one;
    idf: (SLOTS,); reach: the distance (1 - cosine) beyond which a centroid's prediction is rejected."""
    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray


def _weighted(row, slot, n, idf):
    """(weights of unit length by row, starts of the rows, rows) of one block."""
    w = np.log1p(n) * idf[slot]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    norm = np.sqrt(np.add.reduceat(w * w, starts))
    return w / np.repeat(norm, np.diff(np.r_[starts, len(row)])), starts, row[starts]


def _cosines(w, slot, starts, centroids_t) -> np.ndarray:
    parts = [np.add.reduceat(w[:, None] * centroids_t[slot, k:k + 32], starts, axis=0) for k in range(0, centroids_t.shape[1], 32)]
    return np.concatenate(parts, axis=1)


def sample(docs: DataFrame, lang: str, text: str, id_col: str, per_language: int) -> DataFrame:
    """(lang, id, text): at most ``per_language`` labelled texts of each language, those of the least hash of their id.

    Counts by language (one row each on the driver; the model holds far more of each) give the share of a frequent
    language's hashes that are looked at, so few rows more than needed are sorted, whatever a language's size.
    """
    rows = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    counts = [(r["lang"], 1.5 * per_language / r["count"]) for r in rows.groupBy("lang").count().collect()]
    share = docs.sparkSession.createDataFrame(counts, "lang string, share double")
    u = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    near = rows.withColumn("u", u).join(F.broadcast(share), "lang").where(F.col("u") <= F.col("share"))
    first = Window.partitionBy("lang").orderBy("u", "id", "text")
    return near.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= per_language).select("lang", "id", "text")


def _features(texts: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in sliced(batches):
            names, ids = b.column("lang").to_pylist(), b.column("id")
            for row, slot, n in gram_counts(b.column("text").to_pylist()):
                if not len(row):
                    continue
                starts = np.r_[np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row)]
                at = row[starts[:-1]]
                lists = lambda v: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.string()), ids.take(pa.array(at)), lists(slot), lists(n)],
                                                 names=["lang", "id", "slots", "counts"])

    id_t = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"lang string, id {id_t}, slots array<int>, counts array<int>")


def _cluster(slot, w, starts, k: int):
    """Spherical k-means on sparse unit rows: (centroids, cosine of every row with its own, its centroid)."""
    n, rng = len(starts), np.random.default_rng(7)
    ends = np.r_[starts[1:], len(slot)]
    dense = lambda i: np.bincount(slot[starts[i]:ends[i]], w[starts[i]:ends[i]], SLOTS)
    row = np.repeat(np.arange(n), ends - starts)
    cents = dense(int(rng.integers(n)))[None]
    while len(cents) < k:
        far = np.clip(1 - _cosines(w, slot, starts, cents.T).max(axis=1), 1e-12, None)
        cents = np.vstack([cents, dense(int(rng.choice(n, p=far / far.sum())))])
    for _ in range(ROUNDS):
        own = _cosines(w, slot, starts, cents.T).argmax(axis=1)
        sums = np.bincount(own[row] * SLOTS + slot, w, k * SLOTS).reshape(k, SLOTS)
        norm = np.linalg.norm(sums, axis=1)
        cents = sums[norm > 0] / norm[norm > 0, None]
        k = len(cents)
    cos = _cosines(w, slot, starts, cents.T)
    return cents, cos.max(axis=1), cos.argmax(axis=1)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", centroids: int = CENTROIDS,
        per_language: int = PER_LANGUAGE) -> Model:
    """Centroids of every non-null value of ``lang``, from at most ``per_language`` texts of each (see ``sample``).

    A language without a text that has letters isn't learned. The driver gets the document frequencies of the slots
    and ``centroids`` vectors a language (64 KB each). No labelled text at all gives a model that knows no language.
    """
    import pandas as pd

    feats = written(_features(sample(docs, lang, text, id_col, per_language)), "langid_features")
    total = feats.count()
    df = np.zeros(SLOTS)
    for r in feats.select(F.explode("slots").alias("s")).groupBy("s").count().collect():
        df[r["s"]] = r["count"]
    idf = np.log((1 + total) / (1 + df)) + 1

    def cluster(key, rows):
        rows = rows.sort_values("id", kind="mergesort")
        sizes = rows["slots"].map(len).to_numpy()
        slot, n = np.concatenate(rows["slots"].to_list()), np.concatenate(rows["counts"].to_list())
        w, starts, _ = _weighted(np.repeat(np.arange(len(rows)), sizes), slot, n, idf)
        cents, cos, own = _cluster(slot, w, starts, max(1, min(centroids, len(rows) // 8)))
        reach = [SLACK * float(np.quantile(1 - cos[own == j], 0.99)) if (own == j).any() else 0.0 for j in range(len(cents))]
        return pd.DataFrame({"lang": key[0], "centroid": [c.astype(np.float32).tobytes() for c in cents], "reach": reach})

    got = feats.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, reach double").collect()
    got.sort(key=lambda r: (r["lang"].encode("utf-8", "surrogatepass"), r["reach"], bytes(r["centroid"])))
    cents = np.array([np.frombuffer(r["centroid"], np.float32) for r in got], np.float32).reshape(len(got), SLOTS)
    return Model([r["lang"] for r in got], cents, idf, np.array([r["reach"] for r in got]))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected.

    The nearest centroid decides, ties by the smaller name. ``rejected``: the text lies further away than the centroid
    reaches; the prediction stays, so that the caller may use it or not. A null text, one without a letter, and every
    text under a model without languages get 'und', 0 and true. Rows pass through as they are, repeated or not;
    columns of the three names are replaced. An empty table gives an empty table.
    """
    import pyarrow as pa

    new = ("lang_pred", "score", "rejected")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    names = np.array(model.languages + ["und"], object)
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(model.centroids.T), model.idf, model.reach, names))

    def run(batches):
        cents, idf, reach, names = shared.value
        for b in sliced(batches):
            best = np.full(b.num_rows, len(names) - 1)
            score, rejected = np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            for row, slot, n in gram_counts(b.column("_text").to_pylist()) if len(reach) else ():
                if not len(row):
                    continue
                w, starts, at = _weighted(row, slot, n, idf)
                cos = _cosines(w.astype(np.float32), slot, starts, cents)
                best[at] = cos.argmax(axis=1)
                score[at] = np.clip(cos.max(axis=1), 0.0, 1.0)
                rejected[at] = 1 - score[at] > reach[best[at]]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f"_k{i}") for i in range(len(kept))), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rejected)],
                names=[*(f"_k{i}" for i in range(len(kept))), *new])

    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("_text"))
    types = [f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]
    out = rows.mapInArrow(run, ", ".join([*types, "lang_pred string, score double, rejected boolean"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *new)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents`` by centroids fitted on those that aren't held out (a checksum of the id)."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
