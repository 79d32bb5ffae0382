"""Spelling variants: words one edit apart, found by PartEnum signatures, and the common form each variant belongs to.

A word's letters with their occurrence numbers, (e, 1), (e, 2), (n, 1), ..., are a binary vector over all such
pairs. One inserted, deleted or replaced letter changes at most two of its places, so near words have vectors at a
Hamming distance of at most two. PartEnum deals the places to ``PARTS`` parts by a hash and enumerates the choices
of two parts to leave out: for vectors at most two apart one choice leaves out all that differs, and what is kept is
equal. Each kept rest is a signature; near words share one and meet by an equi-join. Two exact marks stand in the
key beside it: the length class (words of length l with words of length l and l + 1), and the first or the last
half of the word, one of which a single edit leaves whole. Candidates are then verified by their edit distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corelev.llm.common import table, written

PARTS = 4
BITS = 64 // PARTS
LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2,
                slip: int | None = None) -> DataFrame:
    """(word, n): maximal runs of ``LETTERS`` of the whole texts, A-Z lower-cased, at least ``min_chars`` code points
    long and ``min_count`` times found.

    ``slip``: where it divides h, the checksum (crc32) of 'id:word', code point h % length (from 0) is left out of
    that occurrence before its length is held against ``min_chars``; rows with a null id keep their words.
    Null and empty texts have no words; repeated rows count each time; columns besides the two take no part.
    Counts are summed in each task before they move, so a frequent word is no hot key.
    """
    text = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(runs).alias("word"))
    if slip:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        rows = rows.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word"))
        rows = rows.where(F.length("word") >= min_chars)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def vector_parts(words: list[str]) -> np.ndarray:
    """Per word ``PARTS`` fields of ``BITS`` bits: of each part of its vector, the xor of the hashes of the places set."""
    sizes = np.array([len(w) for w in words])
    out = np.zeros(len(words), np.uint64)
    if not sizes.sum():
        return out.view(np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    by = np.lexsort((letters, word))
    letters, word = letters[by], word[by]
    new = np.r_[True, (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])]
    at = np.arange(len(letters))
    seen = at - np.maximum.accumulate(np.where(new, at, 0))
    h = (letters << np.uint64(32)) + seen.astype(np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    part = (h >> np.uint64(BITS)) % np.uint64(PARTS)
    field = (h & np.uint64((1 << BITS) - 1)) << (part * np.uint64(BITS))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    some = sizes > 0
    out[some] = np.bitwise_xor.reduceat(field, starts[some])
    return out.view(np.int64)


def with_parts(words: DataFrame) -> DataFrame:
    """(word, n) with the fields of its vector, ``parts``."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            parts = vector_parts(b.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(parts, pa.int64())], names=["word", "n", "parts"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, parts long")


def _signatures(size: Column) -> Column:
    """All signatures of a word in the length class ``size`` (its own length, or one less)."""
    half = F.floor(size / 2).cast("int")
    ends = (F.substr("word", F.lit(1), half), F.substr("word", F.length("word") - (size - half) + 1))
    keys = []
    for side, letters in enumerate(ends):
        for kept in combinations(range(PARTS), PARTS - 2):
            mask = sum(((1 << BITS) - 1) << (BITS * j) for j in kept)
            mask -= (1 << 64) if mask >> 63 else 0
            keys.append(F.xxhash64(F.lit(side), F.lit(mask), size, letters, F.col("parts").bitwiseAND(F.lit(mask))))
    return F.explode(F.array(*keys))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of distinct words exactly one inserted, deleted or replaced code point apart, once
    each; ``a`` is the shorter word, of equally long ones the smaller.

    ``words``: distinct (word, n). A signature's words are joined by their key, so they spread over tasks; a key that
    very many words share is split by the adaptive skew join. A hash in the key can only add candidates.
    """
    w = written(with_parts(words.where(F.length("word") > 0)), "variant_words")
    size = F.length("word")
    short = w.select(_signatures(size).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    same = w.select(_signatures(size).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.lit(False).alias("longer"))
    longer = w.select(_signatures(size - 1).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.lit(True).alias("longer"))
    found = short.join(same.unionByName(longer), "key").where(
        (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "n_a", "b", "n_b").distinct()


def group(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for distinct (word, n).

    form: the near word of the largest n (ties: the smallest in code-point order) where that n is at least ``factor``
    times the word's, else null; n_near: near words; root: the last form that the forms lead to, the word itself if
    none. Forms grow by the factor, so chains are short; they are followed by doubling, a written table a round.
    """
    words = written(words.select("word", "n"), "variant_counts")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    near = words.join(best, "word", "left")
    form_n = F.when(-F.col("best.m") >= factor * F.col("n"), -F.col("best.m"))
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(form_n.isNotNull(), F.col("best.other")).alias("form"), form_n.alias("form_n"))
    near = written(near, "variant_forms")
    roots = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        roots = written(roots.join(on, F.col("root") == F.col("_w"), "left")
                        .select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "variant_roots")
        if not roots.where("moved").limit(1).count():
            break
    return near.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all ``documents``, some of which lose a letter by the checksum rule."""
    words = word_counts(table(spark, sf_dir, "documents"), slip=31)
    return group(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The checksum by its polynomial over the UTF-8 bytes; near words by the words that deleting a code point leaves.
ORACLE = r"""
WITH RECURSIVE
crc(i, v, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
long AS (SELECT run, hex(encode(doc_id || ':' || run)) AS x, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::INT])), 4294967295) AS crc FROM long, tab),
slips AS (SELECT CASE WHEN crc % 31 = 0 THEN left(run, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM slips WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
del AS (SELECT word, n, i AS pos, left(word, i::INT) || substr(word, i::INT + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
near AS (SELECT DISTINCT * FROM (
  SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM del a JOIN w b ON a.rest = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM del a JOIN w b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, other := encode(other))) AS b FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
  CASE WHEN -b.m >= 10 * w.n THEN decode(b.other) END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS nxt FROM f UNION ALL
  SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.nxt)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.nxt IS NULL
"""
