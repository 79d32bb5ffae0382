import collections
import random
import re
import zlib

from corelev.llm import variants as V
from corelev.llm.common import table


def brute_counts(rows, slip=31, min_chars=7):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if slip and i is not None and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= min_chars
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_group(counts, factor=10):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(x, w)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def as_set(df):
    rows = [tuple(r) for r in df.select(*COLS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_dense_words(spark):
    rnd = random.Random(5)
    counts = {"".join(rnd.choice("abcé") for _ in range(rnd.choice([1, 2, 5, 6, 7, 8]))): 10 ** rnd.randrange(5) for _ in range(700)}
    got = as_set(V.group(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)))
    want = brute_group(counts)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)  # chains of forms


def test_every_single_edit_is_found(spark):
    rnd = random.Random(9)
    pairs, words = set(), set()
    for _ in range(300):
        w = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzÀÿ÷") for _ in range(rnd.randrange(1, 14)))
        i, c = rnd.randrange(len(w)), rnd.choice("xyé")
        for x in (w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]):
            if x and x != w:
                words |= {w, x}
                pairs.add(tuple(sorted((w, x), key=lambda v: (len(v), v))))
    got = {(r["a"], r["b"]) for r in V.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    assert pairs <= got and all(one_edit(a, b) for a, b in got)


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    counts = brute_counts(docs)
    assert as_set(V.op13_variants(spark, sf)) == brute_group(counts)


def test_odd_rows(odd, spark):
    long = spark.createDataFrame([(90, "a" * 200_000 + " Straße" * 2 + " resumé×÷ RESUMé×÷"), (91, "a" * 200_000), (92, None)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(long)
    want = brute_counts([tuple(r) for r in docs.collect()])
    got = {r["word"]: r["n"] for r in V.word_counts(docs.withColumn("word", docs.text).withColumn("n", docs.text).withColumn("h", docs.text), slip=31).collect()}
    assert got == want and any(len(w) > 100_000 for w in got)
    assert as_set(V.group(V.word_counts(docs, slip=31))) == brute_group(want)


def test_empty(none):
    words = V.word_counts(none, slip=31)
    assert words.count() == 0 and V.group(words).count() == 0


def test_ties_go_to_the_smaller_word(spark):
    rows = [("abcdefg", 1), ("abcdefgz", 50), ("abcdefgé", 50), ("xbcdefg", 50)]
    got = {r["word"]: r["form"] for r in V.group(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"abcdefg": "abcdefgz", "abcdefgz": None, "abcdefgé": None, "xbcdefg": None}
