import hashlib
import re
import tracemalloc

import pyarrow as pa

from corelev.llm import decontam as D
from corelev.llm.common import table


def w(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(docs, items, width=10):
    wins = {}
    for i, t in items:
        x = w(t)
        for k in range(max(1, len(x) - width + 1) if x else 0):
            wins.setdefault(tuple(x[k: k + width]), set()).add("" if i is None else str(i))
    sizes = sorted({len(k) for k in wins})
    out = []
    for i, t in docs:
        x, hit, its = w(t), set(), set()
        for n in sizes:
            for k in range(len(x) - n + 1):
                if (q := tuple(x[k: k + n])) in wins:
                    hit.update(range(k, k + n))
                    its |= wins[q]
        out.append((i, len(x), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def digests(df):
    out = []
    for r in df.collect():
        n = sum(h["e"] - h["s"] for h in r["hits"])
        out.append((r["doc_id"], r["n_words"], n, len(r["items"]), D.digest(r["items"]), n > 0))
    return sorted(out, key=str)


def test_whole_tables(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = [tuple(r) for r in D.op5_decontamination(spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == want and any(r[-1] for r in want)
    assert digests(D.contamination(docs, items, part_windows=150)) == want  # many parts, same result


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Three FOUR"), (3, "word word word"), (None, "own one"), (4, "...")], "item_id int, text string")
    pairs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert digests(D.contamination(odd, items)) == brute(pairs, [tuple(r) for r in items.collect()])
    assert D.contamination(none, items).count() == 0
    nothing = D.contamination(odd, items.limit(0)).collect()
    assert len(nothing) == len(pairs) and not any(r["hits"] for r in nothing)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "beta x alpha y y gamma"), (2, "alpha x x x x x x x x x beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in D.contamination(docs, items, within=5).collect()}
    assert got == {1: ["9"], 2: [], 3: []}


def test_proximity_stays_in_its_document(spark):
    """Words of the next document are no neighbours, however wide the neighbourhood."""
    docs = spark.createDataFrame([(1, "x alpha"), (2, "beta y"), (3, "alpha " + "x " * 20 + "beta")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(9, "alpha beta")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in D.contamination(docs, items, within=30).collect()}
    assert got == {1: [], 2: [], 3: ["9"]}


def test_index_building_is_lean(spark):
    """A block's words are never all there as objects, and a block is of some 8 MB of text: the peak stays near the size of the text."""

    class Docs:
        select = lambda self, *_: self
        mapInArrow = lambda self, task, _: task

    n, texts = 1200, [" ".join(f"word{(i * 37 + k) % 5000}" for k in range(1200)) for i in range(1200)]
    one = pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_arrays([one, one, pa.array(texts), one], ["i", "r", "t", "h"])
    size = sum(map(len, texts))
    task = D.build_index(Docs())
    tracemalloc.start()
    out = list(task([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(b.column(0)[0]) for b in out) == n and len(out) > 1
    assert peak < 4 * size, peak / size
