import numpy as np

from corelev.llm import ann as A
from corelev.llm import toxicity as T
from corelev.llm.common import table


def brute(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in queries:
        s = A.cosine(x, np.tile(np.array(v, float), (len(x), 1)))
        o = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def test_recall_and_order(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    got: dict = {}
    for r in sorted(A.op1_ann(spark, sf).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    all_scores = {q: dict(brute(rows, [(q, dict(rows)[q])], len(rows))[q]) for q in list(want)[:3]}
    for q, s in all_scores.items():
        assert all(abs(s[i] - x) < 1e-12 for i, x in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1.0, 0.0]), (50, [-1.0, 0.5]), (100, None), (None, [1.0, 0.0]), (9, [1.0]), (8, [1.0, 0.0]), (10, [1e300, 1e300])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = [tuple(r) for r in A.nearest(df, df.where("vec_id % 50 = 0"), visit=100.0).select("query_id", "rank", "vec_id").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 8), (0, 3, 8), (0, 4, 2), (0, 5, 10), (50, 1, 2), (50, 2, 10), (50, 3, 0), (50, 4, 1), (50, 5, 8)]
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0
    assert A.nearest(df, df.where("vec_id = 3")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    near = A.nearest(same, same.where("vec_id = 2")).orderBy("rank").collect()
    assert [r["vec_id"] for r in near] == [0, 1, 3, 4, 5]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chain = T.fit(docs, labels.where("doc_id % 3 <> 0"))
    r = T.score(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), chain).select("toxic", "rejected").collect()
    toxic, clean = [x["rejected"] for x in r if x["toxic"]], [x["rejected"] for x in r if not x["toxic"]]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.02


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (3, None, 1), (4, 0, None), (5, 1, 0), (5, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    chain = T.fit(odd, labels)
    out = T.score(odd.withColumn("rejected", odd["n_chars"]), chain)
    assert out.count() == odd.count() and {"p_toxic", "p_low_quality", "rejected"} <= set(out.columns) and dict(out.dtypes)["rejected"] == "boolean"
    empty = T.fit(none, labels.limit(0))
    assert T.score(none, empty).count() == 0
    assert not any(r["rejected"] for r in T.score(odd, empty).collect())


def test_later_categories_use_earlier_out_of_fold():
    """The second category follows the first; its model learns that from the first one's out-of-fold logits."""
    r = np.random.default_rng(0)
    n = 600
    ids = [[int(j) for j in np.flatnonzero(r.random(12) < 0.3)] for _ in range(n)]
    a = np.array([float(0 in x) for x in ids])
    y = {"a": a, "b": a}
    chain = T.fit_chain({f"f{j}": j for j in range(12)}, ids, np.ones(n), y, np.arange(n) % 5)
    assert len(chain.weights["b"]) == len(chain.weights["a"]) + 1 and chain.weights["b"][-2] > 0.05
    p = chain.predict(ids, np.ones(n))
    assert np.mean((p["b"] > 0.5) == (a > 0.5)) > 0.98
