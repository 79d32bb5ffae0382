import collections

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corelev.llm import packing as P


def check(rows, lengths, caps):
    bins, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append((r["bin_offset"], r["length"], r["capacity"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n, _ in sorted(b):
            assert o == at
            at += n
        assert {c for *_, c in b} == {min(c for c in caps if c >= at)}
    got = sorted((i, sum(n for _, n in p)) for i, p in pieces.items())
    assert got == sorted(lengths)


def test_pack_whole(spark, sf):
    rows = P.op8_best_fit_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(rows, [(d["doc_id"], len((d["text"] or "").encode().split()) + 1) for d in docs], P.CAPACITIES)
    caps = {r["bin_id"]: r["capacity"] for r in rows}
    assert sum(r["length"] for r in rows) > 0.9 * sum(caps.values())


def test_odd_lengths(spark, odd, none):
    df = spark.createDataFrame([(1, 0, "x"), (2, None, "x"), (3, -5, "x"), (4, 100_001, "x"), (None, 7, "x"), (5, 8192, "x"), (6, 8193, "x")], "doc_id long, n_tokens long, piece string")
    rows = P.best_fit(df).collect()
    key = lambda p: (p[0] is None, p)
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert sorted(got.items(), key=key) == sorted([(1, 0), (2, 0), (3, 0), (4, 100_001), (None, 7), (5, 8192), (6, 8193)], key=key)
    assert P.best_fit(P.token_lengths(none)).count() == 0
    assert P.best_fit(P.token_lengths(odd), group_pieces=3).count() >= odd.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80))
def test_pack_valid(lens):
    caps = (16, 32, 64)
    bins, at, final = P.pack(np.array(lens, np.int64), caps)
    used = collections.Counter()
    for b, o, n in sorted(zip(bins.tolist(), at.tolist(), lens)):
        assert o == used[b]
        used[b] += n
    assert all(final[b] == min(c for c in caps if c >= u) for b, u in used.items())
    assert sum(lens) <= sum(final)
