import collections

import corpus_pipeline as P
from corelev.llm import packing
from corelev.llm import toxicity as T
from corelev.llm.common import table
from test_decontam import brute as brute_hits
from test_lines_shards import brute_lines
from test_ngram_join import brute as brute_sets


def test_whole_pipeline(spark, sf):
    """Every stage but the model's verdict is held against brute force, on what the stage before kept."""
    docs = table(spark, sf, "documents")
    cols = docs.columns
    stages = dict(P.STAGES)
    kept = stages["toxicity"](spark, docs, sf)
    marks = T.score(docs, T.fit(docs, table(spark, sf, "labels"))).collect()
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert rows == {r["doc_id"]: r["text"] for r in marks if not r["rejected"]} and kept.columns == cols
    rows = {i: t for i, _, _, t in brute_lines(list(rows.items()))}
    one = stages["line_dedup"](spark, kept, sf)
    got = one.collect()
    assert {r["doc_id"]: r["text"] for r in got} == rows and one.columns == cols and all(r["n_chars"] == len(r["text"]) for r in got)
    rows = {i: rows[i] for i, _, c in brute_sets(list(rows.items())) if i == c}
    two = stages["ngram_join"](spark, one, sf)
    assert {r["doc_id"]: r["text"] for r in two.collect()} == rows and two.columns == cols
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    rows = {r[0]: rows[r[0]] for r in brute_hits(list(rows.items()), items) if not r[-1]}
    three = stages["decontamination"](spark, two, sf)
    assert {r["doc_id"]: r["text"] for r in three.collect()} == rows and three.columns == cols
    total = collections.Counter()
    bins = collections.defaultdict(list)
    for r in P.run(spark, sf).collect():
        total[r["doc_id"]] += r["length"]
        bins[r["bin_id"]].append((r["length"], r["capacity"]))
    assert total == {i: len(t.encode().split()) + 1 for i, t in rows.items()}
    assert all(sum(n for n, _ in b) <= b[0][1] in packing.CAPACITIES for b in bins.values())


def test_odd_documents(spark, odd, sf):
    """Nulls, repeated rows and clashing columns through every stage; no row without words is lost to near-duplicates."""
    docs = odd.withColumn("rejected", odd["lang"]).withColumn("p_toxic", odd["n_chars"])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert out.where("trim(coalesce(text, '')) = ''").count() >= docs.where("trim(coalesce(text, '')) = ''").count(), name
        docs = out
    assert P.STAGES[-1][1](spark, docs, sf).count() >= docs.count() > 5


def test_empty_documents(spark, none, sf):
    docs = none
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
