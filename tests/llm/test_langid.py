import collections
import math
import random
import zlib

import numpy as np
import pytest

from corelev.llm import langid as L
from corelev.llm.common import table


def brute_grams(text):
    """The n-grams of a text by slices of its letters and blanks."""
    flat = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ") if text else ""
    n = collections.Counter()
    for i, c in enumerate(flat):
        n[c] += c != " "
        if i:
            n[flat[i - 1:i + 1]] += flat[i - 1:i + 1] != "  "
        if i > 1:
            n[flat[i - 2:i + 1]] += flat[i - 1] != " "
    return {g: c for g, c in n.items() if c}


def slot_of(gram):
    h = len(gram)
    for c in gram:
        h = ((h << 20) ^ ord(c)) % (1 << 64)
    return (h * 0x9E3779B97F4A7C15) % (1 << 64) >> (65 - L.SLOTS.bit_length())


def brute_slots(text):
    n = collections.Counter()
    for g, c in brute_grams(text).items():
        n[slot_of(g)] += c
    return dict(n)


def counted(texts):
    out = [{} for _ in texts]
    for row, slot, n in L.gram_counts(texts):
        for r, s, c in zip(row.tolist(), slot.tolist(), n.tolist()):
            assert s not in out[r]
            out[r][s] = c
    return out


@pytest.mark.parametrize("piece", [5, 64, 1 << 20])
def test_counts_of_whole_texts(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    rnd = random.Random(piece)
    texts = ["", None, "a", "É", "123 !", "İIı ß ǅ", "日本語 текст", "\U0001F600x"] + ["".join(rnd.choice("aB éÉ-\n1") for _ in range(rnd.randrange(90))) for _ in range(150)]
    assert counted(texts) == [brute_slots(t) for t in texts]


def test_nearest_centroid_against_plain_cosines(spark, sf):
    docs = table(spark, sf, "documents")
    model = L.fit(docs.where(~L.held_out(docs.doc_id)), centroids=3, per_language=40)
    assert model.languages == sorted(model.languages) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    rows = docs.orderBy("doc_id").limit(60)
    got = {r["doc_id"]: r for r in L.identify(rows, model).collect()}
    for r in rows.collect():
        v = {s: math.log(1 + c) * model.idf[s] for s, c in brute_slots(r["text"]).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[s]) for s, x in v.items()) / norm for c in model.centroids]
        g = got[r["doc_id"]]
        assert g["text"] == r["text"] and abs(g["score"] - max(cos)) < 1e-4 and 0 <= g["score"] <= 1
        assert cos[model.languages.index(g["lang_pred"])] <= max(cos) and max(c for c, n in zip(cos, model.languages) if n == g["lang_pred"]) > max(cos) - 1e-4


def test_held_out_accuracy(spark, sf):
    rows = L.op12_langid(spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_only_text_and_other_documents_decide(spark, sf):
    """Held-out labels, and the order of rows, change nothing."""
    from pyspark.sql import functions as F

    docs = table(spark, sf, "documents")
    lied = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).orderBy(F.desc("doc_id"))
    a, b = (L.fit(d.where(~L.held_out(F.col("doc_id"))), per_language=60) for d in (docs, lied))
    assert a.languages == b.languages and np.array_equal(a.centroids, b.centroids) and "xx" not in a.languages


def test_rejection(spark, sf):
    docs = table(spark, sf, "documents")
    model = L.fit(docs, per_language=80)
    odd = spark.createDataFrame([(1, "zqxj kvwq zzzqx qqjx xkcd wvvk"), (2, "1 2 3"), (3, None)], "doc_id long, text string")
    assert [r["rejected"] for r in L.identify(odd, model).orderBy("doc_id").collect()] == [True] * 3
    known = L.identify(docs, model)
    assert known.where("rejected").count() < 0.1 * docs.count()


def test_odd_rows(odd, none, spark):
    model = L.fit(odd.fillna({"lang": "de"}))
    clash = odd.withColumn("score", odd.n).withColumn("lang_pred", odd.n)
    out = L.identify(clash, model)
    assert out.columns == [*odd.columns, "lang_pred", "score", "rejected"]
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    nothing = L.fit(none)
    assert nothing.languages == [] and L.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in L.identify(odd, nothing).collect()} == {"und"}
