import collections
import hashlib

from corelev.llm import line_dedup as L
from corelev.llm import sharding as S
from corelev.llm.common import table


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(L.BLANKS))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    last = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in last or last[key(x)] == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def by(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_line_dedup_odd_rows(odd):
    out = L.line_dedup(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect()]
    assert by(got) == by(brute_lines([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]))
    assert [r["text"] for r in out.where("doc_id = 0").collect()] == [None]


def test_line_dedup_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines([tuple(r) for r in docs.select("doc_id", "text").collect()])]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in L.op10_line_dedup(spark, sf).collect()]
    assert by(got) == by(want) and any(r[2] for r in got)


def test_line_dedup_empty(none):
    assert L.line_dedup(none).count() == 0


def check_law(rows, n, shards=8):
    assert len(rows) == n
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(spark, sf, odd, none):
    rows = S.op9_sharding(spark, sf).collect()
    check_law(rows, table(spark, sf, "documents").count())
    groups = collections.defaultdict(set)
    for r in rows:
        groups[(r["text_crc32"], r["size"])].add(r["shard"])
    copies = collections.Counter((r["text_crc32"], r["size"]) for r in rows)
    cut = sum(len(groups[k]) > 1 for k, c in copies.items() if c > 1)
    assert cut <= max(7, sum(c > 1 for c in copies.values()) // 4)
    check_law(S.shard(odd).collect(), odd.count())
    assert S.shard(none).count() == 0


def test_shards_own_links(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string")
    links = spark.createDataFrame([(i, i - i % 10) for i in range(400) if i % 10], "a long, b long")
    rows = S.shard(docs, shards=4, links=links).collect()
    check_law(rows, 400, 4)
    at = {r["doc_id"]: r["shard"] for r in rows}
    same = sum(at[i] == at[i - i % 10] for i in at if i % 10)
    assert same > 0.45 * 360  # 0.25 by chance


def test_equal_texts_stay_together(spark):
    """Every group of equal texts is whole, but the one at each of the seven borders."""
    sizes = [2] * 300 + [5] * 100 + [20] * 40 + [200] * 10
    rows = [(f"text {g}",) for g, k in enumerate(sizes) for _ in range(k)] + [(f"own {i}",) for i in range(2000)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(rows)], "doc_id long, text string")
    out = S.shard(docs).collect()
    check_law(out, len(rows))
    at = collections.defaultdict(set)
    for r in out:
        at[rows[r["doc_id"]]].add(r["shard"])
    assert sum(len(v) > 1 for v in at.values()) <= 7
