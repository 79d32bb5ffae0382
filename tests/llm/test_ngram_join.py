import random

from corelev.llm import ngram_join as J
from corelev.llm.common import table


def sets_of(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=75):
    """[(doc_id, n, component_id)] by comparing all pairs that share a shingle."""
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for k, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    tried = set()
    for ks in by.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    o = len(sets[a] & sets[b])
                    if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got(J.op2_ngram_join(spark, sf).select("doc_id", "n_shingles", "component_id")) == want
    assert any(i != c for i, _, c in want)


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = J.set_components(odd)
    assert got(out) == brute(rows)
    keep = out.where("representative")
    assert keep.select("component").where("component is not null").distinct().count() == out.select("component").where("component is not null").distinct().count()
    assert J.set_components(none).count() == 0


def test_chains_and_a_large_group(spark):
    """Copies of one text with more and more edits, common passages, sizes that differ: links and components are exact."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base, passage = [word() for _ in range(120)], [word() for _ in range(40)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w[: r.choice([120, 118, 100])])))
    for i in range(200):
        rows.append((2000 + i, " ".join(passage + [word() for _ in range(r.choice([5, 8, 60]))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.set_components(docs)) == brute(rows)
    assert got(J.set_components(docs, percent=90)) == brute(rows, 90)


def test_connected_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 150), (150, 300), (7, 400), (500, 500)] + [(r.randrange(600, 900), r.randrange(600, 900)) for _ in range(120)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["node"]: x["root"] for x in J.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in (a, b) and a != b for a, b in links)}


def test_few_comparisons(spark, monkeypatch):
    """Near copies take about one comparison a set, texts of passages that many others hold too few more; components stay exact."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, passages = [word() for _ in range(150)], [[word() for _ in range(25)] for _ in range(40)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(1, 3)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(150):
        rows.append((1000 + i, " ".join(x for k in r.sample(range(40), 8) for x in passages[k])))
    compared, before = [], J._verified

    def counted(pairs, *args):
        compared.append(pairs.count())
        return before(pairs, *args)

    monkeypatch.setattr(J, "_verified", counted)
    assert got(J.set_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sum(compared) <= 3000, compared
