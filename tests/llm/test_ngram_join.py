import random

import numpy as np
import pytest

from platewright.llm import ngram_join as j
from platewright.llm.components import components


def brute(docs, n=4, percent=85):
    sets = {}
    for i, t in docs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    r, s = sorted((root(a), root(b)))
                    low[s] = r
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one TWO"), (4, "One two"), (5, "one two three"), (6, "w " * 50000)]
    text = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    for base in range(12):
        words = text(rng.choice([6, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 99)}"
            docs.append((len(docs), " ".join(copy)))
    for _ in range(40):
        docs.append((len(docs), passage + " " + " ".join(text(rng.randint(5, 60)))))
    docs += [(len(docs) + k, docs[20][1]) for k in range(25)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"block_rows": 8, "group_shingles": 900, "broadcast_ids": 0})])
def test_equals_brute_force(spark, seed, how):
    docs = corpus(seed)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n long")
    got = j.link_components(d, **how).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs)


def test_odd_rows(spark):
    d = spark.createDataFrame([(7, "a b c d e", "x"), (7, "a b c d e", "x"), (None, "a b c d e", "x"), (9, "A b c d e", None)], "doc_id long, text string, lang string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in j.link_components(d).collect()) == [("7", "7"), ("7", "7"), ("9", "7"), ("None", "None")]
    kept = j.keep(spark, d)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "None"]
    assert j.link_components(d.limit(0)).count() == 0 and j.keep(spark, d.limit(0)).count() == 0


def test_tree_bound_misses_nothing():
    rng = np.random.default_rng(5)
    points = rng.poisson(3, (400, 64))
    points[200:] = np.maximum(points[:200] - (rng.random((200, 64)) < 0.05), 0)
    tree = j.Tree(points)
    for q in range(0, 400, 7):
        overlap = np.minimum(points, points[q]).sum(1)
        assert set(tree.near(q, 85)) == set(np.flatnonzero(overlap >= j.needed(points.sum(1), points[q].sum(), 85)))


def test_forest_connects_across_size_classes(monkeypatch):
    monkeypatch.setattr(j, "CLASSES", ((40, 4), (80, 16), (1 << 62, 64)))
    rng = np.random.default_rng(7)
    sets = []
    for size in list(range(30, 50)) * 2 + list(range(70, 95)):
        base = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        keep = base[rng.random(len(base)) > 0.06]
        sets += [base, keep, np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 4, np.uint64)]))]
    edges = j.forest([j.counts_of(s) for s in sets], 85, j.Sets(sets, 85).links)

    def parts(pairs):
        low = list(range(len(sets)))

        def root(x):
            while low[x] != x:
                x = low[x]
            return x

        for a, b in pairs:
            low[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(len(sets))]

    real = []
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                real.append((a, b))
    assert parts(edges) == parts(real) and len(real) > 50


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5000, 5000), (None, 3)]
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            r, s = sorted((root(a), root(b)))
            low[s] = r
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, root(x)) for x in list(low))


def test_blocks_of_long_documents_are_bounded_by_bytes(spark):
    """A block of long documents is dealt into chunks; what is found stays the same."""
    rng = random.Random(31)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    docs = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(3000), 10 if i % 2 else 400):
            w[k] = f"x{rng.randint(0, 10**9)}"
        docs.append((i, " ".join(w), 1, 2))
    frame = spark.createDataFrame(docs, "doc_id long, text string, `a.b` int, id int")
    want = {r["doc_id"]: r["component_id"] for r in j.link_components(frame).collect()}
    got = {r["doc_id"]: r["component_id"] for r in j.link_components(frame, block_bytes=20_000, group_shingles=20_000).collect()}
    assert got == want and len({want[i] for i in range(1, 60, 2)}) == 1
    assert j.counts_of(j.shingles(docs[0][1].encode(), 4)).nbytes * 60 > 5 * 20_000
    kept = j.keep(spark, frame)
    assert kept.columns == frame.columns and kept.count() == len(set(want.values()))


def test_of_rows_with_one_id_the_smallest_text_stays(spark):
    frame = spark.createDataFrame([(1, "b b", 1), (1, "a a", 2), (2, "c", 3), (None, "a a", 4)], "doc_id long, text string, n long")
    assert sorted(map(str, (tuple(r) for r in j.keep(spark, frame).collect()))) == ["(1, 'a a', 2)", "(2, 'c', 3)", "(None, 'a a', 4)"]


def test_texts_that_stay_do_not_shuffle(spark, tmp_path):
    """What stays is decided by ids; the documents then meet the few ids that go, and are aggregated only where rows repeat an id."""
    docs = [(i, t, i % 3) for i, t in corpus(3)] + [(7, "twice a b c d", 1), (7, "twice a b c", 2), (None, "one two three", 3), (None, None, 4)]
    spark.createDataFrame(docs, "doc_id long, text string, n long").write.parquet(f"{tmp_path}/docs")
    frame = spark.read.parquet(f"{tmp_path}/docs")
    kept = j.keep(spark, frame)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # the ids, broadcast for either part, and the rows that repeat an id
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1 and "SortMergeJoin" not in plan
    rows = sorted(map(str, (tuple(r) for r in kept.collect())))
    assert rows == sorted(map(str, (tuple(r) for r in j.keep(spark, frame, broadcast_ids=0).collect())))
    linked = [tuple(r) for r in j.link_components(frame).select("doc_id", "component_id").collect()]
    stay = {i for i, c in linked if i is not None and i == c}
    first = {}
    for r in docs:
        if r[0] in stay:
            first[r[0]] = min(first.get(r[0], r), r, key=lambda x: (x[1] is not None, x[1] or "", x[2]))
    assert rows == sorted(map(str, [*first.values(), *(r for r in docs if r[0] is None)]))
