import random
import zlib

from platewright.llm import toxicity as t


def brute_segments(scores):
    """By the definition: the best segment, then the same in what is left of it and right of it."""
    best = max(((sum(scores[b:e]), b - e, -b, b, e) for b in range(len(scores)) for e in range(b + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    b, e = best[3:]
    shift = [(x + e, y + e) for x, y in brute_segments(scores[e:])]
    return brute_segments(scores[:b]) + [(b, e)] + shift


def test_segments_equal_the_definition():
    rng = random.Random(2)
    for _ in range(300):
        gap = -rng.choice([0.3, 1.0, 2.5])
        hits = {k: rng.choice([0.7, 1.3, 2.9]) + rng.random() / 1000 for k in range(20) if rng.random() < 0.3}
        scores = [hits.get(k, gap - 1e-9) for k in range(20)]
        got = t.maximal_segments(sorted(hits.items()), gap - 1e-9)
        assert [(b, e) for b, e, _ in got] == brute_segments(scores)
        assert all(abs(s - sum(scores[b:e])) < 1e-9 for b, e, s in got)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(4)
    docs, labels = [(-1, None), (-2, ""), (-3, "vile " * 30000)], []
    for i in range(900):
        toxic = i % 5 == 0
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 90))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "nasty"])
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    docs += [(2000 + i, docs[8][1]) for i in range(50)]
    labels += [(2000 + i, 1) for i in range(50)] + [(5, None), (None, 1), (99999, 1)]
    d = spark.createDataFrame([(i, x, "e") for i, x in docs], "doc_id long, text string, label string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = t.score(d, t.fit(d, y)).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r for r in out}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(by_id[i]["predicted"] == (i % 5 == 0) for i in held) > 0.95 * len(held)
    assert by_id[-1]["score"] == by_id[-2]["score"] < 0.5 < by_id[-3]["score"]
    assert by_id[-3]["segments"]


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in t.score(d, t.fit(d, none)).collect()} == {0.5}
    assert t.score(d.limit(0), t.fit(d.limit(0), none)).count() == 0
