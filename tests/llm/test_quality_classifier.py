import random
import zlib

from platewright.llm import quality_classifier as q


def test_strength_shrinks_sparse_sites(spark):
    rows = [("a", "x", 0.9)] * 200 + [("b", "x", 0.1)] * 200 + [("c", "x", 0.0), (None, None, 1.0)]
    own = spark.createDataFrame(rows, "host string, path string, own double")
    got = {r["host"]: (r["site"], r["base"]) for r in q.posteriors(own).collect()}
    base = got["a"][1]
    assert abs(got["a"][0] - 0.9) < 0.02 and abs(got["b"][0] - 0.1) < 0.02
    assert 0.05 < got["c"][0] < base and base < got[None][0] < 0.95


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(6)
    docs, labels = [(-1, None, None, None), (-2, "", "s0", "en")], []
    for i in range(600):
        good = i % 4 > 0
        words = [f"word{rng.randint(0, 900)}" for _ in range(60)]
        text = " ".join(words) if good else rng.choice([" ".join(w + "%%%" for w in words), " ".join(words[:3] * 20), " ".join(words).upper() + "!!"])
        docs.append((i, text, f"s{i % 7}", "en"))
        if i % 2:
            labels.append((i, int(good)))
        else:
            labels.append((i, int(good)) if i % 8 == 0 else (i, None))
    docs += [docs[5]] * 3
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    out = q.score(d, y).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r for r in out}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(by_id[i]["kept"] == (i % 4 > 0) for i in held) > 0.95 * len(held)


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b", "s", "en")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [round(r["score"], 6) for r in q.score(d, none).collect()] == [0.5]
    assert q.score(d.limit(0), none).count() == 0
