import random
import re

from platewright.llm import decontaminate as d


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(doc, items, window):
    doc, hit, found = words(doc), set(), set()
    for i, text in items:
        item = words(text)
        n = min(window, len(item))
        grams = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        for k in range(len(doc) - n + 1):
            if n and tuple(doc[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        text = lambda n: " ".join(rng.choice("abc") for _ in range(n))  # noqa: E731,B023
        items = [(str(i), text(rng.randint(0, 9))) for i in range(5)]
        built = d.Automaton([(i, t.encode()) for i, t in items], 4)
        for _ in range(10):
            doc = text(rng.randint(0, 25)) + " zz " + text(6)
            spans, ids = built.hits(d.WORD.findall(doc.encode()))
            hit, found = brute(doc, items, 4)
            assert {k for b, e in spans for k in range(b, e)} == hit
            assert ids == found
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


ITEM = "Ünïcode WORDS one two three four five six seven eight nine ten eleven twelve"


def _frames(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short Item here"), (3, None), (4, "..."), (1, ITEM)], "item_id long, text string")
    docs = [
        (1, None),
        (2, ""),
        (3, "before, " + ITEM.lower().replace("ü", "ü") + "! after"),
        (4, "x " * 400 + "SHORT-item: here, and on."),
        (5, "clean text only"),
        (5, "clean text only"),
    ]
    return spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, n_words string"), bench


def test_blocks_give_the_same_spans(spark):
    docs, bench = _frames(spark)
    one = {(r["doc_id"], tuple(r["_dc_spans"]), tuple(r["_dc_items"])) for r in d.scan(docs, bench).collect()}
    many = {(r["doc_id"], tuple(r["_dc_spans"]), tuple(r["_dc_items"])) for r in d.scan(docs, bench, block_bytes=40).collect()}
    assert one == many and len(one) == 5


def test_remove(spark):
    docs, bench = _frames(spark)
    out = d.remove(docs, bench)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(kept) == {1, 2, 4, 5} and out.count() == 5
    assert kept[1] is None and kept[4] == "x " * 400 + ", and on." and kept[5] == "clean text only"
    assert d.remove(docs, bench.limit(0)).count() == 6
    assert d.remove(docs.limit(0), bench).count() == 0
