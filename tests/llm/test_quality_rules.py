import re
from collections import Counter

from platewright.llm import quality_rules as q

TEXTS = [
    None,
    "",
    "  \n\t ",
    "one two three",
    "a b c d e f g h " * 5,
    "w1 w2 w3 w4 w5 w6 w7 w8 w9 " + "x y z " + "w1 w2 w3 w4 w5 w6 w7 w8 w9",
    " ".join(f"word{i}" for i in range(500)),
    "same line here\n" * 9 + "other\n\n \n",
    "### $$$ & < > | %%% " * 10 + " ".join(f"u{i}" for i in range(30)),
    "ÉCOLE DES CAPITALES " * 3 + " ".join(f"MOT{i}" for i in range(40)),
    " nbsp stays in words " + " ".join(f"k{i}" for i in range(25)),
    "long " * 20000,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    out = q.cascade(docs, q.RULES, with_stats=True).collect()
    for r in out:
        got = tuple(r[f"_qr_{k}"] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == brute(TEXTS[r["doc_id"]]), r["doc_id"]


def test_order_changes_nothing_and_names_stay(spark):
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)], "doc_id long, text string, extra string")
    ordered = [rule for rule, _, _ in q.plan(docs)]
    assert sorted(r.name for r in ordered) == sorted(r.name for r in q.RULES)
    verdicts = []
    for order in (ordered, q.RULES, q.RULES[::-1]):
        verdicts.append({r["doc_id"]: r["_qr_failed"] is None for r in q.cascade(docs, order).collect()})
    assert verdicts[0] == verdicts[1] == verdicts[2]
    assert {i for i, ok in verdicts[0].items() if ok} == {6, 10}
    kept = q.keep(spark, docs)
    assert kept.columns == docs.columns and kept.count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.keep(spark, docs).count() == 0


def test_only_named_statistics_are_computed_for_every_document(spark):
    texts = ["one two", "word " * 30, "ONE TWO THREE FOUR " * 10, " ".join(f"word{i}" for i in range(40))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    every = q.cascade(docs, q.RULES, with_stats=True)
    some = q.cascade(docs, q.RULES, with_stats=("n_words",))
    assert some.columns == ["doc_id", "text", "_qr_n_words", "_qr_failed"]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.select(*some.columns).collect()))


def test_columns_of_any_name_are_carried(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, failed_rule string, `a.b` int, _qr_failed int")
    kept = q.keep(spark, docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {(i, TEXTS[i], "x", 1, 2) for i in (6, 10)}


def test_the_order_is_the_same_each_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    orders = [[(rule.name, share) for rule, share, _ in q.plan(docs)] for _ in range(2)]
    assert sorted(orders[0]) == sorted(orders[1])
