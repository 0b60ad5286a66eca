import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from platewright.llm import packing


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    clean = {i: "\n".join(words(30) for _ in range(4)) for i in range(10)}
    shared = words(25)
    passage = words(60)
    docs = dict(clean)
    docs[20] = "too few words"
    docs[21] = "again and again " * 40
    docs[22] = " ".join(w + "%%%" for w in words(60).split())
    docs[30] = shared + "\n" + words(80)
    docs[31] = words(80) + "\n" + shared
    docs[32] = clean[3]
    docs[40] = words(200).replace("\n", " ")
    edited = docs[40].split()
    edited[50] = edited[120] = "changed"
    docs[41] = " ".join(edited)
    docs[50] = words(10) + " " + passage + " " + words(10)
    docs[51] = words(900) + " " + " ".join(passage.split()[:20]) + " " + words(900)
    docs[60] = None
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns and dict(out.dtypes) == dict(frame.dtypes), name
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"]: r["text"] for r in frame.collect()})
    assert set(docs) - set(seen[0]) == {20, 21, 22, 60} and all(seen[0][i] == docs[i] for i in seen[0])
    assert set(seen[0]) - set(seen[1]) == {32, 41}  # no line of these is left
    assert seen[1][31] == docs[31].split("\n")[0] and seen[1][30] == docs[30]
    assert set(seen[1]) == set(seen[2])
    assert set(seen[2]) - set(seen[3]) == {50}
    assert passage.split()[5] not in seen[3][51].split() and len(seen[3][51].split()) == 1800
    assert all(seen[3][i] == clean[i] for i in clean)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in seen[3].items()}
    pieces = p.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == {i: len(x) for i, x in want.items()}
    for r in pieces:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())


def test_near_copies_across_lines_meet_in_the_join(spark):
    rng = random.Random(12)
    text = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    rows = [(1, "\n".join(" ".join(text[k : k + 7]) for k in range(0, 400, 7))), (2, " ".join(text)), (3, "another text of its own kind")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
