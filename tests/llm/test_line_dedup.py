import random

from pyspark.sql import functions as F

from platewright.llm import line_dedup as d


def shingle_set(line, n=5):
    return {line[k : k + n] for k in range(len(line) - n + 1)}


def brute(docs, least=40, percent=80):
    """(dropped lines, pairs of different lines that are similar)."""
    lines = [(i, k, x.strip(" ")) for i, t in docs if t is not None and i is not None for k, x in enumerate(t.split("\n"))]
    lines = sorted((i, k, x) for i, k, x in lines if len(x) >= least)
    texts = sorted({x for _, _, x in lines})
    low = {x: x for x in texts}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    sets, pairs = {x: shingle_set(x) for x in texts}, []
    for k, a in enumerate(texts):
        for b in texts[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * len(sets[a] | sets[b]):
                pairs.append((a, b))
                low[max(root(a), root(b))] = min(root(a), root(b))
    seen, gone = {}, set()
    for i, k, x in lines:
        if seen.setdefault(root(x), (i, k)) != (i, k):
            gone.add((i, k))
    return gone, pairs


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randint(9, 40)))
    bases, docs = [line() for _ in range(40)], []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = line() if rng.random() < 0.4 else rng.choice(bases)
            if rng.random() < 0.5:
                w = x.split(" ")
                for _ in range(rng.randint(1, 2)):
                    w[rng.randrange(len(w))] = word()
                x = " ".join(w)
            lines.append(x)
        lines.insert(rng.randint(0, len(lines)), rng.choice(["Short.", "", "Les.", "  "]))
        docs.append((i, "\n".join(lines)))
    return docs


def test_recall_and_exactness_against_brute_force(spark):
    docs = corpus(1)
    gone, pairs = brute(docs)
    frame = spark.createDataFrame([(i, t, "p") for i, t in docs], "doc_id long, text string, pos string")
    got = {(r["_ld_id"], r["pos"]) for r in d.dropped_lines(frame, least=40).collect()}
    assert len(gone) > 100 and got <= gone
    assert len(got) >= 0.95 * len(gone)


def test_kept_text_and_columns(spark):
    twin = "This line stands in two documents, and it is long enough to count."
    near = twin.replace("two", "tw0")
    docs = [(3, f"a\n{twin}\nb\nb", "x"), (5, f"{twin}\n\nend", None), (1, None, "x"), (2, "", "x"), (None, twin, "x"), (8, near, "x"), (9, f"  {twin} ", "x"), (9, f"  {twin} ", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, line string")
    out = {(r["doc_id"], r["text"], r["_ld_lines"], r["_ld_dropped"]) for r in d.dedup(frame).collect()}
    assert out == {(3, f"a\n{twin}\nb", 4, 1), (5, "\nend", 3, 1), (1, None, 0, 0), (2, "", 1, 0), (None, twin, 1, 0), (8, "", 1, 1), (9, "", 1, 1)}
    kept = d.keep(spark, frame)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "None"]


def test_long_lines_without_blanks(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("漢字仮名交文章長行") for _ in range(3000))
    frame = spark.createDataFrame([(1, base), (2, base[:1500] + "x" + base[1500:]), (3, base[::-1]), (4, "z" * 20000)], "doc_id long, text string")
    assert {r["_ld_id"] for r in d.dropped_lines(frame).collect()} == {2}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert d.dedup(frame).count() == 0 and d.keep(spark, frame).count() == 0


def test_short_lines_in_the_pipeline_stage(spark):
    short = "Released under the MIT License."
    docs = [(1, f"{short}\n\na"), (2, f"x\n{short}\n\n---"), (3, "---\n\na"), (4, short), (5, "b\nc")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in d.keep(spark, frame).collect()} == {docs[0], (2, "x\n\n---"), (3, "---\n"), docs[4]}


def test_near_copies_in_a_template_family(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(4, 8)))
    template, docs = [word() for _ in range(40)], []
    for i in range(300):
        w = list(template)
        for k in (5, 18, 31):
            w[k] = word() + word()
        line = " ".join(w)
        docs += [(2 * i, line), (2 * i + 1, line + "!")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    gone, _ = brute(docs)
    assert 290 <= len(gone) <= 400
    for crowd in (1000, 20):
        got = {(r["_ld_id"], r["pos"]) for r in d.dropped_lines(frame, crowd=crowd).collect()}
        assert got <= gone and len(got) >= 0.95 * len(gone)


def test_recall_of_similar_lines_by_length(spark):
    rng, rows, n = random.Random(9), [], 100
    for size in (10, 20, 40, 60, 120, 200):
        found = 0
        while found < n:
            x = "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(size - 2))
            x = y = f"x{x}z"
            for _ in range(rng.randint(1, max(1, size // 40))):
                at = rng.choice([0, len(y), rng.randrange(len(y))])
                y = y[:at] + rng.choice("ABCDEFG") + y[at + rng.randint(0, 1) :]
            a, b = shingle_set(x), shingle_set(y)
            if x != y and 0.8 <= len(a & b) / len(a | b) < (0.9 if size >= 60 else 1):
                rows += [(size * 1000 + 2 * found, x), (size * 1000 + 2 * found + 1, y)]
                found += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["_ld_id"] // 1000 for r in d.dropped_lines(frame, least=1).collect()]
    for size in (10, 20, 40, 60, 120, 200):
        assert 0.95 * n <= got.count(size) <= n, size


def test_other_columns_by_any_name(spark):
    line = "This line stands in two documents, and it is long enough to count."
    frame = spark.createDataFrame([(1, line, 1, 2, 3), (2, line, 4, 5, 6)], "doc_id long, text string, `a.b` long, pos long, `x y` long")
    assert {tuple(r) for r in d.keep(spark, frame).collect()} == {(1, line, 1, 2, 3)}
    clash = frame.withColumnRenamed("pos", "_ld_gone").withColumnRenamed("a.b", "_ld_dropped")
    kept = d.keep(spark, clash)
    assert kept.columns == clash.columns and {tuple(r) for r in kept.collect()} == {(1, line, 1, 2, 3)}


def test_recall_of_near_copies_alone(spark):
    """On the given documents: of the lines that are near, not equal, to a smaller one, all but a few are dropped, and no other."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    gone, _ = brute([(r["doc_id"], r["text"]) for r in rows], least=40)
    first = {}
    for i, k, x in sorted((r["doc_id"], k, x.strip(" ")) for r in rows for k, x in enumerate((r["text"] or "").split("\n"))):
        first.setdefault(x, (i, k))
    near = gone & set(first.values())
    frame = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    got = {(r["_ld_id"], r["pos"]) for r in d.dropped_lines(frame, least=40).collect()}
    assert len(near) >= 30 and got <= gone
    assert len(got & near) >= 0.95 * len(near)


def test_no_pair_of_a_crowded_band_is_left_out(spark):
    """Lines that share one band and no other: every two similar ones are given, whatever ``crowd`` is."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(4, 8)))
    template, lines = [word() for _ in range(30)], []
    for _ in range(40):
        w = list(template)
        for k in (5, 18, 25):
            w[k] = word() + word()
        lines += [" ".join(w), " ".join(w) + "!"]
    similar = {(i, j) for i in range(80) for j in range(i + 1, 80) if len(shingle_set(lines[i]) & shingle_set(lines[j])) >= 0.8 * len(shingle_set(lines[i]) | shingle_set(lines[j]))}
    bands = spark.createDataFrame([(7, i) for i in range(80)], "key long, h long")
    texts, alone = spark.createDataFrame(list(enumerate(lines)), "h long, line string"), spark.createDataFrame([], "node long, component long")
    assert len(similar) >= 40
    got = {crowd: {(r["a"], r["b"]) for r in d.crossing_pairs(bands, alone, texts, 5, 80, crowd).collect()} for crowd in (1, 1000)}
    assert similar <= got[1] <= got[1000] and len(got[1000]) == 80 * 79 / 2
    assert len(got[1]) < len(got[1000])


def test_lines_of_a_common_passage_make_few_pairs(spark):
    """Lines that share a passage and several bands: of their 3,160 pairs only those that can be similar become rows, once each, and no similar one is missed."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(4, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, lines = text(80), []
    for _ in range(40):
        line = f"{text(20)} {passage} {text(20)}"
        lines += [line, line.replace(passage[:9], "Another")]
    pairs = [(i, j) for i in range(80) for j in range(i + 1, 80)]
    similar = {(i, j) for i, j in pairs if len(shingle_set(lines[i]) & shingle_set(lines[j])) >= 0.8 * len(shingle_set(lines[i]) | shingle_set(lines[j]))}
    assert len(similar) == 40
    bands = spark.createDataFrame([(key, i) for key in (7, 8, 9) for i in range(80)], "key long, h long")
    texts, alone = spark.createDataFrame(list(enumerate(lines)), "h long, line string"), spark.createDataFrame([], "node long, component long")
    got = sorted((r["a"], r["b"]) for r in d.crossing_pairs(bands, alone, texts, 5, 80).collect())
    assert similar <= set(got) and len(got) == len(set(got)) < 80


def test_maps_rule_out_lines_that_are_half_alike(spark):
    rng = random.Random(17)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    rows = []
    for size in (60, 300, 900):
        for _ in range(20):
            passage = text(size)
            rows += [(passage + text(size // 3), passage + text(size // 3)), (passage + text(size // 20), passage)]
    lines = spark.createDataFrame([(2 * k + i, x) for k, p in enumerate(rows) for i, x in enumerate(p)], "h long, line string")
    maps = d.sketched(lines, 5)
    met = maps.alias("x").join(maps.alias("y"), (F.col("x.h") % 2 == 0) & (F.col("x.h") + 1 == F.col("y.h")))
    kept = {r["h"] // 2 for r in met.where(d.may_be_alike("x", "y", 80)).select("x.h").collect()}
    alike = {k for k, (x, y) in enumerate(rows) if len(shingle_set(x) & shingle_set(y)) >= 0.8 * len(shingle_set(x) | shingle_set(y))}
    assert len(alike) == 60 and alike <= kept and len(kept - alike) <= 3


def test_shingles_of_any_characters(spark):
    lines = ["", "abcd", "abcde", "näive 漢字 \U0001f600\U0001f601 x", "aaaaaaa"]
    rows = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    got = {r["h"]: r["s"] for r in rows.select("h", d.shingles("line", 5).alias("s")).collect()}
    for k, x in enumerate(lines):
        assert len(got[k]) == max(0, len(x) - 4) and len(set(got[k])) == len(shingle_set(x))


def test_shuffle_files_go_with_their_query(spark):
    import time

    from pyspark.sql import functions as F

    from platewright.llm.common import written

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in str(manager.getAllFiles().mkString("|")).split("|") if "shuffle_" in f}
    before = files()
    out = written(spark.range(20000).groupBy((F.col("id") % 5000).alias("k")).agg(F.collect_list("id").alias("v")), "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 5000


def test_band_keys_are_the_smallest_hashes_of_each_part(spark):
    rng, words = random.Random(19), []
    for size in (6, 12, 20, 36, 60, 150, 400, 1500):
        words += ["".join(rng.choice("abcdefghijklmnopqrst" + " " * blanks) for _ in range(size)) for blanks in (0, 1, 6)]
    lines = spark.createDataFrame(list(enumerate(words)), "h long, line string")
    sets = d.band_sets(lines, 5)
    assert not sets.schema["s"].dataType.containsNull  # else each hash is an object for Spark's sort
    want = set()
    for r in sets.where("s is not null").collect():
        s, bits = sorted(r["s"]), r["bits"]
        part = [(x >> (64 - bits)) for x in s]
        for p in set(part):
            at, n = part.index(p), part.count(p)
            take = max(3, min(4, n)) if bits == 4 else min(7, n)
            want.add((bits, tuple((s + s[:3])[at : at + take]), r["h"]))
    assert {b for b, _, _ in want} == {2, 3, 4}
    keys = spark.createDataFrame([(b, list(x), h) for b, x, h in want], "bits int, x array<bigint>, h long").select(F.xxhash64("bits", "x").alias("key"), "h")
    got = d.band_keys(lines, 5, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, keys.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "array_position(" not in plan


def test_scratch_tables_shuffle_into_one_file_a_task(spark, monkeypatch):
    """Spark opens a file for each partition of a task up to 200 of them: scratch tables are written with one more, and the session keeps its number."""
    from pyspark.sql import DataFrameWriter

    from platewright.llm.common import PARTITIONS, written

    seen, write, own = [], DataFrameWriter.parquet, spark.conf.get(PARTITIONS)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(self._spark.conf.get(PARTITIONS)), write(self, *a, **k))[1])
    try:
        for n in ("200", "101", "100", "4", "211"):
            spark.conf.set(PARTITIONS, n)
            assert written(spark.range(50).groupBy((F.col("id") % 5).alias("k")).count(), "few").count() == 5
            assert spark.conf.get(PARTITIONS) == n
    finally:
        spark.conf.set(PARTITIONS, own)
    assert seen == ["201", "201", "100", "4", "211"]
