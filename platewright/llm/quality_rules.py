"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a document. ``plan`` measures, on a bounded sample, what share
each rule rejects and what it costs; the rules then run in the order of rejection per cost, in one
CASE whose later branches are not evaluated for a document that an earlier one has rejected. The
order changes the time taken, never the verdict: a document is kept if no rule rejects it.

Edge cases: a null text counts as the empty text; it has no words and is rejected by ``few_words``.
Rows are judged one by one, so repeated rows get equal verdicts, and an empty table gives an empty
result. Columns other than the text are carried along unread, whatever their names; ``keep`` also carries
columns that start like the work columns, ``_qr_``, which ``cascade`` replaces where it reports one of that name.
"""

from __future__ import annotations

import math
import statistics
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.llm.common import SPACE, carrying, let, named, table, text_of, written

WINDOW = 8
MIN_WORDS = 20
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_distinct")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of that many words which the text has twice or more.

    Hashes of the windows come first: only a text in which two of them are equal has its windows
    sorted, as strings, so hash collisions can't change the count. n log n in the words of a text.
    """
    starts = F.sequence(F.lit(1), F.size(words) - window + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(at: Column) -> Column:
        step = lambda a, j: a + F.when(j == F.size(at), F.lit(window)).otherwise(F.least(F.lit(window), F.get(at, j) - F.get(at, j - 1)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(at)), F.lit(0), step))

    def counted(ordered: Column) -> Column:
        same = lambda e, j: (F.get(ordered, j - 1)["k"] == e["k"]) | (F.get(ordered, j + 1)["k"] == e["k"])
        twice = F.filter(ordered, lambda e, j: F.coalesce(same(e, j), F.get(ordered, j - 1)["k"] == e["k"], F.get(ordered, j + 1)["k"] == e["k"]))
        return let(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

    exact = let(F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, window), " ").alias("k"), i.alias("i")))), counted)
    unlike = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) <= window, F.lit(0)).when(unlike, F.lit(0)).otherwise(exact).cast("long")


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))


def stats(text: Column, words: Column) -> dict[str, Column]:
    lines = lines_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_upper": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
        "n_distinct": F.size(F.array_distinct(words)).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """rejects: from the statistics by name to a condition that is never null."""

    name: str
    rejects: object


RULES = [
    Rule("few_words", lambda s: s["n_words"] < MIN_WORDS),
    Rule("repeated_words", lambda s: s["n_repeat_words"] * 100 > s["n_words"] * 30),
    Rule("symbols", lambda s: s["n_symbols"] * 100 > s["word_chars"] * 5),
    Rule("repeated_lines", lambda s: s["n_dup_lines"] * 100 > s["n_lines"] * 45),
    Rule("capitals", lambda s: s["n_upper"] * 100 > s["word_chars"] * 35),
    Rule("word_length", lambda s: (s["word_chars"] > s["n_words"] * 15) | (s["word_chars"] < s["n_words"] * 2)),
    Rule("few_distinct", lambda s: s["n_distinct"] * 20 < F.least(s["n_words"], F.lit(400))),
]
BASE = ("few_words", "repeated_words")


def plan(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", sample_rows: int = 1000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds), best order first. The sample has sample_rows rows at most, drawn from the whole table."""
    n = docs.count()
    sample = docs.select(named(text_col).alias("_qr_raw"))
    if n > sample_rows:  # an even draw over the whole table
        sample = sample.sample(min(1.0, 1.2 * sample_rows / n), seed).orderBy(F.rand(seed)).limit(sample_rows)
    sample = written(sample.repartition(1), "rules-sample")
    text = text_of("_qr_raw")

    def seconds(rejected: Column, runs: int = 3) -> tuple[float, float]:
        """(share rejected, median time of a few runs after one that compiles)"""
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            row = sample.agg(F.count("*").alias("n"), F.sum(rejected).alias("out")).first()
            took.append(time.perf_counter() - began)
        return (row["out"] or 0) / max(1, row["n"]), statistics.median(took[1:])

    # what every rule pays, the job and the split into words, isn't a rule's own cost
    _, idle = seconds(let(words_of(text), lambda w: (F.size(w) < 0).cast("int")))
    found = []
    for rule in rules:
        share, took = seconds(let(words_of(text), lambda w: rule.rejects(stats(text, w)).cast("int")))  # noqa: B023  called at once
        found.append((rule, share, max(took - idle, 0.02 * idle)))
    # costs are told apart by factors of two only: below that it is noise that would change the order from run to run
    return sorted(found, key=lambda x: (-x[1] / 2 ** round(math.log2(x[2])), x[0].name))


def cascade(docs: DataFrame, ordered: list[Rule], text_col: str = "text", with_stats: bool | tuple[str, ...] = False) -> DataFrame:
    """docs with _qr_failed (the first in the order that rejects; null: kept) and, on request, all or the named statistics of every document; the others are computed in the CASE."""
    text = text_of(text_col)

    def verdict(s: dict[str, Column]) -> Column:
        found = F.lit(None).cast("string")
        for rule in reversed(ordered):
            found = F.when(rule.rejects(s), F.lit(rule.name)).otherwise(found)
        return found

    if not with_stats:  # one expression that splits the text once: a filter above it may be pushed down and repeat it, but not take it apart
        return docs.withColumn("_qr_failed", let(words_of(text), lambda w: verdict(stats(text, w))))
    rows = docs.withColumn("_qr_words", words_of(text))
    found = stats(text, F.col("_qr_words"))
    eager = [k for k in STATS if with_stats is True or k in with_stats]
    rows = rows.withColumns({f"_qr_{k}": found[k] for k in eager})
    return rows.withColumn("_qr_failed", verdict(found | {k: F.col(f"_qr_{k}") for k in eager})).drop("_qr_words")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = [rule for rule, _, _ in plan(docs)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = cascade(docs, ordered, with_stats=names)
    s = {k: F.col(f"_qr_{k}") for k in names}
    base = RULES[0].rejects(s) | RULES[1].rejects(s)
    return judged.select("doc_id", *(s[k].alias(k) for k in names), base.alias("base_failed"), F.col("_qr_failed").isNull().alias("kept"))


def keep(spark, docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    ordered = [rule for rule, _, _ in plan(docs)]
    return carrying(docs, "_qr_", lambda d: cascade(d, ordered).where(F.col("_qr_failed").isNull()).select(*map(named, d.columns)))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
      [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) > 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
s AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
      CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, len(list_distinct(ws)) AS n_distinct
      FROM w LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols * 100 > word_chars * 5 OR n_dup_lines * 100 > n_lines * 45
       OR n_upper * 100 > word_chars * 35 OR word_chars > n_words * 15 OR word_chars < n_words * 2 OR n_distinct * 20 < least(n_words, 400)) AS kept
FROM s
"""
