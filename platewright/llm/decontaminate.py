"""Benchmark decontamination with a generalised suffix automaton.

The items are normalised to words and inserted into one automaton. Training words stream through it
while it keeps the longest match that ends at each word; once that reaches ``window`` words, the last
``window`` of them are a window of some item, and the words are hit. An item of fewer words is one
window as a whole. ``scan`` reports hits and items per document; ``remove`` drops documents whose
share of hit words reaches ``coverage`` and cuts the hit spans out of the others.

Words: A-Z lower-cased, runs of 0-9, a-z and all characters from U+0080 up.

Scale: documents never shuffle. Items are dealt by hash into blocks of about ``block_bytes`` of text,
whose number follows from their measured size; each block is broadcast, and the documents pass through
one narrow step per block that adds its hits to those found before, so no broadcast and no automaton
grows with the number of items.

Edge cases: a null or empty text has no words and no hits and stays; items that are null or have no
words are ignored; with an empty benchmark nothing is hit; repeated items count by their distinct ids,
an item whose id is null still makes hits. Repeated documents are judged one by one. Other columns of
the documents are carried along; the work columns start with ``_dc_``, and ``remove`` carries columns of the input so named too.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm.common import carrying, table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """The substrings of all items, and for each window which items have it."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        words = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall(t.lower())]) for i, t in items if t]
        words = [(i, w) for i, w in words if w]
        for _, w in words:
            self._insert(w)
        self.shortest = min((min(len(w), window) for _, w in words), default=0)
        self.of_window: dict[int, set] = {}
        self.of_short: dict[int, list[tuple[int, str | None]]] = {}
        self.has_short = False
        for i, w in words:
            state = 0
            for at, word in enumerate(w):
                state = self.next[state][word]
                if at + 1 >= window:
                    self.of_window.setdefault(self._of_length(state, window), set()).add(i)
            if len(w) < window:
                self.has_short = True
                self.of_short.setdefault(self._of_length(state, len(w)), []).append((len(w), i))
        self.kept: dict[int, int] = {}

    def _insert(self, words: list[int]) -> None:
        last = 0
        for w in words:
            known = self.next[last].get(w)
            if known is not None and self.length[known] == self.length[last] + 1:
                last = known
            elif known is not None:
                last = self._clone(known, last, w)
            else:
                state = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = state
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(q, p, w)
                last = state

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _clone(self, q: int, p: int, w: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _of_length(self, state: int, n: int) -> int:
        """The state of the last n words of what leads to this state."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint half-open spans of hit words, in order, and the items that have a window here."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        if len(words) < self.shortest or not self.shortest:
            return spans, items
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        inside = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin >= self.shortest:
                self._run(ids[begin:end].tolist(), begin, spans, items)
        return spans, items

    def _run(self, ids: list[int], begin: int, spans: list, items: set) -> None:
        moves, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for at, word in enumerate(ids, begin):
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            if word in moves[state]:
                state = moves[state][word]
                matched += 1
            n = 0
            if matched >= window:
                items |= self.of_window[self._window_state(state)]
                n = window
            if self.has_short:
                p = state
                while p > 0:
                    for size, item in self.of_short.get(p, ()):
                        if size <= matched:
                            items.add(item)
                            n = max(n, size)
                    p = link[p]
            if n:
                first = at + 1 - n
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, at + 1))

    def _window_state(self, state: int) -> int:
        found = self.kept.get(state)
        if found is None:
            found = self.kept[state] = self._of_length(state, self.window)
        return found


_BUILT: dict = {}


def _automaton(block, key: str, window: int) -> Automaton:
    """One automaton per worker process and block."""
    if key not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.clear()
        _BUILT[key] = Automaton([(i, t) for i, t in block.value], window)
    return _BUILT[key]


def joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted([*a, *b]):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans of words, from the first character of the first word to the last of the last."""
    ends = [m.span() for m in WORD.finditer(text.lower())]
    kept, at = [], 0
    for begin, end in spans:
        kept.append(text[at : ends[begin][0]])
        at = ends[end - 1][1]
    return b"".join([*kept, text[at:]])


def _scanner(block, window: int, columns: list[str]):
    key = uuid.uuid4().hex

    def scan(batches):
        automaton = _automaton(block, key, window)
        for batch in batches:
            n_words, spans, items = [], [], []
            old_spans, old_items = batch.column("_dc_spans").to_pylist(), batch.column("_dc_items").to_pylist()
            for k, text in enumerate(batch.column("_dc_text")):
                words = WORD.findall((text.as_py() or b"").lower())
                found, ids = automaton.hits(words)
                before = old_spans[k] or []
                n_words.append(len(words))
                spans.append([x for s in joined(found, list(zip(before[::2], before[1::2], strict=True))) for x in s])
                items.append(sorted({i for i in ids if i is not None} | set(old_items[k] or ())))
            new = {"_dc_words": pa.array(n_words, pa.int64()), "_dc_spans": pa.array(spans, pa.list_(pa.int64())), "_dc_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in columns], columns)

    return scan


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 2_000_000, carry: bool = True) -> DataFrame:
    """docs, its text now bytes in _dc_text (if carry), with _dc_words, _dc_spans (flat list of span ends) and _dc_items (sorted ids as strings)."""
    spark = docs.sparkSession
    bench = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-size // block_bytes))
    block_of = F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks))
    rows = docs.select(
        *(F.col(f"`{c}`") for c in docs.columns if c != text_col),
        F.col(text_col).cast("binary").alias("_dc_text"),
        F.lit(0).cast("long").alias("_dc_words"),
        F.array().cast("array<long>").alias("_dc_spans"),
        F.array().cast("array<string>").alias("_dc_items"),
    )
    for k in range(n_blocks):
        block = spark.sparkContext.broadcast([(r["i"], bytes(r["t"]) if r["t"] is not None else None) for r in bench.where(block_of == k).collect()])
        out = rows if carry or k + 1 < n_blocks else rows.drop("_dc_text")
        rows = rows.mapInArrow(_scanner(block, window, out.columns), out.schema)
    return rows


N_HIT = "aggregate(_dc_spans, 0L, (a, x) -> x - a)"


def _judged(rows: DataFrame, coverage: tuple[int, int]) -> DataFrame:
    """Adds _dc_hit (ends less begins: an alternating sum, as the last end counts positive) and _dc_bad."""
    rows = rows.withColumn("_dc_hit", F.expr(N_HIT))
    return rows.withColumn("_dc_bad", (F.col("_dc_hit") > 0) & (F.col("_dc_hit") * coverage[1] >= F.col("_dc_words") * coverage[0]))


def _cutter(columns: list[str], text_col: str):
    def cut(batches):
        for batch in batches:
            texts = [without(t, list(zip(s[::2], s[1::2], strict=True))) if s else t for t, s in zip(batch.column("_dc_text").to_pylist(), batch.column("_dc_spans").to_pylist(), strict=True)]
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_col else batch.column(c) for c in columns], columns)

    return cut


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", coverage: tuple[int, int] = (1, 20), **how) -> DataFrame:
    """docs without those whose hit words are at least coverage of their words; hit spans are cut out of the others."""

    def kept(docs: DataFrame) -> DataFrame:
        rows = _judged(scan(docs, items, text_col, **how), coverage).where(~F.col("_dc_bad"))
        return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), "_dc_text", "_dc_spans").mapInArrow(_cutter(docs.columns, text_col), docs.schema)

    return carrying(docs, "_dc_", kept)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _judged(scan(docs, table(spark, sf_dir, "benchmark"), carry=False), (1, 20))
    return rows.select(
        "doc_id",
        F.col("_dc_words").alias("n_words"),
        F.col("_dc_hit").alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_dc_items", ","), 256).alias("items_sha256"),
        F.col("_dc_bad").alias("contaminated"),
    )


def keep(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove(docs, table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS k
       FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, lens WHERE len(ws) >= n)),
m AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw USING (n, k)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT rid, i, n FROM m)) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS joined FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""
