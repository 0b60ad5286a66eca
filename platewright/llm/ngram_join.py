"""Similarity self-join on word n-grams with a count-vector R-tree.

A document's set holds the hashes (64 bits) of its distinct n-word shingles. Two documents link when
100 * intersection >= percent * union. Every link between different sets is found, exactly:

1. Documents with one set form a class; a class takes part once, under its smallest id.
2. Sets that link share a shingle among the first n - ceil(percent * n / 100) + 1 of each, in any order
   common to all sets. The order puts frequent shingles last, by a counting sketch over all documents,
   so a passage that many documents share doesn't bring them together. Classes with such a shingle in
   common form a block; blocks with the same members are one.
3. In a block, shingles are hashed into groups and each class is the point of its group counts. An
   R-tree over the points is searched breadth first: the sum of coordinate minima bounds the overlap, a
   subtree whose largest coordinates give too little is skipped, and a point once reached leaves the tree.
   The result is a spanning forest of what the bound allows, at most one edge per member.
4. Forests of all blocks join into candidate groups. Each holds every link of its members; the same search, now
   with exact set sizes after the bound, gives a spanning forest of the links, and its components.

Scale: rows of shingles never shuffle, only prefixes (about 15 of 100 shingles) and the texts of classes
in candidate groups. A block or group beyond a size, in rows and in bytes of its points or shingles, is dealt into
chunks, and each pair of chunks is a task of bounded memory, whatever the length of the documents. The sketch has a fixed size.

Edge cases: a null text or one without words has the empty set and links with nothing; a text of fewer
words than n is one shingle. Rows that repeat an id are one node. Rows whose id is null link with nothing. Empty
table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.llm.common import named, table, written
from platewright.llm.components import components

#: (largest set, groups): about 16 of a set's shingles in a group, so that the groups of unlike sets differ enough for the bound.
CLASSES = ((1 << 10, 1 << 6), (1 << 13, 1 << 9), (1 << 16, 1 << 12), (1 << 62, 1 << 14))
SLOTS = 1 << 20
CHUNKS = 64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the n-word shingles; words are split at ASCII white space, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    last = len(h) - n + 1
    s = h[:last] * ODD[0]
    for k in range(1, n):
        s += h[k : k + last] * ODD[k]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def groups_of(n: int) -> int:
    return next(g for most, g in CLASSES if n <= most)


def counts_of(s: np.ndarray) -> np.ndarray:
    """How many shingles are in each group: as many groups as the set's class has, by the first bits of the hash, so that finer groups add up to coarser ones."""
    groups = groups_of(len(s))
    return np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype(np.uint32)


def needed(a, b, percent: int):
    """The least intersection of linked sets of these sizes: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class Tree:
    """R-tree over count vectors: nodes are split at the median of the widest coordinate and hold their largest coordinates."""

    LEAF = 48

    def __init__(self, points: np.ndarray):
        self.points, self.sizes = points, points.sum(1, dtype=np.int64)
        self.order = np.arange(len(points))
        self.nodes: list[list] = []  # begin, end, left, right, largest coordinates, least size
        self.alive = np.ones(len(points), bool)
        if len(points):
            self._build(0, len(points))

    def _build(self, begin: int, end: int) -> int:
        me, mine = len(self.nodes), self.order[begin:end]
        most, least = self.points[mine[0]].copy(), self.points[mine[0]].copy()
        for at in range(0, end - begin, 256):  # no copy of all points
            rows = self.points[mine[at : at + 256]]
            np.maximum(most, rows.max(0), out=most)
            np.minimum(least, rows.min(0), out=least)
        self.nodes.append([begin, end, -1, -1, most, int(self.sizes[mine].min())])
        if end - begin > self.LEAF:
            half = (end - begin) // 2
            self.order[begin:end] = mine[np.argpartition(self.points[mine, int((most - least).argmax())], half)]
            self.nodes[me][2] = self._build(begin, begin + half)
            self.nodes[me][3] = self._build(begin + half, end)
        return me

    def near(self, q: int, percent: int) -> np.ndarray:
        """Members still in the tree whose overlap with q the bound allows to be enough."""
        point, size, found, stack = self.points[q], int(self.sizes[q]), [], [0]
        while stack:
            begin, end, left, right, most, least = self.nodes[stack.pop()]
            if int(np.minimum(point, most).sum(dtype=np.int64)) < needed(size, least, percent):
                continue
            if left >= 0:
                stack += (left, right)
                continue
            rows = self.order[begin:end]
            rows = rows[self.alive[rows]]
            if len(rows):
                found.append(rows[np.minimum(self.points[rows], point).sum(1, dtype=np.int64) >= needed(size, self.sizes[rows], percent)])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def forest(points: list[np.ndarray], percent: int, verify=None) -> list[tuple[int, int]]:
    """Edges that connect all pairs which the bound allows and, if given, verify(q, rows) confirms: a forest for each class.

    A class is searched with those of larger classes that its largest sets could link with, their groups added up to its own.
    """
    sizes, out = np.array([int(p.sum()) for p in points], np.int64), []
    for most, groups in CLASSES:
        rows = [k for k, p in enumerate(points) if len(p) == groups]
        if rows:
            rows += [k for k, p in enumerate(points) if len(p) > groups and sizes[k] * percent <= 100 * most]
            folded = np.empty((len(rows), groups), np.uint32)
            for at, k in enumerate(rows):
                folded[at] = points[k].reshape(groups, -1).sum(1)
            at = np.array(rows)
            found = _forest(folded, percent, verify and (lambda q, r, at=at: verify(int(at[q]), at[r])))
            out += [(rows[a], rows[b]) for a, b in found]
    return out


def _forest(points: np.ndarray, percent: int, verify) -> list[tuple[int, int]]:
    tree, edges = Tree(points), []
    for start in range(len(points)):
        if not tree.alive[start]:
            continue
        tree.alive[start] = False
        todo = [start]
        while todo:
            q = todo.pop()
            rows = tree.near(q, percent)
            if verify is not None and len(rows):
                rows = rows[verify(q, rows)]
            tree.alive[rows] = False
            edges += [(q, int(r)) for r in rows]
            todo += rows.tolist()
    return edges


class Sets:
    """Sets in one flat array of dense numbers, for many exact intersections at once."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mask, self.percent = np.zeros(int(self.flat.max(initial=0)) + 1, bool), percent

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] - self.sizes[k] : self.ends[k]]

    def links(self, q: int, rows: np.ndarray) -> np.ndarray:
        mine = self.of(q)
        self.mask[mine] = True
        out = np.empty(len(rows), bool)
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            flat = np.concatenate([self.of(r) for r in part])
            begins = np.concatenate(([0], np.cumsum(self.sizes[part])[:-1]))
            shared = np.add.reduceat(self.mask[flat].astype(np.int64), begins)
            out[at : at + 4096] = 100 * shared >= self.percent * (self.sizes[part] + len(mine) - shared)
        self.mask[mine] = False
        return out


def _sketch(n: int):
    def count(batches):
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for at in range(0, len(batch), 200):
                sets = [shingles(t, n) for t in batch.column("text").slice(at, 200).to_pylist()]
                total += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        parts = total.reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "counts"])

    return count


def _summed(batches):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(data, np.uint32).astype(np.uint64)
            totals[chunk] = totals[chunk] + part if chunk in totals else part
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["chunk", "counts"])


def frequency_levels(rows: DataFrame, n: int) -> np.ndarray:
    """For each sketch slot how far, in powers of two, its count is above what chance gives the slots."""
    counted = rows.select("text").mapInArrow(_sketch(n), "chunk int, counts binary").repartition(CHUNKS, "chunk").mapInArrow(_summed, "chunk int, counts binary")
    total = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint64)
    for r in counted.collect():  # SLOTS numbers
        total[r["chunk"]] = np.frombuffer(r["counts"], np.uint64)
    total = total.reshape(-1).astype(float)
    mean = float(np.median(total))
    return np.floor(np.log2(np.maximum(1, (total - mean) / (8 + 4 * mean**0.5)))).astype(np.uint8)


def prefix(s: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    n = len(s) - -(-percent * len(s) // 100) + 1
    own = level[(s & np.uint64(len(level) - 1)).astype(np.int64)]
    return (s if not own.any() else s[np.lexsort((s, own))])[:n]


def _described(block, n: int, percent: int):
    def describe(batches):
        level = block.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t, n) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([counts_of(s).tobytes() for s in sets], pa.binary()),
                        pa.array([prefix(s, level, percent).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "n", "digest", "counts", "prefix"],
                )

    return describe


def _groups(batches, keys: list[str], values: list[str]):
    """(rows of one key) from batches sorted by key."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in [*keys, *values]), strict=True))
    for _, group in itertools.groupby(rows, key=lambda r: r[: len(keys)]):
        yield [r[len(keys) :] for r in group]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _candidates(percent: int):
    def search(batches):
        out: list[tuple[int, int]] = []
        for group in _groups(batches, ["block", "i", "j"], ["id", "counts"]):
            points = [np.frombuffer(c, np.uint32) for _, c in group]
            group = [(i,) for i, _ in group]
            out += [(group[a][0], group[b][0]) for a, b in forest(points, percent)]
            if len(out) > 20_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return search


def _links(n: int, percent: int):
    def search(batches):
        out: list[tuple[int, int]] = []
        for group in _groups(batches, ["block", "i", "j"], ["id", "text"]):
            sets = [shingles(t, n) for _, t in group]
            points = [counts_of(s) for s in sets]
            out += [(group[a][0], group[b][0]) for a, b in forest(points, percent, Sets(sets, percent).links)]
            if len(out) > 20_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return search


def chunk_pairs(rows: DataFrame, chunks: Column) -> DataFrame:
    """rows with i and j: each pair of the block's chunks (pairs of a chunk with itself if it is the only one) gets the rows of both."""
    mine = F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")
    rows = rows.withColumn("_k", F.greatest(F.lit(1), chunks.cast("int"))).withColumn("_c", mine)
    other = F.when(F.col("_k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda x: x != F.col("_c")))
    rows = rows.withColumn("_o", F.explode(other))
    return rows.withColumns({"i": F.least("_c", "_o"), "j": F.greatest("_c", "_o")}).drop("_k", "_c", "_o")


def bounded(size: Column, most: int) -> Column:
    """In how many chunks a block of that size is dealt, so that two of them hold about ``most``."""
    return F.ceil(2 * size / most)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, block_rows: int = 8192, block_bytes: int = 16 << 20, group_shingles: int = 2_000_000, broadcast_ids: int = 1_000_000) -> DataFrame:
    """id, n_shingles, component_id for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("binary").alias("text"))
    level = spark.sparkContext.broadcast(frequency_levels(rows, n))
    described = written(rows.mapInArrow(_described(level, n, percent), "id long, n long, digest binary, counts binary, prefix array<long>"), "shingled")
    known = described.where("n > 0 AND id IS NOT NULL")
    classes = written(known.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    first = written(known.join(classes, (known["digest"] == classes["digest"]) & (F.col("id") == F.col("rep"))).select("id", "n", "counts", "prefix"), "firsts")

    # what a prefix's documents are together is summed map-side; then its rows meet that sum in a join, whose hot keys Spark splits
    keyed = first.select("id", F.octet_length("counts").alias("w"), F.explode("prefix").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.sum("w").alias("bytes"), F.bit_xor(F.xxhash64("id")).alias("block")).where("size > 1")
    blocks = keyed.join(sizes, "key").select("block", "size", "bytes", "id").distinct()
    blocks = chunk_pairs(blocks, F.greatest(bounded(F.col("size"), block_rows), bounded(F.col("bytes"), block_bytes))).drop("size", "bytes")
    points = first.select("id", "counts").distinct()
    found = _dealt(blocks.join(points, "id")).select("block", "i", "j", "id", "counts").mapInArrow(_candidates(percent), "a long, b long")
    group = written(components(found), "groups")

    sized = group.join(first.groupBy("id").agg(F.max("n").alias("n")), group["node"] == F.col("id")).select("id", F.col("component").alias("block"), "n")
    total = sized.groupBy("block").agg(F.sum("n").alias("total"))
    members = written(sized.join(total, "block").select("id", "block", "total"), "members")
    few = members.count() <= broadcast_ids  # 24 bytes each
    texts = rows.join(F.broadcast(members) if few else members, "id")
    dealt = _dealt(chunk_pairs(texts, bounded(F.col("total"), group_shingles))).select("block", "i", "j", "id", "text")
    linked = components(dealt.mapInArrow(_links(n, percent), "a long, b long"))

    of_class = classes.join(linked, classes["rep"] == linked["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    slim = described.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    out = slim.join(of_class, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def keep(spark, docs: DataFrame, broadcast_ids: int = 1_000_000, **how) -> DataFrame:
    """One document of each component: that with the smallest id (of rows that repeat it, that with the smallest text, a null text first). Rows with a null id stay.

    Only the ids that go and those of several rows meet the documents, whose texts don't shuffle while these are few.
    """
    linked = written(link_components(docs, broadcast_ids=broadcast_ids, **how).where("doc_id IS NOT NULL"), "linked")
    ids = linked.groupBy(F.col("doc_id").alias("_nj_id")).agg(F.max(F.expr("doc_id = component_id")).alias("stays"), F.count("*").alias("n"))
    marked = written(ids.where("NOT stays OR n > 1").select("_nj_id", "stays"), "marked")
    few = marked.count() <= broadcast_ids  # 9 bytes each
    met = lambda some, kind: docs.join(F.broadcast(some) if few else some, docs["doc_id"] == some["_nj_id"], kind)
    others = [named(c) for c in docs.columns if c != "text"]
    one = met(marked.where("stays").select("_nj_id"), "left_semi").select(F.struct(named("text"), *others).alias("_nj_row"), named("doc_id").alias("_nj_id"))
    one = one.groupBy("_nj_id").agg(F.min("_nj_row").alias("r")).select(*(F.col("r")[c].alias(c) for c in docs.columns))
    return met(marked.select("_nj_id"), "left_anti").unionByName(one)


SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (WITH RECURSIVE w(a, b) AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a) SELECT a, min(b) AS low FROM w GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id
"""
