"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Of all lines in all documents, one is kept of each group of exact or near copies: the one with the smallest
(document id, line number). Lines of every length take part; of those under ``PLAIN`` characters the blank and
wordless ones (no letter or digit) are always kept, and ``least`` can keep all shorter ones.

Candidates: shingles longer than ``short`` (those after blanks, or all of a line with few of these) are hashed, and the hashes dealt to 16
parts by their highest bits; the three or four smallest from the start of each part are a band key (one-permutation MinHash). Lines of up to 38
different shingles of ``short`` characters have 8 parts of these and of up to 18 have 4: more than the shingles that near copies of that size
differ in, so one part is equal. Longer near copies miss all keys rarely (a test measures the recall); other lines rarely share even one key.
In a band each line is paired with the one before it and the first; where that leaves several components, with every line of another
component. The join compares sizes and bit maps, so that only pairs that these can't rule out become rows.

Verification: pairs whose sizes or bit maps prove that they differ in too many shingles go first, without their texts;
then exact Jaccard of the sets of all ``short``-character shingles, at least ``percent``/100. Pairs that pass are joined by connected components, and each component keeps one line.

Scale: exact copies are one node by 128 bits of hash of the line, and meet map-side, so a frequent line is one row per task.
Each different line shuffles once, then keys, ids and the texts of candidate lines, and at last each text once to meet its dropped
line numbers. The lines of a hot component meet the line that is kept salted. A hot band key costs a sort, and comparisons of bit maps that still grow with
the square of its lines; rows don't, but for families of lines whose similarity is just under ``percent``, which their maps can't tell.

Edge cases: null and empty texts have no lines and stay as they are. Rows with a null id stay as they are and take no
part. Rows that repeat an id are one document: the line kept is kept in all of them. Ends of lines are trimmed of blanks for comparison only. Columns
other than id and text are carried along, whatever their names; ``keep`` also carries columns
that start like the work columns, ``_ld_``, which ``dedup`` leaves out or replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.llm.common import SPACE, carrying, discard, let, named, table, written
from platewright.llm.components import components

PLAIN = 40
#: Of 64 bits, in the bit map of a line's shingles; a power of two.
WORDS = 16


def long_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """_ld_id, pos, line (trimmed) and its hashes h and g (128 bits together) of every line that takes part."""
    rows = docs.where(named(id_col).isNotNull()).select(named(id_col).alias("_ld_id"), F.posexplode_outer(F.split(named(text_col), "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where((F.length("line") >= least) & ((F.length("line") >= PLAIN) | F.col("line").rlike(r"[\p{L}\p{N}]")))
    return rows.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def shingles(line: str, short: int) -> Column:
    """The hashes of all shingles of a line, one for each place: cut from its UTF-32 form, whose characters all have four bytes, so that no place is searched for.

    The type of the empty array is one without nulls, by which Spark sorts and compares the hashes as plain longs.
    """

    def cut(b: Column) -> Column:
        places = F.sequence(F.lit(1), F.octet_length(b) - (4 * short - 1), F.lit(4))
        return F.when(F.octet_length(b) >= 4 * short, F.transform(places, lambda k: F.xxhash64(F.substring(b, k, F.lit(4 * short))))).otherwise(F.array_repeat(F.lit(0).cast("long"), F.lit(0)))

    return let(F.encode(F.col(line), "UTF-32"), cut)


def word_starts(line: str, wide: int) -> Column:
    """The hashes of the shingles of ``wide`` characters that follow a blank, one for each place."""
    return F.transform(F.regexp_extract_all(line, F.lit(f"(?s) (?=(.{{{wide}}}))"), F.lit(1)), lambda x: F.xxhash64(x))


def band_sets(lines: DataFrame, short: int) -> DataFrame:
    """h, bits, s: the sets of hashes that each line of at least ``short`` characters has band keys of, and how many bits name a part of them.

    Like lines have a set of one kind in common: kinds go by numbers of different shingles, and those near a limit have both kinds.
    """
    rows = lines.where(F.length("line") >= short).select("h", "line", F.array_distinct(word_starts("line", 2 * short)).alias("w"))
    # outer: for a plain explode the optimizer adds a filter below it that computes the sets again; and what stands in an explode
    # isn't compiled, so the repeated hashes go in a step of their own
    few = (F.size("w") < 48) | (F.length("line") > 16 * F.size("w"))
    rows = rows.select("h", "line", "w", F.explode_outer(F.array(F.when(few, shingles("line", short + 3)))).alias("m"))
    rows = rows.withColumn("m", F.array_distinct("m"))
    # a line of n different shingles has n - 3 different ones that are 3 longer, at least
    rows = rows.select("h", "w", "m", F.explode_outer(F.array(F.when(F.size("m") <= 64, shingles("line", short)))).alias("s"))
    rows = rows.withColumn("s", F.array_distinct("s"))
    n = F.size("s")
    kind = lambda where, bits, s: F.when(where, F.struct(F.lit(bits).alias("bits"), F.col(s).alias("s")))
    kinds = F.array(kind(F.size("w") >= 32, 4, "w"), kind(F.size("m") >= 29, 4, "m"), kind((n >= 16) & (n <= 38), 3, "s"), kind((n > 0) & (n <= 18), 2, "s"))
    return rows.select("h", F.explode_outer(F.filter(kinds, lambda x: x.isNotNull())).alias("k")).select("h", "k.bits", "k.s")


def band_keys(lines: DataFrame, short: int, rows: int, least: int = 3, most: int = 4) -> DataFrame:
    """key, h: the band keys of every line of at least ``short`` characters.

    Sets in 16 parts have keys of the ``most`` smallest hashes of a part, or of ``least``, the next parts' among them, where it has fewer:
    a single frequent shingle is no key. The small sets have keys of up to ``rows`` hashes, of one part only, as it is their size that finds like ones.
    The sorted hashes become rows, and the first of each part looks up those that follow it: generated code
    throughout, without a lambda or a slice for each key.
    """
    s, at, bits, n = F.col("s"), F.col("at"), F.col("bits"), F.size("s")
    hash_at = lambda k: F.get(s, k)
    # the highest bits, by which the sorted hashes stand part by part
    part = lambda x: F.when(bits == 4, F.shiftright(x, 60)).when(bits == 3, F.shiftright(x, 61)).otherwise(F.shiftright(x, 62))
    keyed = band_sets(lines, short).select("h", "bits", F.sort_array("s").alias("s"))
    keyed = keyed.select("h", "bits", "s", F.posexplode_outer("s").alias("at", "x")).where((at == 0) | (part(hash_at(at - 1)) != part(F.col("x"))))
    own = lambda k: F.when(part(hash_at(at + k)) == part(F.col("x")), hash_at(at + k))  # noqa: E731  null, which adds nothing to a hash, past the part
    least_of = lambda k: hash_at(F.when(at + k < n, at + k).otherwise(F.pmod(at + k, n)))
    taken = [F.when(bits == 4, least_of(k) if k < least else own(k) if k < most else F.lit(None)).otherwise(own(k) if k < rows else F.lit(None)) for k in range(1, max(most, rows))]
    return keyed.select(F.xxhash64("bits", "x", *taken).alias("key"), "h")


def sketched(lines: DataFrame, short: int) -> DataFrame:
    """h; n, the number of its line's different shingles; b0, b1, ...: a map of ``64 * WORDS`` bits, those set that the lowest bits of an odd number of their hashes name.

    Where two sets agree cancels out, so unlike a map of all bits that occur this one fills with what they differ in only (an odd sketch).
    """
    # outer: for a plain explode the optimizer adds a filter below it that computes the sets again; in an explode itself they wouldn't be compiled
    rows = lines.select("h", F.array_distinct(shingles("line", short)).alias("s")).select("h", F.explode_outer("s").alias("s"))
    word, bit = F.shiftright("s", 6).bitwiseAND(F.lit(WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    maps = [F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(WORDS)]
    return rows.groupBy("h").agg(F.count("s").alias("n"), *maps)


def may_be_alike(a: str, b: str, percent: int) -> Column:
    """False only for sets that can't have that Jaccard similarity: they differ in at least as many shingles as their bit maps and sizes do."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(WORDS)), F.lit(0))
    return F.greatest(F.abs(n - m), bits) * (100 + percent) <= (n + m) * (100 - percent)


def alike_pairs(pairs: DataFrame, a: str, b: str, short: int, percent: int) -> DataFrame:
    """The pairs whose sets of shingles, each shingle as its 64-bit hash, have at least that Jaccard similarity; empty sets are unlike. n and m: the sizes of the sets.

    The condition's result passes an outer explode, below which a filter isn't pushed: it would compute the sets again. It is computed before, as an explode's own expressions aren't compiled.
    """
    shared = F.size(F.array_intersect(shingles(a, short), shingles(b, short))) * (100 + percent) >= F.greatest(F.lit(1), F.col("n") + F.col("m")) * percent
    kept = [c for c in pairs.columns if c not in (a, b, "n", "m")]
    return pairs.select(*kept, shared.alias("_ld_ok")).select(*kept, F.explode_outer(F.array("_ld_ok")).alias("_ld_ok")).where("_ld_ok").drop("_ld_ok")


def banded(lines: DataFrame, short: int = 5, rows: int = 7) -> DataFrame:
    """key, h, before, first: the lines of every band with different lines, once each, the one before it and the first. lines: h, line."""
    keyed = band_keys(lines, short, rows)
    band = Window.partitionBy("key")
    # most keys are of one line: they go before the lines of a band are sorted
    shared = keyed.select("key", "h", F.min("h").over(band).alias("first"), F.max("h").over(band).alias("last")).where("first < last")
    near = shared.select("key", "h", F.lag("h").over(band.orderBy("h")).alias("before"), "first")
    # copies of one line stand side by side; the first of them sees the line before them
    return near.where("before IS NULL OR before < h")


def crossing(bands: DataFrame, alike: DataFrame, crowd: int = 0) -> DataFrame:
    """key, h, c, crowded: the lines of every band of several components, each with its own, and whether the band has more than ``crowd`` lines. bands: key, h. alike: node, component."""
    rows = bands.join(alike, bands["h"] == alike["node"], "left").select("key", "h", F.coalesce("component", "h").alias("c"))
    band = Window.partitionBy("key")
    rows = rows.select("key", "h", "c", (F.count("*").over(band) > crowd).alias("crowded"), (F.min("c").over(band) < F.max("c").over(band)).alias("several"))
    return rows.where("several").drop("several")


def crossing_pairs(bands: DataFrame, alike: DataFrame, texts: DataFrame, short: int, percent: int, crowd: int = 0, sketches: DataFrame | None = None) -> DataFrame:
    """a, b, n, m: all lines that share a band, but no component, and the numbers of their shingles; each pair once. bands: key, h. alike: node, component. texts: h, line.

    Of a band of more than ``crowd`` lines, those that their sizes and bit maps don't prove unlike: the lines carry both into the join by
    bands, and its condition compares them, so that only such pairs become rows. That is exact, no pair that can be similar is left out.
    """
    rows = written(crossing(bands, alike, crowd), "line-bands")
    # a pair is given in the first of the bands that it shares
    lines = rows.groupBy("h").agg(F.sort_array(F.collect_list("key")).alias("keys")).join(sketches or sketched(texts, short), "h")
    rows = rows.join(lines, "h")
    first = F.get(F.array_intersect("x.keys", "y.keys"), F.lit(0)) == F.col("x.key")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")) & (~F.col("x.crowded") | may_be_alike("x", "y", percent)) & first
    return rows.alias("x").join(rows.alias("y"), met).select(F.col("x.h").alias("a"), F.col("y.h").alias("b"), F.col("x.n"), F.col("y.n").alias("m"))


def similar_lines(lines: DataFrame, short: int = 5, percent: int = 80, broadcast_ids: int = 500_000, crowd: int = 0, **how) -> DataFrame:
    """h, g, component: lines that are near copies of others; component is the smallest h of theirs.

    Should two lines have one h, only the first by g takes part: no line is then taken for another.
    """
    lines = written(lines.groupBy("h").agg(F.min(F.struct("g", "line")).alias("t")).select("h", "t.g", "t.line"), "line-texts")
    bands = written(banded(lines, short, **how), "line-bands")
    ids = written(bands.select("h").distinct(), "line-ids")
    few = ids.count() <= broadcast_ids  # 8 bytes each
    texts = written(lines.join(F.broadcast(ids) if few else ids, "h", "left_semi"), "line-texts")
    sketches = written(sketched(texts, short), "line-sketches")
    discard(lines)

    def possible(pairs: DataFrame) -> DataFrame:
        size = lambda c, to: sketches.select(F.col("h").alias(c), F.struct(*(x for x in sketches.columns if x != "h")).alias(to))
        return pairs.join(size("a", "x"), "a").join(size("b", "y"), "b").where(may_be_alike("x", "y", percent)).select("a", "b", F.col("x.n"), F.col("y.n").alias("m"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
        return written(alike_pairs(both, "x", "y", short, percent), "line-links")

    # first each line with the one before it and the first, which joins most copies; then all that are not joined
    near = bands.where("before < h").select("h", F.explode_outer(F.array_distinct(F.array("before", "first"))).alias("other"))
    near = near.select(F.col("other").alias("a"), F.col("h").alias("b")).distinct()
    links = verified(possible(near))
    rest = written(crossing_pairs(bands.select("key", "h"), components(links), texts, short, percent, crowd, sketches), "line-pairs")
    alike = components(links.unionByName(verified(rest)))
    return texts.join(alike, texts["h"] == alike["node"]).select("h", "g", "component")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, broadcast_ids: int = 500_000, salts: int = 16, **how) -> DataFrame:
    """_ld_id, pos of every line that is a copy of one that is kept."""
    lines = long_lines(docs, id_col, text_col, least)
    slim = written(lines.select("_ld_id", "pos", "h", "g"), "lines")
    alike = similar_lines(lines.select("h", "g", "line"), broadcast_ids=broadcast_ids, **how)
    counts = slim.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("_ld_id", "pos")).alias("own"))
    copies = counts.join(alike, ["h", "g"], "left").where("n > 1 OR component IS NOT NULL").select("h", "g", "component", "own")
    copies = written(copies.withColumn("salt", F.pmod(F.xxhash64("g"), F.lit(salts))), "line-groups")
    # the line kept of a component, found map-side and met by its lines salted, as one component may hold a large part of them
    kept = copies.where("component IS NOT NULL").groupBy("component").agg(F.min("own").alias("kept"))
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    copies = copies.join(kept, ["component", "salt"], "left").select("h", "g", F.coalesce("kept", "own").alias("kept"))
    copies = written(copies, "line-kept")
    few = copies.count() <= broadcast_ids  # 40 bytes each
    rows = slim.join(F.broadcast(copies) if few else copies, ["h", "g"])
    return rows.where(F.struct("_ld_id", "pos") != F.col("kept")).select("_ld_id", "pos").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the text without dropped lines, and _ld_lines and _ld_dropped (how many lines there were and how many of them went)."""
    docs = docs.drop("_ld_id", "_ld_gone", "_ld_lines", "_ld_dropped")
    gone = dropped_lines(docs, id_col, text_col, **how).groupBy("_ld_id").agg(F.collect_set("pos").alias("_ld_gone"))
    rows = docs.join(gone.hint("shuffle_hash"), named(id_col) == F.col("_ld_id"), "left")
    lines = F.split(named(text_col), "\n")
    rest = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_ld_gone")), lambda k: F.get(x, k)), "\n"))
    text = F.when(F.col("_ld_gone").isNull(), named(text_col)).otherwise(rest)
    counts = [F.when(named(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("_ld_lines"), F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("_ld_dropped")]
    return rows.select(*((text.alias(c) if c == text_col else named(c)) for c in docs.columns), *counts)


def query(spark, sf_dir: str) -> DataFrame:
    rows = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), "text")


def keep(spark, docs: DataFrame) -> DataFrame:
    """docs without repeated lines; a document that lost lines and has no word left goes."""

    def kept(docs: DataFrame) -> DataFrame:
        rows = dedup(docs)
        return rows.where((F.col("_ld_dropped") == 0) | named("text").rlike(f"[^{SPACE[1:-1]}]")).select(*map(named, docs.columns))

    return carrying(docs, "_ld_", kept)
