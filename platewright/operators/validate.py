"""Plate validation and correction as array expressions, evaluated once per row in the JVM.

``validate`` gives the formatted plate or null. Each text of six to eight characters becomes up to five
candidates of seven; the first candidate that either format accepts after replacing characters wins, and
in it the format with the better product of weights, the newer one on ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import SPARK
from platewright.functions.tables import HINT_FACTOR, KINDS, MERCOSUL, MERCOSUL_BIAS, NEED, OLD


def _at(text: Column, i: int) -> Column:
    return F.substring(text, i + 1, 1)


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _maps(need: str) -> tuple[Column, Column]:
    pairs = NEED[need].items()
    chars = F.create_map(*(F.lit(x) for c, (r, _) in pairs for x in (c, r)))
    weights = F.create_map(*(F.lit(x) for c, (_, w) in pairs for x in (c, w)))
    return chars, weights


def needs(kind: str) -> str:
    """What each place needs: a letter, a digit, or in the newer format's fifth place a consonant."""
    return KINDS[kind][:4] + "C" + KINDS[kind][5:] if kind == "mercosul" else KINDS[kind]


def prefix_plausibility(text: Column) -> Column:
    from platewright.functions.tables import VALIDATOR_RANGES, merged

    head = F.substring(text, 1, 3)
    known = reduce(lambda a, b: a | b, (head.between(a, b) for a, b in merged(VALIDATOR_RANGES)))
    return F.when(F.length(text) < 3, 0.5).when(known, 1.0).otherwise(0.7)


def corrected(text: Column, kind: str) -> Column:
    """struct(text, score) of seven characters put right for the format; text is null where that can't be."""
    maps = {n: _maps(n) for n in set(needs(kind))}
    chars = [F.try_element_at(maps[n][0], _at(text, i)) for i, n in enumerate(needs(kind))]
    weights = [F.try_element_at(maps[n][1], _at(text, i)) for i, n in enumerate(needs(kind))]
    return F.struct(F.concat(*chars).alias("text"), reduce(lambda a, b: a * b, weights).alias("score"))


def candidate_score(text: Column) -> Column:
    """How plausible seven characters are as a plate, before any replacement."""
    kinds = [sum((F.when(_at(text, i).rlike("[A-Z]" if t == "L" else "[0-9]"), 1).otherwise(0) for i, t in enumerate(kind)), F.lit(0)) for kind in KINDS.values()]
    vowel = _at(text, 4).isin(*"AEIOU")
    exact = F.when(text.rlike(OLD), 1.0).when(text.rlike(MERCOSUL), F.when(vowel, 0.8).otherwise(1.0))
    return F.coalesce(exact, F.greatest(*kinds) / 7.0 * 0.7) * 0.8 + prefix_plausibility(text) * 0.2


def inserted(text: Column, place: int, need: str) -> Column:
    """Six characters with the missing one put in at the place; null if none is plausible."""
    fits = "[A-Z]" if need == "L" else "[0-9]"
    before, after = (_at(text, place - 1) if place else F.lit("")), _at(text, place)
    char = F.when(before.rlike(fits), before).when(after.rlike(fits), after).otherwise(F.lit("A") if need == "L" else F.lit(None))
    return F.concat(F.substring(text, 1, place), char, F.substring(text, place + 1, 6))


def normalize_to_7(text: Column) -> Column:
    """Up to five candidates, best first; the text itself if it has seven characters."""
    dropped = [F.concat(F.substring(text, 1, i), F.substring(text, i + 2, 8)) for i in range(8)]
    added = [inserted(text, i, kind[i]) for kind in KINDS.values() for i in range(7)]

    def best(options: list[Column]) -> Column:
        scored = F.transform(F.array(*options), lambda c, n: F.struct((-candidate_score(c)).alias("s"), n.alias("n"), c.alias("c")))
        kept = F.filter(scored, lambda x: x["c"].isNotNull())
        return F.slice(F.array_distinct(F.transform(F.array_sort(kept), lambda x: x["c"])), 1, 5)

    none = F.array().cast("array<string>")
    return F.when(F.length(text) == 7, F.array(text)).when(F.length(text) == 8, best(dropped)).when(F.length(text) == 6, best(added)).otherwise(none)


def best_correction(text: Column, hint: str | None = None) -> Column:
    """The formatted plate from a compact text of six to eight characters, or null."""

    def choose(c: Column) -> Column:
        def pick(old: Column, new: Column) -> Column:
            a = old["score"] * (HINT_FACTOR if hint == "old" else 1.0) * (0.7 + 0.3 * prefix_plausibility(old["text"]))
            b = new["score"] * MERCOSUL_BIAS * (HINT_FACTOR if hint == "mercosul" else 1.0) * (0.7 + 0.3 * prefix_plausibility(new["text"]))
            hyphen = F.concat(F.substring(old["text"], 1, 3), F.lit("-"), F.substring(old["text"], 4, 4))
            return F.when(new["text"].isNotNull() & (old["text"].isNull() | (b >= a)), new["text"]).otherwise(hyphen)

        return let(F.struct(corrected(c, "old").alias("o"), corrected(c, "mercosul").alias("m")), lambda x: pick(x["o"], x["m"]))

    return F.get(F.filter(F.transform(normalize_to_7(text), choose), lambda p: p.isNotNull()), 0)


def validate(text: Column, hint: str | None = None) -> Column:
    """text: compact, as ``compact`` gives it."""
    vowel = F.substring(text, 5, 1).isin(*"AEIOU")
    new, old = text.rlike(MERCOSUL) & ~vowel, text.rlike(OLD)
    hyphen = F.concat(F.substring(text, 1, 3), F.lit("-"), F.substring(text, 4, 4))
    exact = F.when(new, text).when(old, hyphen)
    if hint is None:
        return F.when(new, text).when(old, hyphen).otherwise(best_correction(text))
    right = old if hint == "old" else new
    return F.when(right, exact).otherwise(F.coalesce(best_correction(text, hint), exact))


def with_validation(reads: DataFrame, text: str = "plate_text", hint: str | None = None) -> DataFrame:
    """reads with compact, suggested, and the fields of a full report; suggested and validity follow their own rules and may differ."""
    c = F.col("compact")
    rows = reads.withColumn("cleaned", F.expr(k.clean_text(SPARK, text))).withColumn("compact", F.replace("cleaned", F.lit("-"), F.lit("")))
    rows = rows.withColumn("suggested", validate(c, hint))
    corrects = F.when(~c.rlike(MERCOSUL) & ~c.rlike(OLD), F.col("suggested") if hint is None else best_correction(c, hint))
    rows = rows.withColumn("_correction", corrects)
    vowel = c.rlike(MERCOSUL) & F.substring(c, 5, 1).isin(*"AEIOU")
    hyphen = F.concat(F.substring(c, 1, 3), F.lit("-"), F.substring(c, 4, 4))
    is_valid = (c.rlike(MERCOSUL) & ~vowel) | c.rlike(OLD) | F.col("_correction").isNotNull()
    kind = F.when(c.rlike(MERCOSUL), "mercosul").when(c.rlike(OLD), "old").when(F.col("_correction").contains("-"), "old").when(F.col("_correction").isNotNull(), "mercosul").otherwise("unknown")
    plain = F.replace(F.coalesce("suggested", F.lit("")), F.lit("-"), F.lit(""))
    changed = F.col("suggested").isNotNull() & (plain != c)
    given = F.coalesce(F.col(text), F.lit("")) != ""
    issues = F.array(
        F.when(~given, F.lit("empty_plate")),
        F.when(vowel, F.lit("vowel_in_fifth_place")),
        F.when(given & ~is_valid & ~vowel, F.lit("unknown_format")),
        F.when(F.length(c) != 7, F.lit("length_outside_expected")),
        F.when(changed, F.lit("corrected_from_ocr_noise")),
        F.when(F.col("suggested").isNull(), F.lit("unresolved_plate")),
    )
    return rows.withColumns(
        {
            "format": kind,
            "check_valid": is_valid,
            "is_valid": is_valid & F.col("suggested").isNotNull(),
            "normalized_plate": F.coalesce(F.when(c.rlike(MERCOSUL), c).when(c.rlike(OLD), hyphen).otherwise(F.col("_correction")), F.col("suggested"), F.lit("")),
            "correction_applied": changed,
            "exact_old": c.rlike(OLD),
            "exact_mercosul": c.rlike(MERCOSUL) & ~vowel,
            "prefix_score": prefix_plausibility(c),
            "old_score": F.expr(k.format_fit(SPARK, "compact", KINDS["old"], False)),
            "mercosul_score": F.expr(k.format_fit(SPARK, "compact", KINDS["mercosul"], True)),
            "issues": F.array_distinct(F.array_compact(issues)),
        }
    ).drop("_correction")


def multi_substitution(text: Column, places: int = 4) -> Column:
    """The most plausible plate from all look-alikes at the first ambiguous places, the first made on ties; null if none is a plate.

    At most six characters to the power of ``places`` texts for each input, as one array.
    """
    from platewright.functions.tables import SIMILAR

    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(s) for s in x)) for c in SIMILAR for x in (c, [c, *SIMILAR[c]])))
    places_of = F.slice(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda i: F.substr(text, i, F.lit(1)).isin(*SIMILAR)), 1, places)

    def made(at: Column) -> Column:
        texts = F.array(text)
        for k in range(places):
            texts = _swapped(texts, F.get(at, k), table, text)
        return texts

    plates = F.filter(let(places_of, made), lambda c: c.rlike(OLD) | (c.rlike(MERCOSUL) & ~F.substring(c, 5, 1).isin(*"AEIOU")))
    formatted = lambda c: F.when(c.rlike(OLD), F.concat(F.substring(c, 1, 3), F.lit("-"), F.substring(c, 4, 4))).otherwise(c)
    best = F.array_min(F.transform(plates, lambda c, i: F.struct((-prefix_plausibility(c)).alias("p"), i.alias("i"), formatted(c).alias("t"))))
    return F.when((F.length(text) >= 7) & (F.size(places_of) > 0), best["t"])


def _swapped(texts: Column, pos: Column, table: Column, text: Column) -> Column:
    """Each text with each look-alike (the character itself first) of the original text's character at the place."""
    options = F.try_element_at(table, F.substr(text, pos, F.lit(1)))
    each = F.transform(texts, lambda c: F.transform(options, lambda a: F.concat(F.substr(c, F.lit(1), pos - 1), a, F.substr(c, pos + 1, F.lit(99)))))
    return F.when(pos.isNull(), texts).otherwise(F.flatten(each))
