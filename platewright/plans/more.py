"""Further queries with their DuckDB SQL: parts of the validator, associations, small lists, pools and fragments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import DUCK as D
from platewright.functions.dialect import SPARK
from platewright.functions.tables import KINDS, VALIDATOR_RANGES, ordered
from platewright.operators import boxes, fragments, ngram, tracking, voting
from platewright.operators.validate import candidate_score, corrected, inserted
from platewright.plans import oracle as o
from platewright.plans.oracle import r6 as sql6
from platewright.plans.oracle import w
from platewright.plans.registry import K, Q, observations, reads, rounded
from platewright.plans.views import view, with_views

SQL: dict[str, str] = {}
RECOMMENDED = ["large-a", "large-b"]


def both(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def rows_only(f):
    Q[f.__name__] = f
    return f


seven = lambda s, d: reads(s, d).where("length(compact) = 7")
_OLD7, _NEW7 = (f"CASE WHEN regexp_matches(s, '{p}') THEN true ELSE false END" for p in ("^[A-Z]{3}[0-9]{4}$", "^[A-Z]{3}[0-9][A-Z][0-9]{2}$"))


@both(w(o.NEED_SQL, o.PLACES, o.SRC, "put AS (SELECT event_id, fmt, string_agg(r, '' ORDER BY pos) AS t, exp(sum(ln(w))) AS score FROM src, place JOIN need ON need.kind = place.kind WHERE length(s) = 7 AND need.ch = substr(s, pos, 1) GROUP BY 1, 2 HAVING count(*) = 7)", select=f"SELECT event_id, fmt, t, {sql6('score')} AS score FROM put"))
def correct_to_format(s, d):
    rows = seven(s, d).select("event_id", F.explode(F.array(*(F.struct(F.lit(f).alias("fmt"), corrected(F.col("compact"), f).alias("x")) for f in KINDS))).alias("y"))
    return rounded(rows.where("y.x.text IS NOT NULL").select("event_id", "y.fmt", F.col("y.x.text").alias("t"), F.col("y.x.score").alias("score")), "score")


@both(w(o.SRC, "q AS (SELECT event_id, s AS c FROM src WHERE length(s) = 7)", select=f"SELECT event_id, {sql6(f'({o._BASE}) * 0.8e0 + ({k.prefix_plausibility("c")}) * 0.2e0')} AS score FROM q"))
def score_candidate(s, d):
    return rounded(seven(s, d).select("event_id", candidate_score(F.col("compact")).alias("score")), "score")


@both(w(o.SLOTS, o.SRC, o.CANDIDATES, select="SELECT DISTINCT s, seq, c FROM options WHERE length(s) = 6 AND c IS NOT NULL"))
def infer_missing(s, d):
    c = F.col("compact")
    options = F.array(*(F.struct(F.lit(n * 7 + i).cast("long").alias("seq"), inserted(c, i, kind[i]).alias("c")) for n, kind in enumerate(KINDS.values()) for i in range(7)))
    return reads(s, d).where("length(compact) = 6").select(c.alias("s")).distinct().withColumnRenamed("s", "compact").select(F.col("compact").alias("s"), F.explode(options).alias("x")).select("s", "x.seq", "x.c").where("c IS NOT NULL")


@both(
    w(
        o.NEED_SQL, o.PLACES, o.SLOTS, o.SRC, o.CORRECTIONS,
        f"v AS (SELECT event_id, plate_text, s, p, {o.VALID} AS sug, {k.is_mercosul(D, 's')} AS new7, regexp_matches(s, '^[A-Z]{{3}}[0-9]{{4}}$') AS old7, {k.vowel_fifth('s')} AS vow FROM src LEFT JOIN fixed USING (s))",
        """x AS (SELECT *, new7 AND vow AS bad, CASE WHEN new7 THEN NOT vow WHEN old7 THEN true ELSE p IS NOT NULL END AS ok, coalesce(sug, '') <> '' AND replace(sug, '-', '') <> s AS fixed_up FROM v)""",
        select="""SELECT event_id, sug AS suggested, CASE WHEN new7 THEN 'mercosul' WHEN old7 THEN 'old' WHEN p LIKE '%-%' THEN 'old' WHEN p IS NOT NULL THEN 'mercosul' ELSE 'unknown' END AS format, ok AND sug IS NOT NULL AS is_valid,
  coalesce(CASE WHEN new7 THEN s WHEN old7 THEN substr(s, 1, 3) || '-' || substr(s, 4) ELSE p END, sug, '') AS normalized_plate, fixed_up AS correction_applied,
  concat_ws(',', CASE WHEN bad THEN 'vowel_in_fifth_place' END, CASE WHEN NOT ok AND NOT bad THEN 'unknown_format' END, CASE WHEN length(s) <> 7 THEN 'length_outside_expected' END, CASE WHEN fixed_up THEN 'corrected_from_ocr_noise' END, CASE WHEN sug IS NULL THEN 'unresolved_plate' END) AS issues FROM x""",
    )
)
def describe_validation(s, d):
    from platewright.operators.validate import with_validation

    return with_validation(reads(s, d)).select("event_id", "suggested", "format", "is_valid", "normalized_plate", "correction_applied", F.array_join("issues", ",").alias("issues"))


@both(w(o.SRC, o.NEED_SQL, o.PLACES, o.SLOTS, o.CORRECTIONS, select=f"SELECT DISTINCT s AS original, {o.VALID} AS corrected FROM src LEFT JOIN fixed USING (s) WHERE {o.VALID} IS NOT NULL AND replace({o.VALID}, '-', '') <> s"))
def correction_history(s, d):
    from platewright.operators.validate import validate

    # by way of an outer explode, below which the filters aren't pushed: they would repeat the whole rule
    rows = reads(s, d).select(F.col("compact").alias("original")).distinct().select("original", F.explode_outer(F.array(validate(F.col("original")))).alias("corrected"))
    return rows.where("corrected IS NOT NULL").where("replace(corrected, '-', '') <> original")


@both(w(o.values("ranges", "seq, state, low, high", ordered(VALIDATOR_RANGES)), o.SRC, select="SELECT event_id, CASE WHEN length(s) < 3 THEN 0.5e0 WHEN EXISTS (SELECT 1 FROM ranges WHERE substr(s, 1, 3) BETWEEN low AND high) THEN 1e0 ELSE 0.7e0 END AS score FROM src"))
def jn_prefix_range(s, d):
    """The plausibility of a prefix as a broadcast range join: the table has 55 rows. Prefixes first, so that each is looked up once."""
    ranges = F.broadcast(s.createDataFrame(ordered(VALIDATOR_RANGES), "seq int, state string, low string, high string"))
    heads = reads(s, d).select(F.substring("compact", 1, 3).alias("head")).distinct()
    known = heads.join(ranges, F.col("head").between(F.col("low"), F.col("high")), "left_semi").withColumn("known", F.lit(True))
    rows = reads(s, d).select("event_id", "compact", F.substring("compact", 1, 3).alias("head")).join(known, "head", "left")
    return rows.select("event_id", F.when(F.length("compact") < 3, 0.5).when(F.col("known"), 1.0).otherwise(0.7).alias("score"))


@both(w(o.SRC, "texts_in AS (SELECT s AS t FROM src)", o.NGRAM, select=f"SELECT video_id, event_id, place FROM (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY round(0.7e0 * coalesce(ngram, 0e0) + 0.3e0 * confidence, 9) DESC, frame_number) AS place FROM src LEFT JOIN ngrams ON t = s) x WHERE place <= 5"))
def topk_ngram(s, d):
    rows = ngram.score_texts(reads(s, d), "compact").withColumn("c", 0.7 * F.col("ngram") + 0.3 * F.col("confidence"))
    v = Window.partitionBy("video_id").orderBy(F.round("c", 9).desc(), "frame_number")
    return rows.withColumn("place", F.row_number().over(v).cast("long")).where("place <= 5").select("video_id", "event_id", "place")


_POOL = "pool AS (SELECT video_id, frame_number // 4 AS g, s AS text, frame_number, confidence AS p, quality AS v, frame_number % 4 = 0 AS prim, " + k.is_plate(D, "s") + " AS ok FROM src)"
_POOLED = "pooled AS (SELECT video_id, g, text, max(p) AS p, max(v) AS v, arg_max(ok, frame_number) AS ok, bool_or(prim) AS prim FROM pool WHERE text <> '' GROUP BY 1, 2, 3)"


def pool(s, d):
    rows = reads(s, d).where("compact <> ''").withColumns({"g": F.floor(F.col("frame_number") / 4), "ok": F.expr(k.is_plate(SPARK, "compact"))})
    return rows.groupBy("video_id", "g", F.col("compact").alias("text")).agg(F.max("confidence").alias("p"), F.max("quality").alias("v"), F.max_by("ok", "frame_number").alias("ok"), F.bool_or(F.col("frame_number") % 4 == 0).alias("prim"))


@both(w(o.SRC, _POOL, _POOLED, select="SELECT video_id, g, text, p, v, ok, prim FROM pooled"))
def agg_llm_pool(s, d):
    return pool(s, d)


def ranked(s, d):
    v = Window.partitionBy("video_id", "g").orderBy(F.desc("p"), F.desc("v"), F.desc("prim"), "text")
    return pool(s, d).withColumn("place", F.row_number().over(v).cast("long"))


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, g ORDER BY p DESC, v DESC, prim DESC, text) AS place FROM pooled)"


@both(w(o.SRC, _POOL, _POOLED, _RANKED, select="SELECT video_id, g, text, place FROM ranked WHERE place <= 3"))
def topk_llm(s, d):
    return ranked(s, d).where("place <= 3").select("video_id", "g", "text", "place")


@both(w(o.SRC, _POOL, _POOLED, _RANKED, select=f"SELECT video_id, g, text, {sql6('CASE WHEN sum(p) OVER (PARTITION BY video_id, g) > 0 THEN p / sum(p) OVER (PARTITION BY video_id, g) ELSE p END')} AS probability FROM ranked WHERE place <= 5"))
def win_prob_norm(s, d):
    total = F.sum(F.greatest(F.lit(0.0), "p")).over(Window.partitionBy("video_id", "g"))
    return rounded(ranked(s, d).where("place <= 5").select("video_id", "g", "text", F.when(total > 0, F.col("p") / total).otherwise(F.col("p")).alias("probability")), "probability")


@both(w(o.SRC, _POOL, _POOLED, _RANKED, select=f"SELECT video_id, g, {sql6('greatest(0e0, max(CASE WHEN place = 1 THEN p END) - coalesce(max(CASE WHEN place = 2 THEN p END), 0e0))')} AS gap FROM ranked GROUP BY 1, 2"))
def win_gap(s, d):
    top = ranked(s, d).groupBy("video_id", "g").agg(F.max(F.when(F.col("place") == 1, F.col("p"))).alias("a"), F.max(F.when(F.col("place") == 2, F.col("p"))).alias("b"))
    return rounded(top.select("video_id", "g", F.greatest(F.lit(0.0), F.col("a") - F.coalesce("b", F.lit(0.0))).alias("gap")), "gap")


@both(w(o.SRC, _POOL, _POOLED, _RANKED, select="SELECT r.video_id, r.g, r.text AS pick, CASE WHEN r.place <= 3 THEN r.text ELSE 'ABSTAIN' END AS choice FROM ranked r"))
def jn_llm_member(s, d):
    from platewright.sources.payloads import accepted_pick

    offered = ranked(s, d).where("place <= 3").groupBy("video_id", "g").agg(F.collect_list("text").alias("offered"))
    rows = ranked(s, d).select("video_id", "g", F.col("text").alias("pick")).join(offered, ["video_id", "g"])
    return accepted_pick(rows, "pick", "offered").select("video_id", "g", "pick", "choice")


@both(with_views("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'large-a' WHEN 1 THEN 'large-b' WHEN 2 THEN 'own' ELSE 'other' END AS model FROM reads"))
def prj_model_pick(s, d):
    """The first recommended model that is installed, else the configured one, else the first installed, else the first recommended."""
    i = F.col("event_id") % 4
    installed = F.when(i == 0, F.array(F.lit("other"), F.lit("large-a"))).when(i == 1, F.array(F.lit("large-b"))).otherwise(F.array(F.lit("other")))
    configured = F.when(i == 2, F.lit("own")).otherwise(F.lit(""))
    wanted = F.array(*(F.lit(m) for m in RECOMMENDED))
    pick = F.coalesce(F.get(F.filter(wanted, lambda m: F.array_contains(installed, m)), 0), F.nullif(configured, F.lit("")), F.get(installed, 0), F.get(wanted, 0))
    return view(s, d, "reads").select("event_id", pick.alias("model"))


@both(with_views("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'm1,m2,m3' ELSE 'm2,m3' END AS models FROM reads"))
def prj_ordered_dedup(s, d):
    first = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("m1"), F.lit(""))).otherwise(F.array(F.lit("")))
    models = F.filter(F.array_distinct(F.concat(first, F.array(F.lit("m2"), F.lit("m2")), F.array(F.lit("m3"), F.lit("m2")))), lambda m: m != "")
    return view(s, d, "reads").select("event_id", F.array_join(models, ",").alias("models"))


@both(w(o.SRC, o.TRACKS, o.INDIVIDUAL, o.MAJOR, o.VOTED, o.HYBRID, "tt AS (SELECT video_id, vehicle, best_text AS t FROM res UNION SELECT video_id, vehicle, major_text FROM res WHERE major_text IS NOT NULL)", select="SELECT event_id, min(tt.vehicle) AS track FROM src JOIN tt ON tt.video_id = src.video_id AND tt.t = src.s GROUP BY 1"))
def jn_track_lookup(s, d):
    """The first track whose best or voted text a read has."""
    best = voting.individual(observations(s, d), K).select(*K, F.col("best_text").alias("t"))
    texts = best.unionByName(voting.majority(observations(s, d), K).select(*K, F.col("major_text").alias("t"))).distinct().withColumnRenamed("vehicle", "track")
    rows = reads(s, d).select("event_id", "video_id", F.col("compact").alias("t")).join(texts, ["video_id", "t"])
    return rows.groupBy("event_id").agg(F.min("track").alias("track"))


@both(with_views(f"SELECT event_id, len(t) AS n, {sql6('conf_sum')} AS total FROM (SELECT event_id, true_plate AS t, confidence * 3 + (length(true_plate) - 3) * quality AS conf_sum FROM reads) x"))
def build_char_conf(s, d):
    confs = F.array(*(F.col("confidence") for _ in range(3)))
    rows = view(s, d, "reads").select("event_id", fragments.char_confidences(F.col("true_plate"), confs, F.col("quality")).alias("c"))
    return rounded(rows.select("event_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0.0), lambda a, x: a + x["conf"]).alias("total")), "total")


_FRAG = f"fr AS (SELECT event_id, s, substr(s, 1, 3) AS a, substr(s, 4) AS b, confidence AS ca, quality AS cb, {k.is_plate(D, 's')} AS fits FROM src)"


@both(w(o.SRC, _FRAG, select=f"SELECT event_id, CASE WHEN fits THEN s WHEN b = '' OR (a <> '' AND ca >= cb) THEN a ELSE b END AS text, {sql6('CASE WHEN fits THEN (ca + cb) / 2 WHEN b = \'\' OR (a <> \'\' AND ca >= cb) THEN ca ELSE cb END')} AS score FROM fr WHERE s <> '' AND length(s) <= 7"))
def frag_concat(s, d):
    rows = reads(s, d).where("compact <> '' AND length(compact) <= 7")
    parts = F.array(F.struct(F.lit(0).alias("seq"), F.substring("compact", 1, 3).alias("text"), F.col("confidence").alias("score")), F.struct(F.lit(1).alias("seq"), F.substring("compact", 4, 9).alias("text"), F.col("quality").alias("score")))
    found = fragments.best_text(rows.select(F.col("event_id").alias("read_id"), F.explode(parts).alias("x")).select("read_id", "x.*"))
    return rounded(found.select(F.col("read_id").alias("event_id"), "text", "score"), "score")


@both(with_views(f"SELECT event_id, true_plate AS text, {sql6('confidence')} AS score FROM reads"))
def ocr_parse(s, d):
    """Both raw layouts, by turns, as JSON in and fragments out."""
    new = F.to_json(F.array(F.struct(F.array("true_plate").alias("rec_texts"), F.array("confidence").alias("rec_scores"))))
    old = F.concat(F.lit('[[[[[0,0],[1,0]],["'), "true_plate", F.lit('",'), F.col("confidence").cast("string"), F.lit("]]]]"))
    body = F.when(F.col("event_id") % 2 == 0, new).otherwise(old)
    rows = fragments.parsed(view(s, d, "reads").select(F.col("event_id").alias("read_id"), body.alias("body")), "body")
    return rounded(rows.select(F.col("read_id").alias("event_id"), "text", "score"), "score")


@both(with_views("SELECT event_id, CAST(round_even(0.65e0 * x1 + (1e0 - 0.65e0) * y1, 0) AS BIGINT) AS x, CAST(round_even(0.65e0 * x2 + (1e0 - 0.65e0) * y2, 0) AS BIGINT) AS y FROM reads"))
def smooth_bbox(s, d):
    mix = lambda a, b: F.bround(0.65 * F.col(a) + (1 - 0.65) * F.col(b)).cast("long")
    return view(s, d, "reads").select("event_id", mix("x1", "y1").alias("x"), mix("x2", "y2").alias("y"))


@both(with_views("SELECT event_id, sha256(true_plate) AS digest FROM reads"))
def sha256(s, d):
    return view(s, d, "reads").select("event_id", F.sha2("true_plate", 256).alias("digest"))


@both(w(o.PLATES, select=f"SELECT video_id, plate, {sql6('avg(c)')} AS mean FROM (SELECT video_id, plate, confidence * (80 + (event_id + pos) % 5 * 5) / 100e0 AS c FROM rq, (SELECT unnest(range(0, 9)) AS pos) p WHERE plate <> '' AND pos < length(plate)) x GROUP BY 1, 2"))
def mean_char_conf(s, d):
    from platewright.plans.registry import char_reads

    rows = char_reads(s, d).select("video_id", "plate", F.explode("char_confs").alias("c"))
    return rounded(rows.groupBy("video_id", "plate").agg(F.avg("c.conf").alias("mean")), "mean")


@both(w(o.PLATES, select="SELECT video_id, plate, tag, count(*) AS n FROM (SELECT video_id, plate, CASE WHEN quality < 0.3e0 THEN 'low_light' WHEN motion > 0.35e0 THEN 'motion' ELSE 'clear' END AS tag FROM rq WHERE plate <> '') x GROUP BY 1, 2, 3"))
def agg_scenarios(s, d):
    tag = F.when(F.col("quality") < 0.3, "low_light").when(F.col("motion") > 0.35, "motion").otherwise("clear")
    return reads(s, d).where("plate <> ''").groupBy("video_id", "plate", tag.alias("tag")).agg(F.count("*").alias("n"))


@both(w(o.TRACKS, o.INDIVIDUAL, select="SELECT video_id, vehicle, last_frame - first_frame + 1 AS duration FROM ind"))
def track_duration(s, d):
    return voting.individual(observations(s, d), K).selectExpr("video_id", "vehicle", "last_frame - first_frame + 1 AS duration")


_CANDS = (
    o.NEED_SQL, o.PLACES, o.SLOTS, o.SRC, o.CORRECTIONS,
    f"""made AS (SELECT event_id, s AS raw, confidence, s AS text, 0 AS seq FROM src UNION ALL SELECT event_id, s, confidence, replace({o.VALID}, '-', ''), 1 FROM src LEFT JOIN fixed USING (s) UNION ALL SELECT event_id, src.s, confidence, c, 1 + place FROM src JOIN c7 USING (s)),
cp AS (SELECT event_id, raw, text, max(confidence) AS base_conf, count(*) AS support, min(seq) AS seq FROM made WHERE text <> '' GROUP BY 1, 2, 3)""",
)
SQL["agg_cand_pool"] = w(*_CANDS, select="SELECT event_id AS read_id, text, base_conf, support FROM cp")
_PRIOR = o.ORACLE["win_temporal_prior"]
_SCORES = (
    *_CANDS, o.SIMILAR_SQL, "texts_in AS (SELECT DISTINCT text AS t FROM cp)", o.NGRAM, o.PLATES,
    _PRIOR[_PRIOR.index("tp AS (") : _PRIOR.index(" SELECT event_id, (floor(")],
    """prior AS (SELECT event_id, CASE WHEN n > 0 THEN least(1e0, 0.35e0 * n / max_n + 0.2e0 * (last - first + 1) / max_span + 0.2e0 * best + 0.15e0 * bq + 0.1e0 * greatest(chars, least(1e0, n / 5e0))) ELSE 0e0 END AS prior FROM tm)""",
    """sup AS (SELECT event_id, text, sum(least(1e0, CASE WHEN substr(raw, pos, 1) = substr(text, pos, 1) THEN base_conf WHEN w IS NOT NULL THEN greatest(0.12e0, base_conf * w + (1e0 - base_conf) * 0.25e0) ELSE greatest(0.05e0, (1e0 - base_conf) * 0.6e0) END)) / max(length(text)) AS ocr
  FROM cp CROSS JOIN (SELECT unnest(range(1, 10)) AS pos) p LEFT JOIN similar_to ON ch = substr(raw, pos, 1) AND alike = substr(text, pos, 1) WHERE pos <= length(text) GROUP BY 1, 2)""",
    f"""cs AS (SELECT cp.event_id, cp.text, cp.seq, cp.support, 0.3e0 * (0.7e0 * coalesce(ngram, 0e0) + 0.3e0 * base_conf) + 0.3e0 * ocr + 0.2e0 * ({k.pattern_score(D, 'cp.text')}) + 0.1e0 * least(1e0, cp.support) + 0.1e0 * least(1e0, prior) AS c
  FROM cp JOIN sup ON sup.event_id = cp.event_id AND sup.text = cp.text JOIN prior ON prior.event_id = cp.event_id LEFT JOIN ngrams ON t = cp.text),
top5 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(c, 9) DESC, seq) AS place FROM cs)""",
)
SQL["cand_score"] = w(*_SCORES, select=f"SELECT event_id AS read_id, text, {sql6('c')} AS composite FROM cs")
_CHANGES = "(SELECT string_agg(pos || ':' || CASE WHEN substr(s, pos, 1) = '' THEN '_' ELSE substr(s, pos, 1) END || '->' || substr(t5.text, pos, 1), ', ' ORDER BY pos) FROM (SELECT unnest(range(1, 10)) AS pos) p WHERE pos <= length(t5.text) AND substr(s, pos, 1) <> substr(t5.text, pos, 1))"
SQL["topk_alt"] = w(*_SCORES, select=f"SELECT t5.event_id AS read_id, place, text, {sql6('c / sum(c) OVER (PARTITION BY t5.event_id)')} AS probability, coalesce({_CHANGES}, 'no-change') AS changes, support FROM top5 t5 JOIN src ON src.event_id = t5.event_id WHERE place <= 5")


SQL["gate_llm"] = w(
    *_SCORES,
    "pr AS (SELECT event_id, place, c / sum(c) OVER (PARTITION BY event_id) AS p FROM top5 WHERE place <= 5)",
    "gp AS (SELECT event_id, count(*) AS n, max(CASE WHEN place = 1 THEN p END) AS p1, max(CASE WHEN place = 2 THEN p END) AS p2 FROM pr GROUP BY 1)",
    f"gv AS (SELECT event_id, confidence, {o.VALID} IS NOT NULL AS ok FROM src LEFT JOIN fixed USING (s))",
    select=f"SELECT event_id AS read_id, {sql6('greatest(0e0, p1 - p2)')} AS gap, CASE WHEN n < 2 THEN 'not_enough_candidates' WHEN NOT ok OR confidence < 0.8e0 OR greatest(0e0, p1 - p2) <= 0.12e0 THEN 'ask' ELSE 'not_needed' END AS reason FROM gp JOIN gv USING (event_id)",
)
SQL["img_variant_ocr"] = w(o.SRC, select="SELECT video_id AS crop_id, CAST(frame_number AS INT) AS variant_idx, s AS text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, frame_number) AS rn FROM src WHERE s <> '') x WHERE rn = 1")


@both(w(o.SRC, o.PREFIXES, select="SELECT event_id FROM src WHERE substr(s, 1, 3) IN (SELECT prefix FROM prefixes)"))
def jn_prefix_valid(s, d):
    return reads(s, d).select("event_id", F.substring("compact", 1, 3).alias("prefix")).join(F.broadcast(ngram.prefixes(s)), "prefix", "left_semi").select("event_id")


@both(w(o.SLOTS, o.SRC, o.CANDIDATES, select="SELECT s, string_agg(c, ',' ORDER BY place) AS best FROM c7 GROUP BY s"))
def topk_norm7(s, d):
    from platewright.operators.validate import normalize_to_7

    rows = reads(s, d).where("length(compact) BETWEEN 6 AND 8").select(F.col("compact").alias("s")).distinct()
    return rows.select("s", F.array_join(normalize_to_7(F.col("s")), ",").alias("best"))


@both(o.ORACLE["calib_grid"].replace("SELECT CAST(n AS BIGINT) AS grid_seq", "SELECT row_number() OVER (ORDER BY " + sql6(k.calib_score("ex", "ch", "fp", "ms")) + " DESC, n) AS place, CAST(n AS BIGINT) AS grid_seq"))
def srt_leaderboard(s, d):
    v = Window.orderBy(F.desc("score"), "grid_seq")  # one row per combination of thresholds
    return Q["calib_grid"](s, d).withColumn("place", F.row_number().over(v).cast("long"))


_OPTIONS = "opts AS (SELECT ch, ch AS alt, -1 AS rank FROM similar_to GROUP BY ch UNION ALL SELECT ch, alike, rank FROM similar_to)"
_AMB = "amb AS (SELECT s, pos, substr(s, pos, 1) AS ch, row_number() OVER (PARTITION BY s ORDER BY pos) AS rn FROM (SELECT DISTINCT s FROM src WHERE length(s) >= 7) q, (SELECT unnest(range(1, 12)) AS pos) p WHERE substr(s, pos, 1) IN (SELECT ch FROM similar_to))"
_STEP = lambda n, last: f"m{n} AS (SELECT m.s, CASE WHEN a.pos IS NULL THEN m.t ELSE substr(m.t, 1, CAST(a.pos AS INT) - 1) || x.alt || substr(m.t, CAST(a.pos AS INT) + 1) END AS t, m.o * 10 + coalesce(x.rank + 1, 0) AS o FROM {last} m LEFT JOIN amb a ON a.s = m.s AND a.rn = {n} LEFT JOIN opts x ON x.ch = a.ch)"


@both(
    w(
        o.SRC, o.SIMILAR_SQL, _OPTIONS, _AMB, "m0 AS (SELECT DISTINCT s, s AS t, 0 AS o FROM amb)", *(_STEP(n, f"m{n - 1}") for n in (1, 2, 3, 4)),
        f"good AS (SELECT s, t, o, ({k.prefix_plausibility('t')}) AS p FROM m4 WHERE regexp_matches(t, '^[A-Z]{{3}}[0-9]{{4}}$') OR ({k.is_mercosul(D, 't')} AND NOT {k.vowel_fifth('t')}))",
        select="SELECT s, CASE WHEN regexp_matches(t, '[0-9]{4}$') THEN substr(t, 1, 3) || '-' || substr(t, 4) ELSE t END AS plate FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p DESC, o) AS rn FROM good) x WHERE rn = 1",
    )
)
def multi_subst(s, d):
    from platewright.operators.validate import multi_substitution

    rows = reads(s, d).where("length(compact) >= 7").select(F.col("compact").alias("s")).distinct()
    return rows.select("s", F.explode_outer(F.array(multi_substitution(F.col("s")))).alias("plate")).where("plate IS NOT NULL")


@both(w(o.SRC, select="SELECT event_id, CAST((CASE WHEN substr(s, 1, 3) <> '' THEN 1 ELSE 0 END + CASE WHEN substr(s, 4) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM src"))
def flt_empty_frag(s, d):
    parts = F.filter(F.array(F.substring("compact", 1, 3), F.lit(""), F.substring("compact", 4, 99)), lambda p: p != "")
    return reads(s, d).select("event_id", F.size(parts).cast("long").alias("kept"))


def _flat(x, path=()):
    if isinstance(x, dict):
        for key in x:
            yield from _flat(x[key], (*path, key))
    else:
        yield ".".join(path), str(x)


@both(with_views("SELECT 'video.skip_frames' AS path, '5' AS value UNION ALL SELECT 'temporal_voting.min_observations', '3' UNION ALL SELECT 'ocr.max_variants', '1' UNION ALL SELECT 'ocr.engine', 'paddle' UNION ALL SELECT 'forensic.jpeg_quality', '100' UNION ALL SELECT 'ocr.paddle.lang', 'pt'"))
def cfg_typed(s, d):
    from platewright.config import settings

    found = settings({"video": {"vehicle_mode": "stationary", "skip_frames": 0}, "temporal_voting": {"min_observations": 0}, "ocr": {"max_variants": 0, "engine": "x"}, "forensic": {"jpeg_quality": 300}})
    wanted = ["video.skip_frames", "temporal_voting.min_observations", "ocr.max_variants", "ocr.engine", "forensic.jpeg_quality", "ocr.paddle.lang"]
    return s.createDataFrame([x for x in _flat(found) if x[0] in wanted], "path string, value string")


@both(with_views("SELECT 'a.b' AS path, '1' AS value UNION ALL SELECT 'a.c', '9' UNION ALL SELECT 'd', '2'"))
def deep_merge(s, d):
    from platewright.config import merged

    return s.createDataFrame(list(_flat(merged({"a": {"b": 1, "c": 3}, "d": {"e": 1}}, {"a": {"c": 9}, "d": 2}))), "path string, value string")


@rows_only
def prj_detect_flow(s, d):
    rows = boxes.valid_boxes(view(s, d, "boxes")).dropDuplicates(["image_id", "det_seq"])
    return boxes.detect_flow(rows.where("det_seq % 2 = 1"), rows.where("det_seq % 2 = 0"))


@rows_only
def report_payload(s, d):
    from platewright.sources.reports import report_payload as payload

    rows = reads(s, d).withColumn("is_valid", F.expr(k.is_plate(SPARK, "compact")))
    return payload(rows).select("label", F.get_json_object("payload", "$.recognition.confidence_band").alias("band"))


@rows_only
def track_summary(s, d):
    return tracking.track_summary(tracking.assign_tracks(reads(s, d)))


@rows_only
def img_variant_ocr(s, d):
    from platewright.operators.engines import best_read

    rows = reads(s, d).select(F.col("video_id").alias("crop_id"), F.col("frame_number").cast("int").alias("variant_idx"), F.col("compact").alias("text"), "confidence")
    return best_read(rows)

