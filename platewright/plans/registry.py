"""All queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import SPARK
from platewright.functions.tables import NEED, SIMILAR
from platewright.operators import boxes, candidates, evaluate, images, ngram, rollup, tracking, voting
from platewright.operators.validate import best_correction, normalize_to_7, validate, with_validation
from platewright.plans.oracle import ORACLE as BUILT
from platewright.plans.shared import SHARED
from platewright.plans.views import view

r6 = lambda c: F.floor(F.col(c) * 1e6 + 0.5001) / 1e6
K = ["video_id", "vehicle"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def reads(spark, sf_dir) -> DataFrame:
    """The reads with compact text, normalised plate, and the columns that rollups want."""
    rows = view(spark, sf_dir, "reads").withColumn("compact", F.expr(k.compact(SPARK, "plate_text"))).withColumn("plate", F.expr(k.normalize_plate(SPARK, "plate_text")))
    return rows.withColumns({"seq": F.lit(0).cast("long"), "char_conf": F.col("confidence")})


def observations(spark, sf_dir) -> DataFrame:
    return reads(spark, sf_dir).select(*K, F.col("frame_number").alias("seq"), F.col("compact").alias("text"), F.col("confidence").alias("conf"))


def plates(spark, sf_dir) -> DataFrame:
    return rollup.unique_plates(reads(spark, sf_dir).where("plate <> ''"))


def char_reads(spark, sf_dir) -> DataFrame:
    chars = F.transform(F.filter(F.split("plate", ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("ch"), (F.col("confidence") * (80 + (F.col("event_id") + i) % 5 * 5) / 100.0).alias("conf")))
    return reads(spark, sf_dir).where("plate <> ''").withColumn("char_confs", chars)


def records(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "records").withColumn("tags", F.array("tag", "tag2"))


SUMMARY = ("exact_rate", "char_accuracy", "false_positive_rate", "avg_confidence", "avg_detection", "avg_ms")
by_compact = lambda s, d: reads(s, d).select("event_id", "compact")
Q: dict = {name: q for name, (q, _) in SHARED.items()}


def query(f):
    Q[f.__name__] = f
    return f


# --- text


@query
def validate_plates(s, d):
    return by_compact(s, d).select("event_id", validate(F.col("compact")).alias("plate"))


Q["validate"] = Q.pop("validate_plates")


@query
def try_correction(s, d):
    return by_compact(s, d).select("event_id", best_correction(F.col("compact")).alias("plate"))


Q["normalize_to_7"] = lambda s, d: by_compact(s, d).select("event_id", F.posexplode(normalize_to_7(F.col("compact"))).alias("p", "candidate")).select("event_id", "candidate", (F.col("p") + 1).cast("long").alias("place"))
Q["check_validity"] = lambda s, d: with_validation(reads(s, d)).select("event_id", "format", "check_valid")
Q["describe_validation"] = lambda s, d: with_validation(reads(s, d)).select("event_id", "suggested", "format", "is_valid", "normalized_plate", "correction_applied", F.array_join("issues", ",").alias("issues"))
Q["best_replacement"] = lambda s, d: s.createDataFrame([(n, c, r, w) for n, t in NEED.items() for c, (r, w) in t.items()], "kind string, ch string, r string, w double")
Q["confusion_weight"] = lambda s, d: s.createDataFrame([(a, b) for a, o in SIMILAR.items() for b in o], "a string, b string").withColumn("w", candidates.confusion_weight("a", "b"))
Q["similar_group"] = lambda s, d: s.createDataFrame([(a, "".join(o)) for a, o in SIMILAR.items()], "ch string, alike string")
Q["describe_changes"] = lambda s, d: reads(s, d).select("event_id", candidates.describe_changes("compact", "true_plate").alias("changes"))
Q["cand_support"] = lambda s, d: rounded(reads(s, d).select("event_id", candidates.support("compact", "true_plate", "confidence").alias("support")), "support")


# --- n-gram model and candidates


@query
def jn_prefix_state(s, d):
    known = ngram.prefixes(s)
    rows = by_compact(s, d).withColumn("prefix", F.substring("compact", 1, 3)).join(F.broadcast(known), "prefix", "left")
    return rows.select("event_id", "state", F.col("state").isNotNull().alias("known"))


@query
def ngram_build(s, d):
    known = ngram.prefixes(s)
    one = ngram.letter_rates(known).select(F.lit("single").alias("kind"), "pos", F.lit("").alias("prev"), "ch", "p")
    return rounded(one.unionByName(ngram.pair_rates(known).select(F.lit("pair").alias("kind"), "pos", "prev", "ch", "p")), "p")


Q["ngram_score"] = lambda s, d: rounded(ngram.score_texts(by_compact(s, d), "compact").select("event_id", F.col("ngram").alias("score")), "score")


@query
def topk_chars(s, d):
    w = Window.partitionBy("pos", "prev").orderBy(F.desc("p"), "ch")
    return ngram.pair_rates(ngram.prefixes(s)).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("pos", "prev", "ch", "place")


def priors(s, d):
    return rollup.temporal_prior(reads(s, d).where("plate <> ''")).withColumn("read_id", F.col("event_id"))


Q["topk_alt"] = lambda s, d: rounded(candidates.alternatives(priors(s, d).select("read_id", "plate_text", "confidence", "prior")), "probability")
Q["cand_score"] = lambda s, d: rounded(candidates.scored(priors(s, d).select("read_id", "plate_text", "confidence", "prior")).select("read_id", "text", "composite"), "composite")
Q["agg_cand_pool"] = lambda s, d: ngram.candidate_table(reads(s, d).withColumn("read_id", F.col("event_id"))).select("read_id", "text", "base_conf", "support")


@query
def gate_llm(s, d):
    rows = priors(s, d)
    alternatives = candidates.alternatives(rows.select("read_id", "plate_text", "confidence", "prior"))
    judged = rows.select("read_id", "confidence", validate(F.col("compact")).isNotNull().alias("is_valid"))
    return rounded(candidates.gate(alternatives, judged), "gap")


# --- votes and rollups

Q["vote_majority"] = lambda s, d: rounded(voting.majority(observations(s, d), K), "share", "major_conf")
Q["vote_positional"] = lambda s, d: rounded(voting.positional(observations(s, d), K), "voted_conf")
Q["vote_hybrid"] = lambda s, d: rounded(voting.hybrid(observations(s, d), K), "confidence").select(*K, "text", "confidence", "observations", "voting_applied")
Q["agg_track"] = lambda s, d: voting.individual(observations(s, d), K)
Q["agg_self_consistency"] = lambda s, d: rounded(voting.self_consistency(observations(s, d), K), "confidence")
Q["agg_unique"] = lambda s, d: rounded(plates(s, d), "avg_confidence", "avg_quality").drop("char_confirmation", "temporal_observations")
Q["agg_best_conf_text"] = lambda s, d: plates(s, d).select("video_id", "plate", "plate_text", "best_confidence")
Q["agg_best_quality"] = lambda s, d: plates(s, d).select("video_id", "plate", "best_frame_number", "best_quality")
Q["topk_rank"] = lambda s, d: rounded(rollup.rank_plates(plates(s, d)), "composite").select("video_id", "place", "plate", "total_detections", "composite")
Q["topk_frames"] = lambda s, d: rollup.rank_plates(plates(s, d), 3).select("video_id", F.col("best_frame_number").alias("frame_number"), "place")
Q["agg_best_char"] = lambda s, d: rollup.best_chars(char_reads(s, d)).withColumn("pos", F.col("pos").cast("long"))
Q["confirmed_reading"] = lambda s, d: rollup.confirmed_reading(rollup.best_chars(char_reads(s, d)))
Q["agg_stable_bbox"] = lambda s, d: rollup.stable_boxes(reads(s, d).where("plate <> ''"))
Q["timeline"] = lambda s, d: reads(s, d).groupBy("video_id", "frame_number").agg(F.min(F.col("timestamp_ms") / 1000.0).alias("time_s"), F.array_join(F.collect_list("plate_text"), ", ").alias("texts"), F.max("confidence").alias("max_confidence"))
Q["win_early_stop"] = lambda s, d: rollup.early_stop(reads(s, d).where("plate <> ''"))
Q["win_last_annot"] = lambda s, d: rollup.last_annotation(reads(s, d).withColumn("a", F.expr("CASE WHEN (frame_number - 1) % 2 = 0 THEN plate_text END")), "a").select("video_id", "frame_number", "shown")
Q["win_temporal_prior"] = lambda s, d: rounded(priors(s, d).select("event_id", "prior"), "prior")


@query
def win_norm_max(s, d):
    w = Window.partitionBy("video_id")
    share = lambda c: F.col(c) / F.max(c).over(w)
    return rounded(plates(s, d).select("video_id", "plate", share("total_detections").alias("detections"), share("span_frames").alias("span")), "detections", "span")


@query
def flt_limit(s, d):
    w = Window.partitionBy("video_id").orderBy("frame_number")
    return reads(s, d).where("(frame_number - 1) % 2 = 0 AND ms >= 50").withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("video_id", "frame_number")


@query
def win_artifact_cap(s, d):
    """The first 50 artifacts of the whole run, by video and frame; each partition gives 50 rows at most to the numbering."""
    reasons = F.array_join(F.array_compact(F.array(F.when(~F.expr(k.is_plate(SPARK, "compact")), "invalid"), F.when(F.col("confidence") < 0.75, "lowconf"))), "_")
    rows = reads(s, d).withColumn("reasons", reasons).where("reasons <> ''")
    order = ("video_id", "frame_number", "event_id")
    rows = rows.orderBy(*order).limit(50).withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))
    label = F.concat_ws("_", F.lpad(F.col("n").cast("string"), 3, "0"), F.when(F.col("compact") == "", "unknown").otherwise(F.col("compact")), "reasons")
    return rows.select("video_id", "event_id", "n", label.alias("label"))


# --- joins


@query
def jn_dict_lookup(s, d):
    voted = voting.majority(observations(s, d), K).groupBy(F.col("video_id").alias("v"), F.col("major_text").alias("t")).agg(F.max("major_conf").alias("voted_conf"))
    rows = plates(s, d).join(voted, (F.col("video_id") == F.col("v")) & (F.col("plate") == F.col("t")), "full")
    better = F.col("voted_conf").isNotNull() & (F.col("best_confidence").isNull() | (F.col("voted_conf") > F.col("best_confidence")))
    best = F.greatest(F.coalesce("best_confidence", F.lit(0.0)), F.coalesce("voted_conf", F.lit(0.0)))
    return rounded(rows.select(F.coalesce("video_id", "v").alias("video_id"), F.coalesce("plate", "t").alias("plate"), best.alias("best_confidence"), F.coalesce(better, F.lit(False)).alias("voted")), "best_confidence")


Q["jn_frame_map"] = lambda s, d: plates(s, d).select("video_id", "plate", F.col("best_frame_number").alias("frame_number")).join(reads(s, d).select("video_id", "frame_number", "event_id"), ["video_id", "frame_number"]).select("video_id", "plate", "event_id")


@query
def jn_local_premium(s, d):
    rows = reads(s, d).select("event_id", "compact", "true_plate", F.explode(F.sequence(F.lit(1), F.greatest(F.length("compact"), F.length("true_plate")))).alias("pos"))
    char = lambda c: F.expr(f"CASE WHEN substr({c}, pos, 1) = '' THEN '-' ELSE substr({c}, pos, 1) END")
    return rows.select("event_id", F.col("pos").cast("long").alias("pos"), char("compact").alias("local"), char("true_plate").alias("premium"))


@query
def jn_pred_fixture(s, d):
    rows = view(s, d, "reads")
    got = rows.where("confidence >= 0.5e0").select(F.col("event_id").alias("i"), F.expr("upper(trim(plate_text))").alias("p"), F.col("confidence").alias("c"))
    rows = rows.join(got, F.col("event_id") == F.col("i"), "left")
    return rows.select(F.col("event_id").alias("fixture_id"), F.col("true_plate").alias("expected"), F.coalesce("p", F.lit("")).alias("predicted"), F.coalesce("c", F.lit(0.0)).alias("confidence"))


@query
def jn_iou(s, d):
    a, b = (view(s, d, "boxes").select("image_id", *(F.col(c).alias(f"{p}_{c.replace('det_', '')}") for c in ("det_seq", "x1", "y1", "x2", "y2"))) for p in "ab")
    pairs = a.join(b, "image_id").where("a_seq < b_seq")
    pairs = pairs.withColumns({"iou": F.expr(k.iou("a_", "b_")), "iou_floor": F.expr(k.iou("a_", "b_", True))})
    return rounded(pairs.select("image_id", "a_seq", "b_seq", "iou", "iou_floor"), "iou", "iou_floor")


Q["jn_text_sim"] = lambda s, d: rounded(reads(s, d).select("event_id", F.expr(k.text_similarity("compact", "true_plate")).alias("similarity")), "similarity")


# --- boxes and images

Q["prj_region"] = lambda s, d: boxes.regions(boxes.valid_boxes(view(s, d, "boxes"))).select("image_id", "det_seq", "cx1", "cy1", "cx2", "cy2", "out_w", "out_h")
Q["prj_tile"] = lambda s, d: boxes.tiles(view(s, d, "boxes").select("image_id", "img_w", "img_h").distinct())
Q["prd_sahi_retry"] = lambda s, d: boxes.retry_reason(view(s, d, "boxes"))
Q["nms"] = lambda s, d: boxes.nms(boxes.valid_boxes(view(s, d, "boxes")))
Q["img_order_corners"] = lambda s, d: boxes.order_corners(view(s, d, "boxes").select("image_id", F.col("det_seq").alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y")), "image_id")
Q["img_resize_geom"] = lambda s, d: boxes.fit_geometry(view(s, d, "boxes").where("x1 < x2 AND y1 < y2").selectExpr("image_id", "det_seq", "x2 - x1 AS w", "y2 - y1 AS h")).select("image_id", "det_seq", "new_w", "new_h", "left", "top", "right", "bottom", "method")


@query
def img_quality_native(s, d):
    p = F.col("p")
    rows = view(s, d, "pixels").groupBy("crop_id").agg(F.avg(p).alias("brightness"), F.stddev_pop(p).alias("contrast"), F.avg((p >= 250).cast("double")).alias("highlight"), F.avg((p <= 5).cast("double")).alias("shadow"))
    return rounded(rows.withColumn("clip_limit", F.expr(k.adaptive_clip("brightness", "contrast"))), "brightness", "contrast", "highlight", "shadow", "clip_limit")


crops = lambda s, d: images.crops(view(s, d, "pixels"))
Q["agg_quadrant"] = lambda s, d: rounded(images.quadrant_spread(view(s, d, "pixels"), 8, 45.0), "spread")
Q["agg_border_center"] = lambda s, d: rounded(images.border_delta(view(s, d, "pixels"), 8), "delta")
Q["img_sharpness"] = lambda s, d: rounded(images.measure(crops(s, d)).select("crop_id", "sharpness"), "sharpness")
Q["img_quality"] = lambda s, d: rounded(images.measure(crops(s, d)), *images.METRICS)

# --- evaluation

Q["agg_eval"] = lambda s, d: rounded(evaluate.evaluate(records(s, d)), *SUMMARY)
Q["agg_eval_tag"] = lambda s, d: rounded(evaluate.evaluate_by_tag(records(s, d)), *SUMMARY)
Q["char_accuracy"] = lambda s, d: rounded(evaluate.scored(records(s, d)).select("fixture_id", F.col("chars").alias("accuracy")), "accuracy")
Q["calib_grid"] = lambda s, d: rounded(evaluate.calibrate(records(s, d), [0.2, 0.25, 0.3], [0.5, 0.55, 0.6], [0.7, 0.75, 0.8]), "score")

# --- tracks

Q["jn_track"] = lambda s, d: tracking.assign_tracks(reads(s, d))
Q["vote_consolidate"] = lambda s, d: rounded(voting.hybrid(tracking.assign_tracks(reads(s, d)).select("video_id", "track_id", F.col("frame_number").alias("seq"), "text", F.col("confidence").alias("conf")), ["video_id", "track_id"]), "confidence")

# --- sorts


@query
def srt_results(s, d):
    w = Window.partitionBy("video_id").orderBy(F.expr(k.is_plate(SPARK, "compact")).desc(), F.desc("confidence"), F.desc("quality"), F.desc("det_conf"), "event_id")
    return reads(s, d).select("video_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query
def best_ocr(s, d):
    best = F.max_by(F.struct("event_id", "confidence"), F.struct("confidence", -F.col("frame_number")))
    return reads(s, d).groupBy("video_id").agg(best.alias("b")).select("video_id", "b.*")


@query
def best_fragment(s, d):
    rank = F.when(F.expr(k.is_plate(SPARK, "compact")), 2).when(F.length("compact") == 7, 1).otherwise(0)
    best = F.max_by(F.struct("event_id", rank.alias("rank")), F.struct(rank, F.col("confidence"), -F.col("frame_number")))
    return reads(s, d).groupBy("video_id").agg(best.alias("b")).select("video_id", "b.*")


# --- JSON in


@query
def src_premium(s, d):
    from platewright.sources.payloads import plate_response

    part = lambda p, c: F.struct(p.alias("plate"), c.alias("score"))
    rows = view(s, d, "reads").select("event_id", F.to_json(F.struct(F.array(part(F.lower(F.col("true_plate")), F.col("confidence")), part(F.concat(F.substring("true_plate", 1, 3), F.lit("-"), F.lower(F.substring("true_plate", 4, 4))), F.col("det_conf"))).alias("results"))).alias("body"))
    return rounded(plate_response(rows, "body").select("event_id", "plate", "score", "accepted", "format"), "score")


@query
def json_llm_parse(s, d):
    from platewright.sources.payloads import decision

    body = F.to_json(F.struct(F.col("true_plate").alias("selected_plate"), F.expr("event_id % 2 = 0").alias("should_override"), F.col("confidence").alias("decision_confidence")))
    fenced = F.when(F.expr("event_id % 3 = 0"), F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.expr("event_id % 3 = 1"), F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(body)
    return decision(view(s, d, "reads").select("event_id", fenced.alias("body")), "body").select("event_id", F.col("selected_plate").alias("selected"), "decision_confidence", "should_override")


@query
def src_manifest(s, d):
    from platewright.sources.payloads import fixtures

    i = F.col("event_id")
    entry = F.struct(
        i.alias("notes"),
        F.when(i % 3 == 0, F.concat(F.lit("id"), i)).otherwise("").alias("id"),
        F.when(i % 3 == 1, F.concat(F.lit("fx"), i)).alias("fixture_id"),
        F.concat(F.lit("in/clip"), i, F.lit(".mp4")).alias("path"),
        F.when(i % 4 == 0, "video").alias("media_type"),
        F.concat(F.substring("true_plate", 1, 3), F.lit("-"), F.lower(F.substring("true_plate", 4, 4))).alias("expected_plate"),
    )
    bodies = view(s, d, "reads").groupBy("video_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(entry).alias("fixtures"))).alias("body"))
    return fixtures(bodies, "body").select(F.col("notes").cast("long").alias("event_id"), "fixture_id", F.col("expected_plate").alias("expected"), "media_type")


QUERIES = Q
ORACLE = {name: sql for name, (_, sql) in SHARED.items()} | BUILT

from platewright.plans import more  # noqa: E402  adds to Q, with what is above

ORACLE |= more.SQL
