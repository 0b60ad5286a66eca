"""Queries whose rules are expression texts that both engines read: select, filter and simple aggregates over one view."""

from __future__ import annotations

from platewright.functions import kernels as k
from platewright.functions.dialect import DUCK, SPARK
from platewright.functions.tables import KINDS
from platewright.plans.views import view, with_views

r6 = k.r6


def shared(source: str, columns: dict, where: str = "", group: str = "", pre: dict | None = None):
    """(query, sql). columns: name to expression or to a function of the dialect; pre: columns worked out once below them."""
    text = lambda x, q: x(q) if callable(x) else x

    def sql(q) -> str:
        chosen = ", ".join(f"{text(x, q)} AS {name}" for name, x in columns.items())
        below = "{source}" if not pre else "(SELECT *, " + ", ".join(f"{text(x, q)} AS {name}" for name, x in pre.items()) + " FROM {source}) p"
        return f"SELECT {chosen} FROM {below}" + (f" WHERE {text(where, q)}" if where else "") + (f" GROUP BY {group}" if group else "")

    def query(spark, sf_dir):
        view(spark, sf_dir, source).createOrReplaceTempView(f"_pw_view_{source}")
        return spark.sql(sql(SPARK).replace("{source}", f"_pw_view_{source}"))

    return query, with_views(sql(DUCK).replace("{source}", f"{source}"))


ID = {"event_id": "event_id"}
COMPACT = {"c": lambda q: k.compact(q, "plate_text")}
C = "upper(trim(plate_text))"

SHARED = {
    # text
    "clean_text": shared("texts", {"id": "id", "kind": "kind", "clean": lambda q: k.clean_text(q, "t")}),
    "normalize_plate": shared("texts", {"id": "id", "kind": "kind", "plate": lambda q: k.normalize_plate(q, "t")}),
    "normalize_ocr_text": shared("reads", ID | {"t": lambda q: k.normalize_ocr_text(q, "plate_text")}),
    "clean_plate_ocr": shared("reads", ID | {"t": lambda q: k.clean_plate_ocr(q, "plate_text || '-9'")}),
    "is_old_mercosul": shared("reads", ID | {"old": lambda q: k.is_old(q, C), "mercosul": lambda q: k.is_mercosul(q, C)}),
    "detect_format": shared("reads", ID | {"format": lambda q: k.detect_format(q, C)}),
    "format_plate": shared("reads", ID | {"plate": lambda q: k.format_plate(q, "plate_text")}),
    "prefix_plausibility": shared("reads", ID | {"score": k.prefix_plausibility(C)}),
    "format_fit": shared("reads", ID | {"old": lambda q: r6(k.format_fit(q, "c", KINDS["old"], False)), "mercosul": lambda q: r6(k.format_fit(q, "c", KINDS["mercosul"], True))}, pre=COMPACT),
    "format_aderence": shared("reads", ID | {"score": lambda q: k.format_aderence(q, "plate_text")}),
    "combine_conf": shared("reads", ID | {"score": lambda q: r6(k.clip01(f"0.7e0 * {k.clip01('confidence * 1.2e0')} + 0.3e0 * ({k.format_aderence(q, 'plate_text')})"))}),
    "cand_pattern": shared("reads", ID | {"score": lambda q: r6(k.pattern_score(q, "c"))}, pre=COMPACT),
    # bands and small rules
    "clip01": shared("reads", ID | {"x": r6(k.clip01("confidence * 2e0 - 0.5e0"))}),
    "quality_band": shared("reads", ID | {"band": k.quality_band("quality")}),
    "prj_conf_band_ui": shared("reads", ID | {"band": k.ui_band("confidence")}),
    "prj_conf_levels": shared("reads", ID | {"level": k.confidence_level("confidence")}),
    "prj_conf_band_report": shared("reads", ID | {"band": lambda q: k.report_band("confidence", k.is_plate(q, C))}),
    "prj_engine_label": shared("reads", ID | {"label": k.engine_label("CASE event_id % 5 WHEN 0 THEN 'paddle_v3' WHEN 1 THEN 'GLM-x' WHEN 2 THEN 'olmocr2' WHEN 3 THEN '' ELSE 'other' END")}),
    "adaptive_mode": shared("reads", ID | {"mode": k.adaptive_mode("quality", "snr", "motion"), "multi_bin": "NOT (quality >= 0.75e0 AND snr >= 9 AND motion <= 0.35e0)", "sharpen": "quality < 0.25e0 OR motion > 0.35e0", "denoise": "snr < 9"}),
    "prj_vram_profile": shared("reads", ID | {"label": "CASE WHEN snr * 2 <= 0 THEN 'CPU / ate 16GB' WHEN snr * 2 >= 32 THEN '32GB' WHEN snr * 2 >= 24 THEN '24GB' ELSE '16GB' END"}),
    "src_premium_health": shared("reads", ID | {"available": "event_id % 7 <> 0 AND event_id % 5 <> 0 AND length(plate_text || 'key') >= 10 AND CASE WHEN event_id % 3 = 0 THEN 401 ELSE 200 END <> 401"}),
    "flt_det_conf": shared("reads", ID | {"threshold": r6(k.detector_threshold("0.25e0", "quality * 200", "x1 * 5"))}),
    "context_profile": shared(
        "reads",
        ID
        | {
            "low_light": "quality * 200 <= 90 OR quality * 100 <= 40",
            "small_plate": "y2 - y1 <= 41",
            "low_snr": "snr <> 0 AND snr < 9",
            "motion_blur": "motion > 0.35e0",
            "low_quality": "quality < 0.45e0",
            "ocr_threshold": r6("CASE WHEN snr <> 0 AND snr < 9 THEN greatest(0.3e0, least(0.6e0, CASE WHEN quality * 200 <= 90 OR quality * 100 <= 40 THEN 0.5e0 ELSE 0.6e0 END, CASE WHEN y2 - y1 <= 41 THEN 0.55e0 ELSE 0.6e0 END) - 0.05e0) ELSE least(0.6e0, CASE WHEN quality * 200 <= 90 OR quality * 100 <= 40 THEN 0.5e0 ELSE 0.6e0 END, CASE WHEN y2 - y1 <= 41 THEN 0.55e0 ELSE 0.6e0 END) END"),
            "fallback_threshold": r6("CASE WHEN motion > 0.35e0 THEN greatest(0.55e0, least(0.8e0, CASE WHEN quality * 200 <= 90 OR quality * 100 <= 40 THEN 0.72e0 ELSE 0.8e0 END, CASE WHEN y2 - y1 <= 41 THEN 0.75e0 ELSE 0.8e0 END) - 0.05e0) ELSE least(0.8e0, CASE WHEN quality * 200 <= 90 OR quality * 100 <= 40 THEN 0.72e0 ELSE 0.8e0 END, CASE WHEN y2 - y1 <= 41 THEN 0.75e0 ELSE 0.8e0 END) END"),
            "variants": "CAST(CASE WHEN quality * 200 <= 90 OR quality * 100 <= 40 OR y2 - y1 <= 41 THEN 6 ELSE 5 END + CASE WHEN snr <> 0 AND snr < 9 THEN 1 ELSE 0 END + CASE WHEN motion > 0.35e0 THEN 1 ELSE 0 END AS BIGINT)",
        },
    ),
    "img_quality_fallback": shared("reads", ID | {"score": r6(k.clip01("0.3e0 * least(1e0, quality * 200 / 90e0) + 0.2e0 * least(1e0, quality * 100 / 40e0) + 0.3e0 * least(1e0, ms / 120e0) + 0.2e0 * least(1e0, greatest(40e0, y2 - y1) / 60e0)"))}),
    "img_quality_combine": shared("reads", ID | {"score": lambda q: r6(k.quality_score({"brightness": "(quality * 255)", "contrast": "(confidence * 80)", "sharpness": "ms", "snr": "snr", "motion": "motion", "edges": "(quality / 5)", "high": "(confidence / 5)", "low": "(quality / 9)"}))}),
    "img_forensics_combine": shared(
        "reads",
        ID
        | {
            "score": r6(k.forensic_score("quality", "confidence", "motion", "det_conf", "snr / 25")),
            "severity": f"CASE WHEN {k.forensic_score('quality', 'confidence', 'motion', 'det_conf', 'snr / 25')} >= 0.75e0 THEN 'high' WHEN {k.forensic_score('quality', 'confidence', 'motion', 'det_conf', 'snr / 25')} >= 0.55e0 THEN 'review' ELSE 'low' END",
            "n_signals": "CAST(CASE WHEN quality >= 0.55e0 THEN 1 ELSE 0 END + CASE WHEN confidence >= 0.55e0 THEN 1 ELSE 0 END + CASE WHEN motion >= 0.55e0 THEN 1 ELSE 0 END + CASE WHEN det_conf >= 0.55e0 THEN 1 ELSE 0 END + CASE WHEN snr / 25 >= 0.55e0 THEN 1 ELSE 0 END AS BIGINT)",
        },
    ),
    "img_annotate": shared("reads", ID | {"colour": "CASE WHEN confidence >= 0.8e0 THEN 'green' WHEN confidence >= 0.6e0 THEN 'yellow' ELSE 'red' END", "label": lambda q: f"{k.compact(q, 'plate_text')} || ' (' || CAST(CAST(floor(confidence * 100 + 0.5e0) AS BIGINT) AS STRING) || '%)'"}),
    "img_preprocess": shared("reads", ID | {"variants": "CAST(5 + CASE WHEN motion > 0.35e0 THEN 1 ELSE 0 END + CASE WHEN quality >= 0.75e0 AND snr >= 9 AND motion <= 0.35e0 THEN 0 ELSE 8 END AS BIGINT)"}),
    "img_warp_guard": shared("boxes", {"image_id": "image_id", "det_seq": "det_seq", "ok": "y2 > y1 AND CAST(x2 - x1 AS DOUBLE) / greatest(1, y2 - y1) BETWEEN 0.5e0 * 1.2e0 AND 1.5e0 * 5.0e0"}),
    "iso_ts": shared("videos", {"video_id": "video_id", "stem": "substr(path, 4, length(path) - 7)"}),
    "adaptive_clip": shared("reads", ID | {"clip": k.adaptive_clip("(quality * 200)", "(confidence * 80)")}),
    "agg_quality_score": shared("reads", ID | {"score": r6("greatest(confidence, quality, 0.5e0 * confidence + 0.5e0 * det_conf)")}),
    "ui_tables": shared("reads", ID | {"plate": lambda q: k.format_plate(q, "plate_text"), "share": "CAST(CAST(floor(confidence * 100 + 0.5e0) AS BIGINT) AS STRING) || '%'", "state": lambda q: f"CASE WHEN {k.is_plate(q, 'c')} THEN 'valid' ELSE 'review' END", "ms": "CAST(ms AS BIGINT)"}, pre=COMPACT),
    "engine_status": shared("reads", {"engine": "'paddle'", "reads": "CAST(count(*) AS BIGINT)", "mean_confidence": r6("avg(confidence)"), "enabled": "true"}),
    # filters
    "flt_bbox": shared("boxes", {"image_id": "image_id", "det_seq": "det_seq", "x1": "x1", "y1": "y1", "x2": "x2", "y2": "y2"}, where="x1 < x2 AND y1 < y2 AND x1 >= 0 AND y1 >= 0"),
    "flt_conf_frame": shared("reads", ID | {"confidence": "confidence"}, where="confidence >= 0.6e0"),
    "flt_sample": shared("reads", ID | {"frame_number": "frame_number"}, where="(frame_number - 1) % 2 = 0"),
    "flt_sharp": shared("reads", ID | {"ms": "ms"}, where="ms >= 50"),
    "flt_short_text": shared("reads", ID, where=lambda q: f"length({k.compact(q, 'plate_text')}) >= 7"),
    "flt_empty_plate": shared("texts", {"id": "id", "kind": "kind", "n": lambda q: f"CAST(length({k.normalize_plate(q, 't')}) AS BIGINT)"}, where=lambda q: f"{k.normalize_plate(q, 't')} <> ''"),
    "gate_fallback": shared("reads", ID, where=lambda q: f"NOT {k.is_plate(q, C)} OR confidence < 0.8e0"),
    # videos
    "src_video_ext": shared("videos", {"video_id": "video_id", "suffix": lambda q: k.suffix_of(q, "path"), "supported": lambda q: k.is_video(q, "path")}),
    "src_video_meta": shared(
        "videos",
        {
            "video_id": "video_id",
            "codec": f"trim({k.fourcc('code')})",
            "duration": r6("CASE WHEN fps > 0 THEN total_frames / fps ELSE 0e0 END"),
            "resolution": "CAST(width AS STRING) || 'x' || CAST(height AS STRING)",
            "size_mb": r6("bytes / 1048576e0"),
            "frames_to_process": "CAST(least(floor(CAST(total_frames AS DOUBLE) / skip), 3000) AS BIGINT)",
        },
    ),
    "fmt_duration": shared("videos", {"video_id": "video_id", "t": k.duration("(total_frames * 3 - 500)")}),
    "snk_video": shared("videos", {"video_id": "video_id", "out": lambda q: f"substr(path, 4, length(path) - 7) || '_alpr_20000101_000000' || CASE WHEN {k.is_video(q, 'path')} THEN {k.suffix_of(q, 'path')} ELSE '.mp4' END"}),
    # one-pass aggregates
    "agg_video_totals": shared("reads", {"video_id": "video_id", "processed": "CAST(sum(CASE WHEN (frame_number - 1) % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT)", "skipped": "CAST(sum(CASE WHEN (frame_number - 1) % 2 = 0 THEN 0 ELSE 1 END) AS BIGINT)", "avg_ms": r6("avg(CASE WHEN (frame_number - 1) % 2 = 0 THEN ms END)"), "fps": r6("CASE WHEN sum(ms) > 0 THEN count(*) * 1000e0 / sum(ms) ELSE 0e0 END")}, group="video_id"),
    "vote_status": shared("reads", {"video_id": "video_id", "tracks": "CAST(count(DISTINCT vehicle) AS BIGINT)", "observations": "CAST(count(*) AS BIGINT)"}, group="video_id"),
    "calib_score": shared("records", {"tag": "tag", "score": r6(k.calib_score("avg(CASE WHEN expected = predicted THEN 1e0 ELSE 0e0 END)", "avg(confidence)", "avg(det_conf)", "avg(ms)"))}, group="tag"),
}
