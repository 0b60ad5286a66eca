"""Settings: defaults, a recursive merge over them, limits on values, and a key that tells when services must be rebuilt."""

from __future__ import annotations

import copy
import json
from pathlib import Path

# --- fixed values -------------------------------------------------------------------------------
DEFAULTS = {
    "models": {"detector": {"confidence": 0.25, "default": "yolo11l-plate.pt", "device": "auto", "dir": "models/yolo", "enable_sahi": True, "sahi_slice_size": 640, "sahi_overlap_ratio": 0.25, "sahi_retry_confidence_threshold": 0.55, "sahi_retry_area_ratio_threshold": 0.01, "sahi_retry_large_image_threshold": 1600, "sahi_merge_iou_threshold": 0.45}},
    "ocr": {"engine": "paddle", "try_multiple_variants": True, "max_variants": 5, "top_k_candidates": 5, "paddle": {"lang": "pt", "use_gpu": True, "use_angle_cls": True, "det_limit_side_len": 960, "rec_batch_num": 6, "min_score": 0.3}},
    "premium_api": {"enabled": False, "provider": "platerecognizer", "api_key": "", "regions": ["br"], "min_confidence": 0.5, "timeout": 30, "log_all_calls": True},
    "pipeline": {"crop_margin": 0.10, "ocr_confidence_threshold": 0.6, "fallback_confidence_threshold": 0.8},
    "temporal_voting": {"enabled": True, "strategy": "hybrid", "min_observations": 2},
    "video": {"vehicle_mode": "moving", "skip_frames": 2, "max_frames": 0, "generate_output_video": True, "output_dir": "data/results", "confidence_threshold": 0.6},
    "artifacts": {"enabled": True, "output_dir": "data/results/artifacts", "save_invalid": True, "save_low_confidence": True, "confidence_threshold": 0.75, "max_saved_per_run": 50},
    "scenarios": {
        "low_light": {"brightness_threshold": 90.0, "contrast_threshold": 40.0, "ocr_confidence_threshold": 0.50, "fallback_confidence_threshold": 0.72, "max_variants": 6},
        "small_plate": {"area_ratio_threshold": 0.015, "height_threshold": 60, "ocr_confidence_threshold": 0.55, "fallback_confidence_threshold": 0.75, "max_variants": 6},
        "video": {"moving": {"skip_frames": 2, "temporal_min_observations": 2}, "stationary": {"skip_frames": 5, "temporal_min_observations": 3}},
    },
    "evaluation": {"fixtures_dir": "data/fixtures", "manifest_path": "data/fixtures/manifest.template.json", "reports_dir": "data/results/evaluation"},
    "calibration": {"detector_thresholds": [0.20, 0.25, 0.30], "ocr_thresholds": [0.55, 0.60, 0.65], "fallback_thresholds": [0.70, 0.80, 0.90]},
    "quality": {"enabled": True, "low_quality_threshold": 0.45, "snr_review_threshold": 9.0, "motion_blur_review_threshold": 0.35},
    "forensic": {"enabled": True, "jpeg_quality": 90, "review_threshold": 0.55, "high_risk_threshold": 0.75},
    "reports": {"enabled": True, "output_dir": "data/results/reports", "prefer_artifact_dir": True},
    "llm_validation": {"enabled": False, "base_url": "http://127.0.0.1:11434", "model": "", "timeout": 20.0, "allow_override": True, "ambiguity_gap_threshold": 0.12, "min_decision_confidence": 0.70},
}
#: path: (least, most)
LIMITS = {
    ("models", "detector", "sahi_retry_large_image_threshold"): (256, None),
    ("ocr", "max_variants"): (1, None),
    ("ocr", "top_k_candidates"): (1, None),
    ("video", "skip_frames"): (1, None),
    ("video", "max_frames"): (0, None),
    ("temporal_voting", "min_observations"): (1, None),
    ("forensic", "jpeg_quality"): (50, 100),
}
# --------------------------------------------------------------------------------------------------


def merged(base: dict, over: dict | None) -> dict:
    out = copy.deepcopy(base)
    for key, value in (over or {}).items():
        out[key] = merged(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else copy.deepcopy(value)
    return out


def load(path: str | Path) -> dict:
    """The file's settings (JSON or YAML) over the defaults; the defaults alone if it can't be read. Without an installed YAML reader a YAML file is an ImportError."""
    try:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith(".json"):
            found = json.loads(text)
        else:
            import yaml

            found = yaml.safe_load(text)
    except (OSError, ValueError):
        return settings({})
    except Exception as e:  # noqa: BLE001  a YAML reader's own error type
        if "yaml" not in type(e).__module__:
            raise
        return settings({})
    return settings(found if isinstance(found, dict) else {})


def settings(raw: dict) -> dict:
    """Full settings: defaults under raw, the one supported engine, frames and observations from the vehicle mode where unset, and limits."""
    out = merged(DEFAULTS, raw)
    out["ocr"]["engine"] = "paddle"
    mode = str(out["video"]["vehicle_mode"]).lower()
    out["video"]["vehicle_mode"] = mode = mode if mode == "stationary" else "moving"
    scenario = out["scenarios"]["video"][mode]
    for section, key, default in (("video", "skip_frames", "skip_frames"), ("temporal_voting", "min_observations", "temporal_min_observations")):
        given = (raw.get(section) or {}).get(key, scenario[default])
        out[section][key] = given or scenario[default]
    for path, (least, most) in LIMITS.items():
        at = out
        for key in path[:-1]:
            at = at[key]
        value = int(at[path[-1]])
        at[path[-1]] = max(least, value if most is None else min(most, value))
    return out


def signature(found: dict) -> tuple:
    """A key of all settings, numbers rounded to six decimals, in a fixed order."""

    def flat(x, path=()):
        if isinstance(x, dict):
            for key in sorted(x):
                yield from flat(x[key], (*path, key))
        else:
            yield path, tuple(x) if isinstance(x, list) else round(x, 6) if isinstance(x, float) else x

    return tuple(flat(found))
