"""Scalar rules as SQL expression texts: q is the dialect, the other arguments are expressions."""

from __future__ import annotations

from platewright.functions.dialect import num
from platewright.functions.tables import MERCOSUL, OLD, OLD_LOOSE, VALIDATOR_RANGES, VIDEO_SUFFIXES, VOWELS, merged

# --- text ---------------------------------------------------------------------------------------


def clean_text(q, x):
    return q.strip(q.upper(f"trim(coalesce({x}, ''))"), "[^A-Z0-9-]")


def compact(q, x):
    """Cleaned, without hyphens."""
    return f"replace({clean_text(q, x)}, '-', '')"


def normalize_plate(q, x):
    return q.strip(q.upper(f"coalesce({x}, '')"), r"[^\p{L}\p{N}]")


def normalize_ocr_text(q, x):
    return f"replace(replace({q.upper(f"trim(coalesce({x}, ''))")}, ' ', ''), '-', '')"


def clean_plate_ocr(q, x):
    kept = q.strip(q.upper(f"coalesce({x}, '')"), "[^A-Z0-9]")
    found = q.extract(kept, "[A-Z]{3}[0-9][A-Z0-9][0-9]{2}")
    return f"CASE WHEN length({kept}) <= 7 THEN {kept} WHEN {found} <> '' THEN {found} ELSE substr({kept}, 1, 7) END"


def is_old(q, x):
    return q.matches(x, OLD_LOOSE)


def is_mercosul(q, x):
    return q.matches(x, MERCOSUL)


def vowel_fifth(x):
    return f"(substr({x}, 5, 1) IN ({', '.join(repr(v) for v in VOWELS)}))"


def is_plate(q, x):
    """Either format, vowels allowed."""
    return f"({q.matches(x, OLD)} OR {q.matches(x, MERCOSUL)})"


def detect_format(q, x):
    return f"CASE WHEN {is_mercosul(q, x)} THEN 'mercosul' WHEN {is_old(q, x)} THEN 'old' ELSE 'unknown' END"


def format_plate(q, x):
    c = compact(q, x)
    return f"CASE WHEN {q.matches(c, OLD)} THEN substr({c}, 1, 3) || '-' || substr({c}, 4) WHEN {is_mercosul(q, c)} THEN {c} ELSE {x} END"


def prefix_plausibility(x):
    ranges = " OR ".join(f"substr({x}, 1, 3) BETWEEN '{a}' AND '{b}'" for a, b in merged(VALIDATOR_RANGES))
    return f"CASE WHEN length({x}) < 3 THEN 0.5e0 WHEN {ranges} THEN 1e0 ELSE 0.7e0 END"


def kind_matches(q, x, kind):
    """How many of the first seven characters are of the format's kind."""
    return " + ".join(f"CASE WHEN {q.matches(f'substr({x}, {k + 1}, 1)', '[A-Z]' if t == 'L' else '[0-9]')} THEN 1 ELSE 0 END" for k, t in enumerate(kind))


def format_fit(q, x, kind, mercosul):
    score = f"(({kind_matches(q, x, kind)}) / 7e0)"
    return f"CASE WHEN {vowel_fifth(x)} THEN {score} * 0.75e0 ELSE {score} END" if mercosul else score


def format_aderence(q, x):
    c = normalize_ocr_text(q, x)
    return f"CASE WHEN {c} = '' THEN 0e0 WHEN {is_mercosul(q, c)} THEN 0.88e0 WHEN {q.matches(c, OLD)} THEN 0.85e0 WHEN length({c}) = 7 THEN 0.55e0 WHEN length({c}) IN (6, 8) THEN 0.35e0 ELSE 0.2e0 END"


def text_similarity(a, b):
    """Equal characters by position, over the longer length; by seven places and more via the callers' arrays."""
    same = " + ".join(f"CASE WHEN substr({a}, {k}, 1) = substr({b}, {k}, 1) AND substr({a}, {k}, 1) <> '' THEN 1 ELSE 0 END" for k in range(1, 9))
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0e0 ELSE ({same}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


# --- numbers --------------------------------------------------------------------------------------


def clip01(x):
    return f"greatest(0e0, least(1e0, {x}))"


def band(x, steps, otherwise):
    """The label of the first step that x reaches."""
    return "CASE " + " ".join(f"WHEN {x} >= {num(least)} THEN '{label}'" for least, label in steps) + f" ELSE '{otherwise}' END"


def quality_band(x):
    return band(x, [(0.80, "excellent"), (0.65, "good"), (0.45, "review")], "critical")


def ui_band(x):
    return band(x, [(0.85, "green"), (0.65, "yellow"), (0.45, "orange")], "red")


def confidence_level(x):
    return band(x, [(0.80, "alta"), (0.60, "media"), (0.40, "baixa")], "insuficiente")


def report_band(conf, valid):
    return f"CASE WHEN {conf} >= 0.85e0 AND {valid} THEN 'high' WHEN {conf} >= 0.65e0 THEN 'medium' ELSE 'review' END"


def iou(a, b, floor_area=False):
    """IoU of boxes with columns {a}x1 ...; floor_area: areas of at least 1, as the video path has it."""
    w = f"(least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"(least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    area = lambda p: f"(({p}x2 - {p}x1) * ({p}y2 - {p}y1))"
    one, two = (f"greatest(1, {area(a)})", f"greatest(1, {area(b)})") if floor_area else (area(a), area(b))
    union = f"({one} + {two} - {w} * {h})"
    return f"CASE WHEN {w} <= 0 OR {h} <= 0 OR {union} <= 0 THEN 0e0 ELSE CAST({w} * {h} AS DOUBLE) / CAST({union} AS DOUBLE) END"


def adaptive_clip(mean, std):
    base = f"CASE WHEN {mean} < 80 THEN 3.5e0 WHEN {mean} < 120 THEN 2.5e0 ELSE 1.5e0 END"
    return f"CASE WHEN {std} > 60 THEN greatest(1e0, {base} - 0.5e0) WHEN {std} < 30 THEN least(4e0, {base} + 0.5e0) ELSE {base} END"


def adaptive_mode(quality, snr, motion):
    base = band(quality, [(0.75, "excelente"), (0.50, "suficiente"), (0.25, "critica")], "insuficiente")
    return f"{base} || CASE WHEN {snr} < 9 THEN '_low_snr' ELSE '' END || CASE WHEN {motion} > 0.35e0 THEN '_motion' ELSE '' END"


def detector_threshold(base, gray, side, low_light=90, large=1600, tiles=True):
    first = f"CASE WHEN {gray} < {low_light} THEN greatest(0.05e0, {base} - 0.05e0) ELSE {base} END"
    return f"CASE WHEN {'true' if tiles else 'false'} AND {side} >= {large} THEN greatest(0.05e0, ({first}) - 0.03e0) ELSE {first} END"


def duration(seconds):
    """MM:SS, or HH:MM:SS from an hour up; negative: 00:00. seconds: a whole number."""
    two = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    whole = f"CAST(floor({seconds}) AS BIGINT)"
    h, m, s = f"CAST(floor({whole} / 3600) AS BIGINT)", f"CAST(floor(({whole} % 3600) / 60) AS BIGINT)", f"({whole} % 60)"
    return f"CASE WHEN {seconds} < 0 THEN '00:00' WHEN {h} > 0 THEN {two(h)} || ':' || {two(m)} || ':' || {two(s)} ELSE {two(m)} || ':' || {two(s)} END"


def fourcc(code):
    return " || ".join(f"chr(CAST((({code} >> {8 * k}) & 255) AS INT))" for k in range(4))


def calib_score(exact, chars, fp, ms):
    return f"0.55e0 * {exact} + 0.20e0 * {chars} + 0.15e0 * (1e0 - {fp}) + 0.10e0 * (1e0 - least({ms}, 1500e0) / 1500e0)"


def suffix_of(q, path):
    return f"lower({q.extract(path, '([.][^./]+)$', 1)})"


def is_video(q, path):
    return f"({suffix_of(q, path)} IN ({', '.join(repr(s) for s in VIDEO_SUFFIXES)}))"


def engine_label(x):
    return f"CASE WHEN lower(coalesce({x}, '')) LIKE 'paddle%' THEN 'PaddleOCR' WHEN lower(coalesce({x}, '')) LIKE 'glm%' THEN 'GLM OCR' WHEN lower(coalesce({x}, '')) LIKE 'olmocr%' THEN 'OLMoOCR2' WHEN coalesce({x}, '') = '' THEN '-' ELSE {x} END"


def r6(x):
    """Six decimals, by the same arithmetic in both engines; a hair above a half, so that sums in another order don't fall to either side of it."""
    return f"(floor(({x}) * 1e6 + 0.5001e0) / 1e6)"


def pattern_score(q, x):
    """How much a normalised candidate looks like a plate."""
    return f"CASE WHEN {x} = '' THEN 0e0 ELSE least(1e0, 0.2e0 + CASE WHEN length({x}) = 7 THEN 0.15e0 ELSE 0e0 END + CASE WHEN {is_plate(q, x)} THEN 0.35e0 ELSE 0e0 END + 0.2e0 * ({prefix_plausibility(x)}) + CASE WHEN {is_mercosul(q, x)} AND NOT {vowel_fifth(x)} THEN 0.1e0 ELSE 0e0 END) END"


def quality_score(c):
    """c: column expressions by name."""
    return (
        f"0.18e0 * (1e0 - {clip01(f'abs({c['brightness']} - 145e0) / 145e0')}) + 0.16e0 * {clip01(f'{c['contrast']} / 55e0')}"
        f" + 0.2e0 * CASE WHEN {c['sharpness']} > 0 THEN {clip01(f'ln(1e0 + {c['sharpness']}) / 5.5e0')} ELSE 0e0 END + 0.16e0 * {clip01(f'({c['snr']} - 6e0) / 16e0')}"
        f" + 0.12e0 * (1e0 - {clip01(f'{c['motion']} / 0.55e0')}) + 0.1e0 * {clip01(f'{c['edges']} / 0.18e0')} + 0.08e0 * (1e0 - {clip01(f'({c['high']} + {c['low']}) / 0.3e0')})"
    )


def forensic_score(ela, illumination, noise, edge, border):
    return f"0.3e0 * {ela} + 0.2e0 * {illumination} + 0.2e0 * {noise} + 0.15e0 * {edge} + 0.15e0 * {border}"
