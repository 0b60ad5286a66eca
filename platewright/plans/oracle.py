"""DuckDB SQL for the operators that are written with the DataFrame API: the same results by plain relational means."""

from __future__ import annotations

from platewright.functions import kernels as k
from platewright.functions.dialect import DUCK as D
from platewright.functions.dialect import num
from platewright.functions.tables import LETTERS, NEED, NGRAM_RANGES, SIMILAR, ordered, weight
from platewright.plans.views import with_views

r6 = k.r6


def values(name: str, columns: str, rows) -> str:
    def lit(x):
        return "'" + x + "'" if isinstance(x, str) else num(x) if isinstance(x, float) else str(x)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(lit(x) for x in r) + ')' for r in rows)})"


NEED_SQL = values("need", "kind, ch, r, w", [(kind, c, r, w) for kind, table in NEED.items() for c, (r, w) in table.items()])
PLACES = values("place", "fmt, pos, kind", [(f, i + 1, n) for f, kinds in (("old", "LLLNNNN"), ("mercosul", "LLLNCNN")) for i, n in enumerate(kinds)])
SLOTS = values("slot", "fmt, pos, kind", [(f, i, n) for f, kinds in ((0, "LLLNNNN"), (1, "LLLNLNN")) for i, n in enumerate(kinds)])
SIMILAR_SQL = values("similar_to", "ch, alike, rank, w", [(c, o, n, weight(c, o)) for c, others in SIMILAR.items() for n, o in enumerate(others)])

_MATCHES = lambda kind: k.kind_matches(D, "c", kind)
_BASE = f"CASE WHEN regexp_matches(c, '^[A-Z]{{3}}[0-9]{{4}}$') THEN 1e0 WHEN regexp_matches(c, '^[A-Z]{{3}}[0-9][A-Z][0-9]{{2}}$') THEN CASE WHEN {k.vowel_fifth('c')} THEN 0.8e0 ELSE 1e0 END ELSE greatest({_MATCHES('LLLNNNN')}, {_MATCHES('LLLNLNN')}) / 7e0 * 0.7e0 END"
#: c7: s (compact text), c (candidate of seven), place (best first, up to 5).
CANDIDATES = f"""
s6 AS (SELECT DISTINCT s FROM src WHERE length(s) BETWEEN 6 AND 8),
options AS (
  SELECT s, 0 AS seq, s AS c FROM s6 WHERE length(s) = 7
  UNION ALL SELECT s, i, substr(s, 1, i) || substr(s, i + 2) FROM s6, (SELECT unnest(range(0, 8)) AS i) x WHERE length(s) = 8
  UNION ALL SELECT s, fmt * 7 + pos, substr(s, 1, pos) || CASE
      WHEN pos > 0 AND regexp_matches(substr(s, pos, 1), CASE kind WHEN 'L' THEN '[A-Z]' ELSE '[0-9]' END) THEN substr(s, pos, 1)
      WHEN regexp_matches(substr(s, pos + 1, 1), CASE kind WHEN 'L' THEN '[A-Z]' ELSE '[0-9]' END) THEN substr(s, pos + 1, 1)
      WHEN kind = 'L' THEN 'A' END || substr(s, pos + 1) FROM s6, slot WHERE length(s) = 6),
scored AS (SELECT s, seq, c, ({_BASE}) * 0.8e0 + ({k.prefix_plausibility('c')}) * 0.2e0 AS score FROM options WHERE c IS NOT NULL),
ranked AS (SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY score DESC, seq) AS rn FROM scored),
firsts AS (SELECT s, c, min(rn) AS rn FROM ranked GROUP BY s, c),
c7 AS (SELECT s, c, place FROM (SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY rn) AS place FROM firsts) x WHERE place <= 5)"""
#: fixed: s, p (the corrected and formatted plate); one row for each text that can be put right.
CORRECTIONS = f"""{CANDIDATES},
put AS (SELECT s, c7.c, c7.place AS pl, place.fmt, string_agg(r, '' ORDER BY place.pos) AS t, exp(sum(ln(w))) AS w FROM c7, place JOIN need ON need.kind = place.kind WHERE need.ch = substr(c7.c, place.pos, 1) GROUP BY ALL HAVING count(*) = 7),
both_ways AS (SELECT s, pl, max(CASE WHEN fmt = 'old' THEN t END) AS o, max(CASE WHEN fmt = 'mercosul' THEN t END) AS m,
  max(CASE WHEN fmt = 'old' THEN w * (0.7e0 + 0.3e0 * ({k.prefix_plausibility('t')})) END) AS ow, max(CASE WHEN fmt = 'mercosul' THEN w * 1.15e0 * (0.7e0 + 0.3e0 * ({k.prefix_plausibility('t')})) END) AS mw FROM put GROUP BY s, pl),
fixed AS (SELECT s, p FROM (SELECT s, CASE WHEN m IS NOT NULL AND (o IS NULL OR mw >= ow - 1e-12) THEN m ELSE substr(o, 1, 3) || '-' || substr(o, 4) END AS p, row_number() OVER (PARTITION BY s ORDER BY pl) AS rn FROM both_ways) x WHERE rn = 1)"""
VALID = f"""CASE WHEN {k.is_mercosul(D, 's')} AND NOT {k.vowel_fifth('s')} THEN s WHEN regexp_matches(s, '^[A-Z]{{3}}[0-9]{{4}}$') THEN substr(s, 1, 3) || '-' || substr(s, 4) ELSE p END"""
SRC = f"src AS (SELECT *, {k.compact(D, 'plate_text')} AS s FROM reads)"

PREFIXES = f"""{values('ranges', 'seq, state, low, high', ordered(NGRAM_RANGES))},
letters AS (SELECT unnest(string_split('{','.join(LETTERS)}', ',')) AS l),
prefixes AS (SELECT prefix, arg_max(state, seq) AS state FROM (SELECT a.l || b.l || c.l AS prefix FROM letters a, letters b, letters c) x JOIN ranges ON prefix BETWEEN low AND high GROUP BY prefix),
single AS (SELECT pos, l AS ch, (count(prefix) + 1) / ((SELECT count(*) FROM prefixes) + 26e0) AS p FROM (SELECT unnest([0, 1, 2]) AS pos) q CROSS JOIN letters LEFT JOIN prefixes ON substr(prefix, pos + 1, 1) = l GROUP BY pos, l),
pair AS (SELECT pos, a.l AS prev, b.l AS ch, (count(prefix) + 1) / ((SELECT count(*) FROM prefixes WHERE substr(prefix, pos, 1) = a.l) + 26e0) AS p FROM (SELECT unnest([1, 2]) AS pos) q, letters a, letters b LEFT JOIN prefixes ON substr(prefix, pos, 1) = a.l AND substr(prefix, pos + 1, 1) = b.l GROUP BY pos, a.l, b.l)"""
_P = lambda i: f"ln(coalesce((SELECT p FROM single WHERE pos = {i} AND ch = substr(t, {i + 1}, 1)), 1e-6) + 1e-10)"
_PP = lambda i: f"ln(coalesce((SELECT p FROM pair WHERE pos = {i} AND prev = substr(t, {i}, 1) AND ch = substr(t, {i + 1}, 1)), 1e-6) + 1e-10)"
_DD = lambda i: f"ln(CASE WHEN regexp_matches(substr(t, {i + 1}, 1), '[0-9]') THEN 0.1e0 ELSE 1e-6 END + 1e-10)"
_D4 = "ln(CASE WHEN regexp_matches(substr(t, 5, 1), '[0-9]') THEN 0.04e0 WHEN regexp_matches(substr(t, 5, 1), '[AEIOU]') THEN 0.001e0 WHEN regexp_matches(substr(t, 5, 1), '[A-Z]') THEN 0.6e0 / 21 ELSE 1e-6 END + 1e-10)"
NGRAM = f"""{PREFIXES},
dt AS (SELECT DISTINCT t FROM texts_in WHERE length(t) = 7),
raw_score AS (SELECT t, greatest(0e0, least(1e0, ({' + '.join([_P(0), _P(1), _P(2), _DD(3), _D4, _DD(5), _DD(6), _PP(1), _PP(2)])} + 50e0) / 47e0)) AS b, (SELECT state FROM prefixes WHERE prefix = substr(t, 1, 3)) AS state FROM dt),
with_prefix AS (SELECT t, state, CASE WHEN state IS NOT NULL THEN least(1e0, b + 0.15e0) ELSE b END AS b FROM raw_score),
ngrams AS (SELECT t, state, CASE WHEN regexp_matches(t, '^[A-Z]{{3}}[0-9]{{4}}$') THEN least(1e0, b + 0.05e0) WHEN {k.is_mercosul(D, 't')} AND NOT {k.vowel_fifth('t')} THEN least(1e0, b + 0.07e0) WHEN {k.is_mercosul(D, 't')} THEN b - 0.05e0 ELSE b END AS ngram FROM with_prefix)"""

TRACKS = f"obs AS (SELECT video_id, vehicle, frame_number AS seq, {k.compact(D, 'plate_text')} AS text, confidence AS conf FROM reads)"
INDIVIDUAL = "ind AS (SELECT video_id, vehicle, arg_max(text, conf * 1e6 - seq * 1e-3) AS best_text, max(conf) AS best_conf, count(*) AS observations, min(seq) AS first_frame, max(seq) AS last_frame FROM obs GROUP BY 1, 2)"
MAJOR = "tx AS (SELECT video_id, vehicle, text, count(*) AS n, max(conf) AS c, min(seq) AS f FROM obs WHERE length(text) = 7 GROUP BY 1, 2, 3), maj AS (SELECT video_id, vehicle, text AS major_text, n / total AS share, (n / total + c) / 2 AS major_conf FROM (SELECT *, row_number() OVER (PARTITION BY video_id, vehicle ORDER BY n DESC, f) AS rn, CAST(sum(n) OVER (PARTITION BY video_id, vehicle) AS DOUBLE) AS total FROM tx) x WHERE rn = 1)"
VOTED = f"""{SIMILAR_SQL},
o7 AS (SELECT *, pos, substr(text, pos, 1) AS ch FROM obs, (SELECT unnest(range(1, 8)) AS pos) p WHERE length(text) = 7),
cast_votes AS (SELECT video_id, vehicle, pos, alike AS c, conf * 0.3e0 AS w, seq, rank FROM o7 JOIN similar_to ON o7.ch = similar_to.ch UNION ALL SELECT video_id, vehicle, pos, ch, conf, seq, 99 FROM o7),
tally AS (SELECT video_id, vehicle, pos, c, sum(w) AS w, min(seq * 100 + rank) AS f FROM cast_votes GROUP BY 1, 2, 3, 4),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, vehicle, pos ORDER BY round(w, 9) DESC, f) AS rn FROM tally) x WHERE rn = 1),
pos7 AS (SELECT video_id, vehicle, string_agg(c, '' ORDER BY pos) AS voted_text, sum(least(1e0, w / n7)) / 7 AS voted_conf FROM won JOIN (SELECT video_id, vehicle, count(*) AS n7 FROM obs WHERE length(text) = 7 GROUP BY 1, 2) q USING (video_id, vehicle) GROUP BY 1, 2)"""
HYBRID = f"""res AS (SELECT i.*, CASE WHEN observations < 2 THEN 'best' WHEN share > 0.5e0 AND {k.is_plate(D, 'major_text')} THEN 'majority' WHEN {k.is_plate(D, 'voted_text')} THEN 'positional' ELSE 'best' END AS how, major_text, major_conf, voted_text, voted_conf
 FROM ind i LEFT JOIN maj USING (video_id, vehicle) LEFT JOIN pos7 USING (video_id, vehicle))"""

PLATES = f"""
rq AS (SELECT *, {k.normalize_plate(D, 'plate_text')} AS plate, confidence AS char_conf, greatest(confidence, quality) AS read_quality FROM reads),
up AS (SELECT video_id, plate, count(*) AS total_detections, min(frame_number) AS first_seen_frame, max(frame_number) AS last_seen_frame, min(timestamp_ms) AS first_seen_time, max(timestamp_ms) AS last_seen_time, max(confidence) AS best_confidence,
  arg_max(plate_text, confidence * 1e6 - frame_number * 1e-3) AS plate_text, avg(confidence) AS avg_confidence, avg(read_quality) AS avg_quality, max(read_quality) AS best_quality, arg_max(frame_number, read_quality * 1e6 + frame_number * 1e-3) AS best_frame_number, avg(char_conf) AS char_confirmation
  FROM rq WHERE plate <> '' GROUP BY 1, 2),
ups AS (SELECT *, greatest(1, last_seen_frame - first_seen_frame + 1) AS span_frames, total_detections AS temporal_observations FROM up),
cmp AS (SELECT *, 0.22e0 * total_detections / max(total_detections) OVER (PARTITION BY video_id) + 0.2e0 * best_confidence + 0.13e0 * avg_confidence + 0.15e0 * avg_quality + 0.15e0 * char_confirmation + 0.1e0 * span_frames / max(span_frames) OVER (PARTITION BY video_id) + 0.05e0 * least(1e0, temporal_observations / 5e0) AS composite FROM ups),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(composite, 9) DESC, first_seen_frame, plate) AS place FROM cmp) x WHERE place <= 10)"""

_SAME = "len([i FOR i IN range(1, 9) IF substr(expected, i, 1) = substr(predicted, i, 1) AND substr(expected, i, 1) <> ''])"
EVAL = f"ev AS (SELECT *, CASE WHEN expected <> '' AND expected = predicted THEN 1e0 ELSE 0e0 END AS exact, CASE WHEN expected = '' AND predicted = '' THEN 1e0 ELSE {_SAME} / CAST(greatest(length(expected), length(predicted)) AS DOUBLE) END AS chars, CASE WHEN expected = '' AND predicted <> '' THEN 1e0 ELSE 0e0 END AS wrong FROM records)"
_SUM = f"count(*) AS n, {r6('avg(exact)')} AS exact_rate, {r6('avg(chars)')} AS char_accuracy, {r6('avg(wrong)')} AS false_positive_rate, {r6('avg(confidence)')} AS avg_confidence, {r6('avg(det_conf)')} AS avg_detection, {r6('avg(ms)')} AS avg_ms"


def w(*ctes: str, select: str) -> str:
    return with_views("WITH " + ", ".join(c.strip() for c in ctes) + " " + select)


ORACLE = {
    "validate": w(NEED_SQL, PLACES, SLOTS, SRC, CORRECTIONS, select=f"SELECT event_id, {VALID} AS plate FROM src LEFT JOIN fixed USING (s)"),
    "try_correction": w(NEED_SQL, PLACES, SLOTS, SRC, CORRECTIONS, select="SELECT event_id, p AS plate FROM src LEFT JOIN fixed USING (s)"),
    "normalize_to_7": w(SLOTS, SRC, CANDIDATES, select="SELECT event_id, c AS candidate, place FROM src JOIN c7 USING (s)"),
    "check_validity": w(
        NEED_SQL, PLACES, SLOTS, SRC, CORRECTIONS,
        select=f"""SELECT event_id, CASE WHEN {k.is_mercosul(D, 's')} THEN 'mercosul' WHEN regexp_matches(s, '^[A-Z]{{3}}[0-9]{{4}}$') THEN 'old' WHEN p LIKE '%-%' THEN 'old' WHEN p IS NOT NULL THEN 'mercosul' ELSE 'unknown' END AS format,
  CASE WHEN {k.is_mercosul(D, 's')} THEN NOT {k.vowel_fifth('s')} WHEN regexp_matches(s, '^[A-Z]{{3}}[0-9]{{4}}$') THEN true ELSE p IS NOT NULL END AS check_valid FROM src LEFT JOIN fixed USING (s)""",
    ),
    "best_replacement": w(NEED_SQL, select="SELECT kind, ch, r, w FROM need"),
    "confusion_weight": w(SIMILAR_SQL, select="SELECT ch AS a, alike AS b, w FROM similar_to"),
    "similar_group": w(SIMILAR_SQL, select="SELECT ch, string_agg(alike, '' ORDER BY rank) AS alike FROM similar_to GROUP BY ch"),
    "jn_prefix_state": w(SRC, PREFIXES, select="SELECT event_id, state, state IS NOT NULL AS known FROM src LEFT JOIN prefixes ON prefix = substr(s, 1, 3)"),
    "ngram_build": w(PREFIXES, select=f"SELECT 'single' AS kind, pos, '' AS prev, ch, {r6('p')} AS p FROM single UNION ALL SELECT 'pair', pos, prev, ch, {r6('p')} FROM pair"),
    "ngram_score": w(SRC, "texts_in AS (SELECT s AS t FROM src)", NGRAM, select=f"SELECT event_id, {r6('coalesce(ngram, 0e0)')} AS score FROM src LEFT JOIN ngrams ON t = s"),
    "topk_chars": w(PREFIXES, select="SELECT pos, prev, ch, place FROM (SELECT pos, prev, ch, row_number() OVER (PARTITION BY pos, prev ORDER BY p DESC, ch) AS place FROM pair) x WHERE place <= 5"),
    "vote_majority": w(TRACKS, MAJOR, select=f"SELECT video_id, vehicle, major_text, {r6('share')} AS share, {r6('major_conf')} AS major_conf FROM maj"),
    "vote_positional": w(TRACKS, VOTED, select=f"SELECT video_id, vehicle, voted_text, {r6('voted_conf')} AS voted_conf FROM pos7"),
    "vote_hybrid": w(
        TRACKS, INDIVIDUAL, MAJOR, VOTED, HYBRID,
        select=f"SELECT video_id, vehicle, CASE how WHEN 'majority' THEN major_text WHEN 'positional' THEN voted_text ELSE best_text END AS text, {r6('CASE how WHEN \'majority\' THEN major_conf WHEN \'positional\' THEN voted_conf ELSE best_conf END')} AS confidence, observations, observations >= 2 AS voting_applied FROM res",
    ),
    "agg_track": w(TRACKS, INDIVIDUAL, select="SELECT video_id, vehicle, best_text, best_conf, observations, first_frame, last_frame FROM ind"),
    "agg_self_consistency": w(
        TRACKS, "tx AS (SELECT video_id, vehicle, text, count(*) AS n, min(seq) AS f FROM obs WHERE text <> '' GROUP BY 1, 2, 3)", "win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, vehicle ORDER BY n DESC, f) AS rn FROM tx) x WHERE rn = 1)", "tot AS (SELECT video_id, vehicle, count(*) AS total FROM obs GROUP BY 1, 2)",
        select=f"SELECT video_id, vehicle, text AS winner, {r6(f'greatest(0.15e0, least(1e0, 0.6e0 * n / total + 0.4e0 * ({k.format_aderence(D, "text")}) + CASE WHEN total >= 3 AND n = total THEN 0.05e0 ELSE 0e0 END))')} AS confidence FROM win JOIN tot USING (video_id, vehicle)",
    ),
    "agg_unique": w(PLATES, select=f"SELECT video_id, plate, total_detections, first_seen_frame, last_seen_frame, first_seen_time, last_seen_time, best_confidence, plate_text, {r6('avg_confidence')} AS avg_confidence, {r6('avg_quality')} AS avg_quality, best_quality, best_frame_number, span_frames FROM ups"),
    "topk_rank": w(PLATES, select=f"SELECT video_id, place, plate, total_detections, {r6('composite')} AS composite FROM rk"),
    "topk_frames": w(PLATES, select="SELECT video_id, best_frame_number AS frame_number, place FROM rk WHERE place <= 3"),
    "timeline": with_views("SELECT video_id, frame_number, timestamp_ms / 1000e0 AS time_s, plate_text AS texts, confidence AS max_confidence FROM reads"),
    "agg_best_conf_text": w(PLATES, select="SELECT video_id, plate, plate_text, best_confidence FROM up"),
    "agg_best_quality": w(PLATES, select="SELECT video_id, plate, best_frame_number, best_quality FROM up"),
    "win_norm_max": w(PLATES, select=f"SELECT video_id, plate, {r6('total_detections / CAST(max(total_detections) OVER (PARTITION BY video_id) AS DOUBLE)')} AS detections, {r6('span_frames / CAST(max(span_frames) OVER (PARTITION BY video_id) AS DOUBLE)')} AS span FROM ups"),
    "agg_best_char": w(PLATES, select="SELECT video_id, plate, pos, arg_max(substr(plate, pos + 1, 1), c * 1e6 - frame_number * 1e-3) AS ch, max(c) AS conf FROM (SELECT video_id, plate, frame_number, pos, confidence * (80 + (event_id + pos) % 5 * 5) / 100e0 AS c FROM rq, (SELECT unnest(range(0, 9)) AS pos) p WHERE plate <> '' AND pos < length(plate)) x GROUP BY 1, 2, 3"),
    "confirmed_reading": w(PLATES, select="SELECT video_id, plate, string_agg(CASE WHEN c >= 0.7e0 THEN substr(plate, pos + 1, 1) ELSE '*' END, '' ORDER BY pos) AS reading FROM (SELECT video_id, plate, pos, max(confidence * (80 + (event_id + pos) % 5 * 5) / 100e0) AS c FROM rq, (SELECT unnest(range(0, 9)) AS pos) p WHERE plate <> '' AND pos < length(plate) GROUP BY 1, 2, 3) x GROUP BY 1, 2"),
    "win_early_stop": w(
        PLATES,
        select="""SELECT video_id, min(frame_number) AS stop_frame FROM (SELECT video_id, frame_number, ok AND plate = p1 AND plate = p2 AND o1 AND o2 AS stop FROM (SELECT video_id, frame_number, plate, confidence >= 0.85e0 AS ok, lag(plate) OVER v AS p1, lag(plate, 2) OVER v AS p2, lag(confidence >= 0.85e0) OVER v AS o1, lag(confidence >= 0.85e0, 2) OVER v AS o2 FROM rq WHERE plate <> '' WINDOW v AS (PARTITION BY video_id ORDER BY frame_number)) a) b WHERE stop GROUP BY video_id""",
    ),
    "win_last_annot": with_views("SELECT video_id, frame_number, last_value(CASE WHEN (frame_number - 1) % 2 = 0 THEN plate_text END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_number ROWS UNBOUNDED PRECEDING) AS shown FROM reads"),
    "win_temporal_prior": w(
        PLATES,
        """tp AS (SELECT video_id, event_id, frame_number, plate, count(*) OVER b AS n, min(frame_number) OVER b AS first, max(frame_number) OVER b AS last, max(confidence) OVER b AS best, max(read_quality) OVER b AS bq, avg(char_conf) OVER b AS chars, count(*) OVER u AS n_now, frame_number - min(frame_number) OVER u + 1 AS s_now
  FROM rq WHERE plate <> '' WINDOW b AS (PARTITION BY video_id, plate ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY video_id, plate ORDER BY frame_number ROWS UNBOUNDED PRECEDING))""",
        "tm AS (SELECT *, max(n_now) OVER v AS max_n, max(s_now) OVER v AS max_span FROM tp WINDOW v AS (PARTITION BY video_id ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        select=f"SELECT event_id, {r6('CASE WHEN n > 0 THEN least(1e0, 0.35e0 * n / max_n + 0.2e0 * (last - first + 1) / max_span + 0.2e0 * best + 0.15e0 * bq + 0.1e0 * greatest(chars, least(1e0, n / 5e0))) ELSE 0e0 END')} AS prior FROM tm",
    ),
    "flt_limit": with_views("SELECT video_id, frame_number FROM (SELECT video_id, frame_number, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS rn FROM reads WHERE (frame_number - 1) % 2 = 0 AND ms >= 50) x WHERE rn <= 10"),
    "win_artifact_cap": w(SRC, select=f"""SELECT video_id, event_id, n, lpad(CAST(n AS VARCHAR), 3, '0') || '_' || CASE WHEN s = '' THEN 'unknown' ELSE s END || '_' || reasons AS label FROM (SELECT video_id, event_id, s, reasons, row_number() OVER (ORDER BY video_id, frame_number, event_id) AS n FROM (SELECT *, concat_ws('_', CASE WHEN NOT {k.is_plate(D, 's')} THEN 'invalid' END, CASE WHEN confidence < 0.75e0 THEN 'lowconf' END) AS reasons FROM src) a WHERE reasons <> '') b WHERE n <= 50"""),
    "agg_eval": w(EVAL, select=f"SELECT {_SUM} FROM ev"),
    "agg_eval_tag": w(EVAL, select=f"SELECT scenario, {_SUM} FROM (SELECT *, unnest(list_distinct([tag, tag2])) AS scenario FROM ev) x GROUP BY scenario"),
    "char_accuracy": w(EVAL, select=f"SELECT fixture_id, {r6('chars')} AS accuracy FROM ev"),
    "jn_pred_fixture": with_views("SELECT f.event_id AS fixture_id, f.true_plate AS expected, coalesce(p.t, '') AS predicted, coalesce(p.confidence, 0e0) AS confidence FROM reads f LEFT JOIN (SELECT event_id, upper(trim(plate_text)) AS t, confidence FROM reads WHERE confidence >= 0.5e0) p USING (event_id)"),
    "calib_grid": w(
        values("g0", "n, d, o, f", [(n, *g) for n, g in enumerate((a, b, c) for a in (0.2, 0.25, 0.3) for b in (0.5, 0.55, 0.6) for c in (0.7, 0.75, 0.8))]),
        f"ev AS (SELECT n, d, o, f, expected, CASE WHEN det_conf >= d AND confidence >= o THEN predicted ELSE '' END AS predicted, ms + CASE WHEN confidence < f THEN 200e0 ELSE 0e0 END AS ms FROM records, g0)",
        f"sc AS (SELECT n, d, o, f, avg(CASE WHEN expected <> '' AND expected = predicted THEN 1e0 ELSE 0e0 END) AS ex, avg(CASE WHEN expected = '' AND predicted = '' THEN 1e0 ELSE {_SAME} / CAST(greatest(length(expected), length(predicted)) AS DOUBLE) END) AS ch, avg(CASE WHEN expected = '' AND predicted <> '' THEN 1e0 ELSE 0e0 END) AS fp, avg(ms) AS ms, count(*) AS c FROM ev GROUP BY 1, 2, 3, 4)",
        select=f"SELECT CAST(n AS BIGINT) AS grid_seq, d AS detector, o AS ocr, f AS fallback, c AS n, {r6(k.calib_score('ex', 'ch', 'fp', 'ms'))} AS score FROM sc",
    ),
    "jn_iou": with_views(f"SELECT a.image_id, a.det_seq AS a_seq, b.det_seq AS b_seq, {r6(k.iou('a.', 'b.'))} AS iou, {r6(k.iou('a.', 'b.', True))} AS iou_floor FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.det_seq < b.det_seq"),
    "jn_text_sim": with_views(f"SELECT event_id, {r6(k.text_similarity(k.compact(D, 'plate_text'), 'true_plate'))} AS similarity FROM reads"),
    "prj_region": with_views(
        """WITH m AS (SELECT *, CASE WHEN y2 - y1 < 60 AND y2 - y1 > 0 THEN greatest(0.1e0, least(0.25e0, 0.15e0 * (60e0 / (y2 - y1)))) ELSE 0.1e0 END AS margin FROM boxes WHERE x1 < x2 AND y1 < y2 AND x1 >= 0 AND y1 >= 0),
c AS (SELECT *, greatest(0, x1 - CAST(trunc((x2 - x1) * margin) AS BIGINT)) AS cx1, greatest(0, y1 - CAST(trunc((y2 - y1) * margin) AS BIGINT)) AS cy1, least(img_w, x2 + CAST(trunc((x2 - x1) * margin) AS BIGINT)) AS cx2, least(img_h, y2 + CAST(trunc((y2 - y1) * margin) AS BIGINT)) AS cy2 FROM m)
SELECT image_id, det_seq, cx1, cy1, cx2, cy2, CASE WHEN cy2 - cy1 < 80 THEN CAST(trunc((cx2 - cx1) * (80e0 / (cy2 - cy1))) AS BIGINT) ELSE cx2 - cx1 END AS out_w, CASE WHEN cy2 - cy1 < 80 THEN CAST(trunc((cy2 - cy1) * (80e0 / (cy2 - cy1))) AS BIGINT) ELSE cy2 - cy1 END AS out_h FROM c WHERE cx1 < cx2 AND cy1 < cy2"""
    ),
    "prj_tile": with_views(
        """WITH i AS (SELECT DISTINCT image_id, img_w, img_h FROM boxes WHERE img_w > 640 OR img_h > 640), y AS (SELECT *, unnest(range(0, img_h, 480)) AS ty1 FROM i), x AS (SELECT *, unnest(range(0, img_w, 480)) AS tx1 FROM y),
t AS (SELECT image_id, tx1, ty1, least(tx1 + 640, img_w) AS tx2, least(ty1 + 640, img_h) AS ty2 FROM x) SELECT * FROM t WHERE tx2 - tx1 >= 256 AND ty2 - ty1 >= 256"""
    ),
    "prd_sahi_retry": with_views(
        """SELECT image_id, CASE WHEN greatest(max(img_w), max(img_h)) < 1600 THEN '' WHEN max(confidence) < 0.55e0 THEN 'low_confidence' WHEN max(CAST(greatest(0, x2 - x1) * greatest(0, y2 - y1) AS DOUBLE) / (img_w * img_h)) <= 0.01e0 THEN 'small_plate_candidate' ELSE '' END AS reason FROM boxes GROUP BY image_id"""
    ),
    "img_order_corners": with_views(
        """WITH p AS (SELECT image_id, det_seq AS seq, x1 AS x, y1 AS y FROM boxes), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x + y, seq, x, y) AS a, row_number() OVER (PARTITION BY image_id ORDER BY x + y DESC, seq, x, y) AS b, row_number() OVER (PARTITION BY image_id ORDER BY y - x, seq, x, y) AS c, row_number() OVER (PARTITION BY image_id ORDER BY y - x DESC, seq, x, y) AS d FROM p)
SELECT image_id, max(CASE WHEN a = 1 THEN x END) AS tl_x, max(CASE WHEN a = 1 THEN y END) AS tl_y, max(CASE WHEN c = 1 THEN x END) AS tr_x, max(CASE WHEN c = 1 THEN y END) AS tr_y, max(CASE WHEN b = 1 THEN x END) AS br_x, max(CASE WHEN b = 1 THEN y END) AS br_y, max(CASE WHEN d = 1 THEN x END) AS bl_x, max(CASE WHEN d = 1 THEN y END) AS bl_y FROM r GROUP BY image_id"""
    ),
    "img_resize_geom": with_views(
        """WITH g AS (SELECT image_id, det_seq, x2 - x1 AS w, y2 - y1 AS h, least(300e0 / (x2 - x1), 100e0 / (y2 - y1)) AS scale FROM boxes WHERE x1 < x2 AND y1 < y2), n AS (SELECT *, CAST(trunc(w * scale) AS BIGINT) AS new_w, CAST(trunc(h * scale) AS BIGINT) AS new_h FROM g)
SELECT image_id, det_seq, new_w, new_h, (300 - new_w) // 2 AS "left", (100 - new_h) // 2 AS top, 300 - new_w - (300 - new_w) // 2 AS "right", 100 - new_h - (100 - new_h) // 2 AS bottom, CASE WHEN scale > 1 THEN 'cubic' ELSE 'area' END AS method FROM n"""
    ),
    "img_quality_native": with_views(f"SELECT crop_id, {r6('avg(p)')} AS brightness, {r6('stddev_pop(p)')} AS contrast, {r6('avg(CASE WHEN p >= 250 THEN 1e0 ELSE 0e0 END)')} AS highlight, {r6('avg(CASE WHEN p <= 5 THEN 1e0 ELSE 0e0 END)')} AS shadow, {r6(k.adaptive_clip('avg(p)', 'stddev_pop(p)'))} AS clip_limit FROM pixels GROUP BY crop_id"),
    "agg_quadrant": with_views(f"SELECT crop_id, {r6('least(1e0, stddev_pop(m) / 45e0)')} AS spread FROM (SELECT crop_id, i // 8 // 4 * 2 + i % 8 // 4 AS q, avg(p) AS m FROM pixels GROUP BY 1, 2) x GROUP BY crop_id"),
    "agg_border_center": with_views(f"SELECT crop_id, {r6('least(1e0, abs(avg(CASE WHEN edge THEN p END) - avg(CASE WHEN NOT edge THEN p END)) / 70e0)')} AS delta FROM (SELECT crop_id, p, NOT (i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5) AS edge FROM pixels) x GROUP BY crop_id"),
    "img_sharpness": with_views(
        f"""WITH g AS (SELECT crop_id, i // 8 AS y, i % 8 AS x, p FROM pixels), m AS (SELECT crop_id, y, x, p, CASE WHEN y = 0 THEN 1 ELSE y - 1 END AS u, CASE WHEN y = 7 THEN 6 ELSE y + 1 END AS d, CASE WHEN x = 0 THEN 1 ELSE x - 1 END AS l, CASE WHEN x = 7 THEN 6 ELSE x + 1 END AS r FROM g)
SELECT crop_id, {r6('var_pop(lap)')} AS sharpness FROM (SELECT m.crop_id, a.p + b.p + c.p + e.p - 4 * m.p AS lap FROM m JOIN g a ON a.crop_id = m.crop_id AND a.y = m.u AND a.x = m.x JOIN g b ON b.crop_id = m.crop_id AND b.y = m.d AND b.x = m.x JOIN g c ON c.crop_id = m.crop_id AND c.y = m.y AND c.x = m.l JOIN g e ON e.crop_id = m.crop_id AND e.y = m.y AND e.x = m.r) z GROUP BY crop_id"""
    ),
    "srt_results": w(SRC, select=f"SELECT video_id, event_id, place FROM (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY {k.is_plate(D, 's')} DESC, confidence DESC, quality DESC, det_conf DESC, event_id) AS place FROM src) x"),
    "best_ocr": with_views("SELECT video_id, event_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, frame_number) AS rn FROM reads) x WHERE rn = 1"),
    "best_fragment": w(SRC, select=f"SELECT video_id, event_id, rank FROM (SELECT video_id, event_id, frag_rank AS rank, row_number() OVER (PARTITION BY video_id ORDER BY frag_rank DESC, confidence DESC, frame_number) AS rn FROM (SELECT *, CASE WHEN {k.is_plate(D, 's')} THEN 2 WHEN length(s) = 7 THEN 1 ELSE 0 END AS frag_rank FROM src) a) x WHERE rn = 1"),
    "jn_dict_lookup": w(
        PLATES, TRACKS, MAJOR,
        "vt AS (SELECT video_id, major_text AS plate, max(major_conf) AS voted_conf FROM maj GROUP BY 1, 2)",
        select=f"SELECT coalesce(u.video_id, v.video_id) AS video_id, coalesce(u.plate, v.plate) AS plate, {r6('greatest(coalesce(best_confidence, 0e0), coalesce(voted_conf, 0e0))')} AS best_confidence, voted_conf IS NOT NULL AND (best_confidence IS NULL OR voted_conf > best_confidence) AS voted FROM up u FULL JOIN vt v ON u.video_id = v.video_id AND u.plate = v.plate",
    ),
    "jn_frame_map": w(PLATES, select="SELECT p.video_id, p.plate, r.event_id FROM up p JOIN reads r ON r.video_id = p.video_id AND r.frame_number = p.best_frame_number"),
    "jn_local_premium": w(SRC, select="SELECT event_id, pos, CASE WHEN substr(s, pos, 1) = '' THEN '-' ELSE substr(s, pos, 1) END AS local, CASE WHEN substr(true_plate, pos, 1) = '' THEN '-' ELSE substr(true_plate, pos, 1) END AS premium FROM src, (SELECT unnest(range(1, 10)) AS pos) p WHERE pos <= greatest(length(s), length(true_plate))"),
    "src_premium": with_views(f"SELECT event_id, true_plate AS plate, {r6('greatest(confidence, det_conf)')} AS score, greatest(confidence, det_conf) >= 0.5e0 AS accepted, {k.detect_format(D, 'true_plate')} AS format FROM reads"),
    "json_llm_parse": with_views("SELECT event_id, true_plate AS selected, confidence AS decision_confidence, event_id % 2 = 0 AS should_override FROM reads"),
    "src_manifest": with_views("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'id' || event_id WHEN event_id % 3 = 1 THEN 'fx' || event_id ELSE 'clip' || event_id END AS fixture_id, replace(true_plate, '-', '') AS expected, CASE WHEN event_id % 4 = 0 THEN 'video' ELSE 'image' END AS media_type FROM reads"),
    "describe_changes": w(
        SRC,
        "ch AS (SELECT event_id, string_agg(pos || ':' || CASE WHEN substr(s, pos, 1) = '' THEN '_' ELSE substr(s, pos, 1) END || '->' || substr(true_plate, pos, 1), ', ' ORDER BY pos) AS c FROM src, (SELECT unnest(range(1, 8)) AS pos) p WHERE substr(s, pos, 1) <> substr(true_plate, pos, 1) GROUP BY event_id)",
        select="SELECT event_id, CASE WHEN s = '' THEN 'candidate' ELSE coalesce(c, 'no-change') END AS changes FROM src LEFT JOIN ch USING (event_id)",
    ),
    "cand_support": w(
        SRC, SIMILAR_SQL,
        "cs AS (SELECT event_id, least(1e0, CASE WHEN substr(s, pos, 1) = substr(true_plate, pos, 1) THEN confidence WHEN w IS NOT NULL THEN greatest(0.12e0, confidence * w + (1e0 - confidence) * 0.25e0) ELSE greatest(0.05e0, (1e0 - confidence) * 0.6e0) END) AS x FROM src CROSS JOIN (SELECT unnest(range(1, 8)) AS pos) p LEFT JOIN similar_to ON ch = substr(s, pos, 1) AND alike = substr(true_plate, pos, 1))",
        select=f"SELECT event_id, {r6('avg(x)')} AS support FROM cs GROUP BY event_id",
    ),
}
