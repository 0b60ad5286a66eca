"""Input tables as plate data: SQL that Spark and DuckDB read alike. $name stands for an input table.

The driver's tables hold no plates; these views derive them from whole tables by plain arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LETTER = lambda a, b: f"chr(CAST(65 + (v * {a} + {b}) % 26 AS INT))"
_DIGIT = lambda a, b: f"chr(CAST(48 + (v * {a} + {b}) % 10 AS INT))"

READS = f"""
SELECT event_id, video_id, frame_number, vehicle, true_plate,
  CASE WHEN event_id % 13 = 0 THEN substr(noisy, 1, 6) WHEN event_id % 17 = 0 THEN noisy || 'X' WHEN event_id % 19 = 0 THEN lower(noisy) || ' ' ELSE noisy END AS plate_text,
  confidence, quality, det_conf, snr, motion, x1, y1, x1 + 100 + event_id % 5 AS x2, y1 + 40 + event_id % 3 AS y2,
  CAST(frame_number AS DOUBLE) * 33e0 AS timestamp_ms, CAST(20 + event_id * 7 % 900 AS DOUBLE) AS ms, event_id % 40 AS blur_class
FROM (
  SELECT *, CASE WHEN event_id % 7 = 0 THEN translate(true_plate, '1', 'I') WHEN event_id % 5 = 0 THEN translate(true_plate, '0', 'O') WHEN event_id % 11 = 0 THEN translate(true_plate, 'B', '8') ELSE true_plate END AS noisy
  FROM (
    SELECT event_id, user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame_number, v AS vehicle,
      {_LETTER(7, 3)} || {_LETTER(11, 5)} || {_LETTER(3, 1)} || {_DIGIT(3, 1)}
        || CASE WHEN user_id % 2 = 0 THEN {_DIGIT(7, 2)} ELSE substr('BCDFGHJKLMNPQRSTVWXYZ', CAST(1 + v * 5 % 21 AS INT), 1) END || {_DIGIT(9, 0)} || {_DIGIT(1, 4)} AS true_plate,
      CAST(30 + event_id * 37 % 70 AS DOUBLE) / 100e0 AS confidence, CAST(event_id * 13 % 100 AS DOUBLE) / 100e0 AS quality, CAST(20 + event_id * 29 % 80 AS DOUBLE) / 100e0 AS det_conf,
      CAST(event_id * 17 % 25 AS DOUBLE) AS snr, CAST(event_id * 23 % 60 AS DOUBLE) / 100e0 AS motion,
      100 + v * 53 % 400 + event_id % 9 AS x1, 80 + v * 31 % 300 + event_id % 4 AS y1
    FROM (SELECT *, user_id * 2 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS v FROM $events) a
  ) b
) c"""

BOXES = """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS det_seq, x1, y1, x1 + w AS x2, y1 + h AS y2, confidence, 640 + l_orderkey % 5 * 400 AS img_w, 480 + l_orderkey % 7 * 300 AS img_h
FROM (SELECT *, l_partkey % 60 - 3 AS x1, l_suppkey % 40 - 2 AS y1, 30 + l_partkey % 45 AS w, (l_suppkey + l_linenumber) % 50 - 2 AS h, 0.05e0 + l_discount * 9e0 AS confidence FROM $lineitem) a"""

VIDEOS = """
SELECT o_orderkey AS video_id, 'in/Clip_' || CAST(o_orderkey AS STRING) || substr('.mp4.AVI.mov.mkv.txt.wmv', CAST(1 + o_orderkey % 6 * 4 AS INT), 4) AS path,
  o_custkey * 3 AS total_frames, CAST(o_orderkey % 4 * 15 AS DOUBLE) AS fps, 640 + o_orderkey % 3 * 640 AS width, 480 + o_orderkey % 3 * 300 AS height,
  (109 + o_orderkey % 9) + 112 * 256 + 52 * 65536 + 118 * 16777216 AS code, CAST(o_totalprice * 100e0 AS DOUBLE) AS bytes, CAST(1 + o_orderkey % 5 AS BIGINT) AS skip
FROM $orders"""

PIXELS = """
SELECT vec_id AS crop_id, CAST(i AS BIGINT) AS i, greatest(0e0, least(255e0, floor((CAST(v AS DOUBLE) + 0.5e0) * 255e0))) AS p FROM ($exploded) a"""

TEXTS = """
SELECT CAST(doc_id AS BIGINT) AS id, 'd' AS kind, text AS t FROM $documents UNION ALL SELECT CAST(item_id AS BIGINT), 'b', text FROM $benchmark"""

RECORDS = f"""
SELECT event_id AS fixture_id, CASE WHEN event_id % 23 = 0 THEN '' ELSE true_plate END AS expected, CASE WHEN event_id % 29 = 0 THEN '' ELSE upper(trim(plate_text)) END AS predicted, CASE WHEN event_id % 29 = 0 THEN 0e0 ELSE confidence END AS confidence,
  det_conf, ms, CASE WHEN quality < 0.3e0 THEN 'low_light' WHEN motion > 0.35e0 THEN 'motion' ELSE 'clear' END AS tag, CASE WHEN x1 % 3 = 0 THEN 'small_plate' ELSE 'clear' END AS tag2
FROM ({READS}) r"""

EXPLODED = {"spark": "SELECT vec_id, i, v FROM $embeddings LATERAL VIEW posexplode(embedding) e AS i, v", "duckdb": "SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding) AS v FROM $embeddings"}
VIEWS = {"reads": READS, "boxes": BOXES, "videos": VIDEOS, "pixels": PIXELS, "texts": TEXTS, "records": RECORDS}
TABLES = ("events", "lineitem", "orders", "embeddings", "documents", "benchmark", "part", "customer", "labels")


def view_sql(name: str, dialect: str) -> str:
    text = VIEWS[name].replace("$exploded", EXPLODED[dialect])
    if dialect == "duckdb":
        for t in TABLES:
            text = text.replace(f"${t}", t)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = view_sql(name, "spark")
    for t in TABLES:
        if f"${t}" in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"_pw_{t}")
            text = text.replace(f"${t}", f"_pw_{t}")
    return spark.sql(text)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as CTEs."""
    named = [f"{n} AS ({view_sql(n, 'duckdb')})" for n in VIEWS if f" {n}" in sql.replace("\n", " ").replace("(", " ")]
    if not named:
        return sql
    return f"WITH {', '.join(named)}{',' + sql.strip()[4:] if sql.strip().upper().startswith('WITH') else ' ' + sql}"
