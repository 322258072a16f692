"""Catalog views over the driver's tables: the same SQL in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["part", "lineitem", "events", "documents", "embeddings"]
VIEWS = {
    "v_tracks": """
SELECT p_partkey AS track_id,
 concat('/lib/', p_brand, '/', p_name, ' ', CAST(p_partkey AS STRING), '.mp3') AS file_path,
 concat(p_name, ' ', CAST(p_partkey AS STRING), '.mp3') AS filename,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS title,
 CASE WHEN p_partkey % 13 = 0 THEN 'Unknown Artist' ELSE p_brand END AS artist,
 p_type AS genre_raw,
 CASE WHEN (p_partkey*7 + p_size*5) % 26 >= 24 THEN NULL ELSE
  concat(CAST((p_partkey*7 + p_size*5) % 26 % 12 + 1 AS STRING), CASE WHEN (p_partkey*7 + p_size*5) % 26 >= 12 THEN 'B' ELSE 'A' END) END AS key_camelot,
 CAST((p_partkey*13 + p_size) % 100 AS DOUBLE) / 100 AS key_confidence,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 80 + CAST((p_partkey*37 + p_size*11) % 900 AS DOUBLE)/10 END AS bpm,
 CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(p_size % 10 + 1 AS INT) END AS energy_level,
 CAST(120000 + p_size*1000 AS BIGINT) AS duration_ms,
 CASE WHEN p_partkey % 10 < 7 THEN 'analyzed' WHEN p_partkey % 10 = 7 THEN 'pending' WHEN p_partkey % 10 = 8 THEN 'metadata_ready' ELSE 'error' END AS status
FROM part
""",
    "v_opinions": """
SELECT track_id, source, key_camelot, bpm, energy, confidence, created_at FROM (
SELECT l.l_partkey AS track_id,
 CASE l.l_suppkey % 4 WHEN 0 THEN 'engine' WHEN 1 THEN 'tagcsv' WHEN 2 THEN 'djxml' ELSE 'fingerprint' END AS source,
 CASE WHEN l.l_orderkey % 10 < 6 THEN t.key_camelot WHEN l.l_orderkey % 10 = 9 THEN NULL ELSE concat(CAST(l.l_orderkey % 12 + 1 AS STRING), CASE WHEN l.l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END) END AS key_camelot,
 CASE WHEN l.l_orderkey % 7 = 0 THEN NULL ELSE t.bpm + (l.l_linenumber % 3) * CAST(0.75 AS DOUBLE) END AS bpm,
 CAST(l.l_quantity AS INT) % 10 + 1 AS energy,
 1 - l.l_discount AS confidence,
 l.l_shipdate AS created_at,
 row_number() OVER (PARTITION BY l.l_partkey, l.l_suppkey % 4 ORDER BY l.l_shipdate DESC, l.l_orderkey DESC, l.l_linenumber DESC, l.l_suppkey, l.l_extendedprice DESC) AS rn
FROM lineitem l JOIN v_tracks t ON t.track_id = l.l_partkey) x WHERE rn = 1
""",
    "v_playlist_tracks": """
SELECT playlist_id, track_id, CAST(row_number() OVER (PARTITION BY playlist_id ORDER BY p, track_id) - 1 AS BIGINT) AS position FROM
(SELECT l_orderkey AS playlist_id, l_partkey AS track_id, min(l_linenumber) AS p FROM lineitem GROUP BY l_orderkey, l_partkey) d
""",
    "v_gold": """
SELECT l_orderkey * 10 + l_linenumber AS annotation_id, l_partkey AS track_id, CAST(l_partkey % 12 + (CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS INT) % 12 AS tonic_pc,
 CASE l_returnflag WHEN 'R' THEN 'major' WHEN 'A' THEN 'minor' ELSE CASE WHEN l_linenumber = 7 THEN 'atonal' ELSE 'ambiguous' END END AS key_mode,
 l_linenumber % 5 + 1 AS annotator_confidence, CASE WHEN l_linestatus = 'O' THEN 'self' ELSE 'second' END AS annotator_id, l_shipdate AS created_at
FROM lineitem
""",
    "v_training": """
SELECT event_id AS session_id, event_type AS session_type, value < 150 AS correct, value / 100 AS response_time_s, ts AS created_at FROM events
""",
    "v_onset": """
SELECT track_id, frame, sum(v) AS onset FROM (SELECT user_id AS track_id, CAST((extract(day FROM ts) - 1) * 24 + extract(hour FROM ts) AS INT) AS frame, value AS v FROM events) e GROUP BY track_id, frame
""",
    "v_genres": """
SELECT t.track_id, g.genre_raw FROM v_tracks t JOIN (VALUES (0,'Tech House'),(1,'Acid Techno'),(2,'Psy-trance'),(3,'Drum & Bass'),(4,'rap & hip hop'),(5,'Soul'),(6,'rock & roll'),(7,'Top 40'),(8,'Dancehall'),(9,'Soundtrack'),(10,'Blues'),(11,'Lounge'),(12,'Folk'),(13,'EDM'),(14,''),(15,'remix-nation.com')) AS g(i, genre_raw) ON t.track_id % 16 = g.i
""",
    "v_predictions": """
SELECT t.track_id, t.file_path AS location, g.genre_raw, CASE t.track_id % 3 WHEN 0 THEN 'mp3' WHEN 1 THEN 'flac' ELSE 'm4a' END AS extension,
 t.key_camelot AS truth_camelot, t.bpm AS truth_bpm, o.key_camelot AS pred_camelot,
 o.bpm * (CASE t.track_id % 5 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS pred_bpm,
 CASE WHEN t.track_id % 23 = 0 THEN 'decode: x' END AS failure, CAST(t.duration_ms % 5000 AS BIGINT) AS total_ms
FROM v_tracks t JOIN v_genres g ON g.track_id = t.track_id JOIN v_opinions o ON o.track_id = t.track_id AND o.source = 'engine'
""",
    "v_beat_grids": """
SELECT track_id, source, bpm, first_beat_ms, meter_numerator, downbeat_offset_beats, confidence, is_override, created_at FROM (
SELECT l_partkey AS track_id, CASE l_suppkey % 3 WHEN 0 THEN 'engine' WHEN 1 THEN 'manual' ELSE 'imported' END AS source,
 80 + CAST((l_partkey*37 + l_linenumber*10) % 900 AS DOUBLE)/10 AS bpm, CAST(l_quantity AS BIGINT) * 10 AS first_beat_ms, CASE WHEN l_linenumber % 4 = 0 THEN 3 ELSE 4 END AS meter_numerator, l_linenumber % 3 AS downbeat_offset_beats,
 CASE WHEN l_suppkey % 3 = 1 THEN NULL ELSE 1 - l_discount END AS confidence, l_suppkey % 3 = 1 AS is_override, l_shipdate AS created_at,
 row_number() OVER (PARTITION BY l_partkey, l_suppkey % 3 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey, l_extendedprice DESC) AS rn FROM lineitem) x WHERE rn = 1
""",
    "v_setlist": """
SELECT p.playlist_id AS set_id, p.position, t.artist, concat(upper(t.filename), ' (Live!)') AS title FROM v_playlist_tracks p JOIN v_tracks t ON t.track_id = p.track_id WHERE p.playlist_id % 50 = 0
""",
    # the same of every playlist; v_setlist is the queries of the fuzzy search
    "v_setlist_all": """
SELECT p.playlist_id AS set_id, p.position, t.artist, concat(upper(t.filename), ' (Live!)') AS title FROM v_playlist_tracks p JOIN v_tracks t ON t.track_id = p.track_id
""",
    "v_progress": """
SELECT ts, user_id AS worker_id, event_id AS track_id, event_type = 'error' AS failed, CAST(floor(value * 10) AS BIGINT) AS elapsed_ms FROM events
""",
    "v_pairs": """
SELECT p.playlist_id, p.position, a.track_id AS a_id, b.track_id AS b_id, a.key_camelot AS ak, b.key_camelot AS bk, a.bpm AS abpm, b.bpm AS bbpm, a.energy_level AS ae, b.energy_level AS be
FROM v_playlist_tracks p JOIN v_playlist_tracks q ON p.playlist_id = q.playlist_id AND q.position = p.position + 1 JOIN v_tracks a ON a.track_id = p.track_id JOIN v_tracks b ON b.track_id = q.track_id
""",
    "v_keys": """
SELECT track_id, bpm, key_camelot, CAST(substr(key_camelot, 1, length(key_camelot) - 1) AS INT) AS n, substr(key_camelot, length(key_camelot), 1) AS c FROM v_tracks WHERE key_camelot IS NOT NULL
""",
    "v_dim": """
SELECT CAST(n AS INT) AS n, c, concat(CAST(n AS STRING), c) AS code, CAST(CASE WHEN c = 'B' THEN t ELSE (t + 9) % 12 END AS INT) AS tonic, c = 'B' AS is_major
FROM (VALUES (8,0),(3,1),(10,2),(5,3),(12,4),(7,5),(2,6),(9,7),(4,8),(11,9),(6,10),(1,11)) AS m(n, t) CROSS JOIN (VALUES ('A'), ('B')) AS l(c)
""",
    "v_moves": """
SELECT x.*, (bn - an + 12) % 12 AS d, ac = bc AS same, CASE WHEN abpm > 0 AND bbpm IS NOT NULL THEN (bbpm - abpm) / abpm * 100 ELSE 0 END AS delta FROM (
SELECT p.*, CAST(substr(ak, 1, length(ak) - 1) AS INT) AS an, substr(ak, length(ak), 1) AS ac, CAST(substr(bk, 1, length(bk) - 1) AS INT) AS bn, substr(bk, length(bk), 1) AS bc FROM v_pairs p) x
""",
    "v_scored": """
SELECT p.*, t.tonic AS tt, t.is_major AS tm, q.tonic AS pt, q.is_major AS pm FROM v_predictions p LEFT JOIN v_dim t ON t.code = p.truth_camelot LEFT JOIN v_dim q ON q.code = p.pred_camelot
""",
}


def needed(sql: str) -> list[str]:
    """The views that ``sql`` uses, each after those it builds on."""
    out: list[str] = []
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in out:
            out += [x for x in [*needed(VIEWS[name]), name] if x not in out]
    return out


def with_views(sql: str) -> str:
    """``sql`` with its views as common table expressions, for DuckDB."""
    names = needed(sql)
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names) + "\n" if names else "") + sql


#: Rows that one task sorts or groups.
ROWS_A_TASK = 500_000
#: Views that group and number a whole table's rows by one of its columns: Spark deals the table by that column first, to tasks by rows.
DEALT = {"v_playlist_tracks": ("lineitem", "l_orderkey"), "v_opinions": ("lineitem", "l_partkey")}


def tasks(spark: SparkSession, sf_dir: str, table: str) -> int:
    """Tasks for all rows of a table: as many as Spark's setting, more where one would get over ROWS_A_TASK. Counts come from the files' footers."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = needed(name)
    text = " ".join(VIEWS[n] for n in names)
    hints = {t: f"/*+ REPARTITION({tasks(spark, sf_dir, t)}, {by}) */ " for n, (t, by) in DEALT.items() if n in names}
    parts = [f"{t} AS (SELECT {hints.get(t, '')}* FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b{t}\b", text)]
    parts += [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    return spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}")
