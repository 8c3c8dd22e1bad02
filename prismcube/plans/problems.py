"""Queries of the general large-table problems (skew, places, times, records)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import instants, points, records, skew
from ..session import table
from .registry import Catalog

catalog = Catalog()

HOT_SHARE = 1 / 20
NEAR_M = 100.0
RECORD = records.RecordSchema(
    records.Digits("c0", 255), records.Digits("c1", 255), records.Digits("c2", 255), records.PlainDecimal("lat", 90), records.PlainDecimal("lon", 180)
)


def term(c: Column) -> Column:
    """A value with outer blanks and tabs removed, inner runs made one space, in upper case; blank is null."""
    text = F.trim(F.regexp_replace(c, "[ \t]+", " "))
    return F.when(text != "", F.upper(text))


_TERM = "nullif(upper(trim(regexp_replace({c}, '[ \\t]+', ' ', 'g'))), '')"


@catalog.query(
    "p3_found",
    f"""
    WITH k AS (SELECT 'crimes.type' AS field, {_TERM.format(c="type")} AS hot_key FROM crimes
               UNION ALL SELECT 'taxi.pickup_location', CAST(pickup_location AS VARCHAR) FROM taxi),
         t AS (SELECT field, count(*) AS total FROM k GROUP BY 1)
    SELECT field, hot_key FROM k JOIN t USING (field) WHERE hot_key IS NOT NULL
    GROUP BY field, hot_key, total HAVING count(*) * 20 >= total""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [("crimes.type", table(spark, d, "crimes"), term(F.col("type"))), ("taxi.pickup_location", table(spark, d, "taxi"), F.col("pickup_location"))]
    found = [skew.heavy_keys(df, key, HOT_SHARE).select(F.lit(field).alias("field"), F.col("key").cast("string").alias("hot_key")) for field, df, key in parts]
    return found[0].unionByName(found[1])


def _stats_sql(source: str, key: str, values: list[str]) -> str:
    def ranked(v: str) -> str:
        return f"""SELECT k, {", ".join(f"max(CASE WHEN rn = greatest(1, ceil({p} * n - 1e-9)) THEN v END) AS {name}_{v}" for name, p in PROBS.items())},
                   CAST(sum(CAST(v AS DECIMAL(28,6))) AS DOUBLE) AS sum_{v}
            FROM (SELECT {key} AS k, {v} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {v}) AS rn, count(*) OVER (PARTITION BY {key}) AS n
                  FROM {source} WHERE {v} IS NOT NULL AND NOT isnan({v}) AND NOT isinf({v})) GROUP BY k"""

    joins = " ".join(f"LEFT JOIN ({ranked(v)}) q{i} ON q{i}.k = h.key" for i, v in enumerate(values))
    cols = ", ".join(f"sum_{v}, " + ", ".join(f"{n}_{v}" for n in PROBS) for v in values)
    return f"SELECT h.key AS key, n_rows, {cols} FROM (SELECT {key} AS key, count(*) AS n_rows FROM {source} WHERE {key} IS NOT NULL GROUP BY 1) h {joins}"


PROBS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@catalog.query("p3_pickup_stats", _stats_sql("taxi", "pickup_location", ["duration", "fare"]))
def p3_pickup_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.keyed_stats(table(spark, d, "taxi"), F.col("pickup_location"), ["duration", "fare"], PROBS)


@catalog.query("p3_type_stats", _stats_sql("crimes", _TERM.format(c="type"), ["lat", "lon"]))
def p3_type_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.keyed_stats(table(spark, d, "crimes"), term(F.col("type")), ["lat", "lon"], PROBS)


def _near(spark: SparkSession, d: str) -> DataFrame:
    return points.near_pairs(table(spark, d, "paper"), "id", "latitude", "longitude", NEAR_M)


def _zones(spark: SparkSession, d: str) -> DataFrame:
    kinds = {k: (f"{k}_latitude", f"{k}_longitude") for k in ("pickup", "dropoff")}
    return points.points_in_regions(table(spark, d, "taxi"), "record_no", kinds, table(spark, d, "zones"), "zone_id", "ring_wkt")


_NEAR_SQL = """
    WITH p AS (SELECT DISTINCT id, latitude AS y, longitude AS x FROM paper
               WHERE id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)),
         q AS (SELECT *, CAST(floor(y / 0.001) AS BIGINT) AS r FROM p),
         w AS (SELECT q.*, r + s AS rr FROM q, range(-1, 2) t(s))
    SELECT DISTINCT a.id AS key_a, b.id AS key_b FROM q a JOIN w b ON a.r = b.rr AND a.id < b.id
    WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 100"""
# Rays from every point through the borders of the regions whose box holds it.
_ZONES_SQL = """
    WITH t AS (SELECT zone_id, regexp_extract_all(ring_wkt, '\\(([^()]+)\\)', 1) AS rings FROM zones),
         g AS (SELECT zone_id, i, string_split(rings[i], ',') AS pts FROM t, range(1, 1000) s(i) WHERE i <= len(rings)),
         v AS (SELECT zone_id, i, k, string_split(trim(pts[k]), ' ') AS c FROM g, range(1, 100000) s(k) WHERE k <= len(pts)),
         w AS (SELECT zone_id, i, k, CAST(c[1] AS DOUBLE) AS x, CAST(c[2] AS DOUBLE) AS y FROM v),
         e AS (SELECT zone_id, x AS x1, y AS y1, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM w WINDOW o AS (PARTITION BY zone_id, i ORDER BY k)),
         box AS (SELECT zone_id, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM w GROUP BY zone_id),
         p AS (SELECT 'pickup' AS kind, record_no, pickup_latitude AS y, pickup_longitude AS x FROM taxi UNION ALL SELECT 'dropoff', record_no, dropoff_latitude, dropoff_longitude FROM taxi),
         l AS (SELECT * FROM p WHERE y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 180 AND NOT (y = 0 AND x = 0))
    SELECT kind, CAST(zone_id AS BIGINT) AS key_a, record_no AS key_b FROM l JOIN box ON x BETWEEN xa AND xb AND y BETWEEN ya AND yb JOIN e USING (zone_id)
    WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY kind, zone_id, record_no HAVING count(*) % 2 = 1"""


@catalog.query("p4_found", f"SELECT 'near' AS kind, key_a, key_b FROM ({_NEAR_SQL}) UNION ALL SELECT kind, key_a, key_b FROM ({_ZONES_SQL})")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select(F.lit("near").alias("kind"), "key_a", "key_b").unionByName(_zones(spark, d))


@catalog.query("p4_near", _NEAR_SQL)
def p4_near(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


@catalog.query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rides = table(spark, d, "taxi").select("record_no", "pickup_time", "fleet_id")
    rides, clock = instants.with_profiles(rides, "fleet_id", table(spark, d, "fleets"), "fleet_id", "tz_name", "date_order", "std_abbr", "dst_abbr")
    return instants.normalise_instants(rides, "record_no", "pickup_time", "profile", clock)


_FIELD = """(?:[^",]*|"(?:[^"]|"")*")"""
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_LAT = r"-?0*(?:[0-8]?[0-9](?:\.[0-9]+)?|90(?:\.0+)?)"
_LON = r"-?0*(?:(?:[0-9]{1,2}|1[0-7][0-9])(?:\.[0-9]+)?|180(?:\.0+)?)"
_WHOLE = ",".join(f'(?: *({p}) *|"({p})")' for p in (_BYTE, _BYTE, _BYTE, _LAT, _LON))


@catalog.query(
    "p6_found",
    f"""
    SELECT line_no, CASE WHEN NOT regexp_full_match(line, '(?s){_FIELD}(?:,{_FIELD})*') THEN 'quoting'
      WHEN length(regexp_replace(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) <> 4 THEN 'column_count' ELSE 'value' END AS reason
    FROM bug4e WHERE NOT regexp_full_match(line, '{_WHOLE}')""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return records.failed_records(table(spark, d, "bug4e"), "line", RECORD, "line_no").select("line_no", "reason")


@catalog.query("p6_failed")
def p6_failed(spark: SparkSession, d: str) -> DataFrame:
    """Failed records with the first field that their pattern's prefixes do not reach."""
    return records.failed_records(table(spark, d, "bug4e"), "line", RECORD, "line_no")


@catalog.query(
    "p6_rows",
    "SELECT line_no, "
    + ", ".join(f"CAST(v[{i + 1}] AS {t}) AS {n}" for i, (n, t) in enumerate([("c0", "INTEGER"), ("c1", "INTEGER"), ("c2", "INTEGER"), ("lat", "DOUBLE"), ("lon", "DOUBLE")]))
    + f""" FROM (SELECT line_no, string_split(replace(replace(line, '"', ''), ' ', ''), ',') AS v FROM bug4e WHERE regexp_full_match(line, '{_WHOLE}'))""",
)
def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    return records.load_records(table(spark, d, "bug4e"), "line", RECORD, "line_no")
