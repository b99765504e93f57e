"""Routing data derived from the driver's tables, as SQL both Spark and DuckDB read alike.

Every table below is a SELECT over the given tables (``events``, ``customer``, ``supplier``,
``nation``) or over tables derived before it, so it grows with them. A third of all updates falls
on one prefix (pid 38). Thirty days of events become three bursts of ten minutes, more than an
hour apart, so that sessions are forgotten and classes expire.
"""

from pathlib import Path

from .session import cut

EPOCH = {
    "spark": "timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))",
    "duckdb": "CAST(floor(epoch(ts) - 1704067200) AS BIGINT)",
}

PREFIX = """CASE WHEN pid = 0 THEN '84.205.64.0/24'
       WHEN pid = 2 THEN '93.175.154.128/28'
       WHEN pid = 1 THEN '192.0.2.0/24'
       WHEN pid % 40 = 1 THEN concat('10.', CAST(CAST(floor(pid / 40) AS BIGINT) % 256 AS STRING), '.0.0/16')
       WHEN pid % 5 = 4 THEN concat('2400:', CAST(pid % 9000 + 100 AS STRING), '::/', CAST(32 + (pid % 3) * 8 AS STRING))
       WHEN pid % 11 = 5 THEN concat(CAST(20 + (pid - 1) % 80 AS STRING), '.', CAST(CAST(floor((pid - 1) / 80) AS BIGINT) % 256 AS STRING), '.0.0/24')
       WHEN pid % 22 = 6 THEN concat(CAST(20 + (pid - 2) % 80 AS STRING), '.', CAST(CAST(floor((pid - 2) / 80) AS BIGINT) % 256 AS STRING), '.3.0/24')
       ELSE concat(CAST(20 + pid % 80 AS STRING), '.', CAST(CAST(floor(pid / 80) AS BIGINT) % 256 AS STRING), '.0.0/', CAST(16 + pid % 6 AS STRING)) END"""

TABLES = {
    # One row per update. Needs only ``events``.
    "updates": f"""
WITH raw AS (
  SELECT event_id, user_id, event_type, CAST({{epoch}} AS BIGINT) AS off,
    CAST(CASE WHEN event_id % 3 = 0 THEN 38 ELSE user_id END AS BIGINT) AS pid FROM {{events}}
), b AS (
  SELECT *, CASE WHEN pid % 40 < 10 THEN 3 WHEN pid % 40 < 25 THEN 6 ELSE 36 END AS n_sessions,
    1704067200 + CAST(floor(off / 1440.0) AS BIGINT) + 3700 * CAST(floor(off / 864000.0) AS BIGINT) AS ts,
    event_type IN ('error', 'view') AS is_withdrawal,
    CASE WHEN pid % 7 = 3 AND CAST(floor(off / 432000.0) AS BIGINT) % 2 = 1
         THEN 9000 + pid % 1000 ELSE 1000 + pid END AS o
  FROM raw
), k AS (
  SELECT *, (event_id * 7 + user_id) % n_sessions AS sn FROM b
), p AS (
SELECT CAST(event_id AS BIGINT) AS update_id, CAST(ts AS BIGINT) AS ts, pid,
  {PREFIX} AS prefix,
  CASE WHEN sn % 3 = 0 THEN 'routeviews' ELSE concat('198.18.1.', CAST(sn + 1 AS STRING)) END AS host,
  CASE WHEN sn % 3 = 0 THEN concat('198.18.0.', CAST(sn + 1 AS STRING))
       ELSE concat('198.18.1.', CAST(sn + 1 AS STRING)) END AS peer,
  is_withdrawal,
  CAST(CASE WHEN is_withdrawal THEN 0 ELSE o END AS BIGINT) AS origin_asn,
  CASE WHEN is_withdrawal THEN ''
       WHEN event_id % 4 = 0 THEN concat('3356 ', CAST(5000 + pid % 500 AS STRING), ' 174 ', CAST(o AS STRING))
       WHEN event_id % 4 = 1 THEN concat('1299 2914 3257 ', CAST(o AS STRING))
       WHEN event_id % 4 = 2 THEN concat('6939 ', CAST(o AS STRING), ' ', CAST(o AS STRING))
       WHEN event_id % 16 = 7 THEN concat('64701 64702 64701 ', CAST(o AS STRING))
       WHEN event_id % 16 = 15 AND pid % 4 = 1 THEN concat('174 ', CAST(5000 + pid % 500 AS STRING), ' ', CAST(o AS STRING))
       ELSE concat('6939 ', CAST(5000 + pid % 500 AS STRING), ' ', CAST(5100 + pid % 500 AS STRING), ' ', CAST(o AS STRING)) END AS path_str,
  CASE WHEN event_type = 'purchase' AND pid % 6 = 2 THEN '64500:1 65535:666' ELSE '64496:100' END AS comm_str,
  CASE WHEN sn % 3 = 0 THEN 'routeviews' ELSE 'ris' END AS source
FROM k)
SELECT *, CAST(CASE WHEN path_str = '' THEN 0 ELSE length(path_str) - length(replace(path_str, ' ', '')) + 1 END AS BIGINT) AS path_len,
  CAST(CASE WHEN pid % 13 = 12 THEN 0 ELSE (pid * 3) % 120 - 60 + 0.25 END AS DOUBLE) AS lat,
  CAST(CASE WHEN pid % 13 = 12 THEN 0 ELSE (pid * 7) % 280 - 140 - 0.75 END AS DOUBLE) AS lon,
  CASE WHEN pid % 13 = 12 THEN NULL ELSE concat('CITY_', CAST(pid % 60 AS STRING)) END AS city,
  CASE WHEN pid % 13 = 12 THEN NULL ELSE concat('NATION_', CAST(pid % 25 AS STRING)) END AS country
FROM p""",
    # Known origins: most prefixes, and a few covering ones for longest-prefix match. Three in 22 are
    # nested prefixes that nobody knows: one, one at its address, and one inside it.
    "seen": """
SELECT prefix, CAST(min(1000 + pid) AS BIGINT) AS origin_asn FROM {updates} WHERE pid % 9 <> 8 AND pid % 22 NOT IN (4, 5, 6) GROUP BY prefix
UNION ALL SELECT '24.0.0.0/8', CAST(64500 AS BIGINT) UNION ALL SELECT '2400::/16', CAST(64501 AS BIGINT)
UNION ALL SELECT '20.0.0.0/6', CAST(64502 AS BIGINT) UNION ALL SELECT '2400:100::/23', CAST(64503 AS BIGINT)""",
    "roas": """
SELECT DISTINCT prefix, CAST(CASE WHEN pid % 2 = 0 THEN 48 ELSE 18 END AS INT) AS max_len,
  CAST(CASE WHEN pid % 3 = 0 THEN 1000 + pid ELSE 7777 END AS BIGINT) AS asn
FROM {updates} WHERE pid % 3 < 2
UNION ALL SELECT '20.0.0.0/8', CAST(24 AS INT), CAST(1000 AS BIGINT)
UNION ALL SELECT '2400::/12', CAST(40 AS INT), CAST(1004 AS BIGINT)""",
    "bogons": """
SELECT '192.0.2.0/24' AS prefix UNION ALL SELECT '198.51.100.0/24' UNION ALL SELECT '203.0.113.0/24'
UNION ALL SELECT '10.0.0.0/8' UNION ALL SELECT '2400:4000::/18'""",
    # Networks: customers and suppliers stand for origin ASNs; a few transit networks by hand.
    "as_info": """
SELECT CAST(CASE WHEN c_custkey BETWEEN 8000 AND 8999 OR c_custkey IN (2356, 5939) THEN 4300000000 ELSE 1000 END + c_custkey AS BIGINT) AS asn,
  CASE WHEN c_custkey % 10 = 0 THEN concat('AS', CAST(1000 + c_custkey AS STRING)) WHEN c_custkey % 10 = 1 THEN ''
       WHEN c_custkey % 10 = 2 THEN concat('Google Fiber ', CAST(c_custkey AS STRING)) ELSE c_name END AS name,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' ELSE n_name END AS org_name,
  n_name AS country,
  CAST(CASE WHEN c_custkey % 97 = 0 THEN 0.06 WHEN c_custkey % 97 = 1 THEN 0.02 ELSE 0.001 END AS DOUBLE) AS heg_v4,
  CAST(0.0 AS DOUBLE) AS heg_v6, CAST(CASE WHEN c_custkey % 89 = 0 THEN 0.02 ELSE 0.0 END AS DOUBLE) AS pop_pct,
  CAST(c_custkey * 10000 AS BIGINT) AS pop_users
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT CAST(CASE WHEN s_suppkey < 1000 THEN 9000 ELSE 4200000000 END + s_suppkey AS BIGINT), CASE WHEN s_suppkey % 10 = 2 THEN concat('GOOGLE ', s_name) ELSE s_name END,
  CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE NULL END, n_name, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE),
  CAST(0.0 AS DOUBLE), CAST(0 AS BIGINT)
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT CAST(6939 AS BIGINT), 'HURRICANE', 'Hurricane', 'NATION_1', CAST(0.03 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0 AS BIGINT)
UNION ALL SELECT CAST(3356 AS BIGINT), 'LEVEL3', 'Lumen', 'NATION_2', CAST(0.2 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0 AS BIGINT)""",
    "as_siblings": """
SELECT CAST(1000 + c_custkey AS BIGINT) AS asn1, CAST(9000 + c_custkey % 1000 AS BIGINT) AS asn2
FROM {customer} WHERE c_custkey % 21 = 10""",
    # Locations of prefixes; rank 0 is asked before rank 1.
    "geo": """
SELECT DISTINCT prefix, lat, lon, city, country, CAST(0 AS INT) AS source_rank FROM {updates} WHERE pid % 4 <> 3 AND city IS NOT NULL
UNION ALL SELECT DISTINCT prefix, lat + 1, lon + 1, concat(city, '_B'), country, CAST(1 AS INT) FROM {updates} WHERE pid % 4 >= 2 AND city IS NOT NULL
UNION ALL SELECT '198.18.0.0/16', CAST(10.5 AS DOUBLE), CAST(20.5 AS DOUBLE), 'LAB', 'NATION_0', CAST(1 AS INT)
UNION ALL SELECT '20.0.0.0/6', CAST(1.5 AS DOUBLE), CAST(2.5 AS DOUBLE), 'WIDE', 'NATION_3', CAST(1 AS INT)""",
    # Classified rows by a plain rule, in the schema of the classifier's events: inputs for the
    # operators behind it, so that SQL can state their results. Class by place in the prefix's
    # life, critical classes in runs.
    "classified": """
WITH c AS (
  SELECT u.*, CAST(CASE WHEN pid % 40 = 1 THEN 1
       WHEN pid % 7 = 3 AND update_id % 2 = 0 THEN 2 WHEN pid % 7 = 4 AND update_id % 3 = 0 THEN 10
       WHEN pid % 5 = 0 AND is_withdrawal THEN 4 WHEN pid % 8 = 2 AND update_id % 3 = 1 THEN 3
       WHEN pid % 6 = 2 AND update_id % 5 = 0 THEN 5 WHEN update_id % 7 = 0 THEN 6
       WHEN update_id % 7 = 1 THEN 8 WHEN update_id % 7 = 2 THEN 9 ELSE 0 END AS INT) AS classification
  FROM {updates} u
), d AS (
  SELECT c.*, CAST(coalesce(lag(classification) OVER (PARTITION BY prefix ORDER BY ts, update_id), 0) AS INT) AS old_classification,
    CAST(CASE WHEN is_withdrawal THEN 1000 + pid ELSE origin_asn END AS BIGINT) AS asn FROM c
)
SELECT update_id, ts, prefix, asn, host AS peer_ip, CAST(1000 + pid AS BIGINT) AS historical_asn,
  classification, old_classification,
  CASE WHEN classification IN (2, 3, 4, 10) OR old_classification IN (2, 3, 4, 10)
       THEN concat(prefix, '#', CAST(floor(ts / 600) AS BIGINT)) END AS incident_id,
  CAST(ts - ts % 60 AS BIGINT) AS incident_start_time, source, lat, lon, city, country,
  CAST(CASE WHEN classification = 6 AND update_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS num_flaps,
  is_withdrawal, CAST(classification AS INT) AS state_class, asn AS state_asn,
  CAST(CASE WHEN classification IN (3, 10) THEN 7 WHEN classification = 2 THEN 0 END AS INT) AS leak_type,
  CAST(CASE WHEN classification IN (2, 3, 10) THEN 5000 + pid % 500 END AS BIGINT) AS leaker_asn,
  CAST(CASE WHEN classification IN (2, 3, 10) THEN 3356 END AS BIGINT) AS victim_asn
FROM d""",
}

USES = {
    "updates": ["events"], "seen": ["updates"], "roas": ["updates"], "bogons": [],
    "as_info": ["customer", "nation", "supplier"], "as_siblings": ["customer"], "geo": ["updates"],
    "classified": ["updates"],
}
BASE = ("events", "customer", "supplier", "nation")


_KEPT = {}


def load(spark, sf_dir, name):
    """A given table or a derived one. Derived tables are written out once (checkpoint folder), since
    many queries share them."""
    if name in BASE:
        return spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet"))
    key = (spark.sparkContext.applicationId, str(sf_dir), name)
    if key not in _KEPT:
        parts = {u: load(spark, sf_dir, u) for u in USES[name]}
        sql = TABLES[name].replace("{epoch}", EPOCH["spark"])
        df = spark.sql(sql, **parts) if parts else spark.sql(sql)
        # the given files are small: spread the rows, as a folder of many files would be
        df = df.repartition(spark.sparkContext.defaultParallelism)
        _KEPT[key] = cut(with_events(df) if name == "classified" else df)
    return _KEPT[key]


def with_events(df):
    """Nest leak columns the way classified events hold them."""
    from pyspark.sql import functions as F

    return df.withColumn("leak_detail", F.when(F.col("leak_type").isNotNull(), F.struct(
        "leak_type", "leaker_asn", "victim_asn"))).drop("leak_type", "leaker_asn", "victim_asn").withColumn(
        "anomaly_details", F.lit(None).cast(
            "struct<num_collectors:bigint,num_peers:bigint,num_withdrawals:bigint,"
            "num_announcements:bigint,flap_count:bigint>"))


def dims(spark, sf_dir):
    return {n: load(spark, sf_dir, n) for n in ("seen", "roas", "bogons", "as_info", "as_siblings", "geo")}


def duckdb_ctes(*names):
    """The same tables as a list of DuckDB CTEs (``WITH`` not included), in order of need."""
    done, out = set(BASE), []

    def add(name):
        if name in done:
            return
        for u in USES[name]:
            add(u)
        done.add(name)
        sql = TABLES[name].replace("{epoch}", EPOCH["duckdb"])
        for t in list(USES) + list(BASE):
            sql = sql.replace("{" + t + "}", t)
        out.append(f"{name} AS MATERIALIZED ({sql})")

    for n in names:
        add(n)
    return ",\n".join(out)
