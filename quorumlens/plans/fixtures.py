"""Version logs, request logs, timelines and samples derived from the driver's tables.

Each is one query over the tables; micros is the engine's function for microseconds since 1970 of ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

W1 = """
SELECT key, seq, node, is_deleted, is_restore, value,
       CAST(CASE WHEN node = 'kv-0' OR is_merge THEN c0 ELSE m0 END AS BIGINT) AS v0,
       CAST(CASE WHEN node = 'kv-1' OR is_merge THEN c1 ELSE m1 END AS BIGINT) AS v1,
       CAST(CASE WHEN node = 'kv-2' OR is_merge THEN c2 ELSE m2 END AS BIGINT) AS v2
FROM (
  SELECT *, COALESCE(MAX(CASE WHEN is_merge THEN c0 END) OVER w, 0) AS m0,
            COALESCE(MAX(CASE WHEN is_merge THEN c1 END) OVER w, 0) AS m1,
            COALESCE(MAX(CASE WHEN is_merge THEN c2 END) OVER w, 0) AS m2
  FROM (
    SELECT concat('user-', user_id) AS key, event_id AS seq, concat('kv-', event_id % 3) AS node,
           event_type = 'purchase' AS is_merge, event_type = 'error' AS is_deleted, event_id % 50 = 49 AS is_restore, value,
           SUM(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER w AS c0,
           SUM(CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END) OVER w AS c1,
           SUM(CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END) OVER w AS c2
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) p
  WINDOW w AS (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)) m
"""

W2 = """
SELECT concat('part-', l_partkey) AS key,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS seq,
       CAST(l_suppkey % 6 AS INT) AS layer_rank,
       CAST(l_linenumber % 3 AS BIGINT) AS v0, CAST(l_suppkey % 4 AS BIGINT) AS v1,
       CAST(CAST(round(l_quantity) AS BIGINT) % 3 AS BIGINT) AS v2,
       l_returnflag = 'R' AS is_deleted, CAST(round(l_extendedprice * 100) AS BIGINT) AS value
FROM lineitem
"""

Q1 = """
SELECT concat('t', user_id % 3) AS test, event_id AS seq,
       CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'put' ELSE 'get' END AS op,
       concat('key-', lpad(CAST(user_id AS VARCHAR(20)), 7, '0')) AS key,
       CASE WHEN event_id % 11 = 0 THEN concat('svc-', event_id % 4) ELSE concat('kv-', event_id % 6) END AS target,
       {micros} * 1000 AS start,
       {micros} * 1000 + CAST(round(value * 100) AS BIGINT) * 10000 AS {end},
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'failed'
            WHEN event_type = 'error' THEN 'unknown'
            WHEN event_type = 'view' AND event_id % 9 = 0 THEN 'notfound'
            WHEN event_type = 'click' AND event_id % 17 = 0 THEN 'mismatch'
            WHEN event_type = 'signup' AND event_id % 19 = 0 THEN 'dropped' ELSE 'ok' END AS result
FROM events
"""

T = """
SELECT * FROM (VALUES
  ('t0', 'inject', 'down:kv-0,kv-2', CAST(NULL AS VARCHAR(20)), 1704844800000000000),
  ('t0', 'mark', NULL, 'serving-kv-2', 1705276800000000000),
  ('t0', 'mark', NULL, 'serving', 1705363200000000000),
  ('t0', 'heal', NULL, NULL, 1705449600000000000),
  ('t1', 'inject', 'partition:kv-1,kv-4', NULL, 1705017600000000000),
  ('t1', 'heal', NULL, NULL, 1705622400000000000)) AS t(test, event, fault, mark, time_ns)
"""

MT = """
SELECT concat('pod-', event_id % 4) AS instance, CASE WHEN event_type = 'error' THEN 'ERR' ELSE 'OK' END AS code,
       {micros} AS time_us, event_id AS sample, (event_id * 7) % 1000 AS counter_value
FROM events
"""

RBK = """
SELECT key, CAST(k AS BIGINT) + 1000 * pass AS time_ns, pass,
       CASE WHEN k % 41 = 0 THEN 'notfound' WHEN k % 37 = 0 AND pass = 1 THEN 'unknown'
            WHEN k % 31 = 0 THEN 'failed' ELSE 'ok' END AS result,
       3 AS n_owners, CASE WHEN k % 7 = 0 THEN 2 ELSE 3 END AS n_holders
FROM (SELECT DISTINCT user_id AS k, concat('key-', lpad(CAST(user_id AS VARCHAR(20)), 7, '0')) AS key FROM events WHERE user_id % 13 <> 0) u
CROSS JOIN (VALUES (1), (2)) AS p(pass)
"""

RS = """
SELECT * FROM (VALUES
  (1, 10, 0, 432000), (2, 20, 518400, 950400), (3, 30, 1036800, 1468800), (4, 40, 1555200, 1987200)) AS t(step, target_rate, from_s, to_s)
"""

MAN = """
SELECT * FROM (VALUES
  (1, 'ADD', 'sst_001'), (2, 'ADD', 'sst_002'), (3, 'ADD', 'sst_003'), (4, 'ADD', 'sst_004'), (5, 'ADD', 'sst_004_c'),
  (6, 'REMOVE', 'sst_001'), (7, 'REMOVE', 'sst_002'), (8, 'REMOVE', 'sst_003'), (9, 'REMOVE', 'sst_004'), (10, 'ADD', 'sst_005')) AS t(seq, op, id)
"""

FILES = """
SELECT * FROM (VALUES
  (1, 'sst_010', 900), (2, 'sst_009', 5100), (3, 'sst_008', 4800), (4, 'sst_007', 5300), (5, 'sst_006', 9999),
  (6, 'sst_005', 10000), (7, 'sst_004', 1200), (8, 'sst_003', 1300), (9, 'sst_002', 1400), (10, 'sst_001', 1500)) AS t(newest_rank, id, size)
"""

CODES = """
SELECT * FROM (VALUES
  ('Canceled', 'context canceled'), ('DeadlineExceeded', 'deadline'), ('Unavailable', 'write quorum not reached for key "a"'),
  ('Unavailable', 'connection refused'), ('Unavailable', 'forward put: no replica accepted the write'),
  ('Unavailable', 'local write failed for key "b"'), ('Internal', 'boom'), (NULL, NULL)) AS t(code, msg)
"""

SPECS = """
SELECT * FROM (VALUES ('none'), ('down:kv-2,kv-0,kv-2'), ('partition:kv-1,kv-4'), ('down:kv-5')) AS t(spec)
"""

STAGES = """
SELECT * FROM (VALUES (1, 100, 10, 60), (2, 201, 11, 60), (3, 300, 10, 45)) AS t(place, rate, move, hold)
"""

ANN = """
SELECT * FROM (VALUES
  ('n1', 1, 5, 'f5'), ('n1', 2, 4, 'f4'), ('n1', 3, 5, 'f5'), ('n1', 4, 5, 'x5'), ('n1', 5, 6, 'f6'),
  ('n2', 1, 6, 'f6'), ('n2', 2, 6, 'f6'), ('n2', 3, 5, 'f5'), ('n3', 1, 6, 'x6')) AS t(node, seq, epoch, fingerprint)
"""

FIXTURES = {"W1": W1, "W2": W2, "Q1": Q1, "T": T, "MT": MT, "RBK": RBK, "RS": RS, "MAN": MAN, "FILES": FILES, "CODES": CODES, "SPECS": SPECS, "STAGES": STAGES, "ANN": ANN}
SPARK = {"micros": "unix_micros(CAST(ts AS TIMESTAMP))", "end": "`end`"}
DUCK = {"micros": "epoch_us(ts)", "end": '"end"'}


def text(name: str, words: dict[str, str]) -> str:
    sql = FIXTURES[name]
    for k, v in words.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived fixture over the tables of sf_dir."""
    sql = text(name, SPARK)
    for t in ("events", "lineitem"):
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem") if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def with_clause(*names: str) -> str:
    """The fixtures as CTEs of DuckDB SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({text(n, DUCK)})" for n in names)
