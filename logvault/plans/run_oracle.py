"""DuckDB reference SQL for the run-analytics queries (fixtures of FIXTURES.md §4)."""

from __future__ import annotations

SAMPLES = """
WITH s AS (
  SELECT user_id AS run_id, ts,
         CASE event_type WHEN 'click' THEN 'java' WHEN 'view' THEN 'python3'
              WHEN 'purchase' THEN '/opt/java/openjdk/bin/java' WHEN 'signup' THEN 'bash'
              WHEN 'error' THEN 'jav' ELSE 'sh' END AS command,
         CAST(trunc(value * 100) AS BIGINT) * 1024 AS rss_bytes
  FROM events),
rel AS (
  SELECT * FROM s WHERE EXISTS (
    SELECT 1 FROM (VALUES ('python3'), ('java'), ('/opt/java/openjdk/bin/java')) r(name)
    WHERE starts_with(r.name, s.command))),
tot AS (
  SELECT run_id, date_trunc('hour', ts) AS sample_ts, CAST(sum(rss_bytes) AS BIGINT) AS total_rss_bytes
  FROM rel GROUP BY run_id, date_trunc('hour', ts)),
st AS (
  SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS result,
         sum(CAST(trunc(value * 100) AS BIGINT)) AS s, max(CAST(trunc(value * 100) AS BIGINT)) AS mx
  FROM events GROUP BY user_id),
runs AS (
  SELECT user_id AS run_id, ['tool_a', 'tool_b', 'tool_c', 'tool_d'][user_id % 4 + 1] AS tool,
         'mongod' AS dataset,
         CASE WHEN user_id % 8 < 4 THEN '{}' ELSE '{"dataset_variation": "cleaned_log"}' END AS config,
         CASE WHEN (user_id // 8) % 13 = 0 THEN 'ingest' WHEN (user_id // 8) % 13 <= 6 THEN 'cold'
              ELSE 'hot' END AS phase,
         CASE WHEN (user_id // 8) % 13 = 0 THEN NULL ELSE CAST(((user_id // 8) % 13 - 1) % 6 AS INTEGER) END
           AS query_ind,
         start, "end", result, s, mx
  FROM st),
lng AS (
  SELECT tool, dataset, config, phase, query_ind, strftime(start, '%Y-%m-%d %H:%M:%S') AS start_time,
         m.metric, m.value
  FROM runs, LATERAL (
    SELECT 'time_taken_s' AS metric, s / 100.0 AS value
    UNION ALL SELECT 'memory_average_B', CASE WHEN run_id % 7 = 0 THEN -1.0 ELSE mx * 10000.0 END
    UNION ALL SELECT 'compressed_size_B', CAST(CASE WHEN run_id % 50 = 0 THEN 0 ELSE result * 1000 END AS DOUBLE)
                WHERE phase = 'ingest'
    UNION ALL SELECT 'decompressed_size_B', CAST(result * 3000 AS DOUBLE) WHERE phase = 'ingest'
    UNION ALL SELECT 'result', CAST(result AS DOUBLE) WHERE phase <> 'ingest') m),
both_phases AS (
  SELECT tool, dataset, config FROM lng WHERE phase IN ('cold', 'hot')
  GROUP BY tool, dataset, config HAVING count(DISTINCT phase) = 2),
lab AS (
  SELECT *, tool || ' (' || CASE WHEN config = '{}' THEN '' ELSE 'dataset_variation=cleaned_log' END || ')'
            AS methodology
  FROM lng
  WHERE phase = 'ingest' OR (tool, dataset, config) IN (SELECT (tool, dataset, config) FROM both_phases)),
rep AS (
  SELECT dataset || ' (ingest)' AS sheet, methodology,
         CASE metric WHEN 'memory_average_B' THEN 'memory_average_MB'
                     WHEN 'compressed_size_B' THEN 'compressed_size_MB'
                     WHEN 'decompressed_size_B' THEN 'decompressed_size_MB' ELSE metric END AS metric,
         CASE WHEN metric IN ('memory_average_B', 'compressed_size_B', 'decompressed_size_B')
              THEN nullif(value, -1.0) / 1048576.0 ELSE value END AS value, start_time
  FROM lab WHERE phase = 'ingest'
  UNION ALL
  SELECT dataset || ' (ingest)', methodology, 'compression_ratio',
         CASE WHEN c <> 0 THEN d / c END, st
  FROM (SELECT dataset, methodology,
               max(CASE WHEN metric = 'decompressed_size_B' THEN v END) AS d,
               max(CASE WHEN metric = 'compressed_size_B' THEN v END) AS c, max(st) AS st
        FROM (SELECT dataset, methodology, metric, value AS v, start_time AS st,
                     row_number() OVER (PARTITION BY dataset, methodology, metric
                                        ORDER BY start_time DESC, value DESC) AS rn
              FROM lab WHERE phase = 'ingest') WHERE rn = 1
        GROUP BY dataset, methodology)
  UNION ALL
  SELECT dataset || ' (search)', methodology, 'q' || CAST(query_ind AS VARCHAR) || '_' || phase, value, start_time
  FROM lab WHERE phase IN ('cold', 'hot') AND metric = 'time_taken_s'
  UNION ALL
  SELECT dataset || ' (result)', methodology, 'q' || CAST(query_ind AS VARCHAR) || '_' || phase, value, start_time
  FROM lab WHERE phase IN ('cold', 'hot') AND metric = 'result'
  UNION ALL
  SELECT dataset || ' (search)', methodology, 'memory_average_' || phase || '_MB', avg(value) / 1048576.0,
         max(start_time)
  FROM lab WHERE phase IN ('cold', 'hot') AND metric = 'memory_average_B' AND value <> -1
  GROUP BY dataset, methodology, phase)
"""

TOOLS = ["tool_a", "tool_b", "tool_c", "tool_d"]
METHODOLOGIES = sorted(f"{t} ({c})" for t in TOOLS for c in ("", "dataset_variation=cleaned_log"))


def _pivot() -> str:
    cols = ", ".join(f"max(CASE WHEN methodology = '{m}' THEN value END) AS \"{m}\"" for m in METHODOLOGIES)
    return (SAMPLES + ", latest AS (SELECT sheet, metric, methodology, value FROM ("
            "SELECT *, row_number() OVER (PARTITION BY sheet, metric, methodology "
            "ORDER BY start_time DESC, value DESC) AS rn FROM rep) WHERE rn = 1)\n"
            f"SELECT sheet, metric, {cols} FROM latest GROUP BY sheet, metric")


ORACLES = {
    "parse_ps": SAMPLES + "SELECT run_id, ts, command, rss_bytes FROM s",
    "related_samples": SAMPLES + "SELECT run_id, ts, command, rss_bytes FROM rel",
    "sample_total": SAMPLES + "SELECT run_id, sample_ts, total_rss_bytes FROM tot",
    "run_memory": SAMPLES + """
SELECT r.run_id, r.tool, r.phase, date_diff('microsecond', r.start, r."end") / 1000000.0 AS time_taken_s,
       coalesce(m.m, -1.0) AS memory_average_B
FROM runs r LEFT JOIN (SELECT run_id, avg(total_rss_bytes) AS m FROM tot GROUP BY run_id) m USING (run_id)""",
    "results_long": SAMPLES + """
SELECT tool, dataset, config, phase, query_ind, start_time, metric, value FROM lng""",
    "report_long": SAMPLES + "SELECT sheet, methodology, metric, value FROM rep",
    "report_pivot": _pivot(),
}
