"""The same results in DuckDB SQL, over the driver's table views."""

from __future__ import annotations

# As in the replay: arrival time of one delivery.
SLICE_MS = 360_000


def label(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%d %H:%M:%S')"


def cents(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


M1 = "CAST(SUM(measure1) AS BIGINT)"
M2 = "CAST(SUM(CAST(measure2 AS DECIMAL(18,2))) AS DOUBLE)"

FEED = """
base AS (
  SELECT event_id AS s, 'dev-' || (user_id % 4) || '-' || event_id AS message_id,
         'dev-' || (user_id % 4) AS device_id, event_type AS category,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS measure1, value AS measure2,
         1704067200000 + event_id * 50 AS send_ms
  FROM events),
orig AS (
  SELECT *,
         CASE WHEN (s * 7919) % 1000 < 10 THEN send_ms - 120000 - (s * 104729) % 300000
              ELSE send_ms END AS device_ms,
         CASE WHEN (s * 7919) % 1000 < 10 THEN 'late' ELSE '' END AS patterncode
  FROM base),
resent AS (
  SELECT o.s, o.message_id, o.device_id, o.category, o.measure1, o.measure2,
         t.send_ms + 1 AS send_ms, o.device_ms, 're' AS patterncode
  FROM orig t JOIN orig o ON o.s = (t.s * ((t.s * 31) % 1000)) // 1000
  WHERE (t.s * 15485863) % 1000 < 50),
feed AS (SELECT * FROM orig UNION ALL SELECT * FROM resent)"""

LINES = FEED + """,
lines AS (
  SELECT *, message_id || '|' || device_id || '|' || device_ms || '|' || category || '|' ||
         measure1 || '|' || CAST(measure2 AS VARCHAR) AS line
  FROM feed)"""

# Arrival batches of 5 s and the watermark each of them sees.
ON_TIME = FEED + """,
wm AS (
  SELECT b, MAX(mx) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS wm_ms
  FROM (SELECT send_ms // 5000 AS b, MAX(device_ms) AS mx FROM feed GROUP BY 1)),
ontime AS (
  SELECT f.* FROM feed f JOIN wm ON wm.b = f.send_ms // 5000
  WHERE wm.wm_ms IS NULL OR (f.device_ms // 5000 + 1) * 5000 > wm.wm_ms)"""

SLICED = FEED + f""",
sliced AS (SELECT feed.*, send_ms // {SLICE_MS} AS b FROM feed)"""

# The same rule with the slices of a replay as arrival batches.
SLICED_ON_TIME = SLICED + """,
wm AS (
  SELECT b, MAX(mx) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS wm_ms
  FROM (SELECT b, MAX(device_ms) AS mx FROM sliced GROUP BY 1)),
ontime AS (
  SELECT f.* FROM sliced f JOIN wm USING (b)
  WHERE wm.wm_ms IS NULL OR (f.device_ms // 5000 + 1) * 5000 > wm.wm_ms)"""


def first_per_window(source: str, time: str) -> str:
    """First copy per message id and 5 s window ``w`` of ``time``."""
    return f"""
  SELECT message_id, {time} // 5000 AS w, MIN(send_ms) AS send_ms,
         ARG_MIN(device_ms, send_ms) AS device_ms,
         ARG_MIN(device_id, send_ms) AS device_id, ARG_MIN(category, send_ms) AS category,
         ARG_MIN(measure1, send_ms) AS measure1, ARG_MIN(measure2, send_ms) AS measure2
  FROM {source} GROUP BY 1, 2"""


def last_per_window(source: str, bucket: str) -> str:
    return f"""
  SELECT message_id, {bucket} AS w, MAX(send_ms) AS send_ms,
         ARG_MAX(device_ms, send_ms) AS device_ms,
         ARG_MAX(device_id, send_ms) AS device_id, ARG_MAX(category, send_ms) AS category,
         ARG_MAX(measure1, send_ms) AS measure1, ARG_MAX(measure2, send_ms) AS measure2
  FROM {source} GROUP BY 1, 2"""


def sums(ctes: str, rows: str, time: str = "(w + 1) * 5000") -> str:
    """Labelled sums over ``rows``, which has ``w``, the keys and the measures."""
    return f"""WITH {ctes}, rows AS ({rows})
SELECT {label(time)} AS window_time, device_id, category, {M1} AS m1_sum, {M2} AS m2_sum
FROM rows GROUP BY w, device_id, category"""


def wide(ctes: str, down: str, down_label: str = "(w + 1) * 5000") -> str:
    """CTEs up to ``wide``: both truths and the sums of the job per key."""
    def side(name: str, rows: str, time: str) -> str:
        return f"""
{name} AS (
  SELECT {label(time)} AS window_time, device_id, category, CAST(SUM(measure1) AS BIGINT) AS m1,
         SUM(CAST(measure2 AS DECIMAL(18,2))) AS m2
  FROM ({rows}) GROUP BY 1, 2, 3)"""

    originals = "SELECT *, {} // 5000 AS w FROM feed WHERE patterncode <> 're'"
    return f"""WITH {ctes},
{side('down', down, down_label)},
{side('dt', originals.format('device_ms'), '(w + 1) * 5000')},
{side('st', originals.format('send_ms'), '(w + 1) * 5000')},
wide AS (
  SELECT window_time, device_id, category,
         st.m1 AS m1_sum_ingest_sendtime, dt.m1 AS m1_sum_ingest_devicetime,
         down.m1 AS m1_sum_downstream,
         CAST(st.m2 AS DOUBLE) AS m2_sum_ingest_sendtime,
         CAST(dt.m2 AS DOUBLE) AS m2_sum_ingest_devicetime,
         CAST(down.m2 AS DOUBLE) AS m2_sum_downstream,
         down.m1 - dt.m1 AS delta_m1_sum_downstream_ingestdevice,
         CAST(down.m2 - dt.m2 AS DOUBLE) AS delta_m2_sum_downstream_ingestdevice
  FROM dt FULL OUTER JOIN st USING (window_time, device_id, category)
          FULL OUTER JOIN down USING (window_time, device_id, category))
"""


EVENT = wide(ON_TIME, first_per_window("ontime", "device_ms"))
ARRIVAL = wide(FEED, first_per_window("feed", "send_ms"))
MICROBATCH = wide(FEED, last_per_window("feed", "send_ms // 5000"))
STREAM_EVENT = wide(SLICED_ON_TIME, first_per_window("ontime", "device_ms"))

DEBUG = f"""
  'windowed - ' || message_id || ' - ' || ((w + 1) * 5000) AS id,
  'MESSAGE_ID=' || message_id || ', DEVICE_ID=' || device_id || ', TIMESTAMP=' || device_ms ||
  ', time window start=' || (w * 5000) || ', time window end=' || ((w + 1) * 5000) ||
  ', CATEGORY=' || category || ', M1=' || measure1 || ', M2=' || CAST(measure2 AS VARCHAR) AS message"""

EVENT_COLUMNS = "message_id, device_id, device_ms, category, measure1, measure2"
WORD_COUNT = """
SELECT word, COUNT(*) AS n
FROM (SELECT UNNEST(string_split_regex(lower(text), '\\W+')) AS word FROM documents)
WHERE length(word) > 0 GROUP BY word"""

ORACLES: dict[str, str] = {
    # codec
    "encode_payload": f"WITH {LINES} SELECT send_ms, line AS value FROM lines",
    "parse_payload": f"""WITH {LINES}
        SELECT split_part(line, '|', 1) AS message_id, split_part(line, '|', 2) AS device_id,
               CAST(split_part(line, '|', 3) AS BIGINT) AS device_ms,
               split_part(line, '|', 4) AS category,
               CAST(split_part(line, '|', 5) AS BIGINT) AS measure1,
               CAST(split_part(line, '|', 6) AS DOUBLE) AS measure2, send_ms,
               {label("CAST(split_part(line, '|', 3) AS BIGINT)")} ||
               CASE WHEN device_ms % 1000 = 0 THEN ''
                    ELSE rtrim('.' || lpad(CAST(device_ms % 1000 AS VARCHAR), 3, '0'), '0')
               END AS event_time
        FROM lines""",
    "quarantine_malformed": f"""WITH {LINES}
        SELECT CASE s % 40
                 WHEN 0 THEN message_id || '|' || device_id
                 WHEN 1 THEN message_id || '|' || device_id || '|soon|' || category || '|' ||
                             measure1 || '|' || CAST(measure2 AS VARCHAR)
                 WHEN 2 THEN message_id || '|' || device_id || '|' || device_ms || '|' || category ||
                             '|x|' || CAST(measure2 AS VARCHAR)
                 WHEN 3 THEN message_id || '|' || device_id || '|' || device_ms || '|' || category ||
                             '|' || measure1 || '|'
                 WHEN 4 THEN NULL
                 WHEN 5 THEN '|' || device_id || '|' || device_ms || '|' || category || '|' ||
                             measure1 || '|' || CAST(measure2 AS VARCHAR)
                 WHEN 6 THEN message_id || '||' || device_ms || '|' || category || '|' ||
                             measure1 || '|' || CAST(measure2 AS VARCHAR)
                 WHEN 7 THEN message_id || '|' || device_id || '|' || device_ms || '||' ||
                             measure1 || '|' || CAST(measure2 AS VARCHAR)
                 ELSE message_id || '|' || device_id || '|' || device_ms || '|' || category || '|' ||
                      measure1 || '|' || CASE s % 40 WHEN 8 THEN 'NaN' WHEN 9 THEN '-Infinity' ELSE '0.125' END
               END AS value,
               CASE s % 40
                 WHEN 0 THEN 'too few fields' WHEN 1 THEN 'bad timestamp' WHEN 2 THEN 'bad measure1'
                 WHEN 4 THEN 'empty value' WHEN 5 THEN 'empty message_id' WHEN 6 THEN 'empty device_id'
                 WHEN 7 THEN 'empty category' ELSE 'bad measure2' END AS reason
        FROM lines WHERE s % 40 < 11""",
    "damaged_sums": f"""WITH {FEED}
        SELECT COUNT(*) AS lines, COUNT(*) FILTER (WHERE s % 40 >= 11) AS good,
               COUNT(*) FILTER (WHERE s % 40 < 11) AS quarantined,
               CAST(SUM(measure1) FILTER (WHERE s % 40 >= 11) AS BIGINT) AS m1_sum,
               CAST(SUM(CAST(measure2 AS DECIMAL(18,2))) FILTER (WHERE s % 40 >= 11) AS DOUBLE) AS m2_sum
        FROM feed""",
    "render_event": f"""WITH {FEED}
        SELECT send_ms,
               message_id || chr(9) || device_id || chr(9) || device_ms || chr(9) || category ||
               chr(9) || measure1 || chr(9) || CAST(measure2 AS VARCHAR) || chr(10) AS tab,
               message_id || ',' || device_id || ', ' || device_ms || ', ' || category || ',' ||
               measure1 || ', ' || CAST(measure2 AS VARCHAR) AS comma
        FROM feed""",
    "render_aggregate": f"""WITH sums AS ({sums(FEED, last_per_window("feed", "send_ms // 5000"))})
        SELECT window_time || chr(9) || device_id || chr(9) || category || chr(9) || m1_sum ||
               chr(9) || CAST(m2_sum AS VARCHAR) || chr(10) AS line
        FROM sums""",
    "epoch_to_timestamp": f"""WITH {FEED}
        SELECT message_id, send_ms,
               {label("device_ms")} ||
               CASE WHEN device_ms % 1000 = 0 THEN ''
                    ELSE rtrim('.' || lpad(CAST(device_ms % 1000 AS VARCHAR), 3, '0'), '0')
               END AS device_time,
               {label("device_ms")} AS whole_second
        FROM feed""",
    "window_label_end": f"""WITH {FEED}
        SELECT message_id, send_ms, {label("(device_ms // 5000 + 1) * 5000")} AS window_time FROM feed""",
    "window_label_start": f"""WITH {FEED}
        SELECT message_id, send_ms, {label("device_ms // 5000 * 5000")} AS window_time FROM feed""",
    "lateness_seconds": f"""WITH {FEED}
        SELECT message_id, send_ms, patterncode, (send_ms - device_ms) / 1000.0::DOUBLE AS late_by FROM feed""",
    "key_text_parse": f"""WITH {FEED}
        SELECT DISTINCT '[' || device_id || ', ' || category || '@' || (send_ms // 5000 * 5000) || ']' AS key_text,
               device_id, category, {label("(send_ms // 5000 + 1) * 5000")} AS window_time
        FROM feed""",
    # feed
    "feed_base": f"WITH {FEED} SELECT * FROM base",
    "feed_late": f"WITH {FEED} SELECT * FROM orig WHERE patterncode = 'late'",
    "feed_resend": f"WITH {FEED} SELECT * FROM resent",
    "feed": f"WITH {FEED} SELECT * FROM feed",
    # deduplication
    "dedup_first_per_window": f"""WITH {FEED}, rows AS ({first_per_window("feed", "device_ms")})
        SELECT {EVENT_COLUMNS}, send_ms, {label("(w + 1) * 5000")} AS window_time FROM rows""",
    "dedup_last_per_window": f"""WITH {FEED}, rows AS ({last_per_window("feed", "send_ms // 5000")})
        SELECT {EVENT_COLUMNS}, send_ms, {label("(w + 1) * 5000")} AS window_time FROM rows""",
    "dedup_last_per_batch": f"""WITH {FEED}, rows AS ({last_per_window("feed", "send_ms // 60000")})
        SELECT w * 60000 AS batch, {EVENT_COLUMNS}, send_ms FROM rows""",
    "dedup_rows": f"WITH {FEED} SELECT DISTINCT {EVENT_COLUMNS} FROM feed",
    "dedup_first_per_id": f"""WITH {FEED}
        SELECT {EVENT_COLUMNS}, send_ms FROM feed
        QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY send_ms) = 1""",
    # aggregates
    "agg_event_time": sums(ON_TIME, first_per_window("ontime", "device_ms")),
    "agg_processing_time": sums(FEED, first_per_window("feed", "send_ms")),
    "agg_ingestion_time": sums(FEED, first_per_window("feed", "send_ms")),
    "agg_microbatch": sums(FEED, last_per_window("feed", "send_ms // 5000")),
    "agg_complete": sums(FEED, "SELECT *, device_ms // 5000 AS w FROM feed", "w * 5000"),
    "agg_changelog": sums(FEED, last_per_window("feed", "send_ms // 5000")),
    "agg_sliding": f"""WITH {FEED},
        starts AS (
          SELECT feed.*, device_ms // 1000 - k AS w
          FROM feed, UNNEST([0, 1, 2, 3, 4]) AS k(k)),
        rows AS (
          SELECT message_id, w, ANY_VALUE(device_id) AS device_id, ANY_VALUE(category) AS category,
                 ANY_VALUE(measure1) AS measure1, ANY_VALUE(measure2) AS measure2
          FROM starts GROUP BY 1, 2)
        SELECT {label("w * 1000 + 5000")} AS window_time, device_id, category, {M1} AS m1_sum, {M2} AS m2_sum
        FROM rows GROUP BY w, device_id, category""",
    "truth_devicetime": f"""WITH {FEED}
        SELECT {label("(device_ms // 5000 + 1) * 5000")} AS window_time, device_id, category,
               {M1} AS m1_sum_ingest_devicetime, {M2} AS m2_sum_ingest_devicetime
        FROM feed WHERE patterncode <> 're' GROUP BY 1, 2, 3""",
    "truth_sendtime": f"""WITH {FEED}
        SELECT {label("(send_ms // 5000 + 1) * 5000")} AS window_time, device_id, category,
               {M1} AS m1_sum_ingest_sendtime, {M2} AS m2_sum_ingest_sendtime
        FROM feed WHERE patterncode <> 're' GROUP BY 1, 2, 3""",
    "debug_window_rows": f"""WITH {FEED}, rows AS ({first_per_window("feed", "device_ms")})
        SELECT {DEBUG} FROM rows""",
    "late_dropped": f"""WITH {ON_TIME}
        SELECT message_id, send_ms, device_ms, patterncode,
               (device_ms // 5000 + 1) * 5000 AS window_end_ms, wm_ms AS watermark_ms
        FROM feed JOIN wm ON wm.b = send_ms // 5000
        WHERE (device_ms // 5000 + 1) * 5000 <= wm_ms""",
    # tables
    "upsert_full": f"""{EVENT}
        SELECT window_time, device_id, category,
               COALESCE(m1_sum_downstream, m1_sum_ingest_devicetime) AS m1_sum,
               COALESCE(m2_sum_downstream, m2_sum_ingest_devicetime) AS m2_sum
        FROM wide WHERE COALESCE(m1_sum_downstream, m1_sum_ingest_devicetime) IS NOT NULL""",
    "upsert_partial": f"""{EVENT}
        SELECT * EXCLUDE (delta_m1_sum_downstream_ingestdevice, delta_m2_sum_downstream_ingestdevice)
        FROM wide""",
    "raw_events_upsert": f"""WITH {FEED}
        SELECT message_id, device_id, device_ms, send_ms, category,
               CASE WHEN patterncode <> '' THEN measure1 + 1000 ELSE measure1 END AS measure1, measure2
        FROM feed""",
    "scan_raw_events": f"""WITH {FEED}
        SELECT message_id, device_id, device_ms, send_ms, category, measure1, measure2 FROM feed""",
    "table_counts": f"""{EVENT}, kept AS ({first_per_window("ontime", "device_ms")})
        SELECT 'raw_events' AS table_name, COUNT(*) AS n FROM (SELECT DISTINCT message_id, send_ms FROM feed)
        UNION ALL SELECT 'agg_events', COUNT(*) FROM wide
        UNION ALL SELECT 'debug', COUNT(*) FROM kept""",
    # comparison
    "reconcile": f"""{EVENT}
        SELECT * EXCLUDE (delta_m1_sum_downstream_ingestdevice, delta_m2_sum_downstream_ingestdevice)
        FROM wide""",
    "reconcile_report": f"{EVENT} SELECT * FROM wide ORDER BY device_id, category, window_time",
    "reconcile_exceptions": f"""{EVENT}
        SELECT window_time, device_id, category, m1_sum_ingest_devicetime, m1_sum_downstream,
               delta_m1_sum_downstream_ingestdevice
        FROM wide WHERE delta_m1_sum_downstream_ingestdevice IS DISTINCT FROM 0""",
    "reconcile_counts": f"""{EVENT},
        totals AS (
          SELECT COUNT(*) FILTER (WHERE delta_m1_sum_downstream_ingestdevice IS DISTINCT FROM 0) AS exceptions,
                 COUNT(*) AS total
          FROM wide)
        SELECT exceptions, total, exceptions || ' exceptions out of ' || total AS summary FROM totals""",
    "scenario_event": f"{EVENT} SELECT * FROM wide ORDER BY device_id, category, window_time",
    "scenario_processing": f"{ARRIVAL} SELECT * FROM wide ORDER BY device_id, category, window_time",
    "scenario_ingestion": f"{ARRIVAL} SELECT * FROM wide ORDER BY device_id, category, window_time",
    "scenario_microbatch": f"{MICROBATCH} SELECT * FROM wide ORDER BY device_id, category, window_time",
    # reports and the small jobs
    "filter_sort_limit": f"""{EVENT}
        SELECT window_time, device_id, category, m2_sum_ingest_devicetime, m2_sum_ingest_sendtime,
               m2_sum_downstream
        FROM wide WHERE category = 'view' ORDER BY category, device_id, window_time LIMIT 100""",
    "limit_n": f"""WITH {FEED}, rows AS ({first_per_window("feed", "device_ms")})
        SELECT LEAST(COUNT(*), 100) AS n_taken, LEAST(COUNT(*), 100) AS n_found FROM rows""",
    "wordcount": WORD_COUNT,
    "time_spine": f"""
        SELECT i, at_ms, 'user_id:' || i || ';' || {label("at_ms")} || ';event_number_' || i AS value
        FROM (SELECT event_id + 1 AS i, 1430438400000 + (event_id + 11) * 60000 AS at_ms FROM events)""",
    "pi_estimate": """
        SELECT inside, n, 4.0::DOUBLE * inside / n AS pi
        FROM (
          SELECT CAST(COUNT(*) FILTER (WHERE x * x + y * y <= 100000000) AS BIGINT) AS inside, COUNT(*) AS n
          FROM (
            SELECT (k * 48271 % 2147483647) % 20001 - 10000 AS x,
                   (k * 69621 % 2147483647) % 20001 - 10000 AS y
            FROM (SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS k FROM lineitem)))""",
    # streams
    "stream_event_time": sums(SLICED_ON_TIME, first_per_window("ontime", "device_ms")),
    "stream_event_time_update": sums(SLICED_ON_TIME, first_per_window("ontime", "device_ms")),
    "stream_ingestion_time": sums(FEED, first_per_window("feed", "send_ms")),
    "stream_complete": sums(FEED, "SELECT *, device_ms // 5000 AS w FROM feed", "w * 5000"),
    "stream_changelog": f"""WITH {SLICED_ON_TIME},
        rows AS (
          SELECT message_id, device_ms // 5000 AS w, MIN(b) AS b, ARG_MIN(device_id, send_ms) AS device_id,
                 ARG_MIN(category, send_ms) AS category, ARG_MIN(measure1, send_ms) AS measure1,
                 ARG_MIN(measure2, send_ms) AS measure2
          FROM ontime GROUP BY 1, 2),
        steps AS (
          SELECT w, device_id, category, b, SUM(measure1) AS m1, SUM(CAST(measure2 AS DECIMAL(18,2))) AS m2
          FROM rows GROUP BY ALL)
        SELECT {label("(w + 1) * 5000")} AS window_time, device_id, category,
               row_number() OVER so_far AS version, CAST(SUM(m1) OVER so_far AS BIGINT) AS m1_sum,
               CAST(SUM(m2) OVER so_far AS DOUBLE) AS m2_sum
        FROM steps WINDOW so_far AS (PARTITION BY w, device_id, category ORDER BY b)""",
    "stream_last_copy": sums(FEED, last_per_window("feed", "send_ms // 5000")),
    "stream_microbatch": sums(SLICED, last_per_window("sliced", "b"), f"(w + 1) * {SLICE_MS}"),
    "stream_debug_rows": f"""WITH {SLICED_ON_TIME}, rows AS ({first_per_window("ontime", "device_ms")})
        SELECT {DEBUG} FROM rows""",
    "dedup_within_watermark": f"WITH {FEED} SELECT DISTINCT {EVENT_COLUMNS} FROM feed",
    # A slice's watermark is half a slice below the one before it; an id is kept for half a slice from its own.
    "stream_dedup_bounded": f"""WITH RECURSIVE {FEED},
        arrived AS (SELECT DISTINCT message_id, device_ms, device_id, category, measure1, send_ms // 120000 * 120000 AS slice_ms FROM feed),
        seen AS (SELECT slice_ms, LAG(slice_ms) OVER (ORDER BY slice_ms) - 60000 AS wm_ms FROM (SELECT DISTINCT slice_ms FROM arrived)),
        through AS (
          SELECT message_id, MIN(slice_ms) AS slice_ms FROM arrived GROUP BY 1
          UNION ALL
          SELECT t.message_id, MIN(a.slice_ms) FROM through t JOIN arrived a USING (message_id) JOIN seen ON seen.slice_ms = a.slice_ms
          WHERE seen.wm_ms >= t.slice_ms + 60000 GROUP BY 1)
        SELECT message_id, device_ms, device_id, category, measure1, slice_ms FROM through JOIN arrived USING (message_id, slice_ms)""",
    # The clock is at the end of each slice but a millisecond, six seconds ahead of its watermark.
    "stream_idle": sums(FEED + """,
        flow AS (SELECT feed.*, send_ms // 120000 AS b FROM feed WHERE (send_ms // 120000) % 4 <> 2),
        wm AS (
          SELECT b, CASE WHEN b > MIN(b) OVER () THEN GREATEST(
                   MAX(mx) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000, b * 120000 - 6001) END AS wm_ms
          FROM (SELECT b, MAX(device_ms) AS mx FROM flow GROUP BY 1)),
        ontime AS (SELECT f.* FROM flow f JOIN wm USING (b) WHERE wm_ms IS NULL OR (device_ms // 5000 + 1) * 5000 > wm_ms)""",
        first_per_window("ontime", "device_ms")),
    "wordcount_stream": WORD_COUNT,
    "stream_scenario_event": f"{STREAM_EVENT} SELECT * FROM wide ORDER BY device_id, category, window_time",
    "stream_late_rows": f"""WITH {SLICED_ON_TIME}
        SELECT message_id, send_ms, device_ms, (device_ms // 5000 + 1) * 5000 AS window_end_ms, wm_ms AS watermark_ms
        FROM sliced JOIN wm USING (b) WHERE (device_ms // 5000 + 1) * 5000 <= wm_ms""",
    # A later slice's copy takes back what the slice before had; copies of one slice don't meet.
    "stream_retractions": f"""WITH {FEED},
        arrived AS (
          SELECT message_id, device_id, CASE WHEN patterncode = 're' AND s % 2 = 0 THEN 'corrected' ELSE category END AS category,
                 CASE WHEN patterncode = 're' THEN measure1 + 1000 ELSE measure1 END AS m1,
                 CAST(measure2 AS DECIMAL(18,2)) AS m2, send_ms, send_ms // 120000 AS b, (device_ms // 5000 + 1) * 5000 AS closes
          FROM feed),
        highest AS (
          SELECT b, MAX(mx) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 300000 AS wm_ms
          FROM (SELECT b, MAX(closes) AS mx FROM arrived GROUP BY 1)),
        copies AS (
          SELECT message_id, closes, b, ARG_MAX(device_id, send_ms) AS device_id, ARG_MAX(category, send_ms) AS category,
                 ARG_MAX(m1, send_ms) AS m1, ARG_MAX(m2, send_ms) AS m2
          FROM arrived JOIN highest USING (b) WHERE wm_ms IS NULL OR closes > wm_ms GROUP BY 1, 2, 3),
        paired AS (
          SELECT *, LAG(device_id) OVER o AS old_device, LAG(category) OVER o AS old_category, LAG(m1) OVER o AS old_m1, LAG(m2) OVER o AS old_m2
          FROM copies WINDOW o AS (PARTITION BY message_id, closes ORDER BY b)),
        changed AS (
          SELECT * FROM paired WHERE old_device IS NULL OR (device_id, category, m1, m2) <> (old_device, old_category, old_m1, old_m2)),
        steps AS (
          SELECT closes, device_id, category, b, SUM(m1) AS m1, SUM(m2) AS m2
          FROM (SELECT closes, device_id, category, b, m1, m2 FROM changed
                UNION ALL SELECT closes, old_device, old_category, b, -old_m1, -old_m2 FROM changed WHERE old_device IS NOT NULL)
          GROUP BY ALL)
        SELECT {label("closes")} AS window_time, device_id, category, row_number() OVER so_far AS version,
               CAST(SUM(m1) OVER so_far AS BIGINT) AS m1_sum, CAST(SUM(m2) OVER so_far AS DOUBLE) AS m2_sum
        FROM steps WINDOW so_far AS (PARTITION BY closes, device_id, category ORDER BY b)""",
    "stream_outputs": f"""WITH {FEED},
        sliced AS (SELECT feed.*, send_ms // {SLICE_MS} AS b FROM feed WHERE s % 40 >= 11),
        wm AS (
          SELECT b, MAX(mx) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS wm_ms
          FROM (SELECT b, MAX(device_ms) AS mx FROM sliced GROUP BY 1)),
        judged AS (
          SELECT sliced.*, device_ms // 5000 AS w, wm_ms IS NULL OR (device_ms // 5000 + 1) * 5000 > wm_ms AS open FROM sliced JOIN wm USING (b)),
        kept AS (
          SELECT message_id, w, ANY_VALUE(device_id) AS device_id, ANY_VALUE(category) AS category, ANY_VALUE(measure1) AS measure1
          FROM judged WHERE open GROUP BY 1, 2)
        SELECT 'debug rows' AS output, COUNT(*) AS n, NULL::BIGINT AS m1_sum FROM kept
        UNION ALL SELECT 'sums', COUNT(*), CAST(SUM(m1) AS BIGINT) FROM (SELECT SUM(measure1) AS m1 FROM kept GROUP BY w, device_id, category)
        UNION ALL SELECT 'late', COUNT(*), CAST(SUM(measure1) AS BIGINT) FROM judged WHERE NOT open
        UNION ALL SELECT CASE s % 40 WHEN 0 THEN 'too few fields' WHEN 1 THEN 'bad timestamp' WHEN 2 THEN 'bad measure1'
                 WHEN 4 THEN 'empty value' WHEN 5 THEN 'empty message_id' WHEN 6 THEN 'empty device_id'
                 WHEN 7 THEN 'empty category' ELSE 'bad measure2' END, COUNT(*), NULL FROM feed WHERE s % 40 < 11 GROUP BY 1""",
    "agg_own": f"""WITH {FEED}, rows AS ({first_per_window("feed", "device_ms")})
        SELECT {label("(w + 1) * 5000")} AS window_time, device_id, category,
               quantile_disc(measure1, 0.5) AS median, COUNT(*) AS n
        FROM rows GROUP BY w, device_id, category""",
    "stream_own": f"""WITH {SLICED_ON_TIME}, rows AS ({first_per_window("ontime", "device_ms")})
        SELECT {label("(w + 1) * 5000")} AS window_time, device_id, category,
               quantile_disc(measure1, 0.5) AS median, COUNT(*) AS n
        FROM rows GROUP BY w, device_id, category""",
    "key_lookup": f"""{EVENT}
        SELECT device_id, category, COUNT(*) AS n_windows, CAST(SUM(m1_sum_downstream) AS BIGINT) AS m1_sum, MAX(window_time) AS last_window
        FROM wide WHERE device_id = 'dev-1' GROUP BY 1, 2""",
    "stream_processing_time": f"""WITH {FEED}
        SELECT device_id, category, {M1} AS m1_sum, {M2} AS m2_sum FROM orig GROUP BY 1, 2""",
}
