"""Registered access, log, window and stream queries.

The access tables are read out of the star schema: customers are users, parts are datasets, and what a customer
bought gives permissions and requests.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tabularium.functions.numbers import r4
from tabularium.operators import access, clean, filters, sequences, stats
from tabularium.plans.registry import query
from tabularium.session import scratch_path
from tabularium.streaming import live, lockout, run, windows

PERMS_SQL = """perms AS (SELECT o_custkey AS user_id, l_partkey AS dataset_id, bool_or(l_returnflag <> 'R') AS can_view,
  bool_or(l_linestatus = 'O') AS can_edit, max(l_shipdate) AS granted_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
REQUESTS_SQL = """requests AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, o_custkey AS user_id, l_partkey AS dataset_id,
  l_linestatus AS permission, CASE l_returnflag WHEN 'R' THEN 'pending' WHEN 'A' THEN 'approved' ELSE 'rejected' END AS status,
  l_shipdate AS requested_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
STAMP = "%Y-%m-%d %H:%M:%S"
#: How late rows of the event log may be; its files come in any order.
WHOLE_LOG = timedelta(days=3650)


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def permissions(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("dataset_id")).agg(
        F.bool_or(F.col("l_returnflag") != "R").alias("can_view"), F.bool_or(F.col("l_linestatus") == "O").alias("can_edit"),
        F.max("l_shipdate").alias("granted_at"))


def requests(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("l_returnflag") == "R", "pending").when(F.col("l_returnflag") == "A", "approved").otherwise("rejected")
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"),
                        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("dataset_id"),
                        F.col("l_linestatus").alias("permission"), status.alias("status"), F.col("l_shipdate").alias("requested_at"))


def datasets(t):
    return t.part.select(F.col("p_partkey").alias("dataset_id"), F.col("p_name").alias("dataset_name"), F.col("p_type"))


# ---- joins ---------------------------------------------------------------------------------------------

@query("dataset_listing", f"""SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '{STAMP}') AS created, c_name AS uploader
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'""")
def dataset_listing(t):
    rows = t.orders.filter(F.col("o_orderstatus") != "F").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").select(
        "o_orderkey", "o_orderstatus", stamp("o_orderdate").alias("created"), F.col("c_name").alias("uploader"))


@query("dataset_listing_admin", """SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def dataset_listing_admin(t):
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select("c_custkey", "c_name", "n_name", "r_name"))


@query("rbac_visible", f"""WITH {PERMS_SQL} SELECT user_id, dataset_id, p_name AS dataset_name, can_edit FROM perms
JOIN part ON dataset_id = p_partkey WHERE can_view""")
def rbac_visible(t):
    return access.visible(datasets(t), permissions(t), "dataset_id").select("user_id", "dataset_id", "dataset_name", "can_edit")


@query("rbac_semi", f"""WITH {PERMS_SQL}, {REQUESTS_SQL} SELECT request_id, user_id, dataset_id FROM requests r
WHERE status = 'pending' AND EXISTS (SELECT 1 FROM perms p WHERE p.user_id = r.user_id AND p.dataset_id = r.dataset_id AND can_edit)""")
def rbac_semi(t):
    pending = requests(t).filter("status = 'pending'").select("request_id", "user_id", "dataset_id")
    return access.with_access(pending, permissions(t), ["user_id", "dataset_id"], "can_edit")


@query("rbac_requestable", f"""WITH {PERMS_SQL}, busiest AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT p_partkey AS dataset_id, p_name AS dataset_name, p_type FROM part WHERE p_partkey NOT IN (
  SELECT dataset_id FROM perms WHERE can_view AND user_id = (SELECT o_custkey FROM busiest))""")
def rbac_requestable(t):
    """Datasets the busiest user cannot see."""
    busiest = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(1)
    return access.requestable(datasets(t), permissions(t), "dataset_id", "user_id", busiest.select("o_custkey").scalar())


@query("users_dataset_counts", """SELECT c_custkey, c_name, coalesce(n, 0) AS datasets FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey""")
def users_dataset_counts(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    return access.counted(t.customer.select("c_custkey", "c_name"), urgent, "c_custkey", "o_custkey", "datasets")


@query("log_active_users", "SELECT DISTINCT user_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def log_active_users(t):
    seen = t.events.select("user_id").distinct()
    return seen.join(t.customer, F.col("user_id") == F.col("c_custkey")).select("user_id", "c_name")


@query("perm_pending", f"""WITH {REQUESTS_SQL} SELECT request_id, c_name AS user_name, p_name AS dataset_name, permission,
  strftime(requested_at, '{STAMP}') AS requested_at FROM requests JOIN customer ON user_id = c_custkey JOIN part ON dataset_id = p_partkey
WHERE status = 'pending'""")
def perm_pending(t):
    rows = (requests(t).filter("status = 'pending'")
            .join(t.customer, F.col("user_id") == F.col("c_custkey")).join(t.part, F.col("dataset_id") == F.col("p_partkey")))
    return rows.orderBy(F.desc("requested_at"), "request_id").select(
        "request_id", F.col("c_name").alias("user_name"), F.col("p_name").alias("dataset_name"), "permission",
        stamp("requested_at").alias("requested_at"))


@query("dataset_assignments", f"""WITH {PERMS_SQL} SELECT dataset_id, c_name AS user_name, can_edit FROM perms
JOIN customer ON user_id = c_custkey WHERE can_view""")
def dataset_assignments(t):
    who = permissions(t).filter("can_view").join(t.customer, F.col("user_id") == F.col("c_custkey"))
    return who.select("dataset_id", F.col("c_name").alias("user_name"), "can_edit")


@query("perm_matrix", """WITH g AS (SELECT DISTINCT c_nationkey, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)
SELECT u.c_nationkey, d.p_type, g.p_type IS NOT NULL AS granted FROM (SELECT DISTINCT c_nationkey FROM g) u
CROSS JOIN (SELECT DISTINCT p_type FROM part) d LEFT JOIN g ON g.c_nationkey = u.c_nationkey AND g.p_type = d.p_type""")
def perm_matrix(t):
    """Nation by part type, granted where the nation has bought the type."""
    lines = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .join(t.part, F.col("l_partkey") == F.col("p_partkey")))
    return access.matrix(lines.select("c_nationkey", "p_type").distinct(), "c_nationkey", t.part.select("p_type"))


# ---- logs ----------------------------------------------------------------------------------------------

@query("log_filter", f"""SELECT event_id, strftime(ts, '{STAMP}') AS ts, user_id, event_type, round(value, 4) AS value FROM events
WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def log_filter(t):
    rows = filters.optional(t.events, {"event_type": "purchase", "user_id": None}, moment="ts",
                            start="2024-01-05 00:00:00", end="2024-01-20 12:00:00")
    return rows.orderBy(F.desc("ts"), "event_id").select("event_id", stamp("ts").alias("ts"), "user_id", "event_type", r4(F.col("value")).alias("value"))


STATUS = "CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 50 THEN 'warning' ELSE 'success' END"


def _with_status(t):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 50, "warning").otherwise("success")
    return t.events.withColumn("status", status)


@query("log_stats", f"SELECT event_type, {STATUS} AS status, count(*) AS hits FROM events GROUP BY 1, 2")
def log_stats(t):
    return _with_status(t).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("hits"))


@query("log_event_types", "SELECT DISTINCT event_type FROM events")
def log_event_types(t):
    return t.events.select("event_type").distinct().orderBy("event_type")


@query("status_counts", f"""SELECT count(*) AS total, count(*) FILTER (s = 'success') AS success, count(*) FILTER (s = 'failed') AS failed,
  count(*) FILTER (s = 'warning') AS warning FROM (SELECT {STATUS} AS s FROM events)""")
def status_counts(t):
    s = F.col("status")
    return _with_status(t).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == k).alias(k) for k in ("success", "failed", "warning")])


@query("user_stats", """SELECT c_mktsegment AS role, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active,
  count(*) FILTER (c_acctbal <= 0) AS inactive FROM customer GROUP BY 1
UNION ALL SELECT 'all', count(*), count(*) FILTER (c_acctbal > 0), count(*) FILTER (c_acctbal <= 0) FROM customer""")
def user_stats(t):
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("active"),
              F.count_if(F.col("c_acctbal") <= 0).alias("inactive")]
    by_role = t.customer.groupBy(F.col("c_mktsegment").alias("role")).agg(*counts)
    everyone = by_role.agg(*[F.sum(c).alias(c) for c in ("total", "active", "inactive")]).select(F.lit("all").alias("role"), "*")
    return by_role.unionByName(everyone)


@query("badge_counts", f"""WITH {REQUESTS_SQL} SELECT pending, failed, pending + failed AS total FROM (
  SELECT (SELECT count(*) FROM requests WHERE status = 'pending') AS pending,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS failed)""")
def badge_counts(t):
    failed = t.events.agg(F.count_if(F.col("event_type") == "error")).scalar()
    one = requests(t).agg(F.count_if(F.col("status") == "pending").alias("pending")).withColumn("failed", failed)
    return one.withColumn("total", F.col("pending") + F.col("failed"))


@query("uploads_timeline", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS uploads FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 7""")
def uploads_timeline(t):
    per_day = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("uploads"))
    return per_day.orderBy(F.desc("d")).limit(7).select(F.date_format("d", "yyyy-MM-dd").alias("day"), "uploads")


@query("log_daily_volume", """WITH a AS (SELECT CAST(max(ts) AS DATE) AS d FROM events),
s AS (SELECT CAST(unnest(generate_series(d - 6, d, INTERVAL 1 DAY)) AS DATE) AS day FROM a),
c AS (SELECT day, count(ts) AS hits FROM s LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY 1)
SELECT day, strftime(day, '%a') AS day_label, hits, CAST(floor(hits * 100.0 / greatest(1, max(hits) OVER ()) + 0.5) AS BIGINT) AS normalized FROM c""")
def log_daily_volume(t):
    return sequences.daily_volume(t.events, "ts", 7)


@query("log_last_days", """SELECT event_id, user_id, event_type FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) - 2""")
def log_last_days(t):
    return t.events.filter(filters.last_days(t.events, "ts", 3)).select("event_id", "user_id", "event_type")


SESSIONS_SQL = """flags AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS f FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM flags),
sessions AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM numbered GROUP BY user_id, s)"""


@query("session_idle", f"""WITH {SESSIONS_SQL} SELECT user_id, strftime(session_start, '{STAMP}') AS session_start,
  strftime(session_end, '{STAMP}') AS session_end, events FROM sessions""")
def session_idle(t):
    return sequences.sessions(t.events, "user_id", "ts").select(
        "user_id", stamp("session_start").alias("session_start"), stamp("session_end").alias("session_end"), "events")


SESSION_ROWS_SQL = f"""{SESSIONS_SQL}, now AS (SELECT max(ts) AS n FROM events),
session_rows AS (SELECT user_id, 'SESSION' AS event_type, CASE WHEN q < 7200 THEN 'active' ELSE 'completed' END AS status,
  session_start AS ts, CAST(floor(CASE WHEN q < 7200 THEN epoch_us(n) - epoch_us(session_start) ELSE epoch_us(session_end) - epoch_us(session_start) END / 1000000)
  AS BIGINT) AS duration_seconds FROM (SELECT *, floor((epoch_us(n) - epoch_us(session_end)) / 1000000) AS q FROM sessions, now))"""


def _session_rows(t):
    now = t.events.agg(F.max("ts")).scalar()
    return sequences.session_rows(sequences.sessions(t.events, "user_id", "ts"), "user_id", now)


@query("session_durations", f"WITH {SESSION_ROWS_SQL} SELECT user_id, event_type, status, strftime(ts, '{STAMP}') AS ts, duration_seconds FROM session_rows")
def session_durations(t):
    return _session_rows(t).withColumn("ts", stamp("ts"))


@query("session_pairs", f"""WITH marks AS (SELECT user_id, event_id, ts, event_type = 'signup' AS opens,
  lead(event_type = 'signup') OVER w AS next_opens, lead(ts) OVER w AS next_ts FROM events WHERE event_type IN ('signup', 'purchase')
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), now AS (SELECT max(ts) AS n FROM events)
SELECT user_id, CASE WHEN next_opens IS NULL THEN 'active' WHEN next_opens THEN 'lost' ELSE 'completed' END AS status, strftime(ts, '{STAMP}') AS ts,
  CASE WHEN NOT next_opens THEN strftime(next_ts, '{STAMP}') END AS ended,
  CAST(floor(CASE WHEN next_opens IS NULL THEN epoch_us(n) - epoch_us(ts) WHEN NOT next_opens THEN epoch_us(next_ts) - epoch_us(ts) END / 1000000) AS BIGINT)
  AS duration_seconds FROM marks, now WHERE opens""")
def session_pairs(t):
    """Sessions from pairs of an opening (signup) and a closing (purchase) event, as logins and logouts."""
    now = t.events.agg(F.max("ts")).scalar()
    found = sequences.paired_sessions(t.events, "user_id", "ts", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", now)
    return found.withColumns({"ts": stamp("ts"), "ended": stamp("ended")})


@query("audit_append", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def audit_append(t):
    """Log rows appended in several writes, read back as one log."""
    path = scratch_path(t.spark, "audit")
    log = t.events.select("event_id", "user_id", "ts", "event_type")
    for error in (True, False):
        run.append_log(log.filter((F.col("event_type") == "error") == error), path)
    stored = t.spark.read.schema(log.schema).parquet(path)
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("log_with_sessions", f"""WITH {SESSION_ROWS_SQL} SELECT user_id, event_type, status, strftime(ts, '{STAMP}') AS ts, duration_seconds FROM session_rows
UNION ALL SELECT user_id, event_type, {STATUS}, strftime(ts, '{STAMP}'), NULL FROM events""")
def log_with_sessions(t):
    log = _with_status(t).select("user_id", "event_type", "status", "ts")
    both = log.unionByName(_session_rows(t), allowMissingColumns=True)
    return both.orderBy(F.desc("ts"), "user_id", "event_type").withColumn("ts", stamp("ts"))


# ---- windows over keys ---------------------------------------------------------------------------------

@query("rate_limit_windows", f"""SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '{STAMP}') AS window_start, count(*) AS hits
FROM events GROUP BY 1, 2 HAVING count(*) >= 2""")
def rate_limit_windows(t):
    return sequences.busy_windows(t.events, "user_id", "ts", "1 hour", 2).withColumn("window_start", stamp("window_start"))


RUNS_SQL = """ordered AS (SELECT *, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
runs AS (SELECT *, CASE WHEN bad THEN sum(CASE WHEN bad THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS run FROM ordered)"""


@query("lockout_events", f"""WITH {RUNS_SQL} SELECT user_id, event_id, strftime(ts, '{STAMP}') AS ts,
  strftime(ts + INTERVAL 5 MINUTE, '{STAMP}') AS locked_until FROM runs WHERE run >= 3""")
def lockout_events(t):
    runs = sequences.failure_runs(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id",
                                  F.col("event_type") == "error")
    return runs.filter("run >= 3").select("user_id", "event_id", stamp("ts").alias("ts"),
                                         stamp(F.col("ts") + F.expr("interval 5 minutes")).alias("locked_until"))


@query("failure_runs", f"WITH {RUNS_SQL} SELECT event_id, CAST(run AS BIGINT) AS run FROM runs")
def failure_runs(t):
    runs = sequences.failure_runs(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id",
                                  F.col("event_type") == "error")
    return runs.select("event_id", "run")


@query("conv_history_window", """SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 12""")
def conv_history_window(t):
    return sequences.last_rows(t.conversations, "conv_id", ["turn"], 12)


@query("dedup_pending", f"""WITH {REQUESTS_SQL} SELECT user_id, dataset_id, permission, request_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, dataset_id, permission ORDER BY requested_at, request_id) AS r
  FROM requests WHERE status = 'pending') WHERE r = 1""")
def dedup_pending(t):
    pending = requests(t).filter("status = 'pending'").drop("status")
    kept = clean.dedup(pending, "first", ["user_id", "dataset_id", "permission"], ["requested_at", "request_id"])
    return kept.select("user_id", "dataset_id", "permission", "request_id")


@query("token_active", f"""SELECT event_id, user_id, strftime(ts + INTERVAL 3 DAY, '{STAMP}') AS expires_at FROM events
WHERE event_type <> 'error' AND ts + INTERVAL 3 DAY > (SELECT max(ts) FROM events)""")
def token_active(t):
    now = t.events.agg(F.max("ts")).scalar()
    expires = F.col("ts") + F.expr("interval 3 days")
    return t.events.filter((F.col("event_type") != "error") & (expires > now)).select(
        "event_id", "user_id", stamp(expires).alias("expires_at"))


@query("query_latency_stats", """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS slowest,
  round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1""")
def query_latency_stats(t):
    shape = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("value")).alias("mean"), r4(F.max("value")).alias("slowest"))
    q = stats.group_quantiles(t.events, "event_type", "value", {"median": 0.5, "p95": 0.95})
    return shape.join(q.select("event_type", r4(F.col("median")).alias("median"), r4(F.col("p95")).alias("p95")), "event_type")


# ---- streams -------------------------------------------------------------------------------------------

@query("stream_ingest_counts", "SELECT event_type, count(*) AS hits, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_ingest_counts(t):
    stored = run.drain(run.table_stream(t, "events"), "ingest")
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("user_id").alias("users"))


@query("stream_rate_limit", f"""SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '{STAMP}') AS window_start, count(*) AS hits
FROM events GROUP BY 1, 2 HAVING count(*) >= 2""")
def stream_rate_limit(t):
    hits = windows.busy_windows(run.table_stream(t, "events"), "user_id", "ts", "1 hour")
    return hits.filter("hits >= 2").withColumn("window_start", stamp("window_start"))


@query("stream_sessions", f"""WITH {SESSIONS_SQL} SELECT user_id, strftime(session_start, '{STAMP}') AS session_start,
  strftime(session_end, '{STAMP}') AS session_end, CAST(events AS BIGINT) AS events FROM sessions""")
def stream_sessions(t):
    """All sessions; those still open end with their last event so far."""
    found = windows.idle_sessions(run.table_stream(t, "events"), "user_id", "ts")
    return found.select("user_id", stamp("session_start").alias("session_start"), stamp("session_end").alias("session_end"), "events")


@query("stream_closed_sessions", f"""WITH {SESSIONS_SQL}, now AS (SELECT max(ts) AS n FROM events)
SELECT user_id, strftime(session_start, '{STAMP}') AS session_start, strftime(session_end, '{STAMP}') AS session_end, CAST(events AS BIGINT) AS events
FROM sessions, now WHERE epoch_ms(session_end) + 7200000 < epoch_ms(n)""")
def stream_closed_sessions(t):
    """Sessions that left a running query because they had closed, with all that late rows took back and put in again."""
    feed = run.table_stream(t, "events").select("user_id", "ts")
    found = live.settled(run.drain(live.closed_sessions(feed, "user_id", "ts", horizon=WHOLE_LOG), "closed"))
    return found.select("user_id", stamp("session_start").alias("session_start"), stamp("session_end").alias("session_end"), "events")


@query("stream_expired_tokens", f"""WITH now AS (SELECT max(ts) AS n FROM events), tokens AS (
  SELECT user_id, max(ts) + INTERVAL 12 HOUR AS ends FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT user_id, strftime(ends, '{STAMP}') AS expires_at FROM tokens, now WHERE epoch_ms(ends) < epoch_ms(n)""")
def stream_expired_tokens(t):
    """Each user's token lasts twelve hours from their last success; those that left a running query because they had expired."""
    ends = F.when(F.col("event_type") != "error", F.col("ts") + F.expr("interval 12 hours"))
    feed = run.table_stream(t, "events").select("user_id", "ts", ends.alias("ends"))
    found = live.settled(run.drain(live.expired_tokens(feed, "user_id", "ts", "ends", WHOLE_LOG), "expired"))
    return found.select("user_id", stamp("expires_at").alias("expires_at"))


@query("stream_dedup", "SELECT count(*) AS events, count(DISTINCT user_id) AS users FROM events")
def stream_dedup(t):
    """Every event delivered twice, kept once."""
    feed = run.table_stream(t, "events").select("event_id", "user_id", "ts")
    twice = feed.union(run.table_stream(t, "events").select("event_id", "user_id", "ts"))
    kept = windows.once(twice, ["event_id"], "ts")
    return kept.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))


@query("lockout_state", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'error' AS failed,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (
  SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS event_id, 0 AS failures, CAST(-9000000000000000000 AS BIGINT) AS until, false AS locked
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT e.user_id, e.r, e.event_id,
    CASE WHEN e.us < s.until THEN s.failures WHEN e.failed THEN s.failures + 1 ELSE 0 END,
    CASE WHEN e.us >= s.until AND e.failed AND s.failures + 1 >= 3 THEN e.us + 300000000 ELSE s.until END,
    e.us >= s.until AND e.failed AND s.failures + 1 >= 3
  FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
SELECT user_id, event_id, failures, strftime(make_timestamp(until), '{STAMP}') AS locked_until FROM s WHERE locked""")
def lockout_state(t):
    """Locks of the state machine."""
    feed = run.table_stream(t, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return lockout.lockouts(feed).withColumn("locked_until", stamp("locked_until"))
