"""Queries of the relational side: customers as users, nations as projects, orders as sessions, events as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, relational as R
from .tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-25 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _users(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    roles = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit('["USER","ADMIN"]')).otherwise(F.lit('["USER"]'))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_name").alias("email"), F.col("c_nationkey").alias("nation"), roles.alias("roles"), (F.col("c_acctbal") > 0).alias("is_active"), (F.col("c_mktsegment") != "BUILDING").alias("is_verified"), "c_acctbal", "c_mktsegment")


def _projects(spark, d) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 3).cast("bigint").alias("owner_id"), (F.col("n_regionkey") == 0).alias("is_archived"))


def _members(spark, d) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("project_id"), (F.col("s_suppkey") % 40).alias("user_id"), F.when(F.col("s_acctbal") > 5000, "collaborator").alias("role"))


def _sessions(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "embedding").otherwise("error")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).alias("project_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate") + F.expr("interval 24 hours")).alias("expires_at"), (F.col("o_orderstatus") == "F").alias("cleaned_up"), "o_totalprice")


_S = """WITH s AS (SELECT o_orderkey AS id, o_custkey % 30 AS project_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'embedding' ELSE 'error' END AS status, o_orderdate AS created_at,
 CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + INTERVAL 24 HOUR END AS expires_at, o_orderstatus = 'F' AS cleaned_up, o_totalprice FROM orders),
 p AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, (n_nationkey * 3)::BIGINT AS owner_id, n_regionkey = 0 AS is_archived FROM nation),
 m AS (SELECT s_suppkey AS id, s_nationkey::BIGINT AS project_id, s_suppkey % 40 AS user_id, CASE WHEN s_acctbal > 5000 THEN 'collaborator' END AS role FROM supplier) """


@query("""SELECT count(*)::BIGINT AS total, count(*) FILTER (c_acctbal > 0)::BIGINT AS active, count(*) FILTER (c_mktsegment <> 'BUILDING')::BIGINT AS verified, count(*) FILTER (c_mktsegment = 'MACHINERY')::BIGINT AS admins,
 count(*) FILTER (t >= TIMESTAMP '1998-01-01' - INTERVAL 7 DAY)::BIGINT AS recent_logins FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def admin_stats(spark, d):
    last = read(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("t"))
    u = _users(spark, d).join(last, F.col("id") == F.col("o_custkey"), "left")
    return R.admin_stats(u, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), F.col("is_active"), F.col("is_verified"), R.has_role(F.col("roles"), "ADMIN"), F.col("t"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE (c_name ILIKE '%er#0000000_1%' ESCAPE '\\' OR lower(c_mktsegment) ILIKE '%house%') AND c_acctbal > 0")
def user_search(spark, d):
    found = R.search(_users(spark, d), "er#0000000_1", ["name"], escape=False).unionByName(R.search(_users(spark, d), "house", ["c_mktsegment"])).distinct()
    return R.optional_equal(found, is_active=True, is_verified=None).select("id", "name")


@query("SELECT c_custkey AS id, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey OFFSET 20 LIMIT 10")
def user_page(spark, d):
    return R.page(_users(spark, d), [F.desc("c_acctbal"), F.col("id")], 3, 10).select("id", "c_acctbal")


@query("SELECT c_mktsegment, ceil(count(*) / 20)::BIGINT AS pages, greatest(ceil(count(*) FILTER (c_acctbal > 9990) / 10), 1)::BIGINT AS rich_pages FROM customer GROUP BY 1")
def page_counts(spark, d):
    g = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 9990).alias("r"))
    return g.select("c_mktsegment", R.page_count(F.col("n"), 20).alias("pages"), R.page_count(F.col("r"), 10, 1).alias("rich_pages"))


@query(_S + "SELECT s.id, p.name AS project_name, c.c_name AS owner_name, s.status FROM s JOIN p ON s.project_id = p.id JOIN customer c ON c.c_custkey = p.owner_id")
def session_listing(spark, d):
    return R.session_listing(_sessions(spark, d), _projects(spark, d), _users(spark, d)).select("id", "project_name", "owner_name", "status")


@query(_S + "SELECT id, status FROM s WHERE status = 'error' ORDER BY created_at DESC, id OFFSET 10 LIMIT 10")
def session_page(spark, d):
    return R.page(R.status_filter(_sessions(spark, d), "error"), [F.desc("created_at"), F.col("id")], 2, 10).select("id", "status")


@query(_S + "SELECT count(*)::BIGINT AS n FROM s")
def unknown_status_ignored(spark, d):
    return R.status_filter(_sessions(spark, d), "no such status").agg(F.count("*").alias("n"))


@query(_S + "SELECT p.id, p.name, coalesce(arg_min(m.role, m.id) FILTER (m.role IS NOT NULL OR TRUE), 'viewer') AS role FROM p JOIN m ON m.project_id = p.id WHERE m.user_id = 7 GROUP BY ALL HAVING TRUE".replace("coalesce(arg_min(m.role, m.id) FILTER (m.role IS NOT NULL OR TRUE), 'viewer')", "coalesce(list(m.role ORDER BY m.id)[1], 'viewer')"))
def member_projects(spark, d):
    return R.member_projects(_projects(spark, d), _members(spark, d), 7).select("id", "name", "role")


@query(_S + "SELECT id AS project_id, 0::BIGINT AS place, owner_id AS user_id, 'owner' AS role FROM p UNION ALL SELECT m.project_id, m.id, m.user_id, coalesce(m.role, 'viewer') FROM m JOIN customer ON c_custkey = m.user_id")
def owner_member_union(spark, d):
    return R.owners_and_members(_projects(spark, d), _members(spark, d), _users(spark, d))


@query(_S + "SELECT id, name FROM p WHERE owner_id = 6 OR id IN (SELECT project_id FROM m WHERE user_id = 6)")
def accessible_projects(spark, d):
    return R.accessible(_projects(spark, d), _members(spark, d), 6, False).select("id", "name")


@query(_S + "SELECT id, name FROM p WHERE NOT is_archived ORDER BY name, id LIMIT 5")
def owned_projects(spark, d):
    return R.page(R.optional_equal(_projects(spark, d), is_archived=False), [F.col("name"), F.col("id")], 1, 5).select("id", "name")


@query(_S + "SELECT DISTINCT c_custkey % 50 AS user_id, c_nationkey::BIGINT AS project_id FROM customer WHERE (c_custkey % 50, c_nationkey::BIGINT) NOT IN (SELECT (user_id, project_id) FROM m)")
def new_members(spark, d):
    asked = read(spark, d, "customer").select((F.col("c_custkey") % 50).alias("user_id"), F.col("c_nationkey").cast("bigint").alias("project_id")).distinct()
    return R.new_members(asked, _members(spark, d)).select("user_id", "project_id")


@query("SELECT count(*)::BIGINT AS n FROM customer WHERE c_custkey <> 1 AND c_acctbal > 0 AND c_mktsegment = 'MACHINERY'")
def other_admins(spark, d):
    return R.other_active_admins(_users(spark, d), 1).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN '["USER"]' ELSE '["USER","ADMIN"]' END AS toggled FROM customer""")
def toggle_admin(spark, d):
    r = F.col("roles")
    return _users(spark, d).select("id", F.when(R.has_role(r, "ADMIN"), R.set_role(r, "ADMIN", False)).otherwise(R.set_role(r, "ADMIN", True)).alias("toggled"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_antijoin(spark, d):
    done = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return R.resume(read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key")), done, "key").select("doc_id")


@query("SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_diff(spark, d):
    on_disk = read(spark, d, "orders").select("o_custkey").distinct()
    return R.orphans(on_disk, read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query(_S + ", k AS (SELECT unnest(['created', 'embedding', 'completed', 'error']) AS status) SELECT k.status, count(s.id)::BIGINT AS n FROM k LEFT JOIN s USING (status) GROUP BY 1")
def status_counts(spark, d):
    return R.status_counts(_sessions(spark, d), ["created", "embedding", "completed", "error"])


@query(_S + "SELECT id FROM s WHERE expires_at <= TIMESTAMP '1997-01-01' AND NOT cleaned_up")
def expired_sessions(spark, d):
    return R.expired(_sessions(spark, d), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).select("id")


@query(_S + "SELECT count(*)::BIGINT AS total, count(*) FILTER (NOT cleaned_up AND expires_at <= TIMESTAMP '1997-01-01')::BIGINT AS expired, count(*) FILTER (cleaned_up)::BIGINT AS cleaned, count(*) FILTER (expires_at IS NULL)::BIGINT AS no_expiry FROM s")
def cleanup_stats(spark, d):
    return R.cleanup_stats(_sessions(spark, d), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))


@query(_S + ", g AS (SELECT id FROM p WHERE is_archived), p2 AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM g)) SELECT (SELECT count(*) FROM p2)::BIGINT AS projects, (SELECT count(*) FROM m WHERE project_id NOT IN (SELECT id FROM g))::BIGINT AS members, (SELECT count(*) FROM s WHERE project_id NOT IN (SELECT id FROM g))::BIGINT AS sessions")
def cascade_delete(spark, d):
    p = _projects(spark, d)
    left = R.cascade_delete(p.where("is_archived").select("id"), {"projects": (p, "id"), "members": (_members(spark, d), "project_id"), "sessions": (_sessions(spark, d), "project_id")})
    n = {k: v.agg(F.count("*").alias(k)) for k, v in left.items()}
    return n["projects"].join(n["members"]).join(n["sessions"])


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_status(spark, d):
    e = read(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return R.latest(e, "user_id", "at", ["event_type"]).select("user_id", "event_type", F.col("at.ts").alias("ts"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS value, arg_max(props, (ts, event_id)) FILTER (event_type = 'click') AS props FROM events GROUP BY user_id")
def partial_update(spark, d):
    e = read(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"), F.when(F.col("event_type") == "click", F.col("props")).alias("props"))
    return R.latest(e, "user_id", "at", ["value", "props"]).select("user_id", "value", "props")


@query(f"SELECT count(DISTINCT user_id)::BIGINT AS active FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF}'")
def active_24h(spark, d):
    e = read(spark, d, "events")
    return e.where((F.col("ts") >= _as_of() - F.expr("interval 24 hours")) & (F.col("ts") <= _as_of())).agg(F.countDistinct("user_id").alias("active"))


@query("SELECT event_type, count(value)::BIGINT AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def metric_summary(spark, d):
    return metrics.summary(read(spark, d, "events"), ["event_type"], "value")


@query("WITH b AS (SELECT unnest([1, 10, 50, 100, 500]::DOUBLE[]) AS le) SELECT event_type, le, count(*) FILTER (value <= le)::BIGINT AS n FROM events, b GROUP BY 1, 2 UNION ALL SELECT event_type, 'inf'::DOUBLE, count(value)::BIGINT FROM events GROUP BY 1")
def histogram_buckets(spark, d):
    return metrics.histogram(read(spark, d, "events"), ["event_type"], "value", (1, 10, 50, 100, 500))


@query("SELECT event_type, user_id, count(*)::BIGINT AS total FROM events GROUP BY 1, 2")
def counter_totals(spark, d):
    return metrics.counter(read(spark, d, "events"), ["event_type", "user_id"])


@query("""SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS n_failed, round(sum(value), 4) AS total, round(avg(value), 4) AS mean,
 concat_ws(',', count(*) FILTER (value <= 1), count(*) FILTER (value <= 10), count(*) FILTER (value <= 100), count(value)) AS buckets FROM events GROUP BY user_id""")
def operation_timings(spark, d):
    """Events as timed operations of users; those of the kind 'error' have failed."""
    runs = read(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return metrics.timings(runs, ["user_id"], "value", "failed", (1, 10, 100)).withColumn("buckets", F.array_join(F.col("buckets").cast("array<string>"), ","))


@query("SELECT source AS folder, sum(n_chars)::BIGINT AS bytes, round(sum(n_chars) / 1048576.0, 3) AS mb FROM documents GROUP BY 1")
def folder_sizes(spark, d):
    return metrics.folder_sizes(read(spark, d, "documents"), "source", "n_chars").select(F.col("source").alias("folder"), "bytes", "mb")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1")
def top_file(spark, d):
    return read(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(1).select("doc_id", "n_chars")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT c_custkey AS id, trim(c_mktsegment || ' ' || c_name) AS full_name, '/groups/' || c_nationkey AS prefix, '10.0.0.' || c_nationkey AS ip FROM customer")
def user_names(spark, d):
    u = _users(spark, d)
    return u.select("id", T.full_name(F.col("c_mktsegment"), F.col("name"), F.col("email")).alias("full_name"), T.library_prefix(F.lit("group"), F.col("nation").cast("string")).alias("prefix"), T.client_ip(F.concat(F.lit("10.0.0."), F.col("nation").cast("string"), F.lit(", 1.1.1.1")), F.lit("0.0.0.0")).alias("ip"))


@query("""SELECT json_object('id', n_nationkey::BIGINT, 'name', n_name, 'owner_id', (n_nationkey * 3)::BIGINT, 'is_archived', n_regionkey = 0)::VARCHAR AS json FROM nation""")
def project_json(spark, d):
    return R.as_json(_projects(spark, d))


@query("""SELECT json_object('id', event_id, 'user_id', user_id, 'action', event_type, 'success', event_type <> 'error', 'details', NULL, 'created_at', strftime(ts, '%Y-%m-%dT%H:%M:%S'))::VARCHAR AS json FROM events""")
def audit_json(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), (F.col("event_type") != "error").alias("success"), F.lit(None).cast("string").alias("details"), F.col("ts").alias("created_at"))
    return R.as_json(rows)


@query(f"SELECT 'uploads/one' AS session_folder, 7::BIGINT AS project_id, 'extracted' AS status, count(*)::BIGINT AS row_count, TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR AS expires_at FROM documents")
def upload_session(spark, d):
    return R.uploaded_session(read(spark, d, "documents"), "uploads/one", 7, _as_of())


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'upload' WHEN o_orderpriority = '1-URGENT' THEN 'sparse' WHEN o_totalprice > 200000 THEN 'dense' WHEN o_orderstatus = 'O' THEN 'chunk' ELSE 'extract' END AS stage FROM orders")
def next_stage(spark, d):
    has = {"sparse": F.col("o_orderstatus") == "F", "dense": F.col("o_orderpriority") == "1-URGENT", "chunks": F.col("o_totalprice") > 200000, "rows": F.col("o_orderstatus") == "O"}
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), R.next_stage(has).alias("stage"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'created' ELSE 'error' END AS status FROM events")
def task_statuses(spark, d):
    name = F.when(F.col("event_type") == "signup", "CREATED").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", R.task_status(name).alias("status"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F')::BIGINT AS completed, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS embedding, 0::BIGINT AS created FROM orders")
def run_summary(spark, d):
    return R.run_summary(_sessions(spark, d), ["completed", "embedding", "created"])


@query("SELECT o_orderkey AS id, o_orderdate + INTERVAL 24 HOUR AS expires_at FROM orders")
def session_expiry(spark, d):
    return R.with_expiry(_sessions(spark, d)).select("id", "expires_at")


@query("SELECT user_id, event_type AS action, 'event' AS resource_type, event_id::VARCHAR AS resource_id, (event_type <> 'error')::INT AS success FROM events")
def audit_entries(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("event_type").alias("action"), F.lit("event").alias("resource_type"), F.col("event_id").alias("resource_id"), (F.col("event_type") != "error").alias("success"), "props")
    return R.audit_entries(e, _as_of()).select("user_id", "action", "resource_type", "resource_id", "success")


@query("WITH g AS (SELECT DISTINCT c_nationkey::VARCHAR AS f FROM customer WHERE c_acctbal > 9900) SELECT n_nationkey AS id, CASE WHEN n_nationkey::VARCHAR NOT IN (SELECT f FROM g) THEN n_nationkey::VARCHAR END AS session_folder FROM nation")
def delete_sessions(spark, d):
    gone = read(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").cast("string").alias("session_folder"))
    projects = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("session_folder"))
    return R.delete_session(projects, projects, gone)[1]


@query(_S + """, r AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS errors FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
 SELECT s.id, s.status, s.cleaned_up OR coalesce(r.errors = 0, FALSE) AS cleaned_up FROM s LEFT JOIN r USING (id)""")
def session_cleanup(spark, d):
    """Line items stand for removals of a session's files; returned ones failed."""
    tried = read(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "failed").alias("error"))
    return R.cleaned(_sessions(spark, d), tried).select("id", "status", "cleaned_up")


@query("""SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INT AS nth, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders""")
def ext_windows(spark, d):
    """Extension: ranking and running totals."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("nth"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    """Extension: grouping sets."""
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT p.event_id, c.event_id AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def ext_asof(spark, d):
    """Extension: each purchase with the user's last click, by one window over both kinds."""
    e = read(spark, d, "events").where(F.col("event_type").isin("purchase", "click"))
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "event_type", last.alias("last_click")).where("event_type = 'purchase'").drop("event_type")
