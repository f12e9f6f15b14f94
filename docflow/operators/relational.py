"""Users, projects, members, sessions and audit rows: listings, joins, counts, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SESSION_STATUS, unused


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page, 1-based, of a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(total: Column, size: int, least: int = 0) -> Column:
    return F.greatest(F.ceil(total / size), F.lit(least)).cast("bigint")


def search(df: DataFrame, term: str | None, columns: Sequence[str], escape: bool = True) -> DataFrame:
    """Rows where any column holds the term, ignoring case; % and _ are literal unless escape is off."""
    if not term:
        return df
    if escape:
        for x in ("\\", "%", "_"):
            term = term.replace(x, "\\" + x)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return df.where(found)


def optional_equal(df: DataFrame, **values) -> DataFrame:
    """A filter for every value that is given; None filters nothing."""
    for c, v in values.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def status_filter(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    """An unknown status filters nothing."""
    return df.where(F.col(column) == status) if status in SESSION_STATUS else df


def has_role(roles: Column, role: str) -> Column:
    """roles: a JSON list of strings."""
    return F.coalesce(F.array_contains(F.from_json(roles, "array<string>"), role), F.lit(False))


def set_role(roles: Column, role: str, on: bool) -> Column:
    held = F.coalesce(F.from_json(roles, "array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.array_union(held, F.array(F.lit(role))) if on else F.array_remove(held, role))


def other_active_admins(users: DataFrame, user_id: int) -> DataFrame:
    return users.where((F.col("id") != user_id) & F.col("is_active") & has_role(F.col("roles"), "ADMIN"))


def admin_stats(users: DataFrame, as_of: Column, active: Column, verified: Column, admin: Column, last_login: Column) -> DataFrame:
    """All counts in one pass."""
    return users.agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(verified).alias("verified"), F.count_if(admin).alias("admins"), F.count_if(last_login >= as_of - F.expr("interval 7 days")).alias("recent_logins"))


def session_listing(sessions: DataFrame, projects: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with their project and owner names; sessions of missing projects or owners are left out."""
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "owner_id")
    u = users.select(F.col("id").alias("owner_id"), F.col("name").alias("owner_name"))
    return sessions.join(p, "project_id").join(u, "owner_id")


def member_projects(projects: DataFrame, members: DataFrame, user_id) -> DataFrame:
    """Projects the user has joined, with the role of the first membership (viewer by default)."""
    mine = members.where(F.col("user_id") == user_id).groupBy("project_id").agg(F.min_by("role", "id").alias("role"))
    return projects.join(mine, projects.id == mine.project_id).select(projects["*"], F.coalesce("role", F.lit("viewer")).alias("role"))


def owners_and_members(projects: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """project_id, place, user_id, role: the owner first (place 0), then members whose user exists, by membership."""
    owner = projects.select(F.col("id").alias("project_id"), F.lit(0).cast("bigint").alias("place"), F.col("owner_id").alias("user_id"), F.lit("owner").alias("role"))
    rest = members.join(users.select(F.col("id").alias("user_id")), "user_id").select("project_id", F.col("id").cast("bigint").alias("place"), "user_id", F.coalesce("role", F.lit("viewer")).alias("role"))
    return owner.unionByName(rest)


def accessible(projects: DataFrame, members: DataFrame, user_id, admin: bool) -> DataFrame:
    if admin:
        return projects
    mine = members.where(F.col("user_id") == user_id).select("project_id").distinct()
    return projects.where(F.col("owner_id") == user_id).unionByName(projects.where(~F.coalesce(F.col("owner_id") == user_id, F.lit(False))).join(mine, projects.id == mine.project_id, "left_semi"))


def resume(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items not done yet; blank keys are always processed."""
    has_key = F.coalesce(F.trim(F.col(key)) != "", F.lit(False))
    return items.where(has_key).join(done.select(key).distinct(), key, "left_anti").select(*items.columns).unionByName(items.where(~has_key))


def new_members(asked: DataFrame, members: DataFrame) -> DataFrame:
    return asked.join(members.select("project_id", "user_id").distinct(), ["project_id", "user_id"], "left_anti")


def orphans(on_disk: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return on_disk.join(known.select(key).distinct(), key, "left_anti")


def expired(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.where(F.col("expires_at").isNotNull() & (F.col("expires_at") <= as_of) & ~F.col("cleaned_up"))


def cleanup_stats(sessions: DataFrame, as_of: Column) -> DataFrame:
    open_ = ~F.col("cleaned_up")
    return sessions.agg(F.count("*").alias("total"), F.count_if(open_ & (F.col("expires_at") <= as_of)).alias("expired"), F.count_if(F.col("cleaned_up")).alias("cleaned"), F.count_if(F.col("expires_at").isNull()).alias("no_expiry"))


def status_counts(sessions: DataFrame, statuses: Sequence[str], column: str = "status") -> DataFrame:
    """A row for every known status, 0 where there is none."""
    known = sessions.sparkSession.createDataFrame([(s,) for s in statuses], f"{column} string")
    counts = sessions.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def latest(changes: DataFrame, key: str, at: str, fields: Sequence[str]) -> DataFrame:
    """Current state of an append-only change log: each field's last non-null value (a null leaves a field alone)."""
    return changes.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in fields), F.max(at).alias(at))


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """gone: column id.  Rows of each table (frame, foreign key) whose parent stays."""
    return {name: df.join(gone.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(*df.columns) for name, (df, key) in tables.items()}


def task_status(name: Column) -> Column:
    return F.when(F.lower(name).isin(SESSION_STATUS), F.lower(name)).otherwise("error")


def next_stage(has: dict[str, Column]) -> Column:
    """The stage after the latest stage whose file exists."""
    return F.when(has["sparse"], "upload").when(has["dense"], "sparse").when(has["chunks"], "dense").when(has["rows"], "chunk").otherwise("extract")


def with_expiry(sessions: DataFrame, hours: int = 24) -> DataFrame:
    """Sessions without an expiry get one, counted from their creation; others keep theirs."""
    return sessions.withColumn("expires_at", F.coalesce("expires_at", F.col("created_at") + F.make_interval(hours=F.lit(hours))))


def delete_session(sessions: DataFrame, projects: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, projects) without the folders in gone (session_folder): a project's active folder is cleared if it went."""
    gone = gone.select("session_folder").distinct()
    left = sessions.join(gone, "session_folder", "left_anti").select(*sessions.columns)
    mark = unused("gone", projects.columns)
    marked = projects.join(gone.withColumn(mark, F.lit(True)), "session_folder", "left")
    folder = F.when(F.col(mark), F.lit(None).cast("string")).otherwise(F.col("session_folder"))
    return left, marked.withColumn("session_folder", folder).select(*projects.columns)


def cleaned(sessions: DataFrame, removals: DataFrame) -> DataFrame:
    """Sessions marked as cleaned up where their folder went (removals: id, error).  A folder that was missing already is
    removed without an error; any error of a session leaves it as it was, and so does no removal at all."""
    tried = removals.groupBy("id").agg(F.count("error").alias("errors"))
    done = sessions.join(tried, "id", "left").withColumn("cleaned_up", F.col("cleaned_up") | F.coalesce(F.col("errors") == 0, F.lit(False)))
    return done.select(*sessions.columns)


def audit_entries(actions: DataFrame, as_of: Column) -> DataFrame:
    """Rows to append to the audit log: user_id, action, resource_type, resource_id, details (JSON), success 0/1, created_at."""
    rest = [c for c in actions.columns if c not in ("user_id", "action", "resource_type", "resource_id", "success")]
    details = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return actions.select("user_id", "action", "resource_type", F.col("resource_id").cast("string").alias("resource_id"), details.alias("details"), F.coalesce(F.col("success").cast("int"), F.lit(1)).alias("success"), as_of.alias("created_at"))


def run_summary(results: DataFrame, statuses: Sequence[str], column: str = "status") -> DataFrame:
    """One row with a count for each status, 0 where there is none."""
    return results.agg(*(F.count_if(F.col(column) == s).alias(s) for s in statuses))


def uploaded_session(rows: DataFrame, folder: str, project_id: int, as_of: Column, hours: int = 24) -> DataFrame:
    """The session row of an upload: session_folder, project_id, status (extracted), row_count, created_at, expires_at."""
    one = rows.agg(F.count("*").alias("row_count"))
    made = one.select(F.lit(folder).alias("session_folder"), F.lit(project_id).cast("long").alias("project_id"), F.lit("extracted").alias("status"), "row_count", as_of.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    return with_expiry(made, hours)


#: Fields of users that leave the system only when asked for (fixed values).
SENSITIVE = ("hashed_password", "verification_token", "reset_token", "api_credentials")


def as_json(rows: DataFrame, leave_out: Sequence[str] = (), parsed: Sequence[str] = (), name: str = "json") -> DataFrame:
    """Rows as JSON objects: times in ISO form, null fields kept, columns in ``parsed`` (JSON strings of lists of strings) as
    lists, those in leave_out not there."""
    fields = []
    for c, kind in rows.dtypes:
        if c in leave_out:
            continue
        v = F.col(f"`{c}`")
        if kind.startswith("timestamp"):
            v = F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")
        elif c in parsed:
            v = F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>"))
        fields.append(v.alias(c))
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


def public_user(users: DataFrame, sensitive: Sequence[str] = SENSITIVE) -> DataFrame:
    """Users as JSON objects without sensitive fields."""
    return as_json(users, sensitive)
