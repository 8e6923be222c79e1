"""Registered usage and indexing queries (groups H, I, A4, D8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import indexing, usage
from loomgraph.plans.projections import NOW
from loomgraph.plans.registry import query
from loomgraph.session import work_folder
from loomgraph.streaming import push_streams, usage_streams


def today():
    return F.lit("2024-01-30").cast("date")


_REQ = """
    CASE WHEN user_id % 10 <> 0 THEN 'user' || user_id END AS actor,
    CASE WHEN k % 13 = 0 THEN '/health' WHEN k % 17 = 0 THEN '/overview/NATION_' || (k % 25)
         ELSE '/' || event_type || '/x' END AS path,
    CASE WHEN k % 5 = 0 THEN 'NATION_' || (k % 25) || '|NATION_1' WHEN k % 5 = 1 THEN 'NATION_' || (k % 25) ELSE '' END AS asked
"""


@query(
    "h1_samples",
    f"""
    SELECT coalesce(actor, 'internal') AS actor, split_part(path, '/', 2) AS endpoint,
           CASE WHEN path LIKE '/overview/%' THEN split_part(path, '/', 3) ELSE asked END AS repos,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS at
    FROM (SELECT *, {_REQ} FROM ev) WHERE event_type <> 'error' AND path <> '/health'
    """,
)
def h1_samples(t):
    return usage.to_samples(t.requests())


@query("h2_daily_counts", "SELECT strftime(day, '%Y-%m-%d') AS day, actor, endpoint, repo, n FROM stats")
def h2_daily_counts(t):
    return usage.daily_counts(t.usage_samples())


@query(
    "h3_access_log",
    """SELECT actor, repo, strftime("at", '%Y-%m-%d %H:%M:%S') AS "at" FROM access""",
)
def h3_access_log(t):
    return usage.access_log(t.usage_samples())


@query(
    "h4_retained_access",
    """
    SELECT actor, repo, strftime("at", '%Y-%m-%d %H:%M:%S') AS "at" FROM access
    WHERE "at" >= (SELECT max(ts) FROM ev) - INTERVAL 48 HOURS
    """,
)
def h4_retained_access(t):
    now = t.usage_samples().agg(F.max("at")).scalar()
    return usage.retained(usage.access_log(t.usage_samples()), now)


for _field in ("actor", "repo", "endpoint"):

    @query(
        f"h5_rank_by_{_field}",
        f"""
        SELECT {_field} AS name, CAST(sum(n) AS BIGINT) AS n FROM stats
        WHERE day >= DATE '2024-01-30' - 13 AND {_field} <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 20
        """,
    )
    def h5_rank(t, field=_field):  # noqa: B023
        return usage.rank_by(usage.daily_counts(t.usage_samples()), field, today(), 14, 20)


@query(
    "h6_traffic",
    "SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(n) AS BIGINT) AS n FROM stats WHERE day >= DATE '2024-01-30' - 29 GROUP BY 1",
)
def h6_traffic(t):
    return usage.traffic(usage.daily_counts(t.usage_samples()), today())


@query(
    "h7_total_requests",
    "SELECT CAST(sum(n) AS BIGINT) AS n FROM stats WHERE day >= DATE '2024-01-30' - 6 AND repo = 'NATION_3'",
)
def h7_total_requests(t):
    return usage.total_requests(usage.daily_counts(t.usage_samples()), today(), 7, repo="NATION_3")


@query(
    "h8_actor_activity",
    """
    SELECT repo AS name, CAST(sum(n) AS BIGINT) AS n FROM stats
    WHERE day >= DATE '2024-01-30' - 29 AND actor = 'user7' AND repo <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 50
    """,
)
def h8_actor_activity(t):
    return usage.actor_activity(usage.daily_counts(t.usage_samples()), "user7", today())


@query(
    "h8_repo_activity",
    """
    SELECT actor AS name, CAST(sum(n) AS BIGINT) AS n FROM stats
    WHERE day >= DATE '2024-01-30' - 29 AND repo = 'NATION_8' GROUP BY 1 ORDER BY n DESC, name LIMIT 50
    """,
)
def h8_repo_activity(t):
    return usage.repo_activity(usage.daily_counts(t.usage_samples()), "NATION_8", today())


@query(
    "h9_anomalies",
    """
    SELECT actor, count(DISTINCT repo) AS repo_count, count(*) AS requests,
           string_agg(DISTINCT repo, '|' ORDER BY repo) AS repos,
           strftime(min("at"), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max("at"), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM access WHERE "at" >= (SELECT max(ts) FROM ev) - INTERVAL 48 HOURS AND actor <> 'internal'
    GROUP BY actor HAVING count(DISTINCT repo) >= 6
    """,
)
def h9_anomalies(t):
    samples = t.usage_samples()
    now = samples.agg(F.max("at")).scalar()
    return usage.anomalies(usage.access_log(samples), now, 48 * 3600, 6)


@query(
    "h10_repo_details",
    f"""
    SELECT coalesce(name, repo) AS repo, CAST(coalesce(nodes, 0) AS BIGINT) AS nodes,
           CAST(coalesce(epoch(TIMESTAMP '{NOW}') - epoch(last_synced_at), 0) AS BIGINT) AS age_seconds,
           coalesce(epoch(TIMESTAMP '{NOW}') - epoch(last_synced_at), 0) > 3600 AS stale,
           name IS NOT NULL AS indexed, CAST(coalesce(n, 0) AS BIGINT) AS requests
    FROM (SELECT r.*, nodes FROM repositories r
          LEFT JOIN (SELECT repo, count(*) AS nodes FROM ownership GROUP BY repo) o ON o.repo = r.name)
    FULL JOIN (SELECT repo, sum(n) AS n FROM stats WHERE day >= DATE '{NOW[:10]}' - 29 AND repo <> '' GROUP BY repo) s
      ON s.repo = name
    """,
)
def h10_repo_details(t):
    stat = usage.daily_counts(t.usage_samples())
    return usage.repo_details(t.repositories(), t.ownership(), stat, F.lit(NOW).cast("timestamp"))


@query(
    "h10_actor_details",
    """
    SELECT actor, CAST(sum(n) AS BIGINT) AS requests, count(DISTINCT CASE WHEN repo <> '' THEN repo END) AS repos
    FROM stats WHERE day >= DATE '2024-01-30' - 29 GROUP BY actor
    """,
)
def h10_actor_details(t):
    return usage.actor_details(usage.daily_counts(t.usage_samples()), today())


_RATE_SQL = """
    RECURSIVE lim AS (
      SELECT event_id, coalesce(actor, '-unattributed-') AS bucket, epoch_us(ts) AS u,
             row_number() OVER (PARTITION BY coalesce(actor, '-unattributed-') ORDER BY ts, event_id) AS rn
      FROM (SELECT *, {req} FROM ev) WHERE path <> '/health'),
    dec(event_id, bucket, rn, ws, cnt, allowed, retry_after) AS (
      SELECT event_id, bucket, rn, u, 1, true, 0 FROM lim WHERE rn = 1
      UNION ALL
      SELECT l.event_id, l.bucket, l.rn,
             CASE WHEN u - ws >= 60000000 THEN u ELSE ws END,
             CASE WHEN u - ws >= 60000000 THEN 1 WHEN cnt >= 2 THEN cnt ELSE cnt + 1 END,
             u - ws >= 60000000 OR cnt < 2,
             CASE WHEN u - ws >= 60000000 OR cnt < 2 THEN 0 ELSE (60000000 - (u - ws)) // 1000000 + 1 END
      FROM dec d JOIN lim l ON l.bucket = d.bucket AND l.rn = d.rn + 1)
"""


@query(
    "h11_rate_decisions",
    _RATE_SQL.format(req=_REQ)
    + """
    SELECT event_id AS request_id, allowed, CAST(retry_after AS BIGINT) AS retry_after FROM dec
    UNION ALL
    SELECT event_id, true, 0 FROM ev WHERE k % 13 = 0
    """,
)
def h11_rate_decisions(t):
    return usage.decide_requests(t.rate_requests(), 2).select("request_id", "allowed", "retry_after")


def _replay(t, df, name, **options):
    """Write ``df`` to the work folder and read it back as a stream source."""
    path = f"{work_folder(t.spark)}/{name}"
    df.write.parquet(path)
    return t.spark.readStream.options(**options).schema(df.schema).parquet(path)


def _drain(writer):
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


@query(
    "h2_daily_counts_stream",
    "SELECT strftime(day, '%Y-%m-%d') AS day, actor, endpoint, repo, n FROM stats",
)
def h2_daily_counts_stream(t):
    stream = _replay(t, t.usage_samples(), "samples")
    base = work_folder(t.spark)
    _drain(usage_streams.daily_counts_sink(stream, f"{base}/stat", f"{base}/ckpt"))
    return usage.fold_counts(t.spark.read.parquet(f"{base}/stat"))


@query(
    "h2_folded_counts",
    "SELECT strftime(day, '%Y-%m-%d') AS day, actor, endpoint, repo, n FROM stats",
)
def h2_folded_counts(t):
    """Counts read from two folds of closed days and the deltas beyond them, folded deltas deleted."""
    samples = t.usage_samples().repartition(4, "actor")
    stream = _replay(t, samples, "samples", maxFilesPerTrigger=1)
    base = work_folder(t.spark)
    _drain(usage_streams.daily_counts_sink(stream, f"{base}/stat", f"{base}/ckpt"))
    days = [str(r.day) for r in t.usage_samples().select(F.to_date("at").alias("day")).distinct().orderBy("day").collect()]
    for before, upto in ((days[len(days) // 3], 1), (days[len(days) // 2], 2)):
        usage_streams.fold_closed_days(t.spark, f"{base}/stat", before, upto)
        usage_streams.drop_folded(t.spark, f"{base}/stat")
    return usage.fold_counts(usage_streams.stat_rows(t.spark, f"{base}/stat"))


@query(
    "a6_access_sink_stream",
    """
    SELECT actor, repo, count(*) AS touches FROM access
    WHERE strftime("at", '%Y-%m-%d-%H') >= (SELECT strftime(max("at") - INTERVAL 48 HOURS, '%Y-%m-%d-%H') FROM access)
    GROUP BY actor, repo
    """,
)
def a6_access_sink_stream(t):
    samples = t.usage_samples()
    base = work_folder(t.spark)
    _drain(usage_streams.access_sink(_replay(t, samples, "samples"), f"{base}/access", f"{base}/ckpt"))
    touched = usage.access_log(samples).agg(F.max("at").alias("at"))
    cutoff = touched.select(F.date_format(F.col("at") - F.expr("INTERVAL 48 HOURS"), "yyyy-MM-dd-HH")).first()[0]
    usage_streams.drop_old_hours(t.spark, f"{base}/access", cutoff)
    kept = t.spark.read.schema("actor string, repo string, at timestamp, batch_id long, hour string").parquet(f"{base}/access")
    return kept.groupBy("actor", "repo").agg(F.count(F.lit(1)).alias("touches"))


@query(
    "h9_sliding_anomalies_stream",
    """
    SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, actor,
           count(DISTINCT repo) AS repo_count, count(*) AS requests,
           string_agg(DISTINCT repo, '|' ORDER BY repo) AS repos,
           strftime(min("at"), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max("at"), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM (SELECT actor, repo, "at", unnest(generate_series(time_bucket(INTERVAL 5 MINUTES, "at") - INTERVAL 55 MINUTES,
                 time_bucket(INTERVAL 5 MINUTES, "at"), INTERVAL 5 MINUTES)) AS ws FROM access WHERE actor <> 'internal')
    WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 2 HOURS
    GROUP BY ws, actor HAVING count(DISTINCT repo) >= 2
    """,
)
def h9_sliding_anomalies_stream(t):
    stream = _replay(t, t.usage_samples(), "samples")
    base = work_folder(t.spark)
    found = usage_streams.sliding_anomalies(stream, 2, delay="2 hours")
    writer = found.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/ckpt"
    )
    _drain(writer)
    return t.spark.read.schema(found.schema).parquet(f"{base}/out")


@query(
    "h11_rate_decisions_stream",
    _RATE_SQL.format(req=_REQ)
    + "SELECT event_id AS request_id, bucket, allowed, CAST(retry_after AS BIGINT) AS retry_after FROM dec",
)
def h11_rate_decisions_stream(t):
    stream = _replay(t, t.rate_requests(), "requests")
    base = work_folder(t.spark)
    _drain(usage_streams.rate_decisions_sink(stream, f"{base}/out", 2, f"{base}/ckpt"))
    return t.spark.read.parquet(f"{base}/out").select("request_id", "bucket", "allowed", "retry_after")


_PUSH = """
    SELECT m.name AS repo, ref, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, sha1(CAST(k AS VARCHAR)) AS after
    FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 'refs/heads/dev' ELSE 'refs/heads/main' END AS ref FROM ev)
    JOIN manifest m ON m.name = 'NATION_' || (k % 25) AND ref = 'refs/heads/' || m.branch
    WHERE event_type <> 'error'
"""


@query("h12_match_pushes", _PUSH)
def h12_match_pushes(t):
    return indexing.match_pushes(t.push_events(), t.manifest())


@query("h13_pending_repositories", f"SELECT DISTINCT repo FROM ({_PUSH})")
def h13_pending_repositories(t):
    return indexing.pending_repositories(indexing.match_pushes(t.push_events(), t.manifest()))


@query("h13_pending_repositories_stream", f"SELECT DISTINCT repo FROM ({_PUSH})")
def h13_pending_repositories_stream(t):
    stream = _replay(t, t.push_events(), "pushes")
    base = work_folder(t.spark)

    def store(pending, batch_id):
        pending.write.mode("overwrite").parquet(f"{base}/pending/batch_id={batch_id}")

    _drain(push_streams.coalesced_runs(stream, t.manifest(), store, f"{base}/ckpt"))
    return t.spark.read.parquet(f"{base}/pending").select("repo").distinct()


@query("h13_distinct_pushes_stream", f"SELECT DISTINCT repo FROM ({_PUSH})")
def h13_distinct_pushes_stream(t):
    base = work_folder(t.spark)
    found = push_streams.distinct_pushes(_replay(t, t.push_events(), "pushes"), t.manifest())
    writer = found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
    _drain(writer)
    return t.spark.read.schema(found.schema).parquet(f"{base}/out").select("repo").distinct()


# --- manifest, history, status ---------------------------------------------

_NAME = rules.REPO_NAME_RE
_BRANCH = rules.BRANCH_RE

_REASON = f"""
    CASE WHEN archived THEN 'archived' WHEN NOT regexp_matches(name, '{_NAME}') THEN 'invalid name'
         WHEN coalesce(url, '') = '' OR coalesce(branch, '') = '' THEN 'missing url or branch'
         WHEN NOT regexp_matches(branch, '{_BRANCH}') THEN 'invalid branch' END
"""


@query(
    "a4_check_manifest",
    f"""
    SELECT name, url, branch, coalesce(CASE WHEN NOT regexp_matches(name, '{_NAME}') THEN 'invalid name'
        WHEN coalesce(url, '') = '' THEN 'missing url' WHEN coalesce(branch, '') = '' THEN 'missing branch'
        WHEN NOT regexp_matches(branch, '{_BRANCH}') THEN 'invalid branch' END,
        CASE WHEN row_number() OVER (PARTITION BY name ORDER BY url NULLS FIRST, branch NULLS FIRST) > 1
             THEN 'duplicate name' END) AS problem
    FROM discovered
    """,
)
def a4_check_manifest(t):
    return indexing.check_manifest(t.discovered().select("name", "url", "branch"))


@query(
    "i1_resolve_manifest",
    f"""
    SELECT name, max(url) AS url, max(branch) AS branch FROM (SELECT *, {_REASON} AS reason FROM discovered)
    WHERE reason IS NULL AND name NOT IN (SELECT name FROM manifest) GROUP BY name
    UNION ALL SELECT name, url, branch FROM manifest
    """,
)
def i1_resolve_manifest(t):
    return indexing.resolve_manifest(t.discovered(), t.manifest())


@query(
    "i1_discovery_rejects",
    f"SELECT name, reason FROM (SELECT *, {_REASON} AS reason FROM discovered) WHERE reason IS NOT NULL",
)
def i1_discovery_rejects(t):
    return indexing.check_discovered(t.discovered()).where("reason IS NOT NULL").select("name", "reason")


_STATE = """
    live AS (SELECT *, started_at + to_milliseconds(duration_ms) AS ended FROM runs WHERE NOT canceled),
    st AS (SELECT repo, max_by(ended, run_seq) AS last_attempt_at, arg_max(status, run_seq) AS last_status,
      coalesce(max_by(duration_ms, run_seq), 0) AS last_duration_ms,
      max_by(status, run_seq) FILTER (WHERE status <> 'skipped') AS last_outcome,
      max_by(ended, run_seq) FILTER (WHERE status = 'success') AS last_indexed_at,
      max_by("commit", run_seq) FILTER (WHERE status = 'success') AS last_indexed_commit,
      max_by(schema_version, run_seq) FILTER (WHERE status = 'success') AS schema_version,
      max_by(nodes, run_seq) FILTER (WHERE status = 'success') AS last_nodes,
      max_by(links, run_seq) FILTER (WHERE status = 'success') AS last_links,
      max(run_seq) AS last_seq, max(run_seq) FILTER (WHERE status <> 'failed') AS calm
      FROM live GROUP BY repo),
    state AS (SELECT st.repo, last_attempt_at, last_status, CASE WHEN last_status = 'failed' THEN 'import' END AS last_stage,
      last_duration_ms, last_outcome, last_indexed_at, last_indexed_commit, schema_version, last_nodes, last_links,
      (SELECT count(*) FROM live l WHERE l.repo = st.repo AND status = 'failed' AND run_seq > coalesce(calm, -1)) AS consecutive_fails,
      CASE WHEN last_status = 'failed' THEN 'boom ' || last_seq ELSE '' END AS last_error FROM st)
"""


@query(
    "i3_fold_runs",
    f"""RECURSIVE {_STATE}
    SELECT * REPLACE (strftime(last_attempt_at, '%Y-%m-%d %H:%M:%S') AS last_attempt_at,
                      strftime(last_indexed_at, '%Y-%m-%d %H:%M:%S') AS last_indexed_at) FROM state""",
)
def i3_fold_runs(t):
    return indexing.fold_runs(t.run_results())


@query(
    "i2_needs_reindex",
    f"""RECURSIVE {_STATE}
    SELECT 'repo_' || c_custkey AS name, head, reason, reason <> 'unchanged' AS reindex FROM (
      SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN 'c' || (c_custkey % 3) END AS head,
        CASE WHEN last_outcome IS NULL OR last_indexed_commit IS NULL THEN 'never indexed'
             WHEN last_outcome <> 'success' THEN 'last run failed' WHEN schema_version <> 11 THEN 'schema changed'
             WHEN c_custkey % 9 = 0 THEN 'head unknown'
             WHEN 'c' || (c_custkey % 3) <> last_indexed_commit THEN 'new commit' ELSE 'unchanged' END AS reason
      FROM customer LEFT JOIN state ON repo = 'repo_' || c_custkey)
    """,
)
def i2_needs_reindex(t):
    key = F.col("c_custkey")
    name = F.concat(F.lit("repo_"), key.cast("string"))
    manifest = t.table("customer").select(name.alias("name"))
    heads = t.table("customer").where(key % 9 != 0).select(
        name.alias("repo"), F.concat(F.lit("c"), (key % 3).cast("string")).alias("head")
    )
    return indexing.needs_reindex(manifest, heads, indexing.fold_runs(t.run_results()))


@query(
    "i4_status_snapshot",
    f"""RECURSIVE {_STATE}
    SELECT 'repo_' || c_custkey AS name, 'main' AS branch, coalesce(last_status, '') AS last_status,
      coalesce(last_stage, '') AS last_stage, coalesce(last_indexed_commit, '') AS last_indexed_commit,
      strftime(last_indexed_at, '%Y-%m-%d %H:%M:%S') AS last_indexed_at,
      strftime(last_attempt_at, '%Y-%m-%d %H:%M:%S') AS last_attempt_at, coalesce(last_error, '') AS last_error,
      coalesce(consecutive_fails, 0) AS consecutive_fails, c_mktsegment = 'BUILDING' AS pending_reindex
    FROM customer LEFT JOIN state ON repo = 'repo_' || c_custkey
    """,
)
def i4_status_snapshot(t):
    name = F.concat(F.lit("repo_"), F.col("c_custkey").cast("string"))
    customer = t.table("customer")
    manifest = customer.select(name.alias("name"), F.lit("main").alias("branch"))
    pending = customer.where("c_mktsegment = 'BUILDING'").select(name.alias("repo"))
    return indexing.status_snapshot(manifest, indexing.fold_runs(t.run_results()), pending)


@query(
    "i5_run_summary",
    """
    SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
           count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed
    FROM runs
    """,
)
def i5_run_summary(t):
    return indexing.run_summary(t.run_results())


def _warned(t):
    key = F.col("n_nationkey")
    seconds = F.unix_timestamp(F.lit(NOW)) - key * 300
    return t.table("nation").where(key % 2 == 0).select(
        F.col("n_name").alias("name"), F.timestamp_seconds(seconds).alias("warned_at")
    )


@query(
    "i6_plan_retirement",
    """
    SELECT n_name AS name, CASE WHEN n_nationkey % 5 <> 4 THEN 'cancel' WHEN n_nationkey % 2 <> 0 THEN 'warn'
      WHEN n_nationkey * 300 < 3600 THEN 'pending' ELSE 'delete' END AS action
    FROM nation WHERE n_nationkey % 5 = 4 OR n_nationkey % 2 = 0
    """,
)
def i6_plan_retirement(t):
    from loomgraph.operators.reports import repository_names

    names = repository_names(t.repositories(), t.entities())
    return indexing.plan_retirement(names, t.manifest(), _warned(t), F.lit(NOW).cast("timestamp"))


@query(
    "i6_plan_retirement_guarded",
    """
    SELECT n_name AS name, CASE WHEN n_nationkey >= 5 THEN 'guarded' ELSE 'cancel' END AS action
    FROM nation WHERE n_nationkey >= 5 OR n_nationkey % 2 = 0
    """,
)
def i6_plan_retirement_guarded(t):
    kept = t.table("nation").where("n_nationkey < 5").select(F.col("n_name").alias("name"))
    return indexing.plan_retirement(
        t.repositories(), kept, _warned(t), F.lit(NOW).cast("timestamp")
    )


@query(
    "i7_import_verdict",
    """
    SELECT repo, CASE WHEN error = '' THEN 'success' ELSE 'failed' END AS status, error FROM (
      SELECT 'NATION_' || c_nationkey || '_' || c_custkey AS repo, concat_ws('; ',
        CASE WHEN c_custkey % 6 = 1 THEN 'node-count mismatch (imported ' || c_custkey || ', graph holds ' || (c_custkey - 1) || ')' END,
        CASE WHEN c_custkey % 5 = 2 OR c_custkey % 7 = 3 THEN 'sweep residue (' || CASE WHEN c_custkey % 5 = 2 THEN 1 ELSE 0 END
             || ' nodes, ' || CASE WHEN c_custkey % 7 = 3 THEN 2 ELSE 0 END || ' rels)' END) AS error FROM customer)
    """,
)
def i7_import_verdict(t):
    k = F.col("c_custkey")
    rows = t.table("customer").select(
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit("_"), k.cast("string")).alias("repo"),
        k.alias("nodes_total"),
        F.when(k % 6 == 1, k - 1).otherwise(k).alias("nodes_in_graph"),
        F.when(k % 5 == 2, 1).otherwise(0).alias("residue_nodes"),
        F.when(k % 7 == 3, 2).otherwise(0).alias("residue_rels"),
    )
    return indexing.import_verdict(rows).select("repo", "status", "error")


@query(
    "i8_filter_repositories",
    "SELECT name, url, branch FROM manifest WHERE name IN ('NATION_3', 'NATION_11')",
)
def i8_filter_repositories(t):
    return indexing.filter_repositories(t.manifest(), ["NATION_11", "NATION_3", "NATION_3"])


@query(
    "i9_active_repositories",
    f"""
    SELECT name, strftime(pushed_at, '%Y-%m-%d %H:%M:%S') AS pushed_at FROM discovered
    WHERE NOT archived AND pushed_at >= DATE '{NOW[:10]}' - 90 AND regexp_matches(name, '{_NAME}')
    """,
)
def i9_active_repositories(t):
    return indexing.active_repositories(t.discovered(), F.lit(NOW).cast("timestamp")).select("name", "pushed_at")


@query(
    "d8_freshness_stamps",
    """
    SELECT repo AS name, strftime(max(ended) FILTER (WHERE status IN ('success', 'skipped')), '%Y-%m-%d %H:%M:%S') AS last_synced_at,
           strftime(max(ended) FILTER (WHERE status = 'success'), '%Y-%m-%d %H:%M:%S') AS last_indexed_at
    FROM (SELECT *, started_at + to_milliseconds(duration_ms) AS ended FROM runs WHERE NOT canceled) GROUP BY repo
    """,
)
def d8_freshness_stamps(t):
    return indexing.freshness_stamps(t.run_results())
