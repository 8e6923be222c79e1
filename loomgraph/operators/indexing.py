"""Manifest, change detection, run history, retirement (group I, A4, D8) and push matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.columns import blank, normalize_remote, or_empty


def _manifest_problem(name: Column, url: Column, branch: Column) -> Column:
    return (
        F.when(blank(name), "missing name")
        .when(~name.rlike(rules.REPO_NAME_RE), "invalid name")
        .when(blank(url), "missing url")
        .when(blank(branch), "missing branch")
        .when(~branch.rlike(rules.BRANCH_RE), "invalid branch")
    )


def check_manifest(manifest: DataFrame) -> DataFrame:
    """Every manifest entry with the first rule it breaks, null when sound (A4)."""
    same_name = Window.partitionBy("name").orderBy("url", "branch")
    problem = _manifest_problem(F.col("name"), F.col("url"), F.col("branch"))
    return (
        manifest.withColumn("_n", F.row_number().over(same_name))
        .withColumn("problem", F.coalesce(problem, F.when(F.col("_n") > 1, "duplicate name")))
        .drop("_n")
    )


def valid_manifest(manifest: DataFrame) -> DataFrame:
    return check_manifest(manifest).where(F.col("problem").isNull()).drop("problem")


def check_discovered(discovered: DataFrame) -> DataFrame:
    """Discovered repositories with the reason they are skipped, if any."""
    name, url, branch = F.col("name"), F.col("url"), F.col("branch")
    return discovered.withColumn(
        "reason",
        F.when(F.coalesce("archived", F.lit(False)), "archived")
        .when(~or_empty(name).rlike(rules.REPO_NAME_RE), "invalid name")
        .when(blank(url) | blank(branch), "missing url or branch")
        .when(~branch.rlike(rules.BRANCH_RE), "invalid branch"),
    )


def resolve_manifest(discovered: DataFrame, static: DataFrame) -> DataFrame:
    """Sound discovered repositories overlaid by static entries."""
    found = check_discovered(discovered).where(F.col("reason").isNull())
    # Discovery lists a name once; should it repeat, one row is kept.
    found = found.groupBy("name").agg(F.max_by(F.struct("url", "branch"), F.struct("url", "branch")).alias("e"))
    found = found.select("name", "e.url", "e.branch")
    fixed = static.select("name", "url", "branch")
    return (
        found.join(fixed, "name", "left_anti").unionByName(fixed).orderBy("name")
    )


def fold_runs(run_results: DataFrame) -> DataFrame:
    """Per-repository state after all its runs, canceled ones ignored.

    Ordered aggregates instead of a window: they combine before the shuffle, so
    a repository with very many runs is no hot spot.
    """
    rows = run_results.where(~F.coalesce("canceled", F.lit(False)))
    ended = F.timestamp_micros(F.unix_micros("started_at") + F.col("duration_ms") * 1000)
    rows = rows.withColumn("ended_at", ended)
    ok = F.when(F.col("status") == "success", F.col("run_seq"))
    real = F.when(F.col("status") != "skipped", F.col("run_seq"))
    calm = F.when(F.col("status") != "failed", F.col("run_seq"))
    state = rows.groupBy("repo").agg(
        F.max_by("ended_at", "run_seq").alias("last_attempt_at"),
        F.max_by("status", "run_seq").alias("last_status"),
        F.max_by("stage", "run_seq").alias("last_stage"),
        F.max_by("duration_ms", "run_seq").alias("last_duration_ms"),
        F.max_by("status", real).alias("last_outcome"),
        F.max_by("ended_at", ok).alias("last_indexed_at"),
        F.max_by("commit", ok).alias("last_indexed_commit"),
        F.max_by("schema_version", ok).alias("schema_version"),
        F.max_by("nodes", ok).alias("last_nodes"),
        F.max_by("links", ok).alias("last_links"),
        F.max_by("error", "run_seq").alias("_error"),
        F.max(calm).alias("_calm"),
    )
    fails = (
        rows.where("status = 'failed'")
        .select("repo", "run_seq")
        .join(state.select("repo", "_calm"), "repo")
        .where(F.col("run_seq") > F.coalesce("_calm", F.lit(-1)))
        .groupBy("repo")
        .agg(F.count(F.lit(1)).alias("consecutive_fails"))
    )
    return (
        state.join(fails, "repo", "left")
        .withColumn("last_error", F.when(F.col("last_status") == "failed", or_empty(F.col("_error"))).otherwise(""))
        .withColumn("consecutive_fails", F.coalesce("consecutive_fails", F.lit(0)))
        .drop("_error", "_calm")
    )


def needs_reindex(manifest: DataFrame, heads: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Which repositories to index, and why.

    A repository is skipped when its last real outcome was a success at the same
    commit and schema version.
    """
    rows = manifest.select("name").join(
        heads.select(F.col("repo").alias("name"), "head"), "name", "left"
    ).join(
        state.select(
            F.col("repo").alias("name"), "last_outcome", "last_indexed_commit", "schema_version"
        ),
        "name", "left",
    )
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("last_outcome").isNull() | F.col("last_indexed_commit").isNull(), "never indexed")
        .when(F.col("last_outcome") != "success", "last run failed")
        .when(F.col("schema_version") != rules.GRAPH_SCHEMA_VERSION, "schema changed")
        .when(F.col("head").isNull(), "head unknown")
        .when(F.col("head") != F.col("last_indexed_commit"), "new commit")
        .otherwise("unchanged")
    )
    return rows.select("name", "head", reason.alias("reason")).withColumn(
        "reindex", F.col("reason") != "unchanged"
    )


def status_snapshot(manifest: DataFrame, state: DataFrame, pending: DataFrame) -> DataFrame:
    """State of every manifest repository, never-attempted ones included (I4)."""
    queued = pending.select(F.col("repo").alias("name"), F.lit(True).alias("pending_reindex")).distinct()
    return (
        manifest.select("name", "branch")
        .join(state.withColumnRenamed("repo", "name"), "name", "left")
        .join(queued, "name", "left")
        .select(
            "name", "branch",
            or_empty(F.col("last_status")).alias("last_status"),
            or_empty(F.col("last_stage")).alias("last_stage"),
            or_empty(F.col("last_indexed_commit")).alias("last_indexed_commit"),
            "last_indexed_at", "last_attempt_at",
            or_empty(F.col("last_error")).alias("last_error"),
            F.coalesce("consecutive_fails", F.lit(0)).alias("consecutive_fails"),
            F.coalesce("pending_reindex", F.lit(False)).alias("pending_reindex"),
        )
        .orderBy("name")
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Totals by outcome."""
    def of(status):
        return F.count(F.when(F.col("status") == status, True)).alias(status)

    return results.agg(F.count(F.lit(1)).alias("total"), of("success"), of("skipped"), of("failed"))


def plan_retirement(
    graph_repos: DataFrame, manifest: DataFrame, warned: DataFrame, now: Column,
    grace_seconds: int = 3600, targeted: bool = False,
) -> DataFrame:
    """Action for each repository missing from the manifest or back in it.

    ``graph_repos(name)``, ``warned(name, warned_at)``.  When more than one and
    more than half of the graph is missing, nothing is retired.
    """
    known = manifest.select("name", F.lit(True).alias("_known"))
    joined = graph_repos.select("name").distinct().join(known, "name", "left")
    totals = joined.agg(
        F.struct(
            F.count(F.lit(1)).alias("all"),
            F.count(F.when(F.col("_known").isNull(), True)).alias("missing"),
        )
    )
    missing = joined.where(F.col("_known").isNull()).select("name").join(
        warned.select("name", "warned_at"), "name", "left"
    ).withColumn("t", totals.scalar())
    mass = (F.col("t.missing") > 1) & (F.col("t.missing") > F.floor(F.col("t.all") / 2))
    action = (
        F.when(mass, "guarded")
        .when(F.col("warned_at").isNull(), "warn")
        .when(F.unix_timestamp(now) - F.unix_timestamp("warned_at") < grace_seconds, "pending")
        .otherwise("delete")
    )
    gone = missing.select("name", action.alias("action"))
    back = warned.where(F.col("warned_at").isNotNull()).join(known, "name", "left_semi").select(
        "name", F.lit("cancel").alias("action")
    )
    plan = gone.unionByName(back)
    return plan.where(F.lit(False)) if targeted else plan.orderBy("name")


def import_verdict(summaries: DataFrame) -> DataFrame:
    """Success unless counts disagree or the sweep left residue."""
    mismatch = F.col("nodes_total") != F.col("nodes_in_graph")
    residue = (F.col("residue_nodes") > 0) | (F.col("residue_rels") > 0)
    reasons = F.concat_ws(
        "; ",
        F.when(mismatch, F.format_string(
            "node-count mismatch (imported %d, graph holds %d)", "nodes_total", "nodes_in_graph")),
        F.when(residue, F.format_string("sweep residue (%d nodes, %d rels)", "residue_nodes", "residue_rels")),
    )
    return summaries.withColumn("error", reasons).withColumn(
        "status", F.when(reasons == "", "success").otherwise("failed")
    )


def freshness_stamps(run_results: DataFrame) -> DataFrame:
    """Sync and index stamps from run outcomes."""
    ended = F.timestamp_micros(F.unix_micros("started_at") + F.col("duration_ms") * 1000)
    live = run_results.where(~F.coalesce("canceled", F.lit(False))).withColumn("ended", ended)
    return live.groupBy(F.col("repo").alias("name")).agg(
        F.max(F.when(F.col("status").isin("success", "skipped"), F.col("ended"))).alias("last_synced_at"),
        F.max(F.when(F.col("status") == "success", F.col("ended"))).alias("last_indexed_at"),
    )


def filter_repositories(manifest: DataFrame, names: list[str]) -> DataFrame:
    """The named subset of the manifest; an unknown name is an error (I8)."""
    if not names:
        return manifest
    wanted = manifest.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    unknown = [r.name for r in wanted.join(manifest, "name", "left_anti").orderBy("name").limit(20).collect()]
    if unknown:
        raise LookupError(f"unknown repositories: {unknown}")
    return manifest.join(wanted, "name", "left_semi")


def active_repositories(listed: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Repositories that are not archived and were pushed lately, with sound names."""
    cutoff = F.date_sub(F.to_date(now), days)
    return listed.where(
        ~F.coalesce("archived", F.lit(False))
        & (F.col("pushed_at") >= cutoff.cast("timestamp"))
        & or_empty(F.col("name")).rlike(rules.REPO_NAME_RE)
    )


# --- push events ------------------------------------------------------------


def match_pushes(pushes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Repositories a push concerns: same remote, tracked branch.

    ``pushes`` may be a stream; the manifest is static.  The first of the clone,
    ssh and html addresses that is known decides.
    """
    by_url = manifest.groupBy(normalize_remote(F.col("url")).alias("remote")).agg(
        F.collect_list(F.struct("name", "branch")).alias("entries")
    )
    rows = pushes.where(~F.coalesce("deleted", F.lit(False)))
    kinds = ("clone_url", "ssh_url", "html_url")
    for kind in kinds:
        url = F.col(f"repository.{kind}")
        rows = rows.withColumn(f"_{kind}", F.when(~blank(url), normalize_remote(url)))
        side = by_url.select(F.col("remote").alias(f"_{kind}"), F.col("entries").alias(f"_{kind}_entries"))
        rows = rows.join(side, f"_{kind}", "left")
    entry = F.explode(F.coalesce(*[F.col(f"_{k}_entries") for k in kinds])).alias("entry")
    return (
        rows.select("ref", "after", "at", entry)
        .where(F.col("ref") == F.concat(F.lit("refs/heads/"), "entry.branch"))
        .select(F.col("entry.name").alias("repo"), "ref", "after", "at")
    )


def pending_repositories(matched: DataFrame) -> DataFrame:
    """Many pushes, one pending name each, in sorted order."""
    return matched.select("repo").distinct().orderBy("repo")
