"""Usage: requests to samples, daily counts, rankings, anomalies, rate decisions.

The projections work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.columns import blank, or_empty
from loomgraph.operators.lookup import freshness
from loomgraph.session import cut_lineage, first, sized

# Endpoints whose second path segment names the repository.
PATH_SCOPED = ("overview", "dependencies")


def _query_values(query: Column, key: str) -> Column:
    """Decoded values of one query parameter."""
    pairs = F.filter(F.split(or_empty(query), "&"), lambda p: p.startswith(key + "="))
    return F.transform(pairs, lambda p: F.try_url_decode(p.substr(F.lit(len(key) + 2), F.length(p))))


def to_samples(requests: DataFrame, most_repos: int | None = None) -> DataFrame:
    """Successful, attributable requests as usage samples (H1); ``most_repos`` keeps the first of a request only."""
    trimmed = F.btrim(F.col("path"), F.lit("/"))
    endpoint = F.split_part(trimmed, F.lit("/"), F.lit(1))
    subject = F.split_part(trimmed, F.lit("/"), F.lit(2))
    listed = F.concat(_query_values(F.col("query"), "repo"), _query_values(F.col("query"), "repos"))
    names = F.transform(
        F.flatten(F.transform(listed, lambda v: F.split(or_empty(v), ","))), lambda n: F.trim(n)
    )
    asked = F.filter(names, lambda n: n != "")
    asked = asked if most_repos is None else F.slice(asked, 1, most_repos)
    scoped = endpoint.isin(*PATH_SCOPED) & (subject != "")
    return (
        requests.where((F.col("status") < 400) & (trimmed != ""))
        .where(~endpoint.isin(*rules.UNRECORDED_ENDPOINTS))
        .select(
            F.when(blank(F.col("actor")), F.lit(rules.SHARED_ACTOR)).otherwise(F.col("actor")).alias("actor"),
            endpoint.alias("endpoint"),
            F.when(scoped, F.array(subject)).otherwise(asked).alias("repos"),
            "at",
        )
    )


def usage_keys(samples: DataFrame) -> DataFrame:
    """One row per (sample, repository), '' when a sample names none."""
    return samples.select(
        F.to_date("at").alias("day"), "actor", "endpoint",
        F.explode(F.when(F.size("repos") > 0, F.col("repos")).otherwise(F.array(F.lit("")))).alias("repo"),
    )


def daily_counts(samples: DataFrame) -> DataFrame:
    """Requests per (day, actor, endpoint, repository) (H2)."""
    return usage_keys(samples).groupBy("day", "actor", "endpoint", "repo").agg(
        F.count(F.lit(1)).alias("n")
    )


def fold_counts(stat: DataFrame) -> DataFrame:
    """Appended count deltas summed per key; the state every reader sees."""
    return stat.groupBy("day", "actor", "endpoint", "repo").agg(F.sum("n").alias("n"))


def access_log(samples: DataFrame) -> DataFrame:
    """One row per repository touch (H3)."""
    return samples.select("actor", F.explode("repos").alias("repo"), "at")


def retained(access: DataFrame, now: Column, hours: int = rules.ACCESS_RETENTION_HOURS) -> DataFrame:
    """Touches inside the retention window (H4)."""
    return access.where(F.col("at") >= now - F.expr(f"INTERVAL {hours} HOURS"))


#: Days and rows that a report shows at most; every report takes another bound, or None for no bound.
MOST_DAYS = 365
MOST_RANKED = 100


def bound_days(days: int, most: int | None = MOST_DAYS) -> int:
    return 30 if days <= 0 else days if most is None else min(days, most)


def bound_limit(limit: int, most: int | None = MOST_RANKED) -> int:
    return 10 if limit <= 0 else limit if most is None else min(limit, most)


def _since(stat: DataFrame, today: Column, days: int, most_days: int | None = MOST_DAYS) -> DataFrame:
    return stat.where(F.col("day") >= F.date_sub(today, bound_days(days, most_days) - 1))


def _ranked(rows: DataFrame, field: str, limit: int | None) -> DataFrame:
    counts = rows.groupBy(F.col(field).alias("name")).agg(F.sum("n").alias("n"))
    return first(counts.orderBy(F.desc("n"), "name"), limit)


def rank_by(
    stat: DataFrame, field: str, today: Column, days: int = 0, limit: int = 0,
    most: int | None = MOST_RANKED, most_days: int | None = MOST_DAYS,
) -> DataFrame:
    """Busiest actors, repositories or endpoints (H5)."""
    if field not in ("actor", "repo", "endpoint"):
        raise ValueError(f"cannot rank by {field!r}")
    return _ranked(_since(stat, today, days, most_days).where(F.col(field) != ""), field, bound_limit(limit, most))


def traffic(stat: DataFrame, today: Column, days: int = 0, most_days: int | None = MOST_DAYS) -> DataFrame:
    """Requests per day, oldest first (H6)."""
    return _since(stat, today, days, most_days).groupBy("day").agg(F.sum("n").alias("n")).orderBy("day")


def total_requests(
    stat: DataFrame, today: Column, days: int = 0, actor=None, repo=None, most_days: int | None = MOST_DAYS
) -> DataFrame:
    """Requests in the window, optionally of one actor or repository (H7)."""
    rows = _since(stat, today, days, most_days)
    if actor is not None:
        rows = rows.where(F.col("actor") == actor)
    if repo is not None:
        rows = rows.where(F.col("repo") == repo)
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def actor_activity(
    stat: DataFrame, actor: str, today: Column, days: int = 0,
    limit: int | None = rules.ACTIVITY_CAP, most_days: int | None = MOST_DAYS,
) -> DataFrame:
    """Repositories one actor asked about (H8)."""
    rows = _since(stat, today, days, most_days).where((F.col("actor") == actor) & (F.col("repo") != ""))
    return _ranked(rows, "repo", limit)


def repo_activity(
    stat: DataFrame, repo: str, today: Column, days: int = 0,
    limit: int | None = rules.ACTIVITY_CAP, most_days: int | None = MOST_DAYS,
) -> DataFrame:
    """Actors who asked about one repository (H8)."""
    rows = _since(stat, today, days, most_days).where(F.col("repo") == repo)
    return _ranked(rows, "actor", limit)


def anomalies(
    access: DataFrame, now: Column, window_seconds: int = 3600, threshold: int = 10, limit: int | None = None
) -> DataFrame:
    """All actors touching many repositories in the trailing window (H9); a report may set ``limit`` (``rules.ANOMALY_CAP``).

    Folded per (actor, repository) first, so the list of an actor is built from
    distinct repositories only.
    """
    window_seconds = window_seconds if window_seconds > 0 else 3600
    threshold = threshold if threshold > 0 else 10
    recent = access.where(
        (F.col("at") >= now - F.make_dt_interval(secs=F.lit(window_seconds)))
        & (F.col("actor") != rules.SHARED_ACTOR)
    )
    per_repo = recent.groupBy("actor", "repo").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    rows = (
        per_repo.groupBy("actor")
        .agg(
            F.count("repo").alias("repo_count"),
            F.sum("n").alias("requests"),
            F.sort_array(F.collect_list("repo")).alias("repos"),
            F.min("first").alias("first_seen"),
            F.max("last").alias("last_seen"),
        )
        .where(F.col("repo_count") >= threshold)
    )
    return first(rows.orderBy(F.desc("repo_count"), "actor"), limit)


def repo_details(repositories, ownership, stat, now: Column, days: int = 0) -> DataFrame:
    """Size, age and requests of every repository known or asked about.

    A name that only appears in usage is listed as not indexed, with zeros.
    """
    sizes = ownership.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"))
    indexed = (
        repositories.select(F.col("name").alias("repo"), F.lit(True).alias("indexed"))
        .join(sizes, "repo", "left")
        .join(freshness(repositories, now, clamp=True).select("repo", "age_seconds", "stale"), "repo", "left")
    )
    asked = (
        _since(stat, F.to_date(now), days).where(F.col("repo") != "")
        .groupBy("repo").agg(F.sum("n").alias("requests"))
    )
    return indexed.join(asked, "repo", "full_outer").select(
        "repo",
        F.coalesce("nodes", F.lit(0)).alias("nodes"),
        F.coalesce("age_seconds", F.lit(0)).alias("age_seconds"),
        F.coalesce("stale", F.lit(False)).alias("stale"),
        F.coalesce("indexed", F.lit(False)).alias("indexed"),
        F.coalesce("requests", F.lit(0)).alias("requests"),
    )


def actor_details(stat: DataFrame, today: Column, days: int = 0) -> DataFrame:
    """Requests and distinct repositories of every actor."""
    per_repo = _since(stat, today, days).groupBy("actor", "repo").agg(F.sum("n").alias("n"))
    return per_repo.groupBy("actor").agg(
        F.sum("n").alias("requests"), F.count(F.when(F.col("repo") != "", True)).alias("repos")
    )


# --- rate decisions (H11) --------------------------------------------------

_WINDOW_US = 60_000_000


def decide_requests(requests: DataFrame, per_minute: int) -> DataFrame:
    """Fixed-window rate decision for each request, in batch.

    Columns ``actor, path, at`` plus ``request_id`` in; adds ``allowed`` and
    ``retry_after`` (whole seconds, rounded up as the limiter reports them).

    A window opens at an actor's first request and again at the first request
    60 s or more later, so windows form a chain.  The chain is never walked in
    one task: requests are folded per (actor, minute), minutes are cut into runs
    at gaps of 60 s, and runs in which no two neighbouring minutes exceed the
    limit are allowed whole.  Only the others are chained, by pointer doubling
    over their distinct request times.
    """
    rows = limited_requests(requests)
    ruled, _ = decide(rows, per_minute)
    free = requests.join(rows.select("request_id"), "request_id", "left_anti").select(
        "request_id", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after")
    )
    return requests.join(ruled.select("request_id", "allowed", "retry_after").unionByName(free), "request_id")


def limited_requests(requests: DataFrame) -> DataFrame:
    """(request_id, bucket, t) of the requests that count; t in microseconds."""
    bucket = F.when(blank(F.col("actor")), F.lit(rules.UNATTRIBUTED_BUCKET)).otherwise(F.col("actor"))
    return requests.where(~F.col("path").isin("/health", "/ready")).select(
        "request_id", bucket.alias("bucket"), F.unix_micros("at").alias("t")
    )


def _ruled(rows: DataFrame, keys: list[str], per_minute: int, taken: Column) -> DataFrame:
    """Adds allowed and retry_after to rows of windows (``keys``, window_start) of which ``taken`` places are gone.

    Among equal times the smaller id comes first, as in a queue.  Only the first
    ``per_minute`` rows of a window are ranked, which each task does before the
    shuffle, so a bucket that holds half of all requests is never in one place.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "request_id"))
    first_ones = rows.withColumn("seq", rank).where(F.col("seq") <= per_minute)
    passed = first_ones.where(F.col("seq") + taken <= per_minute).select("request_id", F.lit(True).alias("passed"))
    allowed = F.coalesce("passed", F.lit(False))
    wait = F.floor((_WINDOW_US - (F.col("t") - F.col("window_start"))) / 1_000_000) + 1
    return rows.join(passed, "request_id", "left").select(
        "request_id", "bucket", "t", "window_start", allowed.alias("allowed"), F.when(allowed, 0).otherwise(wait).alias("retry_after")
    )


def decide(rows: DataFrame, per_minute: int, carried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions for (request_id, bucket, t), and each bucket's last window (bucket, window_start, taken).

    ``carried`` is such a table of windows that were open before: a request within
    60 seconds of its bucket's window, or before it (a late one), belongs to it.
    The first request after it opens a window as in a bucket without one.
    """
    parts = []
    if carried is not None:
        carried = cut_lineage(carried)
        known = sized(carried.withColumnRenamed("window_start", "held"), carried.count())
        rows = rows.join(known, "bucket", "left").withColumn("inside", F.coalesce(F.col("t") - F.col("held") < _WINDOW_US, F.lit(False)))
        rows = cut_lineage(rows)
        inside = rows.where("inside").withColumnRenamed("held", "window_start")
        parts.append(_ruled(inside, ["bucket"], per_minute, F.col("taken")))
        rows = rows.where("NOT inside").select("request_id", "bucket", "t")
    limited = rows.withColumn("minute", _slot(F.col("t")))
    per_bin = limited.groupBy("bucket", "minute").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last")
    )
    order = Window.partitionBy("bucket").orderBy("minute")
    gap = F.col("first") - F.lag("last").over(order) >= _WINDOW_US
    near = F.when(F.lead("minute").over(order) == F.col("minute") + 1, F.lead("n").over(order)).otherwise(0)
    bins = (
        per_bin.withColumn("opens", F.coalesce(gap, F.lit(True)).cast("int"))
        .withColumn("over", (F.col("n") + near > per_minute).cast("int"))
        .withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("bucket", "minute", "run", "over", "first")
    )
    runs = bins.groupBy("bucket", "run").agg(F.max("over").alias("over"), F.min("first").alias("start"))
    # Windows are worked out where a request may be refused, and in the last run of a bucket, whose last window is carried on.
    last = runs.groupBy("bucket").agg(F.max("run").alias("last_run"))
    runs = runs.join(last, "bucket").withColumn("hot", (F.col("over") == 1) | (F.col("run") == F.col("last_run")))
    marked = bins.select("bucket", "minute", "run").join(runs, ["bucket", "run"])
    placed = cut_lineage(limited.join(marked, ["bucket", "minute"]).select("request_id", "bucket", "run", "t", "start", "hot"))
    hot = placed.where("hot").drop("hot")
    owner = _assign_windows(hot, _window_starts(hot))
    parts.append(_ruled(owner, ["bucket", "run", "window_start"], per_minute, F.lit(0)))
    calm = placed.where("NOT hot").select("request_id", "bucket", "t", F.lit(None).cast("long").alias("window_start"), F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"))
    parts.append(calm)
    done = cut_lineage(reduce(DataFrame.unionByName, parts))
    return done, _last_windows(done, carried)


def _last_windows(done: DataFrame, carried: DataFrame | None) -> DataFrame:
    """The latest window of each bucket and how many of its places are taken."""
    windows = done.where("window_start IS NOT NULL").groupBy("bucket", "window_start").agg(
        F.count_if("allowed").alias("taken")
    )
    if carried is not None:
        windows = windows.unionByName(carried.select("bucket", "window_start", "taken"))
    windows = windows.groupBy("bucket", "window_start").agg(F.sum("taken").alias("taken"))
    return windows.groupBy("bucket").agg(F.max(F.struct("window_start", "taken")).alias("w")).select("bucket", "w.*")


def _slot(micros: Column) -> Column:
    return F.floor(micros / _WINDOW_US)


def _first_at_or_after(probes: DataFrame, times: DataFrame) -> DataFrame:
    """For probes (bucket, run, t, at) the first of ``times`` (bucket, run, t) with t >= at.

    Both sides meet in 60-second slots, so no task sees more than one slot of a
    bucket; a probe that finds nothing in its slot takes the first time of the
    next slot that has one.
    """
    keys = ["bucket", "run"]
    points = times.select(
        *keys, _slot(F.col("t")).alias("slot"), F.col("t").alias("when"), F.lit(None).cast("long").alias("probe")
    )
    asks = probes.select(
        *keys, _slot(F.col("at")).alias("slot"), F.col("at").alias("when"), F.col("t").alias("probe")
    )
    both = points.unionByName(asks)
    # Walking a slot backwards, the last time seen is the first one at or after a probe.
    backwards = Window.partitionBy(*keys, "slot").orderBy(
        F.desc("when"), F.col("probe").asc_nulls_first()
    ).rowsBetween(Window.unboundedPreceding, 0)
    is_time = F.col("probe").isNull()
    local = both.withColumn("found", F.last(F.when(is_time, F.col("when")), ignorenulls=True).over(backwards))
    # One row per slot: the first time of the next slot that has any.
    after = Window.partitionBy(*keys).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = both.groupBy(*keys, "slot").agg(F.min(F.when(is_time, F.col("when"))).alias("slot_first"))
    following = slots.select(
        *keys, "slot", F.last("slot_first", ignorenulls=True).over(after).alias("next_first")
    )
    return local.where(~is_time).join(following, [*keys, "slot"]).select(
        *keys, F.col("probe").alias("t"), F.coalesce("found", "next_first").alias("next")
    )


def _window_starts(hot: DataFrame) -> DataFrame:
    """Window starts of each run: the orbit of its first time, by pointer doubling."""
    keys = ["bucket", "run"]
    times = cut_lineage(hot.select(*keys, "t").distinct())
    probes = times.withColumn("at", F.col("t") + 60_000_000)
    jump = cut_lineage(_first_at_or_after(probes, times).where(F.col("next").isNotNull()))
    reached = cut_lineage(hot.select(*keys, F.col("start").alias("t")).distinct())
    while not jump.isEmpty():
        landed = reached.join(jump, [*keys, "t"]).select(*keys, F.col("next").alias("t"))
        reached = cut_lineage(reached.unionByName(landed).distinct())
        hop = jump.select(*keys, F.col("t").alias("next"), F.col("next").alias("after"))
        jump = cut_lineage(
            jump.join(hop, [*keys, "next"]).select(*keys, "t", F.col("after").alias("next"))
        )
    return reached


def _assign_windows(hot: DataFrame, starts: DataFrame) -> DataFrame:
    """Give each request the latest window start not after it.

    A window spans 60 s, so the start lies in the request's own slot or the one
    before: an equi-join on two slots.
    """
    slot = _slot(F.col("t"))
    opened = starts.select(
        "bucket", "run", F.col("t").alias("window_start"),
        F.explode(F.array(slot, slot + 1)).alias("slot"),
    )
    # A start opens a slot and at most one more, so a slot sees at most three starts.
    return (
        hot.withColumn("slot", slot)
        .join(opened, ["bucket", "run", "slot"])
        .where("window_start <= t AND t - window_start < 60000000")
        .select("request_id", "bucket", "run", "t", "window_start")
    )
