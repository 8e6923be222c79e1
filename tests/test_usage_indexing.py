import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import indexing, usage
from loomgraph.streaming import usage_streams

BASE = dt.datetime(2024, 1, 1)


def brute_decisions(rows, limit):
    """rows: (id, actor, path, at) -> id -> (allowed, retry)"""
    state, out = {}, {}
    for rid, actor, path, at in sorted(rows, key=lambda r: (r[3], r[0])):
        if path == "/health":
            out[rid] = (True, 0)
            continue
        key = actor or "-"
        if key not in state or (at - state[key][0]).total_seconds() >= 60:
            state[key] = [at, 0]
        start, count = state[key]
        if count < limit:
            state[key][1] += 1
            out[rid] = (True, 0)
        else:
            left = dt.timedelta(seconds=60) - (at - start)
            out[rid] = (False, int(left.total_seconds()) + 1)
    return out


def requests(spark, seed, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        actor = None if rnd.random() < 0.4 else f"u{rnd.randrange(5)}"
        span = 900 if actor else 1500
        at = BASE + dt.timedelta(milliseconds=rnd.randrange(span * 1000) // 500 * 500)
        rows.append((i, actor, "/health" if rnd.random() < 0.05 else "/x", at))
    return rows, spark.createDataFrame(rows, "request_id long, actor string, path string, at timestamp")


@pytest.mark.parametrize("seed,limit", [(1, 3), (2, 8), (3, 1)])
def test_rate_decisions_against_brute_force(spark, seed, limit):
    rows, df = requests(spark, seed)
    got = {r.request_id: (r.allowed, r.retry_after) for r in usage.decide_requests(df, limit).collect()}
    assert got == brute_decisions(rows, limit)


def drained(spark, path, schema, tmp_path, per_minute, **options):
    stream = spark.readStream.options(**options).schema(schema).parquet(path)
    out = str(tmp_path / "out")
    usage_streams.rate_decisions_sink(stream, out, per_minute, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return {r.request_id: (r.allowed, r.retry_after) for r in spark.read.parquet(out).collect()}


def limited(rows, per_minute):
    return {k: v for k, v in brute_decisions(rows, per_minute).items() if rows[k][2] != "/health"}


def test_rate_stream_equals_batch(spark, tmp_path):
    rows, df = requests(spark, 4, 200)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert drained(spark, str(tmp_path / "in"), df.schema, tmp_path, 2) == limited(rows, 2)


def test_rate_stream_carries_windows_from_batch_to_batch(spark, tmp_path):
    """Files in order of time, one a micro-batch; one bucket holds half of all requests."""
    rows, df = requests(spark, 5, 400)
    path, ordered = str(tmp_path / "in"), sorted(rows, key=lambda r: (r[3], r[0]))
    cuts = [0, 90, 100, 101, 230, 400]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(ordered[a:b], df.schema).coalesce(1)
        part.write.mode("append").parquet(path)
        newest = max((tmp_path / "in").glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))
    assert drained(spark, path, df.schema, tmp_path, 3, maxFilesPerTrigger=1) == limited(rows, 3)
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 5


def test_late_requests_count_in_the_carried_window(spark):
    t = 1_000_000_000
    rows = spark.createDataFrame([(1, "a", t - 5_000_000), (2, "a", t + 1), (3, "a", t + 70_000_000)], "request_id long, bucket string, t long")
    carried = spark.createDataFrame([("a", t, 1), ("b", t, 2)], "bucket string, window_start long, taken long")
    done, windows = usage.decide(rows, 2, carried)
    assert sorted((r.request_id, r.allowed) for r in done.collect()) == [(1, True), (2, False), (3, True)]
    assert sorted(map(tuple, windows.collect())) == [("a", t + 70_000_000, 1), ("b", t, 2)]


def test_folds_and_open_deltas_are_all_counts(spark, tmp_path):
    out = str(tmp_path / "stat")
    day = lambda i: (BASE + dt.timedelta(days=i)).date()
    want = {}
    for batch in range(4):
        rows = [(day(i), f"u{i % 2}", "x", "r", batch + i + 1) for i in range(5) for _ in range(2)]
        for d, actor, _, _, n in rows:
            want[d, actor] = want.get((d, actor), 0) + n
        spark.createDataFrame(rows, "day date, actor string, endpoint string, repo string, n long").write.partitionBy("day").parquet(f"{out}/batch_id={batch}")

    def counts():
        return {(r.day, r.actor): r.n for r in usage.fold_counts(usage_streams.stat_rows(spark, out)).collect()}

    assert counts() == want
    assert usage_streams.fold_closed_days(spark, out, str(day(2)), 1) == 1 and counts() == want
    usage_streams.drop_folded(spark, out)
    assert not (tmp_path / "stat" / "batch_id=0" / f"day={day(0)}").exists() and counts() == want
    assert usage_streams.fold_closed_days(spark, out, str(day(4)), 2) == 2 and counts() == want
    usage_streams.drop_folded(spark, out)
    assert counts() == want and not (tmp_path / "stat_folds" / "fold=1").exists()
    with pytest.raises(ValueError):
        usage_streams.fold_closed_days(spark, out, str(day(1)), 3)
    # A fold without its mark is not seen.
    spark.range(1).write.parquet(f"{out}_folds/fold=3")
    assert counts() == want


def test_samples_attribution(spark):
    rows = [
        ("ann", "/overview/core", "", 200), (None, "/routes", "repo=a&repos=b,%20c,,d", 200), ("bob", "/symbols/x", None, 404),
        ("bob", "/health", "", 200), ("bob", "/", "", 200), ("bob", "/admin/api", "", 200),
        ("bob", "/hotspots", "repos=" + ",".join(f"r{i}" for i in range(12)), 200),
    ]
    df = spark.createDataFrame(rows, "actor string, path string, query string, status int").withColumn("at", F.lit(BASE))
    for most, named in ((rules.MAX_REPOS_PER_SAMPLE, 8), (None, 12)):
        got = [(r.actor, r.endpoint, r.repos) for r in usage.to_samples(df, most).collect()]
        assert got == [
            ("ann", "overview", ["core"]), ("internal", "routes", ["a", "b", "c", "d"]),
            ("bob", "hotspots", [f"r{i}" for i in range(named)]),
        ]


def test_anomalies_skip_the_shared_bucket(spark):
    rows = [("internal", f"r{i}", BASE) for i in range(20)] + [("eve", f"r{i}", BASE) for i in range(10)] + [("bob", "r1", BASE)] * 30
    df = spark.createDataFrame(rows, "actor string, repo string, at timestamp")
    got = usage.anomalies(df, F.lit(BASE)).collect()
    assert [(r.actor, r.repo_count, r.requests) for r in got] == [("eve", 10, 10)]


def history(spark, *statuses):
    rows = [
        ("r", i, BASE + dt.timedelta(hours=i), 1000, s, None if s != "failed" else "import", f"c{i}", 11, i, i, "boom" if s == "failed" else None, c)
        for i, (s, c) in enumerate(statuses)
    ]
    return spark.createDataFrame(
        rows,
        "repo string, run_seq long, started_at timestamp, duration_ms long, status string, stage string, commit string,"
        "schema_version int, nodes int, links int, error string, canceled boolean",
    )


def test_fold_runs(spark):
    s = indexing.fold_runs(history(spark, ("success", False), ("failed", False), ("failed", False), ("failed", True))).first()
    assert (s.last_status, s.consecutive_fails, s.last_error, s.last_indexed_commit) == ("failed", 2, "boom", "c0")
    s = indexing.fold_runs(history(spark, ("success", False), ("failed", False), ("skipped", False))).first()
    assert (s.last_status, s.consecutive_fails, s.last_error, s.last_outcome) == ("skipped", 0, "", "failed")


def test_reindex_follows_last_real_outcome(spark):
    state = indexing.fold_runs(history(spark, ("success", False), ("skipped", False)))
    manifest = spark.createDataFrame([("r",), ("new",)], "name string")

    def reasons(head, force=False):
        heads = spark.createDataFrame([("r", head)], "repo string, head string")
        return {r.name: r.reason for r in indexing.needs_reindex(manifest, heads, state, force).collect()}

    assert reasons("c0") == {"r": "unchanged", "new": "never indexed"}
    assert reasons("c9")["r"] == "new commit"
    assert reasons("c0", force=True)["r"] == "forced"


def test_retirement_warns_waits_deletes_cancels_and_guards(spark):
    now = F.lit(BASE)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    warned = spark.createDataFrame(
        [("gone", BASE - dt.timedelta(hours=2)), ("late", BASE - dt.timedelta(minutes=5)), ("back", BASE)],
        "name string, warned_at timestamp",
    )
    graph = names("a", "b", "c", "d", "e", "gone", "late", "first", "back")
    plan = indexing.plan_retirement(graph, names("a", "b", "c", "d", "e", "back"), warned, now)
    assert {r.name: r.action for r in plan.collect()} == {"gone": "delete", "late": "pending", "first": "warn", "back": "cancel"}
    guarded = indexing.plan_retirement(graph, names("a"), warned, now)
    assert {r.action for r in guarded.collect()} == {"guarded"}
    assert indexing.plan_retirement(graph, names("a"), warned, now, targeted=True).count() == 0


def test_pushes_match_remote_and_branch(spark):
    manifest = spark.createDataFrame(
        [("core", "https://git.io/org/core.git", "main"), ("core-dev", "git@git.io:org/core", "dev")], "name string, url string, branch string"
    )
    push = "struct<full_name:string,clone_url:string,ssh_url:string,html_url:string>"
    rows = [
        ("refs/heads/main", False, ("o", None, "git@git.io:Org/Core.git", None)),
        ("refs/heads/dev", False, ("o", "https://git.io/org/core", None, None)),
        ("refs/heads/main", True, ("o", "https://git.io/org/core", None, None)),
        ("refs/heads/main", False, ("o", "https://git.io/org/other", None, None)),
    ]
    df = spark.createDataFrame(rows, f"ref string, deleted boolean, repository {push}").withColumns(
        {"after": F.lit("x"), "at": F.lit(BASE)}
    )
    matched = indexing.match_pushes(df, manifest)
    assert sorted(r.repo for r in matched.collect()) == ["core", "core-dev"]
    assert [r.repo for r in indexing.pending_repositories(matched.unionByName(matched)).collect()] == ["core", "core-dev"]


def test_unknown_name_in_filter_is_an_error(spark):
    manifest = spark.createDataFrame([("a", "u", "main")], "name string, url string, branch string")
    with pytest.raises(LookupError):
        indexing.filter_repositories(manifest, ["a", "zzz"])
