from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetlake.operators import fleet, ordering, specs
from facetlake.schemas import STAGES
from facetlake.session import materialize, shared_dir
from facetlake.sources import meshtext, records, tables
from facetlake.streaming import admission, presence, run, tail


def fill_by_rounds(total, faces):
    """Proportional split with a floor of 32, clamping in rounds."""
    out, left, free = {}, total, set(faces)
    while free:
        s = sum(faces[k] for k in free)
        low = {k for k in free if (left * (faces[k] / s) if s else left / len(free)) < 32}
        if not low:
            out.update({k: round(left * (faces[k] / s) if s else left / len(free)) for k in free})
            break
        out.update({k: 32 for k in low})
        free -= low
        left -= 32 * len(low)
    big = max(sorted(faces), key=lambda k: faces[k])
    out[big] += total - sum(out.values())
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=9), st.integers(0, 4000))
def test_budgets_match_rounds(spark, faces, extra):
    total = 32 * len(faces) + extra
    rows = [("m", i, f, total) for i, f in enumerate(faces)] + [("poor", 0, 5, 10)]
    df = spark.createDataFrame(rows, "mesh_id STRING, part_index INT, n_faces BIGINT, total_budget BIGINT")
    out = specs.water_fill(df).collect()
    got = {r.part_index: r.target_faces for r in out if r.mesh_id == "m"}
    assert got == fill_by_rounds(total, dict(enumerate(faces)))
    assert sum(got.values()) == total
    assert [r.target_faces for r in out if r.mesh_id == "poor"] == [None]


def test_positions_and_running_sums(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), ((F.col("id") * 7919) % 5000).alias("o"))
    rows = ordering.positions(df.repartition(7), ["k"], ["o"]).collect()
    want = {}
    for k in (0, 1):
        for i, o in enumerate(sorted(r.o for r in rows if r.k == k)):
            want[(k, o)] = i
    assert {(r.k, r.o): r.pos for r in rows} == want
    total = ordering.running_sum(df, ["k"], ["o"], F.col("o")).collect()
    for k in (0, 1):
        mine = sorted((r.o, r.running) for r in total if r.k == k)
        assert [x[1] for x in mine] == list(np.cumsum([x[0] for x in mine]))


def test_materialize_uses_the_shared_folder(spark):
    before = shared_dir(spark)
    df = materialize(spark.range(10), "t")
    assert before == shared_dir(spark) and all(before in f for f in df.inputFiles())


def replayed(names):
    """One name after the other, each with the smallest number that is free."""
    seen, out = set(), []
    for b in names:
        stem, n = b, 2
        while stem in seen:
            stem, n = f"{b}-{n}", n + 1
        seen.add(stem)
        out.append(stem)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_equal_the_replay(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["part", "part-2", "part-3", "part-4", "part-7", "part-2-2", "part-2-3", "part-2-2-2", "part-02", "part-1", "x", "x-2", "-2", "part-2-", "x-9999999999999999999"]
    rows, want = [], {}
    for job in range(12):
        names = [str(x) for x in rng.choice(pool[: int(rng.integers(2, len(pool) + 1))], int(rng.integers(1, 60)))]
        rows += [(job, seq, b) for seq, b in enumerate(names)]
        want |= {(job, seq): stem for seq, stem in enumerate(replayed(names))}
    df = spark.createDataFrame(rows, "job BIGINT, seq BIGINT, base STRING").repartition(4)
    assert {(r.job, r.seq): r.stem for r in fleet.unique_names(df, ["job"], "base", ["seq"]).collect()} == want


def test_unique_names_of_one_large_family(spark):
    """Names of one key that are all numbered forms of one name, which occurs as well."""
    names = ["part" if i % 3 == 0 else f"part-{1 + i * 7919 % 20011}" for i in range(20000)]
    df = spark.createDataFrame(list(enumerate(names)), "seq BIGINT, base STRING").withColumn("job", F.lit(1))
    got = {r.seq: r.stem for r in fleet.unique_names(df, ["job"], "base", ["seq"]).collect()}
    assert [got[i] for i in range(20000)] == fast_replay(names)


def fast_replay(names):
    seen, following, out = set(), {}, []
    for b in names:
        stem, n = b, following.get(b, 2)
        while stem in seen:
            stem, n = f"{b}-{n}", n + 1
        following[b] = n
        seen.add(stem)
        out.append(stem)
    return out


def test_a_write_that_fails_leaves_the_keyed_table(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.write_table(spark.range(20).selectExpr("id AS v", "id % 4 AS k"), path, ["k"])
    schema = "v BIGINT, k BIGINT"

    def content():
        return sorted(map(tuple, tables.read_table(spark, path, schema).collect()))

    before = content()
    bad = spark.range(40).selectExpr("id + 100 AS v", "id % 2 AS k").filter("CASE WHEN v = 139 THEN raise_error('broken') IS NULL ELSE true END")
    with pytest.raises(Exception, match="broken"):
        tables.replace_keys(bad, path, ["k"])
    assert content() == before
    tables.replace_keys(spark.range(3).selectExpr("id + 100 AS v", "id % 2 AS k"), path, ["k"])
    assert content() == sorted([(100, 0), (101, 1), (102, 0), *[r for r in before if r[1] > 1]])
    plan = tables.read_table(spark, path, schema).filter("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan


def test_unique_names_first_fit(spark):
    names = ["a", "a", "a-2", "a", "b", "b", "c-1", "a-2", "c"]
    df = spark.createDataFrame([("j", i, n) for i, n in enumerate(names)], "job STRING, seq INT, base STRING")
    got = [r.stem for r in fleet.unique_names(df, ["job"], "base", ["seq"]).orderBy("seq").collect()]
    seen, want = set(), []
    for n in names:
        stem, k = n, 2
        while stem in seen:
            stem, k = f"{n}-{k}", k + 1
        seen.add(stem)
        want.append(stem)
    assert got == want and max(Counter(got).values()) == 1


def test_stage_keys_ignore_order_and_have_one_format(spark):
    import hashlib
    import json

    prints = ["b2", "a1", "c3", "a1"]
    pieces = [hashlib.md5(p.encode()).hexdigest() for p in prints]
    sums = [sum(int(m[at : at + 15], 16) for m in pieces) for at in (0, 16)]
    digest = hashlib.sha256(f"{len(prints)}:{sums[0]}:{sums[1]}".encode()).hexdigest()[:16]
    payload = json.dumps({"stage": "s", "params": {"n": 1}, "inputs": digest}, sort_keys=True)
    want = "s-" + hashlib.sha256(payload.encode()).hexdigest()[:12]
    for order in (prints, prints[::-1]):
        df = spark.createDataFrame([(1, p) for p in order], "job_id BIGINT, fingerprint STRING")
        assert fleet.stage_keys(df, "s", '{"n": 1}').first().key == want
    many = spark.range(20_000).select(F.lit(2).cast("bigint").alias("job_id"), F.col("id").cast("string").alias("fingerprint"))
    keys = {fleet.stage_keys(many.repartition(n), "s", "{}").first().key for n in (1, 5)}
    assert len(keys) == 1


def test_log_cursor_rules(spark):
    log = spark.createDataFrame([(j, i, f"line {i}") for j in (1, 2, 3) for i in range(5)], "job_id BIGINT, line_no BIGINT, line STRING")
    cursors = spark.createDataFrame([(1, 3), (2, -1), (3, 5)], "job_id BIGINT, log_since BIGINT")
    got = fleet.log_since(log, cursors).collect()
    assert Counter(r.job_id for r in got) == {1: 2, 2: 5}
    assert all(r.log_total == 5 for r in got)
    past = spark.createDataFrame([(1, 6)], "job_id BIGINT, log_since BIGINT")
    assert fleet.log_since(log, past).count() == 5


def test_stage_track_shows_reported_stages_as_they_are(spark):
    stages = spark.createDataFrame([(1, 0, "odd-stage", "failed", "", 1.0)], STAGES)
    jobs = spark.createDataFrame([(1, "failed"), (2, "failed"), (3, "running")], "job_id BIGINT, status STRING")
    rows = fleet.stage_track(jobs, stages).collect()
    assert [(r.name, r.state) for r in rows if r.job_id == 1] == [("odd-stage", "failed")]
    assert {r.state for r in rows if r.job_id == 2} == {"skipped"} and {r.state for r in rows if r.job_id == 3} == {"pending"}


def test_admission_equals_sequential(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for job in range(200):
        start = int(rng.integers(0, 5000))
        rows.append((job, int(job % 3), start, start + int(rng.integers(1, 200))))
    rows.append((900, 7, 10, 20))
    df = spark.createDataFrame(rows, "job_id BIGINT, host BIGINT, a BIGINT, b BIGINT").select(
        "job_id", "host", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts")
    )
    want, until = {}, {}
    for job, host, a, b in sorted(rows, key=lambda r: (r[2], r[0])):
        want[job] = a >= until.get(host, -1)
        if want[job]:
            until[host] = b
    assert {r.job_id: r.accepted for r in fleet.admitted(df).collect()} == want
    busy = {r.job_id: r.active for r in fleet.busy_hosts(df).collect()}
    for job, host, a, _ in rows:
        assert busy[job] == sum(h == host and (s, j) < (a, job) and e > a for j, h, s, e in rows)
    src = run.stage_arrivals(df, "start_ts", {"host": -1}, 5000, batches=5, quiet=86400)
    done = run.drain_counted(admission.admission_stream(run.read_stream(spark, src, files_per_batch=1)))
    assert {r.job_id: r.accepted for r in done.table.collect()} == want
    assert done.rows == len(rows) + 1 and done.late == 0


def presence_rows(df):
    return sorted((r.project, r.poll_ts, r.running, r.preempted or "", r.presence) for r in df.collect())


def test_presence_stream_equals_batch_over_several_batches(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(p, h, f"vm{m}") for p in range(3) for h in range(40) for m in range(3) if rng.random() < 0.45]
    base = 500_000 * 3600  # not the epoch, where a stream's watermark begins
    polls = spark.createDataFrame(rows, "project BIGINT, h BIGINT, name STRING").select(
        "project", F.timestamp_seconds(F.col("h") * 3600 + base).alias("poll_ts"), "name"
    )
    asks = [(int(p), int(s)) for p in range(3) for s in rng.integers(0, 40 * 3600, 6)]
    teardowns = spark.createDataFrame(asks, "project BIGINT, s BIGINT").select("project", F.timestamp_seconds(F.col("s") + base).alias("request_ts"))
    times = presence.poll_times(polls)
    batch = presence_rows(presence.presence(polls, times, teardowns))
    events = presence.events(polls, times, teardowns)
    src = run.stage_arrivals(events, "ts", {"kind": "tick"}, 7 * 3600, batches=6, quiet=8 * 3600)
    done = run.drain_counted(presence.presence_stream(run.read_stream(spark, src, files_per_batch=1), "8 hours"))
    first = {p: min(t for q, t, *_ in batch if q == p) for p in range(3)}
    assert [r for r in presence_rows(done.table) if r[1] >= first[r[0]]] == batch and done.late == 0
    # The same files in two runs that share a checkpoint: what waits in state is not lost in between.
    out, ck, grow = (str(tmp_path / n) for n in ("out", "ck", "grow"))
    half = F.timestamp_seconds(F.lit(20 * 3600 + base))
    early = (F.col("ts") <= half) | (F.col("kind") == "teardown")
    events.filter(early).coalesce(1).write.parquet(grow)
    some = run.drain(presence.presence_stream(run.read_stream(spark, grow), "48 hours"), out, ck)
    assert some.count() == 0
    events.filter(~early).coalesce(1).write.mode("append").parquet(grow)
    tick = spark.range(1).select(F.lit(None).cast("bigint").alias("project"), F.timestamp_seconds(F.lit(base + 100 * 3600)).alias("ts"), F.lit("tick").alias("kind"), F.array().cast("array<string>").alias("running"))
    run.drain(presence.presence_stream(run.read_stream(spark, grow), "48 hours"), out, ck)
    tick.coalesce(1).write.mode("append").parquet(grow)
    got = presence_rows(run.drain(presence.presence_stream(run.read_stream(spark, grow), "48 hours"), out, ck))
    assert [r for r in got if r[1] >= first[r[0]]] == batch


def test_a_teardown_that_comes_after_the_poll_still_counts(spark, tmp_path):
    base = 10**9 - 10**9 % 3600
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def write(rows):
        df = spark.createDataFrame(rows, "project BIGINT, s BIGINT, kind STRING, running ARRAY<STRING>")
        df = df.select("project", F.timestamp_seconds(F.col("s") + base).alias("ts"), "kind", "running")
        df.coalesce(1).write.mode("append").parquet(src)
        return run.drain_counted(presence.presence_stream(run.read_stream(spark, src)), out, ck)

    write([(1, 0, "poll", ["vm"]), (2, 0, "poll", ["vm"])])
    write([(1, 3600, "poll", []), (2, 3600, "poll", [])])
    write([(1, 1800, "teardown", [])])
    done = write([(None, 7 * 3600, "tick", [])])
    assert [r[2:] for r in presence_rows(done.table)] == [(1, "", "ready"), (0, "", "absent"), (1, "", "ready"), (0, "vm", "preempted")]
    late = write([(2, 60, "poll", ["vm"]), (1, 8 * 3600, "poll", ["x"])])
    assert late.late == 1


def test_silence_is_reported_once_and_in_order(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def write(rows):
        df = spark.createDataFrame(rows, "job_id BIGINT, s BIGINT, terminal BOOLEAN").select("job_id", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "terminal")
        df.coalesce(1).write.mode("append").parquet(src)
        found = run.drain(admission.silent_stream(run.read_stream(spark, src), 3600, "2 hours"), out, ck)
        return sorted((r.job_id, r.status, int(r.last_ts.timestamp()) - 10**9) for r in found.collect())

    assert write([(1, 0, False), (2, 0, False), (3, 0, False), (4, 0, True)]) == []
    # Beats that come out of order bridge the silence of job 2; job 1 stays silent for too long.
    assert write([(2, 7000, False), (1, 7000, False), (3, 3000, None), (9, 9000, False)]) == [(4, "finished", 0)]
    assert write([(2, 3500, False), (9, 16000, False)]) == [(1, "failed", 0), (3, "failed", 3000), (4, "finished", 0)]
    # What a job says after its verdict changes nothing.
    assert write([(1, 20000, True), (3, 21000, False), (-1, 90000, None)]) == [
        (1, "failed", 0), (2, "failed", 7000), (3, "failed", 3000), (4, "finished", 0), (9, "failed", 9000),
    ]
    assert write([(1, 200000, False), (-2, 300000, None)])[1:] == [(1, "failed", 0), (2, "failed", 7000), (3, "failed", 3000), (4, "finished", 0), (9, "failed", 9000)]


def test_tail_delivers_each_line_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("log", "out", "ck"))
    line = spark.range(6).select(F.lit(1).alias("job_id"), F.col("id").alias("line_no"), F.lit("[OK] x").alias("line"), F.lit(None).cast("timestamp").alias("ts"))
    line.filter("line_no < 4").write.parquet(src)
    assert tail.run_tail(run.read_stream(spark, src), out, ck).count() == 4
    line.filter("line_no >= 4").write.mode("append").parquet(src)
    rows = tail.run_tail(run.read_stream(spark, src), out, ck).collect()
    assert sorted(r.line_no for r in rows) == list(range(6)) and {r.severity for r in rows} == {"ok"}


def test_waits_and_silence(spark, tmp_path):
    ev = [(1, 0, "queued"), (1, 100, "ready"), (2, 0, "queued"), (2, 50, "failed"), (3, 0, "queued"), (3, 4000, "ready"), (4, 0, "queued"), (9, 90000, "ready"), (9, 89000, "queued")]
    df = spark.createDataFrame(ev, "job_id BIGINT, s BIGINT, kind STRING").select("job_id", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "kind")
    want = {1: "released", 2: "failed", 3: "timed out", 4: "timed out", 9: "released"}
    assert {r.job_id: r.outcome for r in admission.wait_outcomes(df).collect()} == want
    src = str(tmp_path / "w")
    df.coalesce(1).write.parquet(src)
    out = run.drain(admission.wait_stream(run.read_stream(spark, src)))
    assert {r.job_id: r.outcome for r in out.collect()} == want
    beats = spark.createDataFrame([(1, 0, False), (1, 100, True), (2, 0, False), (3, 90000, False)], "job_id BIGINT, s BIGINT, terminal BOOLEAN").select(
        "job_id", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "terminal"
    )
    batch = admission.silent_jobs(beats, 3600, F.timestamp_seconds(F.lit(90000 + 10**9)))
    assert {r.job_id: r.status for r in batch.collect()} == {1: "finished", 2: "failed", 3: "running"}
    src = str(tmp_path / "b")
    beats.coalesce(1).write.parquet(src)
    out = run.drain(admission.silent_stream(run.read_stream(spark, src), 3600))
    assert {r.job_id: r.status for r in out.collect()} == {1: "finished", 2: "failed"}


def test_an_answer_may_come_before_its_request(spark, tmp_path):
    def write(rows):
        df = spark.createDataFrame(rows, "job_id BIGINT, s BIGINT, kind STRING").select("job_id", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "kind")
        df.coalesce(1).write.mode("append").parquet(src)
        return run.drain(admission.wait_stream(run.read_stream(spark, src)), out, ck)

    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    write([(1, 100, "ready"), (2, 90, "failed"), (3, 100, "ready")])
    got = write([(1, 50, "queued"), (2, 80, "queued"), (3, 120, "queued"), (4, 100, "queued")])
    assert {r.job_id: r.outcome for r in got.collect()} == {1: "released", 2: "failed"}
    got = write([(9, 50_000, "queued")])
    assert {r.job_id: r.outcome for r in got.collect()} == {1: "released", 2: "failed", 3: "timed out", 4: "timed out"}


def test_many_jobs_that_wait_share_a_row_of_state(spark, tmp_path):
    """Batch outcomes, without a call for every job; ids beyond 2^53 and a missing id stay what they are."""
    big = 2**60 + 1
    k = F.col("id")
    ids = F.when(k % 3 == 0, k + big).when(k == 1, F.lit(None)).otherwise(k)
    queued = spark.range(3000).select(ids.alias("job_id"), F.timestamp_seconds(k * 3 + 10**9).alias("ts"), F.lit("queued").alias("kind"))
    kind = F.when(k % 4 == 0, "failed").otherwise("ready")
    answers = spark.range(3000).filter("id % 5 <> 0").select(ids.alias("job_id"), F.timestamp_seconds(k * 3 + k * 37 % 7000 + 10**9).alias("ts"), kind.alias("kind"))
    events = queued.unionByName(answers)
    want = {(r.job_id, r.outcome, r.ts) for r in admission.wait_outcomes(events.filter("job_id IS NOT NULL")).collect()}
    src = run.stage_arrivals(events, "ts", {"job_id": -1, "kind": "tick"}, 600, quiet=7200)
    ck = str(tmp_path / "ck")
    got = [(r.job_id, r.outcome, r.ts) for r in run.drain(admission.wait_stream(run.read_stream(spark, src, files_per_batch=1)), None, ck).collect()]
    assert {r for r in got if r[0] is not None} == want and len(got) == len(want) + 1
    state = spark.read.format("statestore").load(ck)
    assert len(state.select("key.bucket").distinct().collect()) <= admission.BUCKETS


def test_many_silent_jobs_share_a_row_of_state(spark, tmp_path):
    """Verdicts of single walks, without a call for every job; ids beyond 2^53 and a missing id stay what they are."""
    rng = np.random.default_rng(12)
    ids = [None, 2**60 + 1, *range(1500)]
    rows = [(job, int(s), bool(rng.random() < 0.1)) for job in ids for s in rng.integers(0, 40_000, rng.integers(1, 6))]
    want = set()
    for job in ids:
        last, status = None, None
        for s, terminal in sorted((s, t) for j, s, t in rows if j == job):
            if last is not None and s > last + 7200:
                break
            last, status = s, "finished" if terminal else "failed"
            if terminal:
                break
        want.add((job, "failed" if status is None else status, last))
    beats = spark.createDataFrame(rows, "job_id BIGINT, s BIGINT, terminal BOOLEAN").select("job_id", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "terminal")
    src = run.stage_arrivals(beats, "ts", {"job_id": -1}, 600, quiet=86400, files=3)
    ck = str(tmp_path / "ck")
    done = run.drain_counted(admission.silent_stream(run.read_stream(spark, src, files_per_batch=3), 7200), None, ck)
    got = [(r.job_id, r.status, int(r.last_ts.timestamp()) - 10**9) for r in done.table.collect()]
    assert set(got) == want and len(got) == len(want) and done.late == 0
    state = spark.read.format("statestore").load(ck)
    assert len(state.select("key.bucket").distinct().collect()) <= admission.BUCKETS


def test_batches_of_arrivals_have_as_many_files_as_asked_for(spark):
    rows = spark.range(10).select(F.col("id").alias("job_id"), F.timestamp_seconds(F.col("id") * 1000 + 10**9).alias("ts"))
    src = run.stage_arrivals(rows, "ts", {"job_id": -1}, 10, batches=3, files=4)
    found = spark.read.parquet(src)
    assert len(found.inputFiles()) == 3 * 4 + 1 and found.count() == 11


def test_late_submissions_are_dropped(spark, tmp_path):
    def write(rows):
        df = spark.createDataFrame(rows, "job_id BIGINT, host BIGINT, a BIGINT, b BIGINT")
        df = df.select("job_id", "host", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"))
        df.coalesce(1).write.mode("append").parquet(src)
        return {r.job_id: r.accepted for r in run.drain(admission.admission_stream(run.read_stream(spark, src)), out, ck).collect()}

    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    day = 86400
    assert write([(1, 1, 10, 50), (2, 1, 30 * day, 31 * day)]) == {1: True}
    # Job 3 is behind the watermark; jobs 4 and 5 wait until it has passed them.
    assert write([(3, 2, 10 * day, 11 * day), (4, 1, 30 * day + 5, 32 * day), (5, 1, 31 * day, 32 * day)]) == {1: True}
    assert write([(None, -1, 40 * day, 40 * day)]) == {1: True, 2: True, 4: False, 5: True}


def test_obj_round_trip_and_polygons(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "cube.obj").write_text(
        "# c\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 0\nf 1/1 2/1 3/1 4/1\nv 0 0 5\nf -1 -2 -3\nusemtl x\nf 1//1 2//1 5//1\n"
    )
    vertices, faces = meshtext.parse_obj(meshtext.read_lines(spark, str(folder)))
    got = [(r.v0, r.v1, r.v2) for r in faces.orderBy("fid").collect()]
    assert got == [(0, 1, 2), (0, 2, 3), (4, 3, 2), (0, 1, 4)] and vertices.count() == 5
    out = str(tmp_path / "out")
    meshtext.write_obj(vertices, faces, out)
    again_v, again_f = meshtext.parse_obj(
        meshtext.read_lines(spark, out).withColumn("mesh_id", F.lit("cube"))
    )
    assert [(r.v0, r.v1, r.v2) for r in again_f.orderBy("fid").collect()] == got
    assert [(r.x, r.y, r.z) for r in again_v.orderBy("vid").collect()] == [(r.x, r.y, r.z) for r in vertices.orderBy("vid").collect()]


def test_ascii_stl_and_ply(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    facet = "facet normal 0 0 1\n outer loop\n  vertex 0 0 0\n  vertex 1 0 0\n  vertex 0 {y} 0\n endloop\nendfacet\n"
    (folder / "a.stl").write_text("solid a\n" + facet.format(y=1) + facet.format(y=2) + "endsolid a\n")
    t = meshtext.parse_stl(meshtext.read_lines(spark, str(folder))).orderBy("fid").collect()
    assert [(r.fid, r.bx, r.cy) for r in t] == [(0, 1.0, 1.0), (1, 1.0, 2.0)]
    ply = tmp_path / "p"
    ply.mkdir()
    (ply / "b.ply").write_text(
        "ply\nformat ascii 1.0\ncomment x\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\n"
        "element face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n"
    )
    v, f = meshtext.parse_ply(meshtext.read_lines(spark, str(ply)))
    assert v.count() == 4 and [(r.v0, r.v1, r.v2) for r in f.orderBy("fid").collect()] == [(0, 1, 2), (0, 2, 3)]


def test_sessions_skip_junk(spark, tmp_path):
    for name, text in (("20240101-a", '{"name": "car", "faces": 12}'), ("20240102-b", "{ broken"), ("20240103-c", '{"job_id": "j9", "label": "lamp"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text(text)
    got = {r.job_id: r for r in records.read_sessions(spark, str(tmp_path)).collect()}
    assert set(got) == {"20240101-a", "j9"} and got["j9"].name == "lamp" and got["20240101-a"].faces == 12


def test_instance_listing_gaps(spark):
    rows = [('{"name": "a", "scheduling": {"preemptible": true}, "creationTimestamp": "2024-01-01T00:00:00.5-08:00"}',), ("{}",), ("not json",)]
    got = records.flatten_instances(spark.createDataFrame(rows, "text STRING")).orderBy(F.desc("name")).collect()
    assert got[0].spot and got[0].accelerator is None and str(got[0].created) == "2024-01-01 08:00:00.500000"
    assert got[1].name == "" and got[1].image is None


@pytest.mark.parametrize("text,ok", [('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ("```\n{}\n```", True), ("hello", False), (None, False)])
def test_model_replies(spark, text, ok):
    r = spark.createDataFrame([(text,)], "t STRING").select(records.parse_reply(F.col("t"), "a INT").alias("r")).first().r
    assert (r.error is None) == ok


def test_keyed_table_round_trip(spark, tmp_path):
    from facetlake.sources.tables import read_table, write_table

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0)], "mesh_id STRING, fid BIGINT, area DOUBLE")
    write_table(rows, path, ["mesh_id"])
    write_table(rows.filter("mesh_id = 'b'").withColumn("fid", F.col("fid") + 10), path, ["mesh_id"])
    back = read_table(spark, path, "mesh_id STRING, fid BIGINT, area DOUBLE")
    assert sorted((r.mesh_id, r.fid) for r in back.collect()) == [("a", 1), ("b", 2), ("b", 12)]
    plan = back.filter("mesh_id = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_shared_folder_is_needed_beyond_a_local_master(spark, monkeypatch):
    from facetlake import session

    assert session.is_local("local") and session.is_local("local[8]") and not session.is_local("local-cluster[2,1,1024]")
    monkeypatch.setattr(session, "is_local", lambda master: False)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_path(spark, "x")
