import duckdb
from edge import frame, with_extra
from facetlake.llm.mixing import mix_photos
from facetlake.llm.queries import QUERIES, SQL
from facetlake.starschema.check import compare, connect


def levels(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by sharing again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in capped]
        room = total - sum(repeats * sizes[s] for s in capped)
        share = {s: room * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not over:
            return share | {s: repeats * sizes[s] for s in capped}
        capped |= over


def check(rows, biggest=None):
    sizes, taken, targets = {}, {}, {}
    for r in rows:
        sizes[r.shoot_id] = sizes.get(r.shoot_id, 0) + r.size
        taken[r.shoot_id] = taken.get(r.shoot_id, 0) + r.taken
        targets[r.shoot_id] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert sum(taken.values()) == sum(sizes.values())
    want = levels(sizes)
    for s, target in targets.items():
        assert abs(target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target) <= 2 * max(r.size for r in rows)
        assert {r.shoot_size for r in rows if r.shoot_id == s} == {sizes[s]}


def test_mix_keeps_to_targets(spark):
    rows = [(i, ["a", "b", "c", None, "dd", "hot"][min(i % 11, 5)], (i * 37) % 90) for i in range(3000)]
    rows += [(5000 + i, "tiny", 1) for i in range(3)] + [(9, "a", 5), (9, "a", 5), (None, None, None), (7000, "zero", 0)]
    photos = frame(spark, rows, "photo_id long, shoot_id string, size long")
    got = mix_photos(with_extra(photos)).collect()
    assert len(got) == len(rows)
    check(got)
    again = mix_photos(photos.repartition(13)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = mix_photos(photos, seed="2").collect()
    assert sorted(map(str, got)) != sorted(map(str, other))
    check(other)


def test_mix_edges(spark):
    photos = frame(spark, [(1, "a", 0), (2, None, 0)], "photo_id long, shoot_id string, size long")
    assert [r.taken for r in mix_photos(photos).collect()] == [0, 0]
    assert mix_photos(photos.limit(0)).count() == 0
    assert [r.taken for r in mix_photos(frame(spark, [(1, "a", 9)], photos.schema)).collect()] == [9]


def test_query_equals_sql(spark, small):
    assert isinstance(connect(small), duckdb.DuckDBPyConnection)
    ok, note, _ = compare(spark, QUERIES["op8_mixing"], "op8_mixing", small, connect(small), SQL["op8_mixing"])
    assert ok, note


def test_no_python_in_the_plan(spark, small):
    plan = QUERIES["op8_mixing"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
