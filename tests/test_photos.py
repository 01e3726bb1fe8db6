import zlib
from struct import pack

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetlake.functions import pixels as px
from facetlake.functions import text as tx
from facetlake.functions.numbers import round_even
from facetlake.operators import dedup, frames, photos
from facetlake.schemas import FRAMES, HASHES
from facetlake.sources import photos as files


def greedy(rows, t):
    """Sequential first-wins over (seq, h, h_flip)."""
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    kept, out = [], {}
    for seq, h, _ in sorted(rows):
        match = next(
            (s for s, hj, fj in kept if bits(h, hj) <= t and not bits(h, fj) < bits(h, hj)), None
        )
        out[seq] = match
        if match is None:
            kept.append((seq, h, next(f for s, _, f in rows if s == seq)))
    return out


def clustered(rng, n, centres=6, flips=5):
    base = rng.integers(-(2**62), 2**62, centres)
    rows = []
    for seq in range(n):
        h = int(base[rng.integers(centres)])
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            h ^= 1 << int(b)
        h = (h + 2**63) % 2**64 - 2**63
        rows.append((seq, h, int(rng.integers(-(2**62), 2**62))))
    return rows


@pytest.mark.parametrize("options", [{}, {"first_prefix": 8}, {"first_prefix": 32, "hot_bucket": 60, "residue": 4}])
def test_first_wins_equals_sequential(spark, options):
    rng = np.random.default_rng(7)
    rows = {shoot: clustered(rng, n) for shoot, n in ((0, 90), (1, 40), (2, 1))}
    df = spark.createDataFrame([(s, *r) for s, rs in rows.items() for r in rs], HASHES)
    got = {(r.shoot_id, r.seq): r.duplicate_of for r in dedup.first_wins(df, **options).collect()}
    want = {(s, seq): d for s, rs in rows.items() for seq, d in greedy(rs, 6).items()}
    assert got == want


@pytest.mark.parametrize("hot", [dedup.HOT_BUCKET, 1])
def test_banded_join_equals_brute_force(spark, hot):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 120, centres=3, flips=7)
    reps = dedup.representatives(spark.createDataFrame([(0, *r) for r in rows], HASHES))
    local = [(r.seq, r.h, r.h_flip) for r in reps.collect()]
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {
        (a[0], b[0]) for a in local for b in local
        if a[0] < b[0] and bits(a[1], b[1]) <= 6 and not bits(b[1], a[2]) < bits(a[1], b[1])
    }
    got = [(r.earlier, r.later) for df in dedup.banded_pairs(reps, reps, 6, hot) for r in df.collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_class_pairs_and_members_tell_every_pair(spark):
    rng = np.random.default_rng(8)
    rows = clustered(rng, 90, centres=3, flips=7)
    rows += [(100 + seq, h, f if seq % 2 else ~f) for seq, h, f in rows[:40]]
    hashes = spark.createDataFrame([(0, *r) for r in rows], HASHES)
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {
        (a[0], b[0]) for a in rows for b in rows
        if a[0] < b[0] and bits(a[1], b[1]) <= 6 and not bits(b[1], a[2]) < bits(a[1], b[1])
    }
    kind = {r.seq: r["class"] for r in dedup.near_duplicate_members(hashes).collect()}
    found = [(r.earlier, r.later) for r in dedup.near_duplicate_pairs(hashes).collect()]
    assert len(found) == len(set(found)) and len(found) < len(want)
    told = set(found)
    assert {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (kind[a[0]], kind[b[0]]) in told} == want
    assert told == {(kind[a], kind[b]) for a, b in want}


def test_pair_join_has_no_cartesian_product(spark):
    reps = spark.createDataFrame([(0, 1, 5, 9), (0, 2, 7, 9)], HASHES)
    plan = next(iter(dedup.banded_pairs(reps, reps)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_chain_keeps_third_link(spark):
    # A~B and B~C but not A~C: B is dropped, so C stays.
    a, b, c = 0, 0b111111, 0b111111111111
    far = (1 << 62) - 1
    df = spark.createDataFrame([(0, 0, a, far), (0, 1, b, far), (0, 2, c, far)], HASHES)
    got = {r.seq: r.duplicate_of for r in dedup.first_wins(df).collect()}
    assert got == {0: None, 1: 0, 2: None}


def test_one_hash_shared_by_all(spark):
    df = spark.range(3000).select(
        F.lit(0).alias("shoot_id"), F.col("id").alias("seq"), F.lit(42).cast("bigint").alias("h"), F.lit(7).cast("bigint").alias("h_flip")
    )
    out = dedup.first_wins(df).groupBy("duplicate_of").count().collect()
    assert {(r.duplicate_of, r["count"]) for r in out} == {(None, 1), (0, 2999)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(1, 40)), min_size=1, max_size=4))
def test_buckets_partition_the_clip(spark, clips):
    for n, target in clips:
        df = spark.range(n).select(
            F.lit(1).cast("bigint").alias("clip_id"), F.col("id").alias("seq"), F.rand(1).alias("score"), F.lit(True).alias("ok")
        )
        rows = frames.with_bucket(frames.candidates(df, target), target).collect()
        m = len(rows)
        for r in rows:
            assert r.bucket * m // target <= r.candidate < (r.bucket + 1) * m // target


def test_sharpest_frame_and_ties(spark):
    rows = [(1, 0, 3.0, True), (1, 1, 9.0, False), (1, 2, 5.0, True), (1, 3, 5.0, True)]
    got = frames.pick(spark.createDataFrame(rows, FRAMES), 1).collect()
    assert [(r.bucket, r.seq, r.score) for r in got] == [(0, 2, 5.0)]


def png(path, grey):
    """A greyscale PNG, written by hand."""
    h, w = grey.shape
    raw = b"".join(b"\0" + grey[y].tobytes() for y in range(h))
    chunk = lambda kind, data: pack(">I", len(data)) + kind + data + pack(">I", zlib.crc32(kind + data))
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def test_image_files_are_listed_decoded_and_scored(spark, tmp_path):
    shoot = tmp_path / "s1"
    shoot.mkdir()
    rng = np.random.default_rng(0)
    png(shoot / "b.png", rng.integers(0, 256, (40, 60), dtype=np.uint8))
    png(shoot / "A.PNG", np.full((40, 60), 128, np.uint8))
    (shoot / "c.jpg").write_bytes(b"not an image")
    (shoot / "notes.txt").write_text("x")
    listed = files.list_photos(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.path.rsplit("/", 1)[1] for r in listed] == ["A.PNG", "b.png", "c.jpg"]
    assert [r.seq for r in listed] == [0, 1, 2]
    images = files.read_images(spark, str(shoot))
    assert images.filter("unreadable").count() == 2  # the jpg and the text file
    scored = {r.path.rsplit("/", 1)[1]: r for r in files.score_images(images).collect()}
    assert scored["A.PNG"].blur == 0.0 and scored["b.png"].blur > 1000
    assert scored["c.jpg"].blur is None
    inventory = files.file_inventory(spark, str(tmp_path)).collect()
    assert {(r.job_id, r.name) for r in inventory} >= {("s1", "s1/b.png")}


def test_empty_folder_is_an_error(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "readme.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        files.list_photos(spark, str(tmp_path))


def test_grid_and_image_scores_agree(spark):
    rng = np.random.default_rng(2)
    grids = [(0, i, [int(x) for x in rng.integers(20, 230, 64)]) for i in range(20)]
    df = spark.createDataFrame(grids, "shoot_id INT, seq BIGINT, grid ARRAY<INT>")
    a = {r.seq: r for r in photos.scores(df).collect()}
    b = {int(r.path.split("/")[1]): r for r in files.score_images(files.grids_to_images(df)).collect()}
    for seq, r in a.items():
        assert r.blur == pytest.approx(b[seq].blur) and r.dark == b[seq].dark and r.bright == b[seq].bright


def test_subject_mask():
    g = np.zeros((20, 20), np.uint8)
    g[5:15, 5:15] = 200
    g[9:11, 9:11] = 0  # a dark hole inside the subject still counts
    mask = files.subject_mask(g)
    assert mask.sum() == 100 and mask[9, 9] and not mask[0, 0]
    assert files.subject_mask(np.zeros((20, 20), np.uint8)).all()


def test_area_resize_and_hash():
    g = np.tile(np.arange(90, dtype=np.uint8) * 2, (80, 1))
    assert (files.area_resize(g, 8, 9)[0] == np.floor(np.arange(9) * 20 + 9 + 0.5)).all()
    assert files.gradient_hash(g) == -1  # every step brightens: all 64 bits set
    assert files.gradient_hash(g[:, ::-1]) == 0


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(0, 10**6).map(lambda n: n / 1000), st.floats(0, 1e6)), min_size=1, max_size=40))
def test_rounding_matches_python(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x DOUBLE")
    rows = df.select("x", tx.fixed2(F.col("x")).alias("t"), round_even(F.col("x"), 3).alias("r")).collect()
    for r in rows:
        assert r.t == f"{r.x:.2f}" and r.r == round(r.x, 3)


def test_lengths_and_names(spark):
    rows = [("4.5m", 4.5), ("45 cm", 0.45), ("18IN", 0.4572), (".5 ft", 0.1524), ("0mm", None), ("-3 m", None), ("5 parsec", None), (None, None)]
    df = spark.createDataFrame(rows, "t STRING, want DOUBLE").select("*", tx.parse_length(F.col("t")).alias("p"))
    for r in df.collect():
        assert (r.p.metres is None) == (r.want is None)
        if r.want is not None:
            assert r.p.metres == pytest.approx(r.want)
        else:
            assert r.p.error
    assert px.MIN_LONG_EDGE == 640


def test_samples_are_cut_before_the_shuffle(spark):
    rows = spark.range(50).select((F.col("id") % 3).cast("int").alias("shoot_id"), F.col("id").alias("seq"), F.lit("a/front.jpg").alias("path"))
    for df in (photos.first_n(rows), photos.conditioning_views(rows)):
        assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
