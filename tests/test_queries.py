"""Registered queries against their SQL counterparts, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from facetlake.operators import parts
from facetlake.session import tune
from facetlake.starschema.catalog import QUERIES
from facetlake.starschema.check import compare, connect
from facetlake.starschema.view_queries import start_labels
from facetlake.starschema.views import Views

SLOW = {"mesh_tail_report", "voxel_fill", "normal_map_gutter", "resource_wait_stream"}
NAMES = sorted(set(entry.oracle_sql()) & set(QUERIES) - SLOW)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES[::2])
def test_query_equals_sql(spark, small, con, name):
    ok, note, _ = compare(spark, entry.queries()[name], name, small, con, entry.oracle_sql()[name])
    assert ok, note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "shoot_id" and df.count() == 10


def test_names_are_plain():
    assert all(n.isidentifier() and not n.startswith("op") and "pipeline" not in n for n in QUERIES)

# Plans over the views of a whole table: what a part is expanded to must not be broadcast by the size of its file.
WIDE = (
    "mesh_face_gather", "mesh_feature_edges", "mesh_indexed_faces", "mesh_silhouette_edges", "mesh_drawing_lines", "label_views",
    "edge_votes", "significant_regions",
)


@pytest.mark.parametrize("name", WIDE)
def test_expanded_rows_are_not_broadcast_by_file_size(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("name", ["photo_intake_stream", "photo_intake_running_counts"])
def test_streams_read_a_table_of_many_files(spark, small, tmp_path, name):
    spark.read.parquet(f"{small}/embeddings.parquet").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    told = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert told == sorted(map(tuple, QUERIES[name](spark, small).collect()))


@pytest.mark.parametrize("name", ["neighbour_means", "taubin_one_step", "parts_from_labels"])
def test_stored_tables_of_expanded_rows_are_not_broadcast(spark, name):
    if name == "parts_from_labels":
        views = Views(tune(spark, expanding=True), "/root/testdata/sf0.1")
        df = parts.label_areas(views.triangles, start_labels(views))
    else:
        df = QUERIES[name](spark, "/root/testdata/sf0.1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
