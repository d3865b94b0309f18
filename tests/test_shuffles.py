"""Sides of joins that grow with the points stay off the driver, whatever Spark estimates from compressed files."""

import io
from contextlib import redirect_stdout

from stridemap.operators import components, geo
from stridemap.plans import place_queries


def plan(df):
    with redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


def points_file(spark, tmp_path, n):
    spark.range(n).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    return place_queries._points(spark, str(tmp_path))


def test_the_exploded_side_of_near_pairs_is_shuffled(spark, tmp_path):
    said = plan(geo.near_pairs(points_file(spark, tmp_path, 400), 30.0, ["grp"]))
    assert "BroadcastExchange" not in said and "SortMergeJoin" in said


def test_cluster_labels_and_stars_are_shuffled(spark, tmp_path):
    points = points_file(spark, tmp_path, 400)
    rows = geo.clusters(points, geo.C.JUNCTION_CLUSTER_M, ["grp"])
    said = plan(rows)
    assert "BroadcastExchange" not in said and "SortMergeJoin" in said
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long")
    edges.write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    for star in (components._large_star, components._small_star):
        assert "BroadcastExchange" not in plan(star(edges))
