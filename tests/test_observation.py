"""Observations of any number of players; players of a squad stay in generated code."""
import pytest

import __spark_entry__ as entry
from matchlens.functions import observation as O


@pytest.mark.parametrize("n", [0, 3, 11, 12, None])
def test_flip_and_features_of_any_number_of_players(spark, n):
    pts = None if n is None else [(i + 1, -2 * i) for i in range(n)]
    two = [(5, 6), (7, 8)]
    point = "array<struct<x: long, y: long>>"
    df = spark.createDataFrame([(pts, two, two, two, 1, 2, 3, 4, 5, 6, -1, None, 2)],
                               f"left {point}, left_dir {point}, right {point}, right_dir {point}, ball_x long, ball_y long,"
                               " ball_z long, ball_dx long, ball_dy long, ball_dz long, owned_team long, active long, game_mode long")
    got = df.select(O.features(True).alias("f"), O.features(False).alias("p")).first()
    rest = [1.0, 2, 3, 4, 5, 6, 1, 0, 0, *[0] * 11, 0, 0, 1, 0, 0, 0, 0]
    if pts is None:
        assert got.f is None and got.p is None
    else:
        a, b = [float(v) for p in pts for v in p], [float(v) for p in two for v in p]
        assert got.f == [v for x in (a, b, b, b) for v in x + [-1.0] * (22 - len(x))] + rest
        assert got.p == a + 3 * b + [-1.0] * (76 - len(a)) + rest
    turned = O.flip(df.select("left", "right")).first()
    assert turned.left == [(-x, -y) for x, y in two]
    assert turned.right == (None if pts is None else [(-x, -y) for x, y in pts])


@pytest.mark.parametrize("name", ["feature_vectors", "flipped_observations"])
def test_sums_over_players_are_not_interpreted(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
