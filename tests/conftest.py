import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from matchlens import session
    s = session.build("local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield session.tune(s)


@pytest.fixture
def small_chunks(spark):
    """Cut traces in chunks much shorter than a clip, so that borders matter everywhere."""
    spark.conf.set("matchlens.chunk.frames", "16")
    yield 16
    spark.conf.unset("matchlens.chunk.frames")


SCHEMA = ("match_id long, frame long, ball_x double, ball_y double, ball_z double, "
          "owned_team long, owned_player long, game_mode long, score_l long, score_r long, "
          "left array<struct<x:double,y:double>>, right array<struct<x:double,y:double>>")


def home(side):
    s = -1 if side == 0 else 1
    return [(s * (0.95 if i == 0 else 0.1 + 0.07 * i), 0.02 * i) for i in range(11)]


def steps(n, match=1, **over):
    """n quiet frames; each override is a function of the frame or {frame: value}."""
    rows = []
    for f in range(n):
        row = {"match_id": match, "frame": f, "ball_x": 0.0, "ball_y": 0.0, "ball_z": 0.1,
               "owned_team": -1, "owned_player": -1, "game_mode": 0, "score_l": 0, "score_r": 0,
               "left": home(0), "right": home(1)}
        for k, v in over.items():
            if callable(v):
                row[k] = v(f)
            elif f in v:
                row[k] = v[f]
        rows.append(tuple(row.values()))
    return rows


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)
