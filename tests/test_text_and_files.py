"""Parsers, graders, observation flips and file formats."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.functions import grid, observation, text as T
from matchlens.operators import grade as A, measure as M
from matchlens.sources import readers


@pytest.mark.parametrize("raw, strict, tolerant", [
    ("Ball position: D5", "D5", "D5"),
    ("Reasoning: it left.\nball position: c, 12\nsure", "C12", "C12"),
    ("Ball position: row D column 5", None, "D5"),
    ("Ball position: 4, 5", None, "D5"),
    ("maybe G3 or B2", "B2", "A3"),
    ("Ball position: A17", None, None),
    ("ERROR: timeout", None, None),
    ("", None, None),
])
def test_cells(spark, raw, strict, tolerant):
    df = spark.createDataFrame([(raw,)], "raw string")
    r = df.select(T.parse_cell(F.col("raw"), 16, 6)["cell"].alias("s"),
                  T.parse_cell_tolerant(F.col("raw"), 16, 6)["cell"].alias("t")).first()
    assert (r.s, r.t) == (strict, tolerant)


def test_grades_keep_the_known_quirks(spark):
    truth = ("n_left long, n_right long, n_total long, left_scored boolean, right_scored boolean,"
             " end_bin string, region_count long, best_intervention string,"
             " responsibility_rank string").replace(" long", ": long").replace(
        " boolean", ": boolean").replace(" string", ": string")
    t = (3, 4, 7, False, False, "bin", 5, "a_add_attacker", "r")
    rows = [("description", "How many on the left?", "", "I see 3 players", t, True),
            ("description", "How many?", "", "no idea", t, False),
            ("prediction", "Will they score?", "", "No goal here", t, False),
            ("prediction", "Where?", "", "yes", t, None),
            ("inference", "q", "region_occluded", "about 5", t, True),
            ("hypothetical", "q", "", "A good choice is B", t, True),
            ("hypothetical", "q", "", "none of these", t, None),
            ("counterfactual", "q", "", "player 3", t, None)]
    df = spark.createDataFrame(rows, "category string, question string, subtask string, "
                                     f"answer string, truth struct<{truth}>, want boolean")
    got = A.grade_categories(df).select("grade.correct", "want").collect()
    assert [r.correct for r in got] == [r.want for r in got]


def test_truncation_and_floor_differ_left_of_zero(spark):
    df = spark.createDataFrame([(-5.0, -1.2)], "px double, x double")
    r = df.select(grid.cell_of(F.col("px"), F.lit(0.0)).alias("c"),
                  grid.pitch_bin(F.col("x"), F.lit(0.5))[0].alias("b")).first()
    assert (r.c, r.b) == ("A1", 0)


def test_flip_twice_changes_nothing(spark):
    rng = np.random.default_rng(0)

    def pts():
        return [(float(a), float(b)) for a, b in rng.normal(size=(11, 2))]
    p = "array<struct<x:double,y:double>>"
    row = (0.3, -0.1, 0.2, 0.01, 0.02, 0.03, 1, 2, 1, pts(), pts(), pts(), pts(),
           [int(v) for v in rng.integers(0, 2, 10)])
    df = spark.createDataFrame([row], "ball_x double, ball_y double, ball_z double, ball_dx double,"
                               " ball_dy double, ball_dz double, owned_team int, score_l int, "
                               f"score_r int, left {p}, right {p}, left_dir {p}, right_dir {p}, "
                               "sticky array<int>")
    once = observation.flip(df)
    assert once.first().owned_team == 0 and once.first().ball_x == -0.3
    assert observation.flip(once).first() == df.first()


def test_match_archives(spark, tmp_path):
    n = 7
    np.savez(tmp_path / "mid_bal_s301.npz", ball=np.arange(n * 3, dtype="float32").reshape(n, 3),
             owned_team=np.full(n, -1), owned_player=np.full(n, -1), game_mode=np.zeros(n, int),
             left=np.zeros((n, 11, 2), "float32"), right=np.ones((n, 11, 2), "float32"),
             score=np.zeros((n, 2), int))
    got = readers.match_arrays(spark, str(tmp_path)).orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(n))
    assert (got[2].match, got[2].shape, got[2].seed, got[2].ball_z) == ("mid_bal_s301", "mid_bal",
                                                                       301, 8.0)
    assert len(got[0].right) == 11 and got[0].right[3].x == 1.0


def test_ball_centroid_of_an_empty_pair_is_null(spark):
    rows = [(c, y, x, *((250, 250, 250) if c and (x, y) == (2, 1) else (30, 70, 25)), 30, 70, 25)
            for c in (0, 1) for y in range(3) for x in range(4)]
    px = spark.createDataFrame(rows, "clip long, y long, x long, vis_r long, vis_g long, "
                                     "vis_b long, inv_r long, inv_g long, inv_b long")
    got = {r.clip: (r.px, r.py) for r in M.ball_centroid(px, ["clip"]).collect()}
    assert got == {0: (None, None), 1: (2.0, 1.0)}


def test_published_layouts(spark, tmp_path):
    step = '{"ball":[0.1,0.2,0.3],"ball_owned_team":-1,"ball_owned_player":-1,"game_mode":0,"left_team":[[0.0,0.1]],"right_team":[[0.5,0.6]],"score":[1,0]}'
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "name_s11.json").write_text(f"[{step},\n{step}]")
    rows = readers.match_step_lists(spark, str(tmp_path / "log")).orderBy("frame").collect()
    assert [(r.match, r.frame, r.ball_z, r.score_l, r.right[0].y) for r in rows] == [("name_s11", 0, 0.3, 1, 0.6), ("name_s11", 1, 0.3, 1, 0.6)]
    (tmp_path / "pix").mkdir()
    (tmp_path / "pix" / "name_s12.json").write_text('{"7": [10.5, 20.25], "300": [1.0, 2.5]}')
    assert sorted(tuple(r) for r in readers.match_pixels(spark, str(tmp_path / "pix")).collect()) == [("name_s12", 7, 10.5, 20.25), ("name_s12", 300, 1.0, 2.5)]
    (tmp_path / "absent.json").write_text('{\n "name_s11": [[5, 9], [20, 20]],\n "name_s13": []}')
    assert sorted(tuple(r) for r in readers.match_spans(spark, str(tmp_path / "absent.json")).collect()) == [("name_s11", 5, 9), ("name_s11", 20, 20)]
    (tmp_path / "plan.json").write_text('[{"match": "a_s1", "shape": "a", "seed": 1, "kind": "open", "offset_x": -12.0, "offset_y": 6.0, "windows": [{"start": 25, "end": 150, "anchor": 25, "coh": 0.5}]}]')
    p = readers.plan(spark, str(tmp_path / "plan.json")).first()
    assert (p.match, p.offset_x, p.windows[0].start, p.windows[0].coh) == ("a_s1", -12.0, 25, 0.5)
    (tmp_path / "picks.json").write_text('[{"clip": "clip_01", "match": "a_s1", "count": 8, "cell": "A2", "px": 100.5}]')
    assert readers.picks(spark, str(tmp_path / "picks.json")).first()["clip"] == "clip_01"
    header = ",".join(readers.schemas.CLIP_KEY.names)
    (tmp_path / "key.csv").write_text(header + "\nclip_07,corner,11,9,1,C,red,E3,210.5,330.25,F9,700.5,410.75,3.5,1.25,wideL,901,wideL_s901,40,165,125,5.0,0.111,1.25,0.625,0.5,1.0625\n")
    k = readers.clip_key(spark, str(tmp_path / "key.csv")).first()
    assert (k.clip, k.number, k.ball_final_cell, k.coherence) == ("clip_07", 7, "E3", 1.0625)
    (tmp_path / "ans.jsonl").write_text('{"model": "m", "category": "description", "item_id": "x", "grade": {"predicted": 5, "expected": 7, "correct": false}}\n\n{"category": "prediction", "grade": {"predicted": true, "expected": "bin", "correct": null}}\n')
    a = readers.category_answers(spark, str(tmp_path / "ans.jsonl")).collect()
    assert [(r.grade.predicted, r.grade.expected, r.grade.correct) for r in a] == [("5", "7", False), ("true", "bin", None)]


def test_step_lists_in_many_splits(spark, tmp_path):
    """One long list is read by several tasks, in any layout of blanks, and its frames are numbered over all splits."""
    def step(i):
        return (f'{{"ball":[{i}.0,0.2,0.3],"ball_owned_team":-1,"ball_owned_player":-1,"game_mode":0,"left_team":[[0.0,0.1]],'
                f'"right_team":[[0.5,0.6]],"score":[{i},0]}}')
    (tmp_path / "a_s1.json").write_text("[" + ",".join(map(step, range(400))) + "]")
    (tmp_path / "b_s2.json").write_text("\n [ " + " ,\n ".join(map(step, range(90))) + "\n]\n")
    (tmp_path / "c_s3.json").write_text("[]")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = readers.match_step_lists(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 8
        got = sorted((r.match, r.frame, int(r.ball_x), r.score_l) for r in rows.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [("a_s1", i, i, i) for i in range(400)] + [("b_s2", i, i, i) for i in range(90)]
    for bad in ('[{"ball":[0.0]} {"ball":[0.0]}]', '{"ball":[0.0]}', '[{"ball":[0.0]}', '[1, 2]'):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "d_s4.json").write_text(bad)
        with pytest.raises(Exception):
            readers.match_step_lists(spark, str(tmp_path / "bad")).collect()


def test_other_layouts_are_errors(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"match_id": 1, "steps": []}')
    with pytest.raises(Exception):
        readers.match_step_lists(spark, str(tmp_path / "x.json")).collect()
    (tmp_path / "y.json").write_text("[1, 2]")
    with pytest.raises(Exception):
        readers.match_spans(spark, str(tmp_path / "y.json")).collect()
    (tmp_path / "key.csv").write_text("clip,ball_cell\n1,D5\n")
    with pytest.raises(Exception):
        readers.clip_key(spark, str(tmp_path / "key.csv")).collect()


def test_tenths_as_stored(spark):
    values = [0.25, 2.25, 2.35, 2.45, 2.65, 0.35, 1.0, 0.04, 12.05, 3.3, 0.0]
    from matchlens.operators import report
    got = spark.createDataFrame([(v,) for v in values], "v double").select(report.in_tenths(F.col("v"))).collect()
    assert [r[0] for r in got] == [f"{v:.1f}" for v in values]


def test_step_logs_are_compressed_and_read_back(spark, tmp_path):
    """Plain, the logs take several times the room of what is shuffled for them."""
    from matchlens.plans import fixtures
    from matchlens.sources import readers, writers
    trace = fixtures.trace(spark, "/root/testdata/sf0.001").where("match_id < 3 and frame < 700")
    path = str(tmp_path / "logs")
    writers.step_logs(trace, path)
    files = [p.name for p in (tmp_path / "logs").iterdir() if p.name.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    keys = ["match_id", "frame", "owned_team", "owned_player", "game_mode", "score_l", "score_r"]
    assert sorted(map(tuple, readers.step_logs(spark, path).select(*keys).collect())) == sorted(map(tuple, trace.select(*keys).collect()))


def test_matches_that_share_a_name_keep_their_own_step_lists(spark, tmp_path):
    """Names hold three digits of the seed, so that of 9,800 matches on the first ones share theirs."""
    from matchlens.plans import fixtures
    from matchlens.sources import readers, writers
    frames = spark.createDataFrame([(m, f, 7 + m % 3) for m in (0, 9800, 9814) for f in range(7 + m % 3)], "match_id long, frame long, n long")
    trace = fixtures.named(fixtures.track(frames))
    assert trace.where("match_id > 0").select("match").distinct().count() == 1
    writers.step_lists(trace, str(tmp_path / "lists"))
    keys = ["match", "frame", "owned_team", "game_mode", "score_l"]
    got = readers.match_step_lists(spark, str(tmp_path / "lists")).select(*keys).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, trace.select(*keys).collect()))


def test_scene_graphs_are_compressed_and_read_back(spark, tmp_path):
    """Plain, the documents take many times the room of what is shuffled for them."""
    from matchlens.operators import report
    from matchlens.plans import fixtures
    from matchlens.sources import writers
    clips = spark.createDataFrame([(1, 30, 155, 9), (2, 60, 185, None)], "match_id long, start long, end long, count_last long")
    docs = report.scene_documents(clips, fixtures.trace(spark, "/root/testdata/sf0.001").where("match_id < 3"), unit=1000.0)
    writers.scene_graphs(docs, str(tmp_path / "scenes"))
    files = [p for p in (tmp_path / "scenes").iterdir() if p.name.startswith("part-")]
    assert files and all(p.name.endswith(".json.gz") for p in files)
    back = spark.read.schema(docs.schema).json(str(tmp_path / "scenes"))
    assert back.orderBy("match_id").collect() == docs.orderBy("match_id").collect()
    plain = docs.select(F.length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("n")).agg(F.sum("n")).first()[0]
    assert sum(p.stat().st_size for p in files) * 4 < plain


def test_match_archives_are_compressed_and_keep_matches_apart(spark, tmp_path):
    """Of matches that share a name each has its own archives and seed; several stretches come back in order."""
    from matchlens.plans import fixtures
    from matchlens.sources import readers, writers
    frames = spark.createDataFrame([(m, f) for m in (0, 9800, 9814) for f in range(300)], "match_id long, frame long")
    trace = fixtures.named(fixtures.track(frames).withColumns({c: F.col(c) / 1000.0 for c in ("ball_x", "ball_y", "ball_z")}))
    side = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.struct((i / 16).alias("x"), (i / 32 + F.col("frame") / 64).alias("y")))
    trace = trace.withColumns({"left": side, "right": F.reverse(side)})
    files = writers.match_arrays(trace, str(tmp_path / "npz"), 128).collect()
    assert len(files) == len({r.file for r in files}) == 9 and sum(r.frames for r in files) == 900
    with np.load(files[0].file.removeprefix("file:")) as z:
        assert z["left"].shape == (files[0].frames, 11, 2) and z["left"].dtype == z["ball"].dtype == np.float32
        assert sum(z[k].nbytes for k in z.files) > 2 * sum(i.compress_size for i in z.zip.infolist())
    keys = ["match", "shape", "seed", "frame", "owned_team", "owned_player", "game_mode", "score_l", "score_r", "left", "right",
            *[F.round(f"ball_{a}", 3).alias(f"ball_{a}") for a in "xyz"]]
    got, want = (sorted(map(tuple, df.select(*keys).collect())) for df in (readers.match_arrays(spark, str(tmp_path / "npz")), trace))
    assert got == want
