"""Observation transforms and step-wise episode quantities."""
from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.functions import observation as O
from matchlens.operators import episode as Ep
from matchlens.plans import fixtures as X
from matchlens.plans.oracle import VIEWS, slot_sql, with_views
from matchlens.plans.registry import query

U = X.UNIT

VIEWS["observed"] = """SELECT *, (frame//20)%11 AS active, (frame+match_id)%7-3 AS ball_dx,
    (frame+2*match_id)%5-2 AS ball_dy, (frame+3*match_id)%9-4 AS ball_dz FROM trace"""


def observed(spark, sf):
    """Traces as raw observations: directions, the active player, sticky bits added."""
    return X.trace(spark, sf).select(
        "*", F.expr("(frame div 20) % 11").alias("active"),
        F.expr("(frame + match_id) % 7 - 3").alias("ball_dx"),
        F.expr("(frame + 2 * match_id) % 5 - 2").alias("ball_dy"),
        F.expr("(frame + 3 * match_id) % 9 - 4").alias("ball_dz"),
        *[F.expr("array(" + ", ".join(f"named_struct('x', get(`{side}`, {i}).x % 5, 'y', get(`{side}`, {i}).y % 3)"
                                      for i in range(11)) + ")").alias(f"{side}_dir") for side in ("left", "right")],
        F.expr("array(" + ", ".join(f"(frame div {1 << i}) % 2" for i in range(10)) + ")").alias("sticky"))


def _weighted(side: str, axis: str):
    return F.expr(" + ".join(["0L", *(f"get({side}, {i}).{axis} * {i + 1}" for i in range(11))]))


def _weighted_sql(team: int, axis: int, mod: str = "") -> str:
    value = slot_sql(str(team), "s")[axis]
    return f"CAST(list_sum(list_transform(range(0,11), lambda s: {value}{mod}*(s+1))) AS BIGINT)"


@query("flipped_observations", "P15", with_views(f"""SELECT match_id, frame, -ball_x AS ball_x,
    -ball_y AS ball_y, ball_z, CASE WHEN owned_team>-1 THEN 1-owned_team ELSE -1 END AS
    owned_team, score_r AS score_l, score_l AS score_r, -{_weighted_sql(1, 0)} AS left_x,
    -{_weighted_sql(1, 1)} AS left_y, -{_weighted_sql(0, 0)} AS right_x, -{_weighted_sql(0, 1)} AS right_y,
    -{_weighted_sql(1, 0, "%5")} AS left_dir_x, array_to_string(list_transform(
    [4,5,6,7,0,1,2,3,8,9], lambda i: (frame//(1<<i))%2),'') AS sticky, true AS involution
    FROM observed"""))
def _(spark, sf):
    o = observed(spark, sf)
    once = O.flip(o.withColumn("original", F.struct(*o.columns)))
    cols = [c for c in o.columns]
    twice = O.flip(once.withColumn("flipped", F.struct(*cols)))
    f = "flipped"
    return twice.select(
        "match_id", "frame", *[F.col(f"{f}.{c}").alias(c) for c in (
            "ball_x", "ball_y", "ball_z", "owned_team", "score_l", "score_r")],
        *[_weighted(f"{f}.`{side}`", axis).alias(f"{side}_{axis}")
          for side in ("left", "right") for axis in "xy"],
        _weighted(f"{f}.left_dir", "x").alias("left_dir_x"),
        F.concat_ws("", F.col(f"{f}.sticky").cast("array<string>")).alias("sticky"),
        (F.struct(*cols) == F.col("original")).alias("involution"))


def _vector_sql(packed: bool) -> str:
    blocks = ["lp", "ld", "rp", "rd"]
    def fill(b, n):
        return f"list_concat({b}, list_transform(range(0, {n}-len({b})), lambda z: -1.0::DOUBLE))"
    if packed:
        people = fill("list_concat(lp, ld, rp, rd)", 88)
    else:
        people = "list_concat(" + ", ".join(fill(b, 22) for b in blocks) + ")"
    return f"""list_concat({people}, [ball_x::DOUBLE, ball_y, ball_z, ball_dx, ball_dy, ball_dz],
        list_transform(range(-1,2), lambda t: CASE WHEN t=owned_team THEN 1.0::DOUBLE ELSE 0.0 END),
        list_transform(range(0,11), lambda t: CASE WHEN t=active THEN 1.0::DOUBLE ELSE 0.0 END),
        list_transform(range(0,7), lambda t: CASE WHEN t=game_mode THEN 1.0::DOUBLE ELSE 0.0 END))"""


@query("feature_vectors", "P16", with_views(f"""SELECT match_id, frame, len(f) AS n_fixed,
    len(p) AS n_packed, list_sum(list_transform(f, lambda v, i: v*i)) AS sum_fixed,
    list_sum(list_transform(p, lambda v, i: v*i)) AS sum_packed, f[23] AS f23, p[23] AS p23
    FROM (SELECT match_id, frame, {_vector_sql(False)} AS f, {_vector_sql(True)} AS p FROM observed
    JOIN (SELECT match_id, frame,
    flatten(list([x::DOUBLE,y::DOUBLE] ORDER BY slot) FILTER (team=0 AND slot<11-match_id%3)) AS lp,
    flatten(list([(x%5)::DOUBLE,(y%3)::DOUBLE] ORDER BY slot) FILTER (team=0 AND slot<11-match_id%3)) AS ld,
    flatten(list([x::DOUBLE,y::DOUBLE] ORDER BY slot) FILTER (team=1)) AS rp,
    flatten(list([(x%5)::DOUBLE,(y%3)::DOUBLE] ORDER BY slot) FILTER (team=1)) AS rd
    FROM players GROUP BY 1,2) q USING (match_id, frame))"""))
def _(spark, sf):
    o = observed(spark, sf)
    short = F.expr("11 - cast(match_id % 3 as int)")
    o = o.withColumn("left", F.slice("left", F.lit(1), short)).withColumn(
        "left_dir", F.slice("left_dir", F.lit(1), short))
    v = o.select("match_id", "frame", O.features(True).alias("f"), O.features(False).alias("p"))

    def weigh(c):
        return F.expr(" + ".join(["0.0D", *(f"get({c}, {i}) * {i + 1}" for i in range(O.LENGTH))]))
    return v.select("match_id", "frame", F.size("f").cast("bigint").alias("n_fixed"),
                    F.size("p").cast("bigint").alias("n_packed"), weigh("f").alias("sum_fixed"),
                    weigh("p").alias("sum_packed"), F.get("f", F.lit(22)).alias("f23"),
                    F.get("p", F.lit(22)).alias("p23"))


@query("minimap_cells", "P17", with_views("""SELECT match_id, layer, y, x, count(*) AS frames FROM (
    SELECT DISTINCT match_id, frame, layer,
    greatest(0,least(71,trunc((py/1000.0::DOUBLE+1.0::DOUBLE/2.25::DOUBLE)/(2*(1.0::DOUBLE/2.25::DOUBLE))*72)))::BIGINT AS y,
    greatest(0,least(95,trunc((px/1000.0::DOUBLE+1.0::DOUBLE)/2.0::DOUBLE*96)))::BIGINT AS x FROM (
    SELECT match_id, frame, CASE team WHEN 0 THEN 'left_team' ELSE 'right_team' END AS layer,
      x AS px, y AS py FROM players UNION ALL
    SELECT match_id, frame, 'ball', ball_x, ball_y FROM trace UNION ALL
    SELECT p.match_id, p.frame, 'active', p.x, p.y FROM players p JOIN observed o ON
      o.match_id=p.match_id AND o.frame=p.frame WHERE p.team=0 AND p.slot=o.active))
    GROUP BY 1,2,3,4"""))
def _(spark, sf):
    return O.minimap(observed(spark, sf), ["match_id", "frame"], unit=U).groupBy(
        "match_id", "layer", "y", "x").agg(F.count(F.lit(1)).alias("frames"))


@query("step_rewards", "W20", with_views("""SELECT match_id, frame, d-coalesce(lag(d) OVER
    (PARTITION BY match_id ORDER BY frame),0) AS reward, d AS cumulative FROM (SELECT match_id,
    frame, score_l-score_r AS d FROM trace)"""))
def _(spark, sf):
    return Ep.rewards(X.trace(spark, sf))


@query("waiting_counter", "W21", with_views("""SELECT match_id, frame, CASE WHEN game_mode=0 THEN 0
    ELSE row_number() OVER (PARTITION BY match_id, grp ORDER BY frame) - CASE WHEN opener THEN 0 ELSE 1 END END AS waiting FROM (SELECT *, grp=0 AS opener FROM (SELECT *,
    sum(CASE WHEN game_mode=0 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame) AS grp
    FROM trace))"""))
def _(spark, sf):
    return Ep.waiting(X.trace(spark, sf))


@query("waiting_spans", "W21", with_views("""SELECT match_id, min(frame) AS since, max(frame) AS
    until, count(*) AS frames FROM (SELECT *, frame-row_number() OVER (PARTITION BY match_id ORDER BY
    frame) AS isl FROM trace WHERE game_mode<>0) GROUP BY match_id, isl"""))
def _(spark, sf):
    return Ep.waiting_spans(X.trace(spark, sf))


@query("episode_ends", "W22", with_views("""SELECT match_id, on_score, on_out_of_play,
    on_possession_change, on_duration, least(on_score, on_out_of_play, on_possession_change,
    on_duration) AS ends FROM (SELECT match_id, min(frame) FILTER (score_l>0 OR score_r>0) AS
    on_score, min(frame) FILTER (game_mode<>0 AND pm=0) AS on_out_of_play,
    min(frame) FILTER (owned_team<>-1 AND po<>owned_team) AS on_possession_change,
    min(frame) FILTER (frame+1>=400) AS on_duration FROM (SELECT *, lag(game_mode) OVER w AS pm,
    last_value(CASE WHEN owned_team>=0 THEN owned_team END IGNORE NULLS) OVER (PARTITION BY match_id
    ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM trace WINDOW w AS
    (PARTITION BY match_id ORDER BY frame)) GROUP BY 1)"""))
def _(spark, sf):
    return Ep.episode_end(X.trace(spark, sf), 400)


@query("checkpoint_rewards", "W23", with_views("""SELECT match_id, frame, collected,
    round(reward+(collected-coalesce(lag(collected) OVER (PARTITION BY match_id ORDER BY frame),0))
    *0.1::DOUBLE,6) AS reward FROM (SELECT match_id, frame, reward, max(now) OVER (PARTITION BY match_id
    ORDER BY frame)::BIGINT AS collected FROM (SELECT match_id, frame, reward, CASE WHEN reward=1 THEN 10
    WHEN owned_team=0 AND owned_player=active THEN (SELECT count(*) FROM range(0,10) t(i) WHERE
    d<=0.99::DOUBLE-0.8::DOUBLE/9*i) ELSE 0 END AS now FROM (SELECT *, score_l-score_r-coalesce(
    lag(score_l-score_r) OVER (PARTITION BY match_id ORDER BY frame),0) AS reward,
    sqrt((ball_x/1000.0::DOUBLE-1)*(ball_x/1000.0::DOUBLE-1)+(ball_y/1000.0::DOUBLE)*(ball_y/1000.0::DOUBLE))
    AS d FROM observed)))"""))
def _(spark, sf):
    return Ep.checkpoint_rewards(observed(spark, sf), unit=U)


@query("stacked_frames", "W24", with_views("""SELECT match_id, frame,
    coalesce(lag(ball_x,3) OVER w, first_value(ball_x) OVER w) AS x0,
    coalesce(lag(ball_x,2) OVER w, first_value(ball_x) OVER w) AS x1,
    coalesce(lag(ball_x,1) OVER w, first_value(ball_x) OVER w) AS x2, ball_x AS x3
    FROM trace WINDOW w AS (PARTITION BY match_id ORDER BY frame)"""))
def _(spark, sf):
    s = Ep.stacked(X.trace(spark, sf), ["ball_x"], 4)
    return s.select("match_id", "frame", *[F.get("ball_x", F.lit(i)).alias(f"x{i}")
                                           for i in range(4)])


@query("prediction_truth", "W27", with_views("""SELECT match_id, cutoff_x, cutoff_y, end_x, end_y,
    CAST(greatest(0,least(5,trunc((end_x+1.0::DOUBLE)/(2.0::DOUBLE/6)))) AS BIGINT) AS end_col,
    CAST(greatest(0,least(3,trunc((end_y+0.42::DOUBLE)/(0.84::DOUBLE/4)))) AS BIGINT) AS end_row,
    left_scored, right_scored, end_frame, end_frame<580 AS ended_early FROM (SELECT match_id,
    arg_max(ball_x,frame) FILTER (frame<=50)/1000.0::DOUBLE AS cutoff_x,
    arg_max(ball_y,frame) FILTER (frame<=50)/1000.0::DOUBLE AS cutoff_y,
    arg_max(ball_x,frame)/1000.0::DOUBLE AS end_x, arg_max(ball_y,frame)/1000.0::DOUBLE AS end_y,
    arg_max(score_l,frame)>0 AS left_scored, arg_max(score_r,frame)>0 AS right_scored,
    max(frame) AS end_frame FROM trace GROUP BY 1)"""))
def _(spark, sf):
    return Ep.prediction_truth(X.trace(spark, sf), 50, 580, unit=U)


@query("decimated_trace", "S12", with_views("SELECT match_id, frame, ball_x, ball_y, ball_z FROM "
                                            "trace WHERE frame%5=0"))
def _(spark, sf):
    return Ep.decimate(X.trace(spark, sf), 5).select("match_id", "frame", "ball_x", "ball_y",
                                                     "ball_z")


@query("upsampled_trace", "S13", with_views("""SELECT match_id, frame AS source_frame, ball_x,
    frame*3+k AS frame, CASE WHEN k=0 THEN 'act' || (frame%19) ELSE 'idle' END AS action
    FROM trace JOIN lengths l USING (match_id), (SELECT unnest(range(0,13)) AS k)
    WHERE k<3 OR frame=l.n-1"""))
def _(spark, sf):
    t = X.trace(spark, sf).select("match_id", "frame", "n", "ball_x", F.concat(
        F.lit("act"), (F.col("frame") % 19).cast("string")).alias("action"))
    return Ep.upsample(t, 3).drop("n")
