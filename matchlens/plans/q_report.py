"""Clip classification, passes, scene graphs, batch statistics, rollouts."""
from __future__ import annotations

from pyspark.sql import functions as F

from matchlens import config as C, session
from matchlens.functions import grid as Gr
from matchlens.operators import lookups as L, report as R, select as S
from matchlens.plans import fixtures as X, q_joins as J
from matchlens.plans.oracle import VIEWS, with_views
from matchlens.plans.q_grading import cell_sql
from matchlens.plans.registry import query

U = X.UNIT

# Clips with a kind each, so that every wording of the report occurs.
VIEWS["kinded"] = """SELECT *, (['open','corner','gk_throw','kickoff'])[match_id%4+1] AS kind,
    start-20+(match_id%7)*10 AS anchor FROM clips"""
VIEWS["clip_rows"] = """SELECT k.match_id, k.start, k."end", k.kind, k.anchor, t.*
    EXCLUDE (match_id), b.near_n, s.people FROM kinded k JOIN (SELECT *, sqrt(
    (ball_x-lag(ball_x) OVER w)*52.5::DOUBLE*((ball_x-lag(ball_x) OVER w)*52.5::DOUBLE)+
    (ball_y-lag(ball_y) OVER w)*(34.0::DOUBLE/0.42::DOUBLE)*((ball_y-lag(ball_y) OVER w)*
    (34.0::DOUBLE/0.42::DOUBLE))) AS step_m FROM trace WINDOW w AS (PARTITION BY match_id
    ORDER BY frame)) t ON t.match_id=k.match_id AND t.frame>=k.start AND t.frame<k."end"
    JOIN bodies b ON b.match_id=k.match_id AND b.frame=t.frame
    LEFT JOIN (SELECT match_id, frame, count(*) FILTER (body_px>=20) AS people FROM inshot
      GROUP BY 1,2) s ON s.match_id=k.match_id AND s.frame=t.frame"""
VIEWS["clip_facts"] = """SELECT match_id, start, "end", kind, anchor,
    round(sum(step_m) FILTER (frame>start)/1000.0::DOUBLE,6) AS travel_m,
    arg_min(ball_x,frame) AS x0, arg_min(ball_y,frame) AS y0, arg_max(ball_x,frame) AS x1,
    arg_max(ball_y,frame) AS y1, max(ball_z)/1000.0::DOUBLE AS apex_m,
    avg(CASE WHEN ball_z>500 THEN 1.0 ELSE 0.0 END)::DOUBLE AS airborne_frac,
    arg_min(owned_team,frame) AS ps, arg_max(owned_team,frame) AS pe,
    arg_min(near_n,frame) AS near_start, arg_max(near_n,frame) AS near_end,
    arg_min(people,frame) AS count_start, min(people) AS count_min, max(people) AS count_max,
    arg_max(people,frame) AS count_end FROM clip_rows GROUP BY 1,2,3,4,5"""
VIEWS["turns"] = """SELECT match_id, start, count(*) FILTER (was<>owned_team) AS turnovers FROM (
    SELECT match_id, start, owned_team, lag(owned_team) OVER (PARTITION BY match_id, start
    ORDER BY frame) AS was FROM clip_rows WHERE owned_team>=0) GROUP BY 1,2"""
VIEWS["classified"] = """SELECT f.match_id, f.start, "end", kind, anchor, travel_m, net_m,
    CASE WHEN abs(dx)<5 THEN 'across the pitch' WHEN dx>0 THEN 'towards the red goal' ELSE
    'towards the blue goal' END AS direction, apex_m, airborne_frac,
    CASE WHEN x0/1000.0::DOUBLE< -1.0::DOUBLE/3 THEN 'blue defensive third' WHEN x0/1000.0::DOUBLE>1.0::DOUBLE/3
      THEN 'red defensive third' ELSE 'middle third' END AS zone_start,
    CASE WHEN x1/1000.0::DOUBLE< -1.0::DOUBLE/3 THEN 'blue defensive third' WHEN x1/1000.0::DOUBLE>1.0::DOUBLE/3
      THEN 'red defensive third' ELSE 'middle third' END AS zone_end,
    (['loose','blue','red'])[ps+2] AS possession_start, (['loose','blue','red'])[pe+2] AS
    possession_end, coalesce(turnovers,0) AS possession_changes, near_start, near_end,
    CASE WHEN near_end<2 THEN 'isolated' WHEN near_end<5 THEN 'contested' ELSE 'crowded' END AS
    crowding_end, count_start, count_min, count_max, count_end, count_end-count_start AS count_delta,
    CASE kind WHEN 'open' THEN 'open play' WHEN 'corner' THEN 'corner kick' WHEN 'kickoff' THEN
    'kick-off' ELSE 'goalkeeper distribution' END AS situation,
    CASE WHEN kind<>'open' THEN (anchor-f.start)/25.0::DOUBLE END AS restart_s,
    CASE WHEN kind<>'open' THEN f.start<=anchor AND anchor<"end" END AS restart_visible
    FROM (SELECT *, (x1-x0)*52.5::DOUBLE/1000.0::DOUBLE AS dx, round(sqrt(((x1-x0)*52.5::DOUBLE/1000.0::DOUBLE)
    *((x1-x0)*52.5::DOUBLE/1000.0::DOUBLE)+((y1-y0)*(34.0::DOUBLE/0.42::DOUBLE)/1000.0::DOUBLE)*((y1-y0)*
    (34.0::DOUBLE/0.42::DOUBLE)/1000.0::DOUBLE)),6) AS net_m FROM clip_facts) f LEFT JOIN turns t
    ON t.match_id=f.match_id AND t.start=f.start"""


def kinded(spark, sf):
    return J.clips(spark, sf).withColumn("kind", F.expr(
        "element_at(array('open','corner','gk_throw','kickoff'), cast(match_id % 4 + 1 as int))")
    ).withColumn("anchor", F.expr("start - 20 + (match_id % 7) * 10"))


CLASS_KEY = ["match_id", "start", "end", "kind", "anchor"]


def classified(spark, sf):
    return R.classify(kinded(spark, sf).select(*CLASS_KEY), X.trace(spark, sf),
                      X.inshot(spark, sf), unit=U)


@query("clip_classification", "W16 W14 P8 P9", with_views("SELECT * FROM classified"))
def _(spark, sf):
    return classified(spark, sf)


VIEWS["sentences"] = """SELECT match_id, start, concat_ws('; ',
    CASE WHEN kind='open' THEN 'Open play in the ' || zone_start WHEN restart_visible THEN
      verb || ' ' || printf('%.1f',restart_s) || ' s into the clip' ELSE verb || ' ' ||
      printf('%.1f',abs(restart_s)) || ' s before the clip opens, so the clip shows what followed'
      END,
    'net movement ' || printf('%.0f',net_m) || ' m ' || direction || ' over ' ||
      printf('%.0f',travel_m) || ' m of travel, finishing in the ' || zone_end,
    CASE WHEN apex_m>=2.0 THEN 'lofted to ' || printf('%.1f',apex_m) || ' m' END,
    near_end || CASE WHEN near_end=1 THEN ' player' ELSE ' players' END || ' around it at the end ('
      || crowding_end || ')',
    CASE WHEN possession_end='loose' THEN 'nobody in possession at the end' ELSE possession_end ||
      ' in possession at the end' END,
    CASE WHEN possession_changes>0 THEN possession_changes || CASE WHEN possession_changes>1 THEN
      ' changes' ELSE ' change' END || ' of possession' END,
    count_start || ' people in shot at the start and ' || count_end || ' at the end (' ||
      CASE WHEN count_delta=0 THEN 'unchanged' WHEN count_delta>0 THEN '+' || count_delta ELSE
      CAST(count_delta AS VARCHAR) END || ')') || '.' AS description FROM (SELECT *, CASE kind WHEN
    'corner' THEN 'Corner kick taken' WHEN 'gk_throw' THEN 'Keeper releases the ball' ELSE
    'Kick-off restart' END AS verb FROM classified)"""


@query("clip_sentences", "P18", with_views("SELECT * FROM sentences"))
def _(spark, sf):
    return classified(spark, sf).select("match_id", "start", R.sentence().alias("description"))


def _or_blank(c):
    return F.coalesce(c.cast("string"), F.lit(""))


def _open(value):
    return F.when(F.col("kind") == "open", F.lit("")).otherwise(value)


# Columns of the shipped classification table, in order: (name, builder) pairs.
REPORT_FIELDS = [
    ("clip", lambda: F.concat(F.lit("clip_"), F.col("match_id").cast("string"))),
    ("situation", lambda: F.col("situation")), ("description", R.sentence),
    *[(name, lambda c=c: F.col(c)) for name, c in (
        ("players_in_frame_start", "count_start"), ("players_in_frame_end", "count_end"),
        ("players_in_frame_delta", "count_delta"), ("players_in_frame_min", "count_min"),
        ("players_in_frame_max", "count_max"), ("ball_start_cell", "start_cell"),
        ("ball_final_cell", "cell"), ("zone_start", "zone_start"), ("zone_end", "zone_end"),
        ("ball_direction", "direction"))],
    *[(name, lambda c=c, n=n: R.parts_of(F.col(c), 10 ** n) / float(10 ** n)) for name, c, n in (
        ("ball_travel_m", "travel_m", 1), ("ball_net_m", "net_m", 1), ("ball_apex_m", "apex_m", 2),
        ("airborne_fraction", "airborne_frac", 3))],
    *[(name, lambda c=c: F.col(c)) for name, c in (
        ("possession_start", "possession_start"), ("possession_end", "possession_end"),
        ("possession_changes", "possession_changes"), ("players_near_ball_start", "near_start"),
        ("players_near_ball_end", "near_end"), ("crowding_end", "crowding_end"))],
    ("restart_seconds_into_clip", lambda: _open(_or_blank(F.round("restart_s", 2)))),
    ("restart_visible_in_clip", lambda: _open(_or_blank(F.col("restart_visible")))),
    *[(name, lambda c=c: F.col(c)) for name, c in (
        ("shape", "shape"), ("seed", "seed"), ("match", "match"), ("start_frame", "start"),
        ("end_frame", "end"), ("camera_offset_x", "offset_x"), ("camera_offset_y", "offset_y"))],
    ("same_play_as", lambda: F.when(F.col("same_play") > 0, F.concat(
        F.col("same_play").cast("string"), F.lit(" other clips"))).otherwise(F.lit(""))),
]


@query("classification_columns", "U5 W16", with_views("""SELECT 'clip_' || c.match_id AS clip, situation,
    description, count_start AS players_in_frame_start, count_end AS players_in_frame_end, count_delta AS
    players_in_frame_delta, count_min AS players_in_frame_min, count_max AS players_in_frame_max,
    b.srow || b.scol AS ball_start_cell, k.cell AS ball_final_cell, zone_start, zone_end,
    direction AS ball_direction, CAST(printf('%.1f',travel_m) AS DOUBLE) AS ball_travel_m, CAST(printf('%.1f',net_m) AS DOUBLE) AS ball_net_m,
    CAST(printf('%.2f',apex_m) AS DOUBLE) AS ball_apex_m, CAST(printf('%.3f',airborne_frac) AS DOUBLE) AS airborne_fraction, possession_start,
    possession_end, possession_changes, near_start AS players_near_ball_start, near_end AS
    players_near_ball_end, crowding_end, CASE WHEN c.kind='open' THEN '' ELSE
    CAST(round(restart_s,2) AS VARCHAR) END AS restart_seconds_into_clip, CASE WHEN c.kind='open' THEN ''
    ELSE CAST(restart_visible AS VARCHAR) END AS restart_visible_in_clip, shape, seed, match,
    c.start AS start_frame, c."end" AS end_frame,
    ([0.0,-12.0,12.0,-20.0,20.0,-6.0,6.0,-24.0,24.0,-16.0,16.0])[c.match_id%11+1]::DOUBLE AS camera_offset_x,
    ([0.0,6.0,-5.0,10.0,-9.0,3.0,-2.0,8.0,-7.0])[c.match_id%9+1]::DOUBLE AS camera_offset_y,
    CASE WHEN s.n>0 THEN s.n || ' other clips' ELSE '' END AS same_play_as
    FROM classified c JOIN named USING (match_id) JOIN sentences d ON d.match_id=c.match_id AND d.start=c.start
    JOIN kinded k ON k.match_id=c.match_id AND k.start=c.start
    LEFT JOIN starts b ON b.match_id=c.match_id AND b.frame=c.start
    JOIN (SELECT x.match_id, count(y.match_id) AS n FROM plays x LEFT JOIN plays y ON y.play=x.play AND
      y.match_id<>x.match_id AND x.start<y."end" AND y.start<x."end" GROUP BY 1) s ON s.match_id=c.match_id""",
    plays="""SELECT match_id, start, "end", match_id%7 AS play FROM clips""",
    starts=f"SELECT match_id, frame, {cell_sql(prefix='s')} FROM ballpix"))
def _(spark, sf):
    rows = session.cut_lineage(kinded(spark, sf))
    facts = R.classify(rows.select(*CLASS_KEY), X.trace(spark, sf), X.inshot(spark, sf), unit=U)
    pixels = X.ballpix(spark, sf).select("match_id", F.col("frame").alias("start"), Gr.cell_of(
        F.col("px"), F.col("py")).alias("start_cell"))
    # some matches replay the play of others
    play = rows.select("match_id", (F.col("match_id") % 7).cast("string").alias("digest"))
    same = L.same_play(rows.select("match_id", "start", "end"), play).select("match_id", "same_play")
    full = (X.named(facts).join(rows.select("match_id", "start", "cell"), ["match_id", "start"])
            .join(rows.select("match_id", "start").join(pixels, ["match_id", "start"]), ["match_id", "start"], "left")
            .join(same, "match_id"))
    full = S.scheduled(full, "match_id")
    return full.select(*[build().alias(n) for n, build in REPORT_FIELDS])


@query("passes_while_hidden", "W15", with_views("""SELECT c.match_id, c.start, c."end",
    coalesce(p.passes,0) AS passes, coalesce(p.turnovers,0) AS turnovers, coalesce(p.changes,0) AS
    changes FROM clips c LEFT JOIN (SELECT match_id, start, count(*) FILTER (ot=pt) AS passes,
    count(*) FILTER (ot<>pt) AS turnovers, count(*) AS changes FROM (SELECT *,
    lag(ot) OVER w AS pt, lag(op) OVER w AS pp FROM (SELECT match_id, start, run, min(owned_team) AS
    ot, min(owned_player) AS op, count(*) AS len FROM (SELECT *, sum(fresh) OVER (PARTITION BY
    match_id, start ORDER BY frame) AS run FROM (SELECT *, CASE WHEN owned_team=lag(owned_team)
    OVER x AND owned_player=lag(owned_player) OVER x THEN 0 ELSE 1 END AS fresh FROM clip_rows
    WHERE frame>=start+24 WINDOW x AS (PARTITION BY match_id, start ORDER BY frame)))
    WHERE owned_team>=0 GROUP BY 1,2,3) WHERE len>=2 WINDOW w AS (PARTITION BY match_id, start
    ORDER BY run)) WHERE pt IS NOT NULL AND (pt<>ot OR pp<>op) GROUP BY 1,2) p
    ON p.match_id=c.match_id AND p.start=c.start"""))
def _(spark, sf):
    return R.passes(J.clips(spark, sf), X.trace(spark, sf))


@query("ball_velocity", "W6", with_views("""SELECT match_id, frame,
    coalesce(ball_x-lag(ball_x) OVER w,0)*25/1000.0::DOUBLE AS vx,
    coalesce(ball_y-lag(ball_y) OVER w,0)*25/1000.0::DOUBLE AS vy,
    coalesce(ball_z-lag(ball_z) OVER w,0)*25/1000.0::DOUBLE AS vz FROM trace WINDOW w AS
    (PARTITION BY match_id ORDER BY frame)"""))
def _(spark, sf):
    return R.velocities(X.trace(spark, sf), unit=U)


VIEWS["clip_players"] = """SELECT c.match_id, c.start, p.frame, p.team, p.slot, p.x, p.y, q.x AS wx,
    q.y AS wy FROM clips c JOIN players p ON p.match_id=c.match_id AND p.frame>=c.start AND
    p.frame<c."end" LEFT JOIN players q ON q.match_id=p.match_id AND q.frame=p.frame-1 AND
    q.team=p.team AND q.slot=p.slot"""


@query("scene_graph_players", "S8 W6", with_views("""SELECT match_id, start, frame-start AS frame,
    (['A','B'])[team+1] || slot AS id, (['GK','RM','CF','LB','CB','CB','RB','CM','CM','CM','LM'])
    [slot+1] AS role, round(x/1000.0::DOUBLE,4) AS x, round(y/1000.0::DOUBLE,4) AS y,
    round((x-coalesce(wx,x))*25/1000.0::DOUBLE,4) AS vx,
    round((y-coalesce(wy,y))*25/1000.0::DOUBLE,4) AS vy FROM clip_players"""))
def _(spark, sf):
    docs = R.scene_documents(J.clips(spark, sf).select("match_id", "start", "end", "cell"),
                             X.trace(spark, sf), unit=U)
    f = docs.select("match_id", "start", F.explode("frames").alias("f"))
    return f.select("match_id", "start", F.col("f.frame").alias("frame"),
                    F.explode("f.players").alias("p")).select(
        "match_id", "start", "frame", "p.id", "p.role", "p.x", "p.y", "p.vx", "p.vy")


@query("scene_graph_frames", "S8 P20 A24 J8", with_views("""SELECT k.match_id, k.start, cell,
    125::INTEGER AS n_frames, t.frame-k.start AS frame, t.frame AS engine_frame,
    round((t.frame-k.start)/25.0::DOUBLE,3) AS t, (['normal','kickoff','goalkick','freekick','corner',
    'throwin','penalty'])[game_mode+1] AS game_mode, owned_team<0 AS loose,
    CASE owned_team WHEN 0 THEN 'A' WHEN 1 THEN 'B' END || owned_player AS holder,
    (['A','B'])[n.team+1] || n.slot AS nearest, round(sqrt(n.d2::DOUBLE)/1000.0::DOUBLE,4) AS distance,
    CASE WHEN t.frame-k.start<25 THEN round(t.ball_x/1000.0::DOUBLE,4) END AS ball_x,
    CASE WHEN t.frame-k.start<25 THEN round((ball_z-coalesce(pz,ball_z))*25/1000.0::DOUBLE,4) END
    AS ball_vz, round(cx,4) AS centroid_a_x, round(cy,4) AS centroid_b_y FROM clips k JOIN (SELECT *, lag(ball_z)
    OVER (PARTITION BY match_id ORDER BY frame) AS pz FROM trace) t ON t.match_id=k.match_id AND
    t.frame>=k.start AND t.frame<k."end" JOIN (SELECT *, row_number() OVER (PARTITION BY match_id,
    frame ORDER BY d2, team, slot) AS r FROM (SELECT *, (x-ball_x)*(x-ball_x)+(y-ball_y)*(y-ball_y)
    AS d2 FROM players)) n ON n.match_id=t.match_id AND n.frame=t.frame AND n.r=1
    JOIN (SELECT match_id, frame, sum(x) FILTER (team=0)/11.0::DOUBLE/1000.0::DOUBLE AS cx, sum(y) FILTER
    (team=1)/11.0::DOUBLE/1000.0::DOUBLE AS cy FROM players GROUP BY 1,2) c ON c.match_id=t.match_id AND
    c.frame=t.frame"""))
def _(spark, sf):
    docs = R.scene_documents(J.clips(spark, sf).select("match_id", "start", "end", "cell"),
                             X.trace(spark, sf), unit=U, hide_after=25)
    f = docs.select("match_id", "start", F.col("ground_truth.cell").alias("cell"), "n_frames",
                    F.explode("frames").alias("f"))
    return f.select(
        "match_id", "start", "cell", "n_frames", "f.frame", "f.engine_frame", "f.t",
        "f.game_mode", F.col("f.possession.loose").alias("loose"),
        F.col("f.possession.player").alias("holder"),
        F.col("f.nearest_player_to_ball.id").alias("nearest"),
        F.col("f.nearest_player_to_ball.distance").alias("distance"),
        F.col("f.ball.x").alias("ball_x"), F.col("f.ball.vz").alias("ball_vz"),
        F.col("f.team_centroid.A")[0].alias("centroid_a_x"),
        F.col("f.team_centroid.B")[1].alias("centroid_b_y"))


# --- batch statistics ---
def truth_cells(spark, sf):
    r, c = Gr.cell_index(F.col("px"), F.col("py"))
    return X.ballpix(spark, sf).select("match_id", "frame", "px", "py", r.alias("row"),
                                       c.alias("col"))


VIEWS["cells"] = f"""SELECT match_id, frame, px, py, ascii(crow)-65 AS row, ccol-1 AS col FROM (
    SELECT *, {cell_sql(prefix='c')} FROM ballpix)"""


@query("grid_heatmap", "A11", with_views("""SELECT 'cell' AS level, r AS row, c AS col,
    count(k.px) AS n, (SELECT count(*) FROM cells)/96.0::DOUBLE AS expected FROM
    (SELECT unnest(range(0,6)) AS r), (SELECT unnest(range(0,16)) AS c) LEFT JOIN cells k ON
    k.row=r AND k.col=c GROUP BY 2,3 UNION ALL
    SELECT 'row', r, NULL, count(k.px), (SELECT count(*) FROM cells)/6.0::DOUBLE FROM
    (SELECT unnest(range(0,6)) AS r) LEFT JOIN cells k ON k.row=r GROUP BY 2 UNION ALL
    SELECT 'col', NULL, c, count(k.px), (SELECT count(*) FROM cells)/16.0::DOUBLE FROM
    (SELECT unnest(range(0,16)) AS c) LEFT JOIN cells k ON k.col=c GROUP BY 3"""))
def _(spark, sf):
    return R.grid_heatmap(truth_cells(spark, sf))




@query("spread_stats", "A12", with_views("""SELECT match_id, sum(n)::BIGINT AS n, count(*) AS
    occupied, max(n) AS top, max(n)*100.0::DOUBLE/sum(n) AS top_pct, count(DISTINCT row) AS
    rows_used, count(DISTINCT col) AS cols_used, any_value(sx) AS px_sd, any_value(sy) AS py_sd
    FROM (SELECT match_id, row, col, count(*) AS n FROM cells GROUP BY 1,2,3) JOIN (SELECT match_id,
    round(stddev_pop(px),6) AS sx, round(stddev_pop(py),6) AS sy FROM cells GROUP BY 1)
    USING (match_id) GROUP BY 1"""))
def _(spark, sf):
    return R.spread_stats(truth_cells(spark, sf), ["match_id"])


@query("spread_before_after", "A13", with_views(f"""SELECT batch, sum(n)::BIGINT AS n, count(*) AS
    occupied, max(n) AS top, max(n)*100.0::DOUBLE/sum(n) AS top_pct, count(DISTINCT row) AS
    rows_used, count(DISTINCT col) AS cols_used, any_value(sx) AS px_sd, any_value(sy) AS py_sd
    FROM (SELECT batch, row, col, count(*) AS n FROM sides GROUP BY 1,2,3) JOIN (SELECT batch,
    round(stddev_pop(px),6) AS sx, round(stddev_pop(py),6) AS sy FROM sides GROUP BY 1)
    USING (batch) GROUP BY 1""", sides=f"""SELECT batch, px, py, ascii(crow)-65 AS row,
    ccol-1 AS col FROM (SELECT *, {cell_sql(prefix='c')} FROM (SELECT 'before' AS batch, px, py
    FROM old_picks UNION ALL SELECT 'after', px, py FROM new_picks))"""))
def _(spark, sf):
    r, c = Gr.cell_index(F.col("px"), F.col("py"))
    old, new = J.both_picks(spark, sf)
    rows = old.select(F.lit("before").alias("batch"), "px", "py").unionByName(
        new.select(F.lit("after").alias("batch"), "px", "py"))
    return R.spread_stats(rows.select("batch", "px", "py", r.alias("row"), c.alias("col")),
                          ["batch"])


@query("level_distribution", "A25 A28", with_views("""SELECT level, measured, designed,
    CASE WHEN designed=0 THEN 'out of range' WHEN measured=0 THEN 'missing' WHEN measured>designed
    THEN 'over' ELSE '' END AS note FROM (SELECT coalesce(w.level,g.count_last) AS level,
    coalesce(n,0) AS measured, coalesce(designed,0)::BIGINT AS designed FROM (SELECT
    unnest(range(8,20)) AS level, 2 AS designed) w FULL JOIN (SELECT count_last, count(*) AS n FROM
    clips GROUP BY 1) g ON g.count_last=w.level)"""))
def _(spark, sf):
    return R.level_distribution(J.clips(spark, sf).withColumnRenamed("count_last", "level"))


@query("shape_tallies", "A28", with_views("""SELECT shape, count(*) AS clips,
    count(DISTINCT seed) AS seeds, min(count_last) AS fewest, max(count_last) AS most FROM clips
    JOIN named USING (match_id) GROUP BY 1"""))
def _(spark, sf):
    return X.named(J.clips(spark, sf)).groupBy("shape").agg(
        F.count(F.lit(1)).alias("clips"), F.countDistinct("seed").alias("seeds"),
        F.min("count_last").alias("fewest"), F.max("count_last").alias("most"))


def final_slots(spark, sf, picks):
    """clip, slot, pix, body_pix of the last frame of each pick."""
    last = picks.select("match_id", "clip", (F.col("end") - 1).alias("frame"))
    j = last.join(X.inshot(spark, sf), ["match_id", "frame"])
    return j.select("clip", F.posexplode(F.arrays_zip("body", "shadow"))
                    .alias("slot", "p")).select(
        "clip", "slot", (F.col("p.body") + F.col("p.shadow") * 5).alias("pix"),
        F.col("p.body").alias("body_pix"))


@query("final_frame_verdicts", "A26 V6", with_views("""SELECT clip, players, measured,
    measured-slivers AS clear, slivers, shadow_only, smallest, CASE WHEN players=measured THEN
    'matches' WHEN players=measured-slivers THEN 'borderline' ELSE 'wrong' END AS verdict FROM (
    SELECT o.clip, o.count_last AS players,
    count(*) FILTER (pix>=20 AND body_px>=20) AS measured,
    count(*) FILTER (pix>=20 AND body_px>=20 AND body_px<60) AS slivers,
    count(*) FILTER (pix>=20 AND body_px<20) AS shadow_only,
    coalesce(min(body_px) FILTER (pix>=20 AND body_px>=20),0) AS smallest FROM old_picks o JOIN
    (SELECT *, body_px+shadow_px*5 AS pix FROM inshot) i ON i.match_id=o.match_id AND
    i.frame=o."end"-1 GROUP BY 1,2)"""))
def _(spark, sf):
    picks = session.cut_lineage(J.old_picks(spark, sf))
    pub = picks.select("clip", F.col("count_last").alias("players"))
    return R.final_frame_verdict(final_slots(spark, sf, picks), pub, sliver=60)


@query("one_sided_clips", "A27", with_views("""SELECT o.match_id, o.start, s.team_blue AS blue,
    s.team_red AS red FROM clips o JOIN (SELECT match_id, frame, count(*) FILTER (body_px>=140 AND
    slot<11) AS team_blue, count(*) FILTER (body_px>=140 AND slot>=11) AS team_red FROM inshot
    GROUP BY 1,2) s ON s.match_id=o.match_id AND s.frame=o."end"-1 WHERE least(team_blue,team_red)=0"""))
def _(spark, sf):
    from matchlens.operators import measure as M
    at = X.inshot(spark, sf).select(
        "match_id", (F.col("frame") + 1).alias("end"),
        M.count_over("body", 140, 0, 11).alias("blue"),
        M.count_over("body", 140, 11, 22).alias("red"))
    return J.clips(spark, sf).join(at, ["match_id", "end"]).where(
        F.least("blue", "red") == 0).select("match_id", "start", "blue", "red")


@query("reused_sources", "A27", with_views("""SELECT match_id, count(*) AS clips FROM pool
    GROUP BY 1 HAVING count(*)>1"""))
def _(spark, sf):
    return J.pool(spark, sf).groupBy("match_id").agg(F.count(F.lit(1)).alias("clips")).where(
        "clips > 1")


# --- rollouts ---
@query("rollout_rates", "A16", with_views("""SELECT level, count(*) AS n,
    avg(CASE WHEN "left">0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS left_rate,
    avg(CASE WHEN "right">0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS right_rate,
    avg(CASE WHEN natural_end THEN 1.0 ELSE 0.0 END)::DOUBLE AS natural_end_rate FROM rollouts
    GROUP BY 1"""))
def _(spark, sf):
    return R.rollout_rates(X.rollouts(spark, sf))


TAGS = "['a_add_attacker','b_remove_defender','c_ball_forward','d_no_change']"
VIEWS["tag_rates"] = f"""SELECT level AS item, tag, avg("left")::DOUBLE AS rate FROM (SELECT *,
    ({TAGS})[seed%4+1] AS tag FROM rollouts) GROUP BY 1,2"""


def tag_rates(spark, sf):
    return X.rollouts(spark, sf).withColumn("tag", F.expr(
        "element_at(array('a_add_attacker','b_remove_defender','c_ball_forward','d_no_change'),"
        " cast(seed % 4 + 1 as int))")).groupBy(F.col("level").alias("item"), "tag").agg(
        F.avg("left").alias("rate"))


@query("best_intervention", "A17", with_views("""SELECT item, tag AS best, rate FROM (SELECT *,
    row_number() OVER (PARTITION BY item ORDER BY rate DESC, tag DESC) AS k FROM tag_rates)
    WHERE k=1"""))
def _(spark, sf):
    return R.best_intervention(tag_rates(spark, sf), "item", "tag", "rate")


@query("responsibility", "A18", with_views("""SELECT item, tag, delta, row_number() OVER (PARTITION
    BY item ORDER BY delta DESC, tag) AS rank FROM (SELECT a.item, a.tag, CASE WHEN a.tag LIKE
    'right%' THEN -(b.rate-a.rate) ELSE b.rate-a.rate END AS delta FROM ablated a JOIN (SELECT
    level AS item, avg("left")::DOUBLE AS rate FROM rollouts GROUP BY 1) b USING (item))""",
    ablated="""SELECT level AS item, CASE WHEN seed%7<4 THEN 'left_' ELSE 'right_' END || (seed%7)
    AS tag, avg("left")::DOUBLE AS rate FROM rollouts GROUP BY 1,2"""))
def _(spark, sf):
    r = X.rollouts(spark, sf)
    ablated = r.groupBy(F.col("level").alias("item"), F.expr(
        "concat(case when seed % 7 < 4 then 'left_' else 'right_' end, seed % 7)").alias("tag")
    ).agg(F.avg("left").alias("rate"))
    base = r.groupBy(F.col("level").alias("item")).agg(F.avg("left").alias("rate"))
    return R.responsibility(ablated, base, "item", "tag", "rate")


@query("reproducibility_report", "A20", with_views("""SELECT count(*) AS clips,
    count(*) FILTER (match_id%9<>0) AS deterministic, count(*) FILTER (match_id%7<>0) AS
    render_invariant, count(DISTINCT digest) AS distinct_plays, sum(steps)::BIGINT*3 AS
    steps_replayed, count(*) FILTER (match_id%9=0 OR match_id%7=0) AS failures FROM digests""",
    digests=J.DIGEST_SQL, **J.COPIES))
def _(spark, sf):
    d = L.digest(J.copied_trace(spark, sf), J.DIGEST_COLUMNS)
    return R.reproducibility(d.select(
        F.col("digest").alias("play_sha"), "steps", F.expr("match_id % 9 <> 0")
        .alias("determinism_ok"), F.expr("match_id % 7 <> 0").alias("render_invariant_ok")))


@query("visibility_variants", "P22", with_views("""SELECT k.match_id, k.start, v.visible,
    count(*) FILTER (t.frame-k.start<v.visible*25) AS from_visible,
    count(*) FILTER (t.frame-k.start>=v.visible*25) AS from_hidden,
    max(t.frame) FILTER (t.frame-k.start<v.visible*25) AS last_visible FROM clips k JOIN trace t ON
    t.match_id=k.match_id AND t.frame>=k.start AND t.frame<k."end", (SELECT unnest(range(0,5)) AS
    visible) v GROUP BY 1,2,3"""))
def _(spark, sf):
    rows = R.clip_frames(J.clips(spark, sf), X.trace(spark, sf).select("match_id", "frame"))
    rows = rows.select("match_id", "start", "frame", F.explode(F.expr("sequence(0L, 4L)"))
                       .alias("visible"))
    shown = F.col("frame") - F.col("start") < F.col("visible") * C.FPS
    return rows.groupBy("match_id", "start", "visible").agg(
        F.count(F.when(shown, 1)).alias("from_visible"),
        F.count(F.when(~shown, 1)).alias("from_hidden"),
        F.max(F.when(shown, F.col("frame"))).alias("last_visible"))


