"""Event detectors and window placement."""
from __future__ import annotations

from pyspark.sql import functions as F

from matchlens import config as C
from matchlens.operators import events as E, windows as W
from matchlens.plans import fixtures as X
from matchlens.plans.oracle import VIEWS, with_views
from matchlens.plans.registry import query

U = X.UNIT

VIEWS["awards"] = """SELECT match_id, frame, game_mode AS mode, frame=0 AS opens FROM (
    SELECT *, lag(game_mode) OVER (PARTITION BY match_id ORDER BY frame) AS prev FROM trace)
    WHERE game_mode BETWEEN 1 AND 6 AND (frame=0 OR prev<>game_mode)"""
VIEWS["corners"] = """SELECT a.match_id, min(s.frame) AS anchor, a.frame AS award,
    a.frame+1 AS min_start FROM awards a JOIN lengths l USING (match_id)
    JOIN steps s ON s.match_id=a.match_id AND s.frame BETWEEN a.frame AND a.frame+223
    WHERE a.mode=4 AND s.step_next>2.0 AND a.frame+2<l.n GROUP BY a.match_id, a.frame"""
VIEWS["kickoffs"] = """SELECT r.match_id, min(s.frame) AS anchor, r.frame AS award,
    r.frame AS min_start, r.frame=0 AS opening FROM (
      SELECT *, lag(score_l) OVER w AS pl, lag(score_r) OVER w AS pr FROM trace
      WINDOW w AS (PARTITION BY match_id ORDER BY frame)) r
    JOIN lengths l USING (match_id) JOIN bodies b ON b.match_id=r.match_id AND b.frame=r.frame
    JOIN steps s ON s.match_id=r.match_id AND s.frame BETWEEN r.frame AND r.frame+223
    WHERE (r.frame=0 OR pl<>r.score_l OR pr<>r.score_r) AND b.left_home>=10
    AND b.right_home>=10 AND sqrt((r.ball_x*r.ball_x+r.ball_y*r.ball_y)::DOUBLE)<=30
    AND s.step_next>1.5 AND r.frame+2<l.n GROUP BY r.match_id, r.frame"""
VIEWS["held_runs"] = """SELECT match_id, owned_team AS team, min(frame) AS caught,
    max(frame) AS release, count(*) AS hold_frames,
    count(*) FILTER (ball_z BETWEEN 1150 AND 1750) AS hand_frames FROM (
    SELECT *, frame - row_number() OVER (PARTITION BY match_id, owned_team ORDER BY frame) AS isl
    FROM trace WHERE owned_player=0 AND owned_team>=0) GROUP BY match_id, owned_team, isl"""


def throws_sql(far: int, hold: str, travel: float) -> str:
    return f"""SELECT h.match_id, release AS anchor, release AS award, CAST(0 AS BIGINT) AS
        min_start, caught, team, hold_frames, hand_frames,
        round(sqrt(((e.ball_x-b.ball_x)*(e.ball_x-b.ball_x)+(e.ball_y-b.ball_y)*(e.ball_y-b.ball_y)
        )::DOUBLE)/1000.0::DOUBLE,6) AS travel,
        (SELECT max(z.ball_z) FROM trace z WHERE z.match_id=h.match_id AND z.frame>=h.release AND
        z.frame<h.release+{far})/1000.0::DOUBLE AS apex
        FROM held_runs h JOIN lengths l USING (match_id)
        JOIN trace b ON b.match_id=h.match_id AND b.frame=h.release
        JOIN trace e ON e.match_id=h.match_id AND e.frame=least(l.n-1, h.release+{far})
        WHERE {hold} AND release+1<l.n AND round(sqrt(((e.ball_x-b.ball_x)*(e.ball_x-b.ball_x)
        +(e.ball_y-b.ball_y)*(e.ball_y-b.ball_y))::DOUBLE)/1000.0::DOUBLE,6)>={travel}"""


VIEWS["throws"] = throws_sql(75, "hand_frames>=10", 0.2)


def headers_sql(gap: int, back: int, z_max: str, contested: int, z_min: int = 1350) -> str:
    return f"""SELECT t.match_id, t.frame AS anchor, t.frame AS award, CAST(0 AS BIGINT) AS
        min_start, ball_z/1000.0::DOUBLE AS z, near_n AS contested,
        apex_in/1000.0::DOUBLE AS apex_in, round(cosv,6) AS turn_cos,
        near_n*10 + apex_in/1000.0::DOUBLE AS score FROM (
        SELECT *, (ix*ox+iy*oy)/(sqrt((ix*ix+iy*iy)::DOUBLE)*sqrt((ox*ox+oy*oy)::DOUBLE)) AS cosv
        FROM (SELECT match_id, frame, ball_z,
          ball_x-lag(ball_x,{gap}) OVER w AS ix, ball_y-lag(ball_y,{gap}) OVER w AS iy,
          lead(ball_x,{gap}) OVER w-ball_x AS ox, lead(ball_y,{gap}) OVER w-ball_y AS oy,
          max(ball_z) OVER (PARTITION BY match_id ORDER BY frame ROWS {back} PRECEDING) AS apex_in
          FROM trace WINDOW w AS (PARTITION BY match_id ORDER BY frame))
        WHERE ix*ix+iy*iy>=400 AND ox*ox+oy*oy>=400 AND ball_z>={z_min} {z_max}) t
        JOIN bodies b ON b.match_id=t.match_id AND b.frame=t.frame
        WHERE near2<=35*35 AND near_n>={contested} AND cosv<=0.35"""


VIEWS["headers"] = headers_sql(10, 45, "AND ball_z<=2900", 1)


# The views' ball moves slowly off the mark, so a delivery starts at a lower speed here.
TUNED = {"corner": {"quiet": 0.002}, "header": {"gap": 10}}


def events(tr, kind):
    return E.detect(tr, [kind], unit=U, options=TUNED)


@query("restart_awards", "W2", with_views("SELECT * FROM awards"))
def _(spark, sf):
    return E.awards(X.trace(spark, sf))


@query("corner_deliveries", "W3", with_views("SELECT * FROM corners"))
def _(spark, sf):
    return E.deliveries(X.trace(spark, sf), unit=U, **TUNED["corner"])


@query("kickoff_restarts", "W4", with_views("SELECT * FROM kickoffs"))
def _(spark, sf):
    return E.kickoffs(X.trace(spark, sf), unit=U)


@query("keeper_throws", "W5", with_views("SELECT * FROM throws"))
def _(spark, sf):
    return E.keeper_holds(X.trace(spark, sf), unit=U)


@query("keeper_throws_early", "W5", with_views(throws_sql(30, "hand_frames>=4", 0.2)))
def _(spark, sf):
    return E.keeper_holds(X.trace(spark, sf), hold_min=4, ahead=30, unit=U)


@query("keeper_holds_by_length", "W5", with_views(throws_sql(13, "hold_frames>=3", 0.025)))
def _(spark, sf):
    return E.keeper_holds(X.trace(spark, sf), hold_min=3, ahead=12, from_release=1,
                          in_hand=False, travel_min=0.025, unit=U)


@query("header_turns", "W7", with_views("SELECT * FROM headers"))
def _(spark, sf):
    return E.headers(X.trace(spark, sf), gap=10, unit=U)


@query("header_turns_short_gap", "W7", with_views(
    headers_sql(3, 18, "", 1, 1250).replace(">=400", ">=25")))
def _(spark, sf):
    return E.headers(X.trace(spark, sf), gap=3, look_back=18, z_min=1.25, z_max=None,
                     min_step=0.005, unit=U)


@query("corner_quality", "W8", with_views("""SELECT match_id, award, delivery AS anchor,
    award+1 AS min_start, apex, contested, contested*10+apex AS score FROM (
    SELECT d.match_id, d.award, d.delivery,
      (SELECT max(ball_z) FROM trace z WHERE z.match_id=d.match_id AND z.frame>=d.delivery AND
       z.frame<least(d.n-1,d.delivery+45))/1000.0::DOUBLE AS apex,
      coalesce((SELECT max(near_n) FROM (SELECT near_n FROM lows z WHERE z.match_id=d.match_id AND
       z.frame>=d.delivery+5 AND z.frame<least(d.n-1,d.delivery+45) ORDER BY z.frame LIMIT 6)),0)
       AS contested FROM first_move d)""",
    first_move="""SELECT a.match_id, a.frame AS award, min(s.frame) AS delivery, any_value(l.n)
      AS n FROM awards a JOIN lengths l USING (match_id) JOIN steps s ON s.match_id=a.match_id
      AND s.frame BETWEEN a.frame AND a.frame+88 AND s.step_next>2.0
      WHERE a.mode=4 AND a.frame>0 GROUP BY 1,2""",
    lows="""SELECT t.match_id, t.frame, near_n FROM trace t JOIN bodies b USING (match_id, frame)
      WHERE ball_z<1500 AND abs(ball_x)>820"""))
def _(spark, sf):
    return E.corner_quality(X.trace(spark, sf), unit=U, quiet=0.002)


def freekick_sql(window: int, full: bool) -> str:
    t, d, lo, hi = (0.04, 0.88, 0.06, 0.34) if full else (0.05, 0.85, 0.08, 0.32)
    pts = ("(CASE WHEN attacking THEN 80 ELSE 0 END)+(CASE WHEN in_range THEN 30 ELSE 0 END)"
           "+apex+(CASE WHEN central THEN 15 ELSE 0 END)+contest*5" if full else
           "(CASE WHEN attacking THEN 60 ELSE 0 END)+(CASE WHEN in_range THEN 25 ELSE 0 END)+apex")
    return with_views(f"""SELECT *, round({pts},6) AS score FROM (SELECT match_id, award, towards,
      dist_to_goal, reach, apex, towards>{t} AND reach>{d} AS attacking,
      dist_to_goal BETWEEN {lo} AND {hi} AS in_range, abs(y)<220 AS central, contest FROM (
      SELECT a.match_id, a.frame AS award, any_value(o.ball_y) AS y,
        1.0::DOUBLE-abs(any_value(o.ball_x))/1000.0::DOUBLE AS dist_to_goal,
        (CASE WHEN any_value(o.ball_x)>=0 THEN max(x.ball_x) FILTER (seg)-any_value(o.ball_x)
          ELSE any_value(o.ball_x)-min(x.ball_x) FILTER (seg) END)/1000.0::DOUBLE AS towards,
        max(abs(x.ball_x)) FILTER (seg)/1000.0::DOUBLE AS reach,
        max(x.ball_z) FILTER (seg)/1000.0::DOUBLE AS apex,
        coalesce(max(near_n) FILTER (seg AND f BETWEEN 8 AND 29),0) AS contest,
        max(x.step) FILTER (f BETWEEN 2 AND {window - 1}) AS jump,
        count(*) FILTER (f BETWEEN 1 AND {window - 1}) AS ahead
      FROM awards a JOIN trace o ON o.match_id=a.match_id AND o.frame=a.frame
      JOIN (SELECT s.*, b.near_n, l.n FROM steps s JOIN bodies b USING (match_id, frame)
        JOIN lengths l USING (match_id)) x ON x.match_id=a.match_id
        AND x.frame BETWEEN a.frame AND a.frame+{max(window, 35)},
        LATERAL (SELECT x.frame-a.frame AS f, x.frame-a.frame<35 AND x.frame<x.n-1 AS seg)
      WHERE a.mode=3 GROUP BY a.match_id, a.frame) WHERE ahead>=3 AND jump<350)""")


@query("freekick_quality", "W9", freekick_sql(60, False))
def _(spark, sf):
    return E.freekick_quality(X.trace(spark, sf), window=60, unit=U)


@query("freekick_quality_full", "W9", freekick_sql(80, True))
def _(spark, sf):
    return E.freekick_quality(X.trace(spark, sf), window=80, scoring="full", unit=U)


VIEWS["goals"] = """SELECT match_id, frame, pl AS before_l, pr AS before_r, score_l AS after_l,
    score_r AS after_r, px/1000.0::DOUBLE AS ball_x, py/1000.0::DOUBLE AS ball_y,
    pz/1000.0::DOUBLE AS ball_z, greatest(0,frame-100) AS clip_start, frame+25 AS clip_end FROM (
    SELECT *, lag(score_l) OVER w AS pl, lag(score_r) OVER w AS pr, lag(ball_x) OVER w AS px,
    lag(ball_y) OVER w AS py, lag(ball_z) OVER w AS pz FROM trace
    WINDOW w AS (PARTITION BY match_id ORDER BY frame)) WHERE pl<>score_l OR pr<>score_r"""


@query("goal_clips", "W10", with_views("SELECT * FROM goals"))
def _(spark, sf):
    return E.goals(X.trace(spark, sf), unit=U)


@query("headers_after_restart", "J17", with_views("""SELECT a.*,
    sqrt(((e.ball_x-o.ball_x)*(e.ball_x-o.ball_x)+(e.ball_y-o.ball_y)*(e.ball_y-o.ball_y)
    )::DOUBLE)/1000.0::DOUBLE AS travel, coalesce((SELECT max(z.ball_z) FROM trace z WHERE
    z.match_id=a.match_id AND z.frame>=a.frame AND z.frame<least(n-1,a.frame+90)),0)
    /1000.0::DOUBLE AS apex
    FROM (SELECT a.match_id, a.frame, a.mode,
    count(h.anchor) AS followers, min(h.anchor) AS first_follower FROM awards a
    LEFT JOIN headers h ON h.match_id=a.match_id AND h.anchor>a.frame AND h.anchor<=a.frame+90
    GROUP BY 1,2,3) a JOIN lengths l USING (match_id)
    JOIN trace o ON o.match_id=a.match_id AND o.frame=a.frame
    JOIN trace e ON e.match_id=a.match_id AND e.frame=least(l.n-1,a.frame+90)"""))
def _(spark, sf):
    tr = X.trace(spark, sf)
    hd = E.headers(tr, gap=10, unit=U).select("match_id", F.col("anchor").alias("frame"))
    return E.followed_by(E.after_awards(tr, 90, unit=U), hd, 90)


@query("sweep_summary", "A22", with_views("""SELECT match_id,
    count(*) FILTER (game_mode=4 AND pm<>4) AS corners,
    count(*) FILTER (game_mode=3 AND pm<>3) AS free_kicks,
    count(*) FILTER (owned_player=0 AND owned_team>=0) AS keeper_frames,
    count(*) FILTER (score_l+score_r>ps) AS goals FROM (
    SELECT *, lag(game_mode) OVER w AS pm, lag(score_l+score_r) OVER w AS ps FROM trace
    WINDOW w AS (PARTITION BY match_id ORDER BY frame)) GROUP BY 1"""))
def _(spark, sf):
    return E.sweep_summary(X.trace(spark, sf))


def placed_sql(source: str, lead: int, snap: int = 1) -> str:
    return f"""SELECT e.match_id, e.anchor, e.award, b+o AS start, b+o+125 AS "end" FROM (
        SELECT *, CAST(ceil(greatest(anchor-{lead}, min_start)/{snap}::DOUBLE)*{snap} AS BIGINT)
        AS b FROM {source}) e JOIN lengths l USING (match_id),
        (SELECT unnest(range(0,51,5)) AS o) WHERE o<=least(50, greatest(anchor-b,0)) AND b+o>=0
        AND b+o+125<=l.n AND b+o<=anchor"""


@query("placed_restart_windows", "W11 F10", with_views(" UNION ALL ".join(
    f"SELECT '{k}' AS kind, * FROM ({placed_sql(v, C.LEAD[k])})"
    for k, v in (("corner", "corners"), ("kickoff", "kickoffs"), ("gk_throw", "throws")))))
def _(spark, sf):
    tr, n = X.trace(spark, sf), X.lengths(spark, sf)
    out = None
    for k in ("corner", "kickoff", "gk_throw"):
        w = E.place(events(tr, k), n, k).select(
            F.lit(k).alias("kind"), "match_id", "anchor", "award", "start", "end")
        out = w if out is None else out.unionByName(w)
    return out


@query("placed_on_probe_grid", "W11", with_views(placed_sql("corners", 10, 4)))
def _(spark, sf):
    return E.place(events(X.trace(spark, sf), "corner"), X.lengths(spark, sf), "corner",
                   snap=4).select("match_id", "anchor", "award", "start", "end")


@query("detected_situations", "U1", with_views(" UNION ALL ".join(
    f"SELECT '{k}' AS kind, match_id, anchor, award, min_start FROM {v}" for k, v in
    (("corner", "corners"), ("kickoff", "kickoffs"), ("gk_throw", "throws"),
     ("header", "headers")))))
def _(spark, sf):
    return E.detect(X.trace(spark, sf), list(E.DETECTORS), unit=U, options=TUNED)


# Restart windows measured and gated like open play, each kind with its own bands.
VIEWS["restart_windows"] = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, * FROM ({placed_sql(v, C.LEAD[k])})"
    for k, v in (("corner", "corners"), ("kickoff", "kickoffs"), ("gk_throw", "throws")))
VIEWS["restart_features"] = """SELECT r.kind, r.match_id, r.anchor, r.start, r."end",
    avg(CASE WHEN t.owned_team=-1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS loose,
    max(t.ball_z)/1000.0::DOUBLE AS apex,
    round(sum(t.step) FILTER (t.frame>r.start)/1000.0::DOUBLE,6) AS path,
    max(t.step) FILTER (t.frame>r.start) AS top, bool_or(t.goal_touch) AS touch,
    bool_or(t.award AND t.frame>r.start) AS inside, round(quantile_cont(b.near_m,0.5),6) AS dnear
    FROM restart_windows r JOIN steps t ON t.match_id=r.match_id AND t.frame>=r.start AND
    t.frame<r."end" JOIN bodies b ON b.match_id=t.match_id AND b.frame=t.frame
    GROUP BY 1,2,3,4,5"""
VIEWS["bands"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}',{v[0]},{v[1]},{v[2]},{v[3]},{v[4]})" for k, v in C.ENGAGEMENT.items()) + \
    ") v(kind,lo_max,ap_max,dn_max,pa_min,pa_max)"
VIEWS["restart_candidates"] = """SELECT kind, match_id, anchor, start, "end", loose, apex, dnear,
    path, round(loose*2.0+apex/3.2+dnear/4.0,4) AS coh FROM restart_features
    JOIN bands USING (kind) WHERE top<350 AND NOT touch AND NOT inside
    AND (kind='kickoff' OR start>=25) AND loose<=lo_max AND apex<=ap_max AND dnear<=dn_max
    AND path BETWEEN pa_min AND pa_max"""


def restart_candidates(spark, sf):
    tr = X.trace(spark, sf)
    ev = E.detect(tr, ["corner", "kickoff", "gk_throw"], unit=U, options=TUNED)
    w = W.slides(tr, ev, X.lengths(spark, sf), unit=U)
    legal = (F.col("kind") == "kickoff") | (F.col("start") >= C.SKIP_START)
    return w.where(legal & W.continuous() & W.no_restart() & W.engaged(F.col("kind"))).select(
        "kind", "match_id", "anchor", "start", "end", "loose", "apex", "dnear", "path",
        W.coherence().alias("coh"))


@query("restart_candidates", "F3 F4 F10 W11", with_views("SELECT * FROM restart_candidates"))
def _(spark, sf):
    return restart_candidates(spark, sf)


