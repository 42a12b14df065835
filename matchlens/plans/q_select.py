"""Further gates, thinning, budgets, quotas and joint selection."""
from __future__ import annotations

from pyspark.sql import functions as F

from matchlens import config as C, session
from matchlens.operators import events as E, gates as Ga, measure as M, select as S, windows as W
from matchlens.plans import fixtures as X, q_joins as J
from matchlens.plans.oracle import VIEWS, with_views
from matchlens.plans.q_events import events, restart_candidates, throws_sql
from matchlens.plans.q_grading import cell_sql
from matchlens.plans.q_windows import open_windows
from matchlens.plans.registry import query

U = X.UNIT

# --- gates ---
VIEWS["tumbling"] = """SELECT match_id, frame//50*50 AS start, frame//50*50+50 AS "end",
    round(sum(step) FILTER (frame%50<>0)/1000.0::DOUBLE,6) AS path,
    max(step) FILTER (frame%50<>0)/1000.0::DOUBLE AS max_step, max(abs(ball_x))/1000.0::DOUBLE AS max_x,
    count(*) FILTER (pl<>score_l OR pr<>score_r) AS goals FROM (SELECT *, lag(score_l) OVER w AS pl,
    lag(score_r) OVER w AS pr FROM steps WINDOW w AS (PARTITION BY match_id ORDER BY frame))
    GROUP BY 1,2,3 HAVING count(*)=50"""


@query("movement_band", "F5", with_views("""SELECT match_id, start, "end", path, max_step, max_x,
    goals FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY start) AS k FROM tumbling
    WHERE goals=0 AND path BETWEEN 0.1 AND 0.95) WHERE k<=3"""))
def _(spark, sf):
    return Ga.movement_band(Ga.tumbling(X.trace(spark, sf), 50, unit=U), lo=0.1)


@query("clean_drills", "F5", with_views("""SELECT * FROM tumbling WHERE max_step<0.35 AND
    max_x<=1.0 AND path>0.12 AND path<4.0"""))
def _(spark, sf):
    return Ga.clean_drill(Ga.tumbling(X.trace(spark, sf), 50, unit=U))


VIEWS["scan_windows"] = VIEWS["windows"].replace("s.frame<l.n-125", "s.frame<=l.n-125")
VIEWS["scan"] = """SELECT w.*, max_step<0.35 AND NOT goal_touch AS is_continuous,
    NOT award_inside AS no_restart, loose<=0.55 AND apex<=2.6 AND dnear<=3.5 AND
    path BETWEEN 0.33 AND 0.95 AS is_engaged, x.changes, x.travel, x.ymax, x.same_score
    FROM scan_windows w JOIN (SELECT s.match_id, s.start,
    (max(ball_x)-min(ball_x))/1000.0::DOUBLE AS travel, max(abs(ball_y))/1000.0::DOUBLE AS ymax,
    arg_min(score_l,frame)=arg_max(score_l,frame) AND arg_min(score_r,frame)=arg_max(score_r,frame)
    AS same_score, count(*) FILTER (owned_team>=0 AND pf>=s.start AND po<>owned_team) AS changes
    FROM scan_windows s JOIN (SELECT *,
      last_value(CASE WHEN owned_team>=0 THEN owned_team END IGNORE NULLS) OVER v AS po,
      last_value(CASE WHEN owned_team>=0 THEN frame END IGNORE NULLS) OVER v AS pf FROM trace
      WINDOW v AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND
      1 PRECEDING)) t ON t.match_id=s.match_id AND t.frame>=s.start AND t.frame<s."end"
    GROUP BY 1,2) x ON x.match_id=w.match_id AND x.start=w.start"""


def scan(spark, sf):
    return W.sliding(X.trace(spark, sf), last_start=True, unit=U, watch=True).select(
        "*", W.continuous().alias("is_continuous"), W.no_restart().alias("no_restart"),
        W.engaged("open").alias("is_engaged"))


@query("scan_funnel", "F11 F8 W1", with_views("""SELECT unnest([0,1,2,3,4])::BIGINT AS step, unnest([
    'windows','continuous','no_restart','same_score','engaged']) AS gate, unnest([count(*),
    count(*) FILTER (is_continuous), count(*) FILTER (is_continuous AND no_restart),
    count(*) FILTER (is_continuous AND no_restart AND same_score),
    count(*) FILTER (is_continuous AND no_restart AND same_score AND is_engaged)]) AS "left"
    FROM scan"""))
def _(spark, sf):
    return Ga.funnel(scan(spark, sf), [
        ("continuous", "is_continuous"), ("no_restart", "no_restart"),
        ("same_score", "same_score"), ("engaged", "is_engaged")])


@query("watchable_windows", "F6 F8", with_views("""SELECT match_id, start, changes, travel, ymax
    FROM scan WHERE is_continuous AND no_restart AND same_score AND is_engaged AND changes>=3 AND
    travel>=0.2 AND ymax<=0.38"""))
def _(spark, sf):
    s = scan(spark, sf).where("is_continuous and no_restart and same_score and is_engaged")
    return Ga.watchable(s, travel=0.2).select("match_id", "start", "changes", "travel", "ymax")


VIEWS["corner_windows"] = """SELECT * FROM (SELECT k.match_id, greatest(k.anchor-10,k.min_start) AS
    start, greatest(k.anchor-10,k.min_start)+125 AS "end" FROM corners k) JOIN lengths USING (match_id)
    WHERE "end"<=n"""


def corner_windows(spark, sf):
    ev = events(X.trace(spark, sf), "corner")
    return E.place(ev, X.lengths(spark, sf), "corner", stride=1000).select("match_id", "start",
                                                                           "end")


@query("corner_third_gate", "F7", with_views("""SELECT c.match_id, c.start, c."end",
    min(abs(ball_x))/1000.0::DOUBLE AS min_x FROM corner_windows c JOIN trace t ON t.match_id=c.match_id AND
    t.frame>=c.start AND t.frame<c."end" GROUP BY 1,2,3 HAVING min(abs(ball_x))>=500 AND
    min(sign(ball_x))=max(sign(ball_x))"""))
def _(spark, sf):
    return Ga.in_own_third(corner_windows(spark, sf), X.trace(spark, sf), unit=U, min_x=0.50)


@query("longest_slide", "W12", with_views("""SELECT c.match_id, c.start, c."end", coalesce(least(50,
    min(CASE WHEN s.bad THEN s.frame END)-c."end", max(s.frame)+1-c."end"),0) AS max_slide
    FROM corner_windows c LEFT JOIN (SELECT *, coalesce(step>=350,false) OR goal_touch OR
    abs(ball_x)<500 OR coalesce(sign(ball_x)<>sign(lag(ball_x) OVER (PARTITION BY match_id ORDER BY
    frame)),false) OR award AS bad FROM steps) s ON s.match_id=c.match_id AND s.frame>=c."end" AND
    s.frame<c."end"+50 GROUP BY 1,2,3"""))
def _(spark, sf):
    return Ga.longest_slide(corner_windows(spark, sf), X.trace(spark, sf), unit=U, min_x=0.50)


VIEWS["balls"] = """SELECT match_id, frame, greatest(0,abs((frame+31*match_id)%200-100)-60) AS
    ball_px, CASE WHEN match_id%4<>0 THEN greatest(0,abs((frame+17*match_id)%150-75)-10) END AS
    plate_px FROM frames"""


def balls(spark, sf):
    return X.frames(spark, sf).select("match_id", "frame", F.expr(
        "greatest(0L, abs((frame + 31 * match_id) % 200 - 100) - 60)").alias("ball_px"))


def plates(spark, sf):
    # every fourth match has no plate evidence: that is the case the status reports on
    return X.frames(spark, sf).where("match_id % 4 <> 0").select("match_id", "frame", F.expr(
        "greatest(0L, abs((frame + 17 * match_id) % 150 - 75) - 10)").alias("plate_px"))


@query("best_slide", "W13", with_views("""SELECT c.match_id, c.start, c."end", b.o AS offset,
    b.worst FROM corner_windows c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY match_id,
    start ORDER BY worst DESC, o) AS k FROM (SELECT c.match_id, c.start, m.frame-c.start AS o,
    m.worst FROM corner_windows c JOIN (SELECT match_id, frame, min(people) OVER v AS worst,
    count(*) OVER v AS n, ball_px>=3 AND last_value(ball_px) OVER v>=3 AS ok FROM shown JOIN balls
    USING (match_id, frame) WINDOW v AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT
    ROW AND 124 FOLLOWING)) m ON m.match_id=c.match_id AND m.frame BETWEEN c.start AND c.start+50
    WHERE m.n=125 AND m.ok)) b ON b.match_id=c.match_id AND b.start=c.start AND b.k=1"""))
def _(spark, sf):
    ball = balls(spark, sf).select("match_id", "frame", (F.col("ball_px") >= 3).alias("has_ball"))
    return Ga.best_slide(corner_windows(spark, sf), M.people(X.inshot(spark, sf)), ball)


@query("ballless_ends", "W26", with_views("""SELECT match_id, start, "end", why, lo, hi FROM (
    SELECT match_id, start, "end", 'opening' AS why, start AS lo, coalesce(f,"end")-1 AS hi,
    f IS NULL OR f-start>=8 AS hit FROM fe UNION ALL SELECT match_id, start, "end", 'ending',
    "end"-1, "end"-1, e<3 FROM fe) WHERE hit""", fe="""SELECT c.match_id, c.start, c."end",
    min(b.frame) FILTER (ball_px>=3) AS f, arg_max(ball_px,b.frame) AS e FROM corner_windows c
    JOIN balls b ON b.match_id=c.match_id AND b.frame>=c.start AND b.frame<c."end"
    GROUP BY 1,2,3"""))
def _(spark, sf):
    return Ga.ballless_ends(corner_windows(spark, sf), balls(spark, sf))


@query("ballless_status", "W26", with_views("""SELECT match_id, start, "end", gaps, status,
    CASE WHEN status='rejected' THEN lo END AS lo, CASE WHEN status='rejected' THEN hi END AS hi
    FROM (SELECT *, CASE WHEN gaps=0 THEN 'clean' WHEN ev=0 THEN 'needs evidence' WHEN lo IS NULL
    THEN 'occluded' ELSE 'rejected' END AS status FROM (SELECT c.match_id, c.start, c."end",
    count(*) FILTER (ball_px<3) AS gaps, count(plate_px) AS ev, min(b.frame) FILTER (plate_px<3) AS
    lo, max(b.frame) FILTER (plate_px<3) AS hi FROM corner_windows c JOIN balls b ON
    b.match_id=c.match_id AND b.frame>=c.start AND b.frame<c."end" GROUP BY 1,2,3))"""))
def _(spark, sf):
    return Ga.ballless_status(corner_windows(spark, sf), balls(spark, sf), plates(spark, sf))


WANTS = list(range(8, 17))
VIEWS["exact"] = """SELECT match_id, start, "end", want, near_first, near_last, travel, path, spread,
    round(near_last*3+near_first*2+path*6-spread*8,6) AS score FROM (
    SELECT w.match_id, w.start, w."end", e.people AS want, a.near_wide AS near_first,
    z.near_wide AS near_last, w.path, sqrt(((t1.ball_x-t0.ball_x)*(t1.ball_x-t0.ball_x)+
    (t1.ball_y-t0.ball_y)*(t1.ball_y-t0.ball_y))::DOUBLE)/1000.0::DOUBLE AS travel, e.spread
    FROM scored w JOIN bodies a ON a.match_id=w.match_id AND a.frame=w.start
    JOIN bodies z ON z.match_id=w.match_id AND z.frame=w."end"-1
    JOIN trace t0 ON t0.match_id=w.match_id AND t0.frame=w.start
    JOIN trace t1 ON t1.match_id=w.match_id AND t1.frame=w."end"-1
    JOIN (SELECT p.match_id, p.frame, count(*) AS people, round(sum(sqrt(((x-ball_x)*(x-ball_x)+
      (y-ball_y)*(y-ball_y))::DOUBLE))/count(*)/1000.0::DOUBLE,6) AS spread FROM players p JOIN inshot i ON
      i.match_id=p.match_id AND i.frame=p.frame AND i.slot=p.team*11+p.slot WHERE body_px>=25
      GROUP BY 1,2) e ON e.match_id=w.match_id AND e.frame=w."end"-1
    WHERE is_continuous AND no_restart AND e.people BETWEEN 8 AND 16)
    WHERE near_first>=CASE WHEN want<=6 THEN 2 ELSE 1 END AND near_last>=CASE WHEN want<=6 THEN 2
    ELSE 1 END AND travel>=0.1""".replace("ELSE 1 END", "ELSE 3 END")


def exact(spark, sf):
    tr = X.trace(spark, sf)
    w = W.sliding(tr, unit=U, near=False).where(W.continuous() & W.no_restart())
    return Ga.exact_count(w.select("match_id", "start", "end", "path"), tr, X.inshot(spark, sf),
                          WANTS, unit=U)


@query("exact_count_windows", "F9 P23", with_views("SELECT * FROM exact"))
def _(spark, sf):
    return exact(spark, sf)


# --- greedy choices ---
@query("scarce_levels", "T8", with_views("""SELECT level, match_id, start, "end", score FROM (
    SELECT x.*, w.took FROM order1 x JOIN walk w ON w.r=x.r) WHERE took""",
    best1="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY want, match_id ORDER BY
      score DESC, start) AS k FROM exact) WHERE k=1""",
    order1="""SELECT want AS level, match_id, start, "end", score, row_number() OVER (ORDER BY want
      DESC, score DESC, match_id, start) AS r FROM best1""",
    walk="""SELECT r, [match_id] AS used, [level] AS lv, true AS took FROM order1 WHERE r=1
      UNION ALL SELECT x.r, CASE WHEN NOT list_contains(w.used,x.match_id) AND
      len(list_filter(w.lv, lambda l: l=x.level))<3 THEN list_append(w.used,x.match_id) ELSE w.used
      END, CASE WHEN NOT list_contains(w.used,x.match_id) AND len(list_filter(w.lv,
      lambda l: l=x.level))<3 THEN list_append(w.lv,x.level) ELSE w.lv END,
      NOT list_contains(w.used,x.match_id) AND len(list_filter(w.lv, lambda l: l=x.level))<3
      FROM walk w JOIN order1 x ON x.r=w.r+1"""))
def _(spark, sf):
    return S.by_scarce_level(exact(spark, sf).withColumnRenamed("want", "level"), WANTS, 3)


VIEWS["scored_events"] = f"""SELECT kind, e.match_id, anchor AS start, score, shape FROM (
    SELECT 'header' AS kind, match_id, anchor, score FROM headers UNION ALL
    SELECT 'gk_throw', match_id, anchor, round(travel*100+hand_frames,6) FROM
    ({throws_sql(30, 'hand_frames>=4', 0.2)})) e JOIN named USING (match_id)"""


def scored_events(spark, sf):
    tr = X.trace(spark, sf)
    hd = E.headers(tr, gap=10, unit=U).select(F.lit("header").alias("kind"), "match_id",
                                              F.col("anchor").alias("start"), "score")
    gk = E.keeper_holds(tr, hold_min=4, ahead=30, unit=U).select(
        F.lit("gk_throw").alias("kind"), "match_id", F.col("anchor").alias("start"),
        F.round(F.col("travel") * 100 + F.col("hand_frames"), 6).alias("score"))
    return X.named(hd.unionByName(gk)).select("kind", "match_id", "start", "score", "shape")


@query("quota_picks", "T7", with_views("""SELECT kind, match_id, start, score, shape FROM (SELECT *,
    row_number() OVER (PARTITION BY kind ORDER BY score DESC, match_id, start) AS c FROM (SELECT *,
    row_number() OVER (PARTITION BY kind, shape ORDER BY score DESC, match_id, start) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY kind, match_id ORDER BY score DESC, start) AS a
    FROM scored_events) WHERE a=1) WHERE b<=2) WHERE c<=12"""))
def _(spark, sf):
    return S.quota_pick(scored_events(spark, sf), 12, per_shape=2)


@query("distinct_events", "W18", with_views("""SELECT x.match_id, x.frame, x.score FROM ranked x JOIN
    walk w ON w.match_id=x.match_id AND w.r=x.r WHERE w.took""",
    ranked="""SELECT match_id, anchor AS frame, score, row_number() OVER (PARTITION BY match_id
      ORDER BY score DESC, anchor) AS r FROM headers""",
    walk="""SELECT match_id, r, [frame] AS kept, true AS took FROM ranked WHERE r=1 UNION ALL
      SELECT x.match_id, x.r, CASE WHEN len(list_filter(w.kept, lambda k: abs(k-x.frame)<40))=0
      THEN list_append(w.kept, x.frame) ELSE w.kept END,
      len(list_filter(w.kept, lambda k: abs(k-x.frame)<40))=0 FROM walk w JOIN ranked x ON
      x.match_id=w.match_id AND x.r=w.r+1"""))
def _(spark, sf):
    ev = E.headers(X.trace(spark, sf), gap=10, unit=U).select(
        "match_id", F.col("anchor").alias("frame"), "score")
    return S.drop_close(ev, 40)


@query("evenly_thinned_ends", "T2", with_views("""SELECT match_id, frame FROM (SELECT match_id, frame,
    row_number() OVER (PARTITION BY match_id ORDER BY frame)-1 AS k, count(*) OVER (PARTITION BY
    match_id) AS n FROM (SELECT match_id, "end"-1 AS frame FROM open_windows)) WHERE n<=7 OR
    list_contains(list_transform(range(0,7), lambda i: (i*n)//7), k)"""))
def _(spark, sf):
    ends = open_windows(spark, sf).select("match_id", (F.col("end") - 1).alias("frame"))
    return S.thin_evenly(ends, 7)


# --- pool of all kinds ---
VIEWS["candidates"] = """SELECT 'open' AS kind, match_id, start AS anchor, start, "end", loose, apex,
    dnear, path, coh FROM open_windows UNION ALL SELECT kind, match_id, anchor, start, "end", loose,
    apex, dnear, path, coh FROM restart_candidates"""
VIEWS["kpool"] = f"""SELECT kind, match_id, anchor, start, "end", coh, startown, level, px, py,
    crow || ccol AS cell FROM (SELECT w.*, p.owner AS startown, z.people AS level, b.px, b.py,
    {cell_sql(prefix='c')} FROM candidates w
    JOIN possession p ON p.match_id=w.match_id AND p.frame=w.start AND p.owner>=0
    JOIN shown a ON a.match_id=w.match_id AND a.frame=w.start
    JOIN shown z ON z.match_id=w.match_id AND z.frame=w."end"-1
    JOIN ballpix b ON b.match_id=w.match_id AND b.frame=w."end"-1
    WHERE NOT EXISTS (SELECT 1 FROM absent s WHERE s.match_id=w.match_id AND
      (w.start BETWEEN lo AND hi OR w."end"-1 BETWEEN lo AND hi)))"""


def candidates(spark, sf):
    op = open_windows(spark, sf).select(
        F.lit("open").alias("kind"), "match_id", F.col("start").alias("anchor"), "start", "end",
        "loose", "apex", "dnear", "path", "coh")
    return op.unionByName(restart_candidates(spark, sf))


KPOOL = ["kind", "match_id", "anchor", "start", "end", "coh", "startown", "level", "px", "py",
         "cell"]


def kpool(spark, sf):
    return J.pool(spark, sf, candidates(spark, sf)).withColumnRenamed(
        "count_last", "level").select(*KPOOL)


def shared_pool(spark, sf):
    """The pool as a written table, for queries that read it more than once."""
    return session.cut_lineage(kpool(spark, sf))


@query("candidates_by_kind", "T6", with_views(
    "SELECT kind, count(*) AS windows, count(DISTINCT match_id) AS matches FROM candidates GROUP BY 1"))
def _(spark, sf):
    return candidates(spark, sf).groupBy("kind").agg(
        F.count(F.lit(1)).alias("windows"), F.countDistinct("match_id").alias("matches"))


@query("full_pool", "J2 J3 J4 J7 T6", with_views("SELECT * FROM kpool"))
def _(spark, sf):
    return kpool(spark, sf)


@query("scarcest_class", "T4", with_views("""SELECT kind, match_id, start, "end", coh FROM (SELECT *,
    list_position(['corner','gk_throw','kickoff','open'],kind) AS r, min(list_position(
    ['corner','gk_throw','kickoff','open'],kind)) OVER (PARTITION BY match_id) AS m FROM candidates)
    WHERE r=m"""))
def _(spark, sf):
    return S.scarcest_class(candidates(spark, sf)).select("kind", "match_id", "start", "end",
                                                          "coh")


VIEWS["classed"] = """SELECT * FROM (SELECT *, list_position(['corner','gk_throw','kickoff','open'],
    kind) AS cr, min(list_position(['corner','gk_throw','kickoff','open'],kind)) OVER (PARTITION BY
    match_id) AS cm FROM candidates) WHERE cr=cm"""


@query("probe_plan", "T5 P19", with_views("""SELECT position, kind, match_id, coh, windows,
    ([0.0,-12.0,12.0,-20.0,20.0,-6.0,6.0,-24.0,24.0,-16.0,16.0])[position%11+1]::DOUBLE AS offset_x,
    ([0.0,6.0,-5.0,10.0,-9.0,3.0,-2.0,8.0,-7.0])[position%9+1]::DOUBLE AS offset_y FROM (SELECT *,
    row_number() OVER (ORDER BY list_position(['corner','gk_throw','kickoff','open'],kind), r)-1 AS
    position FROM (SELECT kind, match_id, min(coh) AS coh, count(*) AS windows, row_number() OVER
    (PARTITION BY kind ORDER BY min(coh), match_id) AS r FROM classed WHERE kind IN ('corner',
    'gk_throw') OR "end"<=1900 GROUP BY 1,2) WHERE r<=CASE kind WHEN 'corner' THEN 999 WHEN 'gk_throw'
    THEN 18 WHEN 'kickoff' THEN 16 ELSE 26 END)"""))
def _(spark, sf):
    return S.probe_plan(S.scarcest_class(candidates(spark, sf)))


@query("incremental_plan", "T5", with_views("""SELECT coalesce(p.match_id,o.match_id) AS match_id,
    coalesce(kind,'open') AS kind, rank, o.match_id IS NOT NULL AS kept FROM (
    SELECT match_id, 'corner' AS kind, r AS rank FROM p1 UNION ALL SELECT match_id, 'gk_throw', r
    FROM p2 UNION ALL SELECT match_id, 'kickoff', r FROM p3 UNION ALL SELECT match_id, 'open', r
    FROM p4) p FULL JOIN (SELECT DISTINCT match_id FROM awards WHERE mode=3) o
    ON o.match_id=p.match_id""",
    can="""SELECT n.*, match_id IN (SELECT match_id FROM corners) AS c1, match_id IN (SELECT match_id
      FROM throws) AS c2, match_id IN (SELECT match_id FROM kickoffs) AS c3 FROM named n""",
    p1="""SELECT match_id, row_number() OVER (ORDER BY shape, seed, match_id) AS r FROM can WHERE c1
      QUALIFY r<=9""",
    p2="""SELECT match_id, row_number() OVER (ORDER BY shape, seed, match_id) AS r FROM can WHERE c2
      AND match_id NOT IN (SELECT match_id FROM p1) QUALIFY r<=11""",
    p3="""SELECT match_id, row_number() OVER (ORDER BY shape, seed, match_id) AS r FROM can WHERE c3
      AND match_id NOT IN (SELECT match_id FROM p1) AND match_id NOT IN (SELECT match_id FROM p2)
      QUALIFY r<=7""",
    p4="""SELECT match_id, row_number() OVER (ORDER BY shape, seed, match_id) AS r FROM can WHERE
      match_id NOT IN (SELECT match_id FROM p1) AND match_id NOT IN (SELECT match_id FROM p2) AND
      match_id NOT IN (SELECT match_id FROM p3) QUALIFY r<=5"""))
def _(spark, sf):
    tr = X.trace(spark, sf)
    m = X.named(X.lengths(spark, sf)).withColumn("can_open", F.lit(True))
    for kind in ("corner", "gk_throw", "kickoff"):
        have = events(tr, kind).select("match_id").distinct().withColumn(
            f"can_{kind}", F.lit(True))
        m = m.join(have, "match_id", "left").fillna(False, [f"can_{kind}"])
    old = E.awards(tr, [C.FREEKICK]).select("match_id").distinct()
    return S.incremental_plan(m, old, {"corner": 9, "gk_throw": 11, "kickoff": 7, "open": 5})


@query("contrasting_pair", "T9", with_views("""SELECT 1::BIGINT AS pick, match_id, start, shape, startown,
    coh FROM first1 UNION ALL SELECT * FROM (SELECT 2, p.match_id, p.start, p.shape, p.startown, p.coh
    FROM sp p, first1 f WHERE p.shape<>f.shape AND p.match_id<>f.match_id AND p.startown<>f.startown
    ORDER BY p.coh, p.match_id, p.start LIMIT 1)""",
    sp="SELECT p.*, shape FROM pool p JOIN named USING (match_id)",
    first1="SELECT * FROM sp ORDER BY coh, match_id, start LIMIT 1"))
def _(spark, sf):
    return S.contrasting_pair(X.named(J.pool(spark, sf))).select(
        "pick", "match_id", "start", "shape", "startown", "coh")


@query("spread_cost", "T11", with_views("""SELECT n, mean_coh, round(cost,6) AS spread_cost,
    round(m+0.06::DOUBLE*cost,6) AS objective FROM (SELECT count(*) AS n, avg(coh) AS m,
    round(avg(coh),6) AS mean_coh, (count(*)-count(DISTINCT cell))*3.0::DOUBLE+
    0.25::DOUBLE*(SELECT sum((v-t.n/6.0::DOUBLE)*(v-t.n/6.0::DOUBLE)) FROM (SELECT count(*) AS v FROM clips GROUP BY
      cell[1]), (SELECT count(*) AS n FROM clips) t)+
    0.12::DOUBLE*(SELECT sum((v-t.n/16.0::DOUBLE)*(v-t.n/16.0::DOUBLE)) FROM (SELECT count(*) AS v FROM clips GROUP BY
      cell[2:]), (SELECT count(*) AS n FROM clips) t) AS cost FROM clips)"""))
def _(spark, sf):
    return S.spread_cost(J.clips(spark, sf))


@query("shortages", "T12", with_views("""SELECT what, name, need, have, have<need AS short FROM (
    SELECT 'class' AS what, k AS name, q::BIGINT AS need, (SELECT count(DISTINCT match_id) FROM kpool
      WHERE kind=k) AS have FROM (VALUES ('corner',5),('gk_throw',5),('kickoff',5),('open',9)) v(k,q)
    UNION ALL SELECT 'level', CAST(l AS VARCHAR), 2, (SELECT count(DISTINCT match_id) FROM kpool WHERE
      level=l) FROM (SELECT unnest(range(8,20)) AS l)
    UNION ALL SELECT 'slot', l || '/' || t, 1, (SELECT count(DISTINCT match_id) FROM kpool WHERE
      level=l AND startown=CASE t WHEN 'blue' THEN 0 ELSE 1 END) FROM (SELECT unnest(range(8,20)) AS l),
      (SELECT unnest(['blue','red']) AS t))"""))
def _(spark, sf):
    return S.shortages(shared_pool(spark, sf))


@query("supply_per_level", "A21", with_views("""SELECT level, startown, coalesce(m,0) AS matches,
    coalesce(m,0)<2 AS short FROM (SELECT * FROM (SELECT unnest(range(8,20)) AS level),
    (SELECT unnest(range(0,2)) AS startown)) LEFT JOIN (SELECT level, startown, count(DISTINCT match_id) AS m FROM kpool GROUP BY 1,2)
    USING (level, startown)"""))
def _(spark, sf):
    dense = spark.range(8, 20).select(F.col("id").alias("level"),
                                      F.explode(F.expr("sequence(0L, 1L)")).alias("startown"))
    return S.supply(kpool(spark, sf), ["level", "startown"], dense)


@query("supply_per_kind", "A21", with_views("""SELECT kind, count(DISTINCT match_id) AS matches,
    count(DISTINCT match_id)<2 AS short FROM kpool GROUP BY 1"""))
def _(spark, sf):
    return S.supply(kpool(spark, sf), ["kind"])


@query("alternates", "T14", with_views("""SELECT match_id, start, level, startown, kind, coh FROM (
    SELECT *, row_number() OVER (PARTITION BY level, startown, kind ORDER BY coh, match_id, start) AS k
    FROM kpool) p WHERE k<=3 AND level BETWEEN 8 AND 19 AND NOT EXISTS (SELECT 1 FROM clips c WHERE
    c.match_id=p.match_id AND c.start=p.start)"""))
def _(spark, sf):
    pool = shared_pool(spark, sf)
    slots = pool.where(F.col("level").between(8, 19)).select("level", "startown", "kind")
    return S.alternates(pool, J.clips(spark, sf), slots, 3).select(
        "match_id", "start", "level", "startown", "kind", "coh")


@query("scan_list", "T14", with_views("""SELECT match_id, start, level, startown, kind, coh FROM (
    SELECT *, row_number() OVER (PARTITION BY level, startown, kind ORDER BY coh, match_id, start) AS k
    FROM kpool) p WHERE k<=6 AND startown=1 AND NOT EXISTS (SELECT 1 FROM clips c WHERE
    c.match_id=p.match_id AND c.start=p.start)"""))
def _(spark, sf):
    pool = shared_pool(spark, sf)
    slots = pool.where("startown = 1").select("level", "startown", "kind")
    return S.alternates(pool, J.clips(spark, sf), slots, 6).select(
        "match_id", "start", "level", "startown", "kind", "coh")


@query("slot_table", "T17", with_views("""SELECT level, slot, clip, CASE WHEN clip IS NULL THEN
    'unfilled' ELSE 'filled' END AS status FROM (SELECT * FROM (SELECT unnest(range(8,20)) AS level),
    (SELECT unnest(range(1,3)) AS slot)) LEFT JOIN (SELECT count_last AS level, clip, row_number() OVER
    (PARTITION BY count_last ORDER BY clip) AS slot FROM old_picks) USING (level, slot)"""))
def _(spark, sf):
    return S.slot_table(J.old_picks(spark, sf).withColumnRenamed("count_last", "level"))


@query("hide_sets", "T15", with_views("""SELECT match_id, start, "end", a, 8-a AS b, 6-a AS c,
    CASE WHEN a IS NOT NULL THEN 14-a+never END AS shown FROM (SELECT *, list_max(list_filter(
    range(0,7), lambda x: x<=nb AND 8-x<=na AND 6-x<=nc)) AS a FROM (SELECT match_id, start, "end",
    count(*) FILTER (f AND l) AS nb, count(*) FILTER (f AND NOT l) AS na,
    count(*) FILTER (NOT f AND l) AS nc, count(*) FILTER (dwell=0) AS never FROM (
    SELECT c.match_id, c.start, c."end", i.slot, count(*) FILTER (body_px>=25) AS dwell,
    bool_or(body_px>=25) FILTER (i.frame=c.start) AS f, bool_or(body_px>=25) FILTER
    (i.frame=c."end"-1) AS l FROM pool c JOIN inshot i ON i.match_id=c.match_id AND i.frame>=c.start
    AND i.frame<c."end" GROUP BY 1,2,3,4) GROUP BY 1,2,3))"""))
def _(spark, sf):
    return S.hide_sets(J.pool(spark, sf), X.inshot(spark, sf), pane=C.STRIDE).select(
        "match_id", "start", "end", "a", "b", "c", F.when(F.col("shown").isNotNull(), F.size(
            "shown")).cast("bigint").alias("shown"))


def _normal_sql(axis: str, seed: int = 20260807) -> str:
    parts = [f"CAST('0x' || substr(md5('{seed}{axis}{k}-' || draw),{8 * j + 1},8) AS BIGINT)" for k in range(3) for j in range(4)]
    return f"(({'+'.join(parts)})/4294967296.0::DOUBLE-6.0::DOUBLE)"


@query("target_cells", "T16", with_views(f"""SELECT draw, "row", col FROM (SELECT *, row_number() OVER (PARTITION BY
    "row", col ORDER BY draw) AS k FROM (SELECT draw, CAST(floor({_normal_sql("y")}*1.3::DOUBLE+3.2::DOUBLE) AS BIGINT) AS "row",
    CAST(floor({_normal_sql("x")}*3.7::DOUBLE+8.0::DOUBLE) AS BIGINT) AS col FROM (SELECT match_id*100000+frame AS draw
    FROM frames)) WHERE col BETWEEN 0 AND 15 AND "row" BETWEEN 1 AND 5) WHERE k<=2"""))
def _(spark, sf):
    return S.target_cells(X.frames(spark, sf).select(
        (F.col("match_id") * 100000 + F.col("frame")).alias("draw")))


@query("joint_selection", "T10")
def _(spark, sf):
    return S.joint_selection(kpool(spark, sf))


def old_selection(pool):
    return S.top(pool.where("level between 8 and 19"), ["level"], ["coh", "match_id", "start"], 1)


@query("reselection", "T13")
def _(spark, sf):
    pool = shared_pool(spark, sf)
    return S.reselect(old_selection(pool), pool)


# What a complete selection must look like; the pool, so that it is one the pool allows.
DESIGN = """
    SELECT 'size' AS what, '' AS name, CAST(24 AS BIGINT) AS n UNION ALL SELECT 'matches', '', 24 UNION ALL
    SELECT 'class', k, n FROM (VALUES ('corner',5),('gk_throw',5),('kickoff',5),('open',9)) q(k,n) UNION ALL
    SELECT 'level', CAST(level AS VARCHAR), 2 FROM slots GROUP BY level UNION ALL
    SELECT 'team', CAST(startown AS VARCHAR), 12 FROM slots GROUP BY startown UNION ALL
    SELECT 'slot', level || '/' || startown, 1 FROM slots"""
SLOTS = "SELECT DISTINCT level, startown FROM kpool WHERE level BETWEEN 8 AND 19 AND startown IN (0,1)"


@query("joint_selection_counts", "T10", with_views(DESIGN, slots=SLOTS))
def _(spark, sf):
    pool = shared_pool(spark, sf)
    picks = session.cut_lineage(S.joint_selection(pool))
    return S.selection_counts(picks.join(pool.select(*S.PICK).distinct(), S.PICK, "left_semi"))


@query("reselection_counts", "T13", with_views(DESIGN, slots=SLOTS))
def _(spark, sf):
    pool = shared_pool(spark, sf)
    return S.selection_counts(session.cut_lineage(S.reselect(old_selection(pool), pool)))


# --- job lists ---
VIEWS["jobs"] = """SELECT (row_number() OVER (ORDER BY seed)-1)*14+s AS job, seed, (['mid_bal',
    'mid_even','mid_even2','mid_push','mid_r','flankL','flankL2','flankR','boxL','boxR','wideL',
    'wideR','countL','countR'])[s+1] AS shape FROM (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS seed
    FROM orders), (SELECT unnest(range(0,14)) AS s)""".replace(
        "(row_number() OVER (ORDER BY seed)-1)*14+s", "(dense_rank() OVER (ORDER BY seed)-1)*14+s")


def jobs(spark, sf):
    return S.job_matrix(X.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("bigint").alias("seed")))


@query("job_matrix", "S10", with_views("SELECT * FROM jobs"))
def _(spark, sf):
    return jobs(spark, sf)


@query("open_jobs", "S11", with_views("""SELECT job, seed, shape FROM jobs j WHERE job%5=2 AND NOT
    EXISTS (SELECT 1 FROM named n WHERE n.shape=j.shape AND n.seed=j.seed+300)"""))
def _(spark, sf):
    done = X.named(X.lengths(spark, sf)).select("shape", (F.col("seed") - 300).alias("seed"))
    return S.todo(jobs(spark, sf), done, 2, 5)


# --- set operations ---
@query("set_operations", "T6", with_views("""SELECT 'restarts' AS what, count(*) AS n FROM (
    SELECT match_id, 0 AS frame FROM lengths UNION SELECT match_id, frame FROM goals)
    UNION ALL SELECT 'only_old', count(*) FROM (SELECT match_id, start FROM old_picks EXCEPT
      SELECT match_id, start FROM new_picks)
    UNION ALL SELECT 'levels_in_spec', count(*) FROM (SELECT count_last FROM clips INTERSECT
      SELECT unnest(range(8,20)))
    UNION ALL SELECT 'distinct_names', count(DISTINCT CASE WHEN shape IN ('mid_even','mid_even2')
      THEN 'mid_bal' ELSE shape END || seed) FROM named"""))
def _(spark, sf):
    from matchlens.functions import grid as Gr
    tr = X.trace(spark, sf)
    restarts = X.lengths(spark, sf).select("match_id", F.lit(0).cast("bigint").alias("frame")
                                           ).union(E.goals(tr, unit=U).select("match_id", "frame")
                                                   ).distinct()
    key = ["match_id", "start"]
    old, new = J.both_picks(spark, sf)
    only_old = old.select(*key).exceptAll(new.select(*key))
    levels = old.select("count_last").intersect(
        spark.range(8, 20).select(F.col("id").alias("count_last")))
    plays = X.named(X.lengths(spark, sf)).withColumn(
        "play", Gr.canonical_match(F.col("match"))).dropDuplicates(["play"])
    out = None
    for what, df in (("restarts", restarts), ("only_old", only_old),
                     ("levels_in_spec", levels), ("distinct_names", plays)):
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        out = part if out is None else out.unionByName(part)
    return out

