"""People counts and pixel measurements."""
from __future__ import annotations

from pyspark.sql import functions as F

from matchlens import config as C, session
from matchlens.operators import measure as M
from matchlens.plans import fixtures as X, q_joins  # noqa: F401
from matchlens.plans.oracle import VIEWS, with_views
from matchlens.plans.q_windows import open_windows
from matchlens.plans.registry import query


def people(spark, sf):
    return M.people(X.inshot(spark, sf))


@query("people_per_frame", "A3", with_views("SELECT * FROM shown"))
def _(spark, sf):
    return people(spark, sf)


@query("people_per_second", "A4", with_views("""SELECT match_id, frame//10 AS second,
    round(avg(people),6) AS mean_people, min(people) AS min_people, max(people) AS max_people
    FROM shown GROUP BY 1,2"""))
def _(spark, sf):
    return M.per_second(people(spark, sf), fps=10)


@query("people_summary", "A5", with_views("""SELECT count(*) AS frames, count(DISTINCT match_id)
    AS clips, min(people) AS min, max(people) AS max, round(avg(people),6) AS mean,
    quantile_cont(people,0.5)::DOUBLE AS median, quantile_cont(people,0.25)::DOUBLE AS p25,
    quantile_cont(people,0.75)::DOUBLE AS p75, round(avg(team_blue),6) AS blue_mean,
    round(avg(team_red),6) AS red_mean, count(*) FILTER (goalkeepers>0) AS gk_frames
    FROM shown"""))
def _(spark, sf):
    return M.summary(people(spark, sf))


@query("people_histogram", "A6", with_views("""SELECT v.people, coalesce(n,0) AS n FROM (SELECT
    unnest(range(min(people),max(people)+1)) AS people FROM shown) v LEFT JOIN (SELECT people,
    count(*) AS n FROM shown GROUP BY 1) h ON h.people=v.people"""))
def _(spark, sf):
    return M.histogram(people(spark, sf))


@query("people_frame_profile", "A7", with_views("""SELECT frame, round(avg(people),6) AS mean,
    quantile_cont(people,0.25)::DOUBLE AS p25, quantile_cont(people,0.75)::DOUBLE AS p75,
    min(people) AS min, max(people) AS max FROM shown GROUP BY 1"""))
def _(spark, sf):
    return M.frame_profile(people(spark, sf))


@query("people_clip_means", "A7", with_views(
    "SELECT match_id, round(avg(people),6) AS mean FROM shown GROUP BY 1"))
def _(spark, sf):
    return M.clip_means(people(spark, sf))


@query("people_churn", "A8", with_views("""SELECT round(avg(abs(people-prev)),6) AS churn,
    (SELECT sum(abs(seen-was))::BIGINT FROM (SELECT CASE WHEN body_px>=25 THEN 1 ELSE 0 END AS
    seen, lag(CASE WHEN body_px>=25 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, slot
    ORDER BY frame) AS was FROM inshot)) AS entries_exits FROM (SELECT people, lag(people) OVER
    (PARTITION BY match_id ORDER BY frame) AS prev FROM shown)"""))
def _(spark, sf):
    return M.churn(X.inshot(spark, sf))


@query("people_sensitivity", "A9", with_views("""SELECT threshold::BIGINT AS threshold,
    round(avg(n),6) AS mean FROM (SELECT match_id, frame, threshold, count(*) FILTER
    (body_px>=threshold) AS n FROM inshot, (SELECT unnest([1,10,25,50,100]) AS threshold)
    GROUP BY 1,2,3) GROUP BY 1"""))
def _(spark, sf):
    return M.sensitivity(X.inshot(spark, sf))


@query("people_matrix", "A10", with_views("""SELECT match_id, second, round(avg(people),6) AS
    mean_people, grouping_id(match_id, second) AS margin FROM (SELECT *, frame//25 AS second
    FROM shown) GROUP BY CUBE (match_id, second)"""))
def _(spark, sf):
    return M.second_matrix(people(spark, sf))


@query("window_occupancy", "A34", with_views("""SELECT w.match_id, w.start, w."end",
    min(people) AS min, quantile_cont(people,0.5)::DOUBLE AS median,
    round(quantile_cont(people,0.1)::DOUBLE,6) AS p10
    FROM open_windows w JOIN shown s ON s.match_id=w.match_id AND s.frame>=w.start AND
    s.frame<w."end" GROUP BY 1,2,3"""))
def _(spark, sf):
    return M.occupancy(session.cut_lineage(open_windows(spark, sf)), people(spark, sf), C.STRIDE).withColumn(
        "p10", F.round("p10", 6))


@query("region_count", "A23", with_views("""SELECT match_id, frame, count(*) FILTER (
    trunc(80.0::DOUBLE+(y/1000.0::DOUBLE+0.42::DOUBLE)/0.84::DOUBLE*560) BETWEEN 300 AND 420)
    AS in_band FROM players GROUP BY 1,2"""))
def _(spark, sf):
    return M.region_count(X.trace(spark, sf), 300, 420, unit=X.UNIT)


@query("team_centroids", "A24", with_views("""SELECT match_id, frame,
    round(sum(x) FILTER (team=0)/11.0::DOUBLE/1000.0::DOUBLE,6) AS a_x, round(sum(y) FILTER (team=0)/11.0::DOUBLE/1000.0::DOUBLE,6)
    AS a_y, round(sum(x) FILTER (team=1)/11.0::DOUBLE/1000.0::DOUBLE,6) AS b_x,
    round(sum(y) FILTER (team=1)/11.0::DOUBLE/1000.0::DOUBLE,6) AS b_y FROM players GROUP BY 1,2"""))
def _(spark, sf):
    return M.centroids(X.trace(spark, sf), unit=X.UNIT)


# --- pixels ---
VIEWS["diffs"] = """SELECT *, abs(vis_r-inv_r)+abs(vis_g-inv_g)+abs(vis_b-inv_b) AS d,
    vis_r+vis_g+vis_b AS light FROM pixels"""
VIEWS["centroids"] = """SELECT clip, CASE WHEN n_l>=3 THEN round(x_l/w_l,6) ELSE round(x_m/w_m,6)
    END AS px, CASE WHEN n_l>=3 THEN round(y_l/w_l,6) ELSE round(y_m/w_m,6) END AS py, mask_px FROM (
    SELECT clip, count(*) FILTER (m) AS n_m, sum(d) FILTER (m)::DOUBLE AS w_m,
    sum(d*x) FILTER (m)::DOUBLE AS x_m, sum(d*y) FILTER (m)::DOUBLE AS y_m,
    count(*) FILTER (m AND light>600) AS n_l, sum(d) FILTER (m AND light>600)::DOUBLE AS w_l,
    sum(d*x) FILTER (m AND light>600)::DOUBLE AS x_l,
    sum(d*y) FILTER (m AND light>600)::DOUBLE AS y_l, count(*) FILTER (s) AS mask_px FROM (
    SELECT *, CASE WHEN bool_or(s) OVER (PARTITION BY clip) THEN s ELSE d>peak*0.5 END AS m FROM (
    SELECT *, d>greatest(40, peak*0.35) AS s FROM (SELECT *, max(d) OVER (PARTITION BY clip) AS peak
    FROM diffs))) GROUP BY clip)"""


@query("ball_centroid", "A29", with_views("SELECT * FROM centroids"))
def _(spark, sf):
    return M.ball_centroid(X.pixels(spark, sf), ["clip"])


@query("ball_centroid_compact", "A29", with_views("""SELECT b.clip,
    CASE WHEN strong>=12 THEN px WHEN ok THEN round(mx/m,6) END AS px,
    CASE WHEN strong>=12 THEN py WHEN ok THEN round(my/m,6) END AS py,
    CASE WHEN strong>=12 THEN mask_px WHEN ok THEN weak ELSE 0 END AS changed FROM (
    SELECT clip, count(*) FILTER (d>40) AS strong, count(*) FILTER (d>18) AS weak,
    sum(d) FILTER (d>18)::DOUBLE AS m, sum(d*x) FILTER (d>18)::DOUBLE AS mx,
    sum(d*y) FILTER (d>18)::DOUBLE AS my, count(*) FILTER (d>18)>=4 AND
    max(x) FILTER (d>18)-min(x) FILTER (d>18)<=20 AND
    max(y) FILTER (d>18)-min(y) FILTER (d>18)<=20 AS ok FROM diffs GROUP BY 1) b
    JOIN centroids USING (clip)"""))
def _(spark, sf):
    return M.ball_centroid_compact(X.pixels(spark, sf), ["clip"], signal=12, min_weak=4)


@query("ball_visibility", "A30", with_views("""SELECT clip, count(*) FILTER (d>40) AS ball_px,
    count(*) FILTER (d>40)>=7 AS visible FROM diffs GROUP BY 1"""))
def _(spark, sf):
    return M.ball_visible(X.pixels(spark, sf), ["clip"], min_px=7)


# The visible pass as a solo frame: the ball square plus, below it, a strip that only darkens.
SOLO = """SELECT clip, y, x, CASE WHEN y=(cy+4)%24 AND abs(x-bx)<=clip%5 THEN inv_r-12 ELSE vis_r END
    AS vis_r, CASE WHEN y=(cy+4)%24 AND abs(x-bx)<=clip%5 THEN inv_g-12 ELSE vis_g END AS vis_g,
    CASE WHEN y=(cy+4)%24 AND abs(x-bx)<=clip%5 THEN inv_b-12 ELSE vis_b END AS vis_b,
    inv_r, inv_g, inv_b FROM (SELECT p.*, (389*clip+211)%1280//20 AS bx, (157*clip+97)%480//20 AS cy
    FROM pixels p)"""


def solo(spark, sf):
    p = X.pixels(spark, sf).select(
        "*", F.expr("y = ((157 * clip + 97) % 480 div 20 + 4) % 24 and abs(x - (389 * clip + 211)"
                    " % 1280 div 20) <= clip % 5").alias("shade"))
    return p.select("clip", "y", "x", *[F.expr(
        f"case when shade then inv_{c} - 12 else vis_{c} end").alias(f"vis_{c}") for c in "rgb"],
        "inv_r", "inv_g", "inv_b")


@query("body_and_shadow", "A31", with_views("""SELECT clip, count(*) FILTER (hit) AS pix,
    count(*) FILTER (hit AND dark) AS shadow_pix, count(*) FILTER (hit AND NOT dark) AS body_pix,
    min(x) FILTER (hit) AS x0, min(y) FILTER (hit) AS y0, max(x) FILTER (hit) AS x1,
    max(y) FILTER (hit) AS y1, round(avg(x) FILTER (hit),6) AS cx, round(avg(y) FILTER (hit),6)
    AS cy FROM (SELECT *, abs(vis_r-inv_r)+abs(vis_g-inv_g)+abs(vis_b-inv_b)>30 AS hit,
    vis_r+vis_g+vis_b<inv_r+inv_g+inv_b AND greatest(abs(vis_r-inv_r),abs(vis_g-inv_g),
    abs(vis_b-inv_b))<60 AS dark FROM solo) GROUP BY 1""", solo=SOLO))
def _(spark, sf):
    return M.body_and_shadow(solo(spark, sf), ["clip"])


def _hue_sql(p):
    hi = f"greatest({p}_r,{p}_g,{p}_b)"
    sp = f"({hi}-least({p}_r,{p}_g,{p}_b))::DOUBLE"
    raw = (f"CASE WHEN {sp}=0 THEN 0 WHEN {hi}={p}_r THEN 60*(({p}_g-{p}_b)/{sp}) WHEN {hi}={p}_g "
           f"THEN 60*(({p}_b-{p}_r)/{sp})+120 ELSE 60*(({p}_r-{p}_g)/{sp})+240 END")
    return f"(CASE WHEN ({raw})<0 THEN ({raw})+360 ELSE ({raw}) END)"


@query("recoloured_pixels", "A31", with_views(f"""SELECT clip, count(*) FILTER (hit) AS pix,
    count(*) FILTER (hit AND least(gap,360-gap)>12) AS body_pix FROM (SELECT clip,
    abs(vis_r-inv_r)+abs(vis_g-inv_g)+abs(vis_b-inv_b)>30 AS hit,
    abs({_hue_sql('vis')}-{_hue_sql('inv')}) AS gap FROM solo) GROUP BY 1""",
    solo=SOLO))
def _(spark, sf):
    return M.recoloured(solo(spark, sf), ["clip"])


@query("pitch_fraction", "A32", with_views("""SELECT clip, avg(CASE WHEN vis_g>vis_r*1.04::DOUBLE
    AND vis_g>vis_b*1.04::DOUBLE AND vis_g>12 THEN 1.0 ELSE 0.0 END)::DOUBLE AS pitch,
    avg(CASE WHEN vis_g>vis_r*1.04::DOUBLE AND vis_g>vis_b*1.04::DOUBLE AND vis_g>12 THEN 1.0
    ELSE 0.0 END)<0.995 AS low FROM pixels GROUP BY 1"""))
def _(spark, sf):
    return M.pitch_fraction(X.pixels(spark, sf), ["clip"], floor=0.995)


@query("stack_difference", "A33", with_views("""SELECT sum(px)::BIGINT AS pixels,
    sum(nd)::BIGINT AS differing, max(big) AS largest, sum(total)::DOUBLE/(sum(px)*3) AS mean,
    count(*) FILTER (nd>0) AS frames_touched FROM (SELECT clip, count(*) AS px,
    count(*) FILTER (d>0) AS nd, max(greatest(abs(vis_r-inv_r),abs(vis_g-inv_g),abs(vis_b-inv_b)))
    AS big, sum(d) AS total FROM diffs GROUP BY 1)"""))
def _(spark, sf):
    return M.stack_difference(X.pixels(spark, sf))


@query("paired_passes", "A29 P22", with_views("""SELECT clip, count(*) AS px, sum(vis_g)::BIGINT
    AS vis_g, sum(inv_g)::BIGINT AS inv_g FROM pixels GROUP BY 1"""))
def _(spark, sf):
    wide = X.pixels(spark, sf)
    long = wide.select("clip", "y", "x", F.explode(F.array(*[F.struct(
        F.lit(p).alias("pass"), *[F.col(f"{p}_{c}").alias(c) for c in "rgb"])
        for p in ("vis", "inv")])).alias("s")).select("clip", "y", "x", "s.*")
    return M.pair_passes(long, ["clip"]).groupBy("clip").agg(
        F.count(F.lit(1)).alias("px"), F.sum("vis_g").alias("vis_g"),
        F.sum("inv_g").alias("inv_g"))
