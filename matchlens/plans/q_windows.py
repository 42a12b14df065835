"""Window queries: cutting, gates, features, ranking."""
from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.operators import windows as W
from matchlens.plans import fixtures as X
from matchlens.plans.oracle import VIEWS, with_views
from matchlens.plans.registry import query

U = X.UNIT

# One row per legal open-play window, with its features.
VIEWS["windows"] = """SELECT s.match_id, s.frame AS start, s.frame+125 AS "end",
    avg(CASE WHEN t.owned_team=-1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS loose,
    max(t.ball_z)/1000.0::DOUBLE AS apex,
    round(sum(t.step) FILTER (t.frame>s.frame)/1000.0::DOUBLE,6) AS path,
    max(t.step) FILTER (t.frame>s.frame)/1000.0::DOUBLE AS max_step,
    bool_or(t.goal_touch) AS goal_touch,
    bool_or(t.award AND t.frame>s.frame) AS award_inside,
    round(quantile_cont(b.near_m, 0.5),6) AS dnear
    FROM steps s JOIN lengths l USING (match_id)
    JOIN steps t ON t.match_id=s.match_id AND t.frame BETWEEN s.frame AND s.frame+124
    JOIN bodies b ON b.match_id=t.match_id AND b.frame=t.frame
    WHERE s.frame>=25 AND s.frame%5=0 AND s.frame<l.n-125 GROUP BY 1,2"""
VIEWS["scored"] = """SELECT *, round(loose*2.0+apex/3.2+dnear/4.0,4) AS coh,
    max_step<0.35 AND NOT goal_touch AS is_continuous, NOT award_inside AS no_restart,
    loose<=0.55 AND apex<=2.6 AND dnear<=3.5 AND path BETWEEN 0.33 AND 0.95 AS is_engaged
    FROM windows"""
VIEWS["open_windows"] = """SELECT match_id, start, "end", loose, apex, dnear, path, coh
    FROM scored WHERE is_continuous AND no_restart AND is_engaged"""


def open_windows(spark, sf):
    out = W.sliding(X.trace(spark, sf), unit=U)
    out = out.where(W.continuous() & W.no_restart() & W.engaged("open"))
    return out.select("match_id", "start", "end", "loose", "apex", "dnear", "path",
                      W.coherence().alias("coh"))


@query("sliding_windows", "W1 A1 A2 F1 F2 F3", with_views(
    "SELECT * FROM scored"))
def _(spark, sf):
    return W.sliding(X.trace(spark, sf), unit=U).select(
        "*", W.coherence().alias("coh"), W.continuous().alias("is_continuous"),
        W.no_restart().alias("no_restart"), W.engaged("open").alias("is_engaged"))


@query("short_tail_windows", "F1 W1", with_views("""SELECT s.match_id, s.frame AS start, count(*) AS frames,
    avg(CASE WHEN t.owned_team=-1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS loose,
    max(t.step) FILTER (t.frame>s.frame)/1000.0::DOUBLE<0.35 AS no_jump,
    max(t.step) FILTER (t.frame>s.frame)/1000.0::DOUBLE<0.35 AND NOT bool_or(t.goal_touch) AS is_continuous
    FROM steps s JOIN steps t ON t.match_id=s.match_id AND t.frame BETWEEN s.frame AND s.frame+124
    WHERE s.frame>=25 AND s.frame%5=0 GROUP BY 1,2 HAVING count(*)>=120"""))
def _(spark, sf):
    w = W.sliding(X.trace(spark, sf), unit=U, near=False, missing=5)
    return w.select("match_id", "start", "frames", "loose", W.continuous(False, "frames", missing=5).alias("no_jump"),
                    W.continuous(True, "frames", missing=5).alias("is_continuous"))


@query("open_windows", "F4", with_views("SELECT * FROM open_windows"))
def _(spark, sf):
    return open_windows(spark, sf)


@query("top_windows", "T1", with_views("""SELECT match_id, start, "end", coh, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY coh, start) AS rank
    FROM open_windows) WHERE rank<=40"""))
def _(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("match_id").orderBy("coh", "start")
    return (open_windows(spark, sf).withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where("rank <= 40").select("match_id", "start", "end", "coh", "rank"))


SPREAD_SQL = dict(
    ranked="""SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY coh, start) AS r
        FROM open_windows""",
    walk="""SELECT match_id, r, [start] AS kept, true AS took FROM ranked WHERE r=1
        UNION ALL SELECT x.match_id, x.r,
        CASE WHEN len(w.kept)<40 AND len(list_filter(w.kept, lambda k: abs(k-x.start)<25))=0
          THEN list_append(w.kept, x.start) ELSE w.kept END,
        len(w.kept)<40 AND len(list_filter(w.kept, lambda k: abs(k-x.start)<25))=0
        FROM walk w JOIN ranked x ON x.match_id=w.match_id AND x.r=w.r+1""")


@query("spread_windows", "W17", with_views("""SELECT x.match_id, row_number() OVER
    (PARTITION BY x.match_id ORDER BY x.r) AS rank, x.start, x."end", loose, apex, dnear, path,
    coh FROM ranked x JOIN walk w ON w.match_id=x.match_id AND w.r=x.r WHERE w.took""",
    **SPREAD_SQL))
def _(spark, sf):
    return W.spread(open_windows(spark, sf))
