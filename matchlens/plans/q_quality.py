"""Batch expectations."""
from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.operators import lookups as L, quality as Q
from matchlens.plans import fixtures as X, q_joins as J, q_select as Sel
from matchlens.plans.oracle import VIEWS, with_views
from matchlens.plans.registry import query

# One clip per match: the calmest window of any kind.
VIEWS["batch"] = """SELECT * EXCLUDE (k), 0 AS hidden FROM (SELECT *, row_number() OVER (PARTITION BY
    match_id ORDER BY coh, kind, start) AS k FROM kpool) WHERE k=1"""


def batch(spark, sf):
    return Sel.S.top(Sel.kpool(spark, sf), ["match_id"], ["coh", "kind", "start"], 1)


@query("check_batch_spec", "V1", with_views("""SELECT 'batch size' AS "check", count(*)=24 AS pass,
    CAST(count(*) AS VARCHAR) AS detail FROM batch UNION ALL
    SELECT 'situation quota', count(*) FILTER (kind='corner')=5 AND count(*) FILTER (kind='gk_throw')=5
      AND count(*) FILTER (kind='kickoff')=5 AND count(*) FILTER (kind='open')=9,
      'corner=' || count(*) FILTER (kind='corner') || ' gk_throw=' || count(*) FILTER (kind='gk_throw')
      || ' kickoff=' || count(*) FILTER (kind='kickoff') || ' open=' || count(*) FILTER (kind='open')
      FROM batch UNION ALL
    SELECT 'team totals', count(*) FILTER (startown=0)=12 AND count(*) FILTER (startown=1)=12,
      count(*) FILTER (startown=0) || '/' || count(*) FILTER (startown=1) FROM batch UNION ALL
    SELECT 'nobody hidden', count(*) FILTER (hidden<>0)=0, CAST(count(*) FILTER (hidden<>0) AS VARCHAR)
      FROM batch UNION ALL
    SELECT 'restart shown', count(*) FILTER (kind<>'open' AND start>anchor)=0,
      CAST(count(*) FILTER (kind<>'open' AND start>anchor) AS VARCHAR) FROM batch UNION ALL
    SELECT 'levels filled exactly', count(*) FILTER (level BETWEEN 8 AND 19 AND n=2)=12 AND
      count(*) FILTER (level NOT BETWEEN 8 AND 19)=0, count(*) FILTER (level BETWEEN 8 AND 19 AND n=2)
      || '/' || count(*) FILTER (level NOT BETWEEN 8 AND 19) FROM lv UNION ALL
    SELECT 'two-clip levels split by team', count(*) FILTER (n=2 AND blue<>1)=0,
      CAST(count(*) FILTER (n=2 AND blue<>1) AS VARCHAR) FROM lv""",
    lv="""SELECT level, count(*) AS n, count(*) FILTER (startown=0) AS blue FROM batch GROUP BY 1"""))
def _(spark, sf):
    from matchlens import session
    b = session.cut_lineage(batch(spark, sf).withColumn("hidden", F.lit(0)))
    return Q.batch_spec(b)


@query("check_selected_batch", "V1 T10", """SELECT * FROM (VALUES ('batch size', true, '24'),
    ('situation quota', true, 'corner=5 gk_throw=5 kickoff=5 open=9'), ('team totals', true, '12/12'),
    ('nobody hidden', true, '0'), ('restart shown', true, '0'), ('levels filled exactly', true, '12/0'),
    ('two-clip levels split by team', true, '0')) t("check", pass, detail)""")
def _(spark, sf):
    from matchlens import session
    pool = Sel.shared_pool(spark, sf)
    key = Sel.S.PICK
    picks = session.cut_lineage(Sel.S.joint_selection(pool).join(
        pool.groupBy(*key).agg(F.min("anchor").alias("anchor")), key).withColumn("hidden", F.lit(0)))
    return Q.batch_spec(picks)


@query("check_distinct_passages", "V2 J10", with_views("""SELECT 'one clip per passage of play' AS
    "check", count(*) FILTER (EXISTS (SELECT 1 FROM cc b WHERE b.digest=a.digest AND
    b.match_id<>a.match_id AND a.start<b."end" AND b.start<a."end"))=0 AS pass, CAST(count(*) FILTER (
    EXISTS (SELECT 1 FROM cc b WHERE b.digest=a.digest AND b.match_id<>a.match_id AND a.start<b."end"
    AND b.start<a."end")) AS VARCHAR) AS detail FROM cc a""", digests=J.DIGEST_SQL, **J.COPIES,
    cc="""SELECT c.*, d.digest FROM (SELECT match_id, start, start+125 AS "end" FROM (SELECT
    3*match_id+c AS match_id, ((3*match_id+c)*53)%300 AS start FROM lengths,
    (SELECT unnest(range(0,3)) AS c))) c JOIN digests d USING (match_id)"""))
def _(spark, sf):
    d = L.digest(J.copied_trace(spark, sf), J.DIGEST_COLUMNS)
    return Q.distinct_passages(L.same_play(J.copied_clips(spark, sf), d))


@query("check_frames", "V3", with_views("""SELECT 'framing shows pitch' AS "check", min(pitch)>=0.8
    AS pass, 'clip ' || arg_min(clip, (pitch, clip)) AS detail FROM per UNION ALL
    SELECT 'passes differ only in the ball', max(n)<=400, 'clip ' || arg_max(clip,(n,clip)) || ' at '
      || max(n) || ' px' FROM per UNION ALL
    SELECT 'ball on every final frame', min(n)>=3, 'clip ' || arg_min(clip,(n,clip)) || ' at ' || min(n)
      || ' px' FROM per""", per="""SELECT clip, avg(CASE WHEN vis_g>vis_r*1.04::DOUBLE AND vis_g>vis_b*
      1.04::DOUBLE AND vis_g>12 THEN 1.0 ELSE 0.0 END)::DOUBLE AS pitch,
      count(*) FILTER (abs(vis_r-inv_r)+abs(vis_g-inv_g)+abs(vis_b-inv_b)>40) AS n FROM pixels
      GROUP BY 1"""))
def _(spark, sf):
    return Q.frame_checks(X.pixels(spark, sf))


@query("check_spread", "V4", with_views("""SELECT 'no row holds too many' AS "check", max(n)<=12 AS
    pass, CAST(max(n) AS VARCHAR) AS detail FROM (SELECT count(*) AS n FROM clips GROUP BY cell[1])
    UNION ALL SELECT 'enough rows', count(DISTINCT cell[1])>=4, CAST(count(DISTINCT cell[1]) AS VARCHAR)
      FROM clips UNION ALL SELECT 'enough distinct cells', count(DISTINCT cell)>=12,
      CAST(count(DISTINCT cell) AS VARCHAR) FROM clips UNION ALL SELECT 'enough columns',
      count(DISTINCT cell[2:])>=8, CAST(count(DISTINCT cell[2:]) AS VARCHAR) FROM clips"""))
def _(spark, sf):
    from matchlens import session
    return Q.spread_checks(session.cut_lineage(J.clips(spark, sf).select("cell")))


@query("check_key", "V5 S3", with_views("""SELECT 'key rows have files' AS "check", count(*)=0 AS pass,
    CAST(count(*) AS VARCHAR) AS detail FROM truth t WHERE clip%13=0 UNION ALL
    SELECT 'files have key rows', count(*)=0, CAST(count(*) AS VARCHAR) FROM (SELECT 1 FROM truth WHERE
      clip%17=0) UNION ALL
    SELECT 'no blank cells', count(*) FILTER (clip%19=0)=0, CAST(count(*) FILTER (clip%19=0) AS VARCHAR)
      FROM truth UNION ALL
    SELECT 'counts equal targets', count(*) FILTER (clip%12<>clip%11)=0, CAST(count(*) FILTER
      (clip%12<>clip%11) AS VARCHAR) FROM truth UNION ALL
    SELECT 'all players in play', count(*) FILTER (clip%23=0)=0, CAST(count(*) FILTER (clip%23=0) AS VARCHAR)
      FROM truth"""))
def _(spark, sf):
    from matchlens.functions import grid as Gr
    t = X.truth(spark, sf)
    cell = Gr.cell_of(F.col("px"), F.col("py"))
    key = t.select("clip", F.when(F.expr("clip % 19 <> 0"), cell).otherwise("").alias("start_cell"),
                   cell.alias("final_cell"), F.expr("clip % 12").alias("measured"),
                   F.expr("clip % 11").alias("target"), F.expr("if(clip % 23 = 0, 21, 22)").alias("in_play"))
    files = t.where("clip % 13 <> 0").select("clip").unionByName(
        t.where("clip % 17 = 0").select((-F.col("clip") - 1).alias("clip")))
    return Q.key_completeness(key, files)


@query("check_published_counts", "V6", with_views("""SELECT 'published counts hold' AS "check",
    count(*) FILTER (o.count_last IS DISTINCT FROM s.n)=0 AS pass, count(*) FILTER (o.count_last IS
    DISTINCT FROM s.n) || '/' || count(*) AS detail FROM old_picks o LEFT JOIN (SELECT match_id, frame,
    count(*) FILTER (body_px>=20) AS n FROM inshot GROUP BY 1,2) s ON s.match_id=o.match_id AND
    s.frame=o."end"-1"""))
def _(spark, sf):
    from matchlens import session
    from matchlens.operators import measure as M
    old = session.cut_lineage(J.old_picks(spark, sf).select("clip", "match_id", "end",
                                                            "count_last"))
    again = X.inshot(spark, sf).select("match_id", (F.col("frame") + 1).alias("end"),
                                       M.count_over("body", 20).alias("measured"))
    return Q.published_counts(old.select("clip", F.col("count_last").alias("players")),
                              old.join(again, ["match_id", "end"]).select("clip", "measured"))
