"""Joins of windows and clips with measurements, spans, possession and other versions."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from matchlens import session
from matchlens.functions import grid as Gr
from matchlens.operators import chunks, events as E, lookups as L
from matchlens.plans import fixtures as X
from matchlens.plans.oracle import VIEWS, with_views
from matchlens.plans.q_grading import cell_sql
from matchlens.plans.q_windows import open_windows
from matchlens.plans.registry import query

U = X.UNIT

VIEWS["shown"] = """SELECT match_id, frame, count(*) FILTER (body_px>=25) AS people,
    count(*) FILTER (body_px>=25 AND slot<11) AS team_blue,
    count(*) FILTER (body_px>=25 AND slot>=11) AS team_red,
    count(*) FILTER (body_px>=25 AND slot IN (0,11)) AS goalkeepers FROM inshot GROUP BY 1,2"""
VIEWS["possession"] = """SELECT match_id, frame, coalesce(last_value(held IGNORE NULLS) OVER
    (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(held IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN
    CURRENT ROW AND 124 FOLLOWING), -1) AS owner FROM (SELECT match_id, frame,
    CASE WHEN owned_team>=0 THEN owned_team END AS held FROM trace)"""
VIEWS["pool"] = f"""SELECT match_id, start, "end", loose, apex, dnear, path, coh, startown,
    count_first, count_last, px, py, crow || ccol AS cell FROM (
    SELECT w.*, p.owner AS startown, a.people AS count_first, z.people AS count_last, b.px, b.py,
    {cell_sql(prefix='c')} FROM open_windows w
    JOIN possession p ON p.match_id=w.match_id AND p.frame=w.start AND p.owner>=0
    JOIN shown a ON a.match_id=w.match_id AND a.frame=w.start
    JOIN shown z ON z.match_id=w.match_id AND z.frame=w."end"-1
    JOIN ballpix b ON b.match_id=w.match_id AND b.frame=w."end"-1
    WHERE NOT EXISTS (SELECT 1 FROM absent s WHERE s.match_id=w.match_id AND
      (w.start BETWEEN lo AND hi OR w."end"-1 BETWEEN lo AND hi)))"""
VIEWS["clips"] = """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY match_id
    ORDER BY coh, start) AS k FROM pool) WHERE k=1"""


def pool(spark, sf, windows=None):
    tr = X.trace(spark, sf)
    # Written first: the lookups below read the windows six times in all, and each time their whole plan over the
    # trace would stand in the driver's memory again.
    w = session.written(open_windows(spark, sf) if windows is None else windows)
    w = L.outside_spans(w, X.absent(spark, sf), "ends")
    w = L.with_end_counts(w, X.inshot(spark, sf))
    w = L.with_ball_pixel(w, X.ballpix(spark, sf))
    w = L.with_possession(w, tr)
    return w.withColumn("cell", Gr.cell_of(F.col("px"), F.col("py")))


POOL_COLUMNS = ["match_id", "start", "end", "loose", "apex", "dnear", "path", "coh", "startown",
                "count_first", "count_last", "px", "py", "cell"]


def clips(spark, sf):
    return best(pool(spark, sf))


@query("pool", "J2 J3 J4 J7", with_views("SELECT * FROM pool"))
def _(spark, sf):
    return pool(spark, sf).select(*POOL_COLUMNS)


@query("best_window_per_match", "W19", with_views("SELECT * FROM clips"))
def _(spark, sf):
    return clips(spark, sf)


@query("windows_with_end_counts", "J2", with_views("""SELECT w.match_id, w.start, w."end",
    a.people AS count_first, z.people AS count_last FROM open_windows w
    JOIN shown a ON a.match_id=w.match_id AND a.frame=w.start
    JOIN shown z ON z.match_id=w.match_id AND z.frame=w."end"-1"""))
def _(spark, sf):
    return L.with_end_counts(open_windows(spark, sf), X.inshot(spark, sf)).select(
        "match_id", "start", "end", "count_first", "count_last")


@query("windows_without_ball_pixel", "J3", with_views("""SELECT w.match_id, count(*) AS dropped
    FROM open_windows w LEFT JOIN ballpix b ON b.match_id=w.match_id AND b.frame=w."end"-1
    WHERE b.px IS NULL GROUP BY 1"""))
def _(spark, sf):
    return L.without_ball_pixel(open_windows(spark, sf), X.ballpix(spark, sf)).groupBy(
        "match_id").agg(F.count(F.lit(1)).alias("dropped"))


for name, covers, rule, test in (
        ("outside_absent_ends", "J4", "ends",
         'w.start BETWEEN lo AND hi OR w."end"-1 BETWEEN lo AND hi'),
        ("outside_absent_overlap", "J5", "overlap", 'w.start<=hi AND lo<=w."end"-1'),
        ("outside_absent_inside", "J6", "ends", 'w.start BETWEEN lo AND hi OR w."end"-1 BETWEEN '
         'lo AND hi OR (lo<=w.start AND w."end"-1<=hi)')):
    @query(name, covers, with_views(f"""SELECT match_id, start, "end" FROM open_windows w WHERE
        NOT EXISTS (SELECT 1 FROM absent s WHERE s.match_id=w.match_id AND ({test}))"""))
    def _(spark, sf, rule=rule):
        return L.outside_spans(open_windows(spark, sf), X.absent(spark, sf), rule).select(
            "match_id", "start", "end")


@query("possession_as_of", "J7", with_views("SELECT * FROM possession"))
def _(spark, sf):
    return L.possession(X.trace(spark, sf))


@query("nearest_player", "J8", with_views("""SELECT match_id, frame, team::BIGINT AS team,
    slot::BIGINT AS slot, sqrt(d2::DOUBLE)/1000.0::DOUBLE AS distance FROM (SELECT *, row_number() OVER
    (PARTITION BY match_id, frame ORDER BY d2, team, slot) AS k FROM (SELECT *,
    (x-ball_x)*(x-ball_x)+(y-ball_y)*(y-ball_y) AS d2 FROM players)) WHERE k=1"""))
def _(spark, sf):
    return L.nearest(X.trace(spark, sf), unit=U)


@query("restart_taker_in_shot", "J21", with_views("""SELECT k.match_id, k.anchor, n.team, n.slot,
    CASE WHEN body_px IS NULL THEN '?' WHEN body_px>=25 THEN 'yes' ELSE 'NO' END AS taker_in_shot
    FROM corners k JOIN (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY
    (x-ball_x)*(x-ball_x)+(y-ball_y)*(y-ball_y), team, slot) AS r FROM players) n
    ON n.match_id=k.match_id AND n.frame=k.anchor AND n.r=1 LEFT JOIN inshot i ON
    i.match_id=k.match_id AND i.frame=k.anchor AND i.slot=n.team*11+n.slot"""))
def _(spark, sf):
    tr = X.trace(spark, sf)
    ev = E.deliveries(tr, quiet=0.002, unit=U).select("match_id", "anchor")
    return L.taker_in_shot(ev, tr, X.inshot(spark, sf))


# --- copies of plays: every match under three names ---
COPIES = dict(phases="""SELECT 3*match_id+c AS match_id, frame, match_id AS play FROM frames,
    (SELECT unnest(range(0,3)) AS c)""")
DIGEST_COLUMNS = ["ball_x", "ball_y", "ball_z", "owned_team", "owned_player", "game_mode",
                  "score_l", "score_r"]
DIGEST_SQL = """SELECT match_id, sha256(sha256(sha256(string_agg(h,';' ORDER BY b)))) AS digest,
    sum(n)::BIGINT AS steps FROM (SELECT match_id, frame//4096 AS b, sha256(string_agg(h,';' ORDER BY frame))
    AS h, count(*) AS n FROM (SELECT match_id, frame, sha256(concat_ws(',',frame,ball_x,ball_y,
    ball_z,owned_team,owned_player,game_mode,score_l,score_r)) AS h FROM trace) GROUP BY 1,2)
    GROUP BY 1"""


def copied_trace(spark, sf):
    named = X.frames(spark, sf).withColumnRenamed("match_id", "play").select(
        "play", "frame", F.explode(F.expr("sequence(3 * play, 3 * play + 2)")).alias("match_id"))
    return X.track(named, "play")


def copied_clips(spark, sf):
    return X.lengths(spark, sf).select(
        F.explode(F.expr("sequence(3 * match_id, 3 * match_id + 2)")).alias("match_id")).select(
        "match_id", F.expr("(match_id * 53) % 300").alias("start"),
        F.expr("(match_id * 53) % 300 + 125").alias("end"))


@query("play_digests", "A19 T6", with_views("""SELECT digest, min(match_id) AS match_id,
    count(*) AS copies, max(steps) AS steps FROM digests GROUP BY 1""", digests=DIGEST_SQL,
    **COPIES))
def _(spark, sf):
    d = L.digest(copied_trace(spark, sf), DIGEST_COLUMNS)
    return d.groupBy("digest").agg(F.min("match_id").alias("match_id"),
                                   F.count(F.lit(1)).alias("copies"),
                                   F.max("steps").alias("steps"))


@query("same_play_clips", "J10 V2", with_views("""SELECT a.match_id, a.start, a."end",
    count(b.match_id) AS same_play FROM cc a LEFT JOIN cc b ON b.digest=a.digest AND
    b.match_id<>a.match_id AND a.start<b."end" AND b.start<a."end" GROUP BY 1,2,3""",
    digests=DIGEST_SQL, **COPIES, cc="""SELECT c.*, d.digest FROM (SELECT match_id, start,
    start+125 AS "end" FROM (SELECT 3*match_id+c AS match_id, ((3*match_id+c)*53)%300 AS start
    FROM lengths, (SELECT unnest(range(0,3)) AS c))) c JOIN digests d USING (match_id)"""))
def _(spark, sf):
    d = L.digest(copied_trace(spark, sf), DIGEST_COLUMNS)
    return L.same_play(copied_clips(spark, sf), d).select("match_id", "start", "end",
                                                          "same_play")


# copies that differ by 6e-7: neighbours are the same play, the first and the third are not
SHIFT = 6e-7


@query("play_partners", "J10", with_views(f"""SELECT c.match_id, c.start, p.partner, p.partner_start,
    coalesce(125-p.apart,0) AS shared FROM cc c LEFT JOIN (SELECT a.match_id, a.start, b.match_id AS partner,
    b.start AS partner_start, abs(a.start-b.start) AS apart, row_number() OVER (PARTITION BY a.match_id, a.start
    ORDER BY abs(a.start-b.start), b.match_id, b.start) AS k FROM cc a JOIN same s ON s.a=a.match_id JOIN cc b ON
    b.match_id=s.b AND abs(a.start-b.start)<125) p ON p.match_id=c.match_id AND p.start=c.start AND p.k=1""",
    **COPIES, moved=f"""SELECT match_id, frame, ball_x/1000.0::DOUBLE+(match_id%3)*{SHIFT!r}::DOUBLE AS x,
    ball_y/1000.0::DOUBLE AS y, ball_z/1000.0::DOUBLE AS z FROM trace""",
    same="""SELECT a.match_id AS a, b.match_id AS b FROM moved a JOIN moved b ON a.frame=b.frame AND a.match_id<>b.match_id
    AND abs(a.x-b.x)<=1e-6::DOUBLE AND abs(a.y-b.y)<=1e-6::DOUBLE AND abs(a.z-b.z)<=1e-6::DOUBLE JOIN lengths3 l ON l.match_id=a.match_id JOIN
    lengths3 m ON m.match_id=b.match_id AND m.n=l.n GROUP BY 1,2 HAVING count(*)=max(l.n)""",
    lengths3="SELECT match_id, count(*) AS n FROM trace GROUP BY 1",
    cc="SELECT 3*match_id+c AS match_id, ((3*match_id+c)*53)%300 AS start FROM lengths, (SELECT unnest(range(0,3)) AS c)"))
def _(spark, sf):
    real = [(F.col(f"ball_{a}") / U).alias(f"ball_{a}") for a in "yz"]
    moved = copied_trace(spark, sf).select("match_id", "frame", (
        F.col("ball_x") / U + F.col("match_id") % 3 * F.lit(SHIFT)).alias("ball_x"), *real)
    plays, near = L.near_plays(moved, ["ball_x", "ball_y", "ball_z"])
    return L.play_partners(copied_clips(spark, sf).select("match_id", "start"), plays, near)


# --- two versions of a batch: all best clips, and the best that never lose the ball ---
VIEWS["old_picks"] = """SELECT match_id, start, "end", count_last, cell, px, py, coh, startown,
    'clip_' || lpad(CAST(row_number() OVER (ORDER BY count_last, match_id) AS VARCHAR),2,'0')
    AS clip FROM clips"""
VIEWS["new_picks"] = """SELECT match_id, start, "end", count_last, cell, px, py, coh, startown,
    'clip_' || lpad(CAST(row_number() OVER (ORDER BY count_last, match_id) AS VARCHAR),2,'0')
    AS clip FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY coh, start) AS k
    FROM pool w WHERE NOT EXISTS (SELECT 1 FROM absent s WHERE s.match_id=w.match_id AND
    w.start<=hi AND lo<=w."end"-1)) WHERE k=1"""


def numbered(df):
    """Clip names in (count, match) order."""
    out = chunks.number_rows(session.cut_lineage(df), ["count_last", "match_id"], None, "k")
    name = F.when(F.col("k") < 9, F.lpad((F.col("k") + 1).cast("string"), 2, "0")).otherwise(
        (F.col("k") + 1).cast("string"))
    return out.withColumn("clip", F.concat(F.lit("clip_"), name)).drop("k")


def best(df):
    w = Window.partitionBy("match_id").orderBy("coh", "start")
    return df.withColumn("k", F.row_number().over(w)).where("k = 1").select(*POOL_COLUMNS)


def old_picks(spark, sf, p=None):
    return numbered(best(pool(spark, sf) if p is None else p))


def new_picks(spark, sf, p=None):
    p = pool(spark, sf) if p is None else p
    return numbered(best(L.outside_spans(p, X.absent(spark, sf), "overlap")))


def both_picks(spark, sf):
    """The two versions of the batch, from one written pool."""
    p = session.cut_lineage(pool(spark, sf))
    return old_picks(spark, sf, p), new_picks(spark, sf, p)


for _v in ("old_picks", "new_picks"):
    VIEWS[_v] = VIEWS[_v].replace("lpad(CAST(row_number() OVER (ORDER BY count_last, match_id) "
                                  "AS VARCHAR),2,'0')", "printf('%02d', row_number() OVER "
                                  "(ORDER BY count_last, match_id))")


@query("clip_numbers", "W25", with_views("SELECT clip, match_id, start, count_last FROM old_picks"))
def _(spark, sf):
    return old_picks(spark, sf).select("clip", "match_id", "start", "count_last")


@query("renumbering", "J11", with_views("""SELECT coalesce(o.match_id,n.match_id) AS match_id,
    coalesce(o.start,n.start) AS start, o.clip AS old_clip, n.clip AS new_clip,
    CASE WHEN o.clip IS NULL THEN 'newly built' WHEN n.clip IS NULL THEN 'dropped: ' ||
    CASE WHEN o.count_last<8 OR o.count_last>19 THEN 'outside the range' ELSE 'not selected' END
    ELSE 'kept, renumbered' END AS note FROM old_picks o FULL JOIN new_picks n
    ON o.match_id=n.match_id AND o.start=n.start"""))
def _(spark, sf):
    why = F.when(~F.col("count_last").between(8, 19), "outside the range")
    return L.renumbering(*both_picks(spark, sf), why, ["match_id", "start"])


@query("carried_measurements", "J12", with_views("""SELECT n.match_id, n.start, n.clip,
    o.count_last AS measured, o.clip IS NOT NULL AS moved FROM new_picks n LEFT JOIN old_picks o
    ON o.match_id=n.match_id AND o.start=n.start"""))
def _(spark, sf):
    old, new = both_picks(spark, sf)
    got, gone = L.carry_over(old.select("clip", F.col("count_last").alias("measured")), old, new,
                             ["match_id", "start"])
    return got.select("match_id", "start", "clip", "measured", F.lit(True).alias("moved")
                      ).unionByName(gone.select("match_id", "start", "clip",
                                                F.lit(None).cast("bigint").alias("measured"),
                                                F.lit(False).alias("moved")))


@query("clip_recipes", "J13", with_views("""SELECT o.clip, o.match_id, o.start,
    coalesce(d.digest,'') AS play_sha, coalesce(CAST(d.steps AS VARCHAR),'') AS steps
    FROM old_picks o LEFT JOIN digests d ON d.match_id=o.match_id AND o.match_id%4<>0""",
    digests=DIGEST_SQL))
def _(spark, sf):
    old = old_picks(spark, sf).select("clip", "match_id", "start")
    d = L.digest(X.trace(spark, sf), DIGEST_COLUMNS)
    # some clips have no provenance on record; their fields must come out empty
    prov = old.join(d, "match_id").where("match_id % 4 <> 0").select(
        "clip", F.col("digest").alias("play_sha"), "steps")
    return L.recipe(old, prov, ["play_sha", "steps"])


@query("version_differences", "J14 V6", with_views("""SELECT match_id, field, a, b,
    a IS NOT DISTINCT FROM b AS same FROM (SELECT o.match_id,
    unnest(['start','count_last','cell','startown']) AS field,
    unnest([CAST(o.start AS VARCHAR),CAST(o.count_last AS VARCHAR),o.cell,
      CAST(o.startown AS VARCHAR)]) AS a,
    unnest([CAST(n.start AS VARCHAR),CAST(n.count_last AS VARCHAR),n.cell,
      CAST(n.startown AS VARCHAR)]) AS b
    FROM old_picks o JOIN new_picks n ON o.match_id=n.match_id)"""))
def _(spark, sf):
    return L.compare_fields(*both_picks(spark, sf), ["match_id"],
                            ["start", "count_last", "cell", "startown"])


@query("paired_traces", "J15", with_views("""SELECT a.match_id, count(*) AS frames,
    min(a.frame) FILTER (NOT (a.ball_x=b.ball_x AND a.ball_y=b.ball_y AND a.ball_z=b.ball_z AND
      a.owned_team=b.owned_team AND a.owned_player=b.owned_player)) AS first_divergence,
    round(avg(sqrt(((a.ball_x-b.ball_x)*(a.ball_x-b.ball_x)+(a.ball_y-b.ball_y)*(a.ball_y-b.ball_y)
      )::DOUBLE)/1000.0::DOUBLE),6) AS mean_apart,
    max(sqrt(((a.ball_x-b.ball_x)*(a.ball_x-b.ball_x)+(a.ball_y-b.ball_y)*(a.ball_y-b.ball_y)
      )::DOUBLE)/1000.0::DOUBLE) AS max_apart,
    avg(CASE WHEN a.owned_team=b.owned_team THEN 1.0 ELSE 0.0 END)::DOUBLE AS possession_agreement
    FROM trace a JOIN (SELECT match_id, frame, CASE WHEN frame>100+match_id THEN ball_x+frame-100
    -match_id ELSE ball_x END AS ball_x, ball_y, ball_z, CASE WHEN frame>120+match_id THEN -1 ELSE
    owned_team END AS owned_team, owned_player FROM trace) b
    ON a.match_id=b.match_id AND a.frame=b.frame GROUP BY 1"""))
def _(spark, sf):
    a = X.trace(spark, sf)
    b = a.withColumn("ball_x", F.expr("case when frame > 100 + match_id then ball_x + frame - 100"
                                      " - match_id else ball_x end")).withColumn(
        "owned_team", F.expr("case when frame > 120 + match_id then -1 else owned_team end"))
    return L.compare_traces(a, b, unit=U)


@query("coverage_by_level", "J16 V5", with_views("""SELECT count_last,
    count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b,
    count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both FROM (SELECT
    coalesce(o.count_last,n.count_last) AS count_last, o.match_id AS a, n.match_id AS b FROM
    old_picks o FULL JOIN new_picks n ON o.match_id=n.match_id AND o.start=n.start AND
    o.count_last=n.count_last) GROUP BY 1"""))
def _(spark, sf):
    return L.coverage(*both_picks(spark, sf), ["match_id", "start"],
                      "count_last")


@query("verified_levels", "J18", with_views("""SELECT o.match_id, o.start,
    coalesce(n.count_first, o.count_last) AS count_last, n.count_first IS NOT NULL AS verified
    FROM clips o LEFT JOIN (SELECT * FROM pool WHERE startown=0) n ON n.match_id=o.match_id AND
    n.start=o.start"""))
def _(spark, sf):
    p = session.cut_lineage(pool(spark, sf))
    better = p.where("startown = 0").select("match_id", "start",
                                            F.col("count_first").alias("count_last"))
    return L.first_known(best(p).select("match_id", "start", "count_last"), better,
                         ["match_id", "start"], "count_last")


@query("unused_matches", "J19", with_views("""SELECT l.match_id, l.n FROM lengths l WHERE
    l.match_id NOT IN (SELECT match_id FROM clips)"""))
def _(spark, sf):
    return X.lengths(spark, sf).join(clips(spark, sf).select("match_id"), "match_id", "left_anti")


@query("wanted_end_frames", "J20", with_views("""SELECT DISTINCT w.match_id, w."end"-1 AS frame
    FROM open_windows w JOIN shown s ON s.match_id=w.match_id AND s.frame=w.start
    WHERE s.people BETWEEN 8 AND 19"""))
def _(spark, sf):
    w = L.with_end_counts(open_windows(spark, sf), X.inshot(spark, sf)).withColumnRenamed(
        "count_first", "level")
    return L.ends_wanted(w, list(range(8, 20)))


