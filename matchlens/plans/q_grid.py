"""Cells, bins, projections, names and keys."""
from __future__ import annotations

from pyspark.sql import functions as F

from matchlens import config as C
from matchlens.functions import grid as Gr
from matchlens.plans import fixtures as X
from matchlens.plans.oracle import slot_sql, with_views
from matchlens.plans.q_grading import cell_sql
from matchlens.plans.registry import query


@query("ball_cells", "P1", with_views(f"""SELECT match_id, frame, wrow || wcol AS cell_32x12,
    crow || ccol AS cell_16x6, erow || ecol AS cell_28x8 FROM (SELECT match_id, frame,
    {cell_sql(32, 12, 'w')}, {cell_sql(16, 6, 'c')}, {cell_sql(28, 8, 'e')} FROM ballpix)"""))
def _(spark, sf):
    px, py = F.col("px"), F.col("py")
    return X.ballpix(spark, sf).select("match_id", "frame", *[
        Gr.cell_of(px, py, c, r).alias(f"cell_{c}x{r}") for c, r in ((32, 12), (16, 6), (28, 8))])


@query("cell_centres", "P2 P3", with_views(f"""SELECT clip, grow || gcol AS cell, grow AS row_letter,
    gcol AS col, (gcol-1+0.5::DOUBLE)*80 AS cx, (ascii(grow)-65+0.5::DOUBLE)*80 AS cy FROM (
    SELECT clip, {cell_sql(prefix='g')} FROM truth)"""))
def _(spark, sf):
    t = X.truth(spark, sf).withColumn("cell", Gr.cell_of(F.col("px"), F.col("py")))
    letter, col = Gr.parse_label(F.col("cell"))
    cx, cy = Gr.cell_centre(F.ascii(letter) - 65, col - 1)
    return t.select("clip", "cell", letter.alias("row_letter"), col.alias("col"),
                    cx.alias("cx"), cy.alias("cy"))


@query("pitch_bins", "P4", with_views("""SELECT match_id, frame,
    CAST(greatest(0,least(5,trunc((ball_x/1000.0::DOUBLE+1.0::DOUBLE)/(2.0::DOUBLE/6)))) AS BIGINT)
    AS bin_col, CAST(greatest(0,least(3,trunc((ball_y/1000.0::DOUBLE+0.42::DOUBLE)
    /(0.84::DOUBLE/4)))) AS BIGINT) AS bin_row FROM trace"""))
def _(spark, sf):
    c, r = Gr.pitch_bin(F.col("ball_x") / 1000.0, F.col("ball_y") / 1000.0)
    return X.trace(spark, sf).select("match_id", "frame", c.alias("bin_col"), r.alias("bin_row"))


PROJECT_SQL = """CAST(trunc(60.0::DOUBLE+({x}/1000.0::DOUBLE+1.0::DOUBLE)/2.0::DOUBLE*1160) AS BIGINT)
    AS px, CAST(trunc(80.0::DOUBLE+({y}/1000.0::DOUBLE+0.42::DOUBLE)/0.84::DOUBLE*560) AS BIGINT)
    AS py"""


@query("pitch_pixels", "P5", with_views(f"""SELECT match_id, frame, px, py,
    greatest(0,least(31,px//40)) AS bin_col,
    greatest(0,least(11,CAST(floor((py-60)/40.0::DOUBLE) AS BIGINT))) AS bin_row FROM (
    SELECT match_id, frame, {PROJECT_SQL.format(x='ball_x', y='ball_y')} FROM trace)"""))
def _(spark, sf):
    x, y = F.col("ball_x") / 1000.0, F.col("ball_y") / 1000.0
    px, py = Gr.pitch_to_pixel(x, y)
    c, r = Gr.pixel_bin(x, y)
    return X.trace(spark, sf).select("match_id", "frame", px.alias("px"), py.alias("py"),
                                     c.alias("bin_col"), r.alias("bin_row"))


@query("grid_remap", "P6", with_views(f"""SELECT clip, grow || gcol AS cell,
    nrow AS new_row, ncol AS new_col, nrow || ncol AS new_cell FROM (SELECT clip,
    {cell_sql(prefix='g')}, {cell_sql(32, 12, 'n')} FROM truth)"""))
def _(spark, sf):
    px, py = F.col("px"), F.col("py")
    r, c = Gr.cell_index(px, py, 32, 12)
    return X.truth(spark, sf).select(
        "clip", Gr.cell_of(px, py).alias("cell"), Gr.letter(r).alias("new_row"),
        (c + 1).alias("new_col"), Gr.label(r, c).alias("new_cell"))


def _interp_sql(x: str) -> str:
    xs, ys = C.CAL_DPY, C.CAL_OFFY
    out = f"CASE WHEN {x}<={xs[0]}::DOUBLE THEN {ys[0]}::DOUBLE"
    for a, b, c, d in zip(xs, xs[1:], ys, ys[1:]):
        out += (f" WHEN {x}<={b}::DOUBLE THEN {(d - c) / (b - a)!r}::DOUBLE*({x}-({a}::DOUBLE))"
                f"+({c}::DOUBLE)")
    return out + f" ELSE {ys[-1]}::DOUBLE END"


@query("camera_offsets", "P7 P11", with_views(f"""SELECT match_id, frame, wx, wy,
    round(least(greatest(ox, -{C.ENVELOPE_X!r}::DOUBLE-wx), {C.ENVELOPE_X!r}::DOUBLE-wx),3)
    AS offset_x,
    round(least(greatest(oy, -{C.ENVELOPE_Y!r}::DOUBLE-wy), {C.ENVELOPE_Y!r}::DOUBLE-wy),3)
    AS offset_y FROM (
    SELECT *, least(greatest((tx-px-(-2.92::DOUBLE)*oy)/(-26.58::DOUBLE),-26.0::DOUBLE),
    26.0::DOUBLE) AS ox FROM (
    SELECT *, least(greatest({_interp_sql('dy')},-12.0::DOUBLE),12.0::DOUBLE) AS oy FROM (
    SELECT match_id, frame, px, py, ball_x/1000.0::DOUBLE*54.4::DOUBLE AS wx,
    ball_y/1000.0::DOUBLE*(-83.6::DOUBLE) AS wy,
    least(greatest((frame%16+0.5::DOUBLE)*80,55.0::DOUBLE),1225.0::DOUBLE) AS tx,
    least(greatest((frame%6+0.5::DOUBLE)*80,35.0::DOUBLE),445.0::DOUBLE)-py AS dy
    FROM (SELECT match_id, frame, ball_x, ball_y, (389*match_id+17*frame+211)%1280 AS px,
      (157*match_id+7*frame+97)%480 AS py FROM trace WHERE (frame+match_id)%11<>0))))"""))
def _(spark, sf):
    tr = X.trace(spark, sf).select(
        "match_id", "frame", (F.col("ball_x") / 1000.0 * C.WORLD_X).alias("wx"),
        (F.col("ball_y") / 1000.0 * C.WORLD_Y).alias("wy"))
    cx, cy = Gr.cell_centre(F.col("frame") % 6, F.col("frame") % 16)
    ox, oy = Gr.camera_offset(F.col("px"), F.col("py"), cx, cy, F.col("wx"), F.col("wy"))
    return X.ballpix(spark, sf).join(tr, ["match_id", "frame"]).select(
        "match_id", "frame", "wx", "wy", ox.alias("offset_x"), oy.alias("offset_y"))


@query("zones_and_crowding", "P8 P9 J9", with_views("""SELECT t.match_id, t.frame,
    CASE WHEN ball_x/1000.0::DOUBLE< -1.0::DOUBLE/3 THEN 'blue defensive third'
      WHEN ball_x/1000.0::DOUBLE>1.0::DOUBLE/3 THEN 'red defensive third' ELSE 'middle third' END
      AS zone, near_n, CASE WHEN near_n<2 THEN 'isolated' WHEN near_n<5 THEN 'contested'
      ELSE 'crowded' END AS crowding, CASE WHEN abs(ball_x/1000.0::DOUBLE*52.5::DOUBLE)<5 THEN
      'across the pitch' WHEN ball_x>0 THEN 'towards the red goal' ELSE 'towards the blue goal' END
      AS heading FROM (SELECT *, len(list_filter(range(0,22), lambda s:
        ({SLOT_X}-ball_x)*({SLOT_X}-ball_x)+({SLOT_Y}-ball_y)*({SLOT_Y}-ball_y)<3600)) AS near_n
        FROM trace) t""".replace("{SLOT_X}", slot_sql("s//11", "s%11")[0]).replace(
            "{SLOT_Y}", slot_sql("s//11", "s%11")[1])))
def _(spark, sf):
    from matchlens.functions import geometry as G
    x = F.col("ball_x") / 1000.0
    return (X.trace(spark, sf).withColumn("near_n", G.near_count(C.NEAR_RADIUS, X.UNIT)).select(
        "match_id", "frame", Gr.third(x).alias("zone"), "near_n",
        Gr.crowding(F.col("near_n")).alias("crowding"),
        Gr.direction(x * C.METRES_X).alias("heading")))


@query("named_codes", "P10", with_views("""SELECT match_id, frame,
    (['normal','kickoff','goalkick','freekick','corner','throwin','penalty'])[game_mode+1] AS mode,
    CASE owned_team WHEN 0 THEN 'blue' WHEN 1 THEN 'red' ELSE 'loose' END AS team,
    (['GK','RM','CF','LB','CB','CB','RB','CM','CM','CM','LM'])
    [CASE WHEN owned_player>=0 THEN owned_player+1 END] AS role,
    CASE owned_team WHEN 0 THEN '28,72,224' WHEN 1 THEN '214,32,32' END AS rgb FROM trace"""))
def _(spark, sf):
    roles = dict(enumerate(C.SLOT_ROLES))
    rgb = {k: ",".join(map(str, v)) for k, v in C.OUTFIELD_RGB.items()}
    return X.trace(spark, sf).select(
        "match_id", "frame", Gr.names(F.col("game_mode"), C.MODE_NAMES).alias("mode"),
        Gr.names(F.col("owned_team"), C.TEAM_COLOURS).alias("team"),
        Gr.names(F.col("owned_player"), roles).alias("role"),
        Gr.names(F.col("owned_team"), rgb).alias("rgb"))


@query("units", "P11", with_views("""SELECT match_id, frame,
    ball_x/1000.0::DOUBLE*52.5::DOUBLE AS x_m,
    ball_y/1000.0::DOUBLE*(34.0::DOUBLE/0.42::DOUBLE) AS y_m,
    ball_x/1000.0::DOUBLE*54.4::DOUBLE AS x_world, ball_y/1000.0::DOUBLE*(-83.6::DOUBLE) AS y_world,
    frame/25.0::DOUBLE AS t FROM trace"""))
def _(spark, sf):
    x, y = F.col("ball_x") / 1000.0, F.col("ball_y") / 1000.0
    return X.trace(spark, sf).select(
        "match_id", "frame", (x * C.METRES_X).alias("x_m"), (y * C.METRES_Y).alias("y_m"),
        (x * C.WORLD_X).alias("x_world"), (y * C.WORLD_Y).alias("y_world"),
        (F.col("frame") / float(C.FPS)).alias("t"))


@query("match_names", "P12 P13 P14", with_views("""SELECT match_id, match,
    CASE WHEN shape IN ('mid_even','mid_even2') THEN 'mid_bal' ELSE shape END || '_s' ||
    lpad(CAST(seed AS VARCHAR),3,'0') AS canonical,
    match || '_' || match_id || '_' || (match_id+125) AS window_key, match || '@' || match_id
    AS start_key, substr(md5(match || '|' || match_id || '|' || seed),1,10) AS item FROM named"""))
def _(spark, sf):
    d = X.named(X.lengths(spark, sf))
    return d.select(
        "match_id", Gr.match_key(F.col("shape"), F.col("seed")).alias("match"),
        Gr.canonical_match(F.col("match")).alias("canonical"),
        F.format_string("%s_%d_%d", "match", "match_id", F.col("match_id") + 125)
        .alias("window_key"), F.format_string("%s@%d", "match", "match_id").alias("start_key"),
        Gr.item_id(F.col("match"), F.col("match_id").cast("string"),
                   F.col("seed").cast("string")).alias("item"))


@query("grid_legends", "P21", with_views("""SELECT match_id, 'A yellow coordinate grid is overlaid on the video. Its ROWS are labelled A-' || chr(CAST(64+r AS INTEGER)) || ' from top to bottom (' || r || ' rows) and its COLUMNS are labelled 1-' || c || ' from left to right (' || c || ' columns). A cell is named <row-letter><column-number>, e.g. B2 is row B, column 2.' || chr(10) || chr(10) AS legend
    FROM (SELECT match_id, 4+match_id%9 AS r, 8+match_id%25 AS c FROM lengths)"""))
def _(spark, sf):
    return X.lengths(spark, sf).select("match_id", Gr.legend(
        F.col("match_id") % 25 + 8, F.col("match_id") % 9 + 4).alias("legend"))
