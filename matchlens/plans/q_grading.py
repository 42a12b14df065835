"""Answer parsing, grading, scoreboards."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from matchlens.functions import grid as Gr, text as T
from matchlens.operators import grade as A
from matchlens.plans import fixtures as X
from matchlens.plans.oracle import VIEWS, with_views
from matchlens.plans.registry import query

CELL_SQL = """chr(CAST(65+least(greatest(floor(py/({h}::DOUBLE/{r})),0),{r}-1) AS INTEGER)) AS {p}row,
    CAST(least(greatest(floor(px/(1280::DOUBLE/{c})),0),{c}-1)+1 AS BIGINT) AS {p}col"""


def cell_sql(cols: int = 16, rows: int = 6, prefix: str = "") -> str:
    return CELL_SQL.format(h=480, c=cols, r=rows, p=prefix)


VIEWS["keyed"] = f"SELECT *, grow || gcol AS gcell FROM (SELECT clip, px, py, {cell_sql(prefix='g')} FROM truth)"
VIEWS["parsed"] = r"""SELECT a.*, m[1] AS _ok, CASE WHEN m IS NOT NULL THEN upper(m[1]) END AS prow,
    CASE WHEN m IS NOT NULL THEN CAST(regexp_extract(m,'([0-9]{1,2})$',1) AS BIGINT) END AS pcol
    FROM (SELECT *, list_filter(regexp_extract_all(part, '([A-Za-z])\s*[-, ]?\s*([0-9]{1,2})'),
      lambda x: upper(x[1]) BETWEEN 'A' AND 'F' AND
      CAST(regexp_extract(x,'([0-9]{1,2})$',1) AS BIGINT) BETWEEN 1 AND 16)[1] AS m FROM (
    SELECT *, CASE WHEN seg<>'' THEN seg ELSE raw END AS part FROM (
    SELECT *, regexp_extract(raw, '(?i)Ball position:\s*([^\n]+)', 1) AS seg FROM answers))) a"""
VIEWS["cell_grades"] = """SELECT *, CASE WHEN known THEN row_e=0 AND col_e=0 END AS correct,
    CASE WHEN known THEN row_e END AS row_err, CASE WHEN known THEN col_e END AS col_err,
    CASE WHEN known THEN round(sqrt((row_e*row_e+col_e*col_e)::DOUBLE),2) END AS cell_dist FROM (
    SELECT p.event_id, p.model, p.clip, p.raw, prow || pcol AS pred_cell, gcell AS gt_cell,
    prow IS NOT NULL AND grow IS NOT NULL AS known, abs(ascii(prow)-ascii(grow))::BIGINT AS row_e,
    abs(pcol-gcol) AS col_e FROM parsed p LEFT JOIN keyed k USING (clip))"""


def keyed(spark, sf, cols=16, rows=6):
    t = X.truth(spark, sf)
    r, c = Gr.cell_index(F.col("px"), F.col("py"), cols, rows)
    return t.select("clip", "px", "py", Gr.letter(r).alias("grow"), (c + 1).alias("gcol"),
                    Gr.label(r, c).alias("gcell"))


def cell_grades(spark, sf):
    ans = X.answers(spark, sf).withColumn("pred", T.parse_cell(F.col("raw"), 16, 6))
    j = A.with_truth(ans, keyed(spark, sf))
    g = A.grade_cell(F.col("pred.row"), F.col("pred.col"), F.col("grow"), F.col("gcol"))
    return j.select("event_id", "model", "clip", "raw", F.col("pred.cell").alias("pred_cell"),
                    F.col("gcell").alias("gt_cell"), *[v.alias(k) for k, v in g.items()])


@query("parse_strict_cell", "R1", with_views(
    "SELECT event_id, prow || pcol AS pred_cell, prow AS pred_row, pcol AS pred_col FROM parsed"))
def _(spark, sf):
    p = T.parse_cell(F.col("raw"), 16, 6)
    return X.answers(spark, sf).withColumn("p", p).select(
        "event_id", F.col("p.cell").alias("pred_cell"), F.col("p.row").alias("pred_row"),
        F.col("p.col").alias("pred_col"))


TOLERANT = r"""SELECT {key}, CASE WHEN lr<>'' AND lc BETWEEN 1 AND 16 THEN lr || lc
    WHEN nums[1]::BIGINT BETWEEN 1 AND 6 AND nums[2]::BIGINT BETWEEN 1 AND 16
    THEN chr(CAST(64+nums[1]::BIGINT AS INTEGER)) || nums[2]::BIGINT END AS pred_cell FROM (
    SELECT *, upper(regexp_extract(part,'([A-Fa-f])[^0-9]{{0,12}}?([0-9]{{1,2}})',1)) AS lr,
    TRY_CAST(regexp_extract(part,'([A-Fa-f])[^0-9]{{0,12}}?([0-9]{{1,2}})',2) AS BIGINT) AS lc,
    regexp_extract_all(part,'([0-9]{{1,2}})',1) AS nums FROM (SELECT *, CASE WHEN seg<>'' THEN seg
    ELSE raw END AS part FROM (SELECT *, regexp_extract(raw,'(?i)Ball position:\s*([^\n]+)',1)
    AS seg FROM {src})))"""


@query("parse_tolerant_cell", "R2", with_views(TOLERANT.format(key="event_id", src="answers")))
def _(spark, sf):
    return X.answers(spark, sf).select(
        "event_id", T.parse_cell_tolerant(F.col("raw"), 16, 6)["cell"].alias("pred_cell"))


@query("parse_cells_in_documents", "R2", with_views(TOLERANT.format(
    key="doc_id", src="(SELECT CAST(doc_id AS BIGINT) AS doc_id, text AS raw FROM documents)")))
def _(spark, sf):
    return X.table(spark, sf, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        T.parse_cell_tolerant(F.col("text"), 16, 6)["cell"].alias("pred_cell"))


@query("parse_bins", "R3", with_views(r"""SELECT event_id,
    TRY_CAST(regexp_extract(t,'(?i)col[^0-9]{0,5}([0-9])[^0-9]{0,10}row[^0-9]{0,5}([0-9])',1)
    AS BIGINT) AS pred_col,
    TRY_CAST(regexp_extract(t,'(?i)col[^0-9]{0,5}([0-9])[^0-9]{0,10}row[^0-9]{0,5}([0-9])',2)
    AS BIGINT) AS pred_row FROM (SELECT event_id, raw || chr(10) || 'Col ' || (event_id%13) ||
    ', row: ' || (event_id%7) AS t FROM answers)"""))
def _(spark, sf):
    t = F.concat("raw", F.lit("\nCol "), (F.col("event_id") % 13).cast("string"),
                 F.lit(", row: "), (F.col("event_id") % 7).cast("string"))
    c, r = T.parse_bin(t)
    return X.answers(spark, sf).select("event_id", c.alias("pred_col"), r.alias("pred_row"))


@query("cell_grades", "R4 J1 R11", with_views("SELECT * EXCLUDE (known, row_e, col_e) "
                                              "FROM cell_grades"))
def _(spark, sf):
    return cell_grades(spark, sf)


@query("scoreboard", "A14", with_views("""SELECT model, batch,
    count(correct) AS n, count(*) FILTER (correct) AS exact,
    count(*) FILTER (row_err<=1 AND col_err<=1) AS within1,
    round(avg(cell_dist),6) AS mean_dist, count(*) FILTER (pred_cell IS NULL) AS unparsed
    FROM (SELECT *, clip%2 AS batch FROM cell_grades) GROUP BY ROLLUP (model, batch)"""))
def _(spark, sf):
    g = cell_grades(spark, sf).withColumn("batch", F.col("clip") % 2)
    return A.scoreboard(g, ["model", "batch"])


@query("error_rows", "R11", with_views("""SELECT model, count(*) AS errors,
    count(*) FILTER (pred_cell IS NULL) AS unparsed, count(correct) AS graded FROM cell_grades
    WHERE starts_with(raw,'ERROR:') GROUP BY 1"""))
def _(spark, sf):
    return cell_grades(spark, sf).where(T.is_error(F.col("raw"))).groupBy("model").agg(
        F.count(F.lit(1)).alias("errors"),
        F.count(F.when(F.col("pred_cell").isNull(), 1)).alias("unparsed"),
        F.count("correct").alias("graded"))


SPLIT_SQL = r"""CASE WHEN rs<>'' THEN regexp_replace(rs,'^\s+|\s+$','','g')
    ELSE replace(raw,chr(10),' ') END AS reasoning,
    CASE WHEN ps<>'' THEN regexp_replace(ps,'^\s+|\s+$','','g') ELSE '(not in expected format)'
    END AS position"""


@query("reasoning_split", "R10", with_views(rf"""SELECT event_id, {SPLIT_SQL} FROM (SELECT *,
    regexp_extract(raw,'(?i)Reasoning:\s*([^\n]+)',1) AS rs,
    regexp_extract(raw,'(?i)Ball position:\s*([^\n]+)',1) AS ps FROM answers)"""))
def _(spark, sf):
    return X.answers(spark, sf).select("event_id", T.reasoning(F.col("raw")).alias("reasoning"),
                                       T.position(F.col("raw")).alias("position"))


@query("flat_predictions", "R14", with_views(r"""SELECT event_id, clip, gt_cell AS true_cell,
    coalesce(pred_cell,'') AS predicted_cell, coalesce(correct,false) AS correct,
    cell_dist AS miss_cells, replace(regexp_replace(split_part(CASE WHEN
    contains(raw,'Reasoning:') THEN substr(raw, strpos(raw,'Reasoning:')+10) ELSE raw END,
    'Ball position:',1),'^\s+|\s+$','','g'),chr(10),' ') AS reasoning FROM cell_grades"""))
def _(spark, sf):
    return cell_grades(spark, sf).select(
        "event_id", "clip", F.col("gt_cell").alias("true_cell"),
        F.coalesce("pred_cell", F.lit("")).alias("predicted_cell"),
        F.coalesce("correct", F.lit(False)).alias("correct"),
        F.col("cell_dist").alias("miss_cells"), T.between_marks(F.col("raw")).alias("reasoning"))


# --- answers of five categories, built on the conversation turns ---
VIEWS["category_answers"] = """SELECT item_id, category, CASE WHEN category='inference' AND
    item_id%2=0 THEN 'region_occluded' WHEN category='inference' THEN 'ball_bin' ELSE '' END
    AS subtask, CASE WHEN category='prediction' AND item_id%4<3 THEN 'Will either side score?'
    WHEN category='prediction' THEN 'Where will the ball be?'
    WHEN item_id%3=0 THEN 'How many players on the LEFT?'
    WHEN item_id%3=1 THEN 'How many players on the right?' ELSE 'How many players in all?' END
    AS question, CASE item_id%4 WHEN 0 THEN text
    WHEN 1 THEN 'I count ' || (item_id%23) || ' players. ' || text
    WHEN 2 THEN 'Answer: ' || chr(CAST(65+item_id%5 AS INTEGER)) || '. ' || text
    ELSE 'Yes, they will score. ' || text END AS answer,
    item_id%23 AS n_left, item_id%11 AS n_right, item_id%23+item_id%11 AS n_total,
    item_id%7=0 AS left_scored, item_id%5=0 AS right_scored, 'bin ' || (item_id%24) AS end_bin,
    item_id%23 AS region_count,
    (['a_add_attacker','b_remove_defender','c_ball_forward','d_no_change','none'])[item_id%5+1]
    AS best_intervention, 'rank ' || (item_id%3) AS responsibility_rank FROM (
    SELECT *, (['description','prediction','inference','hypothetical','counterfactual'])
    [(item_id//4)%5+1] AS category FROM (SELECT CAST(conv_id*64+turn AS BIGINT) AS item_id, text
    FROM conversations))"""
VIEWS["category_grades"] = r"""SELECT item_id, category, CASE category
    WHEN 'description' THEN num
    WHEN 'prediction' THEN CASE WHEN about THEN CAST(yes AS VARCHAR) ELSE answer END
    WHEN 'inference' THEN CASE WHEN subtask='region_occluded' THEN num
      ELSE answer END
    WHEN 'hypothetical' THEN pick ELSE answer END AS predicted, CASE category
    WHEN 'description' THEN CAST(want AS VARCHAR)
    WHEN 'prediction' THEN CASE WHEN about THEN CAST(left_scored OR right_scored AS VARCHAR)
      ELSE end_bin END
    WHEN 'inference' THEN CASE WHEN subtask='region_occluded' THEN CAST(region_count AS VARCHAR)
      ELSE 'coordinate/bin' END
    WHEN 'hypothetical' THEN best ELSE responsibility_rank END AS expected, CASE category
    WHEN 'description' THEN coalesce(num=CAST(want AS VARCHAR),false)
    WHEN 'prediction' THEN CASE WHEN about THEN yes=(left_scored OR right_scored) END
    WHEN 'inference' THEN CASE WHEN subtask='region_occluded' THEN coalesce(num=CAST(region_count AS VARCHAR),false)
      END WHEN 'hypothetical' THEN pick=best END AS correct FROM (SELECT *,
    nullif(regexp_replace(regexp_extract(answer,'(?:^|[^\p{L}\p{N}_])([0-9]+)(?:[^\p{L}\p{N}_]|$)',1),
      '^0+([0-9])','\1'),'') AS num,
    nullif(regexp_extract(upper(answer),'(?:^|[^\p{L}\p{N}_])([ABCD])(?:[^\p{L}\p{N}_]|$)',1),'')
      AS pick, contains(lower(question),'score') AS about,
    contains(lower(answer),'yes') OR contains(lower(answer),'will score') OR
      contains(lower(answer),'goal') AS yes,
    CASE WHEN contains(lower(question),'left') THEN n_left WHEN contains(lower(question),'right')
      THEN n_right ELSE n_total END AS want,
    CASE best_intervention WHEN 'a_add_attacker' THEN 'A' WHEN 'b_remove_defender' THEN 'B'
      WHEN 'c_ball_forward' THEN 'C' WHEN 'd_no_change' THEN 'D' END AS best
    FROM category_answers)"""


def category_answers(spark, sf):
    t = X.table(spark, sf, "conversations").select(
        F.expr("cast(conv_id * 64 + turn as bigint)").alias("item_id"), "text")
    i = "item_id"
    t = t.withColumn("category", F.expr(
        f"element_at(array('description','prediction','inference','hypothetical',"
        f"'counterfactual'), cast(({i} div 4) % 5 + 1 as int))"))
    return t.select(
        i, "category",
        F.expr(f"case when category='inference' and {i}%2=0 then 'region_occluded' "
               "when category='inference' then 'ball_bin' else '' end").alias("subtask"),
        F.expr(f"case when category='prediction' and {i}%4<3 then 'Will either side score?' "
               "when category='prediction' then 'Where will the ball be?' "
               f"when {i}%3=0 then 'How many players on the LEFT?' when {i}%3=1 then "
               "'How many players on the right?' else 'How many players in all?' end")
        .alias("question"),
        F.expr(f"case {i}%4 when 0 then text when 1 then concat('I count ', {i}%23, "
               f"' players. ', text) when 2 then concat('Answer: ', char(65+{i}%5), '. ', text) "
               "else concat('Yes, they will score. ', text) end").alias("answer"),
        F.expr(f"""struct({i}%23 as n_left, {i}%11 as n_right, {i}%23+{i}%11 as n_total,
            {i}%7=0 as left_scored, {i}%5=0 as right_scored, concat('bin ', {i}%24) as end_bin,
            {i}%23 as region_count, element_at(array('a_add_attacker','b_remove_defender',
            'c_ball_forward','d_no_change','none'), cast({i}%5+1 as int)) as best_intervention,
            concat('rank ', {i}%3) as responsibility_rank)""").alias("truth"))


def category_grades(spark, sf):
    return A.grade_categories(category_answers(spark, sf)).select(
        "item_id", "category", "grade.predicted", "grade.expected", "grade.correct")


@query("category_grades", "R5 R6 R7 R8 R9 U2", with_views("SELECT * FROM category_grades"))
def _(spark, sf):
    return category_grades(spark, sf)


@query("category_summary", "A15", with_views("""SELECT category, correct, wrong, ungraded,
    CASE WHEN correct+wrong=0 THEN 'n/a' ELSE correct || '/' || (correct+wrong) END AS accuracy
    FROM (SELECT category, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS
    wrong, count(*) FILTER (correct IS NULL) AS ungraded FROM category_grades GROUP BY 1)"""))
def _(spark, sf):
    return A.category_summary(category_grades(spark, sf), ["category"])


@query("user_graded_answers", "U2", with_views("""SELECT event_id,
    raw LIKE '%' || gcell || '%' AS correct FROM answers LEFT JOIN keyed USING (clip)"""))
def _(spark, sf):
    import pandas as pd

    def mentions(answer: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([None if e is None else e in a for a, e in zip(answer, expected)],
                         dtype="object")
    build = A.user_grader(mentions)
    j = A.with_truth(X.answers(spark, sf), keyed(spark, sf)).withColumn(
        "truth", F.struct(F.col("gcell").alias("expected")))
    _, _, ok = build(F.col("raw"), F.lit(""), F.lit(""), F.col("truth"))
    return j.select("event_id", ok.alias("correct"))


@query("probe_questions", "R12 U3", with_views("""SELECT category, item_id, '' AS subtask,
    unnest([text, 'Again: ' || text]) AS question FROM items WHERE category IN
    ('description','prediction')
    UNION ALL SELECT category, item_id, unnest(['region_occluded','ball_bin']),
    unnest(['Count: ' || text, 'Where: ' || text]) FROM items WHERE category='inference'
    UNION ALL SELECT category, item_id, '', text || chr(10) || 'A=add attacker  B=remove defender'
    || '  C=ball forward  D=no change' || chr(10) || 'ANSWER: ' FROM items
    WHERE category='hypothetical'
    UNION ALL SELECT category, item_id, '', q || chr(10) || 'ANSWER: ' FROM (SELECT category,
    item_id, unnest([text, 'Again: ' || text]) AS q FROM items WHERE category='counterfactual')""",
    items="""SELECT CAST(doc_id AS BIGINT) AS item_id, text, (['description','prediction',
    'inference','hypothetical','counterfactual'])[doc_id%5+1] AS category FROM documents"""))
def _(spark, sf):
    items = X.table(spark, sf, "documents").select(
        F.col("doc_id").cast("bigint").alias("item_id"),
        F.expr("element_at(array('description','prediction','inference','hypothetical',"
               "'counterfactual'), cast(doc_id % 5 + 1 as int))").alias("category"),
        F.array("text", F.concat(F.lit("Again: "), "text")).alias("questions"),
        F.create_map(F.lit("region_occluded"), F.concat(F.lit("Count: "), "text"),
                     F.lit("ball_bin"), F.concat(F.lit("Where: "), "text")).alias("subtasks"))
    return A.probes(items)


@query("rejected_requests", "R13", with_views("""SELECT model AS name, count(*) AS requests
    FROM answers WHERE model NOT IN ('click','view','purchase') GROUP BY 1"""))
def _(spark, sf):
    return A.unknown(X.answers(spark, sf), "model", ["click", "view", "purchase"])


@query("answers_by_clip_order", "T3", with_views("""SELECT model, clip, event_id FROM (SELECT *,
    row_number() OVER (PARTITION BY model ORDER BY clip, event_id) AS k FROM answers)
    WHERE k<=30"""))
def _(spark, sf):
    w = Window.partitionBy("model").orderBy("clip", "event_id")
    return (X.answers(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 30")
            .select("model", "clip", "event_id"))


# Batches of answers by event type, each with the grid of its truth.
GRIDS = {"click": (16, 6), "view": (32, 12), "purchase": (28, 8), "signup": (8, 3), "error": (16, 6)}


def batch_scores_sql() -> str:
    parts, extra = [], {}
    for b, (c, r) in GRIDS.items():
        last = chr(64 + r)
        extra[f"key_{b}"] = (f"SELECT clip, grow, gcol FROM (SELECT clip, "
                             f"{cell_sql(c, r, 'g')} FROM truth)")
        extra[f"parsed_{b}"] = (VIEWS["parsed"].replace("BETWEEN 1 AND 16", f"BETWEEN 1 AND {c}")
                                .replace("'A' AND 'F'", f"'A' AND '{last}'"))
        parts.append(f"""SELECT '{b}' AS batch, count(*) AS answers, count(prow) AS parsed,
            count(*) FILTER (prow=grow AND pcol=gcol) AS exact FROM parsed_{b} LEFT JOIN key_{b}
            USING (clip) WHERE model='{b}'""")
    return with_views(" UNION ALL ".join(parts), **extra)


@query("batch_scores", "U4 J1", batch_scores_sql())
def _(spark, sf):
    return A.batch_scores(X.answers(spark, sf), X.truth(spark, sf), GRIDS)


# The same batches with keys of three layouts: pixels, rows and columns as written, names of cells.
LOADERS = {"click": "pixels", "view": "written", "purchase": "names", "signup": "pixels", "error": "written"}


def loaded_scores_sql() -> str:
    parts, extra = [], {}
    for b, (c, r) in GRIDS.items():
        last = chr(64 + r)
        # written keys are those of the usual grid, whatever the grid of the batch; pixels are put into it
        kc, kr = (c, r) if LOADERS[b] == "pixels" else (16, 6)
        extra[f"lkey_{b}"] = f"""SELECT clip, grow, gcol FROM (SELECT clip, {cell_sql(kc, kr, 'g')} FROM truth)
            WHERE grow BETWEEN 'A' AND '{last}' AND gcol BETWEEN 1 AND {c}"""
        extra[f"parsed_{b}"] = (VIEWS["parsed"].replace("BETWEEN 1 AND 16", f"BETWEEN 1 AND {c}")
                                .replace("'A' AND 'F'", f"'A' AND '{last}'"))
        parts.append(f"""SELECT '{b}' AS batch, count(*) AS answers, count(prow) AS parsed, count(grow) AS known,
            count(*) FILTER (prow=grow AND pcol=gcol) AS exact FROM parsed_{b} LEFT JOIN lkey_{b}
            USING (clip) WHERE model='{b}'""")
    return with_views(" UNION ALL ".join(parts), **extra)


@query("loaded_batch_scores", "U4 J1", loaded_scores_sql())
def _(spark, sf):
    from matchlens.functions import grid as Gr
    pixels = X.truth(spark, sf)
    row, col = Gr.cell_index(F.col("px"), F.col("py"), 16, 6)
    written = pixels.select("clip", F.lower(Gr.letter(row)).alias("grid_row"), (col + 1).alias("grid_col"))
    names = pixels.select("clip", F.concat(F.lit(" "), Gr.letter(row), (col + 1).cast("string")).alias("ball_cell"))
    tables = {"pixels": pixels, "written": written, "names": names}
    return A.scores_of_batches(X.answers(spark, sf), {b: (LOADERS[b], tables[LOADERS[b]], c, r) for b, (c, r) in GRIDS.items()})
