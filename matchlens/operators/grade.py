"""Answers against truth: joins, graders, scoreboards."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from matchlens.functions import grid, text as T


def with_truth(answers: DataFrame, truth: DataFrame, key: str = "clip") -> DataFrame:
    """Answers keep their row when the clip has no truth. Truth holds one row per clip, so a
    clip with a great share of the answers only skews the answer side, which adaptive
    execution splits."""
    return answers.join(truth, key, "left")


def grade_cell(pred_row: Column, pred_col: Column, row: Column, col: Column) -> dict[str, Column]:
    """correct, row_err, col_err, cell_dist; all null when unparsed or without truth."""
    known = pred_row.isNotNull() & row.isNotNull()
    row_err = F.abs(F.ascii(pred_row) - F.ascii(row)).cast("bigint")
    col_err = F.abs(pred_col - col)
    dist = F.sqrt((row_err * row_err + col_err * col_err).cast("double"))
    return {"correct": F.when(known, (row_err == 0) & (col_err == 0)),
            "row_err": F.when(known, row_err), "col_err": F.when(known, col_err),
            "cell_dist": F.when(known, F.round(dist, 2))}


def scoreboard(graded: DataFrame, by: list[str], total: bool = True) -> DataFrame:
    """n, exact, within1 and mean_dist over graded rows; unparsed over all rows."""
    ok = F.col("correct").isNotNull()
    aggs = [F.count(F.when(ok, 1)).alias("n"),
            F.count(F.when(F.col("correct"), 1)).alias("exact"),
            F.count(F.when(ok & (F.col("row_err") <= 1) & (F.col("col_err") <= 1), 1))
            .alias("within1"),
            F.round(F.avg(F.when(ok, F.col("cell_dist"))), 6).alias("mean_dist"),
            F.count(F.when(F.col("pred_cell").isNull(), 1)).alias("unparsed")]
    return graded.rollup(*by).agg(*aggs) if total else graded.groupBy(*by).agg(*aggs)


def batch_scores(answers: DataFrame, truth: DataFrame, grids: dict[str, tuple[int, int]]) -> DataFrame:
    """batch, answers, parsed and exact per registered batch, in one pass over the answers.

    A batch (``model``) has its own grid; the truth in pixels is turned into the cells of each."""
    pred = F.lit(None).cast("struct<cell:string,row:string,col:bigint>")
    want = F.lit(None).cast("struct<row:string,col:bigint>")
    for batch, (cols, rows) in grids.items():
        r, c = grid.cell_index(F.col("px"), F.col("py"), cols, rows)
        mine = F.col("model") == batch
        pred = F.when(mine, T.parse_cell(F.col("raw"), cols, rows)).otherwise(pred)
        want = F.when(mine, F.struct(grid.letter(r).alias("row"), (c + 1).cast("bigint").alias("col"))).otherwise(want)
    known = answers.where(F.col("model").isin(*grids)).withColumn("pred", pred)
    j = with_truth(known, truth).withColumn("want", want)
    exact = (F.col("pred.row") == F.col("want.row")) & (F.col("pred.col") == F.col("want.col"))
    return j.groupBy(F.col("model").alias("batch")).agg(
        F.count(F.lit(1)).alias("answers"), F.count("pred.cell").alias("parsed"), F.count(F.when(exact, 1)).alias("exact"))


# --- batches with their own truth ---
def cells_from_pixels(rows: DataFrame, cols: int, grid_rows: int) -> DataFrame:
    """(clip, row, col) from pixels (clip, px, py), for a key that was made for another grid."""
    r, c = grid.cell_index(F.col("px"), F.col("py"), cols, grid_rows)
    return rows.select("clip", grid.letter(r).alias("row"), (c + 1).cast("bigint").alias("col"))


def cells_as_written(rows: DataFrame, cols: int, grid_rows: int) -> DataFrame:
    """(clip, row, col) from a key with its own row letter and column; cells outside the grid are no truth."""
    got = rows.select("clip", F.upper(F.trim("grid_row")).alias("row"), F.col("grid_col").cast("bigint").alias("col"))
    return got.where((F.col("row") >= "A") & (F.col("row") <= chr(64 + grid_rows)) & F.col("col").between(1, cols))


def cells_from_names(rows: DataFrame, cols: int, grid_rows: int) -> DataFrame:
    """(clip, row, col) from cell names such as ``D5``."""
    name = F.upper(F.trim("ball_cell"))
    return cells_as_written(rows.select("clip", F.substring(name, 1, 1).alias("grid_row"), F.expr(
        "try_cast(substring(upper(trim(ball_cell)), 2) as bigint)").alias("grid_col")), cols, grid_rows)


TRUTH_LOADERS: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {
    "pixels": cells_from_pixels, "written": cells_as_written, "names": cells_from_names}


def batch_truth(batches: dict[str, tuple[str, DataFrame, int, int]], loaders: dict | None = None) -> DataFrame:
    """(batch, clip, row, col): the truths of all batches, each by its loader. A batch is (loader, its table, columns, rows)."""
    out = None
    for batch, (loader, rows, cols, grid_rows) in batches.items():
        part = (loaders or TRUTH_LOADERS)[loader](rows, cols, grid_rows).select(F.lit(batch).alias("batch"), "clip", "row", "col")
        out = part if out is None else out.unionByName(part)
    return out


def scores_of_batches(answers: DataFrame, batches: dict[str, tuple[str, DataFrame, int, int]], loaders: dict | None = None) -> DataFrame:
    """batch, answers, parsed, known (with a truth) and exact: answers are parsed in the grid of their batch
    (``model``) and joined once with the truths of all batches."""
    pred = F.lit(None).cast("struct<cell:string,row:string,col:bigint>")
    for batch, (_, _, cols, grid_rows) in batches.items():
        pred = F.when(F.col("model") == batch, T.parse_cell(F.col("raw"), cols, grid_rows)).otherwise(pred)
    known = answers.where(F.col("model").isin(*batches)).select(F.col("model").alias("batch"), "clip", pred.alias("pred"))
    j = known.join(batch_truth(batches, loaders), ["batch", "clip"], "left")
    exact = (F.col("pred.row") == F.col("row")) & (F.col("pred.col") == F.col("col"))
    return j.groupBy("batch").agg(F.count(F.lit(1)).alias("answers"), F.count("pred.cell").alias("parsed"),
                                  F.count("row").alias("known"), F.count(F.when(exact, 1)).alias("exact"))


def category_summary(graded: DataFrame, by: list[str]) -> DataFrame:
    correct = F.count(F.when(F.col("correct"), 1))
    wrong = F.count(F.when(~F.col("correct"), 1))
    return graded.groupBy(*by).agg(
        correct.alias("correct"), wrong.alias("wrong"),
        F.count(F.when(F.col("correct").isNull(), 1)).alias("ungraded")).withColumn(
        "accuracy", F.when(F.col("correct") + F.col("wrong") == 0, F.lit("n/a")).otherwise(
            F.concat(F.col("correct").cast("string"), F.lit("/"),
                     (F.col("correct") + F.col("wrong")).cast("string"))))


# A grader maps (answer, question, subtask, truth struct) to (predicted, expected, correct),
# predicted and expected as text.
Grader = Callable[[Column, Column, Column, Column], tuple[Column, Column, Column]]


# --- fixed value: what is expected of an open region question ---
OPEN_REGION = "coordinate/bin"


def _as_text(c: Column) -> Column:
    return c.cast("string")


def grade_count(answer, question, subtask, truth):
    pred = T.first_number(answer)
    q = F.lower(question)
    want = (F.when(q.contains("left"), truth["n_left"])
            .when(q.contains("right"), truth["n_right"]).otherwise(truth["n_total"]))
    return pred, _as_text(want), F.coalesce(pred == _as_text(want), F.lit(False))


def grade_score(answer, question, subtask, truth):
    low = F.lower(answer)
    yes = low.contains("yes") | low.contains("will score") | low.contains("goal")
    want = truth["left_scored"] | truth["right_scored"]
    about = F.lower(question).contains("score")
    return (F.when(about, _as_text(yes)).otherwise(answer),
            F.when(about, _as_text(want)).otherwise(truth["end_bin"]),
            F.when(about, yes == want))


def grade_region(answer, question, subtask, truth):
    pred = T.first_number(answer)
    about = subtask == "region_occluded"
    want = _as_text(truth["region_count"])
    return (F.when(about, pred).otherwise(answer),
            F.when(about, want).otherwise(F.lit(OPEN_REGION)),
            F.when(about, F.coalesce(pred == want, F.lit(False))))


# --- fixed values: intervention labels, question suffix ---
CHOICE_SUFFIX = "\nA=add attacker  B=remove defender  C=ball forward  D=no change\nANSWER: "
CHOICES = {"a_add_attacker": "A", "b_remove_defender": "B", "c_ball_forward": "C",
           "d_no_change": "D"}


def grade_choice(answer, question, subtask, truth):
    pred = T.first_choice(answer)
    want = F.lit(None).cast("string")
    for name, letter in CHOICES.items():
        want = F.when(truth["best_intervention"] == name, F.lit(letter)).otherwise(want)
    return pred, want, pred == want


def grade_pass_through(answer, question, subtask, truth):
    return answer, truth["responsibility_rank"], F.lit(None).cast("boolean")


GRADERS: dict[str, Grader] = {
    "description": grade_count, "prediction": grade_score, "inference": grade_region,
    "hypothetical": grade_choice, "counterfactual": grade_pass_through}


def grade_categories(answers: DataFrame, graders: dict[str, Grader] | None = None) -> DataFrame:
    """Grade (category, question, subtask, answer, truth) rows by their category's grader."""
    out = F.lit(None).cast("struct<predicted:string,expected:string,correct:boolean>")
    for cat, fn in (graders or GRADERS).items():
        p, e, c = fn(F.col("answer"), F.col("question"), F.col("subtask"), F.col("truth"))
        out = F.when(F.col("category") == cat, F.struct(
            p.alias("predicted"), e.alias("expected"), c.alias("correct"))).otherwise(out)
    return answers.withColumn("grade", out)


def user_grader(fn, name: str = "user") -> Grader:
    """Wrap a pandas function (answers, expected -> booleans) as a grader."""
    judge = F.pandas_udf(fn, "boolean", F.PandasUDFType.SCALAR)

    def build(answer, question, subtask, truth):
        return answer, truth["expected"], judge(answer, truth["expected"])
    build.__name__ = name
    return build


# --- probe expansion ---
def _array_probes(items: DataFrame) -> DataFrame:
    return items.select("category", "item_id", F.lit("").alias("subtask"),
                        F.explode("questions").alias("question"))


def _map_probes(items: DataFrame) -> DataFrame:
    return items.select("category", "item_id",
                        F.explode("subtasks").alias("subtask", "question"))


def _choice_probes(items: DataFrame) -> DataFrame:
    return items.select("category", "item_id", F.lit("").alias("subtask"),
                        F.concat(F.get("questions", F.lit(0)), F.lit(CHOICE_SUFFIX)).alias("question"))


def _open_probes(items: DataFrame) -> DataFrame:
    return _array_probes(items).withColumn("question",
                                           F.concat("question", F.lit("\nANSWER: ")))


PROBES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "description": _array_probes, "prediction": _array_probes, "inference": _map_probes,
    "hypothetical": _choice_probes, "counterfactual": _open_probes}


def probes(items: DataFrame, builders: dict | None = None) -> DataFrame:
    """Expand items to one row per question, by the builder of their category."""
    out = None
    for cat, build in (builders or PROBES).items():
        part = build(items.where(F.col("category") == cat))
        out = part if out is None else out.unionByName(part)
    return out


def unknown(requests: DataFrame, column: str, registry: list[str]) -> DataFrame:
    """Requested names that are not registered, with how often they were asked for."""
    return (requests.where(~F.col(column).isin(*registry)).groupBy(F.col(column).alias("name"))
            .agg(F.count(F.lit(1)).alias("requests")))
