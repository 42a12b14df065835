"""People and ball measurements: counts per frame, profiles, pixels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchlens.functions import geometry as G, grid
from matchlens.operators import chunks

SLOTS = 22


def count_over(values: str, threshold, lo: int = 0, hi: int = SLOTS) -> Column:
    """How many slots lo..hi-1 of an array column reach the threshold."""
    return G.count_of([f"get({values}, {i}) >= {threshold}" for i in range(lo, hi)])


def people(inshot: DataFrame, threshold: int = 25) -> DataFrame:
    """People in shot per frame: all, by team, keepers."""
    b = "body"
    return inshot.select(
        "match_id", "frame", count_over(b, threshold).alias("people"),
        count_over(b, threshold, 0, 11).alias("team_blue"),
        count_over(b, threshold, 11, 22).alias("team_red"),
        (count_over(b, threshold, 0, 1) + count_over(b, threshold, 11, 12)).alias("goalkeepers"))


def per_second(counts: DataFrame, fps: int = 25) -> DataFrame:
    return counts.groupBy("match_id", F.expr(f"frame div {fps}").alias("second")).agg(
        F.round(F.avg("people"), 6).alias("mean_people"), F.min("people").alias("min_people"),
        F.max("people").alias("max_people"))


def summary(counts: DataFrame) -> DataFrame:
    """Counts take at most 23 values, so the exact percentiles keep a short histogram."""
    return counts.agg(
        F.count(F.lit(1)).alias("frames"), F.countDistinct("match_id").alias("clips"),
        F.min("people").alias("min"), F.max("people").alias("max"),
        F.round(F.avg("people"), 6).alias("mean"),
        F.percentile("people", F.lit(0.5)).alias("median"),
        F.percentile("people", F.lit(0.25)).alias("p25"),
        F.percentile("people", F.lit(0.75)).alias("p75"),
        F.round(F.avg("team_blue"), 6).alias("blue_mean"),
        F.round(F.avg("team_red"), 6).alias("red_mean"),
        F.sum((F.col("goalkeepers") > 0).cast("bigint")).alias("gk_frames"))


def histogram(counts: DataFrame) -> DataFrame:
    """Dense histogram between the smallest and the largest count seen."""
    seen = counts.groupBy("people").agg(F.count(F.lit(1)).alias("n"))
    values = seen.agg(F.explode(F.sequence(F.min("people"), F.max("people"))).alias("people"))
    return values.join(seen, "people", "left").select("people", F.coalesce("n", F.lit(0))
                                                      .alias("n"))


def frame_profile(counts: DataFrame) -> DataFrame:
    return counts.groupBy("frame").agg(
        F.round(F.avg("people"), 6).alias("mean"),
        F.percentile("people", F.lit(0.25)).alias("p25"),
        F.percentile("people", F.lit(0.75)).alias("p75"), F.min("people").alias("min"),
        F.max("people").alias("max"))


def clip_means(counts: DataFrame) -> DataFrame:
    return counts.groupBy("match_id").agg(F.round(F.avg("people"), 6).alias("mean"))


def churn(inshot: DataFrame, threshold: int = 25) -> DataFrame:
    """Mean absolute change of the head count between frames, and single entries and exits."""
    w = chunks.along()
    mask = F.expr(" + ".join(f"if(get(body, {i}) >= {threshold}, {1 << i}L, 0L)"
                             for i in range(SLOTS)))
    body = chunks.reach(inshot.select("match_id", "frame", mask.alias("mask")), 1, 0)
    before = F.lag("mask").over(w)
    body = chunks.core(body.select(
        "match_id", "frame", chunks.CHUNK,
        F.abs(F.bit_count("mask") - F.bit_count(before)).alias("delta"),
        F.bit_count(F.col("mask").bitwiseXOR(before)).alias("flips")))
    return body.agg(F.round(F.avg("delta"), 6).alias("churn"),
                    F.sum("flips").cast("bigint").alias("entries_exits"))


def sensitivity(inshot: DataFrame, thresholds=(1, 10, 25, 50, 100)) -> DataFrame:
    """Mean head count per threshold; one pass, one partial row per task."""
    wide = inshot.agg(*[F.avg(count_over("body", t)).alias(str(t)) for t in thresholds])
    return wide.select(F.explode(F.array(*[F.struct(
        F.lit(t).cast("bigint").alias("threshold"), F.round(F.col(f"`{t}`"), 6).alias("mean"))
        for t in thresholds])).alias("r")).select("r.*")


def second_matrix(counts: DataFrame, fps: int = 25) -> DataFrame:
    """Mean people per clip and second, with all margins (null marks a margin)."""
    return counts.withColumn("second", F.expr(f"frame div {fps}")).cube(
        "match_id", "second").agg(F.round(F.avg("people"), 6).alias("mean_people"),
                                  F.grouping_id().cast("bigint").alias("margin"))


def occupancy(windows: DataFrame, counts: DataFrame, pane: int = 1) -> DataFrame:
    """Per window: fewest, median and tenth-percentile people over its frames.

    From sliding histograms (one counter for each number of people), see `chunks.range_sums`.
    """
    at = {f"n{v}": (F.col("people") == v).cast("bigint") for v in range(SLOTS + 1)}
    h = chunks.range_sums(counts, windows.select("match_id", "start", "end").distinct(), at, pane)
    upto = [F.col("n0")]
    for v in range(1, SLOTS + 1):
        upto.append(upto[-1] + F.col(f"n{v}"))
    h = h.select("match_id", "start", "end", F.array(*upto).alias("upto")).withColumn("n", F.col("upto")[SLOTS]).where("n > 0")

    def ranked(r):      # the value of rank r: so many values have no more than r frames up to them
        return F.size(F.filter("upto", lambda c: c <= r)).cast("bigint")

    def quantile(q):
        at = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        return F.when(low == high, ranked(low).cast("double")).otherwise((high - at) * ranked(low) + (at - low) * ranked(high))
    return h.select("match_id", "start", "end", ranked(F.lit(0)).alias("min"), quantile(0.5).alias("median"), quantile(0.1).alias("p10"))


def region_count(trace: DataFrame, y_lo: int, y_hi: int, unit: float = 1.0) -> DataFrame:
    """Players per frame whose projected pixel row lies in the band, both ends included."""
    tests = [f"{grid.pixel_row_sql(f'{p}.y / {float(unit)!r}D')} between {y_lo} and {y_hi}"
             for p in G.everyone()]
    return trace.select("match_id", "frame", G.count_of(tests).alias("in_band"))


def team_mean(team: int, axis: str, unit: float = 1.0) -> Column:
    """Mean coordinate of the players of one side; missing players do not count."""
    part = G.everyone()[G.SQUAD * team:G.SQUAD * (team + 1)]
    total = " + ".join(["0.0D", *(f"coalesce({p}.{axis}, 0)" for p in part)])
    n = " + ".join(["0", *(f"if({p} is null, 0, 1)" for p in part)])
    return F.expr(f"({total}) / ({n}) / {float(unit)!r}D")


def centroids(trace: DataFrame, unit: float = 1.0) -> DataFrame:
    return trace.select("match_id", "frame", *[
        F.round(team_mean(team, axis, unit), 6).alias(f"{name}_{axis}")
        for team, name in ((0, "a"), (1, "b")) for axis in "xy"])


# --- pixels: one row per pixel, both passes side by side (vis_*, inv_*) ---
def change() -> Column:
    return (F.abs(F.col("vis_r") - F.col("inv_r")) + F.abs(F.col("vis_g") - F.col("inv_g"))
            + F.abs(F.col("vis_b") - F.col("inv_b")))


def pair_passes(pixels: DataFrame, key: list[str]) -> DataFrame:
    """Long pixels (key, y, x, pass, r, g, b) to one row per pixel with both passes.

    A grouped reduction: two rows in, one out, so no join of the passes is needed.
    """
    def of(p, ch):
        return F.max(F.when(F.col("pass") == p, F.col(ch))).alias(f"{p}_{ch}")
    return pixels.groupBy(*key, "y", "x").agg(*[of(p, ch) for p in ("vis", "inv")
                                                for ch in ("r", "g", "b")])


def ball_centroid(pixels: DataFrame, key: list[str], *, floor: int = 40, share: float = 0.35,
                  bright: int = 600, min_bright: int = 3) -> DataFrame:
    """Difference-weighted centre of the ball per frame pair; null when nothing differs.

    Two grouped passes over the pixels: the peak change per frame, then weighted sums over the
    changed pixels under each possible mask. Frames are never collected.
    """
    moving = pixels.select(*key, "y", "x", change().alias("d"),
                           (F.col("vis_r") + F.col("vis_g") + F.col("vis_b")).alias("light"))
    peak = moving.groupBy(*key).agg(F.max("d").alias("peak"))
    # pixels below half of the floor's lowest possible mask can never count
    j = moving.where("d > 0").join(peak, key)
    strict = F.col("d") > F.greatest(F.lit(float(floor)), F.col("peak") * share)
    loose = F.col("d") > F.col("peak") * 0.5
    lit = F.col("light") > bright
    sums = []
    for name, test in (("s", strict), ("sl", strict & lit), ("h", loose), ("hl", loose & lit)):
        sums += [F.count(F.when(test, 1)).alias(f"n_{name}"),
                 F.sum(F.when(test, F.col("d"))).alias(f"w_{name}"),
                 F.sum(F.when(test, F.col("d") * F.col("x"))).alias(f"x_{name}"),
                 F.sum(F.when(test, F.col("d") * F.col("y"))).alias(f"y_{name}")]
    agg = j.groupBy(*key).agg(*sums)

    def pick(v):
        use_s = F.when(F.col("n_sl") >= min_bright, F.col(f"{v}_sl")).otherwise(F.col(f"{v}_s"))
        use_h = F.when(F.col("n_hl") >= min_bright, F.col(f"{v}_hl")).otherwise(F.col(f"{v}_h"))
        return F.when(F.col("n_s") > 0, use_s).otherwise(use_h)
    return peak.join(agg, key, "left").select(
        *key, F.round(pick("x") / pick("w"), 6).alias("px"),
        F.round(pick("y") / pick("w"), 6).alias("py"),
        F.coalesce(F.col("n_s"), F.lit(0)).alias("mask_px"))


def ball_centroid_compact(pixels: DataFrame, key: list[str], *, signal: int = 8, weak: int = 18,
                          min_weak: int = 10, extent: int = 20) -> DataFrame:
    """Stricter centre: weak pairs count only when their changed pixels form a small blob."""
    strong = ball_centroid(pixels, key)
    moving = pixels.select(*key, "y", "x", change().alias("d"))
    w = F.col("d") > weak
    blob = moving.groupBy(*key).agg(
        F.count(F.when(F.col("d") > 40, 1)).alias("n_strong"), F.count(F.when(w, 1)).alias("n_weak"),
        F.max(F.when(w, F.col("x"))).alias("x1"), F.min(F.when(w, F.col("x"))).alias("x0"),
        F.max(F.when(w, F.col("y"))).alias("y1"), F.min(F.when(w, F.col("y"))).alias("y0"),
        F.sum(F.when(w, F.col("d"))).alias("m"),
        F.sum(F.when(w, F.col("d") * F.col("x"))).alias("mx"),
        F.sum(F.when(w, F.col("d") * F.col("y"))).alias("my"))
    compact = (F.col("n_weak") >= min_weak) & (F.col("x1") - F.col("x0") <= extent) & (
        F.col("y1") - F.col("y0") <= extent)
    j = blob.join(strong, key)
    enough = F.col("n_strong") >= signal

    def choose(a, b):
        return F.when(enough, a).when(compact, b)
    return j.select(
        *key, choose(F.col("px"), F.round(F.col("mx") / F.col("m"), 6)).alias("px"),
        choose(F.col("py"), F.round(F.col("my") / F.col("m"), 6)).alias("py"),
        F.coalesce(choose(F.col("mask_px"), F.col("n_weak")), F.lit(0)).alias("changed"))


def ball_visible(pixels: DataFrame, key: list[str], threshold: int = 40, min_px: int = 3
                 ) -> DataFrame:
    n = F.count(F.when(change() > threshold, 1))
    return pixels.groupBy(*key).agg(n.alias("ball_px")).withColumn(
        "visible", F.col("ball_px") >= min_px)


def body_and_shadow(pixels: DataFrame, key: list[str], *, changed: int = 30,
                    shade: int = 60) -> DataFrame:
    """Per solo frame against its plate: changed pixels, split in shadow and body, and extent.

    ``vis`` is the frame with one player, ``inv`` the empty plate. A shadow only darkens:
    less light in all, no channel moved by ``shade`` or more.
    """
    hit = change() > changed
    darker = ((F.col("vis_r") + F.col("vis_g") + F.col("vis_b"))
              < (F.col("inv_r") + F.col("inv_g") + F.col("inv_b"))) & (F.greatest(
                  F.abs(F.col("vis_r") - F.col("inv_r")), F.abs(F.col("vis_g") - F.col("inv_g")),
                  F.abs(F.col("vis_b") - F.col("inv_b"))) < shade)
    return pixels.groupBy(*key).agg(
        F.count(F.when(hit, 1)).alias("pix"), F.count(F.when(hit & darker, 1)).alias("shadow_pix"),
        F.count(F.when(hit & ~darker, 1)).alias("body_pix"),
        *[f(F.when(hit, F.col(c))).alias(n) for n, f, c in (
            ("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))],
        F.round(F.avg(F.when(hit, F.col("x"))), 6).alias("cx"),
        F.round(F.avg(F.when(hit, F.col("y"))), 6).alias("cy"))


def hue(prefix: str) -> Column:
    """Hue in degrees of one pass, 0 for grey."""
    r, g, b = (F.col(f"{prefix}_{c}").cast("double") for c in "rgb")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    raw = (F.when(span == 0, F.lit(0.0)).when(hi == r, 60.0 * ((g - b) / span))
           .when(hi == g, 60.0 * ((b - r) / span) + 120.0)
           .otherwise(60.0 * ((r - g) / span) + 240.0))
    return F.when(raw < 0, raw + 360.0).otherwise(raw)


def recoloured(pixels: DataFrame, key: list[str], *, changed: int = 30, shift: float = 12.0
               ) -> DataFrame:
    """Hide-one variant: changed pixels whose hue moved (around the circle) are body."""
    gap = F.abs(hue("vis") - hue("inv"))
    turn = F.least(gap, 360.0 - gap)
    hit = change() > changed
    return pixels.groupBy(*key).agg(F.count(F.when(hit, 1)).alias("pix"),
                                    F.count(F.when(hit & (turn > shift), 1)).alias("body_pix"))


def pitch_fraction(pixels: DataFrame, key: list[str], prefix: str = "vis",
                   floor: float = 0.80) -> DataFrame:
    r, g, b = (F.col(f"{prefix}_{c}") for c in "rgb")
    grass = (g > r * 1.04) & (g > b * 1.04) & (g > 12)
    return pixels.groupBy(*key).agg(F.avg(grass.cast("double")).alias("pitch")).withColumn(
        "low", F.col("pitch") < floor)


def stack_difference(pixels: DataFrame) -> DataFrame:
    """Differing pixels, largest and mean channel difference, frames touched."""
    biggest = F.greatest(F.abs(F.col("vis_r") - F.col("inv_r")),
                         F.abs(F.col("vis_g") - F.col("inv_g")),
                         F.abs(F.col("vis_b") - F.col("inv_b")))
    per = pixels.groupBy("clip").agg(
        F.count(F.lit(1)).alias("px"), F.count(F.when(change() > 0, 1)).alias("differing"),
        F.max(biggest).alias("largest"), F.sum(change()).alias("total"))
    return per.agg(F.sum("px").alias("pixels"), F.sum("differing").alias("differing"),
                   F.max("largest").alias("largest"),
                   (F.sum("total").cast("double") / (F.sum("px") * 3)).alias("mean"),
                   F.count(F.when(F.col("differing") > 0, 1)).alias("frames_touched"))
