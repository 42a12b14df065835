"""Joins between windows, clips, traces and measurements.

Every join has an equality key that spreads with the data: (match, frame) for measurements,
(match, time bucket) for spans, clip or window keys for tables with one row per key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlens import config as C
from matchlens import session
from matchlens.functions import geometry as G
from matchlens.operators import chunks, measure as M

WINDOW_KEY = ["match_id", "start", "end"]


def with_end_counts(windows: DataFrame, inshot: DataFrame, threshold: int = 25) -> DataFrame:
    """People in shot on the first and on the last frame; windows missing either are dropped."""
    ends = windows.select("match_id", F.explode(F.array("start", F.col("end") - 1)).alias("frame"))
    # counted before the join, which then moves one number for each frame
    counts = inshot.select("match_id", "frame", M.count_over("body", threshold).alias("n")).join(
        ends.distinct().hint("merge"), ["match_id", "frame"], "left_semi").hint("merge")
    first = counts.select("match_id", F.col("frame").alias("start"),
                          F.col("n").alias("count_first"))
    last = counts.select("match_id", (F.col("frame") + 1).alias("end"),
                         F.col("n").alias("count_last"))
    return windows.join(first, ["match_id", "start"]).join(last, ["match_id", "end"])


def with_ball_pixel(windows: DataFrame, ballpix: DataFrame) -> DataFrame:
    at_end = ballpix.select("match_id", (F.col("frame") + 1).alias("end"), "px", "py")
    return windows.join(at_end, ["match_id", "end"])


def without_ball_pixel(windows: DataFrame, ballpix: DataFrame) -> DataFrame:
    at_end = ballpix.select("match_id", (F.col("frame") + 1).alias("end"))
    return windows.join(at_end, ["match_id", "end"], "left_anti")


def outside_spans(windows: DataFrame, spans: DataFrame, rule: str = "ends",
                  bucket: int = 256) -> DataFrame:
    """Drop windows that touch an absent span (match_id, lo, hi; both ends inclusive).

    "ends": the first or the last frame lies in a span (a window inside one span satisfies this
    too); "overlap": any frame does. Spans are cut at bucket borders and only the longest
    piece per start is kept, so a bucket holds at most ``bucket`` pieces whatever the number
    of recorded spans. A window of any length looks in the buckets it touches ("overlap") or
    that hold its ends, and goes if one of them says so.
    """
    if rule not in ("ends", "overlap"):
        raise ValueError(f"unknown rule {rule}")
    pieces = spans.select("match_id", "lo", "hi", F.explode(F.sequence(
        F.expr(f"lo div {bucket}"), F.expr(f"hi div {bucket}"))).alias("b"))
    pieces = pieces.select(
        "match_id", "b", F.greatest("lo", F.col("b") * bucket).alias("lo"),
        F.least("hi", (F.col("b") + 1) * bucket - 1).alias("hi")).groupBy(
        "match_id", "b", "lo").agg(F.max("hi").alias("hi"))
    gone = pieces.groupBy("match_id", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    last = F.col("end") - 1

    def buckets(lo, hi):
        return F.sequence(F.floor(lo / bucket).cast("bigint"), F.floor(hi / bucket).cast("bigint"))
    ends = F.array(F.struct(F.col("start").alias("lo"), F.col("start").alias("hi")),
                   F.struct(last.alias("lo"), last.alias("hi")))
    whole = F.array(F.struct(F.col("start").alias("lo"), last.alias("hi")))
    looked = windows.select(*WINDOW_KEY, F.explode(ends if rule == "ends" else whole).alias("p"))
    looked = looked.select(*WINDOW_KEY, "p", F.explode(buckets(F.col("p.lo"), F.col("p.hi"))).alias("b"))
    hit = F.exists("gone", lambda s: (F.col("p.lo") <= s["hi"]) & (s["lo"] <= F.col("p.hi")))
    # unfolded windows: Spark takes them to be as small as the file they come from, and would broadcast millions
    touched = looked.hint("merge").join(gone, ["match_id", "b"]).where(hit).select(*WINDOW_KEY)
    return windows.join(touched.hint("merge"), WINDOW_KEY, "left_anti").select(*windows.columns)


def possession(trace: DataFrame, clip: int = C.CLIP_FRAMES) -> DataFrame:
    """match_id, frame, owner: the team in possession of a clip starting at each frame.

    The owner on that frame, else the last owner before it, else the first owner inside the
    clip, else -1.
    """
    w = chunks.along()
    held = F.when(F.col("owned_team") >= 0, F.col("owned_team"))
    body = chunks.reach(trace.select("match_id", "frame", "owned_team"), 0, clip - 1)
    body = body.select("match_id", "frame", chunks.CHUNK, held.alias("held"),
                       F.first(held, ignorenulls=True).over(w.rowsBetween(0, clip - 1))
                       .alias("coming"))
    body = chunks.carry_last(body.where(chunks.is_core()), {"known": F.col("held")})
    return body.select("match_id", "frame",
                       F.coalesce("known", "coming", F.lit(-1)).alias("owner"))


def with_possession(windows: DataFrame, trace: DataFrame, clip: int = C.CLIP_FRAMES
                    ) -> DataFrame:
    """Adds startown; windows in which the ball is never owned are dropped."""
    own = possession(trace, clip).where("owner >= 0").select(
        "match_id", F.col("frame").alias("start"), F.col("owner").alias("startown"))
    return windows.join(own, ["match_id", "start"])


def nearest(trace: DataFrame, unit: float = 1.0) -> DataFrame:
    """match_id, frame and the player closest to the ball."""
    return trace.withColumn("p", G.nearest_player()).select(
        "match_id", "frame", F.col("p.team").alias("team"), F.col("p.slot").alias("slot"),
        (F.sqrt(F.col("p.d2").cast("double")) / F.lit(float(unit))).alias("distance"))


def taker_in_shot(events: DataFrame, trace: DataFrame, inshot: DataFrame,
                  threshold: int = 25) -> DataFrame:
    """Per event (match_id, anchor): is the player nearest the ball at the anchor in shot?"""
    who = nearest(trace.select("match_id", "frame", "ball_x", "ball_y", "left", "right")).select(
        "match_id", "frame", "team", "slot").join(
        events.select("match_id", F.col("anchor").alias("frame")).distinct(), ["match_id", "frame"], "left_semi")
    seen = who.join(inshot.select("match_id", "frame", "body"), ["match_id", "frame"], "left")
    px = F.get("body", (F.col("team") * 11 + F.col("slot")).cast("int"))
    return events.join(seen.select(
        "match_id", F.col("frame").alias("anchor"), "team", "slot",
        F.when(px.isNull(), "?").when(px >= threshold, "yes").otherwise("NO")
        .alias("taker_in_shot")), ["match_id", "anchor"])


# --- same play under another name ---
def digest(trace: DataFrame, columns: list[str], key: str = "match_id",
           fan: int = 4096) -> DataFrame:
    """key, digest, steps: one content digest per trace, whatever its length.

    Rows are hashed in order in blocks of ``fan``, the block digests in blocks again, until one
    is left per trace: no list is longer than ``fan``.
    """
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in ["frame", *columns]])
    level = trace.select(key, F.col("frame").alias("__i"), F.sha2(text, 256).alias("__h"),
                         F.lit(1).cast("bigint").alias("__n"))
    return _tree(level, key, fan, 4)


def _tree(level: DataFrame, key: str, fan: int, rounds: int) -> DataFrame:
    """key, digest, steps from (key, __i, __h, __n): hashes in order of __i, ``fan`` of them to one of the next level."""
    for _ in range(rounds):
        level = level.groupBy(key, F.expr(f"__i div {fan}").alias("__b")).agg(
            F.sha2(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("__i", "__h"))), lambda s: s["__h"]), ";"),
                256).alias("__h"), F.sum("__n").alias("__n")).withColumnRenamed("__b", "__i")
    return level.select(key, F.col("__h").alias("digest"), F.col("__n").alias("steps"))


def same_play(clips: DataFrame, digests: DataFrame) -> DataFrame:
    """How many other clips show an overlapping stretch of the same play.

    Counted from the two sorted sets of clip borders of each play (clips that start before my
    end, less clips that end by my start, less myself), so that a play copied very often gives
    one number per clip and not one row per pair.
    """
    named = clips.join(digests.select("match_id", "digest"), "match_id")
    marks = named.select("digest", F.explode(F.array(
        F.struct(F.col("start").alias("frame"), F.lit(1).alias("opens"), F.lit(0).alias("ends")),
        F.struct(F.col("end").alias("frame"), F.lit(0).alias("opens"), F.lit(1).alias("ends"))))
        .alias("m")).select("digest", "m.*")
    marks = marks.groupBy("digest", "frame").agg(F.sum("opens").alias("opens"),
                                                 F.sum("ends").alias("ends"))
    run = chunks.running(chunks.reach(marks), {
        "opened": ("sum", F.col("opens")), "ended": ("sum", F.col("ends"))}, key="digest")
    at_end = run.select("digest", F.col("frame").alias("end"),
                        (F.col("opened") - F.col("opens")).alias("opened_before"))
    at_start = run.select("digest", F.col("frame").alias("start"),
                          F.col("ended").alias("ended_by"))
    return (named.join(at_end, ["digest", "end"]).join(at_start, ["digest", "start"])
            .withColumn("same_play", F.col("opened_before") - F.col("ended_by") - 1)
            .drop("opened_before", "ended_by"))


def near_plays(trace: DataFrame, columns: list[str], tolerance: float = 1e-6, key: str = "match_id") -> tuple[DataFrame, DataFrame]:
    """(key, digest) and (digest, near): the traces of equal length whose columns differ by ``tolerance`` at most
    on every frame, as pairs of digests; a digest is near itself.

    Equal traces share a digest, so only one trace of each digest goes on. Two traces within the
    tolerance have means within it, so they meet in a cell of (length, means) or, where a mean lies
    that close to a border, in the next one. What meets, with means no further apart than the tolerance and the
    rounding of their sums allow, is compared frame by frame. Frames are gathered once, in blocks of ``fan``, which
    are hashed, averaged and compared as they are: a block moves as one row of plain lists.
    """
    fan = 4096
    blocks = session.written(_blocks(trace, columns, key, fan))
    line = F.arrays_zip("__f", *columns)
    hashes = F.transform(line, lambda r: F.sha2(F.concat_ws(",", (F.col("__i") * fan + r["__f"]).cast("string"), *[
        r[c].cast("string") for c in columns]), 256))
    of = session.written(_tree(blocks.select(key, "__i", F.sha2(F.array_join(hashes, ";"), 256).alias("__h"), F.size("__f").cast(
        "bigint").alias("__n")), key, fan, 3))
    first = of.groupBy("digest").agg(F.min(key).alias(key), F.first("steps").alias("steps"))
    real = blocks.select(key, F.explode(F.arrays_zip(*columns)).alias("r")).select(key, *[F.col(f"r.{c}").cast("double").alias(c) for c in columns])
    # of the sum of n doubles no more than n roundings of its largest is lost; a column with nulls has no such bound
    lost = [F.when(F.count(c) == F.count(F.lit(1)), F.max(F.abs(F.col(c))) * F.count(F.lit(1)) * 2.0 ** -52).alias(f"__lost_{c}") for c in columns]
    means = first.join(real.groupBy(key).agg(*[F.avg(c).alias(f"__mean_{c}") for c in columns], *lost), key)
    cell = tolerance * (1 << 12)
    for c in columns:       # one cell, or two next to a border
        slack, mean = F.lit(2 * tolerance), F.col(f"__mean_{c}")
        means = means.withColumn(c, F.explode(F.array_distinct(F.array(F.floor((mean - slack) / cell), F.floor((mean + slack) / cell)))))
    a, b = means.alias("a"), means.alias("b")
    may = F.col("a.digest") < F.col("b.digest")
    for c in ["steps", *columns]:
        may &= F.col(f"a.{c}") == F.col(f"b.{c}")
    for c in columns:
        may &= F.coalesce(F.abs(F.col(f"a.__mean_{c}") - F.col(f"b.__mean_{c}")) <= tolerance * (1 + 1e-9) + F.col(
            f"a.__lost_{c}") + F.col(f"b.__lost_{c}"), F.lit(True))
    met = session.written(a.join(b, may).select(F.col("a.digest").alias("a"), F.col("b.digest").alias("b"), F.col(f"a.{key}").alias("__x"), F.col(
        f"b.{key}").alias("__y"), F.col("a.steps").alias("steps")).distinct())
    # by match and block, so that a block moves to the pairs it is in and from there to its partner
    at = blocks.select(F.col(key).alias("__x"), "__i")
    pairs = met.select("__x", "__y").join(at, "__x")
    x = blocks.select(F.col(key).alias("__x"), "__i", line.alias("__a")).join(pairs, ["__x", "__i"])
    y = blocks.select(F.col(key).alias("__y"), "__i", line.alias("__b")).join(pairs.select("__y", "__i").distinct(), ["__y", "__i"], "left_semi")
    both = x.join(y, ["__y", "__i"]).select("__x", "__y", F.explode(F.arrays_zip("__a", "__b")).alias("r"))
    apart = F.greatest(*[F.abs(F.col(f"r.__a.{c}").cast("double") - F.col(f"r.__b.{c}").cast("double")) for c in columns], F.lit(0.0))
    agreed = both.where((F.col("r.__a.__f") == F.col("r.__b.__f")) & (apart <= tolerance)).groupBy("__x", "__y").agg(F.count(F.lit(1)).alias("n"))
    agreed = session.cut_lineage(met.join(agreed, ["__x", "__y"]).where("n = steps").select("a", "b"))
    both = agreed.select(F.col("a").alias("digest"), F.col("b").alias("near")).unionByName(
        agreed.select(F.col("b").alias("digest"), F.col("a").alias("near")))
    return of.select(key, "digest"), both.unionByName(first.select("digest", F.col("digest").alias("near")))


def _blocks(trace: DataFrame, columns: list[str], key: str, fan: int) -> DataFrame:
    """key, __i (number of the block), __f (frames, from the block's first) and a list for each column, in order of frames."""
    rows = trace.select(key, F.expr(f"frame div {fan}").cast("bigint").alias("__i"), F.expr(f"cast(frame - frame div {fan} * {fan} as smallint)").alias("__f"), *columns)
    lists = rows.groupBy(key, "__i").agg(F.array_sort(F.collect_list(F.struct("__f", *columns))).alias("__l"))
    return lists.select(key, "__i", *[F.col(f"__l.{c}").alias(c) for c in ["__f", *columns]])


def play_partners(clips: DataFrame, plays: DataFrame, near: DataFrame, clip: int = C.CLIP_FRAMES) -> DataFrame:
    """Adds the clip of another match that shows most of the same play: partner, partner_start, shared (frames).

    ``clips`` (match_id, start) are all ``clip`` frames long, ``plays`` and ``near`` as `near_plays` gives them. Of clips that share
    equally many frames the one of the smallest match counts; without any, the three are null, null and 0.
    Clips of a play are first reduced to the two smallest matches per start, and a clip looks at the starts
    within its length: lists are bounded by the clip length, however often a play was copied.
    """
    named = clips.join(plays, "match_id")
    # the smallest two matches: the least, and the least that is not it
    one = named.groupBy("digest", "start").agg(F.min("match_id").alias("m"))
    two = named.join(one, ["digest", "start"]).where("match_id != m").groupBy("digest", "start").agg(F.min("match_id").alias("m"))
    starts = one.unionByName(two).withColumnRenamed("digest", "near").join(near, "near")
    # the starts of all plays near one; those of equal start shrink to two matches again
    w = Window.partitionBy("digest", "start").orderBy("m")
    starts = starts.select("digest", "start", "m", F.row_number().over(w).alias("k")).where("k <= 2").groupBy("digest", "start").agg(
        F.collect_list("m").alias("ms"))
    asked = named.select("digest", "start").distinct()
    starts = starts.join(asked.withColumn("asked", F.lit(True)), ["digest", "start"], "left")
    w = Window.partitionBy("digest", chunks.CHUNK).orderBy("start").rangeBetween(-(clip - 1), clip - 1)
    seen = chunks.reach(starts, clip, clip, "start").withColumn("seen", F.collect_list(F.struct("start", "ms")).over(w))
    seen = chunks.core(seen.where("asked"), "start").select("digest", "start", "seen")
    options = F.flatten(F.transform("seen", lambda s: F.transform(F.filter(s["ms"], lambda m: m != F.col("match_id")), lambda m: F.struct(
        F.abs(s["start"] - F.col("start")).alias("apart"), m.alias("match"), s["start"].alias("start")))))
    best = F.array_min(options)
    return named.join(seen, ["digest", "start"]).withColumn("best", best).select(
        *clips.columns, F.col("best.match").alias("partner"), F.col("best.start").alias("partner_start"),
        F.coalesce(F.lit(clip) - F.col("best.apart"), F.lit(0)).cast("bigint").alias("shared"))


def distinct_plays(matches: DataFrame, digests: DataFrame) -> DataFrame:
    """Keep the first match of every play."""
    firsts = digests.groupBy("digest").agg(F.min("match_id").alias("match_id"),
                                           F.count(F.lit(1)).alias("copies"))
    return matches.join(firsts, "match_id")


# --- versions of a batch ---
def renumbering(old: DataFrame, new: DataFrame, reasons: Column, key: list[str]) -> DataFrame:
    """Where every old number went: kept, newly built or dropped (with a reason)."""
    a = old.select(*key, F.col("clip").alias("old_clip"), reasons.alias("reason"))
    b = new.select(*key, F.col("clip").alias("new_clip"))
    return a.join(b, key, "full_outer").select(
        *key, "old_clip", "new_clip",
        F.when(F.col("old_clip").isNull(), "newly built")
        .when(F.col("new_clip").isNull(), F.concat(F.lit("dropped: "), F.coalesce(
            "reason", F.lit("not selected")))).otherwise("kept, renumbered").alias("note"))


def carry_over(measured: DataFrame, old: DataFrame, new: DataFrame, key: list[str]
               ) -> tuple[DataFrame, DataFrame]:
    """Measurements under their new clip number, and the new clips without any."""
    keyed = measured.join(old.select(*key, "clip"), "clip").drop("clip")
    moved = new.select(*key, "clip").join(keyed, key)
    missing = new.join(keyed.select(*key).distinct(), key, "left_anti").select(*key, "clip")
    return moved, missing


def recipe(truth: DataFrame, provenance: DataFrame, fields: list[str]) -> DataFrame:
    """Truth with its provenance fields; absent ones become empty text."""
    out = truth.join(provenance.select("clip", *fields), "clip", "left")
    return out.select(*truth.columns, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f)
                                        for f in fields])


def compare_fields(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row per key and field: both values as text and whether they agree (nulls too)."""
    x = a.select(*key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    y = b.select(*key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    j = x.join(y, key)
    rows = F.explode(F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b"),
        F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")).alias("same")) for f in fields]))
    return j.select(*key, rows.alias("r")).select(*key, "r.*")


def compare_traces(a: DataFrame, b: DataFrame, unit: float = 1.0) -> DataFrame:
    """Per match: first divergent frame, mean and max ball separation, possession agreement."""
    cols = ["ball_x", "ball_y", "ball_z", "owned_team", "owned_player"]
    x = a.select("match_id", "frame", *[F.col(c).alias(f"a_{c}") for c in cols])
    y = b.select("match_id", "frame", *[F.col(c).alias(f"b_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    apart = G.planar(F.col("a_ball_x") - F.col("b_ball_x"),
                     F.col("a_ball_y") - F.col("b_ball_y")) / F.lit(float(unit))
    j = x.join(y, ["match_id", "frame"]).select("match_id", "frame", same.alias("same"),
                                                apart.alias("apart"),
                                                (F.col("a_owned_team") == F.col("b_owned_team"))
                                                .alias("agree"))
    return j.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.min(F.when(~F.col("same"), F.col("frame"))).alias("first_divergence"),
        F.round(F.avg("apart"), 6).alias("mean_apart"), F.max("apart").alias("max_apart"),
        F.avg(F.col("agree").cast("double")).alias("possession_agreement"))


def coverage(a: DataFrame, b: DataFrame, key: list[str], by: str) -> DataFrame:
    """Per class: names only in a, only in b, and in both."""
    x = a.select(by, *key).distinct().withColumn("in_a", F.lit(1))
    y = b.select(by, *key).distinct().withColumn("in_b", F.lit(1))
    j = x.join(y, [by, *key], "full_outer")
    return j.groupBy(by).agg(
        F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_b"),
        F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("both"))


def first_known(base: DataFrame, better: DataFrame, key: list[str], column: str) -> DataFrame:
    """``column`` from ``better`` where it is there, else the one of ``base``."""
    alt = better.select(*key, F.col(column).alias("__alt"))
    return base.join(alt, key, "left").select(
        *[F.coalesce("__alt", column).alias(column) if c == column else c for c in base.columns],
        F.col("__alt").isNotNull().alias("verified"))


def ends_wanted(windows: DataFrame, levels: list[int]) -> DataFrame:
    return windows.where(F.col("level").isin(*levels)).select(
        "match_id", (F.col("end") - 1).alias("frame")).distinct()
