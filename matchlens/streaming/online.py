"""Online counterparts of the batch operators, over a step feed.

A feed row is a trace step with ``event_time`` (start of the match plus frame / fps). Late rows
are dropped by the watermark; in the keyed state, frames not newer than the last one seen are
ignored. State per match is a few numbers, and a micro-batch is bounded by its trigger.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchlens import config as C

EPOCH = "2024-01-01 00:00:00"


def with_time(trace: DataFrame, fps: int = C.FPS) -> DataFrame:
    """Adds event_time; whole milliseconds, so that equal steps stay equal."""
    ms = (F.col("frame") * F.lit(1000 // fps)).cast("bigint")
    base = F.unix_millis(F.lit(EPOCH).cast("timestamp"))
    return trace.withColumn("event_time", F.timestamp_millis(base + ms))


EVENTS = "match_id long, frame long, event string"
_EVENT_STATE = "frame long, mode long, owner long, diff long"


def step_events(feed: DataFrame) -> DataFrame:
    """Goal, lost goal, set piece and possession change events, step by step."""
    def scan(key, parts, state):
        import numpy as np
        import pandas as pd
        last, mode, owner, diff = state.get if state.exists else (-1, -1, -1, 0)
        steps = pd.concat(list(parts)).sort_values("frame").drop_duplicates("frame")
        steps = steps[steps["frame"] > last]
        if not len(steps):
            return
        f, m, o = (steps[c].to_numpy() for c in ("frame", "game_mode", "owned_team"))
        lead = (steps["score_l"] - steps["score_r"]).to_numpy()
        reward = lead - np.r_[diff, lead[:-1]]
        # the last owner at or before each step; what was before the first is in the state
        at = np.maximum.accumulate(np.where(o != -1, np.arange(len(o)), -1))
        known = np.where(at >= 0, o[at], owner)
        before = np.r_[owner, known[:-1]]
        hits = {"score": reward == 1, "lost_score": reward == -1,
                "set_piece": (m != C.NORMAL) & (np.r_[mode, m[:-1]] == C.NORMAL),
                "possession_change": (o != -1) & (before != -1) & (o != before)}
        state.update((int(f[-1]), int(m[-1]), int(known[-1]), int(lead[-1])))
        found = [(f[hit], name) for name, hit in hits.items() if hit.any()]
        if found:
            yield pd.concat([pd.DataFrame({"match_id": key[0], "frame": frames, "event": name})
                             for frames, name in found])
    cols = feed.select("match_id", "frame", "game_mode", "owned_team", "score_l", "score_r")
    return cols.groupBy("match_id").applyInPandasWithState(
        scan, EVENTS, _EVENT_STATE, "append", "NoTimeout")


CAPTURES = "match_id long, event string, frame long, first_frame long, last_frame long"
TRIGGERS = ["score", "lost_score"]


def captures(events: DataFrame, *, before: int = 100, after: int = 1, max_count: int | None = None,
             every: int = 300) -> DataFrame:
    """Context of events, as frame ranges: ``before`` steps before the event and ``after`` steps
    from it on; at most ``max_count`` (if given) per match and event name, ``every`` frames apart, and none
    while one of the same name is pending."""
    gap = max(every, after)

    def scan(key, parts, state):
        import pandas as pd
        taken, last = state.get if state.exists else (0, -1)
        out = []
        for f in sorted(f for p in parts for f in p["frame"]):
            if (max_count is None or taken < max_count) and (last < 0 or f - last >= gap):
                out.append(f)
                taken, last = taken + 1, f
        state.update((int(taken), int(last)))
        if out:
            yield pd.DataFrame({"match_id": key[0], "event": key[1], "frame": out,
                                "first_frame": [max(0, f - before) for f in out],
                                "last_frame": [f + after - 1 for f in out]})
    return events.where(F.col("event").isin(*TRIGGERS)).groupBy(
        "match_id", "event").applyInPandasWithState(
        scan, CAPTURES, "taken long, last long", "append", "NoTimeout")


EPISODE_CAPTURES = CAPTURES + ", steps long"
_EPISODE_STATE = ("first long, frame long, seen long, lead long, ended boolean, ring array<long>, taken array<long>, last array<long>, "
                  "pending array<long>, pending_steps array<long>")


def episode_captures(feed: DataFrame, *, before: int = 100, after: int = 10, max_count: int | None = None, every: int = 300,
                     idle: str = "10 seconds", late: str = "2 seconds") -> DataFrame:
    """Captures of all four triggers, from the steps themselves, in one stateful query.

    A step has ``event_time`` and ``done``, true on the last one of an episode. The state of a match is the ring
    of its last ``before`` frames and, per trigger, what was taken last and what is pending.

    score, lost_score   the steps of the ring, the step itself and those up to ``after`` steps from it; at most
                        ``max_count`` per match, ``every`` frames apart, none while one is pending. A pending
                        capture ends with the episode.
    episode_done        the whole episode, when its last step comes
    shutdown            the ring, when a match has been silent for ``idle`` of event time without a last step

    ``steps`` counts the steps that were there. Steps that are late by the watermark are dropped, as are
    those not newer than the last one seen and those after the end.
    """
    gap = max(every, after)
    wait = _millis(idle)

    def scan(key, parts, state):
        import numpy as np
        import pandas as pd
        if state.exists:
            first, frame, seen, lead, ended, ring, taken, last, pending, held = state.get
            ring, taken, last, pending, held = (list(map(int, x)) for x in (ring, taken, last, pending, held))
        else:
            first, frame, seen, lead, ended, ring, taken, last, pending, held = -1, -1, 0, 0, False, [], [0, 0], [-1, -1], [-1, -1], [0, 0]
        out = []

        def close(i, until):
            out.append((TRIGGERS[i], pending[i], max(0, pending[i] - before), min(pending[i] + after - 1, until), held[i]))
            pending[i] = -1
        if state.hasTimedOut:
            if not ended:
                for i in range(2):
                    if pending[i] >= 0:
                        close(i, frame)
                out.append(("shutdown", frame, max(first, frame - before), frame, len(ring)))
            state.remove()
        else:
            steps = pd.concat(list(parts)).sort_values("frame").drop_duplicates("frame")
            steps = steps[steps["frame"] > frame]
            for f, l, r, done in zip(*(steps[c].tolist() for c in ("frame", "score_l", "score_r", "done"))):
                if ended:
                    break
                first = f if first < 0 else first
                for i in range(2):
                    if pending[i] >= 0 and f >= pending[i] + after:
                        close(i, frame)
                hit = {1: 0, -1: 1}.get(l - r - lead)
                frame, seen, lead = f, seen + 1, l - r
                ring = [x for x in ring if x >= f - before] + [f]
                for i in range(2):
                    if pending[i] >= 0:
                        held[i] += 1
                if hit is not None and pending[hit] < 0 and (max_count is None or taken[hit] < max_count) and (last[hit] < 0 or f - last[hit] >= gap):
                    taken[hit], last[hit], pending[hit], held[hit] = taken[hit] + 1, f, f, len(ring)
                if done:
                    for i in range(2):
                        if pending[i] >= 0:
                            close(i, f)
                    out.append(("episode_done", f, first, f, seen))
                    ended = True
            state.update((int(first), int(frame), int(seen), int(lead), bool(ended), ring, taken, last, pending, held))
            if len(steps):
                newest = int(steps["event_time"].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(newest + wait, state.getCurrentWatermarkMs() + 1))
        if out:
            made = pd.DataFrame(out, columns=["event", "frame", "first_frame", "last_frame", "steps"])
            made.insert(0, "match_id", np.int64(key[0]))
            yield made
    cols = feed.withWatermark("event_time", late).select("match_id", "frame", "score_l", "score_r", "done", "event_time")
    return cols.groupBy("match_id").applyInPandasWithState(scan, EPISODE_CAPTURES, _EPISODE_STATE, "append", "EventTimeTimeout")


def _millis(interval: str) -> int:
    import pandas as pd
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def people_per_second(feed: DataFrame, late: str = "2 seconds") -> DataFrame:
    """People in shot per match and second of event time."""
    return feed.withWatermark("event_time", late).groupBy(
        "match_id", F.window("event_time", "1 second").alias("w")).agg(
        F.avg("people").alias("mean_people"), F.min("people").alias("min_people"),
        F.max("people").alias("max_people")).select(
        "match_id", (F.unix_millis("w.start") - F.unix_millis(F.lit(EPOCH).cast("timestamp")))
        .alias("ms"), "mean_people", "min_people", "max_people")


def keeper_sessions(feed: DataFrame, fps: int = C.FPS, late: str = "2 seconds") -> DataFrame:
    """Unbroken keeper holds as sessions: a missing frame closes one."""
    step = 1000 // fps
    held = feed.where((F.col("owned_player") == 0) & F.col("owned_team").isin(0, 1))
    gap = f"{step + step // 2} milliseconds"
    return held.withWatermark("event_time", late).groupBy(
        "match_id", "owned_team", F.session_window("event_time", gap).alias("w")).agg(
        F.min("frame").alias("caught"), F.max("frame").alias("release"),
        F.count(F.lit(1)).alias("hold_frames")).select(
        "match_id", F.col("owned_team").alias("team"), "caught", "release", "hold_frames")


def closing(feed: DataFrame, after: str = "1 day") -> DataFrame:
    """The row that ends a feed: a step of match -1, so late that the watermark closes every window and
    session before it; its own is never emitted. Its other fields are 0, which no filter here drops.
    Without it the last windows stay open, as more steps may come."""
    last = feed.agg((F.max("event_time") + F.expr(f"interval {after}")).alias("event_time"))
    other = {"match_id": -1}
    return last.select(*[F.col("event_time") if f.name == "event_time" else F.lit(other.get(f.name, 0)).cast(
        f.dataType).alias(f.name) for f in feed.schema.fields])


def run_available(query: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop; a later call goes on where this one ended."""
    q = (query.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
