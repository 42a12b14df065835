"""Streams against the same rules applied row by row, with rows that come late."""
import random

import pytest
from pyspark.sql import functions as F

from matchlens.streaming import online


@pytest.fixture
def fed(spark, tmp_path):
    """Runs a query over batches of rows, one after the other, and returns what it wrote."""
    def run(build, schema, batches):
        source = str(tmp_path / "in")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).transform(online.with_time).coalesce(1).write.mode("append").parquet(source)
            live = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
            for _ in range(2 if i == len(batches) - 1 else 1):
                online.run_available(build(live), str(tmp_path / "out"), str(tmp_path / "state"))
        return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    return run


STEP = "match_id long, frame long, score_l long, score_r long, done boolean"
END = (-1, 1_000_000, 0, 0, False)      # moves the watermark past everything


def plain(steps, before, after, every, idle_end):
    """steps of one match in the order in which they count."""
    out, frames, lead, pending, last = [], [], 0, {}, {}
    for f, l, r, done in steps:
        for name in [n for n, p in pending.items() if f >= p + after]:
            p = pending.pop(name)
            out.append((name, p, max(0, p - before), min(p + after - 1, frames[-1]), sum(max(0, p - before) <= x < p + after for x in frames)))
        frames.append(f)
        name = {1: "score", -1: "lost_score"}.get(l - r - lead)
        lead = l - r
        if name and name not in pending and (name not in last or f - last[name] >= max(every, after)):
            pending[name] = last[name] = f
        if done:
            break
    for name, p in pending.items():
        out.append((name, p, max(0, p - before), min(p + after - 1, frames[-1]), sum(max(0, p - before) <= x < p + after for x in frames)))
    if done:
        out.append(("episode_done", frames[-1], frames[0], frames[-1], len(frames)))
    elif idle_end:
        out.append(("shutdown", frames[-1], max(frames[0], frames[-1] - before), frames[-1], sum(x >= frames[-1] - before for x in frames)))
    return out


def test_episode_captures(fed):
    """Four triggers; gaps, repeated and late steps, steps after the end, captures that the end cuts short."""
    draw = random.Random(1)
    batches, counted = [[] for _ in range(4)], {}
    for m in range(1, 7):
        n, l, r = draw.randint(60, 200), 0, 0
        rows = []
        for f in range(n):
            if draw.random() < 0.08:
                l, r = (l + 1, r) if draw.random() < 0.5 else (l, r + 1)
            rows.append((m, f, l, r, f == n - 1 and m % 2 == 0))
        rows = [x for i, x in enumerate(rows) if i in (0, n - 1) or draw.random() < 0.9]
        counted[m] = [x[1:] for x in rows]
        for x in rows:
            batches[x[1] // 50].append(x)
        batches[3] += [(m, 10, 50, 0, False), (m, rows[0][1], 9, 0, True)] if n > 150 else []      # long past, and late
        if m % 2 == 0 and n < 150:
            batches[3].append((m, n + 5, 30, 0, False))                                            # after the end
    got = fed(lambda feed: online.episode_captures(feed, before=20, after=8, every=30), STEP, [*batches, [END]])
    want = {(m, *x) for m, steps in counted.items() for x in plain(steps, 20, 8, 30, True)}
    assert {x for x in got if x[0] > 0} == want and len([x for x in got if x[0] > 0]) == len(want)


def test_late_rows_of_windows_and_sessions(fed, spark, tmp_path):
    """A row within the watermark counts, one behind it is dropped."""
    rows = [(1, f, 10) for f in range(100)]
    late = [(1, 99, 40), (1, 0, 99)]       # the second of frame 99 is still open, that of frame 0 is not
    got = fed(online.people_per_second, "match_id long, frame long, people long", [rows, late, [(-1, 100_000, 0)]])
    assert sorted(x[:4] for x in got) == [(1, 0, 10.0, 10), (1, 1000, 10.0, 10), (1, 2000, 10.0, 10), (1, 3000, (25 * 10 + 40) / 26, 10)]


def test_late_rows_of_keeper_holds(fed):
    held = [(1, f, 0, 0) for f in (*range(5, 10), *range(80, 90), *range(91, 95))]
    late = [(1, 90, 0, 0), (1, 10, 0, 0)]  # joins two holds; comes after its hold was closed
    got = fed(online.keeper_sessions, "match_id long, frame long, owned_team long, owned_player long", [held, late, [(-1, 100_000, 0, 0)]])
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, 5, 9, 5), (1, 0, 80, 94, 15)]
