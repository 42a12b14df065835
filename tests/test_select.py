"""Choices against brute force on small pools."""
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from matchlens.operators import chunks, lookups as L, matching, select as S, windows as W


def test_close_events_like_the_sequential_pass(spark, small_chunks):
    rnd = random.Random(5)
    for case in range(2):
        rows = [(m, f, float(rnd.randint(0, 6) if case else f)) for m in (1, 2)
                for f in sorted(rnd.sample(range(300), 60))]
        kept = []
        for m, f, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if all(m != k or abs(f - g) >= 25 for k, g, _ in kept):
                kept.append((m, f, s))
        df = spark.createDataFrame(rows, "match_id long, frame long, score double")
        got = {tuple(r) for r in S.drop_close(df, 25).select("match_id", "frame", "score")
               .collect()}
        assert got == set(kept)


def test_spaced_triggers_like_the_sequential_pass(spark, small_chunks):
    rnd = random.Random(7)
    rows = [(1, f, "score") for f in sorted(rnd.sample(range(400), 50))]
    kept = []
    for _, f, _ in rows:
        if not kept or f - kept[-1] >= 30:
            kept.append(f)
    df = spark.createDataFrame(rows, "match_id long, frame long, event string")
    assert sorted(r.frame for r in S.spaced_triggers(df, 30).collect()) == kept


def test_spread_like_the_sequential_pass(spark):
    rnd = random.Random(3)
    rows = [(m, 25 + 5 * k, round(rnd.random(), 2)) for m in (1, 2) for k in range(200)]
    want = set()
    for m in (1, 2):
        kept = []
        for _, s, c in sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])):
            if len(kept) < 6 and all(abs(s - k) >= 25 for k in kept):
                kept.append(s)
        want |= {(m, s) for s in kept}
    df = spark.createDataFrame(rows, "match_id long, start long, coh double")
    got = {(r.match_id, r.start) for r in W.spread(df, keep=6).collect()}
    assert got == want


def test_quota_pick_like_the_sequential_pass(spark):
    rnd = random.Random(11)
    rows = [("header", m, s, float(rnd.randint(0, 9)), f"shape{m % 3}") for m in range(30)
            for s in range(3)]
    chosen, used, shapes = [], set(), {}
    for r in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if len(chosen) < 7 and r[1] not in used and shapes.get(r[4], 0) < 3:
            chosen.append(r[1:3])
            used.add(r[1])
            shapes[r[4]] = shapes.get(r[4], 0) + 1
    df = spark.createDataFrame(rows, "kind string, match_id long, start long, score double, "
                                     "shape string")
    got = {(r.match_id, r.start) for r in S.quota_pick(df, 7, 3).collect()}
    assert got == set(chosen)


def pool(spark, matches=120):
    rnd = random.Random(2)
    kinds = ["corner", "gk_throw", "kickoff", "open"]
    rows = [(m, kinds[m % 4], 25 * k, 25 * k + 125, rnd.randint(8, 19), rnd.randint(0, 1),
             f"{rnd.choice('ABCDEF')}{rnd.randint(1, 16)}", round(rnd.random() + 0.5, 4))
            for m in range(matches) for k in range(12)]
    return spark.createDataFrame(rows, "match_id long, kind string, start long, end long, "
                                       "level long, startown long, cell string, coh double")


def test_joint_selection_keeps_every_constraint(spark):
    got = S.joint_selection(pool(spark)).collect()
    assert len({r.match_id for r in got}) == len(got)
    slots = [(r.level, r.startown) for r in got]
    assert len(set(slots)) == len(slots)
    for kind, n in {"corner": 5, "gk_throw": 5, "kickoff": 5, "open": 9}.items():
        assert sum(r.kind == kind for r in got) == n
    assert len(got) == 24


def options(spark, rows):
    """rows: (slot, match, kind, coh)."""
    return spark.createDataFrame([(f"s{s}", m, k, "ABCDEF"[m % 6] + str(1 + m % 16), float(c)) for s, m, k, c in rows],
                                 "slot string, match_id long, kind string, cell string, coh double")


def most_slots(rows, quota):
    """Maximum flow from slots over matches and classes, by plain depth-first search."""
    room = {("slot", s): {("match", m): 1 for t, m, *_ in rows if t == s} for s, *_ in rows}
    room |= {("match", m): {("class", k): 1} for _, m, k, _ in rows}
    room |= {("class", k): {"end": n} for k, n in quota.items()} | {"start": {x: 1 for x in room if x[0] == "slot"}, "end": {}}

    def push(x, seen):
        if x == "end":
            return True
        seen.add(x)
        for y in [y for y, n in room[x].items() if n and y not in seen]:
            if push(y, seen):
                room[x][y] -= 1
                room[y][x] = room[y].get(x, 0) + 1
                return True
        return False
    n = 0
    while push("start", set()):
        n += 1
    return n


def check_picks(picks, rows, quota):
    for key in ("slot", "match_id"):
        assert len({r[key] for r in picks}) == len(picks)
    for k, n in quota.items():
        assert sum(r["kind"] == k for r in picks) <= n
    assert {(r["slot"], r["match_id"], r["kind"]) for r in picks} <= {(f"s{s}", m, k) for s, m, k, _ in rows}


def test_a_slot_is_filled_by_a_chain_of_any_length(spark):
    """Slot 0 can only use match 0, whose holder has to move, and so on: nine picks move for it."""
    rows = [(0, 0, "open", 9.0)] + [x for s in range(1, 10) for x in ((s, s - 1, "open", 0.1), (s, s, "open", 5.0))]
    rows += [(20, 100, "corner", 0.1), (20, 101, "open", 3.0), (21, 102, "corner", 1.0)]     # and a class with one place
    quota = {"open": 11, "corner": 1}
    got = matching.batch(options(spark, rows), quota, 0.0).collect()
    check_picks(got, rows, quota)
    assert sorted((r["slot"], r["match_id"]) for r in got) == sorted([(f"s{s}", s) for s in range(10)] + [("s20", 101), ("s21", 102)])


def test_scarce_pools_are_filled_as_far_as_they_can(spark):
    rnd = random.Random(4)
    for case in range(3):
        kinds = {m: rnd.choice("abc") for m in range(16)}
        rows = [(s, m, kinds[m], round(rnd.random(), 3)) for s in range(12) for m in rnd.sample(range(16), rnd.randint(1, 2))]
        quota = {"a": 4, "b": 3, "c": 5}
        got = matching.batch(options(spark, rows), quota, 0.06).collect()
        check_picks(got, rows, quota)
        assert len(got) == most_slots(rows, quota), case


def test_matches_of_several_classes_keep_the_quotas(spark):
    rnd = random.Random(6)
    rows = sorted({(s, rnd.randrange(14), rnd.choice("abc"), float(rnd.randint(1, 9))) for s in range(10) for _ in range(4)})
    quota = {"a": 3, "b": 3, "c": 4}
    check_picks(matching.batch(options(spark, rows), quota, 0.06).collect(), rows, quota)


def test_exchanges_spread_the_cells(spark):
    """No single exchange makes the result better."""
    rnd = random.Random(8)
    rows = [(s, m, "a", round(rnd.random(), 3)) for s in range(6) for m in rnd.sample(range(40), 12)]
    df = options(spark, rows)
    got = [r.asDict() for r in matching.batch(df, {"a": 6}, 0.06).collect()]
    assert len(got) == 6

    def cost(picks):
        n, cells = len(picks), [p["cell"] for p in picks]
        part = lambda f, k: sum((v - n / k) ** 2 for v in Counter(map(f, cells)).values())
        return sum(p["coh"] for p in picks) / n + 0.06 * (3 * (n - len(set(cells))) + 0.25 * part(lambda c: c[0], 6) + 0.12 * part(lambda c: c[1:], 16))
    for o in (r.asDict() for r in df.collect()):
        if o["match_id"] not in {p["match_id"] for p in got if p["slot"] != o["slot"]}:
            assert cost([o if p["slot"] == o["slot"] else p for p in got]) > cost(got) - 1e-6


def test_reselection_prefers_what_is_there(spark):
    p = pool(spark)
    old = p.where("match_id in (4, 5, 6, 7) and start = 0")
    got = S.reselect(old, p)
    assert got.count() == 24 and got.where("kept").count() >= 3
    assert got.agg(F.min("coh")).first()[0] > 0


def test_target_cells_stay_in_bounds(spark):
    got = S.target_cells(spark.range(4000).withColumnRenamed("id", "draw"))
    assert got.groupBy("row", "col").count().where("count > 2").count() == 0
    assert got.where("row < 1 or row > 5 or col < 0 or col > 15").count() == 0
    assert got.count() > 40


def test_same_play_counts_like_all_pairs(spark, small_chunks):
    rnd = random.Random(9)
    rows = [(m, s, s + 30) for m, s in ((m, rnd.randint(0, 90)) for m in range(60))]
    digests = [(m, "hot" if m % 3 else f"d{m % 5}") for m in range(60)]
    d = dict(digests)
    want = {(m, s): sum(1 for n, t, e in rows if n != m and d[n] == d[m] and s < e and t < s + 30)
            for m, s, _ in rows}
    got = L.same_play(spark.createDataFrame(rows, "match_id long, start long, end long"),
                      spark.createDataFrame(digests, "match_id long, digest string"))
    assert {(r.match_id, r.start): r.same_play for r in got.collect()} == want


def test_play_partners_like_all_pairs(spark, small_chunks):
    """Tracks that wander by up to the tolerance, of several lengths; clips anywhere, several to a match."""
    rnd = random.Random(12)
    tracks = {}
    for play in range(6):
        n = rnd.choice([5, 6])
        base = [(rnd.randint(-1000, 1000) / 1000, rnd.randint(-400, 400) / 1000) for _ in range(n)]
        for copy in range(rnd.randint(1, 6)):
            tracks[10 * play + copy] = [(x + copy * 4e-7 * rnd.choice([0, 1]), y) for x, y in base]
    tracks[90], tracks[91] = [(0.0, 0.0)] * 5, [(5e-7, -5e-7)] * 5     # on both sides of a border
    rows = [(m, f, x, y) for m, t in tracks.items() for f, (x, y) in enumerate(t)]
    clips = sorted({(m, rnd.randint(0, 80)) for m in tracks for _ in range(3)})

    def same(a, b):
        return len(tracks[a]) == len(tracks[b]) and max(abs(p - q) for u, v in zip(tracks[a], tracks[b]) for p, q in zip(u, v)) <= 1e-6
    want = set()
    for m, s in clips:
        found = min(((abs(s - t), n, t) for n, t in clips if n != m and abs(s - t) < 30 and same(m, n)), default=(30, None, None))
        want.add((m, s, found[1], found[2], 30 - found[0]))
    plays, near = L.near_plays(spark.createDataFrame(rows, "match_id long, frame long, x double, y double"), ["x", "y"])
    got = L.play_partners(spark.createDataFrame(clips, "match_id long, start long"), plays, near, 30).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_plays_move_blocks_of_frames(spark, monkeypatch):
    """No table keeps a row per frame, in traces of several blocks; digests are those of `digest`."""
    from matchlens import session
    kept = []
    for name in ("written", "cut_lineage"):
        def keep(df, of=getattr(session, name)):
            out = of(df)
            kept.append(out.count())
            return out
        monkeypatch.setattr(session, name, keep)
    rnd = random.Random(14)
    base = [(rnd.randint(-1000, 1000) / 1000, rnd.randint(-400, 400) / 1000) for _ in range(5000)]
    tracks = {1: base, 2: list(base), 3: [(x + 8e-7, y) for x, y in base], 4: [(x + (1e-5 if i == 4500 else 0), y) for i, (x, y) in enumerate(base)],
              5: [(x - 8e-7, y) for x, y in base], 6: base[:4096]}
    rows = [(m, f, *p) for m, t in tracks.items() for f, p in enumerate(t)]
    rows += [(7, f + 1, *p) for f, p in enumerate(base)]       # the same places a frame later
    trace = spark.createDataFrame(rows, "match_id long, frame long, x double, y double").repartition(7)
    plays, near = L.near_plays(trace, ["x", "y"])
    d = {r.match_id: r.digest for r in plays.collect()}
    assert d == {r.match_id: r.digest for r in L.digest(trace, ["x", "y"]).collect()} and d[1] == d[2]
    found = {(r.digest, r.near) for r in near.collect()}
    assert found == {(a, a) for a in d.values()} | {(d[a], d[b]) for a, b in ((1, 3), (3, 1), (1, 5), (5, 1))}
    assert 0 < max(kept) < 100


def test_range_sums_of_any_length(spark, small_chunks):
    """Ranges of any length, gaps between frames, ranges beyond the last frame, in panes of 1 and of 5."""
    rnd = random.Random(13)
    frames = {(m, f): rnd.randint(0, 9) for m in (1, 2) for f in range(300) if rnd.random() < 0.8}
    for pane in (1, 5):
        ranges = sorted({(m, pane * a, pane * (a + rnd.randint(1, 40))) for m in (1, 2) for a in (rnd.randint(0, 290 // pane) for _ in range(60))})
        got = chunks.range_sums(spark.createDataFrame([(*k, v) for k, v in frames.items()], "match_id long, frame long, v long"),
                                spark.createDataFrame(ranges, "match_id long, start long, end long"), {"v": F.col("v"), "n": F.lit(1)}, pane).collect()
        want = [(m, a, b, *(sum(x) for x in zip((0, 0), *[(frames[m, f], 1) for f in range(a, b) if (m, f) in frames]))) for m, a, b in ranges]
        assert sorted(map(tuple, got)) == want
    off = spark.createDataFrame([(1, 3, 10)], "match_id long, start long, end long")
    with pytest.raises(Exception, match="panes of 5"):
        chunks.range_sums(spark.range(9).selectExpr("1L as match_id", "id as frame"), off, {"n": F.lit(1)}, 5).collect()


def test_numbering_without_one_big_sort(spark):
    vals = random.Random(1).sample(range(1000), 200)
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = {r.v: r.k for r in chunks.number_rows(df, ["v"], F.expr("v div 50")).collect()}
    assert got == {v: i for i, v in enumerate(sorted(vals))}
    keyed = chunks.number_rows(df.withColumn("key", F.expr("v % 3")), ["v"], F.expr("v div 50"), key=["key"]).collect()
    assert {r.v: r.k for r in keyed} == {v: i for k in range(3) for i, v in enumerate(sorted(x for x in vals if x % 3 == k))}
    assert chunks.number_rows(df.limit(0), ["v"], None).count() == 0


def test_covering_ranges_of_any_length(spark):
    trace = spark.range(600).select(F.lit(1).cast("long").alias("match_id"),
                                    F.col("id").alias("frame"))
    ranges = spark.createDataFrame([(1, 5, 140), (1, 127, 129), (1, 590, 700)],
                                   "match_id long, a long, b long")
    rows = [(r.a, r.frame) for r in chunks.covering(trace, ranges, F.col("a"), F.col("b")).collect()]
    assert sorted(rows) == sorted((a, f) for a, b in ((5, 140), (127, 129), (590, 700)) for f in range(a, min(b, 599) + 1))


def close(rows, apart=40):
    kept = []
    for f, s in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(abs(f - k) >= apart for k, _ in kept):
            kept.append((f, s))
    return sorted(kept)


@pytest.mark.parametrize("frames", [16, 400, 8192])
def test_close_events_as_lists(spark, frames):
    rnd = random.Random(frames)
    rows = {1: [(100, 9), (130, 5), (160, 3), (160, 2), (160, 3)], 2: [(rnd.randint(0, 3000), rnd.randint(0, 20)) for _ in range(300)],
            3: [(30 * i, i) for i in range(1000)], 4: [(30 * i, -i) for i in range(200)], 5: []}
    spark.conf.set("matchlens.chunk.frames", str(frames))
    try:
        df = spark.createDataFrame([(m, f, float(s)) for m, r in rows.items() for f, s in r], "match_id long, frame long, score double")
        got = S.drop_close(df).collect()
    finally:
        spark.conf.unset("matchlens.chunk.frames")
    assert sorted((r.match_id, r.frame, r.score) for r in got) == [(m, f, s) for m, r in rows.items() for f, s in close(r)]


def test_spread_off_the_stride_grid(spark):
    rnd = random.Random(3)
    rows = [(1, s, round(rnd.random(), 2)) for s in range(25, 800)] + [(2, 25 + rnd.randint(0, 90), float(i)) for i in range(50)]
    got = W.spread(spark.createDataFrame(rows, "match_id long, start long, coh double"), keep=10).collect()
    for m in (1, 2):
        kept = []
        for _, s, c in sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])):
            if len(kept) < 10 and all(abs(s - k) >= 25 for k, _ in kept):
                kept.append((s, c))
        assert sorted((r["rank"], r["start"], r["coh"]) for r in got if r["match_id"] == m) == [(i + 1, s, c) for i, (s, c) in enumerate(kept)]


def test_windows_of_any_length_against_spans(spark):
    rnd = random.Random(5)
    windows = [(1, s, s + n) for s, n in ((rnd.randint(0, 3000), rnd.choice([1, 100, 700, 2000])) for _ in range(200))]
    spans = [(1, lo, lo + rnd.randint(0, 60)) for lo in (rnd.randint(0, 5000) for _ in range(6))]
    w = spark.createDataFrame(windows, "match_id long, start long, end long")
    s = spark.createDataFrame(spans, "match_id long, lo long, hi long")
    tests = {"overlap": lambda a, b, lo, hi: a <= hi and lo <= b - 1,
             "ends": lambda a, b, lo, hi: lo <= a <= hi or lo <= b - 1 <= hi}
    for rule, hit in tests.items():
        want = sorted((a, b) for _, a, b in windows if not any(hit(a, b, lo, hi) for _, lo, hi in spans))
        assert sorted((r.start, r.end) for r in L.outside_spans(w, s, rule).collect()) == want
