"""Hand-written traces: first frame, last frame, ties, exact thresholds, empty matches."""
from conftest import steps

from matchlens.operators import episode, events as E, gates, lookups as L, report as R, windows as W


def test_award_on_first_and_last_frame(make, small_chunks):
    t = make(steps(40, game_mode=lambda f: 4 if f < 3 or f == 39 else 0))
    got = {(r.frame, r.opens) for r in E.awards(t).collect()}
    assert got == {(0, True), (39, False)}


def test_delivery_needs_movement_within_search(make, small_chunks):
    mode = {5: 4, 6: 4}
    moving = make(steps(60, game_mode=mode, ball_x=lambda f: 0.0 if f <= 30 else 0.01 * (f - 30)))
    r = E.deliveries(moving).collect()
    assert [(x.award, x.anchor, x.min_start) for x in r] == [(5, 30, 6)]
    assert E.deliveries(moving, search=20).count() == 0
    assert E.deliveries(make(steps(60, game_mode=mode))).count() == 0


def test_keeper_hold_must_end_before_the_trace(make, small_chunks):
    def held(lo, hi):
        return {"owned_team": lambda f: 1 if lo <= f < hi else -1,
                "owned_player": lambda f: 0 if lo <= f < hi else -1,
                "ball_z": lambda f: 1.3,
                "ball_x": lambda f: 0.0 if f < hi else 0.02 * (f - hi + 1)}
    got = E.keeper_holds(make(steps(90, **held(10, 45)))).collect()
    assert [(r.caught, r.anchor, r.hold_frames, r.team) for r in got] == [(10, 44, 35, 1)]
    assert E.keeper_holds(make(steps(45, **held(10, 45)))).count() == 0
    assert E.keeper_holds(make(steps(90, **held(10, 19)))).count() == 0


def test_kickoff_needs_the_mark_and_both_sides_home(make, small_chunks):
    t = steps(50, ball_x=lambda f: 0.0 if f < 20 else 0.01 * (f - 19))
    got = E.kickoffs(make(t)).collect()
    assert [(r.award, r.anchor, r.opening) for r in got] == [(0, 19, True)]
    away = [r[:-1] + ([(-0.5, 0.0)] * 2 + home_right()[2:],) for r in t]
    assert E.kickoffs(make(away)).count() == 0


def home_right():
    from conftest import home
    return home(1)


def test_goal_on_score_change(make, small_chunks):
    t = make(steps(40, score_l=lambda f: 1 if f >= 17 else 0, ball_x=lambda f: 0.02 * f))
    got = E.goals(t).collect()
    assert [(r.frame, r.before_l, r.after_l) for r in got] == [(17, 0, 1)]
    assert abs(got[0].ball_x - 0.32) < 1e-9


def windows(make, n=176, **over):
    return {r.start: r for r in W.sliding(make(steps(n, **over))).collect()}


def test_window_starts_exclude_the_last_legal_one(make, small_chunks):
    assert sorted(windows(make, 176)) == [25, 30, 35, 40, 45, 50]
    assert sorted(windows(make, 175)) == [25, 30, 35, 40, 45]
    assert windows(make, 124) == {}


def test_step_at_threshold_is_a_teleport(make, small_chunks):
    def gate(x):
        t = make(steps(160, ball_x=lambda f: x if f >= 60 else 0.0))
        return {r.start for r in W.sliding(t).where(W.continuous()).collect()}
    assert gate(0.35) == set()
    assert gate(0.349) == {25, 30}


def test_jump_into_the_opening_frame_does_not_count(make, small_chunks):
    t = make(steps(160, ball_x=lambda f: 0.5 if f >= 30 else 0.0))
    assert {r.start for r in W.sliding(t).where(W.continuous()).collect()} == {30}


def test_ball_past_the_line_outside_the_posts_is_kept(make, small_chunks):
    def kept(y):
        return W.sliding(make(steps(156, ball_x=lambda f: 1.011, ball_y=lambda f: y))).where(
            W.continuous()).count()
    assert kept(0.30) == 2 and kept(0.04) == 0


def test_restart_without_teleport_closes_the_window(make, small_chunks):
    t = make(steps(160, game_mode=lambda f: 4 if f >= 100 else 0))
    assert W.sliding(t).where(W.no_restart()).count() == 0
    t = make(steps(160, game_mode=lambda f: 4 if f >= 30 else 0))
    assert {r.start for r in W.sliding(t).where(W.no_restart()).collect()} == {30}


def test_possession_falls_back_before_then_inside(make, small_chunks):
    t = make(steps(80, owned_team={40: 1, 41: 1, 60: 0}, owned_player={40: 3, 41: 3, 60: 2}))
    own = {r.frame: r.owner for r in L.possession(t, clip=30).collect()}
    assert own[5] == -1 and own[12] == 1 and own[41] == 1 and own[59] == 1 and own[79] == 0


def test_nearest_player_tie_goes_to_the_lowest_slot(make):
    rows = steps(1)
    r = list(rows[0])
    r[-2] = [(0.5, 0.0)] * 3 + [(0.1, 0.0), (-0.1, 0.0)] + [(0.5, 0.0)] * 6
    r[-1] = [(0.1, 0.0)] + [(0.9, 0.0)] * 10
    got = L.nearest(make([tuple(r)])).first()
    assert (got.team, got.slot) == (0, 3)


def test_loose_frame_splits_a_run(make, small_chunks, spark):
    own = {25: 0, 26: 0, 27: -1, 28: 0, 29: 0, 30: 0, 31: 0, 32: 1, 33: 1}
    who = {25: 4, 26: 4, 27: -1, 28: 4, 29: 4, 30: 7, 31: 7, 32: 2, 33: 2}
    t = make(steps(130, owned_team=own, owned_player=who))
    clips = spark.createDataFrame([(1, 0, 125)], "match_id long, start long, end long")
    r = R.passes(clips, t, visible=26).first()
    assert (r.passes, r.turnovers, r.changes) == (1, 1, 2)


def test_span_rules_at_their_borders(spark):
    w = spark.createDataFrame([(1, 100, 225), (1, 101, 226), (1, 300, 425), (1, 500, 625)],
                              "match_id long, start long, end long")
    s = spark.createDataFrame([(1, 90, 100), (1, 350, 360), (1, 625, 700)],
                              "match_id long, lo long, hi long")
    assert {r.start for r in L.outside_spans(w, s, "ends").collect()} == {101, 300, 500}
    assert {r.start for r in L.outside_spans(w, s, "overlap").collect()} == {101, 500}


def test_waiting_and_episode_end(make, small_chunks):
    t = make(steps(60, game_mode=lambda f: 3 if 10 <= f < 45 else 0, owned_team={3: 0, 50: 1}))
    wait = {r.frame: r.waiting for r in episode.waiting(t).collect()}
    assert wait[9] == 0 and wait[10] == 1 and wait[44] == 35 and wait[45] == 0
    e = episode.episode_end(t, 55).first()
    assert (e.on_score, e.on_out_of_play, e.on_possession_change, e.on_duration, e.ends) == (
        None, 10, 50, 54, 10)


def test_longest_slide_stops_at_the_trace_end(make, small_chunks, spark):
    t = make(steps(150, ball_x=lambda f: 0.6))
    w = spark.createDataFrame([(1, 0, 125), (1, 25, 150)], "match_id long, start long, end long")
    got = {r.start: r.max_slide for r in gates.longest_slide(w, t).collect()}
    assert got == {0: 25, 25: 0}
