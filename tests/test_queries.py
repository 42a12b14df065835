"""Registered queries against their SQL twins, on the smallest data."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal
from matchlens.plans import catalog

SF = "/root/testdata/sf0.001"
# The selections of a whole batch need more matches than the smallest data has; check.py compares
# them, and all queries, on larger data.
TWINS = ["sliding_windows", "spread_windows", "restart_awards", "goal_clips", "outside_absent_overlap",
         "people_histogram", "ball_centroid", "body_and_shadow", "scoreboard", "category_grades",
         "grid_heatmap", "camera_offsets", "zones_and_crowding", "flipped_observations", "job_matrix",
         "check_key", "scarce_levels", "watchable_windows", "online_step_events", "online_keeper_sessions",
         "online_people_per_second", "batch_scores", "reasoning_split", "classification_columns",
         "clip_sentences", "full_pool", "probe_plan", "target_cells", "match_array_ingest", "step_log_reader",
         "published_step_lists", "published_maps", "published_key", "published_lists", "published_category_answers"]
# those that cut traces in chunks, or join along them
CHUNKED = ["sliding_windows", "kickoff_restarts", "possession_as_of", "waiting_counter", "checkpoint_rewards",
           "keeper_throws", "header_turns", "corner_quality", "restart_candidates", "distinct_events",
           "same_play_clips", "clip_classification", "captured_steps"]


def compare(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    want = normal(rel.fetchall(), [d[0] for d in rel.description])
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got.equals(want)


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, name):
    compare(spark, name)


@pytest.mark.parametrize("name", CHUNKED)
def test_twin_with_short_chunks(spark, small_chunks, name):
    compare(spark, name)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_names_what_it_covers():
    assert all(q.covers for q in catalog.QUERIES.values())
