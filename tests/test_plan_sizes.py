"""No join broadcasts rows that were unfolded from a few: their number is unknown to Spark."""
import pytest

import __spark_entry__ as entry

SMALL = 20_000      # far fewer rows than the 60,000 frames of sf0.01


def broadcast_rows(df):
    """Rows of every broadcast of an executed plan, its subqueries and stages included."""
    df.collect()
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            open_.append(node.plan())
        else:
            if name == "BroadcastExchange":
                found.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            open_ += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("name", ["camera_offsets", "captured_steps", "exact_count_windows", "pool"])
def test_frames_are_not_broadcast(spark, name):
    assert max(broadcast_rows(entry.queries()[name](spark, "/root/testdata/sf0.01")), default=0) < SMALL


def test_large_shuffles_get_more_tasks_than_the_setting_names(spark):
    from matchlens.operators import events
    from matchlens.plans import fixtures
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                        "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
        found = events.awards(fixtures.trace(spark, "/root/testdata/sf0.01"))
        assert found.rdd.getNumPartitions() > 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_pool_reads_the_windows_plan_once(spark):
    """Lookups join the windows several times; their plan over the trace must not stand in the pool's as often."""
    from matchlens.plans import q_select
    plan = q_select.kpool(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    traced = sum("l_suppkey" in leaves.apply(i).output().toString() for i in range(leaves.size()))
    assert 0 < traced <= 8


def test_rounds_of_a_batch_have_small_plans(spark, monkeypatch):
    """Each round's plan stays in the driver's memory until it is collected: counts of the grid are no joins of their own."""
    from matchlens import session
    from matchlens.operators import matching
    joins = []

    def cut(df, of=session.cut_lineage):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins.append(sum("Join " in line for line in plan.splitlines()))
        return of(df)
    monkeypatch.setattr(session, "cut_lineage", cut)
    rows = [(f"s{i % 3}", i, "ab"[i % 2], "ABCDEF"[i % 6] + str(1 + i % 16), 0.1 * (i % 7)) for i in range(30)]
    options = spark.createDataFrame(rows, "slot string, match_id long, kind string, cell string, coh double")
    picks = options.where("match_id in (0, 4, 5)")
    joins.clear()
    assert matching.exchanged(options, picks, 0.06).count() == 3
    assert 0 < max(joins) <= 4


def test_windows_of_a_written_table_are_not_broadcast(spark):
    from matchlens import session
    from matchlens.operators import lookups as L
    w = session.written(spark.range(40_000).selectExpr("id % 100 as match_id", "id as start", "id + 125 as end"))
    spans = spark.range(100).selectExpr("id as match_id", "10 * id as lo", "10 * id + 30 as hi")
    assert max(broadcast_rows(L.outside_spans(w, spans)), default=0) < SMALL
    inshot = spark.range(1000).selectExpr("id % 100 as match_id", "id as frame", "array(30L) as body")
    assert max(broadcast_rows(L.with_end_counts(w, inshot)), default=0) < SMALL


# Queries on the best windows of a pool, with what each adds to it
@pytest.mark.parametrize("name", ["check_published_counts", "clip_classification", "clip_recipes"])
def test_pools_and_their_frames_are_not_broadcast(spark, name):
    assert max(broadcast_rows(entry.queries()[name](spark, "/root/testdata/sf0.01")), default=0) < SMALL


def test_pixels_are_dealt_before_they_unfold(spark):
    """The few bytes of a frame pair become many pixels: left to adaptive execution, all of them would meet in one task."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert entry.queries()["paired_passes"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
