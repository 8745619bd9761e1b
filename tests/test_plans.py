"""Plan shape of the registered queries (what must hold at 100 TB, checked on sf0.001).

* No window is partitioned by a key: a hot key would land in one task.
* No cartesian product or nested-loop join anywhere.
* A window without partitioning (one task) only runs on input that is
  bounded by construction: after a top-k / limit, or over the one-row-per-
  partition count table of the id numbering.
* Point lookups reach the parquet scan as pushed filters and read only the
  projected columns; no query reads every column of a fact table.
"""

import pytest

from paths import SF_SMALL

STREAMING = {"stream_snapshot_ingest", "stream_error_isolation", "stream_documents",
             "stream_sequence_errors"}
# nodes that neither bound nor grow the rows a single-task window sees
PASS_THROUGH = {"Sort", "Project", "Filter", "Exchange", "Window", "WholeStageCodegen",
                "InputAdapter", "AQEShuffleRead", "ShuffleQueryStage", "WindowGroupLimit"}
BOUNDED = {"TakeOrderedAndProject", "GlobalLimit", "CollectLimit"}


def _children(node):
    ch = node.children()
    return [ch.apply(i) for i in range(ch.size())]


def _walk(node):
    yield node
    for c in _children(node):
        yield from _walk(c)


def _plan(df):
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    return plan


def _subqueries(node):
    subs = node.subqueries()
    return [subs.apply(i) for i in range(subs.size())]


def _all_nodes(plan):
    for n in _walk(plan):
        yield n
        for s in _subqueries(n):
            yield from _all_nodes(s)


def _bounded_source(node):
    """First operator below ``node`` that changes the row count, skipping pass-throughs."""
    while node.nodeName() in PASS_THROUGH:
        ch = _children(node)
        if len(ch) != 1:
            return node
        node = ch[0]
    return node


def _is_bounded(node) -> bool:
    if node.nodeName() in BOUNDED:
        return True
    if node.nodeName() == "HashAggregate":
        keys = node.groupingExpressions()
        names = {keys.apply(i).toString().split("#")[0] for i in range(keys.size())}
        return names == {"_pid"}          # one row per partition (id offsets)
    return False


@pytest.fixture(scope="module")
def plans(spark):
    from pumpwatch.plans.registry import load_all
    out = {}
    for name, entry in load_all().items():
        if name not in STREAMING:
            out[name] = _plan(entry.build(spark, SF_SMALL))
    return out


def test_no_key_partitioned_windows(plans):
    bad = []
    for name, plan in plans.items():
        for n in _all_nodes(plan):
            if n.nodeName() == "Window" and n.partitionSpec().size() > 0:
                bad.append((name, n.toString()[:120]))
    assert not bad, bad


def test_single_task_windows_run_on_bounded_input(plans):
    bad = []
    for name, plan in plans.items():
        for n in _all_nodes(plan):
            if n.nodeName() == "Window" and n.partitionSpec().size() == 0:
                src = _bounded_source(_children(n)[0])
                if not _is_bounded(src):
                    bad.append((name, src.nodeName()))
    assert not bad, bad


def _scan_of(plan, table):
    scans = [n for n in _all_nodes(plan)
             if n.nodeName().startswith("Scan") and f"{table}.parquet" in n.toString()]
    assert scans, f"no scan of {table}"
    return scans


@pytest.mark.parametrize("name", ["latest_prices", "changed_since_previous", "vanished_since_previous",
                                  "snapshot_changes"])
def test_newest_snapshots_are_read_by_a_pushed_time_filter(plans, name):
    for scan in _scan_of(plans[name], "events"):
        pushed = scan.toString().split("PushedFilters: [")[1].split("ReadSchema")[0]
        assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed, pushed


def test_price_moves_join_parts_of_a_key(plans):
    """The facts meet the moves' origins by (station, fuel, part), not by the key alone."""
    keys = [n.toString() for n in _all_nodes(plans["price_variations"]) if "Join" in n.nodeName()]
    assert any("_part" in k for k in keys), keys


def test_point_lookups_push_filters_and_prune_columns(plans):
    (scan,) = _scan_of(plans["prices_of_snapshot"], "lineitem")
    meta = scan.metadata()
    assert "l_orderkey" in meta.apply("PushedFilters")
    assert meta.apply("ReadSchema").count(":") == 4   # the four projected columns only
    pushed = [s.metadata().apply("PushedFilters")
              for s in _scan_of(plans["station_price_extract"], "lineitem")]
    assert all("l_suppkey" in p for p in pushed)


def test_latest_prices_is_top_k(plans):
    names = {n.nodeName() for n in _all_nodes(plans["latest_prices"])}
    assert "TakeOrderedAndProject" in names and "Window" not in names


def test_no_cross_or_nested_loop_joins(plans):
    bad = [(name, n.nodeName()) for name, plan in plans.items() for n in _all_nodes(plan)
           if n.nodeName() in ("CartesianProduct", "BroadcastNestedLoopJoin")]
    assert not bad, bad


def test_fact_scans_are_column_pruned(spark, plans):
    """No registered query reads every column of a fact table."""
    width = {t: len(spark.read.parquet(f"{SF_SMALL}/{t}.parquet").columns)
             for t in ("lineitem", "orders", "events")}
    bad = []
    for name, plan in plans.items():
        for n in _all_nodes(plan):
            if not n.nodeName().startswith("Scan"):
                continue
            text = n.toString()
            for t, w in width.items():
                if f"/{t}.parquet" in text:
                    read = n.metadata().apply("ReadSchema")
                    if read.count(":") >= w:
                        bad.append((name, t, read))
    assert not bad, bad
