"""Tables of an earlier stage go when the next one starts, unless its input reads them."""

import threading
from pathlib import Path

from driftline.llm import common


def test_tables_go_with_the_next_stage(spark):
    with common.stage_tables(spark, spark.range(1)):
        first = common.written(spark.range(5))
        common.bucketed(spark.range(5), "id")
    folder = Path(first.inputFiles()[0].removeprefix("file:")).parents[1]
    names = [n for n, p in common._tables.items() if folder.name in p]
    assert len(names) == 1 and spark.catalog.tableExists(names[0])
    with common.stage_tables(spark, first.where("id > 0")):
        pass
    assert first.count() == 5  # still read, so still there
    with common.stage_tables(spark, spark.range(1)):
        pass
    assert not folder.exists() and not spark.catalog.tableExists(names[0])


def test_runs_side_by_side_keep_their_tables(spark):
    """Two threads go through their stages in turn; each one's tables go by its own stages only."""
    turn, seen, failed = threading.Barrier(2, timeout=120), {}, []

    def go(name):
        try:
            with common.stage_tables(spark, spark.range(1)):
                mine = common.written(spark.range(5))
                common.bucketed(spark.range(5), "id")
            turn.wait()
            if name == "a":
                with common.stage_tables(spark, spark.range(1)):
                    pass
            turn.wait()
            folder = Path(mine.inputFiles()[0].removeprefix("file:")).parents[1]
            seen[name] = folder.exists()
            if name == "b":
                assert mine.count() == 5
                with common.stage_tables(spark, spark.range(1)):
                    pass
                assert not folder.exists()
        except BaseException as e:  # a thread's failure is the test's
            failed.append(e)
            turn.abort()

    threads = [threading.Thread(target=go, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and seen == {"a": False, "b": True}


def test_a_run_leaves_tables_of_stages_before_it(spark):
    with common.stage_tables(spark, spark.range(1)):
        before = common.written(spark.range(5))
    with common.intermediate(spark):
        with common.stage_tables(spark, spark.range(1)):
            inside = common.written(spark.range(3))
        assert inside.count() == 3
    assert before.count() == 5
    assert not Path(inside.inputFiles()[0].removeprefix("file:")).exists()
