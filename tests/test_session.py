"""Staged tables."""

import threading

from trustkpi.session import stage, staged_for


def test_threads_delete_only_their_own_staged_tables(spark):
    kept = []
    with staged_for(spark):
        here = stage(spark.range(3).toDF("id"), "here")
        other = threading.Thread(target=lambda: kept.append(stage(spark.range(5).toDF("id"), "there")))
        other.start()
        other.join()
        assert here.count() == 3
    assert kept[0].count() == 5
