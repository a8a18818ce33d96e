"""Tasks over nested trees take a bounded number of modules."""

from duck import connect, same

import __spark_entry__ as entry
from spindrift.operators import trees

D = "/root/testdata/sf0.001"


def test_tasks_take_a_bounded_number_of_modules(spark, monkeypatch):
    monkeypatch.setattr(trees, "ROWS", 100)
    out = entry.queries()["mod_02_subtree_files"](spark, D)
    assert out.rdd.getNumPartitions() >= out.count() // 100
    same(out, connect(D), entry.oracle_sql()["mod_02_subtree_files"])
