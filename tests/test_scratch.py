from pathlib import Path

from shatterlens import scratch
from shatterlens.scratch import Scratch


def test_tables_are_written_dropped_and_cleared(spark):
    s = Scratch(spark)
    a, b = s.save(spark.range(3), "a"), s.save(spark.range(4), "b")
    folder = Path(s.root.removeprefix("file://"))
    assert a.count() == 3 and b.count() == 4 and len(list(folder.iterdir())) == 2
    s.drop(a)
    assert len(list(folder.iterdir())) == 1 and b.count() == 4
    before, scratch._roots[:] = list(scratch._roots), [s.root]
    scratch.clear(spark)
    scratch._roots[:] = [r for r in before if r != s.root]
    assert not folder.exists()
