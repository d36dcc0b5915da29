"""Intermediate tables: in one folder of the application, and gone when told."""

import os

from quillstream import session
from quillstream.operators.groups import written


def test_intermediate_tables_go(spark):
    one, two = (written(spark.range(10).withColumnRenamed("id", name)) for name in ("a", "b"))
    folder = session.run_folder(spark).removeprefix("file://")
    assert one.count() == two.count() == 10
    before = set(os.listdir(folder))
    assert len(before) >= 2 and session.shared_folder(spark) != session.shared_folder(spark)
    session.clear(spark)
    assert not os.path.exists(folder)
    session.clear(spark)  # nothing left is no fault
    assert written(spark.range(3)).count() == 3
