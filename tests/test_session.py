"""Lifetime of the tables the library writes."""

import os

import pytest

from contentmark.session import materialize, scratch
from contentmark.sources.pages import scratch_path


def test_scratch_removes_its_tables_only(spark):
    before = materialize(spark.range(5), "kept")
    with scratch(spark) as room:
        outer = materialize(spark.range(7), "outer")
        with scratch(spark) as inner_room:
            inner = materialize(outer.where("id > 2"), "inner")
            assert inner.count() == 4
            spark.range(3).write.parquet(scratch_path(spark, "folder"))
        assert outer.count() == 7
        local = room.removeprefix("file:")
        assert os.path.isdir(local) and not os.path.exists(inner_room.removeprefix("file:"))
    assert not os.path.exists(local)
    assert before.count() == 5 and materialize(spark.range(2)).count() == 2


def test_scratch_after_an_error_and_without_tables(spark):
    with pytest.raises(KeyError), scratch(spark) as room:
        materialize(spark.range(1))
        raise KeyError("x")
    assert not os.path.exists(room.removeprefix("file:"))
    with scratch(spark):
        pass
