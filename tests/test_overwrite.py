"""A table is never lost while it is replaced."""

import os

import pytest

from tarnwatch.operators import upsert


def test_replaces_what_it_reads(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    upsert.overwrite(spark.range(5), path)
    upsert.overwrite(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["t"]


@pytest.mark.parametrize("fails", [1, 2])
def test_a_failing_rename_leaves_the_old_table(spark, tmp_path, monkeypatch, fails):
    path, calls = f"file://{tmp_path}/t", []
    upsert.overwrite(spark.range(5), path)
    own = upsert.moved

    def moved(fs, a, b):
        calls.append(str(b))
        if len(calls) == fails:
            raise OSError("no")
        own(fs, a, b)

    monkeypatch.setattr(upsert, "moved", moved)
    with pytest.raises(OSError, match="no"):
        upsert.overwrite(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5


def test_a_crash_between_the_steps_is_settled(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    upsert.overwrite(spark.range(5), path)
    os.rename(tmp_path / "t", tmp_path / "t.old")  # the old one has stepped aside, the new one has no place yet
    upsert.recover(spark, path)
    assert spark.read.parquet(path).count() == 5
    spark.range(3).write.parquet(f"{path}.old")  # the new one has its place, the old one is still there
    upsert.overwrite(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and not os.path.exists(tmp_path / "t.old")


def test_a_rename_that_says_no_raises():
    class No:
        def rename(self, a, b):
            return False

    with pytest.raises(OSError):
        upsert.moved(No(), "a", "b")
