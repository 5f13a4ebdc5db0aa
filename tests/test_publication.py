"""Publication of several tables: a writer that fails or dies at any step leaves the old version or the new one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.sources import publication as pub


def tables(spark, value):
    return {"t": spark.createDataFrame([(value,)], "a int"), "u": spark.createDataFrame([(value,), (value,)], "a int")}


def seen(spark, root):
    t, u = pub.read_published(spark, root, "t", "u", schema="a int")
    values = {r["a"] for r in t.collect()} | {r["a"] for r in u.collect()}
    assert len(values) == 1, "a mix of versions"
    return values.pop()


class Dies(pub.Store):
    """Does ``steps`` changes, then fails: at every later one too if ``dead``. ``after``: the failing change itself takes place."""

    def __init__(self, spark, root, steps, dead, after):
        super().__init__(spark, root)
        self.left, self.dead, self.after, self.failed = steps, dead, after, False

    def _step(self, change, *args):
        if self.failed and self.dead:
            raise OSError("dead")
        self.left -= 1
        if self.left < 0 and not self.failed:
            self.failed = True
            if self.after:
                change(*args)
            raise OSError("stopped")
        return change(*args)

    def create(self, name, text):
        self._step(super().create, name, text)

    def rename(self, old, new):
        self._step(super().rename, old, new)

    def delete(self, name):
        self._step(super().delete, name)


@pytest.mark.parametrize("dead", [False, True])
@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("steps", range(4))
def test_old_or_new_at_every_step(spark, tmp_path, steps, dead, after):
    root = str(tmp_path / "data")
    assert pub.publish_tables(spark, tables(spark, 1), root) == 1
    with pytest.raises(OSError, match="stopped|dead"):
        pub.publish_tables(spark, tables(spark, 2), root, store=Dies(spark, root, steps, dead, after))
    # claim, pointer aside, rename, claim dropped: the third of them publishes
    assert seen(spark, root) == (2 if steps > 2 or steps == 2 and after else 1)
    pub.recover(spark, root)
    assert seen(spark, root) == (2 if steps > 2 or steps == 2 and after else 1)
    pub.publish_tables(spark, tables(spark, 3), root)
    assert seen(spark, root) == 3
    versions, _ = pub.current(spark, root)
    pub.recover(spark, root, keep=1)
    store = pub.Store(spark, root)
    assert seen(spark, root) == 3 and len(store.names("versions")) == len(store.names("pointers")) == 1 and not store.names("claims")


def test_a_failing_table_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "data")
    pub.publish_tables(spark, tables(spark, 1), root)
    bad = spark.createDataFrame([(2,)], "a int").select(F.raise_error(F.lit("no")).cast("int").alias("a"))
    with pytest.raises(Exception, match="no"):
        pub.publish_tables(spark, {"t": spark.createDataFrame([(5,)], "a int"), "u": bad}, root)
    store = pub.Store(spark, root)
    assert seen(spark, root) == 1 and len(store.names("versions")) == 1 and not store.names("claims")


def test_tables_keep_their_version_until_replaced(spark, tmp_path):
    root = str(tmp_path / "data")
    assert pub.current(spark, root) == (0, {})
    with pytest.raises(FileNotFoundError):
        pub.read_published(spark, root, "t")
    pub.publish_tables(spark, tables(spark, 1), root)
    pub.publish_tables(spark, {"u": spark.createDataFrame([(9,)], "a int")}, root)
    t, u = pub.read_published(spark, root, "t", "u")
    assert [r["a"] for r in t.collect()] == [1] and [r["a"] for r in u.collect()] == [9]
    assert pub.recover(spark, root) == {"claims": [], "pointers": [], "versions": []}


def test_one_writer_at_a_time(spark, tmp_path):
    root = str(tmp_path / "data")
    store = pub.Store(spark, root)
    store.create(f"claims/{1:012d}", "another writer's")
    with pytest.raises(pub.PublicationUnderWay):
        pub.publish_tables(spark, tables(spark, 1), root)
    assert pub.publish_tables(spark, tables(spark, 1), root, stale_seconds=0) == 1 and seen(spark, root) == 1


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path / "data")
    pub.publish_tables(spark, {"t": spark.createDataFrame([], "a int")}, root)
    assert pub.read_published(spark, root, "t", schema="a int")[0].collect() == []
