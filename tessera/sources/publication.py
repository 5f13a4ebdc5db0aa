"""Several tables published together: numbered versions, and one pointer that readers follow.

A folder holds ``versions/<number>-<id>/<table>`` (JSON lines) and ``pointers/<number>.json``, the map from tables to folders. A writer claims the next number, writes its tables under
a folder of its own, and last renames a finished pointer into place: that rename is the publication. Readers take the highest pointer, so they see the tables of
one version, old or new, whenever they look and wherever a writer stops. Nothing is moved or replaced, so there is nothing to roll back: a failure deletes what
its own writer has made, and if even that fails, unreferenced folders stay until ``recover``.

A claim of a writer that has died holds later writers up until it is STALE_SECONDS old, or ``recover`` drops it.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

STALE_SECONDS = 3600
#: Versions that ``recover`` keeps, so that readers of the last ones can finish.
KEPT_VERSIONS = 2


class PublicationUnderWay(RuntimeError):
    """Another writer has claimed the next version."""


class Store:
    """The few operations that publication needs, on a folder's own file system. The driver handles names and small records only."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = root.rstrip("/")

    def names(self, folder: str) -> dict[str, float]:
        """Names in a folder and when they were changed, in seconds."""
        place = self.path(f"{self.root}/{folder}")
        if not self.fs.exists(place):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(place)}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that isn't there yet."""
        stream = self.fs.create(self.path(f"{self.root}/{name}"), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        target = self.path(f"{self.root}/{new}")
        if self.fs.exists(target) or not self.fs.rename(self.path(f"{self.root}/{old}"), target):
            raise OSError(f"can't rename {old} to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


def _number(name: str) -> int:
    return int(name.partition(".")[0].partition("-")[0])


def _pointers(store: Store) -> list[str]:
    return sorted(n for n in store.names("pointers") if n.endswith(".json"))


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The version that readers see, 0 if none, and its tables' folders."""
    store = Store(spark, root)
    found = _pointers(store)
    return (_number(found[-1]), json.loads(store.read(f"pointers/{found[-1]}"))) if found else (0, {})


def read_published(spark: SparkSession, root: str, *names: str, schema: Any = None) -> list[DataFrame]:
    """Tables of one version, the newest. ``schema`` spares a pass over them; without one it is taken from the rows."""
    _, tables = current(spark, root)
    if missing := [n for n in names if n not in tables]:
        raise FileNotFoundError(f"not published in {root}: {missing}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return [reader.json(f"{root.rstrip('/')}/{tables[n]}") for n in names]


def publish_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str, stale_seconds: float = STALE_SECONDS, store: Store | None = None) -> int:
    """Write several tables and publish them together, beside those published before under other names. Returns the version."""
    store = store or Store(spark, root)
    number, before = current(spark, root)
    number += 1
    claim, folder, aside = f"claims/{number:012d}", f"versions/{number:012d}-{uuid.uuid4().hex}", f"claims/{number:012d}-{uuid.uuid4().hex}.pointer"
    held = store.names("claims").get(claim.partition("/")[2])
    if held is not None:
        if time.time() - held < stale_seconds:
            raise PublicationUnderWay(f"version {number} of {root}")
        store.delete(claim)
    store.create(claim, folder)
    done = False
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{store.root}/{folder}/{name}")
        store.create(aside, json.dumps(before | {n: f"{folder}/{n}" for n in tables}))
        store.rename(aside, f"pointers/{number:012d}.json")
        done = True
    finally:
        # Whether the rename took place is read from the store: an error may come after it.
        if not done and not _settled(store, number):
            for name in (aside, folder, claim):
                store.delete(name)
    store.delete(claim)
    return number


def _settled(store: Store, number: int) -> bool:
    """Is the version published, as far as the store tells? If it can't tell, nothing is deleted."""
    try:
        return f"{number:012d}.json" in store.names("pointers")
    except Exception:  # noqa: BLE001  the first error is the one to report
        return True


def recover(spark: SparkSession, root: str, keep: int = KEPT_VERSIONS, stale_seconds: float = 0.0) -> dict[str, list[str]]:
    """Drop what dead writers have left, and pointers older than the last ``keep`` with the folders that only they name. Returns what was dropped, by kind."""
    store, now = Store(spark, root), time.time()
    claims = {n: t for n, t in store.names("claims").items()}
    alive = {n for n, t in claims.items() if now - t < stale_seconds}
    pointers = _pointers(store)
    kept = pointers[-keep:]
    named = {f.rpartition("/")[0].rpartition("/")[2] for p in kept for f in json.loads(store.read(f"pointers/{p}")).values()}
    busy = {_number(n) for n in alive}
    dropped = {
        "claims": sorted(set(claims) - alive),
        "pointers": [p for p in pointers if p not in kept],
        "versions": sorted(v for v in store.names("versions") if v not in named and _number(v) not in busy),
    }
    # Pointers go first, so that no pointer ever names a folder that is gone.
    for kind in ("pointers", "versions", "claims"):
        for name in dropped[kind]:
            store.delete(f"{kind}/{name}")
    return dropped
