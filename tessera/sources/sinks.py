"""Record sinks: exclusive and replacing writes, deterministic archives, contracts of a folder. Tables that are published together: see publication."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import shutil
import tarfile
import uuid
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def write_jsonl(df: DataFrame, path: str, refuse_overwrite: bool = False) -> None:
    """JSON lines; the commit protocol publishes them whole or not at all."""
    df.write.mode("errorifexists" if refuse_overwrite else "overwrite").option("ignoreNullFields", False).json(path)


def put_bytes(spark: SparkSession, path: str, raw: bytes, refuse_overwrite: bool = False) -> None:
    """A file in any store that Spark writes, for the driver's own small records: written aside, then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    target, aside = place(path), place(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    if refuse_overwrite and fs.exists(target):
        raise FileExistsError(path)
    out = fs.create(aside, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"can't put {path}")


def put_json(spark: SparkSession, path: str, value: Any, refuse_overwrite: bool = False) -> None:
    put_bytes(spark, path, (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode(), refuse_overwrite)


def bundle_bytes(files: dict[str, bytes]) -> bytes:
    """A tar.gz whose bytes depend on names and contents only."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name in sorted(files):
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = len(files[name]), 0o644, 0
            tar.addfile(info, io.BytesIO(files[name]))
    return gzip.compress(out.getvalue(), mtime=0)


def write_json_object(path: str, value: Any) -> None:
    """One local JSON file, for the driver's own records: written aside, then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    aside = target.with_name(f".{target.name}.{uuid.uuid4().hex}.tmp")
    aside.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    os.replace(aside, target)


def manifest_of(files: dict[str, bytes]) -> list[dict[str, Any]]:
    return [{"path": p, "bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for p, b in sorted(files.items())]


def write_bundle(files: dict[str, bytes], path: str) -> bool:
    """A tar.gz whose bytes depend on names and contents only. An equal one that is there is left; another one is refused. True if written."""
    raw = bundle_bytes(files)
    target = Path(path)
    if target.exists():
        if target.read_bytes() == raw:
            return False
        raise FileExistsError(f"{path} holds another bundle")
    aside = target.with_name(f".{target.name}.{uuid.uuid4().hex}.tmp")
    aside.write_bytes(raw)
    os.replace(aside, target)
    return True


def extract_bundle(path: str, manifest: Iterable[dict[str, Any]], out: str) -> None:
    """Unpack a bundle whose members are the manifest's files, no more and no less, into a folder that isn't there yet."""
    want = {m["path"]: m for m in manifest}
    aside = f"{out}.{uuid.uuid4().hex}.tmp"
    try:
        with tarfile.open(path, "r:gz") as tar:
            members = tar.getmembers()
            if sorted(m.name for m in members) != sorted(want):
                raise ValueError("the bundle's members aren't those of its manifest")
            for m in members:
                target = Path(aside, m.name)
                if not m.isfile() or Path(aside).resolve() not in target.resolve().parents:
                    raise ValueError(f"{m.name} isn't a plain file inside the bundle")
                body = tar.extractfile(m).read()
                if len(body) != want[m.name]["bytes"] or hashlib.sha256(body).hexdigest() != want[m.name]["sha256"]:
                    raise ValueError(f"{m.name} was changed")
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(body)
        if os.path.exists(out):
            raise FileExistsError(out)
        os.rename(aside, out)
    finally:
        shutil.rmtree(aside, ignore_errors=True)


def folder_issues(root: str, expected: Iterable[str], removable: Iterable[str] = ()) -> tuple[list[str], list[str], list[str]]:
    """(missing, unexpected, removable) files of a local run folder against its contract."""
    actual = {str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file()}
    want, extra = set(expected), set(removable)
    return sorted(want - actual), sorted(actual - want - extra), sorted(actual & extra)


def prune_folder(root: str, expected: Iterable[str], removable: Iterable[str]) -> list[str]:
    """Delete the removable extras; anything unknown stops it before the first deletion."""
    _, unknown, extras = folder_issues(root, expected, removable)
    if unknown:
        raise ValueError(f"unknown files: {unknown}")
    for name in extras:
        Path(root, name).unlink()
    return extras


def prune(spark: SparkSession, root: str, expected: Iterable[str], removable: Iterable[str]) -> list[str]:
    """Delete the removable extras of a run's folder in any store; anything unknown or missing stops it before the first deletion."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    base = fs.makeQualified(base)
    found, listed = [], fs.listFiles(base, True)
    while listed.hasNext():
        found.append(base.toUri().relativize(listed.next().getPath().toUri()).getPath())
    want, extra, actual = set(expected), set(removable), {f for f in found if not f.rpartition("/")[2].startswith(".")}
    if unknown := sorted((actual ^ want) - extra):
        raise ValueError(f"missing or unknown files: {unknown}")
    gone = sorted(actual & extra)
    for name in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, name), False)
    return gone
