"""Loaders of record sets under closed contracts: personas, style examples, prompts; manifests, snapshots, configurations."""

from __future__ import annotations

import hashlib
import json
import shutil
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import Field, violations
from .records import file_facts, manifest_issues, read_lines

SECTION_NAMES = ("identity", "personality", "speech_style", "relationships", "facts", "boundaries")
PERSONA_FIELDS = (Field("name", "string"), *(Field(n, "array") for n in SECTION_NAMES), Field("notes", "array", required=False))
PERSONA_SCHEMA = "name string, " + ", ".join(f"{n} array<string>" for n in (*SECTION_NAMES, "notes"))
EXAMPLE_FIELDS = (Field("user", "string"), Field("assistant", "string"))
PROMPT_FIELDS = (Field("id", "string"), Field("scenario", "string"), Field("target_goals", "array", distinct=True), Field("user", "string"))
TARGETED_PROMPT_FIELDS = (*(Field(n, "string") for n in ("id", "target_issue", "scenario", "user", "preference_criteria")),)


class RecordError(ValueError):
    """A record set breaks its contract."""


def load_records(spark: SparkSession, paths: str | Sequence[str], alternatives: Sequence[tuple[Field, ...]], schema: str, unique: str | None = None, least: int = 1, most: int | None = None) -> DataFrame:
    """JSON lines of which each keeps one of the contracts, with a unique column and a number of rows within bounds; else RecordError, naming a line."""
    lines = read_lines(spark, paths)
    broken = [violations(F.col("raw"), fields) for fields in alternatives]
    fewest = F.array_min(F.transform(F.array(*broken), lambda v: F.struct(F.size(v).alias("n"), v.alias("v"))))
    bad = lines.withColumn("_v", fewest).where(F.col("_v.n") > 0).select("file", "raw", F.array_join("_v.v", ", ").alias("v")).limit(1).collect()
    if bad:
        raise RecordError(f"{bad[0]['file']}: {bad[0]['v']}: {bad[0]['raw'][:80]}")
    rows = lines.select(F.from_json("raw", schema).alias("r")).select("r.*")
    n = rows.count()
    if n < least or (most is not None and n > most):
        raise RecordError(f"{paths} has {n} rows, not {least} to {'any' if most is None else most}")
    if unique and rows.select(unique).distinct().count() != n:
        raise RecordError(f"{paths}: {unique} isn't unique")
    return rows


def load_prompts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Prompts in their full form, or with the user's text alone; users are unique."""
    return load_records(spark, paths, [PROMPT_FIELDS, (Field("user", "string"),)], "id string, scenario string, target_goals array<string>, user string", "user")


def load_examples(spark: SparkSession, path: str, least: int = 10, most: int = 20) -> DataFrame:
    return load_records(spark, path, [EXAMPLE_FIELDS], "user string, assistant string", "user", least, most)


def load_persona(spark: SparkSession, path: str) -> DataFrame:
    """The one persona of a JSON file: closed fields, texts that aren't blank, lists that may be empty."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"))
    listed = F.from_json("raw", PERSONA_SCHEMA)
    own = raw.select(violations(F.col("raw"), PERSONA_FIELDS).alias("v"), listed.alias("p"))
    blank = F.exists(F.flatten(F.array(*(F.coalesce(F.col(f"p.{n}"), F.array().cast("array<string>")) for n in (*SECTION_NAMES, "notes")))), lambda x: x.isNull() | (F.trim(x) == ""))
    row = own.select("p", F.concat("v", F.array_compact(F.array(F.when(blank, "blank text")))).alias("v")).first()
    if row is None or row["v"]:
        raise RecordError(f"{path}: {', '.join(row['v']) if row else 'empty'}")
    return own.select("p.*")


def load_manifested(spark: SparkSession, base: str, manifest: DataFrame, schema: str) -> DataFrame:
    """The rows of a manifest's files (path, bytes, sha256 and, where it is known, records), once all are as it says."""
    facts = file_facts(spark, base).withColumn("path", F.regexp_extract("path", r"([^/]+)\z", 1))
    wrong = manifest_issues(facts.join(manifest.select("path"), "path", "left_semi"), manifest.select("path", "bytes", "sha256")).limit(1).collect()
    if wrong:
        raise RecordError(f"{wrong[0]['path']}: {wrong[0]['issue']}")
    files = [r["path"] for r in manifest.select("path").collect()]  # as many as the manifest names
    lines = read_lines(spark, [f"{base}/{f}" for f in files]).withColumn("path", F.regexp_extract("file", r"([^/]+)\z", 1))
    if "records" in manifest.columns:
        counts = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        off = manifest.where("records is not null").join(counts, "path", "left").where("records <> coalesce(n, 0)").limit(1).collect()
        if off:
            raise RecordError(f"{off[0]['path']}: {off[0]['n']} rows, not {off[0]['records']}")
    return lines.select(F.from_json("raw", schema).alias("r"), "path").select("r.*", "path")


def load_others(spark: SparkSession, folder: str, excluded: Sequence[str], extra: Sequence[str] = (), pattern: str = "*.jsonl") -> DataFrame:
    """The lines of all files of a folder but the excluded names, and of some more paths."""
    lines = read_lines(spark, [f"{folder}/{pattern}", *extra])
    return lines.where(~F.regexp_extract("file", r"([^/]+)\z", 1).isin(*excluded)) if excluded else lines


def snapshot_inputs(paths: Sequence[str], out: str) -> list[dict[str, Any]]:
    """Byte-exact copies of local files in a new folder, and their manifest, which is written beside them."""
    target = Path(out)
    target.mkdir(parents=True)
    manifest = []
    for p in map(Path, paths):
        shutil.copyfile(p, target / p.name)
        body = (target / p.name).read_bytes()
        manifest.append({"path": p.name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()})
    (target / "manifest.json").write_text(json.dumps(manifest, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return manifest


def load_yaml(path: str) -> dict[str, Any]:
    """A configuration object of the driver; needs a YAML library."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("no YAML library is installed here") from e
    with open(path, encoding="utf-8") as f:
        value = yaml.safe_load(f)
    if not isinstance(value, dict):
        raise RecordError(f"{path} isn't an object")
    return value
