"""Record sources: JSON lines in their strict and lenient forms, single objects, hash-pinned files, manifests, logs, bundles."""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, paths: str | Sequence[str], missing: str = "error") -> DataFrame:
    """Non-blank lines of JSON-lines files: file, raw. ``missing``: 'error', or 'empty' for an empty result where the path isn't there."""
    if missing == "empty" and isinstance(paths, str) and not path_exists(spark, paths):
        return spark.createDataFrame([], "file string, raw string")
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).where(F.trim("raw") != "")


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType, missing: str = "error", strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema. Strict: a line that isn't an object fails the query, naming its file. Lenient: it is left out."""
    lines = read_lines(spark, paths, missing)
    variant = F.try_parse_json("raw")
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    if strict:
        fault = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(": "), F.substring("raw", 1, 80))).cast("string")
        lines = lines.withColumn("raw", F.when(is_object, F.col("raw")).otherwise(fault))
    else:
        lines = lines.where(is_object)
    return lines.select(F.from_json("raw", schema).alias("row"), "file").select("row.*", "file")


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one object of a JSON file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def file_facts(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, bytes, sha256) of every file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pinned(spark: SparkSession, path: str, sha256: str) -> str:
    """The path, once its content has the expected hash."""
    actual = file_facts(spark, path).select("sha256").first()
    if actual is None or actual[0] != sha256:
        raise ValueError(f"{path}: sha256 {actual[0] if actual else None} is not {sha256}")
    return path


def manifest_issues(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed against a manifest (path, bytes, sha256): rows (path, issue)."""
    a = facts.select("path", F.struct("bytes", "sha256").alias("_a"))
    b = manifest.select("path", F.struct("bytes", "sha256").alias("_b"))
    issue = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unexpected").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "path", "full").select("path", issue.alias("issue")).where("issue is not null")


def in_order(rows: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """The rows of the wanted keys in their order (column place); a key without a row, or with two, fails the query."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(wanted)], T.StructType([T.StructField("place", T.LongType()), T.StructField(key, rows.schema[key].dataType)]))
    met = asked.join(rows.withColumn("_there", F.lit(True)), key, "left")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    met = met.join(counts, key, "left")
    fault = F.raise_error(F.concat(F.lit("no single row for "), F.col(key).cast("string"))).cast("long")
    return met.withColumn("place", F.when(F.coalesce(F.col("_n"), F.lit(0)) == 1, F.col("place")).otherwise(fault)).drop("_there", "_n").orderBy("place")


def longest_series(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """The longest series of a numeric metric among log files of JSON lines; booleans and broken lines don't count. Rows (file, place, value)."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant(F.try_variant_get("v", f"$['{metric}']", "variant"))
    values = raw.where(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")).select("file", "place", F.try_variant_get("v", f"$['{metric}']", "double").alias("value"))
    best = values.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("file", F.struct(-F.col("n"), F.col("file"))).alias("file"))
    return values.join(F.broadcast(best), "file")


def progress_lines(lines: DataFrame, text: str, metrics: Sequence[str]) -> DataFrame:
    """Of log lines that name every metric: its number, a column each."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    found = {m: F.regexp_extract(text, rf"['\"]?{m}['\"]?\s*[:=]\s*['\"]?({number})", 1) for m in metrics}
    own = lines.withColumns(found)
    for m in metrics:
        own = own.where(F.col(m) != "")
    return own.withColumns({m: F.col(m).cast("double") for m in metrics})


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    schema = pa.schema([("bundle", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("issue", pa.string())])
    for batch in batches:
        for bundle, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            with tarfile.open(fileobj=io.BytesIO(raw.as_py()), mode="r:*") as tar:
                for m in tar:
                    parts = PurePosixPath(m.name)
                    issue = "not a file" if not m.isfile() else "leaves the bundle" if parts.is_absolute() or ".." in parts.parts else None
                    body = tar.extractfile(m).read() if m.isfile() else b""
                    rows.append({"bundle": bundle, "path": m.name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "issue": issue})
            yield pa.RecordBatch.from_pylist(rows, schema)


def bundle_members(spark: SparkSession, path: str) -> DataFrame:
    """The members of tar bundles: bundle, path, bytes, sha256, and an issue for what isn't a plain file inside."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_members, "bundle string, path string, bytes long, sha256 string, issue string")


def load_env(path: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """Key=value lines of a local file, for the driver's settings: comments are passed over, what is set stays."""
    env = dict(os.environ) if env is None else dict(env)
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if line and not line.startswith("#") and "=" in line:
                key, _, value = line.partition("=")
                env.setdefault(key.strip(), value.strip().strip("'\""))
    return env


def env_pairs(lines: DataFrame, text: str = "value") -> DataFrame:
    """Key=value lines of any store: rows (key, value); comments and lines without a key are passed over, quotes around a value fall away."""
    line = F.trim(F.col(text))
    pair = F.split(line, "=", 2)
    own = lines.where(~line.startswith("#") & line.contains("=")).select(F.trim(pair[0]).alias("key"), F.regexp_replace(F.trim(pair[1]), r"^['\x22]+|['\x22]+$", "").alias("value"))
    return own.where("key <> ''")
