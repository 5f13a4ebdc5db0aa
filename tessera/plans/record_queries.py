"""Queries of record sources and sinks, contracts, and rows on their way into training, each beside its DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pandas_text as P
from ..functions import text as T
from ..operators import contracts, evaluation, isolation, preparation, reports, reviews, rows
from ..sources import loaders, publication, records, sinks
from ..sources.scratch import materialise, scratch_dir
from ..streaming import logs
from . import bindings as B
from .bindings import drawn_sql as drawn
from .oracles import CONV, DOCS, PROMPTS, _gibberish, _open, _repeats, _strip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def _lines(df: DataFrame, raw: Column, path: str) -> str:
    """Write texts as lines of files."""
    df.select(raw.alias("value")).write.text(path)
    return path


# --- sources ----------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def q_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON lines, as they were written."""
    path = scratch_dir(spark, "jsonl")
    sinks.write_jsonl(B.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    return records.read_jsonl(spark, path, "doc_id long, lang string, source string, n_chars long").drop("file")


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id + turn) % 7 NOT IN (3, 5)")
def q_jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient JSON lines: arrays and broken lines are passed over."""
    c = B.table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 7
    raw = F.when(k == 3, F.lit("[1, 2]")).when(k == 5, F.lit('{"conv_id": ')).otherwise(F.to_json(F.struct("conv_id", "turn", "role", "text")))
    return records.read_jsonl(spark, _lines(c, raw, scratch_dir(spark, "lenient")), "conv_id long, turn long, role string", strict=False).drop("file")


@query("SELECT unnest(['there', 'empty', 'error']) AS mode, unnest([count(*), 0, 1])::BIGINT AS n, unnest([coalesce(sum(doc_id), 0), 0, 0])::BIGINT AS ids FROM documents")
def q_jsonl_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as JSON lines, and a path beside them that isn't there: no rows, or an error."""
    root = scratch_dir(spark, "not-there")
    sinks.write_jsonl(B.table(spark, sf_dir, "documents").select("doc_id", "text"), f"{root}/there")
    facts = lambda path, mode: records.read_jsonl(spark, path, "doc_id long, text string", missing="empty").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("ids")).select(F.lit(mode).alias("mode"), "n", "ids")
    failed = 0
    try:
        records.read_jsonl(spark, f"{root}/elsewhere", "doc_id long").count()
    except Exception:  # noqa: BLE001  the kind of error is the store's
        failed = 1
    return facts(f"{root}/there", "there").unionByName(facts(f"{root}/elsewhere", "empty")).unionByName(spark.createDataFrame([("error", failed, 0)], "mode string, n long, ids long"))


@query("SELECT 'regions' AS name, count(*) AS n, string_agg(r_name, ',' ORDER BY r_regionkey) AS listed FROM region")
def q_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object, written whole or not at all, and read with its schema."""
    names = [r["r_name"] for r in B.table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows
    path = scratch_dir(spark, "object") + ".json"
    sinks.put_json(spark, path, {"name": "old"})
    sinks.put_json(spark, path, {"name": "regions", "n": len(names), "listed": names})
    return records.read_object(spark, path, "name string, n long, listed array<string>").withColumn("listed", F.array_join("listed", ","))


@query("SELECT conv_id * 100 + turn || ' ' || text AS \"user\" FROM conversations WHERE role = 'user'")
def q_prompt_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts in both accepted forms; their users."""
    p = B.prompts(spark, sf_dir)
    user = F.concat(F.col("id").cast("string"), F.lit(" "), F.col("user")).alias("user")
    whole = F.struct(F.col("id").cast("string").alias("id"), F.col("scenario").cast("string").alias("scenario"), F.array(F.lit("a"), F.lit("b")).alias("target_goals"), user)
    raw = F.when(F.col("id") % 2 == 0, F.to_json(whole)).otherwise(F.to_json(F.struct(user)))
    return loaders.load_prompts(spark, _lines(p, raw, scratch_dir(spark, "prompts"))).select("user")


@query("SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n FROM nation WHERE n_regionkey NOT IN (2, 4) GROUP BY 1")
def q_glob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all files of a folder but the excluded ones."""
    root = scratch_dir(spark, "glob")
    nation = B.table(spark, sf_dir, "nation").select("n_regionkey", "n_name").collect()  # 25 rows
    for key in sorted({r["n_regionkey"] for r in nation}):
        lines = "".join(json.dumps({"n_regionkey": key, "n_name": r["n_name"]}) + "\n\n" for r in nation if r["n_regionkey"] == key)
        sinks.put_bytes(spark, f"{root}/r{key}.jsonl", lines.encode())
    lines = loaders.load_others(spark, root, ["r2.jsonl", "r4.jsonl"])
    return lines.select(F.from_json("raw", "n_regionkey long").alias("r")).groupBy(F.col("r.n_regionkey").alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT n_regionkey FROM s ORDER BY n DESC, n_regionkey LIMIT 1) SELECT count(*) AS n, round(sum(n_nationkey / 10.0)::DOUBLE, 6) AS total FROM nation JOIN b USING (n_regionkey)")
def q_longest_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest series of a metric among log files in folders; booleans and broken lines don't count."""
    root = scratch_dir(spark, "series")
    nation = B.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect()  # 25 rows
    for key in sorted({r["n_regionkey"] for r in nation}):
        body = [json.dumps({"reward": r["n_nationkey"] / 10}) for r in nation if r["n_regionkey"] == key] + [json.dumps({"reward": True}), "{broken", json.dumps({"other": 1})] * 4
        sinks.put_bytes(spark, f"{root}/run{key}/logging.jsonl", ("\n".join(body) + "\n").encode())
    return records.longest_series(spark, root, "reward").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _nation_files(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, bytes]]:
    root = scratch_dir(spark, "nations")
    nation = B.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows
    files = {f"r{key}.jsonl": "".join(f'{{"k":{r["n_nationkey"]},"name":"{r["n_name"]}"}}\n' for r in nation if r["n_regionkey"] == key).encode() for key in sorted({r["n_regionkey"] for r in nation})}
    for name, body in files.items():
        sinks.put_bytes(spark, f"{root}/{name}", body)
    return root, files


_FILES = "f AS (SELECT 'r' || n_regionkey || '.jsonl' AS path, string_agg('{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' || chr(10), '' ORDER BY n_nationkey) AS body FROM nation GROUP BY n_regionkey)"


@query(f"WITH {_FILES} SELECT path, octet_length(encode(body)) AS bytes, sha256(body) AS sha256 FROM f")
def q_file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and hashes of files."""
    root, _ = _nation_files(spark, sf_dir)
    return records.file_facts(spark, root).withColumn("path", F.regexp_extract("path", r"([^/]+)\z", 1))


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation WHERE n_regionkey = 1")
def q_pinned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is read once its hash is the expected one."""
    import hashlib

    root, files = _nation_files(spark, sf_dir)
    path = records.pinned(spark, f"{root}/r1.jsonl", hashlib.sha256(files["r1.jsonl"]).hexdigest())
    return records.read_jsonl(spark, path, "k long, name string").drop("file")


@query("SELECT 'r' || n_regionkey || '.jsonl' AS path, n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def q_manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a manifest, once sizes, hashes and numbers of rows are as it says."""
    root, files = _nation_files(spark, sf_dir)
    listed = [(m["path"], m["bytes"], m["sha256"], files[m["path"]].count(b"\n")) for m in sinks.manifest_of(files)]
    return loaders.load_manifested(spark, root, spark.createDataFrame(listed, "path string, bytes long, sha256 string, records long"), "k long, name string")


@query("SELECT 'r9.jsonl' AS path, 'missing' AS issue UNION ALL SELECT 'r3.jsonl', 'unexpected' UNION ALL SELECT 'r0.jsonl', 'changed'")
def q_manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder breaks of its manifest."""
    root, files = _nation_files(spark, sf_dir)
    facts = records.file_facts(spark, root).withColumn("path", F.regexp_extract("path", r"([^/]+)\z", 1))
    wanted = {n: b for n, b in files.items() if n != "r3.jsonl"} | {"r0.jsonl": b"other", "r9.jsonl": b""}
    return records.manifest_issues(facts, spark.createDataFrame([(m["path"], m["bytes"], m["sha256"]) for m in sinks.manifest_of(wanted)], "path string, bytes long, sha256 string"))


@query("SELECT row_number() OVER (ORDER BY n_name DESC) - 1 AS place, n_name, n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_regionkey = 3")
def q_lookup_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order in which they are asked for."""
    nation = B.table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_regionkey")
    names = sorted((r["n_name"] for r in nation.where("n_regionkey = 3").collect()), reverse=True)  # five rows
    return records.in_order(nation.drop("n_regionkey"), "n_name", names)


@query("SELECT event_id, round(value, 4) AS loss, (event_id % 7) / 2.0 AS grad_norm FROM events WHERE event_id % 3 <> 0")
def q_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of log lines that name every metric."""
    e = B.table(spark, sf_dir, "events").select("event_id", F.round("value", 4).alias("v"))
    body = F.concat(F.lit("{'loss': "), F.format_string("%.4f", "v"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(", 'grad_norm': "), ((F.col("event_id") % 7) / 2.0).cast("string"))).otherwise(F.lit("")), F.lit("}"))
    path = _lines(e, F.concat(F.col("event_id").cast("string"), F.lit("\t"), body), scratch_dir(spark, "log"))
    lines = spark.read.text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("event_id"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("line"))
    return records.progress_lines(lines, "line", ["loss", "grad_norm"]).drop("line")


@query(f"WITH {_FILES} SELECT 'run/' || path AS path, octet_length(encode(body)) AS bytes, sha256(body) AS sha256 FROM f")
def q_bundle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic bundle and what is in it."""
    _, files = _nation_files(spark, sf_dir)
    raw = sinks.bundle_bytes({f"run/{n}": b for n, b in files.items()})
    assert raw == sinks.bundle_bytes({f"run/{n}": files[n] for n in reversed(sorted(files))})
    path = scratch_dir(spark, "bundle") + ".tar.gz"
    sinks.put_bytes(spark, path, raw)
    return records.bundle_members(spark, path).where("issue is null").select("path", "bytes", "sha256")


@query("""WITH n AS (SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS l FROM nation GROUP BY 1) SELECT r_name AS name, l AS "identity", 0 AS facts FROM region JOIN n ON r = r_regionkey WHERE r_regionkey = 2""")
def q_persona_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persona under its closed contract."""
    name = B.table(spark, sf_dir, "region").where("r_regionkey = 2").first()["r_name"]
    names = sorted(r["n_name"] for r in B.table(spark, sf_dir, "nation").where("n_regionkey = 2").collect())  # a few rows
    path = scratch_dir(spark, "persona") + ".json"
    sinks.put_json(spark, path, {"name": name, **{s: [] for s in loaders.SECTION_NAMES}, "identity": names})
    return loaders.load_persona(spark, path).select("name", F.array_join("identity", "|").alias("identity"), F.size("facts").alias("facts"))


@query("""SELECT n_name AS "user", 'to ' || n_name AS assistant FROM nation WHERE n_nationkey < 15""")
def q_example_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style examples: 10 to 20, with unique users."""
    n = B.table(spark, sf_dir, "nation").where("n_nationkey < 15")
    return loaders.load_examples(spark, _lines(n, F.to_json(F.struct(F.col("n_name").alias("user"), F.concat(F.lit("to "), F.col("n_name")).alias("assistant"))), scratch_dir(spark, "examples")))


@query("SELECT conv_id, text AS \"user\" FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, min(text) FROM conversations GROUP BY conv_id")
def q_nested_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User texts at the top of a row and within its messages."""
    c = B.table(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.min("text").alias("top"), F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    out = m.withColumn("top", F.concat(F.col("conv_id").cast("string"), F.lit("\t"), F.col("top"))).withColumn("messages", F.transform("messages", lambda x: F.struct(x["role"].alias("role"), F.concat(F.col("conv_id").cast("string"), F.lit("\t"), x["content"]).alias("content"))))
    cut = F.instr("user", "\t")
    return isolation.nested_users(out, "top", "messages").select(F.substr("user", F.lit(1), cut - 1).cast("long").alias("conv_id"), F.substr("user", cut + 1).alias("user"))


# --- sinks ------------------------------------------------------------------------------------------


@query("""
  WITH d AS (SELECT coalesce(sum(doc_id), 0) AS s, count(*) AS n FROM documents), c AS (SELECT count(*) AS n FROM conversations), e AS (SELECT count(*) AS n FROM documents WHERE doc_id % 2 = 0)
  SELECT 'first' AS step, 1 AS version, d.n AS rows, c.n AS other, s AS ids FROM d, c UNION ALL SELECT 'again', 2, e.n, c.n, (SELECT coalesce(sum(doc_id), 0) FROM documents WHERE doc_id % 2 = 0) FROM e, c
  UNION ALL SELECT 'failed', 2, e.n, c.n, (SELECT coalesce(sum(doc_id), 0) FROM documents WHERE doc_id % 2 = 0) FROM e, c
""")
def q_publish_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are published together, replaced together, and left as they were by a failure of one of them."""
    root = scratch_dir(spark, "published")
    docs, turns = B.table(spark, sf_dir, "documents").select("doc_id", "text"), B.table(spark, sf_dir, "conversations")
    seen = []

    def look(step: str) -> None:
        version, _ = publication.current(spark, root)
        own, other = publication.read_published(spark, root, "documents", "conversations")
        facts = own.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("ids")).crossJoin(other.agg(F.count(F.lit(1)).alias("other")))  # one row each
        seen.append(facts.select(F.lit(step).alias("step"), F.lit(version).alias("version"), "rows", "other", "ids"))

    publication.publish_tables(spark, {"documents": docs, "conversations": turns}, root)
    look("first")
    publication.publish_tables(spark, {"documents": docs.where("doc_id % 2 = 0")}, root)
    look("again")
    try:
        publication.publish_tables(spark, {"documents": docs, "conversations": turns.withColumn("x", F.raise_error(F.lit("on purpose")))}, root)
    except Exception:  # noqa: BLE001  any failure is to leave the tables as they were
        look("failed")
    return reduce(DataFrame.unionByName, seen)


@query("SELECT count(*) AS rows, true AS refused FROM region")
def q_exclusive_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write that refuses to replace what is there."""
    region, path = B.table(spark, sf_dir, "region"), scratch_dir(spark, "exclusive")
    sinks.write_jsonl(region, path, refuse_overwrite=True)
    refused = False
    try:
        sinks.write_jsonl(region.limit(1), path, refuse_overwrite=True)
    except Exception:  # noqa: BLE001  the kind of error is Spark's
        refused = True
    return spark.read.json(path).agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def q_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream appended to JSON lines, each batch once."""
    root = scratch_dir(spark, "append-log")
    stream = logs.read_stream(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for _ in range(2):  # the second run finds nothing new
        logs.append_log(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    rows_ = spark.read.schema("event_id long, event_type string, value double").json(f"{root}/out")
    return rows_.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


# --- isolation and joins ----------------------------------------------------------------------------

_KEY = _strip("regexp_replace(text, '[\\t-\\r \\x1c-\\x1f]+', ' ', 'g')")


@query(f"WITH {DOCS}, k AS (SELECT doc_id, side, {_KEY} AS k FROM d) SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM k a JOIN k b ON a.k = b.k AND a.side = 0 AND b.side = 1")
def q_expansion_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of an expansion repeat which rows of a data set."""
    d = B.documents(spark, sf_dir)
    key = T.collapse(F.col("text"))
    return isolation.overlaps(d.where("side = 0"), d.where("side = 1"), key, key, "doc_id", "doc_id").drop("key")


@query("""WITH n AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS pos FROM conversations), u AS (SELECT * FROM n WHERE role = 'user'), a AS (SELECT * FROM n WHERE role = 'assistant')
  SELECT coalesce(u.pos, a.pos) AS pos, md5(u.text) AS asked, md5(a.text) AS answered, CASE WHEN u.pos IS NULL THEN 'missing_left' WHEN a.pos IS NULL THEN 'missing_right' END AS issue FROM u FULL JOIN a ON u.pos = a.pos""")
def q_zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows and responses by position."""
    c = B.table(spark, sf_dir, "conversations")
    side = lambda role, name: preparation.placed(c.where(F.col("role") == role), ["conv_id", "turn"]).select(F.col("place").cast("long").alias("pos"), F.md5("text").alias(name))
    return preparation.zip_rows(side("user", "asked"), side("assistant", "answered"), "pos")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def q_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a field of what they refer to."""
    facts = B.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return preparation.enriched(B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), facts, "o_custkey", ["c_mktsegment"]).drop("o_custkey")


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'missing_before' WHEN vec_id % 7 = 0 THEN 'missing_after' END AS issue, CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 <> 0 THEN len(list_filter(embedding, lambda x: x <> 0)) END AS changed FROM embeddings WHERE vec_id % 35 <> 0""")
def q_tensor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one of two tensor tables has, and changed elements of the others: the second table is twice the first."""
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = reports.array_deltas(e.where("vec_id % 5 <> 0"), e.where("vec_id % 7 <> 0").withColumn("v", F.transform("v", lambda x: x * 2)), "vec_id", "v")
    return out.select("vec_id", "issue", F.when(F.col("issue").isNull(), F.col("changed")).cast("long").alias("changed"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'lora.' || lower(n_name) || '.weight' WHEN n_nationkey % 3 = 1 THEN 'base.' || lower(n_name) || '.bias' END AS "key", n_nationkey % 3 <> 1 AS transposed FROM nation""")
def q_tensor_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensor names under other prefixes, and which are stored transposed."""
    k = F.col("n_nationkey")
    old = F.concat(F.element_at(F.array(F.lit("model.adapter."), F.lit("model."), F.lit("else.")), (k % 3 + 1).cast("int")), F.lower("n_name"), F.when(k % 3 == 1, ".bias").otherwise(".weight"))
    r = preparation.rekeyed(old, {"model.adapter.": "lora.", "model.": "base."}, (".weight",))
    return B.table(spark, sf_dir, "nation").select("n_nationkey", r["key"].alias("key"), r["transposed"].alias("transposed"))


# --- aggregates, sets and limits --------------------------------------------------------------------


@query(f"SELECT doc_id % 4 AS side, round(avg({drawn('reward', 'doc_id', 1000)} / 100.0), 6) AS mean_total, count(*) FILTER (WHERE {drawn('hard', 'doc_id', 6)} = 0) AS hard_invalid, sum({drawn('wrong', 'doc_id', 4)})::BIGINT AS wrong_self FROM labels GROUP BY 1")
def q_reward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward, hard-invalid rows and occurrences of wrong names for oneself."""
    k = F.col("doc_id")
    reward = F.struct((B.drawn("reward", k, 1000) / 100.0).alias("total_reward"), F.when(B.drawn("hard", k, 6) == 0, F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>")).alias("hard_invalid_reasons"), B.drawn("wrong", k, 4).alias("wrong_self_count"))
    return evaluation.reward_summary(B.table(spark, sf_dir, "labels").select((k % 4).alias("side"), reward.alias("reward")), "reward", "side")


@query("WITH h AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), w AS (SELECT * FROM (VALUES ('en', 10::BIGINT), ('de', 20::BIGINT), ('xx', 3::BIGINT)) AS v(lang, want)) SELECT lang, coalesce(n, 0) AS have, coalesce(want, 0) AS want FROM h FULL JOIN w USING (lang) WHERE coalesce(n, 0) <> coalesce(want, 0)")
def q_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories whose number of rows isn't the wanted one."""
    return preparation.distribution_issues(B.table(spark, sf_dir, "documents"), "lang", {"en": 10, "de": 20, "xx": 3})


@query(f"SELECT sha256({_KEY}) AS \"key\", count(*) AS n FROM documents GROUP BY {_KEY} HAVING count(*) > 1")
def q_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that stand more than once."""
    return preparation.uniqueness_issues(B.table(spark, sf_dir, "documents"), T.collapse(F.col("text")))


@query("""WITH b AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 2 = 0)
  SELECT 'count' AS issue, (SELECT n FROM b)::VARCHAR AS detail WHERE (SELECT n FROM b) <> 10
  UNION ALL SELECT 'id', ident FROM (SELECT printf('x_%04d', c_custkey // 2) AS ident, row_number() OVER (ORDER BY printf('x_%04d', c_custkey // 2)) AS n FROM customer WHERE c_custkey % 2 = 0) WHERE ident <> printf('x_%04d', n)
  UNION ALL SELECT 'repeated_user', min(printf('x_%04d', c_custkey // 2)) FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_nationkey HAVING count(*) > 1
  UNION ALL SELECT 'distribution', coalesce(c, w) FROM (SELECT c_mktsegment AS c, count(*) AS h FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) FULL JOIN (SELECT 'BUILDING' AS w, 2 AS want) ON c = w WHERE coalesce(h, 0) IS DISTINCT FROM want""")
def q_split_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished split breaks: number of rows, ids, unique users, distribution."""
    from . import workflows

    c = B.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    split = c.select(F.format_string("x_%04d", F.floor(F.col("c_custkey") / 2)).alias("ident"), F.col("c_nationkey").cast("string").alias("user"), F.col("c_mktsegment").alias("category"))
    return workflows.split_issues(split, "ident", "user", "category", "x_", 10, {"BUILDING": 2})


@query("WITH n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS pos FROM conversations WHERE role = 'user'), b AS (SELECT pos FROM n WHERE pos % 11 = 3) SELECT pos, CASE WHEN pos % 22 = 3 THEN 'missing' ELSE 'changed' END AS issue FROM b")
def q_resume_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished rows that aren't the plan's at their positions."""
    plan = preparation.placed(B.table(spark, sf_dir, "conversations").where("role = 'user'"), ["conv_id", "turn"]).select(F.col("place").cast("long").alias("pos"), "text")
    done = plan.where("pos % 22 <> 3").withColumn("text", F.when(F.col("pos") % 11 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return preparation.suffix_issues(done, plan, plan.limit(0), "pos", ["text"])


@query("WITH c AS (SELECT scenario, row_number() OVER (ORDER BY scenario) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id % 5 AS scenario FROM conversations)) SELECT scenario, (23 // n + CASE WHEN i <= 23 % n THEN 1 ELSE 0 END)::BIGINT AS quota FROM c")
def q_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even share of a total to each category, the remainder to the first."""
    return preparation.quotas(B.prompts(spark, sf_dir).select("scenario").distinct(), "scenario", 23)


@query("SELECT l_returnflag, sum(l_linenumber)::BIGINT AS wanted FROM lineitem GROUP BY 1")
def q_pool_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pool must hold of each category to serve every split."""
    return preparation.pool_quota(B.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber")


_OK = "n_chars % 3 = 0 AND lang = 'en'"


@query(f"WITH t AS (SELECT doc_id FROM documents WHERE {_OK} ORDER BY doc_id LIMIT 25), e AS (SELECT max(doc_id) AS m, count(*) AS n FROM t) SELECT count(*) FILTER (WHERE {_OK}) AS accepted, count(*) FILTER (WHERE NOT coalesce({_OK}, false)) AS refused FROM documents, e WHERE n < 25 OR doc_id <= m")
def q_limit_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass in order has seen when it stops at 25 accepted rows."""
    return preparation.first_accepted(B.table(spark, sf_dir, "documents"), F.expr(_OK), "doc_id", 25)[1]


@query("SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS place FROM documents")
def q_audit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows in a stable order, numbered."""
    return preparation.placed(B.table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", F.col("place").cast("long").alias("place"))


@query("WITH n AS (SELECT count(*) AS n FROM nation) SELECT 25 + r_regionkey + 1 AS pos, 'changed' AS issue FROM region WHERE r_regionkey % 2 = 1 UNION ALL SELECT n + 6, 'unexpected' FROM n")
def q_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that should be another one and then additions: what differs, and what is too much."""
    base = B.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("pos"), F.col("n_name").alias("name"))
    extra = B.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("pos"), F.col("r_name").alias("name"))
    changed = extra.withColumn("name", F.when(F.col("pos") % 2 == 0, F.lower("name")).otherwise(F.col("name"))).unionByName(spark.range(1).select(F.lit(6).cast("long").alias("pos"), F.lit("more").alias("name")))
    return preparation.suffix_issues(preparation.appended(base, changed, "pos"), base, extra, "pos", ["name"])


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'chars,digest' WHEN doc_id % 3 = 0 THEN 'chars' ELSE 'digest' END AS changed FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def q_frozen_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose derived fields aren't what they are computed from now."""
    t, k = F.col("text"), F.col("doc_id")
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text", (F.length(t) + F.when(k % 3 == 0, 1).otherwise(0)).alias("chars"), F.when(k % 2 == 0, F.md5(F.concat(t, F.lit("!")))).otherwise(F.md5(t)).alias("digest"))
    return reviews.frozen_issues(d, {"chars": F.length(t), "digest": F.md5(t)}).select("doc_id", F.array_join("changed", ",").alias("changed"))


@query(f"""WITH x AS (SELECT doc_id, {drawn('d', 'doc_id', 3)} AS d, {drawn('t', 'doc_id', 4)} AS t, {drawn('q', 'doc_id', 4)} AS q, {drawn('e', 'doc_id', 3)} AS e FROM labels)
  SELECT CASE WHEN d = 2 THEN 'decision' WHEN d = 1 AND e = 0 THEN 'exclusion_without_evidence' WHEN d = 1 AND q <> 0 THEN 'exclusion_with_quality' WHEN d = 0 AND (t = 0 OR q = 0) THEN 'inclusion_incomplete' ELSE 'ok' END AS issue, count(*) AS n FROM x GROUP BY 1""")
def q_review_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose fields don't suit their decision."""
    k = F.col("doc_id")
    decision = F.element_at(F.array(F.lit("include"), F.lit("exclude"), F.lit("maybe")), (B.drawn("d", k, 3) + 1).cast("int"))
    issue = preparation.review_semantics(decision, F.when(B.drawn("t", k, 4) != 0, "target"), F.when(B.drawn("q", k, 4) != 0, B.drawn("q", k, 4)), F.when(B.drawn("e", k, 3) != 0, "why").otherwise(" "))
    return B.table(spark, sf_dir, "labels").groupBy(F.coalesce(issue, F.lit("ok")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, concat_ws(',', CASE WHEN user_id % 3 = 0 THEN 'epochs' END, CASE WHEN user_id % 4 <> 1 THEN 'lr' END) AS issues FROM (SELECT DISTINCT user_id FROM events)")
def q_config_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a run that aren't the expected ones."""
    u = F.col("user_id")
    actual = F.map_filter(F.create_map(F.lit("lr"), F.when(u % 4 == 1, "0.1").otherwise("0.2"), F.lit("epochs"), F.when(u % 3 != 0, "3"), F.lit("more"), F.lit("x")), lambda _, v: v.isNotNull())
    return B.table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.array_join(preparation.setting_issues(actual, {"lr": "0.1", "epochs": "3"}), ",").alias("issues"))


# --- text helpers -----------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_nationkey % 4 = 0 AS styled FROM nation")
def q_style_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of an action in brackets and dialogue."""
    forms = F.array(F.concat(F.lit("(nods) "), "n_name"), F.concat("n_name", F.lit(" (nods)")), F.concat(F.lit("(nods)\n"), "n_name"), F.concat(F.lit("() "), "n_name"))
    return B.table(spark, sf_dir, "nation").select("n_nationkey", T.is_style_format(F.element_at(forms, (F.col("n_nationkey") % 4 + 1).cast("int"))).alias("styled"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'Ann' || conv_id % 9 END AS name FROM conversations")
def q_named_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name before a colon at the front of a text."""
    name = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Ann"), (F.col("conv_id") % 9).cast("string"), F.lit(": "))).otherwise(F.lit("A name that is too long to be one: "))
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.named_user(F.concat(name, "text")).alias("name"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1")
def q_self_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct quoted names that rules give for calling oneself."""
    rule = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("自称“"), "n_name", F.lit("”。自称“ "), "n_name", F.lit("”"))).otherwise(F.concat(F.lit("不是“"), "n_name", F.lit("”")))
    listed = B.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", rule.alias("rule")))).alias("rules"))
    return listed.select("n_regionkey", F.array_join(T.self_references(F.transform("rules", lambda r: r["rule"])), ",").alias("names"))


@query("SELECT doc_id, md5(replace(text, 'the', '[REDACTED]')) AS digest FROM documents")
def q_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a secret."""
    return B.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact(F.col("text"), "the")).alias("digest"))


@query("SELECT p_partkey, (p_partkey % 5) || '.' || (p_partkey % 7) AS version FROM part")
def q_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions without what follows a plus."""
    k = F.col("p_partkey")
    raw = F.concat((k % 5).cast("string"), F.lit("."), (k % 7).cast("string"), F.when(k % 2 == 0, "+cu12").otherwise(""))
    return B.table(spark, sf_dir, "part").select("p_partkey", T.plain_version(raw).alias("version"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id * 37 % 400000 END AS s FROM events)
  SELECT event_id, CASE WHEN s IS NULL THEN '--:--' WHEN s >= 3600 THEN CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || s // 3600 || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS shown FROM s""")
def q_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as a progress report shows them."""
    k = F.col("event_id")
    return B.table(spark, sf_dir, "events").select("event_id", T.duration(F.when(k % 10 != 0, (k * 37 % 400000).cast("double"))).alias("shown"))


@query(f"WITH {DOCS}, t AS (SELECT doc_id, text AS s, text, finish_reason FROM d), {_repeats('doc_id', 't', 's')} SELECT doc_id, {_strip('text')} <> '' AND finish_reason = 'stop' AND NOT {_gibberish('text')} AND NOT repeated AND NOT {_open('text')} AS stable FROM t JOIN rp USING (doc_id)")
def q_stable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are whole, readable and ended by themselves."""
    t = F.col("text")
    return B.documents(spark, sf_dir).select("doc_id", evaluation.stable(t, F.col("finish_reason"), P.has_repeated_span(t)).alias("stable"))


# --- contracts of answers ---------------------------------------------------------------------------


@query(f"""WITH x AS (SELECT doc_id, {drawn('bad', 'doc_id', 6)} AS b FROM labels) SELECT doc_id, CASE b WHEN 0 THEN 'invalid:scores' WHEN 1 THEN 'invalid:decision' WHEN 2 THEN 'keep_but_changed' WHEN 3 THEN 'edit_but_unchanged' WHEN 4 THEN 'invalid:final_checks' ELSE '' END AS issues FROM x""")
def q_audit_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a teacher's audits break."""
    k = F.col("doc_id")
    b = B.drawn("bad", k, 6)
    scores = F.when(b == 0, F.lit('{"stability":11,"role":3}')).otherwise('{"stability":9,"role":3}')
    decision = F.when(b == 1, "drop").when(b == 3, "rewrite").otherwise("keep")
    improved = F.when(b.isin(1, 2), "changed").otherwise("base")
    checks = F.when(b == 4, '{"safe":1}').otherwise('{"safe":true}')
    raw = F.concat(F.lit('```json\n{"scores":'), scores, F.lit(',"issues":[],"decision":"'), decision, F.lit('","improved_assistant":"'), improved, F.lit('","final_checks":'), checks, F.lit("}\n```"))
    issues = reviews.audit_issues(raw, F.lit("base"), ("stability", "role"), ("safe",))
    return B.table(spark, sf_dir, "labels").select("doc_id", F.array_join(issues, ",").alias("issues"))


@query(f"SELECT doc_id, CASE {drawn('bad', 'doc_id', 4)} WHEN 0 THEN 'tiers_missing' WHEN 1 THEN 'empty_tier' WHEN 2 THEN 'labels_incomplete' ELSE 'ok' END AS issue FROM labels")
def q_ranking_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What group rankings break: tiers part the labels."""
    b = B.drawn("bad", F.col("doc_id"), 4)
    raw = F.when(b == 0, '{"tiers":[]}').when(b == 1, '{"tiers":[["A","B"],[],["C","D"]]}').when(b == 2, '{"tiers":[["A","B"],["B","D"]]}').otherwise('{"tiers":[["C"],["A","B"],["D"]]}')
    return B.table(spark, sf_dir, "labels").select("doc_id", F.coalesce(contracts.ranking_issue(raw, ("A", "B", "C", "D")), F.lit("ok")).alias("issue"))


@query(f"SELECT doc_id, CASE {drawn('bad', 'doc_id', 4)} WHEN 0 THEN 'dimensions' WHEN 1 THEN 'score' WHEN 2 THEN 'score' ELSE 'ok' END AS issue FROM labels")
def q_score_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score objects that aren't whole numbers of 0 to 10 in each dimension."""
    b = B.drawn("bad", F.col("doc_id"), 4)
    raw = F.when(b == 0, '{"s":{"x":1}}').when(b == 1, '{"s":{"x":1,"y":11}}').when(b == 2, '{"s":{"x":true,"y":1}}').otherwise('{"s":{"y":10,"x":0}}')
    return B.table(spark, sf_dir, "labels").select("doc_id", F.coalesce(reviews.score_map_issue(raw, "$.s", ("x", "y")), F.lit("ok")).alias("issue"))


@query(f"SELECT doc_id, CASE {drawn('bad', 'doc_id', 5)} WHEN 0 THEN 'invalid:target_status' WHEN 1 THEN 'missing:evidence' WHEN 2 THEN 'unexpected:more' WHEN 3 THEN 'target_off_target' ELSE '' END AS issues FROM labels")
def q_candidate_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviews of candidates break."""
    b = B.drawn("bad", F.col("doc_id"), 5)
    status = F.when(b == 0, "good").otherwise("pass")
    off = F.when(b == 3, '["voice","tone"]').otherwise('["tone"]')
    raw = F.concat(F.lit('{"target_status":"'), status, F.lit('","non_target_quality":7,"off_target_issues":'), off, F.when(b != 1, ',"evidence":"why"').otherwise(""), F.when(b == 2, ',"more":1').otherwise(""), F.lit("}"))
    return B.table(spark, sf_dir, "labels").select("doc_id", F.array_join(reviews.candidate_review_issues(raw, F.lit("voice")), ",").alias("issues"))


@query("""SELECT conv_id, turn, md5('{"user":"' || conv_id || ' \\"x\\"","candidate":"' || role || '"}') AS digest FROM conversations""")
def q_untrusted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untrusted texts as JSON."""
    c = B.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(rows.judge_request(F.concat(F.col("conv_id").cast("string"), F.lit(' "x"')), F.col("role"))).alias("digest"))


@query(f"WITH {PROMPTS} SELECT id, 1::BIGINT AS n FROM p")
def q_prompt_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of generators' answers, as a list or an object; blank ones don't count."""
    p = B.prompts(spark, sf_dir)
    user = F.concat(F.lit("u"), F.col("id").cast("string"))
    raw = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.array(F.struct(user.alias("user")), F.struct(F.lit(" ").alias("user"))).alias("prompts")))).otherwise(F.to_json(F.array(user)))
    return p.select("id", F.size(contracts.prompt_list(raw)).cast("long").alias("n"))


# --- row construction -------------------------------------------------------------------------------


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'first' WHEN 'de' THEN 'second' END AS goal, CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 5 END::BIGINT AS share FROM documents")
def q_scenario_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the constants of their category."""
    return rows.with_constants(B.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": {"goal": "first", "share": 3}, "de": {"goal": "second", "share": 5}}).drop("lang")


@query("WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE n_chars % 2 = 0) SELECT d.doc_id, CASE WHEN a.n IS NOT NULL THEN printf('r%02d', a.n) END AS review_id FROM documents d LEFT JOIN a USING (doc_id)")
def q_review_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by the place among the accepted rows."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return rows.review_ids(d, "r", F.col("n_chars") % 2 == 0, "doc_id", "lang").select("doc_id", "review_id")


@query("SELECT n_nationkey AS dpo_key, n_name AS dpo_name, n_regionkey AS other FROM nation")
def q_renamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of one stage under another's prefix; other columns stay."""
    n = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sft_key"), F.col("n_name").alias("sft_name"), F.col("n_regionkey").alias("other"))
    return rows.renamed_metrics(n, "sft_", "dpo_")


@query("""SELECT pair, md5(a.text) AS sft_answer, md5(b.text) AS grpo_answer FROM (SELECT doc_id // 2 AS pair, text FROM documents WHERE doc_id % 2 = 0) a JOIN (SELECT doc_id // 2 AS pair, text FROM documents WHERE doc_id % 2 = 1) b USING (pair)""")
def q_renamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer key's columns under the names of later stages."""
    d = B.documents(spark, sf_dir)
    side = lambda n, name: d.where(F.col("side") == n).select("pair", F.md5("text").alias(name))
    key = side(0, "base_answer").join(side(1, "sft_answer"), "pair")
    return rows.renamed_metrics(rows.renamed_metrics(key, "sft_", "grpo_"), "base_", "sft_")


@query("""SELECT string_agg('user: ' || n_name || chr(10) || 'assistant: ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS examples FROM nation""")
def q_example_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples as lines of a prompt."""
    n = B.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("user"), F.col("n_regionkey").cast("string").alias("assistant"))
    return rows.render_examples(n, "n_nationkey")


@query("""WITH e AS (SELECT n_regionkey AS r, string_agg('user:' || n_name || '|assistant:' || n_nationkey, '|' ORDER BY n_nationkey) AS l FROM nation GROUP BY 1) SELECT r_regionkey, 'system:s|' || l || '|user:' || r_name AS fewshot, 'user:' || r_name AS bare FROM region JOIN e ON r = r_regionkey""")
def q_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a system prompt and examples, and without."""
    e = B.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("user"), F.col("n_nationkey").cast("string").alias("assistant")))).alias("examples"))
    flat = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    r = B.table(spark, sf_dir, "region").join(e, "r_regionkey")
    return r.select("r_regionkey", flat(rows.few_shot(F.lit("s"), F.col("examples"), F.col("r_name"))).alias("fewshot"), flat(rows.few_shot(None, None, F.col("r_name"))).alias("bare"))


@query("""SELECT n_nationkey, '## ' || n_name || chr(10) || chr(10) || '**region**: ' || n_regionkey || chr(10) || chr(10) || '**note**: ' AS page FROM nation""")
def q_review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section of a review document."""
    return B.table(spark, sf_dir, "nation").select("n_nationkey", rows.review_page(F.col("n_name"), [("region", F.col("n_regionkey")), ("note", F.lit(None))]).alias("page"))


@query("""SELECT '{"review_id":"' || n_name || '","winner":null,"clearly_worse":null,"scores":{"A":{"x":null},"B":{"x":null}}}' AS template FROM nation""")
def q_result_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank results to be filled in."""
    return B.table(spark, sf_dir, "nation").select(F.to_json(rows.result_template(F.col("n_name"), ("A", "B"), ("x",)), {"ignoreNullFields": "false"}).alias("template"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 1 AND 500 THEN 7000 + o_orderkey - 1 END AS seed FROM orders")
def q_batch_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of batches, within their range."""
    return B.table(spark, sf_dir, "orders").select("o_orderkey", preparation.batch_seed(7000, F.col("o_orderkey"), 500).cast("long").alias("seed"))


@query("""SELECT doc_id, '{"reward":{"quality":' || quality || ',"codes":' || CASE WHEN toxic = 1 THEN '["a","b"]' ELSE '[]' END || ',"note":null},"total":' || quality + toxic || ',"n_codes":' || toxic * 2 || '}' AS line FROM labels""")
def q_log_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards and their totals as lines of a log."""
    codes = F.when(F.col("toxic") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    reward = F.struct("quality", codes.alias("codes"), F.lit(None).cast("string").alias("note"))
    return B.table(spark, sf_dir, "labels").select("doc_id", preparation.log_record(reward, {"total": F.col("quality") + F.col("toxic"), "n_codes": F.size(codes)}).alias("line"))


_TASK = "'Judge the answer.' || chr(10) || chr(10) || 'Data:' || chr(10) || '{\"user\":\"' || role || '\",\"answer\":\"' || turn || '\"}' || chr(10) || chr(10) || 'Answer with a JSON object: x (0 to 2), violations, reason.'"
_RANK = "'Rank the answers in tiers, the best first.' || chr(10) || chr(10) || 'Data:' || chr(10) || '{\"user\":\"' || role || '\",\"A\":\"' || turn || '\",\"B\":null}' || chr(10) || chr(10) || 'Answer with a JSON object: tiers, a list of lists that holds each of A, B once.'"


@query(f"SELECT conv_id, turn, {_TASK} AS judge, {_RANK} AS ranking FROM conversations")
def q_prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a judge and to a group judge."""
    c = B.table(spark, sf_dir, "conversations")
    answer = F.col("turn").cast("string")
    return c.select("conv_id", "turn", preparation.judge_prompt(F.col("role"), answer, {"x": 2}).alias("judge"), preparation.group_judge_prompt(F.col("role"), (answer, F.lit(None).cast("string")), ("A", "B")).alias("ranking"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN lang END, 'none') AS lang, coalesce(CASE WHEN doc_id % 4 <> 0 THEN n_chars END, 7) AS n FROM documents")
def q_batch_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults where a batch gives none."""
    k = F.col("doc_id")
    return B.table(spark, sf_dir, "documents").select("doc_id", preparation.with_default(F.when(k % 3 != 0, F.col("lang")), "none").alias("lang"), preparation.with_default(F.when(k % 4 != 0, F.col("n_chars")), 7).alias("n"))


@query("SELECT 'v1-' || n_name AS release FROM nation")
def q_release_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of releases."""
    return B.table(spark, sf_dir, "nation").select(preparation.release_name(F.lit("v1"), F.col("n_name")).alias("release"))


@query("SELECT n_nationkey, n_name AS title, 'role_break,unreadable' AS codes FROM nation")
def q_packet_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet documents with the codes a reviewer may give."""
    d = preparation.with_vocabulary(F.struct(F.col("n_name").alias("title")), ("role_break", "unreadable"))
    return B.table(spark, sf_dir, "nation").select("n_nationkey", d.alias("d")).select("n_nationkey", "d.title", F.array_join("d.severe_codes", ",").alias("codes"))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (n_chars > 1000) AS long FROM documents) SELECT 'manifest' AS name, sha256('{"filters":["exact","near"],"near_duplicates":{"ratio":0.88},"quotas":{"dev":' || long || ',"train":' || n || '},"seed":7}') AS digest FROM n
  UNION ALL SELECT 'reward', sha256('{"codes":["a"],"constants":{"base":-' || n || '.0},"score":"(1 - v) / (1 + v)","weights":{"style":1.0}}') FROM n""")
def q_record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, as canonical JSON, of a run's manifest that asks for as many rows as there are documents and long ones, and of a reward's definition with their number."""
    n = B.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long")).first()  # one row
    docs = {"manifest": preparation.run_manifest({"train": n["n"], "dev": n["long"]}, {"ratio": 0.88}, ["exact", "near"], 7), "reward": preparation.reward_spec({"style": 1.0}, {"base": -float(n["n"])}, ["a"])}
    raw = spark.createDataFrame([(k, preparation.canonical_json(d)) for k, d in docs.items()], "name string, raw string")
    return raw.select("name", F.sha2("raw", 256).alias("digest"))


@query("""SELECT lang, sha256('{"count":' || count(*) || ',"lang":"' || lang || '","longest":' || max(n_chars) || '}') AS digest FROM documents GROUP BY lang""")
def q_report_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of reports, as canonical JSON."""
    g = B.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.max("n_chars").alias("longest"))
    return g.select("lang", F.sha2(F.to_json(F.struct("count", "lang", "longest")), 256).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, round((l_linenumber * 2 + 0.5)::DOUBLE / l_linenumber * (9 - l_linenumber), 6) AS eta FROM lineitem""")
def q_progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that remain at the pace so far."""
    n = F.col("l_linenumber")
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(reports.eta(n, F.lit(9), (n * 2 + 0.5).cast("double")), 6).alias("eta"))


# --- rows for training ------------------------------------------------------------------------------


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\t-\\r \\x1c-\\x1f]+'), lambda w: w <> '')) AS n FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[\\t-\\r \\x1c-\\x1f]+'), lambda w: w <> '')) > 400")
def q_length_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose texts are longer than a cap, in words."""
    return preparation.word_cap_issues(B.table(spark, sf_dir, "documents"), "doc_id", ["text"], 400)


@query()
def q_pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, by a chat template and a tokenizer file, of pairs whose answers are a whole document and its text in upper case, and which are over a cap."""
    import public_tokenizers

    d = B.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    made = d.select("doc_id", F.array(rows.message("system", F.col("lang")), rows.message("user", F.col("source")), rows.message("assistant", F.col("text"))).alias("messages"), F.upper("text").alias("rejected"))
    return preparation.pair_lengths(made, "doc_id", "messages", "rejected", 1024, preparation.tokenizer_count(public_tokenizers.path("byte_bpe_50k.json")))


@query("SELECT conv_id * 100 + turn AS id, md5('system:s|user:' || conv_id || '-' || turn) AS digest FROM conversations WHERE role = 'user'")
def q_reward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of reward training from prompts that keep their contract."""
    p = B.table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat_ws("-", "conv_id", "turn").alias("user"))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return preparation.reward_rows(p, "id", "user", "s").select("id", F.md5(flat).alias("digest"))


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE lang || doc_id % 50 END AS u, CASE WHEN doc_id % 10 = 0 THEN 'length' ELSE 'stop' END AS fin, CASE WHEN doc_id % 7 = 0 THEN 'an idiot and the end' WHEN doc_id % 5 = 0 THEN 'none' ELSE 'the answer' END AS a FROM documents),
  y AS (SELECT *, CASE WHEN u = '' OR u IS NULL THEN 'blank_user' WHEN fin <> 'stop' THEN 'answer' WHEN NOT contains(a, 'the') THEN 'no_signature' WHEN regexp_matches(a, 'idiot|scum') THEN 'wrong_alias' END AS i FROM x), f AS (SELECT u, min(doc_id) AS m FROM y WHERE i IS NULL GROUP BY u)
  SELECT coalesce(i, CASE WHEN doc_id <> m THEN 'repeated_user' END, 'ok') AS issue, count(*) AS n FROM y LEFT JOIN f USING (u) GROUP BY 1""")
def q_targeted_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions that pass their gate, and why the others don't."""
    k = F.col("doc_id")
    d = B.documents(spark, sf_dir).select("doc_id", F.when(k % 13 == 0, "").otherwise(F.concat("lang", (k % 50).cast("string"))).alias("user"), "finish_reason", F.when(k % 7 == 0, "an idiot and the end").when(k % 5 == 0, "none").otherwise("the answer").alias("assistant"))
    return preparation.targeted_additions(d, "doc_id", "user", "assistant", "finish_reason", "s").groupBy(F.coalesce("issue", F.lit("ok")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id AS pos, CASE WHEN doc_id % 9 = 0 THEN 'missing_right' WHEN doc_id % 4 = 0 THEN 'baseline_changed' WHEN doc_id % 5 = 0 THEN 'empty_answer' END AS issue, CASE WHEN doc_id % 9 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'keep' ELSE 'edit' END AS decision FROM documents""")
def q_teacher_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New answers of a teacher over frozen baselines."""
    k, t = F.col("doc_id"), F.col("text")
    d = B.table(spark, sf_dir, "documents").where("text is not null")
    frozen = d.select(k.alias("pos"), F.when(k % 4 == 0, F.lit("other")).otherwise(F.sha2(t, 256)).alias("sha"), t.alias("baseline"))
    answers = d.where("doc_id % 9 <> 0").select(k.alias("pos"), F.when(k % 5 == 0, " ").when(k % 2 == 0, t).otherwise(F.concat(t, F.lit("."))).alias("improved"))
    return preparation.teacher_rerun(frozen, answers, "pos", "sha", "baseline", "improved")


_STABLE = f"{_strip('text')} <> '' AND finish_reason = 'stop' AND NOT {_gibberish('text')} AND NOT repeated AND NOT {_open('text')}"


@query(f"""WITH {CONV}, t AS (SELECT *, conv_id * 100 + turn AS ident, text AS s FROM c), {_repeats('ident', 't', 's')}, g AS (SELECT t.* FROM t JOIN rp USING (ident) WHERE {_STABLE})
  SELECT conv_id, turn, chr((64 + row_number() OVER (PARTITION BY conv_id ORDER BY md5('5:' || ident), ident))::INT) AS label FROM g UNION ALL SELECT DISTINCT conv_id, -1, 'none' FROM t WHERE conv_id NOT IN (SELECT conv_id FROM g)""")
def q_editability_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable candidates under blind labels, and prompts without one."""
    c = B.conversations(spark, sf_dir).withColumn("ident", F.col("conv_id") * 100 + F.col("turn"))
    packet, lost = preparation.editability_packet(c, "conv_id", "ident", "text", "finish_reason", 5)
    return packet.select("conv_id", (F.col("ident") % 100).alias("turn"), "label").unionByName(lost.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("none").alias("label")))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'not_reviewed' WHEN doc_id % 6 = 0 THEN 'changed' WHEN {drawn('sim', 'doc_id', 101)} / 100.0 < 0.65 THEN 'too_different' WHEN NOT {drawn('len', 'doc_id', 200)} / 100.0 BETWEEN 0.8 AND 1.2 THEN 'length_changed' END AS issue FROM labels
  UNION ALL SELECT -1, 'unknown_review'""")
def q_editability_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed edits as preference rows, or why not."""
    k = F.col("doc_id")
    edits = B.table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("u"), k.cast("string")).alias("user"), F.concat(F.lit("s"), k.cast("string")).alias("source"), F.concat(F.lit("i"), k.cast("string")).alias("improved"), (B.drawn("sim", k, 101) / 100.0).alias("similarity"), (B.drawn("len", k, 200) / 100.0).alias("length_ratio"))
    seen = edits.where("doc_id % 11 <> 0").select("doc_id", F.when(k % 6 == 0, "x").otherwise(F.sha2(F.concat("source", F.lit("\n"), "improved"), 256)).alias("sha"))
    seen = seen.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("y").alias("sha")))
    return preparation.editability_export(edits, seen, "doc_id", "sha", 0.65, (0.8, 1.2), "s").select("doc_id", "issue")


@query(f"""WITH x AS (SELECT doc_id % 3 AS scenario, {drawn('ok', 'doc_id', 2)} = 0 AS ok, {drawn('r1', 'doc_id', 3)} AS r1, {drawn('r2', 'doc_id', 3)} AS r2 FROM labels), r AS (SELECT scenario, unnest(list_filter([CASE WHEN r1 = 0 THEN 'repeated' END, CASE WHEN r2 = 0 THEN 'open' END], lambda v: v IS NOT NULL)) AS reason FROM x WHERE NOT ok)
  SELECT scenario, reason, count(*) AS n FROM r GROUP BY 1, 2""")
def q_blocking_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why prompts have no edit, by scenario."""
    k = F.col("doc_id")
    why = F.array_compact(F.array(F.when(B.drawn("r1", k, 3) == 0, "repeated"), F.when(B.drawn("r2", k, 3) == 0, "open")))
    x = B.table(spark, sf_dir, "labels").select((k % 3).alias("scenario"), why.alias("reasons"), (B.drawn("ok", k, 2) == 0).alias("ok")).where("not ok")
    return reports.reason_counts_by(x, "scenario", "reasons")


# --- rewards and forms of text, on texts whose parts are known --------------------------------------

_M, _J = "(3 + doc_id % 5)", "(13 + doc_id % 9)"
_L = f"({_M} + {_J} + 6)"  # "(aaa) the bbb.", white space aside


def _case_text() -> Column:
    k = F.col("doc_id")
    return F.concat(F.lit("("), F.expr("repeat('a', cast(3 + doc_id % 5 as int))"), F.lit(") the "), F.expr("repeat('b', cast(13 + doc_id % 9 as int))"), F.lit("."))


_CASES = f"""x AS (SELECT doc_id, {_M}::DOUBLE AS m, {_J}::DOUBLE AS j, {_L}::DOUBLE AS len, doc_id % 6 = 0 AS cut, doc_id % 4 AS least FROM labels),
  r AS (SELECT *, list_max([CASE WHEN 2 * n <= len THEN greatest((j - n) * n, (m - n) * n, 0) ELSE 0 END FOR n IN range(3, 13)]) / len AS rep, 0.3 * greatest(30 - len, 0) / 30.0 + greatest(least - 1, 0) + 0.7 AS iv, 0.8 * 1 AS pv, abs(len - 45) / 45.0 AS far FROM x),
  s AS (SELECT *, 0.4 * far + 0.5 * least(rep, 1.0) + 0.3 * greatest(m / len - 0.5, 0.0) / 0.5 AS sv FROM r)"""
_V = "((1 - {0}) / (1 + {0}))"


@query(f"""WITH {_CASES} SELECT doc_id, len::BIGINT AS filled, round(iv, 6) AS instruction_violation, round(pv::DOUBLE, 6) AS persona_violation, round(sv, 6) AS style_violation, CASE WHEN cut THEN 'truncated' ELSE '' END AS hard, round((CASE WHEN cut THEN 0.8 ELSE 1.0 END)::DOUBLE, 6) AS recoverability,
  round(CASE WHEN cut THEN -12.0 + 2.0 * 0.8 ELSE 5.0 * {_V.format('iv')} + 2.0 * {_V.format('pv')} + {_V.format('sv')} END, 6) AS total FROM s""")
def q_reward_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered rule reward of texts whose counts follow from their making: one action, one sentence, one signature, a run of letters."""
    from . import workflows

    k = F.col("doc_id")
    d = B.table(spark, sf_dir, "labels").select("doc_id", _case_text().alias("text"), F.when(k % 6 == 0, "length").otherwise("stop").alias("finish"))
    bounds = {"actions": (k % 4, F.lit(4)), "sentences": (F.lit(2), F.lit(3)), "chars": (F.lit(30), F.lit(60)), "signatures": (F.lit(2), F.lit(3))}
    c = B.table(spark, sf_dir, "labels").select("doc_id", F.struct(*(x.cast("int").alias(f"{m}_{n}") for n, lows in bounds.items() for m, x in zip(("min", "max"), lows))).alias("constraints"))
    r = workflows.reward("rule")(d, c, "doc_id", "text", "finish")
    numbers = {"instruction_violation": "instruction_violation", "persona_violation": "persona_violation", "style_violation": "style_violation", "recoverability": "recoverability", "total_reward": "total"}
    return r.select("doc_id", F.col("reward.normalized_length").alias("filled"), F.array_join("reward.hard_invalid_reasons", ",").alias("hard"), *(F.round(f"reward.{a}", 6).alias(b) for a, b in numbers.items()))


@query(f"SELECT doc_id, round(least(list_max([CASE WHEN 2 * n <= {_L} THEN greatest(({_J} - n) * n, ({_M} - n) * n, 0) ELSE 0 END FOR n IN range(3, 13)])::DOUBLE / {_L}, 1.0), 6) AS repetition FROM labels")
def q_repetition_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that repeats make up, of texts with two runs of letters."""
    return B.table(spark, sf_dir, "labels").select("doc_id", F.round(P.repetition_ratio(_case_text()), 6).alias("repetition"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 1 END::BIGINT AS actions, CASE n_nationkey % 4 WHEN 1 THEN length(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) END::BIGINT AS gap, CASE n_nationkey % 4 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS nested,
  CASE n_nationkey % 4 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS unbalanced, CASE n_nationkey % 4 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS invalid, CASE n_nationkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 5 ELSE 2 END::BIGINT AS total, n_nationkey % 4 <> 0 AS has_letter FROM nation""")
def q_action_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of texts that hold none with letters, two with a gap, a nested one, an unbalanced one."""
    forms = F.array(F.concat(F.lit("(123) "), F.lit("12")), F.concat(F.lit("(nod) "), "n_name", F.lit(" (go)")), F.concat(F.lit("(a(b)c) "), "n_name"), F.concat(F.lit("(ab）"), "n_name", F.lit(")")))
    n = B.table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(forms, (F.col("n_nationkey") % 4 + 1).cast("int")).alias("t"))
    f = n.withColumn("f", T.action_facts(F.col("t"), T.actions(F.col("t"))))
    return f.select("n_nationkey", F.col("f.count").alias("actions"), F.col("f.minimum_gap").cast("long").alias("gap"), *(F.col(f"f.{c}").alias(c) for c in ("nested", "unbalanced", "invalid")), F.col("f.total_length").alias("total"), T.has_letter(F.col("t")).alias("has_letter"))


@query("""SELECT n_nationkey, 'ABC ' || n_name AS nfkc, 'abc' || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS comparison, n_name AS unthought, '{"a":1}' AS unfenced, 'Abc' || regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g') AS copied FROM nation""")
def q_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms: NFKC, for comparison, without an empty thinking wrapper, without a code fence, for copies."""
    n = F.col("n_name")
    wide = F.concat(F.lit("\t ＡＢＣ\u3000 "), n, F.lit(" \n"))
    return B.table(spark, sf_dir, "nation").select(
        "n_nationkey", P.nfkc_key(wide).alias("nfkc"), P.comparison_key(F.concat(wide, F.lit("!_-"))).alias("comparison"), T.drop_empty_think(F.concat(F.lit(" <think>\n</think>\n"), n)).alias("unthought"),
        T.drop_code_fence(F.lit('```json\n{"a":1}\n```')).alias("unfenced"), T.copy_form(F.concat(F.lit("Ab, c. "), n, F.lit("!"))).alias("copied"),
    )


@query("SELECT n_nationkey, round(2.0 * (length(n_name) + 2) / (2 * length(n_name) + 6), 6) AS ratio FROM nation")
def q_similarity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching ratio of texts that differ in their last character."""
    n = B.table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("12z")).alias("a"), F.concat("n_name", F.lit("12w")).alias("b"))
    return n.select("n_nationkey", F.round(P.ratio_udf(False)("a", "b"), 6).alias("ratio"))


@query("SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 2 = 0 THEN 'extra_tag' END, CASE WHEN conv_id % 3 = 0 THEN 'speaker_label' END) AS reasons FROM conversations")
def q_format_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and speakers' labels in answers."""
    text = F.concat(F.when(F.col("conv_id") % 3 == 0, "User : hello ").otherwise("hello "), F.when(F.col("turn") % 2 == 0, "<b> you").otherwise("a < b"))
    reasons = F.array_compact(F.array(F.when(T.has_tag(text), "extra_tag"), F.when(T.has_speaker_label(text), "speaker_label")))
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(reasons, ",").alias("reasons"))


@query(f"""WITH x AS (SELECT doc_id, {drawn('st', 'doc_id', 6)} > 0 AS st, {drawn('hv', 'doc_id', 6)} > 0 AS hv, {drawn('ch', 'doc_id', 6)} > 0 AS ch, {drawn('len', 'doc_id', 200)} / 100.0 AS len, {drawn('sim', 'doc_id', 101)} / 100.0 AS sim FROM labels)
  SELECT CASE WHEN NOT st THEN 'unstable' WHEN NOT hv THEN 'hard_invalid' WHEN NOT ch THEN 'unchanged' WHEN NOT len BETWEEN 0.5 AND 1.5 THEN 'length' WHEN sim < 0.4 THEN 'similarity' ELSE 'ok' END AS issue, count(*) AS n FROM x GROUP BY 1""")
def q_teacher_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why teachers' answers are refused."""
    from ..operators import curation

    k = F.col("doc_id")
    some = lambda n: B.drawn(n, k, 6) > 0
    issue = curation.teacher_issue(some("st"), some("hv"), some("ch"), B.drawn("len", k, 200) / 100.0, B.drawn("sim", k, 101) / 100.0, 0.5, 1.5, 0.4)
    return B.table(spark, sf_dir, "labels").groupBy(F.coalesce(issue, F.lit("ok")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, printf('%s_%04d', lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)) AS record_id FROM documents")
def q_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ids by place within a split."""
    from ..operators import curation

    out = curation.numbered(B.table(spark, sf_dir, "documents").select("doc_id", "lang"), "x", ["doc_id"], "lang")
    return out.select("doc_id", F.concat("lang", F.substring("record_id", 2, 100)).alias("record_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(length(coalesce(text, '')) AS VARCHAR) END AS response, CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS attempts,
  CASE WHEN doc_id % 5 = 0 THEN 'ValueError: refused ' || doc_id END AS error FROM documents""")
def q_external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an external function over whole texts: some come at the second attempt, some never; all are logged."""
    tried: dict[str, int] = {}

    def ask(text: str) -> str:
        number, _, own = text.partition(":")
        tried[number] = tried.get(number, 0) + 1
        if int(number) % 5 == 0 or int(number) % 5 == 1 and tried[number] < 2:
            raise ValueError(f"refused {number}")
        return str(len(own))

    d = B.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))).alias("t"))
    called = logs.call_external(d, "t", ask, attempts=3, at_once=4, waits=(0.001,), executor_limit=8).drop("t")
    log = scratch_dir(spark, "calls")
    try:
        return logs.logged_calls(called, log)
    except logs.CallsFailed:
        return spark.read.schema(called.schema).parquet(log)


@query("SELECT doc_id, length(coalesce(text, '')) AS n FROM documents")
def q_processed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are worked off in portions; the run is killed in its second one, and the next goes on."""
    plan, out = B.table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_dir(spark, "items")
    portion, tries = plan.count() // 3 + 1, []

    def work(rows_: DataFrame) -> DataFrame:
        tries.append(1)
        if len(tries) == 2:
            raise InterruptedError("on purpose")
        return rows_.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"))

    try:
        logs.process_items(plan, "doc_id", work, out, portion)
    except InterruptedError:
        logs.process_items(plan, "doc_id", work, out, portion)
    return logs.processed(spark, out)


@query("""WITH e AS (SELECT user_id, event_id, ['running', 'review', 'passed', 'failed'][event_id % 4 + 1] AS status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
  SELECT user_id, event_id, before, status, CASE WHEN before IS NOT NULL AND NOT coalesce(status IN ('review', 'failed') AND before = 'running' OR status IN ('passed', 'failed') AND before = 'review', false) THEN 'transition' END AS issue FROM b""")
def q_status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's status beside the one before it, from a stream that keeps one row of state for a user."""
    status = F.element_at(F.array(*map(F.lit, ("running", "review", "passed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    events = logs.read_stream(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"), "ts")
    steps = logs.status_machine(events, "user_id", "status", "event_id", "ts", {"running": ("review", "failed"), "review": ("passed", "failed")}, "36500 days", "36500 days")
    return logs.drain(steps, "append", "status-machine")


@query("""WITH a AS (SELECT n_nationkey AS id, n_name AS u FROM nation WHERE n_nationkey < 10), b AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'x' || n_nationkey ELSE n_name END AS u FROM nation WHERE n_nationkey BETWEEN 7 AND 14)
  SELECT 'a' AS "left", 'b' AS "right", a.id AS left_id, b.id::VARCHAR AS right_id FROM a JOIN b USING (u) UNION ALL SELECT 'a', 'other0', a.id, md5(u) FROM a WHERE id % 5 = 0 UNION ALL SELECT 'b', 'other0', b.id, md5(u) FROM b WHERE u IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0)""")
def q_data_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that two splits share, or a split and another table."""
    from . import workflows

    n = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("user"))
    b = n.where("id between 7 and 14").withColumn("user", F.when(F.col("id") % 4 == 0, F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(F.col("user")))
    return workflows.data_issues({"a": n.where("id < 10"), "b": b}, [(n.where("id % 5 = 0"), "user")], "id", "user")


@query(f"""WITH x AS (SELECT doc_id % 2 AS side, {drawn('reward', 'doc_id', 1000)} / 100.0 AS r, {drawn('hard', 'doc_id', 6)} = 0 AS h, {drawn('wrong', 'doc_id', 4)} AS w FROM labels), g AS (SELECT round(avg(r) FILTER (WHERE side = 0), 6) AS b_mean, count(*) FILTER (WHERE side = 0 AND h) AS b_hard, (sum(w) FILTER (WHERE side = 0))::BIGINT AS b_wrong,
  round(avg(r) FILTER (WHERE side = 1), 6) AS c_mean, count(*) FILTER (WHERE side = 1 AND h) AS c_hard, (sum(w) FILTER (WHERE side = 1))::BIGINT AS c_wrong FROM x) SELECT *, c_mean >= b_mean AS mean_not_lower, c_hard <= b_hard AS hard_invalid_not_higher, c_wrong <= b_wrong AS wrong_self_not_higher, c_mean >= b_mean AND c_hard <= b_hard AND c_wrong <= b_wrong AS passed FROM g""")
def q_reward_not_worse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the second of two scored sides is no worse."""
    from . import workflows

    k = F.col("doc_id")
    reward = F.struct((B.drawn("reward", k, 1000) / 100.0).alias("total_reward"), F.when(B.drawn("hard", k, 6) == 0, F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>")).alias("hard_invalid_reasons"), B.drawn("wrong", k, 4).alias("wrong_self_count"))
    d = B.table(spark, sf_dir, "labels").select((k % 2).alias("side"), reward.alias("reward"))
    out = workflows.reward_not_worse(d.where("side = 0"), d.where("side = 1"), "reward")
    return out.withColumns({n: F.round(n, 6) for n in ("b_mean", "c_mean")})


@query(f"""WITH x AS (SELECT doc_id, doc_id % 5 <> 0 AS ok, doc_id % 4 <> 0 AS kept, {drawn('i', 'doc_id', 3)} AS i, {drawn('p', 'doc_id', 3)} AS p, {drawn('v', 'doc_id', 2)} AS v, {drawn('e', 'doc_id', 4)} AS e, {drawn('q', 'doc_id', 3)} AS q, {drawn('code', 'doc_id', 2)} = 0 AS brk FROM labels)
  SELECT doc_id, ok::INT AS readable, CASE WHEN ok AND NOT kept THEN 'missing:reason' ELSE '' END AS issues, CASE WHEN NOT ok THEN 0.0 WHEN kept THEN (least(i + p + v, CASE WHEN brk THEN 1 ELSE 5 END) + e + q) / 2.0 END::DOUBLE AS reward FROM x""")
def q_judge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered judge reward: local components, a judge's answers, and what they break."""
    from . import workflows

    k = F.col("doc_id")
    codes = F.when(B.drawn("code", k, 2) == 0, F.array(F.lit("identity_break"))).otherwise(F.array().cast("array<string>"))
    names = {"identity_boundary_facts": ("i", 3), "personality_relationship": ("p", 3), "character_voice": ("v", 2), "response_effectiveness": ("e", 4), "expression_quality": ("q", 3)}
    raw = F.to_json(F.struct(*(B.drawn(n, k, below).alias(name) for name, (n, below) in names.items()), codes.alias("violations"), F.when(k % 4 != 0, "why").alias("reason")))
    d = B.table(spark, sf_dir, "labels").select("doc_id", F.when(k % 5 == 0, " ").otherwise("the end.").alias("text"), F.lit("stop").alias("finish"))
    out = workflows.reward("judge")(d, "text", "finish", B.table(spark, sf_dir, "labels").select("doc_id", raw.alias("raw")), "doc_id", "raw")
    return out.select("doc_id", "readable", F.array_join(F.coalesce("issues", F.array().cast("array<string>")), ",").alias("issues"), F.col("reward").cast("double").alias("reward"))


# --- streams, runs and folders ----------------------------------------------------------------------


@query("SELECT event_id, round(value, 4) AS loss FROM events WHERE event_id % 4 <> 0")
def q_stream_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of log lines that arrive as a stream."""
    e = B.table(spark, sf_dir, "events").select("event_id", F.round("value", 4).alias("v"))
    body = F.concat(F.when(F.col("event_id") % 4 != 0, "loss=").otherwise("lost="), F.format_string("%.4f", "v"))
    path = _lines(e, F.concat(F.col("event_id").cast("string"), F.lit("\t"), body), scratch_dir(spark, "log-stream"))
    lines = logs.stream_lines(spark, path).select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("event_id"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("line"))
    return logs.drain(records.progress_lines(lines, "line", ["loss"]).drop("line"), "append", "log-lines")


@query("""WITH x AS (SELECT user_id, event_id, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS before, s AS status FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'review' WHEN 2 THEN 'passed' ELSE 'failed' END AS s FROM events))
  SELECT * FROM x WHERE before IS NOT NULL AND NOT ((before = 'running' AND status IN ('review', 'failed')) OR (before = 'review' AND status IN ('passed', 'failed')))""")
def q_status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses that may not follow the one before."""
    status = F.element_at(F.array(*map(F.lit, ("running", "review", "passed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = B.table(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"))
    return logs.status_issues(e, "user_id", "status", "event_id", {"running": ("review", "failed"), "review": ("passed", "failed")})


@query("SELECT source, count(*) AS n, count(DISTINCT text) AS \"distinct\" FROM documents WHERE text IS NOT NULL GROUP BY source HAVING count(*) > count(DISTINCT text)")
def q_distinct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that hold an answer more than once."""
    from ..operators import pairs

    return pairs.repeated_answers(B.table(spark, sf_dir, "documents").where("text is not null"), "source", F.col("text"))


@query("SELECT doc_id AS taken FROM documents WHERE n_chars % 3 = 0 ORDER BY doc_id LIMIT 20")
def q_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty documents that a test accepts, from a source that is asked for more than is wanted, and then for what is missing."""
    docs = materialise(preparation.placed(B.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"]), "backfill")
    state = {"at": 0}

    def ask(n: int) -> list[str]:
        state["at"] += n
        got = docs.where(F.col("place").between(state["at"] - n + 1, state["at"])).orderBy("place").collect()  # n rows, 25 at most
        return [f"{r['doc_id']} {r['n_chars']}" for r in got]

    taken = reports.backfill(20, ask, lambda new, limit: [x for x in new if int(x.split()[1]) % 3 == 0][:limit], max_empty=50)
    return spark.createDataFrame([(int(x.split()[0]),) for x in taken], "taken long")


@query("SELECT a.n_nationkey AS left_id, a.n_nationkey AS right_id FROM nation a WHERE n_nationkey % 2 = 0")
def q_overlap_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of two tables by NFKC keys."""
    n = B.table(spark, sf_dir, "nation")
    a = n.select("n_nationkey", F.concat(F.lit("Ａ\u3000"), "n_name").alias("user"))
    b = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.concat(F.lit(" A  "), "n_name", F.lit("\t")).alias("user"))
    return isolation.overlaps(a, b, P.nfkc_key("user"), P.nfkc_key("user"), "n_nationkey", "n_nationkey").drop("key")


@query("SELECT n_name AS \"key\", 'v=' || n_nationkey AS value FROM nation WHERE n_nationkey % 3 <> 0")
def q_env_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of key=value lines."""
    k = F.col("n_nationkey")
    line = F.concat(F.when(k % 3 == 0, F.lit("# ")).otherwise(F.lit("  ")), "n_name", F.lit(" = 'v="), k.cast("string"), F.lit("'"))
    path = _lines(B.table(spark, sf_dir, "nation"), line, scratch_dir(spark, "env"))
    return records.env_pairs(spark.read.text(path))


@query("SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS ids, true AS stopped FROM documents WHERE lang IN ('de', 'en') GROUP BY lang")
def q_pruned_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in folders by language, of which two are a run's and the others are removed as extras; a file that is neither stops it first."""
    root = scratch_dir(spark, "run")
    B.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.partitionBy("lang").json(root)
    files = sorted(r["path"].rpartition(f"{root.rpartition('/')[2]}/")[2] for r in records.file_facts(spark, root, recursive=True).select("path").collect())  # names of files
    mine = ["_SUCCESS", *(f for f in files if f.startswith(("lang=de/", "lang=en/")))]
    extras = [f for f in files if f not in mine] + ["gone.txt"]
    stopped = False
    try:
        sinks.prune(spark, root, mine[1:], extras)
    except ValueError:
        stopped = True
    sinks.prune(spark, root, mine, extras)
    left = spark.read.schema("doc_id long, text string, lang string").json(root)
    return left.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).withColumn("stopped", F.lit(stopped))
