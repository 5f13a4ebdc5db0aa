"""WARC records, and the resolution of not-modified revisits.

A revisit of the server-not-modified profile has headers but no body. It is joined as of its date to the latest earlier
full response of the same canonical URL. If the validator that the revisit carries (its ETag, or where it has none its
Last-Modified) agrees with the response's, the revisit takes that response's payload, and of its own headers those
that a 304 may change (RFC 9111, section 3.2); all others stay the response's.

The as-of join sorts no URL's whole history in one task. Dates are cut into ranges by quantiles, as many as the URL of most rows needs; the last response of each
(URL, range) comes from a partial aggregate, is carried forward over the ranges in a window of one row per
range, and only the rows of one (URL, range) are sorted together. So a URL with a third of all records is spread over the ranges.

Files are read record by record: Spark's text reader cuts them wherever a record may end and the next begin, one file to a task, so a gzipped file is a stream and no file is cut by size.
A record is sound if its Content-Length ends where the cut is, or at a later one (a block may hold such a place, a whole nested record too). If it ends nowhere so, or is missing or
negative, the record takes all up to the next record's head and carries an ``issue``; reading goes on with that head, so a wrong length costs no other record. What belongs to no record is
a row of kind ``fragment``. So every byte is in some row of ``warc_rows``; ``warc_faults`` counts what is wrong. A record is held whole in memory, LARGEST bytes at most.

Null URLs and dates match nothing: such revisits are unresolved. A response without a record id can't be named, and one whose file ends within it isn't whole: both are left out; a revisit needs none. Ties: a
response at the very date of a revisit is not earlier; of responses with equal dates the one with the largest record id counts, and of several responses of one id the
one whose payload has the smallest hash. A repeated revisit is resolved as often as it stands there. Null headers count as none. An empty table gives an empty result; columns
beyond SCHEMA's are left out.
"""

from __future__ import annotations

import gzip
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialise, short_batches

SCHEMA = "record_id string, kind string, url string, ts long, status int, headers map<string,string>, payload binary"
# Headers of a 304 that never replace stored ones (they describe a message or a body that isn't there).
KEPT_OF_RESPONSE = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that name a visit, not a page.
TRACKING = r"(?:utm_[A-Za-z_]*|fbclid|gclid|sessionid|phpsessid|jsessionid)"
#: Rows of one URL in one date range, on average, where the URL has the most; and the most ranges.
RANGE_ROWS, MOST_RANGES = 20_000, 4096


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, default port and user, then path and query as they are, without fragment, tracking parameters, index file and last slash; no scheme."""
    whole = F.trim(url)
    part = lambda i: F.regexp_extract(whole, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)(.*)$", i)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(part(1)), r"^.*@", ""), r"^www\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_replace(part(2), r"(?s)#.*$", "")
    rest = F.regexp_replace(rest, rf"([?&]){TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(rest, r"[?&]+$", "")
    rest = F.regexp_replace(rest, r"\?&+", "?")
    rest = F.regexp_replace(rest, r"&&+", "&")
    rest = F.regexp_replace(rest, r"/(?:index|default)\.(?:html?|php|aspx?)(\?|$)", "/$1")
    return F.concat(host, F.regexp_replace(rest, r"/(\?|$)", "$1"))


#: Where a record ends and the next begins.
BETWEEN = b"\r\n\r\nWARC/1."
#: A block of more bytes is taken for a wrong length.
LARGEST = 1 << 30
#: With files of a terabyte at most, one to a partition.
_WHOLE_FILES = {"spark.sql.files.maxPartitionBytes": 1 << 40, "spark.sql.files.openCostInBytes": 1 << 40, "spark.sql.files.minPartitionNum": 1}


class _Parts:
    """The parts of files that are cut at every BETWEEN, with a way back; None where a file ends. Each comes with its place in its file."""

    def __init__(self, parts: Iterator[bytes]):
        self.stream, self.back, self.at = iter(parts), deque(), 0

    def take(self) -> tuple[int, bytes] | None:
        if self.back:
            return self.back.popleft()
        part = next(self.stream, None)
        if part is None:
            return None
        if part.startswith(BETWEEN[4:]):  # a file begins
            fresh, self.at = self.at > 0, len(part)
            own = (0, part[len(BETWEEN) - 4 :])
            if fresh:
                self.back.append(own)
                return None
            return own
        at, self.at = self.at + 4, self.at + len(BETWEEN) + len(part)
        return at, part

    def put_back(self, parts: list) -> None:
        self.back.extendleft(reversed(parts))


def _head(part: bytes) -> tuple[dict[str, str], bytes] | None:
    """The headers of a record and what follows them; None if the part doesn't begin like a record."""
    head, _, rest = part.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].strip().isdigit() or not all(b":" in x or x[:1] in b" \t" for x in lines[1:]):
        return None
    own = _pairs(lines[1:])
    return (own, rest) if "warc-type" in own else None


def records_of(parts: Iterator[bytes], largest: int = LARGEST) -> Iterator[dict]:
    """All records and fragments of files that are cut at every BETWEEN, in order, each with its offset and issue."""
    source, ended = _Parts(parts), 0
    while ended < 2:
        got = source.take()
        if got is None:  # a file's end, and the end of all files if another follows at once
            ended += 1
            continue
        ended, (at, part) = 0, got
        found = _head(part)
        if found is None:
            yield {"kind": "fragment", "payload": part, "headers": [], "offset": at, "issue": "no record head"}
            continue
        own, rest = found
        claim = own.get("content-length", "")
        size = int(claim) if claim.isascii() and claim.isdigit() else None
        block, issue = rest, None
        if size is None or size > largest:
            issue = "no length" if size is None else "length too large"
        elif len(rest) >= size:
            if rest[size:].strip(b"\r\n"):
                issue = "length too small"
            else:
                block = rest[:size]
        else:
            taken, have, end = [], len(rest), False
            while have < size and not end:
                more = source.take()
                end = more is None
                if not end:
                    taken.append(more)
                    have += len(BETWEEN) + len(more[1])
            whole = BETWEEN.join([rest, *(x for _, x in taken)]) if have >= size else b""
            if have >= size and not whole[size:].strip(b"\r\n"):
                block = whole[:size]
            else:
                issue = "length too large"
                source.put_back([*taken, *([None] if end else [])])
        if issue:  # all up to the next head is this record's
            more = []
            while (following := source.take()) is not None and _head(following[1]) is None:
                more.append(following[1])
            source.put_back([following])
            block = BETWEEN.join([rest, *more])
            if following is None and size is not None and len(block) < size <= largest:
                issue = "truncated"
            if following is None and block.endswith(b"\r\n\r\n") and issue != "truncated":
                block = block[:-4]
        yield _record(own, block) | {"offset": at, "issue": issue}


def _record(own: dict[str, str], block: bytes) -> dict:
    kind = own["warc-type"]
    head, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
    lines = head.split(b"\r\n")
    status = lines[0].split()[1:2]
    return {
        "record_id": own.get("warc-record-id"), "kind": kind, "url": own.get("warc-target-uri"), "ts": _epoch(own.get("warc-date")),
        "status": int(status[0]) if status and status[0].isdigit() else None, "headers": list(_pairs(lines[1:]).items()), "payload": payload if kind != "revisit" else None,
    }


def _pairs(lines: list[bytes]) -> dict[str, str]:
    """Headers by lower-case name. Lines of one name are joined by a comma, cookies by a line end, as theirs may hold commas; a folded line goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for x in (line.decode("utf-8", "replace") for line in lines):
        if x[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {x.strip()}".strip()
        elif ":" in x:
            name, _, value = x.partition(":")
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}{chr(10) if name == 'set-cookie' else ', '}{value}" if name in out else value
    return out


def _epoch(date: str | None) -> int | None:
    from datetime import datetime

    try:
        return int(datetime.fromisoformat((date or "").replace("Z", "+00:00")).timestamp())
    except ValueError:
        return None


_ARROW = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("ts", pa.int64()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("offset", pa.int64()), ("issue", pa.string())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((r["file"], r["content"]) for batch in batches for r in (dict(zip(batch.schema.names, x)) for x in zip(*(c.to_pylist() for c in batch.columns))))
    for file, parts in groupby(rows, key=lambda r: r[0]):
        for record in records_of(content for _, content in parts):
            yield pa.RecordBatch.from_pylist([record | {"file": file}], _ARROW)


def warc_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every record and fragment of WARC files, plain or gzipped by record: file, SCHEMA's columns, offset (in the unpacked file) and issue (null: sound)."""
    own = spark.newSession()  # so that the caller's settings stay
    for key, value in _WHOLE_FILES.items():
        own.conf.set(key, str(value))
    short_batches(own, 16)
    rows = own.read.option("lineSep", BETWEEN.decode()).text(path)
    content = rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("content"))
    return content.mapInArrow(_parsed, f"file string, {SCHEMA}, offset long, issue string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files, those with an issue too: it is a column beside SCHEMA's."""
    return warc_rows(spark, path).where(F.col("kind").isin("response", "revisit")).drop("file", "offset")


def warc_faults(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, issue, n): what is wrong in which file."""
    return warc_rows(spark, path).where("issue is not null").groupBy("file", "issue").agg(F.count(F.lit(1)).alias("n"))


def serialise_record(r: dict) -> bytes:
    """One gzipped WARC record, as it is appended to a file."""
    from datetime import datetime, timezone

    head = f"HTTP/1.1 {r['status']} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r["headers"].items())
    block = head.encode() + b"\r\n" + (r["payload"] or b"")
    date = datetime.fromtimestamp(r["ts"], timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = f"WARC/1.1\r\nWARC-Type: {r['kind']}\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Target-URI: {r['url']}\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(own.encode() + block + b"\r\n\r\n", mtime=0)


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def _rank(ts: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``ts``, looked up in blocks."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    upto = lambda block: F.size(F.filter(block, lambda c: c <= ts))
    at = upto(F.array(*(F.lit(b[0]) for b in blocks)))
    return F.when(at > 0, (at - 1) * step + upto(F.get(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), at - 1))).otherwise(0)


def as_of(revisits: DataFrame, responses: DataFrame, ranges: int | None = None) -> DataFrame:
    """``revisits`` (key, ts, record_id, ...) with ``hit``: the record id of the latest earlier response (key, ts, record_id), or null. ``ranges``: by the largest key's rows if not given."""
    both = responses.select("key", "ts", "record_id", F.lit(True).alias("full")).unionByName(revisits.select("key", "ts", "record_id", F.lit(False).alias("full")))
    both = materialise(both.where("key is not null and ts is not null"), "warc-events")
    if ranges is None:
        most = both.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        ranges = min(MOST_RANGES, max(1, -(-most // RANGE_ROWS)))
    cuts = both.agg(F.percentile_approx("ts", [i / ranges for i in range(1, ranges)], 10 * MOST_RANGES)).first()[0] if ranges > 1 else []
    cut = both.withColumn("part", _rank(F.col("ts"), sorted(set(cuts or []))))
    last = cut.where("full").groupBy("key", "part").agg(F.max(F.struct("ts", "record_id")).alias("last"))
    # The last response of any range before: the ranges that hold rows of a key, at most `ranges` of them.
    spans = cut.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).join(last, ["key", "part"], "left")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("key", "part", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    within = Window.partitionBy("key", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    own = F.max(F.when(F.col("full"), F.struct("ts", "record_id"))).over(within)
    met = cut.withColumn("own", own).where("not full").join(carried, ["key", "part"], "left")
    found = met.select("record_id", F.coalesce(F.col("own"), F.col("before")).getField("record_id").alias("hit")).distinct()
    return revisits.join(found, "record_id", "left")


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per revisit of ``records`` (columns of SCHEMA): its resolution.

    Returns record_id, url_key, response_id, status ('resolved', 'validator mismatch', 'no validator', 'no earlier response'),
    headers (merged; the revisit's own where it isn't resolved) and payload (null where it isn't). Record ids identify records.
    """
    cut_short = F.coalesce(F.col("issue") == "truncated", F.lit(False)) if "issue" in records.columns else F.lit(False)
    keyed = records.select(*(F.col(c) for c in ("record_id", "kind", "url", "ts", "headers", "payload")), cut_short.alias("cut_short")).withColumn("key", canonical_url(F.col("url")))
    full = keyed.where((F.col("kind") == "response") & F.col("record_id").isNotNull() & ~F.col("cut_short"))
    revisits = keyed.where(F.col("kind") == "revisit").select("record_id", "key", "ts", F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers"))
    # A revisit is known by its place in a written table, so it needs no id and may repeat one.
    revisits = materialise(revisits.withColumn("row", F.monotonically_increasing_id()), "warc-revisits")
    found = as_of(revisits.select(F.col("row").cast("string").alias("record_id"), "key", "ts"), full, ranges).select(F.col("record_id").cast("long").alias("row"), "hit")
    # Revisits without a response stay out of the join, where their null key would meet in one task.
    hits = materialise(revisits.join(found, "row"), "warc-hits")
    value = F.struct(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("r_headers"), "payload")
    stored = full.groupBy(F.col("record_id").alias("hit")).agg(F.min_by(value, F.xxhash64("payload")).alias("stored")).select("hit", "stored.*")
    met = hits.where("hit is not null").join(stored, "hit").unionByName(hits.where("hit is null"), allowMissingColumns=True)
    no_tag, no_date = (_header(F.col("headers"), n).isNull() for n in ("etag", "last-modified"))
    agree = F.when(~no_tag, _header(F.col("headers"), "etag") == _header(F.col("r_headers"), "etag")).otherwise(_header(F.col("headers"), "last-modified") == _header(F.col("r_headers"), "last-modified"))
    status = (
        F.when(F.col("hit").isNull(), "no earlier response").when(F.coalesce(no_tag & no_date, F.lit(True)), "no validator")
        .when(F.coalesce(agree, F.lit(False)), "resolved").otherwise("validator mismatch")
    )
    changes = F.map_filter("headers", lambda k, v: ~F.lower(k).isin(*KEPT_OF_RESPONSE))
    stays = F.map_filter("r_headers", lambda k, v: ~F.map_contains_key(changes, k))
    done = met.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return done.select("record_id", F.col("key").alias("url_key"), F.col("hit").alias("response_id"), "status", F.when(ok, F.map_concat(stays, changes)).otherwise(F.col("headers")).alias("headers"), F.when(ok, F.col("payload")).alias("payload"))
