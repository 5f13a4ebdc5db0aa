"""Token ids in ORC: run-length encoded integers, row indexes, and Bloom filters on document ids.

Writing: the texts are dealt by ranges of document ids in one shuffle, sorted by id there, encoded and written, one
ORC file per range, as many as the scan has partitions unless told otherwise. They are encoded after the shuffle, so that its sampling pass reads texts but encodes none.
ORC stores the list lengths and the ids as run-length encoded integer streams (version 2), keeps minimum and
maximum of every column for each stripe and each ROW_STRIDE rows, and a Bloom filter of the document ids.

Reading: Spark splits files by stripe, so stripes are read in parallel; a filter on the document id is pushed down and
prunes by file, stripe and row-group statistics and by Bloom filter.

Encoding is the tokenizers library's. A byte-level BPE never joins characters across a single space that
stands between two non-spaces, so a text is cut there. Arrow parts each distinct piece into letters and the marks after them, and the ids of
either are looked up, in a cache that the library fills. Texts with other runs of white space around a space, with characters on whose class Unicode versions
may differ, or with a special token's string, are encoded whole.

Every row carries its place in its file, and a file its number in its name, so starts follow the files' own order.

Null texts count as empty: only the end id. Rows with equal ids are adjacent, ordered by their text's hash, and equal rows are each written; null ids come first.
Texts of any length are encoded whole, a row at a time where they exceed PORTION_BYTES. An empty table writes no row and reads back as empty; columns other than id and text aren't
read, whatever their names.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .caches import hold
from .store import materialise, quoted, short_batches

END_ID = 2
#: Rows after which ORC begins a row group.
ROW_STRIDE = 1000
#: Pieces that a generation of a worker's cache holds (of about 230 bytes; there are two generations).
CACHE_PIECES = 600_000
#: Text that is encoded at once.
PORTION_BYTES = 4 << 20
#: Characters of stable class beyond ASCII: the letters of Latin-1 and of the Latin extensions A and B.
_UNSURE = "[^\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ɏ]"
#: White space on either side of a space; the other kinds of white space are unsure characters.
_RUNS = ("  ", r" [\n\t\r]", r"[\n\t\r] ")


def _byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_ALPHABET = _byte_alphabet()


class Recent:
    """A mapping of bounded size: a full generation becomes the old one, and what is used of it comes back."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lookup(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """What the mapping has for distinct keys; ``make`` gives what it doesn't."""
        got: list = list(map(self.new.get, keys))
        gaps = [i for i, g in enumerate(got) if g is None]
        if gaps and len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        unknown = []
        for i in gaps:
            got[i] = self.old.get(keys[i])
            if got[i] is None:
                unknown.append(i)
        for i, made in zip(unknown, make([keys[i] for i in unknown]) if unknown else ()):
            got[i] = made
        self.new.update((keys[i], got[i]) for i in gaps)
        return got


class PieceEncoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that aren't cut at their spaces.
        self.odd = "|".join([*_RUNS, " $", *special, _UNSURE])
        self.forget()
        self.model = self.tokenizer.model
        self.line_end = self._ids(["\n"])[0]

    def forget(self) -> None:
        self.later, self.first = Recent(CACHE_PIECES), Recent(CACHE_PIECES // 10)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _solve(self, keys: list[str], space: str) -> list[bytes]:
        """Ids of keys, each after a space or none. A run of letters is one pre-token: it goes to the library's model as it is, in its alphabet of bytes, without the cost of a whole encoding."""
        out, other = [b""] * len(keys), []
        lead, tokenize = ("Ġ" if space else ""), self.model.tokenize
        for i, key in enumerate(keys):
            if key.isalpha():
                own = key if key.isascii() else key.encode().decode("latin-1").translate(_BYTE_ALPHABET)
                out[i] = array("I", [t.id for t in tokenize(lead + own)]).tobytes()
            else:
                other.append(i)
        for i, ids in zip(other, self._ids([space + keys[i] for i in other])):
            out[i] = ids
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by ``end_id``, and the number of ids of each text.

        The pieces of a batch are numbered by Arrow, so Python sees each distinct one once; ids are gathered by number.
        """
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False).astype(bool)
        counts = np.zeros(len(texts), np.int64)
        flat, counts[~odd] = self._cut_and_gather(texts.filter(pa.array(~odd)) if odd.any() else texts, end_id)
        if not odd.any():
            return flat, counts
        whole = [array("I", [*e.ids, end_id]) for e in self.tokenizer.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        counts[odd] = [len(w) for w in whole]
        out, of_odd = np.empty(counts.sum(), np.uint32), np.repeat(odd, counts)
        out[~of_odd] = flat
        out[of_odd] = np.concatenate([np.frombuffer(w, np.uint32) for w in whole])
        return out, counts

    def _cut_and_gather(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        begin, pieces = _split(texts.cast(pa.string()), " ")
        numbered = pieces.dictionary_encode()
        number, m = numbered.indices.to_numpy().copy(), len(numbered.dictionary)
        # A text's first piece has no space before it, and the end id comes after its last one.
        flat, size = self._pieces(pa.concat_arrays([numbered.dictionary, pieces.take(pa.array(begin[:-1]))]), m)
        number[begin[:-1]] = m + np.arange(n, dtype=np.int32)
        number = np.insert(number, begin[1:], m + n)
        out, sizes = _gathered(np.append(flat, np.uint32(end_id)), np.append(size, np.int32(1)), number)
        return out, np.add.reduceat(sizes, begin[:-1] + np.arange(n))

    def _pieces(self, pieces: pa.Array, m: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and the number of ids of each; the first ``m`` pieces follow a space.

        Most pieces are letters, with marks after them or none, or lines of such. A line end between them is a pre-token of its own, and so are the letters and the marks,
        so each distinct run of letters or marks is solved once, whatever stands beside it. Other pieces are solved as they are.
        """
        begin, lines = _split(pieces, "\n")
        word = pc.utf8_rtrim(lines, characters=string.punctuation)
        plain = np.logical_and.reduceat(pc.utf8_is_alpha(word).to_numpy(zero_copy_only=False), begin[:-1])
        n_lines = np.diff(begin)
        spaced, of_plain = np.zeros(len(lines), bool), np.repeat(plain, n_lines)
        spaced[begin[:m]] = True
        marks = _rests(lines, word)
        marked = of_plain & (pc.binary_length(marks).to_numpy() > 0)
        # Up to three numbers for each line: its letters, its marks, the line end after it.
        rows = np.full((len(lines), 3), -1, np.int64)
        every: list[bytes] = [self.line_end]
        odd = np.flatnonzero(~plain)
        for cache, space, later in ((self.later, " ", True), (self.first, "", False)):
            runs, rest = np.flatnonzero(of_plain & (spaced == later)), odd[(odd < m) == later]
            parts = [word.take(pa.array(runs)), pieces.take(pa.array(rest))] + ([] if later else [marks.take(pa.array(np.flatnonzero(marked)))])
            keys = pa.concat_arrays(parts).dictionary_encode()
            code = keys.indices.to_numpy() + len(every)
            every += cache.lookup(keys.dictionary.to_numpy(zero_copy_only=False).tolist(), partial(self._solve, space=space))
            rows[runs, 0], rows[begin[rest], 0] = code[: len(runs)], code[len(runs) : len(runs) + len(rest)]
            if not later:
                rows[marked, 1] = code[len(runs) + len(rest) :]
        rows[of_plain, 2] = 0
        rows[begin[1:] - 1, 2] = -1  # none after the last line
        held = rows >= 0
        flat, sizes = _gathered(np.frombuffer(b"".join(every), np.uint32), np.fromiter(map(len, every), np.int32, len(every)) // 4, rows[held])
        by_line = np.zeros(rows.shape, np.int32)
        by_line[held] = sizes
        return flat, np.add.reduceat(by_line.sum(axis=1, dtype=np.int32), begin[:-1])


def _split(texts: pa.Array, mark: str) -> tuple[np.ndarray, pa.Array]:
    """The parts of all texts, and the place of each text's first part, with the number of parts at the end."""
    cut = pc.split_pattern(texts, mark)
    at = cut.offsets.to_numpy().astype(np.int64)
    return at - at[0], cut.values.slice(at[0], at[-1] - at[0])


def _rests(texts: pa.Array, heads: pa.Array) -> pa.Array:
    """What follows each head in its text."""
    taken = pc.binary_length(heads).to_numpy()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    # Heads and rests in turn, over the texts' own bytes.
    both = np.empty(2 * len(texts) + 1, np.int32)
    both[0:-1:2], both[1::2], both[-1] = at[:-1], at[:-1] + taken, at[-1]
    every = pa.StringArray.from_buffers(2 * len(texts), pa.py_buffer(both), data)
    return every.take(pa.array(np.arange(1, 2 * len(texts), 2)))


def _gathered(flat: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of items by number, of which ``flat`` has the ids in turn and ``size`` how many; and how many each number took."""
    begin = np.cumsum(size, dtype=np.int32) - size
    sizes = size[number]
    upto = np.cumsum(sizes, dtype=np.int32)
    place = np.repeat(begin[number] - (upto - sizes), sizes)
    place += np.arange(len(place), dtype=np.int32)
    return flat[place], sizes


@lru_cache
def _loaded(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoder(path: str) -> PieceEncoder:
    """The encoder of a file, loaded once in each worker."""
    e = _loaded(path)
    hold("tokens", e.forget)
    return e


def portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PORTION_BYTES of text each, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION_BYTES, "right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        at = 0
        for batch in batches:
            for part in portions(batch, "text"):
                flat, counts = enc.encode(part.column("text"), end_id)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.arange(at, at + part.num_rows)), ids], ["id", "place", "ids"])
                at += part.num_rows

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, n_files: int | None = None) -> None:
    """Write rows (doc_id, place, ids) in ascending doc_id order to ORC files in ``out``, a file to a task, numbered in that order.

    Which rows a file has follows from their order: a task that runs again writes the same file.
    """
    short_batches(docs.sparkSession)
    base = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    if n_files is None:
        n_files = max(1, base.rdd.getNumPartitions())
    kind = dict(base.dtypes)["id"]
    ranged = base.repartitionByRange(n_files, "id")
    ordered = ranged.withColumn("th", F.xxhash64("text")).sortWithinPartitions("id", "th").select("id", "text")
    rows = ordered.mapInArrow(_encoded(tokenizer, end_id), f"id {kind}, place long, ids array<int>").withColumnRenamed("id", "doc_id")
    rows.write.options(**{"maxRecordsPerFile": "0", "compression": "snappy", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(ROW_STRIDE), "orc.create.index": "true"}).orc(out)


def read_tokens(spark: SparkSession, path: str, ids: Sequence | None = None) -> DataFrame:
    """Rows (doc_id, ids); with ``ids`` only those documents, pruned by the files' statistics and Bloom filters."""
    rows = spark.read.orc(path).select("doc_id", "ids")
    return rows if ids is None else rows.where(F.col("doc_id").isin(list(ids)))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("token-layout")  # the workers that encoded read next, and need their pieces no more
    for batch in batches:
        lists = batch.column("ids")
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        raw = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(raw[4 * int(a) : 4 * int(b)]) for a, b in zip(ends[:-1], ends[1:])]
        names = ["doc_id", "file", "place"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], [*names, "n_tokens", "ids_crc32"])


def token_layout(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files are in id order by their number. Starts are running sums in the order of a file, shifted by the sums of the files before:
    one row per file is all that meets in one task.
    """
    raw = spark.read.orc(path)
    kind = dict(raw.dtypes)["doc_id"]
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = raw.select("doc_id", "ids", number.alias("file"), "place")
    rows = rows.mapInArrow(_digested, f"doc_id {kind}, file long, place long, n_tokens long, ids_crc32 long")
    rows = materialise(rows, "token-layout")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inner", F.coalesce(inner, F.lit(0))).join(before, "file").select("doc_id", (F.col("inner") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
