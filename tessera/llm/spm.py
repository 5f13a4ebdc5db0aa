"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a text once. At each position it follows the output links to every piece that ends there, longest first, and relaxes the
best score of that position by the score where the piece begins plus that of the step. The path is read back from the end.

* In a unigram model a step's score is the piece's own, so the best path is that of the highest total score. Characters that no piece covers cost
  UNKNOWN_PENALTY more than the worst piece.
* In a merge (BPE) model, as the one at hand, a step's score is 0 where merging the two neighbouring pieces' characters in order of rank leaves just these two,
  and minus infinity elsewhere. A text's merged form is the one path all of whose neighbours are so, and the same holds for each of its prefixes; so a position is
  settled by the first piece that fits, and the ids are the sentencepiece library's own. Which neighbours fit is worked out once for each pair of pieces and kept.

Characters that no piece covers are written as the byte pieces of their UTF-8 form.

In the models at hand a piece has the word mark only at its front. So no piece spans a character that is not the
mark and a mark after it, every path passes through such a place, and the parts between can be solved
apart: the operator solves each distinct part and keeps it in a bounded cache. (A unigram model with other pieces is solved text by text; a merge model with them is refused.)
Runs of marks have no rank in a merge model: they are merged last, from the left, and apart from the word behind them.

Texts are normalised as such a model asks: a mark at the front (if it adds one), then a mark for every
space; nothing else is changed. Nulls count as empty texts, which have no ids and decode to the empty text. A text that holds the mark itself decodes to a space
there. Very long texts are encoded whole, in memory linear in them. Each row is handled alone, so ties, repeated rows and empty tables need nothing; other columns stay as they are, but one
of the name of a result, which is replaced.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .caches import hold
from .store import free_names, quoted, short_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct parts that a generation of a worker's cache holds (of about 200 bytes; there are two generations).
CACHE_PARTS = 700_000
#: Pairs of neighbouring pieces of which a worker knows whether they fit.
CACHE_PAIRS = 250_000
#: Kinds of pieces in a model file that may be matched in a text: normal and user-defined.
_MATCHED, _BYTE = (1, 4), 6


class PieceModel:
    """A SentencePiece model file: pieces, scores and normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.name not in ("identity", "") or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only models of the identity normaliser that keep white space are read")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [float(p.score) for p in proto.pieces]
        matched = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in _MATCHED and p.piece}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.raw: list[bytes] = [p.encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.ids = matched
        #: Whether pieces come from merges in order of rank (their scores), or have scores of their own.
        self.merges = proto.trainer_spec.model_type == 2
        worst = min([self.scores[i] for i in matched.values()] or [0.0])
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.separable = not any(MARK in p.lstrip(MARK) for p in matched)
        if self.merges and not self.separable:
            raise ValueError(f"{path}: a piece has the word mark behind its front")
        #: Finds every piece that ends at a place, with its length, score (in a unigram model) and id, by following the output links.
        self.automaton = ahocorasick.Automaton()
        for piece, i in matched.items():
            if not self.merges or piece == MARK or piece.strip(MARK):
                self.automaton.add_word(piece, (len(piece), i) if self.merges else (len(piece), self.scores[i], i))
        self.automaton.make_automaton()
        #: By a piece's id plus one (0: nothing before) the pieces that fit behind it, and those that don't.
        self.fits: list[dict[int, bool]] = []
        self.pairs = 0
        self._forget_pairs()
        self.runs: dict[int, list[int]] = {}
        self.limit = CACHE_PARTS
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def best_path(self, text: str) -> list[int]:
        """The ids of the best path over a text whose spaces are marks already; for a merge model over one part of it."""
        if not self.merges:
            return self._by_scores(text)
        if text[:1] == MARK and text[1:2] not in ("", MARK):  # a word with its mark
            return self._by_merges(text)
        body = text.lstrip(MARK)
        marks = len(text) - len(body)
        own = self._by_merges(MARK * bool(marks) + body) if body else []
        # The last mark belongs to the word, unless nothing merges with it.
        if marks and body:
            marks -= 1
            if own[0] == self.ids.get(MARK):
                marks, own = marks + 1, own[1:]
        if marks not in self.runs:
            run = self.merged(MARK * marks)
            if len(self.runs) < 1000:
                self.runs[marks] = run
            return run + own
        return self.runs[marks] + own

    def merged(self, text: str) -> list[int]:
        """What merging in order of rank, equal ranks from the left, makes of a text."""
        size = [1] * len(text)  # of the symbol that begins at a place; 0: none does any more
        before, after = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        open_: list[tuple[float, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and (right := after[at]) < len(text):
                n = size[at] + size[right]
                i = self.ids.get(text[at : at + n])
                if i is not None:
                    heapq.heappush(open_, (-self.scores[i], at, n))

        for at in range(len(text) - 1):
            offer(at)
        while open_:
            _, at, n = heapq.heappop(open_)
            right = after[at]
            if not size[at] or right >= len(text) or size[at] + size[right] != n:
                continue
            size[at], size[right] = n, 0
            after[at] = after[right]
            if after[right] < len(text):
                before[after[right]] = at
            offer(before[at])
            offer(at)
        out: list[int] = []
        at = 0
        while at < len(text):
            out += self._symbol(text[at : at + size[at]])
            at = after[at]
        return out

    def _symbol(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def _fit(self, last: int, piece: int) -> bool:
        """Whether merging leaves the border between two pieces (``last`` < 0: whether it makes the piece)."""
        if self.pairs > CACHE_PAIRS:
            self._forget_pairs()
        left = [last] if last >= 0 else []
        out = self.merged("".join(self.pieces[i] for i in [*left, piece])) == [*left, piece]
        self.fits[last + 1][piece] = out
        self.pairs += 1
        return out

    def _forget_pairs(self) -> None:
        self.fits[:] = [{} for _ in range(len(self.pieces) + 1)]
        self.pairs = 0

    def _by_merges(self, text: str) -> list[int]:
        fits = self.fits
        by, size = [-1] * (len(text) + 1), [1] * (len(text) + 1)
        for at, (length, piece) in self.automaton.iter(text):
            if by[at + 1] < 0:
                last = by[at + 1 - length]
                fit = fits[last + 1].get(piece)
                if fit or fit is None and self._fit(last, piece):
                    by[at + 1], size[at + 1] = piece, length
        ids: list[int] = []
        end = len(text)
        while end:
            piece = by[end]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += self._symbol(text[end - 1])[::-1]
            end -= size[end]
        ids.reverse()
        return ids

    def _by_scores(self, text: str) -> list[int]:
        n, unknown = len(text), self.unknown_score
        best, origin, by = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        at = 0  # the positions up to here have their first value
        for last, (length, score, piece) in self.automaton.iter(text):
            end = last + 1
            while at < end:  # a character may always stand alone, as an unknown one
                at += 1
                best[at], origin[at] = best[at - 1] + unknown, at - 1
            score += best[end - length]
            if score > best[end]:
                best[end], origin[end], by[end] = score, end - length, piece
        while at < n:
            at += 1
            best[at], origin[at] = best[at - 1] + unknown, at - 1
        return self._read_back(text, by, origin)

    def _read_back(self, text: str, by: list[int], origin: list[int]) -> list[int]:
        ids: list[int] = []
        end = len(text)
        while end:
            if by[end] >= 0:
                ids.append(by[end])
            else:
                ids += self._symbol(text[origin[end] : end])[::-1]
            end = origin[end]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if not self.separable:
            return np.array(self.best_path(self.prefix + text.replace(" ", MARK)), "<i4").tobytes()
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        parts = text.split(" ")
        if not self.prefix or "" in parts or MARK in text:
            parts = self._parts(self.prefix + text.replace(" ", MARK))
        # Else every part is a word with a mark before it, and is kept without the mark.
        got = list(map(self.new.get, parts))
        if None in got:
            got = [self._part(p) if g is None else g for p, g in zip(parts, got)]
        return b"".join(got)

    def forget(self) -> None:
        self.new, self.old = {}, {}
        self._forget_pairs()

    @staticmethod
    def _parts(text: str) -> list[str]:
        """A cut before every mark that follows another character."""
        words = text.split(MARK)
        if "" not in words[1:]:
            return [words[0]] * bool(words[0]) + [MARK + w for w in words[1:]]
        parts, marks = [words[0]] * bool(words[0]), 0
        for w in words[1:]:
            marks += 1
            if w:
                parts.append(MARK * marks + w)
                marks = 0
        return parts + [MARK * marks] * bool(marks)

    def _part(self, part: str) -> bytes:
        ids = self.new.get(part)
        if ids is None:
            ids = self.old.get(part)
            if ids is None:
                whole = part if not self.prefix or part[:1] == MARK else MARK + part
                ids = array("i", self.best_path(whole)).tobytes()
            self.new[part] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache
def _loaded(path: str) -> PieceModel:
    return PieceModel(path)


def model(path: str, cache_parts: int = 0) -> PieceModel:
    """The model of a file, loaded once in each worker, with a cache of that many parts to a generation."""
    m = _loaded(path)
    m.limit = cache_parts or CACHE_PARTS
    hold("spm", m.forget)
    return m


def _each(path: str, fn, cache_parts: int = 0) -> object:
    """mapInArrow over all columns plus what ``fn`` adds, a few hundred rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, cache_parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                added = fn(m, part)
                yield pa.RecordBatch.from_arrays([*part.columns, *added.values()], [*part.schema.names, *added])

    return run


def _ids_of(m: PieceModel, texts: list[str | None]) -> pa.Array:
    raw = [m.encode(t or "") for t in texts]
    ends = np.cumsum([0] + [len(r) // 4 for r in raw])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _with(df: DataFrame | T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(df.schema if isinstance(df, DataFrame) else df).fields, T.StructField(name, kind)])


def _text_frame(docs: DataFrame, text_col: str, *drop: str) -> tuple[DataFrame, str]:
    """``docs`` without the columns to be replaced, and with its text as a string under a free name."""
    short_batches(docs.sparkSession)
    rest = docs.drop(*(quoted(c) for c in drop if c in docs.columns)) if drop else docs
    (tmp,) = free_names(rest, "spm_text")
    return rest.withColumn(tmp, quoted(text_col).cast("string")), tmp


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of every whole text; a column of the name of ``ids_col`` is replaced."""
    wide, tmp = _text_frame(docs, text_col, ids_col)
    run = _each(path, lambda m, b: {ids_col: _ids_of(m, b.column(tmp).to_pylist())})
    return wide.mapInArrow(run, _with(wide, ids_col, T.ArrayType(T.IntegerType()))).drop(tmp)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids give an empty text."""
    short_batches(rows.sparkSession)
    rest = rows.drop(quoted(out_col)) if out_col in rows.columns else rows
    run = _each(path, lambda m, b: {out_col: pa.array([m.decode(x or []) for x in b.column(ids_col).to_pylist()], pa.string())})
    return rest.mapInArrow(run, _with(rest, out_col, T.StringType()))


def transcribe(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", cache_parts: int = 0) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task has one Python worker; ``cache_parts`` (0: as many as usual) trades its memory for time."""
    wide, tmp = _text_frame(docs, text_col, ids_col, out_col)

    def both(m: PieceModel, b: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = _ids_of(m, b.column(tmp).to_pylist())
        return {ids_col: ids, out_col: pa.array(map(m.decode, ids.to_pylist()), pa.string())}

    return wide.mapInArrow(_each(path, both, cache_parts), _with(_with(wide, ids_col, T.ArrayType(T.IntegerType())), out_col, T.StringType())).drop(tmp)


def _checked(m: PieceModel, batch: pa.RecordBatch) -> dict[str, pa.Array]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    ids = _ids_of(m, texts)
    back = [m.decode(x) == t for x, t in zip(ids.to_pylist(), texts)]
    raw = np.ascontiguousarray(ids.flatten().to_numpy())
    ends = ids.offsets.to_numpy()
    crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
    return {"ids": ids, "n_pieces": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(back)}


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ids, n_pieces, ids_crc32 (little-endian 32-bit ids), round_trip (decoding gives the text back)."""
    short_batches(docs.sparkSession)
    base = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    kind = dict(base.dtypes)["id"]
    out = base.mapInArrow(_each(path, _checked), f"id {kind}, text string, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean")
    return out.drop("text")
