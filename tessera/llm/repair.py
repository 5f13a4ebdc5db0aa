"""Conversation structure repair: the cheapest edits that turn each conversation into alternating user and assistant turns.

Rows of a conversation stand by turn (nulls first; ties by a hash of role and text). A row is blank (no visible character), else a duplicate (role and text stood there
before), else truncated (its last visible character ends no sentence). Keeping a row costs 0, giving it the role user or assistant 3, deleting it 4 (blank rows and
duplicates must go), inserting an empty turn 3, leaving a truncated row in 3 more. The roles' initials that are left must read ``(s?(ua)+)?``.

The programme runs over the rows that are retained, kept or with a new role, from the last to the first. Between two retained rows all are deleted, so a gap costs the
difference of two prefix sums of deletions plus the inserts that the pair of roles calls for; one running minimum for each role of the row behind the gap gives its best price at
once, so a row costs three steps however far its neighbour stands. Equal costs go to the ASCII-least string of edits: the longest run of deletions first (a minimum is replaced by
smaller values only), then inserts, keeps, new roles.

Scale: rows are ordered by ranges of (conversation, turn), and every conversation is cut into pieces of PIECE rows at most, one letter a row. A piece is a 4 x 4 table of costs from the
state before it to the state behind it; tables are combined from the back and states from the front, so a conversation that holds a third of all rows is solved piece by piece in many
tasks. Duplicates come from a partial aggregate of first places. Texts are joined to their edits by row number and never grouped; only the digest of a whole conversation
reads its rows in order in one task, a batch at a time, as a hash of a sequence must.

Null roles and texts are one space, null conversation ids one conversation; repeated rows count each; an empty table gives an empty result. Very long texts are one row
like any other. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, quoted

#: Rows of a piece: 2 ** PIECE_BITS at most.
PIECE_BITS = 16
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
VISIBLE = r"[^\x20\x09-\x0D]"
#: States are the last role's initial: none yet, s, u, a. Inserts before a retained s, u, a in each state (s only at the start), and at the end.
START, S, U, A = range(4)
NEVER = 1 << 40
GAPS = ((NEVER, 0, 0, 1), (NEVER, NEVER, 0, 1), (NEVER, NEVER, 1, 0), (NEVER, NEVER, 0, 1))
TAIL = (0, 2, 1, 0)
FINAL = tuple(INSERT * n for n in TAIL)
#: Letters of rows: s, u, a and others (o) as they are, upper case where truncated, the figures of the last line where they must go.
KEPT, CUT, GONE = "suao", "SUAO", "1234"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults: by the checksum of conversation and turn, modulo 20, 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's."""
    role, text = _text(quoted(role_col)), _text(quoted(text_col))
    fault = F.crc32(F.concat(_text(quoted(conv_col)), F.lit(":"), _text(quoted(turn_col))).cast("binary")) % 20
    own = rows.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault != 0")
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def backwards(codes: str, ends: tuple[int, ...]) -> tuple[list[int], list[list[tuple[int, int] | None]], list[tuple[int, int] | None]]:
    """Costs from each state before the piece, given those from each state behind it; the next retained row and role after each retained one; the first one from each state. None: no more."""
    n = len(codes)
    best, place = [NEVER * 4] * 4, [0] * 4
    nexts: list[list[tuple[int, int] | None]] = [[None] * 4 for _ in range(n + 1)]

    def after(j: int, state: int) -> tuple[int, tuple[int, int] | None]:
        cost, choice = DELETE * (n - j) + ends[state], None
        for role in (S, U, A):
            price = best[role] - DELETE * j + INSERT * GAPS[state][role]
            if price < cost:
                cost, choice = price, (place[role], role)
            elif price == cost and choice is not None and cost < NEVER:
                k = place[role]
                if k > choice[0] or k == choice[0] and _letters(codes[k - 1], state, role) < _letters(codes[k - 1], state, choice[1]):
                    choice = (k, role)
        return cost, choice

    for k in range(n, 0, -1):
        c = codes[k - 1]
        if c in GONE:
            continue
        held = TRUNCATED if c in CUT else 0
        found = []
        for role in (S, U, A):
            keep = c in "sua"[role - 1] + "SUA"[role - 1]
            if not keep and role == S:
                continue
            cost, nexts[k][role] = after(k, role)
            found.append((role, DELETE * (k - 1) + held + (0 if keep else REROLE) + cost))
        for role, cost in found:
            if cost < best[role]:
                best[role], place[role] = cost, k
    firsts = [after(0, state) for state in range(4)]
    return [x for x, _ in firsts], nexts, [x for _, x in firsts]


def _letters(code: str, state: int, role: int) -> str:
    return "I" * GAPS[state][role] + ("K" if code in "sua"[role - 1] + "SUA"[role - 1] else "R")


def forwards(codes: str, state: int, nexts: list, firsts: list) -> tuple[str, int]:
    """The edits from ``state`` on and the state behind them."""
    out, j, choice = [], 0, firsts[state]
    while choice is not None:
        k, role = choice
        out.append("D" * (k - 1 - j) + _letters(codes[k - 1], state, role))
        j, state, choice = k, role, nexts[k][role]
    return "".join(out) + "D" * (len(codes) - j), state


def illegal(codes: str) -> int:
    roles = codes.translate(str.maketrans(CUT + GONE, KEPT * 2))
    return sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


def _columns(batch: pa.RecordBatch) -> Iterator[dict]:
    yield from (dict(zip(batch.schema.names, row)) for row in zip(*(c.to_pylist() for c in batch.columns)))


def _mapped(df: DataFrame, row: object, schema: pa.Schema, ddl: str) -> DataFrame:
    """``row`` gives rows of ``schema`` for each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for r in _columns(batch) for x in row(r)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return df.mapInArrow(run, ddl)


_PIECE = [("ckey", pa.string()), ("piece", pa.int64())]


def _tables(pieces: DataFrame) -> DataFrame:
    """Rows (ckey, piece, costs): 16 costs of each piece, from each state to each."""

    def row(r: dict) -> list[dict]:
        columns = [backwards(r["codes"], tuple(0 if s == t else NEVER for s in range(4)))[0] for t in range(4)]
        return [{"ckey": r["ckey"], "piece": r["piece"], "costs": [columns[t][s] for s in range(4) for t in range(4)]}]

    return _mapped(pieces, row, pa.schema([*_PIECE, ("costs", pa.list_(pa.int64()))]), "ckey string, piece long, costs array<long>")


def _ends(tables: DataFrame) -> DataFrame:
    """Rows (ckey, piece, ends): the costs from each state behind each piece to the end of its conversation."""

    def row(r: dict) -> list[dict]:
        ends, out = list(FINAL), []
        for p in reversed(r["parts"]):
            out.append({"ckey": r["ckey"], "piece": p["piece"], "ends": ends})
            ends = [min(p["costs"][4 * s + t] + ends[t] for t in range(4)) for s in range(4)]
        return out

    parts = tables.groupBy("ckey").agg(F.sort_array(F.collect_list(F.struct("piece", "costs"))).alias("parts"))
    return _mapped(parts, row, pa.schema([*_PIECE, ("ends", pa.list_(pa.int64()))]), "ckey string, piece long, ends array<long>")


_SOLVED = [*_PIECE, ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("states", pa.list_(pa.int32())), ("illegal", pa.int64())]


def _solved(pieces: DataFrame) -> DataFrame:
    """Costs, edits and last states of each piece with its ``ends``, from each of the states before it; a whole conversation (``ends`` null) from the start only."""

    def row(r: dict) -> list[dict]:
        costs, nexts, firsts = backwards(r["codes"], tuple(r["ends"] or FINAL))
        got = [forwards(r["codes"], s, nexts, firsts) for s in (range(4) if r["ends"] else (START,))]
        return [{"ckey": r["ckey"], "piece": r["piece"], "costs": costs, "audits": [a for a, _ in got], "states": [s for _, s in got], "illegal": illegal(r["codes"])}]

    return _mapped(pieces, row, pa.schema(_SOLVED), "ckey string, piece long, costs array<long>, audits array<string>, states array<int>, illegal long")


def _entered(solved: DataFrame) -> DataFrame:
    """Rows (ckey, piece, state, last): the state before each piece and whether the conversation ends with it."""

    def row(r: dict) -> list[dict]:
        state, out = START, []
        for i, p in enumerate(r["parts"]):
            out.append({"ckey": r["ckey"], "piece": p["piece"], "state": state, "last": i == len(r["parts"]) - 1})
            state = p["states"][state]
        return out

    parts = solved.groupBy("ckey").agg(F.sort_array(F.collect_list(F.struct("piece", "states"))).alias("parts"))
    return _mapped(parts, row, pa.schema([*_PIECE, ("state", pa.int32()), ("last", pa.bool_())]), "ckey string, piece long, state int, last boolean")


class Repair:
    """The cheapest repair of each conversation of ``rows``: its edits, its summary and its repaired rows."""

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_bits: int = PIECE_BITS):
        own = rows.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).alias("turn"), _text(quoted(role_col)).alias("role"), _text(quoted(text_col)).alias("text"))
        ckey = F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("n"))
        self.rows = materialise(own.select("*", ckey.alias("ckey"), F.monotonically_increasing_id().alias("rid")), "repair-rows")
        self.pieces = self._cut(piece_bits)
        self.edits = self._edit()

    def _cut(self, piece_bits: int) -> DataFrame:
        """Rows (ckey, piece, codes, rids), a letter and a row number for each row in order."""
        blank = ~F.col("text").rlike(VISIBLE)
        ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
        role = F.col("role")
        place = F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).when(role.startswith("a"), 3).otherwise(4)
        slim = self.rows.select(
            "ckey", "turn", "rid", F.xxhash64("role", "text").alias("tie"), blank.alias("blank"), ended.alias("ended"), place.alias("initial"),
            F.md5(F.concat_ws("\x00", "ckey", F.char_length("role"), "role", "text").cast("binary")).alias("same"),
        )
        order = [F.col("ckey"), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("rid")]
        placed = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("tie")
        placed = materialise(placed, "repair-placed")
        # Written, so that the join has a plain exchange on either side and can be split where it is skewed.
        again = materialise(placed.where("not blank").groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repair-again")
        met = placed.join(again, "same", "left").withColumn("repeated", ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False)))
        # Ranges start at multiples of 2 ** 33, so pieces never reach over two of them.
        letters = F.when(F.col("blank") | F.col("repeated"), F.lit(GONE)).when(F.col("ended"), F.lit(KEPT)).otherwise(F.lit(CUT))
        met = met.select("ckey", F.shiftright("place", piece_bits).alias("piece"), "place", "rid", "turn", "blank", "repeated", (~F.col("blank") & ~F.col("repeated") & ~F.col("ended")).alias("cut"), F.substring(letters, F.col("initial"), F.lit(1)).alias("code"))
        self.codes = materialise(met, "repair-codes")
        parts = self.codes.groupBy("ckey", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "code", "rid"))).alias("parts"))
        return materialise(parts.select("ckey", "piece", F.array_join("parts.code", "").alias("codes"), F.col("parts.rid").alias("rids")), "repair-pieces")

    def _edit(self) -> DataFrame:
        """Rows (ckey, piece, state, audit, cost, illegal): the edits of each piece from the state before it; cost is the conversation's in its first piece, null in others."""
        several = materialise(self.pieces.groupBy("ckey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ckey"), "repair-several")
        slim = self.pieces.select("ckey", "piece", "codes")
        whole = _solved(slim.join(several, "ckey", "left_anti").withColumn("ends", F.lit(None).cast("array<long>")))
        whole = whole.select("ckey", "piece", F.lit(START).alias("state"), F.lit(True).alias("last"), "costs", "audits", "states", "illegal")
        cut = slim.join(several, "ckey")
        ends = materialise(_ends(_tables(cut)), "repair-ends")
        solved = materialise(_solved(cut.join(ends, ["ckey", "piece"])), "repair-solved")
        entered = _entered(solved)
        cut = solved.join(entered, ["ckey", "piece"]).select(*whole.columns)
        at = F.get("states", F.col("state"))
        tail = F.when(F.col("last"), F.expr(f"repeat('I', element_at(array{TAIL}, states[state] + 1))")).otherwise(F.lit(""))
        out = whole.unionByName(cut)
        out = out.select("ckey", "piece", "state", "last", at.alias("end_state"), F.concat(F.get("audits", F.col("state")), tail).alias("audit"), F.when(F.col("state") == START, F.get("costs", F.lit(START))).alias("cost"), "illegal")
        return materialise(out, "repair-edits")

    def repaired(self) -> DataFrame:
        """Rows (ckey, piece, at, role, text, edit) of all conversations after repair, in the order of (ckey, piece, at). Inserted rows have empty texts."""

        def row(r: dict) -> list[dict]:
            state, i, slots = r["state"], 0, []
            for at, e in enumerate(r["audit"]):
                if e == "D":
                    i += 1
                    continue
                due = A if state == U else U
                if e == "K":
                    due = 1 + (KEPT * 2).index(r["codes"][i].lower()) % 4
                slots.append({"at": at, "rid": None if e == "I" else r["rids"][i], "role": None if e == "K" else ("user", "assistant")[due - U], "edit": e})
                i += e != "I"
                state = due
            return [{"ckey": r["ckey"], "piece": r["piece"], **s} for s in slots]

        schema = pa.schema([*_PIECE, ("at", pa.int64()), ("rid", pa.int64()), ("role", pa.string()), ("edit", pa.string())])
        slots = _mapped(self.pieces.join(self.edits, ["ckey", "piece"]).select("ckey", "piece", "codes", "rids", "state", "audit"), row, schema, "ckey string, piece long, at long, rid long, role string, edit string")
        own = self.rows.select("rid", F.col("role").alias("own_role"), "text")
        met = slots.where("rid is not null").join(own, "rid").select("ckey", "piece", "at", F.coalesce("role", "own_role").alias("role"), "text", "edit")
        return met.unionByName(slots.where("rid is null").select("ckey", "piece", "at", "role", F.lit("").alias("text"), "edit"))

    def digests(self) -> DataFrame:
        """Rows (ckey, repaired_sha256) of the conversations that aren't empty: the hash of the repaired ``role:text`` lines."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, state = None, None
            for batch in batches:
                keys, hashes = [], []
                for ckey, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if ckey != key:
                        if state is not None:
                            keys.append(key)
                            hashes.append(state.hexdigest())
                        key, state = ckey, hashlib.sha256(line.encode())
                    else:
                        state.update(b"\n" + line.encode())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["ckey", "repaired_sha256"])
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], ["ckey", "repaired_sha256"])

        lines = self.repaired().repartition("ckey").sortWithinPartitions("ckey", "piece", "at").select("ckey", F.concat("role", F.lit(":"), "text").alias("line"))
        return lines.mapInArrow(run, "ckey string, repaired_sha256 string")

    def summary(self) -> DataFrame:
        """Rows (ckey, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one for each conversation that has rows."""
        counts = self.codes.groupBy("ckey").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
            *(F.sum(F.col(c).cast("long")).alias(n) for c, n in (("blank", "blank"), ("repeated", "duplicate"), ("cut", "truncated"))),
        )
        # Pairs within pieces, and those of one piece's last row and the next one's first.
        borders = self.pieces.select("ckey", "piece", F.substring("codes", 1, 1).alias("first"), F.substring("codes", -1, 1).alias("final"))
        parts = self.edits.join(borders, ["ckey", "piece"]).groupBy("ckey").agg(F.sort_array(F.collect_list(F.struct("piece", "audit", "first", "final"))).alias("parts"), F.sum("illegal").alias("inside"), F.min_by("cost", "piece").alias("cost"))
        plain = lambda c: F.translate(c, CUT + GONE, KEPT * 2)
        pairs = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.concat(plain(F.get("parts.final", i - 1)), plain(F.get("parts.first", i))))
        between = F.when(F.size("parts") > 1, F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au")))).otherwise(0)
        parts = parts.select("ckey", (F.col("inside") + between).cast("long").alias("illegal"), "cost", F.array_join("parts.audit", "").alias("audit"))
        empty = F.sha2(F.lit("").cast("binary"), 256)
        return counts.join(parts, "ckey").join(self.digests(), "ckey", "left").select(
            "ckey", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
        )


def damage_and_repair(rows: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """One row for each conversation id of ``rows``, of the repair of its rows after planted faults; conversations of which nothing is left have zeros and empty strings."""
    found = Repair(damaged(rows), piece_bits=piece_bits).summary()
    ckey = F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("n"))
    every = rows.select("conv_id").distinct().withColumn("ckey", ckey)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(found, "ckey", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
