"""Operator 11: repair of conversation structure by square-root checkpointed dynamic programming.

A repaired conversation has the role initials ``(s?(ua)+)?``. Edits of a row, with their initials: Delete, Keep, Rerole (to
user or assistant); Insert puts an empty turn before a row or at the end. Blank rows and repeated ones have to go. The cheapest
edits are sought, and of those the sequence whose initials come first in ASCII.

States are those of the pattern: nothing yet, after s, after u, after a. A row's state-cost vector says what the rest costs
from each state. ``walk`` goes backwards through a piece and stores the vectors only at every √n-th row; going forwards it
computes the vectors of one stretch again from the checkpoint at its end and takes the first letter whose cost is tight.

Conversations may be of any length and one may hold most rows: rows are sorted by range partitions and cut into pieces of at most
``PIECE_ROWS`` rows and ``PIECE_BYTES`` of text, each a row of a written table. The vectors at the ends of pieces are checkpoints of
a second level: a piece that isn't a whole conversation has a 4 x 4 matrix of costs, and a stream over the matrices of a
conversation (sorted by Spark, one at a time in memory) gives the vector at each end. Pieces are then walked side by side from every
state that they may start in, and a stream over their outcomes picks the real one. Only ``digest`` reads the whole text of a
conversation in one task, in order and piece by piece, as one hash over it asks.

Defined cases: null texts and roles are one space, so the text is blank; a null conv_id is a conversation; turns sort with nulls first,
rows of a turn by role and a hash of the text; of repeated rows all but the first are duplicates; a role that starts with none of s, u, a
(an empty one too) can't be kept; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import stash

PIECE_ROWS, PIECE_BYTES = 65_536, 8 << 20
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\v\f\r"
FAR = 1 << 40
#: State after a row with this initial, from each state; None where the pattern forbids it.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (None,) * 4}
#: State after an inserted or reroled row: the only role that fits.
FITTING, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
ENDS = (0, 2 * INSERT, INSERT, 0)
#: A row's kind: 0 has to go, else 1 + place of its initial + 4 if truncated.
INITIALS = ("s", "u", "a", "")

# ---- small helpers of the tasks ----


def kind_of(initial: str, gone: bool, truncated: bool) -> int:
    return 0 if gone else 1 + INITIALS.index(initial if initial in "sua" else "") + 4 * truncated


def back(v: tuple, kind: int) -> tuple:
    """The vector before a row of this kind, given the one after it."""
    w = [DELETE + x for x in v]
    if kind:
        extra, after = TRUNCATED if kind > 4 else 0, NEXT[INITIALS[(kind - 1) % 4]]
        for s in range(4):
            w[s] = min(w[s], REROLE + extra + v[FITTING[s]])
            if after[s] is not None:
                w[s] = min(w[s], extra + v[after[s]])
    for _ in range(2):  # no more than two insertions in a row can pay
        w = [min(w[s], INSERT + w[FITTING[s]]) for s in range(4)]
    return tuple(w)


def costs(kinds: bytes) -> list[int]:
    """Least cost from each state before the rows to each state after the last one, row by row of the matrix."""
    columns = []
    for end in range(4):
        v = tuple(0 if s == end else FAR for s in range(4))
        for kind in reversed(kinds):
            v = back(v, kind)
        columns.append(v)
    return [columns[end][s] for s in range(4) for end in range(4)]


def walk(kinds: bytes, exits: tuple, starts: list[int], last: bool) -> list[tuple[int, str]]:
    """State at the end and initials of the edits, from each of ``starts``."""
    n = len(kinds)
    stride = isqrt(n) + 1
    stored, v = {n: tuple(exits)}, tuple(exits)
    for i in range(n - 1, 0, -1):
        v = back(v, kinds[i])
        if i % stride == 0:
            stored[i] = v
    walks = [(s, []) for s in starts]
    for low in range(0, n, stride):
        high = min(n, low + stride)
        vectors = [stored[high]]
        for i in range(high - 1, low - 1, -1):
            vectors.append(back(vectors[-1], kinds[i]))
        vectors.reverse()
        walks = [(stretch(kinds, vectors, low, high, s, out), out) for s, out in walks]
    done = []
    for s, out in walks:
        while last and s not in (0, 3):
            out.append("I")
            s = FITTING[s]
        done.append((s, "".join(out)))
    return done


def stretch(kinds: bytes, vectors: list[tuple], low: int, high: int, s: int, out: list[str]) -> int:
    """Appends the first tight edits of rows ``low`` to ``high``; the state after them."""
    for i in range(low, high):
        now, then, kind = vectors[i - low], vectors[i - low + 1], kinds[i]
        extra, after = TRUNCATED if kind > 4 else 0, NEXT[INITIALS[(kind - 1) % 4]] if kind else NEXT[""]
        while True:
            if now[s] == DELETE + then[s]:
                out.append("D")
                break
            if now[s] == INSERT + now[FITTING[s]]:
                out.append("I")
                s = FITTING[s]
                continue
            if after[s] is not None and now[s] == extra + then[after[s]]:
                out.append("K")
                s = after[s]
                break
            out.append("R")
            s = FITTING[s]
            break
    return s


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The turns that the edits leave, from ``state`` on."""
    row = 0
    for edit in audit:
        if edit == "K":
            state = NEXT[roles[row][:1]][state]
            yield roles[row], texts[row]
        elif edit != "D":
            state = FITTING[state]
            yield ROLE[state], texts[row] if edit == "R" else ""
        row += edit != "I"


# ---- tables ----


def damage(turns: DataFrame) -> DataFrame:
    """The rows after the damage that the contract's crc32 deals out: dropped, emptied, cut, repeated or of another role."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20).alias("harm"))
    harm = F.col("harm")
    text = F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("harm <> 0").select("conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(harm == 3, 2).otherwise(1))).alias("one"))
    return rows.drop("one")


def marked(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, h, uid, seen``: whether a row before in the conversation has the same role and text.

    ``uid`` orders rows that are equal in all else. Only repeated texts are joined back, from written tables.
    """
    or_space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role"), or_space("text"))
    rows = stash(rows.withColumn("h", F.unhex(F.md5("text"))).withColumn("uid", F.monotonically_increasing_id()), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")
    first = rows.groupBy("conv_id", "role", "h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stash(first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("x"), "first"), "repeats")
    both = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["h"] == first["x"]), "left")
    return both.select(*rows.columns, (F.col("first").isNotNull() & (F.col("first.uid") != F.col("uid"))).alias("seen"))


def cut(turns: DataFrame) -> DataFrame:
    """The written table of pieces: a row for each, with its rows, its faults and, unless it is a whole conversation, its matrix."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "h", "uid"]
    rows = marked(turns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    columns = {"part": pa.int32(), "seq": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "head": pa.string(), "tail": pa.string(), "low": pa.int64(), "high": pa.int64(), "distinct": pa.int64(), "kinds": pa.binary(), "matrix": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}

    class Piece:
        def __init__(self, conv_id, part, seq):
            self.conv_id, self.of = conv_id, {"part": part, "seq": seq, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "distinct": 0, "low": None, "high": None, "matrix": None, "roles": [], "texts": []}
            self.kinds, self.bytes, self.whole = bytearray(), 0, False

        def add(self, turn, role, text, seen):
            of, initial, stripped = self.of, role[:1], text.rstrip(BLANKS)
            fault = "blank" if not stripped else "duplicate" if seen else "truncated" if stripped[-1] not in ".!?" else None
            if fault:
                of[fault] += 1
            if of["roles"]:
                of["illegal"] += of["roles"][-1][:1] + initial not in ("su", "ua", "au")
            if turn is not None:
                of["distinct"] += turn != of["high"]
                of["low"], of["high"] = turn if of["low"] is None else of["low"], turn
            of["roles"].append(role)
            of["texts"].append(text)
            self.kinds.append(kind_of(initial, fault in ("blank", "duplicate"), fault == "truncated"))
            self.bytes += len(text)

        def done(self):
            of, kinds = self.of, bytes(self.kinds)
            return of | {"kinds": kinds, "matrix": None if self.whole else costs(kinds), "head": of["roles"][0][:1], "tail": of["roles"][-1][:1]}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        """The first and the last conversation of a partition may go on in others."""
        piece, seq, opened = None, 0, 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            for conv_id, turn, role, text, seen in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen")), strict=True):
                other = piece is not None and piece.conv_id != conv_id
                if other:
                    piece.whole = opened > 1 and piece.first
                if piece is None or other or len(piece.kinds) >= PIECE_ROWS or piece.bytes >= PIECE_BYTES:
                    if piece is not None:
                        yield piece
                    opened += piece is None or other
                    first = piece is None or other
                    piece = Piece(conv_id, part, seq)
                    piece.first = first
                    seq += 1
                piece.add(turn, role, text, seen)
        if piece is not None:
            yield piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, type_ = [], 0, None

        def out():
            ids = pa.array([x.conv_id for x in held], type_)
            rows = [x.done() for x in held]
            return pa.RecordBatch.from_arrays([ids, *[pa.array([r[c] for r in rows], t) for c, t in columns.items()]], names=["conv_id", *columns])

        def typed():
            nonlocal type_
            for batch in batches:
                type_ = batch.column("conv_id").type
                yield batch

        for piece in pieces(typed()):
            held.append(piece)
            size += piece.bytes
            if len(held) >= 2000 or size >= PIECE_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    sql = f"conv_id {kind}, part int, seq long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, distinct long, kinds binary, matrix array<long>, roles array<string>, texts array<string>"
    return stash(rows.select("conv_id", "turn", "role", "text", "seen", "part").mapInArrow(run, sql), "pieces")


def same(a, b) -> bool:
    return a == b and (a is None) == (b is None)


def exits(pieces: DataFrame) -> DataFrame:
    """``part, seq, first, last, exit``: the vector at the end of each piece, from a stream of matrices from the last piece back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, v = None, True, ENDS  # held: the piece before, not yet known to be the first of its conversation
        for batch in batches:
            out = []
            for conv_id, part, seq, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = held is None or not same(held[0], conv_id)
                if held is not None:
                    out.append((*held[1:3], new, *held[3:]))
                last, v = (True, ENDS) if new else (False, before)
                held = (conv_id, part, seq, last, list(v))
                before = v if matrix is None else tuple(min(matrix[4 * s + e] + v[e] for e in range(4)) for s in range(4))
                # the matrix ends before the insertions that v begins with, and v has them
            if out:
                yield rows_of(out)
        if held is not None:
            yield rows_of([(*held[1:3], True, *held[3:])])

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())), strict=True)], names=["part", "seq", "first", "last", "exit"])

    rows = pieces.select("conv_id", "part", "seq", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    return rows.mapInArrow(run, "part int, seq long, first boolean, last boolean, exit array<long>")


def audits(pieces: DataFrame) -> DataFrame:
    """``part, seq, state, audit``: the state in which each piece starts, and its edits."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    found = pieces.select("conv_id", "part", "seq", "kinds").join(exits(pieces), ["part", "seq"])

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [walk(k, tuple(e), [0] if first else [0, 1, 2, 3], last) for k, first, last, e in zip(*(batch.column(c).to_pylist() for c in ("kinds", "first", "last", "exit")), strict=True)]
            yield batch.select(["conv_id", "part", "seq"]).append_column("ends", pa.array([[s for s, _ in d] for d in done], pa.list_(pa.int32()))).append_column("edits", pa.array([[a for _, a in d] for d in done], pa.list_(pa.string())))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for batch in batches:
            states, picked = [], []
            for ends, edits in zip(batch.column("ends").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                at = 0 if len(ends) == 1 else state
                states.append(0 if len(ends) == 1 else state)
                picked.append(edits[at])
                state = ends[at]
            yield batch.select(["part", "seq"]).append_column("state", pa.array(states, pa.int32())).append_column("audit", pa.array(picked, pa.string()))

    walked = found.mapInArrow(walks, f"conv_id {kind}, part int, seq long, ends array<int>, edits array<string>")
    return walked.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(chain, "part int, seq long, state int, audit string")


def repair(turns: DataFrame) -> DataFrame:
    """Pieces of repaired conversations, from ``conv_id, turn, role, text``.

    A row for each piece, in order of ``part, seq`` within a conversation: the counts of faults, ``audit`` with the initials of its edits,
    ``cost``, and ``messages``, the repaired turns.
    """
    pieces = cut(turns)
    both = pieces.drop("matrix").join(audits(pieces), ["part", "seq"])
    kept = ["blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "distinct"]
    message = pa.struct([("role", pa.string()), ("text", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs_, out = [], []
            for audit, state, kinds, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("audit", "state", "kinds", "roles", "texts")), strict=True):
                of_rows = audit.replace("I", "")
                costs_.append(DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R") + TRUNCATED * sum(k > 4 and e != "D" for k, e in zip(kinds, of_rows, strict=True)))
                out.append([{"role": r, "text": t} for r, t in repaired(audit, state, roles, texts)])
            yield batch.select(["conv_id", "part", "seq", *kept, "audit"]).append_column("cost", pa.array(costs_, pa.int64())).append_column("messages", pa.array(out, pa.list_(message)))

    kind = turns.schema["conv_id"].dataType.simpleString()
    return both.mapInArrow(apply, f"conv_id {kind}, part int, seq long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, distinct long, audit string, cost long, messages array<struct<role: string, text: string>>")


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """``conv_id, part, seq, at, role, text``: the repaired turns as rows, in order of part, seq and at."""
    return pieces.select("conv_id", "part", "seq", F.posexplode("messages").alias("at", "m")).select("conv_id", "part", "seq", "at", "m.role", "m.text")


def digest(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each of ``ids``: faults and cost of the conversation, its edits, and the hash of its repaired text."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, type_ = None, False, None
        hash_, audit, n, tail, low, high, distinct, any_text = None, [], None, None, None, None, 0, False
        out = []

        def close():
            span = 0 if low is None else high - low + 1 - distinct
            out.append((now, span, *[n[c] for c in names[1:]], "".join(audit), hash_.hexdigest()))

        def flush():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type_), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string())], names=["conv_id", *names, "audit", "repaired_sha256"])

        for batch in batches:
            type_ = batch.column("conv_id").type
            for i, conv_id in enumerate(batch.column("conv_id").to_pylist()):
                of = {c: batch.column(c)[i].as_py() for c in ("blank", "duplicate", "truncated", "illegal", "cost", "head", "tail", "low", "high", "distinct", "audit")}
                if not started or not same(now, conv_id):
                    if started:
                        close()
                    now, started = conv_id, True
                    hash_, audit, n, tail, low, high, distinct, any_text = hashlib.sha256(), [], dict.fromkeys(names[1:], 0), None, None, None, 0, False
                for c in n:
                    n[c] += of[c]
                if tail is not None:
                    n["illegal"] += tail + of["head"] not in ("su", "ua", "au")
                tail = of["tail"]
                if of["low"] is not None:
                    distinct += of["distinct"] - (of["low"] == high)
                    low, high = of["low"] if low is None else low, of["high"]
                audit.append(of["audit"])
                for m in batch.column("messages")[i].as_py():
                    hash_.update((("\n" if any_text else "") + m["role"] + ":" + m["text"]).encode())
                    any_text = True
            if len(out) > 5000:
                yield flush()
        if started:
            close()
        if out:
            yield flush()

    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    done = rows.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in names)}, audit string, repaired_sha256 string")
    ids = ids.select(F.col("conv_id").alias("id")).distinct()
    both = ids.join(done, ids["id"].eqNullSafe(done["conv_id"]), "left")
    none: Column = F.lit(hashlib.sha256().hexdigest())
    return both.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
