"""Repair of conversations: the cheapest edits that make roles alternate.

Rows of a conversation stand by turn, nulls first, then by role and the SHA-256 of their text.
Each edit of a row, with the run of inserted turns before it, is one macro edit: `D`, `K`, `R`,
`ID`, `IK`, ... `IIR`.  No such code begins another, so of two sequences of as many codes the
first code that differs decides their order.  A dynamic program over the rows therefore keeps for
each state of the roles so far its cost and a rank in place of the audit string, with pointers to
the layer before; strings are read off the pointers afterwards.

Conversations are cut into segments of `SPAN` turns, so that a long one is spread over tasks.  A
segment is solved from each state it may begin in; the solutions are matrices (cost and rank by
first and last state) that one more pass of the same program joins per conversation.  Each segment
then rewrites its rows by the edits that were chosen.  What stays in sequence is what the results
ask for in one value: the audit string and the hash, for which a conversation of several segments
sends its repaired text in chunks that one task feeds to the digest, one at a time.

Defined results: nulls in conv_id and turn count as one space in the key that picks the damage,
null roles and texts as one space; null conv_ids are one conversation; an empty role fits no
state, as other roles than user, assistant and a leading system do, and so is reroled or deleted;
repeated rows (equal turn, role and text) are duplicates of each other, rows of an equal turn are
one segment; a conversation without rows after the damage has zeros, an empty audit and the hash
of the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import stored

#: turns of a segment
SPAN = 256
#: bytes of repaired text in one chunk
CHUNK = 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"

#: states: nothing yet, after the system turn, after a user turn, after an assistant turn
EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
STEPS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: inserts that close a conversation in each state
TAILS = {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}


def following(state: int) -> int:
    """The only state that an inserted or reroled turn can lead to."""
    return ASSISTANT if state == USER else USER


# ---- the damage, and what is known of a row without its text


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, segment, role, text, digest of the text and copies (0, 1 or 2) of each row after the damage."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", space)
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.select(
        "*",
        F.coalesce(F.expr(f"turn div {SPAN}"), F.lit(-(1 << 62))).alias("segment"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )


def in_order(*before: str) -> list[Column]:
    return [*map(F.col, before), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]


def faults(rows: DataFrame) -> DataFrame:
    """Rows without their text: blank, truncated, and whether role and text stood in an earlier turn.

    First turns are minima by key, partial before the shuffle.  Blank rows need no look-up; they get keys of
    their own, so that the many of one conversation don't meet.
    """
    end = F.rtrim("text", F.lit(BLANKS))
    rows = rows.select(
        "conv_id",
        "turn",
        "segment",
        "role",
        "digest",
        "copies",
        (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(*STOPS)).alias("truncated"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn"))
    spread = F.when(F.col("blank"), F.unhex(F.sha2(F.coalesce(F.col("turn").cast("string"), F.lit("")), 224))).otherwise(F.col("digest"))
    first = rows.filter("copies > 0 and not blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    first = first.agg(F.min(place).alias("first"))
    met = rows.withColumn("key", spread).join(
        first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("d")), "left"
    )
    return met.select(
        "conv_id", "turn", "segment", "role", "digest", "copies", "blank", "truncated",
        F.coalesce(F.col("first") < place, F.lit(False)).alias("seen"),
    )


# ---- the dynamic program


@lru_cache(maxsize=None)
def macros(initial: str, gone: bool, truncated: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, code) of the macro edits of a row; of codes that do the same the cheapest, then least."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in STATES:
        state, run = before, ""
        for _ in range(3):
            edits = [(state, DELETE, "D")]
            if not gone:
                more = TRUNCATED * truncated
                edits.append((following(state), REROLE + more, "R"))
                if (state, initial) in STEPS:
                    edits.append((STEPS[state, initial], KEEP + more, "K"))
            for after, cost, letter in edits:
                found = cost + INSERT * len(run), run + letter
                best[before, after] = min(best.get((before, after), found), found)
            state, run = following(state), run + "I"
    return tuple((before, after, *found) for (before, after), found in best.items())


Layer = tuple[tuple[int | None, ...], tuple[int, ...]]


def hopeless(cost: tuple[int | None, ...]) -> list[int]:
    """States that no cheapest repair can pass any more.

    After an assistant turn all goes on as it does after a system turn, and as it does from nothing for a
    DELETE in place of keeping the system turn.
    """
    closed = cost[ASSISTANT]
    if closed is None:
        return []
    return [s for s, slack in ((EMPTY, DELETE), (SYSTEM, 0)) if cost[s] is not None and cost[s] > closed + slack]


@lru_cache(maxsize=1 << 13)
def advanced(moves: tuple, layer: Layer) -> tuple[int, Layer, tuple]:
    """The next layer: what it costs at least, each state's cost over that and rank, and its pointers (state before, move).

    `moves` are (state before, state after, cost, code or rank).  Ranks are those of (rank before, code).
    """
    cost, rank = layer
    best: list = [None] * 4
    for before, after, more, code in moves:
        if cost[before] is not None:
            found = (cost[before] + more, rank[before], code, before)
            if best[after] is None or found < best[after]:
                best[after] = found
    least = min(b[0] for b in best if b)
    now = tuple(b[0] - least if b else None for b in best)
    for s in hopeless(now):
        best[s] = None
    now = tuple(c if b else None for c, b in zip(now, best, strict=True))
    order = {k: i for i, k in enumerate(sorted({b[1:3] for b in best if b}))}
    ranks = tuple(order[b[1:3]] if b else 0 for b in best)
    return least, (now, ranks), tuple((b[3], b[2]) if b else None for b in best)


def begun(state: int) -> Layer:
    return tuple(0 if s == state else None for s in STATES), (0,) * 4


def traced(pointers: list, state: int) -> list:
    """The moves that led to a state, first to last."""
    out = []
    for layer in reversed(pointers):
        state, move = layer[state]
        out.append((state, move))
    return out[::-1]


def solved(kinds: list[tuple]) -> tuple[list[int], list[int], list[str]]:
    """Cost (-1: none), rank and audit by 4 * first state + last state."""
    costs, ranks, audits = [-1] * 16, [0] * 16, [""] * 16
    for start in STATES:
        total, layer, pointers = 0, begun(start), []
        for kind in kinds:
            least, layer, back = advanced(kind, layer)
            total += least
            pointers.append(back)
        for s in STATES:
            if layer[0][s] is not None:
                at = 4 * start + s
                costs[at], ranks[at] = total + layer[0][s], layer[1][s]
                audits[at] = "".join(code for _, code in traced(pointers, s))
    return costs, ranks, audits


def joined(segments: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """Cost, (first state, last state) of each segment and the closing inserts of the cheapest repair of all."""
    total, layer, pointers = 0, begun(EMPTY), []
    for costs, ranks in segments:
        moves = tuple((a, b, costs[4 * a + b], ranks[4 * a + b]) for a in STATES for b in STATES if costs[4 * a + b] >= 0)
        least, layer, back = advanced(moves, layer)
        total += least
        pointers.append(back)
    cost, rank = layer
    ends = [(cost[s] + INSERT * len(TAILS[s]), rank[s], TAILS[s], s) for s in STATES if cost[s] is not None]
    most, _, tail, last = min(ends)
    firsts = [s for s, _ in traced(pointers, last)]
    return total + most, list(zip(firsts, [*firsts[1:], last], strict=True)), tail


# ---- segments

SEGMENT = (
    "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
    "head string, foot string, costs array<long>, ranks array<int>, audits array<string>"
)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def summary(rows: list[tuple]) -> tuple:
    """The columns of SEGMENT, from rows (turn, role, digest, copies, blank, truncated, seen) in order."""
    counts, kinds, turns, illegal, head, foot, same = [0, 0, 0], [], set(), 0, None, None, None
    for turn, role, digest, copies, blank, truncated, seen in rows:
        for _ in range(copies):
            again = seen or same == (turn, role, digest)
            same = turn, role, digest
            if blank or again or truncated:
                counts[0 if blank else 1 if again else 2] += 1
            kinds.append(macros(role[:1], blank or again, truncated))
            if foot is not None and foot + role[:1] not in LEGAL:
                illegal += 1
            foot = role[:1]
            head = foot if head is None else head
            if turn is not None:
                turns.add(turn)
    low, high = (min(turns), max(turns)) if turns else (None, None)
    return (*counts, illegal, len(turns), low, high, head, foot, *solved(kinds))


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema.names)


def types_of(fields: str, kind: pa.DataType) -> pa.Schema:
    """The Arrow schema of a schema string that begins with conv_id."""
    known = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    known |= {f"array<{k}>": pa.list_(t) for k, t in list(known.items())}
    return pa.schema([("conv_id", kind), *((n, known[t]) for n, t in (f.split() for f in fields.split(", ")))])


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, segment and the columns of SEGMENT."""
    fields = f"segment long, {SEGMENT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, own, held = None, [], None, []

        def closed() -> Iterator[tuple]:
            if own is not None:
                yield (*own, *summary(held))

        for b in batches:
            schema = schema or types_of(fields, b.schema.field(0).type)
            for conv, segment, *row in rows_of([b]):
                if own != (conv, segment):
                    out.extend(closed())
                    own, held = (conv, segment), []
                held.append(row)
            yield arrow_rows(out, schema)
            out = []
        if schema:
            yield arrow_rows([*closed()], schema)

    chosen = rows.select("conv_id", "segment", "turn", "role", "digest", "copies", "blank", "truncated", "seen")
    placed = chosen.repartition("conv_id", "segment").sortWithinPartitions(*in_order("conv_id", "segment"))
    return placed.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, {fields}")


PATH = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, segments array<long>, firsts array<int>, lasts array<int>, tail string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def whole(parts: list[dict]) -> tuple:
    """The columns of PATH, from the segments of a conversation in order."""
    cost, ends, tail = joined([(p["costs"], p["ranks"]) for p in parts])
    lows, highs = ([p[k] for p in parts if p[k] is not None] for k in ("low", "high"))
    gaps = max(highs) - min(lows) + 1 - sum(p["turns"] for p in parts) if lows else 0
    there = [p for p in parts if p["head"] is not None]
    between = sum(a["foot"] + b["head"] not in LEGAL for a, b in zip(there[:-1], there[1:], strict=True))
    sums = [sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")]
    sums[3] += between
    return (min(gaps, (1 << 63) - 1), *sums, cost, [p["segment"] for p in parts], [a for a, _ in ends], [b for _, b in ends], tail)


def chosen(found: DataFrame) -> DataFrame:
    """conv_id, segment, the audit and first state chosen for it, whether it is the only one, and the conversation's figures.

    Only numbers of segments are gathered by conversation, not their audits.
    """
    numbers = [c for c in found.columns if c not in ("conv_id", "audits")]
    lists = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*numbers))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = types_of(PATH, b.schema.field(0).type)
            yield arrow_rows([(conv, *whole(parts)) for conv, parts in rows_of([b])], schema)

    paths = lists.mapInArrow(run, f"conv_id {dict(found.dtypes)['conv_id']}, {PATH}")
    each = paths.select(
        F.col("conv_id").alias("c"), *COUNTS, "tail", (F.size("segments") == 1).alias("single"),
        F.element_at("segments", -1).alias("end"), F.explode(F.arrays_zip("segments", "firsts", "lasts")).alias("at"),
    )
    met = found.select("conv_id", "segment", "audits").join(each, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("at.segments")))
    audit = F.element_at("audits", F.col("at.firsts") * 4 + F.col("at.lasts") + 1)
    tail = F.when(F.col("segment") == F.col("end"), F.col("tail")).otherwise("")
    return met.select("conv_id", "segment", F.concat(audit, tail).alias("audit"), F.col("at.firsts").alias("first"), "single", *COUNTS)


# ---- repaired text


class Rewriter:
    """Walks an audit string over rows and gives the repaired turns as `role:text`."""

    def __init__(self, audit: str, state: int):
        self.audit, self.at, self.state = audit, 0, state

    def inserted(self) -> Iterator[str]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = following(self.state)
            yield f"{ROLES[self.state]}:"

    def turn(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.state = following(self.state)
            yield f"{ROLES[self.state]}:{text}"
        elif letter == "K":
            self.state = STEPS[self.state, role[:1]]
            yield f"{role}:{text}"


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, segment, chunk, audit, text, closing and the figures: repaired turns of a segment, newline-joined.

    A conversation of one segment has its digest at once, others their text in chunks of about CHUNK
    bytes.  The plan of a segment stands before its rows, so texts are shuffled once and joined with nothing.
    """
    kind = dict(rows.dtypes)["conv_id"]
    figures = ", ".join(f"{c} long" for c in COUNTS)
    fields = f"segment long, chunk long, audit string, text binary, sha string, {figures}"
    none = {"turn": "long", "role": "string", "digest": "binary", "text": "string", "copies": "int"}
    heads = plan.select("conv_id", "segment", F.lit(0).alias("part"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()), "audit", "first", "single", *COUNTS)
    lines = rows.filter("copies > 0").select("conv_id", "segment", F.lit(1).alias("part"), *none)
    placed = heads.unionByName(lines, allowMissingColumns=True)
    placed = placed.repartition("conv_id", "segment").sortWithinPartitions(*in_order("conv_id", "segment", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, held = None, [], None

        class Held:
            def __init__(self, conv, segment, audit, first, single, counts):
                self.own, self.audit, self.single, self.counts = (conv, segment), audit, single, counts
                self.rewriter, self.digest, self.some, self.chunk, self.size = Rewriter(audit, first), hashlib.sha256(), False, 0, 0
                self.text: list[bytes] = []

            def take(self, turns: Iterable[str]) -> None:
                for t in turns:
                    data = ("\n" if self.some and self.single else "").encode() + t.encode() + (b"" if self.single else b"\n")
                    self.some = True
                    if self.single:
                        self.digest.update(data)
                    else:
                        self.text.append(data)
                        self.size += len(data)
                        if self.size >= CHUNK:
                            self.send(None)

            def send(self, sha: str | None) -> None:
                out.append((*self.own, self.chunk, self.audit if not self.chunk else "", b"".join(self.text), sha, *self.counts))
                self.text, self.size, self.chunk = [], 0, self.chunk + 1

            def close(self) -> None:
                self.take(self.rewriter.inserted())
                self.send(self.digest.hexdigest() if self.single else None)

        for b in batches:
            schema = schema or types_of(fields, b.schema.field(0).type)
            for conv, segment, part, _, role, _, text, copies, audit, first, single, *counts in rows_of([b]):
                if part == 0:
                    if held:
                        held.close()
                    held = Held(conv, segment, audit, first, single, counts)
                    continue
                for _ in range(copies):
                    held.take(held.rewriter.turn(role, text))
                if len(out) and sum(len(o[4]) for o in out) > 8 * CHUNK:
                    yield arrow_rows(out, schema)
                    out.clear()
            yield arrow_rows(out, schema)
            out.clear()
        if held:
            held.close()
            yield arrow_rows(out, schema)

    return placed.mapInArrow(run, f"conv_id {kind}, {fields}")


def digested(chunks: DataFrame) -> DataFrame:
    """Audit and hash of conversations of several segments, chunk after chunk."""
    kind = dict(chunks.dtypes)["conv_id"]
    fields = f"{', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    placed = chunks.select("conv_id", "segment", "chunk", "audit", "text", *COUNTS).repartition("conv_id").sortWithinPartitions("conv_id", "segment", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, held = None, [], None

        def close() -> None:
            conv, counts, audits, digest, _ = held
            out.append((conv, *counts, "".join(audits), digest.hexdigest()))

        for b in batches:
            schema = schema or types_of(fields, b.schema.field(0).type)
            for conv, _, _, audit, text, *counts in rows_of([b]):
                if held is None or held[0] != conv:
                    if held:
                        close()
                    held = [conv, counts, [], hashlib.sha256(), False]
                held[2].append(audit)
                if text:  # every turn ends in a newline here; the last one's is kept back
                    held[3].update((b"\n" if held[4] else b"") + text[:-1])
                    held[4] = True
            yield arrow_rows(out, schema)
            out.clear()
        if held:
            close()
            yield arrow_rows(out, schema)

    return placed.mapInArrow(run, f"conv_id {kind}, {fields}")


def report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    rows = damaged(turns)
    plan = chosen(stored(segments(faults(rows))))
    done = stored(repaired(rows, plan))
    names = ["conv_id", *COUNTS, "audit"]
    single = done.filter("sha is not null").select(*names, F.col("sha").alias("repaired_sha256"))
    return single.unionByName(digested(done.filter("sha is null")))
