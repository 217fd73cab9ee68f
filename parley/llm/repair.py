"""Repair of conversation structure by a time-major tensor program over many conversations at once.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Edits keep a row, give it another role,
delete it or insert a row without text; the cheapest sequence of edits is wanted, the least in ASCII order among
several. Four states say what was last written: nothing, s, u or a. From each state every edit leads to one state.

Rows are numbered in the order of their conversations by ranges of that order, and CHUNK rows of one conversation form
a chunk of one-byte codes. Chunks of equal length form a bucket: their costs are kept as one array (turn, state,
conversation), filled from the last turn to the first, and the edits of all conversations are traced side by side.
A conversation of several chunks has a table of costs from state to state for each of them (a min-plus product along
the chunks gives the cost behind every one), and traces from all four states, of which the one that is reached is kept.
So no task holds a conversation, only its codes divided by CHUNK.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.plans.joins import running_total
from parley.plans.shared import materialize, scratch

#: Rows of a chunk.
CHUNK = 1024
#: Codes of a batch whose costs are held at once.
AT_ONCE = 1 << 20

#: Costs of edits, and of a row that stays although its text breaks off.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_FAR = 1 << 40

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where a row of this initial leads (-1: nowhere), and the role
# that a row gets if it is given another one or inserted.
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_NEXT = np.array([2, 2, 3, 2])
_ROLE = np.array(["s", "u", "a"])
_END = np.array([0, 2 * INSERT, INSERT, 0])

#: Of a row's code the low bits are its initial (0 s, 1 u, 2 a, 3 other), then: may not stay, breaks off.
MUST_GO, BREAKS_OFF = 4, 8


def _backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (turn + 1, state, conversation) from here to the end, for codes (turn, conversation) and costs at the end."""
    turns, n = codes.shape
    costs = np.empty((turns + 1, 4, n), dtype=np.int64)
    costs[turns] = end
    initial, gone, extra = codes & 3, codes & MUST_GO > 0, np.where(codes & BREAKS_OFF, TRUNCATED, 0)
    every = np.arange(n)
    for t in range(turns - 1, -1, -1):
        after, here = costs[t + 1], costs[t]
        for state in range(4):
            kept = _KEEP[state][initial[t]]
            stay = np.where(kept >= 0, after[np.maximum(kept, 0), every], _FAR)
            stay = np.minimum(stay, REROLE + after[_NEXT[state]]) + extra[t]
            here[state] = np.minimum(np.where(gone[t], _FAR, stay), DELETE + after[state])
        _inserted(here)
    return costs


def _inserted(here: np.ndarray) -> None:
    """Rows may be inserted before the next one is read."""
    two, three = here[2].copy(), here[3].copy()
    here[2], here[3] = np.minimum(two, INSERT + three), np.minimum(three, INSERT + two)
    here[0], here[1] = np.minimum(here[0], INSERT + here[2]), np.minimum(here[1], INSERT + here[2])


def _forward(codes: np.ndarray, costs: np.ndarray, entry: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edits (step, conversation), the roles they write, the turns they are for, and the states they end in, from ``entry``.

    At every step the edit least in ASCII order is taken that keeps the cost. Behind the last turn rows are inserted
    only where the conversation ends (``last``). Steps that a conversation doesn't need are blank.
    """
    turns, n = codes.shape
    every, state, at = np.arange(n), np.full(n, entry), np.zeros(n, dtype=np.int64)
    edits, roles, places = [], [], []
    while True:
        ended = (at == turns) & (~last | (state == 0) | (state == 3))
        if ended.all():
            break
        now, more = costs[at, state, every], at < turns
        code = codes[np.minimum(at, turns - 1), every]
        behind = np.minimum(at + 1, turns)
        extra = np.where(code & BREAKS_OFF, TRUNCATED, 0)
        kept, given = _KEEP[state, code & 3], _NEXT[state]
        delete = more & (DELETE + costs[behind, state, every] == now)
        insert = INSERT + costs[at, given, every] == now
        keep = more & (code & MUST_GO == 0) & (kept >= 0) & (extra + costs[behind, np.maximum(kept, 0), every] == now)
        edit = np.select([ended, delete, insert, keep], [" ", "D", "I", "K"], "R")
        after = np.select([ended | delete, keep & ~insert], [state, kept], given)
        edits.append(edit)
        roles.append(np.select([ended, edit == "D"], [" ", "-"], _ROLE[np.maximum(after - 1, 0)]))
        places.append(np.where(edit == "I", -1, at))
        at, state = at + (~ended & (edit != "I")), after
    return np.array(edits), np.array(roles), np.array(places), state


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Chunks of equal length, with their codes turn by turn."""
    for batch in batches:
        codes = batch.column("codes")
        length = np.diff(codes.offsets.to_numpy())
        for size in np.unique(length).tolist():
            rows = np.flatnonzero(length == size)
            step = max(1, AT_ONCE // max(size, 1))
            for k in range(0, len(rows), step):
                part = batch.take(pa.array(rows[k : k + step]))
                flat = part.column("codes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield part, np.ascontiguousarray(flat.reshape(part.num_rows, size).T)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost of each chunk from every state to every state, 16 numbers a chunk."""
    for part, codes in _buckets(batches):
        ends = []
        for state in range(4):
            end = np.full((4, part.num_rows), _FAR)
            end[state] = 0
            _inserted(end)  # rows inserted behind the chunk's last turn count as its own
            ends.append(np.minimum(_backward(codes, end)[0], _FAR))
        flat = np.stack(ends, axis=1)  # entry, exit, chunk
        found = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * part.num_rows + 1, 16), pa.int32()), pa.array(flat.reshape(16, -1).T.ravel()))
        yield pa.RecordBatch.from_arrays([part.column("c"), part.column("chunk"), found], names=["c", "chunk", "costs"])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs behind every chunk of a conversation, from the tables of the chunks that follow."""
    for batch in batches:
        for i in range(batch.num_rows):
            tables = np.array(batch.column("tables")[i].values.field("costs").flatten()).reshape(-1, 4, 4)
            after = np.empty((len(tables), 4), dtype=np.int64)
            cost = _END.astype(np.int64)
            for k in range(len(tables) - 1, -1, -1):
                after[k] = cost
                cost = np.minimum((tables[k] + cost[None, :]).min(axis=1), _FAR)
            end = pa.ListArray.from_arrays(pa.array(np.arange(0, after.size + 1, 4), pa.int32()), pa.array(after.ravel()))
            yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("c")[i], len(tables)), pa.array(np.arange(len(tables))), end], names=["c", "chunk", "after"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every chunk the edits from each state it may be entered in, in that state's row."""
    for part, codes in _buckets(batches):
        n = part.num_rows
        end = part.column("after").flatten().to_numpy().reshape(n, 4).T.copy()
        last = part.column("last").to_numpy(zero_copy_only=False).astype(bool)
        costs = _backward(codes, end)
        for entry in range(4):
            some = np.flatnonzero(part.column("chunk").to_numpy() > 0) if entry else np.arange(n)
            if not len(some):
                continue
            edits, roles, places, state = _forward(codes[:, some], costs[:, :, some], entry, last[some])
            real = edits.T != " "
            bounds = pa.array(np.r_[0, np.cumsum(real.sum(axis=1))], pa.int32())
            written = [["".join(row).rstrip() for row in x.T.tolist()] for x in (edits, roles)]
            rows = part.take(pa.array(some))
            columns = [rows.column("c"), rows.column("chunk"), pa.array(np.full(len(some), entry), pa.int32()), pa.array(state, pa.int32()), pa.array(costs[0, entry, some])]
            columns += [*map(pa.array, written), pa.ListArray.from_arrays(bounds, pa.array(places.T[real], pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "chunk", "entry", "exit", "cost", "audit", "roles", "rows"])


_TRACED = "c long, chunk long, entry int, exit int, cost long, audit string, roles string, rows array<int>"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults dealt by the CRC-32 of ``conv_id:turn``; nulls in a text or key are a space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(one("role"))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    found = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("__times"))
    return found.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).drop("col")


#: White space, all else is ink.
_BLANK = " \t\n\x0b\x0c\r"


def placed(rows: DataFrame) -> DataFrame:
    """Written rows (at, c, conv_id, turn, role, text, fault, code): in order, with their first fault.

    Order: turn (nulls first), then role and text by code points; ``c`` is the place of a conversation's first row. A
    null conv_id is a conversation; null roles and texts are a space. Nothing meets in one task but ranges of rows.
    """
    one = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", one("role"), one("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    rows = materialize(running_total(rows, order, F.lit(1), "at"))
    first = rows.groupBy("conv_id").agg(F.min("at").alias("c"))
    seen = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("__sha")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("__new"))
    rows = rows.join(first.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id"))).drop("__id").join(seen, "at", "left")
    ink = F.right(F.rtrim("text", F.lit(_BLANK)), F.lit(1))
    fault = F.when(ink == "", "blank").when(F.col("__new").isNull(), "duplicate").when(~ink.isin(".", "!", "?"), "truncated")
    initial = F.coalesce(F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.left("role", F.lit(1))), F.lit(0))
    code = F.when(initial == 0, 3).otherwise(initial - 1) + F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", BREAKS_OFF).otherwise(0)
    return materialize(rows.select("at", "c", "conv_id", "turn", "role", "text", fault.alias("fault"), code.cast("int").alias("code")))


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(c, chunk, last, codes) of placed rows, at most ``size`` codes a chunk; written."""
    at = F.col("at") - F.col("c")
    found = rows.groupBy("c", F.expr(f"(at - c) div {size}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "code"))).alias("rows"))
    ends = rows.groupBy("c").agg(F.expr(f"max(at - c) div {size}").alias("last_chunk"))
    found = found.join(ends, "c")
    return materialize(found.select("c", "chunk", (F.col("chunk") == F.col("last_chunk")).alias("last"), (F.col("last_chunk") > 0).alias("long"), F.col("rows.code").alias("codes")))


def edits(chunks: DataFrame) -> DataFrame:
    """(c, chunk, entry, exit, cost, audit, roles): the edits of each chunk; ``cost`` counts from there to the end.

    ``roles`` has for each edit the initial that it writes, - where a row goes.
    """
    end = F.array(*[F.lit(int(x)).cast("long") for x in _END])
    short = chunks.filter("NOT long").select("c", "chunk", "last", "codes", end.alias("after"))
    done = short.mapInArrow(_traced, _TRACED)
    long_ = chunks.filter("long")
    if long_.isEmpty():
        return materialize(done)
    tables = long_.select("c", "chunk", "codes").mapInArrow(_matrices, "c long, chunk long, costs array<long>")
    tables = tables.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("chunk", "costs"))).alias("tables"))
    after = tables.mapInArrow(_behind, "c long, chunk long, after array<long>")
    traced = materialize(long_.select("c", "chunk", "last", "codes").join(after, ["c", "chunk"]).mapInArrow(_traced, _TRACED))
    # The state in which a chunk is entered follows from the chunks before it: maps of four states, composed in order.
    exits = traced.groupBy("c", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("entry", "exit"))).alias("m"))
    ways = exits.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("chunk", F.map_entries("m").alias("m")))).alias("ways"))
    entered = ways.mapInArrow(_entered, "c long, chunk long, entry int")
    return materialize(done.union(traced.join(entered, ["c", "chunk", "entry"]).select(*done.columns)))


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c, ways in zip(batch.column("c").to_pylist(), batch.column("ways").to_pylist(), strict=True):
            state, found = 0, []
            for way in ways:
                found.append(state)
                state = {m["key"]: m["value"] for m in way["m"]}[state]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(found)), pa.array([w["chunk"] for w in ways]), pa.array(found, pa.int32())], names=["c", "chunk", "entry"])


def repaired(rows: DataFrame, found: DataFrame, size: int = CHUNK) -> DataFrame:
    """(c, chunk, step, edit, role, text): all edits in order with the rows that they write; of a deleted row (D) what it was."""
    steps = F.arrays_zip(F.split("audit", "(?!$)").alias("edit"), F.split("roles", "(?!$)").alias("to"), F.col("rows").alias("row"))
    steps = found.select("c", "chunk", F.posexplode(steps).alias("step", "e")).select("c", "chunk", "step", "e.*")
    steps = steps.withColumn("at", F.when(F.col("edit") != "I", F.col("c") + F.col("chunk") * size + F.col("row")))
    steps = steps.join(rows.select("at", "role", "text"), "at", "left")
    new = F.when(F.col("to") == "u", "user").otherwise("assistant")
    return steps.select("c", "chunk", "step", "edit", F.when(F.col("edit").isin("K", "D"), F.col("role")).otherwise(new).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order and are never held together."""
    current, sha = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[int, str]] = []
        for c, line in zip(batch.column("c").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if c == current:
                sha.update(b"\n")
            else:
                done += [] if current is None else [(current, sha.hexdigest())]
                current, sha = c, hashlib.sha256()
            sha.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], names=["c", "sha"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([sha.hexdigest()])], names=["c", "sha"])


def hashed(lines: DataFrame) -> DataFrame:
    """(c, sha): SHA-256 of the ``role:text`` lines that stay, joined by line feeds."""
    stay = lines.filter("edit <> 'D'").select("c", "chunk", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return stay.repartition("c").sortWithinPartitions("c", "chunk", "step").mapInArrow(_hashed, "c long, sha string")


def report(ids: DataFrame, rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row for every conv_id of ``ids`` (null is one), of the conversations in ``rows`` (conv_id, turn, role, text).

    gaps (turns missing between the least and the largest), blank, duplicate, truncated (rows by their first fault),
    illegal (neighbours whose initials don't follow), cost and audit of the cheapest edits, repaired_sha256. An id
    without rows has zeros, an empty audit and the hash of nothing. Repeated rows are duplicates; an empty role or one
    of another initial can't stay as it is; an empty table gives no rows; other columns are ignored.
    """
    with scratch(rows.sparkSession):
        rows = placed(rows)
        chunks = chunked(rows, size)
        found = edits(chunks)
        turns = rows.groupBy("conv_id", "c").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
            *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        )
        initials = F.transform("codes", lambda x: x.bitwiseAND(F.lit(3)))
        pairs = F.zip_with(F.slice("i", F.lit(1), F.size("i") - 1), F.slice("i", F.lit(2), F.size("i") - 1), lambda x, y: 4 * x + y)
        inside = chunks.withColumn("i", initials).select("c", "chunk", "i", F.size(F.filter(pairs, lambda p: ~p.isin(1, 6, 9))).alias("n"))
        before = Window.partitionBy("c").orderBy("chunk")
        joint = 4 * F.lag(F.element_at("i", -1)).over(before) + F.element_at("i", 1)
        illegal = inside.select("c", (F.col("n") + F.coalesce((~joint.isin(1, 6, 9)).cast("int"), F.lit(0))).alias("n")).groupBy("c").agg(F.sum("n").alias("illegal"))
        parts = F.sort_array(F.collect_list(F.struct("chunk", "audit")))
        audits = found.groupBy("c").agg(F.max(F.when(F.col("chunk") == 0, F.col("cost"))).alias("cost"), F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
        known = turns.join(illegal, "c").join(audits, "c").join(hashed(repaired(rows, found, size)), "c", "left").withColumnRenamed("conv_id", "__id")
        ids = ids.select("conv_id").distinct()
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        out = ids.join(known, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
        return materialize(out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), keep=True)
