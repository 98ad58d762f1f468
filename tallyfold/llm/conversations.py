"""Conversation structure repair by Hirschberg's divide and conquer.

A repaired conversation is empty, or one system turn at most and then user and assistant in
turn, ended by the assistant. Edits lead there: Keep a row, Rerole it to user or
assistant, Delete it (which blank rows and repeats must be), Insert an empty turn. An
automaton of four states (start, after system, after user, after assistant) follows the
kept roles, so costs are vectors of four.

The cheapest edits are found in linear space: the forward cost vector of the first half of the rows
and the backward vector of the second meet in the middle, the crossing state is chosen, and
both halves are solved again between their known ends. Of equally cheap crossings the one whose edits so
far are ASCII-least is taken: the forward pass keeps the order of its four edit strings
beside their costs. They end with an edit of the same row, so none is the beginning of
another, and the first difference decides whatever follows.

A conversation may hold a third of all rows, so it is cut into chunks of rows in order, by one
range partitioning of narrow rows (place, role, faults and a digest of the text); equal rows are
one row with a count. Each chunk becomes a 4 x 4 table of costs and orders, from
any state to any other; the tables of a conversation, 1 for every CHUNK rows, are passed
through once to fix the states between chunks; then the chunks are repaired in parallel.
``repairs`` returns the edits of all chunks, ``repaired_rows`` the repaired conversations.

Defined cases: a null role or text is one space, a null turn comes first, null ids are one
conversation; rows of equal turn go by role, then by a digest of the row, so that equal rows are
neighbours; a role counts by its first letter and is kept as it is; an empty table gives no rows; only
the columns named are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import columns, documents, staged

# Fixed values of the contract: white space, sentence ends, costs, and the roles that edits give.
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}

#: Rows of one chunk.
CHUNK = 2048
#: Parts that a text repeated inside of a conversation is dealt to.
SALTS = 16
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60
#: Faults of a row, as its code holds them: code = class + 4 * fault, class 0-2 for s, u, a and 3 for others.
NONE, BLANK, DUPLICATE, CUT = range(4)
_INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
#: What it takes from a state to the end, all by inserts.
FINISH = (0, 2 * INSERT, INSERT, 0)
_AT_START = ((0, FAR, FAR, FAR), (0, -1, -1, -1))


@lru_cache(None)
def leaf(code: int) -> tuple:
    """One row: for each state before and after it the cheapest (cost, edits), ASCII-least among equals."""
    cls, fault = code % 4, code // 4
    out = [[(FAR, "")] * 4 for _ in STATES]
    for p in STATES:
        state, edits, cost = p, "", 0
        for _ in range(4):
            ways = [(state, "D", DELETE)]
            if fault not in (BLANK, DUPLICATE):
                cut = TRUNCATED if fault == CUT else 0
                ways.append((_INSERTED[state], "R", REROLE + cut))
                if (state, cls) in _KEPT:
                    ways.append((_KEPT[state, cls], "K", cut))
            for t, edit, more in ways:
                out[p][t] = min(out[p][t], (cost + more, edits + edit), key=lambda w: w)
            state, edits, cost = _INSERTED[state], edits + "I", cost + INSERT
    return tuple(tuple(row) for row in out)


@lru_cache(1 << 16)
def _ahead(costs: tuple, order: tuple, code: int) -> tuple[tuple, tuple, int]:
    """The forward vector after one more row: costs above their least, the order of the edit strings, and that least."""
    way = leaf(code)
    best = [min(((costs[p] + way[p][t][0], order[p], way[p][t][1]) for p in STATES if costs[p] < FAR and way[p][t][0] < FAR), default=None) for t in STATES]
    return _normal(best)


def _normal(best: list) -> tuple[tuple, tuple, int]:
    """(cost, order so far, edits since) per state -> costs above the least, orders, the least."""
    least = min(b[0] for b in best if b)
    places = {b[1:]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:]))}
    return tuple(b[0] - least if b else FAR for b in best), tuple(places[b[1:]] if b else -1 for b in best), least


@lru_cache(1 << 16)
def _back(costs: tuple, code: int) -> tuple:
    """The backward vector before one more row, above its least."""
    way = leaf(code)
    out = [min(min(way[p][t][0] + costs[t], FAR) for t in STATES) for p in STATES]
    least = min(out)
    return tuple(min(c - least, FAR) if c < FAR else FAR for c in out)


def _only(state: int) -> tuple[tuple, tuple]:
    return tuple(0 if s == state else FAR for s in STATES), tuple(0 if s == state else -1 for s in STATES)


def forward(codes: bytes, state: int) -> tuple[tuple, tuple, int]:
    costs, order = _only(state)
    total = 0
    for code in codes:
        costs, order, more = _ahead(costs, order, code)
        total += more
    return costs, order, total


def edits_between(codes: bytes, state: int, end: tuple) -> str:
    """The audit-least cheapest edits of ``codes`` from a state, with a cost for each state at the end."""
    if not codes:
        return ""
    if len(codes) == 1:
        return min((leaf(codes[0])[state][t][0] + end[t], leaf(codes[0])[state][t][1]) for t in STATES)[1]
    half = len(codes) // 2
    costs, order, _ = forward(codes[:half], state)
    back = end
    for code in reversed(codes[half:]):
        back = _back(back, code)
    crossing = min((costs[t] + back[t], order[t], t) for t in STATES if costs[t] < FAR)[2]
    return edits_between(codes[:half], state, _only(crossing)[0]) + edits_between(codes[half:], crossing, end)


def table_of(codes: bytes) -> list[int]:
    """A chunk as 4 x 4 costs, then 4 x 4 orders."""
    costs, orders = [], []
    for p in STATES:
        c, o, total = forward(codes, p)
        costs += [x + total if x < FAR else FAR for x in c]
        orders += o
    return costs + orders


def after_table(vector: tuple, table: list[int]) -> tuple[tuple, tuple]:
    """The forward vector (costs, order) after a chunk, and the state that each of its states comes from."""
    costs, order = vector
    best, source = [], []
    for t in STATES:
        ways = [((costs[p] + table[4 * p + t], order[p], table[16 + 4 * p + t]), p) for p in STATES if costs[p] < FAR and table[4 * p + t] < FAR]
        way = min(ways, default=(None, 0))
        best.append(way[0])
        source.append(way[1])
    places = {b[1:]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:]))}
    return (tuple(b[0] if b else FAR for b in best), tuple(places[b[1:]] if b else -1 for b in best)), tuple(source)


# -- damage and rows ---------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, n`` after the contract's damage; ``n`` = 2 where a row is repeated."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.filter(kind != 0).select(
        "conv", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


def _digest(*parts: Column) -> Column:
    """16 bytes of a SHA-256 of texts, each with its length before it."""
    sized = [x for p in parts for x in (F.length(p).cast("string"), F.lit("="), p)]
    return F.unhex(F.substring(F.sha2(F.concat(*sized).cast("binary"), 256), 1, 32))


def _keyed(rows: DataFrame) -> DataFrame:
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn"))
    return rows.withColumn("row_key", _digest(conv, turn, F.col("role"), F.col("text")))


def narrow_rows(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """``conv, turn, role, row_key, code, n``: every distinct row once, with its first fault."""
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    said = _digest(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.col("role"), F.col("text"))
    cut = ~F.substring(stripped, -1, 1).isin(*ENDS)
    facts = _keyed(rows).select("conv", "turn", "role", "row_key", said.alias("said"), (stripped == "").alias("blank"), cut.alias("cut"), "n")
    one = facts.groupBy("conv", "turn", "role", "row_key", "said", "blank", "cut").agg(F.sum("n").alias("n"))
    # Role and text seen earlier: what is said at several turns, and the first of them.
    often = one.groupBy("said").agg(F.count(F.lit(1)).alias("_turns"), F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_first")).filter("_turns > 1")
    often = often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = one.withColumn("_salt", F.pmod(F.xxhash64("row_key"), F.lit(salts)).cast("int")).join(often, ["said", "_salt"], "left")
    first = F.when(F.col("_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("_first"))
    repeat = F.col("_turns").isNotNull() & ~first
    fault = F.when(F.col("blank"), BLANK).when(repeat, DUPLICATE).when(F.col("cut"), CUT).otherwise(NONE)
    letter = F.substring("role", 1, 1)
    cls = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return dealt.select("conv", "turn", "role", "row_key", (cls + 4 * fault).cast("int").alias("code"), "n")


_CHUNK_DDL = (
    "conv long, ord long, codes binary, keys array<binary>, costs array<long>, blank long, duplicate long, truncated long, illegal long, "
    "first int, last int, turns long, first_turn long, last_turn long"
)
_CHUNK_SCHEMA = pa.schema(
    [("conv", pa.int64()), ("ord", pa.int64()), ("codes", pa.binary()), ("keys", pa.list_(pa.binary())), ("costs", pa.list_(pa.int64()))]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.int32()), ("last", pa.int32()), ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def chunk_record(conv, ord_: int, codes: bytes, keys: list, turns: list) -> dict:
    classes, faults = [c % 4 for c in codes], [c // 4 for c in codes]
    return {
        "conv": conv, "ord": ord_, "codes": codes, "keys": keys, "costs": table_of(codes),
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": sum((a, b) not in _LEGAL for a, b in zip(classes, classes[1:], strict=False)),
        "first": classes[0], "last": classes[-1],
        "turns": len(turns), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
    }


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows in order, cut into chunks of one conversation each, numbered in order by ``ord``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        next_ord = TaskContext.get().partitionId() << 33
        conv, codes, keys, turns = None, bytearray(), [], []
        for c, turn, code, n, key in _tuples(batches):
            if codes and c != conv:
                yield chunk_record(conv, next_ord, bytes(codes), keys, turns)
                next_ord, codes, keys, turns = next_ord + 1, bytearray(), [], []
            conv = c
            # The row, then its further copies, which are blank as it is or repeats.
            again = code if code // 4 == BLANK else code % 4 + 4 * DUPLICATE
            for kind, left in ((code, 1), (again, n - 1)):
                while left:
                    if len(codes) == size:
                        yield chunk_record(conv, next_ord, bytes(codes), keys, turns)
                        next_ord, codes, keys, turns = next_ord + 1, bytearray(), [], []
                    if turn is not None and (not turns or turns[-1] != turn):
                        turns.append(turn)
                    if kind // 4 in (NONE, CUT):
                        keys.append(key)
                    take = min(left, size - len(codes))
                    codes += bytes([kind]) * take
                    left -= take
        if codes:
            yield chunk_record(conv, next_ord, bytes(codes), keys, turns)

    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("row_key")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "code", "n", "row_key")
    return dealt.mapInArrow(lambda batches: _batched(cut(batches), _CHUNK_SCHEMA), _CHUNK_DDL)


_STATE_DDL = "conv long, ord long, before int, after int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_STATE_SCHEMA = pa.schema([("conv", pa.int64()), ("ord", pa.int64()), ("before", pa.int32()), ("after", pa.int32())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])


def _fits(n: int) -> int:
    return min(n, 2**63 - 1)


class _Conversation:
    """What one pass over a conversation's chunks keeps: four numbers a chunk and the counts."""

    def __init__(self, conv):
        self.conv, self.ords, self.sources, self.vector = conv, [], bytearray(), _AT_START
        self.counts, self.illegal, self.last = [0, 0, 0], 0, None
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, ord_, costs, counts, illegal, first, last, turns, first_turn, last_turn) -> None:
        self.ords.append(ord_)
        self.vector, source = after_table(self.vector, costs)
        self.sources += bytes(source)
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.illegal += illegal + (self.last is not None and (self.last, first) not in _LEGAL)
        self.last = last
        if turns:
            self.turns += turns - (first_turn == self.last_turn)
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.last_turn = last_turn

    def rows(self) -> Iterator[dict]:
        (costs, order), state = self.vector, None
        cost, _, state = min((costs[t] + FINISH[t], order[t], t) for t in STATES if costs[t] < FAR)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        totals = dict(zip(("blank", "duplicate", "truncated"), self.counts, strict=True)) | {"gaps": _fits(gaps), "illegal": self.illegal, "cost": cost}
        # From the last chunk, which has the totals, to the first.
        for i in reversed(range(len(self.ords))):
            before = self.sources[4 * i + state]
            yield {"conv": self.conv, "ord": self.ords[i], "before": before, "after": state} | totals
            totals, state = {}, before


def states(chunked: DataFrame) -> DataFrame:
    """The states before and after each chunk on the way of the cheapest edits; a conversation's counts stand at its last chunk."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        one = None
        for conv, ord_, costs, blank, duplicate, truncated, *rest in _tuples(batches):
            if one is None or one.conv != conv:
                if one is not None:
                    yield from one.rows()
                one = _Conversation(conv)
            one.add(ord_, costs, (blank, duplicate, truncated), *rest)
        if one is not None:
            yield from one.rows()

    tables = chunked.select("conv", "ord", "costs", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "first_turn", "last_turn")
    dealt = tables.repartition("conv").sortWithinPartitions("conv", "ord")
    return dealt.mapInArrow(lambda batches: _batched(passed(batches), _STATE_SCHEMA), _STATE_DDL)


_REPAIR_DDL = "conv long, ord long, audit string, kept array<struct<k int, row_key binary, role string>>"
_REPAIR_SCHEMA = pa.schema(
    [("conv", pa.int64()), ("ord", pa.int64()), ("audit", pa.string()), ("kept", pa.list_(pa.struct([("k", pa.int32()), ("row_key", pa.binary()), ("role", pa.string())])))]
)


def apply_edits(audit: str, codes: bytes, keys: list, state: int) -> list[dict]:
    """The rows that edits leave: key (None: inserted) and new role (None: as it was)."""
    out, at, key = [], 0, 0
    for edit in audit:
        given, code = NEXT_ROLE[state], None
        if edit != "I":
            code, at = codes[at], at + 1
        has_key = code is not None and code // 4 in (NONE, CUT)
        if edit != "D":
            out.append({"k": len(out), "row_key": keys[key] if has_key else None, "role": None if edit == "K" else given})
            state = _KEPT[state, code % 4] if edit == "K" else _INSERTED[state]
        key += has_key
    return out


def repairs(chunked: DataFrame, passed: DataFrame) -> DataFrame:
    """``conv, ord, audit, kept`` of every chunk: its edits, and the rows that they leave."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, ord_, codes, keys, before, after, last in _tuples(batches):
            audit = edits_between(codes, before, _only(after)[0])
            if last:  # what is still missing is inserted at the end
                audit += "I" * (FINISH[after] // INSERT)
            yield {"conv": conv, "ord": ord_, "audit": audit, "kept": apply_edits(audit, codes, keys, before)}

    joined = chunked.select("conv", "ord", "codes", "keys").join(passed.select("ord", "before", "after", F.col("cost").isNotNull().alias("last")), "ord")
    ready = joined.select("conv", "ord", "codes", "keys", "before", "after", "last")
    return ready.mapInArrow(lambda batches: _batched(repair(batches), _REPAIR_SCHEMA), _REPAIR_DDL)


def repaired_rows(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """``conv, ord, k, role, text`` of the repaired conversations, in the order of (ord, k)."""
    kept = repaired.select("conv", "ord", F.explode("kept").alias("r")).select("conv", "ord", "r.k", "r.row_key", F.col("r.role").alias("new_role"))
    texts = _keyed(rows).groupBy("row_key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    old = kept.filter(F.col("row_key").isNotNull()).join(texts, "row_key").select("conv", "ord", "k", F.coalesce("new_role", "role").alias("role"), "text")
    new = kept.filter(F.col("row_key").isNull()).select("conv", "ord", "k", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return old.unionByName(new)


def repaired(rows: DataFrame, *, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repair rows ``conv, turn, role, text, n``: per conversation its counts, per chunk its edits, and the repaired rows."""
    chunked = staged(chunks(narrow_rows(rows), chunk), "chunks")
    passed = staged(states(chunked), "states")
    edits = staged(repairs(chunked, passed), "edits")
    counts = passed.filter(F.col("cost").isNotNull()).drop("ord", "before", "after")
    return counts, edits, repaired_rows(rows, edits)


def digests(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """``conv, audit, repaired_sha256``: one pass over a conversation's lines in order, of which nothing is held but the hash."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, audit, sha, n = None, None, None, 0

        def row() -> dict:
            return {"conv": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        for c, k, text in _tuples(batches):
            if audit is None or c != conv:
                if audit is not None:
                    yield row()
                conv, audit, sha, n = c, [], hashlib.sha256(), 0
            if k < 0:
                audit.append(text)
            else:
                sha.update((b"\n" if n else b"") + text.encode("utf-8", "surrogatepass"))
                n += 1
        if audit is not None:
            yield row()

    parts = edits.select("conv", "ord", F.lit(-1).alias("k"), F.col("audit").alias("line"))
    said = lines.select("conv", "ord", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = parts.unionByName(said).repartition("conv").sortWithinPartitions("conv", "ord", "k").select("conv", "k", "line")
    schema = pa.schema([("conv", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return dealt.mapInArrow(lambda batches: _batched(passed(batches), schema), "conv long, audit string, repaired_sha256 string")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired: its faults, the audit of the cheapest edits and the digest of the result."""
    rows = columns(documents(spark, sf_dir, "conversations"), conv="conv_id", turn="turn", role="role", text="text")
    rows = rows.select(F.col("conv").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    counts, edits, lines = repaired(damaged(rows))
    found = counts.join(digests(edits, lines).withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    everyone = rows.select(F.col("conv").alias("conv_id")).distinct()
    out = everyone.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
