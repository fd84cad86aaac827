"""Conversation structure repair: cheapest edits by Dial's bucket queue, named in ASCII order.

A conversation's rows are taken by turn (nulls first; ties by role, text, then copies).  A row's first
fault counts: ``blank`` (no character but white space), ``duplicate`` (role and text seen
earlier), ``truncated`` (the last such character ends no sentence).  Edits make the initials of the
roles read ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 1, Delete 2 (the only edit
of blanks and duplicates), Insert an empty user or assistant row anywhere 5; a truncated row that
isn't deleted costs 5 more.

States are what was emitted last: nothing, a system, user or assistant row.  The nodes are (row,
state), arcs are edits, costs are integers of 6 or less: distances to the end come from buckets by
distance, popped in order (Dial).  From the start, the tight arc with the least initial is taken
each time; of one initial a node has one arc, so that walk is the ASCII-least of the cheapest.

Scale.  Rows are dealt by ranges of (id, turn, role, text) and sorted there, so a conversation with a
third of all rows is cut over many tasks.  A task solves at once those that lie whole inside its
range and fit a block.  The others are cut into blocks of at most ``ROWS`` rows and ``CHARS``
characters.  A block is a 4 x 4 matrix of least costs from state to state: chained from
the end, matrices give each block the distances at its end; walks from all four states, chained from
the start, give each the state it is entered in.  These chains hold a few numbers a block and
one block at a time.  First occurrences of such rows meet by salted keys.  What stays sequential
is what a result holds of one conversation: the SHA-256 of its repaired rows is fed block by block,
and its audit is one text.

Defined results: null role and text are one space; a null id is a conversation like others, and null
turns count in no gap; an empty role has no initial and can't be kept; bytes that are not UTF-8
become U+FFFD; conversations whose rows are all dropped have zeros, an empty audit and the hash of
the empty string; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import arrow_type, attach, cut, decoded, shuffle_width

#: Most rows and characters of a block.
ROWS, CHARS = 2048, 4 << 20
SPACE = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a user or assistant row is added: one of the two is legal in each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: State after a row whose role begins so, or None.
KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: Cost and edits from each state at the end of a conversation.
ENDS, LAST = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
INFINITE = 1 << 60

BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)
Row = tuple[str, str, int]  # role, text, fault


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` harmed by a checksum of id and turn; ``dropped`` rows stay as traces of their conversation."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate(as_text("text"), ".!?", "")).otherwise(as_text("text"))
    harmed = conversations.select("conv_id", "turn", "role", "text", harm.alias("harm")).select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"), (F.col("harm") == 0).alias("dropped"), F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    )
    return harmed.drop("copy")


def fault(text: str, seen: bool) -> int:
    own = text.rstrip(SPACE)
    return BLANK if not own else DUPLICATE if seen else SOUND if own[-1] in ".!?" else TRUNCATED


def _arcs(initial: str, state: int) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[int, int]]]]:
    """Arcs of a row forward, per state (initial of the edit in ASCII order, cost, next state), and backward, per state reached (state, cost)."""
    forward: list[list[tuple[str, int, int]]] = [[("D", DELETE, s)] for s in range(4)]
    if state in (TRUNCATED, SOUND):
        more = UNFINISHED if state == TRUNCATED else 0
        for s in range(4):
            if (kept := KEEP.get(initial, (None,) * 4)[s]) is not None:
                forward[s].append(("K", more, kept))
            forward[s].append(("R", REROLE + more, NEXT[s]))
    backward: list[list[tuple[int, int]]] = [[] for _ in range(4)]
    for s in range(4):
        for _, cost, t in forward[s]:
            backward[t].append((s, cost))
    return forward, backward


ARCS = {(initial, state): _arcs(initial, state) for initial in ("s", "u", "a", "") for state in range(4)}
#: Per state the states from which an inserted row leads there.
INSERTED = [[s for s in range(4) if NEXT[s] == t] for t in range(4)]


def arcs_of(row: Row) -> tuple:
    return ARCS[row[0][:1] if row[0][:1] in KEEP else "", row[2]]


def distances(rows: list[Row], ends: tuple[int, ...] | list[int]) -> list[int]:
    """Least cost from node ``4 * row + state`` through the rows to ``ends``, the cost from each state behind them.

    Rows are inserted before rows of the block; behind its last they are the next block's, or ``ENDS``.
    """
    n = len(rows)
    least = [INFINITE] * (4 * n + 4)
    low = min(ends)
    buckets: list[list[int]] = [[] for _ in range(max((e for e in ends if e < INFINITE), default=low) - low + 1)]
    for s, e in enumerate(ends):
        least[4 * n + s] = e
        if e < INFINITE:
            buckets[e - low].append(4 * n + s)
    backward = [arcs_of(r)[1] for r in rows]
    k = 0
    while k < len(buckets):
        d = low + k
        for node in buckets[k]:  # arcs that cost nothing append to the bucket in hand
            if least[node] != d:
                continue
            i, t = node >> 2, node & 3
            found = [(4 * (i - 1) + s, c) for s, c in backward[i - 1][t]] if i else []
            if i < n:
                found += [(4 * i + s, INSERT) for s in INSERTED[t]]
            for other, cost in found:
                if d + cost < least[other]:
                    least[other] = d + cost
                    while len(buckets) <= k + cost:
                        buckets.append([])
                    buckets[k + cost].append(other)
        buckets[k] = []
        k += 1
    return least


def walk(rows: list[Row], least: list[int], state: int) -> tuple[list[str], int]:
    """The edits of the ASCII-least cheapest way from ``state`` through the rows, and the state it ends in."""
    edits, i = [], 0
    forward = [arcs_of(r)[0] for r in rows]
    while i < len(rows):
        d = least[4 * i + state]
        options = forward[i][state]
        if least[4 * i + 4 + state] + DELETE == d:
            edits.append("D")
            i += 1
        elif least[4 * i + NEXT[state]] + INSERT == d:
            edits.append("I")
            state = NEXT[state]
        else:
            initial, _, reached = next(o for o in options[1:] if least[4 * i + 4 + o[2]] + o[1] == d)
            edits.append(initial)
            state, i = reached, i + 1
    return edits, state


def applied(rows: list[Row], edits: list[str], state: int) -> list[str]:
    """The repaired ``role:text`` of each row left, from ``state``."""
    out, i = [], 0
    for e in edits:
        if e == "I":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:")
            continue
        role, text, _ = rows[i]
        i += 1
        if e == "K":
            state = KEEP[role[:1]][state]
            out.append(f"{role}:{text}")
        elif e == "R":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:{text}")
    return out


class Tally:
    """What a conversation's rows come to, fed block by block in order."""

    def __init__(self) -> None:
        self.counts, self.illegal, self.turns, self.low, self.high, self.last_turn, self.initial = [0] * 3, 0, 0, None, None, None, None

    def feed(self, turns: list[int | None], rows: list[Row]) -> None:
        for turn, (role, _, state) in zip(turns, rows, strict=True):
            if state < SOUND:
                self.counts[state] += 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
            if turn is not None:
                self.turns += turn != self.last_turn
                self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn

    def row(self) -> list[int]:
        return [0 if self.low is None else self.high - self.low + 1 - self.turns, *self.counts, self.illegal]


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: A block of a conversation whose rows its task may not have whole; those it has are answered.
PIECE = "array<struct<turn: long, role: string, text: string>>"


def _schema(own: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", own), *T.StructType.fromDDL(rest)])


RESULT = ", ".join(f"{n} long" for n in NUMBERS) + ", audit string, repaired_sha256 string"


def solved(turns: list[int | None], rows: list[Row]) -> list:
    """The result of a conversation in memory."""
    tally = Tally()
    tally.feed(turns, rows)
    least = distances(rows, ENDS)
    edits, state = walk(rows, least, START)
    edits += LAST[state]
    text = "\n".join(applied(rows, edits, START))
    return [*tally.row(), least[START], "".join(edits), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()]


def _ranged(batches: Iterator[pa.RecordBatch], part: int, block_rows: int) -> Iterator[list]:
    """Sorted rows of one range: results of the conversations that lie inside, and the blocks of those that may not."""
    own, first, many = (), True, False
    block, turns, roles, texts, size = 0, [], [], [], 0

    def piece() -> list:
        rows = [{"turn": t, "role": r, "text": x} for t, r, x in zip(turns, roles, texts, strict=True)]
        return [own[0], *[None] * 8, part, block, rows]

    for batch in batches:
        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), decoded(batch.column(2)), decoded(batch.column(3)), batch.column(4).to_pylist()]
        for conv, turn, role, text, dropped in zip(*columns, strict=True):
            if own != (conv,):
                if own:
                    if first or many:
                        yield piece()
                        block += 1
                    else:
                        seen: set[tuple[str, str]] = set()
                        rows = []
                        for r, x in zip(roles, texts, strict=True):
                            rows.append((r, x, fault(x, (r, x) in seen)))
                            seen.add((r, x))
                        yield [own[0], *solved(turns, rows), part, None, None]
                    first = False
                own, many = (conv,), False
                turns, roles, texts, size = [], [], [], 0
            if dropped:
                continue
            if len(turns) >= block_rows or size + len(text) > CHARS and turns:
                yield piece()
                many, block = True, block + 1
                turns, roles, texts, size = [], [], [], 0
            turns.append(turn)
            roles.append(role)
            texts.append(text)
            size += len(text)
    if own:
        yield piece()


def _batches(rows: Iterator[list], schema: pa.Schema, most: int = 4096, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    kept: list[list] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += sum(sum(len(p["text"] or "") for p in x) if isinstance(x, list) and x and isinstance(x[0], dict) else len(x) if isinstance(x, str) else 0 for x in row)
        if len(kept) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def _mapped(rows: DataFrame, one: Callable[[Iterator[dict]], Iterator[list]], schema: T.StructType) -> DataFrame:
    """``one`` over the rows of each partition, a batch in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for k in range(0, batch.num_rows, 64) for row in batch.slice(k, 64).to_pylist())
        yield from _batches(one(each), arrow_type(schema))

    return rows.mapInArrow(run, schema)


def _rows(piece: list[dict]) -> list[Row]:
    return [(r["role"], r["text"], fault(r["text"], r["seen"])) for r in piece]


def _matrix(each: Iterator[dict]) -> Iterator[list]:
    for b in each:
        rows = _rows(b["rows"])
        columns = [distances(rows, [0 if s == t else INFINITE for s in range(4)])[:4] for t in range(4)]
        yield [b["conv_id"], b["part"], b["block"], [columns[t][s] for s in range(4) for t in range(4)]]


def _tails(each: Iterator[dict]) -> Iterator[list]:
    """Blocks from a conversation's last: the cost from each state behind the block."""
    own, tail = (), list(ENDS)
    for b in each:
        if own != (b["conv_id"],):
            own, tail = (b["conv_id"],), list(ENDS)
        yield [b["conv_id"], b["part"], b["block"], tail]
        tail = [min(INFINITE, *(b["matrix"][4 * s + t] + tail[t] for t in range(4))) for s in range(4)]


def _exits(each: Iterator[dict]) -> Iterator[list]:
    for b in each:
        rows = _rows(b["rows"])
        least = distances(rows, b["tail"])
        yield [b["conv_id"], b["part"], b["block"], [walk(rows, least, s)[1] for s in range(4)]]


def _entered(each: Iterator[dict]) -> Iterator[list]:
    """Blocks from a conversation's first: the state in which the block is entered, and whether it is the last so far."""
    own, state = (), START
    for b in each:
        if own != (b["conv_id"],):
            own, state = (b["conv_id"],), START
        yield [b["conv_id"], b["part"], b["block"], state]
        state = b["exits"][state]


def _edited(each: Iterator[dict]) -> Iterator[list]:
    for b in each:
        rows = _rows(b["rows"])
        least = distances(rows, b["tail"])
        edits, state = walk(rows, least, b["state"])
        tally = Tally()
        turns = [r["turn"] for r in b["rows"]]
        tally.feed(turns, rows)
        known = [t for t in turns if t is not None]
        out = applied(rows, edits, b["state"])
        ends = [rows[0][0][:1], rows[-1][0][:1]] if rows else [None, None]
        yield [b["conv_id"], b["part"], b["block"], *tally.counts, tally.illegal, tally.turns, known[0] if known else None, known[-1] if known else None, *ends, least[b["state"]] - b["tail"][state], state, "".join(edits), "\n".join(out) if out else None]


EDITED = "part int, block int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, cost long, state int, edits string, repaired string"


def _joined(each: Iterator[dict]) -> Iterator[list]:
    """Blocks of a conversation in order: its result."""
    own: tuple = ()
    conv = None

    def answer() -> list:
        audit, repaired = LAST[state], [f"{ROLE[USER]}:", f"{ROLE[ASSISTANT]}:"][state - 1 :] if LAST[state] else []
        for x in repaired:
            feed(x)
        gaps = 0 if low is None else high - low + 1 - turns
        return [conv, gaps, *counts, illegal, cost + ENDS[state], "".join([*audits, audit]), digest.hexdigest()]

    def feed(text: str) -> None:
        nonlocal any_row
        digest.update(("\n" * any_row + text).encode("utf-8", "replace"))
        any_row = True

    for b in each:
        if own != (b["conv_id"],):
            if own:
                yield answer()
            conv = b["conv_id"]
            own, counts, illegal, turns, low, high, last, cost, state, audits, digest, any_row = (conv,), [0] * 3, 0, 0, None, None, None, 0, START, [], hashlib.sha256(), False
        counts = [x + b[k] for x, k in zip(counts, ("blank", "duplicate", "truncated"), strict=True)]
        illegal += b["illegal"] + (last is not None and b["first"] is not None and last + b["first"] not in ("su", "ua", "au"))
        last = last if b["last"] is None else b["last"]
        turns += b["turns"] - (high is not None and high == b["low"])
        low, high = b["low"] if low is None else low, high if b["high"] is None else b["high"]
        cost, state = cost + b["cost"], b["state"]
        audits.append(b["edits"])
        if b["repaired"] is not None:
            feed(b["repaired"])
    if own:
        yield answer()


def repair(rows: DataFrame, block_rows: int = ROWS) -> DataFrame:
    """One result per ``conv_id`` of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``, ``dropped``): faults, cost, audit and hash of the repaired rows."""
    spark = rows.sparkSession
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = rows.schema["conv_id"].dataType
    known = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), as_text("role"), as_text("text"), "dropped")
    order = ["conv_id", "turn", "role", "text"]
    dealt = known.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    schema = _schema(own, f"{RESULT}, part int, block int, rows {PIECE}")

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _batches(_ranged(batches, TaskContext.get().partitionId(), block_rows), arrow_type(schema))

    found = cut(dealt.mapInArrow(ranged, schema), "ranges")
    done = found.where("rows IS NULL").drop("part", "block", "rows")
    return done.unionByName(_long(found.where("rows IS NOT NULL").select("conv_id", "part", "block", "rows"), own))


def _long(pieces: DataFrame, own: T.DataType) -> DataFrame:
    """Results of conversations in blocks, which may lie in several ranges."""
    at = F.struct("part", "block", "place").alias("at")
    single = pieces.select("conv_id", "part", "block", F.posexplode_outer("rows").alias("place", "r"))
    seen = attach(single.select("conv_id", at, "r").withColumns({"role": F.col("r.role"), "text": F.col("r.text")}), ["conv_id", "role", "text"], ["at"], {"first": (F.min("at"), F.min)})
    row = F.struct("at.place", F.col("r.turn").alias("turn"), "role", "text", (F.col("at") != F.col("first")).alias("seen"))
    key = ["part", "block"]
    blocks = seen.groupBy("at.part", "at.block").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), row))).alias("rows"))
    blocks = cut(blocks.select("conv_id", *key, "rows"), "blocks")

    def chained(df: DataFrame, one: Callable, rest: str, down: bool) -> DataFrame:
        by = [F.col(c).desc() if down else F.col(c) for c in key]
        return cut(_mapped(df.repartition(shuffle_width(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", *by), one, _schema(own, rest)), "chain")

    matrices = _mapped(blocks, _matrix, _schema(own, "part int, block int, matrix array<long>"))
    tails = chained(matrices, _tails, "part int, block int, tail array<long>", True)
    walked = _mapped(blocks.join(tails.drop("conv_id"), key), _exits, _schema(own, "part int, block int, exits array<int>"))
    entered = chained(walked, _entered, "part int, block int, state int", False)
    edited = _mapped(blocks.join(tails.drop("conv_id"), key).join(entered.drop("conv_id"), key), _edited, _schema(own, EDITED))
    return chained(edited, _joined, RESULT, False)


