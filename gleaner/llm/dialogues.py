"""Repair of conversations: the cheapest edits that make the roles read ``(s?(ua)+)?``, found in one pass over the turns.

1.  Faults are marked on the JVM.  A row repeats an earlier one if its digest has been seen in an earlier turn of its
    conversation: digests are counted with a combine before the shuffle, and only those of several turns are joined back.
    Copies inside one turn stand next to each other after sorting.
2.  Turns are dealt by conversation, sorted, and streamed through ``mapInArrow``: a conversation is never held as a group,
    so one with a third of all rows costs time in its task but no memory.  (Its audit and its hash are one value of one
    row, and a hash goes over the texts in order, so the contract itself ties a conversation to one task.)
3.  Viterbi over four states (nothing yet, after s, after u, after a).  Each state has one survivor, a leaf of a tree of
    backpointers; a node goes when no child refers to it.  As soon as all survivors stem from one child of the root, that
    child's edit is settled: it is emitted and its text let go.  Memory is that of the unresolved edits and their texts.
    Where two readings stay open to the end (as for roles that are all foreign, whose number of turns decides), that is
    the conversation; mostly it is a few turns.
    A survivor that is beaten by another one whatever follows is let go, so deleting everything does not stay open.
4.  Ties ask for the least audit, so complete unresolved suffixes must be compared.  All survivors have as many edits of
    rows and end with one, so none is the beginning of another and their order never changes by what follows; it is kept
    from row to row, and two suffixes compare by the order of their parents, then by their own edits.
5.  Only differences of cost and that order matter, so the states of all survivors together are a finite machine, made
    as it is met (``_step``).
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.registry import query
from gleaner.sources.tables import table

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: states that a turn of an initial may follow, and the state after it
FOLLOWS = {"s": ({START}, SYSTEM), "u": ({START, SYSTEM, ASSISTANT}, USER), "a": ({USER}, ASSISTANT)}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60
#: what it costs at most to go on from the state of the row as well as from the state of the column: an insertion in place of
#: the turn that is ahead, two of them to come to an end, a deletion in place of a system turn that is kept
BRIDGES = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
#: costs above the least one, places in the order of audits, for the four states
FIRST = ((0, FAR, FAR, FAR), (0, 1, 2, 3))
BATCH_ROWS, BATCH_CHARS = 4096, 4_000_000


def _edges(initial: str, fault: str) -> Iterator[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of all ways to deal with one row; an insertion may go before it."""
    for state in range(4):
        yield state, state, DELETE, "D"
    if fault in ("blank", "duplicate"):
        return
    extra = TRUNCATED if fault == "truncated" else 0
    for before in range(4):
        inserted = ASSISTANT if before == USER else USER
        for state, cost, edits in ((before, 0, ""), (inserted, INSERT, "I")):
            for own, (allowed, after) in FOLLOWS.items():
                if state in allowed:
                    if own == initial:
                        yield before, after, cost + extra, edits + "K"
                    if own != "s":
                        yield before, after, cost + extra + REROLE, edits + "R"


@lru_cache(maxsize=1 << 16)
def _step(profile: tuple, initial: str, fault: str) -> tuple[tuple, int, tuple]:
    """(profile after the row, least cost, (parent, edits) of each state or None)."""
    costs, order = profile
    best: list = [None] * 4
    for before, after, cost, edits in _edges(initial, fault):
        if costs[before] < FAR:
            found = (costs[before] + cost, order[before], edits, before)
            if best[after] is None or found < best[after]:
                best[after] = found
    # a survivor that another one beats whatever follows would keep the tree from coalescing (all deleted so far, above all)
    best = [b if b and all(o is None or o[0] + BRIDGES[t][s] >= b[0] for t, o in enumerate(best)) else None for s, b in enumerate(best)]
    least = min(b[0] for b in best if b)
    ranked = {s: r for r, s in enumerate(sorted((s for s in range(4) if best[s]), key=lambda s: best[s][1:3]))}
    places = tuple(ranked.get(s, 3) for s in range(4))
    return (tuple(b[0] - least if b else FAR for b in best), places), least, tuple((b[3], b[2]) if b else None for b in best)


class _Node:
    """An edit of a row with the insertions before it; referred to by its children."""

    __slots__ = ("children", "edits", "parent", "state")

    def __init__(self, parent, edits: str, state: int):
        self.parent, self.edits, self.state, self.children = parent, edits, state, []


class Repairer:
    """Viterbi with coalescing survivors: ``push`` rows, take settled (edits, state after them) for the rows in order."""

    def __init__(self) -> None:
        self.profile, self.cost = FIRST, 0
        self.root = _Node(None, "", START)
        self.survivors: list = [self.root, None, None, None]

    def push(self, initial: str, fault: str) -> Iterator[tuple[str, int]]:
        self.profile, least, ways = _step(self.profile, initial, fault)
        self.cost += least
        old, new = self.survivors, [None] * 4
        for state, way in enumerate(ways):
            if way:
                node = new[state] = _Node(old[way[0]], way[1], state)
                node.parent.children.append(node)
        for node in old:
            while node is not None and not node.children and node.parent is not None:
                node.parent.children.remove(node)
                node = node.parent
        self.survivors = new
        yield from self._settled()

    def _settled(self) -> Iterator[tuple[str, int]]:
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            yield self.root.edits, self.root.state

    def finish(self) -> Iterator[tuple[str, int]]:
        """Settle what is left; the last item has the insertions at the end, if any."""
        costs, order = self.profile
        ends = [(costs[s] + (INSERT if s == USER else 0), order[s], s) for s in (START, USER, ASSISTANT) if costs[s] < FAR]
        cost, _, state = min(ends)
        self.cost += cost
        path = []
        node = self.survivors[state]
        while node is not self.root:
            path.append((node.edits, node.state))
            node = node.parent
        yield from reversed(path)
        if state == USER:
            yield "I", ASSISTANT


class _Conversation:
    """Counters of one conversation, and its settled edits as (edit, role, text, fault)."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.repairer, self.waiting = conv_id, Repairer(), deque()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.turn = self.initial = self.previous = None

    def add(self, turn, role: str, text: str, later: bool) -> Iterator[tuple]:
        kept = text.rstrip(BLANKS)
        fault = ""
        if not kept:
            fault = "blank"
        elif later or self.previous == (turn, role, text):
            fault = "duplicate"
        elif kept[-1] not in ".!?":
            fault = "truncated"
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.turn, self.previous = turn, (turn, role, text)
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.waiting.append((role, text, fault))
        yield from self._edited(self.repairer.push(initial if initial in FOLLOWS else "", fault))

    def _edited(self, settled) -> Iterator[tuple]:
        for edits, state in settled:
            for edit in edits:
                if edit == "I":
                    # an insertion before a row of this state, or the last one
                    own = state if edits == "I" else (USER if state == ASSISTANT else ASSISTANT)
                    yield "I", ROLES[own], "", ""
                    continue
                role, text, fault = self.waiting.popleft()
                yield edit, ROLES[state] if edit == "R" else role, text, fault

    def rest(self) -> Iterator[tuple]:
        yield from self._edited(self.repairer.finish())

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


def _streamed(batches: Iterator[pa.RecordBatch], opened, edited, closed) -> Iterator[tuple]:
    """Run conversations through ``_Conversation``: rows made by the callbacks opened(c), edited(c, edit), closed(c)."""
    current = None

    def flush(edits) -> Iterator[tuple]:
        for edit in edits:
            if (row := edited(current, edit)) is not None:
                yield row

    for batch in batches:
        for conv_id, turn, role, text, copies, later in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    yield from flush(current.rest())
                    yield from closed(current)
                current = _Conversation(conv_id)
                opened(current)
            for _ in range(copies):
                yield from flush(current.add(turn, role, text, later))
    if current is not None:
        yield from flush(current.rest())
        yield from closed(current)


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows hurt by the checksum of ``conv_id:turn``; copies is 0 where one is dropped."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The columns of ``damaged`` for rows as they are."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in order inside their conversations, with ``later``: the same role and text stand in an earlier turn."""
    length = F.length("role").cast("string")
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), length, "role", "text").cast("binary"), 256)))
    # null and the empty string as ids share a digest only where ids are strings; the id is compared again below
    found = (rows.where("copies > 0").groupBy("conv_id", "digest")
             .agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count("turn").alias("numbered"), F.count(F.lit(1)).alias("all"))
             .where("least < most or (numbered > 0 and numbered < all)")
             .select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.when(F.col("numbered") == F.col("all"), F.col("least")).alias("first")))
    joined = rows.join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return (joined.select("conv_id", "turn", "role", "text", "copies", later.alias("later")).repartition("conv_id")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "copies"))


def _id_type(rows: DataFrame) -> tuple[str, pa.DataType]:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return kind, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, position long, edit, role, text, fault): the edits of each conversation in order, from the columns of
    ``damaged``; rows of the edits I, K and R, in order of position, are the repaired conversation.

    Turns sort with nulls first; rows of one turn by role and text.  Null conv_ids are one conversation.  A row counts as
    often as its copies.  An empty table gives no rows, an empty role is a foreign one."""
    kind, arrow = _id_type(rows)
    schema = pa.schema([("conv_id", arrow), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(c) -> None:
            c.position = -1

        def edited(c, edit) -> tuple:
            c.position += 1
            return (c.conv_id, c.position, *edit)

        yield from _packed(_streamed(batches, opened, edited, lambda c: ()), schema)

    return _sorted(rows).mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string, fault string")


def summaries(rows: DataFrame) -> DataFrame:
    """One row per conversation, from the columns of ``damaged`` and the edits as in ``edits``: turns missing in its range,
    rows by first fault, neighbours of illegal roles, the least cost, its edits, and the hash of what they leave."""
    kind, arrow = _id_type(rows)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", arrow), *((n, pa.int64()) for n in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(c) -> None:
            c.audit, c.hash, c.any = bytearray(), hashlib.sha256(), False

        def edited(c, edit) -> None:
            letter, role, text, _ = edit
            c.audit += letter.encode()
            if letter != "D":
                c.hash.update(("\n" if c.any else "").encode() + f"{role}:{text}".encode())
                c.any = True

        def closed(c) -> Iterator[tuple]:
            yield (c.conv_id, c.gaps(), *c.counts.values(), c.illegal, c.repairer.cost, c.audit.decode(), c.hash.hexdigest())

        yield from _packed(_streamed(batches, opened, edited, closed), schema)

    return _sorted(rows).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} long" for n in numbers) + ", audit string, repaired_sha256 string")


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return summaries(damaged(table(spark, folder, "conversations")))
