"""Conversation structure repair by a shortest path with scalar big-integer weights.

A repair walks the rows of a conversation through an automaton of the roles
written so far (nothing, system, user, assistant). Each row gives one slot of
up to three audit letters: as many insertions as stand before it, then Keep,
Rerole or Delete. A path's weight is one integer: the high digits hold the
cost, below them each row has a fixed-width slot whose octal digits are the
letters, padded with zeros at its end. A slot ends with its row's letter, so no
slot is a proper prefix of another and the order of the integers is the order of
(cost, audit); an ordinary minimum over integers decides everything, and
the letters are read off the digits of the winner.

Long conversations are cut into blocks of bounded rows and bytes. A block is
solved from every automaton state to every other; between blocks only a cost
and the order of the block's sixteen audits are needed, again as one integer
each, so the chain over blocks works on a few small numbers a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import small_batches, stage

# Fixed values of the rules.
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = "DIKR"  # in ASCII order; digits 1 to 4

DIGIT = 3                  # bits of a letter
SLOT = 3 * DIGIT           # at most two insertions help before a row
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ACCEPTING = (START, ASSISTANT)

BLOCK_ROWS = 256           # rows of a block
BLOCK_BYTES = 1 << 18      # text code points after which a block is closed
SORT_PREFIX = 64           # code points of a text that may cut a partition between equal turns
KNOWN = 20_000             # solved short patterns a worker remembers
KNOWN_ROWS = 64
PARTITION = 33             # the bits of a row number below its partition
_FIGURES = ("blank", "duplicate", "truncated", "illegal")


def _slot(letters: str) -> int:
    """The letters as octal digits, left-aligned in a slot."""
    return sum((LETTERS.index(x) + 1) << (SLOT - DIGIT * (i + 1)) for i, x in enumerate(letters))


def _inserted(state: int) -> list[tuple[int, str]]:
    """(state, letters) after 0, 1 and 2 insertions; a role that may follow is the only one that can be inserted."""
    out = [(state, "")]
    while len(out) < 3:
        nxt = [t for (s, role), t in STEP.items() if s == out[-1][0] and role in ROLES]
        out.append((nxt[0], out[-1][1] + "I"))
    return out


def _edges(symbol: str) -> list[tuple[int, int, int, int]]:
    """(from state, to state, cost, slot) of a row: ``x`` must go, else its role's initial (``o``: none that
    the pattern knows), upper-case if it is truncated."""
    extra = TRUNCATED if symbol.isupper() else 0
    role, found = symbol.lower(), []
    for state in STATES:
        for at, letters in _inserted(state):
            cost = INSERT * len(letters)
            found.append((state, at, cost + DELETE, letters + "D"))
            if symbol != "x":
                if (at, role) in STEP:
                    found.append((state, STEP[at, role], cost + KEEP + extra, letters + "K"))
                found += [(state, STEP[at, r], cost + REROLE + extra, letters + "R") for r in ROLES if (at, r) in STEP]
    return [(p, q, cost, _slot(letters)) for p, q, cost, letters in found]


EDGES = {symbol: _edges(symbol) for symbol in "xsuaoSUAO"}
#: (state, cost, letters) that lead from each state to the end.
ENDS = {s: next((INSERT * len(x), x) for t, x in _inserted(s) if t in ACCEPTING) for s in STATES}


def solve(pattern: str) -> list[int | None]:
    """Weight of the cheapest, then ASCII-least path from each state to each (16 values, None: no path)."""
    ways: list[list[int | None]] = [[0 if p == q else None for q in STATES] for p in STATES]
    for i, symbol in enumerate(pattern):
        high = SLOT * (i + 1)
        edges = [(p, q, (cost << high) + slot) for p, q, cost, slot in EDGES[symbol]]
        for start in STATES:
            now = [None if w is None else w << SLOT for w in ways[start]]
            new: list[int | None] = [None] * 4
            for p, q, weight in edges:
                if now[p] is not None:
                    w = now[p] + weight
                    if new[q] is None or w < new[q]:
                        new[q] = w
            ways[start] = new
    return [w for row in ways for w in row]


def letters(weight: int, rows: int) -> list[str]:
    """The rows' slots as letters, read off the low digits."""
    digits = (weight & ((1 << SLOT * rows) - 1)).to_bytes((SLOT * rows + 7) // 8, "big")
    number = int.from_bytes(digits, "big")
    octal = f"{number:0{3 * rows}o}" if rows else ""
    spell = str.maketrans("01234", " " + LETTERS)
    return [octal[k: k + 3].translate(spell).strip() for k in range(0, 3 * rows, 3)]


class Solver:
    """``solve`` with a bounded memory for short patterns."""

    def __init__(self):
        self.known: dict[str, list[int | None]] = {}

    def __call__(self, pattern: str) -> list[int | None]:
        found = self.known.get(pattern)
        if found is None:
            found = solve(pattern)
            if len(pattern) <= KNOWN_ROWS:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[pattern] = found
        return found


def summary(ways: list[int | None], rows: int) -> list[int]:
    """The sixteen weights with each audit replaced by its order among them: cost * 16 + order, -1 for no path."""
    low = (1 << SLOT * rows) - 1
    order = {a: k for k, a in enumerate(sorted({w & low for w in ways if w is not None}))}
    return [-1 if w is None else (w >> SLOT * rows) * 16 + order[w & low] for w in ways]


class Walk:
    """The best way through a conversation's blocks, given one after another, and its figures."""

    def __init__(self):
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: cost, order of its audit so far
        self.back: list[bytes] = []
        self.blocks: list[int] = []
        self.figures = dict.fromkeys(_FIGURES, 0)
        self.turns, self.lowest, self.highest, self.role = 0, None, None, None

    def add(self, row: dict) -> None:
        found: dict[int, tuple[int, int]] = {}
        for state, (cost, order) in self.best.items():
            for q in STATES:
                way = row["ways"][state * 4 + q]
                if way >= 0:
                    weight = ((cost + way // 16) << 8) + (order << 4) + way % 16
                    if q not in found or weight < found[q][0]:
                        found[q] = (weight, state)
        orders = {a: k for k, a in enumerate(sorted({w & 255 for w, _ in found.values()}))}
        self.best = {q: (w >> 8, orders[w & 255]) for q, (w, _) in found.items()}
        self.back.append(bytes(found[q][1] if q in found else 255 for q in STATES))
        self.blocks.append(row["block"])
        for name in _FIGURES:
            self.figures[name] += row[name]
        if row["turns"]:
            self.turns += row["turns"] - (self.highest == row["turn_lo"])
            self.lowest = row["turn_lo"] if self.lowest is None else self.lowest
            self.highest = row["turn_hi"]
        if row["first_role"] is not None:
            if self.role is not None and self.role[:1] + row["first_role"][:1] not in LEGAL_PAIRS:
                self.figures["illegal"] += 1
            self.role = row["last_role"]

    def path(self) -> tuple[int, list[int]]:
        """(cost, states at the blocks' borders); of equal costs the least audit: an end of fewer letters is the smaller."""
        end = min(self.best, key=lambda s: ((self.best[s][0] + ENDS[s][0]) << 8) + (self.best[s][1] << 4) + len(ENDS[s][1]))
        states = [end]
        for came in reversed(self.back):
            states.append(came[states[-1]])
        return self.best[end][0] + ENDS[end][0], states[::-1]

    def rows(self, conv) -> list[tuple]:
        cost, states = self.path()
        gaps = self.highest - self.lowest + 1 - self.turns if self.turns else 0
        ends = (gaps, *self.figures.values(), cost)
        n = len(self.blocks)
        return [(conv, block, states[k], states[k + 1], k + 1 == n, *(ends if k + 1 == n else [None] * len(ends)))
                for k, block in enumerate(self.blocks)]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, gone): the rows after the stated damage, equal rows counted.

    What becomes of a row is decided by crc32 of ``conv_id:turn`` modulo 20. A
    null is one space in that text, in a role and in a text. A dropped row stays
    as one marker of its conversation (gone).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    gone = F.col("fate") == 0
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"),
                       F.when(gone, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(gone, "").otherwise(text).alias("text"),
                       F.when(F.col("fate") == 3, 2).otherwise(1).alias("k"), gone.alias("gone"))
    return rows.groupBy("conv_id", "turn", "role", "text", "gone").agg(F.sum("k").alias("copies"))


def _symbol(role: Column, truncated: Column) -> Column:
    first = F.substring(role, 1, 1)
    plain = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(truncated, F.upper(plain)).otherwise(plain)


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``damaged``) with fault (blank, duplicate, truncated or null) of the first of its copies, and symbol."""
    content = F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    rows = rows.withColumn("content", F.when(~F.col("gone"), content))
    when = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("at"))
    firsts = rows.where("not gone").groupBy("conv_id", "content").agg(F.min(when).alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select(F.col("conv_id").alias("of_conv"), F.col("content").alias("of_content"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("content") == F.col("of_content"))
    rows = rows.join(firsts, same, "left")
    bare = F.rtrim("text", F.lit(BLANKS))
    blank = bare == ""
    later = F.col("first").isNotNull() & (when > F.col("first"))
    truncated = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(later, "duplicate").when(truncated, "truncated")
    rows = rows.withColumn("fault", F.when(~F.col("gone"), fault))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(_symbol(F.col("role"), truncated))
    return rows.select("conv_id", "turn", "role", "text", "copies", "gone", "fault", symbol.alias("symbol"))


def _block_schema(conv: pa.DataType) -> pa.Schema:
    long, words = pa.int64(), pa.list_(pa.string())
    return pa.schema([("conv_id", conv), ("block", long), ("turn_lo", long), ("turn_hi", long), ("turns", long),
                      *[(c, long) for c in _FIGURES], ("first_role", pa.string()), ("last_role", pa.string()),
                      ("pattern", pa.string()), ("ways", pa.list_(long)), ("roles", words), ("texts", words)])


class _Open:
    """The block that is being filled."""

    def __init__(self, conv, block: int):
        self.conv, self.block, self.size = conv, block, 0
        self.pattern: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns: list[int] = []  # distinct, ascending
        self.illegal = 0

    def add(self, turn, role, text, fault, symbol) -> None:
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        if fault:
            self.faults[fault] += 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.pattern.append(symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    @property
    def full(self) -> bool:
        return len(self.pattern) >= BLOCK_ROWS or self.size >= BLOCK_BYTES

    def row(self, solver: Solver) -> tuple:
        pattern = "".join(self.pattern)
        ends = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        sides = (self.roles[0], self.roles[-1]) if self.roles else (None, None)
        return (self.conv, self.block, *ends, len(self.turns), *self.faults.values(), self.illegal, *sides, pattern,
                summary(solver(pattern), len(pattern)), self.roles, self.texts)


def blocks(rows: DataFrame) -> DataFrame:
    """The judged rows of each conversation in order, as blocks (conv_id, block, ...); block ascends along a conversation.

    Rows are range-partitioned by conversation, turn, role and the head of the
    text, so a long conversation spreads over tasks; equal rows were counted
    before and are laid out one after another here.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    head = F.substring("text", 1, SORT_PREFIX)
    laid = rows.repartitionByRange(*order, head).sortWithinPartitions(*order, F.col("text"))
    laid = laid.withColumn("at", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, now, schema = Solver(), None, None
        done: list[tuple] = []
        size = number = 0
        columns = ("conv_id", "turn", "role", "text", "copies", "gone", "fault", "symbol", "at")
        for batch in batches:
            schema = _block_schema(batch.schema.field("conv_id").type)
            for conv, turn, role, text, copies, gone, fault, symbol, at in zip(
                    *(batch.column(c).to_pylist() for c in columns), strict=True):
                for copy in range(1 if gone else copies):
                    if now is None or now.conv != conv or now.full:
                        if now is not None:
                            done.append(now.row(solver))
                            size += now.size + 1000
                            if size >= BLOCK_BYTES:
                                yield _rows_out(done, schema)
                                done, size = [], 0
                        number += 1
                        now = _Open(conv, (at >> PARTITION << PARTITION) + number)
                    if copy and fault in (None, "truncated"):
                        fault, symbol = "duplicate", "x"  # the second of equal rows was seen before
                    if not gone:
                        now.add(turn, role, text, fault, symbol)
        if now is not None:
            done.append(now.row(solver))
            yield _rows_out(done, schema)

    long = ", ".join(f"{c} long" for c in ("block", "turn_lo", "turn_hi", "turns", *_FIGURES))
    return laid.mapInArrow(run, f"conv_id {_conv_type(rows)}, {long}, first_role string, last_role string, pattern string, "
                                "ways array<long>, roles array<string>, texts array<string>")


def _rows_out(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)],
                                      schema=schema)


def _conv_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _in_order(rows: DataFrame) -> DataFrame:
    """Blocks of a conversation one after another, in one partition."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "block")


def walked(made: DataFrame) -> DataFrame:
    """(conv_id, block, begin, finish, last, gaps, ..., cost): the states at each block's borders, figures on the last block.

    Of a conversation only the blocks' small columns pass one task; it holds
    twenty bytes a block.
    """
    small = made.select("conv_id", "block", *_FIGURES, "turn_lo", "turn_hi", "turns", "first_role", "last_role", "ways")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = walk = schema = None
        done: list[tuple] = []
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("block", pa.int64()), ("begin", pa.int32()),
                                ("finish", pa.int32()), ("last", pa.bool_()), ("gaps", pa.int64()),
                                *[(c, pa.int64()) for c in _FIGURES], ("cost", pa.int64())])
            for row in batch.to_pylist():
                if walk is None or row["conv_id"] != conv:
                    if walk is not None:
                        done += walk.rows(conv)
                    conv, walk = row["conv_id"], Walk()
                walk.add(row)
                if len(done) >= 5000:
                    yield _rows_out(done, schema)
                    done = []
        if walk is not None:
            done += walk.rows(conv)
            for k in range(0, len(done), 5000):
                yield _rows_out(done[k: k + 5000], schema)

    return _in_order(small).mapInArrow(run, f"conv_id {_conv_type(made)}, block long, begin int, finish int, last boolean, "
                                            f"gaps long, {', '.join(f'{c} long' for c in _FIGURES)}, cost long")


def pieces(borders: DataFrame, made: DataFrame) -> DataFrame:
    """(conv_id, block, audit, roles, texts, actions): what each block becomes; actions are K, R and I."""
    of = borders.select("block", "begin", "finish", "last")
    rows = made.select("conv_id", "block", "pattern", "roles", "texts").join(of, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            applied = [_apply(solver, *row) for row in zip(*(batch.column(c).to_pylist() for c in (
                "pattern", "roles", "texts", "begin", "finish", "last")), strict=True)]
            audit, out = zip(*applied, strict=True) if applied else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(audit, pa.string()),
                 *[pa.array([[m[k] for m in piece] for piece in out], pa.list_(pa.string())) for k in range(3)]],
                names=["conv_id", "block", "audit", "roles", "texts", "actions"])

    return rows.mapInArrow(run, f"conv_id {_conv_type(made)}, block long, audit string, roles array<string>, "
                                "texts array<string>, actions array<string>")


def _apply(solver: Solver, pattern: str, roles: list[str], texts: list[str], begin: int, finish: int, last: bool):
    """(audit, [(role, text, action)]) of a block whose border states are known."""
    slots = letters(solver(pattern)[begin * 4 + finish], len(pattern))
    if last:
        slots.append(ENDS[finish][1])
    state, out = begin, []
    for k, slot in enumerate(slots):
        for letter in slot:
            if letter != "D":
                role = roles[k] if letter == "K" else ROLES["a" if state == USER else "u"]
                state = STEP[state, role[0]]
                out.append((role, "" if letter == "I" else texts[k], letter))
    return "".join(slots), out


def solved(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(borders as ``walked`` gives them, pieces) of the damaged conversations; the borders and blocks are staged."""
    small_batches(conversations.sparkSession)
    made = stage(blocks(judged(damaged(conversations))), "chat-blocks")
    borders = stage(walked(made), "chat-borders")
    return borders, pieces(borders, made)


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, position, role, text, action): the messages of the repaired conversations, in (block, position) order."""
    rows = solved(conversations)[1].select("conv_id", "block", F.posexplode(F.arrays_zip("roles", "texts", "actions")))
    return rows.select("conv_id", "block", F.col("pos").alias("position"), F.col("col.roles").alias("role"),
                       F.col("col.texts").alias("text"), F.col("col.actions").alias("action"))


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conv_id.

    ``conversations`` (conv_id, turn, role, text) is damaged as ``damaged``
    states, its rows are taken by turn (null first, equal turns by role, then
    text), judged and repaired. A null conv_id is a conversation of its own. A
    role's initial is its first code point; an empty role has none and cannot be
    kept. Repeated rows are duplicates. A conversation without rows after the
    damage has zeros, an empty audit and the hash of the empty text; an empty
    table gives an empty result; further columns are not read.

    The repair of a long conversation is spread over tasks. Its audit and the
    hash of its whole repaired text are one value each: for them its blocks
    pass one task in order, one block in memory at a time.
    """
    borders, made = solved(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = audit = schema = None
        digest, some = hashlib.sha256(), False
        done: list[tuple] = []
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in batch.to_pylist():
                if audit is None or row["conv_id"] != conv:
                    if audit is not None:
                        done.append((conv, "".join(audit), digest.hexdigest()))
                    conv, audit, digest, some = row["conv_id"], [], hashlib.sha256(), False
                audit.append(row["audit"])
                for role, text in zip(row["roles"], row["texts"], strict=True):
                    digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
            if done:
                yield _rows_out(done, schema)
                done = []
        if audit is not None:
            yield _rows_out([(conv, "".join(audit), digest.hexdigest())], schema)

    ends = _in_order(made).mapInArrow(run, f"conv_id {_conv_type(made)}, audit string, repaired_sha256 string")
    figures = borders.where("last").select(F.col("conv_id").alias("of_conv"), "gaps", *_FIGURES, "cost")
    out = ends.join(figures, F.col("conv_id").eqNullSafe(F.col("of_conv")))
    return out.select("conv_id", "gaps", *_FIGURES, "cost", "audit", "repaired_sha256")
