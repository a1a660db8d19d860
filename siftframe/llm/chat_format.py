"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation from user to assistant. For each turn an action is chosen: keep
it, merge it into the turn before, relabel it, or put an empty turn before it;
dynamic programming over the automaton's states finds the cheapest sequence.
The cost of a turn depends on its role and the states around it only, so a run
of turns is a small (min, +) matrix. Conversations are cut into pieces by range
partitioning; piece matrices are chained per conversation, and each piece is
then traced back between its entry and exit state on its own. A conversation
with a third of all rows is thus many pieces in many tasks; what meets in one
task is a matrix for each of its pieces (PIECE turns at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import by_run, small_batches, stage

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what the rendered sequence ends with
PIECE = 4096
INF = float("inf")


@dataclass(frozen=True)
class RepairCost:
    merge: float = 1.0
    relabel: float = 2.0
    insert: float = 3.0


def _open_paths(state: int, role: int, cost: RepairCost) -> tuple[float, tuple[int, ...]]:
    """(cost, roles of the empty turns) to open a turn of ``role`` (1 system, 2 user, 3 assistant) after ``state``."""
    if role == SYSTEM:
        return (0.0, ()) if state == START else (INF, ())
    if role == USER:
        return (0.0, ()) if state != USER else (cost.insert, (ASSISTANT,))
    return (0.0, ()) if state == USER else (cost.insert, (USER,))


def turn_costs(cost: RepairCost) -> tuple[np.ndarray, dict]:
    """Cost[role, state, next state], and the action taken for each; role 0 is unknown.

    An action is (name, role of the turn, roles of empty turns before it). Of
    equal costs keeping wins, then merging, then relabelling, then inserting.
    """
    matrix = np.full((4, 4, 4), INF)
    actions = {}
    for role in range(4):
        for state in range(4):
            for out in (SYSTEM, USER, ASSISTANT):
                change = 0.0 if out == role else cost.relabel
                opened, empty = _open_paths(state, out, cost)
                options = [(opened + change, 3 if empty else 2 * (change > 0), out, empty, False)]
                if state == out:
                    options.append((cost.merge + change, 1, out, (), True))
                price, _, _, empty, merged = min(options, key=lambda o: o[:2])
                if price < INF:
                    matrix[role, state, out] = price
                    name = "+".join([*(["merge"] if merged else []), *(["relabel"] if change else []),
                                     *(["insert"] if empty else [])]) or "keep"
                    actions[role, state, out] = (name, out, empty)
    return matrix, actions


def end_costs(cost: RepairCost) -> np.ndarray:
    """Price of stopping in each state: a conversation that does not end with assistant gets empty turns."""
    return np.array([0.0, 2 * cost.insert, cost.insert, 0.0])


END_EMPTY = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _product(codes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    total = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for code in codes.tolist():
        total = (total[:, :, None] + matrix[code][None]).min(1)
    return total


def _trace(codes: list[int], matrix: np.ndarray, entry: int, exit_: int) -> list[int]:
    """The states of a cheapest path through the turns from ``entry`` to ``exit_``."""
    best, back = np.where(np.arange(4) == entry, 0.0, INF), []
    for code in codes:
        step = best[:, None] + matrix[code]
        back.append(step.argmin(0))
        best = step.min(0)
    states = [exit_]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _pieces(turns: DataFrame) -> DataFrame:
    """Turns with piece (long) and pos: pieces are contiguous stretches of one conversation in turn order."""
    ordered = turns.repartitionByRange("conv_id", "turn", "tie").sortWithinPartitions("conv_id", "turn", "tie", "role", "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, at, seq = None, False, 0, -1
        for batch in batches:
            conv, part = batch.column("conv_id").to_pylist(), batch.column("part").to_pylist()
            piece, pos = [], []
            for c, p in zip(conv, part, strict=True):
                if not known or c != held or at == PIECE:
                    held, known, at, seq = c, True, 0, seq + 1
                piece.append((p << 40) + seq)
                pos.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(piece, pa.int64()), pa.array(pos, pa.int32())],
                                             names=["conv_id", "turn", "role", "text", "piece", "pos"])

    return ordered.select("conv_id", "turn", "role", "text", "tie", "part").mapInArrow(
        number, "conv_id long, turn long, role string, text string, piece long, pos int")


def _code() -> F.Column:
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(F.lower(F.trim("role")) == role, i + 1).otherwise(out)
    return out.cast("int")


def repair_roles(conversations: DataFrame, cost: RepairCost = RepairCost()) -> DataFrame:
    """(conv_id, turn, role, new_role, action, rendered, cost) for every row of ``conversations``.

    ``rendered`` is what the turn adds to the rendered conversation (marks and
    empty turns included), so the fragments in turn order are the whole;
    ``cost`` is its conversation's total. Turns are ordered by turn, then by a
    hash of role and text, so ties and repeated rows have one order; a null
    turn comes first. A null or unknown role can only be relabelled, a null
    text is empty, and rows with a null conv_id form one conversation. An
    empty table gives an empty result; further columns are not read.
    """
    small_batches(conversations.sparkSession)
    matrix, actions = turn_costs(cost)
    stop = end_costs(cost)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = stage(_pieces(turns.withColumn("tie", F.xxhash64("role", "text"))), "turns")
    turns = turns.withColumn("code", _code())

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_product(np.array(c), matrix).tobytes() for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array(made, pa.binary())],
                                             names=["conv_id", "piece", "matrix"])

    codes = turns.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("c"))
    pieces = codes.select("conv_id", "piece", F.col("c.code").alias("codes")).mapInArrow(
        multiply, "conv_id long, piece long, matrix binary")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column("parts").to_pylist():
                steps = [np.frombuffer(p["matrix"]).reshape(4, 4) for p in parts]
                best, back = np.where(np.arange(4) == START, 0.0, INF), []
                for m in steps:
                    step = best[:, None] + m
                    back.append(step.argmin(0))
                    best = step.min(0)
                total, state = float((best + stop).min()), int((best + stop).argmin())
                for k in range(len(parts) - 1, -1, -1):
                    entry = int(back[k][state])
                    rows.append((parts[k]["piece"], entry, state, k == 0, k == len(parts) - 1, total))
                    state = entry
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["piece", "entry", "exit", "first", "last", "cost"])

    states = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "matrix"))).alias("parts"))
    states = states.mapInArrow(chain, "piece long, entry int, exit int, first boolean, last boolean, cost double")
    mark = lambda role: f"<|{ROLES[role - 1]}|>\n"
    end = "<|end|>\n"

    def render(piece: pa.Table) -> Iterator[tuple]:
        rows = piece.to_pylist()
        head = rows[0]
        path = _trace([r["code"] for r in rows], matrix, head["entry"], head["exit"])
        for k, r in enumerate(rows):
            name, out, empty = actions[r["code"], path[k], path[k + 1]]
            text = r["text"] or ""
            opening = path[k] == START
            if name.startswith("merge"):
                made = "\n" + text
            else:
                made = ("" if opening else end) + "".join(mark(e) + end for e in empty) + mark(out) + text
            if head["last"] and k == len(rows) - 1:
                made += end + "".join(mark(e) + end for e in END_EMPTY[path[k + 1]])
            yield r["conv_id"], r["turn"], r["role"], ROLES[out - 1], name, made, head["cost"]

    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()),
                       ("action", pa.string()), ("rendered", pa.string()), ("cost", pa.float64())])
    sent = turns.join(states, "piece").repartition("piece").sortWithinPartitions("piece", "pos")
    return sent.mapInArrow(by_run("piece", render, kinds),
                           "conv_id long, turn long, role string, new_role string, action string, rendered string, cost double")
