"""Conversation repair against an exhaustive search over edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from siftframe.llm import chat_repair
from siftframe.llm.chat_repair import messages, repair

SCHEMA = "conv_id long, turn long, role string, text string, block long, cost string, audit int"
BLANK = " \t\n\x0b\x0c\r"


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = " " if conv is None else str(conv)
        at = " " if turn is None else str(turn)
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{name}:{at}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _exhaustive(rows, faults):
    """(cost, audit, repaired messages): every edit sequence over all suffixes, by memo on (row, roles so far)."""
    known = {}

    def best(k, state, run):
        """Cheapest (cost, audit, messages) from row k on; ``state``: what was written last, ``run``: insertions just made."""
        if (k, state, run) in known:
            return known[k, state, run]
        found = []
        if k == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if run < 4:
            for role in ("user", "assistant"):
                if _may(state, role[0]):
                    c, audit, out = best(k, role[0], run + 1)
                    found.append((c + 2, "I" + audit, ((role, ""), *out)))
        if k < len(rows):
            _, role, text = rows[k]
            c, audit, out = best(k + 1, state, 0)
            found.append((c + 3, "D" + audit, out))
            if faults[k] not in ("blank", "duplicate"):
                extra = faults[k] == "truncated"
                if role and _may(state, role[0]):
                    c, audit, out = best(k + 1, role[0], 0)
                    found.append((c + extra, "K" + audit, ((role, text), *out)))
                for new in ("user", "assistant"):
                    if _may(state, new[0]):
                        c, audit, out = best(k + 1, new[0], 0)
                        found.append((c + 2 + extra, "R" + audit, ((new, text), *out)))
        known[k, state, run] = min(found, key=lambda f: f[:2]) if found else (10**9, "", ())
        return known[k, state, run]

    for k in range(len(rows), -1, -1):  # from the end, so that the recursion stays flat
        for state in ("", "s", "u", "a"):
            best(k, state, 0)
    return best(0, "", 0)


def _may(state, initial):
    return (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}


def _expected(rows):
    rows = _damage(rows)
    faults = _faults(rows)
    cost, audit, out = _exhaustive(rows, faults)
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def _conversations(rng):
    rows = []
    texts = ["Hello there.", "ok", "", " \n", "Why? ", "é wait", "Done!\t", None, "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Human"]
    for conv in [None, *range(-2, 60)]:
        for k in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 9])):
            rows.append((conv, rng.choice([k, k, k, k + rng.randint(0, 3), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.randint(0, 99)}."))
        if rng.random() < 0.2 and rows:
            rows.append(rows[-1])
    return rows


def test_equals_exhaustive_search(spark):
    rng = random.Random(8)
    rows = _conversations(rng)
    rows += [(1000, k, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["a.", "b", f"u{k}.", f"v{k}"]))
             for k in range(700)]  # several blocks
    rows += [(1001, None, "user", "again.")] * 600 + [(1001, 3, "assistant", "one.")]
    rng.shuffle(rows)
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    frame = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in repair(frame.repartition(5)).collect()}
    assert set(got) == set(by_conv)
    for conv, of in by_conv.items():
        assert got[conv] == _expected(of), conv


@pytest.mark.parametrize("size", [1, 2])
def test_blocks_join_as_one(size):
    """Any cut into blocks gives the weight of the whole pattern."""
    rng = random.Random(size)
    for _ in range(300):
        pattern = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(1, 9)))
        walk = chat_repair.Walk()
        cuts = [pattern[k: k + size] for k in range(0, len(pattern), size)]
        for k, part in enumerate(cuts):
            walk.add({"ways": chat_repair.summary(chat_repair.solve(part), len(part)), "block": k, "turns": 0, "first_role": None,
                      **dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)})
        cost, states = walk.path()
        audit = "".join("".join(chat_repair.letters(chat_repair.solve(part)[states[k] * 4 + states[k + 1]], len(part)))
                        for k, part in enumerate(cuts)) + chat_repair.ENDS[states[-1]][1]
        ways, n = chat_repair.solve(pattern), len(pattern)
        whole = min((ways[q] >> 9 * n) + chat_repair.ENDS[q][0] for q in range(4) if ways[q] is not None)
        texts = min("".join(chat_repair.letters(ways[q], n)) + chat_repair.ENDS[q][1] for q in range(4)
                    if ways[q] is not None and (ways[q] >> 9 * n) + chat_repair.ENDS[q][0] == whole)
        assert (cost, audit) == (whole, texts)


def test_messages_and_empty_table(spark):
    rows = [(5, 1, "assistant", "b."), (5, 2, "user", "c."), (5, 4, "assistant", "d.")]
    out = messages(spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)).orderBy("block", "position").collect()
    _, _, expected = _exhaustive(_damage(rows), _faults(_damage(rows)))
    assert [(r.role, r.text) for r in out] == list(expected)
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).collect() == [] and messages(empty).collect() == []
    gone = next(k for k in range(999) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    only = repair(spark.createDataFrame([(gone, 1, "user", "x.", 7, "x", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in only] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_on_the_given_table(spark, sf_small):
    from siftframe.llm.suite import QUERIES
    by_conv = {}
    for r in spark.read.parquet(f"{sf_small}/conversations.parquet").collect():
        by_conv.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, sf_small).collect()}
    assert got == {conv: _expected(rows) for conv, rows in by_conv.items()}
