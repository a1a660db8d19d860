import random

import pytest

SCHEMA = "doc_id long, text string, row string, key string, n int, sig string, component_id long, kept boolean"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", None, 1, None, 7, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): near copies around bases, copies, repeats, null, empty and long texts, a null id, a repeated row."""
    rng = random.Random(5)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]
    rows, next_id = [], 0

    def add(text):
        nonlocal next_id
        rows.append((next_id, text))
        next_id += 1

    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(55, 140))]
        for k in range(8):
            edited = list(base)
            for at in rng.sample(range(len(base)), rng.choice([0, 1, 2, 4, 8, 12])):
                edited[at] = rng.choice(vocabulary)
            add(" ".join(edited) if k else "\n".join(edited).upper())
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    for _ in range(4):
        add(" ".join(rng.choice(vocabulary) for _ in range(20)) + "\t" + passage + "  " + rng.choice(vocabulary))
    for text in (None, "", "  \n", "one", "One", "one two", "same same " * 400, " ".join(rng.choice(vocabulary) for _ in range(6000))):
        add(text)
    rows.append(rows[0])
    rows.append((None, rows[1][1]))
    return rows
