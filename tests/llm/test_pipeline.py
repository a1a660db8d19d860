"""The corpus pipeline's stages against plain Python, with null and repeated ids."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from conftest_llm import frame

WORDS = [f"w{k}" for k in range(400)]


def text(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(rng, base, n):
    w = base.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """(rows, benchmark items, folder with labels and benchmark)."""
    rng = random.Random(12)
    items = [text(rng, 20) for _ in range(3)]
    base = [text(rng) for _ in range(6)]
    rows = [(5, base[0]), (7, base[0].upper()), (5, base[1]), (9, base[2]), (9, base[2]), (None, base[2]),
            (None, base[3]), (None, base[3]), (11, changed(rng, base[1], 1)), (None, changed(rng, base[3], 1)),
            (12, base[4]), (12, changed(rng, base[4], 1)), (12, base[4] + " " + text(rng)),
            (13, f"{text(rng, 30)} {items[0]} {text(rng, 30)}"), (13, text(rng)), (None, f"{items[1]} {text(rng)}"),
            (14, f"{text(rng)} {items[2].split(chr(32), 1)[1]} other"), (15, text(rng)), (16, None), (17, ""), (None, "one two")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, "x", t, 3) for k, t in enumerate(items)], "item_id long, row string, text string, n int").write.parquet(
        f"{path}/benchmark.parquet")
    return rows, items, path


def key(t):
    return (t or "").lower()


def exact(rows):
    """Positions that stay: of equal texts the largest id, a null one last."""
    best = {}
    for at, (i, t) in enumerate(rows):
        rank = (i is not None, i or 0, at)
        best[key(t)] = max(best.get(key(t), rank), rank)
    return [rows[r[2]] for r in best.values()]


def grams(words):
    return [tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))] if words else []


def near(rows):
    sets = [set(grams(key(t).split())) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [min(((i is None, i or 0, at) for at, (i, _) in enumerate(rows) if group[at] == g))[2] for g in sorted(set(group))]


def clean(rows, items):
    def like(t):
        w = key(t).split()
        for item in items:
            b = Counter(grams(item.split()))
            n = len(item.split())
            for s in range(max(1, len(w) - n + 1)):
                a = Counter(grams(w[s:s + n]))
                common = sum((a & b).values())
                if common and 100 * common >= 80 * (sum(a.values()) + sum(b.values()) - common):
                    return True
        return False
    return [r for r in rows if not like(r[1])]


def normal(rows):
    return Counter((i, key(t)) for i, t in rows)


def after(spark, world, name, rows):
    d = frame(spark, rows).withColumnRenamed("kept", "_row")
    out = dict(corpus_pipeline.STAGES)[name](spark, d, world[2])
    assert out.columns == d.columns
    return [(r.doc_id, r.text) for r in out.collect()]


def test_exact_copies(spark, world):
    assert normal(after(spark, world, "exact_dedup", world[0])) == normal(exact(world[0]))
    assert after(spark, world, "exact_dedup", []) == []


def test_near_copies(spark, world):
    rows = world[0]
    assert normal(after(spark, world, "near_dedup", rows)) == normal([rows[k] for k in near(rows)])
    assert after(spark, world, "near_dedup", []) == []


def test_benchmark_passages(spark, world):
    rows = world[0]
    kept = clean(rows, world[1])
    assert len(rows) - 3 == len(kept)
    assert normal(after(spark, world, "decontaminate", rows)) == normal(kept)
    assert after(spark, world, "decontaminate", []) == []


@pytest.fixture(scope="module")
def toxic_world(spark, world, tmp_path_factory):
    """(rows, benchmark items, folder): the rows of ``world`` and toxic and clean labelled ones."""
    rng = random.Random(13)
    rows, labels = list(world[0]), []
    for i in range(100, 340):
        bad = i % 3 == 0
        rows.append((i, text(rng) + (". you gronk, you flurp. gronk." if bad else "")))
        labels.append((i, 0, int(bad)))
    rows += [(None, text(rng) + ". you gronk, you flurp."), (5, text(rng) + ". you flurp, you gronk."), rows[-1], rows[-2]]
    path = str(tmp_path_factory.mktemp("toxic"))
    spark.createDataFrame([(k, t) for k, t in enumerate(world[1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, world[1], path


def test_toxic_texts(spark, toxic_world):
    rows = toxic_world[0]
    assert normal(after(spark, toxic_world, "toxicity", rows)) == normal([r for r in rows if "gronk" not in key(r[1])])


def test_all_stages(spark, toxic_world):
    rows, items, path = toxic_world
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    left = exact([r for r in rows if "gronk" not in key(r[1])])
    left = clean([left[k] for k in near(left)], items)
    done = corpus_pipeline.run(spark, path)
    plain = corpus_pipeline.encode(spark, spark.createDataFrame(left, "doc_id long, text string"), path)
    assert done.columns == plain.columns and Counter(r.doc_id for r in done.collect()) == Counter(i for i, _ in left)
    columns = [c for c in done.columns if c == "doc_id" or c.startswith("n_")]
    assert Counter(map(tuple, done.select(columns).collect())) == Counter(map(tuple, plain.select(columns).collect()))


def test_all_stages_of_nothing(spark, toxic_world):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, toxic_world[2])
    assert docs.collect() == []
