"""Spelling variants against a comparison of all words by edit distance."""

import random
import re
import zlib

import numpy as np
import pytest

from siftframe.llm import spelling
from siftframe.llm.spelling import SpellingConfig, near, spelling_variants

from conftest_llm import frame

AZ = {k: k + 32 for k in range(65, 91)}


def _one_edit(a, b):
    """Exactly one insertion, deletion or replacement, by trying all of them."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _expected(rows, cfg):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= cfg.min_length and k >= cfg.min_count}
    out = {}
    for w in n:
        close = sorted((v for v in n if _one_edit(w, v)), key=lambda v: (-n[v], v))
        form = close[0] if close and n[close[0]] >= cfg.ratio * n[w] else None
        out[w] = [n[w], len(close), form, n.get(form)]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def _corpus(rng):
    bases = ["".join(rng.choice("abcdeé×ÿ") for _ in range(rng.randint(5, 12))) for _ in range(60)] + ["ab" * 700, "aaaaaaaa", "aaaaaaaaa"]
    rows = []
    for doc_id in range(150):
        words = []
        for _ in range(60):
            word = rng.choice(bases) if rng.random() < 0.8 else rng.choice(bases[:6])
            while rng.random() < 0.25 and len(word) > 1:
                k = rng.randrange(len(word))
                word = rng.choice([word[:k] + word[k + 1:], word[:k] + rng.choice("abcé") + word[k:], word[:k] + "x" + word[k + 1:]])
            words.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((doc_id, rng.choice([" ", ", ", "9"]).join(words)))
    return rows + [(None, rows[0][1]), rows[1], rows[1], (900, None), (901, ""), (902, " .,1")]


@pytest.mark.parametrize("block", [512, 5])
def test_equals_all_pairs(spark, block):
    cfg = SpellingConfig(min_count=2, block=block)
    rows = _corpus(random.Random(3))
    expected = _expected(rows, cfg)
    got = spelling_variants(frame(spark, rows).repartition(4), cfg).collect()
    assert len(got) == len(expected) and sum(1 for r in got if r.form) > 20 and any(r.root != r.form for r in got if r.form)
    for r in got:
        assert (r.n, r.n_near, r.form, r.form_n, r.root) == expected[r.word], r.word


def test_empty_table(spark):
    assert spelling_variants(frame(spark, [])).collect() == []


def test_tiles_of_random_words(monkeypatch):
    monkeypatch.setattr(spelling, "TILE_CELLS", 200)
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(90)})
    found = {(words[i], words[j]) for a, b, _ in near(words, words) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {(v, w) for v in words for w in words if _one_edit(v, w)}


def test_matrices_keep_code_points():
    left, right, sizes = spelling.matrices(["é😀", "abc"])
    assert left.tolist() == [[233, 128512, 0], [97, 98, 99]] and right.tolist() == [[0, 233, 128512], [97, 98, 99]]
    assert sizes.tolist() == [2, 3] and left.dtype == np.uint32
