"""Duplicate operators against brute force, with nulls, copies, hot settings and empty tables."""

import hashlib
import re
import string
from collections import defaultdict

import pytest

from siftframe.llm.exact_dedup import exact_duplicates
from siftframe.llm.near_dedup import NearDupConfig, min_matches, near_duplicates
from siftframe.llm.substring_dedup import SubstringConfig, substring_dedup

from conftest_llm import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_are_the_components_of_all_links(spark, corpus, size):
    sets = {i: shingles(t, size) for i, t in corpus if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if j < i and common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = near_duplicates(frame(spark, corpus), NearDupConfig(shingle=size, block=3)).collect()
    assert len(out) == len(corpus)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id)), r
            assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_posterior_bound_keeps_the_threshold():
    assert min_matches(32, 0.8, 1e-7) < 32 * 0.8 < 32
    assert min_matches(160, 0.8, 1e-7) > min_matches(160, 0.8, 1e-12)


@pytest.mark.parametrize("cfg", [SubstringConfig(), SubstringConfig(hot_strings=0, max_run=7), SubstringConfig(bucket_strings=1)])
def test_covered_words_go(spark, corpus, cfg):
    first = {}
    for i, t in sorted((x for x in corpus if x[0] is not None), key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    expected = defaultdict(list)
    for i, t in corpus:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[i].append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = defaultdict(list)
    for r in substring_dedup(frame(spark, corpus), cfg).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256, r.kept_text))
    assert got == expected
    assert sum(x[1] for v in got.values() for x in v) > 200


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("capacity", [1 << 16, 2])
def test_exact_duplicates(spark, corpus, capacity):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[(t or "").translate(LOW)].append(i)
    out = exact_duplicates(frame(spark, corpus), capacity).collect()
    assert len(out) == len(corpus)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        ids = by_hash[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)


def test_exact_duplicates_of_nothing(spark):
    assert exact_duplicates(frame(spark, [])).collect() == []


def test_words_whose_polynomial_hashes_agree_are_told_apart(spark):
    """Two words in Thue-Morse order and its complement: every polynomial modulo a power of two gives both one hash."""
    order = [bin(k).count("1") % 2 for k in range(2048)]
    for size in (256, 512, 1024, 2048):
        x, y = ("".join("ab"[bit ^ flip] for bit in order[:size]) for flip in (0, 1))
        rows = [(1, " ".join([x] * 60)), (2, " ".join([y] * 60)), (3, f"{x} {x}"), (4, f"{y} {y}")]
        docs = frame(spark, rows)
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, NearDupConfig(shingle=2)).collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
        assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_byte_hashes_depend_on_every_byte_and_on_nothing_else():
    import numpy as np
    from siftframe.llm.tokens import LONG_WORD, byte_hashes
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 9, 16, 17, LONG_WORD, LONG_WORD + 1):
        word = rng.integers(0, 256, size, dtype=np.uint8)
        data = np.concatenate((rng.integers(0, 256, 5, dtype=np.uint8), word, rng.integers(0, 256, 3, dtype=np.uint8), word))
        starts, ends = np.array([5, 8 + size]), np.array([5 + size, 8 + 2 * size])
        for which in (0, 1):
            a, b = byte_hashes(data, starts, ends, which)
            assert a == b
            seen = {int(a)}
            for k in range(min(size, 64)):
                data[5 + k] ^= 1
                seen.add(int(byte_hashes(data, starts, ends, which)[0]))
                data[5 + k] ^= 1
            assert len(seen) == 1 + min(size, 64)
    assert (byte_hashes(data, starts, ends, 0) != byte_hashes(data, starts, ends, 1)).all()
