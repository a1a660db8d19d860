"""Token files against the tokenizers library, and the entropy coder's round trips."""

import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftframe.llm import token_files
from siftframe.llm.common import shared_dir
from siftframe.llm.token_files import (
    Recent, Table, Words, _path, decode, encode, read_range, read_tokens, round_trip, token_ids, write_tokens)

from conftest_llm import frame


def _library():
    import public_tokenizers as P
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def _texts(corpus):
    rng = random.Random(4)
    letters = [*map(chr, range(0x250)), " ", "　", " ", "́", " ", "​", "Σ", "ς", "İ", "中", "😀", "'ll", "<|endoftext|>", " <|startoftext|>", "a", "b", " ", "\n"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    return [t for _, t in corpus] + made + [f"x{c}y z{c}" for c in letters] + ["à ̀a \ńb", "o" * 100_000, "word " * 30_000]


def test_files_give_back_the_librarys_ids(spark, corpus, monkeypatch):
    library, texts = _library(), _texts(corpus)
    rng = random.Random(9)
    ids = rng.sample(range(-5000, 5000), len(texts))
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 20_000)
    docs = frame(spark, list(zip(ids, texts, strict=True))).repartition(5)
    target = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, target)
    got = {r.doc_id: r for r in read_tokens(spark, target).collect()}
    expected = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in zip(ids, texts, strict=True)}
    assert len(got) == len(texts)
    at, stream = 0, []
    for i in sorted(ids):
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == expected[i], texts[ids.index(i)][:80]
        assert (got[i].start, got[i].n_tokens) == (at, len(expected[i]))
        at += len(expected[i])
        stream += expected[i]
    for start, count in ((0, 10), (at - 5, 50), (19_990, 45_000), (at // 2, 1), (at + 3, 4)):
        assert read_range(spark, target, start, count).tolist() == stream[start: start + count]


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "one two"), (3, None), (3, "three"), (3, "three"), (1, ""), (None, None)]
    got = round_trip(frame(spark, rows).repartition(3)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 3, 3, 3]
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    alone = np.array([2], "<u4").tobytes()
    assert (got[2].n_tokens, got[2].ids_crc32) == (1, zlib.crc32(alone))
    assert round_trip(frame(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1, 31, 32, 33, 5000, 16_384, 65_536, 65_537, 200_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.minimum(rng.geometric(0.01, n) * 7, 49_407).astype(np.uint32)
    ids, counts = np.unique(np.concatenate((values, [49_407])), return_counts=True)
    table = Table.of_counts(ids, counts)
    assert table.share.sum() == 1 << token_files.SCALE and table.share.min() >= 1
    block, slots = encode(values, table), table.slots()
    assert (decode(block, table, slots) == values).all()
    stretches = len(block.places) // 8
    length = token_files.CHECKPOINT * block.lanes
    for k in range(stretches):
        assert (decode(block, table, slots, k, k + 1) == values[k * length: (k + 1) * length]).all()
    if n == 200_000:  # close to the entropy
        p = counts / counts.sum()
        assert len(block.words) < 1.01 * n / 8 * -(p * np.log2(p)).sum()


def test_table_with_more_rare_ids_than_shares():
    ids = np.arange(400_000)
    counts = np.ones(400_000, np.int64)
    counts[7] = 10**12
    table = Table.of_counts(ids, counts)
    assert table.share.sum() == 1 << token_files.SCALE and table.share.min() == 1


def test_a_damaged_block_fails_the_read(spark):
    target = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(frame(spark, [(1, "some words to encode")]), target)
    blocks = spark.read.parquet(f"{target}/blocks")
    broken = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    blocks.selectExpr("* except (ids_crc32)", "ids_crc32 + 1 as ids_crc32").write.parquet(f"{broken}/blocks")
    spark.read.parquet(f"{target}/frequencies").write.parquet(f"{broken}/frequencies")
    with pytest.raises(Exception, match="checksum"):
        read_tokens(spark, broken).collect()


def test_query_on_the_given_table(spark, sf_small):
    from siftframe.llm.suite import QUERIES
    library, at = _library(), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op13_token_files"](spark, sf_small).collect()}
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got.pop(r.doc_id) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_texts_of_a_chunk_have_the_librarys_ids(kind):
    library = _library()
    made = ["", None, " \n\t ", "Tree tree. TREE! treé*** ***tree", "a\tb\x0bc\x0cd\re\x1cf\x85g\xa0h i", "o" * 200 + "!",
            "don't we'll it's", "µªº ßÄÖÜÿ ×÷", "x<|endoftext|>y <|startoftext|>", "1,234.5 a1b2", "...", "ﬁ İ é ?́"]
    for texts in (made, made[::-1], [], [None], [" "], ["..."], ["1 2"]):
        words = Words(_path(None), "<u2")
        for chunk in (pa.array(texts, kind), pa.array(["before", *texts, "behind"], kind).slice(1, len(texts))):
            got = [np.frombuffer(v, "<u2").tolist() for v in words.coded(chunk, b"\x02\x00").to_pylist()]
            assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_python_sees_a_chunks_distinct_words_only(monkeypatch):
    asked, made = [], []
    monkeypatch.setattr(Recent, "values", lambda self, keys, make, f=Recent.values: asked.extend(keys.to_pylist()) or f(self, keys, make))
    monkeypatch.setattr(Words, "stem", lambda self, letters, f=Words.stem: made.append(letters) or f(self, letters))
    words = Words(_path(None), "<u2")
    texts = pa.array(["Tree tree. TREE! tree*** 12"] * 300)
    ids = words.coded(texts, b"").to_pylist()
    assert len(set(ids)) == 1 and sorted(asked) == ["", "!", "***", ".", "12", "tree"] and made == ["tree"]
    assert words.coded(texts, b"").to_pylist() == ids and made == ["tree"]


def test_recent_words_stay_and_others_leave():
    made = []
    recent = Recent(3)

    def make(key):
        made.append(key)
        return key.encode()

    for keys in (["a", "b", "c"], ["a", "d"], ["a", "e"], ["f", "a"], ["g"], ["a"]):
        assert recent.values(pa.array(keys), make).to_pylist() == [k.encode() for k in keys]
        assert len(recent.new) <= 3 and len(recent.old) <= 3
    assert made == ["a", "b", "c", "d", "e", "f", "g"]
    assert recent.values(pa.array(["b", "x" * 65]), make).to_pylist() == [b"b", b"x" * 65] and made[7:] == ["b", "x" * 65]
    assert "x" * 65 not in recent.new


def test_chunks_of_a_partition(spark, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_BYTES", 5_000)
    texts = [f"word{k} Word, words. {k}" * (k % 40) for k in range(700)]
    rows = token_ids(frame(spark, [(k, t or None) for k, t in enumerate(texts)]).coalesce(1)).collect()
    library = _library()
    assert [r.doc_id for r in rows] == list(range(700))
    assert all(np.frombuffer(bytes(r.ids), "<u2").tolist() == [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2] for r in rows)


def test_coder_takes_ids_beyond_16_bits_and_of_few_tokens():
    for ids, counts in (([70_000, 3, 131_072], [5, 1, 900_000]), ([9], [4])):
        table = Table.of_counts(np.array(ids), np.array(counts))
        values = np.random.default_rng(1).choice(np.array(ids, np.uint32), 40_000)
        assert (decode(encode(values, table), table, table.slots()) == values).all()
