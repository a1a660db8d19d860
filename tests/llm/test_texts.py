"""Per-text operators against the tokenizers library, regular expressions and brute force."""

import collections
import hashlib
import random
import re
import zlib
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from siftframe.llm import bpe, chat_format, pii, toxicity
from siftframe.llm.decontaminate import contaminated
from siftframe.llm.license_scan import PHRASES, LicenseConfig, scan_licenses
from siftframe.llm.url_filter import RULES, default_list, judge_urls

from conftest_llm import frame


def test_bpe_equals_the_library(spark, corpus):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0x20, 0x250), 0x85, 0x2028, 0x3A3, 0x130, 0x301, 0x4E2D, 0x1F600]] + ["'ll", "<|endoftext|>", " "] * 9
    texts = [t for _, t in corpus] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    done = bpe.encode_documents(frame(spark, list(enumerate(texts)))).select("doc_id", "n_tokens", "ids", "decoded", "row").collect()
    codec = bpe.load_codec(P.path("word_bpe_49k.json"))
    for r in done:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == codec.decode(bytes(r.ids))
    assert bpe.encode_documents(frame(spark, [])).collect() == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans_stay_and_keep_code_points(spark):
    texts = [None, "", "é😀 a.b@x.y_c@d.e@f.gh and @x.y", "1.2.3.4 1.2.3.4.5 256.1.1.1 0255.001.2.3 1..2.3.4", "x" * 50_000 + "@",
             "4111 1111 1111 1111 and 4111111111111112 4111-1111-1111-1111-1 4111 1111 1111 1111 and 79927398713",
             "+1 (255) 555-8013, +49-30-123456 +12 +1234567890123456 ++1 222 333 4444", "a" + ".b" * 20_000, "9" * 20_000,
             "a@" + "b." * 20_000 + "c", "call (255) 555-8013 or mail joe (at) ex.org password=abcdef1"] * 3
    rows = pii.digests(pii.find_pii(frame(spark, list(enumerate(texts))))).collect()
    for r in rows:
        spans, counts = [], []
        for kind, pattern in BASE.items():
            found = [m.span() for m in re.finditer(pattern, texts[r.doc_id] or "") if _valid(kind, m.group())]
            counts.append(len(found))
            spans += [f"{kind}:{a}:{b}" for a, b in found]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(","))
    assert pii.find_pii(frame(spark, [])).collect() == []


def test_licence_bases_and_spans(spark):
    texts = [None, "", "MIT License, mit\tlicense", "the Apache license. general PUBLIC-license x", "mit licenses", "é mit license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction", "license " * 9000 + "mit license"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in scan_licenses(frame(spark, list(enumerate(texts))), LicenseConfig()).collect():
        w = word.findall((texts[r.doc_id] or "").lower())
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert 0 <= r.score <= 1
        if r.doc_id == 6:
            assert r.labels == "mit" and r.spans[0].cover > 0.9
    assert scan_licenses(frame(spark, [])).collect() == []


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://example.net/de", "http://net/", "http://xnet/", "http://a.org/fr/",
            "https://example.com/de/1", "http://www.spam-farm.example.com/x", "http://ok.example.com", "a://b://c/", "http://example.net/en/x"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(None, urls[3], "k")], "page_id long, url string, key string")
    out = judge_urls(pages, default_list(spark)).collect()
    assert len(out) == len(urls) + 1
    got = {r.page_id: r for r in out if r.page_id is not None}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest).group().lower()
        path = re.match("[^?#]*", rest[len(host):]).group()
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (max(fits)[1] if fits else None)
        assert got[i].verdict == (max(fits)[2] if fits else "block" if "spam-farm" in host else "allow")
    assert judge_urls(pages.limit(0), default_list(spark)).collect() == []


def test_contaminated_documents(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randint(0, 400)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(14, 50)))) for k in range(12)] + [
        (90, None), (91, ""), (92, "short item"), (93, "three word item"), (94, "zz")]
    text = lambda: " ".join(word() for _ in range(60))
    near = items[3][1].split()
    near[-1] = "other"
    docs = [(0, text()), (1, text() + " " + items[0][1].upper() + ", " + text()), (2, None), (3, ""), (4, items[1][1]),
            (5, text() + " " + " ".join(near) + " " + text()), (6, items[5][1][: len(items[5][1]) // 2]), (7, "short item"), (None, items[1][1]),
            (8, " ".join([items[7][1], text(), items[8][1], items[7][1]]))] + [(4, items[1][1])]
    # further documents: halves swapped, words put in, an item cut at the end, short items inside, a shared shingle repeated
    long = max(items[:12], key=lambda x: len(x[1]))[1].split()
    half, third = len(long) // 2, len(long) // 3
    docs += [(20, " ".join([text(), *long[half:], *long[:half], text()])),
             (21, " ".join([*long[:third], "put", "in", *long[third:], text()])),
             (22, text() + " " + " ".join(long[:-2])),
             (23, text() + " Three-word item " + text()), (24, "zz " + text()), (25, text() + " short other item"),
             (26, " ".join([text(), *long[:5], *long[:5], *long, *long[-5:], text()])),
             (27, " ".join([*long[3:], text()]))]

    def grams(w):
        return collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or collections.Counter([tuple(w)] if w else [])

    expected = {}
    for i, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for j, u in items:
            v = re.findall(r"[^\W_]+", (u or "").lower())
            best = 0
            for k in range(max(1, len(w))):  # every start, the last windows end with the document
                a, b = grams(w[k:k + len(v)]), grams(v)
                common = sum((a & b).values())
                best = max(best, common / max(1, sum(a.values()) + sum(b.values()) - common))
            if i is not None and best >= 0.8:
                expected[i, j] = best
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, words int")
    out = contaminated(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in out} == expected and len(out) == len(expected)
    assert contaminated(frame(spark, []), bench).collect() == []
    assert contaminated(frame(spark, docs), bench.limit(0)).collect() == []


def test_repair_is_the_cheapest(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", None, "tool", "User "]
    rows = [(c, k, rng.choice(roles), None if rng.random() < 0.1 else f"t{k}") for c in range(40) for k in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (99, 1, "assistant", "tie"), (99, 1, "assistant", "tie")]
    old, chat_format.PIECE = chat_format.PIECE, 3
    try:
        frame_ = spark.createDataFrame([(*r, "k") for r in rows], "conv_id int, turn int, role string, text string, piece string")
        out = chat_format.repair_roles(frame_).collect()
        assert chat_format.repair_roles(frame_.limit(0)).collect() == []
    finally:
        chat_format.PIECE = old
    assert len(out) == len(rows)
    matrix, _ = chat_format.turn_costs(chat_format.RepairCost())
    end = chat_format.end_costs(chat_format.RepairCost())
    by = collections.defaultdict(list)
    for r in out:
        by[r.conv_id].append(r)
    for turns in by.values():
        turns.sort(key=lambda r: r.turn)
        best = {0: 0.0}
        for r in turns:
            code = {"system": 1, "user": 2, "assistant": 3}.get((r.role or "").strip().lower(), 0)
            best = {o: min(v + matrix[code, s, o] for s, v in best.items()) for o in (1, 2, 3)}
        assert turns[0].cost == min(v + end[s] for s, v in best.items())
        if len({r.turn for r in turns}) == len(turns):
            whole = "".join(r.rendered for r in turns)
            heads = re.findall(r"<\|(system|user|assistant)\|>", whole)
            heads = heads[1:] if heads[0] == "system" else heads
            assert heads == ["user", "assistant"] * (len(heads) // 2) and whole.count("<|end|>") == len(re.findall(r"<\|(?!end)", whole))


def test_clauses():
    insult, target, negation, report, threat = (toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT)
    plain = toxicity.clause_scores([insult], [2.0])
    assert toxicity.clause_scores([insult, target], [2.0, 1.0]) > plain > toxicity.clause_scores([negation, insult], [1.0, 2.0])
    assert toxicity.clause_scores([report, insult], [1.0, 2.0]) < plain
    assert toxicity.clause_scores([threat], [1.0]) == 0 < toxicity.clause_scores([threat, target], [1.0, 1.0])


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(4)
    word = lambda: "w" + "".join(rng.choice("abcdef") for _ in range(6))
    docs, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        w = [word() for _ in range(40)]
        for _ in range(3 * bad):
            w[rng.randrange(40)] = rng.choice(["gronk", "flurp", "snarkel" + rng.choice(["a", "o", "us"])])
        docs.append((i, " ".join(w) + "."))
        labels.append((i, 0, int(bad)))
    docs += [(600, None), (601, ""), (None, "gronk flurp gronk"), (602, "gronk " * 20_000), (0, docs[0][1])]
    d = frame(spark, docs)
    model = toxicity.fit(d, spark.createDataFrame(labels + [(600, 0, 1), (None, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int"),
                         toxicity.ToxicityConfig(min_docs=5))
    assert {"gronk", "flurp"} <= set(model.lexicon)
    out = toxicity.score_documents(d, model).collect()
    assert len(out) == len(docs)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out) and all(r.predicted == (r.score >= 0.3) for r in out)
    empty = toxicity.fit(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(frame(spark, []), empty).collect() == []
    assert len({r.score for r in toxicity.score_documents(d, empty).collect()}) == 1


def test_scores_do_not_depend_on_batches():
    model = toxicity.ToxicityModel({"gronk": 3.0, "snar*": 2.0})
    texts = ["you gronk. not gronk", "snarl", "snar", "x", "a gronk said you"]
    whole = toxicity.features(pa.array(texts), model.word_hashes())
    single = np.concatenate([toxicity.features(pa.array([t]), model.word_hashes()) for t in texts])
    assert np.allclose(whole, single) and whole[1, 0] == 2.0 and whole[2, 0] == 0


def toxic_rows(rng, plan, clean):
    """(docs, labels) of training rows: for each (insult, documents) of ``plan`` texts with it, and ``clean`` texts without."""
    word = lambda: "w" + "".join(rng.choice("abcdefghijk") for _ in range(7))
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs, labels = [], []
    for insult, n in [*plan, (None, clean)]:
        for _ in range(n):
            text = [word() for _ in range(40)]
            if insult:
                text[rng.randrange(40)] = insult
            docs.append((next(ids), " ".join(text)))
            labels.append((docs[-1][0], 0, int(insult is not None)))
    return docs, labels, ids


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_counts_copies_once_and_learns_rare_insults(spark):
    rng = random.Random(8)
    docs, labels, ids = toxic_rows(rng, [("gronk", 150), ("flurp", 12)], 400)
    copied = [f"copied{k:c}x" for k in range(97, 123)] * 2 + ["gronk"]
    for k in range(400):  # half of them exact copies, half with one word changed
        text = [w.upper() if k % 2 else w for w in copied]
        if k % 4 > 1:
            text[rng.randrange(52)] = f"q{rng.randrange(10**9)}"
        docs.append((next(ids), " ".join(text)))
        labels.append((docs[-1][0], 0, 1))
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame(labels, LABELS))
    assert {"gronk", "flurp"} <= set(model.lexicon)
    assert not [w for w in model.lexicon if w.startswith(("copied", "q", "w"))]


def test_families_are_of_near_equal_texts_only():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, (3, toxicity.HASHES), dtype=np.uint32)
    near, half = base[0].copy(), base[1].copy()
    near[40:] += 1
    half[24:] += 1
    label = toxicity.families(np.stack([base[0], base[1], near, half, base[2], base[0]]))
    assert label.tolist() == [0, 1, 0, 3, 4, 0] and toxicity.families(base[:0]).tolist() == []


@pytest.mark.parametrize("scale", [1, 4])
def test_toxicity_learns_from_few_documents(spark, scale):
    docs, labels, _ = toxic_rows(random.Random(9), [("gronk", 5 * scale), ("flurp", 5 * scale)], 50 * scale)
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame(labels, LABELS))
    assert {"gronk", "flurp"} <= set(model.lexicon)
    assert all(w.startswith(("gron", "flur")) for w in model.lexicon)
    by_chance = [(i, j, int(i % 6 == 0)) for i, j, _ in labels]  # labels without a meaning teach nothing
    assert toxicity.fit(frame(spark, docs), spark.createDataFrame(by_chance, LABELS)).lexicon == {}


def test_significance_against_brute_force():
    assert abs(toxicity.chance(3, 1, (5, 7)) - sum(comb(5, k) * comb(7, 4 - k) for k in (3, 4)) / comb(12, 4)) < 1e-12
    assert toxicity.significance([], [], (5, 7), 0.05) == toxicity.significance([(2, 0, 3)], [(2, 3)], (5, 0), 0.05) == -1
    # 20 entries in one document cannot reach the level of the three in four, so they do not weaken it
    level = toxicity.significance([(4, 0, 3), (1, 0, 20)], [(4, 3), (1, 20)], (9, 54), 0.05)
    assert abs(level - toxicity.chance(4, 0, (9, 54))) < 1e-12


def test_toxicity_learns_from_one_row_of_an_id(spark, monkeypatch):
    docs, labels, ids = toxic_rows(random.Random(10), [("gronk", 20)], 100)
    again = [(docs[0][0], f"other text number {k} flurp") for k in range(300)] + [docs[1]] * 300
    read = []
    learn = toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda rows, *a: read.append(rows.count()) or learn(rows, *a))
    model = toxicity.fit(frame(spark, docs + again), spark.createDataFrame(labels, LABELS))
    assert read == [len(docs)] and "gronk" in model.lexicon and "flurp" not in model.lexicon


def test_hits_count_with_the_emitted_factor():
    model = toxicity.ToxicityModel({"gronk": 3.0})
    x = toxicity.features(pa.array(["a gronk", "you gronk", "not gronk", "said gronk", "kill", "gronk, not gronk"]), model.word_hashes())
    assert x[:, 1].tolist() == [1, 1.25, 0.8, 0.8, 0, 1.8] and x[:, 2].tolist() == [1, 1.25, 0.8, 0.8, 0, 1]
    assert np.allclose(x[:, 0], 3 * x[:, 1])
