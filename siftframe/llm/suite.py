"""Registered queries of the text operators and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftframe.llm import bpe, pii
from siftframe.llm.chat_format import repair_roles
from siftframe.llm.chat_repair import repair
from siftframe.llm.common import table
from siftframe.llm.decontaminate import contaminated
from siftframe.llm.exact_dedup import exact_duplicates
from siftframe.llm.license_scan import scan_licenses
from siftframe.llm.near_dedup import NearDupConfig, near_duplicates
from siftframe.llm.spelling import spelling_variants
from siftframe.llm.substring_dedup import substring_dedup
from siftframe.llm.token_files import round_trip
from siftframe.llm.toxicity import fit, score_documents
from siftframe.llm.url_filter import RULES, SPAM, default_list, judge_urls

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x20\x09-\x0D]+'"


def _crc_table() -> list[int]:
    """CRC-32 of each byte value, by its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _crc32_sql(octets: str) -> str:
    """CRC-32 of bytes given as hexadecimal text, in DuckDB, which has no such function."""
    data = f"list_transform(range(1, length({octets}) // 2 + 1), lambda i: CAST('0x' || substr({octets}, 2 * i - 1, 2) AS UBIGINT))"
    step = f"xor(c >> 8, (CAST({_crc_table()} AS UBIGINT[]))[CAST(xor(c, b) & 255 AS BIGINT) + 1])"
    return f"xor(list_reduce({data}, lambda c, b: {step}, CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"


def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), NearDupConfig(shingle=2))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_pii(spark, sf_dir):
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op4_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_chat_format(spark, sf_dir):
    made = repair_roles(table(spark, sf_dir, "conversations"))
    return made.select("conv_id", "turn", "role", "new_role", "action", "cost",
                       F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


def op7_exact_duplicates(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op9_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), default_list(spark))


def op10_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark, sf_dir):
    return repair(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_token_files(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_substring_dedup, op3_pii, op4_bpe, op5_toxicity, op6_chat_format, op7_exact_duplicates,
    op8_license_scan, op9_url_filter, op10_decontamination, op11_conversation_repair, op12_spelling_variants,
    op13_token_files)}

ORACLES = {
    "op1_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM k),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM bad, range(50) t(j)),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
keep AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS kept, count(*) AS n
         FROM pos LEFT JOIN cov ON cov.doc_id = pos.doc_id AND cov.p = pos.p WHERE cov.p IS NULL GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN keep ON keep.doc_id = d.doc_id""",
    "op7_exact_duplicates": f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op9_url_filter": f"""
WITH r(h, p, v, is_rule) AS (VALUES {", ".join([f"('{h}', '{p}', '{v}', true)" for h, p, v in RULES]
                                                + [f"('{h}', '', 'block', false)" for h in SPAM])}),
u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), {_AZ}) AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
m AS (SELECT page_id, host, path, v, is_rule, h || p AS rule, row_number() OVER (
        PARTITION BY page_id ORDER BY is_rule DESC NULLS LAST, length(h || p) DESC) AS k
      FROM x LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, CASE WHEN is_rule THEN rule END AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
    "op12_spelling_variants": f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), {_AZ}) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY doc_id, run),
t AS (SELECT run, k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name FROM d),
x AS (SELECT run, k, hex(encode(name)) AS octets FROM t),
h AS (SELECT run, k, CAST({_crc32_sql("octets")} AS BIGINT) AS h FROM x),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, CAST(length(word) AS BIGINT) AS l FROM w GROUP BY word HAVING sum(k) >= 5 AND length(word) >= 6),
c AS (SELECT word, n, l, unnest(range(1, l + 1)) AS i FROM v),
e AS (SELECT word, n, l, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM c),
p AS (SELECT x.word, y.word AS other, y.n FROM e x JOIN e y ON x.l = y.l AND x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
      UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.a || e.b = v.word
      UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.a || e.b = v.word),
f AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'w': other}}) AS best FROM p GROUP BY word),
j AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN -best.n >= 5 * v.n THEN best.w END AS form,
             CASE WHEN -best.n >= 5 * v.n THEN -best.n END AS form_n FROM v LEFT JOIN f ON f.word = v.word),
g(word, root) AS (SELECT word, word FROM j WHERE form IS NULL UNION ALL SELECT j.word, g.root FROM j JOIN g ON j.form = g.word)
SELECT j.word, n, n_near, form, form_n, root FROM j JOIN g ON g.word = j.word""",
}
