"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import fst, licenses, linededup, mixing, neardup, packing, quality, repair, sharding, spelling, topk, wavelet, wordtable
from parley.llm.text import tables
from parley.plans.shared import materialize, work_folder


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(mixing.sized(tables(spark, sf_dir, "documents")))
    return mixing.mix(rows, rows).select("doc_id", "size", "source_size", "target", "taken", "source", "whole", "extra")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(materialize(found))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(tables(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.without_copies(docs, rules=linededup.RUNS).withColumnsRenamed({"__n_lines": "n_lines", "__n_removed": "n_removed"})


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    wavelet.write(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return wavelet.read(spark, folder)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(tables(spark, sf_dir, "documents")).drop("host_rate", "by_host")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(tables(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst.counted(tables(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(tables(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(tables(spark, sf_dir, "embeddings"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "conversations")
    return repair.report(rows, repair.damaged(rows))


def op12_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    found = wordtable.decode(wordtable.encode(tables(spark, sf_dir, "documents"), path), path)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.forms(spelling.vocabulary(tables(spark, sf_dir, "documents")))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_pack": op2_pack,
    "op3_shard": op3_shard,
    "op4_lines": op4_lines,
    "op5_wavelet": op5_wavelet,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_tokens": op8_tokens,
    "op9_license": op9_license,
    "op10_topk": op10_topk,
    "op11_repair": op11_repair,
    "op12_words": op12_words,
    "op13_variants": op13_variants,
}
#: CRC-32 in SQL: its table, and the sum of a text's bytes.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"


def crc32_sql(text: str) -> str:
    byte = f"CAST('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2] AS BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})), lambda i: {byte})), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op6_quality": r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w))),
c AS (SELECT rid, sum(s) AS s FROM (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS s FROM g WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars, n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(s, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS k FROM f GROUP BY source),
a AS (SELECT sum(k) / sum(n) AS m, sum(n) AS n, sum(k * k / n) AS k2, sum(n) - sum(n * n) / sum(n) AS between_, count(*) AS hosts FROM h),
v AS (SELECT m, CASE WHEN between_ > 0 THEN (k2 - n * m * m - (hosts - 1) * m * (1 - m)) / between_ ELSE 0 END AS v FROM a),
b AS (SELECT m, CASE WHEN v > 1e-12 AND m > 0 AND m < 1 THEN greatest(1, m * (1 - m) / v - 1) END AS strength FROM v),
r AS (SELECT source, rate, CASE WHEN rate > m THEN greatest(0.5, m / rate) ELSE 1.0 END AS share
  FROM (SELECT source, m, CASE WHEN strength IS NULL THEN m ELSE (k + m * strength) / (n + strength) END AS rate FROM h, b))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND rate <= 0.5 AND 100 * n_repeat_words <= 20 * share * n_words
  AND 100 * n_symbols <= 10 * share * word_chars AND 100 * n_dup_lines <= 50 * share * n_lines AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source""",
    "op10_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
    "op11_repair": f"""WITH RECURSIVE {CRC_TABLE}, ws AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blank),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
k AS (SELECT ids.c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(x.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations x JOIN ids ON x.conv_id IS NOT DISTINCT FROM ids.conv_id),
h AS (SELECT *, {crc32_sql('key')} % 20 AS f FROM k, crc),
d AS (SELECT c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
e AS (SELECT *, right(rtrim(text, blank), 1) AS ink, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS two FROM o, ws),
r AS (SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ink NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, CASE WHEN role = '' THEN 0 ELSE strpos('sua', left(role, 1)) END AS who FROM e),
s AS (SELECT c, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY 1),
dp AS (SELECT c, n AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 6::BIGINT, 'a': 'II'}}, {{'c': 3::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}] AS v FROM s
UNION ALL SELECT c, i - 1, [list_min([b[1], {{'c': b[3].c + 3, 'a': 'I' || b[3].a}}, {{'c': b[4].c + 6, 'a': 'II' || b[4].a}}]), list_min([b[2], {{'c': b[3].c + 3, 'a': 'I' || b[3].a}}, {{'c': b[4].c + 6, 'a': 'II' || b[4].a}}]),
  list_min([b[3], {{'c': b[4].c + 3, 'a': 'I' || b[4].a}}]), list_min([b[4], {{'c': b[3].c + 3, 'a': 'I' || b[3].a}}])]
FROM (SELECT dp.c, dp.i, list_transform([1, 2, 3, 4], lambda j: list_min(list_filter([{{'c': v[j].c + 4, 'a': 'D' || v[j].a}},
  CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE {{'c': v[[3, 3, 4, 3][j]].c + 3 + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'a': 'R' || v[[3, 3, 4, 3][j]].a}} END,
  CASE WHEN fault IN ('blank', 'duplicate') OR who = 0 OR [[2, 3, 0], [0, 3, 0], [0, 0, 4], [0, 3, 0]][j][who] = 0 THEN NULL ELSE {{'c': v[[[2, 3, 0], [0, 3, 0], [0, 0, 4], [0, 3, 0]][j][who]].c + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'a': 'K' || v[[[2, 3, 0], [0, 3, 0], [0, 0, 4], [0, 3, 0]][j][who]].a}} END], lambda x: x IS NOT NULL))) AS b
  FROM dp JOIN r ON r.c = dp.c AND r.i = dp.i) WHERE i > 0),
best AS (SELECT c, v[1].c AS cost, v[1].a AS audit FROM dp WHERE i = 0),
step AS (SELECT c, p, audit[p] AS edit, length(replace(audit[:p], 'I', '')) AS i, length(replace(audit[:p], 'D', '')) - length(replace(audit, 'D', '')) % 2 AS place FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM best)),
line AS (SELECT step.c, p, CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM step LEFT JOIN r ON r.c = step.c AND r.i = step.i WHERE edit <> 'D'),
made AS (SELECT c, string_agg(line, chr(10) ORDER BY p) AS said FROM line GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ids LEFT JOIN s USING (c) LEFT JOIN best USING (c) LEFT JOIN made USING (c)""",
    "op13_variants": f"""WITH RECURSIVE {CRC_TABLE},
r0 AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r1 AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, run, count(*) AS c FROM r0 WHERE length(run) >= 6 GROUP BY doc_id, run),
r2 AS (SELECT run, c, {crc32_sql('k')} AS h FROM r1, crc),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM r2) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
g AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
UNION SELECT a.word, a.n, b.word, b.n FROM v a JOIN g b ON a.word = b.rest UNION SELECT b.word, b.n, a.word, a.n FROM v a JOIN g b ON a.word = b.rest),
q AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY 1, 2),
f AS (SELECT word, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n, n_near FROM q),
w AS (SELECT word, word AS at FROM v UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL),
e AS (SELECT w.word, w.at AS root FROM w LEFT JOIN f ON f.word = w.at WHERE f.form IS NULL)
SELECT v.word, f.form, e.root, v.n, CAST(coalesce(f.n_near, 0) AS BIGINT) AS n_near, f.form_n FROM v JOIN e USING (word) LEFT JOIN f USING (word)""",
}
