"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import conversation_repair, decontaminate, hard_negatives, language_id, line_dedup, packing, quality, simhash, suffix_dedup, token_counts, token_store, toxicity, vector_search
from barflow.llm.common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_passages(read(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", 512)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", 1)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("key")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, threshold=3)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", 0, 2048)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def damaged(table: DataFrame) -> DataFrame:
    """The messages of conversations with the contract's damage, dealt by crc32 of `conv_id:turn` mod 20."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = table.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.pmod(F.crc32(named.cast("binary")), F.lit(20)).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversation_repair.messages(rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations")
    return conversation_repair.repair_digests(damaged(table), table.select("conv_id").distinct())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, positives=5, negatives=10, least=30, most=90, scale=256)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_mixtures(read(spark, sf_dir, "documents")).drop("languages")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_token_store, op4_quality, op5_toxicity, op6_simhash, op7_packing, op8_line_dedup, op9_vector_search, op10_decontamination, op11_conversation_repair, op12_hard_negatives, op13_language_id)}

_OP8 = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), spread AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM lines WHERE length(line) >= 20
  GROUP BY line HAVING count(DISTINCT source) >= 10
)
SELECT l.doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE s.line IS NOT NULL AND s.first <> struct_pack(d := l.doc_id, p := l.pos)) AS n_removed,
  md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE s.line IS NULL OR s.first = struct_pack(d := l.doc_id, p := l.pos)), '')) AS kept_md5
FROM lines l LEFT JOIN spread s ON l.line = s.line
GROUP BY l.doc_id
"""

_OP9 = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP1 = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), win AS (
  SELECT doc_id, CAST(k AS BIGINT) AS k, b[k + 1 : k + 50] AS h FROM d, unnest(range(octet_length(b) - 49)) AS r(k)
), least_of AS (
  SELECT h, min(doc_id) AS m FROM win GROUP BY h
), gone AS (
  SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS gap FROM win JOIN least_of USING (h) WHERE m < doc_id
), runs AS (
  SELECT doc_id, k, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM gone
), spans AS (
  SELECT doc_id, run, min(k) AS a, max(k) + 50 AS e FROM runs GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(e), 0), octet_length(any_value(b)) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
), texts AS (
  SELECT doc_id, string_agg(hex(b[x + 1 : y]), '' ORDER BY x) AS t FROM kept JOIN d USING (doc_id) GROUP BY doc_id
), s AS (SELECT doc_id, sum(e - a) AS n, count(*) AS c FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed, coalesce(s.c, 0) AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d JOIN texts USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_OP10 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), {_WORDS}) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, {_A_TO_Z}), {_WORDS}) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k + 1 : k + least(len(w), 13)], ' ') AS s FROM i, unnest(range(greatest(len(w) - 12, 1))) AS r(k) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS s FROM d, sizes, unnest(range(len(w) - n + 1)) AS r(k)
), met AS (
  SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.s = dw.s
), hit AS (
  SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT doc_id, n, k FROM met), unnest(range(n)) AS r(j) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP11 = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS b
  FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
    list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 20 AS fate
  FROM keyed
), rows AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM fated, unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE fate <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r, rtrim(text, E' \t\n\x0b\f\r') AS seen FROM rows
), faulted AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair
  FROM ordered
), tallied AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulted GROUP BY conv_id
), starts AS (
  SELECT conv_id, 0 AS i, [{'c': 0, 'a': '', 't': ''}, {'c': 100000000, 'a': '', 't': ''}, {'c': 3, 'a': 'I', 't': chr(10) || 'user:'}, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}] AS s FROM tallied
), steps AS (
  SELECT * FROM starts
  UNION ALL
  SELECT conv_id, i, list_value(v[1], v[2],
    list_min(list_value(v[3], {'c': v[1].c + 3, 'a': v[1].a || 'I', 't': v[1].t || chr(10) || 'user:'}, {'c': v[2].c + 3, 'a': v[2].a || 'I', 't': v[2].t || chr(10) || 'user:'}, {'c': v[4].c + 3, 'a': v[4].a || 'I', 't': v[4].t || chr(10) || 'user:'})),
    list_min(list_value(v[4], {'c': v[3].c + 3, 'a': v[3].a || 'I', 't': v[3].t || chr(10) || 'assistant:'}, {'c': v[1].c + 6, 'a': v[1].a || 'II', 't': v[1].t || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': v[2].c + 6, 'a': v[2].a || 'II', 't': v[2].t || chr(10) || 'user:' || chr(10) || 'assistant:'}))) AS s
  FROM (
    SELECT p.conv_id, f.i, list_value(
      {'c': s[1].c + 4, 'a': s[1].a || 'D', 't': s[1].t},
      list_min(list_value({'c': s[2].c + 4, 'a': s[2].a || 'D', 't': s[2].t}, {'c': s[1].c + keep + CASE r WHEN 's' THEN 0 ELSE 100000000 END, 'a': s[1].a || 'K', 't': s[1].t || kept})),
      list_min(list_value({'c': s[3].c + 4, 'a': s[3].a || 'D', 't': s[3].t},
        {'c': s[1].c + keep + CASE r WHEN 'u' THEN 0 ELSE 100000000 END, 'a': s[1].a || 'K', 't': s[1].t || kept}, {'c': s[2].c + keep + CASE r WHEN 'u' THEN 0 ELSE 100000000 END, 'a': s[2].a || 'K', 't': s[2].t || kept}, {'c': s[4].c + keep + CASE r WHEN 'u' THEN 0 ELSE 100000000 END, 'a': s[4].a || 'K', 't': s[4].t || kept},
        {'c': s[1].c + keep + 3, 'a': s[1].a || 'R', 't': s[1].t || as_user}, {'c': s[2].c + keep + 3, 'a': s[2].a || 'R', 't': s[2].t || as_user}, {'c': s[4].c + keep + 3, 'a': s[4].a || 'R', 't': s[4].t || as_user})),
      list_min(list_value({'c': s[4].c + 4, 'a': s[4].a || 'D', 't': s[4].t}, {'c': s[3].c + keep + CASE r WHEN 'a' THEN 0 ELSE 100000000 END, 'a': s[3].a || 'K', 't': s[3].t || kept}, {'c': s[3].c + keep + 3, 'a': s[3].a || 'R', 't': s[3].t || as_assistant}))) AS v
    FROM steps p JOIN (
      SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 3 ELSE 100000000 END AS keep, chr(10) || role || ':' || text AS kept, chr(10) || 'user:' || text AS as_user, chr(10) || 'assistant:' || text AS as_assistant FROM faulted
    ) f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
  )
), done AS (
  SELECT p.conv_id, list_min([s[1], s[4]]) AS best FROM steps p JOIN tallied t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p.i
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN tallied t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_OP12 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

ORACLES: dict[str, str] = {"op1_suffix_dedup": _OP1, "op8_line_dedup": _OP8, "op9_vector_search": _OP9, "op10_decontamination": _OP10, "op11_conversation_repair": _OP11, "op12_hard_negatives": _OP12}
