"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import bpe_round_trip
from gridloom.llm.chat import chat_digests, format_chats
from gridloom.llm.classifier import quality_scores
from gridloom.llm.common import table
from gridloom.llm.fingerprint import edited_fingerprints
from gridloom.llm.jaccard import jaccard_groups
from gridloom.llm.language import identify
from gridloom.llm.lines import apply_line_marks, line_marks
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import find_pii, pii_digests
from gridloom.llm.repair import damaged, repair_report, turns
from gridloom.llm.rules import quality_rules
from gridloom.llm.secrets import find_secrets, secret_digests
from gridloom.llm.whitening import whiten


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_digests(format_chats(rows))


_MARKS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>"]
_ESCAPED = "length(text) + (length(text) - length(replace(text, chr(92), ''))) + " + " + ".join(
    f"(length(text) - length(replace(text, '{m}', ''))) // {len(m)}" for m in _MARKS
)
OP5_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    {_ESCAPED} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 27 + length(role) END AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END
    AND (k < n OR role = 'assistant') AND NOT (role = 'system' AND k > 1)) AS valid
FROM sized GROUP BY conv_id
"""


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = apply_line_marks(docs, line_marks(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), keys AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.first AS dropped FROM lines l LEFT JOIN keys k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id, s.n
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(find_pii(table(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(find_secrets(table(spark, sf_dir, "documents")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(turns(table(spark, sf_dir, "conversations"))))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def _way(before: str, role: int, edit: str, late: bool = True) -> str:
    """One way in OP12_SQL from the state ``before`` over the row; an insertion is part of it where ``edit`` begins with I."""
    names = {1: "system", 2: "user", 3: "assistant"}
    lines, cost = f"{before}.lines", 0
    if edit[0] == "I":
        lines, cost = f"list_append({lines}, '{names[3 if before == 's2' else 2]}:')", 3
    lines = f"list_append({lines}, role || ':' || text)" if edit[-1] == "K" else f"list_append({lines}, '{names[role]}:' || text)"
    cost += 3 * (edit[-1] == "R")
    allowed = f"NOT forced AND {before} IS NOT NULL" + (f" AND initial = '{names[role][0]}'" if edit[-1] == "K" else "")
    return f"CASE WHEN {allowed} THEN {{'cost': {before}.cost + {cost} + late, 'audit': {before}.audit || '{edit}', 'lines': {lines}}} END"


_STAY = "CASE WHEN s{0} IS NOT NULL THEN {{'cost': s{0}.cost + 4, 'audit': s{0}.audit || 'D', 'lines': s{0}.lines}} END"
_TO = {
    0: [],
    1: [_way("s0", 1, "K")],
    2: [_way(f"s{s}", 2, e) for s in (0, 1, 3) for e in "KR"] + [_way("s2", 2, e) for e in ("IK", "IR")],
    3: [_way("s2", 3, e) for e in "KR"] + [_way(f"s{s}", 3, e) for s in (0, 1, 3) for e in ("IK", "IR")],
}
_STEP = ", ".join(f"least({', '.join([_STAY.format(t), *w, 'NULL'])}) AS s{t}" for t, w in _TO.items())
_NEXT = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
OP12_SQL = f"""
WITH RECURSIVE byte AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: {_NEXT}) ORDER BY i) AS t FROM range(256) r(i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), summed AS (
  SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS part FROM keyed k, byte
), hurt AS (
  SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role,
    CASE part WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN part = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM summed WHERE part <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS k FROM hurt
), faults AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM placed
), marked AS (
  SELECT *, blank OR again AS forced, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS late FROM faults
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS s0,
    CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[])) AS s1, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[])) AS s2,
    CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[])) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, m.k, {_STEP} FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k + 1
), ended AS (
  SELECT conv_id, least(s0, s3, CASE WHEN s1 IS NOT NULL THEN {{'cost': s1.cost + 6, 'audit': s1.audit || 'II', 'lines': list_concat(s1.lines, ['user:', 'assistant:'])}} END,
    CASE WHEN s2 IS NOT NULL THEN {{'cost': s2.cost + 3, 'audit': s2.audit || 'I', 'lines': list_append(s2.lines, 'assistant:')}} END) AS done
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS late FROM walk) WHERE late = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE late > 0) AS truncated, count(*) FILTER (WHERE k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(done.cost AS BIGINT) AS cost, done.audit AS audit,
  sha256(array_to_string(done.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_pii": op4_pii,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_language_id": op13_language_id,
}
ORACLES = {"op2_line_dedup": OP2_SQL, "op3_ngram_jaccard": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op12_conversation_repair": OP12_SQL}
