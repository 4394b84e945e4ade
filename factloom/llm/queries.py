"""The queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from factloom.llm import chosenpath, ctw, decontaminate, kdshards, langid, licenses, multiindex, pieces, pii, weaklabels
from factloom.llm.common import table

SHARDS = 24
#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("FACTLOOM_TOKENIZERS", "/opt/tokenizers")


def op1_language_id(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_kd_shards(spark, sf_dir):
    out = kdshards.kd_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sentencepiece(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op6_license_scan(spark, sf_dir):
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expression", "freedom")


def op7_ctw(spark, sf_dir):
    return ctw.lm_scores(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op3_chosen_path(spark, sf_dir):
    return chosenpath.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op8_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_multi_index(spark, sf_dir):
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_weak_labels(spark, sf_dir):
    return weaklabels.classify(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def base_language_folds(spark, sf_dir):
    """Operator 1: which documents are held out."""
    return op1_language_id(spark, sf_dir).select("doc_id", "held_out")


def base_license_scan(spark, sf_dir):
    """Operator 6: the columns of the base phrases."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_word_model(spark, sf_dir):
    """Operator 7: the columns of the word model; scores are rounded, as sums differ in order."""
    return op7_ctw(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def base_pii_counts(spark, sf_dir):
    """Operator 9: how many spans of each base kind a document has."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_kd_shards": op2_kd_shards,
    "op4_sentencepiece": op4_sentencepiece,
    "op6_license_scan": op6_license_scan,
    "op7_ctw": op7_ctw,
    "op9_pii": op9_pii,
    "op3_chosen_path": op3_chosen_path,
    "op8_decontamination": op8_decontamination,
    "op10_multi_index": op10_multi_index,
    "op5_weak_labels": op5_weak_labels,
    "base_language_folds": base_language_folds,
    "base_license_scan": base_license_scan,
    "base_word_model": base_word_model,
    "base_pii_counts": base_pii_counts,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a short ASCII text: eight shifts a character."""
    step = "xor(c, ascii(b)::BIGINT)"
    for k in range(8):
        step = f"list_transform([{step}], lambda c{k}: xor(c{k} >> 1, 3988292384 * (c{k} & 1)))[1]"
    return f"xor(list_reduce(list_prepend('4294967295', string_split({text}, '')), lambda c, b: ({step})::VARCHAR)::BIGINT, 4294967295)".replace("xor(c, ", "xor(c::BIGINT, ")


def _phrase_places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(1, len(w) + 1), lambda i: {same})"


def _license_sql() -> str:
    places = {label: _phrase_places(phrase) for phrase, label in licenses.BASE_PHRASES.items()}
    every = " || ".join(places.values())
    labels = " || ".join(f"CASE WHEN len({p}) > 0 THEN ['{x}'] ELSE [] END" for x, p in sorted(places.items()))
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), p AS (SELECT doc_id, w, {every} AS spots, {labels} AS labels FROM t)
SELECT doc_id, len(w) AS n_words, len(spots) AS n_base, list_min(spots) - 1 AS first_word, list_max(spots) - 1 AS last_word, array_to_string(labels, ',') AS base_labels FROM p"""


#: SQL of what SQL can express: the base columns of four operators.
ORACLES: dict[str, str] = {
    "base_language_folds": f"SELECT doc_id, {_crc32('doc_id::VARCHAR')} % 3 = 1 AS held_out FROM documents",
    "base_license_scan": _license_sql(),
    "base_word_model": f"""
WITH d AS (SELECT doc_id, {_crc32('doc_id::VARCHAR')} % 7 = 2 AS held_out, list_append(regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+'), chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS token FROM d), c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token), s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 3) AS base_score FROM t LEFT JOIN c USING (token), s GROUP BY doc_id, held_out, n""",
    "base_pii_counts": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), m AS (SELECT doc_id, regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(x, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(x, '[0-9]([ -]?[0-9])+'), lambda s: regexp_replace(s, '[ -]', '', 'g')) AS card, regexp_extract_all(x, '\\+[0-9][ ().0-9-]+[0-9]') AS phone FROM t)
SELECT doc_id, len(email) AS n_email, len(list_filter(ip, lambda s: list_max(list_transform(string_split(s, '.'), lambda p: try_cast(p AS DOUBLE))) <= 255)) AS n_ip,
  len(list_filter(card, lambda s: len(s) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN s[len(s) + 1 - i]::INT ELSE (s[len(s) + 1 - i]::INT * 2) // 10 + (s[len(s) + 1 - i]::INT * 2) % 10 END)) % 10 = 0)) AS n_card,
  len(list_filter(phone, lambda s: len(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM m""",
}
