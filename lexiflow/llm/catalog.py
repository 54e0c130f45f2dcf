"""The registered queries of the training-data operators, each over its whole
table with production parameters, and DuckDB SQL where SQL can express one."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import context_tree, language_id, run_index, toxicity, turn_repair
from lexiflow.llm.common import id_remainder, table
from lexiflow.llm.decontaminate import MASKS, SPAN, leaks
from lexiflow.llm.html_text import main_text
from lexiflow.llm.line_quality import PHRASES, SEPARATORS, clean_lines
from lexiflow.llm.middle import fill_in_middle
from lexiflow.llm.packing import pack
from lexiflow.llm.sanitize import KINDS, count_of, joined, sanitize
from lexiflow.llm.simhash import near_duplicates
from lexiflow.llm.substring_dedup import remove_repeats


#: The public vocabulary that packing counts tokens with, and its closing id.
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(id_remainder(5) != 0))
    rows = docs.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "text")
    return toxicity.score(rows, model, keep=["doc_id", "held_out"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents"), with_text=False).drop("cleaned")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(id_remainder(3) != 1))
    rows = docs.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "text")
    return language_id.predict(rows, model, keep=["doc_id", "held_out"])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=END_ID, with_ids=False)
    return out.drop("source", "ids")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(7) == 2
    return context_tree.score(docs, ~held_out, keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def op9_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitize(table(spark, sf_dir, "documents"), with_text=False)
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id")


def op11_swar_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), with_text=False).drop("output")


def op12_path_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op13_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_index.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.drop("kept", "removed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_decontamination, op4_language_id, op5_packing, op6_html_extraction, op7_substring_dedup, op8_lm_scoring, op9_sanitisation, op10_simhash,
                              op11_swar_middle, op12_path_ranking, op13_run_index)
}

#: The seeds of operator 3 in SQL: the selected tokens of each mask in a row.
_SEEDS = " UNION ALL ".join(
    f"SELECT {{id}}, {m} AS mask, p, [{', '.join(f'w[p + {k}]' for k in mask)}] AS seed FROM "
    f"(SELECT {{id}}, w, unnest(range(1, len(w) - {mask[-1]} + 1)) AS p FROM {{source}} WHERE len(w) > {mask[-1]})"
    for m, mask in enumerate(MASKS))

SQL: dict[str, str] = {
    "op3_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents
), i AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark)
  WHERE len(w) >= {SPAN} GROUP BY w
), ds AS ({_SEEDS.format(id="doc_id", source="d")}
), bs AS ({_SEEDS.format(id="item_id", source="i")}
), diag AS (
  SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS diagonal FROM ds JOIN bs USING (mask, seed)
), same AS (
  SELECT doc_id, item_id, diagonal, len(i.w) AS n, least(len(i.w), 15) AS length,
         [CASE WHEN j + diagonal >= 1 AND d.w[j + diagonal] = i.w[j] THEN 1 ELSE 0 END FOR j IN range(1, len(i.w) + 1)] AS e
  FROM diag JOIN d USING (doc_id) JOIN i USING (item_id)
), stretch AS (
  SELECT doc_id, item_id, diagonal, n, length, list_sum(e)::BIGINT AS item_matches, p - 1 AS item_start,
         list_sum(e[p:p + length - 1])::BIGINT AS matches
  FROM (SELECT *, unnest(range(1, n - length + 2)) AS p FROM same)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id
                               ORDER BY matches DESC, item_matches DESC, diagonal, item_start) AS k
  FROM stretch WHERE matches >= ceil(0.8 * length)
)
SELECT doc_id, item_id, (diagonal + item_start)::BIGINT AS doc_start, item_start::BIGINT AS item_start,
       length::BIGINT AS length, matches, item_matches, n::BIGINT AS item_tokens
FROM ranked WHERE k = 1""",
    "op2_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), win AS (
  SELECT doc_id, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d WHERE len(ws) >= 3)
), rep AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win) WHERE k > 1
), rep_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS p FROM rep) GROUP BY doc_id
), line AS (
  SELECT doc_id, i, ls[i] AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))
), fact AS (
  SELECT doc_id, len(ws) AS n, len(array_to_string(ws, '')) AS c,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
         len(list_filter(ws, lambda x: regexp_matches(x, '[.!?…][\x22\x27)\]»”’]*$'))) AS ends,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         len(list_filter(ws, lambda x: regexp_matches(x, '[!?]{2}'))) AS shouts,
         len(list_filter(ws, lambda x: list_contains([{separators}], x))) AS seps,
         regexp_matches(lower(line), '{phrases}') AS phrase,
         len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS same
  FROM line WHERE len(ws) > 0
), judged AS (
  SELECT *, ends = 0 OR ends * 100 < n OR symbols * 10 > n OR shouts * 4 > n OR seps * 10 > n OR phrase
            OR same * 2 > n AS fails
  FROM fact
), by_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (fails) AS n_removed_lines,
         count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(c) FILTER (fails), 0) AS lost_chars
  FROM judged GROUP BY doc_id
), all_docs AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
         coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN rep_words USING (doc_id) LEFT JOIN by_doc USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.3 * word_chars AS kept
FROM all_docs""".replace("{separators}", ", ".join(f"'{s}'" for s in SEPARATORS)).replace("{phrases}", "|".join(PHRASES)),
    "op11_swar_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), draw AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draw
), part AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM part""",
    # texts as hexadecimal digits, so a byte is two characters
    "op13_run_index": """
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), win AS (
  SELECT doc_id, p, h[2 * p + 1:2 * p + 100] AS s
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)
), hit AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id
), step AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit
), span AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM step) GROUP BY doc_id, k
), piece AS (
  SELECT doc_id, b AS from_byte, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), len(h) // 2) AS to_byte, h
  FROM (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, -1, 0 FROM d) JOIN d USING (doc_id)
), rest AS (
  SELECT doc_id, string_agg(h[2 * from_byte + 1:2 * to_byte], '' ORDER BY from_byte) AS kept FROM piece GROUP BY doc_id
), n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN rest USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)
), rep AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM rep
), tok AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM tok ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
