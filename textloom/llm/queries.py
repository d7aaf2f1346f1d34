"""The queries opN_<name> over whole tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, hilbert_sharding, language_id, packing, quality_rules, simhash, sstable, substring_dedup, toxicity, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_sharding.hilbert_shards(_table(spark, sf_dir, "documents"), shards=16)


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "spans")


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op6_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_quality(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(_table(spark, sf_dir, "pages"))


def op8_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(_table(spark, sf_dir, "documents"), end_id=2)


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_substring_dedup,
        op2_hilbert_sharding,
        op3_crf_toxicity,
        op4_bm25_packing,
        op5_simhash_near_dedup,
        op6_repetition_quality,
        op7_url_filter,
        op8_sstable_shards,
        op9_spaced_seed_decontamination,
        op10_bigru_language,
    )
    return {f.__name__: f for f in found}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH docs AS (SELECT doc_id, {WORDS} AS ws FROM documents),
wins AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM docs)
),
firsts AS (SELECT h, min(row(doc_id, s)) AS f FROM wins GROUP BY h),
gone AS (SELECT doc_id, s FROM wins JOIN firsts USING (h) WHERE row(doc_id, s) > f),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM docs),
marked AS (
  SELECT word.doc_id, w, i,
    coalesce(max(g.s) OVER (PARTITION BY word.doc_id ORDER BY i ROWS 19 PRECEDING), -1) >= 0 AS removed
  FROM word LEFT JOIN gone g ON g.doc_id = word.doc_id AND g.s = word.i
),
kept AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed,
    coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT removed), '') AS t
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def _op6_sql() -> str:
    grams = quality_rules.NGRAMS
    windows, covered, sums, joins = [], [], [], []
    for n in grams:
        windows.append(
            f"g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS often, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS later "
            f"FROM (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM docs)))"
        )
        over = f"OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS {n - 1} PRECEDING)"
        covered.append(f"coalesce(bool_or(g{n}.later) {over}, false) AS d{n}")
        if n == quality_rules.REPEAT_GRAM:
            covered.append(f"coalesce(bool_or(g{n}.often) {over}, false) AS often")
        joins.append(f"LEFT JOIN g{n} ON g{n}.doc_id = word.doc_id AND g{n}.i = word.i")
        sums.append(f"coalesce(sum(c) FILTER (d{n}), 0)::BIGINT AS dup_{n}gram_chars")
    bad = " OR ".join(f"dup_{n}gram_chars > {limit} * word_chars" for n, limit in grams.items())
    names = ", ".join(quality_rules.NAMES)
    return rf"""
WITH docs AS (SELECT doc_id, text, {WORDS} AS ws FROM documents),
word AS (SELECT doc_id, unnest(list_transform(ws, lambda w: length(w))) AS c, unnest(range(1, len(ws) + 1)) AS i FROM docs),
{", ".join(windows)},
marked AS (SELECT word.doc_id, c, {", ".join(covered)} FROM word {" ".join(joins)}),
grams AS (SELECT doc_id, sum(c)::BIGINT AS word_chars, count(*) FILTER (often) AS n_repeat_words, {", ".join(sums)} FROM marked GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: length(w))) AS c, row_number() OVER (PARTITION BY doc_id, line) > 1 AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dups AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(c) FILTER (dup), 0)::BIGINT AS dup_line_chars FROM lines GROUP BY doc_id),
found AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
    {", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in grams)}
  FROM docs d LEFT JOIN grams g ON g.doc_id = d.doc_id LEFT JOIN dups u ON u.doc_id = d.doc_id
),
judged AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words AS base_failed FROM found)
SELECT doc_id, {names}, base_failed, NOT base_failed AND NOT (dup_line_chars > {quality_rules.LINES} * word_chars OR {bad}) AS kept FROM judged
"""


def _like(glob: str) -> str:
    text = glob.replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("*", "%").replace("?", "_")
    return f"url LIKE '{text}' ESCAPE '!'"


def _op7_sql() -> str:
    ordered = sorted(url_filters.RULES, key=lambda r: -len(r[1]))
    fits = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in ordered]
    test = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, _, h, p in fits]
    rule = " ".join(f"WHEN {t} THEN '{r}'" for t, (_, r, _, _) in zip(test, fits, strict=True))
    verdict = " ".join(f"WHEN {t} THEN '{v}'" for t, (v, *_) in zip(test, fits, strict=True))
    globs = " OR ".join(map(_like, url_filters.GLOBS))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    return rf"""
WITH rest AS (
  SELECT page_id, regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^?#]*') AS r FROM pages
),
split AS (SELECT page_id, {lower("regexp_extract(coalesce(r, ''), '^[^/]*')")} AS host, substr(coalesce(r, ''), length(regexp_extract(coalesce(r, ''), '^[^/]*')) + 1) AS path FROM rest),
whole AS (SELECT *, host || {lower("path")} AS url FROM split)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM whole
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op6_repetition_quality": _op6_sql(), "op7_url_filter": _op7_sql()}
