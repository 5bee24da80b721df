"""Queries of the distinct counts (problem 4) and the training-text problems 8 to 10, each over its whole tables, and
their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import contamination, mixing, multires, splitting
from tidewell.llm.tokens import TOKEN_RE2
from tidewell.sources.tables import load, spread


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents"), "doc_id")


def _leaks(spark: SparkSession, d: str, copies: bool = False) -> DataFrame:
    return contamination.leaks(_documents(spark, d), load(spark, d, "eval_items"), copies=copies)


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.sized(_documents(spark, d))
    return sizes, mixing.cuts(sizes, load(spark, d, "mix_targets"))


def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    return multires.distinct_counts(load(spark, d, "processed_events"), "uid", "event_date", "campaign_id")


def p4_error(spark: SparkSession, d: str) -> DataFrame:
    """Whether the estimates keep their bound, beside exact counts."""
    return multires.errors(load(spark, d, "processed_events"), "uid", "event_date", "campaign_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, copies=True).where(F.col("run") >= contamination.SPAN).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Copies, and paraphrases that keep most words of a passage, in order or nearly, and most of what they say."""
    return contamination.leaked(_leaks(spark, d))


def p8_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether nine of ten passages planted among the documents, copied or paraphrased, are found."""
    r = contamination.recall(_documents(spark, d), load(spark, d, "eval_items"))
    return r.select("kind", "n_planted", (F.col("n_found") >= 0.9 * F.col("n_planted")).alias("recall_kept"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose prefix sums, repeated as often as allowed, end before their budget."""
    return _plan(spark, d)[1].where("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_plan(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, plan = _plan(spark, d)
    return mixing.shares(mixing.mix(sizes, plan), plan)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(_documents(spark, d)).where(F.col("piece_no") == 0).select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(_documents(spark, d))


def p10_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the pieces put together again, by their digest."""
    r = splitting.rejoined(splitting.split_documents(_documents(spark, d)))
    return r.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), (F.col("most_tokens") <= splitting.LIMIT).alias("within_limit"))


QUERIES = {f.__name__: f for f in (p4_distinct, p4_error, p8_found, p8_leaks, p8_recall, p9_found, p9_mix, p9_shares, p10_found, p10_pieces, p10_rejoined)}



def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _words_sql(column: str) -> str:
    """``contamination.words`` in DuckDB's functions. Compatibility forms of the basic plane come from Python's tables."""
    forms = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x10000) if not (0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4)]
    one = [f for f in forms if f[0] != f[1] and len(f[1]) == 1]
    many = [_text(a + b) for a, b in forms if a != b and len(b) != 1]
    odd = "".join(map(chr, [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0])) + "\ufe00-\ufe0f"
    # the soft hyphen isn't removed with the invisible characters, as it may break a word at a line end
    t = f"regexp_replace(translate({column}, chr(173), chr(57344)), '[\\p{{Cf}}{odd}]', '', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}])[-\\x{{E000}}\\x{{2010}}\\x{{2011}}][ \\t\\r\\f\\v\\p{{Z}}]*\\n[\\s\\p{{Z}}]*([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g')"
    t = f"translate({t}, {_text(''.join(a for a, _ in one))}, {_text(''.join(b for _, b in one))})"
    t = f"list_reduce(list_concat([{t}], [{', '.join(many)}]), lambda a, x: replace(a, x[1], x[2:]))"
    t = f"regexp_replace(nfc_normalize(replace({t}, chr(57344), '')), '[(\\[]\\s*\\p{{Nd}}+(?:\\s*[,;.–-]\\s*\\p{{Nd}}+)*\\s*[)\\]]', ' ', 'g')"
    return f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"


def _leaks_sql() -> str:
    n = contamination.SPAN - 1
    grams = f"array_to_string(w[k:k + {n}], ' ') AS g"
    return f"""WITH d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE length(text) > 0), i AS (SELECT item_id, {_words_sql('text')} AS w FROM eval_items WHERE length(text) > 0),
 dg AS (SELECT doc_id, {grams} FROM d, unnest(range(1, len(w) - {n - 1})) AS r(k)), ig AS (SELECT DISTINCT item_id, {grams} FROM i, unnest(range(1, len(w) - {n - 1})) AS r(k))
 SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


_SIZED = f"n AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{TOKEN_RE2}')), 0) AS n FROM documents)"
_GRAIN = "SELECT '{0}' AS grain, count(*) AS n_groups, sum(n)::bigint AS exact_total, true AS within_bound FROM (SELECT count(DISTINCT uid) AS n FROM processed_events WHERE uid IS NOT NULL GROUP BY {1})"
_MIX = f"""WITH {_SIZED}, b AS (SELECT m.source, target_share, max_repeats, coalesce((SELECT sum(n) FROM n WHERE n.source = m.source), 0)::bigint AS available, (SELECT sum(n) FROM n)::bigint AS total FROM mix_targets m),
 p AS (SELECT *, target_share * total AS budget, coalesce(least(floor(target_share * total / nullif(available, 0)), max_repeats), 0)::bigint AS passes FROM b),
 r AS (SELECT *, CASE WHEN passes < max_repeats THEN budget - passes * available ELSE 0.0 END AS rest FROM p),
 k AS (SELECT doc_id, source, n, sum(n) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('{mixing.SEED}/' || doc_id || '/' || source), 1, {mixing.KEY_BITS // 4}))::bigint, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM n WHERE source IS NOT NULL),
 x AS (SELECT doc_id, source, n AS n_tokens, passes + (rest > 0 AND upto <= rest)::int AS repeats FROM k JOIN r USING (source)),
 mixed AS (SELECT * FROM x WHERE repeats > 0)"""
SQL = {
    "p4_error": " UNION ALL ".join(_GRAIN.format(*g) for g in (("all", "()"), ("event_date", "event_date"), ("campaign_id", "campaign_id"), ("event_date+campaign_id", "event_date, campaign_id"))),
    "p8_found": _leaks_sql(),
    "p8_recall": f"""WITH i AS (SELECT {_words_sql('text')} AS w FROM eval_items WHERE length(text) > 0), n AS (SELECT count(*) AS n_planted FROM i WHERE len(w) >= {contamination.PLANTED})
 SELECT kind, n_planted, true AS recall_kept FROM n, (VALUES {', '.join(f"('{k}')" for k in contamination.KINDS)}) AS k(kind)""",
    "p9_found": f"""WITH {_SIZED} SELECT source FROM mix_targets m
 WHERE max_repeats * (SELECT coalesce(sum(n), 0) FROM n WHERE n.source = m.source) < target_share * (SELECT sum(n) FROM n)""",
    "p9_mix": f"{_MIX} SELECT doc_id, source, n_tokens, repeats FROM mixed",
    "p9_shares": f"""{_MIX}, u AS (SELECT source, sum(n_tokens * repeats)::bigint AS used, count(*) AS n_docs, max(repeats) AS most FROM mixed GROUP BY source)
 SELECT r.source, target_share, round(coalesce(used, 0) / (SELECT sum(used) FROM u), 6) AS actual_share, coalesce(used, 0) AS used_tokens, available, max_repeats, coalesce(n_docs, 0) AS n_docs, coalesce(most, 0) AS most_repeats,
  max_repeats * available < budget AS short FROM r LEFT JOIN u ON u.source = r.source""",
    "p10_found": f"WITH {_SIZED} SELECT doc_id FROM n WHERE n > 1000",
    "p10_rejoined": f"WITH {_SIZED} SELECT doc_id, md5(text) AS text_md5, true AS within_limit FROM n WHERE n > 1000",
}
