"""The corpus operators' registered queries and, where SQL can express them, their DuckDB SQL.

Further queries show the base figures of quality rules, secret scans, whitening and language-model scoring alone, which SQL can express; what the
operators' methods add to them, models, decoders and eigenvectors, it cannot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, common, html, lm_scoring, packing, quality, resampling, secrets, simhash, toxicity, warc, whitening, wordpiece


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    untrained = quality.Model(np.zeros(quality.FAMILIES << quality.BITS, np.float32))
    return quality.judge(common.table(spark, sf_dir, "documents"), untrained).drop("quality", "kept")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op4_secrets(spark, sf_dir).drop("spans")


QUERIES = {
    "op1_html": html.op1_html,
    "op2_token_counts": wordpiece.op2_token_counts,
    "op3_quality": quality.op3_quality,
    "op4_secrets": secrets.op4_secrets,
    "op5_simhash": simhash.op5_simhash,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_warc": warc.op7_warc,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ann": ann.op10_ann,
    "op11_whitening": whitening.op11_whitening,
    "op12_resampling": resampling.op12_resampling,
    "op13_lm_scoring": lm_scoring.op13_lm_scoring,
    "quality_base": quality_base,
    "secrets_base": secrets_base,
    "whitening_base": whitening.whitening_base,
    "lm_base": lm_scoring.lm_base,
}

QUALITY_BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
  g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
  again AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
  r AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
  f AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f"""


def _spans_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: where matches start follows from the lengths of what stands between them."""
    return f"""SELECT rid, '{kind}' AS kind, {order} AS o, a AS start, a + length(m) AS stop FROM (SELECT rid, m, sum(length(gap)) OVER before + sum(length(m)) OVER before - length(m) AS a
      FROM (SELECT rid, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(list_slice(regexp_split_to_array(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}')))) AS gap, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM d)
      WINDOW before AS (PARTITION BY rid ORDER BY i)) WHERE length(regexp_extract(m, '{pattern}', {group})) >= {least}"""


_KEY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
SECRETS_BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
  s AS ({_spans_sql('assign', 0, _KEY + '["' + "'']?" + r'\x20*[:=]\x20*["' + "'']?([A-Za-z0-9+/_.=-]+)", 2, 6)}
    UNION ALL {_spans_sql('access', 1, 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_spans_sql('hex', 2, '[0-9a-f]{24,}', 0, 24)}),
  g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nk, count(*) FILTER (kind = 'hex') AS nh, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nk, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (rid)"""

WARC_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
  k AS (SELECT hex, max(page_id) AS keeper FROM d GROUP BY hex)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d JOIN k USING (hex)"""

SQL: dict[str, str] = {"op7_warc": WARC_SQL, "op12_resampling": resampling.SQL, "whitening_base": whitening.BASE_SQL, "lm_base": lm_scoring.BASE_SQL, "quality_base": QUALITY_BASE_SQL, "secrets_base": SECRETS_BASE_SQL}
