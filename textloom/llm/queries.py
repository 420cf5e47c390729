"""The driver's queries over this package's operators, and their SQL where it can say them."""

from __future__ import annotations

from textloom.llm import exactdedup, licenses, mixing, negatives, warc
from textloom.llm.exactdedup import op13_exact_dedup
from textloom.llm.langid import op6_language_id
from textloom.llm.licenses import op3_license_scan
from textloom.llm.mixing import op5_mixing
from textloom.llm.neardup import op1_probminhash
from textloom.llm.negatives import op11_hard_negatives
from textloom.llm.pieces import op7_sentencepiece
from textloom.llm.quality import op9_quality_rules
from textloom.llm.secrets import op10_secret_scan
from textloom.llm.syncmers import op4_syncmers
from textloom.llm.tokenalign import op12_token_alignment
from textloom.llm.toxicity import op2_toxicity
from textloom.llm.warc import op8_warc

QUERIES = {
    "op1_probminhash": op1_probminhash,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_syncmers": op4_syncmers,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_exact_dedup": op13_exact_dedup,
}


def base_secrets(spark, sf_dir: str):
    """The counts of the base patterns of op10, which SQL can say."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_quality(spark, sf_dir: str):
    """The figures of op9's base rule, which SQL can say."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def edited_texts(spark, sf_dir: str):
    """What op4 does to texts before it fingerprints them, which SQL can say."""
    return op4_syncmers(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES |= {"base_secrets": base_secrets, "base_quality": base_quality, "edited_texts": edited_texts}
SQL: dict[str, str] = {"op3_license_scan": licenses.SQL, "op5_mixing": mixing.SQL, "op8_warc": warc.SQL, "op11_hard_negatives": negatives.SQL, "op13_exact_dedup": exactdedup.SQL}

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL["base_secrets"] = rf"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM documents
"""
SQL["base_quality"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM m GROUP BY doc_id),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w)::BIGINT - 1)) AS p FROM d)),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r WHERE n > 1) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
SQL["edited_texts"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS f FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, (length(t) - length(t) // 2)::BIGINT) || substr(f, 1, (length(t) // 2)::BIGINT)) AS edited_sha256 FROM n
"""
