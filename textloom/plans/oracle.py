"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from textloom import lexicon
from textloom.operators import report, scan, score
from textloom.plans.planted import SQL as SRC
from textloom.plans.planted import quoted

SQL: dict[str, str] = {}


def _replaced(x: str, rules) -> str:
    for a, b in rules:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


#: White space of all kinds; \s alone would be ASCII only.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^{WS}]+'))"


def norm(src: str, out: str) -> str:
    """CTEs that normalise column t of src."""
    r = lambda x, a, b: f"regexp_replace({x}, '{a}', {b}, 'g')"
    one = r(r(r(r("t", r"\r\n?", "chr(10)"), r"```[\s\S]*?```", "' '"), "`([^`]+)`", r"'\1'"), r"\\[a-zA-Z]+\{([^}]*)\}", r"'\1'")
    two = r(r(_replaced("t", lexicon.LATEX), r"\\[a-zA-Z]+", "' '"), r"[\$\^_{}\[\]\\]", "' '")
    three = _replaced("t", lexicon.TYPOGRAPHY + lexicon.MATH + lexicon.GREEK)
    odd = r"[\x00-\x08\x0B-\x1F\x7F-\x{A0}\x{AD}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}]"
    four = r(r("t", odd, "''"), r"[^\p{L}\p{N}_\s.,;:!?\-''\"]", "' '")
    five = strip(r(r(r("t", r"[ \t]+", "' '"), r"\s+([.,;:!?])", r"'\1'"), r"\n{3,}", "chr(10) || chr(10)"))
    steps = [one, two, three, four, five]
    names = [src, *(f"{out}_{i}" for i in range(1, len(steps))), out]
    return ",\n".join(f"{names[i + 1]} AS (SELECT * REPLACE ({e} AS t) FROM {names[i]})" for i, e in enumerate(steps))


def detector_sentences(x: str) -> str:
    x = strip(rf"regexp_replace({x}, '([a-z])([A-Z])', '\1. \2', 'g')")
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])[{WS}]+', '\1' || chr(30), 'g'), chr(30)), lambda s: {strip('s')}), lambda s: {words('s')} >= 2)"


def paragraphs(x: str) -> str:
    """Paragraphs as a list of strings, blank ones included."""
    return rf"list_transform(string_split_regex({strip(x)}, '\n[{WS}]*\n'), lambda p: {strip('p')})"


def chunk_sentences(x: str) -> str:
    x = rf"regexp_replace({x}, '([a-z0-9])\.([A-Z])', '\1. \2', 'g')"
    for a, b in (("e", "g"), ("i", "e")):
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])((?i:{a}))\.((?i:{b}))\.', '\1\2§DOT§\3§DOT§', 'g')"
    one = "|".join(a[:-1] for a in lexicon.ABBREVIATIONS if a.count(".") == 1)
    x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])((?i:{one}))\.', '\1\2§DOT§', 'g')"
    x = rf"string_split(regexp_replace({x}, '([.!?])([{WS}\"''])', '\1' || chr(30) || '\2', 'g'), chr(30))"
    return rf"list_filter(list_transform({x}, lambda s: {strip('replace(s, ' + quoted('§DOT§') + ', ' + quoted('.') + ')')}), lambda s: {words('s')} >= 2)"


def table_of(m: dict[str, int]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {v}" for k, v in m.items()) + "}"


AI, HUMAN = table_of(lexicon.AI_TENTHS), table_of(lexicon.HUMAN_TENTHS)
TOKENS = r"regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')"
CANNED_IN = "list_filter([" + ", ".join(rf"CASE WHEN contains(lower(t), {quoted(p)}) AND regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}_]){p.replace(chr(39), chr(39) * 2)}($|[^\p{{L}}\p{{N}}_])') THEN {quoted(p)} END" for p in lexicon.CANNED) + "], lambda p: p IS NOT NULL)"


def in_list(m: dict[str, int]) -> str:
    return f"list_filter(tk, lambda x: list_contains([{', '.join(map(quoted, m))}], x))"


#: CTEs from clean to scored.
FEATURES = (
    "WITH " + SRC + ",\n" + norm("src", "clean") + f""",
f1 AS (SELECT doc_id, t, {TOKENS} AS tk, {detector_sentences('t')} AS sn, {CANNED_IN} AS canned FROM clean),
f2 AS (SELECT *, len(tk) AS n, len(sn) AS k, list_transform(sn, lambda s: {words('s')}) AS wc, {in_list(lexicon.AI_TENTHS)} AS ai, {in_list(lexicon.HUMAN_TENTHS)} AS human FROM f1),
f3 AS (SELECT *, coalesce(list_sum(wc), 0)::BIGINT AS sx, coalesce(list_sum(list_transform(wc, lambda x: x * x)), 0)::BIGINT AS sxx,
  coalesce(list_sum(list_transform(ai, lambda x: ({AI})[x])), 0)::BIGINT AS ait, coalesce(list_sum(list_transform(human, lambda x: ({HUMAN})[x])), 0)::BIGINT AS humant FROM f2),
f4 AS (SELECT *, CASE WHEN k >= 2 THEN sqrt((k::DOUBLE * sxx - sx * sx) / (k::DOUBLE * (k::DOUBLE - 1))) ELSE 0.0::DOUBLE END AS std, CASE WHEN n > 0 THEN len(list_distinct(tk)) / n::DOUBLE ELSE 0.0::DOUBLE END AS ttr FROM f3),
f AS (SELECT *, CASE WHEN k >= 2 AND sx > 0 THEN std / (sx / k::DOUBLE) ELSE 0.0::DOUBLE END AS cv FROM f4),
o1 AS (SELECT doc_id, unnest(sn) AS s, generate_subscripts(sn, 1) AS i FROM f),
o2 AS (SELECT doc_id, lower(regexp_extract(s, '^\\S+')) AS o, i FROM o1),
o3 AS (SELECT doc_id, o, count(*) AS n, min(i) AS first FROM o2 GROUP BY doc_id, o),
mode AS (SELECT doc_id, o, n AS m FROM o3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1),
l1 AS (SELECT f.*, o, m, (k >= 3 AND cv < 0.35) AS uniform, (k >= 2 AND cv > 0.60 AND NOT (k >= 3 AND cv < 0.35)) AS varied, (ttr >= 0.60 AND ttr <= 0.80 AND n > 50) AS formal,
  coalesce(k >= 4 AND m / k::DOUBLE > 0.35 AND o IN ('the', 'in', 'it', 'this'), FALSE) AS opens FROM f LEFT JOIN mode ON f.doc_id = mode.doc_id),
l AS (SELECT *, -1.0::DOUBLE + CASE WHEN len(ai) > 0 THEN ait / 10.0::DOUBLE / sqrt(n::DOUBLE) * 3.6::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN len(human) > 0 THEN humant / 10.0::DOUBLE / sqrt(n::DOUBLE) * 3.0::DOUBLE ELSE 0.0::DOUBLE END
  + len(canned) * 1.5::DOUBLE + CASE WHEN uniform THEN 1.2::DOUBLE WHEN varied THEN -1.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN formal THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN opens THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS logit FROM l1),
s0 AS (SELECT *, CASE WHEN n < 15 THEN 0 ELSE round_even(100 * (1 / (1 + exp(-logit))), 0)::INT END AS score FROM l),
s AS (SELECT *, CASE WHEN n < 15 THEN 'TOO SHORT' WHEN score >= 65 THEN 'LIKELY AI-GENERATED' WHEN score >= 40 THEN 'INCONCLUSIVE / MIXED' ELSE 'LIKELY HUMAN-WRITTEN' END AS verdict FROM s0)
"""
)
SPACED = "WITH " + SRC + ", spaced AS (SELECT doc_id, replace(t, chr(10), chr(10) || chr(10)) AS t FROM src)"
PARAGRAPHS = SPACED + f""",
p1 AS (SELECT doc_id, {paragraphs('t')} AS ps FROM spaced), p2 AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS paragraph_id FROM p1),
p AS (SELECT doc_id, paragraph_id, text, {chunk_sentences('text')} AS ss FROM p2 WHERE text <> '')
"""
SENTENCES = PARAGRAPHS + f""",
c0 AS (SELECT doc_id, paragraph_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS index_in_para FROM p),
c AS (SELECT *, 'p' || paragraph_id || '_s' || index_in_para AS sentence_id, {words('text')} AS word_count FROM c0)
"""
SCORED = SENTENCES + ", cs AS (SELECT *, text AS t FROM c),\n" + norm("cs", "cn") + f""",
e1 AS (SELECT *, {TOKENS} AS tk, {CANNED_IN} AS canned FROM cn),
e2 AS (SELECT *, len(tk) AS n, {in_list(lexicon.AI_TENTHS)} AS ai, {in_list(lexicon.HUMAN_TENTHS)} AS human FROM e1),
e3 AS (SELECT *, CASE WHEN n < 3 THEN 10 ELSE greatest(0, least(100, 25 + least(len(ai) * 22, 50) + len(canned) * 25 - least(len(human) * 20, 40) + CASE WHEN n > 28 AND len(human) = 0 THEN 15 ELSE 0 END)) END::INT AS ai_score FROM e2),
e AS (SELECT *, ai_score >= 60 AS is_flagged, CASE WHEN ai_score >= 65 THEN 'high' WHEN ai_score >= 40 THEN 'medium' ELSE 'low' END AS severity FROM e3)
"""

SQL["token_stats"] = f"SELECT doc_id, len(tk)::BIGINT AS n_tokens, len(list_distinct(tk))::BIGINT AS n_distinct, CASE WHEN len(tk) > 0 THEN len(list_distinct(tk)) / len(tk)::DOUBLE ELSE 0.0::DOUBLE END AS ttr FROM (SELECT doc_id, {TOKENS.replace('lower(t)', 'lower(text)')} AS tk FROM documents)"
SQL["token_frequency"] = f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({TOKENS.replace('lower(t)', 'lower(text)')}) AS token FROM documents) GROUP BY token"
SQL["sentences"] = f"WITH {SRC}, x AS (SELECT doc_id, {detector_sentences('t')} AS sn FROM src) SELECT doc_id, generate_subscripts(sn, 1) - 1 AS pos, unnest(sn) AS sentence FROM x"
SQL["burstiness"] = FEATURES + "SELECT doc_id, k::BIGINT AS n_sentences, std AS stddev, cv FROM s"
SQL["opener_mode"] = FEATURES + "SELECT doc_id, o AS opener, m::BIGINT AS n FROM mode"
SQL["marker_hits"] = FEATURES + "SELECT doc_id, kind, token, count(*) AS n FROM (SELECT doc_id, 'ai' AS kind, unnest(ai) AS token FROM s UNION ALL SELECT doc_id, 'human', unnest(human) FROM s) GROUP BY doc_id, kind, token"
SQL["marker_weights"] = FEATURES + "SELECT doc_id, ait AS ai_tenths, humant AS human_tenths, len(ai)::BIGINT AS n_ai, len(human)::BIGINT AS n_human FROM s"
SQL["robotic_phrases"] = FEATURES + "SELECT doc_id, generate_subscripts(canned, 1)::BIGINT AS place, unnest(canned) AS phrase FROM s"
SQL["passage_logit"] = FEATURES + "SELECT doc_id, logit FROM s WHERE n >= 15"
SQL["passage_score"] = FEATURES + "SELECT doc_id, score AS ai_score, verdict FROM s"
SQL["verdict_counts"] = FEATURES + "SELECT verdict, count(*) AS n, min(score) AS least, max(score) AS most FROM s GROUP BY verdict"
SQL["normalized"] = "WITH " + SRC + ",\n" + norm("src", "clean") + " SELECT doc_id, t AS clean FROM clean"
SQL["paragraphs"] = PARAGRAPHS + "SELECT doc_id, paragraph_id, text, len(ss)::BIGINT AS n_sentences FROM p"
SQL["chunk_sentences"] = SENTENCES + "SELECT doc_id, paragraph_id, index_in_para, sentence_id, text, word_count::BIGINT AS word_count FROM c"
SQL["chunk_totals"] = PARAGRAPHS + f"SELECT doc_id, count(*) AS total_paragraphs, sum(len(ss))::BIGINT AS total_sentences, sum(coalesce(list_sum(list_transform(ss, lambda s: {words('s')})), 0))::BIGINT AS total_words FROM p GROUP BY doc_id"
SQL["reassemble"] = PARAGRAPHS + "SELECT doc_id, string_agg(array_to_string(ss, ' '), chr(10) || chr(10) ORDER BY paragraph_id) AS text FROM p WHERE len(ss) > 0 GROUP BY doc_id"
SQL["cleaned_text"] = PARAGRAPHS + "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_id) AS text FROM p GROUP BY doc_id"
SQL["text_preview"] = "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS text_preview FROM documents"
SQL["sentence_scores"] = SCORED + "SELECT doc_id, sentence_id, ai_score, severity, is_flagged FROM e"
SQL["heatmap"] = SCORED + "SELECT doc_id, paragraph_id::INT AS paragraph_id, index_in_para::INT AS index_in_para, sentence_id, text, ai_score, severity, is_flagged, CASE WHEN n < 3 THEN '' ELSE array_to_string(list_sort(list_distinct(ai)), ',') END AS ai_markers, CASE WHEN n < 3 THEN '' ELSE array_to_string(canned, ',') END AS robotic_phrases FROM e"
SQL["paragraph_rollup"] = SCORED + """,
r AS (SELECT doc_id, paragraph_id, sum(word_count) AS w, count(*) AS k, sum(ai_score) AS points FROM e GROUP BY doc_id, paragraph_id),
g AS (SELECT p.doc_id, p.paragraph_id::INT AS paragraph_id, coalesce(w, 0)::INT AS word_count, coalesce(k, 0)::INT AS sentence_count, coalesce(round_even(points / k::DOUBLE, 0), 0)::INT AS ai_score, text FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.paragraph_id = r.paragraph_id)
SELECT doc_id, paragraph_id, word_count, sentence_count, ai_score, CASE WHEN ai_score >= 65 THEN 'HIGH RISK' WHEN ai_score >= 40 THEN 'MODERATE' ELSE 'CLEAN' END AS verdict, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS text_preview FROM g"""
_HOLISTIC = FEATURES.replace("WITH " + SRC + ",\n", "").replace("src_", "x_").replace("FROM src)", "FROM whole)")
DOCUMENTS = (
    SCORED + ", whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_id) AS t FROM p GROUP BY doc_id),\n" + _HOLISTIC + """,
w AS (SELECT doc_id, sum(word_count)::INT AS total_words, count(*)::INT AS total_sentences, sum(ai_score) AS points, count(*) FILTER (WHERE ai_score >= 65)::INT AS flagged FROM e GROUP BY doc_id),
q AS (SELECT doc_id, count(*)::INT AS total_paragraphs FROM p GROUP BY doc_id),
d AS (SELECT src.doc_id, coalesce(total_words, 0) AS total_words, coalesce(total_paragraphs, 0) AS total_paragraphs, coalesce(total_sentences, 0) AS total_sentences, coalesce(points, 0) AS points, coalesce(flagged, 0) AS flagged, coalesce(score, 0) AS holistic FROM src LEFT JOIN w ON src.doc_id = w.doc_id LEFT JOIN q ON src.doc_id = q.doc_id LEFT JOIN s ON src.doc_id = s.doc_id),
z AS (SELECT *, CASE WHEN total_words < 15 THEN 0.0::DOUBLE ELSE flagged / greatest(total_sentences, 1)::DOUBLE END AS ratio FROM d),
y AS (SELECT *, CASE WHEN total_words < 15 THEN 0 ELSE greatest(0, least(100, round_even(holistic * 0.5::DOUBLE + points / greatest(total_sentences, 1)::DOUBLE * 0.3::DOUBLE + ratio * 100 * 0.2::DOUBLE, 0))) END::INT AS overall_score FROM z)
"""
)
SQL["document_scan"] = DOCUMENTS + """SELECT doc_id, overall_score, CASE WHEN total_words < 15 THEN 'TOO SHORT' WHEN overall_score >= 65 THEN 'LIKELY AI-GENERATED' WHEN overall_score >= 40 THEN 'INCONCLUSIVE / MIXED' ELSE 'LIKELY HUMAN-WRITTEN' END AS verdict, total_words, total_paragraphs, total_sentences, CASE WHEN total_words < 15 THEN 0 ELSE flagged END::INT AS flagged_ai_sentence_count, ratio AS flagged_ratio FROM y"""


def shingles(table: str, key: str, k: int = 5) -> str:
    run = ", ".join(f"tk[p + {i + 1}]" for i in range(k))
    return rf"tok_{table} AS (SELECT {key} AS doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS tk FROM {table}), pos_{table} AS (SELECT doc_id, tk, unnest(range(len(tk)::BIGINT - {k - 1})) AS p FROM tok_{table}), sh_{table} AS (SELECT doc_id, p AS pos, left(md5(concat_ws(' ', {run})), 16) AS hash FROM pos_{table})"


def winnowed(table: str, key: str, w: int = 4) -> str:
    return shingles(table, key) + f""", win_{table} AS (SELECT doc_id, min((hash, -pos)) OVER f AS best, count(*) OVER f AS n FROM sh_{table} WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)),
fp_{table} AS (SELECT DISTINCT doc_id, best[1] AS hash, -best[2] AS pos FROM win_{table} WHERE n = {w})"""


MATCHES = "WITH " + winnowed("documents", "doc_id") + ",\n" + winnowed("benchmark", "item_id") + """,
q AS (SELECT DISTINCT doc_id AS query_id, hash FROM fp_documents), t AS (SELECT query_id, count(*) AS total FROM q GROUP BY query_id),
m AS (SELECT q.query_id, b.doc_id, count(*) AS shared, list_sort(list(b.pos)) AS positions FROM q JOIN fp_benchmark b ON q.hash = b.hash GROUP BY q.query_id, b.doc_id),
r AS (SELECT m.*, total, shared / total::DOUBLE AS similarity FROM m JOIN t ON m.query_id = t.query_id)
"""
SQL["shingles"] = "WITH " + shingles("documents", "doc_id") + " SELECT doc_id, pos, hash FROM sh_documents"
SQL["fingerprints"] = "WITH " + winnowed("documents", "doc_id") + " SELECT doc_id, pos, hash FROM fp_documents"
SQL["postings"] = "WITH " + winnowed("benchmark", "item_id") + " SELECT hash, doc_id, pos FROM fp_benchmark"
SQL["plagiarism_matches"] = MATCHES + "SELECT query_id, doc_id, similarity, shared, total FROM r"
SQL["matched_positions"] = MATCHES + "SELECT query_id, doc_id, array_to_string(positions[1:10], ',') AS positions FROM r"
SQL["shared_hashes"] = MATCHES + "SELECT query_id, sum(shared)::BIGINT AS shared_hashes FROM r GROUP BY query_id"
SQL["fingerprint_rank"] = MATCHES + "SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM r"
_UNIT = "SELECT vec_id, list_transform(v, lambda x: x / norm) AS u FROM (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"
_KNN = f"WITH u AS ({_UNIT}), x AS (SELECT q.vec_id AS query_id, i.vec_id AS match_id, list_reduce(list_transform(list_zip(q.u, i.u), lambda z: z[1] * z[2]), lambda a, b: a + b) AS similarity FROM u q JOIN u i ON q.vec_id % 50 = 0"
_RANK = "), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id) AS rank FROM x) SELECT query_id, match_id, rank, similarity FROM r WHERE rank <= 3"
SQL["knn_topk"] = _KNN + _RANK
SQL["knn_threshold"] = _KNN + " AND q.vec_id <> i.vec_id" + _RANK + " AND similarity >= 0.3"


def semantic(by: str) -> str:
    x = rf"list_filter(list_transform(string_split(regexp_replace({strip('text')}, '([.!?]){by}', '\1' || chr(30), 'g'), chr(30)), lambda s: {strip('s')}), lambda s: {words('s')} >= 4)"
    return f"SELECT doc_id, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS chunk FROM (SELECT doc_id, {x} AS c FROM documents)"


SQL["semantic_chunks"], SQL["semantic_chunks_by_space"] = semantic(f"[{WS}]+"), semantic(" +")


def contracted(x: str) -> str:
    """Each rule's first place; RE2 knows no look-behind, so the sign before goes along."""
    for a, b in lexicon.CONTRACTIONS:
        before, after = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
        lower, upper = rf"{before}{a[0]}(?i:{a[1:]}){after}", rf"{before}{a[0].upper()}(?i:{a[1:]}){after}"
        low, up = rf"'\1{b.replace(chr(39), chr(39) * 2)}\2'", rf"'\1{b.capitalize().replace(chr(39), chr(39) * 2)}\2'"
        first = rf"regexp_extract({x}, '{before}((?i:{a})){after}', 2)"
        x = f"CASE WHEN left({first}, 1) = '{a[0]}' THEN regexp_replace({x}, '{lower}', {low}) WHEN left({first}, 1) = '{a[0].upper()}' THEN regexp_replace({x}, '{upper}', {up}) ELSE {x} END"
        yield x
        x = "s"


_c = "x0 AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS s FROM (SELECT doc_id, " + chunk_sentences("t") + " AS ss FROM src)), y0 AS (SELECT doc_id, pos, s, s AS raw FROM x0)"
for _i, _e in enumerate(contracted("s")):
    _c += f", y{_i + 1} AS (SELECT doc_id, pos, {_e} AS s, raw FROM y{_i})"
SQL["rectify_contractions"] = f"WITH {SRC}, {_c} SELECT doc_id, pos, CASE WHEN contains(raw, '\"') OR contains(raw, '''') OR {words('raw')} <= 6 THEN raw ELSE s END AS text FROM y{len(lexicon.CONTRACTIONS)}"

_LIST = lambda c: f"'[''' || array_to_string({c}, ''', ''') || ''']'"
_UNIQ = lambda c: f"list_sort(list_distinct({c}))"
REASONS = f"""list_filter([CASE WHEN len(ai) > 0 THEN 'AI academic/rhetorical markers detected: ' || {_LIST(_UNIQ('ai'))} END, CASE WHEN len(human) > 0 THEN 'Colloquial human phrasing detected: ' || {_LIST(_UNIQ('human'))} END,
CASE WHEN len(canned) > 0 THEN 'Typical LLM canned phrases detected: ' || {_LIST('canned')} END, CASE WHEN uniform THEN printf('Uniform sentence cadence (CV: %.2f)', cv) WHEN varied THEN printf('High human rhythm variance (CV: %.2f)', cv) END,
CASE WHEN formal THEN printf('Controlled lexical dispersion ratio (%.2f)', ttr) END, CASE WHEN opens THEN printf('Monotonous sentence openers (%s: %d%%)', upper(left(o, 1)) || o[2:], floor(m / k::DOUBLE * 100)::BIGINT) END], lambda x: x IS NOT NULL)"""
SQL["reports"] = FEATURES + f""", a AS (SELECT *, CASE WHEN n < 15 THEN ['Text too short for reliable statistical evaluation (min 15 words)'] ELSE {REASONS} END AS reasons FROM s)
SELECT doc_id, array_to_string(list_filter(['Verdict: ' || verdict || ' (confidence: ' || score || '%)', CASE WHEN n > 0 THEN 'Word count: ' || n END, CASE WHEN k > 0 THEN 'Sentences analyzed: ' || k END,
CASE WHEN n >= 15 THEN printf('Burstiness CV: %.3f (human ~0.7+, AI ~0.3-0.4)', printf('%.4f', cv)::DOUBLE) END, CASE WHEN n >= 15 THEN printf('Type-token ratio: %.3f', printf('%.4f', ttr)::DOUBLE) END,
CASE WHEN n >= 15 AND len(ai) > 0 THEN 'AI markers found: ' || array_to_string({_UNIQ('ai')}[1:10], ', ') END, CASE WHEN n >= 15 AND len(human) > 0 THEN 'Human markers found: ' || array_to_string({_UNIQ('human')}[1:10], ', ') END,
CASE WHEN len(reasons) > 0 THEN chr(10) || 'Reasons:' || chr(10) || array_to_string(list_transform(reasons[1:6], lambda r: '  - ' || r), chr(10)) END], lambda x: x IS NOT NULL), chr(10)) AS report FROM a"""
TIPS = f"""array_to_string(list_concat(list_concat(list_filter([CASE WHEN n < 15 OR printf('%.4f', cv)::DOUBLE < 0.5 THEN {quoted(report.TIP_LENGTHS)} END, CASE WHEN n >= 15 AND printf('%.4f', ttr)::DOUBLE > 0.75 THEN {quoted(report.TIP_VARIED)} END], lambda x: x IS NOT NULL),
CASE WHEN n < 15 THEN [] ELSE list_transform(list_filter({_UNIQ('ai')}[1:6], lambda x: list_contains([{', '.join(map(quoted, lexicon.WORD_REWRITES))}], x)), lambda x: 'Replace ''' || x || ''' with ''' || (MAP {{{', '.join(f'{quoted(a)}: {quoted(b)}' for a, b in lexicon.WORD_REWRITES.items())}}})[x] || '''') END), [{quoted(report.TIP_ALWAYS)}]), chr(10))"""
SQL["fix_tips"] = FEATURES + f"SELECT doc_id, {TIPS} AS tips FROM s"
SQL["premium_gate"] = FEATURES + f"SELECT doc_id, 'u' || (doc_id % 7) AS user_id, doc_id % 7 IN (0, 2, 4) AS premium, CASE WHEN doc_id % 7 IN (0, 2, 4) AND score >= 65 THEN {TIPS} END AS fix FROM s"
SQL["extract_text"] = r"SELECT conv_id, turn, text FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 'plain: ' || replace(text, '\"', '''') ELSE coalesce(text, '') END AS text FROM conversations) WHERE regexp_replace(text, '\s', '', 'g') <> ''".replace('\\"', '"')
SQL["json_sink"] = "SELECT '{\"doc_id\":' || doc_id || ',\"n\":' || length(text) || '}' AS json FROM documents"
SQL["distinct_sentences"] = f"SELECT text, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({chunk_sentences('p')}) AS text FROM (SELECT doc_id, unnest({paragraphs('text')}) AS p FROM documents) WHERE p <> '') GROUP BY text HAVING count(*) > 1"

_LISTS = ", ".join(f"CASE WHEN n >= 15 THEN array_to_string({x}, ',') END AS {name}" for x, name in ((_UNIQ("ai"), "ai_markers_found"), (_UNIQ("human"), "human_markers_found"), ("canned", "robotic_phrases_found")))
SQL["detection_metrics"] = FEATURES + f"""SELECT doc_id, score AS ai_score, verdict, CASE WHEN n >= 15 THEN printf('%.4f', cv)::DOUBLE END AS burstiness_cv, CASE WHEN n >= 15 THEN printf('%.4f', ttr)::DOUBLE END AS type_token_ratio,
k::INT AS sentence_count, n::INT AS word_count, {_LISTS} FROM s"""
SQL["full_scan_counts"] = (
    DOCUMENTS + ", sp AS (SELECT doc_id, t AS text FROM spaced),\n" + winnowed("sp", "doc_id") + ",\n" + winnowed("benchmark", "item_id") + f""",
n_x AS (SELECT q.doc_id, count(DISTINCT b.doc_id) AS n FROM fp_sp q JOIN fp_benchmark b ON q.hash = b.hash GROUP BY q.doc_id),
n_r AS (SELECT doc_id, CASE WHEN n < 15 THEN 1 ELSE len({REASONS}) END AS n FROM s)
SELECT y.doc_id, overall_score, CASE WHEN total_words < 15 THEN 'TOO SHORT' WHEN overall_score >= 65 THEN 'LIKELY AI-GENERATED' WHEN overall_score >= 40 THEN 'INCONCLUSIVE / MIXED' ELSE 'LIKELY HUMAN-WRITTEN' END AS verdict,
CASE WHEN total_words < 15 THEN 0 ELSE flagged END::INT AS flagged_ai_sentence_count, CASE WHEN total_words < 15 THEN 0 ELSE total_paragraphs END::INT AS n_paragraphs, CASE WHEN total_words < 15 THEN 0 ELSE total_sentences END::INT AS n_sentences,
CASE WHEN total_words < 15 THEN 1 ELSE coalesce(n_r.n, 1) END::INT AS n_reasons, coalesce(n_x.n, 0)::INT AS n_exact FROM y LEFT JOIN n_x ON y.doc_id = n_x.doc_id LEFT JOIN n_r ON y.doc_id = n_r.doc_id"""
)
#: A fold over the sentences of a document carries the place at which the search goes on and the places found.
_STEP = "lambda a, x: {'s': '', 'at': CASE WHEN instr(substr(t, a.at + 1), x.s) > 0 THEN a.at + instr(substr(t, a.at + 1), x.s) - 1 ELSE a.at END + length(x.s), 'out': list_append(a.out, CASE WHEN instr(substr(t, a.at + 1), x.s) > 0 THEN a.at + instr(substr(t, a.at + 1), x.s) - 1 ELSE a.at END)}"
OFFSETS = SENTENCES + f""",
g1 AS (SELECT doc_id, list({{'s': text, 'at': 0::BIGINT, 'out': []::BIGINT[]}} ORDER BY paragraph_id, index_in_para) AS items, list({{'p': paragraph_id, 'i': index_in_para}} ORDER BY paragraph_id, index_in_para) AS keys FROM c GROUP BY doc_id),
g2 AS (SELECT spaced.doc_id, keys, list_reduce(list_prepend({{'s': '', 'at': 0::BIGINT, 'out': []::BIGINT[]}}, items), {_STEP}).out AS places FROM g1 JOIN spaced ON g1.doc_id = spaced.doc_id),
g3 AS (SELECT doc_id, unnest(keys) AS key, unnest(places) AS char_start FROM g2),
o AS (SELECT c.*, g3.char_start::INT AS char_start, (g3.char_start + length(c.text))::INT AS char_end FROM c JOIN g3 ON c.doc_id = g3.doc_id AND c.paragraph_id = g3.key.p AND c.index_in_para = g3.key.i)
"""
SQL["sentence_offsets"] = OFFSETS + "SELECT doc_id, paragraph_id::INT AS paragraph_id, index_in_para::INT AS index_in_para, sentence_id, text, word_count::INT AS word_count, char_start, char_end FROM o"
SQL["heatmap_with_offsets"] = (
    SCORED + OFFSETS[len(SENTENCES) :] + """SELECT e.doc_id, e.paragraph_id::INT AS paragraph_id, e.index_in_para::INT AS index_in_para, e.sentence_id, e.text, e.word_count::INT AS word_count, char_start, char_end, ai_score, is_flagged, severity,
CASE WHEN n < 3 THEN '' ELSE array_to_string(list_sort(list_distinct(ai)), ',') END AS ai_markers, CASE WHEN n < 3 THEN '' ELSE array_to_string(canned, ',') END AS robotic_phrases
FROM e JOIN o ON e.doc_id = o.doc_id AND e.paragraph_id = o.paragraph_id AND e.index_in_para = o.index_in_para"""
)
SQL["full_scan_contents"] = (
    DOCUMENTS + ", sp AS (SELECT doc_id, t AS text FROM spaced),\n" + winnowed("sp", "doc_id") + ",\n" + winnowed("benchmark", "item_id") + f""",
q_x AS (SELECT DISTINCT doc_id, hash FROM fp_sp), t_x AS (SELECT doc_id, count(*) AS total FROM q_x GROUP BY doc_id),
m_x AS (SELECT q.doc_id, b.doc_id::VARCHAR AS k, count(*) AS shared, any_value(total) AS total, array_to_string(list_sort(list(b.pos))[1:10], '+') AS places FROM q_x q JOIN t_x ON q.doc_id = t_x.doc_id JOIN fp_benchmark b ON q.hash = b.hash GROUP BY q.doc_id, b.doc_id),
e_x AS (SELECT doc_id, string_agg(k || ':' || shared || '/' || total || '@' || places, ';' ORDER BY k) AS exact FROM m_x GROUP BY doc_id),
h_x AS (SELECT doc_id, string_agg(sentence_id || ':' || ai_score || ':' || severity, ';' ORDER BY paragraph_id, index_in_para) AS heat FROM e GROUP BY doc_id),
r_x AS (SELECT doc_id, CASE WHEN n < 15 THEN {quoted(score.SHORT_REASON)} ELSE array_to_string({REASONS}, ';') END AS reasons FROM s)
SELECT y.doc_id, coalesce(exact, '') AS exact, CASE WHEN total_words < 15 THEN {quoted(scan.SHORT_REASON)} ELSE coalesce(reasons, {quoted(score.SHORT_REASON)}) END AS reasons, CASE WHEN total_words < 15 THEN '' ELSE coalesce(heat, '') END AS heatmap
FROM y LEFT JOIN e_x ON y.doc_id = e_x.doc_id LEFT JOIN h_x ON y.doc_id = h_x.doc_id LEFT JOIN r_x ON y.doc_id = r_x.doc_id"""
)
_FULL = f"regexp_matches(text, '[^{WS}]')"
SQL["library_registry"] = f"""
WITH b AS (SELECT item_id::VARCHAR AS doc_id, text FROM benchmark WHERE {_FULL}), d AS (SELECT doc_id::VARCHAR AS doc_id, text FROM documents WHERE {_FULL}),
r AS (SELECT * FROM d UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM d))
SELECT doc_id, text, len({TOKENS.replace('lower(t)', 'lower(text)')})::BIGINT AS n_tokens FROM r"""
_GROWN = winnowed("documents", "doc_id") + ",\n" + winnowed("benchmark", "item_id") + ",\nlib AS (SELECT hash, doc_id::VARCHAR AS doc_id, pos FROM fp_documents UNION SELECT hash, doc_id::VARCHAR, pos FROM fp_benchmark)"
SQL["library_postings"] = "WITH " + _GROWN + " SELECT hash, doc_id, pos FROM lib"
SQL["library_matches"] = "WITH " + _GROWN + """,
q AS (SELECT DISTINCT doc_id AS query_id, hash FROM fp_benchmark), n AS (SELECT query_id, count(*) AS total FROM q GROUP BY query_id)
SELECT q.query_id, lib.doc_id, count(*) / any_value(total)::DOUBLE AS similarity, count(*) AS shared, any_value(total) AS total, array_to_string(list_sort(list(lib.pos))[1:10], ',') AS positions
FROM q JOIN n ON q.query_id = n.query_id JOIN lib ON q.hash = lib.hash GROUP BY q.query_id, lib.doc_id"""
SQL["knn_pruned"] = SQL["knn_topk"]
SQL["distinct_token_sketches"] = f"SELECT source, count(DISTINCT token) AS n_tokens, TRUE AS close FROM (SELECT source, unnest({TOKENS.replace('lower(t)', 'lower(text)')}) AS token FROM documents) GROUP BY source"
