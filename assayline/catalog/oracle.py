"""DuckDB SQL with the same results as the registered queries.

Written from the definitions, not from the Spark code: sentences are unnested rows, word
overlap is a join on words, ranks are window functions, and the exact tail probabilities are
finite sums.
"""

from __future__ import annotations

from . import fixtures as given

ORACLE: dict[str, str] = {}

# ASCII and Latin-1 white space is all the tables contain.
_SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)"


def r(x: str, digits: int = 4) -> str:
    """Round to the nearest decimal of the exact binary value."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _strip(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def _pieces(x: str) -> str:
    marked = f"regexp_replace({_strip(x)}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    return f"string_split({marked}, chr(1))"


def _sentences(name: str, source: str, column: str, keys: str) -> str:
    """Kept sentences with positions from 0."""
    return f"""{name}_pieces AS (
  SELECT {keys}, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT {keys}, {_pieces(column)} AS p FROM {source})),
{name} AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS pos,
         {_strip('piece')} AS s
  FROM {name}_pieces WHERE length({_strip('piece')}) > 10)"""


def _spaced(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _tokens(name: str, source: str, column: str, keys: str) -> str:
    """Distinct words per key."""
    return f"""{name} AS (
  SELECT DISTINCT {keys}, tok FROM (
    SELECT {keys}, unnest(string_split({_spaced(column)}, ' ')) AS tok FROM {source})
  WHERE tok <> '')"""


_TOX = "CASE WHEN toxic = 1 THEN 0.9::DOUBLE WHEN toxic = 0 THEN 0.05::DOUBLE ELSE 0.2::DOUBLE END"

# One row per scored text: (sample_id, slot, suite_id, lang, generated, source, prompt, tox).
# An even document has its own text as source, others the one after; that is the prompt.
SAMPLES = f"""outs AS (
  SELECT d.doc_id AS sample_id, 0 AS slot, d.source AS suite_id, d.lang, d.text AS generated,
         CASE WHEN d.doc_id % 2 = 0 THEN d.text ELSE coalesce(n.text, d.text) END AS source,
         coalesce(n.text, d.text) AS prompt, {_TOX} AS tox
  FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

PAIRS = f"""pairs AS (
  SELECT d.doc_id AS sample_id, d.source AS suite_id, d.lang, d.text AS candidate,
         CASE WHEN n.text <> d.text THEN n.text END AS baseline,
         CASE WHEN d.doc_id % 2 = 0 THEN d.text ELSE coalesce(n.text, d.text) END AS source,
         coalesce(n.text, d.text) AS prompt, {_TOX} AS tox
  FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _slots(baseline_tox: str, baseline_when: str) -> str:
    return f"""outs AS (
  SELECT sample_id, 0 AS slot, suite_id, lang, candidate AS generated, source, prompt, tox
  FROM pairs
  UNION ALL
  SELECT sample_id, 1, suite_id, lang, baseline, source, prompt, {baseline_tox}
  FROM pairs WHERE baseline IS NOT NULL AND {baseline_when})"""


AB_OUTS = _slots("tox", "true")
GATE_OUTS = _slots("0.05::DOUBLE", "true")
K = "sample_id, slot"

SENTS = _sentences("sents", "outs", "generated", K)
SRC_SENTS = _sentences("src_kept", "outs", "source", K) + """,
src_sents AS (
  SELECT * FROM src_kept
  UNION ALL
  SELECT sample_id, slot, 0, source FROM outs
  WHERE (sample_id, slot) NOT IN (SELECT (sample_id, slot) FROM src_kept))"""

GROUNDING = ",\n".join([
    _tokens("stok", "sents", "s", f"{K}, pos"),
    _tokens("srctok", "outs", "source", K),
    f"""slen AS (SELECT {K}, pos, count(*) AS n FROM stok GROUP BY ALL),
srclen AS (SELECT {K}, count(*) AS n FROM srctok GROUP BY ALL),
shared AS (SELECT {K}, a.pos, count(*) AS n FROM stok a JOIN srctok b USING ({K}, tok) GROUP BY ALL),
grounding AS (
  SELECT s.sample_id, s.slot, s.pos, s.s,
         coalesce(coalesce(h.n, 0)::DOUBLE / l.n::DOUBLE, 0.0::DOUBLE) AS ent,
         coalesce(coalesce(h.n, 0)::DOUBLE / sqrt((l.n * sl.n)::DOUBLE), 0.0::DOUBLE) AS sim
  FROM sents s LEFT JOIN slen l USING ({K}, pos) LEFT JOIN srclen sl USING ({K})
  LEFT JOIN shared h USING ({K}, pos))""",
])

MATCHES = ",\n".join([
    _tokens("evtok", "src_sents", "s", f"{K}, pos"),
    f"""evlen AS (SELECT {K}, pos, count(*) AS n FROM evtok GROUP BY ALL),
pair_shared AS (
  SELECT a.sample_id, a.slot, a.pos, b.pos AS ev, count(*) AS n
  FROM stok a JOIN evtok b ON a.sample_id = b.sample_id AND a.slot = b.slot AND a.tok = b.tok
  GROUP BY ALL),
pair_sim AS (
  SELECT p.sample_id, p.slot, p.pos, p.ev, p.n::DOUBLE / sqrt((l.n * e.n)::DOUBLE) AS sim
  FROM pair_shared p JOIN slen l ON l.sample_id = p.sample_id AND l.slot = p.slot AND l.pos = p.pos
  JOIN evlen e ON e.sample_id = p.sample_id AND e.slot = p.slot AND e.pos = p.ev),
top_match AS (
  SELECT * FROM pair_sim
  QUALIFY row_number() OVER (PARTITION BY {K}, pos ORDER BY sim DESC, ev) = 1),
matches AS (
  SELECT s.sample_id, s.slot, s.pos, s.s, coalesce(t.sim, 0.0::DOUBLE) AS sim,
         coalesce(t.ev, 0) AS ev
  FROM sents s LEFT JOIN top_match t USING ({K}, pos))""",
])

# The number grammar.
_NUMBER = (
    "(?i)(?:(?:approximately|about|around|roughly|nearly|over|under)\\s+)?([+-])?(\\$|€|£)?"
    "([\\d,]+(?:\\.\\d+)?)(\\s*%?)?(?:\\s*(billion|million|thousand|bps|basis points|percent))?"
)


def _numbers(name: str, source: str, column: str, keys: str) -> str:
    def group(i: int) -> str:
        return f"regexp_extract(m, '{_NUMBER}', {i})"

    return f"""{name}_found AS (
  SELECT {keys}, unnest(f) AS m, generate_subscripts(f, 1) AS i
  FROM (SELECT {keys}, regexp_extract_all({column}, '{_NUMBER}') AS f FROM {source}
        WHERE regexp_matches({column}, '[0-9]'))),
{name}_read AS (
  SELECT {keys}, i, m, TRY_CAST(replace({group(3)}, ',', '') AS DOUBLE) AS base,
         {group(1)} AS sign, {group(2)} AS cur, {group(4)} AS pct, {group(5)} AS unit_word
  FROM {name}_found),
{name} AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS k, m,
         base * CASE lower(unit_word) WHEN 'billion' THEN 1e9::DOUBLE
                WHEN 'million' THEN 1e6::DOUBLE WHEN 'thousand' THEN 1e3::DOUBLE
                ELSE 1.0::DOUBLE END AS value,
         CASE WHEN cur <> '' THEN cur WHEN pct <> '' THEN trim(pct) ELSE unit_word END AS unit,
         sign = '-' AS negative
  FROM {name}_read WHERE base IS NOT NULL)"""


NUMBERS = _numbers("nums", "sents", "s", f"{K}, pos") + ",\n" + _numbers(
    "srcnums", "outs", "source", K
)

# Claims in order, with the first source number within five percent.
CLAIMS = f"""close_numbers AS (
  SELECT n.sample_id, n.slot, n.pos, n.k, s.k AS at, s.value AS source_value, s.m AS evidence
  FROM nums n JOIN srcnums s ON s.sample_id = n.sample_id AND s.slot = n.slot
  WHERE CASE WHEN s.value = 0 THEN n.value = 0
             ELSE abs(n.value - s.value) / abs(s.value) <= 0.05::DOUBLE END
  QUALIFY row_number() OVER (PARTITION BY n.sample_id, n.slot, n.pos, n.k ORDER BY s.k) = 1),
claims AS (
  SELECT m.sample_id, m.slot, m.pos, -1 AS k, 'textual' AS type, m.s AS text,
         m.sim >= 0.65::DOUBLE AS verified, m.sim AS sim,
         CASE WHEN m.sim >= 0.65::DOUBLE THEN e.s END AS evidence,
         NULL::DOUBLE AS value, NULL::DOUBLE AS source_value
  FROM matches m LEFT JOIN src_sents e
    ON e.sample_id = m.sample_id AND e.slot = m.slot AND e.pos = m.ev
  UNION ALL
  SELECT n.sample_id, n.slot, n.pos, n.k, 'numerical', s.s, c.at IS NOT NULL, NULL, c.evidence,
         n.value, c.source_value
  FROM nums n JOIN sents s USING ({K}, pos) LEFT JOIN close_numbers c USING ({K}, pos, k))"""

HALLUCINATION = f"""h_sums AS (
  SELECT {K}, count(*) AS n,
         list_reduce(list(ent ORDER BY pos), lambda a, b: a + b) / count(*)::DOUBLE AS ent,
         list_reduce(list(sim ORDER BY pos), lambda a, b: a + b) / count(*)::DOUBLE AS sim
  FROM grounding GROUP BY ALL),
h_scores AS (
  SELECT o.sample_id, o.slot,
         CASE WHEN o.source = '' THEN 0.0 WHEN h.n IS NULL THEN 1.0
              ELSE {r('0.6::DOUBLE * h.ent + 0.4::DOUBLE * h.sim')} END AS h
  FROM outs o LEFT JOIN h_sums h USING ({K}))"""

FACTUAL = f"""f_counts AS (
  SELECT {K}, count(*) AS n, count(*) FILTER (verified) AS ok FROM claims GROUP BY ALL),
f_scores AS (
  SELECT o.sample_id, o.slot,
         CASE WHEN o.source = '' THEN 0.0 WHEN f.n IS NULL THEN 1.0
              ELSE {r('f.ok::DOUBLE / f.n::DOUBLE')} END AS f
  FROM outs o LEFT JOIN f_counts f USING ({K}))"""

# Patterns per kind of personal data, in reporting order.
_PII = {
    "email": "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b",
    "phone_us": "\\b(?:\\+1[-.\\s]?)?\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}\\b",
    "ssn": "\\b\\d{3}-\\d{2}-\\d{4}\\b",
    "credit_card": "\\b(?:\\d{4}[-\\s]?){3}\\d{4}\\b",
    "ip_address": "\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b",
    "date_of_birth": "(?i)\\b(?:DOB|date of birth|born on)[:\\s]*\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}\\b",
}


def _pii(keys: str, source: str, column: str) -> str:
    parts = [
        f"SELECT {keys}, {i} AS kind_order, '{kind}' AS kind, "
        f"unnest(regexp_extract_all({column}, '{pattern}')) AS found FROM {source}"
        for i, (kind, pattern) in enumerate(_PII.items())
    ]
    return "pii AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def _rules(terms, topics, competitors) -> str:
    rows = [("forbidden_term", v) for v in terms] + [("forbidden_topic", v) for v in topics]
    rows += [("competitor_mention", v) for v in competitors]
    values = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(rows))
    return f"rules(rule_id, kind, value) AS (VALUES {values})"


CORPUS_RULES = _rules(given.CORPUS_TERMS, given.CORPUS_TOPICS, given.CORPUS_COMPETITORS)


def _hits(keys: str, source: str, column: str) -> str:
    """Hits per rule and text: whole words for terms and topics, substrings for competitors."""
    return f"""words AS (
  SELECT {keys}, tok, count(*) AS n FROM (
    SELECT {keys}, unnest(string_split({_spaced(column)}, ' ')) AS tok FROM {source})
  GROUP BY ALL),
hits AS (
  SELECT {', '.join('w.' + k.strip() for k in keys.split(','))}, r.rule_id, r.kind, r.value, w.n
  FROM words w JOIN rules r ON w.tok = lower(r.value) AND r.kind <> 'competitor_mention'
  UNION ALL
  SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, r.rule_id, r.kind, r.value, 1
  FROM {source} t JOIN rules r
    ON r.kind = 'competitor_mention' AND contains(lower(t.{column}), lower(r.value)))"""


SAFETY = ",\n".join([
    CORPUS_RULES,
    _hits(K, "outs", "generated"),
    _pii(K, "outs", "generated"),
    f"""s_brand AS (SELECT {K}, sum(n)::BIGINT AS n FROM hits GROUP BY ALL),
s_pii AS (SELECT {K}, count(*) AS n FROM pii GROUP BY ALL),
s_parts AS (
  SELECT o.sample_id, o.slot, o.tox, coalesce(b.n, 0) AS n_brand, coalesce(p.n, 0) AS n_pii,
         greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * coalesce(b.n, 0)) AS brand_score,
         greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.2::DOUBLE * coalesce(p.n, 0)) AS pii_score
  FROM outs o LEFT JOIN s_brand b USING ({K}) LEFT JOIN s_pii p USING ({K})),
s_scores AS (
  SELECT *, {r('(1.0::DOUBLE - tox + brand_score + pii_score) / 3.0::DOUBLE')} AS sf
  FROM s_parts)""",
])

# The transition phrases.
_TRANSITIONS = (
    "however", "therefore", "furthermore", "additionally", "moreover", "consequently",
    "in addition", "as a result", "for example", "in contrast", "meanwhile", "specifically",
    "notably",
)


def _words(x: str) -> str:
    """White-space words of a text that is not blank."""
    return f"string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' ')"


def _transitions(x: str) -> str:
    return " + ".join(f"contains(lower({x}), '{t}')::INT" for t in _TRANSITIONS)


def _quality(keys: str, source: str, text: str, prompt: str) -> str:
    return f"""q_counts AS (
  SELECT {keys},
         (CASE WHEN {_strip(text)} = '' THEN 0 ELSE len({_words(text)}) END)::DOUBLE
           / greatest(len({_pieces(text)}), 1)::DOUBLE AS mean_length,
         {_transitions(text)} AS transitions, {prompt} AS prompt
  FROM {source}),
q_wanted AS (
  SELECT DISTINCT {keys}, w FROM (
    SELECT {keys}, unnest({_words(f'lower({prompt})')}) AS w FROM {source}) WHERE w <> ''),
q_have AS (
  SELECT DISTINCT {keys}, w FROM (
    SELECT {keys}, unnest({_words(f'lower({text})')}) AS w FROM {source})),
q_overlap AS (
  SELECT {keys}, count(h.w)::DOUBLE / count(*)::DOUBLE AS overlap
  FROM q_wanted LEFT JOIN (SELECT *, 1 AS one FROM q_have) h USING ({keys}, w)
  GROUP BY ALL),
q_scores AS (
  SELECT *, {r('(coherence + fluency + relevance)::DOUBLE / 15.0::DOUBLE')} AS q FROM (
    SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.mean_length, c.transitions,
           CASE WHEN transitions >= 3 THEN 4 WHEN transitions >= 1 THEN 3 ELSE 2 END AS coherence,
           CASE WHEN mean_length BETWEEN 10 AND 25 THEN 4
                WHEN mean_length BETWEEN 5 AND 40 THEN 3 ELSE 2 END AS fluency,
           CASE WHEN c.prompt = '' THEN 3 WHEN o.overlap > 0.4::DOUBLE THEN 4
                WHEN o.overlap > 0.2::DOUBLE THEN 3 ELSE 2 END AS relevance,
           coalesce(o.overlap, 0.0) AS overlap
    FROM q_counts c LEFT JOIN q_overlap o USING ({keys})))"""


# count(h.w) after USING would count the merged key, so the presence marker is counted.
def _fixed_overlap(sql: str) -> str:
    return sql.replace("count(h.w)::DOUBLE", "count(h.one)::DOUBLE")


QUALITY = _fixed_overlap(_quality(K, "outs", "generated", "prompt"))

ALL_SCORES = ",\n".join(
    [SENTS, SRC_SENTS, GROUNDING, MATCHES, NUMBERS, CLAIMS, HALLUCINATION, FACTUAL, SAFETY, QUALITY]
) + f""",
scores AS (
  SELECT o.sample_id, o.slot, o.suite_id, o.lang, h.h, f.f, s.sf, q.q,
         (0.0::DOUBLE + h.h + f.f + s.sf + q.q) / 4.0::DOUBLE AS agg
  FROM outs o JOIN h_scores h USING ({K}) JOIN f_scores f USING ({K})
  JOIN s_scores s USING ({K}) JOIN q_scores q USING ({K}))"""

# Flag categories with their order: (evaluator, position, sub-position).
FLAG_ROWS = """flag_rows AS (
  SELECT sample_id, slot, 0 AS e, pos AS p, 0 AS k, 'hallucination:unsupported' AS category
  FROM grounding WHERE ent < 0.3::DOUBLE AND sim < 0.5::DOUBLE
  UNION ALL
  SELECT sample_id, slot, 1, pos, k, 'factual:' || type FROM claims WHERE NOT verified
  UNION ALL
  SELECT sample_id, slot, 2, 0, 0, 'toxicity:toxicity' FROM outs WHERE tox >= 0.5::DOUBLE
  UNION ALL
  SELECT sample_id, slot, 2, 1 + CASE kind WHEN 'forbidden_term' THEN 0
           WHEN 'forbidden_topic' THEN 1 ELSE 2 END, 0, 'brand:' || kind
  FROM (SELECT sample_id, slot, kind, unnest(range(n)) FROM hits)
  UNION ALL
  SELECT sample_id, slot, 2, 10 + kind_order, 0, 'pii:' || kind FROM pii
  UNION ALL
  SELECT sample_id, slot, 3, 0, 0, 'quality:coherence' FROM q_scores WHERE coherence <= 2
  UNION ALL
  SELECT sample_id, slot, 3, 1, 0, 'quality:fluency' FROM q_scores WHERE fluency <= 2
  UNION ALL
  SELECT sample_id, slot, 3, 2, 0, 'quality:relevance' FROM q_scores WHERE relevance <= 2
)"""

DECISIONS = """all_flags AS (
  SELECT sample_id, e, p, k, category FROM flag_rows WHERE slot = 0
  UNION ALL
  SELECT sample_id, 9, 0, 0, 'hallucination' FROM scores WHERE slot = 0 AND h < 0.5::DOUBLE),
flag_lists AS (
  SELECT sample_id, count(*) AS n_flags,
         string_agg(category, ', ' ORDER BY e, p, k) AS listed,
         arg_max(category, (e, p, k)) AS last_flag,
         bool_or(category = 'hallucination') AS injected
  FROM all_flags GROUP BY ALL),
blocks AS (
  SELECT sample_id, unnest(CASE WHEN sample_id % 4 = 0 THEN ['toxicity:toxicity', 'pii:email']
                           WHEN sample_id % 4 = 1 THEN ['hallucination'] ELSE [] END) AS category
  FROM pairs),
blockers AS (
  SELECT f.sample_id, f.category AS blocker
  FROM all_flags f JOIN blocks b USING (sample_id, category)
  QUALIFY row_number() OVER (PARTITION BY f.sample_id ORDER BY e, p, k) = 1),
judged AS (
  SELECT c.sample_id, c.suite_id, c.agg, b.agg AS base, x.blocker, coalesce(l.n_flags, 0) AS n_flags,
         l.listed, l.last_flag, coalesce(l.injected, false) AS injected,
         0.25::DOUBLE + 0.125::DOUBLE * (c.sample_id % 5) AS min_score
  FROM (SELECT * FROM scores WHERE slot = 0) c
  LEFT JOIN (SELECT * FROM scores WHERE slot = 1) b USING (sample_id)
  LEFT JOIN blockers x USING (sample_id) LEFT JOIN flag_lists l USING (sample_id)),
coded AS (
  SELECT *, CASE WHEN blocker IS NOT NULL THEN '1' WHEN agg < min_score THEN '2'
                 WHEN agg < base - 0.05::DOUBLE THEN '3a' WHEN agg < base THEN '3b'
                 WHEN n_flags > 0 THEN '4' WHEN base IS NOT NULL THEN '5a' ELSE '5b' END AS code
  FROM judged),
decided AS (
  SELECT *, CASE WHEN code IN ('1', '2', '3a') THEN 'fail' WHEN code IN ('3b', '4')
                 THEN 'human_review' ELSE 'pass' END AS decision,
         printf('%.2f', agg) AS a2, printf('%.2f', base) AS b2, printf('%.2f', min_score) AS m2
  FROM coded)"""

GATE = _with(PAIRS, GATE_OUTS, ALL_SCORES, FLAG_ROWS, DECISIONS)


def _add(name: str, sql: str) -> None:
    ORACLE[name] = sql


D = "doc_id"
_DOC_SENTS = _sentences("sents", "documents", "text", D)

# --- text -----------------------------------------------------------------------------
_add("split_sentences", _with(_DOC_SENTS) + """
SELECT d.doc_id, count(s.s) AS n_sentences,
       md5(coalesce(string_agg(s.s, '|' ORDER BY s.pos), '')) AS sentences_md5
FROM documents d LEFT JOIN sents s USING (doc_id) GROUP BY ALL""")

_add("explode_sentences", _with(_DOC_SENTS) + """
SELECT d.doc_id, s.pos, s.s AS sentence FROM documents d LEFT JOIN sents s USING (doc_id)""")

_add("extract_numbers", _with(_numbers("nums", "documents", "text", D)) + """
SELECT doc_id, k AS pos, value, unit, m AS match, negative FROM nums""")

_add("extract_claims", _with(_DOC_SENTS, _numbers("nums", "sents", "s", f"{D}, pos")) + """,
claims AS (
  SELECT doc_id, pos, -1 AS k, 'textual' AS claim_type, s, NULL::DOUBLE AS value, NULL AS unit FROM sents
  UNION ALL
  SELECT n.doc_id, n.pos, n.k, 'numerical', s.s, n.value, n.unit
  FROM nums n JOIN sents s ON s.doc_id = n.doc_id AND s.pos = n.pos)
SELECT d.doc_id, c.position, c.claim_type, md5(c.s) AS text_md5, c.value, c.unit
FROM documents d LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS position FROM claims) c
USING (doc_id)""")

_add("detect_pii", _with(_pii(D, "documents", "text")) + """
SELECT doc_id, kind AS pii_type, found FROM pii""")

# A match starts after the pieces and matches before it.
_add("match_spans", "WITH cut AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS pii_type, regexp_extract_all(text, '{pattern}') AS m, "
    f"regexp_split_to_array(text, '{pattern}') AS p FROM documents"
    for kind, pattern in _PII.items()) + """),
found AS (SELECT *, unnest(m) AS cut, generate_subscripts(m, 1) AS i FROM cut),
placed AS (
  SELECT doc_id, pii_type, cut,
         (list_sum(list_transform(p[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS span_start
  FROM found)
SELECT doc_id, pii_type, span_start, span_start + length(cut) AS span_end, cut FROM placed""")

_add("forbidden_terms", _with(CORPUS_RULES, _hits(D, "documents", "text")) + """
SELECT d.doc_id, coalesce(sum(h.n), 0)::BIGINT AS hits
FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.kind = 'forbidden_term'
GROUP BY ALL""")
_add("forbidden_topics", ORACLE["forbidden_terms"].replace(
    "h.kind = 'forbidden_term'", "h.kind = 'forbidden_topic'"))
_add("competitor_mentions", ORACLE["forbidden_terms"].replace(
    "h.kind = 'forbidden_term'", "h.kind = 'competitor_mention'"))

_add("brand_score", _with(CORPUS_RULES, _hits(D, "documents", "text")) + f"""
SELECT doc_id, v AS violations,
       {r('greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * v)')} AS brand_score
FROM (SELECT d.doc_id, coalesce(sum(h.n), 0)::BIGINT AS v
      FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY ALL)""")

_add("pii_score", _with(_pii(D, "documents", "text")) + f"""
SELECT doc_id, n AS pii_count,
       {r('greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.2::DOUBLE * n)')} AS pii_score
FROM (SELECT d.doc_id, count(p.found) AS n FROM documents d LEFT JOIN pii p USING (doc_id)
      GROUP BY ALL)""")

_add("content_rating", _with(PAIRS, _pii("sample_id", "pairs", "candidate")) + """
SELECT suite_id, CASE WHEN tox < 0.1 AND n = 0 THEN 'G' WHEN tox < 0.3 AND n <= 1 THEN 'PG'
                      WHEN tox < 0.6 AND n <= 3 THEN 'PG-13' ELSE 'R' END AS rating,
       count(*) AS n
FROM (SELECT p.sample_id, p.suite_id, p.tox, count(i.found) AS n
      FROM pairs p LEFT JOIN pii i USING (sample_id) GROUP BY ALL)
GROUP BY ALL""")

_DOC_QUALITY = _fixed_overlap(_quality(D, "documents", "text", "''"))
_add("fluency", _with(_DOC_QUALITY) + f"""
SELECT doc_id, {r('mean_length')} AS words_per_sentence, fluency::BIGINT AS fluency FROM q_scores""")
_add("coherence", _with(_DOC_QUALITY) + """
SELECT doc_id, transitions::BIGINT AS transitions, coherence::BIGINT AS coherence FROM q_scores""")

_ANSWERS = """answers AS (
  SELECT a.conv_id, a.turn, a.text AS generated, u.text AS prompt
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
  WHERE a.role = 'assistant' AND u.role = 'user')"""
_ANSWER_QUALITY = _with(
    _ANSWERS, _fixed_overlap(_quality("conv_id, turn", "answers", "generated", "prompt"))
)
_add("relevance", _ANSWER_QUALITY + f"""
SELECT conv_id, turn, {r('overlap')} AS overlap, relevance::BIGINT AS relevance FROM q_scores""")
_add("quality_score", _ANSWER_QUALITY + """
SELECT conv_id, turn, q AS quality_score,
       concat_ws('|', CASE WHEN coherence <= 2 THEN 'quality:coherence' END,
                 CASE WHEN fluency <= 2 THEN 'quality:fluency' END,
                 CASE WHEN relevance <= 2 THEN 'quality:relevance' END) AS categories,
       coherence / 5.0::DOUBLE AS coherence, fluency / 5.0::DOUBLE AS fluency,
       relevance / 5.0::DOUBLE AS relevance
FROM q_scores""")

# --- factual ----------------------------------------------------------------------------
_FACTS = _with(SAMPLES, SENTS, SRC_SENTS, GROUNDING, MATCHES, NUMBERS, CLAIMS, FACTUAL)

_add("flag_messages", _FACTS + """
SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos, k) - 1 AS pos,
       'Unverified ' || type || ' claim: "' || substring(text, 1, 80) || '..."' AS message,
       text AS evidence, 'warning' AS severity
FROM claims WHERE NOT verified""")

_CLAIM_POS = "row_number() OVER (PARTITION BY sample_id ORDER BY pos, k) - 1 AS claim_at"
_add("verify_textual", _FACTS + f"""
SELECT sample_id, claim_at AS pos, {r('sim')} AS similarity, verified, evidence
FROM (SELECT *, {_CLAIM_POS} FROM claims) WHERE type = 'textual'""")

_MONEY = "CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)"
_ORDER_OUTS = f"""outs AS (
  SELECT o_orderkey AS sample_id, 0 AS slot,
         'The order total was $' || {_MONEY.format(x='o_totalprice')} || '.' AS source,
         'The order came to $' || CASE o_orderkey % 4
           WHEN 0 THEN {_MONEY.format(x='o_totalprice * 1.02::DOUBLE')}
           WHEN 1 THEN {_MONEY.format(x='o_totalprice * 1.2::DOUBLE')}
           WHEN 2 THEN {_MONEY.format(x='o_totalprice')}
           ELSE {_MONEY.format(x='o_totalprice / 1000.0::DOUBLE')} || ' thousand' END || '.'
           AS generated
  FROM orders)"""
_add("verify_numerical", _with(_ORDER_OUTS, SENTS, SRC_SENTS, GROUNDING, MATCHES, NUMBERS, CLAIMS) + """
SELECT sample_id, value, source_value, verified, evidence FROM claims WHERE type = 'numerical'""")

_add("source_fallback", _with(SAMPLES, SRC_SENTS) + """
SELECT sample_id, count(*) AS n_evidence, md5(string_agg(s, '|' ORDER BY pos)) AS evidence_md5
FROM src_sents GROUP BY ALL""")

_add("factual_score", _FACTS + f"""
SELECT o.sample_id, f.f AS factual_accuracy_score,
       CASE WHEN c.n > 0 THEN {r('c.t_ok::DOUBLE / greatest(c.t, 1)::DOUBLE')} END AS textual_accuracy,
       CASE WHEN c.n > 0 THEN {r('c.n_ok::DOUBLE / greatest(c.nn, 1)::DOUBLE')} END AS numerical_accuracy,
       coalesce(c.n - c.t_ok - c.n_ok, 0) AS n_flags
FROM outs o JOIN f_scores f USING (sample_id) LEFT JOIN (
  SELECT sample_id, count(*) AS n, count(*) FILTER (type = 'textual') AS t,
         count(*) FILTER (type = 'textual' AND verified) AS t_ok,
         count(*) FILTER (type = 'numerical') AS nn,
         count(*) FILTER (type = 'numerical' AND verified) AS n_ok
  FROM claims GROUP BY ALL) c USING (sample_id)""")

# Evidence of the samples, and after it the facts of the benchmark table by id.
_WITH_FACTS = SRC_SENTS + """,
own_sents AS (SELECT * FROM src_sents),
all_evidence AS (
  SELECT sample_id, slot, pos, s FROM own_sents
  UNION ALL
  SELECT o.sample_id, o.slot, 1000000 + b.item_id, b.text FROM outs o, benchmark b)"""
_FACT_MATCHES = MATCHES.replace("FROM src_sents", "FROM all_evidence")
_add("knowledge_base_union", _with(
    SAMPLES, SENTS, _WITH_FACTS, GROUNDING, _FACT_MATCHES, NUMBERS, CLAIMS, FACTUAL) + """
SELECT o.sample_id, f.f AS factual_accuracy_score, coalesce(c.ok, 0) AS verified,
       coalesce(c.n, 0) AS total
FROM outs o JOIN f_scores f USING (sample_id) LEFT JOIN f_counts c USING (sample_id)""")

_add("corpus_as_knowledge", _with(
    _sentences("tsents", "conversations", "text", "conv_id, turn"),
    _tokens("ttok", "tsents", "s", "conv_id, turn, pos"),
    _sentences("dsents", "documents", "text", "doc_id"),
    _tokens("dtok", "dsents", "s", "doc_id, pos")) + """,
tlen AS (SELECT conv_id, turn, pos, count(*) AS n FROM ttok GROUP BY ALL),
dlen AS (SELECT doc_id, pos, count(*) AS n FROM dtok GROUP BY ALL),
common AS (
  SELECT t.conv_id, t.turn, t.pos, d.doc_id, d.pos AS fact, count(*) AS n
  FROM ttok t JOIN dtok d USING (tok) GROUP BY ALL),
near AS (
  SELECT c.conv_id, c.turn, c.pos, c.doc_id * 100000 + c.fact AS fact_id,
         c.n / sqrt((t.n * d.n)::DOUBLE) AS similarity
  FROM common c JOIN tlen t USING (conv_id, turn, pos) JOIN dlen d ON d.doc_id = c.doc_id AND d.pos = c.fact),
best AS (
  SELECT conv_id, turn, pos, similarity, fact_id FROM near WHERE similarity >= 0.65::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY similarity DESC, fact_id) = 1)
SELECT c.conv_id, c.turn, (SELECT count(*) FROM tsents s WHERE s.conv_id = c.conv_id AND s.turn = c.turn) AS sentences,
       count(b.fact_id) AS known, coalesce(sum(b.fact_id), 0)::BIGINT AS fact_ids, max(b.similarity) AS best
FROM conversations c LEFT JOIN best b USING (conv_id, turn) GROUP BY ALL""")

# --- safety -----------------------------------------------------------------------------
_SAFE = _with(SAMPLES, SAFETY)
_add("result_record", _SAFE + f""",
firsts AS (
  SELECT sample_id, category FROM (
    SELECT sample_id, 0 AS o, 'toxicity:toxicity' AS category FROM outs WHERE tox >= 0.5::DOUBLE
    UNION ALL SELECT sample_id, 1 + rule_id, 'brand:' || kind FROM hits
    UNION ALL SELECT sample_id, 100 + kind_order, 'pii:' || kind FROM pii)
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY o) = 1)
SELECT s.sample_id, 'content_safety' AS evaluator, s.sf AS score,
       s.tox < 0.5::DOUBLE AND s.n_pii = 0 AS passed, {r('s.brand_score')} AS brand_alignment,
       s.n_pii AS pii_count, f.category AS first_flag
FROM s_scores s LEFT JOIN firsts f USING (sample_id)""")

_add("toxicity_flags", f"""
SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY o) - 1 AS pos,
       'toxicity:' || c AS category, v AS score
FROM (SELECT d.doc_id AS sample_id, 0 AS o, 'toxicity' AS c, {_TOX} AS v
      FROM documents d LEFT JOIN labels USING (doc_id)
      UNION ALL SELECT doc_id, 1, 'insult', (doc_id % 16) / 16.0::DOUBLE FROM documents)
WHERE v >= 0.5::DOUBLE""")

_add("safety_score", _SAFE + f"""
SELECT sample_id, sf AS content_safety_score, {r('1.0::DOUBLE - tox')} AS toxicity,
       {r('brand_score')} AS brand_alignment, {r('pii_score')} AS pii_safety
FROM s_scores""")

_add("passed", _SAFE + """
SELECT suite_id, count(*) FILTER (ok) AS n_passed, count(*) FILTER (NOT ok) AS n_failed,
       bool_and(ok) AS all_passed
FROM (SELECT o.suite_id, s.tox < 0.5::DOUBLE AND s.n_pii = 0 AS ok
      FROM s_scores s JOIN outs o USING (sample_id))
GROUP BY ALL""")

_add("policy_only", _with(CORPUS_RULES, _hits(D, "documents", "text"), _pii(D, "documents", "text")) + """
SELECT source AS suite_id, sum(t)::BIGINT AS term_hits, sum(p)::BIGINT AS pii_hits,
       count(*) FILTER (t = 0 AND p = 0) AS clean
FROM (SELECT d.doc_id, d.source,
             coalesce((SELECT sum(n) FROM hits h WHERE h.doc_id = d.doc_id
                       AND h.kind = 'forbidden_term'), 0) AS t,
             (SELECT count(*) FROM pii p WHERE p.doc_id = d.doc_id) AS p
      FROM documents d)
GROUP BY ALL""")

_redacted = "text"
for _kind, _pattern in _PII.items():
    _redacted = f"regexp_replace({_redacted}, '{_pattern}', '[{_kind}]', 'g')"
_add("redact_pii", f"SELECT doc_id, md5({_redacted}) AS redacted_md5 FROM documents")

# --- hallucination ----------------------------------------------------------------------
_NLI = SENTS + """,
nli AS (
  SELECT sample_id, slot, pos, s, con, ent, 1.0::DOUBLE - con - ent AS neu,
         ((sample_id * 5 + pos * 17) % 65) / 64.0::DOUBLE AS sim
  FROM (SELECT *, ((sample_id * 7 + pos * 13) % 64) / 128.0::DOUBLE AS con,
               ((sample_id * 11 + pos * 29) % 64) / 128.0::DOUBLE AS ent FROM sents)),
labelled AS (
  SELECT *, CASE WHEN con >= ent AND con >= neu THEN 'contradiction'
                 WHEN ent >= neu THEN 'entailment' ELSE 'neutral' END AS label FROM nli)"""
_MODEL = _with(SAMPLES, _NLI)
_add("nli_label", _MODEL + "SELECT sample_id, pos, label FROM labelled")
_add("hallucination_score", _MODEL + f"""
SELECT o.sample_id,
       CASE WHEN o.source = '' THEN 0.0 WHEN m.e IS NULL THEN 1.0
            ELSE {r('0.6::DOUBLE * m.e + 0.4::DOUBLE * m.s')} END AS hallucination_score,
       CASE WHEN o.source <> '' AND m.e IS NOT NULL THEN {r('m.e')} END AS entailment,
       CASE WHEN o.source <> '' AND m.e IS NOT NULL THEN {r('m.s')} END AS semantic_similarity
FROM outs o LEFT JOIN (SELECT sample_id, avg(ent) AS e, avg(sim) AS s FROM nli GROUP BY ALL) m
USING (sample_id)""")
_add("hallucination_flags", _MODEL + """
SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS pos,
       CASE WHEN label = 'contradiction' THEN 'hallucination:contradiction'
            ELSE 'hallucination:unsupported' END AS category,
       CASE WHEN label = 'contradiction' THEN 'critical' ELSE 'warning' END AS severity,
       CASE WHEN label = 'contradiction' THEN 'Sentence contradicts source: "'
            ELSE 'Sentence appears unsupported by source: "' END
         || substring(s, 1, 80) || '..."' AS message
FROM labelled WHERE label = 'contradiction' OR (ent < 0.3::DOUBLE AND sim < 0.5::DOUBLE)""")
_add("hallucination_counts", _MODEL + """
SELECT o.sample_id, count(l.pos) AS num_sentences,
       count(*) FILTER (l.label = 'contradiction') AS num_contradictions,
       count(*) FILTER (l.ent < 0.3::DOUBLE AND l.sim < 0.5::DOUBLE) AS num_unsupported
FROM outs o LEFT JOIN labelled l USING (sample_id) GROUP BY ALL""")
_add("nli_scored", _with(SAMPLES, SENTS, GROUNDING) + f""",
paired AS (
  SELECT g.sample_id, contains(g.s, '%') AS refused, g.sim,
         (length(g.s) * 7 + length(o.source)) % 64 AS con, (length(g.s) * 11 + length(o.source) * 3) % 64 AS ent
  FROM grounding g JOIN outs o USING (sample_id, slot)),
per AS (
  SELECT sample_id, count(*) AS n, bool_or(refused) AS refused, avg(ent / 128.0::DOUBLE) AS e, avg(sim) AS s,
         count(*) FILTER (con >= ent AND con >= 128 - con - ent) AS contradictions
  FROM paired GROUP BY ALL),
judged AS (
  SELECT o.sample_id, o.source, p.*, CASE WHEN o.source <> '' AND p.refused THEN 'the model refused a sentence' END AS error
  FROM outs o LEFT JOIN per p USING (sample_id))
SELECT sample_id, CASE WHEN source = '' OR error IS NOT NULL THEN 0.0 WHEN n IS NULL THEN 1.0
       ELSE {r('0.6::DOUBLE * e + 0.4::DOUBLE * s')} END AS hallucination_score,
       CASE WHEN error IS NULL THEN 'model' END AS hallucination_method, error AS hallucination_error,
       CASE WHEN error IS NULL THEN coalesce(n, 0) END AS sentences,
       CASE WHEN error IS NULL THEN coalesce(contradictions, 0) END AS contradictions
FROM judged""")
_add("toxicity_scored", _with(SAMPLES, SAFETY) + """,
modelled AS (
  SELECT s.sample_id, contains(o.generated, '@') AS refused, n_pii,
         greatest(length(o.generated) % 64 / 64.0::DOUBLE, length(o.generated) % 16 / 16.0::DOUBLE) AS tox
  FROM s_scores s JOIN outs o USING (sample_id))
SELECT sample_id, CASE WHEN refused THEN 'the model refused a text' END AS model_error,
       CASE WHEN refused THEN 0.0::DOUBLE ELSE tox END AS max_toxicity,
       CASE WHEN refused THEN 'toxicity scores are missing' END AS content_safety_error,
       refused OR (tox < 0.5::DOUBLE AND n_pii = 0) AS content_safety_passed
FROM modelled""")
_add("sentence_source_cosine", _with(SAMPLES, SENTS, GROUNDING) + f"""
SELECT sample_id, pos, {r('sim')} AS similarity, {r('ent')} AS entailment FROM grounding""")
_add("no_content_guard", _with(SAMPLES, SENTS) + """
SELECT o.sample_id, count(s.pos) = 0 AS no_content, count(s.pos) = 0 AS hallucination_clear,
       count(s.pos) = 0 AS factual_clear
FROM outs o LEFT JOIN sents s USING (sample_id) GROUP BY ALL""")
_add("no_source_guard", """
SELECT doc_id AS sample_id, 0.0::DOUBLE AS hallucination_score,
       0.0::DOUBLE AS factual_accuracy_score,
       'Cannot assess hallucination without source document.|'
         || 'Cannot verify facts without a source document.' AS messages,
       'warning|warning' AS severities
FROM documents WHERE doc_id % 3 = 0 OR length(text) < 2""")

# --- gate ---------------------------------------------------------------------------------
_SAMPLE_SCORES = _with(SAMPLES, ALL_SCORES)
_DEFAULT_SAFETY = SAFETY.replace(CORPUS_RULES, _rules(("kill",), ("politics",), ()))
_add("enabled_evaluators", _with(SAMPLES, ALL_SCORES.replace(SAFETY, _DEFAULT_SAFETY)) + """
SELECT suite_id, e AS evaluator, count(*) AS n, sum(round(v * 10000)::BIGINT)::BIGINT AS score_units
FROM (SELECT suite_id, 'factual_accuracy' AS e, f AS v FROM scores
      UNION ALL SELECT suite_id, 'content_safety', sf FROM scores
      UNION ALL SELECT suite_id, 'quality', q FROM scores)
GROUP BY ALL""")
_add("error_row", _with(SAMPLES, SAFETY) + """
SELECT sample_id,
       CASE WHEN sample_id % 10 = 3 THEN 'generated text is missing'
            WHEN sample_id % 10 = 7 THEN 'toxicity scores are missing' END AS content_safety_error,
       CASE WHEN sample_id % 10 = 3 THEN 'generated text is missing' END AS quality_error,
       sample_id % 10 IN (3, 7) OR (tox < 0.5::DOUBLE AND n_pii = 0) AS content_safety_passed,
       sample_id % 10 IN (3, 7) OR sf = 0 AS safety_zero,
       CASE WHEN sample_id % 10 IN (3, 7) THEN 0::BIGINT END AS safety_flags,
       CASE WHEN sample_id % 10 = 3 THEN 0.0::DOUBLE END AS quality_on_error
FROM s_scores""")
_add("failing_evaluators", _with(SAMPLES, SENTS, SRC_SENTS) + """,
seen AS (
  SELECT o.sample_id, any_value(o.generated) AS generated, any_value(o.source) AS source,
         count(s.pos) > 0 AS any_sentence,
         bool_or(contains(o.source, '@') OR coalesce(contains(s.s, '@'), false)) AS refused,
         bool_or(contains(o.source, '%')) AS odd_source, coalesce(bool_or(contains(s.s, '%')), false) AS odd,
         coalesce(bool_and(contains(s.s, '%')), false) AS all_odd
  FROM outs o LEFT JOIN sents s USING (sample_id, slot) GROUP BY o.sample_id),
ragged AS (
  SELECT e.sample_id, bool_and(contains(e.s, '%')) AS all_odd FROM src_sents e GROUP BY ALL),
errors AS (
  SELECT s.*, CASE WHEN NOT any_sentence OR source = '' THEN NULL
                   WHEN refused THEN 'the model refused a text'
                   WHEN (odd_source OR odd) AND NOT (odd_source AND s.all_odd AND r.all_odd)
                     THEN 'vectors of different sizes' END AS error
  FROM seen s LEFT JOIN ragged r USING (sample_id))
SELECT sample_id, error AS hallucination_error, error AS factual_accuracy_error,
       CASE WHEN error IS NOT NULL THEN 0.0::DOUBLE END AS score_on_error,
       CASE WHEN error IS NOT NULL THEN 0::BIGINT END AS flags_on_error,
       CASE WHEN contains(generated, '@') THEN 'no addresses, please' END AS strict_error,
       CASE WHEN contains(generated, '@') THEN 0.0::DOUBLE WHEN contains(generated, '|') THEN 0.5::DOUBLE
            ELSE 1.0::DOUBLE END AS strict_score,
       contains(generated, '@') OR NOT contains(generated, '|') AS strict_passed,
       CASE WHEN NOT contains(generated, '@') AND contains(generated, '|') THEN 1 ELSE 0 END::BIGINT AS strict_flags
FROM errors""")
_JUDGED = _with(SAMPLES, QUALITY) + """
SELECT q.sample_id, l.quality, q.q, q.fluency, CASE WHEN l.quality = 1 THEN 4 ELSE 2 END AS level
FROM q_scores q LEFT JOIN labels l ON l.doc_id = q.sample_id"""
_add("judge_or_heuristic", f"""
SELECT sample_id,
       CASE WHEN quality IS NULL THEN q
            ELSE {r('(3 * level + 1)::DOUBLE / 15.0::DOUBLE')} END AS quality_score,
       CASE WHEN quality IS NULL THEN 'heuristic' ELSE 'judge' END AS method,
       (CASE WHEN quality IS NULL THEN fluency ELSE level + 1 END)::BIGINT AS fluency
FROM ({_JUDGED})""")
_add("evaluator_method", """
SELECT CASE WHEN l.quality IS NULL THEN 'Deterministic + Heuristic Fallback'
            ELSE 'Deterministic + judge-1 Judge' END AS evaluator_method, count(*) AS n
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
_add("aggregate_score", GATE + f"""
SELECT sample_id, h AS hallucination, f AS factual_accuracy, sf AS content_safety, q AS quality,
       {r('agg', 6)} AS aggregate_score
FROM scores WHERE slot = 0""")
_add("collect_flags", GATE + """
SELECT p.sample_id, count(f.category) AS n_flags,
       md5(coalesce(string_agg(f.category, '|' ORDER BY e, f.p, k), '')) AS flags_md5
FROM pairs p LEFT JOIN (SELECT * FROM flag_rows WHERE slot = 0) f USING (sample_id)
GROUP BY ALL""")
_add("inject_hallucination_flag", GATE + "SELECT sample_id, injected, last_flag FROM decided")
_add("candidate_vs_baseline", GATE + f"""
SELECT sample_id, {r('agg', 6)} AS candidate_score,
       CASE WHEN base IS NOT NULL THEN {r('base', 6)} END AS baseline_score FROM decided""")
_add("blocker_match", GATE + "SELECT sample_id, blocker FROM decided")
_add("promotion_decision", GATE + """
SELECT sample_id, decision, code AS reason_code, CASE code
  WHEN '1' THEN 'Blocked on critical flag: ' || blocker
  WHEN '2' THEN 'Aggregate score ' || a2 || ' is below minimum threshold ' || m2
  WHEN '3a' THEN 'Regression detected: Candidate (' || a2
    || ') is significantly worse than Baseline (' || b2 || ')'
  WHEN '3b' THEN 'Slight regression: Candidate (' || a2 || ') vs Baseline (' || b2
    || '). Requires review.'
  WHEN '4' THEN 'Passed thresholds but flagged for review: ' || listed
  WHEN '5a' THEN
    'Candidate meets or exceeds baseline aggregate score with no critical regressions.'
  ELSE 'Candidate meets all promotion criteria.' END AS reason
FROM decided""")
_add("decisions_by_suite", GATE + """
SELECT suite_id, decision, code AS reason_code, count(*) AS n FROM decided GROUP BY ALL""")
_add("redact_payload", _with(PAIRS) + """
SELECT sample_id, CASE WHEN keep THEN md5(prompt) END AS prompt_md5,
       CASE WHEN keep THEN length(candidate) END AS candidate_chars,
       CASE WHEN keep THEN length(baseline) END AS baseline_chars,
       CASE WHEN NOT keep THEN true END AS input_redacted,
       CASE WHEN NOT keep THEN true END AS output_redacted
FROM (SELECT *, sample_id % 3 = 0 AS keep FROM pairs)""")
_add("gate_request_source", _with(PAIRS) + """,
lines AS (
  SELECT *, sample_id % 13 <> 0 AS json, sample_id % 4 <> 1 AS has_base FROM pairs)
SELECT sample_id,
       CASE WHEN NOT json THEN 'request: not valid JSON|input.prompt: field required|'
              || 'candidate.output: field required'
            ELSE concat_ws('|',
              CASE WHEN sample_id % 11 = 0 THEN 'candidate.output: field required' END,
              CASE WHEN has_base AND (sample_id % 9 = 0 OR baseline IS NULL)
                   THEN 'baseline.output: field required' END) END AS errors,
       CASE WHEN json AND sample_id % 5 <> 0 THEN suite_id ELSE 'default-quality-gate' END AS suite_id,
       CASE WHEN json AND sample_id % 3 <> 0 THEN length(source) ELSE 0 END AS source_chars,
       CASE WHEN json AND sample_id % 2 = 0 THEN 'model-x' ELSE 'default' END AS candidate_id,
       CASE WHEN json AND sample_id % 11 <> 0 THEN md5(candidate) END AS candidate_md5,
       CASE WHEN json AND has_base THEN 'default' END AS baseline_id,
       CASE WHEN json AND sample_id % 3 = 1 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS min_score,
       CASE WHEN json AND sample_id % 3 = 1 THEN 'hallucination' ELSE '' END AS block_on_flags,
       json AND sample_id % 7 = 0 AS store_full_payloads
FROM lines""")
_CONFIG_RULES = _rules(given.CORPUS_TERMS, ("politics", "religion", "gambling", "weapons"),
                       given.CORPUS_COMPETITORS)
_add("rules_from_config", _with(_CONFIG_RULES, _hits(D, "documents", "text")) + """
SELECT r.rule_id::BIGINT AS rule_id, r.kind, r.value, coalesce(sum(h.n), 0)::BIGINT AS hits,
       count(h.doc_id) AS documents
FROM rules r LEFT JOIN hits h USING (rule_id, kind, value) GROUP BY ALL""")

# --- A/B ----------------------------------------------------------------------------------
_add("pair_ab", """
SELECT suite_id, sample_index, a IS NOT NULL AND b IS NOT NULL AS paired, md5(a) AS a_md5,
       md5(b) AS b_md5
FROM (SELECT doc_id // 100 AS suite_id, (doc_id % 100) // 2 AS sample_index,
             max(CASE WHEN doc_id % 2 = 0 THEN text END) AS a,
             max(CASE WHEN doc_id % 2 = 1 THEN text END) AS b
      FROM documents GROUP BY ALL)""")
_add("ab_json_source", _with(_sentences("sents", "documents", "text", "doc_id, lang")) + """,
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sents)
SELECT doc_id, slot, CASE slot WHEN 'a' THEN 'model_a' ELSE lang END AS model_id,
       count(*) AS outputs, sum(length(s))::BIGINT AS text_chars,
       sum(CASE WHEN pos < n // 2 THEN length(s) ELSE 0 END)::BIGINT AS source_chars,
       count(*) FILTER (pos < n - 1) AS prompts,
       count(*) FILTER (pos % 3 = 1) AS metadata_keys
FROM counted, (VALUES ('a'), ('b')) slots(slot) GROUP BY ALL""")
_add("ab_quarantine", _with(_sentences("sents", "documents", "text", "doc_id")) + """,
sized AS (
  SELECT d.doc_id, d.doc_id % 14 AS k, count(s.pos) AS n
  FROM documents d LEFT JOIN sents s USING (doc_id) GROUP BY ALL),
judged AS (
  SELECT doc_id, n, CASE k
    WHEN 1 THEN 'not valid JSON' WHEN 2 THEN 'not an object' WHEN 3 THEN 'model_a has no list of outputs'
    WHEN 4 THEN 'model_b has no list of outputs'
    WHEN 5 THEN CASE WHEN n <> 1 THEN 'unequal outputs: ' || n || ' and 1' END
    WHEN 6 THEN 'model_b has outputs that are neither text nor object: 2'
    WHEN 7 THEN 'prompts is no list' WHEN 8 THEN 'no document' END AS reason
  FROM sized)
SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 2 * n END AS outputs
FROM judged WHERE reason IS NOT NULL OR n > 0""")
_add("attach_prompt_source", _with(_DOC_SENTS) + """
SELECT doc_id AS suite_id, pos AS sample_index, 'model_a' AS model_id, md5(s) AS generated_md5,
       CASE WHEN pos % 2 = 0 THEN 'p' || pos ELSE '' END AS prompt, '' AS source
FROM sents""")

_PAIRED = ALL_SCORES + """,
wide AS (
  SELECT a.sample_id, a.suite_id, a.lang, a.h AS ah, b.h AS bh, a.f AS af, b.f AS bf,
         a.sf AS asf, b.sf AS bsf, a.q AS aq, b.q AS bq
  FROM scores a JOIN scores b ON a.sample_id = b.sample_id AND a.slot = 0 AND b.slot = 1),
paired AS (
  SELECT suite_id, lang, sample_id, 'hallucination' AS evaluator, ah AS a, bh AS b FROM wide
  UNION ALL SELECT suite_id, lang, sample_id, 'factual_accuracy', af, bf FROM wide
  UNION ALL SELECT suite_id, lang, sample_id, 'content_safety', asf, bsf FROM wide
  UNION ALL SELECT suite_id, lang, sample_id, 'quality', aq, bq FROM wide)"""


def _statistics(by: str) -> str:
    """Moments in whole 1e-4 units; ranks over the nonzero differences."""
    def std(u: str) -> str:
        return (f"sqrt((n::HUGEINT * {u}2::HUGEINT - {u}1::HUGEINT * {u}1::HUGEINT)::DOUBLE)"
                f" / (n::DOUBLE * 10000.0::DOUBLE)")

    def mean(u: str) -> str:
        return f"{u}1::DOUBLE / (n::DOUBLE * 10000.0::DOUBLE)"

    return f"""units AS (
  SELECT {by}, evaluator, a - b AS d, round(a * 10000)::BIGINT AS ua,
         round(b * 10000)::BIGINT AS ub FROM paired),
moments AS (
  SELECT {by}, evaluator, count(*) AS n, sum(ua)::BIGINT AS a1, sum(ua * ua)::BIGINT AS a2,
         sum(ub)::BIGINT AS b1, sum(ub * ub)::BIGINT AS b2, sum(ua - ub)::BIGINT AS d1,
         sum((ua - ub) * (ua - ub))::BIGINT AS d2
  FROM units GROUP BY ALL),
ranked AS (
  SELECT {by}, evaluator, d,
         rank() OVER (PARTITION BY {by}, evaluator ORDER BY abs(d))
           + (count(*) OVER (PARTITION BY {by}, evaluator, abs(d)) - 1) / 2.0::DOUBLE AS rnk,
         count(*) OVER (PARTITION BY {by}, evaluator, abs(d)) AS peers
  FROM units WHERE d <> 0),
signed AS (
  SELECT {by}, evaluator, count(*) AS nz, sum(CASE WHEN d > 0 THEN rnk ELSE 0 END) AS wp,
         sum(CASE WHEN d < 0 THEN rnk ELSE 0 END) AS wm,
         sum(peers * peers - 1)::DOUBLE AS tie
  FROM ranked GROUP BY ALL),
stats AS (
  SELECT {by}, evaluator, n, coalesce(nz, 0) AS nz, least(wp, wm)::DOUBLE AS w,
         coalesce(tie, 0) AS tie, {mean('a')} AS ma, {mean('b')} AS mb, {std('a')} AS sa,
         {std('b')} AS sb, {mean('d')} AS md, {std('d')} AS sd,
         CASE WHEN n > 1 THEN sqrt((n::HUGEINT * d2::HUGEINT - d1::HUGEINT * d1::HUGEINT)::DOUBLE)
           / (sqrt(n::DOUBLE * (n::DOUBLE - 1)) * 10000.0::DOUBLE) END AS sds
  FROM moments LEFT JOIN signed USING ({by}, evaluator)),
tstat AS (
  SELECT *, CASE WHEN sds > 0 THEN md / (sds / sqrt(n::DOUBLE)) END AS t FROM stats),
-- Student t: for a whole number v of degrees of freedom the tail is a finite sum in the
-- angle atan(t / sqrt(v)).
angles AS (
  SELECT *, n - 1 AS v, atan(abs(t) / sqrt((n - 1)::DOUBLE)) AS th FROM tstat
  WHERE n >= 30 AND t IS NOT NULL),
terms AS (
  SELECT {by}, evaluator, v, th, j,
         exp(sum(ln(CASE WHEN j = 0 THEN 1.0::DOUBLE
                         WHEN v % 2 = 0 THEN (2.0::DOUBLE * j - 1) / (2.0::DOUBLE * j)
                         ELSE 2.0::DOUBLE * j / (2.0::DOUBLE * j + 1) END))
             OVER (PARTITION BY {by}, evaluator ORDER BY j))
           * pow(cos(th), CASE WHEN v % 2 = 0 THEN 2 * j ELSE 2 * j + 1 END) AS term
  FROM (SELECT *, unnest(range(CASE WHEN v % 2 = 0 THEN v // 2 ELSE (v - 1) // 2 END)) AS j
        FROM angles)),
tails AS (
  SELECT {by}, evaluator,
         1.0::DOUBLE - CASE WHEN any_value(v) % 2 = 0 THEN sin(any_value(th)) * sum(term)
           ELSE 2.0::DOUBLE / pi() * (any_value(th) + sin(any_value(th)) * sum(term)) END AS p
  FROM terms GROUP BY ALL),
-- Signed ranks without ties: subsets of 1..n by their sum, counted rank by rank.
subsets AS (
  WITH RECURSIVE step(k, s, c) AS (
    SELECT 0, 0, 1::DOUBLE
    UNION ALL
    SELECT k + 1, s, sum(c) FROM (
      SELECT k, s, c FROM step UNION ALL SELECT k, s + k + 1, c FROM step)
    WHERE k < 29 GROUP BY k, s)
  SELECT k, s, c FROM step),
exact AS (
  SELECT t.{by.replace(', ', ', t.')}, t.evaluator,
         least(1.0::DOUBLE, 2.0::DOUBLE * sum(x.c) / pow(2.0::DOUBLE, any_value(t.nz))) AS p
  FROM tstat t JOIN subsets x ON x.k = t.nz AND x.s <= t.w
  WHERE t.n < 30 AND t.tie = 0 AND t.nz >= 2 GROUP BY ALL),
-- Normal tail by the series of the error function that has positive terms only.
zs AS (
  SELECT {by}, evaluator,
         abs((w - nz * (nz + 1) / 4.0::DOUBLE)
             / sqrt((nz * (nz + 1) * (2 * nz + 1) - tie / 2.0::DOUBLE) / 24.0::DOUBLE))
           / sqrt(2.0::DOUBLE) AS x
  FROM tstat WHERE n < 30 AND nz >= 2 AND tie > 0),
normal AS (
  SELECT {by}, evaluator,
         1.0::DOUBLE - 2.0::DOUBLE / sqrt(pi()) * exp(-any_value(x) * any_value(x)) * sum(term) AS p
  FROM (SELECT {by}, evaluator, x, j,
               exp(j * ln(2.0::DOUBLE) + (2 * j + 1) * ln(x)
                   - sum(ln(2.0::DOUBLE * j + 1)) OVER (PARTITION BY {by}, evaluator ORDER BY j))
                 AS term
        FROM (SELECT *, unnest(range(120)) AS j FROM zs WHERE x > 0))
  GROUP BY ALL
  UNION ALL SELECT {by}, evaluator, 1.0::DOUBLE FROM zs WHERE x = 0),
tested AS (
  SELECT s.*, CASE WHEN s.n >= 30 THEN CASE WHEN s.t IS NULL AND s.md <> 0 THEN 0.0 ELSE a.p END
                   WHEN s.nz < 2 THEN 1.0 ELSE coalesce(e.p, z.p) END AS p
  FROM tstat s LEFT JOIN tails a USING ({by}, evaluator) LEFT JOIN exact e USING ({by}, evaluator)
  LEFT JOIN normal z USING ({by}, evaluator)),
compared AS (
  SELECT *, CASE WHEN p < 0.05::DOUBLE THEN CASE WHEN md > 0 THEN 'model_a' ELSE 'model_b' END
                 ELSE 'tie' END AS winner,
         md / greatest(sd, 1e-10::DOUBLE) AS effect, {r('ma')} AS ma4, {r('mb')} AS mb4
  FROM tested)"""


_BY_SUITE = _with(PAIRS, AB_OUTS, _PAIRED, _statistics("suite_id"))
_BY_SUITE_LANG = _with(PAIRS, AB_OUTS, _PAIRED, _statistics("suite_id, lang"))

_add("ab_summary", _BY_SUITE + f"""
SELECT suite_id, evaluator, n AS num_samples, ma4 AS mean_a, {r('sa')} AS std_a, mb4 AS mean_b,
       {r('sb')} AS std_b FROM compared""")
_add("paired_effect", _BY_SUITE_LANG + f"""
SELECT suite_id, lang, evaluator, {r('md', 6)} AS mean_diff, {r('effect', 6)} AS effect_size
FROM compared""")
_add("paired_ttest", _BY_SUITE + f"""
SELECT suite_id, evaluator,
       -- equal differences have no spread: t is infinite, as a paired test returns it
       CASE WHEN t IS NOT NULL THEN {r('t', 6)} WHEN md > 0 THEN 'inf'::DOUBLE
            WHEN md < 0 THEN '-inf'::DOUBLE END AS t_statistic,
       CASE WHEN p IS NOT NULL THEN {r('p', 6)} END AS p_value
FROM compared WHERE n >= 30""")
_add("wilcoxon_signed_rank", _BY_SUITE_LANG + f"""
SELECT suite_id, lang, evaluator,
       CASE WHEN nz < 2 THEN 'none' WHEN tie = 0 THEN 'wilcoxon_exact' ELSE 'wilcoxon_normal' END
         AS method,
       CASE WHEN nz >= 2 THEN w END AS w_statistic, {r('p', 6)} AS p_value
FROM compared WHERE n < 30""")
_add("raw_score_ranks", _with(PAIRS) + """,
scores AS (
  SELECT suite_id, lang, 1.0::DOUBLE / (length(candidate) % 97 + 3) AS a, 1.0::DOUBLE / (length(baseline) % 97 + 3) AS b
  FROM pairs WHERE baseline IS NOT NULL),
ranked AS (
  SELECT suite_id, lang, a - b AS d,
         rank() OVER w + (count(*) OVER (PARTITION BY suite_id, lang, abs(a - b)) - 1) / 2.0::DOUBLE AS r,
         count(*) OVER (PARTITION BY suite_id, lang, abs(a - b)) AS ties
  FROM scores WHERE a <> b WINDOW w AS (PARTITION BY suite_id, lang ORDER BY abs(a - b))),
sums AS (
  SELECT suite_id, lang, count(*) AS n_nonzero, sum(r) FILTER (d > 0) AS p, sum(r) FILTER (d < 0) AS m,
         sum(ties * ties - 1.0::DOUBLE) AS tie
  FROM ranked GROUP BY ALL)
SELECT s.suite_id, s.lang, count(*) AS n, coalesce(any_value(n_nonzero), 0) AS n_nonzero,
       coalesce(any_value(p), 0.0::DOUBLE) AS rank_plus, coalesce(any_value(m), 0.0::DOUBLE) AS rank_minus,
       coalesce(any_value(tie), 0.0::DOUBLE) AS tie_term, round(avg(a), 9) AS mean_a, round(stddev_pop(a), 9) AS std_a,
       round(stddev_pop(b), 9) AS std_b, round(avg(a - b), 9) AS mean_diff, round(stddev_pop(a - b), 9) AS std_diff
FROM scores s LEFT JOIN sums USING (suite_id, lang) GROUP BY ALL""")
_add("ab_winner", _BY_SUITE + "SELECT suite_id, evaluator, winner FROM compared")
_OVERALL = """
SELECT suite_id, count(*) FILTER (winner = 'model_a') AS a_wins,
       count(*) FILTER (winner = 'model_b') AS b_wins,
       CASE WHEN count(*) FILTER (winner = 'model_a') > count(*) FILTER (winner = 'model_b')
            THEN 'model-x'
            WHEN count(*) FILTER (winner = 'model_b') > count(*) FILTER (winner = 'model_a')
            THEN 'model-y' ELSE 'tie' END AS overall_winner
FROM compared GROUP BY ALL"""
_add("overall_winner", _BY_SUITE + _OVERALL)
_add("ci_verdict", _BY_SUITE + """
SELECT suite_id, count(*) AS evaluators, count(*) FILTER (ma4 >= 0.5) AS a_passing,
       count(*) FILTER (mb4 >= 0.5) AS b_passing, bool_and(ma4 >= 0.5 OR mb4 >= 0.5) AS passed
FROM compared GROUP BY ALL""")
_add("json_report", _BY_SUITE + f""",
overall AS ({_OVERALL})
SELECT c.suite_id, '1.0' AS schema_version, any_value(c.n) AS num_samples,
       any_value(o.overall_winner) AS overall_winner,
       max(c.ma4) FILTER (c.evaluator = 'quality') AS quality_mean_a,
       max(c.winner) FILTER (c.evaluator = 'content_safety') AS safety_winner,
       bool_and(c.ma4 >= 0.5 OR c.mb4 >= 0.5) AS ci_passed,
       bool_or(c.mb4 >= 0.5) FILTER (c.evaluator = 'hallucination') AS b_grounded
FROM compared c JOIN overall o USING (suite_id) GROUP BY ALL""")

# --- run history --------------------------------------------------------------------------
_RUNS = """runs AS (
  SELECT 'run-' || lpad(user_id::VARCHAR, 5, '0') AS run_id, event_id AS ingest_seq, ts AS saved_at,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS created_at, event_type AS suite_id,
         'v' || (event_id // 1000) AS suite_version,
         (event_id * 37 % 10001) / 10000.0::DOUBLE AS aggregate_score,
         CASE WHEN event_id % 10 < 6 THEN 'pass' WHEN event_id % 10 < 9 THEN 'fail'
              ELSE 'human_review' END AS decision,
         CASE WHEN event_id % 10 < 6 THEN '5b' WHEN event_id % 10 < 8 THEN '3a'
              WHEN event_id % 10 = 8 THEN '2' ELSE '3b' END AS reason_code
  FROM events)"""
_LATEST = _RUNS + """,
latest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ingest_seq DESC) = 1)"""
_add("save_run", _with(_LATEST) + """
SELECT run_id, ingest_seq, created_at, suite_id, aggregate_score, decision FROM latest""")
_add("recent_runs", _with(_LATEST) + """
SELECT run_id, created_at, suite_id, decision FROM latest
ORDER BY created_at DESC, run_id LIMIT 10""")
_add("get_run", _with(_LATEST) + """
SELECT run_id, ingest_seq, created_at, suite_id, aggregate_score FROM latest
WHERE run_id = 'run-00007'""")

# --- extension surface --------------------------------------------------------------------
_add("custom_evaluator", _SAFE + f"""
SELECT s.sample_id, 'content_safety' AS evaluator, s.sf AS score,
       (s.tox >= 0.5::DOUBLE)::BIGINT + s.n_brand + s.n_pii AS n_flags FROM s_scores s
UNION ALL
SELECT doc_id, 'brevity', {r('least(1.0::DOUBLE, 1500.0::DOUBLE / greatest(length(text), 1)::DOUBLE)')},
       (length(text) > 1500)::BIGINT
FROM documents""")

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(x: str) -> str:
    counts = [f"(length({x}) - length(replace({x}, '{c}', '')))::BIGINT AS n_{c}" for c in _LETTERS]
    return ", ".join(counts)


def _dot(a: str, b: str) -> str:
    return " + ".join(f"{a}.n_{c} * {b}.n_{c}" for c in _LETTERS)


_VECTORS = f"""mine AS (SELECT sample_id, slot, pos, s, {_letters('s')} FROM sents),
theirs AS (SELECT sample_id, slot, pos, {_letters('s')} FROM src_sents),
whole AS (SELECT sample_id, slot, {_letters('source')} FROM outs),
lettered AS (
  SELECT m.sample_id, m.slot, m.pos, m.s,
         CASE WHEN ({_dot('m', 'm')}) * ({_dot('w', 'w')}) > 0
              THEN ({_dot('m', 'w')})::DOUBLE / sqrt((({_dot('m', 'm')}) * ({_dot('w', 'w')}))::DOUBLE)
              ELSE 0.0::DOUBLE END AS sim
  FROM mine m JOIN whole w USING (sample_id, slot)),
letter_pairs AS (
  SELECT m.sample_id, m.slot, m.pos, t.pos AS ev,
         CASE WHEN ({_dot('m', 'm')}) * ({_dot('t', 't')}) > 0
              THEN ({_dot('m', 't')})::DOUBLE / sqrt((({_dot('m', 'm')}) * ({_dot('t', 't')}))::DOUBLE)
              ELSE 0.0::DOUBLE END AS sim
  FROM mine m JOIN theirs t ON m.sample_id = t.sample_id AND m.slot = t.slot),
matches AS (
  SELECT p.sample_id, p.slot, p.pos, s.s, p.sim, p.ev FROM letter_pairs p
  JOIN sents s USING (sample_id, slot, pos)
  QUALIFY row_number() OVER (PARTITION BY p.sample_id, p.slot, p.pos ORDER BY p.sim DESC, p.ev) = 1)"""
_EMBEDDED = _with(SAMPLES, SENTS, SRC_SENTS, _VECTORS)
_add("model_scorer", _EMBEDDED + f"""
SELECT l.sample_id, l.pos, {r('l.sim', 6)} AS similarity, {r('m.sim', 6)} AS best_similarity,
       m.ev AS best_position
FROM lettered l JOIN matches m USING (sample_id, slot, pos)""")
_add("model_scored_evaluators", _with(SAMPLES, SENTS, SRC_SENTS, _VECTORS, NUMBERS, CLAIMS, FACTUAL) + f""",
h AS (
  SELECT sample_id, count(*) AS n, avg(((sample_id * 11 + pos * 29) % 64) / 128.0::DOUBLE) AS e,
         avg(sim) AS s FROM lettered GROUP BY ALL)
SELECT o.sample_id,
       CASE WHEN o.source = '' THEN 0.0 WHEN h.n IS NULL THEN 1.0
            ELSE {r('0.6::DOUBLE * h.e + 0.4::DOUBLE * h.s')} END AS hallucination_score,
       'model' AS hallucination_method, f.f AS factual_accuracy_score,
       'model' AS factual_accuracy_method
FROM outs o JOIN f_scores f USING (sample_id, slot) LEFT JOIN h USING (sample_id)""")

# --- configured or documented, not part of a decision ---------------------------------------
_add("weighted_score", _SAMPLE_SCORES + f"""
SELECT sample_id, {r('(0.3::DOUBLE * h + 0.25::DOUBLE * f + 0.25::DOUBLE * sf + 0.2::DOUBLE * q) / (0.3::DOUBLE + 0.25::DOUBLE + 0.25::DOUBLE + 0.2::DOUBLE)', 6)}
       AS weighted_score
FROM scores""")
_add("rating_by_table", _SAFE + """
SELECT suite_id, CASE WHEN tox < 0.1 AND n <= 0 THEN 'G' WHEN tox < 0.25 AND n <= 0 THEN 'PG'
                      WHEN tox < 0.6 AND n <= 2 THEN 'PG-13' ELSE 'R' END AS rating,
       count(*) AS n
FROM (SELECT s.sample_id, o.suite_id, s.tox,
             s.n_pii + coalesce((SELECT sum(h.n) FROM hits h WHERE h.sample_id = s.sample_id), 0) AS n
      FROM s_scores s JOIN outs o USING (sample_id))
GROUP BY ALL""")
_add("rubric_check", _with(PAIRS, f"""gold AS (
  SELECT DISTINCT sample_id, w FROM (
    SELECT sample_id, unnest({_words('lower(baseline)')}) AS w FROM pairs) WHERE w <> ''),
have AS (
  SELECT DISTINCT sample_id, w, 1 AS one FROM (
    SELECT sample_id, unnest({_words('lower(candidate)')}) AS w FROM pairs))""") + f"""
SELECT p.sample_id, CASE WHEN g.o IS NOT NULL THEN {r('g.o')} END AS gold_overlap,
       concat_ws('|', CASE WHEN g.o >= 0.5 THEN 'gold_overlap' END, CASE WHEN length(candidate) < 2000 THEN 'brief' END,
                 CASE WHEN NOT contains(candidate, '|') THEN 'no_bars' END) AS passed,
       concat_ws('|', CASE WHEN g.o < 0.5 THEN 'gold_overlap' END, CASE WHEN length(candidate) >= 2000 THEN 'brief' END,
                 CASE WHEN contains(candidate, '|') THEN 'no_bars' END) AS failed
FROM pairs p LEFT JOIN (
  SELECT sample_id, count(one)::DOUBLE / count(*)::DOUBLE AS o
  FROM gold LEFT JOIN have USING (sample_id, w) GROUP BY ALL) g USING (sample_id)""")
_add("run_metrics", _with(_RUNS) + f"""
SELECT suite_id, runs, passes, failures, reviews, regressions,
       {r('passes::DOUBLE / runs::DOUBLE', 6)} AS pass_ratio
FROM (SELECT suite_id, count(*) AS runs, count(*) FILTER (decision = 'pass') AS passes,
             count(*) FILTER (decision = 'fail') AS failures,
             count(*) FILTER (decision = 'human_review') AS reviews,
             count(*) FILTER (reason_code IN ('3a', '3b')) AS regressions
      FROM runs GROUP BY ROLLUP (suite_id))""")
_add("metrics_by_evaluator", _with(PAIRS, AB_OUTS, _PAIRED) + f""",
judged AS (
  SELECT *, evaluator = 'content_safety' AND sample_id % 10 = 7 AS failed, round(a * 10000)::BIGINT AS units FROM paired),
summed AS (
  SELECT CASE grouping(suite_id, evaluator) WHEN 0 THEN 'suite and evaluator' WHEN 1 THEN 'suite'
         WHEN 2 THEN 'evaluator' ELSE 'all' END AS level,
         suite_id, evaluator, count(*) AS results, count(*) FILTER (failed) AS errors,
         count(*) FILTER (NOT failed) AS scored, count(*) FILTER (NOT failed AND a < b) AS regressions,
         sum(units) FILTER (NOT failed) AS units
  FROM judged GROUP BY GROUPING SETS ((suite_id, evaluator), (suite_id), (evaluator), ()))
SELECT level, suite_id, evaluator, results, errors, scored, regressions, CASE WHEN scored > 0 THEN scored END AS sketched,
       {r('errors / results::DOUBLE', 6)} AS error_rate, {r('units / (scored * 10000.0::DOUBLE)', 6)} AS mean_score
FROM summed""")
_add("regression_trend", _with(_RUNS) + f""",
means AS (
  SELECT suite_id, suite_version, count(*) AS runs, min(ingest_seq) AS first_saved,
         sum(round(aggregate_score * 10000)::BIGINT)::DOUBLE / (count(*)::DOUBLE * 10000) AS m
  FROM runs GROUP BY ALL),
windowed AS (
  SELECT *, m - lag(m) OVER w AS change,
         avg(m) OVER (PARTITION BY suite_id ORDER BY first_saved
                      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling
  FROM means WINDOW w AS (PARTITION BY suite_id ORDER BY first_saved))
SELECT suite_id, suite_version, runs, {r('m', 6)} AS mean_score,
       CASE WHEN change IS NOT NULL THEN {r('change', 6)} END AS change,
       {r('rolling', 6)} AS rolling_mean
FROM windowed""")
_add("golden_set_latest", """
SELECT user_id AS case_id, event_id AS version, event_type, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
_add("enforcement_level", GATE + """
SELECT d.sample_id, CASE WHEN code = '1' OR x.sample_id IS NOT NULL THEN 'hard_gate'
                         WHEN code IN ('2', '3a', '3b') THEN 'ticket' ELSE 'monitor' END AS level
FROM decided d LEFT JOIN (
  SELECT DISTINCT sample_id FROM all_flags
  WHERE starts_with(category, 'pii:') OR starts_with(category, 'toxicity:')) x USING (sample_id)""")
_add("no_regression_on_blockers", _with(PAIRS, AB_OUTS, _PAIRED) + """
SELECT sample_id, concat_ws('|', CASE WHEN ah < bh THEN 'hallucination' END,
         CASE WHEN af < bf THEN 'factual_accuracy' END,
         CASE WHEN asf < bsf THEN 'content_safety' END,
         CASE WHEN aq < bq THEN 'quality' END) AS regressed
FROM wide""")
_add("compacted_history", _with(_RUNS) + """
SELECT run_id, ingest_seq % 5 AS ingest_seq, suite_id, decision, aggregate_score FROM runs
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ingest_seq % 5 DESC, ingest_seq DESC) = 1""")
_add("spot_check_gate", GATE + """,
timed AS (
  SELECT sample_id, TIMESTAMP '2024-01-01' + to_hours((sample_id - CASE WHEN sample_id % 10 = 0 THEN 720 ELSE 0 END)::INT) AS t,
         floor(sample_id * 3 / ((SELECT max(doc_id) FROM documents) + 1))::INT AS part
  FROM (SELECT doc_id AS sample_id FROM documents)),
marks AS (
  SELECT a.part, max(b.t) - INTERVAL 10 MINUTE AS mark
  FROM (SELECT DISTINCT part FROM timed) a JOIN timed b ON b.part < a.part GROUP BY ALL)
SELECT strftime(date_trunc('day', t), '%Y-%m-%d') AS day, d.suite_id, d.decision,
       coalesce(date_trunc('day', t) + INTERVAL 1 DAY <= mark, false) AS late, count(*) AS n
FROM timed JOIN decided d USING (sample_id)
LEFT JOIN marks USING (part)
WHERE ('0x' || substr(md5(sample_id::VARCHAR), 1, 8))::BIGINT < 2147483648
GROUP BY ALL""")
_add("spot_check_stream", _with(_RUNS) + """
SELECT strftime(day, '%Y-%m-%d') AS day, suite_id, decision, count(*) AS n
FROM (SELECT *, date_trunc('day', saved_at) AS day FROM runs)
GROUP BY ALL""")
