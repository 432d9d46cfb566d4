"""DuckDB SQL for the query catalogue: the same answers, written independently.

The statements are composed from a few shared common table expressions; each
covers the whole tables.
"""

from __future__ import annotations

import re

from ..functions.labels import SPONSORSHIP_BADGES, SPONSORSHIP_LABELS
from ..functions.urls import TRACKING_KEYS
from ..rules import CORPUS, HARD_DISQUALIFIERS, SPONSORSHIP_FACTORS
from ..schema import SOURCE_TYPES
from .views import ARCHIVE_SEEN, FETCH_TS, PARTS, PREVIOUS_SEEN, RUN_TS, SECOND_TS

P = CORPUS
SPACES = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
NOT_WORD = r"[^\p{L}\p{N}_]"


def quoted(text: object) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def listed(terms) -> str:
    return "CAST([" + ", ".join(quoted(t) for t in terms) + "] AS VARCHAR[])"


def norm_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def strip_ws(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACES}', ''), '{SPACES}$', '')"


def truncated(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN regexp_replace(left({x}, {n - 1}), '{SPACES}$', '') || '…' ELSE {x} END"


def escaped(x: str) -> str:
    return strip_ws(f"replace(replace(replace({x}, '\\', '\\\\'), '|', '\\|'), chr(10), ' ')")


def hits(low: str, terms) -> str:
    return f"list_filter({listed(terms)}, lambda p: contains({low}, p))"


def bounded(low: str, term: str) -> str:
    return f"regexp_matches({low}, '(^|{NOT_WORD})' || regexp_escape({term}) || '($|{NOT_WORD})')"


def word_hits(low: str, terms) -> str:
    """Constant patterns, so the engine compiles each of them once."""
    tests = []
    for term in terms:
        literal = "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term.lower())
        pattern = f"(^|{NOT_WORD}){literal}($|{NOT_WORD})"
        tests.append(
            f"CASE WHEN contains({low}, {quoted(term.lower())}) AND regexp_matches({low}, {quoted(pattern)}) THEN {quoted(term)} END"
        )
    return f"list_filter([{', '.join(tests)}], lambda p: p IS NOT NULL)"


def semis(x: str) -> str:
    return f"coalesce(array_to_string({x}, '; '), '')"


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '-')"


def cased(x: str, table: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {default} END"


def rounded(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INTEGER)"


def encoded(x: str) -> str:
    return f"replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"


def canonical(x: str) -> str:
    """Canonical form of http(s) addresses (all driver addresses are)."""
    query = f"regexp_extract({x}, '\\?([^#]*)', 1)"
    tracked = listed(TRACKING_KEYS)
    kept = (
        f"list_filter(string_split({query}, '&'), lambda q: regexp_matches(q, '^[^=]*=.') "
        f"AND NOT list_contains({tracked}, lower(split_part(q, '=', 1))))"
    )
    pairs = (
        f"array_to_string(list_transform({kept}, lambda q: {encoded('split_part(q, chr(61), 1)')} || '=' || "
        + encoded("regexp_replace(q, '^[^=]*=', '')") + "), '&')"
    )
    base = (
        f"lower(regexp_extract({x}, '^([A-Za-z]+)://', 1)) || '://' || "
        f"lower(regexp_extract({x}, '^[A-Za-z]+://([^/?#]*)', 1)) || "
        f"rtrim(regexp_replace(regexp_extract({x}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/')"
    )
    return f"CASE WHEN {x} = '' THEN '' ELSE {base} || CASE WHEN coalesce({pairs}, '') <> '' THEN '?' || {pairs} ELSE '' END END"


def passage(text: str, phrase: str, context: int = 160) -> str:
    """Sentence around the first hit; positions instead of nested cuts."""
    at = f"strpos(lower({text}), lower({phrase}))"
    left = f"regexp_extract(left({text}, {at} - 1), '[^.\\n•]*$')"
    right = f"regexp_extract(substr({text}, {at} + length({phrase})), '^[^.\\n]*[.\\n]?')"
    clip = f"length({left}) + length({right}) > {2 * context}"
    inner = (
        f"CASE WHEN {clip} THEN right({left}, {context}) ELSE {left} END || "
        f"substr({text}, {at}, length({phrase})) || "
        f"CASE WHEN {clip} THEN left({right}, {context}) ELSE {right} END"
    )
    return norm_ws(inner)


SENTENCE = "trim(split_part(split_part(text, chr(10), 1), '.', 1))"

DOCS = f"""docs AS (
  SELECT doc_id, source AS company, {SENTENCE} AS title, text AS description, lang FROM documents)"""

RECORDS = f"""records AS (
  SELECT d.doc_id, d.source AS company, CAST(d.doc_id AS VARCHAR) AS source_job_id, {SENTENCE} AS title,
    CASE lang WHEN 'es' THEN 'Remote' WHEN 'de' THEN '' ELSE coalesce(r_name, '') END AS location,
    CASE WHEN lang IN ('es', 'fr') THEN '' ELSE coalesce(n_name, '') END AS country,
    text AS description, coalesce(url, '') AS application_url,
    CASE WHEN lang = 'es' THEN '' ELSE coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') END AS date_posted,
    lang, n_chars
  FROM documents d
  LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
    ON n_nationkey = n_chars % 25
  LEFT JOIN orders ON o_orderkey = d.doc_id
  LEFT JOIN pages ON page_id = d.doc_id)"""

_NUM = "CAST(regexp_extract(name, '([0-9]+)$', 1) AS INTEGER)"
SOURCES = f"""sources AS (
  SELECT n AS source_no, name, n % 7 <> 6 AS enabled, n % 5 AS priority,
    {listed([*SOURCE_TYPES, 'pigeon'])}[(n % {len(SOURCE_TYPES) + 1}) + 1] AS source_type,
    CASE n % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['EUROPE', 'NATION_7']
      WHEN 2 THEN ['asia', 'nation_1'] ELSE ['Africa', 'Middle East'] END AS locations,
    CASE WHEN n % 2 = 0 THEN 'checked by hand' ELSE '' END AS notes
  FROM (SELECT name, {_NUM} AS n FROM (SELECT DISTINCT source AS name FROM documents)))"""

RUN_LOG = """run_log AS (
  SELECT 'src' || user_id AS company, ts AS run_ts, event_id AS run_id,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'skipped'
      WHEN floor(value) > 0 THEN 'ok' ELSE 'ok_empty' END AS status,
    CAST(floor(value) AS BIGINT) AS jobs_fetched
  FROM events)"""

OK_SOURCES = """ok_sources AS (
  SELECT company FROM (
    SELECT company, status, row_number() OVER (PARTITION BY company ORDER BY run_ts DESC, run_id DESC) AS nth
    FROM run_log) WHERE nth = 1 AND status IN ('ok', 'ok_empty'))"""

TITLE_HITS = f"""{word_hits('lower(title)', [*P.include_level, *P.include_role])} AS matched,
    {word_hits('lower(title)', P.exclude)} AS excluded"""

_LOW_PLACE = "lower(location || ' ' || country)"
ALLOWED = f"""CASE WHEN contains(lower(country), 'united states') THEN TRUE
    WHEN coalesce(len(locations), 0) = 0 THEN TRUE
    WHEN trim({_LOW_PLACE}) = '' THEN FALSE
    WHEN len(list_filter(locations, lambda a: {bounded(_LOW_PLACE, 'lower(a)')})) > 0 THEN TRUE
    ELSE contains({_LOW_PLACE}, 'remote') AND country = '' END"""


def gated(feed: str, name: str = "gated") -> str:
    return f"""{name} AS (
  SELECT * REPLACE (CASE WHEN country = '' THEN {quoted(P.default_country)} ELSE country END AS country)
  FROM (SELECT f.*, {TITLE_HITS} FROM {feed} f LEFT JOIN sources s ON s.name = f.company
    WHERE f.title <> '' AND ({ALLOWED})
      AND (date_posted = '' OR left(date_posted, 10) >= {quoted(P.min_posted_date)}))
  WHERE len(matched) > 0 AND len(excluded) = 0)"""


SPONSOR_HITS = f"""{hits('low', P.ineligible)} AS h_ineligible, {hits('low', P.negative)} AS h_negative,
    {hits('low', P.positive)} AS h_positive, {hits('low', P.weak_positive)} AS h_weak"""
CLASS = """CASE WHEN len(h_ineligible) > 0 THEN 'ineligible' WHEN len(h_negative) > 0 THEN 'likely_not_supported'
    WHEN len(h_positive) > 0 THEN 'likely_supported' WHEN len(h_weak) > 0 THEN 'possibly_supported'
    ELSE 'unclear' END"""
DECIDING = "coalesce(h_ineligible[1], h_negative[1], h_positive[1], h_weak[1])"

_WEIGHT = P.weights
AGE = f"""CASE WHEN try_cast(date_posted AS DATE) IS NULL THEN NULL
    ELSE greatest(0, date_diff('day', CAST(date_posted AS DATE), DATE '{RUN_TS[:10]}')) END"""
RECENCY = f"""CASE WHEN age IS NULL THEN 0.5::DOUBLE WHEN age <= {P.recency_full_days} THEN 1.0::DOUBLE
    WHEN age >= {P.recency_zero_days} THEN 0.0::DOUBLE
    ELSE 1.0::DOUBLE - (age - {P.recency_full_days}) / {P.recency_zero_days - P.recency_full_days}.0::DOUBLE END"""
ROLE_SCORE = """least(100, CASE WHEN len(prim) = 0 AND len(sec) > 0 THEN 45
    WHEN len(prim) > 0 OR len(matched) > 0 THEN 60 ELSE 0 END + least(40, 5 * len(skills)))"""
KEYWORDS = "list_sort(list_distinct(list_concat(matched, skills)))"
_LOW_SKILLS = [s.lower() for s in P.skills]
ROLE_PARTS = f"""{hits('lower(title)', [r.lower() for r in P.primary_roles])} AS prim,
    {hits('lower(title)', [r.lower() for r in P.secondary_roles])} AS sec,
    {word_hits('low', _LOW_SKILLS)} AS skills"""


def judged(name: str, source: str) -> str:
    """Classify and score a gated feed (no years occur near the prose's rules)."""
    return f"""{name}_1 AS (
  SELECT *, title || ' ' || description || ' ' AS full_text, lower(title || ' ' || description || ' ') AS low
  FROM {source}),
{name}_2 AS (
  SELECT *, {SPONSOR_HITS}, {ROLE_PARTS}, {AGE} AS age,
    len(list_filter(matched, lambda m: len(list_filter({listed(P.new_grad_markers)}, lambda k: contains(m, k))) > 0)) > 0 AS marked,
    len(regexp_extract_all(title, '(^|{NOT_WORD})20[0-9][0-9]($|{NOT_WORD})')) AS years
  FROM {name}_1),
{name}_3 AS (
  SELECT *, {CLASS} AS sponsorship_classification, CAST({ROLE_SCORE} AS INTEGER) AS role_match_score,
    {DECIDING} AS phrase, 'unspecified' AS graduation_match FROM {name}_2),
{name}_4 AS (
  SELECT *, CASE WHEN phrase IS NULL THEN '' ELSE {truncated(f"coalesce(nullif({passage('full_text', 'phrase')}, ''), phrase)", 400)} END AS sponsorship_evidence,
    {rounded(f'role_match_score / 100.0::DOUBLE * {_WEIGHT["role_skills"]}')} AS pts_role,
    {rounded(f'CASE WHEN marked THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * {_WEIGHT["graduation"]}')} AS pts_grad,
    {rounded(f'{cased("sponsorship_classification", SPONSORSHIP_FACTORS, "0.45")}::DOUBLE * {_WEIGHT["sponsorship"]}')} AS pts_sponsor,
    CASE WHEN lower(country) LIKE 'united states%' OR location <> '' THEN {_WEIGHT["location"]} ELSE {_WEIGHT["location"] // 2} END AS pts_loc,
    {rounded(f'({RECENCY}) * {_WEIGHT["recency"]}')} AS pts_recency
  FROM {name}_3),
{name} AS (
  SELECT *, CAST(pts_role + pts_grad + pts_sponsor + pts_loc + pts_recency AS INTEGER) AS overall_score,
    'role ' || pts_role || '/{_WEIGHT["role_skills"]} (' ||
      CASE WHEN len(prim) > 0 THEN 'primary role match (' || prim[1] || ')'
        WHEN len(sec) > 0 THEN 'secondary role match (' || sec[1] || ')'
        ELSE 'title matched filter terms' END ||
      CASE WHEN len(skills) > 0 THEN '; skills: ' || array_to_string(skills[1:6], ', ') ELSE '' END || ') · ' ||
    'graduation ' || pts_grad || '/{_WEIGHT["graduation"]} (unspecified) · ' ||
    'sponsorship ' || pts_sponsor || '/{_WEIGHT["sponsorship"]} (' || sponsorship_classification || ') · ' ||
    'location ' || pts_loc || '/{_WEIGHT["location"]} (' || CASE WHEN location <> '' THEN left(location, 40) ELSE 'location unknown' END || ') · ' ||
    'recency ' || pts_recency || '/{_WEIGHT["recency"]} (' || CASE WHEN age IS NULL THEN 'posting date unknown' ELSE 'posted ' || age || 'd ago' END || ') · ' ||
    'graduation note: no graduation year stated; assumed open to upcoming grads' AS score_explanation,
    list_contains({listed(HARD_DISQUALIFIERS)}, sponsorship_classification) AS disqualified,
    CASE WHEN list_contains({listed(HARD_DISQUALIFIERS)}, sponsorship_classification)
      THEN 'sponsorship classification ''' || sponsorship_classification || '''' ||
        CASE WHEN sponsorship_evidence <> '' THEN ': ' || left(sponsorship_evidence, 160) ELSE '' END
      ELSE '' END AS disqualify_reason
  FROM {name}_4)"""


ALL_JUDGED = f"""{RECORDS}, {SOURCES}, {gated('records')}, {judged('judged_all', 'gated')},
judged AS (SELECT *, {slug('company')} || '-' || source_job_id AS job_id FROM judged_all)"""

HISTORY = f"""history AS (
  SELECT r.*, quality, toxic,
    CASE WHEN quality = 0 OR (quality IS NULL AND lang = 'de') THEN 'archive'
      WHEN quality IS NULL AND lang = 'fr' THEN 'unseen' ELSE 'active' END AS slot,
    coalesce(toxic, 0) = 1 OR contains(application_url, '#') AS left_feed,
    {slug('company')} || '-' || source_job_id AS own_id
  FROM records r LEFT JOIN labels USING (doc_id)),
state AS (
  SELECT CASE slot WHEN 'active' THEN 0 ELSE 1 END AS scope, own_id AS job_id, company, title, location, application_url,
    CASE slot WHEN 'active' THEN '{PREVIOUS_SEEN}' ELSE '{ARCHIVE_SEEN}' END AS first_seen,
    CASE slot WHEN 'active' THEN '{PREVIOUS_SEEN}' ELSE '{ARCHIVE_SEEN}' END AS last_seen,
    CASE slot WHEN 'active' THEN 'active' ELSE 'closed' END AS status,
    CASE slot WHEN 'active' THEN CAST(least(2, floor(n_chars / 1000)) AS INTEGER) ELSE 3 END AS consecutive_missing,
    CASE slot WHEN 'active' THEN coalesce(quality = 1, FALSE) ELSE TRUE END AS announced
  FROM history WHERE slot <> 'unseen'),
fetched AS (
  SELECT h.doc_id * 2 + copy AS fetch_ord, company, title, location, country, description, date_posted,
    CASE WHEN lang = 'es' THEN 'new-' || source_job_id ELSE source_job_id END AS source_job_id,
    CASE WHEN lang = 'es' AND application_url <> '' THEN application_url ||
      CASE WHEN contains(application_url, '?') THEN '&' ELSE '?' END || 'utm_source=x' ELSE application_url END AS application_url
  FROM history h CROSS JOIN (SELECT unnest([0, 1]) AS copy)
  WHERE NOT left_feed AND company IN (SELECT company FROM ok_sources) AND (copy = 0 OR coalesce(quality, 0) = 1))"""


def fp(t: str = "") -> str:
    cols = [f"lower({strip_ws(t + c)})" for c in ("company", "title", "location", "application_url")]
    return "sha256(" + " || '|' || ".join(cols) + ")"


def merge(feed: str, score: str, extra: str) -> str:
    """The merge as six left joins, one per tier and scope."""
    ranks = [(s, t) for s in (0, 1) for t in ("id", "url", "fp")]
    joins, when_rank, when_hist = [], [], []
    for rank, (scope, tier) in enumerate(ranks, 1):
        a = f"k{rank}"
        joins.append(f"LEFT JOIN (SELECT {tier}_key AS key, arg_min(h, (lower_company, job_id)) AS h FROM keyed WHERE scope = {scope} AND {tier}_key IS NOT NULL GROUP BY 1) {a} ON {a}.key = f.{tier}_key")
        when_rank.append(f"WHEN {a}.h IS NOT NULL THEN {rank}")
        when_hist.append(f"{a}.h")
    stamp = FETCH_TS.replace(" ", "T") + "Z"
    return f"""keyed AS (
  SELECT *, lower(company) AS lower_company, job_id AS id_key,
    CASE WHEN application_url <> '' THEN company || chr(1) || {canonical('application_url')} END AS url_key,
    {fp()} AS fp_key, {{'job_id': job_id, 'first_seen': first_seen, 'announced': announced}} AS h
  FROM state),
feed AS (
  SELECT *, {slug('company')} || '-' || source_job_id AS id_key,
    CASE WHEN application_url <> '' THEN company || chr(1) || {canonical('application_url')} END AS url_key,
    {fp()} AS fp_key FROM {feed}),
resolved AS (
  SELECT f.*, CASE {' '.join(when_rank)} END AS rnk, coalesce({', '.join(when_hist)}) AS h
  FROM feed f {' '.join(joins)}),
firsts AS (
  SELECT * FROM (
    SELECT *, coalesce(h.job_id, id_key) AS job_id,
      row_number() OVER (PARTITION BY coalesce(h.job_id, id_key) ORDER BY fetch_ord) AS nth FROM resolved)
  WHERE nth = 1),
tiers AS (SELECT *, coalesce(['active/id', 'active/url', 'active/fingerprint', 'archive/id', 'archive/url', 'archive/fingerprint'][rnk], 'none') AS matched_by FROM firsts),
merged AS (
  SELECT job_id, company, title, application_url, coalesce(h.first_seen, '{stamp}') AS first_seen, '{stamp}' AS last_seen,
    'active' AS status, 0 AS consecutive_missing, coalesce(h.announced, FALSE) AS announced,
    CASE WHEN rnk IS NULL THEN 'new' WHEN rnk <= 3 THEN 'continuing' ELSE 'reopened' END AS lifecycle, matched_by, {score}
  FROM tiers
  UNION ALL
  SELECT job_id, company, title, application_url, first_seen, last_seen,
    CASE WHEN ok AND consecutive_missing + 1 >= {P.archive_after_missing_runs} THEN 'closed' ELSE status END,
    CASE WHEN ok THEN consecutive_missing + 1 ELSE consecutive_missing END, announced,
    CASE WHEN NOT ok THEN 'carried' WHEN consecutive_missing + 1 >= {P.archive_after_missing_runs} THEN 'closed' ELSE 'missing' END,
    'none', {extra}
  FROM (SELECT *, company IN (SELECT company FROM ok_sources) AS ok FROM state
    WHERE scope = 0 AND job_id NOT IN (SELECT job_id FROM firsts))
  UNION ALL
  SELECT job_id, company, title, application_url, first_seen, last_seen, status, consecutive_missing, announced,
    'archived', 'none', {extra}
  FROM state WHERE scope = 1 AND job_id NOT IN (SELECT job_id FROM firsts WHERE rnk > 3))"""


_NUMBERED = re.compile(r"\b(state|keyed|feed|resolved|firsts|tiers|merged|ok_sources)\b")


def numbered(sql: str, n: int) -> str:
    """The parts of a merge under names of their own, so that several runs follow one another."""
    return _NUMBERED.sub(rf"\g<1>_{n}", sql)


def next_state(n: int, extra: str, announced: str = "announced") -> str:
    """What the run after run n starts from."""
    return f"""state_{n + 1} AS (
  SELECT CASE WHEN lifecycle IN ('closed', 'archived') THEN 1 ELSE 0 END AS scope, job_id, company, title, application_url,
    first_seen, last_seen, status, consecutive_missing, {announced} AS announced, {extra} FROM merged_{n})"""


_MERGE_BASE = f"{RECORDS}, {RUN_LOG}, {OK_SOURCES}, {HISTORY}"
MERGED = f"{_MERGE_BASE}, {merge('fetched', 'NULL AS x', 'NULL')}"
_SCORE_COLUMNS = ["overall_score", "disqualified", "sponsorship_classification", "sponsorship_evidence",
                  "score_explanation", "location", "date_posted"]
_EXTRA = "0, FALSE, 'unclear', '', '', location, ''"
JUDGED_MERGE = (
    f"{_MERGE_BASE}, {SOURCES}, {gated('fetched', 'gated_feed')}, {judged('judged_feed', 'gated_feed')}, "
    + merge("judged_feed", ", ".join(_SCORE_COLUMNS), _EXTRA)
)
ACTIVE = "lifecycle NOT IN ('closed', 'archived')"
ELIGIBLE = f"lifecycle = 'new' AND NOT disqualified AND overall_score >= {P.digest_min_score} AND NOT announced"
STATE_COLUMNS = "job_id, company, first_seen, last_seen, status, consecutive_missing, announced, lifecycle, matched_by"

FOLD = f"""{RUN_LOG}, marked AS (
  SELECT *, max(CASE WHEN status IN ('ok', 'ok_empty') THEN (run_ts, run_id) END) OVER (PARTITION BY company) AS last_ok,
    row_number() OVER (PARTITION BY company ORDER BY run_ts DESC, run_id DESC) AS nth FROM run_log),
folded AS (
  SELECT company, strftime(max(run_ts), '%Y-%m-%dT%H:%M:%SZ') AS last_attempt,
    coalesce(strftime(max(run_ts) FILTER (WHERE status IN ('ok', 'ok_empty')), '%Y-%m-%dT%H:%M:%SZ'), '') AS last_success,
    max(status) FILTER (WHERE nth = 1) AS status,
    CAST(coalesce(max(jobs_fetched) FILTER (WHERE nth = 1 AND status IN ('ok', 'ok_empty')), 0) AS BIGINT) AS jobs_fetched,
    count(*) FILTER (WHERE status = 'failed' AND (last_ok IS NULL OR (run_ts, run_id) > last_ok)) AS consecutive_failures,
    count(*) AS runs
  FROM marked GROUP BY company)"""
HEALTH = f"""{FOLD}, health AS (
  SELECT company, 'json' AS source_type, last_attempt, last_success, status, jobs_fetched,
    CASE status WHEN 'failed' THEN 'network_error' WHEN 'skipped' THEN 'unsupported' ELSE status END AS error_category,
    'last run of ' || company || ' | ' || last_attempt AS error_message,
    CAST(consecutive_failures AS INTEGER) AS consecutive_failures FROM folded)"""
OUTCOMES = f"""{SOURCES}, fetched_rows AS (
  SELECT source AS company, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1),
broken AS (
  SELECT source AS company, min('document ' || doc_id) AS message FROM documents JOIN labels USING (doc_id)
  WHERE toxic = 1 AND quality = 0 GROUP BY 1),
outcomes AS (
  SELECT name AS company, source_type,
    CASE WHEN skipped THEN 'skipped' WHEN message IS NOT NULL THEN 'failed' WHEN n > 0 THEN 'ok' ELSE 'ok_empty' END AS status,
    CAST(CASE WHEN skipped OR message IS NOT NULL THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS jobs_fetched,
    CASE WHEN skipped THEN 'unsupported' WHEN message IS NOT NULL THEN 'structure_changed'
      WHEN n > 0 THEN 'ok' ELSE 'ok_empty' END AS error_category,
    CASE WHEN skipped THEN coalesce(nullif(notes, ''), 'disabled in the source list')
      WHEN message IS NOT NULL THEN message ELSE '' END AS error_message
  FROM (SELECT *, NOT enabled OR source_type = 'unresolved' AS skipped FROM sources)
  LEFT JOIN fetched_rows f ON f.company = name LEFT JOIN broken b ON b.company = name)"""
VALIDATION = f"""{OUTCOMES}, {DOCS}, seen AS (
  SELECT company, count(*) AS n, arg_min(title, doc_id) AS first_title FROM docs GROUP BY 1),
validation AS (
  SELECT o.company,
    CASE WHEN o.source_type = 'unresolved' THEN 'unresolved' WHEN NOT s.enabled THEN 'disabled'
      WHEN status = 'failed' THEN 'FAILED (' || error_category || ')' ELSE 'ok (' || coalesce(n, 0) || ' jobs)' END AS result,
    CASE WHEN o.source_type = 'unresolved' OR NOT s.enabled THEN coalesce(s.notes, '')
      WHEN status IN ('ok', 'ok_empty') THEN left(coalesce(first_title, ''), 80) ELSE left(error_message, 160) END AS detail,
    CASE status WHEN 'failed' THEN 1 ELSE 0 END AS failing
  FROM outcomes o JOIN sources s ON s.name = o.company LEFT JOIN seen USING (company))"""

BADGE = cased("sponsorship_classification", SPONSORSHIP_BADGES, "sponsorship_classification")
_PLACE = escaped(truncated("location", 60))
ACTIVE_LINE = (
    f"'| [Apply](' || application_url || ') | ' || {escaped('company')} || ' | ' || {escaped('title')} || ' | ' || "
    f"{_PLACE} || ' | ' || {BADGE} || ' | ' || coalesce(nullif(date_posted, ''), '—') || ' |'"
)
_REASON = "coalesce(nullif(sponsorship_evidence, ''), score_explanation)"
DIGEST_LINE = (
    f"'| [Apply](' || application_url || ') | ' || {escaped('company')} || ' | ' || {escaped('title')} || ' | ' || "
    f"{_PLACE} || ' | ' || overall_score || ' | ' || {BADGE} || ' | ' || {escaped(truncated(_REASON, 160))} || ' |'"
)
CHAT_LINE = (
    "'• ' || company || ' — ' || title || ' (' || coalesce(nullif(location, ''), 'location n/a') || ') score ' || "
    "overall_score || ' [' || sponsorship_classification || ']' || chr(10) || '  ' || application_url"
)
BAND = (
    f"CASE WHEN overall_score >= {P.thresholds['excellent']} THEN 'excellent' WHEN overall_score >= {P.thresholds['strong']} THEN 'strong' "
    f"WHEN overall_score >= {P.thresholds['possible']} THEN 'possible' ELSE 'low' END"
)
PRIORITY = "coalesce((SELECT priority FROM sources s WHERE s.name = company), 9)"
SORTED = f"overall_score, date_posted, {PRIORITY} AS priority, company, job_id"
ORDER = (
    "overall_score DESC, coalesce(date_diff('day', DATE '1970-01-01', try_cast(date_posted AS DATE)), 0) DESC, "
    "priority, lower(company), job_id"
)
FAMILY = "CASE " + " ".join(
    f"WHEN regexp_matches(title, '(?i){pattern}') THEN {quoted(name)}" for name, pattern in P.families
) + " ELSE 'other' END"
_SUMMARY_STATE = f"""count(*) FILTER (WHERE {ACTIVE}) AS active_jobs, count(*) FILTER (WHERE lifecycle = 'new') AS new_jobs,
    count(*) FILTER (WHERE lifecycle = 'closed') AS closed_jobs, count(*) FILTER (WHERE {ELIGIBLE}) AS digest_jobs"""

_YEAR_TEXTS = """years AS (
  SELECT o_orderkey,
    CASE WHEN lvl = '1' THEN 'Engineer, class of ' || y ELSE 'Engineer' END AS title,
    CASE lvl WHEN '2' THEN 'Graduating in ' || y || ' or 2026.'
      WHEN '3' THEN y || ' grads are welcome; founded 2019.'
      WHEN '4' THEN 'Since ' || y || ' we have grown.'
      ELSE 'Expected completion: May ' || y END AS description
  FROM (SELECT o_orderkey, left(o_orderpriority, 1) AS lvl, CAST(year(o_orderdate) + 30 AS VARCHAR) AS y FROM orders))"""
_CONTEXT = r"(?i)(?:graduat\w+|class of|degree|expected|completion)\D{0,40}\b20\d{2}\b|\b20\d{2}\b\D{0,40}(?:graduat\w+|grads?\b)"


def _years(xs) -> str:
    return "[" + ", ".join(str(x) for x in xs) + "]"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


ORACLE: dict[str, str] = {
    "canonical_urls": f"SELECT page_id, {canonical('url')} AS canonical_url FROM pages",
    "site_links": """SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/jobs' AS rooted,
      regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || 'next' AS beside,
      regexp_extract(url, '^([a-z]+):', 1) || '://cdn.example.org/x' AS other_host, url AS itself FROM pages""",
    "url_dedup_first_wins": f"""SELECT canonical_url, min(page_id) AS page_id
      FROM (SELECT page_id, {canonical('url')} AS canonical_url FROM pages) WHERE canonical_url <> '' GROUP BY 1""",
    "normalized_text": f"SELECT doc_id, {norm_ws('text')} AS text FROM documents",
    "evidence_passages": _with(
        f"{DOCS}, found AS (SELECT doc_id, description, {hits('lower(description)', P.positive)}[1] AS phrase FROM docs)",
        f"SELECT doc_id, phrase, {passage('description', 'phrase')} AS passage FROM found WHERE phrase IS NOT NULL",
    ),
    "truncated_cells": f"SELECT doc_id, {truncated('text', 140)} AS cell FROM documents",
    "escaped_cells": f"SELECT doc_id, {escaped('text')} AS cell FROM documents",
    "date_texts": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS from_us,
      strftime(o_orderdate, '%Y-%m-%d') AS from_seconds, strftime(o_orderdate, '%Y-%m-%d') AS from_millis,
      CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS ordinal FROM orders""",
    "relative_dates": """SELECT o_orderkey, coalesce(strftime(CAST(o_orderdate AS DATE) - CAST(
        CASE WHEN day(o_orderdate) = 1 THEN 0 WHEN day(o_orderdate) = 2 THEN 1 WHEN day(o_orderdate) = 31 THEN 31
          WHEN o_orderstatus = 'P' THEN NULL ELSE day(o_orderdate) END AS INTEGER), '%Y-%m-%d'), '') AS posted FROM orders""",
    "run_stamps": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y-%m-%d %H:%M UTC') AS utc,
      strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M Asia/Taipei') AS local FROM events""",
    "json_path_values": """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS missing,
      'https://example.com/' || coalesce(json_extract_string(props, '$.k'), '') || '/apply' AS link FROM events""",
    "json_list_values": _with(DOCS, """SELECT doc_id, replace(title, ' ', '|') AS words,
      CAST(length(split_part(title, ' ', 1)) AS VARCHAR) AS first_size, replace(title, ' ', '|') AS listed FROM docs"""),
    "title_gate": _with(
        f"{DOCS}, decided AS (SELECT doc_id, {TITLE_HITS} FROM docs)",
        f"SELECT doc_id, len(matched) > 0 AND len(excluded) = 0 AS passed, {semis('matched')} AS matched, {semis('excluded')} AS excluded FROM decided",
    ),
    "location_gate": _with(
        f"{RECORDS}, {SOURCES}", f"SELECT doc_id, {ALLOWED} AS allowed FROM records LEFT JOIN sources ON name = company"
    ),
    "date_floor": f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders
      WHERE o_orderdate >= TIMESTAMP {quoted(P.min_posted_date)}""",
    "gated_rows": _with(
        f"{RECORDS}, {SOURCES}, {gated('records')}",
        f"SELECT doc_id, company, country, {semis('matched')} AS matched FROM gated",
    ),
    "enabled_sources": _with(SOURCES, "SELECT name, NOT enabled OR source_type = 'unresolved' AS skipped FROM sources"),
    "selected_sources": _with(SOURCES, "SELECT name, priority FROM sources WHERE name IN ('src1', 'src12', 'src7')"),
    "phrase_hit_lists": _with(
        f"{DOCS}, h AS (SELECT doc_id, {SPONSOR_HITS} FROM (SELECT *, lower(description) AS low FROM docs))",
        f"""SELECT doc_id, {semis('h_ineligible')} AS ineligible, {semis('h_negative')} AS negative,
        {semis('h_positive')} AS positive, {semis('h_weak')} AS weak_positive FROM h""",
    ),
    "priority_class": _with(
        f"""{DOCS}, t AS (SELECT doc_id, title || ' ' || description || ' ' AS full_text FROM docs),
        h AS (SELECT doc_id, full_text, {SPONSOR_HITS} FROM (SELECT *, lower(full_text) AS low FROM t)),
        c AS (SELECT *, {DECIDING} AS phrase FROM h)""",
        f"""SELECT doc_id, {CLASS} AS sponsorship_classification,
        CASE WHEN phrase IS NULL THEN '' ELSE {truncated(passage('full_text', 'phrase'), 400)} END AS sponsorship_evidence,
        {semis('list_concat(h_ineligible, h_negative)')} AS risk_flags FROM c""",
    ),
    "year_class": _with(
        f"""{_YEAR_TEXTS}, found AS (
          SELECT o_orderkey, list_transform(regexp_extract_all(title, '\\b20\\d{{2}}\\b'), lambda x: CAST(x AS INTEGER)) AS t,
            list_transform(regexp_extract_all(description, {quoted(_CONTEXT)}), lambda x: CAST(regexp_extract(x, '20\\d{{2}}') AS INTEGER)) AS d FROM years),
        picked AS (SELECT o_orderkey, CASE WHEN len(t) > 0 THEN t ELSE d END AS ys FROM found),
        judged AS (SELECT o_orderkey, list_max(list_intersect(ys, {_years(P.compatible_years)})) AS good,
          list_max(list_intersect(ys, {_years(P.incompatible_years)})) AS bad, list_max(ys) AS last FROM picked)""",
        f"""SELECT o_orderkey,
          CASE WHEN good IS NOT NULL THEN 'compatible_' || good WHEN bad IS NOT NULL THEN 'incompatible_' || bad
            WHEN last > {max(P.compatible_years)} THEN 'future_' || last ELSE 'unspecified' END AS graduation_match,
          CASE WHEN good = 2027 THEN 'posting targets 2027 grads — matches May 2027 graduation'
            WHEN good IS NOT NULL THEN 'posting targets ' || good || ' grads — matches potential Dec 2026 early graduation'
            WHEN bad IS NOT NULL THEN 'posting targets ' || bad || ' grads, before the candidate''s earliest availability (Dec 2026)'
            WHEN last > {max(P.compatible_years)} THEN 'posting targets ' || last || ' grads (later than needed but possibly open)'
            ELSE 'no graduation year stated; assumed open to upcoming grads' END AS graduation_note FROM judged""",
    ),
    "title_family": _with(DOCS, f"SELECT doc_id, {FAMILY} AS family FROM docs"),
    "role_score": _with(
        f"""{DOCS}, parts AS (SELECT doc_id, {TITLE_HITS}, {ROLE_PARTS}
          FROM (SELECT *, lower(title || ' ' || description || ' ') AS low FROM docs)),
        scored AS (SELECT *, CAST({ROLE_SCORE} AS INTEGER) AS role_match_score FROM parts)""",
        f"""SELECT doc_id, role_match_score, {rounded(f'role_match_score / 100.0::DOUBLE * {_WEIGHT["role_skills"]}')} AS points,
        {semis(KEYWORDS)} AS keywords FROM scored""",
    ),
    "recency_score": _with(
        f"aged AS (SELECT o_orderkey, CAST(greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '{RUN_TS[:10]}')) AS INTEGER) AS age FROM orders)",
        f"SELECT o_orderkey, age, {rounded(f'({RECENCY}) * {_WEIGHT["recency"]}')} AS points FROM aged",
    ),
    "overall_score": _with(
        ALL_JUDGED,
        f"""SELECT job_id, role_match_score, graduation_match, sponsorship_classification, overall_score, score_explanation,
        disqualified, disqualify_reason, {semis(KEYWORDS)} AS keywords FROM judged""",
    ),
    "score_bands": _with(ALL_JUDGED, f"SELECT {BAND} AS band, count(*) AS n FROM judged GROUP BY 1"),
    "refined_classes": _with(
        f"{DOCS}, h AS (SELECT doc_id, description, {SPONSOR_HITS} FROM (SELECT *, lower(title || ' ' || description || ' ') AS low FROM docs)), c AS (SELECT doc_id, description, {CLASS} AS cls FROM h)",
        """SELECT doc_id, CASE WHEN cls IN ('unclear', 'possibly_supported') AND length(description) > 2000
        THEN 'possibly_supported' ELSE cls END AS sponsorship_classification FROM c""",
    ),
    "fingerprints": _with(RECORDS, f"SELECT doc_id, {fp()} AS fingerprint FROM records"),
    "record_ids": _with(
        RECORDS,
        f"""SELECT doc_id, {slug('company')} || '-' || CASE WHEN lang = 'fr' THEN left({fp()}, 16) ELSE source_job_id END AS record_id FROM records""",
    ),
    "identity_match_tiers": _with(
        MERGED,
        """SELECT fetch_ord, coalesce(['active/id', 'active/url', 'active/fingerprint', 'archive/id', 'archive/url',
        'archive/fingerprint'][rnk], 'none') AS tier, coalesce(h.job_id, '') AS known_as FROM resolved""",
    ),
    "lifecycle_merge": _with(MERGED, f"SELECT {STATE_COLUMNS} FROM merged"),
    "lifecycle_counts": _with(MERGED, "SELECT lifecycle, count(*) AS n FROM merged GROUP BY 1"),
    "active_rows": _with(MERGED, f"SELECT job_id, title, application_url, first_seen FROM merged WHERE {ACTIVE}"),
    "saved_envelope": _with(
        MERGED, f"SELECT '{FETCH_TS.replace(' ', 'T')}Z' AS generated_at, count(*) AS count FROM merged WHERE {ACTIVE}"
    ),
    "reopened_rows": _with(MERGED, f"SELECT {STATE_COLUMNS} FROM merged WHERE lifecycle = 'reopened'"),
    "closed_this_run": _with(MERGED, f"SELECT {STATE_COLUMNS} FROM merged WHERE lifecycle = 'closed'"),
    "digest_rows": _with(JUDGED_MERGE, f"SELECT job_id, overall_score, sponsorship_classification FROM merged WHERE {ELIGIBLE}"),
    "mark_announced": _with(JUDGED_MERGE, f"SELECT job_id, announced OR ({ELIGIBLE}) AS announced FROM merged WHERE {ACTIVE}"),
    "detail_enrichment_capped": _with(
        f"""{DOCS}, decided AS (SELECT doc_id, company, {TITLE_HITS} FROM docs),
        allowed AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY company ORDER BY doc_id) AS nth
          FROM decided WHERE len(matched) > 0 AND len(excluded) = 0) WHERE nth <= 40)""",
        """SELECT d.doc_id, company, l.quality, l.toxic FROM docs d LEFT JOIN (SELECT * FROM labels WHERE doc_id IN (SELECT doc_id FROM allowed)) l
        ON l.doc_id = d.doc_id""",
    ),
    "detail_enrichment": _with(
        f"{DOCS}, decided AS (SELECT doc_id, company, {TITLE_HITS} FROM docs)",
        """SELECT d.doc_id, company, CASE WHEN ok THEN l.quality END AS quality, CASE WHEN ok THEN l.toxic END AS toxic
        FROM (SELECT doc_id, company, len(matched) > 0 AND len(excluded) = 0 AS ok FROM decided) d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "source_health_fold": _with(FOLD, "SELECT company, last_attempt, last_success, status, jobs_fetched, consecutive_failures, runs FROM folded"),
    "source_outcomes": _with(OUTCOMES, "SELECT company, source_type, status, jobs_fetched, error_category, error_message FROM outcomes"),
    "source_health_step": _with(
        f"{HEALTH}, {OUTCOMES}",
        f"""SELECT coalesce(o.company, h.company) AS company, coalesce(o.source_type, h.source_type) AS source_type,
        CASE WHEN o.company IS NULL THEN h.last_attempt ELSE '{FETCH_TS.replace(' ', 'T')}Z' END AS last_attempt,
        CASE WHEN o.status IN ('ok', 'ok_empty') THEN '{FETCH_TS.replace(' ', 'T')}Z' ELSE coalesce(h.last_success, '') END AS last_success,
        coalesce(o.status, h.status) AS status,
        CASE WHEN o.company IS NULL THEN h.jobs_fetched WHEN o.status IN ('ok', 'ok_empty') THEN o.jobs_fetched ELSE 0 END AS jobs_fetched,
        coalesce(o.error_category, h.error_category) AS error_category, coalesce(o.error_message, h.error_message) AS error_message,
        CAST(CASE WHEN o.status IN ('ok', 'ok_empty') THEN 0 WHEN o.status = 'failed' THEN coalesce(h.consecutive_failures, 0) + 1
          ELSE coalesce(h.consecutive_failures, 0) END AS INTEGER) AS consecutive_failures
        FROM outcomes o FULL OUTER JOIN health h ON h.company = o.company""",
    ),
    "source_problems": _with(
        HEALTH,
        f"""SELECT CASE status WHEN 'failed' THEN 1 ELSE 2 END AS status_rank, {escaped('company')} AS company, status, error_category,
        {escaped(truncated('error_message', 140))} AS detail FROM health WHERE status IN ('failed', 'skipped')""",
    ),
    "source_validation": _with(VALIDATION, "SELECT company, result, detail, failing FROM validation"),
    "failing_sources": _with(VALIDATION, "SELECT CAST(sum(failing) AS BIGINT) AS failing FROM validation"),
    "run_summary": _with(
        # Both parts define the run log; the merge's copy serves the fold too.
        JUDGED_MERGE + HEALTH[len(RUN_LOG):],
        f"""SELECT * FROM (SELECT count(*) FILTER (WHERE status IN ('ok', 'ok_empty')) AS companies_checked,
          count(*) FILTER (WHERE status = 'failed') AS companies_failed,
          count(*) FILTER (WHERE status = 'skipped') AS companies_skipped FROM health),
        (SELECT {_SUMMARY_STATE} FROM merged)""",
    ),
    "report_summary": _with(
        f"{HEALTH}, {ALL_JUDGED}",
        f"""SELECT * FROM (SELECT count(*) AS active_jobs, count(*) FILTER (WHERE NOT disqualified) AS recommended,
          count(*) FILTER (WHERE NOT disqualified AND {BAND} = 'excellent') AS excellent_jobs,
          count(*) FILTER (WHERE NOT disqualified AND {BAND} = 'strong') AS strong_jobs,
          count(*) FILTER (WHERE NOT disqualified AND {BAND} = 'possible') AS possible_jobs,
          count(*) FILTER (WHERE NOT disqualified AND {BAND} = 'low') AS low_jobs FROM judged),
        (SELECT count(*) FILTER (WHERE status IN ('ok', 'ok_empty')) AS sources_ok,
          count(*) FILTER (WHERE status = 'failed') AS sources_failed,
          count(*) FILTER (WHERE status = 'skipped') AS sources_skipped FROM health)""",
    ),
    "rows_per_source": _with(
        SOURCES,
        """SELECT name AS company, coalesce(n, 0) AS jobs_fetched FROM sources
        LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) ON source = name""",
    ),
    "company_list": "SELECT DISTINCT source AS company FROM documents",
    "unknown_sources": """SELECT DISTINCT 'src' || user_id AS name FROM events
      WHERE 'src' || user_id NOT IN (SELECT lower(source) FROM documents)""",
    "duplicate_sources": _with(
        RUN_LOG, "SELECT company AS name, count(DISTINCT status) AS n FROM run_log GROUP BY 1 HAVING count(DISTINCT status) > 1"
    ),
    "invalid_sources": _with(
        f"{SOURCES}, listed AS (SELECT CASE WHEN source_no = 3 THEN '' ELSE name END AS name, source_type FROM sources)",
        f"""SELECT name, source_type, CASE WHEN name = '' THEN 'blank name' ELSE 'unknown source type' END AS reason
        FROM listed WHERE name = '' OR NOT list_contains({listed(SOURCE_TYPES)}, source_type)""",
    ),
    "ranked_documents": _with(
        ALL_JUDGED, f"SELECT job_id, overall_score, date_posted, {PRIORITY} AS priority, company FROM judged ORDER BY {ORDER}"
    ),
    "top_k_with_rest": _with(
        f"{ALL_JUDGED}, shown AS (SELECT *, {PRIORITY} AS priority FROM judged WHERE NOT disqualified)",
        f"""(SELECT 'row' AS kind, line FROM (SELECT {CHAT_LINE} AS line FROM shown ORDER BY {ORDER} LIMIT 15))
        UNION ALL SELECT 'rest', '…and ' || (count(*) - 15) || ' more' FROM shown HAVING count(*) > 15""",
    ),
    "explore_by_score": _with(
        ALL_JUDGED,
        f"""SELECT job_id, company, title, overall_score, date_posted FROM judged WHERE NOT disqualified AND overall_score >= 40
        AND (contains(lower(title), 'the') OR contains(lower(company), 'the')) AND {FAMILY} = 'articles'
        ORDER BY overall_score DESC, date_posted DESC, job_id""",
    ),
    "explore_by_date": _with(
        ALL_JUDGED,
        """SELECT job_id, company, title, overall_score, date_posted FROM judged WHERE contains(lower(location), 'e')
        ORDER BY date_posted DESC, overall_score DESC, job_id""",
    ),
    "explore_page": _with(
        ALL_JUDGED,
        """SELECT job_id, company, title, overall_score, date_posted, count(*) OVER () AS matched FROM judged
        WHERE contains(lower(location), 'e') ORDER BY date_posted DESC, overall_score DESC, job_id LIMIT 400""",
    ),
    "explore_by_company": _with(
        ALL_JUDGED,
        """SELECT job_id, company, title, overall_score, date_posted FROM judged WHERE company = 'src4' AND NOT disqualified
        AND sponsorship_classification = 'likely_supported' AND date_posted >= '1998-01-01'
        ORDER BY lower(company), company, overall_score DESC, job_id""",
    ),
    "new_only": _with(MERGED, "SELECT job_id, company FROM merged WHERE lifecycle = 'new'"),
    "report_lines": _with(
        ALL_JUDGED, f"SELECT {BAND} AS band, {SORTED}, {ACTIVE_LINE} AS line FROM judged WHERE NOT disqualified AND {BAND} <> 'low'"
    ),
    "new_report_lines": _with(
        JUDGED_MERGE, f"SELECT {SORTED}, {ACTIVE_LINE} AS line FROM merged WHERE lifecycle = 'new' AND NOT disqualified"
    ),
    "digest_lines": _with(JUDGED_MERGE, f"SELECT {SORTED}, {DIGEST_LINE} AS line FROM merged WHERE {ELIGIBLE}"),
    "explorer_cards": _with(
        ALL_JUDGED,
        f"""SELECT job_id, date_posted >= '1998-01-01' AS is_new,
        {cased('sponsorship_classification', SPONSORSHIP_LABELS, 'sponsorship_classification')} AS sponsorship_label,
        CASE WHEN sponsorship_evidence <> '' THEN sponsorship_evidence
          ELSE 'No explicit sponsorship language found in the posting text.' END AS evidence_line FROM judged""",
    ),
}

# ------------------------------------------------------------ landed payloads
_EMPTY = {c: "''" for c in ("location", "country", "department", "employment_type", "description",
                            "requirements", "application_url", "date_posted")}
_TEXT = norm_ws("text")
_NEEDS = "lang || ' ' || n_chars"
_FEED_DAY = "strftime(make_timestamp((1700000000 + n_chars * 3600) * 1000000), '%Y-%m-%d')"


def feed(source: str = "documents", ctes: str = "", **columns: str) -> str:
    shown = {"source_job_id": "CAST(doc_id AS VARCHAR)", "title": SENTENCE, **_EMPTY, **columns}
    lines = ", ".join(f"{sql} AS {name}" for name, sql in shown.items())
    return f"{'WITH ' + ctes if ctes else ''} SELECT source AS company, {lines} FROM {source}"


def detailed(eligible: str = "TRUE") -> str:
    """Documents with `has_detail`: labelled and passing the title gate."""
    return f"""decided AS (SELECT doc_id, source, lang, {TITLE_HITS} FROM (SELECT *, {SENTENCE} AS title FROM documents)),
allowed AS (SELECT doc_id FROM decided WHERE len(matched) > 0 AND len(excluded) = 0 AND {eligible}),
feed AS (SELECT d.*, a.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AS has_detail FROM documents d
  LEFT JOIN allowed a ON a.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


_GREENHOUSE = dict(
    location="lang", department="'Engineering, ' || lang",
    date_posted="CASE WHEN lang = 'fr' THEN '2026-07-01' ELSE '2026-06-28' END",
)
_WORKDAY_PAGE = "'https://w.example.com/en-US/Careers/job/' || lang || '/R-' || doc_id"
_EIGHTFOLD_PAGE = "'https://e.example.com' || CASE WHEN lang = 'de' THEN '/p/' ELSE '/careers/job/' END || doc_id || '?domain=example.com'"
_PLAIN_PAGE = (
    r"regexp_replace({x}, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')"
)


def page_plain(x: str) -> str:
    out = _PLAIN_PAGE.format(x=x)
    # A cut title may end in an entity without its semicolon.
    for entity, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        out = f"regexp_replace({out}, {quoted(entity)}, {quoted(char)}, 'g')"
    return norm_ws(out)


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_NAV = r"""links AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS company,
    unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS cell,
    generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), 1) AS pos FROM pages),
cells AS (
  SELECT page_id, pos, url, company, replace(regexp_extract(cell, 'href="([^"]*)"', 1), '&amp;', '&') AS href,
    replace(regexp_extract(cell, '">([^<]*)</a>', 1), '&amp;', '&') AS raw FROM links),
found AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS application_url FROM cells)"""

# Three runs over thirds of the documents.
THREE_RUNS = f"""{_MERGE_BASE}, {', '.join(f'ok_sources_{n} AS (SELECT * FROM ok_sources)' for n in range(3))},
{', '.join(f'fetched_{n} AS (SELECT * FROM fetched WHERE (fetch_ord // 2) % 3 = {n})' for n in range(3))},
state_0 AS (SELECT * FROM state), {numbered(merge('fetched_0', 'location', 'location'), 0)}, {next_state(0, 'location')},
{numbered(merge('fetched_1', 'location', 'location'), 1)}, {next_state(1, 'location')},
{numbered(merge('fetched_2', 'location', 'location'), 2)}"""


def _board(source: str) -> str:
    order = dict(doc_id="doc_id", country="''", **_GREENHOUSE)
    return feed(source, description=_TEXT, application_url="'https://boards.example.com/' || doc_id", fetch_ord="doc_id * 2", **order) + (
        " UNION ALL BY NAME " + feed(
            source, source_job_id="doc_id || '-b'", title="'Second'", description="'no & tags'", fetch_ord="doc_id * 2 + 1",
            application_url="'https://boards.example.com/' || doc_id || '-b'", **order))


# Two whole runs: the second finds two thirds of the documents, and one source refuses.
_STAMP = FETCH_TS.replace(" ", "T") + "Z"
_KEPT = "location, overall_score, sponsorship_classification, disqualified"
_FEED_SOURCES = """sources AS (SELECT DISTINCT source AS name, CAST([] AS VARCHAR[]) AS locations FROM documents)"""
_ONE_RUN = f"""{_FEED_SOURCES}, pages_0 AS ({_board('documents')}), {gated('pages_0', 'gated_0')},
{judged('judged_0', 'gated_0').replace(RUN_TS[:10], FETCH_TS[:10])}, ok_sources_0 AS (SELECT name AS company FROM sources),
state_0 AS (SELECT 0 AS scope, '' AS job_id, '' AS company, '' AS title, '' AS location, '' AS application_url, '' AS first_seen,
  '' AS last_seen, '' AS status, 0 AS consecutive_missing, FALSE AS announced, 0 AS overall_score, '' AS sponsorship_classification,
  FALSE AS disqualified WHERE FALSE),
{numbered(merge('judged_0', _KEPT, _KEPT), 0)}"""
_TWO_RUNS = f"""{_ONE_RUN}, {next_state(0, _KEPT, f'announced OR ({ELIGIBLE})')},
pages_1 AS (SELECT * FROM pages_0 WHERE doc_id % 3 <> 0 AND company <> 'src4'), {gated('pages_1', 'gated_1')},
{judged('judged_1', 'gated_1').replace(RUN_TS[:10], SECOND_TS[:10])}, ok_sources_1 AS (SELECT name AS company FROM sources WHERE name <> 'src4'),
{numbered(merge('judged_1', _KEPT, _KEPT), 1).replace(_STAMP, SECOND_TS.replace(' ', 'T') + 'Z')}"""
_SAVED = "job_id, title, overall_score, sponsorship_classification, disqualified, first_seen, last_seen, status, consecutive_missing"


def _saved(n: int, announced: str) -> str:
    # Rows of the active and the archived output; what closed in this run is in the archive without its own word there.
    return f"""SELECT {_SAVED}, {announced} AS announced, CASE WHEN lifecycle <> 'closed' THEN lifecycle END AS lifecycle,
      CASE WHEN lifecycle <> 'closed' THEN matched_by END AS matched_by FROM merged_{n}"""


def _sources_of(n: str) -> str:
    return f"(SELECT * FROM documents WHERE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 6 {n})"


def _mixed() -> str:
    green, lever = _sources_of("IN (0, 4)"), _sources_of("IN (1, 5)")
    lever_columns = dict(
        location="lang", country="'US'", department="'Core'", employment_type="'Full-time'",
        description=f"CASE WHEN lang = 'de' THEN 'Plain text.' ELSE {_TEXT} END", requirements=f"{_NEEDS} || ' care'", date_posted=_FEED_DAY,
        application_url="CASE WHEN lang = 'en' THEN 'https://l.example.com/apply/' ELSE 'https://l.example.com/' END || doc_id",
    )
    number = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 6"
    cut, refused = f"({number} = 4 AND lang = 'de')", f"({number} = 5 AND lang = 'es')"
    parts = [
        f"SELECT * EXCLUDE (doc_id, fetch_ord) FROM ({_board(f'(SELECT * FROM {green} WHERE NOT {cut})')})",
        feed(f"(SELECT * FROM {lever} WHERE NOT {refused})", **lever_columns),
        feed(_sources_of("= 2"), source_job_id="'R-' || doc_id", location="lang || '; Denver'", department="'Ops'", description=_TEXT,
             application_url="'https://api.example.com/apply/R-' || doc_id", date_posted="'2026-07-01'"),
        feed(_sources_of("= 3"), location="lang", description=_TEXT, application_url="'https://own.example.com/' || doc_id"),
    ]
    rows = " UNION ALL BY NAME ".join(f"SELECT *, '' AS category FROM ({p})" for p in parts)
    blank = ", ".join(f"'' AS {c}" for c in ("title", *_EMPTY))
    problems = f"""SELECT source AS company, CAST(count(*) AS VARCHAR) AS source_job_id, {blank},
      CASE WHEN {cut} THEN 'parse_error' ELSE 'blocked' END AS category
      FROM documents WHERE {cut} OR {refused} GROUP BY source, category"""
    return f"{rows} UNION ALL BY NAME {problems}"


# Announcements within a bound: what is remembered after a part, and what that leaves of the next.
_WITHIN = "INTERVAL 2 DAY"
_BOUNDED = f"""log AS (SELECT 'src' || user_id AS company, CASE WHEN ts < TIMESTAMP '{PARTS[0]}' THEN 0 WHEN ts < TIMESTAMP '{PARTS[1]}' THEN 1 ELSE 2 END AS part,
  max(date_trunc('second', ts)) AS ts FROM events GROUP BY ALL),
due AS (SELECT company, part, CASE WHEN part = 2 AND company LIKE '%0' THEN TIMESTAMP '{PARTS[0]}' - INTERVAL 1 DAY ELSE ts END AS ts FROM log),
mark AS (SELECT max(ts) FILTER (WHERE part = 0) - {_WITHIN} AS one, max(ts) FILTER (WHERE part <= 1) - {_WITHIN} AS two FROM due),
out_0 AS (SELECT * FROM due WHERE part = 0),
held_1 AS (SELECT company, ts FROM out_0, mark WHERE ts + {_WITHIN} > one),
out_1 AS (SELECT due.* FROM due, mark WHERE part = 1 AND ts > one AND company NOT IN (SELECT company FROM held_1)),
held_2 AS (SELECT company FROM (SELECT company, ts FROM held_1 UNION ALL SELECT company, ts FROM out_1), mark WHERE ts + {_WITHIN} > two),
out_2 AS (SELECT due.* FROM due, mark WHERE part = 2 AND ts > two AND company NOT IN (SELECT company FROM held_2))"""

ORACLE.update(
    {
        "normalize_mixed": _mixed(),
        "full_run_state": _with(_ONE_RUN, _saved(0, f"announced OR ({ELIGIBLE})")),
        "second_run_state": _with(_TWO_RUNS, _saved(1, "announced")),
        "stream_lifecycle_runs": _with(THREE_RUNS, f"SELECT {STATE_COLUMNS} FROM merged_2"),
        "stream_health_shuffled": ORACLE["source_health_fold"],
        "stream_announce_bounded": _with(_BOUNDED, """SELECT company, strftime(ts, '%Y-%m-%d %H:%M:%S') AS announced_at
          FROM (SELECT * FROM out_0 UNION ALL SELECT * FROM out_1 UNION ALL SELECT * FROM out_2)"""),
        "normalize_greenhouse": feed(
            description=_TEXT, application_url="'https://boards.example.com/' || doc_id", **_GREENHOUSE
        ) + " UNION ALL BY NAME " + feed(
            source_job_id="doc_id || '-b'", title="'Second'", description="'no & tags'",
            application_url="'https://boards.example.com/' || doc_id || '-b'", **_GREENHOUSE,
        ),
        "normalize_lever": feed(
            location="lang", country="'US'", department="'Core'", employment_type="'Full-time'",
            description=f"CASE WHEN lang = 'de' THEN 'Plain text.' ELSE {_TEXT} END",
            requirements=f"{_NEEDS} || ' care'", date_posted=_FEED_DAY,
            application_url="CASE WHEN lang = 'en' THEN 'https://l.example.com/apply/' ELSE 'https://l.example.com/' END || doc_id",
        ),
        "normalize_ashby": feed(
            location="lang || '; New York, NY'", employment_type="'FullTime'", description=_TEXT,
            department="CASE WHEN lang = 'en' THEN 'Product' ELSE 'Growth' END",
            application_url="'https://a.example.com/' || doc_id", date_posted="'2026-07-05'",
        ),
        "normalize_workday": feed(
            "feed", detailed(),
            source_job_id="CASE WHEN lang = 'en' THEN 'JR' ELSE 'R-' END || doc_id",
            location="CASE WHEN has_detail AND lang = 'en' THEN 'Austin, TX' ELSE lang END",
            country="CASE WHEN has_detail THEN 'United States of America' ELSE '' END",
            employment_type="CASE WHEN has_detail THEN 'Full time' ELSE '' END",
            description=f"CASE WHEN has_detail THEN {_TEXT} ELSE '' END",
            application_url=f"CASE WHEN has_detail AND lang = 'de' THEN 'https://w.example.com/' || doc_id ELSE {_WORKDAY_PAGE} END",
            date_posted="CASE WHEN has_detail THEN '2024-01-31' ELSE '2024-01-29' END",
        ),
        "normalize_eightfold": feed(
            "feed", detailed(),
            source_job_id="CASE WHEN lang = 'en' THEN 'D' ELSE '' END || doc_id",
            location="CASE WHEN has_detail AND lang = 'en' THEN 'Redmond' WHEN lang = 'fr' THEN 'Paris' ELSE lang || '; Remote' END",
            department="'Software'", employment_type="CASE WHEN has_detail THEN 'Full-Time' ELSE '' END",
            description=f"CASE WHEN has_detail THEN {_TEXT} ELSE '' END",
            application_url=f"CASE WHEN has_detail AND lang = 'en' THEN 'https://e.example.com/' || doc_id ELSE {_EIGHTFOLD_PAGE} END",
            date_posted=f"CASE WHEN lang = 'es' THEN '2023-11-14' ELSE {_FEED_DAY} END",
        ),
        "normalize_amazon": feed(
            source_job_id="CASE WHEN lang = 'en' THEN 'I' ELSE '' END || doc_id", location="lang", country="'United States'",
            department="'Software'", employment_type="'full-time'", description=f"trim({_TEXT} || ' ' || {_NEEDS})",
            requirements=_NEEDS, application_url="'https://www.amazon.jobs/en/jobs/' || doc_id", date_posted="'2026-07-05'",
        ),
        "normalize_google": feed(
            location="lang || '; Boston'", country="'United States'",
            description=f"trim({_TEXT} || ' short ' || {_NEEDS})", requirements=_NEEDS,
            application_url="'https://careers.google.com/jobs/results/' || doc_id || '/'", date_posted="'2026-06-30'",
        ),
        "normalize_uber": feed(
            location="CASE WHEN lang = 'en' THEN 'Seattle, WA; Reno' ELSE lang || ', CA' END", country="'United States'",
            department="'Eng'", description=_TEXT,
            application_url="'https://www.uber.com/global/en/careers/list/' || doc_id || '/'", date_posted="'2026-06-29'",
        ),
        "normalize_janestreet": feed(
            title=f"CASE WHEN lang = 'en' AND {SENTENCE} <> '' THEN {SENTENCE} ELSE 'T ' || {SENTENCE} END",
            location="'New York'", country="'United States'", department="'Tech'", employment_type="'Full-Time'",
            description=_TEXT, application_url="'https://www.janestreet.com/join-jane-street/position/' || doc_id || '/'",
        ),
        "normalize_smartrecruiters": feed(
            "feed", detailed("lang <> 'fr'"),
            location="lang || ', TX'", country="'United States'", department="'IT'", employment_type="'Permanent'",
            description=f"CASE WHEN has_detail THEN trim('About us ' || {_TEXT} || ' ' || {_NEEDS}) ELSE '' END",
            requirements=f"CASE WHEN has_detail THEN {_NEEDS} ELSE '' END",
            application_url="'https://jobs.smartrecruiters.com/acme/' || doc_id", date_posted="'2026-07-02'",
        ),
        "normalize_oracle": feed(
            location="lang", description=_TEXT,
            application_url="'https://careers.oracle.com/jobs/#en/sites/jobsearch/job/' || doc_id", date_posted="'2026-07-03'",
        ),
        "normalize_salesforce": feed(
            source_job_id="CASE WHEN lang = 'en' THEN '' ELSE 'J' END || doc_id", location="lang || '; Remote'",
            department="'Sales'", description=_TEXT, date_posted="'2026-07-04'",
            application_url="CASE WHEN lang = 'de' THEN 'https://s.example.com/' || doc_id ELSE 'https://' || source || '.example.com/jobs' END",
        ),
        "normalize_generic": feed(
            source_job_id="'R-' || doc_id", location="lang || '; Denver'", department="'Ops'", description=_TEXT,
            application_url="'https://api.example.com/apply/R-' || doc_id", date_posted="'2026-07-01'",
        ),
        "landed_problems": """SELECT source AS company,
          CASE WHEN lang = 'es' THEN 'blocked' WHEN source = 'src9' THEN 'unsupported'
            WHEN lang = 'de' THEN 'parse_error' ELSE 'structure_changed' END AS category, count(*) AS n
          FROM documents WHERE lang <> 'en' OR source = 'src9' GROUP BY ALL""",
        "page_text": f"SELECT page_id, {page_plain('html')} AS text FROM pages",
        "page_articles": f"SELECT page_id, {page_plain(_ARTICLE)} AS text FROM pages",
        "page_rows": _with(
            _NAV,
            f"""SELECT company, {norm_ws('raw')} AS title, application_url FROM (
              SELECT *, row_number() OVER (PARTITION BY company, application_url ORDER BY page_id, pos) AS nth FROM found)
            WHERE nth = 1""",
        ),
        "page_detail_rows": feed(
            "feed", detailed(), source_job_id="''", title=norm_ws(SENTENCE),
            description=f"CASE WHEN has_detail THEN {_TEXT} ELSE '' END",
            application_url="'https://feeds.example.com/p/' || doc_id",
        ),
        "page_jsonld": feed(
            source_job_id="'REQ-' || doc_id", location="'Boston, MA'", country="lang", employment_type="'FULL_TIME'",
            description=_TEXT, date_posted="'2026-07-06'",
            application_url="CASE WHEN lang = 'fr' THEN 'https://feeds.example.com/' ELSE 'https://j.example.com/' END || doc_id",
        ),
        "rendered_rows": _with(
            _NAV,
            f"""SELECT company, {norm_ws('raw')} AS title, application_url FROM found
            WHERE company NOT IN (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) FROM pages WHERE contains(url, 'casino'))""",
        ),
        "stream_lifecycle": ORACLE["lifecycle_merge"],
        "saved_records": ORACLE["active_rows"],
        "saved_csv": ORACLE["active_rows"],
        "saved_health": ORACLE["source_health_step"],
        "run_outputs": ORACLE["mark_announced"],
        "stream_health": ORACLE["source_health_fold"],
        "stream_announce_once": "SELECT DISTINCT 'src' || user_id AS company FROM events",
        "stream_date_floor": ORACLE["date_floor"],
    }
)
