"""SQL that computes each query's result from the raw tables, written for the checking engine.

It is a second statement of the rules, not a rendering of the Spark plans: rows fold one by one
with list functions, tokens are tested one by one, batches are windows. Named parts are CTEs, and
each query brings in only those it mentions.
"""

import re

from .. import vocab
from ..operators.replies import MIN_DESCRIPTION, REQUEST_POSTING
from ..schema import COMPONENTS, SCORING_COLUMNS
from ..sources import adapter
from ..functions.html import BOARD

EDGE = r"[^\p{L}\p{N}_]"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "CAST([" + ", ".join(lit(v) for v in value) + "] AS VARCHAR[])"
    if isinstance(value, float):
        return f"CAST({value} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


SPACES = ("(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))")


def trim(c):
    return f"trim({c}, {SPACES})"


def has_any(c, parts):
    return "(" + " OR ".join(f"contains({c}, {lit(p)})" for p in parts) + ")"


def token(c, term):
    return f"regexp_matches({c}, {lit(f'(^|{EDGE}){re.escape(term.lower())}({EDGE}|$)')})"


def found(tests):
    """List of the labels whose test holds."""
    items = ", ".join(f"CASE WHEN {test} THEN {lit(label)} END" for label, test in tests)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def ladder(c, rungs):
    return " ".join(f"WHEN {has_any(c, parts)} THEN {lit(name)}" for name, parts in rungs)


def joined(c):
    return f"array_to_string({c}, '|')"


def company_norm(c):
    words = "|".join(vocab.COMPANY_NOISE)
    return (f"regexp_replace(regexp_replace(lower({c}), {lit(rf'\b({words})\b')}, '', 'g'), "
            "'[^a-z0-9]', '', 'g')")


def title_norm(c):
    out = f"lower({c})"
    for p in (r"\(.*?\)", r"\[.*?\]", rf"\b({vocab.TITLE_NOISE})\b", "[^a-z0-9]"):
        out = f"regexp_replace({out}, {lit(p)}, '', 'g')"
    return out


def key(company, title):
    c, t = company_norm(company), title_norm(title)
    return f"CASE WHEN {c} = '' OR {t} = '' THEN '' ELSE {c} || ':' || {t} END"


def city(loc):
    parts = f"list_filter(list_transform(string_split({loc}, ','), lambda s: {trim('s')}), lambda s: s <> '')"
    return f"coalesce({parts}[1], {loc})"


def merge(a, b):
    return (f"CASE WHEN {a} IS NULL OR {a} = '' THEN coalesce({b}, '') "
            f"WHEN {b} IS NULL OR {b} = '' THEN {a} "
            f"WHEN lower({trim(a)}) = lower({trim(b)}) THEN {a} "
            f"WHEN lower({city(a)}) = lower({city(b)}) THEN {a} "
            f"WHEN contains(lower({a}), lower({city(b)})) THEN {a} "
            f"ELSE {a} || ' / ' || {city(b)} END")


def fold(locations):
    """Left fold of a non-empty list of locations."""
    return f"list_reduce({locations}, lambda a, b: {merge('a', 'b')})"


def longest_match(a, b):
    """(k letters, -i) of the longest text that stands in both, the first of a."""
    return (f"list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform("
            f"range(1, length({a}) - i + 2), lambda k: CASE WHEN contains({b}, substr({a}, i, k)) "
            "THEN struct_pack(k := k, i := -i) END))))")


def matching_letters(by, pairs):
    """n per `by`: letters of the longest common text, and of what is left and right of it, and so on."""
    prefixed = ", ".join(f"r.{c}" for c in by.split(", "))
    return f"""WITH RECURSIVE parts AS (
        SELECT {by}, a, b, {longest_match('a', 'b')} AS m FROM {pairs}
        UNION ALL
        SELECT {prefixed}, r.x.a, r.x.b, {longest_match('r.x.a', 'r.x.b')} FROM (
          SELECT {by}, unnest([
            struct_pack(a := substr(a, 1, -m.i - 1), b := substr(b, 1, instr(b, substr(a, -m.i, m.k)) - 1)),
            struct_pack(a := substr(a, -m.i + m.k), b := substr(b, instr(b, substr(a, -m.i, m.k)) + m.k))]) AS x
          FROM parts WHERE m IS NOT NULL) r
        WHERE r.x.a <> '' AND r.x.b <> '')
      SELECT {by}, coalesce(sum(m.k), 0) AS n FROM parts GROUP BY {by}"""


def letter_counts(c):
    return (f"list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''), "
            f"lambda x: length({c}) - length(replace({c}, x, '')))")


def rank(status):
    arms = " ".join(f"WHEN {lit(s)} THEN {r}" for s, r in vocab.STATUS_RANK.items())
    return f"CASE {status} {arms} ELSE 1 END"


def years(text):
    """{lo, hi, shown} columns by the first pattern in range."""
    lo_arms, hi_arms, text_arms = [], [], []
    for pattern, ranged, low in vocab.REQUIRED_YEARS:
        lo = f"TRY_CAST(regexp_extract({text}, {lit(pattern)}, 1) AS DOUBLE)"
        hi = (f"TRY_CAST(nullif(regexp_extract({text}, {lit(pattern)}, 2), '') AS DOUBLE)"
              if ranged else "CAST(NULL AS DOUBLE)")
        test = f"WHEN {lo} BETWEEN {low} AND {vocab.REQUIRED_YEARS_MAX} THEN"
        lo_arms.append(f"{test} {lo}")
        hi_arms.append(f"{test} {hi}")
        shown = (f"CAST({lo} AS VARCHAR) || CASE WHEN {hi} <> 0 THEN '-' || CAST({hi} AS VARCHAR) "
                 "ELSE '+' END || ' years'")
        text_arms.append(f"{test} {shown}")
    return (f"CASE {' '.join(lo_arms)} END AS lo, CASE {' '.join(hi_arms)} END AS hi, "
            f"CASE {' '.join(text_arms)} END AS shown")


def spaced(c):
    return rf"regexp_replace({c}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')"


def occurrences(c, terms):
    return " + ".join(f"(length({c}) - length(replace({c}, {lit(t)}, ''))) // {len(t)}"
                      for t in terms)


def number(c):
    return (f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({c} AS VARCHAR) END")


def flag(test):
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


def pattern_of(names, tags="span|div|h1|h3|h4|li"):
    return (rf'(?s)<({tags})[^>]*\bclass="(?:[^"]*\s)?(?:' + "|".join(names)
            + rf')(?:\s[^"]*)?"[^>]*>(.*?)</(?:{tags})>')


def unescape(c):
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        c = f"replace({c}, '&{name};', {lit(char)})"
    return c


def element(html, names, *tags):
    return f"nullif(regexp_extract({html}, {lit(pattern_of(names, *tags))}, 2), '')"


def field(html, names):
    inner = element(html, names)
    pieces = rf"string_split_regex({inner}, '<[^>]*>')"
    return f"list_aggregate(list_transform({pieces}, lambda s: {trim(unescape('s'))}), 'string_agg', '')"


def adapted(sql):
    tables = {n: n for n in adapter.TABLES}
    return adapter.dialect(sql, "duckdb").format(
        **tables, postings="SELECT * FROM postings", cards="SELECT * FROM cards_view")


PROFILE = vocab.DEFAULT_PROFILE
CORE = vocab.CORE_STACK

# What is counted as experience, per posting and profile: shared by one and many candidates.
SENIOR = "seniority IN (" + ", ".join(lit(s) for s in vocab.SENIOR_GROUP) + ")"


def gap_case(arms, otherwise):
    return (f"CASE WHEN lo - years >= 4 THEN {arms[0]} WHEN lo - years >= 2 THEN {arms[1]} "
            f"WHEN lo - years >= 1 THEN {arms[2]} ELSE {otherwise} END")


ASKED = (f"({number('lo')} || CASE WHEN hi <> 0 THEN '-' || {number('hi')} ELSE '+' END "
         "|| ' years')")
HAVE = f"(' (Candidate has ' || {number('years')} || ' yr')"
TAIL = f"(' experience' || {HAVE} || ', deficit: -' || {number('(lo - years)')} || ' yrs)')"
MATCHES = ("len(list_filter(owned, lambda r: r = lower(j) OR ((contains(r, lower(j)) OR "
           "contains(lower(j), r)) AND length(r) > 2 AND length(j) > 2))) > 0")


def scoring(source, profile):
    """Score columns of `source` x `profile` (columns candidate_id, years, place, skill_list,
    cloud_list, n_edu, n_cert), one stage of columns after another."""
    owned = f"list_distinct(list_transform(skill_list, lambda s: lower({trim('s')})))"
    concern = gap_case([f"'❌ CRITICAL BLOCKER: JD requires ' || {ASKED} || {TAIL}",
                        f"'⚠ HARD REQ MISMATCH: JD requires ' || {ASKED} || {TAIL}",
                        f"'⚠ Experience Deficit: JD asks for ' || {ASKED} || {HAVE} || ')'"],
                       f"'ℹ Minor experience gap: JD asks for ' || {ASKED}")
    gates = " ".join(
        f"WHEN contains(lower(title), '{c}') AND len(list_filter(cloud_list, lambda x: "
        f"contains(lower(x), '{c}'))) = 0 THEN '{c.upper()}'" for c in ("azure", "aws", "gcp"))
    return f"""
SELECT *,
  greatest(0, least(100, round_even(raw_ats - penalty, 1))) AS ats_score,
  CASE WHEN len(list_filter(concerns, lambda c: {has_any('c', ['CRITICAL', 'SENIORITY MISMATCH', 'HARD REQ MISMATCH'])})) > 0
    THEN 1 ELSE 0 END AS blocked
FROM (SELECT *,
  round_even(c_skills + c_experience + c_responsibilities + c_cloud_platform + c_education
    + c_certifications + c_ats_keywords + c_location, 1) AS raw_ats,
  exp_penalty + gate_penalty + edu_penalty AS penalty,
  list_concat(list_concat(exp_concerns, gate_concerns), edu_concerns) AS concerns,
  greatest(0, least(100, round_even(fit_seniority + fit_domain + fit_stack + fit_mode, 1))) AS fit_score
FROM (SELECT *,
  CASE WHEN len(skills) = 0 THEN 28.0 ELSE round_even(len(hits) / len(skills) * 35.0, 1) END AS c_skills,
  CASE WHEN lo IS NULL THEN CASE WHEN {SENIOR} THEN 4.0 WHEN seniority = 'SENIOR' THEN 8.0 ELSE 18.0 END
    WHEN years >= lo THEN 20.0 ELSE {gap_case(['0.0', '4.0', '10.0'], '15.0')} END AS c_experience,
  CASE WHEN {SENIOR} AND years < 3 THEN 25.0 ELSE 0.0 END + CASE WHEN years < lo
    THEN {gap_case(['35.0', '20.0', '10.0'], '4.0')} ELSE 0.0 END AS exp_penalty,
  list_filter([CASE WHEN {SENIOR} AND years < 3 THEN '❌ SENIORITY MISMATCH: Role is '
      || substr(seniority, 1, 1) || lower(substr(seniority, 2)) || ' level (Candidate has '
      || CAST(years AS VARCHAR) || ' yr experience)' END,
    CASE WHEN years < lo THEN {concern} END], lambda x: x IS NOT NULL) AS exp_concerns,
  CASE domain WHEN 'cloud_devops' THEN 14.0 WHEN 'data_ai' THEN 8.0 ELSE 4.0 END AS c_responsibilities,
  CASE WHEN len(clouds) = 0 THEN CASE WHEN len(cloud_list) > 0 THEN 7.0 ELSE 4.0 END
    ELSE round_even(len(list_filter(clouds, lambda c: list_contains(list_transform(cloud_list, lambda x: lower(x)), lower(c))))
      / len(clouds) * 10.0, 1) END AS c_cloud_platform,
  CASE WHEN n_edu > 0 THEN 5.0 ELSE 3.0 END AS c_education,
  CASE WHEN n_cert > 0 THEN 5.0 ELSE 2.0 END AS c_certifications,
  least(5.0, round_even(len(matched) * 0.8, 1)) AS c_ats_keywords,
  CASE WHEN place = '' OR location = '' OR contains(lower(location), lower(place))
    OR contains(lower(location), 'india') OR contains(lower(location), 'remote') THEN 5.0 ELSE 2.0 END AS c_location,
  CASE WHEN gate IS NULL THEN 0.0 ELSE 20.0 END AS gate_penalty,
  list_filter(['❌ Primary Platform Missing: Title requires ' || gate || ' (Not in candidate cloud stack)'],
    lambda x: x IS NOT NULL) AS gate_concerns,
  CASE WHEN degree AND n_edu = 0 THEN 5.0 ELSE 0.0 END AS edu_penalty,
  list_filter([CASE WHEN degree AND n_edu = 0 THEN '⚠ Job specifies a degree requirement' END],
    lambda x: x IS NOT NULL) AS edu_concerns,
  CASE WHEN {SENIOR} THEN CASE WHEN years < 3 THEN 0.0 ELSE 25.0 END
    WHEN seniority = 'SENIOR' THEN CASE WHEN years < 3 THEN 8.0 ELSE 30.0 END
    WHEN seniority IN ('ENTRY', 'ASSOCIATE') THEN 35.0 WHEN lo >= 5 AND years < 2 THEN 5.0
    WHEN lo >= 3 AND years < 2 THEN 15.0 ELSE 30.0 END AS fit_seniority,
  CASE domain WHEN 'cloud_devops' THEN 35.0 WHEN 'data_ai' THEN 15.0 ELSE 5.0 END AS fit_domain,
  least(20.0, round_even(len(list_filter(matched, lambda s: list_contains({lit(CORE)}, lower(s)))) * 3.5, 1)) AS fit_stack,
  CASE WHEN contains(lower(coalesce(work_mode, '')), 'remote') THEN 10.0
    WHEN contains(lower(coalesce(work_mode, '')), 'hybrid') THEN 8.0 ELSE 6.0 END AS fit_mode
FROM (SELECT *,
  CASE WHEN len(skills) = 0 THEN skill_list[1:6] ELSE hits END AS matched,
  CASE {gates} END AS gate
FROM (SELECT a.*, p.* EXCLUDE (owned),
  list_filter(a.skills, lambda j: {MATCHES}) AS hits,
  list_filter(a.skills, lambda j: NOT ({MATCHES})) AS missing
FROM {source} a CROSS JOIN (SELECT *, {owned} AS owned FROM {profile}) p))))"""


PRIORITY = """CASE WHEN blocked = 1 OR ats_score < 60 OR fit_score < 50 THEN 'LOW'
  WHEN ats_score >= 78 AND fit_score >= 75 AND len(exp_concerns) = 0 THEN 'HIGH'
  WHEN ats_score >= 65 OR fit_score >= 60 THEN 'MEDIUM' ELSE 'LOW' END"""

REPOST = """CASE WHEN is_reposted IS NOT NULL THEN CAST(is_reposted <> 0 AS INT)
  WHEN contains(lower(coalesce(posted_at, '')), 'repost')
    OR contains(lower(substr(coalesce(description, ''), 1, 300)), 'reposted') THEN 1 ELSE 0 END"""


def csv(c):
    return (f"list_filter(list_transform(string_split(coalesce({c}, ''), ','), "
            f"lambda s: {trim('s')}), lambda s: s <> '')")


def last(column):
    """Last non-empty value of a group in batch order."""
    return f"last({column} ORDER BY seq) FILTER (WHERE {column} IS NOT NULL AND {column} <> '')"


TEXTS = ["title", "company", "url", "posted_at", "employment_type", "experience_level",
         "work_mode", "salary", "dedup_key"]

CTES = {
    "postings": adapted(adapter.POSTINGS),
    "incoming": adapted(adapter.INCOMING),
    "candidate_forms": adapted(adapter.CANDIDATES),
    "resumes": adapted(adapter.RESUMES),
    "status_events": adapted(adapter.STATUS_EVENTS),
    "fit_replies": adapted(adapter.FIT_REPLIES),
    "profile_replies": adapted(adapter.PROFILE_REPLIES),
    "json_postings": adapted(adapter.JSON_POSTINGS),
    "profile_saves": adapted(adapter.PROFILE_SAVES),
    "detail_pages": adapted(adapter.DETAIL_PAGES),
    "cards_view": adapted(adapter.CARDS),
    "card_html": adapted(adapter.CARD_HTML),
    "lowered": "SELECT *, lower(title || chr(10) || chr(10) || description) AS low, "
               + spaced("title || chr(10) || chr(10) || description") + " AS flat FROM postings",
    "active": f"""SELECT 0 AS candidate_id, {lit(PROFILE['years_experience'])} AS years,
      {lit(PROFILE['location'])} AS place, {lit(PROFILE['skills'])} AS skill_list,
      {lit(PROFILE['cloud_platforms'])} AS cloud_list, 1 AS n_edu, 1 AS n_cert""",
    "people": f"""SELECT candidate_id, years_experience AS years, location AS place,
      {csv('skills_csv')} AS skill_list, {csv('clouds_csv')} AS cloud_list,
      len({csv('education_csv')}) AS n_edu, len({csv('certifications_csv')}) AS n_cert
      FROM candidate_forms""",
    "profiles": """SELECT DISTINCT years, place, skill_list, cloud_list, CAST(n_edu > 0 AS INT) AS n_edu,
      CAST(n_cert > 0 AS INT) AS n_cert FROM people""",
    "seniorities": f"""SELECT id, CASE {ladder('lower(title)', vocab.SENIORITY_TITLE)}
      {ladder("lower(coalesce(experience_level, ''))", vocab.SENIORITY_LEVEL)}
      ELSE {lit(vocab.SENIORITY_DEFAULT)} END AS seniority FROM postings""",
    "year_rows": f"SELECT id, {years('flat')} FROM lowered",
    "analysed": f"""SELECT l.*, s.seniority, y.lo AS stated_lo, y.hi AS hi, y.shown,
      coalesce(y.lo, i.guess) AS lo, i.guess,
      {found([(t, token('low', t)) for t in vocab.SKILL_TERMS])} AS skills,
      {found([(c, has_any('low', a)) for c, a in vocab.CLOUD_ALIASES.items()])} AS clouds,
      CASE {ladder('lower(title)', vocab.DOMAIN_TITLE)}
        WHEN {occurrences('low', vocab.CLOUD_DOMAIN_TERMS)} >= {occurrences('low', vocab.SOFTWARE_DOMAIN_TERMS)}
        THEN 'cloud_devops' ELSE 'software_engineering' END AS domain,
      {has_any('low', vocab.DEGREE_HINTS)} AS degree
      FROM lowered l JOIN seniorities s USING (id) JOIN year_rows y USING (id)
      JOIN (SELECT id, CASE seniority {' '.join(f"WHEN '{k}' THEN {lit(v)}" for k, v in vocab.YEARS_BY_SENIORITY.items())} END AS guess
        FROM seniorities) i USING (id)""",
    "scored_parts": scoring("analysed", "active"),
    "scored": f"SELECT *, {PRIORITY} AS priority, lo AS required_experience FROM scored_parts",
    "many_parts": scoring("analysed", "profiles"),
    "many": f"SELECT *, {PRIORITY} AS priority FROM many_parts",
    "keyed": f"SELECT *, {key('company', 'title')} AS dedup_key FROM postings",
    "groups": f"""SELECT dedup_key, min(id) AS leader_id, count(*) AS copies,
      {fold("list(location ORDER BY id)")} AS merged_location,
      max(CAST(coalesce(is_reposted, 0) <> 0 AS INT)) AS reposted,
      first(coalesce(nullif(status, ''), 'new') ORDER BY {rank("coalesce(nullif(status, ''), 'new')")} DESC, id) AS merged_status,
      first(coalesce(description, '') ORDER BY length(coalesce(description, '')) DESC, id) AS merged_text
      FROM keyed WHERE dedup_key <> '' GROUP BY dedup_key""",
    "stored": """SELECT k.* REPLACE (
        CASE WHEN g.copies > 1 THEN g.merged_location ELSE k.location END AS location,
        CASE WHEN g.copies > 1 THEN g.reposted ELSE k.is_reposted END AS is_reposted,
        CASE WHEN g.copies > 1 THEN g.merged_status ELSE k.status END AS status,
        CASE WHEN g.copies > 1 THEN g.merged_text ELSE k.description END AS description)
      FROM keyed k LEFT JOIN groups g ON k.id = g.leader_id
      WHERE g.leader_id IS NOT NULL OR k.dedup_key = ''""",
    "batch": f"""SELECT * EXCLUDE (is_reposted), {REPOST} AS is_reposted,
      {key(f"coalesce(company, {lit(vocab.UNKNOWN_COMPANY)})", f"coalesce(title, {lit(vocab.UNKNOWN_TITLE)})")} AS dedup_key
      FROM incoming""",
    "resolved": """SELECT *, CAST(target_id IS NULL AND seq = min(seq) OVER (PARTITION BY target_id IS NULL, g) AS INT)
      AS is_new FROM matched""",
    "matched": """SELECT b.*, CASE WHEN b.dedup_key <> '' THEN 'k:' || b.dedup_key ELSE 'p:' || b.posting_id END AS g, s.id AS by_id, CASE WHEN s.id IS NULL THEN k.id END AS by_key,
      coalesce(s.id, k.id) AS target_id
      FROM batch b LEFT JOIN stored s ON b.posting_id = s.posting_id
      LEFT JOIN (SELECT dedup_key, min(id) AS id FROM stored WHERE dedup_key <> '' GROUP BY dedup_key) k
        ON b.dedup_key = k.dedup_key""",
    "updates": f"""SELECT target_id, list(location ORDER BY seq) AS locations,
      {', '.join(f'{last(c)} AS new_{c}' for c in TEXTS)},
      first(description ORDER BY length(description) DESC, seq) AS new_description,
      max(is_reposted) AS new_reposted FROM resolved WHERE target_id IS NOT NULL GROUP BY target_id""",
    "fresh_groups": f"""SELECT g, min(seq) AS first_seq, {fold("list(location ORDER BY seq)")} AS location,
      {', '.join(f"coalesce({last(c)}, first(coalesce({c}, '') ORDER BY seq)) AS {c}" for c in TEXTS)},
      first(description ORDER BY length(description) DESC, seq) AS description,
      max(is_reposted) AS is_reposted, first(posting_id ORDER BY seq) AS posting_id
      FROM resolved WHERE target_id IS NULL GROUP BY g""",
    "inserts": """SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY first_seq) AS id,
      * EXCLUDE (g, first_seq), 'new' AS status FROM fresh_groups""",
    "merged": f"""SELECT s.id, s.posting_id,
      {', '.join(f'coalesce(u.new_{c}, s.{c}) AS {c}' for c in TEXTS)},
      CASE WHEN u.target_id IS NULL THEN s.location
        ELSE {fold("list_prepend(s.location, u.locations)")} END AS location,
      CASE WHEN length(u.new_description) > length(coalesce(s.description, '')) THEN u.new_description
        ELSE s.description END AS description,
      CASE WHEN u.target_id IS NULL THEN s.is_reposted
        ELSE greatest(CAST(coalesce(s.is_reposted, 0) <> 0 AS INT), u.new_reposted) END AS is_reposted,
      s.status FROM stored s LEFT JOIN updates u ON s.id = u.target_id""",
    "cards": f"""SELECT search_id, page, doc_id - page * 25 AS pos,
      coalesce(nullif(regexp_extract(card, 'data-entity-urn="[^"]*jobPosting:(\\d+)', 1), ''),
        nullif(regexp_extract(card, '/view/(\\d+)', 1), '')) AS posting_id,
      coalesce({field('card', BOARD.card_title)}, {lit(vocab.UNKNOWN_TITLE)}) AS title,
      coalesce({field('card', BOARD.card_company)}, {lit(vocab.UNKNOWN_COMPANY)}) AS company,
      coalesce({field('card', BOARD.card_location)}, 'India') AS location,
      coalesce(nullif(regexp_extract(card, 'href="([^"?]*/view/[^"?]*)', 1), ''),
        {lit(BOARD.site)} || '/jobs/view/' || coalesce(
          nullif(regexp_extract(card, 'jobPosting:(\\d+)', 1), ''), '') || '/') AS url,
      regexp_extract(card, '<time[^>]*>([^<]*)</time>', 1) AS posted_at,
      {flag(f"regexp_matches(regexp_replace(card, '<[^>]*>', '', 'g'), '(?i)(^|{EDGE})repost(ed)?({EDGE}|$)') OR contains(lower(regexp_extract(card, '<time[^>]*>([^<]*)</time>', 1)), 'reposted')")} AS is_reposted
      FROM card_html""",
    "kept_cards": "SELECT * FROM cards WHERE posting_id IS NOT NULL",
    "seen": """SELECT * FROM kept_cards QUALIFY row_number() OVER (
      PARTITION BY search_id, posting_id ORDER BY page, pos) = 1""",
    "yields": """SELECT c.search_id, c.page, count(s.posting_id) AS new_cards FROM
      (SELECT DISTINCT search_id, page FROM card_html) c LEFT JOIN seen s
      ON c.search_id = s.search_id AND c.page = s.page GROUP BY c.search_id, c.page""",
    "page_flags": """SELECT y.*, coalesce(y.page < z.stop, true) AS kept FROM yields y LEFT JOIN
      (SELECT search_id, min(page) AS stop FROM yields WHERE new_cards = 0 GROUP BY search_id) z
      ON y.search_id = z.search_id""",
    "detail_text": f"""SELECT *, {field('html', BOARD.location)} AS page_place,
      array_to_string(list_filter(list_transform(string_split_regex({unescape(
        "regexp_replace(regexp_replace(" + element('html', BOARD.description, 'div')
        + ", '(<br[^>]*>|</p>|</li>)', '\\1' || chr(10), 'g'), '<[^>]*>', '', 'g')")},
        '[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
        lambda s: {trim('s')}), lambda s: s <> ''), chr(10) || chr(10)) AS description
      FROM detail_pages""",
    "details": f"""SELECT page_id, html,
      CASE WHEN card_title IN ('', {lit(vocab.UNKNOWN_TITLE)}) THEN {field('html', BOARD.title)} ELSE card_title END AS title,
      CASE WHEN card_company IN ('', {lit(vocab.UNKNOWN_COMPANY)}) THEN {field('html', BOARD.company)} ELSE card_company END AS company,
      CASE WHEN page_place <> '' AND NOT contains(lower(page_place), 'applicant') THEN page_place ELSE card_location END AS location,
      coalesce(description, '') AS description,
      trim(regexp_extract(html, 'Seniority level </h3><span class="description__job-criteria-text">([^<]*)<', 1)) AS experience_level,
      trim(regexp_extract(html, 'Employment type</h3><span class="description__job-criteria-text">([^<]*)<', 1)) AS employment_type,
      {flag(f"regexp_matches({element('html', BOARD.location)}, '(?i)(^|{EDGE})repost(ed)?({EDGE}|$)') OR regexp_matches(substr(html, 1, 4000), '(?i)(^|{EDGE})repost(ed)?({EDGE}|$)')")} AS is_reposted,
      coalesce({field('html', BOARD.salary)}, {trim(f"regexp_extract(description, {lit(vocab.SALARY)}, 0)")}, '') AS salary
      FROM detail_text""",
    "cv": f"SELECT *, lower(resume_text) AS low FROM resumes WHERE {trim('resume_text')} <> ''",
    "cv_all": "SELECT *, lower(resume_text) AS low FROM resumes",
    "answers": """SELECT id, CASE WHEN json_valid(body) AND body LIKE '{%' THEN body END AS body FROM (
      SELECT id, trim(regexp_replace(regexp_replace(trim(reply, ' ' || chr(10)), '^```[^\\n]*\\n', ''), '\\n```$', '')) AS body
      FROM fit_replies)""",
    "answer_parts": """SELECT id, array_to_string(CAST(json_extract(body, '$.key_strengths') AS VARCHAR[]), '|') AS strengths,
      array_to_string(CAST(json_extract(body, '$.critical_gaps') AS VARCHAR[]), '|') AS gaps,
      json_extract_string(body, '$.interview_tips') AS tips FROM answers""",
}

# Similar titles and what goes row by row. Letters that match are summed over the longest common text, then what
# is left of it and right of it; only pairs that share enough letters are looked at.
CTES |= {
    "all_keys": """SELECT DISTINCT dedup_key AS k FROM keyed WHERE dedup_key <> ''
      UNION SELECT DISTINCT dedup_key FROM batch WHERE dedup_key <> ''""",
    "key_parts": f"""SELECT k, split_part(k, ':', 1) AS company, split_part(k, ':', 2) AS title,
      {letter_counts("split_part(k, ':', 2)")} AS letters FROM all_keys""",
    "title_pairs": """SELECT h.k AS held, p.k AS probe, h.title AS a, p.title AS b
      FROM key_parts h JOIN key_parts p ON h.company = p.company AND h.k <> p.k
      WHERE 2 * least(length(h.title), length(p.title)) >= 0.87 * (length(h.title) + length(p.title))
        AND 2 * list_sum(list_transform(list_zip(h.letters, p.letters), lambda z: least(z[1], z[2])))
          >= 0.87 * (length(h.title) + length(p.title))""",
    "title_matches": matching_letters("held, probe", "title_pairs"),
    "same_postings": f"""SELECT p.id, {title_norm('p.title')} AS a, {title_norm('i.title')} AS b
      FROM postings p JOIN incoming i USING (posting_id)""",
    "same_matches": matching_letters("id", "same_postings"),
    "similar_keys": f"""SELECT probe AS k, list(held) AS near FROM title_matches
      JOIN title_pairs USING (held, probe)
      WHERE 2.0 * n / (length(a) + length(b)) >= {vocab.TITLE_SIMILARITY} GROUP BY probe""",
    "key_order": """SELECT g.dedup_key AS k, split_part(g.dedup_key, ':', 1) AS company, coalesce(n.near, []) AS near,
      row_number() OVER (PARTITION BY split_part(g.dedup_key, ':', 1) ORDER BY g.leader_id) AS step
      FROM groups g LEFT JOIN similar_keys n ON g.dedup_key = n.k""",
    "key_leaders": """WITH RECURSIVE steps AS (
        SELECT company, step, k, k AS leader, [k] AS leaders FROM key_order WHERE step = 1
        UNION ALL
        SELECT company, step, k, coalesce(first, k),
          CASE WHEN first IS NULL THEN list_append(leaders, k) ELSE leaders END
        FROM (SELECT o.company, o.step, o.k, s.leaders,
            list_filter(s.leaders, lambda x: list_contains(o.near, x))[1] AS first
          FROM steps s JOIN key_order o ON o.company = s.company AND o.step = s.step + 1))
      SELECT k, leader FROM steps""",
    "led": "SELECT p.*, l.leader FROM keyed p JOIN key_leaders l ON p.dedup_key = l.k",
    "family_rows": f"""SELECT leader, min(id) AS leader_id, count(*) AS copies,
      {fold("list(location ORDER BY id)")} AS merged_location,
      max(CAST(coalesce(is_reposted, 0) <> 0 AS INT)) AS reposted,
      first(coalesce(nullif(status, ''), 'new') ORDER BY {rank("coalesce(nullif(status, ''), 'new')")} DESC, id) AS merged_status,
      max(length(coalesce(description, ''))) AS n_chars FROM led GROUP BY leader""",
    "posting_numbers": """SELECT posting_id, row_number() OVER (ORDER BY posting_id) AS pid FROM (
      SELECT posting_id FROM stored UNION SELECT posting_id FROM batch)""",
    "key_numbers": """SELECT a.k, row_number() OVER (ORDER BY a.k) AS kid FROM all_keys a""",
    "near_numbers": """SELECT kid, list(held) AS near FROM (
        SELECT p.kid, h.kid AS held FROM similar_keys s JOIN key_numbers p ON p.k = s.k,
          unnest(s.near) AS u(name) JOIN key_numbers h ON h.k = u.name) GROUP BY kid""",
    "batch_steps": """SELECT b.seq, row_number() OVER (ORDER BY b.seq) AS step, p.pid, k.kid, coalesce(n.near, []) AS near
      FROM batch b JOIN posting_numbers p ON p.posting_id = b.posting_id
      LEFT JOIN key_numbers k ON k.k = b.dedup_key LEFT JOIN near_numbers n ON n.kid = k.kid""",
    # Owners are stored ids; a posting that the batch starts is -1 - seq.
    "row_by_row": """WITH RECURSIVE walk AS (
        SELECT CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS owner,
          (SELECT list(struct_pack(o := CAST(s.id AS BIGINT), p := p.pid, k := k.kid) ORDER BY s.id) FROM stored s
            JOIN posting_numbers p ON p.posting_id = s.posting_id
            LEFT JOIN key_numbers k ON k.k = s.dedup_key) AS held
        UNION ALL
        SELECT step, seq, coalesce(hit, -1 - seq),
          CASE WHEN hit IS NULL THEN list_append(held, struct_pack(o := -1 - seq, p := pid, k := kid))
            ELSE list_transform(held, lambda x: CASE WHEN x.o = hit AND kid IS NOT NULL
              THEN struct_pack(o := x.o, p := x.p, k := kid) ELSE x END) END
        FROM (SELECT r.step, r.seq, r.pid, r.kid, w.held, coalesce(
              list_filter(w.held, lambda x: x.p = r.pid)[1].o, list_filter(w.held, lambda x: x.k = r.kid)[1].o,
              list_filter(w.held, lambda x: list_contains(r.near, x.k))[1].o) AS hit
          FROM walk w JOIN batch_steps r ON r.step = w.step + 1))
      SELECT seq, owner FROM walk WHERE seq IS NOT NULL""",
    "resolved_fuzzy": """SELECT b.*, CASE WHEN w.owner >= 0 THEN w.owner END AS target_id,
        CASE WHEN w.owner < 0 THEN 's:' || (-1 - w.owner) END AS g, CAST(w.owner = -1 - b.seq AS INT) AS is_new
      FROM batch b JOIN row_by_row w ON w.seq = b.seq""",
}
for _name in ("updates", "fresh_groups", "inserts", "merged"):
    CTES[f"{_name}_fuzzy"] = re.sub(r"\b(resolved|updates|fresh_groups)\b", r"\1_fuzzy", CTES[_name])


def resume_years(c):
    lo, hi = vocab.RESUME_YEARS_RANGE
    arms = " ".join(
        f"WHEN {v} BETWEEN {lo} AND {hi} THEN {v}"
        for p in vocab.RESUME_YEARS
        for v in [f"TRY_CAST(regexp_extract({c}, {lit(p)}, 1) AS DOUBLE)"])
    return f"CASE {arms} ELSE {lit(vocab.RESUME_YEARS_DEFAULT)} END"


CV_SKILLS = joined(found([(t, token("low", t)) for t in vocab.SKILL_TERMS]))
CV_CLOUDS = joined(found([(t, f"contains(low, {lit(t.lower())})") for t in vocab.RESUME_CLOUDS]))
CV_CERTS = joined(found([(t, token("low", t)) for t in vocab.CERTIFICATIONS]))
CV_DEGREES = joined(found([(t, f"contains(low, {lit(t.lower())})") for t in vocab.DEGREES]))
CV_SUMMARY = (f"coalesce(list_filter(list_transform(string_split(resume_text, chr(10)), "
              f"lambda s: {trim('s')}), lambda s: s <> '')[1], {lit(vocab.EMPTY_RESUME_SUMMARY)})")
DEFAULT_ROLES = lit("|".join(vocab.PROFILE_DEFAULTS["target_roles"]))

SAID_NUMBER = "CAST(json_extract(r.reply, '$.years_experience') AS DOUBLE)"


def said(name):
    return f"json_extract_string(r.reply, '$.{name}')"


def said_list(name):
    return (f"array_to_string(coalesce(CAST(json_extract(r.reply, '$.{name}') AS VARCHAR[]), "
            "CAST([] AS VARCHAR[])), '|')")


def strict_cap(cap):
    title = " AND ".join(f"lower(title) NOT LIKE '%{k}%'" for k in vocab.STRICT_TITLE_BLOCK)
    level = " AND ".join(f"(experience_level IS NULL OR lower(experience_level) NOT LIKE '%{k}%')"
                         for k in vocab.STRICT_LEVEL_BLOCK)
    return f"(lo IS NULL OR lo <= {cap}) AND {title} AND {level}"


PRIORITY_RANK = "CASE priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
ORDERS = {
    "priority_desc": f"{PRIORITY_RANK}, ats_score DESC, fit_score DESC, id",
    "ats_desc": "ats_score DESC, fit_score DESC, id",
    "fit_desc": "fit_score DESC, ats_score DESC, id",
    "date_desc": "scraped_at DESC, id DESC",
}


def sorted_page(name):
    return (f"SELECT row_number() OVER (ORDER BY {ORDERS[name]}) AS rank, id, ats_score, fit_score, "
            f"priority FROM scored ORDER BY rank LIMIT 100")


def keyword(k):
    k = k.lower()
    return (f"(contains(lower(title), '{k}') OR contains(lower(company), '{k}') "
            f"OR contains(lower(description), '{k}'))")


def mean(c):
    return (f"coalesce(round_even(sum(CASE WHEN ats_score > 0 THEN CAST(round_even({c} * 10, 0) AS BIGINT) END) "
            "/ (count(*) FILTER (WHERE ats_score > 0) * 10.0), 1), 0.0)")


def request_sql():
    p = vocab.DEFAULT_PROFILE
    head = ("How well does this person fit the posting?\n"
            f"Years: {p['years_experience']}\nSkills: {', '.join(p['skills'])}\n"
            f"Clouds: {', '.join(p['cloud_platforms'])}\n"
            f"Certificates: {', '.join(p['certifications'])}\nPlace: {p['location']}\nTitle: ")
    ask = ("\nAnswer with one JSON object: key_strengths (list), critical_gaps (list), "
           "interview_tips (one sentence).")
    return (f"SELECT id, {lit(head)} || title || {lit(chr(10) + 'Company: ')} || company || "
            f"{lit(chr(10) + 'Posting:' + chr(10))} || substr(description, 1, {REQUEST_POSTING}) || {lit(ask)} "
            f"AS request FROM postings WHERE length(description) > {MIN_DESCRIPTION}")


RESOLVED_COLUMNS = "seq, dedup_key, is_reposted, target_id, is_new"
MERGED = ("id, posting_id, title, company, location, url, posted_at, employment_type, "
          "experience_level, work_mode, salary, description, is_reposted, status, dedup_key")
LATEST_STATUS = """SELECT id, lower(status) AS status, event_id FROM status_events
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1"""
LATEST_PROFILE = """SELECT * FROM profile_saves
  QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC, event_id DESC) = 1"""
MERGE_SQL = f"SELECT {MERGED} FROM merged UNION ALL SELECT {MERGED} FROM inserts"
FUZZY_MERGE_SQL = f"SELECT {MERGED} FROM merged_fuzzy UNION ALL SELECT {MERGED} FROM inserts_fuzzy"
PD = vocab.PROFILE_DEFAULTS

ORACLES = {
    "scan_decode_json": """SELECT id,
      array_to_string(CAST(json_extract(coalesce(nullif(matched_skills, ''), '[]'), '$') AS VARCHAR[]), '|') AS matched,
      CAST(json_array_length(missing_skills) AS BIGINT) AS n_missing,
      CAST(json_extract(coalesce(nullif(score_breakdown, ''), '{}'), '$.raw_ats') AS DOUBLE) AS raw_ats,
      CAST(json_extract(coalesce(nullif(score_breakdown, ''), '{}'), '$.skills.score') AS DOUBLE) AS skills_score,
      CAST(json_extract(coalesce(nullif(score_breakdown, ''), '{}'), '$.skills.max') AS INT) AS skills_max
      FROM json_postings""",
    "scan_projected": f"SELECT {', '.join(SCORING_COLUMNS)} FROM postings",
    "lookup_by_id": """SELECT id, title, company,
      array_to_string(CAST(json_extract(coalesce(nullif(matched_skills, ''), '[]'), '$') AS VARCHAR[]), '|') AS matched,
      array_to_string(CAST(json_extract(missing_skills, '$') AS VARCHAR[]), '|') AS missing
      FROM json_postings WHERE id = 42""",
    "profile_or_default": f"""SELECT f.candidate_id, f.candidate_name AS person,
      CASE WHEN s.candidate_id IS NULL THEN {lit(PROFILE['candidate_name'])} ELSE {lit(PD['candidate_name'])} END AS candidate_name,
      CASE WHEN s.candidate_id IS NULL THEN {lit(PROFILE['years_experience'])} ELSE s.years_experience END AS years_experience,
      CASE WHEN s.candidate_id IS NULL THEN {lit(PROFILE['location'])} ELSE coalesce(s.location, {lit(PD['location'])}) END AS location,
      CASE WHEN s.candidate_id IS NULL THEN {lit(PROFILE['summary'])} ELSE coalesce(s.summary, '') END AS summary,
      CASE WHEN s.candidate_id IS NULL THEN {lit('|'.join(PROFILE['skills']))} ELSE '' END AS skills,
      CASE WHEN s.candidate_id IS NULL THEN {lit('|'.join(PROFILE['target_roles']))} ELSE {DEFAULT_ROLES} END AS target_roles
      FROM candidate_forms f LEFT JOIN ({LATEST_PROFILE}) s ON f.candidate_id = s.candidate_id""",
    "profile_latest": f"SELECT candidate_id, event_id, years_experience, location, summary FROM ({LATEST_PROFILE})",
    "schema_evolve_defaults": """SELECT id, title, CAST(NULL AS DOUBLE) AS required_experience, '' AS seniority,
      CAST(0 AS INT) AS is_reposted, '' AS dedup_key FROM postings""",
    "decode_resume_bytes": r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR NOT regexp_matches(text, '^[\x{00}-\x{ff}]*$')
      THEN text ELSE text END AS resume_text FROM documents""",
    "html_cards": "SELECT * FROM kept_cards",
    "html_detail": f"""SELECT page_id, title, company, location, description, experience_level, employment_type,
      CASE WHEN contains(lower(concat_ws(' ', title, location, description)), 'remote') THEN 'Remote'
        WHEN contains(lower(concat_ws(' ', title, location, description)), 'hybrid') THEN 'Hybrid' ELSE 'On-site' END AS work_mode,
      salary, is_reposted FROM details""",
    "upsert_insert_rows": """SELECT id, posting_id, title, company, location, url, posted_at, employment_type,
      experience_level, work_mode, salary, description, is_reposted, dedup_key, status,
      CAST(0 AS DOUBLE) AS ats_score, CAST(0 AS DOUBLE) AS fit_score, 'MEDIUM' AS priority, '' AS seniority, '' AS matched
      FROM inserts""",
    "apply_scores": f"""SELECT id, CASE WHEN priority <> 'LOW' THEN ats_score ELSE 0.0 END AS ats_score,
      CASE WHEN priority <> 'LOW' THEN fit_score ELSE 0.0 END AS fit_score,
      CASE WHEN priority <> 'LOW' THEN priority ELSE 'MEDIUM' END AS priority,
      CASE WHEN priority <> 'LOW' THEN {joined('matched')} ELSE '' END AS matched,
      CASE WHEN priority <> 'LOW' THEN lo ELSE 9.0 END AS required_experience,
      CASE WHEN priority <> 'LOW' THEN seniority ELSE 'old' END AS seniority FROM scored""",
    "ingest_run_log": """SELECT keywords, 'India' AS location, count(*) AS jobs_found,
      count(*) FILTER (WHERE is_new = 1) AS new_jobs FROM resolved GROUP BY keywords""",
    "feed_exp_cap_strict": f"SELECT id, title, required_experience FROM scored WHERE {strict_cap(3.0)}",
    "feed_exp_cap_loose": "SELECT id, title, required_experience FROM scored WHERE lo IS NULL OR lo <= 5.0",
    "feed_no_cap": "SELECT id, title, required_experience FROM scored",
    "feed_min_scores": "SELECT id, ats_score, fit_score FROM scored WHERE ats_score >= 60 AND fit_score >= 70",
    "feed_priority": "SELECT id, priority FROM scored WHERE priority = 'MEDIUM'",
    "feed_work_mode": "SELECT id, work_mode FROM postings WHERE lower(work_mode) LIKE '%remote%'",
    "feed_exp_level": "SELECT id, experience_level FROM postings WHERE lower(experience_level) LIKE '%senior%'",
    "feed_status_tab": """SELECT 'new' AS tab, id, status FROM postings WHERE status = 'new' OR status IS NULL
      UNION ALL SELECT 'saved', id, status FROM postings WHERE status = 'saved'
      UNION ALL SELECT 'all', id, status FROM postings""",
    "feed_keyword": f"SELECT id, title FROM postings WHERE {keyword('terraform')}",
    "feed_location": "SELECT id, location FROM postings WHERE lower(location) LIKE '%hyderabad%'",
    "feed_combined": f"""SELECT id, ats_score, fit_score, priority FROM scored WHERE (lo IS NULL OR lo <= 6)
      AND ats_score >= 40 AND lower(work_mode) LIKE '%remote%' AND (status = 'new' OR status IS NULL)
      AND {keyword('engineer')} AND lower(location) LIKE '%india%'""",
    "feed_total": f"SELECT count(*) AS total FROM scored WHERE {strict_cap(3.0)} AND (status = 'new' OR status IS NULL)",
    "feed_page": f"SELECT id, priority, ats_score, fit_score FROM scored ORDER BY {ORDERS['priority_desc']} LIMIT 25 OFFSET 50",
    "feed_page_count": f"""SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages
      FROM scored WHERE {strict_cap(3.0)}""",
    "feed_rank": f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY {ORDERS['ats_desc']}) AS rank, id, ats_score
      FROM scored) WHERE rank BETWEEN 26 AND 75""",
    **{f"sort_{n}": sorted_page(n) for n in ORDERS},
    "feed_exit_flag": """SELECT e.event_id, e.id, coalesce(p.status, 'new') AS tab, lower(e.status) AS status,
      CASE WHEN coalesce(p.status, 'new') = 'new' THEN CASE WHEN lower(e.status) = 'new' THEN 0 ELSE 1 END
        WHEN coalesce(p.status, 'new') = lower(e.status) THEN 0 ELSE 1 END AS leaves
      FROM status_events e JOIN postings p ON e.id = p.id""",
    "repost_flag": f"SELECT id, {REPOST} AS is_reposted FROM postings",
    "repost_display": f"""SELECT id, {flag("coalesce(is_reposted, 0) <> 0 OR contains(lower(posted_at), 'repost')")} AS shown
      FROM postings""",
    "search_recency": """SELECT id, CAST(epoch(scraped_at) AS BIGINT) AS scraped FROM postings
      WHERE scraped_at >= (SELECT max(scraped_at) FROM postings) - INTERVAL 604800 SECOND""",
    "search_work_type": "SELECT id, work_mode FROM postings WHERE work_mode = 'Remote'",
    "search_roles_topn": " UNION ALL ".join(
        f"SELECT * FROM (SELECT {lit(r)} AS role, row_number() OVER (ORDER BY scraped_at DESC, id DESC) AS role_rank, id "
        f"FROM postings WHERE {keyword(r)}) WHERE role_rank <= 50" for r in vocab.PRESET_ROLES),
    "roles_union_all": " UNION ALL ".join(
        f"SELECT * FROM (SELECT {lit(r)} AS role, id FROM postings WHERE {keyword(r)} "
        "ORDER BY scraped_at DESC, id DESC LIMIT 100)"
        for r in ("DevOps Engineer", "Cloud Engineer", "Engineer")),
    "score_postings": f"""SELECT id, ats_score, fit_score, priority, required_experience, seniority,
      {joined('matched')} AS matched, {joined('missing')} AS missing, {joined('concerns')} AS concerns FROM scored""",
    "score_breakdown": f"""SELECT id, {', '.join(f'c_{n} AS {n}' for n in COMPONENTS)},
      {', '.join(f'CAST({m} AS INT) AS {n}_max' for n, m in COMPONENTS.items())},
      raw_ats, penalty, {joined('concerns')} AS reasons, ats_score AS final_ats, fit_score AS fit, priority FROM scored""",
    "skills_match": f"SELECT id, {joined('matched')} AS matched FROM scored_parts",
    "skills_missing": f"SELECT id, {joined('missing')} AS missing FROM scored_parts",
    "score_skills": "SELECT id, c_skills AS score FROM scored_parts",
    "score_cloud": "SELECT id, c_cloud_platform AS score FROM scored_parts",
    "score_experience": f"SELECT id, c_experience AS score, exp_penalty AS penalty, {joined('exp_concerns')} AS concerns FROM scored_parts",
    "score_fit": "SELECT id, fit_score AS fit FROM scored_parts",
    "score_title_gate": f"SELECT id, gate_penalty AS penalty, {joined('gate_concerns')} AS concerns FROM scored_parts",
    "score_components": """SELECT id, c_responsibilities AS responsibilities, c_education AS education,
      c_certifications AS certifications, c_ats_keywords AS ats_keywords, c_location AS location FROM scored_parts""",
    "score_priority": "SELECT id, priority, blocked FROM scored",
    "score_many_candidates": """SELECT p.candidate_id, t.* EXCLUDE (years, place, skill_list, cloud_list, n_edu, n_cert)
      FROM people p JOIN (SELECT years, place, skill_list, cloud_list, n_edu, n_cert,
        count(*) FILTER (WHERE priority = 'HIGH') AS n_high, count(*) FILTER (WHERE priority = 'MEDIUM') AS n_medium,
        count(*) FILTER (WHERE priority = 'LOW') AS n_low, max(ats_score) AS best_ats, max(fit_score) AS best_fit
        FROM many GROUP BY years, place, skill_list, cloud_list, n_edu, n_cert) t
      ON p.years = t.years AND p.place = t.place AND p.skill_list = t.skill_list AND p.cloud_list = t.cloud_list
        AND CAST(p.n_edu > 0 AS INT) = t.n_edu AND CAST(p.n_cert > 0 AS INT) = t.n_cert""",
    "topk_per_candidate": f"""SELECT p.candidate_id, t.rank, t.id, t.ats_score, t.fit_score
      FROM people p JOIN (SELECT *, row_number() OVER (PARTITION BY years, place, skill_list, cloud_list, n_edu, n_cert
        ORDER BY {PRIORITY_RANK}, ats_score DESC, fit_score DESC, id) AS rank FROM many) t
      ON p.years = t.years AND p.place = t.place AND p.skill_list = t.skill_list AND p.cloud_list = t.cloud_list
        AND CAST(p.n_edu > 0 AS INT) = t.n_edu AND CAST(p.n_cert > 0 AS INT) = t.n_cert WHERE t.rank <= 5""",
    "score_bands": """SELECT CASE WHEN floor(ats_score + 0.5) >= 80 THEN 'green' WHEN floor(ats_score + 0.5) >= 60
      THEN 'amber' ELSE 'red' END AS band, count(*) AS postings FROM scored GROUP BY band""",
    "skill_chips": f"""SELECT id, {joined('matched[1:10]')} AS matched, {joined('missing[1:8]')} AS missing,
      {joined('matched[1:6]')} AS summary FROM scored_parts""",
    "csv_to_array": f"""SELECT candidate_id, {joined(csv('skills_csv'))} AS skills,
      CAST(len({csv('skills_csv')}) AS BIGINT) AS n_skills, {joined(csv('clouds_csv'))} AS clouds FROM candidate_forms""",
    "extract_skills": f"SELECT id, {joined('skills')} AS skills FROM analysed",
    "extract_clouds": f"SELECT id, {joined('clouds')} AS clouds FROM analysed",
    "extract_experience": "SELECT id, lo AS min_years, hi AS max_years, coalesce(shown, '') AS years_text FROM year_rows",
    "extract_seniority": "SELECT id, seniority FROM seniorities",
    "infer_experience": "SELECT id, guess AS inferred_years FROM analysed",
    "detect_domain": "SELECT id, domain FROM analysed",
    "domain_term_counts": f"""SELECT id, CAST({occurrences('low', vocab.CLOUD_DOMAIN_TERMS)} AS BIGINT) AS cloud_terms,
      CAST({occurrences('low', vocab.SOFTWARE_DOMAIN_TERMS)} AS BIGINT) AS software_terms FROM lowered""",
    "degree_required": "SELECT id, CAST(degree AS INT) AS degree FROM analysed",
    "analyze_postings": f"""SELECT id, {joined('skills')} AS skills, {joined('clouds')} AS clouds, lo AS min_years,
      hi AS max_years, CASE WHEN shown IS NOT NULL THEN shown WHEN guess IS NOT NULL
        THEN CAST(guess AS VARCHAR) || '+ years (inferred from ' || seniority || ')' ELSE '' END AS years_text,
      CAST(stated_lo IS NULL AND guess IS NOT NULL AS INT) AS inferred, seniority, domain,
      CAST(degree AS INT) AS degree FROM analysed""",
    "normalize_company": f"SELECT id, {company_norm('company')} AS company FROM postings",
    "normalize_title": f"SELECT id, {title_norm('title')} AS title FROM postings",
    "dedup_key": "SELECT id, dedup_key FROM keyed",
    "work_mode_detect": """SELECT id, CASE WHEN contains(lower(title || ' ' || location || ' ' || description), 'remote')
      THEN 'Remote' WHEN contains(lower(title || ' ' || location || ' ' || description), 'hybrid') THEN 'Hybrid'
      ELSE 'On-site' END AS work_mode FROM postings""",
    "merge_locations_pair": f"""SELECT p.id, p.location AS kept, i.location, {merge('p.location', 'i.location')} AS merged
      FROM postings p JOIN incoming i ON p.posting_id = i.posting_id""",
    "merge_locations": "SELECT leader_id, copies, merged_location FROM groups",
    "dedup_status_merge": "SELECT leader_id, merged_status FROM groups",
    "dedup_exact_key": "SELECT id, posting_id, title, company, location, is_reposted, status, description, dedup_key FROM stored",
    "dedup_report": """SELECT count(*) AS initial_count, count(*) - (SELECT sum(copies - 1) FROM groups) AS cleaned_count,
      CAST((SELECT sum(copies - 1) FROM groups) AS BIGINT) AS duplicates_removed FROM postings""",
    "dedup_fuzzy": """SELECT k.id, k.posting_id, coalesce(CASE WHEN f.copies > 1 THEN f.merged_location END, k.location) AS location,
      CASE WHEN f.copies > 1 THEN f.reposted ELSE k.is_reposted END AS is_reposted,
      CASE WHEN f.copies > 1 THEN f.merged_status ELSE k.status END AS status,
      CASE WHEN f.copies > 1 THEN f.n_chars ELSE length(k.description) END AS n_chars, k.dedup_key
      FROM keyed k LEFT JOIN family_rows f ON k.id = f.leader_id
      WHERE f.leader_id IS NOT NULL OR k.dedup_key = ''""",
    "dedup_fuzzy_report": """SELECT count(*) AS initial_count,
      CAST(count(*) - (SELECT sum(copies - 1) FROM family_rows) AS BIGINT) AS cleaned_count,
      CAST((SELECT sum(copies - 1) FROM family_rows) AS BIGINT) AS duplicates_removed FROM keyed""",
    "upsert_match_fuzzy": "SELECT seq, dedup_key, target_id, is_new = 1 AS is_new FROM resolved_fuzzy",
    "title_similarity": """SELECT p.id, p.a, p.b, CASE WHEN length(a) + length(b) = 0 THEN 1.0
      ELSE CAST(2.0 * n AS DOUBLE) / (length(a) + length(b)) END AS ratio FROM same_postings p JOIN same_matches USING (id)""",
    "upsert_merge_fuzzy": FUZZY_MERGE_SQL,
    "upsert_match_id": "SELECT seq, by_id FROM resolved",
    "upsert_match_key": "SELECT seq, by_id, by_key FROM resolved",
    "upsert_resolve_exact": f"SELECT {RESOLVED_COLUMNS} FROM resolved",
    "upsert_merge_exact": MERGE_SQL,
    "apply_status": f"""SELECT p.id, coalesce(s.status, p.status) AS status FROM postings p
      LEFT JOIN ({LATEST_STATUS}) s ON p.id = s.id""",
    "status_latest": LATEST_STATUS,
    "feed_page_stored": f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY {ORDERS['ats_desc']}) AS rank, id, ats_score,
      fit_score, title FROM scored) WHERE rank BETWEEN 701 AND 725""",
    "feed_tab_stored": f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY {ORDERS['priority_desc']}) AS rank, id, priority,
      ats_score, fit_score FROM scored WHERE status = 'saved') WHERE rank BETWEEN 21 AND 60""",
    "lookup_stored": """SELECT s.id, s.posting_id, s.title, s.priority, s.ats_score, s.fit_score FROM scored s
      WHERE s.posting_id IN (SELECT posting_id FROM incoming WHERE seq % 50 = 0)""",
    "any_contains": f"""SELECT candidate_id, len(list_filter({csv('skills_csv')}, lambda s: contains(lower(s), 'python'))) > 0
      AS has_python FROM candidate_forms""",
    "stats_dashboard": f"""SELECT count(*) AS total, count(DISTINCT posting_id) AS unique_postings,
      count(*) FILTER (WHERE ats_score > 0) AS scored, count(*) FILTER (WHERE priority = 'HIGH') AS high_priority,
      {mean('ats_score')} AS avg_ats, {mean('fit_score')} AS avg_fit,
      count(*) FILTER (WHERE status = 'new' OR status IS NULL) AS count_new,
      {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS count_{s}" for s in ('saved', 'applied', 'rejected', 'ignored'))}
      FROM scored""",
    "priority_counts": "SELECT priority, count(*) AS postings FROM scored GROUP BY priority",
    "top5_high": "SELECT id, title, ats_score, fit_score FROM scored WHERE priority = 'HIGH' ORDER BY id LIMIT 5",
    "ingest_role_rollup": """SELECT keywords, count(*) AS found, count(*) FILTER (WHERE is_new = 1) AS new,
      CAST(sum(is_reposted) AS BIGINT) AS reposted FROM resolved GROUP BY ROLLUP (keywords)""",
    "cards_first_seen": "SELECT search_id, posting_id, page, pos, title FROM seen",
    "page_yield": "SELECT search_id, page, new_cards, CAST(kept AS INT) AS kept FROM page_flags",
    "search_cards": """SELECT s.search_id, s.page, s.pos, s.posting_id, s.url FROM seen s JOIN page_flags f
      ON s.search_id = f.search_id AND s.page = f.page WHERE f.kept""",
    "posting_id_extract": "SELECT page, pos, posting_id FROM kept_cards",
    "url_canonical": "SELECT page, pos, url FROM kept_cards",
    "html_repost": "SELECT page_id, is_reposted FROM details",
    "html_to_text": "SELECT page_id, description FROM details",
    "html_cards_rendered": """SELECT CAST(floor(doc_id / 25) AS BIGINT) AS page, CAST(doc_id AS VARCHAR) AS posting_id,
      'Role ' || doc_id || ' & more' AS title, 'Acme' || source AS company,
      CASE WHEN doc_id % 5 = 0 THEN 'India' ELSE 'Lima' END AS location,
      'https://jobs.example.com/jobs/view/' || doc_id AS url FROM documents""",
    "html_nested": """SELECT page_id, 'one' || chr(10) || chr(10) || split_part(url, '/', 3)
      || 'deepIt''s ' || chr(65533) || chr(65533) || ' < A' AS description FROM pages""",
    "html_criteria": "SELECT page_id, experience_level, employment_type FROM details",
    "salary_extract": "SELECT page_id, salary FROM details",
    "resume_skills": f"SELECT resume_id, {CV_SKILLS} AS skills FROM cv_all",
    "resume_years": f"SELECT resume_id, {resume_years('resume_text')} AS years FROM cv_all",
    "resume_clouds": f"SELECT resume_id, {CV_CLOUDS} AS clouds FROM cv_all",
    "resume_certs": f"SELECT resume_id, {CV_CERTS} AS certifications FROM cv_all",
    "resume_education": f"SELECT resume_id, {CV_DEGREES} AS education FROM cv_all",
    "resume_summary": f"SELECT resume_id, {CV_SUMMARY} AS summary FROM cv_all",
    "structure_resumes": f"""SELECT resume_id, replace(file_name, '.txt', '') AS candidate_name, {DEFAULT_ROLES} AS target_roles,
      {resume_years('resume_text')} AS years_experience, 'India' AS location, {CV_SKILLS} AS skills,
      {CV_CLOUDS} AS cloud_platforms, {CV_CERTS} AS certifications, {CV_DEGREES} AS education,
      {CV_SUMMARY} AS summary, resume_text AS raw_text FROM cv""",
    "profile_reply_or_rules": f"""SELECT c.resume_id,
      CASE WHEN r.reply IS NULL THEN replace(file_name, '.txt', '') ELSE {said('candidate_name')} END AS candidate_name,
      {DEFAULT_ROLES} AS target_roles,
      CASE WHEN r.reply IS NULL THEN {resume_years('resume_text')} ELSE {SAID_NUMBER} END AS years_experience,
      coalesce({said('location')}, 'India') AS location,
      CASE WHEN {said_list('skills')} <> '' THEN {said_list('skills')} ELSE {CV_SKILLS} END AS skills,
      CASE WHEN {said_list('cloud_platforms')} <> '' THEN {said_list('cloud_platforms')} ELSE {CV_CLOUDS} END AS cloud_platforms,
      CASE WHEN r.reply IS NULL THEN {CV_CERTS} ELSE '' END AS certifications,
      CASE WHEN r.reply IS NULL THEN {CV_DEGREES} ELSE '' END AS education,
      CASE WHEN r.reply IS NULL THEN {CV_SUMMARY} ELSE '' END AS summary, resume_text AS raw_text
      FROM cv c LEFT JOIN profile_replies r ON c.resume_id = r.resume_id""",
    "profile_defaults": f"""SELECT r.resume_id, {said('candidate_name')} AS candidate_name, {DEFAULT_ROLES} AS target_roles,
      {SAID_NUMBER} AS years_experience, coalesce({said('location')}, 'India') AS location,
      {said_list('skills')} AS skills, {said_list('cloud_platforms')} AS cloud_platforms, '' AS certifications,
      '' AS education, '' AS summary, '' AS raw_text FROM profile_replies r""",
    "model_reply_parse": "SELECT * FROM answer_parts",
    "ai_analysis_compose": """SELECT p.id, CASE WHEN length(p.description) > 100 THEN concat_ws(chr(10) || chr(10),
      CASE WHEN a.strengths <> '' THEN '**Strengths:** ' || replace(a.strengths, '|', ', ') END,
      CASE WHEN a.gaps <> '' THEN '**Critical Gaps:** ' || replace(a.gaps, '|', ', ') END,
      CASE WHEN a.tips <> '' THEN '**Action Tip:** ' || a.tips END) ELSE '' END AS ai_analysis
      FROM postings p LEFT JOIN answer_parts a ON p.id = a.id""",
    "prompt_build": request_sql(),
    "upsert_merge_drift": """SELECT doc_id + 1 AS id, 'ext_' || doc_id AS posting_id,
      CASE WHEN doc_id % 3 = 0 THEN 'Site Reliability Lead' ELSE 'Cloud Engineer' END AS title,
      'Drift ' || doc_id AS company, CASE WHEN doc_id % 3 = 1 THEN 'u' ELSE 'v1' END AS url,
      CASE WHEN doc_id % 3 = 1 THEN source ELSE source || ' and more' END AS description,
      'saved' AS status FROM documents
      UNION ALL
      SELECT (SELECT max(doc_id) + 1 FROM documents) + row_number() OVER (ORDER BY seq) AS id,
        posting_id, title, company, url, description, 'new' AS status FROM (
        SELECT doc_id * 3 + 2 AS seq, 'old_' || doc_id AS posting_id, 'Cloud Engineer' AS title,
          'Drift ' || doc_id AS company, 'v2' AS url, '' AS description FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id * 3, 'fresh_' || doc_id, 'Data Engineer', 'Newer ' || doc_id, 'v1',
          source || ' and more' FROM documents WHERE doc_id % 3 = 1
        UNION ALL SELECT doc_id * 3 + 2, 'late_' || doc_id, 'Cloud Engineer', 'Newer ' || doc_id, 'v2', ''
          FROM documents WHERE doc_id % 3 = 1)""",
    "feed_unknown_sort": f"""SELECT row_number() OVER (ORDER BY {ORDERS['priority_desc']}) AS rank, id, priority
      FROM scored ORDER BY rank LIMIT 25""",
    "stream_upsert": MERGE_SQL,
    "stream_upsert_fuzzy": FUZZY_MERGE_SQL,
    "stream_status_latest": LATEST_STATUS,
    "stream_first_seen": "SELECT DISTINCT id FROM status_events",
    "stream_run_log": """SELECT keywords, count(*) AS jobs_found,
      count(*) FILTER (WHERE is_new = 1) AS new_jobs FROM resolved GROUP BY keywords""",
}

ORACLES["profile_json_sink"] = ORACLES["profile_defaults"]
ORACLES["stream_figures"] = ORACLES["stats_dashboard"].replace("FROM scored", """FROM (
  SELECT sc.posting_id, sc.ats_score, sc.fit_score, sc.priority, sc.status FROM scored sc JOIN stored st USING (id)
  UNION ALL SELECT posting_id, 0.0, 0.0, 'MEDIUM', status FROM inserts_fuzzy)""")


def _needed(sql: str, have: list[str]) -> list[str]:
    for name, body in CTES.items():
        if name not in have and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", sql):
            _needed(body, have)
            if name not in have:
                have.append(name)
    return have


def assembled(sql: str) -> str:
    names = _needed(sql, [])
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in names)
    return f"WITH {parts} {sql}" if parts else sql


def all_oracles() -> dict[str, str]:
    return {name: assembled(sql) for name, sql in ORACLES.items()}
