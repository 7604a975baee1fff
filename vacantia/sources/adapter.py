"""Posting-shaped views over the given tables.

The given `documents` are invented prose, so each view adds titles, companies, year phrases and
skills around the *whole* text, by rules on the row's own columns. Every view is one SQL text that
both Spark and the checking engine run, so both sides see the same rows; `{name}` stands for a
table and the few functions whose names differ are in DIALECTS.
"""

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {"from_epoch": "timestamp_seconds(%s)", "to_epoch": "unix_timestamp(%s)",
              "strip_tags": "regexp_replace(%s, '<[^>]*>', '')"},
    "duckdb": {"from_epoch": "make_timestamp(CAST((%s) * 1000000 AS BIGINT))",
               "to_epoch": "CAST(epoch(%s) AS BIGINT)",
               "strip_tags": "regexp_replace(%s, '<[^>]*>', '', 'g')"},
}


def _pick(on: str, *values: str) -> str:
    """CASE over the remainder of `on`; None stands for NULL."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values))
    return f"(CASE {on} % {len(values)} {arms} END)"


TITLES = ["Junior Azure Cloud Engineer", "Senior Backend Java Engineer", "DevOps Architect",
          "Cloud Operations Specialist", "Site Reliability Engineer (Night Shift)",
          "Platform Engineer [IRC12345]", "Lead GCP Cloud Engineer", "Data Engineer",
          "Machine Learning Engineer", "Associate DevOps Engineer",
          "Principal Infrastructure Engineer", "Engineering Manager", "DevOps Engineer",
          "DevOps Engineers", "React Developer", "Support Analyst"]
YEARS = ["Experience: 6-10 Yrs.", "Minimum 4 years.", "3+ years of work experience.",
         "3 to 5 years.", "2+ yrs.", "experience 40 years", "1+ years experience.", "", "", ""]
SKILL_LINES = ["Azure, Kubernetes, Terraform, Docker, Linux, CI/CD",
               "Java, Spring Boot, Kafka, PostgreSQL", "AWS, Docker, Python",
               "GitLab CI/CD and Go", "GCP and GKE with Helm", "Prometheus, Grafana",
               "Node.js, C++", "Azure and Linux", "", "speaks for 6 weeks", "Terraform"]

POSTINGS = f"""
SELECT d.doc_id + 1 AS id,
  'ext_' || CAST(d.doc_id AS STRING) AS posting_id,
  {_pick('d.doc_id', *TITLES)} || CASE WHEN d.doc_id % 3 = 0 THEN ''
    ELSE ' ' || split_part(d.text, ' ', 1) END AS title,
  CASE d.doc_id % 7 WHEN 0 THEN 'Acme Technologies Pvt Ltd' WHEN 1 THEN 'ACME'
    WHEN 2 THEN 'Acme India' WHEN 3 THEN 'Globex Corporation' WHEN 4 THEN 'Globex'
    WHEN 5 THEN 'Initech Solutions' ELSE 'TechCorp ' || d.source END AS company,
  {_pick('d.doc_id', 'Hyderabad, India', 'Bengaluru, Karnataka, India', 'hyderabad', 'Remote',
         'Berlin, Germany', '')} AS location,
  'https://jobs.example.com/jobs/view/' || CAST(d.doc_id AS STRING) || '?ref=' || d.lang AS url,
  CASE WHEN d.doc_id % 9 = 0 THEN 'Reposted 3 days ago'
    ELSE CAST(d.doc_id % 23 + 1 AS STRING) || ' hours ago' END AS posted_at,
  {_pick('d.doc_id', 'Full-time', 'Contract', '')} AS employment_type,
  {_pick('d.doc_id', 'Entry level', 'Associate', 'Mid-Senior level', 'Director', None)}
    AS experience_level,
  {_pick('d.doc_id', 'Remote', 'Hybrid', 'On-site', None)} AS work_mode,
  {_pick('d.doc_id', '₹8,00,000 - ₹12,00,000', '$120,000', '')} AS salary,
  {_pick('d.doc_id', *YEARS)} || ' ' || {_pick('d.doc_id', *SKILL_LINES)} || '. '
    || {_pick('d.doc_id', 'Bachelor degree.', 'B.Tech needed.', '', 'Scrum Master.', '')}
    || ' ' || d.text AS description,
  [[from_epoch|1704067200 + d.doc_id * 3600]] AS scraped_at,
  CASE WHEN d.doc_id % 13 = 0 THEN 1 WHEN d.doc_id % 13 < 4 THEN 0 END AS is_reposted,
  CASE WHEN l.toxic = 1 THEN 'ignored' WHEN l.quality = 1 THEN 'saved'
    WHEN d.doc_id % 17 = 0 THEN 'applied' WHEN d.doc_id % 19 = 0 THEN 'rejected'
    WHEN d.doc_id % 23 = 0 THEN NULL ELSE 'new' END AS status
FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id
"""

# A later crawl of every document: the same posting again, a copy under a new id in another city,
# a slightly different title, and a posting of a new company that repeats inside the batch.
INCOMING = f"""
SELECT d.doc_id AS seq,
  {_pick('d.doc_id', 'Cloud Engineer', 'DevOps Engineer', 'Site Reliability Engineer')} AS keywords,
  CASE WHEN d.doc_id % 4 = 0 THEN 'ext_' ELSE 'new_' END || CAST(d.doc_id AS STRING) AS posting_id,
  CASE d.doc_id % 4 WHEN 2 THEN 'Site Reliability Engineers ' || split_part(d.text, ' ', 1)
    ELSE {_pick('d.doc_id', *TITLES)} || CASE WHEN d.doc_id % 3 = 0 THEN ''
      ELSE ' ' || split_part(d.text, ' ', 1) END END AS title,
  CASE WHEN d.doc_id % 4 = 3 THEN 'NewCo ' || CAST(d.doc_id % 50 AS STRING)
    WHEN d.doc_id % 7 <= 2 THEN 'ACME' WHEN d.doc_id % 7 <= 4 THEN 'Globex'
    WHEN d.doc_id % 7 = 5 THEN 'Initech Solutions' ELSE 'TechCorp ' || d.source END AS company,
  {_pick('d.doc_id', 'Pune, India', 'Hyderabad', 'Berlin', '', 'Chennai, India', 'remote', 'Oslo')}
    AS location,
  'https://jobs.example.com/jobs/view/9' || CAST(d.doc_id AS STRING) AS url,
  CASE WHEN d.doc_id % 9 = 1 THEN '' ELSE CAST(d.doc_id % 23 + 1 AS STRING) || ' minutes ago' END
    AS posted_at,
  {_pick('d.doc_id', 'Full-time', '', None)} AS employment_type,
  {_pick('d.doc_id', '', 'Associate', None)} AS experience_level,
  {_pick('d.doc_id', 'Remote', '', None, 'Hybrid')} AS work_mode,
  {_pick('d.doc_id', '', '$90,000')} AS salary,
  CASE WHEN d.doc_id % 4 = 0 THEN 'Updated posting. Reposted. ' ELSE '' END
    || {_pick('d.doc_id', *YEARS)} || ' ' || {_pick('d.doc_id', *SKILL_LINES)} || '. ' || d.text
    AS description,
  [[from_epoch|1706745600 + d.doc_id * 60]] AS scraped_at,
  CAST(NULL AS INT) AS is_reposted
FROM {{documents}} d
"""

# Stored postings with a company each, and a batch of three rows per company in which postings move
# to another key before rows that use the old or the new one.
DRIFT_STORED = """
SELECT d.doc_id + 1 AS id, 'ext_' || CAST(d.doc_id AS STRING) AS posting_id,
  'Cloud Engineer' AS title, 'Drift ' || CAST(d.doc_id AS STRING) AS company, 'Pune' AS location,
  'u' AS url, '' AS posted_at, '' AS employment_type, '' AS experience_level, '' AS work_mode,
  '' AS salary, d.source AS description, 0 AS is_reposted, 'saved' AS status,
  CAST(NULL AS STRING) AS dedup_key
FROM {documents} d
"""
DRIFT_BATCH = """
SELECT d.doc_id * 3 + k.step AS seq,
  CASE d.doc_id % 3 * 3 + k.step WHEN 1 THEN 'new_' WHEN 2 THEN 'old_' WHEN 3 THEN 'fresh_'
    WHEN 4 THEN 'fresh_' WHEN 5 THEN 'late_' WHEN 7 THEN 'x_' ELSE 'ext_' END
    || CAST(d.doc_id AS STRING) AS posting_id,
  CASE d.doc_id % 3 * 3 + k.step WHEN 0 THEN 'Site Reliability Lead'
    WHEN 1 THEN 'Site Reliability Lead' WHEN 4 THEN 'Data Engineer' ELSE 'Cloud Engineer' END AS title,
  CASE WHEN d.doc_id % 3 = 1 THEN 'Newer ' ELSE 'Drift ' END || CAST(d.doc_id AS STRING) AS company,
  'Pune' AS location,
  CASE WHEN d.doc_id % 3 = 2 AND k.step = 2 THEN '' ELSE 'v' || CAST(k.step AS STRING) END AS url,
  '' AS posted_at, '' AS employment_type, '' AS experience_level, '' AS work_mode, '' AS salary,
  CASE k.step WHEN 1 THEN d.source || ' and more' ELSE '' END AS description,
  CAST(NULL AS INT) AS is_reposted
FROM {documents} d CROSS JOIN (SELECT 0 AS step UNION ALL SELECT 1 UNION ALL SELECT 2) k
"""

# A description with elements inside elements, both quotes, and references of every kind.
NESTED_PAGES = """
SELECT g.page_id, '<p>before</p><div class=''x show-more-less-html__markup''><p>one</p><div>'
  || split_part(g.url, '/', 3) || '<div>deep</div></div><p>It&#x27;s &#55296;&#9999999; &lt &#65;</p>'
  || '</div><p>after</p>' AS html
FROM {pages} g
"""

# Cards of the board as a browser shows it: list items, with links of another class.
RENDERED_ITEMS = """
SELECT d.doc_id, CAST(floor(d.doc_id / 25) AS BIGINT) AS page,
  '<li><a class=''job-search-card__title-link'' href="https://jobs.example.com/jobs/view/'
  || CAST(d.doc_id AS STRING) || '?t=1"><b class="job-search-card__title"> Role '
  || CAST(d.doc_id AS STRING) || ' &amp; more</b></a><i class="x job-search-card__company-name">'
  || '<u>Acme </u> ' || d.source || '</i>' || CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE
     '<span class="job-search-card__location">Lima</span>' END
  || '<ul><li-note>1 day ago</li-note></ul></li>' AS card
FROM {documents} d
"""

CANDIDATES = f"""
SELECT c.c_custkey + 1 AS candidate_id,
  c.c_name AS candidate_name,
  CASE c.c_custkey % 6 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1.0e0 WHEN 2 THEN 2.0e0 WHEN 3 THEN 3.5e0
    WHEN 4 THEN 6.0e0 ELSE 10.0e0 END AS years_experience,
  {_pick('c.c_custkey', 'India', 'Berlin', '')} AS location,
  {_pick('c.c_custkey', 'Azure, AWS, Kubernetes, Terraform, Docker, Linux, Python',
         'Java, Spring Boot, PostgreSQL', 'Go, JavaScript, Node.js, , Git ', '',
         'prometheus, GRAFANA, Python 3')} AS skills_csv,
  {_pick('c.c_custkey', 'Azure, AWS', 'GCP', '', 'Microsoft Azure')} AS clouds_csv,
  {_pick('c.c_custkey', 'CKA', '')} AS certifications_csv,
  {_pick('c.c_custkey', 'B.Tech', '', 'BCA, MCA')} AS education_csv,
  c.c_mktsegment AS segment
FROM {{customer}} c
"""

RESUMES = f"""
SELECT d.doc_id AS resume_id,
  'cv_' || CAST(d.doc_id AS STRING) || '.txt' AS file_name,
  CASE WHEN d.doc_id % 12 = 0 THEN '' ELSE '  ' || chr(10) || 'Profile ' || CAST(d.doc_id AS STRING)
    || ' of ' || d.source || '  ' || chr(10) END
  || {_pick('d.doc_id', '4+ years of experience', 'Experience: 2.5 yrs', '3 years', '45 years',
            '0.4 yrs', '')} || chr(10)
  || {_pick('d.doc_id', 'AZ-104, CKA', 'CKAD certified', 'Terraform Associate', '',
            'CompTIA Security+, RHCE')} || chr(10)
  || {_pick('d.doc_id', 'B.Tech in CS', 'Master of Science', 'BCA, MCA', '')} || chr(10)
  || {_pick('d.doc_id', *SKILL_LINES)} || chr(10) || d.text AS resume_text
FROM {{documents}} d
"""

# Postings as rows with JSON text columns, null and '' included.
JSON_POSTINGS = f"""
SELECT d.doc_id + 1 AS id, {_pick('d.doc_id', *TITLES)} AS title, d.source AS company,
  CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '[]'
    ELSE '["Azure", "' || d.source || '"]' END AS matched_skills,
  CASE WHEN d.doc_id % 3 = 0 THEN '["Go"]' ELSE '[]' END AS missing_skills,
  CASE d.doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{{{{}}}}'
    ELSE '{{{{"skills": {{{{"score": ' || CAST(d.doc_id % 35 AS STRING)
    || '.5, "max": 35}}}}, "raw_ats": ' || CAST(d.doc_id % 100 AS STRING) || '.0}}}}' END
    AS score_breakdown
FROM {{documents}} d
"""

# Profile saves over time, one per event.
PROFILE_SAVES = """
SELECT e.user_id AS candidate_id, e.event_id, e.ts AS updated_at,
  CAST(CAST(e.event_id % 20 AS STRING) || '.5' AS DOUBLE) AS years_experience,
  CASE WHEN e.event_type = 'click' THEN NULL ELSE 'City ' || CAST(e.event_id % 7 AS STRING) END
    AS location,
  CASE WHEN e.event_type = 'view' THEN NULL ELSE e.event_type END AS summary
FROM {events} e
"""

STATUS_EVENTS = """
SELECT e.event_id, e.event_id % (SELECT count(*) FROM {documents}) + 1 AS id,
  CASE e.event_type WHEN 'view' THEN 'Saved' WHEN 'click' THEN 'saved'
    WHEN 'purchase' THEN 'APPLIED' WHEN 'signup' THEN 'new' ELSE 'ignored' END AS status,
  e.ts AS ts
FROM {events} e
"""

# Stored model replies, one per document: plain, fenced, broken or missing.
FIT_REPLIES = """
SELECT d.doc_id + 1 AS id,
  CASE WHEN d.doc_id % 5 = 4 THEN NULL WHEN d.doc_id % 5 = 3 THEN 'no answer'
    ELSE CASE WHEN d.doc_id % 2 = 0 THEN '```json' || chr(10) ELSE '  ' END
      || '{{"key_strengths": [' || CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE '"Azure", "' || d.source
      || '"' END || '], "critical_gaps": [' || CASE WHEN d.doc_id % 4 = 0 THEN '"Go"' ELSE '' END
      || '], "interview_tips": "' || CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE 'Show project '
      || CAST(d.doc_id AS STRING) END || '", "verdict": "PASS"}}'
      || CASE WHEN d.doc_id % 2 = 0 THEN chr(10) || '```' ELSE '' END END AS reply
FROM {documents} d
"""

PROFILE_REPLIES = """
SELECT d.doc_id AS resume_id,
  '{{"candidate_name": "Person ' || CAST(d.doc_id AS STRING) || '", "years_experience": '
  || CAST(d.doc_id % 9 AS STRING) || '.5, "skills": ['
  || CASE WHEN d.doc_id % 3 = 0 THEN '"Azure", "Perl"' ELSE '' END || ']'
  || CASE WHEN d.doc_id % 4 = 0 THEN ', "cloud_platforms": ["GCP"], "location": "Berlin"' ELSE '' END
  || '}}' AS reply
FROM {documents} d WHERE d.lang = 'en'
"""

# One search result page per 25 postings; every fifth page of a search repeats the page before,
# and a search has ten pages.
CARDS = """
SELECT d.doc_id, CAST(floor(d.doc_id / 250) AS BIGINT) AS search_id,
  CAST(floor(d.doc_id / 25) AS BIGINT) AS page,
  CASE WHEN CAST(floor(d.doc_id / 25) AS BIGINT) % 5 = 4 THEN d.doc_id - 25 ELSE d.doc_id END
    AS card_id, p.title, p.company, p.location, p.posted_at
FROM {documents} d JOIN ({postings}) p ON p.id = d.doc_id + 1
"""
CARD_HTML = """
SELECT search_id, page, doc_id,
  '<li><div class="base-card" ' || CASE WHEN card_id % 6 = 5 THEN ''
     ELSE 'data-entity-urn="urn:x:jobPosting:' || CAST(card_id AS STRING) || '"' END || '>'
  || CASE WHEN card_id % 8 = 7 AND card_id % 6 <> 5 THEN '' ELSE
     '<a class="base-card__full-link" href="https://jobs.example.com/jobs/view/'
     || CASE WHEN card_id % 30 = 29 THEN 'none' ELSE CAST(card_id AS STRING) END
     || '?trk=' || CAST(page AS STRING) || '">open</a>' END
  || CASE WHEN card_id % 10 = 3 THEN '' ELSE '<h3 class="base-search-card__title"> '
     || replace(replace(title, '&', '&amp;'), '<', '&lt;') || chr(10) || '</h3>' END
  || CASE WHEN card_id % 11 = 4 THEN '' ELSE
     '<h4 class="base-search-card__subtitle"><a href="/c"> ' || company || ' </a></h4>' END
  || CASE WHEN location = '' THEN '' ELSE
     '<span class="job-search-card__location">' || location || '</span>' END
  || '<time datetime="2024-01-01">' || posted_at || '</time></div></li>' AS card
FROM ({cards}) c
"""

# One posting page per given web page: its own article under the board's markup.
DETAIL_PAGES = f"""
SELECT g.page_id, g.url,
  CASE WHEN g.page_id % 3 = 0 THEN 'Unknown Title' WHEN g.page_id % 3 = 1 THEN '' ELSE
    'Cloud Engineer' END AS card_title,
  CASE WHEN g.page_id % 4 = 0 THEN 'Unknown Company' ELSE 'Acme' END AS card_company,
  'India' AS card_location,
  '<html><body><section><h1 class="topcard__title"> '
  || regexp_extract(g.html, '<h1>([^<]*)</h1>', 1) || ' </h1>'
  || '<span class="topcard__flavor"><a href="/c"> Globex &amp; Co ' || CAST(g.page_id AS STRING)
  || '</a></span><span class="topcard__flavor topcard__flavor--bullet">'
  || {_pick('g.page_id', ' Pune, India ', '27 Applicants', 'Remote', 'Reposted 2 days ago')}
  || '</span>'
  || CASE WHEN g.page_id % 5 = 0 THEN '<span class="topcard__flavor--salary"> $'
     || CAST(90 + g.page_id AS STRING) || ',000 </span>' ELSE '' END
  || '<div class="show-more-less-html__markup">'
  || {_pick('g.page_id', 'Hybrid role. ', 'Pay: INR 12,00,000 - 15,00,000 year<br>', 'Remote. ',
            '', 'Work onsite. ₹ 500 hr<li>one</li>', 'Paid USD 100k ')}
  || regexp_extract(g.html, '<article>(.*)</article>', 1) || '</div></section><ul>'
  || CASE WHEN g.page_id % 6 = 0 THEN '' ELSE '<li class="description__job-criteria-item">'
     || '<h3 class="description__job-criteria-subheader"> Seniority level </h3>'
     || '<span class="description__job-criteria-text"> '
     || {_pick('g.page_id', 'Entry level', 'Director', 'Mid-Senior level')}
     || ' </span></li>' END
  || '<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">'
  || 'Employment type</h3><span class="description__job-criteria-text">'
  || {_pick('g.page_id', 'Full-time', 'Contract')} || '</span></li></ul></body></html>' AS html
FROM {{pages}} g
"""

TABLES = ("documents", "labels", "customer", "events", "pages")


def dialect(sql: str, engine: str) -> str:
    """Replaces [[name|argument]] by the engine's spelling."""
    out = sql
    while "[[" in out:
        start = out.index("[[")
        end = out.index("]]", start)
        name, arg = out[start + 2:end].split("|", 1)
        out = out[:start] + DIALECTS[engine][name] % arg + out[end + 2:]
    return out


# Tables whose rows are long texts, with their unique key.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def spread(table: DataFrame, key: str) -> DataFrame:
    """A scan that yields fewer tasks than the session has cores is spread over them by its unique
    key, because mining its texts costs far more than moving them. A table of many files or row
    groups keeps its scan tasks and is not shuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


class Tables:
    """The given tables and the views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table, TEXT_TABLES[name]) if name in TEXT_TABLES else table

    def view(self, sql: str, **inputs: DataFrame) -> DataFrame:
        given = {n: self.raw(n) for n in TABLES if "{" + n + "}" in sql}
        return self.spark.sql(dialect(sql, "spark"), **given, **inputs)

    def postings(self) -> DataFrame:
        return self.view(POSTINGS)

    def incoming(self) -> DataFrame:
        return self.view(INCOMING)

    def drift_stored(self) -> DataFrame:
        return self.view(DRIFT_STORED)

    def drift_batch(self) -> DataFrame:
        return self.view(DRIFT_BATCH)

    def nested_pages(self) -> DataFrame:
        return self.view(NESTED_PAGES)

    def candidate_forms(self) -> DataFrame:
        return self.view(CANDIDATES)

    def resumes(self) -> DataFrame:
        return self.view(RESUMES)

    def status_events(self) -> DataFrame:
        return self.view(STATUS_EVENTS)

    def json_postings(self, only: str | None = None) -> DataFrame:
        """`only`: a condition on the stored columns (d.doc_id, ...), which reaches the scan."""
        return self.view(JSON_POSTINGS + (f"WHERE {only}" if only else ""))

    def profile_saves(self) -> DataFrame:
        return self.view(PROFILE_SAVES)

    def fit_replies(self) -> DataFrame:
        return self.view(FIT_REPLIES)

    def profile_replies(self) -> DataFrame:
        return self.view(PROFILE_REPLIES)

    def list_pages(self) -> DataFrame:
        """(search_id, page, html). A page holds 25 cards, so its group is bounded."""
        cards = self.view(CARD_HTML.replace("{cards}", CARDS.replace("{postings}", POSTINGS)))
        return self.spark.sql("""
            SELECT search_id, page, concat('<ul>', array_join(transform(
              sort_array(collect_list(struct(doc_id, card))), c -> c.card), ''), '</ul>') AS html
            FROM {cards} GROUP BY search_id, page""", cards=cards)

    def rendered_pages(self) -> DataFrame:
        """(search_id, page, html) as a browser shows it; a page holds 25 cards."""
        return self.spark.sql("""
            SELECT CAST(0 AS BIGINT) AS search_id, page, concat('<main><ul class="jobs-search__results-list">',
              array_join(transform(sort_array(collect_list(struct(doc_id, card))), c -> c.card), ''),
              '</ul></main>') AS html
            FROM {items} GROUP BY page""", items=self.view(RENDERED_ITEMS))

    def detail_pages(self) -> DataFrame:
        return self.view(DETAIL_PAGES)
