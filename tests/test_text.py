"""Column rules on small inputs."""

import pytest
from pyspark.sql import functions as F

from vacantia import vocab
from vacantia.functions import extract as E
from vacantia.functions import html as H
from vacantia.functions import resume as R
from vacantia.functions import scoring as S
from vacantia.functions import text as X
from vacantia.functions.markup import Markup
from vacantia.operators import feed, folds, pages, replies


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + schema)
    return [r[0] for r in df.select(column.alias("v"), "i").orderBy("i").collect()]


def test_required_years(spark):
    texts = {"Experience: 6-10 Yrs": (6.0, 10.0), "Experience: 3 to 5 years": (3.0, 5.0),
             "Minimum 4 years": (4.0, None), "4+ years of work experience": (4.0, None),
             "experience 40 years": None, "at  least\n2 yrs": (2.0, None), "0.5 years": None,
             "3-5 years of experience": (5.0, None), "6 - 8 years": (6.0, 8.0), "no number": None,
             "Relevant experience: 2+ yrs": (2.0, None)}
    got = values(spark, [(t,) for t in texts], "t string", E.required_years(F.lower("t")))
    assert [(g.lo, g.hi) if g else None for g in got] == list(texts.values())


def test_keys(spark):
    got = values(spark, [("Acme Technologies Pvt Ltd", "Platform Engineer [IRC12345]"),
                         ("TechCorp", "SRE (Night) walk-in drive"), ("", "x"), ("India", "x")],
                 "c string, t string", X.dedup_key(F.col("c"), F.col("t")))
    assert got == ["acme:platformengineer", "techcorp:sre", "", ""]


@pytest.mark.parametrize("a, b, want", [
    ("Hyderabad, India", "Bengaluru, Karnataka, India", "Hyderabad, India / Bengaluru"),
    ("Hyderabad, India", "hyderabad", "Hyderabad, India"), ("", "Pune", "Pune"),
    ("Pune", None, "Pune"), (None, None, ""), ("New York", "York, UK", "New York"),
    (" , ", "Oslo", " ,  / Oslo")])
def test_merge_locations(spark, a, b, want):
    assert values(spark, [(a, b)], "a string, b string",
                  X.merge_locations(F.col("a"), F.col("b"))) == [want]


def test_tokens(spark):
    got = values(spark, [("gitlab ci/cd, c++ and node.js",), ("éazure azures go_ golang.",),
                         ("(go) git java-script",), ("",)], "t string",
                 E.skills(F.lower("t")))
    assert got == [["CI/CD", "GitLab CI", "Node.js", "C++"], ["Golang"], ["Go", "Git", "Java"], []]
    assert X.shadowed(vocab.SKILL_TERMS) == [] and X.shadowed(["go", "go lang"]) != []


def test_one_scan_equals_one_test_per_term(spark):
    texts = [(f"{a}{gap}{b} {a}x x{b}",) for a in vocab.SKILL_TERMS
             for b in vocab.SKILL_TERMS[::7] for gap in ("", " ", "/", "é")]
    low = F.lower("t")
    each = F.array_compact(F.array(*[F.when(X.has_token(low, t), F.lit(t))
                                     for t in vocab.SKILL_TERMS]))
    assert values(spark, texts, "t string", E.skills(low)) == values(
        spark, texts, "t string", each)


def test_clouds_strict(spark):
    rows = [("notice of 6 weeks",), ("AKS and S3",)]
    assert values(spark, rows, "t string", E.clouds(F.lower("t"))) == [["AWS"], ["AZURE", "AWS"]]
    assert values(spark, rows, "t string", E.clouds(F.lower("t"), strict=True)) == [
        [], ["AZURE", "AWS"]]


def test_seniority(spark):
    rows = [("VPN Engineer", None), ("Engineer", "Mid-Senior level"), ("Internal Tools", "x"),
            ("Engineer", None)]
    level = E.seniority(F.col("t"), F.col("l"))
    assert values(spark, rows, "t string, l string", level) == ["MANAGER", "SENIOR", "ENTRY",
                                                                "STANDARD"]
    strict = E.seniority(F.col("t"), F.col("l"), strict=True)
    assert values(spark, rows, "t string, l string", strict) == ["STANDARD", "SENIOR", "STANDARD",
                                                                 "STANDARD"]


def test_half_even(spark):
    assert spark.range(1).select(S._share(F.lit(3), F.lit(4), 35.0)).first()[0] == 26.2


def test_html(spark):
    page = ('<h1 class="topcard__title"> A &amp;amp; B&nbsp;</h1><div class="x description__text">'
            'One &lt;b&gt;<br>two<p>three</p> <ul><li>four&#8364;</li></ul></div>'
            '<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">'
            ' Seniority level</h3><span class="description__job-criteria-text"> Entry </span></li>')
    got = spark.createDataFrame([(page,)], "html string").select(
        H.field(F.col("html"), H.BOARD.title), H.description(F.col("html")),
        H.criteria(F.col("html"), "seniority"), H.criteria(F.col("html"), "employment"),
        H.field(F.col("html"), H.BOARD.company)).first()
    assert tuple(got) == ("A &amp; B", "One <b>\n\ntwothree\n\nfour€", "Entry", "", None)


@pytest.mark.parametrize("text, decoded", [
    ("&#38;amp;", "&amp;"), ("&#128;", "€"), ("&notit;", "¬it;"), ("&amp;lt; &lt", "&lt; <"),
    ("&#x41;&#65&#0;", "AA\ufffd"), ("&am &unknown; &", "&am &unknown; &")])
def test_references_are_decoded_once(text, decoded):
    page = Markup(f"<p class='x'>{text}</p>")
    assert page.tight(page.first(["x"])) == decoded


@pytest.mark.parametrize("page, text", [
    ("<div class='a x'>1<div>2<DIV>3</DIV></div>4</div>5", "1234"), ('<b CLASS=x>1<br/>2</b>3', "12"),
    ('<a title="a > b" class="x">t</a>u', "t"), ("<p title='open class=\"x\">t</p>u", "t"),
    ('<p class="x">1<!-- <p class="x"> -->2<script>"</p>"</script>3</p>', "123"),
    ('<i class="xx">no</i><i class="y x z">yes', "yes"), ('<img class="x">t', ""), ("<p>x</p>", None)])
def test_elements(page, text):
    read = Markup(page)
    assert read.tight(read.first(["x"])) == text


def test_cards_with_either_quote(spark):
    """An id in single quotes or none is an id; the words of the next card are not this one's."""
    page = ("<div class='base-card' data-entity-urn='u:jobPosting:1'><h3 class='base-search-card__title'>A</h3></div>"
            "<div class=base-card><a class='base-card__full-link' href='https://x/jobs/view/2?q=1'>B</a></div> reposted"
            "<div class=\"base-card\" data-entity-urn=u:jobPosting:3><time>1 day ago</time></div><div class='base-card'>no id</div>")
    df = spark.createDataFrame([(1, 0, page), (1, 1, None), (1, 2, "")], "search_id long, page long, html string")
    got = pages.cards(df).orderBy("pos").collect()
    assert [(r.pos, r.posting_id, r.title, r.url, r.posted_at, r.is_reposted) for r in got] == [
        (0, "1", "A", "https://jobs.example.com/jobs/view/1/", "", 0),
        (1, "2", "Unknown Title", "https://x/jobs/view/2", "", 0),
        (2, "3", "Unknown Title", "https://jobs.example.com/jobs/view/3/", "1 day ago", 0)]


def test_criteria_of_nested_items(spark):
    page = ('<li class="description__job-criteria-item"><ul><li>x</li></ul><h3 class="description__job-criteria-subheader">'
            'Employment type</h3><b class="description__job-criteria-text">Contract</b></li>')
    df = spark.createDataFrame([(page,), (None,)], "html string")
    assert [r[0] for r in df.select(H.criteria(F.col("html"), "employment")).collect()] == ["Contract", None]


def test_pages_to_postings(spark):
    def card(i, title):
        return (f'<li><div class="base-card" data-entity-urn="u:jobPosting:{i}"><div><h3 class='
                f'"base-search-card__title">{title}</h3></div></div></li>')

    listed = spark.createDataFrame([
        (1, 0, "<ul>" + card(7, "A") + card(8, "B") + "</ul>"), (1, 1, card(7, "A again")),
        (1, 2, card(9, "never reached")), (2, 0, card(7, "other search"))],
        "search_id long, page long, html string")
    detail = spark.createDataFrame([(
        "7", '<span class="topcard__flavor--bullet">Pune</span><div class="description__text">'
        "Remote job, $100k</div>")], "posting_id string, html string")
    rows = pages.postings_from_pages(listed, detail).orderBy("search_id", "posting_id").collect()
    assert [(r.search_id, r.posting_id, r.title, r.location, r.work_mode, r.salary) for r in rows] == [
        (1, "7", "A", "Pune", "Remote", "$100k"), (1, "8", "B", "India", "On-site", ""),
        (2, "7", "other search", "Pune", "Remote", "$100k")]


def test_resume_files(spark, tmp_path):
    from vacantia.operators.profiles import from_resumes
    from vacantia.sources.tables import read_resume_files

    (tmp_path / "ann.txt").write_bytes("Résumé of Ann\n3 years experience, Azure".encode("utf-8"))
    (tmp_path / "bob.txt").write_bytes("Café\n45 years".encode("latin-1"))
    (tmp_path / "blank.txt").write_bytes(b" \n ")
    rows = from_resumes(read_resume_files(spark, str(tmp_path))).orderBy("candidate_name").collect()
    assert [(r.candidate_name, r.summary, r.years_experience, r.skills) for r in rows] == [
        ("ann", "Résumé of Ann", 3.0, ["Azure"]), ("bob", "Café", 1.0, [])]


def test_replies(spark):
    rows = [("```json\n{\"interview_tips\": \"x\"}\n```",), (" {\"key_strengths\": [\"a\", \"b\"]} ",),
            ("sorry",), (None,)]
    df = replies.parse(spark.createDataFrame(rows, "reply string"))
    got = [r[0] for r in df.select(replies.analysis(F.col("answer"))).collect()]
    assert got == ["**Action Tip:** x", "**Strengths:** a, b", "", ""]


def test_small_rules(spark):
    assert feed.roles_to_search([], None) == ["Cloud Engineer"]
    assert feed.pages_of(0, 25) == 1 and feed.pages_of(26, 25) == 2
    ranks = values(spark, [("applied",), ("odd",), ("new",)], "s string",
                   folds.status_rank(F.col("s")))
    assert ranks == [5, 1, 1]
    assert values(spark, [("a, ,b ,",), (None,)], "c string", X.csv_items(F.col("c"))) == [
        ["a", "b"], []]
    assert values(spark, [("/x/cv.v2.txt",), (".env",)], "f string", R.file_stem(F.col("f"))) == [
        "cv.v2", ".env"]
