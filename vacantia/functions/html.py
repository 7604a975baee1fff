"""Fields of stored board pages.

A page crosses to Python once, in Arrow batches, and is read there once (`markup`); what comes back is
one struct of its fields. Class names are parameters of a `Template`, so another board is another
template. `BOARD` holds the markup the engine knows.
"""

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

from .. import vocab
from . import text as X
from .markup import Markup, attributes, with_class

_REPOSTED = r"(?i)(?<![\p{L}\p{N}_])repost(ed)?(?![\p{L}\p{N}_])"
_LINE_ENDS = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_JOB_URN = re.compile(r"jobPosting:([0-9]+)")


@dataclass(frozen=True)
class Template:
    """Class names of a board's markup (fixed values of that board)."""

    site: str = "https://jobs.example.com"
    card: str = "base-card"
    card_links: tuple = ("base-card__full-link",)
    results: str | None = None  # list whose items are the cards, where a page has it
    card_title: tuple = ("base-search-card__title", "job-search-card__title")
    card_company: tuple = ("base-search-card__subtitle", "job-search-card__company-name")
    card_location: tuple = ("job-search-card__location",)
    title: tuple = ("topcard__title", "top-card-layout__title")
    company: tuple = ("topcard__flavor", "top-card-layout__first-subline")
    location: tuple = ("topcard__flavor--bullet", "top-card-layout__second-subline")
    posted: tuple = ("topcard__flavor--bullet", "top-card-layout__second-subline",
                     "posted-time-ago__text")
    description: tuple = ("show-more-less-html__markup", "description__text")
    criteria: str = "description__job-criteria-item"
    criteria_name: str = "description__job-criteria-subheader"
    criteria_value: str = "description__job-criteria-text"
    salary: tuple = ("main-job-card__salary-info", "topcard__flavor--salary")


BOARD = Template()
# The same board as a browser shows it (fixed values of that board).
RENDERED = Template(
    card_links=("base-card__full-link", "job-search-card__title-link"),
    results="jobs-search__results-list",
    description=("show-more-less-html__markup", "description__text", "jobs-description__content"))


def _per_page(read, kind: str, html: Column) -> Column:
    """read(Markup) of each page, null for a null one."""
    def step(pages: pd.Series):
        rows = [None if page is None else read(Markup(page)) for page in pages]
        if not kind.startswith("struct"):
            return pd.Series(rows, dtype="object")
        names = [field.split(" ")[0].split(":")[0] for field in kind[len("struct<"):-1].split(",")]
        return pd.DataFrame({n: pd.Series([None if r is None else r[i] for r in rows], dtype="object")
                             for i, n in enumerate(names)})

    step.__annotations__ = {"pages": pd.Series, "return": pd.DataFrame if kind.startswith("struct") else pd.Series}
    return F.pandas_udf(step, kind)(html)


def field(html: Column, names) -> Column:
    """Text of the first element with one of the classes; null when there is none."""
    return _per_page(lambda m: m.tight(m.first(names)), "string", html)


def description(html: Column, template: Template = BOARD) -> Column:
    """Description as paragraphs; null when there is none."""
    return _per_page(lambda m: m.readable(m.first(template.description)), "string", html)


def _criteria(page: Markup, template: Template) -> list[tuple[str, str]]:
    """(header in lower case, value) of the criteria items that have a value."""
    out = []
    for item in page.elements(with_class([template.criteria])):
        name = page.tight(page.first([template.criteria_name], item))
        value = page.tight(page.first([template.criteria_value], item))
        if name is not None and value is not None:
            out.append((name.lower(), value))
    return out


def _last(items: list[tuple[str, str]], word: str, without: str = "") -> str:
    """Value of the last item whose header has `word`; '' when there is none."""
    return next((value for name, value in reversed(items)
                 if word in name and not (without and without in name)), "")


def criteria(html: Column, word: str, template: Template = BOARD, without: str = "") -> Column:
    return _per_page(lambda m: _last(_criteria(m, template), word, without), "string", html)


DETAIL = ("struct<title string,company string,location string,description string,experience_level string,"
          "employment_type string,salary string,posted string>")


def detail(html: Column, template: Template = BOARD) -> Column:
    """All fields of a posting page in one reading."""
    def read(m: Markup):
        items, posted = _criteria(m, template), m.first(template.posted)
        return (m.tight(m.first(template.title)), m.tight(m.first(template.company)),
                m.tight(m.first(template.location)), m.readable(m.first(template.description)),
                _last(items, "seniority"), _last(items, "employment", "seniority"),
                m.tight(m.first(template.salary)), None if posted is None else m.loose(posted))

    return _per_page(read, DETAIL, html)


CARD = ("array<struct<posting_id:string,href:string,title:string,company:string,location:string,"
        "posted_at:string,text:string>>")


def cards(html: Column, template: Template = BOARD) -> Column:
    """All cards of a list page in one reading, those without an id, too."""
    def starts(m: Markup) -> list[int]:
        listed = m.first([template.results]) if template.results else None
        if listed is not None:
            found = m.elements(lambda name, _: name == "li", listed)
        else:
            is_card = with_class([template.card])
            found = m.elements(lambda name, rest: name == "div" and (
                is_card(name, rest) or "data-entity-urn" in rest.lower()))
        out, stop = [], -1
        for k in found:  # what is inside a card is not another one
            if k >= stop:
                out.append(k)
                stop = m.end(k)
        return out

    def read(m: Markup):
        return [_card(m, k, template) for k in starts(m)]

    return _per_page(read, CARD, html)


def _card(m: Markup, card: int, template: Template) -> dict:
    is_link = with_class(template.card_links)
    link = next(m.elements(lambda name, rest: name == "a" and (
        is_link(name, rest) or "/jobs/view/" in attributes(rest).get("href", "")), card), None)
    href = None if link is None else attributes(m.tags[link][4]).get("href")
    tagged = [card, *m.elements(lambda _, rest: "data-entity-urn" in rest.lower(), card)]
    urns = (_JOB_URN.search(attributes(m.tags[k][4]).get("data-entity-urn", "")) for k in tagged)
    urn = next((found.group(1) for found in urns if found), None)
    view = re.search("/view/([0-9]+)", href or "")
    time = next(m.elements(lambda name, _: name == "time", card), None)
    return {"posting_id": urn or (view.group(1) if view else None), "href": href,
            "title": m.tight(m.first(template.card_title, card)),
            "company": m.tight(m.first(template.card_company, card)),
            "location": m.tight(m.first(template.card_location, card)),
            "posted_at": m.tight(time) or "", "text": m.loose(card)}


def lines(c: Column) -> Column:
    """Stripped, non-blank lines."""
    return F.filter(F.transform(F.split(c, _LINE_ENDS), X.strip), lambda line: line != "")


def says_reposted(c: Column) -> Column:
    return F.coalesce(c.rlike(_REPOSTED), F.lit(False))


def page_reposted(html: Column, posted: Column) -> Column:
    """Repost word in the posted line or in the first 4000 characters of the page."""
    return says_reposted(posted) | says_reposted(F.substring(html, 1, 4000))


def work_mode(title: Column, location: Column, description: Column) -> Column:
    low = F.lower(F.concat_ws(" ", title, location, description))
    return (F.when(low.contains("remote"), "Remote").when(low.contains("hybrid"), "Hybrid")
            .otherwise("On-site"))


def salary(badge: Column, description: Column) -> Column:
    """The badge, else the first amount in the description, else ''."""
    found = X.strip(F.regexp_extract(description, vocab.SALARY, 0))
    return F.coalesce(badge, found, F.lit(""))


def known_or(card_value: Column, page_value: Column, unknown: str) -> Column:
    """The card's value unless it is missing or unknown and the page has one."""
    missing = X.either_empty(card_value) | (card_value == unknown)
    return F.when(missing & page_value.isNotNull(), page_value).otherwise(card_value)


def pinned_location(card_value: Column, page_value: Column) -> Column:
    usable = (page_value != "") & ~F.lower(page_value).contains("applicant")
    return F.when(usable, page_value).otherwise(card_value)


def canonical_url(href: Column, job_id: Column, template: Template = BOARD) -> Column:
    """Link without its query, else built from the id."""
    built = F.concat(F.lit(template.site + "/jobs/view/"), job_id, F.lit("/"))
    return F.coalesce(F.substring_index(href, "?", 1), built)
