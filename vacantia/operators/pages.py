"""Stored board pages -> cards -> posting rows."""

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import html as H


def cards(list_pages: DataFrame, search_location: str = "India",
          template: H.Template = H.BOARD) -> DataFrame:
    """One row per card with an id: (search_id, page, pos, posting_id, title, ...). A page is read
    once."""
    cut = list_pages.select("search_id", "page", F.posexplode(H.cards(F.col("html"), template)).alias("pos", "card"))
    card, job = F.col("card"), F.col("card.posting_id")
    return cut.where(job.isNotNull()).select(
        "search_id", "page", F.col("pos").cast("bigint").alias("pos"), "card.posting_id",
        F.coalesce(card["title"], F.lit(vocab.UNKNOWN_TITLE)).alias("title"),
        F.coalesce(card["company"], F.lit(vocab.UNKNOWN_COMPANY)).alias("company"),
        F.coalesce(card["location"], F.lit(search_location)).alias("location"),
        H.canonical_url(card["href"], job, template).alias("url"), "card.posted_at",
        (H.says_reposted(card["text"]) | F.lower(card["posted_at"]).contains("reposted"))
        .cast("int").alias("is_reposted"),
    )


def first_seen(all_cards: DataFrame) -> DataFrame:
    """First card of each posting id of a search, in page order: an aggregate, so repeats are
    dropped before the shuffle."""
    rest = [c for c in all_cards.columns if c not in ("search_id", "posting_id", "page", "pos")]
    return (all_cards.groupBy("search_id", "posting_id")
            .agg(F.min(F.struct("page", "pos", *rest)).alias("card"))
            .select("search_id", "posting_id", "card.*"))


def page_yield(all_cards: DataFrame, list_pages: DataFrame) -> DataFrame:
    """New ids per page, and whether the search got that far: it stops after the first page that
    adds none, and that page adds no rows."""
    new = first_seen(all_cards).groupBy("search_id", "page").agg(F.count("*").alias("new_cards"))
    counted = (list_pages.select("search_id", "page").join(new, ["search_id", "page"], "left")
               .withColumn("new_cards", F.coalesce("new_cards", F.lit(0).cast("bigint"))))
    stop = counted.groupBy("search_id").agg(
        F.min(F.when(F.col("new_cards") == 0, F.col("page"))).alias("stop_page"))
    return counted.join(stop, "search_id").select(
        "search_id", "page", "new_cards",
        F.coalesce(F.col("page") < F.col("stop_page"), F.lit(True)).alias("kept"))


def search_cards(list_pages: DataFrame, search_location: str = "India",
                 template: H.Template = H.BOARD) -> DataFrame:
    """Cards a search returns: first seen per id, up to the page that added nothing."""
    found = cards(list_pages, search_location, template)
    kept = page_yield(found, list_pages).where("kept").select("search_id", "page")
    return first_seen(found).join(kept, ["search_id", "page"], "left_semi")


def details(pages: DataFrame, template: H.Template = H.BOARD) -> DataFrame:
    """Posting page next to its card's fields (card_title, card_company, card_location; card_reposted
    when known) -> posting fields. Narrow."""
    html, page = F.col("html"), F.col("_page")
    if "card_reposted" not in pages.columns:
        pages = pages.withColumn("card_reposted", F.lit(0))
    staged = pages.withColumn("_page", H.detail(html, template)).withColumns({
        "title": H.known_or(F.col("card_title"), page["title"], vocab.UNKNOWN_TITLE),
        "company": H.known_or(F.col("card_company"), page["company"], vocab.UNKNOWN_COMPANY),
        "location": H.pinned_location(F.col("card_location"), page["location"]),
        "description": F.coalesce(page["description"], F.lit("")),
        "experience_level": F.coalesce(page["experience_level"], F.lit("")),
        "employment_type": F.coalesce(page["employment_type"], F.lit("")),
        "is_reposted": ((F.col("card_reposted") != 0) | H.page_reposted(html, page["posted"])).cast("int"),
    })
    return staged.withColumns({
        "work_mode": H.work_mode(F.col("title"), F.col("location"), F.col("description")),
        "salary": H.salary(page["salary"], F.col("description")),
    }).drop("html", "_page", "card_title", "card_company", "card_location", "card_reposted")


def postings_from_pages(list_pages: DataFrame, detail_pages: DataFrame,
                        search_location: str = "India",
                        template: H.Template = H.BOARD) -> DataFrame:
    """List pages and stored posting pages (posting_id, html) -> one posting row per card. A card
    without a stored page keeps its own fields and an empty description."""
    found = search_cards(list_pages, search_location, template)
    joined = found.join(detail_pages.select("posting_id", "html"), "posting_id", "left")
    renamed = joined.withColumnsRenamed({"title": "card_title", "company": "card_company",
                                         "location": "card_location",
                                         "is_reposted": "card_reposted"})
    return details(renamed, template).drop("pos")
