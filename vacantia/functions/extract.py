"""Requirement mining from posting text."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from . import text as X


def full_text(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"),
                    F.coalesce(description, F.lit("")))


def skills(lowered: Column) -> Column:
    return X.tokens_found(lowered, vocab.SKILL_TERMS)


def clouds(lowered: Column, strict: bool = False) -> Column:
    """Clouds mentioned. Aliases are plain substrings ('weeks' contains 'eks'); `strict` asks
    for whole tokens instead."""
    def hit(alias):
        return X.has_token(lowered, alias) if strict else lowered.contains(alias)

    return F.array_compact(F.array(*[
        F.when(X.any_of(hit, aliases), F.lit(label))
        for label, aliases in vocab.CLOUD_ALIASES.items()]))


# Every match of every pattern holds a number, an optional sign and a year word in this form.
_YEARS_GUARD = X.any_spaced(r"\d\s*(?:-|to|\+)?\s*y(?:ea)?r")


def first_piece(lowered: Column, pattern: str) -> Column:
    """First match of a pattern, '' when there is none. The long text is searched once; groups
    are then read from this short piece."""
    return F.regexp_extract(lowered, X.any_spaced(pattern), 0)


def piece_number(piece: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(piece, X.any_spaced(pattern), group).try_cast("double")


def _years_of(lowered: Column, pattern: str, ranged: bool, low: float) -> Column:
    """{lo, hi, shown} of a pattern's first match, null when there is none or it is out of
    range."""
    def limits(piece):
        hi = piece_number(piece, pattern, 2) if ranged else F.lit(None).cast("double")
        return F.struct(piece_number(piece, pattern, 1).alias("lo"), hi.alias("hi"))

    def kept(found):
        lo, hi = found["lo"], found["hi"]
        upper = F.when(hi.isNotNull() & (hi != 0), F.concat(F.lit("-"), hi.cast("string")))
        shown = F.concat(lo.cast("string"), F.coalesce(upper, F.lit("+")), F.lit(" years"))
        return F.when(lo.between(low, vocab.REQUIRED_YEARS_MAX),
                      F.struct(lo.alias("lo"), hi.alias("hi"), shown.alias("shown")))

    return X.let(X.let(first_piece(lowered, pattern), limits), kept)


def required_years(lowered: Column) -> Column:
    """First pattern whose first match is in range; texts without a number before a year word
    skip the patterns."""
    found = F.coalesce(*[_years_of(lowered, *rule) for rule in vocab.REQUIRED_YEARS])
    return F.when(lowered.rlike(_YEARS_GUARD), found)


def _ladder(c: Column, rungs) -> Column:
    return F.coalesce(*[F.when(X.contains_any(c, parts), F.lit(name)) for name, parts in rungs])


def _title_ladder_strict(title_low: Column, rungs) -> Column:
    return F.coalesce(*[
        F.when(X.any_of(lambda p: X.has_token(title_low, p.strip()), parts), F.lit(name))
        for name, parts in rungs])


def seniority(title: Column, level: Column, strict: bool = False) -> Column:
    """Seniority from the title, else from the stated level. Title tests are substrings
    ('VPN Engineer' contains 'vp'); `strict` asks for whole tokens instead."""
    title_low = F.lower(F.coalesce(title, F.lit("")))
    level_low = F.lower(F.coalesce(level, F.lit("")))
    from_title = (_title_ladder_strict if strict else _ladder)(title_low, vocab.SENIORITY_TITLE)
    return F.coalesce(from_title, _ladder(level_low, vocab.SENIORITY_LEVEL),
                      F.lit(vocab.SENIORITY_DEFAULT))


def inferred_years(level: Column) -> Column:
    return F.try_element_at(X.literal_map(vocab.YEARS_BY_SENIORITY, "double"), level)


def term_count(lowered: Column, terms) -> Column:
    """Sum of non-overlapping occurrences. A count is the length lost when the term is removed,
    and is only computed for texts that contain the term."""
    counts = [
        F.when(lowered.contains(t),
               ((F.length(lowered) - F.length(F.replace(lowered, F.lit(t), F.lit(""))))
                / len(t)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        for t in terms]
    return reduce(lambda a, b: a + b, counts)


def domain(title: Column, lowered: Column) -> Column:
    by_count = F.when(
        term_count(lowered, vocab.CLOUD_DOMAIN_TERMS)
        >= term_count(lowered, vocab.SOFTWARE_DOMAIN_TERMS), F.lit("cloud_devops")
    ).otherwise(F.lit("software_engineering"))
    return F.coalesce(_ladder(F.lower(F.coalesce(title, F.lit(""))), vocab.DOMAIN_TITLE), by_count)


def degree_required(lowered: Column) -> Column:
    return X.contains_any(lowered, vocab.DEGREE_HINTS)


def with_requirements(postings: DataFrame, strict: bool = False) -> DataFrame:
    """Adds struct column `req`. Narrow: no shuffle. The lower-cased text is a column of its own
    stage, so the many tests on it do not recompute it."""
    staged = postings.withColumns({
        "_low": F.lower(full_text(F.col("title"), F.col("description"))),
        "_level": seniority(F.col("title"), F.col("experience_level"), strict),
    })
    staged = staged.withColumn("_years", required_years(F.col("_low")))
    low, years, level = F.col("_low"), F.col("_years"), F.col("_level")
    guess = inferred_years(level)
    guessed = years.isNull() & guess.isNotNull()
    req = F.struct(
        skills(low).alias("skills"),
        clouds(low, strict).alias("clouds"),
        F.coalesce(years["lo"], guess).alias("min_years"),
        years["hi"].alias("max_years"),
        F.when(years.isNotNull(), years["shown"])
        .when(guessed, F.concat(guess.cast("string"), F.lit("+ years (inferred from "), level,
                                F.lit(")")))
        .otherwise(F.lit("")).alias("years_text"),
        guessed.alias("years_inferred"),
        level.alias("seniority"),
        domain(F.col("title"), low).alias("domain"),
        degree_required(low).alias("degree_required"),
    )
    return staged.withColumn("req", X.fenced(req)).drop("_low", "_level", "_years")
