"""Profile fields from resume text."""

from pyspark.sql import Column, functions as F

from .. import vocab
from . import text as X
from .extract import first_piece, piece_number
from .html import lines


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 when valid, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")),
                      F.decode(content, "ISO-8859-1"))


def years(lowered: Column) -> Column:
    low, high = vocab.RESUME_YEARS_RANGE

    def value(pattern):
        number = piece_number(first_piece(lowered, pattern), pattern, 1)
        return X.let(number, lambda n: F.when(n.between(low, high), n))

    return F.coalesce(*[value(p) for p in vocab.RESUME_YEARS], F.lit(vocab.RESUME_YEARS_DEFAULT))


def skills(lowered: Column) -> Column:
    return X.tokens_found(lowered, vocab.SKILL_TERMS)


def clouds(lowered: Column) -> Column:
    return X.substrings_found(lowered, vocab.RESUME_CLOUDS)


def certifications(lowered: Column) -> Column:
    return X.tokens_found(lowered, vocab.CERTIFICATIONS)


def education(lowered: Column) -> Column:
    return X.substrings_found(lowered, vocab.DEGREES)


def summary(c: Column) -> Column:
    return F.coalesce(F.get(lines(c), F.lit(0)), F.lit(vocab.EMPTY_RESUME_SUMMARY))


def file_stem(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
