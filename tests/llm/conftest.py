"""Documents that are awkward on purpose, and the small given tables."""

import re

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, "
          "kept int, n long, ids string, _text string")

ODD = [None, "", " ", "one", "one two", "one two three", "the and of the and of the and",
       "A.b+c@mail.example.com and 4111 1111 1111 1111, call +1 (555) 123-4567 at 10.0.0.255",
       "x" * 5000, "\n\n\n", "line here\nline here\n \nline here", "ÄÖ Ünï 日本 ²", "12 34 !!",
       "a  b \n c\td", "one two three", "<|endoftext|> end"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", "s", None, "x", i, 1, "y", "z") for i, t in enumerate(ODD)]
    rows.append((None, "no id here", "de", None, None, None, None, None, None, None))
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def words(text, lower=False):
    if lower:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x20\x09-\x0D]+", text or "")
