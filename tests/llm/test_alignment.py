"""Alignment of two tokenizers against a plain walk over whole texts with the public libraries."""

import collections
import hashlib
import re

import numpy as np
import pytest

from tests.llm.conftest import ODD
from vacantia.llm import alignment as A
from vacantia.llm.packing import vocabulary

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    return first, second


def _byte_of_letter():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _walk(text, libraries):
    """(ids, ids, groups, links), or None."""
    if not text:
        return None
    first, second = libraries
    letters = _byte_of_letter()
    a = first.encode(" " + text, add_special_tokens=False).ids
    raw_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
    b = second.encode(text)
    raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else
             p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
    whole = (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return None
    stops_a, stops_b = np.cumsum([*map(len, raw_a)]), np.cumsum([*map(len, raw_b)])
    owner_a = np.repeat(np.arange(len(a)), [*map(len, raw_a)])
    owner_b = np.repeat(np.arange(len(b)), [*map(len, raw_b)])
    links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(owner_a.tolist(), owner_b.tolist()))]
    groups, i, j = [], 0, 0
    for stop in sorted({*stops_a.tolist()} & {*stops_b.tolist()}):
        m, n = int(np.searchsorted(stops_a, stop)) + 1, int(np.searchsorted(stops_b, stop)) + 1
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        i, j = m, n
    return a, b, groups, links


def expected(texts, libraries):
    walked = [_walk(t, libraries) for t in texts]
    count = collections.Counter(link for w in walked if w for link in w[3])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if w is None else (
        len(w[0]), len(w[1]), len(w[2]), len(w[3]), sum(count[x] == most[x[1]] for x in w[3]),
        sum(count[x] for x in w[3]), hashlib.sha256(";".join(w[2]).encode()).hexdigest()) for w in walked]


def result(docs, top=A.TOP):
    aligned = A._kept(A.alignments(docs, "doc_id", "text"))
    rows = A.scored(aligned, A._kept(A.link_counts(aligned)), top).collect()
    return [(r["_row"].text, tuple(r[c] for c in COLUMNS)) for r in rows]


@pytest.mark.parametrize("top", [A.TOP, 200, 0])
def test_equals_a_plain_walk(spark, docs, libraries, top):
    """With few, or no, pairs broadcast the rest comes from the join."""
    got = result(docs.where("doc_id < 120"), top)
    want = expected([t for t, _ in got], libraries)
    assert [g for _, g in got] == want


def test_odd_texts(spark, odd, libraries):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate([
        "a▁b", "<s> <0x41> </s> <unk>", "\x00 \x01", "日本 語　x", " lead", "trail ", "  two  spaces ",
        "é" * 50, "🙂 🙂🙂", "line\n\n\n line", "﻿bom", "é ä"])], "doc_id long, text string")
    got = result(odd.select("doc_id", "text").unionByName(more))
    assert [g for _, g in got] == expected([t for t, _ in got], libraries)
    assert len(got) == len(ODD) + 2 + 12


def test_long_texts_are_cut_without_a_trace(libraries):
    text = "one, two three. Four's 55 sixty  seven\n eight\tnine <|endoftext|> ünï " * 60
    work = A.aligner(None, None)
    whole = _walk(text, libraries)
    for size in (10, 97, 1000):
        parts = list(A.stretches(text, size))
        assert " ".join(parts) == text and len(parts) > 3 - (size == 1000)
        found = [work.tokens(p) for p in parts]
        assert np.concatenate([f[0] for f in found]).tolist() == whole[0]
        assert np.concatenate([f[1] for f in found]).tolist() == whole[1]


def test_very_long_texts(spark, monkeypatch):
    """Beyond a chunk, with and without places to cut at."""
    work = A.aligner(None, None)
    text = "some plain words follow " * 150_000
    one, = work.aligned([text])
    assert len(text) > 3 * A.CHUNK and one[0] == len(work.a.encode(text))
    for odd in (" " * 1_200_000, "x" * 1_200_000, "日本" * 400_000):
        found, = work.aligned([odd])
        assert found is not None and found[3] == len(found[5]) >= max(found[0], found[1])


def test_windows_are_remembered_and_forgotten(libraries, docs, monkeypatch):
    rows = [r.text or "" for r in docs.where("doc_id < 40").collect()]
    work = A.Aligner(A.byte_level(), A.piece_level())
    first = work.aligned(rows)
    size = len(work.windows)
    again = work.aligned(rows)
    assert [x[:5] for x in first if x] == [x[:5] for x in again if x]
    assert len(work.windows) - size < size / 100  # only long windows are aligned anew
    monkeypatch.setattr(A, "REMEMBERED", 10)
    assert [x[:5] for x in work.aligned(rows) if x] == [x[:5] for x in first if x]


def test_empty_table(none):
    assert result(none) == []


def test_extra_columns_may_clash(spark):
    clash = spark.createDataFrame([(1, "one two", 5, "x", 7)], "doc_id long, text string, n_a int, _id string, code int")
    assert result(clash)[0][1][:2] == (2, 2)


def test_known_windows_are_not_encoded_again(libraries):
    work, given = A.Aligner(A.byte_level(), A.piece_level()), []
    for side in (work.a, work.b):
        side.encode = lambda text, encode=side.encode: given.append(text) or encode(text)
    work.aligned(["one, two three's 55\nfour (five)  six"])
    given.clear()
    texts = ["two three's one, 55\nfour two", "(five)  six one,"]
    found = work.aligned(texts)
    assert given == []
    for text, got in zip(texts, found):
        a, b, groups, links = _walk(text, libraries)
        assert got[:4] == (len(a), len(b), len(groups), len(links))
        assert got[4] == hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_windows_of_one_batch_leave_each_other_alone(libraries):
    """White space at the ends of texts, and windows that do not join, beside plain ones."""
    texts = [" x", "x ", "  x  ", " ", "x y", "y  x", "y  x", "x▁ z", "z ▁", "v\0 w", "w x", "", "\x1c x\x1f y"]
    found = A.Aligner(A.byte_level(), A.piece_level()).aligned(texts)
    for text, got in zip(texts, found):
        walked = _walk(text, libraries)
        assert (got is None) == (walked is None)
        if got is not None:
            assert got[4] == hashlib.sha256(";".join(walked[2]).encode()).hexdigest()
