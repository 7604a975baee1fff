"""Spelling variants against plain Python: every pair of words compared."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vacantia.llm import spelling_variants as S


def brute_words(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(docs):
    words = brute_words(docs)
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by_length[len(w) + d] if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def result(docs, **more):
    rows = S.variants(docs, **more).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


ROWS = [(1, "colour colour colour colour COLOUR colour color color color colours colours colours"),
        (2, "Ärger Ärger Ärger ärger ärger ärger naïve naïve naïve naive naive naive naive naive naive naive"),
        (3, "aaaaa aaaaa aaaaa aaaab aaaab aaaab aaaab aaaab aaaab abaaa abaaa abaaa xaaaaa xaaaaa xaaaaa"),
        (None, "listen silent listen silent listen silent enlist enlist enlist tinsel tinsel tinsel"),
        (5, None), (6, ""), (7, "×÷×÷× ×÷×÷× ×÷×÷× x1y2 don't don't don't"),
        (8, "color color color color color color color color color color color color color")]


def test_hand_made(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS + ROWS[:3]], "doc_id long, text string, word string, n int")
    assert result(docs) == brute(ROWS + ROWS[:3])


@pytest.mark.parametrize("sample, cell", [(S.SAMPLE, S.CELL), (300, 16), (2000, 50)])
def test_given_documents(spark, docs, sample, cell):
    """With many small cells, and trees fitted on a part of the words, too."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs, sample=sample, cell=cell) == brute(rows)


def test_every_pair_once():
    """Random words over few letters: many words of one vector, many close ones."""
    rng = np.random.default_rng(5)
    for letters, length in (("ab", 7), ("abcdé", 5), ("abcdefghÿ", 6)):
        def some(n, size):
            return sorted({"".join(rng.choice(list(letters), size)) for _ in range(n)})

        words, shorter = some(1500, length), some(700, length - 1)
        both = words + shorter
        points = {w: S.vectors(S._letters([w]))[0] for w in both}
        tree, leaf = S.build(np.array([points[w] for w in words]), 20)
        assert np.bincount(leaf).max() <= max(20, np.unique(
            np.array([points[w] for w in words]), axis=0, return_counts=True)[1].max())
        got = Counter()
        for i, j in S.pairs_of_cell(words, [], shorter):
            got.update((min(both[a], words[b]), max(both[a], words[b])) for a, b in zip(i.tolist(), j.tolist()))
        want = {(min(a, b), max(a, b)) for k, a in enumerate(both) for b in words[:k] if one_edit(a, b)}
        assert set(got) == want and set(got.values()) <= {1}


def test_checksums():
    data = np.frombuffer("abc défg x yy".encode(), np.uint8)
    starts, ends = np.array([0, 4, 10, 12, 3]), np.array([3, 9, 11, 14, 3])
    before = np.array([zlib.crc32(b"12:"), zlib.crc32(b""), 7, 0, 5], np.uint32)
    got = S.checksums(data, starts, ends, before)
    assert got.tolist() == [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(starts, ends, before)]


def test_long_chain_and_long_text(spark):
    """Forms of forms, a word of 2,000 letters, and a text longer than the chunks it is read in."""
    chain, word = [], "aaaaaaaa"
    for k in range(8):
        chain.append((word, 3 * 2 ** k))
        word = word[:k] + "b" + word[k + 1:]
    text = " ".join(" ".join([w] * n) for w, n in chain) + (" " + "q" * 2000) * 3
    rows = [(1, text), (2, "filler words without end " * 250_000)]
    assert len(rows[1][1]) > 5 * S.CHUNK
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(docs)
    assert got == brute(rows)
    assert sum(form not in (None, root) for form, root, *_ in got.values()) > 3


def test_empty(none):
    assert result(none) == {}
