"""Operators on single documents: rules, classifier, language, personal data, tokens, packing."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import (language_id, packing, personal_data, pieces, quality_classifier,
                          quality_rules)
from vacantia.llm.words import packed

from .conftest import ODD, SF, words


def counts(text):
    found = words(text)
    window = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    often = Counter(window)
    again = {j for i, w in enumerate(window) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(again))


def test_rule_counts(spark, odd, docs):
    for table in (odd, docs):
        texts = {r.doc_id: r.text for r in table.collect()}
        rows = quality_rules.judged(table, quality_rules.Trees(), "doc_id").select(
            "_row.doc_id", *quality_rules.COUNTS, "base_failed", "kept").collect()
        assert len(rows) == table.count()
        for r in rows:
            want = counts(texts[r.doc_id])
            assert tuple(r[1:6]) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert r.kept == (not r.base_failed)


def test_rules_learn_and_are_monotone(docs, labels, none, spark):
    trees = quality_rules.fit(docs, labels)
    assert trees.roots
    x = np.random.default_rng(0).random((300, len(quality_rules.FEATURES)))
    for name in quality_rules.FALLING:
        more = x.copy()
        more[:, quality_rules.FEATURES.index(name)] += 0.3
        assert (trees.score(more) <= trees.score(x) + 1e-12).all()
    more, rated = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
                   for t in ("documents", "labels"))
    judged = quality_rules.judged(more, quality_rules.fit(more, rated), "doc_id").select(
        "_row.doc_id", "kept", "base_failed")
    right = judged.where("NOT base_failed").join(rated, "doc_id").agg(
        F.avg((F.col("kept") == (F.col("quality") > 0)).cast("int"))).first()[0]
    assert right > 0.95
    assert not quality_rules.fit(docs, labels.limit(0)).roots
    assert quality_rules.judged(none, trees, "doc_id").count() == 0
    stage = quality_rules.kept_documents(spark, docs, SF)
    assert stage.columns == docs.columns and 0 < stage.count() < docs.count()


def test_flat_trees_equal_a_walk():
    x = np.random.default_rng(1).random((500, len(quality_rules.FEATURES)))
    trees = quality_rules.grow(x, (x[:, 2] + x[:, 5] < 1).astype(float), trees=5)

    def walk(row):
        total = trees.start
        for node in trees.roots:
            while trees.feature[node] >= 0:
                node = trees.child[node] + (row[trees.feature[node]] > trees.cut[node])
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])


def test_ordinal_grades(docs, labels, odd, none):
    ratings = labels.select("doc_id", quality_classifier.grade(
        F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality_classifier.fit(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality_classifier.graded(docs, model, "doc_id").select("_row.doc_id", "expected_grade",
                                                                   "tail_probability").join(ratings, "doc_id")
    means = {r.grade: r[1] for r in rows.groupBy("grade").avg("expected_grade").collect()}
    assert means[0] < means[2] - 0.5
    for table in (odd, none):
        out = quality_classifier.graded(table, model, "doc_id", "score").select(
            "_row.*", "expected_grade", "tail_probability", "selected").collect()
        assert len(out) == table.count()
        assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    flat = quality_classifier.fit(docs, ratings.limit(0))
    assert np.allclose(flat.tails(np.zeros(1)), [[2 / 3, 1 / 3]])


def test_ordinal_gradient_reaches_the_optimum():
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.integers(0, 2, (n, 3)).astype(float)
    score = x @ [2.0, -1.0, 0.0] + rng.logistic(size=n)
    y = (score > 0.0).astype(int) + (score > 1.5)
    owner, feature = np.nonzero(x)
    model = quality_classifier.fit_ordinal(owner, feature, np.ones(len(owner)), y)
    assert np.allclose(model.weights[:3], [2, -1, 0], atol=0.3)
    assert np.allclose(model.thresholds, [0, 1.5], atol=0.3)


def test_language(docs, odd, none):
    train = ~language_id.held_out(5)
    model = language_id.fit(docs, train)
    got = language_id.predicted(docs, model, "doc_id", "lang").select("_row.*", "lang_pred", "score")
    held = got.where(language_id.held_out(5))
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    rows = {r.doc_id: r for r in language_id.predicted(odd, model, "doc_id", "score").select(
        F.col("_row.doc_id").alias("doc_id"), "lang_pred", F.col("score")).collect()}
    for i, text in enumerate(ODD):
        letters = any(c.isalpha() for c in text or "")
        assert (rows[i].lang_pred == "und") == (not letters)
        assert 0 <= rows[i].score <= 1
    assert language_id.predicted(none, model, "doc_id").count() == 0
    empty = language_id.fit(none)
    assert {r[0] for r in language_id.predicted(odd, empty, "doc_id").select("lang_pred").collect()} == {"und"}


def test_languages_by_blocks(spark, docs, odd, monkeypatch):
    """Blocks of one language give what one block of all gives, and many languages need no limit."""
    whole = language_id.predicted(docs, language_id.fit(docs), "doc_id").collect()
    monkeypatch.setattr(language_id, "BLOCK", 1)
    monkeypatch.setattr(language_id, "HELD", 2)
    blocks = language_id.predicted(docs, language_id.fit(docs), "doc_id").collect()
    assert [(r["_row"], r.lang_pred) for r in blocks] == [(r["_row"], r.lang_pred) for r in whole]
    assert all(abs(a.score - b.score) < 1e-9 for a, b in zip(blocks, whole))
    monkeypatch.setattr(language_id, "BLOCK", 300)
    many = spark.range(600).selectExpr("id AS doc_id", "concat('l', id) AS lang",
                                       "repeat(concat(translate(cast(id AS string), '0123456789', 'abcdefghij'), ' '), 9) AS text")
    model = language_id.fit(many)
    got = language_id.predicted(many, model, "doc_id", "lang").selectExpr("_row.lang", "lang_pred").collect()
    assert model.size == 600 and sum(r.lang == r.lang_pred for r in got) > 550


def test_scores_equal_naive_bayes(spark):
    """Posterior probabilities worked out with plain dictionaries."""
    rows = [(1, "ab ab", "x"), (2, "ba", "y"), (3, "ab c", "x"), (4, "ccc", "y"), (5, "abc", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def counted(text):
        return Counter(language_id.grams([text])[0].tolist())

    share, total = {"x": 0.5, "y": 0.5}, {"x": Counter(), "y": Counter()}
    for _, text, lang in rows:
        if lang:
            total[lang] += counted(text)
    size = {k: sum(v.values()) + language_id.SMOOTHING * language_id.BUCKETS for k, v in total.items()}
    for r in language_id.predicted(table, language_id.fit(table), "text").collect():
        logs = {k: math.log(share[k]) + sum(n * math.log((total[k][b] + language_id.SMOOTHING) / size[k])
                                            for b, n in counted(r["_row"].text).items()) for k in share}
        best = max(sorted(logs), key=logs.get)
        whole = sum(math.exp(v - logs[best]) for v in logs.values())
        assert r.lang_pred == best and abs(r.score - 1 / whole) < 1e-4


def test_language_counts_equal_brute_force():
    bucket, owner = language_id.grams(["Ab, c!", "", "é"])
    lines = [" ab c ", "  ", " é "]
    want = Counter()
    for i, line in enumerate(lines):
        line = re.sub(" +", " ", line)
        for n in (1, 2, 3):
            for k in range(len(line) - n + 1):
                if line[k:k + n] != " ":
                    want[i] += 1
    assert Counter(owner.tolist()) == Counter({k: v for k, v in want.items() if v})
    assert (bucket[owner == 0][0], bucket.max() < language_id.BUCKETS)[1]


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 12 <= len(digits) <= 19 and luhn(digits)
                    or kind == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", [
    "a@b", "a@b.c@d.e", "+1 (555) 123-4567x", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4",
    "4396177793418310-1", "a.b@@c.d e%f@g-h.ij.k", "@a.b", "x@a..b", "+123456789+123456789",
    "00000000000000 1", "é" * 5 + "a@b.c", *[t or "" for t in ODD]])
def test_base_spans(text):
    assert personal_data.base_spans(text) == plain_spans(text)


def test_personal_data(spark, docs, texts, odd, none):
    field = personal_data.fit(docs)
    for table in (docs, odd, none):
        own = {r.doc_id: r.text or "" for r in table.collect()}
        rows = personal_data.found(table, field, "doc_id", redact=True).select(
            "_row.doc_id", "n_card", "base_sha256", "spans", "redacted").collect()
        assert len(rows) == table.count()
        for r in rows:
            base = plain_spans(own[r.doc_id])
            line = [f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in base]
            assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
            assert r.n_card == sum(k == 2 for _, k, _ in base)
            assert set(line) <= set(r.spans.split(",")) | set() if line else True
            assert not plain_spans(r.redacted or "") or len(plain_spans(r.redacted)) < len(base)


def test_rare_personal_data_is_learned_from(spark):
    """One document in 200 holds any: the field sees all of them, and finds a disguised twin."""
    rows = [(i, f"plain words, item {i} of 9000 {'a' * (i % 7)}") for i in range(9000)]
    rows += [(20_000 + i, f"write to some.one{i}@mail.example.com or call +44 20 7946 0{i}00") for i in range(45)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = packed(table).select("_text").mapInArrow(
        personal_data._examples(300), "piece string, a int, b int, kind int, hash long").collect()
    assert Counter(r.kind for r in drawn)[0] >= 45 and Counter(r.kind for r in drawn)[3] >= 45
    field = personal_data.fit(table)
    twin = spark.createDataFrame([(1, "write to other.name [at] mail.example.com today")], "doc_id long, text string")
    assert personal_data.found(twin, field, "doc_id").first().spans.startswith("email:")


def test_no_stretch_is_left_out_of_the_draw(spark):
    """A document with hundreds of spans gives as many examples as are asked for, in any partitioning."""
    text = " ".join(f"m{i}@x{i}.example.org" for i in range(500))
    table = spark.createDataFrame([(i, text[i:]) for i in range(4)], "doc_id long, text string")
    drawn = [sorted(map(tuple, packed(table.repartition(n)).select("_text").mapInArrow(
        personal_data._examples(100), "piece string, a int, b int, kind int, hash long").collect())) for n in (1, 1)]
    assert drawn[0] == drawn[1] and len([r for r in drawn[0] if r[3] == 0]) == 100


def test_field_sums_equal_enumeration():
    """The sum over all segmentations, and the best one, against listing them."""
    rng = np.random.default_rng(0)
    n = 6
    segments = [(a, b) for a in range(n) for b in range(a + 1, min(n, a + 3) + 1)]
    score = rng.normal(size=len(segments))

    def every(at):
        if at == n:
            return [0.0]
        out = list(every(at + 1))
        for k, (a, b) in enumerate(segments):
            if a == at:
                out += [score[k] + rest for rest in every(b)]
        return out

    alpha, beta = personal_data._sums(n, segments, score)
    whole = np.log(np.exp(every(0)).sum())
    assert np.isclose(alpha[n], whole) and np.isclose(beta[0], whole)


def test_pieces_equal_the_library(spark, docs, odd, none, texts):
    sp = pytest.importorskip("sentencepiece")
    library = sp.SentencePieceProcessor(model_file=pieces.vocabulary())
    for table in (docs, odd, none):
        rows = pieces.decoded(pieces.encoded(table, "doc_id", "text")).select(
            F.col("_row.text").alias("before"), "ids", "text").collect()
        assert len(rows) == table.count()
        for r in rows:
            assert r.ids == library.encode(r.before or "")
            assert r.text == (r.before or "")


@pytest.mark.parametrize("text", ["aaaaaaa aaaa", "  a   b ", "é😀ü 日本語", "ab" * 900,
                                  "<s> </s> <0x0A> <unk>", "....,,,,;;", "\t\n x"])
def test_pieces_odd(text):
    sp = pytest.importorskip("sentencepiece")
    library = sp.SentencePieceProcessor(model_file=pieces.vocabulary())
    model = pieces.Pieces()
    ids = np.frombuffer(model.encode([text])[0], "<u4")
    assert ids.tolist() == library.encode(text) and model.decode(ids) == text


def test_suffix_array():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, 400)
    order = pieces.suffix_array(codes, 16)
    line = codes.tolist()
    keys = [line[i:i + 16] for i in order]
    assert keys == sorted(keys)


def test_suffix_array_sorts_seldom(monkeypatch):
    """Codes share a sort key as far as they fit, so that few sorts are needed."""
    sort, calls = np.argsort, []
    monkeypatch.setattr(pieces.np, "argsort", lambda *a, **k: calls.append(a) or sort(*a, **k))
    for letters, most in ((100, 2), (0x110000, 4)):
        codes = np.random.default_rng(3).integers(0, letters, 3000)
        codes[1500:] = codes[:1500]
        calls.clear()
        order = pieces.suffix_array(codes, 16)
        assert len(calls) <= most
        line = codes.tolist()
        keys = [line[i:i + 16] for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(3000))
    assert len(pieces.suffix_array(np.zeros(0, np.int64), 16)) == 0


def test_pieces_remember_a_bounded_number_of_words(monkeypatch):
    sp = pytest.importorskip("sentencepiece")
    library = sp.SentencePieceProcessor(model_file=pieces.vocabulary())
    monkeypatch.setattr(pieces, "CACHE", 4)
    monkeypatch.setattr(pieces, "KEPT_WORD", 6)
    model = pieces.Pieces()
    for k in range(6):
        texts = ["one two, averylongword one", f"w{k} x{k} two averylongword", "", "averylongword"]
        assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == [*map(library.encode, texts)]
        assert len(model.known) <= 10 and max(map(len, model.known)) <= 6


def packed_rows(table):
    return packing.pack(table, "doc_id").select("_row.doc_id", "start", "length", "ids_crc32",
                                                "doc_tokens", "sequence_id", "offset").collect()


def test_packing(spark, docs, texts, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    tool = tokenizers.Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    for table in (docs.repartition(5), odd):
        own = {r.doc_id: r.text or "" for r in table.collect()}
        ids = {i: np.array(tool.encode(t, add_special_tokens=False).ids + [0], "<u4")
               for i, t in own.items()}
        parts, sequences = defaultdict(list), defaultdict(list)
        for r in packed_rows(table):
            part = ids[r.doc_id][r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
            parts[r.doc_id].append((r.start, r.length))
            sequences[r.sequence_id].append((r.offset, r.length))

        def end(pieces_):
            at = 0
            for start, length in sorted(pieces_):
                assert start == at and length > 0
                at += length
            return at

        repeated = {i for i, n in Counter(r.doc_id for r in table.collect()).items() if n > 1}
        for i, found in parts.items():
            if i not in repeated:
                assert end(found) == len(ids[i])
        used = [end(s) for s in sequences.values()]
        assert max(used) <= packing.WINDOW
        if len(used) > 20:
            assert sum(used) >= 0.97 * len(used) * packing.WINDOW
    assert packed_rows(none) == []


def test_packer_is_bounded():
    packer = packing.Packer(0, window=16, most=3)
    for row in range(200):
        packer.add(row, np.arange(row % 11 + 1, dtype="<u4").tobytes())
        assert len(packer.open) <= 3
    packer.finish()
    assert sum(p[2] for p in packer.out) == sum(r % 11 + 1 for r in range(200))
