"""Language identification (operator 4): multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language come from all learnable documents: every task adds up
its own rows first, so a hot language costs nothing extra. The log-probability matrix (BUCKETS rows,
one column per language) is broadcast; a task scores a whole chunk of texts with one gather and one
sum per text. More than BLOCK languages are scored block after block: the matrix of a block is
broadcast, and every row carries the best score and the sum of all so far.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows without a language
or id are never learned from; repeated rows count and are scored once each; an empty table, or none
to learn from, makes every text `und`; ties go to the alphabetically first language; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.shuffle import with_position
from ..session import cut_lineage
from .words import CHUNK, mix, packed, with_added

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
BLOCK = 512      # languages; bounds the broadcast: 512 x 32768 floats of 4 bytes are 64 MB
HELD = 64        # languages whose counts a task holds before it hands them on

_LETTER = regex.compile(r"\p{L}")
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """True at the code points that are letters (general category L)."""
    if not _letters:
        every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
        table = np.zeros(0x110000, bool)
        for found in regex.finditer(r"\p{L}+", every):
            table[found.start():found.end()] = True
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams. Texts are lower-cased; a run of other characters than letters
    is one blank, so that grams see where words start and end."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a letter stands for the whole run
    keep[0] = True
    keep[1:] |= owner[1:] != owner[:-1]
    codes, owner = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep]
    buckets, owners = [], []
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        value = np.full(size, n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + codes[k:size + k]
        inside = owner[:size] == owner[n - 1:]
        if n == 1:
            inside &= codes != 32
        buckets.append((mix(value[inside]) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[:size][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK // 4 or i == len(texts) - 1:
            yield start, [t or "" for t in texts[start:i + 1]]
            start, size = i + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's texts; bucket -1 counts the texts."""
    totals: dict[str, np.ndarray] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array((at - 1).astype(np.int32)), pa.array(total[at])],
                names=["lang", "bucket", "n"])
        totals.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for start, texts in _chunks(batch.column("_text").to_pylist()):
            bucket, owner = grams(texts)
            of = langs[start:start + len(texts)]
            for lang in sorted(set(of)):
                total = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[0] += (of == lang).sum()
                total[1:] += np.bincount(bucket[(of == lang)[owner]], minlength=BUCKETS)
                if len(totals) >= HELD:
                    yield from handed_on()
    yield from handed_on()


class Model:
    """Counts (lang, bucket, n) of `size` languages and their places (lang, place), in alphabetical
    order."""

    def __init__(self, counts: DataFrame, places: DataFrame, size: int, texts: int):
        self.counts, self.places, self.size, self.texts = counts, places, size, texts

    def block(self, k: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Names, log probabilities of buckets and log shares of texts of the k-th BLOCK languages."""
        own = self.places.where(F.col("place").between(k * BLOCK + 1, (k + 1) * BLOCK))
        table = self.counts.join(F.broadcast(own.select("lang")), "lang").toArrow()  # BLOCK names at most
        langs = sorted(set(table["lang"].to_pylist()))
        column = np.searchsorted(langs, table["lang"].to_pylist()) if langs else np.zeros(0, int)
        total = np.zeros((BUCKETS + 1, len(langs)))
        total[table["bucket"].to_numpy() + 1, column] = table["n"].to_numpy()
        seen = total[1:] + SMOOTHING
        return (langs, np.log(seen / seen.sum(axis=0)).astype(np.float32),
                np.log(total[0] / max(self.texts, 1)))


def fit(docs: DataFrame, learnable: Column | None = None) -> Model:
    """Learns from the rows of docs (text, lang) that are `learnable` and have a language."""
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull()
    rows = docs.where(usable if learnable is None else usable & learnable).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("_text"))
    counts = cut_lineage(rows.mapInArrow(_count, "lang string, bucket int, n long")
                         .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    texts = counts.where("bucket = -1")
    size, total = texts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    names = texts.select("lang")
    places = names.withColumn("place", F.lit(1)) if size <= BLOCK else cut_lineage(
        with_position(names, [F.col("lang")], "place"))
    return Model(counts, places, size, total)


def predicted(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """_row (a struct of the `keep` columns), lang_pred and score (posterior probability)."""
    rows, spark = packed(docs, *keep), docs.sparkSession
    blocks = max(1, -(-model.size // BLOCK))
    names = [f.name for f in rows.schema.fields if f.name != "_text"]

    def step(k: int):
        shared = spark.sparkContext.broadcast(model.block(k))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, logp, prior = shared.value
            known = np.array([*langs, None], object)
            for batch in batches:
                for start, texts in _chunks(batch.column("_text").to_pylist()):
                    part, n = batch.slice(start, len(texts)), len(texts)
                    if k:
                        top, whole = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_top", "_whole"))
                        named = np.array(part.column("lang_pred").to_pylist(), object)
                    else:
                        top, whole, named = np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, None, object)
                    if langs:
                        bucket, owner = grams(texts)
                        total = np.stack([np.bincount(owner, weights=logp[bucket, i], minlength=n)
                                          for i in range(len(langs))], axis=1) + prior
                        best = total.argmax(axis=1)
                        most = total[np.arange(n), best]
                        named = np.where(most > top, known[best], named)
                        here = most + np.log(np.exp(total - most[:, None]).sum(axis=1))
                        top, whole = np.maximum(top, most), np.logaddexp(whole, here)
                    columns = [part.column(c) for c in names]
                    if k < blocks - 1:
                        yield pa.RecordBatch.from_arrays(
                            [*columns, part.column("_text"), pa.array(named, pa.string()), pa.array(top), pa.array(whole)],
                            names=[*names, "_text", "lang_pred", "_top", "_whole"])
                        continue
                    sure = np.array([_LETTER.search(t) is not None for t in texts], bool) & np.isfinite(top)
                    with np.errstate(invalid="ignore"):
                        score = np.where(sure, np.exp(top - whole), 0.0)
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(np.where(sure, named, "und"), pa.string()), pa.array(score)],
                        names=[*names, "lang_pred", "score"])

        return score

    final = with_added(rows, "lang_pred string, score double")
    carried = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(
        "lang_pred string, _top double, _whole double").fields])
    for k in range(blocks - 1):
        rows = cut_lineage(rows.mapInArrow(step(k), carried))
    return rows.mapInArrow(step(blocks - 1), final)


def held_out(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 0


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out(5))
    return predicted(docs, model, "doc_id").select(
        "_row.doc_id", F.coalesce(held_out(5), F.lit(False)).alias("held_out"), "lang_pred", "score")


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents without a recognisable language go (`und`, or a winner with a
    posterior below `least`); all columns stay as they are."""
    found = predicted(docs, fit(docs), *docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")
