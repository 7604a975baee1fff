"""Personal data (operator 3): a semi-Markov conditional random field over whole spans.

Base patterns (email, ip, card, phone) are found exactly. Around what they leave, stretches of
tokens with digits or at-signs are decoded by the field: a segment of up to LONGEST tokens is scored
by features of the whole span (shape, digits, checksum, borders), and dynamic programming chooses
boundaries and kinds together, with base spans fixed. The field learns from a bounded number of base
spans of each kind, drawn by hash from all documents, and from the same spans as people disguise them
(`0044`, `[at]`, dots in card numbers), so it adds spans of known kinds that the patterns do not reach.

Defined cases: a null or empty text has no spans; repeated rows are handled each by itself; a text
of any length is read whole; without base spans to learn from the field adds none; an empty table
gives an empty result; extra columns are ignored, or carried along by `redacted`, whatever their
names. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .words import packed, with_added

KINDS = ["email", "ip", "card", "phone"]
LONGEST = 24         # tokens of a segment
REACH = 80           # characters from a trigger to the border of its stretch
LONG_REGION = 400    # characters; longer stretches are no examples
SAMPLE_REGIONS = 1500

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|[\[(]at[\])]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d // 5 + d * 2 % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = []
    at, after = text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            after = domain.end()
        at = text.find("@", max(at + 1, after))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def regions(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches outside the taken spans that hold a trigger, from blank to blank; stretches that
    one blank divides are one."""
    out: list[tuple[int, int]] = []
    k, floor = 0, 0
    for m in _TRIGGER.finditer(text):
        while k < len(taken) and taken[k][2] <= m.start():
            floor = max(floor, taken[k][2])
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        ceiling = taken[k][0] if k < len(taken) else len(text)
        low, high = max(floor, m.start() - REACH), min(ceiling, m.end() + REACH)
        blanks = 2 if m[0][0] in "[(" else 1  # a disguised at-sign may have blanks around it
        start, stop = m.start(), m.end()
        for step in range(blanks):
            while start > low and (step and start == m.start() - 1 or not text[start - 1].isspace()):
                start -= 1
            while stop < high and (step and stop == m.end() + 1 or not text[stop].isspace()):
                stop += 1
            if step + 1 < blanks:
                start, stop = max(low, start - 1), min(high, stop + 1)
        if out and start <= out[-1][1] + 1 and out[-1][1] >= floor:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return [(a, b) for a, b in out if a < b]


def _border(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return ("digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace()
            else c if c in "@.+-/:_#" else "mark")


class Region:
    """Tokens of a stretch and its candidate segments (first token, token after the last)."""

    def __init__(self, text: str, start: int, stop: int):
        self.text = text
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, stop)]
        self.starts, self.ends = [a for a, _ in tokens], [b for _, b in tokens]
        self.shape = []
        for a, b in tokens:
            t = text[a:b]
            self.shape.append("d" if t[0].isdigit() else
                              ("at" if t == "at" else "w") if t[0].isalpha() else
                              " " if t.isspace() else t)
        self.solid = [s in ("d", "w", "at") for s in self.shape]

    def segments(self) -> Iterator[tuple[int, int]]:
        n = len(self.starts)
        for a in range(n):
            if not (self.solid[a] or self.shape[a] in "+("):
                continue
            marks = 0  # a span needs a digit group or an at-sign
            for b in range(a + 1, min(n, a + LONGEST) + 1):
                marks += self.shape[b - 1] in ("d", "@", "at")
                if marks and self.solid[b - 1]:
                    yield a, b

    def key(self, a: int, b: int) -> tuple:
        """All that the features see of a segment."""
        text = self.text[self.starts[a]:self.ends[b - 1]]
        shape = tuple(self.shape[a:b])
        digits = _NOT_DIGIT.sub("", text) if "d" in shape else ""
        check = 12 <= len(digits) <= 19 and luhn(digits)
        quad = shape.count("d") == 4 and "w" not in shape and all(
            len(p) <= 3 and int(p) <= 255 for p in re.findall(r"[0-9]+", text))
        return (shape, min(len(digits), 20), check, quad, text.startswith("00"),
                _border(self.text, self.starts[a] - 1), _border(self.text, self.ends[b - 1]))


def span_features(key: tuple) -> list[str]:
    shape, digits, check, quad, zeros, left, right = key
    line = "".join(shape)
    signs = re.sub(r"[dw]|at", "", line)
    ats = line.count("@") + shape.count("at")
    dots = line.count(".")
    inside = re.sub(r"(?:[dw][._%+-]?)+", "n", line)  # names and numbers as one
    size = 0 if not digits else 1 if digits < 9 else 2 if digits < 12 else 3 if digits < 16 else \
        4 if digits < 20 else 5
    return ["bias", f"inside {inside}", f"size {size}", f"signs {signs[:8]}", f"left {left}",
            f"right {right}", f"ats {min(ats, 2)} dots {min(dots, 4)}", f"check {check} {size}",
            f"quad {quad} {line == 'd.d.d.d'}", f"first {shape[0]} {zeros} {size}", f"last {shape[-1]}",
            f"letters {'w' in shape}", f"blanks {min(line.count(' '), 3)} letters {'w' in shape}",
            f"digits {digits} first {shape[0]} check {check}"]


class Field:
    """Weights of features by kind. Tokens outside spans score 0."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))
        self.known: dict[tuple, np.ndarray] = {}

    def ids(self, key: tuple, grow: bool = False) -> np.ndarray:
        names = span_features(key)
        if grow:
            for f in names:
                self.index.setdefault(f, len(self.index))
        return np.array([self.index[f] for f in names if f in self.index], int)

    def score(self, key: tuple) -> np.ndarray:
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            names = span_features(key)
            missing = sum(f not in self.index for f in names)
            # A shape never met is no evidence: each unknown feature counts against a span.
            self.known[key] = self.weights[self.ids(key)].sum(axis=0) - 2.0 * missing
        return self.known[key]

    def decode(self, region: Region) -> list[tuple[int, int, int]]:
        """Best segmentation: (start, kind, end) of its spans."""
        n = len(region.starts)
        ending: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for a, b in region.segments():
            score = self.score(region.key(a, b))
            kind = int(score.argmax())
            if score[kind] > 0:
                ending[b].append((a, kind, float(score[kind])))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for b in range(1, n + 1):
            best[b] = best[b - 1]
            for a, kind, score in ending[b]:
                if best[a] + score > best[b]:
                    best[b], back[b] = best[a] + score, (a, kind)
        out, b = [], n
        while b > 0:
            if back[b] is None:
                b -= 1
            else:
                a, kind = back[b]
                out.append((region.starts[a], kind, region.ends[b - 1]))
                b = a
        return out[::-1]

    def learn(self, examples: list[tuple[Region, dict[tuple[int, int], int]]], rounds: int = 6,
              rate: float = 0.3, decay: float = 1e-3) -> None:
        """Maximum likelihood by AdaGrad, one stretch at a time; expected counts come from forward
        and backward sums over all segmentations."""
        prepared = []
        for region, gold in examples:
            segments = list(region.segments())
            ids = [self.ids(region.key(a, b), True) for a, b in segments]
            prepared.append((len(region.starts), segments, ids, [gold.get(s, -1) for s in segments]))
        self.weights = np.zeros((len(self.index), len(KINDS)))
        seen = np.full_like(self.weights, 1e-6)
        for _ in range(rounds):
            for n, segments, ids, gold in prepared:
                if not segments:
                    continue
                scores = np.array([self.weights[i].sum(axis=0) for i in ids])
                top = scores.max(axis=1)
                whole = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
                alpha, beta = _sums(n, segments, whole)
                for k, (a, b) in enumerate(segments):
                    share = np.exp(np.minimum(alpha[a] + scores[k] + beta[b] - alpha[n], 0.0))
                    slope = -share
                    if gold[k] >= 0:
                        slope[gold[k]] += 1
                    if np.abs(slope).max() > 1e-3:
                        slope = slope - decay * self.weights[ids[k]]
                        np.add.at(seen, ids[k], slope ** 2)
                        self.weights[ids[k]] += rate * slope / np.sqrt(seen[ids[k]])


def _add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x))


def _sums(n: int, segments: list[tuple[int, int]], score: np.ndarray) -> tuple[list, list]:
    """Log sums over all segmentations up to each token, and from it on."""
    into, outof = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (a, b) in enumerate(segments):
        into[b].append((a, float(score[k])))
        outof[a].append((b, float(score[k])))
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for b in range(1, n + 1):
        alpha[b] = alpha[b - 1]
        for a, s in into[b]:
            alpha[b] = _add(alpha[b], alpha[a] + s)
    for a in range(n - 1, -1, -1):
        beta[a] = beta[a + 1]
        for b, s in outof[a]:
            beta[a] = _add(beta[a], beta[b] + s)
    return alpha, beta


def disguises(text: str, kind: int) -> list[str]:
    """Ways to write a span that the base patterns do not reach."""
    if kind == 0:
        name, _, domain = text.partition("@")
        return [f"{name} [at] {domain}", f"{name}(at){domain}", f"{name} @ {domain}"]
    if kind == 2:
        digits = _NOT_DIGIT.sub("", text)
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    if kind == 3:
        return ["00" + text[1:], "00 " + text[1:]]
    return []


def _examples(most: int):
    """Stretches around base spans and without any: text, borders, kind (-1: none) and a hash. A task
    hands on its `most` least hashes of each kind."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple, int]] = {}

        def add(piece: str, a: int, b: int, kind: int) -> None:
            own = held.setdefault(kind, {})
            own[piece, a, b] = zlib.crc32(f"{kind}:{a}:{b}:{piece}".encode("utf-8", "surrogatepass"))
            if len(own) > 4 * most:
                held[kind] = dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:most])

        for batch in batches:
            for text in batch.column("_text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                for start, kind, stop in spans:
                    low, high = max(0, start - 30), min(len(text), stop + 30)
                    add(text[low:high], start - low, stop - low, kind)
                for start, stop in regions(text, spans):
                    if stop - start <= LONG_REGION:
                        low, high = max(0, start - 5), min(len(text), stop + 5)
                        add(text[low:high], start - low, stop - low, -1)
        rows = [(*key, kind, value) for kind, own in held.items()
                for key, value in sorted(own.items(), key=lambda x: (x[1], x[0]))[:most]]
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string())] + [pa.array(c, pa.int32()) for c in columns[1:4]]
            + [pa.array(columns[4], pa.int64())], names=["piece", "a", "b", "kind", "hash"])

    return step


def fit(docs: DataFrame, most_regions: int = SAMPLE_REGIONS) -> Field:
    """Learns from at most `most_regions` stretches, as many of each kind and of none, that have the
    least hashes among those of all documents; so kinds that are rare in the corpus are learned,
    too."""
    each = most_regions // 5
    rows = packed(docs).select("_text")
    drawn = rows.mapInArrow(_examples(each), "piece string, a int, b int, kind int, hash long").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("hash", "piece", "a", "b"))
    found = drawn.withColumn("n", place).where(F.col("n") <= each).orderBy("kind", "n").select(
        "piece", "a", "b", "kind").collect()
    examples = []
    for piece, a, b, kind in found:
        for text in [piece[a:b], *disguises(piece[a:b], kind)] if kind >= 0 else [None]:
            line, stop = (piece, b) if text is None else (piece[:a] + text + piece[b:], a + len(text))
            low, high = a, stop
            while kind >= 0 and low > 0 and not line[low - 1].isspace():
                low -= 1
            while kind >= 0 and high < len(line) and not line[high].isspace():
                high += 1
            region = Region(line, low, high)
            gold = {}
            if kind >= 0 and a in region.starts and stop in region.ends:
                gold[region.starts.index(a), region.ends.index(stop) + 1] = kind
            if kind < 0 or gold:
                examples.append((region, gold))
    field = Field()
    if any(gold for _, gold in examples):
        field.learn(examples)
    return field


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and base and added spans in order."""
    base = base_spans(text)
    if not field.index or not _TRIGGER.search(text):
        return base, base
    added = [s for a, b in regions(text, base) for s in field.decode(Region(text, a, b))]
    return base, sorted(base + added)


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or stretch of overlapping spans, becomes the name of its first kind."""
    out, at = [], 0
    for start, kind, stop in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def found(docs: DataFrame, field: Field, *keep: str, redact: bool = False) -> DataFrame:
    """_row (a struct of the `keep` columns), counts and spans of every text, and with `redact`
    the text without them."""
    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"] + ["redacted"] * redact

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "_text"]
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                for text in part.column("_text").to_pylist():
                    base, every = all_spans(text or "", field)
                    count = [0] * len(KINDS)
                    for _, kind, _ in base:
                        count[kind] += 1
                    digest = hashlib.sha256(_line(base).encode()).hexdigest()
                    new = [text if not every else redacted_text(text, every)] if redact else []
                    rows.append((*count, digest, _line(every), *new))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in kept]
                    + [pa.array(c, pa.int64() if n.startswith("n_") else pa.string())
                       for n, c in zip(names, columns)], names=kept + names)

    rows = packed(docs, *keep)
    added = ", ".join(f"{n} {'long' if n.startswith('n_') else 'string'}" for n in names)
    return rows.mapInArrow(find, with_added(rows, added))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return found(docs, fit(docs), "doc_id").drop("redacted").select(
        "_row.doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every found span is replaced; all documents and columns stay, and a column
    n_chars follows its text."""
    others = [c for c in docs.columns if c != "text"]
    out = found(docs, fit(docs), *others, redact=True)
    columns = [F.col("redacted").alias("text") if c == "text" else F.col(f"_row.`{c}`")
               for c in docs.columns]
    out = out.select(*columns)
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), count))
    return out
