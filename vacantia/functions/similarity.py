"""Title similarity inside Arrow tasks: the ratio of matching characters of two titles.

Spark has no built-in for it. The ratio is not symmetric: the stored title comes first.
"""

from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from ..vocab import TITLE_SIMILARITY

_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_OTHER = len(_LETTERS)
_SLOT = np.full(128, _OTHER, dtype=np.int64)
for _i, _c in enumerate(_LETTERS):
    _SLOT[ord(_c)] = _i


@lru_cache(1 << 14)
def _letter_counts(title: str) -> np.ndarray:
    codes = np.frombuffer(title.encode("utf-32-le"), dtype=np.uint32)
    slots = np.where(codes < 128, _SLOT[np.minimum(codes, 127)], _OTHER)
    return np.bincount(slots, minlength=_OTHER + 1).astype(np.int32)


@lru_cache(1024)
def _needed(longest: int, probe: int) -> np.ndarray:
    """Letters that titles of 0 to `longest` letters must share with a probe of that length."""
    return np.ceil((TITLE_SIMILARITY - 1e-9) / 2 * (np.arange(longest + 1) + probe) - 1e-9).astype(np.int32)


_SHORT = 255  # letters of a title up to which its counts are kept as bytes


class OrderedTitles:
    """Titles in match order. `first_like` finds the first that is similar to a probe.

    Matching characters are at most the letters two titles share, so a vectorised count over the
    probe's letters rules out nearly all titles; the exact ratio runs on the rest, first hit wins.
    """

    def __init__(self, capacity: int):
        self.titles: list[str] = []
        self._counts = np.zeros((_OTHER + 1, capacity), dtype=np.uint8)  # a line for each letter
        self._lengths = np.zeros(capacity, dtype=np.int32)
        self._longest = 0

    def add(self, title: str) -> None:
        self.titles.append("")
        self.set(len(self.titles) - 1, title)

    def set(self, place: int, title: str) -> None:
        if len(title) > _SHORT and self._counts.dtype == np.uint8:
            self._counts = self._counts.astype(np.int32)
        self._counts[:, place] = _letter_counts(title) if title else 0
        self._lengths[place] = len(title)
        self._longest = max(self._longest, len(title))
        self.titles[place] = title

    def _shared(self, probe: str) -> np.ndarray:
        """Letters that each title shares with the probe. A sum stays within a title's length."""
        counts = _letter_counts(probe)
        letters = np.flatnonzero(counts)
        lines = self._counts[letters, :len(self.titles)]
        most = _SHORT if lines.dtype == np.uint8 else len(probe)
        asked = np.minimum(counts[letters], most).astype(lines.dtype)
        return np.minimum(lines, asked[:, None]).sum(axis=0, dtype=lines.dtype)

    def first_like(self, probe: str, allowed: np.ndarray | None = None) -> int:
        """Place of the first title (of those `allowed`) that is similar to the probe, or -1."""
        n = len(self.titles)
        if not n or not probe:
            return -1
        fits = self._shared(probe) >= _needed(self._longest, len(probe))[self._lengths[:n]]
        fitting = np.flatnonzero(fits if allowed is None else fits & allowed)
        if not len(fitting):
            return -1
        matcher = SequenceMatcher(None)
        matcher.set_seq2(probe)
        for i in fitting:
            matcher.set_seq1(self.titles[i])
            if matcher.ratio() >= TITLE_SIMILARITY:
                return int(i)
        return -1


class _Run(OrderedTitles):
    """Owners in ascending order, each with the title it is the least holder of; '' where there is none, which
    is similar to nothing."""

    def __init__(self):
        super().__init__(16)
        self.owners: list[int] = []
        self.live = 0  # owners that have a title

    def has(self, owner: int) -> bool:
        at = bisect_left(self.owners, owner)
        return at < len(self.owners) and self.owners[at] == owner

    def put(self, owner: int, title: str) -> None:
        if not self.has(owner):
            at, n = bisect_left(self.owners, owner), len(self.owners)
            if n == len(self._lengths):
                self._counts, self._lengths = (np.concatenate([x, np.zeros_like(x)], axis=-1)
                                               for x in (self._counts, self._lengths))
            for line in (self._counts, self._lengths):
                line[..., at + 1:n + 1] = line[..., at:n]
            self.owners.insert(at, owner)
            self.titles.insert(at, "")
        at = bisect_left(self.owners, owner)
        self.live += bool(title) - bool(self.titles[at])
        self.set(at, title)

    def parted(self, size: int) -> list["_Run"]:
        """The owners that have a title, in runs of at most that size."""
        held = np.flatnonzero([bool(title) for title in self.titles])
        out = []
        for places in (held[i:i + size] for i in range(0, len(held), size)):
            part = _Run()
            part._counts, part._lengths = self._counts[:, places], self._lengths[places]
            part._longest = self._longest
            part.owners, part.titles = [self.owners[i] for i in places], [self.titles[i] for i in places]
            part.live = len(places)
            out.append(part)
        return out


class MovingTitles:
    """Different titles, each with the least owner that holds it at present, if any; `lowest` finds the
    least owner whose title is similar to a probe. An owner holds one title at a time.

    Owners are gone through in ascending order, a run of at most `size` at a time, up to the first that is
    similar: where similar titles are common that is near the front, however many titles there are.
    """

    def __init__(self, size: int = 2048):
        self._size = size
        self._runs: list[_Run] = []
        self._firsts: list[int] = []  # the least owner of each run
        self._low: dict[str, int] = {}

    def hold(self, title: str, owner: int | None) -> None:
        """From now on `owner` is the least that holds the title; None if nobody does."""
        before = self._low.get(title)
        if not title or before == owner:
            return
        if before is not None:
            del self._low[title]
            self._put(before, "")
        if owner is not None:
            self._low[title] = owner
            self._put(owner, title)

    def _put(self, owner: int, title: str) -> None:
        last = self._runs[-1].owners if self._runs else []
        if not last or (len(last) >= self._size and owner > last[-1]):
            self._runs.append(_Run())
            self._firsts.append(owner)
        at = max(0, bisect_right(self._firsts, owner) - 1)
        run = self._runs[at]
        if len(run.owners) >= self._size and not run.has(owner):
            parts = run.parted(self._size // 2)
            self._runs[at:at + 1], self._firsts[at:at + 1] = parts, [part.owners[0] for part in parts]
            at = max(0, bisect_right(self._firsts, owner) - 1)
            run = self._runs[at]
        run.put(owner, title)
        self._firsts[at] = run.owners[0]
        if not run.live:
            del self._runs[at], self._firsts[at]

    def lowest(self, probe: str) -> int | None:
        for run in self._runs:
            at = run.first_like(probe)
            if at >= 0:
                return run.owners[at]
        return None


@F.pandas_udf(T.DoubleType())
def title_similarity(stored: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio()
                      for a, b in zip(stored, other)], dtype="float64")
