"""Periodic runs of words, found online by catchers over completed blocks of power-of-two length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table

#: Words on either side of a match that are compared for all matches at once; words of texts that share a catcher.
NEAR, TOGETHER = 16, 1 << 15
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Grown:
    """An array of numbers that is appended to, with room for as many more."""

    def __init__(self, kind):
        self.room, self.n = np.empty(64, kind), 0

    def append(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.empty(2 * (self.n + len(values)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.n]


class SquareCatcher:
    """Maximal runs of period p in a growing sequence of words (numbers): stretches of words that equal the word p before,
    of max(least, 2 p) words or more. append() takes the next words, finish() returns the runs.

    Every completed aligned block of b = 1, 2, 4 .. words has a catcher for the periods 2b-1 .. 4b-2 (and, while `least`
    asks for more words than two periods have, for shorter ones): an appended word ends a window of b words, which is
    compared by hash with the two aligned blocks that stand so far before it. What a run of these periods repeats holds
    an aligned block, so its catcher meets the run in the first such block; there the comparison of suffixes goes on word
    by word to the left, and to the right with each word appended, until it fails. A stretch that has grown to a square
    when it ends is a run. Hashes have 64 bits and every match is compared by words.

    Squares of a multiple of a run's period lie in the run and give the same stretch, for which the smallest period is
    kept. Work and memory grow as n log n.
    """

    def __init__(self, least: int = 12):
        self.least, self.words = least, Grown(np.int64)
        self.hashes: list[Grown] = []  # by level: hashes of all windows of 2^level words
        self.open: dict[int, int] = {}  # period -> start of the stretch that reaches the last word
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        self.short = {p: self._block(p) for p in range(1, least // 2) if self._block(p) != self._block(p, 0)}

    def _block(self, p: int, least: int | None = None) -> int:
        """The longest power of two that lies aligned in any max(p, least - p) words."""
        return 1 << ((max((self.least if least is None else least) - p, p) + 1) // 2).bit_length() - 1

    def append(self, words: np.ndarray, longest: int | None = None) -> None:
        """Take the next words. Where they are texts with a word of its own behind each, `longest` is the length of the
        longest: blocks over half of it repeat nowhere and are not compared."""
        was = self.words.n
        self.words.append(words)
        self._advance(was)
        w, n = self.words.held, self.words.n
        level, b = 0, 1
        while b <= (n if longest is None else min(n, max(longest // 2, self.least))):
            h = self._hashed(level, b, w)
            first = max(0, was - b + 1)  # the first window that ends in an appended word
            s, e = self._caught(h, b, first)
            if len(s):
                self._follow(s, e, b)
            level, b = level + 1, 2 * b

    def _hashed(self, level: int, b: int, w: np.ndarray) -> np.ndarray:
        if level == len(self.hashes):
            self.hashes.append(Grown(np.uint64))
        mine = self.hashes[level]
        todo = slice(mine.n, len(w) - b + 1)
        if level == 0:
            mine.append(mix(w[todo].astype(np.uint64) + np.uint64(1)))
        else:
            half = self.hashes[level - 1].held
            left, right = half[todo], half[b // 2 :][todo]
            mine.append(mix(left * np.uint64(0x9E3779B97F4A7C15) + right))
        return mine.held

    def _caught(self, h: np.ndarray, b: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of blocks and of windows equal to them, where the block before and its window differ."""
        found = []
        e = np.arange(max(first, 2 * b - 1), len(h))
        near = (e - (2 * b - 1)) // b * b
        for s, at in ((near, e), (near[near >= b] - b, e[near >= b])):
            hit = np.flatnonzero(h[s] == h[at])
            found.append((s[hit], at[hit]))
        for p in (p for p, block in self.short.items() if block == b):
            s = np.arange(max(0, first - p + b - 1) // b * b, len(h) - p, b)
            s = s[h[s] == h[s + p]]
            found.append((s, s + p))
        s, e = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        again = s >= b
        again[again] = h[s[again] - b] == h[e[again] - b]
        return s[~again], e[~again]

    def _follow(self, s: np.ndarray, e: np.ndarray, b: int) -> None:
        """Compare the words on both sides of the matches, all at once for NEAR words, one match at a time beyond."""
        w, n, p = self.words.held, self.words.n, e - s
        for i, end, q in [(i, end, q) for (i, end), q in self.runs.items()] + [(i, n, q) for q, i in self.open.items()]:
            if end - i >= 8 * q:  # long runs hold many squares of multiples of their period
                out = (s >= i) & (e + b <= end) & (p % q == 0)
                s, e, p = s[~out], e[~out], p[~out]
        start, stop = s.copy(), s + b
        left = right = np.arange(len(s))
        for _ in range(NEAR):
            left = left[start[left] > 0]
            left = left[w[start[left] - 1] == w[start[left] - 1 + p[left]]]
            start[left] -= 1
            right = right[stop[right] + p[right] < n]
            right = right[w[stop[right]] == w[stop[right] + p[right]]]
            stop[right] += 1
        far = stop + p == n
        far[left] = far[right] = True
        for k in np.flatnonzero(far | (stop - start >= np.maximum(self.least - p, p))).tolist():
            i, j, period = int(start[k]), int(stop[k]), int(p[k])
            if self.open.get(period, n) <= i or not np.array_equal(w[i:j], w[i + period : j + period]):
                continue  # known, or unequal words with one hash
            if far[k]:
                i, j = self._left(i, period), self._right(j, period)
            if j + period == n:
                self.open[period] = i
            else:
                self._close(i, j + period, period)

    def _left(self, i: int, p: int) -> int:
        w, step = self.words.held, 32
        while i > 0:
            low = max(0, i - step)
            differ = np.flatnonzero(w[low:i] != w[low + p : i + p])
            if len(differ):
                return low + int(differ[-1]) + 1
            i, step = low, 2 * step
        return 0

    def _right(self, i: int, p: int) -> int:
        w, step, end = self.words.held, 32, self.words.n - p
        while i < end:
            high = min(end, i + step)
            differ = np.flatnonzero(w[i:high] != w[i + p : high + p])
            if len(differ):
                return i + int(differ[0])
            i, step = high, 2 * step
        return end

    def _advance(self, was: int) -> None:
        """Compare the appended words of the stretches that reached the end."""
        for p, start in list(self.open.items()):
            stop = self._right(was - p, p)
            if stop + p < self.words.n:
                del self.open[p]
                self._close(start, stop + p, p)

    def _close(self, start: int, end: int, p: int) -> None:
        if end - start >= max(self.least, 2 * p):
            self.runs[start, end] = min(p, self.runs.get((start, end), p))

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start, then period. No words may follow."""
        for p, start in self.open.items():
            self._close(start, self.words.n, p)
        self.open = {}
        return sorted((i, end - i, p) for (i, end), p in self.runs.items())


def runs_of(texts: list[list], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, a list of words. One catcher takes all texts."""
    out: list[list] = [[] for _ in texts]
    longest = max(map(len, texts), default=0)
    if longest < least:
        return out
    words = [w for t in texts for w in t]
    number = dict(zip(words, range(len(words))))
    begin = np.cumsum([0, *map(len, texts)])
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    ids = np.insert(ids, begin[1:], np.arange(len(words), len(words) + len(texts)))  # a word of its own ends each text
    begin += np.arange(len(texts) + 1)
    catcher = SquareCatcher(least)
    catcher.append(ids, longest)
    for start, length, period in catcher.finish():
        k = int(np.searchsorted(begin, start, "right")) - 1
        out[k].append((start - int(begin[k]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside repeats, joined by one space: of each run only its first period stays, unless another run drops it."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(id, runs, collapsed) of every row: its periodic runs of `least` words or more, by start, then period, and the text
    without their repeats, words joined by one space.

    Words are what stands between spaces and 0x09-0x0D. Null, empty and short texts have no runs; a null text is empty.
    Null ids stay null, repeated rows are answered each, an empty table gives an empty one, and other columns play no
    part. Runs never tie: no two have the same stretch. A text is searched where it is, whole, with memory for some
    hundred bytes a word; nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows: tuple[list, list] = ([], [])
            texts = [(text or b"").split() for text in b.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                end, n = at + 1, len(texts[at])
                while end < len(texts) and n + len(texts[end]) <= TOGETHER:
                    end, n = end + 1, n + len(texts[end])
                for words, runs in zip(texts[at:end], runs_of(texts[at:end], least)):
                    rows[0].append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    rows[1].append(collapsed(words, runs))
                at = end
            kept = pa.array(rows[1], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], RUNS_ARROW), kept], names=[id_col, "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, runs {RUNS}, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth text (by crc32 of its id) repeats the words from some place on to its end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n = F.size("words")
    d = d.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", source(i).cast("int")))
    return d.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, a tenth of them with planted repeats; the longest one and digests of all and of the rest."""
    d = periodic_runs(with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    d = d.withColumn("longest", longest)
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.less")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.less") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
