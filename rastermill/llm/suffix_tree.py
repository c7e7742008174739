"""Language-model scoring by a probabilistic suffix tree over words, and over the bytes of words below its root."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remainder, table

#: Symbol before the first and after the last byte of a word; no word holds it.
STOP = 0x20
#: Added to each count, and the tokens beyond the known ones, in the base score (fixed values of the contract).
ADD, BEYOND = 0.1, 1


def word_counts(docs: DataFrame, text_col: str = "text", flush: int = 400_000) -> DataFrame:
    """(word binary, n_train long): occurrences in rows where `train` holds, of all words of all rows, lower case A-Z.

    Tasks count words of their own in a table of bounded size before anything is shuffled.
    """

    def run(batches):
        train, rest = Counter(), Counter()

        def out():
            words = [*train, *(w for w in rest if w not in train)]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64())], names=["word", "n"])
            train.clear()
            rest.clear()
            return batch

        for b in batches:
            for text, is_train in zip(b.column(0), b.column(1).to_pylist()):
                words = (text.as_py() or "").encode().lower().split()
                (train if is_train else rest).update(words)
                if len(train) + len(rest) >= flush:
                    yield out()
        yield out()

    return docs.select(text_col, "train").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n_train"))


def context_counts(words: DataFrame, depth: int) -> DataFrame:
    """(d, ctx, sym, n): how often symbol sym follows the d bytes ctx (packed, the last byte lowest) in the distinct
    training words (a word's own frequency is the root's business, so spelling learns from each word once).

    Before a word stands STOP, as often as the context is long, and STOP ends it.
    """

    def run(batches):
        for b in batches:
            data = b.column(0).to_pylist()
            lens = np.fromiter(map(len, data), np.int64, len(data))
            sizes = lens + 1 + depth
            flat = np.frombuffer(b"".join(b"\x20" * depth + w + b"\x20" for w in data), np.uint8).astype(np.int64)
            if not len(flat):
                continue
            at = np.ones(len(flat), bool)
            starts = np.cumsum(sizes) - sizes
            for j in range(depth):
                at[starts + j] = False
            pos = np.flatnonzero(at)
            key = np.zeros(len(pos), np.int64)
            for j in range(depth, -1, -1):
                key = key << 8 | flat[pos - j]
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 8), pa.array((key & 255).astype(np.int32)), pa.array(n)], names=["ctx", "sym", "n"])

    top = words.filter("n_train > 0").select("word").mapInArrow(run, "ctx long, sym int, n long").groupBy("ctx", "sym").agg(F.sum("n").alias("n"))
    by_depth = top.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "ctx", "sym", "n")
    return by_depth.groupBy("d", F.expr("ctx & (shiftleft(1L, 8 * d) - 1)").alias("ctx"), "sym").agg(F.sum("n").alias("n"))


def suffix_tree(words: DataFrame, depth: int = 6, least_share: float = 2e-6, least_gain: float = 1.0) -> dict[tuple[int, int], dict[int, int]]:
    """The retained contexts with their next-symbol counts: {(d, ctx): {symbol: n}}.

    A context stays if it makes up `least_share` of all positions and what follows it diverges from what follows its
    own suffix: n times the Kullback-Leibler divergence is at least `least_gain` nats for each symbol seen after it.
    Suffixes of kept contexts are kept. At most depth / least_share contexts can pass the first test, which bounds what
    the driver and the broadcast hold, whatever the size of the corpus.
    """
    c = cut(context_counts(words, depth), "contexts")
    total = c.filter("d = 0").agg(F.sum("n")).first()[0] or 0
    nodes = c.groupBy("d", "ctx").agg(F.sum("n").alias("total")).filter(F.col("total") >= least_share * total)
    kept = cut(c.join(nodes, ["d", "ctx"]), "nodes")
    up = kept.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("up"), "sym", F.col("n").alias("up_n"), F.col("total").alias("up_total"))
    gain = kept.withColumn("up", F.expr("ctx & (shiftleft(1L, 8 * (d - 1)) - 1)")).filter("d > 0").join(up, ["d", "up", "sym"])
    kl = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") * F.col("up_total") / F.col("up_n")))
    tested = gain.groupBy("d", "ctx").agg(kl.alias("gain"), F.count("*").alias("kinds")).filter(F.col("gain") >= least_gain * F.col("kinds"))
    chain = tested.select(F.explode(F.expr("sequence(0, d)")).alias("d"), "ctx")  # with every suffix
    wanted = chain.select("d", F.expr("ctx & (shiftleft(1L, 8 * d) - 1)").alias("ctx")).union(c.sparkSession.sql("SELECT 0 AS d, 0L AS ctx")).distinct()
    tree: dict[tuple[int, int], dict[int, int]] = {}
    for r in kept.join(wanted, ["d", "ctx"]).select("d", "ctx", "sym", "n").toLocalIterator():
        tree.setdefault((r.d, r.ctx), {})[r.sym] = r.n
    return tree


class Scorer:
    """log10 probability of words: each symbol by the longest retained suffix of what came before, smoothed by the
    shorter ones (Witten-Bell) down to a uniform byte. The tree is sorted arrays by depth: all symbols of a batch of words
    are looked up together, equal (context, symbol) pairs once."""

    def __init__(self, tree: dict[tuple[int, int], dict[int, int]], depth: int):
        self.depth, self.levels = depth, []
        for d in range(depth + 1):
            nodes = sorted((ctx, sum(v.values()), len(v)) for (k, ctx), v in tree.items() if k == d)
            edges = sorted((ctx << 8 | sym, n) for (k, ctx), v in tree.items() if k == d for sym, n in v.items())
            self.levels.append([*(np.array(x, np.int64) for x in zip(*nodes)), *(np.array(x, np.int64) for x in zip(*edges))] if nodes else None)

    def probability(self, ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Of each symbol after its `depth` bytes (packed, the last byte lowest)."""
        p = np.full(len(ctx), 1 / 256)
        for d, level in enumerate(self.levels):
            if level is None:
                break
            at, total, kinds, edges, n = level
            own = ctx & ((1 << 8 * d) - 1)
            k = np.searchsorted(at, own).clip(max=len(at) - 1)
            e = np.searchsorted(edges, own << 8 | sym).clip(max=len(edges) - 1)
            new = (np.where(edges[e] == own << 8 | sym, n[e], 0) + kinds[k] * p) / (total[k] + kinds[k])
            p = np.where(at[k] == own, new, p)  # retained contexts are closed under suffixes
        return p

    def words(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        flat = np.frombuffer(b"".join(b"\x20" * self.depth + w + b"\x20" for w in words), np.uint8).astype(np.int64)
        pos = np.arange(sizes.sum()) + self.depth * np.repeat(np.arange(1, len(words) + 1), sizes)
        key = np.zeros(len(pos), np.int64)
        for j in range(self.depth, -1, -1):
            key = key << 8 | flat[pos - j]
        key, back = np.unique(key, return_inverse=True)
        logs = np.log10(self.probability(key >> 8, key & 255))
        return np.add.reduceat(logs[back], np.cumsum(sizes) - sizes)


def next_counts(texts: DataFrame, known: Broadcast, contexts: Broadcast, flush: int = 4_000_000) -> DataFrame:
    """(key long, n long): how often the symbol key % size follows the context key // size, the longest kind of context that
    `contexts` has numbers for (see WordContexts.at()); symbols are the `known` words and the text's end, which also stands
    before its first word; size = known words + 1. Tasks count in bounded buffers before anything is shuffled."""

    def run(batches):
        get, tree, end = known.value.get, contexts.value, len(known.value)
        parts, held = [], 0

        def out():
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

        for b in batches:
            for k in range(0, len(b), 256):
                flat = []
                for text in b.column(0).slice(k, 256):
                    flat += [get(w, -1) for w in (text.as_py() or "").encode().lower().split()]
                    flat.append(end)
                ids = np.array(flat, np.int64)
                at = tree.at(ids)[0][-1]
                ok = (at >= 0) & (ids >= 0)
                parts.append(at[ok] * (end + 1) + ids[ok])
                held += len(ids)
                if held >= flush:
                    yield out()
                    held = 0
        if parts:
            yield out()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class WordContexts:
    """Next-word states after the last one, two, three ... words: contexts that grow by one word a level.

    A context stays if what follows it diverges from what its own suffix, a word shorter, says: n times the
    Kullback-Leibler divergence over its counted followers is at least `least_gain` nats for each of them. Followers that
    are not counted, and one count for each that is (Witten-Bell), go to the shorter context, down to the root, so the
    probabilities after a context add up to 1. Contexts of the next level are the counted (context, follower) pairs.
    """

    def __init__(self, totals: np.ndarray, root: np.ndarray):
        self.size, self.root, self.plain = len(root), root, 10.0**root
        self.totals, self.levels = totals, []  # of the contexts that the next level is about

    def at(self, ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(contexts, entries) by level, for the symbols of texts one after another, each with its end: the number of the
        context before each symbol (one level more than counted), and of the counted (context, symbol); -1: there is none."""
        end = self.size - 1
        before = np.concatenate(([end], ids[:-1]))  # an end stands before a first word
        first = before == end
        out, entries = [before], []
        for key, _, _ in self.levels:
            found = np.full(len(ids), -1)
            if len(key):
                ok = np.flatnonzero((before >= 0) & (ids >= 0))
                want = before[ok] * self.size + ids[ok]
                k = np.searchsorted(key, want).clip(max=len(key) - 1)
                found[ok] = np.where(key[k] == want, k, -1)
            before = np.concatenate(([-1], found[:-1]))
            before[first] = -1  # no longer context runs over a text's end
            entries.append(found)
            out.append(before)
        return out, entries

    def probabilities(self, ids: np.ndarray, at: tuple[list[np.ndarray], list[np.ndarray]]) -> np.ndarray:
        """Of each symbol; of one not known (-1) the share that its contexts leave to the root."""
        p = np.where(ids >= 0, self.plain[ids], 1.0)
        for before, entry, (key, share, left) in zip(*at, self.levels):
            if len(key):
                p = np.where(before >= 0, left[before] * p, p) + np.where(entry >= 0, share[entry], 0.0)
        return p

    def grow(self, key: np.ndarray, n: np.ndarray, least_gain: float) -> None:
        """Add a level: n times the symbol key % size followed the context key // size of the last level."""
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.float64)
        before, after = key // self.size, key % self.size
        m, totals = len(self.totals), np.maximum(self.totals, 1)
        lower = self.plain[after]  # what the shorter contexts say: those that end like this one
        chain = self._suffixes(before)
        for back, (k, share, left) in zip(chain, self.levels):
            want = back * self.size + after
            j = np.searchsorted(k, want).clip(max=max(len(k) - 1, 0))
            hit = np.where((back >= 0) & (k[j] == want), share[j], 0.0) if len(k) else 0.0
            lower = np.where(back >= 0, left[back] * lower, lower) + hit
        kinds, kept = np.bincount(before, minlength=m), np.bincount(before, n, m)
        gain = np.bincount(before, n * np.log(n / totals[before] / lower), m)
        stays = (kinds > 0) & (gain >= least_gain * kinds)
        left = np.where(stays, (np.maximum(totals - kept, 0) + kinds) / np.maximum(np.maximum(totals, kept) + kinds, 1), 1.0)
        share = np.where(stays[before], n / (np.maximum(totals, kept)[before] + kinds[before]), 0.0)
        self.levels.append((key, share, left))
        self.totals = n

    def _suffixes(self, number: np.ndarray) -> list[np.ndarray]:
        """By level below the last, the numbers of the contexts that end like the given ones of the last level."""
        if not self.levels:
            return []
        words = []  # of the context, the last first
        at = number
        for key, _, _ in reversed(self.levels):
            words.append(key[at] % self.size if len(key) else at)
            at = key[at] // self.size if len(key) else at
        words.append(at)
        out = [words[0]]
        for d in range(1, len(self.levels)):  # the context of the last d + 1 words, found from its first word on
            c = words[d]
            for j, (key, _, _) in zip(range(d - 1, -1, -1), self.levels):
                want = c * self.size + words[j]
                k = np.searchsorted(key, want).clip(max=max(len(key) - 1, 0))
                c = np.where((c >= 0) & (key[k] == want), k, -1) if len(key) else np.full(len(c), -1)
            out.append(c)
        return out

    def score(self, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol of texts one after another, each with its end; of those not known (-1) only what
        their contexts leave to the root."""
        return np.log10(self.probabilities(ids, self.at(ids)))


def score_texts(docs: DataFrame, depth: int = 6, least_share: float = 2e-6, least_gain: float = 1.0, frequent: float = 5e-7, least_count: int = 3, follower_share: float = 1e-7, most_words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows whose `train` holds.

    Words are white-space runs, lower case A-Z, and each row ends with one end token. At the root of the tree a whole
    word is one symbol: its count, smoothed (Witten-Bell) by the product of its bytes' probabilities, each by the longest
    retained suffix of the bytes before; going on and ending follow their counts. Above the root, the last one to
    most_words words (or the text's start) are contexts, the longest that diverge from their suffixes: see WordContexts.
    Base is the unigram score with ADD.
    Counts, vocabulary and tree cover all training rows. Words that make up `frequent` of the training tokens (at most
    1 / frequent of them) go to tasks as a broadcast; rarer ones meet their counts in a join by word, so no word's group
    is large there. A follower of a context is counted from least_count occurrences on, so what is gathered grows with the
    input, up to the bound of what the driver and tasks hold: followers that make up less than follower_share of the
    training tokens are left out, at most 1 / follower_share a level. Null text is empty, very long ones are scored whole;
    null ids stay null; repeated rows are scored each and counted each; an empty table, or one
    without training rows, gives defined results (everything unknown); other columns play no part.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    counts = cut(word_counts(docs), "words")
    ends = docs.filter("train").count()
    sums = counts.agg(F.sum("n_train"), F.count_if(F.col("n_train") > 0)).first()
    n, v, kinds = (sums[0] or 0) + ends, sums[1] + (ends > 0), max(1, sums[1])
    tree = suffix_tree(counts, depth, least_share, least_gain)
    model = spark.sparkContext.broadcast((tree, depth))
    go_on = math.log10((n - ends + 1) / (n + 2))
    stop = math.log10((ends + 1) / (n + 2))
    below = math.log10(n + ADD * (v + BEYOND)) if n else math.log10(ADD)

    def score_words(batches):
        scorer = Scorer(*model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scorer.words(b.column(0).to_pylist()), pa.float64())], names=["word", "n_train", "tree"])

    vocabulary = counts.mapInArrow(score_words, "word binary, n_train long, tree double")
    root = F.log10((F.col("n_train") + kinds * F.pow(F.lit(10.0), F.col("tree"))) / (n - ends + kinds)) + go_on
    vocabulary = cut(vocabulary.withColumns({"base": F.log10(F.col("n_train") + ADD) - below, "tree": root}), "vocabulary")
    common = [(bytes(r.word), r.n_train, r.base, r.tree) for r in vocabulary.filter(F.col("n_train") >= max(1.0, frequent * n)).toLocalIterator()] if n else []
    known_b = spark.sparkContext.broadcast({w: k for k, (w, *_) in enumerate(common)})
    totals, base, root = (np.array([*(c[k] for c in common), last], float) for k, last in ((1, ends), (2, math.log10(ends + ADD) - below), (3, stop)))
    contexts = WordContexts(totals, root)
    for _ in range(most_words):
        so_far = spark.sparkContext.broadcast(contexts)
        counted = next_counts(docs.filter("train").select("text"), known_b, so_far).filter(F.col("n") >= max(least_count, follower_share * n)).toArrow()
        contexts.grow(counted["key"].to_numpy(), counted["n"].to_numpy(), least_gain)
    contexts_b = spark.sparkContext.broadcast((contexts, base))
    names = ["row", "key", "id", "train", "n_tokens", "n_known", "base", "tree", "times"]
    id_kind = docs.schema["id"].dataType.simpleString()

    def parts(batches):
        """For each row of docs: one row with what the frequent words give (its key holds a space: no word), and one for each rare word."""
        known, (contexts, base), at = known_b.value, contexts_b.value, TaskContext.get().partitionId() << 40
        get, end = known.get, len(known)
        for b in batches:
            for k in range(0, len(b), 256):
                some, flat, lens = b.slice(k, 256), [], []
                for text in some.column(1):
                    words = (text.as_py() or "").encode().lower().split()
                    flat += words
                    flat.append(b"")  # the text's end
                    lens.append(len(words) + 1)
                ids, sizes = np.array([get(w, -1) for w in flat], np.int64), np.array(lens, np.int64)
                starts, lasts = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
                ids[lasts] = end
                here = ids >= 0
                sums = lambda x: pa.array(np.add.reduceat(x, starts))
                rows = at + np.arange(len(some)) + 1
                at += len(some)
                own = [pa.array([b" %d" % r for r in rows.tolist()], pa.binary()), some.column(0), some.column(2), pa.array(sizes), sums(here - (ids == end) * int(ends == 0))]
                yield batch(rows, [*own, sums(np.where(here, base[ids], 0.0)), sums(contexts.score(ids)), pa.nulls(len(some), pa.int64())])
                rare = np.flatnonzero(~here)
                if len(rare):
                    words = pa.array([flat[i] for i in rare.tolist()], pa.binary()).dictionary_encode()
                    kinds = len(words.dictionary)
                    pair, times = np.unique(np.searchsorted(lasts, rare) * kinds + words.indices.to_numpy(), return_counts=True)
                    none = [pa.nulls(len(pair), c.type) for c in (some.column(0), some.column(2))]
                    numbers = [pa.nulls(len(pair), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield batch(rows[pair // kinds], [words.dictionary.take(pa.array(pair % kinds)), *none, *numbers, pa.array(times)])

    def batch(rows, columns):
        return pa.RecordBatch.from_arrays([pa.array(rows), *columns], names=names)

    split = docs.mapInArrow(parts, f"row long, key binary, id {id_kind}, train boolean, n_tokens long, n_known long, base double, tree double, times long")
    right = vocabulary.select(F.col("word").alias("key"), F.col("n_train"), F.col("base").alias("w_base"), F.col("tree").alias("w_tree"))
    joined = split.join(right, "key", "left").groupBy("row").agg(
        F.max("id").alias(id_col), F.max("train").alias("train"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("n_train") > 0, F.col("times")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("times") * F.col("w_base"))).alias("base_score"), F.sum(F.coalesce("tree", F.col("times") * F.col("w_tree"))).alias("score"),
    )
    return joined.select(id_col, "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 of the id is not 0 modulo 10."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 10) != 0).alias("train"))
    return score_texts(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
