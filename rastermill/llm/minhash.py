"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE, WordHash, components, cut, held, shingles, table, text_key

#: Bits of the hashed document-frequency counters, and of the table of random variates.
DF_BITS, VARIATE_BITS = 18, 16
#: Up to this many ids (numbers) are broadcast to pick the texts to verify; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Texts of a bucket that are compared with as many others in one group.
BLOCK = 1000


def document_frequencies(docs: DataFrame, bits: int = DF_BITS) -> tuple[int, np.ndarray]:
    """(documents, counters): how many documents have a shingle in each of 2**bits classes of shingles.

    A sketch of fixed size that covers every document and merges by addition: tasks add up their own, the sums go to the
    driver (2**bits numbers, whatever the size of the corpus). Classes share counters, so frequencies of rare shingles
    are estimates from above, alike for the same shingle everywhere.
    """

    def run(batches):
        hashes, sums, n = WordHash(), np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for x in b.column(0):
                n += 1
                sums[np.unique((shingles(x.as_py(), hashes) >> np.uint64(64 - bits)).astype(np.int64))] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(sums[at], n))], names=["k", "n"])

    got = docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    out = np.zeros(1 << bits, np.int64)
    out[k[k >= 0]] = n[k >= 0]
    return int(n[k < 0].sum()), out


class Weights:
    """TF-IDF weights of a text's distinct shingles, and their consistent samples."""

    def __init__(self, documents: int, df: np.ndarray, samples: int, seed: int):
        self.shift = np.uint64(64 - int(len(df)).bit_length() + 1)
        self.idf = np.log1p(documents / np.maximum(df, 1)).astype(np.float64)
        rng = np.random.default_rng(seed)
        shape = (1 << VARIATE_BITS, samples)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.hashes = WordHash()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        h, tf = np.unique(shingles(text, self.hashes), return_counts=True)
        return h, tf * self.idf[(h >> self.shift).astype(np.int64)]

    def sample(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each of the samples the chosen (shingle, level) as a 32-bit hash. Ioffe's scheme: level t = floor(ln w / r
        + beta), and the shingle with least ln a = ln c - r * (t - beta + 1) is chosen. Long texts go in slices."""
        best, chosen = np.full(self.r.shape[1], np.inf, np.float32), np.zeros(self.r.shape[1], np.uint64)
        for a in range(0, len(h), 4096):
            x, row = h[a : a + 4096], (h[a : a + 4096] & np.uint64((1 << VARIATE_BITS) - 1)).astype(np.int64)
            r, beta = self.r[row], self.beta[row]
            t = np.floor(np.log(w[a : a + 4096]).astype(np.float32)[:, None] / r + beta)
            ln_a = self.ln_c[row] - r * (t - beta + 1)
            k = ln_a.argmin(axis=0)
            cols = np.arange(len(k))
            new = ln_a[k, cols] < best
            best = np.where(new, ln_a[k, cols], best)
            chosen = np.where(new, x[k] * np.uint64(2654435761) + t[k, cols].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), chosen)
        return (chosen >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _weights(documents: int, df: bytes, samples: int, seed: int) -> Weights:
    return held(("weights", documents, df, samples, seed), lambda: Weights(documents, np.frombuffer(df, np.int64), samples, seed))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def text_classes(docs: DataFrame, bands: int = 9, rows: int = 3, reps: int = 8, threshold: float = NEAR, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """((doc_id, key) of every row with words; (key, rep, class_id, keep) of every distinct text).

    key: see text_key(). rep: the smallest doc_id that comes with the text (null where none has one). Texts are linked
    from a weighted Jaccard similarity of their TF-IDF shingles of `threshold`; classes are the connected texts, class_id
    is the smallest rep of a class, and one text of each class is to keep: that with the smallest rep, then key.
    Candidates share `rows` samples in one of `bands` bands. In a bucket every text is paired with up to `reps`
    representatives (the least keys of `reps` classes of keys); pairs whose samples agree in half the positions are
    verified on whole texts. Pairs with a bucket's first representative are verified first, then those others that
    would join two classes. Texts of a bucket that are then still in several classes all meet: their samples are
    compared in blocks of about BLOCK texts, each pair of blocks a group of its own, and pairs of two classes that
    agree are verified there as well, so no link within a bucket is lost. That comparison grows with the square of a
    bucket's texts that no representative has joined; the rows that leave a group are no more than its texts.
    """
    spark, samples = docs.sparkSession, bands * rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text").withColumn("key", text_key(F.col("text"))).filter("key IS NOT NULL")
    documents, df = document_frequencies(docs)
    shared = spark.sparkContext.broadcast((documents, df.tobytes(), samples, seed))

    def sketch(batches):
        weights = _weights(*shared.value)
        for b in batches:
            sigs = [weights.sample(*weights.of(x.as_py())) for x in b.column(2)]
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int32)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * samples), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sig], names=["doc_id", "key", "sig"])

    sketches = cut(docs.select("doc_id", "key", "text").mapInArrow(sketch, f"doc_id {kind}, key binary, sig array<int>"), "sketches")
    one = cut(sketches.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "texts")
    band = F.explode(F.array(*[F.xxhash64(F.lit(k), *[F.col("sig")[k * rows + j] for j in range(rows)]) for k in range(bands)]))
    members = cut(one.select("key", band.alias("bucket")), "buckets")
    salted = members.groupBy("bucket", F.pmod(F.xxhash64("key"), F.lit(reps)).alias("salt")).agg(F.min("key").alias("head"), F.count("*").alias("n"))
    full = salted.groupBy("bucket").agg(F.min("head").alias("first"), F.collect_list("head").alias("head"), F.sum("n").alias("n")).filter("n > 1")
    full = full.select("bucket", "first", F.explode("head").alias("head"))
    near = members.join(full, "bucket").filter("key <> head").select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b"), (F.col("head") == F.col("first")).alias("star"))
    near = near.groupBy("a", "b").agg(F.max("star").alias("star"))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    sig = lambda x: one.select(F.col("key").alias(x), F.col("sig").alias(f"sig_{x}"))
    pairs = cut(near.join(sig("a"), "a").join(sig("b"), "b").filter(agree >= samples // 2).select("a", "b", "star"), "pairs")

    def verify(batches):
        weights = _weights(*shared.value)
        for b in batches:
            ok = pa.array([weighted_jaccard(weights.of(x.as_py()), weights.of(y.as_py())) >= threshold for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    def texts_of(asked: DataFrame) -> DataFrame:
        """(key, text) of the keys asked for."""
        asked = cut(asked.join(one.select("key", "rep"), "key").select(F.col("key").alias("k"), "rep"), "asked")
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
        needed = docs.join(asked, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "text")
        return cut(needed.dropDuplicates(["key"]), "needed")

    def verified(some: DataFrame) -> DataFrame:
        needed = texts_of(some.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        both = some.join(needed.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(needed.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
        return cut(both.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary"), "links")

    def merge(classes: DataFrame, joins: DataFrame) -> DataFrame:
        """The classes after those pairs (a, b) of classes are joined."""
        merged = components(joins).select(F.col("node").alias("class_id"), F.col("class_id").alias("into"))
        nodes = classes.union(merged.select(F.col("class_id").alias("node"), "class_id")).distinct()
        return cut(nodes.join(merged, "class_id", "left").groupBy("node").agg(F.min(F.coalesce("into", "class_id")).alias("class_id")), "merged")

    classes = components(verified(pairs.filter("star")))
    at = lambda x: classes.select(F.col("node").alias(x), F.col("class_id").alias(f"{x}_class"))
    rest = pairs.filter("NOT star").join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", F.coalesce("a_class", "a").alias("x"), F.coalesce("b_class", "b").alias("y"))
    rest = cut(rest.filter("x <> y"), "rest")
    if not rest.isEmpty():
        classes = merge(classes, verified(rest.select("a", "b")).join(rest, ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b")))
    # texts of a bucket that are no heads of it and still in several classes: all of them meet, in blocks
    met = full.select("bucket", F.col("head").alias("key"))
    alone = members.join(met, ["bucket", "key"], "left_anti").join(at("key"), "key", "left")
    alone = cut(alone.select("bucket", "key", F.coalesce("key_class", "key").alias("class")), "alone")
    several = alone.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("least"), F.max("class").alias("most")).filter("least < most")
    several = several.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = alone.join(several, "bucket").join(one.select("key", "sig"), "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "class", "sig")

    def alike(t: pa.Table) -> tuple[np.ndarray, ...]:
        """The pairs of rows of different classes whose samples agree, those that agree most first: of one block, or of one
        block with the other. With the number of each row's class."""
        sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, samples)
        block = t.column("block").to_numpy()
        of = t.column("class").combine_chunks().dictionary_encode().indices.to_numpy()
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        first, second = np.flatnonzero(block == p), np.flatnonzero(block == q)
        x, y, z = [], [], []
        for i in first:
            j = second[second > i] if p == q else second
            same = (sig[j] == sig[i]).sum(axis=1)
            ok = (same >= samples // 2) & (of[j] != of[i])
            x.append(np.full(ok.sum(), i))
            y.append(j[ok])
            z.append(same[ok])
        i, j, n = (np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for v in (x, y, z))
        order = np.argsort(-n, kind="stable")
        return i[order], j[order], of

    def in_pairs(t: pa.Table) -> pa.Table:
        i, j, _ = alike(t)
        return t.drop_columns("sig").take(pa.array(np.union1d(i, j)))

    def joined(t: pa.Table) -> pa.Table:
        """The pairs of classes that verified pairs of their texts join. Pairs of texts whose classes are joined by then need no
        verification, so the links are fewer than the classes."""
        i, j, of = alike(t)
        weights, known, up = _weights(*shared.value), {}, list(range(int(of.max()) + 1))
        text, name = t.column("text"), t.column("class")

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        def of_text(k: int):
            if k not in known:
                if len(known) >= 500:
                    known.clear()
                known[k] = weights.of(text[k].as_py())
            return known[k]

        links = []
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = root(int(of[a])), root(int(of[b]))
            if x != y and weighted_jaccard(of_text(a), of_text(b)) >= threshold:
                up[y] = x
                links.append((a, b))
        return pa.table({c: name.take(pa.array([x[k] for x in links], pa.int64())) for k, c in enumerate("ab")})

    if not several.isEmpty():
        group = ["bucket", "p", "q"]
        some = cut(dealt.groupBy(*group).applyInArrow(in_pairs, "bucket long, p int, q int, block int, key binary, class binary"), "some")
        if not some.isEmpty():
            sigs = some.join(one.select("key", "sig"), "key").join(texts_of(some.select("key").distinct()), "key")
            classes = merge(classes, cut(sigs.groupBy(*group).applyInArrow(joined, "a binary, b binary"), "joined").distinct())
    linked = one.select("key", "rep").join(classes.select(F.col("node").alias("key"), F.col("class_id").alias("class")), "key", "left")
    linked = cut(linked.withColumn("class", F.coalesce("class", "key")), "linked")
    first = linked.groupBy("class").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("first"))
    both = linked.join(first, "class").select("key", "rep", F.col("first.rep").alias("class_id"), (F.col("key") == F.col("first.key")).alias("keep"))
    return sketches.select("doc_id", "key"), cut(both, "classes")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id): one row for each row of docs; class_id is the smallest doc_id of the class. Options: text_classes().

    Equal texts are one text (texts of the same words have a similarity of 1), so a doc_id that comes with several texts has a row for each,
    in classes of their own. Texts without a word are classes of their own: class_id is doc_id. A null doc_id gets the
    class_id of its text's class, null if no member has an id. Repeated rows get a row each. Very long texts are sampled
    whole, in slices. An empty table gives an empty one; other columns play no part, whatever their names.
    """
    ids, classes = text_classes(docs, **options)
    none = docs.select("doc_id", text_key(F.col("text")).alias("key")).filter("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return ids.join(classes.select("key", "class_id"), "key").select("doc_id", "class_id").union(none)


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near-duplicates, all columns as they were: of each class one row of one text (see
    text_classes()), all rows whose text has no words. What is dropped is decided by row and text, so another text with the
    same doc_id stays. Up to BROADCAST_IDS dropped (doc_id, text) pairs are broadcast, more meet the rows in a shuffle."""
    ids, classes = text_classes(docs, **options)
    k = "k" * (1 + max(map(len, docs.columns)))
    each = ids.groupBy("doc_id", "key").agg(F.count("*").alias("n")).join(classes, "key")
    each = cut(each.select(F.col("doc_id").alias(f"{k}1"), F.col("key").alias(f"{k}2"), "n", (F.col("keep") & F.col("doc_id").eqNullSafe(F.col("rep"))).alias("keep")), "verdicts")
    keyed = docs.withColumn(k, text_key(F.col("text")))

    def among(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = F.broadcast(some) if some.count() <= BROADCAST_IDS else some
        return rows.join(some, (F.col(k) == F.col(f"{k}2")) & F.col("doc_id").eqNullSafe(F.col(f"{k}1")), how)

    kept = among(keyed, each.filter("NOT keep").select(f"{k}1", f"{k}2"), "left_anti")
    again = each.filter("keep AND n > 1").select(f"{k}1", f"{k}2")
    if not again.isEmpty():  # repeated rows of a text that stays
        kept = among(kept, again, "left_anti").union(among(kept, again, "left_semi").dropDuplicates(["doc_id", k]))
    return kept.select(*docs.columns)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
