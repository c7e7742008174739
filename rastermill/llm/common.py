"""What the corpus operators share: shared-folder writes, word hashing, classes from links."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space and 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]+"
#: Words in a shingle and the similarity from which two word sets are near-duplicates.
SHINGLE, NEAR = 5, 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder. Where neither is
    set, one of our own if the master is local (no other machine then has to see it), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="rastermill-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and a lost executor costs one stage at most."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text):
    """16 bytes that equal texts share; null for a text without words. Texts that differ in case or white space alone have
    keys of their own and are found to be alike by their shingles."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text.cast("binary"))))


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: equal inputs stay equal, others look independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_held: dict = {}


def held(what, make):
    """What make() gives, kept in the worker for the next task that asks for the same. One thing is kept: a worker lives
    through the jobs of several operators, and the tables of the last one make room for those of the next."""
    if what not in _held:
        _held.clear()
        _held[what] = make()
    return _held[what]


class WordHash(dict):
    """64-bit hash of each word (bytes); remembers a bounded number of words."""

    bound = 300_000

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word) << 32 | zlib.crc32(word[::-1], 0x9E3779B9)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h


def shingles(text: str | None, hashes: WordHash, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words (lower case, by white space) in order; one for a shorter text, none without words."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    return mix(h)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, class_id) of every node in links (a, b): the smallest node it is connected with.

    Minimum labels pass along links and through the label's own label, so the rounds grow with the logarithm of a
    class's diameter. Each round is written to the shared folder; only the number of changes reaches the driver.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("class_id")), "label")
    for _ in range(rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("class_id").alias("near"))
        step = label.join(near, label.node == near.a, "left").select("node", F.col("class_id").alias("was"), F.least("class_id", "near").alias("class_id"))
        own = label.select(F.col("node").alias("class_id"), F.col("class_id").alias("up"))
        new = cut(step.join(own, "class_id", "left").select("node", "was", F.least("class_id", "up").alias("class_id")), "label")
        if new.filter("class_id < was").isEmpty():
            return new.select("node", "class_id")
        label = new.drop("was")
    raise RuntimeError(f"links are longer than {rounds} rounds reach")
