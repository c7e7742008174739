"""Language identification by cross-parsing: suffix automata of labelled text, fewest phrases per letter wins."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remainder, table


#: What is no letter.
OTHER = re.compile(r"[\W\d_]+")
#: Up to this many (language, class) rows are broadcast to pick the sampled texts.
BROADCAST_PICKS = 100_000


class SuffixAutomaton:
    """All substrings of a text; parse() cuts a string into the longest ones, left to right."""

    def __init__(self, text: str):
        self.next, link, length = [{}], [-1], [0]
        last = 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

        for edges in self.next:  # a state is its own table of edges from now on: one look-up a letter
            for ch, to in edges.items():
                edges[ch] = self.next[to]
        self.root = self.next[0]

    def phrases(self, s: str) -> int:
        """Phrases of the cross-parsing of s: each is the longest match, or one unseen character."""
        root = node = self.root
        n = 0
        for ch in s:
            to = node.get(ch)
            if to is None:
                if node is not root:
                    n += 1
                    to = root.get(ch)
                if to is None:
                    n += 1  # an unseen character is a phrase of its own
                    to = root
            node = to
        return n + (node is not root)


class Parser:
    """Cross-parsing of whole texts (letters and single spaces, so matches run over words) with each language's automaton."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in texts]
        self.machines = [SuffixAutomaton(text) for _, text in texts]
        self.bits = [math.log2(max(2, len(text))) for _, text in texts]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); ties go to the first language by name. A phrase costs the bits of a place in the language's
        text, so a language with more text has no advantage: bits a letter estimate the cross entropy. Score: share of
        the winner when each language weighs 2 to the power of minus its bits for each 4 letters."""
        s = clean(text or "")
        if not s or not self.langs:
            return "und", 0.0
        rates = [m.phrases(s + " ") * bits / len(s) for m, bits in zip(self.machines, self.bits)]
        best = min(rates)
        return self.langs[rates.index(best)], 1 / math.fsum(2.0 ** (-4 * (r - best)) for r in rates)


def clean(text: str) -> str:
    """The letters in lower case, with one space for whatever stands between them."""
    return OTHER.sub(" ", text.lower()).strip()


@lru_cache(maxsize=1)
def load(texts: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(texts)


def language_samples(docs: DataFrame, n: int = 24, seed: int = 7) -> list[tuple[str, str]]:
    """(language, text) by language: the whole texts of at most n documents of each, the bound of the fit on labelled rows.

    The documents are those with the least hash of their id in each of n classes of ids, so no group is gathered:
    a minimum of numbers picks them, then one row for each class and language is read.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", h.alias("h"), F.pmod(h, F.lit(n)).alias("k"))
    least = cut(labelled.groupBy("lang", "k").agg(F.min("h").alias("h")), "picks")
    least = F.broadcast(least) if least.count() <= BROADCAST_PICKS else least
    picked = labelled.join(least, ["lang", "k", "h"]).groupBy("lang", "k").agg(F.min("text").alias("text"))
    found: dict[str, list] = {}
    for r in picked.orderBy("lang", "k").collect():
        found.setdefault(r.lang, []).append(clean(r.text))
    return [(lang, " " + " ".join(parts) + " ") for lang, parts in sorted(found.items())]


def identify(docs: DataFrame, samples: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, by whole text, however long, and without a shuffle.

    `und` with score 0 for a null text or one without a letter, and where nothing was learned. Null ids stay null,
    repeated rows are answered each, an empty table gives an empty one; other columns play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(map(tuple, samples)))

    def run(batches):
        parser = load(shared.value)
        for b in batches:
            found = [parser.predict(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32 of the id is not 2 modulo 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = language_samples(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    return identify(docs, samples).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
