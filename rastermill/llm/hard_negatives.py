"""Hard negatives of anchors by integer inner products, selected from disjoint slots of scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Anchors that a task holds, and the most rows that it meets them with; the anchors multiplied at a time.
ANCHOR_BLOCK, ROW_BLOCK, AT_ONCE = 4096, 32768, 256
FOUND = "anchor_id long, slot int, id long, score long"
FOUND_ARROW = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
LONG = np.iinfo(np.int64)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): rows with an id, a label and a vector of finite numbers only; of rows with one id, the least."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    d = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~odd)
    d = d.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return d.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")


def whole_numbers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) as a matrix of doubles; vectors shorter than `width` go on with zeros."""
    out = np.zeros((len(column), width))
    values = np.floor(scale * column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()])
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles (or floats) while no sum can leave their whole numbers, else in
    Python's numbers; ones that no long holds become the nearest long."""
    bound = np.linalg.norm(rows, axis=1).max(initial=0.0) * np.linalg.norm(anchors, axis=1).max(initial=0.0)
    if bound < 2**52:
        kind = np.float32 if bound < 2**23 else np.float64
        return (rows.astype(kind) @ anchors.astype(kind).T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(exact(rows) @ exact(anchors).T, LONG.min, LONG.max).astype(np.int64)


def best_of_slots(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores (ties: smallest id) of each anchor and slot."""
    order = np.lexsort((ids, -score, slot, anchor))
    a, s = anchor[order], slot[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])]) if len(order) else np.empty(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def search(rows: DataFrame, anchors: DataFrame, slots, scale: int, k: int) -> DataFrame:
    """FOUND: the k best rows of each anchor and slot; slots(scores, rows, anchors) gives each pair's slot, below 0 for none.

    Blocks of anchors meet blocks of rows, each pair of blocks in a task of its own: a row is copied once for each
    ANCHOR_BLOCK anchors. Blocks are dealt by a hash of the id, so no label, however frequent, makes one larger. Tasks send
    on k rows a slot; the window ranks are cut to k on both sides of their shuffle.
    """
    counted = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n_anchors, width = anchors.count(), max(counted.width or 0, 1)
    blocks = lambda n, most: max(1, -(-n // most))
    columns = blocks(n_anchors, ANCHOR_BLOCK)
    stripes = max(blocks(counted.n, ROW_BLOCK), math.isqrt(counted.n) // 16, 1)
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    place = lambda n, name: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)
    left = rows.select("*", place(stripes, "stripe")).select("*", spread(columns, "block"))
    right = anchors.toDF(*anchors.columns).select("*", place(columns, "block")).select("*", spread(stripes, "stripe"))

    def tile(r: pa.Table, a: pa.Table) -> pa.Table:
        parts = []
        if r.num_rows and a.num_rows:
            numbers = lambda t: whole_numbers(t.column("v").combine_chunks(), scale, width)
            ids, vectors = r.column("id").to_numpy(), numbers(r)
            for at in range(0, a.num_rows, AT_ONCE):
                some = a.slice(at, AT_ONCE)
                score = products(vectors, numbers(some))
                slot = slots(score, r, some)
                slot[ids[:, None] == some.column("id").to_numpy()[None, :]] = -1
                row, anchor = np.nonzero(slot >= 0)
                slot, score = slot[row, anchor], score[row, anchor]
                best = best_of_slots(anchor, slot, score, ids[row], k)
                parts.append((some.column("id").to_numpy()[anchor[best]], slot[best], ids[row[best]], score[best]))
        joined = [np.concatenate([p[j] for p in parts]) if parts else [] for j in range(4)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(joined, FOUND_ARROW)], schema=FOUND_ARROW)

    found = left.groupBy("stripe", "block").cogroup(right.groupBy("stripe", "block")).applyInArrow(tile, FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def labels_of(t: pa.Table) -> np.ndarray:
    return t.column("label").to_numpy()


def same_label(score: np.ndarray, r: pa.Table, a: pa.Table) -> np.ndarray:
    """Slot 0 for rows with the anchor's label."""
    return np.where(labels_of(r)[:, None] == labels_of(a)[None, :], 0, -1).astype(np.int32)


def below_limits(low: int, high: int):
    """Slots of rows with another label: slot j holds the scores over limit j + 1 up to limit j of the anchor's limits, which
    descend; scores under the least lower limit, low / high of a limit, have none."""

    def slots(score: np.ndarray, r: pa.Table, a: pa.Table) -> np.ndarray:
        out = np.full(score.shape, -1, np.int32)
        other = labels_of(r)[:, None] != labels_of(a)[None, :]
        for j, limits in enumerate(a.column("limits").to_pylist()):
            up = np.array(limits, np.int64)
            least = min(-(-low * x // high) for x in limits)  # the least whole number of low / high of a limit, or more
            wanted = np.flatnonzero(other[:, j] & (score[:, j] >= least) & (score[:, j] <= up[0]))
            out[wanted, j] = len(up) - np.searchsorted(up[::-1], score[wanted, j], "left") - 1
        return out

    return slots


def hard_negatives(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor's first `positives` other
    rows of its label, the first `negatives` rows of other labels that score from low / high of the positive's score up to it.

    anchors is a condition on the columns id and label. Components become floor(scale * x), scores are inner products of
    whole numbers; higher ones come first, ties by the smaller id. The positives' scores are upper limits that cut each
    anchor's scores into disjoint slots; `negatives` rows a slot are enough, since a positive's window is its own slot and
    the lower ones, merged from the top until it is full, then cut at its lower limit.

    Rows with a null id, label, vector or component, or one that is not finite, take no part; of rows with the same id
    the one with the least label and vector does. A vector shorter than the longest goes on with zeros. Anchors without
    positives, and windows without rows, give no rows; an empty table gives an empty one. Other columns play no part.
    """
    rows = cut(usable(vectors, id_col, vector_col, label_col), "vectors")
    some = rows.filter(anchors)
    found = cut(search(rows, some, same_label, scale, positives).select("anchor_id", "id", "score"), "positives")
    limits = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("limits"))  # `positives` at most
    limited = some.join(limits.withColumnRenamed("anchor_id", "id"), "id")
    slots = cut(search(rows, limited, below_limits(low, high), scale, negatives).select("anchor_id", "slot", "id", "score"), "slots")
    own = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    pairs = found.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.row_number().over(own) - 1).alias("place"))
    d = pairs.join(slots, "anchor_id").filter("slot >= place AND score <= positive_score")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    d = d.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    d = d.filter(wide("positive_score") * low <= wide("score") * high)
    return d.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def with_shifted_labels(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label, which moves on by one of ten where 7 divides vec_id."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", label.alias("label"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all others."""
    return hard_negatives(with_shifted_labels(table(spark, sf_dir, "embeddings")), "id % 100 = 0")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""
