"""Quality rules whose thresholds come from quantile sketches of each language and source; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, table

SYMBOLS = "[#*$%&|<>]"
#: Thresholds of up to this many groups are broadcast, more are joined by shuffle.
BROADCAST_GROUPS = 50_000
#: Quantiles sketched over all values of a feature, and over those above zero.
ALL, SOME, ACCURACY = [0.25, 0.75], [0.05, 0.75], 10_000
#: Interquartile ranges from the upper (or lower) quartile to the fence.
FENCE = {"symbols": 3.0, "dup_lines": 3.0, "repeats": 3.0, "word_len": 6.0}


def with_features(docs: DataFrame, out: str = "features", text_col: str = "text") -> DataFrame:
    """docs and a struct column `out`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed.

    Words are runs without white space; a null text has none. Three-word windows are compared by a 64-bit hash within
    their text. All steps are array functions within the row: no shuffle, n log n in the words of a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    temp = [f"{out}_{k}" for k in ("words", "lines", "h", "sorted", "at")]
    words, lines, h, pairs, at = temp
    d = docs.withColumns({words: F.filter(F.split(text, SPACE), lambda w: w != ""), lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.withColumn(h, F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2))))
    d = d.withColumn(pairs, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda s, j: F.coalesce(F.get(F.col(pairs), j)["x"] == s["x"], F.lit(False))
    d = d.withColumn(at, F.sort_array(F.transform(F.filter(pairs, lambda s, j: same(s, j - 1) | same(s, j + 1)), lambda s: s["i"])))
    covered = F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(F.col(at), j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    n_words, repeats = F.size(words).cast("long"), F.coalesce(covered, F.lit(0)).cast("long")
    d = d.withColumns({f"{out}_n": n_words, f"{out}_r": repeats})
    n, r = F.col(f"{out}_n"), F.col(f"{out}_r")
    features = F.struct(
        n.alias("n_words"), (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), r.alias("n_repeat_words"), F.size(lines).alias("n_lines"), ((n < 50) | (100 * r > 50 * n)).alias("base_failed"),
    )
    return d.withColumn(out, features).drop(*temp, f"{out}_n", f"{out}_r")


def ratios(f: Column) -> dict[str, Column]:
    n, lines = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["n_lines"], F.lit(1))
    return {"symbols": f["n_symbols"] / n, "dup_lines": f["n_dup_lines"] / lines, "repeats": f["n_repeat_words"] / n, "word_len": f["word_chars"] / n}


def thresholds(measured: DataFrame, features: str = "features", least_group: int = 100) -> DataFrame:
    """(lang, source, fences): bounds of every language and source, from sketches over rows that passed the base rules.

    No bound is a constant. Word length: FENCE interquartile ranges beyond its quartiles. Duplicate lines and repeats,
    which most texts lack: so many times the upper quartile of the values above zero, beyond it. Symbols: so many ranges
    above the upper quartile of all values, or the 5 % quantile of the values above zero where that is more, so the
    fence is low where symbols are rare and rises with their use in a source. A feature nobody shows has no bound.
    Groups of fewer than least_group such rows take their language's bounds, small languages those of all rows. The
    sketches are percentile_approx states: made where the rows are, merged after, of one size whatever a group holds.
    Null languages and sources are groups like others.
    """
    base = measured.select(F.coalesce("lang", F.lit("\0")).alias("lang"), F.coalesce("source", F.lit("\0")).alias("source"), F.col(features)["base_failed"].alias("failed"), *[c.alias(k) for k, c in ratios(F.col(features)).items()])
    ok = [F.percentile_approx(F.when(~F.col("failed"), F.col(k)), ALL, ACCURACY).alias(f"{k}_q") for k in FENCE]
    some = [F.percentile_approx(F.when(~F.col("failed") & (F.col(k) > 0), F.col(k)), SOME, ACCURACY).alias(f"{k}_z") for k in FENCE if k != "word_len"]
    at = lambda *keys: base.groupBy(*keys).agg(F.count_if(~F.col("failed")).alias("n"), *ok, *some)
    own, lang, every = at("lang", "source"), at("lang"), at()
    name = lambda df, p: df.select(*[F.col(c).alias(c if c in ("lang", "source") else f"{p}_{c}") for c in df.columns])
    both = name(own, "own").join(name(lang, "lang"), "lang").crossJoin(F.broadcast(name(every, "all")))  # the last is one row
    pick = lambda k: F.when(F.col("own_n") >= least_group, F.col(f"own_{k}")).when(F.col("lang_n") >= least_group, F.col(f"lang_{k}")).otherwise(F.col(f"all_{k}"))
    above = lambda q, low, high, fence: q[high] + fence * (q[high] - q[low])
    high = {k: pick(f"{k}_z")[1] + FENCE[k] * pick(f"{k}_z")[1] for k in ("dup_lines", "repeats")} | {"word_len": above(pick("word_len_q"), 0, 1, FENCE["word_len"])}
    high["symbols"] = F.greatest(above(pick("symbols_q"), 0, 1, FENCE["symbols"]), pick("symbols_z")[0])
    low = pick("word_len_q")[0] - FENCE["word_len"] * (pick("word_len_q")[1] - pick("word_len_q")[0])
    return both.select("lang", "source", F.struct(*[high[k].alias(f"{k}_max") for k in FENCE], low.alias("word_len_min")).alias("fences"))


def judge(measured: DataFrame, out: str = "kept", features: str = "features", least_group: int = 100) -> DataFrame:
    """measured (written before, see cut(): it is read twice) and a boolean column `out`: false where the base rules fail or a
    ratio lies beyond its group's fences."""
    fences = cut(thresholds(measured, features, least_group), "fences")
    fences = fences.select(F.col("lang").alias(f"{out}_l"), F.col("source").alias(f"{out}_s"), F.col("fences").alias(f"{out}_f"))
    if fences.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    on = (F.coalesce("lang", F.lit("\0")) == F.col(f"{out}_l")) & (F.coalesce("source", F.lit("\0")) == F.col(f"{out}_s"))
    x, f = ratios(F.col(features)), F.col(f"{out}_f")
    inside = ~F.col(features)["base_failed"]
    for k in FENCE:
        inside &= F.coalesce(x[k] <= f[f"{k}_max"], F.lit(True))
    inside &= F.coalesce(x["word_len"] >= f["word_len_min"], F.lit(True))
    return measured.join(fences, on, "left").withColumn(out, inside).drop(f"{out}_l", f"{out}_s", f"{out}_f")


def quality_filter(docs: DataFrame, least_group: int = 100) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source and any others) that the rules keep, all columns as they were.

    Null or empty texts fail the base rules. Repeated rows are judged each. An empty table gives an empty one. Columns
    with any other names are carried along; helper columns take names that docs does not have.
    """
    f = "f" * (1 + max(map(len, docs.columns)))
    k = f + "k"
    measured = cut(with_features(docs, f), "measured")
    return judge(measured, k, f, least_group).filter(k).select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = cut(with_features(docs).drop("text"), "measured")
    return judge(measured).select("doc_id", "features.n_words", "features.word_chars", "features.n_symbols", "features.n_dup_lines", "features.n_repeat_words", "features.base_failed", "kept")


FEATURES_SQL = r"""
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
    FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS x1, n_dup_lines / greatest(n_lines, 1) AS x2,
    n_repeat_words / greatest(n_words, 1) AS x3, word_chars / greatest(n_words, 1) AS x4 FROM m)"""


def _quantiles(keys: str) -> str:
    q = [f"quantile_disc(x{k}, {p}) FILTER (WHERE NOT base_failed) AS q{k}_{int(100 * p)}" for k in range(1, 5) for p in ALL]
    q += [f"quantile_disc(x{k}, {p}) FILTER (WHERE NOT base_failed AND x{k} > 0) AS z{k}_{int(100 * p)}" for k in range(1, 4) for p in SOME]
    return f"SELECT {keys + ', ' if keys else ''}count(*) FILTER (WHERE NOT base_failed) AS n, {', '.join(q)} FROM b" + (f" GROUP BY {keys}" if keys else "")


def _verdict() -> str:
    pick = lambda q: f"(CASE WHEN own.n >= 100 THEN own.{q} WHEN lang.n >= 100 THEN lang.{q} ELSE every.{q} END)"
    above = lambda q, k, fence: f"{pick(f'{q}{k}_75')} + {fence}::DOUBLE * ({pick(f'{q}{k}_75')} - {pick(f'{q}{k}_25')})"
    beyond = lambda k, fence: f"{pick(f'z{k}_75')} + {fence}::DOUBLE * {pick(f'z{k}_75')}"
    low = f"{pick('q4_25')} - {FENCE['word_len']}::DOUBLE * ({pick('q4_75')} - {pick('q4_25')})"
    high = [f"greatest({above('q', 1, FENCE['symbols'])}, {pick('z1_5')})", beyond(2, FENCE["dup_lines"]), beyond(3, FENCE["repeats"]), above("q", 4, FENCE["word_len"])]
    return " AND ".join(["NOT base_failed", *(f"coalesce(x{k} <= {h}, true)" for k, h in enumerate(high, 1)), f"coalesce(x4 >= {low}, true)"])


KEPT_SQL = f"""WITH {FEATURES_SQL}, own AS ({_quantiles('lang, source')}), lang AS ({_quantiles('lang')}), every AS ({_quantiles('')})
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {_verdict()} AS kept
FROM b JOIN own ON b.lang IS NOT DISTINCT FROM own.lang AND b.source IS NOT DISTINCT FROM own.source JOIN lang ON b.lang IS NOT DISTINCT FROM lang.lang CROSS JOIN every
"""
