"""Pixel tables: reading, writing, scanlines, and the small text files that go with images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import view_angles
from ..functions.keys import with_image

PIXELS = "image_id INT, x INT, y INT, r INT, g INT, b INT, a INT"
SCANLINES = "image_id INT, y INT, bits INT, channels INT, data BINARY"
#: The columns of sample texts, in order (fixed values).
SAMPLE_COLUMNS = "px py h s v h_hat s_hat v_hat h_err s_err v_err angle n_close r g b cv_r cv_g cv_b".split()


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PIXELS).parquet(path)


def write_pixels(px: DataFrame, path: str) -> None:
    px.repartition("image_id").write.mode("overwrite").partitionBy("image_id").parquet(path)


def unpack_scanlines(scanlines: DataFrame) -> DataFrame:
    """Rows of bytes to one row for each pixel; 8-bit values are widened to v << 8 | v. No shuffle.

    Rows with fewer than 4 channels, other depths or null data give no pixels.
    """

    def run(batches):
        for pdf in batches:
            parts = []
            for r in pdf.itertuples(index=False):
                v = np.frombuffer(r.data, "u1" if r.bits == 8 else "<u2").astype(np.int32)
                v = v[: len(v) // r.channels * r.channels].reshape(-1, r.channels)[:, :4]
                if r.bits == 8:
                    v = v << 8 | v
                parts.append((r.image_id, r.y, v))
            if parts:
                ids, ys, rows = zip(*parts)
                long = [len(v) for v in rows]
                at = {"image_id": np.repeat(ids, long), "x": np.concatenate([np.arange(n) for n in long]), "y": np.repeat(ys, long)}
                yield pd.DataFrame(at | dict(zip("rgba", np.concatenate(rows).T)))

    return scanlines.filter("channels >= 4 AND bits IN (8, 16) AND data IS NOT NULL").mapInPandas(run, PIXELS)


def pack_scanlines(px: DataFrame, bits: int = 16) -> DataFrame:
    """Pixels to rows of bytes, in x order; 16 bits become 8 by dropping the low byte. Spark gathers the rows, so tasks turn many
    of them into bytes at once."""
    rows = px.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", *"rgba"))).alias("v"))
    rows = rows.select("image_id", "y", F.flatten(F.transform("v", lambda p: F.array(*[p[c].cast("int") for c in "rgba"]))).alias("v"))

    def run(batches):
        for pdf in batches:
            data = [((v >> 8).astype("u1") if bits == 8 else v.astype("<u2")).tobytes() for v in pdf.pop("v")]
            yield pdf.assign(bits=bits, channels=4, data=data)[["image_id", "y", "bits", "channels", "data"]]

    return rows.mapInPandas(run, SCANLINES)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return d.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def read_project_fov(spark: SparkSession, path: str) -> DataFrame:
    """(file, fov): from the last good line that starts with p: v * (crop width) / w, rounded; a missing crop is the frame."""
    d = _lines(spark, path).filter(F.col("line").rlike(r"^p\s"))
    number = lambda p: F.expr(f"try_cast(regexp_extract(line, '{p}', 1) AS DOUBLE)")
    d = d.withColumns({"v": number(r"\\sv([0-9.]+)"), "w": number(r"\\sw([0-9]+)"), "l": number(r"\\sS([0-9]+),"), "r": number(r"\\sS[0-9]+,([0-9]+)")})
    fov = F.floor(F.col("v") * F.coalesce(F.col("r") - F.col("l"), F.col("w")) / F.col("w") + 0.5).cast("int")
    return d.withColumn("fov", fov).filter("fov IS NOT NULL").groupBy("file").agg(F.max_by("fov", "line_no").alias("fov"))


def read_manual_horizon(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, x, y) of vertex files `X Y`; lines that aren't two whole numbers are left out."""
    d = _lines(spark, path).withColumn("p", F.split(F.trim("line"), r"\s+"))
    d = d.select("file", F.col("line_no").alias("ord"), F.expr("try_cast(p[0] AS INT)").alias("x"), F.expr("try_cast(get(p, 1) AS INT)").alias("y"))
    return d.filter("x IS NOT NULL AND y IS NOT NULL")


def sample_report(smp: DataFrame, images: DataFrame) -> DataFrame:
    """What a report of samples holds, in its order and precision: place, viewing angles (degrees), colour, colour over the base
    curves, prediction and its errors, close neighbours, ratios to blue and blue, coefficients of variation and the mark of
    plots (1 for outliers, else 7). images: image_id, width, height, fov."""
    d = with_image(smp, images.select("image_id", "width", "height", "fov"))
    angles = view_angles(F.col("px"), F.col("py"), F.col("fov"), F.col("width"), F.col("height"))
    over_blue = lambda c: F.col(c) / F.nullif(F.col("b"), F.lit(0))
    rounds = {
        "ha": (F.degrees(angles["aoy"]), 1), "va": (F.degrees(angles["aox"]), 1), "px": (F.col("px"), 4), "py": (F.col("py"), 4),
        "hue": (F.col("h"), 2), "sat": (F.col("s"), 3), "val": (F.col("v"), 3), "nv": (F.col("normalized_v"), 3), "ns": (F.col("normalized_s"), 3),
        "hue_hat": (F.col("h_hat"), 2), "sat_hat": (F.col("s_hat"), 3), "val_hat": (F.col("v_hat"), 3),
        "hue_err": (F.col("h_hat") - F.col("h"), 2), "sat_err": (F.col("s_hat") - F.col("s"), 3), "val_err": (F.col("v_hat") - F.col("v"), 3), "n_close": (F.col("n_close"), None),
        "r": (over_blue("r"), 5), "g": (over_blue("g"), 5), "b": (F.col("b") / 65535.0, 5), **{f"cv_{c}": (F.col(f"cv_{c}"), 6) for c in "rgb"},
    }
    mark = F.when(F.col("is_outlier") == 0, 7).otherwise(1).alias("symbol")
    return d.select("image_id", "x", "y", *[(c if n is None else F.round(c, n)).alias(k) for k, (c, n) in rounds.items()], mark)


def write_sample_report(smp: DataFrame, images: DataFrame, path: str) -> None:
    """The report as text, a folder of files an image, columns by one space."""
    sample_report(smp, images).write.mode("overwrite").partitionBy("image_id").csv(path, sep=" ", header=True)


def write_samples(smp: DataFrame, path: str) -> None:
    """Samples (with h_hat, s_hat, v_hat and fov, the image's) as text of the 19 columns that read_samples() takes, without a
    header: colours as shares of full, the angle in degrees for the field of view; numbers are written whole."""
    cols = {c: F.col(c) for c in ("px", "py", "h", "s", "v", "h_hat", "s_hat", "v_hat")}
    cols |= {f"{c}_err": F.col(f"{c}_hat") - F.col(c) for c in "hsv"} | {"angle": F.col("fov") * F.col("px"), "n_close": F.col("n_close").cast("long")}
    cols |= {c: F.col(c) / 65535.0 for c in "rgb"} | {f"cv_{c}": F.col(f"cv_{c}") for c in "rgb"}
    assert list(cols) == SAMPLE_COLUMNS
    smp.select(*[c.alias(n) for n, c in cols.items()]).write.mode("overwrite").csv(path, sep=" ")


def write_knots(knots: DataFrame, path: str) -> None:
    knots.write.mode("overwrite").csv(path, sep=" ", header=True)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, the 19 columns, x, y, fov, lowest_py, n_bad) of sample texts: rows whose first 19 fields are numbers, n_close a
    whole one; what follows in a row is not looked at.

    r, g and b become 0..65535 again; x and y are stand-ins, hundred thousandths of the place. Each file's rows have its field
    of view (angle / px of the last row with a px), the lowest py and the number of its other rows (a header is one of
    them, blank lines are not).
    """
    d = _lines(spark, path).withColumnRenamed("line_no", "line_no_").filter(F.trim("line") != "").withColumn("p", F.split(F.trim("line"), r"\s+"))
    number = lambda k: F.expr(f"try_cast(get(p, {k}) AS DOUBLE)")
    d = d.withColumns({c: number(k) for k, c in enumerate(SAMPLE_COLUMNS)})
    good = F.get("p", F.lit(SAMPLE_COLUMNS.index("n_close"))).rlike(r"^[+-]?\d+$")
    for c in SAMPLE_COLUMNS:
        good = good & F.col(c).isNotNull()
    d = d.withColumn("good", F.coalesce(good, F.lit(False)))
    fov = F.max_by(F.col("angle") / F.col("px"), F.when(F.col("good") & (F.col("px") != 0), F.col("line_no_")))
    of = d.groupBy("file").agg(fov.alias("fov"), F.min(F.when(F.col("good"), F.col("py"))).alias("lowest_py"), F.count_if(~F.col("good")).alias("n_bad"))
    place = lambda c: F.floor((F.col(c) + 0.5) * 100000 + 0.5).cast("int")
    d = d.filter("good").join(of, "file").withColumns({"x": place("px"), "y": place("py"), "n_close": F.col("n_close").cast("int")} | {c: F.floor(F.col(c) * 65535 + 0.5).cast("int") for c in "rgb"})
    return d.select("file", F.col("line_no_").alias("line"), *SAMPLE_COLUMNS, "x", "y", "fov", "lowest_py", "n_bad")


def pixel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster over the events table: every 1000 events are one 40x25 image."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    d = e.select("event_id", F.expr("CAST(floor(event_id/1000) AS INT) image_id"), F.expr("CAST((event_id%1000)%40 AS INT) x"), F.expr("CAST(floor((event_id%1000)/40) AS INT) y"), F.expr("CAST(floor(value*100) AS INT)%512 noise"))
    d = d.selectExpr("*", "1+(x*7+image_id*3)%4 AS sos0", "15+(x*5+image_id)%6 AS eos0")
    d = d.selectExpr("*", "CASE WHEN y < sos0 THEN 0 WHEN event_id % 97 = 0 THEN 40000 ELSE 65535 END AS a0")
    shade = lambda sky, ground: f"CAST(CASE WHEN a0=0 THEN 0 WHEN y<=eos0 THEN {sky}+noise ELSE {ground}*noise END AS INT)"
    return d.selectExpr("image_id", "x", "y", shade("12000+900*y+20*x", "9000+37") + " AS r", shade("24000+700*y+15*x", "12000+29") + " AS g", shade("46000+400*y+10*x", "7000+17") + " AS b", "a0 AS a")


def column_view(px: DataFrame) -> DataFrame:
    """The table of columns that goes with pixel_view()."""
    d = px.select("image_id", "x").distinct()
    return d.selectExpr("image_id", "x", "1+(x*7+image_id*3)%4 AS raw_sos", "1+(x*7+image_id*3)%4 AS sos", "15+(x*5+image_id)%6 AS eos", "CASE WHEN x%7=3 THEN 14 END AS manual_eos", "CASE WHEN x BETWEEN 5 AND 7 THEN 1 ELSE 0 END AS column_mask")


def literal(spark: SparkSession, images: DataFrame, rows: str, names: str) -> DataFrame:
    """The same short list of rows for every image."""
    return images.crossJoin(F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")))


