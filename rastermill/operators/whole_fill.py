"""The whole job: from pixels to filled or replaced skies, in stages that write what they change."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.keys import dealt, of_image, with_image
from ..sources.store import PixelVersions, Stages, saved
from . import columns, fill, fits, overlays, repairs, sampling, sky_model
from . import masks as masking
from .local_fit import NEAR_MEAN, raised_start


@dataclass(frozen=True)
class FillOptions:
    """What run_fill() does besides finding and modelling the sky.

    depth: share of the sky that the fill reaches down. samples: points of sky an image. replace: replace the whole sky
    instead (fade, only_transparent: see replace_sky()). light: `model`, `sun` or `luminance` (see predict_sky(), which says
    what columns images then has). zenith: (depth, end factor) of fill_sky_columns(); factors likewise. hue_range: (l, r),
    columns whose hue is wrong. repair_limit: how far a channel may be from the mean around it (see local_fits()). level: starts of sky three columns apart are levelled. fill_top: all starts are brought to
    the image's least one. uniform: 0, 1 or 2, rows evened out by even_out_rows(). masked_columns, transparent: masked columns
    and transparent pixels are interpolated. smooth_rows, box: the two filters. ghosts, rays: tables of overlays. seed:
    dither the filled sky.
    """

    depth: float = 0.5
    samples: int = 1000
    replace: bool = False
    fade: bool = False
    only_transparent: bool = False
    light: str = "model"
    zenith: tuple[float, float] | None = None
    factors: tuple[float, float, float] = (0.0, 1.0, 1.0)
    hue_range: tuple[int, int] | None = None
    repair_limit: float = NEAR_MEAN
    level: bool = True
    fill_top: bool = False
    uniform: int | None = None
    masked_columns: bool = True
    transparent: bool = False
    smooth_rows: bool = False
    box: bool = False
    ghosts: DataFrame | None = None
    rays: DataFrame | None = None
    seed: int | None = None


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new (all pixels) that are not those of old."""
    key, colors = PixelVersions.KEY, PixelVersions.COLORS
    was = old.select(*key, F.struct(*colors).alias("was"))
    return new.select(*key, *colors).join(dealt(was), key).filter(~F.struct(*colors).eqNullSafe(F.col("was"))).drop("was")


def _starts(px: DataFrame, masks: DataFrame, width: int, height: int) -> DataFrame:
    """The table of columns with starts of sky, ends at the bottom, and a flag for each kind of mask."""
    col = columns.dilate_start(columns.start_of_sky(px, masks, height), width)
    return masking.expand_column_masks(col, masks).withColumn("manual_eos", F.lit(None).cast("int"))


def _ends(px: DataFrame, col: DataFrame, width: int, height: int) -> DataFrame:
    """col with the ends of sky of the default detector; masked columns end at 0."""
    ends = fits.end_of_sky_regression(px, col, height).join(dealt(col.select("image_id", "x", "column_mask")), ["image_id", "x"])
    ends = ends.select("image_id", "x", F.when(F.col("column_mask") == 1, 0).otherwise(F.col("eos")).alias("eos"))
    ends = saved(ends, "ends")  # read twice
    found = columns.find_end_of_sky(ends, col, width, height).select("image_id", "x", "eos")
    return col.drop("eos").join(dealt(found), ["image_id", "x"])


def _samples(px: DataFrame, col: DataFrame, images: DataFrame, width: int, height: int, options: FillOptions) -> DataFrame:
    """Samples of the sky outside masks and the columns of a wrong hue, flagged."""
    free = col.filter("column_mask = 0 AND sample_mask = 0")
    if options.hue_range:
        free = free.filter(~F.col("x").between(*options.hue_range))
    points = sampling.sample_sky(px, free, sampling.sample_grid_spec(free, width, height, options.samples))
    points = sampling.with_hsv(geometry.with_relative_xy(points, images))
    return sampling.flag_outliers(sampling.close_neighbors(points))


def _models(points: DataFrame, images: DataFrame, options: FillOptions) -> DataFrame:
    models = sky_model.fit_sky_model(points, images)
    if options.light == "model":
        return models
    lit = images.drop("fov")
    if options.light == "sun":
        glow = geometry.glow_range(images.withColumnsRenamed({"cc": "c", "cd": "d"}))
        lit = lit.join(glow, "image_id")
    return models.join(lit.drop("width", "height"), "image_id")


def _repaired_top(pixels: PixelVersions, stages: Stages, col: DataFrame, width: int, height: int, options: FillOptions) -> DataFrame:
    """The repairs of the top of the sky, each on the pixels of the one before; returns col with the starts they raise."""
    pixels.change("vertical-edges", lambda px: repairs.clean_vertical_edges(px, col, limit=options.repair_limit))
    pixels.change("vertical-gaps", lambda px: repairs.fill_vertical_gaps(px, col, height, limit=options.repair_limit))
    sides = pixels.change("side-edges", lambda px: repairs.fill_side_edges(px, col, limit=options.repair_limit))
    col = stages.table("columns", lambda at=col: raised_start(at, sides))
    pixels.change("outliers", lambda px, at=col: repairs.repair_outlier_pixels(px, at, limit=options.repair_limit))
    if options.level:
        levelled = stages.table("levelled", lambda at=col: repairs.level_start(at, width))
        raised = pixels.change("levelled-starts", lambda px: repairs.fill_levelled_start(px, levelled, limit=options.repair_limit))
        col = stages.table("columns", lambda at=col: raised_start(at, raised))
    if options.fill_top:
        raised = pixels.change("top", lambda px, at=col: repairs.fill_to_min_start(px, at, limit=options.repair_limit))
        raised_at = raised.select("image_id", "x").distinct().withColumn("raised", F.lit(True))
        least = F.when(F.col("raised"), of_image(F.min("sos"))).otherwise(F.col("sos"))
        col = stages.table("columns", lambda at=col: at.join(dealt(raised_at), ["image_id", "x"], "left").withColumn("sos", least).drop("raised"))
    return col


def _smoothed(pixels: PixelVersions, col: DataFrame, masks: DataFrame, models: DataFrame, width: int, height: int, options: FillOptions) -> None:
    """What follows the fill: interpolation, evening out, filters, flare and dither."""
    if options.masked_columns:
        pixels.change("masked-columns", lambda px: columns.interpolate_masked_columns(px, col, masks))
    if options.transparent:
        predicted = lambda px: fill.sky_probability(fill.predict_sky(px, models, width, height, options.light), col)
        pixels.change("transparent", lambda px: repairs.interpolate_transparent(predicted(px)))
    if options.uniform in (0, 1):
        pixels.change("even-rows", lambda px: _differing(px, columns.even_out_rows(px, col, options.uniform)))
    free = col.filter("column_mask = 0").select("image_id", "x")
    if options.smooth_rows:
        smooth = lambda px: columns.horizontal_smooth(px, col).join(dealt(free), ["image_id", "x"])
        pixels.change("smooth-rows", lambda px: smooth(px).select("image_id", "x", "y", *[F.floor(f"{c}_smooth").cast("int").alias(c) for c in "rgb"], "a"))
    if options.box:
        pixels.change("box", lambda px: _differing(px, columns.box_filter(px, col)))
    if options.ghosts is not None:
        pixels.change("ghosts", lambda px: _differing(px, overlays.overlay_ghosts(px, options.ghosts)))
    if options.rays is not None:
        pixels.change("rays", lambda px: _differing(px, overlays.overlay_rays(px, options.rays)))
    if options.seed is not None:
        top = col.filter("column_mask = 0").select("image_id", "x", (F.col("sos") + F.floor((F.col("eos") - F.col("sos")) * options.depth + 0.5)).alias("fill_end"))
        pixels.change("dither", lambda px: fill.dither(px.join(dealt(top), ["image_id", "x"]).filter("y < fill_end"), options.seed).drop("fill_end"))


def _run(px: DataFrame, images: DataFrame, masks: DataFrame, width: int, height: int, options: FillOptions, stages: Stages) -> DataFrame:
    pixels = PixelVersions(stages.table("pixels", lambda: px.select("image_id", "x", "y", "r", "g", "b", "a")), stages)
    pixels.change("alpha", lambda px: _differing(px, columns.edge_suspects(px)))
    starts = stages.table("starts", lambda: _starts(pixels.now(), masks, width, height))
    if not options.replace:
        pixels.change("overhangs", lambda px: repairs.fill_overhang_holes(px, starts, limit=options.repair_limit))
    first = stages.table("columns", lambda: _ends(pixels.now(), starts, width, height))
    pixels.change("black-edges", lambda px: _differing(px, columns.clear_black_edges(px, first)))
    starts = stages.table("starts", lambda: _starts(pixels.now(), masks, width, height))
    col = stages.table("columns", lambda: _ends(pixels.now(), starts, width, height))
    points = stages.table("samples", lambda: _samples(pixels.now(), col, images, width, height, options))
    models = stages.table("models", lambda: _models(points, images, options))
    predicted = lambda px: fill.predict_sky(px, models, width, height, options.light)
    if options.hue_range:
        pixels.change("hue", lambda px: fill.repair_sky_hue(predicted(px), col, *options.hue_range))
    col = _repaired_top(pixels, stages, col, width, height, options)
    if options.uniform == 2:
        pixels.change("even-rows", lambda px, at=col: _differing(px, columns.even_out_rows(px, at, 2)))
        col = stages.table("columns", lambda at=col: at.withColumn("sos", of_image(F.min("sos"))))

    def filled(px: DataFrame) -> DataFrame:
        seen = predicted(px)
        if options.replace:
            suns = images if options.light == "sun" else None
            new = fill.replace_sky(seen, col, options.depth, suns, options.zenith and options.zenith[0], options.factors, options.fade, options.only_transparent)
        else:
            new = fill.fill_sky_columns(seen, col, height, options.depth, options.zenith, options.factors)
        names = PixelVersions.KEY + PixelVersions.COLORS
        return new.select(*names).unionByName(with_image(px, models.select("image_id"), "left_anti").select(*names))

    pixels.rewrite("filled", filled)
    if not options.replace:
        # a blend towards the zenith has given the columns other ends before the halo is looked at
        extents = fill.zenith_extents(col, options.zenith[1]) if options.zenith else col
        reached = fill.filled_to_end(extents.filter("column_mask = 0"), options.depth)
        pixels.change("halo", lambda px: columns.trim_halo(with_image(px, models.select("image_id"), "left_semi"), reached).filter("trimmed").drop("trimmed", "final_eos").join(dealt(px.select("image_id", "x", "y", "a")), ["image_id", "x", "y"]))
    _smoothed(pixels, col, masks, models, width, height, options)
    return pixels.now()


def run_fill(px: DataFrame, images: DataFrame, masks: DataFrame, options: FillOptions = FillOptions(), folder: str | None = None) -> DataFrame:  # noqa: B008
    """image_id, x, y, r, g, b, a of images (image_id, width, height, fov): the whole job.

    Suspect edges become transparent and holes beneath overhanging sky are filled; the regression detector finds the end
    of the sky, black borders are cleared and it looks again; samples give the model; a wrong hue is mended; then the top
    of the sky is repaired (edges beside transparent pixels, gaps inside columns, the sides of the image, outliers, starts
    that differ too much). The sky is filled or replaced, peaks at the end of filled columns are taken down, and what the
    options name follows. Images whose sky has too few samples for a model keep the pixels of the repairs.

    Each stage writes what it changes as the next version of those pixels (see PixelVersions), in `folder` or below the
    shared folder: no stage is computed twice, and with the same folder a job goes on where it broke off. Images may have
    several sizes: those of one size are one run, so runs number as many as sizes, and images of one size are handled
    together however many they are.
    """
    spark, out = px.sparkSession, []
    for size in images.select("width", "height").distinct().orderBy("width", "height").collect():
        some = images.filter((F.col("width") == size.width) & (F.col("height") == size.height))
        stages = Stages(spark, f"{folder.rstrip('/')}/{size.width}x{size.height}" if folder else None)
        of = some.select("image_id")
        out.append(_run(with_image(px, of, "left_semi"), some, masks.join(of, "image_id", "left_semi"), size.width, size.height, options, stages))
    return reduce(DataFrame.unionByName, out) if out else px.select(*PixelVersions.KEY, *PixelVersions.COLORS).filter("false")
