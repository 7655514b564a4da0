"""Many region requests in one job, global exports and request validation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import grids
from ..sources.blocks import BlockStore
from . import blocks, sampling

BOUNDS = ["west", "south", "east", "north"]


def _finite(c) -> Column:
    c = F.col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def pixel_density() -> Column:
    """Native latitude intervals a request needs to be no finer than the data."""
    east = g.unwrap_east("west", "east")
    return F.greatest(F.col("width") * F.lit(180.0) / F.nullif(east - F.col("west"), F.lit(0.0)),
                      F.col("height") * F.lit(180.0) / F.nullif(F.col("north") - F.col("south"), F.lit(0.0)))


def validate(requests: DataFrame, native_height: int | None = None) -> DataFrame:
    """Add an ``error`` column; NULL means a good request.  Bad requests stay rows."""
    finite = _finite("west") & _finite("south") & _finite("east") & _finite("north")
    lon_ok = F.col("west").between(-180, 180) & F.col("east").between(-180, 180)
    lat_ok = ((F.col("south") >= -90) & (F.col("south") < F.col("north")) & (F.col("north") <= 90)
              & (F.col("west") != F.col("east")))
    size_ok = F.coalesce((F.col("width") >= 1) & (F.col("height") >= 1), F.lit(False))
    error = (F.when(~finite, "bounds_not_finite").when(~lon_ok, "longitude_out_of_range")
             .when(~lat_ok, "bounds_order").when(~size_ok, "size_not_positive"))
    if native_height is not None:
        error = error.when(pixel_density() > F.lit(native_height + 1e-8), "exceeds_native_detail")
    return requests.withColumn("error", error)


def good_requests(requests: DataFrame, native_height: int | None = None) -> DataFrame:
    return validate(requests, native_height).where(F.col("error").isNull()).drop("error")


def preview_guide_height(requests: DataFrame) -> DataFrame:
    """Smallest legal guide height (a multiple of four) for each request's pixel density."""
    needed = F.ceil(pixel_density() / F.lit(1024.0)) * 4
    return good_requests(requests).withColumn("guide_height", F.greatest(F.lit(4), needed).cast("int"))


def region_pixels(requests: DataFrame, spread: bool = True) -> DataFrame:
    """Pixel centres of every request.

    Requests are split into rows first and the rows are spread over all tasks, so one very large
    request does not become one task.
    """
    keep = [c for c in requests.columns if c in ("ts",)]
    r = requests.withColumn("east", g.unwrap_east("west", "east"))
    r = r.withColumn("row_i", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)))
    if spread:
        tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        r = r.repartition(tasks, "request_id", "row_i")
    r = r.withColumn("col_i", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)))
    half = F.lit(0.5)
    lon = F.col("west") + (F.col("col_i") + half) * (F.col("east") - F.col("west")) / F.col("width")
    lat = F.col("north") - (F.col("row_i") + half) * (F.col("north") - F.col("south")) / F.col("height")
    return r.select("request_id", *keep, "row_i", "col_i", lon.alias("lon"), lat.alias("lat"))


def region_query(requests: DataFrame, field: DataFrame, n: int, *, signed_root: str | None = None,
                 native_height: int | None = None, prune: bool = False, spread: bool = True) -> DataFrame:
    """Region grids of all good requests from a cube field, in one job.

    ``signed_root`` names a column stored as signed square root; it is squared on the nodes,
    before interpolation.  ``prune`` first reduces a large field to the touched cells.
    """
    if signed_root:
        field = field.withColumn(signed_root, g.signed_square(signed_root))
    pixels = region_pixels(good_requests(requests, native_height), spread)
    return sampling.sample_cube(g.add_lonlat_direction(pixels), field, n, prune=prune).drop(*g.VEC)


def region_query_stored(requests: DataFrame, stored: BlockStore, native_height: int | None = None) -> DataFrame:
    """Region grids of all good requests from a field in blocks; only the blocks under the requests are read and checked."""
    pixels = g.add_lonlat_direction(region_pixels(good_requests(requests, native_height)))
    if stored.lattice.kind == "cube":
        return blocks.sample_cube(pixels, stored).drop(*g.VEC)
    return blocks.sample_lonlat(g.add_lonlat_node(pixels, stored.lattice.size), stored).drop(*g.VEC, "ny", "nx")


def region_query_lonlat(requests: DataFrame, field: DataFrame, h: int, *, signed_root: str | None = None,
                        native_height: int | None = None, prune: bool = False,
                        spread: bool = True) -> DataFrame:
    """The same from a longitude/latitude node field."""
    if signed_root:
        field = field.withColumn(signed_root, g.signed_square(signed_root))
    pixels = region_pixels(good_requests(requests, native_height), spread)
    p = g.add_lonlat_node(g.add_lonlat_direction(pixels), h)
    return sampling.sample_lonlat(p, field, h, prune=prune).drop(*g.VEC, "ny", "nx")


def guard_cost(requests: DataFrame, estimates: DataFrame, limit: int | None) -> DataFrame:
    """Mark requests whose tile estimate is above the limit as error rows; without a limit all pass."""
    j = requests.join(estimates, "request_id", "left")
    if "error" not in j.columns:
        j = j.withColumn("error", F.lit(None).cast("string"))
    if limit is None:
        return j
    return j.withColumn("error", F.coalesce("error", F.when(F.col("tiles") > limit, "too_many_tiles")))


def export_window(field: DataFrame, h: int, height: int,
                  window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Point evaluation at the pixel centres of a global grid or of a window of it.

    Output has the window's own row and column and the pixel's place; longitudes of a window that
    crosses the date line continue beyond 180.
    """
    p = grids.window_pixels(field.sparkSession, h, height, window)
    s = sampling.sample_lonlat(p, field, h, prune=window is not None)
    per = F.lit(180.0 / h)
    return s.withColumns({"lon": F.lit(-180.0) + F.col("nx") * per, "lat": F.lit(90.0) - F.col("ny") * per}
                         ).drop("nx", "ny")


def export_stored(stored: BlockStore, height: int, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The same from a longitude/latitude field in blocks, of which a window reads and checks those under it."""
    h = stored.lattice.size
    s = blocks.sample_lonlat(grids.window_pixels(stored.spark, h, height, window), stored)
    per = F.lit(180.0 / h)
    return s.withColumns({"lon": F.lit(-180.0) + F.col("nx") * per, "lat": F.lit(90.0) - F.col("ny") * per}).drop("nx", "ny")
