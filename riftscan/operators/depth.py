"""Binned read depth: coverage tracks, local averages and whole-run coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import IGNORED_FLAGS
from .prefix import block_neighbour, block_scan

#: Bins on either side of a position that its local depth averages over.
DEPTH_WINDOW = 2
#: Bins that are scanned together.
BIN_BLOCK = 1 << 14


def primary_intervals(alignments: DataFrame) -> DataFrame:
    """Covered reference interval of every primary mapped read."""
    return alignments.where(
        (F.col("flag").bitwiseAND(IGNORED_FLAGS) == 0) & (F.col("ref_end") > F.col("pos0"))
    ).select("contig", F.col("pos0").alias("start"), F.col("ref_end").alias("end"))


def named_intervals(df: DataFrame, chrom: str | None = None) -> DataFrame:
    """Intervals (contig, start, end) of a table with any of the usual column names.

    Rows without a contig belong to ``chrom`` if one is given; other contigs are then left out. Rows
    without both ends drop out.
    """
    def pick(names: tuple[str, ...], kind: str, default: str | None = None) -> Column:
        found = [F.col(n).cast(kind) for n in names if n in df.columns]
        return F.coalesce(*found, F.lit(default).cast(kind))

    rows = df.select(pick(("contig", "chrom", "rname"), "string", chrom).alias("contig"),
                     pick(("start", "s"), "bigint").alias("start"), pick(("end", "e"), "bigint").alias("end"))
    rows = rows.dropna()
    return rows if chrom is None else rows.where(F.col("contig") == chrom)


def whole_contigs(contigs: DataFrame) -> DataFrame:
    """Regions that span the given contigs."""
    return contigs.where(F.col("length") > 0).select("contig", F.lit(0).cast("bigint").alias("lo"),
                                                     F.col("length").cast("bigint").alias("hi"))


def contig_bounds(signatures: DataFrame, bin_size: int = 1000, contigs: DataFrame | None = None) -> DataFrame:
    """Padded bounding region (lo, hi) of the signatures of each contig, clipped to the contig."""
    pad = max(1, 3 * int(bin_size))
    low = F.greatest(F.lit(0), F.least("tstart", "tend") - pad)
    high = F.greatest(low + 1, F.greatest("tstart", "tend") + pad)
    bounds = signatures.groupBy("contig").agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    if contigs is None:
        return bounds
    lo = F.greatest(F.lit(0), F.least(F.col("length"), F.col("lo")))
    return bounds.join(contigs, "contig").select(
        "contig", lo.alias("lo"), F.greatest(lo, F.least(F.col("length"), F.col("hi"))).alias("hi"))


def region_grid(regions: DataFrame, bin_size: int) -> DataFrame:
    """Regions (contig, lo, hi) with their number of bins."""
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    return regions.select("contig", "lo", "hi", F.greatest(F.lit(1), F.ceil(width / bin_size)).alias("n_bins"))


def depth_bins(intervals: DataFrame, regions: DataFrame, bin_size: int = 1000) -> DataFrame:
    """Track (contig, bin, depth, lo, n_bins): intervals that touch each bin of a contig's region.

    Every interval adds +1 at its first bin and -1 behind its last one. The marks are summed per bin
    before the shuffle, so what is ordered and scanned is one row per bin, however many reads there are.
    """
    sized = region_grid(regions, bin_size)
    clipped = (
        intervals.join(sized, "contig")
        .withColumn("s", F.greatest("lo", "start")).withColumn("e", F.least("hi", "end"))
        .where(F.col("e") > F.col("s"))
        .select("contig",
                F.floor((F.col("s") - F.col("lo")) / bin_size).alias("b0"),
                F.least(F.col("n_bins") - 1, F.floor((F.col("e") - F.col("lo") - 1) / bin_size)).alias("b1"))
    )
    marks = clipped.select("contig", F.inline(F.array(
        F.struct(F.col("b0").alias("bin"), F.lit(1).alias("d")),
        F.struct((F.col("b1") + 1).alias("bin"), F.lit(-1).alias("d")))))
    deltas = marks.groupBy("contig", "bin").agg(F.sum("d").alias("d"))
    # Bins are made block by block, so no row ever holds a contig's whole list.
    blocks = sized.select("contig", "lo", "n_bins", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_bins") - 1) / BIN_BLOCK))).alias("__blk"))
    first = F.col("__blk") * BIN_BLOCK
    grid = blocks.select("*", F.explode(F.sequence(first, F.least(first + BIN_BLOCK, "n_bins") - 1)).alias("bin"))
    marked = grid.join(deltas, ["contig", "bin"], "left")
    track = block_scan(marked, ["contig"], "__blk", ["bin"], F.coalesce("d", F.lit(0)), "depth")
    return track.select("contig", "bin", "depth", "lo", "n_bins")


def depth_runs(track: DataFrame) -> DataFrame:
    """Runs (contig, first_bin, last_bin, depth) of equal depth."""
    rows = track.select("contig", "bin", "depth", F.floor(F.col("bin") / BIN_BLOCK).alias("__blk"))
    rows = block_neighbour(rows, ["contig"], "__blk", ["bin"], F.col("depth"), "__last", ahead=False)
    change = F.when(F.col("__last").eqNullSafe(F.col("depth")), 0).otherwise(1)
    rows = block_scan(rows, ["contig"], "__blk", ["bin"], change, "run")
    return rows.groupBy("contig", "run", "depth").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin")).drop("run")


def smoothed_track(track: DataFrame, window: int = DEPTH_WINDOW) -> DataFrame:
    """Centred mean per bin over the bins that exist, padded so that outside positions find an edge.

    The track grows ``window`` empty bins on both sides; an average ignores them, so a padded bin holds
    the mean of exactly the real bins its window still reaches.
    """
    ends = track.groupBy("contig", "lo", "n_bins").agg(F.count(F.lit(1)).alias("n"))
    pad = ends.select(
        "contig", "lo", "n_bins",
        F.explode(F.concat(
            F.sequence(F.lit(-window).cast("bigint"), F.lit(-1).cast("bigint")),
            F.sequence(F.col("n_bins"), F.col("n_bins") + window - 1))).alias("bin"),
        F.lit(None).cast("bigint").alias("depth"))
    padded = track.select("contig", "lo", "n_bins", "bin", "depth").unionByName(pad)
    # Bins near a block's edge also come as a halo of the block next to it.
    own, low, high = (F.floor((F.col("bin") + by) / BIN_BLOCK) for by in (0, -window, window))
    each = padded.withColumn("__own", own).withColumn("__blk", F.explode(F.array_distinct(F.array(own, low, high))))
    around = Window.partitionBy("contig", "__blk").orderBy("bin").rowsBetween(-window, window)
    return each.withColumn("local_depth", F.avg("depth").over(around)).where("__own = __blk").select(
        "contig", "bin", "lo", "n_bins", "local_depth")


def with_local_depth(df: DataFrame, track: DataFrame, pos: str, bin_size: int = 1000, window: int = DEPTH_WINDOW,
                     regions: DataFrame | None = None) -> DataFrame:
    """Add ``local_depth`` around ``pos``; 0 on contigs without a track.

    ``regions`` are the ones the track was made for; without them they are read off the track.
    """
    smooth = smoothed_track(track, window)
    if regions is None:
        extent = track.groupBy("contig").agg(F.first("lo").alias("lo"), F.first("n_bins").alias("n_bins"))
    else:
        extent = region_grid(regions, bin_size)
    extent = extent.select("contig", F.col("lo").alias("__lo"), F.col("n_bins").alias("__n"))
    at = F.floor((F.col(pos) - F.col("__lo")) / bin_size)
    keyed = df.join(extent, "contig", "left").withColumn(
        "bin", F.greatest(F.lit(-window), F.least(at, F.col("__n") + window - 1)))
    return (
        keyed.join(smooth.select("contig", "bin", "local_depth"), ["contig", "bin"], "left")
        .withColumn("local_depth", F.coalesce("local_depth", F.lit(0.0)))
        .drop("bin", "__lo", "__n")
    )


def global_coverage(alignments: DataFrame, contigs: DataFrame, order: list[str],
                    sample_reads: int | None = None, mapped_reads: DataFrame | None = None) -> DataFrame:
    """One row: mapped reads x mean length of primary reads / reference length.

    NULL when there is nothing to estimate from. All primary reads count, in one combined aggregate. Only where
    ``sample_reads`` is given, the mean is that of so many first reads in ``order``. ``mapped_reads`` (one column
    ``n``) may come from an index instead of a count.
    """
    length = F.when(F.col("query_length") > 0, F.col("query_length")).otherwise(
        F.greatest(F.lit(0), F.col("ref_end") - F.col("pos0")))
    primary = alignments.where(F.col("flag").bitwiseAND(IGNORED_FLAGS) == 0).withColumn("__len", length).where(F.col("__len") > 0)
    head = (primary if sample_reads is None else primary.orderBy(*order).limit(sample_reads)).agg(F.avg("__len").alias("mean_length"))
    if mapped_reads is None:
        mapped_reads = alignments.where(F.col("flag").bitwiseAND(4) == 0).agg(F.count(F.lit(1)).alias("n"))
    total = contigs.where(F.col("length") > 0).agg(F.sum("length").alias("total"))
    # Three one-row aggregates side by side.
    one = F.lit(1)
    joined = (
        head.withColumn("k", one)
        .join(mapped_reads.select(F.col("n").alias("mapped")).withColumn("k", one), "k")
        .join(total.withColumn("k", one), "k")
    )
    usable = (F.col("mapped") > 0) & (F.col("total") > 0) & (F.col("mean_length") > 0)
    return joined.select(F.when(usable, F.col("mapped") * F.col("mean_length") / F.col("total")).alias("coverage"))
