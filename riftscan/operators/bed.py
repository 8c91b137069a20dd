"""Interval sets (BED) and the overlap semi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import merge_touching

#: Width of the lookup bins of the overlap join.
BED_BIN = 1 << 14


def contig_aliases(df: DataFrame) -> DataFrame:
    """Every interval under both contig spellings, with and without the ``chr`` prefix."""
    name = F.col("contig")
    stripped = F.substring(name, F.lit(4), F.length(name))
    other = F.when(name.startswith("chr") & (F.length(name) > 3), stripped).otherwise(F.concat(F.lit("chr"), name))
    return df.withColumn("contig", F.explode(F.array(name, other)))


def merged_bed(bed: DataFrame) -> DataFrame:
    """Aliased, merged, disjoint intervals per contig; empty intervals drop out."""
    usable = bed.where(F.col("end") > F.col("start")).select("contig", "start", "end")
    return merge_touching(contig_aliases(usable), ["contig"])


def bed_index(merged: DataFrame, bin_bp: int = BED_BIN) -> DataFrame:
    """Lookup rows (contig, bin, hits, carry_end): the intervals that start in a bin, and the end of the
    last interval that starts before it. Bins run without holes up to the last start of the contig.
    """
    starts = merged.groupBy("contig", F.floor(F.col("start") / bin_bp).alias("bin")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"),
        F.max("end").alias("__end"))
    grid = starts.groupBy("contig").agg(F.max("bin").alias("last_bin"), F.min("bin").alias("first_bin"))
    cells = grid.select("contig", "last_bin", F.explode(F.sequence("first_bin", F.col("last_bin") + 1)).alias("bin"))
    before = Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # Merged intervals are disjoint and sorted, so the largest earlier end is the last one's end.
    return (
        cells.join(starts, ["contig", "bin"], "left")
        .withColumn("carry_end", F.max("__end").over(before))
        .select("contig", "bin", "last_bin", "hits", "carry_end")
    )


def _with_overlap(df: DataFrame, bed: DataFrame, start: str, end: str, bin_bp: int) -> DataFrame:
    """Mark rows whose interval overlaps the set.

    The intervals are disjoint, so only the last one that starts before the row's end can decide: one
    lookup per row in the bin of its last base, no exploding of rows and nothing to deduplicate.
    """
    index = bed_index(merged_bed(bed), bin_bp)
    bounds = index.groupBy("contig").agg(F.max("last_bin").alias("__last_bin"))
    left = F.greatest(F.least(F.col(start), F.col(end)), F.lit(0))
    right = F.greatest(F.col(start), F.col(end), left + 1)
    keyed = (
        df.withColumn("__s", left).withColumn("__e", right)
        .join(bounds, "contig", "left")
        .withColumn("bin", F.least(F.floor((F.col("__e") - 1) / bin_bp), F.col("__last_bin") + 1))
    )
    here = F.filter("hits", lambda h: h["start"] < F.col("__e"))
    last_end = F.coalesce(F.try_element_at(here, F.lit(-1))["end"], F.col("carry_end"))
    return (
        keyed.join(index.drop("last_bin"), ["contig", "bin"], "left")
        .withColumn("__hit", F.coalesce(last_end > F.col("__s"), F.lit(False)))
        .drop("bin", "hits", "carry_end", "__last_bin", "__s", "__e")
    )


def overlapping(df: DataFrame, bed: DataFrame | None, start: str = "tstart", end: str = "tend",
                bin_bp: int = BED_BIN) -> DataFrame:
    """Rows that overlap the interval set, each once; everything when no set is given."""
    if bed is None:
        return df
    return _with_overlap(df, bed, start, end, bin_bp).where("__hit").drop("__hit").select(*df.columns)


def not_overlapping(df: DataFrame, bed: DataFrame, start: str = "tstart", end: str = "tend",
                    bin_bp: int = BED_BIN) -> DataFrame:
    """Rows that overlap no interval of the set."""
    return _with_overlap(df, bed, start, end, bin_bp).where(~F.col("__hit")).drop("__hit").select(*df.columns)
