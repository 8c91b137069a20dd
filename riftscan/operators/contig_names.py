"""Contig requests such as ``1-3,chrX,7``: expansion, alias resolution and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.svtype import strip

_RANGE = r"(?i)^(chr)?\s*(\d+)$"


def resolve_contig_requests(requests: DataFrame, contigs: DataFrame, ident: str = "id", spec: str = "spec") -> DataFrame:
    """Rows (id, contig, position): the contigs a request names, in request order, each once.

    Ranges count up between two numbers and take the prefix of their start, else of their end. A name
    matches a contig as it is or with the ``chr`` prefix added or removed.
    """
    part = F.col("part")
    pieces = F.split(part, "-")
    left, right = strip(F.get(pieces, F.lit(0))), strip(F.get(pieces, F.lit(1)))
    is_range = ((F.size(pieces) == 2) & ~part.startswith("-")
                & left.rlike(_RANGE) & right.rlike(_RANGE))
    low, high = (F.regexp_extract(side, _RANGE, 2).cast("int") for side in (left, right))
    prefix = F.coalesce(F.nullif(F.regexp_extract(left, _RANGE, 1), F.lit("")), F.regexp_extract(right, _RANGE, 1))
    # A falling range is empty.
    numbers = F.when(low <= high, F.transform(F.sequence(F.least(low, high), high), lambda i: F.concat(prefix, i.cast("string")))
                     ).otherwise(F.array().cast("array<string>"))
    names = F.when(is_range, numbers).otherwise(F.array(part))
    expanded = (
        requests.select(ident, F.posexplode(F.split(F.col(spec), ",")).alias("p", "raw"))
        .withColumn("part", strip(F.col("raw"))).where(part != "")
        .select(ident, "p", F.posexplode(names).alias("q", "name"))
    )
    stripped = F.substring(F.col("contig"), F.lit(4), F.length("contig"))
    other = F.when(F.col("contig").startswith("chr"), stripped).otherwise(F.concat(F.lit("chr"), F.col("contig")))
    # A contig's own name beats an alias of another one.
    aliases = contigs.select("contig", F.inline(F.array(
        F.struct(F.col("contig").alias("name"), F.lit(0).alias("alias")),
        F.struct(other.alias("name"), F.lit(1).alias("alias")))))
    lookup = aliases.groupBy("name").agg(F.min_by("contig", F.struct("alias", "contig")).alias("contig"))
    found = expanded.join(lookup, "name").groupBy(ident, "contig").agg(F.min(F.struct("p", "q")).alias("at"))
    order = Window.partitionBy(ident).orderBy("at")
    return found.select(ident, "contig", F.row_number().over(order).alias("position"))


def contig_lengths(names: DataFrame, contigs: DataFrame) -> DataFrame:
    """Length per requested contig, 0 for one the header does not know."""
    return names.join(contigs.select("contig", "length"), "contig", "left").withColumn(
        "length", F.coalesce("length", F.lit(0)))
