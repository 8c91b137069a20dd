"""Source-tag and platform tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .svtype import strip

# Accepted spellings of the sequencing platforms.
PLATFORM_SPELLINGS = {
    "ont": ("ont", "nanopore", "oxfordnanopore"),
    "ccs": ("ccs", "hifi", "pacbio_ccs", "pacbio-hifi"),
    "clr": ("clr", "pacbio_clr", "pacbio"),
}


def source_tokens(source: Column) -> Column:
    """Upper-case tokens of a source tag; separators are pipe, semicolon, comma, space and tab."""
    pieces = F.split(F.upper(F.coalesce(source, F.lit(""))), r"[|;, \t]")
    return F.filter(F.transform(pieces, strip), lambda token: token != "")


def pipe_tokens(source: Column) -> Column:
    """Tokens of the pipe-only tokenizer that the affinity bonus uses."""
    return F.filter(F.split(F.coalesce(source, F.lit("")), r"\|"), lambda token: token != "")


def mentions(source: Column, *keys: str) -> Column:
    """1.0 when any token contains any key, else 0.0.

    No key holds a separator, so a key is inside some token exactly when it is inside the whole tag:
    one substring test per key, without building the token array.
    """
    tag = F.upper(F.coalesce(source, F.lit("")))
    hit = F.lit(False)
    for key in keys:
        hit = hit | tag.contains(key)
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def normalize_platform(platform: Column) -> Column:
    """Canonical platform; unknown spellings pass through in lower case, blanks become NULL."""
    token = F.lower(strip(platform))
    expr = F.when(token == "", F.lit(None).cast("string"))
    for name, spellings in PLATFORM_SPELLINGS.items():
        expr = expr.when(token.isin(*spellings), F.lit(name))
    return expr.otherwise(token)


def source_bonus(source_a: Column, source_b: Column) -> Column:
    """1.10 for two signatures that share an evidence source, else 1.0."""
    return F.when(F.arrays_overlap(pipe_tokens(source_a), pipe_tokens(source_b)), F.lit(1.1)).otherwise(F.lit(1.0))
