"""Structural-variant type labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .interval import safe_interval

# Canonical types and accepted synonyms.
CANONICAL_TYPES = ("DEL", "INS", "DUP", "INV", "TRA")
TYPE_SYNONYMS = {
    "BND": "TRA",
    "CTX": "TRA",
    "TRANSLOCATION": "TRA",
    "DELETION": "DEL",
    "INSERTION": "INS",
    "DUPLICATION": "DUP",
    "TANDEM": "DUP",
    "INVERSION": "INV",
}
# Substrings of a source tag that reveal the type, in order of precedence.
SOURCE_HINTS = (
    (("TRA", "BND"), "TRA"),
    (("INV",), "INV"),
    (("DUP",), "DUP"),
    (("DEL",), "DEL"),
    (("INS", "CLIP"), "INS"),
)
# Substrings of a legacy record kind, in order of precedence.
LEGACY_KIND_HINTS = (
    (("DEL", "UNCOVERED", "GAP"), "DEL"),
    (("INS", "SOFT", "CLIP"), "INS"),
    (("DUP",), "DUP"),
    (("INV",), "INV"),
    (("TRA", "BND"), "TRA"),
)
_BLANKS = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(_BLANKS))


def _first_hint(value: Column, hints) -> Column:
    """The type of the first hint group with a substring in ``value``; NULL without one."""
    found = F.lit(None).cast("string")
    for needles, svtype in reversed(hints):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | value.contains(needle)
        found = F.when(hit, F.lit(svtype)).otherwise(found)
    return found


def normalize_svtype(value: Column) -> Column:
    """Canonical type of a free-form label, NULL where none applies.

    A whole label is looked up; otherwise a canonical type counts as a prefix before, or a suffix behind,
    a colon or underscore. Of two such types the one listed first wins.
    """
    label = strip(F.upper(value))
    names = {name: name for name in CANONICAL_TYPES} | TYPE_SYNONYMS
    whole = F.expr("map(" + ", ".join(f"'{label}', '{svtype}'" for label, svtype in names.items()) + ")")
    order = F.expr("array(" + ", ".join(f"'{name}'" for name in CANONICAL_TYPES) + ")")
    either = "|".join(CANONICAL_TYPES)
    front = F.array_position(order, F.regexp_extract(label, f"^({either})[:_]", 1))
    back = F.array_position(order, F.regexp_extract(label, f"[:_]({either})$", 1))
    first = F.least(F.nullif(front, F.lit(0)), F.nullif(back, F.lit(0)))
    return F.coalesce(F.try_element_at(whole, label), F.get(order, (first - 1).cast("int")))


def guess_svtype(svtype: Column, source: Column, svlen: Column, tstart: Column, tend: Column,
                 sa_contigs: Column, legacy_type: Column | None = None) -> Column:
    """Type of a record: its label, its legacy label, its source tag, then its geometry."""
    legacy = F.lit(None).cast("string") if legacy_type is None else normalize_svtype(legacy_type)
    tag = F.upper(F.coalesce(source, F.lit("")))
    size = F.abs(F.coalesce(svlen, F.lit(0)))
    box = safe_interval(F.coalesce(tstart, F.lit(0)), F.coalesce(tend, tstart, F.lit(0)))
    narrow = (box["right"] - box["left"]) <= 5
    has_partner = F.coalesce(F.size(sa_contigs) > 0, F.lit(False))
    geometry = (
        F.when((size > 0) & narrow, F.lit("INS"))
        .when((size == 0) & has_partner, F.lit("TRA"))
        .when(narrow, F.lit("INS"))
        .otherwise(F.lit("DEL"))
    )
    return F.coalesce(normalize_svtype(svtype), legacy, _first_hint(tag, SOURCE_HINTS), geometry)


def labelled_svtype(svtype: Column, guessed: Column) -> Column:
    """Canonical type of the label when there is one (even an unusable one), else of the guess."""
    has_label = F.coalesce(svtype != "", F.lit(False))
    return F.when(has_label, normalize_svtype(svtype)).otherwise(guessed)


def type_bucket(svtype: Column, guessed: Column, include_tra: bool = False) -> Column:
    """Clustering bucket; NULL drops the row (translocations unless they are asked for)."""
    kind = labelled_svtype(svtype, guessed)
    tra = F.lit("TRA") if include_tra else F.lit(None).cast("string")
    return F.when(kind == "TRA", tra).otherwise(F.coalesce(kind, F.lit("UNK")))


def legacy_kind_svtype(kind: Column) -> Column:
    """Type of a record that only carries a legacy kind such as SOFT or UNCOVERED."""
    return _first_hint(F.upper(kind), LEGACY_KIND_HINTS)


def svtype_id(svtype: Column, guessed: Column) -> Column:
    """Class label used in training: position of the type, 5 for anything else."""
    kind = F.coalesce(normalize_svtype(svtype), guessed)
    expr = F.lit(len(CANONICAL_TYPES))
    for index, name in enumerate(CANONICAL_TYPES):
        expr = F.when(kind == name, F.lit(index)).otherwise(expr)
    return expr
