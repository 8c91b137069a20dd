"""Split-read evidence: aligned segments of one read and the events their arrangement implies.

Everything is column expressions: segments are an array per read, neighbouring segments are exploded to
one row per pair or triple inside the same task, and the rules are evaluated side by side on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg

#: Read gap up to which two segments on different contigs count as joined.
BREAKEND_READ_GAP = 100
#: Overlap tolerated between the outer segments of a reverse-forward-reverse inversion.
INVERSION_SLACK = -50

_SEGMENT = "struct<q0:bigint,ord:int,q1:bigint,r0:bigint,r1:bigint,ctg:string,st:string>"
_CANDIDATE = "struct<rule:int,kind:string,contig:string,a:double,b:bigint,seq:string,strand:string,partner:string>"


def _segment(q0: Column, order: Column, q1: Column, r0: Column, r1: Column, ctg: Column, st: Column) -> Column:
    return F.struct(q0.alias("q0"), order.alias("ord"), q1.alias("q1"), r0.alias("r0"), r1.alias("r1"),
                    ctg.alias("ctg"), st.alias("st")).cast(_SEGMENT)


def primary_segment(items: Column, min_mapq: int) -> Column:
    """Segment of the primary alignment in read coordinates; NULL below the mapping quality."""
    forward = F.col("flag") == 0
    size = F.col("query_length").cast("bigint")

    def build(parsed: Column) -> Column:
        left, right = cg.leading_clip(parsed, "SH"), cg.trailing_clip(parsed, "SH")
        return _segment(F.when(forward, left).otherwise(right), F.lit(0), size - F.when(forward, right).otherwise(left),
                        F.col("pos0"), F.col("ref_end"), F.col("contig"), F.when(forward, "+").otherwise("-"))

    return F.when(F.col("mapq") >= min_mapq, cg.let(items, build))


def supplementary_segments(sa: Column, min_mapq: int) -> Column:
    """Segments of the SA tag. Positions are used as the tag gives them; only clean entries count."""
    entries = F.split(sa, ";")
    entries = F.slice(entries, F.lit(1), F.greatest(F.size(entries) - 1, F.lit(0)))

    size = F.col("query_length").cast("bigint")
    # Split, drop the poorly mapped, then parse: each step works on the array of the one before.
    parts = F.transform(entries, lambda entry, index: F.struct(F.split(entry, ",").alias("part"), index.alias("at")))
    good = F.filter(parts, lambda p: p["part"][4].cast("int") >= min_mapq)
    parsed = F.transform(good, lambda p: F.struct(p["part"].alias("part"), p["at"].alias("at"),
                                                  cg.clip_and_bias(p["part"][3]).alias("clips")))

    def build(p: Column) -> Column:
        part, clips = p["part"], p["clips"]
        start, forward = part[1].cast("bigint"), part[2] == "+"
        return _segment(F.when(forward, clips["left"]).otherwise(clips["right"]), (p["at"] + 1).cast("int"),
                        size - F.when(forward, clips["right"]).otherwise(clips["left"]),
                        start, start + clips["bias"], part[0], part[2])

    return F.transform(parsed, build)


def with_segments(reads: DataFrame, min_mapq: int, max_parts: int) -> DataFrame:
    """Reads with split evidence and their ``segments``, sorted by read start.

    Only flags 0 and 16 take part. A read with more than ``max_parts`` segments gets NULL (-1: never).
    """
    split = reads.where(F.col("flag").isin(0, 16) & F.col("sa").isNotNull() & (F.col("sa") != ""))
    items = cg.cigar_items(F.col("cigar"))
    primary = F.filter(F.array(primary_segment(items, min_mapq)), lambda s: s.isNotNull())
    segments = F.array_sort(F.concat(primary, supplementary_segments(F.col("sa"), min_mapq)))
    if max_parts != -1:
        segments = cg.let(segments, lambda s: F.when(F.size(s) <= max_parts, s))
    return split.withColumn("segments", segments)


def read_segments(reads: DataFrame, min_mapq: int = 20, max_parts: int = 7) -> DataFrame:
    """``with_segments`` without the reads that have too many."""
    return with_segments(reads, min_mapq, max_parts).where(F.col("segments").isNotNull())


def _mirror(segment: Column) -> Column:
    """Segment in the coordinates of the reverse-complemented read."""
    size = F.col("query_length").cast("bigint")
    return _segment(size - segment["q1"], segment["ord"], size - segment["q0"], segment["r0"], segment["r1"],
                    segment["ctg"], segment["st"])


def _units(segments: Column) -> Column:
    """Array of the segment groups the rules look at: a pair, or all triples plus the outer pair."""
    unit = f"struct<mode:string,at:int,last:boolean,e1:{_SEGMENT},e2:{_SEGMENT},e3:{_SEGMENT}>"
    n = F.size(segments)

    def make(mode: str, at: Column, last: Column, e1: Column, e2: Column, e3: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), at.cast("int").alias("at"), last.alias("last"), e1.alias("e1"),
                        e2.alias("e2"), e3.alias("e3")).cast(unit)

    missing = F.lit(None).cast(_SEGMENT)
    pair = F.array(make("pair", F.lit(0), F.lit(True), F.get(segments, F.lit(0)), F.get(segments, F.lit(1)), missing))
    steps = F.sequence(F.lit(0), n - 3)
    triples = F.transform(steps, lambda i: make("triple", i, i == n - 3, F.get(segments, i), F.get(segments, i + 1),
                                                F.get(segments, i + 2)))
    first, last = F.get(segments, F.lit(0)), F.element_at(segments, -1)
    jumped = F.exists(steps, lambda i: F.get(segments, i)["ctg"] != F.get(segments, i + 1)["ctg"])
    outer = F.when(jumped & (first["ctg"] == last["ctg"]) & (first["st"] == last["st"]),
                   F.array(make("outer", F.lit(0), F.lit(True), first, last, missing))
                   ).otherwise(F.array().cast(f"array<{unit}>"))
    return F.when(n == 2, pair).when(n >= 3, F.concat(triples, outer)).otherwise(F.array().cast(f"array<{unit}>"))


def _candidate(rule: int, when: Column, kind: str, contig: Column, a: Column, b: Column, seq: Column | None = None,
               strand: Column | str | None = None, partner: Column | None = None) -> Column:
    strand = F.lit(strand) if not isinstance(strand, Column) else strand
    body = F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), contig.alias("contig"), a.cast("double").alias("a"),
                    b.cast("bigint").alias("b"), (F.lit(None) if seq is None else seq).cast("string").alias("seq"),
                    strand.cast("string").alias("strand"),
                    (F.lit(None) if partner is None else partner).cast("string").alias("partner"))
    return F.when(when, body.cast(_CANDIDATE))


def _half(value: Column) -> Column:
    """Half of a whole number, cut towards zero."""
    return (value / 2).cast("bigint")


def _inserted(first: Column, second: Column, shift: Column) -> Column:
    return cg.slice_text(F.col("oriented"), first["q1"] + _half(shift), second["q0"] - _half(shift))


def _breakend(rule: int, when: Column, e1: Column, e2: Column) -> Column:
    """Translocation between two segments, anchored on the contig whose name sorts first."""
    at1 = F.when(e1["st"] == "+", e1["r1"]).otherwise(e1["r0"])
    at2 = F.when(e2["st"] == "+", e2["r0"]).otherwise(e2["r1"])
    ahead = e1["ctg"] < e2["ctg"]
    letter = (F.when((e1["st"] == "+") & (e2["st"] == "+"), F.when(ahead, "A").otherwise("D"))
              .when((e1["st"] == "+"), "B").when(e2["st"] == "+", "C")
              .otherwise(F.when(ahead, "D").otherwise("A")))
    near = e2["q0"] - e1["q1"] <= BREAKEND_READ_GAP
    return _candidate(rule, when & near, "TRA", F.when(ahead, e1["ctg"]).otherwise(e2["ctg"]),
                      F.when(ahead, at1).otherwise(at2), F.when(ahead, at2).otherwise(at1),
                      strand=letter, partner=F.when(ahead, e2["ctg"]).otherwise(e1["ctg"]))


def split_candidates(reads: DataFrame, min_sv_size: int = 30, max_sv_size: int = 100_000, min_mapq: int = 20,
                     max_parts: int = 7, keep: tuple[str, ...] = ("sid", "qname")) -> DataFrame:
    """Candidate events of split reads: the ``keep`` columns, the unit, and kind, contig, a, b, seq, strand, partner.

    ``a``/``b`` are position and length (DEL, INS), start and end (DUP, INV), or both positions (TRA).
    """
    # No filter on the segments here: it would be pushed below them and compute them twice.
    df = with_segments(reads, min_mapq, max_parts)
    df = df.select(*keep, "query_length", "flag", "seq", F.inline(_units(F.col("segments"))))
    e1, e2, e3 = F.col("e1"), F.col("e2"), F.col("e3")
    triple, pair, outer = F.col("mode") == "triple", F.col("mode") == "pair", F.col("mode") == "outer"
    one_contig = (e1["ctg"] == e2["ctg"]) & F.coalesce(e2["ctg"] == e3["ctg"], F.lit(True))
    one_strand = (e1["st"] == e2["st"]) & F.coalesce(e2["st"] == e3["st"], F.lit(True))
    turned = one_strand & (e1["st"] == "-")
    # The stored sequence of a reverse read runs along the reference; evidence is read along the read.
    read_seq = F.when(F.col("flag") == 0, F.coalesce("seq", F.lit(""))).otherwise(
        cg.reverse_complement(F.coalesce("seq", F.lit(""))))
    last = F.coalesce(e3, e2)
    df = (
        df.withColumn("one_contig", one_contig).withColumn("one_strand", one_strand)
        .withColumn("o1", F.when(turned, _mirror(last)).otherwise(e1))
        .withColumn("o2", F.when(turned, F.when(e3.isNotNull(), _mirror(e2)).otherwise(_mirror(e1))).otherwise(e2))
        .withColumn("o3", F.when(turned & e3.isNotNull(), _mirror(e1)).otherwise(e3))
        .withColumn("oriented", F.when(turned, cg.reverse_complement(read_seq)).otherwise(read_seq))
    )
    o1, o2, o3 = F.col("o1"), F.col("o2"), F.col("o3")
    size = F.lit(int(min_sv_size))

    def fits(value: Column) -> Column:
        return F.lit(True) if max_sv_size == -1 else value <= int(max_sv_size)

    straight = F.col("one_contig") & F.col("one_strand")
    back = o1["r1"] - o2["r0"]
    read_gap = o2["q0"] - o1["q1"]
    extra = read_gap + back
    clear = F.coalesce(o3["r0"] >= o2["r1"], F.lit(True))

    def insertion(number: int, when: Column) -> Column:
        rule = (back < F.greatest(size, extra / 5)) & (extra >= size) & (-back <= F.greatest(F.lit(100), extra / 5)) & fits(extra)
        return _candidate(number, when & rule, "INS", o2["ctg"], (o2["r0"] + o1["r1"]) / 2, extra, _inserted(o1, o2, -back))

    def deletion(number: int, when: Column) -> Column:
        lost = -extra
        rule = (back < F.greatest(size, lost / 5)) & (lost >= size) & (read_gap <= F.greatest(F.lit(100), lost / 5)) & fits(lost)
        return _candidate(number, when & rule, "DEL", o2["ctg"], o1["r1"], lost)

    # Inversion of a pair: both ends of the flipped part, and half of it as slack on the read.
    forward = e1["st"] == "+"
    flip1, flip2 = F.when(forward, e1["r1"]).otherwise(e1["r0"]), F.when(forward, e2["r1"]).otherwise(e2["r0"])
    flipped = F.abs(flip2 - flip1)
    pair_inversion = (pair & F.col("one_contig") & ~F.col("one_strand") & (flipped >= size) & fits(flipped)
                      & (e2["q0"] + flipped * 0.5 >= e1["q1"]))
    # Inversion inside a triple: the middle segment runs against the outer two.
    against = triple & F.col("one_contig") & (e1["st"] == e3["st"]) & (e1["st"] != e2["st"])
    ahead_slack = (e3["r0"] - e1["r1"]) * 0.5
    middle_reverse = (against & (e2["st"] == "-") & (e2["q0"] + ahead_slack >= e1["q1"]) & (e3["q0"] + ahead_slack >= e2["q1"])
                      & (e2["r0"] >= e1["r1"]) & (e3["r0"] >= e2["r1"]))
    back_slack = (e1["r0"] - e3["r1"]) * 0.5
    middle_forward = (against & (e2["st"] == "+") & (e1["q1"] <= e2["q0"] + back_slack) & (e3["q0"] + back_slack >= e2["q1"])
                      & (e2["r0"] - e3["r1"] >= INVERSION_SLACK) & (e1["r0"] - e2["r1"] >= INVERSION_SLACK))
    ref_gap = -back
    surplus = read_gap - ref_gap
    rules = [
        _candidate(0, pair & straight & (back >= size) & (read_gap >= back) & (extra >= size) & fits(extra), "INS", o2["ctg"],
                   (o1["r1"] + o2["r0"]) / 2, extra, _inserted(o1, o2, back)),
        _candidate(1, pair & straight & (back >= size) & (read_gap < back) & fits(back), "DUP", o2["ctg"], o2["r0"], o1["r1"]),
        insertion(2, pair & straight),
        deletion(3, pair & straight),
        _candidate(4, pair_inversion, "INV", e1["ctg"], F.least(flip1, flip2), F.greatest(flip1, flip2),
                   strand=F.when(forward, "++").otherwise("--")),
        _breakend(5, pair & (e1["ctg"] != e2["ctg"]), e1, e2),
        _candidate(6, middle_reverse & fits(e2["r1"] - e1["r1"]), "INV", e1["ctg"], e1["r1"], e2["r1"], strand="++"),
        _candidate(7, middle_reverse & fits(e3["r0"] - e2["r0"]), "INV", e1["ctg"], e2["r0"], e3["r0"], strand="--"),
        _candidate(8, middle_forward & fits(e2["r1"] - e3["r1"]), "INV", e1["ctg"], e3["r1"], e2["r1"], strand="++"),
        _candidate(9, middle_forward & fits(e1["r0"] - e2["r0"]), "INV", e1["ctg"], e2["r0"], e1["r0"], strand="--"),
        _candidate(10, triple & straight & (o2["r1"] - o3["r0"] >= size) & (o2["r0"] < o3["r1"]) & fits(o2["r1"] - o3["r0"]),
                   "DUP", o2["ctg"], o3["r0"], o2["r1"]),
        _candidate(11, triple & straight & (F.col("at") == 0) & (back >= size) & fits(back), "DUP", o2["ctg"], o2["r0"], o1["r1"]),
        insertion(12, triple & straight & clear),
        deletion(13, triple & straight & clear),
        _breakend(14, triple & (e1["ctg"] != e2["ctg"]), e1, e2),
        _breakend(15, triple & (e1["ctg"] != e2["ctg"]) & F.col("last") & (e2["ctg"] != e3["ctg"]), e2, e3),
        _candidate(16, outer & (F.abs(ref_gap) < F.greatest(size, surplus / 5)) & (surplus >= size) & fits(surplus), "INS",
                   o2["ctg"], F.least(o2["r0"], o1["r1"]), surplus, _inserted(o1, o2, ref_gap)),
        _candidate(17, outer & (ref_gap <= -size) & fits(-ref_gap), "DUP", o2["ctg"], o2["r0"], o1["r1"]),
    ]
    found = F.filter(F.array(*rules), lambda c: c.isNotNull())
    return df.select(*keep, "mode", "at", F.inline(found))
