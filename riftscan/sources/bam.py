"""Indexed BAM files as a Spark data source, to read and to write.

The index gives record-aligned offsets, so a file splits into byte ranges that tasks read on their own:
nobody scans the file to plan the read, and a range costs only its own blocks. Requests for a contig or
region open only the ranges that can hold its reads. Records are decoded column by column, and only the
columns that are asked for. A folder of BAM files is read as one; writing makes such a folder, one sorted
file with its index for each task. Formats follow the public SAM/BAM specification.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

from ..schemas import ALIGNMENTS
from . import bam_index
from .bam_records import ARROW, Records, chain, decode, encode

#: Unmapped, secondary and supplementary records do not count for the ``head`` option.
_IGNORED = 4 | 256 | 2048
#: Decompressed bytes that are decoded at once, and bytes of a written block before compression.
_PIECE, _BLOCK = 4 << 20, 0xFF00


def _locate(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _open(path: str):
    filesystem, inner = _locate(path)
    return filesystem.open_input_file(inner)


def _read(path: str) -> bytes:
    with _open(path) as handle:
        return handle.read()


def files_of(path: str) -> list[str]:
    """The BAM files of a folder in the order of their names, or the file itself."""
    filesystem, inner = _locate(path)
    if filesystem.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    names = [f.base_name for f in filesystem.get_file_info(pafs.FileSelector(inner)) if f.base_name.endswith(".bam") and f.base_name[0] not in "._"]
    if not names:
        raise FileNotFoundError(f"no BAM file in {path}")
    return [f"{path.rstrip('/')}/{name}" for name in sorted(names)]


def blocks(handle, at: int) -> Iterator[tuple[int, bytes]]:
    """Offset and decompressed bytes of the blocks from ``at`` on."""
    while True:
        handle.seek(at)
        head = handle.read(18)
        if len(head) < 18:
            return
        size = struct.unpack_from("<H", head, 16)[0] + 1
        yield at, zlib.decompress(handle.read(size - 18)[:-8], -15)
        at += size


def block_of(data: bytes) -> bytes:
    """One compressed block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


def read_header(path: str) -> tuple[list[tuple[str, int]], int]:
    """Contigs (name, length) in file order, and the offset of the first record."""
    with _open(files_of(path)[0]) as handle:
        data, at, starts, source = b"", 0, [], blocks(handle, 0)

        def take(n: int) -> bytes:
            nonlocal data, at
            while len(data) < at + n:
                offset, more = next(source, (0, None))
                if more is None:
                    raise ValueError(f"not a BAM file: {path}")
                starts.append((len(data), offset))
                data += more
            at += n
            return data[at - n:at]

        def number() -> int:
            return struct.unpack("<i", take(4))[0]

        if take(4) != b"BAM\1":
            raise ValueError(f"not a BAM file: {path}")
        take(number())
        contigs = []
        for _ in range(number()):
            name = take(number())[:-1].decode()
            contigs.append((name, number()))
        if at == len(data):
            offset, _ = next(source, (None, b""))
            return contigs, (offset if offset is not None else handle.size()) << 16
        begin, offset = max(s for s in starts if s[0] <= at)
        return contigs, offset << 16 | at - begin


def read_index(path: str, index_path: str | None = None) -> list[bam_index.ContigIndex]:
    """Index entries by contig, of a .bai or .csi file."""
    return bam_index.find(path, index_path, _read)


class Slice(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None, contig: str | None, start: int | None, stop: int | None) -> None:
        self.path, self.begin, self.end, self.contig, self.start, self.stop = path, begin, end, contig, start, stop


class BamReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.columns = options["path"], columns
        self.index_path = options.get("indexpath")
        self.split_bytes = int(options.get("splitbytes", 64 << 20))
        self.batch_rows = int(options.get("batchrows", 2048))
        self.contig = options.get("contig")
        self.start = int(options["start"]) if options.get("start") else None
        self.stop = int(options["end"]) if options.get("end") else None
        self.head = int(options.get("head", 0))
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Contig filters narrow the ranges that are read; Spark still applies every filter itself."""
        for item in filters:
            names = None
            if isinstance(item, EqualTo) and item.attribute == ("contig",):
                names = {item.value}
            elif isinstance(item, In) and item.attribute == ("contig",):
                names = set(item.value)
            if names is not None:
                self.only = names if self.only is None else self.only & names
            yield item

    def partitions(self) -> list[Slice]:
        return [s for path in files_of(self.path) for s in self._slices(path)]

    def _slices(self, path: str) -> list[Slice]:
        contigs, first = read_header(path)
        if self.head:
            return [Slice(path, first, None, None, None, None)]
        index = read_index(path, self.index_path)
        if self.contig is not None or self.only is not None:
            wanted = [i for i, (name, _) in enumerate(contigs)
                      if (self.contig is None or name == self.contig) and (self.only is None or name in self.only)]
            return [s for i in wanted for s in self._contig_slices(path, index, i, contigs[i][0], first)]
        marks = sorted({first, *(o for e in index for o in e.marks(first))})
        return self._cut(path, marks, None, None)

    def _contig_slices(self, path: str, index: list[bam_index.ContigIndex], i: int, name: str, first: int) -> list[Slice]:
        marks = index[i].marks(first)
        if not marks:
            return []
        end = min((at for e in index[i + 1:] for _, at in e.chunks if at > marks[-1]), default=None)
        if self.start is not None:
            low = index[i].lower(self.start)
            marks = [m for m in marks if m >= low] or marks[-1:]
        if self.stop is not None and (high := index[i].upper(self.stop)) is not None:
            marks = [m for m in marks if m < high]
            end = high
        return self._cut(path, marks, end, name) if marks else []

    def _cut(self, path: str, marks: list[int], end: int | None, contig: str | None) -> list[Slice]:
        """Join neighbouring marks until a slice holds enough compressed bytes."""
        begins = [marks[0]]
        for mark in marks[1:]:
            if (mark >> 16) - (begins[-1] >> 16) >= self.split_bytes:
                begins.append(mark)
        region = (contig, self.start, self.stop) if contig is not None else (None, None, None)
        return [Slice(path, a, b, *region) for a, b in zip(begins, [*begins[1:], end], strict=True)]

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a request that no read can answer
            return
        contigs = [name for name, _ in read_header(partition.path)[0]]
        names, wanted = pa.array(contigs, pa.string()), contigs.index(partition.contig) if partition.contig is not None else None
        left = self.head or None
        for records in self._records(partition):
            ended = False
            if wanted is not None:  # the file is sorted, and the slice began inside the contig
                behind = records.field("ref") != wanted
                if partition.stop is not None:
                    behind |= records.field("pos") >= partition.stop
                if behind.any():
                    records, ended = records.keep(np.arange(len(records)) < behind.argmax()), True
            if partition.start is not None and len(records):
                records = records.keep(records.mapped() & (records.ref_end() > partition.start))
            if left is not None:
                records = records.keep(records.field("flag") & _IGNORED == 0)
                records = records.keep(np.arange(len(records)) < left)
                left -= len(records)
                ended = not left
            if len(records):
                yield decode(records, names, self.columns)
            if ended:
                return

    def _records(self, part: Slice) -> Iterator[Records]:
        with _open(part.path) as handle:
            source = blocks(handle, part.begin >> 16)
            data, at, limit, more = b"", part.begin & 0xFFFF, None, True
            while more and (limit is None or at < limit):
                pieces, size, full = [data], len(data), len(data) + _PIECE
                while size < full:
                    offset, piece = next(source, (0, None))
                    if piece is None:
                        more = False
                        break
                    if part.end is not None and limit is None and offset >= part.end >> 16:
                        limit = size + (part.end & 0xFFFF if offset == part.end >> 16 else 0)
                    pieces.append(piece)
                    size += len(piece)
                data = b"".join(pieces)
                found, after = chain(data, at, limit)
                view, begin = np.frombuffer(data, np.uint8), np.array(found, np.int64)
                end = np.append(begin[1:] - 4, after)[:len(begin)]
                for k in range(0, len(begin), self.batch_rows):
                    yield Records(view, begin[k:k + self.batch_rows], end[k:k + self.batch_rows])
                data, at, limit = data[after:], 0, None if limit is None else limit - after


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    name: str
    rows: int


class BamWriter(DataSourceArrowWriter):
    """One sorted BAM file with a .csi index for each task; files appear under their names when the job has succeeded."""

    def __init__(self, path: str, contigs: list[tuple[str, int]]) -> None:
        self.path, self.contigs = path.rstrip("/"), contigs

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.bam"
        temporary = f"_{name}-{uuid.uuid4().hex}"
        filesystem, inner = _locate(self.path)
        filesystem.create_dir(inner, recursive=True)
        ids = {contig: i for i, (contig, _) in enumerate(self.contigs)}
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{length}\n" for n, length in self.contigs)
        head = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(self.contigs))
        for contig, length in self.contigs:
            head += struct.pack("<i", len(contig.encode()) + 1) + contig.encode() + b"\0" + struct.pack("<i", length)
        facts: dict[str, list[np.ndarray]] = {k: [] for k in ("ref", "begin", "end", "at", "mapped")}
        starts, pending, written = [], b"", 0
        with filesystem.open_output_stream(f"{inner}/{temporary}") as out:
            def flush(whole: bool) -> None:
                nonlocal pending, written
                while len(pending) >= _BLOCK or whole and pending:
                    block = block_of(pending[:_BLOCK])
                    starts.append(written)
                    out.write(block)
                    written += len(block)
                    pending = pending[_BLOCK:]

            for k in range(0, len(head), _BLOCK):
                block = block_of(head[k:k + _BLOCK])
                out.write(block)
                written += len(block)
            total = 0
            for batch in iterator:
                body, seen = encode(batch.select(ARROW.names), ids)
                seen["at"] = seen["at"] + total
                for key, values in facts.items():
                    values.append(seen[key])
                pending, total = pending + body, total + len(body)
                flush(False)
            flush(True)
            starts.append(written)
            out.write(block_of(b""))
        known = {key: np.concatenate(values) if values else np.zeros(0, np.int64) for key, values in facts.items()}
        block_at = np.array(starts, np.int64)
        offset = lambda x: block_at[x // _BLOCK] << 16 | x % _BLOCK if len(x) else x
        after = offset(np.append(known["at"][1:], total)[:len(known["at"])])
        index = bam_index.csi(self.contigs, known["ref"], known["begin"], known["end"], offset(known["at"]), after, known["mapped"].astype(bool))
        with filesystem.open_output_stream(f"{inner}/{temporary}.csi") as out:
            for k in range(0, len(index), _BLOCK):
                out.write(block_of(index[k:k + _BLOCK]))
            out.write(block_of(b""))
        return Written(temporary, name, len(known["at"]))

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, inner = _locate(self.path)
        for message in messages:
            if message is not None:
                for suffix in ("", ".csi"):
                    filesystem.move(f"{inner}/{message.temporary}{suffix}", f"{inner}/{message.name}{suffix}")

    def abort(self, messages: list[Written | None]) -> None:
        filesystem, inner = _locate(self.path)
        for message in messages:
            if message is not None:
                for suffix in ("", ".csi"):
                    filesystem.delete_file(f"{inner}/{message.temporary}{suffix}")


class BamDataSource(DataSource):
    """``spark.read.format("bam")``; options: columns, contig, start, end, splitBytes, batchRows, indexPath, head.

    ``columns`` names the columns that are decoded. ``head`` reads only the first so many primary mapped records, in file
    order, and stops there. Writing takes ``contigs`` (name:length, separated by commas, in file order).
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self):
        named = self._options().get("columns")
        return T.StructType([ALIGNMENTS[c] for c in named.split(",")]) if named else ALIGNMENTS

    def reader(self, schema) -> BamReader:
        return BamReader(self._options(), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> BamWriter:
        options = self._options()
        contigs = [(n, int(length)) for n, length in (c.rsplit(":", 1) for c in options["contigs"].split(",") if c)]
        return BamWriter(options["path"], contigs)


def read_bam(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None,
             end: int | None = None, columns: list[str] | None = None, **options: object) -> DataFrame:
    """Alignments of an indexed BAM file or a folder of them, whole or of one region; ``columns`` leaves the others undecoded."""
    spark.dataSource.register(BamDataSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("bam")
    for key, value in {"contig": contig, "start": start, "end": end, "columns": ",".join(columns) if columns else None, **options}.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(path)


def write_bam(alignments: DataFrame, path: str, contigs: list[tuple[str, int]], files: int | None = None) -> None:
    """Alignments as a folder of sorted BAM files with indexes, dealt by range of (contig, position).

    ``contigs`` are names and lengths in file order; rows of other contigs are written as unmapped, behind all others.
    """
    spark = alignments.sparkSession
    spark.dataSource.register(BamDataSource)
    order = F.coalesce(F.array_position(F.array(*(F.lit(n) for n, _ in contigs)), F.col("contig")), F.lit(0)) if contigs else F.lit(0)
    rows = alignments.select(*ALIGNMENTS.fieldNames()).withColumn("_order", F.when(order == 0, len(contigs) + 1).otherwise(order))
    by = ["_order", "pos0", "qname", "flag"]
    dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).drop("_order").write.format("bam").mode("append").option(
        "contigs", ",".join(f"{n}:{length}" for n, length in contigs)).save(path)


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Header table (contig, length)."""
    return spark.createDataFrame(read_header(path)[0] or [("", 0)], "contig string, length bigint").where("length > 0")


def bam_mapped_reads(spark: SparkSession, path: str) -> DataFrame:
    """One row: mapped reads according to the index statistics."""
    return spark.createDataFrame([(sum(e.mapped for p in files_of(path) for e in read_index(p)),)], "n bigint")
