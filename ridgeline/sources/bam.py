"""BAM files, read and written block by block with zlib and struct only.

`read_bam` is a Spark data source: a file is one partition, or several where a .bai index beside it gives places at which records begin.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ridgeline.schema import READS

OPS = "MIDNSHP=X"
LETTERS = "=ACMGRSVTWYHKDBN"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
KINDS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
EMPTY_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class Blocks:
    """The uncompressed bytes of a BGZF file from a virtual offset on (file offset << 16 | offset in the block)."""

    def __init__(self, f: io.BufferedIOBase, virtual: int = 0):
        self.f, self.next, self.data, self.at = f, virtual >> 16, b"", 0
        self.block = self.next
        if virtual & 0xFFFF:
            self._load()
            self.at = virtual & 0xFFFF

    def _load(self) -> bool:
        self.f.seek(self.next)
        head = self.f.read(12)
        if len(head) < 12:
            return False
        extra = self.f.read(struct.unpack_from("<H", head, 10)[0])
        at, size = 0, 0
        while at + 4 <= len(extra):
            name, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if name == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + n
        if not size:
            raise ValueError("not a BGZF block")
        body = self.f.read(size - 12 - len(extra))
        self.block, self.next = self.next, self.next + size
        self.data, self.at = zlib.decompress(body[:-8], -15), 0
        return True

    def tell(self) -> int:
        while self.at >= len(self.data) and self._load():
            pass
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.at >= len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n]
            out.append(part)
            self.at += len(part)
            n -= len(part)
        return b"".join(out)


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]]]:
    """(text, [(contig, length)])."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = blocks.read(struct.unpack("<i", blocks.read(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return text, contigs


def tags_of(data: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + n * SIZES[sub]
        else:
            out[name] = chr(data[at]) if kind == "A" else struct.unpack_from("<" + KINDS[kind], data, at)[0]
            at += SIZES[kind]
    return out


def decode(record: bytes, contigs: Sequence[tuple[str, int]], platform: str) -> tuple:
    """A row of READS. Unmapped records and records without operations end where they begin; '*' as the sequence is null with length 1."""
    ref, pos, name_n, mapq, _, ops_n, flag, seq_n = struct.unpack_from("<iiBBHHHi", record)
    at = 32 + name_n
    name = record[32 : at - 1].decode()
    words = struct.unpack_from(f"<{ops_n}I", record, at)
    at += 4 * ops_n
    packed = record[at : at + (seq_n + 1) // 2]
    seq = "".join(LETTERS[b >> 4] + LETTERS[b & 15] for b in packed)[:seq_n] if seq_n else None
    tags = tags_of(record[at + (seq_n + 1) // 2 + seq_n :])
    span = sum(w >> 4 for w in words if OPS[w & 15] in "MDN=X")
    cigar = "".join(f"{w >> 4}{OPS[w & 15]}" for w in words) or None
    return (name, platform, flag, contigs[ref][0] if ref >= 0 else None, pos, pos + span, mapq, cigar, seq, seq_n or 1, tags.get("NM"), tags.get("SA"))


def index_offsets(path: str) -> list[int]:
    """Virtual offsets at which records begin, from a .bai index; none without one."""
    where = next((p for p in (path + ".bai", os.path.splitext(path)[0] + ".bai") if os.path.exists(p)), None)
    if where is None:
        return []
    with open(where, "rb") as f:
        data = f.read()
    found, at = set(), 8
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        n = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n):
            chunks = struct.unpack_from("<i", data, at + 4)[0]
            at += 8 + 16 * chunks
        n = struct.unpack_from("<i", data, at)[0]
        found |= set(struct.unpack_from(f"<{n}Q", data, at + 4))
        at += 4 + 8 * n
    return sorted(found - {0})


class BamPartition(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.removeprefix("file://") for p in options["path"].split(",")]
        self.platform, self.size = options.get("platform", ""), int(options.get("split_bytes", 64 << 20))

    def partitions(self) -> list[BamPartition]:
        out = []
        for path in self.paths:
            cuts, last = [0], 0
            for v in index_offsets(path):
                if (v >> 16) - last >= self.size:
                    cuts.append(v)
                    last = v >> 16
            out += [BamPartition(path, a, b) for a, b in zip(cuts, [*cuts[1:], 1 << 63], strict=True)]
        return out

    def read(self, partition: BamPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            blocks = Blocks(f)
            _, contigs = read_header(blocks)
            if partition.begin:
                blocks = Blocks(f, partition.begin)
            while blocks.tell() < partition.end and len(head := blocks.read(4)) == 4:
                yield decode(blocks.read(struct.unpack("<i", head)[0]), contigs, self.platform)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ridgeline_bam"

    def schema(self) -> StructType:
        return READS

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, path: str, platform: str = "", contig: str | None = None, start0: int | None = None, end0: int | None = None) -> DataFrame:
    """The records of BAM files (separated by commas), of a contig or of what overlaps a range if asked for."""
    spark.dataSource.register(BamSource)
    rows = spark.read.format("ridgeline_bam").option("path", path).option("platform", platform).load()
    if contig is not None:
        rows = rows.where(rows["contig"] == contig)
    if start0 is not None and end0 is not None:
        rows = rows.where((rows["start0"] < end0) & (rows["end0"] > start0))
    return rows


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, len, ord) of a BAM header; contigs without a length are left out."""
    with open(path.removeprefix("file://"), "rb") as f:
        _, contigs = read_header(Blocks(f))
    return spark.createDataFrame([(n, k, i) for i, (n, k) in enumerate(contigs) if k > 0], "contig string, len bigint, ord bigint")


def encode(row: dict, ids: dict[str, int]) -> bytes:
    """A record for a row of READS."""
    import re

    ops = [(int(n), OPS.index(op)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    name, seq = row["read_id"].encode() + b"\0", row["seq"] or ""
    codes = [LETTERS.index(c) if c in LETTERS else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    tags = b"" if row["nm"] is None else b"NMi" + struct.pack("<i", int(row["nm"]))
    tags += b"" if row["sa"] is None else b"SAZ" + row["sa"].encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ids.get(row["contig"], -1), row["start0"], len(name), row["mapq"] or 0, 0, len(ops), row["flag"], len(seq), -1, -1, 0)
    body += name + b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def header_bytes(contigs: Sequence[tuple[str, int]]) -> bytes:
    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in contigs)
    out = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    for n, k in contigs:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    return out


def block_bytes(data: bytes) -> bytes:
    """A BGZF block of at most 64 kB of data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam_parts(reads: DataFrame, contigs: Sequence[tuple[str, int]], folder: str) -> DataFrame:
    """Writes each partition of reads as a BAM file in a folder that all executors share; returns (path, records).

    contigs is the header, a row a contig. Order and number of parts are those of the DataFrame.
    """
    contigs = list(contigs)

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        path = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.bam")
        ids, n, held = {c: i for i, (c, _) in enumerate(contigs)}, 0, header_bytes(contigs)
        with open(path + ".part", "wb") as f:
            for pdf in batches:
                for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                    held += encode(row, ids)
                    n += 1
                    while len(held) >= 60_000:
                        f.write(block_bytes(held[:60_000]))
                        held = held[60_000:]
            f.write(block_bytes(held) + EMPTY_BLOCK)
        os.replace(path + ".part", path)
        yield pd.DataFrame({"path": [path], "records": [n]})

    return reads.select(*READS.fieldNames()).mapInPandas(write, "path string, records bigint")
