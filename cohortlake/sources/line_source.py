"""A data source of position-sorted text (SAM or VCF): ``spark.read.format("genomic_lines")``.

Columns chrnum, pos, flag (null for VCF) and line; ``sam.parse`` and ``vcf.parse`` take it from there.
Files are cut into byte ranges. Comparisons of the first three columns are pushed down:
lines are dropped before they reach Spark, and in files that say they are sorted (or with
the option ``sorted``) splits outside the wanted stretch aren't read at all. Where it begins and ends
is found by bisection, from the first whole line of a few splits.

Options: path (a file, a folder or a glob; anything that Arrow's file systems reach), kind (sam, vcf), split
(bytes), sorted (auto, true, false).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Where a line has its chromosome, position and flag; what header lines begin with.
KINDS = {"sam": (2, 3, 1, b"@"), "vcf": (0, 1, None, b"#")}
SCHEMA = "chrnum int, pos int, flag int, line string"
#: Bytes that are read to find a split's first line, and at once while reading.
PEEK, CHUNK = 1 << 16, 8 << 20
_COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def chromosome(name: str) -> int:
    """As ``chrom_number`` reads a name."""
    bare = re.sub("^[cC]hr", "", name)
    return {"X": 23, "Y": 24, "M": 25, "MT": 25}.get(bare) or (int(bare) if re.fullmatch("[0-9]{1,2}", bare) else 0)


@dataclass
class Split(InputPartition):
    file: str
    begin: int
    end: int


def _files(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    base, _, pattern = path.partition("*")
    folder = base.rsplit("/", 1)[0] if pattern or "*" in path else path
    system, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return system, [(at, info.size)]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    found = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    if "*" in path:
        name = re.compile(".*".join(map(re.escape, path.rsplit("/", 1)[1].split("*"))))
        found = [f for f in found if name.fullmatch(f[0].rsplit("/", 1)[1])]
    return system, sorted(found)


def _fields(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> pa.Array:
    """The ``which``-th field between tabs (or blanks) of each line."""
    cuts = np.flatnonzero((data == 9) | (data == 32))
    at = np.searchsorted(cuts, starts)
    bounds = np.concatenate([cuts, np.full(which + 2, len(data))])
    lo = starts if which == 0 else np.minimum(bounds[at + which - 1] + 1, ends)
    hi = np.minimum(bounds[at + which], ends)
    size = np.maximum(hi - lo, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(lo - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[take].tobytes()))


def _numbers(texts: pa.Array) -> pa.Array:
    good = pc.match_substring_regex(texts, "^-?[0-9]{1,9}$")
    return pc.cast(pc.if_else(good, texts, pa.scalar(None, pa.string())), pa.int32())


def _chromosomes(names: pa.Array) -> pa.Array:
    coded = names.dictionary_encode()
    numbers = pa.array([chromosome(n) for n in coded.dictionary.to_pylist()], pa.int32())
    return numbers.take(coded.indices)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "sam")
        self.split, self.sorted = int(options.get("split", 128 << 20)), options.get("sorted", "auto")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in ("chrnum", "pos", "flag"):
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif type(f) in _COMPARED and f.value is not None:
                self.tests.append((name, _COMPARED[type(f)], f.value))
            else:
                yield f

    def _stretch(self) -> tuple[tuple[int, int], tuple[int, int]] | None:
        """The first and the last (chromosome, position) that can be wanted, if the filters name one chromosome."""
        one = [v for n, op, v in self.tests if n == "chrnum" and op == "=="]
        if not one:
            return None
        lo, hi = -1, 1 << 62
        for n, op, v in self.tests:
            if n == "pos":
                lo = max(lo, {"==": v, ">=": v, ">": v + 1}.get(op, lo)) if op in ("==", ">=", ">") else lo
                hi = min(hi, {"==": v, "<=": v, "<": v - 1}.get(op, hi)) if op in ("==", "<=", "<") else hi
        return (one[0], lo), (one[0], hi)

    def _is_sorted(self, system: fs.FileSystem, file: str) -> bool:
        if self.sorted in ("true", "false"):
            return self.sorted == "true"
        with system.open_input_file(file) as f:
            head = f.read(PEEK).split(b"\n")
        mark = KINDS[self.kind][3]
        lines = [x.decode(errors="replace") for x in head if x.startswith(mark)]
        if self.kind == "sam" and not any(x.startswith("@HD") and "SO:coordinate" in x for x in lines):
            return False
        names = re.findall(r"@SQ\t(?:.*\t)?SN:([^\t]+)|##contig=<ID=([^,>]+)", "\n".join(lines))
        order = [c for a, b in names if (c := chromosome(a or b))]
        return bool(order) and order == sorted(order)

    def _coordinate(self, system: fs.FileSystem, file: str, begin: int, size: int) -> tuple[int, int]:
        """(chromosome, position) of the first line that begins at or behind a byte; greater than all at the end of the file."""
        at_chrom, at_pos, _, mark = KINDS[self.kind]
        with system.open_input_file(file) as f:
            tail, at = b"", begin
            first = begin > 0  # what stands before the first line end belongs to the split before
            while at < size:
                f.seek(at)
                block = f.read(PEEK)
                at += len(block)
                *lines, tail = (tail + block).split(b"\n")
                for x in lines[first:] if lines else []:
                    if x and not x.startswith(mark):
                        fields = re.split(rb"[\t ]", x, maxsplit=max(at_chrom, at_pos) + 1)
                        if len(fields) > at_pos and fields[at_pos].isdigit():
                            return chromosome(fields[at_chrom].decode(errors="replace")), int(fields[at_pos])
                first = first and not lines
                if not block:
                    break
        return (1 << 30, 0)

    def partitions(self) -> list[Split]:
        system, files = _files(self.path)
        want, out = self._stretch(), []
        for file, size in files:
            n = max(1, -(-size // self.split))
            lo, hi = 0, n
            if want and n > 1 and self._is_sorted(system, file):
                begins = lambda i: self._coordinate(system, file, i * self.split, size)  # noqa: B023, E731
                # the last split that begins before the stretch may reach into it
                a, b = 0, n
                while a < b:
                    m = (a + b) // 2
                    a, b = (m + 1, b) if begins(m) < want[0] else (a, m)
                lo = max(0, a - 1)
                a, b = lo, n
                while a < b:
                    m = (a + b) // 2
                    a, b = (m + 1, b) if begins(m) <= want[1] else (a, m)
                hi = max(a, lo + 1)
            out += [Split(file, i * self.split, min(size, (i + 1) * self.split)) for i in range(lo, hi)]
        return out

    def _batch(self, text: bytes) -> pa.RecordBatch | None:
        at_chrom, at_pos, at_flag, mark = KINDS[self.kind]
        data = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        keep = (ends > starts) & (data[np.minimum(starts, len(data) - 1)] != mark[0])
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return None
        flag = pa.nulls(len(starts), pa.int32()) if at_flag is None else _numbers(_fields(data, starts, ends, at_flag))
        columns = {"chrnum": _chromosomes(_fields(data, starts, ends, at_chrom)), "pos": _numbers(_fields(data, starts, ends, at_pos)), "flag": flag}
        ok = np.ones(len(starts), bool)
        for name, op, v in self.tests:
            c = columns[name]
            compare = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
            hit = pc.is_valid(c) if op == "there" else pc.is_in(c, pa.array(v, pa.int32())) if op == "in" else compare[op](c, v)
            ok &= pc.fill_null(hit, False).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(ok)
        if not len(at):
            return None
        carriage = data[np.maximum(ends[at] - 1, 0)] == 13
        size = ends[at] - starts[at] - carriage
        offsets = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(starts[at] - offsets[:-1], size) + np.arange(offsets[-1])
        line = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[take].tobytes()))
        return pa.record_batch({**{k: v.take(pa.array(at)) for k, v in columns.items()}, "line": line})

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        """The lines that begin inside the split; the last of them may end beyond it."""
        system, _ = _files(split.file) if "://" not in self.path else (fs.FileSystem.from_uri(self.path.partition("*")[0])[0], None)
        with system.open_input_file(split.file) as f:
            size, at, tail = f.size(), split.begin, b""
            if at:
                # a line that begins right at the split's first byte is ours
                f.seek(at - 1)
                at -= 1
                while at < size:
                    block = f.read(min(PEEK, size - at))
                    cut = block.find(b"\n")
                    at += cut + 1 if cut >= 0 else len(block)
                    if cut >= 0:
                        break
                f.seek(at)
            while at < split.end:
                block = f.read(min(CHUNK, split.end - at))
                if not block:
                    break
                at += len(block)
                text = tail + block
                cut = text.rfind(b"\n") + 1
                tail = text[cut:]
                if cut and (batch := self._batch(text[:cut])) is not None:
                    yield batch
            while tail and at < size:  # the rest of the last line
                block = f.read(min(PEEK, size - at))
                at += len(block)
                cut = block.find(b"\n")
                tail += block if cut < 0 else block[: cut + 1]
                if cut >= 0 or not block:
                    break
            if tail and (batch := self._batch(tail if tail.endswith(b"\n") else tail + b"\n")) is not None:
                yield batch


class GenomicLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "genomic_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters down."""
    spark.dataSource.register(GenomicLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
