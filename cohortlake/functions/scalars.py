"""Scalar functions over columns: chromosome names, bins, CIGARs, overlap ratio, fixed-point depth, densities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_NAMES = ("DEL", "DUP", "INV", "CNV", "INS", "BND")
#: Levels of the bin index, finest first: (shift, first bin).
BIN_LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
MAX_COORDINATE = 1 << 29


def chrom_number(name: Column) -> Column:
    """1..22, X 23, Y 24, M or MT 25 with or without a chr prefix; 0 for anything else, suffixed names too."""
    bare = F.regexp_replace(name, "^[cC]hr", "")
    number = F.regexp_extract(bare, "^([0-9]{1,2})$", 1)
    return F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).when(number != "", number.cast("int")).otherwise(0)


def chrom_name(number: Column) -> Column:
    return F.concat(F.lit("chr"), F.when(number == 23, "X").when(number == 24, "Y").when(number == 25, "M").otherwise(number.cast("string")))


def type_name(code: Column) -> Column:
    """Unknown codes read as DEL."""
    out = F.lit("DEL")
    for i, name in enumerate(TYPE_NAMES):
        out = F.when(code == i, name).otherwise(out)
    return out


def type_code(name: Column) -> Column:
    """Unknown names read as BND."""
    out = F.lit(5)
    for i, known in enumerate(TYPE_NAMES):
        out = F.when(name == known, i).otherwise(out)
    return out


def gc_content(bases: Column) -> Column:
    """GC / ACGT over upper-case letters; -1 unless more than half (rounded down) of the characters are such."""
    gc = F.char_length(F.regexp_replace(bases, "[^GC]", ""))
    at = F.char_length(F.regexp_replace(bases, "[^AT]", ""))
    return F.when(gc + at > F.floor(F.char_length(bases) / 2), gc / (gc + at)).otherwise(F.lit(-1.0))


def tokens(text: Column, delimiters: str = " \t\n") -> Column:
    """Parts between any of the delimiters, without empty ones."""
    chars = "".join("\\" + c if c in "\\]^-[" else c for c in delimiters)
    return F.filter(F.split(text, f"[{chars}]"), lambda t: t != "")


def overlap_ratio(beg_a: Column, end_a: Column, beg_b: Column, end_b: Column) -> Column:
    """Shared over joint span of two intervals; 0 when they are apart."""
    shared = F.least(end_a, end_b) - F.greatest(beg_a, beg_b)
    return F.when(shared > 0, shared / (F.greatest(end_a, end_b) - F.least(beg_a, beg_b))).otherwise(F.lit(0.0))


def fixed_depth(x: Column) -> Column:
    """Depth in 1/32, at most 65535."""
    return F.least(F.lit(65535), F.round(x * 32)).cast("int")


def bin_of(beg: Column, end: Column) -> Column:
    """The smallest bin that holds [beg, end) whole."""
    last = end - 1
    out = F.lit(0)
    for shift, first in reversed(BIN_LEVELS):
        out = F.when(F.shiftright(beg, shift) == F.shiftright(last, shift), F.shiftright(beg, shift) + first).otherwise(out)
    return out


def bins_over(beg: Column, end: Column) -> Column:
    """All bins that can hold an interval overlapping [beg, end)."""
    last = F.least(end, F.lit(MAX_COORDINATE)) - 1
    parts = [F.array(F.lit(0))] + [F.sequence(F.shiftright(beg, s) + f, F.shiftright(last, s) + f) for s, f in reversed(BIN_LEVELS)]
    return F.concat(*parts)


def cigar_ops(cigar: Column) -> Column:
    return F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))


def cigar_length(cigar: Column, ops: str = "MDN=X") -> Column:
    """Reference bases that a CIGAR spans."""
    ours = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(ours, F.lit(0), lambda a, x: a + x.cast("int"))


def reference_gaps(cigar: Column) -> Column:
    """array<struct<at, n>>: deletions and skips of an alignment, as offsets from its start."""
    gap = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    none = F.filter(F.array(gap), lambda g: F.lit(False))

    def add(held: Column, op: Column) -> Column:
        n = F.regexp_extract(op, "^[0-9]+", 0).cast("int")
        more = F.concat(held["gaps"], F.array(F.struct(held["at"].alias("at"), n.alias("n"))))
        return F.struct((held["at"] + n).alias("at"), F.when(op.rlike("[DN]$"), more).otherwise(held["gaps"]).alias("gaps"))

    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+[MDN=X])"), F.lit(1))
    found = F.aggregate(ops, F.struct(F.lit(0).alias("at"), none.alias("gaps")), add)["gaps"]
    return F.when(cigar.rlike("[0-9][DN]"), found).otherwise(none)


def clip_lengths(cigar: Column) -> tuple[Column, Column]:
    """Soft-clipped bases at the left and at the right end."""
    take = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))
    return take("^([0-9]+)S"), take("([0-9]+)S$")


def supplementary(sa: Column) -> dict[str, Column]:
    """First entry of an SA tag: chromosome number (0 if unreadable), position, reverse strand, CIGAR."""
    part = lambda i: F.regexp_extract(sa, r"^(?:chr)?([0-9]{1,2}|X|Y),([0-9]+),([+-]),([^,;]*)", i)
    return {
        "chrnum": F.when(part(1) == "", 0).otherwise(chrom_number(part(1))),
        "pos": F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), F.lit(0)),
        "reverse": F.when(part(3) == "-", 1).otherwise(0),
        "cigar": part(4),
    }


def region(text: Column) -> Column:
    """struct<name, beg, end>: zero-based half-open reading of name, name:beg or name:beg-end; null if beg > end."""
    bare = F.regexp_replace(text, "[, ]", "")
    pattern = "^([^:]+)(?::([0-9]+))?(?:-([0-9]+))?$"
    beg = F.coalesce(F.nullif(F.regexp_extract(bare, pattern, 2), F.lit("")).cast("int"), F.lit(0))
    beg = F.when(beg > 0, beg - 1).otherwise(beg)
    end = F.coalesce(F.nullif(F.regexp_extract(bare, pattern, 3), F.lit("")).cast("int"), F.lit(MAX_COORDINATE))
    name = F.regexp_extract(bare, pattern, 1)
    return F.when((name != "") & (beg <= end), F.struct(name.alias("name"), beg.alias("beg"), end.alias("end")))


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    sd = F.greatest(sd, F.lit(0.0001))
    return F.nanvl(F.exp(-0.5 * F.pow((x - mean) / sd, 2)) / (sd * math.sqrt(2 * math.pi)), F.lit(0.0))


def normal_pdf_2d(x: Column, y: Column, mx: Column, my: Column, cxx: Column, cxy: Column, cyy: Column) -> Column:
    det = cxx * cyy - cxy * cxy
    dx, dy = x - mx, y - my
    square = (cyy * dx * dx - 2 * cxy * dx * dy + cxx * dy * dy) / det
    return F.exp(-0.5 * square) / (2 * math.pi * F.sqrt(det))


def genotype_text(gt: Column) -> Column:
    return F.when(gt == 0, "0/0").when(gt == 1, "0/1").when(gt == 2, "1/1").otherwise("./.")


def combined_copies(a: Column, b: Column) -> Column:
    """The copy number that is known (not -1), or the rounded mean of both."""
    return F.when(a < 0, b).when(b < 0, a).otherwise(F.round((a + b) / 2)).cast("int")
