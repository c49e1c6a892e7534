"""Sequence expressions: pure Columns, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def encode(text: Column) -> Column:
    """Any text as a DNA-like sequence: letters A-Z dealt to ACGT in turn, all else dropped."""
    cyclic = "".join("ACGT"[i % 4] for i in range(26))
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, cyclic)


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTN", "TGCAN"))


def oriented(s: Column, strand: Column) -> Column:
    return F.when(strand == "-", reverse_complement(s)).otherwise(s)


def kmers(s: Column, k: int) -> Column:
    """Array of all windows of length ``k``; empty where the sequence is shorter.

    A substring is found by walking from its text's start, so windows are taken
    from stretches of the sequence, and those from longer stretches.
    """
    def windows(text: Column, steps: tuple[int, ...]) -> Column:
        n = F.length(text) - k + 1
        if not steps:
            return F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(k)))
        pieces = F.transform(F.sequence(F.lit(1), n, F.lit(steps[0])), lambda i: F.substring(text, i, F.lit(steps[0] + k - 1)))
        return F.flatten(F.transform(pieces, lambda piece: windows(piece, steps[1:])))

    return F.when(F.length(s) >= k, windows(s, (4096, 64))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def junction(source: Column, target: Column, k: int) -> Column:
    """The (k+1)-mer across an edge: the source's last k letters and the target's k-th letter."""
    return F.concat(F.right(source, F.lit(k)), F.substring(target, k, 1))


def motif_count(s: Column, motif: Column) -> Column:
    """Occurrences that may overlap; an empty motif has none."""
    m = F.length(motif)
    places = F.sequence(F.lit(1), F.length(s) - m + 1)
    hits = F.size(F.filter(places, lambda i: F.substring(s, i, m) == motif))
    return F.when((m > 0) & (F.length(s) >= m), hits).otherwise(0).cast("long")


def either_strand_count(s: Column, motif: Column) -> Column:
    """Occurrences on both strands; a palindrome counts once."""
    other = reverse_complement(motif)
    return motif_count(s, motif) + F.when(other != motif, motif_count(s, other)).otherwise(0)


def covers(node: Column, read: Column) -> Column:
    """Whether one of the two holds the other, on either strand; an empty read covers nothing."""
    inside = node.contains(read) | node.contains(reverse_complement(read))
    around = read.contains(node) | reverse_complement(read).contains(node)
    return F.when(F.length(read) == 0, False).when(F.length(read) < F.length(node), inside).otherwise(around)


def overlaps(left: Column, right: Column, n: Column) -> Column:
    """Whether the last ``n`` letters of one are the first ``n`` of the other."""
    fit = (F.length(left) >= n) & (F.length(right) >= n) & (F.right(left, n) == F.left(right, n))
    return F.when(n < 0, False).when(n == 0, True).otherwise(fit)


def gc(s: Column) -> Column:
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.translate(s, "GC", ""))) / n).otherwise(0.0)


def entropy(s: Column) -> Column:
    """Shannon entropy in bits over the letters ACGTN."""
    n = F.length(s)

    def part(letter: str) -> Column:
        p = (n - F.length(F.replace(s, F.lit(letter), F.lit("")))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    total = part("A") + part("C") + part("G") + part("T") + part("N")
    return F.when(n > 0, total).otherwise(0.0)


def base4(index: Column, length: int) -> Column:
    """``index`` in base 4 with digits ACGT, padded to ``length``."""
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def first_tokens(name: Column, sep: str, n: int) -> Column:
    return F.substring_index(name, sep, n)


def wrapped(s: Column, width: int = 80) -> Column:
    return F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n")


def tidy(cell: Column) -> Column:
    return F.trim(F.regexp_replace(cell, r"\s+", " "))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere of radius 6 371 000 m."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371000.0 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def route_number(value: Column) -> Column:
    """Leading integer after the first colon; null where there is none."""
    digits = F.regexp_extract(value, r"^[^:]*:(\d+)", 1)
    return F.when(digits != "", digits.cast("long"))


def base4_tag(index: Column) -> Column:
    """``index`` + 1 in base 4, lowest digit first, with digits ACGT."""
    return F.reverse(F.translate(F.conv((index + 1).cast("string"), 10, 4), "0123", "ACGT"))


def accession(read_id: Column) -> Column:
    """The first two tokens of a read's name; a name without an underscore is an error."""
    return F.when(F.instr(read_id, "_") > 0, F.substring_index(read_id, "_", 2)).otherwise(F.raise_error(F.concat(F.lit("no accession in the read name "), read_id)))


def read_genome(read_id: Column) -> Column:
    """What stands before the first underscore of a read's name."""
    return F.substring_index(read_id, "_", 1)


def file_sample(name: Column) -> Column:
    """The sample of a read file named ``<sample>_full_R1...``, with ``sample_`` before it."""
    return F.concat(F.lit("sample_"), F.substring_index(name, "_full_R", 1))


def header_coverage(header: Column) -> Column:
    """The number behind ``multi=`` or ``_cov_`` in a contig's header; null where there is none."""
    return F.regexp_extract(header, r"(?:\bmulti=|_cov_)([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def contig_k(name: Column) -> Column:
    """k of a file called ``k<number>.contigs.fa``; null for other names, such as final contigs."""
    return F.regexp_extract(name, r"k(\d+)\.contigs\.fa$", 1).try_cast("long")


def even_share(values: Column) -> Column:
    """Percentage of ``values`` (an array) with an even route number; null for none, values without a number count as odd."""
    even = F.filter(values, lambda v: F.coalesce(route_number(v) % 2 == 0, F.lit(False)))
    return F.when(F.size(values) > 0, 100.0 * F.size(even) / F.size(values))


def float_cell(x: Column) -> Column:
    return F.format_string("%.10f", x.cast("double"))


def letters_digest(s: Column) -> Column:
    """SHA-256 of the letters of a sequence, upper-cased."""
    return F.sha2(F.upper(F.regexp_replace(s, "[^A-Za-z]", "")), 256)


def place_key(name: Column) -> Column:
    """A place name without differences of case and blanks; letters whose folded form is longer (sharp s) are unfolded."""
    return F.lower(F.upper(tidy(name)))
