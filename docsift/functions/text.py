"""Text functions as columns: all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods know it.
BLANK = r"[\s\x1c-\x1f]"
#: What counts as a token, and as a numbered heading.
TOKEN = r"[a-z0-9_./-]+"
NUMBERED = r"^\s*(\d+(\.\d+)*)\s*[.)-]?\s+(.+)$"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"(?U)^{BLANK}+", ""), f"(?U){BLANK}+$", "")


def normalize_text(c: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line in a row, no blanks around."""
    unix = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n|\r", "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, "[ \t]+", " "), "\n{3,}", "\n\n"))


def fold_for_hash(c: Column) -> Column:
    """Lower case with single spaces, so that layout does not count."""
    return F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), f"(?U){BLANK}+", " "))


def text_sha1(c: Column) -> Column:
    return F.sha1(fold_for_hash(c).cast("binary"))


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and ``_ . / -``."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def is_heading(line: Column) -> Column:
    """A numbered line, or one of 6 to 120 characters in capitals; ``line`` is stripped."""
    numbered = line.rlike(f"(?U){NUMBERED}")
    capitals = line.rlike(r"\p{Lu}") & ~line.rlike(r"[\p{Ll}\p{Lt}]") & F.length(line).between(6, 120)
    return numbered | capitals


def natural_key(c: Column, width: int = 20) -> Column:
    """Lower-cased, with digit runs zero-padded, so that file2 sorts before file10."""
    return F.array_join(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)"), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty for names without one, dot files among them."""
    return F.lower(F.regexp_extract(file_name(path), r"^.*[^.].*?(\.[^.]*)$|^[^.]+(\.[^.]*)$", 1))


def file_type(path: Column) -> Column:
    """The extension in capitals without its dot, or FILE."""
    ext = extension(path)
    return F.when(ext == "", F.lit("FILE")).otherwise(F.upper(F.substring(ext, 2, 1 << 30)))


def size_mb(size: Column) -> Column:
    """Megabytes with two decimals, ties to even, as text."""
    return F.bround(size.cast("decimal(30,0)") / F.lit(1048576).cast("decimal(10,0)"), 2).cast("decimal(30,2)").cast("string")


def cited(answer: Column, most: Column) -> Column:
    """0-based places cited as [n] with n from 1 to ``most``, each once, in first-seen order."""
    digits = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))
    numbers = F.filter(F.transform(digits, lambda d: d.try_cast("bigint")), lambda n: n.isNotNull() & (n >= 1) & (n <= most))
    return F.array_distinct(F.transform(numbers, lambda n: n - 1))
