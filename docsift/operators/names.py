"""The file-name search language, compiled to one Column.

``kw`` contains, ``A*B`` both in any order, other stars in sequence, ``A%B`` A but
not B, ``@words`` fuzzy with synonyms.  Matching ignores case.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _quoted(text: str) -> str:
    """Java's literal quoting; \\E cannot end it early."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E" if text else ""


def _regex(body: str, c: Column) -> Column:
    return c.rlike("(?iu)" + body)


def _either_order(a: str, b: str) -> str:
    return f"({_quoted(a)}.*{_quoted(b)}|{_quoted(b)}.*{_quoted(a)})"


def _in_sequence(pattern: str) -> str:
    return ".*".join(_quoted(p) for p in pattern.split("*"))


def _parts(pattern: str) -> list[str]:
    return [p.strip() for p in pattern.split("*") if p.strip()]


def _star(pattern: str, c: Column, one_star_only: bool) -> Column:
    if "*" not in pattern:
        return F.lower(c).contains(pattern.lower())
    parts = _parts(pattern)
    unordered = len(parts) == 2 and (pattern.count("*") == 1 or not one_star_only)
    return _regex(_either_order(*parts) if unordered else _in_sequence(pattern), c)


def compile_query(query: str, c: Column) -> Column:
    """A boolean column for a query without ``@``.  On either side of ``%``, only a single star is unordered."""
    query = query.strip()
    if "%" in query:
        include, exclude = (x.strip() for x in query.split("%", 1))
        if include and exclude:
            return _star(include, c, True) & ~_star(exclude, c, True)
    return _star(query, c, False)


def expand_terms(query: str, synonyms: dict[str, list[str]], ci_keys: bool = False) -> list[str]:
    """Distinct words of a fuzzy query and the synonyms of each, sorted."""
    table = {k.lower(): v for k, v in synonyms.items()} if ci_keys else synonyms
    words = query.lstrip("@").split()
    return sorted({*words, *(s for w in words for s in table.get(w.lower(), []))})


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = 0
    for ch in b:
        x = row | where.get(ch, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def partial_ratio(one: str, other: str) -> float:
    """0 to 100: how well the shorter text fits the best window of the longer one."""
    if not one and not other:
        return 100.0
    if not one or not other:
        return 0.0
    short, long = sorted((one, other), key=len)
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    pairs = [(short, long)] + ([(long, short)] if len(short) == len(long) else [])
    for s, t in pairs:
        for start in range(1 - n, len(t)):
            window = t[max(0, start) : start + n]
            best = max(best, 200.0 * _common(s, window) / (n + len(window)))
    return best


def letters_allow(name: Column, term: str, threshold: float) -> Column:
    """Whether a name shares enough letters with a term to fit it at ``threshold``; both are in lower case.

    The common subsequence l of a text of s letters and a window of m is no longer than either, and 200 * l / (s + m)
    reaches the threshold t, so l >= t * s / (200 - t); s is the shorter text, and l letters are in both.
    """
    shared = F.lit(0)
    for letter in sorted(set(term)):
        shared = shared + F.least(F.lit(term.count(letter)), F.length(name) - F.length(F.replace(name, F.lit(letter), F.lit(""))))
    return shared * (200 - threshold) >= threshold * F.least(F.length(name), F.lit(len(term))) - 1e-6


def fuzzy(query: str, c: Column, synonyms: dict[str, list[str]] | None = None, threshold: float = 70.0, mode: str = "all", ci_keys: bool = False) -> Column:
    """Every term (``mode="any"``: one of them) fits the name at ``threshold`` or better.

    Names that plain containment settles, or that share too few letters with a term, need no
    Python; of the others, each batch scores a distinct name once, for all terms in one call.
    """
    terms = [t.lower() for t in expand_terms(query, synonyms or {}, ci_keys)]
    if not terms:
        return F.lit(True)
    settle = all if mode == "all" else any
    name = F.lower(c)
    inside = [name.contains(t) for t in terms]
    whole = inside[0]
    for x in inside[1:]:
        whole = (whole & x) if mode == "all" else (whole | x)

    @F.pandas_udf("boolean")
    def far(names: pd.Series) -> pd.Series:
        found = {n: settle(partial_ratio(n, t) >= threshold for t in terms) for n in names.dropna().unique()}
        return names.map(lambda n: found.get(n, False))

    near = [letters_allow(name, t, threshold) for t in terms]
    can = near[0]
    for x in near[1:]:
        can = (can & x) if mode == "all" else (can | x)
    return F.coalesce(F.when(whole, True).otherwise(far(F.when(~whole & can, name))), F.lit(False))


class EditSynonyms(ValueError):
    """The query asks for the synonym table instead of a search."""


def route(query: str, c: Column, synonyms: dict[str, list[str]] | None = None, threshold: float = 70.0) -> Column:
    """The condition of any query: ``@`` leads to the fuzzy search, where ``%`` and ``*`` are plain; others are compiled.

    An empty query is refused; ``$synonym`` raises EditSynonyms.
    """
    query = query.strip()
    if not query:
        raise ValueError("an empty query")
    if query.lower() == "$synonym":
        raise EditSynonyms(query)
    return fuzzy(query, c, synonyms, threshold) if query.startswith("@") else compile_query(query, c)


def parse_synonyms(text: str) -> dict[str, list[str]]:
    """Lines ``key == v1, v2``; others are ignored."""
    out = {}
    for line in re.split(r"\r?\n", text):
        if "==" in line:
            key, values = line.split("==", 1)
            out[key.strip()] = [v.strip() for v in values.split(",")]
    return out


def synonym_table(lines: DataFrame, line: str) -> DataFrame:
    """key, synonyms from lines ``key == v1, v2``; lines without ``==`` are ignored, empty values kept."""
    cut = F.split(F.col(line), "==", 2)
    values = F.transform(F.split(F.get(cut, 1), ","), lambda v: F.btrim(v))
    return lines.where(F.col(line).contains("==")).select(F.btrim(F.get(cut, 0)).alias("key"), values.alias("synonyms"))


def load_synonyms(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The driver's table of synonyms from a JSON object; none where the file is missing."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    except AnalysisException:
        return {}
    return json.loads(text) if text.strip() else {}


def save_synonyms(spark: SparkSession, synonyms: dict[str, list[str]], path: str) -> None:
    spark.createDataFrame([(json.dumps(synonyms, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
