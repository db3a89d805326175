"""Personal data in texts, with offsets, plain and in disguise.

Base patterns find e-mail addresses, IP addresses, card and phone numbers as they
stand.  Then transducers rewrite the text - look-alike letters and digits,
spelled digits, "at" and "dot" in brackets or words - each output character
keeping the span of source characters it came from.  Identifiers found in the
rewritten text are mapped back.  Base spans stay as they are; what such an
identifier covers outside of the base spans of its kind is added beside them.

Offsets are code points, ends exclusive.  Defined results: a null or empty text
has no spans and the digest of the empty string; repeated rows give repeated
results; very long texts are scanned whole, in time proportional to their length;
columns other than doc_id and text play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before would only lead to the same end, so runs of digits are tried once
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, end = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, end))
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind that pass their test; a failing match is dropped."""
    out: dict[str, list[Span]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


class Mapped:
    """A text whose every character knows the source span it stands for."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = starts if starts is not None else list(range(len(text)))
        self.ends = ends if ends is not None else list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, to) -> "Mapped":
        """Replace matches; the characters that replace one each stand for all of it."""
        return self.replace([(*m.span(), new) for m in pattern.finditer(self.text) if (new := to(m)) is not None and m.end() > m.start()])

    def replace(self, edits: list[tuple[int, int, str]]) -> "Mapped":
        """The same for ascending places and their new texts."""
        out, starts, ends, at = [], [], [], 0
        for start, end, new in edits:
            out += [self.text[at:start], new]
            starts += self.starts[at:start] + [self.starts[start]] * len(new)
            ends += self.ends[at:start] + [self.ends[end - 1]] * len(new)
            at = end
        if not at:
            return self
        return Mapped("".join([*out, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


#: Letters of other scripts that look like Latin ones.
_ALIKE = dict(zip("авеѕіјкмнорсԁтухһԛԝАВЕЅІЈКМНОРСТУХαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abesijkmhopcdtyxhqwABESIJKMHOPCTYXaBeiKvoptuxABEZHIKMNOPTYX"))
_ALIKE |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
_ALIKE |= {chr(base + i): str(i) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
_ALIKE |= dict.fromkeys("‐‑‒–−", "-") | dict.fromkeys("․。", ".") | {" ": " "}
_ALIKE |= dict.fromkeys("​‌‍⁠­", "")  # nothing to see
_FOLD = re.compile("[" + re.escape("".join(_ALIKE)) + "]")

_WORD_DIGITS = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789")) | {"plus": "+"}
_DIGIT_WORD = "|".join(sorted(_WORD_DIGITS.keys() - {"plus"}, key=len, reverse=True))
#: Digits in words or figures, and "plus".
_ITEM = re.compile(rf"(?<![A-Za-z0-9])(?:(plus)|{_DIGIT_WORD}|[0-9]+)(?![A-Za-z0-9])", re.I)
_BETWEEN = re.compile(r"[\x20,.-]{1,2}")
#: So many spelled digits at least, or some beside figures, so that prose about numbers stays as it is.
LEAST_ITEMS = 7
_TOKEN = re.compile(rf"(?<![A-Za-z])(plus|{_DIGIT_WORD})(?![A-Za-z])[\x20,.-]{{0,2}}(?=(?:{_DIGIT_WORD}|[0-9])(?![A-Za-z]))|(?<![A-Za-z])({_DIGIT_WORD})(?![A-Za-z])", re.I)

_PLAIN_DIGITS = re.compile(rf"(?:{_DIGIT_WORD})[\x20,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])", re.I)

_AT = r"\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?"
_DOT = r"\x20?[\[({<]\x20?(?:dot|punkt|punto|point|\.)\x20?[\])}>]\x20?"
_MARKED = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_AT_WORD = re.compile(r"\x20at\x20", re.I)
_DOT_WORD = re.compile(r"\x20(?:dot|punkt|punto)\x20", re.I)
#: A host with spoken or literal dots, up to an ending of letters.
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20(?:dot|punkt|punto)\x20|\.)[A-Za-z0-9-]+)*(?:\x20(?:dot|punkt|punto)\x20|\.)([A-Za-z]{2,})(?![A-Za-z0-9-])", re.I)
#: "name @ host . ending", with blanks on both sides of the at sign and on both or neither of each dot.
_SPACED = re.compile(r"(?<=[A-Za-z0-9._%+-])\x20@\x20(?P<host>[A-Za-z0-9-]+(?:(?:\x20\.\x20|\.)[A-Za-z0-9-]+)*(?:\x20\.\x20|\.)[A-Za-z]{2,})(?![A-Za-z0-9-])")
#: Words that name no mailbox before "at": pronouns, small words, and what is done at a place.  Fixed values.
_PLACED = frozenset("a about access and are as available be been buy find found free here hosted is it learn located look me meet more not now on online or out posted published read see seen sold start that them there this today us up visited was website were you".split())
_LAST_DOT = re.compile(r"@[A-Za-z0-9.-]+(?:\x20dot\x20[A-Za-z0-9.-]+)*\x20dot\x20[A-Za-z]{2,}(?![A-Za-z0-9])", re.I)
_SPOKEN_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:(?:\x20dot\x20|\.)[0-9]{1,3}){3}(?![A-Za-z0-9])", re.I)
#: An address of four numbers whose digits may be spelled.
_NUMBER = rf"(?:{_DIGIT_WORD}|[0-9])(?:[\x20-]?(?:{_DIGIT_WORD}|[0-9])){{0,2}}"
_SPELLED_IP = re.compile(rf"(?<![A-Za-z0-9.]){_NUMBER}(?:\x20(?:dot|punkt|punto)\x20{_NUMBER}){{3}}(?![A-Za-z0-9])", re.I)
_SPELLED_DIGIT = re.compile(rf"[\x20-]?({_DIGIT_WORD}|[0-9])", re.I)
_TRIGGER = re.compile(r"\x20@\x20|\x20(?:punkt|punto)\x20|[\[({<]\x20?(?:at|@|dot|punkt|punto|point|\.)\x20?[\])}>]|\x20dot\x20|\x20at\x20[A-Za-z0-9-]+\.[A-Za-z0-9]", re.I)


def _spoken(text: str) -> list[tuple[int, int, str]]:
    """Places of "at" and "dot" in "name at host dot ending", "name at host.ending", "name@host dot ending" and IP addresses."""
    edits, whole = {}, []
    end = 0
    for m in _AT_WORD.finditer(text):
        host = _HOST.match(text, m.end())
        start = m.start()
        while host and start > end:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start == m.start() or not (start - 6 >= end and _DOT_WORD.fullmatch(text, start - 5, start) and text[start - 6] in _LOCAL):
                break
            start -= 5
        if not host or start == m.start():
            continue
        local = text[start : m.start()]
        literal = not _DOT_WORD.search(host[0]) and local.isalpha()
        if local.lower() in _PLACED or literal and not (host[1].islower() or host[1].isupper()):
            continue
        end = host.end()
        edits[m.start()] = (*m.span(), "@")
        whole.append((start, end))
    whole += [m.span() for m in _LAST_DOT.finditer(text)] + [m.span() for m in _SPOKEN_IP.finditer(text)]
    for start, stop in whole:
        edits |= {x.start(): (*x.span(), ".") for x in _DOT_WORD.finditer(text, start, stop)}
    out, at = [], 0
    for start, stop, new in sorted(edits.values()):
        if start >= at:
            out.append((start, stop, new))
            at = stop
    return out


def _spaced(text: str) -> list[tuple[int, int, str]]:
    """Places of " @ " and " . " in addresses written with blanks."""
    out = []
    for m in _SPACED.finditer(text):
        out.append((m.start(), m.start("host"), "@"))
        out += [(x.start(), x.end(), ".") for x in re.compile(r"\x20\.\x20").finditer(text, *m.span("host"))]
    return out


def _spelled_ips(text: str) -> list[tuple[int, int, str]]:
    """Digits and dots of addresses of four numbers, some of whose digits are spelled."""
    out = []
    for m in _SPELLED_IP.finditer(text):
        at = m.start()
        while at < m.end():
            dot = _DOT_WORD.match(text, at, m.end())
            x = dot or _SPELLED_DIGIT.match(text, at, m.end())
            out.append((*x.span(), "." if dot else _WORD_DIGITS.get(x[1].lower(), x[1])))
            at = x.end()
    return out


def _spelled(text: str) -> list[Span]:
    """Runs of LEAST_ITEMS items or more with one or two separators between, in one pass; a run ends with a digit."""
    out, start, end, last, n, digits = [], 0, 0, 0, 0, 0
    for m in _ITEM.finditer(text):
        if not n or not _BETWEEN.fullmatch(text, end, m.start()):
            if digits >= LEAST_ITEMS:
                out.append((start, last))
            start, n, digits = m.start(), 0, 0
        n, end = n + 1, m.end()
        if not m[1]:
            last, digits = end, n  # items up to the last digit
    if digits >= LEAST_ITEMS:
        out.append((start, last))
    return out


class _Inside:
    """Whether a place lies in one of some ascending spans."""

    def __init__(self, spans: list[Span]):
        self.starts, self.spans = [s for s, _ in spans], spans

    def __call__(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start) - 1
        return i >= 0 and end <= self.spans[i][1]


def normalised(text: str) -> Mapped | None:
    """The text after all transducers; None if none of them has work."""
    m = Mapped(text)
    if not text.isascii() and _FOLD.search(text):
        m = m.rewrite(_FOLD, lambda x: _ALIKE[x[0]])
    if _TRIGGER.search(m.text):
        m = m.rewrite(_MARKED, lambda x: "@" if x["at"] else ".")
        m = m.replace(_spaced(m.text)).replace(_spelled_ips(m.text))
        m = m.replace(_spoken(m.text))
    if _PLAIN_DIGITS.search(m.text):
        inside = _Inside(_spelled(m.text))
        m = m.rewrite(_TOKEN, lambda x: _WORD_DIGITS[(x[1] or x[2]).lower()] if inside(x.start(), x.end()) else None)
    return None if m.text == text else m


def _disguised(text: str) -> dict[str, list[Span]]:
    """Spans in the text of what is found in the rewritten text; no kinds if nothing was rewritten."""
    hidden = normalised(text)
    return {} if hidden is None else {kind: [hidden.source(s) for s in spans] for kind, spans in base_spans(hidden.text).items()}


def _outside(found: list[Span], base: list[Span]) -> list[Span]:
    """The parts of ``found`` that no base span covers; both lists ascend."""
    out, i = [], 0
    for s, e in found:
        while i < len(base) and base[i][1] <= s:
            i += 1
        k = i
        while k < len(base) and base[k][0] < e:
            if s < base[k][0]:
                out.append((s, base[k][0]))
            s = max(s, base[k][1])
            k += 1
        if s < e:
            out.append((s, e))
    return out


def _ordered(spans: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    return sorted(((k, s, e) for k in KINDS for s, e in spans.get(k, ())), key=lambda y: (y[1], KINDS.index(y[0])))


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, as (kind, start, end) by start and then kind."""
    text = text or ""
    base, more = base_spans(text), _disguised(text)
    return _ordered(base), _ordered({k: base[k] + _outside(more.get(k, []), base[k]) for k in KINDS})


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; counts are of base spans."""
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find(t) for t in b["text"]]
            out = {"doc_id": b["doc_id"].astype("Int64")}
            out |= {f"n_{k}": [sum(x[0] == k for x in base) for base, _ in found] for k in KINDS}
            yield pd.DataFrame(out | {"base_sha256": [hashlib.sha256(join(base).encode()).hexdigest() for base, _ in found], "spans": [join(every) for _, every in found]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every identifier replaced by its kind in angle brackets."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            base, more, out, at = base_spans(text), _disguised(text), [], 0
            for kind, start, end in _ordered({k: base[k] + more.get(k, []) for k in KINDS}):
                if start >= at:
                    out += [text[at:start], f"<{kind.upper()}>"]
                at = max(at, end)  # what overlaps goes with the first
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one, na_action="ignore")

    return docs.withColumn(column, mask(F.col(column).cast("string")))
