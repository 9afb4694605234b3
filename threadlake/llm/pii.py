"""Personal data, also where it is disguised; spans always refer to the source text.

Plain identifiers are found by fixed patterns. For disguised ones, transducers rewrite the text and
keep offsets: (1) homoglyphs and zero-width characters, (2) digits spelled as words, (3) disguises of at and dot. Stage 2
has two readings, and the spans of both count: every digit word that adjoins a digit, another digit word or a disguised dot, with
the dots between them kept, and runs of three or more words without what stands between them. Each stage knows for every piece of its output where it came from, so
a span found in the final text is carried back stage by stage to source characters. Such a span is
added unless a plain span of its kind covers it; plain spans always stay.

A bare ``at`` becomes @ only with a domain behind it, whose dots may be spelled, bracketed or written, and with a
local part before it, whose dots may be, too. In brackets it always does. What decides is ``likely``: a bracketed dot, two
dots that are not all written, a digit or dot in the local part or a word about mail nearby are enough (``look at the dot on``
is prose); else a domain's last label with spelled dots; with written dots alone (``more at example.com``) the
address has to stand alone. A plain match that fails its check (digits, Luhn, 255) is dropped, not retried.
Digits, at, dot and plus are known in English, German, French and Spanish.
Null and empty texts have no spans. Repeated rows get equal results, an empty table an empty result;
only the named columns are read. Whole texts are read, in slices bounded in bytes; the time for a very long text grows with
its length, not the square of it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spells, tidy

KINDS = ("email", "ip", "card", "phone")
ROWS, SIZE = 512, 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# what begins inside a run of digits also begins at its start, so only starts of runs are tried, and a run is never given back
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches. The part before an @ has no @, so each match is found from its @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
        for m in _CARD.finditer(text):
            d = re.sub(r"[^0-9]", "", m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


#: Letters of other scripts that look like these Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_INVISIBLE = re.compile("[­​-‍⁠﻿]+")
#: The words for the digits, in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: The words for at and dot, and for the plus of a phone number.
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "arobase"), ("dot", "punkt", "point", "punto"), ("plus", "más")
_ATS, _DOTS = "(?:" + "|".join(AT_WORDS) + ")", "(?:" + "|".join(DOT_WORDS) + ")"
_WORD = "(?:" + "|".join(DIGITS) + ")"
_RUN = re.compile(rf"(?<![^\W\d_])(?:(?:{'|'.join(PLUS_WORDS)})[\s-]++(?={_WORD}|[0-9]))?{_WORD}(?:[\s,.-]++{_WORD}){{2,}}(?![^\W\d_])", re.I)
_FEW = re.compile(rf"{_WORD}[\s,.-]++{_WORD}[\s,.-]++{_WORD}")
_DIGIT_WORD = re.compile(rf"(?<![^\W\d_]){_WORD}(?![^\W\d_])", re.I)
_OPEN, _SHUT = r"[\[({<]\s*", r"\s*[\])}>]"
# both begin at the bracket, and the white space before it is taken in afterwards: from every space of a long run on would take quadratic time
_AT = re.compile(rf"{_OPEN}(?:@|ät|{_ATS}){_SHUT}\s*", re.I)
_DOT = re.compile(rf"{_OPEN}(?:\.|{_DOTS}){_SHUT}\s*", re.I)
_DISGUISED = rf"(?:\s*{_DOT.pattern}|\s+{_DOTS}\s+)"
_BEHIND = re.compile(rf"[\s,.-]*[0-9]|[\s,.-]+{_WORD}(?![a-z])|{_DISGUISED}(?:[0-9]|{_WORD}(?![a-z]))|\)[\s.-]*(?:[0-9]|{_WORD}(?![a-z]))", re.I)
_BEFORE = re.compile(rf"(?:[0-9][\s,.-]*|[0-9]\)[\s.-]*|(?<![a-z]){_WORD}\)?[\s,.-]+|(?:[0-9]|(?<![a-z]){_WORD}){_DISGUISED}|\+[\s(.-]*)$", re.I)
_ENDS = (*{w[-3:] for w in (*DIGITS, *DOT_WORDS)}, *"0123456789)]}>+")
#: One more letter than the longest word that counts.
LONGEST = 1 + max(map(len, (*DIGITS, *DOT_WORDS)))
_WHITE_DIGIT = re.compile(r"(?:\s\s++|[\t\r\n])(?=[0-9])")
_PLUS = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(PLUS_WORDS)})[\s-]++(?=[\s(]*+(?:[0-9]|{_WORD}(?![a-z])))", re.I)
_DOT_DIGITS = re.compile(rf"(?<=[0-9])\s+{_DOTS}\s+(?=[0-9])", re.I)
_SPELLED = re.compile(rf"\s+{_DOTS}\s+", re.I)
_HEAD = re.compile(rf"@|(?<!\S){_ATS}(?=\s)", re.I)
_HOST = re.compile(rf"\s*+((?!(?:{_DOTS}|{_ATS})\s)[A-Za-z0-9-]++(?:(?:\s+{_DOTS}\s+|\.)(?!{_DOTS}\b|{_ATS}\s+[A-Za-z0-9-]++(?:\s+{_DOTS}\s|\.[A-Za-z0-9]))[A-Za-z0-9-]++)++)", re.I)
#: What is written behind the last label with a letter.
_TAIL = re.compile(r"(?:\.[0-9-]+)+$")
_CUE = re.compile(r"\b(?:e-?mails?|e-?mailed|mails?|mailto|contact|kontakt|contatto|contacto|correo|courriel|posta|write|reach|inbox|schreib\w*|address|adresse)\b", re.I)
#: How near a word must be that speaks of mail for bare words to count as an address: a matter of meaning, not of white space.
NEAR = 40
#: Last labels of a domain that are enough after bare words; two-letter ones are, too, unless they are English words.
LABELS = frozenset("com org net edu gov int mil info biz name pro app dev xyz online site shop tech cloud blog museum".split())
WORDS2 = frozenset("ad am an as at be by do go he hi if in is it me my no of oh ok on or so to up us we".split())
#: Words before ``at`` and before ``dot`` that make prose of it where nothing else speaks for an address.
BEFORE_AT = frozenset("i me you he him she her it us we they them is are was were be been being am look looks looked looking stare staring point points pointed pointing aim aimed glance glanced here there now online live more find found available visit see read shop buy order watch work works worked working stay met meet and or up down out not only".split())
BEFORE_DOT = frozenset("a an the this that these those each every any some no one my your his her its our their red blue green black white yellow polka big small little tiny".split())


@lru_cache(1)
def homoglyphs() -> dict[int, str]:
    """One character for one: every decimal digit, every character whose compatibility form is one of ASCII, the lookalikes."""
    made = {}
    for i in range(0x80, 0x20000):
        c = chr(i)
        d = unicodedata.decimal(c, None)
        if d is not None:
            made[i] = str(d)
        elif len(n := unicodedata.normalize("NFKC", c)) == 1 and " " < n < "\x7f":
            made[i] = n
    return made | {ord(k): v for k, v in LOOKALIKES.items()}


class Rewrite:
    """A text after some pieces of it were replaced, and the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement), ascending and apart."""
        parts, self.new, self.old, self.kept = [], [0], [0], []
        at = n = 0
        for start, end, by in edits:
            for piece, upto, same in ((text[at:start], start, True), (by, end, False)):
                parts.append(piece)
                self.kept.append(same)
                n += len(piece)
                self.new.append(n)
                self.old.append(upto)
            at = end
        parts.append(text[at:])
        self.kept.append(True)
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source of a span: a replaced piece counts whole, without the white space around it if it opens or ends the span."""
        i = bisect_right(self.new, start) - 1
        s = self.old[i] + (start - self.new[i]) * self.kept[i]
        j = max(i, bisect_left(self.new, end) - 1)
        e = self.old[j] + end - self.new[j] if self.kept[j] else self.old[j + 1]
        return s, e


def local_start(t: str, end: int) -> tuple[int, int]:
    """Where the local part before ``end`` starts and ends, dots spelled between its pieces included; equal if there is none."""

    def back(at: int, white: bool) -> int:
        while at and (t[at - 1].isspace() if white else t[at - 1] in _LOCAL):
            at -= 1
        return at

    stop = back(end, True)
    start = back(stop, False)
    while start < stop and (k := back(start, True)) < start and t[(word := back(k, False)) : k].lower() in DOT_WORDS:
        before = back(word, True)
        piece = back(before, False)
        if before == word or piece == before or t[piece:before].lower() in BEFORE_DOT:
            break
        start = piece
    return start, stop


def likely(t: str, start: int, stop: int, host: int, end: int, marks: set[int]) -> bool:
    """Whether t[start:stop], an at and t[host:end] are an address. ``marks``: where a dot was bracketed."""
    local, name, at = t[start:stop], t[host:end], t[stop:host]
    if local[-1] in ".-" or local[0] == ".":
        return False
    labels = re.split(rf"\s+{_DOTS}\s+|\.", name, flags=re.I)
    last, dots = labels[-1].lower().rstrip("-"), len(labels) - 1
    spelled = bool(_SPELLED.search(name))
    if "@" in at and (spelled or not at[-1].isspace() and not at[0].isspace()):
        return True
    if not (last.isalpha() and len(last) > 1 or last.startswith("xn--")):
        return False
    if any(host <= k < end for k in marks):
        return True
    domain = last in LABELS or last.startswith("xn--") or len(last) == 2 and last not in WORDS2
    plain_name = bool(re.search(r"[A-Za-z]", local)) and local.lower() not in BEFORE_AT
    cue = plain_name and bool(_CUE.search(t, max(start - NEAR, 0), stop) or _CUE.search(t, end, end + NEAR))
    strong = cue or plain_name and bool(re.search(rf"[0-9._]|\s{_DOTS}\s", local, re.I))
    if spelled and at.strip().lower() == "at" and re.search(r"\spoint\s", name, re.I):
        return strong and (domain or dots > 1)  # "at this point in"
    if spelled:
        if domain or dots > 1:
            return True
        return (strong or plain_name and alone(t, start, end)[1]) and labels[-2].lower() not in BEFORE_DOT and last not in ("the", "and")
    if not (labels[-1].islower() or labels[-1].isupper()) or labels[0].lower() == "www":
        return False
    if "@" in at:
        return strong or domain and at[0].isspace() and at[-1].isspace()
    return strong or plain_name and (domain or last in WORDS2) and all(alone(t, start, end))


def alone(t: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether no word of the same phrase stands before and behind."""
    before, behind = t[max(start - 8, 0) : start].rstrip(" \t"), t[end : end + 8].lstrip(" \t")
    return not before or not before[-1].isalnum() and before[-1] not in "'’", not behind or not behind[0].isalnum() and behind[0] not in "'’"


def spelled_addresses(t: str, marks: set[int]) -> list[tuple[int, int, str]]:
    """The edits that write the at and the dots of addresses as signs."""
    found = []
    for m in _HEAD.finditer(t):
        if (host := _HOST.match(t, m.end())) and (m.group() == "@" or t[m.end()].isspace()):
            (start, stop), (left, right) = local_start(t, m.start()), host.span(1)
            right = left + len(_TAIL.sub("", t[left:right]))
            if start < stop and likely(t, start, stop, left, right, marks):
                found.append((start, stop, left, right))
    out, free = [], 0
    for k, (start, stop, host, end) in enumerate(found):
        # in "me at john dot smith at ..." the name belongs to the second at
        if start < free or t[start:stop].lower() in BEFORE_AT and k + 1 < len(found) and found[k + 1][0] < end:
            continue
        dots = [(m.start(), m.end(), ".") for a, b in ((start, stop), (host, end)) for m in _SPELLED.finditer(t, a, b)]
        if dots or t[stop:host] != "@":
            out += sorted([*dots, (stop, host, "@")])
        free = end
    return out


def runs(t: str) -> Rewrite:
    """Runs of three or more digit words as digits alone."""
    return Rewrite(t, [(m.start(), m.end(), "+" * m.group().lower().startswith(PLUS_WORDS) + "".join(DIGITS[w.lower()] for w in re.findall(_WORD, m.group(), re.I))) for m in (_RUN.finditer(t) if _FEW.search(t.lower()) else ())])


def reach(t: str, start: int) -> int:
    """From where on what stands before a digit word can decide about it: over any run of signs and white space, a word at most, and once more. A run is walked over for two words at most."""
    for _ in range(2):
        while start and not t[start - 1].isalnum():
            start -= 1
        least = max(start - LONGEST, 0)
        while start > least and t[start - 1].isalnum():
            start -= 1
    return start


def white_before(t: str, start: int, least: int) -> int:
    """How long the white space is that ends at ``start``, not before ``least``."""
    k = start
    while k > least and t[k - 1].isspace():
        k -= 1
    return start - k


def adjoining(t: str) -> Rewrite:
    """Every digit word that adjoins a digit, a digit word or a disguised dot as its digit. Between two of them dots stay as one dot, white space, commas and hyphens go; next to a digit white space becomes one space."""
    words = []
    for m in _DIGIT_WORD.finditer(t):
        before = t[reach(t, m.start()) : m.start()]
        if _BEHIND.match(t, m.end()) or before.rstrip(" \t\r\n\f\v,.-(").lower().endswith(_ENDS) and _BEFORE.search(before):
            words.append((m.start(), m.end(), DIGITS[m.group().lower()]))
    edits = [(m.start(), m.end(), "+") for m in _PLUS.finditer(t)]
    last = -1
    for start, end, digit in words:
        gap = t[last:start] if last >= 0 else ""
        if gap and not gap.strip(" \t\r\n\f\v,.-"):
            edits.append((last, start, "." if "." in gap else ""))
        elif last < start and (n := white_before(t, start, max(last, 0))) and start - n > max(last, 0) and t[start - n - 1] in "0123456789" and (n > 1 or t[start - 1] in "\t\r\n"):
            edits.append((start - n, start, " "))
        edits.append((start, end, digit))
        if white := _WHITE_DIGIT.match(t, end):
            edits.append((end, white.end(), " "))
        last = end
    return Rewrite(t, sorted(edits))


def stages(text: str, digits=runs):
    """The transducers that have something to do, one after another."""
    if not text.isascii():
        table = homoglyphs()
        if any(ord(c) in table for c in set(text)) or _INVISIBLE.search(text):
            yield lambda t: Rewrite(t.translate(table), [(m.start(), m.end(), "") for m in _INVISIBLE.finditer(t)])
    yield digits
    marks: set[int] = set()

    def bracketed(t: str) -> Rewrite:
        if not re.search(r"[\[({<]", t):
            return Rewrite(t, [])
        edits, free = [], 0
        for start, end, by in sorted([(m.start(), m.end(), "@") for m in _AT.finditer(t)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(t)]):
            while start > free and t[start - 1].isspace():
                start -= 1
            edits.append((start, end, by))
            free = end
        r = Rewrite(t, edits)
        marks.update(r.new[2 * k + 1] for k, e in enumerate(edits) if e[2] == ".")
        return r

    yield bracketed

    def bare(t: str) -> Rewrite:
        edits = spelled_addresses(t, marks)
        taken = {e[0] for e in edits}
        return Rewrite(t, sorted([*edits, *((m.start(), m.end(), ".") for m in _DOT_DIGITS.finditer(t) if m.start() not in taken)]))

    yield bare


def uncovered(found: list[Span], base: list[Span]) -> list[Span]:
    """The spans, each once, that neither a plain span nor another of their kind covers."""
    out = []
    for kind in KINDS:
        most, mine = -1, sorted((s, e) for b, s, e in base if b == kind)  # they do not overlap
        for k, s, e in sorted({x for x in found if x[0] == kind}, key=lambda x: (x[1], -x[2])):
            at = bisect_right(mine, (s, float("inf"))) - 1
            if e > most and not (at >= 0 and e <= mine[at][1]):
                out.append((k, s, e))
            most = max(most, e)
    return out


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans; both by start, then kind."""
    text = text or ""
    base = plain(text)
    more: list[Span] = []
    read: set[str] = set()
    for digits in (runs, adjoining):
        done: list[Rewrite] = []
        now = text
        for stage in stages(text, digits):
            r = stage(now)
            if r.text != now:
                done.append(r)
                now = r.text
            if stage is digits:
                if now in read:
                    done = []
                    break
                read.add(now)
        if not done:
            continue
        for kind, s, e in plain(now):
            for r in reversed(done):
                s, e = r.back(s, e)
            more.append((kind, s, e))
    more = uncovered(more, base)
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(base + more, key=order)


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def redacted(text: str, found: list[Span]) -> str:
    """Every span replaced by its kind; overlapping spans become one, under the kind that starts first."""
    out, at = [], 0
    for k, s, e in found:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the plain spans counted by kind, base_sha256, spans, n_spans (all)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    @tidy
    def run(batches):
        for batch in batches:
            for start, n in spells(batch.column(1), ROWS, SIZE):
                b = batch.slice(start, n)
                made = [spans(t) for t in b.column(1).to_pylist()]
                counts = [pa.array([sum(x[0] == k for x in base) for base, _ in made], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in made]), pa.array([joined(found) for _, found in made]), pa.array([len(found) for _, found in made], pa.int64())],
                    names=names,
                )

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same rows and columns with personal data replaced in ``text_col``, and ``length_col`` set to the new length."""
    at, schema = docs.columns.index(text_col), docs.schema
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    @tidy
    def run(batches):
        for batch in batches:
            for start, size in spells(batch.column(at), ROWS, SIZE):
                b = batch.slice(start, size)
                cols = list(b.columns)
                texts = [t if t is None or not (f := spans(t)[1]) else redacted(t, f) for t in b.column(at).to_pylist()]
                cols[at] = pa.array(texts, pa.string())
                if length is not None:
                    old = b.column(length).to_pylist()
                    cols[length] = pa.array([n if t is None else len(t) for n, t in zip(old, texts, strict=True)], b.column(length).type)
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, schema)
