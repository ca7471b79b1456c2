"""Personal data in texts: base patterns, and the same patterns behind disguises, with spans in the source text.

A transducer writes a normalised view of a text: homoglyphs, wide and other forms of ASCII characters, spelled digits,
and "at" and "dot" in disguise become the plain character, invisible characters vanish. Each character of the view
keeps the source span that it came from, so that what is found in the view maps back to the source.
"""

from __future__ import annotations

import operator
import re
import sys
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import batches, sha256_text, table

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones, beside what compatibility normalisation finds.
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "п": "n", "т": "t", "м": "m", "к": "k", "в": "b", "г": "r",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "ε": "e", "η": "n", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "．": ".", "·": ".",
}

#: Spelled digits of the four languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

AT, DOT = "at|arroba|chez|aet", "dot|punkt|point|punto|period"
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))

#: A bracketed "at" or "dot"; blanks before it are taken along.
BRACKETED = re.compile(rf"[(\[{{<]\s{{0,3}}(?:(?P<at>{AT}|@)|(?P<dot>{DOT}|\.))\s{{0,3}}[)\]}}>][ \t]{{0,3}}", re.I)

#: Last labels that make an address of a spoken or marked "at" and up to one spoken dot; any word could stand there otherwise.
LAST = frozenset(
    "com org net edu gov mil int info biz name io ai app dev me co us uk ca au nz ie in eu de at ch fr be nl lu es pt it mx ar cl pe br pl se no fi dk cz jp cn ru museum shop store site online xyz tech blog cloud email "
    "example test".split()
)

#: An "at" of any kind, the run of labels behind it, and a spoken dot at the end of what is before it.
SAID_AT = re.compile(rf"(?P<marked>(?-i: AT )| ?(?:_at_|-at-) ?)|(?P<bare> (?:{AT}) )|(?P<sign> ?@ ?)", re.I)
LABEL = re.compile("[A-Za-z0-9-]+")
SAID_DOT = re.compile(rf" (?:{DOT}) (?=[A-Za-z0-9-])", re.I)
DOTS_BEFORE = tuple(f" {d} " for d in DOT.split("|"))
SPOKEN_HINTS = tuple(f" {d} " for d in DOT.split("|"))
MARKED_HINTS = ("_at_", "-at-")

#: At least four spelled digits or numbers, the first one spelled, with signs and separators between them; a run is read
#: as a whole, however long.
DIGITS = re.compile(
    rf"(?:\bplus[ -]{{1,3}}|\+ ?)?(?<![^\W\d_])(?:{_DIGIT_WORD})(?:[ ,-]{{1,3}}(?:(?:{DOT}) {{1,3}})?(?:{_DIGIT_WORD}|[0-9]{{1,19}})(?![^\W\d_])){{3,}}+", re.I
)
DIGITS_PART = re.compile(rf"(?P<plus>plus[ -]*)|(?P<dot>[ ,-]*(?:{DOT}) *)|(?P<word>{_DIGIT_WORD})|(?P<gap>[ ,-]+)", re.I)
DIGIT_WORDS = frozenset(SPELLED) | frozenset(DOT.split("|"))


def _folds() -> dict[int, str]:
    """Characters outside ASCII that stand for ASCII ones: by the table above, by compatibility, or as digits."""
    out = {ord(k): v for k, v in HOMOGLYPHS.items()}
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        if c in out or unicodedata.category(ch) in ("Cs", "Cn", "Co"):
            continue
        if unicodedata.category(ch) == "Cf":
            out[c] = ""
        elif unicodedata.category(ch) == "Nd":
            out[c] = str(unicodedata.digit(ch))
        elif unicodedata.category(ch) == "Zs":
            out[c] = " "
        elif (n := unicodedata.normalize("NFKC", ch)).isascii() and len(n) <= 3:
            out[c] = n
    for keep in "ªº²³¹¼½¾´¨¯¸":  # ordinary signs of Latin texts
        out.pop(ord(keep), None)
    return out


FOLDS = _folds()
LATIN_FOLDS = [bytes([c]) for c in sorted(FOLDS) if c < 256]
_FOLD_CLASS = re.compile("[" + re.escape("".join(map(chr, sorted(FOLDS)))) + "]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns: leftmost and non-overlapping for each kind, failing matches dropped.

    Written so that every pattern takes time in proportion to the text: an address is sought from its @, whose local
    part is the run of characters before it.
    """
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            low = m.end()
        else:
            low = max(low, at + 1)
        at = text.find("@", max(low, at + 1))
    if DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(1, *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


class View:
    """A text and, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts: list[int] | range = range(len(text))
        self.ends: list[int] | range = range(1, len(text) + 1)

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Put the new strings in place of the given ranges, which are in order and do not overlap."""
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            if a < at or b <= a:
                continue
            parts += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        if parts:
            self.text = "".join([*parts, self.text[at:]])
            self.starts, self.ends = [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]


def _brackets(text: str) -> Iterable[tuple[int, int, str]]:
    for m in BRACKETED.finditer(text):
        start = m.start()
        while start and m.start() - start < 3 and text[start - 1] in " \t":
            start -= 1
        yield start, m.end(), "@" if m["at"] else "."


def _labels(text: str, at: int, spoken_only: bool) -> list[tuple[int, int]]:
    """Where the labels from there on are, with dots between them, spoken ones or of either kind."""
    out = []
    while m := LABEL.match(text, at):
        out.append(m.span())
        if dot := SAID_DOT.match(text, m.end()):
            at = dot.end()
        elif not spoken_only and text.startswith(".", m.end()):
            at = m.end() + 1
        else:
            break
    return out


def _local_parts(text: str, end: int, low: int) -> list[tuple[int, int]]:
    """Where the parts of a local name that ends there are, with spoken dots between them, not before low."""
    out = []
    while True:
        start = end
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start == end:
            return out[::-1]
        out.append((start, end))
        before = _lower(text[max(low, start - 8) : start])
        if not (dot := next((d for d in DOTS_BEFORE if before.endswith(d)), None)):
            return out[::-1]
        end = start - len(dot)


def _spoken(text: str) -> Iterable[tuple[int, int, str]]:
    """Addresses with a bare "at" and spoken dots, a marked one, or an @ and spoken dots. Runs of parts and labels are
    read as a whole, however many there are, so that nothing of an address stays behind. They end with their last label
    of two letters or more; without an @ and with fewer than two spoken dots that must be one of LAST."""
    low, at = 0, 0
    while m := SAID_AT.search(text, at):
        at = m.end() if m.end() > m.start() + 1 else m.start() + 1
        local, labels = _local_parts(text, m.start(), low), _labels(text, m.end(), m["bare"] is not None)
        dots = len(local) - 1 + sum(text[b:c] != "." for (_, b), (c, _) in zip(labels, labels[1:]))
        known = not m["sign"] and dots < 2

        def ends(word: str, known: bool = known) -> bool:
            word = _lower(word.rstrip("-"))
            return word in LAST or not known and len(word) > 1 and word.isalpha()

        while labels and not ends(text[slice(*labels[-1])]):
            labels.pop()
        if not local or len(labels) < 2 or m["sign"] and not dots:
            continue
        for (_, a), (b, _) in zip(local, local[1:]):
            yield a, b, "."
        yield m.start(), m.end(), "@"
        for (_, a), (b, _) in zip(labels, labels[1:]):
            if text[a:b] != ".":
                yield a, b, "."
        low = at = labels[-1][1]


def _digits(text: str) -> Iterable[tuple[int, int, str]]:
    for m in DIGITS.finditer(text):
        for p in DIGITS_PART.finditer(text, *m.span()):
            yield p.start(), p.end(), "+" if p["plus"] else "." if p["dot"] else SPELLED[_lower(p["word"])] if p["word"] else ""


def _lower(text: str) -> str:
    """Lower case as re.I sees it, for which \u0130 is an i and not two characters."""
    return text.replace("\u0130", "i").lower()


def _may_speak(text: str, low: str) -> bool:
    """Whether _spoken() can change the text: each form has a spelled dot or a marked "at"."""
    return any(h in low for h in SPOKEN_HINTS) or " AT " in text or any(h in low for h in MARKED_HINTS)


def _may_spell(low: str) -> bool:
    """Whether DIGITS can match. Its first and last parts may touch other signs, but those between them are words or
    numbers of their own, so at least two stand next to each other once the separators are gone."""
    parts = list(filter(None, low.replace(",", " ").replace("-", " ").split(" ")))
    return b"\1\1" in bytes(map(operator.or_, map(DIGIT_WORDS.__contains__, parts), map(str.isdigit, parts)))


def _may_fold(text: str) -> bool:
    """Whether anything outside ASCII and the letters of Latin 1 is there; a quick test that spares most texts."""
    if text.isascii():
        return False
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return any(c in plain for c in LATIN_FOLDS)


def view(text: str) -> View | None:
    """The normalised view of a text, or None if nothing in it is in disguise."""
    v = View(text)
    if _may_fold(text):
        v.rewrite((m.start(), m.end(), FOLDS[ord(m[0])]) for m in _FOLD_CLASS.finditer(text))
    if any(c in v.text for c in "([{<"):
        v.rewrite(_brackets(v.text))
    low = _lower(v.text)
    if _may_speak(v.text, low):
        v.rewrite(_spoken(v.text))
        low = _lower(v.text)
    if _may_spell(low):
        v.rewrite(_digits(v.text))
    return None if v.text is text else v


def find_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind and start. Spans of the view are added where no base span of the same kind
    overlaps them, or where they hold all of those that do."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if v := view(text):
        for kind, a, b in base_spans(v.text):
            start, end = v.starts[a], v.ends[b - 1]
            near = [(s, e) for k, s, e in base if k == kind and s < end and e > start]
            if (start, end) not in near and all(start <= s and e <= end for s, e in near):
                out.append((kind, start, end, False))
    return sorted(out)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs: spans is an array of struct<kind, start, end, base>.

    start and end count code points of the source text, end exclusive; base marks what the base patterns find in the
    source itself. Spans are in the order of KINDS, then of start. Null is the empty text, which has none; repeated
    rows give repeated rows, an empty table none; other columns are ignored. Very long texts take time in proportion to
    their length, however many parts, labels or digits stand in a row.
    """

    def find(frame: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        found = [find_spans(t.as_py() or "") for t in frame.column(1)]
        spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in x] for x in found]
        yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])

    docs = docs.select("doc_id", "text")
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
    return docs.mapInArrow(batches(find), T.StructType([docs.schema["doc_id"], T.StructField("spans", spans)]))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *counts, sha256_text(span_text(base)).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
