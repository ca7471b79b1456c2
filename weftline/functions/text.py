"""Expressions on strings: cleaning, tokens, keys and links."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

PUNCTUATION = string.punctuation

#: The same characters as a class; one pass of an expression is many times as fast as translate().
_PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"

#: Whitespace as Python's str.split() sees it, in a form that Java's and RE2's expressions share.
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{_SPACES}]+"

TAG = "<[^>]*>"

START, END = "startseq", "endseq"


def clean(text: Column, legacy: bool = False) -> Column:
    """Lower case without ASCII punctuation. Tags go first; legacy keeps their letters, as deleting "<" and ">" first does."""
    source = text if legacy else F.regexp_replace(text, TAG, "")
    return F.lower(F.regexp_replace(source, _PUNCTUATION_CLASS, ""))


def tokens(text: Column, shortest: int = 2, banned: tuple[str, ...] = ("href", "https")) -> Column:
    """Words of letters only, in lower case without punctuation, of at least shortest letters; a null text has none.

    Words that hold one of the banned strings go. Empty words never appear (a quirk of splitting empty texts is fixed).
    """
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _PUNCTUATION_CLASS, ""))
    # one pass of an expression over the text, in place of a split and a test of each word
    # the class of all spaces is slow, so letters, blanks and line feeds are looked for first
    begins, ends = rf"(?=\p{{L}})(?:(?<=[ \n])|(?<![^{_SPACES}]))", rf"(?:(?=[ \n])|(?![^{_SPACES}]))"
    words = F.regexp_extract_all(plain, F.lit(rf"{begins}\p{{L}}{{{shortest},}}+{ends}"), F.lit(0))

    def keep(w: Column) -> Column:
        found = F.lit(True)
        for b in banned:
            found = found & ~w.contains(b)
        return found

    return F.filter(words, keep) if banned else words


def wrapped(words: Column) -> Column:
    """A token list between the start and the end token."""
    return F.concat(F.array(F.lit(START)), words, F.array(F.lit(END)))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of a token list as strings; none if it is shorter."""
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    grams = F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def pad(ix: Column, length: int, left: bool) -> Column:
    """A list of exactly length numbers. On the left, zeros come first and the end stays; on the right the reverse."""
    kept = F.slice(ix, F.greatest(F.lit(1), F.size(ix) - (length - 1)), length) if left else F.slice(ix, 1, length)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(length) - F.size(ix)))
    return F.concat(zeros, kept) if left else F.concat(kept, zeros)


def canonical_url(url: Column) -> Column:
    """A link without its query."""
    return F.split_part(url, F.lit("?"), F.lit(1))


def url_parameter(url: Column, name: str, width: int, missing: str) -> Column:
    """The first width characters of a query parameter, or the given key if it is missing."""
    found = F.regexp_extract(url, rf"[?&]{name}=([^&#]{{1,{width}}})", 1)
    return F.when(found == "", F.lit(missing)).otherwise(found)


def file_key(name: Column) -> tuple[Column, Column]:
    """Of PREFIX_part_part_N.ext: the key without empty parts and number, and the number."""
    parts = F.filter(F.split(name, "_"), lambda p: p != "")
    key = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")
    return key, F.regexp_extract(F.element_at(parts, -1), r"^([0-9]+)\.", 1).try_cast("int")


def joined_key(*parts: Column) -> Column:
    """Parts joined by underscores, missing ones as None, without the characters that file names cannot hold."""
    return F.translate(F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), "?/", "")


def listed(html: Column, separator: str = "<br>") -> Column:
    """Lines of a marked-up list: cut at the separator and at line feeds, without tags, commas and empty lines."""
    lines = F.flatten(F.transform(F.split(html, separator), lambda x: F.split(x, "\n")))
    plain = F.transform(lines, lambda x: F.replace(F.regexp_replace(x, TAG, ""), F.lit(","), F.lit("")))
    return F.filter(plain, lambda x: (x != "") & (x != '"'))


def after(text: Column, delimiter: str) -> Column:
    """What stands behind the first delimiter; empty if it is missing."""
    at = F.instr(text, delimiter)
    return F.when(at > 0, F.substr(text, at + F.lit(len(delimiter)))).otherwise("")


def path_part(path: Column, from_end: int) -> Column:
    """A component of a path, counted from the end (1 is the name itself); null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def variant_link(base: Column, code: Column) -> Column:
    """The link of a colour variant: the base without its query, and the code as a parameter."""
    return F.concat(canonical_url(base), F.lit("?color="), code)
