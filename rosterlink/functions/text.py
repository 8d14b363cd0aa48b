"""Text keys as column expressions: names, DOIs, ORCIDs, dates, inverted indexes.

Whitespace means Unicode whitespace throughout. The accent folds are exact for all
characters, composed Hangul by arithmetic; ``strict=True`` sends a column through Arrow and
Python's own tables instead.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as Python sees it. Single ASCII characters make the fastest regex class; the
# Unicode class is only used on text that has other characters.
_ASCII_WS = "[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f]"
_UNICODE_WS = r"(?U)[\s\x1c-\x1f]"
_ALL_WS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_NON_ASCII = r"[^\x00-\x7F]"
_HANGUL = range(0xAC00, 0xD7A4)

# Characters read as word breaks in a name.
NAME_BREAKS = "[-,.;:'’_]"
# Prefixes of a DOI, of which one is removed.
DOI_PREFIXES = r"^(https?://(dx\.)?doi\.org/|doi:)"
# Punctuation stripped from both ends of a DOI, and its shape.
DOI_EDGE_PUNCTUATION = ".,;:!?"
DOI_SHAPE = r"^10\.\d{4,9}/\S+$"
# Prefix of an ORCID in URL form, and the shape of the bare form.
ORCID_URL_PREFIX = "https://orcid.org/"
ORCID_SHAPE = r"^[^-]*(-[^-]*){3}$"
# Date layouts with the shape a text must have to be tried with them; a
# failing parse is dear. What fits none falls back to a bare year.
DATE_FORMATS = (
    (r"^\d{4}$", "yyyy"),
    (r"^\d{4}-\d\d$", "yyyy-MM"),
    (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"),
    (r"^\d{4}-\d\d-\d\d \d\d:", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d\d-\d\dT", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]"),
    (r"^\d{4}/\d\d/\d\d$", "yyyy/MM/dd"),
    (r"^\d{4}/\d\d/\d\d \d\d:", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d\d\.\d\d\.\d{4}$", "dd.MM.yyyy"),
    (r"^\d\d-\d\d-\d{4}$", "dd-MM-yyyy"),
    (r"^\d\d/\d\d/\d{4}$", "dd/MM/yyyy"),
    (r"^\d\d/\d\d/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]+ \d{4}$", "MMMM yyyy"),
    (r"^[A-Z][a-z]+ \d{4}$", "MMM yyyy"),
)
YEAR_ANYWHERE = r"(?U)\b((?:19|20)\d{2})\b"


def _decomposed(char: str, form: str) -> str:
    parts = unicodedata.normalize(form, char)
    if form == "NFD":
        return "".join(p for p in parts if unicodedata.category(p) != "Mn")
    return parts.encode("ascii", "ignore").decode()


# blocks whose characters without a counterpart are dropped by table already
_COMMON_BLOCKS = (range(0x80, 0x250), range(0x2000, 0x2070))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _char_class(chars: str) -> str:
    """Regex class of the characters, runs as ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


@lru_cache(maxsize=None)
def _fold_tables(form: str) -> tuple[str, str, str, str]:
    """Characters, their one-character folds, a class of those with longer folds, these as JSON.

    All by rule from ``unicodedata``.
    """
    single: dict[str, str] = {}
    dropped: list[str] = []
    several: dict[str, str] = {}
    for code in range(0x80, 0x30000):
        if 0xD800 <= code <= 0xDFFF or code in _HANGUL:
            continue
        char = chr(code)
        folded = _decomposed(char, form)
        if folded == char:
            continue
        if len(folded) == 1:
            single[char] = folded
        elif folded:
            several[char] = folded
        elif form == "NFD" or any(code in block for block in _COMMON_BLOCKS):
            dropped.append(char)
    pairs = json.dumps([{"k": k, "v": v} for k, v in several.items()])
    # translate() drops the characters that have no counterpart
    return "".join(single) + "".join(dropped), "".join(single.values()), _char_class("".join(several)), pairs


# The parts that composed Hangul is made of, in order; the third part may be none.
_LEADS, _VOWELS, _TAILS = ("".join(map(chr, r)) for r in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)))
_SYLLABLE = f"[{chr(_HANGUL[0])}-{chr(_HANGUL[-1])}]"


def _hangul_apart(text: Column) -> Column:
    """Composed Hangul as its two or three parts: a syllable's place in the block gives them."""
    each = len(_TAILS) + 1

    def part(parts: str, place: Column) -> Column:
        return F.substring(F.lit(parts), place, F.lit(1))

    def apart(char: Column) -> Column:
        place = F.ascii(char) - _HANGUL[0]
        lead, vowel = F.floor(place / (each * len(_VOWELS))), F.floor(place / each) % len(_VOWELS)
        tail = F.when(place % each > 0, part(_TAILS, place % each)).otherwise("")
        whole = F.concat(part(_LEADS, (lead + 1).cast("int")), part(_VOWELS, (vowel + 1).cast("int")), tail)
        return F.when(char.rlike(_SYLLABLE), whole).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), apart), "")


def _fold(col: Column, form: str) -> Column:
    source, target, several, pairs_json = _fold_tables(form)
    pairs = F.from_json(F.lit(pairs_json), "array<struct<k:string,v:string>>")

    def expand(text: Column) -> Column:
        longer = F.aggregate(pairs, text, lambda done, pair: F.replace(done, pair["k"], pair["v"]))
        return F.when(text.rlike(several), longer).otherwise(text)

    def finish(text: Column) -> Column:
        done = let(F.translate(text, source, target), lambda t: F.when(t.rlike(_NON_ASCII), expand(t)).otherwise(t))
        if form == "NFKD":
            return F.regexp_replace(done, _NON_ASCII, "")
        return let(done, lambda t: F.when(t.rlike(_SYLLABLE), _hangul_apart(t)).otherwise(t))

    # plain ASCII, by far the most text, skips the tables
    return let(col, lambda text: F.when(text.rlike(_NON_ASCII), finish(text)).otherwise(text))


@F.pandas_udf(T.StringType())
def _strict_nfd(texts: pd.Series) -> pd.Series:
    def fold(text):
        marks_apart = unicodedata.normalize("NFD", text)
        return "".join(c for c in marks_apart if unicodedata.category(c) != "Mn")

    return texts.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _strict_ascii(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda text: unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode(), na_action="ignore"
    )


def strip_accents(col: Column, strict: bool = False) -> Column:
    """Canonical decomposition without combining marks; null stays null."""
    return _strict_nfd(col) if strict else _fold(col, "NFD")


def ascii_fold(col: Column, strict: bool = False) -> Column:
    """Compatibility decomposition reduced to ASCII; null stays null."""
    return _strict_ascii(col) if strict else _fold(col, "NFKD")


def squeeze(col: Column, ascii_only: bool = False) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    if ascii_only:
        return F.trim(F.regexp_replace(col, _ASCII_WS + "+", " "))
    return let(col, lambda text: F.trim(
        F.when(text.rlike(_NON_ASCII), F.regexp_replace(text, _UNICODE_WS + "+", " "))
        .otherwise(F.regexp_replace(text, _ASCII_WS + "+", " "))
    ))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_ALL_WS))


def blank_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def null_if_blank(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def name_key(col: Column, strict: bool = False) -> Column:
    """Comparison key of a name; blank for null."""
    return squeeze(F.lower(F.regexp_replace(strip_accents(blank_if_null(col), strict), NAME_BREAKS, " ")))


def name_token(col: Column, keep_hyphens: bool = True, strict: bool = False) -> Column:
    """``initials last``; null when fewer than two words are left.

    With hyphens kept, a hyphenated first name gives one initial per part; without,
    the hyphens go first and it gives a single one.
    """
    def surname_last(text: Column) -> Column:
        comma = F.instr(text, ",")
        swapped = F.concat(
            strip(F.substring(text, comma + 1, F.length(text))), F.lit(" "),
            strip(F.substring(text, F.lit(1), comma - 1)),
        )
        return F.when(comma > 0, swapped).otherwise(text)

    def token(words: Column) -> Column:
        given = F.get(words, F.lit(0))
        initials = F.regexp_replace(F.regexp_replace(given, r"([^-])[^-]*-*", "$1"), "^-+", "")
        short = F.coalesce(null_if_blank(initials), F.substring(given, 1, 1))
        return F.when(F.size(words) >= 2, F.lower(F.concat(short, F.lit(" "), F.element_at(words, -1))))

    kept = r"[^\w\s\x1c-\x1f-]" if keep_hyphens else r"[^\w\s\x1c-\x1f]"
    cleaned = F.regexp_replace(ascii_fold(let(strip(col), surname_last), strict), kept, "")
    return let(F.split(squeeze(cleaned, ascii_only=True), " "), token)


def text_fold(col: Column, strict: bool = False) -> Column:
    """ASCII fold with whitespace squeezed, case kept; null stays null."""
    return squeeze(ascii_fold(col, strict), ascii_only=True)


def doi_key(col: Column) -> Column:
    """Bare lower-case DOI, or null when the text is none."""
    bare = F.regexp_replace(F.lower(strip(col)), DOI_PREFIXES, "")
    bare = F.btrim(strip(bare), F.lit(DOI_EDGE_PUNCTUATION))
    return let(bare, lambda doi: F.when(doi.rlike(DOI_SHAPE), doi))


def orcid_key(col: Column) -> Column:
    """Bare ORCID, or null when it has not exactly three hyphens."""
    bare = F.regexp_replace(col, "^" + ORCID_URL_PREFIX, "")
    return F.when(bare.rlike(ORCID_SHAPE), bare)


def orcid_url(col: Column) -> Column:
    return F.concat(F.lit(ORCID_URL_PREFIX), col)


def full_name(*parts: Column) -> Column:
    """Parts joined by a space, a missing part counting as empty."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(" "), blank_if_null(part)]
    return F.concat(*pieces[1:])


def embedding_text(title: Column, abstract: Column) -> Column:
    return F.concat(blank_if_null(title), F.lit(". "), blank_if_null(abstract))


def text_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def text_md5(col: Column) -> Column:
    return F.md5(col)


def publication_year(col: Column) -> Column:
    """Year of a date in any of the known layouts, else of the first 19xx or 20xx."""
    def year(text: Column) -> Column:
        parsed = F.coalesce(*[
            F.when(text.rlike(shape), F.year(F.try_to_timestamp(text, F.lit(layout)))) for shape, layout in DATE_FORMATS
        ])
        found = F.nullif(F.regexp_extract(text, YEAR_ANYWHERE, 1), F.lit("")).cast("int")
        # nanosecond timestamps end in these years; outside them only a bare year counts
        return F.coalesce(let(parsed, lambda y: F.when(y.between(1678, 2261), y)), found)

    return let(strip(col), year)


def text_from_index(col: Column) -> Column:
    """Text rebuilt from ``word -> positions``, ordered by position, then word."""
    placed = F.flatten(F.transform(
        F.map_entries(col),
        lambda entry: F.transform(entry["value"], lambda at: F.struct(at.alias("at"), entry["key"].alias("word"))),
    ))
    return blank_if_null(F.array_join(F.transform(F.array_sort(placed), lambda item: item["word"]), " "))


def digits_only(col: Column) -> Column:
    return col.rlike("^[0-9]+$")


def as_id(col: Column) -> Column:
    """Digit string to id; null for anything else."""
    return F.when(digits_only(col), col.try_cast("bigint"))
