"""Text expressions: whitespace, tokens, accents, lookups. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything Python's str.isspace() takes for white space, as a character class for both Java and RE2.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
#: A token of the vectoriser: a maximal run of at least two word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Cell texts that a CSV reader takes for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _accents() -> tuple[str, str]:
    """Latin letters with marks and the letters below the marks, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _accents()


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, outer ones vanish; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS + "+", " "))


def strip(c: Column) -> Column:
    """Without outer white space; null stays null."""
    return F.btrim(c, F.lit(SPACES))


def fill(c: Column, default: str = "", na_tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    """Missing values (null or one of the tokens) become the default, then outer white space goes."""
    text = c.cast("string")
    return strip(F.coalesce(F.when(~text.isin(*na_tokens), text) if na_tokens else text, F.lit(default)))


def strip_accents(c: Column) -> Column:
    """Letters without their marks. A text of as many bytes as characters has none and is left as it is."""
    return F.when(F.octet_length(c) > F.char_length(c), F.translate(c, ACCENTED, BASE)).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-cased tokens without accents, in text order."""
    return F.regexp_extract_all(strip_accents(F.lower(c)), F.lit(f"({TOKEN})"), F.lit(1))


def ngrams_1_2(words: Column) -> Column:
    """The words and the pairs of neighbouring words, joined by a blank. The list is bound to a variable, so it is made once."""

    def both(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b)))

    return F.get(F.transform(F.array(words), both), 0)


def counted(words: Column) -> Column:
    """array<struct<term, tf>>: the distinct words of a list with their numbers. The sorted list is cut where a run of equal
    words begins, so counting within a row needs no shuffle."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        ends = lambda s: F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(n))
        both = F.get(F.transform(F.array(starts), lambda s: F.zip_with(s, ends(s), lambda i, j: F.struct(F.get(w, i).alias("term"), (j - i).cast("bigint").alias("tf")))), 0)
        return F.when(n > 0, both).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return F.get(F.transform(F.array(F.sort_array(words)), runs), 0)


def split_list(c: Column, separator: str = ",") -> Column:
    """Parts of a separated list, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(c, separator), strip), lambda x: x != "")


def join_names(names: Column) -> Column:
    """Cleaned, non-empty names joined by ', '."""
    return F.array_join(F.filter(F.transform(names, collapse), lambda x: x != ""), ", ")


def primary_category(primary: Column, categories: Column, prefix: str = "astro-ph.") -> Column:
    """The stated primary category, else the first with the prefix, else the first, else 'unknown'."""
    return F.coalesce(F.when(primary != "", primary), F.get(F.filter(categories, lambda x: x.startswith(prefix)), 0), F.get(categories, 0), F.lit("unknown"))


def dedup_key(url: Column, title: Column, published: Column) -> Column:
    """The address, or title and date where there is none."""
    address = strip(F.coalesce(url, F.lit("")))
    return F.when(address != "", address).otherwise(F.concat_ws("::", F.coalesce(title, F.lit("")), F.coalesce(published, F.lit(""))))


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def published_year(c: Column) -> Column:
    """Year in UTC of an ISO date or timestamp; null where it can't be read."""
    return F.year(F.try_to_timestamp(strip(c)))


def year_prefix(c: Column) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, 4)


def display_date(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.substring(c, 1, 10)).otherwise("Unknown date")
