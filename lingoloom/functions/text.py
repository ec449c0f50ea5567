"""Text functions, as columns: tags, entities, whole words, word lists, tokens and slugs."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What plain trimming takes off besides spaces.
BLANK = " \t\n\r\0\x0b"
#: The shortest search keyword, and word to be normalised.
LEAST = 3
INSIDE = r"\p{L}\p{N}"


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANK))


def one_line(x: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(BLANK))


_ENTITY = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """HTML entities that end with a semicolon decoded (no built-in has the full list)."""
    return x.map(lambda s: _ENTITY.sub(lambda m: html.unescape(m[0]), s) if s is not None and "&" in s else s)


def plain_text(*parts: Column) -> Column:
    """Readable text of some HTML strings: joined by a space, tags removed without a gap, entities decoded, one line."""
    joined = F.concat_ws(" ", *parts)
    return one_line(unescaped(F.regexp_replace(joined, r"(?s)<!--.*?-->|<[A-Za-z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", "")))


def quoted(needle: Column) -> Column:
    """A pattern that matches the needle literally."""
    return F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def contains_word(text: Column, needle: Column) -> Column:
    """Whether the needle occurs whole, in any case; letters and digits beside it would belong to it. An empty one doesn't."""
    own = one_line(needle)
    found = F.call_function("rlike", text, F.concat(F.lit(rf"(?iu)(?<![{INSIDE}])"), quoted(own), F.lit(rf"(?![{INSIDE}])")))
    return F.when(own == "", False).otherwise(found)


def keywords(x: Column) -> Column:
    """The search keywords that count: at least LEAST characters."""
    return F.filter(F.split(x, r"(?U)[\s,;]+"), lambda k: F.length(k) >= LEAST)


def _accents() -> tuple[str, str]:
    """Lower-case letters that are a plain letter with marks, and those letters; then the marks alone, which go."""
    letters = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))]
    letters = [(c, d[0]) for c, d in letters if c == c.lower() and len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in letters) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in letters)


def folded(x: Column) -> Column:
    """Text as the tables compare it: without regard to case and accents."""
    return F.translate(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), *_accents())


def tokens(text: Column) -> Column:
    """Distinct words of LEAST characters or more, in order; apostrophes and hyphens belong to words."""
    return F.array_distinct(F.transform(F.filter(F.split(text, rf"[^{INSIDE}'-]+"), lambda x: F.length(x) >= LEAST), lambda x: F.lower(x)))


def normal_case(word: Column) -> Column:
    return F.lower(one_line(word))


def is_single_word(term: Column) -> Column:
    own = one_line(term)
    return (own != "") & (F.instr(own, " ") == 0)


def word_count(text: Column) -> Column:
    own = trimmed(text)
    return F.when(own == "", 0).otherwise(F.size(F.split(own, r"(?U)\s+")))


def diff_tokens(text: Column) -> Column:
    """Words with the white space after them."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), F.lit(0))


def nullable(term: Column) -> Column:
    return F.nullif(trimmed(term), F.lit(""))


def slug(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), rf"[^{INSIDE}]+", "-"), F.lit("-"))


def draft_alias(title: Column, source_alias: Column, language: Column) -> Column:
    """The title's slug with the language behind it if that is the source's alias; else empty: the alias is then made of the title on saving."""
    own = slug(title)
    return F.when(own == source_alias, F.concat(own, F.lit("-"), F.lower(language))).otherwise(F.lit(""))


def language_menu(menu: Column, source: str, target: Column) -> Column:
    """A menu's name for a language: the source language's suffix, if any, gives way to the target's."""
    suffix = f"-{source.lower()}"
    stem = F.when(F.endswith(F.lower(menu), F.lit(suffix)), F.substring(menu, F.lit(1), F.length(menu) - len(suffix))).otherwise(menu)
    return F.concat(stem, F.lit("-"), F.lower(target))


def version_key(key: Column) -> tuple[Column, Column]:
    """(alias, id) of "some.alias.id"."""
    return F.regexp_extract(key, r"^(.*)\.[^.]*$", 1), F.substring_index(key, ".", -1)


def short_key(content_type: Column) -> Column:
    return F.substring_index(content_type, ".", -1)


def body(intro: Column, full: Column) -> Column:
    """The intro, and the rest behind a read-more line if there is any."""
    return F.when(F.coalesce(trimmed(full), F.lit("")) != "", F.concat(F.coalesce(intro, F.lit("")), F.lit('<hr id="system-readmore">'), full)).otherwise(F.coalesce(intro, F.lit("")))
