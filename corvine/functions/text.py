"""Text as native column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9]+"


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


# Where compound words are cut, pass by pass; other cuts would give other tokens.
CAMEL_CUTS = ("([A-Z]+)", "([A-Z][a-z]+)")


def camel_parts(word: Column) -> Column:
    """A word cut before each run of capitals, and again before each capital that small letters follow."""
    spaced = F.regexp_replace(F.regexp_replace(word, CAMEL_CUTS[0], " $1"), CAMEL_CUTS[1], " $1")
    return F.filter(F.split(spaced, " +"), lambda p: p != "")


def _subwords(word: Column) -> Column:
    tail = F.substring(word, 2, 2**31 - 1)
    parts = camel_parts(word)
    # Only a capital after the first character can make several parts, so most words skip the patterns.
    return F.when(tail == F.lower(tail), F.array(F.lower(word))).otherwise(
        F.when(F.size(parts) > 1, F.concat(F.array(F.lower(word)), F.transform(parts, F.lower))).otherwise(F.array(F.lower(word)))
    )


def tokens(text: Column) -> Column:
    """Distinct lower-case words and the camel parts of compound ones, in the order of first appearance."""
    return F.array_distinct(F.flatten(F.transform(words(F.coalesce(text, F.lit(""))), _subwords)))


_CAMEL, _INNER = [re.compile(c.encode()) for c in CAMEL_CUTS], re.compile(rb"[A-Za-z0-9][A-Z]")
#: Bytes of words, as they are and in lower case; all others become blanks.
_WORDS = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_SMALL = _WORDS.lower()


@lru_cache(maxsize=1 << 16)
def _word_tokens(word: bytes) -> tuple[bytes, ...]:
    small, spaced = word.lower(), word
    for cut in _CAMEL:
        spaced = cut.sub(rb" \1", spaced)
    parts = [p for p in spaced.lower().split(b" ") if p]
    return (small, *parts) if len(parts) > 1 else (small,)


def token_set(text: bytes) -> set[bytes]:
    """The same as `tokens` of one text, in no order, for tasks that go on in Python."""
    found = set(text.translate(_SMALL).split())
    if _INNER.search(text):
        for w in set(text.translate(_WORDS).split()):
            if w[1:] != w[1:].lower():
                found.update(_word_tokens(w))
    return found


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("long")


def decoded(content: Column) -> Column:
    """Bytes as text, invalid ones replaced; line ends stay as they are."""
    return F.make_valid_utf8(content.cast("string"))


def cut(content: Column, start: Column, end: Column) -> Column:
    """The bytes from start to end, both clamped to the content."""
    size = F.octet_length(content)
    low = F.least(F.greatest(start, F.lit(0)), size)
    high = F.least(F.greatest(end, F.lit(0)), size)
    return F.substring(content, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))


def spliced(content: Column, start: Column, end: Column) -> Column:
    """The same as text."""
    return F.coalesce(decoded(cut(content, start, end)), F.lit(""))


def content_hash(content: Column) -> Column:
    """MD5 in hex, empty where there is no content."""
    return F.coalesce(F.md5(content), F.lit(""))


def numbered(line: Column, text: Column) -> Column:
    """A line with its number, at least four wide."""
    digits = line.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), " "), F.lit(": "), text)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows; a name that only begins with a dot, or ends with one, has none."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def cleaned_import(raw: Column) -> Column:
    """Without blanks, quotes and all leading dots and slashes."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), "^'+|'+$", ""), '^"+|"+$', ""))
    return F.regexp_replace(bare, "^[./]+", "")
