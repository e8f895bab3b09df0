"""Text helpers as column expressions: blanks, numerals, brackets, URL parameters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s is ASCII only; this is (?U)\s by its members, which needs no look-up of each character's kind.
BLANK = r"[\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# Chinese digits and numeral words.
DIGITS = "零一二三四五六七八九"
TEN, HUNDRED = "十", "一百"

# Unit words of money and their factors.
UNIT_FACTORS = (("%", 0.0), ("亿", 1e8), ("万", 1e4))


def chinese_numerals(limit: int = 100) -> dict[str, int]:
    """Numeral words 零 to 一百 by rule."""
    words = {}
    for n in range(limit + 1):
        tens, ones = divmod(n, 10)
        if n == 100:
            word = HUNDRED
        elif tens == 0:
            word = DIGITS[ones]
        else:
            word = (DIGITS[tens] if tens > 1 else "") + TEN + (DIGITS[ones] if ones else "")
        words[word] = n
    return words


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in one expression."""
    return F.transform(F.array(value), use)[0]


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def first_symbol(text: Column, candidates: Sequence[str]) -> Column:
    """The first candidate that occurs in the text at all, else null."""
    return F.coalesce(*[F.when(text.contains(c), F.lit(c)) for c in candidates])


def index_of(text: Column, symbol: Column) -> Column:
    """1-based position of the symbol, 0 if it is absent or null."""
    return F.coalesce(F.instr(text, symbol), F.lit(0))


def last_index_of(text: Column, symbol: Column) -> Column:
    """1-based position of the last occurrence of a one-character symbol, else 0."""
    back = index_of(F.reverse(text), symbol)
    return F.when(back > 0, F.length(text) - back + 1).otherwise(0)


def bracket_positions(text: Column) -> tuple[Column, Column]:
    """1-based positions of the opening and closing bracket, ASCII form preferred, 0 if absent."""
    return (
        index_of(text, first_symbol(text, ("(", "（"))),
        index_of(text, first_symbol(text, (")", "）"))),
    )


def ends_with_colon(text: Column) -> Column:
    return F.trim(text).rlike("[:：]$")


def chinese_number(text: Column) -> Column:
    """Value of a numeral word, -1 if it is none."""
    table = F.create_map(*[F.lit(x) for kv in chinese_numerals().items() for x in kv])
    return F.coalesce(F.try_element_at(table, text), F.lit(-1))


def leading_number(text: Column) -> Column:
    """The decimal number a text starts with, 0 if it starts with none."""
    number = F.regexp_extract(text, r"^(\d+(?:\.\d*)?|\.\d+)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def to_number(text: Column) -> Column:
    """Number or null, never an error."""
    return F.trim(text).try_cast("double")


def unit_factor(unit: Column) -> Column:
    """1e4 for 万, 1e8 for 亿, 0 for a percentage, else 1."""
    known = [F.when(unit.contains(word), F.lit(value)) for word, value in UNIT_FACTORS]
    return F.coalesce(*known, F.lit(1.0))


def url_param(url: Column, name: str) -> Column:
    """Decoded query parameter, null if it is missing or the URL is malformed."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def article_id(url: Column) -> Column:
    return url_param(url, "articleId")


def join_texts(texts: Column, separator: str) -> Column:
    return F.concat_ws(separator, texts)
