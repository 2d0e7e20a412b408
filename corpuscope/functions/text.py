"""Tokenisation as column expressions (T1-T9), equal to Python's ``re`` on Unicode text.

Nulls give null; empty texts give empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ABBREVIATIONS, MIN_WORDS

LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER}+(?:['’]{LETTER}+)*"
TOKEN = WORD + r"|\p{Nd}+(?:[.,:/]\p{Nd}+)*|[^\p{L}\p{N}_\p{IsWhite_Space}\x1c-\x1f]"
#: White space as Python's ``\s`` and ``str.strip`` have it.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
CLOSERS = r"\"'”’)\]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def words(text: Column, lower: bool = True) -> Column:
    """Runs of letters with inner apostrophes; found first, lower-cased after."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(found, F.lower) if lower else found


def tokens(text: Column) -> Column:
    """Words, numbers with inner separators, or single symbols."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


#: How a piece that joins the next one ends: an abbreviation or an initial, and its full stop.
_OPEN_END = rf"{SPACE}[(\[\"']*(?:{'|'.join(a.replace('.', '[.]') for a in ABBREVIATIONS)}|\p{{L}})[(\[\"']*{SPACE}*[.][{CLOSERS}]*$"


def pieces(text: Column) -> Column:
    """Pieces between end marks, without the closing marks and the white space after them.

    A piece begins and ends without white space, since the bounds take all of it, so that only the whole text is stripped.
    """
    return F.filter(F.split(strip(text), rf"(?<=[.!?…])[{CLOSERS}]*{SPACE}+", -1), lambda p: p != "")


def _is_open(piece: Column) -> Column:
    """Whether a piece ends on an abbreviation or initial; its last characters tell."""
    tail = F.right(F.concat(F.lit(" "), piece), F.lit(64))
    return F.contains(tail, F.lit(".")) & F.rlike(F.lower(tail), F.lit(_OPEN_END))


def openings(parts: Column, wanted) -> Column:
    """``n`` and ``k``: the sentences that the pieces make, and those whose first piece is ``wanted``.

    A piece begins a sentence unless the one before joins it; one fold, in which each piece is looked at once.
    """
    state = F.struct(F.lit(False).alias("joins"), F.lit(0).alias("n"), F.lit(0).alias("k"))

    def add(acc: Column, piece: Column) -> Column:
        begins = F.when(acc["joins"], 0).otherwise(1)
        return F.struct(_is_open(piece).alias("joins"), (acc["n"] + begins).alias("n"), (acc["k"] + F.when((begins == 1) & wanted(piece), 1).otherwise(0)).alias("k"))

    return F.aggregate(parts, state, add)


def sentences(text: Column) -> Column:
    """Pieces between end marks; a piece on an abbreviation or initial joins the next.

    The abbreviation test reads a piece's last word only, so joining is a fold over the pieces.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def add(acc: Column, piece: Column) -> Column:
        joined = F.when(acc["held"] == "", piece).otherwise(F.concat(acc["held"], F.lit(" "), piece))
        open_ = _is_open(piece)
        return F.struct(F.when(open_, acc["done"]).otherwise(F.array_append(acc["done"], joined)).alias("done"), F.when(open_, joined).otherwise(F.lit("")).alias("held"))

    def close(acc: Column) -> Column:
        return F.when(acc["held"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["held"]))

    return F.aggregate(pieces(text), state, add, close)


def lines(text: Column) -> Column:
    """T4: lines that are not blank, without trailing white space."""
    return F.filter(F.transform(F.split(text, LINE_END, -1), lambda x: F.regexp_replace(x, f"{SPACE}+$", "")), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """T5: parts between blank lines."""
    return F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n", -1), strip), lambda p: p != "")


def ngrams(items: Column, n: int) -> Column:
    """Overlapping n-grams as arrays; empty when there are fewer items."""
    if n <= 0:
        raise ValueError("n must be positive")
    return F.when(F.size(items) < n, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - n + 1, F.lit(1))), lambda i: F.slice(items, i, n)))


def view(text: Column) -> dict[str, Column]:
    """Counts of characters, tokens, words, types, sentences, lines, and whether a text is long enough."""
    w = words(text)
    return {
        "n_chars": F.length(text),
        "n_tokens": F.size(tokens(text)),
        "n_words": F.size(w),
        "n_types": F.size(F.array_distinct(w)),
        "n_sentences": F.size(sentences(text)),
        "n_lines": F.size(lines(text)),
        "long_enough": F.size(w) >= MIN_WORDS,
    }


def preview(text: Column, limit: int = 120) -> Column:
    """White space collapsed; cut to ``limit`` characters with an ellipsis."""
    flat = strip(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))
