"""Text expressions. All run in the JVM except the part of NFKC that can change a text."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ananym.config import SPECIAL_TOKENS, WORD_MARK

# The characters that count as whitespace when reading text back.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def reverse_text(text: Column) -> Column:
    """Reverse by Unicode code point."""
    return F.reverse(text)


def read_back(text: Column) -> Column:
    """Un-reverse a prompt or generated text and strip the whitespace around it."""
    return F.btrim(F.reverse(text), F.lit(WHITESPACE))


def prefix(text: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def prefix_reversed(text: Column, last_index: int) -> Column:
    """Characters ``last_index`` down to 0, that is ``last_index + 1`` of them."""
    return F.reverse(F.substring(text, 1, last_index + 1))


@lru_cache(maxsize=1)
def _nfkc_classes() -> tuple[str, str]:
    """Two regex character classes: long runs that NFKC never changes, and all characters it may change.

    A character may change when it is not itself in NFKC, has a combining class, or can be the second
    half of a canonical composition.
    """
    seconds = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for cp in range(sys.maxunicode + 1):
        mapping = unicodedata.decomposition(chr(cp))
        if mapping and not mapping.startswith("<"):
            seconds.update(int(part, 16) for part in mapping.split()[1:])
    runs: list[list[int]] = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if cp in seconds or unicodedata.combining(ch) or not unicodedata.is_normalized("NFKC", ch):
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    edges = [(0, 0)] + [tuple(r) for r in runs]
    stable = [(lo[1] + (lo[1] > 0), hi[0] - 1) for lo, hi in zip(edges, edges[1:]) if hi[0] - lo[1] > 40]

    def char_class(ranges):
        return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"

    return char_class(stable), char_class(runs)


def may_change_under_nfkc(text: Column) -> Column:
    """False only where NFKC surely leaves ``text`` as it is."""
    stable, unstable = _nfkc_classes()
    return text.rlike(f"(?=[^\\x00-\\x9F])(?!{stable}){unstable}")


@F.pandas_udf(StringType())
def _nfkc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC. Spark has no such function; only texts that may change are sent to Python."""
    return F.coalesce(_nfkc_udf(F.when(may_change_under_nfkc(text), text)), text)


def _without_lead(text: Column) -> Column:
    """Spaces and literal word marks are the same thing to the splitter; one at the start is dropped."""
    spaced = F.translate(text, WORD_MARK, " ")
    return F.when(spaced.startswith(" "), F.substring(spaced, 2, 2**31 - 1)).otherwise(spaced)


def bare_words(text: Column) -> Column:
    """Words without their leading mark; an empty or null text has none."""
    return F.when(F.length(text) > 0, F.split(_without_lead(text), " ")).otherwise(
        F.array().cast("array<string>")
    )


def marked(word: Column) -> Column:
    return F.concat(F.lit(WORD_MARK), word)


def words(text: Column) -> Column:
    """Words as the vocabulary sees them: cut before each space, the space kept as a leading mark.

    Newlines and tabs stay inside words; a double space gives a lone mark.
    """
    return F.transform(bare_words(text), marked)


def special_segments(text: Column) -> Column:
    """Cut a text around literal special tokens, which stay as pieces of their own."""
    tokens = "|".join(f"\\Q{t}\\E" for t in SPECIAL_TOKENS)
    return F.filter(F.split(text, f"(?={tokens})|(?<={tokens})"), lambda s: s != "")


def characters(text: Column) -> Column:
    """The code points of a text as an array."""
    return F.split(text, "")
