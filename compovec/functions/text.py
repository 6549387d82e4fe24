"""Text column expressions: cleaning, sentence splitting, identifiers.

Everything here is a JVM-side column expression, so segmentation is a narrow
map over documents: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the usual Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Sentence terminators, and the Unicode noncharacters that stand
# for a terminator that must not end a sentence.  Noncharacters never occur in
# interchanged text, so undoing the shield cannot touch real content.
TERMINATORS = ".!?"
SHIELDED = "\ufdd0\ufdd1\ufdd2"

# Patterns of the segmentation rules.
QUOTED_SPAN = '"[^"]*"|“[^”]*”'
PAREN_SPAN = r"\([^()]*\)"
PIECE = r"[^.!?]*[.!?]|[^.!?]+\z"
HEADING = "## [^#]+? ##"
MIN_LENGTH = 30
MAX_LENGTH = 500

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def remove_headings(c: Column) -> Column:
    """Drop ``## ... ##`` headings, squeeze spaces, trim."""
    c = F.regexp_replace(c, HEADING, "")
    return strip(F.regexp_replace(c, " +", " "))


def clean_text(c: Column) -> Column:
    """Newlines and tabs to spaces, runs of spaces and of ``_ - .`` squeezed, ``*`` dropped."""
    c = F.regexp_replace(c, "\n+", " ")
    c = F.regexp_replace(c, "\t+", " ")
    c = F.regexp_replace(c, " +", " ")
    c = F.regexp_replace(c, r"([_\-.])\1+", "$1")
    return strip(F.regexp_replace(c, r"\*", ""))


def _shield_spans(c: Column, pattern: str) -> Column:
    """Hide terminators inside every match of ``pattern``.

    The text between matches and the matches themselves are zipped back
    together, with the terminators of the matches translated.
    """
    gaps = F.split(c, pattern, -1)
    spans = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    woven = F.zip_with(
        gaps, spans,
        lambda gap, span: F.concat(gap, F.coalesce(F.translate(span, TERMINATORS, SHIELDED), F.lit(""))),
    )
    return F.when(c.rlike(pattern), F.array_join(woven, "")).otherwise(c)


def shield_points(c: Column) -> Column:
    """Hide the points of decimals and of the abbreviation ``ex.``."""
    c = F.regexp_replace(c, r"(?<=\p{Nd})\.(?=\p{Nd})", SHIELDED[0])
    return F.regexp_replace(c, r"(?i)(?<![\p{L}\p{N}_])ex\.", "ex" + SHIELDED[0])


def shield_quotes(c: Column) -> Column:
    return _shield_spans(c, QUOTED_SPAN)


def shield_parentheses(c: Column) -> Column:
    return _shield_spans(c, PAREN_SPAN)


def unshield(c: Column) -> Column:
    return F.translate(c, SHIELDED, TERMINATORS)


def split_pieces(c: Column) -> Column:
    """Pieces that end at a terminator (kept), plus an unterminated tail; blanks dropped."""
    found = F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda p: p != F.lit(""))


def sentence_starts(pieces: Column, min_length: int = MIN_LENGTH) -> Column:
    """Positions of the pieces that open a sentence: the first one and every long one."""
    positions = F.transform(pieces, lambda p, i: F.when((i == 0) | (F.length(p) > min_length), i))
    return F.filter(positions, lambda i: i.isNotNull())


def merge_pieces(pieces: Column, starts: Column) -> Column:
    """Join every short piece to the sentence before it; linear in the number of pieces."""
    def one(start: Column, nth: Column) -> Column:
        stop = F.coalesce(F.get(starts, nth + 1), F.size(pieces))
        return F.array_join(F.slice(pieces, start + 1, stop - start), " ")
    return F.transform(starts, one)


def words(c: Column) -> Column:
    """Whitespace-separated words with outer ASCII punctuation removed; case kept, empties kept."""
    body = strip(c)
    parts = F.filter(F.split(body, f"[{_class(WHITESPACE)}]+", -1), lambda w: w != F.lit(""))
    return F.transform(parts, lambda w: F.btrim(w, F.lit(PUNCTUATION)))


def token_count(c: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.size(F.filter(F.split(c, f"[{_class(WHITESPACE)}]+", -1), lambda w: w != F.lit("")))


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(ch):x}}}" for ch in chars)


def report_type(report_id: Column) -> Column:
    """First character of the last ``-`` segment of a report id."""
    return F.substring(F.substring_index(report_id, "-", -1), 1, 1)


def person_id(report_id: Column, pattern: str = r"(?:-\d+)?-[AP]\d+$") -> Column:
    """Report id without its report suffix."""
    return F.regexp_replace(report_id, pattern, "")


def explode_rows(df, keys, arr, names=("pos", "item")):
    """Array elements as rows with their position.

    The outer form is used on purpose: for the inner one the optimizer infers a
    ``size(arr) > 0`` filter, pushes it to the scan and so computes the whole
    array expression a second time (and inside other lambdas, once per element).
    """
    out = df.select(*keys, F.posexplode_outer(arr).alias(*names))
    return out.filter(F.col(names[0]).isNotNull())
