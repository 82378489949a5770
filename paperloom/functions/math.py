"""Mathematics in texts: segments between delimiters, and lines that are formulas without any.

Segments come from one left-to-right pattern whose tokens cover the whole text: an opener
with its closer, an opener that is never closed (the rest of the text), or what lies
between.  Neighbouring plain tokens are joined by a fold.

Defined cases: a null text is empty and has no segment; an opener without its closer makes
the rest of the text plain; delimiters around nothing are plain; lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Delimiters (opener, closer, shown on a line of its own), signs and words of loose formulas, and their TeX.
DELIMITERS = (("$$", "$$", True), ("\\[", "\\]", True), ("\\(", "\\)", False), ("$", "$", False))
#: Java and RE2 read it alike: the longer of two openers at a place comes first, and a closer may be missing at the end.
TOKEN = r"(?s)\$\$.*?(?:\$\$|\z)|\\\[.*?(?:\\\]|\z)|\\\(.*?(?:\\\)|\z)|\$.*?(?:\$|\z)|[^$\\]+|\\"
TAG = r"(?i)</?[a-z][^>]*>"
STATEMENT = r"(?i)^(for|if|then|while|return|non-blocking|blocking)\b"
MARKS, LONG_WORD, SIGN = r"[\\_{}^=≈∼~πθτΔ∑∏≤≥<>|]", "[A-Za-z]{4,}", r"[^A-Za-z0-9\s]"
LEAST_MARKS, MOST_LONG_WORDS, SIGN_SHARE = 2, 4, 0.18
NUMBERED = r"^(\d+\s*[:.)]\s*)?(.+)$"
TEX = (("π", "\\pi "), ("θ", "\\theta "), ("τ", "\\tau "), ("Δ", "\\Delta "), ("∼", "\\sim "), ("~", "\\sim "), ("−", "-"), ("×", "\\times "), ("≤", "\\le "), ("≥", "\\ge "))

SEGMENT = "struct<kind:string,value:string,display:boolean>"


def segments(text: Column) -> Column:
    """A text as an array of struct(kind 'text' or 'math', value, display)."""

    def plain(token: Column) -> Column:
        return F.struct(F.lit("text").alias("kind"), token.alias("value"), F.lit(None).cast("boolean").alias("display"))

    def read(token: Column) -> Column:
        found = None
        for opener, closer, display in DELIMITERS:
            n = len(opener) + len(closer)
            inner = T.stripped(F.substring(token, F.lit(len(opener) + 1), F.length(token) - n))
            good = F.startswith(token, F.lit(opener)) & F.endswith(token, F.lit(closer)) & (F.length(token) >= n) & (inner != "")
            segment = F.struct(F.lit("math").alias("kind"), inner.alias("value"), F.lit(display).alias("display"))
            # A token of the longer opener is never one of the shorter.
            good = good & ~F.startswith(token, F.lit("$$")) if opener == "$" else good
            found = F.when(good, segment) if found is None else found.when(good, segment)
        return found.otherwise(plain(token))

    def joined(done: Column, next_: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        both = (last["kind"] == "text") & (next_["kind"] == "text")
        # Delimiters around nothing are segments of their own, as they are closed.
        both = F.coalesce(both, F.lit(False)) & ~last["value"].rlike(EMPTY) & ~next_["value"].rlike(EMPTY)
        return F.when(both, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(plain(F.concat(last["value"], next_["value"]))))).otherwise(F.concat(done, F.array(next_)))

    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), 1), read)
    return F.aggregate(tokens, F.array().cast(f"array<{SEGMENT}>"), joined)


#: Delimiters around white space.
EMPTY = r"^(?:\$\$\s*\$\$|\\\[\s*\\\]|\\\(\s*\\\)|\$\s*\$)$"


def is_loose_formula(body: Column) -> Column:
    """A line that is a formula though nothing delimits it."""
    few = (T.count(body, LONG_WORD) <= MOST_LONG_WORDS) | (T.count(body, SIGN) > SIGN_SHARE * F.greatest(F.lit(1), F.length(body)))
    return ~body.rlike(TAG) & ~body.rlike(STATEMENT) & (T.count(body, MARKS) >= LEAST_MARKS) & few


def loose_formula(line: Column) -> Column:
    """struct(prefix, formula) of a loose formula, its signs as TeX; null for any other line."""

    def tex(body: Column) -> Column:
        for sign, name in TEX:
            body = F.replace(body, F.lit(sign), F.lit(name))
        return body

    def read(t: Column) -> Column:
        body = F.trim(F.regexp_extract(t, NUMBERED, 2))
        return F.when((body != "") & is_loose_formula(body), F.struct(F.trim(F.regexp_extract(t, NUMBERED, 1)).alias("prefix"), tex(body).alias("formula")))

    return T.let(T.stripped(F.coalesce(line, F.lit(""))), read)
