"""Text expressions that several operators share. All are built-in functions of Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() has it.
SPACE = r"(?U)[\s\x1c-\x1f\x85]+"
#: The year that ends an Act's name.
YEAR = r"\s+\d{4}$"


def tokens(text: Column) -> Column:
    """Lower-cased runs of anything but white space, punctuation kept; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda t: t != "")


def visible_length(text: Column) -> Column:
    """The number of characters that aren't white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f\x85]+|(?U)[\s\x1c-\x1f\x85]+\z", "")


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normal_act(name: Column) -> Column:
    """An Act's name without jurisdiction and "the", squashed and lower-cased."""
    out = F.regexp_replace(name, r"\((?:Cth|Vic|NSW|Qld|SA|WA|Tas|ACT|NT)\)", " ")
    return F.lower(squashed(F.regexp_replace(out, r"(?iU)\bthe\b", " ")))


def same_act(a: Column, b: Column) -> Column:
    """Equal normalised names, or equal but for a year that only one of them has."""
    bare = lambda x: F.regexp_replace(x, YEAR, "")
    one = F.regexp_like(a, F.lit(YEAR)) != F.regexp_like(b, F.lit(YEAR))
    return (a == b) | (one & (bare(a) == bare(b)))


def is_word(term: Column) -> Column:
    """Letters only, apart from inner apostrophes and typographic hyphens."""
    return F.regexp_like(term, F.lit("^(?U)[^\\W\\d_]+(?:['‐-―][^\\W\\d_]+)*$"))


def term_pattern(term: Column) -> Column:
    """A pattern for the whole phrase, plural too; case counts only if the term has capitals."""
    flags = F.when(term == F.lower(term), F.lit("(?iU)")).otherwise(F.lit("(?U)"))
    return F.concat(flags, F.lit(r"(?<![\w-])\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit(r"\Es?(?![\w-])"))


def document_matches(document: Column, act: Column) -> Column:
    """The document is the Act, or a volume of it."""
    return (document == act) | F.startswith(document, F.concat(act, F.lit("_")))
