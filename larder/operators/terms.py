"""Which names contain which terms: a join on grams instead of all against all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: What may stand after a keyword that ends a compound, and white space.
PIECES = r"[\s·,\d.);!?]+"


def pieces(c: Column) -> Column:
    """The runs of letters of a text."""
    return F.filter(F.split(F.lower(c), PIECES), lambda p: p != "")


def first_piece(keyword: Column) -> Column:
    """The first run of letters; null without one."""
    return F.get(pieces(F.trim(keyword)), F.lit(0))


def piece_ends(name: Column) -> Column:
    """All starts and ends of a name's runs of letters, each once."""
    sizes = lambda p: F.sequence(F.lit(1), F.length(p))
    ends = lambda p: F.concat(F.transform(sizes(p), lambda n: F.left(p, n)), F.transform(sizes(p), lambda n: F.right(p, n)))
    return F.array_distinct(F.flatten(F.transform(pieces(name), ends)))


def grams(c: Column, n: int) -> Column:
    """All substrings of n characters."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda k: k + n - 1 <= F.length(c)), lambda k: F.substr(c, k, F.lit(n)))


def containing(names: DataFrame, terms: DataFrame, name: str, term: str) -> DataFrame:
    """Pairs (name, term) in which the name contains the term, without regard to case, each once; empty terms are in no name.

    A term meets the names that have its first three characters (all of it, if it is shorter). Both sides are taken once.
    """
    low = F.lower(F.col(name))
    keyed = terms.select(term).distinct().filter(F.length(term) > 0).withColumn("__key", F.left(F.lower(term), F.lit(GRAM)))
    keys = F.array_distinct(F.concat(*(grams(low, n) for n in range(1, GRAM + 1))))
    some = names.select(name).distinct().filter(F.col(name).isNotNull()).select(name, F.explode(keys).alias("__key"))
    return some.join(keyed, "__key").filter(F.contains(low, F.lower(F.col(term)))).select(name, term)
