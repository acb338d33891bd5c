"""Who may read what: policies as views of a frame; and names of columns as either side writes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVICE = "service"


@dataclass(frozen=True)
class Policy:
    """What a role may read: the rows where a condition holds, and, if columns are named, these only."""

    role: str
    rows: Column
    columns: tuple[str, ...] = ()


def readable(df: DataFrame, role: str, policies: list[Policy]) -> DataFrame:
    """df as a role sees it. The service sees all; others what any of their policies lets them, in the columns that all of these name; without a policy nothing.

    The conditions are ordinary filters, so they reach the scan, and columns that may not be read are not.
    """
    if role == SERVICE:
        return df
    own = [p for p in policies if p.role == role]
    hidden = {c for p in own if p.columns for c in df.columns if c not in p.columns}
    rows = F.lit(False)
    for p in own:
        rows = rows | F.coalesce(p.rows, F.lit(False))
    return df.filter(rows).select(*(c for c in df.columns if c not in hidden))


def of_token(df: DataFrame, id_col: str, token: str) -> DataFrame:
    """The rows of one list; whoever knows its id may read it. An unknown id is an error, as it is for a changed list."""
    rows = df.filter(F.col(id_col) == token)
    if rows.isEmpty():
        raise KeyError(f"no list {token}")
    return rows


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w[:1].upper() + w[1:] for w in rest)


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def renamed(df: DataFrame, how) -> DataFrame:
    """df with each column's name as how() writes it (camel or snake)."""
    return df.select(*(F.col(f"`{c}`").alias(how(c)) for c in df.columns))
