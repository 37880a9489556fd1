"""Dictionary sources: what a source has to say about itself, and the list of those that are known.

A source has a name, a place among sources (ties of score are listed in that order), pages that are asked one by one
(a language each, say), a fetch method for one term and a flatten method that turns raw responses into result rows.
register() adds one; lookups, federation, the command line and the service then know it.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DictSource:
    """Base of all sources. Subclasses set name and rank, and override fetch() and flatten()."""

    name = ""
    #: Place among sources of equal score; local results have 0.
    rank = 100
    needs_key = True
    #: What is asked for each term; an empty one where there is no choice.
    pages: tuple[str, ...] = ("",)
    #: Requests a second that one task sends at most, and tries for each request.
    rate, tries = 5.0, 3

    @property
    def key(self) -> str:
        return os.environ.get(f"LEXFORGE_{self.name.upper()}_KEY", "")

    @property
    def secret(self) -> str:
        return os.environ.get(f"LEXFORGE_{self.name.upper()}_SECRET", "")

    @property
    def available(self) -> bool:
        """Whether it can be asked: it has a key, or needs none."""
        return not self.needs_key or bool(self.key)

    def endpoint(self, page: str) -> str:
        """The name under which a fetcher is asked for a page."""
        return f"{self.name}-{page}" if page else self.name

    def fetch(self, term: str, page: str = "") -> str | None:
        """The raw response for a term, or None. Errors that a second try may mend are raised."""
        raise NotImplementedError

    def flatten(self, raw: DataFrame, limit: int) -> DataFrame:
        """Result rows of raw(query, lang, json); lang is the page."""
        raise NotImplementedError


_known: dict[str, DictSource] = {}


def register(source: DictSource) -> DictSource:
    """Make a source known; one of the same name is replaced."""
    if not source.name:
        raise ValueError("a source needs a name")
    _known[source.name] = source
    return source


def unregister(name: str) -> None:
    _known.pop(name, None)


def known() -> list[DictSource]:
    """All sources by rank, configured or not."""
    return sorted(_known.values(), key=lambda s: (s.rank, s.name))


def source(name: str) -> DictSource:
    if name not in _known:
        raise ValueError(f"unknown source: {name}")
    return _known[name]


def item(word: Column, kind: str, name: str, score: float, definition: Column) -> Column:
    """One result as a struct."""
    return F.struct(word.alias("word"), F.lit(kind).alias("type"), F.lit(name).alias("source"), F.lit(score).alias("score"), definition.alias("definition"))


def rows(df: DataFrame, items: Column, rank: int, block: int) -> DataFrame:
    """Result rows of an array of item()s in df(query, ...): their place in the block orders equal scores."""
    e = df.select("query", F.posexplode(items).alias("pos", "x"))
    fields = [F.col(f"x.{c}").alias(c) for c in ("word", "type", "source", "score", "definition")]
    return e.select("query", *fields, F.lit(rank).alias("source_rank"), (F.lit(block * 1_000_000).cast("long") + F.col("pos")).alias("ordinal"))
