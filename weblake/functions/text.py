"""Text analysis: tokens, phrases and highlighting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscores; a dot or an apostrophe between them joins.
TOKEN = r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*"


def tokens(text: Column) -> Column:
    """The lower-case tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def literal_tokens(text: str) -> list[str]:
    """The tokens of a query, as ``tokens`` gives them."""
    return re.findall(r"\w+(?:[.']\w+)*", text.lower())


def has_any_token(text: Column, query: str) -> Column:
    """Whether the text has any token of the query; a query without tokens matches nothing."""
    wanted = literal_tokens(query)
    return F.arrays_overlap(tokens(text), F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase's tokens stand next to each other in the text, in order."""
    wanted = literal_tokens(phrase)
    if not wanted:
        return F.lit(False)
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(f" {' '.join(wanted)} ")


def _any_of(wanted: list[str]) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])({'|'.join(map(re.escape, wanted))})(?![\p{{L}}\p{{N}}_])"


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text with the query's tokens marked."""
    wanted = literal_tokens(query)
    if not wanted:
        return text
    return F.regexp_replace(text, _any_of(wanted), f"{before}$1{after}")


def fragments(text: Column, query: str, around: int = 100, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The parts of the text around the query's tokens, ``around`` characters at either side at most, with the tokens marked."""
    wanted = literal_tokens(query)
    if not wanted:
        return F.array().cast("array<string>")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s).{{0,{around}}}?{_any_of(wanted)}.{{0,{around}}}"), F.lit(0))
    return F.transform(found, lambda part: highlight(part, query, before, after))
