"""Built-in word weights for the offline scorer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRONG_POSITIVE = """
    love loved loves amazing excellent fantastic wonderful awesome outstanding perfect perfectly
    best brilliant superb exceptional incredible magnificent
"""
_POSITIVE = """
    good great nice happy glad enjoy enjoyed enjoys recommend recommended exceeded impressive
    impressed beautiful helpful win winning won fast reliable thanks thank pleased delighted fun
    easy better improved improving success successful bullish gain gains up value absolutely
"""
_NEGATIVE = """
    bad poor sad angry ugly slow broken broke fail failed fails failing disappointed disappointing
    disappointment problem problems wrong avoid returning returned annoying annoyed useless
    boring waste wasted lose losing lost loser worse fear bearish loss losses dumb stupid crash
    never
"""
_STRONG_NEGATIVE = """
    hate hated hates terrible horrible awful worst disgusting pathetic trash garbage scum idiot
    moron dreadful appalling nightmare disaster scam
"""

WEIGHTS: dict[str, int] = {
    **{w: 2 for w in _STRONG_POSITIVE.split()},
    **{w: 1 for w in _POSITIVE.split()},
    **{w: -1 for w in _NEGATIVE.split()},
    **{w: -2 for w in _STRONG_NEGATIVE.split()},
}


def _is_one_of(members: list[str]):
    return lambda word: word.isin(*members)


def lexicon_hits(words: Column, weights: dict[str, int] | None = None) -> Column:
    """The words that carry weight, repeats kept.

    The lexicon is a small fixed list, so it is compiled into one hash-set test on the tokens of
    the row itself: no join, no shuffle, no Python.
    """
    weights = WEIGHTS if weights is None else weights
    return F.filter(words, _is_one_of(sorted(w for w, v in weights.items() if v)))


def evidence(hits: Column, weights: dict[str, int] | None = None) -> tuple[Column, Column]:
    """Summed positive and negative weight of a row's lexicon hits."""
    weights = WEIGHTS if weights is None else weights
    positive, negative = F.lit(0), F.lit(0)
    for weight in sorted(set(weights.values()) - {0}):
        members = sorted(w for w, v in weights.items() if v == weight)
        count = F.size(F.filter(hits, _is_one_of(members))) * F.lit(abs(weight))
        if weight > 0:
            positive = positive + count
        else:
            negative = negative + count
    return positive, negative
