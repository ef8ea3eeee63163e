"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with single spaces. An item may differ by an error budget, a
share of its length. Cut into budget + 1 pieces, at least one piece of an item within the budget is unchanged,
so exact hits of pieces (one automaton for all) find every place to look at. There the distance is verified
with Myers' bit-parallel algorithm over the item's whole length plus the budget on either side.

The items are a bounded table that every task gets; a larger one is searched in blocks of bounded size, each
against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.llm.common import giving_back, id_and_text, slices

ITEM_BYTES = 32 << 20  # items of a block
_GRAM = 5
_FOUND = "id long, item long, distance int, begin long, end long"


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, share: float) -> int:
    """Edits an item of ``length`` characters may have; one shorter than a dozen pieces' letters none."""
    return int(length * share) if length >= 40 else 0


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors`` + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(b, item[b:e]) for b, e in zip(cuts, cuts[1:])]


def best_match(masks: dict[str, int], length: int, text: str, errors: int) -> tuple[int, int] | None:
    """(distance, end) of the closest substring of ``text`` within ``errors`` edits, the first of equals; Myers 1999."""
    ones = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = ones, 0, length
    best = None
    get = masks.get
    for end, character in enumerate(text, 1):
        match = get(character, 0)
        vertical = match | minus
        horizontal = (((match & plus) + plus) ^ plus) | match
        up = minus | ~(horizontal | plus) & ones
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & ones, (down << 1) & ones
        plus = down | ~(vertical | up) & ones
        minus = up & vertical
        if score <= errors and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], share: float):
        import ahocorasick

        self.items = [(name, text, budget(len(text), share)) for name, text in items]
        self.masks: dict[int, dict[str, int]] = {}
        self.grams: dict[int, list[str]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces_of(text, errors):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def _masks(self, k: int) -> dict[str, int]:
        if k not in self.masks:
            masks: dict[str, int] = {}
            for at, character in enumerate(self.items[k][1]):
                masks[character] = masks.get(character, 0) | 1 << at
            self.masks[k] = masks
        return self.masks[k]

    def _may_match(self, k: int, window: str) -> bool:
        """An edit spoils at most ``_GRAM`` of the item's grams; the others must be in the window."""
        _, item, errors = self.items[k]
        if k not in self.grams:
            self.grams[k] = [item[i : i + _GRAM] for i in range(len(item) - _GRAM + 1)]
        least = len(self.grams[k]) - _GRAM * errors
        if least <= 0:
            return True
        there = {window[i : i + _GRAM] for i in range(len(window) - _GRAM + 1)}
        return sum(map(there.__contains__, self.grams[k])) >= least

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, begin, end) for every item in ``text`` (normalised), its closest place."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, found) in self.automaton.iter(text) if len(self.automaton) else ():
            for k, offset in found:
                _, item, errors = self.items[k]
                begin = last + 1 - size - offset - errors
                end = begin + len(item) + 2 * errors
                spans = windows.setdefault(k, [])
                # Hits come in the order of their ends, so nearly in that of their windows.
                if spans and begin <= spans[-1][1] and spans[-1][0] <= end:
                    spans[-1] = [min(spans[-1][0], begin), max(spans[-1][1], end)]
                else:
                    spans.append([begin, end])
        out = []
        for k, spans in windows.items():
            name, item, errors = self.items[k]
            best = None
            for begin, end in spans:
                begin, end = max(begin, 0), min(end, len(text))
                if end - begin < len(item) - errors:
                    continue
                if errors == 0:
                    at = text.find(item, begin, end)
                    # A short item counts as whole words only.
                    while at >= 0 and len(item) < 40 and (text[at - 1 : at].isalnum() or text[at + len(item) : at + len(item) + 1].isalnum()):
                        at = text.find(item, at + 1, end)
                    found = (0, at + len(item) - begin) if at >= 0 else None
                else:
                    window = text[begin:end]
                    found = best_match(self._masks(k), len(item), window, errors) if self._may_match(k, window) else None
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], begin + found[1])
            if best:
                out.append((name, best[0], max(0, best[1] - len(item)), best[1]))
        return out


def _search(rows: DataFrame, items: list[tuple[int, str]], share: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("distance", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, share)
        for piece in slices(batches, "text", 4 << 20):
            found = [
                (i, *match)
                for i, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())
                for match in matcher.matches(normalized(text))
            ]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return rows.mapInArrow(giving_back(run), _FOUND)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.1, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id, item, distance, begin, end) for each document and item that it holds within the budget.

    ``share``: edits allowed per character of the item, half of them at most; items under 40 characters must occur unchanged, as
    whole words. begin and end are character places in the normalised text (begin: the item's length before end). Null or
    empty texts and items match nothing; rows with a null id are matched all the same; repeated rows
    repeat their matches.
    """
    if not 0 <= share <= 0.5:
        raise ValueError("an item must keep half of its characters at least")
    rows = id_and_text(docs, key, text)
    tests = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    total = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // ITEM_BYTES))
    numbered = tests.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    searched = []
    for b in range(blocks):
        # At most about ITEM_BYTES reach the driver at once.
        items = [(r["item"], normalized(r["text"])) for r in numbered.where(F.col("block") == b).collect()]
        searched.append(_search(rows, sorted({x for x in items if x[1]}, key=str), share))
    return reduce(DataFrame.unionAll, searched)
