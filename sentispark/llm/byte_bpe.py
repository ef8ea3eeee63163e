"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a model of the tokenizers library: bytes are written as
printable characters by the usual byte-to-character table, and every split of a token into two
known tokens is a merge at the token's rank, which is what merging by ranks does.

Texts are cut before each space that a non-space follows; a match of the pattern never crosses
such a place, so the pieces are encoded alone and each distinct piece of a task is encoded once.

Defined results: null text = empty text; an empty text has no ids; ids are packed as
little-endian unsigned 32-bit integers; unknown ids make ``decode`` fail.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.llm.common import give_back, giving_back, id_and_text, slices

_MEMO = 150_000  # remembered pieces of a task; then it starts afresh
_JOINED = 40  # pieces given to the library as one string
_SLICE = 4 << 20  # bytes of text encoded at a time
_SPACE_BEFORE_SPACE = re.compile(r" (?=\s|\Z)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


def model_of_ranks(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizers library's JSON for a rank file; built once, on the driver."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    name = {token: "".join(map(shown.__getitem__, token)) for token in ranks}
    merges = [
        (name[token[:i]], name[token[i:]])
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    vocabulary = {name[token]: rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocabulary, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer.to_str()


def cut_at_spaces(text: str) -> list[str]:
    """Pieces of ``text``, all but the first without the one space before them."""
    pieces = text.split(" ")
    if not _SPACE_BEFORE_SPACE.search(text):
        return pieces
    glued = pieces[:1]
    for piece in pieces[1:]:
        if piece and not piece[0].isspace():
            glued.append(piece)
        else:
            glued[-1] += " " + piece
    return glued


class PieceEncoder:
    """Ids of texts by a byte-level tokenizer; each distinct piece goes to the library once."""

    def __init__(self, tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.tokenizer = tokenizer
        names = tokenizer.get_vocab(with_added_tokens=False)
        # A token's name has a character per byte.
        self.widths = np.zeros(max(names.values(), default=-1) + 1, np.int64)
        for name, i in names.items():
            self.widths[i] = len(name)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.tokens = np.empty(0, "<u4")
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, strings: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return np.fromiter(itertools.chain.from_iterable(f.ids for f in found), "<u4")

    def numbers(self, pieces: list[str], join: bool) -> np.ndarray:
        """Where the memo has each piece. ``join``: the pieces may be encoded end to end."""
        missing = [p for p in dict.fromkeys(pieces) if p not in self.memo]
        step = _JOINED if join else 1
        for begin in range(0, len(missing), 50_000):
            some = missing[begin : begin + 50_000]
            ids = self._ids(["".join(some[i : i + step]) for i in range(0, len(some), step)])
            sizes = np.cumsum([len(p.encode()) for p in some])
            reached = np.cumsum(self.widths[ids])
            ends = np.where(sizes > 0, np.searchsorted(reached, sizes) + 1, 0) if len(ids) else 0 * sizes
            if len(ids) and not np.array_equal(reached[ends[ends > 0] - 1], sizes[sizes > 0]):
                raise ValueError("a token crosses the end of a piece")
            base, first = len(self.tokens), len(self.starts)
            begins = np.concatenate([[0], ends[:-1]])
            self.tokens = np.concatenate([self.tokens, ids])
            self.starts = np.concatenate([self.starts, base + begins])
            self.lengths = np.concatenate([self.lengths, ends - begins])
            self.memo.update(zip(some, range(first, first + len(some))))
        return np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where those of each text end."""
        if len(self.memo) > _MEMO:
            self._forget()
        cut = pc.split_pattern(texts, " ")
        bounds = np.asarray(cut.offsets, np.int64)
        bounds = bounds - bounds[0]
        coded = cut.flatten().dictionary_encode()
        index = np.asarray(coded.indices, np.int64)
        words = coded.dictionary.to_pylist()
        firsts = bounds[:-1]
        later = np.ones(len(index), bool)
        later[firsts] = False
        # After a space these are no piece of their own; their texts are cut one by one.
        odd = np.fromiter((not w or w[0].isspace() for w in words), bool, len(words))
        used = np.zeros(len(words), bool)
        used[index[later]] = True
        used &= ~odd
        where = np.full(len(words), -1, np.int64)
        where[used] = self.numbers([" " + words[i] for i in np.flatnonzero(used)], True)
        numbers = where[index]
        numbers[firsts] = self.numbers([words[i] for i in index[firsts]], False)
        if glued := sorted({*(np.searchsorted(bounds, np.flatnonzero(later & odd[index]), "right") - 1).tolist()}):
            parts = np.split(numbers, bounds[1:-1])
            for i in glued:
                first, *rest = cut_at_spaces(texts[i].as_py())
                parts[i] = np.concatenate([self.numbers([first], False), self.numbers([" " + r for r in rest], True)])
            bounds = np.cumsum([0, *map(len, parts)])
            numbers = np.concatenate(parts)
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        ids = self.tokens[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, ends[bounds[1:] - 1]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values that lie one after the other in ``data``, ended at the bytes ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _tokens_by_id(ranks: dict[bytes, int]) -> list[bytes | None]:
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the packed ids of every whole text; no special tokens."""
    model = docs.sparkSession.sparkContext.broadcast(model_of_ranks(ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encoder = PieceEncoder(Tokenizer.from_str(model.value))
        for part in slices(batches, "text", _SLICE):
            ids, ends = encoder.encode(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), _binary(ids, 4 * ends)], ["id", "ids"])
        del encoder
        give_back()

    return id_and_text(docs, key, text).mapInArrow(run, "id long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], key: str = "id", ids: str = "ids") -> DataFrame:
    """(id, ids, decoded): the bytes of the ids by the token table; null ids decode to null.

    A token may hold part of a character, so whole texts are joined as bytes; ``decoded_text``
    makes them text again.
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(_tokens_by_id(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = np.array([len(t or b"") for t in vocabulary.value], np.int64)
        begins = np.cumsum(widths) - widths
        letters = np.frombuffer(b"".join(t or b"" for t in vocabulary.value), np.uint8)
        for part in slices(batches, "ids", 4 << 20):
            packed = part.column(1)
            found = np.frombuffer(b"".join(x for x in packed.to_pylist() if x), "<u4")
            if (widths[found] == 0).any():
                raise ValueError("an id has no token")
            width = widths[found]
            ends = np.cumsum(width)
            data = letters[np.repeat(begins[found] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)]
            counts = np.cumsum(pc.binary_length(packed).fill_null(0).to_numpy(zero_copy_only=False)) // 4
            texts = _binary(data, np.concatenate([[0], ends])[counts])
            texts = pc.if_else(packed.is_valid(), texts, None)
            yield pa.RecordBatch.from_arrays([*part.columns, texts], ["id", "ids", "decoded"])

    rows = encoded.select(F.col(key).cast("long").alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(giving_back(run), "id long, ids binary, decoded binary")


def decoded_text(decoded: str):
    """Column of bytes as text; bytes of a cut character become replacement characters."""
    return F.expr(f"make_valid_utf8(cast({decoded} as string))")


def offsets(packed: bytes, table: list[bytes]) -> np.ndarray:
    """(start, end) of every token in characters of the text.

    A token that holds part of a character covers the whole character.
    """
    tokens = [table[i] for i in np.frombuffer(packed, "<u4").tolist()]
    data = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
    # Characters begun up to and with each byte; continuation bytes begin none.
    begun = np.cumsum((data & 0xC0) != 0x80)
    starts = np.concatenate([[0], ends[:-1]]) if len(tokens) else ends
    return np.stack([begun[starts] - 1, begun[ends - 1]], axis=1) if len(tokens) else np.empty((0, 2), np.int64)


def encode_with_offsets(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, ids array, starts array, ends array): ids and the characters that each covers."""
    table = docs.sparkSession.sparkContext.broadcast(_tokens_by_id(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids", 2 << 20):
            packed = part.column(1).to_pylist()
            spans = [offsets(p, table.value) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in packed], pa.list_(pa.int64())),
                    pa.array([s[:, 0] for s in spans], pa.list_(pa.int64())),
                    pa.array([s[:, 1] for s in spans], pa.list_(pa.int64())),
                ],
                ["id", "ids", "starts", "ends"],
            )

    return encode(docs, ranks, pattern, key, text).mapInArrow(
        run, "id long, ids array<long>, starts array<long>, ends array<long>"
    )
