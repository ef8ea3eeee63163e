"""Document quality by co-training two views.

One classifier sees the words of a text, another the page's metadata (language, source, length, line layout and
kinds of characters). A bounded sample of labelled rows gives their first fit, their thresholds and calibration. In each round a
view labels every document of the corpus of which it is sure (sure: as exact on held-out labels as asked), and the other view learns
from all of them and from the labelled rows beyond the sample. At last each view is calibrated on the held-out rows and the
calibrated views are combined. Quality and toxicity are two such targets; a document's score is P(good) * (1 - P(toxic)).

The features of all documents are stored once. A round reads them where they lie and adds up, per target and class, the
documents of each word feature and the moments of the metadata; these sums give a naive Bayes classifier and a linear discriminant,
which a logistic regression on the labelled sample scales and corrects. Only the labelled sample's features and
the sums reach the driver; every document is scored where it lies, from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentispark.llm.common import discard, give_back, giving_back, slices, written
from sentispark.scale import join_per_key

_BITS = 17
_STEMS = (4, 5)  # letters of a word's beginning that are features too
_STRIP = ".,;:!?\"'()[]{}|&$%#*<>~^_-=+/\\"
_LEAST = 5  # rows a feature must be in
_LANGS, _SOURCES, _DENSE = 64, 1024, 14
_META = _LANGS + _SOURCES + _DENSE
#: Held-out share of the labelled sample, by hash of its order.
_HELD_OUT = 4
#: Rows in which the sums of a task are sent: ranges of word features, then the metadata of each target.
_RANGES = 32
_TARGETS = ("quality", "toxic")


@dataclass
class Target:
    """Weights of both views, their calibrations and their mix."""

    words: np.ndarray
    word_bias: float
    meta: np.ndarray
    meta_bias: float
    mix: tuple[float, float, float]


def _slots(words: pa.Array, size: int) -> np.ndarray:
    """Feature of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, size) & ((1 << _BITS) - 1) for w in words.to_pylist()), np.int64, len(words))


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature): the distinct hashed words of each text and their beginnings."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    names = pc.utf8_trim(coded.dictionary, characters=_STRIP)
    lengths = np.asarray(pc.utf8_length(names), np.int64)
    index = np.asarray(coded.indices, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets, np.int64)))
    pairs = []
    for size in (0, *_STEMS):
        # Few beginnings stand for many words.
        parts = (pc.utf8_slice_codeunits(names, 0, size) if size else names).dictionary_encode()
        table = np.where(lengths > size, _slots(parts.dictionary, size)[np.asarray(parts.indices)], -1) if len(names) else np.empty(0, np.int64)
        feature = table[index]
        pairs.append((owner << _BITS | feature)[feature >= 0])
    pairs = np.sort(np.concatenate(pairs))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    return pairs >> _BITS, pairs & ((1 << _BITS) - 1)


def meta_features(texts: list[str], langs: list, sources: list, sizes: list) -> np.ndarray:
    """Dense features of the page; one-hot places of language and source come first, as two indices."""
    out = np.zeros((len(texts), 2 + _DENSE))
    for row, (text, lang, source, size) in enumerate(zip(texts, langs, sources, sizes)):
        out[row, 0] = xxhash.xxh3_64_intdigest(str(lang)) % _LANGS
        out[row, 1] = _LANGS + xxhash.xxh3_64_intdigest(str(source)) % _SOURCES
        n = max(len(text), 1)
        data = np.frombuffer(text.encode(), np.uint8)
        counts = np.bincount(data, minlength=256)
        lines = text.split("\n")
        words = max(int(counts[32]) + len(lines), 1)
        sentences = text.split(". ")
        out[row, 2:] = (
            np.log1p(n),
            np.log1p(max(size or 0, 0)) - np.log1p(n),
            np.log1p(len(lines)),
            np.log1p(n / len(lines)),
            n / words / 10,
            counts[65:91].sum() / n,
            counts[48:58].sum() / n,
            (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n,
            (counts[[35, 36, 37, 38, 42]]).sum() / n,
            counts[124] / words,
            counts[33] / words,
            1 - len(set(lines)) / len(lines),
            1 - len(set(sentences)) / len(sentences),
            (counts[44] + counts[46]) / words,
        )
    return out


def _featured(rows: DataFrame) -> DataFrame:
    """(id, words, low, meta): packed features of every row; the first ``low`` words are below 2**16, the others at or above it."""
    schema = pa.schema([("id", pa.int64()), ("words", pa.binary()), ("low", pa.int32()), ("meta", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 4 << 20):
            owner, feature = word_features(piece.column("text"))
            cuts = np.searchsorted(owner, np.arange(1, piece.num_rows))
            low = np.bincount(owner[feature < 1 << 16], minlength=piece.num_rows)
            meta = meta_features(*(piece.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")))
            columns = [[x.tobytes() for x in np.split(feature.astype(np.uint16), cuts)], low.astype(np.int32), [m.tobytes() for m in meta]]
            yield pa.RecordBatch.from_arrays([piece.column("id"), *map(pa.array, columns)], schema=schema)
        give_back()

    return rows.mapInArrow(run, "id long, words binary, low int, meta binary")


def _unpacked(words: list[bytes], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of packed words."""
    sizes = np.array([len(w) // 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    feature = np.frombuffer(b"".join(words), np.uint16).astype(np.int32)
    feature[np.arange(len(feature)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= low[owner]] += 1 << 16
    return owner, feature


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, count: int, width: int, labels: np.ndarray, penalty: float = 1e-3, known: tuple[np.ndarray, float] | None = None
) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse (row, column, value) by full-batch Adam; ``known`` logits of the rows and a first bias are added to."""
    fixed, bias = known or (0.0, float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))))
    weights, mean, square = np.zeros(width), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, 201):
        miss = _sigmoid(np.bincount(rows, values * weights[columns], count) + fixed + bias) - labels
        slope = np.append(np.bincount(columns, values * miss[rows], width) / count + penalty * weights, miss.mean())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def _scaled(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Factor and bias that fit logits of an overconfident classifier to labels."""
    unit = float(logits.std()) + 1e-9
    factor, bias = _fit(np.arange(len(labels)), np.zeros(len(labels), np.int64), logits / unit, len(labels), 1, labels, 1e-4)
    return max(float(factor[0]), 0.0) / unit, bias


class _Sample:
    """Features of sampled rows, as sparse columns of either view."""

    def __init__(self, frame):
        self.count = len(frame)
        # Narrow, and without the features too rare to be used: the driver holds the whole sample.
        rows, words = _unpacked(frame["words"].tolist(), frame["low"].to_numpy(np.int32))
        common = (np.bincount(words, minlength=1 << _BITS) >= _LEAST)[words]
        self.word_rows, self.words = rows[common], words[common]
        self.meta = np.array([np.frombuffer(m) for m in frame["meta"]]).reshape(self.count, 2 + _DENSE)


def _surely_differs(inside: np.ndarray, outside: np.ndarray, ones: float, zeros: float) -> np.ndarray:
    """Features whose share differs between the classes beyond chance."""
    ones, zeros = max(ones, 1), max(zeros, 1)
    share = (inside + outside) / (ones + zeros)
    sure = np.abs(inside / ones - outside / zeros) / np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros) + 1e-12)
    sure[inside + outside < _LEAST] = 0
    return np.flatnonzero(sure > 4)


def _word_fit(sample: _Sample, rows: np.ndarray, labels: np.ndarray, sums: Sums | None) -> tuple[np.ndarray, float]:
    """Fit on the words whose share differs between the classes beyond chance, on top of what the sums say."""
    known, weights = None, np.zeros(1 << _BITS)
    if sums is not None and sums.counts.all():
        weights = _bayes(sums)
        logits = _word_logits(sample.word_rows, sample.words, weights, 0.0, sample.count)[rows]
        factor, bias = _scaled(logits, labels)
        weights *= factor
        known = factor * logits, bias
    place = np.full(sample.count, -1, np.int32)
    place[rows] = np.arange(len(rows), dtype=np.int32)
    used = place[sample.word_rows] >= 0
    at, words = place[sample.word_rows[used]], sample.words[used]
    del used
    inside = np.bincount(words, labels[at], 1 << _BITS)
    outside = np.bincount(words, minlength=1 << _BITS) - inside
    kept = _surely_differs(inside, outside, labels.sum(), len(labels) - labels.sum())
    slot = np.full(1 << _BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept), dtype=np.int32)
    mine = slot[words] >= 0
    at, words = at[mine], slot[words[mine]]
    found, bias = _fit(at, words, np.ones(len(at), np.float32), len(labels), len(kept), labels, known=known)
    weights[kept] += found
    return weights, bias


def _meta_fit(sample: _Sample, rows: np.ndarray, labels: np.ndarray, scale: np.ndarray, sums: Sums | None) -> tuple[np.ndarray, float]:
    known, weights = None, np.zeros(_META)
    if sums is not None and sums.meta_counts.all():
        weights = _discriminant(sums)
        logits = _meta_logits(sample.meta[rows], weights, 0.0, scale)
        factor, bias = _scaled(logits, labels)
        weights *= factor
        known = factor * logits, bias
    dense = sample.meta[rows]
    n = len(rows)
    at = np.concatenate([np.arange(n), np.arange(n), np.repeat(np.arange(n), _DENSE)])
    columns = np.concatenate([dense[:, 0].astype(np.int64), dense[:, 1].astype(np.int64), np.tile(np.arange(_LANGS + _SOURCES, _META), n)])
    values = np.concatenate([np.ones(2 * n), _rounded(dense, scale).ravel()])
    found, bias = _fit(at, columns, values, n, _META, labels, known=known)
    return weights + found, bias


def _rounded(meta: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled dense features, rounded so that sums of their products are exact in any order."""
    return np.round(np.clip((meta[:, 2:] - scale[0]) / scale[1], -64, 64) * 1024) / 1024


def _word_logits(rows, words, weights, bias, count) -> np.ndarray:
    out = np.full(count, float(bias))
    for begin in range(0, len(words), 1 << 20):
        some = weights[words[begin : begin + (1 << 20)]]
        used = some != 0
        out += np.bincount(rows[begin : begin + (1 << 20)][used], some[used], count)
    return out


def _meta_logits(meta: np.ndarray, weights: np.ndarray, bias: float, scale: np.ndarray) -> np.ndarray:
    return weights[meta[:, 0].astype(np.int64)] + weights[meta[:, 1].astype(np.int64)] + _rounded(meta, scale) @ weights[_LANGS + _SOURCES :] + bias


@dataclass
class Sums:
    """What one target's views learn from: documents of each word feature by class, and first and second moments of the metadata."""

    counts: np.ndarray  # documents by class
    words: np.ndarray  # (class, feature)
    meta_counts: np.ndarray
    first: np.ndarray  # (class, metadata feature)
    second: np.ndarray


def _bayes(sums: Sums) -> np.ndarray:
    """Naive Bayes weights of the words whose share differs between the classes beyond chance."""
    zeros, ones = sums.counts
    outside, inside = sums.words.astype(float)
    kept = _surely_differs(inside, outside, ones, zeros)
    weights = np.zeros(1 << _BITS)
    weights[kept] = np.log((inside[kept] + 1) / (ones + 2)) - np.log((outside[kept] + 1) / (zeros + 2))
    return weights


def _discriminant(sums: Sums) -> np.ndarray:
    """Weights of the linear discriminant of the metadata."""
    n = sums.meta_counts.sum()
    means = sums.first / sums.meta_counts[:, None]
    within = sums.second / n - (means.T * (sums.meta_counts / n)) @ means
    return np.linalg.solve(within + 1e-2 * np.eye(_META), means[1] - means[0])


_MOMENTS = (2, 2 * _META, _LANGS * _SOURCES, _LANGS * _DENSE, _SOURCES * _DENSE, _DENSE * _DENSE, 2)


def _moments(meta: np.ndarray, dense: np.ndarray, taught: np.ndarray) -> np.ndarray:
    """Packed moments of the rows whose class is 0 or 1."""
    mine = taught >= 0
    kind, dense = taught[mine].astype(np.int64), dense[mine]
    lang, source = meta[mine, 0].astype(np.int64), meta[mine, 1].astype(np.int64)
    first = np.zeros((2, _META))
    first += np.bincount(kind * _META + lang, minlength=2 * _META).reshape(2, _META) + np.bincount(kind * _META + source, minlength=2 * _META).reshape(2, _META)
    for k in (0, 1):
        first[k, _LANGS + _SOURCES :] = dense[kind == k].sum(axis=0)
    cross = np.bincount(lang * _SOURCES + source - _LANGS, minlength=_LANGS * _SOURCES)
    by_lang = np.stack([np.bincount(lang, d, _LANGS) for d in dense.T], axis=1)
    by_source = np.stack([np.bincount(source - _LANGS, d, _SOURCES) for d in dense.T], axis=1)
    return np.concatenate([np.bincount(kind, minlength=2), first.ravel(), cross, by_lang.ravel(), by_source.ravel(), (dense.T @ dense).ravel()]).astype(float)


def _sums(words: np.ndarray, packed: np.ndarray) -> Sums:
    meta_counts, first, cross, by_lang, by_source, dense, counts = np.split(packed, np.cumsum(_MOMENTS)[:-1])
    first = first.reshape(2, _META)
    second = np.zeros((_META, _META))
    langs, sources, rest = slice(_LANGS), slice(_LANGS, _LANGS + _SOURCES), slice(_LANGS + _SOURCES, _META)
    second[langs, sources], second[langs, rest], second[sources, rest] = cross.reshape(_LANGS, -1), by_lang.reshape(_LANGS, -1), by_source.reshape(_SOURCES, -1)
    second += second.T
    np.fill_diagonal(second, first.sum(axis=0))
    second[rest, rest] = dense.reshape(_DENSE, _DENSE)
    return Sums(counts, words, meta_counts, first, second)


def _learned(stored: DataFrame, views: list, limits: list, scale: np.ndarray, last: int) -> list[Sums]:
    """Sums over all documents: by their label, or else by what the other view is sure of. Held-out rows teach nothing.

    ``views``: (words, bias, meta, bias) of each target; ``limits``: of each target, those below and above which either view is sure.
    """
    shared = stored.sparkSession.sparkContext.broadcast((views, limits, scale, last))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, limits, scale, last = shared.value
        words = np.zeros((len(_TARGETS), 2, 1 << _BITS), np.int64)
        moments = np.zeros((len(_TARGETS), sum(_MOMENTS)))
        for piece in slices(batches, "words", 2 << 20):
            owner, feature = _unpacked(piece.column("words").to_pylist(), piece.column("low").to_numpy())
            meta = np.frombuffer(b"".join(piece.column("meta").to_pylist())).reshape(piece.num_rows, 2 + _DENSE)
            dense = _rounded(meta, scale)
            order = piece.column("order").fill_null(np.iinfo(np.int64).max).to_numpy()
            held = pc.is_valid(piece.column("order")).to_numpy(zero_copy_only=False) & (order <= last) & _held_out(order)
            for k, ((w, w_bias, m, m_bias), cuts) in enumerate(zip(views, limits)):
                label = piece.column(_TARGETS[k]).to_numpy(zero_copy_only=False).astype(float)
                taught = []
                for logits, (low, high) in zip((_word_logits(owner, feature, w, w_bias, piece.num_rows), _meta_logits(meta, m, m_bias, scale)), cuts):
                    sure = np.where(logits < low, 0, np.where(logits > high, 1, -1))
                    taught.append(np.where(np.isnan(label), sure, np.where(held, -1, label)).astype(np.int64))
                by_words, by_meta = taught
                moments[k, :-2] += _moments(meta, dense, by_words)
                moments[k, -2:] += np.bincount(by_meta[by_meta >= 0], minlength=2)
                kind = by_meta[owner]
                for c in (0, 1):
                    words[k, c] += np.bincount(feature[kind == c], minlength=1 << _BITS)
        for r, some in enumerate(np.split(words, _RANGES, axis=2)):
            yield pa.RecordBatch.from_pydict({"slot": pa.array([r], pa.int32()), "sums": [some.astype(float).tobytes()]})
        for k, some in enumerate(moments):
            yield pa.RecordBatch.from_pydict({"slot": pa.array([_RANGES + k], pa.int32()), "sums": [some.tobytes()]})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, packed in zip(*(c.to_pylist() for c in batch.columns)):
                found[slot] = found.get(slot, 0) + np.frombuffer(packed)
        for slot, some in found.items():
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "sums": [some.tobytes()]})

    slots = stored.mapInArrow(giving_back(sums), "slot int, sums binary").repartitionById(_RANGES + len(_TARGETS), "slot")
    found = {r["slot"]: np.frombuffer(r["sums"]) for r in slots.mapInArrow(total, "slot int, sums binary").collect()}
    shared.destroy()
    words = np.concatenate([found[r].reshape(len(_TARGETS), 2, -1) for r in range(_RANGES)], axis=2)
    return [_sums(words[k], found[_RANGES + k]) for k in range(len(_TARGETS))]


def _held_out(order: np.ndarray) -> np.ndarray:
    return (order >> 7) % _HELD_OUT == 0


def _sure(logits: np.ndarray, labels: np.ndarray, precision: float) -> tuple[float, float]:
    """Logits below and above which held-out rows are 0 and 1 with the precision asked."""
    order = np.argsort(logits)
    truth, ordered = labels[order], logits[order]
    n = np.arange(1, len(order) + 1)
    low = np.flatnonzero((np.cumsum(1 - truth) / n >= precision) & (n >= 30))
    high = np.flatnonzero((np.cumsum(truth[::-1]) / n >= precision) & (n >= 30))
    return ordered[low[-1]] if len(low) else -np.inf, ordered[::-1][high[-1]] if len(high) else np.inf


class _Learner:
    """One target: both views' fits on the labelled sample, and their calibration on its held-out rows."""

    def __init__(self, sample: _Sample, labels: np.ndarray, held: np.ndarray, scale: np.ndarray):
        known = ~np.isnan(labels)
        self.sample, self.labels, self.scale = sample, labels, scale
        self.train, self.test = np.flatnonzero(known & ~held), np.flatnonzero(known & held)

    def fit(self, sums: Sums | None = None) -> None:
        given = self.train, self.labels[self.train]
        self.words, self.word_bias = _word_fit(self.sample, *given, sums)
        self.meta, self.meta_bias = _meta_fit(self.sample, *given, self.scale, sums)
        self.logits = [
            _word_logits(self.sample.word_rows, self.sample.words, self.words, self.word_bias, self.sample.count),
            _meta_logits(self.sample.meta, self.meta, self.meta_bias, self.scale),
        ]

    def view(self) -> tuple:
        return self.words, self.word_bias, self.meta, self.meta_bias

    def limits(self, precision: float) -> list[tuple[float, float]]:
        return [_sure(logits[self.test], self.labels[self.test], precision) for logits in self.logits]

    def target(self) -> Target:
        """Calibrate and combine: a logistic regression of the held-out labels on both views' logits."""
        base = self.test if len(self.test) and 0 < self.labels[self.test].mean() < 1 else self.train
        mix, shift = np.array([0.5, 0.5]), 0.0
        if len(base):
            pair = np.clip(np.stack([x[base] for x in self.logits], axis=1), -15, 15)
            at = np.repeat(np.arange(len(base)), 2)
            mix, shift = _fit(at, np.tile([0, 1], len(base)), pair.ravel(), len(base), 2, self.labels[base], 1e-4)
            mix = np.maximum(mix, 0)
        return Target(self.words.astype(np.float32), self.word_bias, self.meta, self.meta_bias, (float(mix[0]), float(mix[1]), float(shift)))


@dataclass
class Model:
    scale: np.ndarray
    quality: Target
    toxic: Target


def _columns(docs: DataFrame) -> list:
    """Columns of the metadata view; those that are missing are null."""
    have = set(docs.columns)
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]


def train(docs: DataFrame, labels: DataFrame, labelled: int = 12000, unlabelled: int | None = None, rounds: int = 3, precision: float = 0.98) -> Model:
    """Train on at most ``labelled`` labelled rows on the driver, the first by hash of their ids, and on all other documents where they lie.

    With ``unlabelled`` the views label only so many other rows, the first by hash of their ids.
    ``labels`` has doc_id, quality (1 good) and toxic (1 toxic); null labels are left out, of several the
    worst counts. Without any labels every document scores as its prior, 1/2.
    """
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
    known = written(worst.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic", F.xxhash64("doc_id").alias("order")), "labels")
    last = known.orderBy("order").limit(labelled).agg(F.max("order")).first()[0]
    last = np.iinfo(np.int64).min if last is None else last
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text", *_columns(docs))
    # The texts are read once; the rounds read these features.
    stored = written(join_per_key(_featured(rows), known, "id", "left"), "features")
    frame = stored.where(F.col("order") <= last).select("quality", "toxic", "order", "words", "low", "meta").toPandas()
    frame = frame.sort_values(["order", "words", "meta"]).reset_index(drop=True)
    sample = _Sample(frame)
    held = _held_out(frame["order"].to_numpy().astype(np.int64))
    values = {c: frame[c].to_numpy(float) for c in _TARGETS}
    del frame
    dense = sample.meta[:, 2:] if sample.count else np.zeros((1, _DENSE))
    scale = np.stack([dense.mean(axis=0), dense.std(axis=0) + 1e-6])
    if np.isnan(values["quality"]).all():
        discard(known, stored)
        zero = Target(np.zeros(1 << _BITS, np.float32), 0.0, np.zeros(_META), 0.0, (0.0, 0.0, 0.0))
        return Model(scale, zero, zero)
    pool = stored
    if unlabelled is not None:
        others = stored.where("id IS NOT NULL AND order IS NULL").select("id").distinct().orderBy(F.xxhash64("id", F.lit(1))).limit(unlabelled)
        mine = F.col("order").isNotNull() | F.col("mine").isNotNull()
        pool = stored.join(F.broadcast(others.withColumn("mine", F.lit(True))), "id", "left").where(mine)
    learners = [_Learner(sample, values[c], held, scale) for c in _TARGETS]
    for x in learners:
        x.fit()
    for _ in range(rounds):
        found = _learned(pool, [x.view() for x in learners], [x.limits(precision) for x in learners], scale, last)
        for x, sums in zip(learners, found):
            x.fit(sums)
    discard(known, stored)
    return Model(scale, *(x.target() for x in learners))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, quality_p, toxic_p): every row of ``docs`` as a struct, its text in there only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    have = set(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(batch.column(0).field("text"), "")], ["row", "text"])

        for piece in slices(map(with_text, batches), "text", 4 << 20):
            n, row = piece.num_rows, piece.column("row")
            given = lambda c, kind: row.field(c).cast(kind).to_pylist() if c in have else [None] * n
            owner, feature = word_features(piece.column("text"))
            meta = meta_features(piece.column("text").to_pylist(), given("lang", pa.string()), given("source", pa.string()), given("n_chars", pa.int64()))
            found = []
            for t in (model.quality, model.toxic):
                a = _word_logits(owner, feature, t.words, t.word_bias, n)
                b = _meta_logits(meta, t.meta, t.meta_bias, model.scale)
                found.append(_sigmoid(t.mix[0] * np.clip(a, -15, 15) + t.mix[1] * np.clip(b, -15, 15) + t.mix[2]))
            yield pa.RecordBatch.from_arrays([row, pa.array(found[0]), pa.array(found[1])], ["row", "quality_p", "toxic_p"])
        give_back()

    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("quality_p", "double").add("toxic_p", "double"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_p, toxic_p and score = quality_p * (1 - toxic_p), from the whole texts.

    A null text is an empty one, null metadata are values of their own. Columns of ``docs`` stay, but for those that have one of
    the three names, which give way.
    """
    new = ("quality_p", "toxic_p", "score")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new]
    return _scored(docs, model).select(*own, "quality_p", "toxic_p", (F.col("quality_p") * (1 - F.col("toxic_p"))).alias("score"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The accepted rows of ``docs``, with just their own columns, whatever these are called."""
    return _scored(docs, model).where(accepted()).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def accepted(quality: float = 0.4, toxic: float = 0.3):
    """Whether a scored document stays: likely good, and not likely toxic."""
    return (F.col("quality_p") >= quality) & (F.col("toxic_p") < toxic)
