"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text is a sparse vector: its words hashed into WORDS buckets (log of one plus the count, scaled to
length 1) and one bucket for the bin of each statistic of its form and length. The machine has a
weight and a vector of RANK factors per bucket; all pairwise interactions are scored in linear time
as half of (sum of v x)^2 less the sum of (v x)^2. It learns in one task from a bounded sample of
labelled rows and scores every text. Only the text is an input of a score.

Defined cases: a NULL text is an empty one; empty texts get a score from their statistics. Labels
other than 0 and 1 are left out; of several labels of one id the smallest counts. NULL ids and
repeated rows get a result row each. Extra columns aren't read. An empty table gives no row; with no
labelled row every score is 0.5. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import with_id

WORDS = 1 << 14
BINS = 16
STATISTICS = ("length", "symbols", "capitals", "digits", "marks", "bars", "distinct", "repeated_lines", "word_length", "beyond_ascii")
BUCKETS = WORDS + BINS * len(STATISTICS)
RANK = 8

_UPPER, _DIGITS, _SYMBOLS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b".,!?;:"
_BEYOND = bytes(range(128, 256))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = found = zlib.crc32(word) % WORDS
        return found


_KNOWN = _Buckets()


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Bins of a text's statistics, each from 0 to BINS - 1."""
    n = max(1, len(text))
    share = lambda chars: (n - len(text.translate(None, chars))) / n if text else 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    tenths = lambda v: min(BINS - 1, int(v * BINS))
    return [
        min(BINS - 1, len(text).bit_length()),
        tenths(4 * share(_SYMBOLS)),
        tenths(share(_UPPER)),
        tenths(4 * share(_DIGITS)),
        tenths(4 * share(_MARKS)),
        tenths(8 * share(b"|")),
        tenths(distinct / max(1, len(words))),
        tenths(1 - len(set(lines)) / len(lines)) if lines else 0,
        min(BINS - 1, len(text) // max(1, len(words))),
        tenths(share(_BEYOND)),
    ]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text."""
    words = text.lower().split()
    idx, count = np.unique(np.fromiter(map(_KNOWN.__getitem__, words), np.int64, len(words)), return_counts=True)
    value = np.log1p(count)
    if len(value):
        value /= np.sqrt((value**2).sum())
    bins = statistics(text, words, len(set(words)))
    form = [WORDS + k * BINS + b for k, b in enumerate(bins)]
    return np.concatenate([idx, form]).astype(np.int64), np.concatenate([value, np.full(len(form), 0.5)])


class Machine:
    """Bias, weights and factors; sums(...) gives the raw score of rows laid end to end."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor

    @classmethod
    def fresh(cls, seed: int) -> "Machine":
        return cls(0.0, np.zeros(BUCKETS), np.random.default_rng(seed).normal(0, 0.05, (BUCKETS, RANK)))

    @classmethod
    def blank(cls) -> "Machine":
        """Every score is 0.5."""
        return cls(0.0, np.zeros(BUCKETS), np.zeros((BUCKETS, RANK)))

    def sums(self, idx: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, and the rows' sums of factors times values."""
        vx = self.factor[idx] * value[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (s**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weight[idx] * value, starts) + pairs, s

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.bias], self.weight, self.factor.ravel()]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Machine":
        a = np.frombuffer(data, "<f8")
        return cls(float(a[0]), a[1 : 1 + BUCKETS], a[1 + BUCKETS :].reshape(BUCKETS, RANK))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, passes: int = 12, batch: int = 128, rate: float = 0.15, decay: float = 1e-5) -> Machine:
    """Adaptive gradient descent on the logistic loss, in a fixed random order."""
    m, rng = Machine.fresh(seed), np.random.default_rng(seed)
    seen_w, seen_v, seen_b = np.full(BUCKETS, 1e-2), np.full((BUCKETS, RANK), 1e-2), 1e-2
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = [rows[i] for i in order[k : k + batch]]
            sizes = np.array([len(i) for i, _ in part])
            idx, value = np.concatenate([i for i, _ in part]), np.concatenate([v for _, v in part])
            z, s = m.sums(idx, value, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            g = (_sigmoid(z) - labels[order[k : k + batch]]) / len(part)
            each = np.repeat(g, sizes) * value
            used, place = np.unique(idx, return_inverse=True)
            gw = np.bincount(place, each) + decay * m.weight[used]
            inner = each[:, None] * (np.repeat(s, sizes, axis=0) - m.factor[idx] * value[:, None])
            gv = np.stack([np.bincount(place, inner[:, f]) for f in range(RANK)], axis=1) + decay * m.factor[used]
            seen_b += g.sum() ** 2
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            m.bias -= rate * g.sum() / np.sqrt(seen_b)
            m.weight[used] -= rate * gw / np.sqrt(seen_w[used])
            m.factor[used] -= rate * gv / np.sqrt(seen_v[used])
    return m


def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function of one task: (id, text, label) rows to one row with the machine."""
    found = sorted((d, features(t or b""), y) for b in batches for d, t, y in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True))
    m = fit([f for _, f, _ in found], np.array([y for _, _, y in found], float)) if found else Machine.blank()
    yield pa.RecordBatch.from_pydict({"machine": pa.array([m.to_bytes()], pa.binary())})


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a NULL id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", most_rows: int = 8000) -> Machine:
    """A machine from at most `most_rows` labelled rows that aren't held out, the first by a hash of the id."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    y = y.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    sample = texts.join(F.broadcast(y), "id").groupBy("id", "y").agg(F.min("t").alias("t"))  # at most most_rows ids: a bounded broadcast
    fitted = sample.select("id", "t", "y").coalesce(1).mapInArrow(fitting, "machine binary")
    found = fitted.collect()  # one row; none where there is no labelled row, as empty plans aren't run
    return Machine.from_bytes(bytes(found[0][0])) if found else Machine.blank()


def scoring(machine: bytes):
    """Arrow function: (id, text) rows to (id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.from_bytes(machine)
        for b in batches:
            texts, scores = b.column(1).cast(pa.binary()).to_pylist(), []
            for k in range(0, len(texts), 64):
                found = [features(t or b"") for t in texts[k : k + 64]]
                starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in found])[:-1]])
                scores.append(_sigmoid(m.sums(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts)[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[b.schema.names[0], "score"])

    return run


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, score and predicted (1 where score >= 0.5) of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    out = rows.mapInArrow(scoring(machine.to_bytes()), f"_id {dict(docs.dtypes)[id_col]}, score double")
    return with_id(out.select("_id", held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")), id_col)
