"""Secret scans: three fixed patterns, and character Markov models for what they miss.

The labelled samples: ordinary strings are all words and identifiers of the texts, that is runs of
token characters under TOKEN_LENGTH outside the patterns' matches; random strings are the values of
the patterns' matches and digests, random by construction, spelt in six alphabets. Longer runs outside
the matches are the candidates; they train nothing, so that a secret which stands in many files doesn't
hide itself. Each sample gives a first-order Markov model of the next token character, counted over all
texts; the random side is an even mixture of its models, so that a token answers to its own alphabet.

A token is cut at its separators (`+/_=-`) and the log-likelihood ratio is summed over its parts and
taken a pair of characters, so paths and long identifiers are judged as the words they hold and a UUID
as its digits. Parts without lower-case letters meet the ordinary model in lower case. A token is a
secret where the ratio of all its parts, or of one part of TOKEN_LENGTH, reaches `least_ratio`, and where
its pairs of characters hardly repeat, as those of a ruler or of filler do. The threshold is learnt: it
is the largest ratio where the share of missed random strings (of the alphabet that fares worst) and that
of ordinary strings taken for secrets weigh least, within 0.02. The ordinary strings for it are identifiers made of all distinct
words of the texts: words are dealt into groups of about N_WORDS by their hash, and each group sends how many identifiers have which ratio.

Defined cases: a NULL text is an empty one and has no span. NULL ids and repeated rows get a result
row each. Extra columns aren't read by the scan. An empty table gives no row; a sample without a
string gives a uniform model. Texts are scanned whole, in time that grows with their length and
number of spans.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import with_id
from tessera.sources.stored import stored

#: The kinds in the order that breaks ties, and their patterns (over UTF-8 bytes; all classes are ASCII).
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

TOKEN_LENGTH = 20
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(rb"[A-Za-z0-9]+")
WORD = re.compile(rb"[A-Za-z]{3,}")

#: Class of each byte: its place in the alphabet, or one beyond it outside tokens.
N_CLASSES = len(ALPHABET)
_CLASS = np.full(256, N_CLASSES, np.int64)
for _k, _c in enumerate(ALPHABET):
    _CLASS[_c] = _k

_HEX_ONLY = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_TOKEN_ONLY = bytes(116 if c in ALPHABET else 32 for c in range(256))

#: Number of digests that are spelt as random strings, of 64 bytes each, in each alphabet.
N_DIGESTS = 2000

#: Words that are put together to identifiers in one group, at least where the texts have as many.
N_WORDS = 1024

#: Alphabets of random strings by name.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "upper hex": DIGITS + "ABCDEF",
    "lower and digits": LOWER + DIGITS,
    "upper and digits": UPPER + DIGITS,
    "letters and digits": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
}


@dataclass(frozen=True)
class Span:
    """A secret in bytes: all of it, and from where its value stands."""

    kind: str
    start: int
    end: int
    value: int


def base_spans(text: bytes) -> list[Span]:
    """The patterns' matches, leftmost and not overlapping within a kind; those too short are dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [Span("assign", m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if b"AKIA" in text:
        out += [Span("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in text.translate(_HEX_ONLY):
        out += [Span("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return out


def _pairs(text: bytes) -> np.ndarray:
    """Counts of successive token characters, flat."""
    c = _CLASS[np.frombuffer(text, np.uint8)]
    both = (c[:-1] < N_CLASSES) & (c[1:] < N_CLASSES)
    return np.bincount((c[:-1] * N_CLASSES + c[1:])[both], minlength=N_CLASSES**2)


def _without(text: bytes, spans: list[Span]) -> bytes:
    """The text with blanks where spans and candidates stand."""
    if spans:
        kept = bytearray(text)
        for s in spans:
            kept[s.start : s.end] = b" " * (s.end - s.start)
        text = bytes(kept)
    return TOKEN.sub(b" ", text) if b"t" * TOKEN_LENGTH in text.translate(_TOKEN_ONLY) else text


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=7).digest(), "big")


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: texts to pair counts of one task, (label, pair, n), label 1 for matches' values; and the words, label 2."""
    totals, names = np.zeros((2, N_CLASSES**2), np.int64), ["label", "pair", "n", "word"]

    def add(held):
        nonlocal totals
        joined = [b" ".join(h) for h in held]
        totals += [_pairs(j) for j in joined]
        words = pa.array([w.decode() for w in set(WORD.findall(joined[0]))], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), 2)), pa.nulls(len(words), pa.int64()), pa.nulls(len(words), pa.int64()), words], names=names)

    for b in batches:
        held, size = ([], []), 0
        for text in b.column(0).cast(pa.binary()).to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            held[0].append(_without(text, spans))
            held[1].extend(text[s.value : s.end] for s in spans)
            size += len(text)
            if size >= 1 << 22:
                yield add(held)
                held, size = ([], []), 0
        yield add(held)
    label, pair = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(totals[label, pair]), pa.nulls(len(label), pa.string())], names=names)


def random_strings(alphabet: str, numbers: range, length: int) -> Iterator[bytes]:
    """Random strings by construction: SHA-512 digests of numbers as places in an alphabet."""
    letters = alphabet.encode()
    for k in numbers:
        n = int.from_bytes(hashlib.sha512(f"{k}:{alphabet}".encode()).digest(), "big")
        out = bytearray()
        for _ in range(length):
            n, at = divmod(n, len(letters))
            out.append(letters[at])
        yield bytes(out)


def ordinary_strings(words: list[str]) -> list[bytes]:
    """Identifiers of TOKEN_LENGTH and more made of words, in six spellings; the last one goes on with the first words."""
    out, run = [], []
    for n, w in enumerate(itertools.cycle(words)):
        if n >= len(words) and not run:
            break
        run.append(w.lower())
        if len("".join(run)) >= TOKEN_LENGTH:
            camel = "".join(x.title() for x in run)
            out += ["_".join(run), "-".join(run), "/".join(run), "_".join(run).upper(), camel, "".join(run)]
            run = []
    return [x.encode() for x in out]


@dataclass(frozen=True)
class Models:
    """Log-probabilities of the next character, of ordinary strings and of each kind of random ones, and the learnt threshold."""

    ordinary: np.ndarray
    random: np.ndarray
    least_ratio: float

    def _parts(self, token: bytes) -> list[tuple[int, np.ndarray, float]]:
        """Of each part: its pairs, their log-likelihood in each random model, and in the ordinary one."""
        out = []
        for m in PART.finditer(token):
            part = m[0]
            c = _CLASS[np.frombuffer(part, np.uint8)]
            low = c if any(97 <= x <= 122 for x in part) else _CLASS[np.frombuffer(part.lower(), np.uint8)]
            out.append((len(part) - 1, self.random[:, c[:-1], c[1:]].sum(axis=1), float(self.ordinary[low[:-1], low[1:]].sum())))
        return out

    def ratio(self, token: bytes) -> float:
        """Log-likelihood ratio a pair of random strings against ordinary ones: of all parts, or of the long part where it is largest."""
        parts = self._parts(token)
        whole = [(sum(p[0] for p in parts), sum((p[1] for p in parts), np.zeros(len(self.random))), sum(p[2] for p in parts))]
        long = [p for p in parts if p[0] + 1 >= TOKEN_LENGTH] if len(parts) > 1 else []
        return max((float(np.logaddexp.reduce(r)) - np.log(len(r)) - o) / n if n else -np.inf for n, r, o in whole + long)


def varied(token: bytes) -> bool:
    """Whether a token has half as many distinct pairs of characters as characters (64 count at most), and isn't mostly the alphabet in order."""
    in_order = sum(b - a == 1 for a, b in zip(token, token[1:], strict=False))
    return 2 * in_order < len(token) and 2 * len(set(zip(token, token[1:], strict=False))) >= min(len(token), 64)


def log_chances(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Log-probabilities of the next character from pair counts.

    A character's pairs are smoothed with those of all characters, weighed as `smoothing` a class, so
    that one which the sample lacks is followed by what is frequent in it; these are smoothed evenly.
    """
    counts = counts.reshape(N_CLASSES, N_CLASSES)
    each = (counts.sum(axis=0) + smoothing) / (counts.sum() + smoothing * N_CLASSES)
    weight = smoothing * N_CLASSES
    return np.log((counts + weight * each) / (counts.sum(axis=1, keepdims=True) + weight))


def ratios_of(models: Models, words: list[str]) -> Counter:
    """How many identifiers made of words have which ratio, in hundredths."""
    return Counter(round(100 * models.ratio(x)) for x in ordinary_strings(words))


def counting_ratios(models: Models):
    """Arrow function of one group of words: (ratio, n) of its identifiers."""

    def run(table: pa.Table) -> pa.Table:
        found = ratios_of(models, sorted(table.column("word").to_pylist(), key=lambda w: (_hash(w.encode()), w)))
        return pa.table({"ratio": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())})

    return run


def least_cost(models: Models, ordinary: dict[int, int], weight: float = 20.0, slack: float = 0.02) -> float:
    """The ratio of least cost: missed random strings (the worst alphabet's share) and `weight` times the share of ordinary ones at or above it.

    Ordinary strings come as their number by ratio in hundredths. Random strings are of TOKEN_LENGTH, the hardest, from digests that train nothing.
    Of ratios within `slack` of the least cost the largest is taken, as identifiers of other kinds than the texts' score above these.
    """
    random = [np.array([models.ratio(x) for x in random_strings(a, range(N_DIGESTS, N_DIGESTS + 400), TOKEN_LENGTH)]) for a in ALPHABETS.values()]
    ratio, n = (np.array([x[k] for x in sorted(ordinary.items())], np.int64) for k in (0, 1))
    tried = np.unique(np.concatenate([*(np.rint(100 * r).astype(np.int64) for r in random), ratio]))
    missed = np.max([(r[:, None] < tried / 100).mean(axis=0) for r in random], axis=0)
    above = np.concatenate([np.cumsum(n[::-1])[::-1], [0]])
    taken = above[np.searchsorted(ratio, tried)] / max(1, n.sum())
    cost = np.round(missed + weight * taken, 6)
    return float(tried[cost <= cost.min() + slack][-1] / 100)


def learnt_threshold(models: Models, words: list[str], weight: float = 20.0, slack: float = 0.02) -> float:
    """least_cost with the identifiers made of words."""
    return least_cost(models, ratios_of(models, words), weight, slack)


def train(docs: DataFrame, text: str = "text", smoothing: float = 0.5) -> Models:
    """Models from all texts, and the threshold from all their words.

    At most 2 * 67^2 sums and the number of identifiers by ratio in hundredths reach the driver, whatever the number of texts.
    """
    found = docs.select(F.col(text)).mapInArrow(counting, "label long, pair long, n long, word string")
    found = stored(found.groupBy("label", "pair", "word").agg(F.sum("n").alias("n")), "characters")
    totals = np.zeros((2, N_CLASSES**2))
    for label, pair, n in found.where("label < 2").select("label", "pair", "n").collect():
        totals[label, pair] = n
    spelt = [log_chances(_pairs(b" ".join(random_strings(a, range(N_DIGESTS), 64))), smoothing) for a in ALPHABETS.values()]
    models = Models(log_chances(totals[0], smoothing), np.array([log_chances(totals[1], smoothing), *spelt]), 0.0)
    words = found.where("label = 2").select("word")
    groups = max(1, words.count() // N_WORDS)
    ratios = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(groups))).applyInArrow(counting_ratios(models), "ratio long, n long")
    ordinary = {r.ratio: r.n for r in ratios.groupBy("ratio").agg(F.sum("n").alias("n")).collect()}
    return Models(models.ordinary, models.random, least_cost(models, ordinary))


def all_spans(text: bytes, models: Models, least_ratio: float | None = None) -> list[Span]:
    """The patterns' matches and the models' tokens, by start and then kind."""
    found = sorted(base_spans(text), key=lambda s: (s.start, KINDS.index(s.kind)))
    if b"t" * TOKEN_LENGTH not in text.translate(_TOKEN_ONLY):
        return found
    least = models.least_ratio if least_ratio is None else least_ratio
    more, k, reach = [], 0, 0  # reach: the furthest end of the matches that start before the token's end
    for m in TOKEN.finditer(text):
        while k < len(found) and found[k].start < m.end():
            reach = max(reach, found[k].end)
            k += 1
        if reach <= m.start() and varied(m[0]) and models.ratio(m[0]) >= least:
            more.append(Span("markov", m.start(), m.end(), m.start()))
    return sorted(found + more, key=lambda s: (s.start, KINDS.index(s.kind))) if more else found


def _in_points(text: bytes, spans: list[Span]) -> list[str]:
    """kind:start:end in code points."""
    if text.isascii():
        return [f"{s.kind}:{s.start}:{s.end}" for s in spans]
    # a code point begins at every byte that doesn't continue one
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [f"{s.kind}:{before[s.start]}:{before[s.end]}" for s in spans]


def scanning(models: Models, least_ratio: float | None):
    """Arrow function: (id, text) rows to counts and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                found = all_spans(text or b"", models, least_ratio)
                names = _in_points(text, found) if found else []
                n = Counter(s.kind for s in found)
                for k, kind in enumerate(KINDS):
                    counts[k].append(n[kind])
                base = ",".join(n for n in names if not n.startswith("markov"))
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join(names))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())],
                names=[b.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_ratio: float | None = None) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans and n_markov of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    out = f"_id {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
    return with_id(rows.mapInArrow(scanning(train(docs, text), least_ratio), out), id_col)


def redacted(text: bytes, spans: list[Span], mark: bytes) -> bytes:
    """The text with the values of its secrets replaced; overlapping values are one."""
    out, done = [], 0
    for a, z in sorted((s.value, s.end) for s in spans):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, z)
    return b"".join([*out, text[done:]])


def redacting(models: Models, least_ratio: float | None, mark: str, text: str):
    """Arrow function: the text column to the text without secrets, among the columns it came with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            texts = [t if not t else redacted(t, all_spans(t, models, least_ratio), mark.encode()) for t in b.column(at).cast(pa.binary()).to_pylist()]
            new = pa.array(texts, pa.binary()).cast(b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return run


def redact(docs: DataFrame, text: str = "text", least_ratio: float | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret's value replaced by a mark; all columns and rows stay."""
    return docs.mapInArrow(redacting(train(docs, text), least_ratio, mark, text), docs.schema)
