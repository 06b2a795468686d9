"""Near-duplicates by SimHash fingerprints, compared exactly in tiles.

A fingerprint's 64 bits fall into BLOCKS blocks; the population counts of the blocks name its tile.
Two fingerprints within the radius lie in tiles whose counts differ by the radius at most, summed
over the blocks, so only such tile pairs are compared: numpy exclusive-or and bit counts of every
pair in them. No link is missed. Tiles with many rows are compared in chunks. A task gives a
spanning forest of the links it finds, never all pairs of a group; the links' components follow.

Cost: the pairs compared grow with the square of the number of distinct fingerprints, lessened by
about 60 (for 4 blocks and evenly spread bits). Copies with one fingerprint count once.

Defined cases: a NULL or empty text, or one of separators only, has fingerprint zero and links like
any other. A text of one or two words is one shingle. NULL ids stand last: a component with no
other id has NULL. Repeated rows get a result row each. Extra columns aren't read; a key column that
has the name of a result column stands beside it. An empty table gives no row. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.components import components

BITS = 64


def _shingles(text: bytes, width: int) -> list[bytes]:
    words = text.lower().split()  # of bytes: A-Z only, and at blanks and controls 9 to 13
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def _votes(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes: bit k where over half of a run's hashes have it."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits((2 * ones > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[bytes | None], width: int = 3, seed: int = 42, at_once: int = 200_000) -> np.ndarray:
    """Fingerprints of texts (UTF-8), about `at_once` hashes at a time."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), "<u8")
    rows: list[int] = []
    runs: list[np.ndarray] = []

    def settle() -> None:
        if rows:
            counts = np.array([len(r) for r in runs])
            out[rows] = _votes(np.concatenate(runs), np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            rows.clear()
            runs.clear()

    held = 0
    for k, text in enumerate(texts):
        if text and (found := _shingles(text, width)):
            rows.append(k)
            runs.append(np.fromiter((digest(s, seed) for s in found), np.uint64, len(found)))
            held += len(found)
            if held >= at_once:
                settle()
                held = 0
    settle()
    return out


def fingerprinting(width: int, seed: int):
    """Arrow function: the text is the last column; gives the others and the fingerprint as a signed long `fp`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *names, _ = b.schema.names
            fp = fingerprints(b.column(b.num_columns - 1).cast(pa.binary()).to_pylist(), width, seed)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*names, "fp"])

    return run


def _block_counts(fp: Column, blocks: int) -> list[Column]:
    size = BITS // blocks
    return [F.bit_count(F.shiftrightunsigned(fp, k * size).bitwiseAND(F.lit((1 << size) - 1))) for k in range(blocks)]


def _tile(counts: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in counts:
        out = out * 256 + c
    return out


def _steps(blocks: int, radius: int) -> list[int]:
    """What is added to a tile's number to get the tiles within the radius: half of them, and 0 for itself."""
    near = [d for d in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, d)) <= radius]
    numbers = [sum(x * 256 ** (blocks - 1 - k) for k, x in enumerate(d)) for d in near]
    return sorted(n for n in numbers if n >= 0)


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between left and right that connect all that any links between them connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    links, step = [], max(1, (1 << 20) // max(1, len(left)))
    for k in range(0, len(right), step):
        part = right[k : k + step]
        at, to = np.nonzero(np.bitwise_count(np.bitwise_xor(left[:, None], part[None, :])) <= radius)
        for a, b in zip(left[at].tolist(), part[to].tolist(), strict=True):
            if a != b and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
                links.append((a, b))
    return links


def comparing(radius: int):
    """Arrow function of a chunk pair (fp, visits, ...): the links of residents and visitors."""

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        visits = table.column("visits").to_numpy(zero_copy_only=False)
        links = _forest(np.sort(fp[~visits]), np.sort(fp[visits]), radius)
        both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.Table.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = 2, blocks: int = 4, residents: int = 2048, visitors: int = 1 << 16) -> DataFrame:
    """Links u, v that connect all distinct fingerprints (column fp) within the radius, by tiles.

    A task compares about `residents` rows of a tile with about `visitors` rows of it and its lower
    neighbours. There are at most (64 / blocks + 1)^blocks tiles (83,521 for 4 blocks), which bounds
    the broadcast table of tile sizes.
    """
    steps = F.array(*[F.lit(s).cast("long") for s in _steps(blocks, radius)])
    reached = F.explode(F.transform(steps, lambda s: s + F.col("home")))
    tiled = distinct.select("fp", _tile(_block_counts(F.col("fp"), blocks)).alias("home"))
    sizes = stored(tiled.groupBy("home").agg(F.count("*").alias("n")), "tiles")
    reach = sizes.select(reached.alias("tile"), "n").groupBy("tile").agg(F.sum("n").alias("coming"))
    layout = sizes.withColumnRenamed("home", "tile").join(reach, "tile").select("tile", F.ceil(F.col("n") / residents).alias("rs"), F.ceil(F.col("coming") / visitors).alias("vs"))
    layout = F.broadcast(stored(layout, "tile-layout"))
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "fp"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    at_home = tiled.withColumnRenamed("home", "tile").join(layout, "tile").select("fp", F.lit(False).alias("visits"), "tile", part(F.col("rs"), 1).alias("r"), every(F.col("vs")).alias("v"))
    coming = tiled.select("fp", reached.alias("tile")).join(layout, "tile")
    coming = coming.select("fp", F.lit(True).alias("visits"), "tile", every(F.col("rs")).alias("r"), part(F.col("vs"), 2).alias("v"))
    return at_home.unionByName(coming).groupBy("tile", "r", "v").applyInArrow(comparing(radius), "u long, v long")


def near_duplicates(docs: DataFrame, keys: list[str], text: str = "text", id_col: str = "doc_id", radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """The key columns of every row with `fp` (signed long), `root` and `component_id`.

    root names the component: its smallest fingerprint, the row's own where nothing is linked to it.
    component_id is the smallest id_col that links reach, the row's own included; it doesn't tell
    components apart where ids are NULL or stand on several texts. id_col must be among keys.
    """
    names = [f"_key{k}" for k in range(len(keys))]  # whatever the columns' own names
    rows = docs.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_text").dtypes) + ", fp long"
    marked = stored(rows.mapInArrow(fingerprinting(width, seed), schema), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min(names[keys.index(id_col)]).alias("first_id")), "distinct-fingerprints")
    found = components(links(distinct, radius))
    grouped = stored(found.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "first_id"), "grouped")
    firsts = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = grouped.join(stored(firsts, "firsts"), "root").select("fp", "root", "component_id")
    # an unlinked fingerprint is a component of its own
    of_fp = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(stored(of_fp, "components"), "fp").select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
