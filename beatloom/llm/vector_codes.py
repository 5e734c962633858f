"""Product codes of vectors: exact integer k-means on every part of a vector.

Components become integers, vectors are cut into equal consecutive parts, and
every part position has a codebook of its own, moved by a few rounds of
assignment and averaging.  Distances are exact: integers are broken into limbs
so narrow that no float64 BLAS product, nor any sum of them, reaches 2^53; the
limb products are put together in int64 (in whole Python numbers where a bound
on the components says that int64 could overflow), and the first least
distance wins.

Rows whose vector is null, or holds null or non-finite components, are
dropped.  A table's width is that of its least vector id whose width the number
of parts divides; rows of other widths stay, with null code and error.  Null
ids come last; rows with one id are ordered by their components, and each
counts.  Fewer rows than entries give as many entries as rows; an empty table
gives no rows.  An error beyond int64 is null.  Only the id, label and vector
columns are read.

Codebooks (parts x entries x part width) go to every task; sums of a task's
parts, as many numbers and no more, come back.  Labels are summed by key before
they meet the rows, so a label on a third of all rows costs one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.store import stored

FLOAT_EXACT = 53   # bits of whole numbers that float64 holds exactly
LONG_BITS = 62
SCALE = 256
SUM_BITS = 40
BLOCK = 512        # vectors assigned at once


# -- exact products ---------------------------------------------------------
def limb_bits(inner: int) -> int:
    """Widest limbs whose products, ``inner`` of them added, stay below 2^53."""
    return (FLOAT_EXACT - 1 - max(inner - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as float64 digits to the base 2^bits, lowest first; the top digit
    carries the sign."""
    top = max(int(abs(x).max()) if x.size else 0, 1)
    n = max(1, -(-top.bit_length() // bits))
    out, rest = [], x
    for _ in range(n - 1):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def _fits_long(a: np.ndarray, b: np.ndarray, inner: int) -> bool:
    """Whether squares, products and their sums over ``inner`` stay in int64."""
    top = max(int(abs(m).max()) if m.size else 0 for m in (a, b))
    return 2 * top.bit_length() + inner.bit_length() + 2 <= LONG_BITS


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer matrices (..., n, d) and (..., k, d), over d."""
    inner = a.shape[-1]
    whole = np.int64 if _fits_long(a, b, inner) else object
    bits = limb_bits(inner)
    total = None
    right = [np.swapaxes(m, -1, -2) for m in limbs(b, bits)]
    for i, left in enumerate(limbs(a, bits)):
        for j, r in enumerate(right):
            part = (left @ r).astype(np.int64)
            part = part.astype(whole) << (bits * (i + j)) if i + j else part.astype(whole)
            total = part if total is None else total + part
    return total


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry and squared distance of (positions, n, d) parts
    among (positions, entries, d) codebooks."""
    if not _fits_long(parts, books, parts.shape[-1]):
        parts, books = parts.astype(object), books.astype(object)
    far = (books * books).sum(axis=-1)[:, None, :] - 2 * dot(parts, books)
    first = far.argmin(axis=-1)
    least = np.take_along_axis(far, first[..., None], axis=-1)[..., 0]
    return first, least + (parts * parts).sum(axis=-1)


# -- rows -------------------------------------------------------------------
def _whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite float64, as int64 or, if larger, Python numbers."""
    if x.size == 0 or abs(x).max() < 2.0 ** (LONG_BITS - 9):
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([int(np.floor(v * SCALE)) if abs(v) < 2.0**53 else int(v) * SCALE for v in x], dtype=object)


def _narrow(v: np.ndarray) -> np.ndarray:
    if v.dtype == object and all(int(n).bit_length() < LONG_BITS for n in v):
        return v.astype(np.int64)
    return v


def _rows(values: pa.Array) -> list[np.ndarray | None]:
    """Integer vectors of a list column; None for rows that are dropped."""
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    null = values.is_null().to_numpy(zero_copy_only=False)
    ends = np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])[:len(ends)]
    finite = np.isfinite(x)
    bad = np.concatenate([[0], np.cumsum(~finite)])
    whole = _whole(np.where(finite, x, 0.0))
    return [_narrow(whole[a:b]) if k else None for a, b, k in zip(starts, ends, ~null & (bad[ends] == bad[starts]))]


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and the integer vector ``v`` (text where int64 could not
    hold the sums) of every row that is not dropped; ``width`` is its length."""
    narrow = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"))
    label = narrow.schema["label"].dataType.simpleString()

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(2))
            at = [i for i, r in enumerate(rows) if r is not None]
            small = [r if r.dtype != object else None for r in (rows[i] for i in at)]
            large = [[str(n) for n in r] if r.dtype == object else None for r in (rows[i] for i in at)]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(small, pa.list_(pa.int64())), pa.array(large, pa.list_(pa.string())),
                 pa.array([len(rows[i]) for i in at], pa.int32())],
                ["vec_id", "label", "v", "big", "width"])

    return narrow.mapInArrow(integers, f"vec_id long, label {label}, v array<long>, big array<string>, width int")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors of one width as the rows of a matrix."""
    v, big = batch.column("v"), batch.column("big")
    if big.null_count == len(big):
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    return np.array([[int(n) for n in (b or s)] for s, b in zip(v.to_pylist(), big.to_pylist())], dtype=object)


def _parts(matrix: np.ndarray, n_parts: int) -> np.ndarray:
    """(n, width) as (positions, n, part width)."""
    return np.ascontiguousarray(matrix.reshape(len(matrix), n_parts, -1).swapaxes(0, 1))


def _narrow_table(m: np.ndarray) -> np.ndarray:
    return m.astype(np.int64) if all(int(n).bit_length() < LONG_BITS for n in m.ravel()) else m


@dataclass(frozen=True)
class Codebooks:
    """Entries per part position, (positions, entries, part width); no entries
    where the table has no vector to begin with."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(n)) for n in self.entries.ravel()).encode()).hexdigest()

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, parts) of the rows of this width, a block at a time."""
        at = np.flatnonzero(batch.column("width").to_numpy() == self.width)
        for k in range(0, len(at), BLOCK):
            rows = pa.array(at[k:k + BLOCK])
            part = batch.take(rows)
            yield at[k:k + BLOCK], _parts(_matrix(part), self.entries.shape[0])


def first_books(rows: DataFrame, n_parts: int, n_entries: int) -> Codebooks | None:
    """Entries from the least ids; a fixed number of rows reaches the driver."""
    usable = rows.where((F.col("width") > 0) & (F.col("width") % n_parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v"), F.col("big")]
    head = usable.orderBy(*order).limit(1).collect()
    if not head:
        return None
    seeds = usable.where(F.col("width") == head[0]["width"]).orderBy(*order).limit(n_entries).collect()
    table = np.array([[int(n) for n in (r["big"] or r["v"])] for r in seeds], dtype=object)
    return Codebooks(_parts(_narrow_table(table), n_parts))


def _digits(n: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of ``n`` to the base 2^SUM_BITS, the top one with its sign:
    digits of many tasks add up in a long column."""
    place = 0
    while not -(1 << SUM_BITS) <= n < (1 << SUM_BITS):
        yield place, n & ((1 << SUM_BITS) - 1)
        n, place = n >> SUM_BITS, place + 1
    yield place, n


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: assign every part, then average what each entry was given."""
    n_parts, n_entries, d = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((n_parts, n_entries), dtype=np.int64)
        total = np.zeros(books.entries.shape, dtype=object)
        for batch in batches:
            for _, parts in books.blocks(batch):
                first, _ = nearest(parts, books.entries)
                for p in range(n_parts):
                    count[p] += np.bincount(first[p], minlength=n_entries)
                    block = np.zeros((n_entries, d), dtype=parts.dtype)
                    np.add.at(block, first[p], parts[p])
                    total[p] += block
        rows = [(p, e, -1, 0, int(count[p, e])) for p, e in zip(*np.nonzero(count))]
        rows += [(p, e, i, *digit) for p, e, *_ in rows for i in range(d) for digit in _digits(int(total[p, e, i]))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(5)], ["part", "entry", "at", "limb", "value"])

    given = rows.mapInArrow(sums, "part long, entry long, at long, limb long, value long")
    added = given.groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect()
    count = {(r["part"], r["entry"]): r["value"] for r in added if r["at"] < 0}  # as many rows as the codebooks have numbers
    total: dict[tuple, int] = {}
    for r in added:
        if r["at"] >= 0:
            key = (r["part"], r["entry"], r["at"])
            total[key] = total.get(key, 0) + (r["value"] << (SUM_BITS * r["limb"]))
    entries = books.entries.astype(object)
    for (p, e, i), t in total.items():
        entries[p, e, i] = t // count[p, e]
    return Codebooks(_narrow_table(entries))


def assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, ``code`` and ``error`` of every row."""
    label = rows.schema["label"].dataType.simpleString()
    hexed = np.array([f"{i:02x}" for i in range(books.entries.shape[1])])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            for at, parts in books.blocks(batch):
                first, far = nearest(parts, books.entries)
                for i, text, e in zip(at, hexed[first.T], far.sum(axis=0)):
                    code[i], error[i] = "".join(text), int(e) if int(e) < 1 << 63 else None
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(codes, f"vec_id long, label {label}, code string, error long")


def compress(
    vectors: DataFrame, n_parts: int = 16, n_entries: int = 64, rounds: int = 2,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error of every kept row, the codebooks behind them).

    At most 256 entries, two hex digits a part."""
    if not 0 < n_entries <= 256:
        raise ValueError("codes of two hex digits name 1 to 256 entries")
    rows = stored(kept(vectors, id_col, vector_col, label_col), "integers")
    books = first_books(rows, n_parts, n_entries)
    if books is None:
        nothing = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return nothing, None
    for _ in range(rounds):
        books = moved(rows, books)
    return stored(assigned(rows, books), "codes"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows with the same label, added up;
    nulls are one label."""
    added = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(stored(added, "labels"), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
