"""Vectors as bytes, so that a vector costs the JVM no more than a string, and their products on numpy arrays.

A packed vector is a row with cs BINARY (components INT, ascending) and vs BINARY (values DOUBLE, in their order).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a score matrix that are held at a time, and matches of entries.
CELLS = 1 << 22

#: Components of a near product that are multiplied as a dense matrix, at most, and how many cells of it cost as much as a match of entries.
DENSE, CELLS_A_MATCH = 512, 400


def numbers(column: pa.Array | pa.ChunkedArray, dtype: str | np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column (without nulls), one row's after the other's, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    dtype = np.dtype(dtype)
    if not len(column):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer else np.zeros(0, np.uint8)
    return data.view(dtype), (np.diff(ends) // dtype.itemsize).astype(np.int64)


def binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Numbers as a binary column: sizes of them a row."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(np.asarray(sizes) * values.dtype.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def pack(long: DataFrame, key: str, component: str = "component", value: str = "w", by: tuple[str, ...] = ()) -> DataFrame:
    """by, key, cs, vs: a row for each vector of long (by, key, component, value)."""
    lists = long.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct(F.col(component).cast("int").alias("c"), F.col(value).cast("double").alias("v")))).alias("e"))
    names = [*by, key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(len(names))
            sizes = np.diff(e.offsets.to_numpy().astype(np.int64))
            c, v = e.flatten().flatten()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], binary(c.to_numpy(), sizes), binary(v.to_numpy(), sizes)], names=[*names, "cs", "vs"])

    spec = ", ".join(f"`{n}` {long.schema[n].dataType.simpleString()}" for n in names)
    return lists.mapInArrow(run, f"{spec}, cs binary, vs binary")


def pack_maps(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, cs (64-bit hashes of the tokens), vs: of each row of df with entries that have a weight. Repeated keys stay rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy().astype(np.int64))
            names = b.column(1).flatten().dictionary_encode()
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in names.dictionary.to_pylist()], np.uint64).view(np.int64)
            value = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            of = np.repeat(np.arange(b.num_rows), sizes)
            real = ~np.isnan(value)
            of, value, token = of[real], value[real], hashes[names.indices.to_numpy()[real]] if len(names) else np.zeros(0, np.int64)
            order = np.lexsort((token, of))
            sizes = np.bincount(of, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), binary(token[order], sizes), binary(value[order], sizes)], names=[key, "cs", "vs"])

    rows = df.where(F.size(vector) > 0).select(key, F.map_keys(vector), F.map_values(vector))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, cs binary, vs binary")


class Vectors:
    """Packed vectors as arrays: starts of the rows, components, values."""

    def __init__(self, starts: np.ndarray, components: np.ndarray, values: np.ndarray) -> None:
        self.starts, self.components, self.values = starts.astype(np.int64), components, values

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, component: type = np.int32) -> Vectors:
        components, sizes = numbers(table["cs"], component)
        return cls(np.append(0, np.cumsum(sizes)), components, numbers(table["vs"], np.float64)[0])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def take(self, rows: np.ndarray) -> Vectors:
        sizes = self.starts[rows + 1] - self.starts[rows]
        starts = np.append(0, np.cumsum(sizes))
        at = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Vectors(starts, self.components[at], self.values[at])

    def heaviest(self, cut: int) -> Vectors:
        """Each row's cut largest values; the lower component first among equals."""
        rows = self.rows()
        order = np.lexsort((self.components, -self.values, rows))
        keep = np.sort(order[np.arange(len(rows)) - self.starts[rows] < cut])
        return Vectors(np.append(0, np.cumsum(np.bincount(rows[keep], minlength=len(self)))), self.components[keep], self.values[keep])

    def products(self, others: Vectors) -> Iterator[tuple[slice, np.ndarray]]:
        """Inner products, as matrices of some of these rows (slice) with all others."""
        n = len(others)
        order = np.argsort(others.components, kind="stable")
        components, of, values = others.components[order], others.rows()[order], others.values[order]
        lo, hi = np.searchsorted(components, self.components, "left"), np.searchsorted(components, self.components, "right")
        matches = np.append(0, np.cumsum(hi - lo))[self.starts]
        a, step = 0, max(1, CELLS // max(n, 1))
        while a < len(self):
            z = min(a + step, len(self), max(a + 1, int(np.searchsorted(matches, matches[a] + CELLS, "right")) - 1))
            part = slice(self.starts[a], self.starts[z])
            size = (hi - lo)[part]
            at = np.repeat(lo[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rows = np.repeat(np.repeat(np.arange(z - a), np.diff(self.starts[a : z + 1])), size)
            product = np.bincount(rows * n + of[at], weights=np.repeat(self.values[part], size) * values[at], minlength=(z - a) * n)
            yield slice(a, z), product.astype(np.float64, copy=False).reshape(z - a, n)
            a = z

    def near(self, others: Vectors) -> Iterator[tuple[slice, np.ndarray, float]]:
        """Inner products as products gives them, but in single precision, of these rows scaled to length 1 with all others, divided by the
        greatest length among these; the last number bounds the error. Values must be finite. Components that many rows have are multiplied as
        dense matrices, the others match by match."""
        n, rows = len(others), self.rows()
        largest = np.zeros(len(self))
        np.maximum.at(largest, rows, np.abs(self.values))
        mine = self.values / np.where(largest > 0, largest, 1)[rows]
        length = np.sqrt(np.bincount(rows, weights=mine * mine, minlength=len(self)))
        mine = (mine / np.where(length > 0, length, 1)[rows]).astype(np.float32)
        theirs = others.values / (np.abs(others.values).max(initial=0) or 1)
        length = np.sqrt(np.bincount(others.rows(), weights=theirs * theirs, minlength=1).max(initial=0))
        theirs = (theirs / (length or 1)).astype(np.float32)
        names, of = np.unique(others.components, return_inverse=True)
        at = np.minimum(np.searchsorted(names, self.components), max(len(names) - 1, 0))
        met = names[at] == self.components if len(names) else np.zeros(len(at), bool)
        often = np.bincount(at[met], minlength=len(names)) * np.bincount(of, minlength=len(names))
        dense = np.argsort(-often, kind="stable")[:DENSE]
        dense = dense[often[dense] * CELLS_A_MATCH > len(self) * n]
        place = np.full(len(names) + 1, -1)
        place[dense] = np.arange(len(dense))
        held = place[of] >= 0
        right = np.zeros((len(dense), n), np.float32)
        right[place[of[held]], others.rows()[held]] = theirs[held]
        order = np.flatnonzero(~held)[np.argsort(of[~held], kind="stable")]
        rare, column, weight = of[order], others.rows()[order], theirs[order]
        at = np.where(met, at, len(names))
        mine_dense = place[at] >= 0
        lo, hi = np.searchsorted(rare, at, "left"), np.searchsorted(rare, at, "right")
        matches = np.append(0, np.cumsum(hi - lo))[self.starts]
        error = (len(dense) + int(np.diff(self.starts).max(initial=0)) + 8) * 2.0**-23
        a, step = 0, max(1, CELLS // max(n, len(dense), 1))
        while a < len(self):
            z = min(a + step, len(self), max(a + 1, int(np.searchsorted(matches, matches[a] + CELLS, "right")) - 1))
            part = slice(self.starts[a], self.starts[z])
            here = mine_dense[part]
            left = np.zeros((z - a, len(dense)), np.float32)
            left[rows[part][here] - a, place[at[part][here]]] = mine[part][here]
            product = left @ right
            size = (hi - lo)[part]
            if size.any():
                there = np.repeat(lo[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                np.add.at(product.reshape(-1), np.repeat((rows[part] - a) * n, size) + column[there], np.repeat(mine[part], size) * weight[there])
            yield slice(a, z), product, error
            a = z

    def dots(self, mine: np.ndarray, others: Vectors, theirs: np.ndarray) -> np.ndarray:
        """The inner product of each pair of a row of these and one of others, to the bit as products gives it: summed up by component."""
        keys = others.rows() << 32 | others.components
        out, step = np.zeros(len(mine)), 1 << 17
        for a in range(0, len(mine) if len(keys) else 0, step):
            rows, size = mine[a : a + step], np.diff(self.starts)[mine[a : a + step]]
            at = np.repeat(self.starts[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            wanted = np.repeat(theirs[a : a + step] << 32, size) | self.components[at]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            same = np.flatnonzero(keys[found] == wanted)
            out[a : a + step] = np.bincount(np.repeat(np.arange(len(rows)), size)[same], weights=self.values[at[same]] * others.values[found[same]], minlength=len(rows))
        return out

    def finite(self) -> bool:
        return bool(np.isfinite(self.values).all())

    def best(self, others: Vectors, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, column and inner product of each row's k best others, ties to the lower id, as best_of_rows finds them in products:
        near products tell which can be among them, and these are multiplied exactly."""
        if not (self.finite() and others.finite()):
            for part, score in self.products(others):
                row, col = best_of_rows(score, ids, k, np.ones(score.shape, bool))
                yield row + part.start, col, score[row, col]
            return
        for part, score, error in self.near(others):
            if score.shape[1] > k:
                least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                row, col = np.divmod(np.flatnonzero(score >= (least - np.float32(2.1 * error))[:, None]), score.shape[1])
            else:
                row, col = np.divmod(np.arange(score.size), score.shape[1])
            exact = self.dots(row + part.start, others, col)
            order = np.lexsort((ids[col], -exact, row))
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]  # row ascends, before and after it is ordered
            yield row[order] + part.start, col[order], exact[order]

    def touches(self, others: Vectors) -> Iterator[tuple[slice, np.ndarray]]:
        """Whether two rows share a component, in the form of products."""
        ones = Vectors(self.starts, self.components, np.ones(len(self.values)))
        for part, n in ones.products(Vectors(others.starts, others.components, np.ones(len(others.values)))):
            yield part, n > 0


def best_of_rows(score: np.ndarray, ids: np.ndarray, k: int, shown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best shown cells of each row, ties to the lower id."""
    held = np.where(shown, score, -np.inf)
    if held.shape[1] > 4 * k:
        floor = -np.partition(-held, k - 1, axis=1)[:, k - 1 : k]
        shown = shown & (held >= floor)
    row, col = np.nonzero(shown)
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]
