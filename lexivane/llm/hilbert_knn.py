"""The k best partners of every sparse vector by inner product, from several shifted Hilbert orderings.

The token space is dealt to blocks by a hash. In each block a vector is projected to a point of the unit cube, the mean of its
tokens' random positions weighted by their squared weights, shifted for the block, and put in the order of a
Hilbert curve; vectors at the same place are ordered by weight. Vectors that share what weighs most in a block come to lie close on
its curve. Each vector is compared with its neighbours in a window on each of its curves, what neighbours share in the block adds
up over the curves, and the best candidates are ranked again by their whole inner products. Where more vectors lie close together
than windows show, as with near-copies, the best ones are reached over the lists: partners of partners
are scored as well, until no list changes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.packed import binary as _binary
from lexivane.functions.packed import numbers as _numbers
from lexivane.llm.hashing import mix
from lexivane.operators.search import exact_topk
from lexivane.session import cut

#: Tokens of a block that travel with a point: the heaviest ones; only the estimate depends on it.
CARRIED = 2
#: From this cosine on two vectors count as near-copies.
NEAR = 0.8
#: What travels with a point: what its record must find in kept blocks (see _points), the number of these, and the carried tokens.
POINT = np.dtype([("need", "<f4"), ("kept", "<i4"), ("t", "<i8", (CARRIED,)), ("w", "<f4", (CARRIED,))])
#: A neighbour of a point and what the two share in the block.
SHARED = np.dtype([("other", "<i8"), ("part", "<f4")])
_FALL = 16  # bits of the order by weight


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of points (n x d, integers below 2^bits, d * bits <= 63).

    From the highest bit on, the orientation of the sub-cube at hand is undone (exchange and inversion of axes), and the
    Gray code that is left is decoded; the bits of the axes are then interleaved.
    """
    kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint64
    x = np.ascontiguousarray(points.T.astype(kind))
    d, one = len(x), kind(1)
    for level in range(bits - 1, 0, -1):
        low = kind((1 << level) - 1)
        for axis in x:
            high = axis >> kind(level) & one
            mask = (high * low).astype(kind)  # low where the bit is set
            swap = (x[0] ^ axis) & (low ^ mask)
            axis ^= swap
            x[0] ^= swap | mask
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], kind)
    for level in range(bits - 1, 0, -1):
        flip ^= (x[-1] >> kind(level) & one) * kind((1 << level) - 1)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    step = 8  # bits interleaved by one look-up
    spread = sum(((np.arange(1 << step) >> i & 1) << (i * d) for i in range(step)), np.zeros(1 << step, np.int64))
    for at in range(0, bits, step):
        for i, axis in enumerate(x):
            out |= spread[axis >> kind(at) & kind(255)] << (at * d + d - 1 - i)
    return out


def _by_falling(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by group (below 2^31), then value (a FLOAT from 0 on) falling."""
    return np.argsort(group.astype(np.int64) << 32 | np.int64(0x7FFFFFFF) - value.astype(np.float32).view(np.int32), kind="stable")


class Curves:
    """The parameters of the orderings: passes times blocks curves of dims dimensions with bits bits each."""

    def __init__(self, passes: int = 1, blocks: int = 512, dims: int = 4, bits: int = 8, window: int = 32, kept: int = 16) -> None:
        self.passes, self.blocks, self.dims, self.bits, self.window, self.kept = passes, blocks, dims, bits, window, kept
        if (passes * blocks - 1).bit_length() + dims * bits + _FALL > 63 or window > 127:
            raise ValueError("a place on a curve must fit 63 bits, a step in a window 7")

    def block_of(self, token: np.ndarray, p: int) -> np.ndarray:
        return (mix(token ^ mix(np.array([101 + p]))) % np.uint64(self.blocks)).astype(np.int64)

    def restrict(self, rec: np.ndarray, token: np.ndarray, weight: np.ndarray, p: int) -> tuple[np.ndarray, ...]:
        """For each (record, block) with entries, in order: record, block, norm; and for each entry the number of its pair."""
        pair = rec * self.blocks + self.block_of(token, p)
        unique, of = np.unique(pair, return_inverse=True)
        return unique // self.blocks, unique % self.blocks, np.sqrt(np.bincount(of, weights=weight**2)), of

    def spots(self, token: np.ndarray, weight: np.ndarray, of: np.ndarray, block: np.ndarray, norm: np.ndarray, p: int) -> np.ndarray:
        """The sort key of each (record, block): curve, place on it, weight falling."""
        square, n = weight**2, len(block)
        total = np.bincount(of, weights=square, minlength=n)
        points = np.empty((n, self.dims))
        for axis in range(self.dims):
            seed = mix(np.array([1009 * (p + 1) + axis]))
            spot = (mix(token ^ seed) >> np.uint64(11)) / 2.0**53
            shift = (mix(block.astype(np.uint64) ^ mix(seed)) >> np.uint64(11)) / 2.0**53
            points[:, axis] = (np.bincount(of, weights=square * spot, minlength=n) / total + shift) % 1.0
        place = hilbert_index((points * (1 << self.bits)).astype(np.int64), self.bits)
        fall = (np.int64(0x7FFFFFFF) - norm.astype(np.float32).view(np.int32)) >> (31 - _FALL)
        return (((p * self.blocks + block) << (self.dims * self.bits)) | place) << _FALL | fall

    def curve(self, spot: np.ndarray) -> np.ndarray:
        return spot >> (self.dims * self.bits + _FALL)


def _entries(tokens: pa.Array, weights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and weight of each entry of packed vectors."""
    token, sizes = _numbers(tokens, np.uint64)
    return np.repeat(np.arange(len(sizes)), sizes), token, _numbers(weights, np.float32)[0].astype(np.float64)


def vector_classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, norm, tokens BINARY (64-bit hashes, sorted), weights BINARY (FLOAT, in their order), h1 and h2 (identity of the vector).

    Entries with a null, NaN or zero weight don't count; vectors without entries (null and empty ones) are left out.
    Negative weights are refused: the bounds of the search need weights from zero on. Packed as bytes, a vector costs the JVM no more than a string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy().astype(np.int64))
            names = b.column(1).flatten().dictionary_encode()
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in names.dictionary.to_pylist()], np.uint64)
            weight = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            of = np.repeat(np.arange(b.num_rows), sizes)
            real = ~np.isnan(weight) & (weight != 0)
            if (weight[real] < 0).any():
                raise ValueError("weights must not be negative")
            of, weight, token = of[real], weight[real], hashes[names.indices.to_numpy()[real]] if len(names) else np.zeros(0, np.uint64)
            order = np.lexsort((token, of))
            weight, token = weight[order], token[order]
            sizes = np.bincount(of, minlength=b.num_rows)
            norm = np.sqrt(np.bincount(of, weights=weight.astype(np.float64) ** 2, minlength=b.num_rows))
            filled = pa.array(sizes > 0)
            tokens, weights = _binary(token, sizes), _binary(weight, sizes)
            identity = np.array([(xxhash.xxh64_intdigest(t + w, 1), xxhash.xxh64_intdigest(w + t, 2)) for t, w in zip(tokens.to_pylist(), weights.to_pylist())], np.uint64).reshape(-1, 2)
            columns = [b.column(0), pa.array(norm), tokens, weights, *(pa.array(np.ascontiguousarray(identity[:, i]).view(np.int64)) for i in range(2))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "norm", "tokens", "weights", "h1", "h2"]).filter(filled)

    rows = df.where(F.size(vector) > 0).select(key, F.map_keys(vector), F.map_values(vector))
    return rows.mapInArrow(run, f"`{key}` long, norm double, tokens binary, weights binary, h1 long, h2 long")


def _largest_norms(vectors: DataFrame, curves: Curves) -> np.ndarray:
    """By pass and block, the largest norm of a vector's part in it: passes * blocks numbers, whatever the size of the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((curves.passes, curves.blocks))
        for b in batches:
            rec, token, weight = _entries(*b.columns)
            for p in range(curves.passes):
                _, block, norm, _ = curves.restrict(rec, token, weight, p)
                np.maximum.at(top[p], block, norm)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(top.size, dtype=np.int32)), pa.array(top.ravel())], names=["curve", "norm"])

    norms = vectors.select("tokens", "weights").mapInArrow(run, "curve int, norm double").groupBy("curve").agg(F.max("norm").alias("norm"))
    top = np.zeros(curves.passes * curves.blocks)
    for curve, norm in norms.collect():
        top[curve] = norm
    return top.reshape(curves.passes, curves.blocks)


def _points(vectors: DataFrame, key: str, curves: Curves, top: np.ndarray, min_score: float, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """part, spot, key and body (a POINT) of each record on each curve it is put on; part: between which of bounds (spot, key) it lies.

    A record leaves out its lightest blocks as long as what all of them could add to any score, by the largest
    norms, stays below a quarter of min_score. need is half of min_score less what it left out: what two records that reach
    min_score share in the blocks that both kept is at least the sum of their needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            rec, token, weight = _entries(*b.columns[1:])
            for p in range(curves.passes):
                owner, block, norm, of = curves.restrict(rec, token, weight, p)
                bound = norm * top[p][block]
                order = np.lexsort((bound, owner))
                summed = np.cumsum(bound[order])
                before = np.append(0.0, summed)[np.searchsorted(owner, np.arange(len(ids)))][owner[order]]
                keep = np.zeros(len(owner), bool)
                keep[order] = summed - before >= min_score / 4
                out = np.bincount(owner[~keep], weights=bound[~keep], minlength=len(ids))
                body = np.zeros(len(owner), POINT)
                body["need"] = (min_score / 2 - out)[owner] * (1 - 1e-6)  # less what rounding may add
                body["kept"] = np.bincount(owner[keep], minlength=len(ids))[owner]
                by = _by_falling(of, weight)
                rank = np.arange(len(by)) - np.searchsorted(of[by], of[by])
                for i in range(CARRIED):
                    at = by[rank == i]
                    body["t"][of[at], i], body["w"][of[at], i] = token[at].view(np.int64), weight[at]
                spot, own = curves.spots(token, weight, of, block, norm, p)[keep], ids[owner][keep]
                part = np.zeros(len(spot), np.int32)
                if bounds is not None:
                    part += np.searchsorted(bounds[0], spot, "left").astype(np.int32)
                    # places that many share are divided by the key
                    for i in np.flatnonzero(np.isin(spot, bounds[0])):
                        while part[i] < len(bounds[0]) and (bounds[0][part[i]], bounds[1][part[i]]) < (spot[i], own[i]):
                            part[i] += 1
                columns = [pa.array(part), pa.array(spot), pa.array(own), _binary(body[keep], np.ones(len(spot), np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "spot", key, "body"])

    return vectors.select(key, "tokens", "weights").mapInArrow(run, f"part int, spot long, `{key}` long, body binary")


def _bounds(vectors: DataFrame, key: str, curves: Curves, top: np.ndarray, min_score: float, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """parts - 1 (spot, key) that cut the order to parts of about the same size: quantiles of the points of some 40 records a part,
    those with the lowest hashes. They decide where the work is done, not what comes out."""
    share = min(1.0, 40.0 * parts / max(vectors.count(), 1))
    some = vectors.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    sampled = _points(some, key, curves, top, min_score).select("spot", key).toArrow()
    spot, own = (sampled.column(i).to_numpy() for i in range(2))
    order = np.lexsort((own, spot))[len(spot) // (2 * parts) :: max(1, len(spot) // parts)][: parts - 1] if len(spot) else np.zeros(0, int)
    return spot[order], own[order]


class Run:
    """Consecutive points of the order: spot, id and body."""

    def __init__(self, spot: np.ndarray, ids: np.ndarray, body: np.ndarray) -> None:
        self.spot, self.ids, self.body = spot, ids, body

    @classmethod
    def by_part(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Run]]:
        """part and its points, piece by piece, of batches in the order of part."""
        for b in batches:
            part = b.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            whole = cls(b.column(1).to_numpy(), b.column(2).to_numpy(), _numbers(b.column(3), POINT)[0])
            for a, z in zip(cuts[:-1], cuts[1:]):
                yield int(part[a]), whole[a:z]

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, part: slice) -> Run:
        return Run(self.spot[part], self.ids[part], self.body[part])

    @staticmethod
    def joined(runs: Sequence[Run]) -> Run:
        return runs[0] if len(runs) == 1 else Run(*(np.concatenate([getattr(r, f) for r in runs]) for f in ("spot", "ids", "body")))

    def lists(self, first: int, end: int, curves: Curves, stretch: np.ndarray | None = None) -> pa.RecordBatch:
        """own, pass and shared (SHARED each) of the points from first to end: their best neighbours at most a window away, on the
        same curve (and stretch of points without gaps, if given). What two carried tokens share stands for the block; a pair whose
        share is below (sum of needs) / (least number of kept blocks) is left to another block, as one of them must reach it."""
        curve = curves.curve(self.spot)
        token, weight = (np.ascontiguousarray(self.body[f].T) for f in "tw")
        need, kept = self.body["need"], self.body["kept"]
        keys, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = len(self)
        for step in range(1, min(curves.window, n - 1) + 1):
            lo, hi = max(first - step, 0), min(end, n - step)
            if hi <= lo:
                continue
            a, z = slice(lo, hi), slice(lo + step, hi + step)
            part = np.zeros(hi - lo, np.float32)
            for x in range(CARRIED):
                for y in range(CARRIED):
                    part += (token[x, a] == token[y, z]) * (weight[x, a] * weight[y, z])
            good = (part * np.minimum(kept[a], kept[z]) >= need[a] + need[z]) & (curve[a] == curve[z]) & (part > 0)
            if stretch is not None:
                good &= stretch[a] == stretch[z]
            i = np.flatnonzero(good)
            # point, part falling, step and side: no two are equal, so the order is the same however points come in batches
            fall, i = (np.int64(0x7FFFFFFF) - part[i].view(np.int32)) << 8 | 2 * step, i + lo
            keys += [i << 39 | fall, (i + step) << 39 | fall | 1]
            others += [i + step, i]
        key = np.concatenate(keys)
        order = np.argsort(key)
        key, to = key[order], np.concatenate(others)[order]
        at = key >> 39
        inside = (at >= first) & (at < end) & (np.arange(len(at)) - np.searchsorted(at, at) < curves.kept)
        key, at, to = key[inside], at[inside], to[inside]
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        shared = np.zeros(len(at), SHARED)
        shared["other"] = self.ids[to]
        shared["part"] = (np.int64(0x7FFFFFFF) - (key >> 8 & 0x7FFFFFFF)).astype(np.int32).view(np.float32)
        pass_ = (curve[at[heads]] // curves.blocks).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at[heads]]), pa.array(pass_), _binary(shared, np.diff(np.append(heads, len(at))))], names=["own", "pass", "shared"])


_LISTS = "own long, pass int, shared binary"


def _windows(ordered: DataFrame, curves: Curves) -> DataFrame:
    """The lists of all points (see Run.lists) of ordered: part, spot, key, body, each part in one partition, in order.

    A part gives the lists of its points but the first and last window ones, whose neighbours are partly elsewhere, and hands on
    twice a window of points at both its ends. These borders, some 6 KB a part whatever the size of the data, are taken
    together in their order by one task, which gives the other lists. So lists don't depend on where the order is cut.
    """
    w = curves.window

    def border(part: int, at: int, seen: int, run: Run) -> pa.RecordBatch:
        head = np.array([part, at, seen, len(run)], np.int64).tobytes()
        blob = head + run.spot.tobytes() + run.ids.tobytes() + run.body.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], names=["own", "pass", "shared"])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ends() -> Iterator[pa.RecordBatch]:
            yield border(current, 0, seen, head)
            if seen > 2 * w:
                yield border(current, max(seen - 2 * w, 2 * w), seen, held[-min(2 * w, seen - 2 * w) :])

        current, head, held, seen = None, None, None, 0
        for part, now in Run.by_part(batches):
            if part != current:
                if seen:
                    yield from ends()
                current, head, held, seen = part, now[:0], now[:0], 0
            if seen < 2 * w:
                head = Run.joined([head, now[: 2 * w - seen]])
            held = Run.joined([held, now])
            seen_before, seen = seen, seen + len(now)
            start = seen - len(held)  # the place of the first point held
            first = max(w, seen_before - w)
            if seen - w > first:
                yield held.lists(first - start, seen - w - start, curves)
            held = held[-2 * w :]
        if seen:
            yield from ends()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for b in batches:
            for blob in b.column(0).to_pylist():
                part, at, seen, n = np.frombuffer(blob, np.int64, 4)
                spot, ids = np.frombuffer(blob, np.int64, 2 * n, 32).reshape(2, n)
                blobs.append((part, at, seen, Run(spot, ids, np.frombuffer(blob, POINT, n, 32 + 16 * n))))
        if not blobs:
            return
        blobs.sort(key=lambda x: x[:2])
        stretch, edge, number, before = [], [], 0, None
        for part, at, seen, run in blobs:
            number += before is not None and before[0] == part and before[1] != at  # points are missing in between
            place = np.arange(at, at + len(run))
            stretch.append(np.full(len(run), number))
            edge.append((place < w) | (place >= seen - w))
            before = (part, at + len(run))
        whole, stretch, edge = Run.joined([x[3] for x in blobs]), np.concatenate(stretch), np.concatenate(edge)
        ends = np.flatnonzero(np.diff(np.concatenate([[0], edge.astype(np.int8), [0]])))
        for a, z in zip(ends[::2], ends[1::2]):
            lo, hi = max(a - w, 0), min(z + w, len(whole))
            yield whole[lo:hi].lists(a - lo, z - lo, curves, stretch[lo:hi])

    found = cut(ordered.mapInArrow(inner, _LISTS), "lists")
    return found.where("own is not null").unionByName(found.where("own is null").select("shared").coalesce(1).mapInArrow(across, _LISTS))


def _likely(lists: DataFrame, k: int) -> DataFrame:
    """a < b, distinct: of each record the k others that share most with it, added up over the curves of a pass, by the best pass.

    lists: the lists of its points; those of a record meet in one task as packed rows, at most kept partners a curve."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def best(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = []
        for b in held:
            shared, sizes = _numbers(b.column(2), SHARED)
            columns.append((np.repeat(b.column(0).to_numpy(), sizes), np.repeat(b.column(1).to_numpy(), sizes), shared["other"], shared["part"]))
        own, pass_, other, part = (np.concatenate(x) for x in zip(*columns))
        heads = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        at = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(own))))
        # sums are of whole numbers, so the order of arrival doesn't matter
        total = np.rint(np.minimum(part, 1e9) * 2.0**16).astype(np.int64)
        for both in (True, False):  # sums within a pass, then the best pass
            salt = mix(pass_.astype(np.uint64)) if both else np.uint64(0)
            key = at.astype(np.uint64) << np.uint64(44) | mix(other.view(np.uint64) ^ salt) >> np.uint64(20)
            order = np.argsort(key)
            first = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] ^ np.uint64(1)))
            total = (np.add if both else np.maximum).reduceat(total[order], first)
            at, pass_, other = at[order[first]], pass_[order[first]], other[order[first]]
            if not pass_.any():
                break
        order = np.lexsort((-total, at))
        least = total[order][np.minimum(np.searchsorted(at[order], np.arange(len(heads))) + k, np.searchsorted(at[order], np.arange(len(heads)), "right")) - 1]
        reach = total >= least[at]  # k a record, and what ties with the last of them
        at, other, total = at[reach], other[reach], total[reach]
        order = np.lexsort((other, -total, at))
        at, other = at[order], other[order]
        chosen = np.arange(len(at)) - np.searchsorted(at, at) < k
        own, other = own[heads][at[chosen]], other[chosen]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy()
            last = int(np.searchsorted(own, own[-1]))  # the last record's rows may go on
            if last:
                yield best([*held, b.slice(0, last)])
                held = []
            held.append(b.slice(last))
        if held:
            yield best(held)

    return lists.repartition(parts, "own").sortWithinPartitions("own").mapInArrow(run, "a long, b long").distinct()


def _scored(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """a, b, the whole inner product of each pair, added up in double precision, and whether they are near-copies."""
    both = pairs
    for s in "ab":
        side = vectors.select(F.col(key).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("norm", "tokens", "weights")])
        both = both.join(side.hint("shuffle_hash"), s)  # a row a key: the table a task builds is as large as its part of vectors

    def keys(row: np.ndarray, token: np.ndarray) -> np.ndarray:
        return row.astype(np.uint64) << np.uint64(47) | token >> np.uint64(17)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = dict(zip(b.schema.names, b.columns))
            score = np.zeros(b.num_rows)
            for lo in range(0, b.num_rows, 1 << 16):
                part = slice(lo, lo + (1 << 16))
                (ra, ta, wa), (rb, tb, wb) = (_entries(col[f"tokens_{s}"][part], col[f"weights_{s}"][part]) for s in "ab")
                at = np.minimum(np.searchsorted(keys(ra, ta), keys(rb, tb)), len(ra) - 1)
                same = (ta[at] == tb) & (ra[at] == rb)
                score[part] = np.bincount(rb[same], weights=wa[at[same]] * wb[same], minlength=len(col["a"][part]))
            near = score >= NEAR * col["norm_a"].to_numpy() * col["norm_b"].to_numpy()
            yield pa.RecordBatch.from_arrays([col["a"], col["b"], pa.array(score), pa.array(near)], names=["a", "b", "score", "near"])

    return both.mapInArrow(run, "a long, b long, score double, near boolean")


def _best(sides: DataFrame, k: int, wide: int) -> DataFrame:
    """The k best others of each record, and near-copies up to the place wide, with their rank."""
    ranked = sides.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= wide)
    return ranked.where(F.col("near") | (F.col("rank") <= k))


def _both(pairs: DataFrame) -> DataFrame:
    """own, other, score, near, fresh: a link from each to each."""
    ends = [F.struct(F.col(x).alias("own"), F.col(y).alias("other"), "score", "near", F.lit(True).alias("fresh")) for x, y in ("ab", "ba")]
    return pairs.select(F.explode(F.array(*ends)).alias("s")).select("s.*")


def _climbed(scored: DataFrame, vectors: DataFrame, key: str, k: int, wide: int, min_score: float) -> DataFrame:
    """own, other, score: the k best others of each record in scored (a, b, score, near), and over it.

    A round scores each record with the partners of its partners, as far as one of the two links is new and the norms allow a
    place in the list of either. Lists only get better, so rounds end; of a crowd, each multiplies what a record has
    seen. Near-copies, of which norms leave few to score, are followed beyond the k best.
    """
    norms = vectors.select(F.col(key).alias("own"), "norm")
    lists = cut(_best(_both(scored), k, wide), "lists")
    while not (fresh := lists.where("fresh")).isEmpty():
        least = lists.groupBy("own").agg(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("score"))), F.lit(min_score)).alias("least"))
        bounds = norms.join(least, "own")
        ends = [bounds.select(F.col("own").alias(x), F.col("norm").alias(f"norm_{x}"), F.col("least").alias(f"least_{x}")) for x in ("own", "other")]
        links = cut(lists.select("own", "other", "fresh").join(ends[0], "own").join(ends[1], "other"), "links")
        fresh = links.where("fresh")

        def steps(first: DataFrame, then: DataFrame) -> DataFrame:
            """own to other over a link of first and one of then, as far as the norms allow."""
            on = then.select(F.col("own").alias("via"), F.col("other").alias("to"), F.col("norm_other").alias("norm_to"), F.col("least_other").alias("least_to"))
            met = first.join(on, (F.col("other") == F.col("via")) & (F.col("own") != F.col("to")))
            fit = met.where(F.col("norm_own") * F.col("norm_to") * (1 + 1e-9) >= F.least("least_own", "least_to"))
            return fit.select(F.least("own", "to").alias("a"), F.greatest("own", "to").alias("b"))

        pairs = steps(fresh, links).unionByName(steps(links.where("not fresh"), fresh)).distinct()
        held = links.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        found = _scored(pairs.join(held, ["a", "b"], "left_anti"), vectors, key).where(F.col("score") >= min_score)
        lists = cut(_best(lists.drop("rank").withColumn("fresh", F.lit(False)).unionByName(_both(found)), k, wide), "lists")
    return lists.where(F.col("rank") <= k).select("own", "other", "score")


def best_partners(
    df: DataFrame, k: int = 5, min_score: float = 8.0, key: str = "rec_no", vector: str = "vector", curves: Curves | None = None, spare: int = 3
) -> DataFrame:
    """key, partners ARRAY<STRUCT<other, score>>: the k best other records of each record, score descending, then other.

    df: key (BIGINT, unique) and vector MAP<STRING, FLOAT>; other columns are ignored. Only scores from min_score
    (above 0) on count; a record without any has no row. Null and empty vectors have no list and are in none. Records with equal
    vectors are searched once, as one class, and take part in lists one by one, so copies cost a row each. Scores are exact
    inner products; lists may lack a partner that no window showed, or that the parts seen in windows put
    behind k + spare others, if it isn't a partner of their partners either. exact_partners gives the lists
    without loss, for as many records as are asked for.
    """
    if min_score <= 0:
        raise ValueError("min_score must be above 0")
    curves = curves or Curves()
    named = cut(vector_classes(df, key, vector), "vectors")
    classes = named.groupBy("h1", "h2").agg(F.min(key).alias("rep"))
    members = cut(named.select(key, "h1", "h2").join(classes, ["h1", "h2"]).select(key, "rep"), "classes")
    reps = members.where(F.col(key) == F.col("rep")).select(key)
    vectors = cut(named.select(key, "norm", "tokens", "weights").join(reps, key, "left_semi"), "distinct")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = _largest_norms(vectors, curves)
    points = _points(vectors, key, curves, top, min_score, _bounds(vectors, key, curves, top, min_score, parts))
    ordered = points.repartitionById(parts, "part").sortWithinPartitions("part", "spot", key)
    pairs = _likely(_windows(ordered, curves), k + spare)
    scored = cut(_scored(pairs, vectors, key).where(F.col("score") >= min_score), "scores")
    # of each class: scores with other classes, and with itself where it has several members
    own = vectors.select(F.col(key).alias("own"), F.col(key).alias("other"), (F.col("norm") * F.col("norm")).alias("score"))
    own = _scored(own.where(F.col("score") >= min_score * (1 - 1e-9)).select(F.col("own").alias("a"), F.col("own").alias("b")), vectors, key)
    own = own.where(F.col("score") >= min_score).select(F.col("a").alias("own"), F.col("b").alias("other"), "score")
    links = _climbed(scored, vectors, key, k, spare * k, min_score).unionByName(own)
    # only the k + 1 lowest members of a class can be in any list
    lowest = members.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(key))).where(F.col("rank") <= k + 1)
    offered = links.join(lowest.select(F.col("rep").alias("other"), F.col(key).alias("record")), "other").select("own", "record", "score")
    top = offered.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "record"))).where(F.col("rank") <= k + 1)
    lists = top.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("record").alias("other"), "score"))).alias("ranked"))
    return (
        members.join(lists, members["rep"] == lists["own"])
        .select(key, F.slice(F.filter("ranked", lambda x: x["other"] != F.col(key)), 1, k).alias("ranked"))
        .where(F.size("ranked") > 0)
        .select(key, F.transform("ranked", lambda x: F.struct(x["other"].alias("other"), x["score"].alias("score"))).alias("partners"))
    )


def partner_pairs(lists: DataFrame, key: str = "rec_no") -> DataFrame:
    """rec_a < rec_b, distinct: the pairs of which one is in the list of the other."""
    flat = lists.select(key, F.explode("partners.other").alias("other"))
    return flat.select(F.least(key, "other").alias("rec_a"), F.greatest(key, "other").alias("rec_b")).distinct()


def exact_partners(df: DataFrame, wanted: DataFrame, k: int = 5, min_score: float = 8.0, key: str = "rec_no", vector: str = "vector") -> DataFrame:
    """key, other, score, rank: the k best other records of each record of wanted (key and vector), without loss: in blocks of them against all of df."""
    asked = wanted.select(F.col(key).cast("string").alias("id"), vector)
    hits = exact_topk(df, asked, k + 1, key, vector).select(F.col("query_id").cast("long").alias(key), F.col("rec_no").alias("other"), "score")
    own = hits.where((F.col(key) != F.col("other")) & (F.col("score") >= min_score))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k)


def recall(lists: DataFrame, exact: DataFrame, key: str = "rec_no") -> DataFrame:
    """n_exact and n_found: the rows of exact (as exact_partners gives them), and how many of them are in lists (as best_partners gives them)."""
    found = lists.select(key, F.explode("partners.other").alias("other")).withColumn("hit", F.lit(1))
    return exact.join(found, [key, "other"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
