"""Near-duplicate texts: banded MinHash candidates, checked by odd sketches, then exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.hashing import family, mix
from lexivane.session import cut


def shingle_sets(df: DataFrame, key: str, text: str, width: int, least_words: int) -> DataFrame:
    """key and the sorted distinct hashes (grams ARRAY<BIGINT>) of the sequences of width consecutive words of text.

    Words are the longest runs of a-z and 0-9 after lower-casing. Null texts and those with fewer than least_words
    (or width) words are left out. A word is its 64-bit hash, a sequence a mix of its words' hashes.
    """
    words = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(w))
    hashed = df.select(key, words.alias("w")).where(F.size("w") >= max(width, least_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            starts = lists.offsets.to_numpy().astype(np.int64)
            w = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            gram = np.zeros(max(len(w) - width + 1, 0), np.uint64)
            for i in range(width):
                gram = mix(gram ^ w[i : i + len(gram)])
            own = [np.unique(gram[a : z - width + 1].view(np.int64)) for a, z in zip(starts[:-1], starts[1:])]
            offsets = np.zeros(len(own) + 1, np.int32)
            np.cumsum([len(x) for x in own], out=offsets[1:])
            values = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "grams"])

    return hashed.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, grams array<bigint>")


def signatures(sets: DataFrame, key: str, bands: int, rows: int, samples: int, bits: int, seed: int = 7) -> DataFrame:
    """key, n (number of grams), held (non-empty samples), bands ARRAY<BIGINT>, sketch BINARY (bits in all).

    A band is a hash of rows MinHash values, one by each of bands * rows hash functions. The samples of the sketch come from one more
    function: its values are dealt to samples bins, and the least of each bin is a sample; a set of few grams leaves bins
    empty, and then nearly all of its grams are samples. A sample toggles the bit that its bin and value hash to. The bits in which
    two sketches differ tell in how many samples their sets do (see most_differing).
    """
    k = bands * rows
    factor, shift = family(k, seed), family(k, seed + 1)
    own = family(2, seed + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            starts = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[starts[0] : starts[-1]]
            starts -= starts[0]
            m = len(starts) - 1
            least = np.zeros((k, m), np.uint64)
            for i in range(k):
                h = values * factor[i] + shift[i]
                h ^= h >> np.uint64(32)
                h *= np.uint64(0x9E3779B97F4A7C15)
                least[i] = np.minimum.reduceat(h, starts[:-1]) if m else 0
            band = np.zeros((bands, m), np.uint64)
            for r in range(rows):
                band = mix(band ^ least[r * bands : (r + 1) * bands])
            # bins: by set and bin in order, the first value of each
            h = mix(values * own[0])
            of = np.repeat(np.arange(m, dtype=np.uint64), np.diff(starts))
            place = of * np.uint64(samples) + (h >> np.uint64(40)) % np.uint64(samples)
            order = np.lexsort((h, place))
            place, h = place[order], h[order]
            first = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
            place, h = place[first], h[first]
            of, bin_ = place // np.uint64(samples), place % np.uint64(samples)
            at = of * np.uint64(bits) + mix(h ^ mix(bin_ ^ own[1])) % np.uint64(bits)
            odd = (np.bincount(at.astype(np.int64), minlength=m * bits) & 1).astype(np.uint8)
            sketch = np.packbits(odd, bitorder="little").reshape(m, bits // 8)
            band_lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * bands + 1, bands, dtype=np.int32)), pa.array(np.ascontiguousarray(band.T).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.diff(starts).astype(np.int32)),
                    pa.array(np.bincount(of.astype(np.int64), minlength=m).astype(np.int32)),
                    band_lists,
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                ],
                names=[key, "n", "held", "bands", "sketch"],
            )

    spec = f"`{key}` {sets.schema[key].dataType.simpleString()}, n int, held int, bands array<bigint>, sketch binary"
    return sets.select(key, "grams").mapInArrow(run, spec)


def most_differing(threshold: float, samples: int, bits: int, n: np.ndarray, held: np.ndarray, deviations: float = 4.0) -> np.ndarray:
    """Bits in which two odd sketches may differ when the similarity of their sets is threshold, with so many standard deviations to spare.

    n and held: grams and samples of both sets together. At similarity t the sets have u = n / (1 + t) grams in all, which
    leave some of the samples bins empty; in a share t of the others both have the same sample, give or take a draw of as many of the u
    grams without putting back. The samples that differ toggle bits at random: of d, bits / 2 * (1 - (1 - 2 / bits)^d)
    come out odd. All deviations, as of independent causes, make one.
    """
    t = threshold
    u = n / (1 + t)
    empty = (1 - 1 / samples) ** u
    filled = samples * (1 - empty)
    filling = samples * empty + samples * (samples - 1) * (1 - 2 / samples) ** u - (samples * empty) ** 2
    draw = filled * t * (1 - t) * np.clip(1 - filled / np.maximum(u, 1), 0, 1)
    differ = np.maximum(held - 2 * t * filled, 0)
    even = (1 - 2 / bits) ** differ
    expected = bits / 2 * (1 - even)
    toggling = (bits + bits * (bits - 1) * (1 - 4 / bits) ** differ - (bits * even) ** 2) / 4
    # an agreement more or less is two samples that differ less or more
    variance = np.maximum(toggling, 0) + (2 * even) ** 2 * (draw + t**2 * np.maximum(filling, 0))
    return np.ceil(expected + deviations * np.sqrt(variance)).astype(np.int64)


def _sketches_agree(pairs: DataFrame, threshold: float, samples: int, bits: int) -> DataFrame:
    """class_a, class_b of the pairs (with n, held and sketch of both sides) whose sketches differ in few enough bits."""
    keep = ["class_a", "class_b"]
    ones = np.array([x.bit_count() for x in range(256)], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            a, z = (np.frombuffer(b"".join(col[f"sketch_{s}"].to_pylist()), np.uint8).reshape(b.num_rows, bits // 8) for s in "ab")
            differ = ones[a ^ z].sum(1, dtype=np.int64)
            n, held = (col[f"{c}_a"].to_numpy().astype(np.float64) + col[f"{c}_b"].to_numpy() for c in ("n", "held"))
            good = pa.array(differ <= most_differing(threshold, samples, bits, n, held))
            yield pa.RecordBatch.from_arrays([col[c].filter(good) for c in keep], names=keep)

    spec = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep)
    return pairs.select(*keep, *[f"{c}_{s}" for s in "ab" for c in ("n", "held", "sketch")]).mapInArrow(run, spec)


def _rare_parts(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, gram: of each set its rarest grams (rarest among sets), so many that two sets of the threshold's similarity share one of them.

    Of n grams, two such sets share at least threshold * n; in one order of all grams they so share one of the first
    n - ceil(threshold * n) + 1. What very many sets share comes last in the order and stays out.
    """
    flat = sets.select(key, F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    seen = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("sets"))
    ordered = flat.join(seen, "gram").groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("o"))
    wanted = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1
    return ordered.select(key, F.explode(F.slice("o", F.lit(1), wanted.cast("int"))).alias("x")).select(key, F.col("x.gram").alias("gram"))


def band_candidates(signed: DataFrame, sets: DataFrame, key: str, threshold: float, hot: int) -> DataFrame:
    """class_a < class_b, distinct: pairs of sets that agree in a band.

    A band value that more than hot sets have (boilerplate) isn't joined with itself: its sets are joined by their rarest grams
    instead, by which no pair of the threshold's similarity is lost (see _rare_parts).
    """

    def pairs(long: DataFrame, by: list[str]) -> DataFrame:
        a, b = (long.select(*by, F.col(key).alias(f"class_{s}")) for s in "ab")
        return a.join(b, by).where("class_a < class_b").select("class_a", "class_b")

    banded = signed.select(key, F.posexplode("bands").alias("band", "value"))
    sizes = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    busy = cut(sizes.where(F.col("n") > hot).select("band", "value"), "hot")
    shared = banded.join(sizes.where(F.col("n") <= hot).select("band", "value"), ["band", "value"], "left_semi")
    found = pairs(shared, ["band", "value"])
    if not busy.isEmpty():
        crowd = cut(sets.join(banded.join(busy, ["band", "value"], "left_semi").select(key).distinct(), key, "left_semi"), "crowd")
        found = found.unionByName(pairs(_rare_parts(crowd, key, threshold), ["gram"]))
    return found.distinct()


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    least_words: int = 0,
    bands: int = 32,
    rows: int = 3,
    samples: int = 512,
    bits: int = 1024,
    hot: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """Members (key, class_id) and pairs (class_a, class_b, similarity) of classes whose gram sets reach threshold.

    A class is all records with the same gram set, its id the lowest key; only one record a class is compared, so copies cost
    a row each, however many there are. Pairs of classes that agree in a band of MinHash values are candidates;
    those whose odd sketches, of samples MinHash samples in bits bits, differ in more bits than a pair at threshold would are dropped,
    and the others are compared by their whole gram sets, so no pair below threshold comes out. A pair at threshold t is missed
    with probability (1 - t^rows)^bands: 0.04 % at 0.6, far less above; the sketch drops less than 0.1 % of pairs at t.
    df: key (unique, not null) and text; other columns are ignored. Texts that are null or too short (see
    shingle_sets) are in no class. Ties, repeated rows of text and empty tables are no special cases.
    """
    sets = cut(shingle_sets(df, key, text, width, least_words), "grams")
    # grams are compared as a whole: by two hashes and their number
    identity = [F.xxhash64("grams").alias("h1"), F.xxhash64(F.size("grams"), F.reverse("grams")).alias("h2")]
    named = sets.select(key, *identity)
    classes = named.groupBy("h1", "h2").agg(F.min(key).alias("class_id"))
    members = cut(named.join(classes, ["h1", "h2"]).select(key, "class_id"), "members")
    whole = sets.join(members.where(F.col(key) == F.col("class_id")).select(key), key)
    signed = cut(signatures(whole, key, bands, rows, samples, bits), "signed")
    candidates = band_candidates(signed, whole, key, threshold, hot)
    for s in "ab":
        side = signed.select(F.col(key).alias(f"class_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "held", "sketch")])
        candidates = candidates.join(side, f"class_{s}")
    likely = _sketches_agree(candidates, threshold, samples, bits)
    both = likely.join(whole.select(F.col(key).alias("class_a"), F.col("grams").alias("grams_a")), "class_a").join(
        whole.select(F.col(key).alias("class_b"), F.col("grams").alias("grams_b")), "class_b"
    )
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    pairs = (
        both.select("class_a", "class_b", common.alias("common"), (F.size("grams_a") + F.size("grams_b") - common).alias("either"))
        .where(F.col("common") >= F.lit(threshold) * F.col("either") - F.lit(1e-9))
        .select("class_a", "class_b", (F.col("common") / F.col("either")).alias("similarity"))
    )
    return members, pairs


def record_pairs(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """rec_a < rec_b of all records that near_duplicates found alike, those of one class included."""
    a = members.select(F.col(key).alias("x"), F.col("class_id").alias("class_a"))
    b = members.select(F.col(key).alias("y"), F.col("class_id").alias("class_b"))
    across = pairs.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
    within = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y").select(F.col("x").alias("rec_a"), F.col("y").alias("rec_b"))
    return across.unionByName(within)
