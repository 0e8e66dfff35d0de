"""Near-duplicate records with small edits (problem 3).

Method. Word shingles of a record (by default single words, as the problem fixes them) get TF-IDF weights; document
frequencies are counted over all records into a fixed number of hash buckets. Improved consistent weighted sampling
draws ``bands * rows`` samples of each weighted set; the sampled word and its quantised weight, two integers, are the
signature. Signatures are banded, records that share a band are candidates, and every candidate pair is verified by its
weighted Jaccard similarity, with exact document frequencies, or, for the set form, by the share of its words. Equal bags (equal word sets in the set form)
are one class throughout: a class is one row in every band however many records it has, groups are formed of classes, and
classes are expanded to records only where pairs of records are the result that is asked for.

The samples of a (word, count) pair are drawn once per batch for all records that hold it; a record's signature is the
column minimum over its words.

Defined results: null, blank and repeated captions count as the words they hold; records with fewer than
``min_words`` distinct words take no part; records with a null id take no part; copies in the sense of problem 1
are never paired. The result doesn't depend on the partitioning. A pair at the threshold itself is in. Candidates
are never capped. Words are told apart by 32-bit hashes, so a similarity is that of the hashed words (two of the some
hundred words of a pair share a hash once in a million pairs); classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, spread
from .components import components
from .copies import fingerprint, learned_names, record_content

#: Bands and rows a band: a pair of weighted similarity s is a candidate with probability 1 - (1 - s**ROWS)**BANDS.
BANDS, ROWS = 28, 6
#: Hash buckets of the document frequencies; bounds what is collected and broadcast (4 bytes each).
DF_BITS = 20
#: Places of the bitmap that finds the words to be counted exactly; bounds what is collected and broadcast (2 MB).
SIEVE_BITS = 24
#: Words whose hash a worker remembers (bounds its memory, not its results).
REMEMBERED = 500_000
#: (word, count) pairs whose samples a worker holds at once; a batch with more is worked in parts, with the same result.
PAIRS_AT_ONCE = 1 << 16
#: Pairs that are sampled in one go, so that their arrays stay in the processor's cache.
AT_A_TIME = 256

_HAN = "々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U000323af"
_WORDS = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")
_ASCII = re.compile("[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """Longest runs of letters and digits in lower case, each Han character a word of its own."""
    text = text.lower()
    return (_ASCII if text.isascii() else _WORDS).findall(text)


def shingles(words: list[str], n: int) -> list[str]:
    return words if n == 1 else [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the ``shingles`` of a text from those of its words."""
    z = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        z += words[k : k + len(z)] * np.uint64((0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) | 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


_BAG = "record_id bigint, class bigint, copy bigint, words array<int>, times array<int>"


def bags(records: DataFrame, *, min_words: int = 32, n: int = 1, counted: bool = False) -> DataFrame:
    """Hashed shingles of every record with enough distinct words, its class and its copy fingerprint.

    ``counted``: a shingle counts as often as it stands, and records of a class hold all shingles equally often; else
    every shingle counts once.
    """
    shared = records.sparkSession.sparkContext.broadcast(learned_names(records))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            ids, classes, marks, flat, times, sizes = [], [], [], [], [], []
            for record, captions, description in zip(*(batch.column(k).to_pylist() for k in range(3))):
                said = words_of("\n".join([c for c in captions or () if c]))
                count = Counter(said)
                # words are what is asked for, whatever the shingles: 32 words in a row are but 28 shingles of five
                if len(count) < min_words or len(said) < n:
                    continue
                for w in count:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                if n == 1:
                    hashes = np.array([known[w] for w in count], np.uint64)
                    order = np.argsort(hashes)
                    hashes, often = hashes[order], np.fromiter(count.values(), np.int32, len(count))[order]
                else:
                    hashes, often = np.unique(window_hashes(np.array([known[w] for w in said], np.uint64), n), return_counts=True)
                ids.append(record)
                often = often.astype(np.int32) if counted else np.ones(len(hashes), np.int32)
                classes.append(xxhash.xxh3_64_intdigest(hashes.tobytes() + (often.tobytes() if counted else b"")))
                marks.append(fingerprint(record_content(captions, description, shared.value)) >> 64)
                flat.append(hashes.astype(np.uint32))
                times.append(often)
                sizes.append(len(hashes))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).view(t) if t == np.int32 else np.concatenate(x).astype(t))) if x else pa.array([], pa.list_(pa.from_numpy_dtype(t))) for x, t in ((flat, np.int32), (times, np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (classes, marks)), *lists],
                names=["record_id", "class", "copy", "words", "times"],
            )

    read = records.where(F.col("record_id").isNotNull()).select("record_id", "captions", "description")
    return spread(read).mapInArrow(run, _BAG)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _bucket(words: np.ndarray, bits: int) -> np.ndarray:
    return ((words.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


def document_frequencies(bag: DataFrame, bits: int = DF_BITS) -> tuple[int, np.ndarray]:
    """Number of records and records per word bucket, over all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            total += np.bincount(_bucket(_lists(batch.column(0))[0], bits), minlength=1 << bits)
            seen += batch.num_rows
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(total[there], seen))], names=["bucket", "n"])

    # as Arrow whatever the session says: shingles fill every bucket, and as many row objects are more than a driver holds
    rows = bag.select("words").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, count = (rows.column(k).to_numpy() for k in ("bucket", "n"))
    out = np.zeros(1 << bits, np.float32)
    inside = bucket >= 0
    out[bucket[inside]] = count[inside]
    return int(count[~inside].sum()), out


def word_weights(words: np.ndarray, times: np.ndarray, n: int, df: np.ndarray) -> np.ndarray:
    """Term count times the damped inverse document frequency."""
    known = np.maximum(df[_bucket(words, int(len(df)).bit_length() - 1)], 1)
    return times * np.sqrt(np.log1p(n / known))


def _uniform(key: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] from 64-bit keys (splitmix64)."""
    z = key + np.uint64(0x9E3779B97F4A7C15)
    y = z >> np.uint64(30)
    z ^= y
    z *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(z, np.uint64(27), out=y)
    z ^= y
    z *= np.uint64(0x94D049BB133111EB)
    z >>= np.uint64(40)
    u = z.astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2**-24)
    return u


def weighted_samples(words: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Improved consistent weighted sampling: hashed value (its logarithm) and quantised weight of each word for k samples."""
    base = (words.view(np.uint32).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None] + (np.arange(k, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[None, :]
    draw = [_uniform(base ^ np.uint64(salt * 0x8BB84B93962EACC9 & (2**64 - 1))) for salt in range(1, 6)]
    r, c, shift = draw[0], draw[2], draw[4]
    for x, y in ((r, draw[1]), (c, draw[3])):
        x *= y
        np.negative(np.log(x, out=x), out=x)
    t = np.log(weights).astype(np.float32)[:, None] / r
    t += shift
    np.floor(t, out=t)
    value = np.subtract(t, shift, out=shift)
    value += np.float32(1)
    value *= r
    return np.subtract(np.log(c, out=c), value, out=value), t.astype(np.int32)


def _drawn(pair: np.ndarray, n: int, df: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered value with the place of its pair in the low half, and quantised weight, of k samples of each (word, count) pair."""
    own = (pair >> 32).astype(np.int32)
    # value and place of a word in one integer, so that the least of them names the word
    least_of = np.empty((len(pair), k), np.int64)
    quantised = np.empty((len(pair), k), np.int32)
    weights = word_weights(own, pair & 0xFFFFFFFF, n, df)
    for a in range(0, len(pair), AT_A_TIME):
        some = own[a : a + AT_A_TIME]
        value, quantised[a : a + AT_A_TIME] = weighted_samples(some, weights[a : a + AT_A_TIME], k)
        order = value.view(np.int32)
        order ^= (order >> 31) & np.int32(0x7FFFFFFF)
        at = least_of[a : a + AT_A_TIME]
        at[:] = order
        at <<= 32
        at |= np.arange(a, a + len(some))[:, None]
    return least_of, quantised


def _signed(pair: np.ndarray, quantised: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Signatures of the samples that the pairs at these places have won: word and quantised weight."""
    word = (pair >> 32).astype(np.int32).view(np.uint32)[place]
    t = quantised[place, np.arange(quantised.shape[1])].view(np.uint32)
    return word * np.uint32(0x9E3779B1) ^ (t + np.uint32(1)) * np.uint32(0x85EBCA6B)


def signatures(words: np.ndarray, times: np.ndarray, offsets: np.ndarray, n: int, df: np.ndarray, k: int, most: int = PAIRS_AT_ONCE) -> np.ndarray:
    """Signatures (records x k) of the least samples of a batch of bags, ``most`` pairs at once."""
    pair, inverse = np.unique((words.astype(np.int64) << 32) | times.astype(np.int64), return_inverse=True)
    records = len(offsets) - 1
    if len(pair) > most and records > 1:
        m = min(max(int(np.searchsorted(offsets, offsets[-1] // 2)), 1), records - 1)
        at = offsets[m]
        return np.concatenate([signatures(words[:at], times[:at], offsets[: m + 1], n, df, k, most), signatures(words[at:], times[at:], offsets[m:] - at, n, df, k, most)])
    if len(pair) > most:  # one long record: the least of its parts, the earlier one of equals as within a part
        least, best = np.full(k, np.iinfo(np.int64).max), np.empty(k, np.uint32)
        for a in range(0, len(pair), most):
            least_of, quantised = _drawn(pair[a : a + most], n, df, k)
            low = least_of.min(0)
            less = low >> 32 < least
            least[less], best[less] = (low >> 32)[less], _signed(pair[a : a + most], quantised, low & 0xFFFFFFFF)[less]
        return best[None, :]
    least_of, quantised = _drawn(pair, n, df, k)
    out = np.empty((records, k), np.uint32)
    for a in range(0, records, 64):
        b = min(a + 64, records)
        part = inverse[offsets[a] : offsets[b]]
        place = np.minimum.reduceat(least_of[part], offsets[a:b] - offsets[a], axis=0) & 0xFFFFFFFF
        out[a:b] = _signed(pair, quantised, place)
    return out


def band_keys(words: np.ndarray, times: np.ndarray, offsets: np.ndarray, n: int, df: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (records x bands) of a batch of bags."""
    bits = signatures(words, times, offsets, n, df, bands * rows).reshape(-1, bands, rows)
    odd = (np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    keys = np.empty((len(bits), bands), np.int64)
    for a in range(0, len(bits), 64):
        z = (bits[a : a + 64].astype(np.uint64) * odd).sum(2, dtype=np.uint64) + salt
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        keys[a : a + 64] = (z ^ (z >> np.uint64(32))).view(np.int64)
    return keys


def candidate_classes(bag: DataFrame, n: int, df: np.ndarray, *, least_ratio: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(class_a, class_b)`` of classes sharing a band; ``least_ratio`` bounds the ratio of their sizes from below."""
    shared = bag.sparkSession.sparkContext.broadcast(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.sort(np.unique(batch.column(0).to_numpy(), return_index=True)[1])
            batch = batch.take(pa.array(first))
            words, offsets = _lists(batch.column(1))
            times, _ = _lists(batch.column(2))
            if len(offsets) < 2:
                continue
            keys = band_keys(words, times, offsets, n, shared.value, bands, rows)
            sizes = np.minimum(np.diff(offsets), 2**31 - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(np.repeat(sizes, bands))], names=["band", "class", "size"])

    # a class that many batches hold is one row of a band again where the rows of the band have met
    banded = bag.select("class", "words", "times").mapInArrow(run, "band bigint, class bigint, size int").repartition("band").dropDuplicates(["band", "class"])
    a, b = banded.alias("a"), banded.alias("b")
    fits = (F.col("a.band") == F.col("b.band")) & (F.col("a.class") < F.col("b.class")) & (F.col("a.size") >= least_ratio * F.col("b.size")) & (F.col("b.size") >= least_ratio * F.col("a.size"))
    return a.join(b, fits).select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b")).distinct()


def _overlap(wa: pa.Array, xa: np.ndarray, wb: pa.Array, xb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common words, words of both sides, common weight and weight of both sides of aligned pairs of bags."""
    (w1, o1), (w2, o2) = _lists(wa), _lists(wb)
    rows = len(o1) - 1
    pair = np.concatenate([np.repeat(np.arange(rows), np.diff(o1)), np.repeat(np.arange(rows), np.diff(o2))])
    key = (pair << 32) | np.concatenate([w1, w2]).view(np.uint32).astype(np.int64)
    weight = np.concatenate([xa, xb])
    order = np.argsort(key, kind="stable")
    key, weight, pair = key[order], weight[order], pair[order]
    twice = np.flatnonzero(key[1:] == key[:-1])
    both = np.bincount(pair[twice], minlength=rows)
    low = np.bincount(pair[twice], np.minimum(weight[twice], weight[twice + 1]), minlength=rows)
    return both, np.bincount(pair, minlength=rows), low, np.bincount(pair, weight, minlength=rows)


def similarities(wa: pa.Array, ta: pa.Array, wb: pa.Array, tb: pa.Array, n: int, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set and weighted Jaccard similarity of aligned pairs of bags."""
    both, every, low, mass = _overlap(wa, word_weights(_lists(wa)[0], _lists(ta)[0], n, df), wb, word_weights(_lists(wb)[0], _lists(tb)[0], n, df))
    return both / np.maximum(every - both, 1), low / np.maximum(mass - low, 1e-30)


def word_counts(bag: DataFrame, words: DataFrame) -> DataFrame:
    """``(word, n)``: the exact number of records that hold each of the distinct ``words``."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            there[_bucket(batch.column(0).to_numpy(), SIEVE_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(there).astype(np.int32))], names=["place"])

    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[words.mapInArrow(places, "place int").distinct().toArrow().column("place").to_numpy()] = True
    shared = bag.sparkSession.sparkContext.broadcast(np.packbits(sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            flat, _ = _lists(batch.column(0))
            word, n = np.unique(flat[wanted[_bucket(flat, SIEVE_BITS)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    # the sieve lets some others through, which nothing is joined to
    return bag.select("words").mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def heavy_classes(content: DataFrame, bag: DataFrame, pairs: DataFrame, n: int, df: np.ndarray, *, threshold: float) -> DataFrame:
    """``(class_a, class_b, similarity)`` of the candidates that reach a weighted similarity by exact document frequencies.

    A bucket has at least the records of each of its words, so bucketed counts bound the weights from below; a shared word
    stands in two records at least, which bounds its weight from above. Pairs that can't reach the threshold within these
    bounds are dropped, and the words of the rest are counted exactly.
    """
    shared = content.sparkSession.sparkContext.broadcast(df)
    most = float(np.sqrt(np.log1p(n / 2)))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, ta, wb, tb = (batch.column(k) for k in range(2, 6))
            t1, t2 = _lists(ta)[0], _lists(tb)[0]
            _, _, low, mass = _overlap(wa, word_weights(_lists(wa)[0], t1, n, shared.value), wb, word_weights(_lists(wb)[0], t2, n, shared.value))
            common = most * _overlap(wa, t1, wb, t2)[2]
            keep = pa.array(np.flatnonzero(common >= (threshold - 1e-6) * (common + mass - 2 * low)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["class_a", "class_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, xa, wb, xb = (batch.column(k) for k in range(2, 6))
            _, _, low, mass = _overlap(wa, _lists(xa)[0], wb, _lists(xb)[0])
            s = low / np.maximum(mass - low, 1e-30)
            keep = pa.array(np.flatnonzero(s >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(s).take(keep)], names=["class_a", "class_b", "similarity"])

    left = materialize(_sides(pairs, content, "times").mapInArrow(possible, "class_a bigint, class_b bigint"), "p3-possible")
    needed = left.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    told = materialize(content.join(needed, "class", "left_semi").select("class", F.explode(F.arrays_zip("words", "times")).alias("x")).select("class", F.col("x.words").alias("word"), F.col("x.times").alias("times")), "p3-told")
    weight = F.col("times") * F.sqrt(F.log1p(F.lit(n) / F.col("n")))
    weighed = told.join(word_counts(bag, told.select("word").distinct()), "word").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("word", weight.alias("weight")))).alias("x"))
    exact = materialize(weighed.select("class", F.col("x.word").alias("words"), F.col("x.weight").alias("weights")), "p3-weighed")
    return _sides(left, exact, "weights").mapInArrow(run, "class_a bigint, class_b bigint, similarity double")


def _sides(pairs: DataFrame, content: DataFrame, second: str) -> DataFrame:
    """Pairs of classes with the words and the ``second`` list of both."""
    side = lambda x: content.select(F.col("class").alias(f"class_{x}"), F.col("words").alias(f"w{x}"), F.col(second).alias(f"t{x}"))
    return pairs.join(side("a"), "class_a").join(side("b"), "class_b").select("class_a", "class_b", "wa", "ta", "wb", "tb")


def similar_classes(bag: DataFrame, pairs: DataFrame, n: int, df: np.ndarray, *, threshold: float, measure: str) -> DataFrame:
    """``(class_a, class_b, similarity)`` of the candidate pairs that reach the threshold."""
    needed = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    # one row a class first, combined on the map side: a class that a third of all records are in never meets in one task
    content = bag.select("class", "words", "times").dropDuplicates(["class"]).join(needed, "class", "left_semi")
    if measure == "weighted":
        return heavy_classes(materialize(content, "p3-content"), bag, pairs, n, df, threshold=threshold)
    shared = bag.sparkSession.sparkContext.broadcast(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = similarities(*(batch.column(k) for k in range(2, 6)), n, shared.value)[0]
            keep = np.flatnonzero(s >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(s[keep])], names=["class_a", "class_b", "similarity"])

    return _sides(pairs, content, "times").mapInArrow(run, "class_a bigint, class_b bigint, similarity double")


def _similar(records: DataFrame, threshold: float, measure: str, min_words: int, n: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The bags, ``(class, copy, n)`` of all classes, and the similar pairs ``(class_a, class_b, similarity)`` of them."""
    bag = materialize(bags(records, min_words=min_words, n=n, counted=measure == "weighted"), "p3-bags")
    total, df = document_frequencies(bag)
    pairs = materialize(candidate_classes(bag, total, df, least_ratio=threshold if measure == "set" else 0.0, bands=bands, rows=rows), "p3-pairs")
    found = similar_classes(bag, pairs, total, df, threshold=threshold, measure=measure)
    return bag, bag.groupBy("class", "copy").agg(F.count("*").alias("n")), found


def near_duplicates(records: DataFrame, *, threshold: float = 0.8, measure: str = "set", min_words: int = 32, n: int = 1, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(record_a, record_b)`` with record_a < record_b: similar, and no copies of each other.

    ``measure`` is "set" (share of distinct shingles) or "weighted" (weighted Jaccard over TF-IDF).
    """
    return scored_duplicates(records, threshold=threshold, measure=measure, min_words=min_words, n=n, bands=bands, rows=rows).select("record_a", "record_b")


def scored_duplicates(records: DataFrame, *, threshold: float = 0.8, measure: str = "set", min_words: int = 32, n: int = 1, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The pairs of ``near_duplicates`` with their ``similarity``; records of one class have a similarity of 1."""
    bag, kinds, found = _similar(records, threshold, measure, min_words, n, bands, rows)
    members = bag.select("class", "copy", "record_id")
    mixed = kinds.groupBy("class").agg(F.count("*").alias("k")).where("k > 1")
    linked = found.unionByName(mixed.select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.lit(1.0).alias("similarity")))
    side = lambda x: kinds.select(F.col("class").alias(f"class_{x}"), F.col("copy").alias(f"copy_{x}"))
    subclasses = (
        linked.join(side("a"), "class_a")
        .join(side("b"), "class_b")
        .where("copy_a <> copy_b and (class_a <> class_b or copy_a < copy_b)")
    )
    record = lambda x: members.select(F.col("class").alias(f"class_{x}"), F.col("copy").alias(f"copy_{x}"), F.col("record_id").alias(f"r_{x}"))
    out = subclasses.join(record("a"), ["class_a", "copy_a"]).join(record("b"), ["class_b", "copy_b"])
    return out.select(F.least("r_a", "r_b").alias("record_a"), F.greatest("r_a", "r_b").alias("record_b"), "similarity")


def class_links(records: DataFrame, *, threshold: float = 0.8, measure: str = "weighted", min_words: int = 32, n: int = 1, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(record_a, record_b, similarity)``: pairs of similar classes, each named by its smallest record."""
    bag, _, found = _similar(records, threshold, measure, min_words, n, bands, rows)
    least = bag.groupBy("class").agg(F.min("record_id").alias("r"))
    side = lambda x: least.select(F.col("class").alias(f"class_{x}"), F.col("r").alias(f"r_{x}"))
    return found.join(side("a"), "class_a").join(side("b"), "class_b").select(F.least("r_a", "r_b").alias("record_a"), F.greatest("r_a", "r_b").alias("record_b"), "similarity")


def groups(records: DataFrame, *, threshold: float = 0.8, measure: str = "set", min_words: int = 32, n: int = 1, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(record_id, group_id)``: the components of the pairs of ``near_duplicates``, without forming pairs of records.

    Classes are linked and get a component; records take the component of their class. A class whose records are no
    copies of each other is a group even without a link; two classes that hold but copies of each other are no link.
    """
    bag, kinds, found = _similar(records, threshold, measure, min_words, n, bands, rows)
    made = kinds.groupBy("class").agg(F.count("*").alias("k"), F.min("copy").alias("c"))
    side = lambda x: made.select(F.col("class").alias(f"class_{x}"), F.col("k").alias(f"k_{x}"), F.col("c").alias(f"c_{x}"))
    links = found.select("class_a", "class_b").join(side("a"), "class_a").join(side("b"), "class_b").where("k_a > 1 or k_b > 1 or c_a <> c_b")
    linked = materialize(components(links, "class_a", "class_b"), "p3-roots")
    alone = made.where("k > 1").join(linked, F.col("class") == F.col("id"), "left_anti")
    roots = materialize(linked.select(F.col("id").alias("class"), "root").unionByName(alone.select("class", F.col("class").alias("root"))), "p3-components")
    member = materialize(bag.select("class", "record_id").join(roots, "class").select("record_id", "root"), "p3-members")
    named = materialize(member.groupBy("root").agg(F.min("record_id").alias("group_id")), "p3-groups")
    return member.join(named, "root").select("record_id", "group_id")
