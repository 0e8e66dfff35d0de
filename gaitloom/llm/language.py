"""Language of every text and of every line of a mixed text (problem 9).

Method. Lines are compared by a blended-spectrum presence kernel: the number of character n-grams (n = 1 to 4) two lines
share, normalised by their own numbers. On Nystrom landmarks a one-versus-rest kernel ridge regression is fitted to a
bounded sample of labelled rows; labels are known to be partly wrong, so in a few rounds lines whose label disagrees with
the prediction of a smoothed fit to other texts leave the sample before the final fit. The kernel is linear in the presence vectors, so landmarks and regression
weights are multiplied into one matrix of n-gram by language once, and a batch of lines is scored by one product of its
presence matrix with it. Texts are never shuffled: one pass reads, scores and labels them.

The sample is bounded by ``SAMPLE_TEXTS`` texts a language of at most ``SAMPLE_CHARS`` characters; every line of every
text is scored. n-grams are hashed into ``2**GRAM_BITS`` buckets.

Defined results: a line counts if it has at least ten letters; lines end at line feeds and are numbered from 1, blank ones
included. Null, blank and letterless texts, and texts without a counted line, give no row. Of languages with equally many
lines the one with more letters, then the first in the alphabet is the text's. Without a single usable label nothing can
be fitted and no row comes out. Repeated rows give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import spread
from .bpe import _blocks

#: Bounds of the labelled sample the classifier is fitted on, and of the fit itself.
SAMPLE_TEXTS, SAMPLE_CHARS, FIT_LINES, LANDMARKS = 400, 20_000, 300, 40
GRAM_BITS, GRAM_ORDERS = 18, 4
#: Ridge of the final fit and of the fits that clean the labels; rounds of cleaning and folds of texts in each.
RIDGE, SMOOTH, CLEANINGS, FOLDS = 0.1, 3.0, 3, 2
LETTERS = 10
#: Characters whose n-grams are sorted at once.
BLOCK_CHARS = 30_000

#: Notations of a language, besides region and script suffixes and letter case.
NOTATIONS = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "castilian", "español"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "ja": ("ja", "jpn", "japanese", "日本語"),
    "nl": ("nl", "nld", "dut", "dutch", "flemish", "nederlands"),
    "pt": ("pt", "por", "portuguese", "português"),
    "ru": ("ru", "rus", "russian", "русский"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文"),
}


def label_code(label, notations: dict[str, tuple[str, ...]] = NOTATIONS):
    """Two-letter code a label column names in any notation; null if it names none of the known languages."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"(?U)^(\p{L}+)", 1)
    table = F.create_map(*[F.lit(x) for code, names in notations.items() for name in names for x in (name, code)])
    return table.getItem(head)


_OTHER = re.compile(r"[\W\d_]+")


def plain(line: str) -> str:
    """Lower-case letters of a line, words set apart by one blank."""
    if not line.isascii():
        line = unicodedata.normalize("NFKC", line)
    return " " + _OTHER.sub(" ", line.lower()).strip() + " "


def letter_count(line: str) -> int:
    return sum(map(str.isalpha, line))


def grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct n-gram of every prepared line."""
    mask = np.uint64((1 << GRAM_BITS) - 1)
    code = np.frombuffer("\0".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.cumsum(code == 0).astype(np.int64)
    keys, h, alive = [], np.zeros(len(code), np.uint64), np.ones(len(code), bool)
    for n in range(1, GRAM_ORDERS + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        alive = alive[:size] & (code[n - 1 :] != 0)
        h = h[:size] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        z = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (z >> np.uint64(40)) & mask
        keys.append((row[:size][alive] << GRAM_BITS) | bucket[alive].astype(np.int64))
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key >> GRAM_BITS, key & int(mask)


class SpectrumRidge:
    """Nystrom kernel ridge regression over the presence kernel, folded into ``weights`` (bucket x language)."""

    def __init__(self, lines: list[str], labels: np.ndarray, texts: np.ndarray, codes: list[str], seed: int = 9):
        self.codes = codes
        random = np.random.default_rng(seed)
        for _ in range(CLEANINGS):
            # every line is judged by a strongly smoothed fit that hasn't seen its text
            said = np.zeros(len(lines), int)
            for fold in range(FOLDS):
                inside = texts % FOLDS == fold
                if inside.any() and not inside.all():
                    self._fit(lines, labels, np.flatnonzero(~inside), random, SMOOTH)
                    said[inside] = self.predict([lines[k] for k in np.flatnonzero(inside)])[0]
                else:
                    said[inside] = labels[inside]
            agree = np.flatnonzero(said == labels)
            if len(np.unique(labels[agree])) < len(np.unique(labels)):
                break
            lines, labels, texts = [lines[k] for k in agree], labels[agree], texts[agree]
        self._fit(lines, labels, np.arange(len(lines)), random, RIDGE)

    def _fit(self, lines: list[str], labels: np.ndarray, among: np.ndarray, random: np.random.Generator, ridge: float) -> None:
        pick = lambda most: np.sort(np.concatenate([random.permutation(among[labels[among] == c])[:most] for c in range(len(self.codes))]))
        rows, marks = pick(FIT_LINES), pick(LANDMARKS)
        z_row, z_gram = grams([lines[k] for k in marks])
        known, z_col = np.unique(z_gram, return_inverse=True)
        z = np.zeros((len(known), len(marks)), np.float32)
        z[z_col, z_row] = 1
        z /= np.sqrt(np.maximum(z.sum(0), 1))
        place = np.full(1 << GRAM_BITS, -1, np.int64)
        place[known] = np.arange(len(known))

        def kernel(chosen: np.ndarray) -> np.ndarray:
            out = np.zeros((len(chosen), len(marks)), np.float32)
            for a in range(0, len(chosen), 128):
                own = [lines[k] for k in chosen[a : a + 128]]
                row, gram = grams(own)
                norm = np.sqrt(np.maximum(np.bincount(row, minlength=len(own)), 1))
                inside = place[gram] >= 0
                present = np.zeros((len(own), len(known)), np.float32)
                present[row[inside], place[gram[inside]]] = 1
                out[a : a + 128] = present @ z / norm[:, None]
            return out

        value, vector = np.linalg.eigh(kernel(marks).astype(np.float64))
        use = value > 1e-6 * value.max()
        root = vector[:, use] / np.sqrt(value[use])
        phi = kernel(rows) @ root
        target = np.where(labels[rows][:, None] == np.arange(len(self.codes)), 1.0, -1.0)
        self.bias = target.mean(0)
        inner = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ (target - self.bias))
        self.weights = np.zeros((1 << GRAM_BITS, len(self.codes)), np.float32)
        self.weights[known] = z @ (root @ inner)

    def scores(self, lines: list[str]) -> np.ndarray:
        row, gram = grams(lines)
        number = np.bincount(row, minlength=len(lines))
        start = np.concatenate(([0], np.cumsum(number)[:-1]))
        total = np.add.reduceat(self.weights[gram], np.minimum(start, max(len(gram) - 1, 0)), axis=0) if len(gram) else np.zeros((len(lines), len(self.codes)))
        return total / np.sqrt(np.maximum(number, 1))[:, None] + self.bias

    def predict(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and confidence (half the lead over the next one, from 0.5 to 1) of every line."""
        if not lines:
            return np.zeros(0, int), np.zeros(0)
        size = np.cumsum([len(x) for x in lines]) // BLOCK_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(lines)]
        s = np.concatenate([self.scores(lines[a:b]) for a, b in zip(cuts, cuts[1:])])
        if s.shape[1] == 1:
            return np.zeros(len(lines), int), np.ones(len(lines))
        two = np.partition(s, -2, axis=1)[:, -2:]
        return s.argmax(1), np.clip(0.5 + (two[:, 1] - two[:, 0]) / 4, 0.5, 1.0)


def counted_lines(text: str | None) -> list[tuple[int, str]]:
    return [(k, x) for k, x in enumerate((text or "").split("\n"), 1) if len(x) >= LETTERS and letter_count(x) >= LETTERS]


def fit(documents: DataFrame, *, notations: dict[str, tuple[str, ...]] = NOTATIONS) -> SpectrumRidge | None:
    """The classifier fitted to a bounded sample of labelled texts, chosen by a hash of their ids."""
    labelled = documents.select("doc_id", "text", label_code(F.col("lang"), notations).alias("code")).where(F.col("code").isNotNull() & (F.length("text") >= LETTERS) & (F.length("text") <= SAMPLE_CHARS))
    turn = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id"))
    sample = labelled.withColumn("turn", turn).where(F.col("turn") <= SAMPLE_TEXTS).select("doc_id", "text", "code").collect()
    lines, labels, texts = [], [], []
    codes = sorted({r.code for r in sample})
    for number, r in enumerate(sorted(sample, key=lambda r: (r.code, str(r.doc_id), r.text))):
        for _, x in counted_lines(r.text):
            lines.append(plain(x))
            labels.append(codes.index(r.code))
            texts.append(number)
    return SpectrumRidge(lines, np.array(labels), np.array(texts), codes) if lines else None


_OUT = "doc_id bigint, seg_no int, lang string, confidence double, mixed boolean, label string"


def identify(documents: DataFrame, *, notations: dict[str, tuple[str, ...]] = NOTATIONS) -> DataFrame:
    """``(doc_id, seg_no, lang, confidence, mixed, label)``: seg_no 0 is the text, n its n-th line if that counts."""
    spark = documents.sparkSession
    model = fit(documents, notations=notations)
    if model is None:
        return spark.createDataFrame([], _OUT)
    used = np.flatnonzero(np.abs(model.weights).max(1) > 0)
    shared = spark.sparkContext.broadcast((used, model.weights[used], model.bias, model.codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, bias, codes = shared.value
        own = SpectrumRidge.__new__(SpectrumRidge)
        own.codes, own.bias = codes, bias
        own.weights = np.zeros((1 << GRAM_BITS, len(codes)), np.float32)
        own.weights[used] = weights
        for batch in batches:
            for part in _blocks(batch, 4 << 20):
                doc, seg, lines, size = [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    for number, x in counted_lines(text):
                        doc.append(k)
                        seg.append(number)
                        lines.append(plain(x))
                        size.append(len(lines[-1]))
                if not doc:
                    continue
                lang, sure = own.predict(lines)
                doc, size = np.array(doc), np.array(size)
                votes = np.zeros((part.num_rows, len(codes)))
                np.add.at(votes, (doc, lang), 1)
                mass = np.zeros_like(votes)
                np.add.at(mass, (doc, lang), size)
                belief = np.zeros_like(votes)
                np.add.at(belief, (doc, lang), sure)
                texts = np.unique(doc)
                best = (votes + mass / (mass.sum(1, keepdims=True) + 1))[texts].argmax(1)
                trust = belief[texts, best] / votes[texts].sum(1)
                mixed = (votes > 0).sum(1) > 1
                at = np.concatenate([texts, doc])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(at)),
                        pa.array(np.concatenate([np.zeros(len(texts), int), seg]).astype(np.int32)),
                        pa.array(np.array(codes, object)[np.concatenate([best, lang])], pa.string()),
                        pa.array(np.concatenate([trust, sure]).astype(np.float64)),
                        pa.array(mixed[at]),
                        part.column(2).take(pa.array(at)),
                    ],
                    names=["doc_id", "seg_no", "lang", "confidence", "mixed", "label"],
                )

    read = documents.select("doc_id", "text", label_code(F.col("lang"), notations).alias("label"))
    return spread(read).mapInArrow(run, _OUT)


def wrong_or_mixed(documents: DataFrame) -> DataFrame:
    """``(doc_id, seg_no, lang)``: texts whose label is missing or wrong, and the lines of mixed texts."""
    found = identify(documents)
    return found.where((F.col("seg_no") == 0) & ~F.col("label").eqNullSafe(F.col("lang")) | (F.col("seg_no") > 0) & F.col("mixed")).select("doc_id", "seg_no", "lang")
