"""Toxicity scores by subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words' character n-grams, hashed into ``BUCKETS`` vectors.
The vectors' average, weighted by the root of their counts so that no repeated line
drowns the rest, goes through a linear softmax of two classes; vectors and softmax are
trained jointly, in numpy, over shuffled batches, by Adam with one step size for all
vectors: what many texts of a class share outgrows what one text has. A misspelling
or a new ending that was never seen shares most n-grams with words that were, so its
vectors are trained ones.

Training sees at most some ``SAMPLE`` labelled texts per class, drawn by hash, as bags
of bounded size: the one bounded sample, and a parameter. The softmax's offset is that
of classes of equal size, whatever was drawn. Scoring is one narrow pass over
whole texts. As the softmax is linear, a text's score needs only the average of one
number per n-gram; the n-grams of long texts are counted piece by piece.

Defined results: letters are compared in lower case. Null, empty and wordless texts
have the empty bag, whose average is zero: the score is the offset's. Rows without a
label, or with a null one, only get scores; of rows that repeat id and text one is
learnt from, and contradicting labels all count. Without a labelled row the score is
0.5; with one class only, all scores lean to it. Null ids are scored and never held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import cut, draw, text_key
from caseflow.llm.word_arrays import mix

FOLDS = 3
HELD_FOLD = 1
PREDICT_FROM = 0.7
SAMPLE = 2000
BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
WIDTH = 8
EPOCHS = 12
LEAST_STEPS = 200
BATCH = 64
STEP_SIZE = 0.01
SCALE = 20.0
SEED = 23
#: Characters that end a word, besides white space.
STOPS = ".,;:!?()[]{}\"'«»“”…"
#: Characters scored at once; longer texts are cut between words.
PIECE = 1 << 18
#: Texts counted at once.
GROUP = 64

_U = np.uint64
_BREAK = re.compile(r"\s")


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves HELD_FOLD by FOLDS."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


# --- n-grams ----------------------------------------------------------------------------


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of some PIECE characters, cut at white space only."""
    at = 0
    while len(text) - at > PIECE:
        found = _BREAK.search(text, at + PIECE)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def _ends_words(codes: np.ndarray) -> np.ndarray:
    blank = (codes <= 32) | (codes == 0x85) | (codes == 0xA0) | ((codes >= 0x2000) & (codes <= 0x200A)) | (codes == 0x3000)
    return blank | np.isin(codes, np.array([ord(c) for c in STOPS], np.uint32))


def gram_buckets(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (buckets, text numbers) of all n-grams of the words of some texts.

    Words stand between two marks, so that n-grams tell beginnings and endings.
    """
    joined = "\n" + "\n".join(t.lower() for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    stops = _ends_words(codes)
    lengths = [len(t.lower()) + 1 for t in texts]
    owner = np.repeat(np.arange(len(texts)), lengths)  # a text owns the mark before its first character
    size = len(codes) - 1
    marks = np.flatnonzero(stops)
    after = marks[np.searchsorted(marks, np.arange(1, size + 1))]  # where the word that begins here or next ends
    begins = ~stops[1:]  # the next character is in a word
    values = np.where(stops, 1, codes).astype(np.uint64) + _U(1)
    hashes = values.copy()
    for n in range(2, max(GRAMS) + 1):
        hashes = hashes[:-1] * _U(0x100000001B3) + values[n - 1 :]
        if n in GRAMS:
            room = size + 2 - n  # places with n characters from there on
            at = np.flatnonzero(begins[:room] & (np.arange(room) + n <= after[:room] + 1))
            yield (mix(hashes[at] + _U(n)) % _U(BUCKETS)).astype(np.int64), owner[at]


def bag_counts(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """How often each bucket occurs in each whole text; texts are handled some at a time."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and end - at < GROUP and chars <= PIECE:
            chars += len(texts[end] or "")
            end += 1
        if chars > PIECE and end - at > 1:
            end -= 1
        counts = np.zeros((end - at, BUCKETS), np.int64)
        parts = [[text or ""] for text in texts[at:end]] if end - at > 1 else [pieces(texts[at] or "")]
        for part in zip(*parts) if end - at > 1 else ([piece] for piece in parts[0]):
            for buckets, owner in gram_buckets(part):
                cuts = np.searchsorted(owner, np.arange(end - at + 1))
                for i in range(end - at):
                    counts[i] += np.bincount(buckets[cuts[i] : cuts[i + 1]], minlength=BUCKETS)
        yield from counts
        at = end


def bag(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text's counts: the buckets that occur and their weights, summing to 1."""
    used = np.flatnonzero(counts)
    roots = np.sqrt(counts[used])
    return used, roots / max(1.0, roots.sum())


# --- the model --------------------------------------------------------------------------


@dataclass
class Subwords:
    """Vectors of the buckets, the softmax's weights and offsets of class 0 and 1."""

    vectors: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def gains(self) -> np.ndarray:
        """What each bucket adds to the log odds of class 1, before averaging."""
        return SCALE * (self.vectors @ (self.weights[:, 1] - self.weights[:, 0]))

    def chances(self, averages: np.ndarray) -> np.ndarray:
        """Probabilities of class 1 for texts with such averages of ``gains``."""
        odds = averages + self.offsets[1] - self.offsets[0]
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """The probability of class 1 of each whole text."""
        return self.chances(averages(texts, self.gains()))


def averages(texts: Sequence[str | None], gains: np.ndarray) -> np.ndarray:
    """The weighted average of ``gains`` over each text's n-grams; 0 without any."""
    found = np.zeros(len(texts))
    for i, counts in enumerate(bag_counts(texts)):
        roots = np.sqrt(counts)
        found[i] = roots @ gains / max(1.0, roots.sum())
    return found


def train(bags: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Subwords:
    """Vectors and softmax of labelled bags, by Adam on the cross-entropy."""
    rng = np.random.default_rng(SEED)
    vectors = 0.3 * rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    model = Subwords(vectors, rng.uniform(-1, 1, (WIDTH, 2)), np.zeros(2))
    values = [model.vectors, model.weights, model.offsets]
    first, second = [np.zeros_like(v) for v in values], [0.0] * len(values)
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(bags))))):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), BATCH):
            rows, step = order[a : a + BATCH], step + 1
            ids = np.concatenate([bags[r][0] for r in rows])
            shares = SCALE * np.concatenate([bags[r][1] for r in rows])
            own = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            known = model.vectors[ids] * shares[:, None]
            average = np.stack([np.bincount(own, known[:, k], len(rows)) for k in range(WIDTH)], axis=1)
            logits = average @ model.weights + model.offsets
            logits -= logits.max(axis=1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(rows)), labels[rows]] -= 1
            chance /= len(rows)
            back = (chance @ model.weights.T)[own] * shares[:, None]
            slope = np.stack([np.bincount(ids, back[:, k], BUCKETS) for k in range(WIDTH)], axis=1)
            slopes = [slope, average.T @ chance, chance.sum(axis=0)]
            for i, (value, grad) in enumerate(zip(values, slopes)):
                first[i] += 0.1 * (grad - first[i])
                second[i] += 0.01 * (float((grad * grad).mean()) - second[i])
                value -= STEP_SIZE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return model


# --- on Spark ---------------------------------------------------------------------------


def _bags(rows: DataFrame) -> DataFrame:
    """(id, key, label) rows with whole texts -> their bags, as bytes."""

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(c) for c in bag_counts(batch.column(3).to_pylist())]
            buckets = pa.array([b.astype(np.uint16).tobytes() for b, _ in found], pa.binary())
            shares = pa.array([s.astype(np.float32).tobytes() for _, s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], buckets, shares], names=["id", "key", "label", "buckets", "shares"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(bagged, f"id {kind}, key long, label int, buckets binary, shares binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Subwords | None:
    """The model of the labelled rows that are not held out; None without any."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", text_key(F.col("text")))
    known = cut(texts.select("id", "key").join(marks, "id").distinct())
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None
    shares = F.lit(1.0)
    for label, count in counts.items():
        shares = F.when(F.col("label") == label, sample / count).otherwise(shares)
    # some ``sample`` rows a class, so this is broadcast whatever the number of labels
    chosen = cut(known.where(draw(SEED, F.col("id"), F.col("key"), F.col("label")) < shares), 2 * sample)
    rows = texts.join(F.broadcast(chosen), ["id", "key"]).select("id", "key", "label", "text")
    found = _bags(rows).dropDuplicates(["id", "key", "label"]).collect()
    found.sort(key=lambda r: (r["id"], r["key"], r["label"]))
    bags = [(np.frombuffer(r["buckets"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float32)) for r in found]
    marked = np.array([r["label"] for r in found], np.int64)
    model = train(bags, marked)
    model.offsets = model.offsets - np.log(np.bincount(marked, minlength=2) + 1)
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> DataFrame:
    """Per row of ``docs``: id, held_out, score (0 to 1), predicted.

    ``labels`` has the id and a 0/1 column ``label_col``. Its rows whose id is held out
    are never learnt from.
    """
    model = fit(docs, labels, id_col, text_col, label_col, sample)
    if model is None:
        model = Subwords(np.zeros((BUCKETS, 1)), np.zeros((1, 2)), np.zeros(2))
    gains, offsets = model.gains().astype(np.float32), model.offsets
    light = Subwords(np.zeros((0, 1)), np.zeros((1, 2)), offsets)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = light.chances(averages(batch.column(2).to_pylist(), gains))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round(chance, 9))], names=[id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
    found = rows.mapInArrow(scored, f"`{id_col}` {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
