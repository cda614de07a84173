"""Language ID with string kernels.

Two texts are alike by the n-grams of 1 to 3 characters that both contain (presence, blended over
the lengths), normalised by their numbers. Landmark texts span a Nyström map; on it, kernel ridge
regression is solved for each language against the rest. As the kernel is a product of presence
vectors, the map and all languages' weights fold into one matrix, and a batch of texts is scored by
the product of its presence rows with that matrix.

The model is fitted on a bounded sample of labelled training documents, those first in a hash of their
id: ``PER_LANGUAGE`` of each language, fewer where that would be more than ``SAMPLE`` in all, and one at least.
Every language is learned. Ids and sources are no features.

A filter needs more than the likeliest language: a text may be in none of them. ``Familiar`` holds the share
of a language's training documents that have an n-gram. The mean of these shares over a text's
n-grams, measured by the highest mean that as many n-grams can reach, says how much of the text belongs to the
language, whatever the number of languages and the text's length.

Defined cases: ``und`` with score 0 where text is null or has no letter, and for all texts if there is
nothing to learn from; null ids are not held out; repeated rows give a row each; the whole text
counts, however long. An id that stands on several rows of a language is learned once, with the smallest of
its texts; rows without an id are not learned. Only id, text and language are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from norrsken.llm.common import documents, pick, slices, texts_of

ORDERS = (1, 2, 3)
#: Slots of hashed n-grams.
SLOTS = 1 << 15
#: Training documents of a language, and of all languages together (each has one at least).
PER_LANGUAGE = 300
SAMPLE = 19_200
#: Landmarks among the training documents; each language has one at least.
LANDMARKS = 256
RIDGE = 1e-3
FOLDS = 5
BATCH_BYTES = 1 << 20
ROWS = 64
UNKNOWN = "und"
#: A document is rejected if it is less familiar than this part of the least familiar training document.
LEAST_PART = 0.5

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")


def presence(text: str) -> np.ndarray:
    """The distinct slots of the text's n-grams, in lower case, ends marked by a space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    seen = np.zeros(SLOTS, bool)
    code = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for order in ORDERS:
            code = (code[:-1] if order > 1 else code) * np.uint64(0x1000193) + points[order - 1:] + np.uint64(order)
            seen[((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)] = True
            if len(code) < 2:
                break
    return np.flatnonzero(seen)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages
    bias: np.ndarray


def _unit_rows(rows: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(rows), SLOTS), np.float32)
    for i, slots in enumerate(rows):
        x[i, slots] = 1 / np.sqrt(max(1, len(slots)))
    return x


def fit(rows: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS) -> Model:
    """Nyström landmarks and one-versus-rest kernel ridge regression on presence rows."""
    languages = sorted(set(labels))
    if not rows:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    # Landmarks take turns among the languages.
    met: Counter[str] = Counter()
    turn = np.zeros(len(labels), np.int64)
    for i, label in enumerate(labels):
        turn[i] = met[label]
        met[label] += 1
    chosen = np.lexsort((labels, turn))[:max(landmarks, len(languages))]
    marks = _unit_rows([rows[i] for i in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    to_map = vectors[:, kept] / np.sqrt(values[kept])  # kernel with the landmarks -> Nyström map
    mapped = np.concatenate([
        (_unit_rows(rows[at:at + LANDMARKS]) @ marks.T).astype(np.float64) @ to_map
        for at in range(0, len(rows), LANDMARKS)
    ])
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    centre = mapped.mean(0)
    gram = (mapped - centre).T @ (mapped - centre)
    gram[np.diag_indices_from(gram)] += RIDGE * len(rows)
    offset = target.mean(0)
    solved = np.linalg.solve(gram, (mapped - centre).T @ (target - offset))
    return Model(languages, (marks.T @ (to_map @ solved)).astype(np.float32), offset - centre @ solved)


@dataclass
class Familiar:
    shares: dict[str, np.ndarray]  # per language and slot, the share of its training documents that have it
    best: dict[str, np.ndarray]  # the highest sum of shares that 1, 2, ... slots can have
    least: dict[str, float]

    def of(self, text: str, language: str) -> float:
        """0 to 1: how much of the text's n-grams the language has."""
        slots = presence(text)
        return float(self.shares[language][slots].sum() / self.best[language][len(slots) - 1])

    def accepts(self, text: str, language: str) -> bool:
        return language != UNKNOWN and self.of(text, language) >= self.least[language]


def familiar(rows: list[np.ndarray], labels: list[str], part: float = LEAST_PART) -> Familiar:
    """Shares per language; each training document is measured by the others of its language.

    A language with a single training document rejects nothing.
    """
    out = Familiar({}, {}, {})
    own: dict[str, list[np.ndarray]] = {}
    for slots, label in zip(rows, labels):
        own.setdefault(label, []).append(slots)
    for label, members in own.items():
        counts = np.zeros(SLOTS, np.float32)
        for slots in members:
            counts[slots] += 1
        best = np.cumsum(np.sort(counts)[::-1], dtype=np.float64) / len(members)
        others = max(1, len(members) - 1)
        out.least[label] = part * min(float((counts[s] - 1).sum() / others / best[len(s) - 1]) for s in members)
        out.shares[label] = counts / np.float32(len(members))
        out.best[label] = best.astype(np.float32)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score: the winning value, from -1..1 brought to 0..1."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if not model.languages:
        return names, scores
    for at in range(0, len(lettered), ROWS):
        part = lettered[at:at + ROWS]
        x = np.zeros((len(part), SLOTS), np.float32)
        for k, i in enumerate(part):
            slots = presence(texts[i])
            x[k, slots] = 1 / np.sqrt(len(slots))
        values = x @ model.weights + model.bias
        best = values.argmax(1)
        top = values[np.arange(len(part)), best]
        for k, i in enumerate(part):
            names[i] = model.languages[best[k]]
        scores[part] = np.clip((top + 1) / 2, 0, 1)
    return names, scores


def training_sample(df: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> DataFrame:
    """doc_id, lang, text of the sample, a row for each id and language.

    Ids are chosen first, so that only the sample's texts travel; repeated ids are reduced in the map tasks.
    """
    labelled = df.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    ids = labelled.select("lang", "doc_id").distinct()
    count = labelled.select("lang").distinct().count()
    each = min(per_language, max(1, most // max(1, count)))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("lang", "doc_id")
    # At most ``most`` rows, or one for each language: a proven bound for the broadcast.
    texts = labelled.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")
    return texts.where(F.col("text").rlike("\\p{L}")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def _held_out():
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(number % FOLDS == 0, F.lit(False))


def training_rows(df: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[np.ndarray], list[str]]:
    """Presence rows and labels of the sample; they come to the driver as packed bits, SLOTS / 8 bytes each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            packed = []
            for text in texts_of(batch.column("text")):
                seen = np.zeros(SLOTS, bool)
                seen[presence(text)] = True
                packed.append(np.packbits(seen).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(packed, pa.binary())],
                ["doc_id", "lang", "bits"],
            )

    sample = training_sample(df, per_language)
    found = sample.mapInArrow(rows, "doc_id long, lang string, bits binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["lang"], r["doc_id"]))
    bits = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))) for r in found]
    return bits, [r["lang"] for r in found]


def train(df: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    return fit(*training_rows(df, per_language))


def languages(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
              model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shaped = pick(df, doc_id=id, text=text, lang=lang)
    shared = df.sparkSession.sparkContext.broadcast(model or train(shaped))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            names, scores = predict(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return shaped.select("doc_id", "text", _held_out().alias("held_out")).mapInArrow(run, SCHEMA)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


def in_known_language(df: DataFrame) -> DataFrame:
    """The rows of a documents table whose language is recognised, unchanged.

    Texts without a letter go, and those in which the likeliest language is not familiar enough. Rows travel
    as one struct, so any column names and types may stand beside the three that are read.
    """
    rows, labels = training_rows(pick(df, doc_id="doc_id", text="text", lang="lang"))
    shared = df.sparkSession.sparkContext.broadcast((fit(rows, labels), familiar(rows, labels)))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            names, _ = predict(model, texts)
            good = [n != UNKNOWN and known.accepts(t, n) for n, t in zip(names, texts)]
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("row")], ["row"])

    kept = whole.mapInArrow(run, whole.select("row").schema)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
