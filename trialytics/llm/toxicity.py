"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence that holds a learnt feature (see features) has as
its score the logistic function of its features' weights and a bias; one that holds none scores
0. A document's score is the noisy-or of its sentences', 1 - product of (1 - p). Only documents
are labelled: the likelihood of their labels trains the weights through that same noisy-or.
The offending sentences of a document that is predicted toxic are all whose score is at least
`sentence_from`, and in any case the highest; a document that isn't has none.

The model is fitted on the driver on a bounded sample: at most `per_class` labelled documents of
each class, the first by a hash of their id, as far as their texts stay within `most_chars` code
points a class (the first text always counts); whole texts. It scores every whole text.

Nulls and edge cases: a null or empty text has no sentence and scores 0. Labels that are null
don't count; of several labels of one id the highest counts, and of several texts of one id the
shortest is learnt from. Without a document of both classes no weight is learnt and
the score is the share of toxic labels (0 without labels). Repeated rows get the same score
each; an empty table gives no rows. Further columns are kept. The operator's own columns are
called as in OWN; where docs has a column of such a name, the operator's gets one more
underscore in front (own_names), and the input's column stays.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialytics.llm.common import own_names
from trialytics.session import prepare

OWN = ("_t_score", "_t_predicted", "_t_offending")
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> set[str]:
    """The word between marks, and its first and last 3, 4 and 5 letters, so that inflected and compound words are known by their parts."""
    marked = f"^{word}$"
    return {marked, *(marked[:n] for n in (4, 5, 6)), *(marked[-n:] for n in (4, 5, 6))}


@dataclass
class BagModel:
    """Feature weights and bias of the sentence score; constant: the score of all non-empty texts where nothing was learnt."""

    weights: dict[str, float]
    bias: float
    constant: float | None = None
    room: int = 200_000

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def of_word(self, word: str) -> float:
        """The sum of a word's feature weights; up to `room` words are remembered."""
        if (value := self.known.get(word)) is None:
            if len(self.known) >= self.room:
                self.known.clear()
            value = self.known[word] = sum(self.weights.get(f, 0.0) for f in sorted(features(word)))
        return value

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, log-odds) of the sentences with a weighted word."""
        if not any(map(self.of_word, set(WORD.findall(text.lower())))):
            return []
        out = []
        for match in SENTENCE.finditer(text):
            values = [v for w in sorted(set(WORD.findall(match[0].lower()))) if (v := self.of_word(w))]
            if values:
                out.append((*match.span(), self.bias + sum(values)))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its weighted sentences. A sentence without weighted words scores 0."""
        if self.constant is not None:
            return (self.constant if text else 0.0), []
        found = self.sentences(text)
        if not found:
            return 0.0, []
        z = np.array([f[2] for f in found])
        return float(-np.expm1(-np.logaddexp(0, z).sum())), found


def fit(texts: Iterable[str], labels: list[int], steps: int = 150, rate: float = 0.25, l1: float = 1.5e-3, l2: float = 1e-5, least: int = 5, floor: float = 0.3) -> BagModel:
    """Maximum likelihood of the labels under the noisy-or, by proximal Adam steps.

    A first descent under an L1 penalty picks the features (of those in `least` documents or
    more, those whose weight leaves +-floor); a second, all but free, sets their weights. In both
    a sentence counts by the model's rule: one without features in play scores 0. Words
    are numbered and kept in flat arrays: a word of a sentence takes eight bytes.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return BagModel({}, 0.0, float(y.mean()) if len(y) else 0.0)
    numbers: dict[str, int] = {}
    words, sizes, docs = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in SENTENCE.findall(text.lower()):
            ids = {numbers.setdefault(w, len(numbers)) for w in WORD.findall(s)}
            words.extend(sorted(ids))
            sizes.append(len(ids))
            docs.append(d)
    word, doc = np.array(words, dtype=np.int32), np.array(docs, dtype=np.int32)
    sentence = np.repeat(np.arange(len(doc), dtype=np.int32), np.array(sizes, dtype=np.int32))
    names: dict[str, int] = {}
    of_word, feature = array("i"), array("i")
    for w, number in numbers.items():
        for f in sorted(features(w)):
            of_word.append(number)
            feature.append(names.setdefault(f, len(names)))
    of_word, feature = np.array(of_word, dtype=np.int32), np.array(feature, dtype=np.int32)
    # documents that hold a feature: its words' (document, word) pairs, each document once
    pairs = np.unique(doc[sentence].astype(np.int64) * len(numbers) + word)
    begin = np.searchsorted(of_word, np.arange(len(numbers) + 1))
    seen = np.zeros(len(names), dtype=np.int64)
    for d in range(len(y)):
        own = pairs[np.searchsorted(pairs, d * len(numbers)) : np.searchsorted(pairs, (d + 1) * len(numbers))] - d * len(numbers)
        seen[np.unique(feature[_ranges(begin[own], begin[own + 1])])] += 1
    texts_of = list(names)
    count = len(doc)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def descend(kept: np.ndarray, l1: float, l2: float) -> np.ndarray:
        place = np.full(len(names), -1)
        place[kept] = np.arange(len(kept))
        use = place[feature] >= 0
        left, right = of_word[use], place[feature[use]]
        speaks = np.zeros(len(numbers), dtype=bool)
        speaks[left] = True
        in_play = np.bincount(sentence, speaks[word], count) > 0
        theta, first, second = np.append(np.zeros(len(kept)), -4.0), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
        for step in range(1, steps + 1):
            of_words = np.bincount(left, theta[right], len(numbers))
            z = theta[-1] + np.bincount(sentence, of_words[word], count)
            total = np.maximum(np.bincount(doc, np.where(in_play, np.logaddexp(0, z), 0.0), len(y)), 1e-9)
            slope = share * np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)  # of the loss in the total
            at_z = np.where(in_play, slope[doc] / (1 + np.exp(-z)), 0.0)
            by_word = np.bincount(word, at_z[sentence], len(numbers))
            grad = np.append(np.bincount(right, by_word[left], len(kept)) + l2 * theta[:-1], at_z.sum())
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            pace = rate * (1.05 - step / steps) / (np.sqrt(second / (1 - 0.99**step)) + 1e-4)
            theta = theta - pace * first / (1 - 0.9**step)
            theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - (pace * l1)[:-1], 0)
        return theta

    known = np.flatnonzero(seen >= least)
    picked = known[np.abs(descend(known, l1, 0.0)[:-1]) > floor]
    theta = descend(picked, 0.0, l2)
    return BagModel({texts_of[i]: float(w) for i, w in zip(picked.tolist(), theta, strict=False)}, float(theta[-1]))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0], ..., end[0] - 1, begin[1], ... as one array."""
    size = end - begin
    return np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, per_class: int = 1000, most_chars: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> BagModel:
    """Fit on a bounded sample of the labelled documents for whose id learn_from holds (see the module's docstring)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn_from).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    known = known.select("id", "label", F.xxhash64("id").alias("order"))
    picked = known.where("label = 1").orderBy("order", "id").limit(per_class).unionByName(known.where("label = 0").orderBy("order", "id").limit(per_class))
    # at most 2 * per_class ids, so the broadcast is bounded; the hash tells equal sizes of one id's texts apart
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = named.join(F.broadcast(picked), "id").groupBy("order", "id", "label").agg(F.min(F.struct(F.length("text").alias("chars"), F.xxhash64("text").alias("digest"))).alias("first"))
    chosen, room = [], {0: most_chars, 1: most_chars}
    started: set[int] = set()
    for r in sized.orderBy("order", "id").collect():  # numbers only, at most 2 * per_class rows
        room[r["label"]] -= r["first"]["chars"]
        if room[r["label"]] >= 0 or r["label"] not in started:
            started.add(r["label"])
            chosen.append((r["id"], r["order"], r["label"], r["first"]["digest"]))
    if not chosen:
        return fit([], [], **options)
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("order", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("digest", T.LongType())]))
    texts = named.withColumn("digest", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "digest"]).dropDuplicates(["id"])
    rows = sorted(texts.select("order", "id", "text", "label").collect(), key=lambda r: (r["order"], r["id"]))
    return fit((r["text"] for r in rows), [r["label"] for r in rows], **options)


def score(docs: DataFrame, model: BagModel, text_col: str = "text", threshold: float = 0.5, sentence_from: float = 0.25) -> DataFrame:
    """The columns of docs with those of OWN: _t_score, _t_predicted and _t_offending, spans (code points) and scores of the offending sentences, highest first."""
    prepare(docs.sparkSession)
    names, own = docs.columns, list(own_names(docs, OWN).values())
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(n, t) for n, t in zip(own, (T.DoubleType(), T.IntegerType(), T.ArrayType(span)), strict=True)])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, guesses, places = [], [], []
            for text in batch.column(names.index(text_col)).to_pylist():
                value, found = model.score(text or "")
                values.append(value)
                guesses.append(int(value >= threshold))
                ranked = sorted(((float(1 / (1 + np.exp(-z))), a, b) for a, b, z in found), key=lambda f: (-f[0], f[1])) if value >= threshold else []
                places.append([{"start": a, "end": b, "score": p} for at, (p, a, b) in enumerate(ranked) if not at or p >= sentence_from])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64()), pa.array(guesses, pa.int32()), pa.array(places, spans)], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
