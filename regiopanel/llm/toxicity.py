"""Operator 4: toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text, their prefixes, and prefixes that two different words of the text
share (presence, not counts). It is fitted on a
bounded sample of labelled texts. Each sampled text that names a group of people gets a counterfactual: the
same text with every identity term swapped for another one of its kind. The loss adds ``PENALTY`` times the
squared change of the logit between a text and its counterfactual, so the weights of the terms themselves, and of
what only goes with them, are pulled together, and a neutral mention of a group moves no score.

Spark draws the sample (at most ``SAMPLE`` labelled rows, the smallest by hash of the id), counts its features
and selects the ``FEATURES`` that tell the labels apart best; only those columns of the sample, of bounded
size, reach the driver for the fit. Scoring covers every whole text, in each task by the distinct words of a
piece; nothing is shuffled for it.

Labels only decide the fit. Inputs of a score are the words of the text alone. Rows with
``crc32(doc_id as text) % FOLDS == 0`` are held out of the fit.

Defined results: null and empty texts have no words and get the score of the intercept. A row with a null id
is not held out and never in the sample. Labels other than 0 and 1 are ignored; of several labels of an id the larger holds. Without
labels of both kinds the score is the share of label 1 (0 without labels). Repeated rows are scored alike.
Extra columns are ignored or passed through. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiopanel.llm.ship import ship
from regiopanel.llm.words import column, expand, find_words, pieces, text_bytes
from regiopanel.session import materialize

#: Bytes of text worked on at a time, in the fit and in scoring.
PIECE, SCORED = 1 << 20, 2 << 20
#: Labelled rows of the fit at most, features kept, the fewest texts of a feature, and the share held out (1 in so many).
SAMPLE, FEATURES, MIN_TEXTS, FOLDS = 12_000, 4096, 4, 5
#: The least log likelihood ratio of a feature; below it, its link with the label may well be chance.
MIN_GAIN = 6.0
#: Prefix lengths, in characters.
PREFIXES = (3, 4, 5, 6)
#: Weights of the counterfactual penalty and of the squared weights; steps of the fit.
PENALTY, RIDGE, STEPS = 1.0, 1e-4, 400

# Identity terms; a term is swapped for the next one of its row.
IDENTITIES = [
    "women men", "woman man", "girls boys", "girl boy", "female male", "she he", "her his", "gay straight lesbian bisexual",
    "homosexual heterosexual", "transgender cisgender", "muslim christian jewish hindu buddhist atheist sikh",
    "muslims christians jews hindus buddhists atheists sikhs", "islam christianity judaism hinduism buddhism",
    "black white asian latino", "blacks whites asians latinos", "african european american", "africans europeans americans",
    "mexican chinese arab indian turkish polish russian german french spanish",
    "mexicans chinese arabs indians turks poles russians germans french spaniards",
    "immigrant native refugee", "immigrants natives refugees", "disabled blind deaf", "old young", "elderly youth",
    "frauen männer", "frau mann", "schwul lesbisch hetero", "muslime christen juden hindus", "muslimisch christlich jüdisch",
    "schwarze weiße", "ausländer deutsche flüchtlinge türken polen", "behinderte blinde gehörlose",
    "femmes hommes", "femme homme", "musulmans chrétiens juifs", "musulman chrétien juif", "noirs blancs", "noir blanc",
    "immigrés français réfugiés arabes", "homosexuels hétérosexuels",
    "mujeres hombres", "mujer hombre", "musulmanes cristianos judíos", "musulmán cristiano judío", "negros blancos",
    "inmigrantes nativos refugiados", "homosexuales heterosexuales",
]
_SWAP = {t: row[(i + 1) % len(row)] for row in map(str.split, IDENTITIES) for i, t in enumerate(row)}
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass
class Model:
    """Weights by feature: ``word``, ``prefix*``, and ``prefix**`` where two words share the prefix."""

    intercept: float
    weights: dict[str, float] = field(default_factory=dict)


def clean(word: bytes) -> str:
    """A word in lower case without what is no letter or digit at its ends."""
    word = word.decode("utf-8", "replace").lower()
    return word if word.isalnum() else _TRIM.sub("", word)


def features(word: str) -> list[str]:
    """The features of a cleaned word: itself, and its proper prefixes marked by ``*``."""
    return [word] + [word[:k] + "*" for k in PREFIXES if len(word) > k] if word else []


def text_features(words) -> set[str]:
    """The features of a text with these distinct cleaned words."""
    once: set[str] = set()
    twice = set()
    for w in words:
        for f in features(w):
            if f not in once:
                once.add(f)
            elif f[-1] == "*":
                twice.add(f + "*")
    return once | twice


def _distinct(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cleaned distinct words, and the (text, word) pairs that occur."""
    data, off = text_bytes(texts)
    words = find_words(data, off)
    spans = np.empty(2 * len(words.starts) + 1, np.int64)
    spans[:-1:2], spans[1::2], spans[-1] = words.starts, words.ends, len(data)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(spans) - 1, [
        None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(data))]).take(
            pa.array(np.arange(0, len(spans) - 1, 2))).dictionary_encode()
    text = np.repeat(np.arange(len(off) - 1), np.diff(words.first))
    return list(map(clean, coded.dictionary.to_pylist())), text, coded.indices.to_numpy(zero_copy_only=False)


def _pairs(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All features of the texts, and the (text, feature) pairs that occur, each once, as two arrays of numbers."""
    words, text, word = _distinct(texts)
    cleaned = {w: i for i, w in enumerate(dict.fromkeys(words))}  # several words may be one when cleaned
    n = max(1, len(cleaned))
    number = np.array([cleaned[w] for w in words], np.int64)
    pairs = np.unique(text * n + (number[word] if len(word) else word))
    index: dict[str, int] = {}
    of_word = [[index.setdefault(f, len(index)) for f in features(w)] for w in cleaned]
    counts = np.array([len(x) for x in of_word], np.int64)
    flat = np.array([f for x in of_word for f in x], np.int64)
    text, word = pairs // n, pairs % n
    m = max(1, len(index))
    each = counts[word] if len(counts) else word
    found, times = np.unique(np.repeat(text, each) * m + flat[expand((np.cumsum(counts) - counts)[word], each)] if len(counts) else pairs,
                             return_counts=True)
    names = list(index)
    prefix = np.array([f[-1] == "*" for f in names], bool)
    text, feature = found // m, found % m
    shared = (times > 1) & prefix[feature] if len(names) else times > 1  # two words of the text share the prefix
    return names + [f + "*" for f in names], np.concatenate([text, text[shared]]), np.concatenate([feature, feature[shared] + len(names)])


def _relevant(texts: pa.Array, index, also=()) -> list[set]:
    """Per text its distinct cleaned words that have a feature in ``index``, or are in ``also``."""
    words, text, word = _distinct(texts)
    useful = np.array([w in also or any(f in index or f + "*" in index for f in features(w)) for w in words], bool)
    keep = useful[word] if len(word) else np.zeros(0, bool)
    out: list[set] = [set() for _ in range(len(texts))]
    for t, w in zip(text[keep].tolist(), word[keep].tolist()):
        out[t].add(words[w])
    return out


def _sample(docs: DataFrame, labels: DataFrame, sample: int, folds: int) -> DataFrame:
    """``doc_id, toxic, text`` of at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _feature_counts(rows: DataFrame) -> DataFrame:
    """``feature, pos, neg``: sampled texts of each label that hold a feature."""

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            names, text, feature = _pairs(column(batch, "text"))
            toxic = column(batch, "toxic").to_numpy(zero_copy_only=False) == 1
            pos = np.bincount(feature[toxic[text]], minlength=len(names))
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.string()), pa.array(pos, pa.int64()),
                pa.array(np.bincount(feature, minlength=len(names)) - pos, pa.int64())], ["feature", "pos", "neg"])

    return rows.mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _design(rows: DataFrame, index: dict[str, int]) -> DataFrame:
    """Per sampled text: label, its selected features, and those of its counterfactual (null if it names no group)."""

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            of = _relevant(column(batch, "text"), index, _SWAP)
            here = [[index[f] for f in sorted(text_features(w)) if f in index] for w in of]
            swapped = [{_SWAP.get(x, x) for x in w} for w in of]
            there = [[index[f] for f in sorted(text_features(w)) if f in index] if w != v else None for w, v in zip(swapped, of)]
            yield pa.RecordBatch.from_arrays([
                column(batch, "toxic").cast(pa.int32()), pa.array(here, pa.list_(pa.int32())), pa.array(there, pa.list_(pa.int32()))],
                ["toxic", "here", "there"])

    return rows.mapInArrow(run, "toxic int, here array<int>, there array<int>")


def _entries(lists) -> tuple[np.ndarray, np.ndarray]:
    counts = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists)), counts), np.array([i for x in lists for i in x], np.int64)


def solve(here: list, there: list, toxic: np.ndarray, size: int, penalty: float = PENALTY, ridge: float = RIDGE,
          steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss + ridge + penalty * mean squared change of the logit."""
    rows, cols = _entries(here)
    pairs = [(a, b) for a, b in zip(here, there) if b is not None]
    gone, came = _entries([a for a, _ in pairs]), _entries([b for _, b in pairs])
    n, m = len(here), max(1, len(pairs))
    w, b = np.zeros(size), float(np.log((toxic.sum() + 0.5) / (n - toxic.sum() + 0.5)))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / n
        grad = np.bincount(cols, error[rows], size) + 2 * ridge * w
        if pairs:
            change = np.bincount(came[0], w[came[1]], m) - np.bincount(gone[0], w[gone[1]], m)
            pull = 2 * penalty * change / m
            grad += np.bincount(came[1], pull[came[0]], size) - np.bincount(gone[1], pull[gone[0]], size)
        grad = np.append(grad, error.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        move = 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = FEATURES, folds: int = FOLDS, least: int = MIN_TEXTS,
        penalty: float = PENALTY) -> Model:
    """The model of ``docs`` (``doc_id, text``) as ``labels`` (``doc_id, toxic``) marks them."""
    ship(docs.sparkSession)
    rows = materialize(_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample, folds), "toxicity-sample")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return Model(40.0 if n1 else -40.0)
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    both = lambda a, b: F.col(a) * F.log(rate(a, n1 if a == "pos" else n0) / (
        (F.col("pos") + F.col("neg") + 0.5) / (n1 + n0 + 1.0)))
    gain = both("pos", n1) + both("neg", n0)  # log likelihood ratio of the feature
    best = (_feature_counts(rows).where(F.col("pos") + F.col("neg") >= least).select("feature", gain.alias("gain"))
            .where(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "feature").limit(size).collect())
    index = {r["feature"]: i for i, r in enumerate(best)}
    found = _design(rows, index).collect()
    toxic = np.array([r["toxic"] for r in found], float)
    w, b = solve([r["here"] for r in found], [r["there"] for r in found], toxic, len(index), penalty)
    return Model(float(b), {f: float(w[i]) for f, i in index.items()})


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    weight = model.weights
    z = np.array([model.intercept + sum(weight[f] for f in sorted(text_features(w)) if f in weight)
                  for w in _relevant(texts, weight)], float)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with a last column ``name``, the score of each whole text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c != text_col])
    rows = df.select(rest.alias("rest"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in pieces(batches, "text", SCORED):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(shared.value, column(batch, "text")), pa.float64())],
                                             [*batch.schema.names, "score"])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in df.columns], F.col("score").alias(name))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    model = fit(docs, labels, folds=folds, **options)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
