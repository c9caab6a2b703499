"""Toxicity by a classifier chain (operator 9).

Categories are predicted one after another by linear models on hashed words and word beginnings; each
later model also gets the earlier categories' probabilities.  For its training those are out-of-fold
predictions, so a later model learns from probabilities as unsure as those it will see.  Models are
fitted on the driver from a sample of labelled rows that is bounded in rows and bytes (``max_labelled``,
``max_bytes``, by hash of the id); the
threshold, too, comes from out-of-fold predictions.  Scoring is one pass over whole texts with a table of weights of
a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import only, stored, text_of
from weftgraph.llm.wordhash import Words, slices

#: Feature ids have this many bits.
BITS = 20
#: Beginnings of words, in bytes, that are features besides the whole word.
STEMS = (4, 5, 6, 8)
#: Bytes of feature ids that models are fitted on, four an id: what the driver gets at most.
MAX_BYTES = 128 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature id) of every word and stem of a slice, repeats included."""
    w = Words(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    owners, ids = [owner], [w.hash]
    for n in STEMS:
        long = np.flatnonzero(w.end - w.start > n)
        owners.append(owner[long])
        ids.append(w.beginning_hash(w.start[long], n))
    return np.concatenate(owners), (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Sample:
    """Documents as one array of feature ids; ``owner`` says whose each is.  Ids of a document are distinct."""

    ids: np.ndarray  # int32
    owner: np.ndarray  # int32
    n: int

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sample:
        ids = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
        return cls(ids, np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), len(rows))


@dataclass
class Linear:
    """A logistic model on the presence of ``ids`` and on the values of earlier categories."""

    ids: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def scores(self, sample: Sample, before: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.ids] = self.weights
        hit = np.flatnonzero(table[sample.ids])
        sums = np.bincount(sample.owner[hit], table[sample.ids[hit]], sample.n)
        return 1 / (1 + np.exp(-np.clip(sums + before @ self.earlier + self.bias, -30, 30)))


def fit(sample: Sample, use: np.ndarray, before: np.ndarray, y: np.ndarray, keep: int = 2000, least: int = 3, l2: float = 0.5, steps: int = 300) -> Linear:
    """A model of ``y`` on the documents that ``use`` marks; features are screened by a two-proportion score."""
    n, pos = int(use.sum()), int(y[use].sum())
    if not 0 < pos < n:
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), 8.0 if n and pos else -8.0)
    df, df1 = (np.bincount(sample.ids[mask[sample.owner]], minlength=1 << BITS).astype(np.float32) for mask in (use, use & (y > 0)))
    share = (df + 1) / (n + 2)
    score = np.abs(df1 / pos - (df - df1) / (n - pos)) / np.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos)))
    score[df < least] = 0
    ids = np.sort(np.argsort(-score, kind="stable")[:keep])
    ids = ids[score[ids] > 3]
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    hit = np.flatnonzero((place[sample.ids] >= 0) & use[sample.owner])
    owner, at = sample.owner[hit], place[sample.ids[hit]]
    k, m = len(ids), before.shape[1]
    w, b = np.zeros(k + m), float(np.log(pos / (n - pos)))
    first, second = np.zeros(k + m + 1), np.zeros(k + m + 1)
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(owner, w[at], sample.n) + before @ w[k:] + b
        error = np.where(use, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0.0)
        g = np.concatenate([np.bincount(at, error[owner], k) + l2 * w[:k], before.T @ error + l2 * w[k:], [error.sum()]]) / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Linear(ids, w[:k], w[k:], b)


def fit_chain(sample: Sample, labels: np.ndarray, folds: np.ndarray) -> tuple[list[Linear], np.ndarray]:
    """The models of the columns of ``labels`` in order, and all out-of-fold predictions."""
    n, k = labels.shape
    held = np.zeros((n, k))
    models = []
    for c in range(k):
        y, before = labels[:, c].astype(float), held[:, :c]
        for f in np.unique(folds):
            out = folds == f
            if out.all():  # a single fold has nothing else to learn from
                held[:, c] = y.mean()
                continue
            held[out, c] = fit(sample, ~out, before, y).scores(sample, before)[out]
        models.append(fit(sample, np.ones(n, bool), before, y))
    return models, held


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap with the best F1 on held-out predictions; above 1 where nothing is positive."""
    if not len(y) or not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    q, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][q[:-1] == q[1:]] = -1
    i = int(f1.argmax())
    return float((q[i] + (q[i + 1] if i + 1 < len(q) else 0)) / 2)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int) -> DataFrame:
    """(_weft_h, label_0, label_1, ..., _weft_features) of at most ``max_labelled`` labelled documents, chosen by a hash of the id.

    Labels are in the order of the columns of ``labels``; of rows that share an id the least one by labels and features counts.
    """
    columns = [c for c in labels.columns if c != id_col]
    ints = [f"label_{i}" for i in range(len(columns))]
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_weft_id"))
    sample = marks.agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).cast("int").alias(n) for c, n in zip(columns, ints)]).orderBy(F.xxhash64("_weft_id"), "_weft_id").limit(max_labelled)
    own = only(docs, id_col, text_col).select(F.col(id_col).alias("_weft_id"), text_of(text_col).alias("_weft_text"))
    chosen = own.join(F.broadcast(sample), "_weft_id").select("_weft_id", *ints, "_weft_text")  # at most max_labelled short rows
    kind = dict(chosen.dtypes)["_weft_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, data, offsets in slices(batch.column(batch.num_columns - 1)):
                owner, ids = features(data, offsets)
                pair = np.unique((owner << BITS) | ids)
                cuts = np.searchsorted(pair >> BITS, np.arange(len(offsets)))
                low = (pair & ((1 << BITS) - 1)).astype("<i4")
                out += [low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "_weft_features"])

    found = chosen.mapInArrow(run, f"_weft_id {kind}, " + "".join(f"{n} int, " for n in ints) + "_weft_features binary")
    least = F.min(F.struct(*ints, "_weft_features")).alias("_weft_row")
    return found.groupBy("_weft_id").agg(least).select(F.xxhash64("_weft_id").alias("_weft_h"), "_weft_row.*")


@dataclass
class Chain:
    """Fitted models by category, in the chain's order, and what decides: the last category's threshold.

    ``held`` and ``labels`` are the sample's out-of-fold predictions and its labels.
    """

    names: list[str]
    models: list[Linear]
    threshold: float
    held: np.ndarray
    labels: np.ndarray


def bounded(rows: DataFrame, max_bytes: int) -> DataFrame:
    """``labelled_rows`` in the order of their hash as far as their features are ``max_bytes`` in all."""
    rows = stored(rows, "labelled")
    upto = Window.orderBy("_weft_h")  # two numbers for each of at most max_labelled rows
    sizes = rows.select("_weft_h", F.sum(F.octet_length("_weft_features")).over(upto).alias("_weft_bytes"))
    cut = sizes.where(F.col("_weft_bytes") > max_bytes).agg(F.min("_weft_h")).first()[0]
    return rows if cut is None else rows.where(F.col("_weft_h") < cut)


def train(
    docs: DataFrame, labels: DataFrame, decide: str, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 10_000, n_folds: int = 5, max_bytes: int = MAX_BYTES
) -> Chain:
    """Fit the chain of the 0/1 columns of ``labels``, which also has the id; ``decide`` comes last.

    The bounded sample is what the driver gets: at most ``max_labelled`` rows with feature ids of at most
    ``max_bytes`` in all.  A document whose own features are more than that is never learned from.
    """
    names = [*(c for c in labels.columns if c not in (id_col, decide)), decide]
    got = bounded(labelled_rows(docs, labels.select(id_col, *names), id_col, text_col, max_labelled), max_bytes).toArrow()
    h = got.column("_weft_h").to_numpy()
    raw = got.column("_weft_features")
    order = np.argsort(h, kind="stable")
    y = np.stack([got.column(f"label_{i}").to_numpy()[order] > 0 for i in range(len(names))], axis=1) if len(h) else np.zeros((0, len(names)), bool)
    sample = Sample.of([np.frombuffer(raw[int(i)].as_py(), "<i4") for i in order])
    if not sample.n:
        none = [Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(c), -8.0) for c in range(len(names))]
        return Chain(names, none, 1.1, np.zeros((0, len(names))), y)
    folds = h[order] % n_folds
    del got, raw
    models, held = fit_chain(sample, y, folds)
    return Chain(names, models, best_threshold(held[:, -1], y[:, -1].astype(float)), held, y)


def _scorer(chain: Chain) -> tuple[np.ndarray, list[tuple[np.ndarray, float]]]:
    """What scoring needs, of a size fixed by the number of categories: a table of weights, and the rest."""
    table = np.zeros((len(chain.models), 1 << BITS), np.float32)
    for row, m in zip(table, chain.models):
        row[m.ids] = m.weights
    return table, [(m.earlier, m.bias) for m in chain.models]


def _probabilities(column: pa.Array, weights: np.ndarray, rest: list[tuple[np.ndarray, float]], used: np.ndarray) -> np.ndarray:
    """(texts, categories): each category's probability given those before it."""
    parts = []
    for _, data, offsets in slices(column):
        owner, ids = features(data, offsets)
        hit = used[ids]
        pair = np.unique((owner[hit] << BITS) | ids[hit])
        owner, ids = pair >> BITS, pair & ((1 << BITS) - 1)
        n = len(offsets) - 1
        p = np.zeros((n, len(rest)))
        for c, (earlier, bias) in enumerate(rest):
            z = np.bincount(owner, weights[c][ids], n) + p[:, :c] @ earlier + bias
            p[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        parts.append(p)
    return np.concatenate(parts) if parts else np.zeros((0, len(rest)))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., <decide>, kept) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(_scorer(chain))
    own = only(docs, id_col, text_col).select(F.col(id_col), text_of(text_col).alias("_text"))
    kind = own.schema[0].dataType.simpleString()
    columns = [f"p_{c}" for c in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rest = shipped.value
        used = (weights != 0).any(axis=0)
        for batch in batches:
            p = _probabilities(batch.column(1), weights, rest, used)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(len(rest)))], names=[id_col, *columns])

    found = own.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{c}` double" for c in columns))
    bad = F.col(columns[-1]) >= F.lit(chain.threshold)
    return found.select("*", bad.alias(chain.names[-1]), (~bad).alias("kept"))


def without_rejected(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose text the chain rejects: one pass, no shuffle."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((_scorer(chain), chain.threshold))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, rest), threshold = shipped.value
        used = (weights != 0).any(axis=0)
        for batch in batches:
            text = pc.fill_null(batch.column(at), "")
            yield batch.filter(pa.array(_probabilities(text, weights, rest, used)[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def chain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The two categories that a table of (id, quality, toxic) gives: junk (quality 0), toxic."""
    return labels.select(id_col, (F.lit(1) - F.col("quality")).alias("junk"), F.col("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 10_000) -> DataFrame:
    """One row per row of ``docs``: id, p_junk, p_toxic, toxic, kept.

    Null, empty and blank texts have no features and get the models' biases; very long ones are read
    whole.  Null labels count as 0, labels with a null id are left out, repeated labels of an id count as
    their maximum; of repeated documents one is learned from.  Without labels, or with none that is
    toxic, nothing is rejected.  Ids may be of any type that joins that of ``labels``; null ids are scored
    like others.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    return score(docs, train(docs, chain_labels(labels, id_col), "toxic", id_col, text_col, max_labelled), id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 10_000) -> DataFrame:
    """``docs``, all columns, without the rows that ``toxicity`` would not keep.

    Each row is judged by its own text: nulls, repeats, labels and an empty table are as for ``toxicity``.
    """
    return without_rejected(docs, train(docs, chain_labels(labels, id_col), "toxic", id_col, text_col, max_labelled), text_col)
