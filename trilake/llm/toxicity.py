"""Toxicity by a chain of linear classifiers over categories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.llm.common import small_batches

#: Seed words that tell which category a text labelled toxic belongs to.
SEEDS = {
    "insult": ("idiot", "moron", "clown", "loser", "stupid"),
    "contempt": ("scum", "trash", "worthless", "pathetic", "disgusting"),
}
#: In the order of the chain: a category without seed words, and the label itself, come last.
CATEGORIES = (*SEEDS, "other", "toxic")
#: Labelled rows of either class that the models are fitted on at most.
ROWS_PER_CLASS = 4_000
FOLDS = 3
FEATURES = 1 << 17
PENALTY = 0.005
STEPS, MEMORY = 25, 8
THRESHOLD = 0.5
SEED = 42


def terms(text: Column) -> Column:
    """The different words of a text in lower case, and the first four letters of longer
    ones, which catch words made from one stem."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    stems = F.transform(F.filter(words, lambda w: F.length(w) > 4), lambda w: F.concat(F.substring(w, 1, 4), F.lit("*")))
    return F.concat(words, F.array_distinct(stems))


def features(found: Column) -> Column:
    return F.transform(found, lambda t: F.pmod(F.xxhash64(t), F.lit(FEATURES)).cast("int"))


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> DataFrame:
    """doc_id, base (features) and category labels of at most `rows_per_class` toxic and as
    many other labelled documents, those with the smallest hashes of their ids."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = (F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
    chosen = [known.where(F.col("label") == c).orderBy(*order).limit(rows_per_class) for c in (0, 1)]
    # bounded by 2 * rows_per_class pairs of numbers
    chosen = F.broadcast(chosen[0].union(chosen[1]))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    rows = rows.select("doc_id", "label", terms(F.col("text")).alias("terms"))
    toxic = F.col("label") == 1
    kinds = {c: toxic & F.arrays_overlap("terms", F.array(*map(F.lit, words))) for c, words in SEEDS.items()}
    seeded = F.lit(False)
    for found in kinds.values():
        seeded = seeded | found
    kinds |= {"other": toxic & ~seeded, "toxic": toxic}
    return rows.select("doc_id", features(F.col("terms")).alias("base"), *[kinds[c].cast("int").alias(f"is_{c}") for c in CATEGORIES])


class Rows:
    """Sparse rows of ones, as numbers of features and where each row starts."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray) -> None:
        self.values, self.offsets = values, offsets
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    @classmethod
    def of(cls, column: pa.ListArray) -> Rows:
        offsets = column.offsets.to_numpy().astype(np.int64)
        return cls(column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0])

    def times(self, weights: np.ndarray) -> np.ndarray:
        summed = np.r_[0.0, np.cumsum(weights[self.values])]
        return summed[self.offsets[1:]] - summed[self.offsets[:-1]]

    def transposed_times(self, of_rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.values, of_rows[self.row], FEATURES)


def probability(rows: Rows, earlier: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """`weights`: of the features, of the earlier probabilities, and the constant."""
    margin = rows.times(weights[:FEATURES]) + earlier @ weights[FEATURES:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def evidence(rows: Rows, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """How much each feature tells the classes apart: the size of the log ratio of its
    rates in them, smoothed by two rows shared as the classes are."""
    n_yes, n_no = max(1, int(yes.sum())), max(1, int(no.sum()))
    prior = n_yes / (n_yes + n_no)
    rate_yes = (rows.transposed_times(yes.astype(float)) + 2 * prior) / n_yes
    rate_no = (rows.transposed_times(no.astype(float)) + 2 * (1 - prior)) / n_no
    return np.abs(np.log(rate_yes / rate_no))


def fit(rows: Rows, earlier: np.ndarray, label: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Logistic regression by L-BFGS over the rows `used`; each class weighs the same.

    A feature counts as much as its evidence, so that the few words that matter are found
    among many that don't; the weights that come back hold that factor already.
    """
    yes, no = (label == 1) & used, (label == 0) & used
    share = 0.5 * yes / max(1, int(yes.sum())) + 0.5 * no / max(1, int(no.sum()))
    scale = np.r_[evidence(rows, yes, no), np.ones(earlier.shape[1] + 1)]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        p = probability(rows, earlier, w * scale)
        value = -(share * np.log(np.where(label == 1, p, 1 - p))).sum() + PENALTY / 2 * (w[:-1] @ w[:-1])
        error = share * (p - label)
        slope = scale * np.r_[rows.transposed_times(error), earlier.T @ error, error.sum()]
        slope[:-1] += PENALTY * w[:-1]
        return value, slope

    w = np.zeros(FEATURES + earlier.shape[1] + 1)
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step, factors = slope.copy(), []
        for s, y in reversed(past):
            factors.append(s @ step / (s @ y))
            step -= factors[-1] * y
        if past:
            step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), factor in zip(past, reversed(factors)):
            step += (factor - y @ step / (s @ y)) * s
        size, down = 1.0, slope @ step
        while True:
            new_value, new_slope = loss(w - size * step)
            if new_value <= value - 1e-4 * size * down or size < 1e-6:
                break
            size /= 2
        moved, bent = -size * step, new_slope - slope
        w, improved = w + moved, value - new_value
        value, slope = new_value, new_slope
        if moved @ bent > 1e-12:
            past = [*past, (moved, bent)][-MEMORY:]
        if improved < 1e-5:
            break
    return w * scale


def fit_chain(rows: Rows, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Weights for each category. A model must see the earlier probabilities in training as
    it will when scoring, so these come from models fitted without the row's fold."""
    weights, earlier = [], np.zeros((len(labels), 0))
    everything = np.ones(len(labels), bool)
    for i in range(len(CATEGORIES)):
        weights.append(fit(rows, earlier, labels[:, i], everything))
        if i + 1 < len(CATEGORIES):
            held_out = np.zeros(len(labels))
            for f in range(FOLDS):
                model = fit(rows, earlier, labels[:, i], folds != f)
                held_out = np.where(folds == f, probability(rows, earlier, model), held_out)
            earlier = np.c_[earlier, held_out]
    return weights


def trained(training: DataFrame) -> list[np.ndarray]:
    """The chain's weights, fitted in one task on the bounded sample; empty without rows."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        # in the order of ids, so that reruns fit the same model
        table = pa.Table.from_batches(parts).sort_by("doc_id").combine_chunks()
        rows = Rows.of(table.column("base").chunk(0))
        labels = np.stack([table.column(f"is_{c}").to_numpy() for c in CATEGORIES], axis=1).astype(float)
        folds = np.arange(len(labels)) % FOLDS
        weights = fit_chain(rows, labels, folds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(weights)), pa.int32()), pa.array(weights, pa.list_(pa.float64()))], ["place", "weights"]
        )

    found = training.coalesce(1).mapInArrow(train, "place int, weights array<double>").collect()
    return [np.array(r.weights) for r in sorted(found)]


def toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_insult, p_contempt, p_other, p_toxic and toxic of each document.

    The chain predicts the categories in turn; each model gets the words and the
    probabilities of the earlier ones. It is fitted on a bounded sample of `labels`
    (doc_id, toxic); categories of labelled texts come from seed words.

    Null and empty texts have no words and get the models' base rates. Labels with nulls
    are left out; of several labels of a document the toxic one counts. Without labelled
    documents all probabilities are null and no document is toxic. Repeated rows are
    scored alike; other columns are ignored; an empty table gives no rows.
    """
    names = [f"p_{c}" for c in CATEGORIES]
    spark = docs.sparkSession
    small_batches(spark)
    weights = trained(training_rows(docs, labels, rows_per_class))
    if not weights:
        return docs.select("doc_id", *[F.lit(None).cast("double").alias(n) for n in names], F.lit(False).alias("toxic"))
    shared = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows.of(batch.column(1))
            earlier = np.zeros((batch.num_rows, 0))
            for model in shared.value:
                earlier = np.c_[earlier, probability(rows, earlier, model)]
            rounded = [pa.array(np.round(p, 6)) for p in earlier.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rounded], ["doc_id", *names])

    based = docs.select("doc_id", features(terms(F.col("text"))).alias("base"))
    kind = based.schema["doc_id"].dataType.simpleString()
    scored = based.mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names))
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)
