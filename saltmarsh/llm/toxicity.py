"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their first bytes, hashed into a fixed number of
slots. The score is a logistic function of a bias, a weight per term and the products
of the terms' factors for every pair of terms in the text, so two terms can mean more
together than their weights add up to.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``), drawn
by a hash of the id. All terms of the sample take part; none is left out for want of
a tie of its own to the label. Weights and factors start at zero and leave it, in any
round, once their gradient exceeds what chance gives a term of so many rows; then they
are fitted and shrunk together.
Gradients alone would not find a rare pair among many common terms, for at zero the
factors see the sum of all pairs. So the factors start from the pairs themselves: what
the weights leave unexplained is added up for all pairs of words, and the pairs that stand
out give a matrix whose leading eigenvectors are the first factors. Scoring takes one
pass over whole texts without a shuffle.

Null and empty texts, and texts without a known term, get the score of the bias.
Rows are scored each, repeated ones alike. Labels that are null are left out;
of several labels of one id the highest counts. Without labels of both classes
every score is the share of toxic labels (0 without labels). Other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from saltmarsh.llm.words import mix, word_hashes
from saltmarsh.llm.worker import give_back, slices

# Labelled rows that a model is fitted on, at most about so many.
SAMPLE_ROWS = 8_000
FOLDS = 5
PREFIXES = (4, 5, 6)
SLOT_BITS = 18
# Factors per term.
FACTORS = 4
# A term leaves zero when its gradient exceeds so many deviations of chance.
CHANCE = 4.0
# Weights and factors shrink a little, so that a term needs evidence.
SHRINK = 2e-5
# The same for the residuals of a pair; there are far more pairs than terms.
PAIR_CHANCE = 5.5
# Hashed slots in which the residuals of pairs are added up before the pairs that stand out are taken one by one.
PAIR_BITS = 22
# Pairs that are handled at a time.
PAIRED = 1 << 18
# (row, term) pairs whose gradient is added up at a time.
ADDED = 1 << 19


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray  # one per slot
    factors: np.ndarray  # one row per slot

    def scores(self, rows: np.ndarray, slots: np.ndarray, count: int) -> np.ndarray:
        """Scores of ``count`` texts from (row, slot) pairs, each once."""
        return _logistic(_margin(self.bias, self.weights, self.factors, rows, slots, count)[0])


def constant(bias: float) -> Model:
    size = 1 << SLOT_BITS
    return Model(bias, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))


def term_slots(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _margin(bias, weights, factors, rows, terms, count):
    linear = np.bincount(rows, weights[terms], count)
    sums = np.stack([np.bincount(rows, factors[terms, f], count) for f in range(factors.shape[1])], 1)
    squares = np.bincount(rows, (factors[terms] ** 2).sum(1), count)
    return bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def _block_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and whether it is a whole word, of all words and prefixes of a block of texts."""
    words, bounds, heads = word_hashes(column, PREFIXES)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    rows, hashes = [row], [words]
    for head in heads:
        rows.append(row[head != 0])
        hashes.append(head[head != 0])
    whole = np.zeros(sum(map(len, rows)), bool)
    whole[: len(words)] = True
    return np.concatenate(rows), term_slots(np.concatenate(hashes)), whole


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """The fold that no label is learnt from; a null id belongs to no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


class _Fit:
    """Penalised fit of weights and factors over the distinct (row, term) pairs of labelled texts."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, size: int, labels: np.ndarray) -> None:
        self.rows, self.terms, self.size, self.labels = rows, terms, size, labels
        share = float(labels.mean())
        self.seen = np.bincount(terms, minlength=size)
        # What chance gives the gradient of a term, as a deviation.
        self.noise = CHANCE * np.sqrt(self.seen * share * (1 - share)) / len(labels)
        self.bias, self.weights = np.array([np.log(share / (1 - share))]), np.zeros(size)
        self.factors = np.zeros((size, FACTORS))
        self.left = np.zeros(size, bool)

    def residuals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alive = (self.weights != 0) | self.factors.any(1)
        some = alive[self.terms]
        margin, sums = _margin(self.bias[0], self.weights, self.factors, self.rows[some], self.terms[some], len(self.labels))
        score = _logistic(margin)
        return self.labels - score, score * (1 - score), sums

    def gradient(self, rows: np.ndarray, terms: np.ndarray, number: int, factors: np.ndarray, wrong: np.ndarray, sums: np.ndarray):
        own, by_factor = np.zeros(number), np.zeros((number, FACTORS))
        for start in range(0, len(rows), ADDED):
            row, term = rows[start : start + ADDED], terms[start : start + ADDED]
            pulled = wrong[row]
            own += np.bincount(term, pulled, number)
            for f in range(FACTORS):
                by_factor[:, f] += np.bincount(term, pulled * sums[row, f], number)
        return own, by_factor - factors * own[:, None]

    def moved(self) -> np.ndarray:
        """Which terms have a gradient that is more than chance."""
        residual, _, sums = self.residuals()
        weight, factor = self.gradient(self.rows, self.terms, self.size, self.factors, -residual / len(self.labels), sums)
        reach = np.sqrt((sums**2).mean(0))
        strong = (np.abs(factor) > self.noise[:, None] * reach).any(1) if reach.any() else False
        return (np.abs(weight) > self.noise) | strong | self.factors.any(1)

    def descend(self, steps: int, rate: float, pairs: bool = False) -> None:
        """Adam over the terms that have left zero; every quarter of the steps looks for more of them."""
        for _ in range(4):
            self.left |= self.moved()
            chosen = np.flatnonzero(self.left)
            number = np.full(self.size, -1)
            number[chosen] = np.arange(len(chosen))
            some = number[self.terms] >= 0
            rows, terms = self.rows[some], number[self.terms[some]]
            parameters = [self.bias.copy(), self.weights[chosen], self.factors[chosen]]
            first = [np.zeros_like(p) for p in parameters]
            second = [np.zeros_like(p) for p in parameters]
            for step in range(1, steps // 4 + 1):
                margin, sums = _margin(parameters[0][0], parameters[1], parameters[2], rows, terms, len(self.labels))
                wrong = (_logistic(margin) - self.labels) / len(self.labels)
                weight, factor = self.gradient(rows, terms, len(chosen), parameters[2], wrong, sums)
                gradients = [np.array([wrong.sum()]), weight + SHRINK * parameters[1], factor + SHRINK * parameters[2]]
                for p, g, m, v in list(zip(parameters, gradients, first, second))[: 3 if pairs else 2]:
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.bias = parameters[0]
            self.weights[chosen], self.factors[chosen] = parameters[1], parameters[2]

    def start_factors(self, words: np.ndarray) -> None:
        """First factors from the pairs of words whose residuals stand out; ``words`` marks the pairs of a row and a whole word."""
        pairs = outstanding_pairs(self.rows[words], self.terms[words], *self.residuals()[:2])
        if not len(pairs[0]):
            return
        left, right, strength = pairs
        used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        a, b = place[: len(left)], place[len(left) :]
        # Leading eigenvectors of the symmetric matrix by subspace iteration; the shift keeps positive ones ahead.
        base = np.random.default_rng(7).normal(size=(len(used), min(len(used), FACTORS + 4)))
        shift = np.bincount(np.append(a, b), np.append(strength, strength)).max()

        def times(x: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(a, strength * c[b], len(used)) + np.bincount(b, strength * c[a], len(used)) for c in x.T], 1)

        for _ in range(60):
            base, _ = np.linalg.qr(times(base) + shift * base)
        values, turn = np.linalg.eigh(base.T @ times(base))
        vectors, values = (base @ turn)[:, ::-1], values[::-1]
        for f in range(min(FACTORS, len(values))):
            if values[f] > 0:
                # Twice, since a term is no pair with itself and the diagonal stays unused.
                self.factors[used, f] = np.sqrt(2 * values[f]) * vectors[:, f]


def _row_pairs(rows: np.ndarray, terms: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, lesser and greater terms of all pairs in the chosen rows, some at a time; pairs of a row lie in term order."""
    starts = np.searchsorted(rows, np.append(chosen, chosen + 1)).reshape(2, -1)
    for row, low, high in zip(chosen, *starts):
        own = terms[low:high].astype(np.int64)
        step = max(1, PAIRED // max(1, len(own)))
        for first in range(0, len(own) - 1, step):
            last = min(first + step, len(own) - 1)
            count = len(own) - 1 - np.arange(first, last)
            left = np.repeat(np.arange(first, last), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            yield row, own[left], own[right]


def outstanding_pairs(rows: np.ndarray, terms: np.ndarray, residual: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of terms whose rows are far more toxic than the model says, with the step that would mend it.

    Rows and, in a row, terms ascend. Only a row that is more toxic than its score can bring a pair
    forward. Sums in hashed slots leave few pairs; these are added up one by one.
    """
    size = 1 << PAIR_BITS

    def slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix((left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)

    present = np.unique(rows)
    raised = present[residual[present] > 0.3]
    table = np.zeros(size, np.float32)
    for row, left, right in _row_pairs(rows, terms, raised):
        np.add.at(table, slot(left, right), np.float32(residual[row]))
    # A pair of n toxic rows cannot stand out with less than this.
    hopeful = table >= 2.0
    del table
    total, chance = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for row, left, right in _row_pairs(rows, terms, present):
        at = slot(left, right)
        at = at[hopeful[at]]
        np.add.at(total, at, np.float32(residual[row]))
        np.add.at(chance, at, np.float32(spread[row]))
    standing = hopeful & (total > 0.5 * PAIR_CHANCE * np.sqrt(chance + 1e-9))
    del total, chance, hopeful
    found = [np.unique((left[keep] << 32) + right[keep]) for _, left, right in _row_pairs(rows, terms, raised) if (keep := standing[slot(left, right)]).any()]
    names, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
    names = names[times >= 3]
    sums, weigh = np.zeros(len(names)), np.zeros(len(names))
    for row, left, right in _row_pairs(rows, terms, present) if len(names) else ():
        keep = standing[slot(left, right)]
        key = (left[keep] << 32) + right[keep]
        at = np.minimum(np.searchsorted(names, key), len(names) - 1)
        at = at[names[at] == key]
        sums[at] += residual[row]
        weigh[at] += spread[row]
    kept = sums > PAIR_CHANCE * np.sqrt(weigh + 1e-9)
    names, strength = names[kept], np.minimum(sums[kept] / (weigh[kept] + 0.5), 6.0)
    return names >> 32, names & 0xFFFFFFFF, strength


def fit_arrays(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, words: np.ndarray | None = None, steps: int = 240, rate: float = 0.05) -> Model:
    """A model from the distinct (row, slot) pairs of labelled texts; ``words`` marks slots of whole words, all if not given."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return constant(-35.0 if share == 0 else 35.0)
    words = np.ones(len(rows), bool) if words is None else words
    if not ((rows[1:] > rows[:-1]) | ((rows[1:] == rows[:-1]) & (slots[1:] > slots[:-1]))).all():
        order = np.lexsort((slots, rows))
        rows, slots, words = rows[order], slots[order], words[order]
    seen = np.bincount(slots, minlength=1 << SLOT_BITS) > 0
    used = np.flatnonzero(seen)
    terms = (np.cumsum(seen, dtype=np.int32) - np.int32(1))[slots]
    del slots
    fit = _Fit(rows.astype(np.int32), terms, len(used), labels)
    fit.descend(steps, rate)
    # What the weights leave unexplained is left to pairs.
    fit.start_factors(words)
    fit.descend(steps, rate, pairs=True)
    model = constant(float(fit.bias[0]))
    model.weights[used], model.factors[used] = fit.weights, fit.factors
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on labelled rows outside the held-out fold; labels decide nothing else."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.col(label).cast("double")).alias("label"))
    )
    total = known.count()
    part = min(1.0, sample_rows / max(1, total))
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / float(1 << 20)
    # About ``sample_rows`` rows of two numbers: this bound holds for any corpus.
    sample = F.broadcast(known.filter(unit < part))
    rows = docs.select(F.col(key).alias("key"), F.lower(text).alias("text")).join(sample, "key").select("key", "label", "text")
    rows = rows.dropDuplicates(["key"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, 2):
                row, slot, whole = _block_terms(block.column(2))
                # A slot counts once in a text; as a word if it is one there.
                order = np.lexsort((~whole, slot, row))
                row, slot, whole = row[order], slot[order], whole[order]
                if len(row):
                    new = np.append(True, (np.diff(row) != 0) | (np.diff(slot) != 0))
                    row, slot, whole = row[new], slot[new], whole[new]
                offsets = np.searchsorted(row, np.arange(block.num_rows + 1))
                found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((2 * slot + whole).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), found], ["key", "label", "terms"])

    key_type = docs.schema[key].dataType
    found_schema = T.StructType(
        [T.StructField("key", key_type), T.StructField("label", T.DoubleType()), T.StructField("terms", T.ArrayType(T.IntegerType()))]
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            model = constant(-35.0)
        else:
            table = table.sort_by("key").combine_chunks()
            lists = table.column("terms").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(table.num_rows, dtype=np.int32), sizes)
            coded = lists.flatten().to_numpy()
            slots, words, labels = coded >> 1, (coded & 1).astype(bool), table.column("label").to_numpy()
            del lists, coded, table, held
            model = fit_arrays(rows, slots, labels, words)
            del rows, slots, labels, words
        raw = np.concatenate([[model.bias], model.weights, model.factors.reshape(-1)]).astype("<f4").tobytes()
        del model
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["model"])

    # The sample is bounded, so one task can hold it; so is the model, a few numbers per slot.
    trained = rows.mapInArrow(terms, found_schema).repartition(1).mapInArrow(train, "model binary").first()
    values = np.frombuffer(bytes(trained["model"]), "<f4") if trained else np.full(1, -35.0)
    size = 1 << SLOT_BITS
    return Model(float(values[0]), values[1 : size + 1], values[size + 1 :].reshape(size, FACTORS)) if len(values) > 1 else constant(float(values[0]))


def _scoring(model: Model, names: list[str], place: int, drop: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alive = (model.weights != 0) | model.factors.any(1)
        for batch in batches:
            for block in slices(batch, place, 1 << 20):
                row, slot, _ = _block_terms(block.column(place))
                known = alive[slot]
                pairs = np.unique((row[known] << SLOT_BITS) + slot[known])
                score = model.scores(pairs >> SLOT_BITS, pairs & ((1 << SLOT_BITS) - 1), block.num_rows)
                arrays = [c for i, c in enumerate(block.columns) if not (drop and i == place)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(score)], names)

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, from 0 to 1, of every row."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    rows = docs.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    return rows.mapInArrow(_scoring(model, ["key", "score"], 1, True), schema).withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The same columns, rows scored below the threshold."""
    taken = set(docs.columns)
    lowered, scored = ("_" * (1 + max(map(len, taken), default=0)) + name for name in ("text", "score"))
    rows = docs.withColumn(lowered, F.lower(text))
    schema = T.StructType([*docs.schema.fields, T.StructField(scored, T.DoubleType())])
    found = rows.mapInArrow(_scoring(model, [*docs.columns, scored], len(docs.columns), True), schema)
    return found.filter(F.col(scored) < threshold).drop(scored)
