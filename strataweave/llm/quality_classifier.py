"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document is described by statistics of its whole text (shares of byte classes,
word and line shape, repetition).  The standardised statistics are mapped by
random Fourier features of a Gaussian kernel; each partition sums its part of the
normal equations, so that ridge scores are fitted over all training rows.  The
fold that the fit leaves out gives the isotonic calibration from binned scores.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never
learned from.  Of the rest, remainder 3 calibrates and the others fit the ridge.
Labels, lang, source and doc_id are never inputs of a score.

Defined results
* null and empty texts have the statistics of an empty text and get a score.
* a doc_id with several labels counts by its mean label; null labels are left out.
* repeated rows are scored one by one; an empty table gives an empty result.
* without usable labels of both kinds the score is 0.5 throughout.
* a null doc_id is never a training row.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, spool

FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
THRESHOLD = 0.7
FEATURES = 256
RIDGE = 1e-3
BINS = 2048
#: Partition sums that one task adds up.
FAN_IN = 32
SEED = 20240501
STATISTICS = [
    "log_length", "lower", "upper", "digit", "space", "newline", "mark", "symbol", "bang", "pipe", "wide",
    "log_words", "word_length", "distinct", "repeat_next", "shout_words", "symbol_words", "line_length", "same_lines",
]


def _classes() -> np.ndarray:
    """Byte -> class: lower, upper, digit, space, newline, mark, symbol, bang, pipe, wide."""
    out = np.full(256, 6, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-")):
        out[list(chars)] = k
    out[ord("!")] = 7
    out[ord("|")] = 8
    out[128:] = 9
    return out


CLASS_OF = _classes()


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    shares = np.bincount(CLASS_OF, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10) / n
    words = text.split()
    count = max(1, len(words))
    shout = sum(map(str.isupper, words)) / count
    plain = sum(map(str.isalpha, words)) / count
    lines = text.split("\n")
    return [
        np.log1p(len(raw)),
        *shares.tolist(),
        np.log1p(len(words)),
        min(30.0, len(text) / count),
        len(set(words)) / count,
        sum(map(str.__eq__, words, words[1:])) / count,
        shout,
        plain,
        np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fold (crc32 of doc_id as text, mod FOLDS; null for a null doc_id) and x, the statistics."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            folds = [None if i is None else zlib.crc32(str(i).encode()) % FOLDS for i in ids.to_pylist()]
            x = [statistics(t.as_py() or "") for t in texts]
            arrays = [ids, pa.array(folds, pa.int32()), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fold", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, fold int, x array<double>")


class Kernel:
    """Standardised statistics to random Fourier features of a Gaussian kernel, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        width = np.sqrt(len(mean))
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.gain = np.sqrt(2 / features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * self.gain, z, np.ones((len(z), 1))])


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(STATISTICS))


def _partition_sums(rows: DataFrame, part) -> np.ndarray | None:
    """Add up one flat array per partition, in a tree of sums, and bring the last few to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                v = np.frombuffer(v.as_py(), np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    arrays, n = rows.mapInArrow(part, "v binary"), rows.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        arrays = arrays.repartition(n).mapInArrow(add, "v binary")
    found = [np.frombuffer(r["v"], np.float64) for r in arrays.collect()]  # FAN_IN rows at most
    return sum(found[1:], found[0].copy()) if found else None


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 + 2 * len(STATISTICS))
    for batch in batches:
        x = _stack(batch.column("x"))
        total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
    yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})


def isotonic(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising means nearest to sums / weights, one for each bin."""
    blocks: list[list[float]] = []
    for w, s in zip(weights, sums):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    return np.concatenate([np.full(n, s / max(w, 1e-12)) for w, s, n in blocks]) if blocks else np.zeros(0)


class Model:
    def __init__(self, kernel: Kernel, beta: np.ndarray, knots: np.ndarray | None, values: np.ndarray | None):
        self.kernel, self.beta, self.knots, self.values = kernel, beta, knots, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.raw(x)
        if self.knots is None:
            return np.clip(s, 0, 1)
        # a slight slope keeps the order of raw scores inside a flat step
        return np.clip(0.998 * np.interp(s, self.knots, self.values) + 0.002 / (1 + np.exp(-s)), 0, 1)


def fit(rows: DataFrame, ridge: float = RIDGE) -> Model | None:
    """rows: fold, x, y (0 to 1).  None where there are not labels of both kinds."""
    train = rows.where(F.col("y").isNotNull() & F.col("fold").isNotNull() & (F.col("fold") != HELD_OUT))
    m = _partition_sums(train.select("x"), _moments)
    if m is None or m[0] < 2:
        return None
    d = len(STATISTICS)
    mean = m[1 : 1 + d] / m[0]
    scale = np.sqrt(np.maximum(m[1 + d :] / m[0] - mean**2, 0))
    kernel = Kernel(mean, np.where(scale > 1e-9, scale, 1.0))
    size = FEATURES + d + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, ys = np.zeros((size, size)), np.zeros(size), np.zeros(2)
        for batch in batches:
            x, y = _stack(batch.column("x")), batch.column("y").to_numpy()
            for k in range(0, len(x), 2048):
                f = kernel(x[k : k + 2048])
                a += f.T @ f
                b += f.T @ y[k : k + 2048]
            ys += [len(y), y.sum()]
        upper = a[np.triu_indices(size)]
        yield pa.RecordBatch.from_pydict({"v": [np.concatenate([upper, b, ys]).tobytes()]})

    fitted = _partition_sums(train.where(F.col("fold") != CALIBRATION).select("x", "y"), normal)
    if fitted is None or fitted[-2] == 0 or not 0 < fitted[-1] < fitted[-2]:
        return None
    a = np.zeros((size, size))
    a[np.triu_indices(size)] = fitted[: -size - 2]
    a = a + np.triu(a, 1).T
    beta = np.linalg.solve(a + ridge * fitted[-2] / size * np.eye(size), fitted[-size - 2 : -2])
    model = Model(kernel, beta, None, None)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((3, BINS))
        for batch in batches:
            s, y = model.raw(_stack(batch.column("x"))), batch.column("y").to_numpy()
            k = np.clip(((s + 1) / 3 * BINS).astype(int), 0, BINS - 1)
            for row, w in zip(out, (np.ones(len(s)), y, s)):
                row += np.bincount(k, w, BINS)
        yield pa.RecordBatch.from_pydict({"v": [out.tobytes()]})

    bins = _partition_sums(train.where(F.col("fold") == CALIBRATION).select("x", "y"), binned)
    if bins is not None and bins.sum() > 0:
        n, y, s = bins.reshape(3, BINS)
        full = n > 0
        model.knots, model.values = s[full] / n[full], isotonic(n[full], y[full])
    return model


def quality_classifier(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document; see the module docstring."""
    ship(docs.sparkSession)
    stats = spool(document_statistics(docs, id_col, text_col))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    model = fit(spool(stats.join(marks, "doc_id").select("fold", "x", "y")))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = model.score(_stack(batch.column("x")))
            held = pa.array([f == HELD_OUT for f in batch.column("fold").to_pylist()])
            arrays = [batch.column("doc_id"), held, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
