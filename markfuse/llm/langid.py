"""Language identification by error-correcting output codes.

Each learned language has a codeword; one binary classifier for each bit predicts it from hashed byte
trigrams of the whole text (logistic regression on trigram shares, labels are never inputs). Decoding
weighs each bit's logistic loss by that bit's accuracy in training and picks the codeword of least
total loss; texts whose two best codewords lie close are flagged as ambiguous.

Up to five languages use the exhaustive code (2**(L-1) - 1 bits, distance 2**(L-2)); more use random
balanced codewords, the best of many draws by least distance.

Learning uses a bounded, documented sample: at most `sample` labelled rows in total, equally many for
each language, those of lowest hash of id and text. Trigram counts are made by the executors; the driver gets
at most sample x DIM numbers. Prediction is a vectorised pass over every whole text.

Defined cases: null texts and texts without a letter are `und` with score 0; null labels teach nothing;
with one learned language it is predicted for all texts with letters, with none learned all are `und`;
repeated rows and null ids are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markfuse.session import ship

from .common import LOWER, chunks

DIM = 1 << 14
NOTHING = "und"

_FOLD = LOWER.copy()
for _b in [*range(0, 65), *range(91, 97), *range(123, 128)]:
    _FOLD[_b] = 32  # whatever ASCII has besides letters


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # (DIM + 1) x bits; the last row is the bias
    trust: np.ndarray  # of each bit


def _trigrams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashed trigram at each byte; DIM where it would leave its text or holds no letter."""
    x = _FOLD[data].astype(np.uint32)
    out = np.full(len(x), DIM, np.int32)
    if len(x) >= 3:
        key = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
        h = ((key * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)
        h[key == 0x202020] = DIM
        out[:-2] = h
    for back in (1, 2):
        at = off[1:] - back
        out[at[at >= off[:-1]]] = DIM
    return out


def _counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for _, _, data, off in chunks(batch.column(1)):
                grams = _trigrams(data, off)
                for i in range(len(off) - 1):
                    found, times = np.unique(grams[off[i] : off[i + 1]], return_counts=True)
                    keep = found < DIM
                    at.append(found[keep].tolist())
                    n.append(times[keep].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))], ["lang", "at", "n"])

    return run


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """Codewords as rows of -1 and 1; all columns differ and none is constant."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if i == 0 else (1 if ((b >> (i - 1)) & 1) else -1) for b in range(bits)] for i in range(n)], float)
    rng, bits, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        c = np.sign(rng.permuted(np.tile(np.where(np.arange(n) % 2, 1.0, -1.0)[:, None], (1, bits)), axis=0))
        d = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        if d > far:
            best, far = c, d
    return best


def learn(docs: DataFrame, learn_if: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1200) -> Model:
    """Fit on a bounded sample of the rows with a label for which learn_if holds. Two scans of the texts:
    one counts, one takes. With more than `sample` languages the most frequent ones are learned (of
    equally frequent ones the first by name); the others are never predicted."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (learn_if if learn_if is not None else F.lit(True)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones((0, 0)), np.zeros((DIM + 1, 0)), np.ones(0))
    each = max(1, sample // len(langs))
    # a hash threshold thins each language to about twice its share (and some), then the lowest hashes are
    # taken; what is ranked is bounded by that, whatever the table's size. Repeated rows count once
    span = 1 << 30
    limits = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(span, span * (2 * each + 20) // n + 1))))
    thin = rows.where(F.pmod("h", F.lit(span)) < limits[F.col("lang")]).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(span)), "h"))
    chosen = thin.withColumn("rank", rank).where(F.col("rank") <= each)
    got = chosen.select("lang", "text").mapInArrow(_counts("string"), "lang string, at array<int>, n array<bigint>").toArrow()
    at, n = (got.column(c).combine_chunks() for c in ("at", "n"))
    size = np.diff(at.offsets.to_numpy())
    keep = np.flatnonzero(size > 0)
    used, place = np.unique(at.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.cumsum(size > 0) - 1, size)
    x = np.zeros((len(keep), len(used)), np.float32)
    x[row, place] = n.flatten().to_numpy()
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    y = np.array(got.column("lang").to_pylist(), object)[keep]
    codes = codebook(len(langs))
    target = codes[[langs.index(v) for v in y]].astype(np.float32) if len(x) else np.zeros((0, codes.shape[1]), np.float32)
    w, b = _logistic(x, target)
    weights = np.zeros((DIM + 1, codes.shape[1]), np.float32)
    weights[used], weights[DIM] = w, b
    right = ((x @ w + b) * target > 0).mean(0) if len(x) else np.ones(codes.shape[1])
    return Model(langs, codes, weights, np.clip(right, 0.05, 1.0))


def _logistic(x: np.ndarray, t: np.ndarray, rounds: int = 120, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression for each column of t (-1, 1), by accelerated gradient steps."""
    n, d = x.shape
    w, b = np.zeros((d, t.shape[1]), np.float32), np.zeros(t.shape[1], np.float32)
    if not n or not d:
        return w, b
    scale = 1.0 / max(1e-9, float((x * x).sum(1).mean()))
    v, vb, k = w.copy(), b.copy(), 0.0
    for i in range(rounds):
        g = -t / (1 + np.exp(np.clip((x @ v + vb) * t, -30, 30))) / n
        nw, nb = v - scale * 4 * (x.T @ g + penalty * v), vb - 1.0 * g.sum(0)
        k = i / (i + 3)
        v, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the codeword of least weighted logistic loss, its share of exp(-loss), and the margin
    to the second (a share too)."""
    n, count = len(margins), len(model.langs)
    if count == 1 or not model.codes.shape[1]:
        return np.zeros(n, int), np.ones(n), np.ones(n)
    loss = np.stack([(model.trust * np.logaddexp(0, -margins * c)).sum(1) for c in model.codes], 1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    two = np.sort(p, 1)[:, -2:]
    return best, two[:, 1], two[:, 1] - two[:, 0]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", unsure: float = 0.05, extra: dict[str, Column] | None = None, with_text: bool = False) -> DataFrame:
    """id, the extra columns, lang_pred, score, ambiguous (margin below `unsure`) for every row and, if
    asked for, judged_text: the text, null as empty."""
    ship(docs.sparkSession)
    extra = extra or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in extra.items()), text.rlike(r"\p{L}").alias("letter"), text.alias("text"))
    keys = slim.columns[:-2]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (DIM + 1) x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, NOTHING], object)
        rows = m.weights.astype(np.float64)
        bias = rows[DIM].copy()
        rows[DIM] = 0
        for batch in batches:
            letter = batch.column(len(keys)).to_numpy(zero_copy_only=False).astype(bool)
            at, score, margin = (np.zeros(batch.num_rows, k) for k in (int, float, float))
            for a, b, data, off in chunks(batch.column(len(keys) + 1)):
                if not m.langs:
                    break
                # sums of weights per text by differences of running sums
                grams = _trigrams(data, off)
                count = np.append(0, np.cumsum(grams < DIM))
                size = count[off[1:]] - count[off[:-1]]
                total = np.zeros((b - a, rows.shape[1]))
                for k in range(rows.shape[1]):
                    run_sum = np.append(0.0, np.cumsum(rows[:, k][grams]))
                    total[:, k] = run_sum[off[1:]] - run_sum[off[:-1]]
                margins = total / np.maximum(size, 1)[:, None] + bias
                at[a:b], score[a:b], margin[a:b] = decode(margins, m)
            sure = letter & bool(m.langs)
            out = [pa.array(names[np.where(sure, at, len(m.langs))], pa.string()), pa.array(np.where(sure, score, 0.0)), pa.array(sure & (margin < unsure))]
            if with_text:
                out.append(batch.column(len(keys) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *out], [*keys, "lang_pred", "score", "ambiguous", *["judged_text"] * with_text])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keys).schema)
    return slim.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean" + ", judged_text string" * with_text)
