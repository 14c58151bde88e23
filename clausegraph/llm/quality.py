"""Quality scores by attention-based multiple-instance learning (operator 6).

A document is a bag of passages of 96 words. A passage is encoded by what its words look like (case, symbols, lengths,
repetition), a small layer turns that into a representation, gated attention weighs the passages, and the weighted sum is
scored. Only documents have labels; the attention learns from them which passages matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausegraph.llm.common import let_go, slices, small_batches, text_buffer
from clausegraph.llm.neardup import mix, word_hashes, word_spans

PASSAGE_WORDS, HIDDEN, ATTENTION = 96, 16, 8
#: Labelled documents that a model is fitted on at most, those of the smallest hashes; and their length in characters.
SAMPLE, SAMPLE_CHARS = 6000, 100_000
FEATURES = 18
_U = np.uint64
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def passages(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of features per passage, and offsets into them by text; a text without words has one passage of zeros."""
    data, offsets = text_buffer(values)
    starts, ends = word_spans(data, offsets)
    n_texts, n = len(offsets) - 1, len(starts)
    bounds = np.searchsorted(starts, offsets)
    count = np.diff(bounds)
    rows = np.maximum(1, -(-count // PASSAGE_WORDS))
    out_at = np.r_[0, np.cumsum(rows)]
    out = np.zeros((out_at[-1], FEATURES))
    if n == 0:
        return out, out_at
    text = np.repeat(np.arange(n_texts), count)
    within = np.arange(n) - bounds[text]
    row = out_at[text] + within // PASSAGE_WORDS
    size = (ends - starts).astype(float)
    total = lambda table: (lambda c: (c[ends] - c[starts]).astype(float))(np.r_[0, np.cumsum(table[data])])
    letters, upper, digits = total(_LETTER), total(_UPPER), total(_DIGIT)
    symbols = size - letters - digits
    hashes = word_hashes(data, starts, ends)
    same_text = np.r_[False, text[1:] == text[:-1]]
    own = mix(text.astype(np.uint64), 31)

    def seen(keys: np.ndarray) -> np.ndarray:
        """Whether a key came before in the same text."""
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), bool)
        again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        return again

    triple = hashes.copy()
    triple[1:] += hashes[:-1] * _U(3)
    triple[2:] += hashes[:-2] * _U(9)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new_line = np.r_[True, line[1:] != line[:-1]]
    columns = [
        np.ones(n), size, size * size, letters / size, (upper == letters) & (letters > 1), upper > 0, digits > 0,
        symbols / size, symbols >= 2, letters == 0, same_text & np.r_[False, hashes[1:] == hashes[:-1]], seen(hashes ^ own),
        seen(mix(triple, 33) ^ own) & (within >= 2), new_line, size >= 12, size <= 2, symbols == 0,
    ]
    for k, c in enumerate(columns):
        out[:, k] = np.bincount(row, c, minlength=len(out))
    filled = out[:, 0] > 0
    out[filled, 1:] /= out[filled, :1]
    out[:, 1] /= 10
    out[:, 2] /= 100
    out[:, 0] = np.log1p(out[:, 0]) / 5
    out[:, FEATURES - 1] = np.repeat(np.log1p(count), rows) / 10
    return out, out_at


@dataclass
class Model:
    """Weights; ``shift`` and ``scale`` standardise the features."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.shift) / self.scale, -6, 6)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        top = np.maximum.reduceat(e, bags[:-1])
        sizes = np.diff(bags)
        e = np.exp(e - np.repeat(top, sizes))
        attention = e / np.repeat(np.add.reduceat(e, bags[:-1]), sizes)
        z = np.add.reduceat(attention[:, None] * h, bags[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "attention": attention, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))}


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> Model:
    """Adam on the cross-entropy of document labels."""
    rng = np.random.default_rng(seed)
    start = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"W": start(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": start(HIDDEN, ATTENTION), "U": start(HIDDEN, ATTENTION), "a": start(ATTENTION), "c": start(HIDDEN), "d": np.zeros(1)}
    model = Model(x.mean(axis=0) if len(x) else np.zeros(FEATURES), x.std(axis=0) + 1e-3 if len(x) else np.ones(FEATURES), w)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    sizes, step = np.diff(bags), 0
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            rows = np.concatenate([np.arange(bags[i], bags[i + 1]) for i in pick])
            own = np.r_[0, np.cumsum(sizes[pick])]
            f = model.forward(x[rows], own)
            dz = np.outer(f["p"] - y[pick], w["c"]) / len(pick)
            each = np.repeat(dz, sizes[pick], axis=0)
            grad = {"c": f["z"].T @ (f["p"] - y[pick]) / len(pick), "d": np.array([(f["p"] - y[pick]).mean()])}
            da = (each * f["h"]).sum(axis=1)
            mean = np.repeat(np.add.reduceat(f["attention"] * da, own[:-1]), sizes[pick])
            de = f["attention"] * (da - mean)
            grad["a"] = (f["t"] * f["g"]).T @ de
            dt, dg = np.outer(de, w["a"]) * f["g"] * (1 - f["t"] ** 2), np.outer(de, w["a"]) * f["t"] * f["g"] * (1 - f["g"])
            grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
            dh = (f["attention"][:, None] * each + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
            grad["W"], grad["b"] = f["x"].T @ dh, dh.sum(axis=0)
            step += 1
            for k, g in grad.items():
                g = g + decay * w[k]
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents with a non-null ``labels.quality`` whose crc32(doc_id) mod 5 is not 0: those of
    the smallest hashes, and of them those up to ``SAMPLE_CHARS`` characters; rows that repeat a doc_id count as one, that of
    the smallest features. Without any, every score is one constant."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = known.distinct().orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "quality").limit(sample)
    # At most ``sample`` rows of 12 bytes.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, at = passages(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])], ["doc_id", "quality", "x"])

    encoded = rows.select("doc_id", "text", "quality").mapInArrow(encode, "doc_id long, quality int, x binary")
    got = encoded.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()  # at most ``sample`` rows
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(float) for r in got]
    return fit(np.concatenate(x) if x else np.zeros((0, FEATURES)), np.r_[0, np.cumsum([len(v) for v in x])].astype(int), np.array([float(r["quality"] > 0) for r in got]))


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``name``, 0 to 1, from the whole text alone. A null text counts as empty; a text without words
    is scored as one empty passage. Columns pass through, save one of that name, which is replaced."""
    kept = docs.drop(name)
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch, "text"):
                x, at = passages(part.column(part.schema.get_field_index("text")))
                p = pa.array(model.forward(x, at)["p"], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, p], [*part.schema.names, name])

    return kept.mapInArrow(scored, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 5 is 0; null for a null doc_id), score, predicted (1 from ``threshold`` up)."""
    model = learn(docs, labels)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return rows.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
