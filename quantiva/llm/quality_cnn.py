"""Quality classifier: a byte-level convolutional network in numpy.

A document is read as bytes.  Filters of WIDTH bytes, applied every STEP
bytes over the whole text, are max-pooled inside overlapping chunks of CHUNK
bytes (a new chunk every HOP bytes); the mean and the maximum of the chunks'
pooled values are combined by one logistic unit.

A filter is a product of byte embeddings and weights, so for prediction it
becomes one table of 256 rows for each of its bytes, and a convolution is a
sum of table rows.

The network is fitted on a bounded sample of labelled rows: for each class
``SAMPLE_DOCS`` documents in the order of a hash and ``SAMPLE_CHUNKS`` evenly
spaced chunks of each.  Scoring reads every byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, packed, text_column, unpacked

WIDTH, STEP, FILTERS, EMBED = 8, 4, 24, 8
CHUNK, HOP = 256, 128
SAMPLE_DOCS = 1500
SAMPLE_CHUNKS = 24
_PER_HOP = HOP // STEP


class Network:
    """Weights; ``fit`` trains them, ``tables`` prepares prediction."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, EMBED))
        self.filters = r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.weights = np.zeros(2 * FILTERS)
        self.offset = 0.0

    def tables(self) -> np.ndarray:
        """[WIDTH, 256, FILTERS]; the bias is in the first."""
        t = np.einsum("be,wef->wbf", self.embed, self.filters).astype(np.float32)
        t[0] += self.bias.astype(np.float32)
        return np.ascontiguousarray(t)

    def fit(self, chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = 14, docs_a_step: int = 48,
            rate: float = 0.01, seed: int = 11) -> None:
        """chunks [n, CHUNK] bytes, doc: number of each chunk's document (sorted), label by document."""
        r = np.random.default_rng(seed)
        state = {}
        first = np.searchsorted(doc, np.arange(len(label) + 1))
        half = {c: 0.5 / max(1, np.count_nonzero(label == c)) for c in (0, 1)}
        weight = np.where(label == 1, half[1], half[0]) * len(label)
        grid = np.arange((CHUNK - WIDTH) // STEP + 1) * STEP
        for epoch in range(epochs):
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = r.permutation(len(label))
            for a in range(0, len(order), docs_a_step):
                some = order[a:a + docs_a_step]
                n = first[some + 1] - first[some]
                some, n = some[n > 0], n[n > 0]
                if not len(some):
                    continue
                rows = np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                x = chunks[rows]
                t = self.tables()
                out = t[0][x[:, grid]]
                for j in range(1, WIDTH):
                    out += t[j][x[:, grid + j]]
                where = out.argmax(axis=1)                       # [chunks, FILTERS]
                top = np.take_along_axis(out, where[:, None, :], 1)[:, 0, :]
                pooled = np.tanh(top)
                starts = np.cumsum(n) - n
                mean = np.add.reduceat(pooled, starts, axis=0) / n[:, None]
                high = np.maximum.reduceat(pooled, starts, axis=0)
                z = np.concatenate([mean, high], 1)
                p = 1 / (1 + np.exp(-(z @ self.weights + self.offset)))
                g = ((p - label[some]) * weight[some] / len(some))
                dz = g[:, None] * self.weights[None, :]
                spread = np.repeat(np.arange(len(some)), n)
                dpool = dz[spread, :FILTERS] / n[spread][:, None]
                best = pooled >= high[spread] - 1e-7
                dpool += best * dz[spread, FILTERS:] / np.maximum(np.add.reduceat(best.astype(float), starts, axis=0), 1)[spread]
                dtop = dpool * (1 - pooled ** 2)
                dt = np.zeros((WIDTH, 256, FILTERS))
                f = np.broadcast_to(np.arange(FILTERS), where.shape)
                at = where * STEP
                chunk = np.arange(len(x))[:, None]
                for j in range(WIDTH):
                    flat = x[chunk, at + j].astype(np.int64) * FILTERS + f
                    dt[j] = np.bincount(flat.ravel(), dtop.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                grads = {"embed": np.einsum("wbf,wef->be", dt, self.filters) + 1e-5 * self.embed,
                         "filters": np.einsum("wbf,be->wef", dt, self.embed) + 1e-5 * self.filters,
                         "bias": dtop.sum(axis=0), "weights": z.T @ g + 1e-4 * self.weights, "offset": g.sum()}
                self._adam(grads, state, lr)

    def _adam(self, grads: dict, state: dict, rate: float) -> None:
        state["t"] = t = state.get("t", 0) + 1
        for name, g in grads.items():
            m, v = state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            state[name] = (m, v)
            setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8))


class Scorer:
    """Prediction over whole texts."""

    def __init__(self, net: Network):
        self.t, self.weights, self.offset = net.tables(), net.weights, net.offset

    def _pooled(self, raw: np.ndarray) -> np.ndarray:
        """Pooled values of the hops of one text [hops, FILTERS]; a chunk is two neighbouring hops."""
        n = max(1, -(-(len(raw) - WIDTH) // STEP) + 1) if len(raw) > WIDTH else 1
        x = np.zeros((n - 1) * STEP + WIDTH, np.uint8)  # zero bytes after the end, so that all bytes are covered
        x[: len(raw)] = raw
        parts = []
        for a in range(0, n, 64 * _PER_HOP):
            b = min(n, a + 64 * _PER_HOP)
            y = x[a * STEP: (b - 1) * STEP + WIDTH]
            out = self.t[0][y[: (b - a) * STEP: STEP]]
            for j in range(1, WIDTH):
                out += self.t[j][y[j: j + (b - a - 1) * STEP + 1: STEP]]
            parts.append(np.maximum.reduceat(out, np.arange(0, b - a, _PER_HOP), axis=0))
        return np.concatenate(parts)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.empty((len(offsets) - 1, 2 * FILTERS))
        for k in range(len(offsets) - 1):
            hops = self._pooled(raw[offsets[k]:offsets[k + 1]])
            chunks = np.tanh(np.maximum(hops[:-1], hops[1:]) if len(hops) > 1 else hops)
            z[k, :FILTERS], z[k, FILTERS:] = chunks.mean(axis=0, dtype=np.float64), chunks.max(axis=0)
        return 1 / (1 + np.exp(-(z @ self.weights + self.offset)))


def sample_chunks(texts: DataFrame) -> DataFrame:
    """(label, h, text) -> (label, h, chunks): at most SAMPLE_CHUNKS evenly spaced chunks of each text, as bytes."""

    def run(batches):
        for b in batches:
            raw, offsets = text_column(b, "text")
            out = []
            for k in range(b.num_rows):
                own = raw[offsets[k]:offsets[k + 1]]
                n = max(1, -(-(len(own) - CHUNK) // HOP) + 1)
                pick = np.arange(n) if n <= SAMPLE_CHUNKS else np.linspace(0, n - 1, SAMPLE_CHUNKS).astype(int)
                x = np.zeros((len(pick), CHUNK), np.uint8)
                for i, c in enumerate(pick):
                    part = own[c * HOP: c * HOP + CHUNK]
                    x[i, : len(part)] = part
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("h"), pa.array(out, pa.binary())],
                                             ["label", "h", "chunks"])

    return texts.mapInArrow(run, "label int, h bigint, chunks binary")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        folds: int = 5, fold: int = 0) -> Network:
    """Network from the bounded sample; the offset is moved to the class shares of all learning rows.

    Only labels 0 and 1 with a non-null id count; a document with both labels counts as 0.  With
    labels of one class only, or none, every score is that class's share (0.5 for none).
    """
    known = (labels.filter(~held_out(id_col, folds, fold) & F.col(f"`{id_col}`").isNotNull()
                           & F.col(f"`{label_col}`").isin(0, 1))
             .groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(F.col(f"`{label_col}`")).cast("int").alias("label")))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    net = Network()
    if len(sizes) < 2:
        net.offset = 20.0 if sizes.get(1) else -20.0 if sizes.get(0) else 0.0
        return net
    picked = []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    for c in (0, 1):
        few = known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
        # at most SAMPLE_DOCS narrow rows
        texts = rows.join(F.broadcast(few), rows["doc_id"] == few["id"]).select("label", F.xxhash64("id").alias("h"), "text")
        picked += sample_chunks(texts).orderBy("h", "chunks").limit(SAMPLE_DOCS).collect()
    blocks = [np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in picked]
    if len({r["label"] for r in picked}) < 2:
        return net
    doc = np.repeat(np.arange(len(blocks)), [len(x) for x in blocks])
    net.fit(np.concatenate(blocks), doc, np.array([r["label"] for r in picked]))
    net.offset += float(np.log(sizes[1] / sizes[0]))
    return net


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out (crc32 of the id mod ``folds`` is ``fold``), score (probability of label 1), predicted.

    One row per input row; null text is scored as the empty text, which the network sees as zero
    bytes; texts of any length are read whole; null and repeated ids pass through; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(packed(fit(docs, labels, label_col, id_col, text_col, folds, fold)))  # fixed size

    def run(batches):
        scorer = Scorer(unpacked(shared))
        for b in batches:
            raw, offsets = text_column(b, "text")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scorer.scores(raw, offsets), pa.float64())], ["doc_id", "score"])

    key = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")) \
        .mapInArrow(run, f"doc_id {key}, score double")
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
