"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

Two banks of learned filters read the text. FILTERS filters see WIDTH successive bytes (a table of a weight for each
offset, byte and filter, which is a convolution of one-hot bytes). ECHOES filters see how a text repeats itself, which no
filter of single bytes can: their LAGS input channels say of each byte whether the byte so many before is the same, and
a filter weighs the channels' means over SPAN bytes. All are pooled by their maximum over the whole text, and a logistic unit
makes one probability of the rectified maxima. A text is read in chunks of CHUNK bytes that overlap by what a filter
looks back or ahead, so the whole of it counts and memory doesn't depend on its length. An empty or null text has all
maxima zero and gets the probability of the bias. A null label is no label.

The network is fitted by Adam, on whole texts, on a bounded sample of the labelled rows: those with the least hash of their id, at most FIT_ROWS, one for
each id (of rows that repeat it the largest text). If their texts together have more than FIT_BYTES characters, the longest go until they don't, so a few giant
texts put none of the others out; the shortest one stays in any case. Any cluster picks the same ones; of rows that crc32 of the id puts aside none is used. It is a few hundred kilobytes whatever the input is, and scoring is
one pass over the texts without a shuffle. Rows that repeat are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dynspark.llm.common import cut, table, text_or_empty

WIDTH, FILTERS, CHUNK = 5, 16, 1 << 14
ECHOES, LAGS, SPAN, CELL = 4, 32, 64, 16
#: Labelled rows that the network is fitted on at most, and characters of all of them together.
FIT_ROWS, FIT_BYTES = 4000, 1 << 25
EPOCHS, BATCH, RATE, DECAY, DROP = 6, 32, 0.02, 1e-3, 0.2
THRESHOLD = 0.3


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.echo = rng.normal(1, 0.3, (LAGS, ECHOES)).astype(np.float32)
        self.bias = np.zeros(FILTERS + ECHOES, np.float32)
        self.bias[FILTERS:] = -np.linspace(2, 8, ECHOES)
        self.out = rng.normal(0, 0.3, FILTERS + ECHOES).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def maxima(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest response of each filter; where it is, for the first bank; the channels there, for the second."""
        if len(data) < WIDTH:
            data = np.r_[data, np.zeros(WIDTH - len(data), np.uint8)]
        best, where, seen = np.full(FILTERS + ECHOES, -np.inf, np.float32), np.zeros(FILTERS, np.int64), np.zeros((ECHOES, LAGS), np.float32)
        top, echo = best[:FILTERS], best[FILTERS:]
        for k in range(0, len(data), CHUNK):
            part = data[k : k + CHUNK + WIDTH - 1]
            n = len(part) - WIDTH + 1
            if n > 0:
                got = self.table[0].take(part[:n], axis=0)
                for j in range(1, WIDTH):
                    got += self.table[j].take(part[j : j + n], axis=0)
                at = got.argmax(0)
                own = got[at, np.arange(FILTERS)]
                where = np.where(own > top, at + k, where)
                np.maximum(top, own, out=top)
            means = repeats(data, k, k + CHUNK)
            got = means @ self.echo
            at = got.argmax(0)
            own = got[at, np.arange(ECHOES)]
            seen = np.where((own > echo)[:, None], means[at], seen)
            np.maximum(echo, own, out=echo)
        return best, where, seen

    def hidden(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0)

    def logit(self, hidden: np.ndarray) -> float:
        return float(hidden.astype(np.float64) @ self.out.astype(np.float64)) + float(self.base[0])

    def score(self, text: str) -> float:
        if not text:
            return logistic(float(self.base[0]))
        return logistic(self.logit(self.hidden(self.maxima(np.frombuffer(text.encode(), np.uint8))[0])))


def repeats(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """For each cell of CELL bytes from begin on: the share of the SPAN bytes up to its end that equal the byte 1, 2 ... LAGS
    before. Begin and CHUNK are multiples of CELL."""
    end = min(end, len(data))
    back = min(begin, SPAN - CELL)
    first, cells = begin - back, -(-(end - begin + back) // CELL)
    same, counts = np.zeros(cells * CELL, bool), np.zeros((cells, LAGS), np.float32)
    for lag in range(1, LAGS + 1):
        since = max(first, lag)
        if since < end:
            same[: since - first] = False
            same[since - first : end - first] = data[since:end] == data[since - lag : end - lag]
            counts[:, lag - 1] = np.bitwise_count(np.packbits(same).view(np.uint16))
    n = SPAN // CELL
    total = np.r_[np.zeros((n, LAGS), np.float32), np.cumsum(counts, axis=0)]
    return (total[n:] - total[:-n])[back // CELL :] / SPAN


def logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[str], labels: list[int], seed: int = 0, epochs: int = EPOCHS) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed + 1)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    y = np.array(labels, np.float32)
    if not len(y):  # nothing is known: every score is one half
        net.out[:] = 0
        return net
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    net.base[0] = np.log(share / (1 - share))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    params = [net.table, net.bias, net.out, net.base, net.echo]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(data))
        for k in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in params]
            for i in order[k : k + BATCH].tolist():
                d = data[i]
                if not len(d):
                    grads[3] += weight[i] * (logistic(float(net.base[0])) - y[i]) / BATCH
                    continue
                best, where, seen = net.maxima(d)
                h = net.hidden(best) * np.r_[(rng.random(FILTERS) >= DROP) / (1 - DROP), np.ones(ECHOES)].astype(np.float32)
                error = weight[i] * (logistic(net.logit(h)) - y[i]) / BATCH
                grads[2] += error * h
                grads[3] += error
                back = error * net.out * (h > 0)
                grads[1] += back
                grads[4] += (back[FILTERS:, None] * seen).T
                padded = np.r_[d, np.zeros(max(0, WIDTH - len(d)), np.uint8)]
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (padded[where + j], np.arange(FILTERS)), back[:FILTERS])
            t += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) + DECAY * p)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> DataFrame:
    """doc_id, text, quality of the sample. The running sum goes over at most so many rows of lengths."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = cut(texts.groupBy("doc_id", "quality").agg(F.max("text").alias("text")))
    w = Window.orderBy(F.length("text"), F.xxhash64("doc_id"), "doc_id")
    upto = texts.select("doc_id", F.sum(F.length("text")).over(w).alias("upto"), F.row_number().over(w).alias("place"))
    within = upto.filter((F.col("upto") <= size) | (F.col("place") == 1)).select("doc_id")
    return texts.join(F.broadcast(within), "doc_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 0) -> Network:
    found = sorted(labelled(docs, labels, rows).collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in found], [r["quality"] for r in found], seed)


def scores(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)).mapInArrow(work, f"id {id_type}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs that the network doesn't reject; columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [shared.value.score(t.as_py() or "") >= THRESHOLD for t in b.column(at)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
