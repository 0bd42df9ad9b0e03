"""Language identification by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.common import ship, without

WINDOW = 128
WIDTHS = (2, 3, 4)
#: Training takes some ``PER_LANGUAGE`` documents of each language, ``MOST_ROWS`` of all, four windows of each.
PER_LANGUAGE, MOST_ROWS, WINDOWS_EACH = 600, 24_000, 4
#: More values of ``lang`` than these are an error: the network has a weight for each.
MOST_LANGUAGES = 8192
#: Texts classified at once.
AT_ONCE = 64
UNKNOWN = "und"


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The whole text as rows of ``WINDOW`` bytes, the last padded with zeros; and bytes used of each."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    rows = np.zeros(n * WINDOW, np.uint8)
    rows[:len(data)] = data
    used = np.full(n, WINDOW, np.float32)
    used[-1] = max(1, len(data) - (n - 1) * WINDOW)
    return rows.reshape(n, WINDOW), used


@dataclass
class ByteNet:
    """Byte vectors, filters of several widths, max pooling over places, softmax."""

    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    shift: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, labels: list[str], dim=8, per_width=16, epochs=8, rate=0.01, seed=3):
        """Adam on the cross entropy. Gradients pass through the place of each filter's maximum."""
        rng = np.random.default_rng(seed)
        wide = per_width * len(WIDTHS)
        p = [rng.normal(0, 0.3, (256, dim))]
        p += [rng.normal(0, 1 / np.sqrt(w * dim), (w * dim, per_width)) for w in WIDTHS]
        p += [np.zeros(per_width) for _ in WIDTHS]
        p += [rng.normal(0, 1 / np.sqrt(wide), (wide, len(labels))), np.zeros(len(labels))]
        p = [a.astype(np.float32) for a in p]
        moment = [[np.zeros_like(a), np.zeros_like(a)] for a in p]
        step, k = 0, len(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), 128):
                rows = order[at:at + 128]
                xb, yb = x[rows], y[rows]
                n = len(rows)
                vectors = p[0][xb]
                pooled, places = [], []
                for i, w in enumerate(WIDTHS):
                    patch = np.concatenate([vectors[:, j:WINDOW - w + 1 + j] for j in range(w)], axis=2)
                    conv = patch @ p[1 + i] + p[1 + k + i]
                    places.append(conv.argmax(axis=1))
                    pooled.append(conv.max(axis=1))
                top = np.concatenate(pooled, axis=1)
                h = np.maximum(top, 0)
                z = h @ p[-2] + p[-1]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(n), yb] -= 1
                d /= n
                grads = [np.zeros_like(a) for a in p]
                grads[-2], grads[-1] = h.T @ d, d.sum(axis=0)
                back = (d @ p[-2].T) * (top > 0)
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * per_width:(i + 1) * per_width]
                    grads[1 + k + i] = g.sum(axis=0)
                    for j in range(w):
                        letter = np.take_along_axis(xb, places[i] + j, axis=1)
                        rows_j = slice(j * dim, (j + 1) * dim)
                        grads[1 + i][rows_j] = np.einsum("nf,nfd->df", g, p[0][letter])
                        np.add.at(grads[0], letter, g[:, :, None] * p[1 + i][rows_j].T[None])
                step += 1
                for a, g, m in zip(p, grads, moment):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    a -= np.float32(rate) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        return cls(labels, p[0], p[1:1 + k], p[1 + k:1 + 2 * k], p[-2], p[-1])

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Each filter as a sum of table rows for byte pairs (and a single byte at an odd end)."""
        dim = self.embed.shape[1]
        out = []
        for w, f in zip(WIDTHS, self.filters):
            single = [self.embed @ f[j * dim:(j + 1) * dim] for j in range(w)]
            terms = [(j, (single[j][:, None] + single[j + 1][None]).reshape(65536, -1)) for j in range(0, w - 1, 2)]
            out.append(terms + [(w - 1, single[-1])] * (w % 2))
        return out

    def log_probabilities(self, x: np.ndarray, tables) -> np.ndarray:
        """One row per window, one column per label."""
        letters = np.ascontiguousarray(x.T).astype(np.intp)  # places first: sums and maxima run over long rows
        pairs = letters[:-1] * 256 + letters[1:]
        pooled = []
        for w, terms, bias in zip(WIDTHS, tables, self.bias):
            places = WINDOW - w + 1
            conv = None
            for j, t in terms:
                part = np.take(t, (pairs if len(t) > 256 else letters)[j:j + places], axis=0, mode="clip")
                conv = part if conv is None else np.add(conv, part, out=conv)
            pooled.append(conv.max(axis=0) + bias)
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.shift
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _training_windows(batches):
    """A few whole windows at even distances from each sampled text."""
    for batch in batches:
        langs, rows = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            x, _ = windows(text)
            for i in np.unique(np.linspace(0, len(x) - 1, WINDOWS_EACH).astype(int)):
                langs.append(lang)
                rows.append(x[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())],
                                         names=["lang", "window"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> ByteNet | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    Each language keeps rows whose hash falls under its share, and always the row of its
    smallest hash: about ``per_language`` of each, fewer if ``most_rows`` would be passed. So
    every language of the labels is learned, however rare. Rows without language, or without
    a letter, teach nothing; with no row left there is no model. Over ``MOST_LANGUAGES``
    values of ``lang`` raise an error: such a column holds no languages.
    """
    ship(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out()).select(
        F.col("lang"), F.col("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**40)).alias("draw"))
    found = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least"))
    counts = found.limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    each = min(per_language, most_rows / len(counts))
    # as an Arrow table: rows of Python would pass through Python workers of their own, which Spark keeps
    shares = docs.sparkSession.createDataFrame(pa.table({
        "lang": pa.array([r["lang"] for r in counts], pa.string()),
        "below": pa.array([max(int(min(1.0, each / r["n"]) * 2**40), r["least"] + 1) for r in counts], pa.int64())}))
    sampled = (usable.join(F.broadcast(shares), "lang").filter("draw < below")
               .select("lang", "text").mapInArrow(_training_windows, "lang string, window binary").collect())
    sampled.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    labels = sorted({r["lang"] for r in sampled})
    x = np.frombuffer(b"".join(bytes(r["window"]) for r in sampled), np.uint8).reshape(-1, WINDOW)
    number = {lang: k for k, lang in enumerate(labels)}
    y = np.array([number[r["lang"]] for r in sampled])
    return ByteNet.fit(x, y, labels)


def _predictor(shared):
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        tables = net.tables()
        for batch in batches:
            lang, score = [], []
            for part in range(0, len(batch), AT_ONCE):
                texts = batch[part:part + AT_ONCE].to_pylist()
                whole = [windows(t) for t in texts if t is not None]
                mean = iter(())
                if whole:
                    x = np.concatenate([w for w, _ in whole])
                    used = np.concatenate([u for _, u in whole])
                    logs = np.concatenate([net.log_probabilities(x[i:i + 256], tables) for i in range(0, len(x), 256)])
                    starts = np.cumsum([0] + [len(w) for w, _ in whole[:-1]])
                    weights = np.add.reduceat(used, starts)
                    mean = iter(np.add.reduceat(logs * used[:, None], starts) / weights[:, None])
                for t in texts:
                    if t is None:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    m = next(mean).astype(np.float64)
                    odds = np.exp(m - m.max())
                    lang.append(net.labels[int(m.argmax())])
                    score.append(float(1 / odds.sum()))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["lang_pred", "score"])

    # said to be nondeterministic, so that a filter on its values doesn't evaluate it again below
    return F.arrow_udf(predict, T.StructType([T.StructField("lang_pred", T.StringType()),
                                              T.StructField("score", T.DoubleType())])).asNondeterministic()


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` for each whole text.

    Every window of a text is classified in batches; the mean of the log
    probabilities, weighted by bytes, decides, and its softmax is the score. Null
    text, text without a letter and a missing model give ``und`` and 0. The network
    (under 100 KB for some hundred languages) is broadcast. Only the text goes to Python,
    once, and two values come back. Input columns with the added names are replaced.
    """
    plain = without(docs, "lang_pred", "score")
    if net is None:
        return plain.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    ship(docs.sparkSession)
    predict = _predictor(docs.sparkSession.sparkContext.broadcast(net))
    source = F.col(f"`{text}`")
    found = plain.withColumn("_found", predict(F.when(source.rlike(r"\p{L}"), source)))
    return found.select(*[F.col(f"`{c}`") for c in plain.columns], "_found.lang_pred", "_found.score")


def least_score(docs: DataFrame, net: ByteNet, lost: float = 1e-3) -> float:
    """The score that all but a share ``lost`` of the rightly labelled held-out documents reach.

    Held-out rows taught the network nothing, so their scores are those of unseen text,
    whatever the number of languages. An approximate percentile of one pass over them. Fewer
    than 1 / ``lost`` rows can't show so rare a score: the bound shrinks with their number, to 0
    for none.
    """
    seen = identify(docs.filter(F.col("lang").isNotNull() & held_out()).select("lang", "text"), net)
    n, least = seen.filter("lang = lang_pred").agg(F.count("*"), F.percentile_approx("score", lost, 10_000)).first()
    return (least or 0.0) * min(1.0, n * lost)


def document_languages(docs: DataFrame) -> DataFrame:
    net = train(docs)
    found = identify(docs.select("doc_id", F.col("text").alias("content")), net, "content")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
