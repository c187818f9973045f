"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over each fixed-length window, the
maximum of each filter is kept, and a softmax layer gives the language. The network is
trained in numpy on windows from a bounded sample of labelled documents and is applied to
batches of windows that together cover each whole text; a document's probabilities are the
mean over its windows, weighted by their bytes.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every
text when no labelled document exists; repeated rows are predicted one by one; an empty
table gives an empty result; only ``doc_id``, ``text`` and, for training, ``lang`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
#: The training sample: so many documents of each language about, and windows of each document at most.
SAMPLE_DOCS = 600
SAMPLE_WINDOWS = 4
#: Beyond so many languages there are fewer documents of each, but about so many at least.
LANGUAGES = 200
LEAST_DOCS = 20
EPOCHS = 6
FOLDS = 5
#: Windows in one product of matrices.
BATCH = 64
_REACH = max(WIDTHS)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    offset: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """For each position of each window, the embeddings of the bytes that the filters reach."""
        x = self.embedding[windows]
        n, m = windows.shape[0], WINDOW - _REACH + 1
        s = x.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, m, _REACH * DIM), (s[0], s[1], s[2]))).reshape(n, m, -1)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.columns(windows)
        y = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(x.shape[0], x.shape[1], -1)
        return x, y, np.maximum(y.max(1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows)[2] @ self.output + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _mask() -> np.ndarray:
    """Filters of a smaller width see the first bytes of the reach only."""
    mask = np.zeros((_REACH * DIM, FILTERS * len(WIDTHS)), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Minimise the cross entropy with Adam; the gradient of a maximum goes to its position."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    mask = _mask()
    net = Network(languages, f32(256, DIM, scale=0.5), f32(_REACH * DIM, mask.shape[1], scale=0.2) * mask, np.zeros(mask.shape[1], np.float32), f32(mask.shape[1], len(languages), scale=0.2), np.zeros(len(languages), np.float32))
    names = ("embedding", "filters", "bias", "output", "offset")
    first, second, step = [0] * 5, [0] * 5, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), 32):
            rows = order[start : start + 32]
            w, y = windows[rows], labels[rows]
            x, conv, h = net.pooled(w)
            z = h @ net.output + net.offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            p /= len(rows)
            dh = (p @ net.output.T) * (h > 0)
            best = conv.argmax(1)
            seen = x[np.arange(len(rows))[:, None], best]  # rows, filters, reach
            d_filters = np.einsum("bf,bfd->df", dh, seen) * mask
            d_bytes = (dh[:, :, None] * net.filters.T[None]).reshape(len(rows), -1, _REACH, DIM)
            d_embedding = np.zeros_like(net.embedding)
            np.add.at(d_embedding, w[np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(_REACH)], d_bytes)
            step += 1
            for k, (name, g) in enumerate(zip(names, (d_embedding, d_filters, dh.sum(0), h.T @ p, p.sum(0)), strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                change = 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                setattr(net, name, (getattr(net, name) - change).astype(np.float32))
    return net


def held_out(folds: int = FOLDS) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds == 0


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, out = [], []
        for doc, lang, text in zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist(), batch["text"], strict=True):
            data = text.as_py().encode()
            rng = np.random.default_rng(zlib.crc32(str(doc).encode()))
            for k in range(min(SAMPLE_WINDOWS, 1 + len(data) // WINDOW)):
                at = int(rng.integers(0, max(1, len(data) - WINDOW + 1)))
                # Every fourth window is cut short, so that short texts are known too.
                size = WINDOW if k != 1 else int(rng.integers(8, WINDOW))
                langs.append(lang)
                out.append(data[at : at + size].ljust(WINDOW, b"\0"))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])


def learn(labelled: DataFrame) -> Network | None:
    """A network from a sample of ``labelled`` (doc_id, text, lang); all languages are in it, with fewer documents of each beyond ``LANGUAGES``."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counts = labelled.groupBy("lang").count()
    known = counts.count()
    if not known:
        return None
    each = min(SAMPLE_DOCS, max(LEAST_DOCS, SAMPLE_DOCS * LANGUAGES // known))
    # A row is in the sample by a hash of its id, at a rate that depends on the language's rows only.
    scale = 1 << 30
    rate = F.least(F.lit(scale), F.ceil(F.lit(scale * each) / F.col("count")))
    chosen = labelled.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(scale)) < rate)
    bound = known * each * SAMPLE_WINDOWS * 2
    sample = chosen.select("doc_id", "lang", "text").mapInArrow(_sample_windows, "lang string, window binary").limit(bound).toPandas().sort_values(["lang", "window"], ignore_index=True)
    languages = sorted(sample["lang"].unique())
    windows = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.searchsorted(languages, sample["lang"].to_numpy().astype(str)), languages) if len(languages) else None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(at)]
            known = np.array([net is not None and any(map(str.isalpha, t)) for t in texts], bool)
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            totals = np.zeros((len(texts), len(net.languages) if net else 0))
            for part, of, weight in _windows(texts, np.flatnonzero(known)):
                np.add.at(totals, of, net.probabilities(part) * weight[:, None])
            for i in np.flatnonzero(known):
                p = totals[i] / totals[i].sum()
                names[i], scores[i] = net.languages[int(p.argmax())], float(p.max())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns).mapInArrow(apply, f"{fields}, lang_pred string, score double")


def _windows(texts: list[str], rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All bytes of the texts in batches of windows, with each window's text and bytes."""
    parts, of, weight = [], [], []
    for i in rows:
        data = texts[i].encode()
        for at in range(0, len(data), WINDOW):
            part = data[at : at + WINDOW]
            parts.append(part if len(part) == WINDOW else part.ljust(WINDOW, b"\0"))
            of.append(i)
            weight.append(len(part))
            if len(parts) == BATCH:
                yield np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW), np.array(of), np.array(weight)
                parts, of, weight = [], [], []
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW), np.array(of), np.array(weight)


def identify(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; it learns from the labelled documents that are not held out."""
    net = learn(docs.filter(~F.coalesce(held_out(folds), F.lit(True))))
    return predict(docs, net).withColumn("held_out", F.coalesce(held_out(folds), F.lit(False)))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the ``op5_language_id`` query."""
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
