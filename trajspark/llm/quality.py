"""Operator 1: document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded as a vector of character, word and repetition statistics; gated attention,
softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages of a document; the weighted sum is scored by a logistic layer. All weights are
learned from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, text_or_empty

#: Characters of a passage, at least; a passage ends at the next white space. The rest of a text joins the last passage if it is short.
PASSAGE = 600
#: Labelled documents that the model is fitted on, at most (the smallest hashes of doc_id), and characters of them all together, at most.
TRAIN_DOCS, TRAIN_CHARS = 4000, 50_000_000
HASHED = 24
CLASSES = 12


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 11, dtype=np.int64)  # other ASCII
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:", "!?", "#$%&*@^~", "|<>{}[]\\/", "\"'()-_=+`")):
        kinds[[ord(c) for c in chars]] = k
    kinds[0xC0:] = 10  # a character outside ASCII begins
    kinds[0x80:0xC0] = CLASSES  # the rest of one: not counted
    return kinds


KIND = _byte_classes()


def passages(text: str, size: int = PASSAGE) -> list[str]:
    """The whole text cut into passages of about `size` characters, at white space where there is some within a passage; [""] if empty."""
    out, at = [], 0
    while len(text) - at > 1.5 * size:
        end = text.find(" ", at + size, at + 2 * size)
        end = end if end >= 0 else at + size
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def encode(parts: list[str]) -> np.ndarray:
    """One row of statistics for each passage: character classes, word lengths, repetition and hashed word endings."""
    out = np.zeros((len(parts), FEATURES), dtype=np.float32)
    for i, part in enumerate(parts):
        data = np.frombuffer(part.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        kinds = np.bincount(KIND[data], minlength=CLASSES + 1)[:CLASSES]
        chars = max(1, int(kinds.sum()))
        words = part.split()
        n = max(1, len(words))
        row = out[i]
        row[:CLASSES] = kinds / chars
        letters = max(1, int(kinds[0] + kinds[1]))
        unique = len(set(words))
        upper = sum(map(str.isupper, words))
        title = sum(map(str.istitle, words))
        row[CLASSES : CLASSES + 9] = (
            kinds[0] / letters,
            min(chars / n, 40.0) / 10,
            unique / n,
            upper / n,
            title / n,
            np.log1p(len(words)) / 5,
            sum(map(str.isalpha, words)) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            (kinds[5] + kinds[6]) / n,
        )
        ends = np.bincount(data[np.flatnonzero(data == 32) - 1].astype(np.int64) % HASHED, minlength=HASHED) if len(data) > 1 else np.zeros(HASHED)
        row[CLASSES + 9 : CLASSES + 9 + HASHED] = ends / n
    return out


FEATURES = CLASSES + 9 + HASHED + 3


def bag(text: str) -> np.ndarray:
    """The encoded passages of a document; each row also holds the bag's share of repeated lines, its size and whether it is empty."""
    parts = passages(text)
    rows = encode(parts)
    lines = [x for x in text.split("\n") if x.strip()]
    rows[:, -3] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    rows[:, -2] = np.log1p(len(text)) / 10
    rows[:, -1] = not text.strip()
    return rows


class AttentionModel:
    """Gated attention over passages and a logistic layer, trained by Adam on whole bags (numpy)."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, hidden: int = 16, steps: int = 300, rate: float = 0.03, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
        f = rows.shape[1]
        p = {"E": rng.normal(0, f**-0.5, (f, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, hidden)), "U": rng.normal(0, hidden**-0.5, (hidden, hidden)), "w": rng.normal(0, 0.1, hidden), "c": np.zeros(hidden), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float64) for k, v in p.items()}
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        share = np.clip(labels.mean(), 0.05, 0.95)
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        weight = np.sqrt(weight)
        x = (rows - self.mean) / self.scale
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            g = self._gradient(x, starts, owner, labels, weight)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.p[k] = self.p[k] - rate * (0.1 + 0.9 * (1 - t / steps)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _forward(self, x: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        a, b = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = np.clip((a * b) @ p["w"], -30, 30)
        e = np.exp(raw - np.maximum.reduceat(raw, starts)[owner])
        attention = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return h, a, b, attention, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def _gradient(self, x, starts, owner, labels, weight) -> dict[str, np.ndarray]:
        p = self.p
        h, a, b, attention, z, score = self._forward(x, starts, owner)
        d = weight * (score - labels) / len(labels)
        dz = d[:, None] * p["c"]
        dh = attention[:, None] * dz[owner]
        da = (h * dz[owner]).sum(axis=1)
        draw = attention * (da - np.add.reduceat(attention * da, starts)[owner])
        dab = draw[:, None] * p["w"]
        dva, dub = dab * b * (1 - a * a), dab * a * b * (1 - b)
        dh = dh + dva @ p["V"].T + dub @ p["U"].T
        dx = dh * (1 - h * h)
        decay = 1e-4
        return {"E": x.T @ dx + decay * p["E"], "e": dx.sum(axis=0), "V": h.T @ dva + decay * p["V"], "U": h.T @ dub + decay * p["U"], "w": (a * b).T @ draw, "c": z.T @ d + decay * p["c"], "b": np.array([d.sum()])}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self._forward(x, starts, np.repeat(np.arange(len(sizes)), sizes))[-1]


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        bags = [bag(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bags], pa.binary()), batch.column(2).cast(pa.string())], ["quality", "bag", "doc_id"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> AttentionModel | float:
    """Fit on at most train_docs labelled documents outside the held-out quarter, of at most train_chars characters in all (but for the first);
    a constant (the label mean, or 0.5) if one class is missing.

    Labels with a null id or quality take no part; a document labelled more than once counts with its highest label; of rows of a repeated id
    the smallest text counts. The same rows give the same model, whatever the order they come in.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    known = known.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # the bound holds the broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # at most train_docs rows
    rows = rows.withColumn("chars", F.sum(F.length("text")).over(order)).where((F.col("chars") <= train_chars) | (F.col("chars") == F.length("text")))
    rows = rows.select("quality", "text", "doc_id").mapInArrow(_encoded, "quality int, bag binary, doc_id string").collect()  # bags of at most train_chars characters
    rows = sorted(rows, key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in rows], dtype=float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    return AttentionModel(np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]), y)


def score(docs: DataFrame, model: AttentionModel | float, text_col: str = "text", column: str = "score") -> DataFrame:
    """The documents with a column of scores (0 to 1) of the whole texts; null text counts as empty. No shuffle; repeated rows score alike.

    An input column of the same name gives way: name another `column` to keep it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.arrow_udf("double")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for text in texts:
            parts = sliced(iter([pa.RecordBatch.from_arrays([text], ["text"])]))
            scores = [np.full(p.num_rows, own) if isinstance(own, float) else own.score([bag(t) for t in p.column(0).to_pylist()]) for p in parts]
            yield pa.array(np.concatenate([np.empty(0), *scores]))

    return docs.withColumn(column, of(text_or_empty(text_col)))
