"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Each passage is encoded; a gated attention, learned from document labels alone, weighs the passages' representations,
and a linear layer scores the weighted sum.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, alone, mix64, small_batches, strings

#: Words of one passage.
PASSAGE_WORDS = 96
#: Characters of a piece: a longer run without blanks counts as successive pieces, so that all of it is scored.
PIECE_CHARS = 200
#: Characters whose features are made at once, and characters of words that are held between batches: both bound memory only.
BLOCK_CHARS, HELD_CHARS = 1_000_000, 16_000_000
#: Labelled documents that a fit reads at most, those with the smallest hashes of doc_id, and passages that they may have together.
FIT_ROWS, FIT_PASSAGES = 6000, 300_000
HASHED, HIDDEN, GATE = 24, 24, 12
MARKS = re.compile(r"[#*$%&|<>!@^~=_+/\\{}\[\]]")
#: Features of one word: a one, length, letters, digits, upper-case letters, marks, sentence end, comma end, only marks, all upper case, non-ASCII letters.
WORD_FEATURES = 11
FEATURES = WORD_FEATURES + 5 + HASHED


#: Kinds of characters below 0x250; what lies above counts as a letter.
_KIND = np.array([[c.isalpha(), c.isdigit(), c.isupper(), bool(MARKS.match(c))] for c in map(chr, range(0x250))], np.float32)


def word_rows(words: list[str]) -> np.ndarray:
    """A row for each word, made for all words at once."""
    size = np.array([len(w) for w in words])
    starts = np.cumsum(size) - size
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.add.reduceat(np.where((codes < 0x250)[:, None], _KIND[np.minimum(codes, 0x24F)], np.float32([1, 0, 0, 0])), starts, axis=0)
    wide = np.add.reduceat((codes > 127).astype(np.int64), starts) > 0
    last = codes[starts + size - 1]
    share = kinds / size[:, None]
    letters, uppers = kinds[:, 0], kinds[:, 2]
    own = [np.ones(len(words)), np.minimum(size, 40) / 8, *share.T, np.isin(last, [46, 33, 63]), last == 44, kinds[:, 3] == size, (letters > 1) & (uppers == letters), wide]
    crc = np.array([zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) + 1 for w in words], np.uint64)
    bits = mix64(np.arange(1, HASHED + 1, dtype=np.uint64) * crc[:, None]) >> np.uint64(63)
    return np.concatenate([np.stack(own, 1).astype(np.float32), np.where(bits, np.float32(1), np.float32(-1))], 1)


def pieces(text: str) -> list[str]:
    """All words of a text, in order; a run of more than PIECE_CHARS characters as successive pieces."""
    split = text.split()
    if max(map(len, split), default=0) <= PIECE_CHARS:
        return split
    return [w[i : i + PIECE_CHARS] for w in split for i in range(0, len(w), PIECE_CHARS)]


def blocks(words: list[str]) -> Iterator[list[str]]:
    """words in runs of about BLOCK_CHARS characters."""
    at = size = 0
    for i, w in enumerate(words):
        size += len(w)
        if size >= BLOCK_CHARS:
            yield words[at : i + 1]
            at, size = i + 1, 0
    if at < len(words):
        yield words[at:]


class Words(dict):
    """Word to its row in a matrix; starts over between batches once `limit` words or `chars` characters are held, which bounds a worker's memory."""

    def __init__(self, limit: int = 400_000, chars: int = HELD_CHARS):
        super().__init__()
        self.limit, self.chars, self.held, self.new = limit, chars, 0, []
        self.rows = np.zeros((0, WORD_FEATURES + HASHED), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        self.held += len(word)
        return i

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self) > self.limit or self.held > self.chars:
            self.clear()
            self.rows, self.held = self.rows[:0], 0
        out = [np.fromiter(map(self.__getitem__, split), np.int64, len(split)) for split in texts]
        if self.new:
            self.rows = np.concatenate([self.rows, *map(word_rows, blocks(self.new))])
            self.new = []
        return out


def encode(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each text's passages begin; a text without words is one zero passage."""
    found, starts, at = [], [0], 0
    for ids in words.ids([pieces(text) for text in texts]):
        n = len(ids)
        if not n:
            found.append(np.zeros((1, FEATURES), np.float32))
            at += 1
            starts.append(at)
            continue
        cuts = np.arange(0, n, PASSAGE_WORDS)
        size = np.diff([*cuts, n])[:, None].astype(np.float32)
        mean = np.add.reduceat(words.rows[ids], cuts, axis=0) / size
        passage = np.arange(n) // PASSAGE_WORDS
        order = np.lexsort((ids, passage))
        fresh = np.ones(n, bool)
        fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        distinct = np.bincount(passage[order], fresh, len(cuts))[:, None] / size
        same = np.zeros(n, np.float32)
        same[1:] = ids[1:] == ids[:-1]
        pairs = np.zeros(n, np.int64)
        pairs[1:] = ids[:-1] * 4_000_000_007 + ids[1:]
        _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        again = (counts[inverse] > 1).astype(np.float32)
        more = np.stack([np.add.reduceat(same, cuts), np.add.reduceat(again, cuts)], 1) / size
        rest = np.stack([np.log1p(size[:, 0]) / 5, np.full(len(cuts), np.log1p(len(cuts)) / 3)], 1)
        found.append(np.concatenate([mean[:, :WORD_FEATURES], distinct, more, rest, mean[:, WORD_FEATURES:] * 2], 1).astype(np.float32))
        at += len(cuts)
        starts.append(at)
    return (np.concatenate(found) if found else np.zeros((0, FEATURES), np.float32)), np.array(starts)


def _segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts[:-1], axis=0)


class AttentionModel:
    """h = tanh(x W + b); weight = softmax over a document's passages of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(sum(weight h) c + d)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, params: dict[str, np.ndarray]):
        self.mean, self.scale, self.p = mean, scale, params

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, counts = self.p, np.diff(starts)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts[:-1]), counts))
        a = e / np.repeat(_segments(e, starts), counts)
        z = _segments(a[:, None] * h, starts)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "s": s}

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, starts)["s"] if len(starts) > 1 else np.zeros(0)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f, counts = self.p, self.forward(x, starts), np.diff(starts)
        ds = (f["s"] - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], counts, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(_segments(f["a"] * da, starts), counts))
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam on the log loss of documents, from a fixed seed. Without bags, or with one label only, scores are that label's prior."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    params = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
    prior = (labels.sum() + 1) / (len(labels) + 2)
    params["d"][:] = np.log(prior / (1 - prior))
    if len(bags) == 0 or len(set(labels.tolist())) < 2:
        params["c"][:] = 0
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), params)
    flat = np.concatenate(bags).astype(np.float64)
    mean, scale = flat.mean(0), flat.std(0) + 1e-3
    model = AttentionModel(mean, scale, params)
    bags = [(b - mean) / scale for b in bags]
    first, second, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            x, starts = np.concatenate([bags[j] for j in own]), np.concatenate([[0], np.cumsum([len(bags[j]) for j in own])])
            step += 1
            for k, g in model.gradients(x, starts, labels[own]).items():
                g = g + decay * params[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= rate * (0.1 if epoch > 2 * epochs // 3 else 1) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    words = Words()
    for batch in batches:
        x, starts = encode(strings(batch.column(1)), words)
        bags = [x[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary()), pa.array(np.diff(starts)), *batch.columns[2:]], names=["doc_id", "bag", "size", "label", "place"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, fit_passages: int = FIT_PASSAGES) -> AttentionModel:
    """Train on at most fit_rows labelled documents of docs; labels has doc_id and `label`, rows with nulls are left out.

    The documents are those with the smallest hashes of doc_id, so a fit repeats. Of rows that repeat a doc_id one is read,
    that with the smallest features. Documents count in order of their hashes as long as they have at most fit_passages
    passages together, which bounds what the driver collects, however long they are. Without rows or labels, scores are 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("label")).dropna().dropDuplicates(["doc_id", "label"])
    chosen = chosen.withColumn("place", F.xxhash64("doc_id", "label")).orderBy("place", "doc_id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", "place")
    bags = rows.mapInArrow(_features, "doc_id long, bag binary, size long, label double, place long")
    bags = Scratch(spark, "bags").write(bags.groupBy("doc_id", "label", "place").agg(F.min(F.struct("bag", "size")).alias("x")).select("place", "doc_id", "label", "x.*"), "bags")
    sizes = bags.select("place", "doc_id", F.sum("size").over(Window.orderBy("place", "doc_id")).alias("upto"))  # at most fit_rows rows
    within = F.broadcast(sizes.where(F.col("upto") <= fit_passages).select("place", "doc_id"))
    got = bags.join(within, ["place", "doc_id"]).select("place", "doc_id", "label", "bag").toPandas().sort_values(["place", "doc_id"], kind="stable")
    return train([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["bag"]], got["label"].to_numpy())


def _score(model: AttentionModel, at: int, keep: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        words = Words()
        for batch in batches:
            x, starts = encode(strings(batch.column(at)), words)
            scores = np.round(model.scores(x, starts), 9)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores, pa.float64())], names=names)

    return run


def score(docs: DataFrame, model: AttentionModel, name: str = "score") -> DataFrame:
    """docs with a column `name` from 0 to 1; only text is read for it, whole, runs without blanks in pieces.

    Equal texts get equal scores; a null or empty text gets the score of a zero passage. Repeated rows get a row each,
    other columns pass through, one that is called `name` already is replaced. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    from pyspark.sql.types import DoubleType, StructField, StructType

    keep = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() != name.lower()]
    fields = [*(docs.schema.fields[i] for i in keep), StructField(name, DoubleType())]
    at = [f.name.lower() for f in docs.schema.fields].index("text")
    return docs.mapInArrow(_score(model, at, keep, [f.name for f in fields]), StructType(fields))


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_folds(docs: DataFrame, labels: DataFrame, label: str = "quality") -> AttentionModel:
    return fit(docs, labels.where(~held_out()), label)
