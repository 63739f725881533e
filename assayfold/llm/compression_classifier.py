"""Quality classifier by compression: how much better does a text compress beside good texts than beside bad ones?

Two zstandard dictionaries are built from labelled texts of either kind. A text's normalised difference of compressed
sizes, with its plain compressibility and length, goes through a logistic calibration fitted on other labelled texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: Labelled rows of either kind used to fit, the text bytes they may have together, a dictionary's bytes, and the level.
ROWS, BYTES, DICTIONARY, LEVEL = 2000, 16 << 20, 112 << 10, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    level: int = LEVEL


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        make = lambda d: zstandard.ZstdCompressor(
            level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False
        ) if d else self.plain
        self.plain = zstandard.ZstdCompressor(level=model.level, write_content_size=False)
        self.good, self.bad = make(model.good), make(model.bad)

    def features(self, raw: bytes) -> list[float]:
        n = max(1, len(raw))
        good, bad, plain = (len(c.compress(raw)) for c in (self.good, self.bad, self.plain))
        return [(bad - good) / max(good, bad), (bad - good) / n, (plain - good) / n, plain / n, float(np.log1p(n))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features((t or "").encode("utf-8", "surrogatepass")) for t in texts], float).reshape(len(texts), -1)
        z = (x - self.m.means) / self.m.scales @ np.array(self.m.weights[1:]) + self.m.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the samples are too few to train one, their own bytes (zstandard takes both)."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:size]


def train(texts: list[tuple[str, int]], dictionary: int = DICTIONARY, level: int = LEVEL, odds: float | None = None) -> Model:
    """Every other text of a kind builds its dictionary, of those of its lines that no other text has; the others fit the
    calibration, whole. With one kind only, or none,
    the score is the constant share of good texts (0.5 without texts). odds: of good against bad among all labelled
    rows, where the texts hold the kinds in other shares."""
    raw = [[t.encode("utf-8", "surrogatepass") for t, y in texts if y == k] for k in (0, 1)]
    n_bad, n_good = map(len, raw)
    width = 5
    if min(n_bad, n_good) < 2:
        share = (n_good + 0.5) / (n_bad + n_good + 1)
        return Model(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * width), (0.0,) * width, (1.0,) * width, level)
    # a line that several texts hold is boilerplate of either kind, and no sign of one
    held = Counter(x for k in (0, 1) for t in raw[k] for x in set(t.split(b"\n")))
    own = lambda texts: [b"\n".join(x for x in t.split(b"\n") if held[x] == 1) for t in texts]
    model = Model(
        _dictionary(own(raw[1][::2]), dictionary),
        _dictionary(own(raw[0][::2]), dictionary),
        (0.0,) * (width + 1),
        (0.0,) * width,
        (1.0,) * width,
        level,
    )
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for k in (0, 1) for t in raw[k][1::2]])
    y = np.repeat([0.0, 1.0], [len(raw[0][1::2]), len(raw[1][1::2])])
    means, scales = x.mean(0), np.maximum(x.std(0), 1e-9)
    a, w = np.column_stack([np.ones(len(x)), (x - means) / scales]), np.zeros(width + 1)
    ridge = np.diag([1e-6] + [0.1] * width)
    for _ in range(50):  # Newton steps of the ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    if odds:
        w[0] += np.log(odds * y.tolist().count(0.0) / y.sum())
    return Model(model.good, model.bad, tuple(map(float, w)), tuple(map(float, means)), tuple(map(float, scales)), level)


def held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text leaves 1 modulo 3: such rows are never learnt from. False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, max_bytes: int = BYTES) -> Model:
    """A model from at most `rows` labelled rows of either kind, in the order of a hash of their ids, and at most
    `max_bytes` of their texts (both bounds documented parameters); a text is taken whole or not at all. Held-out rows,
    rows without a label or text, and ids that carry both labels are left out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    n = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    order = F.xxhash64("doc_id", F.lit(10))
    chosen = {r.doc_id: r.quality for k in (0, 1) for r in known.where(F.col("quality") == k).orderBy(order, "doc_id").limit(rows).collect()}
    if not chosen:
        return train([])
    def of(ids) -> DataFrame:
        """Rows of docs with one of these ids, 2 * rows at most."""
        few = docs.sparkSession.createDataFrame([(int(k),) for k in ids], "doc_id long")
        return docs.where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id", "left_semi")

    mine = of(chosen)
    sizes = {r.doc_id: r.n for r in mine.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).collect()}
    taken, room = [], {0: max_bytes // 2, 1: max_bytes // 2}
    for k in chosen:  # in hash order
        if sizes.get(k, max_bytes) <= room[chosen[k]]:
            room[chosen[k]] -= sizes[k]
            taken.append(k)
    texts = {r.doc_id: r.text for r in of(taken).groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return train([(texts[k], chosen[k]) for k in taken if k in texts], odds=n[1] / n[0] if len(n) == 2 else None)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a double column from 0 to 1, higher where a text is likelier good. Null texts count as empty; every row
    is scored for itself, so repeated rows score alike and an empty table stays empty. A column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(column)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of bounded size
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scorer.scores(batch.column(at).to_pylist()), pa.float64())], [*batch.schema.names, column]
            )

    return docs.mapInArrow(run, schema)


def crc_mod_3(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
