"""Operator 6, language ID: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's features are the byte 2- to 5-grams of its lower-cased words (a word's border counts as a space), hashed
into ``BUCKETS`` rows of an embedding table. The text's vector is the average of its features' rows; a linear softmax
turns it into language probabilities. Training takes windows of a bounded sample: about ``sample_bytes`` of texts per
language, drawn by a hash of id and text so that it needs no order (its expected size is the bound; texts above
``longest`` bytes aren't drawn for training). Prediction reads every whole text: embedding times output layer is one
small table (buckets x languages), so a text costs one gather and sum per feature.

Calibration: a quarter of the sample is left out of training. On its whole texts and on short openings of them a
temperature is fitted, and the rejection threshold is the score that all but ``loss`` of the right predictions reach, at most 1/2 (a
prediction that is likelier than not is never rejected). A rejected document keeps its
prediction; ``rejected`` says so. ``und`` (no letter) is always rejected.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0; a null label trains nothing;
without any labelled text all is ``und``; repeated rows are predicted each; only id, text and label are read, the
label for training alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, text_slices, tidy

BUCKETS, ORDERS, DIM = 1 << 16, (2, 3, 4, 5), 16
_PRIME, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of all texts, one after the other, and the number of each text's."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    padded = pc.binary_join_element_wise("", low, "", " ")  # a space before and after each text
    sizes = pc.binary_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.frombuffer(padded.buffers()[1], np.int32)[padded.offset]
    data = np.frombuffer(padded.buffers()[2], np.uint8)[first:first + sizes.sum()].copy()
    data[(data >= 9) & (data <= 13)] = 32
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    space = data == 32
    code = data.astype(np.uint32) + np.uint32(1)
    hashed, owner = [], []
    state = np.full(len(data), 0x811C9DC5, np.uint32)
    inner = np.ones(len(data), bool)  # no space strictly inside, and within one text
    for n in range(1, max(ORDERS) + 1):
        usable = len(data) - n + 1
        if usable <= 0:
            break
        state = (state[:usable] ^ code[n - 1:]) * _PRIME
        inner = inner[:usable]
        if n > 2:
            inner = inner & ~space[n - 2:n - 2 + usable]
        if n in ORDERS:
            good = inner & (text_of[:usable] == text_of[n - 1:]) & ~(space[:usable] & space[n - 1:] & (n == 2))
            x = state[good] * _MIX
            hashed.append(x >> np.uint32(32 - BUCKETS.bit_length() + 1))
            owner.append(text_of[:usable][good])
    if not hashed:
        return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    owner, hashed = np.concatenate(owner), np.concatenate(hashed)
    order = np.argsort(owner, kind="stable")
    return hashed[order].astype(np.int64), np.bincount(owner, minlength=len(sizes))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times output layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        """One row per text; sums run per n-gram order, in the texts' order."""
        hashed, count = features(texts)
        ends = np.cumsum(count)
        sums = np.empty((len(count), len(self.languages)))
        for k in range(len(self.languages)):
            run = np.append(0.0, np.cumsum(self.table[hashed, k], dtype=np.float64))
            sums[:, k] = run[ends] - run[ends - count]
        return sums / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language (ties: the first) and its calibrated probability."""
        x = self.logits(texts) / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        x /= x.sum(axis=1, keepdims=True)
        return x.argmax(axis=1), x.max(axis=1)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their shares, per text; texts without features are left out."""
    hashed, count = features(pa.array(texts, pa.string()))
    out = []
    for part in np.split(hashed, np.cumsum(count)[:-1]):
        ids, n = np.unique(part, return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 2.0, window: int = 300, loss: float = 0.002,
        seed: int = 7) -> Model:
    """Train on (text, language) rows: windows of ``window`` characters, three of four rows of each language; calibrate on the rest."""
    rng = np.random.default_rng(seed)
    rows = sorted(rows)
    languages = sorted({x for _, x in rows})
    place = {x: i for i, x in enumerate(languages)}
    order = rng.permutation(len(rows))
    seen, number = Counter(), {}
    for i in order.tolist():  # every fourth row of each language calibrates
        seen[rows[i][1]] += 1
        number[i] = seen[rows[i][1]]
    held, train = ([i for i in order.tolist() if (number[i] % 4 == 0) == spare] for spare in (True, False))
    parts, labels = [], []
    for i in train:
        text, language = rows[i]
        for size, at in ((window, 0), (window, rng.random()), (window // 5, rng.random())):
            at = int(at * max(1, len(text) - size + 1))
            parts.append(text[at:at + size])
            labels.append(place[language])
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    bags, labels = _bags(parts), np.array(labels)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            vector = share @ embedding[ids]
            x = vector @ out + bias
            x = np.exp(x - x.max())
            error = x / x.sum()
            error[labels[i]] -= 1
            error *= np.float32(rate * (1 - done / steps))
            back = out @ error
            out -= np.outer(vector, error)
            bias -= np.float32(0.01) * error
            embedding[ids] -= np.float32(10) * share[:, None] * back
            done += 1
    model = Model(languages, embedding @ out, bias.astype(np.float64))
    spare = [rows[i] for i in (held if len(held) else train)]
    calibrate(model, [(x, y) for text, y in spare for x in (text, text[:window // 5])], place, loss)
    return model


def calibrate(model: Model, rows: list[tuple[str, str]], place: dict[str, int], loss: float) -> None:
    """Fit the temperature by likelihood on ``rows``, then the threshold that loses ``loss`` of right predictions."""
    truth = np.array([place[x] for _, x in rows])
    logits = model.logits(pa.array([t for t, _ in rows], pa.string()))

    def cost(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(-(x[np.arange(len(truth)), truth] - np.log(np.exp(x).sum(axis=1))).mean())

    model.temperature = min(2.0 ** np.arange(0, 4.25, 0.25), key=cost)
    guess, score = model.predict(pa.array([t for t, _ in rows], pa.string()))
    right = np.sort(score[guess == truth])
    model.threshold = min(0.5, float(right[int(loss * len(right))])) if len(right) else 0.0


def train(df: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "lang", sample_bytes: int = 1 << 20, longest: int = 1 << 16) -> Model | None:
    """A model from about ``sample_bytes`` of labelled texts per language among the ``usable`` rows.

    Of a text of over ``longest`` characters, a window of that length counts and may be drawn; where it lies depends on the text's hash.
    """
    rows = df.where(usable) if usable is not None else df
    rows = rows.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       F.col(label_col).cast("string").alias("_label"))
    start = F.pmod(F.xxhash64("_text"), F.greatest(F.length("_text") - longest + 1, F.lit(1))).cast("int") + 1
    rows = rows.where(F.col("_label").isNotNull()).withColumn("_text", F.substring("_text", start, longest))
    rows, size = rows.where(F.col("_text").rlike(r"\p{L}")), F.octet_length("_text")
    volume = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.sum(size).alias("n")).collect()}
    if not volume:
        return None
    draw = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(volume.items()) for x in (k, sample_bytes / n)]),
                         F.col("_label"))
    sample = rows.where(draw < share).select("_text", "_label").collect()
    return fit([(r["_text"], r["_label"]) for r in sample])


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, lang_pred, score, rejected."""
    ship(df.sparkSession)
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col), text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_any"))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(tidy(_predictor(spark_model(df, model), [id_col, "lang_pred", "score", "rejected"], None)), schema)


def keep(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not rejected, unchanged."""
    ship(df.sparkSession)
    text = F.col(text_col).cast("string")
    rows = df.select(F.struct("*").alias("_row"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_any"))
    keep_rows = _predictor(spark_model(df, model), ["_row"], "keep")
    place = df.columns.index(text_col)

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text is taken out of the row's struct, so it crosses to Python once."""
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pc.struct_field(x.column(0), [place]).cast(pa.string()), x.column(1)],
                                             ["_row", "_text", "_any"])

    return rows.mapInArrow(tidy(lambda batches: keep_rows(with_text(batches))),
                           f"_row {rows.schema['_row'].dataType.simpleString()}").select("_row.*")


def spark_model(df: DataFrame, model: Model | None):
    """The model as a broadcast: BUCKETS x languages floats, whatever the input's size."""
    return df.sparkSession.sparkContext.broadcast(model)


def _predictor(model, names: list[str], mode: str | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=1 << 18):
            known = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            if model.value is not None and known.any():
                guess, sure = model.value.predict(part.column(1).filter(pa.array(known)))
                lang[known] = np.array(model.value.languages, object)[guess]
                score[known] = sure
            rejected = ~known | (score < (model.value.threshold if model.value else 0))
            if mode == "keep":
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(~rejected))], names)
            else:
                columns = [part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows


def held_out(id_col: str = "doc_id") -> Column:
    """Ids whose crc32 (as text) leaves 1 modulo 3: never used for training."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1
