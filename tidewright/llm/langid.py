"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; for each bit a binary classifier over hashed byte n-grams tells the languages with a
one from those with a zero. Decoding is loss-weighted: a codeword's loss is the sum of the bits' losses, each weighted by
how well its classifier separates the training texts, and the nearest codeword wins. If the next nearest is almost as
near, the text is flagged as ambiguous.

The classifiers are linear (log-odds of the n-grams on either side of the bit), so that training is one aggregation: counts
of n-grams by language, added up over all labelled rows. The counts have a fixed size, languages times ``FEATURES``.

Defined cases: null or a text without a letter is ``und`` with score 0 and not ambiguous; without labelled rows all are
``und``; with one language in them, every text with a letter is that language; a null label isn't learnt from; ties between
codewords go to the first language in order; repeated rows count as often as they come; an empty table gives no rows.
Predictions see the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructField, StructType

from tidewright.llm.common import map_arrow

#: Hashed n-gram features, and the lengths of the n-grams in bytes of the lower-cased text.
FEATURES, ORDERS = 1 << 14, (1, 2, 3)
#: Random bits in a codeword beside one for each language.
EXTRA_BITS = 15
#: Bytes of a text whose features are counted at a time.
BLOCK = 1 << 20
#: The nearest codeword must be nearer than the next by this share of the loss between them.
MARGIN = 0.02
UNKNOWN = "und"


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of a whole text."""
    data = np.frombuffer(b" " + " ".join(text.lower().split()).encode() + b" ", dtype=np.uint8)
    counts = np.zeros(FEATURES, dtype=np.int64)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + max(ORDERS) - 1].astype(np.uint32)
        for n in ORDERS:
            m = min(BLOCK, len(part) - n + 1)
            if m <= 0:
                continue
            code = np.full(m, n, dtype=np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) ^ part[k : k + m]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)
            counts += np.bincount(code, minlength=FEATURES)
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language of the task: its counts, the number of texts, and the sum of squares (for the bits' weights)."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            seen = total.setdefault(lang, np.zeros(FEATURES))
            counts = features(text.as_py())
            seen += counts / counts.sum()  # each text weighs the same, whatever its length
    for lang, seen in total.items():
        used = np.flatnonzero(seen)
        for at in range(0, len(used), 4096):
            part = used[at : at + 4096]
            yield pa.record_batch(
                [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.int32()), pa.array(np.round(seen[part] * 2**40).astype(np.int64))],
                names=["lang", "feature", "weight"],
            )


def codewords(n: int) -> np.ndarray:
    """A codeword for each of n languages: one bit for each language, then balanced random bits; all differ widely."""
    one_each = np.eye(n, dtype=np.int8)
    random = np.random.default_rng(7)
    extra = np.array([random.permutation(np.arange(n) % 2) for _ in range(EXTRA_BITS)], dtype=np.int8).T.reshape(n, -1)
    code = np.concatenate([one_each, extra], axis=1)
    return code[:, (code.min(axis=0) != code.max(axis=0))] if n > 1 else code[:, :1]


class Model:
    """Codewords, and for each bit a weight for each feature, an offset and the bit's weight in decoding."""

    def __init__(self, languages: list[str], sums: np.ndarray) -> None:
        self.languages = languages
        self.code = codewords(len(languages))
        share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)  # by language
        columns, scale = [], []
        for bit in self.code.T:
            sides = [share[bit == v].mean(axis=0) if (bit == v).any() else share.mean(axis=0) for v in (1, 0)]
            odds = np.log((sides[0] + 1e-6) / (sides[1] + 1e-6))
            # What a mean text of each language scores on this bit: the middle is the offset, the gap the scale.
            scores = share @ odds
            high, low = (scores[bit == v] if (bit == v).any() else scores for v in (1, 0))
            gap = max(high.min() - low.max(), 1e-3)
            columns.append(np.append(odds, -(high.min() + low.max()) / 2) / gap)
            scale.append(gap)
        self.weights = np.array(columns).T.astype(np.float64)
        scale = np.array(scale)
        self.bit_weight = scale / scale.sum()

    def predict(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """Language, score (0 to 1) and whether the next is almost as near."""
        bits = np.append(counts / max(counts.sum(), 1), 1.0) @ self.weights  # about +-1/2 or more on a clear bit
        sign = 2.0 * self.code - 1
        loss = (np.logaddexp(0, -4 * bits * sign) * self.bit_weight).sum(axis=1)
        if len(loss) == 1:
            return self.languages[0], 1.0, False
        order = np.argsort(loss, kind="stable")
        best, second = loss[order[0]], loss[order[1]]
        chance = np.exp(-8 * (loss - best))
        return self.languages[order[0]], float(1 / chance.sum()), bool(second - best < MARGIN * (second + best))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The model from all rows with a label and a letter; None if there are none.

    Each task sends at most ``FEATURES`` numbers for each language, and so does the aggregation in the end. All languages of the
    labels are learnt.
    """
    labelled = docs.where(F.col(lang).isNotNull() & has_letter(F.col(text))).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = map_arrow(labelled, _count, "lang string, feature int, weight bigint").groupBy("lang", "feature").agg(F.sum("weight").alias("weight"))
    rows = counted.groupBy("lang").agg(F.collect_list(F.struct("feature", "weight")).alias("used")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["lang"])
    sums = np.zeros((len(rows), FEATURES))
    for k, r in enumerate(rows):
        for feature, weight in r["used"]:
            sums[k, feature] = weight / 2**40
    return Model([r["lang"] for r in rows], sums)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for batch in batches:
        found = [m.predict(features(t.as_py())) if letter else (UNKNOWN, 0.0, False) for t, letter in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
        lang, score, ambiguous = zip(*found, strict=True) if found else ((), (), ())
        yield pa.record_batch(
            [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())],
            names=["id", "lang_pred", "score", "ambiguous"],
        )


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, ambiguous`` for every whole text; no shuffle. The model's size is bounded, so it is broadcast."""
    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), has_letter(F.col(text)).alias("letter"))
    if model is None:
        unknown = (F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
        return chosen.select(F.col("id").alias(key), *unknown)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(chosen.dtypes)["id"]
    schema = f"id {kind}, lang_pred string, score double, ambiguous boolean"
    return map_arrow(chosen, partial(_predict, model=sent), schema).withColumnRenamed("id", key)


def held_out(key: Column) -> Column:
    """The third of the rows that is kept from training: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_held_out(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Trains on the rows that aren't held out and predicts all: ``key, held_out, lang_pred, score, ambiguous``."""
    model = train(docs.where(~held_out(F.col(key))), text, lang)
    found = identify(docs, model, key, text)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "ambiguous")


def _judge_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for batch in batches:
        keep = []
        for t, letter in zip(batch.column("text"), batch.column("letter").to_pylist(), strict=True):
            keep.append(bool(letter) and not m.predict(features(t.as_py()))[2])
        yield batch.select(["whole"]).filter(pa.array(keep, pa.bool_()))


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without texts that have no letter or whose language stays ambiguous; columns, whatever their names, as they are.

    Where no row has a label there are no languages to tell apart, so nothing is ambiguous: every text with a letter stays.
    """
    model = train(docs, text, lang)
    if model is None:
        return docs.where(has_letter(F.col(text)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    marked = docs.select(whole, F.col(text).alias("text"), has_letter(F.col(text)).alias("letter"))
    return map_arrow(marked, partial(_judge_rows, model=sent), StructType([StructField("whole", docs.schema)])).select("whole.*")
