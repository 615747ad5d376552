"""Language identification: family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import map_batches

#: Language families by code; a code not listed is a family of its own.
FAMILIES = {
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be"),
}
#: Feature slots, and training rows over all languages together (an even share for each).
SLOTS = 4096
TRAINING_ROWS = 4_000
#: Bytes counted at once; a longer text is counted piece by piece.
PIECE = 1 << 20

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), f"only {lang}")


def features(text: str, slots: int = SLOTS) -> np.ndarray:
    """Counts of hashed byte pairs and triples of the whole text, square-rooted, unit length."""
    raw = text.encode()
    counts = np.zeros(slots)
    for at in range(0, max(len(raw), 1), PIECE):
        piece = b" " + b" ".join(raw[max(0, at - 2) : at + PIECE].translate(_KEEP).split()) + b" "
        b = np.frombuffer(piece, np.uint8).astype(np.uint32)
        two = b[:-1] | (b[1:] << np.uint32(8))
        for grams in (two, two[:-1] | (b[2:] << np.uint32(16)) | np.uint32(1 << 30)):
            if len(grams):
                h = (grams * np.uint32(2654435761)) >> np.uint32(16)
                counts += np.bincount(h % np.uint32(slots), minlength=slots)
    counts = np.sqrt(counts)
    norm = np.sqrt((counts * counts).sum())
    return (counts / norm if norm else counts).astype(np.float32)


def _descend(x: np.ndarray, slope, w: np.ndarray, rate: float, steps: int) -> np.ndarray:
    """Accelerated gradient steps; ``slope`` gives the gradient of the mean loss."""
    at, before = w, w
    for k in range(steps):
        w = at - np.float32(rate) * slope(at)
        at = w + np.float32(k / (k + 3)) * (w - before)
        before = w
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Linear SVM (squared hinge); y is +1 or -1, both sides weigh the same. Rows with y 0 do not count."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * (y != 0)
    weight, y, reg = weight.astype(np.float32), y.astype(np.float32), np.float32(reg)

    def slope(w):
        short = np.maximum(0, 1 - y * (x @ w))
        return -2 * (x.T @ (weight * y * short)) + reg * w

    return _descend(x, slope, np.zeros(x.shape[1], np.float32), 1 / (4 + reg), steps)


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, reg: float = 1e-4, steps: int = 120, rate: float = 1.0) -> np.ndarray:
    hot = np.eye(k, dtype=np.float32)[y]
    weight = (1 / np.maximum(1, hot.sum(axis=0)))[y][:, None] / np.float32(k)
    reg = np.float32(reg)

    def slope(w):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return x.T @ (weight * (p - hot)) + reg * w

    return _descend(x, slope, np.zeros((x.shape[1], k), np.float32), rate, steps)


def fit_platt(margin: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins (Newton, smoothed labels)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    want = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        w = w - np.linalg.solve(hess, design.T @ (p - want))
    return float(w[0]), float(w[1])


@dataclass
class Model:
    """Family weights and, for each pair of languages of one family, an SVM with its curve."""

    mean: np.ndarray
    families: list[list[str]]
    family_w: np.ndarray
    pairs: dict[tuple[str, str], tuple[np.ndarray, float, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x - self.mean, np.float32(1))
        z = x @ self.family_w
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        langs = self.families[best]
        votes = np.zeros(len(langs))
        for i, j in itertools.combinations(range(len(langs)), 2):
            w, a, b = self.pairs[langs[i], langs[j]]
            q = 1 / (1 + np.exp(-np.clip(a * (x @ w) + b, -30, 30)))
            votes[i] += q
            votes[j] += 1 - q
        share = votes / max(1, len(langs) - 1) if len(langs) > 1 else np.ones(1)
        return langs[int(share.argmax())], float(min(1.0, max(0.0, p[best] * share.max())))


def fit(rows: list[tuple[str, bytes]]) -> Model | None:
    """Model of (language, feature bytes) rows; None without rows."""
    if not rows:
        return None
    rows = sorted(rows)
    lang = np.array([r[0] for r in rows])
    langs = sorted(set(lang.tolist()))
    names = sorted({family_of(x) for x in langs})
    families = [[x for x in langs if family_of(x) == n] for n in names]
    # the one matrix on the driver; everything below works in place or through weights
    x = np.ones((len(rows), len(rows[0][1]) // 2 + 1), np.float32)
    for i, (_, vector) in enumerate(rows):
        x[i, :-1] = np.frombuffer(vector, np.float16)
    rows.clear()
    mean = x[:, :-1].mean(axis=0)
    x[:, :-1] -= mean
    of = np.array([names.index(family_of(v)) for v in lang])
    # centred unit vectors are short, so that larger steps are safe
    model = Model(mean, families, fit_softmax(x, of, len(names), reg=5e-6, rate=20.0))
    for members in families:
        for a, b in itertools.combinations(members, 2):
            y = (lang == a).astype(float) - (lang == b)
            w = fit_svm(x, y)
            model.pairs[a, b] = (w, *fit_platt((x @ w)[y != 0], y[y != 0]))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _vectors(batch: pa.RecordBatch) -> Iterator[dict]:
    yield {
        "lang": batch.column("lang").to_pylist(),
        "x": [features(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()],
    }


def _predict(model: Model | None, text: str | None) -> tuple[str, float]:
    if model is None or not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    return model.predict(features(text))


def _predictor(model: Model | None):
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_predict(model, t) for t in texts], columns=["lang_pred", "score"])

    return predict


def train(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> Model | None:
    """Fit on at most about ``training_rows`` rows, an even share per language.

    The sample is the documented bound of this operator: of each language the rows whose
    hashed id falls under share / rows of that language. The vectors (8 KB each) go to the
    driver.
    """
    usable = docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string")
    ).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = training_rows / len(counts)
    limit = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, share / n)])
    unit = (F.xxhash64("doc_id", F.lit("language")) + F.lit(float(2**63))) / F.lit(float(2**64))
    chosen = usable.filter((unit < limit[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))
    rows = map_batches(chosen.select("lang", "text"), _vectors, {"lang": "string", "x": "binary"}).collect()
    return fit([(r["lang"], bytes(r["x"])) for r in rows])


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with lang_pred and score; the model, if not given, is trained on them first.

    One pass, no shuffle. Columns of these names are replaced.
    """
    model = model or train(docs)
    told = docs.withColumn("_told", _predictor(model)(F.col("text").cast("string")))
    return told.withColumns({"lang_pred": F.col("_told.lang_pred"), "score": F.col("_told.score")}).drop("_told")


def language_id(docs: DataFrame) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from rows with a language whose crc32(doc_id) mod 4 is not 2, predicts from text
    alone. ``und`` with score 0 where the text is null or has no letter, or where no row has
    a language. Null doc_id: predicted, never learned from, held_out false. Repeated rows
    give repeated result rows; other columns are ignored.
    """
    slim = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"))))
    return identified(slim).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
