"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import WordHashes, hashed_sample, map_batches, saved, stored
from courtline.llm.language_id import fit_platt, fit_softmax

#: Documented bound of the sample of labelled rows.
LABELLED_ROWS = 5_000
WORD_SLOTS = 2048
SHAPES = 8
META_SLOTS = 256
ROUNDS = 4
#: Rows each view hands to the other in a round, as a share of its labelled rows, and how sure.
HANDED = 0.1
SURE = 0.9
#: Of the labelled rows, one of so many calibrates and is never trained on.
CALIBRATION = 4

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>{}[]_^~=+\\/@!")] = True


def text_view(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashed word counts of the whole text (square roots, unit length) and its shape."""
    raw = text.encode()
    words = raw.split()
    out = np.zeros(WORD_SLOTS + SHAPES, np.float32)
    if not words:
        return out
    slots = (hashes.of(words) % np.uint64(WORD_SLOTS)).astype(np.int64)
    counts = np.sqrt(np.bincount(slots, minlength=WORD_SLOTS))
    out[:WORD_SLOTS] = counts / np.sqrt((counts * counts).sum())
    b = np.frombuffer(raw, np.uint8)
    letters = ((b | 32) >= 97) & ((b | 32) <= 122)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[WORD_SLOTS:] = (
        min(1.0, np.log1p(len(words)) / 10), len(set(words)) / len(words), _SYMBOLS[b].mean(),
        ((b >= 65) & (b <= 90)).sum() / max(1, letters.sum()), ((b >= 48) & (b <= 57)).mean(),
        min(1.0, len(raw) / len(words) / 20), 1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
    )
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """What the row says about the page: source, language, size class, and their pairs."""
    size = "none" if n_chars is None else str(int(np.log2(max(1, n_chars))))
    out = np.zeros(META_SLOTS, np.float32)
    for name in (f"s={source}", f"l={lang}", f"n={size}", f"s={source} l={lang}", f"l={lang} n={size}"):
        out[xxhash.xxh32_intdigest(name) % META_SLOTS] += 0.45
    return out


@dataclass
class View:
    """Weights of one view, with the curve that turns its margin into a probability."""

    mean: np.ndarray
    w: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + (self.w[-1] - self.mean @ self.w[:-1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.offset, -12, 12)


@dataclass
class Model:
    views: tuple[View, View]
    mix: np.ndarray
    rounds: list[tuple[int, int]]

    def score(self, x: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [v.logit(f) for v, f in zip(self.views, x, strict=True)]
        both = np.clip(self.mix[0] * z[0] + self.mix[1] * z[1] + self.mix[2], -30, 30)
        return tuple(1 / (1 + np.exp(-v)) for v in (both, z[0], z[1]))


def _fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean = x.mean(axis=0)
    scale = np.float32(4)
    design = np.ones((len(x), x.shape[1] + 1), np.float32)
    np.subtract(x, mean, out=design[:, :-1])
    design[:, :-1] *= scale
    w = fit_softmax(design, y, 2)
    w = w[:, 1] - w[:, 0]
    return View(mean, np.append(w[:-1] * scale, w[-1]))


def _stack(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the two calibrated log odds, held near an even mix by a ridge."""
    design = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    start = np.array([0.5, 0.5, 0.0])
    w = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.eye(3)
        w = w - np.linalg.solve(hess, design.T @ (p - y) + (w - start))
    return w


def cotrain(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Pool, rounds: int = ROUNDS) -> Model:
    """Two views teach each other: each hands the other its surest rows of the pool.

    A row handed over leaves the pool. Both classes are handed in the proportion of the
    labels. Rows of the calibration part fit the curves and the mix only.
    """
    held = np.arange(len(y)) % CALIBRATION == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:  # too few rows to set any aside
        held = np.zeros(len(y), bool)
    train = [(f[~held], y[~held]) for f in x]
    taken: set[int] = set()
    handed = []
    good = y.mean()
    quota = max(2, int(HANDED * len(y)))
    sizes = (int(quota * (1 - good)) + 1, int(quota * good) + 1)
    for _ in range(rounds):
        views = [_fit_view(*t) for t in train]
        for view, f in zip(views, x, strict=True):
            # a view's own curve decides how sure it is
            part = f[held] if held.any() else f
            known = y[held] if held.any() else y
            view.slope, view.offset = fit_platt(view.margin(part), 2.0 * known - 1)
        # so many that those the other view or class takes first cannot use them up
        surest = pool.surest(views, taken, 2 * sum(sizes))
        chosen = []
        for giver in (0, 1):
            ids: list[int] = []
            labels: list[int] = []
            for label in (1, 0):
                got = [i for i in surest[giver, label] if i not in taken][: sizes[label]]
                taken.update(got)
                ids += got
                labels += [label] * len(got)
            chosen.append((ids, labels))
        handed.append(tuple(len(ids) for ids, _ in chosen))
        if not taken or not any(handed[-1]):
            break
        vectors = pool.vectors([i for ids, _ in chosen for i in ids])
        for taker, (ids, labels) in ((1, chosen[0]), (0, chosen[1])):
            if ids:
                f, known = train[taker]
                train[taker] = (np.concatenate([f, np.stack([vectors[i][taker] for i in ids])]), np.concatenate([known, labels]))
    views = [_fit_view(*t) for t in train]
    part = [f[held] if held.any() else f for f in x]
    known = y[held] if held.any() else y
    for v, f in zip(views, part, strict=True):
        v.slope, v.offset = fit_platt(v.margin(f), 2.0 * known - 1)
    z = np.stack([v.logit(f) for v, f in zip(views, part, strict=True)], axis=1)
    return Model(tuple(views), _stack(z, known), handed)


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def _views(hashes: WordHashes, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = [batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")]
    text = np.stack([text_view(t or "", hashes) for t in rows[0]])
    return text, np.stack([meta_view(*r) for r in zip(*rows[1:], strict=True)])


def _packed(hashes: WordHashes):
    """Both views of a row as one sparse vector: places (uint16) and values (float16)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not batch.num_rows:
            return
        rows = np.concatenate(_views(hashes, batch), axis=1)
        at = [r.nonzero()[0] for r in rows]
        yield {
            "doc_id": batch.column("doc_id").to_pylist(), "free": [t is not None for t in batch.column("text").to_pylist()],
            "at": [i.astype(np.uint16).tobytes() for i in at], "v": [r[i].astype(np.float16).tobytes() for r, i in zip(rows, at, strict=True)],
        }

    return run


def _dense(at: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(WORD_SLOTS + SHAPES + META_SLOTS, np.float32)
    out[np.frombuffer(at, np.uint16)] = np.frombuffer(v, np.float16)
    return out[: WORD_SLOTS + SHAPES], out[WORD_SLOTS + SHAPES :]


@dataclass
class Pool:
    """All rows without a label: a stored table of packed vectors (doc_id, at, v), and the labelled ids.

    Vectors are scored where they stand. Only ids of sure rows leave the tasks, and it is they
    that are compared with ``labelled`` (doc_id), so no vector is shuffled whatever the size.
    """

    rows: DataFrame
    labelled: DataFrame

    def surest(self, views: list[View], taken: set[int], n: int) -> dict[tuple[int, int], list[int]]:
        """(view, class) -> the ``n`` ids of the pool it is surest of, surest first."""
        gone = np.array(sorted(taken), np.int64)

        def score(batch: pa.RecordBatch) -> Iterator[dict]:
            out = {"view": [], "label": [], "doc_id": [], "sure": []}
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            if not len(ids):
                return
            ats = [np.frombuffer(b, np.uint16) for b in batch.column("at").to_pylist()]
            at, v = np.concatenate(ats), np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float16).astype(np.float64)
            row = np.repeat(np.arange(len(ids)), [len(a) for a in ats])
            left = ~np.isin(ids, gone)
            split = WORD_SLOTS + SHAPES
            for k, view in enumerate(views):
                mine = at >= split if k else at < split
                place = at[mine].astype(np.int64) - (split if k else 0)
                margin = np.bincount(row[mine], v[mine] * view.w[place], len(ids)) + view.w[-1] - view.mean @ view.w[:-1]
                p = 1 / (1 + np.exp(-np.clip(view.slope * margin + view.offset, -12, 12)))
                for label, sure in ((1, p), (0, 1 - p)):
                    got = (left & (sure >= SURE)).nonzero()[0]
                    out["view"] += [k] * len(got)
                    out["label"] += [label] * len(got)
                    out["doc_id"] += ids[got].tolist()
                    out["sure"] += sure[got].tolist()
            yield out

        scored = saved(
            map_batches(self.rows, score, {"view": "int", "label": "int", "doc_id": "long", "sure": "double"})
            .groupBy("view", "label", "doc_id").agg(F.max("sure").alias("sure"))
            .join(self.labelled, "doc_id", "left_anti")
        )
        return {
            (k, label): [
                r["doc_id"] for r in
                scored.filter((F.col("view") == k) & (F.col("label") == label)).orderBy(F.desc("sure"), "doc_id").limit(n).collect()
            ]
            for k in (0, 1) for label in (0, 1)
        }

    def vectors(self, ids: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        asked = self.rows.sparkSession.createDataFrame([(i,) for i in ids], "_i bigint")
        got = self.rows.join(F.broadcast(asked), F.col("doc_id") == F.col("_i")).groupBy("doc_id").agg(F.min(F.struct("at", "v")).alias("x")).collect()
        return {r["doc_id"]: _dense(r["x"]["at"], r["x"]["v"]) for r in got}


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from a bounded sample of labelled rows and all unlabelled ones; None without two classes."""
    known = (
        labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    )
    # the text is read and hashed once for all rounds
    packed = stored(map_batches(
        _columns(docs).filter("doc_id is not null"), _packed(WordHashes()), {"doc_id": "long", "free": "boolean", "at": "binary", "v": "binary"}
    ))
    chosen = hashed_sample(known, "doc_id", LABELLED_ROWS, "labelled").select(F.col("doc_id").alias("_l"), "y")
    got = packed.join(F.broadcast(chosen), F.col("doc_id") == F.col("_l")).select("doc_id", "y", "at", "v").toPandas()
    if got.y.nunique() < 2:
        return None
    got = got.sort_values(["doc_id", "at", "v"], kind="stable")
    parts = tuple(np.stack(x) for x in zip(*(_dense(a, v) for a, v in zip(got["at"], got["v"], strict=True)), strict=True))
    pool = Pool(packed.filter("free").select("doc_id", "at", "v"), known.select("doc_id"))
    return cotrain(parts, got.y.to_numpy(), pool)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source, lang, n_chars): score, p_text, p_meta, kept.

    ``labels`` (doc_id, quality) teach. ``score`` is the calibrated probability of good
    quality from both views; ``kept`` means 0.5 or more. All documents are scored in one pass
    without a shuffle.

    Null or blank text: all three 0, not kept. Without labels of both classes every text gets
    0.5 and is kept. A null or absent source, lang or n_chars is a value of its own. Several
    labels of one document: the lowest. Repeated rows and null ids are scored row by row.
    """
    model = train(docs, labels)
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        n = batch.num_rows
        blank = np.array([not (t or "").strip() for t in batch.column("text").to_pylist()], bool)
        parts = [np.full(n, 0.5)] * 3 if model is None or not n else model.score(_views(hashes, batch))
        parts = [np.where(blank, 0.0, p) for p in parts]
        yield {
            "doc_id": batch.column("doc_id").to_pylist(), "score": parts[0], "p_text": parts[1], "p_meta": parts[2],
            "kept": parts[0] >= 0.5,
        }

    return map_batches(_columns(docs), run, {"doc_id": "long", "score": "double", "p_text": "double", "p_meta": "double", "kept": "boolean"})
