"""Near-duplicate documents by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import WordHashes, components, map_batches, mix, saved, signed, windows

#: Words of a shingle and per cent of similarity of the registered query.
SHINGLE = 3
PERCENT = 85
BINS = 128
ROWS_PER_BAND = 5
BANDS = BINS // ROWS_PER_BAND
#: Share of the bins two sketches must agree in before texts are fetched. At the default
#: threshold 0.85 a true pair falls below it with probability under 1e-6 (Chernoff).
AGREE = 0.65


def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence where it is shorter than one."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(size, len(words))))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One value for each bin.

    In round i < bins every item falls into a hashed bin with value (i, hash); in round
    bins + j every item falls into bin j, so that no bin stays empty. Values of later rounds
    are larger, so the rounds end as soon as all bins are filled: two or three rounds for
    sets above a few times ``bins``.
    """
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    if not len(items):
        return out
    shift = np.uint64(9)
    for i in range(2 * bins):
        with np.errstate(over="ignore"):
            h = mix(items + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
        value = (np.uint64(i) << np.uint64(55)) | (h >> shift)
        if i < bins:
            np.minimum.at(out, (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64), value)
        else:
            out[i - bins] = min(out[i - bins], value.min())
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def _sketches(shingle: int):
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"doc_id": batch.column("doc_id").to_pylist(), "n": [], "key": [], "bands": [], "sig": []}
        for text in batch.column("text").to_pylist():
            items = shingle_set((text or "").encode().lower().split(), shingle, hashes)
            out["n"].append(len(items))
            if not len(items):
                for c in ("key", "bands", "sig"):
                    out[c].append(None)
                continue
            s = sketch(items)
            rows = s[: BANDS * ROWS_PER_BAND].reshape(BANDS, ROWS_PER_BAND).T
            with np.errstate(over="ignore"):
                band = np.arange(BANDS, dtype=np.uint64)
                for row in rows:
                    band = mix(band * np.uint64(0xD6E8FEB86659FD93) + row)
            out["key"].append(xxhash.xxh3_128_digest(items.tobytes()))
            out["bands"].append(signed(band))
            out["sig"].append((mix(s) & np.uint64(255)).astype(np.uint8).tobytes())
        yield out

    return run


def _agreeing(least: float):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS)
            for c in ("sig_a", "sig_b")
        )
        keep = ((a == b).mean(axis=1) >= least).nonzero()[0]
        yield {c: batch.column(c).take(pa.array(keep)) for c in ("a", "b")}

    return run


def _verified(shingle: int, percent: int):
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out, last, y = {"a": [], "b": []}, None, None
        columns = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
        for a, b, text_a, text_b in zip(*columns, strict=True):
            if last != text_b:
                last, y = text_b, shingle_set(text_b.encode().lower().split(), shingle, hashes)
            x = shingle_set(text_a.encode().lower().split(), shingle, hashes)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out["a"].append(a)
                out["b"].append(b)
        yield out

    return run


def _with_sketches(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of fitting set sizes, each with both sketches."""
    a, b = (
        reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
        for c in ("a", "b")
    )
    return (
        pairs.select("a", "b").distinct().join(a, "a").join(b, "b")
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select("a", "b", "sig_a", "sig_b")
    )


def _links(docs: DataFrame, near: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the pairs with sketches those whose full shingle sets reach the threshold."""
    likely = saved(map_batches(
        near, _agreeing(min(AGREE, percent / 100 - 0.2)), {"a": "long", "b": "long"}
    ).distinct())
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    with_a = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return map_batches(
        with_b.select("a", "b", "text_a", "text_b"), _verified(shingle, percent), {"a": "long", "b": "long"}
    ).distinct()


def _rare(texts: DataFrame, shingle: int) -> DataFrame:
    """(holders): the one to three holders of each shingle that no more of ``texts`` hold."""
    hashes = WordHashes()

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            items = shingle_set((text or "").encode().lower().split(), shingle, hashes)
            yield {"a": np.full(len(items), doc_id), "h": signed(items)}

    few = (
        map_batches(texts, rows, {"a": "long", "h": "long"})
        .groupBy("h").agg(F.count("*").alias("k"), F.min("a").alias("a"), F.max("a").alias("b"), F.bit_xor("a").alias("x"))
        .filter("k <= 3")
    )
    # of three holders the exclusive or leaves the middle one
    third = F.col("a").bitwiseXOR(F.col("b")).bitwiseXOR(F.col("x"))
    held = F.when(F.col("k") == 3, F.array("a", third, "b")).when(F.col("k") == 2, F.array("a", "b")).otherwise(F.array("a"))
    return few.select(F.array_distinct(held).alias("holders"))


def _leftover(openly: DataFrame, texts: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of open bucket members in different components that may be linked, with sketches.

    A pair either shares a shingle with at most three holders, and is found by it, or its
    intersection is no larger than what either set has besides: ``common``. The second kind
    meets in the buckets, once, and only where that bound reaches the threshold. No possible
    link is lost.
    """
    rare = saved(_rare(texts, shingle))
    own = rare.select(F.explode("holders").alias("a")).groupBy("a").agg(F.count("*").alias("own"))
    label = openly.groupBy("a").agg(F.min("comp").alias("comp"))
    able = (
        reps.select(F.col("doc_id").alias("a"), "n", "bands", "sig").join(label, "a").join(own, "a", "left")
        .withColumn("common", F.col("n") - F.coalesce("own", F.lit(0)))
        .filter(100 * F.col("common") >= percent * F.col("n")).drop("own")
        .withColumn("bucket", F.explode("bands")).join(openly.select("bucket", "main").distinct(), "bucket")
    )
    strays = able.filter("comp <> main").select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("a", "comp", "n", "common", "bands", "sig")))
    # two strays meet once, and any two in the first of their buckets
    once = (F.col("comp") == F.col("main")) | (F.col("a") < F.col("a_b"))
    first = F.array_min(F.array_intersect("bands", "bands_b")) == F.col("bucket")
    both = F.least("common", "common_b")
    reach = 100 * both >= percent * (F.col("n") + F.col("n_b") - both)
    met = able.join(strays, "bucket").filter(once & (F.col("comp") != F.col("comp_b")) & reach & first)
    pair = F.explode(F.flatten(F.transform("holders", lambda x: F.transform(
        F.filter("holders", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b"))
    ))))
    sharing = (
        rare.filter(F.size("holders") > 1).select(pair.alias("p")).select("p.*").distinct().join(label, "a")
        .join(label.select(F.col("a").alias("b"), F.col("comp").alias("comp_b")), "b").filter("comp <> comp_b")
    )
    return met.select("a", F.col("a_b").alias("b"), F.col("sig").alias("sig_a"), F.col("sig_b")).union(
        _with_sketches(sharing, reps, percent)
    )


def _apart(bands: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket member and the bucket's smallest one that no link has joined yet.

    Documents get their component before their buckets are listed, and a bucket's smallest
    member brings its own along, so members of one component make no pair.
    """
    placed = (
        bands.join(label.select(F.col("node").alias("a"), "component"), "a", "left")
        .select(F.struct("a", F.coalesce("component", "a").alias("comp")).alias("m"), F.explode("bands").alias("bucket"))
    )
    smallest = placed.groupBy("bucket").agg(F.min("m").alias("s"))
    return (
        placed.join(smallest, "bucket").filter("m.comp <> s.comp")
        .select(F.col("m.a").alias("a"), F.col("s.a").alias("b"))
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of
    ``shingle``-word shingles (A-Z lower-cased); a component holds all documents reachable
    over links, and its smallest doc_id names it.

    * Documents with equal sets form one class; only its smallest doc_id goes on. The class is
      found by a map-side combined minimum, so thousands of copies cost one row per task.
    * Each class gives one bucket per band. A document first meets one other only, the smallest
      of all its buckets; then the smallest member of each bucket whose component it does not
      share yet. No two other members of a bucket meet.
    * Members whose component still differs from the bucket's most frequent one go through
      ``_leftover``, the exact way for what the stars missed.
    * Pairs must agree in enough bins, then the full sets decide.

    Rows that share a doc_id share a component.

    Null or blank text: no shingles, linked with nothing, own component. A null doc_id takes
    part through its class, but never as its name (null where the class has no other id).
    Repeated rows give repeated result rows; other columns are ignored; no rows, no result.
    """
    sk = saved(
        map_batches(
            docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), _sketches(shingle),
            {"doc_id": "long", "n": "long", "key": "binary", "bands": "longs", "sig": "binary"},
        )
    )
    classes = sk.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"))
    # a set of n reaches the threshold with a different set only if n / (n + 1) does
    least = percent // (100 - percent) + (percent % (100 - percent) > 0)
    reps = saved(
        sk.filter(F.col("n") >= least)
        .join(classes.select(F.col("key").alias("k"), "id"), (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("k")), "left_semi")
        .dropDuplicates(["doc_id", "key"])
    )
    bands = reps.select(F.col("doc_id").alias("a"), "bands")
    buckets = bands.select("a", F.explode("bands").alias("bucket"))
    centres = (
        buckets.groupBy("bucket").agg(F.min("a").alias("b"), F.count("*").alias("members")).filter("members > 1")
    )
    # one centre for each document, the smallest of its buckets
    nearest = buckets.join(centres, "bucket").groupBy("a").agg(F.min("b").alias("b")).filter("a <> b")
    star = saved(_links(docs, _with_sketches(nearest, reps, percent), shingle, percent))
    label = components(star)
    further = saved(_links(docs, _with_sketches(_apart(bands, label), reps, percent), shingle, percent))
    if further.limit(1).count():
        star = saved(star.union(further).distinct())
        label = components(star)

    # what the stars left open: buckets of three or more with members of several components
    state = (
        buckets.join(centres.filter("members > 2").select("bucket"), "bucket", "left_semi")
        .join(label, F.col("a") == F.col("node"), "left")
        .select("bucket", "a", F.coalesce("component", "a").alias("comp"))
    )
    most = (
        state.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
        .groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("kinds"))
        .filter("kinds > 1").select("bucket", F.col("top.comp").alias("main"))
    )
    openly = saved(state.join(most, "bucket"))
    texts = saved(docs.join(openly.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text"))
    rest = _leftover(openly, texts, reps, shingle, percent)
    more = saved(_links(texts, rest, shingle, percent))
    if more.limit(1).count():
        label = components(star.union(more))

    of_class = (
        classes.join(label, F.col("id") == F.col("node"), "left")
        .select("key", F.coalesce("component", "id").alias("c"))
    )
    return sk.join(of_class, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("c")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
