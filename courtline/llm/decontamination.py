"""Benchmark decontamination by template windows: numbers, names and units become slots."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import CACHE_WORDS, map_batches, mix, saved, signed, stored, windows

WINDOW = 5
#: Placeholders a window may hold to be a seed as a template; with more it is one by its values.
MAX_SLOTS = 2
#: Share of an item's tokens that an alignment must cover.
MIN_SHARE = 0.8
#: Slots of the membership bitmap: 2^24 bits, 2 MB whatever the benchmark's size.
BITMAP_BITS = 24
#: Rows that the items asked of one document are dealt to.
PARTS = 8

#: Units that turn into <unit> after a number, by themselves or attached to it.
UNITS = (
    "%|mm|cm|m|km|in|inch|inches|ft|feet|foot|mi|mile|miles|yard|yards|mg|g|kg|gram|grams|lb|lbs|oz|ton|tons|"
    "ml|l|liter|liters|litre|litres|s|sec|seconds|second|min|minute|minutes|h|hr|hour|hours|day|days|"
    "week|weeks|month|months|year|years|usd|eur|gbp|dollar|dollars|euro|euros|cent|cents|degree|degrees|"
    "°c|°f|k|w|kw|v|a|hz|khz|mhz|ghz|mb|gb|tb|mph|kmh|km/h|m/s"
)
_NUMBER = re.compile(rf"[-+$€£]?\d[\d.,:/]*(?:e[-+]?\d+)?({UNITS})?")
_UNIT_WORDS = frozenset(UNITS.split("|"))
_DIGIT = re.compile(r"\d")
_EDGE = "\"'`.,;:!?()[]{}<>«»„“”‘’…*"
_BREAK = b"\x00"

LITERAL, NUMBER, NUMBER_UNIT, UNIT, TITLE, BREAK = range(6)
_SLOT = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>".encode(), seed=1)) for k in ("number", "unit", "name")}


class Tokens(dict):
    """token -> code into arrays of kind, literal hash, hash of an attached unit and sentence end; bounded."""

    def __init__(self) -> None:
        super().__init__()
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.kind = np.empty(CACHE_WORDS, np.int8)
        self.literal = np.empty(CACHE_WORDS, np.uint64)
        self.unit = np.zeros(CACHE_WORDS, np.uint64)
        self.ends = np.empty(CACHE_WORDS, bool)

    def __missing__(self, token: bytes) -> int:
        raw = token.decode("utf-8", "replace")
        core = raw.strip(_EDGE)
        low = core.lower()
        if token == _BREAK:
            kind = BREAK
        elif low in _UNIT_WORDS:
            kind = UNIT
        elif _DIGIT.search(low) and (m := _NUMBER.fullmatch(low)):
            kind = NUMBER_UNIT if m[1] else NUMBER
        elif core[:1].isupper() and core[1:] == low[1:] and len(core) > 1:
            kind = TITLE
        else:
            kind = LITERAL
        code = self[token] = len(self)
        if code == len(self.kind):  # one text with very many words of its own
            self.kind, self.literal, self.unit, self.ends = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.literal, self.unit, self.ends)
            )
        self.kind[code] = kind
        if kind == NUMBER_UNIT:
            self.unit[code] = xxhash.xxh64_intdigest(m[1].encode())
            low = low[: m.start(1)]
        self.literal[code] = xxhash.xxh64_intdigest(low.encode())
        self.ends[code] = kind == BREAK or (raw is not core and raw.rstrip("\"')]}»”’*")[-1:] in (".", "!", "?", ":"))
        return code


def template(text: str, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, value hash, slot flag) of each token of a text.

    Numbers are ``<number>``, a unit behind a number or attached to it ``<unit>``, a capitalised
    word inside a sentence ``<name>``. All else is lower-cased and stripped of punctuation.
    """
    if len(tokens) >= CACHE_WORDS // 2:
        tokens.empty()
    words = text.encode().replace(b"\n", b" \x00 ").split()
    code = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
    if not len(code):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
    start = np.concatenate([[True], tokens.ends[code][:-1]])
    real = (tokens.kind[code] != BREAK).nonzero()[0]
    code, start = code[real], start[real]
    kind = tokens.kind[code]
    both = kind == NUMBER_UNIT
    number = both | (kind == NUMBER)
    unit = (kind == UNIT) & np.concatenate([[False], number[:-1]])[: len(kind)]
    name = (kind == TITLE) & ~start
    value = tokens.literal[code]
    shape = value.copy()
    for slot, where in (("number", number), ("unit", unit), ("name", name)):
        shape[where] = _SLOT[slot]
    slots = number | unit | name
    if both.any():
        at = both.nonzero()[0] + 1
        shape, value = np.insert(shape, at, _SLOT["unit"]), np.insert(value, at, tokens.unit[code[both]])
        slots = np.insert(slots, at, True)
    return shape, value, slots


def _seeds(shape: np.ndarray, value: np.ndarray, slots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, is a template) of each window: of its template with few placeholders, else of its values."""
    if len(slots) < size:
        return np.empty(0, np.uint64), np.empty(0, bool)
    seen = np.concatenate([[0], np.cumsum(slots)])
    few = seen[size:] - seen[:-size] <= MAX_SLOTS
    h = windows(shape, size)
    return (h if few.all() else np.where(few, h, windows(value, size))), few


class Runs:
    """Hashes of all runs of any length of a sequence; a few operations for each length."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, np.uint64(self.BASE)))
            self.back = np.cumprod(np.full(n, np.uint64(pow(self.BASE, -1, 1 << 64))))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])

    def of(self, length: int) -> np.ndarray:
        if length >= len(self.sums):
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix(((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length]) ^ np.uint64(length))


def _by_value(slots: np.ndarray, size: int) -> bool:
    """Whether an item is too short, or holds too few words beside placeholders, to be told by its template."""
    return len(slots) < size or int((~slots).sum()) < size - MAX_SLOTS


def _item_rows(size: int):
    tokens = Tokens()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"item": [], "hs": [], "whole": [], "length": []}
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            shape, value, slots = template(text, tokens)
            if not len(slots):
                continue
            h, few = _seeds(shape, value, slots, size)
            whole = None  # what no window can find, its whole sequence finds
            if len(slots) < size:
                whole = "value"
            elif not few.any() and not _by_value(slots, size):
                whole = "shape"
            if whole:
                h = np.concatenate([h, Runs(value if whole == "value" else shape).of(len(slots))])
            out["item"].append(item)
            out["hs"].append(signed(np.unique(h)))
            out["whole"].append(whole)
            out["length"].append(len(slots))
        yield out

    return run


def _doc_rows(size: int, bitmap: bytes, lengths: list[tuple[str, int]]):
    tokens = Tokens()
    bits = np.frombuffer(bitmap, np.uint8)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"doc_id": [], "hs": []}
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key is None or not text:
                continue
            shape, value, slots = template(text, tokens)
            h = [_seeds(shape, value, slots, size)[0]]
            runs = {whole: Runs(value if whole == "value" else shape) for whole in {x for x, _ in lengths}}
            h = np.concatenate(h + [runs[whole].of(n) for whole, n in lengths])
            at = (h & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
            h = np.unique(h[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)])
            if len(h):
                out["doc_id"].append(key)
                out["hs"].append(signed(h))
        yield out

    return run


def _bitmap(h: DataFrame) -> bytes:
    """Bit of each window hash. Spark builds 4 KB pieces; 2 MB at most reach the driver."""
    at = F.col("h").bitwiseAND((1 << BITMAP_BITS) - 1) + 1  # Spark's buckets begin at 1
    piece = h.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = bytearray((1 << BITMAP_BITS) // 8)
    for r in piece.collect():
        begin = (r["k"] - 1) * 4096
        out[begin : begin + 4096] = bytes(r["bits"])
    return bytes(out)


def candidates(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Pairs (doc_id, item) that share a seed; ``items`` has (item, text)."""
    rows = saved(map_batches(
        items.select("item", "text"), _item_rows(size), {"item": "long", "hs": "longs", "whole": "string", "length": "int"}
    ))
    lengths = [tuple(r) for r in rows.filter("whole is not null").select("whole", "length").distinct().collect()]
    seeds = rows.select("item", F.explode("hs").alias("h"))
    found = map_batches(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")),
        _doc_rows(size, _bitmap(seeds.select("h")), sorted(lengths)), {"doc_id": "long", "hs": "longs"},
    )
    return found.select("doc_id", F.explode("hs").alias("h")).join(seeds, "h").select("doc_id", "item").distinct()


def _aligned(a: np.ndarray, b: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Alignments (i, j) of equal tokens of all of ``a`` with a part of ``b``, best first.

    An equal token counts 2, a token of ``b`` left out inside costs 1, one of ``a`` nothing.
    Each further alignment ends apart from the ones before.
    """
    n, m = len(a), len(b)
    ramp = np.arange(m + 1)

    def below(row: np.ndarray, token: np.uint64) -> np.ndarray:
        out = row.copy()
        out[1:] = np.maximum(out[1:], row[:-1] + 2 * (b == token))
        return np.maximum.accumulate(out + ramp) - ramp

    # one row in about sqrt(n) is kept, the others are computed anew where the way back needs them
    every = math.isqrt(n) + 1
    kept, row = [], np.zeros(m + 1, np.int64)
    for i in range(n):
        if i % every == 0:
            kept.append(row)
        row = below(row, a[i])
    ends = row
    while True:
        j = last = int(ends.argmax())
        if ends[j] <= 0:
            return
        i, pairs, base = n, [], -1
        while i and j:
            if (i - 1) // every != base:
                base = (i - 1) // every
                rows = [kept[base]]
                for token in a[base * every : i]:
                    rows.append(below(rows[-1], token))
            here, up = rows[i - base * every], rows[i - base * every - 1]
            if a[i - 1] == b[j - 1] and here[j] == up[j - 1] + 2:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif here[j] == up[j - 1]:
                i, j = i - 1, j - 1
            elif here[j] == up[j]:
                i -= 1
            else:
                j -= 1
        yield pairs[::-1]
        ends[pairs[-1][1] : last + (n + 1) // 2] = 0


def _consistent(pairs: list[tuple[int, int]], slots: np.ndarray, was: np.ndarray, now_slots: np.ndarray, now: np.ndarray) -> bool:
    """Whether each value of the item's slots became the same value wherever it stands.

    A slot may have become several tokens; the slots left out beside its own are such tokens,
    and one of them at least must stand in all places.
    """
    images: dict[int, set[int]] = {}
    taken = {j for _, j in pairs}
    for i, j in pairs:
        if slots[i]:
            seen = {int(now[j])}
            for step in (-1, 1):
                k = j + step
                while 0 <= k < len(now) and now_slots[k] and k not in taken:
                    seen.add(int(now[k]))
                    k += step
            value = int(was[i])
            images[value] = images[value] & seen if value in images else seen
            if not images[value]:
                return False
    return True


def _share(item: tuple, doc: tuple, size: int, enough: float) -> float:
    """Largest share of an item's tokens that one consistent alignment with a document covers."""
    shape, value, slots = item
    n = len(slots)
    exact = _by_value(slots, size)
    a, b = (value, doc[1]) if exact else (shape, doc[0])
    w = min(size, n)
    pos = np.isin(windows(b, w), windows(a, w)).nonzero()[0]
    if not len(pos) or n < size:
        return float(len(pos) > 0)
    best = 0.0
    for group in np.split(pos, (np.diff(pos) > n).nonzero()[0] + 1):
        begin, end = max(0, int(group[0]) - 2 * n), min(len(b), int(group[-1]) + w + 2 * n)
        # stretches of bounded size, each item's length inside one
        for lo in range(begin, max(begin + 1, end - 4 * n), 4 * n):
            part = slice(lo, min(end, lo + 8 * n))
            for pairs in _aligned(a, b[part]):
                share = len(pairs) / n
                if share < enough and share <= best:
                    break
                if exact or _consistent(pairs, slots, value, doc[2][part], doc[1][part]):
                    best = max(best, share)
                    break
            if best >= 1:
                return best
    return best


def _verified(size: int, enough: float):
    tokens = Tokens()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"doc_id": [], "item_id": [], "share": []}
        for doc_id, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked")), strict=True):
            doc = template(text, tokens)
            for item in asked:
                share = _share(template(item["text"], tokens), doc, size, enough)
                if share:
                    out["doc_id"].append(doc_id)
                    out["item_id"].append(item["item_id"])
                    out["share"].append(share)
        yield out

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, contaminated, n_items, items, best_share.

    Texts become templates (numbers, units and names replaced by typed placeholders). Seeds
    are windows of ``size`` tokens: with at most two placeholders their template, with more
    their values; items without a template window are sought by their whole template as well,
    items under ``size`` tokens by their whole values. Seeds of documents and of ``benchmark``
    (item_id, text) are hash-joined.

    Each pair that shares a seed is then compared in full: an alignment covers the item's tokens
    whose template stands in the document in the same order, words put in or left out between
    them. Its slots must be consistent: a value of the item always became the same value in the
    document; a value of several tokens counts by one that stands in all its places. Items with
    fewer than three words beside placeholders are compared by values, since their template
    says nothing. ``best_share`` is the largest share of an item's tokens that a consistent
    alignment covers; an item counts as contained from ``min_share`` on, and a document with
    one is contaminated.

    A bitmap of fixed size (seed hashes modulo 2^24) keeps windows of no item from leaving
    the scan; a crowded bitmap only lets more rows through to the join.

    Null or blank text, a null doc_id, items without text or id: no match. Repeated rows:
    repeated result rows. An empty benchmark: all clean. Repeated items count once. Other
    columns are ignored.
    """
    items = saved(
        benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
        .filter("item_id is not null and text is not null").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    )
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # a stored table: its size is known to the planner, which then need not shuffle the texts
    asked = stored(
        candidates(texts, items, size).join(items, "item")
        .groupBy("doc_id", F.pmod(F.col("item"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("item_id", "text")).alias("asked"))
    )
    shares = map_batches(
        texts.filter("text is not null").join(asked, "doc_id").select("doc_id", "text", "asked"),
        _verified(size, min_share), {"doc_id": "long", "item_id": "long", "share": "double"},
    )
    by_doc = (
        shares.groupBy("doc_id").agg(
            F.max("share").alias("best"),
            F.sort_array(F.collect_set(F.when(F.col("share") >= min_share, F.col("item_id")))).alias("items"),
        )
        .select(F.col("doc_id").alias("id"), "best", "items")
    )
    return docs.select(F.col("doc_id").cast("bigint")).join(by_doc, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", (F.coalesce(F.size("items"), F.lit(0)) > 0).alias("contaminated"),
        F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("best", F.lit(0.0)).alias("best_share"),
    )
