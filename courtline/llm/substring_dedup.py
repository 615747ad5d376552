"""Substring dedup by repeated-phrase automata: 20-word windows that already stand earlier go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import map_batches, mix, signed, stored, windows

WINDOW = 20
#: Words of an anchor. Every window has exactly one: its smallest-hashed run of so many words.
ANCHOR = 6
#: Passages of one anchor that share an automaton's unit; more are dealt to further units.
UNIT_ROWS = 200
#: Passages whose phrases are compiled into one automaton at a time.
SHARD_ROWS = 2_500
#: Words of several texts hashed at a time.
CHUNK_WORDS = 60_000
#: Rounds of eight bytes in which numpy hashes words; longer ones are hashed one by one.
ROUNDS = 8
#: Bits of the map of documents that lose words: a fixed size whatever the corpus. It may let
#: others through, which no window asks for; it never holds one back.
MARKS = 1 << 24


def passages(hashes: np.ndarray, lengths: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first window, windows) of each run of windows with the same anchor.

    ``hashes`` are the words of several texts, one after the other, of ``lengths`` words each; a
    window counts within its text. The anchor is chosen by the window's own words, so equal
    windows of any two documents have the same one. A passage holds all windows around one
    anchor, seven or so.
    """
    none = np.empty(0, np.int64)
    if len(hashes) < window:
        return none, np.empty(0, np.uint64), none, none
    grams = windows(hashes, anchor)
    # place of each window's smallest gram, the first of equal ones; the width doubles per round
    low, at, wide = grams, np.arange(len(grams)), 1
    while wide < window - anchor + 1:
        step = min(wide, window - anchor + 1 - wide)
        left, right = slice(0, len(low) - step), slice(step, None)
        low, at = np.minimum(low[left], low[right]), np.where(low[right] < low[left], at[right], at[left])
        wide += step
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = (text[: len(at)] == text[window - 1 :]).nonzero()[0]
    if not len(inside):
        return none, np.empty(0, np.uint64), none, none
    at = at[inside]
    begin = np.concatenate([[0], (np.diff(at) != 0).nonzero()[0] + 1])
    first = inside[begin]
    start = first - (np.cumsum(lengths) - lengths)[text[first]]
    return text[first], grams[at[begin]], start, np.diff(np.concatenate([begin, [len(at)]]))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of ``raw``, where words are parted by one blank each.

    All words are hashed together, eight bytes a round. Equal words have equal hashes wherever
    they stand; different ones of one length up to eight bytes have different hashes.
    """
    if not raw:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    at, left, live = start, end - start, np.arange(len(start))
    out = mix(left.astype(np.uint64))
    for _ in range(ROUNDS):
        h = mix(out[live] ^ (eight[at] & masks[np.minimum(left, 8)]))
        out[live] = h
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
        if not len(live):
            break
    for i in live.tolist():
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]])
    return out, start, end


def _chunks(texts: Iterable[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Plain texts in groups of about CHUNK_WORDS words, and the words of each."""
    group, lengths, size = [], [], 0
    for text in texts:
        group.append(text)
        lengths.append(text.count(b" ") + 1 if text else 0)
        size += lengths[-1]
        if size >= CHUNK_WORDS:
            yield group, np.array(lengths, np.int64)
            group, lengths, size = [], [], 0
    if group:
        yield group, np.array(lengths, np.int64)


def _plain(text: str | None) -> bytes:
    """The words of a text, parted by one blank each."""
    return b" ".join((text or "").encode().split())


def _joined(texts: Iterable[bytes]) -> bytes:
    return b" ".join(filter(None, texts))


def _inside(every: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, place in the text) of those of all windows that lie in one text."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    at = (of[: len(every)] == of[window - 1 :]).nonzero()[0] if len(every) else np.empty(0, np.int64)
    return at, of[at], at - (np.cumsum(lengths) - lengths)[of[at]]


def _lists(text: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values of each of ``n`` texts, which are in order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _key(h: np.ndarray) -> np.ndarray:
    return signed(np.ascontiguousarray(h))


def _summary(window: int, anchor: int):
    """Number of words and digest of a text, and its anchors: those it holds once, and more often."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        at, doc_id = 0, batch.column("doc_id")
        for group, lengths in _chunks(map(_plain, batch.column("text").to_pylist())):
            text, h, _, _ = passages(word_hashes(_joined(group))[0], lengths, window, anchor)
            keys = _key(h)
            order = np.lexsort((keys, text))
            text, keys = text[order], keys[order]
            begin = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])])[: len(keys)])
            times = np.diff(np.concatenate([begin, [len(keys)]]))
            once, more = begin[times == 1], begin[times > 1]
            yield {
                "doc_id": doc_id.slice(at, len(group)), "n_words": lengths,
                "sha": [hashlib.sha256(t).hexdigest() for t in group],
                "once": _lists(text[once], keys[once], len(group)), "more": _lists(text[more], keys[more], len(group)),
            }
            at += len(group)

    return run


def _packed(batch: pa.RecordBatch) -> Iterator[dict]:
    pack = zstandard.ZstdCompressor(level=1).compress
    yield {"doc_id": batch.column("doc_id").to_pylist(), "blob": [pack(_plain(t)) for t in batch.column("text").to_pylist()]}


def _marks(docs: DataFrame) -> np.ndarray:
    """MARKS bits, one set for the hash of each doc_id: a bounded table of 64-bit parts."""
    parts = (
        docs.select(_mark().alias("mark"))
        .select(F.shiftright("mark", 6).alias("part"), F.expr("shiftleft(1L, cast(mark & 63 as int))").alias("bits"))
        .groupBy("part").agg(F.bit_or("bits").alias("bits"))
    ).toArrow()
    marks = np.zeros(MARKS // 64, np.uint64)
    marks[parts["part"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    return marks


def _mark() -> Column:
    return F.xxhash64("doc_id").bitwiseAND(MARKS - 1)


def _packed_marked(marks: Broadcast):
    """The packed texts whose doc_id is marked, and the few that share a bit with one."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        at = batch.column("mark").to_numpy().astype(np.uint64)
        keep = (marks.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        yield from _packed(batch.filter(pa.array(keep)))

    return run


def _unpacked(blobs: Iterable[bytes]) -> Iterator[bytes]:
    return map(zstandard.ZstdDecompressor().decompress, blobs)


def _recurring(window: int, anchor: int):
    """Passages of a text whose anchor recurs."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, before = batch.column("doc_id").to_numpy(), 0
        for group, lengths in _chunks(_unpacked(batch.column("blob").to_pylist())):
            raw = _joined(group)
            hashes, begin, end = word_hashes(raw)
            text, h, start, n = passages(hashes, lengths, window, anchor)
            # an anchor that recurs does so in each text that holds it
            asked = batch.column("hs").slice(before, len(group)).flatten().to_numpy()
            hit = np.isin(_key(h), asked).nonzero()[0]
            text, h, start, n = text[hit], h[hit], start[hit], n[hit]
            first = (np.cumsum(lengths) - lengths)[text] + start
            found = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first + n + window - 2].tolist(), strict=True)]
            yield {
                "h": _key(h), "doc_id": ids[before + text], "start": start, "n": n, "text": found,
                "run": list(map(xxhash.xxh3_128_digest, found)),
            }
            before += len(group)

    return run


def _windows_of(window: int):
    """(w, place) of each window of a passage, with the passage's own columns."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        lengths = np.array([t.count(b" ") + 1 for t in batch.column("text").to_pylist()], np.int64)
        every = windows(word_hashes(_joined(batch.column("text").to_pylist()))[0], window)
        at, of, place = _inside(every, lengths, window)
        own = batch.select(["h", "units", "run", "doc_id"]).take(pa.array(of))
        yield {"w": _key(every[at]), "at": batch.column("start").to_numpy()[of] + place, **{c: own.column(c) for c in own.schema.names}}

    return run


def _located(window: int):
    """Rows sorted by unit: compile a shard's phrases into an automaton, stream its passages.

    Per passage: (run, gone), the windows of it that stand at an earlier place.
    """

    def hopeful(texts: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Passages with windows that may stand twice, and those: their hash is another one's too."""
        lengths = np.array([t.count(b" ") + 1 for t in texts], np.int64)
        every = windows(word_hashes(_joined(texts))[0], window)
        at, of, place = _inside(every, lengths, window)
        _, kind, times = np.unique(every[at], return_inverse=True, return_counts=True)
        twice = times[kind] > 1
        passage, begin = np.unique(of[twice], return_index=True)
        yield from zip(passage.tolist(), map(np.ndarray.tolist, np.split(place[twice], begin[1:])), strict=False)

    def removed(shard: pa.RecordBatch) -> Iterator[tuple[bytes, list[int]]]:
        texts, runs = shard.column("text").to_pylist(), shard.column("run").to_pylist()
        places = list(zip(shard.column("doc_id").to_pylist(), shard.column("start").to_pylist(), strict=True))
        streamed = shard.column("streamed").to_pylist()
        may = list(hopeful(texts))
        words = [texts[i].split() for i, _ in may]
        codes = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        tokens = [tuple(map(codes.__getitem__, ws)) for ws in words]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        first: dict[tuple, tuple[int, int]] = {}
        seen_twice = set()
        for (i, at), row in zip(may, tokens, strict=True):
            doc_id, start = places[i]
            for j in at:
                phrase, place = row[j : j + window], (doc_id, start + j)
                # one that stands in a single passage, however often that recurs, is first where it stands
                if phrase in first:
                    seen_twice.add(phrase)
                first[phrase] = min(place, first.get(phrase, place))
        for phrase in seen_twice:
            automaton.add_word(phrase, first[phrase])
        if not len(automaton):
            return
        automaton.make_automaton()
        for (i, _), row in zip(may, tokens, strict=True):
            if streamed[i]:
                doc_id, start = places[i][0], places[i][1] - window + 1
                gone = [end - window + 1 for end, first in automaton.iter(row) if first < (doc_id, start + end)]
                if gone:
                    yield runs[i], gone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            out = list(removed(shard))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.list_(pa.int32()))], names=["run", "gone"]
            )

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole units of rows sorted by unit, about SHARD_ROWS at a time.

    A passage alone in its unit goes: the windows of one passage all differ.
    """

    def units() -> Iterator[pa.Table]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if rows.num_rows:
                last = int(np.searchsorted(unit := rows.column("unit").to_numpy(), unit[-1]))
                yield rows.slice(0, last)
                held = rows.slice(last)
        if held is not None:
            yield held

    for rows in units():
        _, begin, times = np.unique(rows.column("unit").to_numpy(), return_index=True, return_counts=True)
        rows = rows.filter(pa.array(np.repeat(times > 1, times)))
        ends, at = np.cumsum(times[times > 1]), 0
        while at < rows.num_rows:
            # the first end of a unit that makes the shard full, else the last
            to = int(ends[min(np.searchsorted(ends, at + SHARD_ROWS), len(ends) - 1)])
            yield from rows.slice(at, to - at).combine_chunks().to_batches()
            at = to


def _kept(window: int):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {"doc_id": batch.column("doc_id").to_pylist(), "n_removed": [], "kept_sha256": []}
        for gone, text in zip(batch.column("gone").to_pylist(), _unpacked(batch.column("blob").to_pylist()), strict=True):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.unique(np.array([a for g in gone for a in g], np.int64))
            at = at[at + window <= len(words)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            stay = (np.cumsum(edge[:-1]) == 0).nonzero()[0]
            out["n_removed"].append(len(words) - len(stay))
            out["kept_sha256"].append(hashlib.sha256(b" ".join([words[i] for i in stay.tolist()])).hexdigest())
        yield out

    return run


def _dealt(distinct: DataFrame, window: int) -> DataFrame:
    """(unit, run, text, doc_id, start, streamed): the distinct passages in units of bounded size.

    Passages that share a window meet in a unit. A passage has a row for each unit that its
    windows of two passages or more are dealt to, so the rows grow with the passages of an anchor.
    """
    # anchors with more distinct passages than a unit takes; the table's size is known to the planner
    hot = stored(
        distinct.groupBy("h").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > UNIT_ROWS)
        .select("h", F.ceil(F.col("kinds") / UNIT_ROWS).cast("int").alias("units"))
    )
    crowded = distinct.join(hot, "h").select("h", "units", "run", "text", "doc_id", "start")
    occurring = stored(map_batches(
        crowded, _windows_of(window),
        {"w": "long", "at": "long", "h": "long", "units": "int", "run": "binary", "doc_id": "long"},
    ))
    parts = F.ceil(F.col("k") / UNIT_ROWS).cast("int").alias("parts")
    shared = occurring.groupBy("w").agg(F.count("*").alias("k")).filter("k > 1").select("w", parts)
    dealt = occurring.join(shared, "w")
    own = F.when(F.col("parts") == 1, F.xxhash64("h", F.pmod("w", "units"))).otherwise(F.xxhash64("h", "w", F.pmod(F.xxhash64("run"), "parts")))
    firsts = (
        dealt.filter("parts > 1").groupBy("h", "w", "parts").agg(F.min(F.struct("doc_id", "at", "run")).alias("home"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    # a passage is streamed where its windows are dealt; the first of a window stands in each of the window's units
    large = (
        dealt.select(own.alias("unit"), "run", F.lit(True).alias("streamed"))
        .union(firsts.select(F.xxhash64("h", "w", F.col("part").cast("bigint")), "home.run", F.lit(False)))
        .groupBy("unit", "run").agg(F.max("streamed").alias("streamed"))
        .join(crowded.select("run", "text", "doc_id", "start"), "run")
    )
    columns = ["unit", "run", "text", "doc_id", "start", "streamed"]
    small = distinct.join(hot, "h", "left_anti").withColumns({"unit": F.xxhash64("h"), "streamed": F.lit(True)})
    return small.select(columns).union(large.select(columns))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    Each word goes that lies in a run of ``window`` words which also starts earlier: in a
    smaller doc_id, or before it in the same document. Windows are judged on the input.

    1. A whole copy of a smaller document goes as a whole; found by the digest's minimum.
    2. Passages: runs of windows around one anchor. Anchors that occur once are dropped; their
       windows cannot recur.
    3. Recurring passages are confirmed: equal passages are merged (map-side) into one with its
       first place.
    4. The distinct passages are dealt by anchor, in units of bounded size, to shards. Each
       shard confirms the phrases that stand in two of its passages, compiles them into
       Aho-Corasick automata over words and streams its passages through them, which locates
       every occurrence word for word. An anchor with many passages has several units: its
       windows of two passages or more are dealt to them by hash, and a passage goes where its
       windows go. A window of many passages has units of its own, each with the first of them.
    5. Places behind a phrase's first one are marked and cut from the texts: all windows of a
       passage where it stands again, the located ones where it stands first.

    Null or blank text: no words, the digest of the empty string. Fewer words than ``window``:
    nothing removed. A null doc_id has no order and is left whole. Rows of one doc_id count as
    one document; repeated rows give repeated result rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    summary = stored(map_batches(
        rows, _summary(window, anchor), {"doc_id": "long", "n_words": "long", "sha": "string", "once": "longs", "more": "longs"}
    ))
    first = summary.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("first"))
    marked = summary.join(first, "sha", "left").select(
        "doc_id", "n_words", "sha", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")
    )
    originals = marked.filter("not copy and n_words >= %d" % window).select("doc_id").distinct()

    anchors = summary.filter("doc_id is not null")
    # an anchor that one document holds twice recurs by itself
    every = anchors.select("doc_id", F.explode("once").alias("h"), F.lit(1).alias("k")).union(
        anchors.select("doc_id", F.explode("more").alias("h"), F.lit(2).alias("k"))
    )
    often = every.groupBy("h").agg(F.sum("k").alias("k")).filter("k > 1").select("h")
    asked = (
        every.join(often, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
        .join(originals, "doc_id", "left_semi")
    )
    blobs = map_batches(rows.filter("doc_id is not null and text is not null"), _packed, {"doc_id": "long", "blob": "binary"})
    found = stored(map_batches(
        blobs.join(asked, "doc_id"), _recurring(window, anchor),
        {"h": "long", "doc_id": "long", "start": "long", "n": "long", "text": "binary", "run": "binary"},
    ))

    # equal passages are one; an anchor whose passages are all equal needs no further count. Stored,
    # as several steps ask for them: each would sort and move the texts anew
    distinct = stored(
        found.groupBy("h", "run").agg(
            F.first("n").alias("n"), F.first("text").alias("text"),
            F.min(F.struct("doc_id", "start")).alias("at"), F.count("*").alias("times"),
        ).select("h", "run", "n", "text", "at.doc_id", "at.start", "times")
    )
    work = _dealt(distinct, window)
    located = work.repartition("unit").sortWithinPartitions("unit").mapInArrow(_located(window), "run binary, gone array<int>")
    none = lambda kind: F.lit(None).cast(kind)
    # what is known of a passage, stored: a plain join with it can be split where one passage recurs very often
    known = stored(
        located.select("run", "gone", none("bigint").alias("fd"), none("bigint").alias("fs"))
        .union(distinct.filter("times > 1").select("run", none("array<int>"), "doc_id", "start"))
        .groupBy("run").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.max("fd").alias("fd"), F.max("fs").alias("fs"))
    )
    places = found.select("run", "doc_id", "start", "n").join(known, "run")
    again = F.col("fd").isNotNull() & ((F.col("fd") != F.col("doc_id")) | (F.col("fs") != F.col("start")))
    windows_gone = F.when(again, F.sequence(F.lit(0), F.col("n").cast("int") - 1)).otherwise(F.col("gone"))
    gone = stored(
        places.select("doc_id", "start", windows_gone.alias("gone")).filter(F.size("gone") > 0)
        .select("doc_id", F.transform("gone", lambda j: F.col("start") + j).alias("gone"))
        .groupBy("doc_id").agg(F.collect_list("gone").alias("gone"))
    )
    # only texts that lose words are moved again
    losing = map_batches(
        rows.filter("doc_id is not null and text is not null").withColumn("mark", _mark()),
        _packed_marked(docs.sparkSession.sparkContext.broadcast(_marks(gone))), {"doc_id": "long", "blob": "binary"},
    )
    cut = map_batches(
        losing.join(gone, "doc_id"), _kept(window),
        {"doc_id": "long", "n_removed": "long", "kept_sha256": "string"},
    ).withColumnsRenamed({"doc_id": "_d", "n_removed": "_r", "kept_sha256": "_k"}).dropDuplicates(["_d"])
    return marked.join(cut, F.col("doc_id") == F.col("_d"), "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("_r", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_k", "sha")).alias("kept_sha256"),
    )
