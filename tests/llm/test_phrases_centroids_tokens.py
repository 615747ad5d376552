"""Collocations, centroid clusters and byte pairs against brute force on small rows."""

import base64
import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

from courtline.llm import collocations as phrases
from courtline.llm.byte_pairs import decode, encode, encoded_digests, java_pattern, merge_long, read_ranks
from courtline.llm.centroids import BITS, BLOCK_ROWS, Nearest, centroid_clusters, hilbert_keys, zone_maps
from courtline.llm.collocations import Chunk, Gathered, Words, _added, collocations

RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = "doc_id bigint, text string, lang string, n string, score double, words string"


# ---- collocations

def brute_phrases(rows, top):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\x00")
        for piece in low.split("\x00"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            totals[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= 30 and len(p) > 1}
        kept = []
        for p, a in found.items():
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in found.items()
            )
            if not inside:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    vocabulary = ["New", "york", "éa", "the", "the", "of", "red", "x\x1cy", "ÀB", " "]
    rows = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(60)]
        for j in range(0, 50, 10):
            words[j : j + 4] = ["united", "states", "of", "america"] if rng.random() < 0.8 else ["united", "states", "the", "sea"]
        glue = [rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "?"]) for _ in words]
        rows.append((i if i % 9 else None, "".join(w + g for w, g in zip(words, glue)), ["en", "de", None, "und"][i % 4], "n", 0.5, "w"))
    rows += [(900, None, "en", "n", 0.5, "w"), (901, "", "fr", "n", 0.5, "w"), (902, " ., \t", "fr", "n", 0.5, "w"), rows[1], rows[1]]
    rows.append((903, "so be it " * 20_000, "en", "n", 0.5, "w"))
    return rows


def test_collocations_equal_brute_force(spark):
    rows = phrase_rows()
    want = brute_phrases(rows, 15)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = collocations(df, top=15)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == want and len(want) > 30
    first = {(r["lang"], r["phrase"]): r["first_doc"] for r in got.collect()}
    assert first["en", "so be it so"] == 903
    assert collocations(df.limit(0)).count() == 0
    assert collocations(df.filter("doc_id = 901")).count() == 0


def counted_locally(rows):
    """Phrases of one task, with every fingerprint taken for frequent."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] or "und" for r in rows]})
    run = phrases._occurrences(SimpleNamespace(value=np.full(phrases.BITS // 64, np.uint64(2**64 - 1))))
    out = pa.Table.from_batches(list(run(iter([batch]))))
    got = Counter()
    for lang, phrase, n in zip(*(out[c].to_pylist() for c in ("lang", "phrase", "n")), strict=True):
        got[lang, phrase] += n
    return got


def test_hand_ons_in_small_parts_change_nothing(monkeypatch):
    whole = counted_locally(phrase_rows()[:-1])
    for name, value in (("CHUNK_BYTES", 1_000), ("GATHERED_PHRASES", 20), ("CACHE_WORDS", 3), ("NAMED_WORDS", 8)):
        monkeypatch.setattr(phrases, name, value)
    assert counted_locally(phrase_rows()[:-1]) == whole


def test_equal_fingerprints_are_told_apart_by_their_words(monkeypatch):
    whole = counted_locally(phrase_rows()[:-1])
    fingerprints = Chunk.fingerprints

    def clash(self, size):
        at, prints = fingerprints(self, size)
        return at, prints % np.uint64(3)

    monkeypatch.setattr(Chunk, "fingerprints", clash)
    assert counted_locally(phrase_rows()[:-1]) == whole and len(whole) > 1_000


def test_equal_numbers_of_two_languages_are_two_phrases():
    rows = lambda lang, n: (np.full(n, 7, np.uint64), np.full((n, phrases.LONGEST), 2, np.int32), np.ones(n, np.int64), np.arange(n), np.full(n, lang, np.int32))
    _, _, n, docs, lang = phrases._merged([rows(0, 3), rows(1, 2)])
    counts = Counter()
    for k, m in zip(lang.tolist(), n.tolist(), strict=True):
        counts[k] += m
    assert counts == {0: 3, 1: 2} and len(docs) >= 2


def test_rare_words_break_phrases_and_are_counted():
    words = Words(lambda h: h != xxhash.xxh64_intdigest(b"odd"))
    chunk = Chunk("en", [(1, "a b odd a b")], words)
    assert chunk.n_words == 5 and len(chunk.fingerprints(2)[0]) == 2 and len(chunk.fingerprints(1)[0]) == 4
    assert words.names == [b"\xff", b"", b"a", b"b"] and words[b"odd"] == phrases.RARE
    # the test of one hash agrees with the map of fingerprints
    whole = Chunk("en", [(1, " ".join(map(str, range(500))))], Words())
    _, prints = whole.fingerprints(1)
    bits = np.zeros(phrases.BITS // 64, np.uint64)
    bits[(prints[::3] & np.uint64(phrases.BITS - 1)).astype(np.int64) >> 6] |= np.uint64(1) << (prints[::3] & np.uint64(63))
    known = phrases.BitMap(bits)
    keeps = known.keeps("en")
    assert [keeps(xxhash.xxh64_intdigest(str(i))) for i in range(500)] == known.holds(prints).tolist()


def test_prints_are_counted_by_half_their_bits(spark):
    text = "a b c " * 40
    df = spark.createDataFrame([(1, text, "en"), (2, "a d", "en")], "doc_id bigint, text string, lang string")
    counts = phrases._print_counts(df, range(1, 3), None)
    assert dict(counts.dtypes) == {"fp": "int", "n": "bigint"}
    chunks = [Chunk("en", [(1, t)], Words()) for t in (text, "a d")]
    prints = np.concatenate([c.fingerprints(size)[1] for c in chunks for size in (1, 2)])
    want = Counter((prints & np.uint64(2**32 - 1)).astype(np.uint32).view(np.int32).tolist())
    assert {r["fp"]: r["n"] for r in counts.collect()} == {h: n for h, n in want.items() if n >= phrases.LEAST} and len(want) == 8
    known = phrases.BitMap(phrases._bitmap(counts))
    assert [int(known.holds(c.fingerprints(1)[1]).sum()) for c in chunks] == [120, 1]


def test_rolled_hashes_are_equal_for_equal_words_only():
    words = Words()
    chunk = Chunk("en", [(1, "a b c a b, c a b c"), (None, "b c a b")], words)
    for size in (1, 2, 3, 4):
        at, prints = chunk.fingerprints(size)
        by = {}
        for i, h in zip(at.tolist(), prints.tolist()):
            by.setdefault(h, set()).add(tuple(chunk.numbers[i : i + size].tolist()))
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


# ---- centroids

def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]

    def order(row):
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centroids = [e for _, e in sorted(kept, key=order)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(e, c)), j) for j, c in enumerate(centroids)) for _, e in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(centroids)):
            mine = [e for (_, e), (_, c) in zip(kept, got) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign()
    sums = Counter()
    for d, c in got:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(i, c, d, sums[c], sum(sums.values()), sha[c]) for (i, _), (d, c) in zip(kept, got)]
    return sorted(rows, key=repr)


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 64))
    rows = [(i, (centres[i % 9] + rng.normal(scale=0.3, size=64)).tolist()) for i in range(n)]
    same = rows[0][1]
    rows += [(1_000 + i, same) for i in range(n // 2)]  # a third of all rows are one vector
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, [0.0] * 64), (5_000, None), (5_001, []), (5_002, [0.1] * 63), (5_003, [None] + [0.1] * 63)]
    rows += [(5_004, [float("nan")] + [0.0] * 63), (5_005, [float("inf")] + [0.0] * 63), (5_006, [-0.001] * 64)]
    return rows


SCHEMA = "vec_id bigint, embedding array<double>, cluster int, block string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash", 1) for r in rows], SCHEMA)


def test_clusters_equal_brute_force(spark):
    rows = vectors(800)
    got = centroid_clusters(frame(spark, rows).repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows)
    few = rows[:5]
    assert sorted((tuple(r) for r in centroid_clusters(frame(spark, few)).collect()), key=repr) == brute_clusters(few)
    assert centroid_clusters(frame(spark, rows).limit(0)).count() == 0
    assert centroid_clusters(frame(spark, [(1, [0.5])])).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        centroid_clusters(frame(spark, [(1, [1e30] * 64)]))


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-2**20, 2**20, 64) + rng.random(64)).tolist()) for i in range(60)]
    assert sorted((tuple(r) for r in centroid_clusters(frame(spark, rows)).collect()), key=repr) == brute_clusters(rows)


def test_blocks_hold_all_rows_and_their_boxes(spark):
    rows = [(i, e) for i, e in vectors(900) if i is not None and i < 5_000]
    df = frame(spark, rows).select("vec_id", "embedding")
    low, high = np.full(64, -400.0), np.full(64, 400.0)
    got = zone_maps(df, low, high, "i2").toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("block"):
        v = np.stack([np.frombuffer(x, "i2") for x in part.v])
        boxes = [b for b in part.box if b is not None]
        assert len(part) <= BLOCK_ROWS and len(boxes) == 1
        assert (np.frombuffer(boxes[0], "i2").reshape(2, -1) == np.stack([v.min(axis=0), v.max(axis=0)])).all()


def test_curve_visits_neighbouring_cells():
    side = 1 << 3
    for dims in (2, 3):
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = hilbert_keys(cells, 3)
        assert len(set(keys)) == len(cells)
        line = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()
    assert len(hilbert_keys(np.zeros((1, 64), int))[0]) == 8 * BITS


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(2)
    ruled_out = 0
    for _ in range(200):
        c = rng.integers(-50, 50, (16, 4))
        v = rng.integers(-20, 20, 4) + rng.integers(0, 6, (30, 4))
        near = Nearest(c, 100)
        box = np.stack([v.min(axis=0), v.max(axis=0)])
        some = near.candidates(*box)
        d = ((v[:, None, :] - c) ** 2).sum(axis=2)
        assert (near.of(v, box)[0] == d.argmin(axis=1)).all() and (near.of(v, box)[1] == d.min(axis=1)).all()
        ruled_out += 16 - len(some)
    assert ruled_out > 1_000


def test_counts_are_added_by_one_sort_and_prints_made_once():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 50, n).astype(np.uint32) + np.uint32(4_294_967_200) for n in (0, 300, 700)]
    counted = np.empty(0, np.uint64)
    for part in parts:
        counted = _added(counted, [part])
    values, n = np.unique(np.concatenate(parts), return_counts=True)
    assert (counted >> np.uint64(32)).tolist() == values.tolist() and (counted & np.uint64(0xFFFFFFFF)).tolist() == n.tolist()
    chunk = Chunk("en", [(1, "a b c. a b")], Words())
    assert chunk.fingerprints(2) is chunk.fingerprints(2)


def test_gathered_occurrences_wait_and_phrases_of_one_fingerprint_stay_apart():
    got, row = Gathered(), lambda *x: np.array([x], np.int32)
    numbers = np.concatenate([row(i, 0, 0, 0) for i in range(10)])
    got.add(np.arange(10, dtype=np.uint64), numbers, np.arange(10) + 5, 0)
    assert got.n_waiting == 0 and len(got.n) == 10
    got.add(np.array([3], np.uint64), row(3, 0, 0, 0), np.array([2]), 0)
    assert got.n_waiting == 1
    got.add(np.array([4], np.uint64), row(99, 0, 0, 0), np.array([1]), 0)
    got.settle()
    rows = sorted(zip(got.prints.tolist(), got.numbers[:, 0].tolist(), got.n.tolist(), got.docs.tolist(), strict=True))
    assert rows == sorted([(i, i, 1 + (i == 3), 2 if i == 3 else i + 5) for i in range(10)] + [(4, 99, 1, 1)])


# ---- byte pairs

def token_rows():
    rng = random.Random(1)
    alphabet = "aab eotéœ你\U0001f600'sS,.\t\n 　 123١\x85\x00\x01"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(200)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "<|endoftext|> we'll I'VE"), (None, "null id"), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(503, "x" * 9_000 + " " + "ab1" * 700 + "-" * 300 + "zqj" * 900), (504, " " * 5_000 + "\n\t" * 90), (505, "sea of words " * 20_000)]
    return [(*r, "clash", 1) for r in rows]


def test_ids_equal_tiktoken(spark):
    rows = token_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, words int")
    want = sorted(((i, TIKTOKEN.encode_ordinary(t or "")) for i, t, *_ in rows), key=repr)
    for common in (0, 30, 10_000):
        got = encode(df, RANKS, public_tokenizers.PATTERN, common)
        assert sorted(((r["doc_id"], list(r["ids"])) for r in got.collect()), key=repr) == want
    back = got.select("doc_id", decode(got["ids"], RANKS).alias("raw")).collect()
    assert sorted(((r["doc_id"], bytes(r["raw"])) for r in back), key=repr) == sorted(((i, (t or "").encode()) for i, t, *_ in rows), key=repr)


def test_constant_maps_are_subqueries_and_no_row_holds_them(spark):
    df = spark.createDataFrame([(1, "a word and a word")], "doc_id bigint, text string")
    got = encode(df, RANKS, public_tokenizers.PATTERN)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 10_000 and plan.count("scalar-subquery") >= 2
    assert " AS pairs#" not in plan and " AS frequent#" not in plan
    assert [r["ids"] for r in got.collect()] == [TIKTOKEN.encode_ordinary("a word and a word")]


def test_digests(spark):
    rows = token_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, words int")
    got = [tuple(r) for r in encoded_digests(df, RANKS, public_tokenizers.PATTERN).collect()]
    want = []
    for i, t, *_ in rows:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert encoded_digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_heap_makes_the_same_merges():
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"aabbcde-= ") for _ in range(rng.randrange(1, 200)))
        assert merge_long(word, RANKS) == TIKTOKEN._encode_single_piece(word)


def test_ranks_need_every_byte(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="no rank"):
        read_ranks(str(path))
    assert java_pattern(r"\s+(?!\S)|[^\s\p{L}]") == r"\p{IsWhite_Space}+(?!\P{IsWhite_Space})|[^\p{IsWhite_Space}\p{L}]"
