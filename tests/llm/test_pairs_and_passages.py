"""Near duplicates, substring dedup and decontamination against brute force on small rows."""

import hashlib
import random

from courtline.llm.decontamination import decontaminate
from courtline.llm.near_duplicates import BINS, near_duplicates, sketch
from courtline.llm.substring_dedup import dedup_substrings

DOCS = "doc_id bigint, text string, component_id string, h string"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    base = words(1, 300)
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(base).upper()), (1, " ".join(base))]
    for i in range(3, 60):  # near copies with more and more changed words, chained
        rng = random.Random(i)
        w = list(base)
        for _ in range(i // 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(words(100 + i, 80))) for i in range(40)]
    shared = words(7, 60)
    rows += [(200 + i, " ".join(words(300 + i, 50) + shared[i : i + 40] + words(400 + i, 30))) for i in range(15)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "one"), (305, "a b"), (306, "A B"), (None, " ".join(base)), (307, "q " * 90)]
    return [(*r, "clash", "clash") for r in rows]


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    sets = {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(doc_id, {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] == 0 and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (
                len(sets[r["doc_id"]]), top(r["doc_id"]), top(r["doc_id"]) == r["doc_id"]
            ), r
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 400):
        assert sketch(rng.integers(0, 2**63, n).astype(np.uint64)).max() < np.iinfo(np.uint64).max
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    agree = np.mean([(sketch(a[k : k + 900]) == sketch(a[k + 100 : k + 1000])).mean() for k in range(0, 1000, 50)])
    assert abs(agree - 0.8) < 3 * np.sqrt(0.16 / BINS)


def test_substrings_equal_brute_force(spark):
    rows = corpus()
    got = {}
    result = dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()
    assert len(result) == len(rows)
    for r in result:
        got.setdefault(r["doc_id"], set()).add((r["n_words"], r["n_removed"], r["kept_sha256"]))
    texts = dict((i, t) for i, t, *_ in rows if i is not None)
    seen = set()
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert got[i] == {(len(w), sum(gone), hashlib.sha256(kept).hexdigest())}, i
    assert {r[1] for r in got[None]} == {0}
    assert dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_are_merged_once_and_only_losing_texts_move(spark):
    rows = [(i, " ".join(words(i, 60)), "", "") for i in range(40)] + [(50, " ".join(words(3, 60)[:40]), "", "")]
    plan = dedup_substrings(spark.createDataFrame(rows, DOCS))._jdf.queryExecution().optimizedPlan().toString()
    # the texts of passages were sorted anew for each step that asked for them
    assert "first(text" not in plan and "max_by" not in plan
    assert plan.count("mapInArrow") + plan.count("MapInArrow") == 2


def test_anchors_of_several_units_equal_brute_force(spark, monkeypatch):
    from courtline.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "UNIT_ROWS", 5)
    line = words(9, 24)  # windows of many passages, between words of their own
    rows = corpus() + [(400 + i, " ".join(words(500 + i, 30) + line + words(600 + i, 30)), "", "") for i in range(30)]
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    texts = {i: (t or "").encode().split() for i, t, *_ in rows if i is not None}
    seen = set()
    for i in sorted(texts):
        gone = [False] * len(texts[i])
        for k in range(len(texts[i]) - 19):
            key = tuple(texts[i][k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(texts[i], gone) if not g)
        assert got[i] == (sum(gone), hashlib.sha256(kept).hexdigest()), i


def test_units_grow_with_the_passages_of_an_anchor(spark, monkeypatch):
    """Each of an anchor's units held the phrases of all its passages: a passage had a row in all 20 here."""
    from courtline.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "UNIT_ROWS", 20)
    line = words(2000, 21)
    texts = [words(k, 26) for k in range(200)] + [words(k, 22) + words(k + 500, 4) for k in range(100)] + [words(k, 5) + line for k in range(900, 1000)]
    rows = [(1, bytes([k // 256, k % 256]), 7, " ".join(t).encode(), k, 0, 1) for k, t in enumerate(texts)]
    distinct = spark.createDataFrame(rows, "h bigint, run binary, n bigint, text binary, doc_id bigint, start bigint, times bigint")
    dealt = substring_dedup._dealt(distinct, 20).collect()
    assert len(dealt) < 3 * len(rows)
    units = {}
    for r in dealt:
        units.setdefault(r["unit"], {})[bytes(r["run"])] = r["streamed"]
    assert max(map(len, units.values())) < 100
    # the passages that begin alike meet, and so do those with the line
    runs = [r[1] for r in rows]
    assert all(any({runs[k], runs[200 + k]} <= set(u) for u in units.values()) for k in range(100))
    assert all(any(u.get(runs[k]) and runs[300] in u for u in units.values()) for k in range(300, 400))


def test_a_passage_alone_in_its_unit_is_not_compiled():
    import pyarrow as pa

    from courtline.llm.substring_dedup import _shards

    units = [1, 2, 2, 3, *[4] * 5000, 5, *[6] * 3000, 7]
    rows = pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(range(len(units)))], names=["unit", "row"])
    parts = [b.column("unit").to_pylist() for b in _shards(rows.slice(k, 700) for k in range(0, len(units), 700))]
    assert sorted(sum(parts, [])) == [2, 2, *[4] * 5000, *[6] * 3000]
    assert all(sum(u in p for p in parts) == 1 for u in (2, 4, 6)) and list(_shards(iter([]))) == []


def test_words_have_one_hash_wherever_they_stand():
    from courtline.llm.substring_dedup import word_hashes

    plain = ["a", "b", "aa", "abcdefgh", "abcdefghi", "é", "x" * 64, "x" * 65, "x" * 300, "abcdefgh\0", "abcdefgh\0\0", "i"]
    raw = " ".join(plain + plain[::-1]).encode()
    hashes, start, end = word_hashes(raw)
    assert [raw[a:b].decode() for a, b in zip(start, end)] == plain + plain[::-1]
    assert hashes[: len(plain)].tolist() == hashes[len(plain) :][::-1].tolist() and len(set(hashes.tolist())) == len(plain)
    assert [word_hashes(w.encode())[0][0] for w in plain] == hashes[: len(plain)].tolist() and not len(word_hashes(b"")[0])


def test_passages_of_several_texts_are_those_of_each():
    import numpy as np

    from courtline.llm.substring_dedup import passages

    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 30, n).astype(np.uint64) for n in (0, 5, 19, 20, 21, 80, 3, 200, 0)]
    parts = passages(np.concatenate(texts), np.array([len(t) for t in texts]), 20, 6)
    assert parts[3].sum() == sum(max(0, len(t) - 19) for t in texts)
    for i, t in enumerate(texts):
        alone = passages(t, np.array([len(t)]), 20, 6)
        for x, y in zip(alone[1:], parts[1:], strict=True):
            assert x.tolist() == y[parts[0] == i].tolist()


def test_decontamination(spark):
    item = "A train leaves Boston at 7:30 and runs 90 km to the coast while Mary waits 15 minutes for the other line"
    moved = item.replace("Boston", "Denver").replace("7:30", "9:45").replace("90 km", "120 miles").replace("Mary", "Peter")
    # Mary twice, but two names in the document
    twice = "When Mary met the old baker near the gate she told Mary nothing about the bread that was burnt"
    rows = [
        (1, "noise before. " + item + ". noise after"), (2, "so " + moved.replace("15", "20") + " and more"), (3, "quite other words about a train"),
        (4, twice), (5, twice.replace("Mary", "Anna", 1)), (6, None), (7, ""), (8, item[:40]), (None, item), (1, "noise before. " + item + ". noise after"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(10, item, 1), (11, twice, 1), (11, twice, 1), (12, None, 1), (13, "too short", 1), (None, item, 1)], "item_id bigint, text string, doc_id int")
    got = sorted(((r["doc_id"] or -1, r["contaminated"], r["items"]) for r in decontaminate(docs, bench).collect()))
    assert got == [
        (-1, False, []), (1, True, [10]), (1, True, [10]), (2, True, [10]), (3, False, []), (4, True, [11]),
        (5, False, []), (6, False, []), (7, False, []), (8, False, []),
    ]
    assert decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0


def test_decontamination_dense_and_short_items(spark):
    items = {
        1: "What is the next number in the sequence 2, 4, 8, 16, 32, 64, 128, 256?", 2: "the sides are 12 cm, 14 cm and 20 cm",
        3: "we met Anna, Boris, Clara, David, Emil and Frida", 4: "too short", 5: "give 3 4 to 5 6 or 7 8 and 9",
    }
    docs = [(i, f"before it {t} after it") for i, t in items.items()]
    docs += [
        (11, "so " + items[1].replace("256", "512") + " then"), (15, "so give 1 2 to 7 3 or 5 4 and 6 then"), (16, "too very short"),
        (17, "the sides are 7 cm, 8 cm and 9 cm"), (18, "rows of 1, 2, 3, 4, 5, 6, 7 and 8"), (19, "give 3 4 to 3 3 or 7 8 and 9"),
        (20, "we met nobody"), (21, "ran 90km in 3 h and then walked 5 km to the sea"),
    ]
    items[6] = "ran 90 km in 3 h and then walked 5km to the sea"
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [5], 11: [1], 15: [5], 16: [], 17: [2], 18: [], 19: [5], 20: [], 21: [6]}


def test_decontamination_with_gaps(spark):
    item = "A train leaves Boston at 7:30 and runs 90 km to the coast while Tom waits 1200 seconds for the other line and Tom sleeps"
    other = "When Mary met the old baker near the gate she told Mary nothing about the bread that was burnt"
    texts = {
        1: item.replace("to the coast", "down to the coast"), 2: item.replace("and runs", "runs"), 3: item.replace("Tom", "Mary Ann"),
        4: item.replace("1200", "1 200"), 5: item.replace("90 km", "90km"), 6: item.replace("Tom", "Mary Ann").replace("Boston", "New York").replace("1200", "1 500"),
        7: item.replace("Tom", "Anna", 1).replace("Tom", "Peter"), 8: item[:60] + " and then many other words, " * 9 + item[60:],
        9: other.replace("Mary", "Anna", 1) + ". " + other.replace("Mary", "Anna").replace("old", "very old"), 10: other.replace("Mary", "Anna", 1),
        11: "filler " * 500 + texts_between(item) + " filler" * 500,
    }
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"so. {t}. end") for i, t in texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate(docs, bench).collect()}
    assert got == dict.fromkeys(range(1, 7), [1]) | {7: [], 8: [], 9: [2], 10: [], 11: [1]}


def texts_between(item):
    w = item.split()
    return " ".join(w[:9] + ["quite"] + w[9:16] + w[17:])
