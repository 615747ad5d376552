"""Rules at their exact borders, and base places of licence scans against a regular expression."""

import random
import re

import pytest

from courtline.llm.licenses import scan_licenses
from courtline.llm.near_duplicates import near_duplicates

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@pytest.mark.parametrize("shingles, changed, linked", [(37, 3, True), (36, 3, False), (74, 6, True), (73, 6, False)])
def test_links_at_exactly_the_threshold(spark, shingles, changed, linked):
    """(n - k) / (n + k) of equal sets: 34 / 40 is 0.85, 33 / 39 is not."""
    assert (100 * (shingles - changed) >= 85 * (shingles + changed)) == linked
    words = [f"w{i}" for i in range(shingles + 2)]
    other = words[:-changed] + [f"x{i}" for i in range(changed)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(f"z{i}" for i in range(40)))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1 if linked else 2, 3: 3}


def test_one_long_text_among_near_copies(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    near = list(long)
    for i in range(0, 60_000, 1_000):
        near[i] = "changed"
    rows = [(5, " ".join(long)), (4, " ".join(near)), (6, " ".join(long[:30_000]))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {4: 4, 5: 4, 6: 6}


def test_base_places_equal_a_regular_expression(spark):
    rng = random.Random(6)
    pieces = ["MIT", "License", "license.", "Apache", "general", "Public", "the", "mit-license", "GENERAL public", "é", "x1", "Ýlicense", "(", "…"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "mit license " * 3_000)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
