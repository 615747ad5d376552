"""Byte-level BPE: ranked merges folded over the bytes of words by higher-order functions, and back."""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.llm.common import let

#: A constant map is an array of so many small maps; a look-up searches one of them.
SHARDS = 1 << 16
#: Distinct words encoded once and looked up: the most frequent ones, at most so many.
COMMON = 1 << 17
#: Words of more bytes are merged by a heap, as the fold takes time by the square of their length.
LONG = 64
#: Length that plan texts are cut to (``explain`` and the like).
PLAN_TEXT = 20_000
#: A token is one character, in the order of the ranks (``token_char``).
_NONE = "\U0010ffff"
_FIRST_CHAR = 1  # ``translate`` takes character 0 for none
_SURROGATES, _SKIPPED = 0xD800, 0x800


def token_char(rank: int) -> str:
    """A token as one character; surrogates, which no text holds, are skipped."""
    code = rank + _FIRST_CHAR
    return chr(code if code < _SURROGATES else code + _SKIPPED)


def char_rank(char: Column, ranks: dict[bytes, int]) -> Column:
    code = F.ascii(char)
    if max(ranks.values()) + _FIRST_CHAR < _SURROGATES:
        return code - _FIRST_CHAR
    return code - _FIRST_CHAR - F.when(code < _SURROGATES, 0).otherwise(_SKIPPED)


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a rank file: one line for each, base64 bytes and the rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    missing = [i for i in range(256) if bytes([i]) not in ranks]
    if missing:
        raise ValueError(f"no rank for the bytes {missing}")
    if max(ranks.values()) >= 0x10F000:
        raise ValueError("a rank has to fit into a character")
    return ranks


def java_pattern(pattern: str) -> str:
    r"""The split pattern for Java, whose own \s knows ASCII white space only."""
    spelled = {r"\s": r"\p{IsWhite_Space}", r"\S": r"\P{IsWhite_Space}"}
    return re.sub(r"\\.", lambda m: spelled.get(m[0], m[0]), pattern)


def constant_map(spark: SparkSession, entries: Iterable[tuple[str, str]]) -> Column:
    """Constant array of SHARDS maps of strings, the value of a subquery.

    A literal of that size would be spelled out in every text of a plan that the driver keeps,
    and would be there once for each use; a subquery's value is one block of bytes. Functions with
    lambdas may not be given subqueries: put it into a column that the next ``select`` uses once,
    by ``let``. The optimizer makes one projection of both, so that no row holds the map.
    """
    shards: list[list[str]] = [[] for _ in range(SHARDS)]
    for key, value in entries:
        shards[zlib.crc32(key.encode()) % SHARDS].append(f"{json.dumps(key)}:{json.dumps(value)}")
    text = "[" + ",".join("{" + ",".join(shard) + "}" for shard in shards) + "]"
    row = spark.createDataFrame([(text,)], "entries string")
    return row.select(F.from_json("entries", "array<map<string,string>>").alias("maps")).scalar()


def found(maps: Column, key: Column) -> Column:
    """Value of a key of a constant map, null where it has none."""
    return F.try_element_at(F.get(maps, (F.crc32(key.cast("binary")) % SHARDS).cast("int")), key)


class RankMap:
    """The constant rank map: the token that two neighbouring tokens merge to, as characters.

    The rank of a merge is the rank of the token it makes, and characters sort as ranks do.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        def entries() -> Iterator[tuple[str, str]]:
            for token, rank in ranks.items():
                for i in range(1, len(token)):
                    x, y = ranks.get(token[:i]), ranks.get(token[i:])
                    if x is not None and y is not None:
                        yield token_char(x) + token_char(y), token_char(rank)

        self.maps = constant_map(spark, entries())
        self.latin = "".join(map(chr, range(256)))
        self.bytes = "".join(token_char(ranks[bytes([i])]) for i in range(256))

    @staticmethod
    def merged(maps: Column, pair: Column) -> Column:
        return F.coalesce(found(maps, pair), F.lit(_NONE))

    def tokens(self, word: Column) -> Column:
        """A word as a string of its byte tokens."""
        return F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), self.latin, self.bytes)


def merged(word: Column, ranks: RankMap, maps: Column) -> Column:
    """Tokens of one word, as a string of token characters, by a fold over its bytes.

    ``maps`` is the value of ``ranks.maps``.

    The state holds the tokens and what each pair of neighbours merges to. One step makes the
    leftmost merge of the lowest rank and looks up the two pairs that are new; without a
    ranked pair the state stays.
    """

    def over(value: Column, state: Column, body: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(F.array(value), state, body)

    def start(tokens: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(tokens) - 1), lambda i: ranks.merged(maps, F.substring(tokens, i, F.lit(2))))
        return F.struct(tokens.alias("tokens"), F.array_join(pairs, "").alias("pairs"))

    def join(s: Column, low: Column, p: Column) -> Column:
        before, behind = F.substring(s["tokens"], p - 1, F.lit(1)), F.substring(s["tokens"], p + 2, F.lit(1))
        left = F.when(p > 1, F.array(F.concat(before, low))).otherwise(F.array().cast("array<string>"))
        right = F.when(p < F.length(s["pairs"]), F.array(F.concat(low, behind))).otherwise(F.array().cast("array<string>"))
        fresh = F.array_join(F.transform(F.concat(left, right), lambda pair: ranks.merged(maps, pair)), "")
        first, n = F.greatest(p - 1, F.lit(1)), F.least(p + 1, F.lit(3))
        return F.struct(
            F.overlay(s["tokens"], low, p, F.lit(2)).alias("tokens"),
            F.overlay(s["pairs"], fresh, first, n).alias("pairs"),
        )

    def step(s: Column, _: Column) -> Column:
        return over(F.array_min(F.split(s["pairs"], "")), s, lambda s, low: F.when(low.isin("", _NONE), s).otherwise(
            over(F.position(low, s["pairs"]), s, lambda s, p: join(s, low, p))
        ))

    def folded(tokens: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(2), F.length(tokens)), start(tokens), step, lambda s: s["tokens"])

    return let(ranks.tokens(word), lambda t: F.when(F.length(t) > 1, folded(t)).otherwise(t))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word: a heap of ranked pairs over a linked list of parts."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        rank = ranks.get(word[i : end[j]]) if j < n else None
        return None if rank is None else (rank, i, end[j])

    heap = [x for x in map(pair, range(n)) if x]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= n or end[j] != stop:  # a part of the pair has changed since
            continue
        gone[j], end[i] = 1, stop
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and (x := pair(k)):
                heapq.heappush(heap, x)
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


def _long_words(ranks: dict[bytes, int]):
    @F.pandas_udf("array<string>")
    def tokens(words: pd.Series) -> pd.Series:
        return words.map(lambda row: ["".join(map(token_char, merge_long(w.encode(), ranks))) for w in row])

    return tokens


def pieces(text: Column, pattern: str) -> Column:
    """Matches of the split pattern, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def common_words(docs: DataFrame, ranks: RankMap, pattern: str, limit: int = COMMON) -> Column:
    """Constant map of the most frequent distinct words of all texts to their tokens.

    All words are counted, in the map tasks first; the ``limit`` most frequent ones are
    encoded, once each, and gathered. The others are not cut off: ``encode`` folds each of
    them where it stands.
    """
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = (
        docs.select(F.explode(pieces(F.col("text").cast("string"), pattern)).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n"))
        .filter((F.octet_length("word") <= LONG) & (F.col("n") > 1))
        .orderBy(F.desc("n"), "word").limit(limit).repartition(spread)
    )
    held = words.select("word", ranks.maps.alias("pairs"))
    rows = held.select("word", let(F.col("pairs"), lambda maps: merged(F.col("word"), ranks, maps)).alias("tokens")).toArrow()
    return constant_map(docs.sparkSession, zip(*(rows[c].to_pylist() for c in ("word", "tokens")), strict=True))


def _short_plan_texts(spark: SparkSession) -> None:
    """Cut the texts of plans: the driver keeps some for each execution, and they spell literals out."""
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, common: int = COMMON) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids (array of int).

    Each match of ``pattern`` is encoded by itself, without special tokens: text that matches
    nothing has no ids. Three ways to the same ids: a word among the ``common`` most frequent
    ones is looked up; others are folded in place; words over LONG bytes are merged by a heap
    in Arrow batches. No text and no id is shuffled. Sets spark.sql.maxPlanStringLength of the
    session to PLAN_TEXT.

    Null or empty text: no ids. A vocabulary must hold all single bytes. Repeated rows and null
    ids are encoded row by row; other columns are ignored; no rows, no result.
    """
    _short_plan_texts(docs.sparkSession)
    pairs = RankMap(docs.sparkSession, ranks)
    frequent = common_words(docs, pairs, pattern, common)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), pieces(F.col("text").cast("string"), pattern).alias("words"))
    rows = rows.withColumn("long", F.array_distinct(F.filter("words", lambda w: F.octet_length(w) > LONG)))
    rows = rows.withColumn("known", F.map_from_arrays("long", _long_words(ranks)("long")))

    def tokens(word: Column, maps: Column) -> Column:
        short = F.coalesce(found(maps["frequent"], word), merged(word, pairs, maps["pairs"]))
        return F.when(F.octet_length(word) > LONG, F.try_element_at("known", word)).otherwise(short)

    held = rows.select("doc_id", "words", "known", frequent.alias("frequent"), pairs.maps.alias("pairs"))
    every = let(F.struct("frequent", "pairs"), lambda maps: F.array_join(F.transform("words", lambda w: tokens(w, maps)), ""))
    joined = held.select("doc_id", every.alias("tokens"))
    ids = F.transform(F.split("tokens", ""), lambda c: char_rank(c, ranks))
    return joined.select("doc_id", F.when(F.length("tokens") > 0, ids).otherwise(F.array().cast("array<int>")).alias("ids"))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of a list of ids: their binary pieces, one after the other. Unknown ids add nothing."""
    tokens = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.hex().upper()
    literal = F.from_json(F.lit(json.dumps(tokens)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))


def encoded_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids, one space between), decoded_sha256."""
    return encode(docs, ranks, pattern).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )
