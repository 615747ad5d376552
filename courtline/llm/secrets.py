"""Secret scans: a trigram index picks candidate documents per rule, regexes verify them."""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import let

#: Alternatives a literal run may have before it is cut.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java, RE2 and Python share; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the three kinds of the contract, in its order
BASE = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    # a run under the least length fails as a whole, so the length may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further token formats that their issuers publish.
MORE = (
    Rule("private_key", r"-----BEGIN[A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\x20-\x22/:@<>]+:[^\x20-\x22/:@<>]+@"),
)
RULES = BASE + MORE


def _strings(seq) -> list[set[str] | None]:
    """The pattern as a list of pieces: the strings it can be (lower case), or None for a gap."""
    out: list[set[str] | None] = []
    for op, arg in seq:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()})
        elif op is sre.AT:
            out.append({""})
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, v in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(v).lower())
                elif kind is sre.RANGE and v[1] - v[0] < 8:
                    chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    chars = None
                    break
            out.append(chars if chars is None or len(chars) <= 6 else None)
        elif op is sre.SUBPATTERN:
            out.extend(_strings(arg[3]))
        elif op is sre.BRANCH:
            branches = [_exact(_strings(b)) for b in arg[1]]
            out.append(None if None in branches else set().union(*branches))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            exact = _exact(_strings(inner))
            if exact is not None and (low, high) == (0, 1):
                out.append({""} | exact)
            else:
                out.extend([exact] * min(low, 8))
                if low != high or low > 8:
                    out.append(None)
        else:
            out.append(None)
    return out


def _exact(pieces: list[set[str] | None]) -> set[str] | None:
    got = {""}
    for p in pieces:
        if p is None or len(got) * len(p) > MAX_STRINGS:
            return None
        got = {a + b for a in got for b in p}
    return got


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigram sets; any match holds all of one set. None: no trigram is mandatory.

    Over lower-cased text, so that one index serves rules of either case.
    """
    runs: list[set[str]] = [{""}]
    for p in _strings(parser.parse(pattern)):
        if p is None:
            runs.append({""})
        elif len(runs[-1]) * len(p) > MAX_STRINGS:
            runs.append(p)
        else:
            runs[-1] = {a + b for a in runs[-1] for b in p}
    query = {frozenset()}
    for run in runs:
        if min(map(len, run)) < 3:
            continue
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        wider = {a | b for a, b in itertools.product(query, sets)}
        query = wider if len(wider) <= MAX_STRINGS else query
    query = {q for q in query if not any(other < q for other in query)}
    return None if query == {frozenset()} else sorted(query, key=sorted)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that some rule asks for."""
    found = let(
        F.lower("text"),
        lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)),
    )
    return docs.select("doc_id", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds): documents whose postings meet one alternative of a rule's query."""
    clauses = [
        (kind, i, len(c), t) for kind, q in queries.items() for i, c in enumerate(q) for t in sorted(c)
    ]
    # as many rows as the rules have trigrams
    wanted = F.broadcast(index.sparkSession.createDataFrame(clauses, "kind string, clause int, size int, trigram string"))
    return (
        index.join(wanted, "trigram").distinct()
        .groupBy("doc_id", "kind", "clause", "size").agg(F.count("*").alias("got")).filter("got = size")
        .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    )


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost matches as array of (start, order, end), code points, end exclusive.

    Lengths of the pieces between matches and of the matches add up to the positions.
    """
    pattern = F.lit(rule.pattern)
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length).alias("match"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length).alias("part"),
    )
    none = F.array().cast("array<struct<start:bigint,ord:int,stop:bigint>>")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["match"], F.lit(0))
        hit = F.array(F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("stop")))
        good = F.coalesce(x["part"] >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(lengths, state, step)["out"]).otherwise(none)


def _joined(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``_found``: sorted array of (start, ord, stop).

    Rules whose trigram query is empty of alternatives scan every text. The others read only
    the texts that the index names; the index holds (trigram, doc_id) rows for the trigrams of
    the rules, so no posting list is ever one value. A null doc_id has no posting to join on:
    such rows are verified against every rule.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    if trigrams:
        index = build_index(docs.filter("doc_id is not null").select("doc_id", "text"), trigrams)
        may = candidates(index, queries).select(F.col("doc_id").alias("_of"), F.col("kinds").alias("_kinds"))
        docs = docs.join(may, F.col("doc_id") == F.col("_of"), "left")
    else:
        docs = docs.withColumns({"_of": F.lit(None), "_kinds": F.lit(None).cast("array<string>")})
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,ord:int,stop:bigint>>")
    parts = []
    for i, rule in enumerate(rules):
        spans = rule_spans(text, rule, i)
        if rule.kind in queries:
            asked = F.coalesce(F.array_contains("_kinds", rule.kind), F.col("doc_id").isNull())
            spans = F.when(asked, spans).otherwise(none)
        parts.append(spans)
    return docs.withColumn("_found", F.array_sort(F.concat(*parts))).drop("_of", "_kinds")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base kinds, their digest, all spans.

    Null text is an empty one. No match: zero counts, the digest of the empty string, empty
    spans. Rows of one doc_id share candidates and are verified one by one; a null doc_id is
    verified against all rules; repeated rows give repeated rows. Other columns are ignored.
    """
    kinds = [r.kind for r in RULES]
    found = find_secrets(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    base = F.filter("_found", lambda s: s["ord"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("_found", lambda s: s["ord"] == i)).cast("bigint")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select(
        "doc_id", *counts,
        F.sha2(F.when(F.size(base) > 0, _joined(base, kinds)).otherwise(""), 256).alias("base_sha256"),
        F.when(F.size("_found") > 0, _joined(F.col("_found"), kinds)).otherwise("").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of found characters replaced by ``mark``; all columns stay.

    Overlapping or touching spans become one mark; n_chars, where the table has it, follows.
    """
    text = F.col("text")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = (s["start"] > acc["at"]) | (acc["at"] == 0)
        between = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate("_found", state, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    out = find_secrets(docs)
    clean = out.withColumn("_new", F.when(F.size("_found") > 0, done).otherwise(text))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("_found") > 0, F.char_length("_new").cast("bigint")).otherwise(F.col("n_chars")))
    return clean.withColumn("text", F.col("_new")).select(docs.columns)


def sql() -> str:
    """The query on DuckDB: the same rules on every text, without the index."""
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, unnest(m) AS m, unnest(g) AS g, unnest(s[1:len(m)]) AS s, "
            f"unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, "
            f"regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS s FROM d "
            f"WHERE regexp_matches(t, '{pattern}'))"
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    counts = ", ".join(
        f"CAST(count(CASE WHEN ord = {i} THEN 1 END) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE)
    )
    span = "kind || ':' || (stop - length(m)) || ':' || stop"
    order = "ORDER BY stop - length(m), ord"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    hit AS ({" UNION ALL ".join(parts)}),
    placed AS (
        SELECT *, sum(length(s) + length(m)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM hit
    ),
    good AS (SELECT * FROM placed WHERE length(g) >= CASE ord {least} END),
    found AS (
        SELECT doc_id, {counts},
            coalesce(string_agg({span}, ',' {order}) FILTER (WHERE ord < {len(BASE)}), '') AS base,
            string_agg({span}, ',' {order}) AS spans
        FROM good GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
        coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN found USING (doc_id)"""
