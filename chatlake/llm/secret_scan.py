"""Secret scans with a trigram inverted index, in DataFrame operations.

From each rule's regular expression a Boolean trigram query is derived: an AND
of clauses, each an OR of literal strings' trigrams that every match must hold.
The index posts (trigram, text) for each trigram that any query mentions, over
lower-cased texts.  Postings are intersected by grouped counts; only candidate
texts are verified by a rule's expression, and rules without a mandatory trigram
scan every text.  A text is posted by its 64-bit hash: texts that share one are
verified alike, so the hash only ever adds candidates.

Matches are leftmost and non-overlapping within a rule.  Their places come from
one expression, ``\\G(.*?)(rule)``: the lengths between matches add up, in code
points, and ``\\G`` keeps the search linear.

Defined results: a null or empty text has no spans; ties at a start are ordered
by rule; repeated rows repeat; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.shared import Scratch


#: Matches of a text that are walked in one go.
PIECE = 256


@dataclass(frozen=True)
class Rule:
    """``least`` code points in ``group`` (0: the match); shorter matches are dropped, not retried."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False


#: The three base rules, then published token formats.
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
]
RULES = BASE_RULES + MORE_RULES

MOST_STRINGS = 64

Clause = frozenset[frozenset[str]]


def trigram_query(pattern: str) -> list[Clause]:
    """AND of clauses; a clause is an OR of trigram sets.  Empty: nothing is mandatory."""
    strings, clauses = _walk(re._parser.parse(pattern))
    return _unique([*clauses, *_clause(strings)])


def _clause(strings: set[str] | None) -> list[Clause]:
    """What a match that holds one of the strings must hold."""
    if not strings or min(map(len, strings)) < 3:
        return []
    return [frozenset(frozenset(s.lower()[i:i + 3] for i in range(len(s) - 2)) for s in strings)]


def _unique(clauses: list[Clause]) -> list[Clause]:
    return list(dict.fromkeys(clauses))


def _walk(items) -> tuple[set[str] | None, list[Clause]]:
    """The strings an expression equals, if they are few (else None), and its clauses."""
    now: set[str] | None = {""}
    exact, clauses = True, []
    for op, arg in items:
        strings, more = _item(str(op), arg)
        clauses += more
        if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
            now = {a + b for a, b in product(now, strings)}
            continue
        clauses += _clause(now)
        exact, now = False, (strings if strings is not None and len(strings) <= MOST_STRINGS else {""})
    if exact:
        return now, _unique(clauses)
    return None, _unique([*clauses, *_clause(now)])


def _item(op: str, arg) -> tuple[set[str] | None, list[Clause]]:
    if op == "LITERAL":
        return {chr(arg)}, []
    if op == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                chars |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, []
        return (chars if len(chars) <= 8 else None), []
    if op == "SUBPATTERN":
        return _walk(arg[-1])
    if op == "BRANCH":
        found = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), []
        # One clause that holds for all branches: the first of each.
        firsts = [(c + _clause(s))[:1] for s, c in found]
        return None, [frozenset().union(*(c[0] for c in firsts))] if all(firsts) else []
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = arg
        strings, clauses = _walk(inner)
        if (least, most) == (1, 1):
            return strings, clauses
        if strings is not None and most == 1:
            return strings | {""}, []
        return None, [*clauses, *_clause(strings)] if least else []
    return None, []


def queries_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(gram, rule, clause, option, need): the Boolean queries, a row for each trigram of each option."""
    rows = [(gram, r, c, o, len(option)) for r, rule in enumerate(rules)
            for c, clause in enumerate(trigram_query(rule.pattern))
            for o, option in enumerate(sorted(clause, key=sorted)) for gram in sorted(option)]
    return spark.createDataFrame(rows, "gram string, rule int, clause int, option int, need int")


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, text_hash) of a table with ``text``: the inverted index of the given trigrams."""
    low = texts.select(F.xxhash64("text").alias("text_hash"), F.lower("text").alias("low")).filter("low is not null")
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams]))
    return low.select("text_hash", F.explode(held).alias("gram")).distinct()


def candidates(index: DataFrame, queries: DataFrame, rules: list[Rule]) -> DataFrame:
    """(text_hash, rules): postings intersected for each rule with mandatory trigrams."""
    clauses = {r: len(trigram_query(rule.pattern)) for r, rule in enumerate(rules)}
    need = F.element_at(F.create_map(*[F.lit(x) for kv in clauses.items() for x in kv]), F.col("rule"))
    met = (index.join(F.broadcast(queries), "gram")  # a few rows for each rule
           .groupBy("text_hash", "rule", "clause", "option").agg(F.count("*").alias("n"), F.max("need").alias("need"))
           .filter("n = need").groupBy("text_hash", "rule").agg(F.countDistinct("clause").alias("met")))
    return met.filter(F.col("met") == need).groupBy("text_hash").agg(F.collect_set("rule").alias("rules"))


def _walked(matches: Column, order: int, base: Column) -> Column:
    """Spans of matches given by their lengths, the first search beginning at ``base``."""
    none = F.array().cast("array<struct<start:int,place:int,stop:int,ok:boolean>>")
    return F.aggregate(
        matches, F.struct(base.alias("at"), none.alias("found")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["size"]).alias("at"),
            F.concat(acc["found"], F.array(F.struct(
                (acc["at"] + m["gap"]).alias("start"), F.lit(order).alias("place"),
                (acc["at"] + m["gap"] + m["size"]).alias("stop"), m["ok"].alias("ok")))).alias("found")),
        lambda acc: acc["found"])


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, place, stop>> of a rule's matches.

    ``aggregate`` copies its list for each match, so matches are walked in pieces of PIECE, whose
    places come from a walk over the pieces: 100,000 matches of a text copy some PIECE lists each.
    """
    find = ("(?is)" if rule.any_case else "(?s)") + rf"\G(.*?)({_long(rule)})"
    # The pattern's own groups follow the two that are put around it.
    part = lambda g: F.regexp_extract_all(text, F.lit(find), F.lit(g))
    matches = F.transform(
        F.arrays_zip(F.transform(part(1), F.length).alias("gap"), F.transform(part(2), F.length).alias("size"),
                     F.transform(part(rule.group + 2), F.length).alias("value")),
        lambda m: F.struct(m["gap"], m["size"], (m["value"] >= rule.least).alias("ok")))
    none = F.array().cast("array<struct<start:int,place:int,stop:int,ok:boolean>>")
    found = _bound(matches, lambda m: F.when(F.size(m) > 0, _bound(_pieces(m), lambda p: _in_pieces(p, order))).otherwise(none))
    return F.transform(F.filter(found, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["place"], s["stop"]))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used (also inside lambdas)."""
    return F.get(F.transform(F.array(value), use), 0)


def _pieces(matches: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / PIECE).cast("int")),
                       lambda i: F.slice(matches, i * PIECE + 1, PIECE))


def _in_pieces(pieces: Column, order: int) -> Column:
    """The spans of all pieces, each begun where the one before it ends."""
    length = lambda piece: F.aggregate(piece, F.lit(0), lambda n, m: n + m["gap"] + m["size"])
    begins = F.aggregate(
        F.transform(pieces, length), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"])
    return F.flatten(F.zip_with(pieces, begins, lambda piece, at: _walked(piece, order, at)))


def scan(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``row`` (the document as it was) and ``found``, its spans by start, then rule."""
    rules = rules or RULES
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    texts = docs.select(F.col(text_col).alias("text"))
    queries = queries_table(spark, rules)
    mandatory = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for clauses in mandatory for clause in clauses for option in clause for g in option})
    index = scratch.save(postings(texts, grams), "postings")
    # Written first: its measured size decides between a broadcast and a join that can split hot texts.
    hits = scratch.save(candidates(index, queries, rules), "candidates").withColumnRenamed("text_hash", "_hash")
    text = F.col(f"row.{text_col}")
    joined = (docs.select(F.struct("*").alias("row")).withColumn("_key", F.xxhash64(text))
              .join(hits, F.col("_key") == F.col("_hash"), "left"))
    none = F.array().cast("array<struct<start:int,place:int,stop:int>>")
    each = []
    for i, rule in enumerate(rules):
        if mandatory[i]:
            wanted = F.array_contains("rules", i)
        else:
            wanted = text.rlike(_quick(rule))
        each.append(F.when(F.coalesce(wanted, F.lit(False)), spans(text, rule, i)).otherwise(none))
    return joined.select("row", F.array_sort(F.concat(*each)).alias("found"))


def _long(rule: Rule) -> str:
    """The rule's pattern without matches that are too short, where that is plain: a class repeated.

    Its matches are maximal runs, so those of the least length are found alike.
    """
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return f"{rule.pattern[:-1]}{{{rule.least},}}"
    return rule.pattern


def _quick(rule: Rule) -> str:
    return ("(?i)" if rule.any_case else "") + _long(rule)


def digest_text(found: Column, rules: list[Rule]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.get(kinds, s["place"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
