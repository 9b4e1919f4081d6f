"""Registered text-labelling queries (TX, JN3, WN, PF8-PF9) with DuckDB oracles.

The oracles are written differently from the Spark code on purpose: history
via ``lag`` windows and correlated subqueries, dictionaries via ``arg_min``
over a keyword join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlake.functions.semantics import JS_WS_CLASS
from chatlake.operators import text as X
from chatlake.plans.oracle_views import with_views
from chatlake.plans.registry import register
from chatlake.session import checkpoint_dir
from chatlake.sources import tables as T
from chatlake.sources.lexicon import (LATIN, LATIN_CURATED, LATIN_REGISTRY, load_curated, load_keywords,
                                      write_json_lines)

LEX = LATIN
TPL = X.Templates()


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join(_q(i) for i in items) + "]"


def _kw_values() -> str:
    rows = ", ".join(f"({a}, {_q(b)}, {c}, {_q(d)})" for a, b, c, d in LEX.keyword_rows())
    return f"kw(cat_rank, category, kw_rank, keyword) AS (VALUES {rows})"


def _classify_sql(src: str, key: str, text: str) -> str:
    return f"""
, {_kw_values()},
hits AS (SELECT s.{key} AS k, arg_min(kw.category, kw.cat_rank * 100000 + kw.kw_rank) AS category,
                arg_min(kw.keyword, kw.cat_rank * 100000 + kw.kw_rank) AS keyword
         FROM {src} s JOIN kw ON contains(s.{text}, kw.keyword) GROUP BY s.{key})"""


TRIM_SQL = f"regexp_replace(@X@, '^{JS_WS_CLASS}+|{JS_WS_CLASS}+$', '', 'g')"


def _trim(x: str) -> str:
    return TRIM_SQL.replace("@X@", x)


def _any(t: str, items: list[str]) -> str:
    return f"(len(list_filter({_sql_list(items)}, lambda h: contains({t}, h))) > 0)"


def _first(t: str, items: list[str]) -> str:
    return f"(list_filter({_sql_list(items)}, lambda h: contains({t}, h))[1])"


def _labelled_sql() -> str:
    """CTE 'lab': every user turn of chat_turns with all labels."""
    wc = f"len(regexp_split_to_array(trimmed, '{JS_WS_CLASS}+'))"
    return f"""
, hist AS (
  SELECT conv_id, turn, role, text,
    lag(role, 1) OVER w AS p1_role, lag(text, 1) OVER w AS p1_text,
    lag(role, 2) OVER w AS p2_role, lag(text, 2) OVER w AS p2_text
  FROM chat_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
base AS (
  SELECT conv_id, turn, text, p1_role, p1_text, p2_role, p2_text, {_trim("text")} AS trimmed,
    COALESCE(p1_role = 'ai' AND contains(p1_text, {_q(LEX.context_marker)}), false)
      OR COALESCE(p2_role = 'ai' AND contains(p2_text, {_q(LEX.context_marker)}), false) AS context_asked
  FROM hist WHERE role = 'user'),
prof AS (
  SELECT b.*, COALESCE({_first("lower(trimmed)", LEX.profession_hints)},
    (SELECT {_first("lower(e.text)", LEX.profession_hints)} FROM chat_turns e
     WHERE e.conv_id = b.conv_id AND e.role = 'user' AND e.turn < b.turn
       AND {_first("lower(e.text)", LEX.profession_hints)} IS NOT NULL
     ORDER BY e.turn LIMIT 1)) AS known_profession
  FROM base b),
typed AS (
  SELECT *, CASE WHEN {_any("trimmed", LEX.dream_markers)} THEN 'new_dream'
                 WHEN context_asked AND {wc} <= 25 THEN 'context_answer'
                 ELSE 'general_question' END AS input_type
  FROM prof)
{_classify_sql("typed", "conv_id * 10000 + turn", "trimmed")},
lab AS (
  SELECT t.*, COALESCE(h.category, {_q(LEX.default_category)}) AS category, trim(h.keyword) AS entity,
    list_filter([CASE WHEN NOT {_any("lower(t.trimmed)", LEX.location_hints)} THEN {_q(LEX.missing_location)} END,
                 CASE WHEN NOT {_any("lower(t.trimmed)", LEX.emotion_hints)} THEN {_q(LEX.missing_emotion)} END,
                 CASE WHEN t.input_type = 'new_dream' AND t.known_profession IS NULL AND NOT t.context_asked
                      THEN {_q(LEX.missing_life)} END], lambda x: x IS NOT NULL) AS missing
  FROM typed t LEFT JOIN hits h ON h.k = t.conv_id * 10000 + t.turn)"""


def _curated_sql() -> str:
    rows = ", ".join(f"({i}, {_q(c)}, {('NULL' if e is None else _q(e))}, {_q(m)})"
                     for i, (c, e, m) in enumerate(LATIN_CURATED))
    reg = ", ".join(_q(r) for r in LATIN_REGISTRY)
    return f"""
, cur(line_no, category, entity, meaning) AS (VALUES {rows}),
ent AS (SELECT category, entity, arg_max(meaning, line_no) AS em FROM cur
        WHERE entity IS NOT NULL AND category IN ({reg}) GROUP BY 1, 2),
gen AS (SELECT category, arg_max(meaning, line_no) AS gm FROM cur
        WHERE entity IS NULL AND category IN ({reg}) GROUP BY 1),
cl AS (
  SELECT l.*, CASE WHEN l.input_type IN ('new_dream', 'context_answer')
                   THEN COALESCE(NULLIF(ent.em, ''), NULLIF(gen.gm, '')) END AS meaning
  FROM lab l LEFT JOIN ent ON ent.category = l.category AND ent.entity = l.entity
  LEFT JOIN gen ON gen.category = l.category)"""


def _labelled(spark, d):
    return X.label_turns(T.chat_turns(spark, d), LEX)


def _curated(spark, d):
    return X.curated_lookup(_labelled(spark, d), X.curated_frame(spark, LATIN_CURATED), LATIN_REGISTRY)


# ---------------------------------------------------------------- TX1

@register("TX1_classify_documents", with_views([], (_classify_sql("documents", "doc_id", "text") + f"""
SELECT d.doc_id, COALESCE(h.category, {_q(LEX.default_category)}) AS category, trim(h.keyword) AS entity
FROM documents d LEFT JOIN hits h ON h.k = d.doc_id""")))
def tx1_docs(spark, d):
    return X.classify(T.load(spark, d, "documents"), "text", LEX).select("doc_id", "category", "entity")


@register("JN6_keyword_match_join", with_views([], (_classify_sql("documents", "doc_id", "text") + f"""
SELECT d.doc_id, COALESCE(h.category, {_q(LEX.default_category)}) AS category, trim(h.keyword) AS entity
FROM documents d LEFT JOIN hits h ON h.k = d.doc_id""")))
def jn6(spark, d):
    docs = T.load(spark, d, "documents").select("doc_id", "text")
    return X.classify(docs, "text", LEX, key_cols=["doc_id"], method="join").select("doc_id", "category", "entity")


@register("TX1_classify_automaton", with_views([], (_classify_sql("documents", "doc_id", "text") + f"""
SELECT d.doc_id, COALESCE(h.category, {_q(LEX.default_category)}) AS category, trim(h.keyword) AS entity
FROM documents d LEFT JOIN hits h ON h.k = d.doc_id""")))
def tx1_automaton(spark, d):
    """TX1/JN6 by one pass of the keyword automaton: no join, no shuffle."""
    docs = T.load(spark, d, "documents").select("doc_id", "text")
    return X.classify(docs, "text", LEX, method="automaton").select("doc_id", "category", "entity")


def passage_dictionary(spark, d):
    """Every word of the benchmark passages of four letters or more as a keyword; longer words come first."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("keyword")
    words = T.load(spark, d, "benchmark").select(word).where(F.length("keyword") >= 4).distinct()
    by_size = Window.partitionBy(F.length("keyword")).orderBy("keyword")
    return words.select((1000 - F.length("keyword")).alias("cat_rank"),
                        F.concat(F.lit("letters_"), F.length("keyword").cast("string")).alias("category"),
                        F.row_number().over(by_size).alias("kw_rank"), "keyword")


_PASSAGES = with_views([], r"""
, words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS keyword FROM benchmark),
hits AS (SELECT d.doc_id, arg_min(w.keyword, {'n': -length(w.keyword), 'w': w.keyword}) AS keyword
         FROM documents d JOIN words w ON length(w.keyword) >= 4 AND contains(d.text, w.keyword) GROUP BY d.doc_id)
SELECT d.doc_id, COALESCE('letters_' || length(h.keyword), 'other') AS category, h.keyword AS entity
FROM documents d LEFT JOIN hits h USING (doc_id)""")


@register("JN6_passage_dictionary", _PASSAGES)
def jn6_passages(spark, d):
    """The automaton over a dictionary that is a table and grows with the input."""
    docs = T.load(spark, d, "documents").select("doc_id", "text")
    return X.classify_by_table(docs, "text", passage_dictionary(spark, d), "other").select("doc_id", "category", "entity")


@register("SC2_keyword_file", _PASSAGES)
def sc2(spark, d):
    """The same dictionary as a file of JSON lines, written and scanned in its order."""
    path = f"{checkpoint_dir(spark)}/keywords-{uuid.uuid4().hex}"
    lines = (passage_dictionary(spark, d).groupBy("cat_rank", "category")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("kw_rank", "keyword"))), lambda x: x["keyword"])
                  .alias("keywords")))
    write_json_lines(lines, path, "cat_rank", ["category", "keywords"])
    docs = T.load(spark, d, "documents").select("doc_id", "text")
    return X.classify_by_table(docs, "text", load_keywords(spark, path), "other").select("doc_id", "category", "entity")


@register("TX1_classify_chat_turns", with_views(["chat_turns"], _classify_sql("chat_turns", "conv_id * 10000 + turn", "text") + f"""
SELECT c.conv_id, c.turn, COALESCE(h.category, {_q(LEX.default_category)}) AS category, trim(h.keyword) AS entity
FROM chat_turns c LEFT JOIN hits h ON h.k = c.conv_id * 10000 + c.turn"""))
def tx1_turns(spark, d):
    return X.classify(T.chat_turns(spark, d), "text", LEX).select("conv_id", "turn", "category", "entity")


# ---------------------------------------------------------------- WN4, WN5, TX2, TX3

_LAB = with_views(["chat_turns"], _labelled_sql() + "\nSELECT {cols} FROM lab")


@register("WN4_context_asked", _LAB.replace("{cols}", "conv_id, turn, context_asked"))
def wn4(spark, d):
    return _labelled(spark, d).select("conv_id", "turn", "context_asked")


@register("WN5_known_profession", _LAB.replace("{cols}", "conv_id, turn, known_profession"))
def wn5(spark, d):
    return _labelled(spark, d).select("conv_id", "turn", "known_profession")


@register("TX2_classify_input", _LAB.replace("{cols}", "conv_id, turn, input_type, category, entity"))
def tx2(spark, d):
    return _labelled(spark, d).select("conv_id", "turn", "input_type", "category", "entity")


@register("TX2_classify_input_automaton", _LAB.replace("{cols}", "conv_id, turn, known_profession, input_type, category, entity"))
def tx2_automaton(spark, d):
    """TX1, TX2 and WN5 with all lists found by automata."""
    return X.label_turns(T.chat_turns(spark, d), LEX, method="automaton") \
        .select("conv_id", "turn", "known_profession", "input_type", "category", "entity")


@register("TX3_missing_context", _LAB.replace("{cols}", "conv_id, turn, array_to_string(missing, '|') AS missing_items"))
def tx3(spark, d):
    return _labelled(spark, d).select("conv_id", "turn", F.array_join("missing", "|").alias("missing_items"))


# ---------------------------------------------------------------- JN3, TX4, SC3

@register("JN3_curated_lookup", with_views(["chat_turns"], _labelled_sql() + _curated_sql() + """
SELECT conv_id, turn, input_type, category, entity, meaning FROM cl"""))
def jn3(spark, d):
    return _curated(spark, d).select("conv_id", "turn", "input_type", "category", "entity", "meaning")


@register("SC3_curated_file", with_views(["chat_turns"], _labelled_sql() + _curated_sql() + """
SELECT conv_id, turn, input_type, category, entity, meaning FROM cl"""))
def sc3(spark, d):
    """JN3 of all chat turns with the curated meanings read from a file of JSON lines."""
    path = f"{checkpoint_dir(spark)}/curated-{uuid.uuid4().hex}"
    write_json_lines(X.curated_frame(spark, LATIN_CURATED), path, "line_no", ["category", "entity", "meaning"])
    return X.curated_lookup(_labelled(spark, d), load_curated(spark, path), LATIN_REGISTRY) \
        .select("conv_id", "turn", "input_type", "category", "entity", "meaning")


def _tx4_sql() -> str:
    nl = "chr(10)"

    def tpl(s: str) -> str:
        parts = s.split("\n")
        return f" || {nl} || ".join(_q(p) for p in parts) if len(parts) > 1 else _q(s)

    prof = f"COALESCE({tpl(TPL.profession_note.split('{profession}')[0])} || known_profession || " \
           f"{_q(TPL.profession_note.split('{profession}')[1])}, '')"
    know = f"COALESCE({tpl(TPL.knowledge_note.split('{meaning}')[0])} || meaning || " \
           f"{_q(TPL.knowledge_note.split('{meaning}')[1])}, '')"
    miss_head, miss_tail = TPL.new_dream_missing.split("{missing}")
    directive = f"""CASE WHEN input_type = 'context_answer' THEN {tpl(TPL.context_answer)} || {prof} || {know}
      WHEN input_type = 'general_question' THEN {tpl(TPL.general)}
      WHEN len(missing) > 0 THEN {tpl(miss_head)} || array_to_string(missing, {_q(LEX.joiner)}) || {_q(miss_tail)} || {prof} || {know}
      ELSE {tpl(TPL.new_dream_complete)} || {prof} || {know} END"""

    def hist(r: str, t: str) -> str:
        return (f"CASE WHEN {r} = 'ai' THEN 'assistant' ELSE 'user' END AS role, "
                f"CASE WHEN length({t}) > 500 THEN substr({t}, 1, 500) || '...' ELSE {t} END AS content")
    h2 = "(p2_role IN ('user', 'ai'))"
    h1 = "(p1_role IN ('user', 'ai'))"
    return f"""
SELECT conv_id, turn, 1 AS msg_idx, 'system' AS role, {_q(TPL.system)} AS content FROM cl
UNION ALL SELECT conv_id, turn, 2, {hist("p2_role", "p2_text")} FROM cl WHERE {h2}
UNION ALL SELECT conv_id, turn, 2 + CAST({h2} AS INT), {hist("p1_role", "p1_text")} FROM cl WHERE {h1}
UNION ALL SELECT conv_id, turn, 2 + CAST(COALESCE({h2}, false) AS INT) + CAST(COALESCE({h1}, false) AS INT),
  'user', trimmed || {directive} FROM cl"""


@register("TX4_build_prompt", with_views(["chat_turns"], _labelled_sql() + _curated_sql() + _tx4_sql()))
def tx4(spark, d):
    p = X.build_prompts(_curated(spark, d), TPL, LEX)
    return (p.select("conv_id", "turn", F.posexplode("messages").alias("i", "m"))
             .select("conv_id", "turn", (F.col("i") + 1).alias("msg_idx"),
                     F.col("m.role").alias("role"), F.col("m.content").alias("content")))


# ---------------------------------------------------------------- TX5

def responses(spark, d):
    """Model responses derived from the AI turns: one exchange per conversation."""
    ai = T.chat_turns(spark, d).where(F.col("role") == "ai")
    r = F.col("turn") % 3
    return ai.select(F.col("conv_id").alias("exchange_id"),
                     F.when(r == 0, "synthesis").when(r == 1, "primary").otherwise("secondary").alias("source"),
                     F.when(F.col("turn") % 5 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"),
                     F.col("turn").alias("seq"))


@register("TX5_merge_sources", with_views(["chat_turns"], f"""
, r AS (SELECT conv_id AS exchange_id,
          CASE turn % 3 WHEN 0 THEN 'synthesis' WHEN 1 THEN 'primary' ELSE 'secondary' END AS source,
          CASE WHEN turn % 5 = 0 THEN '  ' ELSE text END AS text, turn AS seq
        FROM chat_turns WHERE role = 'ai'),
g AS (SELECT exchange_id,
        arg_max(text, seq) FILTER (WHERE source = 'synthesis') AS s,
        arg_max(text, seq) FILTER (WHERE source = 'primary') AS p,
        arg_max(text, seq) FILTER (WHERE source = 'secondary') AS q FROM r GROUP BY 1)
SELECT exchange_id,
  COALESCE(NULLIF({_trim("s")}, ''), {_trim("p")}, {_trim("q")}) AS answer,
  CASE WHEN NULLIF({_trim("s")}, '') IS NOT NULL THEN 'synthesis' WHEN p IS NOT NULL THEN 'primary'
       WHEN q IS NOT NULL THEN 'secondary' END AS answer_source
FROM g WHERE COALESCE(s, p, q) IS NOT NULL"""))
def tx5(spark, d):
    return X.select_answer(responses(spark, d))


@register("TX5_synthesis_input", with_views(["chat_turns"], f"""
, r AS (SELECT conv_id AS exchange_id, CASE turn % 3 WHEN 1 THEN 'p' WHEN 2 THEN 'q' END AS source,
          CASE WHEN turn % 5 = 0 THEN '  ' ELSE text END AS text, turn AS seq FROM chat_turns WHERE role = 'ai'),
p AS (SELECT * FROM r WHERE source = 'p' QUALIFY row_number() OVER (PARTITION BY exchange_id ORDER BY seq DESC) = 1),
q AS (SELECT * FROM r WHERE source = 'q' QUALIFY row_number() OVER (PARTITION BY exchange_id ORDER BY seq DESC) = 1),
u AS (SELECT conv_id AS exchange_id, text FROM chat_turns WHERE role = 'user'
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
SELECT exchange_id, 'Message: ' || {_trim("u.text")} || chr(10) || chr(10) || '[Answer 1]:' || chr(10) || p.text
  || chr(10) || chr(10) || '[Answer 2]:' || chr(10) || q.text || chr(10) || chr(10)
  || 'Merge the two answers into one.' AS content
FROM p JOIN q USING (exchange_id) JOIN u USING (exchange_id)"""))
def tx5_input(spark, d):
    """The last user turn of each conversation with the two answers of ``responses``."""
    last = (T.chat_turns(spark, d).where(F.col("role") == "user")
            .groupBy(F.col("conv_id").alias("exchange_id")).agg(F.max_by("text", "turn").alias("text")))
    return X.synthesis_input(responses(spark, d), last)


# ---------------------------------------------------------------- WN1-WN3

@register("WN1_recent_sessions", with_views(["dream_sessions", "dream_messages"], """
SELECT * FROM (
  SELECT s.id, s.user_id, s.title, s.created_at,
    row_number() OVER (PARTITION BY s.user_id ORDER BY s.created_at DESC NULLS FIRST, s.id DESC) AS rank
  FROM dream_sessions s WHERE EXISTS (SELECT 1 FROM dream_messages m WHERE m.session_id = s.id)
) WHERE rank <= 20"""))
def wn1(spark, d):
    return X.recent_sessions(T.dream_sessions(spark, d), T.dream_messages(spark, d), 20).select(
        "id", "user_id", "title", "created_at", F.col("rank").cast("bigint").alias("rank"))


def logins(spark, d):
    """Sign-ins per device derived from events: device by user, e-mail by user."""
    e = T.load(spark, d, "events")
    return e.select(F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("device"),
                    F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
                    F.col("ts"))


@register("WN2_recent_accounts", with_views([], """
, lg AS (SELECT 'd' || CAST(user_id % 7 AS VARCHAR) AS device,
                'u' || CAST(user_id AS VARCHAR) || '@example.com' AS email, ts FROM events),
l AS (SELECT device, email, max(ts) AS ts FROM lg GROUP BY 1, 2)
SELECT * FROM (SELECT device, email, ts, row_number() OVER (PARTITION BY device ORDER BY ts DESC, email) AS rank
               FROM l) WHERE rank <= 5"""))
def wn2(spark, d):
    return X.recent_accounts(logins(spark, d)).select("device", "email", "ts",
                                                      F.col("rank").cast("bigint").alias("rank"))


@register("WN3_session_title", with_views(["chat_turns"], """
, f AS (SELECT conv_id, arg_min(text, turn) AS t FROM chat_turns WHERE role = 'user' GROUP BY 1)
SELECT conv_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 40) || '…' ELSE t END AS title FROM f"""))
def wn3(spark, d):
    return X.session_titles(T.chat_turns(spark, d))


# ---------------------------------------------------------------- PF8, PF9

@register("PF9_input_validity", with_views(["chat_turns"], f"""
SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'missing'
  WHEN length({_trim("text")}) < 2 THEN 'too_short' WHEN length(text) > 6000 THEN 'too_long' END AS reason
FROM chat_turns"""))
def pf9(spark, d):
    return X.validate_messages(T.chat_turns(spark, d)).select("conv_id", "turn", "reason")
