"""Text labelling and prompt assembly over whole tables of chat turns.

The application labels one message per request; here the same rules run on a
table of turns (conv_id, turn, role, text).  Everything is built-in column
expressions (``filter``/``exists``/``contains`` over literal arrays), so the
work stays in the JVM; the higher-order functions run outside whole-stage
codegen and test every keyword.

Turn-history rules use equi-joins on (conv_id, turn) rather than windows
partitioned by conversation: the join key includes the turn number, so the
turns of a very long conversation hash to many partitions instead of landing
in one window task.  Turns are dense per conversation (0..n-1), as the chat
client sends the whole history.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.joins import broadcast_if_small
from chatlake.functions.semantics import col_, js_trim, js_word_count
from chatlake.operators import keyword_scan
from chatlake.sources.lexicon import (CONTEXT_ANSWER_MAX_WORDS, HISTORY_MAX_CHARS, MAX_MESSAGE_CHARS,
                                      MIN_MESSAGE_CHARS, SOURCE_LABEL, Lexicon)

#: TX5: the synthesis message; its wording is the caller's to choose.
SYNTHESIS_TEMPLATE = ("Message: {text}\n\n[Answer 1]:\n{first}\n\n[Answer 2]:\n{second}\n\n"
                      "Merge the two answers into one.")


# ------------------------------------------------------------------ TX1 / JN6

def keyword_frame(spark, lex: Lexicon) -> DataFrame:
    """SC2: the ordered dictionary as a DataFrame (cat_rank, category, kw_rank, keyword)."""
    return spark.createDataFrame(lex.keyword_rows(),
                                 "cat_rank int, category string, kw_rank int, keyword string")


def _keyword_array(lex: Lexicon) -> Column:
    return F.array(*[F.struct(F.lit(cat).alias("category"), F.lit(kw).alias("kw"))
                     for _, cat, _, kw in lex.keyword_rows()])


# The three precomposed Bengali letters and their canonical
# decomposed forms (base letter + U+09BC NUKTA): RRA, RHA, YYA.
PRECOMPOSED = [("\u09dc", "\u09a1\u09bc"), ("\u09dd", "\u09a2\u09bc"), ("\u09df", "\u09af\u09bc")]


def decompose_nukta(c: Column) -> Column:
    """Map the precomposed nukta letters to base + nukta (what NFC/NFD both do for them)."""
    for pre, dec in PRECOMPOSED:
        c = F.replace(c, F.lit(pre), F.lit(dec))
    return c


def _decompose_py(s: str) -> str:
    for pre, dec in PRECOMPOSED:
        s = s.replace(pre, dec)
    return s


def first_keyword(text: Column, lex: Lexicon) -> Column:
    """Struct(category, kw) of the first dictionary keyword contained in ``text`` (or NULL)."""
    return F.try_element_at(F.filter(_keyword_array(lex), lambda k: text.contains(k["kw"])), F.lit(1))


def classify(df: DataFrame, text_col: str, lex: Lexicon, key_cols: list[str] | None = None,
             method: str = "literal", normalize: bool = False) -> DataFrame:
    """TX1: add (category, entity): first category, then first keyword, contained in the text.

    Case-sensitive substring match on the untrimmed keyword; the entity is the
    trimmed keyword; no hit gives (default category, NULL).

    ``method='literal'`` evaluates the dictionary as a literal array per row (no
    shuffle).  ``method='join'`` joins the size-checked dictionary on
    ``contains`` and keeps each row's best-ranked hit with ``min_by``; rows are
    told apart by a row id, so repeated and NULL keys keep their own answers
    (``key_cols`` is accepted and not needed).  ``method='automaton'`` finds the
    first keyword in one pass of each text, whatever the number of keywords
    (``keyword_scan``; ``classify_by_table`` for a dictionary that is a table).
    The caller chooses; the answers are the same.
    """
    if normalize:
        # Optional: match precomposed and decomposed spellings alike (the default
        # matches code points exactly, as the application does).
        from dataclasses import replace
        lex = replace(lex, categories=[(c, [_decompose_py(k) for k in kws]) for c, kws in lex.categories])
        df = df.withColumn("_norm_text", decompose_nukta(F.col(text_col)))
        out = classify(df, "_norm_text", lex, key_cols, method, normalize=False)
        return out.drop("_norm_text")
    if method == "literal":
        hit = first_keyword(F.col(text_col), lex)
        return (df.withColumn("_hit", hit)
                  .withColumn("category", F.coalesce(F.col("_hit.category"), F.lit(lex.default_category)))
                  .withColumn("entity", js_trim(F.col("_hit.kw")))
                  .drop("_hit"))
    if method == "automaton":
        return classify_by_table(df, text_col, keyword_frame(df.sparkSession, lex), lex.default_category)
    kw = broadcast_if_small(keyword_frame(df.sparkSession, lex))
    rows = df.select(F.struct("*").alias("_r"), F.monotonically_increasing_id().alias("_row"))
    best = (rows.join(kw, F.col(f"_r.{text_col}").contains(F.col("keyword")), "left")
                .groupBy("_row")
                .agg(F.any_value("_r").alias("_r"),
                     F.min_by(F.struct("category", "keyword"), F.struct("cat_rank", "kw_rank")).alias("_hit")))
    return best.select("_r.*", F.coalesce(F.col("_hit.category"), F.lit(lex.default_category)).alias("category"),
                       js_trim(F.col("_hit.keyword")).alias("entity"))


def classify_by_table(df: DataFrame, text_col: str, keywords: DataFrame, default_category: str,
                      max_keywords: int = keyword_scan.MAX_KEYWORDS) -> DataFrame:
    """TX1 with a dictionary of any size: ``keywords`` (cat_rank, category, kw_rank, keyword)."""
    found = keyword_scan.first_keyword(df, text_col, keywords, max_keywords=max_keywords)
    return found.select("row.*", F.when(F.col("keyword").isNull(), F.lit(default_category)).otherwise(F.col("category"))
                        .alias("category"), js_trim(F.col("keyword")).alias("entity"))


# ------------------------------------------------------------------ hints, TX2, TX3

def first_hint(text_lower: Column, hints: list[str]) -> Column:
    """First hint (list order) contained in an already lower-cased text, or NULL."""
    return F.try_element_at(F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: text_lower.contains(h)), F.lit(1))


def any_hint(text: Column, hints: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: text.contains(h))


def classify_input(trimmed: Column, context_asked: Column, lex: Lexicon, marked: Column | None = None) -> Column:
    """TX2: new_dream (marker present) / context_answer / general_question."""
    return (F.when(any_hint(trimmed, lex.dream_markers) if marked is None else marked, "new_dream")
             .when(context_asked & (js_word_count(trimmed) <= CONTEXT_ANSWER_MAX_WORDS), "context_answer")
             .otherwise("general_question"))


def missing_context(trimmed: Column, input_type: Column, known_profession: Column,
                    context_asked: Column, lex: Lexicon) -> Column:
    """TX3: missing-context labels, in order: location, emotion, then (new dreams) life context."""
    t = F.lower(trimmed)
    items = F.array(
        F.when(~any_hint(t, lex.location_hints), F.lit(lex.missing_location)),
        F.when(~any_hint(t, lex.emotion_hints), F.lit(lex.missing_emotion)),
        F.when((input_type == "new_dream") & known_profession.isNull() & ~context_asked,
               F.lit(lex.missing_life)),
    )
    return F.filter(items, lambda x: x.isNotNull())


# ------------------------------------------------------------------ WN4, WN5, turn labelling

def label_turns(turns: DataFrame, lex: Lexicon, method: str = "literal") -> DataFrame:
    """Label every user turn as a chat request, with the turns before it as history.

    Adds: trimmed, context_asked (WN4), known_profession (WN5), input_type
    (TX2), category/entity (TX1) and missing (TX3), plus the two previous
    turns (p1 = newest) for prompt assembly.  ``method`` is that of ``classify``;
    with 'automaton' markers and profession hints are found by it too, in one visit.
    """
    if method == "automaton":
        lower = F.lower(F.col("text"))
        turns = keyword_scan.add_first(turns, {
            "_hint": (F.when(F.col("role") == "user", lower), lex.profession_hints),
            "_own_hint": (F.when(F.col("role") == "user", F.lower(js_trim(F.col("text")))), lex.profession_hints),
            "_marker": (F.when(F.col("role") == "user", js_trim(F.col("text"))), lex.dream_markers)})
    users = turns.where(F.col("role") == "user")
    # The two items before each, whatever their turn numbers.
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = {f"p{back}_{c}": F.lag(c, back).over(w) for back in (1, 2) for c in ("role", "text")}
    x = turns.withColumns(before).where(F.col("role") == "user")

    def asked(role: str, text: str) -> Column:
        return F.coalesce((F.col(role) == "ai") & F.col(text).contains(lex.context_marker), F.lit(False))

    # WN5: profession hint of the current text, else of the oldest earlier user turn with one.
    hit = F.col("_hint") if method == "automaton" else first_hint(F.lower(F.col("text")), lex.profession_hints)
    first_hits = (users.select("conv_id", "turn", hit.alias("h")).where(F.col("h").isNotNull())
                       .groupBy("conv_id")
                       .agg(F.min("turn").alias("h_turn"), F.min_by("h", "turn").alias("h_first")))
    x = x.join(first_hits, "conv_id", "left")

    trimmed = js_trim(F.col("text"))
    x = (x.withColumn("trimmed", trimmed)
          .withColumn("context_asked", asked("p1_role", "p1_text") | asked("p2_role", "p2_text"))
          .withColumn("known_profession",
                      F.coalesce(F.col("_own_hint") if method == "automaton"
                                 else first_hint(F.lower(F.col("trimmed")), lex.profession_hints),
                                 F.when(F.col("h_turn") < F.col("turn"), F.col("h_first"))))
          .drop("h_turn", "h_first"))
    marked = F.col("_marker").isNotNull() if method == "automaton" else None
    x = x.withColumn("input_type", classify_input(F.col("trimmed"), F.col("context_asked"), lex, marked))
    x = classify(x.drop("_hint", "_own_hint", "_marker"), "trimmed", lex, method=method)
    return x.withColumn("missing", missing_context(F.col("trimmed"), F.col("input_type"),
                                                   F.col("known_profession"), F.col("context_asked"), lex))


# ------------------------------------------------------------------ JN3

def curated_frame(spark, rows: list[tuple[str, str | None, str]]) -> DataFrame:
    """SC3: curated meanings (category, entity or NULL for general, meaning) with line order."""
    data = [(i, c, e, m) for i, (c, e, m) in enumerate(rows)]
    return spark.createDataFrame(data, "line_no int, category string, entity string, meaning string")


def curated_lookup(labelled: DataFrame, curated: DataFrame, registry: list[str]) -> DataFrame:
    """JN3: add ``meaning`` for new_dream/context_answer rows.

    Category must be in ``registry``; the entity's meaning if present and
    non-empty, else the category's general text if non-empty, else NULL.
    Duplicate keys: the later line wins (``max_by(meaning, line_no)``).
    Both lookups are key joins against a size-checked broadcast dictionary.
    """
    c = curated.where(F.col("category").isin(registry))
    ent = (c.where(F.col("entity").isNotNull()).groupBy("category", "entity")
            .agg(F.max_by("meaning", "line_no").alias("_em")))
    gen = (c.where(F.col("entity").isNull()).groupBy("category")
            .agg(F.max_by("meaning", "line_no").alias("_gm")))
    x = (labelled.join(broadcast_if_small(ent), ["category", "entity"], "left")
                 .join(broadcast_if_small(gen), ["category"], "left"))
    wants = F.col("input_type").isin("new_dream", "context_answer")
    meaning = F.coalesce(F.when(F.col("_em") != "", F.col("_em")), F.when(F.col("_gm") != "", F.col("_gm")))
    return x.withColumn("meaning", F.when(wants, meaning)).drop("_em", "_gm")


# ------------------------------------------------------------------ TX4

@dataclass(frozen=True)
class Templates:
    """Prompt wording (parameters; the application's own texts are long prose)."""
    system: str = "SYSTEM"
    context_answer: str = "\n[type: context answer]"
    general: str = "\n[type: general question]"
    new_dream_missing: str = "\n[type: new dream; missing: {missing}]"
    new_dream_complete: str = "\n[type: new dream; complete]"
    profession_note: str = '\n[profession: "{profession}"]'
    knowledge_note: str = '\n[knowledge: "{meaning}"]'


def _fill(template: str, name: str, value: Column) -> Column:
    head, _, tail = template.partition("{" + name + "}")
    return F.concat(F.lit(head), value, F.lit(tail))


def _history_msg(role: str, text: str) -> Column:
    t = F.col(text)
    cut = F.when(F.length(t) > HISTORY_MAX_CHARS, F.concat(F.substring(t, 1, HISTORY_MAX_CHARS), F.lit("...")))
    content = cut.otherwise(t)
    r = F.col(role)
    return F.when(r.isin("user", "ai"),
                  F.struct(F.when(r == "ai", "assistant").otherwise("user").alias("role"),
                           content.alias("content")))


def build_prompts(labelled: DataFrame, tpl: Templates = Templates(), lex: Lexicon | None = None) -> DataFrame:
    """TX4: add ``messages`` array<struct<role, content>> per labelled request.

    system; the last two history turns (user/ai only after the cut, texts over
    500 chars cut to 500 + '...'); then the trimmed text + type directive.
    ``labelled`` comes from ``label_turns`` (+ ``curated_lookup`` for meaning).
    """
    if "meaning" not in labelled.columns:
        labelled = labelled.withColumn("meaning", F.lit(None).cast("string"))
    prof = F.coalesce(_fill(tpl.profession_note, "profession", F.col("known_profession")), F.lit(""))
    know = F.coalesce(_fill(tpl.knowledge_note, "meaning", F.col("meaning")), F.lit(""))
    joiner = lex.joiner if lex is not None else " and "
    missing = F.array_join(F.col("missing"), joiner)
    it = F.col("input_type")
    directive = (F.when(it == "context_answer", F.concat(F.lit(tpl.context_answer), prof, know))
                  .when(it == "general_question", F.lit(tpl.general))
                  .when(F.size("missing") > 0,
                        F.concat(_fill(tpl.new_dream_missing, "missing", missing), prof, know))
                  .otherwise(F.concat(F.lit(tpl.new_dream_complete), prof, know)))
    user_msg = F.struct(F.lit("user").alias("role"), F.concat(F.col("trimmed"), directive).alias("content"))
    sys_msg = F.struct(F.lit("system").alias("role"), F.lit(tpl.system).alias("content"))
    msgs = F.filter(F.array(sys_msg, _history_msg("p2_role", "p2_text"), _history_msg("p1_role", "p1_text"),
                            user_msg), lambda m: m.isNotNull())
    return labelled.withColumn("messages", msgs)


# ------------------------------------------------------------------ PF9

def validate_messages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """PF9 (messages): reason = missing / too_short (trimmed < 2) / too_long (raw > 6000) / NULL."""
    t = F.col(text_col)
    return df.withColumn("reason", F.when(t.isNull(), "missing")
                                    .when(F.length(js_trim(t)) < MIN_MESSAGE_CHARS, "too_short")
                                    .when(F.length(t) > MAX_MESSAGE_CHARS, "too_long"))


# ------------------------------------------------------------------ TX5, TX6

def select_answer(responses: DataFrame, key: str = "exchange_id") -> DataFrame:
    """TX5: final answer per exchange: synthesis, else primary, else secondary (trimmed).

    An empty synthesis falls back (JS ``if (!cleanText)``); a present primary is
    used even when empty, as the application does.

    ``responses`` has (key, source, text, seq); several texts of one source
    resolve to the latest ``seq``.  Exchanges with no usable text give no row.
    """
    def pick(src: str) -> Column:
        return F.max_by(F.when(F.col("source") == src, F.col("text")),
                        F.when(F.col("source") == src, F.col("seq")))
    g = responses.groupBy(key).agg(pick("synthesis").alias("_s"), pick("primary").alias("_p"),
                                   pick("secondary").alias("_q"))
    s = js_trim(F.col("_s"))
    s = F.when(s != "", s)
    ans = F.coalesce(s, js_trim(F.col("_p")), js_trim(F.col("_q")))
    src = (F.when(s.isNotNull(), "synthesis").when(F.col("_p").isNotNull(), "primary")
            .when(F.col("_q").isNotNull(), "secondary"))
    return g.where(F.coalesce("_s", "_p", "_q").isNotNull()).select(key, ans.alias("answer"),
                                                                   src.alias("answer_source"))


def synthesis_input(responses: DataFrame, texts: DataFrame, key: str = "exchange_id",
                    template: str = SYNTHESIS_TEMPLATE) -> DataFrame:
    """TX5: (key, content), the synthesis message of each exchange with two answers.

    ``texts`` has (key, text), a row per exchange, with the user's text, which
    is trimmed; the answers stand as given, the latest of each source.
    ``template`` has the places {text}, {first} and {second}; it is cut at them
    before they are filled, so braces inside the texts mean nothing.  An
    exchange with one answer only, or without a text, needs no synthesis and
    gives no row.
    """
    g = responses.where(F.col("source").isin("primary", "secondary")).groupBy(key).agg(*[
        F.max_by(F.when(F.col("source") == s, F.col("text")), F.when(F.col("source") == s, F.col("seq"))).alias(c)
        for s, c in (("primary", "_p"), ("secondary", "_q"))])
    both = (g.where(F.col("_p").isNotNull() & F.col("_q").isNotNull())
             .join(texts.where(F.col("text").isNotNull()).select(key, js_trim("text").alias("_t")), key))
    fill = {"text": F.col("_t"), "first": F.col("_p"), "second": F.col("_q")}
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] + ([fill[name]] if name else [])
    return both.select(key, F.concat(*parts).alias("content"))


def knowledge_block(topk: DataFrame, query_key: str = "query_id", prefix: str = "\n[",
                    suffix: str = "]", label: str = SOURCE_LABEL) -> DataFrame:
    """TX6: per query, '[<label> i]: content' for the ranked chunks, joined by a blank line.

    Grouping collects at most k rows per query (k-bounded by the top-k input).
    """
    g = topk.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: F.concat(F.lit(f"[{label} "), x["rank"].cast("string"),
                                                             F.lit("]: "), x["content"])), "\n\n")
    return g.select(query_key, F.when(F.size("xs") > 0, F.concat(F.lit(prefix), body, F.lit(suffix)))
                    .otherwise(F.lit("")).alias("block"))


# ------------------------------------------------------------------ WN1-WN3

def recent_sessions(sessions: DataFrame, msgs: DataFrame, n: int = 50) -> DataFrame:
    """WN1: newest n sessions per user that have at least one message.

    ``row_number() <= n`` is planned as WindowGroupLimit, which also runs
    before the shuffle, so a user with millions of sessions ships at most n
    rows per map partition.
    """
    from pyspark.sql import Window
    s = sessions.join(msgs.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi")
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recent_accounts(logins: DataFrame, n: int = 5) -> DataFrame:
    """WN2: per device the newest n distinct accounts (by email), latest login wins."""
    from pyspark.sql import Window
    latest = (logins.where(F.col("email").isNotNull())
                    .groupBy("device", "email").agg(F.max("ts").alias("ts")))
    w = Window.partitionBy("device").orderBy(F.col("ts").desc(), F.col("email"))
    return latest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def session_titles(turns: DataFrame, n: int = 40, ellipsis: str = "…") -> DataFrame:
    """WN3: title = first user message, first n chars + ellipsis if longer (aggregate, no window)."""
    first = (turns.where(F.col("role") == "user").groupBy("conv_id")
                  .agg(F.min_by("text", "turn").alias("first_text")))
    t = F.col("first_text")
    return first.select("conv_id", F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(ellipsis)))
                        .otherwise(t).alias("title"))


def rename_title(title: Column | str, n: int = 60) -> Column:
    """WN3 (rename): trimmed, cut to n chars."""
    return F.substring(js_trim(col_(title)), 1, n)
