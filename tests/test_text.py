"""Text labelling semantics: first-match order, shadowed keywords, JS whitespace, prompts."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlake.functions.semantics import js_trim, js_word_count
from chatlake.operators import keyword_scan as A
from chatlake.operators import text as X
from chatlake.sources import tables as T
from chatlake.sources.lexicon import BENGALI, LATIN
from fixture_paths import SF01, SF1


def _classify(spark, texts, lex=BENGALI, method="literal"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = X.classify(df, "text", lex, key_cols=["id"], method=method).orderBy("id")
    return [(r["category"], r["entity"]) for r in out.collect()]


def _py_classify(text, lex):
    for cat, kws in lex.categories:
        for k in kws:
            if k in text:
                return cat, k.strip()
    return lex.default_category, None


def test_shadowed_keywords_bengali(spark):
    cases = {
        "আমি প্রেমিকা দেখলাম": ("প্রেম/সম্পর্ক", "প্রেম"),
        "কোডিং শিখতে চাই": ("প্রোগ্রামিং/কোডিং", "কোড"),
        "প্রোগ্রামিং শিখব": ("রোগ", "রোগ"),
        "javascript help": ("প্রোগ্রামিং/কোডিং", "java"),
        "পরীক্ষার প্রস্তুতি নিচ্ছি": ("পরীক্ষা", "পরীক্ষা"),
        "এর অর্থ কী": ("অর্থ/সম্পদ", "অর্থ"),
        "চাকরি খুঁজছি": ("চাকরি/কর্মক্ষেত্র", "চাকরি"),
        "কিছুই না": ("অন্যান্য", None),
    }
    got = _classify(spark, list(cases))
    assert got == list(cases.values())


def test_trailing_space_keywords_and_case(spark):
    # 'বর ' ends in a space: at the very end of the text it cannot match; entity is trimmed.
    texts = ["সে বর", "সে বর এল", "মা", "মা এল", "Python code", "PYTHON"]
    got = _classify(spark, texts)
    assert got == [_py_classify(t, BENGALI) for t in texts]
    assert got[1] == ("বিয়ে", "বর")
    assert got[5] == ("অন্যান্য", None)  # case-sensitive


def test_precomposed_letters_do_not_match(spark):
    decomposed = "\u0998\u09cb\u09a1\u09bc\u09be"   # keyword spelling: DDA + NUKTA
    precomposed = "\u0998\u09cb\u09dc\u09be"        # RRA (U+09DC): no exact match
    assert decomposed in BENGALI.categories[17][1]
    got = _classify(spark, [decomposed, precomposed])
    assert got[0] == ("পশু", decomposed)
    assert got[1] == ("অন্যান্য", None)


def test_join_method_equals_literal(spark):
    docs = T.load(spark, SF01, "documents").select(F.col("doc_id").alias("id"), "text")
    a = X.classify(docs, "text", LATIN, ["id"], method="literal").select("id", "category", "entity")
    b = X.classify(docs, "text", LATIN, ["id"], method="join").select("id", "category", "entity")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_automaton_method_equals_literal(spark):
    docs = T.load(spark, SF01, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("row"), F.lit("k").alias("keyword"))
    docs = docs.union(spark.createDataFrame([(None, None, 1, "k"), (-1, "", 1, "k"), (-1, "", 1, "k")], docs.schema))
    a = X.classify(docs, "text", LATIN, method="literal")
    b = X.classify(docs, "text", LATIN, method="automaton")
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_label_turns_by_automaton_equals_literal(spark):
    turns = T.chat_turns(spark, SF01)
    a, b = X.label_turns(turns, LATIN), X.label_turns(turns, LATIN, method="automaton")
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_automaton_equals_first_contained(monkeypatch):
    """Also with few full rows, short lanes, empty and repeated keywords, and keywords inside others."""
    rng = random.Random(1)
    for dense, lane in ((16_384, 1024), (5, 3), (1, 1)):
        monkeypatch.setattr(A, "DENSE", dense)
        monkeypatch.setattr(A, "LANE", lane)
        for turn in range(30):
            words = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 40))]
            words += words[:1] + ([""] if turn % 10 == 0 else [])
            texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(60))) for _ in range(30)] + [None, ""]
            want = [next((i for i, w in enumerate(words) if x is not None and w in x), A.NO_HIT) for x in texts]
            assert A.Automaton(words).first_ranks(pa.array(texts)).tolist() == want
    assert A.Automaton([]).first_ranks(pa.array(["x", None])).tolist() == [A.NO_HIT] * 2


@pytest.mark.parametrize("max_keywords", [1 << 20, 40_000])
def test_hundred_thousand_keywords_without_a_join(spark, max_keywords):
    """Over sf0.1, in one pass and in several."""
    docs = T.load(spark, SF1, "documents").select("doc_id", "text")
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100_000)]
    rows = [(i // 1000, f"c{i // 1000}", i % 1000, w) for i, w in enumerate([*made[:50_000], "eronth", *made[50_000:], "and", "que"])]
    frame = spark.createDataFrame(rows, "cat_rank int, category string, kw_rank int, keyword string")
    got = X.classify_by_table(docs, "text", frame, "other", max_keywords=max_keywords)
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
    rank = {}
    for i, (_, c, _, w) in enumerate(rows):
        rank.setdefault(w, (i, c))
    for r in got.where(F.xxhash64("doc_id") % 400 == 0).select("doc_id", "category", "entity", "text").collect():
        want = min((rank[w] + (w,) for n in (3, 6) for w in {r["text"][j:j + n] for j in range(len(r["text"]))} if w in rank),
                   default=(None, "other", None)) if r["text"] else (None, "other", None)
        assert (r["category"], r["entity"]) == want[1:]


def test_fixture_first_match_counts(spark):
    docs = T.load(spark, SF01, "documents")
    c = {r["category"]: r["count"] for r in X.classify(docs, "text", LATIN).groupBy("category").count().collect()}
    assert c == {"d_nature": 346, "d_fire": 102, "d_road": 35, "d_house": 149, "d_code": 2, "other": 366}
    turns = T.chat_turns(spark, SF01)
    c = {r["category"]: r["count"] for r in X.classify(turns, "text", LATIN).groupBy("category").count().collect()}
    assert c == {"d_nature": 97, "d_fire": 39, "d_road": 20, "d_house": 43, "other": 337}


def test_js_whitespace_trim_and_words(spark):
    rows = [("  a b　c ﻿",), ("",), ("x y",), ("​z",)]
    df = spark.createDataFrame(rows, "s string")
    out = df.select(js_trim("s").alias("t")).select("t", js_word_count("t").alias("n")).collect()
    assert [(r["t"], r["n"]) for r in out] == [("a b　c", 3), ("", 1), ("x y", 2), ("​z", 1)]


def test_label_turns_history_rules(spark):
    lex = LATIN
    turns = spark.createDataFrame([
        (1, 0, "user", "I am a than-person"),        # profession hint 'than'
        (1, 1, "ai", "see lich question"),           # context marker
        (1, 2, "user", "short answer"),              # context_answer, profession from turn 0
        (2, 0, "system", "sys"),
        (2, 1, "ai", "lich"),
        (2, 2, "user", "x" * 3 + " nicht"),          # marker → new_dream even though context asked
        (2, 3, "ai", "nothing"),
        (2, 4, "user", "plain text here"),           # marker 3 turns back: not asked
    ], "conv_id long, turn long, role string, text string")
    lab = {(r["conv_id"], r["turn"]): r for r in X.label_turns(turns, lex).collect()}
    assert lab[(1, 2)]["context_asked"] and lab[(1, 2)]["input_type"] == "context_answer"
    assert lab[(1, 2)]["known_profession"] == "than"
    assert lab[(1, 0)]["known_profession"] == "than"
    assert lab[(2, 2)]["input_type"] == "new_dream" and lab[(2, 2)]["context_asked"]
    assert not lab[(2, 4)]["context_asked"] and lab[(2, 4)]["input_type"] == "general_question"
    # new dream with context asked: no life item
    assert lab[(2, 2)]["missing"] == ["place", "feeling"]


def test_prompt_history_cut_and_roles(spark):
    turns = spark.createDataFrame([
        (1, 0, "system", "s"), (1, 1, "ai", "a" * 600), (1, 2, "user", "  hello  ")],
        "conv_id long, turn long, role string, text string")
    lab = X.label_turns(turns, LATIN)
    msgs = X.build_prompts(lab, X.Templates(system="SYS"), LATIN).first()["messages"]
    assert [m["role"] for m in msgs] == ["system", "assistant", "user"]   # system turn dropped after the cut
    assert msgs[1]["content"] == "a" * 500 + "..."
    assert msgs[2]["content"].startswith("hello\n[type: general question]")


def test_optional_normalisation_matches_precomposed(spark):
    precomposed = "\u0998\u09cb\u09dc\u09be"        # RRA (U+09DC)
    df = spark.createDataFrame([(0, precomposed)], "id long, text string")
    faithful = X.classify(df, "text", BENGALI).first()
    norm = X.classify(df, "text", BENGALI, normalize=True).first()
    assert faithful["category"] == "অন্যান্য"
    assert norm["category"] == "পশু" and norm["text"] == precomposed     # text column itself is untouched


def test_dictionary_files_keep_order(spark):
    import json
    import tempfile
    d = tempfile.mkdtemp(prefix="chatlake-dict-")
    with open(f"{d}/kw.jsonl", "w") as f:
        for cat, kws in LATIN.categories:
            f.write(json.dumps({"category": cat, "keywords": kws}) + "\n")
    from chatlake.sources.lexicon import lexicon_from_frame, load_curated, load_keywords
    from chatlake.sources.lexicon import LATIN_CURATED, LATIN_REGISTRY
    frame = load_keywords(spark, f"{d}/kw.jsonl")
    assert [tuple(r) for r in frame.orderBy("cat_rank", "kw_rank").collect()] == LATIN.keyword_rows()
    assert lexicon_from_frame(frame, LATIN).categories == LATIN.categories
    with open(f"{d}/cur.jsonl", "w") as f:
        for c, e, m in LATIN_CURATED:
            f.write(json.dumps({"category": c, "entity": e, "meaning": m}) + "\n")
    cur = load_curated(spark, f"{d}/cur.jsonl")
    lab = spark.createDataFrame([("d_nature", "ich", "new_dream"), ("d_road", "éa", "new_dream"),
                                 ("d_house", "there", "new_dream"), ("d_nature", "ich", "general_question")],
                                "category string, entity string, input_type string")
    got = [r["meaning"] for r in X.curated_lookup(lab, cur, LATIN_REGISTRY).collect()]
    assert sorted(got, key=str) == sorted(["ich meaning", None, None, None], key=str)


def test_rename_title_trims_and_cuts(spark):
    df = spark.createDataFrame([("　 " + "x" * 70 + " ",), ("  short  ",)], "t string")
    got = [r["r"] for r in df.select(X.rename_title("t").alias("r")).collect()]
    assert got == ["x" * 60, "short"]


def test_synthesis_input(spark):
    """Two answers are needed, the latest of each counts, and braces in texts stay as they are."""
    r = spark.createDataFrame([
        (1, "primary", "old", 0), (1, "primary", "one {second}", 2), (1, "secondary", "two", 1),
        (2, "primary", "alone", 0), (2, "synthesis", "s", 1),
        (3, "primary", "", 0), (3, "secondary", "q", 0),
        (4, "primary", "p", 0), (4, "secondary", "q", 0),
        (5, "primary", "p", 0), (5, "secondary", "q", 0)],
        "exchange_id long, source string, text string, seq int")
    texts = spark.createDataFrame([(1, "  hi {first} "), (2, "x"), (3, "y"), (4, None)], "exchange_id long, text string")
    got = {x["exchange_id"]: x["content"] for x in
           X.synthesis_input(r, texts, template="{text}|{first}|{second}|{{end}}").collect()}
    assert got == {1: "hi {first}|one {second}|two|{end}", 3: "y||q|{end}"}
    assert X.synthesis_input(r.limit(0), texts).count() == 0


def test_dictionary_files_keep_order_over_splits(spark, tmp_path):
    """Several files, each in many splits: lines are numbered in the order of names and places."""
    from chatlake.sources.lexicon import load_keywords, write_json_lines
    rows = [(i, f"c{i:04d}", [f"k{i}a", f"k{i}b"]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "place int, category string, keywords array<string>")
    path = str(tmp_path / "kw")
    write_json_lines(frame, path, "place", ["category", "keywords"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = load_keywords(spark, path).orderBy("cat_rank", "kw_rank").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["cat_rank"], r["category"], r["kw_rank"], r["keyword"]) for r in got] == \
        [(i + 1, c, j + 1, k) for i, c, ks in rows for j, k in enumerate(ks)]
