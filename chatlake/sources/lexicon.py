"""Dictionaries for text labelling (SC2): keyword lists, hint lists, markers.

Dictionaries are data: an ordered list of (category, [keywords]) pairs whose
order is the semantics (first category, then first keyword, wins).  They are
turned into a small DataFrame or a literal array by ``chatlake.operators.text``.

Two sets are provided: the application's Bengali lists (used by unit tests and
by real chat text) and a Latin fixture set for the synthetic test corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# The application's Bengali dictionaries, in their natural order.
# Keywords are matched as exact substrings, without lower-casing; several end in
# a space on purpose ('বর ', 'মা ', 'বস ').
# ---------------------------------------------------------------------------
DREAM_CATEGORIES: list[tuple[str, list[str]]] = [
    ("সাপ", ["সাপ"]),
    ("দাঁত পড়া", ["দাঁত পড়ে", "দাঁত পড়ছে", "দাঁত ভেঙে", "দাঁত খুলে"]),
    ("পরীক্ষা", ["পরীক্ষা"]),
    ("বিয়ে", ["বিয়ে", "বিবাহ", "বর ", "কনে"]),
    ("সন্তান/গর্ভাবস্থা", ["সন্তান", "বাচ্চা", "গর্ভবতী", "গর্ভাবস্থা", "প্রসব"]),
    ("মৃত ব্যক্তি", ["মৃত বাবা", "মৃত মা", "মৃত আত্মীয়", "মারা যাওয়া"]),
    ("মৃত্যু", ["মৃত্যু", "মরে গেছি", "মারা যাচ্ছি", "মারা গেলাম", "খুন"]),
    ("পড়ে যাওয়া", ["পড়ে যাচ্ছি", "পড়ে গেলাম", "পতন হচ্ছে"]),
    ("উড়া", ["উড়ছি", "উড়ে যাচ্ছি", "আকাশে ভাসছি", "উড়ে বেড়া"]),
    ("তাড়া করা", ["তাড়া করছে", "তাড়া করে", "পিছু নিয়েছে", "ধাওয়া"]),
    ("দুর্ঘটনা", ["দুর্ঘটনা", "এক্সিডেন্ট"]),
    ("আগুন", ["আগুন"]),
    ("পানি/বন্যা", ["পানি", "বন্যা", "নদী", "সাগর", "সমুদ্র", "ডুবে", "ডুবছি", "পুকুর", "লেক"]),
    ("ভূত/অতিপ্রাকৃত", ["ভূত", "প্রেতাত্মা", "অতিপ্রাকৃত", "জ্বিন"]),
    ("দেব-দেবী", ["দেবতা", "দেবী", "ভগবান", "ঈশ্বর", "আল্লাহ", "খোদা", "প্রভু"]),
    ("রোগ", ["জ্বর", "ক্যান্সার", "কাশি", "অসুস্থ", "অসুখ", "রোগ"]),
    ("ইউনিভার্স", ["চাঁদ", "সূর্য", "নক্ষত্র", "তারা", "মহাকাশ", "গ্রহ"]),
    ("পশু", ["গরু", "ছাগল", "কুকুর", "বিড়াল", "বাঘ", "সিংহ", "হাতি", "ঘোড়া", "ভেড়া", "বানর"]),
    ("পাখি", ["কাক", "কবুতর", "ময়না", "টিয়া", "মুরগি", "ঈগল", "পেঁচা"]),
    ("ভ্রমণ", ["ভ্রমণ", "ট্রেন", "বিমান", "জাহাজ"]),
    ("অর্থ/সম্পদ", ["টাকা", "অর্থ", "সোনা", "ধনী", "সম্পদ"]),
    ("প্রেম/সম্পর্ক", ["প্রেম", "ভালোবাসা", "প্রেমিক", "প্রেমিকা"]),
    ("পরিবার/আত্মীয়", ["মা ", "বাবা", "ভাই", "বোন", "স্ত্রী", "স্বামী", "পরিবার", "আত্মীয়"]),
    ("চাকরি/কর্মক্ষেত্র", ["চাকরি", "অফিস", "বস ", "কর্মক্ষেত্র"]),
    ("ঘর/বাড়ি", ["বাড়ি", "ঘর", "বাসা"]),
]

GENERAL_CATEGORIES: list[tuple[str, list[str]]] = [
    ("প্রোগ্রামিং/কোডিং", ["কোড", "কোডিং", "প্রোগ্রামিং", "python", "java", "c++", "javascript", "html", "css",
                          "sql", "ফাংশন", "ভ্যারিয়েবল", "script", "বাগ", "debug", "api", "অ্যালগরিদম",
                          "সফটওয়্যার", "অ্যাপ বানা", "ওয়েবসাইট বানা"]),
    ("অনুবাদ", ["অনুবাদ", "translate", "ইংরেজি করো", "বাংলা করো", "ইংরেজিতে বলো"]),
    ("পড়াশোনা/হোমওয়ার্ক", ["হোমওয়ার্ক", "অ্যাসাইনমেন্ট", "রচনা লেখো", "প্রবন্ধ", "অংক", "ম্যাথ", "সমাধান করো",
                            "পরীক্ষার প্রস্তুতি", "সিলেবাস"]),
    ("সাধারণ জ্ঞান", ["রাজধানী", "ইতিহাস", "বিজ্ঞান কী", "কত সালে", "কে আবিষ্কার", "সংজ্ঞা কী", "অর্থ কী"]),
    ("স্বাস্থ্য পরামর্শ", ["স্বাস্থ্য", "চিকিৎসা", "ডাক্তার দেখা", "ঔষধ", "medicine", "লক্ষণ"]),
    ("জীবন/ক্যারিয়ার পরামর্শ", ["পরামর্শ দিন", "উপদেশ", "সাজেশন দিন", "কী করব", "ক্যারিয়ার", "চাকরি খুঁজ"]),
    ("পরিচয়/সম্পর্কে", ["তুমি কে", "আপনি কে", "তোমার নাম", "কে বানিয়েছে", "কে তৈরি করেছে"]),
]

DEFAULT_CATEGORY = "অন্যান্য"
NEW_CHAT_TITLE = "নতুন চ্যাট"

LOCATION_HINTS = ["বাসা", "বাড়ি", "ঘর", "রাস্তা", "অফিস", "স্কুল", "কলেজ", "মাঠ", "জঙ্গল", "বন", "পানি", "নদী",
                  "তীর", "পুকুর", "লেক", "সাগর", "সমুদ্র", "দ্বীপ", "বাইরে", "গ্রাম", "শহর", "ছাদ", "বাজার",
                  "হাসপাতাল", "মন্দির", "মসজিদ", "পাহাড়", "আকাশ", "ট্রেন", "বাস", "স্টেশন", "দোকান", "পার্ক",
                  "বিয়েবাড়ি", "অনুষ্ঠান"]
EMOTION_HINTS = ["ভয়", "ভীত", "আনন্দ", "খুশি", "দুঃখ", "কষ্ট", "উদ্বেগ", "আতঙ্ক", "স্বস্তি", "রাগ", "অবাক",
                 "বিস্মিত", "শান্তি", "ভালোলাগা", "খারাপ লাগা", "কান্না", "হাসি", "চিন্তিত"]
PROFESSION_HINTS = ["ছাত্র", "ছাত্রী", "শিক্ষার্থী", "চাকরি", "কৃষক", "ব্যবসা", "শিক্ষক", "শিক্ষিকা", "ডাক্তার",
                    "ইঞ্জিনিয়ার", "গৃহিণী", "ব্যবসায়ী", "কর্মচারী", "পুলিশ", "সৈনিক", "আইনজীবী", "নার্স",
                    "ড্রাইভার", "দোকানদার", "প্রবাসী", "বেকার", "অবসরপ্রাপ্ত", "ফ্রিল্যান্সার", "কৃষিকাজ",
                    "ব্যাংকার", "অফিসার", "কর্মজীবী"]
NEW_DREAM_MARKERS = ["স্বপ্নে দেখলাম", "স্বপ্ন দেখলাম", "স্বপ্নে দেখি", "স্বপ্ন দেখি", "আমি দেখলাম যে",
                     "স্বপ্নটা ছিল", "স্বপ্নে আমি"]
CONTEXT_MARKER = "প্রাসঙ্গিক প্রশ্ন"
# Labels of the missing-context items and the word joining them.
MISSING_LOCATION = "স্থান (স্বপ্নটি কোথায় ঘটেছিল)"
MISSING_EMOTION = "তখনকার মানসিক অনুভূতি (ভয়/আনন্দ/উদ্বেগ ইত্যাদি)"
MISSING_LIFE = "জীবন-প্রেক্ষাপট (তিনি ছাত্র/কৃষক/চাকরিজীবী/ব্যবসায়ী ইত্যাদি কিনা)"
MISSING_JOINER = " এবং "
SOURCE_LABEL = "সূত্র"
# Limits of the chat request checks.
MIN_MESSAGE_CHARS = 2
MAX_MESSAGE_CHARS = 6000
MIN_KNOWLEDGE_CHARS = 20
MAX_KNOWLEDGE_CHARS = 200_000
CONTEXT_ANSWER_MAX_WORDS = 25
HISTORY_TURNS = 2
HISTORY_MAX_CHARS = 500


@dataclass(frozen=True)
class Lexicon:
    """Every list the labelling operators take; all are parameters."""
    categories: list[tuple[str, list[str]]]
    default_category: str
    location_hints: list[str]
    emotion_hints: list[str]
    profession_hints: list[str]
    dream_markers: list[str]
    context_marker: str
    missing_location: str = MISSING_LOCATION
    missing_emotion: str = MISSING_EMOTION
    missing_life: str = MISSING_LIFE
    joiner: str = MISSING_JOINER
    no_category_title: str = NEW_CHAT_TITLE
    extra: dict = field(default_factory=dict)

    def keyword_rows(self) -> list[tuple[int, str, int, str]]:
        """(cat_rank, category, kw_rank, keyword) in match order."""
        return [(ci + 1, cat, ki + 1, kw) for ci, (cat, kws) in enumerate(self.categories)
                for ki, kw in enumerate(kws)]


BENGALI = Lexicon(
    categories=DREAM_CATEGORIES + GENERAL_CATEGORIES,
    default_category=DEFAULT_CATEGORY,
    location_hints=LOCATION_HINTS, emotion_hints=EMOTION_HINTS, profession_hints=PROFESSION_HINTS,
    dream_markers=NEW_DREAM_MARKERS, context_marker=CONTEXT_MARKER,
)

# Fixture dictionary for the synthetic (Latin-script) corpus.  'und ' ends in a
# space (entity is trimmed) and 'reaux' is shadowed by the earlier 'eaux'.
LATIN = Lexicon(
    categories=[("d_nature", ["ich", "und "]), ("d_fire", ["ción"]), ("d_road", ["eaux", "éa"]),
                ("d_house", ["there"]), ("d_code", ["token"]), ("g_code", ["reaux"]),
                ("g_life", ["nation"]), ("g_misc", ["house"])],
    default_category="other",
    location_hints=["eau", "ung"], emotion_hints=["que", "mente"],
    profession_hints=["ung", "lich", "than"],
    dream_markers=["nicht", "Than", "ción"], context_marker="lich",
    missing_location="place", missing_emotion="feeling", missing_life="life", joiner=" and ",
    no_category_title="new chat",
)

# Curated meanings for the Latin fixture: (category, entity or None for the
# category's general text, meaning).  Duplicate keys: the later row wins.
LATIN_CURATED = [
    ("d_nature", None, "nature in general"),
    ("d_nature", "ich", "first ich meaning"),
    ("d_nature", "und", "und meaning"),
    ("d_nature", "ich", "ich meaning"),
    ("d_road", None, ""),
    ("d_road", "eaux", "eaux meaning"),
    ("d_road", "éa", ""),
    ("d_fire", None, "fire in general"),
    ("d_house", "there", "never used: d_house is not in the registry"),
]
LATIN_REGISTRY = ["d_nature", "d_road", "d_fire"]


# ---------------------------------------------------------------------------
# File loaders (SC2, SC3): dictionaries are data; order in the file is meaning.
# ---------------------------------------------------------------------------

def _ordered_json_lines(spark, path: str, schema: str):
    """Read JSON lines keeping file order in ``line_no`` (0, 1, ...), however many files and splits there are.

    A line's place is (file, split, place in the split).  Spark packs splits into partitions in an order of its
    own, so lines are numbered from the counts of the splits before theirs: one small row for each split.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    raw = (spark.read.text(path).where(F.trim("value") != "")
           .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                   F.monotonically_increasing_id().alias("id")))
    splits = raw.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (raw.join(splits, ["file", "split"])
            .select((F.col("before") + F.col("id") - F.col("first")).alias("line_no"), F.from_json("value", schema).alias("r"))
            .select("line_no", "r.*"))


def load_keywords(spark, path: str):
    """SC2: keyword dictionary from JSON lines {"category": ..., "keywords": [...]}, in order.

    Returns (cat_rank, category, kw_rank, keyword) — the frame ``classify``'s
    join and automaton methods and ``keyword_frame`` use.
    """
    from pyspark.sql import functions as F
    rows = _ordered_json_lines(spark, path, "category string, keywords array<string>")
    return rows.select((F.col("line_no") + 1).cast("int").alias("cat_rank"), "category",
                       F.posexplode("keywords").alias("kw_pos", "keyword")) \
               .select("cat_rank", "category", (F.col("kw_pos") + 1).alias("kw_rank"), "keyword")


def write_json_lines(rows, path: str, order: str, fields: list[str]) -> None:
    """Write a dictionary's ``fields`` as JSON lines in the order of a column, in files whose names keep it."""
    from pyspark.sql import functions as F
    (rows.repartitionByRange(order).sortWithinPartitions(order)
     .select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).write.text(path))


def lexicon_from_frame(frame, base: Lexicon) -> Lexicon:
    """A Lexicon whose ordered categories come from a (small) keyword frame."""
    from dataclasses import replace
    cats: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for r in frame.collect():      # dictionary-sized (a few hundred rows), read once on the driver
        cats.setdefault((r["cat_rank"], r["category"]), []).append((r["kw_rank"], r["keyword"]))
    ordered = [(c, [k for _, k in sorted(v)]) for (_, c), v in sorted(cats.items())]
    return replace(base, categories=ordered)


def load_curated(spark, path: str):
    """SC3: curated meanings from JSON lines {"category", "entity" (null = general), "meaning"}.

    Returns (line_no, category, entity, meaning) for ``curated_lookup``,
    which resolves duplicate keys by the later line.
    """
    return _ordered_json_lines(spark, path, "category string, entity string, meaning string")
