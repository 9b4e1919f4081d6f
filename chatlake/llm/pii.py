"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of four kinds.  Boosted trees
learn which of them are right from format and context alone: what the base rules
require literally (the plus of a phone number, the check digit of a card, the
at sign) is hidden from them.  Right in all documents are the base spans; wrong are candidates known to be something else (``something_else``: dates, named
numbers, wrong lengths, parts of longer numbers, spans of another kind).  Other
candidates look alike and are not labelled.  Every labelled candidate of every
document is learnt from.  Fixed written examples of either sort join them, with a
tenth of each kind's weight at least, so no kind lacks labels in any input and no
table drowns the formats that the base rules cannot label.

On a held-out third each kind's threshold is the least probability, in
thousandths, with the wanted precision, ``LEAST_CUT`` at least, and ``FALLBACK_CUT`` where no probability has
that precision.  Candidates above it that are nothing else are added, cards only
with a right check digit.  Base spans always stay; an added span overlaps no
other of its kind, and no span of a kind before it.

Every search is linear in the text: maximal runs are found first and examined
once, so long digit or letter runs cost no retries.  A run may hold several
numbers: each window of its digit groups with a number's digits is a candidate.

Defined results: a null or empty text has no spans; spans are code points, end
exclusive; of overlapping candidates the more probable, then the earlier, then
the longer stays; without documents the written examples alone are learnt;
repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.boosting import Boosted, fit_kinds
from chatlake.session import checkpoint_dir

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: Labelled candidates that a task gives out at once.
OUT_ROWS = 10_000
PRECISION = 0.97
LEAST_HELD_OUT = 20
LEAST_CUT, FALLBACK_CUT = 0.5, 0.9
#: Written examples of each format.
EXAMPLES = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9][0-9.]*")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: High recall: any run of digits with phone or card punctuation, dotted groups, and spelled-out addresses.
_DIGITS = re.compile(r"\+?\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,}")
_GROUP = re.compile(r"[0-9]+")
#: Digits of a window over a run's groups; with the linear search of runs, at most 20 windows begin at a group.
LEAST_DIGITS, MOST_DIGITS = 7, 20
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:[.:,][0-9]{1,4}){2,7}")
_SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}(?:@|[\x20]?[\[(](?:at|AT)[\])][\x20]?|[\x20]at[\x20])"
                      r"[\w-]{1,64}(?:(?:\.|[\x20]?[\[(](?:dot|DOT)[\])][\x20]?|[\x20]dot[\x20])[\w-]{1,64}){1,4}")
_HAS_AT = re.compile(r"@|[\[(](?:at|AT)[\])]|[\x20]dot[\x20]")
#: Context words, as fixed values.
_HINTS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
          "card": ("card", "visa", "payment", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax")}

#: What makes a candidate something else.
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])"
                   r"|(?:0?[1-9]|[12][0-9]|3[01])([-/.])(?:0?[1-9]|[12][0-9]|3[01])\2(?:19|20)[0-9]{2})(?![0-9])")
_NAMED = re.compile(r"(?:(?<![^\W_])(?:order|invoice|version|release|build|isbn|issn|ticket|serial|sku|ref|id|no|nr|v)"
                    r"|#)[\x20.:#=\"'-]*$", re.IGNORECASE)

#: A plus and a country's digits before the rest of a number.
_PLUS = re.compile(r"\+(?:\(?[0-9]{1,3}\)?[\x20.-]{0,2})?$")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join([c for c in text if c in "0123456789"])


def base_emails(text: str) -> list[Span]:
    """Each at sign with its run of local characters and a dotted domain."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1) if at > done and text[at - 1] in _LOCAL else None
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = base_emails(text)
    for run in _NUMBERS.finditer(text):
        if run[0].count(".") >= 3:
            for m in _QUAD.finditer(text, run.start(), run.end()):
                # int() of a part is only taken for parts of ordinary length
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    found["ip"].append(m.span())
    for m in _CHAIN.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def _windows(text: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of consecutive digit groups of a run that hold as many digits as a number may."""
    groups = [m.span() for m in _GROUP.finditer(text, a, b)]
    for i, (start, _) in enumerate(groups):
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > MOST_DIGITS:
                break
            if n >= LEAST_DIGITS:
                yield start, groups[j][1], n


def candidates(text: str) -> Iterator[tuple[int, Span]]:
    """(kind, span): overlapping proposals of the generators."""
    for m in _DIGITS.finditer(text):
        for start, end, n in _windows(text, *m.span()):
            lead = start
            while lead > m.start() and text[lead - 1] in "+(":
                lead -= 1
            if lead < start:
                yield 3, (lead, end)
            yield 3, (start, end)
            if n >= 12:
                yield 2, (start, end)
    for m in _DOTTED.finditer(text):
        yield 1, m.span()
    if _HAS_AT.search(text):
        for m in _SPELLED.finditer(text):
            yield 0, m.span()


def something_else(text: str, kind: int, span: Span, found: dict[str, list[Span]]) -> bool:
    """Whether a candidate cannot be of its kind, given the spans already found."""
    a, b = span
    body = text[a:b]
    if kind == 0:
        last = re.split(r"[^\w-]+|\x20", body.rstrip())[-1]
        bare = "@" not in body and not re.search(r"[\[(](?:at|AT)[\])]", body)
        return not (last.isalpha() and 2 <= len(last) <= 24) or bare and not re.search(r"\x20dot\x20|[\[(](?:dot|DOT)[\])]", body)
    if any(_overlaps(found[k], span) for k in KINDS[:kind]):
        return True
    # A part of a word or of a longer number.
    if text[a - 1:a].isalnum() and a or text[b:b + 1].isalnum():
        return True
    tight = "-.,:" if kind == 1 else "-."
    if a > 1 and text[a - 1] in tight and text[a - 2].isdigit() or text[b:b + 1] in tuple(tight) and text[b + 1:b + 2].isdigit():
        return True
    if _DATE.match(text, a, b) or _NAMED.search(text, max(0, a - 24), a):
        return True
    if kind == 1:
        parts = re.split("[.:,]", body)
        return len(parts) != 4 or len({c for c in body if c in ".:,"}) > 1 or any(int(p) > 255 for p in parts)
    n = len(only_digits(body))
    if kind == 2:
        return not 13 <= n <= 19
    if _PLUS.search(text, max(0, a - 8), a):
        return True
    # A bracket opened inside or outside the number alone is half of one.
    return not 7 <= n <= 15 or body.count("(") != body.count(")")


def features(text: str, kind: int, span: Span) -> list[float]:
    """Format and context of a candidate, without what the base rules ask for literally."""
    a, b = span
    body = text[a:b].lstrip("+")
    groups = re.split(r"[^0-9A-Za-z]+", body.strip(".-_() "))
    digits = sum(c.isdigit() for c in body)
    before, after = text[max(0, a - 24):a], text[b:b + 12]
    near = before.lower()
    lengths = [len(g) for g in groups] + [0, 0, 0, 0]
    return [
        len(body), digits, len(groups), lengths[0], lengths[1], lengths[2], lengths[3], max(lengths),
        body.count(" "), body.count("-"), body.count("."), body.count("("), body.count("/"), body.count(":"), body.count(","),
        float(body[:1] == "("), float(ord(body[0]) - 48 if body[:1].isdigit() else -1),
        float(before[-1:] in ("", " ", "\n", "\t")), float(before[-1:].isalpha()), float(before[-1:] in "=:\"'" and before != ""),
        float(after[:1] in ("", " ", "\n", "\t")), float(after[:1].isalpha()), float(after[:1] in ".,;!?" and after != ""),
        *[float(any(h in near for h in _HINTS[k])) for k in KINDS],
        float(near.rstrip().endswith(("=", ":"))), sum(c.isupper() for c in body), sum(c.isalpha() for c in body),
    ]


def labelled(text: str, base: dict[str, list[Span]]) -> Iterator[tuple[int, int, Span]]:
    """(kind, label, span) of the candidates that are known to be right or something else."""
    known = {(i, s) for i, k in enumerate(KINDS) for s in base[k]}
    for k, span in dict.fromkeys(candidates(text)):
        if (k, span) in known or text[span[0] - 1:span[0]] == "+" and (k, (span[0] - 1, span[1])) in known:
            yield k, 1, span
        elif not _overlaps(base[KINDS[k]], span) and something_else(text, k, span, base):
            yield k, 0, span


def examples() -> Iterator[tuple[int, int, list[float]]]:
    """(kind, label, features) of the written examples, the same in every run."""
    rng = random.Random(11)
    n = lambda size: "".join(str(rng.randrange(10)) for _ in range(size))
    local = lambda: f"{rng.randint(2, 9)}{n(2)}"
    byte = lambda: str(rng.randrange(256))
    word = lambda: "".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(2, 8)))
    hints = {0: ("mail ", "contact: ", "write to "), 1: ("ip ", "host ", "server="), 2: ("card ", "visa: ", "paid, credit "),
             3: ("phone: ", "call ", "tel. ")}
    right = {
        0: [lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}(at){word()}.org", lambda: f"{word()} at {word()} dot net",
            lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()}@{word()} dot com", lambda: f"{word()}{n(2)}@{word()}.co.uk"],
        1: [lambda s=s: s.join(byte() for _ in range(4)) for s in (".", ".", ",", ":")],
        2: [lambda s=s, f=f: s.join(n(x) for x in f) for s in (" ", "-", ".")
            for f in ((4, 4, 4, 4), (4, 6, 5), (16,), (4, 4, 4, 4, 3), (13,))],
        3: [lambda: f"+1 ({local()}) {local()}-{n(4)}", lambda: f"({local()}) {local()}-{n(4)}", lambda: f"{local()}-{local()}-{n(4)}",
            lambda: f"{local()}.{local()}.{n(4)}", lambda: f"{local()} {local()} {n(4)}", lambda: f"1-{local()}-{local()}-{n(4)}",
            lambda: f"0{n(2)} {n(4)} {n(4)}", lambda: f"0{n(3)} {n(6)}", lambda: f"+{rng.randint(20, 99)} {n(3)} {n(7)}",
            lambda: f"0{n(2)}/{n(7)}"]}
    wrong = {
        0: [lambda: f"{word()} at {word()}.{word()}"],
        1: [lambda: f"{rng.randint(1, 20)}.{n(1)}.{n(2)}", lambda: f"1{n(1)}:2{n(1)}:3{n(1)}", lambda: f"{rng.randint(1, 12)},{n(3)},{n(3)}",
            lambda: f"{rng.randint(1, 12)},{n(3)},{n(3)},{n(3)}", lambda: ",".join(n(1) for _ in range(rng.randint(3, 8))),
            lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{n(2)}", lambda: ".".join(n(2) for _ in range(rng.randint(5, 8)))],
        2: [lambda: " ".join(n(3) for _ in range(5)), lambda: " ".join(n(2) for _ in range(8)), lambda: " ".join(n(1) for _ in range(16)),
            lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: n(12), lambda: n(20), lambda: f"{n(3)}.{n(3)}.{n(3)}.{n(3)}",
            lambda: f"{n(8)} {n(6)}"],
        3: [lambda: n(rng.randint(7, 15)), lambda: n(rng.randint(7, 15)), lambda: f"20{n(2)}-0{rng.randint(1, 9)}-1{n(1)} 1{n(1)}",
            lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{n(2)}", lambda: " ".join(n(2) for _ in range(rng.randint(4, 7))),
            lambda: " ".join(n(1) for _ in range(rng.randint(7, 12))), lambda: " ".join(n(4) for _ in range(rng.randint(2, 3))),
            lambda: f"{n(4)} {byte()}.{byte()}", lambda: f"{n(4)} ({local()}) {local()}", lambda: f"{n(4)} {local()} {local()}",
            lambda: f"1 ({local()}) {local()}", lambda: f"{local()}-{n(4)} {local()}", lambda: f"{n(3)}.{n(3)}.{n(3)}",
            lambda: f"{local()} {n(4)} {local()}", lambda: f"{local()} {n(4)} {local()} {n(2)}",
            lambda: f"{rng.randint(0, 9999)}.{n(rng.randint(6, 11))}", lambda: f"97{rng.choice('89')}-{n(1)}-{n(2)}-{n(6)}-{n(1)}"]}
    for label, formats in ((1, right), (0, wrong)):
        for k, made in formats.items():
            for make in made:
                for i in range(EXAMPLES):
                    before = rng.choice(("", "and ", "the ", "\n", f"{n(4)} ", hints[k][i % 3] if label else "total "))
                    body, after = make(), rng.choice(("", " today", ".", ", then", f" {n(3)}"))
                    yield k, label, features(before + body + after, k, (len(before), len(before) + len(body)))


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, label, held, feature = [], [], [], []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(label, pa.int32()), pa.array(held, pa.bool_()),
             pa.array(feature, pa.list_(pa.float64()))], names=["kind", "label", "held", "feature"])
        for column in (kind, label, held, feature):
            column.clear()
        return made

    for batch in batches:
        for text, h in zip(batch["text"], batch["key"].to_pylist()):
            text = text.as_py() or ""
            for k, right, span in labelled(text, base_spans(text)):
                kind.append(k)
                label.append(right)
                held.append((h + span[0]) % 3 == 0)
                feature.append(features(text, k, span))
                if len(kind) == OUT_ROWS:
                    yield out()
    yield out()


def fit(docs: DataFrame, id_col: str, text_col: str) -> dict[int, tuple[Boosted, float]]:
    """A model and a calibrated threshold of each kind, from all labelled candidates of all documents."""
    checkpoint_dir(docs.sparkSession)
    known = (docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("pii")).alias("key"))
             .mapInArrow(_known, "kind int, label int, held boolean, feature array<double>").checkpoint(eager=True))
    written: dict[int, tuple[list, list]] = {k: ([], []) for k in range(len(KINDS))}
    for k, label, feature in examples():
        written[k][0].append(feature)
        written[k][1].append(label)
    given = {k: (np.array(x), np.array(y, dtype=float), np.arange(len(y)) % 3 == 0) for k, (x, y) in written.items()}
    models = fit_kinds(known, given, PRECISION, LEAST_HELD_OUT)
    return {k: (model, max(cut, LEAST_CUT) if cut <= 1 else FALLBACK_CUT) for k, (model, cut) in models.items()}


def added(text: str, base: dict[str, list[Span]], models: dict[int, tuple[Boosted, float]]) -> dict[str, list[Span]]:
    """Candidates above their kind's threshold that are nothing else and overlap no span of the kind."""
    proposed = [c for c in dict.fromkeys(candidates(text)) if c[0] in models]
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    all_found = {k: sorted(base[k]) for k in KINDS}
    for k, (model, cut) in sorted(models.items()):
        taken = all_found[KINDS[k]]
        mine = [s for i, s in proposed if i == k and not _overlaps(taken, s) and not something_else(text, k, s, all_found)
                and (k != 2 or luhn(only_digits(text[s[0]:s[1]])))]
        if not mine:
            continue
        p = model.probability(np.array([features(text, k, s) for s in mine]))
        chosen: list[Span] = []
        for i in sorted(np.flatnonzero(p >= cut).tolist(), key=lambda i: (-p[i], mine[i][0], -mine[i][1])):
            if not _overlaps(chosen, mine[i]):
                insort(chosen, mine[i])
        found[KINDS[k]] = chosen
        all_found[KINDS[k]] = sorted(taken + chosen)
    return found


def _overlaps(spans: list[Span], new: Span) -> bool:
    """Whether ``new`` meets one of the sorted, disjoint ``spans``."""
    i = bisect_left(spans, (new[1], -1))
    return i > 0 and spans[i - 1][1] > new[0]


def listing(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def _find(models: dict[int, tuple[Boosted, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base_of, spans_of, more = [], [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                base = base_spans(text)
                extra = added(text, base, models)
                for c, k in zip(counts, KINDS):
                    c.append(len(base[k]))
                base_of.append(listing(base))
                spans_of.append(listing({k: base[k] + extra[k] for k in KINDS}))
                more.append(sum(map(len, extra.values())))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base_of], pa.string()),
                 pa.array(spans_of, pa.string()), pa.array(more, pa.int64())],
                names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         models: dict[int, tuple[Boosted, float]] | None = None) -> DataFrame:
    """id, base counts by kind, base_sha256, all spans and n_added of every document."""
    models = fit(docs, id_col, text_col) if models is None else models
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _find(models), f"id {kind}, {counts}, base_sha256 string, spans string, n_added long")
