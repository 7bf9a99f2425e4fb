"""Personal data: fixed base rules, and a semi-Markov conditional random field that adds spans.

**Base.** E-mail addresses, IP addresses, card numbers and phone numbers by four patterns, leftmost and
non-overlapping within a kind. They are read in linear time: a local part is looked for backwards from its ``@``, and the
other patterns never give back what they took.

**Field.** Personal data is also written in ways no pattern lists: "name at host dot org", a phone number without
a plus, a card number with dots. Around digits and at-signs all segments of bounded length (``MAX_GROUPS``
groups of digits, ``MAX_LABELS`` labels) are candidates for each kind. A candidate is scored as a whole: number of
digits and groups, separators, Luhn sum, ranges of the parts, lengths of first and last group, what stands beside it, the
word before it. A dynamic program over the text positions then chooses segments and kinds together, with plain text,
score 0, between them. Texts far from any candidate need no work, because no segment can begin
there. The weights maximise the likelihood of training windows; their labels are what the base rules found,
in the original form and in rewritten forms (``FORMS``). The windows are a bounded sample: of each kind, and of
windows without any, the ``SAMPLE`` with the smallest hashes; windows of more than 256 characters do not train.
Added spans never overlap base spans.

Defined cases: null and empty texts have no spans; failing matches are dropped, not retried; equal spans of
different kinds are all kept; repeated rows are answered each for itself; an empty table trains nothing
and finds nothing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import stash

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 200
MAX_GROUPS = 8
MAX_LABELS = 6
_AROUND = 32  # characters of context kept with a training window

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end(), "email"
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str | None) -> list[Span]:
    """What the four patterns find, by start and then kind."""
    if not text:
        return []
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdecimal() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# --- candidate segments -------------------------------------------------------------------------------

_NUMBERS = re.compile(r"[0-9]++(?:(?:\[\.\]|[ ]?[-(/][ ]?|[)][ ]?|[. ])[0-9]++)*+")
_GROUP = re.compile(r"[0-9]++")
_SPELT = re.compile(
    r"(?:@|[ ]?[\[({][ ]?at[ ]?[\])}][ ]?|[ ]at[ ])[A-Za-z0-9-]++"
    r"(?:(?:\.|[ ]?[\[({][ ]?dot[ ]?[\])}][ ]?|[ ]dot[ ])[A-Za-z0-9-]++)++",
    re.IGNORECASE,
)
_LABEL_GAP = re.compile(r"\.|[ ]?[\[({][ ]?dot[ ]?[\])}][ ]?|[ ]dot[ ]", re.IGNORECASE)
_AT_GAP = re.compile(r"@|[ ]?[\[({][ ]?at[ ]?[\])}][ ]?|[ ]at[ ]", re.IGNORECASE)
_WORD_BEFORE = re.compile(r"([^\W\d_]{1,12})\W{0,2}\Z")


@dataclass
class Candidate:
    start: int
    stop: int
    kind: str
    features: list[str] = field(default_factory=list)


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "word" if c.isalnum() else "gap" if c.isspace() else c if c in ".,-+/=_:" else "mark"


def _beside(text: str, start: int, stop: int) -> list[str]:
    word = _WORD_BEFORE.search(text[max(0, start - 16):start])
    return [f"left {_side(text, start - 1)}", f"right {_side(text, stop)}"] + ([f"after {word[1].lower()}"] if word else [])


def _number_candidates(text: str, groups: list[tuple[int, int]]) -> Iterator[Candidate]:
    for i in range(len(groups)):
        digits, parts, gaps = "", [], set()
        for j in range(i, min(i + MAX_GROUPS, len(groups))):
            if j > i:
                gaps.add(text[groups[j - 1][1]:groups[j][0]])
            parts.append(text[groups[j][0]:groups[j][1]])
            digits += parts[-1]
            if len(digits) > 19:
                break
            four = len(parts) == 4 and all(map(_small, parts))
            if len(digits) < 7 and not (four and gaps <= {".", "[.]"}):
                continue
            start, stop = groups[i][0], groups[j][1]
            signs = ""
            while start and text[start - 1] in "+(" and len(signs) < 2:
                start -= 1
                signs = text[start] + signs
            marks = "".join(sorted({c for g in gaps for c in g}))
            shape = [
                f"digits {len(digits)}", f"groups {len(parts)}", f"marks {marks}",
                f"first {min(len(parts[0]), 9)}", f"last {min(len(parts[-1]), 9)}",
            ]
            if len(digits) >= 12:
                shape.append("sum holds" if luhn(digits) else "sum fails")
            if four:
                shape.append("four small")
            if len(parts) > 2 and {len(p) for p in parts} == {4}:
                shape.append("all fours")
            for kind in ("ip", "card", "phone"):
                if kind == "ip" and len(parts) != 4 or kind == "card" and len(digits) < 12 or kind == "phone" and len(digits) > 15:
                    continue
                own = start if kind == "phone" else groups[i][0]
                more = [f"signs {signs}"] if kind == "phone" else []
                yield Candidate(own, stop, kind, shape + more + _beside(text, own, stop))


def _mail_candidates(text: str, match: re.Match) -> Iterator[Candidate]:
    start = at = match.start()
    while start and _LOCAL.match(text[start - 1]):
        start -= 1
    if start == at:
        return
    gap = _AT_GAP.match(text, at)
    stops = [m.start() for m in _LABEL_GAP.finditer(text, gap.end(), match.end())][1:] + [match.end()]
    for stop in stops[:MAX_LABELS]:
        last = text[start:stop].rsplit(".", 1)[-1].rsplit(" ", 1)[-1]
        at_form = "sign" if gap[0] == "@" else "word" if gap[0].lower() == " at " else "bracket"
        spelt = "dots" if "dot" not in text[gap.end():stop].lower() else "spelt"
        yield Candidate(start, stop, "email", [
            f"at {at_form}", f"at {at_form} {spelt}", f"last {min(len(last), 7)}",
            "last letters" if last.isalpha() else "last mixed", f"whole {stop == match.end()}", *_beside(text, start, stop),
        ])


def candidates(text: str) -> list[Candidate]:
    """All candidate segments of a text, by start."""
    found: list[Candidate] = []
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
            found += _number_candidates(text, groups)
    low = text.lower()
    # every match of the pattern begins with one of these
    if "@" in text or " at " in low or any(b + a in low for b in "[({" for a in ("at", " at")):
        for m in _SPELT.finditer(text):
            found += _mail_candidates(text, m)
    return sorted(found, key=lambda c: (c.start, c.stop, c.kind))


def windows(found: list[Candidate]) -> Iterator[list[Candidate]]:
    """Groups of candidates that overlap, directly or through others: each is decided for itself."""
    group: list[Candidate] = []
    end = -1
    for c in found:
        if group and c.start >= end:
            yield group
            group = []
        group.append(c)
        end = max(end, c.stop) if len(group) > 1 else c.stop
    if group:
        yield group


# --- the field ------------------------------------------------------------------------------------------


@dataclass
class Field:
    weight: dict[str, float]

    def score(self, c: Candidate) -> float:
        get, kind = self.weight.get, c.kind
        return get(kind, 0.0) + sum(get(f"{kind} {f}", 0.0) for f in c.features)

    def best(self, group: list[Candidate]) -> list[Span]:
        """The most likely choice of segments and kinds: dynamic programming over the positions."""
        places = sorted({p for c in group for p in (c.start, c.stop)})
        number = {p: i for i, p in enumerate(places)}
        ending: list[list[tuple[int, float, Candidate]]] = [[] for _ in places]
        for c in group:
            ending[number[c.stop]].append((number[c.start], self.score(c), c))
        value, choice = [0.0] * len(places), [None] * len(places)
        for i in range(1, len(places)):
            value[i] = value[i - 1]
            for start, score, c in ending[i]:
                if value[start] + score > value[i]:
                    value[i], choice[i] = value[start] + score, c
        out, i = [], len(places) - 1
        while i > 0:
            c = choice[i]
            if c is None:
                i -= 1
            else:
                out.append((c.start, c.stop, c.kind))
                i = number[c.start]
        return out[::-1]

    def find(self, text: str) -> list[Span]:
        return [s for group in windows(candidates(text)) for s in self.best(group)]


def _expected(group: list[Candidate], scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Logarithm of the sum over all choices, and each candidate's probability (forward and backward sums)."""
    places = sorted({p for c in group for p in (c.start, c.stop)})
    number = {p: i for i, p in enumerate(places)}
    a, b = [number[c.start] for c in group], [number[c.stop] for c in group]
    ahead, back = np.full(len(places), -np.inf), np.full(len(places), -np.inf)
    ahead[0] = back[-1] = 0.0
    for i in range(1, len(places)):
        ahead[i] = np.logaddexp.reduce([ahead[i - 1], *(ahead[a[k]] + scores[k] for k in range(len(group)) if b[k] == i)])
    for i in range(len(places) - 2, -1, -1):
        back[i] = np.logaddexp.reduce([back[i + 1], *(back[b[k]] + scores[k] for k in range(len(group)) if a[k] == i)])
    return ahead[-1], np.exp([ahead[a[k]] + scores[k] + back[b[k]] - ahead[-1] for k in range(len(group))])


def _spelt(mail: str, at: str, dot: str) -> str:
    local, _, domain = mail.partition("@")
    return local + at + domain.replace(".", dot)


# Rewritten forms of what the base rules found, to learn from besides the original.
FORMS = {
    "email": (
        lambda s: _spelt(s, " at ", " dot "), lambda s: _spelt(s, " [at] ", " [dot] "),
        lambda s: _spelt(s, "(at)", "."), lambda s: _spelt(s, " (at) ", " (dot) "),
    ),
    "ip": (lambda s: s.replace(".", "[.]"),),
    "card": (
        lambda s: ".".join(re.findall("[0-9]{1,4}", re.sub("[^0-9]", "", s))),
        lambda s: "/".join(re.findall("[0-9]{1,4}", re.sub("[^0-9]", "", s))),
    ),
    "phone": (
        lambda s: s.replace("+", "", 1), lambda s: re.sub(r"^\+[0-9]+ ?", "", s),
        lambda s: re.sub(r"[^0-9]+", "-", s).strip("-"), lambda s: "-".join(re.findall("[0-9]+", s)[1:]),
        lambda s: re.sub(r"[^0-9]+", ".", re.sub(r"^\+[0-9]+ ?", "", s)).strip("."),
        lambda s: "00" + re.sub(r"[^0-9]+", " ", s).strip(),
    ),
}


def _examples(rows: list[tuple[str, list[Span]]]) -> Iterator[tuple[str, list[Span]]]:
    for text, gold in rows:
        yield text, gold
        for start, stop, kind in gold:
            for form in FORMS[kind]:
                new = form(text[start:stop])
                yield text[:start] + new + text[stop:], [(start, start + len(new), kind)]


def fit(rows: list[tuple[str, list[Span]]], rounds: int = 60, l2: float = 1e-3, rate: float = 0.3) -> Field:
    """Maximise the likelihood of the labelled windows, with AdaGrad steps over all of them."""
    names: dict[str, int] = {}
    data = []
    for text, gold in _examples(rows):
        wanted = set(gold)
        for group in windows(candidates(text)):
            index = [np.array([names.setdefault(n, len(names)) for n in (c.kind, *(f"{c.kind} {f}" for f in c.features))]) for c in group]
            data.append((group, index, np.array([(c.start, c.stop, c.kind) in wanted for c in group], dtype=float)))
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(rounds if data else 0):
        gradient = -l2 * len(data) * w
        for group, index, gold in data:
            _, chance = _expected(group, np.array([w[i].sum() for i in index]))
            for i, g in zip(index, gold - chance):
                if abs(g) > 1e-4:
                    gradient[i] += g
        squares += gradient**2
        w += rate * gradient / np.sqrt(squares)
    return Field({n: float(w[i]) for n, i in names.items() if abs(w[i]) > 1e-6})


# --- on tables ------------------------------------------------------------------------------------------

_WINDOW = "kind string, h bigint, text string, gold array<struct<start:int,stop:int,kind:string>>"


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the texts with its surroundings and the base spans inside it."""
    schema = pa.schema([
        ("kind", pa.string()), ("h", pa.int64()), ("text", pa.string()),
        ("gold", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))),
    ])
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            found = candidates(text) if text else []
            base = base_spans(text) if found else []
            for group in windows(found):
                lo, hi = max(0, group[0].start - _AROUND), max(c.stop for c in group) + _AROUND
                if hi - lo > 8 * _AROUND:
                    continue  # long runs of numbers teach nothing that short ones do not
                inside = [s for s in base if s[0] >= lo and s[1] <= hi]
                gold, end = [], -1
                for s in inside:  # one label per place
                    if s[0] >= end:
                        gold.append({"start": s[0] - lo, "stop": s[1] - lo, "kind": s[2]})
                        end = s[1]
                part = text[lo:hi]
                h = int.from_bytes(hashlib.md5(part.encode()).digest()[:8], "big", signed=True)
                rows.append({"kind": gold[0]["kind"] if gold else "none", "h": h, "text": part, "gold": gold})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Learn from a bounded sample of windows of all texts."""
    every = stash(docs.select("text").mapInArrow(_training_windows, _WINDOW), "pii-windows")
    rows = []
    for kind in ("none", *KINDS):
        own = every.where(F.col("kind") == kind).dropDuplicates(["h"]).orderBy("h", "text").limit(sample)
        rows += [(r["text"], [(g["start"], g["stop"], g["kind"]) for g in r["gold"]]) for r in own.collect()]
    return fit(rows)


def all_spans(text: str | None, model: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together."""
    base = base_spans(text)
    if not text:
        return base, base
    taken = np.array([s[:2] for s in base], dtype=np.int64).reshape(-1, 2)
    added = [s for s in model.find(text) if not ((taken[:, 0] < s[1]) & (taken[:, 1] > s[0])).any()]
    return base, in_order(base + added)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))
_KIND = "struct<base:array<struct<start:bigint,stop:bigint,kind:string>>,all:array<struct<start:bigint,stop:bigint,kind:string>>>"
_ARROW = pa.struct([("base", _SPAN), ("all", _SPAN)])


def find_spans(docs: DataFrame, model: Field, out: str = "pii") -> DataFrame:
    """``docs`` with a column ``out``: base spans and all spans, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        rows = [
            {name: [dict(zip(("start", "stop", "kind"), s)) for s in spans] for name, spans in zip(("base", "all"), all_spans(t, shared.value))}
            for t in text.to_pylist()
        ]
        return pa.array(rows, _ARROW)

    return docs.withColumn(out, F.arrow_udf(run, _KIND)("text"))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with a mark such as ``[EMAIL]`` for each span; of overlapping ones the first and longest."""
    if not spans:
        return text
    out, done = [], 0
    for start, stop, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, stop)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars`` kept true where there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        return pa.array([redacted(t, all_spans(t, shared.value)[1]) for t in text.to_pylist()], pa.string())

    clean = docs.withColumn("text", F.arrow_udf(run, "string")("text"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, all spans, how many were added."""
    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def number(kind: str):
        return F.size(F.filter("x.base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return find_spans(docs.select("doc_id", "text"), train(docs), "x").select(
        "doc_id", *[number(k) for k in KINDS], F.sha2(joined("x.base"), 256).alias("base_sha256"),
        joined("x.all").alias("spans"), (F.size("x.all") - F.size("x.base")).cast("bigint").alias("n_added"),
    )
