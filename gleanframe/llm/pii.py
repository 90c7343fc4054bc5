"""Personal data in texts: fixed patterns, and a linear-chain conditional random field beside them.

The patterns find whole e-mail addresses, IP addresses, card and phone numbers. The random
field reads word shapes and finds what has no such fixed form: telephone numbers without a
country prefix, addresses written with [at] and [dot], and grouped account numbers. It is
trained from the small labelled table below and decoded by Viterbi over padded numpy batches.

A sequence is a run of words that hold a digit, an @ or a bracketed at/dot, no more than two
other words apart, with two words of context on either side; words farther from any such word
have no label but "outside". Patterns are searched in linear time, whatever the text holds.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanframe.llm.batches import texts

BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("account", "contact", "mailbox")
KINDS = (*BASE_KINDS, *FIELD_KINDS)

Span = tuple[int, int, str]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run at which no address starts is passed as a whole: none starts inside it either.
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end(), "email"
            done = found.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind as listed; code points, end exclusive."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if m[1] and all(map(_part_ok, m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# The labelled table: fixed values. {kind|text} marks a span; everything else is outside.
LABELLED = """
call me at {contact|(743) 555-3824} after work
tel {contact|030 1234567} oder per post
phone {contact|555-123-4567} any time
mobile {contact|0171 5553824} bitte
his number is {contact|(0) 171 555 38 24} now
fax {contact|(030) 901820-11} buero
ring {contact|01 23 45 67 89} le matin
telefono {contact|91 555 12 34} por favor
tel: {contact|06 12 34 56 78} merci
reach us on {contact|212.555.0198} or here
contact {contact|(212) 555 0198} today
number {contact|0049 171 5553824} please
write to {mailbox|anna [at] mail [dot] org} soon
mail {mailbox|john.doe [at] example [dot] com} please
{mailbox|info(at)firma(dot)de} schreiben
adresse {mailbox|marie (at) poste (dot) fr} merci
send it to {mailbox|sales[at]shop[dot]com} now
correo {mailbox|luis [at] correo [dot] es} gracias
contact {mailbox|kim_lee [at] uni [dot] edu} there
pay to {account|DE89 3704 0044 0532 0130 00} today
iban {account|FR14 2004 1010 0505 0001 3} merci
konto {account|ES91 2100 0418 4502 0005 1332} bitte
transfer to {account|GB29 NWBK 6016 1331 9268 19} now
iban: {account|NL91ABNA0417164300} please
account {account|AT61 1904 3002 3457 3201} for rent
cuenta {account|DE44500105175407324931} hoy
it was 12 years ago in 1998 and again in 2004
on 2021-05-17 at 10:45 the price was 12.50
version 2.10.3 of the module and build 20431
chapter 4 page 112 section 7.2 of 300
for 1,200 people and 3,400 more in 2019
24be64439e3e49cf46b2d7c90f3602a3d0b907ff was the value
token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more
key f33e61083db5dbdf4bd2369d2f80176e57f7fda2 here
the id 4785380592391139 of the order
number 4432507379035540 and 4757965300669737 there
from 152.143.123.131 and 10.0.0.1 again
write to that.92@mail2.example.com then
mail bob@example.org or amy@example.net today
call +1 (743) 555-3824 now
tel +49 171 5553824 bitte
at 12:30 am 03.05.2020 um 8 uhr
isbn 978-3-16-148410-0 in print
room 12 floor 3 building 7
10 20 30 40 50 60
1 2 3 4 5 6 7 8 9
0.5 1.5 2.5 3.5 and 4.5
in 2020 2021 2022 and 2023
score 3-2 and 10-7 in the end
a1b2c3 x9y8 and md5 sums
items 100 200 300 at 15 each
see [1] and [2] or (3) below
meet @anna and @bob at 5
user_12 and user_15 of group 3
""".strip().split("\n")

_MARKED = re.compile(r"\{(\w+)\|([^}]*)\}")
LABELS = ("O", *(f"{side}-{kind}" for kind in FIELD_KINDS for side in ("B", "I")))
_WORD = re.compile(r"\S+")


def shape(word: str) -> str:
    """Letters become a or A, digit runs their length, other characters stay; runs of letters collapse."""
    out: list[str] = []
    run = 0
    for c in word[:40]:
        if c.isdigit():
            run += 1
            continue
        if run:
            out.append(str(min(run, 20)))
            run = 0
        kind = ("A" if c.isupper() else "a") if c.isalpha() else c
        if not out or out[-1] != kind or not c.isalpha():
            out.append(kind)
    if run:
        out.append(str(min(run, 20)))
    return "".join(out)


_HINTS = frozenset("tel phone fax mobile iban konto account at dot number contact".split())


def _features(words: list[str], shapes: list[str], k: int) -> tuple[str, ...]:
    word, left, right = shapes[k], shapes[k - 1] if k else "<", shapes[k + 1] if k + 1 < len(words) else ">"
    plain = words[k].lower().strip("[]().,:;")
    hint = words[k - 1].lower().strip(".:,;") if k else ""
    digits = sum(c.isdigit() for c in words[k])
    return (
        "s=" + word,
        "l=" + left,
        "r=" + right,
        "ls=" + left + "|" + word,
        "sr=" + word + "|" + right,
        "n=" + str(min(digits, 16)),
        "c=" + "".join(sorted({("d" if c.isdigit() else "a" if c.isalpha() else c) for c in words[k][:40]})),
        "w=" + (plain if plain in _HINTS else ""),
        "h=" + (hint if hint in _HINTS else ""),
        "m=" + str(len(words[k]) > 20),
    )


@dataclass(frozen=True)
class Field:
    """Weights of a trained field: features by label, and transitions."""

    index: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray


def _parse(line: str) -> tuple[list[str], list[int]]:
    words, labels, at = [], [], 0
    for m in [*_MARKED.finditer(line), None]:
        outside = line[at : m.start() if m else len(line)].split()
        words += outside
        labels += [0] * len(outside)
        if m:
            inside = m[2].split()
            words += inside
            labels += [LABELS.index(("I-" if k else "B-") + m[1]) for k in range(len(inside))]
            at = m.end()
    return words, labels


def _forbidden() -> np.ndarray:
    """No I- without its B- or I- before it."""
    bad = np.zeros((len(LABELS), len(LABELS)))
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y[0] == "I" and x[2:] != y[2:]:
                bad[a, b] = -1e4
    return bad


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@functools.lru_cache(4)
def train(lines: tuple[str, ...] = tuple(LABELLED), rounds: int = 150, decay: float = 0.02, rate: float = 0.5) -> Field:
    """Maximum penalised likelihood by full gradients (forward-backward), with adaptive steps."""
    parsed = [_parse(line) for line in lines]
    rows = [[_features(w, [shape(x) for x in w], k) for k in range(len(w))] for w, _ in parsed]
    index: dict[str, int] = {}
    for row in rows:
        for features in row:
            for f in features:
                index.setdefault(f, len(index))
    size, n, longest = len(LABELS), len(parsed), max(len(w) for w, _ in parsed)
    active = np.zeros((n, longest, len(index)), np.float32)
    truth = np.zeros((n, longest, size))
    mask = np.zeros((n, longest, 1))
    for i, (row, (_, labels)) in enumerate(zip(rows, parsed)):
        for t, (features, label) in enumerate(zip(row, labels)):
            active[i, t, [index[f] for f in features]] = 1
            truth[i, t, label] = mask[i, t] = 1
    follows = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    flat = active.reshape(-1, len(index))
    emission, transition, bad = np.zeros((len(index), size)), np.zeros((size, size)), _forbidden()
    start = np.where([x[0] == "I" for x in LABELS], -1e4, 0.0)
    seen_e, seen_t = np.full(emission.shape, 1e-6), np.full(transition.shape, 1e-6)
    for _ in range(rounds):
        score = (flat @ emission).reshape(n, longest, size)
        step = transition + bad
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            moved = _logsum(ahead[:, t - 1, :, None] + step, 1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t] > 0, moved, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = _logsum(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1] > 0, moved, 0)
        total = _logsum(ahead[:, -1], 1)[:, None, None]
        single = np.exp(ahead + behind - total) * mask
        pair = ahead[:, :-1, :, None] + step + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[..., None]
        double = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, :, None]).sum((0, 1))
        grad_e = flat.T @ (truth - single).reshape(-1, size) - decay * emission
        grad_t = follows - double - decay * transition
        seen_e += grad_e**2
        seen_t += grad_t**2
        emission += rate * grad_e / np.sqrt(seen_e)
        transition += rate * grad_t / np.sqrt(seen_t)
    return Field(index, emission, transition + bad)


def viterbi(scores: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """Best label sequences, all sequences of a batch side by side."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    size = transition.shape[0]
    start = np.where([x[0] == "I" for x in LABELS], -1e4, 0.0)
    best = np.array([scores[i][0] for i in order]) + start
    back: list[np.ndarray] = []
    for t in range(1, int(lengths[0])):
        alive = int(np.searchsorted(-lengths, -t, side="left"))
        through = best[:alive, :, None] + transition
        came = through.argmax(axis=1)
        emitted = np.array([scores[i][t] for i in order[:alive]])
        best[:alive] = np.take_along_axis(through, came[:, None, :], 1)[:, 0] + emitted
        back.append(came)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    for place, i in enumerate(order):
        label = int(best[place].argmax())
        path = [label]
        for t in range(int(lengths[place]) - 2, -1, -1):
            label = int(back[t][place, label])
            path.append(label)
        out[i] = np.array(path[::-1])
    return out


_TELLING = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]")
_CONTEXT = 200


def _telling_words(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _TELLING.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _WORD.match(text, m.start()).end()
        yield start, end


def sequences(text: str) -> Iterator[list[tuple[int, int]]]:
    """Word spans of each stretch that can hold personal data, with its context."""
    stretch: tuple[int, int] | None = None
    for start, end in _telling_words(text):
        if stretch and start - stretch[1] <= _CONTEXT and len(text[stretch[1] : start].split()) <= 2:
            stretch = (stretch[0], end)
            continue
        if stretch:
            yield _widened(text, *stretch)
        stretch = (start, end)
    if stretch:
        yield _widened(text, *stretch)


def _widened(text: str, start: int, end: int) -> list[tuple[int, int]]:
    low = max(0, start - _CONTEXT)
    before = [m.span() for m in _WORD.finditer(text, low, start)][-2:]
    inside = [m.span() for m in _WORD.finditer(text, start, end)]
    after = [m.span() for m in _WORD.finditer(text, end, end + _CONTEXT)][:2]
    return before + inside + after


class _Scores(dict):
    """Emission scores by word and neighbours' shapes, remembered within a task."""

    def __init__(self, field: Field):
        self.field = field

    def of(self, words: list[str]) -> np.ndarray:
        shapes = [shape(w) for w in words]
        out = []
        for k in range(len(words)):
            features = _features(words, shapes, k)
            if features not in self:
                if len(self) > 100_000:
                    self.clear()
                known = [self.field.index[f] for f in features if f in self.field.index]
                self[features] = self.field.emission[known].sum(axis=0)
            out.append(self[features])
        return np.array(out)


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def _plausible(kind: str, text: str) -> bool:
    """Fixed requirements a decoded span must meet."""
    if kind == "contact":
        return 7 <= _digits(text) <= 15
    if kind == "account":
        return len(text) >= 15 and text[:2].isalpha() and text[:2].isupper() and text[2:4].isdigit()
    return bool(re.search(r"[\[(]at[\])]", text)) and bool(re.search(r"[\[(]dot[\])]", text))


def field_spans(some: list[str], field: Field, scores: _Scores | None = None) -> list[list[Span]]:
    """Spans the random field finds in each text."""
    scores = scores or _Scores(field)
    owners, spans = [], []
    for i, text in enumerate(some):
        for words in sequences(text):
            owners.append(i)
            spans.append(words)
    emitted = [scores.of([some[i][a:b] for a, b in words]) for i, words in zip(owners, spans)]
    out: list[list[Span]] = [[] for _ in some]
    for i, words, path in zip(owners, spans, viterbi(emitted, field.transition)):
        k = 0
        while k < len(words):
            label = LABELS[path[k]]
            if label[0] != "B":
                k += 1
                continue
            last = k
            while last + 1 < len(words) and LABELS[path[last + 1]] == "I-" + label[2:]:
                last += 1
            start, end = words[k][0], words[last][1]
            while end > start and some[i][end - 1] in ".,;:!?\"'":
                end -= 1
            if _plausible(label[2:], some[i][start:end]):
                out[i].append((start, end, label[2:]))
            k = last + 1
    return out


def all_spans(base: list[Span], found: list[Span]) -> list[Span]:
    """Base spans stay; of the others, those that touch none of them."""
    free = [s for s in found if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
    return sorted({*base, *free}, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans go as one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(field: Field, schema: pa.Schema, mask: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(field)
        for batch in batches:
            some = list(texts(batch))
            base = [base_spans(t) for t in some]
            every = [all_spans(b, f) for b, f in zip(base, field_spans(some, field, scores))]
            made: dict[str, list] = {}
            if mask:
                given = batch.column(mask).to_pylist()
                made[mask] = [None if g is None else masked(t, s) for g, t, s in zip(given, some, every)]
            else:
                for kind in BASE_KINDS:
                    made[f"n_{kind}"] = [sum(s[2] == kind for s in b) for b in base]
                made["base_sha256"] = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
                made["spans"] = [_joined(s) for s in every]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema],
                schema=schema,
            )

    return run


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of base spans, digest of the base spans, and all spans of each text.

    Null texts read as empty: no spans. Rows are looked at one by one, so repeated rows get
    equal results; other columns are ignored.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS),
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
        ]
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(field or train(), to_arrow_schema(schema), None), schema)


def mask_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All columns and rows of ``docs``, with personal data in ``text`` replaced by its kind; null stays null."""
    return docs.mapInArrow(_scan(field or train(), to_arrow_schema(docs.schema), "text"), docs.schema)
