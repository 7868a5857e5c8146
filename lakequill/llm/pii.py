"""Personal data by fixed patterns and a linear-chain conditional random field over word shapes.

The patterns give base spans, leftmost and without overlap for each kind; a match that fails its check is dropped. The
random field reads the words around each word with a digit, an at sign or a masked one ([at], (at)), decodes them by Viterbi in numpy batches, and
adds spans of the same kinds that no base span touches: numbers that a greedy pattern ran together, phones without
a plus sign, masked addresses. What a span holds is checked by its meaning (a host, octets, a card's sum), not its shape. It is trained by maximum likelihood from a small labelled table that this module writes.

Results for odd input: a null text is empty and has no spans; rows repeat as they come; an empty table gives an empty
result; other columns are ignored, so their names don't matter; texts of any length are read whole, in time in proportion;
a span of the field that touches a base span is dropped, and of two labels of equal odds the first of LABELS wins.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 2
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
#: What any span that _holds accepts has in it.
_SIGN = re.compile(r"[0-9@]|\[at\]|\(at\)|\[dot\]|\(dot\)")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from the at signs outwards."""
    out, end, seen = [], 0, 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            low = max(end, seen)
            start = low + len(text[low:at].rstrip(_LOCAL))
            if start < at and (m := _DOMAIN.match(text, at)):
                out.append((start, m.end()))
                end = m.end()
        seen = at + 1
        at = text.find("@", seen)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern: of each chain of numbers with single dots between, four after four."""
    out: list[tuple[int, int]] = []
    chain: list[tuple[int, int]] = []
    for m in _NUMBERS.finditer(text) if text.count(".") >= 3 else ():
        a, b = m.span()
        if chain and (a != chain[-1][1] + 1 or text[a - 1] != "."):
            chain = []
        chain.append((a, b))
        if len(chain) == 4:
            if all(y - x <= 3 and int(text[x:y]) <= 255 or len(text[x:y].lstrip("0")) <= 3 and int(text[x:y].lstrip("0") or 0) <= 255 for x, y in chain):
                out.append((chain[0][0], b))
            chain = []
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind of KINDS by the patterns."""
    out: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if _MARKED.search(text):
        out[1] = ips(text)
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out[2].append(m.span())
        out[3] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []
    return out


# the random field


def shape(word: str) -> str:
    """Letters as a or A, digits as 9, runs of over three shortened, other signs as they are; masks stay as they are."""
    word = word.replace("[at]", "\0").replace("(at)", "\0").replace("[dot]", "\1").replace("(dot)", "\1")
    s = re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub(r"[^\W\d_A-Z]", "a", word)))
    return re.sub(r"(.)\1{3,}", r"\1\1\1+", s).replace("\0", "[at]").replace("\1", "[dot]")


def token_features(word: str) -> tuple[str, ...]:
    s = shape(word)
    n = sum(c in "0123456789" for c in word)
    signs = "".join(sorted({c for c in word if not c.isalnum()}))
    return (f"s={s}", f"n={min(n, 20)}", f"g={signs}", f"f={s[:1]}", f"l={s[-1:]}", f"at={'@' in word}", f"d={word.count('.')}" if n else "d=")


def sequence_features(words: list[str]) -> list[list[str]]:
    own = [token_features(w) for w in words]
    blank = ("edge",)
    out = []
    for k, f in enumerate(own):
        before, after = (own[k - 1] if k else blank), (own[k + 1] if k + 1 < len(own) else blank)
        out.append(["bias", *f, *("-" + x for x in before[:3]), *("+" + x for x in after[:3])])
    return out


def labelled_table(rows: int = 900, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: words and their labels, positive and negative."""
    r = random.Random(seed)
    plain = "the of and to in on was with please call write mail die der und le la de pour las que number from at since".split()
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda a=3, b=8: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(a, b)))

    def card() -> str:
        d = r.choice("456") + digit(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def entity() -> tuple[str, list[str]]:
        kind = r.choice(KINDS)
        if kind == "email":
            host = f"{name()}.{r.choice(['com', 'org', 'net', 'example.com', 'de'])}"
            user = name() + r.choice(["", "." + name(), "_" + name(), "-" + name(2, 5), "+" + name(2, 5), "." + digit(2), digit(2)])
            host = host if r.random() < 0.8 else f"{name()}-{host}"
            if r.random() < 0.15:
                return kind, r.choice([[user, r.choice(["[at]", "(at)"]), host], [user, r.choice(["[at]", "(at)"]), host.split(".")[0], r.choice(["[dot]", "(dot)"]), "com"], [f"{user}[at]{host.split('.')[0]}[dot]org"], [f"{user}(at){name()}(dot){name(2, 3)}"]])
            return kind, [r.choice([f"{user}@{host}", f"{user}@mail{digit(1)}.{host}", f"{user}[at]{host}{digit(1)}", f"{user}[at]{host}", f"{user}(at){host}", f"<{user}@{host}>", f"{user}@{host},"])]
        if kind == "ip":
            ip = ".".join(str(r.randint(0, 255)) for _ in range(4))
            return kind, [ip + r.choice(["", "", ",", ".", ":" + digit(4)])]
        if kind == "card":
            c = card()
            return kind, r.choice([[c], [c + "."], [c[:4], c[4:8], c[8:12], c[12:]], ["-".join((c[:4], c[4:8], c[8:12], c[12:]))], [c + ","], [".".join((c[:4], c[4:8], c[8:12], c[12:]))]])
        a, b, c = digit(3), "555", digit(4)
        if r.random() < 0.3:
            return kind, r.choice([[f"({digit(3)})", digit(3), digit(4)], [f"{digit(3)}/{digit(3)}-{digit(4)}"], ["0" + digit(2), digit(4), digit(4)], [f"0{digit(3)}-{digit(3)}-{digit(4)}"], [f"00{digit(2)}", digit(3), digit(7)], [f"+{digit(2)}.{digit(3)}.{digit(3)}.{digit(3)}"], [digit(3), digit(3), digit(4)], [f"{a}-{b}-{c},"], [f"({a})-{b}-{c}"]])
        return kind, r.choice([[f"+{r.choice('13479')}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{digit(2)}", a, digit(3), c], [f"+1-{a}-{b}-{c}"], [f"+1{a}{b}{c}"], [f"({a})", f"{b}-{c},"]])

    def other() -> list[str]:
        return [r.choice([str(r.randint(1, 2100)), digit(4), f"{digit(1)}.{digit(1)}", f"{digit(1)}.{digit(1)}.{digit(1)}", f"{digit(2)}%", f"§{digit(2)}", f"({digit(4)})", f"({digit(2)})", f"({name()})", f"[{name()}]", f"{name()}({name()})", f"$" + digit(3), f"{digit(2)}:{digit(2)}", f"{digit(4)}-{digit(2)}-{digit(2)}", f"password={name()}{digit(3)}{name()}", f"AKIA{name().upper()}{digit(2)}", f'"{digit(3)}{name()}{digit(6)}{name()}{digit(9)}"', f"v{digit(1)}.{digit(1)}", f"@{name()}", f"#{digit(3)}", f"{digit(2)},{digit(3)}", digit(6), digit(8), digit(12), digit(20), f"{digit(2)}th", f"{digit(3)}-{digit(3)}", name() + digit(2)])]

    out = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, CONTEXT)):
                words.append(r.choice(plain) if r.random() < 0.4 else r.choice([name(2, 12), name(2, 9).title(), name(3, 9) + r.choice(".,")]))
                labels.append("O")
            if r.random() < 0.6:
                kind, parts = entity()
                words += parts
                labels += [f"{'I' if k else 'B'}-{kind}" for k in range(len(parts))]
            else:
                words += other()
                labels.append("O")
        for _ in range(r.randint(0, CONTEXT)):
            words.append(name(2, 12))
            labels.append("O")
        out.append((words, labels))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.index, self.emit, self.step = index, emit, step

    def scores(self, words: list[str]) -> np.ndarray:
        return np.array([self.emit[[self.index[f] for f in fs if f in self.index]].sum(axis=0) for fs in sequence_features(words)])

    def decode(self, batch: list[list[str]]) -> list[list[str]]:
        """Viterbi for many sequences at once."""
        out: list[list[str]] = [[] for _ in batch]
        order, i = sorted(range(len(batch)), key=lambda k: len(batch[k])), 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 2000 and (j - i + 1) * len(batch[order[j]]) <= 100_000:
                j += 1
            places, i = order[i:j], j
            own = [batch[k] for k in places]
            sizes = np.array([len(w) for w in own])
            s = np.zeros((len(own), int(sizes.max()), len(LABELS)))
            for k, words in enumerate(own):
                s[k, : len(words)] = self.scores(words)
            best, back = s[:, 0] + self.step[-1, :-1], []
            last = best.copy()
            for t in range(1, s.shape[1]):
                cand = best[:, :, None] + self.step[:-1, :-1][None]
                back.append(cand.argmax(axis=1).astype(np.int8))
                best = cand.max(axis=1) + s[:, t]
                last[sizes > t] = best[sizes > t]
            for k in range(len(own)):
                y = int((last[k] + self.step[:-1, -1]).argmax())
                path = [y]
                for t in range(int(sizes[k]) - 2, -1, -1):
                    y = int(back[t][k, y])
                    path.append(y)
                out[places[k]] = [LABELS[y] for y in reversed(path)]
        return out


def fit(table: list[tuple[list[str], list[str]]], epochs: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum likelihood by AdaGrad over full passes; forward and backward run over all sequences at once."""
    index: dict[str, int] = {}
    rows = []
    for words, labels in table:
        rows.append(([[index.setdefault(f, len(index)) for f in fs] for fs in sequence_features(words)], [LABELS.index(x) for x in labels]))
    n, longest, k = len(rows), max(len(y) for _, y in rows), len(LABELS)
    width = max(len(f) for x, _ in rows for f in x)
    feats = np.full((n, longest, width), len(index))
    gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (x, y) in enumerate(rows):
        for t, f in enumerate(x):
            feats[i, t, : len(f)] = f
        gold[i, : len(y)], mask[i, : len(y)] = y, True
    emit, step = np.zeros((len(index) + 1, k)), np.zeros((k + 1, k + 1))  # the last row starts, the last column ends
    emit_g, step_g = np.full_like(emit, 1e-6), np.full_like(step, 1e-6)
    sizes = mask.sum(1)
    ends = sizes - 1
    seq = np.arange(n)
    for _ in range(epochs):
        s = emit[feats].sum(axis=2)
        a = np.zeros((n, longest, k))
        b = np.zeros((n, longest, k))
        a[:, 0] = s[:, 0] + step[-1, :-1]
        for t in range(1, longest):
            a[:, t] = np.where(mask[:, t, None], _logsum(a[:, t - 1, :, None] + step[:-1, :-1], 1) + s[:, t], a[:, t - 1])
        b[:, -1] = step[:-1, -1]
        for t in range(longest - 2, -1, -1):
            inner = _logsum(step[:-1, :-1][None] + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(mask[:, t + 1, None], inner, step[:-1, -1])
        z = _logsum(a[seq, ends] + step[:-1, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
        d = p.copy()
        d[seq[:, None], np.arange(longest)[None], gold] -= mask
        g = np.zeros_like(emit)
        np.add.at(g, feats.ravel(), np.repeat(d.reshape(-1, k), width, axis=0))
        h = np.zeros_like(step)
        h[-1, :-1] = d[:, 0].sum(0)
        h[:-1, -1] = (p[seq, ends] - np.eye(k)[gold[seq, ends]]).sum(0)
        for t in range(1, longest):
            on = mask[:, t]
            pair = np.exp(a[on, t - 1, :, None] + step[:-1, :-1] + (s[on, t] + b[on, t])[:, None, :] - z[on, None, None])
            h[:-1, :-1] += pair.sum(0)
            np.subtract.at(h, (gold[on, t - 1], gold[on, t]), 1)
        g, h = g / n + decay * emit, h / n + decay * step
        emit_g += g * g
        step_g += h * h
        emit -= rate * g / np.sqrt(emit_g)
        step -= rate * h / np.sqrt(step_g)
        emit[-1] = 0
    return Field(index, emit[:-1], step)


@cache
def field() -> Field:
    """The field, trained once a process; it has a few thousand weights."""
    return fit(labelled_table())


_EDGE = ".,;:!?\"'<>[]{}"


_MASK = re.compile(r"\s*(?:(\[at\]|\(at\))|\[dot\]|\(dot\))\s*")


def _holds(kind: str, text: str) -> bool:
    """Whether a decoded span means what it is labelled as: an address with a host, octets, a card's sum, a number to dial."""
    if kind == "email":
        local, _, host = _MASK.sub(lambda m: "@" if m[1] else ".", text).rpartition("@")
        return bool(local) and "." in host.strip(".") and not any(c.isspace() for c in local + host)
    numbers = _NUMBERS.findall(text)
    if kind == "ip":
        return len(numbers) in (4, 5) and all(len(n) <= 3 and int(n) <= 255 for n in numbers[:4])
    digits = "".join(numbers)
    if any(c.isalpha() for c in text):
        return False
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(numbers) > 1


def segments(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words within CONTEXT of a word with a sign that a span must have; a run of any length stays whole."""
    if not _SIGN.search(text):
        return []
    words = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([a for a, _ in words])
    marks = np.unique(np.searchsorted(starts, [m.start() for m in _SIGN.finditer(text)], "right") - 1)
    out, low, high = [], int(marks[0]) - CONTEXT, int(marks[0]) + CONTEXT
    for k in map(int, marks[1:]):
        if k - CONTEXT > high + 1:
            out.append(words[max(0, low) : high + 1])
            low = k - CONTEXT
        high = k + CONTEXT
    out.append(words[max(0, low) : high + 1])
    return [s for s in out if s]


def field_spans(texts: list[str], model: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field alone finds in each text."""
    where, batch = [], []
    for k, text in enumerate(texts):
        for s in segments(text):
            where.append((k, s))
            batch.append([text[a:b] for a, b in s])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not batch:
        return out
    for (k, spans), labels in zip(where, model.decode(batch)):
        t = 0
        while t < len(labels):
            if labels[t] == "O":
                t += 1
                continue
            kind, end = labels[t][2:], t + 1
            while end < len(labels) and labels[end] == f"I-{kind}":
                end += 1
            a, b = spans[t][0], spans[end - 1][1]
            own = texts[k][a:b]
            a += len(own) - len(own.lstrip(_EDGE))
            own = texts[k][a:b]
            b -= len(own) - len(own.rstrip(_EDGE))
            if a < b and _holds(kind, texts[k][a:b]):
                out[k].append((kind, a, b))
            t = end
    return out


def added_spans(texts: list[str], base: list[list[list[tuple[int, int]]]], model: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field adds to each text: those that touch no base span."""
    out = []
    for found, groups in zip(field_spans(texts, model), base):
        held = sorted(span for group in groups for span in group)
        starts, ends = [a for a, _ in held], list(accumulate((b for _, b in held), max))
        # the base spans before the end of a span reach into it, or none does
        out.append([x for x in found if not (n := bisect.bisect_left(starts, x[2])) or ends[n - 1] <= x[1]])
    return out


def _joined(groups: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, spans in zip(KINDS, groups) for a, b in sorted(spans))


_OUT, _SCHEMA = arrow_schema("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def find(docs: DataFrame) -> DataFrame:
    """A row for each text: base counts and digest, and all spans as kind:start:end in code points, end exclusive."""
    model = field()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model)
            whole = [[b[i] + [(x, y) for kind, x, y in m if kind == KINDS[i]] for i in range(4)] if m else b for b, m in zip(base, more)]
            yield arrow_batch(_SCHEMA, batch.column("doc_id"), *([len(b[i]) for b in base] for i in range(4)), [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], [_joined(w) for w in whole], [len(m) for m in more], [sum(map(len, w)) for w in whole])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)
