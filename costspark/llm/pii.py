"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.  An email is found from its "@" on, an address from its dotted run.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # can't fail, so no digit is tried twice
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What a document has to hold to be of use as an example.
EXAMPLE = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.|[0-9]{10}|[0-9]{3}[ )-]"

OUTSIDE = 0
LABELS = ["O", *(f"{place}-{kind}" for kind in KINDS for place in "BI")]
SPANS = "array<struct<start:int,end:int,kind:string,source:string>>"

# A small labelled table: [kind:text] marks personal data that the patterns don't find, or find only alone.
LABELLED = """
Call me at [phone:(212) 555-0147] after six.
Phone: [phone:212-555-0198], ask for the desk.
tel. [phone:030 5550 1234] or come by
Tel: [phone:01 45 55 01 99] le matin
My number is [phone:555-0123-456], thanks.
Reach us at [phone:415.555.0172] or write.
phone [phone:(030) 555-0188] fax [phone:(030) 555-0189]
mobile: [phone:0171 5550142]
Fax [phone:212-555-0111] and card [card:4556 7375 8689 9855]
[phone:+1 (212) 555-0147] [card:4556737586899855] was on the note
[card:4556737586899855] [card:5425233430109903] both were charged
old card [card:5425233430109903] new card [card:4556737586899855] end
pay with [card:4556737586899855] [phone:+1 (305) 555-0190] please
[phone:+1 (646) 555-0101] [phone:+1 (646) 555-0102] two lines
from [ip:203.0.113.7] [ip:198.51.100.23] to the gate
host [ip:198.51.100.99], port 8080
write to [email:jo.field at example.org] today
mail [email:ann(at)example.com] or call
contact [email:max [at] example [dot] net] for keys
e-mail: [email:li@example.co.uk], [email:bo@example.org]
The version 1.2.3 came on 2024-03-01 at 10:45.
Chapter 3.2.1.4.5 of the book has 320 pages.
Order 20240301123456 of 12 items for 1,234.50 was sent.
ISBN 978-3-16-148410-0 is the number of the book.
In 2019 there were 1200 people, 300 more than in 2018.
The sum of 100 200 300 and 400 is 1000.
Line 12 has 15 words and 80 characters.
token = 9233a8ecf7c5b09fe5949719b6b82bc439e9329b in the log
build 10.2.300.4000 failed at step 17
The price is 19.99 or 20.00, not 2,000,000.
Meet @noon at the corner, not at example street.
Add 3+4 and 5+6 to get 18.
The code 1234 5678 is not a card.
Serial 1111222233334445 stands on the case.
""".strip().splitlines()


def luhn(digits: str) -> bool:
    """Whether the sum of Luhn over ASCII digits is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _octet(part: str) -> bool:
    return len(bare := part.lstrip("0")) <= 3 and int(bare or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            last = m.end()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            n = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, at + n
            at += n + 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as a place in KINDS, end) of the fixed patterns, sorted; linear in the text's length.

    Leftmost and not overlapping within a kind; matches that fail their test are dropped and not tried shorter.
    """
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if any(d in text for d in "0123456789"):
        found += [(s, 1, e) for s, e in _addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def doubtful(text: str) -> bool:
    """Whether digits run on for longer than one card or phone: what the patterns say of it is no label."""
    return any(len(_digits(m[0])) > 19 for m in CARD.finditer(text)) or any(len(_digits(m[0])) > 15 for m in PHONE.finditer(text))


# ---- features -------------------------------------------------------------------------------------------

LENGTHS = (1, 3, 8, 15, 30)
EDGE = " .,;:!?\"'*#&%$|<>{}=«»“”…"
SHAPE = [(re.compile(r"[0-9]+"), "d"), (re.compile(r"[A-Z]+"), "X"), (re.compile(r"[^\W\d_A-Z]+"), "x")]


def _step(value: int, bounds: tuple[int, ...]) -> int:
    return sum(value > b for b in bounds)


def features(word: str) -> list[str]:
    """Shape, length, digits and tests of a word, without the punctuation around it."""
    core = word.strip(EDGE) or word
    plain = core.strip("()[]")
    shape = core
    for pattern, letter in SHAPE:
        shape = pattern.sub(letter, shape)
    digits = _digits(core)
    n = len(digits)
    out = [f"s:{shape}" if len(shape) <= 16 else "s:long", f"n:{_step(n, (0, 1, 2, 3, 4, 6, 9, 13, 19))}"]
    out.append(f"l:{_step(len(core), LENGTHS)}")
    if word[-1:] != core[-1:]:
        out.append("ends:" + word[-1:])
    if plain.isalpha():
        out += [f"w:{plain.lower()}"] if len(plain) <= 12 else []
        return out
    if DOMAIN.search(core):
        out.append("mail")
    if n >= 14 and not any(c.isalpha() for c in core):
        out.append("luhn" if n <= 19 and luhn(digits) else "no luhn")
    if "." in core and n and (parts := core.split(".")) and all(p.isdigit() and p.isascii() for p in parts):
        out.append("quad" if len(parts) == 4 and all(map(_octet, parts)) else f"parts:{min(5, len(parts))}")
    if core[:1] == "+" and n:
        out.append("plus")
    if core[:1] == "(" and n:
        out.append("paren")
    return out


# ---- the model ------------------------------------------------------------------------------------------

OFFSETS = (-1, 0, 1)
Window = tuple[list[str], list[int]]


@dataclass(frozen=True)
class Field:
    """A trained field: rows of ``index`` in ``weights`` (offset, feature, label), ``moves`` (label, label)."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    @functools.cached_property
    def names(self) -> list[str]:
        return list(self.index)

    def rows(self, word: str) -> tuple[int, ...]:
        return tuple(self.index[f] for f in features(word) if f in self.index)


def forward_backward(scores: np.ndarray, real: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded windows: log of the sum over all labelings, marginals of labels, expected moves in all.

    A window stands between two outside labels.  ``real`` marks its words, which come first.
    """
    n, steps, k = scores.shape
    alpha, beta = np.zeros((steps, n, k)), np.zeros((steps, n, k))

    def add(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    last = real.sum(1) - 1
    alpha[0] = moves[OUTSIDE] + scores[:, 0]
    for t in range(1, steps):
        alpha[t] = add(alpha[t - 1][:, :, None] + moves, 1) + scores[:, t]
    for t in range(steps - 1, -1, -1):
        ends = (last == t)[:, None]
        after = add(moves + (scores[:, t + 1] + beta[t + 1])[:, None, :], 2) if t + 1 < steps else np.zeros((n, k))
        beta[t] = np.where(ends, moves[:, OUTSIDE], after)
    total = add(alpha[last, np.arange(n)] + moves[:, OUTSIDE], 1)
    marginal = np.exp(alpha + beta - total[None, :, None]).transpose(1, 0, 2) * real[:, :, None]
    expected = np.zeros((k, k))
    expected[OUTSIDE] += marginal[:, 0].sum(0)
    expected[:, OUTSIDE] += marginal[np.arange(n), last].sum(0)
    for t in range(1, steps):
        own = real[:, t]
        pair = alpha[t - 1][own][:, :, None] + moves + (scores[own, t] + beta[t][own])[:, None, :] - total[own][:, None, None]
        expected += np.exp(pair).sum(0)
    return total, marginal, expected


class Examples:
    """Windows as padded arrays: class of each word (rows of equal features), labels, words that count."""

    def __init__(self, windows: list[Window], index: dict[str, int]) -> None:
        self.width = max(len(w) for w, _ in windows)
        classes: dict[tuple[int, ...], int] = {(): 0}
        memo: dict[str, int] = {}
        for words, _ in windows:
            for w in words:
                if w not in memo:
                    memo[w] = classes.setdefault(tuple(index[f] for f in features(w) if f in index), len(classes))
        self.matrix = np.zeros((len(classes), len(index)))
        for rows, c in classes.items():
            self.matrix[c, list(rows)] = 1
        self.cls = np.zeros((len(windows), self.width + 2), np.int64)  # a place without a word at both sides
        self.label = np.zeros((len(windows), self.width), np.int64)
        self.real = np.zeros((len(windows), self.width), bool)
        for i, (words, labels) in enumerate(windows):
            self.cls[i, 1 : 1 + len(words)] = [memo[w] for w in words]
            self.label[i, : len(words)] = labels
            self.real[i, : len(words)] = True

    def loss(self, weights: np.ndarray, moves: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood with squared decay, and its gradient."""
        tables = [self.matrix @ w for w in weights]
        place = lambda o: self.cls[:, 1 + o : 1 + o + self.width]
        scores = sum(t[place(o)] for o, t in zip(OFFSETS, tables))
        total, marginal, expected = forward_backward(scores, self.real, moves)
        n, steps = self.label.shape
        chosen = np.take_along_axis(scores, self.label[:, :, None], 2)[:, :, 0]
        own = np.zeros_like(moves)
        before = np.concatenate([np.zeros((n, 1), np.int64), self.label[:, :-1]], 1)
        np.add.at(own, (before[self.real], self.label[self.real]), 1)
        last = self.real.sum(1) - 1
        np.add.at(own, (self.label[np.arange(n), last], np.zeros(n, np.int64)), 1)
        value = total.sum() - chosen[self.real].sum() - (own * moves).sum()
        push = marginal.copy()
        rows, columns = np.nonzero(self.real)
        push[rows, columns, self.label[self.real]] -= 1
        slope = np.empty_like(weights)
        for i, o in enumerate(OFFSETS):
            by_class = np.zeros((len(self.matrix), weights.shape[2]))
            np.add.at(by_class, place(o)[self.real], push[self.real])
            slope[i] = self.matrix.T @ by_class
        value += decay / 2 * ((weights**2).sum() + (moves**2).sum())
        return value, slope + decay * weights, expected - own + decay * moves


def train(windows: list[Window], rounds: int = 100, decay: float = 0.05, least: int = 2, rate: float = 0.2) -> Field:
    """A field fitted to ``windows`` (words, labels) by Adam over all of them at once; features seen
    ``least`` times count.  No windows give a field that finds nothing."""
    seen: dict[str, int] = {}
    for words, _ in windows:
        for w in words:
            for f in features(w):
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    weights, moves = np.zeros((len(OFFSETS), len(index), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    if not windows:
        moves[:, 1:] = -1.0
        return Field(index, weights, moves)
    examples = Examples(windows, index)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, moves)]
    for i in range(1, rounds + 1):
        _, *slopes = examples.loss(weights, moves, decay)
        step = rate * (1 - 0.9 * i / rounds)
        for p, g, (mean, square) in zip((weights, moves), slopes, state):
            mean *= 0.9
            mean += 0.1 * g
            square *= 0.99
            square += 0.01 * g * g
            p -= step * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return Field(index, weights, moves)


class Decoder:
    """Best labels of texts by Viterbi, many words at once.

    A word is closed if outside beats every other label there whatever its neighbours are labelled: the best
    labeling has outside at it.  What is left falls into runs between closed words,
    and runs are decoded side by side, one step of numpy for all.  The result is that of Viterbi over whole texts.
    """

    def __init__(self, field: Field, remembered: int = 300_000) -> None:
        self.field, self.remembered = field, remembered
        moves = field.moves
        detour = moves[:, :, None] + moves[None, :, :] - (moves[:, OUTSIDE, None] + moves[None, OUTSIDE])[:, None, :]
        self.gain = detour.max((0, 2))  # of a label over outside, at the best neighbours
        self._forget()

    def _forget(self) -> None:
        self.classes: dict[tuple[int, ...], int] = {(): 0}
        self.rows: list[np.ndarray] = [np.zeros((len(OFFSETS), len(LABELS)))]
        self.words: dict[str, int] = {}
        self.plain: dict[tuple, tuple[int, ...]] = {}

    def _class(self, word: str) -> int:
        core = word.strip(EDGE)
        case = "x" if core.islower() else "Xx" if "A" <= core[:1] <= "Z" and core[1:].islower() else None
        if case and core.isalpha():  # what most words are: their features follow from a few facts
            facts = (case, word[-1] if word[-1] != core[-1] else "", _step(len(core), LENGTHS))
            if facts not in self.plain:
                self.plain[facts] = tuple(r for r in self.field.rows(word) if not self.field.names[r].startswith("w:"))
            known = self.field.index.get("w:" + core.lower()) if len(core) <= 12 else None
            rows = self.plain[facts] if known is None else tuple(self.field.rows(word))
        else:
            rows = self.field.rows(word)
        if rows not in self.classes:
            self.classes[rows] = len(self.rows)
            self.rows.append(self.field.weights[:, list(rows)].sum(1))
        self.words[word] = self.classes[rows]
        return self.words[word]

    def labels(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """Labels of each text's words; None where all are outside."""
        if len(self.words) > self.remembered:
            self._forget()
        known, learn = self.words, self._class
        sizes = np.array([len(t) for t in texts])
        flat = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int64)  # class 0 before, between and after texts
        at = 1
        for words in texts:
            for w in set(words).difference(known):
                learn(w)
            flat[at : at + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            at += len(words) + 1
        first = np.cumsum(np.concatenate([[1], sizes + 1]))[:-1]
        table = np.stack(self.rows)  # class, offset, label
        rest = table[:, :, 1:] - table[:, :, :1]
        bound = (rest[:, 1] + self.gain[1:]).max(1)
        open_ = np.zeros(len(flat), bool)
        open_[1:-1] = bound[flat[1:-1]] + rest[:, 0].max(1)[flat[:-2]] + rest[:, 2].max(1)[flat[2:]] >= -1e-9
        walls = np.concatenate([[0], first + sizes])
        open_[walls] = False
        places = np.flatnonzero(open_)
        out: list[np.ndarray | None] = [None] * len(texts)
        if not len(places):
            return out
        scores = table[flat[places - 1], 0] + table[flat[places], 1] + table[flat[places + 1], 2]
        starts = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        best = viterbi(scores, starts, np.diff(starts, append=len(places)), self.field.moves)
        hit = np.flatnonzero(best != OUTSIDE)
        owner = np.searchsorted(first, places[hit], "right") - 1
        for i in np.unique(owner).tolist():
            own = np.zeros(int(sizes[i]), np.int64)
            mine = hit[owner == i]
            own[places[mine] - first[i]] = best[mine]
            out[i] = own
        return out


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of runs of rows of ``scores``, each run between two outside labels; ties to the lower label."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # runs longer than t
    back: list[np.ndarray] = []
    final = np.zeros(len(starts), np.int64)
    state = moves[OUTSIDE] + scores[starts]
    for t, n in enumerate(active.tolist()):
        if t:
            paths = state[:n, :, None] + moves
            back.append(paths.argmax(1).astype(np.int8))
            state = np.take_along_axis(paths, back[-1][:, None, :].astype(np.int64), 1)[:, 0] + scores[starts[:n] + t]
        ends = np.flatnonzero(lengths[:n] == t + 1)
        final[ends] = (state[ends] + moves[:, OUTSIDE]).argmax(1)
    out = np.zeros(len(scores), np.int64)
    now = final.copy()
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        out[starts[:n] + t] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return out


# ---- spans ----------------------------------------------------------------------------------------------

WORDS = re.compile(r"\S+")
TRIM = {  # what a span of a kind begins and ends with
    "email": (re.compile(r"[^A-Za-z0-9]+"), re.compile(r"[^A-Za-z0-9]+$")),
    "ip": (re.compile(r"[^0-9]+"), re.compile(r"[^0-9]+$")),
    "card": (re.compile(r"[^0-9]+"), re.compile(r"[^0-9]+$")),
    "phone": (re.compile(r"[^0-9+(]+"), re.compile(r"[^0-9]+$")),
}
AT = re.compile(r"@|\bat\b", re.IGNORECASE)


def plausible(kind: str, text: str) -> bool:
    """The exact check after the field: Luhn of a card, octets of an address, digits of a phone, the at of an email."""
    digits = _digits(text)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and _octet(p) for p in parts)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return bool(AT.search(text))


def field_spans(text: str, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs of labels that pass the check, without what surrounds them."""
    places = [m.span() for m in WORDS.finditer(text)]
    found, i = [], 0
    while i < len(labels):
        if labels[i] == OUTSIDE:
            i += 1
            continue
        kind = int(labels[i] - 1) // 2
        j = i + 1
        while j < len(labels) and labels[j] == 2 + 2 * kind:  # I of the same kind
            j += 1
        start, end = places[i][0], places[j - 1][1]
        lead, tail = TRIM[KINDS[kind]]
        if m := lead.match(text, start, end):
            start = m.end()
        end = start + len(tail.sub("", text[start:end]))
        if start < end and plausible(KINDS[kind], text[start:end]):
            found.append((start, kind, end))
        i = j
    return found


def labelled_windows(text: str, spans: list[tuple[int, int, int]], around: int = 6, most: int = 8) -> list[Window]:
    """Windows of words around labelled spans and words with digits or an "@"; at most ``most``, spread over the text."""
    places = [m.span() for m in WORDS.finditer(text)]
    labels = [OUTSIDE] * len(places)
    starts = np.array([s for s, _ in places] or [0])
    for start, kind, end in spans:
        i = max(0, int(np.searchsorted(starts, start, "right")) - 1)
        first = True
        while i < len(places) and places[i][0] < end:
            if labels[i] == OUTSIDE:
                labels[i] = (1 if first else 2) + 2 * kind
            first, i = False, i + 1
    marked = [i for i, (s, e) in enumerate(places) if labels[i] or any(c.isdigit() or c == "@" for c in text[s:e])]
    runs: list[list[int]] = []
    for i in marked or ([len(places) // 2] if places else []):
        if runs and i - around <= runs[-1][1] and i + around - runs[-1][0] < 40:
            runs[-1][1] = i + around + 1
        else:
            runs.append([max(0, i - around), i + around + 1])
    out = []
    for a, b in runs[:: max(1, -(-len(runs) // most))]:
        b = min(b, len(places))
        while a > 0 and labels[a] and labels[a] % 2 == 0:  # don't begin inside a span
            a -= 1
        part = text[places[a][0] : places[b - 1][1]]
        if not doubtful(part):
            out.append(([text[s:e] for s, e in places[a:b]], labels[a:b]))
    return out


def written_examples(lines: list[str] = LABELLED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines with [kind:text] marks as texts with spans."""
    out = []
    mark = re.compile(r"\[(" + "|".join(KINDS) + r"):((?:[^\[\]]|\[[^\[\]]*\])*)\]")
    for line in lines:
        text, spans, at = "", [], 0
        for m in mark.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out


def label_sample(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> list[Window]:
    """Windows of about ``sample_docs`` documents that hold digits or addresses, and a quarter as many of all.

    Chosen by a hash of id and text below the share that gives this number; repeated rows count once.  Labels
    are the fixed patterns' spans, windows whose digits run together are left out.  Windows are cut in
    tasks: at most eight of some forty words a document come to the driver.  Two scans: one counts, one cuts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text, F.lit(11)).alias("rank"))
    has = F.rlike("text", F.lit(EXAMPLE))
    fit, every = rows.agg(F.count_if(has), F.count("*")).first()
    below = lambda n, of: F.col("rank") <= min(2**63 - 1, n * 2**64 // max(1, of) - 2**63)
    chosen = rows.where(below(sample_docs // 4, every) | (below(sample_docs, fit) & has)).dropDuplicates(["rank"]).select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for t in batch.column("text").to_pylist() for w in labelled_windows(t, base_spans(t))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.list_(pa.string())), pa.array([n for _, n in found], pa.list_(pa.int32()))],
                ["words", "labels"],
            )

    return sorted((r["words"], r["labels"]) for r in chosen.mapInArrow(cut, "words array<string>, labels array<int>").collect())


def learn_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1500, written: int = 4) -> Field:
    """A field trained on a small labelled table: windows of ``sample_docs`` documents (see ``label_sample``) and
    the written examples, which count ``written`` times."""
    windows = label_sample(docs, id_col, text_col, sample_docs)
    return train(windows + [(text.split(), _word_labels(text, spans)) for text, spans in written_examples()] * written)


def _word_labels(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    labels = []
    for s, e in (m.span() for m in WORDS.finditer(text)):
        over = [(a, k) for a, k, b in spans if s < b and a < e]
        labels.append((1 if s <= over[0][0] < e else 2) + 2 * over[0][1] if over else OUTSIDE)
    return labels


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", words_at_once: int = 200_000) -> DataFrame:
    """``id_col`` and ``spans`` of every row: a list of (start, end, kind, source), code points, end exclusive.

    Sorted by start, then by the order of ``KINDS``.  source is base for the fixed patterns; field
    for what the conditional random field adds: spans that pass the exact check of their kind and
    overlap no base span.  Null texts are empty and have no spans; repeated rows each have theirs.  No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            spans: list[list[dict]] = []
            held: list[str] = []
            words: list[list[str]] = []
            n = 0

            def flush() -> None:
                for text, labels in zip(held, decoder.labels(words)):
                    base = base_spans(text)
                    every = [(s, k, e, "base") for s, k, e in base]
                    if labels is not None:
                        for s, k, e in field_spans(text, labels):
                            if not any(s < b_end and b_start < e for b_start, _, b_end in base):
                                every.append((s, k, e, "field"))
                    spans.append([dict(start=s, end=e, kind=KINDS[k], source=by) for s, k, e, by in sorted(every)])

            for text in batch.column(1).to_pylist():
                held.append(text)
                words.append(text.split())
                n += len(words[-1])
                if n >= words_at_once:
                    flush()
                    held, words, n = [], [], 0
            if held:
                flush()
            struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("source", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(struct))], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(found, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def of_source(spans: Column, source: str, *kinds: str) -> Column:
    """The spans of a source, of some kinds if given."""
    keep: Callable[[Column], Column] = lambda s: (s["source"] == source) & (s["kind"].isin(*(kinds or KINDS)))
    return F.filter(spans, keep)
