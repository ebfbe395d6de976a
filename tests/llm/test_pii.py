from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from costspark.llm import pii

# The patterns as they are written down, run plainly.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a", "Z9", "@", ".", "-", " ", "+", "1", "255", "256", "007", "(", ")", "é", "%", "4556737586899855", "\n", "+1 (", "b.co", "."]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("") == []


def test_long_runs_take_no_square_of_their_length():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "@a" * 200_000, "+1" * 200_000, "a.b" * 100_000 + "@x"):
        pii.base_spans(text)


def small_field(seed):
    rng = np.random.default_rng(seed)
    words = ["tel", "call", "12", "555-0142", "+1", "a@b.co", "1.2.3.4", "x."]
    index = {f: i for i, f in enumerate(sorted({f for w in words for f in pii.features(w)}))}
    k = len(pii.LABELS)
    return pii.Field(index, rng.normal(0, 1.5, (3, len(index), k)), rng.normal(0, 1, (k, k))), words


def score(field, words, labels):
    """The score of a labeling by plain loops."""
    total, before = 0.0, pii.OUTSIDE
    for i, label in enumerate(labels):
        for o, step in enumerate(pii.OFFSETS):
            if 0 <= i + step < len(words):
                total += sum(field.weights[o, r, label] for r in field.rows(words[i + step]))
        total += field.moves[before, label]
        before = label
    return total + field.moves[before, pii.OUTSIDE]


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_equals_all_labelings(seed):
    field, words = small_field(seed)
    field.weights[:, :, 0] += 2.5 * (seed % 2)  # many words are closed in some of the fields
    rng = random.Random(seed)
    texts = [[rng.choice(words) for _ in range(n)] for n in (0, 1, 2, 3, 4, 4, 3)]
    for text, got in zip(texts, pii.Decoder(field).labels(texts)):
        got = np.zeros(len(text), int) if got is None else got
        best = max(score(field, text, ls) for ls in itertools.product(range(len(pii.LABELS)), repeat=len(text)))
        assert score(field, text, got) == pytest.approx(best)


def test_viterbi_of_long_texts():
    field, words = small_field(9)
    rng = random.Random(9)
    texts = [[rng.choice(words) for _ in range(n)] for n in (700, 3, 5000, 0)]
    moves = field.moves
    for text, got in zip(texts, pii.Decoder(field).labels(texts)):
        if not text:
            continue
        at = np.zeros((len(text) + 2, len(pii.OFFSETS), len(pii.LABELS)))
        for i, w in enumerate(text):
            at[i + 1] = field.weights[:, list(field.rows(w))].sum(1)
        state = moves[0] + at[0, 0] + at[1, 1] + at[2, 2]
        for i in range(1, len(text)):
            state = (state[:, None] + moves).max(0) + at[i, 0] + at[i + 1, 1] + at[i + 2, 2]
        got = np.zeros(len(text), int) if got is None else got
        assert score(field, text, got) == pytest.approx((state + moves[:, 0]).max())


def test_loss_and_gradient():
    field, words = small_field(2)
    rng = random.Random(2)
    k = 3  # labels in use: their number doesn't matter to the formulas
    windows = [([rng.choice(words) for _ in range(n)], [rng.randrange(k) for _ in range(n)]) for n in (1, 2, 3, 4)]
    examples = pii.Examples(windows, field.index)
    weights, moves = field.weights[:, :, :k].copy(), field.moves[:k, :k].copy()
    own = pii.Field(field.index, weights, moves)
    value, slope, slope_moves = examples.loss(weights, moves, 0.1)
    want = 0.05 * ((weights**2).sum() + (moves**2).sum())
    for text, labels in windows:
        every = [score(own, text, ls) for ls in itertools.product(range(k), repeat=len(text))]
        want += np.log(np.exp(every).sum()) - score(own, text, labels)
    assert value == pytest.approx(want)
    for p, g in ((weights, slope), (moves, slope_moves)):
        for _ in range(25):
            i = tuple(rng.randrange(n) for n in p.shape)
            p[i] += 1e-5
            up = examples.loss(weights, moves, 0.1)[0]
            p[i] -= 2e-5
            down = examples.loss(weights, moves, 0.1)[0]
            p[i] += 1e-5
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-4)


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.learn_field(docs)


def test_held_out_documents(spark, learnt):
    """Trained on sf0.01; texts of sf0.1 that it lacks: the field alone finds what the patterns find, and little else."""
    seen = {r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()
    texts = [t for r in rows if (t := r["text"] or "") not in seen][:4000]
    hits = missed = added = 0
    for text, labels in zip(texts, pii.Decoder(learnt).labels([t.split() for t in texts])):
        own = pii.field_spans(text, labels) if labels is not None else []
        base = pii.base_spans(text)
        hits += len(set(base) & set(own))
        missed += len(set(base) - set(own))
        added += sum(not any(s < e2 and s2 < e for s2, _, e2 in base) for s, _, e in own)
    assert hits > 100 and missed <= 0.05 * hits and added <= 0.05 * hits


def test_what_the_field_adds(spark, learnt):
    card, other = "4556737586899855", "5425233430109903"
    texts = {
        1: f"two {card} {other} here",  # too many digits in a row for the pattern
        2: "call +1 (212) 555-0147 4556737586899855 today",
        3: "please phone (212) 555-0147 soon",
        4: "nothing of that sort, 12 words and 3.5 more",
        5: None,
        6: "",
        7: f"mail a.b@example.com, card {card}, from 10.0.0.1",
        8: "x" * 200_000 + " 1.2.3.4",
    }
    docs = spark.createDataFrame(list(texts.items()) + [(7, texts[7]), (None, texts[7])], "doc_id long, text string")
    rows = pii.find_pii(docs, learnt).collect()
    assert len(rows) == 10
    got = {r["doc_id"]: [(s["kind"], (texts[r["doc_id"] or 7] or "")[s["start"] : s["end"]], s["source"]) for s in r["spans"]] for r in rows}
    assert got[1] == [("card", card, "field"), ("card", other, "field")]
    assert ("phone", "+1 (212) 555-0147", "field") in got[2] and ("card", card, "field") in got[2]
    assert got[3] == [("phone", "(212) 555-0147", "field")]
    assert got[4] == got[5] == got[6] == []
    assert got[7] == got[None] == [("email", "a.b@example.com", "base"), ("card", card, "base"), ("ip", "10.0.0.1", "base")]
    assert got[8] == [("ip", "1.2.3.4", "base")]


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    field = pii.learn_field(none)
    assert pii.find_pii(none, field).collect() == []
    blank = pii.train([])
    clash = spark.createDataFrame([("k", "a@b.co", 1, "s")], "doc_id string, text string, id int, spans string")
    assert [tuple(r["spans"][0]) for r in pii.find_pii(clash, blank).collect()] == [(0, 6, "email", "base")]
    big = 2**60 + 1
    ids = spark.createDataFrame([(big, "x"), (None, "y")], "doc_id long, text string")
    assert {r["doc_id"] for r in pii.find_pii(ids, blank).collect()} == {big, None}
