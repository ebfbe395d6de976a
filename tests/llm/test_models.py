"""Packing, near copies, toxicity, top-k, pages, conversations and the piece codec against plain versions."""

from __future__ import annotations

import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from costspark.llm import queries
from costspark.llm.chat import align, format_chats, read_back, render, unescape
from costspark.llm.main_text import PRIOR, cut, extract_main_text, fit_weights, main_text
from costspark.llm.mtree import top_products
from costspark.llm.near_join import Shingles, depth_for, near_join
from costspark.llm.packing import best_fit, pack, token_pieces
from costspark.llm.sp_codec import codec, sp_decode, sp_encode
from costspark.llm.tokens import WordIds, public_path
from costspark.llm.toxicity import held_out, nnpu_weights, toxicity

DOCS = "doc_id long, text string, uid long, seq long, id long, digest string, score double, label string"
FILL = (1, 1, 1, "x", 0.5, "x")
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    return lambda *rows: spark.createDataFrame([(i, t, *FILL) for i, t in rows], DOCS)


# -- packing --------------------------------------------------------------------------------


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_path("word_bpe_49k.json")
    own, plain, rng = WordIds(path, most=50), Tokenizer.from_file(path), random.Random(1)
    texts = ["", " ", "It's I'LL a\x1cb c d", "<|endoftext|>x ΑΣ ſK İi 1½²x é"]
    for _ in range(600):
        texts.append("".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x3000), 32, 0x301])) for _ in range(30)))
    for text, ids in zip(texts, own(texts)):
        assert ids == array("I", plain.encode(text, add_special_tokens=False).ids).tobytes()


def check_packed(rows, capacity):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_edges(docs):
    rows = pack(docs((1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d"), (4, "word " * 50)), capacity=8, keep_ids=True).collect()
    check_packed(rows, 8)
    assert sum(r["length"] for r in rows) == 1 + 1 + 4 + 4 + 2 + 51
    assert all(r["ids_crc32"] == zlib.crc32(array("I", r["ids"]).tobytes()) and len(r["ids"]) == r["length"] for r in rows)
    assert [r["length"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == 4] == [8] * 6 + [3]
    assert pack(docs((1, "a")).where("false")).collect() == []


@pytest.mark.parametrize("rows_a_task", [100_000, 60])
@pytest.mark.parametrize("lengths", ["mixed", "equal", "tiny"])
def test_best_fit_is_near_the_bound(spark, rows_a_task, lengths):
    rng = random.Random(5)
    own = {"mixed": [rng.randrange(1, 100) for _ in range(500)], "equal": [30] * 400, "tiny": [1, 2, 3] * 150}[lengths]
    pieces = spark.createDataFrame(list(enumerate(own)), "uid long, length long")
    found = {r["uid"]: r for r in best_fit(pieces, 100, rows_a_task).collect()}
    assert sorted(found) == list(range(len(own)))
    rows = [{"sequence_id": r["seq"], "offset": r["offset"], "length": own[u]} for u, r in found.items()]
    bound = -(-sum(own) // 100) if lengths != "equal" else -(-400 // 3)
    assert check_packed(rows, 100) <= 1.06 * bound + 2


# -- near copies ------------------------------------------------------------------------------


def brute(rows, threshold=0.8):
    own = Shingles(5)
    sets = {i: set(own(t or "").tolist()) for i, t in rows}
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a].add(b)
                    links[b].add(a)
    label = {i: i for i in sets}
    for _ in sets:
        for a, near in links.items():
            label[a] = min([label[a], *(label[b] for b in near)])
    return {i: (label[i], len(links[i])) for i in sets}


def near_rows(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [word() for _ in range(80)]
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(100, 130)]
    for i in range(n):  # one large group of near copies, all different
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(80)] = word()
        rows.append((i, " ".join(own)))
    return rows + [(200, "One, two three!"), (201, "one TWO three"), (202, ""), (203, None), (204, "?!")]


@pytest.mark.parametrize("tile", [256, 7])
def test_near_join_against_all_pairs(docs, tile):
    rows = near_rows()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_join(docs(*rows), tile=tile).collect()}
    assert got == brute(rows)


def test_near_join_odd_rows(docs):
    text = "a b c d e f g"
    got = [tuple(r)[:4] for r in near_join(docs((3, text), (3, text), (None, text), (5, "A b c d e f g"))).collect()]
    assert sorted(got, key=str) == [(3, 3, 2, 3), (3, 3, 2, 3), (5, 3, 2, 3), (None, None, 0, None)]
    assert near_join(docs((1, "a")).where("false")).collect() == []


def test_near_join_tells_texts_of_an_id_apart(docs, spark):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t u v w x y z"
    rows = [(1, one), (1, two), (3, two + " end"), (4, one), (5, "other words stand here alone at last")]
    got = {(r["doc_id"], r["text_hash"]): tuple(r)[1:5] for r in near_join(docs(*rows)).collect()}
    by = sorted((i, v) for (i, _), v in got.items())
    assert by == [
        (1, (1, 1, 1, True)), (1, (1, 1, 1, True)), (3, (1, 1, 3, False)), (4, (1, 1, 1, False)), (5, (5, 0, 5, True)),
    ]
    names = spark.createDataFrame([("b", one), ("a", one), ("c", one + " k")], "doc_id string, text string")
    assert sorted(tuple(r)[:4] for r in near_join(names).collect()) == [("a", "a", 2, "a"), ("b", "a", 2, "a"), ("c", "a", 2, "c")]


def test_near_join_ties_grow_as_the_group(docs, monkeypatch):
    from costspark.llm import near_join as module

    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base, f"x{i}", f"y{i}"])) for i in range(400)]
    seen, plain = [], module.components
    monkeypatch.setattr(module, "components", lambda edges: seen.append(edges.distinct().count()) or plain(edges))
    got = near_join(docs(*rows), tile=32).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 399)}
    assert len(seen) == 2 and max(seen) <= 2 * len(rows)


def test_depth_reaches_the_recall():
    depth = depth_for(0.8, 32, 10, 0.999)
    assert 1 - (1 - 0.8**depth) ** 32 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 32


def test_near_join_recall_on_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op6_ngram_join(spark, SF).collect()}
    assert got == brute(rows)


# -- toxicity -----------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(4000):
        own = rng.choices(words, k=30)
        if toxic := i % 8 == 0:
            own[rng.randrange(30)] = rng.choice(["badone", "badtwo", "badtree"])
        rows.append((i, " ".join(own)))
        if rng.random() < 0.6:
            marks.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (9001, ""), (9002, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    assert len(found) == 4003 and all(0 <= r["score"] <= 1 for r in found.values())
    held = [(r["predicted"], int(i % 8 == 0)) for i, r in found.items() if r["held_out"] and i is not None and i < 4000]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert not any(zlib.crc32(str(i).encode()) % 5 for i, r in found.items() if r["held_out"])


def test_toxicity_without_examples(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(docs((1, "a"), (2, None)), none).collect()
    assert [r["score"] for r in got] == [0.0, 0.0]
    assert toxicity(docs((1, "a")).where("false"), none).collect() == []


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, f"word{i} badone" if i % 2 else f"word{i}") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda own: {r["doc_id"]: round(r["score"], 9) for r in toxicity(docs, own).collect()}
    assert score(labels) == score(turned)


def test_risk_stays_above_zero():
    x = np.eye(4, dtype=np.float32)
    w = nnpu_weights(x[:1].repeat(20, 0), np.vstack([x[:1].repeat(5, 0), x[1:].repeat(15, 0)]), prior=0.1)
    assert w[0] + w[-1] > 0 > w[1] + w[-1]


# -- top-k ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard_rows", [20_000, 40])
def test_top_products_against_all_pairs(spark, shard_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).round(1)
    x[50:90] = x[50]  # a common vector: ties go to the smaller id
    rows = [(i, v.tolist(), 1, 1) for i, v in enumerate(x)]
    rows += [(400, None, 1, 1), (401, [1.0, None], 1, 1), (402, [float("nan")], 1, 1), (403, [float("inf")], 1, 1), (None, [1.0], 1, 1), (404, [], 1, 1), (299, x[299].tolist(), 1, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, shard int")
    found: dict[int, list] = {}
    for r in top_products(vectors, F.col("vec_id") % 20 == 0, k=5, shard_rows=shard_rows, block_rows=4).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(64 * v).astype(int) for i, v in enumerate(x)} | {404: np.zeros(6, int)}
    assert sorted(found) == list(range(0, 300, 20))
    for q, own in found.items():
        order = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(own) == [(k, i, -s) for k, (s, i) in enumerate(order, 1)]
    assert top_products(vectors.where("false"), F.col("vec_id") % 20 == 0).collect() == []


# -- pages --------------------------------------------------------------------------------------------


def test_cut_is_the_least_cost():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randrange(1, 8)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(n)]
        price = lambda keep: sum(max(0, -c) if k else max(0, c) for c, k in zip(cost, keep)) + sum(w for i, j, w in edges if keep[i] != keep[j])
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert abs(price(cut(cost, edges)) - best) < 1e-6


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><header><h1>The  title</h1></header><p>First &amp; best,
line<br>two&nbsp;here.<p><b>Second<p>Third.<script>var a="</p>";</script><div class=ad>Buy this now.</div>
<ul><li>One point.<li>Another.</ul><form><p>Your name, please.</form><section class="comments"><p>Nice article, thank you.</section>
</article></main><aside><p>Other long texts, and more.</aside><footer>&copy; Us</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == ["The title", "First & best, line two here.", "Second", "Third.", "One point.", "Another."]
    long = " ".join(f"Word {i}, and so on." for i in range(9000))
    assert main_text(f"<div><p>{long}</p></div><div><a href=x>Home</a></div>") == long  # no telling names
    assert main_text("<p>" * 3000 + "Deep text, still here.") == "Deep text, still here."


def test_extract_main_text(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, PAGE, "x"), (3, "u", "<article><p>A &am", "x"), (4, "u", "plain, short text.", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [r["text"] for r in extract_main_text(pages).collect()]
    assert got[:2] == ["", ""] and got[2].startswith("The title\n") and got[3] == "A &am"
    assert extract_main_text(pages.where("false")).collect() == []


def test_weights_are_learnt_from_large_tables(spark):
    many = spark.range(5_000_001).select(F.col("id").alias("page_id"), F.lit("<nav>Go</nav><article><p>Some text, here.</article>").alias("html"))
    few = fit_weights(many.where("page_id < 500"), "page_id", "html", 500)
    assert few != PRIOR and fit_weights(many, "page_id", "html", 500) == few  # all pages are alike
    assert fit_weights(many.where("page_id < 0"), "page_id", "html", 500) == PRIOR


def test_blocks_learnt_from_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("costspark.llm.main_text.learn_weights", lambda x, y: seen.append(len(x)) or PRIOR)
    page = "<nav>Go</nav><article>" + "<p>Some text, here." * 40 + "</article>"
    pages = spark.createDataFrame([(i, page) for i in range(9)], "page_id long, html string")
    fit_weights(pages, "page_id", "html", 500, sample_blocks=100)
    fit_weights(pages, "page_id", "html", 5)
    assert seen == [100, 5 * 41]


# -- conversations --------------------------------------------------------------------------------------


def test_render_is_read_back():
    rng = random.Random(3)
    bits = ["\\", "#", "###", "</turn>", ": ", " ", "\n", "a", "é", "😀", "</turn", "### assistant: "]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "", "a: b", "x\n### "]), "".join(rng.choices(bits, k=rng.randrange(12)))) for _ in range(4)]
        text, spans = render(turns)
        assert read_back(text) == turns
        assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_format_chats(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "Ünï 😀"), (1, 0, "user", "hi <|endoftext|>"), (1, 1, "assistant", None), (-7, 0, "user", said), (-7, 1, "assistant", said), (None, None, None, None), (2, 0, "assistant", "long text " * 5000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, conv string")
    got = {r["conv_id"]: r for r in format_chats(turns, at_once=2).collect()}
    learnt = {c: "".join(unescape(r["formatted"][a:b]) for a, b in r["loss_spans"]) for c, r in got.items()}
    assert learnt == {1: "Ünï 😀", -7: said, None: "", 2: "long text " * 5000}
    assert read_back(got[1]["formatted"]) == [("user", "hi <|endoftext|>"), ("assistant", ""), ("assistant", "Ünï 😀")]
    assert all(len(r["ids"]) == len(r["loss"]) for r in got.values()) and 50256 not in got[1]["ids"]
    assert format_chats(turns.where("false")).collect() == []


def test_format_chats_keeps_large_ids_beside_a_null(spark):
    ids = [2**60, 2**60 + 1, None, -5]
    turns = spark.createDataFrame([(i, 0, "user", f"of {i}") for i in ids], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: read_back(r["formatted"]) for r in format_chats(turns).collect()}
    assert got == {i: [("user", f"of {i}")] for i in ids}


def test_align_splits_tokens_at_turns():
    loss, covered = align(np.array([[0, 3], [3, 7], [7, 7], [7, 9]]), [(2, 5), (8, 9)])
    assert loss.tolist() == [True, True, False, True] and covered == [[2, 5], [8, 9]]


# -- pieces -----------------------------------------------------------------------------------------------


def test_piece_codec_equals_the_library():
    import sentencepiece

    path = public_path("piece_bpe_32k.model")
    own, plain, rng = codec(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    bits = ["a", "the", "ing", " ", "  ", "\n", "é", "日", "😀", "\t", "tion", ".", "23", "\0", "▁"]
    texts = ["", " ", "  a", "a  b ", "the " * 3000, "x" * 5000]
    texts += ["".join(rng.choice([*bits, chr(rng.randrange(32, 0x3000))]) for _ in range(25)) for _ in range(800)]
    for text, data in zip(texts, own.encode(texts)):
        ids = np.frombuffer(data, "<i4").tolist()
        assert ids == plain.encode(text) and own.decode(ids) == plain.decode(ids)


def test_piece_columns_equal_single_texts():
    """Texts of a column are looked up together; bytes that are no text become marks, in that row only."""
    import pyarrow as pa

    own = codec(public_path("piece_bpe_32k.model"))
    texts = ["a  b", "plain words here", "", "words ▁ marked", " begins", "plain words", "a\0b", "é 😀\n x"]
    flat, ends = own.encode_column(pa.array(texts))
    parts = [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    assert parts == [np.frombuffer(d, "<i4").tolist() for t in texts for d in own.encode([t])]
    broken = [own.byte_ids[0xC3], own.ids["▁a"]]
    rows = pa.array([[5], *parts, broken], pa.list_(pa.int32()))[1:]
    assert own.decode_column(rows).to_pylist() == [own.decode(ids) for ids in [*parts, broken]]
    assert own.decode(broken) == "\ufffd a" and len(own.encode_column(pa.array([], pa.string()))[0]) == 0


def test_piece_frames(docs, spark):
    rows = docs((1, None), (1, ""), (None, "ab  c"), (3, "日本 \n x"))
    back = {r["text"] for r in sp_decode(sp_encode(rows)).collect()}
    assert back == {"", "ab  c", "日本 \n x"}
    odd = spark.createDataFrame([(1, [5, None, -1, 10**6]), (2, None)], "doc_id long, ids array<int>")
    assert [r["ids"] for r in sp_decode(odd).collect()] == [[5], []]
    assert sp_encode(rows.where("false")).collect() == []


def test_piece_query(spark):
    import hashlib

    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    for r in queries.op5_sentencepiece(spark, SF).collect():
        ids = plain.encode(texts[r["doc_id"]])
        assert r["n_ids"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_token_pieces_of_odd_ids(docs):
    assert {r["doc_id"] for r in token_pieces(docs((None, "a"), (2, "b"))).collect()} == {None, 2}
