"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costspark.llm.chat import format_chats, read_back, unescape
from costspark.llm.exact_dedup import exact_dedup
from costspark.llm.line_dedup import line_dedup
from costspark.llm.main_text import extract_main_text
from costspark.llm.mtree import top_products
from costspark.llm.near_join import near_join
from costspark.llm.packing import pack
from costspark.llm.pii import KINDS, find_pii, learn_field, of_source
from costspark.llm.prefix_trie import build_trie, number_turns
from costspark.llm.secret_scan import secret_spans, span_text, with_spans
from costspark.llm.sp_codec import sp_decode, sp_encode
from costspark.llm.toxicity import toxicity
from costspark.llm.vector_codes import encode_vectors, learn_codebooks
from costspark.runtime import materialise, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1 = r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
        FROM documents),
    keyed AS (
        SELECT doc_id, line, place,
               translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
    marked AS (SELECT k.*, c.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3 = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secret_spans(docs)
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return with_spans(docs, spans).select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(span_text(of("assign", "access", "hex")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join(table(spark, sf_dir, "documents"), words=5, threshold=0.8)
    return found.select("doc_id", "class_id", "n_links", "set_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0)


OP4 = """
    WITH plain AS (
        SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM plain q JOIN plain c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text (joined by commas) and the text that they give back, as digests."""
    decoded = sp_decode(sp_encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations and their loss masks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for b in batches:
            rows = []
            for conv, text, spans in zip(b["conv_id"].tolist(), b["formatted"].tolist(), b["loss_spans"]):
                turns = read_back(text)
                learnt = "".join(unescape(text[s:e]) for s, e in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv, len(turns), sha(whole), len(learnt), sha(learnt), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    formatted = format_chats(turns).select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss_spans")
    return formatted.mapInPandas(read, schema).withColumn("conv_id", F.col("conv_id").cast("long"))


OP10 = r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(4 + 2 + 9
               + length(regexp_replace(role, '\\|###|</turn>|: ', 'x\0', 'g'))
               + length(regexp_replace(text, '\\|###|</turn>|: ', 'x\0', 'g'))) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id
"""


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, learn_field(docs))
    base = F.col("spans")
    return found.select(
        "doc_id",
        *(F.size(of_source(base, "base", k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(span_text(of_source(base, "base")), 256).alias("base_sha256"),
        span_text(base).alias("spans"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors; the total of a label comes to its rows by a join that Spark splits where skewed."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = learn_codebooks(vectors, parts=4, entries=256, rounds=4, scale=1024)
    coded = materialise(encode_vectors(vectors, books, keep=("label",)), scratch_path(spark, "vector-codes"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals.hint("merge"), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op12() -> str:
    distance = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
    assign = f"""SELECT id, p, any_value(x) AS x, min(({distance}) * 256 + e) AS best
                 FROM parts JOIN {{books}} USING (p) GROUP BY id, p"""
    steps = []
    for r in range(5):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(books=f'b{r}')})")
        if r < 4:
            steps.append(f"""m{r} AS (
                SELECT p, e, list(v ORDER BY i) AS c FROM (
                    SELECT p, CAST(best % 256 AS BIGINT) AS e, i, floor(sum(x[i]) / count(*)) AS v
                    FROM a{r}, range(1, 1 + len(x)) t(i) GROUP BY 1, 2, 3) GROUP BY p, e)""")
            steps.append(f"""b{r + 1} AS MATERIALIZED (
                SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
    WITH kept AS (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label,
               [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    parts AS MATERIALIZED (
        SELECT id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)),
    b0 AS MATERIALIZED (SELECT p, id - 1 AS e, x AS c FROM parts WHERE id <= 256),
    {", ".join(steps)},
    coded AS (
        SELECT id, string_agg(printf('%02x', CAST(best % 256 AS BIGINT)), '' ORDER BY p) AS code,
               CAST(sum(floor(best / 256)) AS BIGINT) AS error FROM a4 GROUP BY id),
    sha AS (
        SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS books
        FROM (SELECT p, e, i, c[i] AS v FROM b4, range(1, 1 + len(c)) t(i)))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256
    FROM kept JOIN coded USING (id) CROSS JOIN sha
    """


OP12 = _op12()


def _rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps and members of the conversations that begin with turns of the conversation 20 divides, as ``build_trie`` takes them."""
    heads = numbered.where("at < 3").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "words"))).alias("head"))
    heads = heads.withColumnRenamed("conv", "base")
    slices = numbered.where("first").select("conv", "slice", "n", "at")
    slices = slices.withColumn("h", (F.crc32(F.col("conv").cast("string")) % 4).cast("int")).withColumn("base", F.expr("conv - conv % 20"))
    led = slices.join(heads, "base", "left")
    led = led.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    led = led.withColumn("taken", F.size("head")).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    led = materialise(led, scratch_path(numbered.sparkSession, "trie-led"))
    own = numbered.join(led.select("conv", "slice", "h", "taken", "length"), ["conv", "slice"]).where("at >= h")
    own = own.select("conv", "slice", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "length", "digest", "words")
    begun = led.where("at = 0")
    head = begun.select("conv", F.lit(-1).alias("slice"), "length", F.posexplode("head").alias("i", "t"))
    head = head.select("conv", "slice", (F.col("i") + 1).cast("bigint").alias("depth"), "length", "t.digest", "t.words")
    return own.unionByName(head), begun.select("conv", "length")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, members = _rebuilt(number_turns(table(spark, sf_dir, "conversations")))
    nodes = build_trie(steps, members)
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


OP13 = r"""
    WITH RECURSIVE turns AS (
        SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS place, d, words FROM (
            SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
            FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS (
        SELECT DISTINCT c, c - c % 20 AS base,
               xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(CAST(c AS VARCHAR), '')]),
                   lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0::BIGINT FOR i IN range(8)]),
                       lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 4 AS h
        FROM turns),
    steps AS (
        SELECT v.c, t.place, t.d, t.words FROM convs v JOIN turns t ON t.c = v.base AND t.place < v.h
        UNION ALL SELECT v.c, t.place, t.d, t.words FROM convs v JOIN turns t ON t.c = v.c AND t.place >= v.h),
    ordered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY place) AS depth, d, words FROM steps),
    paths AS MATERIALIZED (
        SELECT c, 0::BIGINT AS depth, '' AS key, NULL::VARCHAR AS above, 0::BIGINT AS words FROM convs
        UNION ALL
        SELECT p.c, o.depth, sha256(p.key || o.d), p.key, o.words FROM paths p JOIN ordered o ON o.c = p.c AND o.depth = p.depth + 1),
    lengths AS (SELECT c, max(depth) AS length FROM paths GROUP BY c),
    nodes AS MATERIALIZED (
        SELECT depth, key, above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
               sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = length), '')) AS ends
        FROM paths JOIN lengths USING (c) GROUP BY depth, key, above),
    children AS (SELECT above AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
    below AS (
        SELECT p.key, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum(u.saved) AS saved
        FROM nodes u LEFT JOIN children k ON k.key = u.key JOIN paths p ON p.c = u.conv_id AND p.depth <= u.depth GROUP BY p.key)
    SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children,
           b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
    FROM nodes v LEFT JOIN nodes up ON up.key = v.above LEFT JOIN children k ON k.key = v.key JOIN below b ON b.key = v.key
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mtree_topk": op4_mtree_topk,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_ngram_join": op6_ngram_join,
    "op7_main_text": op7_main_text,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_chat_format": op10_chat_format,
    "op11_pii": op11_pii,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE = {
    "op1_line_dedup": OP1,
    "op3_exact_dedup": OP3,
    "op4_mtree_topk": OP4,
    "op10_chat_format": OP10,
    "op12_vector_codes": OP12,
    "op13_prefix_trie": OP13,
}
