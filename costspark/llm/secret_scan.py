"""Secrets in texts: fixed patterns, and tokens that look random to a pair of Markov models."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costspark.llm.sample import first_by_rank
from costspark.runtime import materialise, scratch_path

# The base patterns (letters of the key words in either case) and the
# smallest length of what counts; "token" is what the models judge.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
TOKEN = r"([A-Za-z0-9+/_-]{20,}={0,2})"
KINDS = ["assign", "access", "hex", "markov"]
ASCII = 128


def _candidates(rows: DataFrame) -> DataFrame:
    """``rows`` (id, version, text) to one row per match: kind, number, gap before it, length, value.

    ``split`` and ``regexp_extract_all`` find the same matches, so the lengths of gaps and
    matches give the places.  A cheap test comes first; most texts need no more.
    """
    text = F.col("text")
    patterns = [
        ("assign", ASSIGN, 2, (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & F.rlike(text, F.lit(ASSIGN))),
        ("access", ACCESS, 1, F.contains(text, F.lit("AKIA")) & F.rlike(text, F.lit(ACCESS))),
        ("hex", HEX, 1, F.rlike(text, F.lit(HEX))),
        ("markov", TOKEN, 1, F.rlike(text, F.lit(TOKEN))),
    ]
    parts = []
    for kind, pattern, group, has in patterns:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = whole if group == 1 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        parts.append(
            F.struct(
                F.lit(kind).alias("kind"),
                F.when(has, F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("n"), value.alias("value")))
                .alias("found"),
            )
        )
    return (
        rows.select("id", "version", F.inline(F.array(*parts)))
        .select("id", "version", "kind", F.posexplode("found").alias("at", "m"))
        .where("m.n IS NOT NULL")
        .select("id", "version", "kind", "at", "m.gap", "m.n", "m.value")
    )


def _pairs(chars: Column) -> Column:
    """Codes of neighbouring characters as one number; null at the end of the list."""
    return F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.ascii(a) * ASCII + F.ascii(b))


def _pair_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each pair of ASCII characters stands in ``value``: at most 128 x 128 numbers."""
    pairs = tokens.select(F.explode(_pairs(F.split("value", ""))).alias("pair")).where("pair IS NOT NULL")
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}


def log_ratios(random: dict[int, int], ordinary: dict[int, int], weight: float = 20.0) -> list[float]:
    """log P(next | this) under the model of random strings minus that of ordinary identifiers.

    A pair's share is drawn toward the share of its second character, as if that had been
    seen ``weight`` times: after a character that a model hardly knows, what is common stays likely.
    """
    letters = [i for i in range(ASCII) if chr(i).isalnum() or chr(i) in "+/_-="]
    out = [0.0] * (ASCII * ASCII)
    for sign, pairs in ((1, random), (-1, ordinary)):
        rows = {a: sum(pairs.get(a * ASCII + b, 0) for b in letters) for a in letters}
        columns = {b: sum(pairs.get(a * ASCII + b, 0) for a in letters) + 0.5 for b in letters}
        every = sum(columns.values())
        for a in letters:
            for b in letters:
                seen = pairs.get(a * ASCII + b, 0) + weight * columns[b] / every
                out[a * ASCII + b] += sign * log(seen / (rows[a] + weight))
    return out


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = 5000,
    threshold: float = 10.0,
    shortest_value: int = 6,
) -> DataFrame:
    """Spans of secrets: ``id_col``, ``version`` (hash of the text) and ``spans``, rows with a span only.

    ``spans`` is a list of (start, rank, kind, end) in code points, end exclusive, sorted by
    start and then by the order of ``KINDS``.  assign, access and hex are the fixed
    patterns.  markov is a token of 20 characters and more whose log-likelihood ratio
    between two character Markov models reaches ``threshold``.  The labelled samples: values
    of the fixed patterns in all documents are the random strings, words of 6 to 19
    characters in those of ``sample_docs`` documents (all, if there are no more; chosen by a
    hash of id and text) that have no such match the ordinary ones.  With no examples both
    models are uniform and markov finds nothing.

    The text is read once for the candidates (kept in the shared folder), once to hash it and
    once for the sample.  Rows that repeat id and text are found once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "version", F.xxhash64("text")
    )
    found = materialise(_candidates(rows), scratch_path(spark, "secret-candidates"))
    clean = first_by_rank(rows, F.xxhash64("id", "version", F.lit(9)), sample_docs).where(
        ~(F.rlike("text", F.lit(ASSIGN)) | F.rlike("text", F.lit(ACCESS)) | F.rlike("text", F.lit(HEX)))
    )
    words = clean.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]{6,})"), F.lit(1))).alias("value"))
    words = words.where(F.length("value") < 20)  # longer ones may be what is looked for
    ratios = log_ratios(
        _pair_counts(found.where(F.col("kind") != "markov").select("value")),
        _pair_counts(words),
    )
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    score = F.aggregate(
        _pairs(F.split("value", "")), F.lit(0.0), lambda s, k: s + F.coalesce(F.get(table, k), F.lit(0.0))
    )
    once = found.dropDuplicates(["id", "version", "kind", "at"])
    before = Window.partitionBy("id", "version", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("n")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    placed = once.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    counts = (
        F.when(F.col("kind") == "assign", F.length("value") >= shortest_value)
        .when(F.col("kind") == "markov", score >= threshold)
        .otherwise(True)
    )
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return (
        placed.where(counts)
        .groupBy("id", "version")
        .agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
        .withColumnRenamed("id", id_col)
    )


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``spans`` of ``secret_spans``; an empty list where there are none.

    The columns ``spans`` and ``version``, if ``docs`` has them, are replaced.
    """
    right = spans.select(F.col(id_col).alias("_id"), F.col("version").alias("_version"), F.col("spans").alias("_spans"))
    # The hash is a column before the join, so that a caller who needs no text moves none.
    left = docs.withColumn("_text_version", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = left[id_col].eqNullSafe(F.col("_id")) & (F.col("_text_version") == F.col("_version"))
    joined = left.join(right.hint("merge"), same, "left")  # spans grow with the documents
    none = F.array().cast(spans.schema["spans"].dataType)
    return joined.withColumn("spans", F.coalesce("_spans", none)).drop("_id", "_version", "_spans", "_text_version")


def span_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _joined(spans: Column) -> Column:
    """Runs of overlapping or touching spans (sorted by start) as one (start, end) each."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        own = F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)),
        ).otherwise(F.concat(done, F.array(own)))

    return F.aggregate(spans, none, add)


def redact(
    docs: DataFrame, spans: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with each run of overlapping spans in ``text_col`` replaced by ``mark``.

    Columns stay as they are, other texts too; a column named ``spans`` is not kept.
    """
    columns = [c for c in docs.columns if c != "spans"]
    held = with_spans(docs, spans, id_col, text_col).withColumn("_cut", _joined(F.col("spans")))
    zero, end = F.array(F.lit(0).cast("bigint")), F.array(F.length(text_col).cast("bigint"))
    between = F.zip_with(
        F.concat(zero, F.col("_cut.end")), F.concat(F.col("_cut.start"), end), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    part = lambda p: F.substring(F.col(text_col), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))
    text = F.when(F.size("_cut") > 0, F.array_join(F.transform(between, part), mark)).otherwise(F.col(text_col))
    return held.withColumn(text_col, text).select(*columns)
