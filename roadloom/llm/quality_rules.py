"""Operator 2: quality rules, of a document alone and of its lines across documents.

Rules of the document count words, symbols, repeated lines and words in repeated eight-word windows, each within the row.  Across documents, normalised
lines are hashed, the distinct documents that hold a line are counted for each host (the document's source), lines above the host's limit are taken out,
and a document that keeps too little is rejected.  `judged` shuffles hashes of lines, never texts.  DataFrame functions only.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; a document of frequent lines alone is
depleted; repeated rows (equal doc_id and text) are one document and get the same verdict; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import SPACES, free, held, join_hot, let, table, words

# Fixed values of the base rules.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30

#: A line is boilerplate of a host if it stands in more than this share of the host's documents, and in more than LEAST_DOCUMENTS of them.
LINE_SHARE, LEAST_DOCUMENTS = 0.05, 10
#: A document is depleted if fewer of its words than this share stay.
LEAST_KEPT = 0.3


def repeated_words(word_list: Column, window: int = WINDOW) -> Column:
    """Words in windows that a text holds twice or more, the first included: windows are hashed, equal neighbours in sorted order found, their cover counted."""

    def of(ws: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(ws) - (window - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(window)))), cover)

    def cover(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), joined))

    def joined(s: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

        places = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")), lambda a: a["n"])

    return F.when(F.size(word_list) > window, let(word_list, of)).otherwise(F.lit(0)).cast("long")


def _bare(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def normalised(line: Column) -> Column:
    """A line as it is compared across documents: lower case, digits alike, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def base_rules(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, doc_id, host, t (a hash of the document), the base counts, and lines: struct<hash, words> of each line with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), "doc_id", F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name")).alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, SPACES, "      ")) != "")
    d = d.select("row", "doc_id", "host", F.xxhash64("doc_id", "text").alias("t"), "text", words(F.col("text")).alias("ws"), lines.alias("ls"))
    return d.select(
        "row", "doc_id", "host", "t", F.size("ws").cast("long").alias("n_words"),
        F.length(_bare(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
        F.transform("ls", lambda x: let(normalised(x), lambda y: F.struct(F.xxhash64(y).alias("line"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("words")))).alias("lines"),
    )


def frequent_lines(base: DataFrame, share: float = LINE_SHARE, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(host, line) of lines that more than `share` of the host's documents hold, and more than `least` of them."""
    documents = base.groupBy("host").agg(F.count_distinct("t").alias("documents"))
    held_by = base.select("host", "t", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    # the pair and document first, then the pair: neither step gathers the rows of a hot line or host in a task
    counts = held_by.groupBy("host", "line", "t").agg(F.lit(1).alias("_")).groupBy("host", "line").count().where(F.col("count") > least)
    return join_hot(counts, documents, ["host"]).where(F.col("count") > F.col("documents") * F.lit(share)).select("host", "line")


def judged(docs: DataFrame, share: float = LINE_SHARE, least: int = LEAST_DOCUMENTS, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The base counts, words_removed (in frequent lines), base_failed and kept, for every row of docs."""
    base = held(base_rules(docs))
    frequent = held(frequent_lines(base, share, least))
    rows = base.select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    removed = join_hot(rows, frequent, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("removed"))
    out = base.drop("lines", "t", "host").join(removed, "row", "left").withColumn("words_removed", F.coalesce("removed", F.lit(0)).cast("long")).drop("removed", "row")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stay = F.col("n_words") - F.col("words_removed")
    depleted = stay < least_kept * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def cleaned(docs: DataFrame, share: float = LINE_SHARE, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs without the frequent lines in their texts; null texts stay null, rows and further columns are kept."""
    row, gone = free(docs, "_row", "_gone")
    own = held(docs.withColumn(row, F.monotonically_increasing_id()))
    base = held(base_rules(own, F.col(row)).select("row", "host", "t", "lines"))
    lines = base.select("row", "host", F.explode("lines.line").alias("line"))
    out = join_hot(lines, held(frequent_lines(base, share, least)), ["host", "line"]).groupBy("row").agg(F.collect_set("line").alias("gone")).toDF(row, gone)
    stay = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normalised(x))) | (F.trim(F.translate(x, SPACES, "      ")) == ""))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return own.join(out, row, "left").select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")
