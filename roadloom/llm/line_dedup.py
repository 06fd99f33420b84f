"""Operator 3: repeated passages, by a suffix array over words that prefix doubling names.

A sequence of whole lines misses passages that begin or end within a line, so the units are words.  Each has a fingerprint of 64 bits, and doubling makes
those of the 2, 4, 8, ... words from each position, the names by which suffixes are compared; any other length is two overlapping powers of two.  What is
wanted of the suffix array are the intervals of suffixes whose longest common prefix is `least_words` or more.  Those of exactly that depth contain all
deeper ones, and a maximal repeated run is the union of its windows of just so many words: so an interval is a name of that length that stands twice, its
suffixes are aggregated by name wherever they lie, and the first one in the order of documents stays.  The words of later ones go, with their lines where no
word of a line is left.

Only windows that can stand twice are named: equal windows have an equal least fingerprint of half their length at the same place, their anchor.  Anchors,
about one in thirteen words, are counted first; windows of anchors that stand once are left out.

No join has a name as its key, so a hot passage is one row for each task: what is alone, or first, is aggregated and brought back to its document.

Defined cases: words are compared, not the white space between them; a line that loses some of its words keeps the others; lines without a word stay
unless the words before and behind them go; later copies that overlap the first one in the same document lose only what lies beyond it; a null doc_id
comes last in order, and of repeated rows (equal doc_id and text) one comes first, by a hash of its other columns; null texts stay null; a text that is a
copy as a whole becomes empty; an empty table gives an empty result; further columns are kept, but for those named like the result's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch, free, held, join_hot, lean, ranked, table

LEAST_WORDS = 50
#: Bytes of text that are looked at together in a Python worker.
TOGETHER = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
CUT = "text string, lines bigint, words bigint"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_prints(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each word of texts that lie one behind the other, and the number of its text."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    new = solid.copy()
    new[1:] &= ~solid[:-1]
    at = bounds[:-1][bounds[:-1] < len(data)]
    new[at] = solid[at]
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(new[solid])  # of each word, among the bytes that aren't white space
    size = np.diff(np.append(first, np.count_nonzero(solid)))
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    terms = (data[solid].astype(np.uint64) + np.uint64(1)) * power[np.arange(int(size.sum())) - np.repeat(first, size)]
    return mixed(np.add.reduceat(terms, first)), np.searchsorted(bounds, starts, "right") - 1


def run_prints(words: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of the n words from each position, by doubling."""
    out, have = words, 1
    while have < n:
        step = min(have, n - have)
        out = mixed(out[:-step] * np.uint64(0xD6E8FEB86659FD93) + out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def least_places(x: np.ndarray, n: int) -> np.ndarray:
    """The place of the leftmost least value among the n from each position."""
    out, have = np.arange(len(x)), 1
    while have < n:
        step = min(have, n - have)
        a, b = out[:-step] if len(out) > step else out[:0], out[step:]
        out, have = np.where(x[a] <= x[b], a, b), have + step
    return out


def _anchored(words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of half the length; for each position, its window's anchor, and whether the window lies in one text."""
    half = (least + 1) // 2
    prints = run_prints(words, half)
    place = least_places(prints, least - half + 1)
    return prints, place, doc[: len(place)] == doc[least - 1 : least - 1 + len(place)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows whose texts are about TOGETHER bytes: themselves, their words' fingerprints, each word's row, and each row's first word."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").cast(pa.large_string())
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        cuts = np.flatnonzero(np.diff((offsets - offsets[0]) // TOGETHER)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            if a < b:
                prints, doc = word_prints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield batch.slice(a, b - a), prints, doc, np.searchsorted(doc, np.arange(b - a))


def _listed(rows: pa.RecordBatch, names: list[str], doc: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    """Columns of the rows, and values as arrays of the row that they are of."""
    offsets = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values.values()]
    return pa.RecordBatch.from_arrays([rows.column(n) for n in names] + lists, names=[*names, *values])


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, doc, first in _pieces(batches):
            prints, place, whole = _anchored(words, doc, least)
            at = np.unique(place[whole])
            own = doc[at]
            out = _listed(rows, ["doc_id", "rk", "tk"], own, h=prints[at].view(np.int64), p=(at - first[own]).astype(np.int32))
            yield out.append_column("n", pa.array(np.bincount(doc, minlength=rows.num_rows).astype(np.int32)))

    return run


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, doc, first in _pieces(batches):
            _, place, whole = _anchored(words, doc, least)
            twice = np.zeros(len(words), bool)
            lists = rows.column("twice")
            twice[lists.flatten().to_numpy() + np.repeat(first, lists.value_lengths().to_numpy())] = True
            at = np.flatnonzero(whole & twice[place])
            own = doc[at]
            yield _listed(rows, ["d", "rk", "tk"], own, h=run_prints(words, least)[at].view(np.int64), p=(at - first[own]).astype(np.int32))

    return run


def _later(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for h, p, own in zip(frame["h"], frame["p"], frame["own"], strict=True):
                if len(own) == len(p):
                    out.append(None)
                    continue
                stays = np.isin(p, own)
                first = dict(zip(h[stays], p[stays], strict=True))
                start, stop = p[~stays].astype(np.int64), p[~stays].astype(np.int64) + least
                if first:  # later copies in the document of the first one
                    start = np.maximum(start, [first.get(x, -least) + least for x in h[~stays]])
                some = start < stop
                gone = np.zeros(int(p[-1]) + least + 1, np.int64)
                np.add.at(gone, start[some], 1)
                np.add.at(gone, stop[some], -1)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(gone) > 0).astype(np.int8)))))
                out.append(edges.astype(np.int32) if len(edges) else None)
            frame["cuts"] = pd.Series(out, frame.index, object)
            yield frame.loc[frame["cuts"].notna(), ["rk", "tk", "cuts"]]

    return run


def cut(text: str, edges: np.ndarray) -> tuple[str, int, int]:
    """The text without its words from edges[0] to edges[1], from edges[2] to edges[3], ..., how many lines went as a whole, and how many words."""
    gone = np.zeros(edges[-1] + 1, bool)
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        gone[a:b] = True
    out, at, lines = [], 0, 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        n = len(line.split())
        if not n:
            if not (0 < at < len(gone) and gone[at - 1] and gone[at]):
                out.append(line)
            continue
        own, at = gone[at : at + n], at + n
        if not own.any():
            out.append(line)
        elif len(own) == n and own.all():
            lines += 1
        else:
            spans = [m.span() for m in WORD.finditer(line)]
            kept = np.flatnonzero(~np.concatenate((own, np.zeros(n - len(own), bool))))
            runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1)
            out.append(b" ".join(line[spans[r[0]][0] if r[0] else 0 : spans[r[-1]][1] if r[-1] < n - 1 else len(line)] for r in runs))
    return b"\n".join(out).decode("utf-8", "surrogatepass"), lines, int(gone.sum())


def _cut_udf():
    @F.pandas_udf(CUT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from lean(each)(batches)

    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, edges in batches:
            yield pd.DataFrame([(None, 0, 0) if t is None or e is None else cut(t, e) for t, e in zip(text, edges, strict=True)], columns=["text", "lines", "words"])

    return run


def _places(rows: DataFrame) -> DataFrame:
    """rows (d, h, p) to (h, at), at being a document's number and a place in it."""
    return rows.select("d", F.explode(F.arrays_zip("h", "p")).alias("x")).select("x.h", (F.shiftleft("d", 32) + F.col("x.p")).alias("at"))


def _by_document(at: DataFrame, out: str) -> DataFrame:
    return at.groupBy(F.shiftright("at", 32).alias("d")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit(2**32 - 1)).cast("int")).alias(out))


def later_copies(docs: DataFrame, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame | None]:
    """(rk, tk, cuts) of documents with later copies, cuts being the first word and the one behind the last, in turns; and (rk, tk, n), n words, of those that
    are there several times, None if there are none.  rk and tk are hashes of doc_id and text."""
    scratch = Scratch(docs.sparkSession, "passages")
    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64(F.lit(7), "text").alias("tk"))
    found = scratch.put(texts.mapInArrow(lean(_anchors(least_words)), "doc_id bigint, rk bigint, tk bigint, h array<bigint>, p array<int>, n int").where("size(h) > 0"))
    again = found.groupBy("rk", "tk").agg(F.max("n").alias("n"), F.count("*").alias("c")).where("c > 1").select("rk", "tk", "n")
    again = held(again) if again.take(1) else None
    single = found if again is None else found.dropDuplicates(["rk", "tk"])
    placed = ranked(single, [F.col("doc_id").asc_nulls_last(), F.col("tk"), F.col("rk")], "d")
    scratch.drop(found)
    numbered = scratch.put(placed)
    scratch.drop(placed._under)
    alone = _places(numbered).groupBy("h").agg(F.min("at").alias("at"), F.max("at").alias("last")).where("at = last")
    twice = numbered.join(_by_document(alone, "alone"), "d", "left").select("d", "rk", "tk", F.when(F.col("alone").isNull(), F.col("p")).otherwise(F.array_except("p", "alone")).alias("twice"))
    twice = scratch.put(twice.where("size(twice) > 0"))
    scratch.drop(numbered)
    single = texts if again is None else texts.dropDuplicates(["rk", "tk"])
    windows = single.join(twice.hint("merge"), ["rk", "tk"]).select("d", "rk", "tk", "text", "twice")
    windows = scratch.put(windows.mapInArrow(lean(_windows(least_words)), "d bigint, rk bigint, tk bigint, h array<bigint>, p array<int>").where("size(h) > 0"))
    scratch.drop(twice)
    first = _by_document(_places(windows).groupBy("h").agg(F.min("at").alias("at")), "own")
    judged = windows.join(first, "d", "left").select("rk", "tk", "h", "p", F.coalesce("own", F.array().cast("array<int>")).alias("own"))
    cuts = held(judged.mapInPandas(lean(_later(least_words)), "rk bigint, tk bigint, cuts array<int>"))
    scratch.drop(windows)
    return cuts, again


def _later_rows(own: DataFrame, again: DataFrame, rk: str, tk: str, whole: str) -> DataFrame:
    """own with `whole`: how many words go from a row that is there earlier with equal doc_id and text, else null."""
    keys = again.toDF(rk, tk, whole)
    tag, order, first = free(own, "_tag", "_order", "_first")
    plain = [c for c, kind in own.dtypes if "map<" not in kind and "variant" not in kind]
    rows = held(join_hot(own, keys, [rk, tk]).withColumns({tag: F.monotonically_increasing_id(), order: F.xxhash64(*plain)}))
    least = rows.groupBy(rk, tk).agg(F.min(F.struct(order, tag)).alias(first))
    rows = join_hot(rows, least, [rk, tk]).withColumn(whole, F.when(F.struct(order, tag) != F.col(first), F.col(whole)))
    others = own.join(keys.select(rk, tk), [rk, tk], "left_anti").withColumn(whole, F.lit(None).cast("int"))
    return others.unionByName(rows.select(*others.columns))


def _cut_texts(docs: DataFrame, least_words: int, lines: str, words: str) -> DataFrame:
    """docs with their texts cut, and how many lines (as a whole) and words went."""
    cuts, again = later_copies(docs, least_words)
    rk, tk, edges, whole, new = free(docs, "_rk", "_tk", "_edges", "_whole", "_new")
    own = docs.withColumns({rk: F.xxhash64("doc_id", "text"), tk: F.xxhash64(F.lit(7), "text")})
    if again is not None:
        own = _later_rows(own, again, rk, tk, whole)
    joined = own.join(cuts.toDF(rk, tk, edges).hint("merge"), [rk, tk], "left")
    if again is not None:
        joined = joined.withColumn(edges, F.when(F.col(whole).isNotNull(), F.array(F.lit(0), F.col(whole))).otherwise(F.col(edges)))
    joined = joined.withColumn(new, _cut_udf()(F.when(F.col(edges).isNotNull(), F.col("text")), F.col(edges)))
    text = F.when(F.col(edges).isNull(), F.col("text")).otherwise(F.col(f"{new}.text"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), F.col(f"{new}.lines").alias(lines), F.col(f"{new}.words").alias(words))


def deduped(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with their texts cut, and removed_lines (those that went as a whole) and removed_words."""
    return _cut_texts(docs.drop("removed_lines", "removed_words"), least_words, "removed_lines", "removed_words")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs (with their columns alone) with cut texts; documents that lost words and have none left are dropped, n_chars follows the text."""
    lines, words = free(docs, "_lines", "_words")
    out = _cut_texts(docs, least_words, lines, words)
    out = out.where((F.col(words) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        shorter = F.when(F.col(words) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", shorter)
    return out.select(*docs.columns)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduped(docs).select("doc_id", "removed_lines", "removed_words", "text")
