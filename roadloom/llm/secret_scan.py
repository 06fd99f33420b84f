"""Operator 1: secrets in texts.

Three fixed patterns give the base spans.  Beside them, candidate strings are scanned by a sliding window whose Shannon entropy is kept by incremental
counts: when the window moves by a character, one count falls, one rises, and the sum of c*log2(c) changes by two table entries.  Every candidate is
scanned, with a threshold for its kind of characters: hexadecimal, one case with digits, no digits, mixed.  An allow-list suppresses the windows that
touch what is known to be harmless: a word or UUID with the letters and digits around it, or a run of one character.  Windows that overlap make one span.  Sums are scaled
integers, so that results don't depend on the order of additions.  DataFrame functions only; nothing is shuffled.

Defined cases: a null or empty text has no spans and the checksum of the empty string; texts of any length are scanned whole; repeated rows are rows of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import let, table

# Fixed values of the base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Bits a character, from which a window is suspect: at most 4 for hexadecimal digits, log2(20) = 4.32 for others; fewer letters give fewer bits.
HEX_BITS, MIXED_BITS = 3.2, 4.0
ONE_CASE_BITS, LETTER_BITS = 3.7, 3.9
SCALE = 1_000_000
#: Harmless strings: UUIDs, alphabets and digits in order, placeholders, each with the letters and digits that it is part of; runs of one character.
_WORDS = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|abcdefghij|0123456789|example|placeholder|changeme|dummy"
ALLOWED = rf"(?i)(?<![0-9a-z])[0-9a-z]*?(?:{_WORDS})[0-9a-z]*|(.)\1{{7,}}"
#: What stands before a string and tells that it is a checksum or a picture, not a secret.
ALLOWED_BEFORE = r"(?i)(commit|md5|sha-?\d*|checksum|digest|integrity|uuid|etag|base64,)[\s:=\"'(-]*$"


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, before, found, value>> of a pattern's leftmost matches, from the pieces between them."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern == ASSIGN else found
    kind = "struct<start:int,end:int,before:string,found:string,value:string>"
    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.right(x["0"], F.lit(24)).alias("before"), x["1"].alias("found"), x["2"].alias("value")))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(f"array<{kind}>")), one).alias("out"))

    pieces = let(found, lambda f: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(f)).alias("0"), f.alias("1"), value.alias("2")))
    pieces = F.transform(pieces, lambda x: F.struct(x["0"].alias("0"), x["1"].alias("1"), x["2"].alias("2")))
    return F.when(text.rlike(pattern), F.coalesce(F.aggregate(pieces, begin, step, lambda acc: acc["out"]), F.array().cast(f"array<{kind}>"))).otherwise(F.array().cast(f"array<{kind}>"))


def _as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["found"].alias("text")))


def _terms() -> Column:
    return F.array(*(F.lit(round(SCALE * c * math.log2(c)) if c else 0).cast("long") for c in range(WINDOW + 1)))


def high_entropy(found: Column) -> Column:
    """array<struct<a, e>>: offsets within a candidate string that windows of high entropy cover."""
    is_hex = found.rlike("^[0-9a-f]+$|^[0-9A-F]+$")
    digits, mixed = found.rlike("[0-9]"), found.rlike("[0-9]") & found.rlike("[a-z]") & found.rlike("[A-Z]")
    most = {bits: F.lit(round(SCALE * WINDOW * (math.log2(WINDOW) - bits))) for bits in (HEX_BITS, MIXED_BITS, ONE_CASE_BITS, LETTER_BITS)}
    limit = F.when(is_hex, most[HEX_BITS]).when(mixed, most[MIXED_BITS]).when(digits, most[ONE_CASE_BITS]).otherwise(most[LETTER_BITS]).cast("long")
    part = "struct<a:int,e:int>"

    def scan(codes: Column, allowed: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def put(counts: Column, k: Column, by: int) -> Column:
                return F.concat(F.slice(counts, F.lit(1), k - 1), F.array((F.element_at(counts, k) + by).cast("int")), F.slice(counts, k + 1, F.lit(128) - k))

            def f(c: Column) -> Column:
                return F.element_at(terms_, c + 1)

            terms_ = acc["f"]
            new = F.element_at(codes, i + 1)

            def leave(counts: Column) -> Column:
                """The state's counts and sum without the character that falls out of the window."""
                old = F.element_at(codes, F.greatest(i - WINDOW + 1, F.lit(1)))
                c = F.element_at(counts, old)
                fell = F.struct(put(counts, old, -1).alias("n"), (acc["s"] - f(c) + f(c - 1)).alias("s"))
                return F.when(i >= WINDOW, fell).otherwise(F.struct(counts.alias("n"), acc["s"].alias("s")))

            def enter(x: Column) -> Column:
                c = F.element_at(x["n"], new)
                return F.struct(put(x["n"], new, 1).alias("n"), (x["s"] - f(c) + f(c + 1)).alias("s"))

            def mark(x: Column) -> Column:
                a, e = i - WINDOW + 1, i + 1
                hot = (i >= WINDOW - 1) & (x["s"] <= limit) & ~F.exists(allowed, lambda y: (y["start"] < e) & (a < y["end"]))
                apart = hot & (acc["e"] < a) & (acc["e"] > 0)
                return F.struct(
                    x["n"].alias("n"), x["s"].alias("s"), acc["f"].alias("f"),
                    F.when(hot & ((acc["e"] < a) | (acc["e"] == 0)), a).otherwise(acc["a"]).alias("a"), F.when(hot, e).otherwise(acc["e"]).alias("e"),
                    F.when(apart, F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["e"].alias("e"))))).otherwise(acc["out"]).alias("out"),
                )

            return let(let(leave(acc["n"]), enter), mark)

        start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0).cast("long").alias("s"), _terms().alias("f"), F.lit(0).alias("a"), F.lit(0).alias("e"), F.array().cast(f"array<{part}>").alias("out"))
        last = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step)
        return let(last, lambda x: F.when(x["e"] > 0, F.concat(x["out"], F.array(F.struct(x["a"].alias("a"), x["e"].alias("e"))))).otherwise(x["out"]))

    codes = F.transform(F.split(found, ""), lambda ch: F.ascii(ch))
    return let(codes, lambda c: let(_placed(found, ALLOWED), lambda allowed: scan(c, allowed)))


def secrets(text: Column) -> tuple[Column, Column]:
    """Arrays of struct<start, ord, end, kind, text>: the base spans, and those that the entropy scan adds outside of them."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_placed(text, ASSIGN), lambda x: F.length(x["value"]) >= 8)
    base = F.sort_array(F.concat(_as_spans(assign, "assign"), _as_spans(_placed(text, ACCESS), "access"), _as_spans(_placed(text, HEX), "hex")))
    able = F.filter(_placed(text, CANDIDATE), lambda x: ~x["before"].rlike(ALLOWED_BEFORE))

    def spans(x: Column) -> Column:
        hexed = x["found"].rlike("^[0-9a-f]+$|^[0-9A-F]+$")

        def one(y: Column) -> Column:
            return F.struct(
                (x["start"] + y["a"]).alias("start"), F.when(hexed, F.lit(3)).otherwise(F.lit(4)).alias("ord"), (x["start"] + y["e"]).alias("end"),
                F.when(hexed, F.lit(KINDS[3])).otherwise(F.lit(KINDS[4])).alias("kind"), F.substring(x["found"], y["a"] + 1, y["e"] - y["a"]).alias("text"),
            )

        return F.transform(high_entropy(x["found"]), one)

    return base, F.flatten(F.transform(able, spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (all of them, sorted): arrays of struct<start, ord, end, kind, text>; positions are code points, the end is exclusive."""
    base, more = secrets(F.col("text"))
    out = docs.select("doc_id", base.alias("base"), more.alias("more"))
    new = F.filter("more", lambda x: ~F.exists("base", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))
    return out.select("doc_id", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(F.sort_array(F.concat("base", new))).alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_entropy"))
