"""Operator 7: a Jaccard join of word n-grams by PartEnum signatures.

Sets whose sizes may go together share a size band.  Within a band, two sets with the wanted similarity differ in at most k features.  The feature domain
is dealt to k // 2 + 1 parts, so in at least one of them the sets differ in one feature at most; each part is dealt to three smaller ones, and two of
these are the same in both sets.  So a signature is the hash of a set's features in one of the three pairs of smaller parts, and each set has all three
for each part.  Pairs without features say nothing; spare parts make up for them, and sets with more parts that have such a pair than there are spare
ones sign again under another seed (sets that have too many under every seed sign their band).  So no similar pair is missed, and each signature covers
several features, so few others meet.

Equal sets are one node from the start.  Signatures travel in packed blocks, a node's once from each task.  In each bucket all nodes are compared with
a leader, and components of the links found; buckets that still hold several components choose further leaders, at most AT_ONCE a round, until every
pair of a bucket is compared or in one component.  Pairs that can't link are never made: features that no other set of a large bucket has count as
differences, so does what the sizes of the rest differ by, and so do the bits of an odd sketch.  Buckets of at most LEADERS + 1 nodes give all pairs.

Defined cases: A-Z are lowered; a text of fewer words than the n-gram is one feature; texts without words, or null, have no features and link with
nothing; repeated rows are linked; a null doc_id is never a component's id unless all of a component's are null; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch, free, held, join_hot, lean, shuffle_partitions, table
from roadloom.llm.graph import components

SEEDS, LEADERS, AT_ONCE, BITMAP_BITS = 3, 16, 4096, 23
#: Second-level parts of each first-level one; signatures are of all but one of them.
SECOND = 3
#: Signatures that are put together at once.
AT_A_TIME = 500_000
#: Sets that a worker remembers as sent.
REMEMBERED = 200_000
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Stafford's variant of the 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to its 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, n: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out += mixed(h[k : len(h) - width + 1 + k] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
    return np.unique(mixed(out + np.uint64(width)))


class Bands:
    """Size bands for pairs with similarity of at least p/q: the smaller set's size is in [low, high) of the band, the larger one's up to high*q/p."""

    def __init__(self, similarity: Fraction, ratio: Fraction = Fraction(3, 2), spare: float = 0.1):
        self.p, self.q, self.ratio, self.spare = similarity.numerator, similarity.denominator, ratio, spare
        self.lows, self.k = [1], []

    def reach(self, size: int) -> None:
        while self.lows[-1] <= size:
            high = max(self.lows[-1] + 1, int(self.lows[-1] * self.ratio))
            self.k.append((high - 1) * (self.q - self.p) // self.p)
            self.lows.append(high)

    def of(self, size: int) -> list[int]:
        """The bands that a set of this size takes part in."""
        self.reach(size)
        own = int(np.searchsorted(self.lows, size, "right")) - 1
        out = [own]
        while own and (self.lows[own] - 1) * self.q >= size * self.p:
            own -= 1
            out.append(own)
        return out

    def parts(self, band: int) -> tuple[int, int]:
        """How many first-level parts the domain has, and how many of them may have an empty pair of second-level parts."""
        spare = round(self.spare * self.k[band] / 2)
        return self.k[band] // 2 + 1 + spare, spare


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of all sets, which mustn't be empty."""
    owner, band = [], []
    for i, s in enumerate(sets):
        for b in bands.of(len(s)):
            owner.append(i)
            band.append(b)
    owner, band, found = np.array(owner, np.int64), np.array(band, np.int64), []
    for seed in range(SEEDS):
        if not len(owner):
            break
        n = np.array([bands.parts(b)[0] for b in band], np.int64)
        spare = np.array([bands.parts(b)[1] for b in band], np.int64)
        whole = np.array([bands.k[b] == 0 for b in band])  # equal sets alone are similar: one signature, of all features
        start = np.concatenate(([0], np.cumsum(n)))
        sizes = np.array([len(sets[i]) for i in owner], np.int64)
        flat = mixed(np.concatenate([sets[i] for i in owner]) + np.uint64(0xD1B54A32D192ED03 * (seed + 1) & 0xFFFFFFFFFFFFFFFF))
        first = np.repeat(start[:-1], sizes) + ((flat >> np.uint64(32)) % np.repeat(n, sizes).astype(np.uint64)).astype(np.int64)
        second = np.where(np.repeat(whole, sizes), 0, ((flat & np.uint64(0xFFFFFFFF)) % np.uint64(SECOND)).astype(np.int64))
        slot = first * SECOND + second
        total, full = np.zeros(start[-1] * SECOND, np.uint64), np.bincount(slot, minlength=start[-1] * SECOND).reshape(-1, SECOND)
        np.add.at(total, slot, mixed(flat))
        total = total.reshape(-1, SECOND)
        member = np.repeat(np.arange(len(owner)), n)
        part = np.arange(start[-1]) - start[:-1][member]
        weak = np.zeros(len(member), bool)
        for j, (a, b) in enumerate(combinations(range(SECOND), SECOND - 1)):
            some = full[:, a] + full[:, b]
            place = (band[member].astype(np.uint64) << np.uint64(40)) + (part.astype(np.uint64) << np.uint64(8)) + np.uint64(seed * 16 + j)
            sig = mixed(total[:, a] + total[:, b] + mixed(place + some.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            able = ~whole[member] if j else np.ones(len(member), bool)
            weak |= able & (some == 0)
            keep = able & (some > 0)
            found.append((owner[member[keep]], sig[keep]))
        again = np.bincount(member[weak], minlength=len(owner)) > spare
        owner, band = owner[again], band[again]
    if len(owner):
        found.append((owner, mixed(band.astype(np.uint64) + np.uint64(0xABCDEF1234567))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _combined(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (signature, node) rows: those to be dealt by signature, and those that stay behind.

    Where more than LEADERS + 1 nodes of one batch share a signature, only the first is dealt, with a mark (node 0) that there are others.
    """
    packed = packed[np.lexsort((packed[:, 1], packed[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], packed[1:, 0] != packed[:-1, 0])))
    size = np.diff(np.concatenate((first, [len(packed)])))
    hot = np.repeat(size > LEADERS + 1, size)
    leads = np.zeros(len(packed), bool)
    leads[first] = True
    behind = hot & ~leads
    marks = packed[first[size > LEADERS + 1]].copy()
    marks[:, 1] = 0
    return np.concatenate((packed[~behind], marks)), packed[behind]


def _block(packed: np.ndarray) -> bytes:
    """(signature, node) rows as bytes: how many signatures and nodes there are, the signatures, the nodes, and each signature's node by its place."""
    nodes, place = np.unique(packed[:, 1], return_inverse=True)
    kind = np.uint16 if len(nodes) <= 1 << 16 else np.uint32
    return np.array([len(packed), len(nodes)], np.uint64).tobytes() + packed[:, 0].tobytes() + nodes.tobytes() + place.astype(kind).tobytes()


def _rows_of(block: bytes) -> np.ndarray:
    rows, nodes = map(int, np.frombuffer(block, np.uint64, 2))
    place = np.frombuffer(block, np.uint16 if nodes <= 1 << 16 else np.uint32, rows, 16 + 8 * (rows + nodes))
    return np.column_stack((np.frombuffer(block, np.uint64, rows, 16), np.frombuffer(block, np.uint64, nodes, 16 + 8 * rows)[place]))


SIGNED = "part int, doc_id bigint, text_key bigint, n bigint, node bigint, block binary"


def _signer(n: int, similarity: Fraction, parts: int, features: int = 200_000):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bands, sent = Words(), Bands(similarity), set()
        for frame in batches:
            start = 0
            texts = frame["text"].tolist()
            while start < len(frame):
                sets, total, stop = [], 0, start
                while stop < len(frame) and total < features:
                    sets.append(shingles(texts[stop], n, known))
                    total += len(sets[-1])
                    stop += 1
                part = frame.iloc[start:stop]
                nodes = np.array([int(s.sum(dtype=np.uint64)) ^ len(s) if len(s) else 0 for s in sets], np.uint64)
                nodes = np.where([len(s) > 0 for s in sets], mixed(nodes), np.uint64(0)).astype(np.int64)
                yield pd.DataFrame({"part": (np.arange(start, stop) % parts).astype(np.int32), "doc_id": part["doc_id"].astype("Int64"), "text_key": part["text_key"], "n": [len(s) for s in sets], "node": nodes, "block": None})
                fresh, own = [], []
                for i, s in enumerate(sets):
                    if len(s) and int(nodes[i]) not in sent:
                        if len(sent) > REMEMBERED:
                            sent.clear()
                        sent.add(int(nodes[i]))
                        fresh.append(s)
                        own.append(nodes[i])
                who, sig = signatures(fresh, bands) if fresh else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                if len(sig):
                    packed = np.empty((len(sig), 2), np.uint64)
                    packed[:, 0], packed[:, 1] = sig, np.array(own, np.int64)[who].astype(np.uint64)
                    packed, local = _combined(packed)
                    if len(local):
                        yield pd.DataFrame({"part": (np.arange(len(local)) % parts).astype(np.int32), "doc_id": pd.array([None] * len(local), "Int64"), "text_key": 0, "n": -2, "node": local[:, 1].astype(np.int64), "block": [x.tobytes() for x in local[:, 0]]})
                    to = (packed[:, 0] % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    packed = packed[order]
                    ends = np.searchsorted(to[order], np.arange(parts + 1))
                    used = [p for p in range(parts) if ends[p] < ends[p + 1]]
                    yield pd.DataFrame({"part": np.array(used, np.int32), "doc_id": pd.array([None] * len(used), "Int64"), "text_key": 0, "n": -1, "node": 0, "block": [_block(packed[ends[p] : ends[p + 1]]) for p in used]})
                start = stop

    return sign


MET = "kind int, doc_id bigint, text_key bigint, n bigint, node bigint, other bigint"
DOCUMENT, PAIR, ENTRY = 0, 1, 2


def _rows(kind: int, node: np.ndarray, other: np.ndarray) -> Iterator[pd.DataFrame]:
    for k in range(0, len(node), 200_000):
        x, y = node[k : k + 200_000].astype(np.int64), other[k : k + 200_000].astype(np.int64)
        yield pd.DataFrame({"kind": kind, "doc_id": pd.array([None] * len(x), "Int64"), "text_key": 0, "n": -1, "node": x, "other": y})


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents pass; buckets of at most LEADERS + 1 nodes give their pairs, of larger ones the entries (node, signature) stay."""
    blocks = []
    for frame in batches:
        docs = frame[frame["n"] >= 0]
        if len(docs):
            yield docs[["doc_id", "text_key", "n", "node"]].assign(kind=DOCUMENT, doc_id=docs["doc_id"].astype("Int64"), other=0)[["kind", "doc_id", "text_key", "n", "node", "other"]]
        behind = frame[frame["n"] == -2]
        if len(behind):
            node, sig = behind["node"].to_numpy(np.int64), np.frombuffer(b"".join(behind["block"]), np.uint64)
            yield from _rows(ENTRY, node, sig)
        blocks += list(frame.loc[frame["n"] == -1, "block"])
    rows = sum(int(np.frombuffer(b, np.uint64, 1)[0]) for b in blocks)
    rounds = -(-rows // AT_A_TIME)
    for turn in range(rounds):  # packed blocks are what is held; of the signatures in them, a share at a time is taken out
        own = [x[mixed(x[:, 0]) % np.uint64(rounds) == turn] if rounds > 1 else x for x in map(_rows_of, blocks)]
        yield from _buckets(np.concatenate(own))


def _buckets(all_: np.ndarray) -> Iterator[pd.DataFrame]:
    """All rows (signature, node) of some signatures, to pairs and entries."""
    all_ = all_[np.lexsort((all_[:, 1], all_[:, 0]))]
    all_ = all_[np.concatenate((np.ones(min(1, len(all_)), bool), (all_[1:] != all_[:-1]).any(1)))]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(all_)), bool), all_[1:, 0] != all_[:-1, 0])))
    size = np.diff(np.concatenate((first, [len(all_)])))
    marked = all_[first, 1] == 0
    small = ~marked & (size <= LEADERS + 1)
    pairs = []
    for m in range(2, LEADERS + 2):
        at = first[small & (size == m)]
        for i in range(m):
            for j in range(i + 1, m):
                pairs.append(np.column_stack((all_[at + i, 1], all_[at + j, 1])))
    for g in np.flatnonzero(~small):
        own = all_[first[g] + marked[g] : first[g] + size[g]]
        yield from _rows(ENTRY, own[:, 1], own[:, 0])
    if pairs:
        both = np.unique(np.concatenate(pairs), axis=0)
        yield from _rows(PAIR, both[:, 0], both[:, 1])


def _texts_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))


SKETCH = [f"p{i}" for i in range(8)]
SETS = "node bigint, s bigint, " + ", ".join(f"{c} bigint" for c in SKETCH) + ", features binary"


def _sketch(features: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the features that fall to it."""
    bits = np.bincount((mixed(features + np.uint64(77)) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _filler(n: int, bitmap) -> object:
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bits, sent = Words(), np.frombuffer(bitmap.value, np.uint8), set()
        for frame in batches:
            keys = frame["text_key"].to_numpy(np.int64).astype(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)
            hit = (bits[(keys >> np.uint64(3)).astype(np.int64)] >> (keys & np.uint64(7)).astype(np.uint8)) & 1
            out = []
            for text in frame["text"][hit > 0]:
                s = shingles(text, n, known)
                node = int(mixed(np.array([int(s.sum(dtype=np.uint64)) ^ len(s)], np.uint64)).astype(np.int64)[0]) if len(s) else 0
                if len(s) and node not in sent:
                    if len(sent) > REMEMBERED:
                        sent.clear()
                    sent.add(node)
                    out.append((node, len(s), *_sketch(s), s.tobytes()))
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=["node", "s", *SKETCH, "features"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["node", "s", *SKETCH, "features"])

    return fill


def _compare(p: int, q: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            like = []
            for x, y in zip(frame["fa"], frame["fb"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                if len(a) * q < len(b) * p:
                    like.append(False)
                    continue
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                like.append(q * both >= p * (len(a) + len(b) - both))
            yield frame.loc[np.array(like, bool), ["a", "b"]]

    return compare


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _room(p: int, q: int):
    """Whether the sizes s and s_a, with u and u_a features that no other set has, leave room for the similarity: such features, and what the sizes of
    the rest differ by, are differences."""
    least = F.col("u") + F.col("u_a") + F.abs(F.col("s") - F.col("u") - F.col("s_a") + F.col("u_a"))
    return least * (q + p) <= (F.col("s") + F.col("s_a")) * (q - p)


def _alike(p: int, q: int):
    """Whether sizes and odd sketches leave room: a difference turns one of 512 bits, so sets differ by as many features as bits at least."""
    turned = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in SKETCH), F.lit(0))
    sizes = (F.col("s") * q >= F.col("s_a") * p) & (F.col("s_a") * q >= F.col("s") * p)
    return sizes & (turned * (q + p) <= (F.col("s") + F.col("s_a")) * (q - p))


def _close(p: int, q: int):
    return _room(p, q) & _alike(p, q)


def _as_other(*more) -> list:
    return [F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("s", "u", *SKETCH)), *more]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        sets = [np.frombuffer(x, np.int64) for x in frame["features"]]
        yield pd.DataFrame({"node": np.repeat(frame["node"].to_numpy(), [len(x) for x in sets]), "f": np.concatenate(sets) if sets else np.zeros(0, np.int64)})


def _able(entries: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Large buckets' entries (sig, node, s, u, sketch) that may link with another of the same bucket: s is the set's size, u the number of its features
    that no other set of a large bucket has."""
    own = sets.join(entries.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    alone = own.select("node", "features").mapInPandas(lean(_features), "node bigint, f bigint").groupBy("f").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    sizes = own.select("node", "s", *SKETCH).join(alone.groupBy("node").agg(F.count("*").alias("u")), "node", "left")
    sizes = sizes.withColumn("u", F.coalesce("u", F.lit(0))).where((F.col("s") - F.col("u")) * q >= F.col("s") * p)
    rows = held(entries.join(sizes, "node").select("sig", "node", "s", "u", *SKETCH))
    # kinds of sets in a bucket are few, its sets may be many
    kinds = held(rows.groupBy("sig", "s", "u").agg(F.count("*").alias("c")))
    other = kinds.select("sig", F.col("s").alias("s_a"), F.col("u").alias("u_a"))
    same = (F.col("s") == F.col("s_a")) & (F.col("u") == F.col("u_a"))
    fine = kinds.join(other, "sig").where(_room(p, q) & (~same | (F.col("c") > 1))).select("sig", "s", "u").distinct()
    return join_hot(rows, fine, ["sig", "s", "u"])


def _bitmap(keys: DataFrame) -> bytes:
    """A bit for each key's last BITMAP_BITS bits: the same size for any input."""
    k = F.col("text_key").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = keys.select(k.alias("k")).groupBy(F.shiftright("k", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out.tobytes()


class Joined:
    """The join's result: docs (doc_id, text_key, n, node), one row a document, and roots (node, root) of the nodes with links."""

    def __init__(self, docs: DataFrame, roots: DataFrame):
        self.docs, self.roots = docs, roots


def join(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5)) -> Joined:
    spark, p, q = docs.sparkSession, similarity.numerator, similarity.denominator
    scratch, parts = Scratch(spark, "jaccard"), shuffle_partitions(spark)
    keyed = _texts_key(docs)
    met = scratch.put(keyed.mapInPandas(lean(_signer(n, similarity, parts)), SIGNED).repartition(parts, "part").drop("part").mapInPandas(lean(_meet), MET))
    rows = met.where(F.col("kind") == DOCUMENT).select("doc_id", "text_key", "n", "node")
    whole = met.where(F.col("kind") == ENTRY).select(F.col("other").alias("sig"), "node")
    pairs = held(_ordered(met.where(F.col("kind") == PAIR).select(F.col("node").alias("a"), F.col("other").alias("b"))))
    # the sets of nodes that met another: their texts are known by a bitmap of fixed size, so texts are neither shuffled nor all taken apart again
    near = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(whole.select("node")).distinct()
    sent = spark.sparkContext.broadcast(_bitmap(join_hot(rows, near, ["node"]).select("text_key")))
    sets = scratch.put(keyed.select("text", "text_key").mapInPandas(lean(_filler(n, sent)), SETS))  # a node's set may be there from several tasks
    sent.unpersist()
    marks = scratch.put(sets.select("node", "s", *SKETCH).dropDuplicates(["node"]))
    other = marks.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("s", *SKETCH)))
    pairs = pairs.join(other, "a").join(marks.withColumnRenamed("node", "b"), "b").where(_alike(p, q)).select("a", "b")
    whole = held(_able(whole, sets, p, q))
    links = roots = compared = None
    lead = whole.groupBy("sig").agg(F.min(F.struct("u", "node", "s", *SKETCH)).alias("x"), F.count("*").alias("c")).where("c > 1")
    lead = lead.select("sig", "x.*").select("sig", *_as_other())
    star = join_hot(whole, lead, ["sig"]).where((F.col("a") != F.col("node")) & _close(p, q)).select("a", F.col("node").alias("b"))
    pairs = held(pairs.union(_ordered(star)).distinct())  # each node with its buckets' leaders, and small buckets whole
    led = held(lead.select("sig", F.col("a").alias("node")))
    last = not whole.take(1)
    while True:
        used = sets.select("node", "features").join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node"])
        one = pairs.join(used.withColumnsRenamed({"node": "a", "features": "fa"}).hint("merge"), "a")
        new = held(one.join(used.withColumnsRenamed({"node": "b", "features": "fb"}).hint("merge"), "b").mapInPandas(lean(_compare(p, q)), "a bigint, b bigint"))
        compared = pairs if compared is None else compared.union(pairs)
        links = new if links is None else links.union(new)
        roots = held(components(links))
        if last:
            break
        # large buckets that still hold nodes of several components
        of = held(join_hot(whole, roots, ["node"], "left").withColumn("root", F.coalesce("root", "node")))
        several = of.groupBy("sig", "root").count().groupBy("sig").agg(F.count("*").alias("roots"), F.max(F.struct("count", "root")).alias("top")).where("roots > 1").select("sig", F.col("top.root").alias("top"))
        open_ = join_hot(of, several, ["sig"]).where("root != top").join(led, ["sig", "node"], "left_anti")
        order = Window.partitionBy("sig").orderBy("u", "node")
        leaders = held(open_.withColumn("r", F.row_number().over(order)).where(F.col("r") <= AT_ONCE + 1).select("r", "sig", *_as_other(F.col("root").alias("ra"))))
        if not leaders.take(1):
            break
        # where all open nodes lead, every pair of the bucket is compared or in one component after this round; the others go on
        more = leaders.where(F.col("r") > AT_ONCE).select("sig")
        last = not more.take(1)
        if not last:
            whole = held(join_hot(whole, more, ["sig"]))
        leaders = leaders.where(F.col("r") <= AT_ONCE).drop("r")
        pairs = _ordered(join_hot(of, leaders, ["sig"]).where((F.col("root") != F.col("ra")) & _close(p, q)).select("a", F.col("node").alias("b")))
        pairs = held(pairs.join(compared, ["a", "b"], "left_anti"))
        led = led.union(leaders.select("sig", F.col("a").alias("node")))
    scratch.drop(sets, marks)
    return Joined(rows, roots)


def classed(joined: Joined) -> DataFrame:
    """doc_id, text_key, n, node and component: the node's root, null for documents without features."""
    out = join_hot(joined.docs, joined.roots, ["node"], "left")
    return out.select("doc_id", "text_key", "n", "node", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("component"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    rows = held(classed(join(table(spark, sf_dir, "documents"), 4, Fraction(85, 100))))
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).where("members > 1")
    out = join_hot(rows, least, ["component"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """docs without all but the first document (by doc_id, nulls last) of each component."""
    rows = classed(join(docs, n, similarity))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")
    per = held(rows.where("component is not null").groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("c")))
    best = per.groupBy("component").agg(F.min(order).alias("first"), F.sum("c").alias("c")).where("c > 1").select("component", F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("t"))
    grouped = held(join_hot(per, best, ["component"]))
    first = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
    gone = grouped.where(~first).select("doc_id", "text_key")
    twice = grouped.where(first & (F.col("c") > 1)).select("doc_id", "text_key")
    (key,) = free(docs, "_key")
    own = docs.withColumn(key, F.xxhash64("text"))

    def on(x: DataFrame):
        return (own[key] == x["text_key"]) & own["doc_id"].eqNullSafe(x["doc_id"])

    stay = own.join(gone, on(gone), "left_anti")
    # rows that are there several times alike: few, so they are set apart, and one of each kept
    if not twice.take(1):
        return stay.drop(key)
    alike = own.join(twice, on(twice), "left_semi").dropDuplicates(["doc_id", key])
    return stay.join(twice, on(twice), "left_anti").unionByName(alike).drop(key)
