"""Operator 8: toxicity grades by cumulative-link ordinal regression.

Features are sparse: which words, and which word beginnings of four to six letters, a text has (forms of one stem share their beginning).  The model has
one weight for each feature, shared by the ordered thresholds: P(grade > k) = sigmoid(x.w - b_k) with b_0 < b_1 < ...  The output is the expected
grade, which is the sum of these probabilities.

Labels say only whether a text is toxic.  Grade 0 is for clean texts; toxic ones are dealt to grades 1 to GRADES - 1 by how many of the features they
have that are telltale in the labelled sample, cut at the sample's quantiles.  The fit takes at most SAMPLE labelled rows of either class, chosen by a
seeded hash; all else covers all documents.  Its weights, at most FEATURES of them, are what is sent to the executors.

Defined cases: a null or empty text has no features and gets the grade of the thresholds alone, never a rejection; labels that are null are skipped, of
several for one document the largest counts; without labels of both classes nothing is rejected and every severity is 0; repeated rows get the same
grade; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import lean, table

SAMPLE, GRADES, FEATURES, SEED, SPACE_BITS = 4000, 4, 20_000, 41, 22
LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
#: A feature is kept when it stands in so many sampled documents, its log-odds are beyond 2, and the root of its likelihood ratio is beyond this.
LEAST_DOCUMENTS, LEAST_Z = 3, 4.0


def features_of(word: str) -> list[int]:
    """A word's features, hashed to SPACE_BITS bits."""
    names = [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << SPACE_BITS) - 1) for x in names]


def document_features(text: str | None) -> np.ndarray:
    return np.unique(np.array([x for w in words_of(text) for x in features_of(w)], np.int32))


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


@dataclass
class Model:
    weights: dict[int, float]
    cuts: list[float]

    def severity(self, score: float) -> tuple[float, float, int]:
        """Expected grade, P(grade > 0), and the most likely grade."""
        above = [1.0, *(1 / (1 + np.exp(np.clip(c - score, -60, 60))) for c in self.cuts), 0.0]
        each = [a - b for a, b in zip(above, above[1:], strict=False)]
        return float(sum(above[1:-1])), float(above[1]) if self.cuts else 0.0, int(np.argmax(each))


def ordinal(rows: list[np.ndarray], grades: np.ndarray, width: int, n_grades: int, l2: float = 0.002, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts that minimise the cumulative-link loss; rows: the features that are present.  Full-batch Adam from a fixed start."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, levels = len(rows), np.arange(n_grades - 1)
    share = np.array([(grades > k).mean() for k in levels]).clip(1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    theta = np.concatenate((np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 0.05))))  # gaps as logarithms keep the cuts in order
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))  # both classes count alike
    for t in range(1, steps + 1):
        w, cuts = theta[:width], theta[width] + np.concatenate(([0.0], np.cumsum(np.exp(theta[width + 1 :]))))
        score = np.bincount(owner, w[at], n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -40, 40)))
        up = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), 1)
        i = np.arange(n)
        prob = np.maximum(up[i, grades] - up[i, grades + 1], 1e-12)
        slope = up * (1 - up)
        d_low, d_high = slope[i, grades] / prob, slope[i, grades + 1] / prob
        d_score = -(d_low - d_high) * weight
        d_cut = np.zeros((n, n_grades + 1))
        d_cut[i, grades] += d_low * weight
        d_cut[i, grades + 1] -= d_high * weight
        d_cut = d_cut[:, 1:-1].sum(0)
        tail = np.cumsum(d_cut[::-1])[::-1]
        g = np.concatenate((np.bincount(at, d_score[owner], width) + l2 * w, tail[:1], tail[1:] * np.exp(theta[width + 1 :])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:width], theta[width] + np.concatenate(([0.0], np.cumsum(np.exp(theta[width + 1 :]))))


def fit(docs: list[np.ndarray], toxic: list[int]) -> Model:
    """docs: each labelled document's features."""
    label = np.array(toxic, int)
    seen = [np.zeros(1 << SPACE_BITS, np.int32), np.zeros(1 << SPACE_BITS, np.int32)]
    for f, y in zip(docs, toxic, strict=True):
        seen[y][f] += 1
    n = [max(1, int((label == y).sum())) for y in (0, 1)]
    able = np.flatnonzero(seen[0] + seen[1] >= LEAST_DOCUMENTS)
    b, a = seen[0][able].astype(float), seen[1][able].astype(float)
    odds = np.log((a + 0.5) / (n[1] - a + 0.5)) - np.log((b + 0.5) / (n[0] - b + 0.5))
    share = (a + b) / sum(n)

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    gain = 2 * (part(a, share * n[1]) + part(b, share * n[0]) + part(n[1] - a, (1 - share) * n[1]) + part(n[0] - b, (1 - share) * n[0]))
    strength = np.sqrt(np.maximum(0.0, gain))
    keep = np.flatnonzero((np.abs(odds) > 2) & (strength > LEAST_Z))
    keep = keep[np.lexsort((able[keep], -strength[keep]))][:FEATURES]
    chosen = able[keep]
    place = np.full(1 << SPACE_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    telling = np.concatenate((odds[keep] > 3, [False]))
    rows = [(r := place[f])[r >= 0].astype(np.int64) for f in docs]
    counts = np.array([int(telling[r].sum()) for r in rows])
    edges = np.quantile(counts[label == 1], [k / (GRADES - 1) for k in range(1, GRADES - 1)]) if label.any() else []
    grades = np.where(label == 1, 1 + sum((counts > e).astype(int) for e in edges), 0)
    w, cuts = ordinal(rows, grades, len(chosen), GRADES)
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True)}, [float(c) for c in cuts])


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic): at most `most` labelled documents of either class, by a seeded hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(most).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(most))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # 2 * most rows of two numbers


def trained(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """None without labelled documents of both classes."""
    rows = {}
    for r in sample(docs, labels, most).toLocalIterator():  # a document at a time; copies count once
        rows.setdefault((r["doc_id"], zlib.crc32((r["text"] or "").encode("utf-8", "surrogatepass"))), (document_features(r["text"]), r["toxic"]))
    rows = [rows[k] for k in sorted(rows)]
    toxic = [y for _, y in rows]
    return fit([f for f, _ in rows], toxic) if len(set(toxic)) == 2 else None


def _scorer(model: Model | None):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        weights = model.weights if model else {}
        for frame in batches:
            out = []
            for text in frame["text"]:
                found: set[int] = set()
                for w in words_of(text):
                    f = known.get(w)
                    if f is None:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = f = tuple(x for x in features_of(w) if x in weights)
                    if f:
                        found.update(f)
                out.append(model.severity(sum(weights[f] for f in sorted(found))) if model and found else (0.0, 0.0, 0) if not model else (*model.severity(0.0)[:1], 0.0, 0))
            yield frame.drop(columns="text").assign(severity=[x[0] for x in out], p_toxic=[x[1] for x in out], grade=np.array([x[2] for x in out], np.int32))

    return score


def graded(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_key, severity (expected grade), p_toxic and grade for every row of docs."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInPandas(lean(_scorer(model)), "doc_id bigint, text_key bigint, severity double, p_toxic double, grade int")


def clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without those that are more likely toxic than not; columns are kept, texts aren't shuffled."""
    score = _scorer(model)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            p = next(score(iter([frame[["text"]]])))["p_toxic"]
            yield frame[(p < 0.5).to_numpy()]

    return docs.mapInPandas(lean(keep), docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = graded(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("severity").alias("expected_severity"), "p_toxic", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))
