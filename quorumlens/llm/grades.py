"""A quality classifier: cumulative-link (ordinal) regression on graded ratings.

Grades are 0 (toxic), 1 (neither toxic nor good) and 2 (good). A text's features are its distinct
words, their first letters, and a few coarse shares (marks, capitals, digits, repeated lines), each
hashed to 64 bits, with one weight each, shared by all grades; ordered thresholds turn the weighted sum
into the probabilities of each grade or better. The expected grade and the probability of the tail
select documents.

Training takes a bounded sample of labelled rows (SAMPLE, SAMPLE_CHARS), in an order by hashes, so that
reruns agree, and features that SEEN of them have at least; it runs on the driver. The model is a sorted
array of feature hashes and their weights, at most as long as the sample's features; a hash that isn't in
it has no weight. Scoring takes every word of every text, whole batches of texts at a time.

Defined results: a null text is scored as empty, and a text of any length by all its words; several
different labels of one document are trained on each, equal rows once; a label that is null counts as
unknown and the row isn't trained on; of equally likely grades the lowest is given; without labels every
text has the probabilities of three equal grades; repeated rows are scored each; an empty table gives an
empty table; other columns aren't passed on, so their names can't clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from quorumlens.llm.common import quoted, table

#: Labelled rows that training takes at most, half of them of grades below the best, and the characters of all their texts.
SAMPLE, SAMPLE_CHARS = 6000, 16_000_000
SEEN = 4
#: Characters of the texts whose features are held at once; a longer text is held alone.
HELD_CHARS = 2_000_000
GRADES = 3
EPOCHS, BATCH, RATE, PENALTY = 12, 64, 0.15, 1e-3
#: A document is kept if its probability of grade KEEP or better is at least this.
KEEP, LEAST = 2, 0.5
WORDS = re.compile(r"[^\W_]+")


def shares(text: str) -> list[str]:
    """Coarse shares of a text, each by a name."""
    n = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    marks = text.count("|") + text.count("!") + text.count("#") + text.count("*")
    told = {
        "marks": marks / n,
        "upper": sum(map(text.count, filter(str.isupper, set(text)))) / n,
        "digits": sum(map(text.count, "0123456789")) / n,
        "again": 1 - len(set(lines)) / max(1, len(lines)),
    }
    return [f"{k}{min(9, int(np.ceil(np.sqrt(v) * 10)))}" for k, v in told.items()] + [f"length{min(16, n.bit_length())}"]


def hashed(kind: int, name: str) -> int:
    """64 bits for a feature; the kind (0 word, 1 first letters, 2 share) is the seed. 0 stands for no feature."""
    return xxh64_intdigest(name.encode("utf-8", "replace"), kind) or 1


def word_features(word: str) -> tuple[int, int, int]:
    """A word, and the first letters of longer ones, which compounds share."""
    return hashed(0, word), hashed(1, word[:4]) if len(word) > 5 else 0, hashed(1, word[:5]) if len(word) > 6 else 0


def bags(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct features of all texts, sorted, and the places among them of each text's own, each once."""
    index: dict[str, int] = {}
    words = [np.fromiter({index.setdefault(w, len(index)) for w in WORDS.findall(t.lower())}, np.int64) for t in texts]
    own = np.array([[hashed(2, x) for x in shares(t)] for t in texts], np.uint64).reshape(len(texts), -1)
    table = np.array([word_features(w) for w in index] + [(0, 0, 0)], np.uint64)
    every, places = np.unique(np.concatenate([table.ravel(), own.ravel()]), return_inverse=True)
    table, own = places[: table.size].reshape(table.shape), places[table.size :].reshape(own.shape)
    none = int(np.searchsorted(every, 0))  # always 0: the last row of the table has it
    rows = [np.unique(np.concatenate([table[w].ravel(), o])) for w, o in zip(words, own, strict=True)]
    return every, [r[r != none] for r in rows]


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Grader:
    """Sorted feature hashes with their weights, and thresholds; probabilities of grade 1 or better, 2 or better."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def scores(self, texts: list[str]) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= HELD_CHARS):
                chars += len(texts[end])
                end += 1
            every, rows = bags(texts[at:end])
            weights = np.zeros(len(every))
            if len(self.features):
                places = np.minimum(np.searchsorted(self.features, every), len(self.features) - 1)
                weights = np.where(self.features[places] == every, self.weights[places], 0.0)
            lens = np.array([len(r) for r in rows])
            out[at:end] = np.bincount(np.repeat(np.arange(len(rows)), lens), weights[np.concatenate(rows)], len(rows))
            at = end
        return out

    def tails(self, texts: list[str]) -> np.ndarray:
        return logistic(self.scores(texts)[:, None] - self.thresholds[None, :])


def train(texts: list[str], grades: list[int], counts: dict[int, int] | None = None, seed: int = 11) -> Grader:
    """A grader fitted to a sample; counts says how many labelled rows of each grade there are, which the sample stands for."""
    if not texts:
        return Grader(np.zeros(0, np.uint64), np.zeros(0), np.array([-np.log(2), np.log(2)]))
    every, rows = bags(texts)
    often = np.bincount(np.concatenate(rows), minlength=len(every)) >= SEEN
    names, place = every[often], np.cumsum(often) - 1
    rows = [place[r[often[r]]] for r in rows]
    y = np.array(grades)
    rng = np.random.default_rng(seed)
    weights, cuts = np.zeros(len(names)), np.arange(GRADES - 1) - (GRADES - 2) / 2
    seen_w, seen_c = np.full(len(names), 1e-2), np.full(GRADES - 1, 1e-2)
    drawn = np.bincount(y, minlength=GRADES)
    whole = np.array([(counts or {}).get(k, drawn[k]) for k in range(GRADES)])
    cost = (whole / np.maximum(drawn, 1))[y]  # the sample has as many of each grade; a text that says little gets their true shares
    cost /= cost.mean()
    for _ in range(EPOCHS):
        for own in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            lens = np.array([len(rows[i]) for i in own])
            ids, at = np.concatenate([rows[i] for i in own]), np.repeat(np.arange(len(own)), lens)
            s = np.bincount(at, weights[ids], len(own))
            # P(y <= k) = logistic(cut_k - s), with cuts at -inf and inf outside
            edge = np.r_[-30.0, cuts, 30.0]
            upper, lower = logistic(edge[y[own] + 1] - s), logistic(edge[y[own]] - s)
            p = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper), lower * (1 - lower)
            slope = cost[own] * (up - low) / p / len(own)  # d loss / d s
            grad = np.bincount(ids, slope[at], len(names))
            seen_w += grad**2
            step = RATE / np.sqrt(seen_w)
            weights -= step * grad
            weights = np.sign(weights) * np.maximum(0, np.abs(weights) - step * PENALTY)  # words that tell nothing get no weight
            for k in range(GRADES - 1):
                g = (cost[own] * (np.where(y[own] == k + 1, low, 0) - np.where(y[own] == k, up, 0)) / p).sum() / len(own)
                seen_c[k] += g**2
                cuts[k] -= RATE * g / np.sqrt(seen_c[k])
            cuts = np.maximum.accumulate(cuts + np.arange(GRADES - 1) * 1e-6)  # thresholds stay in order
    return Grader(names[weights != 0], weights[weights != 0], cuts)


def graded(labels: DataFrame, quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """labels with grade: 0 toxic, 1 neither toxic nor good, 2 good."""
    grade = F.when(F.col(quoted(toxic)) == 1, 0).when(F.col(quoted(quality)) == 1, 2).when(F.col(quoted(quality)).isNotNull() & F.col(quoted(toxic)).isNotNull(), 1)
    return labels.withColumn("grade", grade).filter("grade is not null")


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts, grades and all grades' counts of at most SAMPLE labelled rows, a third of each grade if there are so many, chosen and ordered by hashes of ids."""
    known = labels.select(F.col(quoted(doc_id)).alias("id"), "grade").filter("id is not null")
    counts = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # three grades
    rate = F.lit(0)
    for g, n in counts.items():
        rate = F.when(F.col("grade") == g, F.lit(int(min(1.0, SAMPLE / GRADES / n) * 1_000_000))).otherwise(rate)
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1_000_000)) < rate).distinct()
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(23)), "id", "grade").limit(SAMPLE)
    bodies = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text")).filter("text is not null").withColumn("body", F.xxhash64("text"))
    # lengths first, so that no more than SAMPLE_CHARS characters reach the driver
    sizes = bodies.select("id", "body", F.length("text").alias("chars")).join(F.broadcast(chosen), "id").distinct()
    picked, left = [], SAMPLE_CHARS
    for r in sizes.orderBy(F.xxhash64("id", F.lit(23)), "id", "body", "grade").limit(SAMPLE).collect():
        if r["chars"] <= left:
            picked.append((r["id"], r["body"], r["grade"]))
            left -= r["chars"]
    if not picked:
        return [], [], counts
    kind = dict(chosen.dtypes)["id"]
    wanted = docs.sparkSession.createDataFrame(picked, f"id {kind}, body long, grade int")
    rows = bodies.join(F.broadcast(wanted), ["id", "body"]).dropDuplicates(["id", "body", "grade"]).select("id", "body", "grade", "text").collect()
    rows.sort(key=lambda r: (str(r["id"]), r["grade"], r["body"]))
    return [r["text"] for r in rows], [r["grade"] for r in rows], counts


def select(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: int = KEEP, least: float = LEAST) -> DataFrame:
    """doc_id, expected_grade, p_tail (of grade keep or better), grade (the likeliest) and kept of each row of docs."""
    grader = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, graded(labels), doc_id, text)))  # at most the sample's features, 16 bytes each
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("expected_grade", T.DoubleType()), T.StructField("p_tail", T.DoubleType()), T.StructField("grade", T.LongType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for batch in batches:
            tails = grader.value.tails([t.as_py() or "" for t in batch.column(1)])
            each = -np.diff(np.c_[np.ones(len(tails)), tails, np.zeros(len(tails))], axis=1)
            tail = tails[:, keep - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(each.argmax(axis=1)), pa.array(tail >= least)], names=schema.names)

    return docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")).mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
