"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are hashed: its affixes of up to four characters, its inner character n-grams and
the word itself (the lexicon). A score per language adds up over them; a learned transition matrix
ties neighbouring words together, so text that switches languages is labelled word by word. The
field is trained by stochastic gradients on sequences of words, some of them spliced from two texts;
forward-backward gives each word's language probabilities, and a text's language is the one with the
largest mean probability over all its words.

Forward-backward runs over blocks of 32 words at once: each block's transfer matrix first, then a
scan over the blocks of a text, then the words of all blocks; with more than WIDE languages, whose
matrices would be large, the words of all texts are scanned at once. Training takes a bounded sample
of labelled rows of every language (SAMPLE_PER_LANGUAGE); prediction takes every word of every text.

Defined results: a null text, or one without a letter, is "und" with score 0; without labelled rows
every text is "und"; of equally probable languages the first by name is given; a text of any length is
labelled whole; rows with a null or repeated id are predicted each, and equal rows are learned from once;
an empty table gives an empty table; of other columns only those named as kept are passed on, and a kept
one named like a result raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens.llm.common import quoted, table

UNKNOWN = "und"
#: Labelled rows per language that training takes; every language is learned, beyond MANY of fewer rows and weights each.
SAMPLE_PER_LANGUAGE, MANY = 300, 64
#: Characters that training takes of all rows together, in whole texts, and rows and characters that it takes of each language in any case.
SAMPLE_CHARS = 6_000_000
LEAST_ROWS, LEAST_CHARS = 20, 20_000
BITS = 18
EPOCHS, SEQUENCE, BATCH, RATE, SHRINK = 2, 24, 256, 0.3, 1e-6
#: Words of a block, and characters of the texts whose words are held at once.
BLOCK, HELD_CHARS = 32, 4_000_000
#: Languages up to which blocks have transfer matrices; with more, words are scanned one after another.
WIDE = 16
WORDS = re.compile(r"[^\W\d_]+")
M = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    h = h * M
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def features(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, end to end, and where each word's begin."""
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    word = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(chars)) - starts[word]
    left = lens[word] - place  # characters from here to the word's end
    owner, feats = [], []
    gram = chars.copy()
    for n in range(2, 6):  # n-grams with the word's edges: those at an edge are its affixes
        gram = gram[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :] if len(gram) > 1 else gram[:0]
        inside = left[: len(gram)] >= n
        edge = (place[: len(gram)] == 0) | (left[: len(gram)] == n)
        at = np.flatnonzero(inside & (edge | (n <= 3)))
        owner.append(word[at])
        feats.append(mixed(gram[at] * np.uint64(8) + np.uint64(n), bits))
    powers = np.uint64(0x100000001B3) ** np.minimum(place, 63).astype(np.uint64)
    owner.append(np.arange(len(words)))
    feats.append(mixed(np.add.reduceat(chars * powers + np.uint64(7), starts) * np.uint64(8), bits))
    owner, feats = np.concatenate(owner), np.concatenate(feats)
    order = np.argsort(owner, kind="stable")
    return feats[order], np.searchsorted(owner[order], np.arange(len(words)))


def emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    out = np.empty((len(words), weights.shape[1]))
    size = max(100, 20_000 * 4 // max(4, weights.shape[1]))
    for at in range(0, len(words), size):
        feats, starts = features(words[at : at + size], len(weights).bit_length() - 1)
        out[at : at + size] = np.add.reduceat(weights[feats], starts, axis=0)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of equally long sequences, and the expected moves of all together: scores (sequence, place, label), moves (from, to)."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max())
    n, length, k = e.shape
    forward, backward = np.empty_like(e), np.empty_like(e)
    forward[:, 0] = scaled(e[:, 0])
    for t in range(1, length):
        forward[:, t] = scaled(forward[:, t - 1] @ a * e[:, t])
    backward[:, -1] = 1 / k
    for t in range(length - 2, -1, -1):
        backward[:, t] = scaled((backward[:, t + 1] * e[:, t + 1]) @ a.T)
    left, right = forward[:, :-1].reshape(-1, k), (e[:, 1:] * backward[:, 1:]).reshape(-1, k)
    both = ((left @ a) * right).sum(axis=1, keepdims=True)  # summed over all moves of each place
    return scaled(forward * backward), a * ((left / both).T @ right)


def scanned_probabilities(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """text_probabilities without transfer matrices: a step takes a word of each text, and memory is in proportion to the labels."""
    n, k = len(lens), scores.shape[1]
    a = np.exp(moves - moves.max())
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    first = np.r_[0, np.cumsum(lens)[:-1]]
    e[first] /= a.sum(axis=0)  # no move comes before the first word: this undoes the step from nowhere below
    order = np.argsort(-lens, kind="stable")
    many = np.searchsorted(-lens[order], -np.arange(int(lens.max())), side="left")  # texts with more than t words
    forward, x = np.empty_like(e), np.full((n, k), 1 / k)
    for t, m in enumerate(many):
        own = order[:m]
        x[own] = forward[first[own] + t] = scaled((x[own] @ a) * e[first[own] + t])
    total, x = np.zeros((n, k)), np.full((n, k), 1 / k)
    for t, m in enumerate(many):
        own = order[:m]
        at = first[own] + lens[own] - 1 - t
        total[own] += scaled(forward[at] * x[own])
        x[own] = scaled((x[own] * e[at]) @ a.T)
    return total


def text_probabilities(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Summed label probabilities over the words of each text; scores of all words end to end, lens > 0."""
    k = scores.shape[1]
    if k > WIDE:
        return scanned_probabilities(scores, lens, moves)
    a = np.exp(moves - moves.max())
    blocks = -(-lens // BLOCK)
    first = np.r_[0, np.cumsum(blocks)[:-1]]
    text = np.repeat(np.arange(len(lens)), lens)
    inner = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(lens)[:-1]], lens)
    e = np.ones((int(blocks.sum()), BLOCK, k))
    real = np.zeros((len(e), BLOCK), bool)
    at = first[text] + inner // BLOCK, inner % BLOCK
    e[at] = np.exp(scores - scores.max(axis=1, keepdims=True))
    e[first, 0] /= a.sum(axis=0)  # no move comes before the first word: this undoes the step from nowhere below
    real[at] = True

    def step(x, t):  # rows x of blocks over place t, unchanged where a block has ended
        return np.where(real[:, t, None, None], (x.reshape(-1, k) @ a).reshape(-1, k, k) * e[:, t, None, :], x)

    whole = np.broadcast_to(np.eye(k), (len(e), k, k)).copy()
    for t in range(BLOCK):
        whole = step(whole, t)
        if t % 4 == 3:
            whole /= whole.sum(axis=(1, 2), keepdims=True)
    # what enters each block from the left and from the right, block after block of all texts that have so many
    enter, leave = np.empty((len(e), k)), np.empty((len(e), k))
    order = np.argsort(-blocks, kind="stable")
    many = np.searchsorted(-blocks[order], -np.arange(int(blocks.max())), side="left")  # texts with more than j blocks
    x = np.full((len(lens), k), 1 / k)
    for j, n in enumerate(many):
        own = order[:n]
        enter[first[own] + j] = x[own]
        x[own] = scaled(np.einsum("nk,nkl->nl", x[own], whole[first[own] + j]))
    x = np.full((len(lens), k), 1 / k)
    for j, n in enumerate(many):
        own = order[:n]
        there = first[own] + blocks[own] - 1 - j
        leave[there] = x[own]
        x[own] = scaled(np.einsum("nkl,nl->nk", whole[there], x[own]))
    backward = np.empty((BLOCK, len(e), k))
    x = leave
    for t in range(BLOCK - 1, -1, -1):
        backward[t] = x
        x = np.where(real[:, t, None], scaled((x * e[:, t]) @ a.T), x)
    total, x = np.zeros((len(e), k)), enter
    for t in range(BLOCK):
        x = np.where(real[:, t, None], scaled((x @ a) * e[:, t]), x)
        total += np.where(real[:, t, None], scaled(x * backward[t]), 0)
    return np.add.reduceat(total, first, axis=0)


def train(texts: list[str], labels: list[str], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, feature weights and transitions fitted to labelled texts."""
    names = sorted(set(labels))
    k, rng = len(names), np.random.default_rng(seed)
    number = {name: i for i, name in enumerate(names)}
    # beyond MANY languages weights are of half the width, then fewer for each, and batches shorter
    bits = BITS if k <= MANY else max(10, min(BITS, BITS + 7 - (k - 1).bit_length()))
    batch = BATCH if k <= MANY else max(8, BATCH * MANY // k)
    index: dict[str, int] = {}
    pieces, marks = [], []
    for text, label in zip(texts, labels, strict=True):
        ids = [index.setdefault(w, len(index)) for w in WORDS.findall(text.lower())]
        for at in range(0, len(ids) - SEQUENCE + 1, SEQUENCE):
            pieces.append(ids[at : at + SEQUENCE])
            marks.append(number[label])
        if 0 < len(ids) < SEQUENCE:  # a short text is repeated to the length of a sequence
            pieces.append((ids * SEQUENCE)[:SEQUENCE])
            marks.append(number[label])
    weights, moves = np.zeros((1 << bits, k), np.float64 if k <= MANY else np.float32), np.eye(k)
    if not pieces or k < 2:
        return names, weights.astype(np.float32), moves
    vocabulary, found = list(index), []
    for at in range(0, len(vocabulary), 20_000):  # in pieces, which bounds what the driver holds
        own, begin = features(vocabulary[at : at + 20_000], bits)
        found.append((own.astype(np.int32), np.diff(np.r_[begin, len(own)])))
    feats, sizes = np.concatenate([f for f, _ in found]), np.concatenate([n for _, n in found])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    del vocabulary, found
    x, y = np.array(pieces), np.repeat(np.array(marks)[:, None], SEQUENCE, axis=1)
    seen_w, seen_m = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    for _ in range(EPOCHS):
        other = rng.permutation(len(x))
        cut = np.where(rng.random(len(x)) < 0.3, rng.integers(4, SEQUENCE - 3, len(x)), SEQUENCE)
        tail = np.arange(SEQUENCE)[None, :] >= cut[:, None]
        words, want = np.where(tail, x[other], x), np.where(tail, y[other], y)
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            ids, back = np.unique(words[rows], return_inverse=True)
            sizes = ends[ids] - starts[ids]
            own = np.repeat(np.arange(len(ids)), sizes)
            own_feats = feats[np.repeat(starts[ids] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
            per_word = np.zeros((len(ids), k))
            np.add.at(per_word, own, weights[own_feats])
            scores = per_word[back.reshape(-1)].reshape(len(rows), SEQUENCE, k)
            p, expected = marginals(scores, moves)
            target = np.eye(k)[want[rows]]
            grad_word = np.zeros((len(ids), k))
            np.add.at(grad_word, back.reshape(-1), (p - target).reshape(-1, k) / len(rows))
            hit, where = np.unique(own_feats, return_inverse=True)
            grad = np.zeros((len(hit), k))
            np.add.at(grad, where, grad_word[own])
            seen_w[hit] += grad**2
            weights[hit] -= RATE * grad / np.sqrt(seen_w[hit]) + SHRINK * weights[hit]
            grad = (expected - np.einsum("ntk,ntl->kl", target[:, :-1], target[:, 1:])) / len(rows)
            seen_m += grad**2
            moves -= RATE * grad / np.sqrt(seen_m)
    return names, weights.astype(np.float32), moves


def predict(texts: Iterator[str | None], names: list[str], weights: np.ndarray, moves: np.ndarray) -> list[tuple[str, float]]:
    texts = list(texts)
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    at, most = 0, HELD_CHARS if len(names) <= WIDE else max(1, HELD_CHARS * WIDE // len(names))
    while at < len(texts):
        index: dict[str, int] = {}
        ids, lens, places, chars = [], [], [], 0
        while at < len(texts) and (not chars or chars + len(texts[at] or "") <= most):
            words = WORDS.findall((texts[at] or "").lower())
            chars += len(texts[at] or "")
            if any(c.isalpha() for w in words for c in w) and names:
                ids += [index.setdefault(w, len(index)) for w in words]
                lens.append(len(words))
                places.append(at)
            at += 1
        if places:
            sums = text_probabilities(emissions(weights, list(index))[np.array(ids)], np.array(lens), moves)
            best = sums.argmax(axis=1)
            share = np.clip(sums[np.arange(len(best)), best] / np.array(lens), 0, 1)
            for place, b, s in zip(places, best.tolist(), share.tolist(), strict=True):
                out[place] = names[b], s
    return out


def sample(docs: DataFrame, doc_id: Column, text: Column, lang: Column) -> tuple[list[str], list[str]]:
    """Texts and labels of a bounded sample of labelled rows, as many of each language, chosen by a hash of the id."""
    rows = docs.select(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), text.alias("text"), lang.cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    each = SAMPLE_PER_LANGUAGE if len(counts) <= MANY else max(LEAST_ROWS, SAMPLE_PER_LANGUAGE * MANY // len(counts))
    pairs = [F.lit(v) for name, n in counts.items() for v in (name, max(1, int(min(1.0, each / n) * 1_000_000)))]
    share = F.create_map(*pairs)[F.col("lang")]
    order = [F.xxhash64("id", F.lit(17)), F.col("id"), F.col("body")]
    rows = rows.withColumns({"body": F.xxhash64("text"), "chars": F.length("text")})
    narrow = rows.select("lang", "id", "body", "chars")
    chosen = narrow.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < share).distinct()
    # several times the expected rows could only come of repeated ids; the bound holds all the same, in an order that any run has
    found = [tuple(r) for r in chosen.orderBy(*order, "lang").limit(2 * each * len(counts)).collect()]
    missed = sorted(counts.keys() - {r[0] for r in found})
    if missed:  # only repeated ids leave a language without a row: it gets one
        one = narrow.filter(F.col("lang").isin(missed)).groupBy("lang").agg(F.min_by(F.struct("id", "body", "chars"), F.struct(*order)).alias("r"))
        found += [tuple(r) for r in one.select("lang", "r.*").collect()]
    # whole texts as far as each language's share of the characters goes; one whose texts are all longer takes its shortest
    picked, left = [], dict.fromkeys(counts, max(LEAST_CHARS, SAMPLE_CHARS // len(counts)))
    for name, key, body, chars in found:
        if chars <= left[name]:
            picked.append((name, key, body))
            left[name] -= chars
    for name in sorted(counts.keys() - {r[0] for r in picked}):
        _, _, key, body = min((chars, i, key, body) for i, (lang_, key, body, chars) in enumerate(found) if lang_ == name)
        picked.append((name, key, body))
    wanted = docs.sparkSession.createDataFrame(picked, "lang string, id string, body long")
    told = rows.join(F.broadcast(wanted), ["lang", "id", "body"]).dropDuplicates(["lang", "id", "body"]).select("lang", "id", "body", "text").collect()
    told.sort(key=lambda r: (r["lang"], r["id"], r["body"]))
    return [r["text"] for r in told], [r["lang"] for r in told]


def languages(docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of keep, lang_pred and score (or what names calls them) of each row, by a field trained on the rows where learn holds."""
    if {k.lower() for k in keep} & {n.lower() for n in names}:
        raise ValueError(f"kept columns {keep} clash with the results {names}")
    told = sample(docs.filter(learn), F.col(quoted(doc_id)), F.col(quoted(text)), F.col(quoted(lang)))
    model = docs.sparkSession.sparkContext.broadcast(train(*told))  # 2**18 weights for each of up to 128 languages, 2**25 in all up to 2**15 languages
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    more = [] if text in keep else [F.col(quoted(text)).alias("_text")]
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        for batch in batches:
            found = predict(batch.column(at).to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return docs.select(*[F.col(quoted(k)) for k in keep], *more).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a null id has no remainder: such a row isn't held out, nor learned from
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))
    found = languages(docs, learn)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
