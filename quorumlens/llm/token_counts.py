"""Token counts by rank-synchronous array merging of a byte-level BPE vocabulary.

The distinct pre-tokens of a batch lie end to end in one ragged array of symbol ids. In each round
every sequence finds the lowest rank among its neighbouring pairs and merges all its pairs of that
rank at once, left to right; sequences without a known pair leave the array, and the symbols left
are their tokens. Merging one rank at a time in each sequence is what BPE does, since a merge can
only make pairs of higher ranks. A very long sequence goes through the same rounds alone, over lists of
its pairs' places by rank, so a round costs as much as it merges.

Defined results: a null text counts as empty (0 bytes, 0 tokens); ids are passed on as they are,
null or repeated; a text of any length is counted whole, in parts of bounded size; an empty table gives
an empty table; other columns aren't passed on, and a kept one named like a result raises ValueError.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens.llm.common import quoted, table

# Fixed value: the published pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same pattern for texts of ASCII, Latin letters from U+00C0 to U+02C1 and general punctuation only, where the standard library's engine is several times as fast.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02c1"
PLAIN_PRETOKEN = rf" ?[{LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
NOT_PLAIN = "[^\x00-\x7f\u00c0-\u02c1\u2010-\u2027]"
NONE = np.int64(2**31 - 1)
#: Pre-tokens longer than this have their pairs sorted by rank, as rounds over the whole of one long sequence would cost its square.
LONG = 4096
#: Characters of text whose pre-tokens are held at once, and counts remembered between batches.
HELD_CHARS, REMEMBERED = 2_000_000, 400_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, other bytes from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PairTable:
    """Open addressing from a pair of ids to its rank, probed for whole arrays."""

    BITS = 19

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NONE, np.int64)
        key, rank = left.astype(np.int64) << 32 | right, np.arange(len(left), dtype=np.int64)
        slot = self.slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & ((1 << self.BITS) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = self.slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((seen != key) & (seen >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


class RankMerger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pairs = PairTable(left, right)
        self.first = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.first[byte] = vocab[char]
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.known: dict[str, int] = {}
        self.any_split, self.plain_split, self.not_plain = regex.compile(PRETOKEN, regex.V1), re.compile(PLAIN_PRETOKEN), re.compile(NOT_PLAIN)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def count_sequences(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        out = lens.copy()
        for i in np.flatnonzero(lens > LONG):
            out[i] = self.count_long(words[i])
        short = np.flatnonzero((lens > 1) & (lens <= LONG))
        for at in range(0, len(short), 16384):
            block = short[at : at + 16384]
            out[block] = self.rounds([words[i] for i in block], lens[block])
        return out

    def rounds(self, words: list[bytes], lens: np.ndarray) -> np.ndarray:
        out = lens.copy()
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), lens)
        rank = np.full(len(ids), NONE, np.int64)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self.pairs.find(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            least = np.minimum.reduceat(rank, starts)
            going = least < NONE
            out[seq[starts[~going]]] = sizes[~going]
            if not going.all():
                stay = np.repeat(going, sizes)
                ids, seq, rank = ids[stay], seq[stay], rank[stay]
                least, sizes = least[going], sizes[going]
                if not len(ids):
                    break
            merge = rank == np.repeat(least, sizes)
            run = merge[1:] & merge[:-1]
            if run.any():  # the pairs of a run of one symbol overlap: every second one merges
                at = np.arange(len(merge))
                begin = np.maximum.accumulate(np.where(merge & ~np.r_[False, run], at, -1))
                merge &= (at - begin) % 2 == 0
            hit = np.flatnonzero(merge)
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, seq, rank, merge = ids[keep], seq[keep], rank[keep], merge[keep]
            merge[:-1] |= merge[1:]  # the pairs on either side of a merge are new
            rank[merge] = NONE
            merge[-1] = False
            merge[:-1] &= seq[:-1] == seq[1:]
            stale = np.flatnonzero(merge)
            rank[stale] = self.pairs.find(ids[stale], ids[stale + 1])
        return out

    def count_long(self, word: bytes) -> int:
        """One very long sequence, rank by rank: the places of its pairs lie in a list for each rank, so a round costs as much as it merges."""
        ids = self.first[np.frombuffer(word, np.uint8)]
        size = len(ids)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        alive = np.ones(size + 1, bool)
        alive[size] = False
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[after[at] < size]
            rank = self.pairs.find(ids[at], ids[after[at]])
            known = np.flatnonzero(rank < NONE)
            if not len(known):
                return
            order = known[np.argsort(rank[known], kind="stable")]
            own, starts = np.unique(rank[order], return_index=True)
            for r, part in zip(own.tolist(), np.split(at[order], starts[1:]), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        enter(np.arange(size - 1))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at]]
            at = at[after[at] < size]
            at = at[(ids[at] == self.left[r]) & (ids[after[at]] == self.right[r])]
            if not len(at):
                continue
            if self.left[r] == self.right[r]:  # the pairs of a run of one symbol overlap: every second one merges
                run = np.r_[False, after[at[:-1]] == at[1:]]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(run, -1, place))) % 2 == 0]
            gone = after[at]
            ids[at], alive[gone] = self.made[r], False
            after[at] = after[gone]
            inner = after[at] < size
            before[after[at[inner]]] = at[inner]
            left = before[at]
            enter(np.unique(np.r_[left[left >= 0], at]))
        return int(alive.sum())

    def splitter(self, text: str):
        return self.any_split if self.not_plain.search(text) else self.plain_split

    def learn(self, tokens: list[list[str]]) -> None:
        new = list(set().union(*tokens) - self.known.keys())
        if new:
            self.known.update(zip(new, self.count_sequences([w.encode("utf-8", "replace") for w in new]).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        out = []
        at = 0
        while at < len(texts):
            chars, end = 0, at
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= HELD_CHARS):
                chars += len(texts[end] or "")
                end += 1
            if len(self.known) > REMEMBERED:
                self.known.clear()
            if chars > HELD_CHARS:  # one very long text
                out.append(self.count_streamed(texts[at]))
            else:
                parts = [self.parts(t or "") for t in texts[at:end]]
                tokens = [[w for p in ps for w in self.splitter(p).findall(p)] for ps, _ in parts]
                self.learn(tokens)
                get = self.known.__getitem__
                out += [sum(map(get, words)) + more for words, (_, more) in zip(tokens, parts, strict=True)]
            at = end
        return out

    def parts(self, text: str) -> tuple[list[str], int]:
        """What lies between the special strings, and how many of those there are."""
        if not self.special or not any(s in text for s in self.special):
            return [text], 0
        between = self.at_special.split(text)
        return between, len(between) - 1

    def count_streamed(self, text: str) -> int:
        between, total = self.parts(text)
        for p in between:
            found = (m[0] for m in self.splitter(p).finditer(p))
            while words := list(islice(found, 200_000)):
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.learn([words])
                total += sum(map(self.known.__getitem__, words))
        return total


@lru_cache(2)
def merger(path: str) -> RankMerger:
    """One for each Python worker."""
    return RankMerger(path)


def token_counts(df: DataFrame, vocabulary: str | Callable[[], str], text: str = "text", limit: int = 512, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and n_bytes, n_tokens and over_limit of df's texts under the vocabulary file: its path, or a function that tells it where it is called, on the executors."""
    if {k.lower() for k in keep} & {"n_bytes", "n_tokens", "over_limit"}:
        raise ValueError(f"kept columns {keep} clash with the results")
    fields = [T.StructField(k, df.schema[k].dataType) for k in keep]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        m = merger(vocabulary() if callable(vocabulary) else vocabulary)
        for batch in batches:
            n = m.count(batch.column(len(keep) + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[f.name for f in schema])

    body = F.col(quoted(text))
    return df.select(*[F.col(quoted(k)) for k in keep], F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("_bytes"), body.alias("_text")).mapInArrow(run, schema)


def byte_bpe_50k() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), byte_bpe_50k)
