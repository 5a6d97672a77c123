"""SimHash near-duplicates, their fingerprints matched by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in
three bits at most, either one segment is equal and another differs in one bit at most, or each of the
three differs in one bit. A segment, as a 23-bit word, decodes to one codeword of the binary Golay code.
A word three bits from its codeword also lies four bits from five others; of two words one bit apart,
each decodes to one of the other's codewords, these six or the single one. So a fingerprint is entered
under each ordered pair of a segment's bits and another's codeword index, and under its three codeword
indices; it is looked up with every codeword near those segments, and the few pairs found are verified.
Keys have 33 bits or more. Equal fingerprints are one entry throughout.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; rows with
the same doc_id are rows of the result each; component_id ignores null ids and is null if a component
has no other; a text of any length is taken whole; other columns aren't passed on, so their names can't
clash; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens.llm.common import FEW, bounded, forget, materialise, quoted, table
from quorumlens.llm.components import components

SEED, BITS, SHINGLE, MOST = 42, 64, 3, 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width)
#: Kinds of keys: (segment that is equal, segment that differs in one bit at most); one more, ALL, has all three differ in one bit at most.
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
ALL, KIND_BIT = len(PAIRS), 36
GOLAY = 0xAE3  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code

BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 of the text's shingles; bytes.split cuts at the contract's white space."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)  # noqa: B905
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ BIT_TABLE for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""
    kind = docs.schema[doc_id].dataType

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("binary").alias("text")).mapInArrow(run, schema)


class Golay:
    """Tables of the binary Golay code of length 23: any word is at most three bits from one codeword."""

    def __init__(self):
        low = np.arange(1 << 12, dtype=np.int64) << 11
        rest = low.copy()
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
        words = low | rest  # systematic: the upper 12 bits are the index
        self.remainder = np.zeros(1 << 12, np.int64)
        self.remainder[:] = rest
        errors = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)] + [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
        errors = np.array(errors, np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self.syndrome(errors)] = errors
        weights = np.bitwise_count(words)
        sevens = words[weights == 7]
        #: What to xor to a word's own index for each codeword near it: 0, and five more for words three bits off.
        self.near = np.full((1 << 11, 6), -1, np.int64)
        self.near[:, 0] = 0
        for s in np.flatnonzero(np.bitwise_count(self.error) == 3):
            self.near[s, 1:] = sevens[(sevens & self.error[s]) == self.error[s]] >> 11

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return (words & 0x7FF) ^ self.remainder[words >> 11]

    def decode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each word's codeword, and the indices of all near it (-1: none)."""
        s = self.syndrome(words)
        own = (words ^ self.error[s]) >> 11
        near = self.near[s]
        return own, np.where(near < 0, -1, own[:, None] ^ near)


@lru_cache(1)
def golay() -> Golay:
    return Golay()


def keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in fps and keys: a kind, and below it a segment's bits and a codeword index, or three codeword indices."""
    bits = fps.view(np.uint64)
    parts = [(bits >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    decoded = [golay().decode(p) for p in parts]
    codes = [near if probe else own[:, None] for own, near in decoded]  # -1: none
    at, out = [], []
    for kind, (a, b) in enumerate(PAIRS):
        there = codes[b] >= 0
        at.append(np.nonzero(there)[0])
        out.append((kind << KIND_BIT | parts[a][:, None] << 12 | codes[b])[there])
    x, y, z = codes[0][:, :, None, None], codes[1][:, None, :, None], codes[2][:, None, None, :]
    there = (x >= 0) & (y >= 0) & (z >= 0)
    at.append(np.nonzero(there)[0])
    out.append((ALL << KIND_BIT | x << 24 | y << 12 | z)[there])
    return np.concatenate(at), np.concatenate(out)


def keyed(nodes: DataFrame, probe: bool) -> DataFrame:
    """(key, fp) of nodes (fp)."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for begin in range(0, len(fps), 1024):
                block = np.ascontiguousarray(fps[begin : begin + 1024])
                at, out = keys(block, probe)
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(block[at])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints in nodes (fp) that differ in three bits at most, once each.

    Each fingerprint has 7 keys and is looked up by up to 252; Spark takes both sides to be as small as nodes and
    would broadcast them, so the join is told to shuffle.
    """
    own, looked = keyed(nodes, False).withColumnRenamed("fp", "a"), keyed(nodes, True).withColumnRenamed("fp", "b")
    differ = "(a ^ b)"
    off = [f"bit_count(shiftrightunsigned({differ}, {low}) & {(1 << width) - 1}L)" for low, width in SEGMENTS]
    # a pair met under several keys counts under the first kind that it fits
    once = " ".join(f"when {off[a]} = 0 and {off[b]} <= 1 then {kind}L" for kind, (a, b) in enumerate(PAIRS))
    return own.hint("merge").join(looked, "key").filter(f"a < b and bit_count({differ}) <= {MOST} and shiftright(key, {KIND_BIT}) = case {once} else {ALL}L end").select("a", "b")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs."""
    rows = materialise(fingerprints(docs, doc_id=doc_id, text=text), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    few = nodes.count() <= FEW  # so are roots and components, of which these joins may broadcast any
    told = (lambda df: df) if few else lambda df: df.hint("merge")
    roots = components(links(nodes))
    rooted = nodes.join(told(roots), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialise(rooted.select("fp", "root").join(told(least), "root").select("fp", "component_id"), "components")
    forget(nodes, rooted, roots)
    return rows.join(told(of), "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest id (null last), of equal ids that whose text has the least MD5.

    Of rows equal in id and text but not in other columns, that with the least hash of all of them stays, so reruns agree.
    """
    own = {"__ql_none": F.col(quoted(doc_id)).isNull(), "__ql_id": F.col(quoted(doc_id)), "__ql_md5": F.coalesce(F.md5(F.col(quoted(text))), F.lit(""))}
    marked = docs.withColumns(own)
    found = near_duplicates(marked.withColumn("__ql_mark", F.struct(*own)), doc_id="__ql_mark", text=text)
    marks = found.groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    marks = materialise(marks.select(F.col("doc_id.__ql_id").alias("__ql_i"), F.col("doc_id.__ql_md5").alias("__ql_m"), (F.col("doc_id") == F.col("component_id")).alias("kept"), "n"), "marks")
    dropped, again = marks.filter("not kept").select("__ql_i", "__ql_m"), marks.filter("kept and n > 1").select("__ql_i", "__ql_m")
    out = marked.join(bounded(dropped), F.expr("__ql_id <=> __ql_i and __ql_md5 = __ql_m"), "left_anti")
    if again.limit(1).count():  # rows equal in id and text: one of them stays, that with the least hash of all its columns
        again, columns = bounded(again), [F.col(quoted(c)) for c in docs.columns]
        same = F.expr("__ql_id <=> __ql_i and __ql_md5 = __ql_m")
        plain = [F.to_json(F.struct(c)) if isinstance(f.dataType, T.MapType) else c for c, f in zip(columns, docs.schema, strict=True)]
        twice = out.join(again, same, "left_semi").groupBy("__ql_id", "__ql_md5").agg(F.min_by(F.struct(*columns), F.xxhash64(*plain)).alias("r"))
        out = out.join(again, same, "left_anti").select(*columns).unionByName(twice.select("r.*"))
    return out.select(*[F.col(quoted(c)) for c in docs.columns])
