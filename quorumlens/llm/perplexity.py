"""Quality rules with an n-gram perplexity: a modified Kneser-Ney model of characters, counted by Spark.

Characters are mapped to 4096 symbols: ASCII ones by letter or mark, others by their code points, so that
the letters of one alphabet never share a symbol. An n-gram of up to five is a number of 60 bits. Tasks
count the five-grams of all their texts and Spark adds them up; lower orders count continuations, and
each order's contexts have their totals and discounted mass. The model grows with the corpus: it stays in
the shared folder, as sorted hash arrays in files of bounded size, by remainder of the n-gram; nothing of
it is broadcast or sent to the driver but the files' names and the discounts. A scoring task collects the
distinct n-grams of some CHUNK_CHARS characters and goes through the files, one at a time.

As texts are judged by a model of the corpus they are in, each occurrence is left out of the counts that
score it: else a junk text's own unheard-of n-grams would make it likely. Discounts are the modified
Kneser-Ney ones, from the counts of counts of the whole corpus.

A text's perplexity is taken over all its characters. For each language, Spark takes the median of
the log perplexities and their median distance from it over all documents that pass the base rules,
and the band is the median and so many robust deviations on either side, wider for short texts.

Defined results: a null text has no words; a null language is a language of its own; texts without
words fail the base rules; a text of any length is scored whole; equal rows are judged equally and get a
row each; a perplexity on a band's edge is inside; an empty table gives an empty table; other columns
aren't passed on, so their names can't clash.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens.llm.common import forget, materialise, new_path, quoted, remove, table

ORDER, SYMBOL_BITS = 5, 12
SYMBOLS_IN_ALL = 1 << SYMBOL_BITS
UNIFORM = 1 / SYMBOLS_IN_ALL
SYMBOLS = frozenset("#*$%&|<>")  # fixed value of the contract
WINDOW = 5
#: Deviations from a language's median at which a text is rejected, below and above, and the spread of a text of one character.
BELOW, ABOVE, SHORT = 4.5, 3.5, 1.0
#: Characters whose n-grams a task holds at once, those counted in one go, and rows of a file of the model.
CHUNK_CHARS, BLOCK_CHARS, FILE_ROWS = 16_000_000, 1_000_000, 2_000_000


def symbol_table() -> np.ndarray:
    """A symbol for each code point: 0 the text's edge, 1 space, 2 line end, 3 digit, 4-29 letters a-z, 30-127 the rest of ASCII, then others by code point."""
    points = np.arange(0x110000, dtype=np.int64)
    out = 128 + points % (SYMBOLS_IN_ALL - 128)
    out[:0x80] = 30 + points[:0x80] % 98
    out[[0x20, 0x09, 0x0B, 0x0C]] = 1
    out[[0x0A, 0x0D]] = 2
    out[0x30:0x3A] = 3
    out[0x41:0x5B] = out[0x61:0x7B] = np.arange(4, 30)
    return out


TABLE = symbol_table()


def grams(text: str) -> np.ndarray:
    """The five-gram that ends at each character of text, and at its end; edges come before the first."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.zeros(len(points) + ORDER, np.int64)
    s[ORDER - 1 : -1] = TABLE[points]
    out = s[: len(s) - ORDER + 1].copy()
    for i in range(1, ORDER):
        out = out << SYMBOL_BITS | s[i : len(s) - ORDER + 1 + i]
    return out


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of both."""
    keys, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([a[1], b[1]]), len(keys)).astype(np.int64)


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all texts."""

    def run(batches):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        total, held, size = none, [], 0

        def told():
            for at in range(0, len(total[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in total], names=["gram", "n"])

        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    held.append(grams(t.as_py()))
                    size += len(held[-1])
                    if size > BLOCK_CHARS:
                        total, held, size = added(total, np.unique(np.concatenate(held), return_counts=True)), [], 0
                        if len(total[0]) > FILE_ROWS:
                            yield from told()
                            total = none
        if held:
            total = added(total, np.unique(np.concatenate(held), return_counts=True))
        yield from told()

    return docs.select(F.col(quoted(text))).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of 0, 1, 2, and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


# The model's files


def stored(df: DataFrame, columns: list[str], folder: str) -> tuple[int, list[str]]:
    """df (key, columns) as files of arrays sorted by key, one for each remainder of the key by the number of files; that number, and their paths."""
    files = 1 + df.count() // FILE_ROWS // 2 * 2 if df.count() > FILE_ROWS else 1  # odd, so that all symbols of a key count

    def run(rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_numpy()
        order = np.argsort(keys)
        path = f"{folder}/{uuid.uuid4().hex}.npz"  # a task that runs again writes another, and only one is named in the end
        data = io.BytesIO()
        np.savez(data, key=keys[order], **{c: rows.column(c).to_numpy()[order] for c in columns})
        system, at = fs.FileSystem.from_uri(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at) as out:
            out.write(data.getbuffer())
        return pa.table({"file": pa.array([rows.column("file")[0].as_py()], pa.int64()), "path": [path]})

    named = df.withColumn("file", F.pmod("key", F.lit(files)).cast("long")).groupBy("file").applyInArrow(run, "file long, path string").collect()  # a row for each file
    by = {r["file"]: r["path"] for r in named}
    return files, [by.get(i, "") for i in range(files)]


def fit(docs: DataFrame, folder: str, text: str = "text") -> list[dict]:
    """For each order from 1 up: discounts, and the files, in folder, of n-grams (key, n) and of contexts (key, total, mass)."""
    level = materialise(count_grams(docs, text), f"grams-{ORDER}")
    out: list[dict] = []
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # a lower n-gram's count is the number of symbols seen before it
            upper, level = level, materialise(level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << k * SYMBOL_BITS) - 1)).alias("gram")).agg(F.count("*").alias("n")), f"grams-{k}")
            forget(upper)
        taken = discounts(*level.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first())
        mass = F.sum(F.element_at(F.lit([float(x) for x in taken]), (F.least(F.col("n"), F.lit(3)) + 1).cast("int")))
        contexts = level.groupBy(F.shiftright("gram", SYMBOL_BITS).alias("key")).agg(F.sum("n").alias("total"), mass.alias("mass"))
        known = {"taken": taken, "grams": stored(level.withColumnRenamed("gram", "key"), ["n"], f"{folder}/grams-{k}"), "contexts": stored(contexts, ["total", "mass"], f"{folder}/contexts-{k}")}
        out.insert(0, known)
    forget(level)
    return out


def looked_up(keys: np.ndarray, stored_: tuple[int, list[str]], columns: list[str]) -> list[np.ndarray]:
    """Each column at sorted keys, 0 where a key isn't known; a file is read at a time."""
    files, paths = stored_
    out = [np.zeros(len(keys)) for _ in columns]
    own = keys % files
    for i, path in enumerate(paths):
        at = np.flatnonzero(own == i)
        if not path or not len(at):
            continue
        system, where = fs.FileSystem.from_uri(path)
        with system.open_input_stream(where) as source:
            told = np.load(io.BytesIO(source.read()))
            have = told["key"]
            place = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
            hit = have[place] == keys[at]
            for o, c in zip(out, columns, strict=True):
                o[at[hit]] = told[c][place[hit]]
    return out


def log_probabilities(model: list[dict], keys: np.ndarray) -> np.ndarray:
    """The log probability of each five-gram's last symbol by the counts without one occurrence of the five-gram; keys are sorted."""
    own, levels = np.ones(len(keys), bool), []
    for k in range(ORDER, 0, -1):  # from above: an occurrence that is the only one of its kind counts in the next order as well
        low, place = np.unique(keys & ((1 << k * SYMBOL_BITS) - 1), return_inverse=True)
        context, of = np.unique(low >> SYMBOL_BITS, return_inverse=True)
        (n,) = looked_up(low, model[k - 1]["grams"], ["n"])
        total, mass = looked_up(context, model[k - 1]["contexts"], ["total", "mass"])
        n, total, mass = n[place], total[of][place], mass[of][place]
        own = own & (n > 0)
        taken = model[k - 1]["taken"]
        less = lambda x, taken=taken: taken[np.minimum(x, 3).astype(np.int64)]
        levels.append((n - own - less(n - own), total - own, mass - np.where(own, less(n) - less(n - own), 0)))
        own = own & (n == 1)
    p = np.full(len(keys), UNIFORM)
    for sure, total, mass in reversed(levels):
        p = np.where(total > 0, (np.maximum(sure, 0) + mass * p) / np.maximum(total, 1), p)
    return np.log(p)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at the contract's white space, and at nothing else
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup = set(), 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line.strip():
                if line in seen:
                    dup += 1
                seen.add(line)
    repeat = 0
    if n > WINDOW:
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
        if len(index) < n:
            windows = ids[: n - WINDOW + 1]
            for i in range(1, WINDOW):  # pairs of numbers are numbered again, so windows are equal only if all their words are
                _, windows = np.unique(windows * len(index) + ids[i : n - WINDOW + 1 + i], return_inverse=True)
            twice = np.flatnonzero(np.bincount(windows)[windows] > 1)
            if len(twice):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, twice, 1)
                np.add.at(edge, twice + WINDOW, -1)
                repeat = int((np.cumsum(edge) > 0).sum())
    return n, chars, symbols, dup, repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


class Chunk:
    """Texts' numbers, and their n-grams as places among the distinct ones of their block."""

    def __init__(self):
        self.rows, self.blocks, self.held, self.chars, self.size = [], [], [], 0, 0

    def add(self, row: tuple, text: str) -> None:
        self.rows.append((*row, *base_counts(text), len(text)))
        self.held.append(grams(text))
        self.chars, self.size = self.chars + len(self.held[-1]), self.size + len(self.held[-1])
        if self.size > BLOCK_CHARS:
            self.close()

    def close(self) -> None:
        if self.held:
            keys, place = np.unique(np.concatenate(self.held), return_inverse=True)
            self.blocks.append((keys, place.astype(np.int32), np.array([len(h) for h in self.held])))
            self.held, self.size = [], 0

    def means(self, model: list[dict]) -> np.ndarray:
        """The mean negative log probability of each text's characters."""
        self.close()
        every = np.unique(np.concatenate([b[0] for b in self.blocks]))
        logs = log_probabilities(model, every)
        own = [logs[np.searchsorted(every, keys)][place] for keys, place, _ in self.blocks]
        return -np.concatenate([np.add.reduceat(x, np.r_[0, np.cumsum(lens)[:-1]]) / lens for x, (_, _, lens) in zip(own, self.blocks, strict=True)])


def scored(docs: DataFrame, model: list[dict], *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts and mean_log, the mean negative log probability of a character, of each row."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars"]
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("lang", T.StringType()), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("mean_log", T.DoubleType())])

    def run(batches):
        chunk, kind = Chunk(), None

        def told():
            columns = [pa.array([r[0].as_py() for r in chunk.rows], kind), pa.array([r[1].as_py() for r in chunk.rows], pa.string())]
            columns += [pa.array([r[i] for r in chunk.rows], pa.int64()) for i in range(2, 2 + len(longs))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(chunk.means(model))], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for row in zip(*(batch.column(i) for i in range(3)), strict=True):
                chunk.add(row[:2], row[2].as_py() or "")
                if chunk.chars >= CHUNK_CHARS:
                    yield told()
                    chunk = Chunk()
        if chunk.rows:
            yield told()

    return docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(text)).alias("text")).mapInArrow(run, schema)


def quality(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """Base counts, base_failed, perplexity, its band and kept for each row of docs."""
    folder = new_path(docs.sparkSession, "model")
    rows = materialise(scored(docs, fit(docs, folder, text), doc_id=doc_id, text=text, lang=lang), "scored")
    remove(docs.sparkSession, folder)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    good = rows.filter("not base_failed")
    middle = good.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("mean_log", 0.5, 10_000).alias("middle"))
    near = good.join(middle, F.expr("lang <=> _lang")).select("lang", F.abs(F.col("mean_log") - F.col("middle")).alias("off"), "middle")
    bands = near.groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx("off", 0.5, 10_000).alias("spread")).withColumnRenamed("lang", "_lang")
    out = rows.join(materialise(bands, "bands"), F.expr("lang <=> _lang"), "left")
    # a mean over few characters scatters more: the variance of a text's own length adds to its language's
    unit = F.sqrt(F.pow(F.col("spread") * 1.4826, F.lit(2)) + F.lit(SHORT) / F.greatest(F.col("n_chars"), F.lit(1)))
    out = out.withColumns({"perplexity": F.exp("mean_log"), "perplexity_low": F.exp(F.col("middle") - below * unit), "perplexity_high": F.exp(F.col("middle") + above * unit)})
    inside = F.coalesce(F.col("perplexity").between(F.col("perplexity_low"), F.col("perplexity_high")), F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & inside)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "perplexity", "perplexity_low", "perplexity_high", "kept")


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")
