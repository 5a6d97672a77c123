"""The corpus operators against brute force on small fixtures with nulls, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from harness import compare
from pyspark.sql import functions as F

from quorumlens.llm import archives, components, contamination, grades, language, licences, mixing, perplexity, registry, sharding, simhash, token_counts
from quorumlens.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, h long"
ODD = [None, "", " \n\t ", "word", "The the THE", "é中🙂 ünï", "a\x0bb\x0cc\x1cd", "x" * 5000, "one two three four five " * 400, "<|endoftext|> hi <|endoftext|>"]


def docs(spark, texts, langs=("en", None), sources=("s1", None, "s0"), ids=None):
    rows = [(ids[i] if ids else i, t, langs[i % len(langs)], sources[i % len(sources)], len(t or ""), 0.5, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


@pytest.mark.parametrize("name", registry.ORACLES)
def test_sql(spark, name):
    assert compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], SF) > 0


# 1


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(3)
    texts = [t for t in ODD if t is not None]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3000), rng.randrange(0, 0x20), 32])) for _ in range(300)) for _ in range(60)]
    texts += ["ab" * 3000 + "a" * 5001, "xyz" * 1700 + "".join(rng.choice("etaoinshr") for _ in range(30000)), "中文字" * 3000, "a" * 9000, "".join(rng.choice("abcdef") for _ in range(6000)), "  \n\n  x 　y 's 'LL don't"]
    texts += [r.text for r in table(spark, SF, "documents").select("text").limit(150).collect()]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, texts), path).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (want[i] > 512) for i, t in enumerate(texts))
    null = token_counts.token_counts(docs(spark, [None, ""], ids=[None, None]), path).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in null] == [(None, 0, 0, False)] * 2
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


def test_long_sequences_stream():
    import public_tokenizers

    m = token_counts.RankMerger(public_tokenizers.path("byte_bpe_50k.json"))
    word = "".join(random.Random(1).choice("the in") for _ in range(3000)).replace(" ", "")
    assert m.count_long(word.encode()) == int(m.rounds([word.encode()], np.array([len(word)]))[0])
    text = "some words <|endoftext|> again " * 200
    assert m.count_streamed(text) == m.count([text])[0]


# 2


def test_shards_fit_and_only_large_buckets_split(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(400)] + ODD + ["big " * 3000] + ["same"] * 50
    ids = [*range(len(texts) - 50), *[7] * 50]  # fifty rows are equal in id and text
    limit = 2000
    out = sharding.shards(docs(spark, texts, ids=ids), limit)
    assert {"doc_id", "text", "source", "score", "h", "shard"} <= set(out.columns) and out.columns.count("shard") == 1
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(zip(ids, texts, strict=True))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for rs in by.values():
        total = sum(r.n_bytes for r in rs)
        assert {r.shard_bytes for r in rs} == {total}
        assert total <= limit or (len(rs) == 1 and rs[0].oversized)
    # each shard's parent was too large
    sizes = Counter()
    for r in rows:
        key = int(hashlib.md5(f"{r.doc_id}|{r.text or ''}".encode()).hexdigest()[:15], 16)
        for d in range(61):
            sizes[d, key >> 60 - d] += r.n_bytes
    for name in by:
        d, p = map(int, name.split("+")[0].split("-"))
        assert d == 0 or sizes[d - 1, p >> 1] > limit
    assert sharding.shards(docs(spark, []), limit).count() == 0


def test_many_equal_rows_get_pages(spark):
    texts = ["same text of some length"] * 300
    rows = sharding.shards(docs(spark, texts, ids=[1] * 300).repartition(7), 240).collect()
    pages = Counter(r.shard for r in rows)
    assert len(rows) == 300 and max(pages.values()) == 10 and len(pages) == 30 and all(r.shard_bytes <= 240 for r in rows)


# 3


def by_hand(rows, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess until none is above its limit."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = share * sum(size.values())
    full: dict = {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        told = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if told[s] > most * size[s]]
        if not over:
            return size, {**full, **told}
        full |= {s: most * size[s] for s in over}


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(500)] + ODD
    sources = ["s0"] * 5 + ["s1", "s2", "s3", None, "Z"]
    df = docs(spark, texts, sources=sources)
    rows = mixing.mix_counts(df).collect()
    size, want = by_hand([(i, t, sources[i % len(sources)]) for i, t in enumerate(texts)])
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id % len(sources)]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in size)
    again = mixing.mix_counts(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    words = Counter()
    for r in mixing.mix(df).collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert all(words[r.doc_id] == r.taken for r in rows)
    assert mixing.mix(df).columns == df.columns


def test_mix_of_nothing_and_of_equal_rows(spark):
    assert mixing.mix_counts(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_counts(docs(spark, [None, "", " "])).collect()] == [0, 0, 0]
    rows = mixing.mix_counts(docs(spark, ["a b c d"] * 30, ids=[None] * 30, sources=("s",))).collect()
    assert len(rows) == 30 and len({r.taken for r in rows}) == 1 and 0 <= rows[0].target - sum(r.taken for r in rows) < 30


# 4


def test_mix_refines_its_ranges(spark, monkeypatch):
    """The same cut whether the range in which a budget ends is sorted at once or cut into ranges, to the last bit, before."""
    rng = random.Random(5)
    df = docs(spark, [prose(rng, rng.randrange(30)) for _ in range(400)] + ["same words here"] * 40, ids=[*range(400), *[7] * 40])
    want = sorted((r.doc_id, r.size, r.taken) for r in mixing.mix_counts(df).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 0)
    monkeypatch.setattr(mixing, "RANGE_BITS", 4)
    assert sorted((r.doc_id, r.size, r.taken) for r in mixing.mix_counts(df.filter("doc_id < 400")).collect()) == want


def test_grades_separate(spark):
    rng = random.Random(2)
    good = [prose(rng, 60) for _ in range(300)]
    texts = good + [f"{t} idiot {t[:20]}" for t in good[:150]] + ["BUY NOW!! " * 20 + t[:30] for t in good[150:]]
    marks = [(i, 1, 0) for i in range(300)] + [(i, 1, 1) for i in range(300, 450)] + [(i, 0, 0) for i in range(450, 600)]
    labels = spark.createDataFrame([m for m in marks if m[0] % 2] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in grades.select(docs(spark, texts + [None]), labels).collect()}
    held = [i for i in range(600) if i % 2 == 0]
    right = [rows[i].kept == (i < 300) for i in held]
    assert np.mean(right) > 0.95 and len(rows) == 601 and all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows.values())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.p_tail, 3) for r in grades.select(docs(spark, ODD), none).collect()} == {0.333}
    assert grades.select(docs(spark, []), labels).count() == 0


def test_capitals_are_counted_over_the_whole_text():
    for text in ("a" * 7999, "ab" * 2000 + "C" * 3999, ("x" * 9 + "Y") * 1000, "Éé" * 5000):
        share = sum(c.isupper() for c in text) / len(text)
        assert f"upper{min(9, int(np.ceil(np.sqrt(share) * 10)))}" in grades.shares(text)


def test_grade_scores_by_hand(spark):
    """Probabilities, expected and likeliest grades against sets and dictionaries, of whole texts, by batches of any size."""
    rng = random.Random(12)
    texts = [prose(rng, 60, 200) + (" vile idiot" if i % 5 == 0 else " splendid Craftsmanship 3!") for i in range(120)] + ODD + [prose(rng, 30_000, 3000)]
    marks = [(i, int(i % 5 > 1), int(i % 5 == 0)) for i in range(120)]
    labels = spark.createDataFrame([*marks, *marks[:9]], "doc_id long, quality int, toxic int")
    df = docs(spark, texts).unionByName(docs(spark, texts[:1]))
    model = grades.train(*grades.sample(df, grades.graded(labels), "doc_id", "text"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert list(model.features) == sorted(set(model.features)) and len(weights) > 50 and np.all(np.diff(model.thresholds) >= 0)

    def brute(text):
        words = set(re.findall(r"[^\W_]+", text.lower()))
        own = {(0, w) for w in words} | {(1, w[:4]) for w in words if len(w) > 5} | {(1, w[:5]) for w in words if len(w) > 6} | {(2, x) for x in grades.shares(text)}
        s = sum(weights.get(xxhash.xxh64_intdigest(name.encode(), kind), 0.0) for kind, name in own)
        return [1 / (1 + np.exp(c - s)) for c in model.thresholds]

    rows = grades.select(df, labels).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        first, second = brute(texts[r.doc_id] or "")
        each = [1 - first, first - second, second]
        assert r.p_tail == pytest.approx(second) and r.expected_grade == pytest.approx(first + second) and r.kept == (r.p_tail >= 0.5) and each[r.grade] == pytest.approx(max(each))


def test_grades_agree_however_rows_are_dealt(spark, monkeypatch):
    """More labelled rows than the sample takes, repeated rows and several orders: the same sample, so the same scores."""
    rng = random.Random(13)
    monkeypatch.setattr(grades, "SAMPLE", 60)
    monkeypatch.setattr(grades, "SAMPLE_CHARS", 9000)
    texts = [prose(rng, 40, 100) + (" vile" if i % 3 == 0 else "") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 1), int(i % 3 == 0)) for i in range(300)] * 2, "doc_id long, quality int, toxic int")
    df = docs(spark, texts)
    runs = [[(r.doc_id, r.p_tail) for r in grades.select(d, l).orderBy("doc_id").collect()] for d, l in ((df, labels), (df.repartition(7, "text"), labels.repartition(5)), (df.orderBy(F.rand(3)), labels.orderBy(F.rand(4))))]
    assert runs[0] == runs[1] == runs[2]
    told = grades.sample(df, grades.graded(labels), "doc_id", "text")[0]
    assert 10 < len(told) <= 60 and sum(map(len, told)) <= 9000


def test_grades_on_the_documents(spark):
    rows = {r.doc_id: r.kept for r in registry.QUERIES["op4_quality"](spark, "/root/testdata/sf0.1").collect()}
    told = {r.doc_id: (r.quality, r.toxic) for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    assert np.mean([rows[d] for d, m in told.items() if m == (1, 0)]) > 0.95
    assert np.mean([rows[d] for d, m in told.items() if m[1] == 1]) < 0.1


# 5


def test_licences(spark):
    rng = random.Random(4)
    plain = [prose(rng, 50) + "\n" + prose(rng, 30) for _ in range(80)]
    named = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    texts, want = [*plain], ["none"] * len(plain)
    for f, line in named.items():
        texts.append(plain[0] + "\n" + line)
        want.append(f)
    texts += [None, "", "The apache helicopter, version 2, was built in the desert."]
    want += ["none"] * 3
    df = docs(spark, texts)
    rows = {r.doc_id: r for r in licences.licences(df).collect()}
    assert [rows[i].family for i in range(len(texts))] == want
    assert all(rows[i].confirmed == (w != "none") for i, w in enumerate(want))
    twice = licences.licences(docs(spark, [texts[80]] * 3, ids=[5, 5, 5])).collect()
    assert [(r.family, r.n_licences) for r in twice] == [("Apache-2.0", 1)] * 3
    assert licences.licences(docs(spark, [])).count() == 0


def test_licence_scores_are_the_models(spark):
    """Families and probabilities against the model applied paragraph by paragraph."""
    rng = random.Random(15)
    known = [t for ts in licences.TEMPLATES.values() for t in ts]
    texts = [prose(rng, 20) + "\n" + " ".join(w for w in rng.choice(known).split() if rng.random() > 0.3) + "\n" + rng.choice(licences.OTHERS) for _ in range(60)]
    df = docs(spark, texts)
    weights, offset, heat = licences.train(licences.sampled(df, "text"))
    got = {r.doc_id: r for r in licences.licences(df).collect()}
    some = 0
    for i, text in enumerate(texts):
        best = []
        for n, line in enumerate(text.split("\n")):
            s = (offset + sum((weights[g] for g in licences.ngrams_of(line) if g in weights), np.zeros(len(offset)))) / heat
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            if p[:-1].max() >= max(p[-1], licences.LEAST):
                family = licences.FAMILIES[int(p[:-1].argmax())]
                pairs = {g for g in licences.ngrams_of(line) if g.count(" ") == 1}
                shapes = [{g for g in licences.ngrams_of(t) if g.count(" ") == 1} for t in licences.TEMPLATES[family]]
                alike = max(len(pairs & x) / max(1, min(len(pairs), len(x))) for x in shapes)
                best.append((alike >= licences.CONFIRMED, p[:-1].max(), alike, -n, family))
        assert got[i].n_licences == sum(x[0] for x in best)
        if best:
            some += 1
            sure, p, alike, _, family = max(best)
            assert (got[i].family, got[i].confirmed) == (family, sure) and got[i].probability == pytest.approx(p) and got[i].similarity == pytest.approx(alike)
        else:
            assert got[i].family == "none"
    assert some > 30


# 6


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered)


def test_base_counts():
    rng = random.Random(8)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab #|\n ") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += [prose(rng, 300, 6) for _ in range(20)]
    assert [perplexity.base_counts(t) for t in texts] == [brute_base(t) for t in texts]


def brute_kneser_ney(texts):
    """Modified Kneser-Ney over symbols by dictionaries, without one occurrence of the five-gram asked for; returns p(five-gram)."""
    width, top = perplexity.SYMBOL_BITS, perplexity.ORDER
    whole = Counter(int(g) for t in texts for g in perplexity.grams(t))

    def orders_of(count):
        orders = {top: count}
        for k in range(top - 1, 0, -1):
            orders[k] = Counter(g & ((1 << k * width) - 1) for g in orders[k + 1])
        return orders

    d = {k: perplexity.discounts(*[sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for k, c in orders_of(whole).items()}

    def p(gram):
        less = Counter(whole)
        less[gram] -= 1
        orders, out = orders_of(+less), perplexity.UNIFORM
        for k in range(1, top + 1):
            own = gram & ((1 << k * width) - 1)
            group = [n for g, n in orders[k].items() if g >> width == own >> width]
            if group:
                n = orders[k].get(own, 0)
                out = (max(0, n - d[k][min(n, 3)]) + sum(d[k][min(x, 3)] for x in group) * out) / sum(group)
        return out

    return p


def test_perplexity_is_kneser_neys_without_the_occurrence(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aabcde fgh.") for _ in range(50)) for _ in range(25)] + ["é 中\n#1", None, "", "привет мир привет"]
    own = [t or "" for t in texts]
    asked = np.unique(np.concatenate([perplexity.grams(t) for t in own]))
    p = brute_kneser_ney([t for t in texts if t is not None])
    some = rng.sample(range(len(asked)), 120)
    for rows in (2_000_000, 50):  # in one file each, and in many
        monkeypatch.setattr(perplexity, "FILE_ROWS", rows)
        model = perplexity.fit(docs(spark, texts), f"file://{tmp_path}/model{rows}")
        assert (model[-1]["grams"][0] > 1) == (rows == 50)
        got = np.exp(perplexity.log_probabilities(model, asked))
        assert np.allclose(got[some], [p(int(asked[i])) for i in some], rtol=1e-9)
    monkeypatch.setattr(perplexity, "CHUNK_CHARS", 300)
    monkeypatch.setattr(perplexity, "BLOCK_CHARS", 100)
    means = {r.doc_id: r.mean_log for r in perplexity.scored(docs(spark, texts), model).collect()}
    logs = dict(zip(asked.tolist(), np.log(got).tolist(), strict=True))
    assert means == pytest.approx({i: -np.mean([logs[g] for g in perplexity.grams(t).tolist()]) for i, t in enumerate(own)})


def test_letters_of_an_alphabet_have_symbols_of_their_own():
    for first, last in (("а", "я"), ("α", "ω"), ("א", "ת"), ("一", "乿"), ("!", "/")):
        points = range(ord(first), ord(last) + 1)
        assert len({int(perplexity.TABLE[x]) for x in points}) == len(points)


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(1)
    texts = [prose(rng, 80) for _ in range(200)] + ["QZX|#@%^ }{~ " * 3 + "".join(rng.choice("QZXJ{}~^@") for _ in range(600)) + " a b c d e f g h i j k"] + ODD
    rows = {r.doc_id: r for r in perplexity.quality(docs(spark, texts, langs=("en",))).collect()}
    assert np.mean([rows[i].kept or rows[i].base_failed for i in range(200)]) > 0.97 and not rows[200].kept and not rows[200].base_failed
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert perplexity.quality(docs(spark, [])).count() == 0


# 7


def test_archives_round_trip(spark, tmp_path):
    pages = [(3, "http://a b/\n", "x"), (1, None, "x"), (2, "http://c", ""), (None, "http://d", None), (4, "http://e", "é\r\n\r\nmore"), (4, "http://e", "é\r\n\r\nmore"), (5, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for version in (1, 2):
        index = archives.write_arc(df, f"file://{tmp_path}/arc{version}", version=version)
        rows = archives.read_warc(archives.arc_to_warc(index, f"file://{tmp_path}/warc{version}")).collect()
        got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows), key=str)
        want = [(3, 1, "revisit", 1), (1, 1, "response", None), (2, 0, "response", None), (None, 0, "revisit", 2), (4, 10, "response", None), (4, 10, "revisit", 4), (5, 12, "response", None)]
        assert got == sorted(want, key=str)
        assert {r.warc_date for r in rows} == {"2020-01-01T00:00:00Z"}
        least = archives.read_warc(archives.arc_to_warc(index, f"file://{tmp_path}/least{version}", 5)).collect()
        assert Counter(r.record_type for r in least) == {"response": 6, "revisit": 1}
    empty = archives.write_arc(df.limit(0), f"file://{tmp_path}/none")
    assert archives.read_warc(archives.arc_to_warc(empty, f"file://{tmp_path}/none")).count() == 0


def test_archives_from_elsewhere(spark, tmp_path):
    """A plain ARC file with records of bare line feeds, of no HTTP and of no payload, indexed by reading it; repeated pages get identifiers of their own."""
    bodies = [b"HTTP/1.0 200 OK\nContent-Type: text/html\n\npage\r\n\r\nmore", b"example.org. 1 IN A 10.0.0.1", b"HTTP/1.1 204 No Content", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\npage\r\n\r\nmore"]
    heads = ["http://a", "dns:example.org", "http://b", "http://c"]
    whole = archives.arc_block("x", 1, archives.ARCHIVE_DATE) + b"".join(f"{h} 0.0.0.0 20011231235959 text/plain {len(b)}\n".encode() + b + b"\n" for h, b in zip(heads, bodies, strict=True))
    (tmp_path / "old.arc").write_bytes(whole)
    index = archives.index_arcs(spark.createDataFrame([(f"file://{tmp_path}/old.arc",)], "arc string"))
    rows = {r.url: r for r in archives.read_warc(archives.arc_to_warc(index, f"file://{tmp_path}/warc")).collect()}
    told = {u: (r.record_type, r.payload_bytes, r.payload_digest) for u, r in rows.items()}
    page = archives.digest32(b"page\r\n\r\nmore")
    assert told == {"http://a": ("response", 12, page), "dns:example.org": ("resource", 28, archives.digest32(bodies[1])), "http://b": ("response", 0, archives.digest32(b"")), "http://c": ("revisit", 12, page)}
    assert rows["http://a"].warc_date == "2001-12-31T23:59:59Z" and len({r.record_id for r in rows.values()}) == 4
    same = spark.createDataFrame([(1, "u", "x" * 3_000_000, "clash")] * 3, "page_id long, url string, html string, arc string")
    again = archives.read_warc(archives.arc_to_warc(archives.write_arc(same, f"file://{tmp_path}/same"), f"file://{tmp_path}/same-warc")).collect()
    assert len({r.record_id for r in again}) == 3 and Counter(r.record_type for r in again) == {"response": 1, "revisit": 2}
    with pytest.raises(ValueError, match="whole number"):
        archives.write_arc(spark.createDataFrame([("a", "u", "x")], "page_id string, url string, html string"), f"file://{tmp_path}/bad")


def test_arc_with_a_wrong_length():
    import io

    whole = archives.arc_block("x", 1, archives.ARCHIVE_DATE) + archives.arc_record("u", b"payload", 1, archives.ARCHIVE_DATE, "x", 0)
    assert [h["URL"] for h, _ in archives.parse_arc(io.BytesIO(whole))] == ["u"]
    with pytest.raises(ValueError, match="declares"):
        list(archives.parse_arc(io.BytesIO(whole[:-1])))
    with pytest.raises(ValueError, match="filedesc"):
        list(archives.parse_arc(io.BytesIO(b"nothing\n")))


# 8


def test_languages_held_out(spark):
    rows = registry.QUERIES["op8_language"](spark, "/root/testdata/sf0.1").collect()
    told = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(told) and len(held) > 3000
    assert np.mean([r.lang_pred == told[r.doc_id] for r in held]) > 0.99 and all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_languages_of_odd_texts(spark):
    base = table(spark, SF, "documents").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(None, None, None), (-1, "", "en"), (-2, "123 !?", "de"), (-3, "²½", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(base.unionByName(more), F.lit(True)).collect() if r.doc_id is None or r.doc_id < 0}
    assert rows == {None: ("und", 0.0), -1: ("und", 0.0), -2: ("und", 0.0), -3: ("und", 0.0)}
    assert language.languages(base.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.languages(base.limit(5), F.lit(False)).collect()} == {"und"}


def test_switched_text_is_labelled_word_by_word(spark):
    rows = table(spark, "/root/testdata/sf0.1", "documents").filter("n_chars between 400 and 3000").select("text", "lang").limit(1500).collect()
    names, weights, moves = language.train([r.text for r in rows], [r.lang for r in rows])
    by = {n: next(language.WORDS.findall(r.text.lower())[:30] for r in rows if r.lang == n) for n in names}
    a, b = names[0], names[1]
    words = by[a] + by[b]
    p, _ = language.marginals(language.emissions(weights, words)[None], moves)
    got = p[0].argmax(axis=1)
    want = [names.index(a)] * 30 + [names.index(b)] * 30
    assert np.mean(got == want) > 0.9 and moves.trace() > moves.sum() - moves.trace()


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    names = [f"l{i:02d}" for i in range(70)]
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for n in names}
    texts = [" ".join(rng.choice(words[n]) for _ in range(30)) for _ in range(6) for n in names]
    df = docs(spark, texts + texts[:64], langs=tuple(names) * 6 + tuple(names[:64]))
    got = language.languages(df, F.col("doc_id") < 350, keep=("doc_id", "lang")).filter("doc_id between 350 and 419").collect()
    assert len(got) == 70 and {r.lang for r in got if r.lang_pred == r.lang} >= set(names[64:])
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def brute_language(text, names, weights, moves):
    """Label and score of a short text: hashes by plain integers, and marginals by listing every sequence of labels."""
    from itertools import product

    whole, prime, bits = 1 << 64, 0x100000001B3, len(weights).bit_length() - 1

    def slot(h):
        h = h * 0x9E3779B97F4A7C15 % whole
        h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % whole
        return h >> (64 - bits)

    words = re.findall(r"[^\W\d_]+", text.lower())
    scores = []
    for w in words:
        c = [2, *map(ord, w), 3]
        own = []
        for n in range(2, 6):
            for i in range(len(c) - n + 1):
                if n <= 3 or i == 0 or i + n == len(c):
                    gram = 0
                    for x in c[i : i + n]:
                        gram = (gram * prime + x) % whole
                    own.append(slot((gram * 8 + n) % whole))
        own.append(slot(sum(x * pow(prime, min(i, 63), whole) + 7 for i, x in enumerate(c)) * 8 % whole))
        scores.append(sum(weights[f].astype(float) for f in own))
    total = np.zeros((len(words), len(names)))
    for path in product(range(len(names)), repeat=len(words)):
        p = np.exp(sum(scores[i][k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, k in enumerate(path):
            total[i, k] += p
    mean = (total / total.sum(axis=1, keepdims=True)).mean(axis=0)
    return names[int(mean.argmax())], mean.max()


def test_labels_by_hand(spark):
    """Whole predictions of short texts against an independent field over plain integers."""
    rows = table(spark, SF, "documents").filter("lang is not null and n_chars between 200 and 3000").select("text", "lang").limit(300).collect()
    names, weights, moves = language.train([r.text for r in rows], [r.lang for r in rows])
    texts = [" ".join(r.text.split()[i : i + 1 + n % 5]) for n, r in enumerate(rows[:60]) for i in (0, 20)]
    texts = [t for t in texts if re.search(r"[^\W\d_]", t)] + ["a", "Überzeugung naïve", rows[0].text.split()[0] + " " + rows[-1].text.split()[0]]
    got = language.predict(iter(texts), names, weights, moves)
    for t, (name, score) in zip(texts, got, strict=True):
        want, p = brute_language(t, names, weights, moves)
        assert score == pytest.approx(p, abs=1e-5) and (name == want or abs(p - score) < 1e-5)


def test_learning_is_repeatable(spark, monkeypatch):
    """The same sample, of whole texts only, however the rows are dealt; a language of long texts only takes its shortest."""
    monkeypatch.setattr(language, "SAMPLE_CHARS", 2000)
    monkeypatch.setattr(language, "LEAST_CHARS", 300)
    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(5, 40)) for _ in range(200)] + [prose(rng, 4000), prose(rng, 3000)]
    df = docs(spark, texts, langs=("en", "de", None)).withColumn("lang", F.expr("case when doc_id >= 200 then 'long' else lang end"))
    of = lambda d: language.sample(d, F.col("doc_id"), F.col("text"), F.col("lang"))
    first = of(df)
    assert of(df.repartition(9, "text")) == first == of(df.unionByName(df).orderBy(F.rand(2)))
    assert set(first[0]) <= set(texts) and set(first[1]) == {"en", "de", "long"} and [t for t, name in zip(*first, strict=True) if name == "long"] == [min(texts[200:], key=len)]
    with pytest.raises(ValueError, match="clash"):
        language.languages(df, F.lit(True), keep=("doc_id", "score"))


def test_scan_is_the_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    lens, moves = np.array([1, 5, 32, 33, 100, 7, 100]), rng.normal(size=(20, 20))
    scores = rng.normal(size=(lens.sum(), 20)) * 2
    got = language.text_probabilities(scores, lens, moves)
    monkeypatch.setattr(language, "WIDE", 20)
    assert np.allclose(got, language.text_probabilities(scores, lens, moves)) and np.allclose(got.sum(axis=1), lens)


def test_forward_backward_over_blocks():
    rng = np.random.default_rng(0)
    lens, moves = np.array([1, 5, 32, 33, 100, 7]), rng.normal(size=(3, 3))
    scores = rng.normal(size=(lens.sum(), 3)) * 2
    got, at = language.text_probabilities(scores, lens, moves), 0
    for i, n in enumerate(lens):
        e, a, f, forward = np.exp(scores[at : at + n]), np.exp(moves), np.full(3, 1 / 3), []
        for t in range(n):
            f = (f @ a if t else f) * e[t]  # as in training, no move comes before the first word
            forward.append(f := f / f.sum())
        back, total = np.full(3, 1 / 3), 0
        for t in range(n - 1, -1, -1):
            m = forward[t] * back
            total = total + m / m.sum()
            back = a @ (back * e[t])
            back /= back.sum()
        assert np.allclose(total, got[i])
        at += n


# 9


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(150)]
    for t in texts[:40]:
        w = t.split()
        for _ in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = "CHANGED"
            texts.append(" ".join(w))
    texts += ODD + [texts[3]] * 5 + [texts[3].upper()]
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fp % (1 << 64) for i, r in rows.items()} == fps
    want = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {i: r.component_id for i, r in rows.items()} == want
    kept = simhash.keep_first(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert simhash.keep_first(docs(spark, [])).count() == 0


def test_candidates_stay_few():
    """Of unlike fingerprints, few meet under a key, at two sizes; they grew with N / 2**24 for each lookup when keys had 24 bits."""
    for n in (2000, 8000):
        fps = np.random.default_rng(n).integers(-(1 << 63), (1 << 63) - 1, n)
        at, own = simhash.keys(fps, False)
        to, looked = simhash.keys(fps, True)
        assert len(own) == 7 * n and len(looked) < 260 * n
        order = np.sort(own)
        met = (np.searchsorted(order, looked, "right") - np.searchsorted(order, looked, "left")).sum()
        assert n * 7 <= met < n * 7 + n * n * 260 / (1 << 33) * 20 + 10


def test_no_pair_within_three_bits_is_lost():
    rng = random.Random(11)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 3])):
            y ^= 1 << b
        pair = np.array([x, y], np.uint64).view(np.int64)
        at, own = simhash.keys(pair, False)
        to, looked = simhash.keys(pair, True)
        assert set(own[at == 0]) & set(looked[to == 1]) and set(own[at == 1]) & set(looked[to == 0])


def test_links_of_close_fingerprints(spark):
    rng = random.Random(12)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for b in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}


def test_links_broadcast_nothing(spark, tmp_path):
    """7 keys and up to 252 lookups of each fingerprint look as small to Spark as the fingerprints do."""
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "nodes"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "nodes")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_stars_broadcast_no_edges(spark, tmp_path):
    """Millions of edges may fit a small file; only the nodes' least ones are broadcast, if they are few."""
    spark.range(20000).selectExpr("0L as a", "id + 1 as b").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    for large in (True, False):
        many, few = (components.star(edges, large, f) for f in (False, True))
        assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in few._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
        assert many.count() == 20000


def test_equal_rows_and_null_ids_keep_one(spark):
    df = docs(spark, ["one two three four"] * 4 + ["five six seven eight"] * 3, ids=[None, 2, 2, None, 9, 9, 9])
    assert [(r.doc_id) for r in simhash.keep_first(df).orderBy("doc_id").collect()] == [2, 9]
    assert [r.doc_id for r in simhash.keep_first(docs(spark, ["x y z"] * 2, ids=[None, None])).collect()] == [None]


def test_rows_equal_in_id_and_text_keep_the_same_one(spark):
    rows = [(1, "a b c d", f"l{i}", f"s{i}", 7, 0.5, "x", i) for i in range(20)]
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA).repartition(5, "h")
    assert simhash.keep_first(a).collect() == simhash.keep_first(b).collect() and simhash.keep_first(a).count() == 1


def test_components_of_chains(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(50)] + [(7, 7), (2, 1)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes, links = sorted({x for e in edges if e[0] != e[1] for x in e}), {frozenset(e) for e in edges}
    assert got == brute_components(nodes, lambda a, b: frozenset((a, b)) in links)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10


def brute_contamination(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w = cut(t)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[s : s + n])):
                    found |= ids
                    hit |= set(range(s, s + n))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark):
    rng = random.Random(13)
    items = [(i, prose(rng, rng.choice([1, 3, 5, 7, 12, 13, 14, 20, 40]), 5000)) for i in range(40)] + [(3, "another text for three"), (None, prose(rng, 30)), (50, None), (51, "..."), (52, "same same same same same same same same same same same same same same")]
    texts = list(ODD)
    for _ in range(200):
        w = prose(rng, rng.randrange(0, 200)).split()
        for _ in range(rng.randrange(3)):
            p = items[rng.randrange(len(items))][1] or ""
            p = p.split()
            a = rng.randrange(len(p) + 1)
            w[(at := rng.randrange(len(w) + 1)) : at] = p[a : a + rng.randrange(8, 30)]
        texts.append(rng.choice([" ", ", ", "--"]).join(w))
    texts.append("same " * 40)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(texts, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination.contamination(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(x[1] > 0 for x in want) > 50
    many = docs(spark, [texts[15]] * 3, ids=[8, 8, 8])
    assert contamination.contamination(many, bench).count() == 3
    assert {r.n_hit for r in contamination.contamination(docs(spark, texts), bench.limit(0)).collect()} == {0}
    assert contamination.contamination(docs(spark, []), bench).count() == 0


def test_contamination_by_shuffles(spark, monkeypatch):
    rng = random.Random(14)
    items = [(i, prose(rng, 25, 5000)) for i in range(20)]
    texts = [prose(rng, 20) + " " + items[i % 20][1] for i in range(40)]
    monkeypatch.setattr(contamination, "FEW_HASHES", 0)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[i] for i in range(40)] == brute_contamination(texts, items)


def test_contamination_of_very_long_texts(spark):
    """Texts of 20,020 and 200,000 words, one that says one passage throughout, and a passage shared by all."""
    rng = random.Random(15)
    items = [(i, prose(rng, 40, 5000)) for i in range(10)]
    texts = [prose(rng, n, 5000) + " " + items[n % 10][1] for n in (20_020, 200_000)] + [" ".join([items[4][1]] * 400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination.contamination(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(3)] == brute_contamination(texts, items)


def test_many_dropped_documents_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Beyond FEW rows a join shuffles, even where the rows' file is small enough for Spark to broadcast."""
    from quorumlens.llm import common

    spark.range(1000).selectExpr("id as __ql_i", "md5('same') as __ql_m").write.parquet(str(tmp_path / "marks"))
    marks, rows = spark.read.parquet(str(tmp_path / "marks")), spark.range(2000).selectExpr("id as __ql_id", "md5('same') as __ql_md5")
    joined = lambda: rows.join(common.bounded(marks), F.expr("__ql_id <=> __ql_i and __ql_md5 = __ql_m"), "left_anti")
    assert "Broadcast" in joined()._jdf.queryExecution().executedPlan().toString() and joined().count() == 1000
    monkeypatch.setattr(common, "FEW", 10)
    assert "Broadcast" not in joined()._jdf.queryExecution().executedPlan().toString() and joined().count() == 1000
