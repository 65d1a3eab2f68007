"""Every operator against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import bpe, common, components, decontaminate, langid, lattice_lm, registry, sentence_spans, simhash, suffix_dedup, token_files, topk, url_filters

from .conftest import EDGE, documents, prose


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 1: top-k


def vectors(spark, seed=0, n=300, dim=8):
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, size=(n, dim)) / 4
    v[50:120] = v[50]  # a large group of copies
    out = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    out += [(1000, None), (1050, []), (1100, [1.0, None]), (1150, [float("nan")] * dim), (1200, [float("inf")] * dim), (1250, [0.5] * 3), (1300, [0.25] * 3)]
    return spark.createDataFrame(out, "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize(("slices", "block"), [(1, 2048), (2, 2048), (4, 3)])
def test_topk(spark, monkeypatch, slices, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    df = vectors(spark)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, 5, slices))}
    known = {r.vec_id: [math.floor(256 * x) for x in r.embedding] for r in df.collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)}
    want = {}
    for i, a in known.items():
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in known.items() if j != i and len(a) == len(b))
            want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(scored[:5])}
    assert got == want
    assert topk.top_k(topk.quantised(df.where("false")), F.lit(True)).count() == 0


# 2: language


def test_language(spark, edge, nothing):
    french = documents(spark, [(i, "le la les " * 20 + "été déjà " * 9) for i in range(20, 40)], {i: "fr" for i in range(20, 40)})
    english = documents(spark, [(i, "the of and with " * 20) for i in range(40, 60)])
    model = langid.fit(french.unionByName(english), ~langid.held_out())
    assert model.languages == ["en", "fr"]
    out = langid.identify(edge, model)
    assert out.count() == len(EDGE)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in rows(out)]
    assert [(p, s) for i, p, s in got if i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(0 <= s <= 1 for _, _, s in got)
    mixed = ["the of and with the of and with", "le la les le la les", "the of and with the of le la les été le la les", "漢字"]
    names, score = model.predict(mixed)
    assert names[:2] == ["en", "fr"] and score[0] == 1.0 and 0.4 < score[2] < 1.0 and names[3] in ("en", "fr")
    words, labels = model.spans([mixed[2]], penalty=2.0)
    changes = int((np.diff(labels) != 0).sum())
    assert changes == 1
    empty = langid.fit(nothing, F.lit(True))
    assert {r["lang_pred"] for r in rows(langid.identify(edge, empty))} == {"und"}
    assert langid.identify(nothing, model).count() == 0


def test_language_by_rule(spark, edge, tmp_path):
    """Every column of the query: words scored one by one, labels by trying each step of the recursion, the learned tables given."""
    texts = [(200 + i, prose(800 + i, 12) if i % 2 else "le chat noir dort déjà là où il a été " * (1 + i % 3)) for i in range(24)]
    texts += [(300, "alpha beta le chat noir dort là gamma delta epsilon zeta eta"), (301, "漢字 alpha"), (302, "слово"), (303, "le")]
    docs = edge.unionByName(documents(spark, texts, {i: None if i >= 300 else "en" if i % 2 else "fr" for i, _ in texts}))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(common.read(spark, str(tmp_path), "documents").select("doc_id", "text", "lang"), ~langid.held_out())
    want = Counter()
    for r in docs.collect():
        w = langid.Words([r.text])
        scores = [[sum(float(model.table[c, k]) for c in w.codes[s : s + n]) if model.allowed[w.script[j], k] else -1e9 for k in range(len(model.languages))] for j, (s, n) in enumerate(zip(w.starts, w.sizes))]
        best = [(s, (k,)) for k, s in enumerate(scores[0])] if scores else []
        for row in scores[1:]:
            best = [max(((v - (langid.PENALTY if path[-1] != k else 0) + row[k], path + (k,)) for v, path in best), key=lambda x: x[0]) for k in range(len(row))]
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        if not scores:
            want[r.doc_id, held, "und", 0.0] += 1
            continue
        mass = Counter()
        for k, n in zip(max(best, key=lambda x: x[0])[1], w.sizes):
            mass[k] += int(n)
        top = max(sorted(mass), key=mass.__getitem__)
        want[r.doc_id, held, model.languages[top], round(mass[top] / sum(mass.values()), 9)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in rows(langid.op2_langid(spark, str(tmp_path))))
    assert got == want and {k[2] for k in want} >= {"en", "fr", "und"}


def test_scripts_narrow_candidates():
    table = np.zeros((1 << langid.BITS, 2))
    scripts = np.zeros((len(langid.NAMES), 2))
    scripts[langid.NAMES.index("latin"), 0] = 10
    scripts[langid.NAMES.index("cyrillic"), 1] = 10
    model = langid.Model(["aa", "bb"], table, scripts)
    assert model.predict(["слово слово", "word word"])[0] == ["bb", "aa"]


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(0, 6, rng.integers(1, 5))
        text = np.repeat(np.arange(len(sizes)), sizes)
        s = rng.normal(size=(len(text), 3)) * 3
        labels = langid.viterbi(s, text, len(sizes), 1.5)
        for i in range(len(sizes)):
            m, g = s[text == i], labels[text == i]
            value = lambda p: sum(m[j, p[j]] for j in range(len(m))) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
            if len(m):
                assert math.isclose(max(map(value, itertools.product(range(3), repeat=len(m)))), value(list(g)))


# 3: suffix arrays


def removed(texts, n=suffix_dedup.LENGTH):
    """What is left of each text by the rule, and the runs that go, brute force."""
    c = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if c[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = bytes(gone).split(b"\0")
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(map(bool, runs))))
    return out


def test_repeated_places():
    rng = random.Random(5)
    for alphabet in (b"ab", b"abcdefgh"):
        base = bytes(rng.choice(alphabet) for _ in range(3000))
        texts = [base[(s := rng.randrange(2300)) : s + rng.randrange(380, 700)] for _ in range(8)] + [b"a" * 600, b"a" * 450]
        n = suffix_dedup.LENGTH
        c = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        for t, got in zip(texts, suffix_dedup.repeated_places(texts)):
            assert got.tolist() == [c[t[i : i + n]] > 1 for i in range(max(0, len(t) - n + 1))]


@pytest.mark.parametrize("contexts", [512, 2])
def test_suffix_dedup(spark, edge, nothing, monkeypatch, tmp_path, contexts):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    shared = prose(77, 90)
    more = documents(spark, [(100 + i, prose(200 + i, 60) + "\n" + shared[i:] + "\n" + prose(300 + i, 40)) for i in range(12)])
    docs = edge.unionByName(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(suffix_dedup.op3_suffix_dedup(spark, str(tmp_path)))
    texts = [common.text_bytes(r.text) for r in docs.select("text").collect()]
    want = Counter((len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for t, (k, n) in zip(texts, removed(texts)))
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    for length in (64, 200):
        left = Counter(r.text or "" for r in suffix_dedup.remove_repeats(docs, length).select("text").collect())
        assert left == Counter(k.decode("utf-8", "ignore") for k, _ in removed(texts, length))
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_passages_by_words(spark):
    """Repeated passages of 50 words go wherever they are, shorter ones stay, whatever the bytes of a word."""
    few, many, short = prose(91, 45), prose(92, 50), " ".join(f"w{i:02}" for i in range(52))
    around = lambda k, p: f"{prose(600 + k, 30)} | {p} | {prose(700 + k, 30)}"
    texts = [(k, around(k, p)) for k, p in enumerate([few, few, many, many, many, short, short])] + [(10, prose(93, 200))]
    assert len(few) > 200 and len(short) > 200
    kept = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(documents(spark, texts), 200, 50).collect()}
    for k, t in texts:
        want = t if k in (0, 1, 10) else t.replace(" | " + (many if k < 5 else short) + " | ", "")
        # a byte or two of what is around may be the same by chance
        assert kept[k] == want if k in (0, 1, 10) else len(want) - 20 <= len(kept[k]) <= len(want), k
    gone = np.array([0, 1, 1, 1, 1, 1, 0, 1, 1], bool)
    assert suffix_dedup.without_short(gone, b"aa b ccdd", 1).tolist() == [0, 1, 1, 1, 1, 1, 0, 0, 0]
    assert not suffix_dedup.without_short(gone, b"aa b ccdd", 2).any()
    assert suffix_dedup.without_short(gone, b"aa b ccdd", 0).tolist() == gone.tolist()


def shared_words(texts, n=suffix_dedup.PASSAGE):
    """Runs of words that n words elsewhere cover, and their words, of each text, brute force."""
    texts = [[w for w in re.split(rb"[ \t\n\v\f\r]", t) if w] for t in texts]
    c = Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if c[tuple(t[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((sum(map(bool, bytes(gone).split(b"\0"))), sum(gone)))
    return out


@pytest.mark.parametrize("contexts", [512, 2])
def test_passages_elsewhere(spark, edge, monkeypatch, tmp_path, contexts):
    """op3 tells passages of 50 words that are elsewhere, shorter than 400 bytes or not, and removes none for it."""
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    short, few, hot = " ".join(f"w{i:02}" for i in range(55)), " ".join(f"v{i:02}" for i in range(49)), " ".join(f"u{i:02}" for i in range(70))
    around = lambda k, p: f"{prose(600 + k, 30)} {p} {prose(700 + k, 30)}"
    texts = [(100, around(0, short)), (101, around(1, short.replace(" ", "\n\u00a0x ", 1))), (102, around(2, short.replace(" ", "\t  "))), (103, around(3, few)), (104, around(4, few)), (105, short), (106, "\u00a0".join(short.split()))]
    texts += [(110 + i, around(10 + i, " ".join(hot.split()[i : 62 + i // 2]))) for i in range(12)]
    docs = edge.unionByName(documents(spark, texts))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = rows(suffix_dedup.op3_suffix_dedup(spark, str(tmp_path)))
    found = docs.select("doc_id", "text").collect()
    want = shared_words([common.text_bytes(r.text) for r in found])
    assert Counter((r["doc_id"], r["n_passages"], r["passage_words"]) for r in out) == Counter((r.doc_id, *w) for r, w in zip(found, want))
    got = {r["doc_id"]: r for r in out}
    assert [got[k]["passage_words"] for k in range(100, 107)] == [55, 54, 55, 0, 0, 55, 0]
    assert [got[k]["n_removed"] for k in range(100, 107)] == [0] * 7


def test_repeated_places_of_words():
    rng = random.Random(6)
    for alphabet in ("ab", "abcdefgh"):
        base = [rng.choice(alphabet) * rng.randint(1, 9) for _ in range(400)]
        texts = [base[(s := rng.randrange(300)) : s + rng.randrange(5, 99)] for _ in range(12)] + [["a"] * 80, ["a"] * 51]
        n = suffix_dedup.PASSAGE
        c = Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
        for t, got in zip(texts, suffix_dedup.repeated_places([" ".join(t).encode() for t in texts], n, suffix_dedup.WORDS)):
            assert got.tolist() == [c[tuple(t[i : i + n])] > 1 for i in range(max(0, len(t) - n + 1))]


# 4: lattice


def test_forward_sums_all_segmentations():
    v = lattice_lm.pieces(lattice_lm.vocabulary_path())
    logs = np.log(v.prior[:, None])
    index = {p: i for i, p in enumerate(v.pieces)}

    def brute(word: bytes) -> float:
        if not word:
            return 1.0
        return sum(math.exp(logs[index[word[:k]], 0]) * brute(word[k:]) for k in range(1, len(word) + 1) if word[:k] in index)

    words = [b"the", b"thing", b"ing", b"x", "été".encode(), b"zzqj"]
    got = v.words(words, logs)[:, 0]
    assert np.allclose(got, [math.log(brute(b" " + w)) for w in words])
    counts = np.zeros((len(v.pieces), 1))
    v.words([b"thing"], logs, counts, np.ones((1, 1)))
    # expected pieces cover the word's bytes once
    assert math.isclose(sum(len(p) * counts[i, 0] for i, p in enumerate(v.pieces)), len(b" thing"))


def test_scores(spark, edge, nothing):
    more = documents(spark, [(100 + i, prose(i % 7, 60)) for i in range(40)])
    docs = edge.unionByName(more)
    got = rows(lattice_lm.score(docs, lattice_lm.held_out()))
    tokens = [(r.doc_id, [*lattice_lm.words_of(r.text), None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(t for i, ts in tokens if not held(i) for t in ts)
    total, size = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ts), sum(c[t] > 0 for t in ts), total, round(sum(math.log10((c[t] + 0.1) / (total + 0.1 * (size + 1))) for t in ts), 5)) for i, ts in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lattice_lm.score(nothing, lattice_lm.held_out()).count() == 0


def cuts(word: bytes, pieces: set, start: int = 0):
    """All ways to cut a word into pieces."""
    if start == len(word):
        yield []
    for end in range(start + 1, len(word) + 1):
        if word[start:end] in pieces:
            yield from ([word[start:end], *rest] for rest in cuts(word, pieces, end))


def test_lattice_scores(spark):
    """The score by its definition: all cuts of every word listed, sums without logarithms."""
    words = "a to tea team stream zq é".split()
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(100 + i, f"new{i} tea") for i in range(40)]
    langs = {i: "fr" if i % 3 == 0 else "en" for i, _ in texts}
    got = {r["doc_id"]: r["score"] for r in rows(lattice_lm.score(documents(spark, texts, langs), lattice_lm.held_out()))}
    v = lattice_lm.pieces(lattice_lm.vocabulary_path())
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    labels = [x for x, _ in sorted(Counter(langs[i] for i, _ in texts if i not in held).items(), key=lambda x: (-x[1], x[0]))] + [None]
    count = {k: Counter(w.encode() for i, t in texts if i not in held and langs[i] == k for w in t.split()) for k in labels}
    ends = {k: sum(i not in held and langs[i] == k for i, _ in texts) for k in labels}
    every = sum(count.values(), Counter())
    prior = dict(zip(v.pieces, v.prior))
    known = {w: list(cuts(b" " + w, prior.keys())) for w in {x.encode() for _, t in texts for x in t.split()}}
    chance = lambda cut, p: math.prod(p[x] for x in cut)
    share, weight, novel = {}, {}, {}
    n_words, n_ends = sum(every.values()), sum(ends.values())
    for k in labels:
        n = {p: q * lattice_lm.PRIOR for p, q in prior.items()}
        for w in count[k]:
            whole = sum(chance(c, prior) for c in known[w])
            for c in known[w]:
                for p in c:
                    n[p] += chance(c, prior) / whole
        size = sum(n.values())
        share[k] = {p: x / size for p, x in n.items()}
        once = sum(every[w] == 1 and count[k][w] == 1 for w in every)
        novel[k] = (once + 1) / (sum(count[k].values()) + 2)
        weight[k] = (ends[k] + 1) / (n_ends + len(labels))
    assert held and len(known[b"stream"]) > 10
    for i, t in texts:
        total = 0.0
        for k in labels:
            p = weight[k] * (n_ends + 1) / (n_words + n_ends + 2)
            for w in (x.encode() for x in t.split()):
                own = (1 - lattice_lm.COMMON) * count[k][w] / max(sum(count[k].values()), 1) + lattice_lm.COMMON * every[w] / n_words
                p *= ((1 - novel[k]) * own + novel[k] * sum(chance(c, share[k]) for c in known[w])) * (n_words + 1) / (n_words + n_ends + 2)
            total += p
        assert math.isclose(got[i], math.log10(total), rel_tol=1e-9), (i, t)


# 5: token files


def test_coder_beats_order0():
    """Streams, tables, sizes and checksums together are smaller than the entropy of single ids."""
    ids = np.array([x for k in range(400) for x in bpe.codec().library.encode(prose(k % 90, 200), add_special_tokens=False).ids], np.uint32)
    p = np.bincount(ids)
    p = p[p > 0] / len(ids)
    e = token_files.encode_group(ids)
    size = sum(len(e[x]) for x in ("symbols", "frequencies", "stream")) + 12 * len(e["sizes"])
    assert size * 8 / len(ids) < -(p * np.log2(p)).sum()
    assert np.array_equal(token_files.decode_group(len(ids), *(e[x] for x in ("steps", "symbols", "frequencies", "stream", "sizes", "checksums"))), ids)


@pytest.mark.parametrize("ids", [[5], [1, 2, 3], list(range(3000)), [7] * 5000, [3, 1, 4, 1, 5, 9, 2, 6] * 700, [0, 65535] * 40])
def test_coder_round_trip(ids):
    a = np.array(ids, np.uint32)
    e = token_files.encode_group(a)
    args = (len(a), e["steps"], e["symbols"], e["frequencies"], e["stream"], e["sizes"], e["checksums"])
    assert np.array_equal(token_files.decode_group(*args), a)
    with pytest.raises(ValueError, match="checksum"):
        token_files.decode_group(*args[:-1], e["checksums"] + 1)


@pytest.mark.parametrize("group", [500, 5000])
def test_token_files(spark, edge, nothing, monkeypatch, group):
    monkeypatch.setattr(token_files, "GROUP", group)
    folder = common.new_path(spark, "tokens")
    token_files.write(edge, folder)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows(token_files.read(spark, folder)))
    c = bpe.codec()
    packed = [(i, np.append(np.array(c.library.encode(t or "", add_special_tokens=False).ids, dtype="<u4"), np.uint32(0)).astype("<u4")) for i, t in EDGE]
    assert got == Counter((i, len(p), zlib.crc32(p.tobytes())) for i, p in packed)
    ordered = sorted((r["start"], r["n_tokens"]) for r in rows(token_files.read(spark, folder)))
    assert [s for s, _ in ordered] == [sum(n for _, n in ordered[:k]) for k in range(len(ordered))]
    other = common.new_path(spark, "tokens")
    token_files.write(nothing, other)
    assert token_files.read(spark, other).count() == 0


# 6: URLs


def test_url_filters(spark):
    captures = spark.createDataFrame(
        [(1, "https://a.b.com/x/y?q#f", "2024-02-01"), (2, "http://u@B.com:80/", "2024-01-10"), (3, None, "2024-01-10"), (4, "b.com/x/yy", "2024-03-01"), (5, "https://b.com", None), (6, "", "2024-01-01"), (1, "https://a.b.com/x/y?q#f", "2024-02-01")],
        "capture bigint, url string, fetched string",
    ).withColumn("fetched", F.col("fetched").cast("date"))
    captures = captures.withColumns({c: F.lit(1) for c in ("kind", "key", "list", "host", "path", "valid_from", "n_active", "reason", "times", "k")})
    log = spark.createDataFrame(
        [("l", "domain", "b.com", "add", "2024-01-10"), ("l", "domain", "b.com", "add", "2024-01-15"), ("l", "domain", "b.com", "remove", "2024-02-01"), ("m", "prefix", "a.b.com/x", "add", "2024-01-01"), ("m", "host", "b.com", "add", "2024-03-02"), (None, "host", "b.com", "add", "2024-01-01"), ("m", "host", "b.com", "other", "2024-01-01")],
        "list string, kind string, key string, action string, day string",
    ).withColumn("day", F.col("day").cast("date"))
    log = log.withColumns({c: F.lit(1) for c in ("capture", "fetched", "url", "salt", "was", "valid_from")})
    found = rows(url_filters.evaluate(captures, log.unionByName(log)))
    got = {r["capture"]: (r["blocked"], r["n_active"], r["lists"], r["reason"]) for r in found}
    none = (False, 0, None, None)
    assert len(found) == 6 and got == {1: (True, 1, "m", "m:prefix:a.b.com/x"), 2: (True, 1, "l", "l:domain:b.com"), 3: none, 4: none, 5: none, 6: none}
    assert url_filters.evaluate(captures, log.where("false")).where("blocked").count() == 0
    assert url_filters.evaluate(captures.where("false"), log).count() == 0


def test_prefix_of_any_depth(spark):
    captures = spark.createDataFrame([(1, "http://h.org/a/b/c/d/e", 5), (2, "http://h.org/a/b/c/x", 5), (3, "http://h.org/", 5)], "capture bigint, url string, fetched int")
    log = spark.createDataFrame([("l", "prefix", "h.org/a/b/c/d/e", 1, "add")], "list string, kind string, key string, day int, action string")
    assert {r.capture: r.blocked for r in url_filters.evaluate(captures, log).collect()} == {1: True, 2: False, 3: False}
    deep = "h.org/" + "/".join(map(str, range(40)))
    pages = spark.createDataFrame([(k, "http://" + deep) for k in range(3)], "page_id bigint, url string")
    logged = url_filters.page_log(url_filters.page_captures(pages)).where("kind = 'prefix'").select("key").distinct()
    assert logged.agg(F.max(F.size(F.split("key", "/")))).first()[0] > 30


# 7: SimHash


def test_fingerprint():
    text = "One two  three\tfour One"
    w = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode(), 3)[0][0] % (1 << 64) == want
    assert simhash.fingerprint(b" \n", 3)[0] == [0]
    assert simhash.fingerprint(b"Ab", 3)[0][0] % (1 << 64) == xxhash.xxh64_intdigest(b"ab", 42)


@pytest.mark.parametrize(("parts", "radius", "tile"), [(1, 3, 2048), (2, 3, 4), (4, 3, 2048), (1, 20, 8)])
def test_components_of_fingerprints(spark, monkeypatch, parts, radius, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for k in range(120):
        prints.append(prints[rng.randrange(len(prints))] ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) % (1 << 64))
    prints += [0, 0, 7]
    f = np.array(prints, dtype=np.uint64)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "doc_id bigint, f0 bigint")
    near = np.bitwise_count(f[:, None] ^ f[None]) <= radius
    label = np.arange(len(f))
    while not np.array_equal(new := np.array([label[row].min() for row in near]), label):
        label = new
    assert {r["doc_id"]: r["component_id"] for r in rows(simhash.component_ids(df, radius, 1, parts))} == dict(enumerate(label.tolist()))


def test_near_duplicates(spark, edge, nothing):
    out = rows(simhash.near_duplicates(edge))
    assert len(out) == len(EDGE)
    named = {r["doc_id"]: r for r in out}
    assert named[2]["fingerprint"] == "0" * 16 and {named[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert named[6]["component_id"] == 5
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one(spark):
    base = prose(9, 400).split()
    texts = [(1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (5, prose(10, 400)), (6, prose(11, 400)), (None, prose(12, 30))]
    for i in range(20, 40):
        edited = list(base)
        edited[i * 7] = "other"
        texts.append((i, " ".join(edited)))
    kept = simhash.keep_one(documents(spark, texts))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6]
    assert kept.columns == documents(spark, texts).columns
    again = simhash.keep_one(documents(spark, [(1, "a b c"), (1, "a b c")]))
    assert again.count() == 1


def test_keep_one_by_document(spark):
    """A document is an id with a text: another text under the id of a copy stays, and so do rows without an id."""
    w, v = prose(13, 60), prose(14, 60)
    kept = lambda texts: sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_one(documents(spark, texts)).collect())
    assert kept([(1, w), (2, w), (2, v)]) == [(1, w), (2, v)]
    assert kept([(1, w), (1, w), (2, w), (2, v), (2, v), (2, v)]) == [(1, w), (2, v)]
    near = w + " end"
    assert len(kept([(3, w), (3, near), (4, near), (4, v)])) == 2
    assert kept([(None, w), (None, w), (5, w)]) == [(0, w), (0, w), (5, w)]
    assert kept([(1, None), (2, None), (3, "")]) == [(1, "")]


def test_near_copies_found(spark):
    """At least nine in ten of planted near copies of a similarity of 0.8 or more go; texts below it stay."""
    rng = random.Random(8)
    texts, pairs = [], []
    for k in range(150):
        words = prose(1000 + k, 120 + k).split()
        texts.append((k, " ".join(words)))
        for _ in range(1 + k % 9):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        texts.append((1000 + k, " ".join(words)))
        pairs.append(similarity(texts[-2][1], texts[-1][1]))
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()}
    near = [k for k, s in enumerate(pairs) if s >= 0.8]
    assert 50 < len(near) < 150 and all(k in kept for k in range(150))
    assert all(1000 + k in kept for k in set(range(150)) - set(near))
    assert sum(1000 + k not in kept for k in near) >= 0.9 * len(near)


def test_large_family_of_texts(spark):
    """A family within the radius but below 0.8 is met in tiles; no row is made for a pair that is not similar."""
    base = prose(40, 400).split()
    family = []
    for k in range(120):
        rng = random.Random(k)
        family.append((k, " ".join(f"y{k}" if rng.random() < 0.035 else w for w in base)))
    family.append((500, family[7][1] + " more"))
    docs = documents(spark, family)
    prints = simhash.set_fingerprints(docs, 5, (42, 43, 44, 45), 12)
    links = [(r.u, r.v) for r in simhash.similar_links(docs, prints.drop("sketch"), 54, 5, 42, 4).collect()]
    label = {i: i for i, _ in family}
    for (i, a), (j, b) in itertools.combinations(family, 2):
        if similarity(a, b) >= 0.8:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {k: new if v == old else v for k, v in label.items()}
    assert label[500] == label[7] and len(links) <= 2 * len(family)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(label.values())


def similarity(a: str, b: str) -> float:
    x, y = (set(simhash.shingles(t.encode(), 5)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_keep_one_checks_similarity(spark):
    base = prose(20, 400).split()

    def edited(places):
        return " ".join("other" + str(i) if i in places else w for i, w in enumerate(base))

    # 2 to 6: 0.6 to 0.79 to the base and below 0.8 to each other; 7 is similar to 6 only, 8 to the base
    texts = [(1, " ".join(base))] + [(2 + k, edited(set(range(k, 400, 400 // n)))) for k, n in enumerate((10, 12, 14, 16, 18))]
    texts += [(7, texts[-1][1] + " more"), (8, edited({200}))]
    # one long run of a word in two languages: sets of shingles with one in common
    texts += [(20, prose(21, 40) + " la" * 3000), (21, prose(22, 40) + " la" * 3000), (22, " ".join(["la"] * 2000)), (23, " ".join(["la"] * 2500))]
    at = [similarity(texts[0][1], t) for _, t in texts[1:6]]
    assert all(0.6 <= s < 0.8 for s in at), at
    label = {i: i for i, _ in texts}
    for i, a in texts:
        for j, b in texts:
            if similarity(a, b) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    want = sorted(set(label.values()))
    assert 20 in want and 21 in want and 22 in want and 7 not in want and 8 not in want and 23 not in want
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()) == want


def test_similar_pairs_behind_failed_links(spark):
    """Spanning links within the radius may fail where another pair of the same group is similar."""
    base = prose(30, 400).split()
    texts = []
    for k in range(12):  # pairs of similar texts around one base, each pair far from the others
        words = [f"x{k}" if i % 36 == k * 3 % 36 else w for i, w in enumerate(base)]
        texts += [(k, " ".join(words)), (100 + k, " ".join(words[:-1]))]
    want = {k for k, _ in texts if k < 100}
    assert all(similarity(texts[0][1], t) < 0.8 for _, t in texts[2:])
    assert {r.doc_id for r in simhash.keep_one(documents(spark, texts), radius=256).collect()} == want


def brute_kept(texts: list[tuple[int, str]]) -> set[int]:
    label = {i: i for i, _ in texts}
    for (i, a), (j, b) in itertools.combinations(texts, 2):
        if similarity(a, b) >= 0.8:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {k: new if v == old else v for k, v in label.items()}
    return set(label.values())


def families(n: int, size: int) -> list[tuple[int, str]]:
    """Texts of n families that have nothing in common; neighbours of a family have a similarity of some 0.83, others less."""
    texts = []
    for k in range(n):
        words = prose(2000 + k, 120 + 5 * k).split()
        for i in range(size):
            words[7 + 23 * (i % 5)] = f"edit{k}x{i}"
            words[14 + 23 * (i % 5)] = f"edit{k}y{i}"
            texts.append((100 * k + i, " ".join(words)))
    return texts


def test_work_follows_groups_of_shared_hashes(spark, monkeypatch):
    """Texts that have no sketch hash in common, even by others between them, are never in tiles that meet."""
    texts = families(12, 9)
    family = {simhash.set_name(simhash.shingle_set(t.encode(), 5)): i // 100 for i, t in texts}
    monkeypatch.setattr(simhash, "WIDE_TILE", 4)
    monkeypatch.setattr(simhash, "GROUP", 3, raising=False)
    met = []
    scratch = common.scratch

    def watched(df, name):
        out = scratch(df, name)
        if name == "tiles":
            key = "key" if "key" in out.columns else F.lit(0)
            met.extend((name, r.key, family[r.node]) for r in out.select(F.concat_ws("/", key).alias("key"), F.explode("prints.node").alias("node")).collect())
        return out

    monkeypatch.setattr(common, "scratch", watched)
    assert {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()} == brute_kept(texts)
    assert met and len(set(met)) == len({m[:2] for m in met})


@pytest.mark.parametrize("group, held", [(256, 1 << 16), (256, 1), (3, 1)])
def test_shared_links(spark, monkeypatch, group, held):
    """Links of keyed rows span, for each key, what is within the radius; groups in tiles, beside others, or across batches."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "ROWS", held)
    monkeypatch.setattr(simhash, "WIDE_TILE", 4)
    texts = families(8, 9)
    prints = simhash.set_fingerprints(documents(spark, texts), 5, (42, 43, 44, 45), 12).localCheckpoint()
    each = prints.select("node", F.explode("sketch").alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = each.join(counts, "key").join(prints.drop("sketch", "h", "doc_id"), "node").select("key", "n", "node", "f0", "f1", "f2", "f3", "size")
    rows_of = keyed.collect()

    def groups(links):
        label = {r.node: r.node for r in rows_of}
        for a, b in links:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
        return label

    bits = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[3:7], b[3:7]))
    want = {(a.node, b.node) for a, b in itertools.permutations(rows_of, 2) if a.key == b.key and a.node < b.node and bits(a, b) <= 54 and min(a.size, b.size) * 5 >= max(a.size, b.size) * 4}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = [(r.a, r.b) for r in simhash.shared_links(keyed, 54, 4).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    distance = {r.node: r for r in rows_of}
    assert want and all(a < b and bits(distance[a], distance[b]) <= 54 for a, b in found) and len(set(found)) == len(found)
    assert groups(found) == groups(want)


def test_levels_of_sizes(spark):
    """Set sizes of a ratio of 0.8 or more are in the same or the next level."""
    top = 20_000
    by = [r.c for r in spark.range(1, top + 1).select(simhash.level(F.col("id")).alias("c")).collect()]
    assert all(by[(n * 5 // 4) - 1] - by[n - 1] in (0, 1) for n in range(1, top * 4 // 5))


def test_links_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "u bigint, v bigint")
    assert {r.node: r.root for r in components.components(links).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(links.where("false")).count() == 0


# 8: sentences


def test_sentence_spans(spark, edge, nothing):
    run = "First one here. Second one there. Third one now. "
    more = [(100, run + prose(50, 40)), (101, prose(51, 40) + " " + run), (102, prose(52, 60)), (103, "FIRST one  here.\nSecond one there. Third one now.")]
    docs = edge.unionByName(documents(spark, more))
    # by the rule: all runs of each distinct document, the first occurrence stays
    kept = {}
    distinct = sorted({(i, t) for i, t in [*EDGE, *more]}, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    found = [(i, t, sentence_spans.sentences(t)) for i, t in distinct]
    seen = {}
    for k, (i, t, s) in enumerate(found):
        for at in range(len(s) - 2):
            seen.setdefault(tuple(" ".join(x.lower().split()) for x in s[at : at + 3]), []).append((k, at))
    for k, (i, t, s) in enumerate(found):
        gone = {at + j for name, places in seen.items() for kk, at in places[1:] if kk == k for j in range(3)}
        kept[i, t] = "\n".join(x for j, x in enumerate(s) if j not in gone) if gone else (t or "")
    got = sentence_spans.remove_repeated(docs)
    assert got.count() == docs.count()
    for r in got.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").collect():
        if (r.doc_id, r.t) in kept and r.doc_id not in (6,):
            assert (r.text or "") == kept[r.doc_id, r.t], r.doc_id
    assert sentence_spans.remove_repeated(nothing).count() == 0
    long = " ".join(f"w{i}" for i in range(60)) + "."
    assert len(sentence_spans.sentences(long)) == 4 and sentence_spans.sentences(None) == []


def test_sentence_spans_by_rule(spark, edge, tmp_path):
    """Every column of the query: all runs of all distinct documents listed, the first occurrence stays."""
    run = "First one here. Second one there. Third one now. "
    more = [(100, run + prose(50, 40)), (101, prose(51, 40) + " " + run), (6, "Other text. " + run), (102, run + "And more. " + run), (103, run[:-20])]
    docs = edge.unionByName(documents(spark, more)).unionByName(documents(spark, more[:1]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    every = [(r.doc_id, r.h, r.text) for r in docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()]
    places = {}
    for i, h, t in sorted(set(every), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        found = [" ".join(s.lower().split()) for s in sentence_spans.pieces(t)]
        for at in range(len(found) - 2):
            places.setdefault(tuple(found[at : at + 3]), []).append((i, h, at))
    starts = {}
    for found in places.values():
        for i, h, at in found[1:]:
            starts.setdefault((i, h), set()).add(at)
    want = Counter()
    for i, h, t in every:
        if (i, h) in starts:
            found = sentence_spans.pieces(t)
            gone = [any(at <= k < at + 3 for at in starts[i, h]) for k in range(len(found))]
            left = "\n".join(s for s, g in zip(found, gone) if not g)
            want[i, len(found), sum(gone), sum(g and not b for g, b in zip(gone, [False, *gone])), hashlib.sha256(left.encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_sentences"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(sentence_spans.op8_sentence_spans(spark, str(tmp_path))))
    assert got == want and sum(n for n in want.values()) >= 6


def test_passage_at_any_offset(spark):
    """A passage of 60 words without sentence ends, mid-sentence at all 16 offsets; runs of words and of two words."""
    plain = lambda seed, n: prose(seed, n).replace(".", "")
    passage = plain(60, 60)
    texts = [(k, f"{plain(100 + k, 40 + k)} {passage} {plain(200 + k, 40)}") for k in range(17)]
    texts += [(20 + k, f"{plain(300 + k, 20 + k)} {'to be ' * 60}{plain(400 + k, 30)}") for k in range(4)]
    texts += [(30 + k, f"{plain(500 + k, 20 + k)} {'und ' * (50 + k)}{plain(600 + k, 30)}") for k in range(16)]
    kept = {r.doc_id: r.text.split() for r in sentence_spans.remove_repeated(documents(spark, texts)).collect()}
    assert all(kept[30 + k].count("und") <= 20 for k in range(1, 16))
    assert kept[0] == texts[0][1].split() and kept[20][:20] == texts[17][1].split()[:20]
    inside = set(passage.split())
    for k in range(1, 17):
        words = texts[k][1].split()
        assert kept[k][: 36 + k] == words[: 36 + k] and kept[k][-36:] == words[-36:]  # what is around stays
        assert len([w for w in words if w in inside]) - len([w for w in kept[k] if w in inside]) >= 30, k
    assert all(kept[20 + k].count("be") < 20 for k in range(1, 4))
    for text in (texts[3][1], "one " * 1000, "a b c " * 500, " ".join(f"w{i}" for i in range(999))):
        found = sentence_spans.pieces(text)
        assert " ".join(found) == text.strip() and all(len(p.split()) <= 16 for p in found)


# 9: decontamination


def edits(pattern: bytes, text: bytes) -> int:
    """Fewest edits between a pattern and any part of a text."""
    t = np.frombuffer(text, np.uint8)
    cost, s = np.zeros(len(t) + 1, int), np.arange(len(t) + 1)
    for ch in pattern:
        new = np.empty_like(cost)
        new[0] = cost[0] + 1
        new[1:] = np.minimum(cost[:-1] + (t != ch), cost[1:] + 1)
        cost = np.minimum.accumulate(new - s) + s
    return int(cost.min())


def test_matches_are_exact():
    items = [(i, prose(400 + i, n)) for i, n in enumerate((6, 12, 30, 45, 1, 2, 3, 4))] + [(8, "abc"), (9, "Q")]
    index = decontaminate.Index(items)
    assert index.budget.tolist() == [len(t) // 10 for t in index.texts] and len(index.texts) == len(items)
    rng = random.Random(3)
    for _ in range(300):
        k = rng.randrange(len(items))
        p, e = bytearray(index.texts[k].tobytes()), int(index.budget[k])
        for _ in range(min(rng.randint(0, e + 4), len(p) - 1)):
            at, kind = rng.randrange(len(p)), rng.random()
            if kind < 0.34:
                p[at] = rng.choice(b"abcdefgh ")
            elif kind < 0.67:
                del p[at]
            else:
                p.insert(at, rng.choice(b"abcdefgh"))
        text = decontaminate.normal(prose(rng.randrange(1000), 60)) + b" " + bytes(p) + b" " + decontaminate.normal(prose(rng.randrange(1000), 60))
        found = {i: (n, at) for _, i, n, at in index.scan([b"", text, b"abx"]) if _ == 1}
        for j in {k, *range(4, 10)}:
            want = edits(index.texts[j].tobytes(), text)
            assert (j in found) == (want <= index.budget[j]) and found.get(j, (want,))[0] == want, items[j]
            if j in found and want == 0:
                assert text[found[j][1] :].startswith(index.texts[j].tobytes())


def test_decontaminate(spark, edge, nothing):
    bench = spark.createDataFrame([(0, prose(500, 40)), (1, None), (2, ""), (3, "abc"), (4, "aaaa aaaa"), (0, prose(500, 40)), (None, prose(3, 20))], "item_id bigint, text string")
    more = documents(spark, [(100, prose(501, 50) + " " + prose(500, 40).upper().replace(" ", ", ") + prose(502, 20)), (101, prose(503, 100))])
    docs = edge.unionByName(more)
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.matches(docs, bench))}
    assert (100, 0) in got and not any(d == 101 for d, _ in got)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})
    assert decontaminate.matches(nothing, bench).count() == 0 and decontaminate.matches(docs, bench.where("false")).count() == 0


# 10: BPE


def test_codec_equals_the_library():
    c = bpe.codec()
    rng = random.Random(1)
    parts = [*"aabcdehlrstvm'' \n\n\t .,!?-0123é ñ\xa0　ßжд漢字😀xjqzwkgfvb<|>", "<|endoftext|>", "'s", "'ll", "  ", "\n\n", "'ve", "́", "Ⅷ", "²", "\x1c", "\x85", " ", " "]
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = c.library.encode(s, add_special_tokens=False).ids
        assert c.encode(s).tolist() == ids, repr(s)
        assert c.decode(ids) == c.library.decode(ids, skip_special_tokens=False)


def test_digests(spark, edge, nothing):
    c = bpe.codec()
    want = []
    for i, t in EDGE:
        ids = c.library.encode(t or "", add_special_tokens=False).ids
        decoded = c.library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe.digests(edge))) == Counter(want)
    assert bpe.digests(nothing).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(edge.select("doc_id", "text")))
    assert Counter((r["doc_id"], r["text"]) for r in rows(back)) == Counter((i, t or "") for i, t in EDGE)


# all


def test_registry():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 14)]


def test_suffix_shards_hold_little():
    """Contexts of many anchors are taken in parts: a worker holds some 40 MB, however many come in one batch."""
    rng, rows, n = random.Random(5), [], 5000
    for i in range(n):
        if i % 10 == 0:
            common_part = bytes(rng.choices(b"abcdefgh ", k=384))
        text = bytearray(common_part)
        text[rng.randrange(384)] = 65 + i % 26
        rows.append({"g": i // 10 * 2, "c": i, "n": 1, "salts": 1, "salt": 0, "left": 184, "l2": True, "r2": True, "bytes": bytes(text)})
    kinds = {"g": pa.int64(), "c": pa.int64(), "n": pa.int64(), "salts": pa.int32(), "salt": pa.int32(), "left": pa.int32(), "l2": pa.bool_(), "r2": pa.bool_(), "bytes": pa.binary()}
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))
    tracemalloc.start()
    out = [x for b in suffix_dedup.shards(iter([batch]), (200,)) for x in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48e6
    found = {x["c"]: x["found"] for x in out}
    for first in range(0, n, 1000):
        texts = [r["bytes"] for r in rows[first : first + 10]]
        windows = Counter(t[i : i + 200] for t in texts for i in range(185))
        for k, t in enumerate(texts):
            hit = {i for i in range(185) if windows[t[i : i + 200]] > 1}
            got = found.get(first + k, [])
            assert hit == {i for a, b in zip(got[::2], got[1::2]) for i in range(a, b + 1)}


def test_pipeline_limits_batches(spark, nothing, sf_dir):
    """Rows go to Python workers in batches of few bytes, unless the session says how many."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    texts = spark.createDataFrame([(i, "x" * 10_000) for i in range(2000)], "doc_id bigint, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        for _, stage in corpus_pipeline.STAGES[1:3]:
            spark.conf.unset(key)
            stage(spark, nothing, sf_dir)
            assert max(r.n for r in texts.mapInArrow(sizes, "n bigint").collect()) < 2 * common.BATCH
        spark.conf.set(key, "1m")
        corpus_pipeline.repeat_removal(spark, nothing, sf_dir)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
