"""Every operator and pipeline stage on awkward tables, and decisions against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("strataweave.llm")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from strataweave.llm import bpe, decontamination, license_scan, line_dedup, lm_scoring, near_dedup, quality_classifier, quality_rules, secret_scan, sharding  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = "aeinorst"


def words(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 6))) for _ in range(n))


ITEM = words(random.Random(77), 30)
OPERATORS = {
    "sharding": lambda d, spark: sharding.shard_documents(d, 4),
    "decontamination": lambda d, spark: decontamination.benchmark_leaks(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string")),
    "classifier": lambda d, spark: quality_classifier.quality_classifier(d, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")),
    "licences": lambda d, spark: license_scan.license_scan(d),
    "lines": lambda d, spark: line_dedup.line_dedup(d),
    "bpe": lambda d, spark: bpe.bpe(d, PATH, ("n_tokens", "ids_sha256", "decoded_sha256")),
    "model": lambda d, spark: lm_scoring.lm_scores(d),
    "secrets": lambda d, spark: secret_scan.digest(secret_scan.secret_scan(d)),
    "near": lambda d, spark: near_dedup.near_duplicates(d),
    "rules": lambda d, spark: quality_rules.quality_rules(d),
}


def rounded(rows):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty texts, ties, wholly equal rows, a leak and a licence that occur twice."""
    rng = random.Random(21)
    base = words(rng, 150)
    rows = [
        (None, None, None, None, None), (None, "", None, None, None), (1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (2, "", "en", "s1", 0), (3, " \n\t\n", "en", None, None),
        (4, base, "en", "s1", None), (4, base, "en", "s1", None), (5, base, None, "s2", None), (6, words(rng, 60) + "\n" + ITEM + "\n" + words(rng, 60), "en", "s2", None),
        (7, "Released under the MIT License.", "zz", "s3", None), (7, "Released under the MIT License.", "zz", "s3", None), (8, "token: abcd1234efgh5678 " + words(rng, 60), "de", "s3", None),
    ]
    rows += [(9, words(rng, 60) + "\n" + ITEM, "en", "s2", None)] * 2 + [(10 + k, words(rng, 80), "fr", f"s{k % 3}", None) for k in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, awkward, name):
    clash = ["tid", "tkey", "bucket", "key", "rid", "h", "h1", "lines", "gone", "at_doc", "pos", "words", "common", "ref_lang", "chunk", "fold", "x", "y", "shard", "size",
             "score", "held_out", "mark", "band", "sig", "item_id", "class_id", "verdict", "f", "owner", "repo", "begin", "carried", "windows", "near", "n", "word"]
    more = awkward.select("*", *[F.lit("clash").alias(c) for c in clash])
    want = rounded(OPERATORS[name](awkward, spark).collect())
    assert rounded(OPERATORS[name](more, spark).collect()) == want
    if name in ("licences", "decontamination"):
        assert sorted(n for r, n in want.items() if r[0] in (7, 9)) == [2]  # equal rows each give theirs
    else:
        assert sum(want.values()) == awkward.count()


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(4)
    word = "".join(rng.choice(LETTERS) for _ in range(1_000_000))
    line = words(rng, 200_000)
    return [(1, word), (2, line), (3, line + " " + ITEM), (4, "eyJ" * 300_000), (5, "password " * 100_000 + "\n" * 100_000), (6, "a b c " * 150_000), (7, "short")]


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts(spark, long_rows, name):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in long_rows], SCHEMA).repartition(3)
    out = OPERATORS[name](docs, spark).collect()
    if name == "decontamination":
        assert [(r["doc_id"], r["item_id"]) for r in out] == [(3, 1)]
    elif name == "licences":
        assert not any(r["confirmed"] for r in out)
    else:
        assert sorted(r["doc_id"] for r in out) == [i for i, _ in long_rows]
    by = {r["doc_id"]: r for r in out}
    if name == "near":
        assert by[3]["class_id"] == by[2]["class_id"] == 2 and by[7]["class_id"] == 7
    if name == "rules":
        assert by[6]["n_words"] == by[6]["n_repeat_words"] == 450_000 and by[5]["n_dup_lines"] == 0
    if name == "bpe":
        tokenizer = Tokenizer.from_file(PATH)
        for i in (2, 5, 6):
            ids = tokenizer.encode(dict(long_rows)[i], add_special_tokens=False).ids
            assert by[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_long_words_merge_as_the_library_does():
    rng = random.Random(3)
    merges, tokenizer = bpe.Merges(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    for n in (65, 300, 3000):
        for letters in ("a", "ab", LETTERS, "é漢xyz"):
            w = "".join(rng.choice(letters) for _ in range(n))
            ids = []
            for part in bpe.regex.findall(bpe.PATTERN, w):
                ids += merges.encode(part.encode())
            assert ids == tokenizer.encode(w, add_special_tokens=False).ids


def test_stages_on_awkward_tables(spark, awkward, tmp_path):
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 20)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (None, None), (1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (awkward.withColumn("gone", F.lit(1)).withColumn("wanted_id", F.lit(2)).withColumn("_text", F.lit(3)), awkward.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path)).collect()
            assert len(out) <= docs.count()
            if name == "near-dedup" and out:
                assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out) == sorted(set((r["doc_id"] or -1, r["text"] or "") for r in out))
            if name == "decontamination" and out:
                assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out} == {6, 9}
            if name == "BPE":
                assert len(out) == docs.count()


# decontamination


def test_latent_search_against_brute_force():
    """Every window that reaches the cosine and confirms its item is found, windows at any word being the truth."""
    rng = random.Random(12)
    bag = [words(rng, 1) + str(k) for k in range(400)]
    items = decontamination.Items([(k, " ".join(rng.choice(bag) for _ in range(rng.randint(12, 40)))) for k in range(30)])
    items.weigh(np.full(len(items.number), 2.0), 100)
    space = np.linalg.qr(np.random.default_rng(1).standard_normal((len(items.number), 64)))[0]
    search = decontamination.Search(items, space)
    texts, want = [], set()
    for k in range(60):
        text = [rng.choice(bag).encode() if rng.random() < 0.3 else words(rng, 1).encode() for _ in range(rng.randint(50, 400))]
        own = rng.randrange(30)
        copy = [w if rng.random() > 0.15 else words(rng, 1).encode() for w in items.words[own]]
        if k % 3:
            at = rng.randrange(len(text))
            text[at:at] = copy
        texts.append(b" ".join(text).decode())
        for item, m in enumerate(map(len, items.words)):
            unit = search.own[item].astype(float)
            for a in range(0, len(text), 1):
                v = sum((search.vectors[items.number[w.decode().encode()]] for w in text[a : a + m] if w in items.number), np.zeros(64))
                if np.linalg.norm(v) > 1e-6 and v @ unit / np.linalg.norm(v) >= decontamination.COSINE:
                    near = text[max(0, a - m // 2) : a + m + m // 2]
                    share = decontamination.lcs_length(items.words[item], near) / m
                    answer = b" ".join([b"", *items.words[item][-4:], b""]) in b" ".join([b"", *near, b""])
                    if share >= 0.7 or share >= 0.5 and answer:
                        want.add((k, item))
    got = {(r[0], r[1]) for r in search.find(texts)}
    assert len(want) > 30 and len(got & want) >= 0.97 * len(want)
    for k, item in got - want:  # wider surroundings may confirm more, never without a subsequence
        assert decontamination.lcs_length(items.words[item], decontamination.words_of(texts[k])) >= 0.5 * len(items.words[item])


def test_blocks_cut_no_leak(monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 64)
    rng = random.Random(2)
    items = decontamination.Items([(0, words(rng, 25))])
    items.weigh(np.ones(len(items.number)), 50)
    search = decontamination.Search(items, np.linalg.qr(np.random.default_rng(0).standard_normal((len(items.number), 16)))[0])
    for at in range(40, 200, 7):
        text = (words(rng, at) + " " + b" ".join(items.words[0]).decode() + " " + words(rng, 60))
        ((text_no, item, first, _, share, answered),) = search.find([text])
        assert (text_no, item, share, answered) == (0, 0, 1.0, True) and abs(first - at) <= 40


def test_windows_that_cannot_confirm_are_compared_together():
    """Far fewer calls than words where overlapping windows of one text reach the cosine; one comparison a window took more."""
    rng = random.Random(14)
    bag = [words(rng, 1) + str(k) for k in range(40)]
    items = decontamination.Items([(0, " ".join(bag))])
    items.weigh(np.ones(len(items.number)), 50)
    search = decontamination.Search(items, np.linalg.qr(np.random.default_rng(0).standard_normal((len(items.number), 16)))[0])
    text = [w for _ in range(100) for w in rng.sample(items.words[0], 40)]
    ids = decontamination.numbered(text, items.number)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = search.find_numbered([ids])
    finally:
        sys.setprofile(None)
    assert found == [] and calls < len(text)


def test_stretches_confirm_as_windows_one_by_one():
    rng = random.Random(15)
    for case in range(200):
        m = rng.randint(8, 30)
        items = decontamination.Items([(0, " ".join(f"w{rng.randrange(20)}" for _ in range(m)))])
        items.weigh(np.ones(len(items.number)), 50)
        search = decontamination.Search(items, np.eye(len(items.number)))
        own, text = search.own_ids[0], np.array([rng.randrange(len(items.number) + 1) for _ in range(rng.randint(20, 400))])
        if case % 2:  # the item with gaps, or its end among other words
            at = rng.randrange(len(text))
            text = np.concatenate([text[:at], [w for w in own[m // 3 * (case % 4 > 2) :] if rng.random() > 0.2], own[-4:], text[at:]]).astype(np.int64)
        begins = np.arange(0, len(text), 4)
        ends = np.minimum(begins + m, len(text))
        want = None
        for x, y in zip(begins.tolist(), ends.tolist()):
            a, b = max(0, x - m // 2), min(len(text), y + m // 2)
            share = decontamination.lcs_length(own.tolist(), text[a:b].tolist()) / m
            answered = any((text[i : i + 4] == own[-4:]).all() for i in range(a, b - 3))
            if (share >= 0.7 or share >= 0.5 and answered) and (want is None or share > want[2]):
                want = (a, float(x), share, answered)
        assert search.confirm(0, begins, ends, begins.astype(float), text) == want, case


# licences


def test_notices_that_are_no_templates_are_classified():
    rng = random.Random(5)
    model, measured = license_scan.train([words(rng, 20) for _ in range(400)])
    assert measured["unknown"] <= 0.01 and measured["recall"] >= 0.4
    texts = ["Released here under the terms of the MIT License", "Code is licensed under Apache License, Version 2.0", "Text licensed under CC BY-SA 4.0 by the authors",
             words(rng, 90) + " Licensed under the Mozilla Public License 2.0. " + words(rng, 90), "\n".join([words(rng, 9), "Alle Rechte vorbehalten.", words(rng, 9)])]
    found = {r[0]: r[3] for r in license_scan.find_licences(texts, model, license_scan._WordHash()) if r[-1]}
    assert found == {0: "mit", 1: "apache-2.0", 2: "cc-by-sa", 3: "mpl-2.0", 4: "proprietary"}


def test_block_sums_equal_plain_scores():
    rng = random.Random(6)
    model = license_scan.LicenseModel(np.random.default_rng(0).standard_normal((1 << license_scan.BITS, len(license_scan.FAMILIES))), np.zeros(len(license_scan.FAMILIES)))
    paragraphs = [words(rng, n).split() for n in (1, 2, 7, 8, 9, 24, 25, 60)]
    memo = license_scan._WordHash()
    owner, first, family, p = model.windows(paragraphs, memo)
    for o, b, f, q in zip(owner, first, family, p):
        own = paragraphs[o]
        # n-grams that begin in the window, as far as the paragraph goes
        at, _ = license_scan.features([own], memo)
        at = at[b * 8 : b * 8 + 24]
        n = (at < 1 << license_scan.BITS).sum()
        z = model.weights[at].sum((0, 1)) / math.sqrt(n)
        e = np.exp(z - z.max())
        assert f == z.argmax() and q == pytest.approx(float((e / e.sum()).max()), rel=1e-4)
    assert Counter(owner.tolist())[7] == 6


def test_every_paragraph_trains_the_licence_model(spark, monkeypatch):
    """Texts of any hash move the probabilities; a sample of about 400 texts left most of them out."""
    monkeypatch.setattr(license_scan, "PASSES", 8)
    rng = random.Random(8)
    plain = [(k, words(rng, 30)) for k in range(1200)]
    docs = spark.createDataFrame([(-1, "Released under the MIT License."), *plain], "doc_id long, text string")
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) >= (1 << 29)
    other = docs.withColumn("text", F.when(part & (F.col("doc_id") >= 0), F.concat(F.lit("a license or the mit of this version, "), "text")).otherwise(F.col("text")))
    a, b = (license_scan.license_scan(d).where("doc_id = -1").collect() for d in (docs, other))
    assert a and abs(a[0]["probability"] - (b[0]["probability"] if b else 0)) > 1e-4


def some_windows(n):
    rng = np.random.default_rng(16)
    many = rng.integers(0, 20, n)
    grams = np.minimum(rng.geometric(0.02, many.sum()) - 1, license_scan.OTHER - 1)
    return license_scan.Windows(grams, many, rng.integers(1, 9, (n, 3)), rng.random(n) < 0.25, rng.integers(1, 5, n))


def test_slopes_hold_a_block_of_windows_at_a_time():
    """All columns of all windows of a pack took over 40 MB at once, and each pass most of its time to move them."""
    windows = some_windows(license_scan.PACK)
    weights = np.random.default_rng(17).standard_normal((2, license_scan.POSITIONS + 1, len(license_scan.FAMILIES))) / 4
    tracemalloc.start()
    try:
        license_scan.unknown_slopes(windows, weights)
        assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("rows, common", [(64, 5), (1 << 11, 64), (100, 2000)])
def test_slopes_equal_plain_products(monkeypatch, rows, common):
    monkeypatch.setattr(license_scan, "ROWS", rows, raising=False)
    monkeypatch.setattr(license_scan, "COMMON", common, raising=False)
    windows = some_windows(700)
    weights = np.random.default_rng(18).standard_normal((2, license_scan.POSITIONS + 1, len(license_scan.FAMILIES))) / 4
    plain = np.zeros((700, license_scan.POSITIONS + 1))
    np.add.at(plain, (np.repeat(np.arange(700), windows.many), windows.grams), 1)
    plain[:, license_scan.OTHER : license_scan.POSITIONS] = windows.others
    plain /= np.sqrt(plain.sum(1, keepdims=True))
    plain[:, -1] = 1
    for k, times in enumerate((windows.times * ~windows.held, windows.times)):
        p = license_scan._softmax(plain @ weights[k])
        got = license_scan.unknown_slopes(windows, weights)[k]
        assert got[0] == pytest.approx(float(-np.log(p[:, 0]) @ times), rel=1e-9)
        assert got[1:].reshape(weights[k].shape) == pytest.approx(plain.T @ ((p - np.eye(len(license_scan.FAMILIES))[0]) * times[:, None]), rel=1e-8, abs=1e-8)
    empty = windows.kept(np.zeros(700, bool))
    assert not license_scan.unknown_slopes(empty, weights).any() and not license_scan.unknown_losses(empty, weights[0]).any()


def test_training_windows_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "PACK", 40)
    rng = random.Random(9)
    bag = [w for t in license_scan.DECOYS for w in license_scan.words_of(t)] + [words(rng, 1) for _ in range(30)]
    texts = ["\n".join(" ".join(rng.choice(bag) for _ in range(rng.randint(0, 60))) for _ in range(3)) for _ in range(60)]
    texts += ["Released under the MIT License.", None, "", texts[0], texts[0]]
    grams, n = Counter(), 0
    for text in texts[:60] + texts[-2:]:
        for line in text.split("\n"):
            w = line.split()
            n += -(-len(w) // license_scan.WINDOW)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    grams[license_scan.PLACE.get(tuple(w[i : i + k]), license_scan.OTHER + k - 1)] += 1
    weights = np.random.default_rng(2).standard_normal((2, license_scan.POSITIONS + 1, len(license_scan.FAMILIES))) / 4
    slopes = []
    for parts in (1, 6):
        rows = license_scan.spooled_windows(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts))
        found = [license_scan.Windows.unpacked(r.asDict()) for r in rows.collect()]
        got = Counter()
        for w in found:
            for g, m in zip(w.grams.tolist(), np.repeat(w.times, w.many).tolist()):
                got[g] += m
            for k in range(3):
                got[license_scan.OTHER + k] += int(w.others[:, k] @ w.times)
        assert +got == +grams
        assert license_scan.added_windows(rows, 40, license_scan.unknown_counts)[:2].sum() == n
        slopes.append(license_scan.added_windows(rows, 40, license_scan.unknown_slopes, weights))
    assert slopes[0] == pytest.approx(slopes[1], rel=1e-9, abs=1e-9)
    # the sums are the plain losses and their slopes
    way = np.random.default_rng(3).standard_normal(weights.shape)
    low, high = (sum(license_scan.unknown_slopes(w, weights + e * way) for w in found) for e in (-1e-5, 1e-5))
    for k in range(2):
        assert (high[k, 0] - low[k, 0]) / 2e-5 == pytest.approx(float(slopes[1][k, 1:] @ way[k].ravel()), rel=1e-5)
    plain = 0.0
    for text in texts[:60] + texts[-2:]:
        for line in text.split("\n"):
            w = line.split()
            for a in range(0, len(w), license_scan.WINDOW):
                at = [license_scan.PLACE.get(tuple(w[i : i + k]), license_scan.OTHER + k - 1) for i in range(a, min(len(w), a + license_scan.WINDOW)) for k in (1, 2, 3) if i + k <= len(w)]
                z = weights[1][at].sum(0) / math.sqrt(len(at)) + weights[1][-1]
                plain += math.log(np.exp(z - z[0]).sum())
    assert slopes[0][1, 0] == pytest.approx(plain, rel=1e-9)


# secrets


def test_ownership_decides_and_adds_spans(spark):
    value, copied, hot = "q9w8e7r6t5y4u3i2", "a1s2d3f4g5h6j7k8", "z1x2c3v4b5n6m7l8"
    rows = [(1, f"password = {value}", "o1"), (2, f"found {value} again, and {value}.", "o2"), (3, f"key {copied} bare", "o1")]
    rows += [(10 + k, f"token: {copied}", f"o{k}") for k in range(3)] + [(50 + k, f"secret={hot}", "o9") for k in range(20)] + [(90, f"see {hot}", "o8")]
    out = {r["doc_id"]: r["findings"] for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    text = dict((r[0], r[1]) for r in rows)
    assert [(f["kind"], f["verdict"]) for f in out[1]] == [("assign", "live")]
    assert [(f["kind"], text[2][f["start"] : f["end"]]) for f in out[2]] == [("reuse", value)] * 2
    assert out[3] == [] and out[90] == []  # examples are no secrets elsewhere
    assert all(out[10 + k][0]["verdict"] == "example" and out[10 + k][0]["owners"] == 3 for k in range(3))
    assert all(f["verdict"] == "example" and f["repos"] == 20 and f["owners"] == 1 for k in range(20) for f in out[50 + k])


# near-duplicates


def test_recall_against_the_exact_answer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    cells, holders = {}, defaultdict(list)
    for i, t in texts.items():
        w = t.lower().split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        cells[i] = {(g, k) for g, n in grams.items() for k in range(n)}
        for c in cells[i]:
            holders[c].append(i)
    shared = Counter((a, b) for ids in holders.values() for x, a in enumerate(ids) for b in ids[x + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(cells[a]) + len(cells[b]) - n)]
    by = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    met = sum(by[a] == by[b] for a, b in links)
    assert len(links) > 50 and met >= 0.99 * len(links)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    same = defaultdict(list)
    for i, t in texts.items():
        same[t].append(i)
    for ids in same.values():
        for i in ids[1:]:
            root[max(find(ids[0]), find(i))] = min(find(ids[0]), find(i))
    assert sum(by[i] == find(i) for i in texts) >= 0.995 * len(texts)


# quality rules


def test_distances_and_limits_against_brute_force(spark):
    rng = random.Random(8)
    often = ["the", "of", "and", "to"]
    rows = [(k, " ".join(rng.choice(often) if rng.random() < 0.4 else words(rng, 1) for _ in range(rng.randint(64, 120))) + ".", "en") for k in range(60)]
    rows += [(100, "!!! ".join(words(rng, 80).upper().split()), "en"), (101, " ".join("the" if k % 3 else words(rng, 1) for k in range(90)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = Counter(w for _, t, _ in rows for w in re.findall(r"[^\x20\x09-\x0d]+", t))
    total = sum(common.values())
    hashed = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in common], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    top = sorted((w for w, n in common.items() if n >= quality_rules.COMMON_SHARE * total), key=lambda w: (-common[w], hashed[w]))[: quality_rules.N_COMMON]

    def histogram(t):
        c = Counter(t.split())
        return np.array([c[w] for w in top] + [sum(c.values()) - sum(c[w] for w in top)], float)

    def distance(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
        return math.sqrt(max(0.0, (part(p) + part(q)) / 2))

    found = {r["doc_id"]: r for r in quality_rules.distances(docs).collect()}
    passed = [i for i, *_ in rows if not found[i]["base_failed"]]
    ref = sum(histogram(dict((i, t) for i, t, _ in rows)[i]) for i in passed)
    for i, t, _ in rows:
        if not found[i]["base_failed"]:
            assert found[i]["word_distance"] == pytest.approx(distance(histogram(t), ref - histogram(t)), abs=1e-9)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert all(kept[i] for i in range(60)) and not kept[100]


def test_windows_repeated_far_apart_are_counted(spark):
    docs = spark.createDataFrame([(1, " ".join(["a b c", *(f"w{k}" for k in range(40)), "a b c"]))], "doc_id long, text string")
    assert quality_rules.quality_rules(docs.withColumn("lang", F.lit("en"))).first()["n_repeat_words"] == 6
