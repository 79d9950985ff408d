"""The corpus operators against brute force, and on awkward rows: nulls, empty and long texts, repeats, clashing columns."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from kairoscope.llm import language_id, license_scan, line_dedup, lm_scoring, mixing, packing, quality, queries, simhash, topk, warc
from kairoscope.operators.components import components
from kairoscope.storage import CLEANUP, scratch, shared_dir, stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, h string, k string, counts string, place string, copies int, root string, piece string, c string"
LONG = " ".join(f"word{i % 977} the of" for i in range(40_000)) + "\n" + "x" * 50_000
PROSE = "The house by the river is old and it was built for the family of a miller, and they live in it to this day with all that they have. " * 3


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [
        (None, "a text without an id, and the words of it are few", "en"), (1, None, None), (2, "", "en"), (3, " \t\n\x0b ", "fr"), (4, LONG, "en"), (5, PROSE, "en"), (5, PROSE, "en"), (6, PROSE, None), (7, PROSE + " tail", "de"),
        (8, "Released under the MIT License.", "en"), (9, "ß é 漢字 <|endoftext|> 😀", "es"), (10, "same line here of words\nsame line here of words\nanother one of these", "en"),
    ]
    clash = (7, "x", "y", "z", "c", "p", 3, "r", "q", "c")
    return spark.createDataFrame([(i, t, lang, None if i in (1, 9) else f"s{(i or 0) % 3}", None, *clash) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


def naive_fingerprint(text):
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 470)] + [(7, 7)]
    wanted = union_find({x for p in pairs for x in p}, pairs)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert found == {n: r for n, r in wanted.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_awkward(awkward, nothing):
    found = {(r["doc_id"], r["n_words"]): r for r in quality.measure(awkward).collect()}
    assert found[(1, 0)]["base_failed"] and found[(2, 0)]["base_failed"] and found[(3, 0)]["base_failed"]
    assert found[(4, 120_001)]["n_dup_lines"] == 0
    assert found[(10, 14)]["n_dup_lines"] == 1 and found[(10, 14)]["n_repeat_words"] == 10
    kept = quality.filter_documents(awkward)
    assert kept.columns == awkward.columns and all(r["doc_id"] not in (1, 2, 3) for r in kept.collect())
    assert quality.filter_documents(nothing).count() == 0 and quality.measure(nothing).count() == 0


def test_language_held_out(spark, documents, awkward, nothing):
    found = language_id.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").alias("f")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    rows = language_id.identify(awkward).collect()
    assert len(rows) == 12 and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)
    assert language_id.identify(nothing).count() == 0
    unlabelled = language_id.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unlabelled] == ["und"]


def test_language_prediction_is_the_nearest_centroid(spark, documents):
    model = language_id.train(documents.filter(~language_id.held_out()))
    found = {r["doc_id"]: r for r in language_id.predict(documents, model).collect()}
    for r in documents.limit(60).collect():
        kept = language_id.letters(r["text"])
        if kept is None:
            assert found[r["doc_id"]]["lang_pred"] == "und"
            continue
        raw, v = kept.encode(), np.zeros(language_id.DIMS)
        for n, mix in enumerate(language_id.MIX):
            for i in range(len(raw) - n):
                v[((int.from_bytes(raw[i : i + n + 1], "big") * mix + n) & 0xFFFFFFFF) >> 20] += 1
        v *= model["idf"]
        cosines = [float(c @ v) / np.sqrt(v @ v) / np.sqrt(float(c @ c)) for c in model["centres"].astype(float)]
        assert found[r["doc_id"]]["lang_pred"] == model["langs"][int(np.argmax(cosines))] and abs(found[r["doc_id"]]["score"] - max(cosines)) < 1e-4


def test_language_many_null_and_repeated_ids(spark):
    words = {"en": "the house and river with some people", "de": "das haus und der fluss mit vielen leuten"}
    rows = [(None if i % 2 else 7, f"{t} {i % 900}", lang) for lang, t in words.items() for i in range(2600)] + [(1, "le chat noir sur la table", "fr")] * 2000
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    right = found.groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in right} == {"en": 2600, "de": 2600, "fr": 2000}


def test_language_counts_in_blocks():
    text = language_id.letters("the quick brown fox " * 20)
    whole = language_id.counts(text)
    block, language_id.BLOCK = language_id.BLOCK, 7
    try:
        assert (language_id.counts(text) == whole).all()
    finally:
        language_id.BLOCK = block
    n = len(text.encode())
    assert whole.sum() == 3 * n - 3


def test_lm_scores(spark, documents, awkward, nothing, monkeypatch):
    monkeypatch.setattr(lm_scoring, "KNOWN", 300)
    model = lm_scoring.train(documents)
    scored = {r["doc_id"]: r for r in lm_scoring.score(documents, model).collect()}
    near, far = lm_scoring.NEAR, lm_scoring.FAR
    table = lm_scoring.log_probabilities(model["network"]).reshape(far, near, near, near, far)
    assert np.allclose(np.exp(table[3, 9, :, 4, 1]).sum(), 1, atol=1e-4)
    counts = Counter(w for r in documents.collect() for w in (r["text"] or "").encode().lower().split())
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert model["known"] == ranked[:300] and model["words"].count() == len(counts)
    frequent = [w for w, _ in ranked[: lm_scoring.FREQUENT]]
    class_ = {w: 1 + frequent.index(w) if w in frequent else 1 + lm_scoring.FREQUENT + zlib.crc32(w[-3:]) % lm_scoring.BUCKETS for w in counts}
    sizes = Counter()
    for w, n in counts.items():
        sizes[class_[w]] += n
    coarse = lambda c: 1 + c % (far - 1) if c else 0
    for r in documents.limit(20).collect():
        words = r["text"].encode().lower().split()
        c = [0, 0, *(class_[w] for w in words), 0, 0]
        total = sum(float(table[coarse(c[i]), c[i + 1], c[i + 2], c[i + 3], coarse(c[i + 4])]) + np.log(counts[w] / sizes[class_[w]]) for i, w in enumerate(words))
        assert scored[r["doc_id"]]["n_tokens"] == len(words)
        assert abs(scored[r["doc_id"]]["log_likelihood"] - total) < 1e-6 * abs(total) + 1e-2
    real = documents.filter(F.length("text") > 500).limit(60)
    words = [w for r in real.collect() for w in r["text"].split()]
    random.Random(1).shuffle(words)  # of several languages
    mixed = spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string")
    mean = lambda d: lm_scoring.score(d, model).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert mean(real) > mean(mixed) + 0.05
    rows = {(r["doc_id"]): r for r in lm_scoring.score(awkward, lm_scoring.train(awkward)).collect()}
    assert rows[1]["n_tokens"] == 0 and rows[2]["log_likelihood"] == 0.0 and rows[3]["mean_log_likelihood"] is None and rows[4]["n_tokens"] == 120_001
    assert lm_scoring.score(awkward, model).count() == 12  # words that the model hasn't seen
    assert lm_scoring.score(nothing, lm_scoring.train(nothing)).count() == 0


def test_lm_gradient_and_training():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 4, (3, 5, 5, 5, 3)) * (rng.random((3, 5, 5, 5, 3)) < 0.3)
    p = lm_scoring.start(counts)
    loss, grad = lm_scoring.loss_and_gradient(p, counts)
    by_hand = 0.0
    for i, j, c, r, k in zip(*np.nonzero(counts), strict=True):
        z = np.tanh(p["F"][i] + p["L"][j] + p["R"][r] + p["G"][k] + p["b"]) @ p["W"].T + p["o"]
        by_hand -= counts[i, j, c, r, k] * (z[c] - np.log(np.exp(z).sum()))
    assert np.isclose(loss, by_hand / counts.sum())
    for name, x in p.items():
        for at in [tuple(rng.integers(0, n) for n in x.shape) for _ in range(4)]:
            moved = {k: v.copy() for k, v in p.items()}
            moved[name][at] += 1e-6
            assert np.isclose((lm_scoring.loss_and_gradient(moved, counts)[0] - loss) / 1e-6, grad[name][at], atol=1e-5)
    assert lm_scoring.loss_and_gradient(lm_scoring.train_counts(counts), counts)[0] < loss - 0.05


def test_lm_vocabulary_forgets(monkeypatch):
    monkeypatch.setattr(lm_scoring, "WORDS_KEPT", 3)
    v = lm_scoring.Vocabulary([(b"a", 9), (b"b", 7)], {lm_scoring.bucket(b"c"): 5})
    own = lm_scoring.numbers(b"a b c d e f g h a", v)
    assert list(own) == [0, 1, 2, 3, 4, 5, 6, 7, 0] and list(v.of("hashes", own) == 0) == [True, True, *[False] * 6, True]
    assert int(v.of("hashes", own)[2]) % 2**64 == xxhash.xxh64_intdigest(b"c", 42) and np.isclose(v.of("part", own)[2], -np.log(5))
    v.trim()
    assert list(v) == [b"a", b"b"]
    own = lm_scoring.numbers(b"a z b", v)
    assert list(own) == [0, 2, 1] and list(v.of("classes", own)) == [1, lm_scoring.bucket(b"z"), 2]


def test_simhash(documents, awkward, nothing):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = {d: naive_fingerprint(t) for d, t in texts.items()}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    wanted = union_find(ids, pairs)
    found = {r["doc_id"]: r for r in simhash.digest(simhash.near_duplicates(documents)).collect()}
    assert {d: int(r["fingerprint"], 16) for d, r in found.items()} == prints
    assert {d: r["component_id"] for d, r in found.items()} == wanted
    rows = simhash.digest(simhash.near_duplicates(awkward)).collect()
    assert len(rows) == 12 and {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"0" * 16} and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect() if r["doc_id"] in (1, 2, 3, 5, 6)) == [1, 5]
    assert simhash.keep_one(nothing).count() == 0


def test_simhash_links_are_complete(spark):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(10):
            x = rng.choice([p, *list(prints)[:5]])
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    wanted = union_find(signed.values(), [(signed[a], signed[b]) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    found = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"))).collect()}
    assert {x: found.get(x, x) for x in wanted} == wanted


def test_license_rules(spark, awkward, nothing):
    s = license_scan.SENTENCES
    mit = f"Copyright (c) 2020 A\n\n{s['mit-grant'].replace(' to use', chr(10) + 'to use')}\n\n{s['mit-notice']}\n\n{s['mit-warranty']}"
    bsd = f"{s['bsd-redistribution']}\n\n1. {s['bsd-source']}\n2. {s['bsd-binary']}\n"
    names = lambda t: [x[2] for x in license_scan.scan_text(t)[1]]
    assert names("Some prose\nReleased under the MIT License.\nMore prose. And so\n" + mit) == ["MIT", "MIT"]
    assert names(bsd) == ["BSD-2-Clause"] and names(f"{bsd}3. {s['bsd-names']}") == ["BSD-3-Clause"]
    assert names("# SPDX-License-Identifier: Apache-2.0\nx") == ["Apache-2.0"] and names("licensed under the sea of words") == []
    assert names("Copyright 2020 B. All rights reserved.") == ["all-rights-reserved"]
    text = "x\nLicensed under CC BY-NC 4.0.\ny"
    (start, end, name), = license_scan.scan_text(text)[1]
    assert text[start:end] == "Licensed under CC BY-NC 4.0." and name == "CC-BY-NC-4.0"
    rows = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan(awkward)).collect()}
    assert rows[8]["licences"] == "MIT" and rows[1]["licences"] == "" and rows[4]["n_sentences"] == 0 and len(rows) == 11
    assert license_scan.scan(nothing).count() == 0


def dressed(text):
    """Ways to write a licence sentence: wrapped, padded, commented, shouted."""
    words = text.split(" ")
    wrapped = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    yield text
    yield text.upper()
    yield text.replace(" ", " " * 700)
    for lead in ("", "# ", "// ", " * ", "> ", ";; ", "  "):
        yield "\n".join(lead + x for x in wrapped)
    yield "/*\n" + "\n".join(f" * {x}" for x in wrapped) + "\n */"
    yield "some prose before it\n" + text + "\nand after"
    yield f"Some prose before it. {text}{'' if text[-1] in '.:' else '.'} And after."


def test_license_sentences_are_recognised_however_written():
    for text, name in license_scan.spelled():
        for form in dressed(text):
            assert name in [x[2] for x in license_scan.scan_text(form)[0]], (name, form[:200])
        assert not [x for x in license_scan.scan_text("prefix " + text)[0] if x[2] == name or x[2].startswith("notice")]


def test_license_rules_match_their_own_texts():
    by = {i: s for s, i in license_scan.spelled()} | {"copyright": "Copyright 2020 A."}
    for licence, run in license_scan.RULES:
        for between in (" ", "\n", "\n\n", "\n#\n# ", "\n * "):
            text = between.join(by[i] + ("" if by[i][-1] in ".:" else ".") for i in run)
            assert [x[2] for x in license_scan.scan_text(text)[1]] == [licence], (licence, run, between)
    assert license_scan.scan_text("This program is free software: licence 2.0.")[0] == []
    assert license_scan.scan_text("Copyright law is a difficult subject. All rights reserved.")[1] == []


def brute_sentences(text):
    """Identifiers by trying every run of words from the start of a sentence to the end of one, longest first."""
    tokens, known_ = [], {tuple(license_scan.words_of(s)): i for s, i in license_scan.spelled()}
    most = max(map(len, known_))
    for sentence in __import__("re").split(r"(?<=[.!?:;])\s+|\n", text):
        words = license_scan.words_of(sentence)
        tokens += [(w, i == 0, i == len(words) - 1) for i, w in enumerate(words)]
    out, i = [], 0
    while i < len(tokens):
        hit = None
        if tokens[i][1]:
            hit = next((j for j in range(min(len(tokens), i + most), i, -1) if tokens[j - 1][2] and tuple(t[0] for t in tokens[i:j]) in known_), None)
        if hit:
            out.append(known_[tuple(t[0] for t in tokens[i:hit])])
        i = hit or i + 1
    return out


def test_license_scan_against_brute_force():
    rng, spelled = random.Random(6), license_scan.spelled()
    for _ in range(150):
        pieces = [rng.choice([rng.choice(spelled)[0], " ".join(rng.choice(spelled)[0].split()[: rng.randint(1, 6)]), "words of prose", "licence"]) for _ in range(rng.randint(1, 9))]
        text = "".join(p + rng.choice([". ", ".\n", "\n", " ", "; ", "\n\n"]) for p in pieces)
        assert [x[2] for x in license_scan.identified(text)] == brute_sentences(text), text


def test_license_spellings_pass_the_keys():
    names = lambda t: [x[2] for x in license_scan.scan_text(t)[1]]
    assert names("Released under CC-BY-SA 4.0.") == ["CC-BY-SA-4.0"] and names("Available under CC-BY 4.0.") == ["CC-BY-4.0"]
    assert all(names(f"Released under{x}MIT.") == ["MIT"] for x in ("\n", "\t", ' "', " ("))
    assert all(license_scan.KEY.search(s.lower()) for s, _ in spelled_out())


def spelled_out():
    return [(s.replace(" ", gap, 5), i) for s, i in license_scan.spelled() for gap in ("\n", "\t", "  ", "\n# ")]


def test_license_notices_are_found(documents):
    found = {r["doc_id"]: r["licences"] for r in license_scan.digest(license_scan.scan(documents)).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    for r in documents.collect():
        assert {lines[x] for x in lines if x in (r["text"] or "")} == {x for x in found[r["doc_id"]].split(",") if x}


def test_top_k_awkward(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [1.0, None]), (40, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (60, [1.0]), (8, [1e300, 1e300]), (9, [-1.0, -0.001])]
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    found = topk.top_k(table, F.col("vec_id") % 20 == 0).collect()
    by = defaultdict(list)
    for r in found:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [0, 20]  # 60 has a length of its own, 40 is null
    assert sorted(by[0]) == [(1, 8, 2**63 - 1), (2, 20, 64 * 64 * 5), (3, 20, 64 * 64 * 5), (4, 7, 32 * 64 * 3), (5, 9, 64 * -64 + 128 * -1)]
    assert [x[1] for x in sorted(by[20])] == [8, 0, 7, 9]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_in_blocks_and_repeated_queries(spark, duck, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.choice([i, 40, 60]), [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    duck.register("spread", table.toPandas())
    wanted = duck.execute(topk.oracle_sql().replace("FROM embeddings", "FROM spread")).df()
    monkeypatch.setattr(topk, "SHARD_ROWS", 90)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    for parts in (1, 5):
        assert rows_of(topk.top_k(table.repartition(parts), F.col("vec_id") % 20 == 0).toPandas()) == rows_of(wanted)


def test_top_k_trees():
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(0, 20, (3000, 8)))
    points[:700] = points[0]  # one very common vector
    ids, queries_ = np.arange(3000), points[rng.integers(0, 3000, 40)]
    found = defaultdict(list)
    for q, i, s in topk.search(points, ids, queries_, np.full(40, -1), np.full(40, -np.inf), 20):
        found[q].append((-s, i))
    for q in range(40):
        scores = points @ queries_[q]
        assert sorted(found[q]) == sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:20]


def test_mixing(awkward, nothing, documents):
    rows = mixing.decide(awkward).collect()
    assert len(rows) == 12 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    taken = Counter({(r["doc_id"], r["size"]): r["taken"] // r["size"] for r in rows if r["size"]})
    again = Counter(r["doc_id"] for r in mixed.collect())
    assert again[5] == 2 * taken[(5, next(s for d, s in taken if d == 5))]
    assert mixing.mix(nothing).count() == 0 and mixing.decide(nothing).count() == 0
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in (rows := mixing.decide(documents).collect()):
        by[(r["source_size"], r["target"])][0] += r["taken"]
        by[(r["source_size"], r["target"])][2] = max(by[(r["source_size"], r["target"])][2], r["size"])
    assert all(abs(taken - target) <= largest for (_, target), (taken, _, largest) in by.items())
    total = sum(r["size"] for r in rows)
    targets = {(r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 * total and all(t <= 2 * s for s, t in targets)
    assert sorted(mixing.decide(documents.repartition(7)).collect()) == sorted(rows)


def test_mixing_repeated_rows_at_the_boundary(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    text = "w " * 60
    rows = [(1, text, "a", i % 2) for i in range(50)] + [(1, text, "b", 0)] * 9 + [(i, "w " * (i % 40), "c", 0) for i in range(60)] + [(5, None, "a", 0), (6, "", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    decided = mixing.decide(docs).collect()
    assert len(decided) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in decided)
    by = defaultdict(list)
    for r in decided:
        by[(r["source_size"], r["target"])].append((r["taken"], r["size"]))
    for (_, target), x in by.items():
        assert abs(sum(t for t, _ in x) - target) <= max(s for _, s in x)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    plan = Counter()
    for r in mixing.plan(docs).collect():
        plan[(r["doc_id"], r["k"], r["size"])] += r["copies"] if r["size"] else 0
    assert Counter((r["doc_id"], "s" + r["source"], len(r["text"].split())) for r in mixed.collect()) == Counter({x: n for x, n in plan.items() if n})
    assert sorted(mixing.decide(docs.repartition(5)).collect()) == sorted(decided)


def test_keep_one_of_rows_that_share_id_and_text(spark):
    rows = [(1, PROSE, f"s{i % 3}") for i in range(30)] + [(2, PROSE, "a"), (3, "another text that has nothing in common with it at all", "b")] * 2
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(documents, awkward, nothing):
    tokenizer = whole_tokenizer()
    for docs, most_waste in ((documents, 3), (awkward, 12)):
        wanted = Counter()
        for r in docs.collect():
            ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
            first = len(ids) % 2048 or 2048
            edges = [0, *range(first, len(ids) + 1, 2048)]
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                wanted[(r["doc_id"], i, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
        rows = packing.pack_documents(docs).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + most_waste
    assert packing.pack_documents(nothing).count() == 0
    ids = packing.pack_documents(awkward, with_ids=True).filter("doc_id = 5 AND piece = 0").first()["ids"]
    assert ids[:-1] == tokenizer.encode(PROSE, add_special_tokens=False).ids


def test_both_tokenizers_agree():
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    letters = [chr(c) for c in range(packing.LATIN + 1)]
    for _ in range(3000):
        text = "".join(rng.choice(letters if rng.random() < 0.3 else "  \n\tabc'streLd.,12\xa0\x85\x1c") for _ in range(rng.randint(0, 50)))
        assert encode(text).tolist() == encode.slow(text).tolist()


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(1)
    for counts in (rng.integers(0, 40, packing.SEQUENCE + 1), rng.integers(0, 3, packing.SEQUENCE + 1) * (rng.random(packing.SEQUENCE + 1) < 0.02)):
        counts[0] = 0
        used = Counter()
        for lengths, times in packing.patterns(counts):
            assert times > 0 and sum(lengths) <= packing.SEQUENCE
            for x in lengths:
                used[x] += times
        assert used == Counter({x: int(n) for x, n in enumerate(counts) if n})


def brute_lines(rows):
    """(doc_id, line number) of the lines that go."""
    lines = defaultdict(list)
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                lines[line].append((doc_id, i))
    texts = list(lines)
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    inverted, pairs = defaultdict(list), []
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in inverted[g])
        pairs += [(i, j) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
        for g in s:
            inverted[g].append(i)
    roots = union_find(range(len(texts)), pairs)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[roots[i]] += lines[t]
    return {place for places in groups.values() for place in sorted(places)[1:]}


def test_line_dedup(documents, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    wanted = brute_lines(rows)
    found = {(r["doc_id"], i) for r in line_dedup.decide(documents).collect() for i in r["dropped"]}
    assert not found - wanted and len(found) >= 0.99 * len(wanted)
    new = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents).collect()}
    for doc_id, text in rows:
        left = "\n".join(x for i, x in enumerate((text or "").split("\n")) if (doc_id, i) not in found)
        assert new.get(doc_id) == (left if left.strip() or not (text or "").strip() else None)
    decided = line_dedup.decide(awkward).collect()
    assert len(decided) == 12 and all(r["n_lines"] == 0 and r["dropped"] == [] for r in decided if r["doc_id"] in (1, 2, 3))
    assert [r["dropped"] for r in decided if r["doc_id"] == 10] == [[1]]
    assert [r["dropped"] for r in decided if r["doc_id"] == 5] == [[], []] and [r["dropped"] for r in decided if r["doc_id"] == 6] == [[0]]
    out = line_dedup.dedup_lines(awkward)
    assert out.columns == awkward.columns and sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 2, 3, 4, 5, 5, 8, 9, 10]
    assert line_dedup.dedup_lines(nothing).count() == 0 and line_dedup.decide(nothing).count() == 0


def test_line_dedup_group_of_near_copies(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghij ") for _ in range(300))
    texts = [base[:p] + rng.choice("xyz") + base[p + 1 :] for p in rng.sample(range(300), 120)] + ["other text entirely " + str(i) * 9 for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(r["doc_id"], i) for r in line_dedup.decide(docs).collect() for i in r["dropped"]}
    assert found == brute_lines(list(enumerate(texts)))


def test_line_dedup_large_bucket_of_many_clusters(spark, monkeypatch):
    """One bucket of 120 clusters: every pair that shares it is verified, in blocks too."""
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdefghij ") for _ in range(80)) for _ in range(120)]
    rows = [(k, t) for i, b in enumerate(bases) for k, t in ((1000 + i, b), (5000 - i, b + "x"))]
    monkeypatch.setattr(line_dedup, "BLOCK", 50, raising=False)
    found = spark.createDataFrame([(k, None, 9) for k, _ in rows], "a long, b long, key long")
    assert {(r["node"], r["root"]) for r in line_dedup.linked(found, spark.createDataFrame(rows, "k long, line string")).collect()} == {(5000 - i, 1000 + i) for i in range(120)}


def test_line_dedup_links_components_once(spark, monkeypatch):
    """The rest of a large bucket gives a link for two components, not one for each of their pairs that are alike or near."""
    monkeypatch.setattr(line_dedup, "TILE", 40)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghij ") for _ in range(300))
    rows = [(1000 + i, base[:p] + "z" + base[p + 1 :]) for i, p in enumerate(rng.sample(range(300), 150))] + [(9000 + i, f"{i} other text {'ab' * i}" * 4) for i in range(20)]
    held = spark.createDataFrame([(9, k, k if k >= 9000 else 1000 + (k % 3), len(rows)) for k, _ in rows], "key long, k long, root long, n long")
    found = [(r["a"], r["b"]) for r in line_dedup.across(held, spark.createDataFrame(rows, "k long, line string")).collect()]
    assert sorted(x for x in found if x[1] < 9000) == [(1000, 1001), (1000, 1002), (1001, 1002)]
    sets = {k: {t[i : i + 5] for i in range(len(t) - 4)} for k, t in rows}
    others = {(a, b) for a in range(9000, 9020) for b in range(a + 1, 9020) if len(sets[a] & sets[b]) >= line_dedup.LEAST * len(sets[a] | sets[b])}
    assert {x for x in found if x[1] >= 9000} == others


def test_line_dedup_bands_find_similar_pairs():
    """At a similarity of 0.8 each minimum agrees with probability 0.8; 0.99 of such pairs share a band."""
    agree = np.random.default_rng(1).random((100_000, line_dedup.BINS)) < 0.8
    assert np.any([agree[:, own].all(axis=1) for own in line_dedup.bands()], axis=0).mean() >= 0.99


def near_copies(rng, length):
    """A text of this length, a copy with few edits, and their similarity."""
    text = "".join(rng.choice("abcdefghijklmnopqr ") for _ in range(length))
    other = text
    for _ in range(rng.randint(1, 1 + length // 60)):
        p = rng.randrange(len(other))
        other = other[:p] + rng.choice(["", "x", "yz"]) + other[p + rng.randint(0, 1) :]
    a, b = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (text, other))
    return text, other, len(a & b) / len(a | b)


def test_line_dedup_keys_find_real_pairs():
    """Signatures of one permutation, with bins that short lines leave empty, find pairs of 0.8 to 0.9 as the bands promise."""
    rng = random.Random(12)
    pairs = [x for _ in range(9000) for x in [near_copies(rng, rng.choice((8, 25, 45, 70, 150, 400)))] if 0.8 <= x[2] < 0.9]
    left, right = (line_dedup.keys(line_dedup.signatures([x[i] for x in pairs])) for i in (0, 1))
    assert len(pairs) > 1500 and (left == right).any(axis=1).mean() >= 0.99


def test_line_dedup_likeness_is_exact():
    rng = random.Random(13)
    rows = [near_copies(rng, rng.choice((1, 3, 5, 9, 60, 3000))) for _ in range(3000)] + [("é", "é", 1.0), ("漢字 😀 abc", "漢字 😀 abc", 1.0), ("aaaaaaa", "aaaaa", 1.0), ("ab", "abc", 0.0)]
    assert np.allclose(line_dedup.likeness([r[0] for r in rows], [r[1] for r in rows]), [r[2] for r in rows])


def test_line_dedup_blocks_are_exact(monkeypatch):
    rng = random.Random(14)
    texts = [x for _ in range(40) for x in near_copies(rng, rng.choice((3, 40, 90)))[:2]]
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    wanted = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    monkeypatch.setattr(line_dedup, "COLUMNS", 64)
    monkeypatch.setattr(line_dedup, "PAIRS", 33)
    k = np.arange(len(texts))
    off = ~np.eye(len(texts), dtype=bool)
    for some in (k, k[3:40:5]):
        assert np.allclose(line_dedup.likenesses(texts, some)[off[some]], np.array(wanted)[some][off[some]])
    links = line_dedup.linked_block(k, k, k * 0, texts)
    pairs = [(a, b) for a in k for b in range(a) if wanted[a][b] >= line_dedup.LEAST]
    assert union_find(k, links) == union_find(k, pairs) and len(links) < len(texts)
    root = np.array([min(i, 7) for i in k])  # a large component
    assert union_find(root, [(root[a], root[b]) for a, b in line_dedup.linked_block(k, root, k * 0, texts)]) == union_find(root, [(root[a], root[b]) for a, b in pairs])
    assert all(a % 2 != b % 2 for a, b in line_dedup.linked_block(k, k, k % 2, texts))


@pytest.mark.parametrize(("size", "most"), [(1, 1000), (7, 1000), (40, 30), (7, 60), (1000, 10)])
def test_line_dedup_buckets_in_blocks(size, most, monkeypatch):
    import pyarrow as pa

    rng = random.Random(size)
    rows = list({(rng.choice([rng.randrange(150), 7, 8]), rng.randrange(10_000)) for _ in range(500)})
    blocks = [(t, np.array([(key, k, 0) for key, k in rows[i : i + size] if key % 3 == t], dtype=np.int64)) for t in range(3) for i in range(0, len(rows), size)]
    batches = [pa.RecordBatch.from_pylist([{"target": t, "rows": x.tobytes()}]) for t, x in blocks if len(x)]
    monkeypatch.setattr(line_dedup, "HELD", most)
    found = [(r["key"], r["a"], r["b"]) for b in line_dedup.shared(iter(batches)) for r in b.to_pylist()]
    members = defaultdict(list)
    for key, k in rows:
        members[key].append(k)
    pairs = {(None, a, b) for ks in members.values() if len(ks) <= line_dedup.SMALL for b in ks for a in ks if a < b}
    assert {x for x in found if x[0] is None} == pairs
    for key, ks in members.items():
        own = [x for x in found if x[0] == key]
        assert sorted(x[1] for x in own) == (sorted(ks) if len(ks) > line_dedup.SMALL else [])
        assert not own or len({x[2] for x in own if x[2] is not None}) == 1 and sum(x[2] is None for x in own) == 1


def test_line_dedup_blocks_hold_every_band(monkeypatch):
    import pyarrow as pa

    texts = [f"line number {i} of many, and some words" for i in range(300)] * 2
    monkeypatch.setattr(line_dedup, "HELD", 500)
    batches = [pa.RecordBatch.from_pylist([{"k": i % 300, "line": x} for i, x in enumerate(texts)][j : j + 70]) for j in range(0, 600, 70)]
    rows = [x for b in line_dedup.keyed(iter(batches), 7) for r in b.to_pylist() for x in np.frombuffer(r["rows"], dtype=np.int64).reshape(-1, 3).tolist() if (x[0] % 2**64 >> 32) % 7 == r["target"]]
    wanted = line_dedup.keys(line_dedup.signatures(texts[:300]))
    assert sorted((x[1], x[0]) for x in rows) == sorted((i, int(key)) for i in range(300) for key in wanted[i])


def test_line_dedup_sketches_keep_similar_pairs():
    rng = random.Random(15)
    pairs = [x for _ in range(6000) for x in [near_copies(rng, rng.choice((8, 20, 25, 45, 70, 125, 150, 400)))] if x[2] >= 0.8]
    left, right = (line_dedup.sketches(line_dedup.signatures([x[i] for x in pairs]), [x[i] for x in pairs]) for i in (0, 1))
    assert len(pairs) > 2500 and line_dedup.near(left, right).mean() > 0.999
    other = np.roll(right, 1)
    assert line_dedup.near(left, other).mean() < 0.6


def tables_of(spark) -> set[str]:
    return {x.name for x in Path(shared_dir(spark).removeprefix("file:")).iterdir()}


def shuffles(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_line_dedup_and_keep_one_leave_one_table(documents, spark):
    for run, name in ((line_dedup.dedup_lines, "dropped"), (line_dedup.decide, "dropped"), (simhash.keep_one, "kept")):
        shared_dir(spark)
        before = tables_of(spark)
        found = run(documents)
        assert {x.rpartition("-")[0] for x in tables_of(spark) - before} == {name} and len(tables_of(spark) - before) == 1
        assert found.count() > 0  # it reads nothing that is gone


def test_line_dedup_tiles_leave_one_table(spark):
    held, before = spark.createDataFrame([(9, 1, 1, 2), (9, 2, 2, 2)], "key long, k long, root long, n long"), tables_of(spark)
    found = line_dedup.across(held, spark.createDataFrame([(1, "the same line"), (2, "the same line")], "k long, line string"))
    assert [tuple(r) for r in found.collect()] == [(1, 2)] and {x.rpartition("-")[0] for x in tables_of(spark) - before} == {"tiles"}


def test_stored_leaves_no_shuffle_files(spark):
    held = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before, was = shuffles(spark), spark.conf.get(CLEANUP, None)
    assert len(stored(held, "held").collect()) == 10 and spark.conf.get(CLEANUP, None) == was
    for _ in range(50):  # files go in the background
        if shuffles(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffles(spark) <= before


def test_scratch_keeps_what_it_is_told_to(spark):
    rows, before = spark.range(3), tables_of(spark)
    with scratch():
        with scratch():
            stored(rows, "inner")
            kept = stored(rows, "kept", keep=True)
        assert kept.count() == 3 and {x.rpartition("-")[0] for x in tables_of(spark) - before} == {"kept"}
        last = stored(kept, "last", keep=True)
    assert last.count() == 3 and {x.rpartition("-")[0] for x in tables_of(spark) - before} == {"last"}


def test_line_dedup_is_native(documents, spark, monkeypatch):
    """Without any Python on the executors it finds what the brute force finds."""
    monkeypatch.setattr(type(documents), "mapInArrow", None)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = {(r["doc_id"], i) for r in line_dedup.decide(documents).collect() for i in r["dropped"]}
    wanted = brute_lines(rows)
    assert not found - wanted and len(found) >= 0.99 * len(wanted)


def test_line_dedup_forms_agree(documents):
    native, arrow = ({(r["doc_id"], i) for r in line_dedup.decide(documents, native=n).collect() for i in r["dropped"]} for n in (True, False))
    assert len(native ^ arrow) <= 0.01 * len(arrow)


def test_line_dedup_native_signatures_find_real_pairs(spark):
    """Native keys find pairs of 0.8 to 0.9 of short and long lines as the bands promise, and native sketches keep them; chance pairs seldom."""
    rng = random.Random(12)
    drawn = [near_copies(rng, rng.choice((8, 25, 45, 70, 150, 400))) for _ in range(9000)] + [(f"{t} {i}" * 40, f"{t} {i}" * 60 + "!", 0.9) for i, t in enumerate(["ab", "漢字 ß", "x", "a longer unit of text"] * 9)]
    pairs = [x for x in drawn if 0.8 <= x[2] < 1]
    texts = spark.createDataFrame([(2 * i + j, x[j]) for i, x in enumerate(pairs) for j in (0, 1)], "k long, line string")
    found = {r["k"]: r for r in line_dedup.signed(texts).collect()}
    met = [any(a == b for a, b in zip(found[2 * i]["keys"], found[2 * i + 1]["keys"], strict=True)) for i in range(len(pairs))]
    assert len(pairs) > 1500 and len(found) == 2 * len(pairs) and np.mean(met) >= 0.99
    apart = lambda x, y: (((x["b0"] ^ y["b0"]) | (x["b1"] ^ y["b1"]) | (x["b2"] ^ y["b2"]) | (x["b3"] ^ y["b3"])) & x["mask"] & y["mask"] & 2**64 - 1).bit_count()
    assert np.mean([apart(found[2 * i], found[2 * i + 1]) <= line_dedup.MOST_APART for i in range(len(pairs))]) > 0.999
    long = [i for i, x in enumerate(pairs) if len(x[0]) >= 150]
    assert np.mean([apart(found[2 * i], found[2 * j]) <= line_dedup.MOST_APART for i, j in zip(long, long[1:], strict=False)]) < 0.1
    assert not any(set(found[2 * i]["keys"]) & set(found[2 * j]["keys"]) for i, j in zip(long, long[1:], strict=False))


def test_line_dedup_native_likeness_is_exact(spark):
    rng = random.Random(13)
    rows = [near_copies(rng, rng.choice((1, 3, 5, 9, 60, 3000))) for _ in range(600)] + [("漢字 😀 abc", "漢字 😀 abcd", 6 / 7), ("aaaaaaa", "aaaaa", 1.0), ("ab", "abc", 0.0)]
    texts = spark.createDataFrame([(2 * i + j, x[j]) for i, x in enumerate(rows) for j in (0, 1)], "k long, line string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(rows))], "a long, b long")
    assert {r["a"] // 2 for r in line_dedup.similar(pairs, texts).collect()} == {i for i, x in enumerate(rows) if x[2] >= line_dedup.LEAST}


def test_warc_round_trip(spark, nothing):
    rows = [(1, "http://a/é b", "<p>x"), (2, None, "<p>x"), (None, "http://n", "<p>x"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "ü" * 70_000), (2, None, "<p>x"), (6, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, payload int")
    found = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digest(warc.round_trip(pages)).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    x, e = sha("<p>x"), sha("")
    assert found == {(1, 4, x, "revisit", 2), (2, 4, x, "response", None), (None, 4, x, "revisit", 2), (3, 0, e, "revisit", 4), (4, 0, e, "response", None), (5, 140_000, sha("ü" * 70_000), "response", None), (6, 12, sha("WARC/1.1\r\n\r\n"), "response", None)}
    assert warc.digest(warc.round_trip(pages)).count() == 8
    assert warc.digest(warc.round_trip(pages, least_bytes=5)).filter("record_type = 'revisit'").count() == 0
    assert warc.digest(warc.round_trip(pages.limit(0))).count() == 0
    payloads = {r["payload"] for r in warc.round_trip(pages).filter("record_type = 'response'").collect()}
    assert bytes("ü" * 70_000, "utf-8") in {bytes(p) for p in payloads}


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    records = [warc.encode_record(i, f"http://x/{i}", (f"<html>{i}" * 900).encode()) for i in range(12)]
    parts = [warc.member(r) if packed else r for r in records]
    data = bytearray(b"".join(parts))
    begin = sum(map(len, parts[:4]))
    middle = begin + len(parts[4]) // 2
    data[middle] ^= 0xFF
    data = b"garbage" + bytes(data[:-9])
    items = list(warc.salvage(data))
    good = [int(i[3]["warc-record-id"].rsplit(":", 1)[1][:-1]) for i in items if i[0] == "record"]
    assert good == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]
    gaps = [(a, b) for kind, a, b, *_ in items if kind == "gap"]
    assert gaps == [(0, 7), (7 + begin, 7 + begin + len(parts[4])), (7 + sum(map(len, parts[:11])), len(data))]
    spans = sorted({(i[1], i[2]) for i in items})
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("harm", ["inner", "crc", "cut", "flip"])
def test_warc_salvage_inside_a_member(harm):
    rng = random.Random(3)
    records = [warc.encode_record(i, None, bytes(rng.randrange(256) for _ in range(3000))) for i in range(10)]
    plain = bytearray(b"".join(records))
    if harm == "inner":
        plain[len(records[0]) * 4 + len(records[0]) // 2] ^= 0xFF
    many = bytearray(warc.member(bytes(plain)))
    if harm == "crc":
        many[-6] ^= 0xFF
    elif harm == "cut":
        many = many[: len(many) * 3 // 4]
    elif harm == "flip":
        many[len(many) // 2] ^= 0xFF
    data = bytes(many) + warc.member(warc.encode_record(10, None, b"last"))
    items = list(warc.salvage(data))
    good = [int(i[3]["warc-record-id"].rsplit(":", 1)[1][:-1]) for i in items if i[0] == "record"]
    assert good[-1] == 10 and any(i[0] == "gap" for i in items) and len(set(good)) == len(good)
    least = {"inner": {0, 1, 2, 3, 5, 6, 7, 8, 9}, "crc": set(range(10)), "cut": set(range(6)), "flip": set(range(4))}[harm]
    assert least <= set(good)


@pytest.mark.parametrize("packed", [True, False])
def test_warc_payloads_that_quote_records(packed):
    quoted = warc.encode_record(99, None, b"quoted")
    records = [warc.encode_record(1, None, b"<pre>" + quoted + b"</pre>"), warc.encode_record(2, None, b"x")]
    records[0] = records[0].replace(b"<pre>", b"<PRE>")  # its digest no longer holds
    data = b"".join(warc.member(r) if packed else r for r in records)
    items = list(warc.salvage(data))
    assert [i[0] for i in items] == ["gap", "record"] and items[1][3]["warc-record-id"].endswith(":2>")
    both = warc.member(b"".join(records))
    assert [i[3]["warc-record-id"][-3:] for i in warc.salvage(both) if i[0] == "record"] == [":2>"]


def test_warc_folder_as_uri(spark, tmp_path):
    assert warc.uri_of(spark, str(tmp_path)) == f"file://{tmp_path}" == warc.uri_of(spark, f"file:{tmp_path}")


def test_pipeline_stages(spark, documents, awkward, nothing, duck):
    kept = {r["doc_id"] for r in quality.measure(documents).filter("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, documents, SF)
    assert {r["doc_id"] for r in one.collect()} == kept
    two = stages["line_dedup"](spark, one, SF)
    gone = brute_lines([(r["doc_id"], r["text"]) for r in one.collect()])
    for r in two.collect():
        source = one.filter(F.col("doc_id") == r["doc_id"]).first()["text"] if r["doc_id"] in (0, 1, 2, 3, 4) else None
        if source is not None:
            assert r["text"] == "\n".join(x for i, x in enumerate(source.split("\n")) if (r["doc_id"], i) not in gone)
    three = stages["simhash_near_dedup"](spark, two, SF)
    prints = {r["doc_id"]: naive_fingerprint(r["text"]) for r in two.collect()}
    ids = sorted(prints)
    roots = union_find(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(set(roots.values()))
    four = stages["mixing"](spark, three, SF)
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(three).collect()}
    assert Counter(r["doc_id"] for r in four.collect()) == Counter({d: c for d, c in copies.items() if c})
    five = stages["best_fit_packing"](spark, four, SF)
    assert five.filter("piece = 0").count() == four.count()
    assert corpus_pipeline.run(spark, SF).count() == five.count()
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
