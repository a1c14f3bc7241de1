"""Training-data operators do the whole job."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import jaccard, licences, repeats, reputation
from gristmill.llm.licence_texts import APACHE_2_0

DOCS = "doc_id long, text string"


def words(rng, n, longest=9):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, longest))) for _ in range(n))


@pytest.mark.parametrize("longest", [1, 4, 7])
def test_pipeline_removes_passages_of_51_words(spark, longest):
    import corpus_pipeline

    rng = random.Random(5)
    passage, short = words(rng, 51, longest), words(rng, 40, 4)
    assert len(passage) < repeats.BYTES.length
    texts = [f"{words(rng, 80)} {x} {words(rng, 80)}" for x in (passage, passage, short, short)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    left = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    assert all(passage not in left[i] and len(left[i]) >= len(texts[i]) - len(passage) - 4 for i in (0, 1))
    assert all(left[i] == texts[i] for i in (2, 3))


def test_pipeline_removes_frequent_passages_of_51_words(spark):
    rng = random.Random(6)
    passage = words(rng, 51, 4)
    docs = spark.createDataFrame([(i, f"{words(rng, 30)} {passage} {words(rng, 30)}") for i in range(12)], DOCS)
    left = repeats.remove_repeats(docs, 4, repeats.PASSAGES).collect()
    assert len(left) == 12 and not any(passage in r.text for r in left)


def test_one_each_judges_texts_under_one_id_apart(spark):
    rng = random.Random(7)
    a, b, c, d = (words(rng, 120) for _ in range(4))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c + " more"), (None, a + " again"), (None, d), (4, d + " more"), (None, b[::-1])]
    left = {tuple(r) for r in jaccard.one_each(spark.createDataFrame(rows, DOCS)).collect()}
    assert {(1, a), (2, b), (4, d + " more"), (None, b[::-1])} < left and len(left) == 5
    assert len(left & {(3, c), (3, c + " more")}) == 1


def test_licences_know_the_whole_apache_text(spark):
    flat = "\n\n".join(" ".join(x.split()) for x in APACHE_2_0.split("\n\n"))
    texts = [APACHE_2_0, flat, APACHE_2_0.split("   APPENDIX:")[0], APACHE_2_0.replace("Licensor", "Lender")]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {0: "Apache-2.0", 1: "Apache-2.0", 2: "Apache-2.0", 3: None}


def test_reputation_levels_of_long_suffixes_and_addresses(spark):
    hosts = {"a.b.x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "y.com.au:80": ("y.com.au", "com.au"), "10.0.0.7:8080": ("10.0.0.7",) * 2, "[::1]:80": ("[::1]",) * 2, "a.example.com": ("example.com", "com"), "local": ("local", "local"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    _, domain, suffix = reputation._levels(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


@pytest.mark.parametrize("group_most", [5000, 2])
def test_passages_against_brute_force(spark, group_most):
    rng = random.Random(3)
    passages = [words(rng, n).split() for n in (50, 51, 52, 80)]
    texts = [words(rng, 30).split() + passages[i % 4] + words(rng, 20).split() + (passages[3] if i % 5 == 0 else []) for i in range(24)] + [[], ["a"] * 60, ["b"] * 51]
    rows = [(i, rng.choice([" ", "\n", "  \t"]).join(t)) for i, t in enumerate(texts)] + [(90, None), (91, rng.choice("é😀") * 700), (3, " ".join(texts[0]))]
    lists = [(t or "").split() for _, t in rows]
    seen = {}
    for k, t in enumerate(lists):
        for i in range(len(t) - 50):
            seen.setdefault(tuple(t[i : i + 51]), []).append((k, i))
    gone = [[False] * len(t) for t in lists]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + 51] = [True] * 51
    want = sorted((d, sum(x and not y for x, y in zip(g, [False, *g], strict=False)), sum(g)) for (d, _), g in zip(rows, gone, strict=True))
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id, r.n_passages, r.n_passage_words) for r in repeats.report(df, group_most).collect()) == want
    left = sorted((r.doc_id, (r.text or "").split()) for r in repeats.remove_repeats(df, group_most, repeats.PASSAGES).collect())
    assert left == sorted((d, [w for w, x in zip(t, g, strict=True) if not x]) for (d, _), t, g in zip(rows, lists, gone, strict=True) if not t or not all(g))


def test_removal_invents_no_characters(spark):
    rng = random.Random(4)
    shared = "\u0129"[0].encode()[1:] + words(rng, 200)[:398].encode() + "ã".encode()[:1]
    texts = [("C".encode() + b"\xc4" + shared + b"\xa3" + "D".encode()).decode(), (words(rng, 9).encode() + b"\xc5" + shared + b"\xa9x").decode()]
    left = {r.doc_id: r.text for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert left[0] == "CD"


def test_clashing_names_in_stages(spark):
    from gristmill.llm import mixing, quality

    rng = random.Random(9)
    rows = [(i, words(rng, 120), "en", "a") for i in range(30)]
    rows += [(40 + i, rows[i][1], "en", "a") for i in range(5)]
    names = ("_d", "_t", "d", "t", "id", "_th", "th", "_spans", "spans", "_gone", "_gone_th", "_copies", "copies", "label", "left", "row", "n", "salt_", "x0", "g", "level")
    df = spark.createDataFrame(rows, f"{DOCS}, lang string, source string").withColumns({c: F.lit(7) for c in names})
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    for f in (repeats.remove_repeats, jaccard.one_each, quality.filter_documents, lambda x: mixing.mix(x, labels)):
        out = f(df)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        got = out.collect()
        assert got and all(r[c] == 7 for r in got for c in names)
        assert f(df.limit(0)).columns == df.columns and f(df.limit(0)).count() == 0


@pytest.mark.parametrize("keys", [200_000, 0])
def test_spread_join(spark, tmp_path, keys):
    from gristmill.llm._util import spread_join

    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(200)], "k long, x long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("m"))
    got = sorted(tuple(r) for r in spread_join(left, right, "k", 20, keys).select("k", "x", "m").collect())
    assert got == sorted(tuple(r) for r in left.join(right, "k").select("k", "x", "m").collect())


def test_components_of_a_long_path(spark):
    from gristmill.llm.components import components

    n = 3000
    assert {r.u: r.v for r in components(spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")).collect()} == {i: 0 for i in range(1, n + 1)}


def test_neighbours_of_repeated_ids_and_small_cells(spark):
    from gristmill.llm import neighbours

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x[50:200] = x[50]
    ids = [*range(390), 0, 7, 7, 50, 50, 399, 398, 397, 396, 395]
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "block", "part", "asked", "turn", "centre", "code")})
    want = {}
    for q in {i for i in ids if i % 50 == 0}:
        own = min(list(v) for i, v in zip(ids, x, strict=True) if i == q)
        score = [(-round(float(v @ own / np.sqrt(v @ v) / np.sqrt(np.dot(own, own))), 12), i) for i, v in zip(ids, x, strict=True) if i != q]
        want[q] = sorted(score)[:5]
    for options in ({}, {"probes": 192, "row_block": 20, "query_block": 3}):
        got = {}
        for r in sorted(neighbours.search(df, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
        assert set(got) == set(want) and sum(a == b for q in want for a, b in zip(got[q], want[q], strict=True)) >= 0.95 * 5 * len(want)
        assert got[50] == want[50]


def test_minimum_covariance_against_numpy(spark):
    from gristmill.llm import quality

    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(7, 7)) * 0.3
    groups = {"a": rng.normal(size=(300, 7)) @ mixed + 1, "b": rng.normal(size=(200, 7)), "c": np.round(rng.normal(size=(60, 7))), "one": rng.normal(size=(1, 7))}
    groups["a"][:50] += 6
    groups["b"][:, 3] = 0
    rows = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} double" for i in range(7)))
    got = {r.g: r for r in quality.minimum_covariance(df).collect()}
    floor, least = np.array(quality.FLOOR), quality.GUARD * np.array(quality.FLOOR)

    def step(x, mean, cov):
        d = np.square((x - mean) @ np.linalg.inv(np.linalg.cholesky(cov + np.diag(least**2))).T).sum(1)
        bins = np.floor(np.log2(d + 1e-9) * quality.BINS_PER_OCTAVE)
        near = x[[(bins < b).sum() < quality.ALPHA * len(x) for b in bins]]
        return near.mean(0), np.cov(near.T, bias=True).reshape(7, 7)

    det = lambda cov: np.linalg.slogdet(cov + np.diag(least**2))[1]
    for g, x in groups.items():
        q = np.sort(x, axis=0)[[int(np.ceil(s * len(x))) - 1 for s in (0.25, 0.5, 0.75)]]
        scale = np.where(q[2] > q[0], (q[2] - q[0]) / 1.349, floor)
        z = (x - q[1]) / scale
        size = np.sqrt(np.square(z).sum(1, keepdims=True))
        u = z / np.where(size > 0, size, 1)
        begin = [np.eye(7)]
        for cov in (np.cov(np.tanh(z).T, bias=True).reshape(7, 7), u.T @ u / len(u)):
            s = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            begin.append(cov / np.outer(s, s))
        found = []
        for k, cov in enumerate(begin):
            mean, cov = q[1], cov * np.outer(scale, scale)
            for _ in range(quality.FIRST):
                mean, cov = step(x, mean, cov)
            found.append((det(cov), k, mean, cov))
        low, k, mean, cov = min(found, key=lambda f: f[:2])
        for _ in range(quality.STEPS):
            m, c = step(x, mean, cov)
            before, low = low, min(low, det(c))
            mean, cov = (m, c) if det(c) < before else (mean, cov)
            if not det(c) < before:
                break
        own = quality._square(np.array([got[g][f"c{i}_{j}"] for i, j in quality._PAIRS]))
        assert abs(got[g].logdet - low) < 0.05, g
        if abs(got[g].logdet - low) < 1e-9:
            assert np.allclose([got[g][f"m{i}"] for i in range(7)], mean) and np.allclose(own, cov, atol=1e-9), g
    assert abs(got["a"].m0 - groups["a"][50:].mean(0)[0]) < 0.2  # the planted group doesn't count


def test_quality_estimates_are_pooled():
    from gristmill.llm import quality

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(50, 7)) + 1, rng.normal(size=(quality.PRIOR, 7))
    both = np.vstack([x, y])
    mean, cov = quality.pooled(50, x.mean(0), np.cov(x.T, bias=True), y.mean(0), np.cov(y.T, bias=True))
    assert np.allclose(mean, both.mean(0)) and np.allclose(cov, np.cov(both.T, bias=True))


def test_licences_know_texts_by_digest(spark):
    from pathlib import Path

    base = Path("/usr/share/common-licenses")
    files = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {f: n for f, n in files.items() if (base / f).exists()}
    if not there:
        pytest.skip("no licence texts on this machine")
    texts = [(base / f).read_text() for f in there]
    rows = [*enumerate(texts), *((200 + i, t + " and more") for i, t in enumerate(texts))]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i in range(len(texts))] == list(there.values()) and all(got[200 + i] is None for i in range(len(texts)))


def test_word_scores_are_the_kernel():
    from gristmill.llm import toxicity

    rng = random.Random(2)

    def kernel(x, y):
        """The subsequences of three letters that both hold, by enumeration."""

        def subsequences(w):
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
            return out

        a, b = subsequences(x), subsequences(y)
        return sum(v * b.get(k, 0) for k, v in a.items()) / toxicity.NORMS[len(x)] / toxicity.NORMS[len(y)]

    names = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 12))) for _ in range(40)]
    for y in names[:8]:
        weights = np.zeros(1 << 18, np.float32)
        for i, v in toxicity.word_vector(y).items():
            weights[i] = v
        for x in names:
            assert abs(toxicity.word_scores(x, weights) - kernel(x, y)) < 1e-5
        text = " ".join(names)
        assert abs(toxicity.word_scores(text, weights) - max(kernel(x, y) for x in names)) < 1e-5
    row, ids, weight = toxicity.entries(names)
    for k, x in enumerate(names):
        own = {}
        for i, v in zip(ids[row == k].tolist(), weight[row == k].tolist(), strict=True):
            own[i] = own.get(i, 0) + v
        assert own == pytest.approx(toxicity.word_vector(x))


def test_long_texts_and_clashing_names(spark):
    from gristmill.llm import chat, mixing, reputation, toxicity

    long = "word " * 300_000
    clash = {c: F.lit(1) for c in ("host", "path", "rule", "verdict", "key", "digest", "found", "known", "name", "hits", "n", "held_out", "score", "f", "formatted", "loss_start")}
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "")], DOCS).withColumns(clash)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert licences.scan(docs).count() == 4
    rates = {r.doc_id: r.n_tokens for r in mixing.rates(docs, labels).collect()}
    assert rates == {1: 300_000, 2: 1, 3: 0, 4: 0}
    scored = toxicity.score(docs, labels).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
    pages = spark.createDataFrame([(1, "http://a.org/" + "x" * 2_000_000), (2, None), (3, "no scheme")], "page_id long, url string").withColumns(clash)
    got = {r.page_id: (r.host, len(r.path)) for r in reputation.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()}
    assert got == {1: ("a.org", 2_000_001), 2: ("", 0), 3: ("", 0)}
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, None, None)], "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1)})
    back = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert back == {1: (2, len(long)), 2: (1, 0)}


def test_pipeline_on_an_empty_table_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    names = {c: F.lit(5) for c in ("row", "th", "d", "t", "n", "copies", "spans", "left")}
    docs = spark.createDataFrame([(i, words(rng, 90), "en", "a", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").withColumns(names)
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/full/labels.parquet")
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/full").select("doc_id").distinct().count() == 20
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
