"""The ten operators against brute force, and on nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat, jaccard, licences, mixing, neighbours, packing, quality, repeats, reputation, toxicity
from gristmill.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return "".join(w + (". " if i % 11 == 10 else "\n" if i % 47 == 46 else " ") for i, w in enumerate(words)).strip()


def near(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 40, 120, 300])) for _ in range(60)]
    passage = prose(rng, 90)
    texts = [None, "", " \t\n", "One", "ONE", "a b c d e", "x" * 70_000, "é" * 900 + " end", *base, *base[:8]]
    texts += [near(rng, base[9 + i % 3] if len(base[9 + i % 3].split()) > 30 else base[0], 1) for i in range(12)]
    texts += [prose(rng, 60) + " " + passage + " " + prose(rng, 60) for _ in range(7)]
    family = prose(rng, 200)
    texts += [near(rng, family, rng.randint(1, 9)) for _ in range(25)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[20], out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {c: F.lit("clash") for c in ("n", "g", "h", "start", "label", "token", "sig", "th", "place", "spans", "level", "row", "rate", "copies", "x0")}
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns(clash).cache()


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(i % 4 > 0), int(i % 5 == 0)) for i, r in enumerate(rows) if i % 3], "doc_id long, quality int, toxic int")


# --- packing


def test_packing_covers_every_id_once(docs, rows):
    encoder = packing.Encoder()
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: np.array([*(plain.encode(r[1] or "", add_special_tokens=False).ids), 1], "<u4") for r in rows}
    assert all((encoder.ids(r[1]) == ids[r[0]]).all() for r in rows)
    got = packing.pack_documents(docs, with_ids=True, run_tokens=5000).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(own.tobytes()) == p.ids_crc32 and list(own) == p.ids
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    times = collections.Counter(r[0] for r in rows)
    for d, pieces in by_doc.items():
        assert sorted(x for s, n in pieces for x in range(s, s + n)) == sorted(x for x in range(len(ids[d])) for _ in range(times[d]))
    padding = 0
    for pieces in by_sequence.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding < 0.2 * sum(len(x) for x in ids.values())
    assert set(by_doc) == set(ids)


def test_packing_is_optimal_on_small_streams():
    rng = np.random.default_rng(1)
    for _ in range(60):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 30))])
        penalty = rng.integers(0, 20, len(pos))
        penalty[[0, -1]] = 0
        best = [0] + [10**9] * (len(pos) - 1)
        for i in range(1, len(pos)):
            for j in range(i):
                n = int(pos[i] - pos[j])
                if n <= 16:
                    best[i] = min(best[i], best[j] + (0 if n & (n - 1) == 0 else 16 - n) + int(penalty[i]) + 3)
        cuts = packing.choose_cuts(pos, penalty, 16, 3)
        total = sum((0 if (n := int(pos[b] - pos[a])) & (n - 1) == 0 else 16 - n) + int(penalty[b]) + 3 for a, b in zip(cuts, cuts[1:], strict=False))
        assert total == best[-1] and all(pos[b] - pos[a] <= 16 for a, b in zip(cuts, cuts[1:], strict=False))


def test_special_and_rare_characters_take_the_tokenizer():
    e = packing.Encoder()
    for t in ("<|endoftext|> x", "漢字 \U0001f600 ١٢٣", "a\u200bb", "tab\t\n\n  x"):
        assert list(e.ids(t)[:-1]) == e.slow.encode(t, add_special_tokens=False).ids


# --- URL filters


def test_url_edges(spark):
    urls = [None, "", "no scheme", "://", "http://A.Example.COM", "x://y://z/en/1", "http://com/en/1", "http://dotcom/en/1", "https://example.com/en/71?x", "https://a.example.net/de/8#y", "http://example.net/de/9", "http://É.org/es/", "http://u@h.org:80/es/2"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(4, True), (4, None), (999, True), (None, True)], "page_id long, bad boolean")
    got = {r.page_id: r for r in reputation.judge(pages, labels).collect()}
    assert [(got[i].host, got[i].path) for i in range(7)] == [("", ""), ("", ""), ("", ""), ("", ""), ("a.example.com", ""), ("y:", "//z/en/1"), ("com", "/en/1")]
    assert [(got[i].rule, got[i].verdict) for i in (6, 8, 9, 10, 11)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert got[7].rule is None and got[12].rule is None
    assert reputation.judge(pages.limit(0), labels).count() == 0
    assert reputation.judge(pages, labels.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_reputation_shrinks(spark):
    """A host with many bad pages is blocked, one with a single bad page isn't, an unseen host of a bad domain is."""
    rows = [("bad.worse.xyz", i % 10 > 0) for i in range(200)] + [("fine.good.xyz", i % 50 == 0) for i in range(200)] + [("new.good.xyz", True)]
    pages = [(i, f"http://{h}/p", b) for i, (h, b) in enumerate(rows)] + [(900, "http://other.worse.xyz/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, bad boolean")
    got = {r.host: r.verdict for r in reputation.judge(df.drop("bad"), df.select("page_id", "bad")).collect()}
    assert got == {"bad.worse.xyz": "block", "fine.good.xyz": "allow", "new.good.xyz": "allow", "other.worse.xyz": "block"}


# --- quality rules


def base_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = collections.defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    hit = {j for v in where.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(docs, rows):
    extra = ["a a a a", "x y z\nx y z\n\n x y z", "##\n##\n" * 9, "a b c a b c a b"]
    for t in [*(r[1] for r in rows), *extra]:
        x = quality.text_statistics([(t or "").encode()])
        assert tuple(int(x[c][0]) for c in quality.BASE) == base_statistics(t), t
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(docs).collect())
    assert got == collections.Counter((r[0], *base_statistics(r[1])) for r in rows)


def test_quality_rejects_planted_junk_and_keeps_clean(spark):
    rng = random.Random(2)
    clean = [(i, prose(rng, rng.randint(60, 400)), "en", rng.choice("ab"), 0) for i in range(700)]
    junk = [(1000 + i, " ".join(w + "&&&" for w in prose(rng, 200).split()), "en", "a", 0) for i in range(20)]
    df = spark.createDataFrame(clean + junk, DOCS)
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert not any(got[i] for i in range(1000, 1020)) and sum(got[i] for i in range(700)) >= 698
    left = quality.filter_documents(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {k for k, v in got.items() if v}
    assert quality.judge(df.limit(0)).count() == 0 and quality.filter_documents(df.limit(0)).count() == 0


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 2) - 5.991464547) < 1e-6 and abs(quality.chi2_cdf(7, 7) - 0.571119) < 1e-5


# --- nearest neighbours


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x[100:600] = x[100] + 0.05 * rng.normal(size=(500, 24))  # a dense group
    x[700:710] = x[700]  # equal vectors
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0, None] + [1.0] * 22), (5200, [float("inf")] + [1.0] * 23), (5250, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = neighbours.search(df).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in own)
        assert [r.score for r in own] == sorted((r.score for r in own), reverse=True)
        hit += len({r.vec_id for r in own} & set(best.tolist()))
    assert {r.query_id for r in got} == set(range(0, 3000, 50)) and hit >= 0.95 * 5 * 60
    tied = sorted((r for r in got if r.query_id == 700), key=lambda r: r.rank)
    assert [r.vec_id for r in tied] == [701, 702, 703, 704, 705]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(few).collect())[0][0] == 0 and neighbours.search(few).count() == 2
    assert neighbours.search(few.limit(0)).count() == 0


# --- suffix-array dedup


def brute_spans(texts):
    count = collections.Counter(b[i : i + 400] for b in texts for i in range(len(b) - 399))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        out.append(bytes(gone))
    return out


@pytest.mark.parametrize("group_most", [5000, 2])
def test_repeats(docs, rows, group_most):
    rows = [r for r in rows if len(r[1] or "") < 60_000]
    texts = [(r[1] or "").encode() for r in rows]
    want = collections.Counter()
    for r, b, gone in zip(rows, texts, brute_spans(texts), strict=True):
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        want[(r[0], len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())] += 1
    got = collections.Counter(tuple(r)[:5] for r in repeats.report(docs.where("length(coalesce(text, '')) < 60000"), group_most).collect())
    assert got == want and sum(k[2] for k in want) > 0


def test_repeats_within_one_text_and_removal(spark):
    rng = random.Random(8)
    p = prose(rng, 100)
    df = spark.createDataFrame([(1, p + " middle " + p, "en", "a", 0), (2, "é" * 300 + prose(rng, 50), "en", "a", 0), (3, "é" * 300, "fr", "b", 0), (4, None, None, None, None)], DOCS)
    left = {r.doc_id: r.text for r in repeats.remove_repeats(df).collect()}
    assert left[1] == " middle " or left[1].strip() == "middle"
    assert 4 in left and left[4] is None and left[2].count("é") == 0 and 3 not in left
    assert repeats.report(df.limit(0)).count() == 0 and repeats.remove_repeats(df.limit(0)).columns == df.columns


def test_intervals_are_the_common_prefix_tree():
    rng = random.Random(0)
    for _ in range(200):
        words = sorted("".join(rng.choice("ab") for _ in range(5)) for _ in range(rng.randint(2, 9)))
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 5)
        prefix = np.array([common(a, b) for a, b in zip(words, words[1:], strict=False)])
        want = {(i, j, r) for i in range(len(words)) for j in range(i + 1, len(words)) for r in [min(prefix[i:j])] if (i == 0 or prefix[i - 1] < r) and (j == len(words) - 1 or prefix[j] < r)}
        assert set(repeats.intervals(prefix)) == want


# --- toxicity


def test_toxicity_held_out_and_gapped(spark):
    rng = random.Random(4)
    insults = ["blorkhead", "snivelwort", "grubbish", "mucklout"]
    texts = []
    for i in range(1200):
        t = prose(rng, rng.randint(20, 120)).split(" ")
        if i % 6 == 0:
            for _ in range(rng.randint(2, 4)):
                t.insert(rng.randrange(len(t)), rng.choice(insults))
        texts.append((i, " ".join(t), "en", "a", 0))
    texts += [(5000, "calm words blork-head here", "en", "a", 0), (5001, "s n i v e l w o r t you", "en", "a", 0), (5002, "such a mucxklout then", "en", "a", 0), (5003, None, None, None, None), (5004, "", None, None, None), (5005, "a b", None, None, None)]
    df = spark.createDataFrame(texts, DOCS).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(1200)] + [(None, 1, 1), (9999, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    held = [i for i in range(1200) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(1200))
    assert sum(got[i].predicted == int(i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert all(got[i].predicted == 1 for i in (5000, 5001, 5002)) and all(got[i].predicted == 0 for i in (5003, 5004, 5005))
    assert all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.score(df.limit(20), labels.limit(0))
    assert none.count() == 20 and toxicity.score(df.limit(0), labels).count() == 0


# --- chat


def test_chat_round_trip(spark):
    rng = random.Random(3)
    piece = ["\\", "<s>", "</s>", "[INST]", "<<SYS>>", "<", "/s", ">", "é", "a", "[/INST]", "<\\s>", "\\\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<s>"]), rng.choice([None, ""]) if rng.random() < 0.2 else "".join(rng.choice(piece) for _ in range(rng.randint(0, 9)))) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [rows[0], (None, 1, "user", "x"), (None, None, "assistant", "y"), (70, 1, "assistant", "b"), (70, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    want = collections.defaultdict(list)
    for r in sorted(rows, key=order):
        want[r[0]].append((r[2] or "", r[3] or ""))
    made = chat.format_conversations(df)
    for r in made.collect():
        raw = r.formatted.encode()
        assert [(a.decode(), b.decode()) for a, b in chat.parse(raw)] == want[r.conv_id]
        assert [chat.unescape(raw[a:b]).decode() for a, b in zip(r.loss_start, r.loss_stop, strict=True)] == [t for role, t in want[r.conv_id] if role == "assistant"]
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert set(back) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (back[c].n_turns, back[c].loss_chars, back[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# --- licences


def test_licences(spark):
    mit = licences.LICENCES["MIT"][0]
    texts = [None, "", "Copyright (c) 2020 A", "Copyright (c) 2021 B. All rights reserved.\n\n" + mit.upper().replace(",", " ,"), mit + " extra", "Some words.\nReleased under the MIT Licence!\nmore\nReleased under the MIT License.", "Licenced under CC BY-NC 4.0", mit]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("name", F.lit("clash"))
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [got[i].licence for i in range(8)] == [None, None, None, "MIT", None, None, "CC-BY-NC-4.0", "MIT"]
    assert [got[i].digest is None for i in range(4)] == [True, True, True, False]
    assert (got[5].n_notices, got[5].notices) == (2, "MIT") and (got[0].n_notices, got[0].notices) == (0, "")
    assert all(licences.canonical_text(t or "") == (r.c or "") for t, r in zip(texts, df.orderBy("doc_id").select(licences.canonical(F.col("text")).alias("c")).collect(), strict=True))
    assert licences.scan(df.limit(0)).count() == 0


# --- mixing


def test_mixing_reaches_targets(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        kind = ("clean", "low", "toxic")[0 if i % 10 < 6 else 1 if i % 10 < 8 else 2]
        t = prose(rng, rng.randint(60, 200))
        t = " ".join(w + "##" for w in t.split()) if kind == "low" else t + " grubbish grubbish snivelwort" if kind == "toxic" else t
        rows.append((i, t, "en", "a", 0))
        marks.append((i, int(kind != "low"), int(kind == "toxic")))
    rows += [(2000, None, None, None, None), (2001, "", None, None, None), rows[3]]
    df = spark.createDataFrame(rows, DOCS).withColumn("rate", F.lit("clash"))
    labels = spark.createDataFrame([*marks[:700], (None, 1, 1), (8888, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    targets = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    got = mixing.rates(df, labels, targets).collect()
    total = {d: sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS}
    whole = sum(total.values())
    assert all(abs(total[d] / whole - targets[d]) < 0.01 for d in targets) and all(r.rate >= 0 for r in got)
    assert all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 for r in got)
    assert all(abs(r.copies - r.rate) < 1 for r in got) and len(got) == len(rows)
    mixed = mixing.mix(df, labels, targets)
    assert mixed.columns == df.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +sum((collections.Counter({r.doc_id: r.copies}) for r in got), collections.Counter())
    assert mixing.rates(df.limit(0), labels).count() == 0 and mixing.rates(df, labels.limit(0)).count() == len(rows)


def test_mixing_matches_brute_force(spark):
    """The fold over a few grid cells against plain projected gradient in numpy."""
    cells = [(1.0, 0.0, 0.0, 500), (0.25, 0.5, 0.25, 300), (0.0, 0.25, 0.75, 200)]
    stats = spark.createDataFrame([(float(a), float(b), float(c), n) for a, b, c, n in cells], "p0 double, p1 double, p2 double, n_tokens long")
    columns = [F.col(f"p{k}") for k in range(3)]
    history = mixing.fit_rates(stats, columns, mixing.TARGETS)
    got = [r.r for r in stats.orderBy(F.desc("n_tokens")).select(mixing._rate(columns, history)["r"].alias("r")).collect()]
    p, t = np.array([c[:3] for c in cells]), np.array([c[3] for c in cells], float)
    now = t @ p
    goal = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * now[0] / mixing.TARGETS["clean"]
    r = np.ones(3)
    for _ in range(200_000):
        r = np.maximum(0, r - 0.5 * (p @ ((t * r) @ p - goal)) / t.sum())
    assert np.abs((t * got) @ p - (t * r) @ p).max() < 0.02 * t.sum()


# --- n-gram Jaccard


def brute_groups(rows):
    sets = {}
    for i, r in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("list_most", [20_000, 4])
def test_jaccard_groups(docs, rows, list_most, monkeypatch):
    if list_most == 4:
        monkeypatch.setattr(jaccard, "ROUNDS", ("across",))  # all pairs by the exact round alone
    got = collections.Counter(tuple(r) for r in jaccard.groups(docs, list_most).collect())
    assert got == brute_groups(rows)


def test_jaccard_one_each(docs, rows):
    kept = jaccard.one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _, c in brute_groups(rows) if d == c})
    assert jaccard.groups(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(200, 260)] + [(300, 300)]
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(200, 260)}}


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    passage = prose(rng, 80)
    base = [prose(rng, rng.randint(60, 250)) for _ in range(400)]
    texts = [*base, *base[:5], *[near(rng, base[7], 1) for _ in range(3)], *[prose(rng, 60) + passage + prose(rng, 60) for _ in range(4)], "too short", None]
    rows = [(i, t, "en", rng.choice("ab"), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    assert set(ids["quality_rules"]) <= set(range(412)) and len(ids["quality_rules"]) >= 408
    one = brute_groups([r for r in rows if r[0] in set(ids["quality_rules"])])
    assert sorted(ids["ngram_jaccard"]) == sorted(d for d, _, c in one if d == c)
    assert passage[10:-10] not in "\n".join(r.text for r in seen["suffix_array_dedup"].collect())
    assert len(ids["mix_sources"]) >= 0.95 * len(ids["suffix_array_dedup"]) and set(ids["packing"]) == set(ids["mix_sources"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids["packing"])
