"""Operators on hand-built rows: empty inputs, ties, nulls, and invariants of those without SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gristmill.functions import arrays, hashing, text
from gristmill.operators import audit, balance, contamination, dedup, evaluate, rules
from gristmill.sources import jsonl


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_split_ideographs_and_fold_case(spark):
    assert one(spark, text.tokens(F.lit("Ab_c 你好 x1")).alias("t")).t == ["ab", "c", "你", "好", "x1"]


@pytest.mark.parametrize(("words", "short", "want"), [(["a"], False, []), (["a"], True, ["a"]), ([], True, []), (["a", "b", "a", "b"], False, ["a b", "b a"])])
def test_shingles(spark, words, short, want):
    assert one(spark, text.shingles(F.array(*map(F.lit, words)).cast("array<string>"), 2, short).alias("s")).s == want


def test_split_shares(spark):
    rows = spark.range(4000).select(hashing.split_of(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 4000 for r in rows}
    assert abs(share["train"] - 0.70) < 0.03 and abs(share["devreal"] - 0.15) < 0.03


def test_argmax_ties_to_first(spark):
    assert one(spark, arrays.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).alias("i")).i == 0


def test_posterior_without_mass_is_null(spark):
    p = arrays.posterior(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.array(F.lit(0.0), F.lit(0.0))))
    assert one(spark, p.alias("p")).p is None


@pytest.mark.parametrize(("values", "want"), [((True, True, None), False), ((True, False, None), None), ((True, False, False), True), ((False, False, False), False)])
def test_exactly_one(spark, values, want):
    assert one(spark, rules.kleene("one", [F.lit(v).cast("boolean") for v in values]).alias("v")).v is want


def test_blocked_needs_half_of_one_item(spark):
    item = " ".join(f"w{i}" for i in range(24))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, " ".join(f"w{i}" for i in range(9))), (3, "x\nalpha beta gamma delta epsilon zeta\ny"), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "alpha beta gamma delta epsilon zeta"), (3, None)], "item_id long, text string")
    assert {r.doc_id for r in contamination.blocked(docs, items).collect()} == {1, 3}
    assert contamination.keep(docs.limit(0), items).count() == 0


def test_linked_takes_the_least(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 3)], "a long, b long")
    assert {r.node: r.root for r in dedup.linked(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4}


def test_exact_drops_conflicting_labels(spark):
    rows = spark.createDataFrame([(1, "A  b", 0), (2, "a b", 0), (3, "c", 0), (4, "C ", 1)], "id long, t string, y int")
    assert [(r.id, r.copies) for r in dedup.exact(rows, "id", "y", "id", "t").collect()] == [(1, 2)]


def test_pairing_by_occurrence(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, id long")
    b = spark.createDataFrame([("k", 7), ("m", 8)], "key string, id long")
    assert {(r.key, r.id_a, r.id_b) for r in evaluate.paired(a, b, "key", "id").collect()} == {("k", 1, 7), ("m", 3, 8)}


def test_bin_edges_differ(spark):
    r = one(spark, evaluate.bin_left(F.lit(1 / 3), 3).alias("l"), evaluate.bin_right(F.lit(1 / 3), 3).alias("r"), evaluate.bin_left(F.lit(1.0), 3).alias("top"), evaluate.bin_right(F.lit(0.0), 3).alias("low"))
    assert (r.l, r.r, r.top, r.low) == (1, 0, 2, 0)


def test_pearson_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, x double, y double")
    assert evaluate.pearson(rows, "x", "y", ["g"]).first().r is None


def test_bootstrap_covers_and_ignores_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 40).alias("c"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("v"))
    r = evaluate.bootstrap(rows, "v", "c").first()
    again = evaluate.bootstrap(rows.repartition(7), "v", "c").first()
    assert r.low < r["mean"] < r.high and abs(r.low - again.low) < 1e-9
    assert r.high - r.low < 6 * 0.29 / 2000**0.5


def test_temperature_recovers_scale(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    rows = spark.createDataFrame([([float(x) for x in z * 3], t) for z, t in zip(logits, y, strict=True)], "logits array<double>, target long")
    assert abs(evaluate.fit_temperature(rows) - 3) < 0.3


def test_carve_never_takes_a_whole_task(spark):
    rows = spark.createDataFrame([("small", i) for i in range(10)] + [("big", i // 3) for i in range(300)], "task string, g long")
    got = balance.carve(rows, "task", "g").collect()
    assert {r.task for r in got} == {"big"} and 3 <= 3 * len(got) <= 18


def test_positives_first_is_disjoint_and_prefers_positives(spark):
    rows = spark.range(1000).select("id", *((F.col("id") % m == 0).cast("int").alias(f"m{m}") for m in (3, 5)))
    got = balance.positives_first(rows, "id", ["m3", "m5"], 40, 0.5).collect()
    assert len(got) == len({r.id for r in got}) == 80
    assert sum(r.id % 5 == 0 for r in got if r.task == "m5") >= 20


def test_disjoint_slices_cover(spark):
    rows = spark.range(11).withColumn("g", F.lit(1))
    parts = [r.part for r in balance.disjoint_slice(rows, ["g"], "id", 4).orderBy("id").collect()]
    assert parts == [next(i for i in reversed(range(4)) if 11 * i // 4 <= p) for p in range(11)]


def test_wording_gain_finds_a_planted_wording(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "told").otherwise("plain").alias("task"), (F.pmod(F.xxhash64("id"), F.lit(4))).alias("wording"), "id")
    rows = rows.withColumn("target", F.when(F.col("task") == "told", F.col("wording")).otherwise(F.pmod(F.xxhash64(F.col("id") + 7), F.lit(4))))
    got = {r.task: r for r in audit.wording_gain(rows, "task", "wording", "target").collect()}
    assert got["told"].gain > 0.5 > got["told"].null and got["plain"].gain < 0.15


def test_flatten_json(spark):
    rows = spark.createDataFrame([('{"a": {"b": [1, "x", {}]}, "c d": "1"}',), ("not json",), (None,), ("[]",)], "j string")
    assert [r.paths for r in audit.flatten_json(rows, "j").collect()] == ['a.b[0]: 1\na.b[1]: x\na.b[2]: {}\n["c d"]: "1"', None, None, "[]"]


def test_unflatten_is_the_inverse(spark):
    import json

    values = [{"a": {"b": [1, "x", {}, []]}, "c d": "1", "e": None, "t": "true", "n": -1.5}, [1, [2, {"k": "v: w"}]], "plain: text", 7, {}, [], {"q": "line\nbreak", "r": " pad "}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, j string")
    back = audit.unflatten_json(audit.flatten_json(rows, "j"), "paths").orderBy("i").collect()
    assert [json.loads(r.json) for r in back] == values


def test_temperature_by_size_recovers_slope(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for _ in range(4000):
        n = int(rng.choice([2, 4, 8]))
        z = rng.normal(size=n) * 2
        p = np.exp(z) / np.exp(z).sum()
        rows.append((n, [float(x) for x in z * 2 * (n / 2) ** 0.5], int(rng.choice(n, p=p))))
    t, slope = evaluate.fit_temperature_by_size(spark.createDataFrame(rows, "n long, logits array<double>, target long"))
    assert abs(t - 2) < 0.3 and abs(slope - 0.5) < 0.15


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("t", "s", [("q1", "Good?", ["no", "yes"], "1", None, None, None), ("q2", "P?", ["no", "yes"], "[0.3,0.7]", None, None, None)])], jsonl.EXAMPLE)
    jsonl.write_examples(rows, str(tmp_path / "x"))
    got = jsonl.questions(jsonl.examples(spark, str(tmp_path / "x"))).orderBy("position").collect()
    assert [(r.id, r.target_index, r.target_probs) for r in got] == [("q1", 1, None), ("q2", None, [0.3, 0.7])]
    assert jsonl.lines(spark, str(tmp_path / "x")).count() == 1


def test_tolerant_reader_skips_bad_lines(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text('{"task": "a"}\nnot json\n\n{"task": "b"}\n')
    assert {r.task for r in jsonl.records(spark, str(tmp_path / "raw.jsonl"), "task string", strict=False).collect()} == {"a", "b"}
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        jsonl.records(spark, str(tmp_path / "raw.jsonl"), "task string").collect()


def test_corpus_build_keeps_splits_apart(spark):
    from gristmill.plans import corpus

    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("task"), (F.col("id") % 12).cast("string")).alias("task"), F.concat(F.lit("d"), (F.col("id") % 9).cast("string")).alias("domain"), F.concat_ws(" ", F.lit("state"), *(F.sha1(F.concat((F.col("id") % 590).cast("string"), F.lit(i))) for i in map(str, range(4)))).alias("state"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("target"))
    items = spark.createDataFrame([(1, "nothing of this stands in any of the states that the rows above hold at all")], "item_id long, text string")
    got = corpus.build(rows, items)
    assert got.count() > 300
    states = got.join(rows.select("doc_id", "state"), "doc_id").groupBy("state").count()
    assert states.where("count > 1").count() == 0


def test_solved_tracker_stream(spark, tmp_path):
    from gristmill.streaming import events as stream

    spark.createDataFrame([("t", 1)] * 40, "task string, correct int").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("task string, correct int").parquet(str(tmp_path / "in"))
    q = stream.solved(rows, window=20).writeStream.outputMode("update").format("memory").queryName("solved").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.task, r.solved, r.accuracy) for r in spark.table("solved").collect()] == [("t", True, 1.0)]


def test_corpus_build_moves_no_states(spark):
    from gristmill.plans import corpus

    def written():
        sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    state = F.concat_ws("", *(F.sha2(F.concat((F.col("id") % 790).cast("string"), F.lit(i)), 256) for i in map(str, range(100))))
    rows = spark.range(800).select(F.col("id").alias("doc_id"), F.concat(F.lit("task"), (F.col("id") % 12).cast("string")).alias("task"), F.concat(F.lit("d"), (F.col("id") % 9).cast("string")).alias("domain"), F.concat(F.lit("word "), state).alias("state"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("target"))
    items = spark.createDataFrame([(1, "nothing of this stands in any of the states that the rows above hold at all")], "item_id long, text string")
    before = written()
    assert corpus.build(rows, items).count() > 300
    assert sum(v for k, v in written().items() if k not in before) < 2_000_000  # the states have 5 MB


def test_containment_of_common_lines_makes_few_pairs(spark, monkeypatch):
    import random

    from gristmill.operators import dedup

    rng = random.Random(5)
    lines = [" ".join(f"l{i}w{j}" for j in range(14)) for i in range(5)]
    own = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(60)]
    texts = [" ".join([f"u{d}", *rng.sample(lines, rng.choice([1, 1, 1, 2, 3])), f"v{d}", *([rng.choice(own)] if d % 9 == 0 else []), f"z{d}"]) for d in range(900)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = [{tuple(w[i : i + 10]) for i in range(len(w) - 9)} for w in map(str.split, texts)]
    want = {d: best / len(x) for d, x in enumerate(runs) if (best := max(len(x & y) for e, y in enumerate(runs) if e != d))}
    joined = []
    whole = dedup.most_shared
    monkeypatch.setattr(dedup, "most_shared", lambda held, limit=8: joined.append(held.count()) or whole(held, limit))
    got = {r.doc_id: r.share for r in dedup.containment(rows, "doc_id", "text").collect()}
    assert got == pytest.approx(want)
    assert len(joined) > 1 and joined[-1] < joined[0] / 20  # the frequent items' sets are few
