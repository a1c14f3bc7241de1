"""Probes against plain Python: inserted identifiers, shards of options, options of other tasks, rendered states."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from gristmill.operators import probes

UUID4 = r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"


def test_nonce_variants_change_one_place(spark):
    record = {"order_id": 4711, "né": ["a", {"id": "x-9"}], "n": 1.50}
    states = [
        " " + json.dumps(record, indent=2) + "\n", json.dumps(record, ensure_ascii=False, separators=(",", ":")), "one\n\ntwo\n\n", "", "[1, 2]", None,
        '{"a":1, "b" : 2}', json.dumps({"id": "q1", "copy": "q1"}), json.dumps({"id": "asked"}),
    ]
    rows = [(i, s, "Is asked this urgent?") for i, s in enumerate(states)] + [(99, "one", "How many lines?"), (98, "one", None)]
    got = {(r.k, r.kind): r.state for r in probes.nonce_variants(spark.createDataFrame(rows, "k long, s string, q string"), "k", "s", "q").collect()}
    assert set(got) == {(0, "json_key"), (0, "id_replace"), (1, "json_key"), (1, "id_replace"), (2, "text_line"), (3, "text_line"), (7, "json_key"), (8, "json_key"), (98, "text_line")}
    for i in (2, 3):
        cut = re.sub(rf"(\n\n)?(id|ref|request-id|trace id|msg-id): {UUID4}(\n\n)?", "#", got[i, "text_line"])
        assert cut.replace("#", "\n\n", 1).strip("\n") == states[i].strip("\n") or cut.replace("#", "").strip("\n") == states[i].strip("\n")
    for i in (0, 1):
        added = json.loads(got[i, "json_key"])
        new = set(added) - set(record)
        assert len(new) == 1 and new <= set(probes.NONCE_KEYS) and re.fullmatch(UUID4, added[new.pop()])
        assert {k: v for k, v in added.items() if k in record} == record and [k for k in added if k in record] == list(record)
        changed = got[i, "id_replace"]
        [new_id] = re.findall(UUID4, changed)
        assert states[i] in (changed.replace(f'"{new_id}"', "4711"), changed.replace(new_id, "x-9"))


def test_shards_against_plain_python(spark):
    cases = [([5, 5, 5], 10), ([25, 1], 10), ([20, 20, 1, 1, 20], 10), ([], 10), ([20], 10)]

    def plain(lengths, head, budget):
        if not lengths or max(lengths) + head > budget:
            return None
        out, used, now = [], head, 0
        for i, x in enumerate(lengths):
            if i and used + x > budget:
                now, used = now + 1, head
            used += x
            out.append(now)
        return out

    got = spark.createDataFrame(cases, "x array<int>, h int").select(probes.shards(F.col("x"), F.col("h"), 30).alias("s")).collect()
    assert [r.s for r in got] == [plain(x, h, 30) for x, h in cases]


def test_churn_keeps_mass_sentinel_and_clashing_columns(spark):
    rows = [
        (1, ["Aa", "Bb", "Cc", "Dd", "none"], [0.0, 1.0, 0.0, 0.0, 0.0], 9, 2, 4, "x"), (2, ["a", "b"], [1.0, 0.0], 1, 1, None, "x"), (3, ["a", "b", "c"], None, 1, 1, None, "x"),
        (4, ["a", "b", "c"], [0.2, 0.5, 0.3], 2, 9, None, "x"), (5, ["a", "b", "c"], [0.25, 0.5, 0.25], 2, 3, None, "x"), (5, ["a", "b", "c"], [0.25, 0.5, 0.25], 2, 3, None, "x"),
        (6, None, None, 1, 1, None, "x"),
    ]
    df = spark.createDataFrame(rows, "k long, options array<string>, probs array<double>, drop int, add int, sentinel long, _shape string")
    fillers = spark.createDataFrame([("AA",), ("bB",), ("one",), ("ONE",), ("two",), ("three",), ("a whole phrase",), (None,), ("12",)], "option string")
    got = probes.churned(df, "k", fillers).collect()
    assert sorted(r.k for r in got) == [1, 2, 3, 4, 5, 5, 6] and all(r._shape == "x" for r in got)
    by = {r.k: r for r in got}
    assert (by[2].options, by[3].options, by[4].options, by[6].options) == (["a", "b"], ["a", "b", "c"], ["a", "b", "c"], None)
    one = dict(zip(by[1].options, by[1].probs))
    assert one["Bb"] == 1.0 and "none" in one and len(one) == 5 and sum(one.values()) == 1.0 and len(set(one) & {"Aa", "Cc", "Dd"}) == 1
    five = dict(zip(by[5].options, by[5].probs))
    assert {k: five[k] for k in "abc"} == {"a": 0.25, "b": 0.5, "c": 0.25} and len(five) == 6 and set(five) - set("abc") <= {"bB", "one", "ONE", "two", "three"}


def test_criteria_and_rendered_states(spark):
    rows = spark.createDataFrame([(1, "ml_de_x", ["a", "b"]), (2, "ml_fr", ["a"]), (3, "other", ["a"]), (4, None, ["a"]), (5, "ml_de", [])], "k long, task string, options array<string>")
    known = spark.createDataFrame([("ml_", "a", "any"), ("ml_de_", "b", "German"), ("ml", "a", "no prefix"), ("ml_fr", "a", None)], "task_prefix string, option string, text string")
    got = {r.k: r.criteria for r in probes.criteria_for(rows, "k", "task", "options", known).collect()}
    assert got == {1: [None, "German"], 2: ["any"], 3: None, 4: None, 5: None}
    wires = ['"plain \\u00e9"', '{"b":1,"a":["é"]}', "[]", "3", "{bad", None]
    made = [r.x for r in spark.createDataFrame([(w,) for w in wires], "w string").select(probes.render_state("w").alias("x")).collect()]
    assert made == ["plain é", json.dumps({"b": 1, "a": ["é"]}, indent=2, ensure_ascii=False), "[]", None, None, None]


def test_lookups_can_be_answered(spark):
    for r in probes.lookups(spark, sizes=(2, 17), reps=4).collect():
        bins = dict(line.split(": bin ") for line in r.state.split("\n")[1:])
        assert len(bins) == r.n == len(set(r.options)) and set(bins) == set(r.options) and bins[r.options[r.target]] == re.search(r"\d+", r.question)[0]
    with pytest.raises(ValueError):
        probes.lookups(spark, sizes=(1001,))
