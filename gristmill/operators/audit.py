"""Integrity counts over examples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(state: Column, question: Column, options: Column, target: Column, probs: Column) -> dict[str, Column]:
    """A flag for each rule that an example can break."""
    low = F.transform(options, lambda o: F.lower(F.trim(o)))
    total = F.aggregate(probs, F.lit(0.0), lambda a, b: a + b)
    return {
        "empty_state": F.coalesce(F.trim(state) == "", F.lit(True)), "empty_question": F.coalesce(F.trim(question) == "", F.lit(True)),
        "duplicate_options": F.size(F.array_distinct(low)) < F.size(options), "target_range": ~F.coalesce(target.between(0, F.size(options) - 1), F.lit(True)),
        "soft_length": F.size(probs) != F.size(options), "soft_sum": (F.abs(total - 1) > 1e-3) | F.exists(probs, lambda p: p < -1e-9),
        "unfilled_slot": F.regexp_like(question, F.lit(r"\{[a-z_]+\}")),
    }


def counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(rule, n), in one pass."""
    made = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()))
    return made.select(F.expr(f"stack({len(flags)}, {', '.join(f'{k!r}, {k}' for k in flags)}) as (rule, n)"))


def cross_split(rows: DataFrame, split: str, state: str) -> DataFrame:
    """(state digest, splits) of states that stand in more than one split."""
    return rows.groupBy(F.sha2(state, 256).alias("state")).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def wording_gain(rows: DataFrame, task: str, wording: str, target: str, least: int = 200, nulls: int = 40) -> DataFrame:
    """(task, n, gain, null): how much better a wording's usual answer in one half predicts the other half than the commonest
    answer does, and the largest such gain over shuffled wordings.

    The rows of a task are first reduced to counts by (half, wording, target); shuffles are drawn from these tables.
    """
    half = F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(2))
    table = rows.groupBy(task, half.alias("half"), wording, target).agg(F.count(F.lit(1)).alias("n"))

    def gain(w: np.ndarray, t: np.ndarray, h: np.ndarray) -> float:
        c = np.zeros((2, w.max() + 1, t.max() + 1))
        np.add.at(c, (h, w, t), 1)
        usual, common = c[0].argmax(1), c[0].sum(0).argmax()
        n = max(1.0, c[1].sum())
        return float((c[1][np.arange(len(usual)), usual].sum() - c[1][:, common].sum()) / n)

    def judge(own: pd.DataFrame) -> pd.DataFrame:
        total = int(own["n"].sum())
        if total < least or own[wording].nunique() < 2:
            return pd.DataFrame({"task": [], "n": [], "gain": [], "null": []})
        own = own.sort_values(["half", wording, target])
        w, t = (pd.factorize(own[c], sort=True)[0].repeat(own["n"]) for c in (wording, target))
        h = own["half"].to_numpy().repeat(own["n"])
        rng = np.random.default_rng(0)
        shuffled = max(gain(rng.permutation(w), t, h) for _ in range(nulls))
        return pd.DataFrame({"task": [own[task].iloc[0]], "n": [total], "gain": [gain(w, t, h)], "null": [shuffled]})

    return table.groupBy(task).applyInPandas(judge, "task string, n long, gain double, null double")


def flatten_json(rows: DataFrame, column: str, name: str = "paths") -> DataFrame:
    """rows with one `path: value` line a leaf of a JSON column; null where it isn't JSON."""
    import json
    import re

    def walk(x: object, path: str) -> Iterator[str]:
        if isinstance(x, dict) and x:
            for k, v in x.items():
                key = k if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) else f"[{json.dumps(k, ensure_ascii=False)}]"
                yield from walk(v, key if not path and not key.startswith("[") else f"{path}.{key}" if not key.startswith("[") else path + key)
        elif isinstance(x, list) and x:
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]")
        else:
            plain = isinstance(x, str) and path and x.strip() == x and x and "\n" not in x and not re.fullmatch(r"-?[0-9.eE+-]+|true|false|null|[\[{\"].*", x)
            value = x if plain else json.dumps(x, ensure_ascii=False)
            yield f"{path}: {value}" if path else str(value)

    def one(text: str | None) -> str | None:
        try:
            return "\n".join(walk(json.loads(text), ""))
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def flat(x: pd.Series) -> pd.Series:
        return x.map(one)

    return rows.withColumn(name, flat(column))


def unflatten_json(rows: DataFrame, column: str, name: str = "json") -> DataFrame:
    """The inverse of flatten_json: a compact JSON column from path lines; null where a line can't be read."""
    import json
    import re

    token = re.compile(r'\.?([A-Za-z_][A-Za-z0-9_]*)|\[(\d+)\]|\[("(?:[^"\\]|\\.)*")\]')

    def value(s: str) -> object:
        try:
            return json.loads(s)
        except ValueError:
            return s

    def read(line: str) -> tuple[list, str] | None:
        keys: list = []
        at = 0
        while (m := token.match(line, at)) and not line.startswith(":", at):
            keys.append(m[1] if m[1] is not None else int(m[2]) if m[2] is not None else json.loads(m[3]))
            at = m.end()
        return (keys, line[at + 2 :]) if keys and line.startswith(": ", at) else None

    def build(pairs: list[tuple[list, object]]) -> object:
        if len(pairs) == 1 and not pairs[0][0]:
            return pairs[0][1]
        groups: dict = {}
        for keys, v in pairs:
            groups.setdefault(keys[0], []).append((keys[1:], v))
        if all(isinstance(k, int) for k in groups):
            return [build(groups[k]) for k in sorted(groups)]
        return {k: build(g) for k, g in groups.items()}

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        lines = [x for x in text.split("\n") if x]
        parsed = [read(x) for x in lines]
        if len(lines) == 1 and parsed[0] is None:
            return json.dumps(value(lines[0]), ensure_ascii=False)
        if not lines or None in parsed:
            return None
        return json.dumps(build([(k, value(v)) for k, v in parsed]), ensure_ascii=False)

    @F.pandas_udf("string")
    def back(x: pd.Series) -> pd.Series:
        return x.map(one)

    return rows.withColumn(name, back(column))
