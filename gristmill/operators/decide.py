"""Decisions over structured scenarios: controller policies, tool gates, catalog constraints, rosters, posteriors and their shallow readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import arrays
from gristmill.operators import balance as B

# The controller's actions, in order.
ACTIONS = ("shut_down_the_loop", "escalate_to_duty_engineer", "correct_the_setpoint", "hold_and_watch", "leave_the_loop_alone")
#: Assignments that an instance may have for all to be listed.
MOST = 12_000


def past(value: Column, limit: Column, span: Column, high: bool, integral: bool = False) -> Column:
    """Chance that a reading is beyond a limit; counts have a hard edge."""
    if integral:
        return ((value > limit) if high else (value < limit)).cast("double")
    up = arrays.soft(value, limit, span)
    return up if high else 1 - up


def policy(last: Column, rate: Column, runs: Column, alarm: Column, *, low: Column, high: Column, critical: Column, span: Column, horizon: int, runs_most: int) -> list[Column]:
    """The chance of each of ACTIONS: critical now or within the horizon first, then outside the band, then on the way out."""
    ahead = last + rate * horizon
    either = lambda a, b: 1 - (1 - a) * (1 - b)
    shut = either(past(last, critical, span, True), past(ahead, critical, span, True))
    out = either(past(last, high, span, True), past(last, low, span, False))
    improving = F.when(last > (high + low) / 2, rate < 0).otherwise(rate > 0)
    leaving = F.when(rate > 0, past(ahead, high, span, True)).when(rate < 0, past(ahead, low, span, False)).otherwise(0.0)
    act = F.when(improving, "hold_and_watch").when((runs >= runs_most) | alarm, "escalate_to_duty_engineer").otherwise("correct_the_setpoint")
    rest = 1 - shut
    mass = {"shut_down_the_loop": shut, "leave_the_loop_alone": rest * (1 - out) * (1 - leaving)}
    for name in ("escalate_to_duty_engineer", "correct_the_setpoint", "hold_and_watch"):
        mass[name] = F.when(act == name, rest * out).otherwise(0.0) + (rest * (1 - out) * leaving if name == "hold_and_watch" else F.lit(0.0))
    return [mass[a] for a in ACTIONS]


def undoable(effect: Column, dry_run: Column, reverse: Column, tools: Column, backup: Column, target: Column) -> Column:
    """Whether a call can be taken back: it only reads, is a dry run, has a reverse whose tool is allowed, or a backup covers its target."""
    tool = F.split(F.trim(F.coalesce(reverse, F.lit(""))), r"\s+")[0]
    covered = effect.isin("overwrite", "delete") & F.coalesce(F.startswith(target, backup), F.lit(False))
    return (effect == "read") | dry_run | ((tool != "") & F.array_contains(tools, tool)) | covered


def satisfied(kind: Column, op: Column, value: Column, target: Column, upper: Column, options: Column) -> Column:
    """Whether a catalog entry's value (as text) meets a constraint on a flag, an enumeration or a number."""
    v, t, u = value.try_cast("double"), target.try_cast("double"), upper.try_cast("double")
    eps = 1e-9
    flag = (F.lower(value) == "true") == (op == "need")
    enum = F.when(op == "eq", value == target).when(op == "ne", value != target).otherwise(F.array_contains(options, value))
    number = (
        F.when(op == ">=", v >= t - eps).when(op == "<=", v <= t + eps).when(op == ">", v > t + eps).when(op == "<", v < t - eps)
        .when(op == "eq", F.abs(v - t) < 1e-6).otherwise((v >= t - eps) & (v <= u + eps))
    )
    return F.when(kind == "flag", flag).when(kind == "enum", enum).otherwise(number)


def violations(people: Column, rules: Column, per_day: int) -> Column:
    """Places (from 0) of the rules that a roster breaks.

    people: who works each slot, per_day slots a day; rules: structs (t, p, a, b, k) of max_shifts, min_shifts, rest, one_per_day,
    pair_conflict, handover and buddy.
    """
    slots = F.sequence(F.lit(0), F.size(people) - 1)
    of = lambda who: F.filter(slots, lambda s: F.get(people, s) == who)
    days = lambda who: F.array_distinct(F.transform(of(who), lambda s: F.floor(s / per_day)))
    everyone = F.array_distinct(people)

    def broken(r: Column) -> Column:
        t = r["t"]
        rest = F.exists(slots, lambda s: F.get(people, s) == F.get(people, s + 1))
        crowded = F.exists(everyone, lambda who: F.size(of(who)) > F.size(days(who)))
        late = (F.size(of(r["a"])) > 0) & (F.size(of(r["b"])) > 0) & (F.array_max(of(r["a"])) > F.array_min(of(r["b"])))
        return (
            F.when(t == "max_shifts", F.size(of(r["p"])) > r["k"]).when(t == "min_shifts", F.size(of(r["p"])) < r["k"]).when(t == "rest", rest).when(t == "one_per_day", crowded)
            .when(t == "pair_conflict", F.arrays_overlap(days(r["a"]), days(r["b"]))).when(t == "handover", late).when(t == "buddy", F.size(F.array_except(days(r["a"]), days(r["b"]))) > 0)
        )

    marked = F.transform(rules, lambda r, i: F.when(F.coalesce(broken(r), F.lit(False)), i))
    return F.filter(marked, lambda i: i.isNotNull())


def assignments(instances: DataFrame, allowed: str, slots: int) -> DataFrame:
    """instances with people, one row an assignment of an allowed person to each slot; instances of over MOST assignments are left out.

    allowed: an array of arrays; slots: its length, so rows grow slot by slot within their instance.
    """
    size = F.aggregate(F.col(allowed), F.lit(1).cast("long"), lambda a, x: F.least(a * F.size(x), F.lit(MOST + 1).cast("long")))
    grown = instances.where(size <= MOST).withColumn("people", F.array().cast("array<int>"))
    for s in range(slots):
        grown = grown.withColumn("_who", F.explode(F.col(allowed)[s])).withColumn("people", F.concat("people", F.array("_who"))).drop("_who")
    return grown


def to_outcomes(dist: Column, outcomes: Column) -> Column:
    """A distribution over hypotheses as one over outcomes; outcomes: a row of chances for each hypothesis."""
    rows = F.zip_with(dist, outcomes, lambda w, row: F.transform(row, lambda x: w * x))
    zero = F.transform(F.get(outcomes, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(rows, zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))


def offered(target: Column, keep: Column) -> Column:
    """The outcomes that are offered, in order; null if one that is left out carries mass."""
    lost = F.aggregate(F.transform(target, lambda p, o: F.when(F.array_contains(keep, o.cast("int")), 0.0).otherwise(p)), F.lit(0.0), lambda a, b: a + b)
    return F.when(lost == 0, F.transform(keep, lambda o: F.get(target, o)))


def normalised(mass: Column) -> Column:
    whole = arrays.total(mass)
    return F.when(whole > 0, F.transform(mass, lambda x: x / whole)).otherwise(F.transform(mass, lambda x: 1.0 / F.size(mass)))


def heuristics(prior: Column, likelihoods: Column) -> dict[str, Column]:
    """Shallow readings of a draft: the prior alone, the evidence alone, its last piece alone, and a vote of each piece for what it favours."""
    product = F.aggregate(likelihoods, F.transform(prior, lambda x: F.lit(1.0)), lambda a, row: F.zip_with(a, row, lambda x, y: x * y))

    def vote(row: Column) -> Column:
        best = F.transform(row, lambda x: F.when(x >= F.array_max(row) - 1e-12, 1.0).otherwise(0.0))
        return F.transform(best, lambda x: x / arrays.total(best))

    votes = F.aggregate(F.transform(likelihoods, vote), F.transform(prior, lambda x: F.lit(0.0)), lambda a, row: F.zip_with(a, row, lambda x, y: x + y))
    return {"prior": normalised(prior), "likelihood": normalised(product), "last": normalised(F.element_at(likelihoods, -1)), "majority": normalised(votes)}


def balanced(rows: DataFrame, group: str, key: str, order: str, quota: int) -> DataFrame:
    """(group, key, kept): drafts in order, each kept while its key (a bin, a band or a gold index) has under quota kept in its group."""
    return B.ranked(rows, [group, key], [order]).withColumn("kept", F.col("r") <= quota).select(*rows.columns, "kept")


def leaf(op: str, members: Column, field: str, value: float | None = None, count: int = 1) -> Column:
    """A condition over an array of structs: all, any, none or atleast of them past a value, or an aggregate of a field."""
    over = lambda m: m[field] > value
    numbers = F.transform(members, lambda m: m[field].cast("double"))
    some = F.size(members) > 0
    made = {
        "all": lambda: F.forall(members, over), "any": lambda: F.exists(members, over), "none": lambda: ~F.exists(members, over), "atleast": lambda: F.size(F.filter(members, over)) >= count,
        "count": lambda: F.size(members).cast("double"), "sum": lambda: arrays.total(numbers), "mean": lambda: F.when(some, arrays.total(numbers) / F.size(members)), "min": lambda: F.array_min(numbers), "max": lambda: F.array_max(numbers),
    }
    return made[op]()


def wire_problem(role: Column, kind: Column, options: Column, text: Column, most: int = 64) -> Column:
    """The first field of a wire request that is wrong, as `status field`; null for a good one."""
    checks = [
        (~F.coalesce(kind.isin("noul", "choice", "score"), F.lit(False)), "422 type"), (F.trim(F.coalesce(text, F.lit(""))) == "", "422 question"),
        ((kind != "noul") & (F.coalesce(F.size(options), F.lit(0)) < 2), "422 options"), (F.size(options) > most, "422 options"), (F.size(F.array_distinct(options)) < F.size(options), "422 options"), (~F.coalesce(role.isin("user", "system"), F.lit(False)), "422 role"),
    ]
    return reduce(lambda out, check: F.when(check[0], check[1]).otherwise(out), reversed(checks), F.lit(None).cast("string"))


def packed(rows: DataFrame, key: str, pos: str, state: Column, question: Column, budget: int, mode: str) -> DataFrame:
    """(key, kept, dropped, tokens, verdict) of each example's questions under a token budget.

    drop: trailing questions that don't fit go; truncate: the state gives way; refuse: an example that doesn't fit is refused whole.
    """
    w = Window.partitionBy(key).orderBy(pos)
    running = rows.withColumns({"_state": state, "_cum": F.sum(question).over(w)})
    fits = F.col("_cum") <= budget if mode == "truncate" else F.col("_state") + F.col("_cum") <= budget
    g = running.groupBy(key).agg(F.max("_state").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(fits).alias("kept"), F.coalesce(F.max(F.when(fits, F.col("_cum"))), F.lit(0)).alias("q"))
    whole = F.col("kept") == F.col("n")
    left = F.least(F.col("s"), budget - F.col("q"))
    if mode == "refuse":
        return g.select(key, F.when(whole, F.col("kept")).otherwise(0).cast("long").alias("kept"), F.when(whole, 0).otherwise(F.col("n")).cast("long").alias("dropped"), F.when(whole, F.col("s") + F.col("q")).otherwise(0).cast("long").alias("tokens"), F.when(whole, "ok").otherwise("refused").alias("verdict"))
    used = left + F.col("q") if mode == "truncate" else F.when(F.col("kept") > 0, F.col("s") + F.col("q")).otherwise(0)
    verdict = F.when(F.col("kept") == 0, "refused").when((left < F.col("s")) if mode == "truncate" else F.lit(False), "truncated").when(whole, "ok").otherwise("dropped")
    return g.select(key, F.col("kept"), (F.col("n") - F.col("kept")).alias("dropped"), used.cast("long").alias("tokens"), verdict.alias("verdict"))
