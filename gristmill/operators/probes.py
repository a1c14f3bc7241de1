"""Robustness probes: inserted identifiers, look-ups among many options, options from other tasks, and scores in shards or shortlists."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import arrays, hashing, text
from gristmill.operators import evaluate

# Wording that may ask about what an inserted identifier changes, keys that hold identifiers, and names for new ones.
RISKY = (
    r"(?i)how many|number of|\bcount|\bfield|\bkeys?\b|\blines?\b|identifier|\bids?\b|uuid|attribute|length|longest|shortest|\bwords?\b|character|"
    r"token|format|json|schema|propert|column|duplicate|same record|\bhash|checksum|random|nonce"
)
ID_KEY = r"(?i)^(id|uuid|guid|.+_id)$"
NONCE_KEYS = ("trace_id", "request_id", "uuid", "correlation_id", "event_uuid", "nonce_id")
NONCE_LABELS = ("id", "ref", "request-id", "trace id", "msg-id")


def uuid4(key: Column) -> Column:
    """A version 4 UUID made of a key's digest."""
    h = F.sha2(key, 256)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (hashing.digest_mod(F.concat(key, F.lit(":v")), 4) + 1).cast("int"))
    part = lambda start, n: F.substring(h, start, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def nonce_safe(question: Column) -> Column:
    """Whether a question's whole wording (options and criteria included) asks nothing that an identifier could change; null: safe."""
    return ~F.regexp_like(F.coalesce(question, F.lit("")), F.lit(RISKY))


def nonce_line(state: Column, key: Column, seed: int = 0) -> Column:
    """The state with a line such as `ref: <uuid>` as a paragraph of its own, at a drawn place; null for JSON and null states."""
    k = F.concat(F.lit(f"{seed}:"), key)
    paragraphs = F.split(state, "\n\n", -1)
    place = hashing.digest_mod(F.concat(k, F.lit(":place")), F.size(paragraphs) + 1).cast("int")
    label = F.element_at(F.array(*map(F.lit, NONCE_LABELS)), (hashing.digest_mod(F.concat(k, F.lit(":label")), len(NONCE_LABELS)) + 1).cast("int"))
    line = F.concat(label, F.lit(": "), uuid4(k))
    made = F.concat(F.slice(paragraphs, F.lit(1), place), F.array(line), F.slice(paragraphs, place + 1, F.size(paragraphs)))
    return F.when(~F.regexp_like(state, F.lit(r"^\s*[{\[]")), F.array_join(made, "\n\n"))


def _draw(key: str, what: str, n: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{key}:{what}".encode()).digest()[:8], "big") % n


def _style(body: str) -> tuple[dict, dict] | None:
    """An object and the way of writing that gives back these very characters."""
    try:
        made = json.loads(body)
    except (ValueError, RecursionError):
        return None
    if not isinstance(made, dict):
        return None
    ways = [{"indent": i, "ensure_ascii": a} for i in (None, 1, 2, 3, 4, "\t") for a in (False, True)]
    ways += [{"separators": (",", ":"), "ensure_ascii": a} for a in (False, True)]
    return next(((made, w) for w in ways if json.dumps(made, **w) == body), None)


def _places(node: object) -> list[tuple[dict, str]]:
    """Every object and key with an identifier's name and a text or whole number, in the order written."""
    found, rest = [], [node]
    while rest:
        at = rest.pop()
        if isinstance(at, dict):
            found += [(at, k) for k, v in at.items() if re.match(ID_KEY, k) and isinstance(v, str | int) and not isinstance(v, bool) and str(v).strip()]
        if isinstance(at, dict | list):
            rest += reversed(list(at.values() if isinstance(at, dict) else at))
    return found


def _uuid(key: str) -> str:
    h = hashlib.sha256(key.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-4{h[13:16]}-{'89ab'[_draw(key, 'v', 4)]}{h[17:20]}-{h[20:32]}"


def _json_variants(state: str | None, asked: str, key: str) -> dict:
    out = {"json_key": None, "id_replace": None}
    body = (state or "").strip()
    style = _style(body) if body.startswith("{") else None
    if style is None:
        return out
    made, way = style
    before = state.index("{")
    wrap = lambda o: state[:before] + json.dumps(o, **way) + state[before + len(body) :]
    free = [k for k in NONCE_KEYS if k not in made]
    if free:
        items = list(made.items())
        items.insert(_draw(key, "place", len(items) + 1), (free[_draw(key, "label", len(free))], _uuid(key)))
        out["json_key"] = wrap(dict(items))
    once = lambda v: len(re.findall(rf"(?<![\w-]){re.escape(v)}(?![\w-])", state)) == 1
    safe = [(at, k) for at, k in _places(made) if once(str(at[k])) and str(at[k]) not in asked]
    if safe:
        at, k = safe[_draw(key, "id", len(safe))]
        at[k] = _uuid(key)
        out["id_replace"] = wrap(made)
    return out


@F.arrow_udf(T.StructType([T.StructField("json_key", T.StringType()), T.StructField("id_replace", T.StringType())]))
def nonce_json(state: pa.Array, asked: pa.Array, key: pa.Array) -> pa.Array:
    """A JSON object's text with a new identifier, and with one of its own replaced that occurs once and in no question; else null.

    All other characters stay as they are, which needs the object's text written anew in its own style: a step that only Python does.
    """
    rows = zip(state.to_pylist(), asked.to_pylist(), key.to_pylist())
    return pa.array([_json_variants(s, a or "", f"0:{k}") for s, a, k in rows], pa.struct([("json_key", pa.string()), ("id_replace", pa.string())]))


def nonce_variants(rows: DataFrame, key: str, state: str, question: str) -> DataFrame:
    """(key, kind, state): every safe insertion of each row; none where the question's wording is risky."""
    k, q = F.col(key).cast("string"), F.col(question)
    j = nonce_json(F.col(state), q, k)
    made = rows.where(nonce_safe(q)).select(F.col(key), nonce_line(F.col(state), k).alias("_line"), j.alias("_json"))
    kinds = F.array(
        F.struct(F.lit("text_line").alias("kind"), F.col("_line").alias("state")), F.struct(F.lit("json_key").alias("kind"), F.col("_json.json_key").alias("state")),
        F.struct(F.lit("id_replace").alias("kind"), F.col("_json.id_replace").alias("state")),
    )
    return made.select(key, F.explode(F.filter(kinds, lambda s: s["state"].isNotNull())).alias("_v")).select(key, "_v.kind", "_v.state")


def nonce_summary(rows: DataFrame, kind: str, base: str, other: str) -> DataFrame:
    """kind (null: all), n, mean and largest change of a log probability, mean total variation and share of flips, of log probability arrays."""
    b, o = F.col(base), F.col(other)
    change = F.zip_with(b, o, lambda x, y: F.abs(x - y))
    each = rows.where(b.isNotNull() & o.isNotNull()).select(
        F.col(kind).alias("kind"), (arrays.total(change) / F.size(change)).alias("mean"), F.array_max(change).alias("most"),
        (0.5 * arrays.total(F.zip_with(b, o, lambda x, y: F.abs(F.exp(x) - F.exp(y))))).alias("tv"), (arrays.argmax(b) != arrays.argmax(o)).cast("double").alias("flip"),
    )
    return each.rollup("kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean_abs_dlogp"), F.max("most").alias("max_abs_dlogp"), F.avg("tv").alias("mean_tv"), F.avg("flip").alias("flip_rate")
    )


def _dealt(last: Column, n: Column, key: Column, what: str) -> Column:
    """n distinct whole numbers from 1 to `last`, those of the lowest digests, in that order."""
    ranked = F.transform(F.sequence(F.lit(1).cast("long"), last), lambda i: F.struct(F.sha1(F.concat_ws(":", key, F.lit(what), i.cast("string"))).alias("h"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(ranked), F.lit(1), n), lambda s: s["i"])


def lookups(spark: SparkSession, sizes: tuple[int, ...] = (2, 4, 8, 16, 32, 64, 128, 256), reps: int = 10, seed: int = 0) -> DataFrame:
    """(n, rep, state, question, options, target): an item to find by its bin among n; at most 1,000 options."""
    if max(sizes) > 1000:
        raise ValueError("a look-up has at most 1,000 options")
    base = spark.range(len(sizes) * reps).select(F.element_at(F.array(*map(F.lit, sizes)), (F.floor(F.col("id") / reps) + 1).cast("int")).cast("int").alias("n"), (F.col("id") % reps).alias("rep"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("n").cast("string"), F.col("rep").cast("string"))
    names = F.transform(_dealt(F.lit(1000).cast("long"), F.col("n"), key, "name"), lambda i: F.concat(F.lit("item-"), F.lpad(i.cast("string"), 4, "0")))
    made = base.withColumns({"names": names, "bins": _dealt(F.greatest(10 * F.col("n"), F.lit(100)).cast("long") - 1, F.col("n"), key, "bin")})
    made = made.withColumns({"asked": (hashing.digest_mod(F.concat(key, F.lit(":asked")), F.col("n")) + 1).cast("int"), "order": _dealt(F.col("n").cast("long"), F.col("n"), key, "order")})
    lines = F.zip_with("names", "bins", lambda a, b: F.concat(a, F.lit(": bin "), b.cast("string")))
    return made.select(
        "n", "rep", F.concat(F.lit("Items and their bins\n"), F.array_join(lines, "\n")).alias("state"), F.concat(F.lit("Which item is in bin "), F.element_at("bins", F.col("asked")).cast("string"), F.lit("?")).alias("question"),
        F.transform("order", lambda i: F.element_at("names", i.cast("int"))).alias("options"), (F.array_position("order", F.col("asked").cast("long")) - 1).cast("long").alias("target"),
    )


def lookup_summary(scored: DataFrame) -> DataFrame:
    """By n: chance, rows, those that fit, and their acc, ece, mean_p_correct and mean_maxp; null without any that fits.

    scored is a dump (n, probs, target, confidence, correct) with fits; what doesn't fit has null probs.
    """
    p = F.element_at("probs", (F.col("target") + 1).cast("int"))
    fit = scored.where(F.col("fits") & F.col("probs").isNotNull())
    means = fit.groupBy("n").agg(F.count(F.lit(1)).alias("n_fit"), F.avg("correct").alias("acc"), F.avg(p).alias("mean_p_correct"), F.avg("confidence").alias("mean_maxp"))
    every = scored.groupBy("n").agg(F.count(F.lit(1)).alias("n_generated")).withColumn("chance", 1 / F.col("n"))
    return every.join(means, "n", "left").join(evaluate.ece(fit.withColumnRenamed("n", "_options"), ["_options"]).select(F.col("_options").alias("n"), "ece"), "n", "left").fillna(0, ["n_fit"])


def shape(option: Column) -> Column:
    """The kind of text that an option is, as text.surface has it; options of other tasks only replace those of their own kind."""
    return text.surface(option)


def churned(rows: DataFrame, key: str, fillers: DataFrame, seed: int = 0) -> DataFrame:
    """rows with options and probs after `drop` wrong options went and `add` options of other tasks came, in digest order.

    rows need options, probs, drop and add, and may have sentinel (index of an option that stays).  Only options without mass go,
    one of them and three options stay.  fillers is a table (option) of any size; those equal to an own option but for case don't
    count, and with fewer than `add` others of the first option's shape none comes.  Questions without probs or under three options
    stay as they are.  A question meets as many consecutive numbers of its shape as it can need, by an equi-join.
    """
    pool = fillers.select("option").where(F.col("option").isNotNull()).groupBy(F.lower("option").alias("_low")).agg(F.min("option").alias("_option")).withColumn("_shape", shape(F.col("_option")))
    sizes = pool.groupBy("_shape").agg(F.count(F.lit(1)).alias("_size"))
    # a number for each filler of a shape: its rank in its part of the digests, after all parts before; no window holds a whole shape
    pool = pool.withColumn("_part", hashing.digest_mod(F.col("_low"), 1024))
    # and with six shapes neither table of sizes has over 6,144 rows
    parts = pool.groupBy("_shape", "_part").agg(F.count(F.lit(1)).alias("_in")).withColumn("_before", F.expr("sum(_in) OVER (PARTITION BY _shape ORDER BY _part) - _in"))
    ranked = pool.withColumn("_r", F.expr("row_number() OVER (PARTITION BY _shape, _part ORDER BY sha2(_low, 256), _low) - 1"))
    numbered = ranked.join(F.broadcast(parts), ["_shape", "_part"]).select("_shape", "_option", "_low", (F.col("_before") + F.col("_r")).alias("_number"))

    k = F.concat(F.lit(f"{seed}:"), F.col(f"_row.{key}").cast("string"))
    options, probs = F.col("_row.options"), F.col("_row.probs")
    stays = F.col("_row.sentinel") if "sentinel" in rows.columns else F.lit(None).cast("long")
    n = F.size(options)
    best = arrays.argmax(probs)
    spare = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i != best) & ~F.coalesce(i == stays, F.lit(False)) & (F.element_at(probs, i + 1) <= 1e-9))
    most = F.greatest(F.least(F.col("_row.drop"), F.size(spare) - 1, n - 3), F.lit(0))
    by_digest = F.array_sort(F.transform(spare, lambda i: F.struct(hashing.hash_order(seed, k, F.lit("drop"), i.cast("string")).alias("h"), i.alias("i"))))
    gone = F.transform(F.slice(by_digest, F.lit(1), most.cast("int")), lambda s: s["i"])
    able = F.coalesce((n >= 3) & probs.isNotNull(), F.lit(False))
    base = rows.select(F.struct(*rows.columns).alias("_row")).select("_row", able.alias("_able"), F.when(able, gone).alias("_gone"), F.when(able & (F.col("_row.add") > 0), shape(options[0])).alias("_shape"))
    base = base.join(F.broadcast(sizes), "_shape", "left").withColumn("_id", F.sha2(F.to_json(F.struct("_row")), 256))  # the same wherever it is made; equal rows are one

    wanted = F.least(F.col("_size"), n + F.col("_row.add"))
    start = hashing.digest_mod(F.concat(k, F.lit(":fill")), F.col("_size"))
    asks = base.where(F.col("_size") > 0).select("_id", "_shape", "_size", wanted.alias("_wanted"), start.alias("_start"), F.transform(options, F.lower).alias("_own"), F.col("_row.add").alias("_add")).dropDuplicates(["_id"])
    steps = asks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_wanted").cast("long") - 1)).alias("_step")).withColumn("_number", (F.col("_start") + F.col("_step")) % F.col("_size"))
    met = steps.join(numbered, ["_shape", "_number"]).where(~F.array_contains("_own", F.col("_low")))
    came = met.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_step", "_option"))).alias("_met"), F.first("_add").alias("_add"))
    came = came.where(F.size("_met") >= F.col("_add")).select("_id", F.expr("transform(slice(_met, 1, CAST(_add AS INT)), s -> s._option)").alias("_came"))

    joined = base.join(came, "_id", "left").withColumn("_came", F.coalesce("_came", F.array().cast("array<string>")))
    kept = F.filter(F.zip_with(options, probs, lambda o, p: F.struct(o.alias("o"), p.cast("double").alias("p"))), lambda s, i: ~F.array_contains("_gone", i))
    pairs = F.concat(kept, F.transform("_came", lambda o: F.struct(o.alias("o"), F.lit(0.0).alias("p"))))
    dealt = F.array_sort(F.transform(pairs, lambda s: F.struct(hashing.hash_order(seed, k, F.lit("order"), s["o"]).alias("h"), s["o"].alias("o"), s["p"].alias("p"))))
    changed = F.col("_able") & ((F.size("_gone") > 0) | (F.size("_came") > 0))
    made = joined.withColumn("_dealt", F.when(changed, dealt))
    mass = arrays.total(F.transform("_dealt", lambda s: s["p"]))
    new = {
        "options": F.when(changed, F.transform("_dealt", lambda s: s["o"])).otherwise(options),
        "probs": F.when(changed, F.transform("_dealt", lambda s: F.when(mass > 0, s["p"] / mass).otherwise(s["p"]))).otherwise(probs),
    }
    return made.select(*(new[c].alias(c) if c in new else F.col(f"_row.{c}").alias(c) for c in rows.columns))


def shards(lengths: Column, head: Column, budget: int) -> Column:
    """The shard, from 0, of each option: in order, as many as fit beside the head; null if one alone doesn't fit or there is none."""
    start = F.struct(F.array().cast("array<int>").alias("at"), head.cast("long").alias("used"), F.lit(0).alias("now"))

    def step(done: Column, x: Column) -> Column:
        full = (F.size(done["at"]) > 0) & (done["used"] + x > budget)
        now = F.when(full, done["now"] + 1).otherwise(done["now"])
        used = F.when(full, head + x).otherwise(done["used"] + x)
        return F.struct(F.concat(done["at"], F.array(now)).alias("at"), used.cast("long").alias("used"), now.alias("now"))

    return F.when((F.size(lengths) > 0) & (F.array_max(lengths) + head <= budget), F.aggregate(lengths, start, step, lambda s: s["at"]))


def over_shards(options: DataFrame, key: str, shard: str, logit: str) -> DataFrame:
    """options with p, the softmax over all options of a question whose logits come by shard: each shard gives a maximum and a sum only."""
    top = F.max(logit)
    part = options.groupBy(key, shard).agg(top.alias("_top"), F.collect_list(logit).alias("_all")).select(key, "_top", F.expr("aggregate(_all, 0D, (a, x) -> a + exp(x - _top))").alias("_sum"))
    whole = part.groupBy(key).agg(F.max("_top").alias("_most"), F.collect_list(F.struct("_top", "_sum")).alias("_parts"))
    lse = whole.select(key, (F.col("_most") + F.log(F.expr("aggregate(_parts, 0D, (a, s) -> a + s._sum * exp(s._top - _most))"))).alias("_lse"))
    return options.join(lse, key).withColumn("p", F.exp(F.col(logit) - F.col("_lse"))).drop("_lse")


def shortlist_mix(logits: Column, deltas: Column, top: int) -> Column:
    """Logits with the `top` best (ties to the first) moved by their deltas, so that the shortlist's mass and all outside stay."""
    ranked = F.sort_array(F.transform(logits, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    best = F.transform(F.slice(ranked, 1, top), lambda s: s["i"])
    inside = lambda x: F.filter(x, lambda v, i: F.array_contains(best, i))
    lse = lambda x: F.array_max(x) + F.log(arrays.total(F.transform(x, lambda v: F.exp(v - F.array_max(x)))))
    moved = F.zip_with(logits, deltas, lambda a, b: a + b)
    shift = lse(inside(moved)) - lse(inside(logits))
    return F.transform(logits, lambda v, i: F.when(F.array_contains(best, i), F.element_at(moved, i + 1) - shift).otherwise(v))


def criteria_for(questions: DataFrame, key: str, task: str, options: str, criteria: DataFrame) -> DataFrame:
    """questions with criteria, a text or null for each option in order; null where the task has none of them.

    criteria is (task_prefix, option, text), one text a pair; a prefix is the whole task or ends at one of its underscores, and the
    longest that has any text for the options counts.  key is distinct.
    """
    cuts = F.expr(f"transform(filter(sequence(1, greatest(length({task}), 1)), i -> i = length({task}) OR substring({task}, i, 1) = '_'), i -> substring({task}, 1, i))")
    asked = questions.select(F.col(key).alias("_key"), cuts.alias("_cuts"), F.posexplode(options).alias("_at", "option"))
    found = asked.withColumn("task_prefix", F.explode("_cuts")).join(criteria.select("task_prefix", "option", "text").where(F.col("text").isNotNull()), ["task_prefix", "option"])
    texts = found.groupBy("_key", "task_prefix").agg(F.map_from_entries(F.collect_list(F.struct("_at", "text"))).alias("_texts"))
    longest = texts.groupBy("_key").agg(F.max_by("_texts", F.length("task_prefix")).alias("_texts"))
    row = questions.select(F.struct(*questions.columns).alias("_row")).join(longest, F.col(f"_row.{key}") == F.col("_key"), "left")
    made = F.when(F.col("_texts").isNotNull(), F.transform(F.col(f"_row.{options}"), lambda o, i: F.try_element_at("_texts", i)))
    return row.select("_row.*", made.alias("criteria"))


@F.arrow_udf(T.StringType())
def render_state(wire: pa.Array) -> pa.Array:
    """A state's JSON text as a model reads it: a string as it is, an object or array indented by two with its keys in order; else null."""
    def one(s: str | None) -> str | None:
        try:
            made = json.loads(s) if s is not None else None
        except (ValueError, RecursionError):
            return None
        return made if isinstance(made, str) else json.dumps(made, indent=2, ensure_ascii=False) if isinstance(made, dict | list) else None

    return pa.array([one(s) for s in wire.to_pylist()], pa.string())
