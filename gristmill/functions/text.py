"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token for each ideograph, kana or Thai letter, else runs of letters and digits.
TOKEN = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{0E00}-\x{0E7F}]|[[\p{L}\p{N}]&&[^\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{0E00}-\x{0E7F}]]+"
PLAIN_TOKEN = r"[\p{L}\p{N}]+"
# Ordered vocabularies that make options ordinal.
ORDERED = (
    ("low", "medium", "high"), ("low", "medium", "high", "critical"), ("none", "low", "medium", "high", "critical"),
    ("small", "medium", "large"), ("negative", "neutral", "positive"), ("easy", "medium", "hard"), ("never", "sometimes", "always"),
    ("poor", "fair", "good", "excellent"), ("strongly disagree", "disagree", "neutral", "agree", "strongly agree"),
)


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-cased tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def shingles(words: Column, k: int, short: bool = False) -> Column:
    """Distinct runs of k words; with short, fewer words make one run of all."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")) if short else F.array().cast("array<string>")
    return F.array_distinct(F.when(F.size(words) >= k, runs).otherwise(whole))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, k: int, short: bool = False) -> Column:
    """Hashes of the distinct runs of k words, or hashes of words; no run is put together as a string."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    none = F.array().cast("array<bigint>")
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none) if short else none
    return F.array_distinct(F.when(F.size(words) >= k, runs).otherwise(whole))


def option_norm(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))


def norm(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def snake_case(name: Column) -> Column:
    x = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    x = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"))


def strip_headers(text: Column, labels: tuple[str, ...]) -> Column:
    """Lines that start with one of the labels and a colon go."""
    return F.regexp_replace(text, "(?im)^(" + "|".join(labels) + r")\s*:.*\n?", "")


def skeleton(text: Column, n: int) -> Column:
    """Numbers and hex runs masked, spaces collapsed, cut to n."""
    x = F.regexp_replace(F.lower(text), r"\b[0-9a-f]*[0-9][0-9a-f]*\b", "#")
    return F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, n)


def cut_words(text: Column, limit: int) -> Column:
    """Cut to the limit, back to a word's end if that is past half of it."""
    head = F.substring(text, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when(F.length(text) <= limit, text).when((F.instr(F.reverse(head), " ") > 0) & (at > limit / 2), F.substr(head, F.lit(1), at)).otherwise(head)


def scrub(text: Column, words: list[str], mask: str = "[REDACTED]") -> Column:
    """Words of four letters or more, with or without a plural s, masked, the longest first."""
    stems = sorted({w.lower().rstrip("s") or w.lower() for x in words for w in x.split() if len(w) >= 4}, key=lambda w: (-len(w), w))
    if not stems:
        return text
    return F.regexp_replace(text, "(?i)(?<![A-Za-z0-9])(" + "|".join(stems) + ")s?(?![A-Za-z0-9])", mask)


def scrub_by(text: Column, label: Column, mask: str = "[REDACTED]") -> Column:
    """As scrub, by the words of a column: the pattern is made for each row."""
    words = F.filter(F.split(F.lower(label), r"\s+"), lambda w: F.length(w) >= 4)
    stems = F.transform(words, lambda w: F.coalesce(F.nullif(F.regexp_replace(w, "s+$", ""), F.lit("")), w))
    either = F.array_join(F.transform(F.reverse(F.array_sort(F.array_distinct(stems))), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9])("), either, F.lit(")s?(?![A-Za-z0-9])"))
    return F.when(F.size(stems) > 0, F.regexp_replace(text, pattern, F.lit(mask))).otherwise(text)


def spelled_out(option: Column, state: Column) -> Column:
    """Whether the option stands in the state as whole tokens, whatever its case."""
    padded = lambda x: F.concat(F.lit(" "), F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), F.lit(" "))
    return F.contains(padded(state), padded(F.trim(option)))


def placeholders(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([a-z_]+)\}"), F.lit(1)))


def surface(option: Column) -> Column:
    """numeric, boolean, upper, word, phrase or sentence."""
    words = F.size(F.split(F.trim(option), r"\s+"))
    return (
        F.when(F.regexp_like(option, F.lit(r"^\s*[-+]?[0-9]+(\.[0-9]+)?\s*$")), "numeric").when(F.lower(F.trim(option)).isin("yes", "no", "true", "false"), "boolean")
        .when((F.upper(option) == option) & F.regexp_like(option, F.lit("[A-Z]")), "upper").when(words == 1, "word").when(words <= 5, "phrase").otherwise("sentence")
    )


def alias_key(label: Column) -> Column:
    """Symbols away, tokens sorted."""
    return F.array_join(F.array_sort(tokens(F.regexp_replace(label, r"\p{S}", ""), PLAIN_TOKEN)), " ")


def is_ordinal(options: Column) -> Column:
    """Three options or more that are numbers in steps of one, or an ordered vocabulary."""
    numbers = F.array_sort(F.transform(options, lambda o: o.try_cast("double")))
    steps = F.zip_with(F.slice(numbers, F.lit(2), F.size(numbers)), F.slice(numbers, 1, F.size(numbers) - 1), lambda b, a: b - a)
    contiguous = F.forall(numbers, lambda x: x.isNotNull()) & F.forall(steps, lambda s: s == 1.0)
    low = F.transform(options, lambda o: F.lower(F.trim(o)))
    same = None
    for words in ORDERED:
        known = F.array(*map(F.lit, words))
        hit = (F.size(options) == len(words)) & (F.size(F.array_except(low, known)) == 0)
        same = hit if same is None else same | hit
    return (F.size(options) >= 3) & (F.coalesce(contiguous, F.lit(False)) | same)


def canonical_level(raw: Column) -> Column:
    """Severity names made one; null for unknown ones."""
    # Usual severity names.
    names = {"TRACE": "debug", "DEBUG": "debug", "FINE": "debug", "INFO": "info", "NOTICE": "info", "WARN": "warning", "WARNING": "warning", "ERROR": "error", "ERR": "error", "SEVERE": "error", "FATAL": "fatal", "CRITICAL": "fatal"}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.upper(F.trim(raw)))
