"""License scan by ordered signature rules, in DataFrame functions only; no shuffle.

The rules (llm.signatures) are hand-written patterns over lower-case words joined by single spaces, in order of
priority. Two prefilters, both implied by the rules, so that they lose nothing: a text is scanned where it holds a gate of some
rule, and a rule is tried in a block of words where the block holds the rule's keyword. A rule detects at every
word at which its pattern matches, its longest-first alternatives tried in the order written. A detection is dropped
when the interval of words of a detection by an earlier rule contains its own.

Words are scanned in blocks of BLOCK with REACH words around them; no match with its context is longer than REACH / 2, so
blocks give what the whole text would, and a text costs in proportion to its length.

Defined results: a null text has no words; labels of a text without detections are empty strings, first_word and
last_word are null and score is 0. The base phrases are found beside the rules and always count. Names that are words of
other languages (mit, isc) count only after wording of a license.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm import signatures
from keytide.llm.common import let

#: What separates words, with upper-case letters still in words, and the three base phrases.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BLOCK = 1024
REACH = 256


def anywhere(rule: tuple) -> str:
    """The rule's pattern as a place in words, before each word at which it matches; group 1 is the match."""
    context = f"(?<=(?: |^){signatures.expanded(rule[4])})" if len(rule) > 4 else ""
    return f"(?<= )(?=((?:{signatures.expanded(rule[3])})(?= ))){context}"


def _gate(text: Column) -> Column:
    """Whether a text, in any case, holds a gate of some rule or of a base phrase; gates of two words and short ones from the start of a word."""
    gates = sorted({g for r in signatures.RULES for g in signatures.gates(r)} | {"licen"})
    apart = [g for g in gates if " " in g or len(g) < 4 and g not in ("gpl", "bsd", "cc0")]
    held = F.lit(False)
    for g in gates:
        if g not in apart:
            held = held | F.contains(text, F.lit(g))
    return held | text.rlike(f"(?<![a-z0-9])(?:{'|'.join(g.replace(' ', '[^a-z0-9]+') for g in apart)})")


def _detections() -> str:
    """SQL for the detections in block b (from, low, high, text): those that start in low..high, the ones inside an earlier rule's dropped."""
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    by_word: dict[str, list[str]] = {}
    for order, rule in enumerate(signatures.RULES):
        label, score, keyword = rule[:3]
        place = anywhere(rule)
        before = f"concat_ws('', slice(split(b.text, r'{place.replace('((?:', '(?:(?:')}', -1), 1, k + 1))"
        start = f"b.from + {spaces(before)} - 1"
        one = f"transform(regexp_extract_all(b.text, r'{place}', 1), (m, k) -> named_struct('order', {order}, 'label', '{label}', 'score', {score}D, 'start', int({start}), 'n', int({spaces('m')}) + 1))"
        # rules that share the first word of their keyword are skipped together
        by_word.setdefault(keyword.split()[0], []).append(f"CASE WHEN contains(b.text, '{keyword}') THEN {one} END")
    groups = ", ".join(f"CASE WHEN contains(b.text, '{word}') THEN flatten(filter(array({', '.join(rules)}), r -> r IS NOT NULL)) END" for word, rules in by_word.items())
    clear = "filter(x, d -> d.start >= b.low AND d.start < b.high AND NOT exists(x, e -> e.order < d.order AND e.start <= d.start AND e.start + e.n >= d.start + d.n))"
    found = f"transform(array(flatten(filter(array({groups}), g -> g IS NOT NULL))), x -> {clear})[0]"
    return f"transform({found}, d -> named_struct('order', d.order, 'label', d.label, 'score', d.score, 'start', d.start, 'end', d.start + d.n))"


def lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _count(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    ends = F.when(whole.rlike("^" + SEPARATORS), 1).otherwise(0) + F.when(whole.rlike(SEPARATORS + r"\z"), 1).otherwise(0)
    return F.when(~whole.rlike(WORD), F.lit(0)).otherwise(F.size(F.split(whole, SEPARATORS, -1)) - ends).cast("long")


def _blocks(words: Column) -> Column:
    """(from, low, high, text) of each block of words: words low..high are its own, text starts at word `from`."""

    def block(k: Column) -> Column:
        low = k * BLOCK
        start = F.greatest(F.lit(0), low - REACH)
        joined = F.array_join(F.slice(words, start + 1, low - start + F.lit(BLOCK + REACH)), " ")
        return F.struct(start.alias("from"), low.alias("low"), (low + BLOCK).alias("high"), F.concat(F.lit(" "), joined, F.lit(" ")).alias("text"))

    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / BLOCK).cast("int")), block)).otherwise(F.array().cast("array<struct<from:int,low:int,high:int,text:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and detections (label, start, end, score)."""
    phrases = [(p.split(" "), label) for p, label in BASE]

    def base(w: Column) -> Column:
        """(start, label) of each base phrase, found at its last word."""

        def at(x: Column, i: Column) -> Column:
            found = F.when(F.lit(False), F.struct(i.alias("start"), F.lit("").alias("label")))
            for phrase, label in phrases:
                n = len(phrase)
                same = (x == phrase[-1]) & (i >= n - 1)
                for k, part in enumerate(phrase[:-1]):
                    same = same & (F.get(w, i - (n - 1 - k)) == part)
                found = found.when(same, F.struct((i - (n - 1)).alias("start"), F.lit(label).alias("label")))
            return found

        return F.filter(F.transform(w, at), lambda x: x.isNotNull())

    text = F.coalesce(docs[text_col], F.lit(""))
    words = F.array_remove(F.split(lower(text), SEPARATORS), "")
    narrowed = F.when(_gate(F.lower(text)), let(words, lambda w: F.struct(base(w).alias("base"), _blocks(w).alias("blocks"))))
    parts = docs.select(docs[id_col].alias("doc_id"), _count(docs[text_col]).alias("n_words"), narrowed.alias("__f"))
    rules = F.expr(f"flatten(transform(__f.blocks, b -> {_detections()}))")
    parts = parts.select("doc_id", "n_words", F.col("__f.base").alias("__b"), F.when(F.col("__f").isNotNull(), rules).alias("__r"))
    none = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.transform("__b", lambda x: x["label"]), none)))
    all_labels = F.array_sort(F.array_union(F.coalesce(F.transform("__b", lambda x: x["label"]), none), F.coalesce(F.transform("__r", lambda x: x["label"]), none)))
    n_base = F.coalesce(F.size("__b"), F.lit(0))
    n_base = F.when(F.col("__b").isNull(), 0).otherwise(n_base).cast("long")
    score = F.greatest(F.coalesce(F.array_max(F.transform("__r", lambda x: x["score"])), F.lit(0.0)), F.when(n_base > 0, 0.6).otherwise(0.0))
    return parts.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min(F.transform("__b", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("__b", lambda x: x["start"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), score.cast("double").alias("score"),
        F.transform("__r", lambda x: F.struct(x["label"], x["start"], x["end"], x["score"])).alias("detections"),
    )
