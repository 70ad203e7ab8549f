"""Quality rules from cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, runs of white space as one space, trimmed) and hashed. For each host (the
source), the documents that hold a line are counted, each once however often it holds it. A line is too frequent when more than
max(min_docs, share * documents of the host) documents of its host hold it; such lines are removed. A document
is rejected when a base rule fails, or when what is left is under min_words words or under min_left of its words.
With copies_once, documents of one text count as one: for a step that removes copies afterwards, and must not lose the last.

Defined results: a null text has no words and fails the base rules; null hosts form one host; rows are
documents of their own, and each gets the result of its text. A document without frequent lines is never depleted.

The text is parsed once, into a narrow table (counts and line hashes) in the shared folder. Counting shuffles
8-byte hashes, combined before the shuffle; the join back is salted, so a line that a third of all documents
hold is dealt to `salts` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import WORD, let, named_rows, stored, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def line_keys(text: Column) -> Column:
    """Normalised lines of a text, those without a word included as ''."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words found twice or more, from the word hashes."""

    def covered(pairs: Column) -> Column:
        found = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
        gap = lambda starts: F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(let(F.sort_array(F.transform(found, lambda x: x["i"])), gap), F.lit(0).cast("long"), lambda a, x: a + x)

    def count(windows: Column) -> Column:
        twice = F.size(F.array_distinct(windows)) < F.size(windows)
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(twice, let(pairs, covered)).otherwise(F.lit(0).cast("long"))

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.when(F.size(h) > WINDOW, let(F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])), count)).otherwise(F.lit(0).cast("long"))

    return let(hashes, windows)


def _repeats(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(lines, lambda x: x.rlike(WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def base_counts(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """keep, and the base counts and line hashes of each row."""
    whole = F.coalesce(text, F.lit(""))
    split = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"),
            _repeat_words(F.transform(w, lambda x: F.xxhash64(x))).alias("again"),
        ),
    )
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return df.select(
        *keep,
        F.xxhash64(whole).alias("text_key"),
        split.alias("__c"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _repeats(F.split(whole, "\n", -1)).alias("n_dup_lines"),
        F.transform(F.filter(line_keys(text), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), (spaces(x) + 1).alias("n"))).alias("lines"),
    ).select("*", F.col("__c.n").alias("n_words"), F.col("__c.chars").alias("word_chars"), F.col("__c.again").alias("n_repeat_words")).drop("__c")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *,
    min_docs: int = 5, share: float = 0.05, min_words: int = 10, min_left: float = 0.3, salts: int = 32, copies_once: bool = False, keep_rows: bool = False,
) -> DataFrame:
    """The counts and the verdict for each row of docs.

    With keep_rows, each result also has the struct `row` (all columns of docs, whatever their names) and
    `clean_text`, the text without its frequent lines.
    """
    docs, name = named_rows(docs)
    keep = [name.alias("rid"), docs[id_col].alias("doc_id"), docs[host_col].alias("host")]
    table, _ = stored(base_counts(docs, docs[text_col], keep), "lines")
    many = F.count_distinct("text_key") if copies_once else F.count("*")
    hosts = table.groupBy("host").agg(many.alias("host_docs"))
    held = table.select("host", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = held.groupBy("host", "h").agg(many.alias("n")).where(F.col("n") > min_docs)
    frequent = (
        counts.alias("c").join(hosts.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
        .where(F.col("n") > F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("host_docs")))
        .select(F.col("c.host").alias("host"), "h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    dealt = table.select("rid", "host", F.pmod("rid.row", F.lit(salts)).cast("int").alias("salt"), F.explode("lines").alias("x")).select("rid", "host", "salt", "x.h", "x.n")
    cut = (
        dealt.alias("d")
        .join(frequent.alias("f"), (F.col("d.h") == F.col("f.h")) & (F.col("d.salt") == F.col("f.salt")) & F.col("d.host").eqNullSafe(F.col("f.host")))
        .groupBy(F.col("d.rid").alias("rid"))
        .agg(F.count("*").alias("n_frequent_lines"), F.sum("d.n").alias("cut"), *([F.collect_set("d.h").alias("cut_lines")] if keep_rows else []))
    )
    left = F.col("n_words") - F.coalesce("cut", F.lit(0))
    out = (
        table.drop("lines", "text_key").join(cut, "rid", "left")
        .withColumn("n_words_left", left)
        .withColumn("n_frequent_lines", F.coalesce("n_frequent_lines", F.lit(0)))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("depleted", (F.col("n_frequent_lines") > 0) & ((left < min_words) | (left < min_left * F.col("n_words"))))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_lines", "n_words_left"]
    if not keep_rows:
        return out.select(*columns)
    text = F.col("row").getField(text_col)
    keys = line_keys(text)
    raw = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    out = out.join(docs.select(name.alias("rid"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).hint("merge"), "rid")
    clean = let(
        F.struct(keys.alias("k"), F.col("cut_lines").alias("cut")),
        lambda s: F.array_join(F.filter(raw, lambda x, i: ~F.array_contains(s["cut"], F.xxhash64(F.get(s["k"], i)))), "\n"),
    )
    return out.withColumn("clean_text", F.when(F.col("n_frequent_lines") > 0, clean).otherwise(text)).select(*columns, "clean_text", "row")
