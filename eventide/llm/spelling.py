"""Spelling variants: words one edit apart, found by asymmetric chunks, and the form that each one stands for.

A word of length L gives two disjoint chunks, its halves, each with its place. A single edit of that word leaves one half as it
is: the first at its place, or the second at its place plus the change in length. So the other word, of length L or L + 1, gives
its positional grams of the same lengths at those places, and the two meet by an equality join on (L, half, gram); only the shorter
word of a pair has to give chunks. Spark's own bounded edit distance verifies what meets.

A chunk that very many words share would pair them all. Where a key could give more than ``pairs`` pairs, it is drawn out: the half
in which the edit must lie is halved again, and the key takes in the quarter that stays as it is. That goes on until keys are small
or the edit's place is a single letter; words that then meet agree everywhere else. No pair is lost and none is capped.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import blank_text, settle

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 5, least_count: int = 3, noise: int = 97) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, and how often they occur; one in ``noise`` runs, by its hash, loses a letter."""
    run = F.translate("run", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(blank_text(text), F.lit(RUN), 0)).alias("run"))
    runs = runs.filter(F.char_length("run") >= least_length).select("id", run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _places(words: DataFrame) -> DataFrame:
    """Every part a word has in the join: (word, n, length of the chunk word, more, lo, hi), the edit lying in [lo, hi) of that word.

    ``more`` 0: the word gives its own chunks, which are also its grams for words of its length. ``more`` 1: it gives grams for
    words that are one shorter.
    """
    own = words.withColumn("length", F.char_length("word"))
    both = own.withColumn("more", F.lit(0)).unionByName(own.withColumns({"length": F.col("length") - 1, "more": F.lit(1)}).filter("length > 0"))
    return _halve(both.withColumns({"lo": F.lit(0), "hi": F.col("length")}))


def _halve(places: DataFrame) -> DataFrame:
    middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) / 2).cast("int")
    whole = places.filter("hi - lo > 1").withColumn("_window", F.explode(F.array(
        F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))))
    return whole.withColumns({"lo": F.col("_window.lo"), "hi": F.col("_window.hi")}).drop("_window")


def _key() -> Column:
    """Hash of what lies outside the window; a longer word's window is longer by one. Chunks and grams meet where this is equal."""
    return F.xxhash64(F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.col("hi") + F.col("more") + 1, F.char_length("word")))


def near_words(words: DataFrame, pairs: int = 20_000) -> DataFrame:
    """(a, b): all pairs of different words one edit apart, each once, from rows (word, n) of distinct words."""
    places, found = _places(words.select("word")), []
    while True:
        # a written step: lineage stays short, and the join below is planned from its size
        places = settle(places.withColumn("key", _key()), "places")
        if places.isEmpty():
            break
        shares = places.groupBy("length", "lo", "hi", "key").agg(F.sum(1 - F.col("more")).alias("short"), F.sum("more").alias("long"))
        shares = settle(shares.filter("short > 0 and short + long > 1").withColumn(
            "apart", (F.col("short") * (F.col("short") + F.col("long")) > pairs) & (F.col("hi") - F.col("lo") > 1)), "shares")
        on = ["length", "lo", "hi", "key"]
        ready = places.join(shares.filter("not apart").select(*on), on)
        chunks = ready.filter("more = 0").select(*on, F.col("word").alias("a"))
        grams = ready.select(*on, "more", F.col("word").alias("b"))
        met = chunks.join(grams, on).filter((F.col("more") == 1) | (F.col("a") < F.col("b"))).filter(F.levenshtein("a", "b", 1) == 1)
        found.append(settle(met.select("a", "b"), "near"))
        places = _halve(places.join(shares.filter("apart").select(*on), on).drop("key"))
    if not found:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def forms(words: DataFrame, near: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near). The form is the near word of largest n (ties: least), where that is at least twice the word's."""
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other")))
    known = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = known.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w"))).alias("best"))
    taken = -F.col("best.n") >= 2 * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.when(taken, F.col("best.w")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) for words with a form: forms are followed to the last.

    Words at one step from a root are named first, then those at two, and so on. n at least doubles with each step, so there are
    few; and a join key is a word's direct form, which has no more words than lie one edit from it.
    """
    waiting = settle(formed.filter("form is not null").select("word", "form"), "forms")
    named, last = [], formed.filter("form is null").select(F.col("word").alias("form"), F.col("word").alias("root"))
    while True:
        last = settle(waiting.join(last, "form").select("word", "root"), "roots")
        if last.isEmpty():
            break
        named.append(last)
        last = last.withColumnRenamed("word", "form")
    return reduce(DataFrame.unionByName, named) if named else waiting.withColumnRenamed("form", "root")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", pairs: int = 20_000, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``.

    Null texts have no words; a null id counts as an empty one; repeated rows count each; an empty table gives an empty result; other
    columns do not matter. Words may be of any length. For ``options`` see ``noisy_words``.
    """
    words = settle(noisy_words(docs, text, doc_id, **options), "words")
    formed = settle(forms(words, near_words(words, pairs)), "formed")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
