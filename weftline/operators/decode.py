"""Greedy and beam decoding of sequences over a table of next-word probabilities, or a scorer of whole prefixes."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.text import END, START
from weftline.plans.lineage import materialise


class Scorer(Protocol):
    """Next words of rows by all that is known of them, in place of a table."""

    columns: list[str]  #: of the inputs, which it looks at

    def __call__(self, live: DataFrame, width: int) -> DataFrame:
        """live (its columns, begun: the word to begin after, words: those since) with next, prob and r: a row for each
        of the width likeliest next words, r = 1 being the likeliest, of equal ones any that is always the same."""


def bigram_scorer(texts: DataFrame, words: str, context: str | None = None) -> DataFrame:
    """(prev, next, prob): relative frequencies of the words that follow each word, start and end token included; with a
    context column, (context, prev, next, prob), a distribution for each context.

    It stands in for a neural decoder behind the same interface: a table of distributions over next words, given what
    is known of the input.
    """
    given = [context] if context else []
    before, after = F.concat(F.array(F.lit(START)), F.col(words)), F.concat(F.col(words), F.array(F.lit(END)))
    pairs = F.zip_with(before, after, lambda a, b: F.struct(a.alias("prev"), b.alias("next")))
    counts = texts.select(*given, F.explode_outer(pairs).alias("x")).groupBy(*given, "x.prev", "x.next").agg(F.count("*").alias("n"))
    counts = materialise(counts)  # else all words are read, shuffled and counted again for the totals
    totals = counts.groupBy(*given, "prev").agg(F.sum("n").alias("t"))
    return counts.join(totals, [*given, "prev"]).select(*given, "prev", "next", (F.col("n") / F.col("t")).alias("prob"))


def bigram_losses(texts: DataFrame, others: DataFrame, key: str, words: str, outcomes: int) -> DataFrame:
    """(key, loss): -log of the probability of the words and the end of each of the others, by the words that follow each
    word in texts, with one count added to each of the possible outcomes."""
    def steps(df: DataFrame) -> DataFrame:
        before, after = F.concat(F.array(F.lit(START)), F.col(words)), F.concat(F.col(words), F.array(F.lit(END)))
        return df.select(key, F.explode(F.arrays_zip(before.alias("prev"), after.alias("next"))).alias("x")).select(key, "x.prev", "x.next")

    counts = steps(texts).groupBy("prev", "next").agg(F.count("*").alias("n"))
    totals = counts.groupBy("prev").agg(F.sum("n").alias("t"))
    found = steps(others).join(counts, ["prev", "next"], "left").join(totals, "prev", "left")
    loss = -F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + outcomes))
    return found.groupBy(key).agg(F.sum(loss).alias("loss"))


def _given(context: str | None) -> tuple[list[str], list[Column], Column]:
    """Columns of the context on the side of the inputs and of the scorer, and how the two meet."""
    met = F.col("last") == F.col("prev")
    if not context:
        return [], [], met
    return [context], [F.col(context).alias("__given")], met & F.col(context).eqNullSafe(F.col("__given"))


def greedy(inputs: DataFrame, key: str, scorer: DataFrame | Scorer, most: int = 20, start: str | None = None, context: str | None = None) -> DataFrame:
    """(key, words, n): the most probable next word, again and again, until the end token or `most` words.

    Ties take the smaller word; a word that the table lacks ends its row. start names a column with the word to begin after, else it is the start token; context
    one that inputs and scorer share, by which each row meets its own distributions (a Scorer looks at columns of its own instead). Rows keep their key, so that the order in which they finish does not matter. Every fifth step is a table, after which only rows that go on are joined again.
    """
    given, theirs, met = _given(context)
    first = F.coalesce(F.col(start), F.lit(START)) if start else F.lit(START)
    if callable(scorer):
        given = [*scorer.columns, "begun"]
    else:
        best = scorer.groupBy(*([context] if context else []), "prev").agg(F.min(F.struct((-F.col("prob")).alias("p"), "next")).alias("b"))
        best = materialise(best.select(*theirs, "prev", F.col("b.next").alias("next")))
    active = inputs.withColumn("begun", first).select(key, *given, F.col("begun").alias("last"), F.array().cast("array<string>").alias("words"))
    done: list[DataFrame] = []
    for step in range(1, most + 1):
        extended = scorer(active, 1).withColumn("next", F.when(F.col("last") != END, F.col("next"))) if callable(scorer) else active.join(best, met, "left")
        grown = extended.select(key, *given, F.coalesce("next", F.lit(END)).alias("last"), "words")
        active = grown.withColumn("words", F.when(F.col("last") == END, F.col("words")).otherwise(F.concat("words", F.array("last"))))
        if step % 5 == 0 or step == most:  # rows that have ended ride along until the next table; END leads nowhere
            table = materialise(active)
            active = table.where(F.col("last") != END)
            done.append(table if step == most else table.where(F.col("last") == END))
            if step < most and active.isEmpty():
                break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(key, F.array_join("words", " ").alias("words"), F.size("words").alias("n"))


def beam(inputs: DataFrame, key: str, scorer: DataFrame | Scorer, width: int = 3, most: int = 12, start: str | None = None, context: str | None = None) -> DataFrame:
    """(key, place, words, score): hypotheses by falling log probability per word, the best first.

    Each step extends every live hypothesis by its `width` most probable words and keeps the best of all. A
    hypothesis that takes the end token is finished. As soon as the end token has been the best word of some
    hypothesis of an input, its beam loses one place with every later step (kept from the original decoder). start
    names a column with the word to begin after, else it is the start token, context one that inputs and scorer share, by
    which each row meets its own distributions. After a word that the table lacks the
    end token is certain, so that every input has hypotheses. Log probabilities are rounded to nine digits, so that
    hypotheses of equal probability tie whatever the order of their words; ties take the smaller words.
    """
    given, theirs, met = _given(context)
    first = F.coalesce(F.col(start), F.lit(START)) if start else F.lit(START)
    if callable(scorer):
        given = [*scorer.columns, "begun"]
    else:
        by_prev = Window.partitionBy(*([context] if context else []), "prev").orderBy(F.desc("prob"), "next")
        top = materialise(scorer.withColumn("r", F.row_number().over(by_prev)).where(F.col("r") <= width).select(*theirs, "prev", "next", F.round(F.ln("prob"), 9).alias("lp"), "r"))
    live = inputs.withColumn("begun", first).select(key, *given, F.col("begun").alias("last"), F.array().cast("array<string>").alias("words"), F.lit(0.0).alias("score"), F.lit(width).alias("k"), F.lit(False).alias("shrinks"))
    finished: list[DataFrame] = []
    for _ in range(most):
        extended = scorer(live, width).withColumn("lp", F.round(F.ln("prob"), 9)).drop("prob") if callable(scorer) else live.join(top, met, "left")
        grown = extended.withColumn("score", F.round(F.col("score") + F.coalesce("lp", F.lit(0.0)), 9))
        grown = grown.withColumn("next", F.coalesce("next", F.lit(END))).withColumn("r", F.coalesce("r", F.lit(1)))
        ended = F.max(((F.col("r") == 1) & (F.col("next") == END)).cast("int")).over(Window.partitionBy(key)) == 1
        grown = grown.withColumn("shrinks", F.col("shrinks") | ended)
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.array_join(F.concat("words", F.array("next")), " ")))
        grown = grown.withColumn("place", place).where(F.col("place") <= F.col("k"))
        grown = materialise(grown.select(key, *given, F.col("next").alias("last"), "words", "score", (F.col("k") - F.col("shrinks").cast("int")).alias("k"), "shrinks"))
        finished.append(grown.where(F.col("last") == END).select(key, "words", (F.col("score") / (F.size("words") + 1)).alias("score")))
        live = grown.where((F.col("last") != END) & (F.col("k") > 0)).withColumn("words", F.concat("words", F.array("last")))
        if live.isEmpty():
            break
    else:
        finished.append(live.select(key, "words", (F.col("score") / F.size("words")).alias("score")))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.array_join("words", " ")))
    return out.withColumn("place", place).select(key, "place", F.array_join("words", " ").alias("words"), "score")
