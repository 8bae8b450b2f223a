"""The exact nearest text by Jaccard similarity of words, without pairing texts by the words that all share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import word_set
from pairforge.shared import materialize

#: Similarities at which texts are looked up, from high to low; what is found at one ends the search for all that it satisfies.
LEVELS = (0.8, 0.6, 0.4, 0.25, 0.15, 0.08)


def _prefix(n: Column, level: Column) -> Column:
    """How many of a text's rarest words it has to share one of with any text of at least this similarity."""
    return n - F.greatest(F.lit(1), F.ceil(level * n - F.lit(1e-9))) + 1


def _ordered_words(rows: DataFrame) -> DataFrame:
    """(id, n, place, word): each text's words from the rarest, by how many texts hold them, to the most common."""
    words = rows.select("id", F.explode("w").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    placed = words.join(counts, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "word"))).alias("ws"))
    return placed.select("id", F.size("ws").alias("n"), F.posexplode("ws").alias("place", "x")).select("id", "n", "place", F.col("x.word").alias("word"))


def _scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, other, order, similarity) of pairs (id, other)."""
    mine = rows.select("id", F.col("w").alias("a"))
    theirs = rows.select(F.col("id").alias("other"), F.col("w").alias("b"), "order")
    both = pairs.join(mine, "id").join(theirs, "other")
    common = F.size(F.array_intersect("a", "b"))
    return both.select("id", "other", "order", (common / (F.size("a") + F.size("b") - common)).alias("similarity"))


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "order", "other")).alias("b"))


def candidates(active: DataFrame, words: DataFrame, rows: DataFrame, level: Column) -> DataFrame:
    """(id, other) of different groups that share a word which is rare enough in both, for the active texts.

    active: id, bound (the similarity each has already); level: what similarity counts, given the bound.
    """
    group = rows.select("id", "group")
    mine = words.join(active, "id").withColumn("level", level).where(F.col("place") < _prefix(F.col("n"), F.col("level")))
    mine = mine.join(group, "id").select("id", "n", "level", "group", "word")
    theirs = words.join(group, "id").select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("group").alias("other_group"), "word")
    near = mine.join(theirs, "word").where((F.col("group") != F.col("other_group")) & (F.col("m") >= F.col("level") * F.col("n") - 1e-9) & (F.col("n") >= F.col("level") * F.col("m") - 1e-9))
    return near.where(F.col("at") < _prefix(F.col("m"), F.col("level"))).select("id", "other").distinct()


def jaccard_neighbours(texts: DataFrame, least: float = 0.0, order: str = "id", levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """The most similar text of another group for each text: (id, neighbour, similarity), from `least` on.

    texts: id, group, text, and `order`, by which ties go to the first. Texts of at least a similarity share one of their
    rarest words, the fewer the higher it is. So texts are looked up level by level, each with its own bound by what it has
    found, and its most common words are left out as soon as anything better is known than they could give. Those
    that share no word with another group have similarity 0 with the first of another group, or 1 with the first of the other
    texts without words. Without another group there is no row.
    """
    spark = texts.sparkSession
    rows, _ = materialize(spark, texts.select("id", "group", F.col(order).alias("order"), word_set(F.coalesce("text", F.lit(""))).alias("w")), "texts")
    words, _ = materialize(spark, _ordered_words(rows), "words")
    found, _ = materialize(spark, rows.select("id", F.lit(0.0).alias("bound"), F.lit(None).cast(dict(rows.dtypes)["order"]).alias("order"), F.lit(None).cast(dict(rows.dtypes)["id"]).alias("other")), "found")
    searched = 2.0
    for level in (*levels, 0.0):
        # All that is as similar as the last level has been found; of what a text still lacks, only what beats its bound counts.
        active = found.where(F.col("bound") < searched)
        if active.isEmpty():
            break
        at, searched = F.greatest(F.lit(level), "bound"), level
        more = _best(_scored(candidates(active.select("id", "bound"), words, rows, at), rows))
        first = F.least(F.when(F.col("other").isNotNull(), F.struct((-F.col("bound")).alias("s"), "order", "other")), F.col("b"))
        better = found.join(more, "id", "left").select("id", first.alias("b"))
        found, _ = materialize(spark, better.select("id", F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("bound"), "b.order", "b.other"), "found")
    best = found.where("other IS NOT NULL")

    def smallest(of: DataFrame, name: str) -> DataFrame:
        """The first texts of the two groups that come first: one row."""
        groups = of.groupBy("group").agg(F.min(F.struct("order", "id")).alias("f")).orderBy("f").limit(2)
        return groups.agg(F.sort_array(F.collect_list(F.struct("f", "group"))).alias(name))

    alone = rows.select("id", "group", F.size("w").alias("n")).join(best.select("id", "bound", "other"), "id", "left")
    alone = alone.join(F.broadcast(smallest(rows, "any")), how="cross").join(F.broadcast(smallest(rows.where("size(w) = 0"), "empty")), how="cross")
    first = lambda name: F.try_element_at(F.filter(name, lambda g: g["group"] != F.col("group")), F.lit(1))["f"]["id"]
    wordless = (F.col("n") == 0) & first("empty").isNotNull()
    neighbour = F.coalesce(F.col("other"), F.when(wordless, first("empty")), first("any"))
    similarity = F.coalesce(F.when(F.col("other").isNotNull(), F.col("bound")), F.when(wordless, F.lit(1.0)), F.lit(0.0))
    return alone.select("id", neighbour.alias("neighbour"), similarity.alias("similarity")).where(F.col("neighbour").isNotNull() & (F.col("similarity") >= least))
