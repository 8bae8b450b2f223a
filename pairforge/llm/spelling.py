"""Spelling variants: frequent words that differ by one letter, by automata over the halves of all words.

A word that is one insertion, deletion or replacement away from another holds one of the other's two halves unchanged, the
first at its beginning or the second at its end. Halves are dealt out by their text over shards; a shard builds one
Aho-Corasick automaton of its halves and scans the words that may hold one of them: a word has at most two lengths of first
and two of second halves to look for, as lengths differ by one at most. A hit counts if the half stands at the
beginning or end and the lengths fit; what is left of both words then has to be one edit apart. The rests of a half's words
are kept by what they are with one letter less, so a half of many words does not compare all of them; halves
of very many words are dealt out by those rests, too.

Results in odd cases:

* a null text has no words; a null id is empty where runs are hashed; rows that repeat an id count each;
* an empty table gives an empty one; other columns are ignored;
* words equally frequent tie by code points; a chain of forms ends, as each form is ten times as frequent as its word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SpellingConfig:
    #: Code points of a word and occurrences of it, at least.
    least_length: int = 7
    least_count: int = 2
    #: A form is so many times as frequent as its word, at least.
    ratio: int = 10
    #: One run in so many loses a code point.
    damage: int = 31
    #: Halves of a shard, on average, and words of one half beyond which it is dealt out by the rests of its words.
    shard: int = 12_000
    hot: int = 2_000


def words_of(docs: DataFrame, cfg: SpellingConfig) -> DataFrame:
    """(word, n): lower-cased runs of letters, damaged by their hashes, that are long and frequent enough."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{cfg.least_length},}})"), 1))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), runs.alias("run"))
    found = found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = found.select(F.when(h % cfg.damage == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= cfg.least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= cfg.least_count)


def _half(length: Column) -> Column:
    """Length of the first half of a word."""
    return F.floor(length / 2).cast("int")


def _halves(words: DataFrame) -> DataFrame:
    """(word, n, last, half, rest): both halves of every word and what is left of it."""
    size = F.length("word")
    h = _half(size)
    first, second = F.substring("word", F.lit(1), h), F.substring("word", h + 1, size - h)
    both = F.array(F.struct(F.lit(False).alias("last"), first.alias("half"), second.alias("rest")), F.struct(F.lit(True).alias("last"), second.alias("half"), first.alias("rest")))
    return words.select("word", "n", F.explode(both).alias("h")).select("word", "n", "h.*")


def _possible(words: DataFrame) -> DataFrame:
    """(word, n, last, half, rest): every beginning and end of a word that is as long as a half of a word that is near."""
    size = F.length("word")

    def sides(length: Column) -> list[Column]:
        h = _half(length)
        k = length - h
        return [F.struct(F.lit(False).alias("last"), F.substring("word", F.lit(1), h).alias("half"), F.substring("word", h + 1, size - h).alias("rest")), F.struct(F.lit(True).alias("last"), F.substring("word", size - k + 1, k).alias("half"), F.substring("word", F.lit(1), size - k).alias("rest"))]

    return words.select("word", "n", F.explode(F.array_distinct(F.array(*sides(size - 1), *sides(size), *sides(size + 1)))).alias("h")).select("word", "n", "h.*")


def _variants(rest: Column) -> Column:
    """A rest, and it with one letter less, at every place."""
    less = F.transform(F.sequence(F.lit(1), F.length(rest)), lambda i: F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, F.length(rest))))
    return F.array_distinct(F.concat(F.array(rest), F.when(F.length(rest) > 0, less).otherwise(F.array().cast("array<string>"))))


def near(a: str, b: str) -> bool:
    """Whether exactly one insertion, deletion or replacement leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def less_one(rest: str) -> set[str]:
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


class HalvesAutomaton:
    """Words by their halves: an Aho-Corasick automaton of the halves' texts, and under each the rests of its words."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.rests: dict[tuple[bool, str], dict[str, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))

    def add(self, word: str, n: int, last: bool, half: str, variant: str | None) -> None:
        """One half of a word; under one variant of the rest only, if one is given."""
        rest = word[: -len(half)] if last else word[len(half) :]
        by_rest = self.rests[last, half]
        for v in (variant,) if variant is not None else less_one(rest):
            by_rest[v].append((word, n))

    def build(self) -> None:
        for half in {h for _, h in self.rests}:
            self.automaton.add_word(half, half)
        if self.rests:
            self.automaton.make_automaton()

    def scan(self, word: str) -> Iterator[tuple[bool, str]]:
        """(last, half) of the halves of words of near lengths that stand at the beginning or the end of word."""
        size = len(word)
        for end, half in self.automaton.iter(word):
            k = len(half)
            if end + 1 == k and any((size + d) // 2 == k for d in (-1, 0, 1)):
                yield False, half
            if end + 1 == size and any((size + d + 1) // 2 == k for d in (-1, 0, 1)):
                yield True, half

    def neighbours(self, word: str, last: bool, half: str, variant: str | None) -> Iterator[tuple[str, int]]:
        """Words with this half that are one edit away, each once over all halves and variants."""
        by_rest = self.rests.get((last, half))
        if by_rest is None:
            return
        rest = word[: -len(half)] if last else word[len(half) :]
        mine = less_one(rest)
        for v in (variant,) if variant is not None else mine:
            for other, n in by_rest.get(v, ()):
                if not near(word, other) or (last and word.startswith(other[: len(other) // 2])):
                    continue
                if v == min(mine & less_one(other[: -len(half)] if last else other[len(half) :])):
                    yield other, n


def _scan_shard(key: tuple, table: pa.Table) -> pa.Table:
    """(word, near, near_n) of one shard: its halves are built, its words scanned."""
    shard, asked = HalvesAutomaton(), defaultdict(set)
    for word, n, last, half, variant, build in zip(*(table.column(c).to_pylist() for c in ("word", "n", "last", "half", "variant", "build")), strict=True):
        if build:
            shard.add(word, n, last, half, variant)
        else:
            asked[word].add((last, half, variant))
    shard.build()
    out: tuple[list, list, list] = ([], [], [])
    for word, wanted in asked.items() if shard.rests else ():
        hits = set(shard.scan(word))
        for last, half, variant in wanted:
            if (last, half) in hits:
                for other, n in shard.neighbours(word, last, half, variant):
                    for column, value in zip(out, (word, other, n), strict=True):
                        column.append(value)
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})


def near_pairs(words: DataFrame, cfg: SpellingConfig) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words one edit apart. words: (word, n), each word once, stored."""
    common.ship(words.sparkSession)
    halves = _halves(words)
    hot, _ = common.materialize(words.sparkSession, halves.groupBy("last", "half").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > cfg.hot).select("last", "half", F.lit(True).alias("hot")), "hot-halves")
    everything = halves.withColumn("build", F.lit(True)).unionByName(_possible(words).withColumn("build", F.lit(False)))
    variant = F.explode(F.when(F.col("hot"), _variants(F.col("rest"))).otherwise(F.array(F.lit(None).cast("string"))))
    dealt = everything.join(hot, ["last", "half"], "left").select("word", "n", "last", "half", variant.alias("variant"), "build")
    shards = max(1, -(-2 * words.count() // cfg.shard))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("last", "half", "variant"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_scan_shard, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. forms: (word, form) of the words that have one; chains end.

    Each round doubles how far a word has gone, and is written, so a chain of k forms takes log2(k) rounds.
    """
    spark = forms.sparkSession
    reach, _ = common.materialize(spark, forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not reach.where("moved").isEmpty():
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        reach, _ = common.materialize(spark, step, "roots")
    return reach.select("word", "root")


def spelling_variants(docs: DataFrame, cfg: SpellingConfig | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of documents."""
    cfg, spark = cfg or SpellingConfig(), docs.sparkSession
    words, _ = common.materialize(spark, words_of(docs, cfg), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    grouped = near_pairs(words, cfg).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(grouped, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    holds = F.col("near_n") >= cfg.ratio * F.col("n")
    told, _ = common.materialize(spark, joined.select("word", "n", "n_near", F.when(holds, F.col("near")).alias("form"), F.when(holds, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of documents, their forms and roots."""
    return spelling_variants(common.table(spark, sf_dir, "documents"))


_DAMAGE = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(steps[1 + (xor(c, x) & 255)], c >> 8)), 4294967295)"
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT for k in range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS b FROM counted),
hashed AS (SELECT run, k, {_DAMAGE} AS h FROM bytes, crc),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
swaps AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM swaps a JOIN swaps b ON a.v = b.v AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
told AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN ranked p ON p.word = w.word AND r = 1),
chain AS (SELECT word, word AS root, 0 AS d FROM told UNION ALL SELECT c.word, t.form, d + 1 FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""
