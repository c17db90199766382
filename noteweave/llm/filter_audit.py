"""Operator 12: what each of five filters removes, alone and in every order, by the potential of the removal game.

A document fails a set of filters, five bits.  Of a coalition S of filters the game's worth v(S) is the
number of documents that at least one of S removes.  The potential of Hart and Mas-Colell is defined by
P(empty) = 0 and P(S) = (v(S) + sum of P(S without i) over i in S) / |S|; the Shapley value of a filter is
P(all) - P(all without it).  Whatever the order, the filters applied before a step form a coalition, so a
step's figures are differences of two worths.  Only counts by (part, bits) go into the games: 32 a part.

Copies share their text and so the first four bits; whether a row is the first of its copies is settled on
rows counted by (text digest, part, labels), so a text that a third of all rows hold is a handful of rows
before it is shuffled by its digest.

Labels and digests grow with the corpus, so they are joined by sorting at every size: the estimate by which Spark
broadcasts a table through the driver does not count the copies that are made of the labels.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: Parts into which the rows of one id are dealt when labels are joined.
SALTS = 8
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Least words; least percent of distinct words; most percent of capitals; characters that fail a text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"


def text_bits(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.char_length(text), text.rlike(MARKS)]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0)).cast("int")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): rows of each part by the set of filters they fail, and those labelled good or toxic.

    A row fails E if a row with a smaller id has its text, in whatever part; rows without an id fail it never
    and make no other row fail.  Of conflicting labels of an id the larger counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_bits(text).alias("bits"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    marks = marks.filter(F.col("id").isNotNull()).groupBy("id").agg(F.coalesce(F.max("good"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))

    folder = shared_dir(docs.sparkSession)
    # read more than once below: written, so that texts are read once
    rows = stored(facts.groupBy("id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n")), folder, "rows")
    nameless = rows.filter(F.col("id").isNull()).groupBy("part", "bits").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    named = rows.filter(F.col("id").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = named.join(marks.hint("merge"), ["id", "salt"], "left").fillna(0, ["good", "toxic"])
    same = named.groupBy("digest", "part", "bits", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"))
    same = stored(same, folder, "same")
    lowest = same.groupBy("digest").agg(F.min("low").alias("lowest"))
    same = same.join(lowest.hint("merge"), "digest")
    firsts = F.when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(F.lit(0))
    split = F.explode(F.array(F.struct(F.col("bits"), firsts.alias("n")), F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - firsts).alias("n"))))
    split = same.select("part", "good", "toxic", split.alias("s")).select("part", "s.bits", F.col("s.n").alias("n"), (F.col("good") * F.col("s.n")).alias("good"), (F.col("toxic") * F.col("s.n")).alias("toxic"))
    out = split.unionByName(nameless).groupBy("part", "bits").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    return out.filter(F.col("n") > 0)


def worths(counts: DataFrame) -> DataFrame:
    """(part, total, unique[5], v[32], good[32], toxic[32]): of each coalition the rows, good rows and toxic rows it removes."""
    part = counts.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))  # 32 cells a part

    def lost(field: str) -> Column:
        def of(s: Column) -> Column:
            return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["bits"].bitwiseAND(s) != 0, c[field]).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit(ALL)), of)

    unique = F.transform(F.array(*(F.lit(1 << k) for k in range(len(FILTERS)))), lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["bits"] == s, c["n"]).otherwise(0)))
    return part.select("part", "total", unique.alias("unique"), lost("n").alias("v"), lost("good").alias("good"), lost("toxic").alias("toxic"))


def potentials(games: DataFrame, worth: str = "v", name: str = "potential") -> DataFrame:
    """Adds the array of 120 P(S) over the 32 coalitions, by recursion over their subsets.

    120 P(S) is a whole number: v(T) enters P(S) with 1 / (t * binomial(s, t)), whose denominators divide 60.
    """
    bits = F.array(*(F.lit(1 << k) for k in range(len(FILTERS))))

    def of(found: Column, s: Column) -> Column:
        inside = F.filter(bits, lambda b: b.bitwiseAND(s) != 0)
        below = F.aggregate(inside, F.lit(0).cast("long"), lambda a, b: a + found[s - b])
        return F.concat(found, F.array(F.call_function("div", 120 * F.col(worth)[s] + below, F.size(inside))))

    # S without i is a smaller number than S, so in this order every smaller coalition is there
    return games.withColumn(name, F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), of))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    A null text counts as empty, a null part as the empty string; repeated rows each count; further columns
    are ignored; without documents there are no parts and no rows, without labels nothing is good or toxic.
    """
    games = potentials(worths(failure_counts(docs, labels, id_col, text_col, part_col)))
    letter = lambda i: F.expr(f"instr('{FILTERS}', substring(filter_order, {i}, 1)) - 1")
    order = games.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), letter(i).alias("own"), sum((F.call_function("shiftleft", F.lit(1), letter(j)) for j in range(1, i)), F.lit(0)).alias("before")) for i in range(1, len(FILTERS) + 1))))
    rows = order.withColumn("s", step).select("*", "s.step", "s.own", "s.before")
    bit = F.call_function("shiftleft", F.lit(1), F.col("own"))
    after = F.col("before").bitwiseOR(bit)
    diff = lambda c: F.col(c)[after] - F.col(c)[F.col("before")]
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.col("v")[after]).alias("kept"), diff("v").alias("removed"),
        (F.col("v")[bit] - diff("v")).alias("redundant"), F.col("unique")[F.col("own")].alias("unique_fails"),
        diff("good").alias("good_lost"), diff("toxic").alias("toxic_lost"),
        (F.col("potential")[ALL] - F.col("potential")[F.lit(ALL) - bit]).alias("shapley"))
