"""Filter interaction audit: what filters remove alone, together and in every order.

Five filters judge a document: A under 50 words, B few distinct words, C many
capitals, D a symbol, E a text that a smaller id has.  All orders of the
filters are paths through the lattice of sets of applied filters: a step of an
order is an edge from the set applied already to that set with the next filter.
There are 5 * 16 = 80 edges and 120 * 5 = 600 steps.  Documents are counted by
part, filters failed and labels; those counts go to the edges, and the edges to
the steps of all orders.  Shapley counts weigh an edge with the orders through it.

Only ids, parts, flags and digests of texts are shuffled.  Copies of a text fail
the same of A to D, so that they are counted together before they meet, and how
many of them have the smallest id says how many fail E.  Texts are told apart by
SHA-256.

Defined cases: a null text is empty, and empty texts are copies of one another;
a null source is the part ""; a null id fails E never and makes no other id fail
it, and has no labels; rows that repeat an id count one by one, and none of them
fails E for another of the same id; an id labelled more than once has a label if
any row gives it; a null label counts as 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Applied sets and filters: a bit for each filter, A first.
SETS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    few = F.size(words) < MIN_WORDS
    same = 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * F.size(words)
    capitals = 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_SHARE * F.length(text)
    symbol = text.rlike(r"[#$%&*|]")
    return sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate((few, same, capitals, symbol))), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail and their labels."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    judged = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text_failures(text).alias("mask"),
    )
    rows = judged.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))  # rows that repeat an id
    marked = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(marked("quality"), marked("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", flag("quality").alias("good"), flag("toxic").alias("toxic"))

    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    unnamed = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    # one row of the smallest id for each part, as an id's rows of one text and part were counted together
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), unnamed.alias("unnamed"))
    smallest = copies.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    whole = copies.join(smallest, "digest")
    passing = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - passing).alias("n")))
    split = whole.select("part", "good", "toxic", F.inline(both))
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edge_counts(counts: DataFrame) -> DataFrame:
    """One row for each part and edge (applied, next) of the lattice, from rows (part, mask, good, toxic, n).

    ``shapley`` of a part and filter sums what the filter removes over all orders.
    """
    spark = counts.sparkSession
    k = F.col("id") % len(FILTERS)
    low = F.floor(F.col("id") / len(FILTERS)).cast("int")  # a set of the other filters, without a place for this one
    cut = F.call_function("shiftleft", F.lit(1), k.cast("int"))
    applied = (low - low % cut) * 2 + low % cut
    edges = spark.range(len(FILTERS) * SETS // 2).select(applied.cast("int").alias("applied"), k.cast("int").alias("next"), cut.cast("int").alias("bit"))
    meets = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(SETS - 1))).alias("mask"))  # 80 edges of 32 masks

    before = F.col("mask").bitwiseAND(F.col("applied")) != 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    kinds = {"kept": ~before & ~fails, "removed": ~before & fails, "redundant": before & fails, "unique_fails": F.col("mask") == F.col("bit"), "good_lost": ~before & fails & F.col("good"), "toxic_lost": ~before & fails & F.col("toxic")}
    total = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0))
    met = counts.join(F.broadcast(meets), "mask")
    by_edge = met.groupBy("part", "applied", "next").agg(*[total(kinds[c]).alias(c) for c in COUNTS])
    size = F.bit_count("applied")
    orders = F.factorial(size) * F.factorial(F.lit(len(FILTERS) - 1) - size)
    shapley = by_edge.groupBy("part", "next").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    return by_edge.join(shapley, ["part", "next"])


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, next) for the 600 steps of the 120 orders."""
    orders = spark.createDataFrame([("".join(p),) for p in permutations(FILTERS)], "filter_order string")
    placed = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = lambda c: F.locate(c, F.col("filter_order"))
    applied = sum((F.when(place(c) < F.col("step"), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))
    following = sum((F.when(place(c) == F.col("step"), k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))
    return placed.select("filter_order", "step", applied.alias("applied"), following.alias("next"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    paths = F.broadcast(steps(docs.sparkSession))  # 600 rows
    joined = edge_counts(failure_counts(docs, labels)).join(paths, ["applied", "next"])
    return joined.select("part", "filter_order", "step", *COUNTS, "shapley")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS smallest FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > smallest, false)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT k, chr(65 + k::INT) AS letter, (1 << k)::INT AS bit FROM range(0, 5) r(k)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step::INT AS step, coalesce(list_sum([1 << j::INT for j in ks[1:step - 1]]), 0)::INT AS applied, (1 << ks[step]::INT)::INT AS bit FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit,
  sum(n) FILTER (mask & (applied | bit) = 0) AS kept, sum(n) FILTER (mask & applied = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (mask & applied > 0 AND mask & bit > 0) AS redundant,
  sum(n) FILTER (mask = bit) AS unique_fails, sum(n) FILTER (mask & applied = 0 AND mask & bit > 0 AND good) AS good_lost, sum(n) FILTER (mask & applied = 0 AND mask & bit > 0 AND toxic) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM x
"""
