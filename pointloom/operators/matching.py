"""Maximum matching of a bipartite graph whose edges are a table.

A phase searches from all unmatched left vertices at once, layer by layer, by
joins: a right vertex that is reached for the first time keeps one of its
neighbours as parent, and a matched one leads on to its partner.  So each
unmatched left vertex has a tree of its own, and trees share no vertex.  Where a
tree reaches an unmatched right vertex, its path is an augmenting one; the tree
stops there, and paths of different trees are disjoint, so that all of them
augment in one step.  A phase without such a path ends the search: the matching
is maximum, and what the last search has reached tells a largest independent set.

Graphs of several groups are matched side by side.  Edges are stored once, dealt and
sorted by their left vertex, so that no layer shuffles or sends them: joins merge them
with the few rows of a layer as they lie.  Where the right side has less than half as
many vertices, sides are turned, so that trees grow from the few vertices of the smaller
side that a greedy start leaves.  Edges of a hot vertex of the side that proposes pass
through one task, a row at a time; those of the other side are reduced with partial
aggregation.  The driver sees counts only, and joins have no estimates of size by which
to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.rng import uniform
from pointloom.plans.ranks import shared_folder, stored

#: Rounds of proposals that a greedy start has.
GREEDY_ROUNDS = 4
STARTS = ("greedy-det", "greedy-rand")

LEFT, RIGHT = ["group", "left"], ["group", "right"]


@dataclass
class Matching:
    """``pairs`` (group, left, right); ``left`` (group, left) and ``right`` (group, right) make a largest independent set, ``cover_left`` and ``cover_right`` a smallest cover."""

    pairs: DataFrame
    left: DataFrame
    right: DataFrame
    size: int
    cover_left: DataFrame
    cover_right: DataFrame

    def turned(self) -> Matching:
        return Matching(*map(_turned, (self.pairs, self.right, self.left)), self.size, _turned(self.cover_right), _turned(self.cover_left))


def _kept(df: DataFrame) -> DataFrame:
    return stored(df, estimated=False)


def _turned(rows: DataFrame) -> DataFrame:
    """Rows whose left vertices are right ones, and the other way round."""
    return rows.select("group", *[F.col(b).alias(a) for a, b in (("left", "right"), ("right", "left")) if b in rows.columns])


def _vertices(edges: DataFrame) -> DataFrame:
    """Edges (group, left, right) of the types used here, without nulls; a single graph is group 0."""
    left = F.col("left").cast("long")
    # a literal group would be folded away, and the edges with it no longer known to be dealt by (group, left)
    group = (F.col("group") if "group" in edges.columns else F.lit(0)) + (left - left)
    return edges.select(group.cast("int").alias("group"), left.alias("left"), F.col("right").cast("long").alias("right")).dropna()


def _by_left(rows: DataFrame) -> DataFrame:
    """The other side of a join with edges on their left vertex: merged with them where they lie."""
    return rows.hint("merge")


def stored_edges(edges: DataFrame) -> DataFrame:
    """(group, left, right): each edge once, dealt and sorted by its left vertex."""
    conf = edges.sparkSession.conf
    adaptive, width = conf.get("spark.sql.adaptive.enabled"), int(conf.get("spark.sql.shuffle.partitions"))
    shared_folder(edges.sparkSession)
    # a checkpoint of an adaptive plan forgets how its rows are dealt and sorted, as does `stored` without an estimate, and each join would shuffle them again
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # other names on the way: columns that keep theirs are planned as those of the source, which the checkpoint does not know
        dealt = edges.select(F.col("group").alias("g"), F.col("left").alias("u"), F.col("right").alias("v")).repartition(width, "g", "u").distinct().sortWithinPartitions("g", "u")
        return dealt.select(F.col("g").alias("group"), F.col("u").alias("left"), F.col("v").alias("right")).checkpoint(eager=True)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def greedy_match(edges: DataFrame, start: str = "greedy-rand", seed: int = 0, matched: DataFrame | None = None, rounds: int = GREEDY_ROUNDS) -> DataFrame:
    """(group, left, right): rounds in which free left vertices propose to a free neighbour, and each of those takes one.

    "greedy-det" proposes to the smallest neighbour, "greedy-rand" to a random one.
    """
    if start not in STARTS:
        raise ValueError(f"unknown start {start}")
    free = edges
    for turn in range(rounds):
        open_edges = free
        if matched is not None:
            # a round reads what the round before has left, not all edges
            free = stored(free.join(_by_left(matched.select(*LEFT)), LEFT, "left_anti"))
            open_edges = free.join(matched.select(*RIGHT), RIGHT, "left_anti")
        rank = F.col("right") if start == "greedy-det" else uniform(seed, F.col("left"), F.col("right"), F.lit(turn))
        asked = open_edges.groupBy(*LEFT).agg(F.min_by("right", rank).alias("right"))
        chance = F.lit(0.0) if start == "greedy-det" else uniform(seed, F.col("left"), F.lit("taken"), F.lit(turn))
        taken = _kept(asked.groupBy(*RIGHT).agg(F.min(F.struct(chance.alias("rank"), "left"))["left"].alias("left")).select(*LEFT, "right"))
        matched = taken if matched is None else matched.unionAll(taken)
        if taken.isEmpty():
            break
    return matched if matched is not None else edges.limit(0)


def _search(edges: DataFrame, all_lefts: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lefts reached, rights reached, and (group, left, right) along one augmenting path of each tree that has one."""
    none = matched.limit(0)
    free = all_lefts.join(matched.select(*LEFT), LEFT, "left_anti")
    steps = F.array().cast("array<struct<left:bigint,right:bigint>>")
    front = _kept(free.select(*LEFT, F.col("left").alias("root"), steps.alias("path")))
    lefts, rights = front.select(*LEFT), none.select(*RIGHT)
    paths = None
    while not front.isEmpty():
        # one parent for each right vertex, by chance so that trees share what is there
        parent = F.min(F.struct(F.xxhash64("left", "right").alias("rank"), "left", "root", "path")).alias("p")
        met = edges.join(_by_left(front), LEFT).groupBy(*RIGHT).agg(parent)
        # known vertices leave after the reduction, so that the edges of a hot one are not sent to one task
        new = met.join(rights, RIGHT, "left_anti").select(*RIGHT, F.col("p.root").alias("root"), F.concat("p.path", F.array(F.struct(F.col("p.left").alias("left"), F.col("right").alias("right")))).alias("path"))
        reached = _kept(new.join(matched, RIGHT, "left"))
        if reached.isEmpty():
            break
        rights = _kept(rights.unionAll(reached.select(*RIGHT)))
        # a path for each tree that has come to an unmatched vertex
        ended = _kept(reached.where("left IS NULL").groupBy("group", "root").agg(F.min(F.struct("right", "path"))["path"].alias("path")))
        found = ended.select("group", F.inline("path"))
        paths = found if paths is None else paths.unionAll(found)
        front = _kept(reached.where("left IS NOT NULL").join(ended.select("group", "root"), ["group", "root"], "left_anti").select(*LEFT, "root", "path"))
        lefts = lefts.unionAll(front.select(*LEFT))
    return lefts, rights, paths if paths is not None else none


def bipartite_match(edges: DataFrame, start: DataFrame | str = "greedy-rand", seed: int = 0) -> Matching:
    """Maximum matching of edges (group, left, right), or (left, right) for a single graph.

    ``start`` is a matching to begin from (pairs that are no edges, or share a vertex, are refused) or the name of
    a greedy start.  Edges that repeat count once, those with a null vertex not at all.
    """
    edges, given = _vertices(edges), None
    if isinstance(start, DataFrame):
        given = _kept(start.select((F.col("group") if "group" in start.columns else F.lit(0)).cast("int").alias("group"), F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right")))
    # numbers that need not be exact, as any side can propose
    sides = edges.agg(*[F.approx_count_distinct(F.xxhash64("group", side)).alias(side) for side in ("left", "right")]).first()
    turned = 2 * sides.right < sides.left
    found = _best(stored_edges(_turned(edges) if turned else edges), "greedy-rand" if given is not None else start, seed, _turned(given) if turned and given is not None else given)
    return found.turned() if turned else found


def _best(edges: DataFrame, start: str, seed: int, given: DataFrame | None) -> Matching:
    """A maximum matching of stored edges, augmented from greedy rounds after the pairs that are given."""
    if given is not None:
        n = given.count()
        if n != given.join(edges.hint("merge"), [*LEFT, "right"], "left_semi").count() or n != given.select(*LEFT).distinct().count() or n != given.select(*RIGHT).distinct().count():
            raise ValueError("the start is no matching of these edges")
    all_lefts = _kept(edges.select(*LEFT).distinct())
    matched = greedy_match(edges, start, seed, given)
    while True:
        lefts, rights, paths = _search(edges, all_lefts, matched)
        if paths.isEmpty():
            unreached = edges.select(*RIGHT).distinct().join(rights, RIGHT, "left_anti")
            return Matching(matched.select(*LEFT, "right"), lefts, unreached, matched.count(), matched.select(*LEFT).join(lefts, LEFT, "left_anti"), rights)
        # trees that found no path stay as they are; vertices on a path get their new partners
        matched = _kept(matched.select(*LEFT, "right").join(paths.select(*LEFT), LEFT, "left_anti").unionAll(paths.select(*LEFT, "right")))


def certificate(edges: DataFrame, found: Matching) -> DataFrame:
    """One row: size, whether pairs are edges that share no vertex, and whether a vertex cover of the same size proves them most.

    Edges are shuffled once, to what is known of their vertex on the side with more of the cover; those that
    this side does not cover go on to the other one.
    """
    edges, pairs = _vertices(edges), _kept(found.pairs)
    cover = {"left": _kept(found.cover_left.distinct()), "right": _kept(found.cover_right.distinct())}
    sizes = {side: rows.count() for side, rows in cover.items()}
    near, far = ("left", "right") if sizes["left"] > sizes["right"] else ("right", "left")
    mates = pairs.select("group", near, F.col(far).alias("mate"), F.lit(False).alias("covers"))
    covering = cover[near].select("group", near, F.lit(None).cast("long").alias("mate"), F.lit(True).alias("covers"))
    known = mates.unionAll(covering).groupBy("group", near).agg(F.max("mate").alias("mate"), F.bool_or("covers").alias("covers"))
    met = edges.join(known.hint("shuffle_hash"), ["group", near], "left").select("group", "left", "right", (F.col("mate") == F.col(far)).alias("pair"), F.coalesce("covers", F.lit(False)).alias("covered"))
    rest = met.where("pair OR NOT covered").join(cover[far].withColumn("other", F.lit(True)), ["group", far], "left")
    seen = rest.agg(F.count_distinct(F.when(F.col("pair"), F.struct("group", near))).alias("edges"), F.count_if(~F.col("covered") & F.col("other").isNull()).alias("bare"))
    sides = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(*LEFT).alias("lefts"), F.count_distinct(*RIGHT).alias("rights"))
    n = F.lit(found.size).cast("long")
    proper = (F.col("pairs") == n) & (F.col("edges") == n) & (F.col("lefts") == n) & (F.col("rights") == n)
    return sides.crossJoin(seen).select(n.alias("size"), proper.alias("proper"), (F.lit(sum(sizes.values()) == found.size) & (F.col("bare") == 0)).alias("largest"))  # one row each
