"""Graph operators (G rows, E4-E7): walks, closures, reachability, taint, components, exports.

Edges are rows (src, dst, ...). Loops hold state in DataFrames, join the frontier against the edges, drop what was
visited with an anti-join, and cut lineage in the shared folder; only counts come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def flipped(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "__s", "dst": "src"}).withColumnRenamed("__s", "dst")


@dataclass
class Factored:
    """Edges, some of them factored: each site (src, set_id) leads to all members (set_id, dst) of its set.

    Walks take it in place of an edge table. They open a set once, so their work grows with sites and members, not with
    the pairs of both.
    """

    edges: DataFrame
    sites: DataFrame | None = None
    sets: DataFrame | None = None

    @classmethod
    def of(cls, edges: "DataFrame | Factored") -> "Factored":
        return edges if isinstance(edges, Factored) else cls(edges)

    def flipped(self) -> "Factored":
        if self.sites is None:
            return Factored(flipped(self.edges))
        into = self.sets.select(F.col("dst").alias("src"), "set_id", "confidence")
        return Factored(flipped(self.edges), into, self.sites.select("set_id", F.col("src").alias("dst"), "confidence"))

    def plain(self) -> "Factored":
        """Without repeats and further columns, written once."""
        if self.sites is None:
            return Factored(cut(self.edges.select("src", "dst").distinct()))
        return Factored(cut(self.edges.select("src", "dst").distinct()), cut(self.sites.select("src", "set_id").distinct()), cut(self.sets.select("set_id", "dst").distinct()))


class Seen:
    """What a walk has visited. A round adds its frontier; only every eighth rewrites what is there."""

    def __init__(self, first: DataFrame) -> None:
        self.parts = [first]

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        if len(self.parts) > 8:
            self.parts = [cut(self.rows())]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def _ahead(g: Factored, frontier: DataFrame, opened: Seen | None) -> tuple[DataFrame, DataFrame | None]:
    """(node, via) one step from the frontier's nodes, and the sets (set_id) that it opened; via is the least node of several."""
    step = frontier.join(g.edges, F.col("node") == F.col("src")).select(F.col("dst").alias("to"), "src")
    new = None
    if g.sites is not None:
        new = frontier.join(g.sites, F.col("node") == F.col("src")).groupBy("set_id").agg(F.min("src").alias("src"))
        new = cut(new.join(opened.rows(), "set_id", "left_anti"))
        step = step.union(new.join(g.sets, "set_id").select(F.col("dst").alias("to"), "src"))
    return step.groupBy(F.col("to").alias("node")).agg(F.min("src").alias("via")), new


def one_step(edges: DataFrame | Factored, nodes: DataFrame) -> DataFrame:
    """The nodes (column node) that some of the given ones lead to."""
    g = Factored.of(edges)
    return _ahead(g, nodes.select("node").distinct(), _none_opened(g))[0].select("node")


def first_neighbours(edges: DataFrame, at: str = "offset") -> DataFrame:
    """One row for each pair; the edge of least offset (then path) supplies the confidence."""
    rest = [c for c in edges.columns if c not in ("src", "dst", at)]
    return edges.groupBy("src", "dst").agg(F.min(F.struct(at, *sorted(rest))).alias("b")).select("src", "dst", "b.*")


def trace(edges: DataFrame | Factored, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes within `depth` steps of the starts (column node) with their depth, the node they were reached from (the least of several) and, at the bound, whether they lead further."""
    g = Factored.of(edges).plain()
    frontier = cut(starts.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(dict(starts.dtypes)["node"]).alias("via")))
    seen, opened = Seen(frontier), _none_opened(g)
    for d in range(1, depth + 1):
        step, new = _ahead(g, frontier, opened)
        frontier = cut(step.join(seen.rows(), "node", "left_anti").select("node", F.lit(d).alias("depth"), "via"))
        if frontier.isEmpty():
            break
        seen.add(frontier)
        if new is not None:
            opened.add(new.select("set_id"))
    at_bound = seen.rows().where(F.col("depth") == depth).select("node")
    known = seen.rows().select(F.col("node").alias("dst"))
    more = at_bound.join(g.edges.select(F.col("src").alias("node"), "dst"), "node").join(known, "dst", "left_anti").select("node")
    if g.sites is not None:
        unseen = g.sets.join(known, "dst", "left_anti").select("set_id").distinct()
        more = more.union(at_bound.join(g.sites.withColumnRenamed("src", "node"), "node").join(unseen, "set_id", "left_semi").select("node"))
    return seen.rows().join(more.distinct().withColumn("__u", F.lit(True)), "node", "left").select("node", "depth", "via", F.coalesce("__u", F.lit(False)).alias("unexplored"))


def _none_opened(g: Factored) -> Seen | None:
    return None if g.sites is None else Seen(g.sites.select("set_id").limit(0))


def cycle_edges(edges: DataFrame, traced: DataFrame) -> DataFrame:
    """Edges of a walk that lead back to a node of the same or a lesser depth."""
    a = traced.select(F.col("node").alias("src"), F.col("depth").alias("from_depth"))
    b = traced.select(F.col("node").alias("dst"), F.col("depth").alias("to_depth"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("to_depth <= from_depth").select("src", "dst")


def neighbourhood(edges: DataFrame | Factored, starts: DataFrame, depth: int) -> DataFrame:
    """Both ways, callers at negative ranks; depth is held between 1 and 8."""
    depth = max(1, min(8, depth))
    ahead = trace(edges, starts, depth).select("node", F.col("depth").alias("rank"), F.col("unexplored").alias("more"))
    back = trace(Factored.of(edges).flipped(), starts, depth).select("node", (-F.col("depth")).alias("rank"), F.col("unexplored").alias("more"))
    return ahead.unionByName(back.where("rank < 0"))


def reach(edges: DataFrame | Factored, seeds: DataFrame, rounds: int = 10_000) -> DataFrame:
    """All nodes that can be reached from the seeds (column node), the seeds included. Semi-naive, so a cycle ends it."""
    g = Factored.of(edges).plain()
    frontier = cut(seeds.select("node").distinct())
    seen, opened = Seen(frontier), _none_opened(g)
    for _ in range(rounds):
        step, new = _ahead(g, frontier, opened)
        frontier = cut(step.select("node").join(seen.rows(), "node", "left_anti"))
        if frontier.isEmpty():
            return seen.rows()
        seen.add(frontier)
        if new is not None:
            opened.add(new.select("set_id"))
    raise RuntimeError("reach did not settle")


def regular_walk(edges: DataFrame, starts: DataFrame, automaton: list[tuple[str, str, str]], depth: int) -> DataFrame:
    """Walks typed edges (src, dst, label) along the paths that an automaton (state, label, next state) allows.

    starts has (node, state); every start has a walk of its own: (origin, node, state, depth, via, label, stop). A node is
    visited once in each state, at its least depth, from the least node of several. stop is `end` where no edge of an
    allowed label leads on, `depth-limit` where one does at the bound, and null inside a path.
    """
    spark = edges.sparkSession
    rules = F.broadcast(spark.createDataFrame(automaton, "state string, label string, next string"))  # a few rows, written by hand
    steps = cut(edges.select("src", "dst", "label").distinct().join(rules, "label"))
    first = starts.select(F.col("node").alias("origin"), "node", "state").distinct()
    frontier = cut(first.withColumn("depth", F.lit(0)).withColumn("via", F.lit(None).cast(dict(edges.dtypes)["src"])).withColumn("label", F.lit(None).cast("string")))
    seen = Seen(frontier)
    from_ = steps.withColumnsRenamed({"src": "node", "label": "by"})
    for d in range(1, depth + 1):
        ahead = frontier.select("origin", "node", "state").join(from_, ["node", "state"])
        best = ahead.groupBy("origin", F.col("dst").alias("to"), F.col("next").alias("then")).agg(F.min(F.struct(F.col("node").alias("via"), F.col("by").alias("label"))).alias("b"))
        new = best.select("origin", F.col("to").alias("node"), F.col("then").alias("state"), F.lit(d).alias("depth"), "b.via", "b.label")
        frontier = cut(new.join(seen.rows().select("origin", "node", "state"), ["origin", "node", "state"], "left_anti"))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    on = from_.select("node", "state").distinct().withColumn("__on", F.lit(True))
    stop = F.when(F.col("__on").isNull(), "end").when(F.col("depth") == depth, "depth-limit")
    return seen.rows().join(on, ["node", "state"], "left").select("origin", "node", "state", "depth", "via", "label", stop.alias("stop"))


def closure(edges: DataFrame, rounds: int = 64, hub: int = 1000) -> DataFrame:
    """All pairs (src, dst), without (x, x) unless on a cycle.

    Nodes on cycles reach the same nodes, so a component stands for its members until the end. Components of at least
    `hub` members are taken out: what reaches one and what it reaches are found apart, and their product is not made
    before the result. Paths of the rest are closed by steps of 1, 2, 4, ..., as many rounds as the longest has digits.
    """
    edges = cut(edges.select("src", "dst").distinct())
    member = cut(strong_components(edges))
    if member.isEmpty():
        return _acyclic_closure(edges, rounds)
    of = lambda end: member.select(F.col("node").alias(end), F.col("component").alias(f"__{end}"))
    between = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst"))
    between = cut(between.where("src <> dst").distinct())
    loops = edges.where("src = dst").join(member.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst")
    sizes = cut(member.groupBy("component").agg(F.count("*").alias("n")))
    hubs = sizes.where(F.col("n") >= hub).select("component")
    small = member.join(hubs, "component", "left_anti")
    cycles = sizes.where(F.col("n") < hub).select(F.col("component").alias("src"), F.col("component").alias("dst"))
    if hubs.isEmpty():
        return _opened(_acyclic_closure(between, rounds).union(cycles), small).union(loops)
    up, down = cut(_signed(flipped(between).select("src", "dst"), hubs)), cut(_signed(between, hubs))
    beside = between.join(hubs.withColumnRenamed("component", "src"), "src", "left_anti").join(hubs.withColumnRenamed("component", "dst"), "dst", "left_anti")
    rest = _acyclic_closure(cut(beside.select("src", "dst")), rounds).union(cycles)
    met = rest.join(up.toDF("src", "__up"), "src", "left").join(down.toDF("dst", "__down"), "dst", "left")
    rest = met.where(~F.coalesce(F.arrays_overlap("__up", "__down"), F.lit(False))).select("src", "dst")
    return _opened(rest, small).union(_products(up, down, member, hub)).union(loops)


def _signed(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(node, hubs): the hubs (column component) that lead to a node, sorted; a hub's own is one of them."""
    frontier = cut(hubs.select(F.col("component").alias("hub"), F.col("component").alias("src")))
    seen = Seen(frontier)
    while not frontier.isEmpty():
        step = frontier.join(edges, "src").select("hub", F.col("dst").alias("src")).distinct()
        frontier = cut(step.join(seen.rows(), ["hub", "src"], "left_anti"))
        seen.add(frontier)
    return seen.rows().groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("hub")).alias("hubs"))


def _products(up: DataFrame, down: DataFrame, member: DataFrame, most: int, units: int = 64) -> DataFrame:
    """Pairs (src, dst) that lead through a hub: nodes of equal hubs ahead with nodes of equal hubs behind, if one of those is in both.

    Either side comes in blocks of about `most` nodes. Two blocks make a unit, and a task opens about `units` of them.
    """
    sides, keyed = [], []
    for side, signed in (("a", up), ("b", down)):
        nodes = signed.join(member.withColumnRenamed("component", "of").withColumnsRenamed({"node": "inner", "of": "node"}), "node", "left").select("hubs", F.coalesce("inner", "node").alias("node"))
        counted = nodes.groupBy("hubs").agg(F.ceil(F.count("*") / most).alias("blocks"))
        dealt = nodes.join(counted, "hubs").groupBy("hubs", F.pmod(F.xxhash64("node"), "blocks").alias("block")).agg(F.collect_list("node").alias("nodes"))
        sides.append(cut(dealt.toDF(f"{side}_hubs", f"{side}_block", f"{side}_nodes")))
        keyed.append(counted.select(F.col("hubs").alias(f"{side}_hubs"), F.explode("hubs").alias("hub")))
    pairs = keyed[0].join(keyed[1], "hub").select("a_hubs", "b_hubs").distinct()
    for side, blocks in zip("ab", sides):
        pairs = pairs.join(blocks.drop(f"{side}_nodes"), f"{side}_hubs")
    pairs = cut(pairs)
    for side, blocks in zip("ab", sides):
        pairs = pairs.join(blocks, [f"{side}_hubs", f"{side}_block"])
    parts = max(int(member.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // units))
    dealt = pairs.repartition(parts, "a_hubs", "a_block", "b_hubs", "b_block")
    return dealt.select(F.explode("a_nodes").alias("src"), "b_nodes").select("src", F.explode("b_nodes").alias("dst"))


def _acyclic_closure(edges: DataFrame, rounds: int) -> DataFrame:
    """Pairs of edges without cycles, but for loops (x, x), which stay."""
    paths, hop = edges, cut(edges.where("src <> dst"))
    joined = lambda a, b: a.toDF("src", "mid").join(b.toDF("mid", "dst"), "mid").select("src", "dst")
    for _ in range(rounds):
        hop = cut(joined(hop, hop).distinct())
        if hop.isEmpty():
            return paths
        steps = paths.where("src <> dst")
        paths = cut(paths.union(hop).union(joined(steps, hop)).distinct())
    raise RuntimeError("closure did not settle")


def _opened(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs with the members of small components in their place. Both ends get their lists before the first is opened, so no pair of nodes is dealt again."""
    lists = cut(member.groupBy("component").agg(F.collect_list("node").alias("nodes")))
    met = pairs.join(lists.toDF("src", "a"), "src", "left").join(lists.toDF("dst", "b"), "dst", "left")
    listed = met.select(F.coalesce("a", F.array("src")).alias("a"), F.coalesce("b", F.array("dst")).alias("b"))
    return listed.select(F.explode("a").alias("src"), "b").select("src", F.explode("b").alias("dst"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes nothing leads to."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def taint(edges: DataFrame | Factored, starts: DataFrame, depth: int) -> DataFrame:
    """For nodes that lead to the starts within `depth` steps, the best route's weakest tier and the least depth that has it.

    States are (node, tier, depth); a state that another beats in both is dropped each round, so there are four a node at
    most. A set is opened again only for a better tier than before.
    """
    g = Factored.of(edges)
    into = cut(g.edges.groupBy("src", "dst").agg(F.min("confidence").alias("confidence")))
    if g.sites is not None:
        sites = cut(g.sites.groupBy("src", "set_id").agg(F.min("confidence").alias("confidence")))
        sets = cut(g.sets.groupBy("set_id", "dst").agg(F.min("confidence").alias("confidence")))
        opened = Seen(sites.select("set_id", F.lit(0).alias("tier")).limit(0))
    frontier = cut(starts.select("node").distinct().select("node", F.lit(-1).alias("tier"), F.lit(0).alias("depth")))
    seen = Seen(frontier)
    for d in range(1, depth + 1):
        step = frontier.join(into, F.col("node") == F.col("dst")).select("src", F.greatest("tier", "confidence").alias("tier"))
        if g.sites is not None:
            new = frontier.join(sets, F.col("node") == F.col("dst")).groupBy("set_id").agg(F.min(F.greatest("tier", "confidence")).alias("tier"))
            new = cut(new.join(opened.rows().groupBy("set_id").agg(F.min("tier").alias("best")), "set_id", "left").where("best is null or tier < best").select("set_id", "tier"))
            step = step.union(new.join(sites, "set_id").select("src", F.greatest("tier", "confidence").alias("tier")))
            opened.add(new)
        step = step.groupBy(F.col("src").alias("node")).agg(F.min("tier").alias("tier"))
        known = seen.rows().groupBy("node").agg(F.min("tier").alias("best"))
        frontier = cut(step.join(known, "node", "left").where("best is null or tier < best").select("node", "tier", F.lit(d).alias("depth")))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.rows().where("depth > 0").groupBy("node").agg(F.min(F.struct("tier", "depth")).alias("b")).select("node", "b.tier", "b.depth").join(starts.select("node"), "node", "left_anti")


def strong_components(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, component) of nodes on cycles; a component is called by its least node.

    A node takes the least label that leads to it and the least one that it leads to, both ways in the same round. Where
    they are the same, the node is in that label's component; edges between nodes that differ in either are in none. Labels
    begin with the nodes of most edges in and out and go by chance among equals, so what is left falls apart quickly.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    for _ in range(rounds):
        left = _trim(left)
        if left.isEmpty():
            break
        state = _labelled(left)
        done = state.where("ahead = back").select("node", F.col("ahead").alias("label"))
        done = cut(done.join(done.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1"), "label").select("node", "component"))
        found = done if found is None else found.unionByName(done)
        open_ = state.where("ahead <> back")
        src, dst = open_.toDF("src", "a", "b"), open_.toDF("dst", "a", "b")
        left = cut(left.join(src, "src").join(dst, ["dst", "a", "b"]).select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return found


def _labelled(edges: DataFrame) -> DataFrame:
    """(node, ahead, back): the least label that leads to a node and the least one that it leads to, its own included. A round sends on what the last one lowered."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(True).alias("out")).union(edges.select("dst", "src", F.lit(False)))
    nodes = both.groupBy("node").agg(F.least(F.count_if("out"), F.count_if(~F.col("out")), F.lit(255)).alias("n"))
    label = (F.shiftleft(F.lit(255) - F.col("n"), 55) + F.monotonically_increasing_id()).alias("ahead")
    state = cut(nodes.sortWithinPartitions(F.xxhash64("node")).select("node", label).select("node", "ahead", F.col("ahead").alias("back"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        sent = both.join(state.where("moved"), "node").groupBy(F.col("to").alias("node")).agg(F.min(F.expr("if(out, ahead, null)")).alias("a"), F.min(F.expr("if(out, null, back)")).alias("b"))
        state = cut(state.join(sent, "node", "left").select("node", F.least("ahead", "a").alias("ahead"), F.least("back", "b").alias("back"), F.expr("coalesce(a < ahead, false) or coalesce(b < back, false)").alias("moved")))
    return state.drop("moved")


def _trim(edges: DataFrame) -> DataFrame:
    """Drops edges of nodes that nothing leads to or that lead nowhere, until none are left or few go at a time."""
    count = None
    while True:
        tails, heads = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
        both = tails.join(heads, "node", "left_semi")
        edges = cut(edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        now = edges.count()
        if not now or count is not None and now > 0.9 * count:
            return edges
        count = now


def dead_cycles(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Components on cycles without a reached member and without an edge from outside; a null src counts as outside."""
    members = strong_components(edges.where("src is not null"))
    live = members.join(reached.select("node"), "node", "left_semi").select("component")
    src = members.select(F.col("node").alias("src"), F.col("component").alias("a"))
    outside = edges.join(members.select(F.col("node").alias("dst"), "component"), "dst").join(src, "src", "left").where("a is null or a <> component").select("component")
    return members.join(live.union(outside).distinct(), "component", "left_anti")


def dot(edges: DataFrame) -> DataFrame:
    """One line of DOT for each edge; dashed unless proven."""
    style = F.when(F.col("confidence") > 1, F.lit(" [style=dashed]")).otherwise("")
    return edges.select(F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('"'), style, F.lit(";")).alias("line"))


def as_json(edges: DataFrame) -> DataFrame:
    """One JSON object for each edge."""
    return edges.select(F.to_json(F.struct(*sorted(edges.columns))).alias("json"))


def ordered_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by a full order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
