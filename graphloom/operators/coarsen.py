"""Coarse mappings of a graph: id -> cid. Random choices are hash priorities, so that each mapping is one fixed function of the graph.

Rounds read the snapshot of the round before; cluster ids are positions of the clusters' roots in id order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.priority import SALT, edge_priority, priority
from graphloom.operators.graph import degrees, vertices_of
from graphloom.plans.in_order import apart_by_two, in_order
from graphloom.plans.iterate import fixpoint, numbered, numbered_within
from graphloom.session import materialise


def number_roots(roots: DataFrame) -> DataFrame:
    """(id, root) as (id, cid): cid is the position of the root among all roots."""
    ids = numbered(roots.select("root").distinct(), "root", name="cid")
    return roots.join(ids, "root").select("id", "cid")


def heavy_neighbour(edges: DataFrame, vertices: DataFrame | None = None, salt: str = SALT) -> DataFrame:
    """id, hn: the neighbour over the heaviest edge, by (weight, priority, id); an isolated vertex has itself."""
    best = edges.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("w", priority("dst", salt).alias("p"), "dst"))["dst"].alias("hn"))
    if vertices is None:
        return best
    return vertices.select("id").join(best, "id", "left").select("id", F.coalesce("hn", "id").alias("hn"))


def hec_rooted(hn: DataFrame) -> DataFrame:
    """id, root by heavy-edge clustering in closed form: of mutual pairs the smaller id; whoever is someone's heavy neighbour, itself; else its heavy neighbour's root."""
    other = hn.select(F.col("id").alias("hn"), F.col("hn").alias("back"))
    wanted = hn.select(F.col("hn").alias("id")).distinct().withColumn("wanted", F.lit(True))
    first = hn.join(other, "hn").join(wanted, "id", "left").select(
        "id", "hn", F.when(F.col("back") == F.col("id"), F.least("id", "hn")).when(F.col("wanted"), F.col("id")).alias("root")
    )
    first = materialise(first, "roots")
    reached = first.where("root is not null").select(F.col("id").alias("hn"), F.col("root").alias("through"))
    return first.join(reached, "hn", "left").select("id", F.coalesce("root", "through").alias("root"))


def hec3(edges: DataFrame, vertices: DataFrame | None = None, salt: str = SALT) -> DataFrame:
    return number_roots(hec_rooted(heavy_neighbour(edges, vertices, salt)))


def hec_serial(edges: DataFrame, vertices: DataFrame | None = None, salt: str = SALT) -> DataFrame:
    """Heavy-edge clustering in visiting order, without a sequential pass.

    A vertex is active if it is unassigned when its turn comes, that is, if no earlier active vertex has it as heavy neighbour; this is
    decided in rounds, each vertex as soon as its earlier suitors are. Inactive vertices are roots; active ones follow their heavy neighbour.
    """
    hn = materialise(heavy_neighbour(edges, vertices, salt).withColumn("p", priority("id", salt)), "heavy")
    here = hn.select(F.col("id").alias("hn"), F.col("p").alias("hp"))
    earlier = materialise(hn.join(here, "hn").where("id <> hn and struct(p, id) < struct(hp, hn)").select(F.col("hn").alias("id"), F.col("id").alias("suitor")), "suitors")

    def decide(state: DataFrame) -> DataFrame:
        told = earlier.join(state.select(F.col("id").alias("suitor"), "active"), "suitor").groupBy("id").agg(
            F.coalesce(F.bool_or("active"), F.lit(False)).alias("any"), F.count_if(F.col("active").isNull()).alias("open")
        )
        now = F.when(F.col("active").isNotNull(), F.col("active")).when(F.col("any"), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        return state.join(told, "id", "left").select("id", "hn", now.alias("active"))

    state = fixpoint(hn.select("id", "hn", F.lit(None).cast("boolean").alias("active")), decide, F.col("active").isNull(), "active")
    up = state.select("id", F.when(F.col("active"), F.col("hn")).otherwise(F.col("id")).alias("up"))
    return number_roots(pointer_jumped(up))


def pointer_jumped(up: DataFrame) -> DataFrame:
    """(id, up) as (id, root), by doubling."""
    up = materialise(up.withColumn("done", F.lit(False)), "pointers")

    def jump(state: DataFrame) -> DataFrame:
        two = state.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        return state.join(two, "up").select("id", F.col("upper").alias("up"), (F.col("up") == F.col("upper")).alias("done"))

    return fixpoint(up, jump, ~F.col("done"), "pointers").select("id", F.col("up").alias("root"))


def hec2(edges: DataFrame, vertices: DataFrame | None = None, salt: str = SALT) -> DataFrame:
    """Heavy-edge clustering in rounds: each vertex accepts its first suitor by priority; accepted pairs that come before those they touch merge; then free vertices join their heavy neighbour's cluster."""
    hn = materialise(heavy_neighbour(edges, vertices, salt).withColumn("p", priority("id", salt)), "heavy")
    state = materialise(hn.select("id", "hn", "p", F.when(F.col("id") == F.col("hn"), F.col("id")).alias("root")), "state")
    before = None
    while left := (free := state.where("root is null")).count():
        if left == before:
            raise RuntimeError(f"hec2: {left} vertices still free, none joined in a round")
        before = left
        both = free.join(free.select(F.col("id").alias("hn")), "hn")
        pairs = both.groupBy("hn").agg(F.min(F.struct("p", "id")).alias("m")).select(F.col("m.id").alias("u"), F.col("hn").alias("v"), F.col("m.p").alias("p"))
        ends = pairs.select(F.col("u").alias("x"), "p", "u").unionByName(pairs.select(F.col("v").alias("x"), "p", "u"))
        first = ends.groupBy("x").agg(F.min(F.struct("p", "u"))["u"].alias("first"))
        taken = pairs.join(first.select(F.col("x").alias("u"), F.col("first").alias("fu")), "u").join(first.select(F.col("x").alias("v"), F.col("first").alias("fv")), "v").where("fu = u and fv = u")
        merged = taken.select(F.col("u").alias("id"), F.col("v").alias("got")).unionByName(taken.select(F.col("v").alias("id"), F.col("v").alias("got")))
        state = materialise(state.join(merged, "id", "left").select("id", "hn", "p", F.coalesce("root", "got").alias("root")), "state")
        known = state.where("root is not null").select(F.col("id").alias("hn"), F.col("root").alias("through"))
        state = materialise(state.join(known, "hn", "left").select("id", "hn", "p", F.coalesce("root", "through").alias("root")), "state")
    return number_roots(state.select("id", "root"))


def matching_pairs(edges: DataFrame, salt: str = SALT) -> DataFrame:
    """a, b (a < b): a maximal matching of locally heaviest edges. Both ends agree on an edge's rank, so the best edge left is taken each round."""
    left, found = materialise(edges.where("src <> dst").withColumn("p", edge_priority("src", "dst", salt)), "open"), None
    while not left.isEmpty():
        best = left.groupBy("src").agg(F.max(F.struct("w", "p", "dst"))["dst"].alias("dst"))
        mutual = best.join(best.select(F.col("src").alias("dst"), F.col("dst").alias("back")), "dst").where("src = back and src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        mutual = materialise(mutual, "pairs")
        found = mutual if found is None else found.unionByName(mutual)
        used = mutual.select(F.explode(F.array("a", "b")).alias("x"))
        left = materialise(left.join(used.select(F.col("x").alias("src")), "src", "left_anti").join(used.select(F.col("x").alias("dst")), "dst", "left_anti"), "open")
    return found if found is not None else edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).limit(0)


def pairs_to_mapping(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs and single vertices as a mapping."""
    own = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a")
    return number_roots(vertices.select("id").join(own, "id", "left").select("id", F.coalesce("a", "id").alias("root")))


def matching(edges: DataFrame, vertices: DataFrame | None = None, salt: str = SALT) -> DataFrame:
    return pairs_to_mapping(matching_pairs(edges, salt), vertices_of(edges) if vertices is None else vertices)


def halved(edges: DataFrame, vertices: DataFrame, salt: str = SALT) -> DataFrame:
    """A mapping to half as many clusters, rounded up, whatever the graph: matched pairs, and the vertices left over by twos in id order."""
    pairs = materialise(matching_pairs(edges, salt), "pairs")
    rest = vertices.select("id").join(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti")
    return pairs_to_mapping(pairs.unionByName(paired_in_order(rest.withColumn("all", F.lit(0)), "all")), vertices)


def paired_in_order(rows: DataFrame, group: str, ident: str = "id") -> DataFrame:
    """a, b: the consecutive ids of each group by twos; an odd one stays alone."""
    ranked = numbered_within(rows.select(group, ident), group, ident, name="n").groupBy(group, F.expr("n div 2").alias("k"))
    return ranked.agg(F.min(ident).alias("a"), F.max(ident).alias("b")).where("a < b").select("a", "b")


def leaf_pairs(edges: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """Free vertices of degree one, paired within their only neighbour."""
    deg = degrees(edges)
    leaves = edges.join(deg.where("deg = 1").select(F.col("id").alias("src")), "src")
    if free is not None:
        leaves = leaves.join(free.select(F.col("id").alias("src")), "src", "left_semi")
    return paired_in_order(leaves.select(F.col("dst").alias("hub"), F.col("src").alias("id")), "hub")


def twin_pairs(edges: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """Free vertices with equal neighbourhoods, paired. Neighbourhoods are compared by size, sum and two hashes, as the lists of hubs may be long."""
    own = edges if free is None else edges.join(free.select(F.col("id").alias("src")), "src", "left_semi")
    wide = lambda x: F.sum(x.cast("decimal(38,0)"))
    digest = own.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.sum("dst").alias("s"), wide(F.xxhash64("dst")).alias("h"), wide(F.xxhash64("dst", F.lit(7))).alias("g"))
    return paired_in_order(digest.select("id", F.concat_ws("/", "n", "s", "h", "g").alias("twin")), "twin")


def relative_round(edges: DataFrame, free: DataFrame, salt: str = SALT) -> DataFrame:
    """One round of pairing free vertices that share a matched neighbour: each hub pairs its free neighbours, each vertex takes the partner of its best hub, mutual ones match."""
    hub = edges.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(free.select(F.col("id").alias("dst")), "dst", "left_anti")
    ranked = numbered_within(hub.select(F.col("dst").alias("hub"), F.col("src").alias("id")), "hub", "id", name="n")
    two = ranked.groupBy("hub", F.expr("n div 2").alias("k")).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    offers = two.select("hub", F.col("a").alias("id"), F.col("b").alias("partner")).unionByName(two.select("hub", F.col("b").alias("id"), F.col("a").alias("partner")))
    best = offers.groupBy("id").agg(F.max(F.struct(priority("hub", salt).alias("p"), "hub", "partner"))["partner"].alias("partner"))
    return best.join(best.select(F.col("id").alias("partner"), F.col("partner").alias("back")), "partner").where("back = id and id < partner").select(F.col("id").alias("a"), F.col("partner").alias("b"))


def two_hop_matching(edges: DataFrame, vertices: DataFrame | None = None, salt: str = SALT, open_share: float = 0.25) -> DataFrame:
    """Matching, and while more than open_share of the vertices are free: leaves, twins, then relatives until no round pairs any."""
    ids = materialise((vertices_of(edges) if vertices is None else vertices).select("id"), "ids")
    total = ids.count()
    pairs = materialise(matching_pairs(edges, salt), "pairs")

    def free() -> DataFrame:
        return ids.join(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti")

    for stage in (lambda f: leaf_pairs(edges, f), lambda f: twin_pairs(edges, f), None):
        while (own := materialise(free(), "free")).count() > open_share * total:
            new = materialise(stage(own) if stage else relative_round(edges, own, salt), "new-pairs")
            pairs = materialise(pairs.unionByName(new), "pairs")
            if stage or new.isEmpty():
                break
    return pairs_to_mapping(pairs, ids)


def mis2(edges: DataFrame, salt: str = SALT) -> DataFrame:
    """id, state (1 in, -1 out): the maximal set without two vertices within two steps, greedy by descending (priority, id). In one task that streams the
    graph; in rounds where it has too many vertices for that."""
    done = in_order(edges.select(F.col("src").alias("id"), F.col("dst").alias("via")), apart_by_two, salt, descending=True)
    return mis2_by_rounds(edges, salt) if done is None else done.withColumnRenamed("value", "state")


def mis2_by_rounds(edges: DataFrame, salt: str = SALT) -> DataFrame:
    """The same: in each round, undecided vertices that are the largest within two steps come in, and those near them go out."""
    closed = materialise(edges.select("src", "dst").unionByName(edges.select("src", F.col("src").alias("dst")).distinct()), "closed")

    def spread(values: DataFrame) -> DataFrame:
        return closed.join(values.select(F.col("id").alias("dst"), "t"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("t").alias("t"))

    def step(state: DataFrame) -> DataFrame:
        own = state.select("id", F.struct("state", "p", "id").alias("t"))
        top = spread(spread(own)).select("id", F.col("t").alias("top"))
        now = F.when(F.col("state") != 0, F.col("state")).when(F.col("top.id") == F.col("id"), F.lit(1)).when(F.col("top.state") == 1, F.lit(-1)).otherwise(F.lit(0))
        return state.join(top, "id").select("id", "p", now.alias("state"))

    start = vertices_of(edges).select("id", priority("id", salt).alias("p"), F.lit(0).alias("state"))
    return fixpoint(start, step, F.col("state") == 0, "mis2").select("id", "state")


def mis2_aggregation(edges: DataFrame, salt: str = SALT) -> DataFrame:
    """Set vertices are roots; their neighbours join them; the others join the adjacent cluster of the heaviest edge (then priority, id)."""
    state = materialise(mis2(edges, salt), "mis2")
    roots = state.where("state = 1").select("id", F.col("id").alias("root"))
    near = edges.join(roots.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("root").alias("root"))
    known = materialise(roots.unionByName(near.join(roots.select("id"), "id", "left_anti")), "near")
    rest = state.join(known, "id", "left_anti").select(F.col("id").alias("src"))
    far = edges.join(rest, "src").join(known.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.max(F.struct("w", priority("dst", salt).alias("p"), "dst", "root"))["root"].alias("root"))
    return number_roots(known.unionByName(far))


def gosh(edges: DataFrame, salt: str = SALT) -> DataFrame:
    """Independent set by descending (degree, id), where edges between two vertices above the average degree do not count; the others join the neighbour in the set of highest degree."""
    deg = materialise(degrees(edges).select("id", "deg"), "degrees")
    average = deg.agg(F.expr("sum(deg) div count(*)")).first()[0]
    both = edges.join(deg.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    light = materialise(both.where(f"not (ds > {average} and dd > {average})").select("src", "dst"), "light")

    def step(state: DataFrame) -> DataFrame:
        live = state.where("state >= 0").select(F.col("id").alias("dst"), F.struct("state", "deg", "id").alias("t"))
        top = light.join(live, "dst").groupBy(F.col("src").alias("id")).agg(F.max("t").alias("t"))
        own = F.struct("state", "deg", "id")
        now = F.when(F.col("state") != 0, F.col("state")).when(F.col("t.state") == 1, F.lit(-1)).when(F.col("t").isNull() | (own > F.col("t")), F.lit(1)).otherwise(F.lit(0))
        return state.join(top, "id", "left").select("id", "deg", now.alias("state"))

    state = materialise(fixpoint(deg.withColumn("state", F.lit(0)), step, F.col("state") == 0, "gosh"), "gosh")
    roots = state.where("state = 1").select("id", "deg")
    rest = edges.join(state.where("state = -1").select(F.col("id").alias("src")), "src").join(roots.select(F.col("id").alias("dst"), "deg"), "dst")
    joined = rest.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("deg", "dst"))["dst"].alias("root"))
    return number_roots(roots.select("id", F.col("id").alias("root")).unionByName(joined))


def gosh2_seeds(edges: DataFrame, least: int = 50) -> DataFrame:
    """id: vertices whose degree is above the average (integer division) and above `least`."""
    deg = degrees(edges).select("id", "deg")
    average = deg.agg(F.expr("sum(deg) div count(*)").alias("a"))  # one row
    return deg.crossJoin(F.broadcast(average)).where(F.col("deg") > F.greatest(F.lit(least), "a")).select("id")


def gosh2_stage(edges: DataFrame, known: DataFrame, by: str, salt: str = SALT) -> DataFrame:
    """(id, root) of the vertices that join a neighbour's cluster: that of the heaviest edge (by = w) or of the highest degree (by = deg)."""
    offers = edges.join(known.select(F.col("id").alias("src")), "src", "left_anti").join(known.select(F.col("id").alias("dst"), "root"), "dst")
    if by == "deg":
        offers = offers.join(degrees(edges).select(F.col("id").alias("dst"), "deg"), "dst")
    return offers.groupBy(F.col("src").alias("id")).agg(F.max(F.struct(by, priority("dst", salt).alias("p"), "dst", "root"))["root"].alias("root"))


def gosh2(edges: DataFrame, salt: str = SALT) -> DataFrame:
    """Seeds; neighbours by weight, then by degree; what is left by heavy-edge clustering, which may end in known clusters."""
    known = materialise(gosh2_seeds(edges).withColumn("root", F.col("id")), "seeds")
    for by in ("w", "deg"):
        known = materialise(known.unionByName(gosh2_stage(edges, known, by, salt)), "clustered")
    hn = heavy_neighbour(edges, None, salt).join(known.select("id"), "id", "left_anti")
    into = hn.join(known.select(F.col("id").alias("hn"), "root"), "hn").select("id", "root")
    alone = hn.join(known.select(F.col("id").alias("hn")), "hn", "left_anti").select("id", "hn")
    return number_roots(known.unionByName(materialise(into, "joined")).unionByName(hec_rooted(alone)))


def weighted_aggregation(edges: DataFrame, share: float = 0.3, salt: str = SALT) -> DataFrame:
    """id, rep, v: interpolation weights. In priority order a vertex becomes a representative if less than `share` of its weight leads to earlier ones; the others spread over all representatives beside them."""
    ids = vertices_of(edges).select("id", priority("id", salt).alias("p"))
    a, b = ids.select(F.col("id").alias("src"), F.col("p").alias("ps")), ids.select(F.col("id").alias("dst"), F.col("p").alias("pd"))
    earlier = materialise(edges.join(a, "src").join(b, "dst").where("struct(pd, dst) < struct(ps, src)").select("src", "dst", "w"), "earlier")
    total = degrees(edges).select("id", "wdeg")

    def decide(state: DataFrame) -> DataFrame:
        told = earlier.join(state.select(F.col("id").alias("dst"), "rep"), "dst").groupBy(F.col("src").alias("id")).agg(
            F.sum(F.when(F.col("rep"), F.col("w")).otherwise(0)).alias("to"), F.count_if(F.col("rep").isNull()).alias("open")
        )
        now = F.when(F.col("rep").isNotNull(), F.col("rep")).when(F.coalesce("to", F.lit(0)) >= share * F.col("wdeg"), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        return state.join(told, "id", "left").select("id", "wdeg", now.alias("rep"))

    state = fixpoint(total.withColumn("rep", F.lit(None).cast("boolean")), decide, F.col("rep").isNull(), "representatives")
    reps = state.where("rep").select(F.col("id").alias("dst"))
    shares = edges.join(state.where("not rep").select(F.col("id").alias("src")), "src").join(reps, "dst")
    sums = shares.groupBy("src").agg(F.sum("w").alias("s"))
    spread = shares.join(sums, "src").select(F.col("src").alias("id"), F.col("dst").alias("rep"), (F.col("w") / F.col("s")).alias("v"))
    return spread.unionByName(reps.select(F.col("dst").alias("id"), F.col("dst").alias("rep"), F.lit(1.0).alias("v")))


def within_parts(edges: DataFrame, part: DataFrame) -> DataFrame:
    """The edges whose ends have one label; part: id, part."""
    a, b = part.select(F.col("id").alias("src"), F.col("part").alias("a")), part.select(F.col("id").alias("dst"), F.col("part").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a = b").select("src", "dst", "w")


def recoarsen_hec(edges: DataFrame, part: DataFrame, salt: str = SALT) -> DataFrame:
    """Heavy-edge clustering that keeps to the parts; a vertex without a neighbour in its part takes the next of its part in priority order, cyclically."""
    best = heavy_neighbour(within_parts(edges, part), None, salt)
    lone = part.join(best.select("id"), "id", "left_anti").withColumn("p", priority("id", salt))
    ranked = numbered(lone.select("id", "part", "p"), "part", "p", "id", name="nr")
    after = ranked.select((F.col("nr") - 1).alias("nr"), F.col("id").alias("next"), F.col("part").alias("next_part"))
    first = ranked.groupBy("part").agg(F.min(F.struct("p", "id"))["id"].alias("first"))
    ring = ranked.join(after, "nr", "left").join(first, "part").select("id", F.when(F.col("next_part") == F.col("part"), F.col("next")).otherwise(F.col("first")).alias("hn"))
    return number_roots(hec_rooted(best.unionByName(ring)))


def recoarsen_matching(edges: DataFrame, part: DataFrame, salt: str = SALT) -> DataFrame:
    """Matching with leaves and relatives that keeps to the parts."""
    return two_hop_matching(within_parts(edges, part), part.select("id"), salt)
