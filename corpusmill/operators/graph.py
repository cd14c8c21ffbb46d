"""Graph questions as joins over an edge table. Iterations stop on an empty frontier and checkpoint each round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """(id, kind, neighbor) for the requested ids; direction out, in or both."""
    parts = []
    if direction in ("out", "both"):
        parts.append(edges.select(F.col("src").alias("id"), "kind", F.col("dst").alias("neighbor")))
    if direction in ("in", "both"):
        parts.append(edges.select(F.col("dst").alias("id"), "kind", F.col("src").alias("neighbor")))
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def degree_warnings(edges: DataFrame, limit: int = 15) -> DataFrame:
    """(id, kind, degree) of nodes with more than ``limit`` out-edges of one kind."""
    return edges.groupBy(F.col("src").alias("id"), "kind").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > limit)


def edge_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, edges, resolved, external, dangling_src, dangling_dst, external_without_ref).

    edges: (src, dst, kind, external, external_ref). The node table is joined as a distinct key set on each end.
    """
    keys = nodes.select("id").distinct()
    j = edges.join(keys.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(
        keys.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    c = lambda cond, name: F.count_if(cond).cast("bigint").alias(name)
    ext, s, d = F.col("external"), F.col("_s").isNotNull(), F.col("_d").isNotNull()
    return j.groupBy("kind").agg(
        F.count(F.lit(1)).alias("edges"), c(~ext & s & d, "resolved"), c(ext, "external"), c(~s, "dangling_src"),
        c(~ext & ~d, "dangling_dst"), c(ext & F.col("external_ref").isNull(), "external_without_ref"))


def walk_through(links: DataFrame, own: DataFrame) -> DataFrame:
    """(node, lo, hi): the smallest and largest value that a node has itself or reaches over its links.

    links: (node, over); own: (node, lo, hi), at most one row a node. In each round a node takes the values of the nodes it links
    to. A link to a node that has a single link itself then points to where that one does, so a chain is walked in steps of doubling length; a
    link to a node without links is done with. Links never become more. When a round changes no value, none will change later:
    every node already has what its links offer, and so what their links offer. Only changed values are written.
    """
    links = cut_lineage(links.filter("node <> over").distinct())
    parts = cut_lineage(own.select("node", "lo", "hi"))
    while True:
        known = parts.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        offered = links.join(known.withColumnRenamed("node", "over"), "over").groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        old = known.select("node", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        new = cut_lineage(offered.join(old, "node", "left").filter("_lo IS NULL OR lo < _lo OR hi > _hi").select("node", "lo", "hi"))
        if new.isEmpty():
            return known
        onward = links.groupBy(F.col("node").alias("over")).agg(F.count(F.lit(1)).alias("n"), F.min("over").alias("next"))
        links = cut_lineage(links.join(onward, "over").select("node", F.when(F.col("n") == 1, F.col("next")).otherwise(F.col("over")).alias("over"))
                            .filter("node <> over").distinct())
        parts = parts.unionByName(new)


def resolve_supersession(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Live-successor state per record: (rvid, immediate_live, conflicted, has_live_successor).

    records: (rvid, namespace, status); edges: (src, dst) meaning src supersedes dst. A walk goes on through
    successors that are not current and stops at current ones; edges across namespaces do not count.

    Worked out on nodes, not on (start, node) pairs: each node carries the smallest and the largest live record it can
    reach (``walk_through``). A cycle cannot make a record its own successor, because a pair equal to the record itself on
    both ends counts as nothing.
    """
    keyed = records.select("rvid", "namespace", "status")
    a, b = keyed.alias("a"), keyed.alias("b")
    hop = cut_lineage(
        edges.select("src", "dst").distinct().filter("src <> dst").alias("e")
        .join(a, F.col("e.src") == F.col("a.rvid")).join(b, F.col("e.dst") == F.col("b.rvid"))
        .filter("a.namespace = b.namespace")
        .select(F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), (F.col("a.status") == "current").alias("live")))
    direct = hop.filter("live").groupBy("dst").agg(
        F.count(F.lit(1)).alias("immediate_live"), F.min("src").alias("lo"), F.max("src").alias("hi"))
    reach = walk_through(hop.filter("NOT live").select(F.col("dst").alias("node"), F.col("src").alias("over")),
                         direct.select(F.col("dst").alias("node"), "lo", "hi")).withColumnRenamed("node", "rvid")
    return (
        keyed.select("rvid").join(reach, "rvid", "left")
        .join(direct.select(F.col("dst").alias("rvid"), "immediate_live"), "rvid", "left")
        .select("rvid", F.coalesce("immediate_live", F.lit(0)).cast("bigint").alias("immediate_live"),
                (F.coalesce("immediate_live", F.lit(0)) >= 2).alias("conflicted"),
                F.coalesce((F.col("lo") != F.col("rvid")) | (F.col("hi") != F.col("rvid")), F.lit(False)).alias("has_live_successor")))


def effective_current(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """(rvid, effective_current): status current and no live successor; chunks are judged by their status alone."""
    r = records.select("rvid", "kind", "status").join(resolved.select("rvid", "has_live_successor"), "rvid", "left")
    cur = F.col("status") == "current"
    return r.select("rvid", F.when(F.col("kind") == "source_chunk", cur).otherwise(
        cur & ~F.coalesce("has_live_successor", F.lit(False))).alias("effective_current"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start has an edge into it and whose end has one out of it."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
        edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _chains(edges: DataFrame) -> DataFrame:
    """(id, prev, next) of nodes with one edge in and one out, from and to other nodes."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_o"), F.min("dst").alias("next"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_i"), F.min("src").alias("prev"))
    return out.join(into, "id").filter("_o = 1 AND _i = 1 AND next <> id AND prev <> id").select("id", "prev", "next")


def _jumped(chain: DataFrame, size: int) -> DataFrame:
    """The same with prev and next outside the chains: pointers over chain nodes double until they leave them. On a cycle of chain nodes
    alone they never do, and stay inside after as many steps as there are nodes."""
    steps = 1
    while steps <= size:
        one = chain.join(chain.select(F.col("id").alias("next"), F.col("next").alias("_n")), "next", "left").withColumn("next", F.coalesce("_n", "next")).drop("_n")
        both = one.join(chain.select(F.col("id").alias("prev"), F.col("prev").alias("_p")), "prev", "left")
        moved = cut_lineage(both.select("id", F.coalesce("_p", "prev").alias("prev"), "next", F.col("_p").isNotNull().alias("_m")))
        chain, steps = moved.drop("_m"), steps * 2
        if moved.filter("_m").isEmpty():
            break
    return chain


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, scc): in a graph where every node has edges in and out, each node takes the largest id that reaches it as its colour; the nodes of a colour
    that reach the node it is named after are a strongly connected component with it. Components found are returned, other nodes are not."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    colour = cut_lineage(nodes.withColumn("c", F.col("id")))
    while True:
        pushed = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("_c"))
        new = cut_lineage(colour.join(pushed, "id", "left").select("id", F.greatest("c", "_c").alias("c"), (F.col("_c") > F.col("c")).alias("_m")))
        colour = new.drop("_m")
        if new.filter("_m").isEmpty():
            break
    inside = cut_lineage(edges.join(colour.withColumnRenamed("id", "src"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("_d")), "dst").filter("c = _d").select("src", "dst", "c"))
    found = front = cut_lineage(colour.filter("id = c"))
    while not front.isEmpty():
        back = inside.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "c").distinct()
        front = cut_lineage(back.join(found.select("id"), "id", "left_anti"))
        found = found.unionByName(front)
    return found.select("id", F.col("c").alias("scc"))


def cycle_components(edges: DataFrame) -> DataFrame:
    """(id, scc) of the nodes on directed cycles; ``scc`` names the strongly connected component they are on cycles of.

    Three steps repeat until no edge is left. Loose ends (no edge in, or none out) go. Chains of nodes with one edge in and one out
    become one edge, by pointers of doubling length; whether such nodes are on a cycle is decided with the edge. What remains
    branches everywhere; its components are found by colouring. Rounds grow with the logarithm of a chain's or a tree's
    length, and with the distances between branching nodes.
    """
    left = cut_lineage(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    labels, waiting = [], []
    while not left.isEmpty():
        size = left.count()
        slim = cut_lineage(_trimmed(_trimmed(left)))
        chain = cut_lineage(_chains(slim))
        n = chain.count()
        if n:
            jumped = cut_lineage(_jumped(chain, n))
            ids = jumped.select("id")
            rings = cut_lineage(jumped.join(ids.withColumnRenamed("id", "next"), "next", "left_semi"))
            if not rings.isEmpty():
                labels.append(_named_rings(rings, chain))
            open_ = cut_lineage(jumped.join(rings.select("id"), "id", "left_anti"))
            waiting.append(open_)
            kept = slim.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
            slim = cut_lineage(kept.unionByName(open_.select(F.col("prev").alias("src"), F.col("next").alias("dst"))).distinct())
        now = slim.count()
        if now == size:                                     # nothing loose and no chain: only branching nodes
            found = cut_lineage(_coloured(slim))
            sizes = found.groupBy("scc").agg(F.count(F.lit(1)).alias("_k"))
            selfish = slim.filter("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("_self"))
            labels.append(cut_lineage(found.join(sizes, "scc").join(selfish, "id", "left").filter("_k > 1 OR _self").select("id", "scc")))
            gone = found.select("id")
            slim = cut_lineage(slim.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        left = slim
    known = edges.select(F.col("src").alias("id"), F.col("src").alias("scc")).limit(0)
    for part in labels:
        known = known.unionByName(part)
    known = cut_lineage(known)
    for open_ in reversed(waiting):                      # chains were contracted in this order; the last ones hang on nodes of later rounds
        a = known.select(F.col("id").alias("prev"), F.col("scc").alias("_a"))
        b = known.select(F.col("id").alias("next"), F.col("scc").alias("_b"))
        known = cut_lineage(known.unionByName(open_.join(a, "prev").join(b, "next").filter("_a = _b").select("id", F.col("_a").alias("scc"))))
    return known


def _named_rings(rings: DataFrame, chain: DataFrame) -> DataFrame:
    """(id, scc) of cycles of chain nodes alone: the smallest id, found by steps of doubling length."""
    now = chain.join(rings.select("id"), "id", "left_semi").select("id", "next", F.col("id").alias("scc"))
    while True:
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("scc").alias("_s"))
        new = cut_lineage(now.join(ahead, "next").select("id", F.col("_n").alias("next"), F.least("scc", "_s").alias("scc"), (F.col("_s") < F.col("scc")).alias("_m")))
        now = new.drop("_m")
        if new.filter("_m").isEmpty():
            return now.select("id", "scc")


def cycle_members(edges: DataFrame) -> DataFrame:
    """(id) of nodes on directed cycles. Nodes between two cycles are not on one."""
    return cycle_components(edges).select("id")


def ancestors(edges: DataFrame, seeds: DataFrame, max_depth: int = 32) -> DataFrame:
    """(id, ancestor, depth) following child -> parent edges; a parent relation, so one row per level and seed."""
    up = edges.select(F.col("child").alias("at"), F.col("parent").alias("ancestor"))
    step = cut_lineage(seeds.select("id", F.col("id").alias("at")).join(up, "at").select("id", "ancestor", F.lit(1).cast("bigint").alias("depth")))
    levels = [step]
    for d in range(2, max_depth + 1):
        step = cut_lineage(levels[-1].select("id", F.col("ancestor").alias("at")).join(up, "at").select(
            "id", "ancestor", F.lit(d).cast("bigint").alias("depth")))
        if step.isEmpty():
            break
        levels.append(step)
    else:
        raise ValueError(f"parent relation deeper than {max_depth} (or cyclic)")
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def contradictions(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(reason, a, b, n): a logical record with several current versions, and declared contradictions between members.

    Declared pairs are unordered and listed once; versions of one record are summarised, not paired.
    """
    multi = selected.filter("status = 'current'").groupBy("record_id").agg(
        F.count_distinct("rvid").alias("n"), F.min("rvid").alias("a"), F.max("rvid").alias("b")).filter("n > 1").select(
        F.lit("multiple_current").alias("reason"), "a", "b", "n")
    ids = selected.select("rvid").distinct()
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    declared = pairs.join(ids.withColumnRenamed("rvid", "a"), "a", "left_semi").join(
        ids.withColumnRenamed("rvid", "b"), "b", "left_semi").select(
        F.lit("declared").alias("reason"), "a", "b", F.lit(2).cast("bigint").alias("n"))
    return multi.unionByName(declared)


def cross_namespace_edges(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two known ends live in different namespaces."""
    r = records.select("rvid", "namespace")
    return (
        edges.join(r.select(F.col("rvid").alias("src"), F.col("namespace").alias("src_ns")), "src")
        .join(r.select(F.col("rvid").alias("dst"), F.col("namespace").alias("dst_ns")), "dst")
        .filter("src_ns <> dst_ns").select("src", "dst", "kind", "src_ns", "dst_ns"))


def resolve_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(src_path, target) -> resolved path and how: relative join, literal path, unique basename (in any case), else external.

    Quotes around a target are dropped, backslashes are slashes, empty and ``.`` segments vanish, ``..`` takes the segment
    before it, and above the root nothing.
    """
    paths = files.select("source_path").distinct()
    base = paths.groupBy(F.lower(F.element_at(F.split("source_path", "/"), -1)).alias("_base")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("source_path").alias("_unique")).filter("_n = 1").select("_base", "_unique")
    plain = F.translate(F.regexp_replace(F.trim("target"), r"""^["']+|["']+$""", ""), "\\", "/")
    joined = F.concat(F.regexp_replace("src_path", "[^/]*$", ""), plain)
    folded = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda path, part: F.when(part.isin("", "."), path).when(
        part == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.array_append(path, part)))
    q = refs.withColumn("_rel", F.array_join(folded, "/")).withColumn("_lit", F.regexp_replace(plain, "^[./]+", "")).withColumn(
        "_base", F.lower(F.element_at(F.split(plain, "/"), -1)))
    q = q.join(paths.select(F.col("source_path").alias("_rel"), F.col("source_path").alias("_r1")), "_rel", "left")
    q = q.join(paths.select(F.col("source_path").alias("_lit"), F.col("source_path").alias("_r2")), "_lit", "left")
    q = q.join(base, "_base", "left")
    return q.select(
        "src_path", "target", F.coalesce("_r1", "_r2", "_unique").alias("resolved"),
        F.when(F.col("_r1").isNotNull(), "relative").when(F.col("_r2").isNotNull(), "literal")
        .when(F.col("_unique").isNotNull(), "basename").otherwise("external").alias("how"))


def derive_relationships(files: DataFrame, facts: DataFrame, module: Column, is_test: Column, is_manifest: Column) -> DataFrame:
    """(src, kind, dst): in_module, tests, skill_of_module from paths; produces, consumes from facts.

    facts: (module, role produced|referenced, name). A module consumes what it references but does not produce itself.
    """
    f = files.withColumn("_m", module)
    parts = [
        f.select(F.col("source_path").alias("src"), F.lit("in_module").alias("kind"), F.col("_m").alias("dst")),
        f.filter(is_test).select(F.col("source_path").alias("src"), F.lit("tests").alias("kind"), F.col("_m").alias("dst")),
        f.filter(is_manifest).select(F.col("source_path").alias("src"), F.lit("skill_of_module").alias("kind"), F.col("_m").alias("dst")),
    ]
    roles = facts.groupBy("module", "name").agg(
        F.bool_or(F.col("role") == "produced").alias("p"), F.bool_or(F.col("role") == "referenced").alias("r"))
    parts.append(roles.filter("p").select(F.col("module").alias("src"), F.lit("produces").alias("kind"), F.col("name").alias("dst")))
    parts.append(roles.filter("r AND NOT p").select(F.col("module").alias("src"), F.lit("consumes").alias("kind"), F.col("name").alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def coverage_gaps(harvest: DataFrame, entities: DataFrame) -> DataFrame:
    """(gap, id): harvested items without an entity and entities without a harvested backing. One outer join."""
    h, e = harvest.select("id").distinct().withColumn("_h", F.lit(1)), entities.select("id").distinct().withColumn("_e", F.lit(1))
    return h.join(e, "id", "full_outer").filter("_h IS NULL OR _e IS NULL").select(
        F.when(F.col("_e").isNull(), "no_entity").otherwise("unbacked_entity").alias("gap"), "id")


def field_conflicts(a: DataFrame, b: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(id, field, a_value, b_value) where both sources give a value and the values differ."""
    j = a.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields]).join(
        b.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields]), key)
    rows = F.array(*[F.when(F.col(f"a_{f}") != F.col(f"b_{f}"), F.struct(
        F.lit(f).alias("field"), F.col(f"a_{f}").alias("a_value"), F.col(f"b_{f}").alias("b_value"))) for f in fields])
    return j.select(key, F.inline(F.array_compact(rows)))


def load_bearing(entities: DataFrame, refs: DataFrame, own_rule: Column) -> DataFrame:
    """(id, load_bearing): by its own attributes or because something refers to it."""
    r = refs.select("id").distinct().withColumn("_r", F.lit(True))
    return entities.join(r, "id", "left").select("id", (F.coalesce(own_rule, F.lit(False)) | F.coalesce("_r", F.lit(False))).alias("load_bearing"))


def uncovered_fields(entities: DataFrame) -> DataFrame:
    """(id, field): populated fields that no source of the entity vouches for ('*' vouches for all). Row-local."""
    covered = F.flatten(F.transform("sources", lambda s: s["fields"]))
    missing = F.when(F.array_contains(covered, "*"), F.array().cast("array<string>")).otherwise(F.array_except("populated", covered))
    return entities.select("id", F.explode(missing).alias("field"))


def resolve_alias(entities: DataFrame, args: DataFrame) -> DataFrame:
    """(arg, id, outcome): an argument must match the id, or exactly one entity by alias; otherwise ambiguous or unknown."""
    names = entities.select("id", F.explode(F.array_union(F.array("id"), "aliases")).alias("name"))
    uniq = names.groupBy(F.lower("name").alias("_k")).agg(
        F.count_distinct("id").alias("n"), F.min("id").alias("one"),
        F.max(F.when(F.lower("id") == F.lower("name"), F.col("id"))).alias("exact"))
    q = args.select("arg").distinct().withColumn("_k", F.lower(F.trim("arg"))).join(uniq, "_k", "left")
    hit = F.coalesce("exact", F.when(F.col("n") == 1, F.col("one")))
    return q.select("arg", hit.alias("id"), F.when(hit.isNotNull(), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unknown").alias("outcome"))
