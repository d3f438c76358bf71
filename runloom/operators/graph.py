"""Dependency graphs as tables of nodes and edges, many graphs at a time (``key`` tells them apart)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored


def roots(nodes: DataFrame, edges: DataFrame, key: str = "run_rowid", node: str = "task_idx") -> DataFrame:
    """Nodes that depend on nothing."""
    return nodes.select(key, node).join(edges.select(key, F.col("dst").alias(node)), [key, node], "left_anti")


def neighbours(edges: DataFrame, key: str = "run_rowid") -> DataFrame:
    """Sorted direct dependencies and dependents of every node that has any."""
    up = edges.select(key, F.col("dst").alias("node"), F.col("src").alias("dep"), F.lit(None).cast("int").alias("dependent"))
    down = edges.select(key, F.col("src").alias("node"), F.lit(None).cast("int").alias("dep"), F.col("dst").alias("dependent"))
    lists = [F.sort_array(F.collect_list(c)).alias(f"{c}s") for c in ("dep", "dependent")]
    return up.unionByName(down).groupBy(key, "node").agg(*lists)


#: Rows (nodes and edges) of a graph that is worked on as one row; larger graphs go level by level.
SMALL_GRAPH = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the graphs that are small, and of those that are not, or None if there are none of these."""
    large = stored(rows.groupBy(key).count().where(F.col("count") > SMALL_GRAPH).select(key))
    if large.isEmpty():
        return rows, None
    return rows.join(large, key, "left_anti"), rows.join(large, key, "left_semi")


#: Groups in which rows are counted; only in one that holds many rows can there be a large graph.
GROUPS = 1 << 15


def beyond(rows: DataFrame, key: str, most: int) -> tuple[int, DataFrame | None]:
    """Number of rows, and the keys of the graphs that have more than ``most``, or None if there are none.

    Rows are counted in groups of keys, so that little is shuffled, and by key only in groups of more than ``most``.
    """
    group = F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")
    counts = rows.groupBy(group.alias("g")).count()
    n, full = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.collect_list(F.when(F.col("count") > most, F.col("g")))).first()
    if not full:
        return n, None
    held = rows if len(full) == GROUPS else rows.where(F.array_contains(F.lit(full), group))
    large = stored(held.groupBy(key).count().where(F.col("count") > most).select(key))
    return n, None if large.isEmpty() else large


def levels(ids: Column, sources: Column) -> Column:
    """Longest path from a root to each of ``ids``; not less than their number for nodes on or behind a cycle.

    ``sources``: for each id the ids it depends on. As many rounds as there are ids, each of which takes every node one
    further than its dependencies. Nodes that depend on one that is not there are behind a cycle, too.
    """
    endless = 1 << 20
    places = F.transform(sources, lambda own: F.transform(own, lambda x: F.array_position(ids, x).cast("int")))
    further = lambda seen, own: F.coalesce(F.array_max(F.transform(own, lambda p: F.when(p == 0, endless).otherwise(F.get(seen, p - 1)))) + 1, F.lit(0))
    return let(places, lambda of: F.aggregate(ids, F.transform(ids, lambda _: F.lit(0)), lambda seen, _: F.transform(of, lambda own: further(seen, own))))


def graphs(rows: DataFrame, key: str, *attributes: str) -> DataFrame:
    """(key, ids, sources, attributes): one row for each graph, with arrays that go by node.

    rows: key, node, src, attributes. One with src is an edge to node; one without is a node, with what attributes it has
    (of several values of one the largest). Sources are the ids that a node depends on.
    """
    listed = rows.groupBy(key).agg(F.collect_list(F.struct("node", "src", *attributes)).alias("_rows"))
    ids = F.array_distinct(F.transform("_rows", lambda r: r["node"]))

    def values(c: str) -> Callable[[Column], Column]:
        return lambda x: F.transform(F.filter("_rows", lambda r: (r["node"] == x) & r[c].isNotNull()), lambda r: r[c])

    def largest(c: str) -> Callable[[Column], Column]:
        return lambda x: F.array_max(values(c)(x))

    made = let(ids, lambda own: F.struct(own.alias("ids"), F.transform(own, values("src")).alias("sources"), *[F.transform(own, largest(c)).alias(c) for c in attributes]))
    return listed.select(key, made.alias("_graph")).select(key, "_graph.*")


def layers(nodes: DataFrame, edges: DataFrame, key: str = "run_rowid", node: str = "task_idx") -> DataFrame:
    """Longest path to each node from a root; nodes on or behind a cycle have none and are left out.

    The nodes and edges of a small graph meet in one row, by one shuffle; larger graphs are peeled level by level.
    """
    kind = nodes.schema[node].dataType.simpleString()
    rows = nodes.select(key, F.col(node).alias("node"), F.lit(None).cast(kind).alias("src")).unionByName(edges.select(key, F.col("dst").cast(kind).alias("node"), F.col("src").cast(kind).alias("src")))
    small, large = split(stored(rows), key)
    found = graphs(small, key).select(key, "ids", levels(F.col("ids"), F.col("sources")).alias("layers"))
    found = found.select(key, F.size("ids").alias("n"), F.explode(F.arrays_zip("ids", "layers")).alias("x")).where("x.layers < n")
    found = found.select(key, F.col("x.ids").alias(node), F.col("x.layers").alias("layer"))
    if large is None:
        return found
    return found.unionByName(peeled_layers(large.where("src is null").select(key, F.col("node").alias(node)), large.where("src is not null").select(key, "src", F.col("node").alias("dst")), key, node))


def peeled_layers(nodes: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """Layers level by level; a node's layer is the round in which its last dependency was peeled."""
    edges = stored(edges.select(key, "src", "dst"))  # read in every round
    degree = stored(edges.groupBy(key, F.col("dst").alias(node)).agg(F.count("*").alias("n_edges")))
    fresh = stored(roots(nodes, edges, key, node).distinct().withColumn("layer", F.lit(0)))
    done, met, depth = fresh, None, 0
    while not fresh.isEmpty():
        depth += 1
        reached = edges.join(fresh.select(key, F.col(node).alias("src")), [key, "src"]).groupBy(key, F.col("dst").alias(node)).agg(F.count("*").alias("n"))
        met = reached if met is None else met.unionByName(reached)
        met = stored(met.groupBy(key, node).agg(F.sum("n").alias("n")))
        fresh = stored(met.join(degree, [key, node]).where("n = n_edges").select(key, node, F.lit(depth).alias("layer")))
        met = met.join(fresh.select(key, node), [key, node], "left_anti")
        done = done.unionByName(fresh)
    return done


def topological_order(nodes: DataFrame, edges: DataFrame, key: str = "run_rowid", node: str = "task_idx") -> DataFrame:
    """A valid order of each graph: by layer, then node."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("layer", node)) - 1
    return layers(nodes, edges, key, node).select(key, node, place.cast("int").alias("position"))


def bits() -> Column:
    """The bit of each of 64 nodes; SMALL_GRAPH rows have no more."""
    return F.array(*[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("bigint") for i in range(64)])


def reach(ids: Column, sources: Column) -> Column:
    """For each node of a small graph the nodes that lead to it, as bits."""
    places = F.transform(sources, lambda own: F.transform(own, lambda x: F.array_position(ids, x).cast("int")))
    gathered = lambda seen, own: F.aggregate(own, F.lit(0).cast("bigint"), lambda m, p: m.bitwiseOR(F.get(bits(), p - 1)).bitwiseOR(F.get(seen, p - 1)))
    none = F.transform(ids, lambda _: F.lit(0).cast("bigint"))
    return let(places, lambda of: F.aggregate(ids, none, lambda seen, _: F.transform(of, lambda own: gathered(seen, own))))


def cyclic_nodes(edges: DataFrame, key: str = "run_rowid") -> DataFrame:
    """Nodes on a cycle, self loops included; not those that only lie between cycles.

    In a small graph a node is on a cycle if it reaches itself. Of larger graphs chains are contracted first, round by round.
    """
    kind = edges.schema["src"].dataType.simpleString()
    pairs = edges.select(key, F.col("dst").cast(kind).alias("node"), "src").distinct()
    rows = stored(pairs.unionByName(pairs.select(key, F.col("src").alias("node"), F.lit(None).cast(kind).alias("src"))))
    small, large = split(rows, key)
    starts = graphs(small, key)
    starts = starts.select(key, "ids", reach(F.col("ids"), F.col("sources")).alias("reach"))
    reached = starts.select(key, F.posexplode(F.arrays_zip("ids", "reach")).alias("i", "x"))
    found = reached.where(F.col("x.reach").bitwiseAND(F.get(bits(), F.col("i"))) != 0).select(key, F.col("x.ids").alias("node"))
    return found if large is None else found.unionByName(_strongly_connected(large.where("src is not null").select(key, "src", F.col("node").alias("dst")), key))


#: Edges of a graph that one task takes; what is larger is contracted first.
TASK_GRAPH = 100_000


def _strongly_connected(edges: DataFrame, key: str) -> DataFrame:
    """Nodes on cycles of large graphs.

    A node with one way in or one way out is on a cycle only with its neighbour there and is merged into it, round by
    round, half of a chain's nodes by lot; what ends nowhere or begins nowhere goes. So rounds grow with the logarithm of
    the longest path. Of what is left the parts are found in one task for each graph, and the merged nodes are taken
    out again in reverse. Only a graph that stays large, having several ways in and out everywhere, goes by labels.
    """
    loops = stored(edges.where("src = dst").select(key, F.col("src").alias("v")).distinct())
    left = stored(edges.where("src <> dst").select(key, "src", "dst").distinct())
    rounds, before = [], None
    while True:
        most, n = left.groupBy(key).count().agg(F.max("count"), F.sum("count")).first()
        if (most or 0) <= TASK_GRAPH:
            kinds = {f.name: f.dataType.simpleString() for f in left.schema}
            found = left.groupBy(key).applyInPandas(_parts_in_task(key), f"{key} {kinds[key]}, v {kinds['src']}, part {kinds['src']}")
            break
        if before is not None and n > 0.9 * before:
            found = _parts_by_labels(left, key)
            break
        merged, mapped = _contracted(left, key, len(rounds))
        rounds.append((left, merged))
        loops = loops.unionByName(mapped.where("src = dst").select(key, F.col("src").alias("v")))
        left, before = mapped.where("src <> dst"), n
    loops, found = stored(loops.distinct()), stored(found)
    alone = loops.join(found, [key, "v"], "left_anti")
    for _, merged in rounds:
        alone = alone.join(merged.where("not gone"), [key, "v"], "left_anti")
    found = stored(found.unionByName(alone.withColumn("part", F.col("v"))))
    for own, merged in reversed(rounds):
        by_in, by_out = merged.where("not gone and not by_out"), merged.where("not gone and by_out")
        moved = by_out.select(key, F.col("v").alias("dst"), F.col("target").alias("onto"))
        pairs = own.join(by_in.select(key, F.col("v").alias("src"), "target"), [key, "src"]).join(moved, [key, "dst"], "left")
        found = found.unionByName(_taken_out(by_in, pairs.select(key, F.col("src").alias("v"), F.coalesce("onto", "dst").alias("other"), "target"), found, loops, key))
        pairs = own.join(by_out.select(key, F.col("v").alias("dst"), "target"), [key, "dst"])
        found = found.unionByName(_taken_out(by_out, pairs.select(key, F.col("dst").alias("v"), F.col("src").alias("other"), "target"), found, loops, key))
    return found.select(key, F.col("v").alias("node"))


def _contracted(edges: DataFrame, key: str, turn: int) -> tuple[DataFrame, DataFrame]:
    """(key, v, target, by_out, gone) of the nodes that this round takes away, and the edges as they are then, with the
    loops that this makes. No node that another is merged into is itself merged."""
    kind = edges.schema["src"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    ends = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("to"), none.alias("by")), F.struct(F.col("dst").alias("v"), none.alias("to"), F.col("src").alias("by"))))
    near = edges.select(key, ends.alias("x")).groupBy(key, F.col("x.v").alias("v"))
    near = near.agg(F.count("x.to").alias("n_to"), F.min("x.to").alias("to"), F.count("x.by").alias("n_by"), F.min("x.by").alias("by"))
    lot = lambda c: F.xxhash64(F.lit(turn), key, c) % 2 == 0
    target = F.when(F.col("n_to") == 1, F.col("to")).when(F.col("n_by") == 1, F.col("by"))
    near = near.select(key, "v", target.alias("target"), (F.col("n_to") == 1).alias("by_out"), ((F.col("n_to") == 0) | (F.col("n_by") == 0)).alias("gone"))
    merged = stored(near.where(F.col("gone") | (F.col("target").isNotNull() & lot("v") & ~lot("target"))))
    mapped = edges.select(key, "src", "dst")
    for end in ("src", "dst"):
        mapped = mapped.join(merged.select(key, F.col("v").alias(end), F.struct("target", "by_out", "gone").alias(f"m_{end}")), [key, end], "left")
    # The edge to the node that a node is merged into goes: the only one out of it, or the only one into it.
    mapped = mapped.where("not coalesce(m_src.gone, false) and not coalesce(m_dst.gone, false) and not coalesce(m_src.by_out, false) and coalesce(m_dst.by_out, true)")
    return merged, stored(mapped.select(key, F.coalesce("m_src.target", "src").alias("src"), F.coalesce("m_dst.target", "dst").alias("dst")).distinct())


def _taken_out(merged: DataFrame, pairs: DataFrame, found: DataFrame, loops: DataFrame, key: str) -> DataFrame:
    """(key, v, part) of merged nodes that are on cycles: with their target, if a neighbour on the other side is in its part."""
    targets, others = found.select(key, F.col("v").alias("target"), "part"), found.select(key, F.col("v").alias("other"), F.col("part").alias("other_part"))
    along = pairs.join(targets, [key, "target"]).join(others, [key, "other"], "left").where("other = target or part = other_part").select(key, "v", "part").distinct()
    along = stored(along)
    alone = merged.select(key, "v").join(loops, [key, "v"], "left_semi").join(along, [key, "v"], "left_anti")
    return stored(along.unionByName(alone.withColumn("part", F.col("v"))))


def _parts_in_task(key: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Function of one graph's edges that gives (key, v, part): strongly connected parts of two nodes or more (Tarjan, without recursion)."""

    def parts(rows: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for a, b in zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True):
            after.setdefault(a, []).append(b)
        order, low, stack, on, out = {}, {}, [], set(), []
        for root in after:
            if root in order:
                continue
            path = [(root, iter(after[root]))]
            order[root] = low[root] = len(order)
            stack.append(root)
            on.add(root)
            while path:
                v, ways = path[-1]
                for w in ways:
                    if w not in order:
                        order[w] = low[w] = len(order)
                        stack.append(w)
                        on.add(w)
                        path.append((w, iter(after.get(w, ()))))
                        break
                    if w in on:
                        low[v] = min(low[v], order[w])
                else:
                    path.pop()
                    if path:
                        low[path[-1][0]] = min(low[path[-1][0]], low[v])
                    if low[v] == order[v]:
                        part = []
                        while not part or part[-1] != v:
                            part.append(stack.pop())
                            on.discard(part[-1])
                        if len(part) > 1:
                            out += [(w, v) for w in part]
        found = pd.DataFrame(out, columns=["v", "part"]).astype({"v": rows["src"].dtype, "part": rows["src"].dtype})
        found.insert(0, key, rows[key].iloc[0])
        return found

    return parts


def _parts_by_labels(edges: DataFrame, key: str) -> DataFrame:
    """(key, v, part) by the smallest nodes that lead to each and that each leads to. Rounds are as many as the longest shortest path."""
    left, found = _peeled(edges, key), None
    while not left.isEmpty():
        forward, backward = _least_along(left, key), _least_along(left.select(key, F.col("dst").alias("src"), F.col("src").alias("dst")), key)
        label = stored(forward.join(backward.withColumnRenamed("least", "back"), [key, "v"]))
        for end in ("src", "dst"):
            left = left.join(label.select(key, F.col("v").alias(end), F.struct("least", "back").alias(f"l_{end}")), [key, end])
        left = stored(left.where("l_src = l_dst").withColumn("done", F.col("l_src.least") == F.col("l_src.back")))
        inside, left = left.where("done"), _peeled(left.where("not done"), key)
        nodes = inside.select(key, F.explode(F.array("src", "dst")).alias("v"), F.col("l_src.least").alias("part")).distinct()
        found = nodes if found is None else found.unionByName(nodes)
    return edges.select(key, F.col("src").alias("v"), F.col("src").alias("part")).limit(0) if found is None else found


def _peeled(edges: DataFrame, key: str) -> DataFrame:
    """The edges that are left when sources and sinks are taken away again and again."""
    left = stored(edges.select(key, "src", "dst"))
    before, now = -1, left.count()
    while now != before:
        left = left.join(left.select(key, F.col("dst").alias("src")), [key, "src"], "left_semi")
        left = left.join(left.select(key, F.col("src").alias("dst")), [key, "dst"], "left_semi")
        left = stored(left.select(key, "src", "dst"))
        before, now = now, left.count()
    return left


def _least_along(edges: DataFrame, key: str) -> DataFrame:
    """(key, v, least): the smallest of the nodes that lead to v, itself included."""
    nodes = edges.select(key, F.explode(F.array("src", "dst")).alias("v")).distinct()
    label = stored(nodes.withColumn("least", F.col("v")))
    fresh = label
    while not fresh.isEmpty():
        come = edges.join(fresh.select(key, F.col("v").alias("src"), "least"), [key, "src"]).groupBy(key, F.col("dst").alias("v")).agg(F.min("least").alias("new"))
        fresh = stored(label.join(come, [key, "v"]).where("new < least").select(key, "v", F.col("new").alias("least")))
        label = stored(label.unionByName(fresh).groupBy(key, "v").agg(F.min("least").alias("least")))
    return label


def reachable(edges: DataFrame, max_depth: int, key: str = "run_rowid") -> DataFrame:
    """(key, src, dst) of all nodes that lead to each other over at most ``max_depth`` edges.

    Each round takes the pairs that the last one was first to find one edge further.
    """
    edges = stored(edges.select(key, "src", "dst").distinct())  # read in every round
    following = edges.select(key, F.col("src").alias("dst"), F.col("dst").alias("next"))
    found = fresh = edges
    for _ in range(max_depth - 1):
        reached = fresh.join(following, [key, "dst"]).select(key, "src", F.col("next").alias("dst")).distinct()
        fresh = stored(reached.join(found, [key, "src", "dst"], "left_anti"))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


def refused_edges(nodes: DataFrame, edges: DataFrame, key: str = "run_rowid", node: str = "task_idx", existing: DataFrame | None = None) -> DataFrame:
    """Edges that can't be added, with the reason: unknown ends (NotFound), self loops (InvalidArgument) and, if the
    ``existing`` edges are given, those that would close a cycle with them (CycleDetected)."""
    known = nodes.select(key, F.col(node).alias("n")).distinct()
    marked = edges.join(known.select(key, F.col("n").alias("src"), F.lit(True).alias("has_src")), [key, "src"], "left")
    marked = marked.join(known.select(key, F.col("n").alias("dst"), F.lit(True).alias("has_dst")), [key, "dst"], "left")
    error = F.when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "NotFound").when(F.col("src") == F.col("dst"), "InvalidArgument")
    marked = marked.withColumn("error", error)
    if existing is not None:
        marked = stored(marked)
        closing = closing_edges(existing, marked.where("error is null").select(key, "src", "dst"), key).withColumn("closes", F.lit(True))
        marked = marked.join(closing, [key, "src", "dst"], "left").withColumn("error", F.coalesce("error", F.when(F.col("closes"), "CycleDetected")))
    return marked.where("error is not null").select(key, "src", "dst", "error")


def closing_edges(existing: DataFrame, proposed: DataFrame, key: str = "run_rowid") -> DataFrame:
    """The proposed edges whose source can be reached from their destination over existing edges, each taken by itself.

    A small graph's existing edges meet in one row, which tells what leads where, and each proposed edge looks there. In
    larger graphs each round goes one edge further from the destinations; nodes that an edge's search has met are not met again.
    """
    kind = existing.schema["src"].dataType.simpleString()
    ends = F.explode(F.array(F.struct(F.col("dst").cast(kind).alias("node"), F.col("src")), F.struct(F.col("src").alias("node"), F.lit(None).cast(kind).alias("src"))))
    small, large = split(stored(existing.select(key, ends.alias("x")).select(key, "x.*")), key)
    proposed = stored(proposed.select(key, "src", "dst").distinct())
    known = graphs(small, key).select(key, "ids", reach(F.col("ids"), F.col("sources")).alias("reach"))
    place = lambda c: F.array_position("ids", F.col(c).cast(kind)).cast("int") - 1
    leads = F.get("reach", place("src")).bitwiseAND(F.get(bits(), place("dst"))) != 0
    found = proposed.where("src <> dst").join(known, key).where(leads).select(key, "src", "dst").unionByName(proposed.where("src = dst"))
    if large is None:
        return found
    far = proposed.where("src <> dst").join(large.select(key).distinct(), key, "left_semi")
    return found.unionByName(_closing_by_level(large.where("src is not null").select(key, "src", F.col("node").alias("dst")), far, key))


def _closing_by_level(existing: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    existing = stored(existing.select(key, F.col("src").alias("at"), F.col("dst").alias("next")).distinct())
    met = fresh = stored(proposed.select(key, "src", "dst").distinct().withColumn("at", F.col("dst")))
    while not fresh.isEmpty():
        further = fresh.where("at <> src").join(existing, [key, "at"]).select(key, "src", "dst", F.col("next").alias("at")).distinct()
        fresh = stored(further.join(met, [key, "src", "dst", "at"], "left_anti"))
        met = met.unionByName(fresh)
    return met.where("at = src").select(key, "src", "dst").distinct()


def undeletable(nodes: DataFrame, edges: DataFrame, key: str = "run_rowid", node: str = "task_idx") -> DataFrame:
    """Tasks that can't be deleted because others depend on them."""
    return nodes.select(key, node).join(edges.select(key, F.col("src").alias(node)), [key, node], "left_semi")


def definition_errors(dags: DataFrame, tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(dag_id, error, detail) of all that is wrong with definitions; a DAG without name or tasks has no further errors.

    dags: dag_id, name. tasks: dag_id, task_id, command. edges: dag_id, task_id, dep.
    """
    row = lambda df, error, detail="''": df.selectExpr("dag_id", f"'{error}' as error", f"cast({detail} as string) as detail")
    named = dags.where("coalesce(name, '') <> ''")
    full = named.join(tasks.select("dag_id"), "dag_id", "left_semi").select("dag_id")
    own, deps = tasks.join(full, "dag_id", "left_semi"), edges.join(full, "dag_id", "left_semi")
    found = [
        row(dags.where("coalesce(name, '') = ''"), "empty name"), row(named.join(tasks.select("dag_id"), "dag_id", "left_anti"), "no tasks"),
        row(own.where("coalesce(task_id, '') = ''"), "empty id"), row(own.groupBy("dag_id", "task_id").count().where("count > 1"), "duplicate id", "task_id"),
        row(own.where("coalesce(command, '') = ''"), "empty command", "task_id"), row(deps.where("task_id = dep"), "self dependency", "task_id"),
        row(deps.join(own.select("dag_id", F.col("task_id").alias("dep")), ["dag_id", "dep"], "left_anti"), "unknown dependency", "dep"),
    ]
    total = found[0]
    for f in found[1:]:
        total = total.unionByName(f)
    return total


def definition_verdicts(dags: DataFrame, errors: DataFrame) -> DataFrame:
    """(dag_id, n_errors, verdict) for each definition: valid without errors (``definition_errors``), else invalid."""
    counts = errors.groupBy("dag_id").agg(F.count("*").alias("n_errors"))
    n = F.coalesce("n_errors", F.lit(0))
    return dags.select("dag_id").join(counts, "dag_id", "left").select("dag_id", n.alias("n_errors"), F.when(n == 0, "valid").otherwise("invalid").alias("verdict"))
