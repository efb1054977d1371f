"""What feeds what: closures over an edge table, node colours, impact and SLA state.

``edges(src, dst)``; ``nodes(id, pos, layer, owner, sla_minutes, secret)`` with ``pos`` the catalogue order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

DEFAULT_SLA_MINUTES = 60
NAMED = 10  # products that a summary spells out
# The colour of each severity.
COLOUR = {"CRITICAL": "red", "HIGH": "red", "MEDIUM": "yellow", "LOW": "yellow"}


def no_rules() -> Column:
    return F.array().cast("array<string>")


def downstream(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node, hops) for every node reachable from ``starts(start)``; cycles end.

    A start is its own descendant only when it lies on a cycle. Each round joins the newest nodes with
    the edges, drops pairs seen before and is checkpointed, so plans stay short and a lost executor
    costs one round. The edges are written once, and all pairs seen meet the new ones in a single anti-join.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    seen, hops = None, 0
    while True:
        hops += 1
        nxt = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        if seen is not None:
            nxt = nxt.join(seen, ["start", "node"], "left_anti")
        frontier = cut_lineage(nxt.withColumn("hops", F.lit(hops)))
        seen = frontier if seen is None else seen.unionByName(frontier)
        if frontier.isEmpty():
            return seen


def upstream(starts: DataFrame, edges: DataFrame) -> DataFrame:
    return downstream(starts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def first_cause(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cause) for every node below ``starts(start, pos)``: its ancestor among them with the least ``pos``.

    Each node keeps one candidate and passes it on when it improves, so no (ancestor, node) pairs are formed: a round holds at most
    one row per node, and there are no more rounds than steps on the longest path without a cycle.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    least = F.min(F.struct("pos", "start")).alias("at")
    moving = starts.groupBy(F.col("start").alias("node")).agg(F.min("pos").alias("pos")).select("node", F.struct("pos", F.col("node").alias("start")).alias("at"))
    best = None
    while True:
        sent = moving.join(edges, moving["node"] == edges["src"]).select(F.col("dst").alias("node"), "at.pos", "at.start").groupBy("node").agg(least)
        if best is not None:
            old = best.select(F.col("node").alias("__node"), F.col("at").alias("__at"))
            sent = sent.join(old, F.col("node") == F.col("__node"), "left").where(F.col("__at").isNull() | (F.col("at") < F.col("__at"))).select("node", "at")
        moving = cut_lineage(sent)
        if moving.isEmpty():
            return (moving if best is None else best).select("node", F.col("at.start").alias("cause"))
        best = moving if best is None else cut_lineage(best.unionByName(moving).groupBy("node").agg(F.min("at").alias("at")))


def node_status(nodes: DataFrame, edges: DataFrame, open_alerts: DataFrame, blocked: DataFrame) -> DataFrame:
    """Colour and reason per node.

    ``open_alerts(step, severity, problem, seq)``: the worst colour wins, the later alert on ties.
    ``blocked(node, reason)`` is red. Green nodes below a red one are yellow and name the first red
    ancestor in catalogue order.
    """
    red = F.col("severity").isin(*[s for s, c in COLOUR.items() if c == "red"])
    rank = F.when(red, 2).otherwise(1)
    worst = open_alerts.groupBy(F.col("step").alias("id")).agg(
        F.max(rank).alias("rank"), F.max_by("problem", F.struct(rank, "seq")).alias("problem"))
    held = blocked.select(F.col("node").alias("id"), F.concat(F.lit("Publishing blocked: "), "reason").alias("held"))
    own = nodes.select("id", "pos").join(worst, "id", "left").join(held, "id", "left").select(
        "id", "pos", F.when(F.col("held").isNotNull(), 2).otherwise(F.coalesce("rank", F.lit(0))).alias("rank"),
        F.coalesce("held", "problem", F.lit("")).alias("detail"))
    own = cut_lineage(own)
    reds = own.where(F.col("rank") == 2).select(F.col("id").alias("start"), "pos")
    joined = own.join(first_cause(reds, edges).withColumnRenamed("node", "id"), "id", "left")
    risk = (F.col("rank") == 0) & F.col("cause").isNotNull()
    return joined.select(
        F.col("id").alias("node"),
        F.when(risk | (F.col("rank") == 1), "yellow").when(F.col("rank") == 2, "red").otherwise("green").alias("status"),
        F.when(risk, F.concat(F.lit("At risk: upstream "), F.col("cause"), F.lit(" has a problem"))).otherwise(
            F.col("detail")).alias("detail"))


def _minutes_since(then: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(then)) / F.lit(6e7)


def impact(steps: DataFrame, nodes: DataFrame, edges: DataFrame, refresh: DataFrame, as_of: Column) -> DataFrame:
    """Affected data products per incident with their SLA clock.

    ``steps(incident_id, step)`` are the failing nodes, ``refresh(node, last_refreshed, blocked)``. ``regulation`` lists the rules that a
    product answers to, if ``nodes`` has that column.
    """
    pairs = downstream(steps.select(F.col("step").alias("start")), edges)
    reached = steps.select("incident_id", F.col("step").alias("node")).unionByName(
        steps.join(pairs, steps["step"] == pairs["start"]).select("incident_id", "node")).distinct()
    rules = F.coalesce(F.col("regulation"), no_rules()) if "regulation" in nodes.columns else no_rules()
    gold = nodes.where(F.col("layer") == "gold").select(
        F.col("id").alias("node"), "owner", "sla_minutes", rules.alias("regulation"))
    since = F.coalesce(_minutes_since(F.col("last_refreshed"), as_of), F.lit(0.0))
    sla = F.coalesce("sla_minutes", F.lit(DEFAULT_SLA_MINUTES))
    return reached.join(gold, "node").join(refresh, "node", "left").select(
        "incident_id", "node", F.coalesce("owner", F.lit("-")).alias("owner"), sla.alias("sla_minutes"),
        F.round(since, 1).alias("minutes_since_refresh"), F.round(sla - since, 1).alias("minutes_left"),
        (F.coalesce("blocked", F.lit(0)) == 1).alias("blocked"), "regulation")


def impact_summary(gold: DataFrame, incidents: DataFrame) -> DataFrame:
    """One sentence for each of ``incidents(incident_id)``; with blocked products, the one that breaches first is named.

    Without blocked ones the products are named by name, the first ten and how many more: a text stays bounded where thousands are
    affected, and ``impact`` has them all.
    """
    worst = F.min(F.when(F.col("blocked"), F.struct("minutes_left", "node", "owner")))
    per = gold.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("products"), F.count_if("blocked").alias("blocked"), F.count_if(F.size("regulation") > 0).alias("regulated"), worst.alias("worst"))
    first = Window.partitionBy("incident_id").orderBy("node")
    named = gold.select("incident_id", "node", F.row_number().over(first).alias("k")).where(F.col("k") <= NAMED).groupBy("incident_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda n: F.replace(n, F.lit("gold_"), F.lit(""))), ", ").alias("names"))
    all_ = incidents.select("incident_id").distinct().join(per, "incident_id", "left").join(named, "incident_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    left = F.bround(F.greatest(F.col("worst.minutes_left"), F.lit(0.0)), 0).cast("int").cast("string")
    n = F.col("products").cast("string")
    more = F.when(F.col("products") > NAMED, F.concat(F.lit(" and "), (F.col("products") - NAMED).cast("string"), F.lit(" more"))).otherwise("")
    return all_.select(
        "incident_id", count("products"), count("blocked"), count("regulated"), F.col("worst.node").alias("worst_node"),
        F.when(F.col("products").isNull(), "No data products affected.").when(F.col("blocked") > 0, F.concat(
            n, F.lit(" data products affected; "), F.col("blocked").cast("string"), F.lit(" blocked. "), F.col("worst.node"),
            F.lit(" ("), F.col("worst.owner"), F.lit(") breaches its SLA in "), left, F.lit(" min."))).otherwise(
            F.concat(n, F.lit(" data products receive incomplete data: "), "names", more, F.lit(". None blocked yet."))).alias("summary"))


def _folded(edges: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold the tree-like parts of a graph from their leaves up.

    A leaf with a single parent is below a node exactly if its parent is, or if that node is the parent; so what it counts for moves to the
    parent and its edge goes. Returns the edges left over, ``mass(node, owner, steps, products)`` of what was folded into a node that
    remains, and the same for the nodes that went. A forest folds up whole; rows never exceed the nodes.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    single = cut_lineage(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("parent")).where("n = 1").select(F.col("dst").alias("node"), "parent"))
    sums = [F.sum("steps").alias("steps"), F.sum("products").alias("products")]
    mass, gone = own.limit(0), None
    while True:
        leaves = cut_lineage(edges.select(F.col("dst").alias("node")).distinct().join(single, "node").join(
            edges.select(F.col("src").alias("node")), "node", "left_anti"))
        if leaves.isEmpty():
            return edges, mass, own.limit(0) if gone is None else gone
        finished = cut_lineage(mass.join(leaves.select("node"), "node", "left_semi"))
        moved = finished.unionByName(own.join(leaves.select("node"), "node", "left_semi")).join(leaves, "node").select(
            F.col("parent").alias("node"), "owner", "steps", "products")
        mass = cut_lineage(mass.join(leaves.select("node"), "node", "left_anti").unionByName(moved).groupBy("node", "owner").agg(*sums))
        edges = cut_lineage(edges.join(leaves.select(F.col("node").alias("dst")), "dst", "left_anti"))
        gone = finished if gone is None else gone.unionByName(finished)


def blast_radius(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Downstream steps and data products of every node that feeds another, and how many owners they have.

    Tree-like parts are folded first; only what then remains (nodes above shared ones or on cycles) is walked in pairs.
    """
    gold = F.col("layer") == "gold"
    own = cut_lineage(nodes.select(F.col("id").alias("node"), F.when(gold, F.col("owner")).alias("owner"), F.lit(1).cast("long").alias("steps"),
                                   gold.cast("long").alias("products")))
    core, mass, gone = _folded(edges, own)
    pairs = downstream(core.select(F.col("src").alias("start")), core).select("start", "node")
    others = pairs.where(F.col("start") != F.col("node"))  # a node on a cycle reaches itself, and what was folded into it counts once
    folded = mass.unionByName(gone).withColumn("start", F.col("node"))
    columns = ["start", "owner", "steps", "products"]
    rows = pairs.join(own, "node").select(*columns).unionByName(others.join(mass, "node").select(*columns)).unionByName(folded.select(*columns))
    # Owners first, so distinct owners are counted from combined rows.
    per_owner = rows.groupBy("start", "owner").agg(F.sum("steps").alias("steps"), F.sum("products").alias("products"))
    return per_owner.groupBy("start").agg(
        F.sum("steps").alias("steps"), F.sum("products").alias("products"), F.count("owner").alias("owners"))


def evidence_upstream(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything upstream of each failing step, with the secret a node needs, if any."""
    pairs = upstream(steps.select(F.col("step").alias("start")), edges)
    return pairs.join(nodes.select(F.col("id").alias("node"), "secret"), "node", "left").select(
        F.col("start").alias("step"), "node", "secret")


def sla_status(refresh: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """SLA budget per data product: Blocked, else Breached, At risk (under a quarter left) or OK."""
    j = refresh.join(nodes.select(F.col("id").alias("node"), "owner", "sla_minutes"), "node", "left")
    sla = F.coalesce("sla_minutes", F.lit(DEFAULT_SLA_MINUTES))
    left = sla - _minutes_since(F.col("last_refreshed"), as_of)
    status = F.when(F.col("blocked") == 1, "Blocked").when(left <= 0, "Breached").when(left < sla * 0.25, "At risk").otherwise("OK")
    shown = F.greatest(left, F.lit(0.0))
    return j.select(
        F.replace("node", F.lit("gold_"), F.lit("")).alias("product"), "owner", status.alias("status"),
        F.round(shown, 1).alias("minutes_left"), F.round(F.greatest(100 * left / sla, F.lit(0.0)), 1).alias("pct_left"),
        F.concat(F.bround(shown, 0).cast("int").cast("string"), F.lit(" of "), sla.cast("string"), F.lit(" min · "),
                 F.lower(status)).alias("label"))
