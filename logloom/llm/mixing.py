"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import common

#: Ranges of the seeded order of a leaf; only the one in which its budget ends is sorted.
RANGES = 4096


def n_words(text: str) -> Column:
    """Runs without ASCII white space, the token count used for budgets; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


#: Steps of the fill of a node for each doubling, so some 64,000 in all.
STEPS = 1024


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `share` to nodes (parent columns, `budget` of the parent, `weight`, `capacity`; all whole numbers).

    Each child of a parent gets weight / (sum of weights) of the budget, but no more than its capacity;
    what it leaves goes to its siblings in proportion to their weights, again up to their capacities.
    Solved at once: children in the order of capacity / weight, their fill, are full first. Divisions round
    down. A weight of 0 gets nothing.

    Children are not put in one order, for one parent may have any number of them. Those of one weight and
    capacity are counted as one kind, for all of one fill are full or none is. Kinds are summed by steps of
    the fill, the sums of STEPS for each doubling are put in order, kinds only inside their step.
    """
    fill = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    step = F.when(F.col("weight") > 0, F.floor(F.log2(F.col("capacity") / F.col("weight") + 1) * STEPS)).otherwise(1 << 30).cast("int")
    kinds = nodes.groupBy(*parent, "weight", "capacity").agg(F.count("*").alias("n"), F.first("budget").alias("budget"))
    kinds = kinds.select("*", fill.alias("fill"), step.alias("step"), (F.col("n") * F.col("capacity")).alias("holds"), (F.col("n") * F.col("weight")).alias("weighs"))
    steps = Window.partitionBy(*parent).orderBy("step")
    sums = kinds.groupBy(*parent, "step").agg(F.sum("holds").alias("here"), F.sum("weighs").alias("pull"))
    sums = sums.select(*parent, "step", (F.sum("here").over(steps) - F.col("here")).alias("before"), F.coalesce(F.sum("pull").over(steps.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("after"))
    inside = Window.partitionBy(*parent, "step").orderBy("fill", "weight", "capacity")
    kinds = kinds.join(sums, [*parent, "step"])
    full = F.col("before") + F.sum("holds").over(inside) - F.col("holds")
    open_ = F.col("after") + F.sum("weighs").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    fits = (F.col("weight") > 0) & (F.col("capacity").cast("decimal(38,0)") * open_ <= F.col("weight").cast("decimal(38,0)") * (F.col("budget") - full))
    ends = [F.max(F.when(F.col("fits"), F.col("fill"))).alias("level"), F.sum(F.when(F.col("fits"), F.col("holds")).otherwise(0)).alias("used"), F.sum(F.when(~F.col("fits"), F.col("weighs")).otherwise(0)).alias("others")]
    kinds = kinds.select(*parent, "fill", "holds", "weighs", fits.alias("fits"))
    if parent:
        told = nodes.join(kinds.groupBy(*parent).agg(*ends), parent)
    else:
        one = kinds.agg(*ends).first()
        told = nodes.select("*", F.lit(one["level"]).cast("double").alias("level"), F.lit(one["used"] or 0).cast("long").alias("used"), F.lit(one["others"] or 0).cast("long").alias("others"))
    part = F.expr("cast(cast(greatest(budget - used, 0) as decimal(28,0)) * weight div greatest(others, 1) as bigint)")
    share = F.when((F.col("weight") > 0) & (fill <= F.col("level")), F.col("capacity")).otherwise(part).cast("long")
    return told.withColumn("share", share).drop("level", "used", "others")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: float, max_epochs: int) -> DataFrame:
    """Budget in tokens of each leaf (domain, lang, source, tokens); the root's is `share` of all tokens.

    weights: for "domain", "lang" and "source", whole weights by value; a value that is not listed has
    weight 1. Capacity of a leaf is max_epochs times its tokens, of an inner node the sum of its
    children's. Budgets go down from the root, so a shortage is made good by siblings first and only
    what a whole subtree cannot hold goes to the ancestors' other children.
    """

    def weight(level: str) -> Column:
        out = F.lit(1)
        for value, w in weights.get(level, {}).items():
            out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
        return out.cast("long")

    leaves = common.checkpointed(leaves.withColumn("capacity", F.col("tokens") * max_epochs))
    root = leaves.agg(F.least(F.floor(F.sum("tokens") * F.lit(share)).cast("long"), F.sum("capacity")).alias("budget")).first()["budget"] or 0
    path, now = ["domain", "lang", "source"], None
    for depth in range(1, len(path) + 1):
        parent, own = path[: depth - 1], path[:depth]
        nodes = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(path[depth - 1]))
        nodes = nodes.withColumn("budget", F.lit(root).cast("long")) if now is None else nodes.join(now, parent)
        now = common.checkpointed(share_out(nodes, parent).select(*own, F.col("share").alias("budget")))
    return now


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] | None = None, share: float = 0.5, max_epochs: int = 2, seed: int = 11, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs taken to target weights, with `mix_tokens`, `mix_epoch` (from 0) and `mix_budget` added.

    The whole budget is `share` of all tokens. A leaf takes whole epochs while its budget holds them,
    then of one more epoch the documents in that epoch's seeded order (md5 of seed, epoch and id, then
    id) as long as their tokens, summed from the first, fit. A document may so come back max_epochs
    times. Documents without words cost nothing. Null lang, source or domain count as ''. Rows that
    repeat an id stand in one place of the order and are taken or left together when their joint
    tokens fit. An empty table gives an empty result. Columns of docs
    called mix_tokens, mix_epoch or mix_budget are replaced, all others pass through.

    Scale: a leaf may hold any part of the rows. Its order is cut into RANGES ranges of the hash, which
    are summed first; only the range in which the budget ends is sorted, the rest is a comparison.
    """
    domain = F.col("source") if domain is None else domain
    docs = docs.select(*[c for c in docs.columns if c.lower() not in MIX])
    leaf = F.struct(F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    slim = common.checkpointed(docs.select(leaf.alias("leaf"), F.col(id_col).alias("id"), n_words(text_col).alias("tokens")))
    leaves = slim.groupBy("leaf").agg(F.sum("tokens").alias("tokens")).select("leaf.*", "tokens")
    budgets = leaf_budgets(leaves, weights or {}, share, max_epochs)
    full = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(1).cast("int")
    plan = leaves.join(budgets, ["domain", "lang", "source"]).withColumn("full", full)
    plan = plan.select(F.struct("domain", "lang", "source").alias("leaf"), "full", (F.col("budget") - F.col("full") * F.col("tokens")).alias("rest"), "budget")
    plan = common.small(plan)

    placed = slim.join(plan.where(F.col("full") < max_epochs), "leaf").withColumn("order", _order(seed, F.col("full"), F.col("id")))
    placed = placed.withColumn("range", (F.conv(F.substring("order", 1, 4), 16, 10).cast("int") * RANGES / (1 << 16)).cast("int"))
    sums = placed.groupBy("leaf", "range").agg(F.sum("tokens").alias("here"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.sum("here").over(Window.partitionBy("leaf").orderBy("range")) - F.col("here"))
    ends = sums.where("before <= rest and before + here > rest").select("leaf", "range", "before")
    at_end = placed.join(ends, ["leaf", "range"]).groupBy("leaf", "order", "id").agg(F.sum("tokens").alias("here"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.col("before") + F.sum("here").over(Window.partitionBy("leaf").orderBy("order", "id"))
    cuts = at_end.withColumn("upto", upto).where("upto <= rest").groupBy("leaf").agg(F.max(F.struct("order", "id")).alias("cut"))
    # a range whose first document is too long: the cut is before it, at the end of the ranges that fit
    cuts = ends.join(cuts, "leaf", "left").select("leaf", "range", "cut")
    names = dict(zip(("leaf", "full", "budget", "range", "cut"), common.free(docs, "leaf", "full", "budget", "range", "cut"), strict=True))
    plan = common.small(plan.join(cuts, "leaf", "left").select(*[F.col(k).alias(v) for k, v in names.items()]))

    c = lambda k: F.col(names[k])
    order = _order(seed, c("full"), F.col(id_col))
    at = (F.conv(F.substring(order, 1, 4), 16, 10).cast("int") * RANGES / (1 << 16)).cast("int")
    under = (at < c("range")) | ((at == c("range")) & (F.struct(order.alias("order"), F.col(id_col).alias("id")) <= c("cut")))
    times = c("full") + F.when((c("full") < max_epochs) & F.coalesce(under, F.lit(False)), 1).otherwise(0)
    taken = docs.withColumn(names["leaf"], leaf).join(plan, names["leaf"])
    taken = taken.select(*docs.columns, n_words(text_col).alias("mix_tokens"), c("budget").alias("mix_budget"), times.alias("mix_epoch")).where("mix_epoch > 0")
    return taken.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_epoch") - 1))).select(*docs.columns, *MIX)


#: Columns that mix() adds.
MIX = ["mix_tokens", "mix_epoch", "mix_budget"]


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.md5(text.cast("binary"))
