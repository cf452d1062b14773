"""Item trees: ancestors, components, category queries, and redundant children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def with_roots(items: DataFrame) -> DataFrame:
    """items with root_item_id (the ancestor at depth 0) and depth.

    By pointer doubling: every item points to its parent, and each round joins the items that aren't at a root yet with
    what they point to, so pointers span twice as far; log2 of the deepest tree rounds reach all roots. Only the items
    still on their way are joined, and each round is written, so the lineage stays short. A parent that is no item of the
    label is a root. An item that leads into a cycle has neither root nor depth: it is still on its way after as many
    rounds as the largest label could need. An item_id twice in a label is an error.
    """
    up = items.select("label_id", "item_id", F.coalesce("parent_item_id", "item_id").alias("at"), F.when(F.col("parent_item_id").isNull(), 0).otherwise(1).alias("depth"), F.col("parent_item_id").isNull().alias("done"))
    state = written(up, "roots")
    largest = state.groupBy("label_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    for _ in range(largest.bit_length() + 1):
        there = state.select(F.col("label_id").alias("t_label"), F.col("item_id").alias("t_item"), F.col("at").alias("t_at"), F.col("depth").alias("t_depth"), F.col("done").alias("t_done"))
        moved = state.where("not done").join(there, (F.col("label_id") == F.col("t_label")) & (F.col("at") == F.col("t_item")), "left")
        moved = moved.select("label_id", "item_id", F.coalesce("t_at", "at").alias("at"), (F.col("depth") + F.coalesce("t_depth", F.lit(0))).alias("depth"), F.coalesce("t_done", F.lit(True)).alias("done"))
        state = written(state.where("done").unionByName(moved), "roots")
        if not state.where("not done").take(1):
            break
    tops = state.select(F.col("label_id").alias("s_label"), F.col("item_id").alias("s_item"), F.when(F.col("done"), F.col("at")).alias("root_item_id"), F.when(F.col("done"), F.col("depth")).alias("depth"))
    return items.join(tops, (F.col("label_id") == F.col("s_label")) & (F.col("item_id") == F.col("s_item"))).select(*items.columns, "root_item_id", "depth")


def with_components(items: DataFrame) -> DataFrame:
    """items with root_item_id, depth, is_compound and component (the root's id where the root has children)."""
    parents = items.where("parent_item_id is not null").select(F.col("label_id").alias("p_label"), F.col("parent_item_id").alias("p_item")).distinct()
    roots = parents.select(F.col("p_label").alias("r_label"), F.col("p_item").alias("r_item"))
    rows = with_roots(items)
    columns = rows.columns
    rows = rows.join(parents, (F.col("label_id") == F.col("p_label")) & (F.col("item_id") == F.col("p_item")), "left")
    rows = rows.join(roots, (F.col("label_id") == F.col("r_label")) & (F.col("root_item_id") == F.col("r_item")), "left")
    return rows.select(*columns, F.col("p_item").isNotNull().alias("is_compound"), F.col("r_item").alias("component"))


def category_queries(items: DataFrame) -> DataFrame:
    """One query per label for the product, unless all depth-0 items are compounds, and one per compound with an additive.

    items: label_id, item_id, parent_item_id, name, additive_id (null: none). Returns label_id, component (null:
    product), text (names in item order) and additive_ids.
    """
    rows = with_components(items)
    names = lambda cond, c: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("item_id", c)))), lambda x: x[c])
    top = (F.col("depth") == 0) & ~F.col("is_compound")
    product = rows.groupBy("label_id").agg(
        names(top, "name").alias("names"), names(top & F.col("additive_id").isNotNull(), "additive_id").alias("additives"), F.count_if(top).alias("n")
    )
    product = product.where("n > 0").select("label_id", F.lit(None).cast("int").alias("component"), "names", "additives")
    below = (F.col("depth") > 0) & F.col("component").isNotNull()
    parts = rows.where(below).groupBy("label_id", "component").agg(names(F.lit(True), "name").alias("names"), names(F.col("additive_id").isNotNull(), "additive_id").alias("additives"))
    parts = parts.where(F.size("additives") > 0)
    both = product.unionByName(parts)
    return both.select("label_id", "component", F.array_join("names", ", ").alias("text"), F.array_distinct("additives").alias("additive_ids"))


def item_category(items: DataFrame, results: DataFrame) -> DataFrame:
    """items with the result of their component, else the product's, else none.

    items: label_id, item_id, component; results: label_id, component (null: product), fcs_code.
    """
    own = results.where("component is not null").select(F.col("label_id").alias("o_label"), F.col("component").alias("o_component"), F.col("fcs_code").alias("o_code"))
    whole = results.where("component is null").select(F.col("label_id").alias("w_label"), F.col("fcs_code").alias("w_code"))
    rows = items.join(own, (F.col("label_id") == F.col("o_label")) & (F.col("component") == F.col("o_component")), "left").join(whole, F.col("label_id") == F.col("w_label"), "left")
    scope = F.when(F.col("o_code").isNotNull(), "component").when(F.col("w_code").isNotNull(), "product").otherwise("none")
    return rows.select(*items.columns, F.coalesce("o_code", "w_code").alias("fcs_code"), scope.alias("scope"))


def drop_redundant_children(items: DataFrame) -> DataFrame:
    """items without only children that restate a code in their parent's text.

    items: label_id, item_id, parent_item_id, verbatim, declared_code.
    """
    siblings = F.count(F.lit(1)).over(Window.partitionBy("label_id", "parent_item_id"))
    alone = items.where("parent_item_id is not null").withColumn("siblings", siblings).where("siblings = 1 and verbatim = declared_code")
    parents = items.select("label_id", F.col("item_id").alias("p_item"), F.col("verbatim").alias("p_text"))
    gone = alone.join(parents, (alone["label_id"] == parents["label_id"]) & (F.col("parent_item_id") == F.col("p_item"))).where(F.contains("p_text", "declared_code")).select(alone["label_id"], "item_id")
    return items.join(gone, ["label_id", "item_id"], "left_anti")
