"""Words with positions (page, x, y) to lines, and lines to their nearest anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """words: page, x, y, text -> page, line, y, text: a gap in y above the tolerance starts a line, whose words stand by x."""
    w = Window.partitionBy("page").orderBy("y", "x")
    starts = F.when(F.col("y") - F.lag("y").over(w) <= tolerance, 0).otherwise(1)
    rows = words.withColumn("__new", starts).withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct("x", "text")))
    return rows.groupBy("page", "line").agg(F.min("y").alias("y"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def nearest(points: DataFrame, anchors: DataFrame, by: str = "page") -> DataFrame:
    """Each point (by, y, ...) with the y of its nearest anchor of the same group; of two as near, the earlier one.

    Last anchor before and first one after come from running windows over the union, so no pairs are made.
    """
    cols = points.columns
    both = points.withColumn("__anchor", F.lit(None).cast("double")).unionByName(anchors.select(by, F.col("y"), F.col("y").cast("double").alias("__anchor")), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy("y")
    before = F.max("__anchor").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # read from the far end: a frame that ends behind the row would be summed anew for each row
    after = F.min("__anchor").over(Window.partitionBy(by).orderBy(F.desc("y")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumn("__before", before).withColumn("__after", after).where("__anchor is null")
    pick = F.when(F.col("__after").isNull() | (F.col("y") - F.col("__before") <= F.col("__after") - F.col("y")), F.col("__before")).otherwise(F.col("__after"))
    return rows.select(*cols, pick.alias("anchor"))


def zone(words: DataFrame, x_range: tuple[float, float], y_range: tuple[float, float], page_span: float, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The words of one column of the page bodies, with g, their height counted on through the pages, strictly between start and end.

    words: doc, page, x, y, text. A body ends one above the first word "*" below its top: that is a footnote.
    """
    low, high = y_range
    note = F.min(F.when((F.col("text") == "*") & (F.col("y") > low), F.col("y"))).over(Window.partitionBy("doc", "page"))
    rows = words.withColumn("__note", note).withColumn("g", F.col("page") * F.lit(page_span) + F.col("y"))
    body = (F.col("y") >= low) & (F.col("y") <= F.least(F.lit(float(high)), F.col("__note") - 1))
    rows = rows.where(body & (F.col("x") >= x_range[0]) & (F.col("x") < x_range[1]))
    for bound, side in ((start, 1), (end, -1)):
        if bound is not None:
            rows = rows.where((F.col("g") - bound) * side > 0)
    return rows.drop("__note")


def headings(words: DataFrame, phrases: list[str], page_span: float) -> DataFrame:
    """doc, phrase (its place in the list), g: where the words of a phrase follow one another on a page, by height, then from the left."""
    order = Window.partitionBy("doc", "page").orderBy("y", "x")
    rows = words.withColumn("g", F.col("page") * F.lit(page_span) + F.col("y"))
    ahead = max(len(p.split()) for p in phrases)
    run = F.array(*(F.lead("text", k).over(order) for k in range(ahead)))
    rows = rows.withColumn("__run", run)
    found = F.array_compact(F.array(*(F.when(F.slice("__run", 1, len(p.split())) == F.array(*map(F.lit, p.split())), F.lit(i)) for i, p in enumerate(phrases))))
    return rows.select("doc", F.explode(found).alias("phrase"), "g")


def boundaries(words: DataFrame, phrases: list[str], page_span: float) -> DataFrame:
    """doc, bounds: the first place of each phrase after the place of the one before; null from the first that is missing on."""
    held = headings(words, phrases, page_span).groupBy("doc").agg(F.collect_list(F.struct("phrase", "g")).alias("held"))

    def step(s: Column, i: Column) -> Column:
        before = F.when(F.size(s) == 0, 0.0).otherwise(F.element_at(s, -1))
        later = F.filter("held", lambda h: (h["phrase"] == i) & (h["g"] > before))
        return F.concat(s, F.array(F.array_min(F.transform(later, lambda h: h["g"].cast("double")))))

    return held.select("doc", F.aggregate(F.sequence(F.lit(0), F.lit(len(phrases) - 1)), F.array().cast("array<double>"), step).alias("bounds"))


def merged_fragments(fragments: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """doc, g, name: fragments (doc, g, text) of wrapped names put together, in order of height, at the height of their first part.

    A fragment goes on with the one before as long as that begins a known name. What begins none is marked, and so is a
    name that the section ends in. A document's section is folded inside its row.
    """
    known = F.array(*map(F.lit, vocabulary))
    parts = F.array_sort(F.collect_list(F.struct(F.col("g").cast("double").alias("g"), "text")))
    entry = lambda g, name: F.array(F.struct(g.alias("g"), name.alias("name")))
    empty = F.struct(F.array().cast("array<struct<g: double, name: string>>").alias("done"), F.lit(None).cast("double").alias("top"), F.lit("").alias("open"))

    def step(s: Column, f: Column) -> Column:
        name = F.when(s["open"] == "", f["text"]).otherwise(F.concat(s["open"], F.lit(" "), f["text"]))
        top = F.coalesce(s["top"], f["g"])
        whole = F.array_contains(known, name)
        begun = ~whole & F.exists(known, lambda k: F.startswith(k, name))
        done = F.when(whole, F.concat(s["done"], entry(top, name))).when(begun, s["done"]).otherwise(F.concat(s["done"], entry(f["g"], F.concat(f["text"], F.lit(" [UNRECOGNISED]")))))
        return F.struct(done.alias("done"), F.when(begun, top).alias("top"), F.when(begun, name).otherwise("").alias("open"))

    last = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], entry(s["top"], F.concat(s["open"], F.lit(" [INCOMPLETE]")))))
    rows = fragments.groupBy("doc").agg(parts.alias("parts")).select("doc", F.explode(F.aggregate("parts", empty, step, last)).alias("e"))
    return rows.select("doc", "e.g", "e.name")
