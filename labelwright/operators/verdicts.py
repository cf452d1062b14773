"""Verdicts: looking a substance up in a category, the ordered decision list per item, and the roll-up per label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import lineage
from ..storage import small, written
from .provisions import select_rows, verdict_of

# What governs items outside the permission list, and the verdict sets.
OUT_OF_SCOPE = {"flavouring": "Reg 1334/2008", "enzyme": "Reg 1332/2008", "food_ingredient": "not an additive", "compound": "not an additive"}
UNRESOLVED = ("unknown", "ambiguous")
BLOCKING = ("not_authorised_eu", "not_permitted_in_category")
PERMITTING = ("permitted_qs", "permitted_with_limit", "permitted_with_conditions")


def with_lineage(ids: DataFrame, column: str) -> DataFrame:
    """The distinct ids, each with itself and its broader codes: column, code, step (0: itself)."""
    return ids.select(column).where(F.col(column).isNotNull()).distinct().select(column, F.posexplode(lineage(F.col(column))).alias("step", "code"))


def standing(ids: DataFrame, column: str, permits: DataFrame) -> DataFrame:
    """Per distinct id: whether it, or a broader code, appears at all, and the nearest code that is prohibited."""
    codes = permits.groupBy(F.col("canonical_id").alias("code")).agg(F.max(F.col("status") == "prohibited").alias("banned"))
    met = with_lineage(ids, column).join(codes, "code")
    return met.groupBy(column).agg(F.lit(True).alias("appears"), F.min_by(F.when(F.col("banned"), F.col("code")), F.when(F.col("banned"), F.col("step"))).alias("prohibited_id"))


def _nearest(steps: DataFrame, column: str, permits: DataFrame) -> DataFrame:
    """column, fcs_code, best: the provision of each id in each category that has one, the code's own or else the nearest broader one's."""
    chosen = select_rows(permits.where("fcs_code <> ''"), "canonical_id", "fcs_code").withColumnRenamed("canonical_id", "code")
    best = F.min_by(F.struct("step", "flags", "status", "max_level_mg_kg", "max_level_basis", "conditions", "note_codes", "source_url"), "step")
    return steps.join(chosen, "code").groupBy(column, "fcs_code").agg(best.alias("best"))


def _told(b: Column) -> tuple[Column, Column]:
    """Verdict and flags of a provision."""
    own, none = verdict_of(b["status"], b["conditions"], b["max_level_mg_kg"]), F.array().cast("array<string>")
    flags = F.concat(
        b["flags"],
        F.when(b["step"] > 0, F.array(F.lit("widened_to_parent_for_lookup"))).otherwise(none),
        F.when(own == "not_authorised_eu", F.array(F.lit("prohibited"))).otherwise(none),
        F.when(F.coalesce(b["source_url"], F.lit("")) == "", F.array(F.lit("uncitable_verdict"))).otherwise(none),
    )
    return own, flags


def lookup(probes: DataFrame, permits: DataFrame) -> DataFrame:
    """The provision for each distinct (canonical_id, fcs_code) of probes: the code's own, else the nearest broader one's.

    Adds verdict, level, basis, conditions, flags; a pair without any provision gets not_permitted_in_category if the
    substance appears elsewhere, else not_authorised_eu. Work is per distinct pair, not per item.
    """
    pairs = probes.select("canonical_id", "fcs_code").where("canonical_id is not null").distinct()
    best = _nearest(with_lineage(pairs, "canonical_id"), "canonical_id", permits)
    out = pairs.join(best, ["canonical_id", "fcs_code"], "left").join(standing(pairs, "canonical_id", permits), "canonical_id", "left")
    b = F.col("best")
    own, told = _told(b)
    verdict = F.when(b.isNotNull(), own).when(F.col("appears"), "not_permitted_in_category").otherwise("not_authorised_eu")
    flags = F.when(b.isNotNull(), told).otherwise(F.array().cast("array<string>"))
    return out.select(
        "canonical_id", "fcs_code", verdict.alias("verdict"), b["max_level_mg_kg"].alias("max_level_mg_kg"), b["max_level_basis"].alias("max_level_basis"),
        b["conditions"].alias("conditions"), b["note_codes"].alias("note_codes"), flags.alias("flags"),
    )


def laws(ids: DataFrame, column: str, permits: DataFrame) -> DataFrame:
    """One row per distinct id that appears: appears, prohibited_id, and a map of the categories that have a provision to verdict, level and flags.

    As many entries as substances have categories, whatever the number of items.
    """
    ids = written(ids.select(column).where(F.col(column).isNotNull()).distinct(), "ids")
    near = _nearest(with_lineage(ids, column), column, permits.withColumn("note_codes", F.array().cast("array<string>")))
    verdict, flags = _told(F.col("best"))
    own = F.struct(verdict.alias("verdict"), F.col("best.max_level_mg_kg").alias("level"), flags.alias("flags"))
    maps = near.groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct(F.col("fcs_code"), own))).alias("provisions"))
    return standing(ids, column, permits).join(maps, column, "left")


def evaluate(resolved: DataFrame, candidates: DataFrame, permits: DataFrame, confirmed: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """One row per item: headline, certainty, flags and the verdicts by candidate category.

    resolved: label_id, item_id, classification, canonical_ins, eu_canonical_id. candidates: label_id, rank, fcs_code.
    confirmed: label_id of labels whose category a user confirmed. ids: eu_canonical_id of all items, or of more, where
    that is cheaper to get than from resolved; the law is looked up for these. The order of the decisions is that of the law:
    scope, identity, absence, prohibition, category. Items meet the candidates by label and the law by id; they are not
    spread over categories.
    """
    tops = candidates.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("rank", "fcs_code"))).alias("tops"))
    state = small(laws(resolved if ids is None else ids, "eu_canonical_id", permits), "laws", 200_000, F.coalesce(F.size("provisions"), F.lit(0)) + 1)
    items = resolved.join(tops, "label_id", "left").join(state, "eu_canonical_id", "left")
    elsewhere = F.when(F.col("appears"), "not_permitted_in_category").otherwise("not_authorised_eu")

    def judge(x: Column) -> Column:
        own = x["own"]
        return F.struct(
            x["rank"].alias("rank"), x["fcs_code"].alias("fcs_code"), F.coalesce(own["verdict"], elsewhere).alias("verdict"), own["level"].alias("level"),
            F.coalesce(own["flags"], F.array().cast("array<string>")).alias("flags"),
        )

    # a map is searched once for each candidate: its entry is a variable of the second transform, and explode keeps the result from being computed again for each column
    met = F.transform(F.filter("tops", lambda x: x["fcs_code"].isNotNull()), lambda x: F.struct(x["rank"].alias("rank"), x["fcs_code"].alias("fcs_code"), F.try_element_at("provisions", x["fcs_code"]).alias("own")))
    items = items.select("*", F.explode(F.array(F.when(F.col("eu_canonical_id").isNotNull(), F.transform(met, judge)))).alias("by")).drop("provisions")
    items = items.withColumn("by_category", F.when(F.size("by") > 0, F.col("by"))).drop("by")
    if confirmed is not None:
        items = items.join(confirmed.select("label_id", F.lit(True).alias("confirmed")).distinct(), "label_id", "left")
    else:
        items = items.withColumn("confirmed", F.lit(False))
    none = F.array().cast("array<string>")
    kind = F.col("classification")
    scope = F.create_map(*(F.lit(x) for kv in OUT_OF_SCOPE.items() for x in kv))
    absent = F.col("eu_canonical_id").isNull() & F.col("canonical_ins").isNotNull() & (kind == "additive")
    listed = F.flatten(F.transform("by_category", lambda x: x["flags"]))
    confirmation = F.when(F.coalesce(F.col("confirmed"), F.lit(False)), "category_confirmed_by_user").otherwise("category_unconfirmed")
    first = F.get("by_category", F.lit(0))["verdict"]
    out_of_scope, unresolved = kind.isin(*OUT_OF_SCOPE), kind.isin(*UNRESOLVED)
    banned, no_category = F.col("prohibited_id").isNotNull(), F.col("tops").isNull()
    judged = ~out_of_scope & ~unresolved & F.col("eu_canonical_id").isNotNull() & ~banned & ~no_category
    headline = (
        F.when(out_of_scope, "out_of_scope")
        .when(unresolved, "unresolved")
        .when(absent, "not_authorised_eu")
        .when(F.col("eu_canonical_id").isNull(), "unresolved")
        .when(banned, "not_authorised_eu")
        .when(no_category, F.when(F.col("appears"), "category_unknown").otherwise("not_authorised_eu"))
        .otherwise(first)
    )
    flags = (
        F.when(out_of_scope, F.array(F.concat(F.lit("governing_regulation: "), F.element_at(scope, kind))))
        .when(unresolved, none)
        .when(absent, F.array(F.lit("not_in_eu_list")))
        .when(F.col("eu_canonical_id").isNull(), none)
        .when(banned, F.concat(F.array(F.lit("prohibited")), F.when(F.col("prohibited_id") != F.col("eu_canonical_id"), F.array(F.lit("widened_to_parent_for_lookup"))).otherwise(none)))
        .when(no_category, none)
        .otherwise(F.array_distinct(F.concat(F.array(confirmation), listed)))
    )
    kinds = F.array_distinct(F.transform("by_category", lambda x: x["verdict"]))
    sensitive = F.coalesce(judged & (F.size(kinds) > 1), F.lit(False))
    conflict = sensitive & first.isin(*BLOCKING) & F.exists("by_category", lambda x: (x["rank"] > 1) & x["verdict"].isin(*PERMITTING))
    return items.select(
        "label_id", "item_id", "eu_canonical_id", headline.alias("headline"), sensitive.alias("category_sensitive"),
        F.when(sensitive, "category_dependent").otherwise("certain").alias("verdict_certainty"), F.coalesce(conflict, F.lit(False)).alias("category_conflict"),
        flags.alias("flags"), F.when(judged, F.col("by_category")).alias("by_category"),
    )


def evidence(items: DataFrame, permits: DataFrame) -> DataFrame:
    """What the law says on each item, in the order a verdict looks: label_id, item_id, kind, at (the code that decides) and lines.

    items: label_id, item_id, classification, canonical_ins, eu_canonical_id, fcs_code (null: none pinned). The lines of an
    exact or widened hit are its provisions by row_ord, those of a hit elsewhere the distinct codes, categories and states.
    Work is per distinct pair and per distinct id.
    """
    kind = F.col("classification")
    unknown = kind.isin(*UNRESOLVED) | (F.col("eu_canonical_id").isNull() & F.col("canonical_ins").isNull())
    structural = F.when(kind.isin(*OUT_OF_SCOPE), "out_of_scope").when(unknown, "unresolved").when(F.col("eu_canonical_id").isNull(), "absent")
    level = F.coalesce(F.concat(F.col("max_level_mg_kg").cast("string"), F.lit(" mg/kg")), F.lit("no numeric cap"))
    text = F.coalesce(F.nullif(F.replace("conditions", F.lit("\n"), F.lit(" ")), F.lit("")), F.lit("(none)"))
    line = F.concat(F.lit("status="), "status", F.lit(", level="), level, F.lit(", conditions: "), text)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_ord", line.alias("line")))), lambda x: x["line"]).alias("lines")
    held = permits.where("fcs_code <> ''").groupBy(F.col("canonical_id").alias("code"), "fcs_code").agg(listed)
    asked = written(items.select("eu_canonical_id", "fcs_code").where("eu_canonical_id is not null").distinct(), "asked")
    pairs = asked.where("fcs_code is not null")
    places = permits.where("fcs_code <> ''").select(F.col("canonical_id").alias("code"), "fcs_code").distinct()
    near = with_lineage(pairs, "eu_canonical_id").join(pairs, "eu_canonical_id").join(places, ["code", "fcs_code"])
    near = small(near.groupBy("eu_canonical_id", "fcs_code").agg(F.min_by(F.struct("step", "code"), "step").alias("near")), "near")
    place = F.concat("code", F.lit(" in "), F.when(F.col("fcs_code") == "", "no category").otherwise(F.col("fcs_code")), F.lit(": status="), "status")
    states = permits.select(F.col("canonical_id").alias("code"), "fcs_code", "status").distinct()
    far = with_lineage(asked, "eu_canonical_id").join(states, "code").groupBy("eu_canonical_id").agg(F.array_sort(F.collect_set(place)).alias("lines"))
    state = small(standing(asked, "eu_canonical_id", permits), "standing")
    rows = items.join(near, ["eu_canonical_id", "fcs_code"], "left").join(state, "eu_canonical_id", "left")
    hit = F.col("near.step").isNotNull()
    found = (
        F.when(structural.isNotNull(), structural)
        .when(F.col("prohibited_id").isNotNull(), "prohibited")
        .when(F.col("fcs_code").isNull(), "no_pin")
        .when(hit, F.when(F.col("near.step") == 0, "exact").otherwise("widened"))
        .when(F.col("appears"), "elsewhere")
        .otherwise("nowhere")
    )
    rows = rows.select("label_id", "item_id", "eu_canonical_id", "fcs_code", "near", "prohibited_id", found.alias("kind"))
    here, there = F.col("kind").isin("exact", "widened"), F.col("kind") == "elsewhere"
    rows = rows.select(
        "label_id", "item_id", "kind", F.when(F.col("kind") == "prohibited", F.col("prohibited_id")).when(here, F.col("near.code")).alias("at"),
        F.when(here, F.col("near.code")).when(there, F.col("eu_canonical_id")).alias("of"), F.when(here, F.col("fcs_code")).when(there, "").alias("within"),
    )
    # one last join brings the lines, which may be long: rows that have them are not dealt out again
    lines = held.select(F.col("code").alias("l_of"), F.col("fcs_code").alias("l_within"), "lines").unionByName(far.select(F.col("eu_canonical_id").alias("l_of"), F.lit("").alias("l_within"), "lines"))
    rows = rows.join(lines, (F.col("of") == F.col("l_of")) & (F.col("within") == F.col("l_within")), "left")
    return rows.select("label_id", "item_id", "kind", "at", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def is_blocking(headline: Column, certainty: Column) -> Column:
    return headline.isin(*BLOCKING) & (certainty == "certain")


def roll_up(items: DataFrame) -> DataFrame:
    """One row per label: the lists of blocking, conflicting, review and sensitive items, and a summary."""
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("item_id"))))
    head = F.col("headline")
    review = head.isin("unresolved", "category_unknown", "permitted_with_conditions") | F.col("category_conflict")
    grouped = items.groupBy("label_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        ids(is_blocking(head, F.col("verdict_certainty"))).alias("blocking"),
        ids(F.col("category_conflict")).alias("category_conflict"),
        ids(review).alias("review_required"),
        ids(F.col("category_sensitive")).alias("category_sensitive_items"),
        F.count_if(head == "category_unknown").alias("n_category_unknown"),
    )
    listed = F.concat(F.lit("["), F.array_join(F.transform("blocking", lambda x: x.cast("string")), ", "), F.lit("]"))
    blocked = F.when(F.size("blocking") > 0, F.concat(F.size("blocking").cast("string"), F.lit(" item(s) NOT PERMITTED (item_id "), listed, F.lit(") -- see flags."))).otherwise("No item was found not permitted.")
    summary = F.concat(F.col("n_items").cast("string"), F.lit(" item(s) evaluated. "), blocked)
    return grouped.withColumn("summary", summary)


def count_buckets(items: DataFrame) -> DataFrame:
    """Four counts per label that exclude one another and add up to its items."""
    head = F.col("headline")
    needs = head.isin("unresolved", "category_unknown") | F.col("category_conflict")
    blocked = is_blocking(head, F.col("verdict_certainty")) & ~needs
    permitted = head.isin(*PERMITTING) & ~needs & ~blocked
    return items.groupBy("label_id").agg(
        F.count_if(blocked).alias("n_blocked"), F.count_if(needs).alias("n_review"), F.count_if(permitted).alias("n_permitted"),
        F.count_if(~blocked & ~needs & ~permitted).alias("n_other"),
    )
