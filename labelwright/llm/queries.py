"""The registered query of each training-data operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filter_audit, html_extract, lm_score, lsh_forest, mixing, pu_quality, repetition, resampling, sharding, simhash, superkmer, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.curriculum)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("position"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")), toxicity.held_out_quarter())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out_quarter().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is every document labelled as good; the background is the whole table."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score_corpus(table(spark, sf_dir, "documents"), good)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = repetition.repetition_rules(table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pu_quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")), pu_quality.held_out_third())
    scored = pu_quality.score(docs, model)
    return scored.select("doc_id", pu_quality.held_out_third().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.dedup(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.classes(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_lm_score": op4_lm_score,
    "op5_html": op5_html,
    "op6_repetition": op6_repetition,
    "op7_quality": op7_quality,
    "op8_substrings": op8_substrings,
    "op9_sharding": op9_sharding,
    "op10_jaccard": op10_jaccard,
    "op11_filter_audit": op11_filter_audit,
    "op12_simhash": op12_simhash,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {
    "op1_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        totals AS (SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source),
        weighed AS (
            SELECT source, n, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
            FROM totals),
        filled AS (
            SELECT *, 1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                   sum(w) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
            FROM weighed),
        level AS (
            SELECT min(remaining / weight) FILTER (WHERE 2 * n * weight > remaining * w) AS ratio,
                   min(2 * n / w) FILTER (WHERE 2 * n * weight > remaining * w) AS lowest FROM filled),
        first AS (SELECT remaining AS r, weight AS s FROM filled, level WHERE 2 * n / w = lowest ORDER BY weight DESC LIMIT 1),
        targets AS (
            SELECT source, n AS source_size, least(2.0 * n, coalesce((SELECT r * w / s FROM first), 2.0 * n)) AS target, w AS mean,
                   CASE w WHEN 3 THEN 4.0 WHEN 1 THEN 0.5 ELSE 2.0 END::DOUBLE AS w0, CASE w WHEN 3 THEN 2.0 WHEN 1 THEN 1.5 ELSE 2.0 END::DOUBLE AS w1 FROM weighed),
        demand AS (SELECT sum(target * w0 / mean) / sum(target) AS v, sum(target * (w1 - w0) / mean) / 2 / sum(target) AS c FROM targets),
        placed AS (
            SELECT doc_id, size, source_size, target, round(target)::BIGINT AS tokens, mean, w0, w1,
                   sum(size) OVER (PARTITION BY s.source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        due AS (
            SELECT *, least(1.0, before / greatest(target, 1.0))::DOUBLE * mean AS need,
                   (CASE WHEN source_size = 0 THEN 0
                         ELSE (tokens // source_size) * size + least(greatest(tokens % source_size - before, 0), size) END)::BIGINT AS taken
            FROM placed),
        inverted AS (
            SELECT *, least(1.0, CASE WHEN need = 0 THEN 0 ELSE 2 * need / (w0 + sqrt(greatest(0, w0 * w0 + 2 * (w1 - w0) * need))) END)::DOUBLE AS x FROM due)
        SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(least(1.0, v * x + c * x * x), 6) END AS position
        FROM inverted, demand""",
    "op6_repetition": r"""
        WITH lists AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS l FROM documents),
        words AS (SELECT doc_id, i, l[i] AS word FROM lists, unnest(range(1, len(l) + 1)) AS u(i)),
        windows AS (
            SELECT doc_id, n, i, array_to_string(l[i:i + n - 1], ' ') AS win
            FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM lists, (VALUES (5), (6), (7), (8), (9), (10)) AS s(n) WHERE len(l) >= n)),
        repeated AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, win) AS c FROM windows) WHERE c > 1),
        covered AS (SELECT DISTINCT doc_id, n, i + j AS p FROM repeated, unnest(range(0, n)) AS u(j)),
        shares AS (
            SELECT c.doc_id, c.n, count(*) AS n_covered, sum(length(word)) AS chars FROM covered c JOIN words w ON c.doc_id = w.doc_id AND c.p = w.i GROUP BY 1, 2),
        lines AS (
            SELECT doc_id, line, count(*) - 1 AS again, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM lists) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
        dup AS (SELECT doc_id, sum(again) AS n_dup_lines, sum(again * chars) AS dup_chars FROM lines GROUP BY 1),
        base AS (
            SELECT doc_id, len(l)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM lists),
        over AS (
            SELECT s.doc_id, max(CASE WHEN n = 5 THEN n_covered END) AS n_repeat, bool_or(chars > (CASE n WHEN 5 THEN 0.20 WHEN 6 THEN 0.19 WHEN 7 THEN 0.18 WHEN 8 THEN 0.17 WHEN 9 THEN 0.16 ELSE 0.15 END)::DOUBLE * word_chars) AS above
            FROM shares s JOIN base USING (doc_id) GROUP BY 1)
        SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
               (n_words < 10 OR 100 * coalesce(n_repeat, 0) > 20 * n_words) AS base_failed,
               NOT (n_words < 10 OR 100 * coalesce(n_repeat, 0) > 20 * n_words) AND NOT coalesce(above, false) AND coalesce(dup_chars, 0) <= 0.30::DOUBLE * word_chars AS kept
        FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN over USING (doc_id)""",
    "op8_substrings": r"""
        WITH words AS (
            SELECT doc_id, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        windows AS (
            SELECT doc_id, i AS start, array_to_string(w[i:i + 19], ' ') AS win
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
        late AS (
            SELECT doc_id, start FROM (
                SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS k FROM windows) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, start + j AS p FROM late, unnest(range(0, 20)) AS u(j)),
        each AS (
            SELECT words.doc_id, k AS p, w[k] AS word FROM words, unnest(range(1, len(w) + 1)) AS v(k)),
        kept AS (
            SELECT each.doc_id, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY each.p) AS kept, count(gone.p) AS n_removed
            FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p GROUP BY each.doc_id)
        SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id""",
    "op11_filter_audit": r"""
        WITH rows AS (SELECT *, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
        counted AS (
            SELECT *, coalesce(regexp_extract_all(body, '[^\x20\x09-\x0D]+'), []) AS w, min(doc_id) OVER (PARTITION BY body) < doc_id AS copy FROM rows),
        known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        flags AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) | (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
                   | (CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 4 ELSE 0 END)
                   | (CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END) | (CASE WHEN copy THEN 16 ELSE 0 END) AS mask
            FROM counted LEFT JOIN known USING (doc_id)),
        cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM flags GROUP BY part, mask),
        letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)),
        orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
              AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        steps AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier FROM orders, range(1, 6) AS r(step)),
        figures AS (
            SELECT part, filter_order, step, bit,
                   coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n_good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(n_toxic) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
            FROM cells, steps GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM figures""",
    "op13_resampling": r"""
        WITH texts AS (
            SELECT doc_id, true AS ours, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
            UNION ALL
            SELECT item_id, false, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) FROM benchmark),
        runs AS (
            SELECT doc_id, ours, unnest(w) AS f FROM texts
            UNION ALL
            SELECT doc_id, ours, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts),
        spelled AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM runs)),
        -- the bits of CRC-32: each byte is read as itself and eight shifts
        hashed AS (
            SELECT f, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(x), 2),
                    lambda i: [(16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 10000 AS bucket FROM spelled),
        placed AS (SELECT doc_id, ours, bucket FROM runs JOIN hashed USING (f)),
        counts AS (SELECT bucket, count(*) FILTER (ours) AS s, count(*) FILTER (NOT ours) AS t FROM placed GROUP BY bucket),
        sums AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM counts),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM counts, sums),
        weights AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE ours GROUP BY doc_id),
        scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score
            FROM texts LEFT JOIN weights USING (doc_id) WHERE ours),
        able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (doc_id)""",
}
