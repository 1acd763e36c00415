"""Document-vs-table discrepancy detection, expressed as joins and aggregations.

Reference semantics per entity: every document fact is compared with its single
best table fact (Jaccard of label tokens >= threshold; on equal similarity the
later table fact wins), values are snapped to the same power of 1000, and the
pair is reported when ``lo <= |delta| / |doc| <= hi``.

Scale plan (no all-pairs step anywhere):

1. Candidates meet on an inverted index: ``(entity, token)`` equi-join, so
   facts that share no token are never paired (no cross join).
2. Table facts are reduced to the last fact per ``(entity, label)``: that is the
   only one that can win a tie, so the fan-out per document fact is bounded by
   the number of matching labels. Both reductions are partial aggregations.
3. The best candidate per document fact is the last table fact among the most
   similar ones: two hash aggregates over numbers, not a window sort. Labels and
   texts are joined back to what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..session import materialize


def label_similarity(doc_labels: DataFrame, db_labels: DataFrame,
                     threshold: float = rules.MATCH_THRESHOLD) -> DataFrame:
    """``(doc_label, db_label, sim)`` for every label pair with Jaccard >= threshold.

    Token-index join: pairs that share no token are never formed. A pair can
    only reach the threshold if the smaller token set is at least ``threshold``
    times the larger, which prunes before the join output is aggregated.
    """
    d = (doc_labels.select(F.col("label").alias("doc_label")).distinct()
         .withColumn("dt", T.label_tokens("doc_label"))
         .withColumn("dn", F.size("dt")).where(F.col("dn") > 0))
    b = (db_labels.select(F.col("label").alias("db_label")).distinct()
         .withColumn("bt", T.label_tokens("db_label"))
         .withColumn("bn", F.size("bt")).where(F.col("bn") > 0))
    de = d.select("doc_label", "dn", F.explode("dt").alias("tok"))
    be = b.select("db_label", "bn", F.explode("bt").alias("tok"))
    pairs = (de.join(be, "tok")
             .where(F.least("dn", "bn") >= F.lit(threshold) * F.greatest("dn", "bn"))
             .groupBy("doc_label", "db_label", "dn", "bn")
             .agg(F.count(F.lit(1)).alias("inter")))
    sim = F.col("inter") / (F.col("dn") + F.col("bn") - F.col("inter"))
    return pairs.select("doc_label", "db_label", sim.alias("sim")).where(F.col("sim") >= threshold)


def matched_numbers(doc_facts: DataFrame, db_facts: DataFrame, threshold: float = rules.MATCH_THRESHOLD) -> DataFrame:
    """(entity_id, doc_ix, doc_value, db_ix, db_value, sim): the best table fact
    of each document fact, by keys and numbers alone.

    Candidates meet on ``(entity_id, token)``: a document fact only ever pairs
    with the distinct labels of its own entity that share a token with it. They
    are dealt once by document fact; counting shared tokens, taking the last of
    equally similar facts and the most similar one are hash aggregates there."""
    last = (db_facts.groupBy("entity_id", "label").agg(F.max("ix").alias("db_ix"), F.max_by("value", "ix").alias("db_value"))
            .withColumn("bt", T.label_tokens("label")).withColumn("bn", F.size("bt")))
    be = last.select("entity_id", "db_ix", "db_value", "bn", F.explode("bt").alias("tok"))
    d = (doc_facts.select("entity_id", F.col("ix").alias("doc_ix"), F.col("value").alias("doc_value"), T.label_tokens("label").alias("dt"))
         .withColumn("dn", F.size("dt")))
    de = d.select("entity_id", "doc_ix", "doc_value", "dn", F.explode("dt").alias("tok"))
    met = (de.join(be, ["entity_id", "tok"])
           # |a ∩ b| / |a ∪ b| >= t needs min(|a|,|b|) >= t * max(|a|,|b|)
           .where(F.least("dn", "bn") >= F.lit(threshold) * F.greatest("dn", "bn")).drop("tok").repartition("entity_id", "doc_ix"))
    numbers = ["doc_value", "dn", "db_value", "bn"]
    pairs = met.groupBy("entity_id", "doc_ix", "db_ix").agg(F.count(F.lit(1)).alias("inter"), *[F.first(c).alias(c) for c in numbers])
    cand = pairs.withColumn("sim", F.col("inter") / (F.col("dn") + F.col("bn") - F.col("inter"))).where(F.col("sim") >= threshold)
    last_of = (cand.groupBy("entity_id", "doc_ix", "sim")
               .agg(F.max("db_ix").alias("db_ix"), F.max_by("db_value", "db_ix").alias("db_value"), F.first("doc_value").alias("doc_value")))
    best = last_of.groupBy("entity_id", "doc_ix").agg(F.max("sim").alias("sim"), F.max_by("db_ix", "sim").alias("db_ix"),
                                                      F.max_by("db_value", "sim").alias("db_value"), F.first("doc_value").alias("doc_value"))
    return best.select("entity_id", "doc_ix", "doc_value", "db_ix", "db_value", "sim")


def with_texts(matches: DataFrame, doc_facts: DataFrame, db_facts: DataFrame) -> DataFrame:
    """Labels and texts of matched facts, by their numbers: doc_label, doc_raw, db_label, db_raw."""
    ours = doc_facts.select("entity_id", F.col("ix").alias("doc_ix"), F.col("label").alias("doc_label"), F.col("raw_text").alias("doc_raw"))
    theirs = db_facts.select("entity_id", F.col("ix").alias("db_ix"), F.col("label").alias("db_label"), F.col("raw_text").alias("db_raw"))
    return matches.join(ours, ["entity_id", "doc_ix"]).join(theirs, ["entity_id", "db_ix"])


def best_matches(doc_facts: DataFrame, db_facts: DataFrame,
                 threshold: float = rules.MATCH_THRESHOLD) -> DataFrame:
    """One best table fact per document fact (``label_match_join`` +
    ``best_match_per_fact``). Columns: entity_id, doc_ix, doc_label, doc_value,
    doc_raw, db_ix, db_label, db_value, db_raw, sim. Facts are found once and
    written; a fact is named by (entity_id, ix)."""
    doc, db = materialize(doc_facts, "doc-facts"), materialize(db_facts, "db-facts")
    return with_texts(matched_numbers(doc, db, threshold), doc, db).select(
        "entity_id", "doc_ix", "doc_label", "doc_value", "doc_raw", "db_ix", "db_label", "db_value", "db_raw", "sim")


def score_pairs(pairs: DataFrame, lo: float = rules.DELTA_LOW, hi: float = rules.DELTA_HIGH,
                flagged_only: bool = True) -> DataFrame:
    """Scale alignment, delta, percent and the [lo, hi] flag on matched pairs."""
    doc_v, db_v = T.align_scale("doc_value", "db_value")
    out = (pairs.withColumn("doc_aligned", doc_v).withColumn("db_aligned", db_v)
           .withColumn("delta", F.col("db_aligned") - F.col("doc_aligned"))
           .withColumn("pct", F.when(F.col("doc_aligned") != 0,
                                     F.col("delta") / F.col("doc_aligned") * 100.0))
           .withColumn("rel", F.when(F.col("doc_aligned") != 0,
                                     F.abs(F.col("delta") / F.col("doc_aligned")))
                       .otherwise(F.abs("delta")))
           .withColumn("flagged", (F.col("rel") >= lo) & (F.col("rel") <= hi)))
    return out.where("flagged") if flagged_only else out


def detect_discrepancies(doc_facts: DataFrame, db_facts: DataFrame,
                         match: float = rules.MATCH_THRESHOLD, lo: float = rules.DELTA_LOW,
                         hi: float = rules.DELTA_HIGH) -> DataFrame:
    """Flagged discrepancies: entity_id, doc_ix, label, doc_value, db_value,
    delta, pct, doc_snippet, db_snippet. Matching and scoring see keys and
    numbers; labels and texts join the flagged pairs only."""
    doc, db = materialize(doc_facts, "doc-facts"), materialize(db_facts, "db-facts")
    scored = with_texts(score_pairs(matched_numbers(doc, db, match), lo, hi), doc, db)
    n = rules.SNIPPET_CHARS
    return scored.select(
        "entity_id", "doc_ix",
        T.canonical_label("doc_label", "db_label").alias("label"),
        F.col("doc_aligned").alias("doc_value"), F.col("db_aligned").alias("db_value"),
        "delta", "pct",
        F.substring("doc_raw", 1, n).alias("doc_snippet"),
        F.substring("db_raw", 1, n).alias("db_snippet"))


def checked_pairs(doc_facts: DataFrame, db_facts: DataFrame,
                  match: float = rules.MATCH_THRESHOLD) -> DataFrame:
    """Per entity: how many document facts found a table partner."""
    return (matched_numbers(doc_facts, db_facts, match)
            .groupBy("entity_id").agg(F.count(F.lit(1)).alias("checked_pairs")))


def reconcile(stated: DataFrame, computed: DataFrame, keys: list[str], stated_col: str,
              computed_col: str, label: str, lo: float = rules.DELTA_LOW,
              hi: float = rules.DELTA_HIGH) -> DataFrame:
    """Table-vs-table form: a stated figure against a computed one on the same key
    (labels are known to match, so the label join collapses to an equi-join)."""
    pairs = (stated.select(*keys, F.col(stated_col).alias("doc_value"))
             .join(computed.select(*keys, F.col(computed_col).alias("db_value")), keys))
    scored = score_pairs(pairs, lo, hi)
    return scored.select(*keys, F.lit(label).alias("label"),
                         F.col("doc_aligned").alias("doc_value"),
                         F.col("db_aligned").alias("db_value"), "delta", "pct")


def report_lines(discrepancies: DataFrame) -> DataFrame:
    """The reference's prompt block as ordered rows ``(entity_id, line_key, line)``:
    a header (key 0), one line per discrepancy (key doc_ix + 1) and a footer.
    Kept as rows so a large entity never becomes one giant value."""
    sign = F.when(F.col("delta") >= 0, F.lit("+")).otherwise(F.lit(""))
    pct = F.when(F.col("pct").isNotNull(),
                 F.concat(F.lit(" ("), sign, F.format_string("%.1f", F.col("pct")), F.lit("%)"))
                 ).otherwise(F.lit(""))
    item = F.concat(
        F.lit("  [DISCREPANCY] "), F.col("label"), F.lit(": Doc says "),
        T.format_number_plain("doc_value"), F.lit(" [Source: "), F.col("doc_snippet"),
        F.lit("]. DB shows "), T.format_number_plain("db_value"), F.lit(" [DB: "),
        F.col("db_snippet"), F.lit("]. Delta: "), sign, T.format_number_plain("delta"), pct)
    head = F.lit("\n\nPRE-COMPUTED DISCREPANCY ANALYSIS (use these exact numbers):")
    foot = F.lit("Flag each of the above with [DISCREPANCY] in your answer. "
                 "Do NOT invent additional discrepancies beyond those listed.")
    # one pass over the discrepancies: every row emits the entity's header and
    # footer too; duplicates of those two collapse in one aggregation
    three = F.array(F.struct(F.lit(0).cast("long").alias("line_key"), head.alias("line")),
                    F.struct((F.col("doc_ix") + 1).cast("long").alias("line_key"), item.alias("line")),
                    F.struct(F.lit(2 ** 62).cast("long").alias("line_key"), foot.alias("line")))
    rows = discrepancies.select("entity_id", F.inline(three))
    return rows.groupBy("entity_id", "line_key").agg(F.first("line").alias("line"))
