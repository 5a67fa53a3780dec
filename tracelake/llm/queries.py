"""The queries of the text and algorithm problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import canonical, cooccur, leaks, looks, mixing, setjoin, truncation
from tracelake.runtime import cut, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    terms = looks.unusual_texts(table(spark, folder, "case_terms"), "term_id", "term")
    names = looks.unusual_texts(table(spark, folder, "scenarios"), "scenario_id", "name")
    both = terms.withColumn("field_name", F.lit("case_terms.term")).unionByName(names.withColumn("field_name", F.lit("scenarios.name")))
    return both.select("field_name", "record_id").distinct()


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term and scenario name in its consistent form, repeated rows once."""
    texts = table(spark, folder, "case_terms").select(F.lit("case_terms.term").alias("field_name"), F.col("term_id").alias("record_id"), F.col("term").alias("text"))
    names = table(spark, folder, "scenarios").select(F.lit("scenarios.name").alias("field_name"), F.col("scenario_id").alias("record_id"), F.col("name").alias("text"))
    return texts.unionByName(names).distinct().select("field_name", "record_id", looks.consistent_form("text").alias("form"))


def _case_sets(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "case_terms").where(F.trim("normalized") != "")
    return setjoin.record_sets(terms, "case_id", ["term_type", "normalized"], 4)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, members = setjoin.similar_records(_case_sets(spark, folder), 0.6)
    return setjoin.expand_pairs(pairs, members).toDF("case_id_a", "case_id_b")


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per case: its class of equal sets and the number of other classes similar to it. Nothing is expanded."""
    pairs, members = setjoin.similar_records(_case_sets(spark, folder), 0.6)
    pairs = cut(pairs, "setjoin-links")
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, "rep", "left").select(F.col("record").alias("case_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _service_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """The services changed in each trusted or candidate case."""
    usable = table(spark, folder, "cases").where(F.col("knowledge_tier").isin("trusted", "candidate")).select("case_id").distinct()
    changes = table(spark, folder, "service_changes").select("case_id", "service").join(usable, "case_id", "left_semi")
    return cooccur.baskets(changes, "case_id", "service")


def _cochange_stripes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "service_cochange").select(
        "batch_no", F.col("service_a").alias("item_a"), F.col("service_b").alias("item_b"),
        F.col("case_count").cast("long").alias("n"), F.from_json("case_ids_json", "array<string>").alias("ids"),
    )
    return cooccur.partial_count_stripes(rows)


def _rated(spark: SparkSession, folder: str, least: int = 1) -> DataFrame:
    """The pairs of service_cochange with least cases or more, rated against the cases."""
    entries = cooccur.entries_of(cooccur.merged_stripes(_cochange_stripes(spark, folder))).where(F.col("c") >= least)
    return cooccur.significance(entries, _service_baskets(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    # with 5 cases and a lift of 3.7 the ratio is 5.7 at least, so the test of significance drops no case
    found = _rated(spark, folder, 5).where((F.col("lift") >= 3.7) & (F.col("llr") >= cooccur.SIGNIFICANT))
    return found.select(F.col("item_a").alias("service_a"), F.col("item_b").alias("service_b"))


def _rounded(rated: DataFrame) -> DataFrame:
    return rated.select(
        F.col("item_a").alias("service_a"), F.col("item_b").alias("service_b"), "c",
        F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"),
    )


def p4_rated(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of service_cochange with its count, lift and log-likelihood ratio."""
    return _rounded(_rated(spark, folder))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of services changed together, counted from the cases themselves."""
    baskets = _service_baskets(spark, folder)
    return _rounded(cooccur.significance(cooccur.entries_of(cooccur.merged_stripes(cooccur.basket_stripes(baskets))), baskets))


_P4_BASKETS = """
usable AS (SELECT DISTINCT case_id FROM cases WHERE knowledge_tier IN ('trusted', 'candidate')),
baskets AS (SELECT DISTINCT case_id, lower(trim(service)) AS service FROM service_changes SEMI JOIN usable USING (case_id)),
total AS (SELECT count(DISTINCT case_id) AS n FROM baskets),
single AS (SELECT service, count(*) AS k FROM baskets GROUP BY 1),
pairs AS (
  SELECT a.service AS service_a, b.service AS service_b, count(*) AS c
  FROM baskets a JOIN baskets b ON a.case_id = b.case_id AND a.service < b.service GROUP BY 1, 2),
rated AS (
  SELECT service_a, service_b, c, x.k AS n_a, y.k AS n_b, n, c * n / (x.k * y.k)::DOUBLE AS lift
  FROM pairs JOIN single x ON x.service = service_a JOIN single y ON y.service = service_b, total)
"""


def _xlx(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END)"


_LLR = (
    f"greatest(0, 2 * ({_xlx('c')} + {_xlx('n_a - c')} + {_xlx('n_b - c')} + {_xlx('n - n_a - n_b + c')} + {_xlx('n')}"
    f" - ({_xlx('n_a')} + {_xlx('n - n_a')} + {_xlx('n_b')} + {_xlx('n - n_b')})))"
)

def _mapped_terms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    reference = table(spark, folder, "canonical_terms").select("ref_id", F.col("canonical").alias("name"))
    terms = table(spark, folder, "case_terms").select("term_id", "term", "normalized")
    return canonical.map_values(terms, "term", reference), reference


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    mapped, reference = _mapped_terms(spark, folder)
    named = mapped.where("ref_id IS NOT NULL")
    # equal to an entry already: nothing to map
    return named.join(reference.select(F.col("name").alias("normalized")), "normalized", "left_anti").select("term_id", "ref_id")


def p6_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many terms name an entry, by how they were matched; `none` are those to report."""
    mapped, _ = _mapped_terms(spark, folder)
    return mapped.groupBy(F.coalesce("how", F.lit("none")).alias("how")).agg(F.count(F.lit(1)).alias("n_terms"))


def _leaks(spark: SparkSession, folder: str, edited: bool) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "heldout_items"), edited=edited)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder, False).select("doc_id", "item_id").distinct()


def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Edited and paraphrased copies too: alignments that reach a third of the item's greatest score."""
    return _leaks(spark, folder, True).select("doc_id", "item_id", F.round("score", 4).alias("score"), "run")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used."""
    documents = cut(mixing.sized(table(spark, folder, "documents"), "doc_id", "source", "text"), "mixing-sized")
    mixed = mixing.mix(documents, table(spark, folder, "source_targets"))
    return mixed.select(F.col("doc").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share each source gets in the mix."""
    documents = cut(mixing.sized(table(spark, folder, "documents"), "doc_id", "source", "text"), "mixing-sized")
    targets = table(spark, folder, "source_targets")
    return mixing.shares(cut(mixing.mix(documents, targets), "mixing-mix"), targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_texts(table(spark, folder, "documents"))


def p9_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """How many cut documents a prefix of each length shows; 16 is a prefix from the start of a unit, or of 16 tokens; null a mark alone."""
    return truncation.judged_texts(table(spark, folder, "documents")).groupBy("k").agg(F.count(F.lit(1)).alias("n_cut"))


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return truncation.cut_shares(documents, truncation.cut_texts(documents))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p7_found": p7_found, "p7_copies": p7_copies, "p9_found": p9_found, "p9_sources": p9_sources, "p9_lengths": p9_lengths, "p6_found": p6_found, "p6_coverage": p6_coverage, "p4_found": p4_found, "p4_pairs": p4_pairs, "p4_rated": p4_rated, "p2_found": p2_found, "p2_forms": p2_forms, "p3_found": p3_found, "p3_classes": p3_classes}

_ODD = (
    r"[\x{ff01}-\x{ff5e}]|[\x{fb00}-\x{fb06}]|[\x{200b}-\x{200f}\x{2060}\x{feff}\x{ad}]|[\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]|[\x{300}-\x{36f}]"
    r"|\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin}|\p{Cyrillic}\p{Greek}|\p{Greek}\p{Cyrillic}"
)

_P3_COMMON = """
WITH items AS (SELECT DISTINCT case_id, term_type, normalized FROM case_terms WHERE trim(normalized) <> ''),
sizes AS (SELECT case_id, count(*) AS n FROM items GROUP BY 1 HAVING count(*) >= 4),
common AS (
  SELECT a.case_id AS case_id_a, b.case_id AS case_id_b, count(*) AS c
  FROM items a JOIN items b ON a.term_type IS NOT DISTINCT FROM b.term_type AND a.normalized = b.normalized AND a.case_id < b.case_id
  GROUP BY 1, 2),
alike AS (
  SELECT case_id_a, case_id_b FROM common
  JOIN sizes x ON x.case_id = case_id_a JOIN sizes y ON y.case_id = case_id_b
  WHERE c >= 0.6::DOUBLE * (x.n + y.n - c) - 1e-9)
"""

SQL = {
    "p2_found": f"""SELECT DISTINCT 'case_terms.term' AS field_name, term_id AS record_id FROM case_terms WHERE regexp_matches(term, '{_ODD}')
      UNION ALL SELECT DISTINCT 'scenarios.name', scenario_id FROM scenarios WHERE regexp_matches(name, '{_ODD}')""",
    "p4_found": f"WITH {_P4_BASKETS} SELECT service_a, service_b FROM rated WHERE c >= 5 AND lift >= 3.7::DOUBLE",
    "p4_pairs": f"""WITH {_P4_BASKETS} SELECT service_a, service_b, c, round(lift, 6) AS lift,
      round(CASE WHEN lift < 1 THEN -{_LLR} ELSE {_LLR} END, 4) AS llr FROM rated""",
    "p4_rated": f"""WITH {_P4_BASKETS},
      lines AS (
        SELECT batch_no, least(lower(trim(service_a)), lower(trim(service_b))) AS service_a, greatest(lower(trim(service_a)), lower(trim(service_b))) AS service_b,
          max(coalesce(case_count, len(list_distinct(case_ids_json::VARCHAR[])), 0)) AS c
        FROM service_cochange WHERE lower(trim(service_a)) <> lower(trim(service_b)) GROUP BY 1, 2, 3),
      counted AS (SELECT service_a, service_b, sum(c)::BIGINT AS c FROM lines WHERE c > 0 GROUP BY 1, 2),
      weighed AS (
        SELECT service_a, service_b, counted.c, x.k AS n_a, y.k AS n_b, n, counted.c * n / (x.k * y.k)::DOUBLE AS lift
        FROM counted JOIN single x ON x.service = service_a JOIN single y ON y.service = service_b, total)
      SELECT service_a, service_b, c, round(lift, 6) AS lift, round(CASE WHEN lift < 1 THEN -{_LLR} ELSE {_LLR} END, 4) AS llr FROM weighed""",
    "p3_classes": f"""{_P3_COMMON},
classes AS (
  SELECT case_id, min(case_id) OVER (PARTITION BY s) AS class_id
  FROM (SELECT case_id, list(struct_pack(a := term_type, b := normalized) ORDER BY term_type, normalized)::VARCHAR AS s FROM items SEMI JOIN sizes USING (case_id) GROUP BY 1)),
pairs AS (
  SELECT DISTINCT a.class_id AS x, b.class_id AS y FROM alike JOIN classes a ON a.case_id = case_id_a JOIN classes b ON b.case_id = case_id_b WHERE a.class_id <> b.class_id),
links AS (SELECT rep, count(DISTINCT other) AS n FROM (SELECT x AS rep, y AS other FROM pairs UNION ALL SELECT y, x FROM pairs) GROUP BY 1)
SELECT case_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes LEFT JOIN links ON rep = class_id""",
    "p3_found": f"{_P3_COMMON} SELECT case_id_a, case_id_b FROM alike",
}
