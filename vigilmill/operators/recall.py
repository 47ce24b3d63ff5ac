"""Recall of texts that mention a target drug, exactly or nearly.

Exact: per drug one alternation of its names, longest first, not beside an
ASCII letter or digit. Fuzzy: letter tokens of at least seven letters within
similarity 0.80 of a name, matched per distinct word of the corpus and not per
text; a drug found exactly is closed to fuzzy evidence, and a token equally
near to two drugs counts for none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASS_TERMS, FUZZY_MIN_LENGTH, FUZZY_SIMILARITY, MOST_TARGETS
from ..functions.osa import close_distance, similarity
from ..functions.text import half_even
from ..session import Scratch
from .dedup import keep_one_delivery

MATCH = "canonical_drug string, matched_text string, matched_alias string, match_type string, edit_distance int, similarity double"


def alias_map(aliases: DataFrame) -> dict[str, list[str]]:
    """``canonical -> names`` (lower case, canonical included) from a table
    with ``canonical, aliases``; bounded by MOST_TARGETS."""
    rows = aliases.select("canonical", "aliases").where("canonical is not null").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target drugs")
    out: dict[str, list[str]] = {}
    for r in rows:
        name = r[0].strip().lower()
        if name:
            own = out.setdefault(name, [])
            own += [a for a in dict.fromkeys(x.strip().lower() for x in [*(r[1] or []), name] if x and x.strip()) if a not in own]
    if not out:
        raise ValueError("no target drugs")
    return dict(sorted(out.items()))


def _alternation(names: list[str]) -> str:
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", n) for n in sorted(names, key=lambda n: (-len(n), n)))


def name_pattern(names: list[str]) -> str:
    return rf"(?iu)(?<![a-z0-9])(?:{_alternation(names)})(?![a-z0-9])"


def exact_matches(texts: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """``doc_id`` and MATCH columns: the leftmost hit of each drug."""
    hits = []
    for drug, own in names.items():
        got = F.regexp_extract("text", name_pattern(own), 0)
        hits.append(F.struct(F.lit(drug).alias("canonical_drug"), got.alias("matched_text")))
    flat = texts.where("text is not null").select("doc_id", F.explode(F.array(*hits)).alias("m")).where("m.matched_text <> ''")
    return flat.select("doc_id", "m.canonical_drug", "m.matched_text", F.lower("m.matched_text").alias("matched_alias"), F.lit("exact").alias("match_type"), F.lit(0).alias("edit_distance"), F.lit(1.0).alias("similarity"))


def tokens(text: Column) -> Column:
    """Distinct lower-case letter tokens of at least seven letters."""
    found = F.regexp_extract_all(text, F.lit("(?iu)[a-z]{%d,}" % FUZZY_MIN_LENGTH), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def token_candidates(words: DataFrame, names: dict[str, list[str]], least: float = FUZZY_SIMILARITY) -> DataFrame:
    """``token, canonical_drug, matched_alias, edit_distance, similarity`` for
    each distinct ``token`` near a name; tokens that are names have none."""
    eligible = [(d, a) for d, own in names.items() for a in own if len(a) >= FUZZY_MIN_LENGTH and a.isalpha()]
    known = sorted({a for own in names.values() for a in own})
    if not eligible:
        none = [F.lit(None).cast(k).alias(c) for c, k in (("canonical_drug", "string"), ("matched_alias", "string"), ("edit_distance", "int"), ("similarity", "double"))]
        return words.where("false").select("token", *none)
    pairs = F.array(*[F.struct(F.lit(d).alias("canonical_drug"), F.lit(a).alias("alias")) for d, a in eligible])
    w = words.where(~F.col("token").isin(known)).select("token", F.explode(pairs).alias("p")).select("token", "p.canonical_drug", F.col("p.alias").alias("matched_alias"))
    d = w.withColumn("edit_distance", close_distance(F.col("token"), F.col("matched_alias"), least)).where("edit_distance is not null")
    s = similarity(F.col("edit_distance"), F.col("token"), F.col("matched_alias"))
    return d.withColumn("raw", s).where(F.col("raw") + 1e-12 >= least).select("token", "canonical_drug", "matched_alias", "edit_distance", half_even(F.col("raw"), 4).alias("similarity"))


def find_matches(texts: DataFrame, names: dict[str, list[str]], least: float = FUZZY_SIMILARITY) -> DataFrame:
    """``doc_id`` and MATCH columns, one row per text and drug.

    ``texts``: doc_id (any type; repeated rows of one doc_id have one text),
    text. Null texts have no match. Of
    several fuzzy tokens for one drug the most similar wins, then the fewer
    edits, then the smaller token.
    """
    exact = exact_matches(texts, names).dropDuplicates(["doc_id", "canonical_drug"])
    per_doc = texts.where("text is not null").select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    cand = token_candidates(per_doc.select("token").distinct(), names, least)
    found = per_doc.join(cand, "token").join(exact.select("doc_id", "canonical_drug"), ["doc_id", "canonical_drug"], "left_anti")
    per_token = found.groupBy("doc_id", "token", "canonical_drug").agg(F.min(F.struct((-F.col("similarity")).alias("neg"), "edit_distance", "matched_alias")).alias("best"))
    # Drugs are few, so each token's group is too.
    ranked = per_token.groupBy("doc_id", "token").agg(F.min("best.neg").alias("top"), F.collect_list(F.struct("canonical_drug", "best")).alias("all"))
    only = ranked.withColumn("near", F.filter("all", lambda x: x["best"]["neg"] == F.col("top"))).where(F.size("near") == 1).select("doc_id", "token", F.col("near")[0].alias("n"))
    per_drug = only.groupBy("doc_id", F.col("n.canonical_drug").alias("canonical_drug")).agg(F.min(F.struct("n.best.neg", "n.best.edit_distance", "token", "n.best.matched_alias")).alias("b"))
    fuzzy = per_drug.select("doc_id", "canonical_drug", F.col("b.token").alias("matched_text"), "b.matched_alias", F.lit("fuzzy").alias("match_type"), "b.edit_distance", (-F.col("b.neg")).alias("similarity"))
    return exact.unionByName(fuzzy)


def class_term_hit(text: Column) -> Column:
    return F.coalesce(text.rlike(name_pattern(CLASS_TERMS)), F.lit(False))


def recalled(texts: DataFrame, names: dict[str, list[str]], include_class_only: bool = False) -> DataFrame:
    """``texts`` that match, with ``matched_target_drugs`` (sorted),
    ``drug_match_details`` and ``class_only``."""
    per_doc = find_matches(texts, names).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("canonical_drug", "matched_text", "matched_alias", "match_type", "edit_distance", "similarity"))).alias("drug_match_details")
    )
    # The class test runs before the join, so the text itself need not be shuffled.
    out = texts.withColumn("_class", class_term_hit(F.col("text"))).join(per_doc, "doc_id", "left")
    empty = F.array().cast(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in MATCH.split(', '))}>>")
    details = F.coalesce("drug_match_details", empty)
    out = out.withColumn("drug_match_details", details).withColumn("matched_target_drugs", F.transform("drug_match_details", lambda x: x["canonical_drug"]))
    out = out.withColumn("class_only", (F.size("matched_target_drugs") == 0) & F.col("_class")).drop("_class")
    return out.where((F.size("matched_target_drugs") > 0) | (F.lit(include_class_only) & F.col("class_only")))


def recalled_once(copies: DataFrame, names: dict[str, list[str]], include_class_only: bool = False) -> DataFrame:
    """Each record once: the first delivered copy among those that match.

    ``copies``: doc_id (a copy's own), id (its record), retrieved_on, text and
    more. A record whose first copy has no match but whose second has is
    recalled with the second. Copies of equal time are ordered by their columns.
    """
    got = recalled(copies, names, include_class_only).drop("doc_id")
    got = Scratch(copies.sparkSession, "recalled").put(got)
    return keep_one_delivery(got, "id", "retrieved_on")


def matches_once(copies: DataFrame, matches: DataFrame) -> DataFrame:
    """``matches`` (doc_id and MATCH columns) of each record's first matching
    copy, with the record's ``id``."""
    m = matches.dropDuplicates(["doc_id", "canonical_drug"])
    own = copies.join(m.select("doc_id").distinct(), "doc_id", "left_semi")
    first = keep_one_delivery(own.select("id", "retrieved_on", *[c for c in copies.columns if c not in ("id", "doc_id", "retrieved_on")], "doc_id"), "id", "retrieved_on")
    return m.join(first.select("doc_id", "id"), "doc_id")


def scan_stats(copies: DataFrame, recalled_df: DataFrame) -> DataFrame:
    """One row: ``n_rows`` read, ``n_records`` in scope, ``n_recalled``."""
    a = copies.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_records"))
    b = recalled_df.agg(F.count(F.lit(1)).alias("n_recalled"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def mention_set(drugs: Column) -> Column:
    return F.when(F.size(drugs) == 0, F.lit("class_only")).otherwise(F.array_join(F.array_sort(drugs), " + "))


def match_flags(recalled_df: DataFrame) -> DataFrame:
    """One row: records, with an exact, a fuzzy, and only fuzzy matches,
    class-only ones, and ones with several drugs."""
    kinds = F.transform("drug_match_details", lambda x: x["match_type"])
    exact, fuzzy = F.array_contains(kinds, "exact"), F.array_contains(kinds, "fuzzy")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return recalled_df.agg(
        F.count(F.lit(1)).alias("n_records"), n(exact).alias("n_exact"), n(fuzzy).alias("n_fuzzy"), n(fuzzy & ~exact).alias("n_only_fuzzy"),
        n(F.col("class_only")).alias("n_class_only"), n(F.size("matched_target_drugs") > 1).alias("n_multi_drug"),
    )


def by_drug(recalled_df: DataFrame) -> DataFrame:
    return recalled_df.select(F.explode("matched_target_drugs").alias("canonical_drug")).groupBy("canonical_drug").agg(F.count(F.lit(1)).alias("n_records"))


def by_mention_set(recalled_df: DataFrame) -> DataFrame:
    return recalled_df.groupBy(mention_set(F.col("matched_target_drugs")).alias("mention_set")).agg(F.count(F.lit(1)).alias("n_records"))


def matched_terms(recalled_df: DataFrame) -> DataFrame:
    """Histogram of match details, most frequent first."""
    cols = [c.split()[0] for c in MATCH.split(", ")]
    flat = recalled_df.select(F.explode("drug_match_details").alias("m")).select(*[F.col(f"m.{c}") for c in cols])
    return flat.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_records")).orderBy(F.desc("n_records"), *cols)


def recall_rate(in_scope: DataFrame, recalled_df: DataFrame, by: str) -> DataFrame:
    """``by, n_in_scope, n_recalled, percent_recalled`` (4 digits, 0 if empty)."""
    a = in_scope.groupBy(by).agg(F.count_distinct("doc_id").alias("n_in_scope"))
    b = recalled_df.groupBy(by).agg(F.count_distinct("doc_id").alias("n_recalled"))
    n = F.coalesce("n_recalled", F.lit(0)).cast("long")
    return a.join(b, by, "left").select(by, "n_in_scope", n.alias("n_recalled"), F.when(F.col("n_in_scope") == 0, 0.0).otherwise(half_even(100 * n / F.col("n_in_scope"), 4)).alias("percent_recalled"))
