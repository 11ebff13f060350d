"""Annotation: filling gaps, evidence from texts, and labels from keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..functions.text import blank_to_null, contains_any, joined, matched_terms
from ..params import (
    DEFAULTS,
    ANCHOR_TERMS, FEEDING_FAMILIES, FUNCTION_CLASS_KEYWORDS, INDUCTION_TERMS,
    LITERATURE_ORGANISMS, LITERATURE_PHENOTYPES)
from ..session import cut_lineage, spread_small_scan
from .ledger import n
from .ordering import top_per_group
from .skew import ROWS_PER_SLICE, sliced_join


def function_class(names: Column) -> Column:
    """Function class from domain names; the first class with a matching keyword wins."""
    text = F.lower(F.array_join(F.coalesce(names, F.array().cast("array<string>")), " "))
    return first_match([(contains_any(text, keys), label) for label, keys in FUNCTION_CLASS_KEYWORDS], "Unknown")


def distinct_by_id(items: Column) -> Column:
    """Array of structs without repeated ids, first one kept, order kept."""
    ids = F.transform(items, lambda d: d["id"])
    return F.filter(items, lambda d, i: F.array_position(ids, d["id"]) == i + 1)


def fill_annotation(targets: DataFrame, found: DataFrame, domains: DataFrame) -> DataFrame:
    """Fill blank text fields from ``found`` and always set domains, terms and function class.

    ``domains`` has (accession, domains, go_terms), arrays of (id, name). Both joins sort and merge: arrays built from
    short columns are far larger than the size Spark takes them for, and would be broadcast.
    """
    fields = ["name", "gene", "function", "subcellular"]
    new = found.select("accession", *[F.col(f).alias(f"_{f}") for f in fields])
    out = targets.join(new.hint("merge"), "accession", "left").join(domains.hint("merge"), "accession", "left")
    empty = F.array().cast("array<struct<id:string,name:string>>")
    filled = [F.coalesce(blank_to_null(F.col(f)), blank_to_null(F.col(f"_{f}")), F.lit("")).alias(f) for f in fields]
    changed = [
        F.when(blank_to_null(F.col(f)).isNull() & blank_to_null(F.col(f"_{f}")).isNotNull(), F.lit(f)) for f in fields]
    keep = [c for c in targets.columns if c not in fields]
    out = out.select(
        *keep, *filled, F.concat_ws(",", *changed).alias("filled_fields"),
        distinct_by_id(F.coalesce("domains", empty)).alias("interpro_domains"),
        distinct_by_id(F.coalesce("go_terms", empty)).alias("interpro_go"))
    return out.withColumn("function_class", function_class(F.transform("interpro_domains", lambda d: d["name"])))


def annotation_report(filled: DataFrame) -> DataFrame:
    """One report row per target: class, first three domain names, first five terms."""
    names = F.transform("interpro_domains", lambda d: d["name"])
    terms = F.transform("interpro_go", lambda d: d["id"])
    return filled.select(
        "accession", F.col("name").alias("new_name"), "gene", "function_class",
        F.size("interpro_domains").alias("domain_count"), F.array_join(F.slice(names, 1, 3), "; ").alias("domain_summary"),
        F.size("interpro_go").alias("go_count"), F.array_join(F.slice(terms, 1, 5), "; ").alias("go_terms"))


def annotation_terms(df: DataFrame, terms: Sequence[str] = ANCHOR_TERMS) -> DataFrame:
    """Records that mention any term anywhere, with the terms found."""
    text = F.lower(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    return df.withColumn("terms", matched_terms(text, terms)).where(F.size("terms") > 0)


def annotation_term_scan(sources: Sequence[tuple[str, DataFrame]], terms: Sequence[str] = ANCHOR_TERMS) -> DataFrame:
    """(accession, source, terms): the first source that mentions a term wins per accession."""
    out = None
    for name, df in sources:
        part = annotation_terms(df, terms).select("accession", F.lit(name).alias("source"), "terms")
        if out is None:
            out = part
        else:
            out = out.unionByName(part.join(out.select("accession"), "accession", "left_anti"))
    return out


def keyword_members(df: DataFrame, keyword: str) -> DataFrame:
    """Records that carry a database keyword."""
    return df.where(F.array_contains("keywords", keyword))


def site_members(sites: DataFrame, kind: str = "site", description: str = "GPI-anchor") -> DataFrame:
    """Accessions with a sequence annotation of a kind whose description mentions a term."""
    fits = (F.lower("type") == kind.lower()) & F.contains(F.lower("description"), F.lit(description.lower()))
    return sites.where(fits).select("accession").distinct()


def keyword_or_site_members(df: DataFrame, keyword: str, sites: DataFrame, kind: str = "site",
                            description: str = "GPI-anchor") -> DataFrame:
    """(accession, name): records with the keyword, and those known only from a site annotation, whose name is empty."""
    named = keyword_members(df, keyword).select("accession", F.coalesce("name", F.lit("")).alias("name"))
    more = site_members(sites, kind, description).join(named.select("accession"), "accession", "left_anti")
    return named.unionByName(more.withColumn("name", F.lit("")))


def evidence_union(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Each accession once, with the names of the sources that support it."""
    merged = None
    for name, df in sources:
        part = df.select("accession", F.lit(name).alias("source"))
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy("accession").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def evidence_counts(union: DataFrame, names: Sequence[str], proteome_size: int | Column) -> DataFrame:
    """Accessions per source and in total, next to the 1-3 % expected of a proteome."""
    size = F.lit(proteome_size) if isinstance(proteome_size, int) else proteome_size
    return union.agg(
        *[n(F.array_contains("sources", s)).alias(f"n_{s}") for s in names], F.count("*").alias("n_union"),
    ).withColumn("estimate_low", F.floor(size * 0.01)).withColumn("estimate_high", F.floor(size * 0.03))


def feeding_relevance(targets: DataFrame, overrides: DataFrame, families: Sequence[str] = FEEDING_FAMILIES,
                      induction_terms: Sequence[str] = INDUCTION_TERMS) -> DataFrame:
    """Expression relevance: curated override, family keyword, RNAi evidence, else none; an
    induction text that mentions the process outranks them all.

    ``overrides`` is the curated (accession, override_note) table.
    """
    text = F.lower(joined(F.col("name"), F.col("gene"), F.col("annotation")))
    found = matched_terms(text, families)
    induced = contains_any(F.lower(F.coalesce(F.col("induction"), F.lit(""))), induction_terms)
    curated, family, rnai = F.col("override_note").isNotNull(), F.size("_families") > 0, F.col("rnai_evidence")
    out = targets.join(overrides, "accession", "left").withColumn("_families", found)
    return out.withColumn("feeding_relevant", first_match(
        [(induced | curated | family, "true"), (rnai, "Likely")], "false"),
    ).withColumn("evidence_source", first_match([
        (induced, "UniProt induction text"), (curated, "Literature"), (family, "Keyword match"), (rnai, "RNAi lethal"),
    ], "No data")).withColumn("note", F.left(first_match([
        (induced, F.col("induction")),
        (curated, F.col("override_note")),
        (family, F.concat(F.lit("Matches gene families: "), F.array_join(F.slice("_families", 1, 3), ", "))),
        (rnai, "RNAi knockdown is lethal"),
    ], "No evidence found"), F.lit(150))).drop("_families", "override_note")


def expression_summary(rows: DataFrame) -> DataFrame:
    """Relevant targets among all."""
    relevant = F.col("feeding_relevant").isin("true", "Likely")
    return rows.agg(F.count("*").alias("n_targets"), n(relevant).alias("n_relevant"))


def relevant_accessions(rows: DataFrame) -> DataFrame:
    """The relevant accessions, as rows."""
    return rows.where(F.col("feeding_relevant").isin("true", "Likely")).select("accession", "evidence_source")


# --- literature -------------------------------------------------------------------------

NOT_WORD = r"[^\p{L}\p{N}]+"


def plain_words(text: Column) -> Column:
    """Lower-cased words with single spaces between and around."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), F.lit(" "))


def word_form(term: str) -> str:
    """How a term is found among plain words; a trailing star asks for the beginning of a word."""
    return f" {term[:-1].lower()}" if term.endswith("*") else f" {term.lower()} "


def literature_terms(targets: DataFrame, name_chars: int | None = DEFAULTS.literature_name_chars) -> DataFrame:
    """(target, term): the gene, and a name longer than three characters.

    A name of more than ``name_chars`` ends with its last whole word within them, since a part of a word
    would only be found by accident; None asks for the whole name.
    """
    name = F.col("name")
    if name_chars is not None:
        whole = F.regexp_extract(F.left(name, F.lit(name_chars + 1)), r"(?s)^(.*[^\p{L}\p{N}])", 1)
        name = F.when(F.length(name) <= name_chars, name).when(F.trim(whole) != "", whole).otherwise(F.left(name, F.lit(name_chars)))
    name = F.when(F.length("name") > 3, name)
    term = F.explode(F.array_compact(F.array(blank_to_null(F.col("gene")), name)))
    rows = targets.select("target", term.alias("_t")).select("target", F.trim(plain_words(F.col("_t"))).alias("term"))
    return rows.where(F.col("term") != "").distinct()


def literature_matches(targets: DataFrame, abstracts: DataFrame,
                       organisms: Sequence[str] = LITERATURE_ORGANISMS,
                       phenotypes: Sequence[str] = LITERATURE_PHENOTYPES,
                       name_chars: int | None = DEFAULTS.literature_name_chars,
                       rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(target, pmid) of abstracts that name the target, an organism and a phenotype.

    Both fixed word groups are checked while scanning. Then only (abstract, word) rows are joined
    to the rarest word of each term; the text is looked at again only for terms of several words.
    """
    def fits(words: Column) -> Column:
        organism, phenotype = (contains_any(words, [word_form(t) for t in group]) for group in (organisms, phenotypes))
        return organism & phenotype

    # filtering a one-element array cleans each text once, where a filter on the column would repeat it
    clean = F.explode(F.filter(F.array(plain_words(F.col("text"))), fits))
    relevant = cut_lineage(spread_small_scan(abstracts).select("pmid", clean.alias("words")), "abstracts")
    parts = cut_lineage(literature_terms(targets, name_chars).select("target", "term", F.explode(F.split("term", " ")).alias("token")), "terms")
    named = relevant.select("pmid", F.explode(F.array_distinct(F.split(F.trim("words"), " "))).alias("token"))
    tokens = cut_lineage(named.join(parts.select("token").distinct(), "token", "left_semi"), "tokens")
    spread = parts.join(tokens.groupBy("token").agg(F.count("*").alias("_n")), "token", "left").withColumn(
        "_n", F.coalesce("_n", F.lit(0)))
    terms = cut_lineage(
        spread.groupBy("target", "term").agg(F.min(F.struct("_n", "token")).alias("_m"))
        .where(F.col("_m._n") > 0).select("target", "term", F.col("_m.token").alias("token")), "rare-words")
    met = sliced_join(tokens, terms, ["token"], rows_per_slice=rows_per_slice)
    single = met.where(F.col("term") == F.col("token")).select("target", "pmid")
    phrases = met.where(F.col("term") != F.col("token")).join(relevant, "pmid").where(
        F.contains(F.col("words"), F.concat(F.lit(" "), F.col("term"), F.lit(" ")))).select("target", "pmid")
    return single.unionByName(phrases).distinct()


def literature_evidence(targets: DataFrame, matches: DataFrame, n_ids: int = 5) -> DataFrame:
    """Evidence flag, number of abstracts and the first ids of every target."""
    matches = cut_lineage(matches, "matches")
    counts = matches.groupBy("target").agg(F.count("*").alias("rnai_count"))
    first = top_per_group(matches, ["target"], [F.col("pmid")], n_ids).groupBy("target").agg(
        F.array_sort(F.collect_list("pmid")).alias("pmids"))
    out = targets.select("target").distinct().join(counts, "target", "left").join(first, "target", "left")
    return out.select(
        "target", (F.coalesce("rnai_count", F.lit(0)) > 0).alias("rnai_evidence"),
        F.coalesce("rnai_count", F.lit(0)).alias("rnai_count"), "pmids")
