"""Sequence work: k-mer containment, homology tables, orthologs and sequence signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ortholog_call
from ..params import DEFAULTS, HYDROPHOBIC_RESIDUES, SMALL_RESIDUES, ScreenParams
from ..session import cut_lineage, spread_small_scan
from .ledger import n
from .ordering import keep_first
from .skew import ROWS_PER_SLICE, sliced_join


def kmer_array(sequence: Column, k: int) -> Column:
    """Different k-mers of a text. The look-ahead walks the text once, unlike repeated substring
    calls, which rescan it from its start."""
    return F.array_distinct(F.regexp_extract_all(sequence, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def kmer_containment(query: DataFrame, subject: DataFrame, k: int = 5, min_containment: float = 0.3,
                     rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Best subject of each query by the share of the query's k-mers it holds.

    Inputs have (id, sequence). A subject that holds ``need = ceil(c * n)`` of a query's n k-mers
    must hold at least ``need / 2`` of its ``n - need / 2`` rarest ones. Only those are joined on,
    so the most common k-mers never are, and only subjects that reach that count are looked at in
    full. Ties go to the smallest subject id. This is containment, not alignment identity.
    """
    spelled = cut_lineage(
        spread_small_scan(query).select(F.col("id").alias("query_id"), kmer_array(F.col("sequence"), k).alias("texts"))
        .where(F.size("texts") > 0), "query-kmers")
    spelled = spelled.select("query_id", F.size("texts").alias("n_kmers"), F.explode("texts").alias("text"))
    # a number for each wanted k-mer, fixed as a table; it is broadcast if small and shuffled if not
    wanted = cut_lineage(spelled.select("text").distinct().withColumn("kmer", F.monotonically_increasing_id()), "wanted-kmers")
    q_rows = cut_lineage(spelled.join(wanted, "text").select("query_id", "n_kmers", "kmer"), "query-numbers")
    q = q_rows.groupBy("query_id").agg(F.collect_list("kmer").alias("q_kmers"))  # one sequence's k-mers
    s_rows = spread_small_scan(subject).select(
        F.col("id").alias("subject_id"), F.explode(kmer_array(F.col("sequence"), k)).alias("text"))
    held = s_rows.join(wanted, "text").groupBy("subject_id").agg(
        F.array_sort(F.collect_list("kmer")).alias("s_kmers"))  # at most one sequence's k-mers
    # subjects that share the same k-mers with the queries, copies above all, are compared once
    held = cut_lineage(held.groupBy("s_kmers").agg(F.min("subject_id").alias("subject_id")), "subject-kmers")
    shared_rows = held.select("subject_id", F.explode("s_kmers").alias("kmer"))

    spread = shared_rows.groupBy("kmer").agg(F.count("*").alias("n_subjects"))
    rare_first = Window.partitionBy("query_id").orderBy(F.coalesce("n_subjects", F.lit(0)), "kmer")
    need = F.ceil(F.col("n_kmers") * min_containment - 1e-9)
    half = F.greatest(F.lit(1), F.ceil(need / 2))
    probes = cut_lineage(
        q_rows.withColumn("at_least", half).join(spread, "kmer", "left")
        .withColumn("_place", F.row_number().over(rare_first))
        .where((F.col("_place") <= F.col("n_kmers") - need + half) & F.col("n_subjects").isNotNull())
        .select("kmer", "query_id", "at_least"), "probes")
    candidates = (
        sliced_join(probes, shared_rows, ["kmer"], rows_per_slice=rows_per_slice)
        .groupBy("query_id", "subject_id").agg(F.count("*").alias("_n"), F.first("at_least").alias("_least"))
        .where(F.col("_n") >= F.col("_least")).select("query_id", "subject_id")
    )
    counted = candidates.join(q, "query_id").join(held, "subject_id").select(
        "query_id", "subject_id", F.size("q_kmers").alias("n_kmers"),
        F.size(F.array_intersect("q_kmers", "s_kmers")).alias("n_shared"))
    enough = counted.where(F.col("n_shared") >= F.col("n_kmers") * min_containment - 1e-9)
    best = enough.groupBy("query_id").agg(
        F.min(F.struct((-F.col("n_shared")).alias("s"), "subject_id", "n_kmers")).alias("_b"))
    return best.select(
        "query_id", F.col("_b.subject_id").alias("subject_id"), (-F.col("_b.s")).cast("bigint").alias("n_shared"),
        F.col("_b.n_kmers").cast("bigint").alias("n_kmers"),
    ).withColumn("kmer_containment", F.col("n_shared") / F.col("n_kmers"))


def best_hits(table: DataFrame, max_evalue: float | None = None) -> DataFrame:
    """Best row per (query, species) of a precomputed alignment table."""
    rows = table if max_evalue is None else table.where(F.col("evalue") <= max_evalue)
    return keep_first(rows, ["accession", "species"],
                      [(-F.col("bitscore")).alias("b"), F.col("evalue"), F.col("subject_id")])


def ortholog_calls(targets: DataFrame, hits: DataFrame, species: Sequence[str],
                   p: ScreenParams = DEFAULTS) -> DataFrame:
    """A call for every target in every species, "No hit" where the search found nothing."""
    wanted = targets.select("accession").withColumn("species", F.explode(F.array(*[F.lit(s) for s in species])))
    return wanted.join(
        hits.select("accession", "species", "identity_pct", "coverage_pct"), ["accession", "species"], "left"
    ).withColumn("ortholog_call", ortholog_call(F.col("identity_pct"), F.col("coverage_pct"), p))


def ortholog_summary(calls: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Strong orthologs, broad-conservation flag and species coverage of each target."""
    strong = (F.col("identity_pct") >= p.ortholog_identity) & (F.col("coverage_pct") >= p.ortholog_coverage)
    return calls.groupBy("accession").agg(
        n(strong).alias("n_strong_orthologs"), n(F.col("identity_pct") >= p.putative_identity).alias("species_coverage"),
    ).withColumn("pan_tick", F.col("n_strong_orthologs") >= p.ortholog_min_species)


def ortholog_table(calls: DataFrame, species: Sequence[str]) -> DataFrame:
    """Identity, coverage and call of each species side by side."""
    return calls.groupBy("accession").pivot("species", list(species)).agg(
        F.first("identity_pct").alias("identity"), F.first("coverage_pct").alias("coverage"),
        F.first("ortholog_call").alias("call"))


def ortholog_totals(summary: DataFrame) -> DataFrame:
    pan, some = F.col("pan_tick"), F.col("species_coverage") >= 1
    return summary.agg(
        F.count("*").alias("n_targets"), n(pan).alias("n_pan"), n(~pan & some).alias("n_species_specific"),
        n(~pan & ~some).alias("n_none"))


def gpi_signal(sequence: Column, min_hydrophobic: int = 8) -> Column:
    """Anchor signal at the end of a sequence: a hydrophobic tail behind a small residue.

    Letters are raised one by one: ``upper`` makes some, such as the sharp s, longer, and would move the window. The two
    others that become residue letters are the dotless i and the long s.
    """
    tail = F.translate(F.right(sequence, F.lit(30)), "abcdefghijklmnopqrstuvwxyz\u0131\u017f", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS")
    hydrophobic = F.regexp_count(F.right(tail, F.lit(15)), F.lit(f"[{HYDROPHOBIC_RESIDUES}]"))
    site = F.substring(tail, 14, 7).rlike(f"[{SMALL_RESIDUES}]")
    return (F.length(sequence) >= 30) & (hydrophobic >= min_hydrophobic) & site


def sequence_union(sources: Sequence[DataFrame]) -> DataFrame:
    """One sequence per accession, from the first source that has a non-empty one."""
    tagged = [
        s.where(F.coalesce(F.col("sequence"), F.lit("")) != "").select("accession", "sequence", F.lit(i).alias("source_no"))
        for i, s in enumerate(sources)
    ]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t)
    return keep_first(merged, ["accession"], ["source_no", "sequence"])


def preferred_entry(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One database entry per key: reviewed first, then the better annotated, then by accession."""
    return keep_first(entries, list(keys), [
        (~F.col("reviewed")).alias("r"), (-F.col("annotation_score")).alias("a"), F.col("accession")])
