"""The benchmark tables in the roles of the screening tables.

Each role is defined twice: as a DataFrame for the operators and as SQL for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_BITS = 64

# part words standing in for protein classes
PROTEIN_WORDS = (
    ("gear", "kinase"), ("ring", "receptor"), ("bolt", "protease"), ("rod", "channel"),
    ("plate", "translation factor"), ("anvil", "acetylcholinesterase"), ("gizmo", "cuticle protein"),
)


def protein_words(column: Column) -> Column:
    for old, new in PROTEIN_WORDS:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def protein_words_sql(expression: str) -> str:
    for old, new in PROTEIN_WORDS:
        expression = f"replace({expression}, '{old}', '{new}')"
    return expression


class Tables:
    """The tables of one directory under their screening roles."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def facts(self) -> DataFrame:
        c = F.col
        gap = (c("l_linenumber") == 7) & (c("l_returnflag") == "R")
        return self.read("lineitem").select(
            (F.year("l_shipdate") - 1994).alias("round"), F.month("l_shipdate").alias("batch_id"),
            c("l_suppkey").alias("target"), c("l_partkey").alias("ligand"),
            F.when(~gap, -c("l_quantity") / 4).alias("score"),
            F.when(c("l_linenumber") % 2 == 0, 8).otherwise(4).alias("exh"),
            c("l_linenumber").alias("line"), c("l_extendedprice").cast("bigint").alias("size"))

    @cached_property
    def ledger(self) -> DataFrame:
        """Facts as ledger rows; every first line is from before the effort was recorded."""
        return self.facts.withColumn("exh", F.when(F.col("line") != 1, F.col("exh")))

    @cached_property
    def yearly(self) -> DataFrame:
        """Facts with the year as target: few targets, so that ligands can be promiscuous."""
        return self.facts.withColumn("target", F.col("round"))

    @cached_property
    def targets(self) -> DataFrame:
        s, k = self.read("supplier"), F.col("s_suppkey")
        nation = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("gene"))
        identity = F.when(k % 11 != 0, F.abs("s_acctbal") / 10000)
        return s.join(nation, "s_nationkey").select(
            k.alias("target"), F.col("s_name").alias("name"), "gene", identity.alias("max_identity"),
            F.when(k % 3 != 0, 55 + k % 45).cast("double").alias("mean_plddt"),
            (k % 5).cast("int").alias("druggable_pockets"), F.greatest(F.lit(0), k % 5 - 1).cast("int").alias("allosteric_sites"),
            (k % 7 == 0).alias("rnai_evidence"), F.when(k % 7 == 0, 1 + k % 4).otherwise(0).cast("int").alias("rnai_count"),
            (k % 13).cast("int").alias("novelty_score"), (k % 4 == 0).alias("pan_tick"), F.col("s_acctbal").alias("acctbal"))

    @cached_property
    def proteins(self) -> DataFrame:
        p, k = self.read("part"), F.col("p_partkey")
        text = protein_words(F.col("p_name"))
        return p.select(
            k.alias("accession"), F.col("p_name").alias("label"), text.alias("name"), F.col("p_brand").alias("gene"),
            F.when(k % 4 == 0, "").otherwise(F.concat_ws(" ", F.lower("p_type"), text)).alias("function"),
            F.when(F.col("p_size") % 6 == 0, "Cell membrane").otherwise("").alias("subcellular"),
            F.split(F.concat_ws(",", F.col("p_type"), F.when(k % 9 == 0, "Cell division"), F.when(k % 50 == 0, "GPI-anchor")), ",").alias("keywords"),
            (F.col("p_size") * 32).alias("length"), (k % 3 == 0).alias("has_structure"), (k % 5 == 0).alias("has_ligands"),
            (k % 2 == 0).alias("alphafold_available"))

    @cached_property
    def compounds(self) -> DataFrame:
        p, k, s = self.read("part"), F.col("p_partkey"), F.col("p_size")
        return p.select(
            k.alias("ligand"), F.when(k % 17 == 0, "").otherwise(F.col("p_name")).alias("smiles"),
            ((F.col("p_retailprice") - 800) * 3).alias("mw"), (s / 8).alias("logp"),
            (s % 8).alias("hbd"), (s % 13).alias("hba"), (s * 3.5).alias("tpsa"), (s % 12).alias("rotbonds"),
            (s % 4).alias("aromatic_rings"), (s % 4 * 6).alias("aromatic_atoms"),
            F.when(s == 1, 0).otherwise(10 + s).alias("heavy_atoms"), (s % 3).alias("basic_n"),
            (s / 50).alias("qed"), (k % 13 == 0).alias("pains"), (k % 6 == 0).alias("brenk"),
            F.array_compact(F.array(F.when(s % 5 == 0, "SecAmine"), F.when(s % 7 == 0, "ArNitro"))).alias("ames_alerts"),
            F.array_compact(F.array(F.when(s % 9 == 0, "Epoxide/thirane"))).alias("hepatotox_alerts"),
            (k % 5).cast("int").alias("max_phase"), F.when(k % 10 == 4, "P").otherwise("N").alias("atc_level1"),
            F.when(k % 20 == 4, "P01").when(k % 20 == 14, "P02").alias("atc_level2"),
            (k % 2).cast("int").alias("natural_product"), (s % 3).alias("num_ro5_violations"),
            F.concat_ws(" ", "p_type", "p_brand").alias("murcko_scaffold"),
            F.split("p_name", " ").alias("flags"))

    @cached_property
    def fingerprints(self) -> DataFrame:
        bits = F.array_compact(F.transform("embedding", lambda v, i: F.when(v > 0, i)))
        return self.read("embeddings").select(F.col("vec_id").alias("ligand"), bits.alias("fp_bits"), "label")

    @cached_property
    def atoms(self) -> DataFrame:
        k = F.col("vec_id")
        x, y, z = (F.round(F.col("embedding")[i].cast("double") * 60, 3) for i in range(3))
        element = F.when(k % 4 == 0, "N").when(k % 4 == 1, "O").otherwise("C")
        names = F.when(k % 6 == 0, "PHE").when(k % 6 == 1, "HIS").when(k % 6 == 2, "GLY").otherwise("ALA")
        return self.read("embeddings").select(
            k.alias("atom_id"), (F.col("label") % 3).alias("pose"), F.lit("A").alias("chain"), (k % 60).cast("int").alias("resnum"),
            names.alias("resname"), element.alias("element"), x.alias("x"), y.alias("y"), z.alias("z"),
            (k % 5 == 0).alias("is_ligand"))

    @cached_property
    def known_actives(self) -> DataFrame:
        """Reference compounds scored on targets."""
        n_targets = self.read("supplier").agg(F.count("*")).scalar()
        k = F.col("o_orderkey")
        return self.read("orders").select(
            F.col("o_orderpriority").alias("compound"), (F.col("o_custkey") % n_targets).alias("target"),
            (-(k % 50 + 1).cast("double") / 4).alias("score"))

    @cached_property
    def abstracts(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("pmid"), "text")


# The same roles as SQL.
VIEWS = {
    "facts": """SELECT CAST(year(l_shipdate) - 1994 AS INT) AS round, CAST(month(l_shipdate) AS INT) AS batch_id,
        l_suppkey AS target, l_partkey AS ligand,
        CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL ELSE -l_quantity / 4 END AS score,
        CASE WHEN l_linenumber % 2 = 0 THEN 8 ELSE 4 END AS exh, l_linenumber AS line,
        CAST(trunc(l_extendedprice) AS BIGINT) AS size FROM lineitem""",
    "ledger_rows": "SELECT round, batch_id, target, ligand, score, CASE WHEN line <> 1 THEN exh END AS exh, line FROM facts",
    "yearly": "SELECT round, batch_id, CAST(round AS BIGINT) AS target, ligand, score, exh, line FROM facts",
    "top_pairs": """SELECT target, ligand, min(score) AS score, min(round) AS first_seen_round
        FROM facts WHERE score <= -7 GROUP BY target, ligand""",
    "target_dim": """SELECT s_suppkey AS target, s_name AS name, n_name AS gene,
        CASE WHEN s_suppkey % 11 <> 0 THEN abs(s_acctbal) / 10000 END AS max_identity,
        CAST(CASE WHEN s_suppkey % 3 <> 0 THEN 55 + s_suppkey % 45 END AS DOUBLE) AS mean_plddt,
        CAST(s_suppkey % 5 AS INT) AS druggable_pockets, CAST(greatest(0, s_suppkey % 5 - 1) AS INT) AS allosteric_sites,
        s_suppkey % 7 = 0 AS rnai_evidence,
        CAST(CASE WHEN s_suppkey % 7 = 0 THEN 1 + s_suppkey % 4 ELSE 0 END AS INT) AS rnai_count,
        CAST(s_suppkey % 13 AS INT) AS novelty_score, s_suppkey % 4 = 0 AS pan_tick, s_acctbal AS acctbal
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "proteins": f"""SELECT p_partkey AS accession, p_name AS label, {protein_words_sql('p_name')} AS name, p_brand AS gene,
        CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(p_type) || ' ' || {protein_words_sql('p_name')} END AS function,
        CASE WHEN p_size % 6 = 0 THEN 'Cell membrane' ELSE '' END AS subcellular,
        concat_ws(' ', p_type, CASE WHEN p_partkey % 9 = 0 THEN 'Cell division' END,
            CASE WHEN p_partkey % 50 = 0 THEN 'GPI-anchor' END) AS keyword_text,
        p_size * 32 AS length, p_partkey % 3 = 0 AS has_structure, p_partkey % 5 = 0 AS has_ligands,
        p_partkey % 2 = 0 AS alphafold_available FROM part""",
    "compounds": """SELECT p_partkey AS ligand, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS smiles,
        (p_retailprice - 800) * 3 AS mw, p_size / 8 AS logp, p_size % 8 AS hbd, p_size % 13 AS hba,
        p_size * CAST(3.5 AS DOUBLE) AS tpsa, p_size % 12 AS rotbonds, p_size % 4 AS aromatic_rings,
        p_size % 4 * 6 AS aromatic_atoms, CASE WHEN p_size = 1 THEN 0 ELSE 10 + p_size END AS heavy_atoms,
        p_size % 3 AS basic_n, p_size / 50 AS qed, p_partkey % 13 = 0 AS pains, p_partkey % 6 = 0 AS brenk,
        p_size % 5 = 0 AS sec_amine, p_size % 7 = 0 AS nitro, p_size % 9 = 0 AS epoxide,
        CAST(p_partkey % 5 AS INT) AS max_phase, CASE WHEN p_partkey % 10 = 4 THEN 'P' ELSE 'N' END AS atc_level1,
        CASE WHEN p_partkey % 20 = 4 THEN 'P01' WHEN p_partkey % 20 = 14 THEN 'P02' END AS atc_level2,
        CAST(p_partkey % 2 AS INT) AS natural_product, p_size % 3 AS num_ro5_violations,
        p_type || ' ' || p_brand AS murcko_scaffold, p_name FROM part""",
    "fp_on": """SELECT vec_id AS ligand, i AS bit FROM embeddings, range(64) AS r(i) WHERE embedding[i + 1] > 0""",
    "fp_rows": """SELECT ligand, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS pattern, count(*) AS size
        FROM fp_on GROUP BY ligand""",
    "fp_distinct": """SELECT pattern, min(ligand) AS fp_id, count(*) AS copies, min(size) AS size
        FROM fp_rows GROUP BY pattern""",
    "fp_pairs": """SELECT a.fp_id AS a, b.fp_id AS b, s.n AS n_shared, s.n / (a.size + b.size - s.n) AS similarity,
        a.copies AS a_copies, b.copies AS b_copies
        FROM (SELECT x.ligand AS a, y.ligand AS b, count(*) AS n
              FROM (SELECT * FROM fp_on WHERE ligand IN (SELECT fp_id FROM fp_distinct)) x
              JOIN (SELECT * FROM fp_on WHERE ligand IN (SELECT fp_id FROM fp_distinct)) y
              ON x.bit = y.bit AND x.ligand < y.ligand GROUP BY 1, 2) s
        JOIN fp_distinct a ON a.fp_id = s.a JOIN fp_distinct b ON b.fp_id = s.b""",
    "atoms": """SELECT vec_id AS atom_id, label % 3 AS pose, 'A' AS chain, CAST(vec_id % 60 AS INT) AS resnum,
        CASE vec_id % 6 WHEN 0 THEN 'PHE' WHEN 1 THEN 'HIS' WHEN 2 THEN 'GLY' ELSE 'ALA' END AS resname,
        CASE vec_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'O' ELSE 'C' END AS element,
        round(CAST(embedding[1] AS DOUBLE) * 60, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 60, 3) AS y,
        round(CAST(embedding[3] AS DOUBLE) * 60, 3) AS z, vec_id % 5 = 0 AS is_ligand FROM embeddings""",
    "known_actives": """SELECT o_orderpriority AS compound, o_custkey % (SELECT count(*) FROM supplier) AS target,
        -CAST(o_orderkey % 50 + 1 AS DOUBLE) / 4 AS score FROM orders""",
}
