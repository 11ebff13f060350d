"""Compound library and ADMET queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chem
from ..operators import hits as H
from ..operators import library as B
from .registry import query

BASE = "mw BETWEEN 150 AND 500 AND logp <= 5 AND hbd <= 5 AND hba <= 10 AND num_ro5_violations <= 1 AND smiles <> ''"
MODES = {
    "druglike": "TRUE", "approved": "max_phase = 4", "antiparasitic": "max_phase = 4 AND atc_level1 = 'P'",
    "clinical": "max_phase >= 3", "natural": "natural_product = 1",
    "antiprotozoal": "max_phase = 4 AND atc_level2 = 'P01'", "anthelmintic": "max_phase = 4 AND atc_level2 = 'P02'",
    "ectoparasiticide": "max_phase = 4 AND atc_level1 = 'P'",  # no P03 compounds: the coarse class steps in
}


def _register_mode(mode, predicate):
    @query(f"select_library_{mode}", f"SELECT ligand, max_phase, atc_level1, natural_product FROM compounds WHERE {BASE} AND {predicate}")
    def select_library(t):
        return B.select_library(t.compounds, mode).select("ligand", "max_phase", "atc_level1", "natural_product")


for _mode, _predicate in MODES.items():
    _register_mode(_mode, _predicate)


@query("select_library_page", f"SELECT ligand FROM compounds WHERE {BASE} AND max_phase >= 3 ORDER BY ligand LIMIT 40 OFFSET 25")
def select_library_page(t):
    return B.select_library(t.compounds, "clinical", offset=25, limit=40).select("ligand")


@query("first_source", f"SELECT ligand, smiles FROM compounds WHERE {BASE} AND atc_level2 = 'P02'")
def first_source(t):
    sources = [t.compounds.where("atc_level2 = 'P03'"), t.compounds.where(B.base_predicate() & (F.col("atc_level2") == "P02")),
               t.compounds]
    return B.first_source([s.select("ligand", "smiles") for s in sources])


STAGE = """CASE WHEN smiles = '' THEN 'no_structure' WHEN NOT (mw <= 500 AND hbd <= 5 AND hba <= 10 AND logp <= 5 AND rotbonds <= 10) THEN 'lipinski'
    WHEN pains THEN 'pains' WHEN qed < 0.25 THEN 'qed' WHEN ligand IN (SELECT ligand FROM top_pairs WHERE score <= -12.25) THEN 'already_prepared'
    ELSE 'passed' END"""


def _staged(t):
    return B.library_funnel(t.compounds, t.facts.where("score <= -12.25").select("ligand"))


@query("library_funnel", f"SELECT {STAGE} AS fail_stage, count(*) AS n_compounds FROM compounds GROUP BY 1")
def library_funnel(t):
    return B.funnel_counts(_staged(t))


@query("library_work", f"""s AS (SELECT ligand, {STAGE} AS fail_stage FROM compounds),
    p AS (SELECT *, row_number() OVER (ORDER BY ligand) AS place FROM s WHERE fail_stage IN ('passed', 'already_prepared'))
    SELECT ligand FROM p WHERE place <= 150 AND fail_stage = 'passed'""")
def library_work(t):
    return B.funnel_work(_staged(t), 150).select("ligand")


@query("lipinski_strict", """SELECT ligand, mw <= 500 AND hbd <= 5 AND hba <= 10 AND logp <= 5 AND rotbonds <= 10 AS passes FROM compounds""")
def lipinski_strict(t):
    c = F.col
    return t.compounds.select("ligand", chem.lipinski_strict(c("mw"), c("hbd"), c("hba"), c("logp"), c("rotbonds")).alias("passes"))


VIOLATIONS = "CAST((mw > 500)::INT + (logp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT AS INT)"


@query("lipinski_lenient", f"SELECT ligand, {VIOLATIONS} AS ro5_violations, CASE WHEN {VIOLATIONS} <= 1 THEN 'Pass' ELSE 'Fail' END AS lipinski FROM compounds")
def lipinski_lenient(t):
    return B.admet(t.compounds).select("ligand", "ro5_violations", "lipinski")


@query("veber_egan", """SELECT ligand, CASE WHEN tpsa <= 140 AND rotbonds <= 10 THEN 'Pass' ELSE 'Fail' END AS veber,
    CASE WHEN logp <= 5.88 AND tpsa <= 131.6 THEN 'Pass' ELSE 'Fail' END AS egan FROM compounds""")
def veber_egan(t):
    return B.admet(t.compounds).select("ligand", "veber", "egan")





@query("esol", """SELECT ligand, round(CAST(0.16 AS DOUBLE) - CAST(0.63 AS DOUBLE) * logp - CAST(0.0062 AS DOUBLE) * mw + CAST(0.066 AS DOUBLE) * rotbonds
    - CAST(0.74 AS DOUBLE) * coalesce(aromatic_atoms / nullif(heavy_atoms, 0), 0), 2) AS logs_esol FROM compounds""")
def esol(t):
    return B.admet(t.compounds).select("ligand", "logs_esol")


HERG = """CASE WHEN basic_n >= 1 AND aromatic_rings >= 2 AND mw > 300 AND logp > 2 THEN 'Flag'
    WHEN basic_n >= 1 AND aromatic_rings >= 1 THEN 'Possible' ELSE 'Low risk' END"""
AMES = "CASE WHEN nitro THEN 'Flag' WHEN sec_amine THEN 'Possible' ELSE 'Low risk' END"
HEPATOTOX = "CASE WHEN epoxide THEN 'Flag' ELSE 'Low risk' END"


@query("toxicity_flags", f"""SELECT ligand, {HERG} AS herg_flag, {AMES} AS ames_flag,
    CASE WHEN nitro THEN 'ArNitro' WHEN sec_amine THEN 'SecAmine' ELSE '' END AS ames_names, {HEPATOTOX} AS hepatotox_flag,
    CASE WHEN epoxide THEN 'Epoxide/thirane' ELSE '' END AS hepatotox_names FROM compounds""")
def toxicity_flags(t):
    return B.admet(t.compounds).select("ligand", "herg_flag", "ames_flag", "ames_names", "hepatotox_flag", "hepatotox_names")


OVERALL = f"""f AS (SELECT ligand, concat_ws(',', CASE WHEN {HERG} = 'Flag' THEN 'hERG' END, CASE WHEN {AMES} = 'Flag' THEN 'AMES' END,
        CASE WHEN epoxide THEN 'Hepatotox' END) AS flags,
        concat_ws(',', CASE WHEN {HERG} = 'Possible' THEN 'hERG?' END, CASE WHEN {AMES} = 'Possible' THEN 'AMES?' END,
        CASE WHEN pains THEN 'PAINS' END, CASE WHEN brenk THEN 'Brenk' END) AS warns FROM compounds),
    o AS (SELECT ligand, CASE WHEN flags <> '' THEN 'FLAG(' || flags || ')' WHEN warns <> '' THEN 'WARN(' || warns || ')' ELSE 'CLEAN' END AS admet_flag FROM f)"""


@query("overall_flag", OVERALL + " SELECT ligand, admet_flag FROM o")
def overall_flag(t):
    return B.admet(t.compounds).select("ligand", "admet_flag")


@query("admet_counts", OVERALL + """ SELECT count(*) AS n_compounds, count(*) FILTER (WHERE admet_flag = 'CLEAN') AS n_clean,
    count(*) FILTER (WHERE contains(admet_flag, 'hERG')) AS n_herg, count(*) FILTER (WHERE contains(admet_flag, 'AMES')) AS n_ames,
    count(*) FILTER (WHERE contains(admet_flag, 'Hepatotox')) AS n_hepatotox, count(*) FILTER (WHERE contains(admet_flag, 'PAINS')) AS n_pains FROM o""")
def admet_counts(t):
    return B.admet_counts(B.admet(t.compounds))


LABELS = ("gear", "ring", "bolt", "rod")


@query("scaffold_classes", """b AS (SELECT ligand, target, score, row_number() OVER (PARTITION BY ligand ORDER BY score, target) AS rn FROM top_pairs)
    SELECT b.ligand, b.target, b.score, CASE split_part(p_name, ' ', 2) WHEN 'gear' THEN 'gear' WHEN 'ring' THEN 'ring' WHEN 'bolt' THEN 'bolt'
    WHEN 'rod' THEN 'rod' ELSE 'Other' END AS scaffold_class FROM b JOIN compounds c ON c.ligand = b.ligand WHERE rn = 1""")
def scaffold_classes(t):
    hits = H.top_hits(t.facts).join(t.compounds.select("ligand", "flags"), "ligand").select("ligand", "target", "score", "flags")
    return B.scaffold_classes(hits, "flags", LABELS).drop("flags")


@query("scaffold_class_counts", """l AS (SELECT DISTINCT ligand FROM top_pairs)
    SELECT CASE split_part(p_name, ' ', 2) WHEN 'gear' THEN 'gear' WHEN 'ring' THEN 'ring' WHEN 'bolt' THEN 'bolt' WHEN 'rod' THEN 'rod'
    ELSE 'Other' END AS scaffold_class, count(*) AS n_ligands FROM l JOIN compounds c ON c.ligand = l.ligand GROUP BY 1""")
def scaffold_class_counts(t):
    return scaffold_classes(t).groupBy("scaffold_class").agg(F.count("*").alias("n_ligands"))


FREQ = "f AS (SELECT murcko_scaffold, count(*) AS n_hits FROM top_pairs h JOIN compounds c ON c.ligand = h.ligand WHERE h.ligand % 4 <> 0 GROUP BY 1)"


def _freq(t):
    scaffold = F.when(F.col("ligand") % 4 != 0, F.col("murcko_scaffold")).otherwise("").alias("murcko_scaffold")
    return B.scaffold_freq(H.top_hits(t.facts).join(t.compounds.select("ligand", scaffold), "ligand"))


@query("scaffold_freq", FREQ + " SELECT murcko_scaffold, n_hits FROM f")
def scaffold_freq(t):
    return _freq(t)


@query("scaffold_summary", FREQ + """ SELECT count(*) AS n_unique, count(*) FILTER (WHERE n_hits = 1) AS n_singletons,
    CAST(sum(n_hits) AS BIGINT) AS n_total, round(count(*) / sum(n_hits), 4) AS diversity FROM f""")
def scaffold_summary(t):
    return B.scaffold_summary(_freq(t))


@query("scaffold_top3", FREQ + " SELECT murcko_scaffold, n_hits FROM f ORDER BY n_hits DESC, murcko_scaffold LIMIT 3")
def scaffold_top3(t):
    return _freq(t).orderBy(F.desc("n_hits"), "murcko_scaffold").limit(3)


@query("valid_files", """SELECT page_id FROM pages WHERE octet_length(encode(html)) >= 2500 AND (contains(html, 'ATOM') OR contains(html, 'HETATM') OR contains(html, 'nav'))""")
def valid_files(t):
    # page sources stand in for prepared files; their "nav" block stands in for atom records
    files = t.read("pages").select("page_id", F.octet_length("html").alias("size"), F.replace("html", F.lit("nav"), F.lit("ATOM")).alias("content"))
    return B.valid_files(files, 2500).select("page_id")
