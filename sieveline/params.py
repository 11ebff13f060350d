"""Every threshold the operators use, as named defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScreenParams:
    # docking score cut points (kcal/mol, lower is better)
    hit_score: float = -7.0
    lead_score: float = -9.0
    exceptional_score: float = -11.0
    moderate_score: float = -5.0
    near_miss_margin: float = 1.5

    # literature: characters of a target's name that are looked for
    literature_name_chars: int = 40

    # ledger
    permanent_exhaustiveness: int = 9999
    legacy_exhaustiveness: int = 4

    # promiscuity
    promiscuous_fraction: float = 0.80

    # structure and pockets
    min_plddt: float = 70.0
    min_plddt_mean: float = 70.0
    min_plddt_fraction: float = 0.5
    min_druggability: float = 0.5
    min_pocket_volume: float = 300.0
    min_box: int = 20
    max_box: int = 30
    box_padding: float = 8.0
    min_exhaustiveness: int = 4
    max_exhaustiveness: int = 8

    # host homology (fractions)
    identity_low: float = 0.20
    identity_medium: float = 0.40
    identity_high: float = 0.80

    # orthologs (percent)
    ortholog_identity: float = 60.0
    putative_identity: float = 40.0
    ortholog_coverage: float = 70.0
    ortholog_min_species: int = 1

    # proteins
    min_length: int = 150
    max_length: int = 1500

    # drug-likeness
    max_mw: float = 500.0
    min_mw: float = 150.0
    max_hbd: int = 5
    max_hba: int = 10
    max_logp: float = 5.0
    max_rotbonds: int = 10
    min_qed: float = 0.25
    max_ro5_violations: int = 1

    # selectivity ratio cut points
    selective_ratio: float = 0.60
    moderate_ratio: float = 0.80
    risky_ratio: float = 1.0

    # contacts (angstrom)
    contact_distance: float = 4.0
    hbond_distance: float = 3.5
    hydrophobic_distance: float = 4.5
    pi_distance: float = 5.5

    # similarity, refinement, rank recovery
    cluster_similarity: float = 0.4
    refinement_band: float = 0.05
    recovery_percentile: float = 60.0
    recovery_pass: int = 3
    recovery_marginal: int = 1


DEFAULTS = ScreenParams()

# ---------------------------------------------------------------------------
# These lists must equal the published screening definitions for
# the results to be the same.
# ---------------------------------------------------------------------------

KNOWN_TARGET_KEYWORDS = (
    "AChE", "AChE2", "acetylcholinesterase", "VGSC", "sodium channel", "GABA", "Bm86",
)

# address of a predicted structure, before its accession
STRUCTURE_PAGE = "https://alphafold.ebi.ac.uk/entry/"

STATIC_EXCLUSIONS = (
    "CHEMBL10", "CHEMBL11", "CHEMBL12", "CHEMBL112998", "CHEMBL9937", "CHEMBL429188",
)

DRUGGABLE_CLASSES = (
    "receptor", "kinase", "protease", "channel", "transporter", "isomerase",
    "reductase", "synthase", "oxidase", "ligase", "phosphatase", "transferase",
)

ESSENTIAL_PROCESSES = (
    "cell division", "dna replication", "translation", "transcription",
    "atp synthesis", "membrane integrity",
)

MEMBRANE_TERMS = ("membrane", "transmembrane", "receptor")

PRIORITY_CLASSES = (
    "receptor", "kinase", "channel", "isomerase", "transporter", "protease",
)

FUNCTION_CLASS_KEYWORDS = (
    ("Enzyme - Kinase/Phosphatase", ("kinase", "phosphatase", "atpase", "gtpase")),
    ("Enzyme - Protease", ("protease", "peptidase", "hydrolase")),
    ("Enzyme - Transferase", ("transferase", "methyltransfer", "acetyltransfer")),
    ("Enzyme - Oxidoreductase", ("reductase", "oxidase", "dehydrogenase", "oxidoreductase")),
    ("Receptor", ("receptor", "gpcr", "nuclear receptor")),
    ("Transporter/Channel", ("transport", "transporter", "channel", "pump")),
    ("Transcription Factor", ("dna bind", "zinc finger", "homeodomain", "transcription")),
    ("Translation/Ribosome", ("ribosom", "translation", "rna bind")),
    ("Structural", ("structural", "cytoskeleton", "collagen")),
    ("Chaperone", ("chaperone", "heat shock", "hsp")),
)

ANCHOR_TERMS = (
    "gpi", "glycosylphosphatidylinositol", "pgap", "cdc1", "lipid-anchor", "gpi-anchor", "bm86",
)

FEEDING_FAMILIES = (
    "cement protein", "tick cement", "salp", "isac", "ixac", "tick-binding-inhibitor",
    "serpin", "serine protease inhibitor", "cystatin", "lipocalin", "salivary protein",
    "cytochrome p450", "glutathione s-transferase", "abc transporter",
    "cuticle protein", "peritrophin",
    "longicin", "longistatin", "defensin", "microplusin",
    "ferritin", "heme-binding", "heme binding",
    "nuclear hormone receptor", "ecdysone", "gpi-anchor", "pgap",
)

INDUCTION_TERMS = ("blood", "feeding", "engorgement", "nymph", "larv", "upregulat")

LITERATURE_ORGANISMS = ("tick", "Ixodes", "Amblyomma")
LITERATURE_PHENOTYPES = ("RNAi", "silenc*", "knockdown", "lethal")

HYDROPHOBIC_RESIDUES = "ACFILMVWY"
SMALL_RESIDUES = "GAST"

HBOND_ELEMENTS = ("N", "O", "F", "S")
AROMATIC_RESIDUES = ("PHE", "TYR", "TRP", "HIS")

SCAFFOLD_LABELS = (
    "Quinazolinone-hydrazone", "Imidazopyridine-tetrazole", "Piperazine-heteroaryl",
    "Benzazepinone", "Carbazole-amide", "Flavonoid",
)

# library name -> exact-match and lower-bound requirements on compound columns;
# "fallback" names the coarser class used when the finer one selects nothing.
LIBRARY_MODES = {
    "druglike": {},
    "approved": {"max_phase": 4},
    "antiparasitic": {"max_phase": 4, "atc_level1": "P"},
    "clinical": {"min_phase": 3},
    "natural": {"natural_product": 1},
    "antiprotozoal": {"max_phase": 4, "atc_level2": "P01", "fallback": "P"},
    "anthelmintic": {"max_phase": 4, "atc_level2": "P02", "fallback": "P"},
    "ectoparasiticide": {"max_phase": 4, "atc_level2": "P03", "fallback": "P"},
}
