"""Three-dimensional contacts between ligand and receptor atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..functions.scores import exact_avg
from ..params import AROMATIC_RESIDUES, DEFAULTS, HBOND_ELEMENTS, ScreenParams
from .ledger import n
from .skew import ROWS_PER_SLICE, sliced_join

CELL = ["pose", "cx", "cy", "cz"]
# Edge of a cell in cutoffs: wider cells repeat ligand atoms less and compare more pairs.
CELL_CUTOFFS = 1.5


def touched_cells(ligand: DataFrame, cutoff: float, size: float) -> DataFrame:
    """Each ligand atom (pose, lig_element, lx, ly, lz) once for every cell that the ball around it reaches.

    Of the 27 cells around an atom only those are kept whose nearest point is within the cutoff; axis by axis, so that
    cells out of reach are never formed. With cells of 1.5 cutoffs, 10.4 cells an atom are reached on average.
    """
    reach, out = cutoff * cutoff * (1 + 1e-9) + 1e-9, ligand.withColumn("_gap", F.lit(0.0))
    for a in "xyz":
        own = F.floor(F.col(f"l{a}") / size)
        out = out.withColumn(f"c{a}", F.explode(F.sequence(own - 1, own + 1)))
        low = F.col(f"c{a}") * size
        gap = F.greatest(F.lit(0.0), low - F.col(f"l{a}"), F.col(f"l{a}") - (low + size))
        out = out.withColumn("_gap", F.col("_gap") + gap * gap).where(F.col("_gap") <= reach)
    return out.drop("_gap")


def near_atoms(ligand: DataFrame, receptor: DataFrame, cutoff: float,
               rows_per_slice: int = ROWS_PER_SLICE, cells: float = CELL_CUTOFFS) -> DataFrame:
    """Ligand/receptor atom pairs of a pose within ``cutoff``, with their ``distance``.

    Space is cut into cells of ``cells`` (1 or more) cutoffs. A receptor atom lies in one cell, which owns its pairs; a ligand atom
    is looked up in the cells that its ball reaches, so each pair meets once. Atoms that coincide are folded.
    """
    size = cutoff * cells
    lig = touched_cells(ligand.select("pose", "element", "x", "y", "z").distinct().select(
        "pose", F.col("element").alias("lig_element"), *[F.col(a).alias(f"l{a}") for a in "xyz"]), cutoff, size)
    rec = receptor.select("pose", "chain", "resnum", "resname", F.col("element").alias("rec_element"), "x", "y", "z")
    rec = rec.distinct().select("*", *[F.floor(F.col(a) / size).alias(f"c{a}") for a in "xyz"])
    square = sum(((F.col(f"l{a}") - F.col(a)) * (F.col(f"l{a}") - F.col(a)) for a in "yz"),
                 (F.col("lx") - F.col("x")) * (F.col("lx") - F.col("x")))
    return sliced_join(lig, rec, CELL, F.sqrt(square) <= cutoff, rows_per_slice).withColumn("distance", F.sqrt(square))


def contacts(ligand: DataFrame, receptor: DataFrame, distance: float | None = None,
             p: ScreenParams = DEFAULTS, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Residues in contact with the ligand: shortest distance, and hbond over hydrophobic over vdw."""
    cutoff = p.contact_distance if distance is None else distance
    d = F.col("distance")
    polar = F.col("lig_element").isin(*HBOND_ELEMENTS) & F.col("rec_element").isin(*HBOND_ELEMENTS)
    carbon = (F.col("lig_element") == "C") & (F.col("rec_element") == "C")
    found = near_atoms(ligand, receptor, cutoff, rows_per_slice).groupBy("pose", "chain", "resnum", "resname").agg(
        F.round(F.min(d), 2).alias("distance"),
        F.bool_or(polar & (d <= p.hbond_distance)).alias("_hbond"),
        F.bool_or(carbon & (d <= p.hydrophobic_distance)).alias("_hydrophobic"),
    )
    return found.withColumn("type", first_match(
        [(F.col("_hbond"), "hbond"), (F.col("_hydrophobic"), "hydrophobic")], "vdw")).drop("_hbond", "_hydrophobic")


def pi_residues(ligand: DataFrame, receptor: DataFrame, distance: float | None = None,
                p: ScreenParams = DEFAULTS, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Aromatic residues per pose with a carbon near a ligand carbon."""
    cutoff = p.pi_distance if distance is None else distance
    rings = receptor.where(F.col("resname").isin(*AROMATIC_RESIDUES) & (F.col("element") == "C"))
    near = near_atoms(ligand.where(F.col("element") == "C"), rings, cutoff, rows_per_slice)
    return near.select("pose", "chain", "resnum").distinct().groupBy("pose").agg(F.count("*").alias("n_pipi"))


def contact_summary(hits: DataFrame, found: DataFrame, pi: DataFrame, poses: DataFrame) -> DataFrame:
    """Contact counts of every hit, with zeros and a note where there is no pose."""
    counted = found.groupBy("pose").agg(
        F.count("*").alias("n_contacts"),
        n(F.col("type") == "hbond").alias("n_hbonds"), n(F.col("type") == "hydrophobic").alias("n_hydrophobic"))
    there = poses.select("pose").distinct().withColumn("_there", F.lit(True))
    joined = hits.join(there, "pose", "left").join(counted, "pose", "left").join(pi, "pose", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select(
        *hits.columns, *[zero(c) for c in ("n_contacts", "n_hbonds", "n_hydrophobic", "n_pipi")],
        F.col("_there").isNotNull().alias("pose_available"),
        F.when(F.col("_there").isNull(), "pose not found").when(
            F.coalesce("n_contacts", F.lit(0)) == 0, "no contacts").otherwise("").alias("note"))


def residue_centroid(atoms: DataFrame, resname: str) -> DataFrame:
    """Mean position of one residue name per file."""
    return atoms.where(F.col("resname") == resname).groupBy("file").agg(
        F.count("*").alias("n_atoms"), *[F.round(exact_avg(F.col(a)), 3).alias(f"center_{a}") for a in "xyz"])


def reference_check(cases: DataFrame) -> DataFrame:
    """PASS/FAIL of measured scores against reference scores within a tolerance."""
    off = F.abs(F.col("score") - F.col("reference_score"))
    return cases.withColumn("difference", F.round(off, 3)).withColumn("status", first_match(
        [(F.col("score").isNull(), "FAILED"), (off <= F.col("tolerance"), "PASS")], "FAIL"))
