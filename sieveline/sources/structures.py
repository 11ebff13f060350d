"""Structure and pose files: atoms, pose scores, pockets and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise_ligand

FLOAT = r"([-+]?\d+(?:\.\d+)?)"
# Field labels of the pocket report and the fixed columns of atom records.
POCKET_FIELDS = {
    "score": r"Druggability Score\s*:\s*",
    "volume": r"Volume\s*:\s*",
    "area": r"Total SASA\s*:\s*",
    "hydrophobicity": r"Mean local hydrophobic density\s*:\s*",
    "alpha_spheres": r"Number of Alpha Spheres\s*:\s*",
}
ATOM_COLUMNS = {
    "atom_name": (13, 4), "resname": (18, 3), "chain": (22, 1), "resnum": (23, 4),
    "x": (31, 8), "y": (39, 8), "z": (47, 8), "b": (61, 6), "element": (77, 2),
}
BOX_KEYS = ("center_x", "center_y", "center_z", "size_x", "size_y", "size_z")
RUN_KEYS = ("out", "log", "exhaustiveness", "num_modes", "energy_range")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, value) of every small text file below ``path``."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def pose_scores(files: DataFrame) -> DataFrame:
    """(target, pocket_idx, ligand, pose, energy) of every result line of pose files.

    Pose numbers follow the lines of a file, so a file is one row here. Folders named
    ``target_pocketN_results`` keep their pocket number instead of posing as targets.
    """
    energies = F.regexp_extract_all("value", F.lit(r"REMARK VINA RESULT:?\s+" + FLOAT), F.lit(1))
    parts = F.split("path", "/")
    folder = F.when((F.size(parts) > 1) & (file_name(F.col("path")) != ""), F.element_at(parts, -2))
    # names and energies are cut out once a file, before its poses become rows
    read = files.select(folder.alias("_folder"), normalise_ligand(file_name(F.col("path"))).alias("ligand"), energies.alias("_e")).withColumn(
        "_name", F.when(F.endswith("_folder", F.lit("_results")), F.expr("left(_folder, length(_folder) - 8)")).otherwise(""))
    keyed = read.select(
        F.regexp_replace("_name", r"_pocket\d+$", "").alias("target"),
        F.coalesce(F.regexp_extract("_name", r"_pocket(\d+)$", 1).try_cast("int"), F.lit(0)).alias("pocket_idx"), "ligand", "_e")
    return keyed.select("target", "pocket_idx", "ligand", F.posexplode("_e").alias("_i", "_e")).select(
        "target", "pocket_idx", "ligand", (F.col("_i") + 1).alias("pose"), F.col("_e").cast("double").alias("energy"))


def read_pose_scores(spark: SparkSession, path: str, pattern: str = "*.pdbqt") -> DataFrame:
    return pose_scores(whole_files(spark, path, pattern))


def first_pose(poses: DataFrame) -> DataFrame:
    """Energy of the first reported pose."""
    return poses.groupBy("target", "pocket_idx", "ligand").agg(F.min_by("energy", "pose").alias("score"))


def best_pose(poses: DataFrame) -> DataFrame:
    """Lowest energy over all poses."""
    return poses.groupBy("target", "pocket_idx", "ligand").agg(F.min("energy").alias("score"))


def _field(name: str) -> Column:
    start, width = ATOM_COLUMNS[name]
    return F.trim(F.substring("line", start, width))


def atom_lines(files: DataFrame, kind: str = "pdb") -> DataFrame:
    """Atom rows of whole files given as (path, value).

    ``kind='pose'`` keeps the first model only, ``kind='receptor'`` only ATOM records with a residue
    number. Hydrogens and lines whose coordinates do not parse are dropped; a missing element is
    the first letter of the atom name. Pose files put the atom type one column further right, so
    its first letter is what counts there.
    """
    text = F.col("value")
    if kind == "pose":
        text = F.split(text, r"(?m)^ENDMDL", 2)[0]
    lines = files.select(file_name(F.col("path")).alias("file"), F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    is_atom = F.col("line").startswith("ATOM")
    atoms = lines.where(is_atom if kind == "receptor" else is_atom | F.col("line").startswith("HETATM"))
    letters = F.upper(_field("element"))
    fallback = F.upper(F.regexp_extract(_field("atom_name"), r"([A-Za-z])", 1))
    out = atoms.select(
        "file", F.col("line_no").cast("bigint").alias("line_no"), F.trim(F.substring("line", 1, 6)).alias("record"),
        _field("atom_name").alias("atom_name"), _field("resname").alias("resname"), _field("chain").alias("chain"),
        _field("resnum").try_cast("int").alias("resnum"),
        F.when(letters != "", letters).otherwise(fallback).alias("element"),
        *[_field(a).try_cast("double").alias(a) for a in ("x", "y", "z", "b")])
    out = out.where((F.col("element") != "H") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    return out.where(F.col("resnum").isNotNull()) if kind == "receptor" else out


def read_atoms(spark: SparkSession, path: str, kind: str = "pdb", pattern: str = "*") -> DataFrame:
    return atom_lines(whole_files(spark, path, pattern), kind)


def pocket_report(files: DataFrame) -> DataFrame:
    """Pocket blocks of report files: one row per (file, pocket); absent values are null."""
    blocks = F.filter(F.split("value", r"(?=Pocket\s+\d+\s*:)"), lambda b: b.rlike(r"^Pocket\s+\d+\s*:"))
    rows = files.select(F.regexp_replace(file_name(F.col("path")), r"_info\.txt$", "").alias("target"), F.explode(blocks).alias("_b"))
    return rows.select(
        "target", F.regexp_extract("_b", r"^Pocket\s+(\d+)", 1).cast("int").alias("pocket_id"),
        F.lit("fpocket").alias("source"),
        *[F.regexp_extract("_b", label + FLOAT, 1).try_cast("double").alias(name) for name, label in POCKET_FIELDS.items()])


def read_pocket_report(spark: SparkSession, path: str, pattern: str = "*_info.txt") -> DataFrame:
    return pocket_report(whole_files(spark, path, pattern))


def read_pocket_predictions(spark: SparkSession, path: str, pattern: str = "*_predictions.csv") -> DataFrame:
    """Pocket prediction tables: padded headers, comment lines, and rows that do not parse dropped.

    Columns are found by the names in each file's own header, so files may differ in their order; the size
    is a proxy of 20 per surface atom.
    """
    plain = lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
        .select(F.col("_metadata.file_path").alias("_path"), F.transform(F.split("value", ","), plain).alias("_cells"))
        .where(~F.startswith(F.element_at("_cells", 1), F.lit("#")))
    )
    is_header = F.array_contains("_cells", "rank") & F.array_contains("_cells", "probability")
    headers = lines.where(is_header).groupBy("_path").agg(F.min("_cells").alias("_header"))
    rows = lines.where(~is_header).join(headers, "_path").where(F.size("_cells") == F.size("_header"))
    raw = rows.select("_path", F.map_from_arrays("_header", "_cells").alias("_row"))
    cell = lambda c: F.element_at("_row", F.lit(c))
    number = lambda c: cell(c).try_cast("double")
    out = raw.select(
        F.regexp_replace(file_name(F.col("_path")), r"(\.pdb)?_predictions\.csv$", "").alias("target"),
        cell("rank").try_cast("int").alias("pocket_id"), F.lit("p2rank").alias("source"),
        number("score").alias("score"), number("probability").alias("probability"),
        (number("surf_atoms") * 20).alias("volume"),
        *[number(f"center_{a}").alias(f"center_{a}") for a in "xyz"])
    return out.dropna(subset=["pocket_id", "score", "probability", "volume", "center_x", "center_y", "center_z"])


def box_configs(lines: DataFrame) -> DataFrame:
    """One row per box file with all six values, from its (path, value) lines."""
    kv = F.split("value", "=", 2)
    pairs = lines.where((F.size(kv) == 2) & ~F.trim(kv[0]).startswith("#")).select(
        F.regexp_replace(file_name(F.col("path")), r"(_vina)?\.conf$", "").alias("target"),
        F.trim(kv[0]).alias("key"), F.trim(kv[1]).try_cast("double").alias("value"))
    wide = pairs.groupBy("target").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in BOX_KEYS])
    return wide.dropna(subset=list(BOX_KEYS))


def config_lines(spark: SparkSession, path: str, pattern: str = "*_vina.conf") -> DataFrame:
    """(path, value) of every line of the box files."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


def read_box_configs(spark: SparkSession, path: str, pattern: str = "*_vina.conf") -> DataFrame:
    return box_configs(config_lines(spark, path, pattern))


def strip_run_keys(lines: DataFrame, keys: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    """Config lines without those that belong to a single run."""
    return lines.where(~F.trim(F.substring_index("value", "=", 1)).isin(*keys))


ALIGNMENT_SCHEMA = T.StructType([
    T.StructField("accession", T.StringType()), T.StructField("subject_id", T.StringType()),
    T.StructField("identity_pct", T.DoubleType()), T.StructField("aln_length", T.IntegerType()),
    T.StructField("query_len", T.IntegerType()), T.StructField("subject_len", T.IntegerType()),
    T.StructField("evalue", T.DoubleType()), T.StructField("bitscore", T.DoubleType()),
])


def read_alignments(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    """Tabular alignments with query coverage in percent (one decimal)."""
    rows = spark.read.schema(ALIGNMENT_SCHEMA).option("sep", "\t").option("comment", "#").csv(path)
    coverage = F.round(F.try_divide(F.col("aln_length") * 100.0, F.col("query_len")), 1)
    out = rows.withColumn("coverage_pct", F.coalesce(coverage, F.lit(0.0)))
    return out if species is None else out.withColumn("species", F.lit(species))
