"""Source and sink queries. The files are derived from the tables by Spark, written to the shared
folder, and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hits as H
from ..operators import reports as R
from ..session import scratch_path
from ..sources import ledger as SL
from ..sources import proteins as SP
from ..sources import sinks
from ..sources import structures as SS
from .registry import query


def _entries(t):
    """Nested database entries made from the part table."""
    k, value = F.col("p_partkey"), lambda c: F.struct(c.alias("value"))
    full = lambda c: F.struct(value(c).alias("fullName"))
    comment = lambda kind, *texts: F.struct(F.lit(kind).alias("commentType"), F.array(*[value(x) for x in texts]).alias("texts"))
    name = F.col("p_name")
    return t.read("part").select(
        F.concat(F.lit("P"), k).alias("primaryAccession"),
        F.struct(
            F.when(k % 3 == 0, full(name)).alias("recommendedName"),
            F.when(k % 3 == 1, F.array(full(F.upper(name)))).alias("submittedNames"),
            F.when((k % 3 == 2) & (k % 2 == 0), F.array(full(F.col("p_type")))).alias("submissionNames")).alias("proteinDescription"),
        F.when(k % 4 != 0, F.array(F.struct(value(F.col("p_brand")).alias("geneName")))).alias("genes"),
        F.struct(F.upper(name).alias("value"), F.length(name).alias("length")).alias("sequence"),
        F.array_compact(F.array(
            F.when(k % 5 == 0, F.struct(F.lit("PDB").alias("database"), F.concat(F.lit("X"), k).alias("id"))),
            F.when(k % 10 == 0, F.struct(F.lit("PDB").alias("database"), F.concat(F.lit("Y"), k).alias("id"))),
            F.when(k % 7 == 0, F.struct(F.lit("ChEMBL").alias("database"), F.concat(F.lit("C"), k).alias("id"))),
        )).alias("uniProtKBCrossReferences"),
        F.array(
            comment("TISSUE SPECIFICITY", F.col("p_type"), name), comment("FUNCTION", F.concat(F.lit("Makes "), name), F.lit("second")),
            comment("FUNCTION", F.lit("later")), comment("TISSUE SPECIFICITY", F.col("p_brand")),
            comment("SUBCELLULAR LOCATION", F.col("p_brand"))).alias("comments"),
        F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit("Signal").alias("name"))).alias("keywords"))


def _written_entries(t):
    path = scratch_path(t.spark, "entries")
    _entries(t).write.json(path)
    return path


@query("read_proteome", """SELECT 'P' || p_partkey AS accession, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END END AS name,
    CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE '' END AS gene, CAST(length(p_name) AS INT) AS length, upper(p_name) AS sequence,
    concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'X' || p_partkey END, CASE WHEN p_partkey % 10 = 0 THEN 'Y' || p_partkey END) AS pdb_ids,
    CASE WHEN p_partkey % 7 = 0 THEN 'C' || p_partkey ELSE '' END AS chembl_ids, 'Makes ' || p_name AS function, p_brand AS subcellular, '' AS catalytic,
    p_type || ',Signal' AS keywords, p_partkey % 5 = 0 AS has_structure, p_partkey % 7 = 0 AS has_ligands FROM part""")
def read_proteome(t):
    df = SP.read_proteome(t.spark, _written_entries(t)).drop("species", "latin")
    for c in ("pdb_ids", "chembl_ids", "keywords"):
        df = df.withColumn(c, F.array_join(c, ","))
    return df


@query("comment_text", "SELECT 'P' || p_partkey AS accession, p_type || '. ' || p_name || '. ' || p_brand AS tissue, '' AS induction FROM part")
def comment_text(t):
    return SP.read_entries(t.spark, _written_entries(t)).select(
        F.col("primaryAccession").alias("accession"), SP.comment_text("TISSUE SPECIFICITY").alias("tissue"), SP.comment_text("INDUCTION").alias("induction"))


FASTA = "SELECT 'D' || doc_id AS accession, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents WHERE regexp_matches(text, '[A-Za-z]')"


@query("fasta_round_trip", FASTA)
def fasta_round_trip(t):
    path = scratch_path(t.spark, "fasta")
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    docs = t.read("documents").select(F.concat(F.lit("D"), "doc_id").alias("accession"), F.col("source").alias("gene"),
                                      F.concat(F.lit("a > b "), F.col("lang")).alias("name"), letters.alias("sequence"))
    SP.write_fasta(docs, path)
    return SP.read_fasta(t.spark, path).select("accession", "sequence")


@query("fasta_lines", """s AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS q FROM documents)
    SELECT doc_id, CAST(ceil(length(q) / 60) + 1 AS INT) AS n_lines FROM s WHERE q <> ''""")
def fasta_lines(t):
    docs = t.read("documents").select("doc_id", F.col("doc_id").alias("accession"), F.col("source").alias("gene"), F.col("lang").alias("name"),
                                      F.regexp_replace("text", "[^A-Za-z]", "").alias("sequence"))
    records = SP.fasta_records(docs)
    return records.select(F.regexp_extract("value", r"^>(\d+)", 1).cast("bigint").alias("doc_id"), F.size(F.split("value", "\n")).alias("n_lines"))


POSES = """pf AS (SELECT DISTINCT 'T' || l_suppkey AS target, CAST(CASE WHEN l_linenumber % 4 = 3 THEN 2 ELSE 0 END AS INT) AS pocket_idx, 'L' || l_partkey AS ligand,
        CAST(-(l_partkey % 50) AS DOUBLE) / 4 - 1 AS e1 FROM lineitem)"""


def _poses(t):
    c = F.col
    keys = t.read("lineitem").select("l_suppkey", "l_partkey", (c("l_linenumber") % 4 == 3).alias("second")).distinct()
    e = -(c("l_partkey") % 50).cast("double") / 4 - 1
    remark = lambda energy: F.format_string("REMARK VINA RESULT:    %.3f      0.000      0.000\nATOM\nENDMDL\n", energy)
    return keys.select(
        F.concat(F.lit("/poses/T"), "l_suppkey", F.when(c("second"), "_pocket2").otherwise(""), F.lit("_results/L"), "l_partkey", F.lit("_out.pdbqt")).alias("path"),
        F.concat(F.lit("MODEL 1\n"), remark(e), F.lit("MODEL 2\n"), remark(e - c("l_partkey") % 2), F.lit("MODEL 3\n"), remark(e + 0.5)).alias("value"))


@query("pose_scores_best", POSES + " SELECT target, pocket_idx, ligand, e1 - CAST(substr(ligand, 2) AS BIGINT) % 2 AS score FROM pf")
def pose_scores_best(t):
    return SS.best_pose(SS.pose_scores(_poses(t)))


@query("pose_scores_first", POSES + " SELECT target, pocket_idx, ligand, e1 AS score FROM pf")
def pose_scores_first(t):
    return SS.first_pose(SS.pose_scores(_poses(t)))


def _atom_files(t, kind):
    """Atom files of twenty atoms each; pose files hold a second model that must be ignored."""
    k = F.col("vec_id")
    x, y, z = (F.round(F.col("embedding")[i].cast("double") * 60, 3) for i in range(3))
    element = F.when(k % 4 == 0, "N").when(k % 4 == 1, "H").when(k % 4 == 2, "").otherwise("C")
    line = F.format_string("%-6s%5d %-4s %3s %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s",
                           F.when(k % 3 == 0, "HETATM").otherwise("ATOM"), k % 99999, F.lit(" O1"), F.when(k % 2 == 0, "GLY").otherwise("PHE"),
                           F.lit("A"), (k % 60).cast("int"), x, y, z, F.lit(1.0), (k % 100).cast("double"), element)
    lines = t.read("embeddings").select((k / 20).cast("bigint").alias("f"), F.struct(k.alias("k"), line.alias("l")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["l"]), "\n")
    files = lines.groupBy("f").agg(body.alias("body"))
    value = F.concat(F.lit("HEADER\n"), "body", F.lit("\nTER\n"))
    if kind == "pose":
        value = F.concat(F.lit("MODEL 1\n"), "body", F.lit("\nENDMDL\nMODEL 2\n"), "body", F.lit("\nENDMDL\n"))
    return files.select(F.concat(F.lit("/a/f"), "f", F.lit(".pdb")).alias("path"), value.alias("value"))


ATOM_ROWS = """SELECT 'f' || vec_id // 20 || '.pdb' AS file, CAST(vec_id % 20 + 1 AS BIGINT) AS line_no, CASE WHEN vec_id % 3 = 0 THEN 'HETATM' ELSE 'ATOM' END AS record, 'O1' AS atom_name,
    CASE WHEN vec_id % 2 = 0 THEN 'GLY' ELSE 'PHE' END AS resname, 'A' AS chain, CAST(vec_id % 60 AS INT) AS resnum, CASE vec_id % 4 WHEN 0 THEN 'N' WHEN 2 THEN 'O' ELSE 'C' END AS element,
    round(CAST(embedding[1] AS DOUBLE) * 60, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 60, 3) AS y, round(CAST(embedding[3] AS DOUBLE) * 60, 3) AS z, CAST(vec_id % 100 AS DOUBLE) AS b
    FROM embeddings WHERE vec_id % 4 <> 1"""


@query("read_atoms", ATOM_ROWS)
def read_atoms(t):
    return SS.atom_lines(_atom_files(t, "pdb"))


@query("read_pose_atoms", ATOM_ROWS)
def read_pose_atoms(t):
    return SS.atom_lines(_atom_files(t, "pose"), kind="pose")


@query("pocket_report", """SELECT 'T' || p_partkey // 10 AS target, CAST(p_partkey % 10 + 1 AS INT) AS pocket_id, p_size / 50 AS score, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS volume,
    CAST(p_size AS DOUBLE) AS alpha_spheres FROM part""")
def pocket_report(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    block = F.concat(
        F.format_string("Pocket %d :\n\tScore :\t0.1\n\tDruggability Score :\t%.2f\n\tNumber of Alpha Spheres :\t%d\n\tTotal SASA :\t12.5\n", k % 10 + 1, s / 50, s),
        F.when(k % 6 != 0, F.format_string("\tVolume :\t%.1f\n", "p_retailprice")).otherwise("\tVolume :\t-\n"), F.lit("\n"))
    blocks = t.read("part").select(F.floor(k / 10).alias("f"), F.struct((k % 10).alias("k"), block.alias("b")).alias("s"))
    files = blocks.groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "").alias("value"))
    return SS.pocket_report(files.select(F.concat(F.lit("/p/T"), "f", F.lit("_info.txt")).alias("path"), "value")).select(
        "target", "pocket_id", "score", "volume", "alpha_spheres")


@query("pocket_predictions", """SELECT CAST(p_partkey AS INT) AS pocket_id, p_retailprice AS score, p_size / 50 AS probability, CAST(p_size * 20 AS DOUBLE) AS volume, CAST(p_size AS DOUBLE) AS center_x FROM part WHERE p_partkey % 8 <> 0""")
def pocket_predictions(t):
    path = scratch_path(t.spark, "predictions")
    k, s = F.col("p_partkey"), F.col("p_size")
    padded = t.read("part").select(
        F.format_string("pocket%d  ", k).alias("name  "), F.format_string("  %d", k).alias("  rank"),
        F.when(k % 8 == 0, " broken").otherwise(F.concat(F.lit("   "), F.col("p_retailprice").cast("string"))).alias("   score"),
        (s / 50).cast("string").alias(" probability"), s.alias(" surf_atoms"), s.alias("   center_x"), s.alias("   center_y"), s.alias("   center_z"),
        F.lit(" A_1 A_2").alias(" residue_ids"))
    padded.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return SS.read_pocket_predictions(t.spark, path, "*.csv").select("pocket_id", "score", "probability", "volume", "center_x")


@query("read_alignments", """SELECT 'A' || o_custkey AS accession, 'S' || o_orderkey AS subject_id, CAST(o_orderkey % 100 AS DOUBLE) AS identity_pct, CAST(o_orderkey % 300 AS INT) AS aln_length, CAST(o_custkey % 320 AS INT) AS query_len,
    o_totalprice AS bitscore, coalesce(round((o_orderkey % 300) * 100 / nullif(o_custkey % 320, 0), 1), 0) AS coverage_pct FROM orders""")
def read_alignments(t):
    path = scratch_path(t.spark, "alignments")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t.read("orders").select(
        F.concat(F.lit("A"), c), F.concat(F.lit("S"), k), (k % 100).cast("double"), (k % 300).cast("int"), (c % 320).cast("int"),
        F.lit(100), F.lit(1e-20), F.col("o_totalprice")).write.option("sep", "\t").csv(path)
    return SS.read_alignments(t.spark, path).select(
        "accession", "subject_id", "identity_pct", "aln_length", "query_len", "bitscore", "coverage_pct")


@query("read_ledger", "SELECT CAST(target AS VARCHAR) AS target, CAST(ligand AS VARCHAR) AS ligand, score, CASE WHEN line <> 1 THEN exh END AS exh FROM facts")
def read_ledger(t):
    path = scratch_path(t.spark, "ledger")
    t.ledger.select("target", "ligand", "score", "exh").withColumn("target", F.col("target").cast("string")).withColumn(
        "ligand", F.col("ligand").cast("string")).write.json(path)
    return SL.read_ledger(t.spark, path)


FACTS_PER_DROP = 2000


def drop_chunks(t):
    """Drops of each batch, such that they have about FACTS_PER_DROP facts on average."""
    batches = t.facts.groupBy("round", "batch_id").count().agg(F.sum("count").alias("facts"), F.count("*").alias("n")).first()
    return max(1, -(-(batches["facts"] or 0) // (max(1, batches["n"]) * FACTS_PER_DROP)))


def drop_rows(facts, chunks):
    """(round, batch_id, exh, kept, near_miss, pruned) of each drop of ``facts``, with ``chunks`` drops a batch."""
    text = facts.select(
        "round", "batch_id", F.when(F.col("batch_id") % 2 == 0, 6).alias("file_exh"),
        F.pmod(F.xxhash64(*facts.columns), F.lit(chunks)).alias("chunk"),
        F.when(F.col("score") <= -7, "kept").when(F.col("score") <= -5.5, "near_miss").otherwise("pruned").alias("zone"),
        F.struct(F.col("target").cast("string").alias("target"), F.col("ligand").cast("string").alias("ligand"), "score",
                 F.when(F.col("line") != 1, F.col("exh")).alias("exh")).alias("fact"))
    return text.groupBy("round", "batch_id", "chunk").agg(
        F.max("file_exh").alias("exh"), *[F.collect_list(F.when(F.col("zone") == z, F.col("fact"))).alias(z) for z in SL.SECTIONS])


def write_drops(t, path):
    """Batch drops of the facts: one file of indented JSON for each (round, batch, chunk), with arrays per
    section. The round is in the file's path only. The number of chunks follows the table, so that a drop stays small."""
    body = F.to_json(F.struct("batch_id", "exh", *SL.SECTIONS), {"pretty": "true"})
    name = F.format_string("batch_R%d_B%d_compressed.json", "round", "batch_id")
    drop_rows(t.facts, drop_chunks(t)).select(name.alias("drop"), body.alias("value")).write.option(
        "maxRecordsPerFile", 1).partitionBy("drop").text(path)


def write_drop_lines(facts, chunks, path):
    """The same drops, one a line with its round, in as few files as their size asks for."""
    drop_rows(facts, chunks).select(F.to_json(F.struct("round", "batch_id", "exh", *SL.SECTIONS)).alias("value")).write.text(path)


DROPS = """SELECT round, batch_id, CAST(target AS VARCHAR) AS target, CAST(ligand AS VARCHAR) AS ligand, score,
    CASE WHEN line <> 1 THEN exh WHEN batch_id % 2 = 0 THEN 6 END AS exh, CASE WHEN score <= -7 THEN 'kept' WHEN score <= -5.5 THEN 'near_miss' ELSE 'pruned' END AS zone FROM facts"""


@query("read_batch_drops", DROPS)
def read_batch_drops(t):
    path = scratch_path(t.spark, "drops")
    write_drops(t, path)
    return SL.read_batch_drops(t.spark, path)


@query("box_configs", "SELECT 'T' || p_partkey AS target, CAST(p_size AS DOUBLE) AS center_x, p_retailprice AS center_y, CAST(-p_size AS DOUBLE) AS center_z, 20.0::DOUBLE AS size_x, 20.0::DOUBLE AS size_y, 25.0::DOUBLE AS size_z FROM part WHERE p_partkey % 9 <> 0")
def box_configs(t):
    return SS.box_configs(_config_lines(t))


def _config_lines(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    lines = F.array_compact(F.array(
        F.lit("# search box, volume = 12"), F.concat(F.lit("receptor = T"), k, F.lit(".pdbqt")), F.concat(F.lit("center_x = "), s),
        F.concat(F.lit("center_y="), F.col("p_retailprice")), F.concat(F.lit("center_z = -"), s), F.lit("size_x = 20"), F.lit("size_y = 20.0"),
        F.when(k % 9 != 0, "size_z = 25"), F.lit("exhaustiveness = 8"), F.lit("num_modes = 9"), F.lit("out = x.pdbqt")))
    return t.read("part").select(F.concat(F.lit("/c/T"), k, F.lit("_vina.conf")).alias("path"), F.explode(lines).alias("value"))


@query("strip_run_keys", "SELECT 'T' || p_partkey || '_vina.conf' AS file, CAST(CASE WHEN p_partkey % 9 = 0 THEN 7 ELSE 8 END AS BIGINT) AS n_lines FROM part")
def strip_run_keys(t):
    return SS.strip_run_keys(_config_lines(t)).groupBy(SS.file_name(F.col("path")).alias("file")).agg(F.count("*").alias("n_lines"))


@query("smiles_map", "SELECT CAST(ligand AS VARCHAR) AS ligand, smiles FROM compounds")
def smiles_map(t):
    pair = F.struct(F.col("ligand").cast("string"), F.col("smiles"))
    maps = t.compounds.groupBy(F.floor(F.col("ligand") / 100).alias("f")).agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value"))
    return SL.smiles_map(maps)


@query("read_trend", """SELECT 'batch' AS kind, round, batch_id, count(*) AS cum_hits, NULL::BIGINT AS upgraded, make_timestamp(2024, 1, 1, round, batch_id, 0.0) AS timestamp FROM facts WHERE score <= -7 GROUP BY round, batch_id
    UNION ALL SELECT 'near_miss_upgrade', round, NULL, NULL, count(*), make_timestamp(2024, 1, 2, round, 0, 0.0) FROM facts WHERE score <= -12 GROUP BY round""")
def read_trend(t):
    path = scratch_path(t.spark, "trend")
    stamp = lambda day, minute: F.format_string(f"2024-01-{day:02d}T%02d:%02d:00", "round", minute)
    t.facts.where("score <= -7").groupBy("round", "batch_id").agg(F.count("*").alias("cum_hits")).withColumn(
        "timestamp", stamp(1, F.col("batch_id"))).write.json(path)
    t.facts.where("score <= -12").groupBy("round").agg(F.count("*").alias("upgraded")).withColumn(
        "timestamp", stamp(2, F.lit(0))).withColumn("type", F.lit("near_miss_upgrade")).write.mode("append").json(path)
    return SL.read_trend(t.spark, path).select(
        "kind", "round", "batch_id", "cum_hits", "upgraded", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def _audit(t):
    k = F.col("s_suppkey")
    entry = lambda v: F.struct(v.cast("string").alias("value"), F.lit("about").alias("description"))
    step = F.struct(
        F.lit("2024-01-01").alias("started"), F.col("s_acctbal").alias("elapsed_sec"),
        F.create_map(F.lit("limit"), entry(k), F.lit("mode"), entry(F.col("s_name"))).alias("params"),
        F.create_map(F.lit("total"), entry(k * 2)).alias("stats"),
        F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.struct(F.lit("svc").alias("service"), i.cast("int").alias("result_count"))).alias("api_calls"),
        F.when(k % 2 == 0, F.array(F.struct(F.lit("w").alias("message")))).alias("warnings"))
    value = F.to_json(F.struct(F.create_map(F.concat(F.lit("step_"), k), step).alias("steps")))
    return SL.audit_log(t.read("supplier").select(value.alias("value")))


@query("audit_summary", """SELECT 'step_' || s_suppkey AS step, '2024-01-01' AS started, s_acctbal AS elapsed_sec, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS n_warnings, 0 AS n_errors,
    CAST(s_suppkey % 3 + 1 AS INT) AS n_api_calls FROM supplier""")
def audit_summary(t):
    return R.audit_summary(_audit(t))


@query("audit_parameters", """SELECT 'step_' || s_suppkey AS step, 'limit' AS parameter, CAST(s_suppkey AS VARCHAR) AS value, 'about' AS description FROM supplier
    UNION ALL SELECT 'step_' || s_suppkey, 'mode', s_name, 'about' FROM supplier""")
def audit_parameters(t):
    return R.audit_parameters(_audit(t))


@query("audit_statistics", "SELECT 'step_' || s_suppkey AS step, 'total' AS statistic, CAST(s_suppkey * 2 AS VARCHAR) AS value, 'about' AS description FROM supplier")
def audit_statistics(t):
    return R.audit_statistics(_audit(t))


@query("write_table", "SELECT target, name, max_identity, rnai_evidence FROM target_dim")
def write_table(t):
    path = scratch_path(t.spark, "tsv")
    sinks.write_table(t.targets.select("target", "name", "max_identity", "rnai_evidence"), path)
    return t.spark.read.schema("target bigint, name string, max_identity double, rnai_evidence boolean").option("sep", "\t").option("header", True).csv(path)


@query("write_per_target", "SELECT target, ligand, score FROM top_pairs")
def write_per_target(t):
    path = scratch_path(t.spark, "per-target")
    sinks.write_per_target(H.top_hits(t.facts).select("target", "ligand", "score"), path)
    return sinks.read_per_target(t.spark, path, "ligand bigint, score double, target bigint")


@query("write_facts", "SELECT round, batch_id, count(*) AS n_facts, min(score) AS best_score FROM facts GROUP BY 1, 2")
def write_facts(t):
    path = scratch_path(t.spark, "facts")
    sinks.write_facts(t.facts.select("round", "batch_id", "target", "ligand", "score", "exh"), path)
    return t.spark.read.parquet(path).groupBy(F.col("round").cast("int").alias("round"), F.col("batch_id").cast("int").alias("batch_id")).agg(F.count("*").alias("n_facts"), F.min("score").alias("best_score"))


@query("slim_projection", "SELECT doc_id, lang FROM documents")
def slim_projection(t):
    docs = t.read("documents").select("doc_id", "lang", F.col("text").alias("sequence"))
    return R.slim(docs)
