"""Target selection, evidence and annotation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import Rule, first_match, rule_score
from ..functions.scores import duration_text, host_risk, hours_between, search_box
from ..functions.text import joined, normalise_ligand, safe_name
from ..operators import annotation as A
from ..operators import contacts as C
from ..operators import hits as H
from ..operators import homology as S
from ..operators import reports as R
from ..operators import targets as T
from ..params import DRUGGABLE_CLASSES
from ..session import scratch_path
from ..sources import sinks
from .registry import query

KNOWN = "('ACHE', 'ACHE2', 'ACETYLCHOLINESTERASE', 'VGSC', 'SODIUM CHANNEL', 'GABA', 'BM86')"
KNOWN_TEXT = "upper(name || ' ' || gene || ' ' || keyword_text)"


@query("exclude_known", f"""SELECT accession, name FROM proteins WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT unnest(['ACHE', 'ACHE2', 'ACETYLCHOLINESTERASE', 'VGSC', 'SODIUM CHANNEL', 'GABA', 'BM86']) AS k) w WHERE contains({KNOWN_TEXT}, k))""")
def exclude_known(t):
    return T.exclude_known(t.proteins).select("accession", "name")


@query("exclude_known_whole_word", """SELECT accession, name FROM proteins WHERE NOT regexp_matches(upper(name || ' ' || gene || ' ' || keyword_text),
    '(^|[^A-Z0-9_])(KIN|CELL|PROTEASE)([^A-Z0-9_]|$)')""")
def exclude_known_whole_word(t):
    return T.exclude_known(t.proteins, ("kin", "cell", "protease"), whole_word=True).select("accession", "name")


@query("filter_novelty", "SELECT accession FROM proteins WHERE NOT has_ligands")
def filter_novelty(t):
    return T.filter_novelty(t.proteins).select("accession")


@query("filter_novelty_no_structure", "SELECT accession FROM proteins WHERE NOT has_ligands AND NOT has_structure")
def filter_novelty_no_structure(t):
    return T.filter_novelty(t.proteins, exclude_pdb=True).select("accession")


@query("novelty_counts", """SELECT count(*) AS n_total, count(*) FILTER (WHERE has_structure) AS with_structure, count(*) FILTER (WHERE has_ligands) AS with_ligands,
    count(*) FILTER (WHERE NOT has_structure) AS no_structure, count(*) FILTER (WHERE NOT has_ligands) AS no_ligands,
    count(*) FILTER (WHERE NOT has_structure AND NOT has_ligands) AS neither FROM proteins""")
def novelty_counts(t):
    return T.novelty_counts(t.proteins)


@query("filter_length", "SELECT accession, length FROM proteins WHERE length BETWEEN 150 AND 1500")
def filter_length(t):
    return T.filter_length(t.proteins).select("accession", "length")


@query("availability_gate", """SELECT accession FROM proteins WHERE accession IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def availability_gate(t):
    return T.availability_gate(t.proteins, t.read("lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("accession"))).select("accession")


@query("availability_gate_capped", """p AS (SELECT accession FROM proteins ORDER BY accession LIMIT 120)
    SELECT accession FROM p WHERE accession IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def availability_gate_capped(t):
    available = t.read("lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("accession"))
    return T.availability_gate(t.proteins, available, [F.col("accession")], 120).select("accession")


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _first(text, words):
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in words) + " END"


def _any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


NOVEL_TEXT = "lower(name || ' ' || function || ' ' || subcellular || ' ' || keyword_text)"
NOVELTY = f"""n0 AS (SELECT *, {NOVEL_TEXT} AS txt FROM proteins),
    n1 AS (SELECT *, {_first('txt', DRUGGABLE_CLASSES)} AS cls, {_any('txt', ('membrane', 'transmembrane', 'receptor'))} AS mem,
        {_any('txt', ('cell division', 'dna replication', 'translation', 'transcription', 'atp synthesis', 'membrane integrity'))} AS ess FROM n0),
    novelty AS (SELECT *, 2 + (NOT has_ligands)::INT * 3 + (function = '')::INT * 2 + (alphafold_available AND NOT has_structure)::INT
        + (length BETWEEN 100 AND 1000)::INT + (cls IS NOT NULL)::INT + mem::INT * 2 + ess::INT * 2 AS novelty_score,
        concat_ws('; ', CASE WHEN has_structure THEN 'Experimental PDB structure (+2)' ELSE 'No experimental structure (+2)' END,
        CASE WHEN NOT has_ligands THEN 'No registered ligands (+3)' END, CASE WHEN function = '' THEN 'Unknown function (+2)' END,
        CASE WHEN alphafold_available AND NOT has_structure THEN 'AlphaFold available (+1)' END,
        CASE WHEN length BETWEEN 100 AND 1000 THEN 'Ideal docking size (+1)' END, 'Druggable class: ' || cls || ' (+1)',
        CASE WHEN mem THEN 'Membrane/receptor protein (+2)' END, CASE WHEN ess THEN 'Essential cellular process (+2)' END) AS reasons FROM n1)"""


@query("score_novelty", NOVELTY + " SELECT accession, CAST(novelty_score AS INT) AS novelty_score, reasons FROM novelty")
def score_novelty(t):
    return T.score_novelty(t.proteins).select("accession", "novelty_score", F.array_join("novelty_reasons", "; ").alias("reasons"))


@query("keyword_class_counts", NOVELTY + """, b AS (SELECT lower(name || ' ' || function) AS x FROM novelty ORDER BY novelty_score DESC, accession LIMIT 50)
    SELECT class, count(*) AS n_candidates FROM b, (SELECT unnest(['receptor', 'kinase', 'channel', 'isomerase', 'transporter', 'protease']) AS class) k
    WHERE contains(x, class) GROUP BY 1""")
def keyword_class_counts(t):
    return T.keyword_class_counts(T.score_novelty(t.proteins))


@query("rule_score", """SELECT ligand, CAST((mw > 450)::INT * 5 - (pains)::INT * 3 AS INT) AS points,
    concat_ws(',', CASE WHEN mw > 450 THEN 'heavy' END, CASE WHEN pains THEN 'pains' END) AS reasons FROM compounds""")
def rule_score_query(t):
    points, reasons = rule_score([Rule(F.col("mw") > 450, 5, "heavy"), Rule(F.col("pains"), -3, "pains")])
    return t.compounds.select("ligand", points.alias("points"), F.array_join(reasons, ",").alias("reasons"))


@query("first_match", "SELECT ligand, CASE WHEN logp > 5 THEN 'greasy' WHEN hbd > 5 THEN 'polar' ELSE 'plain' END AS kind FROM compounds")
def first_match_query(t):
    return t.compounds.select("ligand", first_match([(F.col("logp") > 5, "greasy"), (F.col("hbd") > 5, "polar")], "plain").alias("kind"))


# --- structures and pockets -------------------------------------------------------------

# one atom per line item: the target is the file, the part the residue, order and line number the place in the file
ATOMS = """pa AS (SELECT l_suppkey AS file, CAST(l_partkey % 300 AS INT) AS resnum, l_orderkey * 10 + l_linenumber AS line_no,
    CASE WHEN l_linenumber <= 5 THEN 'CA' ELSE 'CB' END AS atom_name, 50 + l_quantity AS b FROM lineitem),
    pr AS (SELECT file, resnum, arg_max(b, (line_no, b)) AS plddt FROM pa WHERE atom_name = 'CA' GROUP BY 1, 2)"""


def _protein_atoms(t):
    c = F.col
    return t.read("lineitem").select(
        c("l_suppkey").alias("file"), F.lit("ATOM").alias("record"), F.when(c("l_linenumber") <= 5, "CA").otherwise("CB").alias("atom_name"),
        F.lit("A").alias("chain"), (c("l_partkey") % 300).cast("int").alias("resnum"),
        F.struct(c("l_orderkey") * 10 + c("l_linenumber"), c("l_quantity")).alias("line_no"), (50 + c("l_quantity")).alias("b"),
        c("l_suppkey").alias("target"), c("l_discount").alias("x"), c("l_tax").alias("y"), c("l_quantity").alias("z"), c("l_linenumber").alias("line"), c("l_orderkey").alias("order"))


@query("plddt_summary", ATOMS + """, s AS (SELECT file, sum(plddt) / count(*) AS m, count(*) AS n, count(*) FILTER (WHERE plddt >= 70) AS h FROM pr GROUP BY 1)
    SELECT file, round(m, 2) AS mean_plddt, n AS total_residues, h AS high_conf_residues, round(h / n, 3) AS high_conf_fraction, m >= 70 AND h / n >= 0.5 AS suitable,
    CASE WHEN m >= 90 AND h / n >= 0.9 THEN 'EXCELLENT' WHEN m >= 80 AND h / n >= 0.7 THEN 'GOOD' WHEN m >= 70 AND h / n >= 0.5 THEN 'USABLE'
    WHEN m >= 60 THEN 'LOW' ELSE 'POOR' END AS quality_label FROM s""")
def plddt_summary(t):
    return T.plddt_summary(_protein_atoms(t))


@query("residue_bands", ATOMS + " SELECT file, resnum, plddt, CASE WHEN plddt >= 70 THEN 'high' ELSE 'low' END AS band FROM pr")
def residue_bands(t):
    return T.residue_bands(_protein_atoms(t)).select("file", "resnum", "plddt", "band")


@query("experimental_quality", """SELECT l_orderkey AS file, count(*) FILTER (WHERE l_linenumber = 7) AS total_residues, count(*) FILTER (WHERE l_linenumber = 7) > 0 AS suitable,
    CASE WHEN count(*) FILTER (WHERE l_linenumber = 7) > 0 THEN 'EXPERIMENTAL' END AS quality_label, CAST(NULL AS DOUBLE) AS mean_plddt
    FROM lineitem GROUP BY 1""")
def experimental_quality(t):
    atoms = _protein_atoms(t).withColumn("file", F.col("order")).withColumn("atom_name", F.when(F.col("line") == 7, "CA").otherwise("N"))
    return T.experimental_quality(atoms)


CHOSEN = """e AS (SELECT s_suppkey AS accession, s_suppkey % 4 <> 0 AS suitable FROM supplier WHERE s_suppkey % 3 = 0),
    p AS (SELECT s_suppkey AS accession, CASE WHEN s_suppkey % 13 <> 0 THEN s_acctbal > 2000 END AS suitable, abs(s_acctbal) / 100 AS mean_plddt FROM supplier WHERE s_suppkey % 5 <> 0),
    j AS (SELECT t.target AS accession, t.target % 3 = 0 OR t.target % 7 = 0 AS wants, e.accession IS NOT NULL AND e.suitable AND (t.target % 3 = 0 OR t.target % 7 = 0) AS use_e,
        p.accession IS NOT NULL AS has_p, p.suitable AS p_ok, p.mean_plddt AS pm FROM target_dim t LEFT JOIN e ON e.accession = t.target LEFT JOIN p ON p.accession = t.target),
    chosen AS (SELECT accession, CASE WHEN use_e THEN 'experimental' WHEN has_p AND wants THEN 'alphafold_fallback' WHEN has_p THEN 'alphafold' END AS structure_source,
        CASE WHEN NOT use_e AND NOT has_p AND wants THEN 'NO_STRUCTURE' WHEN NOT use_e AND NOT has_p THEN 'NO_ALPHAFOLD'
        WHEN NOT use_e AND p_ok IS NULL THEN 'PARSE_FAILED' ELSE 'OK' END AS structure_status,
        CASE WHEN NOT use_e THEN pm END AS mean_plddt, CASE WHEN use_e THEN TRUE ELSE coalesce(p_ok, FALSE) END AS suitable FROM j)"""


def _chosen(t):
    k = F.col("target")
    proteins = t.targets.select(k.alias("accession"), ((k % 3 == 0) | (k % 7 == 0)).alias("has_structure"), F.array(F.lit("1ABC")).alias("pdb_ids"))
    e = t.targets.where("target % 3 = 0").select(k.alias("accession"), k.cast("string").alias("file"), (k % 4 != 0).alias("suitable"),
                                                 F.lit(None).cast("double").alias("mean_plddt"), F.lit("EXPERIMENTAL").alias("quality_label"))
    p = t.targets.where("target % 5 <> 0").select(
        k.alias("accession"), k.cast("string").alias("file"), F.when(k % 13 != 0, F.col("acctbal") > 2000).alias("suitable"),
        (F.abs("acctbal") / 100).alias("mean_plddt"), F.lit("GOOD").alias("quality_label"))
    return T.choose_structure(proteins, e, p)


@query("choose_structure", CHOSEN + " SELECT accession, structure_source, structure_status, mean_plddt, suitable FROM chosen")
def choose_structure(t):
    return _chosen(t).select("accession", "structure_source", "structure_status", "mean_plddt", "suitable")


@query("structure_counts", CHOSEN + " SELECT structure_status, structure_source, count(*) AS n_proteins, count(*) FILTER (WHERE suitable) AS n_suitable FROM chosen GROUP BY 1, 2")
def structure_counts(t):
    return T.structure_counts(_chosen(t))


# pockets: one per order line of a supplier's first orders; retail price as volume, discount as score
POCKET = """pk AS (SELECT l_suppkey AS target, l_orderkey * 10 + l_linenumber AS pocket_id, l_extendedprice / 100 AS volume,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 10 END AS score, CASE WHEN l_returnflag = 'A' THEN 'fpocket' ELSE 'dogsite' END AS source,
    row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber ORDER BY l_extendedprice, l_discount, l_returnflag) AS rn FROM lineitem),
    pockets AS (SELECT target, pocket_id, volume, score, source FROM pk WHERE rn = 1)"""


def _pockets(t):
    from ..operators.ordering import keep_first

    c = F.col
    raw = t.read("lineitem").select(
        c("l_suppkey").alias("target"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("pocket_id"), c("l_extendedprice"), c("l_discount"), c("l_returnflag"), c("l_linenumber"))
    once = keep_first(raw, ["target", "pocket_id"], ["l_extendedprice", "l_discount", "l_returnflag"])
    return once.select("target", "pocket_id", (c("l_extendedprice") / 100).alias("volume"), F.when(c("l_linenumber") != 3, c("l_discount") * 10).alias("score"),
                       F.when(c("l_returnflag") == "A", "fpocket").otherwise("dogsite").alias("source"))


GOOD = POCKET + """, g AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY volume DESC, pocket_id) - 1 AS r FROM pockets WHERE coalesce(score, 0) >= 0.5 AND volume >= 300)"""


@query("filter_pockets", GOOD + """ SELECT target, pocket_id, volume, score, CAST(r AS INT) AS pocket_rank,
    CASE WHEN r = 0 THEN 'PRIMARY' ELSE 'ALLOSTERIC_' || r END AS site_type, r > 0 AS allosteric_candidate FROM g""")
def filter_pockets(t):
    return T.filter_pockets(_pockets(t)).select("target", "pocket_id", "volume", "score", "pocket_rank", "site_type", "allosteric_candidate")


@query("pocket_counts", GOOD + " SELECT target, count(*) AS druggable_pockets, count(*) FILTER (WHERE r > 0) AS allosteric_sites FROM g GROUP BY 1")
def pocket_counts(t):
    return T.pocket_counts(T.druggable(_pockets(t)))


@query("merge_pocket_source", POCKET + """, m AS (SELECT target, score FROM pockets WHERE NOT (source = 'fpocket' AND target % 3 = 0)
    UNION ALL SELECT target, volume / 1000 FROM pockets WHERE source = 'dogsite' AND target % 3 = 0)
    SELECT target, max(score) AS top_score, count(*) AS n_pockets FROM m GROUP BY 1""")
def merge_pocket_source(t):
    pockets = _pockets(t)
    again = pockets.where("source = 'dogsite' AND target % 3 = 0").select("target", "pocket_id", "volume", (F.col("volume") / 1000).alias("score"))
    return T.top_pocket_score(T.merge_pocket_source(pockets, again, "fpocket"))


@query("best_pocket", POCKET + """, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY coalesce(volume, 0) < 400, -coalesce(score, 0), pocket_id) AS rn FROM pockets)
    SELECT target, pocket_id, score, volume FROM r WHERE rn = 1""")
def best_pocket(t):
    return T.best_pocket(_pockets(t), 400.0)


@query("pocket_center", """c AS (SELECT l_suppkey AS target, avg(l_quantity) AS z, avg(CASE WHEN l_linenumber = 2 AND l_suppkey % 3 <> 0 THEN l_quantity END) AS pz FROM lineitem GROUP BY 1)
    SELECT target, round(coalesce(pz, z), 3) AS center_z FROM c""")
def pocket_center(t):
    atoms = _protein_atoms(t)
    return T.pocket_center(atoms.where("line = 2 AND target % 3 <> 0"), atoms).select("target", "center_z")


BOX = """CASE WHEN volume > 0 THEN greatest(20, least(30, CAST({fn}(2 * cbrt(3 * volume / (4 * pi())) + 8) AS INT))) ELSE 20 END"""


@query("search_box", f"""v AS (SELECT p_partkey AS target, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN 0 ELSE p_size * p_retailprice / 7 END AS volume FROM part),
    b AS (SELECT target, {BOX.format(fn='ceil')} AS box, {BOX.format(fn='floor')} AS box_floor FROM v)
    SELECT target, box AS vina_box_size, box_floor, greatest(4, least(8, CAST(round(CAST(0.4 AS DOUBLE) * box - 4) AS INT))) AS exh FROM b""")
def search_box_query(t):
    k = F.col("p_partkey")
    volumes = t.read("part").select(k.alias("target"), F.when(k % 9 == 0, None).when(k % 9 == 1, 0).otherwise(F.col("p_size") * F.col("p_retailprice") / 7).alias("volume"))
    return T.with_search_box(volumes).withColumn("box_floor", search_box(F.col("volume"), "floor")).drop("volume")


@query("effort_distribution", f"""v AS (SELECT p_size * p_retailprice / 7 AS volume FROM part), b AS (SELECT {BOX.format(fn='ceil')} AS box FROM v)
    SELECT greatest(4, least(8, CAST(round(CAST(0.4 AS DOUBLE) * box - 4) AS INT))) AS exh, count(*) AS n_targets FROM b GROUP BY 1""")
def effort_distribution(t):
    return T.effort_distribution(T.with_search_box(t.read("part").select((F.col("p_size") * F.col("p_retailprice") / 7).alias("volume"))))


# --- evidence and rank ------------------------------------------------------------------

RISK = "CASE WHEN {x} >= 0.8 THEN 'HIGH' WHEN {x} >= 0.4 THEN 'MEDIUM' WHEN {x} >= 0.2 THEN 'LOW' WHEN {x} < 0.2 THEN 'VERY LOW' END"


@query("host_risk", f"""SELECT target, CASE WHEN target % 10 = 9 THEN 'NO_SEQUENCE' WHEN target % 10 = 8 THEN 'SKIPPED' WHEN max_identity IS NULL THEN 'ERROR'
    ELSE {RISK.format(x='max_identity')} END AS risk FROM target_dim""")
def host_risk_query(t):
    k = F.col("target")
    return t.targets.select("target", T.risk_label(k % 10 != 9, k % 10 != 8, F.col("max_identity")).alias("risk"))


HOSTS = """h AS (SELECT o_custkey AS accession, CASE o_orderstatus WHEN 'F' THEN 'human' WHEN 'O' THEN 'dog' ELSE 'mouse' END AS host,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS identity FROM orders)"""


def _hosts(t):
    k = F.col("o_orderkey")
    return t.read("orders").select(
        F.col("o_custkey").alias("accession"), F.when(F.col("o_orderstatus") == "F", "human").when(F.col("o_orderstatus") == "O", "dog").otherwise("mouse").alias("host"),
        F.when(k % 7 != 0, (k % 101).cast("double") / 100).alias("identity"))


@query("host_identity", HOSTS + f""" SELECT accession, count(*) AS n_hosts, max(identity) AS max_identity, arg_max(host, (identity, host)) AS closest_host,
    {RISK.format(x='max(identity)')} AS host_risk FROM h WHERE identity IS NOT NULL GROUP BY 1""")
def host_identity(t):
    return T.host_identity(_hosts(t))


@query("host_identity_map", HOSTS + """ SELECT accession, max(identity) FILTER (WHERE host = 'human') AS identity_human, max(identity) FILTER (WHERE host = 'dog') AS identity_dog,
    max(identity) FILTER (WHERE host = 'mouse') AS identity_mouse FROM h GROUP BY 1""")
def host_identity_map(t):
    return T.host_identity_map(_hosts(t), ("human", "dog", "mouse"))


@query("newly_risky", HOSTS + """, o AS (SELECT accession, max(identity) AS v FROM h WHERE host = 'human' AND identity IS NOT NULL GROUP BY 1),
    n AS (SELECT accession, max(identity) AS v FROM h WHERE identity IS NOT NULL GROUP BY 1)
    SELECT n.accession, n.v AS new_identity, o.v AS old_identity FROM n LEFT JOIN o ON o.accession = n.accession WHERE n.v > 0.4 AND coalesce(o.v, 0) <= 0.4""")
def newly_risky(t):
    hosts = _hosts(t)
    return T.newly_risky(T.host_identity(hosts.where("host = 'human'")), T.host_identity(hosts))


FINAL = """f AS (SELECT *, CAST(novelty_score + CASE WHEN druggable_pockets >= 3 THEN 4 WHEN druggable_pockets = 2 THEN 3 WHEN druggable_pockets = 1 THEN 2 ELSE 0 END
        + CASE WHEN allosteric_sites >= 2 THEN 3 WHEN allosteric_sites = 1 THEN 2 ELSE 0 END
        + CASE WHEN max_identity < 0.2 THEN 4 WHEN max_identity < 0.4 THEN 2 WHEN max_identity >= 0.8 THEN -5 ELSE 0 END
        + CASE WHEN rnai_evidence THEN 4 ELSE 0 END
        + CASE WHEN mean_plddt IS NULL OR mean_plddt >= 90 THEN 2 WHEN mean_plddt >= 80 THEN 1 ELSE 0 END AS INT) AS final_score FROM target_dim),
    ranked_t AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, target) AS rank FROM f)"""


def _final(t):
    return T.final_score(t.targets.withColumn("accession", F.col("target")).withColumn("novelty_reasons", F.array(F.lit("base"))))


REASONS = """concat_ws('; ', 'base',
    CASE WHEN druggable_pockets >= 3 THEN druggable_pockets || ' druggable pockets (+4)' WHEN druggable_pockets = 2 THEN '2 druggable pockets (+3)' WHEN druggable_pockets = 1 THEN '1 druggable pocket (+2)' END,
    CASE WHEN allosteric_sites >= 2 THEN allosteric_sites || ' allosteric sites (+3)' WHEN allosteric_sites = 1 THEN '1 allosteric site (+2)' END,
    CASE WHEN max_identity < 0.2 THEN 'Below 20% host homology (+4)' WHEN max_identity < 0.4 THEN 'Low host homology ' || format('{:.0f}', max_identity * 100) || '% (+2)'
    WHEN max_identity >= 0.8 THEN 'HIGH host homology ' || format('{:.0f}', max_identity * 100) || '% (-5)' END,
    CASE WHEN rnai_evidence THEN 'RNAi lethality evidence ' || rnai_count || ' papers (+4)' END,
    CASE WHEN mean_plddt IS NULL THEN 'Experimental structure (+2)' WHEN mean_plddt >= 90 THEN 'Excellent pLDDT (+2)' WHEN mean_plddt >= 80 THEN 'Good pLDDT (+1)' END)"""


@query("final_score", FINAL + f" SELECT target, final_score, {REASONS} AS reasons FROM f")
def final_score(t):
    return _final(t).select("target", "final_score", F.array_join("score_reasons", "; ").alias("reasons"))


@query("rank_targets", FINAL + f""" SELECT rank, target, final_score, CASE WHEN max_identity IS NULL THEN '' ELSE format('{{:.1f}}', max_identity * 100) END AS host_identity_pct,
    {RISK.format(x='max_identity')} AS host_risk, rnai_evidence FROM ranked_t""")
def rank_targets(t):
    return T.rank_targets(_final(t)).select("rank", "target", "final_score", "host_identity_pct", "host_risk", "rnai_evidence")


@query("rank_totals", """SELECT count(*) AS n_targets, count(*) FILTER (WHERE max_identity >= 0.8) AS n_high_risk, count(*) FILTER (WHERE rnai_evidence) AS n_rnai FROM target_dim""")
def rank_totals(t):
    return T.rank_totals(t.targets.withColumn("host_risk", host_risk(F.col("max_identity"))))


REPORT = FINAL + f""", rep AS (SELECT rank, target AS accession, gene, left(name, 80) AS name, final_score * 10 AS length, mean_plddt, 'Q' || druggable_pockets AS structure_quality,
    druggable_pockets, allosteric_sites, CASE WHEN max_identity IS NULL THEN '' ELSE format('{{:.1f}}', max_identity * 100) END AS host_identity_pct, {RISK.format(x='max_identity')} AS host_risk,
    rnai_evidence, rnai_count, final_score, 'https://alphafold.ebi.ac.uk/entry/' || target AS structure_url,
    array_to_string(list_slice(string_split({REASONS}, '; '), 1, 3), ' | ') AS top_score_reasons FROM ranked_t)"""


def _report(t):
    ranked = T.rank_targets(_final(t)).withColumn("length", F.col("final_score") * 10).withColumn(
        "structure_quality", F.concat(F.lit("Q"), F.col("druggable_pockets").cast("string")))
    return R.ranked_report(ranked)


@query("ranked_report", REPORT + " SELECT * FROM rep")
def ranked_report(t):
    return _report(t)


@query("write_ranked_csv", REPORT + " SELECT * REPLACE (nullif(host_identity_pct, '') AS host_identity_pct) FROM rep")
def write_ranked_csv(t):
    path, report = scratch_path(t.spark, "csv"), _report(t)
    sinks.write_ranked_csv(report, path)
    return t.spark.read.schema(report.schema).option("header", True).csv(path)


@query("write_json_rows", REPORT + " SELECT * FROM rep")
def write_json_rows(t):
    path, report = scratch_path(t.spark, "json"), _report(t)
    sinks.write_json_rows(report, path)
    return t.spark.read.schema(report.schema).json(path)


@query("target_roster", """b AS (SELECT DISTINCT target FROM facts WHERE target % 3 = 1), s AS (SELECT DISTINCT target FROM facts WHERE target % 3 <> 1),
    u AS (SELECT target, name, 0 AS source_no FROM target_dim WHERE target IN (SELECT target FROM b)
        UNION ALL SELECT target, NULL, 1 FROM b UNION ALL SELECT target, NULL, 2 FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source_no) AS rn FROM u)
    SELECT target, CAST(source_no AS INT) AS source_no, coalesce(name, CAST(target AS VARCHAR)) AS name FROM r WHERE rn = 1""")
def target_roster(t):
    boxed, seen = t.facts.where("target % 3 = 1").select("target"), t.facts.where("target % 3 <> 1").select("target")
    return T.target_roster(t.targets.select("target", "name"), boxed, [seen])


@query("selection_funnel", """SELECT 0 AS stage_no, 'all' AS stage, count(*) AS n_rows FROM proteins UNION ALL
    SELECT 1, 'novel', count(*) FROM proteins WHERE NOT has_ligands UNION ALL
    SELECT 2, 'length', count(*) FROM proteins WHERE NOT has_ligands AND length BETWEEN 150 AND 1500 UNION ALL
    SELECT 3, 'available', count(*) FROM proteins WHERE NOT has_ligands AND length BETWEEN 150 AND 1500 AND alphafold_available""")
def selection_funnel(t):
    return T.stage_funnel([
        ("all", F.lit(True)), ("novel", ~F.col("has_ligands")), ("length", F.col("length").between(150, 1500)),
        ("available", F.col("alphafold_available"))], t.proteins)


@query("hit_funnel", """SELECT 0 AS stage_no, 'scored' AS stage, count(score) AS n_rows FROM facts UNION ALL SELECT 1, 'hits', count(*) FROM facts WHERE score <= -7 UNION ALL
    SELECT 2, 'clean', count(*) FROM facts WHERE score <= -7 AND ligand % 13 <> 0""")
def hit_funnel(t):
    return T.stage_funnel([("scored", F.col("score").isNotNull()), ("hits", F.col("score") <= -7), ("clean", F.col("ligand") % 13 != 0)], t.facts)


@query("proteome_counts", """SELECT count(*) AS n_proteins, count(*) FILTER (WHERE has_structure) AS with_structure, count(*) FILTER (WHERE has_ligands) AS with_ligands,
    count(*) FILTER (WHERE function = '') AS no_function FROM proteins""")
def proteome_counts(t):
    return T.proteome_counts(t.proteins)


# --- orthologs and sequences ------------------------------------------------------------

HOMOLOGY = """al AS (SELECT o_custkey AS accession, CASE o_orderstatus WHEN 'F' THEN 'americanum' WHEN 'O' THEN 'variabilis' ELSE 'other' END AS species, o_orderkey AS subject_id,
        CAST(o_orderkey % 1000 AS DOUBLE) / 10 AS identity_pct, CAST(o_orderkey % 77 + 24 AS DOUBLE) AS coverage_pct, o_totalprice AS bitscore FROM orders),
    br AS (SELECT *, row_number() OVER (PARTITION BY accession, species ORDER BY bitscore DESC, subject_id) AS rn FROM al),
    bh AS (SELECT * FROM br WHERE rn = 1),
    calls AS (SELECT c.c_custkey AS accession, s.species, bh.identity_pct, bh.coverage_pct, CASE WHEN identity_pct IS NULL THEN 'No hit' WHEN identity_pct >= 60 AND coverage_pct >= 70 THEN 'Pan-tick ortholog'
        WHEN identity_pct >= 40 THEN 'Putative ortholog' ELSE 'Distant homolog' END AS ortholog_call
        FROM customer c CROSS JOIN (SELECT unnest(['americanum', 'variabilis']) AS species) s LEFT JOIN bh ON bh.accession = c.c_custkey AND bh.species = s.species),
    os AS (SELECT accession, count(*) FILTER (WHERE identity_pct >= 60 AND coverage_pct >= 70) AS n_strong_orthologs,
        count(*) FILTER (WHERE identity_pct >= 40) AS species_coverage FROM calls GROUP BY 1)"""
SPECIES = ("americanum", "variabilis")


def _calls(t):
    k = F.col("o_orderkey")
    table = t.read("orders").select(
        F.col("o_custkey").alias("accession"), F.when(F.col("o_orderstatus") == "F", "americanum").when(F.col("o_orderstatus") == "O", "variabilis").otherwise("other").alias("species"),
        k.alias("subject_id"), ((k % 1000).cast("double") / 10).alias("identity_pct"), (k % 77 + 24).cast("double").alias("coverage_pct"),
        F.col("o_totalprice").alias("bitscore"), F.lit(1e-9).alias("evalue"))
    targets = t.read("customer").select(F.col("c_custkey").alias("accession"))
    return S.ortholog_calls(targets, S.best_hits(table, 1e-5), SPECIES)


@query("ortholog_calls", HOMOLOGY + " SELECT * FROM calls")
def ortholog_calls(t):
    return _calls(t)


@query("ortholog_summary", HOMOLOGY + " SELECT *, n_strong_orthologs >= 1 AS pan_tick FROM os")
def ortholog_summary(t):
    return S.ortholog_summary(_calls(t))


@query("ortholog_table", HOMOLOGY + " SELECT accession, " + ", ".join(
    f"max({c}) FILTER (WHERE species = '{s}') AS {s}_{n}" for s in SPECIES for c, n in (("identity_pct", "identity"), ("coverage_pct", "coverage"), ("ortholog_call", "call"))) + " FROM calls GROUP BY 1")
def ortholog_table(t):
    return S.ortholog_table(_calls(t), SPECIES)


@query("ortholog_totals", HOMOLOGY + """ SELECT count(*) AS n_targets, count(*) FILTER (WHERE n_strong_orthologs >= 1) AS n_pan,
    count(*) FILTER (WHERE n_strong_orthologs = 0 AND species_coverage >= 1) AS n_species_specific, count(*) FILTER (WHERE n_strong_orthologs = 0 AND species_coverage = 0) AS n_none FROM os""")
def ortholog_totals(t):
    return S.ortholog_totals(S.ortholog_summary(_calls(t)))


@query("kmer_containment", """q AS (SELECT item_id AS query_id, unnest(list_distinct(list_transform(range(1, length(text) - 6), lambda i: substring(text, i, 8)))) AS kmer FROM benchmark WHERE length(text) >= 8),
    n AS (SELECT query_id, count(*) AS n_kmers FROM q GROUP BY 1),
    s AS (SELECT doc_id AS subject_id, unnest(list_distinct(list_transform(range(1, length(text) - 6), lambda i: substring(text, i, 8)))) AS kmer FROM documents WHERE length(text) >= 8),
    p AS (SELECT query_id, subject_id, count(*) AS n_shared FROM q JOIN s ON q.kmer = s.kmer GROUP BY 1, 2),
    r AS (SELECT p.*, n_kmers, row_number() OVER (PARTITION BY p.query_id ORDER BY n_shared DESC, subject_id) AS rn FROM p JOIN n ON n.query_id = p.query_id WHERE n_shared >= 0.4 * n_kmers)
    SELECT query_id, subject_id, n_shared, n_kmers, n_shared / n_kmers AS kmer_containment FROM r WHERE rn = 1""")
def kmer_containment(t):
    queries = t.read("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("sequence"))
    subjects = t.abstracts.select(F.col("pmid").alias("id"), F.col("text").alias("sequence"))
    return S.kmer_containment(queries, subjects, k=8, min_containment=0.4)


@query("gpi_signal", """x AS (SELECT doc_id, upper(right(text, 30)) AS tail, length(text) AS n FROM documents)
    SELECT doc_id AS accession, n >= 30 AND length(regexp_replace(right(tail, 15), '[^ACFILMVWY]', '', 'g')) >= 4 AND regexp_matches(substring(tail, 14, 7), '[GAST]') AS gpi FROM x""")
def gpi_signal(t):
    return t.abstracts.select(F.col("pmid").alias("accession"), S.gpi_signal(F.col("text"), 4).alias("gpi"))


@query("sequence_union", """u AS (SELECT item_id AS accession, text AS sequence, 0 AS source_no FROM benchmark WHERE text <> '' UNION ALL
    SELECT doc_id, text, 1 FROM documents WHERE text <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY source_no, sequence) AS rn FROM u)
    SELECT accession, CAST(source_no AS INT) AS source_no, CAST(length(sequence) AS INT) AS length FROM r WHERE rn = 1""")
def sequence_union(t):
    first = t.read("benchmark").select(F.col("item_id").alias("accession"), F.col("text").alias("sequence"))
    second = t.abstracts.select(F.col("pmid").alias("accession"), F.col("text").alias("sequence"))
    return S.sequence_union([first, second]).select("accession", "source_no", F.length("sequence").alias("length"))


@query("preferred_entry", """r AS (SELECT s_nationkey AS gene, s_suppkey AS accession, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 <> 0, s_acctbal DESC, s_suppkey) AS rn FROM supplier)
    SELECT gene, accession FROM r WHERE rn = 1""")
def preferred_entry(t):
    entries = t.read("supplier").select(F.col("s_nationkey").alias("gene"), F.col("s_suppkey").alias("accession"),
                                        (F.col("s_suppkey") % 3 == 0).alias("reviewed"), F.col("s_acctbal").alias("annotation_score"))
    return S.preferred_entry(entries, ["gene"]).select("gene", "accession")


# --- annotation -------------------------------------------------------------------------

CLASS = """CASE WHEN contains(x, 'kinase') THEN 'Enzyme - Kinase/Phosphatase' WHEN contains(x, 'protease') THEN 'Enzyme - Protease' WHEN contains(x, 'receptor') THEN 'Receptor'
    WHEN contains(x, 'channel') THEN 'Transporter/Channel' WHEN contains(x, 'translation') THEN 'Translation/Ribosome' ELSE 'Unknown' END"""


@query("function_class", f"SELECT accession, {CLASS.replace('x,', 'lower(name),')} AS function_class FROM proteins")
def function_class(t):
    return t.proteins.select("accession", A.function_class(F.array("name")).alias("function_class"))


FILLED = f"""d AS (SELECT accession, string_agg(w, '; ' ORDER BY p) AS names, count(*) AS n FROM (SELECT accession, unnest(string_split(name, ' ')) AS w, unnest(range(len(string_split(name, ' ')))) AS p FROM proteins) GROUP BY 1),
    fa AS (SELECT p.accession, p.name AS name, CASE WHEN p.accession % 3 = 0 THEN p.gene ELSE 'old' END AS gene, CASE WHEN p.function = '' THEN '' ELSE p.function END AS function,
        CASE WHEN p.accession % 3 = 0 THEN 'gene' ELSE '' END AS filled_fields, d.names, d.n, lower(p.name) AS x FROM proteins p JOIN d ON d.accession = p.accession)"""


def _filled(t):
    k = F.col("accession")
    known = t.proteins.select("accession", "name", F.when(k % 3 == 0, "").otherwise("old").alias("gene"), "function", F.lit("cytoplasm").alias("subcellular"))
    found = t.proteins.select("accession", F.lit("other").alias("name"), "gene", F.lit("").alias("function"), F.lit("x").alias("subcellular"))
    words = F.split("name", " ")
    # every word twice: repeated ids must collapse to the first
    terms = F.transform(F.concat(words, words), lambda w: F.struct(w.alias("id"), w.alias("name")))
    return A.fill_annotation(known, found, t.proteins.select("accession", terms.alias("domains"), terms.alias("go_terms")))


@query("fill_annotation", FILLED + " SELECT accession, name, gene, function, filled_fields FROM fa")
def fill_annotation(t):
    return _filled(t).select("accession", "name", "gene", "function", "filled_fields")


@query("annotation_report", FILLED + f" SELECT accession, name AS new_name, gene, {CLASS} AS function_class, CAST(n AS INT) AS domain_count, names AS domain_summary, CAST(n AS INT) AS go_count, names AS go_terms FROM fa")
def annotation_report(t):
    return A.annotation_report(_filled(t))


SCAN = """a AS (SELECT accession, 'candidates' AS source, concat_ws(',', CASE WHEN accession % 50 = 0 THEN 'gpi' END, CASE WHEN accession % 50 = 0 THEN 'gpi-anchor' END) AS terms FROM proteins WHERE accession % 50 = 0),
    b AS (SELECT accession, 'targets' AS source, 'pgap' AS terms FROM proteins WHERE accession % 20 = 0)"""


def _scan(t):
    second = t.proteins.where("accession % 20 = 0").select("accession", F.lit("PGAP5").alias("gene"))
    return A.annotation_term_scan([("candidates", t.proteins.select("accession", "keywords")), ("targets", second)])


@query("annotation_term_scan", SCAN + " SELECT * FROM a UNION ALL SELECT * FROM b WHERE accession NOT IN (SELECT accession FROM a)")
def annotation_term_scan(t):
    return _scan(t).withColumn("terms", F.array_join("terms", ","))


@query("keyword_members", "SELECT accession FROM proteins WHERE accession % 9 = 0")
def keyword_members(t):
    return A.keyword_members(t.proteins, "Cell division").select("accession")


@query("keyword_or_site_members", """SELECT accession, coalesce(name, '') AS name FROM proteins WHERE accession % 9 = 0
    UNION ALL SELECT DISTINCT p_partkey, '' FROM part WHERE p_size % 5 = 0 AND p_partkey % 9 <> 0""")
def keyword_or_site_members(t):
    sites = t.read("part").select(F.col("p_partkey").alias("accession"), F.lit("Site").alias("type"),
                                  F.when(F.col("p_size") % 5 == 0, "GPI-anchor amidated residue").otherwise("Cleavage").alias("description"))
    return A.keyword_or_site_members(t.proteins, "Cell division", sites)


UNION = """e AS (SELECT accession, 'keyword' AS source FROM proteins WHERE accession % 9 = 0 UNION SELECT accession, 'scan' FROM proteins WHERE accession % 50 = 0 OR accession % 20 = 0
    UNION SELECT accession, 'signal' FROM proteins WHERE length > 1500), u AS (SELECT accession, string_agg(source, ',' ORDER BY source) AS sources FROM e GROUP BY 1)"""


def _union(t):
    return A.evidence_union([("keyword", A.keyword_members(t.proteins, "Cell division")), ("scan", _scan(t)), ("signal", t.proteins.where("length > 1500"))])


@query("evidence_union", UNION + " SELECT accession, sources FROM u")
def evidence_union(t):
    return _union(t).withColumn("sources", F.array_join("sources", ","))


@query("evidence_counts", UNION + """ SELECT count(*) FILTER (WHERE contains(sources, 'keyword')) AS n_keyword, count(*) FILTER (WHERE contains(sources, 'scan')) AS n_scan,
    count(*) FILTER (WHERE contains(sources, 'signal')) AS n_signal, count(*) AS n_union, CAST(floor((SELECT count(*) FROM proteins) * CAST(0.01 AS DOUBLE)) AS BIGINT) AS estimate_low,
    CAST(floor((SELECT count(*) FROM proteins) * CAST(0.03 AS DOUBLE)) AS BIGINT) AS estimate_high FROM u""")
def evidence_counts(t):
    return A.evidence_counts(_union(t), ("keyword", "scan", "signal"), t.proteins.agg(F.count("*")).scalar())


FEEDING = """x AS (SELECT accession, name, contains(name, 'cuticle protein') AS fam, accession % 7 = 0 AS rnai, accession % 40 = 1 AS cur, accession % 33 = 2 AS ind FROM proteins),
    fr AS (SELECT accession, CASE WHEN ind OR cur OR fam THEN 'true' WHEN rnai THEN 'Likely' ELSE 'false' END AS feeding_relevant,
    CASE WHEN ind THEN 'UniProt induction text' WHEN cur THEN 'Literature' WHEN fam THEN 'Keyword match' WHEN rnai THEN 'RNAi lethal' ELSE 'No data' END AS evidence_source,
    left(CASE WHEN ind THEN 'Upregulated by a Blood meal of ' || repeat(name || ' ', 20) WHEN cur THEN 'curated note' WHEN fam THEN 'Matches gene families: cuticle protein'
    WHEN rnai THEN 'RNAi knockdown is lethal' ELSE 'No evidence found' END, 150) AS note FROM x)"""


def _feeding(t):
    k = F.col("accession")
    meal = F.concat(F.lit("Upregulated by a Blood meal of "), F.repeat(F.concat("name", F.lit(" ")), F.lit(20)))
    targets = t.proteins.select("accession", "name", "gene", F.lit("").alias("annotation"), (k % 7 == 0).alias("rnai_evidence"), F.when(k % 33 == 2, meal).alias("induction"))
    return A.feeding_relevance(targets, t.proteins.where("accession % 40 = 1").select("accession", F.lit("curated note").alias("override_note")))


@query("feeding_relevance", FEEDING + " SELECT accession, feeding_relevant, evidence_source, note FROM fr")
def feeding_relevance(t):
    return _feeding(t).select("accession", "feeding_relevant", "evidence_source", "note")


@query("expression_summary", FEEDING + " SELECT count(*) AS n_targets, count(*) FILTER (WHERE feeding_relevant <> 'false') AS n_relevant FROM fr")
def expression_summary(t):
    return A.expression_summary(_feeding(t))


@query("relevant_accessions", FEEDING + " SELECT accession, evidence_source FROM fr WHERE feeding_relevant <> 'false'")
def relevant_accessions(t):
    return A.relevant_accessions(_feeding(t))


# literature: the longest word and the whole of a benchmark passage name a target; frequent words stand in for organism and phenotype
LITERATURE = r"""w AS (SELECT doc_id AS pmid, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS words FROM documents),
    rel AS (SELECT * FROM w WHERE (contains(words, ' the ') OR contains(words, ' der ')) AND (contains(words, ' of ') OR contains(words, ' ther'))),
    tt AS (SELECT item_id AS target, trim(regexp_replace(lower(list_sort(list_transform(string_split(text, ' '), lambda w: {'n': length(w), 'w': w}), 'DESC')[1].w), '[^\p{L}\p{N}]+', ' ', 'g')) AS term FROM benchmark
        UNION SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) FROM benchmark WHERE length(text) > 3),
    lm AS (SELECT DISTINCT target, pmid FROM tt JOIN rel ON contains(words, ' ' || term || ' ') WHERE term <> '')"""


def _literature(t):
    longest = F.array_max(F.transform(F.split("text", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    targets = t.read("benchmark").select(F.col("item_id").alias("target"), longest.alias("gene"), F.col("text").alias("name"))
    return targets, A.literature_matches(targets, t.abstracts, organisms=("the", "der"), phenotypes=("of", "ther*"), name_chars=None)


@query("literature_matches", LITERATURE + " SELECT target, pmid FROM lm")
def literature_matches(t):
    return _literature(t)[1]


@query("literature_evidence", LITERATURE + """, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pmid) AS rn FROM lm)
    SELECT b.item_id AS target, count(r.pmid) > 0 AS rnai_evidence, count(r.pmid) AS rnai_count, string_agg(CAST(r.pmid AS VARCHAR), ' ' ORDER BY r.pmid) FILTER (WHERE rn <= 5) AS pmids
    FROM benchmark b LEFT JOIN r ON r.target = b.item_id GROUP BY 1""")
def literature_evidence(t):
    return A.literature_evidence(*_literature(t)).withColumn("pmids", F.array_join(F.transform("pmids", lambda x: x.cast("string")), " "))


# --- jobs, checks and scalar functions --------------------------------------------------

JOBS = """best AS (SELECT target FROM top_pairs GROUP BY 1 ORDER BY min(score), target LIMIT 8),
    r AS (SELECT target, ligand, score, row_number() OVER (PARTITION BY target ORDER BY score, ligand) AS rank FROM top_pairs WHERE target IN (SELECT target FROM best)),
    j AS (SELECT r.target, r.ligand, r.target || '_' || r.ligand AS job_name, s.text AS sequence, c.smiles FROM r LEFT JOIN benchmark s ON s.item_id = r.target
        LEFT JOIN compounds c ON c.ligand = r.ligand WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM facts o WHERE o.target = r.target AND o.ligand = r.ligand AND o.round = 1 AND o.score <= -12.25)),
    jobs AS (SELECT *, CASE WHEN coalesce(sequence, '') = '' THEN 'no_sequence' WHEN coalesce(smiles, '') = '' THEN 'no_smiles' END AS skip_reason FROM j)"""


def _jobs(t):
    hits = H.select_hits(H.top_hits(t.facts), n_targets=8, n_hits=10)
    sequences = t.read("benchmark").select(F.col("item_id").alias("target"), F.col("text").alias("sequence"))
    done = t.facts.where("round = 1 AND score <= -12.25").select(R.job_name(F.col("target"), F.col("ligand")).alias("job_name")).distinct()
    return R.build_jobs(hits, sequences, t.compounds, done)


@query("build_jobs", JOBS + " SELECT target, ligand, job_name, skip_reason FROM jobs")
def build_jobs(t):
    return _jobs(t).select("target", "ligand", "job_name", "skip_reason")


@query("job_payloads", JOBS + """ SELECT job_name, CAST(target AS VARCHAR) AS target_accession, smiles, CAST(length(sequence) AS INT) AS sequence_length FROM jobs WHERE skip_reason IS NULL""")
def job_payloads(t):
    payload = F.col("payload")
    protein = F.get_json_object(F.get_json_object(payload, "$.sequences[0]"), "$.protein.sequence")
    return R.with_payload(_jobs(t)).select(
        F.get_json_object(payload, "$.name").alias("job_name"), F.get_json_object(payload, "$.meta.target_accession").alias("target_accession"),
        F.get_json_object(F.get_json_object(payload, "$.sequences[1]"), "$.ligand.smiles").alias("smiles"), F.length(protein).alias("sequence_length"))


@query("round_jobs", JOBS + """ SELECT 'round_' || t.first_seen_round AS tag, job_name, j.target, left(coalesce(d.name, ''), 55) AS target_name, j.ligand, j.smiles, job_name || '.json' AS file
    FROM jobs j JOIN top_pairs t ON t.target = j.target AND t.ligand = j.ligand LEFT JOIN target_dim d ON d.target = j.target WHERE skip_reason IS NULL""")
def round_jobs(t):
    return R.round_jobs(_jobs(t).withColumnRenamed("first_seen_round", "round"), t.targets)


@query("job_skip_counts", JOBS + " SELECT coalesce(skip_reason, 'ready') AS state, count(*) AS n_jobs FROM jobs GROUP BY 1")
def job_skip_counts(t):
    return _jobs(t).groupBy(F.coalesce("skip_reason", F.lit("ready")).alias("state")).agg(F.count("*").alias("n_jobs"))


@query("reference_check", """SELECT target, round, score, -9.5::DOUBLE AS reference_score, round(abs(score + 9.5), 3) AS difference, CASE WHEN score IS NULL THEN 'FAILED' WHEN abs(score + 9.5) <= 2 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT ligand AS target, round, min(score) AS score FROM facts GROUP BY 1, 2)""")
def reference_check(t):
    cases = t.facts.groupBy(F.col("ligand").alias("target"), "round").agg(F.min("score").alias("score"))
    return C.reference_check(cases.withColumn("reference_score", F.lit(-9.5)).withColumn("tolerance", F.lit(2.0))).drop("tolerance")


@query("normalise_ids", """SELECT l_orderkey, l_linenumber, 'CHEMBL' || l_partkey AS ligand, regexp_replace(l_returnflag || '-' || l_partkey || '.' || l_suppkey, '[^A-Za-z0-9_]', '_', 'g') AS job FROM lineitem""")
def normalise_ids(t):
    raw = F.concat(F.lit("CHEMBL"), F.col("l_partkey"), F.when(F.col("l_linenumber") % 3 == 0, "_out").when(F.col("l_linenumber") % 3 == 1, "_out.pdbqt").otherwise(""))
    job = F.concat("l_returnflag", F.lit("-"), "l_partkey", F.lit("."), "l_suppkey")
    return t.read("lineitem").select("l_orderkey", "l_linenumber", normalise_ligand(raw).alias("ligand"), safe_name(job).alias("job"))


@query("elapsed_times", """SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 3600 AS hours,
    CAST(value * 100 AS BIGINT) // 3600 || 'h' || lpad(CAST(CAST(value * 100 AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(CAST(value * 100 AS BIGINT) % 60 AS VARCHAR), 2, '0') || 's' AS elapsed FROM events""")
def elapsed_times(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t.read("events").select(
        "event_id", hours_between(start, F.col("ts").cast("timestamp")).alias("hours"), duration_text(F.round(F.col("value") * 100)).alias("elapsed"))
