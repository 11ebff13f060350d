"""Fingerprint and contact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts as C
from ..operators import similarity as S
from .bindings import N_BITS
from .registry import query


@query("tanimoto_join", "SELECT a, b, similarity, n_shared, a_copies, b_copies FROM fp_pairs WHERE similarity >= 0.5")
def tanimoto_join(t):
    return S.tanimoto_pairs(S.distinct_fingerprints(t.fingerprints, N_BITS), 0.5, N_BITS).withColumn(
        "n_shared", F.col("n_shared").cast("bigint"))


NEAREST = """nn AS (SELECT f.fp_id, CASE WHEN f.copies > 1 THEN 1 ELSE coalesce(max(p.similarity), 0) END AS nn_similarity
        FROM fp_distinct f LEFT JOIN (SELECT a AS x, similarity FROM fp_pairs UNION ALL SELECT b, similarity FROM fp_pairs) p ON p.x = f.fp_id GROUP BY f.fp_id, f.copies),
    nearest AS (SELECT r.ligand, CAST(nn_similarity AS DOUBLE) AS nn_similarity FROM fp_rows r JOIN fp_distinct d ON d.pattern = r.pattern JOIN nn ON nn.fp_id = d.fp_id)"""


@query("nearest_neighbor", NEAREST + " SELECT ligand, nn_similarity FROM nearest")
def nearest_neighbor(t):
    return S.nearest_neighbor(t.fingerprints, N_BITS)


@query("similarity_summary", NEAREST + """ SELECT count(*) AS n_compounds, round(avg(nn_similarity), 3) AS mean_nn, round(min(nn_similarity), 3) AS min_nn,
    round(max(nn_similarity), 3) AS max_nn FROM nearest""")
def similarity_summary(t):
    return S.similarity_summary(S.nearest_neighbor(t.fingerprints, N_BITS))


# The sequential rule itself: compounds one by one, each that is still free claims its free neighbours.
CLUSTERS = """nb AS (SELECT a AS x, b AS y FROM fp_pairs WHERE similarity >= 0.5 UNION ALL SELECT b, a FROM fp_pairs WHERE similarity >= 0.5),
    deg AS (SELECT f.fp_id, f.copies - 1 + coalesce(sum(o.copies), 0) AS degree, coalesce(list(o.fp_id) FILTER (WHERE o.fp_id IS NOT NULL), []) AS nbs
        FROM fp_distinct f LEFT JOIN nb ON nb.x = f.fp_id LEFT JOIN fp_distinct o ON o.fp_id = nb.y GROUP BY f.fp_id, f.copies),
    ord AS MATERIALIZED (SELECT fp_id, nbs, row_number() OVER (ORDER BY degree DESC, fp_id) AS pos FROM deg),
    walk(pos, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.pos, CASE WHEN list_contains(w.taken, o.fp_id) THEN w.taken
        ELSE list_concat(w.taken, [o.fp_id], list_filter(o.nbs, lambda x: NOT list_contains(w.taken, x))) END FROM walk w JOIN ord o ON o.pos = w.pos + 1),
    cen AS (SELECT o.fp_id, o.pos, row_number() OVER (ORDER BY o.pos) - 1 AS cluster FROM ord o JOIN walk w ON w.pos = o.pos - 1 WHERE NOT list_contains(w.taken, o.fp_id)),
    own AS (SELECT fp_id, cluster FROM cen UNION ALL SELECT nb.x, min(c.cluster) FROM nb JOIN cen c ON c.fp_id = nb.y WHERE nb.x NOT IN (SELECT fp_id FROM cen) GROUP BY nb.x),
    clustered AS (SELECT r.ligand, own.cluster FROM fp_rows r JOIN fp_distinct d ON d.pattern = r.pattern JOIN own ON own.fp_id = d.fp_id),
    scored AS (SELECT c.ligand, c.cluster, s.target, s.score FROM clustered c JOIN (SELECT ligand, target, min(score) AS score FROM facts WHERE score <= -7 GROUP BY 1, 2) s ON s.ligand = c.ligand),
    tab AS (SELECT cluster, count(*) AS n_members, min(score) AS best_score, arg_min(ligand, (score, ligand, target)) AS rep_ligand,
        arg_min(target, (score, ligand, target)) AS rep_target FROM scored GROUP BY 1)"""


@query("butina_clusters", CLUSTERS + " SELECT ligand, cluster FROM clustered", recursive=True)
def butina_clusters(t):
    return S.butina(t.fingerprints, N_BITS, 0.5)


@query("cluster_table", CLUSTERS + " SELECT * FROM tab", recursive=True)
def cluster_table(t):
    scored = t.facts.where("score <= -7").groupBy("ligand", "target").agg(F.min("score").alias("score"))
    return S.cluster_table(S.butina(t.fingerprints, N_BITS, 0.5).join(scored, "ligand"))


@query("cluster_representatives", CLUSTERS + """ SELECT s.*, n_members, ligand = rep_ligand AS cluster_rep FROM scored s JOIN tab USING (cluster)""", recursive=True)
def cluster_representatives(t):
    scored = t.facts.where("score <= -7").groupBy("ligand", "target").agg(F.min("score").alias("score"))
    clustered = S.butina(t.fingerprints, N_BITS, 0.5).join(scored, "ligand")
    return S.mark_representatives(clustered, S.cluster_table(clustered))


CONTACT = """cp AS (SELECT r.pose, r.chain, r.resnum, r.resname, l.element AS le, r.element AS re,
        sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z)) AS d
        FROM atoms l JOIN atoms r ON l.pose = r.pose WHERE l.is_ligand AND NOT r.is_ligand),
    found AS (SELECT pose, chain, resnum, resname, round(min(d), 2) AS distance,
        CASE WHEN bool_or(le IN ('N', 'O', 'F', 'S') AND re IN ('N', 'O', 'F', 'S') AND d <= 3.5) THEN 'hbond'
        WHEN bool_or(le = 'C' AND re = 'C' AND d <= 4.5) THEN 'hydrophobic' ELSE 'vdw' END AS type
        FROM cp WHERE d <= 4 GROUP BY 1, 2, 3, 4),
    pi AS (SELECT pose, count(DISTINCT (chain, resnum)) AS n_pipi FROM cp WHERE d <= 5.5 AND le = 'C' AND re = 'C'
        AND resname IN ('PHE', 'TYR', 'TRP', 'HIS') GROUP BY 1)"""


def _sides(t):
    return t.atoms.where("is_ligand"), t.atoms.where("NOT is_ligand")


@query("contacts", CONTACT + " SELECT pose, chain, resnum, resname, distance, type FROM found")
def contacts(t):
    return C.contacts(*_sides(t)).withColumn("pose", F.col("pose"))


@query("pi_residues", CONTACT + " SELECT pose, n_pipi FROM pi")
def pi_residues(t):
    return C.pi_residues(*_sides(t))


@query("contact_summary", CONTACT + """, hp AS (SELECT s_suppkey AS target, CAST(s_suppkey % 5 AS INT) AS pose FROM supplier),
    c AS (SELECT pose, count(*) AS n, count(*) FILTER (WHERE type = 'hbond') AS h, count(*) FILTER (WHERE type = 'hydrophobic') AS y FROM found GROUP BY 1)
    SELECT hp.target, hp.pose, coalesce(n, 0) AS n_contacts, coalesce(h, 0) AS n_hbonds, coalesce(y, 0) AS n_hydrophobic, coalesce(n_pipi, 0) AS n_pipi,
    hp.pose IN (SELECT pose FROM atoms) AS pose_available, CASE WHEN hp.pose NOT IN (SELECT pose FROM atoms) THEN 'pose not found' WHEN coalesce(n, 0) = 0 THEN 'no contacts' ELSE '' END AS note
    FROM hp LEFT JOIN c ON c.pose = hp.pose LEFT JOIN pi ON pi.pose = hp.pose""")
def contact_summary(t):
    ligand, receptor = _sides(t)
    hits = t.targets.select("target", (F.col("target") % 5).cast("int").alias("pose"))
    return C.contact_summary(hits, C.contacts(ligand, receptor), C.pi_residues(ligand, receptor), t.atoms)


@query("residue_centroid", """SELECT pose AS file, count(*) AS n_atoms, round(avg(x), 3) AS center_x, round(avg(y), 3) AS center_y, round(avg(z), 3) AS center_z
    FROM atoms WHERE resname = 'PHE' GROUP BY 1""")
def residue_centroid(t):
    return C.residue_centroid(t.atoms.withColumnRenamed("pose", "file"), "PHE")
