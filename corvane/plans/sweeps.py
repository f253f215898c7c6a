"""Queries over what-if sweeps of trade networks and over channel labels, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import edges as E
from corvane.operators import graph as G
from corvane.operators import labels as L
from corvane.operators import whatif as W
from corvane.plans.network import KEY, _sql, matrix, nodes, r
from corvane.sources import adapters as A

AMOUNTS = [-1.0, -0.5, 0.0, 0.5, 1.0]
_T = [*KEY, "cand"]


def grid(spark, sf) -> DataFrame:
    return W.candidate_grid(A.edge(spark, sf), nodes(spark, sf), AMOUNTS)


def baseline(spark, sf) -> DataFrame:
    """Activation of a node: its weighted out-strength plus one."""
    return G.node_strength(matrix(spark, sf), nodes(spark, sf)).select(*KEY, "node", (F.col("s_out") + 1).alias("x"))


def j10_candidate_grid(spark, sf):
    return grid(spark, sf)


def j02_incident_change(spark, sf):
    m = E.normalise(E.dense(E.sanitise(A.edge(spark, sf)), nodes(spark, sf)))
    m = m.withColumn("w", F.col("w") + 0.001)  # every node has some weight
    c = grid(spark, sf)
    return W.change_statistics(W.incident_change(m, c)).select(*_T, r("mean_abs"), r("top"), r("bottom"), "up", "down", r("relative"))


def _gain(spark, sf):
    return W.log_gain(W.propagation(matrix(spark, sf), "none"), grid(spark, sf), baseline(spark, sf))


def j03_additive_shift(spark, sf):
    return W.additive_shift(W.propagation(matrix(spark, sf), "none"), grid(spark, sf), baseline(spark, sf)).groupBy(*_T).agg(F.round(F.sum("final"), 5).alias("total"), F.round(F.max("clipped"), 6).alias("top"), F.round(F.min("clipped"), 6).alias("low"))


def j04_log_gain(spark, sf):
    return _gain(spark, sf).groupBy(*_T).agg(F.round(F.sum("final"), 5).alias("total"), F.round(F.max("clipped"), 6).alias("top"), F.round(F.min("clipped"), 6).alias("low"))


def j05_activation_ratio(spark, sf):
    return _gain(spark, sf).select(*_T, "to", r("ratio"), r("clipped"))


def j06_j09_coactivation(spark, sf):
    c = W.coactivation(matrix(spark, sf).filter("w > 0"), _gain(spark, sf), 1.0, 0.5)
    return W.change_statistics(c).select(*_T, r("mean_abs"), r("top"), r("bottom"), "up", "down", r("relative"))


def j13_constraints(spark, sf):
    return W.constraint_values(_gain(spark, sf)).select(*_T, r("under"), r("over"), r("violation"), "feasible")


def _scored(spark, sf) -> DataFrame:
    """Two objectives of every candidate: distance of the gained total to the graph's baseline, and size of the amount."""
    g = _gain(spark, sf).groupBy(*_T).agg(F.sum("final").alias("a"), F.sum("x").alias("b"))
    return g.join(grid(spark, sf), _T).select(*_T, "node", "amount", F.round(W.objective(F.col("a"), F.col("b") * 1.05), 9).alias("o1"), F.abs("amount").alias("o2"))


def j12_objectives(spark, sf):
    return _scored(spark, sf).select(*_T, r("o1"), "o2")


def j16_pareto_front(spark, sf):
    return W.pareto_front(_scored(spark, sf), KEY, ["o1", "o2"]).select(*_T, r("o1"), "o2")


def j17_g15_ideal_choice(spark, sf):
    f = W.pareto_front(_scored(spark, sf), KEY, ["o1", "o2"])
    return W.ideal_choice(f, KEY, ["o1", "o2"], k=3).select(*KEY, "rank", "cand", r("distance"), r("strength"))


def j18_weighted_choice(spark, sf):
    return W.weighted_choice(_scored(spark, sf), KEY, {"o1": 0.7, "o2": 0.3}).select(*KEY, "cand", r("score"))


# ---------------------------------------------------------------- labels


def _names(spark, sf) -> DataFrame:
    """Electrode-like labels made of columns of `part`: a prefix of the type and a number of the size."""
    p = A.table(spark, sf, "part")
    stem = F.element_at(F.array(*map(F.lit, ["Fp", "AF", "F", "C", "CP", "P", "O", "T", "Cz", "Fz", "X"])), (F.col("p_partkey") % 11 + 1).cast("int"))
    return p.select("p_partkey", F.concat(F.lit(" "), stem, (F.col("p_size") % 10).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "-REF").otherwise("")).alias("name"))


def b01_b05_label_rules(spark, sf):
    n = F.col("name")
    return _names(spark, sf).select("p_partkey", L.clean_name(n).alias("clean"), L.canonical_name(n).alias("canonical"), L.side(n).alias("side"), L.region(n).alias("region"), L.base_electrode(n).alias("base"))


def b06_homologous_pairs(spark, sf):
    own = _names(spark, sf).select((F.col("p_partkey") % 7).alias("list"), L.clean_name(F.col("name")).alias("channel")).distinct()
    return L.homologous_pairs(own, ["list"])


def b09_b10_display_labels(spark, sf):
    n, a = L.clean_name(F.col("name")), F.when(F.col("p_partkey") % 2 == 0, L.canonical_name(F.col("name")))
    return _names(spark, sf).select("p_partkey", L.display_label(n, a, F.when(F.col("p_partkey") % 5 == 0, F.lit("Node"))).alias("label"))


def b11_contract_failures(spark, sf):
    own = _names(spark, sf).select((F.col("p_partkey") % 50).alias("subject"), L.clean_name(F.col("name")).alias("channel"))
    return L.contract_failures(own, ["subject"])


def a05_consistency(spark, sf):
    c = A.table(spark, sf, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("channel")).distinct()
    return L.inconsistent_subjects(c)


def a05_lacking_channels(spark, sf):
    """Users whose events on some days lack a type that those of the first user have."""
    e = A.table(spark, sf, "events").filter("event_id % 11 < 1 + user_id % 3")
    return L.inconsistent_subjects(e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("channel")).distinct())


def b29_relative_gap(spark, sf):
    c = A.table(spark, sf, "customer")
    return c.select("c_custkey", F.round(E.relative_gap(F.col("c_acctbal"), F.lit(5000.0)), 6).alias("gap"), F.round(F.abs(E.relative_gap(F.col("c_acctbal"), F.lit(0.0))), 6).alias("normalised"))


def b31_b33_polarity(spark, sf):
    c = grid(spark, sf)
    return c.groupBy(*KEY).agg(F.sum((F.col("amount") < -1e-10).cast("long")).alias("suppression"), F.sum((F.col("amount") > 1e-10).cast("long")).alias("enhancement"), F.sum((F.abs("amount") <= 1e-10).cast("long")).alias("zero"), F.round(F.sqrt(F.avg(F.col("amount") ** 2)), 6).alias("rms"))


def b35_composite_key(spark, sf):
    c = A.table(spark, sf, "customer").select("c_custkey", F.concat_ws("::", "c_name", "c_mktsegment").alias("k"))
    s, b = L.split_unit(F.col("k"))
    return c.select("c_custkey", s.alias("subject"), b.alias("band"))


def b36_band_names(spark, sf):
    c = A.table(spark, sf, "customer")
    bands = F.array(F.lit("delta"), F.lit("alpha"), F.lit("beta"))
    return c.select("c_custkey", L.resolve_band(F.when(F.col("c_custkey") % 4 == 0, F.lit("gamma")), (F.col("c_custkey") % 5).cast("int"), bands).alias("band"))


_AMT = "amounts AS (SELECT i::INTEGER AS i, a AS amount FROM (VALUES (0, -1.0::DOUBLE), (1, -0.5::DOUBLE), (2, 0.0::DOUBLE), (3, 0.5::DOUBLE), (4, 1.0::DOUBLE)) v(i, a))"
_CAND = "cands AS (SELECT grp, subject, CAST(n_nationkey * 5 + i AS INTEGER) AS cand, n_nationkey AS node, amount FROM graphs, nation, amounts)"
_BASE = "base AS (SELECT grp, subject, src AS node, sum(w) FILTER (WHERE src <> dst) + 1 AS x FROM matrix GROUP BY ALL)"
_PUSH = "push AS (SELECT c.grp, c.subject, c.cand, c.node, c.amount, b.node AS to_, b.x, CASE WHEN b.node = c.node THEN 1.0 ELSE 0.0 END + 0.75 * CASE WHEN m.src = m.dst THEN 0 ELSE m.w END AS push FROM cands c JOIN base b ON b.grp = c.grp AND b.subject = c.subject JOIN matrix m ON m.grp = c.grp AND m.subject = c.subject AND m.src = b.node AND m.dst = c.node)"


def _shift(final: str) -> str:
    return f"moved AS (SELECT *, {final} AS final_, ({final} + 1e-10) / (x + 1e-10) AS ratio, least(greatest(({final} + 1e-10) / (x + 1e-10), 0.1), 10.0) AS clipped FROM push)"


_GAIN = [_AMT, _CAND, _BASE, _PUSH, _shift("x * exp(amount * push)")]
_STATS = "SELECT grp, subject, cand, round(avg(abs(new - w)), 6) AS mean_abs, round(max(new - w), 6) AS top, round(min(new - w), 6) AS bottom, count(*) FILTER (WHERE new - w > 1e-10) AS up, count(*) FILTER (WHERE new - w < -1e-10) AS down, round(coalesce(avg(abs(new - w) / abs(w)) FILTER (WHERE abs(w) > 1e-10), 0), 6) AS relative FROM "
_SCORED = "scored AS (SELECT grp, subject, cand, amount, round(abs(a - b * 1.05) / CASE WHEN abs(b * 1.05) < 1e-10 THEN 1 ELSE abs(b * 1.05) END, 9) AS o1, abs(amount) AS o2 FROM (SELECT grp, subject, cand, amount, sum(final_) AS a, sum(x) AS b FROM moved GROUP BY ALL))"
_FRONT = "front AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM scored o WHERE o.grp = s.grp AND o.subject = s.subject AND o.o1 <= s.o1 AND o.o2 <= s.o2 AND (o.o1 < s.o1 OR o.o2 < s.o2)))"
_STEMS = "['Fp', 'AF', 'F', 'C', 'CP', 'P', 'O', 'T', 'Cz', 'Fz', 'X']"
_NAMES = f"names AS (SELECT p_partkey, {_STEMS}[p_partkey % 11 + 1] || (p_size % 10)::VARCHAR AS clean FROM part)"
_CANON = "CASE clean WHEN 'T3' THEN 'T7' WHEN 'T4' THEN 'T8' WHEN 'T5' THEN 'P7' WHEN 'T6' THEN 'P8' ELSE clean END"
_DIGITS = "regexp_replace(clean, '[^0-9]', '', 'g')"
SQL = {
    "j10_candidate_grid": _sql("SELECT * FROM cands", _AMT, _CAND),
    "j02_incident_change": _sql(_STATS + "chg GROUP BY grp, subject, cand", _AMT, _CAND, "chg AS (SELECT grp, subject, cand, w, w + CASE WHEN hit THEN amount * w / sum(CASE WHEN hit THEN w ELSE 0 END) OVER (PARTITION BY grp, subject, cand) ELSE 0 END AS new FROM (SELECT c.*, m.w + 0.001 AS w, m.src = c.node OR m.dst = c.node AS hit FROM cands c JOIN matrix m USING (grp, subject) WHERE m.src <> m.dst))"),
    "j03_additive_shift": _sql("SELECT grp, subject, cand, round(sum(final_), 5) AS total, round(max(clipped), 6) AS top, round(min(clipped), 6) AS low FROM moved GROUP BY ALL", _AMT, _CAND, _BASE, _PUSH, _shift("(x + amount * push)")),
    "j04_log_gain": _sql("SELECT grp, subject, cand, round(sum(final_), 5) AS total, round(max(clipped), 6) AS top, round(min(clipped), 6) AS low FROM moved GROUP BY ALL", *_GAIN),
    "j05_activation_ratio": _sql('SELECT grp, subject, cand, to_ AS "to", round(ratio, 6) AS ratio, round(clipped, 6) AS clipped FROM moved', *_GAIN),
    "j06_j09_coactivation": _sql(_STATS + "(SELECT a.grp, a.subject, a.cand, n.w, n.w + 0.5 * (n.w * a.clipped * b.clipped - n.w) AS new FROM net n JOIN moved a ON a.grp = n.grp AND a.subject = n.subject AND a.to_ = n.src JOIN moved b ON b.grp = n.grp AND b.subject = n.subject AND b.to_ = n.dst AND a.cand = b.cand) GROUP BY grp, subject, cand", *_GAIN),
    "j13_constraints": _sql("SELECT grp, subject, cand, round(u, 6) AS under, round(o, 6) AS over, round(greatest(u, 0) + greatest(o, 0), 6) AS violation, greatest(u, 0) + greatest(o, 0) <= 1e-10 AS feasible FROM (SELECT grp, subject, cand, 0.1 - min(ratio) AS u, max(ratio) - 10.0 AS o FROM moved GROUP BY ALL)", *_GAIN),
    "j12_objectives": _sql("SELECT grp, subject, cand, round(o1, 6) AS o1, o2 FROM scored", *_GAIN, _SCORED),
    "j16_pareto_front": _sql("SELECT grp, subject, cand, round(o1, 6) AS o1, o2 FROM front", *_GAIN, _SCORED, _FRONT),
    "j17_g15_ideal_choice": _sql("SELECT grp, subject, CAST(k AS INTEGER) AS rank, cand, round(d, 6) AS distance, round(1.0 / k, 6)::DOUBLE AS strength FROM (SELECT *, row_number() OVER (PARTITION BY grp, subject ORDER BY d, cand) AS k FROM (SELECT *, round(sqrt(o1 * o1 + o2 * o2), 9) AS d FROM front)) WHERE k <= 3", *_GAIN, _SCORED, _FRONT),
    "j18_weighted_choice": _sql("SELECT grp, subject, cand, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp, subject ORDER BY s, cand) AS k FROM (SELECT *, round(0.7 * o1 + 0.3 * o2, 9) AS s FROM scored)) WHERE k = 1", *_GAIN, _SCORED),
    "b01_b05_label_rules": f"WITH {_NAMES} SELECT p_partkey, clean, {_CANON} AS canonical, CASE WHEN {_DIGITS} = '' THEN 'M' WHEN right({_DIGITS}, 1)::INT % 2 = 1 THEN 'L' ELSE 'R' END AS side, CASE WHEN upper(clean) LIKE 'FP%' OR upper(clean) LIKE 'AF%' OR upper(clean) LIKE 'F%' THEN 'frontal' WHEN upper(clean) LIKE 'CP%' OR upper(clean) LIKE 'P%' THEN 'parietal' WHEN upper(clean) LIKE 'O%' THEN 'occipital' WHEN upper(clean) LIKE 'T%' THEN 'temporal' WHEN upper(clean) LIKE 'C%' THEN 'central' ELSE 'other' END AS region, upper(clean) AS base FROM names",
    "b06_homologous_pairs": f"WITH {_NAMES}, own AS (SELECT DISTINCT p_partkey % 7 AS list, clean AS channel, upper(regexp_replace(clean, '[0-9]+$', '')) AS stem, regexp_extract(clean, '[0-9]+$')::INT AS num FROM names) SELECT a.list, a.channel, b.channel AS mirror FROM own a JOIN own b ON a.list = b.list AND a.stem = b.stem AND b.num = a.num + CASE WHEN a.num % 2 = 1 THEN 1 ELSE -1 END",
    "b09_b10_display_labels": f"WITH {_NAMES} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Node' WHEN p_partkey % 2 = 0 THEN clean || '/' || {_CANON} ELSE clean END AS label FROM names",
    "b11_contract_failures": f"WITH {_NAMES} SELECT p_partkey % 50 AS subject, count(*) AS n, count(DISTINCT clean) AS n_distinct FROM names GROUP BY ALL HAVING count(*) <> count(DISTINCT clean)",
    "a05_lacking_channels": "WITH l AS (SELECT user_id AS subject, string_agg(event_type, ',' ORDER BY event_type) AS names, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 11 < 1 + user_id % 3) GROUP BY user_id) SELECT subject, n FROM l WHERE names <> (SELECT arg_min(names, subject) FROM l)",
    "a05_consistency": "WITH l AS (SELECT user_id AS subject, string_agg(event_type, ',' ORDER BY event_type) AS names, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id) SELECT subject, n FROM l WHERE names <> (SELECT arg_min(names, subject) FROM l)",
    "b29_relative_gap": "SELECT c_custkey, round((c_acctbal - 5000) / 5000, 6) AS gap, round(abs(c_acctbal), 6) AS normalised FROM customer",
    "b31_b33_polarity": _sql("SELECT grp, subject, count(*) FILTER (WHERE amount < -1e-10) AS suppression, count(*) FILTER (WHERE amount > 1e-10) AS enhancement, count(*) FILTER (WHERE abs(amount) <= 1e-10) AS zero, round(sqrt(avg(amount * amount)), 6) AS rms FROM cands GROUP BY ALL", _AMT, _CAND),
    "b35_composite_key": "SELECT c_custkey, c_name AS subject, c_mktsegment AS band FROM customer",
    "b36_band_names": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'gamma' ELSE ['delta', 'alpha', 'beta'][c_custkey % 5 + 1] END AS band FROM customer",
}
QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "abj" and k[1:3].isdigit() and callable(v)}
