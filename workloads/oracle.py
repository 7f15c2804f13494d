"""SQL twins of the registered queries, for DuckDB over the same Parquet tables.

The statements are written from the definition of each operator, not from its
Spark plan: plain windows and joins where Spark uses cutoffs and partial counts.
"""

from __future__ import annotations

import re
from itertools import combinations
from statistics import NormalDist

from . import bindings as b

ORACLE: dict[str, str] = {}


def lit(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# ---- shared table expressions; a statement gets those it names, in dependency order ------

CTE: dict[str, str] = {}


def sql(body: str) -> str:
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in CTE:
            if name not in seen and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                seen.add(name)
                visit(CTE[name])
                needed.append(name)

    visit(body)
    body = body.strip()
    head = ",\n".join(f"{n} AS ({CTE[n].strip()})" for n in needed)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def hashed_split(name: str, source: str, grp: str, reps: list[int], fraction: float) -> None:
    rep_list = f"(SELECT unnest([{', '.join(map(str, reps))}]) AS rep)"
    CTE[f"{name}_cut"] = f"""
      SELECT rep, max(h) AS cutoff FROM (
        SELECT rep, h, row_number() OVER (PARTITION BY rep ORDER BY h) AS pos, count(*) OVER (PARTITION BY rep) AS n
        FROM (SELECT DISTINCT r.rep, md5((r.rep + {b.SEED})::VARCHAR || ':' || s.{grp}::VARCHAR) AS h
              FROM {source} s, {rep_list} r))
      WHERE pos <= ceil({fraction}::DOUBLE * n) GROUP BY rep"""
    CTE[name] = f"""
      SELECT s.*, c.rep::INT AS rep, md5((c.rep + {b.SEED})::VARCHAR || ':' || s.{grp}::VARCHAR) <= c.cutoff AS is_test
      FROM {source} s, {name}_cut c"""


CTE["crops"] = """
  SELECT event_id, user_id, ts, event_type AS class, stem AS grp,
    'crops/' || event_type || '/' || stem || '_ann' || event_id || '.jpg' AS item_id,
    CASE WHEN user_id % 37 = 0 THEN 'Unassigned' ELSE 'Zone ' || chr((65 + user_id % 12 % 6)::INT) END AS zone
  FROM (SELECT *, (CASE WHEN user_id % 37 = 0 THEN 'scan_' ELSE 'batch_' END) || (user_id % 12 + 1) || '_'
               || lpad(user_id::VARCHAR, 6, '0') AS stem FROM events)"""
hashed_split("crop_split", "crops", "grp", b.REPS, b.FRACTION)
CTE["heads"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{c}', {r})" for a, c, r in b.HEADS) + ") AS t(arm, clf, rate)"
_next = " ".join(f"WHEN '{c}' THEN '{b.CLASSES[(i + 1) % 5]}'" for i, c in enumerate(b.CLASSES))
CTE["pred"] = f"""
  SELECT rep, arm, clf, item_id, grp, event_id, class AS y_true,
    CASE WHEN ('0x' || substr(md5(event_id || ':' || rep || ':' || arm || ':' || clf), 1, 4))::INT < rate
         THEN CASE class {_next} END ELSE class END AS y_pred
  FROM crop_split, heads WHERE is_test"""
CTE["one_head"] = "SELECT * FROM pred WHERE arm = 'D_qubo' AND clf = 'rbf_svm'"
CTE["tally"] = "SELECT item_id, y_pred, count(*) AS votes, min(rep) AS first_rep FROM one_head GROUP BY ALL"
CTE["voted"] = """
  SELECT item_id, y_pred AS class, votes, total_votes, votes / total_votes AS agreement FROM (
    SELECT *, sum(votes) OVER (PARTITION BY item_id)::BIGINT AS total_votes,
      row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, first_rep) AS pos FROM tally) WHERE pos = 1"""

# ---- severity index -----------------------------------------------------------------------


def wilson(s: str, n: str, z: float, side: str) -> str:
    zz = repr(z * z) + "::DOUBLE"
    p = f"(({s})::DOUBLE / ({n}))"
    spread = f"({z!r}::DOUBLE * sqrt(({p} * (1 - {p}) + {zz} / (4 * ({n})::DOUBLE)) / ({n})::DOUBLE))"
    centre = f"({p} + {zz} / (2 * ({n})::DOUBLE))"
    scale = f"(1 + {zz} / ({n})::DOUBLE)"
    if side == "lo":
        return f"greatest(0::DOUBLE, ({centre} - {spread}) / {scale})"
    return f"least(1::DOUBLE, ({centre} + {spread}) / {scale})"


def zone_ctes(prefix: str, source: str, weights: dict[str, float], clean: list[str], agreement: str = "NULL::DOUBLE") -> None:
    z = NormalDist().inv_cdf(1 - 0.05 / (2 * len(weights)))
    counts = ", ".join(f"count(*) FILTER (class = '{c}')::BIGINT AS \"{c}\"" for c in weights)
    worst = "greatest(" + ", ".join(f'"{c}" * {w!r}::DOUBLE' for c, w in weights.items()) + ")"
    CTE[f"{prefix}_raw"] = f"""
      SELECT zone, count(*)::BIGINT AS total, count(*) FILTER (class IN ({lit(clean)}))::BIGINT AS clean,
        avg({agreement}) AS agreement, {counts} FROM {source} GROUP BY zone"""
    CTE[f"{prefix}_peak"] = f"""
      SELECT *, total - clean AS dirty, {worst} AS worst,
        (SELECT CASE WHEN max({worst}) > 0 THEN max({worst}) ELSE 1 END FROM {prefix}_raw) AS peak FROM {prefix}_raw"""
    bound = lambda side: "greatest(" + ", ".join(
        f"total * {wilson(chr(34) + c + chr(34), 'total', z, side)} * {w!r}::DOUBLE / peak * 500" for c, w in weights.items()
    ) + ")"
    CTE[f"{prefix}_index"] = f"""
      SELECT *, greatest(0, least(500, round_even(worst / peak * 500::DOUBLE, 0)))::BIGINT AS psi,
        greatest(0, least(500, floor({bound('lo')})))::BIGINT AS psi_lo,
        greatest(0, least(500, ceil({bound('hi')})))::BIGINT AS psi_hi FROM {prefix}_peak"""
    band = "CASE WHEN psi <= 50 THEN 'Good' WHEN psi <= 100 THEN 'Moderate' WHEN psi <= 200 THEN 'Unhealthy' WHEN psi <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"
    names = ", ".join(f'"{c}"' for c in weights)
    CTE[prefix] = f"""
      SELECT zone, total, clean, dirty, round_even(clean / total * 100, 1) AS cleanliness, psi, {band} AS band,
        '[' || psi_lo || '-' || psi_hi || ']' AS psi_ci, psi_lo, psi_hi,
        round({wilson('dirty', 'total', 1.96, 'lo')}, 3) AS dirty_rate_lo,
        round({wilson('dirty', 'total', 1.96, 'hi')}, 3) AS dirty_rate_hi,
        round(agreement, 3) AS vote_agreement, {names} FROM {prefix}_index"""


zone_ctes("zt_items", "crops", b.WEIGHTS, b.CLEAN)
CTE["voted_zone"] = """
  SELECT v.*, CASE WHEN regexp_matches(v.item_id, '/batch_[0-9]+_[^/]*$')
    THEN 'Zone ' || chr((65 + (regexp_extract(v.item_id, '/batch_([0-9]+)_[^/]*$', 1)::INT - 1) % 6)::INT)
    ELSE 'Unassigned' END AS zone FROM voted v"""
zone_ctes("zt_votes", "voted_zone", b.WEIGHTS, b.CLEAN, "agreement")
CTE["doc_zone"] = "SELECT source AS zone, lang AS class FROM documents"
zone_ctes("zt_docs", "doc_zone", {"en": 1.0, "de": 3.0, "es": 0.8, "fr": 0.5}, ["en", "es", "fr"])

ORACLE["zone_table"] = sql("SELECT * FROM zt_items")
ORACLE["live_zone_table"] = ORACLE["zone_table"]
ORACLE["severity_from_votes"] = sql("SELECT * FROM zt_votes")
ORACLE["zone_table_by_source"] = sql("SELECT * FROM zt_docs")
ORACLE["zone_counts"] = sql(
    "SELECT zone, " + ", ".join(f"count(*) FILTER (class = '{c}')::BIGINT AS {c}" for c in b.CLASSES) + " FROM crops GROUP BY zone"
)
ORACLE["zone_composition"] = sql(
    " UNION ALL ".join(f"SELECT zone, '{c}' AS class, {c} AS n, round({c} / total * 100, 1) AS pct FROM zt_items" for c in b.CLASSES)
)
ORACLE["city_kpis"] = sql("""
  SELECT round_even(sum(clean) / sum(total) * 100, 1) AS cleanliness, arg_min(zone, (-psi, zone)) AS worst_zone,
    max(psi) AS worst_psi, arg_min(band, (-psi, zone)) AS worst_band, sum(total)::BIGINT AS total_items, count(*) AS zone_count
  FROM zt_votes""")
ORACLE["weighted_agreement"] = sql(
    "SELECT round(sum(vote_agreement * total) / sum(total), 6) AS agreement FROM zt_votes WHERE vote_agreement IS NOT NULL"
)
ORACLE["unsupported_classes"] = sql("SELECT class, count(*) AS n FROM crops WHERE class NOT IN ('error', 'view') GROUP BY class")
ORACLE["wilson_bounds"] = f"""
  SELECT quality, s, n, round({wilson('s', 'n', 1.96, 'lo')}, 6) AS lo, round({wilson('s', 'n', 1.96, 'hi')}, 6) AS hi
  FROM (SELECT quality, sum(toxic)::BIGINT AS s, count(*) AS n FROM labels GROUP BY quality)"""
ORACLE["zones_and_groups"] = sql("""
  SELECT event_id, grp, zone AS zone_batch, CASE WHEN user_id % 3 = 0 THEN 'Zone N' ELSE 'Unassigned' END AS zone_folder,
    CASE WHEN user_id % 4 = 0 THEN 'Dock' ELSE zone END AS zone FROM crops""")

# ---- votes and metrics ------------------------------------------------------------------------

ORACLE["count_votes"] = sql("SELECT * FROM tally")
ORACLE["majority_vote"] = sql("SELECT item_id, class, votes, total_votes, round(agreement, 6) AS agreement FROM voted")
ORACLE["vote_agreement"] = sql("SELECT round(avg(agreement), 6) AS agreement FROM voted")
ORACLE["accuracy"] = sql(
    "SELECT rep, arm, clf, round(avg((y_true = y_pred)::INT), 6) AS accuracy, count(*) AS n_items FROM pred GROUP BY ALL"
)
CTE["label_use"] = """
  SELECT rep, arm, clf, label, sum(tp) AS tp, sum(s) AS s, sum(p) AS p FROM (
    SELECT rep, arm, clf, y_true AS label, (y_true = y_pred)::INT AS tp, 1 AS s, 0 AS p FROM pred
    UNION ALL SELECT rep, arm, clf, y_pred, 0, 0, 1 FROM pred) GROUP BY ALL"""
CTE["scored"] = """
  SELECT a.rep, a.arm, a.clf, a.accuracy, f.macro_f1 FROM
    (SELECT rep, arm, clf, avg((y_true = y_pred)::INT) AS accuracy FROM pred GROUP BY ALL) a
    JOIN (SELECT rep, arm, clf, avg(2 * tp / (s + p)) AS macro_f1 FROM label_use GROUP BY ALL) f USING (rep, arm, clf)"""
ORACLE["macro_f1"] = sql("SELECT rep, arm, clf, round(macro_f1, 6) AS macro_f1 FROM scored")
ORACLE["macro_f1_fixed_labels"] = sql("""
  SELECT rep, arm, clf, round(sum(CASE WHEN label IN ('click', 'error', 'spam', 'view') THEN 2 * tp / (s + p) ELSE 0 END) / 4, 6) AS macro_f1
  FROM label_use GROUP BY ALL""")
ORACLE["score"] = sql("SELECT rep, arm, clf, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM scored")


def grid(classes: list[str]) -> str:
    names = f"(SELECT unnest([{lit(classes)}]) AS c)"
    return f"""
      SELECT k.clf, t.c AS y_true, p.c AS y_pred, count(q.y_true) AS n
      FROM (SELECT DISTINCT clf FROM pred) k, {names} t, {names} p
      LEFT JOIN pred q ON q.clf = k.clf AND q.y_true = t.c AND q.y_pred = p.c GROUP BY ALL"""


ORACLE["confusion"] = sql(grid(["click", "error", "spam", "view"]))
ORACLE["confusion_normalised"] = sql(f"""
  SELECT clf, y_true, y_pred, n, round(n / greatest(sum(n) OVER (PARTITION BY clf, y_true), 1), 6) AS share FROM ({grid(b.CLASSES)})""")
ORACLE["confusion_wide"] = sql(
    "SELECT clf, y_true, " + ", ".join(f"count(*) FILTER (y_pred = '{c}') AS {c}" for c in b.CLASSES) + " FROM pred GROUP BY ALL"
)
CTE["class_scores"] = f"""
  SELECT k.rep, k.arm, k.clf, c.class, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(s, 0), 0) AS recall,
    coalesce(2 * tp / nullif(s + p, 0), 0) AS f1, coalesce(s, 0)::BIGINT AS support
  FROM (SELECT DISTINCT rep, arm, clf FROM pred) k, (SELECT unnest([{lit([*b.CLASSES, 'spam'])}]) AS class) c
  LEFT JOIN label_use u ON u.rep = k.rep AND u.arm = k.arm AND u.clf = k.clf AND u.label = c.class"""
ORACLE["per_class_metrics"] = sql(
    "SELECT rep, arm, clf, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM class_scores"
)
ORACLE["per_class_summary"] = sql("""
  SELECT class, clf, round(avg(precision), 3) AS precision, round(avg(recall), 3) AS recall, round(avg(f1), 3) AS f1,
    round(avg(support), 3) AS support FROM class_scores WHERE arm = 'D_qubo' AND class <> 'spam' GROUP BY ALL""")
CTE["summed"] = """
  SELECT arm, clf, round(avg(accuracy), 4) AS accuracy_mean, round(stddev_samp(accuracy), 4) AS accuracy_std,
    round(avg(macro_f1), 4) AS macro_f1_mean, round(stddev_samp(macro_f1), 4) AS macro_f1_std FROM scored GROUP BY ALL"""
ORACLE["summary"] = sql("SELECT * FROM summed")
ORACLE["label_parity"] = sql("""
  SELECT round(avg((a.y_pred = c.y_pred)::INT), 6) AS agreement, count(*) AS n, avg((a.y_pred = c.y_pred)::INT) >= 0.999 AS ok
  FROM pred a JOIN pred c USING (item_id) WHERE a.arm = 'Z_full' AND a.rep = 0 AND a.clf = 'rbf_svm'
    AND c.arm = 'Z_full' AND c.rep = 0 AND c.clf = 'linear_svm'""")
CTE["shots_half"] = """
  SELECT i, j, count(*) FILTER (q = 0) / count(*) AS k, count(*) AS shots FROM (
    SELECT least(l_linenumber, l_suppkey % 7 + 1)::INT AS i, greatest(l_linenumber, l_suppkey % 7 + 1)::INT AS j,
      l_quantity::BIGINT % 4 AS q FROM lineitem) GROUP BY i, j"""
CTE["shots"] = "SELECT i, j, k, shots FROM shots_half UNION ALL SELECT j, i, k, shots FROM shots_half WHERE i <> j"
ORACLE["overlap_matrix"] = sql("SELECT i, j, round(k, 6) AS k, shots FROM shots")


def alignment(pairs: str) -> str:
    """Doubly centred inner product of k and t over a full table (i, j, k, t)."""
    return f"""
      SELECT round(sum(a * c) / (sqrt(sum(a * a)) * sqrt(sum(c * c))), 6) AS alignment FROM (
        SELECT k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS a,
               t - avg(t) OVER (PARTITION BY i) - avg(t) OVER (PARTITION BY j) + avg(t) OVER () AS c
        FROM ({pairs}))"""


ORACLE["kernel_alignment"] = sql(alignment("SELECT i, j, k, (i % 2 = j % 2)::INT::DOUBLE AS t FROM shots"))
ORACLE["linear_alignment"] = alignment("""
  SELECT x.vec_id AS i, y.vec_id AS j, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS k, (x.label = y.label)::INT::DOUBLE AS t
  FROM embeddings x, embeddings y""")

# ---- significance ---------------------------------------------------------------------------------

CTE["diffs"] = "\nUNION ALL ".join(
    f"SELECT clf, rep, '{x}' AS arm_a, '{y}' AS arm_b, x.accuracy - y.accuracy AS diff FROM scored x JOIN scored y USING (clf, rep) WHERE x.arm = '{x}' AND y.arm = '{y}'"
    for x, y in combinations(["A_random", "C_mi", "D_qubo", "Z_full"], 2)
)
ORACLE["paired_diffs"] = sql("SELECT clf, rep, arm_a, arm_b, round(diff, 6) + 0 AS diff FROM diffs")
CTE["ranked"] = """
  SELECT *, rank() OVER (PARTITION BY clf, arm_a, arm_b ORDER BY a) + (count(*) OVER (PARTITION BY clf, arm_a, arm_b, a) - 1) / 2 AS r,
    count(*) OVER (PARTITION BY clf, arm_a, arm_b, a) AS t
  FROM (SELECT *, round(abs(diff), 12) AS a FROM diffs) WHERE a > 0"""
CTE["ranks"] = """
  SELECT z.clf, z.arm_a, z.arm_b, zeros, coalesce(n, 0) AS n, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus, coalesce(ties, 0) AS ties
  FROM (SELECT clf, arm_a, arm_b, count(*) FILTER (round(abs(diff), 12) = 0) AS zeros FROM diffs GROUP BY ALL) z
  LEFT JOIN (SELECT clf, arm_a, arm_b, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w_plus,
    sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS w_minus, sum(t * t - 1)::DOUBLE AS ties FROM ranked GROUP BY ALL) USING (clf, arm_a, arm_b)"""
ORACLE["signed_rank"] = sql("SELECT * FROM ranks")
CTE["t_stats"] = """
  SELECT clf, arm_a, arm_b, count(*) AS pairs, avg(diff) AS mean_diff,
    CASE WHEN count(*) >= 2 AND stddev_samp(diff) > 0 THEN avg(diff) / (stddev_samp(diff) / sqrt(count(*))) END AS t
  FROM diffs GROUP BY ALL"""
ORACLE["paired_t"] = sql("SELECT clf, arm_a, arm_b, pairs, round(mean_diff, 6) + 0 AS mean_diff, round(t, 6) + 0 AS t FROM t_stats")


def step_down(p: str, order: str, family: str = "") -> str:
    part = f"PARTITION BY {family}" if family else ""
    return (
        f"least(1, max(({p}) * left_over) OVER ({part} ORDER BY {p}, {order} ROWS UNBOUNDED PRECEDING))",
        f"count(*) OVER ({part}) - row_number() OVER ({part} ORDER BY {p}, {order}) + 1",
    )


_adj, _left = step_down("p", "rep, arm, clf", "clf")
ORACLE["holm"] = sql(f"""
  SELECT rep, arm, clf, p, round({_adj}, 9) AS adjusted FROM (
    SELECT *, {_left} AS left_over FROM (SELECT rep, arm, clf, round((1 - accuracy) / 20, 9) AS p FROM scored))""")
# p of the signed-rank sum by listing all 2^n sign patterns (n <= 5 repeats); two-sided t tail with 4 degrees of freedom in closed form
_bits = " + ".join(f"((m >> {i}) & 1) * {i + 1}" for i in range(5))
_w = step_down("wp", "clf, arm_a, arm_b")
_t = step_down("tp", "clf, arm_a, arm_b")
ORACLE["paired_significance"] = sql(f"""
  WITH tail AS (
    SELECT r.clf, r.arm_a, r.arm_b, s.mean_diff, r.ties, r.zeros,
      CASE WHEN r.ties = 0 AND r.zeros = 0 THEN
        least(1, 2 * (SELECT count(*) FROM range(32) g(m) WHERE m < (1 << r.n) AND {_bits} <= least(r.w_plus, r.w_minus)) / (1 << r.n)) END AS wp,
      CASE WHEN s.t IS NULL THEN 1 ELSE 1 - 2 * (0.375 * abs(s.t) / sqrt(1 + s.t * s.t / 4) * (1 - s.t * s.t / (12 * (1 + s.t * s.t / 4)))) END AS tp
    FROM ranks r JOIN t_stats s USING (clf, arm_a, arm_b)),
  w AS (SELECT clf, arm_a, arm_b, {_w[0]} AS w FROM (SELECT *, {_w[1]} AS left_over FROM tail)),
  t AS (SELECT clf, arm_a, arm_b, {_t[0]} AS t FROM (SELECT *, {_t[1]} AS left_over FROM tail))
  SELECT clf, arm_a, arm_b, round(mean_diff, 4) AS mean_diff, round(w, 4) AS wilcoxon_p_holm, round(t, 4) AS paired_t_p_holm,
    w < 0.05 AS significant, CASE WHEN ties = 0 AND zeros = 0 THEN 'exact' ELSE 'normal' END AS wilcoxon_method
  FROM tail JOIN w USING (clf, arm_a, arm_b) JOIN t USING (clf, arm_a, arm_b)""")
ORACLE["duplicate_results"] = sql("SELECT clf, arm, rep, 2::BIGINT AS n FROM scored WHERE rep % 3 = 0")
ORACLE["converged"] = sql("""
  SELECT rep, round(accuracy, 6) AS accuracy, round(spread, 6) + 0 AS spread, pos >= 3 AND spread <= 0.02 AS stop FROM (
    SELECT rep, accuracy, max(accuracy) OVER w - min(accuracy) OVER w AS spread, row_number() OVER (ORDER BY rep) AS pos
    FROM scored WHERE arm = 'D_qubo' AND clf = 'rbf_svm' WINDOW w AS (ORDER BY rep ROWS 2 PRECEDING))""")
ORACLE["separation"] = sql("""
  WITH m AS (SELECT arm, avg(accuracy) AS m FROM scored WHERE clf = 'rbf_svm' GROUP BY arm),
  g AS (SELECT arm, abs(m - (SELECT m FROM m WHERE arm = 'D_qubo')) AS g FROM m WHERE arm <> 'D_qubo')
  SELECT arm, round(g, 6) AS mean_gap, CASE WHEN g > 0.05 THEN 'separated' ELSE 'tied' END AS structure FROM g""")
ORACLE["metric_violations"] = sql("""
  SELECT 'E_lasso' AS arm, clf, NULL::INT AS rep, 'missing' AS problem FROM scored GROUP BY clf
  UNION ALL SELECT arm, clf, rep, 'range' FROM scored WHERE rep = 2 AND accuracy + 1 > 1""")

# ---- golden comparison ------------------------------------------------------------------------------

CTE["golden"] = """
  SELECT arm, classifier, metric, baseline, produced, delta, tolerance,
    CASE WHEN baseline IS NULL THEN 'NO_BASELINE' WHEN produced IS NULL THEN 'MISSING' WHEN abs(delta) <= tolerance THEN 'OK' ELSE 'MISMATCH' END AS status,
    CASE WHEN baseline IS NOT NULL THEN coalesce(abs(delta) <= tolerance, false) END AS ok
  FROM (
    SELECT *, produced - baseline AS delta,
      CASE WHEN produced IS NOT NULL AND baseline IS NOT NULL THEN CASE WHEN s IS NULL THEN 0 ELSE 1.5::DOUBLE * CASE WHEN s > 0 THEN s ELSE 0.01::DOUBLE END END END AS tolerance
    FROM (
      SELECT arm, clf AS classifier, metric, std AS s,
        CASE WHEN arm <> 'A_random' THEN mean END AS produced,
        CASE WHEN arm <> 'Z_full' AND NOT (clf = 'linear_svm' AND metric = 'macro_f1')
             THEN round(mean, 2) + CASE WHEN metric = 'macro_f1' THEN 0.05::DOUBLE ELSE 0::DOUBLE END END AS baseline
      FROM (SELECT arm, clf, 'accuracy' AS metric, accuracy_mean AS mean, accuracy_std AS std FROM summed
            UNION ALL SELECT arm, clf, 'macro_f1', macro_f1_mean, macro_f1_std FROM summed)))"""
ORACLE["golden_compare"] = sql("""
  SELECT arm, classifier, metric, round(baseline, 4) AS baseline, round(produced, 4) AS produced, round(delta, 4) + 0 AS delta,
    round(tolerance, 4) AS tolerance, status, ok FROM golden""")
ORACLE["golden_verdict"] = sql("""
  SELECT count(ok) AS comparable, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS skipped,
    (SELECT concat_ws('/', arm, classifier, metric) FROM golden WHERE NOT ok ORDER BY arm, classifier, metric LIMIT 1) AS first_failure,
    (SELECT round(delta, 4) + 0 FROM golden WHERE NOT ok ORDER BY arm, classifier, metric LIMIT 1) AS first_delta,
    CASE WHEN count(*) FILTER (NOT ok) = 0 AND count(ok) > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM golden""")
ORACLE["version_drift"] = """
  SELECT worker, package, expected, actual, CASE WHEN NOT listed THEN 'missing' WHEN actual IS NULL THEN 'not-installed' ELSE 'mismatch' END AS kind FROM (
    SELECT s_suppkey AS worker, package, '1.' || (length(package) % 2) AS expected, listed,
      CASE WHEN listed AND s_suppkey % 9 <> 1 THEN '1.' || ((length(package) + (s_suppkey % 4 = 0)::INT) % 2) END AS actual
    FROM (SELECT *, NOT (s_suppkey % 10 = 2 AND package = 'scipy') AS listed
          FROM supplier, (SELECT unnest(['numpy', 'pandas', 'scipy']) AS package)))
  WHERE actual IS NULL OR actual <> expected"""
ORACLE["config_drift"] = """
  WITH f AS (SELECT c_custkey AS run, path, CASE path WHEN 'seed' THEN '42' WHEN 'arms' THEN '["A", "B"]' ELSE '8' END AS expected
             FROM customer, (SELECT unnest(['seed', 'selection.k', 'arms']) AS path)),
  a AS (SELECT run, CASE WHEN path = 'selection.k' AND run % 17 = 0 THEN 'selection.q' ELSE path END AS path,
          CASE WHEN path = 'seed' AND run % 7 = 0 THEN '43' WHEN path = 'arms' AND run % 11 = 0 THEN '["B", "A"]' ELSE expected END AS got
        FROM f WHERE NOT (path = 'selection.k' AND run % 13 = 0))
  SELECT run, path, expected, got, CASE WHEN expected IS NULL THEN 'unknown' WHEN got IS NULL THEN 'absent' ELSE 'differs' END AS kind
  FROM f FULL JOIN a USING (run, path) WHERE expected IS NULL OR got IS NULL OR expected <> got"""
CTE["plan_cells"] = """
  SELECT c_custkey AS run, depth, entanglement, budget FROM customer, (SELECT unnest([1, 2, 3]) AS depth),
    (SELECT unnest(['linear', 'full']) AS entanglement), (SELECT unnest([4, 6, 8, 12]) AS budget)"""
CTE["ledger"] = """
  SELECT o_custkey AS run, (o_orderkey % 3 + 1)::INT AS depth, CASE WHEN o_orderkey % 2 = 0 THEN 'linear' ELSE 'full' END AS entanglement,
    ([4, 6, 8, 12])[o_orderkey % 4 + 1] AS budget, min(o_orderstatus) AS payload FROM orders GROUP BY ALL"""
ORACLE["pending_cells"] = sql("""
  SELECT p.*, CASE WHEN l.run IS NULL THEN 'run' ELSE 'reused' END AS state
  FROM plan_cells p LEFT JOIN ledger l USING (run, depth, entanglement, budget)""")
ORACLE["pending_cells_limited"] = sql("""
  WITH s AS (SELECT l.run IS NOT NULL AS done FROM plan_cells p LEFT JOIN ledger l USING (run, depth, entanglement, budget))
  SELECT 'reused' AS state, count(*) AS n FROM s WHERE done UNION ALL SELECT 'run', 24::BIGINT
  UNION ALL SELECT 'remaining', count(*) - 24 FROM s WHERE NOT done""")
ORACLE["append_new"] = sql("""
  SELECT run, depth, entanglement, budget, CASE WHEN run % 2 = 0 THEN 'F' ELSE 'O' END AS payload
  FROM plan_cells p ANTI JOIN ledger l USING (run, depth, entanglement, budget)""")
ORACLE["append_conflicts"] = sql("""
  SELECT p.* FROM plan_cells p JOIN ledger l USING (run, depth, entanglement, budget)
  WHERE payload <> CASE WHEN run % 2 = 0 THEN 'F' ELSE 'O' END""")
ORACLE["write_new_ledger"] = sql("""
  SELECT payload, count(*) AS n FROM (SELECT payload FROM ledger UNION ALL
    SELECT 'new' FROM plan_cells p ANTI JOIN ledger l USING (run, depth, entanglement, budget)) GROUP BY payload""")
ORACLE["arm_labels"] = sql("""
  SELECT CASE arm WHEN 'Z_full' THEN 'Full-50' ELSE base || '-8' END AS label, CASE arm WHEN 'Z_full' THEN 'Full-50' ELSE base END AS base, n FROM (
    SELECT arm, CASE arm WHEN 'A_random' THEN 'Random' WHEN 'C_mi' THEN 'MI' WHEN 'D_qubo' THEN 'QUBO' END AS base, count(*) AS n FROM pred GROUP BY arm)""")

# ---- splits --------------------------------------------------------------------------------------------

ORACLE["group_split"] = sql("SELECT rep, grp, is_test, count(*) AS n FROM crop_split GROUP BY ALL")
CTE["leaky"] = "SELECT * REPLACE (CASE WHEN event_id % 101 = 0 THEN NOT is_test ELSE is_test END AS is_test) FROM crop_split"
ORACLE["group_overlap"] = sql("SELECT rep, grp FROM leaky GROUP BY ALL HAVING bool_or(is_test) AND NOT bool_and(is_test)")
ORACLE["shared_groups"] = sql("SELECT grp FROM leaky WHERE rep = 1 GROUP BY grp HAVING bool_or(is_test) AND NOT bool_and(is_test)")
CTE["held_groups"] = "SELECT DISTINCT rep, grp FROM crop_split WHERE is_test"
ORACLE["repeats_sharing"] = sql(
    "SELECT x.rep AS rep_a, y.rep AS rep_b, count(*) AS shared FROM held_groups x JOIN held_groups y ON x.grp = y.grp AND x.rep < y.rep GROUP BY ALL"
)
ORACLE["class_share"] = sql("""
  SELECT rep, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY rep), 3) AS share FROM crop_split WHERE is_test GROUP BY rep, class""")
ORACLE["balanced_weights"] = sql("""
  SELECT rep, class, count(*) AS n, round(sum(count(*)) OVER w / (count(*) OVER w * count(*)), 6) AS weight
  FROM crop_split WHERE NOT is_test GROUP BY rep, class WINDOW w AS (PARTITION BY rep)""")
CTE["train_hash"] = "SELECT rep, event_id, class, md5((rep + 7) || ':' || event_id) AS h FROM crop_split WHERE NOT is_test"
ORACLE["cap_rows"] = sql("SELECT rep, event_id, class FROM train_hash QUALIFY row_number() OVER (PARTITION BY rep ORDER BY h) <= 400")
ORACLE["cap_rows_stratified"] = sql("""
  SELECT rep, event_id, class FROM (SELECT *, row_number() OVER (PARTITION BY rep, class ORDER BY h) <= 2 AS must FROM train_hash)
  QUALIFY row_number() OVER (PARTITION BY rep ORDER BY must DESC, h) <= 48""")

# ---- vectors ----------------------------------------------------------------------------------------------

CTE["vecs"] = "SELECT vec_id AS row_id, vec_id // 5 AS grp, 'c' || label AS label, embedding::DOUBLE[] AS features FROM embeddings"
hashed_split("vec_split", "vecs", "grp", b.VECTOR_REPS, 0.25)
ORACLE["split_violations"] = sql("""
  WITH s AS (
    SELECT CASE WHEN row_id % 83 = 4 THEN row_id - 1 ELSE row_id END AS id, grp,
      CASE WHEN is_test AND row_id % 61 = 3 THEN 'c99' ELSE label END AS label,
      CASE WHEN row_id % 89 = 5 THEN 10 ELSE 64 END AS width, CASE WHEN row_id % 47 = 2 THEN NOT is_test ELSE is_test END AS is_test
    FROM vec_split WHERE rep = 0)
  SELECT 'split_width' AS code, 'features' AS path, 'feature vectors differ in width' AS message FROM s HAVING count(DISTINCT width) > 1
  UNION ALL SELECT 'split_ids', id::VARCHAR, 'id must be unique over both sides' FROM s GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'split_groups', grp::VARCHAR, 'group is on both sides' FROM s GROUP BY grp HAVING count(DISTINCT is_test) > 1
  UNION ALL SELECT 'split_classes', 'label', 'training needs at least two classes' FROM s WHERE NOT is_test HAVING count(DISTINCT label) < 2
  UNION ALL SELECT DISTINCT 'split_labels', label, 'test label is absent from training' FROM s WHERE is_test AND label NOT IN (SELECT label FROM s WHERE NOT is_test)
  UNION ALL SELECT 'split_transform', 'transform_fit', 'declare raw or train_only'""")
CTE["vec_long"] = """
  SELECT rep, row_id, label, is_test, (i - 1)::INT AS f, features[i] AS x FROM vec_split, (SELECT unnest(range(1, 65)) AS i)"""
CTE["vec_moments"] = """
  SELECT rep, f, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi FROM vec_long WHERE NOT is_test GROUP BY rep, f"""
ORACLE["moments_train"] = sql("SELECT rep, f, n, round(mean, 6) + 0 AS mean, round(std, 6) AS std FROM vec_moments")
CTE["vec_z"] = "SELECT rep, row_id, is_test, f, (x - mean) / CASE WHEN std > 0 THEN std ELSE 1 END AS z FROM vec_long JOIN vec_moments USING (rep, f)"
ORACLE["standardise_train"] = sql("SELECT rep, row_id, f, round(z, 6) + 0 AS x FROM vec_z")
ORACLE["minmax_fit_train"] = sql("""
  SELECT rep, row_id, f, round(0.05::DOUBLE + (x - lo) * (1.47::DOUBLE / CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 6) + 0 AS x
  FROM vec_long JOIN vec_moments USING (rep, f)""")
ORACLE["pca_all_components"] = sql("SELECT rep, row_id, round(sum(z * z), 6) AS length2 FROM vec_z GROUP BY rep, row_id")
ORACLE["pca_global"] = """
  WITH l AS (SELECT vec_id AS row_id, i AS f, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
  m AS (SELECT f, avg(x) AS mean, stddev_pop(x) AS std FROM l GROUP BY f)
  SELECT row_id, 'all_rows' AS transform_fit, round(sum(((x - mean) / std) ** 2), 6) AS length2 FROM l JOIN m USING (f) GROUP BY row_id"""

CTE["lines"] = """
  SELECT l_orderkey AS grp, l_returnflag AS label, [l_quantity, l_extendedprice, l_discount, l_tax] AS features FROM lineitem"""
hashed_split("line_split", "lines", "grp", b.LINE_REPS, 0.25)
CTE["line_long"] = """
  SELECT row_number() OVER () AS u, rep, label, is_test, features FROM line_split"""
CTE["line_values"] = "SELECT u, rep, label, is_test, (i - 1)::INT AS f, features[i] AS x FROM line_long, (SELECT unnest(range(1, 5)) AS i)"


def bin_ctes(prefix: str, values: str, bins: int) -> None:
    probs = ", ".join(f"{i / bins!r}::DOUBLE" for i in range(bins + 1))
    CTE[f"{prefix}_edges"] = f"SELECT rep, f, quantile_cont(x, [{probs}]) AS edges FROM {values} WHERE NOT is_test GROUP BY rep, f"
    CTE[f"{prefix}_kept"] = f"""
      SELECT rep, f, [e FOR e, i IN edges IF i = 1 OR e - edges[i - 1] > 1e-8] AS kept FROM {prefix}_edges"""
    CTE[f"{prefix}_cuts"] = f"SELECT rep, f, CASE WHEN len(kept) > 2 THEN kept[2:len(kept) - 1] ELSE [] END AS cuts FROM {prefix}_kept"
    CTE[f"{prefix}_codes"] = f"""
      SELECT v.*, len(list_filter(cuts, lambda c: c <= x))::INT AS code FROM {values} v JOIN {prefix}_cuts USING (rep, f)"""


def mi_ctes(prefix: str, left: str, right: str, keys: str, source: str) -> None:
    """Information between two columns of ``source``, straight from its definition."""
    CTE[f"{prefix}_joint"] = f"SELECT rep, {keys}, {left} AS a, {right} AS c, count(*) AS n FROM {source} GROUP BY ALL"
    CTE[prefix] = f"""
      SELECT rep, {keys}, greatest(sum(n / t * ln(n * t / (na * nc))), 0) AS mi FROM (
        SELECT *, sum(n) OVER (PARTITION BY rep, {keys}) AS t, sum(n) OVER (PARTITION BY rep, {keys}, a) AS na,
          sum(n) OVER (PARTITION BY rep, {keys}, c) AS nc FROM {prefix}_joint) GROUP BY rep, {keys}"""


bin_ctes("line_q", "line_values", 16)
bin_ctes("vec_q", "vec_long", 8)
ORACLE["quantile_edges"] = sql("""
  SELECT rep, f, (i - 1)::INT AS i, round(edges[i], 6) + 0 AS edge FROM line_q_edges, (SELECT unnest(range(1, 18)) AS i)""")
ORACLE["quantile_bins"] = sql("SELECT rep, is_test, f, code, count(*) AS n FROM line_q_codes GROUP BY ALL")
CTE["line_train"] = "SELECT * FROM line_q_codes WHERE NOT is_test"
CTE["vec_train"] = "SELECT * FROM vec_q_codes WHERE NOT is_test"
mi_ctes("line_mi", "code", "label", "f", "line_train")
mi_ctes("vec_mi", "code", "label", "f", "vec_train")
CTE["line_pairs"] = "SELECT x.rep, x.f AS fi, y.f AS fj, x.code AS p, y.code AS q FROM line_train x JOIN line_train y ON x.rep = y.rep AND x.u = y.u AND x.f < y.f"
CTE["vec_pairs"] = "SELECT x.rep, x.f AS fi, y.f AS fj, x.code AS p, y.code AS q FROM vec_train x JOIN vec_train y ON x.rep = y.rep AND x.row_id = y.row_id AND x.f < y.f"
mi_ctes("line_pair_mi", "p", "q", "fi, fj", "line_pairs")
mi_ctes("vec_pair_mi", "p", "q", "fi, fj", "vec_pairs")
ORACLE["mi_label"] = sql("SELECT rep, f, round(mi, 6) AS mi FROM vec_mi")
ORACLE["mi_label_order_lines"] = sql("SELECT rep, f, round(mi, 6) AS mi FROM line_mi")
ORACLE["mi_pairs"] = sql("SELECT rep, fi, fj, round(mi, 6) AS mi FROM vec_pair_mi")
ORACLE["mi_pairs_order_lines"] = sql("SELECT rep, fi, fj, round(mi, 6) AS mi FROM line_pair_mi")
ORACLE["select_mi"] = sql("""
  SELECT rep, 'C_mi' AS arm, string_agg(f::VARCHAR, ',' ORDER BY f) AS selected FROM (
    SELECT rep, f FROM vec_mi QUALIFY row_number() OVER (PARTITION BY rep ORDER BY round(mi, 12) DESC, f) <= 8) GROUP BY rep""")
CTE["prep_train"] = """
  SELECT rep, row_id, label, features FROM (
    SELECT *, md5((rep + 9) || ':' || row_id) AS h, row_number() OVER (PARTITION BY rep, label ORDER BY md5((rep + 9) || ':' || row_id)) <= 2 AS must
    FROM vec_split WHERE NOT is_test) QUALIFY row_number() OVER (PARTITION BY rep ORDER BY must DESC, h) <= 48"""
CTE["prep_test"] = """
  SELECT rep, row_id, label, features FROM vec_split WHERE is_test"""
CTE["prep_long"] = """
  SELECT rep, row_id, label, is_test, (i - 1)::INT AS f, features[i] AS x FROM (
    SELECT *, false AS is_test FROM prep_train UNION ALL SELECT *, true FROM prep_test), (SELECT unnest(range(1, 65)) AS i)"""
bin_ctes("prep_q", "prep_long", 8)
CTE["prep_codes"] = "SELECT * FROM prep_q_codes WHERE NOT is_test"
mi_ctes("prep_mi", "code", "label", "f", "prep_codes")
CTE["prep_pick"] = "SELECT rep, f, row_number() OVER (PARTITION BY rep ORDER BY round(mi, 12) DESC, f) - 1 AS i FROM prep_mi QUALIFY i < 6"
ORACLE["prepare_split"] = sql("""
  SELECT rep, row_id, is_test, i::INT AS i, round(0.05::DOUBLE + (x - lo) * (1.47::DOUBLE / CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 6) + 0 AS x
  FROM prep_long JOIN prep_pick USING (rep, f) JOIN (SELECT rep, f, min(x) AS lo, max(x) AS hi FROM prep_long WHERE NOT is_test GROUP BY rep, f) USING (rep, f)""")
ORACLE["prepare_split_record"] = sql("""
  SELECT rep, string_agg(f::VARCHAR, ',' ORDER BY i) AS selected, (SELECT count(*) FROM prep_train t WHERE t.rep = p.rep)::INT AS n_train,
    (SELECT count(*) FROM prep_test t WHERE t.rep = p.rep)::INT AS n_test, false AS clipped FROM prep_pick p GROUP BY rep""")
CTE["hash_pick"] = f"""
  SELECT rep, f FROM (SELECT unnest({b.VECTOR_REPS}) AS rep), (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS f)
  QUALIFY row_number() OVER (PARTITION BY rep ORDER BY md5((rep + {b.SEED}) || ':' || f)) <= 8"""
ORACLE["select_random"] = sql("SELECT rep::INT AS rep, 'A_random' AS arm, f::INT AS f FROM hash_pick")
ORACLE["selection_checks"] = sql("""
  SELECT rep, arm, CASE WHEN arm = 'Z_full' THEN 64 ELSE 8 END::BIGINT AS n, CASE WHEN arm = 'Z_full' THEN 64 ELSE 8 END::BIGINT AS n_distinct,
    CASE arm WHEN 'B_pca' THEN 7 WHEN 'Z_full' THEN 63 END AS largest
  FROM (SELECT DISTINCT rep FROM vec_split), (SELECT unnest(['A_random', 'B_pca', 'C_mi', 'D_qubo', 'F_mrmr', 'Z_full']) AS arm)""")
# greedy relevance minus mean redundancy: one more feature per step of the recursion
ORACLE["select_mrmr"] = sql("""
  WITH RECURSIVE sym AS MATERIALIZED (SELECT rep, fi, fj, mi FROM vec_pair_mi UNION ALL SELECT rep, fj, fi, mi FROM vec_pair_mi),
  rel AS MATERIALIZED (SELECT rep, f, mi FROM vec_mi),
  picked(rep, step, chosen) AS (
    SELECT rep, 1, [arg_max(f, (mi, -f))] FROM rel GROUP BY rep
    UNION ALL
    SELECT rep, step + 1, list_append(any_value(chosen), arg_max(f, (score, -f))) FROM (
      SELECT p.rep, p.step, p.chosen, r.f, any_value(r.mi) - avg(s.mi) AS score
      FROM picked p JOIN rel r ON r.rep = p.rep AND NOT list_contains(p.chosen, r.f)
      JOIN sym s ON s.rep = r.rep AND s.fi = r.f AND list_contains(p.chosen, s.fj)
      WHERE p.step < 4 GROUP BY p.rep, p.step, p.chosen, r.f) GROUP BY rep, step)
  SELECT rep, 'F_mrmr' AS arm, unnest(chosen) AS f FROM picked WHERE step = 4""")
ORACLE["top_k"] = """
  SELECT o_custkey AS rep, o_orderkey AS f, o_totalprice AS price, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"""
ORACLE["head_predictions"] = sql("""
  SELECT rep, arm, clf, count(*) AS n_items, count(DISTINCT row_id) AS n_distinct
  FROM vec_split, (SELECT unnest(['B_pca', 'Z_full']) AS arm), (SELECT unnest(['rbf_svm', 'rbf_svm_tuned', 'linear_svm']) AS clf)
  WHERE is_test GROUP BY ALL""")
ORACLE["linear_head"] = sql("SELECT 'linear_svm' AS clf, label AS y_true, count(*) AS n FROM line_split WHERE rep = 0 AND is_test GROUP BY label")
ORACLE["rbf_head"] = sql("SELECT 'rbf_rff' AS clf, label AS y_true, count(*) AS n FROM line_split WHERE rep = 0 AND is_test GROUP BY label")

# ---- annotation sets --------------------------------------------------------------------------------------------

_name = "'{p}' || (({k}) % 14) || '/' || lpad(({k})::VARCHAR, 6, '0') || '{e}'"
_plain = _name.format(p="batch_", k="c_custkey", e=".jpg")
CTE["imgs"] = f"""
  SELECT c_custkey AS id, (CASE WHEN c_custkey % 211 = 5 THEN 0 ELSE 300 + c_nationkey * 20 END)::BIGINT AS width, (200 + c_nationkey * 10)::BIGINT AS height,
    CASE WHEN c_custkey % 97 = 3 THEN '../' || {_plain} WHEN c_custkey % 89 = 4 THEN 'C:\\' || {_plain}
         WHEN c_custkey % 83 = 5 THEN {_name.format(p='BATCH_', k='c_custkey - 1', e='.JPG')} ELSE {_plain} END AS file_name,
    CASE WHEN c_custkey % 10 <> 0 THEN 'https://farm' || (c_custkey % 66) || '.staticflickr.com/' || c_custkey || '_z.jpg' END AS flickr_640_url,
    CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 <> 1 THEN 'http://example.org/' || c_custkey || '.jpg' END AS flickr_url
  FROM customer"""
CTE["disk"] = """
  SELECT file_name, CASE WHEN id % 3 = 0 THEN width // 2 ELSE width END AS aw, CASE WHEN id % 3 = 0 THEN height // 2 ELSE height END AS ah, id % 13 <> 1 AS readable
  FROM imgs WHERE id % 11 <> 2"""
CTE["cats"] = """
  SELECT id, p_brand AS name, (['bottle', 'can', 'Cup', 'Bag', 'Tube'])[id % 5 + 1] AS supercategory
  FROM (SELECT DISTINCT p_brand, substr(p_brand, 7)::BIGINT AS id FROM part)"""
CTE["taxo"] = """
  SELECT CASE WHEN id = 25 THEN 'Ghost leaf' ELSE name END AS leaf,
    CASE WHEN id = 10 THEN 'other' WHEN id = 11 THEN 'lid' WHEN id % 5 = 0 THEN 'bottle' WHEN id % 5 = 1 THEN 'can' WHEN id % 5 = 2 THEN 'cup' ELSE 'other' END AS coarse
  FROM cats"""
CTE["anns"] = """
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 173 = 9 THEN o_orderkey + 1000000000 ELSE o_custkey END AS image_id, o_orderkey % 26 + 1 AS category_id,
    o_orderkey % 149 <> 3 AS four, x, y, CASE WHEN o_orderkey % 151 = 2 THEN -w ELSE w END AS w, h,
    CASE WHEN o_orderkey % 311 = 6 THEN -1 ELSE w * h END AS area, CASE WHEN o_orderkey % 307 = 4 THEN 2 ELSE 0 END AS iscrowd
  FROM (SELECT *, (c % 20000) / 100::DOUBLE AS x, ((c // 7) % 10000) / 100::DOUBLE AS y, ((c // 11) % 9000) / 100::DOUBLE + 1 AS w, ((c // 13) % 6000) / 100::DOUBLE + 0.5::DOUBLE AS h
        FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS c FROM orders))"""
ORACLE["annotate"] = sql("""
  SELECT a.id, c.name AS category, i.width, i.height, i.file_name FROM anns a JOIN cats c ON c.id = a.category_id JOIN imgs i ON i.id = a.image_id""")
CTE["mapped"] = """
  SELECT a.*, c.name AS leaf, coalesce(t.coarse, 'Unlabeled litter') AS coarse FROM anns a JOIN cats c ON c.id = a.category_id LEFT JOIN taxo t ON t.leaf = c.name"""
ORACLE["map_taxonomy"] = sql("SELECT id, leaf, coarse FROM mapped")
CTE["corners"] = """
  SELECT id, coarse, file_name, aw, ah, there, readable, four, bx IS NULL OR by_ IS NULL AS unplaced,
    greatest(0, trunc(bx - 0.1::DOUBLE * bw)::INT) AS x0, greatest(0, trunc(by_ - 0.1::DOUBLE * bh)::INT) AS y0,
    least(aw::INT, trunc(bx + bw * 1.1::DOUBLE)::INT) AS x1, least(ah::INT, trunc(by_ + bh * 1.1::DOUBLE)::INT) AS y1
  FROM (SELECT m.id, m.coarse, m.four, i.file_name, d.aw, d.ah, d.file_name IS NOT NULL AS there, d.readable,
          m.x * (d.aw / i.width) AS bx, m.y * (d.ah / i.height) AS by_, m.w * (d.aw / i.width) AS bw, m.h * (d.ah / i.height) AS bh
        FROM (SELECT * REPLACE (CASE WHEN four THEN x END AS x, CASE WHEN four THEN y END AS y, CASE WHEN four THEN w END AS w, CASE WHEN four THEN h END AS h) FROM mapped) m
        JOIN (SELECT * REPLACE (nullif(width, 0) AS width) FROM imgs) i ON i.id = m.image_id LEFT JOIN disk d USING (file_name)
        WHERE m.coarse IN ('bottle', 'can', 'cup', 'lid'))"""
CTE["crop_rows"] = """
  SELECT id, coarse, CASE WHEN there THEN x0 ELSE 0 END AS x0, CASE WHEN there THEN y0 ELSE 0 END AS y0, x1, y1,
    CASE WHEN NOT there THEN 'missing_image' WHEN NOT readable THEN 'unreadable' WHEN NOT four THEN 'bad_box' WHEN unplaced THEN 'bad_dimension' WHEN x1 - x0 < 8 OR y1 - y0 < 8 THEN 'too_small' END AS reason,
    replace(replace(replace(file_name, chr(92), '_'), '/', '_'), '.jpg', '') || '_ann' || id || '.jpg' AS crop FROM corners"""
ORACLE["crop_plan"] = sql("SELECT * FROM crop_rows")
ORACLE["class_counts"] = sql("SELECT coarse, count(*) AS n FROM crop_rows WHERE reason IS NULL GROUP BY coarse")
ORACLE["skip_counts"] = sql("SELECT reason, count(*) AS n FROM crop_rows WHERE reason IS NOT NULL GROUP BY reason")
ORACLE["prune_classes"] = sql("""
  SELECT c.coarse, count(r.id) AS n, count(r.id) >= 50 AS kept FROM (SELECT unnest(['bottle', 'can', 'cup', 'lid', 'cigarette']) AS coarse) c
  LEFT JOIN (SELECT * FROM crop_rows WHERE reason IS NULL) r USING (coarse) GROUP BY c.coarse""")
CTE["retained"] = """
  SELECT coarse, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'too_small') AS too_small FROM crop_rows GROUP BY coarse"""
ORACLE["retention_ratio"] = sql("SELECT *, round(kept / (kept + too_small), 4) AS ratio FROM retained WHERE kept + too_small > 0")
ORACLE["filter_small"] = sql("""
  SELECT coarse, kept AS n, 'kept' AS side FROM retained WHERE kept > 0 UNION ALL SELECT coarse, too_small, 'dropped' FROM retained WHERE too_small > 0""")
ORACLE["unknown_leaves"] = sql("SELECT name AS leaf FROM cats WHERE name NOT IN (SELECT leaf FROM taxo)")
ORACLE["orphans"] = sql("SELECT id, image_id FROM anns WHERE image_id NOT IN (SELECT id FROM imgs)")
ORACLE["fetch_worklist"] = sql("SELECT id, file_name FROM imgs WHERE file_name NOT IN (SELECT file_name FROM disk)")
ORACLE["candidate_urls"] = sql("""
  SELECT id, (coalesce(flickr_640_url, '') <> '')::INT + (coalesce(flickr_url, '') <> '')::INT AS n,
    coalesce(flickr_640_url, nullif(flickr_url, '')) AS first FROM imgs""")
ORACLE["screen_urls"] = r"""
  WITH u AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN replace(url, '://', '://user@') WHEN 2 THEN url || '\x'
                                  WHEN 3 THEN regexp_replace(url, '^[a-z]+://', '') ELSE url END AS url FROM pages)
  SELECT page_id, url, CASE WHEN url = '' THEN 'empty' WHEN NOT contains(url, '://') THEN NULL WHEN NOT starts_with(url, 'https') THEN 'scheme'
    WHEN contains(url, '@') THEN 'userinfo' WHEN contains(url, '\') THEN 'backslash'
    WHEN NOT regexp_matches(url, '^https://([^/?#:]*[.])?example[.](com|org)([/?#:]|$)') THEN 'host' END AS problem FROM u"""
ORACLE["path_safety"] = sql(r"""
  SELECT id, starts_with(file_name, '../') OR starts_with(file_name, 'C:') AS unsafe, starts_with(file_name, '../') OR starts_with(file_name, 'C:') AS nonportable,
    lower(replace(file_name, '\', '/')) AS key FROM imgs""")
ORACLE["outcome_tally"] = """
  SELECT count(*) FILTER (page_id % 5 <= 3) AS failed, count(*) FILTER (page_id % 5 <= 1) AS dead, count(*) FILTER (page_id % 5 = 2) AS transient FROM pages"""
CTE["presence"] = """
  SELECT 'missing_in_taxonomy' AS kind, name AS leaf FROM cats WHERE name NOT IN (SELECT leaf FROM taxo)
  UNION ALL SELECT 'missing_in_categories', leaf FROM taxo WHERE leaf NOT IN (SELECT name FROM cats)"""
ORACLE["presence_drift"] = sql("SELECT * FROM presence")
CTE["both_leaves"] = """
  SELECT t.leaf, t.coarse, c.supercategory, c.id, CASE WHEN lower(c.supercategory) IN (SELECT coarse FROM taxo WHERE coarse <> 'other') THEN lower(c.supercategory) ELSE 'other' END AS implied
  FROM taxo t JOIN cats c ON c.name = t.leaf"""
CTE["drift"] = """
  SELECT kind, 'hard' AS severity, leaf, NULL::VARCHAR AS have, NULL::VARCHAR AS expected FROM presence
  UNION ALL SELECT 'coarse_mismatch', 'soft', leaf, coarse, implied FROM both_leaves WHERE coarse <> implied
  UNION ALL SELECT 'group_inconsistency', 'soft', leaf, coarse, consensus FROM both_leaves JOIN (
    SELECT supercategory, coarse AS consensus FROM both_leaves GROUP BY supercategory, coarse
    QUALIFY row_number() OVER (PARTITION BY supercategory ORDER BY count(*) DESC, min(id)) = 1) USING (supercategory) WHERE coarse <> consensus"""
ORACLE["taxonomy_drift"] = sql("SELECT * FROM drift")
ORACLE["taxonomy_verdict"] = sql("""
  SELECT count(*) FILTER (severity = 'hard') AS n_hard, count(*) FILTER (severity = 'soft') AS n_soft, count(*) FILTER (severity = 'hard') = 0 AS ok FROM drift""")
ORACLE["canonical_ids"] = """
  SELECT o_orderkey, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END AS from_float, o_orderkey::VARCHAR AS from_int, 'id-' || o_orderkey AS from_text
  FROM (SELECT o_orderkey, floor(o_totalprice) / CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 4 END AS x FROM orders)"""

# ---- validation ------------------------------------------------------------------------------------------------------

CTE["ann_findings"] = r"""
  SELECT 'dimension' AS code, 'images[' || id || '].width' AS path, 'must be 1 or more, is ' || width AS message FROM imgs WHERE width < 1
  UNION ALL SELECT 'path', 'images[' || id || '].file_name', 'path is unsafe or not portable' FROM imgs WHERE file_name LIKE '../%' OR file_name LIKE 'C:%'
  UNION ALL SELECT 'duplicate_path', 'images[' || lower(file_name) || ']', 'duplicate portable path' FROM imgs
    WHERE file_name NOT LIKE '../%' AND file_name NOT LIKE 'C:%' GROUP BY lower(file_name) HAVING count(*) > 1
  UNION ALL SELECT 'reference', 'annotations[' || id || '].image_id', 'no row of images has this id: ' || image_id FROM anns WHERE image_id NOT IN (SELECT id FROM imgs)
  UNION ALL SELECT 'reference', 'annotations[' || id || '].category_id', 'no row of categories has this id: ' || category_id FROM anns WHERE category_id NOT IN (SELECT id FROM cats)
  UNION ALL SELECT 'bbox', 'annotations[' || id || ']', '3 values given, 4 finite numbers needed' FROM anns WHERE NOT four
  UNION ALL SELECT 'bbox', 'annotations[' || id || ']', 'bbox needs origin >= 0 and positive extent' FROM anns WHERE four AND (x < 0 OR y < 0 OR w <= 0 OR h <= 0)
  UNION ALL SELECT 'bbox', 'annotations[' || a.id || ']', 'bbox exceeds the annotated image' FROM anns a JOIN imgs i ON i.id = a.image_id
    WHERE four AND width >= 1 AND (x + w > width + 1e-6 OR y + h > height + 1e-6)
  UNION ALL SELECT 'schema', 'annotations[' || id || '].area', 'expected a finite number >= 0' FROM anns WHERE area < 0
  UNION ALL SELECT 'schema', 'annotations[' || id || '].iscrowd', 'expected 0 or 1' FROM anns WHERE iscrowd NOT IN (0, 1)"""
ORACLE["annotation_report"] = sql("SELECT * FROM ann_findings")
ORACLE["annotation_report_ok"] = sql("SELECT count(*) AS n_errors, count(*) = 0 AS ok FROM ann_findings")
CTE["stock"] = """
  SELECT 'c' || label AS class, 'v_' || vec_id || '.jpg' AS file, 'crops/c' || label || '/v_' || vec_id || '.jpg' AS path FROM embeddings WHERE vec_id % 83 <> 8"""
_nine = lit(b.CACHE_CLASSES)
ORACLE["inventory_report"] = sql(f"""
  WITH r AS (SELECT class, CASE WHEN regexp_matches(file, '_1.*7[.]jpg') THEN file || '.png' ELSE class || '/' || file END AS rel FROM stock)
  SELECT DISTINCT 'crop_class' AS code, class AS path, 'class folder is not listed' AS message FROM r WHERE contains(rel, '/') AND class NOT IN ({_nine})
  UNION ALL SELECT 'crop_layout', rel, 'expected <class>/<name>.jpg' FROM r WHERE NOT contains(rel, '/')""")
ORACLE["metadata_report"] = """
  WITH d AS (SELECT event_type AS class, count(*) AS n FROM events GROUP BY ALL)
  SELECT 'metadata' AS code, 'error' AS path, 'class is both kept and removed' AS message FROM d WHERE class = 'error'
  UNION ALL SELECT 'metadata', class, 'per-class count disagrees' FROM d WHERE class IN ('click', 'view')
  UNION ALL SELECT 'metadata', class, 'class is neither kept nor removed' FROM d WHERE class = 'signup'
  UNION ALL SELECT 'crop_counts', class, 'kept count differs from the files on disk' FROM d WHERE class IN ('signup', 'view')"""
CTE["stash"] = """
  SELECT vec_id, 'crops/c' || label || '/v_' || (CASE WHEN vec_id % 79 = 7 THEN vec_id - vec_id % 5 ELSE vec_id END) || '.jpg' AS path,
    'c' || (CASE WHEN vec_id % 73 = 6 THEN label + 1 ELSE label END) AS label, 'c' || label AS folder, CASE WHEN vec_id % 71 = 5 THEN 63 ELSE 64 END AS dim FROM embeddings"""
CTE["label_counts"] = """
  SELECT label, coalesce(n, 0) AS n_left, coalesce(m, 0) AS n_right FROM (SELECT label, count(*) AS n FROM stash GROUP BY label)
  FULL JOIN (SELECT class AS label, count(*) AS m FROM stock GROUP BY class) USING (label)"""
ORACLE["multiset_diff"] = sql("SELECT * FROM label_counts WHERE n_left <> n_right")
ORACLE["set_diff"] = sql("""
  SELECT DISTINCT path, 'left_only' AS side FROM stash WHERE path NOT IN (SELECT path FROM stock)
  UNION ALL SELECT path, 'right_only' FROM stock WHERE path NOT IN (SELECT path FROM stash)""")
ORACLE["cache_report"] = sql(f"""
  WITH listed AS (SELECT label, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT label, count(*) AS n FROM stash GROUP BY label)
    FULL JOIN (SELECT class AS label, count(*) AS m FROM stock WHERE class IN ({_nine}) GROUP BY class) USING (label))
  SELECT 'cache_dimension' AS code, path, 'expected 64 values' AS message FROM stash WHERE dim <> 64
  UNION ALL SELECT 'cache_rows', 'n_samples', 'n_samples differs from the stored rows'
  UNION ALL SELECT 'cache_label', path, 'label is not listed' FROM stash WHERE label NOT IN ({_nine})
  UNION ALL SELECT 'cache_labels', label, 'label count differs from the inventory' FROM listed WHERE n <> m
  UNION ALL SELECT 'cache_label', path, 'label does not match the class folder' FROM stash WHERE label <> folder
  UNION ALL SELECT 'duplicate_path', path, 'duplicate path' FROM stash GROUP BY path HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'cache_path', path, 'stored file does not exist' FROM stash WHERE path NOT IN (SELECT path FROM stock)
  UNION ALL SELECT 'cache_paths', path, 'file of the inventory is not stored' FROM stock WHERE path NOT IN (SELECT path FROM stash)""")
ORACLE["fingerprint_report"] = """
  SELECT 'fingerprint' AS code, 'meta' AS path, 'invalid n_crops or 16-digit hash' AS message
  UNION ALL SELECT 'fingerprint', 'meta', 'fingerprint differs from the inventory'"""
CTE["audited"] = """
  SELECT 'run_events' AS run_id, rep, arm, clf, event_id AS pos, item_id || CASE WHEN arm = 'Z_full' AND rep = 3 AND event_id % 500 = 1 THEN 'x' ELSE '' END AS item_id,
    CASE WHEN rep = 2 AND event_id % 97 = 0 THEN 'elsewhere' ELSE grp END AS grp, y_true,
    CASE WHEN rep = 0 AND clf = 'linear_svm' AND event_id % 101 = 0 THEN NULL ELSE y_pred END AS y_pred
  FROM pred WHERE arm IN ('D_qubo', 'Z_full') AND NOT (rep = 1 AND event_id % 50 = 0)"""
ORACLE["prediction_report"] = sql("""
  WITH p AS (SELECT * REPLACE (CASE WHEN rep = 4 AND pos % 60 = 0 THEN 'view' ELSE y_true END AS y_true,
                               CASE WHEN pos % 400 = 3 AND clf = 'rbf_svm' THEN 'crops/same.jpg' ELSE item_id END AS item_id) FROM audited)
  SELECT 'alignment' AS code, rep || '/' || arm || '/' || clf AS path, 'ids, labels and predictions differ in length' AS message
    FROM p GROUP BY rep, arm, clf HAVING count(y_pred) <> count(*)
  UNION ALL SELECT 'duplicate_id', rep || '/' || arm || '/' || clf || '/' || item_id, 'item occurs twice' FROM p GROUP BY rep, arm, clf, item_id HAVING count(*) > 1
  UNION ALL SELECT 'truth', item_id, 'true label differs across repeats' FROM p GROUP BY item_id HAVING count(DISTINCT y_true) > 1
  UNION ALL SELECT 'arm', 'E_lasso', 'arm has no predictions'""")

# ---- fingerprints, artifacts, runs ----------------------------------------------------------------------------------------


def set_digest(entries: str, classes: list[str]) -> str:
    """(n_crops, digest) of (class, h) rows by sums of hash pieces per class."""
    sums = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT), 0)::HUGEINT::VARCHAR AS s{i}" for i in range(4))
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(classes))
    return f"""
      SELECT sum(n)::BIGINT AS n_crops, left(sha256(string_agg(concat_ws(':', class, n, s0, s1, s2, s3), chr(10) ORDER BY pos)), 16) AS digest FROM (
        SELECT c.pos, c.class, count(h) AS n, {sums} FROM (VALUES {names}) c(pos, class) LEFT JOIN ({entries}) e USING (class) GROUP BY c.pos, c.class)"""


_five = [*b.CLASSES[:4], "spam"]
ORACLE["name_fingerprint"] = sql(f"""
  SELECT (SELECT count(*) FROM events WHERE event_type = 'click') AS first_class, n_crops, digest AS files_hash FROM (
  {set_digest("SELECT class, sha256(class || '/' || split_part(item_id, '/', 3)) AS h FROM crops", _five)})""")
_levels = "".join(
    f"""), t{k} AS (
      SELECT left(k, {k}) AS k, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k)) AS h FROM t{k + 1} WHERE length(k) = {k + 1} GROUP BY 1
      UNION ALL SELECT k, h FROM t{k + 1} WHERE length(k) <= {k}""" for k in range(4, -1, -1))
ORACLE["tree_fingerprint"] = f"""
  WITH l AS (SELECT l_returnflag AS c, l_orderkey || '_' || l_linenumber AS f, count(*) AS n FROM lineitem GROUP BY ALL
  ), g AS (SELECT sha256(concat_ws(chr(9), CASE c WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, c || '/' || f, n)) AS g, n FROM l
  ), p AS (SELECT sum(n)::BIGINT AS n, CASE WHEN count(*) <= 64 THEN 0 WHEN count(*) <= 1024 THEN 1 WHEN count(*) <= 16384 THEN 2
    WHEN count(*) <= 262144 THEN 3 WHEN count(*) <= 4194304 THEN 4 ELSE 5 END AS depth FROM g
  ), t5 AS (SELECT left(g, depth) AS k, sha256(string_agg(g, chr(10) ORDER BY g)) AS h FROM g, p GROUP BY 1{_levels})
  SELECT p.n AS n_crops, left(h, 16) AS files_hash, 'tree:64:' || depth AS kind FROM t0, p"""
ORACLE["content_fingerprint"] = f"""
  SELECT n_crops, digest AS content_hash FROM (
  {set_digest("SELECT lang AS class, sha256(lang || '/' || doc_id || '.txt:' || octet_length(encode(text)) || ':' || sha256(text)) AS h FROM documents", ["en", "de", "es", "fr"])})"""
_pieces = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::HUGEINT::VARCHAR" for i in range(4))
ORACLE["split_fingerprint"] = sql(f"""
  SELECT rep, count(*) AS rows, sha256(concat_ws(':', 'raw', count(*), {_pieces})) AS fingerprint FROM (
    SELECT rep, sha256(to_json({{'row_id': event_id, 'grp': grp, 'label': class, 'is_test': is_test}})::VARCHAR) AS h FROM crop_split) GROUP BY rep""")
CTE["marks"] = """
  SELECT l_orderkey AS o, l_linenumber AS l, 'run_' || l_orderkey AS run_id, 'rep' || l_linenumber || '_D_qubo.json' AS artifact, sha256(l_orderkey || ':' || l_linenumber) AS h
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""
ORACLE["verify_artifacts"] = sql("""
  SELECT run_id, artifact, CASE WHEN NOT act THEN 'missing' WHEN NOT rec THEN 'unrecorded' ELSE 'hash_differs' END AS problem FROM (
    SELECT *, o % 13 <> 1 OR l <> 2 AS rec, o % 11 <> 3 AS act, l = 5 AND o % 7 = 0 AND h <> reverse(h) AS altered FROM marks)
  WHERE (rec OR act) AND (NOT act OR NOT rec OR altered)""")
ORACLE["pending_rows"] = sql("""
  SELECT run_id || '/' || artifact AS path, h AS sha256 FROM marks WHERE (o % 13 <> 1 OR l <> 2) AND (o % 11 = 3 OR (l = 5 AND o % 7 = 0))""")
ORACLE["cache_valid"] = """
  SELECT reason = 'hit' AS reuse, reason FROM (SELECT unnest(['hit', 'identity', 'backbone', 'rows']) AS reason)"""
ORACLE["missing_classes"] = "SELECT class FROM (SELECT unnest(['cigarette', 'lid']) AS class) WHERE class NOT IN (SELECT event_type FROM events)"
CTE["catalog"] = """
  SELECT *, CASE WHEN o_orderkey % 41 <> 7 THEN CASE WHEN status = 'running' THEN start ELSE start + (o_orderkey % 48) * 3600 END END AS stamp FROM (
    SELECT *, 'run_' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'complete' ELSE 'running' END AS status,
      epoch(o_orderdate)::BIGINT AS start, (o_orderkey % 26)::INT AS reps_completed, round(o_totalprice * 100)::BIGINT AS size_bytes,
      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'D_qubo,Z_full' END AS arms FROM orders)"""
ORACLE["best_run"] = sql("""
  SELECT run_id, reps_completed FROM catalog WHERE status = 'complete' ORDER BY reps_completed DESC, stamp DESC NULLS LAST, run_id DESC LIMIT 1""")
ORACLE["rank_runs"] = sql("SELECT run_id, row_number() OVER (ORDER BY stamp DESC NULLS LAST, reps_completed DESC, run_id DESC) AS rank FROM catalog")
CTE["aged"] = """
  SELECT *, (epoch(TIMESTAMP '1998-08-01') - stamp) / 86400::DOUBLE AS age,
    row_number() OVER (ORDER BY stamp DESC NULLS LAST, reps_completed DESC, run_id DESC) AS rank FROM catalog"""
ORACLE["retention_plan"] = sql("""
  SELECT run_id, status, round(age, 3) + 0 AS age_days, reason, size_bytes, reason = 'too old' AS delete FROM (
    SELECT *, CASE WHEN status = 'running' THEN 'running' WHEN rank <= 100 THEN 'recent' WHEN age IS NULL THEN 'no timestamp' WHEN age <= 900 THEN 'young' ELSE 'too old' END AS reason FROM aged)""")
ORACLE["retention_totals"] = sql("""
  SELECT delete, runs, bytes, printf('%.1f MB', round_even(bytes / 1048576, 1)) AS size FROM (
    SELECT status <> 'running' AND rank > 10 AS delete, count(*) AS runs, sum(size_bytes)::BIGINT AS bytes FROM aged GROUP BY 1)""")
ORACLE["list_runs"] = sql("""
  SELECT run_id, status, reps_completed, arms, CASE WHEN ok THEN coalesce(clfs, '') ELSE '' END AS clfs, ok AS selectable FROM (
    SELECT *, status = 'complete' AND arms <> '' AS ok FROM catalog) LEFT JOIN (
    SELECT 'run_' || l_orderkey AS run_id, string_agg(DISTINCT 'clf_' || l_returnflag, ',' ORDER BY 'clf_' || l_returnflag) AS clfs
    FROM lineitem WHERE l_linenumber % 2 = 0 AND l_suppkey % 2 = 0 GROUP BY l_orderkey) USING (run_id)""")
ORACLE["iso_timestamps"] = """
  SELECT o_orderkey, s AS seconds, round((epoch(TIMESTAMP '1998-08-01') - s) / 86400::DOUBLE, 3) + 0 AS age FROM (
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch(o_orderdate)::BIGINT WHEN 1 THEN epoch(o_orderdate)::BIGINT WHEN 2 THEN epoch(o_orderdate)::BIGINT - 7200 END AS s FROM orders)"""
ORACLE["json_numbers"] = """
  SELECT event_type, count(*) AS rows, count(json_extract(props, '$.k')::INT) AS with_k, sum(json_extract(props, '$.k')::INT)::BIGINT AS sum_k FROM events GROUP BY event_type"""

# ---- audit ------------------------------------------------------------------------------------------------------------------

CTE["shelf"] = "SELECT split_part(item_id, '/', 3) AS file, grp AS g FROM crops WHERE event_id % 211 <> 4"
CTE["spots"] = "SELECT DISTINCT rep, arm, pos, item_id, grp, split_part(item_id, '/', 3) AS file, regexp_extract(split_part(item_id, '/', 3), '^(.*)_ann', 1) AS g FROM audited"
CTE["audit_rows"] = """
  SELECT run_id, rep, n_test, n_groups, multi AS groups_with_multiple_crops, dup AS duplicate_test_ids, mis AS misaligned_artifacts,
    CASE WHEN rep = 4 THEN 1 ELSE 0 END::BIGINT AS hash_mismatches, odd AS arms_with_different_split, wrong AS group_label_mismatches, absent AS held_out_missing, strad AS straddling_groups,
    dup + mis + odd + wrong + absent + strad + CASE WHEN rep = 4 THEN 1 ELSE 0 END = 0 AS ok
  FROM (SELECT DISTINCT run_id, rep FROM audited)
  JOIN (SELECT rep, max(n)::BIGINT AS n_test, max(n - d)::BIGINT AS dup, max(w)::BIGINT AS wrong, max(a)::BIGINT AS absent FROM (
      SELECT rep, arm, count(*) AS n, count(DISTINCT item_id) AS d, count(*) FILTER (grp <> g) AS w, count(*) FILTER (file NOT IN (SELECT file FROM shelf)) AS a
      FROM spots GROUP BY rep, arm) GROUP BY rep) USING (rep)
  JOIN (SELECT rep, max(n)::BIGINT AS n_groups, max(m)::BIGINT AS multi FROM (
      SELECT rep, arm, count(*) AS n, count(*) FILTER (k > 1) AS m FROM (SELECT rep, arm, g, count(*) AS k FROM spots GROUP BY ALL) GROUP BY ALL) GROUP BY rep) USING (rep)
  JOIN (SELECT rep, sum(m)::BIGINT AS mis FROM (SELECT rep, arm, clf, (count(y_pred) <> count(item_id))::INT AS m FROM audited GROUP BY ALL) GROUP BY rep) USING (rep)
  JOIN (SELECT rep, (count(*) FILTER (x.item_id <> y.item_id) > 0)::INT::BIGINT AS odd FROM spots x JOIN spots y USING (rep, pos) WHERE x.arm = 'D_qubo' AND y.arm = 'Z_full' GROUP BY rep) USING (rep)
  JOIN (SELECT rep, max(s)::BIGINT AS strad FROM (
      SELECT h.rep, h.arm, count(DISTINCT h.g) FILTER (f.file IS NOT NULL AND o.file IS NULL) AS s
      FROM (SELECT DISTINCT rep, arm, g FROM spots) h LEFT JOIN shelf f ON f.g = h.g
      LEFT JOIN (SELECT DISTINCT rep, arm, file FROM spots) o ON o.rep = h.rep AND o.arm = h.arm AND o.file = f.file GROUP BY h.rep, h.arm) GROUP BY rep) USING (rep)"""
ORACLE["audit_repeats"] = sql("SELECT * FROM audit_rows")
ORACLE["audit_runs"] = sql("""
  WITH pairs AS (SELECT count(*) AS k FROM (SELECT DISTINCT x.rep, y.rep AS r2 FROM spots x JOIN spots y ON x.g = y.g AND x.rep < y.rep)),
  t AS (SELECT count(*) AS repeats, count(*) FILTER (NOT ok) AS failed, sum(straddling_groups)::BIGINT AS s FROM audit_rows)
  SELECT 'run_events' AS run_id, 'complete' AS status, repeats, failed AS failed_repeats, k AS repeats_sharing, s AS recomputed_overlap, 0::BIGINT AS recorded_overlap,
    s = 0 AS overlap_agrees, 'a repeat failed' AS error, 'FAIL' AS verdict FROM t, pairs
  UNION ALL SELECT 'run_open', 'running', 0, 0, 0, NULL, 0, NULL, 'not a complete run', 'FAIL'""")

# ---- stored tables and streams -------------------------------------------------------------------------------------------------

ORACLE["stored_predictions"] = sql("SELECT rep, arm, clf, pos::INT AS pos, item_id, y_true, y_pred FROM audited WHERE rep = 3")
ORACLE["stored_results"] = sql("SELECT 'r1' AS run_id, rep, arm, clf, CASE WHEN rep = 2 THEN 0.5 ELSE round(accuracy, 6) END AS accuracy FROM scored")
ORACLE["stored_split"] = sql("SELECT rep, is_test, 'raw' AS transform_fit, count(*) AS n FROM vec_split GROUP BY ALL")
ORACLE["stored_embeddings"] = sql("SELECT split_part(path, '/', 3) AS grp, label, count(*) AS n FROM stash GROUP BY ALL")
ORACLE["read_annotations"] = sql("""
  SELECT a.id, c.name AS category, i.file_name, CASE WHEN four THEN 4 ELSE 3 END AS n_box, round(CASE WHEN four THEN a.w ELSE abs(a.w) END, 2) AS w
  FROM anns a JOIN cats c ON c.id = a.category_id JOIN imgs i ON i.id = a.image_id""")
# fits cannot be written in SQL: their optimality is worked out again from the stored weights on the other side
CTE["vec_sides"] = """
  SELECT rep, label AS class, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test, true AS optimal,
    nullif(count(*) FILTER (is_test), 0) AS n_scored, nullif(count(*) FILTER (is_test), 0) AS n_items, CASE WHEN bool_or(is_test) THEN true END AS best_given
  FROM vec_split GROUP BY ALL HAVING count(*) FILTER (NOT is_test) > 0"""
ORACLE["svm_head"] = sql("SELECT * FROM vec_sides")
ORACLE["svm_fourier_head"] = sql("SELECT * FROM vec_sides")
ORACLE["svm_tuned"] = sql("""
  SELECT rep, 16::BIGINT AS n_cells, count(*) FILTER (NOT is_test) AS n_rows, true AS best_won, count(*) FILTER (is_test) AS n_scored, count(*) FILTER (is_test) AS n_items
  FROM vec_split GROUP BY rep""")
ORACLE["svm_order_lines"] = sql("SELECT rep, label AS class, true AS optimal, count(*) AS n_scored FROM line_split WHERE is_test GROUP BY ALL")
ORACLE["lasso_path"] = sql("""
  SELECT rep, penalty::INT AS penalty, (SELECT count(DISTINCT label) FROM vec_split) * 65 AS n_coef, true AS optimal, true AS grows
  FROM (SELECT DISTINCT rep FROM vec_split), (SELECT unnest(range(1, 11)) AS penalty)""")
# shards of orders by key: the third of ten has another type for its list, the fourth none, the fifth an entry 7 in place of its
# first record, the sixth an id that is no number, the seventh is cut off, the eighth is empty, the ninth repeats a key
CTE["shard"] = "SELECT o_orderkey // 500 AS s, o_orderkey // 500 % 10 AS kind, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY ALL"
ORACLE["broken_shards"] = sql("""
  SELECT what, n::BIGINT AS n FROM (
    SELECT 'kept' AS what, sum(CASE WHEN kind IN (3, 4, 7, 8, 9) THEN 0 WHEN kind = 5 THEN n - 1 ELSE n END) AS n FROM shard
    UNION ALL SELECT 'json: not a valid JSON document', count(*) FROM shard WHERE kind IN (7, 9)
    UNION ALL SELECT 'schema: a list with at least one entry is needed here', count(*) FROM shard WHERE kind IN (3, 4, 8)
    UNION ALL SELECT 'schema: the entry is not a JSON object', count(*) FROM shard WHERE kind = 5
    UNION ALL SELECT 'id: not an id: null', count(*) FROM shard WHERE kind = 6)
  WHERE n > 0""")
CTE["rep_docs"] = "SELECT rep, arm, rep::INT % 3 AS kind FROM pred GROUP BY ALL"
ORACLE["broken_artifacts"] = sql("""
  SELECT what, n::BIGINT AS n FROM (
    SELECT 'rows' AS what, count(*) AS n FROM pred WHERE rep % 3 <> 2
    UNION ALL SELECT 'rows with an item', count(*) FROM pred WHERE rep % 3 = 0
    UNION ALL SELECT 'schema: the field must be of type array<string>', count(*) FROM rep_docs WHERE kind = 1
    UNION ALL SELECT 'schema: a head and its predictions are needed here', count(*) FROM rep_docs WHERE kind = 2)
  WHERE n > 0""")
ORACLE["append_null_keys"] = """
  SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS a, CASE WHEN c_custkey % 7 = 0 THEN c_custkey END AS b,
    CASE WHEN c_custkey % 5 = 1 THEN c_mktsegment ELSE 'held ' || c_custkey % 3 END AS payload FROM customer"""
ORACLE["read_taxonomy"] = sql("SELECT leaf, CASE WHEN leaf = 'Brand#1' THEN 'zinc' ELSE coarse END AS coarse FROM taxo")
ORACLE["stored_run"] = "SELECT 'run_q' AS run_id, 'complete' AS status, 5 AS reps_completed, 2 AS n_tables, 0::BIGINT AS problems"
ORACLE["deploy_head"] = sql("SELECT 1::DOUBLE AS agreement, count(*) AS n, true AS ok FROM vec_split WHERE rep = 0 AND is_test")
ORACLE["ingest_once"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"
ORACLE["stream_runs"] = sql("SELECT run_id, reps_completed FROM catalog WHERE status = 'complete'")
ORACLE["ranked_items"] = "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rank FROM events"
