"""DuckDB twins of the registered queries, built from one chain of common table expressions."""

STEPS: list[tuple[str, str]] = [
    ("s", r"""SELECT vec_id, vec_id // 10 AS job_id, vec_id % 10 AS pos, CASE WHEN (vec_id // 10) % 2 = 0 THEN 'actuel' ELSE 'cible' END AS role,
        CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(1 + vec_id % 4 AS INTEGER) END AS niveau, CAST(embedding AS DOUBLE[]) AS dense,
        coalesce(w.ws, []) AS ws, 'Skill ' || label AS intitule, label
        FROM embeddings LEFT JOIN (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 2)) AS ws FROM documents) w ON w.doc_id = vec_id"""),
    ("p", """SELECT a.job_id AS ja, c.job_id AS jc, a.pos AS pa, c.pos AS pc, a.vec_id AS ia, c.vec_id AS ic, a.intitule AS ta, c.intitule AS tc, a.niveau AS na, c.niveau AS nc,
        list_dot_product(a.dense, c.dense) AS d,
        CASE WHEN len(a.ws) > 0 AND len(c.ws) > 0 THEN len(list_intersect(a.ws, c.ws)) * 0.25 / (sqrt(len(a.ws) * 0.25) * sqrt(len(c.ws) * 0.25)) ELSE 0.0 END AS l
        FROM s a JOIN s c ON a.role = 'actuel' AND c.role = 'cible'"""),
    ("h", "SELECT *, 2 * d::VARCHAR::DECIMAL(26,22) + l::VARCHAR::DECIMAL(26,22) AS ex FROM p"),
    ("x", "SELECT *, CAST(ex AS DOUBLE) / 3 AS hyb, ex * {sim_den} >= {sim_num} * 3 AS reaches FROM h"),
    ("b", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ja, jc, pc ORDER BY ex DESC, coalesce(na, 0) DESC, l DESC, lower(ta), CAST(ia AS VARCHAR), pa) AS r FROM x) WHERE r = 1"""),
    ("m", """SELECT *, CASE WHEN reaches THEN na ELSE 0 END AS niveau_actuel,
        CASE WHEN NOT reaches THEN nc WHEN na IS NULL OR nc IS NULL THEN NULL ELSE greatest(0, nc - na) END AS ecart FROM b"""),
    ("ms", """SELECT *, CASE WHEN NOT reaches THEN 'absente' WHEN ecart IS NULL THEN 'niveau_non_renseigne' WHEN ecart = 0 THEN 'niveau_suffisant' ELSE 'niveau_insuffisant' END AS statut FROM m"""),
    ("sc", """SELECT ja, jc, count(*) AS n, count(*) FILTER (WHERE reaches) AS nr, count(*) FILTER (WHERE statut = 'niveau_suffisant') AS ns,
        count(*) FILTER (WHERE reaches) / count(*) AS g, count(*) FILTER (WHERE statut = 'niveau_suffisant') / count(*) AS gs,
        sum(ecart * nc) / nullif(sum(CASE WHEN ecart IS NOT NULL THEN nc END), 0) AS gap, count(*) FILTER (WHERE reaches) * 10 >= count(*) * 7 AS adm FROM ms GROUP BY ja, jc"""),
    ("rk", "SELECT *, row_number() OVER (PARTITION BY ja ORDER BY g DESC, gap ASC NULLS LAST, gs DESC, jc) AS rang FROM sc"),
    ("sl", """SELECT *, count(*) FILTER (WHERE sel) OVER (PARTITION BY ja) AS nret FROM
        (SELECT *, adm AND rank() OVER (PARTITION BY ja, adm ORDER BY g DESC, gap ASC NULLS LAST, gs DESC) = 1 AS sel FROM rk)"""),
    ("ru", """SELECT ja, jc, avg(CASE WHEN reaches THEN 1.0 ELSE 0.0 END) AS r FROM
        (SELECT ja, jc, pa, max_by(reaches, hyb) AS reaches FROM x SEMI JOIN (SELECT ja, jc FROM sl WHERE sel) USING (ja, jc) GROUP BY ja, jc, pa) GROUP BY ja, jc"""),
    ("lp", """SELECT a.job_id AS ca, b.job_id AS cb, a.label = b.label AS y FROM s a JOIN s b ON a.pos = 0 AND b.pos = 0 AND a.job_id < b.job_id"""),
    ("ep", """SELECT ca, cb, y, a.pos AS pa, b.pos AS pb, list_dot_product(a.dense, b.dense) AS d,
        CASE WHEN len(a.ws) > 0 AND len(b.ws) > 0 THEN len(list_intersect(a.ws, b.ws)) * 0.25 / (sqrt(len(a.ws) * 0.25) * sqrt(len(b.ws) * 0.25)) ELSE 0.0 END AS l
        FROM lp JOIN s a ON a.job_id = ca JOIN s b ON b.job_id = cb"""),
    ("bs", """SELECT ca, cb, y, 'a' AS side, pa AS pos, max(d) AS best FROM ep GROUP BY ca, cb, y, pa UNION ALL SELECT ca, cb, y, 'b', pb, max(d) FROM ep GROUP BY ca, cb, y, pb"""),
    ("cv", """SELECT ca, cb, y, t, avg(CASE WHEN best >= t THEN 1.0 ELSE 0.0 END) FILTER (WHERE side = 'b') AS ab, avg(CASE WHEN best >= t THEN 1.0 ELSE 0.0 END) FILTER (WHERE side = 'a') AS ba
        FROM bs, (SELECT unnest([{grid}]) AS t) GROUP BY ca, cb, y, t"""),
    ("gr", """SELECT t AS seuil_sim, c AS seuil_couv, count(*) FILTER (WHERE y AND (ab + ba) / 2 >= c) AS tp, count(*) FILTER (WHERE NOT y AND (ab + ba) / 2 >= c) AS fp,
        count(*) FILTER (WHERE y AND (ab + ba) / 2 < c) AS fn, count(*) FILTER (WHERE NOT y AND (ab + ba) / 2 < c) AS tn FROM cv, (SELECT unnest([{couv}]) AS c) GROUP BY t, c"""),
    ("gm", """SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM gr"""),
    ("hw", """SELECT ca, cb, y, w, avg(m) AS score FROM (
        SELECT ca, cb, y, w, side, avg(best) AS m FROM (
          SELECT ca, cb, y, w, 'a' AS side, pa AS pos, max(w * d + (1 - w) * l) AS best FROM ep, (SELECT unnest([{weights}]) AS w) GROUP BY ca, cb, y, w, pa
          UNION ALL SELECT ca, cb, y, w, 'b', pb, max(w * d + (1 - w) * l) FROM ep, (SELECT unnest([{weights}]) AS w) GROUP BY ca, cb, y, w, pb) GROUP BY ca, cb, y, w, side) GROUP BY ca, cb, y, w"""),
    ("au", """SELECT w, (sum(CASE WHEN y THEN mid END) - p * (p + 1) / 2.0) / (p * n) AS auc, p, n FROM
        (SELECT *, rank() OVER (PARTITION BY w ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY w, round(score, 9)) - 1) / 2.0 AS mid,
          count(*) FILTER (WHERE y) OVER (PARTITION BY w) AS p, count(*) FILTER (WHERE NOT y) OVER (PARTITION BY w) AS n FROM hw) GROUP BY w, p, n"""),
]

#: Fixed grid of the fixtures: thresholds from 0.05 to 0.40.
GRID = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4]
COUVERTURES = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
WEIGHTS = [round(1 - 0.1 * i, 1) for i in range(11)]
SIMILARITY = (15, 100)


def sql(last: str, select: str) -> str:
    """The chain up to ``last``, then ``select``; steps that it does not need are left out by the planner."""
    names = [n for n, _ in STEPS]
    values = {"{sim_num}": str(SIMILARITY[0]), "{sim_den}": str(SIMILARITY[1])}
    values |= {"{grid}": ", ".join(f"{x}::DOUBLE" for x in GRID), "{couv}": ", ".join(f"{x}::DOUBLE" for x in COUVERTURES), "{weights}": ", ".join(f"{x}::DOUBLE" for x in WEIGHTS)}
    parts = []
    for name, body in STEPS[: names.index(last) + 1]:
        for k, v in values.items():
            body = body.replace(k, v)
        parts.append(f"{name} AS ({body})")
    return f"WITH {', '.join(parts)} {select}"
