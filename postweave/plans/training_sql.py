"""SQL forms of the epoch loop and of the report, for comparison with the Spark results."""

from __future__ import annotations

from collections.abc import Sequence

from postweave.operators.train import BETA_1, BETA_2, EPSILON


def head_sql(inputs: str, classes: int, epochs: int, lr: float, prefix: str = "") -> str:
    """CTEs of full-batch training: ``run`` has the history, ``scored`` the predictions.

    ``inputs`` selects ``id, label, is_train, pos, x``. Each epoch is written out. The
    saved weights are those of the lowest valid loss. Meant for at most four epochs: a
    patience of 3 cannot stop a run before its fourth epoch. ``prefix`` starts all names.
    """
    x = prefix
    parts = [
        f"""{x}f AS MATERIALIZED (SELECT id, CAST(label AS INT) AS label, is_train, pos, x
          FROM ({inputs}) UNION ALL SELECT DISTINCT id, CAST(label AS INT), is_train, -1, 1.0
          FROM ({inputs}))""",
        f"""{x}w0 AS MATERIALIZED (SELECT pos, CAST(k.i AS INT) AS k, 0.0::DOUBLE AS w,
          0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT DISTINCT pos FROM {x}f)
          CROSS JOIN range({classes}) k(i))""",
    ]
    for t in range(epochs + 1):
        parts += [
            f"""{x}z{t} AS MATERIALIZED (SELECT id, label, is_train, k, sum(x * w) AS z
              FROM {x}f JOIN {x}w{t} USING (pos) GROUP BY 1, 2, 3, 4)""",
            f"""{x}t{t} AS MATERIALIZED (SELECT *, z - max(z) OVER (PARTITION BY id) AS d,
              row_number() OVER (PARTITION BY id ORDER BY z DESC, k) AS place FROM {x}z{t})""",
            f"""{x}p{t} AS MATERIALIZED (SELECT *, exp(d) / sum(exp(d)) OVER (PARTITION BY id) AS p,
              ln(sum(exp(d)) OVER (PARTITION BY id)) - d AS nll FROM {x}t{t})""",
            f"""{x}e{t} AS (SELECT is_train,
              avg(nll) FILTER (k = label) AS loss,
              avg((k = label)::INT) FILTER (place = 1) AS acc FROM {x}p{t} GROUP BY is_train)""",
        ]
        if t == epochs:
            break
        n = t + 1
        parts += [
            f"""{x}g{t} AS (SELECT f.pos, p.k, avg((p.p - (p.k = p.label)::INT) * f.x) AS g
              FROM {x}f f JOIN {x}p{t} p USING (id) WHERE f.is_train GROUP BY 1, 2)""",
            f"""{x}a{n} AS (SELECT pos, k, w, {BETA_1} * m + {1 - BETA_1} * g AS m,
              {BETA_2} * v + {1 - BETA_2} * g * g AS v FROM {x}w{t} JOIN {x}g{t} USING (pos, k))""",
            f"""{x}w{n} AS MATERIALIZED (SELECT pos, k, m, v,
              w - {lr} * (m / (1 - pow({BETA_1}::DOUBLE, {n})))
                / (sqrt(v / (1 - pow({BETA_2}::DOUBLE, {n}))) + {EPSILON}) AS w FROM {x}a{n})""",
        ]
    runs = " UNION ALL ".join(
        f"""SELECT {n} AS epoch, (SELECT loss FROM {x}e{n - 1} WHERE is_train) AS train_loss,
          (SELECT acc FROM {x}e{n - 1} WHERE is_train) AS train_acc,
          (SELECT loss FROM {x}e{n} WHERE NOT is_train) AS valid_loss,
          (SELECT acc FROM {x}e{n} WHERE NOT is_train) AS valid_acc"""
        for n in range(1, epochs + 1)
    )
    scored = " UNION ALL ".join(
        f"SELECT {n} AS epoch, id, label, is_train, k AS prediction FROM {x}t{n} WHERE place = 1"
        for n in range(1, epochs + 1)
    )
    parts += [
        f"{x}run AS MATERIALIZED ({runs})",
        f"""{x}scored AS MATERIALIZED (SELECT id, label, is_train, prediction FROM ({scored})
          WHERE epoch = (SELECT epoch FROM {x}run ORDER BY valid_loss, epoch LIMIT 1))""",
    ]
    return ", ".join(parts)


def report_sql(predictions: str, names: Sequence[str] | None = None) -> str:
    """CTEs ``rates`` (per class) and ``report`` from a table ``label, prediction``."""
    if names is None:
        listed = "SELECT c AS k, CAST(c AS VARCHAR) AS name FROM seen"
    else:
        values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
        listed = f"SELECT k, name FROM (VALUES {values}) v(k, name)"
    return f"""seen AS (SELECT label AS c FROM {predictions}
      UNION SELECT prediction FROM {predictions}),
    tallies AS (SELECT c, (SELECT count(*) FROM {predictions} WHERE label = c) AS support,
      (SELECT count(*) FROM {predictions} WHERE prediction = c) AS predicted,
      (SELECT count(*) FROM {predictions} WHERE label = c AND prediction = c) AS hits FROM seen),
    shares AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits::DOUBLE / predicted END
      AS precision, CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS recall
      FROM tallies),
    rates AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0
      ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM shares),
    report AS (SELECT name, round(coalesce(precision, 0), 6) AS precision,
        round(coalesce(recall, 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1,
        coalesce(support, 0) AS support FROM ({listed}) LEFT JOIN rates ON c = k
      UNION ALL SELECT 'accuracy', round(sum(hits)::DOUBLE / sum(support)::DOUBLE, 6),
        round(sum(hits)::DOUBLE / sum(support)::DOUBLE, 6),
        round(sum(hits)::DOUBLE / sum(support)::DOUBLE, 6), CAST(sum(support) AS BIGINT) FROM rates
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
        round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM rates
      UNION ALL SELECT 'weighted avg', round(sum(support * precision) / sum(support), 6),
        round(sum(support * recall) / sum(support), 6), round(sum(support * f1) / sum(support), 6),
        CAST(sum(support) AS BIGINT) FROM rates)"""
