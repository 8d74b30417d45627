"""SQL forms of the trained networks, for comparison with the Spark results.

Parameters are tables of their keys with ``w, m, v``: weight and the two moments of Adam. Each epoch is written out. A
row at position -1 with the value 1 carries the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from postweave.functions.permute import permutation_sql, round_keys
from postweave.operators.train import BETA_1, BETA_2, EPSILON


def erf_sql(z: str) -> str:
    """The error function as its series of positive terms."""
    series = f"""list_sum(list_transform(range(121),
      lambda n: pow(abs({z}), 2 * n + 1) / gamma(n + 1.5)))"""
    return f"(CASE WHEN abs({z}) > 6 THEN sign({z}) ELSE sign({z}) * exp(-{z} * {z}) * {series} END)"


def mixed_sql(x: str) -> str:
    """32 mixed bits of a number, as ``functions.permute.mixed``."""
    for _ in range(2):
        x = f"(({x}) & 4294967295) * 73244475 & 4294967295"
        x = f"xor({x}, ({x}) >> 16)"
    return x


def _start(name: str, rows: str, keys: str, weight: str) -> str:
    return f"{name}0 AS MATERIALIZED (SELECT {keys}, {weight} AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM {rows})"


def _adam(name: str, keys: str, t: int, lr: float) -> list[str]:
    """``name`` of the next epoch from ``name`` and ``name_g`` (keys, g) of this one."""
    n = t + 1
    return [
        f"""{name}_a{n} AS (SELECT {keys}, w, {BETA_1} * m + {1 - BETA_1} * coalesce(g, 0) AS m,
          {BETA_2} * v + {1 - BETA_2} * coalesce(g, 0) * coalesce(g, 0) AS v
          FROM {name}{t} LEFT JOIN {name}_g{t} USING ({keys}))""",
        f"""{name}{n} AS MATERIALIZED (SELECT {keys}, m, v, w - {lr} * (m / (1 - pow({BETA_1}::DOUBLE, {n})))
          / (sqrt(v / (1 - pow({BETA_2}::DOUBLE, {n}))) + {EPSILON}) AS w FROM {name}_a{n})""",
    ]


def _evaluated(t: int) -> list[str]:
    """Shares, losses and places from ``z{t}`` (id, label, is_train, k, z)."""
    return [
        f"""t{t} AS MATERIALIZED (SELECT *, z - max(z) OVER (PARTITION BY id) AS d,
          row_number() OVER (PARTITION BY id ORDER BY z DESC, k) AS place FROM z{t})""",
        f"""p{t} AS MATERIALIZED (SELECT *, exp(d) / sum(exp(d)) OVER (PARTITION BY id) AS p,
          ln(sum(exp(d)) OVER (PARTITION BY id)) - d AS nll FROM t{t})""",
        f"""e{t} AS (SELECT is_train, avg(nll) FILTER (k = label) AS loss,
          avg((k = label)::INT) FILTER (place = 1) AS acc FROM p{t} GROUP BY is_train)""",
        f"""r{t} AS MATERIALIZED (SELECT id, k, (p - (k = label)::INT) / (SELECT count(DISTINCT id) FROM p{t} WHERE is_train) AS r
          FROM p{t} WHERE is_train)""",
    ]


def _runs(epochs: int) -> list[str]:
    runs = " UNION ALL ".join(
        f"""SELECT {n} AS epoch, (SELECT loss FROM e{n - 1} WHERE is_train) AS train_loss,
          (SELECT acc FROM e{n - 1} WHERE is_train) AS train_acc, (SELECT loss FROM e{n} WHERE NOT is_train) AS valid_loss,
          (SELECT acc FROM e{n} WHERE NOT is_train) AS valid_acc""" for n in range(1, epochs + 1))
    return [f"run AS MATERIALIZED ({runs})"]


def hidden_sql(inputs: str, width: int, hidden: int, classes: int, epochs: int, lr: float, dropout: float, seed: int,
               inner: str, outer: str) -> str:
    """CTEs of a head with a hidden layer: ``run`` has the history, ``last`` the predictions of the last parameters.

    ``inputs`` selects ``id, label, is_train, pos, x``; ``inner`` (of pos, j) and ``outer`` (of j, k) are the first weights.
    """
    parts = [
        f"""f AS MATERIALIZED (SELECT id, CAST(label AS INT) AS label, is_train, pos, x FROM ({inputs})
          UNION ALL SELECT DISTINCT id, CAST(label AS INT), is_train, -1, 1.0 FROM ({inputs}))""",
        "who AS MATERIALIZED (SELECT DISTINCT id, label, is_train FROM f)",
        _start("i", f"range(-1, {width}) a(pos) CROSS JOIN range({hidden}) b(j)", "pos, j", f"CASE WHEN pos < 0 THEN 0.0 ELSE {inner} END"),
        _start("o", f"range(-1, {hidden}) a(j) CROSS JOIN range({classes}) b(k)", "j, k", f"CASE WHEN j < 0 THEN 0.0 ELSE {outer} END"),
    ]
    for t in range(epochs + 1):
        kept = f"{mixed_sql('row_key + j * 40503')} >= {dropout!r} * 4294967296.0"
        parts += [
            f"keys{t} AS MATERIALIZED (SELECT *, {mixed_sql('a + b')} AS row_key FROM (SELECT id, label, is_train, {mixed_sql('id')} AS a, "
            f"{mixed_sql(f'{seed * 1000 + t + 1}::BIGINT')} AS b FROM who))",
            f"""h{t} AS (SELECT id, j, sum(x * w) AS y FROM f JOIN i{t} USING (pos) GROUP BY 1, 2)""",
            f"""a{t} AS MATERIALIZED (SELECT id, label, is_train, j, s, (y > 0)::INT AS up, greatest(y, 0) * s AS y FROM (
              SELECT id, label, is_train, j, y, CASE WHEN NOT is_train THEN 1.0 WHEN {kept} THEN 1.0 / (1.0 - {dropout!r}) ELSE 0.0 END AS s
              FROM h{t} JOIN keys{t} USING (id)) UNION ALL SELECT id, label, is_train, -1, 1.0, 1, 1.0 FROM who)""",
            f"z{t} AS MATERIALIZED (SELECT id, label, is_train, k, sum(y * w) AS z FROM a{t} JOIN o{t} USING (j) GROUP BY 1, 2, 3, 4)",
            *_evaluated(t),
        ]
        if t < epochs:
            parts += [
                f"o_g{t} AS (SELECT j, k, sum(y * r) AS g FROM a{t} JOIN r{t} USING (id) GROUP BY 1, 2)",
                f"""d{t} AS MATERIALIZED (SELECT id, j, sum(r * w) * any_value(s * up) AS d FROM r{t} JOIN o{t} USING (k)
                  JOIN a{t} USING (id, j) WHERE j >= 0 GROUP BY 1, 2)""",
                f"i_g{t} AS (SELECT pos, j, sum(x * d) AS g FROM f JOIN d{t} USING (id) GROUP BY 1, 2)",
                *_adam("i", "pos, j", t, lr), *_adam("o", "j, k", t, lr),
            ]
    return ", ".join([*parts, *_runs(epochs), f"last AS (SELECT id, label, is_train, k AS prediction FROM t{epochs} WHERE place = 1)"])


def batch_attention_sql(sides: str, cut: int, widths: Sequence[int], hidden: int, classes: int, epochs: int, lr: float,
                        seed: int, batch: int) -> str:
    """CTEs of trained attention over batches: ``run`` has the history.

    ``sides`` selects ``side, id, label, is_train, idx, pos, x`` with ``side`` 0 or 1 and ``idx`` the place within the split;
    each epoch has the train order of ``seed``. First weights: sines of the positions.
    """
    layer = "CASE WHEN pos < 0 THEN 0.0 ELSE sin(31 * j + pos + side) / sqrt(CASE side WHEN 0 THEN {} ELSE {} END) END".format(*map(float, widths))
    inputs = " UNION ALL ".join(f"SELECT {s} AS side, pos FROM range(-1, {w}) a(pos)" for s, w in enumerate(widths))
    parts = [
        f"f AS MATERIALIZED ({sides})",
        "g1 AS MATERIALIZED (SELECT * FROM f UNION ALL SELECT DISTINCT side, id, label, is_train, idx, -1, 1.0 FROM f)",
        "who AS MATERIALIZED (SELECT DISTINCT id, label, is_train, idx FROM f)",
        _start("a", f"({inputs}) CROSS JOIN range({hidden}) b(j)", "side, pos, j", layer),
        _start("q", f"range(2) s(side) CROSS JOIN range({hidden}) b(j)", "side, j", "cos(j + side)"),
        _start("o", f"(SELECT side, pos FROM ({inputs}) WHERE pos >= 0 UNION ALL SELECT -1, -1) CROSS JOIN range({classes}) c(k)",
               "side, pos, k", f"CASE WHEN side < 0 THEN 0.0 ELSE sin(17 * k + pos + side * {cut}) / {float(sum(widths))!r} END"),
    ]
    for t in range(epochs + 1):
        y = f"(y / {2 ** 0.5!r})"
        parts += [
            f"""b{t} AS MATERIALIZED (SELECT id, label, is_train, (CASE WHEN is_train THEN {order_sql(seed, t + 1, 'idx')} ELSE idx END) // {batch} AS batch
              FROM (SELECT *, {sides_sql("(SELECT count(*) FROM who WHERE is_train)")} FROM who))""",
            f"h{t} AS (SELECT side, id, j, sum(x * w) AS y FROM g1 JOIN a{t} USING (side, pos) GROUP BY 1, 2, 3)",
            f"h2{t} AS MATERIALIZED (SELECT *, 0.5 * (1 + {erf_sql(y)}) AS phi FROM h{t})",
            f"s{t} AS (SELECT side, id, sum(y * phi * w) AS s FROM h2{t} JOIN q{t} USING (side, j) GROUP BY 1, 2)",
            f"""m{t} AS (SELECT *, exp(s - max(s) OVER (PARTITION BY side, is_train, batch)) AS e FROM s{t} JOIN b{t} USING (id))""",
            f"""w{t} AS MATERIALIZED (SELECT side, id, is_train, batch, e / sum(e) OVER (PARTITION BY side, is_train, batch) AS u FROM m{t})""",
            f"""x{t} AS MATERIALIZED (SELECT f.side, id, label, f.is_train, pos, x, x * u AS y FROM f JOIN w{t} USING (side, id)
              UNION ALL SELECT -1, id, label, is_train, -1, 1.0, 1.0 FROM who)""",
            f"z{t} AS MATERIALIZED (SELECT id, label, is_train, k, sum(y * w) AS z FROM x{t} JOIN o{t} USING (side, pos) GROUP BY 1, 2, 3, 4)",
            *_evaluated(t),
        ]
        if t < epochs:
            parts += [
                f"o_g{t} AS (SELECT side, pos, k, sum(y * r) AS g FROM x{t} JOIN r{t} USING (id) GROUP BY 1, 2, 3)",
                f"""c{t} AS (SELECT side, id, sum(r * x * w) AS c FROM x{t} JOIN r{t} USING (id) JOIN o{t} USING (side, pos, k)
                  WHERE side >= 0 GROUP BY 1, 2)""",
                f"""d{t} AS MATERIALIZED (SELECT side, id, u * (c - sum(u * c) OVER (PARTITION BY side, batch)) AS d
                  FROM w{t} JOIN c{t} USING (side, id))""",
                f"q_g{t} AS (SELECT side, j, sum(d * y * phi) AS g FROM h2{t} JOIN d{t} USING (side, id) GROUP BY 1, 2)",
                f"""n{t} AS MATERIALIZED (SELECT side, id, j, d * w * (phi + y * exp(-0.5 * y * y) / sqrt(2 * pi())) AS n
                  FROM h2{t} JOIN d{t} USING (side, id) JOIN q{t} USING (side, j))""",
                f"a_g{t} AS (SELECT side, pos, j, sum(x * n) AS g FROM g1 JOIN n{t} USING (side, id) GROUP BY 1, 2, 3)",
                *_adam("a", "side, pos, j", t, lr), *_adam("q", "side, j", t, lr), *_adam("o", "side, pos, k", t, lr),
            ]
    return ", ".join([*parts, *_runs(epochs)])


def cross_attention_sql(texts: str, images: str, text_width: int, image_width: int, hidden: int, classes: int,
                        epochs: int, lr: float) -> str:
    """CTEs of trained attention over the images of a post: ``run`` has the history.

    ``texts`` selects ``id, label, is_train, pos, x``, ``images`` ``id, img, pos, x`` of the posts that are in ``texts``.
    """
    def layer(name: str, inputs: int, outputs: int, key: str, turn: int) -> str:
        return _start(name, f"range(-1, {inputs}) a(pos) CROSS JOIN range({outputs}) b({key})", f"pos, {key}",
                      f"CASE WHEN pos < 0 THEN 0.0 ELSE sin({turn} * {key} + pos) / sqrt({float(inputs)!r}) END")

    parts = [
        f"tx AS MATERIALIZED ({texts})", f"im AS MATERIALIZED ({images})",
        "who AS MATERIALIZED (SELECT DISTINCT id, label, is_train FROM tx)",
        "tt AS MATERIALIZED (SELECT id, pos, x FROM tx UNION ALL SELECT id, -1, 1.0 FROM who)",
        "has AS MATERIALIZED (SELECT DISTINCT id FROM im)",
        "mean AS MATERIALIZED (SELECT id, pos, avg(x) AS x FROM im GROUP BY 1, 2)",
        layer("q", text_width, hidden, "j", 31), layer("kk", image_width, hidden, "j", 37), layer("v", image_width, text_width, "o", 41),
        layer("o", text_width + image_width, classes, "k", 17),
    ]
    for t in range(epochs + 1):
        parts += [
            f"qq{t} AS MATERIALIZED (SELECT id, j, sum(x * w) AS q FROM tt JOIN q{t} USING (pos) GROUP BY 1, 2)",
            f"kx{t} AS MATERIALIZED (SELECT id, img, j, sum(x * w) AS y FROM im JOIN kk{t} USING (pos) GROUP BY 1, 2, 3)",
            f"s{t} AS (SELECT id, img, sum(q * y) AS s FROM kx{t} JOIN qq{t} USING (id, j) GROUP BY 1, 2)",
            f"m{t} AS (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM s{t})",
            f"w{t} AS MATERIALIZED (SELECT id, img, e / sum(e) OVER (PARTITION BY id) AS u FROM m{t})",
            f"""y{t} AS MATERIALIZED (SELECT id, pos, sum(u * x) AS x FROM im JOIN w{t} USING (id, img) GROUP BY 1, 2
              UNION ALL SELECT id, -1, 1.0 FROM has)""",
            f"val{t} AS (SELECT id, o AS pos, sum(x * w) AS y FROM y{t} JOIN v{t} USING (pos) GROUP BY 1, 2)",
            f"""x{t} AS MATERIALIZED (SELECT id, label, is_train, pos, x + coalesce(y, 0) AS x FROM tx LEFT JOIN val{t} USING (id, pos)
              UNION ALL SELECT id, label, is_train, {text_width} + pos, x FROM mean JOIN who USING (id)
              UNION ALL SELECT id, label, is_train, -1, 1.0 FROM who)""",
            f"z{t} AS MATERIALIZED (SELECT id, label, is_train, k, sum(x * w) AS z FROM x{t} JOIN o{t} USING (pos) GROUP BY 1, 2, 3, 4)",
            *_evaluated(t),
        ]
        if t < epochs:
            parts += [
                f"o_g{t} AS (SELECT pos, k, sum(x * r) AS g FROM x{t} JOIN r{t} USING (id) GROUP BY 1, 2)",
                f"""back{t} AS MATERIALIZED (SELECT id, pos AS o, sum(r * w) AS b FROM r{t} SEMI JOIN has USING (id) JOIN o{t} USING (k)
                  WHERE pos BETWEEN 0 AND {text_width - 1} GROUP BY 1, 2)""",
                f"v_g{t} AS (SELECT pos, o, sum(x * b) AS g FROM y{t} JOIN back{t} USING (id) GROUP BY 1, 2)",
                f"u{t} AS MATERIALIZED (SELECT id, pos, sum(b * w) AS u FROM back{t} JOIN v{t} USING (o) WHERE pos >= 0 GROUP BY 1, 2)",
                f"g{t} AS (SELECT id, img, sum(x * u) AS g FROM im JOIN u{t} USING (id, pos) GROUP BY 1, 2)",
                f"d{t} AS MATERIALIZED (SELECT id, img, u * (g - sum(u * g) OVER (PARTITION BY id)) AS d FROM w{t} JOIN g{t} USING (id, img))",
                f"kk_g{t} AS (SELECT pos, j, sum(d * x * q) AS g FROM im JOIN d{t} USING (id, img) JOIN qq{t} USING (id) GROUP BY 1, 2)",
                f"dq{t} AS (SELECT id, j, sum(d * y) AS d FROM kx{t} JOIN d{t} USING (id, img) GROUP BY 1, 2)",
                f"q_g{t} AS (SELECT pos, j, sum(x * d) AS g FROM tt JOIN dq{t} USING (id) GROUP BY 1, 2)",
                *_adam("q", "pos, j", t, lr), *_adam("kk", "pos, j", t, lr), *_adam("v", "pos, o", t, lr), *_adam("o", "pos, k", t, lr),
            ]
    return ", ".join([*parts, *_runs(epochs)])


#: Turns that no walk of a small table reaches.
TURNS = 12


def order_sql(seed: int, epoch: int, position: str) -> str:
    """The place of a position in an epoch's order; columns ``n_order, a_order, b_order`` hold the size and the sides."""
    return permutation_sql(position, "n_order", "a_order", "b_order", round_keys(seed, epoch), TURNS)


def sides_sql(size: str) -> str:
    """The columns that ``order_sql`` reads."""
    b = f"(CAST(floor(sqrt(greatest({size} - 1, 0))) AS BIGINT) + 1)"
    return f"CAST({size} AS BIGINT) AS n_order, CAST(({size} + {b} - 1) // {b} AS BIGINT) AS a_order, {b} AS b_order"
