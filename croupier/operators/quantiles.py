"""Exact linear-interpolation quantiles without gathering a column in one task.

Spark's exact ``percentile`` aggregate keeps every value of the group in one buffer. Here each
order statistic (of any number of columns) is bracketed and the brackets are narrowed:

1. non-null counts per column;
2. ``percentile_approx`` (a mergeable sketch, partially aggregated on every task) brackets each
   wanted rank within ``+-n/accuracy`` ranks;
3. one pass counts, per rank, the values below and inside its bracket and their distinct number.
   A bracket with at most ``MAX_DISTINCT`` distinct values is finished from its (value, count)
   pairs, so equal values are one pair however often they occur; a wider one gets a new sketch
   of its inside and goes round again.

What reaches the driver is at most ``MAX_DISTINCT`` pairs per rank, whatever the size of the data.

The interpolation rule matches ``percentile``/``quantile_cont``: with ``pos = (n-1)p``,
``q = x[floor(pos)] + (x[ceil(pos)] - x[floor(pos)]) * (pos - floor(pos))``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000
MAX_DISTINCT = 5_000


def _x(col: str) -> F.Column:
    c = F.col(col).cast("double")
    return F.when(~F.isnan(c), c)


def exact_quantile_row(df: DataFrame, specs: dict[str, tuple[str, float]], accuracy: int = DEFAULT_ACCURACY) -> dict[str, float | None]:
    """Named exact quantiles ``{name: (column, p)}`` computed together."""
    cols = sorted({c for c, _ in specs.values()})
    idx = {c: i for i, c in enumerate(cols)}
    data = df.select(*[_x(c).alias(f"c{i}") for i, c in enumerate(cols)])
    counts = data.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))]).first()
    n = {c: int(counts[f"n{idx[c]}"]) for c in cols}

    wanted: dict[str, set[int]] = {c: set() for c in cols}
    for c, p in specs.values():
        if n[c]:
            pos = (n[c] - 1) * p
            wanted[c] |= {math.floor(pos), math.ceil(pos)}
    stats = _order_statistics(data, idx, n, {c: sorted(r) for c, r in wanted.items() if r}, accuracy)

    out: dict[str, float | None] = {}
    for name, (c, p) in specs.items():
        if not n[c]:
            out[name] = None
            continue
        pos = (n[c] - 1) * p
        lo_r, hi_r = math.floor(pos), math.ceil(pos)
        lo, hi = stats[(c, lo_r)], stats[(c, hi_r)]
        out[name] = lo + (hi - lo) * (pos - lo_r)
    return out


def exact_quantiles(df: DataFrame, col: str, probs: list[float], accuracy: int = DEFAULT_ACCURACY) -> list[float | None]:
    res = exact_quantile_row(df, {f"q{i}": (col, p) for i, p in enumerate(probs)}, accuracy)
    return [res[f"q{i}"] for i in range(len(probs))]


def _brackets(data: DataFrame, wanted: dict, inside: dict, accuracy: int) -> dict:
    """(rank key) -> (low, high) around its rank among the ``inside`` values of its column.

    ``wanted`` maps a key to (column, rank, count) counted within its present bracket.
    """
    sketches = []
    for i, (key, (col, rank, n)) in enumerate(wanted.items()):
        slack = 2.0 / accuracy + 1.0 / n
        q = rank / max(n - 1, 1)
        x = F.col(col) if key not in inside else F.when(F.col(col).between(*inside[key]), F.col(col))
        sketches.append(F.percentile_approx(x, [max(0.0, q - slack), min(1.0, q + slack)], accuracy).alias(f"s{i}"))
    row = data.agg(*sketches).first()
    return {key: tuple(row[f"s{i}"]) for i, key in enumerate(wanted)}


def _order_statistics(data: DataFrame, idx: dict[str, int], n: dict[str, int], ranks: dict[str, list[int]], accuracy: int):
    pending = {(c, r): f"c{idx[c]}" for c, rs in ranks.items() for r in rs}
    if not pending:
        return {}
    bracket = _brackets(data, {k: (col, k[1], n[k[0]]) for k, col in pending.items()}, {}, accuracy)
    out: dict[tuple[str, int], float] = {}
    while pending:
        aggs = []
        for i, (key, col) in enumerate(pending.items()):
            lo, hi = bracket[key]
            x, mine = F.col(col), F.col(col).between(lo, hi)
            aggs += [F.count(F.when(x < F.lit(lo), 1)).alias(f"below{i}"), F.count(F.when(mine, 1)).alias(f"in{i}"),
                     F.approx_count_distinct(F.when(mine, x)).alias(f"kinds{i}")]
        got = data.agg(*aggs).first()
        ready, wide = {}, {}
        for i, (key, col) in enumerate(pending.items()):
            lo, hi = bracket[key]
            place, size = key[1] - got[f"below{i}"], got[f"in{i}"]
            if place < 0:  # the sketch missed the rank: widen towards the side that holds it
                bracket[key] = (float("-inf"), lo)
            elif place >= size:
                bracket[key] = (hi, float("inf"))
            elif lo == hi:
                out[key] = float(lo)
            elif min(size, got[f"kinds{i}"]) <= MAX_DISTINCT:
                ready[key] = (col, place)
            else:
                wide[key] = (col, place, size)
        if ready:
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.when(F.col(col).between(*bracket[key]), F.col(col)).alias("x"))
                                       for i, (key, (col, _)) in enumerate(ready.items())]))
            pairs = data.select(each.alias("e")).filter("e.x IS NOT NULL").groupBy("e.k", "e.x").agg(F.count(F.lit(1)).alias("n")).collect()
            for i, (key, (_, place)) in enumerate(ready.items()):
                for x, count in sorted((p.x, p.n) for p in pairs if p.k == i):
                    if place < count:
                        out[key] = float(x)
                        break
                    place -= count
        if wide:
            bracket.update(_brackets(data, wide, {k: bracket[k] for k in wide}, accuracy))
        pending = {k: col for k, col in pending.items() if k not in out}
    return out
