"""Cell-wise injection and resampling (J10-J16): per-cell Bernoulli masks, the
importance-weighted variant, the one-row guard, negative sampling and bootstrap
weights.  Every draw is a hash of (seed, salt, row, column): partition-free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash_key, hash_unit, sql_hash_key, sql_hash_unit

def _cell_u(seed, c: str, row_id: str):
    return hash_unit(hash_key(seed, f"cell:{c}", row_id))


def systematic_rates(importance: dict, p: float, cap: float = 0.95) -> dict:
    """Column rate proportional to the clipped importance, scaled by p * d, capped."""
    clipped = {c: max(v, 0.0) + 1e-100 for c, v in importance.items()}
    total = sum(clipped.values())
    d = len(clipped)
    return {c: min(cap, v / total * p * d) for c, v in clipped.items()}


def random_cells(df: DataFrame, rates, seed: int, row_id: str = "row_id", columns=None,
                 guard: bool = True) -> DataFrame:
    """Null each cell when its uniform draw <= the column rate.

    ``rates``: one float for all ``columns`` ("random") or {column: rate}
    ("systematic").  With ``guard``, a row that would lose every cell keeps
    int(d * (1 - p)) of them: the cells with the smallest restore draws."""
    if not isinstance(rates, dict):
        rates = {c: float(rates) for c in columns}
    cols = list(rates)
    d = len(cols)
    hit = {c: _cell_u(seed, c, row_id) <= F.lit(rates[c]) for c in cols}
    staged = df.withColumns({f"__m_{c}": hit[c] for c in cols})
    if guard:
        all_hit = None
        for c in cols:
            all_hit = F.col(f"__m_{c}") if all_hit is None else (all_hit & F.col(f"__m_{c}"))
        mean_p = sum(rates.values()) / d
        keep = int(d * (1 - mean_p))
        # rank of each column's restore draw inside the row (small fixed width d)
        ranks = {}
        for c in cols:
            uc = hash_unit(hash_key(seed, f"restore:{c}", row_id))
            r = F.lit(0)
            for o in cols:
                if o != c:
                    uo = hash_unit(hash_key(seed, f"restore:{o}", row_id))
                    r = r + ((uo < uc) | ((uo == uc) & F.lit(o < c))).cast("int")
            ranks[c] = r
        staged = staged.withColumns({f"__m_{c}": F.col(f"__m_{c}") & ~(all_hit & (ranks[c] < keep)) for c in cols})
    out = staged.withColumns({c: F.when(F.col(f"__m_{c}"), F.lit(None).cast(df.schema[c].dataType))
                              .otherwise(F.col(c)) for c in cols})
    return out.drop(*[f"__m_{c}" for c in cols])


def sql_random_cells(src: str, rates: dict, seed: int, row_id: str = "row_id", guard: bool = False) -> str:
    """Twin of ``random_cells``."""
    cols = list(rates)
    hit = {c: f"({sql_hash_unit(sql_hash_key(seed, f'cell:{c}', row_id))} <= CAST({rates[c]!r} AS DOUBLE))" for c in cols}
    if not guard:
        repl = ", ".join(f"CASE WHEN {hit[c]} THEN NULL ELSE {c} END AS {c}" for c in cols)
        return f"SELECT * REPLACE ({repl}) FROM ({src})"
    keep = int(len(cols) * (1 - sum(rates.values()) / len(cols)))
    u = {c: f"__u_{i}" for i, c in enumerate(cols)}
    h = {c: f"__h_{i}" for i, c in enumerate(cols)}
    inner = ", ".join([f"{hit[c]} AS {h[c]}" for c in cols] +
                      [f"{sql_hash_unit(sql_hash_key(seed, f'restore:{c}', row_id))} AS {u[c]}" for c in cols])
    all_hit = " AND ".join(h[c] for c in cols)
    repl = []
    for c in cols:
        rank = " + ".join(f"CAST(({u[o]} < {u[c]}) OR ({u[o]} = {u[c]} AND {str(o < c).upper()}) AS INTEGER)"
                          for o in cols if o != c) or "0"
        repl.append(f"CASE WHEN {h[c]} AND NOT (({all_hit}) AND ({rank}) < {keep}) THEN NULL ELSE {c} END AS {c}")
    drop = ", ".join(list(u.values()) + list(h.values()))
    return f"SELECT * EXCLUDE ({drop}) REPLACE ({', '.join(repl)}) FROM (SELECT *, {inner} FROM ({src}))"


def poisson_bars() -> list[float]:
    """The distribution function of Poisson(1) at 0, 1, 2, ... up to where a draw with 32
    bits cannot lie beyond it: no copy count is cut."""
    import math
    out, acc, term, k = [], 0.0, math.exp(-1.0), 0
    while acc < 1 - 2.0 ** -33:
        acc += term
        out.append(acc)
        k += 1
        term /= k
    return out


def bootstrap(df: DataFrame, seed: int, row_id: str = "row_id", replica: int = 0) -> DataFrame:
    """Bootstrap with replacement as hash-Poisson(1) copy counts per row
    (the distributed form of drawing n rows with replacement); copies exploded."""
    u = hash_unit(hash_key(seed, f"boot:{replica}", row_id))
    count = sum(((u >= F.lit(bar)).cast("int") for bar in poisson_bars()), F.lit(0))
    return (df.withColumn("__copies", count).where("__copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies"))


def negative_samples(obs: DataFrame, levels: DataFrame, seed: int, row="row_id", item="col_id",
                     value="value", level="level") -> DataFrame:
    """For each row, add (positives - negatives) zeros among unobserved
    items whose level exceeds the row's highest observed level (as many as exist).

    The items of a level are put in one hashed order, the same for every row; a row starts at a
    hashed place of each level above its own and takes items from there on, as many as it
    wants plus as many as it has observed on that level, so that enough unobserved ones are among
    them.  Candidates per row and level are bounded by the row's own size, not the
    catalog's.

    obs: (row, item, value) observed cells; levels: (item, level) catalog.
    Returns the new (row, item, value=0) cells."""
    lv = levels.select(F.col(item), F.col(level))
    per_row = (obs.join(lv, item).groupBy(row).agg(F.max(level).alias("max_level"), F.count(F.lit(1)).alias("n_obs"),
                                                   F.count_if(F.col(value) > 0).alias("n_pos"), F.count_if(F.col(value) == 0).alias("n_neg"))
               .where(F.col("n_pos") > F.col("n_neg")))
    order = F.row_number().over(Window.partitionBy(level).orderBy(hash_key(seed, "item", F.col(item)), item)) - 1
    placed = lv.withColumn("place", order)
    size = placed.groupBy(level).agg(F.count(F.lit(1)).alias("size"))
    above = per_row.join(size, F.col(level) > F.col("max_level"))  # one row per level of the catalog
    want = F.least(F.col("size"), F.col("n_pos") - F.col("n_neg") + F.col("n_obs"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col(row), F.col(level)), F.col("size"))
    cand = (above.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("bigint"), want - 1)))
            .withColumn("place", F.pmod(start + F.col("__o"), F.col("size")).cast("int"))
            .join(placed, [level, "place"]).join(obs.select(row, item), [row, item], "left_anti"))
    w = Window.partitionBy(row).orderBy("__u", item)  # a row's own candidates
    return (cand.withColumn("__u", hash_unit(hash_key(seed, "neg", F.concat_ws(":", F.col(row).cast("string"),
                                                                              F.col(item).cast("string")))))
            .withColumn("__r", F.row_number().over(w))
            .where(F.col("__r") <= F.col("n_pos") - F.col("n_neg"))
            .select(row, item, F.lit(0.0).alias(value)))
