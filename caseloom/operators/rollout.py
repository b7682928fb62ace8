"""Continuations from transition tables: greedy, sampled, and consensus.

A step needs only the last ``order`` labels, so greedy continuation runs once per *distinct* context and
is joined back to the prefixes.  Sampled rows advance in lock step; the frontier is written every few
steps, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import EOS, hash_unit
from caseloom.operators import sparse
from caseloom.operators.metrics import dl_similarity, medoid
from caseloom.operators.transitions import TransitionModel, argmax_table, context_columns, context_key
from caseloom.session import lookup_side, materialize, materialize_counted


def _value_of_context(df: DataFrame, table: DataFrame, order: int, value: str, default: Column) -> Column | DataFrame:
    """Add ``_v``: the table's value for the longest known context of each row."""
    hits = []
    for k in range(order, 0, -1):
        t = lookup_side(table.where(F.col("k") == k).select(F.col("ctx").alias(f"_x{k}"), F.col(value).alias(f"_v{k}")))
        df = df.withColumn(f"_key{k}", context_key(order, k)).join(t, F.col(f"_key{k}") == F.col(f"_x{k}"), "left").drop(f"_key{k}", f"_x{k}")
        hits.append(f"_v{k}")
    base = table.where(F.col("k") == 0).agg(F.first(value).alias("v")).scalar()  # order 0 has one row
    return df.withColumn("_v", F.coalesce(*hits, base, default)).drop(*hits)


def _advance(front: DataFrame, nxt: Column, cols: list[str]) -> DataFrame:
    """Append the next label to live rows and shift their context; the end label stops a row."""
    f = front.withColumn("_n", F.when(F.col("_alive"), nxt)).drop("_v")
    go = F.coalesce(F.col("_n") != EOS, F.lit(False))
    shift = {a: F.when(go, F.col(b)).otherwise(F.col(a)) for a, b in zip(cols[:-1], cols[1:])}
    return f.withColumns({
        **shift, cols[-1]: F.when(go, F.col("_n")).otherwise(F.col(cols[-1])),
        "suffix": F.when(go, F.concat("suffix", F.array("_n"))).otherwise(F.col("suffix")), "_alive": go,
    }).drop("_n")


def _loop(front: DataFrame, table: DataFrame, value: str, default: Column, pick, order: int, max_len: int, every: int) -> DataFrame:
    cols = context_columns(order)
    for step in range(max_len):
        front = _advance(_value_of_context(front, table, order, value, default), pick(step), cols)
        if (step + 1) % every == 0 and step + 1 < max_len:
            front = materialize(front, "rollout")
            if front.where("_alive").isEmpty():
                break
    return front


def _start(df: DataFrame) -> DataFrame:
    return df.withColumns({"suffix": F.array().cast("array<int>"), "_alive": F.lit(True)})


def _key(cols: list[str], names: list[str] | None = None) -> Column:
    return F.concat_ws(">", *[F.col(c).cast("string") for c in (names or cols)])


def context_steps(starts: DataFrame, m: TransitionModel) -> DataFrame:
    """(key, emit, dst): one greedy step for every context reachable from ``starts``; dst is null at the end label.

    The walk begins at the start contexts and every full context of the model, then expands level by level
    until nothing new is reached; the table follows the model's size, not the data.
    """
    cols = context_columns(m.order)
    best = materialize(argmax_table(m), "argmax")
    parts = F.split("ctx", ">")
    trained = best.where(F.col("k") == m.order).select(F.col("ctx").alias("key"), *[parts[i].cast("int").alias(c) for i, c in enumerate(cols)])
    level = starts.select(_key(cols).alias("key"), *cols).unionByName(trained).distinct()
    known = None
    while True:
        step = _value_of_context(level, best, m.order, "best", F.lit(0)).withColumnRenamed("_v", "emit")
        go = F.col("emit") != EOS
        moved = [*[F.col(b) for b in cols[1:]], F.col("emit")]
        step = step.select("key", "emit", *[F.when(go, c).alias(f"n_{a}") for a, c in zip(cols, moved)])
        step = materialize(step.withColumn("dst", F.when(F.col("emit") != EOS, _key(cols, [f"n_{c}" for c in cols]))), "steps")
        known = step if known is None else known.unionByName(step)
        fresh = step.where(F.col("dst").isNotNull()).select(F.col("dst").alias("key"), *[F.col(f"n_{c}").alias(c) for c in cols]).distinct()
        level, n_new = materialize_counted(fresh.join(known.select("key"), "key", "left_anti"), "level")
        if not n_new:
            return known.select("key", "emit", "dst")


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """Follow ``first``, then ``then`` from where it stopped."""
    nxt = then.select(F.col("key").alias("dst"), F.col("suffix").alias("_s"), F.col("dst").alias("_d"))
    out = first.join(lookup_side(nxt, "jump"), "dst", "left")
    return out.select("key", F.concat("suffix", F.coalesce("_s", F.array().cast("array<int>"))).alias("suffix"), F.col("_d").alias("dst"))


def greedy(prefixes: DataFrame, m: TransitionModel, max_len: int = 50) -> DataFrame:
    """Prefixes with ``pred``: the greedy continuation up to the end label or ``max_len``.

    Contexts form a functional graph, so continuations of 1, 2, 4, ... steps follow from each other
    (about log2(max_len) joins of a small table instead of max_len).
    """
    cols = context_columns(m.order)
    steps = context_steps(prefixes, m)
    jump = steps.select("key", F.when(F.col("dst").isNotNull(), F.array("emit")).otherwise(F.array().cast("array<int>")).alias("suffix"), "dst")
    total, left = None, max_len
    while left:
        if left & 1:
            total = jump if total is None else _compose(total, jump)
        left >>= 1
        if left:
            jump = materialize(_compose(jump, jump), "jump")
    done = lookup_side(total.select(F.col("key").alias("_key"), F.col("suffix").alias("pred")), "greedy")
    return prefixes.withColumn("_key", _key(cols)).join(done, "_key").drop("_key")


def sample(prefixes: DataFrame, m: TransitionModel, max_len: int, n: int = 5, seed: int = 0, every: int = 8) -> DataFrame:
    """(case_id, pos, sample, suffix): ancestral continuations; each draw is a hash of (case, pos, sample, step)."""
    table = materialize(m.probs.select("k", "ctx", sparse.intervals("dist").alias("cum")), "distributions")
    front = _start(prefixes.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))

    def pick(step: int) -> Column:
        u = hash_unit(seed, "case_id", "pos", "sample", F.lit(step))
        return sparse.draw_interval("_v", u)

    return _loop(front, table, "cum", sparse.intervals(sparse.uniform(m.size)), pick, m.order, max_len, every)


def consensus(samples: DataFrame, truth: DataFrame, keys=("case_id", "pos")) -> DataFrame:
    """Per prefix: mean similarity of the samples, any exact match, and the medoid sample.

    The number of samples per prefix is the sampling parameter, so each group is small by construction.
    """
    s = samples.join(truth, list(keys)).withColumn("sim", dl_similarity("suffix", "true"))
    g = s.groupBy(*keys).agg(
        F.avg("sim").alias("mean_sim"), F.max((F.col("suffix") == F.col("true")).cast("int")).alias("any_exact"),
        F.transform(F.sort_array(F.collect_list(F.struct("sample", "suffix", "sim"))), lambda x: x).alias("_s"))
    g = g.withColumn("_m", medoid(F.transform("_s", lambda x: x["suffix"])))
    best = F.element_at("_s", F.col("_m")["medoid"] + 1)
    return g.select(*keys, "mean_sim", "any_exact", F.col("_m")["medoid"].alias("medoid"), best["suffix"].alias("medoid_suffix"), best["sim"].alias("medoid_sim"))
