"""Labelled features, a ridge-penalised logistic gate with leave-one-case-out scores, rule impact."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.distributions import finite
from lumenframe.session import cut

# Model features in order.
FEATURES = ("vesselness", "radius_cv", "circularity", "path_mm", "radius_mm", "bone_frac", "adj_lumen_frac")

#: Folds whose sums one matrix product holds, rows of a chunk, and the largest change of a weight at which a fold is settled.
FOLD_BLOCK, CHUNK_ROWS, TOLERANCE = 1024, 2048, 1e-9


def design_rows(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Confirmed rows with every feature finite; ``label`` is 1.0 for confirmed_real."""
    ok = F.col("verdict").isin("confirmed_real", "confirmed_false")
    for f in features:
        ok = ok & finite(f)
    return df.where(ok).withColumn("label", (F.col("verdict") == "confirmed_real").cast("double"))


def fold_scales(rows: DataFrame, features: Sequence[str], fold: str) -> DataFrame:
    """Mean and population deviation of each feature over all rows outside each fold.

    Sums per fold are taken once; the complement of a fold is the total minus the fold. The result
    has one row per fold.
    """
    mid = rows.agg(*[F.avg(f).alias(f"c_{f}") for f in features])  # one row; centring avoids cancellation
    centred = rows.join(F.broadcast(mid))
    sums = [F.count(F.lit(1)).alias("n")]
    for f in features:
        d = F.col(f) - F.col(f"c_{f}")
        sums += [F.sum(d).alias(f"s_{f}"), F.sum(d * d).alias(f"q_{f}")]
    per = centred.groupBy(fold).agg(*sums)
    names = ["n", *[f"{k}_{f}" for f in features for k in ("s", "q")]]
    total = per.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    j = per.join(F.broadcast(total)).join(F.broadcast(mid))
    n = F.col("t_n") - F.col("n")
    out = [F.col(fold), n.alias("n_train")]
    for f in features:
        s, q = F.col(f"t_s_{f}") - F.col(f"s_{f}"), F.col(f"t_q_{f}") - F.col(f"q_{f}")
        mean = s / n
        sd = F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0)))
        out += [(mean + F.col(f"c_{f}")).alias(f"mu_{f}"), F.when(sd < 1e-8, 1.0).otherwise(sd).alias(f"sd_{f}")]
    return j.select(*out)


def standardised(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Each feature minus its mean over its population deviation; near-constant ones keep scale 1."""
    stats = rows.agg(*[F.avg(f).alias(f"mu_{f}") for f in features], *[F.stddev_pop(f).alias(f"sd_{f}") for f in features])
    j = rows.join(F.broadcast(stats))  # one row
    z = {f: (F.col(f) - F.col(f"mu_{f}")) / F.when(F.col(f"sd_{f}") < 1e-8, 1.0).otherwise(F.col(f"sd_{f}")) for f in features}
    return j.withColumns(z).drop(*stats.columns)


def fit_gate(train: DataFrame, features: Sequence[str] = FEATURES, l2: float = 1.0):
    """Mean log-loss plus l2/(2n) of the squared weights, free bias, on standardised features."""
    n = train.count()
    vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(train)
    lr = LogisticRegression(regParam=l2 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10)
    return lr.fit(vec)


def score_gate(model, rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return model.transform(vec).withColumn("p_real", F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability", "prediction")


def leave_one_case_out(rows: DataFrame, features: Sequence[str] = FEATURES, fold: str = "case_id", l2: float = 1.0, block: int = FOLD_BLOCK) -> DataFrame:
    """Held-out score ``p_real`` of every row: one ridge-penalised fit per fold, all folds at once.

    A round is one Newton step of every fold. Rows are packed once into chunks of arrays; a chunk adds up the loss,
    gradient and Gram sums of a block of folds by matrix products, without the rows of each fold itself, and only these sums are shuffled. A
    step that raises a fold's loss is halved. A fold whose training rows have one label scores 0 or 1.
    """
    d = len(features)
    rows = cut(rows.withColumn("__fold", F.coalesce(F.col(fold).cast("string"), F.lit(""))), "folds-in")
    mid = rows.agg(*[F.avg(f).alias(f"c_{f}") for f in features])  # one row; centring avoids cancellation
    ones = rows.groupBy("__fold").agg(F.sum("label").alias("own"))
    every = ones.agg(F.sum("own").alias("every"))
    state = fold_scales(rows, features, "__fold").join(ones, "__fold").join(F.broadcast(every)).join(F.broadcast(mid))
    blocks = max(1, -(-rows.select("__fold").distinct().count() // block))
    share = (F.col("every") - F.col("own")) / F.col("n_train")
    bias = F.when((share > 0) & (share < 1), F.log(share / (1.0 - share))).otherwise(F.lit(0.0))
    state = cut(
        state.select(
            "__fold", F.pmod(F.xxhash64("__fold"), F.lit(blocks)).cast("int").alias("block"), share.alias("share"),
            F.array(*[F.col(f"mu_{f}") - F.col(f"c_{f}") for f in features]).alias("mu"), F.array(*[F.col(f"sd_{f}") for f in features]).alias("sd"),
            F.array(bias, *[F.lit(0.0)] * d).alias("w"), F.array(*[F.lit(0.0)] * (d + 1)).alias("step"), F.lit(float("inf")).alias("loss"), F.lit(True).alias("open"),
        ).where("share > 0 AND share < 1"),
        "folds-state",
    )
    values = [(F.col(f) - F.col(f"c_{f}")).cast("double") for f in features]
    packed = rows.join(F.broadcast(mid)).select("__fold", F.col("label").cast("double").alias("label"), F.array(*values).alias("x"))
    chunks = cut(packed.mapInArrow(_packed(d), "folds array<string>, label array<double>, x array<double>"), "folds-rows")
    chunks = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    n_sums = 1 + (d + 1) + (d + 1) * (d + 2) // 2
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    while not state.where("open").isEmpty():
        live = F.struct("__fold", "mu", "sd", "w")
        models = state.where("open").groupBy("block").agg(F.collect_list(live).alias("models"))  # about ``block`` of them
        parts = chunks.join(models, "block").mapInArrow(_fold_sums(d), "__fold string, " + ", ".join(f"s{i} double" for i in range(n_sums)))
        sums = parts.groupBy("__fold").agg(F.array(*[F.sum(f"s{i}") for i in range(n_sums)]).alias("sums"))
        state = cut(state.join(sums, "__fold", "left").mapInArrow(_newton(d, l2), kinds), "folds-state")
    model = state.select("__fold", "mu", "sd", "w")
    found = rows.join(F.broadcast(mid)).join(model, "__fold", "left").join(ones, "__fold").join(F.broadcast(every))
    line = F.col("w")[0]
    for i, f in enumerate(features):
        line = line + F.col("w")[i + 1] * (F.col(f) - F.col(f"c_{f}") - F.col("mu")[i]) / F.col("sd")[i]
    other = F.when(F.col("every") > F.col("own"), 1.0).otherwise(0.0)
    return found.withColumn("p_real", F.when(F.col("w").isNull(), other).otherwise(1.0 / (1.0 + F.exp(-line)))).select(*[c for c in rows.columns if c != "__fold"], "p_real")


def _packed(d: int):
    """Rows -> one row per Arrow batch that holds them as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK_ROWS):
                some = batch.slice(at, CHUNK_ROWS)
                whole = [some.column(0).to_pylist(), some.column(1).to_numpy(), some.column(2).flatten().to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array([whole[0]], pa.list_(pa.string())), pa.array([whole[1]]), pa.array([whole[2]])], ["folds", "label", "x"])

    return run


def _fold_sums(d: int):
    """A chunk of rows beside a block of folds -> loss, gradient and Gram sums of each fold over the rows outside it."""
    upper = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # numbers stay arrays: as Python objects a batch is many times its size
                chunk, folds, models = (batch.column(c)[at].values for c in ("x", "folds", "models"))
                y, x = batch.column("label")[at].values.to_numpy(), chunk.to_numpy().reshape(-1, d)
                x = np.hstack([np.ones((len(y), 1)), x])
                names = models.field("__fold").to_pylist()
                mu, sd, w = (models.field(k).flatten().to_numpy().reshape(len(names), -1) for k in ("mu", "sd", "w"))
                v = w[:, 1:] / sd
                z = x @ np.hstack([w[:, :1] - (mu * v).sum(axis=1, keepdims=True), v]).T
                p = 1.0 / (1.0 + np.exp(-z))
                loss, miss, spread = np.logaddexp(0.0, z) - y[:, None] * z, p - y[:, None], p * (1.0 - p)
                place = {n: i for i, n in enumerate(names)}
                own = [(i, place[f]) for i, f in enumerate(folds.to_pylist()) if f in place]
                if own:
                    cells = tuple(np.array(own).T)
                    loss[cells], miss[cells], spread[cells] = 0.0, 0.0, 0.0
                pairs = x[:, upper[0]] * x[:, upper[1]]
                sums = np.hstack([loss.sum(axis=0)[:, None], miss.T @ x, spread.T @ pairs])
                yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(c) for c in sums.T]], ["__fold", *[f"s{i}" for i in range(sums.shape[1])]])

    return run


def _newton(d: int, l2: float):
    """Folds beside their sums -> folds after one step, in the scale of each fold's own features."""
    upper = np.triu_indices(d + 1)

    def step(r: dict) -> dict:
        if not r["open"]:
            return r
        sums, mu, sd, w = (np.array(r[k]) for k in ("sums", "mu", "sd", "w"))
        # from centred to standardised features: (1, x) -> (1, (x - mu) / sd)
        scale = np.zeros((d + 1, d + 1))
        scale[0, 0] = 1.0
        scale[1:, 0], scale[1:, 1:] = -mu / sd, np.diag(1.0 / sd)
        gram = np.zeros((d + 1, d + 1))
        gram[upper] = sums[d + 2 :]
        gram = gram + np.triu(gram, 1).T
        pull = np.r_[0.0, np.full(d, l2)]
        loss = sums[0] + 0.5 * (pull * w * w).sum()
        if loss > r["loss"] * (1 + 1e-14):
            last = np.array(r["step"]) / 2.0
            w, last = w - last, last
            return {**r, "w": w.tolist(), "step": last.tolist(), "open": bool(np.abs(last).max() > TOLERANCE)}
        change = -np.linalg.solve(scale @ gram @ scale.T + np.diag(pull), scale @ sums[1 : d + 2] + pull * w)
        return {**r, "w": (w + change).tolist(), "step": change.tolist(), "loss": float(loss), "open": bool(np.abs(change).max() > TOLERANCE)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([step(r) for r in batch.to_pylist()], pa.schema([f for f in batch.schema if f.name != "sums"]))

    return run


def fold_column(rows: DataFrame, folds: int, case: str = "case_id") -> DataFrame:
    """Assigns whole cases to ``folds`` groups."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(case), folds).cast("int"))


def threshold_sweep(df: DataFrame, score: str, label: Column, lo: float = 0.15, hi: float = 0.75, steps: int = 13) -> DataFrame:
    """Confusion counts, precision and recall at evenly spaced thresholds; rows pass at score >= t.

    One pass over the data with two conditional sums per threshold.
    """
    ts = [lo + i * (hi - lo) / (steps - 1) for i in range(steps)]
    s = F.col(score)
    cells = [F.struct(F.lit(t).alias("threshold"), F.count_if(label & (s >= t)).alias("tp"), F.count_if(~label & (s >= t)).alias("fp")) for t in ts]
    one = df.agg(F.array(*cells).alias("c"), F.count_if(label).alias("n_true"), F.count_if(~label).alias("n_false"))
    out = one.select(F.explode("c").alias("c"), "n_true", "n_false").select(
        "c.threshold", "c.tp", (F.col("n_true") - F.col("c.tp")).alias("fn"), (F.col("n_false") - F.col("c.fp")).alias("tn"), "c.fp"
    )
    return out.withColumns(
        {
            "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)),
            "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)),
        }
    )


def safest_threshold(sweep: DataFrame) -> DataFrame:
    """Last threshold that loses no true row, and how many false rows it drops; empty if none."""
    return sweep.where(F.col("fn") == 0).agg(F.max(F.struct("threshold", "tn")).alias("b")).where(F.col("b").isNotNull()).select("b.*")


def rule_impact(df: DataFrame, by: str = "verdict", reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(by), F.lit("unlabeled")).alias(by)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(reason).isNotNull()).alias("n_dropped")
    )


def implied_scores(df: DataFrame, n_gt: int | Column, status: str = "status", reason: str = "reason") -> DataFrame:
    """Precision, recall and F1 if every row with a reason were dropped."""
    keep = F.col(reason).isNull()
    hit = F.col(status) == "draft_match"
    out = df.agg(
        F.count_if(keep & hit).alias("n_match"), F.count_if(keep).alias("n_pred"),
        F.count_if(hit & ~keep).alias("dropped_matches"), F.count_if(~hit & ~keep).alias("dropped_extras"),
    )
    n = F.lit(n_gt) if isinstance(n_gt, int) else n_gt
    out = out.withColumns({"precision": F.col("n_match") / F.greatest("n_pred", F.lit(1)), "recall": F.col("n_match") / n})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", 2.0 * p * r / F.greatest(p + r, F.lit(1e-9)))
