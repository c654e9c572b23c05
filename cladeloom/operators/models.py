"""Model fits that use Spark ML."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeloom.functions import vectors as vx
from cladeloom.functions.arith import ratio
from cladeloom.operators.stats import classifier_metrics
from cladeloom.session import materialize

#: Rows whose outer products are formed at a time.
ROWS_AT_ONCE = 512
#: Rows whose held-out scores are packed together (fewer than 65,536, so that counts fit), and scores of a replicate that one range has.
ROWS_PACKED = 4_096
SCORES_AT_ONCE = 500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def logistic_fit(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Binomial fit: coefficients, McFadden-style 1 - deviance / null deviance, and AUC in one row.

    The rows are formed once, as numbers, and scored once: each of the fit's passes, and of those over its scores, would
    else read the whole input anew.
    """
    rows = materialize(df.select(F.col(vec).alias("_v"), F.col(label).cast("double").alias("label")))
    d = rows.select(array_to_vector("_v").alias("features"), "label")
    m = LogisticRegression(maxIter=100, tol=1e-9).fit(d)
    p = materialize(m.transform(d).select("label", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("z")))
    # from the margin, so that a probability that rounds to 0 or 1 costs nothing or its margin
    ll = F.sum(F.col("label") * F.col("z") - F.greatest("z", F.lit(0.0)) - F.log1p(F.exp(-F.abs("z"))))
    rate = F.avg("label")
    null = F.when((rate > 0) & (rate < 1), F.count("*") * (rate * F.log(rate) + (1 - rate) * F.log1p(-rate)))
    fit = p.agg(ll.alias("log_lik"), (1 - ratio(ll, null)).alias("pseudo_r2"))
    auc = classifier_metrics(p, "p", "label").select("n", "auc", "accuracy")
    coef = F.array(*[F.lit(float(x)) for x in m.coefficients])
    out = auc.withColumns({"log_lik": fit.select("log_lik").scalar(), "pseudo_r2": fit.select("pseudo_r2").scalar(), "intercept": F.lit(float(m.intercept))})
    return out.withColumn("coefficients", F.array_join(F.transform(coef, lambda c: F.round(c, 3)), ","))


def _features(df: DataFrame, vec: str, y: str, fold: Column) -> DataFrame:
    return df.select(array_to_vector(F.col(vec)).alias("features"), F.col(y).cast("double").alias("label"), fold.cast("int").alias("fold"))


def elastic_net_cv(df: DataFrame, vec: str, y: str, fold: Column, folds: int, reg: Sequence[float], mix: Sequence[float]) -> DataFrame:
    """Cross-validated error over penalty and mixing; folds come from a column, so whole clades can be held out."""
    d = _features(df, vec, y, fold)
    lr = LinearRegression(maxIter=100)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg)).addGrid(lr.elasticNetParam, list(mix)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=folds, foldCol="fold", parallelism=4).fit(d)
    rows = [(float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(m), float(sd)) for g, m, sd in zip(grid, cv.avgMetrics, cv.stdMetrics)]
    best = min(r[2] for r in rows)
    return df.sparkSession.createDataFrame([(*r, r[2] == best) for r in rows], "reg double, mix double, rmse double, sd_rmse double, is_best boolean")


def cv_models_table(df: DataFrame, vec: str, y: str, fold: Column, folds: int) -> DataFrame:
    """k-fold R2 of ridge, lasso and a random forest."""
    d = _features(df, vec, y, fold)
    models = {"ridge": LinearRegression(regParam=0.1, elasticNetParam=0.0), "lasso": LinearRegression(regParam=0.01, elasticNetParam=1.0),
              "random_forest": RandomForestRegressor(numTrees=20, maxDepth=4, seed=42)}
    rows = []
    for name, est in models.items():
        cv = CrossValidator(estimator=est, estimatorParamMaps=[{}], evaluator=RegressionEvaluator(metricName="r2"), numFolds=folds, foldCol="fold", parallelism=4).fit(d)
        rows.append((name, float(cv.avgMetrics[0]), float(cv.stdMetrics[0])))
    return df.sparkSession.createDataFrame(rows, "model string, r2 double, sd_r2 double")


def uniform_draws(key: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) for every 64-bit key and replicate."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None, :]
        for m in (_M1, _M2):
            x = (x ^ (x >> np.uint64(30))) * m
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


def training_mask(key: np.ndarray, label: np.ndarray, share: np.ndarray, test: float, replicates: int, seed: int = 42) -> np.ndarray:
    """The first of `holdout_masks`."""
    u, yes = uniform_draws(key, replicates, seed), label == 1
    return (u < np.where(yes, test, share)[:, None]) ^ yes[:, None]


def holdout_masks(key: np.ndarray, label: np.ndarray, share: np.ndarray, rest: np.ndarray, test: float, replicates: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(training, held out) of every row and replicate: a positive is held out with probability `test` and trains otherwise;
    a negative trains with probability `share` (its stratum's) and, if it does not, is held out with probability `rest`."""
    train = training_mask(key, label, share, test, replicates, seed)
    w = uniform_draws(key, replicates, seed + 1)
    return train, ~train & ((label == 1)[:, None] | (w < rest[:, None]))


def count_scores(p: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each score once, in order, with its numbers of positives and negatives."""
    order = np.argsort(p, kind="stable")
    p = p[order]
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    return p[first], np.add.reduceat(yes[order].astype(np.int64), first), np.add.reduceat(no[order].astype(np.int64), first)


def pack_scores(p: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return p.tobytes(), yes.astype(np.uint16).tobytes(), no.astype(np.uint16).tobytes()


def unpack_scores(p: bytes, yes: bytes, no: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(p), np.frombuffer(yes, np.uint16), np.frombuffer(no, np.uint16)


def repeated_holdouts(df: DataFrame, key: str, vec: str, label: str, stratum: str, replicates: int = 1000, test: float = 0.3, seed: int = 42, steps: int = 12) -> DataFrame:
    """Logistic fits on repeated balanced subsets: replicate, n_train, n_test, pseudo_r2, auc, accuracy, acc_positive.

    In every replicate about `test` of the positives are held out; the negatives that train are as many per stratum as give
    the training positives' number in all (all, where a stratum has fewer), and about as many of the other negatives as
    positives are held out.  Membership is a hash of key and replicate, so it costs no shuffle and sizes hold on average.
    All replicates are fitted together: a Newton step is one scan, in which a batch's outer products times the replicates'
    weights give every replicate's Hessian, and one small row per replicate and task is shuffled.  They start from one fit to
    all rows, each with the weight of its chance to train, from which few steps are left.  Only coefficients
    (replicates x features) pass through the driver.  Held-out scores are sorted and packed per replicate and range of
    scores where they are formed, so that a row of the shuffle holds many.  Rows with a null key, vector or label are left out,
    and so are replicates that hold out no row of one of the labels.
    """
    ok = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & F.col(label).isNotNull())
    x = ok.select(F.xxhash64(key).alias("_key"), F.transform(vec, lambda v: v.cast("double")).alias("_x"), F.col(label).cast("int").alias("_y"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_s"))
    sizes = x.groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("yes"), F.count_if(F.col("_y") == 0).alias("no"))
    yes, no, strata = sizes.agg(F.sum("yes"), F.sum("no"), F.count_if(F.col("no") > 0)).first()
    if not yes or not no:
        return df.sparkSession.createDataFrame([], HOLDOUT)
    each = (1 - test) * yes / strata
    share = F.least(F.lit(1.0), ratio(F.lit(each), F.col("no")))
    left = sizes.agg(F.sum(F.col("no") * (1 - share))).first()[0]
    rest = min(1.0, test * yes / left) if left else 0.0
    rows = materialize(x.join(sizes.select("_s", F.coalesce(share, F.lit(0.0)).alias("_share")), "_s").drop("_s"))
    width = rows.select(F.max(F.size("_x"))).first()[0] + 1
    spark, beta = df.sparkSession, np.zeros((replicates, width))
    upper = np.triu_indices(width)

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for pdf in parts:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                p = pdf.iloc[at:at + ROWS_AT_ONCE]
                z = np.vstack(p["_x"].to_numpy())
                yield np.hstack([np.ones((len(z), 1)), z]), p["_y"].to_numpy(), p["_key"].to_numpy(), p["_share"].to_numpy(float)

    def sums(shared, chances: bool, likelihood: bool) -> Callable:
        """Sums of a Newton step for every column of coefficients: over the replicates' training rows, or over all rows by their
        chances to train; the likelihood only where it is asked for."""
        def run(parts):
            b = shared.value
            total = np.zeros((len(b), 3 + width + len(upper[0])))
            for z, y, key_, share_ in blocks(parts):
                train = np.where(y == 1, 1 - test, share_)[:, None] if chances else training_mask(key_, y, share_, test, replicates, seed)
                y = y.astype(float)
                eta = z @ b.T
                mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                outer = (z[:, :, None] * z[:, None, :])[:, upper[0], upper[1]]
                if likelihood:
                    loss = y[:, None] * eta - np.maximum(eta, 0) - np.log1p(np.exp(-np.abs(eta)))
                    total[:, 0] += train.sum(0)
                    total[:, 1] += (train * y[:, None]).sum(0)
                    total[:, 2] += np.where(train, loss, 0).sum(0)
                total[:, 3:3 + width] += (train * (y[:, None] - mu)).T @ z
                total[:, 3 + width:] += (train * (mu * (1 - mu))).T @ outer
            yield pd.DataFrame({"replicate": np.arange(len(b)), "t": list(total)})
        return run

    def scan(b: np.ndarray, chances: bool = False, likelihood: bool = False) -> np.ndarray:
        shared = spark.sparkContext.broadcast(b)
        parts = rows.mapInPandas(sums(shared, chances, likelihood), "replicate int, t array<double>").groupBy("replicate").agg(vx.sum_vector(F.col("t")).alias("t"))
        out = np.array([r["t"] for r in sorted(parts.collect(), key=lambda r: r["replicate"])])
        shared.unpersist()
        return out

    def newton(b: np.ndarray, chances: bool) -> np.ndarray:
        for _ in range(steps):
            t = scan(b, chances)
            h = np.zeros((len(b), width, width))
            h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = t[:, 3 + width:]
            ridge = 1e-9 * (1 + np.trace(h, axis1=1, axis2=2))[:, None, None] * np.eye(width)
            move = np.linalg.solve(h + ridge, t[:, 3:3 + width, None])[:, :, 0]
            b = b + move * np.minimum(1, 10 / (1e-300 + np.abs(move).max(1)))[:, None]
            if np.abs(move).max() < 1e-9:
                break
        return b

    common = newton(np.zeros((1, width)), True)
    beta = newton(np.repeat(common, replicates, 0), False)
    t = scan(beta, likelihood=True)
    shared = spark.sparkContext.broadcast(beta)
    # quantiles of the common scores: any cuts give the same measures, these give ranges of like size
    score = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    ranges = 1 + int(2 * test * yes) // SCORES_AT_ONCE
    terms = sum((F.col("_x")[j] * float(c) for j, c in enumerate(common[0, 1:])), F.lit(float(common[0, 0])))
    cuts = score(np.array(rows.select(terms.alias("z")).approxQuantile("z", [k / ranges for k in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else np.zeros(0)

    def held_out(parts):
        kept, n = [], 0

        def packed():
            z, y, key_, share_ = (np.concatenate(c) for c in zip(*kept))
            kept.clear()
            p, held = np.empty((len(z), replicates), order="F"), np.empty((len(z), replicates), bool, order="F")
            for at in range(0, len(z), ROWS_AT_ONCE):
                s = slice(at, at + ROWS_AT_ONCE)
                p[s] = score(z[s] @ shared.value.T)
                held[s] = holdout_masks(key_[s], y[s], share_[s], np.full(len(z[s]), rest), test, replicates, seed)[1]
            out = []
            for r in range(replicates):
                mine = np.flatnonzero(held[:, r])
                order = mine[np.argsort(p[mine, r])]
                values, label = p[order, r], y[order]
                edges = np.concatenate([[0], np.searchsorted(values, cuts), [len(values)]])
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    s = slice(edges[k], edges[k + 1])
                    out.append((r, k, *pack_scores(*count_scores(values[s], label[s] == 1, label[s] == 0))))
            return pd.DataFrame(out, columns=["replicate", "range", "p", "yes", "no"])

        for block in blocks(parts):
            kept.append(block)
            n += len(block[1])
            if n >= ROWS_PACKED:
                yield packed()
                n = 0
        if kept:
            yield packed()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        p, pos, neg = count_scores(*(np.concatenate(c) for c in zip(*(unpack_scores(*row) for row in zip(pdf["p"], pdf["yes"], pdf["no"])))))
        below = np.cumsum(neg) - neg
        high = p >= 0.5
        return pd.DataFrame({"replicate": pdf["replicate"].iloc[:1], "range": pdf["range"].iloc[:1], "yes": int(pos.sum()), "no": int(neg.sum()),
                             "tp": int(pos[high].sum()), "tn": int(neg[~high].sum()), "twice": float((pos * (2 * below + neg)).sum())})

    scored = rows.mapInPandas(held_out, "replicate int, range int, p binary, yes binary, no binary")
    counts = scored.groupBy("replicate", "range").applyInPandas(meet, "replicate int, range int, yes long, no long, tp long, tn long, twice double")
    before = F.coalesce(F.sum("no").over(Window.partitionBy("replicate").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = counts.withColumn("twice", F.col("twice") + 2.0 * F.col("yes") * before).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("yes", "no", "tp", "tn", "twice")])
    n = F.col("yes") + F.col("no")
    m = m.where("yes > 0 and no > 0").select("replicate", n.alias("n"), ratio(F.col("twice") / 2, F.col("yes").cast("double") * F.col("no")).alias("auc"), ((F.col("tp") + F.col("tn")) / n).alias("accuracy"), ratio(F.col("tp"), F.col("yes")).alias("acc_positive"))
    rate = np.clip(t[:, 1] / np.maximum(t[:, 0], 1), 1e-300, 1)
    null = t[:, 1] * np.log(rate) + (t[:, 0] - t[:, 1]) * np.log1p(-np.minimum(rate, 1 - 1e-16))
    fits = spark.createDataFrame([(i, int(r[0]), float(1 - r[2] / n) if n < 0 else None) for i, (r, n) in enumerate(zip(t, null))], "replicate int, n_train bigint, pseudo_r2 double")
    return fits.join(m, "replicate").select("replicate", "n_train", F.col("n").alias("n_test"), "pseudo_r2", "auc", "accuracy", "acc_positive")


HOLDOUT = "replicate int, n_train bigint, n_test bigint, pseudo_r2 double, auc double, accuracy double, acc_positive double"


def holdout_summary(replicates: DataFrame) -> DataFrame:
    """One row: replicates, and mean and standard deviation of their measures."""
    cols = ("pseudo_r2", "auc", "accuracy", "acc_positive")
    return replicates.agg(F.count("*").alias("replicates"), *[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
