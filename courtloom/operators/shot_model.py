"""Make / miss model: median imputation, boosted trees, leave-one-game-out, threshold grid.

Rows that agree in all that a model reads are counted first, and one row with that weight stands for them: boosted trees
read their rows for every level and round, so what they read grows with the distinct rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from courtloom.operators import ordered as O
from courtloom.operators.scoring import count_if
from courtloom.session import cut_lineage


def fit(train: DataFrame, features: Sequence[str], label: str = "label", depth: int = 4, rounds: int = 20, seed: int = 42, weight: str | None = None):
    known = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    times = F.lit(1) if weight is None else F.col(weight)
    middle = train.select(*[F.percentile(known[f], 0.5, times).alias(f) for f in features]).first()
    fills = [f"coalesce(nanvl(cast(`{f}` as double), cast(null as double)), {0.0 if middle[f] is None else middle[f]!r}D) as `{f}_f`" for f in features]
    trees = GBTClassifier(featuresCol="x", labelCol=label, maxDepth=depth, maxIter=rounds, seed=seed)
    return Pipeline(stages=[
        SQLTransformer(statement=f"select *, {', '.join(fills)} from __THIS__"), VectorAssembler(inputCols=[f"{f}_f" for f in features], outputCol="x"),
        trees if weight is None else trees.setWeightCol(weight)]).fit(train)


def predict(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("prob"))


def threshold_curve(pred: DataFrame, lo: float = 0.20, hi: float = 0.85, step: float = 0.005, target: float = 0.90, weight: str | None = None) -> DataFrame:
    """Precision / recall shortfall per threshold; a row counts `weight` times. Scores are reduced to counts per threshold step first, so
    the grid meets a table of that size and not the predictions."""
    n = round((hi - lo) / step)
    bucket = F.least(F.greatest(F.floor((F.col("prob") - lo) / step + 1e-9), F.lit(-1)), F.lit(n)).cast("int")
    times = F.lit(1) if weight is None else F.col(weight)
    hist = pred.groupBy(bucket.alias("b")).agg(F.sum(F.col("label") * times).alias("pos"), F.sum(times).alias("all"))
    grid = pred.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    tot = hist.join(F.broadcast(grid)).groupBy("i").agg(
        F.sum(F.when(F.col("b") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("b") >= F.col("i"), F.col("all")).otherwise(0)).alias("called"), F.sum("pos").alias("pos"))
    p, r = F.col("tp") / F.col("called"), F.col("tp") / F.col("pos")
    zero = F.lit(0.0)
    return tot.filter("called > 0").select(
        (lo + F.col("i") * step).alias("thr"), p.alias("precision"), r.alias("recall"), (-(F.greatest(target - p, zero) + F.greatest(target - r, zero))).alias("score"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """Largest score; the lowest threshold wins ties."""
    return curve.agg(F.max(F.struct("score", (-F.col("thr")).alias("nt"))).alias("b")).select((-F.col("b.nt")).alias("thr"), F.col("b.score").alias("score"))


def area_under_curve(pred: DataFrame, keys: Sequence[str], prob: str = "prob", label: str = "label", steps: float = 1e9) -> DataFrame:
    """(keys, auc): the share of pairs of a positive and a negative row that the score puts in order, ties half.

    Rows become counts for each score first (to nine places); the ranks are running sums over those in blocks, so no key is
    sorted in one task, and all sums are whole numbers. Null where a key has rows of one label only."""
    keys = list(keys)
    score = F.floor(F.col(prob) * steps + 0.5).cast("long")
    counts = pred.groupBy(*keys, score.alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    ranked = O.running_sum(counts, keys, "_s", F.col("neg"), "upto", int(steps) // 256)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * (2 * F.col("upto") - F.col("neg"))).alias("twice"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("twice") / (2.0 * F.col("p") * F.col("n"))).alias("auc"))


def held_out_predictions(df: DataFrame, features: Sequence[str], keep: Sequence[str], max_models: int = 16, parallel: int = 4, **how) -> DataFrame:
    """(game, keep, label, prob, thr): every row scored by a model that has not seen its game, with the threshold that was best
    on the validation rows of that model's own games.

    Each game is held out in turn; beyond `max_models` games they are dealt to that many groups by a hash, and a group is
    held out together. `parallel` models train at a time, over one checkpoint of the counted rows."""
    spark = df.sparkSession
    games = df.select("game").distinct().limit(max_models + 1).collect()      # bounded by max_models
    if len(games) <= max_models:
        order = F.array(*[F.lit(g) for g in sorted(r["game"] for r in games)]) if games else F.array()
        fold, n = F.array_position(order, F.col("game")) - 1, len(games)
    else:
        fold, n = F.pmod(F.xxhash64("game"), F.lit(max_models)), max_models
    times, read = "_times", [*features, "label"]
    counted = lambda rows, by, how: rows.groupBy(*dict.fromkeys(by)).agg(how.alias(times))      # noqa: E731
    alike = counted(df, ["game", *keep, *read, "split"], F.count(F.lit(1)))
    rows = cut_lineage(alike.withColumn("_fold", fold.cast("int")))

    def held_out(k: int) -> DataFrame:
        others = counted(rows.filter(F.col("_fold") != k), [*read, "split"], F.sum(times))
        model = fit(others.filter("split = 'train'"), features, weight=times, **how)
        judged = predict(model, others.filter("split <> 'train'"), ["label", times])
        thr = best_threshold(threshold_curve(judged, weight=times))
        return predict(model, rows.filter(F.col("_fold") == k), ["game", *keep, "label", times]).join(F.broadcast(thr.select("thr")))      # one row

    with ThreadPool(max(1, min(parallel, n))) as pool:
        parts = pool.map(inheritable_thread_target(spark)(held_out), range(n))
    empty = rows.limit(0).select("game", *keep, "label", times, F.lit(0.0).alias("prob"), F.lit(0.0).alias("thr"))
    scored = cut_lineage(reduce(DataFrame.unionByName, parts, empty))
    return scored.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), times))).drop(times)


def accuracy_by_game(pred: DataFrame, cls: str) -> DataFrame:
    """(game, cls, n, correct, thr): accuracy of held-out predictions per game and class, with a null class for the whole game."""
    hit = (F.col("prob") >= F.col("thr")).cast("long") == F.col("label")
    sets = pred.groupingSets([["game", cls], ["game"]], "game", cls)
    return sets.agg(F.count(F.lit(1)).alias("n"), count_if(hit).alias("correct"), F.max("thr").alias("thr"))


def model_report(pred: DataFrame) -> DataFrame:
    """(game, n, accuracy, precision, recall, auc, thr) of held-out predictions; precision and recall are 0 where they have
    no rows."""
    called, label = F.col("prob") >= F.col("thr"), F.col("label") == 1
    zero = F.lit(0.0)
    g = pred.groupBy("game").agg(F.count(F.lit(1)).alias("n"), count_if(called == label).alias("right"), count_if(called & label).alias("tp"),
                                 count_if(called).alias("called"), count_if(label).alias("pos"), F.max("thr").alias("thr"))
    share = lambda over: F.when(F.col(over) > 0, F.col("tp") / F.col(over)).otherwise(zero)      # noqa: E731
    report = g.select("game", "n", (F.col("right") / F.col("n")).alias("accuracy"), share("called").alias("precision"), share("pos").alias("recall"), "thr")
    return report.join(area_under_curve(pred, ["game"]), "game")
