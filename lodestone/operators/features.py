"""Feature projection, label space, calibration and classification metrics, and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numbers import phase
from lodestone.functions.text import first_contained

#: The classes of the outcome model, in order.
CLASSES = ("NFA", "REP", "5s", "10s", "DT", "GRID", "DSQ")


def outcome_class(text: Column) -> Column:
    """Outcome text to class; seconds are read as a number, so 15 seconds are never 5."""
    low = F.lower(text)
    secs = F.try_to_number(F.nullif(F.regexp_extract(low, r"(\d{1,3})[ -]*s(?:ec(?:ond)?s?)?\b", 1), F.lit("")), F.lit("999")).cast("int")
    return (
        F.when(low.rlike(r"no further|\bnfa\b"), "NFA")
        .when(low.contains("reprimand"), "REP")
        .when(low.rlike("drive[- ]through"), "DT")
        .when(low.contains("disqualif"), "DSQ")
        .when(secs <= 5, "5s")
        .when(secs <= 10, "10s")
        .when(secs.isNotNull() | low.contains("grid"), "GRID")
    )


#: Vocabularies in the order in which they are looked for; an underscore stands for any separator.
SESSION_TERMS = ("sprint_qualifying", "sprint", "qualifying", "race", "practice", "formation lap")
TYRE_TERMS = ("soft", "medium", "hard", "intermediate", "wet")
WEATHER_TERMS = ("dry", "wet", "mixed")


def normal_term(value: Column, terms: Sequence[str]) -> Column:
    """The first term contained in a value, case and separators aside; unknown if none is."""
    plain = F.regexp_replace(F.lower(F.btrim(value)), r"[\s\-]+", "_")
    return first_contained(plain, [(t.replace(" ", "_"), t) for t in terms], "unknown")


def incident_features(df: DataFrame) -> DataFrame:
    """The 23 columns of the outcome model from enriched incidents, with defaults for what is missing.

    Input columns: doc_id, season, driver_name, car_number, infraction_type, article_cited,
    session_type, lap_number, total_laps, corner_type, speed_diff_kph, braking_point_delta_m,
    overlap_s, drs_deployed, position_change, safety_car_out, vsc_out, rainfall, compound (of the
    first lap row), penalty_points_ytd, repeat_infraction, outcome, penalty_points. Wet means rain;
    drive phases are thirds of the race; the class index is -1 without a class.
    """
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    number = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")
    label = outcome_class(F.col("outcome"))
    index = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CLASSES]), label) - 1, F.lit(-1)).cast("int")
    return df.select(
        "doc_id", "season", F.coalesce(F.nullif("driver_name", F.lit("")), F.lit("unknown")).alias("driver"), "car_number",
        text("infraction_type"), text("article_cited"), normal_term(F.col("session_type"), SESSION_TERMS).alias("session_type"),
        phase(F.col("lap_number").cast("double"), F.col("total_laps").cast("double")).alias("lap_phase"), text("corner_type"),
        number("speed_diff_kph", "double"), number("braking_point_delta_m", "double"), number("overlap_s", "double"), flag("drs_deployed").alias("drs_deployed"),
        number("position_change", "int"), flag("safety_car_out").alias("safety_car_out"), flag("vsc_out").alias("vsc_out"),
        F.when(flag("rainfall") == 1, "wet").otherwise("dry").alias("weather"), normal_term(F.col("compound"), TYRE_TERMS).alias("tyre_compound"),
        number("penalty_points_ytd", "int"), flag("repeat_infraction").alias("repeat_infraction"),
        label.alias("penalty_class"), index.alias("penalty_class_idx"), F.coalesce("penalty_points", F.lit(0)).cast("int").alias("penalty_points_delta"),
    )


def temporal_split(season: Column, train_to: int = 2023, validate: int = 2024) -> Column:
    """Never random: older seasons train, one validates, newer ones test."""
    return F.when(season <= train_to, "train").when(season == validate, "validate").otherwise("test")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(every)).select(label, "n", F.round(F.col("_all") / (F.col("_k") * F.col("n")), 6).alias("weight"))


def calibration_bins(df: DataFrame, probability: str, hit: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) over [low, high); a probability of 1 falls in no bin."""
    b = df.withColumn("bin", F.floor(F.col(probability) * bins).cast("int")).where(F.col("bin").between(0, bins - 1))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("confidence"), F.avg(hit.cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, probability: str, hit: Column, bins: int = 10) -> DataFrame:
    """One row (ece): gaps of the bins weighted by their share of all rows."""
    b = calibration_bins(df, probability, hit, bins)
    every = df.agg(F.count(F.lit(1)).alias("_all"))
    gaps = b.crossJoin(F.broadcast(every)).agg(F.sum(F.col("n") / F.col("_all") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("_e"))
    return gaps.select(F.round(F.coalesce("_e", F.lit(0.0)), 6).alias("ece"))


def class_calibration_error(df: DataFrame, distribution: str, truth: str, classes: int, bins: int = 10) -> DataFrame:
    """One row (ece): the calibration error of each class against the rest (truth is its index), averaged over classes."""
    rows = df.select(truth, F.posexplode(distribution).alias("_class", "_p"))
    rows = rows.withColumn("bin", F.floor(F.col("_p") * bins).cast("int"))
    every = df.agg(F.count(F.lit(1)).alias("_all"))
    b = rows.where(F.col("bin").between(0, bins - 1)).groupBy("_class", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("c"), F.avg((F.col(truth) == F.col("_class")).cast("double")).alias("a"))
    total = b.crossJoin(F.broadcast(every)).agg(F.sum(F.col("n") / F.col("_all") * F.abs(F.col("a") - F.col("c"))).alias("_e"))
    return total.select(F.round(F.coalesce("_e", F.lit(0.0)) / classes, 6).alias("ece"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1): 0 where a denominator is 0; one narrow count, then small sums."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("s")).select("s.*")
    t = sides.groupBy("label").agg(F.sum("actual").alias("support"), F.sum("guessed").alias("_guessed"), F.sum("hit").alias("_hit"))
    precision, recall = F.coalesce(F.try_divide("_hit", "_guessed"), F.lit(0.0)), F.coalesce(F.try_divide("_hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return t.select("label", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return class_report(df, truth, predicted).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def expand_labels(probabilities: Column, present: Sequence[str], classes: Sequence[str] = CLASSES) -> Column:
    """Probabilities of the present classes laid out over all classes, 0 for absent ones."""
    at = {name: i for i, name in enumerate(present)}
    return F.array(*[F.element_at(probabilities, at[c] + 1) if c in at else F.lit(0.0) for c in classes])


def best_class(distribution: Column, classes: Sequence[str] = CLASSES) -> tuple[Column, Column]:
    """(class, confidence to 4 decimals) of the greatest probability, the first of equals."""
    top = F.array_max(distribution)
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(distribution, top).cast("int")), F.round(top, 4)


def outcome_model(categorical: Sequence[str], numeric: Sequence[str], label: str, trees: int = 40, depth: int = 4, rate: float = 0.05, seed: int = 3):
    """An unfitted pipeline: index, one-hot (unknown kept), scale, boosted trees for each class against the rest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    indexed, hot = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    return Pipeline(stages=[
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep"),
        VectorAssembler(inputCols=[*hot, *numeric], outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"),
        OneVsRest(classifier=boosted),
    ])


def ship_gate(f1: float, ece: float, least_f1: float = 0.65, most_ece: float = 0.05) -> bool:
    return f1 >= least_f1 and ece < most_ece


def latest_share(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of each key's newest group only."""
    newest = F.max(F.struct(*order)).over(Window.partitionBy(*keys))
    return df.withColumn("_newest", newest).where(F.struct(*order) == F.col("_newest")).drop("_newest")


def platt(train: DataFrame, score: str, label: str):
    """A logistic fit of the label on one score: sigmoid calibration."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_s"), LogisticRegression(featuresCol="_s", labelCol=label, probabilityCol="calibrated", rawPredictionCol="_raw", predictionCol="_guess")]).fit(train)


def stack(train: DataFrame, parts: Sequence[str], label: str, folds: int = 3, seed: int = 3):
    """A multinomial logistic fit over the class distributions of several models; its penalty is chosen by cross-validation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    fit = LogisticRegression(featuresCol="_stack", labelCol=label, family="multinomial")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(parts), outputCol="_stack"), fit])
    grid = ParamGridBuilder().addGrid(fit.regParam, [0.001, 0.1]).build()
    loss = MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss")
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=loss, numFolds=folds, seed=seed).fit(train)


def two_clusters(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(grp, key, cluster): average-link clustering of unit vectors into two, the larger one (the speaker) is 0."""
    from lodestone.operators.clusters import average_link

    return average_link(df, group, key, vector)
