"""A final fit as a versioned bundle of tables, and its use on new rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .nested import batch_rank, final_fit, predict
from .ranks import ecdf_percentile

VERSION = 1


@dataclass
class Artifact:
    """What a bundle holds: the fit, the sorted scores of its own rows, the medians of its features, and what it says of itself."""

    fit: DataFrame
    reference: DataFrame
    medians: dict[str, float]
    features: list[str]
    forbidden: list[str]
    status: str
    digest: str


def _digest(fit: DataFrame, reference: DataFrame, about: Sequence[str]) -> str:
    """SHA-256 of the coefficients, of a sum of hashes of the reference scores, which no order changes, and of the description."""
    row = fit.first()
    scores = reference.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("prediction").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    text = "|".join([str(VERSION), repr(row.intercept), *map(repr, row.coefficients), str(scores.n), str(scores.h), *about])
    return reference.sparkSession.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


def _filled(rows: DataFrame, medians: dict[str, float]) -> DataFrame:
    return rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in medians.items()})


def save_artifact(rows: DataFrame, target: str, features: Sequence[str], alpha: float, path: str, accepted: bool, forbidden: Sequence[str] = (), allow_rejected: bool = False, decimals: int = 9) -> None:
    """Fit all ``rows`` and write the bundle: fit, reference scores, feature medians and a description with a digest, each as Parquet under ``path``.

    A fit whose validation wasn't accepted is an error unless ``allow_rejected``; it is then written with the status experimental_rejected.
    Missing features are filled with the medians, here and in :func:`score_with`. Scores are kept at ``decimals``.
    """
    if not accepted and not allow_rejected:
        raise ValueError("the validation of this fit isn't accepted; allow_rejected writes it as an experimental one")
    if used := set(features) & set(forbidden):
        raise ValueError(f"features are forbidden inputs: {sorted(used)}")
    known = rows.where(F.col(target).isNotNull())
    found = known.agg(*(F.coalesce(F.percentile(F.col(f).cast("double"), 0.5), F.lit(0.0)).alias(f) for f in features)).first()
    medians = {f: found[f] for f in features}
    fit, reference = final_fit(_filled(known, medians), target, list(features), alpha)
    reference = reference.select(F.round("prediction", decimals).alias("prediction"))
    spark = rows.sparkSession
    fit.write.mode("overwrite").parquet(f"{path}/fit")
    reference.write.mode("overwrite").parquet(f"{path}/reference")
    spark.createDataFrame(list(medians.items()), "feature string, median double").write.mode("overwrite").parquet(f"{path}/features")
    status = "validated" if accepted else "experimental_rejected"
    about = [status, str(decimals), ",".join(features), ",".join(forbidden), *(repr(medians[f]) for f in features)]
    digest = _digest(spark.read.parquet(f"{path}/fit"), spark.read.parquet(f"{path}/reference"), about)
    spark.createDataFrame([(VERSION, status, decimals, list(features), list(forbidden), digest)],
                          "version int, status string, decimals int, features array<string>, forbidden array<string>, digest string").write.mode("overwrite").parquet(f"{path}/about")


def load_artifact(spark: SparkSession, path: str, allow_rejected: bool = False) -> Artifact:
    """Read a bundle; another version, contents that don't give its digest, or a fit that isn't accepted (unless ``allow_rejected``) are errors."""
    about = spark.read.parquet(f"{path}/about").first()
    if about.version != VERSION:
        raise ValueError(f"version {about.version} of the bundle isn't {VERSION}")
    fit, reference = spark.read.parquet(f"{path}/fit"), spark.read.parquet(f"{path}/reference")
    medians = {r.feature: r.median for r in spark.read.parquet(f"{path}/features").collect()}
    said = [about.status, str(about.decimals), ",".join(about.features), ",".join(about.forbidden), *(repr(medians.get(f)) for f in about.features)]
    if _digest(fit, reference, said) != about.digest:
        raise ValueError("the contents of the bundle don't have its digest")
    if about.status != "validated" and not allow_rejected:
        raise ValueError(f"the status of the fit is {about.status}")
    return Artifact(fit.withColumn("decimals", F.lit(about.decimals)), reference, medians, list(about.features), list(about.forbidden), about.status, about.digest)


def score_with(rows: DataFrame, artifact: Artifact, ordinal: str) -> DataFrame:
    """``rows`` with prediction, percentile against the reference (0 to 100), batch_rank and status; a forbidden input column, or a missing feature, is an error."""
    names = {c.lower() for c in rows.columns}
    if found := [c for c in artifact.forbidden if c.lower() in names]:
        raise ValueError(f"forbidden inputs: {found}")
    if missing := [f for f in artifact.features if f.lower() not in names]:
        raise ValueError(f"missing features: {missing}")
    decimals = artifact.fit.first().decimals
    scored = predict(_filled(rows, artifact.medians), artifact.fit.drop("decimals"), [], artifact.features).drop("alpha").withColumn("prediction", F.round("prediction", decimals))
    placed = ecdf_percentile(scored, artifact.reference, "prediction", smoothed=True).withColumn("percentile", F.round(100 * F.col("percentile"), 6))
    return batch_rank(placed, "percentile", ordinal).withColumn("status", F.lit(artifact.status))
