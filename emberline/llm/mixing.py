"""Mixing to target weights with soft membership, in DataFrame operations only.

A classifier trained on the labelled table gives every document a posterior
over domains. Projected-gradient least squares then moves nonnegative document
rates until the expected tokens of each domain meet the targets. A step needs
only sums over documents: as many numbers as domains, and their products.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline as Steps
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage

# The domains that the labels table can tell apart, and the production targets.
TARGETS = {"clean": 0.9, "junk": 0.07, "toxic": 0.03}


@dataclass(frozen=True)
class Mix:
    """targets: share of the expected tokens by domain. train_rows: labelled rows in the fit, the first
    by hash of the id. features: hashed words. steps and tolerance end the descent."""

    targets: dict[str, float] = field(default_factory=lambda: dict(TARGETS))
    train_rows: int = 4000
    features: int = 1 << 13
    steps: int = 25
    tolerance: float = 1e-7
    seed: int = 5


def domain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) from quality and toxic; the worst of repeated rows, rows with a null label left out."""
    domain = F.when(F.max(1 - F.col("quality")) > 0, "junk").when(F.max("toxic") > 0, "toxic").otherwise("clean")
    return labels.where("quality is not null and toxic is not null").where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(domain.alias("domain"))


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """Words of each text, and shares of capitals, symbols and repeated words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("_text", text).withColumn("_words", F.array_remove(F.split(F.lower("_text"), r"[^\p{L}]+"), ""))
    size = F.greatest(F.length("_text"), F.lit(1))
    return rows.select(
        "*",
        F.size("_words").cast("long").alias("_tokens"),
        ((F.length("_text") - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / size).alias("_capitals"),
        ((F.length("_text") - F.length(F.translate("_text", "#*$%&|<>!", ""))) * 5 / size).alias("_symbols"),
        (F.lit(1.0) - F.size(F.array_distinct("_words")) / F.greatest(F.size("_words"), F.lit(1))).alias("_repeats"),
    ).drop("_text")


def train_domains(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, p: Mix) -> tuple[list[str], list[str], PipelineModel | None]:
    """The domains, those of them that the labelled rows of docs still have, and the model of the latter."""
    names = sorted(p.targets)
    chosen = domain_labels(labels, id_col).where(F.col("domain").isin(names)).orderBy(F.xxhash64("id"), "id").limit(p.train_rows)
    rows = docs.select(F.col(id_col).alias("id"), text_col).join(F.broadcast(chosen), "id")
    rows = rows.orderBy(F.xxhash64("id", text_col)).limit(p.train_rows)  # an id may stand on any number of rows
    rows = cut_lineage(with_features(rows, text_col).select("domain", "_words", "_capitals", "_symbols", "_repeats").repartition(6))
    present = sorted(r["domain"] for r in rows.select("domain").distinct().collect())
    if len(present) < 2:
        return names, present, None
    rows = rows.withColumn("_label", F.array_position(F.array(*[F.lit(x) for x in present]), F.col("domain")).cast("double") - 1)
    steps = [
        HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=p.features, binary=True),
        VectorAssembler(inputCols=["_hashed", "_capitals", "_symbols", "_repeats"], outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", family="multinomial", regParam=0.003, elasticNetParam=0.5, maxIter=60, standardization=True),
    ]
    return names, present, Steps(stages=steps).fit(rows)


def posteriors(docs: DataFrame, names: list[str], present: list[str], model: PipelineModel | None, text_col: str) -> DataFrame:
    """docs with _tokens and one column p_<domain> for each domain, 0 for one without labelled rows."""
    rows = with_features(docs, text_col)
    if model is None:
        return rows.drop("_words", "_capitals", "_symbols", "_repeats").select("*", *[F.lit(1.0 / len(names)).alias(f"p_{x}") for x in names])
    made = model.transform(rows).withColumn("_p", vector_to_array("_p"))
    out = [(F.get("_p", present.index(x)) if x in present else F.lit(0.0)).alias(f"p_{x}") for x in names]
    return made.select(*docs.columns, "_tokens", *out)


def fitted_rates(rows: DataFrame, names: list[str], present: list[str], p: Mix) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of the projected descent from rate 1, as coefficients of the posteriors, and the last domain totals.

    The objective is the squared distance of domain totals from the targets, in the norm
    of the inverse of M = sum(tokens * p p') over documents with a positive rate; in the
    metric of tokens its gradient at a document is -p . M^-1 (target - total), and 1 is a safe step.

    Only domains that labelled rows and posteriors still have are aimed at. Where the totals stay off by
    over a hundredth, or a domain loses more mass to rate 0 than its target calls for (and a hundredth), the
    domain furthest short of its target is given up and the descent starts again for the others.
    """
    k = len(names)
    ps = [F.col(f"p_{x}") for x in names]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def state(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rate = rate_column(names, steps)
        mass = F.col("_tokens") * rate
        active = F.when(rate > 0, F.col("_tokens")).otherwise(0)
        got = rows.agg(*[F.coalesce(F.sum(mass * x), F.lit(0.0)) for x in ps], *[F.coalesce(F.sum(active * ps[i] * ps[j]), F.lit(0.0)) for i, j in pairs]).first()
        m = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k:], strict=True):
            m[i, j] = m[j, i] = v
        return np.array(got[:k], float), m

    first, m_first = state([])
    aimed = [i for i, x in enumerate(names) if x in present and p.targets[x] > 0 and first[i] > 0] if len(present) > 1 else []
    while len(aimed) > 1:
        share = np.array([p.targets[names[i]] for i in aimed])
        goal = share / share.sum() * first[aimed].sum()
        steps, total, m = [], first, m_first
        while np.abs(goal - total[aimed]).sum() > p.tolerance * goal.sum() and len(steps) < p.steps:
            step = np.zeros(k)
            step[aimed] = np.linalg.lstsq(m[np.ix_(aimed, aimed)], goal - total[aimed], rcond=1e-9)[0]
            steps.append(step)
            total, m = state(steps)
        kept = m[aimed].sum(axis=1)  # posteriors add up to 1, so this is each domain's mass at a positive rate
        if np.abs(goal - total[aimed]).sum() <= 0.01 * goal.sum() and (kept >= np.minimum(goal, first[aimed]) - 0.01 * first[aimed]).all():
            return steps, total
        aimed.pop(int(np.argmax(goal / first[aimed])))
    return [], first


def rate_column(names: list[str], steps: list[np.ndarray]):  # noqa: ANN201
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate + sum((F.col(f"p_{x}") * float(c) for x, c in zip(names[1:], step[1:], strict=True)), F.col(f"p_{names[0]}") * float(step[0])))
    return rate


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Mix | None = None) -> DataFrame:
    """(id_col, n_tokens, p_<domain>..., domain, rate, copies) for every row of docs.

    rate is the expected number of times that the mix takes the document; copies is
    rate rounded up or down by a hash of the id, so that sums are right on average.
    Null and empty texts have no tokens and take the rate that their posterior gives.
    Null ids and repeated rows are each rated; other columns are ignored. With fewer
    than two labelled domains the posteriors are flat and every rate is 1; targets are
    shared out among the domains that can meet theirs, see fitted_rates().
    """
    p = params or Mix()
    texts = docs.select(F.col(id_col), F.col(text_col))
    names, present, model = train_domains(texts, labels, id_col, text_col, p)
    rows = cut_lineage(posteriors(texts, names, present, model, text_col).drop(text_col))
    return rated(rows, names, fitted_rates(rows, names, present, p)[0], [id_col], id_col, p)


def rated(rows: DataFrame, names: list[str], steps: list[np.ndarray], keep: list[str], id_col: str, p: Mix) -> DataFrame:
    ps = F.array(*[F.col(f"p_{x}") for x in names])
    best = F.get(F.array(*[F.lit(x) for x in names]), (F.array_position(ps, F.array_max(ps)) - 1).cast("int"))
    even = F.pmod(F.xxhash64(F.lit(p.seed), F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    out = rows.select(*keep, F.col("_tokens").alias("n_tokens"), *[F.round(f"p_{x}", 6).alias(f"p_{x}") for x in names], best.alias("domain"), F.round(rate_column(names, steps), 6).alias("rate"))
    return out.withColumn("copies", F.floor(F.col("rate") + even).cast("long"))


def mixed_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Mix | None = None) -> DataFrame:
    """docs with the columns of mix(), less the documents of rate 0.

    The rates are fitted on a narrow table; the texts are then classified once more
    instead of being carried through a join. A column of docs that mix() makes is replaced, others come back as they
    were. Null ids, repeated rows, null and empty texts: as for mix(). An empty table stays empty.
    """
    p = params or Mix()
    texts = docs.select(F.col(id_col), F.col(text_col))
    names, present, model = train_domains(texts, labels, id_col, text_col, p)
    made = {"n_tokens", "domain", "rate", "copies", *[f"p_{x}" for x in names]}
    # The row rides along as one struct, so that none of its columns can clash with those made on the way.
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in made]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_own"))
    rows = posteriors(whole, names, present, model, "_own")
    narrow = cut_lineage(rows.select("_tokens", *[f"p_{x}" for x in names]))
    steps, _ = fitted_rates(narrow, names, present, p)
    return rated(rows, names, steps, ["_row", "_id"], "_id", p).where("rate > 0").select("_row.*", "n_tokens", *[f"p_{x}" for x in names], "domain", "rate", "copies")
