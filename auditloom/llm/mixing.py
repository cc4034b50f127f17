"""Document rates that bring a corpus to target weights, by DataFrame and SQL functions alone.

A document belongs to each domain in part: a classifier learned from a table of
labels gives it a posterior. With n tokens, posterior p and rate r it brings
r * n * p[k] tokens to domain k. The rates are the nonnegative ones whose
domain totals come closest to the targets in least squares, with a small ridge
towards a rate of one. They are fitted by projected gradient steps. Each document's
gradient is the product of its parts with the domains' gaps, so what the steps have
added up to so far is one number a domain, and a document's rate follows from these
where its row lies: 1 less the product of its parts with them, projected to 0 and
more. A step needs one pass of sums over all documents. Its size is bounded for each
domain by the row sum of the Gram matrix of the documents' parts, so that a rare
domain's gap closes as fast as a frequent one's, and the steps have momentum.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Domains and the share of the tokens that each is to have.
TARGETS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}
FEATURES = 1 << 14


def domain() -> Column:
    """The domain of a row of labels (quality, toxic)."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")


def labelled(docs: DataFrame, labels: DataFrame, per_domain: int) -> DataFrame:
    """text and label of up to per_domain rows of each domain, those of the smallest hash of the id."""
    known = labels.filter("doc_id is not null").select("doc_id", domain().alias("domain"))
    parts = [known.filter(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain).select("doc_id", F.lit(float(k)).alias("label")) for k, name in enumerate(TARGETS)]
    chosen = parts[0]
    for x in parts[1:]:
        chosen = chosen.union(x)
    # At most per_domain rows for each domain.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull()).select("text", "label")


def prepared(df: DataFrame) -> DataFrame:
    """Adds tokens (words and single other characters, lower-cased) and features (which hashed tokens occur)."""
    df = df.withColumn("_text", F.coalesce("text", F.lit("")))
    tokenizer = RegexTokenizer(inputCol="_text", outputCol="tokens", pattern=r"\p{L}+|[^\p{L}\s]", gaps=False)
    hashing = HashingTF(inputCol="tokens", outputCol="features", numFeatures=FEATURES, binary=True)
    return PipelineModel([tokenizer, hashing]).transform(df).drop("_text")


def posteriors(docs: DataFrame, labels: DataFrame, per_domain: int = 600) -> DataFrame:
    """The columns of docs but text, n_tokens, and p, the posterior of each domain; columns of docs may have any name, and those two are replaced.

    per_domain bounds the labelled rows that the classifier is fitted to. With
    fewer than two domains among them all domains are alike.
    """
    rows = stored(prepared(labelled(docs, labels, per_domain)).select("features", "label"), "mixing-labelled")
    seen = [r["label"] for r in rows.groupBy("label").count().collect()]
    scored = prepared(docs.select(F.struct(*(f"`{c}`" for c in docs.columns if c not in ("text", "n_tokens", "p"))).alias("_row"), "text"))
    if len(seen) < 2:
        p = F.array(*(F.lit(1.0 / len(TARGETS)) for _ in TARGETS))
    else:
        model = LogisticRegression(regParam=0.003, elasticNetParam=0.5, maxIter=40, family="multinomial", aggregationDepth=2).fit(rows)
        scored = model.transform(scored)
        found = vector_to_array("probability")
        p = F.array(*(F.coalesce(F.get(found, F.lit(k)), F.lit(0.0)) for k in range(len(TARGETS))))
    return scored.select("_row.*", F.size("tokens").cast("long").alias("n_tokens"), p.alias("p"))


def rates(members: DataFrame, targets: dict[str, float], ridge: float = 1e-3, steps: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """Adds rate to rows with n_tokens and p: the minimum over rates >= 0 of

    1/2 sum over k of (sum of rate * n_tokens * p[k] / total - target[k])**2 + ridge / (2 N) * sum of (rate - 1)**2

    for N rows and total tokens. Rows without tokens get rate 1. At the minimum each rate is 1 less its
    parts' product with the gaps that the rates leave, over ridge / N, projected to 0 and more. The slope of a step is
    what the rates leave less what the steps have added up to; no gap is further from the minimum's than the slope is
    long. It ends when no domain's slope exceeds tolerance, at any scale of the domains, and warns if it took all its steps.
    """
    names, shares = list(targets), np.array(list(targets.values()))
    size = members.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    if not size["tokens"]:
        return members.withColumn("rate", F.lit(1.0))
    parts = [F.col("n_tokens") * F.get("p", F.lit(k)) / float(size["tokens"]) for k in range(len(names))]
    pull = ridge / size["rows"]

    def rate(gaps: np.ndarray) -> Column:
        return F.greatest(1 - sum((F.lit(float(g)) * x for g, x in zip(gaps, parts, strict=True)), F.lit(0.0)) / pull, F.lit(0.0))

    def looked_at(gaps: np.ndarray, left: np.ndarray) -> tuple[tuple, np.ndarray]:
        """In one pass: the dual value, its slope, and row sums of the Gram matrix of the documents whose rates are above zero, and of all; and the slope at left."""
        rows = members.select(*(x.alias(f"x{k}") for k, x in enumerate(parts)), rate(gaps).alias("r"), rate(left).alias("q"))
        x = [F.col(f"x{k}") for k in range(len(names))]
        at, whole, r = sum((F.lit(float(g)) * y for g, y in zip(gaps, x, strict=True)), F.lit(0.0)), sum(x, F.lit(0.0)), F.col("r")
        sums = [F.sum(at * r + pull / 2 * (r - 1) * (r - 1))]
        sums += [F.sum(r * y) for y in x] + [F.sum(F.when(r > 0, y * whole).otherwise(0.0)) for y in x] + [F.sum(y * whole) for y in x] + [F.sum(F.col("q") * y) for y in x]
        got = np.array(rows.agg(*(y.alias(f"s{i}") for i, y in enumerate(sums))).first(), float)
        brought, moving, every, of_left = got[1:].reshape(4, -1)
        return (got[0] - gaps @ gaps / 2 - gaps @ shares, gaps, brought - shares - gaps, 1 + moving / pull, 1 + every / pull), of_left - shares - left

    gaps = ahead = left = np.zeros(len(names))
    speed, best, doubled = 1.0, None, 0.0
    for _ in range(steps):
        at, slope_left = looked_at(ahead, left)
        value, _, slope, moving, every = at
        # Where domains can't be told apart, only the gaps that the rates left are close at once.
        for found, there in ((ahead, slope), (left, slope_left)):
            if np.abs(there).max() <= tolerance:
                return members.withColumn("rate", rate(found))
        left = ahead + slope
        if best and value < best[0] - 1e-12 * abs(best[0]) and np.abs(slope).max() > np.abs(best[2]).max():
            # Went too far: back to the best point, without momentum and with twice the bound.
            (_, ahead, slope, moving, every), doubled, speed = best, doubled + 1, 1.0
            gaps = ahead
        else:
            best, doubled = at, max(doubled - 0.1, 0.0)
        # The rates that are zero now may move later; the bound by all rates holds wherever they are.
        new = ahead + slope / np.minimum(moving * 2**doubled, every)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2 if slope @ (new - gaps) >= 0 else 1.0
        ahead, gaps, speed = new + (speed - 1) / faster * (new - gaps), new, faster
    if tolerance:
        warnings.warn(f"the rates leave a slope of {np.abs(best[2]).max():.2g} after {steps} steps", stacklevel=2)
    return members.withColumn("rate", rate(best[1]))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, per_domain: int = 600) -> DataFrame:
    """doc_id, source, n_tokens, a posterior for each domain (p_<name>) and rate of every row.

    Null and blank texts have no tokens: they take part in no total and keep rate 1.
    """
    targets = targets or TARGETS
    members = stored(posteriors(docs.select("doc_id", "source", "text"), labels, per_domain), "mixing-members")
    p = [F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(targets)]
    return rates(members, targets).select("doc_id", "source", "n_tokens", *p, "rate")
