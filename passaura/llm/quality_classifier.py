"""Quality and toxicity of documents by hierarchical empirical Bayes.

A document's own evidence is a log likelihood ratio for each of two outcomes (low quality, toxic): the
log odds of a logistic regression on the words and style marks whose link with an outcome is
beyond chance among labelled documents, less the log odds of the outcome there. The sites give the prior: for each host the mean of its documents' own
probabilities, shrunk toward the global mean, and for each path of the host the mean shrunk toward the
host's. How strongly a level is shrunk follows from how much its groups differ (method of moments),
so sparse sites fall back on what is above them. A document's own share is left out of its site's mean.
Texts are scored once, to rows of id, site and evidence; sites and posteriors are worked out on these, so no text is
shuffled for them.
"""

from __future__ import annotations

import math
from operator import eq
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, prepare, spread_join, written

#: Of what is fitted, defaults of `trained`: labelled documents read, marks kept for an outcome (of the largest chi-square), and
#: the chi-square and number of documents that a mark needs.
TRAIN_ROWS, MARKS, MIN_CHI2, MIN_COUNT = 10_000, 256, 15.0, 4
#: Of the regression: steps, weight of the squared-length penalty.
STEPS, PENALTY = 300, 3e-5
OUTCOMES = ("low", "toxic")
_STEPS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)


def marks_of(text: str | None) -> set[str]:
    """The distinct words of a text (lower-cased, outer punctuation cut), beginnings of long ones, and marks of its style.

    Style marks begin with a blank, which no word does. No text: the one mark of an empty text.
    """
    raw = (text or "").split()
    if not raw:
        return {" empty"}
    distinct = set(raw)
    words = {x.strip(punctuation).lower() for x in distinct}
    words.discard("")
    words |= {f"{x[:5]}-" for x in words if len(x) > 6}
    words |= {f" tail {x[-1]}" for x in distinct if len(x) > 2 and x[-1] == x[-2] and not x[-1].isalnum()}
    words |= {f" bare {x[0]}" for x in distinct if not x.strip(punctuation)}
    n, chars = len(raw), len(text)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    upper = int(np.count_nonzero(((code >= 65) & (code <= 90)) | ((code >= 0xC0) & (code <= 0xDE))))
    letters = upper + int(np.count_nonzero(((code >= 97) & (code <= 122)) | (code > 0xDE)))
    step = lambda x: sum(x > s for s in _STEPS)
    words.add(f" upper {step(upper / max(1, letters))}")
    words.add(f" letters {step(letters / chars)}")
    words.add(f" distinct {step(len(distinct) / n)} of {min(6, int(math.log10(n) * 2))}")
    words.add(f" again {step(sum(map(eq, raw, raw[1:])) / n)}")
    words.add(f" length {min(8, int(chars / n / 2))}")
    return words


def _counted(batches):
    """(mark, n, low, toxic) of a partition: in how many texts a mark occurs, in all and by outcome."""
    out = pa.schema([("mark", pa.string()), ("n", pa.int64()), ("low", pa.int64()), ("toxic", pa.int64())])
    seen: dict[str, list[int]] = {}

    def batch():
        return pa.record_batch([pa.array(list(seen), pa.string()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in range(3))], schema=out)

    for b in batches:
        for text, low, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for m in marks_of(text):
                x = seen.setdefault(m, [0, 0, 0])
                x[0] += 1
                x[1] += low
                x[2] += toxic
            x = seen.setdefault(" all", [0, 0, 0])
            x[0] += 1
            x[1] += low
            x[2] += toxic
        if len(seen) > 200_000:
            yield batch()
            seen.clear()
    if seen:
        yield batch()


class Model:
    """Weights of marks by outcome, the intercepts, and the outcomes' shares among labelled documents."""

    def __init__(self, weights: dict[str, tuple[float, float]], start: tuple[float, float], base: tuple[float, float]):
        self.weights, self.start, self.base = weights, start, base

    def evidence(self, text: str | None) -> tuple[float, float]:
        low, toxic = self.start
        for m in marks_of(text) & self.weights.keys():
            a, b = self.weights[m]
            low += a
            toxic += b
        return low, toxic


def _regressed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the intercept for each column of y: penalised logistic regression by Adam steps."""
    n, k = x.shape
    w = np.zeros((k + 1, y.shape[1]), np.float32)
    w[-1] = np.log((y.sum(0) + 0.5) / (n - y.sum(0) + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - y
        g = np.concatenate((x.T @ error / n + PENALTY * w[:-1], error.mean(0, keepdims=True)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (1 - 0.9 * t / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, marks: int = MARKS, min_chi2: float = MIN_CHI2, min_count: int = MIN_COUNT) -> Model:
    """A Model of at most `rows` labelled documents, those whose id's hash is smallest.

    Labels are joined by id; of repeated ids an outcome holds if any row says so; null labels count as 0. Of documents
    that share an id the text that is first by order is read, so `rows` bounds what comes to the driver. Only the
    labels' ids are sent to the workers, at most `rows` of them. No labels or no documents: no evidence.
    """
    prepare(docs.sparkSession)
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("low"), F.max(F.coalesce(F.col("toxic"), F.lit(0)).cast("int")).alias("toxic"))
    chosen = written(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labels")
    own = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    found = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("low").alias("low"), F.first("toxic").alias("toxic"))
    texts = written(found.select("text", F.coalesce("low", F.lit(0)).alias("low"), "toxic"), "labelled-texts")
    counts = texts.mapInArrow(_counted, "mark string, n long, low long, toxic long").groupBy("mark").agg(*(F.sum(x).alias(x) for x in ("n", "low", "toxic")))
    counts = written(counts.where((F.col("n") >= min_count) | (F.col("mark") == " all")), "marks")
    whole = counts.where(F.col("mark") == " all").first()
    if not whole:
        return Model({}, (0.0, 0.0), (0.5, 0.5))
    n = whole["n"]

    def chi2(x: str) -> Column:
        a, t, k = F.col(x).cast("double"), F.lit(float(whole[x])), F.col("n").cast("double")
        return F.when((t == 0) | (t == n) | (k == n), 0.0).otherwise(n * (a * n - t * k) * (a * n - t * k) / (t * (n - t) * k * (n - k)))

    best = counts.where(F.col("mark") != " all").withColumns({f"c_{x}": chi2(x) for x in OUTCOMES})
    names = sorted({r["mark"] for x in OUTCOMES for r in best.where(F.col(f"c_{x}") >= min_chi2).orderBy(F.desc(f"c_{x}"), "mark").limit(marks).collect()})
    base = tuple((whole[x] + 0.5) / (n + 1) for x in OUTCOMES)
    at = {m: k for k, m in enumerate(names)}

    def found(batches):
        for b in batches:
            own = [[at[m] for m in marks_of(text) & at.keys()] for text in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(own, pa.list_(pa.int32())), b.column(1), b.column(2)], names=["marks", "low", "toxic"])

    rows = texts.mapInArrow(found, "marks array<int>, low int, toxic int").toArrow()
    x = np.zeros((len(rows), len(names)), np.float32)
    for k, own in enumerate(rows.column("marks").to_pylist()):
        x[k, own] = 1
    y = np.stack([rows.column(c).to_numpy().astype(np.float32) for c in OUTCOMES], axis=1)
    w = _regressed(x, y).astype(float)
    start = tuple(float(a) - math.log(p / (1 - p)) for a, p in zip(w[-1], base, strict=True))
    return Model({m: (float(w[k, 0]), float(w[k, 1])) for m, k in at.items()}, start, base)


def evidence_column(text: Column, model: Model) -> Column:
    """struct(low, toxic): the log likelihood ratios of a text column."""
    kind = pa.struct([(x, pa.float64()) for x in OUTCOMES])
    shared = {"model": model}

    @F.arrow_udf("struct<low:double,toxic:double>")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([shared["model"].evidence(x) for x in texts.to_pylist()], float).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], fields=list(kind))

    return of.asNondeterministic()(text)


def _chance(log_ratio: Column, prior: Column | float) -> Column:
    p = prior if isinstance(prior, Column) else F.lit(prior)
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -log_ratio - F.log(p / (1 - p))))))


def site_means(scored: DataFrame, model: Model, levels: tuple[str, ...] = ("host", "path")) -> DataFrame:
    """(*levels, n, and for each outcome and level: sum, and pseudo-count k of its shrinkage) of scored (*levels, low, toxic).

    One grouped aggregation by the finest level, with partial sums, then ones over its small result. A
    level's k is mean * (1 - mean) / variance between groups, less 1, between 1 and 10000.
    """
    chance = scored.select(*levels, *(_chance(F.col(x), p).alias(x) for x, p in zip(OUTCOMES, model.base, strict=True)))
    fine = written(chance.groupBy(*levels).agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in OUTCOMES)), "sites")
    out = fine.select(*levels)
    whole = fine.agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in OUTCOMES)).first()
    for d in range(1, len(levels) + 1):
        by = levels[:d]
        groups = fine.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in OUTCOMES))
        spread = groups.where("n >= 2").agg(*(F.sum(F.col("n") * (F.col(x) / F.col("n") - F.lit((whole[x] or 0.0) / (whole["n"] or 1))) ** 2).alias(x) for x in OUTCOMES), F.sum("n").alias("n"), F.count("*").alias("g")).first()
        k = {}
        for x in OUTCOMES:
            mean = min(max((whole[x] or 0.0) / (whole["n"] or 1), 1e-6), 1 - 1e-6)
            within = mean * (1 - mean)
            between = (spread[x] or 0.0) / (spread["n"] or 1) - within * (spread["g"] or 0) / (spread["n"] or 1)
            k[x] = min(1e4, max(1.0, within / between - 1)) if between > 0 else 1e4
        groups = groups.select(*by, F.col("n").alias(f"n_{d}"), *(c for x in OUTCOMES for c in (F.col(x).alias(f"{x}_{d}"), F.lit(k[x]).alias(f"{x}_k{d}"))))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
        joined = out.alias("a").join(groups.alias("b"), same, "left")
        out = joined.select("a.*", *(f"b.{c}" for c in groups.columns if c not in by))
    for x in OUTCOMES:
        out = out.withColumn(f"{x}_0", F.lit(min(max((whole[x] or 0.0) / (whole["n"] or 1), 1e-6), 1 - 1e-6)))
    return written(out, "site-means")


def judgements(docs: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(doc_id, text_hash, quality) of every row of docs: quality is struct(host, path, low_evidence, toxic_evidence, low_prior, toxic_prior, low, toxic, rejected).

    low and toxic are posterior probabilities; a document is rejected if either is over `cut`. Null and empty texts are
    judged by the mark of an empty text and their site; null hosts and paths are sites of their own; repeated rows are
    judged alike, as often as they come. A site with a great part of all rows meets them by broadcast (spread_join).
    An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    scored = docs.select(named(id_col).alias("doc_id"), F.xxhash64(named(text_col)).alias("text_hash"), F.struct(host.alias("host"), path.alias("path")).alias("site"), evidence_column(named(text_col), model).alias("e"))
    scored = written(scored.select("doc_id", "text_hash", "site", "e.low", "e.toxic"), "evidence")
    sites = site_means(scored.select("site.host", "site.path", "low", "toxic"), model)
    sites = written(sites.select(F.struct("host", "path").alias("site"), *(c for c in sites.columns if c not in ("host", "path"))), "sites-by-key")
    joined = spread_join(scored, sites, "site", "left", rows="n_2")
    parts = [F.col("site.host").alias("host"), F.col("site.path").alias("path"), F.col("low").alias("low_evidence"), F.col("toxic").alias("toxic_evidence")]
    chances = []
    for x, base in zip(OUTCOMES, model.base, strict=True):
        p = F.col(f"{x}_0")
        for d in (1, 2):
            k = F.col(f"{x}_k{d}")
            p = (F.greatest(F.lit(0.0), F.col(f"{x}_{d}") - _chance(F.col(x), base)) + k * p) / (F.col(f"n_{d}") - 1 + k)
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
        parts.append(p.alias(f"{x}_prior"))
        chances.append(_chance(F.col(x), p).alias(x))
    rejected = (chances[0] > cut) | (chances[1] > cut)
    return joined.select("doc_id", "text_hash", F.struct(*parts, *chances, rejected.alias("rejected")).alias("quality"))


def _joined(docs: DataFrame, found: DataFrame, host: Column, path: Column, id_col: str, text_col: str, how: str) -> DataFrame:
    """docs joined to judgements of its rows, the same rows taken once; the columns of docs and the judgement, under its fresh name."""
    i, t, h, p, q = (fresh(docs, x) for x in ("judged_id", "judged_text", "judged_host", "judged_path", "quality"))
    keys = found.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t), F.col("quality.host").alias(h), F.col("quality.path").alias(p), F.col("quality").alias(q)).dropDuplicates([i, t, h, p])
    same = named(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(named(text_col)) == F.col(t)) & host.eqNullSafe(F.col(h)) & path.eqNullSafe(F.col(p))
    out = docs.join(keys, same, how)
    return out if how == "left_anti" else out.select(*(named(c) for c in docs.columns), q)


def judged(docs: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """docs with a last column of judgements, called `quality`, or `_quality` if docs has that.

    Other columns and repeated rows stay. Here texts move, once, to their judgements: dealt out by id and text, so
    only rows that are alike in both meet in one task.
    """
    return _joined(docs, judgements(docs, model, host, path, id_col, text_col, cut), host, path, id_col, text_col, "left")


def accepted(docs: DataFrame, model: Model, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of docs that are not rejected, as they are; cases and movement as for `judged`."""
    found = judgements(docs, model, host, path, id_col, text_col, cut).where("quality.rejected")
    return _joined(docs, found, host, path, id_col, text_col, "left_anti")
