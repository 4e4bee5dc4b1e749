"""Document quality by hierarchical empirical Bayes (operator 9).

A document has evidence of its own, two logistic regressions on its text (low
quality, and toxicity), fitted on a bounded sample of labelled rows.  For each
of the two, hosts and paths of hosts have posteriors: a host's share is shrunk
towards the global share, and a path's towards its host's.  Each level's prior
is worth a number of documents that is estimated from the spread of the shares
on that level beyond what chance gives (method of moments).  Sparse sites so
stay near the prior, and the posterior replaces the global prior in the
document's odds.  A document's own evidence is left out of the shares of its
host and path, so it counts once.

Shares are grouped aggregates over all documents.  The site table is broadcast
only if its counted size is small.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, require, spread, text_or_empty, written

#: Labelled rows that the regressions are fitted on, at most.
FIT_ROWS = 12_000
#: Labelled documents that a word must be in to be used, and their least share.
LEAST_DOCS, LEAST_SHARE = 5, 0.0015
#: Sites up to this number are broadcast; more are joined by a shuffle.
BROADCAST_SITES = 20_000
#: Documents that a level's prior is worth, at least and at most.
LEAST_STRENGTH, MOST_STRENGTH = 5.0, 1000.0
#: The two kinds of badness.
KINDS = ("low", "toxic")

#: Lengths of word beginnings that count as terms.
BEGINNINGS = (5, 7, 8)

_WORD = re.compile(r"[^\W\d_]+")
_TAIL = re.compile(r"[^\w\s.,;:!?'\"()-]")

#: Names of the text statistics, in order.
STATS = (
    "repeats", "longest_run", "distinct", "symbols", "bars", "digits",
    "mean_word", "stops", "lines", "log_words", "capitals", "top_word",
)


def statistics(text: str) -> list[float]:
    """Language-free numbers about a whole text; zeros for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    same = run = longest = 0
    for a, b in zip(words, words[1:]):
        if a == b:
            same += 1
            run += 1
            longest = max(longest, run)
        else:
            run = 0
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    size = len(text)
    return [
        same / n,
        math.log1p(longest),
        len(counts) / n**0.8,
        min(1.0, len(_TAIL.findall(text)) / n),
        text.count("|") / n,
        sum(map(text.count, "0123456789")) / size,
        min(20.0, size / n) / 10,
        (text.count(".") + text.count(",")) / n,
        text.count("\n") / n,
        math.log1p(n) / 5,
        sum(w[0].isupper() for w in words) / n,
        max(counts.values()) / n,
    ]


def terms(text: str) -> set[str]:
    """The lower-cased words of a text, and their beginnings (marked ``*``)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Logistic:
    """A logistic regression on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(
        cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25, raw: bool = False
    ) -> Logistic:
        """Penalised maximum likelihood by Newton's method; deterministic.

        ``raw`` columns are not standardised, so rare ones stay near zero.
        """
        mean = np.zeros(x.shape[1]) if raw or not len(x) else x.mean(axis=0)
        scale = np.ones(x.shape[1]) if raw or not len(x) else x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        # A class that is missing still has half a row, so odds stay finite.
        rate = (y.sum() + 0.5) / (len(y) + 1)
        w[-1] = math.log(rate / (1 - rate))
        if 0 < y.sum() < len(y):
            for _ in range(rounds):
                p = sigmoid(z @ w)
                gradient = z.T @ (p - y) + ridge * w
                hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
                step = np.linalg.solve(hessian, gradient)
                size = np.abs(step).max()
                w -= step * min(1.0, 5.0 / size) if size else 0
                if size < 1e-6:
                    break
        return cls(mean, scale, w[:-1], float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias


def fit_terms(
    has: list[list[int]], y: np.ndarray, n_terms: int, penalty: float = 1.0, rounds: int = 60, tolerance: float = 1e-10
) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression on which terms a row has.

    The optimum of ``Logistic.fit(raw=True)`` on the 0/1 matrix, without it:
    rows are lists of term numbers, and Newton's steps are solved by conjugate
    gradients to a relative ``tolerance``, so memory grows with the listed
    terms only.  Deterministic.
    """
    n = len(has)
    row = np.repeat(np.arange(n), [len(h) for h in has])
    term = np.fromiter((t for h in has for t in h), np.int64, len(row))
    ridge = np.full(n_terms + 1, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(n_terms + 1)
    rate = (y.sum() + 0.5) / (n + 1)
    w[-1] = math.log(rate / (1 - rate))

    def forward(v):
        return np.bincount(row, v[term], n) + v[-1]

    def back(u):
        return np.append(np.bincount(term, u[row], n_terms), u.sum())

    if not 0 < y.sum() < n:
        return w[:-1], float(w[-1])
    for _ in range(rounds):
        p = sigmoid(forward(w))
        gradient = back(p - y) + ridge * w
        curve = p * (1 - p)
        diagonal = np.append(np.bincount(term, curve[row], n_terms), curve.sum()) + ridge
        step, rest = np.zeros_like(w), gradient.copy()
        ahead = rest / diagonal
        direction, size = ahead.copy(), float(rest @ ahead)
        first = size
        for _ in range(4 * n_terms + 40):
            if size <= tolerance**2 * first or not size:
                break
            bent = back(curve * forward(direction)) + ridge * direction
            by = size / float(direction @ bent)
            step += by * direction
            rest -= by * bent
            ahead = rest / diagonal
            size, old = float(rest @ ahead), size
            direction = ahead + size / old * direction
        most = np.abs(step).max()
        w -= step * min(1.0, 5.0 / most) if most else 0
        if most < max(1e-6, 0.1 * tolerance):
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Both regressions and the words that carry toxicity."""

    low: Logistic
    words: dict[str, float] = field(default_factory=dict)
    toxic_bias: float = -4.0

    def toxic_logit(self, text: str) -> float:
        words = set(_WORD.findall(text.lower()))
        found = self.words.keys() & words
        for k in BEGINNINGS:
            found |= self.words.keys() & {w[:k] + "*" for w in words if len(w) > k}
        return self.toxic_bias + sum(self.words[w] for w in sorted(found))

    def logits(self, text: str) -> tuple[float, float]:
        low = float(self.low.logit(np.array([statistics(text)]))[0])
        return low, self.toxic_logit(text)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fits both regressions on at most ``most`` labelled documents.

    Labels: ``quality`` (0 is low) and ``toxic`` (1 is toxic); rows with null
    labels or ids are left out, and without labelled rows every document gets
    the prior.  The sample is the rows with the least hash of their id.  Only
    statistics, and which of the chosen words a document has, reach the
    driver.
    """
    require(docs, id_col, text_col)
    require(labels, id_col, "quality", "toxic")
    usable = labels.select(labels[id_col].alias("id"), "quality", "toxic").dropna()
    # Labels of one id that differ count once, as the larger pair.
    usable = usable.groupBy("id").agg(F.max(F.struct("quality", "toxic")).alias("l"))
    usable = usable.select("id", "l.quality", "l.toxic")
    marked = written(bounded_sample(usable, "id", most), "marked-rows")
    chosen = {r["id"]: (int(r["quality"]), int(r["toxic"])) for r in marked.collect()}
    kind = docs.schema[id_col].dataType.simpleString()
    picked = spread(docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")))
    # ``most`` bounds the marked rows.
    # Rows that repeat an id count once, by their least text.
    sample = picked.join(F.broadcast(marked), "id").groupBy("id").agg(F.min("text").alias("text"))

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            stats = [statistics(t) for t in texts]
            words = [sorted(terms(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(stats, pa.list_(pa.float64())),
                    pa.array(words, pa.list_(pa.string())),
                ],
                names=["id", "stats", "words"],
            )

    measured = written(
        sample.select("id", "text").mapInArrow(
            measure, f"id {kind}, stats array<double>, words array<string>"
        ),
        "measured",
    )
    toxic_ids = marked.select("id", (F.col("toxic") == 1).cast("int").alias("bad"))
    words = (
        measured.join(F.broadcast(toxic_ids), "id")
        .select(F.explode("words").alias("word"), "bad")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("n_bad"))
        .filter(F.col("n") >= max(LEAST_DOCS, LEAST_SHARE * len(chosen)))
    )
    total = len(chosen)
    total_bad = sum(t for _, t in chosen.values())
    rate = (total_bad + 0.5) / (total + 1)
    # The words that are most surely more frequent in toxic documents.
    excess = (F.col("n_bad") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    top = (
        words.withColumn("excess", excess)
        .filter(F.col("excess") > 6)
        .orderBy(F.desc("excess"), "word")
        .collect()
    )
    names = [r["word"] for r in top]
    place = {w: i for i, w in enumerate(names)}
    # One literal, however many terms; terms have no white space.
    wanted = F.split(F.lit(" ".join(names)), " ")
    rows = measured.select("id", "stats", F.array_intersect("words", wanted).alias("words")).collect()
    rows.sort(key=lambda r: r["id"])
    stats = np.array([r["stats"] for r in rows]).reshape(len(rows), len(STATS))
    low = np.array([1 - chosen[r["id"]][0] for r in rows], float)
    bad = np.array([chosen[r["id"]][1] for r in rows], float)
    has = [[place[w] for w in r["words"] if w in place] for r in rows]
    weights, bias = fit_terms(has, bad, len(names), penalty=0.1)
    return Model(Logistic.fit(stats, low), dict(zip(names, weights.tolist())), bias)


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text", keep: bool = True) -> DataFrame:
    """``docs`` with _low and _toxic, the log-odds of its own text.

    Without ``keep`` the text is left out.  Columns of these names are
    replaced.
    """
    require(docs, text_col)
    docs = spread(docs.drop("_low", "_toxic"))
    names = [c for c in docs.columns if keep or c != text_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    place, kept = docs.columns.index(text_col), [docs.columns.index(c) for c in names]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(place).to_pylist()
            both = [model.logits(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept]
                + [pa.array([b[k] for b in both], pa.float64()) for k in (0, 1)],
                names=[*names, "_low", "_toxic"],
            )

    return docs.mapInArrow(run, f"{schema}, _low double, _toxic double")


def _bad(low, toxic):
    """Probability that a document is low in quality or toxic."""
    odds = lambda c: 1 / (1 + F.exp(-c))
    return 1 - (1 - odds(low)) * (1 - odds(toxic))


def site_sums(evidence: DataFrame, host: str, path: str) -> DataFrame:
    """(_host, _path, n, low, toxic, host_n, host_low, host_toxic), written.

    Sums of the documents' own probabilities, one row per path.  ``evidence``
    has _low and _toxic.  Null hosts and paths are sites of their own.
    Aggregates twice: documents to paths, paths to hosts.
    """
    chance = lambda c: F.sum(1 / (1 + F.exp(-F.col(c))))
    paths = (
        evidence.select(
            F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"),
            F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"),
            "_low",
            "_toxic",
        )
        .groupBy("_host", "_path")
        .agg(F.count(F.lit(1)).alias("n"), *(chance(f"_{k}").alias(k) for k in KINDS))
    )
    # One row a path: small beside the documents, and needed twice.
    paths = written(paths, "path-sums")
    hosts = paths.groupBy("_host").agg(*(F.sum(c).alias(f"host_{c}") for c in ("n", *KINDS)))
    return written(paths.join(written(hosts, "host-sums"), "_host"), "site-sums")


@dataclass(frozen=True)
class Prior:
    """The global share, and the documents that the priors of hosts and paths are worth."""

    mean: float
    host_strength: float
    path_strength: float


def strength(mean: float, spread: float, noise: float) -> float:
    """The worth of a prior for shares of that spread, of which chance explains ``mean (1 - mean) noise``."""
    alone = mean * (1 - mean)
    true_spread = max(spread - alone * noise, 1e-9)
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, alone / true_spread - 1))


def priors(sums: DataFrame) -> dict[str, Prior]:
    """Both kinds' priors, from one row of means over hosts and over paths within hosts."""
    hosts = sums.dropDuplicates(["_host"])
    # Paths that are all of their host say nothing about spread within hosts.
    within = sums.filter(F.col("n") < F.col("host_n"))
    out = {}
    for k in KINDS:
        share = F.col(f"host_{k}") / F.col("host_n")
        mean, spread, noise = hosts.agg(
            F.sum(f"host_{k}") / F.sum("host_n"), F.var_pop(share), F.avg(1 / F.col("host_n"))
        ).first()
        apart, chance = within.agg(
            F.avg(F.pow(F.col(k) / F.col("n") - share, 2)), F.avg(1 / F.col("n") - 1 / F.col("host_n"))
        ).first()
        mean = 0.5 if mean is None else min(1 - 1e-6, max(1e-6, mean))
        out[k] = Prior(
            mean,
            strength(mean, spread or 0.0, noise or 1.0),
            MOST_STRENGTH if apart is None else strength(mean, apart, chance),
        )
    return out


def with_posteriors(scores: DataFrame, sums: DataFrame, host: str, path: str) -> DataFrame:
    """``scores`` with host_low, host_toxic, path_low, path_toxic and _bad, _keep.

    ``scores`` has _low and _toxic and may have other columns.  The posteriors
    are of the document's sites without the document itself.  A document is
    kept unless its posterior probability of being low in quality or toxic is
    over one half.
    """
    known = priors(sums)
    names = ["_n", "_host_n", *(f"_sum_{k}" for k in KINDS), *(f"_host_sum_{k}" for k in KINDS)]
    sites = sums.select(
        "_host", "_path", F.col("n").alias("_n"), F.col("host_n").alias("_host_n"),
        *(F.col(k).alias(f"_sum_{k}") for k in KINDS), *(F.col(f"host_{k}").alias(f"_host_sum_{k}") for k in KINDS),
    )
    # Both sides of the join are plain tables: without a broadcast a hot host can be split.
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    joined = scores.join(
        sites,
        (F.coalesce(scores[host].cast("string"), F.lit("")) == sites["_host"])
        & (F.coalesce(scores[path].cast("string"), F.lit("")) == sites["_path"]),
        "left",
    )
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    shifted = {}
    for k, prior in known.items():
        own = 1 / (1 + F.exp(-F.col(f"_{k}")))
        rest = lambda total: F.greatest(F.col(total) - own, F.lit(0.0))
        up = (prior.host_strength * prior.mean + rest(f"_host_sum_{k}")) / (F.col("_host_n") - 1 + prior.host_strength)
        joined = joined.withColumn(f"host_{k}", up)
        at = (prior.path_strength * F.col(f"host_{k}") + rest(f"_sum_{k}")) / (F.col("_n") - 1 + prior.path_strength)
        joined = joined.withColumn(f"path_{k}", at)
        shifted[k] = F.col(f"_{k}") + logit(F.col(f"path_{k}")) - logit(F.lit(prior.mean))
    joined = joined.withColumn("_bad", _bad(shifted["low"], shifted["toxic"]))
    joined = joined.withColumns({f"_{k}": c for k, c in shifted.items()})
    return joined.withColumn("_keep", F.col("_bad") <= 0.5).drop("_host", "_path", *names)


def quality_posteriors(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, low_quality, toxic, host_posterior, path_posterior, bad, keep).

    Every row gets a result: null texts are judged as empty ones, null ids
    stay null, repeated rows repeat (labelled ones are fitted once).  An empty
    table gives an empty one.  Texts are read twice (the labelled ones, and
    all); scores are written once and joined with the sites' sums.  The sites'
    posteriors are of low quality or toxicity, without the document itself.
    """
    require(docs, id_col, text_col, host, path)
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    narrow = docs.select(
        docs[id_col].alias("id"), docs[host].alias("host"), docs[path].alias("path"), docs[text_col].alias("text")
    )
    scores = written(with_evidence(narrow, model, "text", keep=False), "scores")
    judged = with_posteriors(scores, site_sums(scores, "host", "path"), "host", "path")
    either = lambda level: 1 - (1 - F.col(f"{level}_low")) * (1 - F.col(f"{level}_toxic"))
    return judged.select(
        "id",
        F.round(1 / (1 + F.exp(-F.col("_low"))), 6).alias("low_quality"),
        F.round(1 / (1 + F.exp(-F.col("_toxic"))), 6).alias("toxic"),
        F.round(either("host"), 6).alias("host_posterior"),
        F.round(either("path"), 6).alias("path_posterior"),
        F.round("_bad", 6).alias("bad"),
        F.col("_keep").alias("keep"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Texts are scored once; the rows with their scores are written and filtered
    when the sites' sums are known.  Nulls, repeated rows and empty tables are
    as in :func:`quality_posteriors`.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    # Numbered columns: no name of the caller's can clash with one of ours.
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    host, path, text = (own[names.index(c)] for c in (host, path, text_col))
    scored = written(with_evidence(docs.toDF(*own), model, text), "scored")
    kept = with_posteriors(scored, site_sums(scored, host, path), host, path).filter("_keep")
    return kept.select(*own).toDF(*names)
