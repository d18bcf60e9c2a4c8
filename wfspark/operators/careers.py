"""Career embeddings, continuous-time chains and attention pooling: small matrices on the driver, rows in Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wfspark.operators.linear import _expm
from wfspark.operators.mobility import reachability


#: Pairs of roles or states whose square matrix may come to the driver.
MOST_PAIRS = 4_000_000


def _small(pairs: DataFrame) -> DataFrame:
    if pairs.limit(MOST_PAIRS + 1).count() > MOST_PAIRS:
        raise ValueError(f"at most {MOST_PAIRS} pairs of roles or states; group them first")
    return pairs


@dataclass
class CareerEmbeddings:
    """Unit vectors of roles from diffused transitions, and how far roles reach each other."""

    roles: list[str]
    vectors: np.ndarray
    reach: np.ndarray

    @classmethod
    def fit(cls, moves: DataFrame, dim: int = 8, steps: int = 3, decay: float = 0.6) -> CareerEmbeddings:
        """``moves``: source, target, p. The roles are few: their square matrix comes to the driver."""
        rows = _small(reachability(moves, steps, decay)).toPandas()
        roles = sorted({*rows["source"], *rows["target"]})
        if len(roles) < 3:
            raise ValueError("at least three roles are needed")
        at, m = {r: k for k, r in enumerate(roles)}, np.zeros((len(roles),) * 2)
        m[[at[s] for s in rows["source"]], [at[t] for t in rows["target"]]] = rows["reach"]
        u, s, _ = np.linalg.svd((m + m.T) / 2 + 0.1 * np.eye(len(roles)))
        v = (u * np.sqrt(s))[:, : max(2, min(dim, len(roles) - 2))]
        return cls(roles, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), m)

    def similarity(self) -> np.ndarray:
        return self.vectors @ self.vectors.T

    def to_json(self) -> str:
        return json.dumps({"roles": self.roles, "vectors": self.vectors.tolist(), "reach": self.reach.tolist()})

    @classmethod
    def from_json(cls, text: str) -> CareerEmbeddings:
        d = json.loads(text)
        return cls(d["roles"], np.array(d["vectors"]), np.array(d["reach"]))

    def associate(self, history: list[str], role: str | None = None, decay: float = 0.7) -> np.ndarray:
        """Unit vector of a person: decayed sum of the roles held, the last the heaviest; without known roles that of the present one, or zeros."""
        at = {r: k for k, r in enumerate(self.roles)}
        steps = [at[x] for x in history or [] if x in at] or ([at[role]] if role in at else [])
        v = decay ** np.arange(len(steps))[::-1] @ self.vectors[steps] if steps else np.zeros(self.vectors.shape[1])
        return v / max(np.linalg.norm(v), 1e-12)

    def with_role(self, role: str, like: dict[str, float]) -> CareerEmbeddings:
        """The embeddings with a new role, a weighted mix of known ones, which it reaches and is reached from as they are."""
        known = {k: v for k, v in like.items() if k in self.roles}
        if role in self.roles or not known or sum(known.values()) <= 0:
            raise ValueError("a new role needs a new name and weights of known roles")
        w = np.array([known.get(r, 0.0) for r in self.roles]) / sum(known.values())
        v = w @ self.vectors
        reach = np.block([[self.reach, (self.reach @ w)[:, None]], [w @ self.reach, np.array([[w @ self.reach @ w]])]])
        return CareerEmbeddings([*self.roles, role], np.vstack([self.vectors, v / max(np.linalg.norm(v), 1e-12)]), reach)

    def similarity_frame(self, spark) -> DataFrame:
        s = self.similarity()
        rows = [(a, b, float(s[i, j])) for i, a in enumerate(self.roles) for j, b in enumerate(self.roles)]
        return spark.createDataFrame(rows, "role_a string, role_b string, similarity double")

    def succession(self, people: DataFrame, entity: str, role: str, history: str, target: str, top: int = 10, decay: float = 0.7) -> DataFrame:
        """The people whose history lies nearest the target role: half cosine, half reach of their role. Those in the role don't compete."""
        spark = people.sparkSession
        k = self.roles.index(target)
        state = spark.sparkContext.broadcast((self.roles, self.vectors, self.reach[:, k] / max(self.reach[:, k].max(), 1e-12), k))

        @F.pandas_udf("double")
        def score(own: pd.Series, past: pd.Series) -> pd.Series:
            roles, vectors, reach, k = state.value
            at = {r: n for n, r in enumerate(roles)}
            out = []
            for r, h in zip(own, past):
                steps = [at[x] for x in (h if h is not None else [r]) if x in at]  # without a history: the present role
                w = decay ** np.arange(len(steps))[::-1]
                v = w @ vectors[steps] if steps else np.zeros(vectors.shape[1])
                v = v / max(np.linalg.norm(v), 1e-12)
                out.append(0.5 * float(v @ vectors[k]) + 0.5 * (float(reach[at[r]]) if r in at else 0.0))
            return pd.Series(out, dtype="float64")

        rated = people.where(F.col(role) != target).select(entity, role, F.round(score(F.col(role), F.col(history)), 4).alias("score"), F.array_join(history, " -> ").alias("path"))
        return rated.orderBy(F.desc("score"), entity).limit(top)


@dataclass
class MarkovChain:
    """A continuous-time chain from its rates."""

    states: list[str]
    q: np.ndarray

    @classmethod
    def fit(cls, rates: DataFrame) -> MarkovChain:
        rows = _small(rates.select("source", "target", "rate")).toPandas()
        states = sorted({*rows["source"], *rows["target"]})
        at, q = {s: k for k, s in enumerate(states)}, np.zeros((len(states),) * 2)
        q[[at[s] for s in rows["source"]], [at[t] for t in rows["target"]]] = rows["rate"]
        np.fill_diagonal(q, -q.sum(axis=1))
        return cls(states, q)

    def transition(self, t: float) -> np.ndarray:
        return _expm(self.q * t)

    def stationary(self) -> np.ndarray:
        a = np.vstack([self.q.T, np.ones(len(self.q))])
        p = np.maximum(np.linalg.lstsq(a, np.append(np.zeros(len(self.q)), 1.0), rcond=None)[0], 0)
        return p / p.sum()

    def frame(self, spark, t: float) -> DataFrame:
        p, s = self.transition(t), self.stationary()
        rows = [(a, b, float(p[i, j]), float(s[j])) for i, a in enumerate(self.states) for j, b in enumerate(self.states)]
        return spark.createDataFrame(rows, "source string, target string, probability double, stationary double")

    def simulate(self, spark, n: int, start: str, horizon: float, seed: int = 42) -> DataFrame:
        """Paths of n people, each from a seed of its own: path, step, state and time of entry."""
        states, q, first = self.states, self.q, self.states.index(start)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for path in batch["id"]:
                    r, at, t, step = np.random.default_rng([seed, int(path)]), first, 0.0, 0
                    while t < horizon:
                        rows.append((path, step, states[at], t))
                        if -q[at, at] <= 1e-9:
                            break
                        t += r.exponential(-1 / q[at, at])
                        p = np.maximum(q[at], 0)
                        at, step = int(r.choice(len(states), p=p / p.sum())), step + 1
                yield pd.DataFrame(rows, columns=["path", "step", "state", "entered"])

        return spark.range(n).mapInPandas(run, "path long, step int, state string, entered double")


@dataclass
class AttentionPooling:
    """Multi-head attention of one query over an entity's token vectors, followed by an output projection.

    The query is the mean token unless one is given. Weights: square matrices for queries, keys, values and output."""

    heads: int
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    output: np.ndarray

    @classmethod
    def fresh(cls, dim: int, heads: int = 2, seed: int = 42) -> AttentionPooling:
        """Uniform weights within the root of 3 / dim, drawn in the order query, key, value, output."""
        if heads < 1 or dim % heads:
            raise ValueError(f"{dim} dimensions can't be split into {heads} heads")
        r, bound = np.random.RandomState(seed), np.sqrt(6 / (2 * dim))
        return cls(heads, *(r.uniform(-bound, bound, (dim, dim)) for _ in range(4)))

    @property
    def dim(self) -> int:
        return len(self.query)

    def scores(self, tokens: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Tokens by heads; ``query``: one for all tokens, or one for each."""
        size = self.dim // self.heads
        q, k = np.atleast_2d(query) @ self.query, tokens @ self.key
        return (q * k).reshape(len(tokens), self.heads, size).sum(axis=2) / np.sqrt(size)

    def aggregate(self, tokens: np.ndarray, query: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context vector, weight of each token (mean of the heads), weights by head and token."""
        s = self.scores(tokens, tokens.mean(axis=0) if query is None else query)
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        values = (tokens @ self.value).reshape(len(tokens), self.heads, -1)
        return np.einsum("th,thd->hd", w, values).ravel() @ self.output, w.mean(axis=1), w.T

    def _asked(self, df: DataFrame, by: list[str], vector: str, query: list[float] | None) -> DataFrame:
        """Rows with ``__q``: the query given, or the entity's mean token."""
        if query is not None:
            if len(query) != self.dim:
                raise ValueError("query and tokens differ in their dimension")
            return df.withColumn("__q", F.lit([float(x) for x in query]))
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        token = array_to_vector(F.col(vector).cast("array<double>"))
        means = df.where(F.col(vector).isNotNull()).groupBy(*by).agg(vector_to_array(Summarizer.mean(token)).alias("__q"))
        return df.join(means, by)

    def transform(self, df: DataFrame, by: list[str], vector: str, query: list[float] | None = None) -> DataFrame:
        """``by``, pooled and n_tokens of each entity. Every task adds up what it has of an entity (largest score, sum of weights, weighted sum, by
        head); the parts of an entity are added in Spark, so its tokens never gather in one place."""
        names = [f"__b{k}" for k in range(len(by))]
        kinds = ", ".join(f"{n} {df.schema[b].dataType.simpleString()}" for n, b in zip(names, by))
        model = df.sparkSession.sparkContext.broadcast(self)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = model.value
            for batch in batches:
                if not len(batch):
                    continue
                x, q = np.stack(batch["__x"]).astype(float), np.stack(batch["__q"]).astype(float)
                s, v = m.scores(x, q), (x @ m.value).reshape(len(x), m.heads, -1)
                rows = []
                for key, at in batch.groupby(names, dropna=False, sort=False).indices.items():
                    top = s[at].max(axis=0)
                    w = np.exp(s[at] - top)
                    rows.append((*(key if isinstance(key, tuple) else (key,)), len(at), top.tolist(), w.sum(axis=0).tolist(), np.einsum("th,thd->hd", w, v[at]).ravel().tolist()))
                yield pd.DataFrame(rows, columns=[*names, "n", "top", "mass", "total"])

        asked = self._asked(df, by, vector, query).where(F.col(vector).isNotNull()).select(*[F.col(b).alias(n) for n, b in zip(names, by)], F.col(vector).cast("array<double>").alias("__x"), "__q")
        parts = asked.mapInPandas(part, f"{kinds}, n long, top array<double>, mass array<double>, total array<double>")
        heads, size = self.heads, self.dim // self.heads
        tops = parts.groupBy(*[F.col(n).alias(f"{n}t") for n in names]).agg(*[F.max(F.col("top")[h]).alias(f"__t{h}") for h in range(heads)])
        joined = parts.join(tops, [F.col(n).eqNullSafe(F.col(f"{n}t")) for n in names])
        scale = [F.exp(F.col("top")[h] - F.col(f"__t{h}")) for h in range(heads)]
        sums = [F.sum(scale[h] * F.col("mass")[h]).alias(f"__m{h}") for h in range(heads)] + [F.sum(scale[k // size] * F.col("total")[k]).alias(f"__v{k}") for k in range(self.dim)]
        added = joined.groupBy(*names).agg(F.sum("n").alias("n_tokens"), *sums)
        context = [F.col(f"__v{k}") / F.col(f"__m{k // size}") for k in range(self.dim)]
        project = F.pandas_udf(lambda x: pd.Series((np.stack(x) @ model.value.output).tolist() if len(x) else []), "array<double>")
        return added.select(*[F.col(n).alias(b) for n, b in zip(names, by)], project(F.array(*context)).alias("pooled"), "n_tokens")

    def weights(self, df: DataFrame, by: list[str], vector: str, query: list[float] | None = None) -> DataFrame:
        """The rows with ``attention``: the weight of each token within its entity, mean of the heads."""
        model = df.sparkSession.sparkContext.broadcast(self)
        score = F.pandas_udf(lambda x, q: pd.Series(model.value.scores(np.stack(x).astype(float), np.stack(q).astype(float)).tolist() if len(x) else []), "array<double>")
        scored = self._asked(df, by, vector, query).withColumn("__s", score(F.col(vector).cast("array<double>"), F.col("__q")))
        whole = Window.partitionBy(*by)
        heads = range(self.heads)
        scored = scored.withColumns({f"__e{h}": F.exp(F.col("__s")[h] - F.max(F.col("__s")[h]).over(whole)) for h in heads})
        share = sum((F.col(f"__e{h}") / F.sum(f"__e{h}").over(whole) for h in heads), F.lit(0.0)) / self.heads
        return scored.withColumn("attention", share).select(*df.columns, "attention")

    def to_json(self) -> str:
        return json.dumps({"heads": self.heads, **{k: getattr(self, k).tolist() for k in ("query", "key", "value", "output")}})

    @classmethod
    def from_json(cls, text: str) -> AttentionPooling:
        d = json.loads(text)
        return cls(d["heads"], *(np.array(d[k]) for k in ("query", "key", "value", "output")))


def mean_pool(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Plain mean of each entity's token vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    token = array_to_vector(F.col(vector).cast("array<double>"))
    return df.where(F.col(vector).isNotNull()).groupBy(*by).agg(vector_to_array(Summarizer.mean(token)).alias("pooled"), F.count("*").alias("n_tokens"))
