"""Scoring of token vectors with injected weights, and spans of attention: numpy on Arrow batches.

Weights are a plain dict of arrays (see `Weights`), broadcast once. An embedder is any callable from a list of sequences
to a list of (length, width) arrays; `hash_embedder` is a deterministic one for tests and examples.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[np.ndarray]]


@dataclass
class Weights:
    """Matrices (out, in) and vectors by name: dense layers `name.w`, `name.b`, normalisations `name.g`, `name.b`.

    Layers: token1, token2, token3 with norm1, norm2, norm3 after each; score_norm, score1, score2; seq1, seq2;
    alpha_norm, alpha1, alpha2. The settings have the defaults of the published checkpoints.
    """

    arrays: dict[str, np.ndarray]
    tau: float = 3.0
    tau_gamma: float = 0.0
    tau_reference: float = 1000.0
    least_base: float = 70.0
    least_width: float = 0.02
    k_sigma: float = 2.0
    alpha_most: float | None = None
    length_scale: float = 1.0
    coarse: int = 0
    temperature: float = 1.0
    cache: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, **settings) -> Weights:
        """Arrays of a .npz file by name; settings as keywords."""
        with np.load(path) as held:
            return cls({k: held[k] for k in held.files}, **settings)

    def save(self, path: str) -> None:
        np.savez(path, **self.arrays)

    @classmethod
    def random(cls, width: int, seed: int = 0, hidden: Sequence[int] = (64, 48, 32), **settings) -> Weights:
        """Small random weights for tests; the published sizes are hidden=(1024, 512, 256)."""
        rng = np.random.default_rng(seed)
        a: dict[str, np.ndarray] = {}

        def dense(name: str, n_in: int, n_out: int) -> None:
            a[f"{name}.w"], a[f"{name}.b"] = rng.normal(0, 1 / math.sqrt(n_in), (n_out, n_in)), rng.normal(0, 0.1, n_out)

        def normal(name: str, n: int) -> None:
            a[f"{name}.g"], a[f"{name}.b"] = 1 + rng.normal(0, 0.1, n), rng.normal(0, 0.1, n)

        last = width + 1
        for i, h in enumerate(hidden, 1):
            dense(f"token{i}", last, h)
            normal(f"norm{i}", h)
            last = h
        normal("score_norm", last), dense("score1", last, 16), dense("score2", 16, 1)
        dense("seq1", last + 2, 24), dense("seq2", 24, 1)
        normal("alpha_norm", last + 2), dense("alpha1", last + 2, 16), dense("alpha2", 16, 1)
        return cls(a, **settings)

    def dense(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.arrays[f"{name}.w"].T + self.arrays[f"{name}.b"]

    def normalise(self, name: str, x: np.ndarray) -> np.ndarray:
        m = x.mean(-1, keepdims=True)
        return (x - m) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * self.arrays[f"{name}.g"] + self.arrays[f"{name}.b"]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


_erf = np.vectorize(math.erf)


def _moments(w: np.ndarray, at: np.ndarray) -> tuple[float, float]:
    mu = float((w * at).sum())
    return mu, math.sqrt(float((w * (at - mu) ** 2).sum()) + 1e-8)


def token_states(tokens: list[np.ndarray], weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """(states, scores) of the tokens of each sequence; all tokens go through the layers together, one under the other, so that nothing is padded."""
    sizes = [len(t) for t in tokens]
    at = np.concatenate([np.arange(n) / max(n - 1, 1) for n in sizes])
    h = np.concatenate((np.concatenate([np.asarray(t, np.float64) for t in tokens]), at[:, None]), 1)
    for i in (1, 2, 3):
        h = weights.normalise(f"norm{i}", np.maximum(weights.dense(f"token{i}", h), 0))
    s = weights.dense("score1", weights.normalise("score_norm", h))
    z = weights.dense("score2", 0.5 * s * (1 + _erf(s / math.sqrt(2))))[:, 0]
    cuts = np.cumsum(sizes)[:-1]
    return list(zip(np.split(h, cuts), np.split(z, cuts)))


def score_batch(tokens: list[np.ndarray], weights: Weights) -> list[dict]:
    """The prediction of each sequence's token vectors (L, width), L >= 1."""
    return [_predicted(h, z, weights) for h, z in token_states(tokens, weights)] if tokens else []


def score_sequence(tokens: np.ndarray, weights: Weights) -> dict:
    """The prediction of one sequence."""
    return score_batch([tokens], weights)[0]


def _predicted(h: np.ndarray, z: np.ndarray, weights: Weights) -> dict:
    """P, logit, span and attention from the states and scores of one sequence's tokens.

    A position channel is appended; the tokens' scores give an anchor (a softmax at temperature tau), whose mean and
    spread shape a Gaussian prior, which with the scores gives the attention; the pooled context gives the logit, and
    the attention's mean and k sigma the span.
    """
    n = len(z)
    at = np.arange(n) / max(n - 1, 1)
    tau = weights.tau
    if weights.tau_gamma:
        tau *= min(4.0, max(0.25, n / weights.tau_reference)) ** weights.tau_gamma
    scaled = (z - z.mean()) / math.sqrt(z.var() + 1e-6) / tau
    anchor = _softmax(scaled)
    if weights.coarse >= 2 and n >= 2:
        cells = np.array([scaled[i : i + weights.coarse].max() for i in range(0, n, weights.coarse)])
        mu, sigma = _moments(_softmax(cells), np.arange(len(cells)) / max(math.ceil(n / weights.coarse) - 1, 1))
    else:
        mu, sigma = _moments(anchor, at)
    least = max(weights.least_base / n, weights.least_width)
    sigma = min(0.5, max(sigma, least))
    length = weights.length_scale * np.array([math.log(n + 1.0), 1.0 / n])
    x = np.concatenate((anchor @ h, length))
    raw = float(weights.dense("alpha2", np.maximum(weights.dense("alpha1", weights.normalise("alpha_norm", x)), 0))[0])
    alpha = max(raw, 0.0) + math.log1p(math.exp(-abs(raw)))
    if weights.alpha_most is not None:
        alpha = min(alpha, weights.alpha_most)
    w = _softmax(z - z.mean() - alpha * 0.5 * ((at - mu) / sigma) ** 2)
    logit = float(weights.dense("seq2", np.maximum(weights.dense("seq1", np.concatenate((w @ h, length))), 0))[0])
    mu_a, sigma_a = _moments(w, at)
    sigma_a = min(0.5, max(sigma_a, least))
    lo, hi = max(0.0, mu_a - weights.k_sigma * sigma_a), min(1.0, mu_a + weights.k_sigma * sigma_a)
    calibrated = logit / weights.temperature
    s_idx, e_idx = sorted(int(min(n - 1, max(0, np.rint(v * (n - 1))))) for v in (lo, hi))
    return {"L": n, "P": 1 / (1 + math.exp(-calibrated)), "logit": logit, "calibrated_logit": calibrated, "S_norm": lo, "E_norm": hi, "S_idx": s_idx, "E_idx": e_idx, "mu": mu, "sigma": sigma, "mu_attn": mu_a, "sigma_attn": sigma_a, "alpha": alpha, "w": w.tolist()}


def hash_embedder(width: int = 8) -> Embedder:
    """Vectors that depend on a residue, its neighbours and nothing else: numbers in [-1, 1] from a hash."""

    def embed(seqs: list[str]) -> list[np.ndarray]:
        if any(not s for s in seqs):
            raise ValueError("empty sequence")
        out = []
        for s in seqs:
            rows = [hashlib.blake2b(s[max(0, i - 1) : i + 2].encode() + bytes([min(i, 1)]), digest_size=width).digest() for i in range(len(s))]
            out.append(np.frombuffer(b"".join(rows), np.uint8).reshape(len(s), width) / 127.5 - 1)
        return out

    return embed


def resilient(embed: Embedder, seqs: list[str], tries: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> list[tuple[np.ndarray | None, str | None]]:
    """(vectors, error) of each sequence: the batch is tried with waits that double, then each sequence by itself; failures are recorded."""

    def attempt(batch: list[str]) -> tuple[list[np.ndarray] | None, str]:
        error = ""
        for k in range(max(1, tries)):
            try:
                return embed(batch), ""
            except Exception as e:  # noqa: BLE001 - whatever a user's embedder raises is recorded
                error = f"{type(e).__name__}: {e}"
                if k + 1 < tries:
                    sleep(wait * 2**k)
        return None, error

    whole, _ = attempt(seqs)
    if whole is not None:
        return [(v, None) for v in whole]
    out: list[tuple[np.ndarray | None, str | None]] = []
    for s in seqs:
        got, error = attempt([s])
        out.append((got[0], None) if got is not None else (None, error))
    return out


FIELDS = "L int, P double, logit double, calibrated_logit double, S_norm double, E_norm double, S_idx int, E_idx int, mu double, sigma double, mu_attn double, sigma_attn double, alpha double, w array<double>"


def score_chunks(df: DataFrame, key: str, seq: str, embed: Embedder, weights: Weights, most_tokens: int = 80_000, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """(key, prediction fields, error): the model on each sequence; failed, empty and null ones have nulls and an error.

    Sequences of an Arrow batch are embedded in micro-batches of at most most_tokens (length + 2 each), at least one.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows: list[dict] = []
            start, held, texts = 0, 0, frame["seq"].tolist()

            def flush(a: int, b: int) -> None:
                given = [(i, t) for i, t in enumerate(texts[a:b]) if t]
                got = dict(zip((i for i, _ in given), resilient(embed, [t for _, t in given], tries, wait))) if given else {}
                good = [i for i in range(b - a) if got.get(i, (None, None))[0] is not None]
                scored = dict(zip(good, score_batch([got[i][0] for i in good], weights)))
                for i in range(b - a):
                    error = got.get(i, (None, "empty sequence"))[1]
                    rows.append(scored[i] | {"error": None} if i in scored else dict.fromkeys(names) | {"error": error})

            for i, t in enumerate(texts):
                n = len(t or "") + 2
                if i > start and held + n > most_tokens:
                    flush(start, i)
                    start, held = i, 0
                held += n
            flush(start, len(texts))
            out = pd.DataFrame(rows, columns=[*names, "error"])
            for c in ("L", "S_idx", "E_idx"):
                out[c] = out[c].astype("Int32")
            out.insert(0, "key", frame["key"].to_numpy())
            yield out

    x = df.select(F.col(key).alias("key"), F.col(seq).alias("seq"))
    return x.mapInPandas(run, f"key {kind}, {FIELDS}, error string").withColumnRenamed("key", key)


def hpd(weights: np.ndarray, mass: float) -> tuple[int, int] | None:
    """(first, last) of the shortest run with a sum of at least mass (within 1e-12), the first of equal ones; None for none."""
    sums = np.concatenate(([0.0], np.cumsum(np.asarray(weights, np.float64))))
    ends = np.searchsorted(sums, sums[:-1] + mass - 1e-12, side="left")
    ok = np.flatnonzero(ends < len(sums))
    if not len(ok):
        return None
    size = np.maximum(ends[ok], ok + 1) - ok
    i = int(size.argmin())
    return int(ok[i]), int(ok[i] + size[i] - 1)


def hpd_spans(df: DataFrame, key: str, weights: str, mass: float) -> DataFrame:
    """(key, s, e, mass, entropy): the shortest span of each row's weights (not negative) with that mass, in linear time; nulls for none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for k, w in zip(frame["key"], frame["w"]):
                w = np.asarray(w if w is not None else [], np.float64)
                found = hpd(w, mass) if len(w) else None
                c = np.maximum(w, 1e-12)
                rows.append((k, *(found or (None, None)), float(w[found[0] : found[1] + 1].sum()) if found else None, float(-(c * np.log(c)).sum() / math.log(max(len(w), 2))) if len(w) else None))
            yield pd.DataFrame(rows, columns=["key", "s", "e", "mass", "entropy"]).astype({"s": "Int32", "e": "Int32"})

    x = df.select(F.col(key).alias("key"), F.col(weights).cast("array<double>").alias("w"))
    return x.mapInPandas(run, f"key {kind}, s int, e int, mass double, entropy double").withColumnRenamed("key", key)
