"""Mixing sources to target weights (problem 8).

Method: Poisson replication. A document of a source with mean repetition rate r is written k times, where k inverts the Poisson
distribution with a hash-seeded uniform number, cut at the source's ``max_repeats``; the distribution's parameter is found by
inverting its cut mean, so that the cut distribution has the mean r. Copies are exploded and shuffled globally by a hash of
document and copy.

A source whose wanted tokens no parameter reaches is short: it is used ``max_repeats`` times, and what it lacks is shared by the
others in proportion to their weights (again up to their caps), so that the mix keeps its size. The report has the share that each
source can have, the one it got, and four standard deviations of the draw (``tolerance``) within which the two should agree.

Sizes are tokens of a public tokenizer whose rank file is a parameter; the tokenizer is loaded once per worker.

Defined results: sources are compared in normal form and named as in the targets; documents of no target source are not drawn
but count in the total. Null or empty texts have no tokens and are not drawn. A target without documents is short by its whole
demand. Repeated documents are separate documents. Weights need not add up to 1 (they are shares of the total). Empty input
gives an empty mix and a report of zeros. Columns beside id, text and source are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.names import source_key
from gleanery.session import stage
from gleanery.tables import small

MOST_SOURCES = 10_000
MOST_REPEATS = 1_000


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Path of a public vocabulary in the installed folder; any other rank file may be given to ``token_count`` instead."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_count(text: Column, rank_file: str) -> Column:
    """Tokens of each text by the byte-level BPE with these ranks; null texts have none."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for part in parts:
            yield pd.Series([0 if t is None else len(encode(t)) for t in part], dtype="int64")

    return count(text)


def _cumulative(lam: float, cap: int) -> np.ndarray:
    """P(X <= k) of a Poisson distribution for k below ``cap``, from logarithms, so that large parameters do not underflow."""
    k = np.arange(cap)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(cap, 1))))])[:cap]
    return np.minimum(1.0, np.cumsum(np.exp(k * math.log(lam) - lam - logs))) if lam > 0 else np.ones(cap)


def truncated_mean(lam: float, cap: int) -> float:
    """Mean of min(Poisson(lam), cap)."""
    return float((1.0 - _cumulative(lam, cap)).sum())


def truncated_variance(steps: list[float]) -> float:
    """Variance of the repetitions with these cumulative probabilities."""
    over = 1.0 - np.array(steps)
    return float(((2 * np.arange(len(steps)) + 1) * over).sum() - over.sum() ** 2)


def inverted(want: float, have: float, cap: int) -> float | None:
    """The parameter whose cut distribution has the mean want / have; infinite at the cap, None if no parameter reaches it."""
    if have * cap < want:
        return None
    if want <= 0 or have <= 0:
        return 0.0
    rate = want / have
    if rate >= cap:
        return math.inf
    low, high = rate, rate + 1.0
    while truncated_mean(high, cap) < rate and high < 1e12:
        high *= 2
    for _ in range(100):
        lam = (low + high) / 2
        low, high = (lam, high) if truncated_mean(lam, cap) < rate else (low, lam)
    return high


def thresholds(lam: float | None, cap: int) -> list[float]:
    """The cumulative probabilities of 0 .. cap-1 repetitions; none of them where the source is used as often as it may be."""
    if lam is None or math.isinf(lam):
        return [0.0] * cap
    return _cumulative(lam, cap).tolist()


def water_fill(weights: list[float], most: list[float], total: float) -> list[float]:
    """Amounts in proportion to ``weights`` that add up to ``total``, none above ``most`` (less, if all of them are used up)."""
    out, free = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0]
    while free:
        mass = sum(weights[i] for i in free)
        full = [i for i in free if weights[i] / mass * total >= most[i]]
        for i in full or free:
            out[i] = most[i] if full else weights[i] / mass * total
        total -= sum(most[i] for i in full)
        free = [i for i in free if i not in full] if full else []
    return out


class Mix:
    """Token counts and repetition rates for one corpus and one table of targets."""

    def __init__(
        self, docs: DataFrame, targets: DataFrame, rank_file: str | None = None, key: str = "doc_id", text: str = "text", source: str = "source", salt: str = "mix-1"
    ) -> None:
        self.spark, self.key, self.salt = docs.sparkSession, key, salt
        self.targets = small(targets.select("source", "weight", "max_repeats"), MOST_SOURCES, "mix targets")
        counted = docs.select(
            F.col(key), source_key(F.col(source)).alias("source_key"), token_count(F.col(text), rank_file or tokenizer_file()).alias("tokens")
        )
        self.sizes = stage(counted, "tokens")
        self.plan = self._plan()

    def _plan(self) -> list[dict]:
        names = self.spark.createDataFrame([(r["source"],) for r in self.targets], "source string")
        keys = [r["k"] for r in names.select(source_key(F.col("source")).alias("k")).collect()]
        per = self.sizes.groupBy("source_key").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"), F.sum(F.col("tokens").cast("double") ** 2).alias("sq"))
        listed = per.where(F.col("source_key").isin(*[k for k in keys if k is not None]))
        held = {r["source_key"]: (r["n"], r["docs"], r["sq"]) for r in listed.collect()}
        total = self.sizes.agg(F.sum("tokens")).first()[0] or 0
        out = []
        for r, k in zip(self.targets, keys, strict=True):
            have, docs, squares = held.get(k, (0, 0, 0.0))
            weight, cap = float(r["weight"] or 0), int(r["max_repeats"] or 0)
            if cap > MOST_REPEATS:
                raise ValueError(f"max_repeats {cap} of {r['source']} is more than {MOST_REPEATS}")
            short = inverted(weight * total, have, cap) is None
            out.append({"source": r["source"], "key": k, "weight": weight, "cap": cap, "tokens": have, "docs": docs, "squares": squares, "short": short})
        amounts = water_fill([p["weight"] for p in out], [float(p["tokens"] * p["cap"]) for p in out], sum(p["weight"] for p in out) * total)
        size = sum(amounts)
        for p, amount in zip(out, amounts, strict=True):
            p["rate"] = amount / p["tokens"] if p["tokens"] else 0.0
            p["steps"] = thresholds(inverted(min(amount, p["tokens"] * p["cap"]), p["tokens"], p["cap"]), p["cap"])
            p["target_share"] = amount / size if size else 0.0
            p["variance"] = max(0.0, truncated_variance(p["steps"]) * p["squares"])
        spread = sum(p["variance"] for p in out)
        for p in out:  # of a share: its own tokens vary, and so does the sum
            s = p["target_share"]
            p["tolerance"] = 4 * math.sqrt(max(0.0, (1 - 2 * s) * p["variance"] + s * s * spread)) / size if size else 0.0
        return out

    def short(self) -> DataFrame:
        """Sources that cannot reach their weight, even with all their text used as often as is allowed."""
        return self.report().where("short").select("source")

    def drawn(self) -> DataFrame:
        """``(key, source, tokens, copy_no)`` of every copy, not yet shuffled."""
        plan = [(p["key"], p["source"], p["steps"]) for p in self.plan if p["key"] is not None]
        steps = F.broadcast(self.spark.createDataFrame(plan, "source_key string, source string, steps array<double>"))  # MOST_SOURCES
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(self.salt), self.key), 11).cast("double") / F.lit(float(2**53))
        rows = self.sizes.where("tokens > 0").join(steps, "source_key").withColumn("_u", unit)
        rows = rows.withColumn("_k", F.size(F.filter("steps", lambda s: s <= F.col("_u")))).where("_k > 0")
        return rows.select(self.key, "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("copy_no"))

    def mixed(self) -> DataFrame:
        """The copies in a global random order, which ``position_key`` gives; the order is the same on every run."""
        out = self.drawn().withColumn("position_key", F.xxhash64(F.lit(self.salt + ":order"), self.key, "copy_no"))
        return out.repartitionByRange("position_key").sortWithinPartitions("position_key", self.key, "copy_no")

    def report(self) -> DataFrame:
        """Per target source: wanted and actual share of the mix, size, repetition rate, and whether the target is out of reach."""
        got = self.drawn().groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.count("*").alias("copies"), F.max("copy_no").alias("most_repeats"))
        fields = ("source", "weight", "cap", "docs", "tokens", "rate", "short", "target_share", "tolerance")
        base = self.spark.createDataFrame(
            [tuple(p[k] for k in fields) for p in self.plan],
            "source string, weight double, max_repeats int, docs long, tokens long, rate double, short boolean, target_share double, tolerance double",
        )
        out = base.join(got, "source", "left").na.fill(0, ["drawn_tokens", "copies", "most_repeats"])
        total = out.agg(F.sum("drawn_tokens").alias("_t"))
        return out.join(F.broadcast(total)).select(  # one row
            "source", "weight", "max_repeats", "docs", "tokens", "rate", "drawn_tokens", "copies", "most_repeats", "target_share",
            F.when(F.col("_t") > 0, F.col("drawn_tokens") / F.col("_t")).alias("actual_share"), "tolerance", "short",
        )
