"""Repeated consecutive events: optimal segmentation of ordered sequences into runs of near-identical events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.shared import written

#: Consecutive places of a sequence that one task segments at once.
BLOCK = 8192
_SEGMENT = (
    "entity long, block long, first_ord long, last_ord long, n long, name string, t0 timestamp, t1 timestamp, "
    "head string, tail string, at_start boolean, at_end boolean"
)


def dissimilarity(texts: list[str | None]) -> np.ndarray:
    """Differing places of each text and the next one; infinite if one is null or empty or their lengths differ."""
    n = np.array([len(t) if t else 0 for t in texts])
    d = np.full(max(0, len(texts) - 1), np.inf)
    alike = np.flatnonzero((n[:-1] == n[1:]) & (n[:-1] > 0)) if len(texts) > 1 else np.zeros(0, int)
    for length in np.unique(n[alike]):
        left = alike[n[alike] == length]
        wide = max(1, 4_000_000 // int(length))
        for k in range(0, len(left), wide):
            part = left[k : k + wide]
            letters = lambda rows: np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), -1)
            d[part] = (letters(part) != letters(part + 1)).sum(axis=1)
    return d


class NeighbourCost:
    """Dissimilarity within a run as the sum over its neighbours. All open starts of a run then grow alike, so only the best one has to be kept."""

    additive = True

    def __init__(self, texts: list[str | None]):
        self.d = dissimilarity(texts)
        self.total = np.concatenate([[0.0], np.cumsum(np.where(np.isinf(self.d), 0, self.d))]).tolist()
        self.broken = np.isinf(self.d).tolist()

    def add(self, t: int, starts: list[int]) -> list[float]:
        """Cost of a run from each start to event t, inclusive."""
        return [self.total[t] - self.total[s] for s in starts]


class MedoidCost:
    """Dissimilarity within a run as the sum of its events' differing places from the run's medoid: the event for which that is least.
    A run that drifts from event to event gets dear, so it is split."""

    additive = False

    def __init__(self, texts: list[str | None]):
        self.broken = np.isinf(dissimilarity(texts)).tolist()
        self.codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
        self.sums: dict[int, np.ndarray] = {}

    def add(self, t: int, starts: list[int]) -> list[float]:
        first = starts[0]
        apart = (np.stack(self.codes[first : t + 1]) != self.codes[t]).sum(axis=1)  # one length from start to event
        out, kept = [], {}
        for s in starts:
            far = apart[s - first :]
            own = np.append(self.sums[s] + far[:-1], far.sum()) if s in self.sums else np.zeros(1)
            kept[s] = own
            out.append(float(own.min()))
        self.sums = kept
        return out


def segments(cost: NeighbourCost | MedoidCost | np.ndarray, penalty: float) -> np.ndarray:
    """First places of the best segmentation of some events (given by their cost, or by the dissimilarities of neighbours).

    Minimises the sum over runs of the dissimilarity within the run plus penalty for every run, by pruned dynamic
    programming: a start whose cost has reached the best cost of a run's end there never leads to a better
    segmentation, as splitting a run never raises the dissimilarity, and is dropped. Equal costs prefer longer runs."""
    if isinstance(cost, np.ndarray):
        d, cost = cost, NeighbourCost([])
        cost.total = np.concatenate([[0.0], np.cumsum(np.where(np.isinf(d), 0, d))]).tolist()
        cost.broken = np.isinf(d).tolist()
    n = len(cost.broken) + 1
    best, before = [0.0] * (n + 1), [0] * (n + 1)
    starts = [0]
    for t in range(1, n + 1):
        if t > 1 and cost.broken[t - 2]:
            starts = [t - 1]  # no run crosses an infinite dissimilarity
        costs = [best[s] + c for s, c in zip(starts, cost.add(t - 1, starts), strict=True)]
        least = min(costs)
        first = costs.index(least)
        before[t], best[t] = starts[first], least + penalty
        # With a cost that grows alike for all starts the others stay behind the best one.
        starts = [starts[first]] if cost.additive else [s for s, c in zip(starts, costs, strict=True) if c < best[t]]
        starts.append(t)
    cuts, t = [], n
    while t > 0:
        t = before[t]
        cuts.append(t)
    return np.array(cuts[::-1])


def _medoid(texts: list[str | None]) -> str | None:
    if not texts[0]:
        return texts[0]
    codes = np.stack([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts])
    return texts[int(np.argmin([(codes != c).sum() for c in codes]))]


def collapse_runs(events: DataFrame, penalty: float = 2.5, min_run: int = 1, block: int = BLOCK, medoid: bool = False) -> DataFrame:
    """One row for each run of near-identical consecutive events of an entity.

    events: entity, ord (never null, unique within the entity), name, text, at. The dissimilarity
    of neighbours is the number of differing letters, infinite for unequal lengths and for null or
    empty texts, which stand alone. Gives entity, first_ord, last_ord, name (of the first event),
    n_events and seconds from first to last at (null if none is known), for runs of min_run
    events or more.

    medoid: the dissimilarity within a run is the sum of differences from its medoid instead of that over neighbours, so a run
    that drifts is split; runs at the edges of blocks are then joined if the smaller one's events, each as far apart as the medoids are, cost no
    more than the penalty.

    A cost that is a sum over neighbours makes a cut best exactly where the two sides' costs and
    the penalty say so, whatever lies further away: an entity is cut into blocks of `block` places,
    each is segmented on its own, and the runs at the edges of blocks are joined where that costs no
    more than the penalty. So no task holds a whole entity, however long.
    """
    own = events.select(
        F.col("entity").cast("long").alias("entity"), F.col("ord").cast("long").alias("ord"), F.col("name").alias("name"), F.col("text").alias("text"), F.col("at").cast("timestamp").alias("at")
    ).withColumn("block", F.floor(F.col("ord") / block))

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        texts = [x if isinstance(x, str) else None for x in pdf["text"]]
        first = segments((MedoidCost if medoid else NeighbourCost)(texts), penalty)
        last = np.append(first[1:], len(texts)) - 1
        run = np.repeat(np.arange(len(first)), last - first + 1)
        at = pdf["at"].groupby(run)
        ends = np.zeros(len(first), bool)
        ends[[0, -1]] = True
        take = lambda c, rows: pdf[c].to_numpy()[rows]
        out = pd.DataFrame({"entity": take("entity", first), "block": take("block", first), "first_ord": take("ord", first), "last_ord": take("ord", last), "n": last - first + 1, "name": take("name", first), "t0": at.min().to_numpy(), "t1": at.max().to_numpy()})
        of = lambda i, j, k: (_medoid(texts[i : j + 1]) if medoid else texts[k])
        out["head"] = [of(i, j, i) if e else None for i, j, e in zip(first, last, ends, strict=True)]
        out["tail"] = [of(i, j, j) if e else None for i, j, e in zip(first, last, ends, strict=True)]
        out["at_start"], out["at_end"] = np.arange(len(first)) == 0, np.arange(len(first)) == len(first) - 1
        return out[ends | (out["n"].to_numpy() >= min_run)]

    segs = written(own.groupBy("entity", "block").applyInPandas(segment, _SEGMENT), "segments")
    edge = F.col("at_start") | F.col("at_end")
    # At most two rows of a block: the order of an entity's blocks is a small window.
    w = Window.partitionBy("entity").orderBy("first_ord")
    apart = F.size(F.filter(F.sequence(F.lit(1), F.length("head")), lambda i: F.substr("head", i, F.lit(1)) != F.substr("before", i, F.lit(1))))
    joins = F.col("at_start") & (F.length("head") > 0) & (F.length("head") == F.length("before"))
    chain = (
        segs.where(edge)
        .withColumns({"before": F.lag("tail").over(w), "n_before": F.lag("n").over(w)})
        .withColumn("new", F.when(joins, F.when(apart * (F.least("n", "n_before") if medoid else 1) <= penalty, 0).otherwise(1)).otherwise(1))
        .withColumn("chain", F.sum("new").over(w))
        .groupBy("entity", "chain")
        .agg(F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"), F.min_by("name", "first_ord").alias("name"), F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
        .drop("chain")
    )
    out = segs.where(~edge).select(*chain.columns).unionByName(chain).where(F.col("n") >= min_run)
    return out.select("entity", "first_ord", "last_ord", "name", F.col("n").alias("n_events"), ((F.unix_micros("t1") - F.unix_micros("t0")) / 1e6).alias("seconds"))
