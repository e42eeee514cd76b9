"""Routing decisions on a stream from the state after the previous row (SS5 with RO5-RO7).

Rows go to lanes (the whole stream is one lane, or one per value of ``by``, cut further by a hash of the id); a lane's state is the
trials and successes per processor.  Each row is decided from the counters as the row before it left them, then its logged processor
and outcome are counted.  Within a micro-batch a lane's rows are taken in order of (time, id); earlier rows that arrive in a later
micro-batch are taken when they arrive.

A lane is sequential by nature and runs in one task, so a stream that one task cannot follow needs more lanes: each learns
from its own rows.  State is one short row a lane, kept by the checkpoint; a micro-batch's rows of a lane are held at once,
bounded by the source's rows per trigger.

Decisions equal the batch policies of ``operators.routing`` with one-row buckets: the same hash draws, the same ties (processor
order), the same rates.  Rows of processors not in ``arms`` are decided but not counted; a NULL outcome is a trial without success.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from payscope.functions import expr as X
from payscope.operators.routing import _pick_random

POLICIES = ["epsilon_greedy", "ucb", "thompson"]


def _best(values: Sequence[float], arms: Sequence[str]) -> str:
    """The arm of the largest value; ties: the first."""
    return arms[max(range(len(arms)), key=lambda i: (values[i], -i))]


def decide(policy: str, arms: Sequence[str], trials: Sequence[int], successes: Sequence[int], row, c: float, seed: int) -> str:
    """The policy's processor for a row (``explore``, ``pick`` and ``moment``) given the counters."""
    if policy == "epsilon_greedy":
        return row.pick if row.explore else _best([s / n if n else 0.0 for n, s in zip(trials, successes)], arms)
    if policy == "ucb":
        total = sum(trials)
        if total == 0:
            return row.pick
        return _best([s / n + c * math.sqrt(math.log(total) / n) if n else math.inf for n, s in zip(trials, successes)], arms)
    if policy == "thompson":
        draw = lambda a, n, s: np.random.default_rng(int(hashlib.md5(f"{row.moment}|{a}|{seed}".encode()).hexdigest()[:12], 16)).beta(s + 1, n - s + 1)
        return _best([draw(a, n, s) for a, n, s in zip(arms, trials, successes)], arms)
    raise ValueError(policy)


def route_stream(events: DataFrame, arms: Sequence[str], policies: Sequence[str] = ("epsilon_greedy", "ucb"), by: Sequence[str] = (),
                 lanes: int = 1, epsilon: float = 0.1, c: float = 1.0, seed: int = 42, ts: str = "txn_ts", id_col: str = "transaction_id",
                 arm: str = "processor_id", reward: str = "result") -> DataFrame:
    """One row per event: id, time, ``by``, trials before it (all processors of its lane), and ``route_<policy>`` each."""
    arms, policies, by = list(arms), list(policies), list(by)
    lane = F.pmod(F.xxhash64(id_col), F.lit(lanes)) if lanes > 1 else F.lit(0).cast("long")
    t = events.select(F.col(id_col).alias("id"), F.col(ts).alias("at"), *[F.col(k).cast("string").alias(f"by{i}") for i, k in enumerate(by)], lane.alias("lane"),
                      F.col(arm).alias("arm"), X.is_success(reward).alias("reward"),
                      (X.hash_uniform(id_col, F.lit("explore"), seed=seed) < epsilon).alias("explore"),
                      _pick_random(arms, X.hash_uniform(id_col, F.lit("pick"), seed=seed)).alias("pick"),
                      F.date_trunc("second", ts).cast("string").alias("moment"))
    keys = ["lane", *[f"by{i}" for i in range(len(by))]]
    place = {a: i for i, a in enumerate(arms)}

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trials, successes = map(list, state.get) if state.exists else ([0] * len(arms), [0] * len(arms))
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            out.append((row.id, row.at, *key[1:], sum(trials), *[decide(p, arms, trials, successes, row, c, seed) for p in policies]))
            i = place.get(row.arm)
            if i is not None:
                trials[i] += 1
                successes[i] += int(row.reward == 1)
        state.update((trials, successes))
        yield pd.DataFrame(out, columns=names)

    names = ["id", "at", *keys[1:], "trials_before", *[f"route_{p}" for p in policies]]
    types = [t.schema["id"].dataType.simpleString(), t.schema["at"].dataType.simpleString(), *["string"] * len(by), "long", *["string"] * len(policies)]
    done = t.groupBy(*keys).applyInPandasWithState(follow, ", ".join(f"{n} {x}" for n, x in zip(names, types)), "trials array<long>, successes array<long>",
                                                   "append", GroupStateTimeout.NoTimeout)
    back = {"id": id_col, "at": ts} | {f"by{i}": k for i, k in enumerate(by)}
    return done.select(*[F.col(n).alias(back.get(n, n)) for n in names])
