"""Mixing sources to target weights by balanced sampling (cube method).

Each mix asks of each source for a number of tokens. Where that is more than the source holds, its documents are
taken whole times first; the rest is a sample in which each document has the same inclusion probability. The
cube method draws it: the vector of probabilities moves, at random but without drift, along the null space of
the balancing constraints (tokens and documents of the sample keep their expected totals) until each coordinate
is 0 or 1. With two constraints three undecided documents are always enough to move, so the flight is a single
pass over a part of the documents which leaves at most two undecided in each stratum; these few go on to a next
flight, and the last two are landed. Parts are made by a hash of the document, of ids and sizes only, so that
a source of any share is drawn by many tasks and the draw is the same on any cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loomstead.llm.tokens import count_column
from loomstead.session import write_once

#: Mixes are a small hand-written table; more rows than this are an error, as each task holds them all.
MOST_TARGETS = 10_000
#: Documents of a part, about; each part is a flight of its own.
PART = 32_768


def plan_shares(targets: list[Row], held: dict[str, tuple[int, int]]) -> list[dict]:
    """What each mix takes of each source: whole repeats and the probability of one more.

    targets: rows of mix_name, budget_ratio, source, target_share, max_repeats; equal rows count once, of rows that
    differ for the same mix and source the shares add up and the largest max_repeats holds. held: tokens and
    documents of each source. A source that can't give its part (absent, or at its cap) gives all it may; what it
    lacks is spread over the mix's other sources in proportion to their shares, so that the budget is met if at
    all possible. Null or negative shares, ratios and caps count as 0.
    """
    total = sum(tokens for tokens, _ in held.values())
    mixes: dict[str, dict[str, list[float]]] = {}
    ratio: dict[str, float] = {}
    for r in dict.fromkeys((t.mix_name, t.budget_ratio, t.source, t.target_share, t.max_repeats) for t in targets):
        name, budget, source, share, repeats = r
        ratio[name] = max(ratio.get(name, 0.0), budget or 0.0)
        was = mixes.setdefault(name, {}).get(source, [0.0, 0.0])
        mixes[name][source] = [was[0] + max(share or 0.0, 0.0), max(was[1], repeats or 0)]
    out = []
    for name, sources in mixes.items():
        most = {s: held.get(s, (0, 0))[0] * cap for s, (_, cap) in sources.items()}
        give = dict.fromkeys(sources, 0.0)
        left, open_ = ratio[name] * total, {s for s in sources if most[s] > 0 and sources[s][0] > 0}
        whole = sum(share for share, _ in sources.values())
        left *= min(1.0, whole) if whole > 0 else 0.0
        while open_ and left > 1e-9:
            weight = sum(sources[s][0] for s in open_)
            full = {s for s in open_ if give[s] + left * sources[s][0] / weight >= most[s]}
            if not full:
                for s in open_:
                    give[s] += left * sources[s][0] / weight
                break
            for s in full:
                left -= most[s] - give[s]
                give[s] = most[s]
            open_ -= full
        for s, (share, cap) in sources.items():
            rate = give[s] / held[s][0] if held.get(s, (0, 0))[0] else 0.0
            base = int(min(rate + 1e-12, cap))
            out.append(
                {"mix": name, "source": s, "share": share, "cap": int(cap), "base": base}
                | {"p": max(0.0, rate - base) if base < cap else 0.0, "asked": ratio[name] * total * share}
            )
    return out


def flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities until at most two lie strictly between 0 and 1, keeping sum(p) and sum(p * sizes)."""
    p = p.astype(np.float64).copy()
    inside = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if len(inside) < 3:
        return p
    waiting = inside.tolist()
    size, prob = sizes.tolist(), p.tolist()
    draws = rng.random(len(waiting) + 3).tolist()
    trio = [waiting.pop() for _ in range(3)]
    while True:
        i, j, k = trio
        a, b, c = size[i], size[j], size[k]
        u = (b - c, c - a, a - b)
        if a == b == c:
            u = (1, -1, 0)
        up = down = float("inf")
        for t, step in zip(trio, u):
            if step > 0:
                up, down = min(up, (1 - prob[t]) / step), min(down, prob[t] / step)
            elif step < 0:
                up, down = min(up, prob[t] / -step), min(down, (1 - prob[t]) / -step)
        move = up if draws.pop() * (up + down) < down else -down
        keep = []
        for t, step in zip(trio, u):
            q = prob[t] + move * step
            prob[t] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
            if 0.0 < prob[t] < 1.0:
                keep.append(t)
        while len(keep) < 3 and waiting:
            keep.append(waiting.pop())
        if len(keep) < 3:
            return np.array(prob)
        if not draws:
            draws = rng.random(64).tolist()
        trio = keep


def land(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last few so that the sample's tokens, then its documents, miss their expected totals by the least; ties at random."""
    p = p.copy()
    for start in range(0, max(1, len(p)), 12):
        part = np.flatnonzero((p[start : start + 12] > 0) & (p[start : start + 12] < 1)) + start
        if not len(part):
            continue
        choices = (np.arange(1 << len(part))[:, None] >> np.arange(len(part))) & 1
        miss = np.abs(choices @ sizes[part] - p[part] @ sizes[part]) + 0.5 * np.abs(choices.sum(axis=1) - p[part].sum())
        miss += 1e-9 * rng.random(len(choices))
        p[part] = choices[np.argmin(miss)]
    return p


def _generator(*of: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(of).encode()).digest()[:8], "little"))


def compose(
    documents: DataFrame,
    targets: DataFrame,
    text: str = "text",
    vocabulary: str = "byte_bpe_50k",
    folder: str | None = None,
    seed: int = 7,
) -> tuple[DataFrame, list[dict], dict[str, tuple[int, int]]]:
    """Draw all mixes: rows (mix_name, source, doc_id, tokens, repeats) with repeats >= 1, the plan, and the holdings.

    Documents without tokens (null or empty text), without a source or without a doc_id are never drawn. A document
    given twice (same doc_id) counts as two. Empty tables give no rows. The draw depends on the rows and the seed only.
    """
    sized = count_column(
        documents.select(F.col("doc_id"), F.col("source"), F.col(text).alias("text")), "text", "tokens", vocabulary, folder
    )
    sized = write_once(sized.where("tokens > 0 and source is not null and doc_id is not null"), "sizes")
    rows = targets.select("mix_name", "budget_ratio", "source", "target_share", "max_repeats")
    wanted = rows.where("mix_name is not null and source is not null").limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} rows of mix targets")
    names = sorted({r.source for r in wanted})
    totals = sized.groupBy(F.when(F.col("source").isin(names), F.col("source")).alias("source"))
    held = {r.source: (r.tokens, r.docs) for r in totals.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    plan = plan_shares(wanted, held)
    by_source: dict[str, list[tuple]] = {}
    for x in plan:
        by_source.setdefault(x["source"], []).append((x["mix"], x["base"], x["p"]))
    schema = "mix_name string, source string, doc_id long, tokens long, repeats int, p double"

    def draw(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        source = np.array(group.column("source").to_pylist(), object)
        ids, tokens = group.column("doc_id").to_numpy(), group.column("tokens").to_numpy()
        parts = []
        for s in sorted(set(source.tolist()) & by_source.keys()):
            rows = np.flatnonzero(source == s)
            i, t = ids[rows], tokens[rows]
            for mix, base, p in by_source[s]:
                if p == 0.0 and base == 0:
                    continue
                q = flight(t, np.full(len(rows), p), _generator(seed, mix, s, key[0].as_py()))
                undecided = (q > 0) & (q < 1)
                repeats = base + (q == 1).astype(np.int32)
                taken = undecided | (repeats > 0)
                parts.append(_batch(mix, s, i[taken], t[taken], repeats[taken], np.where(undecided, q, np.nan)[taken]))
        return pa.Table.from_batches(parts or [_batch("", "", ids[:0], tokens[:0], np.zeros(0, np.int32), np.zeros(0))])

    # Narrow rows in parts by a hash of the document, so that the draw doesn't depend on files, tasks or batches.
    parts = max(1, -(-sum(docs for _, docs in held.values()) // PART))
    parted = sized.select("doc_id", "source", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"))
    drawn = write_once(parted.groupBy("part").applyInArrow(draw, schema), "drawn")
    decided = drawn.where(F.isnan("p")).drop("p")
    again = drawn.where(~F.isnan("p"))

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        mix, s = (x.as_py() for x in key)
        group = group.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        t, q = group.column("tokens").to_numpy(), group.column("p").to_numpy()
        q = land(t, flight(t, q, _generator(seed, mix, s, "last")), _generator(seed, mix, s, "landing"))
        repeats = pa.array(group.column("repeats").to_numpy() + (q == 1).astype(np.int32), pa.int32())
        return group.set_column(group.schema.get_field_index("repeats"), "repeats", repeats).drop_columns(["p"])

    # At most two undecided of each partition and stratum come here.
    landed = again.groupBy("mix_name", "source").applyInArrow(finish, "mix_name string, source string, doc_id long, tokens long, repeats int")
    return decided.unionByName(landed.where("repeats > 0")), plan, held


def _batch(mix: str, source: str, ids: np.ndarray, tokens: np.ndarray, repeats: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([mix] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(ids, pa.int64())]
        + [pa.array(tokens, pa.int64()), pa.array(repeats, pa.int32()), pa.array(p, pa.float64())],
        ["mix_name", "source", "doc_id", "tokens", "repeats", "p"],
    )


def shares(drawn: DataFrame, plan: list[dict]) -> DataFrame:
    """The report of a draw: for each mix and source the asked and the actual tokens, documents and shares."""
    spark = drawn.sparkSession
    asked = spark.createDataFrame(
        [(x["mix"], x["source"], x["share"], x["cap"], float(x["asked"])) for x in plan],
        "mix_name string, source string, target_share double, max_repeats int, asked_tokens double",
    )
    got = drawn.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"),
        F.count("*").alias("documents"),
        F.max("repeats").alias("most_repeats"),
    )
    whole = got.groupBy("mix_name").agg(F.sum("actual_tokens").alias("mix_tokens"))
    joined = asked.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    return joined.select(
        "mix_name",
        "source",
        "target_share",
        "max_repeats",
        "asked_tokens",
        F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.coalesce(F.col("actual_tokens") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("actual_share"),
    )
