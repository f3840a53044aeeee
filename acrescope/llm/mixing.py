"""Mixing sources to target weights: Pfair windows for each source's blocks, earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrescope.llm.common import free_prefix

BLOCK = 64  # documents of a source that stay together
MAX_SOURCES = 512
SALT_ROWS = 4_000  # rows of a source that are ordered in one task
PARTS = 1000  # units that default weights are rounded to


def pfair_period(weights: list[int]) -> list[int]:
    """Source of each slot of one period of sum(weights) slots.

    Block j of a source with weight n of a period q may start at floor(j q / n)
    and must be done by ceil((j + 1) q / n); in each slot the released block
    with the earliest deadline goes, of equals that of the first source. All
    deadlines are met, since the weights fill the period exactly.
    """
    q = sum(weights)
    waiting = sorted((j * q // n, -(-(j + 1) * q // n), s) for s, n in enumerate(weights) for j in range(n))
    out, ready, k = [], [], 0
    for slot in range(q):
        while k < q and waiting[k][0] <= slot:
            heapq.heappush(ready, waiting[k][1:])
            k += 1
        deadline, source = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block misses its deadline")
        out.append(source)
    return out


@dataclass(frozen=True)
class Schedule:
    """Per source and phase: first block, first slot, and its slots in a period. A phase ends when a source runs out."""

    phases: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]

    def slots(self, source: str, block: np.ndarray) -> np.ndarray:
        first, base, period, places = self.phases[source]
        phase = np.searchsorted(first, block, "right") - 1
        out = np.empty(len(block), np.int64)
        for p in np.unique(phase):
            pick, per = phase == p, len(places[p])
            k = block[pick] - first[p]
            out[pick] = base[p] + k // per * period[p] + places[p][k % per]
        return out


def plan(blocks: dict[str, int], weights: dict[str, int]) -> Schedule:
    """Slots for all blocks: while all sources last each gets its weight, then the rest share by theirs."""
    left = {s: n for s, n in sorted(blocks.items()) if n > 0}
    done, slot = dict.fromkeys(left, 0), 0
    found: dict[str, list] = {s: [] for s in left}
    while left:
        names = list(left)
        order = np.array(pfair_period([weights[s] for s in names]))
        places = {s: np.flatnonzero(order == k) for k, s in enumerate(names)}
        last = {s: (n - 1) // weights[s] * len(order) + places[s][(n - 1) % weights[s]] for s, n in left.items()}
        length = int(min(last.values())) + 1
        for s in names:
            found[s].append((done[s], slot, len(order), places[s]))
            served = length // len(order) * weights[s] + int(np.searchsorted(places[s], length % len(order)))
            done[s] += served
            left[s] -= served
        left = {s: n for s, n in left.items() if n > 0}
        slot += length
    return Schedule({s: tuple([*map(np.array, list(zip(*rows))[:3]), [r[3] for r in rows]]) for s, rows in found.items()})


def tempered_weights(rows: dict[str, int], power: float = 0.5) -> dict[str, int]:
    """Whole weights, about PARTS together and 1 at least, in proportion to a power of the sources' sizes."""
    total = sum(n ** power for n in rows.values())
    return {s: max(1, round(PARTS * n ** power / total)) for s, n in rows.items()}


PLACES = ("_source_index", "_block", "_slot")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, *, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK,
        power: float = 0.5) -> DataFrame:
    """The documents with _source_index (place in their source), _block and _slot, which replace columns of these names; all rows stay.

    Rows of a source are ordered by a hash of their id and cut into blocks of
    ``block``; a source's large number of rows is ordered in salted parts, with
    offsets from their counts. Only counts per source (at most MAX_SOURCES) and
    the schedule of one period per phase pass the driver. In each phase every
    source's blocks stay within one block of its weight's share of the slots.

    A null source is one named ''. Null ids and repeated rows count as rows;
    the order among rows of one id is open. A source without a weight has 1.
    """
    name = F.coalesce(F.col(source), F.lit(""))
    spread = F.xxhash64(F.col(doc_id), F.lit(23))
    per_source = docs.groupBy(name.alias("s")).count().limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = {r["s"]: r["count"] for r in per_source}
    weights = tempered_weights(rows, power) if weights is None else {s: int(weights.get(s, 1)) for s in rows}
    shared = docs.sparkSession.sparkContext.broadcast(plan({s: -(-n // block) for s, n in rows.items()}, weights))
    salts = max(1, -(-max(rows.values(), default=1) // SALT_ROWS))
    own = free_prefix([c for c in docs.columns if c not in PLACES], "_mix_")  # names that no column of the documents has
    salted = docs.withColumns({f"{own}source": name, f"{own}salt": F.pmod(spread, F.lit(salts)).cast("int"), f"{own}hash": spread})
    counts = salted.groupBy(f"{own}source", f"{own}salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(f"{own}source").orderBy(f"{own}salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(f"{own}source", f"{own}salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{own}before"))
    within = F.row_number().over(Window.partitionBy(f"{own}source", f"{own}salt").orderBy(f"{own}hash", doc_id)) - 1
    numbered = salted.withColumn(f"{own}row", within).join(F.broadcast(offsets) if len(rows) * salts <= 10_000 else offsets, [f"{own}source", f"{own}salt"])
    placed = numbered.withColumn("_source_index", F.col(f"{own}before") + F.col(f"{own}row"))
    placed = placed.withColumn("_block", F.floor(F.col("_source_index") / block))
    names = [c for c in docs.columns if c not in PLACES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.array(batch.column(f"{own}source").to_pylist(), dtype=object)
            at, out = batch.column("_block").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for s in set(group):
                pick = group == s
                out[pick] = shared.value.slots(s, at[pick])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("_source_index"), batch.column("_block"), pa.array(out)],
                                             names=[*names, "_source_index", "_block", "_slot"])

    zero = F.lit(0).cast("long")
    schema = docs.select(*names, zero.alias("_source_index"), zero.alias("_block"), zero.alias("_slot")).schema
    return placed.select(*names, f"{own}source", "_source_index", "_block").mapInArrow(run, schema)


def in_mixed_order(docs: DataFrame, weights: dict[str, int] | None = None, *, places: bool = False, **options) -> DataFrame:
    """The documents in the order of the mixture: sorted ranges of slots, columns as they were.

    Files that are read again come in another order; with ``places`` the columns of ``mix`` stay, which say it for good.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mix(docs, weights, **options)
    rows = rows.repartitionByRange(parts, "_slot", "_source_index").sortWithinPartitions("_slot", "_source_index")
    return rows if places else rows.select(*docs.columns)
