"""Streams of sites in order of position, with state by contig.

A contig's rows come in order from batch to batch; those of one batch may be in any
order. What may still change is kept as state and given when the positions have passed
its reach. A row before a position already seen is an error. A contig is closed by a row
without ``rec`` at or beyond its end: what is left is given then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from genoframe.operators import filters

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_COLUMNS = ["pos", "rec", "span", "ac", "is_snp", "is_indel"]
_SCHEMA = "pos long, rec long, span long, ac double, is_snp boolean, is_indel boolean"

#: Rows in order, those held with the value kept for each (-1 for new rows), and the position reached -> rows to hold, values to keep, rows to give.
Step = Callable[[pd.DataFrame, np.ndarray, int], tuple[pd.DataFrame, np.ndarray, pd.DataFrame]]


class InOrder(StatefulProcessor):
    """Holds a contig's rows that a ``step`` cannot settle yet."""

    def __init__(self, step: Step) -> None:
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", f"{_SCHEMA}, kept long")
        self.reached = handle.getValueState("reached", "pos long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's name)
        new = pd.concat(list(rows))[_COLUMNS]
        before = int(self.reached.get()[0]) if self.reached.exists() else None
        if before is not None and int(new["pos"].min()) < before:
            raise ValueError(f"contig {key[0]} is not in order: {int(new['pos'].min())} after {before}")
        reached = int(new["pos"].max())
        old = pd.DataFrame(list(self.held.get()), columns=[*_COLUMNS, "kept"])
        new = new[new["rec"].notna()].sort_values(["pos", "rec"])
        parts = [p for p in (old, new.assign(kept=-1)) if len(p)]
        self.reached.update((reached,))
        if not parts:
            return
        every = pd.concat(parts, ignore_index=True)
        hold, kept, give = self.step(every[_COLUMNS], every["kept"].to_numpy(dtype="int64"), reached)
        self.held.clear()
        if len(hold):
            self.held.put([_plain(r, k) for r, k in zip(hold.itertuples(index=False), kept)])
        yield give.assign(chrom=key[0])

    def close(self) -> None:
        pass


def _plain(row, kept) -> tuple:
    ac = None if row.ac is None or pd.isna(row.ac) else float(row.ac)
    return int(row.pos), int(row.rec), int(row.span), ac, bool(row.is_snp), bool(row.is_indel), int(kept)


def _stateful(rows: DataFrame, step: Step, out: str) -> DataFrame:
    if "RocksDB" not in rows.sparkSession.conf.get(_PROVIDER, ""):
        raise ValueError(f"set {_PROVIDER} to the RocksDB provider")
    kind = rows.schema["chrom"].dataType.simpleString()
    casts = [F.col(c).cast(t).alias(c) for c, t in (x.split() for x in _SCHEMA.split(", "))]
    return rows.select("chrom", *casts).groupBy("chrom").transformWithStateInPandas(InOrder(step), f"chrom {kind}, {out}", "append", "None")


def _flag(x: pd.Series) -> np.ndarray:
    return x.fillna(False).to_numpy(bool)


def snp_gap(rows: DataFrame, gap: int) -> DataFrame:
    """(chrom, pos, rec, near) of a table or a stream: a SNP within ``gap`` of an indel, see :func:`filters.with_snp_gap`.

    A stream holds the rows within ``gap`` of the position reached and the indels whose
    end, widened by it, is not passed.
    """
    if not rows.isStreaming:
        return filters.with_snp_gap(rows, gap).select("chrom", "pos", "rec", "near")

    def step(every: pd.DataFrame, given: np.ndarray, reached: int):
        pos, indel = every["pos"].to_numpy(dtype="int64"), _flag(every["is_indel"])
        end = pos + every["span"].to_numpy(dtype="int64") - 1 + gap
        order = np.argsort(pos[indel], kind="stable")
        starts, ends = pos[indel][order] - gap, np.maximum.accumulate(end[indel][order])
        at = np.searchsorted(starts, pos, "right") - 1
        near = _flag(every["is_snp"]) & (at >= 0) & (ends[np.maximum(at, 0)] >= pos) if len(ends) else np.zeros(len(pos), bool)
        settled = pos + gap < reached
        fresh = settled & (given != 1)
        hold = ~settled | (indel & (end >= reached))
        return every[hold], np.where(settled, 1, 0)[hold], every.loc[fresh, ["pos", "rec"]].assign(near=near[fresh])

    return _stateful(rows, step, "pos long, rec long, near boolean")


def indel_gap(indels: DataFrame, gap: int) -> DataFrame:
    """(chrom, pos, rec) of a table or a stream: the best indel of each chain, see :func:`filters.indel_gap`.

    A stream holds of each open chain its best indel and how far its last one reaches.
    """
    if not indels.isStreaming:
        return filters.indel_gap(indels, gap).select("chrom", "pos", "rec")

    def step(every: pd.DataFrame, kept: np.ndarray, reached: int):
        pos = every["pos"].to_numpy(dtype="int64")
        reach = np.where(kept >= 0, kept, pos + every["span"].to_numpy(dtype="int64") - 1 + gap)
        chain = np.cumsum(np.append(True, pos[1:] > reach[:-1]))
        last = pd.Series(reach).groupby(chain).last()
        best = every.assign(chain=chain).sort_values(["chain", "ac", "pos", "rec"], ascending=[True, False, True, True], na_position="last").groupby("chain").head(1)
        open_ = (best["chain"].map(last) >= reached).to_numpy()
        return best[open_], best["chain"].map(last).to_numpy()[open_], best.loc[~open_, ["pos", "rec"]]

    return _stateful(indels, step, "pos long, rec long")
