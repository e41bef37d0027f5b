"""Streaming forms of the running packet operators, on Spark's own keyed state.

Each operator groups the stream by its key and keeps a state of constant size per
key with ``applyInPandasWithState``; Spark stores it, versions it with the checkpoint
and, where a watermark is set, expires it. Rows of a key must arrive in position
order from one micro-batch to the next; inside a micro-batch they are sorted.

Captures and classes can be arbitrarily large, so their operators have two levels, see :func:`in_blocks`: rows are grouped by
(key, block of positions), and what a block has to know of the rows before it comes from a second keyed state that sees
one small row per block. A task never holds more than one block of a key. Flows are the key of their operator themselves; for them a
micro-batch must be bounded at the source: set ``maxFilesPerTrigger`` (or the like). Results do not depend on how the stream is cut
into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from flowloom import schemas as S
from flowloom.functions import packets as P
from flowloom.operators import packets as W
from flowloom.operators.running import Blocks
from flowloom.schemas import q

NO_TIME = np.iinfo(np.int64).max


def _start(df: DataFrame, folder: str, name: str) -> StreamingQuery:
    """Append to ``folder/out`` until the source is drained; the file sink takes each micro-batch once."""
    return (
        df.writeStream.queryName(name).format("parquet").outputMode("append")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )


def read_output(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/out")


# ---- flows -------------------------------------------------------------------------------------

_FLOW_KEY = {"a_ip": "string", "a_port": "int", "b_ip": "string", "b_port": "int"}
_FLOW_VALUES = {"flow_packets": "bigint", "flow_bytes": "bigint", "flow_us": "bigint", "tcp_packets": "bigint"}
_FLOW_STATE = ", ".join(f"{c}_{p} bigint" for p in ("tcp", "udp") for c in ("n", "bytes", "lo", "hi")) + ", seen bigint"
_EMPTY_FLOW = (0, 0, NO_TIME, -NO_TIME) * 2 + (-NO_TIME,)


def _flow_update(idle_us: int | None, timeout: bool) -> Callable:
    """Running values of one endpoint pair; TCP and UDP are kept apart, and a pause longer than ``idle_us`` starts anew."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Captures hold very many flows of a few packets each: arrays, as a table operation costs more than such a flow.
        tables = list(parts)
        rows = tables[0] if len(tables) == 1 else pd.concat(tables, ignore_index=True)
        places = rows[W.POSITION].to_numpy()
        order = np.argsort(places, kind="stable")
        old = tuple(state.get) if state.exists else _EMPTY_FLOW
        ts, protocol = rows["ts_us"].to_numpy(np.int64)[order], rows["ip_proto"].to_numpy()[order]
        size = rows["frame_len"].to_numpy()
        size = (size if size.dtype.kind == "i" else rows["frame_len"].fillna(0).to_numpy()).astype(np.int64)[order]
        latest = np.maximum.accumulate(np.append(old[8], ts))
        # A pause leaves the latest time of the new part of the flow equal to that of the whole flow.
        new = np.zeros(len(ts), bool)
        if idle_us is not None:
            new = (latest[:-1] != -NO_TIME) & (ts > latest[:-1] + idle_us)
        ends = [0, *np.flatnonzero(new).tolist(), len(ts)]
        out, kept = {c: np.zeros(len(ts), np.int64) for c in _FLOW_VALUES}, []
        for i, number in enumerate((S.TCP, S.UDP)):
            mine = protocol == number
            start = old[4 * i:4 * i + 4]
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                if low == high:  # the first packet begins a new part
                    start = _EMPTY_FLOW[:4]
                    continue
                own = mine[low:high]
                n = np.cumsum(own) + start[0]
                total = np.cumsum(np.where(own, size[low:high], 0)) + start[1]
                first = np.minimum(np.minimum.accumulate(np.where(own, ts[low:high], NO_TIME)), start[2])
                last = np.maximum(np.maximum.accumulate(np.where(own, ts[low:high], -NO_TIME)), start[3])
                out["flow_packets"][low:high][own], out["flow_bytes"][low:high][own] = n[own], total[own]
                out["flow_us"][low:high][own] = (last - first)[own]
                if number == S.TCP:
                    out["tcp_packets"][low:high] = n
                ended, start = (n, total, first, last), _EMPTY_FLOW[:4]
            kept += [int(v[-1]) for v in ended]
        state.update((*kept, int(latest[-1])))
        if timeout:
            state.setTimeoutTimestamp((int(latest[-1]) + idle_us) // 1000 + 1)
        yield pd.DataFrame({
            W.CAPTURE: [key[0]] * len(ts), W.POSITION: places[order],
            **{c: np.array([v] * len(ts), object) for c, v in zip(_FLOW_KEY, key[1:], strict=True)}, **out})

    return update


def flow_features(
    stream: DataFrame, folder: str, idle_seconds: int | None = None, delay_seconds: int | None = None,
) -> StreamingQuery:
    """Per-packet flow values (duration, packets, bytes, rates) with per-flow state.

    A flow starts anew after a pause of more than ``idle_seconds`` behind its own latest packet (120 s is a usual
    value for live traffic). ``delay_seconds`` is the watermark: packets that late are dropped, and with both
    settings the state of a silent flow is removed. Frames outside TCP and UDP have no flow, all values 0, and are never late.
    ``ts_us`` and the position of a packet are not NULL.
    """
    kept = W.keep_frames(stream).withColumn(W.FLOW, P.endpoints())
    flows = kept.filter(F.col(W.FLOW).isNotNull())
    ends = [F.col(f"{W.FLOW}.{c[0]}.{c[2:]}").alias(c) for c in _FLOW_KEY]
    columns = [W.CAPTURE, W.POSITION, "ts_us", "ip_proto", "frame_len", *ends]
    if delay_seconds is not None:
        flows = flows.withColumn("_time", F.timestamp_micros("ts_us")).withWatermark("_time", f"{delay_seconds} seconds")
        columns.append("_time")
    timeout = idle_seconds is not None and delay_seconds is not None
    position = kept.schema[W.POSITION].dataType.simpleString()
    schema = ", ".join([f"{W.CAPTURE} {kept.schema[W.CAPTURE].dataType.simpleString()}", f"{W.POSITION} {position}",
                        *[f"{c} {t}" for c, t in (_FLOW_KEY | _FLOW_VALUES).items()]])
    # With a watermark Spark drops late rows only where the state may time out by event time.
    kind = "NoTimeout" if delay_seconds is None else "EventTimeTimeout"
    values = flows.select(*columns).groupBy(W.CAPTURE, *_FLOW_KEY).applyInPandasWithState(
        _flow_update(None if idle_seconds is None else idle_seconds * 1_000_000, timeout), schema, _FLOW_STATE, "append", kind)
    end = {e: F.struct(F.col(f"{e}_ip").alias("ip"), F.col(f"{e}_port").alias("port")) for e in "ab"}
    values = values.withColumn(W.FLOW, F.struct(end["a"].alias("a"), end["b"].alias("b")))
    df = W.rates(W.directions(Blocks(values, (W.CAPTURE,), W.POSITION, False))).df
    shown = ["flow_us", "flow_packets", "flow_bytes", "src_to_dst_pkt", "dst_to_src_pkt", "rate", "srate", "drate"]
    others = kept.filter(F.col(W.FLOW).isNull()).select(
        W.CAPTURE, W.POSITION, *[F.lit(0).cast(df.schema[c].dataType).alias(c) for c in shown])
    return _start(df.select(W.CAPTURE, W.POSITION, *shown).unionByName(others), folder, "flow_features")


# ---- keys of any size ----------------------------------------------------------------------------

BLOCK, BLOCK_ROWS = "_block", 100_000
_N, _FIRST, _TAIL, _CARRY = "_n", "_first", "_tail", "_carry"


def _summaries(keys: list[str], position: str, value: str | None, tail: int) -> Callable:
    """Per task and (key, block): how many rows, the first value, and the last ``tail`` values, with their positions."""
    by = [*keys, BLOCK]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for rows in batches:
            # One sort for all keys of the batch: a table operation for each costs more than the few rows of a small capture.
            group = rows.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            order = np.lexsort((rows[position].to_numpy(), group))
            places = rows[position].to_numpy()[order].tolist()
            values = [None if pd.isna(v) else int(v) for v in rows[value].to_numpy()[order].tolist()] if value else [0] * len(order)
            names = [rows[c].to_numpy()[order] for c in by]
            starts = [*np.flatnonzero(np.diff(group[order], prepend=-1)).tolist(), len(order)]
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(None if pd.isna(c[low]) else c[low] for c in names)
                old = held.setdefault(key, [0, (places[low], values[low]), []])
                old[0] += high - low
                old[1] = min(old[1], (places[low], values[low]), key=lambda p: p[0])
                if tail:
                    begin = max(low, high - tail)
                    last = list(zip(places[begin:high], values[begin:high], strict=True))
                    old[2] = sorted([*old[2], *last], key=lambda p: p[0])[-tail:]
        out = [(*k, n, first[0], first[1], [p for p, _ in last], [v for _, v in last]) for k, (n, first, last) in held.items()]
        yield pd.DataFrame(out, columns=[*by, _N, "first_at", _FIRST, "tail_at", _TAIL]).astype({_FIRST: "Int64"})

    return summarise


def _carry_update(tail: int) -> Callable:
    """What came before each block of a key. State: number of rows, first value, last ``tail`` values."""
    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, None, [])
        last, out = list(last), []
        blocks: dict[int, list] = {}
        for r in pd.concat(parts, ignore_index=True).to_dict("records"):
            blocks.setdefault(r[BLOCK], []).append(r)
        for block in sorted(blocks):
            own = blocks[block]
            out.append((*key, block, n, first, list(last)))
            if n == 0:
                first = min(own, key=lambda r: r["first_at"])[_FIRST]
                first = None if pd.isna(first) else int(first)
            n += sum(int(r[_N]) for r in own)
            pairs = sorted((p for r in own for p in zip(r["tail_at"], r[_TAIL], strict=True)), key=lambda p: p[0])
            last = [*last, *(None if v is None or pd.isna(v) else int(v) for _, v in pairs)][-tail:] if tail else []
        state.update((n, first, last))
        made = pd.DataFrame(out, columns=[*[f"k{i}" for i in range(len(key))], BLOCK, _N, _FIRST, _TAIL])
        yield made.astype({_FIRST: "Int64"})

    return update


def in_blocks(
    rows: DataFrame, keys: list[str], position: str, finish: Callable, schema: str, value: str | None = None, tail: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``finish(key, rows in order, n before, first value, last values before)`` over blocks of ``block_rows`` positions of each key.

    Three steps inside each micro-batch: every task sums its rows up per (key, block); a state per key turns these few rows into
    what came before each block; rows and that meet again by (key, block). ``value`` is a whole number, ``position`` a whole
    number of at least 0 that is unique inside the key and grows from one micro-batch to the next.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    cut = rows.withColumn(BLOCK, F.floor(F.col(q(position)) / F.lit(block_rows)).cast("bigint"))
    columns = [*keys, BLOCK, position, *([value] if value and value != position else [])]
    keyed = ", ".join(f"{q(k)} {types[k]}" for k in keys)
    parts = cut.select(*map(q, columns)).mapInPandas(
        _summaries(keys, position, value, tail),
        f"{keyed}, {BLOCK} bigint, {_N} bigint, first_at bigint, {_FIRST} bigint, tail_at array<bigint>, {_TAIL} array<bigint>")
    carried = f"{_N} bigint, {_FIRST} bigint, {_TAIL} array<bigint>"
    carries = parts.groupBy(*map(q, keys)).applyInPandasWithState(
        _carry_update(tail), ", ".join(f"k{i} {types[k]}" for i, k in enumerate(keys)) + f", {BLOCK} bigint, {carried}", carried, "append", "NoTimeout")
    # Rows of both kinds in one table; a carry has position -1, and 0 or NULL for the rest.
    numbers = {f.name for f in rows.schema if isinstance(f.dataType, T.NumericType)}
    own = cut.select("*", F.lit(None).cast("bigint").alias(_N), F.lit(None).cast("bigint").alias(_FIRST),
                     F.lit(None).cast("array<bigint>").alias(_TAIL), F.lit(False).alias(_CARRY))
    as_rows = carries.select(
        *[F.col(f"k{keys.index(c)}").alias(c) if c in keys else F.lit(-1).cast(types[c]).alias(c) if c == position
          else F.lit(0 if c in numbers else None).cast(types[c]).alias(c) for c in rows.columns],
        BLOCK, _N, _FIRST, _TAIL, F.lit(True).alias(_CARRY))

    names = rows.columns

    def meet(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        at = int(np.flatnonzero(table[_CARRY].to_numpy())[0])
        before, first, last = (table[c].iat[at] for c in (_N, _FIRST, _TAIL))
        order = np.argsort(table[position].to_numpy(), kind="stable")
        rows = table[names].iloc[order[order != at]].reset_index(drop=True)
        return finish(key[:-1], rows, int(before), None if pd.isna(first) else int(first), list(last))

    return own.unionByName(as_rows).groupBy(*map(q, keys), BLOCK).applyInPandas(meet, schema)


# ---- captures ----------------------------------------------------------------------------------


def _capture_block(key: tuple, rows: pd.DataFrame, n: int, first: int | None, last: list[int]) -> pd.DataFrame:
    ts = rows["ts_us"].to_numpy(np.int64)
    first, previous = (first, last[-1]) if n else (int(ts[0]), int(ts[0]))
    return pd.DataFrame({
        W.CAPTURE: key[0], W.POSITION: rows[W.POSITION], "iat_us": np.diff(ts, prepend=previous), "cumulative_us": ts - first})


def _capture_keys(stream: DataFrame) -> str:
    return ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in (W.CAPTURE, W.POSITION))


def capture_features(stream: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> StreamingQuery:
    """Time since the previous and the first frame; the state of a capture is its first and its last time."""
    rows = W.keep_frames(stream).select(W.CAPTURE, W.POSITION, "ts_us")
    out = in_blocks(rows, [W.CAPTURE], W.POSITION, _capture_block, f"{_capture_keys(rows)}, iat_us bigint, cumulative_us bigint",
                    "ts_us", 1, block_rows)
    return _start(out, folder, "capture_features")


_STATISTICS = ["w_sum", "w_min", "w_max", "w_avg", "w_std", "w_magnitude", "w_radius", "w_covariance", "w_variance", "w_weight"]


def _window_block(key: tuple, rows: pd.DataFrame, n: int, first: int | None, last: list[int]) -> pd.DataFrame:
    begun = n % W.WINDOW_FRAMES  # frames before the block whose window is not complete yet
    open_ = [np.nan if v is None else float(v) for v in last[len(last) - begun:]]
    sizes = pd.Series(np.concatenate([open_, rows["frame_len"].to_numpy(np.float64, na_value=np.nan)]))
    whole = len(sizes) // W.WINDOW_FRAMES * W.WINDOW_FRAMES
    out = pd.DataFrame(0.0, index=range(len(sizes)), columns=_STATISTICS)
    if whole:
        number = np.arange(whole) // W.WINDOW_FRAMES
        by = sizes[:whole].groupby(number)
        total, low, high, std = by.sum(min_count=1), by.min(), by.max(), by.std(ddof=0)
        mean = total / W.WINDOW_FRAMES
        squares = (sizes[:whole] ** 2).groupby(number).sum(min_count=1)
        made = [total, low, high, mean, std, np.sqrt(squares), high - low, by.var(ddof=0), std * std, mean]
        out.iloc[W.WINDOW_FRAMES - 1:whole:W.WINDOW_FRAMES] = np.column_stack([v.to_numpy() for v in made])
    out = out.iloc[len(open_):].reset_index(drop=True)
    return pd.concat([pd.DataFrame({W.CAPTURE: key[0], W.POSITION: rows[W.POSITION]}), out], axis=1)


def window_features(stream: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> StreamingQuery:
    """Statistics of every 20 frames of a capture, on the last frame of the window; 0 elsewhere.

    The state of a capture is the number of its frames and the sizes of the last 19, of which those of the window that is not complete
    yet open the next block.
    """
    rows = W.keep_frames(stream).select(W.CAPTURE, W.POSITION, F.col("frame_len"))
    out = in_blocks(rows, [W.CAPTURE], W.POSITION, _window_block,
                    f"{_capture_keys(rows)}, " + ", ".join(f"{c} double" for c in _STATISTICS), "frame_len", W.WINDOW_FRAMES - 1, block_rows)
    return _start(out, folder, "window_features")


# ---- labels ------------------------------------------------------------------------------------


def label_counts(stream: DataFrame, by: str = S.LABEL) -> DataFrame:
    """Running class counts: a streaming aggregate, for complete or update mode."""
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def write_complete(df: DataFrame, folder: str, name: str) -> StreamingQuery:
    """Keep the newest full result of a streaming aggregate under ``folder/out``."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    return (
        df.writeStream.queryName(name).outputMode("complete").foreachBatch(on_batch)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )


def capped_rows(stream: DataFrame, folder: str, cap: int, by: str, position: str, block_rows: int = BLOCK_ROWS) -> StreamingQuery:
    """The first ``cap`` rows of each class in arrival order; later rows of a full class are dropped.

    State is one count per class; rows of a class are dealt out by blocks of positions. ``position`` is a whole number of at least 0 that
    grows with arrival. Rows without a class are left out, as in the batch form.
    """
    numbers = [f.name for f in stream.schema if isinstance(f.dataType, T.NumericType)]
    # pandas has no whole numbers with gaps: numbers travel as text, which keeps every digit
    text = {c: F.col(q(c)).cast("string") for c in numbers}
    place = "_place"
    rows = stream.filter(F.col(q(by)).isNotNull()).withColumn(place, F.col(q(position)).cast("bigint")).withColumns(text)
    names = stream.columns

    def first_rows(key: tuple, own: pd.DataFrame, n: int, first: int | None, last: list[int]) -> pd.DataFrame:
        return own.head(max(0, cap - n))[names]

    schema = T.StructType([f for f in rows.schema if f.name != place])
    out = in_blocks(rows, [by], place, first_rows, schema, block_rows=block_rows)
    back = [F.col(q(f.name)).cast(f.dataType).alias(f.name) if f.name in numbers else F.col(q(f.name)) for f in stream.schema]
    return _start(out.select(*back), folder, "capped_rows")


def write_rows(df: DataFrame, folder: str, name: str) -> StreamingQuery:
    """A stateless transformation to Parquet."""
    return _start(df, folder, name)
