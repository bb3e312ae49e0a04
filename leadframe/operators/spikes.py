"""Implausible readings per source: impossible values, stuck values, spikes.

Readings go to blocks of their source, ranges of positions, packed into arrays and without copies before they are moved.
A block yields, per reading, the Hampel verdict (rolling median and median absolute deviation), the stuck-run verdict, the
bounds verdict, and its isolation: the largest threshold at which the reading still belongs to a spike run. The few
readings at a block's ends wait for their neighbours in the blocks before and after, so that a source of any length is
worked on by many tasks and every window is exact. Thresholds that depend on the whole source are then a matter of one
aggregate per source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadframe.operators.chunked import running
from leadframe.operators.durable import durable

#: Positions per block.
BLOCK = 1 << 16
#: Readings that a task looks at together.
AT_ONCE = 1 << 18


def isolation(x: np.ndarray, longest: int = 3) -> np.ndarray:
    """For each reading the largest d such that it is in a run of at most ``longest`` readings that are all further
    than any distance below d from the reading before and from the reading after the run; 0 if in none.

    A run needs a reading on both sides. Distances to or from nan count as none.
    """
    n = len(x)
    out = np.zeros(n)
    for length in range(1, longest + 1):
        m = n - length - 1
        if m <= 0:
            break
        before, after = x[:m], x[length + 1 :]
        least = np.full(m, np.inf)
        with np.errstate(invalid="ignore"):
            for k in range(1, length + 1):
                member = x[k : k + m]
                d = np.minimum(np.abs(member - before), np.abs(member - after))
                least = np.minimum(least, np.where(np.isnan(d), 0.0, d))
        for k in range(1, length + 1):
            out[k : k + m] = np.maximum(out[k : k + m], least)
    return out


def run_lengths(x: np.ndarray) -> np.ndarray:
    """Length of the run of exactly equal readings that each reading belongs to."""
    if not len(x):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, ~(x[1:] == x[:-1])])
    lengths = np.diff(np.r_[starts, len(x)])
    return np.repeat(lengths, lengths)


def _middle(w: np.ndarray) -> np.ndarray:
    """Median of each row, nan left out."""
    n = np.isfinite(w).sum(axis=1)
    v = np.sort(np.where(np.isnan(w), np.inf, w), axis=1)
    at, row = np.maximum(n, 1), np.arange(len(w))
    return np.where(n > 0, (v[row, (at - 1) // 2] + v[row, at // 2]) / 2, np.nan)


def hampel(x: np.ndarray, half: int, sigmas: float, floor: float) -> np.ndarray:
    """True where a reading lies further than ``sigmas`` scaled MADs (at least ``floor``) from the rolling median.

    The window is shorter at the ends of the source; readings that are not finite are left out of it.
    """
    if not len(x):
        return np.zeros(0, bool)
    gap = np.full(half, np.nan)
    finite = np.where(np.isfinite(x), x, np.nan)
    w = np.lib.stride_tricks.sliding_window_view(np.r_[gap, finite, gap], 2 * half + 1)
    holes = np.cumsum(np.r_[np.zeros(1), np.isnan(np.r_[gap, finite, gap])])
    whole = holes[2 * half + 1 :] == holes[: -2 * half - 1]
    median, mad = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if whole.any():
        some = np.sort(w[whole], axis=1)
        part = some[:, half]
        median[whole] = part
        # The nearest half of a sorted window lies together: the least, over its places, of the further end.
        ends = np.maximum(part[:, None] - some[:, : half + 1], some[:, half:] - part[:, None])
        mad[whole] = ends.min(axis=1)
    rest = ~whole & np.isfinite(x)
    if rest.any():
        median[rest] = _middle(w[rest])
        mad[rest] = _middle(np.abs(w[rest] - median[rest][:, None]))
    with np.errstate(invalid="ignore"):
        return np.abs(x - median) > np.maximum(sigmas * 1.4826 * mad, floor)


def _packed(df: DataFrame, keys: Sequence[str], position: str, value: str, block: int) -> DataFrame:
    """(keys, ``_block``, ``_p``, ``_x``): readings as arrays, those of one task and block together, copies gone."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _block bigint, _p array<bigint>, _x array<double>"

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        p, x = t["_p"].to_numpy(), t["_x"].to_numpy()
        codes, names = np.zeros(len(p), np.int64), []
        for k in keys:
            c = t[k].combine_chunks().dictionary_encode()
            names.append(c.dictionary)
            codes = codes * len(c.dictionary) + c.indices.to_numpy()
        b = p // block
        order = np.lexsort((x, p, codes))
        codes, b, p, x = codes[order], b[order], p[order], x[order]
        same = (codes[1:] == codes[:-1]) & (p[1:] == p[:-1]) & ((x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1])))
        keep = np.r_[True, ~same]
        codes, b, p, x = codes[keep], b[keep], p[keep], x[keep]
        first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (b[1:] != b[:-1])])
        ends = pa.array(np.r_[first, len(p)].astype(np.int32))
        c, cols = codes[first], []
        for d in reversed(names):
            cols.append(d.take(pa.array(c % len(d))))
            c = c // len(d)
        return pa.RecordBatch.from_arrays(
            [*reversed(cols), pa.array(b[first]), pa.ListArray.from_arrays(ends, pa.array(p)), pa.ListArray.from_arrays(ends, pa.array(x))], names=[*keys, "_block", "_p", "_x"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= AT_ONCE:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    return df.select(*keys, F.col(position).cast("bigint").alias("_p"), F.col(value).cast("double").alias("_x")).mapInArrow(work, schema)


def _distinct(p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Readings by position, then value; equal ones once."""
    order = np.lexsort((x, p))
    p, x = p[order], x[order]
    keep = np.r_[True, ~((p[1:] == p[:-1]) & ((x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1]))))]
    return p[keep], x[keep]


def scan(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    factor: float | None = None,
    bound: float = 50.0,
    stuck: int = 20,
    longest: int = 3,
    half: int = 10,
    sigmas: float = 3.0,
    floor: float = 0.0,
    block: int = BLOCK,
) -> DataFrame:
    """Readings with ``impossible``, ``is_stuck``, ``hampel`` and ``isolation``.

    With ``factor`` only those come out that may be cases, plus one row per block (null position) whose ``lo`` and
    ``hi`` bound its sure readings: those that neither bounds nor stuck runs object to and that are isolated by no more
    than ``factor`` times the span of the readings that the Hampel filter accepts; the source's span can only be wider.
    """
    m = max(stuck, longest + 1, half)
    kinds = dict(df.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    out = f"{named}, _p bigint, _v double, impossible boolean, is_stuck boolean, hampel boolean, isolation double"
    out += ", lo double, hi double" * (factor is not None)
    names = [f.split()[0].strip("`") for f in out.split(", ")]
    gap = np.full(m, np.nan)

    def judged(x: np.ndarray, parts: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """Verdicts on readings, the sure ones, and the bounds of these per part (from, to)."""
        with np.errstate(invalid="ignore"):
            impossible = ~(np.abs(x) <= bound)
        is_stuck, doubt, alone = run_lengths(x) >= stuck, hampel(x, half, sigmas, floor), isolation(x, longest)
        sound = ~impossible & ~is_stuck
        sure, bounds = np.zeros(len(x), bool), []
        for a, z in parts:
            here, v, far = sound[a:z], x[a:z], alone[a:z]
            now = here & ~doubt[a:z]
            for start in (now, here):  # a reading that is isolated beyond the span is not sure, whatever the filter says
                if now.any():
                    some = v[now]
                    now = start & (far <= (factor or 0.0) * (some.max() - some.min()))
            sure[a:z] = now
            bounds.append((float(v[now].min()), float(v[now].max())) if now.any() else (None, None))
        return impossible, is_stuck, doubt, alone, sure, bounds

    def rows(own: list[pa.Array], place: np.ndarray, p: np.ndarray, x: np.ndarray, found: tuple[np.ndarray, ...], keep: np.ndarray, bounds: list[tuple]) -> pa.RecordBatch:
        """The kept readings of places ``place`` in the keys, and the bounds, one row for each place that has any."""
        if factor is not None:
            keep = keep & ~found[4]
        at = pa.array(place[keep])
        cols = [k.take(at) for k in own] + [pa.array(p[keep]), pa.array(x[keep]), *(pa.array(f[keep]) for f in found[:4])]
        if factor is None:
            return pa.RecordBatch.from_arrays(cols, names=names)
        sides = [(i, *b) for i, b in bounds if b[0] is not None]
        more = pa.array([i for i, *_ in sides], pa.int64())
        empty = lambda kind, n: pa.nulls(n, kind)
        tail = [k.take(more) for k in own] + [empty(c.type, len(more)) for c in cols[len(own) :]]
        cols = [pa.concat_arrays([a, b]) for a, b in zip(cols, tail, strict=True)]
        n = int(keep.sum())
        for side in (1, 2):
            cols.append(pa.concat_arrays([empty(pa.float64(), n), pa.array([s[side] for s in sides], pa.float64())]))
        return pa.RecordBatch.from_arrays(cols, names=names)

    edges = f"{named}, _block bigint, _lead array<double>, _trail array<double>, _hp array<bigint>, _hx array<double>, _tp array<bigint>, _tx array<double>"
    # What a block's ends are, and what is known of its inside, in one schema: rows of the inside have no block.
    schema = f"{out}, " + edges[len(named) + 2 :]

    def inside(own: list[pa.Array], blocks: list[int], groups: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(p) for p, _ in groups])
        ends = np.cumsum(size)
        p, x = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])
        place = np.repeat(np.arange(len(groups)), size)
        long = np.flatnonzero(size > 4 * m)
        parts = [(int(ends[i] - size[i] + m), int(ends[i] - m)) for i in long]
        found = judged(x, parts)
        core = np.zeros(len(x), bool)
        for a, z in parts:
            core[a:z] = True
        yield padded(rows(own, place, p, x, found, core, list(zip(long.tolist(), found[5], strict=True))))
        cut = [(i, ends[i] - size[i], ends[i], size[i] > 4 * m) for i in range(len(groups))]
        lists = lambda values, kind: pa.array([v.tolist() for v in values], pa.list_(kind))
        cols = [
            pa.array(blocks, pa.int64()), lists([x[a : min(z, a + m)] for _, a, z, _ in cut], pa.float64()), lists([x[max(a, z - m) : z] for _, a, z, _ in cut], pa.float64()),
            *(lists([v[a : a + 2 * m] if big else v[a:z] for _, a, z, big in cut], k) for v, k in ((p, pa.int64()), (x, pa.float64()))),
            *(lists([v[z - 2 * m : z] if big else v[:0] for _, a, z, big in cut], k) for v, k in ((p, pa.int64()), (x, pa.float64()))),
        ]
        n = len(groups)
        blank = [pa.nulls(n, k) for k in (pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64(), *([pa.float64()] * 2 * (factor is not None)))]
        yield pa.RecordBatch.from_arrays([*own, *blank, *cols], names=[*names, "_block", "_lead", "_trail", "_hp", "_hx", "_tp", "_tx"])

    def padded(b: pa.RecordBatch) -> pa.RecordBatch:
        kinds_ = (pa.int64(), *[pa.list_(k) for k in (pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())])
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, k) for k in kinds_)], names=[*names, "_block", "_lead", "_trail", "_hp", "_hx", "_tp", "_tx"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[np.ndarray, np.ndarray]] = []
        where: list[tuple] = []
        open_: list[tuple[np.ndarray, np.ndarray]] = []  # pieces of the block that is being read
        last, kind, n = None, [], 0

        def close() -> None:
            if open_:
                pieces = open_ if len(open_) > 1 else [open_[0]]
                p, x = np.concatenate([a for a, _ in pieces]), np.concatenate([a for _, a in pieces])
                groups.append(_distinct(p, x) if len(pieces) > 1 else (p, x))
                where.append(last)
                open_.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if groups:
                own = [pa.array([w[i] for w in where], k) for i, k in enumerate(kind)]
                yield from inside(own, [w[-1] for w in where], groups)
                groups.clear()
                where.clear()

        for b in batches:
            kind = [b.schema.field(k).type for k in keys]
            ids = list(zip(*(b[k].to_pylist() for k in (*keys, "_block")), strict=True))
            cut = b["_p"].offsets.to_numpy()
            p, x = b["_p"].values.to_numpy(), b["_x"].values.to_numpy()
            for i, w in enumerate(ids):
                if w != last:
                    close()
                    if n >= AT_ONCE:
                        yield from flush()
                        n = 0
                last = w
                open_.append((p[cut[i] : cut[i + 1]], x[cut[i] : cut[i + 1]]))
                n += cut[i + 1] - cut[i]
                if len(open_) > 64:  # copies that are delivered over and over do not pile up
                    open_[:] = [_distinct(np.concatenate([a for a, _ in open_]), np.concatenate([a for _, a in open_]))]
        close()
        yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ends of blocks, each seen with its neighbours; runs of nan part one from the next."""
        for b in batches:
            own = [b[k] for k in keys]
            xs, ps, place, core, parts, n = [], [], [], [], [], 0
            for i, (before, hp, hx, tp, tx, after) in enumerate(zip(*(b[c].to_pylist() for c in ("_before", "_hp", "_hx", "_tp", "_tx", "_after")), strict=True)):
                pieces = [(before, hp, hx, after, 0, len(hx))] if not tp else [(before, hp, hx, [], 0, m), ([], tp, tx, after, m, 2 * m)]
                for pre, p, x, post, a, z in pieces:
                    xs += [gap, np.array(pre), np.array(x, float), np.array(post)]
                    k = len(gap) + len(pre)
                    ps += [np.zeros(k, np.int64), np.array(p, np.int64), np.zeros(len(post), np.int64)]
                    inner = np.zeros(k + len(x) + len(post), bool)
                    inner[k + a : k + z] = True
                    core.append(inner)
                    parts.append((n + k + a, n + k + z))
                    place += [i] * len(inner)
                    n += len(inner)
            if not n:
                continue
            x, p, place_ = np.r_[np.concatenate(xs), gap], np.r_[np.concatenate(ps), np.zeros(m, np.int64)], np.array(place + [0] * m)
            inner = np.r_[np.concatenate(core), np.zeros(m, bool)]
            found = judged(x, parts)
            yield rows(own, place_, p, x, found, inner, [(int(place_[a]), c) for (a, _), c in zip(parts, found[5], strict=True)])

    have = df.filter(F.col(value).isNotNull()).dropna(subset=[*keys, position])
    packed = _packed(have, keys, position, value, block).repartition(*keys, "_block").sortWithinPartitions(*keys, "_block")
    both = durable(packed.mapInArrow(work, schema))
    ends = both.filter(F.col("_block").isNotNull())
    w = Window.partitionBy(*keys).orderBy("_block")
    near = lambda c, a, z: F.flatten(F.collect_list(c).over(w.rowsBetween(a, z)))
    before, after = near("_trail", -m, -1), near("_lead", 1, m)
    ends = ends.select(*keys, F.slice(before, F.greatest(F.size(before) - m + 1, F.lit(1)), m).alias("_before"), "_hp", "_hx", "_tp", "_tx", F.slice(after, 1, m).alias("_after"))
    every = both.filter(F.col("_block").isNull()).select(*names).unionByName(ends.mapInArrow(settle, out))
    rest = [c for c in names if c not in (*keys, "_p", "_v")]
    return every.select(*keys, F.col("_p").cast(kinds[position]).alias(position), F.col("_v").cast(kinds[value]).alias(value), *rest)


def implausible(
    df: DataFrame, keys: Sequence[str], position: str, value: str, factor: float = 1.5, **options: float
) -> DataFrame:
    """Readings that are impossible, stuck or spikes: (keys, position, value, ``reason``, ``hampel``, ``isolation``).

    A spike is a reading whose isolation exceeds ``factor`` times the span of the source's readings that are no cases.
    Since that span rests on its own result, it is reached from below: the readings that neither bounds, stuck runs nor
    the Hampel filter object to give a first span; readings within it join in the order of their isolation, each
    widening it, until the next one is isolated by more than the threshold. Only readings beyond the first threshold
    take part in this, gathered by equal isolation and widened over ranges of isolation that meet in one row each.

    Null readings, and rows without a key or position, are no readings; nan and infinities are impossible. Rows delivered again count once. A source without
    sound readings has no span and no spikes; a source of one reading has none either.
    """
    s = durable(scan(df, keys, position, value, factor, **options))
    on, rows = list(keys), s.filter(F.col(position).isNotNull())
    base = s.groupBy(*keys).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    sound = rows.filter(~F.col("impossible") & ~F.col("is_stuck")).join(base, on)
    # First widening, over all readings at once: those isolated by no more than the first threshold.
    sound = sound.withColumn("_t0", factor * (F.col("_hi") - F.col("_lo"))).withColumn("_near", F.col("isolation") <= F.col("_t0"))
    near = sound.filter("_near").groupBy(*keys).agg(F.min(value).alias("_n0"), F.max(value).alias("_n1"))
    wide = sound.filter("not _near").groupBy(*keys, "isolation").agg(F.min(value).alias("_x0"), F.max(value).alias("_x1"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    wide = wide.withColumn("_range", F.floor(F.log2("isolation") * 64))
    for agg, column, name in (("max", "_x1", "_top"), ("min", "_x0", "_bottom")):
        wide = running(wide, on, "_range", [F.col("isolation")], F.col(column), agg, name)
    chain = wide.join(near, on, "left").withColumn("_span", F.greatest("_hi", "_n1", "_top") - F.least("_lo", "_n0", "_bottom"))
    # The least isolation that exceeds the threshold of all before it: from there on readings are spikes.
    cut = chain.filter(F.col("isolation") > factor * F.col("_span")).groupBy(*keys).agg(F.min("isolation").alias("_cut"))
    out = rows.join(cut, on, "left").withColumn(
        "reason",
        F.when(F.col("impossible"), "impossible").when(F.col("is_stuck"), "stuck").when(F.col("isolation") >= F.col("_cut"), "spike"),
    )
    return out.filter(F.col("reason").isNotNull()).select(*keys, position, value, "reason", "hampel", "isolation")
