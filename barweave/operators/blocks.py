"""Ordered operators that never put a whole key into one task.

A key (a symbol, or symbol x parameter set x run) may own a large share of all rows, so no
operator here sorts or collects a key as one group.  Rows get a dense position ``rn`` inside
their key; positions are cut into blocks of ``size`` rows and every window runs inside
``(key, block)``:

* bounded look-back (lags, rolling frames, fading recurrences): each block also receives the
  last ``halo`` rows before it -- ``open_blocks`` / ``close_blocks``; one shuffle, no join;
* unbounded look-back (running sums, extremes, last value, two-state latch): one summary row
  per block is scanned and joined back -- ``running``, ``running_latch``;
* path-dependent folds: blocks are folded from a provisional state, the block borders are
  compared, and only blocks that started from a wrong state are folded again --
  ``chained_fold``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

BLOCK = 4096
STRETCH = 64          # blocks that one task of chained_fold refolds in a row, at most
BLK, CORE = "_blk", "_core"


def span(key: Sequence[str], *extra: str) -> WindowSpec:
    return Window.partitionBy(*key, *extra)


def index_rows(df: DataFrame, key: Sequence[str], order: Sequence, bucket: Sequence[Column],
               out: str = "rn", total: str | None = None) -> DataFrame:
    """Add the dense 1-based position of each row inside its key.

    ``bucket`` are columns that follow the order of ``order`` coarsely (a day, a range of
    values).  Positions are counted inside ``(key, bucket)`` and shifted by the counts of the
    earlier buckets, so the largest sort group is one bucket rather than one key.
    """
    names = [f"_bk{i}" for i in range(len(bucket))]
    # equal structs may hold nulls; one column is the key of count, window and join, so rows are shuffled once
    group = F.struct(*key, *[c.alias(n) for n, c in zip(names, bucket)])
    d = df.withColumn("_g", group)
    counts = d.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).select("_g", "_c", *[F.col("_g")[c].alias(c) for c in [*key, *names]])
    before = span(key).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col("_g").alias("_o"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                         *([F.sum("_c").over(span(key)).alias(total)] if total else []))
    pos = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    return (d.withColumn("_p", pos).join(offs, F.col("_g") == F.col("_o"))
             .select(*[F.col("_g")[c].alias(c) if c in key else c for c in df.columns], *([total] if total else []),
                     (F.col("_p") + F.col("_off")).cast("long").alias(out)))


def block_of(rn: Column, size: int) -> Column:
    return F.floor((rn - 1) / F.lit(size)).cast("long")


def open_blocks(df: DataFrame, halo: int, size: int = BLOCK, rn: str = "rn") -> DataFrame:
    """Copy the last ``halo`` rows of each block into the block(s) that follow it."""
    own = block_of(F.col(rn), size)
    if halo <= 0:
        return df.withColumns({BLK: own, CORE: F.lit(True)})
    last = block_of(F.col(rn) + F.lit(halo), size)
    return (df.withColumn("_own", own)
              .withColumn(BLK, F.explode(F.sequence(F.col("_own"), last)))
              .withColumn(CORE, F.col(BLK) == F.col("_own")).drop("_own"))


def close_blocks(df: DataFrame) -> DataFrame:
    return df.filter(CORE).drop(BLK, CORE)


def block_window(key: Sequence[str], rn: str = "rn") -> WindowSpec:
    return span(key, BLK).orderBy(rn)


_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "min":
        return F.least(a, b)
    if kind == "max":
        return F.greatest(a, b)
    if kind in ("last", "prev"):
        return F.coalesce(b, a)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def running(df: DataFrame, key: Sequence[str], specs: dict[str, tuple[str, Column | str]],
            size: int = BLOCK, rn: str = "rn") -> DataFrame:
    """Running ``sum|min|max|count|last|prev`` over the whole history of a key.

    ``last`` is the latest non-null value, ``prev`` the value of the row before; ``max`` of a
    struct carries the position of an extreme along with its value.

    ``df`` is read twice (rows and block summaries): pass a scan or a staged table.
    """
    d = df.withColumn(BLK, block_of(F.col(rn), size))
    w = block_window(key, rn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = span(key).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    tot, carry, local = [], [], {}
    for out, (kind, c) in specs.items():
        c = F.col(c) if isinstance(c, str) else c
        if kind == "last":
            tot.append(F.max_by(c, F.when(c.isNotNull(), F.col(rn))).alias(f"_t_{out}"))
            carry.append(F.last(f"_t_{out}", ignorenulls=True).over(before).alias(f"_c_{out}"))
            local[out] = F.last(c, ignorenulls=True).over(w)
        elif kind == "prev":
            tot.append(F.max_by(c, rn).alias(f"_t_{out}"))
            carry.append(F.last(f"_t_{out}").over(before).alias(f"_c_{out}"))
            local[out] = F.lag(c).over(block_window(key, rn))
        else:
            tot.append(_AGG[kind](c).alias(f"_t_{out}"))
            again = F.sum if kind == "count" else _AGG[kind]
            carry.append(again(f"_t_{out}").over(before).alias(f"_c_{out}"))
            local[out] = _AGG[kind](c).over(w)
    heads = d.groupBy(*key, BLK).agg(*tot).select(*key, BLK, *carry)
    d = d.withColumns(local).join(heads, [*key, BLK])
    d = d.withColumns({o: _merge(k, F.col(f"_c_{o}"), F.col(o)) for o, (k, _) in specs.items()})
    return d.drop(BLK, *[f"_c_{o}" for o in specs])


def running_latch(df: DataFrame, key: Sequence[str], on: str, off: str, out: str = "state",
                  size: int = BLOCK, rn: str = "rn", hold: str | None = None) -> DataFrame:
    """Two-state automaton: ``on`` alone sets, ``off`` alone clears, both together toggle.

    Every row acts on the state as one of {keep, set, clear, toggle}; these compose, so a
    block is summarised by "last forced value + parity of the toggles after it".  Adds
    ``out`` (0/1 after the row) and ``<out>_before``; with ``hold`` also ``<out>_held``, the
    value of that column at the latest switch-on.  The switch-ons of a block are known for
    both possible states at its start, so the held value needs no second pass.  ``df`` is
    read twice (rows and block summaries).
    """
    e, x = F.coalesce(F.col(on), F.lit(False)), F.coalesce(F.col(off), F.lit(False))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumn(BLK, block_of(F.col(rn), size))
    bw = block_window(key, rn)
    d = d.withColumns({"_set": F.when(e & ~x, 1).when(~e & x, 0), "_tog": (e & x).cast("int")})
    d = d.withColumns({"_base": F.last("_set", ignorenulls=True).over(upto(bw)),
                       "_tc": F.sum("_tog").over(upto(bw))})
    d = d.withColumn("_par", F.col("_tc") - F.coalesce(F.last(F.when(F.col("_set").isNotNull(), F.col("_tc")), ignorenulls=True).over(upto(bw)), F.lit(0)))

    def after(start: Column) -> Column:
        return (F.coalesce(F.col("_base"), start) + F.col("_par")) % 2

    def switched_on(now: Column, start: Column) -> Column:
        # before a toggle the state was the opposite; a set counts if the row before was off
        prev = F.coalesce(F.lag(now).over(bw), start)
        return (now == 1) & (prev == 0)

    d = d.withColumns({"_s0": after(F.lit(0)), "_s1": after(F.lit(1))})
    if hold:
        d = d.withColumns({f"_h{h}": F.when(switched_on(F.col(f"_s{h}"), F.lit(h)), F.col(hold)) for h in (0, 1)})
    ends = d.groupBy(*key, BLK).agg(
        F.max_by(F.struct("_s0", "_s1"), rn).alias("_e"),
        *([F.max_by(f"_h{h}", F.when(F.col(f"_h{h}").isNotNull(), F.col(rn))).alias(f"_k{h}") for h in (0, 1)] if hold else []))
    # At block level the map is again keep / set / clear / toggle.
    over = upto(span(key).orderBy(BLK))
    ends = ends.withColumns({"_v": F.when(F.col("_e._s0") == F.col("_e._s1"), F.col("_e._s0")),
                             "_f": F.when(F.col("_e._s0") > F.col("_e._s1"), 1).otherwise(0)})
    ends = ends.withColumns({"_fc": F.sum("_f").over(over), "_lv": F.last("_v", ignorenulls=True).over(over)})
    ends = ends.withColumn("_fp", F.col("_fc") - F.coalesce(F.last(F.when(F.col("_v").isNotNull(), F.col("_fc")), ignorenulls=True).over(over), F.lit(0)))
    ends = ends.withColumn("_o", (F.coalesce("_lv", F.lit(0)) + F.col("_fp")) % 2)
    seq = span(key).orderBy(BLK)
    ends = ends.withColumn("_in", F.coalesce(F.lag("_o").over(seq), F.lit(0)))
    cols = [*key, BLK, "_in"]
    if hold:
        ends = ends.withColumn("_k", F.when(F.col("_in") == 1, F.col("_k1")).otherwise(F.col("_k0")))
        ends = ends.withColumn("_kin", F.last("_k", ignorenulls=True).over(seq.rowsBetween(Window.unboundedPreceding, -1)))
        cols.append("_kin")
    d = d.join(ends.select(*cols), [*key, BLK])
    now = F.when(F.col("_in") == 1, F.col("_s1")).otherwise(F.col("_s0")).cast("int")
    d = d.withColumn(out, now)
    res = {f"{out}_before": F.coalesce(F.lag(out).over(bw), F.col("_in")).cast("int")}
    if hold:
        own = F.when(F.col("_in") == 1, F.col("_h1")).otherwise(F.col("_h0"))
        res[f"{out}_held"] = F.coalesce(F.last(own, ignorenulls=True).over(upto(bw)), F.col("_kin"))
    return d.withColumns(res).select(*df.columns, out, *res)


Fold = Callable[["object", list], tuple["object", list]]


def chained_fold(df: DataFrame, key: Sequence[str], fold: Fold, start: list[float],
                 out_schema: T.StructType, cols: Sequence[str], halo: int = 512,
                 size: int = BLOCK, rn: str = "rn") -> DataFrame:
    """Path-dependent fold over a key, run block by block with exact borders.

    ``fold(pdf, state) -> (pdf_out, state)`` consumes ordered rows (columns ``cols``) and a
    list of doubles.  First every block is folded from ``start`` over its halo; the state
    found at its border is provisional.  A block is settled when that border state equals the
    state its predecessor ends with.  Unsettled blocks are folded again from the true border
    state until none is left, so the result equals one sequential pass.  Folds forget their
    past quickly (a flipped trend, a closed position), hence one round nearly always suffices.
    A state carried on and on is followed through stretches of 1, 2, 4 ... ``STRETCH`` blocks a
    round; from then on only the first stretch of a run of unsettled ones is folded, the others
    wait for its end state.  Every round settles at least the stretch with a key's first wrong
    border, so the loop ends for any input.
    ``df`` is read more than once: pass a scan or a staged table.
    """
    key = list(key)
    src = df.select(*key, rn, *cols)
    kf = [src.schema[k] for k in key]
    st_type = T.ArrayType(T.DoubleType())
    border = T.StructType([*kf, T.StructField(BLK, T.LongType()),
                           T.StructField("s_in", st_type), T.StructField("s_out", st_type)])
    emit = T.StructType([*kf, T.StructField(rn, T.LongType()), *out_schema.fields])
    names = [f.name for f in out_schema.fields]

    def probe(pdf):
        import pandas as pd
        pdf = pdf.sort_values(rn)
        core = pdf[CORE].to_numpy()
        state = list(start)
        head, body = pdf[~core], pdf[core]
        if len(body) == 0:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in border.fields})
        if len(head):
            state = fold(head, state)[1]
        s_in = [float(v) for v in state]
        s_out = [float(v) for v in fold(body, list(s_in))[1]]
        return pd.DataFrame({**{k: [body[k].iloc[0]] for k in key}, BLK: [body[BLK].iloc[0]],
                             "s_in": [s_in], "s_out": [s_out]})

    def rerun(_, pdf, edges):
        """Fold a stretch from its first wrong border; a block whose border turns out right is kept."""
        import pandas as pd
        parts = dict(tuple(pdf.groupby(BLK)))
        rows, state = [], None
        for e in edges.sort_values(BLK).to_dict("records"):
            s_in, s_out = ([float(v) for v in e[c]] for c in ("s_in", "s_out"))
            true = state or [float(v) for v in e["s_true"]]
            if not rows or any(x != y and (x == x or y == y) for x, y in zip(true, s_in)):
                s_in, s_out = true, [float(v) for v in fold(parts[e[BLK]].sort_values(rn), list(true))[1]]
            rows.append({**{k: e[k] for k in key}, BLK: e[BLK], "s_in": s_in, "s_out": s_out})
            state = s_out
        return pd.DataFrame(rows, columns=[f.name for f in border.fields])

    def final(pdf):
        pdf = pdf.sort_values(rn)
        res, _ = fold(pdf, [float(v) for v in pdf["s_in"].iloc[0]])
        for c in [*key, rn]:
            res[c] = pdf[c].to_numpy()
        return res[[*key, rn, *names]]

    borders = stage(open_blocks(src, halo, size, rn).groupBy(*key, BLK)
                    .applyInPandas(probe, border))
    blocks = src.withColumn(BLK, block_of(F.col(rn), size))
    length, cell, own = 1, "_cell", [*key, "_cell"]
    while True:
        prev = borders.select(*key, (F.col(BLK) + 1).alias(BLK), F.col("s_out").alias("s_true"))
        joined = borders.join(prev, [*key, BLK], "left").withColumn(cell, F.floor(F.col(BLK) / length))
        same = F.col("s_true").isNull() | (F.col("s_true") == F.col("s_in"))
        wrong = stage(joined.filter(~same).groupBy(*own).agg(F.min(BLK).alias("_from")))
        if wrong.isEmpty():
            break
        if length == STRETCH:
            behind = wrong.select(*key, (F.col(cell) + 1).alias(cell))
            wrong = wrong.join(behind, own, "left_anti")
        todo = joined.join(wrong, own, "left")
        first = F.col("_from")
        rows = (blocks.withColumn(cell, F.floor(F.col(BLK) / length)).join(wrong, own)
                .filter(F.col(BLK) >= first).drop("_from"))
        edges = todo.filter(F.col(BLK) >= first).select(*own, BLK, "s_in", "s_out", "s_true")
        again = rows.groupBy(*own).cogroup(edges.groupBy(*own)).applyInPandas(rerun, border)
        kept = todo.filter(first.isNull() | (F.col(BLK) < first)).select(*key, BLK, "s_in", "s_out")
        borders = stage(kept.unionByName(again))
        length = min(2 * length, STRETCH)
    res = (blocks.join(borders.select(*key, BLK, "s_in"), [*key, BLK])
           .groupBy(*key, BLK).applyInPandas(final, emit))
    return df.join(res, [*key, rn])


def exact_percentiles(df: DataFrame, key: Sequence[str], col: str, ps: dict[str, float],
                      splits: int = 64, fine: int = 256) -> DataFrame:
    """Exact linear-interpolated percentiles per key without gathering a key in one task.

    Equal values are counted first.  Splits of a mergeable sketch cut the value range into
    near-equal parts and each part is cut again evenly, which gives up to ``splits * fine``
    ordered buckets per key.  Bucket counts locate the two ranks next to each percentile;
    only rows of those buckets are ranked, the rest is dropped before the ranking.
    """
    key = list(key)
    good = F.col(col).isNotNull() & ~F.isnan(col)
    vals = df.filter(good).groupBy(*key, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = [i / splits for i in range(1, splits)]
    sk = df.filter(good).groupBy(*key).agg(
        F.approx_percentile(F.col(col).cast("double"), cuts, 1000).alias("_s"), F.min(F.col(col).cast("double")).alias("_min"),
        F.max(F.col(col).cast("double")).alias("_max"), F.count(F.lit(1)).alias("_total"))
    v = vals.join(sk, key).withColumn("_c", F.size(F.filter("_s", lambda s: s <= F.col("_v"))))
    lo = F.coalesce(F.get("_s", F.col("_c") - 1), F.col("_min"))
    hi = F.coalesce(F.get("_s", F.col("_c")), F.col("_max"))
    part = F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor((F.col("_v") - lo) / F.nullif(hi - lo, F.lit(0.0)) * fine)))).otherwise(0)
    v = v.withColumn("_b", (F.col("_c") * fine + part).cast("long")).drop("_s", "_min", "_max", "_c")
    upto = span(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cnt = v.groupBy(*key, "_b").agg(F.sum("_n").alias("_bn"), F.first("_total").alias("_t"))
    cnt = cnt.withColumn("_end", F.sum("_bn").over(upto))
    need = [f(F.lit(float(p)) * (F.col("_t") - 1)) for p in ps.values() for f in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for q in need:
        wanted = wanted | ((q >= F.col("_end") - F.col("_bn")) & (q < F.col("_end")))
    cnt = cnt.filter(wanted).select(*key, "_b", (F.col("_end") - F.col("_bn")).alias("_o"))
    v = v.join(cnt, [*key, "_b"])
    w = span(key, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("_top", F.sum("_n").over(w) + F.col("_o"))
    aggs = []
    for name, p in ps.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        pick = lambda q: F.max(F.when((q >= F.col("_top") - F.col("_n")) & (q < F.col("_top")), F.col("_v")))
        a, b = pick(F.floor(pos)), pick(F.ceil(pos))
        aggs.append((a + (b - a) * F.max(pos - F.floor(pos))).alias(name))
    return v.groupBy(*key).agg(*aggs)
