"""Long exact spans shared between records.

A text is cut into sentences at every full stop, comma, bracket, quote, line end or space; where
no such character stands within ``GAP`` characters, every position counts as a cut, so that cuts
depend on a few characters to their left only and fall alike in two texts that share a passage.
A run of consecutive sentences of at least ``run_chars`` characters is hashed from every cut; of
the runs that begin within a stretch of positions only the one with the smallest hash is kept
(again a choice that both texts make alike).  The sizes are chosen so that every shared passage
of ``min_chars`` characters holds at least one kept run in full, so joining the runs by hash finds
every pair; the passage around a common run is then measured character by character.

A run that many texts hold is not compared in pairs: each text sends the hashes of all stretches of
``min_chars`` characters that hold the run, so a footer shorter than that costs one row per text and
stretch, and texts are only paired where they do share a whole stretch.  How much of each text is
shared (``shared_intervals``) needs no pairs of such texts at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.session import materialize

GAP = 20
# Characters after which a sentence or part of one ends.
CUTS = "。、，．,.;:!?！？；：・()（）[]「」『』【】\"'\n\t\r 　/|"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHARS_AT_ONCE = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring code points get unrelated numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sizes(min_chars: int) -> tuple[int, int]:
    """Least run length, and the stretch of positions of which one run is kept."""
    slack = min_chars - 2 * GAP  # a passage may begin mid-sentence; a run may overshoot
    run = max(slack * 2 // 3, 1)
    return run, max(slack - run, 1)


def kept_runs(texts: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and hash of every kept run."""
    run, stretch = _sizes(min_chars)
    lens = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    none = np.empty(0, np.int64)
    if n == 0:
        return none, none, none
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(texts)), lens)
    cut = np.isin(codes, np.frombuffer(CUTS.encode("utf-32-le"), np.uint32))
    # start of a sentence: after a cut, or no cut among the GAP characters before it
    seen = np.concatenate([[0], np.cumsum(cut)])
    at = np.arange(n)
    before = seen[at] - seen[np.maximum(at - GAP, 0)]
    begin = ends[owner] - lens[owner]
    starts = np.flatnonzero((at - begin >= GAP) & ((before == 0) | np.concatenate([[False], cut[:-1]])))
    starts = np.union1d(starts, (ends - lens)[lens > 0])
    # a run ends at the first cut from start + run on, at most GAP characters further
    spots = np.flatnonzero(cut) + 1
    where = np.searchsorted(spots, starts + run)
    stop = np.where(where < len(spots), np.append(spots, n + 2 * GAP)[np.minimum(where, len(spots))], n + 2 * GAP)
    stop = np.minimum(stop, starts + run + GAP)
    good = stop <= ends[owner[starts]]
    starts, stop = starts[good], stop[good]
    if not len(starts):
        return none, none, none
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes + np.uint32(1)) * power[:n])])
        hashes = _mix((total[stop] - total[starts]) * down[starts])
    keep = _smallest(starts, hashes, owner[starts], stretch)
    starts, hashes = starts[keep], hashes[keep]
    return owner[starts], starts - begin[starts], hashes.view(np.int64)


def _smallest(starts: np.ndarray, hashes: np.ndarray, owner: np.ndarray, stretch: int) -> np.ndarray:
    """Those that have the smallest hash in some stretch of positions (ties: the last)."""
    m = len(starts)
    far = np.int64(1) << 40
    left, right = np.full(m, -far), np.full(m, far)
    left_open, right_open = np.ones(m, bool), np.ones(m, bool)
    for k in range(1, stretch + 1):
        if k >= m:
            break
        near = (starts[k:] - starts[:-k] < stretch) & (owner[k:] == owner[:-k])
        if not near.any():
            break
        # later ones look back: a smaller one to the left
        hit = near & (hashes[:-k] < hashes[k:]) & left_open[k:]
        left[k:][hit] = starts[:-k][hit]
        left_open[k:] &= ~hit
        hit = near & (hashes[k:] <= hashes[:-k]) & right_open[:-k]
        right[:-k][hit] = starts[k:][hit]
        right_open[:-k] &= ~hit
    return right - left > stretch


def span_runs(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """``k``, ``at``, ``h``: the kept runs of every text of at least ``min_chars`` characters."""

    def run(batches):
        for batch in batches:
            keys, values = batch.column(0), batch.column(1)
            lo, chars, texts = 0, 0, []
            for i in range(batch.num_rows):
                texts.append(values[i].as_py() or "")
                chars += len(texts[-1])
                if chars > _CHARS_AT_ONCE or i == batch.num_rows - 1:
                    own, at, h = kept_runs(texts, min_chars)
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, len(texts)).take(pa.array(own)), pa.array(at), pa.array(h)], ["k", "at", "h"])
                    lo, chars, texts = i + 1, 0, []

    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("at", T.LongType()), T.StructField("h", T.LongType())])
    long = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.char_length("t") >= min_chars)
    return long.mapInArrow(run, schema)


def _common(a: str, i: int, b: str, j: int) -> tuple[int, int]:
    """How far two texts agree to the left of (i, j) and to the right of it."""
    right, top = 0, min(len(a) - i, len(b) - j)
    step = 1
    while right < top:
        step = min(step, top - right)
        if a[i + right : i + right + step] == b[j + right : j + right + step]:
            right += step
            step *= 2
        elif step == 1:
            break
        else:
            step = step // 2
    left, top, step = 0, min(i, j), 1
    while left < top:
        step = min(step, top - left)
        if a[i - left - step : i - left] == b[j - left - step : j - left]:
            left += step
            step *= 2
        elif step == 1:
            break
        else:
            step = step // 2
    return left, right


MANY = 64  # texts with one run from which on stretches are hashed instead of pairs compared


def _hits(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """``h``, ``n``, ``k``, ``first``, ``mid``, ``s``: the runs that several texts hold, with what surrounds them."""
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & (F.char_length("t") >= min_chars))
    reps = materialize(texts.groupBy(F.xxhash64("t").alias("x"), F.sha2("t", 256).alias("y")).agg(F.min_by(F.struct("k", "t"), "k").alias("r")).select("r.k", "r.t"), "span-texts")
    runs = materialize(span_runs(reps, "k", "t", min_chars), "span-runs")
    repeated = runs.groupBy("h").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).where(F.col("lo") < F.col("hi")).select("h", "n")
    hits = runs.join(repeated, "h")
    # only the surroundings that can matter travel on: min_chars to each side of the run's start
    run_most = _sizes(min_chars)[0] + GAP
    first = F.greatest(F.col("at") - min_chars, F.lit(0))
    ctx = hits.join(reps, "k").select("h", "n", "k", first.alias("first"), (F.col("at") - first).alias("mid"), F.expr(f"substring(t, cast(greatest(at - {min_chars}, 0) as int) + 1, cast(at - greatest(at - {min_chars}, 0) as int) + {run_most + min_chars})").alias("s"))
    return materialize(ctx, "span-hits")


def _measured(ctx: DataFrame, min_chars: int) -> DataFrame:
    """``a``, ``b``, ``a_from``, ``b_from``, ``chars``: passages of texts that hold one run, pair by pair."""
    a, b = ctx.alias("a"), ctx.alias("b")
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.k") < F.col("b.k"))).select(
        F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.col("a.first").alias("af"), F.col("a.mid").alias("am"), F.col("a.s").alias("s"), F.col("b.first").alias("bf"), F.col("b.mid").alias("bm"), F.col("b.s").alias("u"))
    kt = ctx.schema["k"].dataType

    def measure(batches):
        for batch in batches:
            ka, kb, fa, ma, sa, fb, mb, sb = batch.columns
            fa, ma, fb, mb = (x.to_numpy() for x in (fa, ma, fb, mb))
            rows, start_a, start_b, size = [], [], [], []
            for i, (x, y) in enumerate(zip(sa.to_pylist(), sb.to_pylist())):
                left, right = _common(x, int(ma[i]), y, int(mb[i]))
                if left + right >= min_chars:
                    rows.append(i)
                    start_a.append(fa[i] + ma[i] - left)
                    start_b.append(fb[i] + mb[i] - left)
                    size.append(left + right)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ka.take(take), kb.take(take), pa.array(start_a, pa.int64()), pa.array(start_b, pa.int64()), pa.array(size, pa.int64())], ["a", "b", "a_from", "b_from", "chars"])

    schema = T.StructType([T.StructField("a", kt), T.StructField("b", kt), T.StructField("a_from", T.LongType()), T.StructField("b_from", T.LongType()), T.StructField("chars", T.LongType())])
    return pairs.mapInArrow(measure, schema)


def _stretches(ctx: DataFrame, min_chars: int) -> DataFrame:
    """``x``, ``y``, ``k``, ``s``, ``before``: every stretch of ``min_chars`` characters around a run's start.

    ``x`` and ``y`` hash it (with the run and its place in the stretch), ``s`` is where it begins;
    ``before`` is the character in front of it, null for the first stretch of a text or of a run.
    """
    base2 = np.uint64(0xD6E8FEB86659FD93)

    def run(batches):
        for batch in batches:
            keys, hs, firsts, mids = batch.column(1), batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for lo in range(0, batch.num_rows, 512):
                own, x, y, at, ahead = [], [], [], [], []
                for i, s in enumerate(batch.column(4).slice(lo, 512).to_pylist(), lo):
                    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
                    n = len(codes) - min_chars + 1
                    starts = np.arange(max(int(mids[i]) - min_chars + 1, 0), min(int(mids[i]) + 1, n))
                    if not len(starts):
                        continue
                    mixed = _mix(codes + np.uint32(1))
                    with np.errstate(over="ignore"):
                        place = (starts - int(mids[i])).astype(np.int64).view(np.uint64)
                        for out, base in ((x, _BASE), (y, base2)):
                            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(min_chars - 1, base)]))
                            window = np.lib.stride_tricks.sliding_window_view(mixed, min_chars)[starts]
                            out.append(_mix((window * power).sum(axis=1, dtype=np.uint64) + _mix(place + np.uint64(hs[i]))).view(np.int64))
                    own.append(np.full(len(starts), i))
                    at.append(starts + firsts[i])
                    ahead += [None if j in (0, int(mids[i]) - min_chars + 1) else int(codes[j - 1]) for j in starts.tolist()]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)), pa.array(np.concatenate(y)), keys.take(pa.array(np.concatenate(own))), pa.array(np.concatenate(at)), pa.array(ahead, pa.int32())], ["x", "y", "k", "s", "before"])

    kt = T.StructField("k", ctx.schema["k"].dataType)
    schema = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), kt, T.StructField("s", T.LongType()), T.StructField("before", T.IntegerType())])
    return ctx.select("h", "k", "first", "mid", "s").mapInArrow(run, schema)


def shared_links(df: DataFrame, key: str, text: str, min_chars: int = 200) -> DataFrame:
    """``a``, ``b``: different texts that share at least ``min_chars`` characters, each pair once.

    ``a < b`` are keys of class representatives (the smallest key of each distinct text), so a
    text copied any number of times takes part once.  Null, empty and short texts, and rows with a
    null key, share nothing; repeated rows count once.
    """
    ctx = _hits(df, key, text, min_chars)
    few = _measured(ctx.where(F.col("n") <= MANY), min_chars).select("a", "b")
    long = _stretches(ctx.where(F.col("n") > MANY), min_chars)
    # a pair comes from the first stretch it shares: there the characters in front differ, or are not known
    worth = long.groupBy("x", "y").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), (F.count_if(F.col("before").isNull()) > 0).alias("open"), F.min("before").alias("p"), F.max("before").alias("q"))
    worth = worth.where((F.col("lo") < F.col("hi")) & (F.col("open") | (F.col("p") != F.col("q")))).select("x", "y")
    left = long.join(worth, ["x", "y"], "left_semi")
    a, b = left.alias("a"), left.alias("b")
    first = F.col("a.before").isNull() | F.col("b.before").isNull() | (F.col("a.before") != F.col("b.before"))
    many = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.k") < F.col("b.k")) & first).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))
    return few.unionByName(many).distinct()


def shared_intervals(df: DataFrame, key: str, text: str, min_chars: int = 200) -> DataFrame:
    """``rep``, ``s``, ``e``, ``later``: stretches of a text that another text shares; ``later``: one with a smaller key.

    Per class representative as in ``shared_links``; intervals may overlap.  Only texts that hold a
    run with few others are compared in pairs.
    """
    ctx = _hits(df, key, text, min_chars)
    spans = _measured(ctx.where(F.col("n") <= MANY), min_chars)
    few = spans.select(F.explode(F.array(*(F.struct(F.col(x).alias("rep"), F.col(f"{x}_from").alias("s"), (F.col(f"{x}_from") + F.col("chars")).alias("e"), F.lit(x == "b").alias("later")) for x in "ab"))).alias("i")).select("i.*")
    long = _stretches(ctx.where(F.col("n") > MANY), min_chars)
    held = long.groupBy("x", "y").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where(F.col("lo") < F.col("hi"))
    many = long.join(held, ["x", "y"]).select(F.col("k").alias("rep"), "s", (F.col("s") + min_chars).alias("e"), (F.col("lo") < F.col("k")).alias("later"))
    return few.unionByName(many).groupBy("rep", "s", "e").agg(F.max("later").alias("later"))


def text_classes(df: DataFrame, key: str, text: str, min_chars: int = 0) -> DataFrame:
    """``k``, ``rep``: each key with the smallest key that has the very same text."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & (F.char_length("t") >= min_chars))
    keyed = rows.select("k", F.xxhash64("t").alias("x"), F.sha2("t", 256).alias("y"))
    reps = keyed.groupBy("x", "y").agg(F.min("k").alias("rep"))
    return keyed.join(reps, ["x", "y"]).select("k", "rep").distinct()


def expand_pairs(links: DataFrame, classes: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of keys, ``a < b``, from links between representatives and from equal texts."""
    one, two = classes.select(F.col("rep").alias("a"), F.col("k").alias("ka")), classes.select(F.col("rep").alias("b"), F.col("k").alias("kb"))
    between = links.select("a", "b").join(one, "a").join(two, "b").select("ka", "kb")
    within = one.join(two, F.col("a") == F.col("b")).where(F.col("ka") < F.col("kb")).select("ka", "kb")
    return between.unionByName(within).select(F.least("ka", "kb").alias(a), F.greatest("ka", "kb").alias(b))


def _merged(rows: DataFrame) -> DataFrame:
    """``rep``, ``s``, ``e``: the union of each text's intervals, without overlap."""
    w = Window.partitionBy("rep").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = rows.withColumn("to", F.coalesce(F.max("e").over(w), F.lit(-1))).withColumn("new", (F.col("s") > F.col("to")).cast("int"))
    part = fresh.withColumn("part", F.sum("new").over(Window.partitionBy("rep").orderBy("s", "e")))
    return part.groupBy("rep", "part").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("part")


def covered(intervals: DataFrame, classes: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: ``n_chars``, ``shared_chars`` (inside a passage that another row has too) and ``first_chars``.

    ``first_chars`` counts the characters left if every passage that a smaller key has already is
    taken out.  A text that some other row has in full is shared in full.  Null counts as empty.
    """

    def total(rows: DataFrame, name: str) -> DataFrame:
        return _merged(rows).groupBy("rep").agg(F.sum(F.col("e") - F.col("s")).alias(name))

    per = total(intervals, "inside").join(total(intervals.where("later"), "repeated"), "rep", "left")
    copies = classes.groupBy("rep").agg(F.count("*").alias("copies"))
    info = classes.join(copies, "rep").join(per, "rep", "left").select(F.col("k").alias(key), "rep", "copies", "inside", "repeated")
    base = df.select(key, F.coalesce(F.char_length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    out = base.join(info, key, "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("inside", F.lit(0)))
    gone = F.when(F.col("rep") < F.col(key), F.col("n_chars")).otherwise(F.coalesce("repeated", F.lit(0)))
    return out.select(key, "n_chars", shared.cast("bigint").alias("shared_chars"), (F.col("n_chars") - gone).cast("bigint").alias("first_chars"))


# Signs that end a sentence.
SENTENCE_END = "。．.!?！？\n"


def without_repeats(df: DataFrame, key: str, text: str, min_chars: int = 200, out: str = "kept") -> DataFrame:
    """``key``, ``text`` and ``out``: the text without the sentences that a text of a smaller key has already.

    A sentence goes if it lies in full inside passages of at least ``min_chars`` characters that
    such a text shares; exact copies beyond the first lose all.  Null stays null, all other rows
    keep their text; rows with one key share its fate.
    """
    intervals, classes = shared_intervals(df, key, text, min_chars), text_classes(df, key, text, min_chars)
    later = _merged(intervals.where("later")).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("gone"))
    info = classes.join(later, "rep", "left").where((F.col("rep") < F.col("k")) | F.col("gone").isNotNull()).select(F.col("k").alias("_k"), (F.col("rep") < F.col("k")).alias("_copy"), "gone")
    rows = df.select(key, text).join(info, F.col(key) == F.col("_k"), "left").select(key, text, "_copy", "gone")

    def run(batches):
        for batch in batches:
            kept = []
            for t, copy, gone in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if t is None or copy is None:
                    kept.append(t)
                    continue
                parts, at, lo = [], 0, 0
                for hi in [*(i + 1 for i, c in enumerate(t) if c in SENTENCE_END), len(t)]:
                    while gone and at < len(gone) and gone[at]["e"] < hi:
                        at += 1
                    inside = copy or (gone and at < len(gone) and gone[at]["s"] <= lo and hi <= gone[at]["e"])
                    parts.append("" if inside else t[lo:hi])
                    lo = hi
                kept.append("".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], [key, text, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField(out, T.StringType())]))
