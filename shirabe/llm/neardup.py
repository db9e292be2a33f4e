"""Near-duplicate records by the Jaccard similarity of their character n-gram sets, without loss.

All n-grams stand in one global order (that of a mixed hash), which is cut into ``F`` fragments:
vertical partitions of every record's set.  Two sets of sizes s and s' whose similarity reaches
num/den differ in at most ``(s + s') (den - num) / (den + num)`` n-grams.  With more than half as
many fragments as that, some fragment differs in at most one n-gram, so one of the two records
has in it exactly the other's part, or that part less one n-gram.  Every record therefore sends
one key per fragment (the part) and one per n-gram (the part without it); equal keys make a
candidate.  Nothing is learnt from two parts that are both empty, so an empty part sends no key:
a record whose part is empty, or holds one n-gram only, sends the keys of its other n-grams in a
second order instead, marked with the fragment, and there again in a third one; so records that are
merely poor in the same fragment do not meet, and no link is lost.

Nearly all keys meet none.  So the keys move as sorted, packed numbers of a block of records (about
five bytes each), some fragments in a pass, and only those that meet become rows.  These pass a
parity sketch (it can only underestimate the difference), and for the few pairs that remain
the overlaps are counted fragment by fragment and summed per pair.  The keys are computed per record,
so nothing needs a look at all pairs; every pass drops its files before the next one begins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.session import discard, materialize

_GOLD = np.uint64(0x9E3779B97F4A7C15)
PARTS = 8  # fragments of the counting step
SMALL = 128  # sets up to this size need 64 bits of the sketch
WIDE = [f"w{i}" for i in range(8)]  # the words of the sketch of larger sets
DEPTH = 2  # further orders in which records with poor parts meet
PASSES = 4  # the fragments are dealt to so many passes, whatever the size of the input
_ROWS_AT_ONCE = 4_000
_LOW = 20  # lowest bits of a packed key: the place of its record in the block and whether the part is whole
_HASH = 40  # bits above these: the hash to meet by
_BLOCK = 2_000_000  # packed keys of a block, and about those of a slice


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _levels(most: int) -> list[int]:
    """Lower bounds of the size classes, growing by half."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def _reach(size, num: int, den: int):
    """Largest size a set may have beside a smaller one of this size."""
    return size * den // num


def gram_sets(values: list[list[str]], n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Owner and n-gram number (distinct per owner, in order) of all records; no n-gram spans two elements."""
    owner_of, parts = [], []
    for i, texts in enumerate(values):
        for t in texts:
            if t is not None and len(t) >= n:
                owner_of.append(i)
                parts.append(t)
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    lens = np.array([len(t) for t in parts], np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lens)
    piece = np.repeat(np.arange(len(parts)), lens)
    at = np.arange(len(codes))
    whole = at + n <= ends[piece]
    at = at[whole]
    if n <= 3:
        gram = np.zeros(len(at), np.uint64)
        for k in range(n):
            gram = (gram << np.uint64(21)) | codes[at + k]
    else:
        gram = np.zeros(len(at), np.uint64)
        for k in range(n):
            with np.errstate(over="ignore"):
                gram = _mix(gram * _GOLD + codes[at + k] + np.uint64(1))
    owner = np.array(owner_of, np.int64)[piece[at]]
    if n == 2 and len(values) < 1 << 22:  # both in one number
        both = np.sort((owner.astype(np.uint64) << np.uint64(42)) | gram)
        owner, gram = (both >> np.uint64(42)).astype(np.int64), both & np.uint64((1 << 42) - 1)
    else:
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return owner[first], gram[first]


def _keys(owner: np.ndarray, gram: np.ndarray, sizes: np.ndarray, num: int, den: int, turn: int = 0, turns: int = 1):
    """Record, key, and whether the key stands for the whole part of a fragment; of every ``turns``-th fragment only."""
    bounds = _levels(int(sizes.max(initial=0)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool))]
    for level in range(len(bounds) - 1):
        top = bounds[level + 1] - 1
        most = (top + _reach(top, num, den)) * (den - num) // (den + num)
        here = (sizes >= bounds[level]) & (sizes <= _reach(top, num, den))
        if here.any():
            records = np.flatnonzero(here)
            place = np.full(len(sizes), -1, np.int64)
            place[records] = np.arange(len(records))
            pick = here[owner]
            salt = np.full(len(records), 1000 * (level + 1), np.uint64)
            _level_keys(records, place[owner[pick]], gram[pick], salt, most, 0, out, (turn + level) % turns, turns)
    own, keys, full = zip(*out)
    return np.concatenate(own), np.concatenate(keys), np.concatenate(full)


def _level_keys(records: np.ndarray, row: np.ndarray, gram: np.ndarray, salt: np.ndarray, most: int, depth: int, out: list, turn: int = 0, turns: int = 1) -> None:
    """Keys of sets that may differ in ``most`` n-grams; ``row`` is the place of each n-gram's set in ``records``."""
    frags = most // 2 + 1
    if turn >= frags:
        return
    spot = _mix(gram + np.uint64(depth * int(_GOLD) % (1 << 64))) >> np.uint64(32)  # place in the global order of this depth, 32 bits
    frag = ((spot * np.uint64(frags)) >> np.uint64(32)).astype(np.int64)
    now = frag % turns == turn
    own = row[now]
    cell = own * frags + frag[now]
    token = _mix(gram[now] + _GOLD)
    count = np.bincount(cell, minlength=len(records) * frags)
    due = np.tile(np.arange(frags) % turns == turn, len(records))
    total = np.zeros(len(records) * frags, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(total, cell, token)
        mark = _mix(np.repeat(salt, frags) + np.tile(np.arange(frags, dtype=np.uint64), len(records)))
        again = depth < DEPTH and frags > 1
        whole = (count > 0) & due if again else due
        out.append((np.repeat(records, frags)[whole], _mix(total + mark)[whole], np.ones(int(whole.sum()), bool)))
        if most > 0:
            less = count[cell] > 1 if again else np.ones(len(cell), bool)
            out.append((records[own[less]], _mix(total[cell] - token + mark[cell])[less], np.zeros(int(less.sum()), bool)))
    poor = np.flatnonzero((count <= 1) & due)
    if not again or not len(poor):
        return
    # one further set per poor part: the record's n-grams outside it
    begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(records)))])
    order = np.argsort(row, kind="stable")
    size = np.diff(begin)[poor // frags]
    new_row = np.repeat(np.arange(len(poor)), size)
    at = order[np.arange(len(new_row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[poor // frags], size)]
    other = frag[at] != (poor % frags)[new_row]
    _level_keys(records[poor // frags], new_row[other], gram[at[other]], mark[poor] + np.uint64(1), most, depth + 1, out)


def _records(df: DataFrame, key: str, values: str, n: int) -> DataFrame:
    """``k``, ``n``, ``sk`` and the words of ``WIDE`` per record that has n-grams, with its values ``v``.

    The words are a parity sketch, ``sk`` is the same folded to one word; sets up to ``SMALL`` have zeros as words.
    """

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(lo, _ROWS_AT_ONCE)
                owner, gram = gram_sets(batch.column(1).to_pylist(), n)
                sizes = np.bincount(owner, minlength=batch.num_rows)
                spot = _mix(gram * np.uint64(3) + np.uint64(7))
                sketch = np.zeros((len(WIDE), batch.num_rows), np.uint64)
                np.bitwise_xor.at(sketch, ((spot >> np.uint64(32)).astype(np.int64) % len(WIDE), owner), np.uint64(1) << (spot & np.uint64(63)))
                folded = np.bitwise_xor.reduce(sketch, axis=0)
                sketch[:, sizes <= SMALL] = 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), batch.column(1), *(pa.array(x.view(np.int64)) for x in (folded, *sketch))], ["k", "n", "v", "sk", *WIDE])

    rows = df.select(F.col(key).alias("k"), F.col(values).alias("v"))
    schema = T.StructType([rows.schema["k"], T.StructField("n", T.IntegerType()), rows.schema["v"], *(T.StructField(x, T.LongType()) for x in ("sk", *WIDE))])
    return rows.mapInArrow(run, schema).where(F.col("n") > 0)


def _parts(records: DataFrame, n: int) -> DataFrame:
    """``k``, ``n`` and ``parts`` (the set in fragments)."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(lo, _ROWS_AT_ONCE)
                owner, gram = gram_sets(batch.column(2).to_pylist(), n)
                part = ((_mix(gram) >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.int64)
                cell = owner * PARTS + part
                order = np.argsort(cell, kind="stable")
                counts = np.bincount(cell, minlength=batch.num_rows * PARTS)
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(gram[order].view(np.int64)))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * PARTS + 1, PARTS, dtype=np.int32)), inner)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), outer], ["k", "n", "parts"])

    schema = T.StructType([records.schema["k"], records.schema["n"], T.StructField("parts", T.ArrayType(T.ArrayType(T.LongType())))])
    return records.select("k", "n", "v").mapInArrow(run, schema)


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: the upper bytes of small numbers cost next to nothing."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, many: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, many * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, many)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(many)


def _packed_keys(records: DataFrame, num: int, den: int, n: int, turn: int, slices: int) -> DataFrame:
    """``slice``, ``many``, ``body``, ``held``, ``rids``: the keys of a pass, one row per block of records and slice of the hashes.

    ``body`` holds sorted numbers, each as its distance in hash from the one before, with the place
    of the record among ``rids`` and whether the part is whole in the lowest bits.  Chance collisions
    only add candidates, which the counting removes.
    """

    def rows(packed: list[np.ndarray], rids: list[np.ndarray]):
        keys, ids = np.sort(np.concatenate(packed)), np.concatenate(rids)
        held, at = len(ids), _squeeze(np.diff(ids, prepend=np.uint64(0)))
        low = keys & np.uint64((1 << _LOW) - 1)
        hashed = keys >> np.uint64(_LOW)
        firsts = np.array([-(-(i << _HASH) // slices) for i in range(slices + 1)], np.uint64)
        ends = np.searchsorted(hashed, firsts)
        out = [(i, int(hi - lo), _squeeze((np.diff(hashed[lo:hi], prepend=np.uint64(0)) << np.uint64(_LOW)) | low[lo:hi]), held, at) for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])) if hi > lo]
        for lo in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out[lo : lo + 64]), (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()))], ["slice", "many", "body", "held", "rids"])

    def run(batches):
        packed, rids, have, held = [], [], 0, 0
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS_AT_ONCE // 2):
                batch = whole.slice(lo, _ROWS_AT_ONCE // 2)
                owner, gram = gram_sets(batch.column(1).to_pylist(), n)
                own, keys, full = _keys(owner, gram, np.bincount(owner, minlength=batch.num_rows), num, den, turn, PASSES)
                packed.append((keys >> np.uint64(64 - _HASH) << np.uint64(_LOW)) | ((own + held).astype(np.uint64) << np.uint64(1)) | full.astype(np.uint64))
                rids.append(batch.column(0).to_numpy().view(np.uint64))
                have, held = have + len(keys), held + batch.num_rows
                if have >= _BLOCK or held + _ROWS_AT_ONCE > 1 << (_LOW - 1):
                    yield from rows(packed, rids)
                    packed, rids, have, held = [], [], 0, 0
        if have:
            yield from rows(packed, rids)

    return records.select("rid", "v").mapInArrow(run, "slice int, many int, body binary, held int, rids binary")


def _meeting(table: pa.Table) -> pa.Table:
    """``key``, ``rid``, ``full``: of the keys of one slice, those that some whole part shares with another."""
    hashes, lows, blocks, ids = [], [], [], []
    for i, row in enumerate(zip(*(table.column(c).to_pylist() for c in ("many", "body", "held", "rids")))):
        many, body, held, rids = row
        both = _unsqueeze(body, many)
        hashes.append(np.cumsum(both >> np.uint64(_LOW), dtype=np.uint64))
        lows.append((both & np.uint64((1 << _LOW) - 1)).astype(np.int32))
        blocks.append(np.full(many, i, np.int32))
        ids.append(np.cumsum(_unsqueeze(rids, held), dtype=np.uint64).view(np.int64))
    hashed, low, block = np.concatenate(hashes), np.concatenate(lows), np.concatenate(blocks)
    full = (low & 1) == 1
    wholes = np.flatnonzero(full)
    known, where, times = np.unique(hashed[wholes], return_inverse=True, return_counts=True)
    bits = np.uint64((1 << max(16, len(known).bit_length() + 5)) - 1)
    maybe = np.zeros(int(bits) + 1, bool)
    maybe[known & bits] = True
    less = np.flatnonzero(maybe[hashed & bits] & ~full)
    at = np.searchsorted(known, hashed[less])
    hit = at < len(known)
    hit[hit] = known[at[hit]] == hashed[less[hit]]
    met = times > 1
    met[at[hit]] = True
    live = np.concatenate([wholes[met[where]], less[hit]])
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    rid = np.concatenate(ids)[starts[block[live]] + (low[live] >> 1)]
    return pa.table({"key": hashed[live].view(np.int64), "rid": rid, "full": full[live]})


def _candidates(records: DataFrame, num: int, den: int, n: int, turn: int, slices: int) -> DataFrame:
    """``a``, ``b``: pairs that meet in the fragments of a pass and that size and sketch leave."""
    live = _packed_keys(records, num, den, n, turn, slices).groupBy("slice").applyInArrow(_meeting, "key long, rid long, full boolean")
    keys = materialize(live.join(records.drop("v"), "rid").drop("rid"), "near-keys", lean=True)
    a, b = keys.where("full").alias("a"), keys.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    most = F.floor((na + nb) * (den - num) / (den + num))
    apart = {w: F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in ("sk", *WIDE)}
    wide = (F.least(na, nb) <= SMALL) | (reduce(Column.__add__, (apart[w] for w in WIDE)) <= most)
    close = (F.greatest(na, nb) * num <= F.least(na, nb) * den) & (apart["sk"] <= most) & wide
    same = F.col("a.key") == F.col("b.key")
    met = a.join(b, same & F.when(F.col("b.full"), F.col("a.k") < F.col("b.k")).otherwise(F.col("a.k") != F.col("b.k")) & close)
    pairs = materialize(met.select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b")).distinct(), "near-candidates", lean=True)
    discard(keys)
    return pairs


def near_links(df: DataFrame, key: str, values: str, num: int = 4, den: int = 5, n: int = 2) -> DataFrame:
    """``a``, ``b``, ``common``, ``either``: pairs with a < b whose sets reach num/den, each once.

    ``values`` is an array of strings per record; the set of a record is the union of the sets of
    its elements.  Rows that repeat a key count as records of that key, a pair comes out once, and
    rows with a null key take no part.  Records without an n-gram (null, empty, too short)
    are linked to nothing here.  Exact copies are records like others: pass one per class.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must lie above 0 and not above 1")
    records = materialize(_records(df, key, values, n).withColumn("rid", F.monotonically_increasing_id()), "near-records", lean=True)
    grams = records.agg(F.sum("n")).first()[0] or 0
    slices = max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * grams // PASSES // _BLOCK + 1)
    found = [_candidates(records, num, den, n, turn, slices) for turn in range(PASSES)]
    cand = materialize(reduce(DataFrame.unionByName, found).distinct(), "near-candidates", lean=True)
    for x in found:
        discard(x)
    sides = cand.select(F.col("a").alias("k")).unionByName(cand.select(F.col("b").alias("k"))).distinct()
    sets = materialize(_parts(records.join(sides, "k", "left_semi"), n), "near-sets", lean=True)
    discard(records)
    left = sets.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa"))
    right = sets.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))
    both = cand.join(left, "a").join(right, "b")
    # overlaps fragment by fragment, summed per pair
    common = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.size(F.array_intersect(x, y))), F.lit(0), lambda s, x: s + x)
    counted = both.select("a", "b", common.alias("common"), (F.col("na") + F.col("nb") - common).alias("either"))
    near = counted.where(F.col("common") * den >= F.col("either") * num)
    links = materialize(near.groupBy("a", "b").agg(F.max("common").alias("common"), F.min("either").alias("either")), "near-links", lean=True)
    discard(sets)
    discard(cand)
    return links


def copy_classes(df: DataFrame, key: str, values: str) -> DataFrame:
    """``k``, ``rep``: each key with the smallest key of the very same value.

    Rows that are null, empty, or hold only blank elements take no part.
    """
    rows = df.select(F.col(key).alias("k"), F.col(values).alias("v")).where(F.col("k").isNotNull() & F.exists("v", lambda x: x.isNotNull() & x.rlike(r"(?U)\S")))
    text = F.to_json(F.struct("v"))
    hashed = rows.select("k", F.xxhash64("v").alias("x"), F.sha2(text, 256).alias("y"))
    reps = hashed.groupBy("x", "y").agg(F.min("k").alias("rep"))
    return hashed.join(reps, ["x", "y"]).select("k", "rep").distinct()


def near_pairs(df: DataFrame, key: str, values: str, num: int = 4, den: int = 5, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives, and the classes of exact copies (``k``, ``rep``)."""
    classes = materialize(copy_classes(df, key, values), "near-classes", lean=True)
    reps = classes.where(F.col("k") == F.col("rep")).select(F.col("rep").alias("k"))
    rows = df.select(F.col(key).alias("k"), F.col(values).alias("v")).join(reps, "k", "left_semi")
    return near_links(rows, "k", "v", num, den, n), classes


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``k``, ``group``: connected components of ``links`` (a, b); the group is its smallest key.

    Every round each key takes the smallest group among its own, its neighbours' and its group's
    group (pointer jumping); the labels are written to the shared folder each round, and the round before is dropped.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", lean=True)
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("group")), "labels", lean=True)
    last = labels
    for _ in range(max_rounds):
        best = edges.join(labels.select(F.col("k").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("m"))
        near = labels.join(best, labels.k == best.a).select("k", F.col("group").alias("old"), F.least("group", "m").alias("group"))
        jump = labels.select(F.col("k").alias("group"), F.col("group").alias("next"))
        new = materialize(near.join(jump, "group").select("k", "old", F.least("group", "next").alias("group")), "labels", lean=True)
        moved = new.where(F.col("old") != F.col("group")).limit(1).count()
        discard(last)
        last, labels = new, new.select("k", "group")
        if not moved:
            return labels
    raise RuntimeError("the components did not settle")


def near_groups(df: DataFrame, key: str, values: str, num: int = 4, den: int = 5, n: int = 2, group: str = "group_key", links: str = "n_links") -> DataFrame:
    """One row per record that takes part: ``key``, ``group`` (smallest key of its group) and ``links``.

    ``links`` counts the other records that are near it, exact copies included, counted per class
    and never expanded.
    """
    pairs, classes = near_pairs(df, key, values, num, den, n)
    size = materialize(classes.groupBy("rep").agg(F.count("*").alias("m")), "class-sizes", lean=True)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("m").alias("o"))
    comp = components(pairs).withColumnRenamed("k", "rep")
    info = size.join(other, "rep", "left").join(comp, "rep", "left")
    info = info.select("rep", F.coalesce("group", "rep").alias("g"), (F.col("m") - 1 + F.coalesce("o", F.lit(0))).cast("bigint").alias("l"))
    return classes.join(info, "rep").select(F.col("k").alias(key), F.col("g").alias(group), F.col("l").alias(links))
