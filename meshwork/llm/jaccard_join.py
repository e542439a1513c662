"""N-gram Jaccard join with PartEnum signatures.

Sets whose sizes can match lie in one size band or in two adjacent ones; in each such pair of bands linked sets differ in
at most k features. The feature domain is cut into floor(k / 2) + 1 parts, one of which holds at most one difference; that
part is cut into three, and the two thirds without the difference are equal: one signature for each choice of two. So
linked sets share a signature, whatever else they hold, and only sets that share one are compared.

A signature of features that many documents hold (a passage, a footer) or of none says little. Where signatures are short,
spare parts are added: then so many more parts hold at most one difference, and a set needs its weak signatures only if more
parts than the spare ones are weak in it. The features that count as frequent only steer this; links don't depend on them.

Equal sets are one class. Classes connected by signatures are a group, written as their differences from one member, the
pivot. Those that link with the pivot need no comparison with each other. For the others a prefix filter on the differences,
rarest in the group first, finds the pairs to compare: |A ^ B| is |a ^ b| of the differences a and b, so a link needs a
certain overlap of a and b, and differences that nobody shares add nothing to it. Each first meets, for each difference in
its prefix, two sets of about its size. Then each group is written as its differences from what most sets of its largest
component hold, so that near copies differ from it by their own edits only, and only pairs that are still in different
components meet. So a group of near copies costs about its size and not its square, wherever the
first pivot lies and though few of its pairs may link. Every pair found is compared exactly.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.plans.components import components
from meshwork.plans.durable import drop, written
from meshwork.plans.skew import lookup
from meshwork.plans.workers import trimmed

SLICE_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
#: A table of ids up to this many rows (a few MB) may be broadcast; its size is counted first.
BROADCAST_ROWS = 500_000
#: Up to this many pairs (16 MB), counted first, one task finds the components; more go by rounds of shuffles.
LOCAL_PAIRS = 500_000
#: Classes that a task remembers to have sent the signatures of (bounds memory only; sending them again does no harm).
SEEN_CLASSES = 1_000_000
#: Signatures and features that a task holds before it combines them (bounds memory only).
HELD = 500_000
#: Signatures of fewer features than this, on average, get spare parts.
SHORT = 8
#: Features held by so many classes of one task, and so many in all tasks that list them, are frequent; at most so many are kept.
OFTEN_IN_TASK, OFTEN, FREQUENT = 4, 32, 500_000
#: Members of a group that meet one copy of their pivot.
SALT_ROWS = 1_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Finalising mix of 64-bit values."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct n-word shingles of texts as sorted 64-bit fingerprints, many texts at a time."""

    def __init__(self, n: int):
        self.n = n
        self.table = _mix(np.arange(256, dtype=np.uint64), 1)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.base = np.uint64(0xD6E8FEB86659FD93)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.up) <= size:
            size = max(size + 1, 2 * len(self.up))
            for name, f in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, f, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text (lower-cased here, A-Z only) its set; texts without words have an empty one."""
        buf = np.frombuffer(b" " + b" ".join(t.lower() for t in texts) + b" ", np.uint8)
        self._powers(len(buf))
        space = self.space[buf]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=total[1:])
        word = _mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * ODD, 2)
        first = np.cumsum([1] + [len(t) + 1 for t in texts])
        at = np.searchsorted(starts, first)
        rolled = np.zeros(max(0, len(word) - self.n + 1), np.uint64)
        for i in range(self.n):
            rolled = _mix(rolled, 3 + i) + word[i : i + len(rolled)]
        rolled = _mix(rolled, 99)
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= self.n:
                out.append(np.unique(rolled[a : b - self.n + 1]))
            elif b > a:
                h = np.zeros(1, np.uint64)
                for w in word[a:b]:
                    h = _mix(h, 50 + int(b - a)) + w
                out.append(_mix(h, 98))
            else:
                out.append(np.empty(0, np.uint64))
        return out


class Bands:
    """Size bands for the link 100 * intersection >= percent * union, and the greatest difference in each pair of bands."""

    def __init__(self, percent: int):
        self.percent, self.starts, self.plans = percent, [1], {}

    def of(self, size: int) -> int:
        while len(self.starts) < 3 or self.starts[-3] <= size:  # the start after the band's end is needed too
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return bisect_right(self.starts, size) - 1

    def differences(self, instance: int) -> int:
        """Instance i holds pairs inside band i - 1 and pairs of bands i - 1 and i: |A ^ B| <= (|A| + |B|)(1 - t)/(1 + t)."""
        low = self.starts[instance] - 1
        return (low + low * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def plan(self, instance: int) -> tuple[int, int, int]:
        """(parts, cuts of a part, spare parts). All but floor(k / 2) parts hold at most one difference, so one more than the spare ones."""
        if instance not in self.plans:
            k, spare = self.differences(instance), 0
            least = k // 2 + 1
            if least >= 8 and 2 * (self.starts[instance] - 1) < SHORT * 3 * least:
                spare = math.ceil(0.1 * least + 2 * math.sqrt(0.1 * least))
            self.plans[instance] = (least + spare, 3 if k else 1, spare)
        return self.plans[instance]

    @property
    def short(self) -> bool:
        """Whether any instance of large sets has spare parts."""
        return 4 * self.percent < 3 * SHORT * (100 - self.percent)


def signatures(s: np.ndarray, bands: Bands, frequent: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a sorted set, in the two instances that its band takes part in; ``frequent`` is sorted."""
    band = bands.of(len(s))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s, 7), dtype=np.uint64)])
    rare = np.ones(len(s), bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s
    rare = np.concatenate([[0], np.cumsum(rare)])
    out = []
    for instance in (band, band + 1):
        if instance == 0:
            continue
        parts, cuts, spare = bands.plan(instance)
        cells = parts * cuts
        # cells are equal ranges of the fingerprint space, so they are runs of the sorted set
        edges = (np.arange(1, cells, dtype=np.uint64) * np.uint64((2**64 - 1) // cells)) if cells > 1 else np.empty(0, np.uint64)
        cut = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        cell = sums[cut[1:]] - sums[cut[:-1]]
        place = np.arange(cells, dtype=np.uint64)
        sig = _mix(cell + np.diff(cut).astype(np.uint64) * ODD + place, 11)
        if cuts == 3:
            v = sig.reshape(parts, 3)
            sig = np.stack([v[:, [1, 2]].sum(1, dtype=np.uint64) + np.uint64(1), v[:, [0, 2]].sum(1, dtype=np.uint64) + np.uint64(2), v[:, [0, 1]].sum(1, dtype=np.uint64) + np.uint64(3)], 1)
            n = np.diff(rare[cut]).reshape(parts, 3)
            weak = n.sum(1, keepdims=True) == n  # nothing but frequent features in the other two thirds
            sig = sig[~weak] if spare and weak.any(1).sum() <= spare else sig.ravel()
        out.append(_mix(sig, 1000 + instance))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    part, size, start = [], 0, 0
    for i, t in enumerate(texts):
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= SLICE_BYTES:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def digests(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """A 64-bit digest of each set, whatever the order of its members."""
    sums = np.array([_mix(s, seed).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
    return _mix(sums, seed + 100).view(np.int64)


class Held:
    """How many classes of a task hold each feature, of those that count OFTEN_IN_TASK or more in one filling."""

    def __init__(self):
        self.parts, self.size, self.found, self.seen = [], 0, [], set()

    def add(self, name: int, s: np.ndarray) -> None:
        if name in self.seen:
            return
        if len(self.seen) < SEEN_CLASSES:
            self.seen.add(name)
        self.parts.append(s)
        self.size += len(s)
        if self.size >= HELD:
            self.count()

    def count(self) -> None:
        if self.parts:
            x, n = np.unique(np.concatenate(self.parts), return_counts=True)
            self.found.append((x[n >= OFTEN_IN_TASK], n[n >= OFTEN_IN_TASK]))
            self.parts, self.size = [], 0


def fingerprint(rows: DataFrame, n: int, counted: bool = False) -> DataFrame:
    """(__id, __text) to (__id, n_shingles, class, check); class and check are 64-bit digests of the set.

    With ``counted``, rows with n_shingles -1 follow: class is a feature that is frequent in the task, check its count there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, kind = Shingler(n), Held(), None
        names = ["__id", "n_shingles", "class", "check"]
        for batch in batches:
            kind = batch.schema.types[0]
            for start, part in _slices(batch.column(1).to_pylist()):
                sets = shingler.sets(part)
                named = digests(sets, 21)
                if counted:
                    for name, s in zip(named.tolist(), sets, strict=True):
                        held.add(name, s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(named), pa.array(digests(sets, 22))], names)
        held.count()
        for x, c in held.found:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), kind), pa.array(np.full(len(x), -1)), pa.array(x.view(np.int64)), pa.array(c.astype(np.int64))], names)

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"__id {kind}, n_shingles long, class long, check long")


def frequent_features(prints: DataFrame) -> np.ndarray:
    """The most frequent features, at most FREQUENT of them (4 MB), sorted. They only make signatures stronger."""
    top = prints.where("n_shingles < 0").groupBy("class").agg(F.sum("check").alias("n")).where(F.col("n") >= OFTEN)
    found = [r[0] for r in top.orderBy(F.desc("n"), "class").limit(FREQUENT).select("class").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def signature_rows(rows: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Texts (column __text) to (sig, class, mate): a signature's least class in a part of a task, and classes that share one there.

    Signatures are combined where they are made, so a signature of very many classes sends a few rows of each task; rows
    with a mate, which shares a signature with the class, have a signature of their own.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def combined(sigs: list, owners: list) -> Iterator[pa.RecordBatch]:
        sig, own = np.concatenate(sigs), np.concatenate(owners)
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        least = own[np.flatnonzero(first)][np.cumsum(first) - 1]
        pair = ~first & (own != least)
        mates = np.unique(np.stack([own[pair], least[pair]], 1), axis=0)
        alone = _mix(_mix(mates[:, 0].view(np.uint64), 41) + mates[:, 1].view(np.uint64), 42)
        for a, b, c in ((sig[first], own[first], pa.nulls(int(first.sum()), pa.int64())), (alone, mates[:, 0], pa.array(np.ascontiguousarray(mates[:, 1])))):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b)), c], ["sig", "class", "mate"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands, seen, sigs, owners, size = Shingler(n), Bands(percent), set(), [], [], 0
        for batch in batches:
            for _, part in _slices(batch.column(0).to_pylist()):
                sets = shingler.sets(part)
                for name, s in zip(digests(sets, 21).tolist(), sets, strict=True):
                    if len(s) and name not in seen:
                        if len(seen) < SEEN_CLASSES:
                            seen.add(name)
                        sigs.append(signatures(s, bands, shared.value))
                        owners.append(np.full(len(sigs[-1]), name, np.int64))
                        size += len(sigs[-1])
                        if size >= HELD:
                            yield from combined(sigs, owners)
                            sigs, owners, size = [], [], 0
        if size:
            yield from combined(sigs, owners)

    return rows.select("__text").mapInArrow(trimmed(run), "sig long, class long, mate long")


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """Texts (column __text) to (class, check, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for _, part in _slices(batch.column(0).to_pylist()):
                sets = shingler.sets(part)
                yield pa.RecordBatch.from_arrays([pa.array(digests(sets, 21)), pa.array(digests(sets, 22)), _lists(sets)], ["class", "check", "set"])

    return rows.select("__text").mapInArrow(trimmed(run), "class long, check long, set array<long>")


def _most(sizes: Column, percent: int) -> Column:
    """The greatest symmetric difference of linked sets whose sizes add up to ``sizes``."""
    return F.floor(sizes * (100 - percent) / (100 + percent) + 1e-9).cast("long")


def differences(groups: DataFrame, texts: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(group, class) to (group, m, num, node, size, psize, a, linked, delta): each set's differences from its group's pivot.

    The pivot is the least class of the group. Members meet it in portions of SALT_ROWS, so a group may be of any size.
    ``node`` is class and check, which tell two sets of one class digest apart.
    """
    m = groups.groupBy("group").agg(F.count(F.lit(1)).alias("m")).withColumn("salts", F.expr(f"1 + m div {SALT_ROWS}"))
    placed = written(groups.join(m, "group").withColumn("salt", F.pmod(F.xxhash64("class"), "salts")), "placed")
    few = placed.count() <= BROADCAST_ROWS
    near = lambda t: F.broadcast(t) if few else t
    sets = texts(placed.select("class")).join(near(placed), "class")
    tops = placed.where("class = group").select("class", "salts")
    pivots = texts(tops.select("class")).join(near(tops), "class").groupBy("class").agg(F.min_by(F.struct("check", "set"), "check").alias("p"), F.first("salts").alias("salts"))
    pivots = pivots.select(F.col("class").alias("group"), F.col("p.check").alias("pcheck"), F.col("p.set").alias("pset"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    both = sets.join(pivots, ["group", "salt"]).withColumn("delta", F.concat(F.array_except("set", "pset"), F.array_except("pset", "set")))
    both = both.select("group", "m", F.struct("class", "check").alias("node"), F.struct(F.col("group").alias("class"), F.col("pcheck").alias("check")).alias("pivot"), F.size("set").cast("long").alias("size"), F.size("pset").cast("long").alias("psize"), F.size("delta").cast("long").alias("a"), "delta")
    both = both.withColumn("linked", F.col("a") <= _most(F.col("size") + F.col("psize"), percent))
    # of a group of two nothing is left to compare
    out = written(both.withColumn("delta", F.when(F.col("m") > 2, F.col("delta"))).withColumn("num", F.monotonically_increasing_id()), "differences")
    drop(placed)
    return out


def orders(diffs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of groups in which not all link with the pivot: their rows with k, the greatest difference that a link allows a set, and

    (num, node, size, psize, a, k, linked, order, have): the differences that others in the group hold too, rarest first.
    """
    mixed = diffs.where("m > 2").groupBy("group").agg(F.min("linked").alias("every")).where("not every").select("group")
    rows = diffs.where("m > 2").join(mixed, "group", "left_semi").withColumn("k", _most(F.col("size") + F.floor(F.col("size") * 100 / percent), percent))
    seen = rows.select("num", F.explode(F.transform("delta", lambda x: F.xxhash64("group", x))).alias("gx"))
    held = seen.groupBy("gx").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = seen.join(held, "gx").groupBy("num").agg(F.array_sort(F.collect_list(F.struct("n", "gx"))).alias("order"))  # no longer than a set and its pivot's
    kept = rows.select("num", "node", "size", "psize", "a", "k", "linked").join(listed, "num")
    return rows, written(kept.select("*", F.transform("order", lambda x: x["gx"]).alias("gxs"), F.size("order").alias("have")).drop("order"), "orders")


def pairs_to_compare(rows: DataFrame, each: DataFrame, percent: int, opening: bool) -> DataFrame:
    """(u, uc, v, vc) nums and components of sets of different components that don't both link with their group's pivot and may link.

    Linked A and B have |a & b| >= (|a| + |b| - k) / 2, where k = k(|A| + |B|) bounds |A ^ B|. If A doesn't link with the pivot:
    either |a| + |b| <= k, and B is one of the few at so small a distance from the pivot; or a and b share so many differences
    that the prefixes below, in the order of how many sets of the group hold a difference, share one. The opening takes
    for each difference and size class only two sets that have it in their prefix, of two components if there are.
    """
    far = F.greatest(F.lit(1), F.col("a") - F.col("k"))
    half = F.ceil((F.col("a") * (100 + percent) + (F.col("psize") - F.col("size")) * (100 - percent)) / (2.0 * (100 + percent)) - 1e-9)
    first = lambda least: F.posexplode(F.slice("gxs", 1, F.greatest(F.lit(0), F.col("have") - least + 1).cast("int")))
    left = each.where("not linked").select(F.col("num").alias("l"), F.col("size").alias("ls"), F.col("a").alias("la"), F.col("component").alias("lc"), "have", first(far).alias("at", "gx"))
    right = each.select(F.col("num").alias("r"), F.col("size").alias("rs"), F.col("a").alias("ra"), F.col("component").alias("rc"), "have", first(F.greatest(far, half)).alias("at", "gx"))
    left, right = (t.withColumn(n, F.col("have") - F.col("at")).drop("have", "at") for t, n in ((left, "lrest"), (right, "rrest")))
    limit = _most(F.col("ls") + F.col("rs"), percent)
    # if this is the first difference that the two share, they share no more than either has from here on
    enough = 2 * F.least("lrest", "rrest") >= F.col("la") + F.col("ra") - limit
    fits = (F.least("ls", "rs") * 100 >= F.greatest("ls", "rs") * percent) & (F.abs(F.col("la") - F.col("ra")) <= limit) & (F.col("lc") != F.col("rc"))
    on = ["gx"]
    if opening:
        on, step = ["gx", "sizes"], math.log(max(100 / percent, 1.05))
        left, right = (t.withColumn("sizes", F.floor(F.log(c) / step)) for t, c in ((left, "ls"), (right, "rs")))
        some = F.struct(F.xxhash64("rc"), F.xxhash64("r"), "ra", "r", "rs", "rc", "rrest")
        right = right.groupBy(*on).agg(F.array(F.min(some), F.max(some)).alias("x")).select(*on, F.explode("x").alias("x")).select(*on, "x.ra", "x.r", "x.rs", "x.rc", "x.rrest")
    both = left.join(right, on).where(fits & enough).select("l", "lc", "r", "rc")
    if not opening:
        close = rows.where("not linked and a <= k").select("group", F.col("num").alias("l"), F.col("size").alias("ls"), F.col("a").alias("la"), F.col("component").alias("lc"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - F.col("a"))).alias("ra"))
        small = rows.select("group", F.col("num").alias("r"), F.col("size").alias("rs"), F.col("a").alias("ra"), F.col("component").alias("rc"))
        both = both.unionByName(close.join(small, ["group", "ra"]).where(fits & (F.col("la") + F.col("ra") <= limit)).select("l", "lc", "r", "rc"))
    ends = F.array_sort(F.array(F.struct(F.col("l").alias("n"), F.col("lc").alias("c")), F.struct(F.col("r").alias("n"), F.col("rc").alias("c"))))
    return both.select(ends.alias("x")).select(F.expr("x[0].n").alias("u"), F.expr("x[0].c").alias("uc"), F.expr("x[1].n").alias("v"), F.expr("x[1].c").alias("vc")).distinct()


def nearer(rows: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Differences (rows of :func:`differences`) of groups with a component of linked sets, from what most sets of the largest one hold.

    That is no set of the group, so psize is null. The pivot is the set of the component nearest to it, and ``linked`` tells
    of this one: sets of the component differ from the middle by what is their own, so few differences are shared.
    """
    inside = rows.select("group", "num", "node", "delta").join(comps, "node")
    sizes = inside.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"))
    chosen = written(sizes.groupBy("group").agg(F.max(F.struct("n", "component")).alias("x")).select("group", "x.component", "x.n").where("n > 2"), "chosen")
    held = inside.join(chosen, ["group", "component"]).select("group", "n", F.explode("delta").alias("e")).groupBy("group", "n", "e").agg(F.count(F.lit(1)).alias("c"))
    middle = held.where("2 * c > n").groupBy("group").agg(F.collect_list("e").alias("middle"))
    none = F.array().cast("array<long>")
    spread = lambda t: t.withColumn("salt", F.explode(F.expr(f"sequence(0, m div {SALT_ROWS})")))
    m = rows.groupBy("group").agg(F.first("m").alias("m"))
    tops = spread(chosen.join(middle, "group", "left").join(m, "group").select("group", "component", "m", F.coalesce("middle", none).alias("middle"))).drop("m")
    salted = rows.withColumn("salt", F.expr(f"pmod(xxhash64(num), 1 + m div {SALT_ROWS})"))
    both = salted.join(tops, ["group", "salt"]).withColumn("delta", F.concat(F.array_except("delta", "middle"), F.array_except("middle", "delta"))).withColumn("a", F.size("delta").cast("long"))
    first = written(both.select(*rows.columns, "component"), "nearer")
    own = first.join(comps.withColumnRenamed("component", "own"), "node").where("own = component")
    hubs = first.join(own.groupBy("group").agg(F.min(F.struct("a", "num")).alias("x")).select("x.num"), "num")
    hubs = spread(hubs.select("group", "m", F.col("node").alias("hub"), F.col("size").alias("hsize"), F.col("delta").alias("hdelta"))).drop("m")
    salted = first.withColumn("salt", F.expr(f"pmod(xxhash64(num), 1 + m div {SALT_ROWS})")).join(hubs, ["group", "salt"])
    apart = F.size("delta") + F.size("hdelta") - 2 * F.size(F.array_intersect("delta", "hdelta"))
    out = salted.withColumns({"pivot": F.col("hub"), "psize": F.lit(None).cast("long"), "linked": apart <= _most(F.col("size") + F.col("hsize"), percent)})
    out = written(out.select(*rows.columns), "nearer")
    drop(chosen, first)
    return out


def linked_pairs(diffs: DataFrame, percent: int) -> DataFrame:
    """(u, v) nodes that are connected by links, enough of them to connect all that links connect.

    First those with the pivot; then those of the opening; then, from the middles, all pairs that are left
    between different components, of which each pair of components is kept once.
    """
    tops = lambda t: t.where("linked and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    links = tops(diffs)
    rows, each = orders(diffs, percent)
    if each.where("not linked").isEmpty() and rows.where("not linked and a <= k").isEmpty():
        return links
    for opening in (True, False):
        comps = written(components(links, LOCAL_PAIRS), "components")
        if not opening:
            moved = nearer(rows.select(*diffs.columns), comps, percent)
            if not moved.isEmpty():
                diffs = written(diffs.join(moved.select("group").distinct(), "group", "left_anti").unionByName(moved), "differences")
                links = written(links.unionByName(tops(moved)), "links")
                comps = written(components(links, LOCAL_PAIRS), "components")
                drop(each)
                rows, each = orders(diffs, percent)
            drop(moved)
        of = lambda t: t.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))  # noqa: B023, E731
        pairs = written(pairs_to_compare(of(rows), of(each), percent, opening), "pairs")
        found = _links(pairs, diffs, percent)
        found = found.select("u", "v") if opening else found.select(F.col("uc").alias("u"), F.col("vc").alias("v")).distinct()
        links = written(links.unionByName(found), "links")
        drop(pairs)
    return links


def _links(pairs: DataFrame, diffs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, uc, v, vc) of nums and components those that link, nodes for nums, by exact comparison of their differences.

    Up to BROADCAST_ROWS pairs their ids go to the differences, so that only those of these pairs are shuffled.
    """
    a = diffs.select(F.col("num").alias("u"), F.col("node").alias("un"), F.col("size").alias("us"), F.col("delta").alias("ud"))
    b = diffs.select(F.col("num").alias("v"), F.col("node").alias("vn"), F.col("size").alias("vs"), F.col("delta").alias("vd"))
    if pairs.count() <= BROADCAST_ROWS:
        b = b.join(F.broadcast(pairs.select("v").distinct()), "v", "left_semi")
        pairs = F.broadcast(pairs)
    both = a.join(pairs, "u").join(b, "v").withColumn("apart", F.size("ud") + F.size("vd") - 2 * F.size(F.array_intersect("ud", "vd")))
    return both.where(F.col("apart") <= _most(F.col("us") + F.col("vs"), percent)).select(F.col("un").alias("u"), "uc", F.col("vn").alias("v"), "vc")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row: id, n_shingles, component_id.

    Sets are the distinct ``n``-word shingles; shorter texts are one shingle; null, empty and blank texts have none and link
    with nothing. Whole texts are taken, whatever their length. component_id is the smallest id reachable by links, the row's
    own id for sets that are empty. Rows that repeat an id are compared each by its own text. Null ids take part, but name a
    component only if no other id is in it (then it is null). Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    short = Bands(percent).short
    every = written(fingerprint(rows, n, counted=short), "prints")
    frequent = frequent_features(every) if short else np.empty(0, np.uint64)
    prints = every.where("n_shingles >= 0")
    classes = written(prints.where("n_shingles > 0").groupBy("class", "check").agg(F.min("__id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    few = classes.count() <= BROADCAST_ROWS

    def of(chosen: DataFrame) -> DataFrame:
        """Rows of the reps of classes; a rep may have other rows too."""
        reps = classes.select("rep") if chosen is classes else chosen.join(classes, "class").select("rep")
        reps = F.broadcast(reps) if few else reps
        return rows.join(reps, rows["__id"].eqNullSafe(reps["rep"]), "left_semi")

    # one row of each class sends its signatures; beyond the bound all rows do, as a shuffle of the texts costs more
    sent = signature_rows(of(classes) if few else rows, n, percent, frequent)
    met = sent.withColumn("least", F.min("class").over(Window.partitionBy("sig"))).where("mate is not null or least < class")
    edges = written(met.select(F.col("class").alias("u"), F.coalesce("mate", "least").alias("v")).distinct(), "edges")
    groups = written(components(edges, LOCAL_PAIRS).select(F.col("component").alias("group"), F.col("node").alias("class")), "groups")
    diffs = differences(groups, lambda chosen: shingle_sets(of(chosen), n), percent)
    comps = written(components(linked_pairs(diffs, percent), LOCAL_PAIRS), "components")
    drop(edges, groups, diffs)
    classes = classes.withColumn("node", F.struct("class", "check")).join(comps, "node", "left")
    named = classes.where("component is not null").groupBy("component").agg(F.min("rep").alias("first"))
    classes = classes.join(named, "component", "left").select(F.struct("class", "check").alias("node"), "copies", F.coalesce("first", "rep").alias("component_id"))
    table = written(classes, "named")
    keyed = prints.select("__id", "n_shingles", F.when(F.col("n_shingles") > 0, F.struct("class", "check")).alias("__class"))
    out = lookup(keyed, "__class", F.xxhash64("__id"), table, "node", "copies", prints.count())
    return out.select(F.col("__id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("__id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose id and text name their component: one document of each group stays. Rows without an id stay.

    A document is an id with a text, so of rows that repeat an id each is judged by its own text; of such rows in one group
    that have the smallest id, the one of smallest text hash stays. Rows that repeat both stay or go together.
    """
    both = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
    found = jaccard_join(docs.select(both.alias("__doc"), F.col(text_col).alias("__text")), "__doc", "__text", **options)
    gone = found.where(~F.col("__doc").eqNullSafe(F.col("component_id"))).select(F.col("__doc.id").alias("__gone"), F.col("__doc.text").alias("__hash")).distinct()
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__hash"]), "left_anti")
