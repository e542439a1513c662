"""The trie of conversation prefixes, without a step that holds a conversation or a node's members in one task.

Every node is owned by its smallest member, so a conversation owns a suffix of its path: the members of a deeper node are some of
those of the node above it. What a subtree sums up is then told by its members alone. A member adds the tokens of its own turns
from the node on, less those that it owns (each node is owned once), and a flag if it owns a leaf; one group-by of the prefixes
adds that up, and its partial sums take the load off prefixes that many conversations share.

A prefix is named by its length and the xor of two 64-bit hashes of each (place, digest of the turn), which windows over stretches
of a conversation give from place to place; the rare conversation beyond a stretch gets its other stretches' xor by a window over
stretches. Names are 128 bits of SHA-256 digests hashed with their places; prefixes that differ are taken to have different names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.plans.durable import written
from meshwork.plans.skew import lookup
from meshwork.plans.workers import trimmed

#: Turns of a stretch, over which a window runs.
STRETCH = 1024
#: So many characters of role and text bound the ranges by which turns are sorted; within a range whole texts are compared.
BOUND_CHARS = 64


def head_length(conv: Column, most: int) -> Column:
    """How many turns a rebuilt conversation takes from the first of its family: unsigned CRC-32 of the decimal id modulo ``most``."""
    return (F.crc32(conv.cast("string").cast("binary")) % most).cast("long")


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv, part, at, digest, size): ``at`` numbers the turns of a conversation within a part; parts are ranges of all turns in order."""
    short = F.length("role") <= BOUND_CHARS
    ranges = [F.col("conv"), F.col("turn").asc_nulls_first(), F.substring("role", 1, BOUND_CHARS), ~short, F.when(short, F.substring("text", 1, BOUND_CHARS))]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string").cast("binary"), F.lit(b":"), F.encode("role", "UTF-8"), F.encode("text", "UTF-8")), 256))
    sorted_ = turns.repartitionByRange(parts, *ranges).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    slim = sorted_.select("conv", F.spark_partition_id().alias("part"), digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column("conv").to_numpy()
            begins = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(begins, np.diff(np.append(begins, len(conv))))
            if conv[0] == last:
                at[: begins[1] if len(begins) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    return slim.mapInArrow(trimmed(run), "conv long, part int, digest binary, size long, at long")


def _rebuilt(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(conv, d, digest, size, ends) for the turns of rebuilt conversations, d from 1, ``ends`` being how many there are; and (conv, ends)."""
    parts = written(_numbered(turns), "trie-turns")
    # a conversation goes on in the next part at most once a part, so what came before is one row a part
    spans = parts.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    carried = spans.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("before is not null")
    placed = parts.join(F.broadcast(carried.select("conv", "part", "before")), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "digest", "size")
    lengths = spans.groupBy("conv").agg(F.sum("n").alias("n"))
    head = F.col("conv") - F.col("conv") % family
    known = lengths.select("conv", "n", head.alias("head"), head_length(F.col("conv"), most).alias("h"))
    known = known.join(lengths.select(F.col("conv").alias("head"), F.col("n").alias("head_n")), "head", "left")
    taken = F.least("h", F.coalesce("head_n", F.lit(0)))
    known = written(known.select("conv", "n", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("ends")), "trie-lengths")
    # at most ``most`` turns of a head, each for at most 2 * family conversations
    heads = placed.where((F.col("conv") % family == 0) & (F.col("at") < most)).select(F.col("conv").alias("head"), "at", "digest", "size")
    copied = known.where("taken > 0").select("conv", "head", "taken", "ends").join(heads, "head").where("at < taken").select("conv", (F.col("at") + 1).alias("d"), "digest", "size", "ends")
    own = placed.where(F.col("at") >= head_length(F.col("conv"), most))
    own = lookup(own, "conv", F.col("at"), known.select(F.col("conv").alias("c"), "n", "h", "taken", "ends"), "c", "n", turns.count())
    own = own.select("conv", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("d"), "digest", "size", "ends")
    return copied.unionByName(own), known.select("conv", "ends")


def _paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, d, x, y, px, py, before, ends) for every place of every path, the root's included: names of prefix and parent, tokens before."""
    names = turns.select("conv", "d", "size", "ends", F.xxhash64("d", "digest").alias("a"), F.xxhash64("digest", "d", F.lit(1)).alias("b"), ((F.col("d") - 1) / STRETCH).cast("long").alias("stretch"))
    along = Window.partitionBy("conv", "stretch").orderBy("d")
    names = names.withColumns({"x": F.bit_xor("a").over(along), "y": F.bit_xor("b").over(along), "upto": F.sum("size").over(along)})
    whole = turns.where(F.col("ends") > STRETCH).select("conv", "size", F.xxhash64("d", "digest").alias("a"), F.xxhash64("digest", "d", F.lit(1)).alias("b"), ((F.col("d") - 1) / STRETCH).cast("long").alias("stretch"))
    whole = whole.groupBy("conv", "stretch").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("size").alias("s"))
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("conv", "stretch", F.bit_xor("a").over(earlier).alias("ox"), F.bit_xor("b").over(earlier).alias("oy"), F.sum("s").over(earlier).alias("os")).where("os is not null")
    zero = F.lit(0).cast("long")
    full = lambda c, o: F.col(c).bitwiseXOR(F.coalesce(o, zero))
    names = names.join(offsets, ["conv", "stretch"], "left").select(
        "conv", "d", "ends", full("x", "ox").alias("x"), full("y", "oy").alias("y"), "a", "b", (F.col("upto") + F.coalesce("os", zero) - F.col("size")).alias("before"), "size",
    )
    below = names.select("conv", "d", "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("px"), F.col("y").bitwiseXOR(F.col("b")).alias("py"), "before", "size", "ends")
    return lengths.select("conv", zero.alias("d"), *[zero.alias(c) for c in ("x", "y", "px", "py", "before", "size")], "ends").unionByName(below)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(d, x, y, digest): SHA-256 of the decimal ids that end at a node, ascending, joined by commas.

    Ids are sorted by (node, id) over ranges, which split a node's ids, and become strings of a batch's ids each; a node's strings
    pass one by one through a hash that keeps no more than its state.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(c).to_numpy() for c in ("d", "x", "y")]
            begins = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
            ids = batch.column("conv").to_pylist()
            texts = [",".join(map(str, ids[i:j])) for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(k[begins]) for k in keys], batch.column("conv").take(pa.array(begins)), pa.array(texts, pa.string())], ["d", "x", "y", "least", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for d, x, y, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (d, x, y) == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (d, x, y), hashlib.sha256(ids.encode())
            yield rows(out)
        if at is not None:
            yield rows([(*at, state.hexdigest())])

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["d", "x", "y", "digest"])

    cut = ends.repartitionByRange(parts, "x", "y", "d", "conv").sortWithinPartitions("x", "y", "d", "conv").select("d", "x", "y", "conv").mapInArrow(trimmed(pieces), "d long, x long, y long, least long, ids string")
    return cut.repartition("x", "y", "d").sortWithinPartitions("x", "y", "d", "least").mapInArrow(trimmed(digests), "d long, x long, y long, digest string")


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of the rebuilt conversations; see the column names, all long but the digest.

    Conversation c is rebuilt from the first h turns of conversation c - c % ``family`` and its own turns after its first h, where
    h = crc32(c) % ``most``. Turns are ordered by turn, nulls first; ties by role, then text, both by code point, a null one being
    empty; repeated rows are turns of their own. Rows without a conversation id belong to no conversation and are left out; other
    columns are left aside. Texts of any length count whole. A conversation that has no turns when rebuilt is a member of the root
    alone. An empty table has no conversation, hence no root: it gives an empty table.
    """
    turns = conversations.where(conversations[conv_col].isNotNull()).select(
        conversations[conv_col].cast("long").alias("conv"), conversations[turn_col].alias("turn"),
        F.coalesce(conversations[role_col], F.lit("")).alias("role"), F.coalesce(conversations[text_col], F.lit("")).alias("text"),
    )
    rebuilt, lengths = _rebuilt(turns, family, most)
    paths = written(_paths(rebuilt, lengths), "trie-paths")
    node = F.struct("d", "x", "y")
    # a node's smallest member owns it; a conversation owns its path from the first node that it owns
    owners = paths.groupBy("d", "x", "y").agg(F.min(F.struct("conv", "before", "ends")).alias("o"), F.max("ends").alias("deepest"), F.count(F.lit(1)).alias("members"))
    owners = written(owners.select("d", "x", "y", "o.conv", "o.before", ((F.col("d") == F.col("o.ends")) & (F.col("d") == F.col("deepest"))).alias("leaf"), "members"), "trie-owners")
    first = owners.groupBy("conv").agg(F.min(F.struct("d", "before")).alias("f"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    # of a conversation that owns nothing all tokens are shared
    whole = paths.where("d = ends").select("conv", "ends", (F.col("before") + F.col("size")).alias("total"))
    marks = whole.join(first, "conv", "left").select(
        F.col("conv").alias("c"), (F.col("ends") + 1).alias("places"), F.coalesce("f.d", F.col("ends") + 1).alias("owned"),
        F.coalesce("f.before", F.col("total")).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    marked = lookup(paths, "conv", F.col("d"), marks, "c", "places", paths.count())
    child = (F.col("d") < F.col("ends")) & (F.col("d") + 1 >= F.col("owned"))
    sums = marked.groupBy("d", "x", "y").agg(
        F.min(F.struct("conv", "owned", "ends", "px", "py")).alias("o"), F.count(F.lit(1)).alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    sums = sums.join(_end_digests(paths.where("d = ends").select("d", "x", "y", "conv")), ["d", "x", "y"], "left")
    sums = written(sums.select("d", "x", "y", "o.*", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie-nodes")
    # the parent of the first node that a conversation owns is another's, so no more ask for one than there are conversations
    asked = sums.withColumn("above", F.when((F.col("d") == F.col("owned")) & (F.col("d") > 0), F.struct((F.col("d") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y"))))
    askers = F.col("n_children") - (F.col("ends") > F.col("d")).cast("long")
    found = lookup(asked.drop("x", "y"), "above", F.col("conv"), sums.select(node.alias("n"), F.col("conv").alias("parent"), askers.alias("askers")), "n", "askers", lengths.count())
    parent = F.when(F.col("d") > 0, F.when(F.col("d") > F.col("owned"), F.col("conv")).otherwise(F.col("parent")))
    return found.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
