"""Prefix trie of conversations, merged by families first.

A conversation and the one it borrows its first turns from (its base) meet in
one partition; there it is rebuilt and put into the small trie of its family.
Only combined nodes of families are shuffled then, and merged by the digest of
their turns.  Sums over subtrees need no walk over levels: each distinct node
belongs to its smallest member, so a conversation owns the end of its path, and
a node's sums are sums over its members of what each of them shares or owns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import Scratch, prepare

#: Conversations c - c % FAMILY to the next are a family; up to HEADS - 1 turns are borrowed.
FAMILY, HEADS = 100, 6

#: Nodes of a family that a task holds; beyond, it hands on what it has, and the
#: rest of the family follows in further rows that are merged like other families'.
HELD_NODES = 20_000

ROOT = bytes(16)

_NODE = "id binary, parent binary, depth int, above long, length long, members array<long>, ends array<long>"


def borrowed(conv: int) -> int:
    """How many of its first turns a conversation takes from its base."""
    return zlib.crc32(b"%d" % conv) % HEADS


def turn_digest(role: Column, text: Column) -> Column:
    """256 bits of a turn's role and text; the role's length keeps them apart."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


class _Families:
    """Tries of families, fed with turns by base, the base's own turns first,
    then by conversation."""

    def __init__(self):
        self.base = self.conv = self.last = None
        self.nodes: dict[bytes, list] = {}
        self.done: list[tuple] = []

    def turn(self, base: int, conv: int, digest: bytes, length: int) -> None:
        if conv != self.conv or base != self.base:
            self.end()
            if base != self.base:
                self.flush()
                self.base, self.heads, self.last = base, [], None
            # The ends of a row ascend, and no row's ends lie among another's.
            if self.last is not None and (conv < self.last or self.last < base < conv):
                self.flush()
            self.begin(conv)
        self.seen += 1
        if conv == base:
            if len(self.heads) < HEADS - 1:
                self.heads.append((digest, length))
        elif self.seen <= self.skip:
            return
        self.step(digest, length)

    def begin(self, conv: int) -> None:
        self.conv, self.last, self.seen = conv, conv, 0
        self.at = (ROOT, ROOT, 0, 0, 0)  # id, parent, depth, code points above, its own
        self.node()[4].append(conv)
        self.skip = 0 if conv == self.base else borrowed(conv)
        for digest, length in self.heads[: self.skip]:
            self.step(digest, length)

    def step(self, digest: bytes, length: int) -> None:
        if len(self.nodes) >= HELD_NODES:
            self.flush()
        parent, _, depth, above, own = self.at
        self.at = (sha256(parent + digest).digest()[:16], parent, depth + 1, above + own, length)
        self.node()[4].append(self.conv)

    def node(self) -> list:
        name, *facts = self.at
        if name not in self.nodes:
            self.nodes[name] = [*facts, [], []]
        return self.nodes[name]

    def end(self) -> None:
        if self.conv is not None:
            self.node()[5].append(self.conv)
            self.conv = None

    def flush(self) -> None:
        self.done += [(name, *facts) for name, facts in self.nodes.items()]
        self.nodes = {}

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.done) > least:
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = [x.split()[0] for x in _NODE.split(", ")]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*self.done, strict=True), kinds, strict=True)], names)
            self.done = []


def family_nodes(turns: DataFrame) -> DataFrame:
    """Combined nodes of every family, of (conv_id, turn, role, text): id, parent,
    depth, code points above, code points of its own, members and those that end
    in it.  Turns are shuffled once, as digests and lengths."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id")
    light = turns.filter(conv.isNotNull()).select((conv - conv % FAMILY).alias("base"), "conv_id", "turn", turn_digest(role, text).alias("digest"), F.char_length(text).cast("long").alias("length"))
    met = light.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = _Families()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                families.turn(*row)
            yield from families.batches(5_000)
        families.end()
        families.flush()
        yield from families.batches(0)

    return met.select("base", "conv_id", "digest", "length").mapInArrow(build, _NODE)


def _end_digests(nodes: DataFrame) -> DataFrame:
    """(id, ends_sha256): families' lists of ends pass in ascending order, and
    only the state of one digest is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = state = None
        for batch in batches:
            out = []
            for own, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != name:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = own, sha256()
                else:
                    state.update(b",")
                state.update(b",".join(b"%d" % c for c in ends))
            if out:
                yield _pairs(out)
        if name is not None:
            yield _pairs([(name, state.hexdigest())])

    some = nodes.filter(F.size("ends") > 0).select("id", "ends")
    return some.repartition("id").sortWithinPartitions("id", F.col("ends")[0]).mapInArrow(run, "id binary, ends_sha256 string")


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.string())], ["id", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations.

    (id, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): ``id`` is the digest of the turns from the root
    to the node, ``conv_id`` the smallest member.

    Null roles and texts are empty, a null turn comes first, turns of one number
    are in the order of their digest, and repeated rows are turns of their own.
    Rows without conv_id take no part.  ``%`` takes the sign of the id, as in SQL.
    Texts are read whole, as digests; no table, no trie, not even a root.  Other
    columns aren't read.
    """
    spark = prepare(conversations.sparkSession)
    steps = Scratch(spark)
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    parts = steps.stored(family_nodes(turns), "family-nodes")
    nodes = steps.stored(
        parts.groupBy("id").agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("above").alias("above"), F.max("length").alias("length"),
            F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).alias("n_convs"), F.sum(F.size("ends")).alias("n_ends"),
        ),
        "trie-nodes",
    )
    # A conversation owns its path from the first node on of which it is the
    # smallest member, and is alone from the first node with no other member.
    alone = F.when(F.col("n_convs") == 1, F.col("depth"))
    owners = nodes.groupBy("conv_id").agg(F.min("above").alias("shared"), F.min("depth").alias("own_from"), F.min(alone).alias("alone_from"), F.max((F.col("n_ends") == F.col("n_convs")).cast("int")).alias("leaf"))
    ended = parts.select(F.explode("ends").alias("conv_id"), (F.col("above") + F.col("length")).alias("total"))
    facts = ended.join(owners, "conv_id", "left").select("conv_id", F.coalesce("shared", "total").alias("shared"), "own_from", "alone_from", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    members = parts.select("id", "depth", F.explode("members").alias("conv_id")).join(facts, "conv_id")
    met = members.filter(F.col("alone_from").isNull() | (F.col("depth") < F.col("alone_from")))
    own = F.coalesce(F.col("depth") >= F.col("own_from"), F.lit(False))
    sums = met.groupBy("id").agg(F.sum(F.when(own, 0).otherwise(F.col("shared"))).alias("shared"), F.sum("leaf").alias("n_leaves"))
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    several = F.col("n_convs") > 1
    wide = nodes.join(sums, "id", "left").join(children, "id", "left").join(_end_digests(parts), "id", "left")
    out = wide.join(parents, (F.col("depth") > 0) & (wide["parent"] == parents["parent"]), "left").select(
        "id", F.when(F.col("depth") > 0, wide["parent"]).alias("parent"), F.col("depth").cast("long").alias("depth"), "conv_id", F.col("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(several, F.col("n_leaves")).otherwise(1).alias("n_leaves"), F.when(several, F.col("shared") - (F.col("n_convs") - 1) * F.col("above")).otherwise(0).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    done = Scratch(spark).stored(out, "trie")
    steps.clear()
    return done
