"""A Merkle manifest of a dataset by time-forward processing (operator 13)."""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, release_memory

FANOUT = 16
#: Levels that one sweep climbs: a block is what 16^3 nodes in a row have above them.
LEVELS = 3
BLOCK = FANOUT**LEVELS
SIZE = 32


def field_text(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, `:`, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]), 256))


def height(n: int) -> int:
    """Levels above n nodes in a row until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def numbered_in_groups(df: DataFrame, group: str, order: list[str], parts: int) -> DataFrame:
    """df with ``pos``, each row's place in its group from 0 on, and ``size``, the group's number of rows.

    Rows are dealt in ranges of (group, order), so a group of any size is spread over many tasks; a row's place is that in
    its range plus the sizes of the group's earlier ranges. Rows equal in group and order are numbered in any order.
    """
    ranges = df.withColumn("__tie", F.monotonically_increasing_id())
    ranges = ranges.repartitionByRange(parts, group, *order, "__tie").sortWithinPartitions(group, *order, "__tie").drop("__tie")
    ranges = materialize(ranges.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part, nth = F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1)
    own = ranges.groupBy(F.col(group), part).agg(F.min(nth).alias("__first"), F.count("*").alias("__n"))
    of = W.partitionBy(group)  # a group has a row per range at most
    before = F.coalesce(F.sum("__n").over(of.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = own.select(group, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(of).alias("size"))
    return ranges.withColumn("__part", part).join(own, [group, "__part"]).withColumn("pos", F.col("__shift") + nth).drop("__at", "__part", "__shift")


class Sweep:
    """The tree over one block's nodes, built forward in time.

    Nodes are met in the order of their labels: that of a parent is (the last place below it, its level), so it follows
    its children's. A node's digest is a message to its parent's label; the queue holds messages by label, then child, and
    a node takes its own from the front when the sweep reaches it. At most 15 messages a level wait at once; messages to
    nodes of later blocks go to the queue's outer part, a table that the next shuffle sorts by label.
    """

    def __init__(self, digests: list[bytes], levels: int):
        self.levels = [digests, *[[] for _ in range(levels)]]
        queue, last = [], len(digests) - 1
        for at, digest in enumerate(digests):
            if levels:
                heapq.heappush(queue, (self.label(at, 1, last), at, digest))
            while queue and queue[0][0][0] <= at:
                label, got = queue[0][0], []
                while queue and queue[0][0] == label:
                    got.append(heapq.heappop(queue)[2])
                level = label[1]
                own = hashlib.sha256("".join([g.hex() for g in got]).encode()).digest()
                self.levels[level].append(own)
                if level < levels:
                    heapq.heappush(queue, (self.label(at, level + 1, last), at, own))

    @staticmethod
    def label(at: int, level: int, last: int) -> tuple[int, int]:
        """Of the node of a level that lies over the place at."""
        span = FANOUT**level
        return min(at // span * span + span - 1, last), level

    def siblings(self, level: int, k: int) -> tuple[list[bytes], list[bytes]]:
        """Digests left and right of the kth node of a level in its run."""
        first, row = k // FANOUT * FANOUT, self.levels[level]
        return row[first:k], row[k + 1 : first + FANOUT]

    def suffixes(self, above: bytes):
        """(place, proof) of every node of the block, from that of its top: the sweep in reverse.

        Labels are met from the last to the first; each node takes its proof from the queue and sends its children theirs:
        their siblings, then its own proof.
        """
        queue, top, last = [], len(self.levels) - 1, len(self.levels[0]) - 1
        heapq.heappush(queue, ((-last, -top), 0, above))
        while queue:
            (_, level), k, proof = heapq.heappop(queue)
            level, k = -level, -k
            if not level:
                yield k, proof
                continue
            for child in range(FANOUT * k, min(FANOUT * k + FANOUT, len(self.levels[level - 1]))):
                span = FANOUT ** (level - 1)
                label = min(child * span + span - 1, last)
                heapq.heappush(queue, ((-label, -(level - 1)), -child, pack_step(*self.siblings(level - 1, child)) + proof))


def pack_step(left: list[bytes], right: list[bytes]) -> bytes:
    """One level of a proof: how many siblings lie left and right, and their digests."""
    return bytes((len(left), len(right))) + b"".join(left) + b"".join(right)


def steps_of(proof: bytes):
    """(left, right) of each level of a proof, both as hex text."""
    at = 0
    while at < len(proof):
        mid = at + 2 + proof[at] * SIZE
        end = mid + proof[at + 1] * SIZE
        yield proof[at + 2 : mid].hex(), proof[mid:end].hex()
        at = end


def proof_digest(proof: bytes) -> bytes:
    return hashlib.sha256("".join(left + right for left, right in steps_of(proof)).encode()).digest()


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps_of(proof):
        leaf = hashlib.sha256((left + leaf.hex() + right).encode()).digest()
    return leaf


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", *order)


def _by_block(batches):
    """(group, block, rows as tuples) of sorted batches; at most one block of rows is held."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:2] != key:
                if held:
                    yield *key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield *key, held


def _table(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def climb(nodes: DataFrame) -> list[DataFrame]:
    """nodes (grp, pos, size, digest), then the same for every sweep's tops, until each group has one.

    A sweep climbs three levels: nodes are dealt by blocks of 4,096 in a row, whatever group they are of.
    """
    fields = [("grp", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())]

    def run(batches):
        out = []
        for grp, block, rows in _by_block(batches):
            size = rows[0][1]
            levels = min(LEVELS, height(size))
            for _ in range(levels):
                size = -(-size // FANOUT)
            out.append((grp, block, size, Sweep([r[2] for r in rows], levels).levels[-1][0]))
            if len(out) >= 10_000:
                yield _table(out, fields)
                out = []
        yield _table(out, fields)

    sweeps = [nodes]
    while True:
        more = sweeps[-1] if len(sweeps) == 1 else sweeps[-1].where("size > 1")
        if len(sweeps) > 1 and more.isEmpty():
            return sweeps
        rows = _dealt(more.select("grp", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "size", "digest"), "pos")
        sweeps.append(materialize(rows.mapInArrow(run, "grp string, pos long, size long, digest binary"), "sweep"))


def tops(sweeps: list[DataFrame]) -> DataFrame:
    """(grp, digest): the single node left of each group."""
    done = [s.where("size = 1").select("grp", "digest") for s in sweeps[1:]]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def descend(sweeps: list[DataFrame], above: DataFrame, extra: list[str], visit, fields: list[tuple], schema: str) -> DataFrame:
    """Rows that ``visit(extra columns of the leaf, digest, proof, subroot, root)`` makes of each leaf, as proofs travel down.

    above (grp, proof, subroot, root) is the message to each group's top. Sweeps are taken in reverse: messages and the nodes
    of their block meet in one task by a shuffle sorted by label, the task builds the block's tree again and sends the
    proofs on, to the tops of the lower blocks or, in the end, to ``visit``. A proof of a block is sent once, not per leaf.
    """
    message = ["proof", "subroot", "root"]
    passed = [("grp", pa.string()), ("pos", pa.int64()), *[(m, pa.binary()) for m in message]]

    def sweep(own: list[tuple], make):
        def run(batches):
            out = []
            for grp, block, rows in _by_block(batches):
                (kind, _, _, _, above, subroot, root, *_), nodes = rows[0], rows[1:]
                if kind or not nodes or not nodes[0][0]:
                    raise ValueError("a block takes one proof")
                tree = Sweep([n[3] for n in nodes], min(LEVELS, height(nodes[0][2])))
                for k, proof in tree.suffixes(above):
                    out.append(make(grp, block * BLOCK + k, nodes[k], proof, subroot, root))
                    if len(out) >= 4096:
                        yield _table(out, own)
                        out = []
            yield _table(out, own)
            release_memory()

        return run

    def shaped(df: DataFrame, kind: int, kept: list[str]) -> DataFrame:
        types = {"size": "long", "digest": "binary", **dict.fromkeys(message, "binary"), **{e: sweeps[0].schema[e].dataType.simpleString() for e in extra}}
        return df.select("grp", (F.expr(f"pos div {BLOCK}") if kind else F.col("pos")).alias("block"), F.lit(kind).alias("kind"), "pos", *[F.col(c) if c in kept else F.lit(None).cast(t).alias(c) for c, t in types.items()])

    down = None
    for k in reversed(range(len(sweeps) - 1)):
        ended = sweeps[k + 1].where("size = 1").select("grp")  # groups whose top this sweep made
        to = above.join(ended, "grp", "left_semi").select("grp", F.lit(0).cast("long").alias("pos"), *message)
        to = to if down is None else to.unionByName(down)
        nodes = sweeps[k].where("size > 1") if k else sweeps[k]
        met = _dealt(shaped(to, 0, message).unionByName(shaped(nodes, 1, ["size", "digest", *([] if k else extra)])), "kind", "pos")
        if k:
            made = met.mapInArrow(sweep(passed, lambda grp, pos, node, *sent: (grp, pos, *sent)), "grp string, pos long, proof binary, subroot binary, root binary")
            down = materialize(made, "proofs")
    return met.mapInArrow(sweep(fields, lambda grp, pos, node, *sent: visit(node[7:], node[3], *sent)), schema)


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claimed: dict[str, Column] | None = None, proofs: bool = True) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root[, proof]) of each row: digests as hex, the proof as packed steps.

    H is SHA-256 over the inputs joined as text, digests as hex. A leaf is H of its columns, each `-` if null, else the
    UTF-8 byte count, `:`, and the value. Per source, leaves ascend by id; while several nodes are left, each 16 in a row
    (fewer in the last run, even one) become their H; what is left is the subroot. Subroots by source lead to the root
    alike. ``proof`` holds the siblings of each level up to the root, ``proof_sha256`` is H of them from left to right, and
    ``folded_root`` what the siblings make of the row's leaf, or of the leaf with ``claimed`` values where these are given
    for it: ``{column: value}``, and under ``__when`` the condition that a row must meet.

    Time-forward processing: nodes are met in the order of their labels and send their digests to their parents through a
    queue; then a reversed sweep sends the proofs down. The queue's inner part is a heap in the task that works on a block
    of 4,096 nodes, its outer part tables in the shared folder that Spark's external sort orders by label. Sources are
    dealt over blocks, so one that holds any share of the rows is worked on by many tasks.

    Null source: first; null ids: first in their source. Rows that repeat an id ascend by their leaf; equal rows are leaves
    of their own. Null text and other nulls are `-`. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    leaf = leaf_digest([F.col(c) for c in columns])
    other = F.lit(None).cast("binary")
    if claimed:
        other = F.when(claimed["__when"], leaf_digest([claimed.get(c, F.col(c)) for c in columns]))
    # the group of a null source sorts before all others
    grp = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    leaves = materialize(docs.select(grp.alias("grp"), F.col(id_col).alias("id"), leaf.alias("digest"), other.alias("claimed")), "leaves")
    parts = max(spark.sparkContext.defaultParallelism, -(-leaves.count() // (1 << 20)))
    sweeps = climb(numbered_in_groups(leaves, "grp", ["id", "digest"], parts))
    sources = materialize(tops(sweeps).select(F.lit("").alias("grp"), F.col("grp").alias("own"), "digest"), "subroots")
    upper = climb(numbered_in_groups(sources, "grp", ["own"], max(1, -(-sources.count() // (1 << 20)))))
    empty = F.lit(b"")
    top = tops(upper).select("grp", empty.alias("proof"), empty.alias("subroot"), F.col("digest").alias("root"))
    fields = [("grp", pa.string()), ("proof", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())]
    above = materialize(descend(upper, top, ["own"], lambda own, digest, proof, _, root: (own[0], proof, digest, root), fields, "grp string, proof binary, subroot binary, root binary"), "source-proofs")

    kind = leaves.schema["id"].dataType
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    fields = [("id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]), *[(n, pa.string()) for n in names], *([("proof", pa.binary())] if proofs else [])]

    def visit(own, digest, proof, subroot, root):
        row = (own[0], digest.hex(), subroot.hex(), root.hex(), proof_digest(proof).hex(), fold(own[1] or digest, proof).hex())
        return (*row, proof) if proofs else row

    schema = f"id {kind.simpleString()}, " + ", ".join(f"{n} string" for n in names) + (", proof binary" if proofs else "")
    return descend(sweeps, above, ["id", "claimed"], visit, fields, schema).withColumnRenamed("id", id_col)


def op13(docs: DataFrame) -> DataFrame:
    """The manifest of documents; where 5 divides crc32(doc_id), the text that is verified has its A-Z lower-cased."""
    tampered = {"text": F.translate("text", UPPER, LOWER), "__when": F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))}
    out = manifest(docs, claimed=tampered, proofs=False)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
