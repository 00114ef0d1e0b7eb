"""Prefix trie of conversations: every distinct sequence of first turns is a node, with counts over its subtree.

Each turn is hashed (role and text, lengths in front), and each conversation's prefixes get chained digests: a prefix's digest is the SHA-256 of
the digest of the prefix before it and the turn's. Prefixes are exploded, one row each, and grouped by (depth, digest) into nodes. A node is
known by its smallest member. For subtree sums nodes go to all their ancestors: of the nodes that have the same smallest member, which follow each other
down one conversation, running sums are taken first, so only one row goes to each ancestor above them. That keeps the
rows linear in the turns, however deep a conversation is.

Scale: texts never leave the first projection; what is shuffled is digests of 32 bytes. A chain is sequential by its meaning: a task
streams through its conversations' turns in order and holds one digest. Nodes, children and sums are aggregates that combine before they shuffle;
a popular prefix meets its conversations in plain joins, which Spark splits where they are skewed. The list of conversations that end at a node
is hashed in order of their ids: runs of it, dealt by ranges of (node, id), become strings of at most RUN bytes, and only those go to the
node's task, which streams them through the hash.

Defined results: null role or text counts as empty; turns are ordered by turn, null first, and of equal turn by the turn's digest. Repeated rows
are turns of their own. Rows without a conversation id are left out. A conversation without turns is a member of the root. Very long texts are
hashed whole, and count by code points. Columns besides those named, whatever their names, are not read. An empty table gives no rows, as
the root then has no member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Bytes of ids that are joined before they go to their node's task.
RUN = 1 << 14
#: Turns of a conversation that are summed together.
PART = 1024
#: The digest of the empty prefix.
ROOT = hashlib.sha256(b"").digest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; with the role's length in front no two turns are spelt alike."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), digest and chars of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("position"), "digest", "chars")


def forked(turns: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Conversations rebuilt as forks: the first h turns of the conversation at the last multiple of `every`, then the own turns after the first h.

    h is the crc32 of the decimal id, modulo most + 1. turns: as numbered() gives them. Every conversation also gets a row at position 0.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = turns.filter("position = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("position") <= most)).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").filter("position <= h").select("conv_id", F.lit(1).alias("part"), "position", "digest", "chars")
    own = turns.withColumn("h", h).filter("position > h").select("conv_id", F.lit(2).alias("part"), "position", "digest", "chars")
    start = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("position"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return start.unionByName(taken).unionByName(own)


def plain(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of forked()."""
    start = turns.filter("position = 1").select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("position"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return start.unionByName(turns.select("conv_id", F.lit(2).alias("part"), "position", "digest", "chars"))


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent, chars, last: a row for each prefix of each conversation, the empty one included."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the prefix before, of which the next row tells whether it is its conversation's last
        for batch in batches:
            out = []
            for conv, digest, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "chars")), strict=True):
                if held is not None and held[0] == conv:
                    out.append((*held, False))
                    held = (conv, held[1] + 1, hashlib.sha256(held[2] + digest).digest(), held[2], chars)
                else:
                    if held is not None:
                        out.append((*held, True))
                    held = (conv, 0, ROOT, None, 0)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*held, True), schema, strict=True)], schema=schema)

    dealt = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "part", "position").select("conv_id", "digest", "chars")
    return dealt.mapInArrow(chain, "conv_id long, depth long, digest binary, parent binary, chars long, last boolean")


def endings(rows: DataFrame) -> DataFrame:
    """rows (digest, conv_id) -> digest, ends_sha256: of the decimal ids in ascending order, joined by commas."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for digest, conv in zip(*(batch.column(c).to_pylist() for c in ("digest", "conv_id")), strict=True):
                if digest != node or size >= RUN:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, first, ids, size = digest, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield _table(out)
        if ids:
            yield _table([(node, first, ",".join(ids))])

    def _table(out: list[tuple]) -> pa.RecordBatch:
        digests, firsts, texts = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["digest", "first", "ids"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashing = None, None
        for batch in batches:
            out = []
            for digest, ids in zip(*(batch.column(c).to_pylist() for c in ("digest", "ids")), strict=True):
                if digest == node:
                    hashing.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, hashing.hexdigest()))
                node, hashing = digest, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict({"digest": [x[0] for x in out], "ends_sha256": [x[1] for x in out]})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"digest": [node], "ends_sha256": [hashing.hexdigest()]})

    ordered = rows.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    joined = ordered.mapInArrow(runs, "digest binary, first long, ids string")
    gathered = joined.repartition("digest").sortWithinPartitions("digest", "first")
    return gathered.select("digest", "ids").mapInArrow(ends, "digest binary, ends_sha256 string")


def tree(rebuilt: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest.

    rebuilt: conversations as forked() or plain() give them. A digest stands for one depth, as it chains all before it.
    """
    rows = cut(prefixes(rebuilt), "trie-prefixes")
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("chars").alias("chars"))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = cut(nodes, "trie-nodes")
    sums = _subtrees(rows, nodes)
    above = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(sums, "digest").join(endings(rows.filter("last")), "digest", "left").join(above, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "digest")


def _subtrees(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """digest, n_leaves, saved_tokens of each node's subtree.

    A conversation is the smallest member of its own nodes, which are its deepest prefixes from some depth on. Sums from a node down to the deepest of them
    are taken along the conversation, in parts of PART nodes; the sum of all goes to each prefix above.
    """
    own = nodes.select("conv_id", "digest", "depth", "leaf", "saved", F.floor(F.col("depth") / PART).alias("part"))
    parts = own.groupBy("conv_id", "part").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    later = parts.select("conv_id", "part", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"later_{c}") for c in ("leaf", "saved")])
    down = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    inside = own.select("conv_id", "part", "digest", *[F.sum(c).over(down).alias(c) for c in ("leaf", "saved")]).join(later, ["conv_id", "part"])
    inside = inside.select("digest", *[(F.col(c) + F.col(f"later_{c}")).alias(c) for c in ("leaf", "saved")])
    totals = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    upward = rows.select("conv_id", "depth", "digest").join(totals, "conv_id").filter("depth < top").select("digest", "leaf", "saved")
    return inside.unionByName(upward).groupBy("digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
