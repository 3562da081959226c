"""Prefix trie of rebuilt conversations by composable monoid fingerprints.

A conversation is a sequence of stored turns (role, text). The fingerprint of a sequence is
an element of a monoid: (value, power) with

    (v, p) * (w, q) = (v q + w, p q)        modulo the prime 2^127 - 1,

one turn with content digest t being (t, base). Fingerprints of the prefixes of every stored
conversation are computed once. A rebuilt conversation, the head of one conversation
followed by a suffix of another, needs no text: the fingerprint of each of its prefixes is
the product of the head's prefix and the suffix's product, and the suffix's product comes
from two stored prefixes of its own conversation, (v_k - v_h p_{k-h}, p_{k-h}).

Prefixes of one length with one fingerprint are a node. Nodes are verified through the
references that every prefix keeps to its last stored turn: all members must name turns of
one content digest and the same parent, so by induction along the depth equal fingerprints
mean equal sequences. Should a node fail, everything is computed again under another base.

The trie's sums over subtrees are found by pointer doubling: after k rounds a node knows the
sum over its descendants less than 2^k below and its 2^k-th ancestor, so the rounds are the
logarithm of the greatest depth.

Scale: turns are sorted by range over (conv_id, turn, role, text), so one conversation may
span partitions; positions and products are computed within a partition and the products of
the partitions, one row each, are multiplied along. Groups by fingerprint are partial sums,
so a turn that opens a third of all conversations costs one row a task. Ids of the
conversations that end at a node are joined to strings of bounded size in sorted order,
and hashed as a stream.

Defined cases: null roles and texts are empty; turns go by turn (null first), then role,
then text; repeated turns are turns of their own; rows without a conv_id belong to no
conversation; a head that does not exist is empty. An empty table gives no rows. Other
columns are not looked at.
"""
from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship_package, written

PRIME = (1 << 127) - 1
_EMPTY = (0, 1)


def product(x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int]:
    """x followed by y."""
    return (x[0] * y[1] + y[0]) % PRIME, x[1] * y[1] % PRIME


def between(whole: tuple[int, int], head: tuple[int, int], power: int) -> tuple[int, int]:
    """What follows ``head`` in ``whole``; ``power``: base to the number of its turns."""
    return (whole[0] - head[0] * power) % PRIME, power


def _pack(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _value(raw: bytes | None) -> int:
    return int.from_bytes(raw, "big") if raw else 0


# ---- stored turns ----------------------------------------------------------------------

def stored_turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, digest, size) in order: content digest of each turn, UTF-8 bytes of its text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    named = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    # the length of the role keeps (role, text) apart
    content = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    keyed = named.select("conv_id", "turn", "role", "text", F.substring("text", 1, 64).alias("opening"),
                         F.unhex(F.substring(content, 1, 32)).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    keyed = keyed.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", "opening")
    return keyed.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "digest", "size")


def _numbered(turns: DataFrame) -> DataFrame:
    """(part, local, conv_id, digest, size): turns with their place in their partition, written once."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def kernel(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(b), pa.int32()), pa.array(range(n, n + len(b)), pa.int64()), *b.columns],
                                             ["part", "local", "conv_id", "digest", "size"])
            n += len(b)
    return written(turns.mapInArrow(kernel, f"part int, local long, conv_id {kind}, digest binary, size long"), "turns")


def prefixes(turns: DataFrame, base: int) -> DataFrame:
    """(conv_id, pos, digest, size, value): position in the conversation and fingerprint of
    the prefix that ends there. ``turns`` is from ``_numbered``."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    sorted_ = turns.repartition("part").sortWithinPartitions("part", "local")

    def ends(batches):
        """Of each partition's last conversation: number of turns, product; and whether it is the only one."""
        part, conv, first, n, x = None, None, None, 0, _EMPTY
        for b in batches:
            for p, c, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if p != part:
                    if part is not None:
                        yield part, conv, conv == first, n, x
                    part, conv, first, n, x = p, c, c, 0, _EMPTY
                elif c != conv:
                    conv, n, x = c, 0, _EMPTY
                n, x = n + 1, product(x, (_value(raw) % PRIME, base))
        if part is not None:
            yield part, conv, conv == first, n, x

    def last(batches):
        rows = [(p, c, only, n, _pack(v), _pack(q)) for p, c, only, n, (v, q) in ends(batches)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), arrow_id, pa.bool_(), pa.int64(), pa.binary(), pa.binary()))],
                                             ["part", "conv_id", "only", "n", "value", "power"])
    arrow_id = to_arrow_type(turns.schema["conv_id"].dataType)
    tails = sorted_.mapInArrow(last, f"part int, conv_id {kind}, only boolean, n long, value binary, power binary").collect()  # one row a partition
    carry, held = {}, (None, 0, _EMPTY)
    for r in sorted(tails, key=lambda r: r["part"]):
        carry[r["part"]] = held  # what the partitions before hold of the conversation that they end with
        x = (_value(r["value"]), _value(r["power"]))
        goes_on = r["only"] and held[0] == r["conv_id"]
        held = (r["conv_id"], held[1] + r["n"], product(held[2], x)) if goes_on else (r["conv_id"], r["n"], x)

    def kernel(batches):
        part, conv, n, x = None, None, 0, _EMPTY
        for b in batches:
            pos, value = [], []
            for p, c, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if p != part:
                    part = p
                    conv, n, x = carry[p]
                if c != conv:
                    conv, n, x = c, 0, _EMPTY
                n, x = n + 1, product(x, (_value(raw) % PRIME, base))
                pos.append(n)
                value.append(_pack(x[0]))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(pos, pa.int64()), b.column(3), b.column(4), pa.array(value, pa.binary())],
                                             ["conv_id", "pos", "digest", "size", "value"])
    return written(sorted_.mapInArrow(kernel, f"conv_id {kind}, pos long, digest binary, size long, value binary"), "prefixes")


# ---- rebuilt conversations ---------------------------------------------------------------

def rebuilt_prefixes(stored: DataFrame, base_of: Column, head_of: Column, base: int) -> tuple[DataFrame, DataFrame]:
    """``base_of``/``head_of``: from conv_id, the conversation whose head is taken and how
    many turns of it. Returns (conv_id, depth, print, above, digest, size, ends) per prefix of a
    rebuilt conversation (``print`` its fingerprint, ``above`` that of one turn less; digest
    and size are of the stored turn it ends with), and (conv_id, length) of each."""
    own = stored.groupBy("conv_id").agg(F.max("pos").alias("n_own"))
    convs = own.select("conv_id", "n_own", base_of.alias("base_id"), head_of.cast("long").alias("h"))
    base_size = own.select(F.col("conv_id").alias("base_id"), F.col("n_own").alias("n_base"))
    convs = convs.join(base_size, "base_id", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("head") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))), "convs")
    at = lambda key, pos, name: stored.select(F.col("conv_id").alias(key), F.col("pos").alias(pos), F.col("value").alias(name))
    # fingerprints that the symbolic products start from: the base's head and the own head
    joints = convs.join(at("base_id", "head", "head_value"), ["base_id", "head"], "left") \
        .join(at("conv_id", "h", "own_value"), ["conv_id", "h"], "left") \
        .select("conv_id", "base_id", "h", "head", "length", "head_value", "own_value")
    joints = written(joints, "joints")
    longest = joints.agg(F.max("head")).first()[0] or 0
    from_base = joints.select(F.col("conv_id").alias("member"), F.col("base_id").alias("conv_id"), "head", "length") \
        .join(stored.where(F.col("pos") <= longest), "conv_id").where("pos <= head").select(F.col("member").alias("conv_id"), F.col("pos").alias("depth"), "length", "digest", "size", "value",
                                     *[F.lit(None).cast("binary").alias(c) for c in ("head_value", "own_value")], F.lit(0).cast("long").alias("after"))
    from_own = joints.join(stored, "conv_id").where("pos > h").select(
        "conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "length", "digest", "size", "value",
        "head_value", "own_value", (F.col("pos") - F.col("h")).alias("after"))
    kind = stored.schema["conv_id"].dataType.simpleString()

    def kernel(batches):
        inverse = pow(base, -1, PRIME)
        for b in batches:
            prints, above = [], []
            for raw, digest, head, mine, after in zip(*(b.column(i).to_pylist() for i in (5, 3, 6, 7, 8))):
                if after:
                    power = pow(base, after, PRIME)
                    suffix = between((_value(raw), 0), (_value(mine), 0), power)
                    v, _ = product((_value(head), 1), suffix)
                else:
                    v = _value(raw)
                prints.append(_pack(v))
                above.append(_pack((v - _value(digest)) * inverse % PRIME))
            done = [d == n for d, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.binary()), pa.array(above, pa.binary()), b.column(3), b.column(4), pa.array(done)],
                                             ["conv_id", "depth", "print", "above", "digest", "size", "ends"])
    members = from_base.unionByName(from_own).mapInArrow(
        kernel, f"conv_id {kind}, depth long, print binary, above binary, digest binary, size long, ends boolean")
    return written(members, "members"), convs.select("conv_id", "length")


# ---- nodes ---------------------------------------------------------------------------------

def _ends_hashes(ends: DataFrame, most: int = 4096) -> DataFrame:
    """(node, depth, ends_sha256) of ``ends`` (node, depth, conv_id), ids ascending."""
    kind = ends.schema["node"].dataType.simpleString()
    dealt = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")

    def chunks(batches):
        """(node, depth, first id, ids as text), at most ``most`` ids a row."""
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            out = []
            for (node, depth), group in itertools.groupby(rows, key=lambda r: r[:2]):
                ids = [r[2] for r in group]
                out += [(node, depth, ids[i], ",".join(map(str, ids[i:i + most]))) for i in range(0, len(ids), most)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((b.schema[0].type, pa.int64(), b.schema[2].type, pa.string()))],
                                             ["node", "depth", "first", "ids"])

    def stream(batches):
        at, sha, done = None, None, []
        for b in batches:
            for node, depth, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (node, depth) != at:
                    if at:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (node, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield out(done, b.schema[0].type)
                done = []
        if at:
            yield out([(*at, sha.hexdigest())], b.schema[0].type)

    def out(rows, id_type):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (id_type, pa.int64(), pa.string()))], ["node", "depth", "ends_sha256"])

    parts = written(dealt.mapInArrow(chunks, f"node {kind}, depth long, first {kind}, ids string"), "ends")
    return parts.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(stream, f"node {kind}, depth long, ends_sha256 string")


def _nodes(members: DataFrame) -> DataFrame:
    """One row per (depth, print) with its smallest member, size and verified parent."""
    return written(members.groupBy("depth", "print").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.max("above").alias("above"),
        (F.min("digest") != F.max("digest")).alias("clash"), (F.min("above") != F.max("above")).alias("torn")), "nodes")


def _subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """``nodes`` (conv_id, depth, parent, leaves, saved) with both sums over their subtrees."""
    state = nodes.select("conv_id", "depth", F.col("parent").alias("up"), "leaves", "saved")
    step = 1
    while step <= deepest:
        gain = written(state.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth"))
                       .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")), "gain")
        farther = state.select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        state = written(state.join(gain, ["conv_id", "depth"], "left").join(farther, ["up", "depth"], "left").select(
            "conv_id", "depth", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "sums")
        step *= 2
    return state.select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(rows: DataFrame, base_of: Column | None = None, head_of: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text", seed: int = 1) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``base_of`` and ``head_of`` are columns over conv_id; without them every conversation is
    its own head, and the trie is that of the stored conversations.
    """
    ship_package(rows.sparkSession)
    turns = _numbered(stored_turns(rows, conv_col, turn_col, role_col, text_col))
    c = F.col("conv_id")
    base_of, head_of = c if base_of is None else base_of, F.lit(0) if head_of is None else head_of
    while True:
        base = int.from_bytes(hashlib.sha256(f"base {seed}".encode()).digest()[:15], "big") | 1
        stored = prefixes(turns, base)
        members, convs = rebuilt_prefixes(stored, base_of, head_of, base)
        nodes = _nodes(members)
        if not nodes.where("clash or torn").limit(1).count():
            break
        seed += 1  # two sequences share a fingerprint: another base
    # parents: the node whose print is `above`; the textless root stands above depth 1
    upper = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("above"), F.col("conv_id").alias("parent"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("conv_id is not null")
    root = top.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("above"))
    smallest = top.first()
    root_id = F.lit(smallest["conv_id"] if smallest else None).cast(convs.schema["conv_id"].dataType)
    both = nodes.select("conv_id", "depth", "n_convs", "size", "above").unionByName(root).join(upper, ["depth", "above"], "left")
    both = written(both.select("conv_id", "depth", "n_convs", "size", F.when(F.col("depth") == 1, root_id).otherwise(F.col("parent")).alias("parent")), "tree")
    children = both.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    full = written(both.join(children, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), "full")
    deepest = full.agg(F.max("depth")).first()[0] or 0
    sums = _subtree_sums(full, deepest)
    named = nodes.select("depth", "print", F.col("conv_id").alias("node"))
    ends = members.where("ends").join(named, ["depth", "print"]).select("node", "depth", "conv_id")
    bare = convs.where("length = 0").select(root_id.alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id")
    hashes = _ends_hashes(written(ends.unionByName(bare), "members-ending")).withColumnRenamed("node", "conv_id")
    return full.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children") \
        .join(sums, ["conv_id", "depth"]).join(hashes, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
