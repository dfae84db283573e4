"""Prefix trie of rebuilt conversations, by fingerprints that compose.

Every conversation is rebuilt from the head of its base conversation and its own turns after that. A sequence of
turns has a fingerprint, the sum of its turns' hashes times rising powers of a base, modulo a prime: a monoid, in
which the fingerprint of two sequences in a row follows from theirs and the first one's length. So every prefix of
a rebuilt conversation gets its fingerprint from two prefixes of original ones and a constant, and no rebuilt
text is ever made. A prefix is named by its depth and fingerprint, and refers to its last turn as that stands in
its original conversation.

Fingerprints only propose what is equal. Texts that share a hash are compared byte by byte, and all members of a
prefix must share the prefix before and the last turn's hash; by induction they are equal then. Should either not
hold, all is done again with other hashes.

A node is called by its smallest conversation. As sets of members shrink with depth, a conversation calls a run of
nodes down to its own end, a chain, or none. Sums over a subtree are therefore sums over the members of its top:
of their chains' weights, and of their chains that end in leaves. The trie's depth needs no rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Modulus of the fingerprints, and how many a prefix has.
PRIME, LANES = 2**31 - 1, 3
#: Bits of the rows, depths or ids of a block; longer runs go in several blocks, which tasks share.
BLOCK_BITS = 12
#: Parts over which the children of one node are dealt.
SALTS = 64
#: Turns of a base conversation that can be a head, at most.
HEAD = 8
#: Trials of hash functions before giving up; one is enough unless hashes of 93 bits collide.
TRIALS = 5
_F, _G, _X = ([f"{c}{k}" for k in range(LANES)] for c in "fgx")
NODE = ["depth", *_F]


def bases(seed: int) -> list[int]:
    """Bases of the fingerprints: powers of a primitive root."""
    return [pow(7, 10_007 * (k + 1) + seed, PRIME) for k in range(LANES)]


def power(base: int, exponent: Column, bits: int) -> Column:
    """``base ** exponent`` modulo the prime, for exponents below ``2 ** bits``."""
    out = F.lit(1).cast("long")
    for k in range(bits):
        out = out * F.when(F.shiftright(exponent, k).bitwiseAND(1) == 1, F.lit(pow(base, 2**k, PRIME))).otherwise(F.lit(1)) % PRIME
    return out


def _small(columns: dict[str, Column]) -> list[Column]:
    return [c.cast("int").alias(n) for n, c in columns.items()]


def hashed(turns: DataFrame, seed: int) -> DataFrame:
    """Turns with their hashes x0, x1, …; none is 0, so a turn always counts."""
    return turns.withColumns({x: (F.pmod(F.xxhash64(F.lit(seed * LANES + k), "role", "text"), F.lit(PRIME - 1)) + 1).cast("int") for k, x in enumerate(_X)})


def prefixes(turns: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """Every turn with its place from 1 and the fingerprints of its conversation up to it (f) and before it (g).

    Turns are range-sorted, so a long conversation lies in many tasks. Blocks of at most ``2 ** BLOCK_BITS`` rows
    are summed by windows, and a block's fingerprint is put after those before it.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "tie", *_X]
    slim = hashed(turns, seed).select("conv_id", "turn", F.xxhash64("role", "text").alias("tie"), *_X, F.octet_length("text").cast("long").alias("n_bytes"))
    rows = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.save(rows.drop("turn", "tie"), "turns").withColumn("block", F.shiftright("row", BLOCK_BITS))
    inside = Window.partitionBy("conv_id", "block").orderBy("row")
    b = bases(seed)
    rows = rows.withColumn("at", F.row_number().over(inside) - 1)
    rows = rows.withColumns({f"y{k}": F.col(x) * power(b[k], F.col("at"), BLOCK_BITS) % PRIME for k, x in enumerate(_X)})
    rows = rows.withColumns({f"s{k}": F.sum(f"y{k}").over(inside) % PRIME for k in range(LANES)})
    totals = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), *(F.sum(f"y{k}").alias(f"t{k}") for k in range(LANES)))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = totals.withColumns({f"p{k}": power(b[k], F.col("first"), 40) for k in range(LANES)})
    totals = totals.withColumns({f"c{k}": F.coalesce(F.sum(F.col(f"t{k}") % PRIME * F.col(f"p{k}") % PRIME).over(before), F.lit(0)) % PRIME for k in range(LANES)})
    joined = rows.join(totals.drop("n", *(f"t{k}" for k in range(LANES))), ["conv_id", "block"])
    whole = {f: (F.col(f"c{k}") + F.col(f"p{k}") * F.col(f"s{k}")) % PRIME for k, f in enumerate(_F)}
    without = {g: (F.col(f"c{k}") + F.col(f"p{k}") * F.pmod(F.col(f"s{k}") - F.col(f"y{k}"), F.lit(PRIME))) % PRIME for k, g in enumerate(_G)}
    return scratch.save(joined.select("conv_id", (F.col("first") + F.col("at") + 1).alias("pos"), *_small(whole | without), *_X, "n_bytes"), "prefixes")


def rebuilt(own: DataFrame, seed: int) -> DataFrame:
    """Every prefix of every rebuilt conversation: conv_id, depth, f, that of the prefix before (g), its last turn and where that stands.

    A conversation's head is the first ``crc32(conv_id) % 9`` turns of conversation ``conv_id - conv_id % 5``, its own
    turns follow after as many. ``ends`` marks a conversation's last prefix; each has one of depth 0.
    """
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    heads = own.where(F.col("pos") <= HEAD)
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1), "base": F.col("conv_id") - F.col("conv_id") % 5})
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    at_base = heads.select(F.col("conv_id").alias("base"), F.col("pos").alias("taken"), *(F.col(f).alias(f"b{k}") for k, f in enumerate(_F)))
    at_own = heads.select("conv_id", F.col("pos").alias("h"), *(F.col(f).alias(f"o{k}") for k, f in enumerate(_F)))
    convs = convs.join(at_base, ["base", "taken"], "left").join(at_own, ["conv_id", "h"], "left").fillna(0, [f"{c}{k}" for c in "bo" for k in range(LANES)])
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    row = ["conv_id", "depth", "length", *_F, *_G, *_X, "n_bytes", "turn_conv_id", "turn_pos"]
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", *(F.lit(0).alias(c) for c in [*_F, *_G, *_X]), F.lit(0).cast("long").alias("n_bytes"), *(F.lit(None).cast("long").alias(c) for c in row[-2:]))
    head = convs.select("conv_id", "base", "taken", "length").join(heads.withColumnRenamed("conv_id", "base"), "base").where("pos <= taken")
    head = head.withColumns({"depth": F.col("pos"), "turn_conv_id": F.col("base"), "turn_pos": F.col("pos")})
    # A long conversation's turns meet its row block by block.
    several = convs.where("n > h").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, BLOCK_BITS))))
    tail = own.withColumn("part", F.shiftright(F.col("pos") - 1, BLOCK_BITS)).join(several, ["conv_id", "part"]).where("pos > h")
    # What the own turns lose as their first h go, and gain as the head comes before them: B ** (taken - h).
    shifts = [F.array(*(F.lit(pow(b, -j, PRIME)) for j in range(HEAD + 1))) for b in bases(seed)]
    moved = lambda c, k: (F.col(f"b{k}") + F.get(shifts[k], F.col("h") - F.col("taken")) * F.pmod(F.col(c).cast("long") - F.col(f"o{k}"), F.lit(PRIME))) % PRIME
    tail = tail.withColumns({"depth": F.col("taken") + F.col("pos") - F.col("h"), "turn_conv_id": F.col("conv_id"), "turn_pos": F.col("pos")} | {c: moved(c, k).cast("int") for cs in (_F, _G) for k, c in enumerate(cs)})
    return root.select(row).unionByName(head.select(row)).unionByName(tail.select(row)).withColumn("ends", F.col("depth") == F.col("length")).drop("length")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come in a row; only one node's digest is open."""
    node, digest, done = None, None, []

    def table() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * (len(NODE) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *[pa.int32()] * LANES, pa.string()], strict=True)], [*NODE, "ends_sha256"])

    for batch in batches:
        pieces = batch.column("piece")
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True)):
            if key != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(pieces[i].as_py().encode())
        yield table()
        done = []
    if node is not None:
        done.append((*node, digest.hexdigest()))
    yield table()


def ends_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids, in order, of the conversations that end at each node that has any.

    Ids are put in order in blocks of ``2 ** BLOCK_BITS`` values; a digest has to run over a node's blocks in a
    row, and does so as they stream by.
    """
    ended = members.where("ends").withColumn("block", F.shiftright("conv_id", BLOCK_BITS))
    pieces = ended.groupBy(*NODE, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    streamed = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "piece")
    return streamed.mapInArrow(_digests, f"depth long, {', '.join(f'{f} int' for f in _F)}, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` has conv_id, turn, role and text. Columns: conv_id (the smallest member), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and turn_conv_id and turn_pos: where the
    node's last turn stands, counted from 1, among the original conversations (null at the root).

    Turns come by number, null first; those of one number by a hash of role and text, so that repeated rows count
    each and no order of the input matters. Null roles and texts are empty ones; rows with a null conv_id belong to
    no conversation and are left out. Remainders are those of SQL, towards 0 for negative ids. Texts and
    conversations of any length count whole. Without conversations there is no node, not even the root. Further
    columns are ignored.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id is not null")
    scratch = Scratch(turns.sparkSession, "trie")
    for seed in range(TRIALS):
        # Equal turns of a task go once; each hash must be left with a single role and text.
        texts = hashed(turns, seed).select(*_X, "role", "text").distinct()
        if not texts.groupBy(*_X).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            continue
        members = scratch.save(rebuilt(prefixes(turns, seed, scratch), seed), "members")
        last = F.struct(*_G, *_X)
        found = members.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min(last).alias("low"), F.max(last).alias("high"),
            F.min(F.struct("turn_conv_id", "turn_pos")).alias("turn"),
        )
        nodes = scratch.save(found.select(*NODE, "conv_id", "n_convs", "n_bytes", "turn", "low", (F.col("low") != F.col("high")).alias("differ")), "nodes")
        if nodes.where("differ").isEmpty():
            return _measured(scratch, members, nodes.select(*NODE, "conv_id", "n_convs", "n_bytes", "turn", *(F.col("low")[g].alias(g) for g in _G)))
    raise ArithmeticError("turns or prefixes that differ share a hash at every trial")


def _measured(scratch: Scratch, members: DataFrame, nodes: DataFrame) -> DataFrame:
    weight = (F.col("n_convs") - 1) * F.col("n_bytes")
    chains = scratch.save(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.sum(weight).alias("weight")), "chains")
    # Tops of chains hang from nodes of other chains. A node's tops are dealt over salts; each salt learns the node's name.
    tops = nodes.join(chains.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).where("depth > 0")
    tops = tops.select("conv_id", "depth", *_G, F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt"))
    above = {g: f for f, g in zip(_F, _G, strict=True)}
    counted = tops.withColumn("depth", F.col("depth") - 1).groupBy("depth", *_G, "salt").agg(F.count("*").alias("n")).withColumnsRenamed(above)
    counted = scratch.save(counted.join(nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE), "counted")
    hung = counted.groupBy(F.col("parent_conv_id").alias("conv_id"), "depth").agg(F.sum("n").alias("hung"))
    parents = tops.join(counted.drop("n").withColumn("depth", F.col("depth") + 1).withColumnsRenamed({f: g for g, f in above.items()}), ["depth", *_G, "salt"]).select("conv_id", "depth", "parent_conv_id", F.lit(True).alias("is_top"))
    # A chain's end is a leaf if nothing hangs from it.
    chains = chains.join(hung.withColumnRenamed("depth", "end"), ["conv_id", "end"], "left").withColumn("leaf", F.col("hung").isNull().cast("long"))
    several = chains.select("conv_id", "weight", "leaf", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("end", BLOCK_BITS))).alias("part"))
    below = members.select("conv_id", *NODE).withColumn("part", F.shiftright("depth", BLOCK_BITS)).join(several, ["conv_id", "part"])
    # A node's smallest member has the chain that the node is on.
    below = below.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("weight").alias("weights"), F.min_by("end", "conv_id").alias("end"))
    out = nodes.join(below, NODE).join(ends_digests(members), NODE, "left")
    out = out.join(hung, ["conv_id", "depth"], "left").join(parents, ["conv_id", "depth"], "left").withColumn("part", F.shiftright("depth", BLOCK_BITS))
    # Weights of a chain above a node belong to no subtree of it: those of its block, and of the blocks before.
    parts = nodes.groupBy("conv_id", F.shiftright("depth", BLOCK_BITS).alias("part")).agg(F.sum(weight).alias("w"))
    upper = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.sum("w").over(upper).alias("upper")).where("upper > 0")
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    out = out.join(parts, ["conv_id", "part"], "left").withColumn("higher", F.coalesce(F.sum(weight).over(inside), F.lit(0)) + F.coalesce("upper", F.lit(0)))
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs",
        ((F.col("depth") < F.col("end")).cast("long") + F.coalesce("hung", F.lit(0))).alias("n_children"), "n_leaves", (F.col("weights") - F.col("higher")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.col("turn.turn_conv_id").alias("turn_conv_id"), F.col("turn.turn_pos").alias("turn_pos"),
    )
