"""Prefix trie of conversations: what they share from their first turn on.

Every conversation is rebuilt from the first turns of its hundred's first conversation and its own later ones. The digest
of a prefix is the XOR of 128-bit hashes of its turns, each tagged with its place, so digests of all
prefixes are running XORs and a conversation of any length spreads over tasks. One aggregation gives
each digest its smallest member: the node and its owner. A conversation that owns a prefix owns all
longer ones of its own, so its first owned depth is found by binary search, all conversations at
once, by joins with the digests' minima. The last prefix found not owned names the chain's parent.
Owned chains form a forest; their totals go up to all ancestors bottom-up by doubling: a round adds
what the chains 2^i steps below have, so a chain of chains costs its logarithm in rounds. Nodes are
running sums along their chain from its end.

Defined cases: rows without conv_id belong to no conversation and are left out; null roles and texts are empty;
equal turns stand in the order of role, then of the text's MD5, and repeated rows are turns of their
own (rows equal in all of these stay in one range of a shuffle); very long texts count whole;
a conversation without turns is a member of the root and ends there; an empty table gives no node, not even a root.
Only conv_id, turn, role and text are read, so no other column's name can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running
from .store import discard, landed, small_or_shuffled

HUNDRED, HEADS = 100, 6
#: Digests that travel with a conversation in the search; longer ones are searched by chunk ends first.
CHUNK = 64
#: Ids of one block of an end list.
BLOCK_BITS = 12


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, depth, x1, x2, chars) of every rebuilt turn; x1 and x2 are tagged hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.md5(text.cast("binary")).alias("print"), F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("pos")
    )
    thin = landed(thin, "turns")
    ranked = running(thin, "conv_id", ["turn", "role", "print"], {"pos": "sum"})
    discard(thin)
    turns = ranked.select("conv_id", (F.col("pos") - 1).alias("pos"), "role", "print", "chars", head_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"))
    heads = landed(turns.where(F.col("conv_id") == F.col("base")).where(F.col("pos") < HEADS - 1).select("base", "pos", "role", "print", "chars"), "heads")
    given = landed(heads.groupBy("base").agg(F.count("*").alias("given")), "given")
    convs = landed(turns.where("pos = 0").select("conv_id", "h", "base"), "convs")
    own = turns.where("pos >= h").join(small_or_shuffled(given), "base", "left")
    own = own.select("conv_id", (F.least("h", F.coalesce("given", F.lit(0))) + F.col("pos") - F.col("h") + 1).alias("depth"), "role", "print", "chars")
    taken = convs.join(small_or_shuffled(heads), "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "print", "chars")
    tagged = [F.xxhash64(F.lit(seed), "depth", "role", "print").alias(name) for seed, name in ((11, "x1"), (13, "x2"))]
    return convs.select("conv_id"), own.unionByName(taken).select("conv_id", "depth", *tagged, "chars")


def _owner_at(state: DataFrame, minima: DataFrame) -> DataFrame:
    """One round of the search: ``state`` with lo, hi and at moved by who owns the digest (d1, d2) at mid."""
    met = state.join(minima.select("d1", "d2", "owner"), ["d1", "d2"], "left")
    going, owned = F.col("d1").isNotNull(), F.col("owner") == F.col("conv_id")
    return met.withColumns({"hi": F.when(going & owned, F.col("mid")).otherwise(F.col("hi")), "lo": F.when(going & ~owned, F.col("mid")).otherwise(F.col("lo")), "at": F.when(going & ~owned, F.col("owner")).otherwise(F.col("at"))}).drop("d1", "d2", "owner", "mid")


def first_owned(prefixes: DataFrame, minima: DataFrame, least: int | None, chunk: int = CHUNK) -> DataFrame:
    """conv_id, length, since (its first owned depth, length + 1 if none) and at (owner of the prefix before; ``least`` owns the root)."""
    number = F.floor((F.col("depth") - 1) / chunk)
    pieces = prefixes.groupBy("conv_id", number.alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "d1", "d2"))), lambda x: F.struct(x["d1"].alias("d1"), x["d2"].alias("d2"))).alias("digests"))
    pieces = landed(pieces, "pieces")
    length = pieces.groupBy("conv_id").agg(((F.max("chunk") * chunk) + F.max_by(F.size("digests"), "chunk")).alias("length"))
    state = landed(length.select("conv_id", "length", F.lit(0).cast("long").alias("lo"), (F.col("length") + 1).cast("long").alias("hi"), F.lit(least).cast("long").alias("at")), "lengths")
    longest = state.agg(F.max("length")).first()[0] or 0
    lengths = state
    if longest > chunk:
        # in which chunk: lo and hi count chunk ends here, hi one beyond the last full chunk
        last = pieces.where(F.size("digests") == chunk).select("conv_id", F.col("chunk").alias("end"), F.element_at("digests", -1).alias("x")).select("conv_id", (F.col("end") + 1).alias("end"), "x.d1", "x.d2")
        ends = state.withColumn("hi", F.floor(F.col("length") / chunk) + 1)
        for _ in range(math.ceil(math.log2(longest // chunk + 1))):
            asked = ends.withColumn("mid", F.when(F.col("hi") - F.col("lo") > 1, F.floor((F.col("lo") + F.col("hi")) / 2)))
            old, ends = ends, landed(_owner_at(asked.join(last.withColumnRenamed("end", "mid"), ["conv_id", "mid"], "left"), minima), "ends")
            discard(old)
        state = ends.select("conv_id", "length", (F.col("lo") * chunk).alias("lo"), F.least(F.col("hi") * chunk, F.col("length") + 1).alias("hi"), "at")
    state = state.withColumn("chunk", F.floor(F.col("lo") / chunk)).join(pieces, ["conv_id", "chunk"], "left").withColumn("off", F.col("chunk") * chunk)
    for _ in range(math.ceil(math.log2(min(longest, chunk) + 1))):
        mid = F.when(F.col("hi") - F.col("lo") > 1, F.floor((F.col("lo") + F.col("hi")) / 2))
        x = F.when(F.col("mid").isNotNull(), F.get("digests", (F.col("mid") - F.col("off") - 1).cast("int")))
        state = _owner_at(state.withColumn("mid", mid).withColumn("x", x).withColumns({"d1": F.col("x.d1"), "d2": F.col("x.d2")}).drop("x"), minima)
    out = landed(state.select("conv_id", "length", F.col("hi").alias("since"), "at"), "since")
    discard(pieces, lengths, state)
    return out


def chain_totals(chains: DataFrame, columns: list[str]) -> DataFrame:
    """``chains(conv_id, up, *columns)`` with each column summed over a chain and all chains below it; up is null at the top."""
    vals = landed(chains, "chains")
    while not vals.where("up is not null").isEmpty():
        below = vals.where("up is not null")
        add = landed(below.groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"add_{c}") for c in columns]), "add")
        over = vals.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = below.join(over, "up", "left").select("conv_id", F.col("next").alias("up"), *columns)
        moved = moved.unionByName(vals.where("up is null"))
        sums = [(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in columns]
        old, vals = vals, landed(moved.join(add, "conv_id", "left").select("conv_id", "up", *sums), "chains")
        discard(old, add)
    return vals


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    names = ["d1", "d2", "ends_sha256"]
    for batch in batches:
        done = []
        for d1, d2, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (d1, d2) != key:
                if state is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (d1, d2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())]))
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, state.hexdigest()), strict=True))], pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())]))


def end_digests(last: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of ``last(conv_id, d1, d2)``: the hash of the ascending ids that end at a node.

    Ids are joined to texts in blocks of ``2 ** BLOCK_BITS`` consecutive ids first; one task then reads
    a node's blocks in order, since a SHA-256 is sequential, and holds one block at a time.
    """
    blocks = last.groupBy("d1", "d2", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    sorted_blocks = blocks.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "block").select("d1", "d2", "ids")
    return sorted_blocks.mapInArrow(_digests, "d1 long, d2 long, ends_sha256 string")


def trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(conversations)
    least, members = convs.agg(F.min("conv_id"), F.count("*")).first()
    turns = landed(turns, "rebuilt")
    prefixes = running(turns, "conv_id", ["depth"], {"x1": "xor", "x2": "xor"}).withColumnsRenamed({"x1": "d1", "x2": "d2"})
    discard(turns)
    minima = landed(prefixes.groupBy("d1", "d2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("chars").alias("chars")), "minima")
    found = first_owned(prefixes, minima, least, chunk)
    chains = landed(found.where("since <= length"), "owned")
    attached = chains.where("since > 1").select(F.col("at").alias("owner"), (F.col("since") - 1).alias("depth"), "conv_id")
    ends = chains.select(F.col("conv_id").alias("owner"), F.col("length").alias("depth"))
    leaf = ends.join(attached.select("owner", "depth").distinct(), ["owner", "depth"], "left_anti").select(F.col("owner").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    weight = (F.col("n_convs") - 1) * F.col("chars")
    own = minima.groupBy(F.col("owner").alias("conv_id")).agg(F.sum(weight).alias("saved"))
    values = chains.join(own, "conv_id", "left").join(leaf, "conv_id", "left")
    totals = chain_totals(values.select("conv_id", F.when(F.col("since") > 1, F.col("at")).alias("up"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved")), ["leaves", "saved"])
    sums = landed(chains.join(totals.drop("up"), "conv_id").select("at", "since", "leaves", "saved").groupBy(F.col("at").alias("owner"), (F.col("since") - 1).alias("depth")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")), "attached")
    nodes = minima.join(chains.select(F.col("conv_id").alias("owner"), "since", "length", "at"), "owner").join(sums, ["owner", "depth"], "left")
    here = nodes.select(
        F.col("owner").alias("conv_id"), "depth", "d1", "d2", F.when(F.col("depth") > F.col("since"), F.col("owner")).otherwise(F.col("at")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("kids", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
        F.when((F.col("depth") == F.col("length")) & F.col("kids").isNull(), 1).otherwise(F.coalesce("more_leaves", F.lit(0))).cast("long").alias("n_leaves"),
        (weight + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), (-F.col("depth")).alias("back"),
    )
    here = landed(here, "nodes")
    below = running(here, "conv_id", ["back"], {"n_leaves": "sum", "saved_tokens": "sum"}).drop("back")
    kids, leaves, saved = sums.where("depth = 0").agg(F.sum("kids"), F.sum("more_leaves"), F.sum("more_saved")).first()
    counts = {"conv_id": least, "depth": 0, "d1": 0, "d2": 0, "parent_conv_id": None, "n_convs": members, "n_children": kids or 0, "n_leaves": leaves or 1, "saved_tokens": saved or 0}
    root = prefixes.sparkSession.range(1 if members else 0).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()])
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("d1", "d2"), "depth").alias("x"))
    last = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"x.{d}", F.lit(0).cast("long")).alias(d) for d in ("d1", "d2")])
    full = below.unionByName(root).join(landed(end_digests(last), "end_digests"), ["d1", "d2"], "left")
    return full.select(*list(counts)[:2], *list(counts)[4:], F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
