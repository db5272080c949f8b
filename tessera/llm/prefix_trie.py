"""The trie of all conversations' prefixes, by prefix doubling.

Each different turn gets a number, then each different pair of neighbouring blocks of 1, 2, 4 ... turns, so that after as many rounds as the
longest conversation has binary digits a block of any power of two is named by one number. A prefix of d turns is composed by the binary
digits of d: of the prefix without its last digit, and the block that this digit stands for. Prefixes are named in the order of their last
digit, largest first, each of them once, so all rounds together move each turn a few times, whatever the length of its conversation.

A node is a group of equal names and lengths. What a node says of its subtree is a sum over its members' own rows, and no walk: the least
member of a node is the least of every deeper node it reaches, so each conversation owns the nodes from some depth on to its end, and every
node has one owner. What follows a row within its conversation, and what it owns of that, are differences of running totals.

Turns are known by the SHA-256 of role and text after the first read. The conversations that end at a node are written as lines of ids by
ranges, and hashed in one stream of lines, as SHA-256 has to be read in order; a line has a bounded number of ids.

Defined results: rows without a conversation are left out; a null turn comes first, equal turns are ordered by role and the digest of their
text, repeated rows are turns each; a null role or text is empty; other columns are ignored. No conversation: no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, running_totals, stored

#: Ids in a line that is hashed at once.
LINE_IDS = 4096

LINES = pa.schema([("depth", pa.int64()), ("rep", pa.int64()), ("first", pa.int64()), ("line", pa.binary())])
ENDS = pa.schema([("depth", pa.int64()), ("rep", pa.int64()), ("ends_sha256", pa.string())])


def crc32_of(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The different keys of df, with consecutive numbers as `name`. The partitions' sizes alone reach the driver."""
    place = df.select(*keys).distinct().select(*keys, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i"))
    placed = stored(place, name)
    base, rows = 0, []
    for part, count in sorted(placed.groupBy("_part").count().collect()):
        rows.append((part, base))
        base += count
    bases = F.broadcast(df.sparkSession.createDataFrame(rows or [(0, 0)], "_part int, _base long"))
    return placed.join(bases, "_part").select(*keys, (F.col("_i") + F.col("_base")).alias(name))


def turns_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, i, digest, len): the turns in order, i from 1; and (conv, turns, head): each conversation with its number of turns, and h."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.when(F.col("turn").isNull(), 0).otherwise(1).alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("len"), F.monotonically_increasing_id().alias("row"), F.lit(1).cast("long").alias("one"),
    ).filter("conv is not null")
    placed = running_totals(rows, ["conv", "known", "turn", "role", "digest", "row"], ["one"], "conversation-turns")
    placed = stored(placed.select("conv", "digest", "len", F.col("before_one").alias("at")), "turns")
    convs = placed.groupBy("conv").agg(F.min("at").alias("base"), F.count("*").alias("turns"))
    convs = stored(convs.select("conv", "base", "turns", (crc32_of("conv") % 6).alias("head")), "conversations")
    return placed.join(convs.select("conv", "base"), "conv").select("conv", (F.col("at") - F.col("base") + 1).alias("i"), "digest", "len"), convs


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, d, digest, len): the first h turns of conversation c - c % 100, then the own ones after the first h; d counts from 1."""
    whole = convs.select("conv", "turns", "head", (F.col("conv") - F.col("conv") % 100).alias("giver"))
    gives = turns.filter("conv % 100 = 0 and i <= 5").groupBy(F.col("conv").alias("giver")).agg(F.collect_list(F.struct("i", "digest", "len")).alias("given"))
    whole = stored(whole.join(gives, "giver", "left").select("conv", "head", F.expr("filter(given, x -> x.i <= head)").alias("given")), "conversation-heads")
    heads = whole.select("conv", F.explode("given").alias("x")).select("conv", F.col("x.i").alias("d"), "x.digest", "x.len")
    own = turns.join(whole.select("conv", "head", F.when(F.col("given").isNull(), 0).otherwise(F.size("given")).alias("before")), "conv").filter("i > head")
    return heads.unionByName(own.select("conv", (F.col("i") - F.col("head") + F.col("before")).alias("d"), "digest", "len"))


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv, d, name): equal names of a d are equal sequences of the first d turns. turns: (conv, d, digest), d from 1 without gaps."""
    longest = turns.agg(F.max("d")).first()[0] or 0
    named = turns.join(numbered(turns, ["digest"], "name"), "digest")
    blocks = [stored(named.select("conv", (F.col("d") - 1).alias("i"), "name"), "blocks-0")]
    for j in range(1, longest.bit_length()):
        side = lambda s: F.max(F.when(F.col("i") % 2 == s, F.col("name")))
        pairs = blocks[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(side(0).alias("a"), side(1).alias("b")).filter("b is not null")
        pairs = stored(pairs, f"pairs-{j}")
        names = numbered(pairs, ["a", "b"], "name")
        blocks.append(stored(pairs.join(names, ["a", "b"]).select("conv", "i", "name"), f"blocks-{j}"))
    done = None
    for j in reversed(range(len(blocks))):
        even = blocks[j].filter("i % 2 = 0").select("conv", (F.col("i") * (1 << j)).alias("before"), F.col("name").alias("b"))  # ends a prefix of before + 2^j turns
        here = even.filter("before = 0").select("conv", F.lit(1 << j).cast("long").alias("d"), F.col("b").alias("name"))
        if done is not None:
            joint = even.join(done.select("conv", F.col("d").alias("before"), F.col("name").alias("a")), ["conv", "before"])
            joint = stored(joint.select("conv", (F.col("before") + (1 << j)).alias("d"), "a", "b"), f"prefixes-{j}")
            names = numbered(joint, ["d", "a", "b"], "name")
            here = stored(here.unionByName(joint.join(names, ["d", "a", "b"]).select("conv", "d", "name")), f"prefix-names-{j}")
        done = here if done is None else done.unionByName(here)
    return done


def lines(batches):
    """Rows (depth, rep, conv), sorted: lines of the ids that follow each other under a node."""
    for b in batches:
        depth, rep, conv = (b.column(c).to_numpy() for c in ("depth", "rep", "conv"))
        if not len(conv):
            continue
        cut = np.flatnonzero((np.diff(depth) != 0) | (np.diff(rep) != 0)) + 1
        at = np.union1d(np.concatenate([[0], cut]), np.arange(0, len(conv), LINE_IDS))
        text = conv.astype("U20").tolist()
        line = [",".join(text[s:e]).encode() for s, e in zip(at, np.append(at[1:], len(conv)))]
        yield batch(LINES, depth=depth[at], rep=rep[at], first=conv[at], line=line)


def streamed(batches):
    """SHA-256 of the lines of each node, which come in order and without a gap between them."""
    now, state = None, None
    for b in batches:
        out = []
        for *node, line in zip(b.column("depth").to_pylist(), b.column("rep").to_pylist(), b.column("line").to_pylist()):
            if node != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(line)
            else:
                state.update(b"," + line)
        if out:
            yield batch(ENDS, **dict(zip(ENDS.names, map(list, zip(*out)))))
    if now is not None:
        yield batch(ENDS, depth=[now[0]], rep=[now[1]], ends_sha256=[state.hexdigest()])


def ends(ending: DataFrame) -> DataFrame:
    """(depth, rep, ends_sha256) of the nodes where conversations end."""
    node = ["depth", "rep"]
    n = int(ending.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ending.select("depth", "rep", "conv").repartitionByRange(n, *node, "conv").sortWithinPartitions(*node, "conv")
    written = stored(ranged.mapInArrow(lines, "depth long, rep long, first long, line binary"), "ends")
    ordered = written.repartition(n, *node).sortWithinPartitions(*node, "first")
    return ordered.mapInArrow(streamed, "depth long, rep long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = turns_of(conversations)
    built = stored(rebuilt(turns, convs), "rebuilt")
    named = prefix_names(built.select("conv", "d", "digest"))
    roots = convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"))
    names = stored(named.unionByName(roots), "prefix-names")
    owner = names.groupBy("d", "name").agg(F.min("conv").alias("rep"))
    lengths = built.select("conv", "d", "len").unionByName(convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("len")))
    rows = stored(names.join(owner, ["d", "name"]).select("conv", "d", "rep").join(lengths, ["conv", "d"]), "trie-rows")
    # per row: what stands before it in its conversation, from which what follows it is a difference
    before = stored(running_totals(rows, ["conv", "d"], ["len"], "trie-order").select("conv", "d", "rep", "len", F.col("before_len").alias("before")), "trie-totals")
    own = F.col("rep") == F.col("conv")
    ends_at = F.max(F.struct("d", "before", "len", "rep")).alias("end")
    each = before.groupBy("conv").agg(ends_at, F.min(F.when(own, F.struct("d", "before"))).alias("own"))
    each = each.select("conv", F.col("end.d").alias("last"), (F.col("end.before") + F.col("end.len")).alias("all"), F.col("end.rep").alias("end_rep"), F.col("own.d").alias("own"), F.col("own.before").alias("own_before"))
    # a node that someone owns one turn deeper, from which on or before which he owns, has a child; ends without one are leaves
    wide = stored(before.join(each, "conv"), "trie-wide")
    parent = wide.filter("d = own - 1 and d >= 0").select(F.col("d").alias("d"), F.col("conv").alias("child"), F.col("rep").alias("parent"))
    grown = wide.filter("own <= d + 1 and d < last").select("d", "rep").groupBy("d", "rep").agg(F.count("*").alias("n_children"))
    leaf = wide.filter("d = last and rep = conv").join(grown, ["d", "rep"], "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    owned_before = F.when(F.col("d") >= F.col("own"), F.col("before")).otherwise(F.col("own_before"))
    owned = F.when(F.col("own").isNull(), 0).otherwise(F.col("all") - owned_before)
    summed = wide.join(leaf, "conv", "left").groupBy("d", "rep").agg(
        F.count("*").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(F.col("all") - F.col("before") - owned).cast("long").alias("saved_tokens"),
    )
    nodes = summed.join(grown, ["d", "rep"], "left").join(parent, (summed.d == parent.d + 1) & (summed.rep == parent.child), "left").select(
        summed.rep.alias("conv_id"), summed.d.alias("depth"), F.when(summed.d > 0, F.coalesce("parent", summed.rep)).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
    )
    ending = wide.filter("d = last").select(F.col("d").alias("depth"), "rep", "conv")
    digests = ends(ending).select(F.col("rep").alias("conv_id"), "depth", "ends_sha256")
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
