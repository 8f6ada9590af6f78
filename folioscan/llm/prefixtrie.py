"""Prefix trie over conversations that start with turns of another one, by composable fingerprints.

A rebuilt conversation is the head of its base followed by its own later turns. A sequence's fingerprint is an element of a
monoid: the pair (sum of e_i * B^i mod p, length) for turn hashes e_i, where joining two sequences shifts the second sum by a
power of B. So from running sums over the stored turns the fingerprint of every prefix of every rebuilt conversation follows by
one multiplication and one addition: head product times own-suffix product. No rebuilt text is made; three moduli give 93 bits.

Equality is verified, not assumed. Turns of one hash must hold the same role and text, checked over all stored turns; prefixes of one
fingerprint must end in one turn hash and share the fingerprint one turn earlier. Both hold for every group, so by induction
its members are equal turn by turn. Otherwise everything is done again under another seed.

Subtree sums need no walk up the tree. A node belongs to its smallest member. The nodes below a node are those its members own
from its depth on, and only its owner owns any above the place where it leaves the others. So a sum over a subtree is the members'
totals, plus what the owner's running sum from there lacks of its own total."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sequences import running
from .common import materialize

PRIMES = (2147483647, 2147483629, 2147483587)  # below 2^31, so that products fit a long
EACH = range(len(PRIMES))
SPAN = 10  # a block of a conversation is 2^SPAN turn numbers, or depths
IDS = 4096  # conversation ids joined in one piece
SALTS = 1024  # groups that the children of one node are spread over


def bases(seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(1 << 20, p - 1) for p in PRIMES]


def power(m: int, base: int, exponent: Column) -> Column:
    """`base ** exponent` modulo prime m, for exponents below 2^32: one table entry for each byte of the exponent."""
    product, p = None, PRIMES[m]
    for k in range(4):
        step = pow(base, 256 ** k, p)
        table = F.array(*[F.lit(pow(step, i, p)) for i in range(256)]).cast("array<long>")
        digit = F.get(table, F.shiftright(exponent, 8 * k).bitwiseAND(F.lit(255)).cast("int"))
        product = digit if product is None else F.pmod(product * digit, F.lit(p))
    return product


def mod(m: int, value: Column) -> Column:
    return F.pmod(value, F.lit(PRIMES[m]))


def stored_turns(turns: DataFrame, key: str, order: str, role: str, text: str, seed: int) -> DataFrame:
    """`(conv, block, at, role, text, size, e*, l*, b*)`: each turn at its place in its block of turn numbers, its hashes, and the
    sums of its block with and without it. Turns with one number are ordered by role and text."""
    first = -(1 << 62)  # nulls come first
    held = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.coalesce(F.shiftright(F.col(order).cast("long"), SPAN), F.lit(first)).alias("block"), F.col(order).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    along = W.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto, before = along.rowsBetween(W.unboundedPreceding, 0), along.rowsBetween(W.unboundedPreceding, -1)
    base = bases(seed)
    placed = held.withColumn("at", F.row_number().over(along).cast("long"))
    placed = placed.select("*", *[mod(m, F.xxhash64(F.lit(seed * len(PRIMES) + m), "role", "text")).alias(f"e{m}") for m in EACH])
    placed = placed.select("*", *[mod(m, F.col(f"e{m}") * power(m, base[m], F.col("at"))).alias(f"t{m}") for m in EACH])
    sums = [mod(m, F.sum(f"t{m}").over(upto)).alias(f"l{m}") for m in EACH] + [mod(m, F.coalesce(F.sum(f"t{m}").over(before), F.lit(0))).alias(f"b{m}") for m in EACH]
    return placed.select("conv", "block", "at", "role", "text", F.octet_length("text").cast("long").alias("size"), *[f"e{m}" for m in EACH], *sums)


def same_hash_same_turn(stored: DataFrame) -> bool:
    """Whether turns with one hash have one role and text."""
    found = stored.groupBy(*[f"e{m}" for m in EACH]).agg(*[f(c).alias(f"{c}{n}") for c in ("role", "text") for n, f in enumerate((F.min, F.max))])
    return found.where("role0 <> role1 or text0 <> text1").isEmpty()


def block_starts(stored: DataFrame, seed: int) -> DataFrame:
    """`(conv, block, skip, n, s*, w*)`: turns of the conversation before the block, turns in it, their sum and the power it is shifted by."""
    base, along = bases(seed), W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # the last of a block's running sums is that of its last turn
    totals = stored.groupBy("conv", "block").agg(F.count("*").alias("n"), *[F.max(F.struct("at", f"l{m}"))[f"l{m}"].alias(f"l{m}") for m in EACH])
    totals = totals.withColumn("skip", F.coalesce(F.sum("n").over(along), F.lit(0)).cast("long"))
    totals = totals.select("*", *[power(m, base[m], F.col("skip")).alias(f"w{m}") for m in EACH])
    totals = totals.select("*", *[mod(m, F.col(f"l{m}") * F.col(f"w{m}")).alias(f"t{m}") for m in EACH])
    return totals.select("conv", "block", "skip", "n", *[mod(m, F.coalesce(F.sum(f"t{m}").over(along), F.lit(0))).alias(f"s{m}") for m in EACH], *[f"w{m}" for m in EACH])


def prefix_rows(stored: DataFrame, starts: DataFrame, base_of: Column, head_of: Column, most_head: int, seed: int) -> DataFrame:
    """`(conv, depth, length, size, f*, p*, e*)`: every prefix of every rebuilt conversation with its fingerprint, the one a turn earlier,
    and its last turn's hash; depth 0 included. `base_of` and `head_of` are expressions over `conv`."""
    base = bases(seed)
    rows = stored.select("conv", "block", "at", "size", *[f"{c}{m}" for c in "elb" for m in EACH])

    def finished(joined: DataFrame) -> DataFrame:
        g = [mod(m, F.col(f"s{m}") + F.col(f"l{m}") * F.col(f"w{m}")).alias(f"g{m}") for m in EACH]
        q = [mod(m, F.col(f"s{m}") + F.col(f"b{m}") * F.col(f"w{m}")).alias(f"q{m}") for m in EACH]
        return joined.select("*", (F.col("skip") + F.col("at")).alias("pos"), *g, *q)

    fields = ["pos", "size", *[f"{c}{m}" for c in "gqe" for m in EACH]]
    opening = finished(rows.where(F.col("at") <= most_head).join(starts.where(F.col("skip") < most_head), ["conv", "block"])).where(F.col("pos") <= most_head)
    opening = opening.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("opening"))  # at most `most_head` turns
    sizes = starts.groupBy("conv").agg(F.sum("n").cast("long").alias("turns"))
    whole = materialize(sizes.join(opening, "conv"), "openings")
    bases_ = whole.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"), F.col("opening").alias("base_opening"))
    facts = whole.select("conv", "turns", "opening", base_of.alias("base"), head_of.cast("long").alias("head")).join(bases_, "base", "left")
    facts = facts.withColumn("taken", F.least("head", F.coalesce("base_turns", F.lit(0))).cast("long"))
    facts = facts.withColumn("length", F.col("taken") + F.greatest(F.col("turns") - F.col("head"), F.lit(0)))
    sums = lambda column, at, m: F.coalesce(F.get(column, (F.col(at) - 1).cast("int"))[f"g{m}"], F.lit(0))
    back = lambda m: F.get(F.array(*[F.lit(pow(base[m], -i, PRIMES[m])) for i in range(most_head + 1)]).cast("array<long>"), (F.col("head") - F.col("taken")).cast("int"))
    facts = facts.select("*", *[back(m).alias(f"k{m}") for m in EACH])
    facts = facts.select("*", *[mod(m, sums("base_opening", "taken", m) - sums("opening", "head", m) * F.col(f"k{m}")).alias(f"a{m}") for m in EACH])
    facts = materialize(facts.select("conv", "head", "taken", "length", "base_opening", *[f"{c}{m}" for c in "ka" for m in EACH]), "facts")
    shared = facts.where("taken > 0").select("conv", "length", F.explode(F.slice("base_opening", 1, F.col("taken").cast("int"))).alias("o"))
    heads = shared.select("conv", F.col("o.pos").alias("depth"), "length", "o.size", *[F.col(f"o.{c}{m}").alias(f"{n}{m}") for c, n in zip("gqe", "fpe") for m in EACH])
    # facts go to the blocks of a conversation first, so that a long one's turns never meet under its id alone
    own = finished(rows.join(starts.join(facts.drop("base_opening"), "conv"), ["conv", "block"])).where("pos > head")
    moved = lambda c, n: [mod(m, F.col(f"{c}{m}") * F.col(f"k{m}") + F.col(f"a{m}")).alias(f"{n}{m}") for m in EACH]
    own = own.select("conv", (F.col("pos") - F.col("head") + F.col("taken")).alias("depth"), "length", "size", *moved("g", "f"), *moved("q", "p"), *[f"e{m}" for m in EACH])
    zero = [F.lit(0).cast("long").alias(f"{c}{m}") for c in "fpe" for m in EACH]
    tops = facts.select("conv", F.lit(0).cast("long").alias("depth"), "length", F.lit(0).cast("long").alias("size"), *zero)
    return tops.unionByName(heads).unionByName(own)


NODE = ["depth", *[f"f{m}" for m in EACH]]
PARENT = ["depth", *[f"p{m}" for m in EACH]]


def node_rows(prefixes: DataFrame) -> DataFrame:
    """One row for each fingerprint at each depth: `owner` (smallest member), members, what its last turn weighs, and whether its members
    end in one turn hash and were one node a turn earlier."""
    facts = [f"{c}{m}" for c in "pe" for m in EACH]
    found = prefixes.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.count("*").alias("n"), F.max("size").alias("size"), *[F.max(c).alias(c) for c in facts],
                                        *[F.min(c).alias(f"{c}_") for c in facts])
    alike = F.lit(True)
    for c in facts:
        alike = alike & (F.col(c) == F.col(f"{c}_"))
    return found.select(*NODE, "owner", "n", "size", *[f"p{m}" for m in EACH], alike.alias("alike"))


def end_digests(prefixes: DataFrame) -> DataFrame:
    """`NODE` and `ends`: SHA-256 of the ids, ascending and comma-joined, of the members that end at a node. Ids are joined in pieces in
    parallel; the hash itself runs over the pieces in order and holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for *node, ids in zip(*[batch.column(i).to_pylist() for i in (*range(len(NODE)), len(NODE) + 1)]):
                if node != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield out(done)
                done = []
        if now is not None:
            yield out([*done, (*now, digest.hexdigest())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == len(NODE) else pa.int64()) for i, c in enumerate(zip(*rows))], [*NODE, "ends"])

    last = prefixes.where("depth = length").select(*NODE, "conv", F.floor(F.col("conv") / IDS).alias("piece"))
    pieces = last.groupBy(*NODE, "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInArrow(run, ", ".join(f"{c} long" for c in NODE) + ", ends string")


def trie_nodes(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Family and subtree figures of every node."""
    depth_block = F.shiftright("depth", SPAN).alias("span")
    # children, counted in groups that a node with very many is spread over; each group then learns the parent's owner
    salt = F.pmod(F.xxhash64("owner"), F.lit(SALTS)).alias("salt")
    young = nodes.where("depth > 0").select(F.col("depth").alias("at"), F.col("owner").alias("child"), *[F.col(f"f{m}").alias(f"c{m}") for m in EACH],
                                            (F.col("depth") - 1).alias("depth"), *[F.col(f"p{m}").alias(f"f{m}") for m in EACH], salt)
    groups = materialize(young.groupBy(*NODE, "salt").agg(F.count("*").alias("n_children")), "children")
    family = groups.groupBy(*NODE).agg(F.sum("n_children").alias("n_children"))
    aged = materialize(nodes.join(family, NODE, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "aged")
    parents = groups.join(aged.select(*NODE, F.col("owner").alias("parent")), NODE).select(*NODE, "salt", "parent")
    parents = young.join(parents, [*NODE, "salt"]).select(F.col("at").alias("depth"), *[F.col(f"c{m}").alias(f"f{m}") for m in EACH], "parent")
    # what a member owns: bytes saved and its leaf, whole and from each depth on
    saved = aged.select("owner", "depth", *[f"f{m}" for m in EACH], ((F.col("n") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    totals = saved.groupBy("owner").agg(F.sum("saved").alias("total"), F.sum("leaf").alias("leaves"), F.max("depth").alias("deepest"))
    from_here = running(saved.withColumn("up", -F.col("depth")), ["owner"], -F.shiftright("depth", SPAN), ["up"], sums={"below": F.col("saved")})
    spread = totals.where("total > 0 or leaves > 0").select(F.col("owner").alias("conv"), "total", "leaves", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("deepest", SPAN))).alias("span"))
    sums = prefixes.select("conv", *NODE, depth_block).join(spread, ["conv", "span"]).groupBy(*NODE).agg(F.sum("total").alias("members"), F.sum("leaves").alias("n_leaves"))
    own = totals.select("owner", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("deepest", SPAN))).alias("span"))
    lacking = from_here.withColumn("span", F.shiftright("depth", SPAN)).join(own, ["owner", "span"]).select(*NODE, (F.col("below") - F.col("total")).alias("lacking"))
    none = hashlib.sha256(b"").hexdigest()
    found = aged.join(parents, NODE, "left").join(sums, NODE, "left").join(lacking, NODE, "left").join(end_digests(prefixes), NODE, "left")
    zero = F.lit(0).cast("long")
    return found.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
                        F.coalesce("n_leaves", zero).alias("n_leaves"), (F.coalesce("members", zero) + F.coalesce("lacking", zero)).alias("saved_tokens"),
                        F.coalesce("ends", F.lit(none)).alias("ends_sha256"), *[f"f{m}" for m in EACH])


def prefix_trie(turns: DataFrame, base_of: Column, head_of: Column, most_head: int, key: str = "conv_id", order: str = "turn", role: str = "role",
                text: str = "text", seed: int = 11) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`,
    `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`, and the fingerprint `f0`, `f1`, `f2`.

    `base_of` and `head_of` are expressions over the conversation's id, called `conv`: whose first turns it starts with, and how many
    (0 to `most_head`). The conversation's own turns after as many follow.

    Null roles and texts count as empty. Rows without an id belong to no conversation and are left out. Null turn numbers come first;
    equal ones go by role, then text; repeated rows are repeated turns. Other columns are not read. An empty table gives no rows."""
    while True:
        stored = materialize(stored_turns(turns, key, order, role, text, seed), "turns")
        prefixes = materialize(prefix_rows(stored, materialize(block_starts(stored, seed), "starts"), base_of, head_of, most_head, seed), "prefixes")
        nodes = materialize(node_rows(prefixes), "nodes")
        if nodes.where("not alike").isEmpty() and same_hash_same_turn(stored):
            return trie_nodes(prefixes, nodes.drop("alike"))
        seed += 1  # two turns or prefixes share a hash: as good as never
