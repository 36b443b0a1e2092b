"""From band keys to verified links to components, for documents that are near copies of each other.

nodes: one row for each distinct set, (node, n, keys, sketch columns): n is the set's size, keys its band keys.  Nodes
are integers; equal keys make two nodes candidates.  Everything works on rows of nodes, of star edges, or of
shingles; a bucket's members are never brought together, and nothing is capped.

1. Stars: each bucket's smallest node is its centre.  Edges to the other members are verified on full sets.
2. What stars can leave open: two members of a bucket that are linked with each other but with no centre.  Classes are the
   components of all star edges, verified or not, so a bucket lies within one class.  Of a class with several
   verified components, only nodes that share enough shingles with other components can have a link to them; the others
   go, classes are made again from the buckets of those that stay, and so on while that sheds nodes.
3. Those that stay are compared across components in blocks, by exact intersections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, now_and_then, only, staged, steps
from .shingles import sets

#: Ids that are broadcast at most, to pick the texts of candidates; beyond it the texts are shuffled once.
BROADCAST_IDS = 2_000_000
#: Rows and shingles of one block of guests, and of one block of hosts, about (see across).
GUEST_ROWS, GUEST_SHINGLES = 256, 200_000
HOST_ROWS, HOST_SHINGLES = 4096, 1_000_000
#: Edges that one task contracts at most (16 bytes each, some copies of them); more go through rounds over all tasks.
FEW_EDGES = 1_000_000
#: Another round of step 2 follows one that left at most this share of its nodes.
SHEDDING = 0.5


def bands(threshold: float, values: int, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the longest bands that a signature of so many values allows, if a pair at the threshold is to be missed with at most that probability."""
    for rows in range(values, 1, -1):
        if (1 - threshold**rows) ** (values // rows) <= miss:
            return values // rows, rows
    return values, 1


def far_apart(bits: int, threshold: float) -> int:
    """How many of so many one-bit values may differ between sets at the threshold: the mean, and six deviations more.

    A bit of a smallest hash is the same with probability (1 + likeness) / 2; that six deviations are passed has a
    probability of 1e-9.
    """
    p = (1 - threshold) / 2
    return int(bits * p + 6 * (bits * p * (1 - p)) ** 0.5) + 1


def close_sketches(one: list[str], other: list[str], threshold: float) -> Column:
    """Whether two sketches (columns of 64 one-bit values each) are near enough to be worth a check of the whole sets."""
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(one, other)), F.lit(0))
    return apart <= far_apart(64 * len(one), threshold)


def stars(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, from the smallest node of each bucket to each other member, staged.

    The smallest node is the centre in every bucket it is in, so a cluster's members share their edges and
    a cluster of n costs about n edges.
    """
    keys = nodes.select("node", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("key", "a")
    return staged(keys.join(buckets, "key").where("node > a").select("a", F.col("node").alias("b")).distinct(), "star-edges")


def texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the given nodes, staged.  Their ids are broadcast while they number at most BROADCAST_IDS."""
    nodes = staged(nodes.distinct(), "nodes")
    few = nodes.count() <= BROADCAST_IDS
    return staged(texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("node", "text"), "candidate-texts")


def verified(pairs: DataFrame, texts: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """The (a, b) of pairs whose full shingle sets have whole * intersection >= part * union, by texts(node, text).

    Each pair takes its member's text first and the centre's last, so a centre's text isn't copied for each of its
    members.
    """
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for some in steps([batch], "text_b"):
                keep = []
                for text, other in zip(some["text_a"], sets(some["text_b"], size)):
                    text = text.as_py()
                    if text != last:
                        last, own = text, sets(pa.array([text], pa.string()), size)[0]
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(common > 0 and whole * common >= part * (len(own) + len(other) - common))
                yield pa.RecordBatch.from_arrays([some["a"].filter(pa.array(keep)), some["b"].filter(pa.array(keep))], ["a", "b"])

    return both.mapInArrow(check, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge, of staged edges (a, b): the smallest node that it reaches.

    Up to FEW_EDGES edges are contracted in one task.  More: alternating star contraction, each round of which links every
    larger neighbour to the smallest neighbour, then every node's smaller neighbours to its smallest; it ends when the
    edges are stars around the smallest nodes, or few enough for one task.  Rounds grow with the logarithm of the longest chain.
    """
    now = edges.where("a <> b").select("a", "b")
    while now.count() > FEW_EDGES:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: every node b with its smaller neighbours a; they and b go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = staged(large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct(), "small-stars")
        discard(now)
        ends = small.select(F.col("a").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("member")).unionAll(small.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.max("centre").alias("centre"), F.sum("member").alias("member")).where("member > 1 or member = 1 and centre = 1").isEmpty():
            return small.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(small.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        now = small
    return now.coalesce(1).mapInArrow(_contract, "node long, component long")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """components() of few edges: labels go to the smallest of both ends, then each takes its label's label, until nothing changes."""
    parts = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]) for i in (0, 1))
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = number[: len(a)], number[len(a) :]
    label = np.arange(len(nodes))
    while (open_ := label[a] != label[b]).any():
        a, b = a[open_], b[open_]
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], low)
        while (label[label] != label).any():
            label = label[label]
    for at in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 65536]), pa.array(nodes[label[at : at + 65536]])], ["node", "component"])


def classes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, class, component) of the nodes with edges whose class (a component of edges) spans several components of labels, staged."""
    own = components(edges).withColumnRenamed("component", "class").join(labels, "node", "left").select("node", "class", F.coalesce("component", "node").alias("component"))
    mixed = own.groupBy("class").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("class")
    return staged(own.join(mixed, "class", "left_semi"), "open-classes")


def hashes_of(texts: DataFrame, size: int) -> DataFrame:
    """(node, n, hashes) of texts(node, text): the set's size, and its shingles' hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in steps(batches):
            own = sets(some["text"], size)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([some["node"], pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["node", "n", "hashes"])

    return texts.mapInArrow(run, "node long, n long, hashes array<long>")


def sharing(open_: DataFrame, hashes: DataFrame, part: int, whole: int) -> DataFrame:
    """The rows of open_(node, class, component), with n, that can have a link to another component of their class, staged.

    c counts a node's shingles that some other component of its class has too.  A link to a set of n' needs an intersection
    of at least part / (part + whole) * (n + n'), which is at most c, and n' is at least part / whole * n and at
    least the smallest n of the class.  So what this drops has no link; a collision of hashes only raises c.
    """
    own = open_.join(hashes, "node")
    each = own.select("node", "component", "class", F.explode("hashes").alias("h")).select("node", "component", F.xxhash64("class", "h").alias("k"))
    shared = each.groupBy("k").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("k")
    counts = each.select("node", "k").join(shared, "k").groupBy("node").agg(F.count("*").alias("c"))
    least = own.groupBy("class").agg(F.min("n").alias("least"))
    known = open_.join(hashes.select("node", "n"), "node").join(counts, "node").join(least, "class")
    enough = F.col("c") * F.lit((part + whole) * whole) >= F.lit(part) * (F.col("n") * F.lit(whole) + F.greatest(F.col("n") * F.lit(part), F.col("least") * F.lit(whole)))
    return staged(known.where(enough).select("node", "class", "component", "n"), "sharing")


def across(rows: DataFrame, hashes: DataFrame, part: int, whole: int) -> DataFrame:
    """Links (a, b) that join the components of each class of rows(node, class, component, n), by exact intersections.

    Of every two nodes of unlike components one at least is outside the class's largest component: a guest.  Guests are dealt
    to blocks of about GUEST_ROWS, all nodes (as hosts) to blocks of about HOST_ROWS, and each block of guests meets each
    block of hosts, so a group of the result is bounded whatever the class holds.  A meeting returns the links that
    join components, never all pairs.
    """
    each = rows.groupBy("class", "component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    total = each.groupBy("class").agg(F.max(F.struct("m", F.col("component").alias("main"), "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    blocks = lambda m, s, most_rows, most_shingles: F.greatest(F.lit(1), F.ceil(m / most_rows), F.ceil(s / most_shingles)).cast("int")
    total = total.select("class", F.col("top.main").alias("main"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s"), GUEST_ROWS, GUEST_SHINGLES).alias("ps"), blocks(F.col("m"), F.col("s"), HOST_ROWS, HOST_SHINGLES).alias("qs"))
    dealt = staged(rows.join(total, "class").join(hashes.select("node", "hashes"), "node"), "dealt")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    guests = dealt.where("component <> main").withColumn("p", F.pmod(F.xxhash64("node", F.lit(1)), F.col("ps")).cast("int")).withColumn("q", every("qs")).withColumn("guest", F.lit(True))
    hosts = dealt.withColumn("q", F.pmod(F.xxhash64("node", F.lit(2)), F.col("qs")).cast("int")).withColumn("p", every("ps")).withColumn("guest", F.lit(False))

    def link(table: pa.Table) -> pa.Table:
        now_and_then()
        found, of = [], {}

        def root(x: int) -> int:
            while of.setdefault(x, x) != x:
                x = of[x]
            return x

        guest = table["guest"].to_numpy()
        here, there = (table.filter(pa.array(g)).combine_chunks() for g in (guest, ~guest))
        if here.num_rows and there.num_rows:
            flat, ends = (lambda c: (c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()))(there["hashes"].combine_chunks())
            known, number = np.unique(flat, return_inverse=True)
            n, component, nodes = there["n"].to_numpy(), there["component"].to_numpy(), there["node"].to_numpy()
            mark = np.zeros(len(known) + 1, np.int32)
            for own, node, mine in zip(here["hashes"], here["node"].to_pylist(), here["component"].to_pylist()):
                own = own.values.to_numpy()
                at = np.searchsorted(known, own)
                at = at[known[np.minimum(at, len(known) - 1)] == own]
                mark[at] = 1
                common = np.add.reduceat(mark[number], ends[:-1])
                mark[at] = 0
                for i in np.flatnonzero((component != mine) & (common > 0) & (whole * common >= part * (n + len(own) - common))):
                    x, y = root(mine), root(int(component[i]))
                    if x != y:
                        of[max(x, y)] = min(x, y)
                        found.append((min(node, int(nodes[i])), max(node, int(nodes[i]))))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return guests.unionByName(hosts).select("class", "p", "q", "guest", "node", "component", "n", "hashes").groupBy("class", "p", "q").applyInArrow(link, "a long, b long").distinct()


def crossings(nodes: DataFrame, edges: DataFrame, labels: DataFrame, texts: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """Links (a, b) between members of one bucket that the stars left in different components (steps 2 and 3), staged."""
    open_ = classes(edges, labels)
    if open_.isEmpty():
        return open_.select(F.col("node").alias("a"), F.col("class").alias("b"))
    hashes = staged(hashes_of(texts.join(open_.select("node"), "node", "left_semi"), size), "open-sets")
    while True:
        before = open_.count()
        rows = sharing(open_, hashes, part, whole)
        discard(open_)
        again = stars(nodes.join(rows.select("node"), "node", "left_semi"))
        open_ = classes(again, labels)
        discard(again)
        after = open_.count()
        if after == 0 or after > SHEDDING * before:
            break
        discard(rows)
    if after == 0:
        discard(hashes)
        return open_.select(F.col("node").alias("a"), F.col("class").alias("b"))
    rows = open_.join(rows.select("node", "n"), "node")
    found = staged(across(rows, hashes, part, whole), "crossings")
    discard(hashes)
    return found


def linked(nodes: DataFrame, texts: DataFrame, size: int, part: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """Verified edges (a, b) and (node, component) from nodes(node, n, keys, w0, w1, ..: 64 bits of the sketch each) and texts(node, text).

    After steps 1 to 3 no bucket holds an untested pair across components, so components are those of all links; of
    the links within a component only some are among the edges.
    """
    words = [c for c in nodes.columns if c not in ("node", "n", "keys")]
    edges = stars(nodes)
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").cast("long").alias(f"n_{x}"), *[F.col(w).alias(f"{w}_{x}") for w in words])
    fits = F.least("n_a", "n_b") * F.lit(whole) >= F.greatest("n_a", "n_b") * F.lit(part)
    near = close_sketches([f"{w}_a" for w in words], [f"{w}_b" for w in words], part / whole)
    tested = staged(edges.join(side("b"), "b").join(side("a"), "a").where(fits & near).select("a", "b"), "tested")
    texts = texts_of(edges.select(F.explode(F.array("a", "b")).alias("node")), texts)
    links = staged(verified(tested, texts, size, part, whole), "links")
    labels = staged(components(links), "labels")
    more = crossings(nodes, edges, labels, texts, size, part, whole)
    if not more.isEmpty():  # what links across components adds: their components, joined
        joined = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("c"))
        pairs = more.join(joined.select(F.col("node").alias("a"), F.col("c").alias("c_a")), "a").join(joined.select(F.col("node").alias("b"), F.col("c").alias("c_b")), "b")
        merged = staged(components(staged(pairs.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "joined")), "merged")
        known = labels.unionByName(merged.select("node", F.col("node").alias("component"))).distinct()
        labels = staged(known.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        links = links.unionByName(more)
    discard(edges, tested, texts)
    return links, labels


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """(id, first): doc_ids that rows of docs(doc_id, text) with unlike texts share, and the smallest text hash of each; None: no doc_id repeats.

    Texts are read for repeated doc_ids alone, and only if there are any.
    """
    rows = docs.where(F.col("doc_id").isNotNull())
    again = staged(rows.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        return None
    marked = rows.select("doc_id", text_hash().alias("h")).join(again, F.col("doc_id") == F.col("id")).groupBy("id").agg(F.min("h").alias("first"), F.max("h").alias("last"))
    return staged(marked.where("first < last").select("id", "first"), "unlike-texts")


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def classified(docs: DataFrame, signatures: Callable[[DataFrame], DataFrame], size: int, part: int, whole: int) -> DataFrame:
    """doc_id, n_shingles, class_id, own_text, group_id of every row of docs(doc_id, text).

    signatures gives of (node, text): node, n_shingles, content (a hash of the whole set; null: empty set), keys, and the
    sketch's columns w0, w1, ..  Equal sets are one node.  class_id is the smallest doc_id that links reach.  own_text is the
    text's hash where rows with unlike texts share the doc_id, else null; each such text is a document of its own.
    group_id names the class itself: unlike class_id, it differs for two classes whose smallest doc_id is the same.
    """
    table = only(docs, doc_id="long", text="string")
    unlike = repeated_ids(table)
    own_text = F.lit(None).cast("long")
    if unlike is not None:  # further texts of a doc_id are nodes of their own, by a hash that is no doc_id but for chance
        table = table.join(unlike, table["doc_id"] == unlike["id"], "left")
        own_text = F.when(F.col("first").isNotNull(), text_hash())
        table = table.withColumn("node", F.when(own_text > F.col("first"), F.xxhash64(own_text, "doc_id", F.lit("further text"))).otherwise(F.col("doc_id")))
    else:
        table = table.withColumn("node", F.col("doc_id"))
    ids = table.select("node", "doc_id", own_text.alias("own_text")).where("node <> doc_id or own_text is not null").distinct() if unlike is not None else None
    table = table.select("node", "text")
    rows = staged(signatures(table), "signatures")
    sets_of = rows.where(F.col("content").isNotNull() & F.col("node").isNotNull())
    firsts = staged(sets_of.groupBy("content").agg(F.min("node").alias("first")), "contents")
    chosen = sets_of.join(firsts, "content").where("node = first").dropDuplicates(["node"])
    nodes = staged(chosen.select("node", F.col("n_shingles").alias("n"), "keys", *[c for c in rows.columns if c.startswith("w")]), "sets")
    _, labels = linked(nodes, table, size, part, whole)
    discard(nodes)
    mapped = firsts.join(labels, firsts["first"] == labels["node"], "left").select("content", F.coalesce("component", "first").alias("component"))
    mapped = staged(mapped, "classes")
    discard(firsts, labels)
    own = rows.select("node", "n_shingles", "content").join(mapped, "content", "left").withColumn("component", F.coalesce("component", "node")).withColumn("group_id", F.col("component"))
    if ids is None:
        own = own.withColumn("doc_id", F.col("node")).withColumn("own_text", F.lit(None).cast("long"))
    else:  # nodes back to doc_ids; a component's name is its smallest doc_id
        ids = staged(ids, "further-texts")
        own = own.join(ids, "node", "left").withColumn("doc_id", F.coalesce("doc_id", "node"))
        names = own.join(own.join(ids.select("node"), "node", "left_semi").select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("doc_id").alias("name"))
        own = own.join(staged(names, "names"), "component", "left").withColumn("component", F.coalesce("name", "component"))
    return own.select("doc_id", "n_shingles", F.col("component").alias("class_id"), "own_text", "group_id")
