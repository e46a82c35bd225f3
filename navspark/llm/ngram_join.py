"""Near duplicates by Jaccard similarity of word n-gram sets: a size-aware heavy-light join.

A text's set is its distinct shingles of four words, or as many as given (A-Z in lower case); a text of
fewer words has its whole sequence as one. Equal sets are one entity, so copies cost nothing. Sets of n and m members link if
they share c(n, m) = ceil(t/(1+t) * (n+m)) members. Sets are handled by size:

- Small sets enumerate their subsets of each size c that a link can need. Two that share a subset of
  c(n, m) members link, and in a group with one subset of size c every link goes through its smallest
  set; so groups give stars, which need no check.
- Large sets are scanned through inverted lists. A set lists a prefix of its members in hash order,
  so long that two linked sets have many listed members in common. Each set leaves out its longest
  lists, of those with more than HEAVY sets, as many as it can spare: lists are left out in one order
  for all, so what a pair loses is at most what one of both leaves out, and a link always shows.
- The border between both is the one with the lowest cost for the corpus's sizes.

Near copies are settled before the lists are scanned. Sets that share two or more of eight triples
of small hashes with a central set form clusters. A cluster is cut into slices; all sets of a slice,
and the cluster's central one, are compared; the sets that are then not in the cluster's largest
component are compared with all others of the cluster, slice by slice. So a cluster needs no pair
of sets that are connected already, and its members travel a few times instead of once for each
pair. Lists then only pair sets of different clusters, and only if their bit maps agree: a set's map has
a bit for each class of its members, set if their number is odd, so two sets differ in at least as
many members as their maps in bits, and no link is lost. A pair that shares enough listed members is
checked on the whole sets. Members come from the texts of the sets in question, found through a bit
filter of fixed size.

Null, empty and wordless texts have the empty set, link to nothing and are their own component.

Repeated rows share a set; rows of one key with unlike texts each have their own, and their key counts for
the least of each. Ties between sets are broken by their hash, which changes no component. A very long text is
a step of its own. An empty table gives no rows; other columns aren't read, but for those carried.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navspark.llm.components import Scratch, components
from navspark.llm.text import LOWER, frugal, give_back, identified, mixed, rolling, ship, steps, texts_of, word_hashes, words_of

SHINGLE = 4
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 85, 100
#: Sets on one list from which it counts as heavy, and the share of members listed besides the needed.
HEAVY = 16
EXTRA = (3, 20)
#: The border lies at most here; the cost of a listed member in terms of an enumerated subset.
LARGEST_SMALL, LIST_COST = 24, 6
TRIPLE, TRIPLES = 3, 8
#: Equal triples that put a set into the cluster of a central one, and sets in a slice of a cluster.
VOTES, SLICE = 2, 400
FILTER_BITS = 1 << 26
#: Bits in the map of a set: as many as members, to the next power of two, within these.
LEAST_BITS, MOST_BITS = 64, 1024


class Threshold:
    """Words of a shingle, and sizes, overlaps and prefixes that a similarity needs."""

    def __init__(self, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, shingle: int = SHINGLE):
        self.a, self.b, self.shingle = numerator, denominator, shingle

    def overlap(self, n: int, m: int) -> int:
        return -(-self.a * (n + m) // (self.a + self.b))

    def sizes(self, n: int) -> range:
        """Sizes that a set of n can link with."""
        return range(-(-self.a * n // self.b), self.b * n // self.a + 1)

    def prefix(self, n):
        """Listed members of a set of n (number or array)."""
        low = -(-self.a * n // self.b)
        return np.minimum(n, n - -(-self.a * (n + low) // (self.a + self.b)) + 1 + EXTRA[0] * n // EXTRA[1])

    def subset_sizes(self, n: int, border: int) -> list[int]:
        return sorted({self.overlap(n, m) for m in self.sizes(n) if m <= border})

    def subsets(self, n: int, border: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n, border))

    def sql_overlap(self, n: Column, m: Column) -> Column:
        return F.ceil((n + m) * F.lit(self.a) / F.lit(self.a + self.b) - 1e-9)

    def sql_prefix(self, n: Column) -> Column:
        low = F.ceil(n * self.a / self.b - 1e-9)
        return F.least(n.cast("long"), n - F.ceil((n + low) * self.a / (self.a + self.b) - 1e-9) + 1 + F.floor(EXTRA[0] * n / EXTRA[1]))

    def sql_spare(self, n: Column) -> Column:
        """Lists that a set of n can leave out: all that it has in common with any partner but one.

        With a partner of m members a link shares at least prefix(n) - n + overlap(n, m) lists, least
        for the smallest m, and prefix(m) - m + overlap(n, m): 1 + EXTRA * n, but for what rounding takes.
        """
        return F.floor(EXTRA[0] * F.greatest(n - 2, F.lit(0)) / EXTRA[1])

    def border(self, counts: dict[int, int]) -> int:
        """The cheapest border; counts: sets by size."""
        best, cost_of = 0, None
        for border in range(LARGEST_SMALL + 1):
            cost = 0
            for n, k in counts.items():
                if n <= border:
                    cost += k * self.subsets(n, border)
                if n > border or self.b * n // self.a > border:
                    cost += k * int(self.prefix(n)) * LIST_COST
            if cost_of is None or cost < cost_of:
                best, cost_of = border, cost
        return best


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin."""
    data, offs = texts_of(column)
    data = LOWER[data]
    starts, ends, first = words_of(data, offs)
    words = word_hashes(data, starts, ends)
    rows, count = len(offs) - 1, np.diff(first)
    row_of = np.repeat(np.arange(rows), count)
    hashes = rolling(words, size)
    whole = row_of[: len(hashes)] == row_of[size - 1 :] if len(hashes) else np.empty(0, bool)
    short = np.flatnonzero((count > 0) & (count < size))
    few = [rolling(words[first[r] : first[r + 1]], count[r])[0] + np.uint64(count[r]) for r in short]
    values = np.concatenate([hashes[whole], np.array(few, np.uint64)])
    owner = np.concatenate([row_of[: len(hashes)][whole], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))[: len(values)]
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(rows + 1))


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each set; 0 for the empty one."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(bounds[:-1] < bounds[1:])
    if len(full):
        out[full] = mixed(np.add.reduceat(mixed(values), bounds[:-1][full]) + np.diff(bounds)[full].astype(np.uint64))
    return out.view(np.int64)


def _distinct_sets(column: pa.Array, shingle: int):
    """Sets of a slice, each once: id, size, start and end of its members in `values`."""
    values, bounds = shingle_sets(column, shingle)
    ids, place = np.unique(set_ids(values, bounds), return_index=True)
    size = np.diff(bounds)[place]
    keep = size > 0
    place = place[keep]
    return values, ids[keep], size[keep], bounds[:-1][place]


def _map(frame: DataFrame, make, ddl: str) -> DataFrame:
    """`make(slice)` gives the columns named in `ddl`."""
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in make(part)], names=names)

    return frame.mapInArrow(frugal(run), ddl)


def sets_of(frame: DataFrame, shingle: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Of every document: doc_id, carried columns, set, n, the set's triples, its members if they are few, and its bit map."""

    def make(part):
        values, bounds = shingle_sets(part.column(1), shingle)
        size = np.diff(bounds)
        row = np.repeat(np.arange(len(size)), size)
        sig, owner = _triples(values, row)
        few = size[row] <= LARGEST_SMALL
        lists = lambda flat, own: pa.ListArray.from_arrays(
            pa.array(np.searchsorted(own, np.arange(len(size) + 1)), pa.int32()), pa.array(flat.view(np.int64))
        )
        more = [part.column(2 + i) for i in range(len(carried))]
        return part.column(0), *more, set_ids(values, bounds), size, lists(sig, owner), lists(values[few], row[few]), bit_maps(values, row, size)

    own = "".join(f"{c} {frame.schema[c].dataType.simpleString()}, " for c in ("doc_id", *carried))
    return _map(frame, make, f"{own}set long, n long, triples array<long>, few array<long>, bits binary")


def _triples(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the three smallest members of each of eight classes of members, and their rows."""
    member = mixed(values ^ np.uint64(0x5851F42D4C957F2D))
    group = row * TRIPLES + (member % np.uint64(TRIPLES)).astype(np.int64)
    order = np.lexsort((member, group))
    member, group = member[order], group[order]
    opens = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    ends = np.append(opens[1:], len(group))
    sig = mixed(group[opens].astype(np.uint64) % np.uint64(TRIPLES) + np.uint64(1))
    for k in range(TRIPLE):
        there = opens + k < ends
        sig[there] = mixed(sig[there] + member[opens[there] + k])
    return sig, group[opens] // TRIPLES


def bit_maps(values: np.ndarray, row: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each set a bit for each class of members, set if their number is odd."""
    width = np.int64(1) << np.ceil(np.log2(np.clip(size, LEAST_BITS, MOST_BITS))).astype(np.int64)
    first = np.append(0, np.cumsum(width))
    place = (mixed(values ^ np.uint64(0x9FB21C651E98DF25)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(first[row] + place, minlength=first[-1]) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little")
    ends = (first // 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


class _BitMaps:
    """The maps of a bucket's sets, in every width that two of them are compared in."""

    def __init__(self, bits: pa.Array):
        data = bits.to_pylist()
        flat = np.frombuffer(b"".join(data), np.uint64)
        self.words = np.array([len(d) // 8 for d in data], np.int64)
        first = np.cumsum(self.words) - self.words
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(self.words).tolist():
            place, folded, n = np.zeros(len(data), np.int64), [], 0
            for words in np.unique(self.words[self.words >= width]).tolist():
                # A member's class in fewer bits is its class modulo their number.
                own = np.flatnonzero(self.words == words)
                maps = flat[first[own][:, None] + np.arange(words)].reshape(len(own), words // width, width)
                folded.append(np.bitwise_xor.reduce(maps, axis=1))
                place[own] = np.arange(n, n + len(own))
                n += len(own)
            self.maps[width] = place, np.concatenate(folded)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Members in which each pair of sets differs at least."""
        out = np.zeros(len(x), np.int64)
        width = np.minimum(self.words[x], self.words[y])
        for w in np.unique(width).tolist():
            place, maps = self.maps[w]
            own, lot = np.flatnonzero(width == w), max(1, (1 << 20) // w)
            for at in range(0, len(own), lot):
                some = own[at : at + lot]
                out[some] = np.bitwise_count(maps[place[x[some]]] ^ maps[place[y[some]]]).sum(axis=1)
        return out


def _small_rows(sets: DataFrame, t: Threshold, border: int) -> DataFrame:
    """sig, set, n, c: the needed subsets of the sets up to the border, from their members in `few`."""
    picks = {
        n: [(c, np.array(list(combinations(range(n), c)), np.int64)) for c in t.subset_sizes(n, border)]
        for n in range(1, border + 1)
    }

    def run(batches):
        for batch in batches:
            size = batch.column(1).to_numpy()
            for n in np.unique(size).tolist():
                own = batch.filter(pa.array(size == n))
                members = mixed(np.asarray(own.column(2).flatten()).view(np.uint64).reshape(-1, n))
                for c, pick in picks[n]:
                    lot = max(1, 200_000 // len(pick))
                    for at in range(0, len(members), lot):
                        sig = mixed(members[at : at + lot][:, pick].sum(axis=2, dtype=np.uint64) + np.uint64(c))
                        ids = np.repeat(own.column(0).to_numpy()[at : at + lot], len(pick))
                        columns = [sig.ravel().view(np.int64), ids, np.full(sig.size, n), np.full(sig.size, c)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["sig", "set", "n", "c"])

    small = sets.where(F.col("n") <= border).select("set", "n", "few")
    return small.mapInArrow(frugal(run), "sig long, set long, n long, c long")


def _stars(rows: DataFrame) -> DataFrame:
    """Each row with the smallest set of its group (p, pn), for groups of several sets."""
    least = rows.groupBy("sig").agg(
        F.min(F.struct("n", "set")).alias("p"), F.min("set").alias("low"), F.max("set").alias("high")
    )
    least = least.where("low <> high").select("sig", F.col("p.set").alias("p"), F.col("p.n").alias("pn"))
    return rows.join(least, "sig").where("set <> p")


def _listed_rows(frame: DataFrame, t: Threshold, border: int, buckets: int) -> DataFrame:
    """Rows (sig, set) of the prefix lists that hold two sets or more.

    A list with several sets in one slice needs no proof and sends only one of them to be compared
    with other slices, so a frequent member costs a bucket one entry for each slice.
    """
    entry = "bucket long, known boolean, data binary"
    reach = t.a * (border + 1)

    def make(part):
        values, ids, size, first = _distinct_sets(part.column(1), t.shingle)
        # A small set that can link with a large one is listed too.
        own = np.flatnonzero((size > border) | (t.b * size >= reach))
        count = t.prefix(size[own])
        start = np.repeat(first[own], count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start
        sig, owner = values[at], np.repeat(own, count)
        order = np.argsort(sig, kind="stable")
        sig, owner = sig[order], owner[order]
        opens = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
        several = ~opens | np.append(~opens[1:], False) if len(sig) else opens
        rows = np.stack([sig, ids[owner].view(np.uint64)], 1)
        out = []
        for known, which in ((False, opens), (True, several)):
            part_rows = rows[which]
            lead = part_rows[:, 1] if known else part_rows[:, 0]
            bucket = (lead % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            part_rows, bucket = part_rows[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(bucket)) if len(bucket) else []):
                out.append((int(bucket[a]), known, part_rows[a:b].tobytes()))
        return [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 3, (pa.int64(), pa.bool_(), pa.binary()))]

    def compare(table: pa.Table) -> pa.Table:
        known = table["known"].to_numpy()
        data = table["data"].to_pylist()
        read = lambda keep: np.frombuffer(b"".join(d for d, k in zip(data, known) if k == keep), np.uint64).reshape(-1, 2)
        rows = read(False)
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(1))[: len(rows)]
        rows = rows[new]
        same = rows[1:, 0] == rows[:-1, 0]
        several = np.append(False, same)[: len(rows)] | np.append(same, False)[: len(rows)]
        rows = np.concatenate([rows[several], read(True)]).view(np.int64)
        return pa.table([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(2)], names=["sig", "set"])

    sent = _map(frame, make, entry)
    return sent.groupBy("bucket").applyInArrow(_frugally(compare), "sig long, set long")


def _filter_of(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each id's hash; fixed in size whatever the number of ids."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    words = (
        ids.select((bit / 64).cast("long").alias("word"), F.expr("1").cast("long").alias("one"), (bit % 64).cast("int").alias("shift"))
        .select("word", F.expr("shiftleft(one, shift)").alias("bits"))
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def without(frame: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of `frame` whose `column` isn't among `ids`; only rows that a bit filter lets pass are shuffled."""
    ship(frame.sparkSession)
    bits = frame.sparkSession.sparkContext.broadcast(_filter_of(ids, column))
    names = frame.columns

    def tested(batches):
        for batch in batches:
            bit = batch.column(batch.num_columns - 1).to_numpy()
            hit = bits.value[bit // 64] >> (bit % 64) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hit == 1)], names=[*names, "__maybe"])

    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("__bit")
    ddl = T.StructType([*frame.schema.fields, T.StructField("__maybe", T.BooleanType())])
    rows = frame.select(*[F.col(f"`{c}`") for c in names], bit).mapInArrow(frugal(tested), ddl)
    sure = rows.where(~F.col("__maybe")).drop("__maybe")
    maybe = rows.where(F.col("__maybe")).drop("__maybe")
    return sure.unionAll(maybe.join(ids.select(column), column, "left_anti").select(*names))


def one_of_each(
    frame: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = (NUMERATOR, DENOMINATOR)
) -> DataFrame:
    """The rows whose key is the smallest of its component, with their own columns; null keys stay.

    A row is known by its key and its text. Of rows that share both, or a key and a component, all stay
    or all go; rows that share a key only are judged each by itself.
    """
    mark, whole = "__row", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = frame.withColumn(mark, F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(F.col(f"`{key}`"), whole)))
    found = linked_components(rows, key, text, shingle, similarity, carried=(mark,))
    found = found.where("doc_id <> component_id").select(mark)
    return without(rows, Scratch(frame.sparkSession).keep(found.distinct(), "copies"), mark).drop(mark)


def members_of(sets: DataFrame, frame: DataFrame, homes: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """set and members of the given sets, read again from the text of each set's home."""
    chosen = scratch.keep(homes.join(sets.select("set").distinct(), "set").select("doc_id", "set"), "chosen")
    bits = frame.sparkSession.sparkContext.broadcast(_filter_of(chosen, "doc_id"))
    where = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")

    def members(batches):
        for batch in batches:
            bit = batch.column(2).to_numpy()
            hit = bits.value[bit // 64] >> (bit % 64) & 1
            some = batch.filter(pa.array(hit == 1))
            for part in steps(some, "text"):
                values, bounds = shingle_sets(part.column(1), shingle)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                ids = pa.array(set_ids(values, bounds))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, lists], names=["doc_id", "set", "members"])

    kind = frame.schema["doc_id"].dataType.simpleString()
    found = frame.select("doc_id", "text", where).mapInArrow(frugal(members), f"doc_id {kind}, set long, members array<long>")
    # Rows that share a key are told apart by their set.
    own = found.join(chosen, ["doc_id", "set"], "left_semi")
    return scratch.keep(own.select("set", "members").dropDuplicates(["set"]), "members")


def checked(pairs: DataFrame, frame: DataFrame, homes: DataFrame, t: Threshold, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of sets that link, after comparing all members."""
    pairs = scratch.keep(pairs.select("a", "b").distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("set")).unionAll(pairs.select(F.col("b").alias("set")))
    found = members_of(asked, frame, homes, t.shingle, scratch)
    left = pairs.join(found.select(F.col("set").alias("b"), F.col("members").alias("y")), "b")
    both = left.join(found.select(F.col("set").alias("a"), F.col("members").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    linked = common >= t.sql_overlap(F.size("x"), F.size("y"))
    return scratch.keep(both.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def clusters_of(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """set, cluster and hub of the sets that share triples with a central set of their surroundings.

    The more sets a set shares triples with, the more central it is.
    """
    rows = sets.select("set", F.explode(F.array_distinct("triples")).alias("sig"))
    sizes = rows.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1")
    shared = scratch.keep(rows.join(sizes, "sig"), "triples")
    degree = shared.groupBy("set").agg(F.sum("k").alias("degree"))
    ranked = shared.join(degree, "set")
    centres = ranked.groupBy("sig").agg(F.max(F.struct("degree", "set")).alias("top"))
    near = ranked.join(centres.select("sig", F.col("top.set").alias("hub")), "sig").where("set <> hub")
    votes = near.groupBy("set", "hub").agg(F.count("*").alias("votes")).where(F.col("votes") >= VOTES)
    edges = scratch.keep(votes.select(F.col("set").alias("u"), F.col("hub").alias("v")), "near")
    found = components(edges, scratch).select(F.col("node").alias("set"), F.col("component").alias("cluster"))
    ranked = found.join(degree, "set")
    hubs = ranked.groupBy("cluster").agg(F.max(F.struct("degree", "set")).alias("top"), F.count("*").alias("k"))
    made = scratch.keep(found.join(hubs.select("cluster", F.col("top.set").alias("hub"), "k"), "cluster"), "clusters")
    scratch.drop(shared)
    scratch.drop(edges)
    return made


def compare_cell(table: pa.Table, a: int, b: int) -> pa.Table:
    """Edges that join the sets of `left` and `right` rows which link; no two edges say the same."""
    ids, size = table["set"].to_numpy(), np.asarray(pc.list_value_length(table["members"].combine_chunks()), np.int64)
    left, right = table["left"].to_numpy(), table["right"].to_numpy()
    flat = np.asarray(table["members"].combine_chunks().flatten())
    owner = np.repeat(np.arange(len(ids)), size)
    keep = right[owner]
    order = np.argsort(flat[keep], kind="stable")
    tokens, owners = flat[keep][order], owner[keep][order]
    first = np.append(0, np.cumsum(size))
    label, edges = np.arange(len(ids)), []
    for r in np.flatnonzero(left).tolist():
        own = flat[first[r] : first[r + 1]]
        at = np.searchsorted(tokens, own, "left")
        count = np.searchsorted(tokens, own, "right") - at
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at, count)
        common = np.bincount(owners[place], minlength=len(ids))
        linked = np.flatnonzero(((a + b) * common >= a * (size + size[r])) & (common > 0))
        others, where = np.unique(label[linked], return_index=True)
        for o, w in zip(others.tolist(), linked[where].tolist()):
            if o != label[r]:
                edges.append((int(ids[r]), int(ids[w])))
                label[label == o] = label[r]
    u, v = zip(*edges) if edges else ([], [])
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _compared(cells: DataFrame, keys: list[str], t: Threshold) -> DataFrame:
    return cells.groupBy(*keys).applyInArrow(_frugally(lambda table: compare_cell(table, t.a, t.b)), "u long, v long")


def _frugally(make):
    """`make` for one group; what a large group took goes back before the next one."""

    def made(table: pa.Table) -> pa.Table:
        out, large = make(table), table.nbytes > 1 << 20
        if large:
            give_back()
        return out

    return made


def cluster_links(clusters: DataFrame, members: DataFrame, t: Threshold, scratch: Scratch) -> DataFrame:
    """Edges that connect the linked sets of each cluster."""
    slices = F.ceil(F.col("k") / SLICE).cast("long")
    rows = clusters.join(members, "set").withColumn("slices", slices)
    own = F.when(F.col("set") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    own = F.coalesce(own, F.array(F.pmod(F.xxhash64("set"), F.col("slices"))))
    both = [F.lit(True).alias("left"), F.lit(True).alias("right")]
    inside = rows.select("cluster", F.explode(own).alias("slice"), "set", "members", *both)
    links = scratch.keep(_compared(inside, ["cluster", "slice"], t), "inside")
    # Clusters of several slices: whatever isn't in the largest component meets all others.
    wide = clusters.where(F.col("k") > SLICE)
    if wide.isEmpty():
        return links
    parts = wide.join(components(links, scratch).withColumnRenamed("node", "set"), "set", "left")
    parts = parts.withColumn("component", F.coalesce("component", "set"))
    counts = parts.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("top"))
    parts = parts.join(largest.select("cluster", F.col("top.component").alias("main")), "cluster")
    parts = scratch.keep(parts.withColumn("apart", F.col("component") != F.col("main")), "parts")
    apart = parts.where("apart").groupBy("cluster").agg(F.ceil(F.count("*") / SLICE).cast("long").alias("across"))
    parts = parts.join(apart, "cluster").join(members, "set").withColumn("slices", slices)
    hashed = F.xxhash64("set")
    spread = F.lit(0).cast("long")
    lefts = parts.where("apart").select(
        "cluster", F.pmod(hashed, F.col("across")).alias("i"),
        F.explode(F.sequence(spread, F.col("slices") - 1)).alias("j"), "set", "members",
        F.lit(True).alias("left"), F.lit(False).alias("right"),
    )
    rights = parts.select(
        "cluster", F.explode(F.sequence(spread, F.col("across") - 1)).alias("i"),
        F.pmod(hashed, F.col("slices")).alias("j"), "set", "members",
        F.lit(False).alias("left"), F.lit(True).alias("right"),
    )
    across = scratch.keep(_compared(lefts.unionAll(rights), ["cluster", "i", "j"], t), "across")
    return links.unionAll(across)


def _list_pairs(listed: DataFrame, homes: DataFrame, clusters: DataFrame, t: Threshold, scratch: Scratch) -> DataFrame:
    """Pairs of sets in different clusters that share enough listed members."""
    place = homes.select("set", "n").join(clusters.select("set", "cluster"), "set", "left")
    rows = listed.join(place.withColumn("cluster", F.coalesce("cluster", "set")), "set")
    several = rows.groupBy("sig").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo <> hi")
    # Sets of different clusters only meet on lists that hold several clusters.
    rows = scratch.keep(rows.join(several.select("sig"), "sig", "left_semi").distinct(), "across-lists")
    scratch.drop(listed)
    entries = rows.count()
    heavy = rows.groupBy("sig").agg(F.count("*").alias("k")).where(F.col("k") > HEAVY)
    rows = rows.join(heavy, "sig", "left")
    # The longest lists first, in the same order for every set.
    own = Window.partitionBy("set")
    place = F.row_number().over(own.orderBy(F.col("k").desc_nulls_last(), "sig"))
    rows = rows.withColumn("spared", F.col("k").isNotNull() & (place <= t.sql_spare(F.col("n"))))
    rows = rows.withColumn("left_out", F.sum(F.col("spared").cast("long")).over(own))
    rows = rows.where(~F.col("spared")).drop("spared")
    pairs = _scanned(rows, homes.select("set", "bits"), t, entries).groupBy("set1", "set2", "n1", "n2", "left_out1", "left_out2")
    counts = pairs.agg(F.sum("shared").alias("shared"))
    need = t.sql_overlap(F.col("n1"), F.col("n2"))
    listed_in_both = F.least(
        t.sql_prefix(F.col("n1")) - F.col("n1") + need, t.sql_prefix(F.col("n2")) - F.col("n2") + need
    )
    # Of the common lists, those left out by either are the longest ones: as many as one of both left out.
    enough = F.col("shared") + F.greatest("left_out1", "left_out2") >= listed_in_both
    return counts.where(enough).select(F.col("set1").alias("a"), F.col("set2").alias("b"))


#: Entries of a list in one piece, entries in a bucket of lists, and pairs counted at a time.
PIECE, LISTED, LOT = 2000, 400_000, 1 << 20


def _scanned(rows: DataFrame, maps: DataFrame, t: Threshold, entries: int) -> DataFrame:
    """Pairs of sets of different clusters on one list, with the lists of a bucket that they share.

    Lists are dealt to buckets and scanned there: entries lie in order of size, and each meets only
    those after it that are small enough to link with it. Pairs whose bit maps (`maps`: set, bits) differ in
    too many places can't link and stay there; equal pairs of a bucket are counted before they
    leave it. A list longer than a piece is cut into pieces, and every two pieces meet in some bucket. `k`
    is the length of a heavy list. A set travels to a bucket once, with all its entries there.
    """
    rows = rows.withColumn("pieces", F.ceil(F.coalesce("k", F.lit(1)) / F.lit(PIECE)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set"), "pieces").cast("int"))
    to = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    rows = rows.select("sig", "set", "n", "cluster", "left_out", "own", to)
    i, j = F.least("own", "other"), F.greatest("own", "other")
    buckets = max(1, -(-entries // LISTED))
    entry = F.struct(F.xxhash64("sig", i, j).alias("list"), (i == j).alias("one"), "own")
    rows = rows.select(
        F.pmod(F.xxhash64("sig", i, j), F.lit(buckets)).alias("bucket"), "set", "n", "cluster", "left_out", entry.alias("entry")
    )
    rows = rows.groupBy("bucket", "set", "n", "cluster", "left_out").agg(F.collect_list("entry").alias("entries"))
    kinds = "set1 long, set2 long, n1 long, n2 long, left_out1 long, left_out2 long, shared long"
    sent = rows.join(maps, "set").select("bucket", "set", "n", "cluster", "left_out", "entries", "bits")
    return sent.groupBy("bucket").applyInArrow(_frugally(lambda table: scan_lists(table, t.a, t.b)), kinds)


def scan_lists(table: pa.Table, a: int, b: int) -> pa.Table:
    """The pairs of a bucket's lists that can link, each once with the number of lists."""
    known, size, group, out = (table[c].to_numpy() for c in ("set", "n", "cluster", "left_out"))
    packed, maps = table["entries"].combine_chunks(), _BitMaps(table["bits"])
    flat = packed.flatten()
    lists, one, own = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("list", "one", "own"))
    index = np.repeat(np.arange(len(known)), np.asarray(pc.list_value_length(packed), np.int64))
    order = np.lexsort((size[index], lists))
    lists, one, own, index = (x[order] for x in (lists, one, own, index))
    n, cluster = size[index], group[index]
    # Of each entry the last one of its list that it can link with.
    start = np.append(True, lists[1:] != lists[:-1])[: len(lists)]
    where = np.cumsum(start) - 1
    wide = int(n.max()) + 1 if len(n) else 1
    key = where * wide + n
    reach = np.searchsorted(key, where * wide + np.minimum(b * n // a, wide - 1), "right")
    count = reach - np.arange(len(n)) - 1
    ends = np.cumsum(count)
    keys, sums, at = [], [], 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOT, "right")))
        lot = count[at:to]
        x = np.repeat(np.arange(at, to), lot)
        y = np.arange(int(lot.sum())) - np.repeat(np.cumsum(lot) - lot, lot) + x + 1
        meet = (cluster[x] != cluster[y]) & (one[x] | (own[x] != own[y]))
        x, y = x[meet], y[meet]
        swap = cluster[x] > cluster[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        part, times = np.unique(index[x] * len(known) + index[y], return_counts=True)
        x, y = part // len(known), part % len(known)
        both = size[x] + size[y]
        # The sets differ in as many members as they have, but for those that they share twice.
        can = both - maps.apart(x, y) >= 2 * -(-a * both // (a + b))
        keys.append(part[can])
        sums.append(times[can])
        at = to
    pair, back = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_inverse=True)
    shared = np.zeros(len(pair), np.int64)
    np.add.at(shared, back, np.concatenate(sums) if sums else np.empty(0, np.int64))
    x, y = pair // max(len(known), 1), pair % max(len(known), 1)
    columns = [known[x], known[y], size[x], size[y], out[x], out[y], shared]
    return pa.table([pa.array(c) for c in columns], names=["set1", "set2", "n1", "n2", "left_out1", "left_out2", "shared"])


#: Bytes of text for each bucket of list entries.
BUCKET_BYTES = 6 << 20


def linked_components(
    frame: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    similarity: tuple[int, int] = (NUMERATOR, DENOMINATOR), carried: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: key, n_shingles, component_id (smallest key that links reach, itself included), carried columns."""
    t = Threshold(*similarity, shingle)
    scratch = Scratch(frame.sparkSession)
    source = identified(frame, key, text)
    whole = identified(frame, key, text, *carried) if carried else source
    made = scratch.keep(sets_of(whole, t.shingle, carried), "sets")
    docs = made.select("doc_id", *carried, "set", "n")
    homes = made.where("n > 0").groupBy("set").agg(
        F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "triples", "few", "bits"))
    )
    homes = scratch.keep(homes, "homes")
    counts = homes.where(F.col("n") <= 2 * LARGEST_SMALL).groupBy("n").agg(F.count("*").alias("k")).collect()
    border = t.border({r.n: r.k for r in counts})
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    stars = _stars(_small_rows(homes, t, border))
    small = stars.where(t.sql_overlap(F.col("n"), F.col("pn")) <= F.col("c"))
    small = scratch.keep(small.select(F.col("p").alias("u"), F.col("set").alias("v")).distinct(), "small")
    clusters = clusters_of(homes.where(F.col("n") > border), scratch)
    members = members_of(clusters, source, homes, t.shingle, scratch)
    edges = small.unionAll(cluster_links(clusters, members, t, scratch))
    listed = scratch.keep(_listed_rows(source, t, border, max(1, -(-size // BUCKET_BYTES))), "listed")
    scratch.drop(members)
    more = checked(_list_pairs(listed, homes, clusters, t, scratch), source, homes, t, scratch)
    final = components(edges.unionAll(more), scratch)
    place = homes.join(final.withColumnRenamed("node", "set"), "set", "left")
    place = place.select("set", "doc_id", F.coalesce("component", "set").alias("component"))
    least = place.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = place.join(least, "component").select("set", "component_id")
    found = docs.join(by_set, "set", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *carried)

