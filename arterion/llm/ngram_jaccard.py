"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles, as 64-bit hashes.  Two sets
can reach the threshold only if few tokens of either are missing in the other,
so it is enough to index a prefix of each set under one global order.  The
order has four classes of tokens:

1. rare tokens in the lowest part of the hash range, by the number of sets that
   hold them (counted exactly), then by hash.  That part is a little larger than
   a prefix.  Tokens of one set alone fill the prefix without being indexed, so
   a text that is mostly its own has no candidates at all;
2. other rare tokens, by hash;
3. and 4. frequent and very frequent tokens, by subgroup and hash.  They are
   indexed not singly but as combinations of 2, or 3, tokens of one subgroup,
   and the prefix is extended until even the worst placed missing tokens leave
   one rare token or one combination in common.  The number of subgroups follows
   the set's size band, so a set is indexed for its own band and, near an edge,
   for that of a smaller partner.

Of two similar sets, the smaller can miss less of its tokens than the larger
one, so an entry is marked as long if it lies beyond the prefix that a set needs
as the smaller of a pair; two sets are candidates only if they share an entry
that isn't long for the smaller one.

Candidates that share an index entry are verified exactly.  Within an entry's
bucket, members are compared with a pivot, the set that seems to have the fewest
tokens of its own and so is likely the original of its copies; members that end
up in one component need no further comparison, and a bucket that still holds
several components goes through further rounds in which the number of pivots
grows eightfold, until every pair of members that can be similar is either in
one component or was compared.  In those rounds a pair that shares several
entries is taken up in the least of them only.  No pair is lost, and a group of copies costs a
star, not a clique.  Pivots are found by a grouped minimum, which is aggregated
before it is shuffled, and joined back, which adaptive execution can split.

Memory: a task holds the documents of an Arrow batch, the class ids that it has
seen, and the pivots of one cell: the members of a large bucket are dealt to
cells, as are the pivots of later rounds.  Only the frequent tokens, at most
``MOST_FREQUENT``, and hot keys, of which there can only be a thousand, go
through the driver.  Everything but the result is deleted at the end.

Defined results: a null or blank text has an empty set and is linked with
nothing; a text of fewer words than a shingle is one token; equal sets are
linked; a row without doc_id is linked with nothing and has a null component;
of rows that repeat a doc_id, each is looked at and they share a component if
any link; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arterion.llm.common import join_hot, Scratch, table, tidied
from arterion.llm.wordhash import WordHasher, mix

#: The part of the hash range whose tokens are counted, against the part of a set that may be missing.
COUNTED_PART = 1.25
#: A token is frequent if it was counted this often; beyond the second bound it is indexed by threes.
FREQUENT, VERY_FREQUENT = 32, 1 << 14
#: No more tokens than this are called frequent (8 bytes each are broadcast); the others are indexed singly.
MOST_FREQUENT = 1 << 17
#: Tokens are counted exactly by chunks of this many, and counts under LOCAL of a chunk are left out.
COUNTED, LOCAL = 1 << 20, 3
#: A token held by more sets than this is ordered as if it were held by so many; bounds what a task keeps of one token.
MOST_HELD = 1 << 16
GROWTH = 8
#: Members and pivots of a bucket that are compared in one task at most.
CELL_MEMBERS, CELL_PIVOTS = 4096, 512
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)


class Shingler:
    """Distinct word shingles as sorted, even 64-bit hashes: A-Z lower-cased, words cut at blanks of ASCII."""

    def __init__(self, words: int):
        self.words, self.hasher = words, WordHasher()
        self.odd = np.random.default_rng(words).integers(1, 1 << 63, max(words, 2), np.uint64) * np.uint64(2) + np.uint64(1)

    def _sets(self, h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """The sets of texts that have ``counts`` words, one after the other in ``h``."""
        h, w = mix(h), self.words
        n = max(0, len(h) - w + 1)
        out = h[:n] * self.odd[0]
        for k in range(1, w):
            out += h[k : k + n] * self.odd[k]
        out = mix(out) & _EVEN
        sets, at = [], 0
        for m in counts.tolist():
            if m >= w:
                x = np.sort(out[at : at + m - w + 1])
                new = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=new[1:])
                sets.append(x[new])
            elif m:
                few = (h[at : at + m] * self.odd[:m]).sum(dtype=np.uint64) + np.uint64(m)
                sets.append(mix(np.array([few])) & _EVEN)
            else:
                sets.append(np.empty(0, np.uint64))
            at += m
        return sets

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """The set of each text (string or binary; null: empty)."""
        return [x for counts, h, _ in self.hasher.groups(texts) for x in self._sets(h, counts)]

    def tokens(self, text: bytes | None) -> np.ndarray:
        return self.sets(pa.array([text], pa.binary()))[0]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


#: Combinations are odd entries; tokens lose their last bit and are even ones.
_ODD_BIT = np.uint64(1)


def _band(n: int) -> int:
    return n.bit_length() - 1


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many tokens of a set of ``n`` are looked at: as the larger, and as the smaller of a similar pair; 0 if only
    an equal set can be similar."""
    missing = n * (100 - percent) // 100
    if missing == 0 and n * 100 // percent == n:
        return 0, 0
    return missing + 1, n + 1 - -(-2 * percent * n // (100 + percent))


def _combinations(held: np.ndarray, by3: np.ndarray, need: int, n: int, percent: int) -> list[int]:
    """Combinations of frequent tokens that stand for ``need`` tokens of a prefix."""
    out: list[int] = []
    for band in sorted({_band(n), _band(-(-n * percent // 100))}) if need > 0 else ():
        left = need
        for k, part in ((2, held[~by3]), (3, held[by3])):
            if band < 4:
                k, groups = 1, 1
            else:
                groups = max(1, (1 << band) // (4 if k == 2 else 8))
            sub = mix(part) % np.uint64(groups)
            order = np.lexsort((part, sub))
            part, sub = part[order], sub[order]
            for group in np.split(part, np.flatnonzero(np.diff(sub)) + 1):
                if left <= 0:
                    break
                group = group[: left + k - 1].tolist()
                left -= max(0, len(group) - k + 1)
                out += [hash((band, k, *c)) & 0xFFFFFFFFFFFFFFFF for c in combinations(group, k)]
        if left > 0:
            raise ValueError(f"a prefix can't reach its length at {percent} %")
    return out


def signatures(tokens: np.ndarray, percent: int, frequent: np.ndarray, very: np.ndarray) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(long and short prefix length, number of rare tokens, counted rare tokens, further entries, further long entries) of a set.

    Further entries are what a prefix holds if the counted tokens, all of which it holds then, are too few.
    """
    none, n = np.empty(0, np.uint64), len(tokens)
    need, short = prefix_lengths(n, percent) if n else (0, 0)
    if not need:
        return 0, 0, 0, none, none, none
    at = np.searchsorted(frequent, tokens) if len(frequent) else None
    often = (frequent[np.minimum(at, len(frequent) - 1)] == tokens) if at is not None else np.zeros(n, bool)
    rare = tokens[~often]
    part = int(np.searchsorted(rare, np.uint64(int((1 << 64) * min(0.999, COUNTED_PART * (100 - percent) / 100)))))
    counted, single, first = rare[:part], rare[part : max(part, need)], rare[part : max(part, short)]
    if need <= len(rare):
        return need, short, len(rare), counted, first, single[len(first) :]
    # From here on the prefix holds every rare token.
    held = tokens[often]
    by3 = np.isin(held, very, assume_unique=True) if len(very) else np.zeros(len(held), bool)
    near = _combinations(held, by3, short - len(rare), n, percent)
    far = set(_combinations(held, by3, need - len(rare), n, percent)).difference(near)
    return need, short, len(rare), counted, np.concatenate([first, mix(np.array(near, np.uint64)) | _ODD_BIT]), np.concatenate([single[len(first) :], mix(np.array(sorted(far), np.uint64)) | _ODD_BIT])


def _class_id(tokens: np.ndarray, size: int) -> tuple[int, int]:
    """Two signed 64-bit halves that name a set; the second holds its size in the low 24 bits."""
    import xxhash

    a, b = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8").tolist()
    return a, b & ~0xFFFFFF | min(size, 0xFFFFFF)


def frequent_tokens(spark: SparkSession, docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that count as frequent and as very frequent, each sorted; counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(words), [], 0

        def part() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(2, LOCAL * size // COUNTED)
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                held += shingler.sets(batch.column(0).slice(start, 500))
                size = sum(map(len, held))
                if size >= COUNTED:
                    yield part()
                    held, size = [], 0
        if held:
            yield part()

    scratch = Scratch(spark)
    counts = docs.select("text").mapInArrow(tidied(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts.where(F.col("n") >= FREQUENT), "tokens")
    # At most a few hundred rows: how many tokens have a count in each eighth of a power of two.
    steps = sorted(counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().collect(), key=lambda r: -r["step"])
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > MOST_FREQUENT:
            break
        least = r["step"]
    found = counts.where(F.floor(F.log2("n") * 8) >= least).toPandas() if least is not None else None
    scratch.close()
    if found is None:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    return np.sort(token), np.sort(token[found["n"].to_numpy() >= VERY_FREQUENT])


ID = "struct<a:long,b:long>"


def _id(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def _size(c: Column) -> Column:
    return c["b"].bitwiseAND(0xFFFFFF)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(c, label): the least id reachable from each id of ``edges`` (u, v).

    Labels spread over edges and are then followed one step (pointer jumping), until none changes.
    """
    both = scratch.keep(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = join_hot(both, labels.select(F.col("c").alias("v"), "label"), "v").groupBy(F.col("u").alias("c")).agg(F.min("label").alias("m"))
        step = labels.join(near, "c").select("c", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        step = scratch.keep(step, "step")
        # Most labels are roots, whose own label is no other one.
        jump = step.where(F.col("c") != F.col("label")).select(F.col("c").alias("label"), F.col("label").alias("next"))
        step_to = F.least("label", F.coalesce("next", "label"))
        labels, last = scratch.keep(join_hot(step, jump, "label", "left").select("c", step_to.alias("label"), (step_to < F.col("was")).alias("moved")), "labels"), labels
        scratch.drop(last, step)
        if not labels.where("moved").take(1):
            scratch.drop(both)
            return labels


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable by links of at least ``percent`` Jaccard."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark)
    frequent, very = frequent_tokens(spark, docs, words)
    often = spark.sparkContext.broadcast((frequent, very))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        lists, none = pa.list_(pa.int64()), np.empty(0, np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                n, ids, need, short, own, found = [], [], [], [], [], []
                for doc, tokens in zip(rows.column(0), shingler.sets(rows.column(1)), strict=True):
                    n.append(len(tokens))
                    ids.append(_class_id(tokens, len(tokens)))
                    first, second, third, *lists_of = 0, 0, 0, none, none, none
                    if len(tokens) and doc.is_valid and ids[-1] not in seen:
                        seen.add(ids[-1])
                        first, second, third, *lists_of = signatures(tokens, percent, *often.value)
                    need.append(first)
                    short.append(second)
                    own.append(third)
                    found.append([x.view(np.int64) for x in lists_of])
                columns = [pa.array(x, pa.int64()) for x in (n, [x[0] for x in ids], [x[1] for x in ids], need, short, own)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns, *[pa.array([x[k] for x in found], lists) for k in range(3)]], names)

    names = ["doc_id", "n", "a", "b", "need", "short", "rare", "counted", "near", "far"]
    indexed = scratch.keep(docs.mapInArrow(tidied(index), f"doc_id {kind}, n long, a long, b long, need long, short long, rare long, counted array<long>, near array<long>, far array<long>"), "indexed")
    often.destroy()

    # Which counted tokens more than one set holds, by the first half of the sets' ids.  Two sets that agree in that
    # half only lengthen each other's lists, and their prefixes by as much.
    dealt = indexed.select(F.explode("counted").alias("token"), "a").repartition("token").sortWithinPartitions("token", "a")
    shared = dealt.mapInArrow(tidied(_shared), "a long, token long, held int").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    sets = indexed.where(F.col("need") > 0).select("a", "b", "need", "short", "rare", F.size("counted").alias("n_counted"), "near", "far").join(shared, "a", "left")
    n_shared, none = F.coalesce(F.size("shared"), F.lit(0)), F.expr("cast(array() as array<long>)")
    take = lambda c: F.greatest(F.lit(0), F.least(n_shared, F.col(c).cast("int") - F.col("n_counted") + n_shared))
    part = lambda start, n: F.when(n > 0, F.slice("shared", start, n)["token"]).otherwise(none)
    # About how many tokens no other set has.
    own = F.round(F.col("rare") * (1 - F.when(F.col("n_counted") > 0, F.least(F.lit(1.0), n_shared / F.col("n_counted"))).otherwise(0.0))).cast("int")
    sets = sets.select("a", "b", "rare", "near", "far", "shared", own.alias("own"), take("short").alias("x"), take("need").alias("y"))
    sets = sets.select("a", "b", "rare", "own", F.concat(part(F.lit(1), F.col("x")), "near").alias("near"), F.concat(part(F.col("x") + 1, F.col("y") - F.col("x")), "far").alias("far"))
    sets = scratch.keep(sets.where((F.size("near") > 0) | (F.size("far") > 0)), "prefix")
    named = scratch.keep(indexed.select("doc_id", F.col("n").alias("n_shingles"), _id("a", "b").alias("c")), "named")
    scratch.drop(indexed)
    entries = lambda c, long: F.transform(c, lambda t: F.struct(t.alias("sig"), F.lit(long).alias("long")))
    prefix = sets.select("a", "b", "own", F.explode(F.concat(entries("near", 0), entries("far", 1))).alias("e")).select("e.sig", "e.long", "own", "a", "b")

    members = _members(scratch, prefix)
    # All pairs with a pivot keep a bucket open; only those whose smaller set isn't long are to be verified.
    starred = scratch.keep(members.groupBy("c", "p").agg(F.max("fit").alias("fit")), "pairs")
    pairs = starred.where("fit").select("c", "p")

    # The text of one document of each set that has a candidate.
    wanted = starred.select("c").union(starred.select("p")).distinct()
    owner = named.where(F.col("doc_id").isNotNull()).groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    wanted = wanted.join(owner, "c")
    texts = scratch.keep(_texts(docs.where(F.col("doc_id").isNotNull()), wanted, words), "texts")

    labels = components(scratch, scratch.keep(_verified(pairs, texts, words, percent), "links"))
    low, high = 1, GROWTH
    while True:
        open_pairs = _labelled(starred.select("c", "p"), labels).where(F.col("lc") != F.col("lp")).select("c", "p")
        inside = scratch.keep(_open(members, open_pairs, labels), "open")
        if not inside.take(1):
            break
        cells, more = _cells(scratch, inside, sets, low, high)
        again = scratch.keep(cells.mapInArrow(tidied(_compare(percent)), "a long, b long, p long, q long").select(_id("a", "b").alias("c"), _id("p", "q").alias("p")).distinct(), "again")
        found = scratch.keep(_verified(again.join(pairs, ["c", "p"], "left_anti"), texts, words, percent), "links")
        if found.take(1):
            labels = _merged(scratch, labels, found)
        scratch.drop(inside, again, found)
        if not more:
            break
        low, high = high, high * GROWTH

    linked = named.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    linked = scratch.keep(join_hot(linked, labels.select("c", "label"), "c", "left").select("doc_id", "n_shingles", F.coalesce("label", "c").alias("root")), "roots")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = named.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = scratch.keep(join_hot(linked, least, "root").select("doc_id", "n_shingles", "component_id").unionByName(alone), "components")
    scratch.close(out)
    return out


def _merged(scratch: Scratch, labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` after the edges ``found`` (u, v): components of the labels that these edges connect."""
    between = _labelled(found.select(F.col("u").alias("c"), F.col("v").alias("p")), labels)
    over = components(scratch, between.where(F.col("lc") != F.col("lp")).select(F.col("lc").alias("u"), F.col("lp").alias("v")))
    old = join_hot(labels, over.select(F.col("c").alias("label"), F.col("label").alias("new")), "label", "left").select("c", F.coalesce("new", "label").alias("label"))
    out = scratch.keep(old.unionByName(over.select("c", "label").join(labels, "c", "left_anti")), "labels")
    scratch.drop(labels, over)
    return out


def _members(scratch: Scratch, prefix: DataFrame) -> DataFrame:
    """(sig, long, own, c, p, p_own, fit) of the entries (sig, long, own, a, b) that two sets or more hold: each member
    with its bucket's pivot, and if the smaller one's entry isn't long.

    A long entry stays if its set is as large as the smallest set whose entry isn't; that need not be the pivot.
    """
    n = F.col("b").bitwiseAND(0xFFFFFF)
    rank = F.struct("long", "own", n.alias("n"), "a", "b")
    least = F.min(F.when(F.col("long") == 0, n)).alias("least")
    pivot = prefix.groupBy("sig").agg(F.min(rank).alias("p"), least, F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("p.long") == 0))
    pivot = scratch.keep(pivot.select("sig", F.struct("p.a", "p.b").alias("p"), F.col("p.own").alias("p_own"), "least", "n"), "buckets")
    members = join_hot(prefix.select("sig", "long", "own", _id("a", "b").alias("c")), pivot.drop("n"), "sig", counts=pivot)
    members = members.where((F.col("c") != F.col("p")) & ((F.col("long") == 0) | (_size(F.col("c")) >= F.col("least"))))
    members = scratch.keep(members.select("sig", "long", "own", "c", "p", "p_own", ((F.col("long") == 0) | (_size(F.col("c")) >= _size(F.col("p")))).alias("fit")), "members")
    scratch.drop(pivot)
    return members


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and set: (set, token, number of sets) of tokens that two sets or more hold.

    Of the token that a batch ends in, distinct rows wait for the next batch, MOST_HELD at most: a token that fills them
    counts as held by MOST_HELD sets, and its rows go on at once.
    """
    full, token, a = None, np.empty(0, np.int64), np.empty(0, np.int64)

    def part(token: np.ndarray, a: np.ndarray, n: np.ndarray | int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(token), pa.array(np.broadcast_to(np.int32(n), len(a)))], ["a", "token", "held"])

    for batch in batches:
        token = np.concatenate([token, batch.column(0).to_numpy(zero_copy_only=False)])
        a = np.concatenate([a, batch.column(1).to_numpy(zero_copy_only=False)])
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (a[1:] != a[:-1])
        token, a = token[new], a[new]
        if full is not None and len(token):
            end = int(np.searchsorted(token, full, "right"))
            yield part(token[:end], a[:end], MOST_HELD)
            token, a = token[end:], a[end:]
            full = None if len(token) else full
        end = int(np.searchsorted(token, token[-1])) if len(token) else 0  # the last token's rows may go on
        yield from _held(token[:end], a[:end], part)
        token, a = token[end:], a[end:]
        if len(token) >= MOST_HELD:
            full = token[0]
            yield part(token, a, MOST_HELD)
            token, a = token[:0], a[:0]
    yield from _held(token, a, part)


def _held(token: np.ndarray, a: np.ndarray, part: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole tokens that two sets or more hold."""
    if len(token):
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        n = np.diff(np.append(first, len(token)))
        n = np.repeat(np.minimum(n, MOST_HELD), n).astype(np.int32)
        keep = n > 1
        yield part(token[keep], a[keep], n[keep])


class _Member:
    """A set in a bucket, with the entries that index it; those are unpacked when first asked for."""

    __slots__ = ("id", "label", "lists", "n", "rare", "whole")

    def __init__(self, identity: tuple[int, int], label: tuple[int, int], n: int, rare: int, near: pa.Scalar, far: pa.Scalar):
        self.id, self.label, self.n, self.rare, self.lists = identity, label, n, rare, (near, far)

    def entries(self) -> tuple[frozenset[int], frozenset[int]]:
        """(not long, all)."""
        if isinstance(self.lists[0], pa.Scalar):
            near, far = (x.as_py() or [] for x in self.lists)
            self.lists = (frozenset(near), frozenset(near).union(far))
            self.whole = any(x & 1 for x in self.lists[1])  # does the prefix hold every rare token
        return self.lists


def _taken_up(x: _Member, y: _Member, sig: int, percent: int) -> bool:
    """Is ``sig`` the least entry that makes two sets candidates: one they share that isn't long for the smaller.

    And can they be similar: if the prefixes hold every rare token of both, they share no rare tokens but those among
    the shared entries, and no more frequent ones than the set that has fewer.
    """
    (x_near, x_all), (y_near, y_all) = x.entries(), y.entries()
    found = (x_near & y_all) if x.n <= y.n else frozenset()
    if y.n <= x.n:
        found |= y_near & x_all
    if min(found, default=None) != sig:
        return False
    if not (x.whole and y.whole):
        return True
    most = min(x.n - x.rare, y.n - y.rare) + sum(not e & 1 for e in x_all & y_all)
    return (100 + percent) * most >= percent * (x.n + y.n)


def _open(members: DataFrame, open_pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, long, own, n, c, lc): all members, pivots included, of the buckets in which a pair of ``open_pairs`` is."""
    sigs = members.join(open_pairs, ["c", "p"], "left_semi").select("sig").distinct()
    inside = members.join(sigs, "sig", "left_semi")
    inside = inside.select("sig", "long", "own", "c").union(inside.select("sig", F.lit(0), F.col("p_own").alias("own"), F.col("p").alias("c"))).distinct()
    inside = inside.join(labels.select("c", F.col("label").alias("lc")), "c", "left")
    return inside.select("sig", "long", "own", _size(F.col("c")).alias("n"), "c", F.coalesce("lc", "c").alias("lc"))


def _pivots(inside: DataFrame, rank: list[str], low: int, high: int) -> DataFrame:
    """Of each bucket the members that aren't long at places ``low`` up to ``high``.

    The filter is on the plain rank: so Spark limits each task's rows of a bucket to ``high`` before they are shuffled.
    """
    ranked = inside.where(F.col("long") == 0).withColumn("rank", F.row_number().over(Window.partitionBy("sig").orderBy(*rank)))
    return ranked.where((F.col("rank") <= high) & (F.col("rank") > low)).withColumn("place", F.col("rank") - 1).drop("rank")


def _cells(scratch: Scratch, inside: DataFrame, sets: DataFrame, low: int, high: int) -> tuple[DataFrame, bool]:
    """Rows for _compare(), and if a bucket has pivots beyond ``high``.

    A bucket's members are dealt to cells of about CELL_MEMBERS, and its pivots at places ``low`` to ``high`` of those
    that aren't long, by CELL_PIVOTS, go to each of them.
    """
    rank = ["own", "n", "c"]
    pivots = scratch.keep(_pivots(inside, rank, low, high), "pivots")
    sizes = inside.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("long") == 0).alias("m0"))
    sizes = scratch.keep(sizes.where(F.col("m0") > low).select("sig", F.ceil(F.col("m") / CELL_MEMBERS).cast("int").alias("deals"), F.ceil((F.least("m0", F.lit(high)) - low) / CELL_PIVOTS).cast("int").alias("blocks"), (F.col("m0") > high).alias("more")), "sizes")
    deals = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["sig", "deal", "block", "member", *rank, "long", "lc"]
    ours = join_hot(inside, sizes, "sig").withColumn("deal", F.pmod(F.xxhash64("c"), F.col("deals")).cast("int")).withColumn("block", deals("blocks")).withColumn("member", F.lit(1)).select(*names)
    theirs = pivots.join(sizes, "sig").withColumn("deal", deals("deals")).withColumn("block", F.floor((F.col("place") - low) / CELL_PIVOTS).cast("int")).withColumn("member", F.lit(0)).select(*names)
    lists = sets.select(_id("a", "b").alias("c"), "rare", "near", "far").join(inside.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.max("rare").alias("rare"), F.max("near").alias("near"), F.max("far").alias("far"))
    cells = ours.unionByName(theirs).join(lists, "c").repartition("sig", "deal", "block").sortWithinPartitions("sig", "deal", "block", "member", *rank)
    rows = cells.select("sig", "deal", "block", "member", "long", "own", "n", "c.a", "c.b", F.col("lc.a").alias("la"), F.col("lc.b").alias("lb"), "near", "far", "rare")
    return rows, bool(sizes.where("more").take(1))


def _compare(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs (member, pivot) of a cell that are to be verified, as far as sizes and components allow, and if the
    bucket is the pair's least common one.  Rows are sorted: a cell's pivots first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pivots = None, []
        for batch in batches:
            near, far, rare = batch.column(11), batch.column(12), batch.column(13).to_pylist()
            rows = []
            for k, (s, deal, block, member, long, own, n, a, b, la, lb) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(11)), strict=True)):
                if (s, deal, block) != cell:
                    cell, pivots = (s, deal, block), []
                me = _Member((a, b), (la, lb), n, rare[k], near[k], far[k])
                rank = (own, n, a, b)
                if not member:
                    pivots.append((rank, me))
                    continue
                for before, p in pivots:
                    if (long or before < rank) and p.label != me.label and (p.n <= n or not long) and 100 * min(p.n, n) >= percent * max(p.n, n) and _taken_up(p, me, s, percent):
                        rows.append((a, b, *p.id))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["a", "b", "p", "q"])

    return work


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (c, p) with their labels lc and lp; an id without a label is its own."""
    one, two = labels.select(F.col("c").alias("c1"), F.col("label").alias("l1")), labels.select(F.col("c").alias("c2"), F.col("label").alias("l2"))
    out = pairs.join(one, pairs["c"] == one["c1"], "left").join(two, pairs["p"] == two["c2"], "left")
    return out.select("c", "p", F.coalesce("l1", "c").alias("lc"), F.coalesce("l2", "p").alias("lp"))


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(c, packed): the compressed text of each wanted set.  Texts are shuffled once, compressed, and not sorted."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([z.compress(x.as_py() or b"") for x in rows.column(1).cast(pa.binary())], pa.binary())], ["doc_id", "packed"])

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        # Rows that repeat a doc_id may differ: only the text that has the wanted set goes on.
        z, shingler = zstandard.ZstdDecompressor(), Shingler(words)
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 50):
                rows = batch.slice(start, 50)
                sets = shingler.sets(pa.array([z.decompress(x.as_py()) for x in rows.column(2)], pa.large_binary()))
                keep += [_class_id(t, len(t)) == (a, b) for a, b, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), sets, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    packed = docs.mapInArrow(tidied(pack), f"doc_id {kind}, packed binary")
    both = packed.join(wanted.hint("shuffle_hash"), "doc_id").select("c.a", "c.b", "packed")
    return both.mapInArrow(tidied(right), "a long, b long, packed binary").select(_id("a", "b").alias("c"), "packed")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) that reach the threshold.  A text goes to its pairs once for each pair, compressed."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, shingler, last, held = zstandard.ZstdDecompressor(), Shingler(words), None, None
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 50):
                rows = batch.slice(start, 50)
                sets = shingler.sets(pa.array([z.decompress(x.as_py()) for x in rows.column(4)], pa.large_binary()))
                for p, q, x, y in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), sets, rows.column(5), strict=True):
                    if (p, q) != last:
                        last, held = (p, q), shingler.tokens(z.decompress(y.as_py()))
                    keep.append(similar(x, held, percent))
            yield batch.select(["a", "b", "p", "q"]).filter(pa.array(keep, pa.bool_()))

    n, m = _size(F.col("c")), _size(F.col("p"))
    fit = pairs.where(100 * F.least(n, m) >= percent * F.greatest(n, m))
    mine = texts.select(F.col("c").alias("c1"), F.col("packed").alias("x"))
    other = texts.select(F.col("c").alias("c2"), F.col("packed").alias("y"))
    both = fit.join(mine, fit["c"] == mine["c1"]).join(other, fit["p"] == other["c2"])
    rows = both.select("c.a", "c.b", F.col("p.a").alias("p"), F.col("p.b").alias("q"), "x", "y")
    return rows.mapInArrow(tidied(check), "a long, b long, p long, q long").select(_id("a", "b").alias("u"), _id("p", "q").alias("v"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), words=3, percent=90)
