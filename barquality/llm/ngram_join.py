"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles.  With ``D`` the size of the
symmetric difference, a similarity of at least ``p/q`` is exactly
``(q+p) * D <= (q-p) * (|A|+|B|)`` (at 90 of 100: ``19 D <= |A|+|B|``).

1. Equal sets become one class, named by a 64-bit digest of the set.
   A sampled share of all shingles is counted: a set with more shingles of its
   own (found nowhere else) than any link allows links with nothing and is done.
   The repeated ones are known by a bit table of fixed size; where it is
   crowded, fewer sets are done early, and nothing is lost.
2. Sizes fall into bands.  Each class XORs the 64-bit hash of every shingle into
   one word of the sketch of its band (and of the lower bands it can still link
   with).  A changed shingle changes one word, so the Hamming distance of two
   sketches, counted in words or in bits of a one-bit hash, is at most ``D``.
3. A sketch has so many words that two linked sets agree in some of them
   (pigeonhole); sets with too few shared words are taken out.  Words that got no shingle say little; a set with fewer of them
   than the words that must agree leaves them out, and still shares a word with
   whatever it links to.  Every other word is a key.  Keys that occur twice are
   found from packed, pre-combined arrays; only those become rows.
4. The member of a bucket that lies in the most crowded buckets is its pivot;
   each member meets the pivot only, never all others.  Pairs whose parity sketches
   of ``SKETCH_BITS`` single bits are too far apart end there: each shingle flips one
   bit, so the Hamming distance is at most the symmetric difference.  The sets of the
   others are fetched and compared.
5. A bucket whose members are connected by these links is done.  Members of the
   other buckets are joined by prefixes (``_open_pairs``): shingles that several components share
   are ordered by their number, a shingle's place counts those before it, and two
   members of different components meet on a shingle only if as many follow it in
   both as a link takes.  The members of a large group of copies have their own
   shingles first and so drop out before they meet.  Again sketches are compared, then sets.

No link between different texts is lost: its ends are connected through links that
are listed.  Links inside a component that is known already are not all listed.

A class is known by a 64-bit digest of its set; at 10^9 different sets two of them
are expected to share one with a probability of 3%.

Nulls and texts without words have the empty set and link with nothing.  Very
long texts are handled whole; repeated rows and equal texts fall into one
class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, int64_list, mix64, persist_table, pieces, release, slim, text_bytes, word_hashes
from .components import connected_components

#: Upper end of a size band over its lower end.
BAND_RATIO = 1.5
#: Keys that a task combines before it sends them on.
COMBINED = 1_000_000
#: How often keys and classes that cannot be part of a link are taken out; any number is right.
PRUNINGS = 3
#: Low bits of a key's tag, for the least number of shared keys.
TAG_BITS = 20
#: Single bits of the parity sketch that is compared before sets are fetched.
SKETCH_BITS = 1024
#: Upper end of a class of sizes over its lower end, for what a prefix reaches; any number is right.
SIZE_CLASS = 1.05
#: Bits of the table of repeated shingles: 16 MiB, broadcast.
REPEATED_BITS = 1 << 27
#: Bits of the fixed-size filters that keep needless rows out of a shuffle.
FILTER_BITS = 1 << 24


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out = []
    for text in texts:
        tokens = text.lower().split()
        if not tokens:
            out.append(np.zeros(0, np.uint64))
        elif len(tokens) < words:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=1)], np.uint64))
        else:
            h = word_hashes(tokens)
            n = len(tokens) - words + 1
            mixed = np.zeros(n, np.uint64)
            for i in range(words):
                mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
            out.append(np.unique(mixed))
    return out


def digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) if len(shingles) else 0


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch: a bit per slot, flipped by each shingle that falls into it; as 64-bit words."""
    slot = (mix64(shingles + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(slot.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.uint64)


def hamming(one: str, two: str) -> Column:
    """The number of bits in which two sketches differ."""
    return F.expr(f"aggregate(zip_with({one}, {two}, (p, q) -> bit_count(p ^ q)), 0, (n, c) -> n + c)")


class Bands:
    """Size bands, the words of their sketches, and how many of these agree in linked sets."""

    def __init__(self, percent: int, longest: int):
        self.p, self.q = percent, 100
        # smallest size that can link with a different set: one element more or less
        at = next(n for n in range(1, 1_000_000) if self.q * n >= self.p * (n + 1))
        self.low, self.high, self.words, self.agree = [], [], [], []
        while at <= longest:
            end = max(at + 1, int(at * BAND_RATIO))
            partner = (end - 1) * self.q // self.p
            most = (self.q - self.p) * (end - 1 + partner) // (self.q + self.p)
            self.low.append(at)
            self.high.append(partner)
            self.agree.append(2 + most // 12)
            self.words.append(most + self.agree[-1])
            at = end

    def of(self, n: int) -> range:
        """The bands in which a set of this size has keys."""
        last = int(np.searchsorted(self.low, n, "right")) - 1
        first = last
        while first > 0 and self.high[first - 1] >= n:
            first -= 1
        return range(first, last + 1) if last >= 0 else range(0)


def sketch_keys(shingles: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of one set over all its bands, and a tag of each.

    A tag holds the band and how many keys of the band the set shares at least
    with any set it links to.
    """
    keys, tags = [], []
    for band in bands.of(len(shingles)):
        g = bands.words[band]
        word = ((mix64(shingles + np.uint64(band + 1)) >> np.uint64(32)) * np.uint64(g) >> np.uint64(32)).astype(np.int64)
        sketch = np.zeros(g, np.uint64)
        np.bitwise_xor.at(sketch, word, shingles)
        place = np.arange(g, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(32))
        key = mix64(sketch ^ mix64(place))
        empty, agree = np.bincount(word, minlength=g) == 0, bands.agree[band]
        omits = int(empty.sum()) < agree
        keys.append(key[~empty] if omits else key)
        # of the words that must agree, at most those that this set has empty are no keys;
        # a set that leaves none out may meet one that does
        least = agree - int(empty.sum()) if omits else 1
        tags.append(np.full(len(keys[-1]), (band << TAG_BITS) + min(least, (1 << TAG_BITS) - 1), np.int64))
    return (np.concatenate(keys), np.concatenate(tags)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _sketch_rows(words: int, percent: int, share: int, repeated):
    gap = 100 - percent

    def alone(s: np.ndarray) -> bool:
        """Whether the set has more shingles of its own than any link allows."""
        own = sampled(s, share)
        at = own >> np.uint64(64 - REPEATED_BITS.bit_length() + 1)
        bits = repeated.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
        # a partner has at most n * 100 / percent shingles, so they differ in n * gap / percent at most
        return percent * int(len(own) - bits.sum()) > gap * len(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, 1 << 12)
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = shingle_sets(text_bytes(batch.column("text")), words)
                longest = max(map(len, sets), default=0)
                if bands.low and longest >= bands.low[-1]:
                    bands = Bands(percent, 2 * longest)
                nodes = np.array([digest(s) for s in sets], np.uint64).view(np.int64)
                none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                keys, tags = zip(*(none if alone(s) else sketch_keys(s, bands) for s in sets))
                lengths = np.array([len(k) for k in keys])
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(size), pa.array(nodes, mask=size == 0), int64_list(np.concatenate(keys), lengths), int64_list(np.concatenate(tags), lengths)],
                    ["doc_id", "n_shingles", "node", "keys", "tags"],
                )
        release()

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = shingle_sets(text_bytes(batch.column("text")), words)
                nodes = np.array([digest(s) for s in sets], np.uint64).view(np.int64)
                bits = int64_list(np.concatenate([parity_bits(s) for s in sets]), np.full(len(sets), SKETCH_BITS // 64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), int64_list(np.concatenate(sets), np.array([len(s) for s in sets])), bits], ["node", "shingles", "bits"])

    return run


_PACKED = "part int, keys binary"


def _stored_keys(batch: pa.RecordBatch):
    """(node, keys) of stored sketches."""
    keys = batch.column("keys")
    flat, offsets = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(pc.list_value_length(keys).to_numpy(zero_copy_only=False))])
    return ((n, flat[offsets[i] : offsets[i + 1]]) for i, n in enumerate(batch.column("node").to_pylist()))


def sampled(shingles: np.ndarray, share: int) -> np.ndarray:
    """One in ``share`` of the shingles, by their hash; scrambled so that all bits can place them."""
    mixed = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return mixed[mixed % np.uint64(share) == 0]


def _sampled_shingles(words: int, share: int):
    def read(whole: pa.RecordBatch):
        for batch in pieces(whole, "text"):
            for s in shingle_sets(text_bytes(batch.column("text")), words):
                yield digest(s), sampled(s, share)

    return read


def _packed_keys(parts: int, read):
    """Distinct keys of what a task has read, in one array per part of the key space."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held))
        edges = np.searchsorted(keys >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
        edges[-1] = len(keys)
        full = [i for i in range(parts) if edges[i] < edges[i + 1]]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([keys[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary())], ["part", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, nodes = [], 0, set()
        for batch in batches:
            for node, keys in read(batch):
                # the keys of a class count once in a task
                if node in nodes or not len(keys):
                    continue
                nodes.add(node)
                if size + len(keys) > COMBINED and held:
                    yield from doubled(held, packed)
                    held, size = [], 0
                held.append(keys)
                size += len(keys)
                if len(nodes) > COMBINED:
                    nodes.clear()
        if size:
            yield from doubled(held, packed)
        held.clear()
        release()

    def doubled(held: list[np.ndarray], packed) -> Iterator[pa.RecordBatch]:
        """All keys once, and those that two classes of this task share a second time."""
        yield packed(held)
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        if (n > 1).any():
            yield packed([keys[n > 1]])

    return run


def _repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, keys in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist()):
            held.setdefault(part, []).append(np.frombuffer(keys, np.uint64))
    for part in sorted(held):
        keys, n = np.unique(np.concatenate(held.pop(part)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64))], ["key"])


def _repeated_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the bit table in which repeated keys of a part fall: (place, bits)."""
    for batch in _repeated_keys(batches):
        at = batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - REPEATED_BITS.bit_length() + 1)
        at = np.unique(at)
        place, first = np.unique(at >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array([place.astype(np.uint32).tobytes()], pa.binary()), pa.array([bits.tobytes()], pa.binary())], ["place", "bits"])


def repeated_shingles(docs: DataFrame, words: int, share: int) -> np.ndarray:
    """A bit table of the sampled shingles that occur in more than one class (or in copies)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("text").mapInArrow(_packed_keys(parts, _sampled_shingles(words, share)), _PACKED)
    table = np.zeros(REPEATED_BITS // 64, np.uint64)
    for row in packed.repartition(parts, "part").mapInArrow(_repeated_bits, "place binary, bits binary").toLocalIterator(prefetchPartitions=True):
        table[np.frombuffer(row["place"], np.uint32)] |= np.frombuffer(row["bits"], np.uint64)
    return table


def repeated_keys(sketched: DataFrame) -> DataFrame:
    """``key`` of every key that may belong to more than one class (copies in other tasks count too)."""
    parts = int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = sketched.where("node is not null").select("node", "keys").mapInArrow(_packed_keys(parts, _stored_keys), _PACKED)
    return packed.repartition(parts, "part").mapInArrow(_repeated_keys, "key bigint")


def _place(column: str) -> Column:
    return F.xxhash64(column).bitwiseAND(FILTER_BITS - 1)


def _bitmap(values: DataFrame, column: str) -> DataFrame:
    """``_word, _bits``: the bits of all values, at most ``FILTER_BITS / 64`` rows."""
    at = values.select(_place(column).alias("at")).select(F.shiftright("at", 6).alias("_word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    return at.groupBy("_word").agg(F.bit_or("bit").alias("_bits"))


def bit_filter(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may occur in ``values`` (one column of that name).

    A bitmap of ``FILTER_BITS`` bits over hashed values is built by a grouped
    ``bit_or`` and broadcast: at most ``FILTER_BITS / 64`` rows whatever the input,
    so its size is bounded.  It lets some rows through that are not in
    ``values``; an exact join has to follow.
    """

    bits = _bitmap(values, column)
    keyed = df.withColumn("_at", _place(column))
    return (
        keyed.join(F.broadcast(bits), F.shiftright("_at", 6) == F.col("_word"))
        .where(F.expr("shiftright(_bits, cast(_at & 63 as int)) & 1 = 1"))
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


def similar_classes(docs: DataFrame, words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(membership, links, components)`` of ``docs(doc_id, text)``.

    membership: doc_id, n_shingles, node, the class of equal sets (null: no words).
    links: a, b, the nodes of verified pairs.  Every pair of different sets that
    reach the threshold is connected through links; pairs that are connected
    already are not all listed.
    components: node, component of every node of a link; a component is known by one of its nodes.
    """
    docs = slim(docs, "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    # twice as many as a set of its own needs to be told from others
    share = max(1, percent // (2 * (100 - percent)))
    repeated = docs.sparkSession.sparkContext.broadcast(repeated_shingles(docs, words, share))
    sketched = persist_table(docs.mapInArrow(_sketch_rows(words, percent, share, repeated), f"doc_id {kind}, n_shingles bigint, node bigint, keys array<bigint>, tags array<bigint>"), "sketches")
    membership = sketched.select("doc_id", "n_shingles", "node")
    classes = membership.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))

    keyed = sketched.where("node is not null").select(F.explode(F.arrays_zip("keys", "tags")).alias("k"), "node", F.col("n_shingles").alias("n")).select(F.col("k.keys").alias("key"), F.col("k.tags").alias("tag"), "node", "n")
    maybe = persist_table(repeated_keys(sketched), "keys")
    held = persist_table(bit_filter(keyed, maybe, "key").distinct(), "held")
    members = held
    for _ in range(PRUNINGS):
        # keys of two classes, then classes that share as many keys of a band as a link takes
        shared = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
        members = members.join(shared, "key")
        enough = members.groupBy("node", "tag").agg(F.count("*").alias("c")).where(F.col("c") >= F.col("tag").bitwiseAND((1 << TAG_BITS) - 1)).select("node", "tag")
        members = persist_table(members.join(enough, ["node", "tag"]), "members")
    members = members.drop("tag")

    crowd = members.groupBy("key").agg(F.count("*").alias("crowd"))
    central = members.join(crowd, "key").groupBy("node").agg(F.sum("crowd").alias("central"))
    ranked = members.join(central, "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("central", "node", "n")).alias("p")).select("key", F.col("p.node").alias("y"), F.col("p.n").alias("ny"))
    pairs = members.join(pivots, "key").where("node != y").select(F.col("node").alias("x"), F.col("n").alias("nx"), "y", "ny").distinct()
    pairs = persist_table(pairs, "pairs")

    wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    wanted = persist_table(wanted.join(classes, "node").select("node", F.col("rep").alias("doc_id")), "wanted")
    sets = bit_filter(docs, wanted.select("doc_id"), "doc_id").mapInArrow(_set_rows(words), "node bigint, shingles array<bigint>, bits array<bigint>")
    sets = persist_table(sets.join(wanted.select("node"), "node").dropDuplicates(["node"]), "sets")

    first = persist_table(_verified(pairs, sets, percent).select("x", "y"), "links")
    found = persist_table(connected_components(first, "x", "y"), "components")
    second = persist_table(_verified(_open_pairs(members, found, sets, percent), sets, percent), "links")
    links = first.unionByName(second.select("x", "y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    # components that the second links join
    merged = connected_components(second, "cx", "cy").select(F.col("node").alias("component"), F.col("component").alias("_into"))
    alone = merged.join(found, "component", "left_anti").select(F.col("component").alias("node"), F.col("_into").alias("component"))
    joined = found.join(merged, "component", "left").select("node", F.coalesce("_into", "component").alias("component"))
    return membership, links, joined.unionByName(alone)


def _open_pairs(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``x, y, nx, ny, cx, cy``: members of a common bucket, of different components, that may link.

    A link takes ``o`` common shingles with ``(100 + percent) * o >= percent * (nx + ny)``.
    All that two sets share comes after the first that they share, in any order of
    shingles that is the same for both; so at place ``i`` (from 0) of a set of size
    ``n``, a partner has at most ``(100 + percent) * (n - i) / percent - n`` shingles, and no
    place beyond ``n * (100 - percent) / 100`` has one.  Here shingles found in one component
    only come first (their number is enough), then the others from rare to frequent.
    Sizes form classes, and a set looks into the classes that it reaches; members of the component
    that has most of a shingle's places look for nobody, they are looked for.
    """
    gap, total = 100 - percent, 100 + percent
    named = members.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    opened = persist_table(named.join(mixed, "key").select("node", "n", "comp").distinct(), "open")

    elements = opened.join(sets.select("node", "shingles"), "node").select("node", "n", "comp", F.explode("shingles").alias("s"))
    crossing = persist_table(elements.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("s"), "crossing")
    shared = persist_table(bit_filter(elements, crossing, "s").join(crossing, "s"), "shared")
    ranked = shared.join(shared.groupBy("s").agg(F.count("*").alias("c")), "s").groupBy("node", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("k"))
    places = ranked.select("node", "n", "comp", F.expr("n - size(k)").alias("own"), F.posexplode("k")).select("node", "n", "comp", (F.col("own") + F.col("pos")).alias("i"), F.col("col.s").alias("s"))
    places = persist_table(places.where(f"100 * i <= {gap} * n"), "places")

    most = places.groupBy("s", "comp").agg(F.count("*").alias("k")).groupBy("s").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
    size_class = f"int(floor(ln({{}}) / ln({SIZE_CLASS})))"
    index = places.join(most.where("comps > 1").select("s", F.col("top.comp").alias("most")), "s")
    index = persist_table(index.withColumn("class", F.expr(size_class.format("n"))), "index")
    reach = index.where("comp != most").withColumn("least", F.expr(f"({percent} * n + 99) div 100"))
    reach = reach.withColumn("longest", F.expr(f"least(100 * n div {percent}, {total} * (n - i) div {percent} - n)")).where("least <= longest")
    classes = F.expr(f"sequence({size_class.format('least')}, {size_class.format('longest')})")
    p = reach.select("s", F.explode(classes).alias("class"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("comp").alias("cx"))
    q = index.select("s", "class", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("i").alias("iy"), F.col("comp").alias("cy"), (F.col("comp") == F.col("most")).alias("found_only"))
    far = (F.col("cx") != F.col("cy")) & (F.col("found_only") | (F.col("x") < F.col("y")))
    room = F.expr(f"{total} * least(nx - ix, ny - iy) >= {percent} * (nx + ny)")
    met = p.alias("p").join(q.alias("q"), (F.col("p.s") == F.col("q.s")) & (F.col("p.class") == F.col("q.class")) & far & room)
    return persist_table(met.select("x", "y", "nx", "ny", "cx", "cy").distinct(), "candidates")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (``x, y, nx, ny`` and others) that link: first by parity sketches, then by the sets."""
    bits, whole = sets.select("node", "bits"), sets.select("node", "shingles")
    one, two = (t.select(F.col("node").alias("x"), F.col(c).alias("sx")) for t, c in ((bits, "bits"), (whole, "shingles")))
    other, last = (t.select(F.col("node").alias("y"), F.col(c).alias("sy")) for t, c in ((bits, "bits"), (whole, "shingles")))
    near = pairs.join(one, "x").join(other, "y").where(_links(hamming("sx", "sy"), F.col("nx"), F.col("ny"), percent)).select(*pairs.columns)
    near = persist_table(near, "near")
    differ = F.col("nx") + F.col("ny") - 2 * F.size(F.array_intersect("sx", "sy"))
    return near.join(two, "x").join(last, "y").where(_links(differ, F.col("nx"), F.col("ny"), percent)).select(*pairs.columns)


def _links(difference: Column, nx: Column, ny: Column, percent: int) -> Column:
    return (100 + percent) * difference <= (100 - percent) * (nx + ny)


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_size, n_links.

    One row per input row.  ``class_size`` counts the rows with an equal set,
    ``n_links`` the verified links of the class with other sets.
    """
    membership, links, found = similar_classes(docs, words, percent)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = membership.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"))
    named = classes.join(found, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return membership.join(named, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def drop_similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each component.

    Documents without words stay.  Rows that repeat the kept doc_id stay with it.
    """
    found = persist_table(jaccard_components(docs, words, percent), "components")
    dropped = found.where("doc_id != component_id").select(F.col("doc_id")).distinct()
    # only rows that may go are shuffled
    marked = boxed(docs, id=F.col("doc_id"), at=_place("doc_id")).join(F.broadcast(_bitmap(dropped, "doc_id")), F.shiftright("at", 6) == F.col("_word"), "left")
    marked = marked.select("doc", "id", F.expr("coalesce(shiftright(_bits, cast(at & 63 as int)) & 1 = 1, false)").alias("hit"))
    rest = marked.where("hit").join(dropped.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return marked.where("not hit").select("doc.*").unionByName(rest.select("doc.*"))
