"""N-gram Jaccard join: rare shingles are indexed alone, frequent ones in combinations of two from a longer prefix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbmark.llm.common import Scratch, components, map_texts, whole_texts

#: Words of a shingle, and the least similarity in hundredths.
WORDS, SIMILAR = 4, 85
#: A shingle that so many of so many sets in a task share is noted; noted ones with such a total are frequent.
#: Any choice gives the same links, only at another cost, so the list may be bounded: it is broadcast.
NOTED, NOTED_OF, FREQUENT, MOST_FREQUENT = 3, 4000, 9, 500_000
#: Rounds in which each bucket is compared with one member only.
STAR_ROUNDS = 4
#: Least bits of a set's sketch, and how many 64-bit words of it the last round carries along.
SKETCH_BITS, SKETCH_WORDS = 256, 4
#: So many of a set's least bucket keys go along in the last round, to name most pairs once.
LOW_KEYS = 16
#: Bits that tell which texts may be needed, 1 MB in all: a wrong one moves a text in vain.
NEEDED_BITS = 1 << 23
#: Sets that a task remembers as indexed at a time.
INDEXED = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE_STEP = 0xD6E8FEB86659FD93
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of a text; of the whole sequence if it is shorter.

    A word's hash is a polynomial of its bytes: the difference of two running sums, moved to place 0 by an
    inverse power. No word becomes a Python object.
    """

    def __init__(self, words: int) -> None:
        self.words = words
        self._powers(0)

    def __getstate__(self):
        return {"words": self.words}

    def __setstate__(self, state):
        self.words = state["words"]
        self._powers(0)

    def _powers(self, n: int) -> None:
        self.up, self.down = (np.full(max(n, 1 << 16), p, np.uint64) for p in (_BYTE_STEP, pow(_BYTE_STEP, -1, 1 << 64)))
        for powers in (self.up, self.down):
            powers[0] = 1
            np.cumprod(powers, dtype=np.uint64, out=powers)

    def word_hashes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode().lower(), np.uint8)
        n = len(raw)
        if n > len(self.up):
            self._powers(2 * n)
        solid = np.zeros(n + 2, bool)
        np.logical_not(_WHITE[raw], out=solid[1:-1])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.up[:n], dtype=np.uint64, out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.down[starts])

    def of(self, text: str) -> np.ndarray:
        hashes = self.word_hashes(text)
        if not len(hashes):
            return hashes
        size = min(self.words, len(hashes))
        found = np.full(len(hashes) - size + 1, size, np.uint64)
        for i in range(size):
            found = found * _STEP + hashes[i : len(hashes) - size + 1 + i]
        return np.unique(_mixed(found))


def sketch_bits(n: int) -> int:
    """Bits of the sketch of ``n`` shingles: some more than shingles, so that few differences fall on one bit."""
    return max(SKETCH_BITS, 4 << size_class(n))


def sketch(shingles: np.ndarray, bits: int) -> list[int]:
    """For each residue of ``bits``, whether an odd number of shingles has it.

    Two sets differ in at least as many shingles as their sketches differ in bits, which bounds what they share.
    The halves of a sketch, one xor the other, are the sketch of half as many bits.
    """
    odd = np.bincount((shingles >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def least_overlap(n: int, similar: int) -> int:
    """What a set of ``n`` shares with any set it is linked to, at least."""
    return -(-similar * n // 100)


def size_class(n: int) -> int:
    return n.bit_length() - 1


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The rare shingles of a sorted set, its frequent ones, and the length of its prefix.

    All sets are ordered alike: rare shingles first, then frequent ones, each by hash. Linked sets share their
    first common shingle within their prefixes of ``n - least_overlap + 1``.
    """
    often = np.zeros(len(shingles), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        often = frequent[at] == shingles
    return shingles[~often], shingles[often], len(shingles) - least_overlap(len(shingles), similar) + 1


def combinations(shingles: np.ndarray, frequent: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two frequent shingles and the place of the first, for a set whose prefix reaches the frequent ones.

    If the first common shingle of linked sets is frequent, no rare one is common, and within prefixes longer
    by ``g`` they share at least ``g + 1`` frequent ones, so two of these fall into one of ``g`` groups: both
    sets index that pair. ``g`` follows the size class, which keeps the pairs of a set in proportion to it; a
    set whose partners may be of the class below is indexed for both.
    """
    rare, common, prefix = prefix_of(shingles, frequent, similar)
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    n = len(shingles)
    for c in {size_class(n), size_class(least_overlap(n, similar))}:
        groups = max(1, (1 << c) // 8)
        part = common[: prefix + groups - len(rare)]
        group = (part >> np.uint64(13)) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        ordered = group[order]
        for gap in range(1, len(part)):
            same = np.flatnonzero(ordered[gap:] == ordered[:-gap])
            if not len(same):
                break
            first, second = order[same], order[same + gap]
            key = (part[first] * _STEP + part[second]) * _STEP + np.uint64(groups)
            keys.append(key ^ (key >> np.uint64(30)))
            places.append(len(rare) + first)
    return np.concatenate(keys), np.concatenate(places)


def _halved(sketch: str, other: str) -> Column:
    """``sketch`` with as many words as ``other``, whose set is at most one size class smaller."""
    half = F.size(other)
    folded = F.zip_with(F.slice(sketch, 1, half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > half, folded).otherwise(F.col(sketch))


def _words(sketch: str) -> list[Column]:
    """A sketch as ``SKETCH_WORDS`` plain columns."""

    def word(at: int) -> Column:
        own = F.filter(sketch, lambda x, i: i % SKETCH_WORDS == at)
        return F.aggregate(own, F.lit(0).cast("long"), lambda t, y: t.bitwiseXOR(y))

    return [word(at).alias(f"w{at}") for at in range(SKETCH_WORDS)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _set_digest(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


def _perhaps(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The texts that ``needed`` may name, and a few others, found without moving any text.

    One bit of the id's digest is looked up; the table of bits has a fixed size, whatever the number of ids.
    """
    bit = lambda c: F.xxhash64(c).bitwiseAND(F.lit(NEEDED_BITS - 1))
    mask = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))
    bits = needed.select(bit("doc").alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(mask(F.col("b"))).alias("bits"))
    found = texts.withColumn("b", bit("doc_id"))
    found = found.join(F.broadcast(bits), F.shiftright("b", 6) == F.col("word"))
    return found.where(F.col("bits").bitwiseAND(mask(F.col("b"))) != 0).select(*texts.columns)


def ngram_links(
    docs: DataFrame, *, words: int = WORDS, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every row.

    Documents link when ``100 * common >= similar * union`` of their distinct shingles. ``class_id`` is the
    smallest id with the same set, ``component_id`` the smallest id that links reach. Null, empty and wordless
    texts have no shingles and stand alone; repeated rows each get a row and equal ids join their classes; an
    empty table gives no rows. Rows with a null id are linked to others of their class, but stand for none.

    Equal sets are one class in the index. A bucket is never expanded into all its pairs: members are compared
    with one pivot, compared pivots and buckets that hold a single component drop out, and only what is left
    after some rounds is compared across its components. No link is lost. A pair is dropped early only by bounds
    that hold for every link (sizes, places in the prefix, sketches), and counted exactly before it counts.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shingler = Shingler(words)
    scratch = Scratch(spark)

    gathered: dict[tuple[int, int], np.ndarray] = {}

    def note() -> list[list]:
        """One row without a document: the shingles that many of the gathered sets share."""
        found = []
        if gathered:
            values, counts = np.unique(np.concatenate(list(gathered.values())), return_counts=True)
            often = counts >= NOTED
            found = [{"s": s, "n": n} for s, n in zip(_signed(values[often]).tolist(), counts[often].tolist(), strict=True)]
            gathered.clear()
        return [[None], [-1], [0], [0], [[]], [found]]

    def sets(c: list[list]) -> list[list]:
        out: list[list] = [list(c[0]), [], [], [], [], [[] for _ in c[0]]]
        for text in c[1]:
            found = shingler.of(text)
            d1, d2 = _set_digest(found)
            gathered[d1, d2] = found  # copies are one set
            n = len(found)
            for column, x in zip(out[1:5], (n, d1, d2, sketch(found, sketch_bits(n)) if n else []), strict=True):
                column.append(x)
        if len(gathered) >= NOTED_OF:
            for column, x in zip(out, note(), strict=True):
                column += x
        return out

    texts = whole_texts(docs, id_col, text_col)
    schema = f"doc_id {kind}, n_shingles long, d1 long, d2 long, sketch array<long>, noted array<struct<s:long,n:long>>"
    measured = scratch.stage(map_texts(texts, sets, schema, note), "shingle-sets")
    rows = measured.where("n_shingles >= 0")
    classes = rows.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.min("sketch").alias("sketch"))
    classes = scratch.stage(classes, "shingle-classes")
    standing = classes.where("class_id is not null")

    noted = measured.where("n_shingles < 0").select(F.explode("noted").alias("x")).groupBy("x.s").agg(F.sum("x.n").alias("n")).where(F.col("n") >= FREQUENT)
    listed = [r.s for r in noted.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toLocalIterator()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(listed, np.int64).view(np.uint64)))

    done: set[tuple[int, int]] = set()

    def index(c: list[list]) -> list[list]:
        out: list[list] = [[], [], [], []]
        if len(done) > INDEXED:
            done.clear()
        for text in c[0]:
            found = shingler.of(text)
            own = _set_digest(found)
            if own in done or not len(found):
                continue
            done.add(own)
            rare, _, prefix = prefix_of(found, frequent.value, similar)
            keys, places = rare[:prefix], np.arange(min(prefix, len(rare)))
            singles = len(keys)
            if len(rare) < prefix:
                more, of = combinations(found, frequent.value, similar)
                keys, places = np.concatenate([keys, more]), np.concatenate([places, of])
            n = len(keys)
            for column, x in zip(out, (_signed(keys).tolist(), [own[0]] * n, places.tolist(), [i >= singles for i in range(n)]), strict=True):
                column.extend(x)
        return out

    # half a set's digest names it here: should two sets share it, both are in the bucket
    entries = map_texts(texts.select("text"), index, "key long, d1 long, place int, combined boolean")
    # a rare shingle's documents are few and may meet in one task; combinations of frequent ones are spread
    spread = F.when(F.col("combined"), F.pmod("d1", F.lit(256))).otherwise(F.lit(0).cast("long"))
    together = Window.partitionBy("key", "spread")
    counted = entries.withColumn("spread", spread).withColumn("least", F.min("d1").over(together)).withColumn("most", F.max("d1").over(together))
    kept = scratch.stage(counted.where("combined or least <> most").drop("least", "most", "spread"), "shared-shingles")
    # a combination may be held by any share of the documents: partial sums, then a join that can be split
    pairs_of = kept.where("combined")
    shared = pairs_of.groupBy("key").agg(F.min("d1").alias("least"), F.max("d1").alias("most")).where("least <> most").select("key")
    buckets = kept.where("not combined").select(F.xxhash64(F.lit(1), "key").alias("key"), "d1", "place")
    buckets = buckets.unionByName(pairs_of.join(shared, "key").select(F.xxhash64(F.lit(2), "key").alias("key"), "d1", "place"))
    buckets = buckets.join(standing.select("d1", F.col("class_id").alias("doc"), F.col("n_shingles").cast("int").alias("n")), "d1").select("key", "doc", "n", "place").distinct()
    buckets = scratch.stage(buckets, "buckets")
    scratch.drop("shared-shingles")

    def arrays(c: list[list]) -> list[list]:
        out: list[list] = [[], []]
        for doc, d1, d2, text in zip(*c, strict=True):
            found = shingler.of(text)
            if _set_digest(found) == (d1, d2):  # else another row of this id
                out[0].append(doc)
                out[1].append(_signed(found))
        return out

    sketches = standing.select(F.col("class_id").alias("doc"), "sketch")
    sizes = f"100 * least(a.n, b.n) >= {similar} * greatest(a.n, b.n)"
    places = f"(100 + {similar}) * cast(least(a.place, b.place) + 1 + least(a.n - a.place, b.n - b.place) - 1 as bigint) >= {similar} * cast(a.n + b.n as bigint)"
    differ = F.aggregate(F.zip_with(_halved("x", "y"), _halved("y", "x"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    # common <= (n - differ) / 2
    sketch_bound = f"{100 + similar} * (a.n + b.n - differ) >= {2 * similar} * (a.n + b.n)"
    words_differ = " + ".join(f"bit_count(a.w{i} ^ b.w{i})" for i in range(SKETCH_WORDS))
    first_meeting = "coalesce(array_min(array_intersect(a.low, b.low)), a.key) = a.key"
    held = joined = None
    order = F.struct(F.xxhash64("doc").alias("order"), "doc", "n", "place", "part")
    for turn in range(STAR_ROUNDS + 1):
        labelled = buckets.withColumn("part", F.col("doc"))
        if joined is not None:
            labelled = buckets.join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("part", F.coalesce("component", "doc")).drop("component")
            labelled = scratch.stage(labelled, "labelled-buckets")
        # written before it is joined, so that adaptive execution can split a large bucket
        pivots = labelled.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(order).alias("p")).where("low <> high")
        pivots = scratch.stage(pivots.select("key", "p.*"), "pivots")
        if turn < STAR_ROUNDS:
            pivot = pivots.select("key", *(F.col(x).alias(f"p_{x}") for x in ("doc", "n", "place", "part")))
            met = scratch.stage(labelled.join(pivot, "key").where("doc <> p_doc"), "met-pivots")
            of = lambda mark: F.struct(*(F.col(mark + x).alias(x) for x in ("doc", "n", "place", "part")))
            pairs = met.select(of("").alias("a"), of("p_").alias("b")).where(f"a.part <> b.part and {sizes} and {places}")
            left = met.select("key", "doc", "n", "place")
        else:
            # unlike pairs and most repeated ones go inside the join: a large bucket gives its likely pairs only
            labelled = scratch.stage(labelled.join(pivots.select("key"), "key", "left_semi"), "mixed-buckets")
            low = labelled.groupBy("doc").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LOW_KEYS).alias("low"))
            carried = scratch.stage(low.join(sketches, "doc").select("doc", "low", *_words("sketch")), "carried")
            # a large bucket's rows spread over all tasks where the other side is small enough to be sent to each
            labelled = scratch.stage(labelled.join(carried, "doc").repartition(F.col("doc"), F.col("key")), "carrying-buckets")
            likely = sketch_bound.replace("differ", f"({words_differ})")
            pairs = labelled.alias("a").join(labelled.alias("b"), F.col("a.key") == F.col("b.key"))
            pairs = pairs.where(f"a.part < b.part and {sizes} and {places} and {likely} and {first_meeting}")
        near = F.struct(F.col("a.doc").alias("doc"), F.col("a.n").alias("n")), F.struct(F.col("b.doc").alias("doc"), F.col("b.n").alias("n"))
        pairs = pairs.select(F.least(*near).alias("l"), F.greatest(*near).alias("r")).distinct().select(F.col("l.doc").alias("a"), F.col("r.doc").alias("b"), (F.col("l.n") + F.col("r.n")).cast("long").alias("n"))
        pairs = pairs.join(sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("x")), "a")
        pairs = pairs.join(sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("y")), "b")
        pairs = pairs.withColumn("differ", differ).where(sketch_bound.replace("a.n + b.n", "n")).select("a", "b")
        pairs = scratch.stage(pairs, "candidates")
        if pairs.limit(1).count():
            paired = scratch.stage(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "paired")
            needed = paired if held is None else paired.join(held, "doc", "left_anti")
            needed = scratch.stage(needed.join(standing.select(F.col("class_id").alias("doc"), "d1", "d2"), "doc"), "needed")
            wanted = _perhaps(texts, needed).join(needed.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "d1", "d2", "text")
            more = scratch.stage(map_texts(wanted, arrays, f"doc {kind}, shingles array<long>"), f"shingle-arrays-{turn}")
            held = more if held is None else held.unionByName(more)
            own = held.join(paired, "doc", "left_semi")
            both = pairs.join(own.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
            common = F.size(F.array_intersect("x", "y"))
            links = both.where(100 * common >= similar * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()
            if joined is not None:
                links = links.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
            joined = components(links)
        if turn < STAR_ROUNDS:
            buckets = scratch.stage(left, "buckets")
            if buckets.limit(1).count() == 0:
                break

    if joined is None:
        joined = spark.createDataFrame([], f"node {kind}, component {kind}")
    known = classes.drop("sketch").join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    full = rows.select("doc_id", "n_shingles", "d1", "d2").join(known, ["n_shingles", "d1", "d2"], "left")
    return full.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return ngram_links(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; all columns stay.

    Documents without words, and rows with a null id, stay. Of rows with one id, all or none stay.
    """
    linked = ngram_links(docs, words=words, similar=similar, id_col=id_col, text_col=text_col)
    gone = linked.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
