"""Personal data: base patterns seed contexts, and sure contexts discover identifiers that no base pattern knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbmark.session import stage

# The kinds in their order and what a text must hold for a match. The patterns equal the plain ones
# of the contract, written so that each run of characters is read once: possessive, and begun only where a
# run begins or the last match ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}

#: Seeds besides the base kinds: long hexadecimal strings, as keys and digests are written.
KEY_SHAPE = r"(?i)^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}$"
#: A pattern is a context: up to so many pieces before an identifier, or one before and one behind it.
LEFT = 3
#: A pattern is followed if so many different known identifiers stand in it, in so large a share of its places; it is
#: sure from the larger share on.
LEAST_SEEDS, LEAST_PART, LEAST_SHARE = 3, 0.05, 0.6
#: Bits that tell which patterns or values may matter, 1 MB in all: a wrong one is counted in vain.
KNOWN_BITS = 1 << 23
#: Pieces of a text in one row of its stream.
BLOCK = 256
#: Where a text is cut into pieces: behind white space, and behind ``:`` or ``=`` before what they name.
CUTS = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])|(?<=[:=])(?=[^\x20\x09-\x0D:=/])"
#: The identifier in a piece: without punctuation around it.
CORE = r"(?s)^([^\p{L}\p{N}@+_]*+)(.*[\p{L}\p{N}_])"


def valid(kind: Column, hit: Column) -> Column:
    """Whether a match of a base pattern is one of its kind."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    turned = F.reverse(digits)
    doubled = F.translate(turned, "0123456789", "0246813579")
    luhn = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda total, i: total + F.when(i % 2 == 1, F.substring(turned, i, F.lit(1))).otherwise(F.substring(doubled, i, F.lit(1))).cast("int"),
    )
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when((kind == "card") & n.between(12, 19), luhn % 10 == 0)
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _matches(kind: str, pattern: str, needs: str) -> Column:
    """All matches of a pattern, each with the length of the text since the one before."""
    hits = F.regexp_extract_all("text_", F.lit(pattern), 0)
    gaps = F.split("text_", pattern, -1)
    listed = F.zip_with(
        hits, F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda hit, gap: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("before"), hit.alias("hit"))
    )
    kind_of = "array<struct<kind:string,before:int,hit:string>>"
    return F.coalesce(F.when(F.col("text_").rlike(needs), listed), F.lit(None).cast(kind_of), F.array().cast(kind_of))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text_"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("second"), text).alias("d2"))


def _base(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents, numbered, and the spans of all base patterns, both written."""
    lists = [_matches(k, PATTERNS[k], NEEDS[k]) for k in KINDS]
    rows = stage(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "d1", "d2", F.concat(*lists).alias("matches")), "pii-matches")
    each = rows.select("row", F.posexplode("matches").alias("i", "m")).select("row", "i", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    place = F.sum("before").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(
        F.sum(F.length("hit")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = each.withColumn("start", place).where(valid(F.col("kind"), F.col("hit")))
    return rows.drop("matches"), stage(placed.select("row", "kind", "start", (F.col("start") + F.length("hit")).alias("end")), "pii-spans")


def _stream(texts: DataFrame) -> DataFrame:
    """Every piece of every text with the digests of the pieces around it: ``doc_id, d1, d2, base, block, j, piece, p1, p2, p3, next``.

    ``block`` holds the pieces of this part of the text, of which ``piece`` is number ``j``, and ``base`` is the length of the text before it.
    """
    whole = texts.select("doc_id", "d1", "d2", F.split("text_", CUTS, -1).alias("pieces"))
    starts = F.sequence(F.lit(0), F.size("pieces") - 1, F.lit(BLOCK))
    sized = whole.withColumn("sizes", F.transform(starts, lambda at: F.length(F.array_join(F.slice("pieces", at + 1, F.lit(BLOCK)), "")).cast("long")))
    before = lambda at: F.aggregate(F.slice("sizes", F.lit(1), (at / BLOCK).cast("int")), F.lit(0).cast("long"), lambda t, x: t + x)
    blocks = sized.select(
        "doc_id",
        "d1",
        "d2",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("pieces") - 1, F.lit(BLOCK)),
                lambda at: F.struct(
                    before(at).alias("base"),
                    F.slice("pieces", at + 1, F.lit(BLOCK)).alias("block"),
                    # with the pieces before and behind, for their digests
                    F.slice("pieces", F.greatest(at - LEFT + 1, F.lit(1)), F.least(at, F.lit(LEFT))).alias("left"),
                    F.slice("pieces", at + BLOCK + 1, F.lit(1)).alias("right"),
                ),
            )
        ).alias("b"),
    ).select("doc_id", "d1", "d2", "b.*")
    digest = lambda pieces: F.transform(pieces, lambda x: F.xxhash64(F.lower(F.rtrim(x, F.lit(" \t\n\x0b\x0c\r")))))
    nothing = F.array_repeat(F.lit(0).cast("long"), F.lit(LEFT) - F.size("left"))
    around = blocks.select("doc_id", "d1", "d2", "base", "block", F.concat(nothing, digest("left"), digest("block"), digest("right"), F.array(F.lit(0).cast("long"))).alias("h"))
    n = F.size("block")
    side = lambda shift: F.slice("h", shift, n)
    zipped = F.arrays_zip(F.col("block").alias("piece"), side(1).alias("p3"), side(2).alias("p2"), side(3).alias("p1"), side(LEFT + 2).alias("next"))
    listed = around.select("doc_id", "d1", "d2", "base", "block", F.posexplode(zipped).alias("j", "x"))
    return listed.select("doc_id", "d1", "d2", "base", "block", "j", F.col("x.piece").alias("piece"), "x.p1", "x.p2", "x.p3", "x.next")


def _with_patterns(stream: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` and the digest of each pattern that stands around a piece."""
    digests = [F.xxhash64(F.lit(1), "p1"), F.xxhash64(F.lit(2), "p2", "p1"), F.xxhash64(F.lit(3), "p3", "p2", "p1"), F.xxhash64(F.lit(4), "p1", "next")]
    return stream.select(*columns, F.explode(F.array(*digests)).alias("pattern"))


def _perhaps(df: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """The rows whose ``name`` may be among ``known``, by one bit of a digest; the table of bits has a fixed size."""
    bit = lambda: F.xxhash64(name).bitwiseAND(F.lit(KNOWN_BITS - 1))
    mask = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))
    bits = known.select(bit().alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(mask(F.col("b"))).alias("bits"))
    sifted = df.join(F.broadcast(bits), F.shiftright(bit(), 6) == F.col("word"))
    return sifted.where(F.col("bits").bitwiseAND(mask(bit())) != 0).select(*df.columns)


def _core(piece: str = "piece") -> Column:
    return F.regexp_extract(piece, CORE, 2)


def is_seed(value: Column) -> Column:
    """Whether an identifier is known by its own form: a base kind in one piece, the begin of a telephone number, or a key."""
    fits = [value.rlike(f"^(?:{PATTERNS[k]})$") & valid(F.lit(k), value) for k in ("email", "ip", "card")]
    return fits[0] | fits[1] | fits[2] | value.rlike(r"^\+[0-9]") | value.rlike(KEY_SHAPE)


def _sum_of(df: DataFrame) -> tuple:
    """Rows and a sum of digests: equal tables have equal ones."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def scored_graph(edges: DataFrame, uses: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sure patterns ``pattern, share`` and learnt identifiers ``value, weight``, both written.

    ``edges(pattern, value, n)`` join patterns and identifiers, ``uses(pattern, uses)`` say how often a pattern stands anywhere, and
    ``seeds(value, weight)`` are known. A pattern's share is the weight of the known identifiers in it by its uses, its support their
    summed weight; an identifier weighs as much as its best sure pattern. Both only grow, and rounds go on
    until no score, to six places, changes.
    """
    known, before = seeds, None
    while True:
        scored = edges.join(known, "value").groupBy("pattern").agg(F.sum("weight").alias("support"), F.sum(F.col("n") * F.col("weight")).alias("hits")).join(uses, "pattern")
        share = F.round(F.least(F.lit(1.0), F.col("hits") / F.col("uses")), 6)
        sure = stage(scored.where((F.round("support", 6) >= LEAST_SEEDS) & (share >= LEAST_SHARE)).select("pattern", share.alias("share")), "pii-sure")
        learnt = stage(edges.join(sure, "pattern").groupBy("value").agg(F.max("share").alias("weight")), "pii-learnt")
        now = _sum_of(sure)
        if now == before:
            return sure, learnt
        before = now
        known = stage(seeds.unionByName(learnt).groupBy("value").agg(F.max("weight").alias("weight")), "pii-known")


def sure_patterns(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pattern, share`` of the patterns that identifiers stand in, and the places ``doc_id, d1, d2, start, value, pattern`` of all that
    were followed; both written. Nothing is found if no pattern was followed.

    Seeds induce patterns, sure patterns teach identifiers, and these induce further patterns wherever they stand, until none is
    new. Only identifiers with a digit, ``@`` or ``_`` do so: a plain word that once stood in a sure pattern stands everywhere. Their places
    are found in one pass, so a further round reads the texts for its new patterns alone. A pattern is counted over all texts
    before it moves, and only if a known identifier stands in it often enough.
    """
    stream = _stream(texts)
    marked = "[0-9@_]"
    spotted = _stream(texts.where(F.col("text_").rlike(marked))).where(F.col("piece").rlike(marked)).withColumn("value", _core()).where(F.col("value").rlike(marked))
    places = stage(_with_patterns(spotted, "value").groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n")), "pii-places")
    seeds = stage(places.select("value").distinct().where(is_seed(F.col("value"))).select("value", F.lit(1.0).alias("weight")), "pii-seeds")
    known, measured, spots, uses = seeds, None, None, None
    start = F.col("base") + F.length(F.array_join(F.slice("block", F.lit(1), F.col("j")), "")) + F.length(F.regexp_extract("piece", CORE, 1))
    while True:
        held = places.join(known, "value").groupBy("pattern").agg(F.sum("weight").alias("support"), F.sum(F.col("n") * F.col("weight")).alias("hits"))
        induced = held.where(F.round("support", 6) >= LEAST_SEEDS)
        if measured is not None:
            induced = induced.join(measured, "pattern", "left_anti")
        induced = stage(induced, "pii-induced")
        if induced.limit(1).count() == 0:
            break
        measured = induced.select("pattern") if measured is None else measured.unionByName(induced.select("pattern"))
        counted = _perhaps(_with_patterns(stream), "pattern", induced).groupBy("pattern").agg(F.count(F.lit(1)).alias("uses"))
        followed = stage(counted.join(induced, "pattern").where(F.col("hits") >= LEAST_PART * F.col("uses")).select("pattern", "uses"), "pii-followed")
        if followed.limit(1).count() == 0:
            break
        found = _perhaps(_with_patterns(stream, "doc_id", "d1", "d2", "base", "block", "j", "piece"), "pattern", followed)
        found = found.select("doc_id", "d1", "d2", start.alias("start"), _core().alias("value"), "pattern").where("value <> ''")
        found = stage(found.join(followed.select("pattern"), "pattern").select("doc_id", "d1", "d2", "start", "value", "pattern"), "pii-spots")
        spots = found if spots is None else spots.unionByName(found)
        uses = followed if uses is None else uses.unionByName(followed)
        edges = stage(spots.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
        sure, learnt = scored_graph(edges, uses, seeds)
        known = stage(seeds.unionByName(learnt).groupBy("value").agg(F.max("weight").alias("weight")), "pii-known")
    if spots is None:
        spark, kind = texts.sparkSession, texts.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], "pattern long, share double"), spark.createDataFrame([], f"doc_id {kind}, d1 long, d2 long, start long, value string, pattern long")
    return sure, spots


def _discovered(texts: DataFrame, rows: DataFrame, base: DataFrame) -> DataFrame:
    """``row, start, end`` of the identifiers in sure patterns that no base span overlaps."""
    sure, spots = sure_patterns(texts)
    # equal rows have equal identifiers: each gets them all
    found = spots.join(sure, "pattern").select("doc_id", "d1", "d2", "start", (F.col("start") + F.length("value")).alias("end")).distinct()
    found = stage(found.withColumnsRenamed({"doc_id": "id", "d1": "e1", "d2": "e2"}), "pii-found")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    placed = rows.join(found, same).select("row", "start", "end")
    known = base.select("row", F.col("start").alias("from"), F.col("end").alias("to"))
    over = (F.col("from") < F.col("end")) & (F.col("to") > F.col("start"))
    return placed.join(known, "row", "left").groupBy("row", "start", "end").agg(F.coalesce(F.bool_or(over), F.lit(False)).alias("known")).where("not known").drop("known")


def spans_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``row, doc_id, d1, d2`` of every input row (d1, d2: digests of its text), and ``row, kind, start, end`` of all spans.

    Base kinds first; identifiers found by their patterns are of kind ``id`` and never overlap a base span. Whole texts are
    read, however long. Null and empty texts have no spans; repeated rows have their own number; an empty table gives empty ones;
    null ids are ids like any other. A pattern is known by a 64-bit digest, and identifiers are compared as written.
    """
    texts = _texts(docs, id_col, text_col)
    rows, base = _base(texts)
    found = _discovered(texts, rows, base)
    return rows, base.unionByName(found.select("row", F.lit("id").alias("kind"), F.col("start").cast(base.schema["start"].dataType), F.col("end").cast(base.schema["end"].dataType)))


def _listed(spans: DataFrame) -> DataFrame:
    """The spans of each row in order: a document's own spans are gathered, no other group."""
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, "id"))), F.col("kind"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, counts per base kind and of discovered identifiers (``n_id``), digest of
    the base spans, and all spans as ``kind:start:end`` in code points, end exclusive."""
    rows, spans = spans_of(docs, id_col=id_col, text_col=text_col)
    joined = rows.join(_listed(spans), "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return joined.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_text_of(F.filter("spans", lambda s: s["kind"] != "id")), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"),
        count("id"),
    )


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each stretch of overlapping spans replaced by its first kind in angle brackets.

    All columns and rows stay, whatever their names; a null text stays null, and empty tables, repeated rows and very long texts
    are treated as in ``spans_of``. Only documents' own spans are gathered. Rows of one id and text share their spans.
    """
    rows, spans = spans_of(docs, id_col=id_col, text_col=text_col)
    listed = rows.join(_listed(spans), "row").groupBy("doc_id", "d1", "d2").agg(F.first("spans").alias("spans"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), docs[id_col].alias("of"), F.xxhash64(text).alias("e1"), F.xxhash64(F.lit("second"), text).alias("e2"))
    joined = held.join(listed, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")), "left")
    own = F.col("whole").getField(text_col)
    # each span is replaced where it begins behind all earlier ones; what overlaps is cut
    reach = F.expr("aggregate(spans, cast(array(0L) as array<bigint>), (ends, s) -> ends || array(greatest(element_at(ends, -1), s.end)))")
    pieces = F.expr(
        """concat(
          concat_ws('', transform(spans, (s, i) -> concat(
            substring(own, int(reach[i] + 1), int(greatest(s.start - reach[i], 0))),
            CASE WHEN s.start >= reach[i] THEN concat('<', s.kind, '>') ELSE '' END))),
          substring(own, int(array_max(reach) + 1)))"""
    )
    marked = joined.select("whole", "spans", own.cast("string").alias("own"), reach.alias("reach"))
    new = F.when(F.col("spans").isNull(), own).otherwise(pieces)
    return marked.select(*((new if c == text_col else F.col("whole").getField(c)).alias(c) for c in docs.columns))


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return personal_data(docs)
