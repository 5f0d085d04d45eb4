"""Language identification: bit-sliced Bloom filters name, for each letter n-gram, all languages that contain it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.llm.common import map_texts, whole_texts

#: Lengths of the n-grams, with one mark before and behind each word.
LENGTHS = (3, 4)
#: Rows of the filter and rows that an n-gram sets: a language of 50,000 n-grams fills 43 % of them.
ROWS, HASHES = 1 << 18, 3
#: A language contains an n-gram that so many of its documents hold, so large a share of them, and so large a part of
#: the largest share that any language has.
LEAST_DOCS, LEAST_SHARE, LEAST_PART = 2, 0.002, 0.05
#: More languages than this are an error: it bounds the filter, at ROWS * MOST_LANGUAGES / 8 bytes.
MOST_LANGUAGES = 512
#: Code points of a text that are looked up at a time, and n-grams that a learning task holds at a time.
STEP, HELD = 1 << 18, 1 << 21
UNDETERMINED = "und"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and whether it belongs to a word (a letter or a mark)."""
    import unicodedata

    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(0x110000)])
    return kinds == "L", (kinds == "L") | (kinds == "M")


def letters_of(text: str) -> np.ndarray | None:
    """Lower-case code points, each run of others as one 0, with a 0 at both ends; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, inside = _classes()
    if not letter[codes].any():
        return None
    codes = np.concatenate([[np.uint32(0)], np.where(inside[codes], codes, np.uint32(0)), [np.uint32(0)]])
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all n-grams within words, in portions of bounded size."""
    wide = max(LENGTHS) - 1
    for at in range(0, len(codes), STEP):
        part = codes[at : at + STEP + wide].astype(np.uint64)
        for n in LENGTHS:
            windows = min(STEP, len(part) - n + 1)
            if windows <= 0:
                continue
            found, inner = np.full(windows, n, np.uint64), np.ones(windows, bool)
            for i in range(n):
                code = part[i : i + windows]
                found = (found ^ code) * _MULTIPLIER
                if 0 < i < n - 1:
                    inner &= code != 0
            found = found[inner]
            found ^= found >> np.uint64(29)
            yield found * _MULTIPLIER


@dataclass
class LanguageFilter:
    """The filter: row by row the bits of the languages. ``fill`` is the share of rows that each language sets."""

    names: list[str]
    rows: np.ndarray
    fill: np.ndarray

    def hits(self, codes: np.ndarray) -> tuple[int, np.ndarray]:
        """N-grams of a text, and for each language those its filter holds."""
        width = -(-len(self.names) // 8)
        total, found = 0, np.zeros(width * 8, np.int64)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        for hashes in grams(codes):
            total += len(hashes)
            first, step = hashes & np.uint64(ROWS - 1), (hashes >> np.uint64(32)) | np.uint64(1)
            masks = self.rows[first]
            for i in range(1, HASHES):
                masks &= self.rows[(first + np.uint64(i) * step) & np.uint64(ROWS - 1)]
            for byte in range(width):
                found[8 * byte : 8 * byte + 8] += np.bincount(masks[:, byte], minlength=256) @ bits
        return total, found[: len(self.names)]

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language with the most n-grams once those held by chance are taken off, and its part of the two best counts."""
        codes = None if text is None else letters_of(text)
        if codes is None or not self.names:
            return UNDETERMINED, 0.0
        total, held = self.hits(codes)
        chance = self.fill**HASHES
        counts = np.maximum(0.0, (held - total * chance) / np.maximum(1 - chance, 1e-9))
        best = int(np.argmax(counts))  # names stand by falling frequency: the first of equal ones
        top = float(counts[best])
        if top == 0:
            return self.names[best], 0.0
        second = float(np.partition(counts, -2)[-2]) if len(counts) > 1 else 0.0
        return self.names[best], top / (top + second)


def learnt(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """The filter of the languages of ``docs``; rows without a text or a language teach nothing.

    All rows are read. Documents per n-gram and language are counted in each task first. The driver gets the rows of the
    filter only, whose size is fixed by ``ROWS`` and the number of languages.
    """
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).dropna()
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = [r.lang for r in sizes]
    if not names:
        return LanguageFilter([], np.zeros((ROWS, 0), np.uint8), np.zeros(0))
    number = {name: i for i, name in enumerate(names)}
    held: dict[int, list[np.ndarray]] = {}

    def counted() -> list[list]:
        out: list[list] = [[], [], []]
        for lang, parts in held.items():
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            for column, x in zip(out, ([lang] * len(values), values.view(np.int64).tolist(), counts.tolist()), strict=True):
                column += x
        held.clear()
        return out

    def gather(c: list[list]) -> list[list]:
        out: list[list] = [[], [], []]
        for lang, text in zip(*c, strict=True):
            codes = letters_of(text)
            if codes is not None:
                held.setdefault(number[lang], []).append(np.unique(np.concatenate([np.unique(g) for g in grams(codes)] or [np.zeros(0, np.uint64)])))
            if sum(map(len, held.get(number[lang], ()))) > HELD:
                for column, x in zip(out, counted(), strict=True):
                    column += x
        return out

    counts = map_texts(rows, gather, "lang int, gram long, n long", counted).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.element_at(F.array(*(F.lit(float(r.docs)) for r in sizes)), F.col("lang") + 1)
    enough = counts.withColumn("share", share).where((F.col("n") >= LEAST_DOCS) & (F.col("share") >= LEAST_SHARE))
    # an n-gram has at most one entry for each language
    by_gram = enough.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("of"))
    lang = F.explode(F.transform(F.filter("of", lambda x: x["share"] >= LEAST_PART * F.col("top")), lambda x: x["lang"]))
    kept = by_gram.select("gram", lang.alias("lang"))
    first, step = F.col("gram").bitwiseAND(F.lit(ROWS - 1)), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("long"))
    places = F.explode(F.array(*((first + i * step).bitwiseAND(F.lit(ROWS - 1)) for i in range(HASHES))))
    slices = kept.select(places.alias("place"), F.floor(F.col("lang") / 8).cast("int").alias("byte"), F.call_function("shiftleft", F.lit(1), F.col("lang") % 8).alias("bit"))
    table = slices.groupBy("place", "byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros((ROWS, -(-len(names) // 8)), np.uint8)
    found[table["place"].to_numpy(), table["byte"].to_numpy()] = table["bits"].to_numpy().astype(np.uint8)
    fill = np.unpackbits(found, axis=1, bitorder="little")[:, : len(names)].mean(axis=0)
    return LanguageFilter(names, found, fill)


def languages(docs: DataFrame, model: LanguageFilter, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learnt. A text
    with letters but no known n-gram gets the most frequent language with score 0; equal counts go to the more frequent
    language, then by name. Very long texts are looked up in portions; repeated rows and null ids each get a row; an empty
    table gives none; other columns are not read, so none can clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(c: list[list]) -> list[list]:
        judged = [shared.value.judge(text) for text in c[1]]
        return [c[0], [x[0] for x in judged], [x[1] for x in judged]]

    return map_texts(whole_texts(docs, id_col, text_col), rows, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = learnt(docs.where(~held_out(F.col("doc_id"))))
    return languages(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
