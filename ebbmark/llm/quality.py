"""Quality rules: a linear-chain conditional random field marks lines, their content share decides retention."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.llm.common import map_texts, table, whole_texts

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

#: A document stays if at least this share of its words stands in content lines.
CONTENT_SHARE = 0.5
#: The field is fitted on at most so many labelled documents, whole, as runs of at most ``RUN_LINES`` lines; of more than ``FIT_RUNS`` runs, on so many.
FIT_DOCS, RUN_LINES, FIT_RUNS = 3000, 100, 6000
FEATURES = ("one", "length", "symbols", "shouting", "repeats", "exclaims", "digits", "word_length", "closed", "seen", "short")


@dataclass(frozen=True)
class LineField:
    """Weights of a two-state field: what speaks for boilerplate in a line, and between neighbouring lines."""

    emit: tuple[float, ...]
    #: content to content, content to boilerplate, boilerplate to content, boilerplate to boilerplate
    move: tuple[float, float, float, float] = (0.5, -0.5, -0.5, 0.5)

    def decode(self, features: np.ndarray) -> list[int]:
        """The best label sequence (1: boilerplate); at equal scores a line is content."""
        cc, cb, bc, bb = self.move
        content, junk, back = 0.0, 0.0, []
        for i, s in enumerate((features @ np.array(self.emit)).tolist()):
            if i == 0:
                junk = s
                continue
            from_junk, to_junk = junk + bc > content + cc, junk + bb > content + cb
            back.append((from_junk, to_junk))
            content, junk = (junk + bc if from_junk else content + cc), (junk + bb if to_junk else content + cb) + s
        if not len(features):
            return []
        labels = [int(junk > content)]
        for from_junk, to_junk in reversed(back):
            labels.append(int(to_junk if labels[-1] else from_junk))
        return labels[::-1]


#: Used where the labels hold no document of one of the two kinds.
PRIOR = LineField((-3.0, 0.0, 30.0, 4.0, 5.0, 20.0, 1.0, 0.0, -0.5, 1.0, 0.0))


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[float]:
    n, size = len(words), len(line)
    last = words[-1][-1]
    return [
        1.0,
        math.log1p(n) / 5,
        (size - len(line.translate(None, SYMBOLS))) / size,
        sum(map(bytes.isupper, words)) / n,
        1 - len(set(words)) / n if n > 3 else 0.0,
        line.count(b"!") / size,
        (size - len(line.translate(None, b"0123456789"))) / size,
        min(size / n / 10, 3.0),
        float(last in b".!?"),
        float(seen),
        float(n < 4),
    ]


def lines_of(raw: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and numbers of words of the lines that have words, and how many equal an earlier line."""
    features, sizes, seen, equal = [], [], set(), 0
    for line in raw.split(b"\n"):
        words = line.split()
        if words:
            old = line in seen
            equal += old
            seen.add(line)
            features.append(line_features(line, words, old))
            sizes.append(len(words))
    return features, sizes, equal


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def judge(text: str, field: LineField) -> tuple[int, int, int, int, int, bool, bool, int, float, list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, content_share, labels."""
    raw = text.encode()
    words = raw.split()
    features, sizes, equal = lines_of(raw)
    labels = field.decode(np.array(features).reshape(-1, len(FEATURES)))
    total = len(words)
    share = sum(n for n, junk in zip(sizes, labels, strict=True) if not junk) / total if total else 0.0
    repeats = repeated_words(words)
    failed = total < LEAST_WORDS or 100 * repeats > MOST_REPEATED * total
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return total, chars, symbols, equal, repeats, failed, not failed and share >= CONTENT_SHARE, len(sizes), share, labels


def fit_field(docs: DataFrame, labels: DataFrame, *, most_docs: int = FIT_DOCS, most_runs: int = FIT_RUNS) -> LineField:
    """Fit the field on a bounded sample of labelled documents (``labels``: doc_id, quality 1 good or 0 bad).

    The sample is the labelled documents with the smallest hashes of their ids, the same at every run. All lines
    of a text count: a long text is several sequences of ``RUN_LINES`` lines. If the sample holds more than
    ``most_runs`` of them, those with the smallest hashes of id and place are taken, from all over the texts.
    A line starts with its document's label; after a first fit, lines of bad documents that the field holds for
    content are content. Null labels and ids take no part. Without both kinds, ``PRIOR`` is returned.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    texts = whole_texts(docs).join(F.broadcast(sample), "doc_id").select("quality", F.xxhash64("doc_id").alias("of"), "text")

    def rows(c: list[list]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for kind, of, text in zip(*c, strict=True):
            lines = lines_of(text.encode())[0]
            for place, at in enumerate(range(0, len(lines), RUN_LINES)):
                for column, value in zip(out, (kind, of, place, np.array(lines[at : at + RUN_LINES]).tobytes()), strict=True):
                    column.append(value)
        return out

    runs = map_texts(texts, rows, "quality int, of long, place int, features binary")
    runs = runs.orderBy(F.xxhash64("of", "place"), "of", "place").limit(most_runs)
    # bytes, as numbers of their own would take four times the room on the driver
    found = [(r.quality, np.frombuffer(r.features).reshape(-1, len(FEATURES))) for r in runs.select("quality", "features").toLocalIterator()]
    found.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
    if {q for q, _ in found} != {0, 1}:
        return PRIOR
    targets = [np.full(len(x), 1 - q) for q, x in found]
    field = likeliest([x for _, x in found], targets)
    targets = [np.array(field.decode(x)) if q == 0 else y for (q, x), y in zip(found, targets, strict=True)]
    return likeliest([x for _, x in found], targets)


def likeliest(features: list[np.ndarray], targets: list[np.ndarray], steps: int = 120) -> LineField:
    """Maximum likelihood by forward and backward sums over all sequences at once, with a small quadratic penalty."""
    n, longest, width = len(features), max(map(len, features)), len(FEATURES)
    x = np.zeros((longest, n, width))
    y = np.zeros((longest, n), dtype=int)
    for i, (f, t) in enumerate(zip(features, targets, strict=True)):
        x[: len(f), i], y[: len(t), i] = f, t
    sizes = np.array(list(map(len, features)))
    here = np.arange(longest)[:, None] < sizes
    # einsum makes no second array of the size of ``x``
    seen_emit = np.einsum("tnw,tn->w", x, (y * here).astype(float))
    both = here[1:]
    seen_move = np.array([[((y[:-1] == a) & (y[1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
    theta, m, v, total = np.zeros(width + 4), 0.0, 0.0, here.sum()
    for step in range(1, steps + 1):
        emit, move = theta[:width], theta[width:].reshape(2, 2)
        score = np.zeros((longest, n, 2))
        score[:, :, 1] = x @ emit
        a = np.zeros((longest, n, 2))
        b = np.zeros((longest, n, 2))
        a[0] = score[0]
        for t in range(1, longest):
            a[t] = np.where(here[t][:, None], score[t] + np.logaddexp(a[t - 1, :, :1] + move[0], a[t - 1, :, 1:] + move[1]), a[t - 1])
        for t in range(longest - 2, -1, -1):
            later = score[t + 1] + b[t + 1]
            b[t] = np.where(here[t + 1][:, None], np.logaddexp(move[:, 0] + later[:, :1], move[:, 1] + later[:, 1:]), 0.0)
        whole = np.logaddexp(a[-1, :, 0], a[-1, :, 1])
        junk = np.exp(a[:, :, 1] + b[:, :, 1] - whole) * here
        pair = np.exp(a[:-1, :, :, None] + move + (score[1:] + b[1:])[:, :, None, :] - whole[:, None, None]) * both[:, :, None, None]
        gradient = np.concatenate([seen_emit - np.einsum("tnw,tn->w", x, junk), (seen_move - pair.sum((0, 1))).ravel()]) / total - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineField(tuple(theta[:width].tolist()), tuple(theta[width:].tolist()))


def quality(docs: DataFrame, field: LineField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the base counts, ``base_failed``, ``kept``, lines, content share and line labels.

    A document is kept if it passes the base rules and its content lines hold at least half of its words.
    Null, empty and wordless texts have no lines, fail the base rules and go; repeated rows each get their
    row; an empty table gives none; a null id is passed on. No shuffle: each text is judged where it is read.
    """
    schema = (
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, n_lines long, content_share double, junk_lines array<int>"
    )

    def rows(c: list[list]) -> list[list]:
        found = [judge(t, field) for t in c[1]]
        return [c[0], *(map(list, zip(*found, strict=True)) if found else [[]] * 10)]

    return map_texts(whole_texts(docs, id_col, text_col), rows, schema)


def op1(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, fit_field(docs, labels)).drop("junk_lines")


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, all columns as they were.

    Null, empty and wordless texts go; repeated rows and equal ids are judged one by one; nulls in other columns
    and further columns are passed on; an empty table stays empty. A very long text is judged whole.
    """
    field = fit_field(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    types = docs.schema

    def rows(c: list[list]) -> list[list]:
        text = types.names.index("text")
        keep = [judge(t or "", field)[6] for t in c[text]]
        return [[x for x, k in zip(column, keep, strict=True) if k] for column in c]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
    return map_texts(docs, rows, schema)
