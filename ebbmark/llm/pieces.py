"""SentencePiece encoding and decoding: an automaton over the pieces drives a single-pass Viterbi search."""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ebbmark.llm.common import map_texts, whole_texts

MARK = "▁"
#: Parts whose encoding a task remembers in each of two generations (besides those of the text at hand), and the most characters of such a part:
#: together they bound the memory.
KNOWN_PARTS, LONGEST_KNOWN = 200_000, 48
#: Spaces and the word behind them.
WORDS = re.compile(" +[^ ]*")
#: How far a character outside the pieces lies below the lowest piece score.
UNKNOWN_GAP = 10.0
#: What an unknown piece decodes to, as the public library writes it.
UNKNOWN_TEXT = " ⁇ "


class PieceCodec:
    """Best-scored segmentation of a text into the pieces of a model, and back.

    The automaton reports, at each character, every piece that ends there (its output links); each one relaxes
    the best score of that position. A character that no piece covers becomes its UTF-8 byte pieces; in a model
    without all 256 of them, a run of such characters becomes one unknown piece, which does not decode to them. Equal
    scores prefer the longer last piece. Where no piece has a space mark behind another character, the best
    segmentation of a text is that of its parts (spaces and the word behind them, cut at characters that no piece
    joins to others), which are remembered.
    """

    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        #: text, score and kind (``normal``, ``byte``, ``unknown`` or other) by id.
        self.pieces = pieces

    def __getstate__(self):
        return {"pieces": self.pieces}

    @classmethod
    def of_model(cls, path: str) -> PieceCodec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "other" if m.is_control(i) or m.is_unused(i) else "normal"
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind == "normal":
                found.add_word(piece, (len(piece), score, i))
        found.make_automaton()
        return found

    @cached_property
    def bytes_of(self) -> dict[int, int]:
        return {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(self.pieces) if kind == "byte"}

    @cached_property
    def unknown_id(self) -> int | None:
        """The unknown piece of a model that cannot spell every byte, else none."""
        if len(self.bytes_of) == 256:
            return None
        found = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == "unknown"), None)
        if found is None:
            raise ValueError("the model has neither a piece for every byte nor an unknown piece")
        return found

    @cached_property
    def unknown_score(self) -> float:
        return min(score for _, score, kind in self.pieces if kind == "normal") - UNKNOWN_GAP

    @cached_property
    def by_part(self) -> bool:
        normal = {piece for piece, _, kind in self.pieces if kind == "normal"}
        # a mark that is no piece could lie inside a run of unknown characters
        return (self.unknown_id is None or MARK in normal) and not any(MARK in piece.lstrip(MARK) for piece in normal)

    @cached_property
    def _parting(self) -> re.Pattern:
        """What a part is: spaces and a run of characters that pieces join, directly or by way of others, or one that none joins."""
        if self.unknown_id is not None:  # a run of unknown characters is one piece
            return WORDS
        group: dict[str, set[str]] = {}
        for piece, _, kind in self.pieces:
            core = set(piece.lstrip(MARK))
            if kind == "normal" and len(piece.lstrip(MARK)) > 1:
                for other in [group[c] for c in core if c in group]:
                    core |= other
                group.update(dict.fromkeys(core, core))
        runs = {id(g): "[" + "".join(map(re.escape, sorted(g))) + "]+" for g in group.values()}
        alone = "[^ " + "".join(map(re.escape, sorted(group))) + "]"
        return re.compile(f" *(?:{'|'.join([*sorted(runs.values(), key=len, reverse=True), alone])})| +")

    @cached_property
    def _sizes(self) -> list[int]:
        return [len(piece) for piece, _, _ in self.pieces]

    @cached_property
    def _known(self) -> dict[str, tuple[float, bytes]]:
        return {}

    @cached_property
    def _known_before(self) -> dict[str, tuple[float, bytes]]:
        return {}

    def search(self, marked: str) -> tuple[float, array]:
        """Score and ids of the best segmentation of a text with space marks."""
        unknown = self.unknown_score
        best, last = [0.0], [-1]  # the best score up to each position, and the piece that ends there
        done, top = 0, 0.0
        for at, (length, score, i) in self.automaton.iter(marked):
            while done <= at:  # a position begins with its unknown-character step
                done += 1
                top += unknown
                best.append(top)
                last.append(-1)
            total = best[done - length] + score
            # the longest of the pieces that end here comes first
            if total >= top and (total > top or last[done] < 0 and length > 1):
                best[done] = top = total
                last[done] = i
        n = len(marked)
        while done < n:
            done += 1
            top += unknown
            best.append(top)
            last.append(-1)
        ids, end, after, sizes, unknown_id = [], n, n, self._sizes, self.unknown_id
        while end:
            i = last[end]
            if i >= 0:
                ids.append(i)
                after, end = end, end - sizes[i]
                continue
            if unknown_id is None:
                ids.extend(self.bytes_of[b] for b in reversed(marked[end - 1 : end].encode()))
            elif end == n or last[after] >= 0:
                ids.append(unknown_id)
            after, end = end, end - 1
        ids.reverse()
        return best[n], array("i", ids)

    def encode(self, text: str) -> tuple[float, array]:
        """Score and ids of ``text``; the empty text has none. One space mark is put before a text."""
        if not text:
            return 0.0, array("i")
        if not self.by_part:
            return self.search(MARK + text.replace(" ", MARK))
        parts = (WORDS if MARK in text else self._parting).findall(" " + text)
        if len(self._known) >= KNOWN_PARTS:  # what is not met again goes with the next change
            self._known, self._known_before = {}, self._known
        known, before = self._known, self._known_before
        # the parts of this text stay in ``known`` until it is put together
        long = []
        for part in set(parts).difference(known):
            found = before.get(part)
            if found is None:
                score, ids = self.search(part.replace(" ", MARK))
                found = score, ids.tobytes()
                if len(part) > LONGEST_KNOWN:
                    long.append(part)
            known[part] = found
        scores, ids = zip(*map(known.__getitem__, parts))
        for part in long:
            del known[part]
        return sum(scores), array("i", b"".join(ids))

    @cached_property
    def _digits(self) -> list[str]:
        return list(map(str, range(len(self.pieces))))

    def joined(self, ids) -> str:
        """The ids in digits, comma-joined."""
        return ",".join(map(self._digits.__getitem__, ids))

    @cached_property
    def _as_bytes(self) -> list[bytes]:
        texts = {"byte": lambda p: bytes([int(p[3:5], 16)]), "unknown": lambda p: UNKNOWN_TEXT.encode()}
        return [texts.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in self.pieces]

    def decode(self, ids) -> str:
        """The text of ``ids``, without the space put before it; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self._as_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode_texts(docs: DataFrame, codec: PieceCodec, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, score`` for every row. Null and empty texts have no ids and score 0; each repeated row
    gets its row; an empty table gives none. There is no shuffle."""

    def rows(c: list[list]) -> list[list]:
        scores, ids = zip(*map(codec.encode, c[1]), strict=True) if c[1] else ((), ())
        return [c[0], ids, scores]

    return map_texts(whole_texts(docs, id_col, text_col), rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, score double")


def decode_ids(encoded: DataFrame, codec: PieceCodec, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of every row of ids; null ids decode to the empty text."""
    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return map_texts(rows, lambda c: [c[0], [codec.decode(i or ()) for i in c[1]]], f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pieces, score and the digest of the ids (comma-joined) of every document, and whether they decode to it."""
    import public_tokenizers

    codec = PieceCodec.of_model(public_tokenizers.path("piece_bpe_32k.model"))

    def rows(c: list[list]) -> list[list]:
        out: list[list] = [c[0], [], [], [], []]
        for text in c[1]:
            score, ids = codec.encode(text)
            out[1].append(len(ids))
            out[2].append(score)
            out[3].append(hashlib.sha256(codec.joined(ids).encode()).hexdigest())
            out[4].append(codec.decode(ids) == text)
        return out

    return map_texts(whole_texts(docs), rows, "doc_id long, n_pieces long, score double, ids_sha256 string, round_trip boolean")
