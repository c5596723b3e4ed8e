"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

Two pieces are *compatible* if encoding their joined text gives just these two.  A chain
of pieces is the encoding of a text exactly if each piece encodes to itself and all
neighbours are compatible, so each prefix of a text has one last piece.  An automaton
over all pieces gives the pieces that end at each place; the one that is compatible with
the last piece of the prefix before it is stored.  Ids are then read backwards.

Texts are cut where no piece can reach across: between two characters that are neighbours
in no piece.  What lies between two cuts is encoded once and remembered; so are words.

Null text counts as the empty text, which has no ids.  The model has to be of type BPE
with byte fallback, without own normalisation rules and without user-defined pieces;
other models are refused when loaded.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, with_code

SPACE = "▁"
#: Words, and pairs of pieces, that a worker remembers at most.
REMEMBERED = 500_000


class Memory:
    """Keeps what was used of late: when half is full, the older half goes."""

    def __init__(self, size: int) -> None:
        self.half, self.new, self.old = size // 2, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.ids, self.names = {}, names
        self.byte_ids, self.byte_of = {}, {}
        for number, name in enumerate(names):
            if model.is_byte(number):
                self.byte_of[number] = int(name[3:5], 16)
                self.byte_ids[int(name[3:5], 16)] = number
            elif not (model.is_control(number) or model.is_unknown(number) or model.is_unused(number)):
                self.ids[name] = number
        self.unknown = {i for i in range(len(names)) if model.is_unknown(i)}
        self.control = {i for i in range(len(names)) if model.is_control(i)}
        self.special = {*self.byte_of, *self.unknown, *self.control}
        probe = " a\t b\nﬁ①"
        if len(self.byte_ids) != 256 or model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("expected a model with byte fallback and no rules of normalisation")
        score = {name: model.get_score(number) for name, number in self.ids.items() if len(name) > 1}
        # Smaller rank: merged earlier.  Single characters are there from the start.
        order = {value: at for at, value in enumerate(sorted(set(score.values()), reverse=True), 1)}
        self.rank = {name: order[value] for name, value in score.items()}
        shared = {value for value, times in Counter(score.values()).items() if times > 1}
        self.neighbours = {name[at : at + 2] for name in score for at in range(len(name) - 1)}
        # Words stand alone if no piece has a space inside, and lines if none has a break.
        self.simple = not any(pair[1] == SPACE and pair[0] != SPACE or "\n" in pair for pair in self.neighbours)
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        # Pairs with a piece whose rank is shared, or whose merges do not come in the order of
        # ranks, are tested by merging.
        self.uneven = {name for name, value in score.items() if value in shared}
        for name in self.ids:
            chain = self._merge(name)
            if len(chain) == 1:
                self.automaton.add_word(name, (len(name), name))
        self.automaton.make_automaton()
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.tested = 0
        self.words = Memory(REMEMBERED)
        self.texts = {name: str(number) for name, number in self.ids.items()}

    def _merge(self, text: str) -> list[str]:
        """Encode by merging: the pair of best rank first, the leftmost of equals."""
        chain = list(text)
        before = 0
        while len(chain) > 1:
            best, at = min(
                (self.rank.get(chain[i] + chain[i + 1], len(self.names)), i) for i in range(len(chain) - 1)
            )
            if best == len(self.names):
                break
            if len(chain) == 2:
                self.halves[text] = (chain[0], chain[1])
            if best < before:
                self.uneven.add(text)
            before = best
            chain[at : at + 2] = [chain[at] + chain[at + 1]]
        return chain

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge ever crosses from ``left`` to ``right``."""
        found = self.pairs[left].get(right)
        if found is None:
            if self.tested >= REMEMBERED:
                self.pairs.clear()
                self.tested = 0
            self.tested += 1
            found = self.pairs[left][right] = self._apart(left, right)
        return found

    def _apart(self, left: str, right: str) -> bool:
        if left[-1] + right[0] not in self.neighbours:
            return True
        if left in self.uneven or right in self.uneven:
            return self._merge(left + right) == [left, right]
        # Undo merges, the latest first.  ``a`` and ``b`` are what meets at the border at
        # that time.  A crossing merge happens if its turn comes before the one just undone;
        # of equal ranks the one further left comes first.
        rank, a, b = self.rank, left, right
        turn, undone_left = len(self.names), False
        while True:
            crossing = rank.get(a + b)
            if crossing is not None and (crossing < turn or crossing == turn and not undone_left):
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            undone_left = rank.get(a, 0) > rank.get(b, 0)
            if undone_left:
                turn, a = rank[a], self.halves[a][1]
            else:
                turn, b = rank[b], self.halves[b][0]

    def _chain(self, part: str) -> list[str] | None:
        """The pieces of a stretch from its prefix table, or None if a character is no piece."""
        last: list[str | None] = [None] * len(part)
        pairs = self.pairs
        for end, (length, piece) in self.automaton.iter(part):
            if last[end] is None:
                if length > end:
                    last[end] = piece
                elif (before := last[end - length]) is not None:
                    fits = pairs[before].get(piece)
                    if self.compatible(before, piece) if fits is None else fits:
                        last[end] = piece
        chain, end = [], len(part)
        while end:
            piece = last[end - 1]
            if piece is None:
                return None
            chain.append(piece)
            end -= len(piece)
        return chain[::-1]

    def _stretch(self, part: str) -> tuple[str, str]:
        """Decimal ids joined by commas, and the text they decode to."""
        chain = self._chain(part)
        if chain is not None:
            text = self.texts
            return ",".join([text[piece] for piece in chain]), "".join(chain).replace(SPACE, " ")
        ids, cuts = [], [0]
        cuts += [at for at in range(1, len(part)) if part[at - 1 : at + 1] not in self.neighbours]
        for start, end in zip(cuts, [*cuts[1:], len(part)]):
            chain = self._chain(part[start:end])
            if chain is None:  # one character that is no piece
                ids += [self.byte_ids[byte] for byte in part[start:end].encode("utf-8")]
            else:
                ids += [self.ids[piece] for piece in chain]
        return ",".join(map(str, ids)), self._plain(ids)

    def _word(self, word: str) -> tuple[str, str]:
        """Like ``_stretch``, remembered; last marks that stand alone are cut off before."""
        known = self.words.get(word)
        if known is None:
            end = len(word)
            while end > 1 and not word[end - 1].isalnum() and word[end - 2 : end] not in self.neighbours:
                end -= 1
            if end < len(word):
                parts = [self._remembered(word[:end]), *map(self._remembered, word[end:])]
                known = ",".join([part[0] for part in parts]), "".join([part[1] for part in parts])
            else:
                known = self._stretch(word)
            self.words.put(word, known)
        return known

    def _remembered(self, part: str) -> tuple[str, str]:
        """``_stretch`` of a head or of one mark."""
        known = self.words.get(part)
        if known is None:
            known = self._stretch(part)
            self.words.put(part, known)
        return known

    def _plain(self, ids: list[int]) -> str:
        """Text of ids: pieces as they are, runs of byte pieces as UTF-8."""
        if not self.special.intersection(ids):
            return "".join(map(self.names.__getitem__, ids)).replace(SPACE, " ")
        out, raw = [], bytearray()
        for number in [*ids, None]:
            if number in self.byte_of:
                raw.append(self.byte_of[number])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if number is not None:
                out.append(" ⁇ " if number in self.unknown else "" if number in self.control else self.names[number])
        return "".join(out).replace(SPACE, " ")

    def _cut(self, text: str) -> list[str]:
        """Stretches that are encoded by themselves; joined they give the text with marked spaces."""
        if self.simple and text and text[0] != " " and "  " not in text and SPACE not in text:
            marked = SPACE + text.replace(" ", " " + SPACE)
            return [word for word in marked.replace("\n", " \n ").split(" ") if word]
        if not text:
            return []
        text, cuts = SPACE + text.replace(" ", SPACE), [0]
        cuts += [at for at in range(1, len(text)) if text[at - 1 : at + 1] not in self.neighbours]
        return [text[start:end] for start, end in zip(cuts, [*cuts[1:], len(text)])]

    def _each(self, text: str) -> list[tuple[str, str]]:
        words = self._cut(text)
        found = list(map(self.words.new.get, words))
        if None in found:
            found = [known or self._word(word) for known, word in zip(found, words)]
        return found

    def encode(self, text: str) -> list[int]:
        return [int(number) for part, _ in self._each(text) for number in part.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts in front is taken away."""
        return self._plain(ids).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        parts = self._each(text)
        ids = ",".join([part[0] for part in parts])
        plain = "".join([part[1] for part in parts]).removeprefix(" ")
        return (
            ids.count(",") + 1 if ids else 0,
            hashlib.sha256(ids.encode("ascii")).hexdigest(),
            hashlib.sha256(plain.encode("utf-8")).hexdigest(),
        )


@cache
def codec(path: str) -> Codec:
    """One codec per worker and model; what it remembers serves all tasks of the worker."""
    return Codec(path)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the whole text of every document as ids."""
    with_code(documents.sparkSession)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(codec(path).encode)

    return documents.select("doc_id", encode(text_or_empty()).alias("ids"))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text: back from ids."""
    with_code(rows.sparkSession)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda row: codec(path).decode(list(row)))

    return rows.select("doc_id", decode("ids").alias("text"))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    with_code(documents.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(
                [codec(path).digest(text) for text in texts],
                columns=["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select("doc_id", digest(text_or_empty()).alias("out")).select("doc_id", "out.*")
