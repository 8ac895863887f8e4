"""Token ids of texts with a public tokenizer file, one distinct piece of text at a time.

Splitting a text in front of certain spaces does not change its ids: no token of these
vocabularies spans such a space. So the tokenizer only sees pieces that a worker has not met
before, and the ids of a batch are gathered from a flat pool of known pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain, repeat

import numpy as np

#: A space with white space on neither side, for texts that also hold other white space.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SIDE_BY_SIDE = re.compile(r"\s\s")
#: How byte-level vocabularies spell bytes: printable ones as they are, the rest from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SPELLING = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}
#: Pieces a worker remembers at most, those it keeps when it forgets the ones it seldom met, and ids of a
#: piece on average. Never changes ids.
POOL_PIECES = 600_000
KEPT_PIECES = 50_000
POOL_IDS = 8
#: Texts are cut into groups of about so many characters; one longer text is a group of its own.
GROUP_CHARS = 1_500_000


class PieceEncoder:
    """``encode(texts)`` gives all ids in one array and the number of ids of each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A vocabulary that drops white space gives one space no id.
        self.keeps_space = bool(self._ids([" "])[0])
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.starts, self.lengths, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self._keep([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _ids(self, pieces: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(list(pieces), add_special_tokens=False)]

    def _as_bytes(self, piece: str) -> str | None:
        """A Latin word as the model spells its bytes, or None if it may be more than one
        pre-token or change in normalisation."""
        word = piece if self.keeps_space else piece.lower()
        if not word.removeprefix(" ").isalpha() or max(word) > "\u024f" or len(word) != len(piece):
            return None
        if not self.keeps_space and word.startswith(" "):
            return None
        return word.encode().decode("latin-1").translate(_BYTE_SPELLING)

    def forget(self) -> None:
        """Keep the pieces met most often, of those met twice. A task ends with it: Spark keeps workers from
        stage to stage, and later stages would bear what is remembered."""
        often = np.argsort(-self.uses[1:], kind="stable")[:KEPT_PIECES] + 1
        often = often[(self.uses[often] > 1) & (np.cumsum(self.lengths[often]) <= POOL_IDS * KEPT_PIECES)]
        slots = np.concatenate([[0], np.sort(often)])  # the empty piece stays in front
        ids, ends = self._gather(slots)
        names = list(self.known)
        names = [names[slot] for slot in slots.tolist()]
        sizes, joined = [len(name) for name in names], "".join(names)
        # Cut out anew when the others are gone: what is kept lies together and pins no memory around it.
        del names
        self.known.clear()
        self.known.update((joined[end - size : end], i) for i, (size, end) in enumerate(zip(sizes, accumulate(sizes), strict=True)))
        self.pool, self.lengths, self.uses = ids, self.lengths[slots], self.uses[slots] // 2
        self.starts = ends - self.lengths

    def _keep(self, pieces: Sequence[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(lengths), np.int64)])
        self.pool = np.concatenate([self.pool, ids])

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in these slots, one after the other, and where each one ends."""
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.arange(total) + np.repeat(self.starts[slots] - (ends - lengths), lengths)], ends

    def _learn(self, missing: list[str]) -> None:
        """A word with one stop or comma behind it is its word's ids and the mark's."""
        marked = [p for p in missing if len(p) > 1 and p[-1] in ".," and p[-2].lower().isalpha()]
        plain = set(missing).difference(marked)
        plain.update(p[:-1] for p in marked)
        plain.update(p[-1] for p in marked)
        plain = [p for p in plain if p not in self.known]
        spelt = {p: b for p in plain if (b := self._as_bytes(p)) is not None}
        others = [p for p in plain if p not in spelt]
        model = self.tokenizer.model
        found = [[t.id for t in model.tokenize(b)] for b in spelt.values()] + self._ids(others)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self._keep([*spelt, *others], np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)
        if marked:
            pairs = np.fromiter((self.known[x] for p in marked for x in (p[:-1], p[-1])), np.int64, 2 * len(marked))
            ids, ends = self._gather(pairs)
            self._keep(marked, ids, np.diff(ends[1::2], prepend=0))

    def _pieces(self, text: str) -> list[str]:
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        if _SIDE_BY_SIDE.search(text):
            first, *rest = _LONE_SPACE.split(text)
            return [first, *(" " + p for p in rest)]
        # Every white space stands alone: a line break is a piece, a space opens one.
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > POOL_PIECES or len(self.pool) > POOL_IDS * POOL_PIECES:
            self.forget()
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self._pieces(text) if "\x00" not in text else [text]
            counts[i] = len(own)
            pieces += own
        slots = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        lacking = np.flatnonzero(slots < 0)
        if len(lacking):
            lacked = [pieces[i] for i in lacking]
            self._learn(list(set(lacked)))
            slots[lacking] = np.fromiter(map(self.known.__getitem__, lacked), np.int64, len(lacked))
        self.uses += np.bincount(slots, minlength=len(self.uses))
        ids, ends = self._gather(slots)
        edges = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], ends])
        return ids, upto[edges[1:]] - upto[edges[:-1]]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget_rare() -> None:
    """What a task ends with: every encoder of this worker forgets the pieces it seldom met."""
    for tool in _encoders.values():
        tool.forget()


def groups(texts: Sequence[str], chars: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) runs of texts of about ``chars`` characters."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
