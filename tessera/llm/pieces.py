"""SentencePiece encoding and decoding: a streaming Viterbi search over piece boundaries."""

from __future__ import annotations

import re
import string
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship

SPACE = "▁"
#: Texts are encoded together until they hold so many distinct words, or characters.
DISTINCT, TOGETHER = 400_000, 16 << 20
#: Pairs of pieces that a worker remembers; a full memory starts anew.
PAIRS = 1_000_000
NEVER = 1 << 60
_LETTERS = "a-zA-Z\u00c0-\u024f"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A SentencePiece model's pieces and the searches over them.

    The model merges neighbouring pieces by score. Of such an encoding each pair of neighbours is itself an encoding, and each
    prefix of a text has exactly one last piece: the one that can follow the last piece of the text before it. So the best path to
    a position needs one backpointer, and positions further back than the longest piece can't be reached any more.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(names))]
        self.bytes = {int(names[i][1:-1], 16): i for i in range(len(names)) if sp.is_byte(i)}
        self.ids = {n: i for i, n in enumerate(names) if not special[i] and not sp.is_byte(i)}
        order = sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True)
        place = {x: k for k, x in enumerate(order)}
        self.rank = {n: place[sp.get_score(i)] for n, i in self.ids.items()}
        #: Ranks from here on are those of runs of spaces; every other piece of two characters or more has a rank of its own.
        self.shared = min((r for n, r in self.rank.items() if n.strip(SPACE) == "" and len(n) > 1), default=len(order))
        others = [r for n, r in self.rank.items() if len(n) > 1 and n.strip(SPACE)]
        if len(set(others)) < len(others) or max(others, default=-1) >= self.shared and self.shared < len(order):
            self.shared = -1  # no order to undo: can_follow() merges
        # a word ends where no piece can reach on: before a space, around a character of no piece, and between a letter and a mark that follow each other in no piece
        follow = {c for n in self.ids for c in re.findall(f"(?<=[{_LETTERS}]).", n, re.S)}
        held = set("".join(self.ids))
        marks = "".join(re.escape(c) for c in string.punctuation if c not in follow)
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in held)
        own = f"[{alone}]|" if alone else ""
        mark = f"|(?<![{_LETTERS}])[{marks}]" if marks else ""
        self.words = re.compile(f"{own}{SPACE}*[^{SPACE}{alone}](?:[^{SPACE}{alone}{marks}]++{mark})*+|{SPACE}+").findall
        self.split: dict[str, tuple[str, str] | None] = {}
        self.longest = max(map(len, self.ids))
        if any(SPACE in n.lstrip(SPACE) for n in self.ids) or len(self.bytes) != 256 or len(names) > 1 << 16:
            raise ValueError("only models with byte fallback whose pieces hold spaces in front are supported")
        text = [b"" if special[i] else bytes([int(n[1:-1], 16)]) if sp.is_byte(i) else n.encode() for i, n in enumerate(names)]
        self.blob, self.size = np.frombuffer(b"".join(text), np.uint8), np.array(list(map(len, text)), np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.follows: dict[int, bool] = {}
        self.names, self.length = names, list(map(len, names))
        self.edge = "\ud800"  # ends a text: no character, so that no text holds it
        self.pieces = ahocorasick.Automaton()
        for n, i in self.ids.items():
            if len(n) == 1 or self.merge(n) == [n]:  # pieces that encode to themselves; no other is ever used
                self.pieces.add_word(n, i)
        self.pieces.make_automaton()

    def merge(self, text: str) -> list[str]:
        """Encoding of a short text by its definition: merge the pair of best score, the leftmost of equals, while there is one."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1], NEVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, a: str) -> tuple[str, str] | None:
        """The last merge that makes a piece, if it encodes to itself by merges of ever worse rank; else None. Pieces of spaces alone share a rank, so none of them."""
        if (known := self.split.get(a, 0)) != 0:
            return known
        parts, rank, worst, out = list(a), self.rank, -1, None
        while len(parts) > 1:
            ranks = [rank.get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == NEVER or best < worst or best >= self.shared:
                break
            at, worst = ranks.index(best), best
            out = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.split[a] = out = out if len(parts) == 1 else None
        return out

    def can_follow(self, a: int, b: int) -> bool:
        """Is [a, b] the encoding of their joined text? Both must encode to themselves.

        At the border, merges are undone from the last one. A merge over the border that would have come before the one undone makes the
        answer no; if all are undone, it is yes. Of equal ranks the left one comes first.
        """
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        known = self.follows[a << 16 | b] = self._can_follow(self.names[a], self.names[b])
        return known

    def _can_follow(self, a: str, b: str) -> bool:
        rank, limit, x, y = self.rank, NEVER, a, b
        while True:
            if rank.get(x + y, NEVER) < limit:
                return False
            p, q = rank[x] if len(x) > 1 else -1, rank[y] if len(y) > 1 else -1
            if p < 0 and q < 0:
                return True
            parts = self.halves(x if p > q else y)
            if parts is None:
                return self.merge(a + b) == [a, b]
            if p > q:
                limit, x = p, parts[1]
            else:
                limit, y = q + 1, parts[0]

    def stream(self, parts: Iterable[str]) -> Iterator[tuple[list[int], bool]]:
        """Streaming Viterbi search over texts that come in parts, each text ended by `edge`: (ids, does the text end here), each as soon as certain.

        A text is what follows the space in front. The window holds, for each position after the last commit, the last piece of the best (the only) path to it; a character of no
        piece is its code point, below zero. An automaton names the pieces that end at a position, longest first; the first that can follow the path
        to its own start is the position's. At the end of a text all paths meet. Before it, when the window is twice as long as the longest
        piece, the paths to all positions that a later piece can start at are followed back; where they meet, the ids before are committed.
        """
        length, known, can_follow, edge, most = self.length, self.follows.get, self.can_follow, self.edge, 2 * self.longest
        base, reach, window, found = 0, most, [-1], None
        at = 0  # the first character that no piece of the window ends at, counted over all parts, as `end` is; window[0] stands for the text before base
        for part in parts:
            first, stop = at, at + len(part)
            if found is None:
                found = self.pieces.iter(part)
            else:
                found.set(part)
            for end, piece in chain(found, ((stop, -1),)):
                if end < at:
                    continue  # a longer piece ends here
                while end > at:  # what lies between is no piece's: ends of texts, unknown characters
                    c = part[at - first]
                    at += 1
                    if c == edge:
                        yield self._back(window, len(window) - 1), True
                        base, reach, window = at, most, [-1]
                    else:
                        window.append(-2 - ord(c))
                if piece < 0:
                    break
                if (j := end + 1 - base - length[piece]) < 0:
                    continue  # it reaches back over a commit, which all paths pass
                if (before := window[j]) >= 0:
                    can = known(before << 16 | piece)
                    if not (can_follow(before, piece) if can is None else can):
                        continue
                window.append(piece)
                at += 1
                if at - base >= reach:
                    if meet := self._meeting(window, at - base):
                        yield self._back(window, meet), False
                        base, window = base + meet, window[meet:]
                    reach = most if meet else 2 * reach

    def _meeting(self, window: list[int], end: int) -> int:
        """The last position, 0 if there is none, that the paths to `end` and to all positions that a later piece can start at have in common."""
        length, path, i = self.length, set(), end
        while i > 0:
            path.add(i)
            i -= length[window[i]] if window[i] >= 0 else 1
        meet = end
        for i in range(end - self.longest + 1, end):
            while i > 0 and i not in path:
                i -= length[window[i]] if window[i] >= 0 else 1
            meet = min(meet, i)
        return max(0, meet)

    def _back(self, window: list[int], end: int) -> list[int]:
        """Ids of the path to a position; characters of no piece are the ids of their bytes."""
        out, length = [], self.length
        while end > 0:
            if (p := window[end]) >= 0:
                out.append(p)
                end -= length[p]
            else:
                out += [self.bytes[b] for b in reversed(chr(-2 - p).encode())]
                end -= 1
        out.reverse()
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one behind the other, and how many each has: each word is a text of the stream."""
        ids: list[int] = []
        ends: list[int] = []
        for out, is_end in self.stream((self.edge.join(words) + self.edge,) if words else ()):
            ids += out
            if is_end:
                ends.append(len(ids))
        return np.array(ids, "<u2"), np.diff(np.array(ends, np.int64), prepend=0)

    def encode_texts(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For ever so many texts in turn: their ids one behind the other, and how many each has. A text gets a space in front; nothing else is normalised.

        All paths meet at a word's end, so equal words have equal ids, and a turn's distinct words are searched once.
        """
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        held, size = [], 0

        def turn() -> tuple[np.ndarray, np.ndarray]:
            ids, n = self.encode_words(list(index))
            start, at = np.cumsum(n) - n, np.concatenate(held)
            counts = n[at]
            ends = np.cumsum(counts)
            out = ids[np.repeat(start[at] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
            return out, np.diff(np.concatenate([[0], ends])[np.cumsum([0, *map(len, held)])])

        for t in texts:
            words = self.words(SPACE + t.replace(" ", SPACE)) if t else []
            held.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            size += len(t or "")
            if len(index) >= DISTINCT or size >= TOGETHER:
                yield turn()
                index.clear()
                held, size = [], 0
        if held:
            yield turn()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text (two bytes each)."""
        return next(self.encode_texts([text]))[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces join to characters (what is no UTF-8 becomes U+FFFD), the space in front goes."""
        parts = []
        for first in range(0, len(ids), 1 << 18):
            own = ids[first : first + (1 << 18)]
            n = self.size[own]
            ends = np.cumsum(n, dtype=np.int32)
            parts.append(self.blob[np.repeat(self.start[own] - ends + n, n) + np.arange(ends[-1], dtype=np.int32)].tobytes())
        out = b"".join(parts).decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if out[:1] == " " else out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id", model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, n_ids, round_trip) for every row of docs.

    ids are those of the model's own library; round_trip: decoding gives the text again (a space for each U+2581). Null and
    empty texts have no ids; texts are encoded whole; repeated rows come back repeated; a null id stays null; an empty table gives
    an empty result; extra columns don't matter.
    """
    ship(docs.sparkSession)
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, waiting = pieces(path), deque()

        def texts() -> Iterator[str | None]:
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    waiting.append((i, t := t.as_py()))
                    yield t

        for ids, n in p.encode_texts(texts()):
            ends = np.cumsum(n)
            for first in range(0, len(n), 100):
                own = [waiting.popleft() for _ in range(min(100, len(n) - first))]
                last = first + len(own)
                begin = int(ends[first] - n[first])
                part, offsets = ids[begin : ends[last - 1]], np.concatenate([[0], ends[first:last] - begin])
                same = [p.decode(part[s:e]) == (t or "").replace(SPACE, " ") for (_, t), s, e in zip(own, offsets[:-1], offsets[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(part.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), lists, pa.array(n[first:last]), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, ids: str = "ids", id_col: str = "doc_id", model: str | None = None) -> DataFrame:
    """(doc_id, text) for every row of encoded; null ids give a null text, no ids an empty one, null elements none."""
    ship(encoded.sparkSession)
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            texts = [None if x is None else p.decode(np.array([i for i in x if i is not None], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
