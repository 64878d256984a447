"""Byte-pair encoding of piece models by a prefix table.

For each prefix of a string the encoding ends in exactly one token, and the
encoding of a longer prefix extends that of a shorter one. So it is enough to store
the last token of each prefix. Candidates are the pieces that an automaton finds to
end there; the right one is the piece whose neighbour, the stored last token of the
prefix before it, is compatible with it: merged alone, the two stay apart. Ids are
then recovered backwards from the end.

A text may be cut wherever no piece spans the cut, here before each run of spaces
and around line ends, so each distinct chunk is worked out once and then looked up.
A full look-up table is replaced, which costs time and changes nothing.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import ahocorasick
import sentencepiece

SPACE = "▁"
#: Chunks in a worker's table before a new one is begun; the one before is kept.
REMEMBER = 200_000


class PieceModel:
    """Pieces, scores and byte ids of a model file, with the pair test."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.is_byte: list[bool] = []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece, raw, byte = sp.id_to_piece(i), b"", False
            if sp.is_byte(i):
                raw, byte = bytes([int(piece[3:5], 16)]), True
                self.byte_ids[raw[0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = piece.replace(SPACE, " ").encode()
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
            self.bytes_of.append(raw)
            self.is_byte.append(byte)
        self._pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:  # others are never the result of merges
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        inner = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        if any(x[1] == SPACE and x[0] != SPACE for x in inner) or any("\n" in p for p in self.ids):
            raise ValueError("pieces of this model span words or lines")

    def merged(self, text: str) -> list[str]:
        """The merges as defined: best score first, then leftmost. For short strings."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """True if the two tokens stay apart when only they are merged."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBER:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def last_tokens(self, chunk: str) -> list[str]:
        """Entry i: the last token of the encoding of chunk[:i + 1]."""
        last: list[str] = []
        known, done = self._pairs.get, 0
        for end, piece in self.automaton.iter(chunk):
            if end < done:
                continue
            while done < end:  # a character without a piece stands for its bytes
                last.append(chunk[done])
                done += 1
            before = end - len(piece)
            if before >= 0:
                apart = known((last[before], piece))
                if not (self.compatible(last[before], piece) if apart is None else apart):
                    continue
            last.append(piece)
            done += 1
        last.extend(chunk[done:])
        return last

    def ids_of(self, token: str) -> list[int]:
        i = self.ids.get(token)
        return [i] if i is not None else [self.byte_ids[b] for b in token.encode()]

    def chunk_ids(self, chunk: str) -> list[int]:
        last, ids, out, i = self.last_tokens(chunk), self.ids, [], len(chunk)
        while i:
            token = last[i - 1]
            if token in ids:
                out.append(ids[token])
            else:
                out += reversed(self.ids_of(token))
            i -= len(token)
        return out[::-1]

    def chunk_counts(self, chunk: str) -> list[int]:
        """Entry i: the number of tokens of chunk[:i + 1]."""
        counts = [0]
        for i, token in enumerate(self.last_tokens(chunk), 1):
            counts.append(counts[i - len(token)] + len(self.ids_of(token)))
        return counts[1:]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, one leading space goes, broken bytes become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if self.bytes_of[i]), None)
        if first is not None and not self.is_byte[first] and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """UTF-8 in which each byte that belongs to no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        i += n
    return "".join(out)


@lru_cache(maxsize=4)
def load(model_file: str) -> PieceModel:
    """One model for each worker process and file."""
    return PieceModel(model_file)


_RUNS = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")


class Chunks(dict):
    """Chunk -> packed answer, worked out at the first look-up."""

    def __init__(self, answer):
        super().__init__()
        self.answer = answer
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.answer(key)
        self[key] = value
        return value

    def keep_small(self) -> None:
        """A full table becomes the one before, so that frequent chunks outlive it."""
        if len(self) > REMEMBER:
            self.before = dict(self)
            self.clear()


def chunks(text: str) -> list[str]:
    """Chunks of a text as the model sees it: a space in front, spaces as U+2581.

    A chunk without a leading U+2581 or line end is given that space by `spaced`: the
    split at single spaces, by far the most common case, leaves it out.
    """
    if not text:
        return []
    if "  " in text or text[0] == " " or SPACE in text:
        return [x if x[0] == SPACE or x == "\n" else "\n\n" + x for x in _RUNS.findall(SPACE + text.replace(" ", SPACE))]
    return text.replace("\n", " \n").split(" ")


def spaced(key: str) -> tuple[str, ...]:
    """The strings to encode for a key of `chunks`: line ends stand alone."""
    if key[:2] == "\n\n":
        return (key[2:],)  # follows a line end: no space in front
    if key[:1] == "\n":
        return ("\n", key[1:]) if len(key) > 1 else ("\n",)
    return (key,) if key[:1] == SPACE else (SPACE + key,)


def id_table(model: PieceModel) -> Chunks:
    """Chunk key -> ids as little-endian unsigned 32-bit integers."""

    def answer(key: str) -> bytes:
        ids = [i for s in spaced(key) for i in model.chunk_ids(s)]
        return struct.pack(f"<{len(ids)}I", *ids)

    return Chunks(answer)


def count_table(model: PieceModel) -> Chunks:
    """Chunk key -> token count after each of its characters, as int32."""

    def answer(key: str) -> bytes:
        out: list[int] = []
        for s in spaced(key):
            base = out[-1] if out else 0
            out += [base + c for c in model.chunk_counts(s)]
        return struct.pack(f"<{len(out)}i", *out)

    return Chunks(answer)
