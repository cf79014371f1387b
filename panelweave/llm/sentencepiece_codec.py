"""SentencePiece encoding that keeps offsets, and decoding, for BPE models.

The text is normalised by longest-prefix replacement through the model's compiled character map, and every normalised
byte remembers the source bytes it came from.  BPE merges run on the normalised text, each word apart (a merge cannot
cross a border that no piece spans), and every piece is projected to the span of original bytes behind it.

The model file is read by its protobuf description; its path is a parameter and the file must exist on every executor.
Null text is the empty text and has no pieces.  Rows are independent: repeats, order and other columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Words whose ids a worker remembers (two generations of this many, about 250 bytes each).
CACHE = 200_000
# Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2
LETTER = r"[^\W\d_]"
#: Greater than the rank of every piece.
NO_RANK = 1 << 40


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


class Normalizer:
    """Text to normalised text, with the source position of every normalised byte.

    ``user`` are pieces that pass unchanged, as the library lets user-defined symbols pass.
    """

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool, user: tuple[bytes, ...] = ()):
        self.map = CharacterMap(charsmap) if charsmap else None
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        self.user = re.compile(b"|".join(re.escape(u) for u in sorted(user, key=len, reverse=True))) if user else None

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        if self.user and (m := self.user.match(data, at)):
            return m.end() - at, m[0]
        if self.map and (hit := self.map.longest(data, at)):
            return hit
        first = data[at]
        width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return width, data[at : at + width]

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for every byte border in it the source byte where it stands."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.map is None and self.user is None and not self.squeeze:
            return self._plain(text, data)
        space = SPACE.encode() if self.escape else b" "
        out, borders, at, n = bytearray(), [], 0, len(data)
        if self.squeeze:
            while at < n:
                width, value = self._prefix(data, at)
                if value != b" ":
                    break
                at += width
        if at >= n:
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += space
            borders += [at] * len(space)
        blank = self.squeeze
        while at < n:
            width, value = self._prefix(data, at)
            value = value.lstrip(b" ") if blank and self.squeeze else value
            if value:
                shown = value.replace(b" ", space)
                out += shown
                borders += [at] * len(shown)
                blank = self.squeeze and value.endswith(b" ")
            at += width
        borders.append(n)
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], borders[-len(space) - 1 : -1]
                borders[-1] = borders[-1] if not out else borders[-1]
        return out.decode(), np.array(borders, np.int64)

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """No map: only blanks change, so the borders follow from byte widths."""
        space = SPACE if self.escape else " "
        shown = (space if self.dummy_prefix else "") + text.replace(" ", space)
        width = np.where(np.frombuffer(data, np.uint8) == 0x20, len(space.encode()), 1)
        inner = np.repeat(np.arange(len(data)), width)
        lead = np.zeros(len(space.encode()) if self.dummy_prefix else 0, np.int64)
        return shown, np.concatenate([lead, inner, [len(data)]])


class Codec:
    """One BPE model: normaliser, merges, and the pieces of words seen lately."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != BPE_MODEL or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with a leading word mark are supported")
        spec, pieces = model.normalizer_spec, model.pieces
        user = tuple(p.piece.encode() for p in pieces if p.type == USER_DEFINED)
        if user or any(p.type == UNUSED for p in pieces) or not model.trainer_spec.byte_fallback:
            raise ValueError("models with user-defined or unused pieces, or without byte pieces, are not supported")
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.dummy_prefix = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.names = [p.piece for p in pieces]
        self.types = [p.type for p in pieces]
        self.unknown = self.types.index(UNKNOWN)
        self.unknown_text = model.trainer_spec.unk_surface
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        levels = {s: i for i, s in enumerate(sorted({p.score for p in pieces if p.type == NORMAL}, reverse=True))}
        self.rank = {p.piece: levels[p.score] for p in pieces if p.type == NORMAL}
        self.decimal = [str(i) for i in range(len(pieces))]
        self.piece_bytes = np.array([-1 if t == BYTE else len(n.encode()) for n, t in zip(self.names, self.types, strict=True)], np.int64)
        self.byte_of = np.zeros(len(pieces), np.int64)
        for byte, id in self.byte_ids.items():
            self.byte_of[id] = byte
        self.words = self._borders()
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _borders(self) -> re.Pattern | None:
        """Words that can be merged apart: no piece spans a border between two of them.

        Words begin at a mark, a character that is inside no longer piece is a word of its own, and letters end before
        a punctuation character that no piece has behind a letter.
        """
        neighbours = {(a, b) for name in self.ids for a, b in zip(name, name[1:], strict=False)}
        if any(b == SPACE and a != SPACE for a, b in neighbours):
            return None
        held = {c for pair in neighbours for c in pair}
        lone = "".join(c for c in "\n\t\r" if c not in held)
        behind = {b for a, b in neighbours if re.match(LETTER, a)}
        cut = re.escape("".join(c for c in string.punctuation if c not in behind))
        return re.compile(
            (f"[{lone}]|" if lone else "") + (f"{SPACE}*{LETTER}+(?=[{cut}])|" if cut else "") + f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+"
        )

    def merged(self, word: str) -> list[str]:
        """The pieces of ``word``: the best-ranked adjacent pair is joined, leftmost first, until none is left."""
        parts, rank = list(word), self.rank
        pairs = [rank.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < NO_RANK:
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank.get(parts[at] + parts[at + 1], NO_RANK)
            if at:
                pairs[at - 1] = rank.get(parts[at - 1] + parts[at], NO_RANK)
        return parts

    def long_merged(self, word: str) -> list[str]:
        """``merged`` with a heap of pairs and linked neighbours, for words of many characters."""
        parts, rank, n = list(word), self.rank, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, text = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or not parts[i] or parts[i] + parts[j] != text:
                continue
            parts[i], parts[j] = text, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    pair = parts[left] + parts[after[left]]
                    if (r := rank.get(pair)) is not None:
                        heapq.heappush(heap, (r, left, pair))
        return [p for p in parts if p]

    def word(self, word: str) -> bytes:
        """The ids of ``word`` as 32-bit integers."""
        hit = self.young.get(word) or self.old.get(word)
        if hit is None:
            ids = []
            for part in self.merged(word) if len(word) < 40 else self.long_merged(word):
                id = self.ids.get(part)
                if id is not None:
                    ids.append(id)
                else:
                    ids += [self.byte_ids[b] for b in part.encode()]
            hit = array("i", ids).tobytes()
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        if len(word) < 100:
            self.young[word] = hit
        return hit

    def widths(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes that each id stands for; of a character in byte pieces the last has all."""
        out = self.piece_bytes[ids]
        at = np.flatnonzero(out < 0)
        if len(at):
            byte = self.byte_of[ids[at]]
            size = np.where(byte < 0x80, 1, np.where(byte < 0xC0, 0, np.where(byte < 0xE0, 2, np.where(byte < 0xF0, 3, 4))))
            out[at] = 0
            heads = size > 0
            out[at[heads] + size[heads] - 1] = size[heads]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the borders of their source bytes: piece i spans borders[i] to borders[i + 1].

        A character without a piece becomes one id per byte: all but the last have an empty span before it.
        """
        shown, source = self.normalize(text)
        parts = [shown] if self.words is None and shown else self.words.findall(shown) if shown else []
        young, miss = self.young, self.word
        ids = np.frombuffer(b"".join([young.get(p) or miss(p) for p in parts]), np.int32)
        borders = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.widths(ids), out=borders[1:])
        return ids, source[borders]

    def listed(self, ids: np.ndarray) -> str:
        """Decimal ids joined by commas."""
        decimal = self.decimal
        return ",".join([decimal[i] for i in ids.tolist()])

    @property
    def surfaces(self) -> list[bytes]:
        """What each id adds to decoded bytes."""
        if not hasattr(self, "_surfaces"):
            bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
            named = [n.replace(SPACE, " ").encode() if t == NORMAL else b"" for n, t in zip(self.names, self.types, strict=True)]
            for i, value in bytes_of.items():
                named[i] = value
            named[self.unknown] = self.unknown_text.encode()
            self._surfaces = named
        return self._surfaces

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; the mark in front of the first word is dropped, bytes that are no UTF-8 become U+FFFD."""
        surfaces = self.surfaces
        if len(ids) == 0:
            return ""
        known = ids.tolist()
        data = b"".join([surfaces[i] for i in known])
        first = next((i for i in known if self.types[i] != CONTROL), None)
        if self.dummy_prefix and first is not None and self.types[first] == NORMAL and self.names[first].startswith(SPACE):
            data = data[1:]
        return data.decode(errors="replace")


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """A model of the public tokenizer files, where every executor has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The model at ``path``, read once per worker."""
    return Codec(path)


def encode_documents(docs: DataFrame, model: str, ids: bool = False, borders: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered (source bytes under the pieces' spans).

    ``ids`` adds the ids, ``borders`` their places: piece i stands for the source bytes borders[i] to borders[i + 1].
    """
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    fields = ["doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", "n_covered long"]
    fields += ["ids array<int>"] * ids + ["borders array<bigint>"] * borders
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.list_(pa.int32())] * ids + [pa.list_(pa.int64())] * borders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = []
                for text in part.column(1):
                    found, places = own.encode(text.as_py() or "")
                    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (own.listed(found), own.decode(found))]
                    row = [len(found), *digests, int(places[-1] - places[0])]
                    rows.append(row + [found] * ids + [places] * borders)
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[f.split()[0] for f in fields])

    return narrow.mapInArrow(run, ", ".join(fields))
