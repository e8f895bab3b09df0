"""Token ids of many texts by the tokenizers library, with a memory of pieces.

A tokenizer that drops white space can be run part by part: no piece spans a blank.  Texts are
cut at blanks, tabs and line ends, and only parts not seen before are encoded.  Parts of plain
Latin-1 texts are cut into pieces by the file's own pattern for the library's model; parts of
any other text go through the whole library, special strings included.  Ids are the same
either way.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

#: Remembered parts and pieces; beyond that a memory starts anew, so a worker's memory is bounded
#: (about 260 MB at this many).
REMEMBER = 600_000

# The white-space, splitting and lower-casing steps that allow the short way.
DROPS_BLANKS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^{_LETTERS}0-9]+")
_SAFE = bytes([9, 10, 13, *range(32, 127), 0xA1, 0xAB, 0xBB, 0xBF, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])


def _byte_characters() -> dict[int, str]:
    """Bytes to characters as byte-level vocabularies write them: unprintable bytes move beyond 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class _Memory(dict):
    """Part to its number; a new part is encoded when first asked for (to packed 32-bit ids) and its
    ids are kept in arrays."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.new = encode, []
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(self.encode(part))
        return n

    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each part's ids, and the ids; room doubles as it grows."""
        if self.new:
            known = len(self) - len(self.new)
            used = int(self.start[known - 1] + self.length[known - 1]) if known else 0
            n = np.fromiter(map(len, self.new), np.int64, len(self.new)) // 4
            ids = np.frombuffer(b"".join(self.new), np.uint32)
            for name, extra, at in (("start", used + np.cumsum(n) - n, known), ("length", n, known), ("ids", ids, used)):
                held = getattr(self, name)
                if at + len(extra) > len(held):
                    held = np.concatenate((held[:at], np.zeros(at + 2 * len(extra), held.dtype)))
                    setattr(self, name, held)
                held[at : at + len(extra)] = extra
            self.new.clear()
        return self.start, self.length, self.ids


class PieceEncoder:
    def __init__(self, path: str, remember: int = REMEMBER):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.drops_blanks = (
            (spec.get("normalizer") or {}).get("normalizers") == DROPS_BLANKS
            and len(steps) == 2
            and steps[0].get("pattern") == {"Regex": SPLIT}
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and (steps[1]["type"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("ByteLevel", False, False)
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.table = _byte_characters()
        self.remember = remember
        self.known: dict[str, bytes] = {}  # pieces of plain parts
        self.plain = _Memory(self._of_plain)
        self.other = _Memory(self._of_other)

    def _of_plain(self, part: str) -> bytes:
        found = [self.known.get(piece) or self._of_piece(piece) for piece in _PLAIN.findall(part)]
        return found[0] if len(found) == 1 else b"".join(found)

    def _of_piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.table)
        ids = self.known[piece] = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return ids

    def _of_other(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _parts(self, text: str) -> tuple[_Memory, list[str]]:
        try:
            plain = not text.encode("latin-1").translate(None, _SAFE)
        except UnicodeEncodeError:
            plain = False
        if plain and not any(s in text for s in self.special):
            return self.plain, text.lower().split()
        return self.other, [p for p in re.split("[ \t\n\r]+", text) if p]

    def _numbered(self, texts: list[str | None]):
        """Memory and part numbers of each text; forgets between texts once too much is known."""
        for text in texts:
            memory, parts = self._parts(text or "")
            yield memory, np.fromiter(map(memory.__getitem__, parts), np.int64, len(parts))

    def _forget(self) -> None:
        if len(self.known) > self.remember:
            self.known.clear()
        if len(self.plain) > self.remember:
            self.plain = _Memory(self._of_plain)
        if len(self.other) > self.remember // 4:
            self.other = _Memory(self._of_other)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has; null counts as empty."""
        if not self.drops_blanks:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts
        ids, counts = [], []
        for memory, at in list(self._numbered(texts)):
            start, length, held = memory.stored()
            n = length[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids.append(held[np.repeat(start[at] - ends + n, n) + np.arange(total)])
            counts.append(total)
        self._forget()
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array(counts, np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        if not self.drops_blanks:
            return self.encode(texts)[1]
        found = [int(memory.stored()[1][at].sum()) for memory, at in list(self._numbered(texts))]
        self._forget()
        return np.array(found, np.int64)


_KEPT: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and file, so tasks of a worker share its memory."""
    if path not in _KEPT:
        _KEPT[path] = PieceEncoder(path)
    return _KEPT[path]
