"""Fast exact use of a ``tokenizers`` file: each distinct piece between spaces is encoded once.

Byte-level and word-level BPE never merge across a lone space or line end, so a
text's ids are those of its pieces. Pieces are looked up in a
table that grows while a task runs and is dropped when it gets large. Texts for
which the split would not be exact, and tokenizers of any other make, are encoded
whole.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

#: Distinct pieces a table holds before it starts anew (a million take about 200 MB).
PIECES = 1_000_000
#: Pieces that are joined into one text to be encoded.
JOINED = 256
SEPARATOR = "\x01"
#: Signs that are a word of their own behind letters, however many.
TAIL = ".,;:!?#%$&*-"


class _Numbers(dict):
    """Pieces numbered in the order they are first looked up; ``fresh`` are those not learnt yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class _Grown:
    """An array that grows at its end, in place as long as there is room."""

    def __init__(self, dtype):
        self.held, self.size = np.zeros(1 << 12, dtype), 0

    def add(self, x: np.ndarray) -> None:
        n = self.size + len(x)
        if n > len(self.held):
            held = np.zeros(max(n, len(self.held) * 3 // 2), self.held.dtype)
            held[: self.size] = self.held[: self.size]
            self.held = held
        self.held[self.size : n] = x
        self.size = n


class Encoder:
    """``encode(texts)`` gives all ids in one array, and how many each text has."""

    def __init__(self, path: str, pieces: int | None = None):
        self.pieces = PIECES if pieces is None else pieces
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        self.top = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if self.top <= 1 << 16 else np.uint32
        if self.kind == "led":
            self.leads = np.zeros(self.top, bool)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.leads[i] = token.startswith(("Ġ", "Ċ"))
        elif self.kind == "words":
            self.lower = any(n.get("type") == "Lowercase" for n in _norms(spec))
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
            suffix = (spec.get("model") or {}).get("end_of_word_suffix")
            self.ends = None
            if suffix:
                self.ends = np.zeros(self.top, bool)
                for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                    self.ends[i] = token.endswith(suffix)
            ids = self._plain(SEPARATOR)
            self.separator = ids[0] if len(ids) == 1 else None
            if self.separator is None:
                self.kind = "whole"
        self._reset()

    def _reset(self) -> None:
        self.number = _Numbers()
        self.flat, self.offset, self.length = _Grown(self.dtype), _Grown(np.int64), _Grown(np.int64)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole":
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((i for x in lists for i in x), self.dtype, int(counts.sum())), counts
        if len(self.number) > self.pieces:
            self._reset()
        index: list[int] = []
        pieces_of = np.zeros(len(texts), np.int64)
        lookup = self.number.__getitem__
        for n, text in enumerate(texts):
            keys = self._keys(text)
            pieces_of[n] = len(keys)
            index.extend(map(lookup, keys))
        if self.number.fresh:
            self._learn(self.number.fresh)
            self.number.fresh = []
        at = np.array(index, np.int64)
        lens = self.length.held[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat.held[np.repeat(self.offset.held[at] - (ends - lens), lens) + np.arange(total)] if total else np.zeros(0, self.dtype)
        upto = np.concatenate([[0], ends])[np.cumsum(pieces_of)] if len(texts) else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate([[0], upto]))

    def _keys(self, text: str) -> list[str]:
        """Pieces of a text; one that starts with a mark stands for itself, without a space before it.

        ``words``: line ends part words as spaces do, and A-Z may be lower-cased
        first. ``led``: only if all white space is lone spaces and line ends, as runs
        of it are tokens of their own.
        """
        if "\x00" in text or SEPARATOR in text or "<|" in text:
            return ["\x00" + text]
        if self.kind == "words":
            if self.lower:
                text = text.lower() if text.isascii() else text.encode().lower().decode()
            return text.replace("\n", " ").split(" ")
        if not _calm(text):
            return ["\x00" + text]
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\x00" + pieces[0]
        return pieces

    def _learn(self, fresh: list[str]) -> None:
        count = np.fromiter(map(self._parts, fresh), np.int64, len(fresh))
        length, offset = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)

        def put(at: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
            length[at] = lens
            offset[at] = self.flat.size + np.cumsum(lens) - lens
            self.flat.add(ids)

        for kind in (count > 0, count == 0):
            group = np.flatnonzero(kind)
            for i in range(0, len(group), JOINED):
                at = group[i : i + JOINED]
                pieces = [fresh[j] for j in at.tolist()]
                put(at, *((self._by_ends(pieces, count[at]) if count[at[0]] else None) or self._chunk(pieces)))
        for j in np.flatnonzero(count < 0).tolist():
            ids = np.array(self._plain(fresh[j][1:]), self.dtype)
            put(np.array([j]), ids, np.array([len(ids)]))
        self.offset.add(offset)
        self.length.add(length)

    def _parts(self, piece: str) -> int:
        """Into how many words the tokenizer cuts a piece, 0 if that is not told here, -1 if it stands for itself."""
        if piece[:1] == "\x00":
            return -1
        if self.kind != "words" or self.ends is None:
            return 0
        if piece.isalpha():
            return 1
        base = piece.rstrip(TAIL)
        return 2 if len(base) < len(piece) and base.isalpha() else 0

    def _by_ends(self, pieces: list[str], count: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_chunk``, for pieces of known numbers of words, cut by the tokens that end a word; None if that does not come out."""
        ids = self._encoded(" ".join(pieces))
        ends, upto = np.flatnonzero(self.ends[ids]), np.cumsum(count)
        if len(ends) != upto[-1] or ends[-1] != len(ids) - 1:
            return None
        return ids, np.diff(ends[upto - 1], prepend=-1)

    def _encoded(self, text: str) -> np.ndarray:
        plain = max(text, default=" ") < "\u0300" and (not self.lower or text == text.lower())  # normalizing changes nothing
        return np.array((self.bare if plain else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _chunk(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, from one text that holds them, and how many each has."""
        if self.kind == "led":
            text = "".join([p if p[:1] == "\n" else " " + p for p in pieces])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.leads[ids])
            if len(cuts) == len(pieces):
                return ids, np.diff(np.append(cuts, len(ids)))
        else:
            text = f" {SEPARATOR} ".join(pieces)
            ids = self._encoded(text)
            mark = ids == self.separator
            cuts = np.flatnonzero(mark)
            if len(cuts) == len(pieces) - 1:
                return ids[~mark], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        lead = " " if self.kind == "led" else ""  # a piece held a mark of its own
        each = [self._plain(p if p[:1] == "\n" else lead + p) for p in pieces]
        return np.array([i for x in each for i in x], self.dtype), np.array(list(map(len, each)), np.int64)


#: White space other than a space and a line end (fixed values, from Unicode and ASCII control codes).
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _calm(text: str) -> bool:
    """Whether all white space is lone spaces and line ends, none at either end of the text."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return False
    return not any(c in text for c in (_ODD if not text.isascii() else _ODD[:8]))


def _regex(step: dict) -> str:
    return (step.get("pattern") or {}).get("Regex", "")


def _norms(spec: dict) -> list[dict]:
    norm = spec.get("normalizer")
    return [] if norm is None else norm.get("normalizers", [norm])


def _kind(spec: dict) -> str:
    """``led`` (a space belongs to the word after it), ``words`` (spaces are dropped) or ``whole``."""
    pre, norms = spec.get("pre_tokenizer") or {}, _norms(spec)
    steps = pre.get("pretokenizers", [pre])
    added = [a for a in spec.get("added_tokens", []) if a.get("lstrip") or a.get("rstrip") or a.get("single_word") or " " in a["content"]]
    if added or (spec.get("model") or {}).get("type") != "BPE" or spec["model"].get("dropout"):
        return "whole"
    first = steps[0]
    if len(steps) == 1 and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not norms:
        return "led"
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in _regex(first)
    calm = all(n.get("type") in ("NFC", "Lowercase") or n.get("type") == "Replace" and _regex(n) == r"\s+" for n in norms)
    if drops and calm and all(s.get("type") == "ByteLevel" and not s.get("use_regex", True) for s in steps[1:]):
        return "words"
    return "whole"


_HELD: dict[tuple, Encoder] = {}


def encoder(path: str, pieces: int | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; its table serves all tasks of the worker."""
    if (path, pieces) not in _HELD:
        _HELD.clear()
        _HELD[path, pieces] = Encoder(path, pieces)
    return _HELD[path, pieces]


def release() -> None:
    """Drop the worker's encoder, where its memory is needed by what runs next."""
    _HELD.clear()
