"""Batch encoding with the tokenizers library, one encoding per distinct word piece.

Byte-pair merges never cross the pre-tokenizer's boundaries, and a boundary lies before every
blank that follows a non-blank.  So a text is cut there, each distinct piece is encoded once by
the library, and texts are assembled from the pieces' ids.  Texts where a blank precedes the cut
character, texts that hold an added token (``<|endoftext|>``), and tokenizers of another build, are
encoded whole.  Equality with the library's whole-text encoding is tested in ``tests/llm/test_tokens.py``.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

_LOADED: dict[str, "Encoder"] = {}
_BLANK_BEFORE_CUT = re.compile(r"\s[ \n]")
BATCH_CHARS = 1 << 21
DISTINCT = 700_000


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def encoder(path: str) -> "Encoder":
    """One encoder per file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class _Pieces(dict):
    """piece -> number; an unseen piece gets the next number and waits for encoding."""

    def __init__(self, waiting: list):
        super().__init__()
        self.waiting = waiting

    def __missing__(self, piece):
        self[piece] = n = len(self)
        self.waiting.append(piece)
        return n


class Encoder:
    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.style = _style(spec)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self._reset()

    def _reset(self) -> None:
        self.waiting: list[str] = []
        self.pieces = _Pieces(self.waiting)
        self.flat = np.zeros(0, dtype=np.uint32)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _piece_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces; a piece of Latin letters is one pre-token and goes straight to the library's merge model."""
        merge, out, rest = self.tokenizer.model.tokenize, [], []
        bare, blank = self.style == "bare", "" if self.style == "bare" else " ".translate(_BYTE_LETTERS)
        for i, piece in enumerate(pieces):
            if self.style and piece.isalpha() and max(piece) <= "\u00ff":
                word = piece.lower() if bare else piece       # letter by letter here, and in normal form C already
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                out.append([t.id for t in merge(blank + word)])
            else:
                out.append(None)
                rest.append(i)
        for i, ids in zip(rest, self._whole([self._spell(pieces[i]) for i in rest])):
            out[i] = ids
        return out

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        if self.style == "bare":                      # blanks are dropped
            return text.replace("\n", " ").split(" ")
        parts = text.replace("\n", " \n").split(" ")  # a blank belongs to the word after it
        if parts[0]:
            parts[0] = "\r" + parts[0]                # marks a piece with no blank before it
        return parts

    def _spell(self, piece: str) -> str:
        if self.style == "bare" or not piece or piece[0] == "\n":
            return piece
        return piece[1:] if piece[0] == "\r" else " " + piece

    def _learn(self) -> None:
        """Encode the waiting pieces; a word with one point or comma behind it is the word's ids and the mark's."""
        known = len(self.starts)
        look, bare_mark = self.pieces.__getitem__, "\r" if self.style == "prefixed" else ""
        marked, at = {}, 0
        while at < len(self.waiting):                 # looking up a base may add to the list
            piece = self.waiting[at]
            if len(piece) > 1 and piece[-1] in ".," and piece[-2].isalpha():
                marked[known + at] = (look(piece[:-1]), look(bare_mark + piece[-1]))
            at += 1
        alone = [i for i in range(at) if known + i not in marked]
        new = dict(zip((known + i for i in alone), self._piece_ids([self.waiting[i] for i in alone])))
        for k, (base, mark) in marked.items():
            new[k] = self._ids(base, new) + self._ids(mark, new)
        found = [new[known + i] for i in range(at)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=at)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
        self.sizes = np.concatenate([self.sizes, size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(size.sum()))])
        self.waiting.clear()

    def _ids(self, number: int, new: dict) -> list[int]:
        return new[number] if number in new else self.flat[self.starts[number]:self.starts[number] + self.sizes[number]].tolist()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if len(self.pieces) > DISTINCT:
            self._reset()
        numbers: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        odd: dict[int, list[int]] = {}
        look = self.pieces.__getitem__
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.style or any(t in text for t in self.added) or self.style == "prefixed" and ("\r" in text or text[0] == " " or text[-1] == " " or _BLANK_BEFORE_CUT.search(text)):
                odd[i] = self._whole([text])[0]
                continue
            parts = self._cut(text)
            numbers.extend(map(look, parts))
            counts[i] = len(parts)
        if self.waiting:
            self._learn()
        number = np.array(numbers, dtype=np.int64)
        size = self.sizes[number]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.starts[number] - before[:-1], size) + np.arange(before[-1])]
        ends = np.cumsum(counts)
        lengths = before[ends] - before[ends - counts]
        if not odd:
            return ids, lengths
        out, at = [], 0
        for i, n in enumerate(lengths):
            if i in odd:
                out.append(np.array(odd[i], dtype=np.uint32))
                lengths[i] = len(odd[i])
            else:
                out.append(ids[at:at + n])
                at += n
        return np.concatenate(out), lengths


def _style(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm and any(t.get("normalized") for t in spec.get("added_tokens") or []):
        return ""                                     # such a token may appear in the normal form alone
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "prefixed"
    steps = pre.get("pretokenizers") or []
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    if len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and set(kinds) <= {"NFC", "Replace", "Lowercase"}:
        return "bare"
    return ""


def encode_rows(path: str, texts: list, end_id: int | None):
    """Yields (first row, last row + 1, ids, lengths) in pieces of bounded text, with ``end_id`` after each text; a null text is empty."""
    enc = encoder(path)
    lo, n = 0, len(texts)
    while lo < n:
        hi, chars = lo, 0
        while hi < n and (hi == lo or chars < BATCH_CHARS):
            chars += len(texts[hi] or "")
            hi += 1
        ids, lengths = enc.encode([t or "" for t in texts[lo:hi]])
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(lengths), np.uint32(end_id))
            lengths = lengths + 1
        yield lo, hi, ids, lengths
        lo = hi
