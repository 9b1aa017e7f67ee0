"""Encoding of whole texts with a public tokenizer file, to the very ids that the tokenizers library gives.

The file's own vocabulary drives tiktoken's merge loop, which is several times as fast. That holds for byte-pair
models whose ids follow the order of their merges, and for texts of plain letters, digits, punctuation and white
space that hold no added token's string; any other text goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Latin, Greek and Cyrillic letters, ASCII and common quotes: here both libraries cut texts alike.
_ODD = re.compile("[^\n\t\x20-\x7e¡«»¿À-įı-ɏΑ-ΡΤ-Ωα-ωЀ-ҁҊ-ӿ‘’“”–—…]")
#: Ends a word for the word-level model; texts that hold it count as odd.
_END = "\x01"
#: Stands between words that are encoded together; texts that hold it count as odd too.
_BETWEEN = "\x02"
#: How the word-level file cuts texts besides at white space, for texts that aren't odd: around these.
_APART = re.compile(r"'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
#: What isn't a letter, digit, apostrophe or white space there; a run of these is one piece.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~¡«»¿×÷‘’“”–—…"
_DIGIT = re.compile("[0-9]")
_AROUND = f"{_END}\\g<0>{_END}"
#: How byte-level files cut texts.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level models write each byte as a printable letter: itself where it is one, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """``encode(text)`` gives the ids of a whole text, as the library's encode with add_special_tokens=False.

    ``literal`` takes special tokens' strings for ordinary text, as the library does with encode_special_tokens set;
    without it they give the special tokens' ids, which is the library's default.
    """

    def __init__(self, path: str, literal: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["id"] for t in spec["added_tokens"]}
        # Some added tokens are looked for in the normalised text, so case doesn't count for these.
        added = "|".join(f"(?i:{re.escape(t['content'])})" if t["normalized"] else re.escape(t["content"]) for t in spec["added_tokens"] if t["content"])
        self.added = re.compile(added) if added and not literal else None
        end = model.get("end_of_word_suffix")
        byte, ranks = _byte_of_letter(), {}
        for token, i in model["vocab"].items():
            if i not in special:
                last = bool(end) and token.endswith(end)
                ranks[bytes(byte[c] for c in (token[: -len(end)] if last else token)) + _END.encode() * last] = i
        self.words = bool(end)
        self.fast = tiktoken.Encoding("own", pat_str=f"[^{_END}]+{_END}" if end else _BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.size = self.tokenizer.get_vocab_size()
        if self.words:
            [self.between] = self.fast.encode_ordinary(_BETWEEN + _END)

    def _plain(self, text: str) -> bool:
        """Whether both libraries take the text alike."""
        return not (_ODD.search(text) or (self.added and self.added.search(text)))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self._plain(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if not self.words:
            return self.fast.encode_ordinary(text)
        return self.fast.encode_ordinary(self._pieces(text.lower()).replace(" ", _END).replace("\n", _END).replace("\t", _END) + _END)

    @staticmethod
    def _pieces(text: str) -> str:
        """Each piece with one end sign behind it; signs without a piece before them match nothing and are passed over."""
        if "'" in text:
            return _APART.sub(_AROUND, text)
        for mark in _MARKS:
            if mark in text:  # much faster to find out than a replacement of nothing
                text = text.replace(mark, _END + mark + _END)
        # Two signs stand where marks meet, which belong together.
        text = text.replace(_END + _END, "")
        return _DIGIT.sub(_AROUND, text) if _DIGIT.search(text) else text

    def array(self, text: str, end: int | None, kind: str = "<u4") -> np.ndarray:
        """The ids, ``end`` behind them, as integers of a kind that holds them."""
        out = self.encode(text)
        if end is not None:
            out.append(end)
        return np.frombuffer(array("H" if kind == "<u2" else "I", out), kind)

    def arrays(self, texts: list[str], end: int | None, kind: str = "<u4") -> list[np.ndarray]:
        """``array`` of each text. The word-level model encodes each different word of all of them once."""
        out: list = [None] * len(texts)
        plain = [i for i, text in enumerate(texts) if self.words and self._plain(text)]
        if plain:
            lists = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
            coded = lists.flatten().dictionary_encode()
            pieces = self._pieces(" ".join(coded.dictionary.to_pylist())).replace(" ", _END + _BETWEEN + _END)
            ids = np.frombuffer(array("H" if kind == "<u2" else "I", self.fast.encode_ordinary(pieces + _END)), kind)
            gaps = np.flatnonzero(ids == self.between)
            first, n = np.append(0, gaps + 1), np.diff(gaps, prepend=-1, append=len(ids)) - 1
            word = coded.indices.to_numpy()
            before = np.append(0, np.cumsum(n[word]))
            every = ids[np.repeat(first[word] - before[:-1], np.diff(before)) + np.arange(before[-1])]
            bounds = before[lists.offsets.to_numpy()].tolist()
            tail = np.array([] if end is None else [end], kind)
            for i, a, b in zip(plain, bounds[:-1], bounds[1:], strict=True):
                out[i] = np.concatenate((every[a:b], tail))
        return [self.array(text, end, kind) if ids is None else ids for text, ids in zip(texts, out, strict=True)]

    def ids(self, text: str, end: int | None) -> bytes:
        """The ids, ``end`` behind them, as little-endian unsigned 32-bit integers."""
        return self.array(text, end).tobytes()


_loaded: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, literal: bool = True) -> Encoder:
    """One encoder for each file, way and process."""
    if (path, literal) not in _loaded:
        _loaded[path, literal] = Encoder(path, literal)
    return _loaded[path, literal]
