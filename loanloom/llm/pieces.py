"""Exact ids of whole texts from cached pieces.

The pre-tokenizers used here never let a token span from a character that is no white
space to one that is, nor from a letter or digit to a punctuation mark. So a text may be
cut at these places (the second kind only between Latin characters and ASCII marks),
pieces such as `` the`` are encoded once by the tokenizers library, and their ids are put
together again. Texts with characters that Unicode versions class differently, or with
the strings of special tokens, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types

import numpy as np

_PIECE = re.compile(r"\s*[A-Za-z0-9À-ÖØ-öø-ɏ]+(?![^\s!-/:-@\[-`{-~])|\s*\S+|\s+")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_DOUBTFUL = re.compile("[\x1c-\x1f\x85᠎​﻿]")
PIECE_CHARS = 40
CACHE_PIECES = 250_000
LATE_PIECES = 80_000


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def per_process(name: str, version, make):
    """An object per Python worker, which Spark keeps for many tasks; the last version of each name stays."""
    store = sys.modules.setdefault("_loanloom_kept", types.ModuleType("_loanloom_kept")).__dict__
    if name not in store or store[name][0] != version:
        store[name] = version, make()
    return store[name][1]


def tokenizer_text(path: str) -> str:
    """A tokenizer file read on the driver, to be sent to tasks: a few MB of fixed size."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Pieces(dict):
    """Ids, as little-endian unsigned 32-bit integers, of pieces; missing ones are encoded.

    The first pieces of usual length stay, up to a bound, and frequent pieces come early;
    later ones go to a smaller cache that starts anew when it is full.
    """

    def __init__(self, tokenizer_json: str, most: int = CACHE_PIECES):
        super().__init__()
        self.most = most
        self.late: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = re.compile("|".join(
            [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] or ["(?!)"]))

        # with these settings a run of letters after at most one space is one token to split, as it is
        made = json.loads(tokenizer_json)
        own = made.get("pre_tokenizer") or {}
        plain = own.get("type") == "ByteLevel" and own.get("use_regex") and not own.get("add_prefix_space")
        self.direct = bool(plain and not made.get("normalizer") and made["model"]["type"] == "BPE")
        self.model, self.shown = self.tokenizer.model, byte_characters()

    def one(self, piece: str) -> bytes:
        """Ids of one piece; runs of letters skip the steps that leave them as they are."""
        if self.direct and _LETTERS.fullmatch(piece):
            split = self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))
            return np.array([t.id for t in split], "<u4").tobytes()
        return self.whole(piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.late.get(piece)
        if ids is None:
            ids = self.one(piece)
            if len(piece) <= PIECE_CHARS:
                if len(self) < self.most:
                    self[piece] = ids
                else:
                    if len(self.late) >= LATE_PIECES:
                        self.late.clear()
                    self.late[piece] = ids
        return ids

    def sound(self, text: str) -> bool:
        """Whether the text may be cut into pieces."""
        return not self.special.search(text) and not _DOUBTFUL.search(text)

    @staticmethod
    def cut(text: str) -> list[str]:
        return _PIECE.findall(text)

    def encode(self, text: str) -> bytes:
        if not self.sound(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def pieces_of(tokenizer_json: str, most: int = CACHE_PIECES) -> Pieces:
    return per_process("pieces", (most, len(tokenizer_json), hash(tokenizer_json)), lambda: Pieces(tokenizer_json, most))
