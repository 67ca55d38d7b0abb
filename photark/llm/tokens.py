"""Token ids of whole texts, by the tokenizers library, with a cache of the texts' words."""

from __future__ import annotations

import json
import os
import re
from array import array
from unicodedata import is_normalized

import pyarrow as pa


TAIL = re.compile(r"(.*[^\W\d_İ])([!-/:-@\[-`{-~]+)", re.S)  # punctuation after a letter
NUL = re.compile("\0")
SEPARATORS = re.compile("[\x1c-\x1f\x85]")  # white space to Python or to the tokenizer, but not to both
ODD = re.compile(r"\s\s|[^\S \n]")
#: How byte-level vocabularies write bytes: visible ones of Latin-1 as themselves, others from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
VISIBLE = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


#: The pattern of the one kind of pre-tokenizer that drops white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def kind(config: dict) -> str | None:
    """'bytes' or 'words' for the two kinds of tokenizers whose texts may be cut at white space; None for others."""
    normal, before = config["normalizer"], config["pre_tokenizer"] or {}
    model = config["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    if normal is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
        return "bytes"
    steps = before.get("pretokenizers", [])
    lowers = normal is not None and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    splits = [b["type"] for b in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_PATTERN} and not steps[1]["use_regex"]
    return "words" if lowers and splits else None


class Encoder(dict):
    """Ids of a text as little-endian uint32 bytes, equal to those of the library's encode() of it whole.
    Texts with strings of special tokens, and all texts of tokenizers of an unknown kind, are encoded whole.

    A cut between a character that is no white space and a space or line end after it is always
    a boundary of the pre-tokenizer, so the pieces between such cuts are encoded by themselves,
    and this dictionary keeps their ids. A run of ASCII punctuation at a piece's end, after a
    letter, is split off likewise. The cache is bounded: once it holds ``keep`` pieces it becomes
    the older generation, and pieces not met again go.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind(json.loads(self.tokenizer.to_str()))
        self.lowers = self.kind == "words"  # and drops white space
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        self.tokenize = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        self.keep = keep

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            parts = self.parts(piece)
            ids = self.word(piece) if parts == (piece,) else b"".join([self[p] for p in parts])
        self[piece] = ids
        return ids

    def parts(self, piece: str) -> tuple[str, ...]:
        """What a piece is encoded as: without the leading white space that counts for itself or not at
        all, in lower case if that is all the same, and without punctuation at its end."""
        lead = ""
        if self.lowers:
            if piece.isascii():
                piece = piece.lower()
            elif "İ" not in piece and is_normalized("NFC", piece):  # each character's lower case is one character
                piece = "".join(map(str.lower, piece))
        elif len(piece) > 1 and piece[0] == "\n" and not piece[1].isspace():
            lead, piece = "\n", piece[1:]
        tail = TAIL.fullmatch(piece)
        parts = tail.groups() if tail else (piece,)
        return (lead, *parts) if lead else parts

    def word(self, piece: str) -> bytes:
        plain = piece[1:] if piece[:1] == " " else piece
        if plain.isalpha() and (not self.lowers or plain.isascii() or is_normalized("NFC", plain) and plain == "".join(map(str.lower, plain))):
            ids = [t.id for t in self.tokenize("".join(map(VISIBLE.__getitem__, piece.encode())))]  # one word of the pre-tokenizer
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get = self.__getitem__
        cut, odd = (_words, SEPARATORS) if self.lowers else (_pieces, NUL)
        out = []
        for t in texts:
            if len(self) > self.keep:
                self.old = dict(self)
                self.clear()
            if t and (self.kind is None or odd.search(t) or self.special.search(t)):
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(get, cut(t))) if t else b"")
        return out


def _words(text: str) -> list[str]:
    return (text.lower() if text.isascii() else text).split()


def _pieces(text: str) -> list[str]:
    pieces = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    if not ODD.search(text):
        return pieces
    out, open_ = [], ""  # runs of white space stay with what follows them
    for p in pieces:
        open_ += p
        if open_ and not open_[-1].isspace():
            out.append(open_)
            open_ = ""
    return [*out, open_] if open_ else out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batch: pa.RecordBatch, path: str, step: int = 512):
    """(row, id bytes) of each text in the batch, a few texts at a time."""
    enc, column = encoder(path), batch.column("text")
    for at in range(0, batch.num_rows, step):
        yield from enumerate(enc.encode(column.slice(at, step).to_pylist()), at)
