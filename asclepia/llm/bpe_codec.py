"""Byte-level BPE with the tiktoken library and a local rank file: encode whole texts, decode to raw bytes.

A long text is cut before encoding at boundaries where the pattern always ends a match: before a single space between two
characters that aren't white space. Pieces so cut encode to the same ids as the whole, in bounded time and memory. A long run of
white space, on which the library's regular expression can run out of stack, is a match by itself and encoded as one.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asclepia.llm._base import map_rows
from asclepia.llm._tokenizers import _loaded, resolve

#: Texts longer than this are cut into pieces of about this many characters.
PIECE = 1 << 16
#: White space runs longer than this are taken apart by hand.
LONG_RUN = 10_000
_RUN = re.compile(r"\s{%d,}" % LONG_RUN)


def codec(path: str):
    key = ("tiktoken", path)
    if key not in _loaded:
        import public_tokenizers
        import tiktoken

        ranks = {}
        with open(resolve(path), "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at safe boundaries, each piece at least ``size`` long but the last; no boundary, no cut."""
    out, start, at = [], 0, size
    while len(text) - start > size:
        at = text.find(" ", max(at, start + size))
        if at < 0 or at + 1 >= len(text):
            break
        if text[at - 1].isspace() or text[at + 1].isspace() or "\x1c" <= text[at - 1] <= "\x1f" or "\x1c" <= text[at + 1] <= "\x1f":
            at += 1
            continue
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


def encode(path: str, text: str, size: int = PIECE) -> list[int]:
    c = codec(path)
    if len(text) <= size:
        return c.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        at = 0
        for run in _RUN.finditer(piece):
            # The pattern gives a run before a word without its last character, which goes to the word (a space) or stands alone.
            end = run.end() if run.end() == len(piece) else run.end() - 1
            if run.start() > at:
                ids += c.encode_ordinary(piece[at : run.start()])
            ids += c._encode_single_piece(piece[run.start() : end])
            at = end
        if at < len(piece):
            ids += c.encode_ordinary(piece[at:])
    return ids


def decode(path: str, ids: list[int]) -> bytes:
    """The bytes of the ids; they need not be whole characters."""
    return codec(path).decode_bytes(ids)


def encoded_documents(
    docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", columns: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, and of ids (array), decoded (bytes), ids_sha256, decoded_sha256 those named in ``columns``.

    Decoding starts from the ids alone. Null text counts as empty and has no ids; an empty table gives no rows; repeated rows and
    null ids stay; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = {"ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(keys: list, texts: list) -> dict:
        got: dict[str, list] = {"doc_id": keys, "n_tokens": [], **{c: [] for c in columns}}
        for text in texts:
            ids = encode(ranks, text or "")
            got["n_tokens"].append(len(ids))
            back = decode(ranks, ids) if {"decoded", "decoded_sha256"} & set(columns) else b""
            for c in columns:
                got[c].append(
                    ids if c == "ids" else back if c == "decoded" else hashlib.sha256(back).hexdigest() if c == "decoded_sha256"
                    else hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                )
        return got

    return map_rows(rows, run, "doc_id long, n_tokens long, " + ", ".join(f"{c} {kinds[c]}" for c in columns))
