"""Byte-pair encoding by the rank file of a public tokenizer, and exact joining of encoded chunks."""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex
import xxhash

#: Folder of the vocabulary files; a parameter wherever it is used.
VOCABULARIES = os.environ.get("ATTESTRA_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the pattern by which the tokenizer's authors split text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most characters that an alternative of the pattern reads before it can be told apart.
REACH = 3
#: Pieces at the start of a chunk whose ends are kept as places where a join may meet it.
HEAD = 8


class Tokenizer:
    """Encoder of one rank file. Built once per Python worker and path."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.split = regex.compile(PATTERN)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


@lru_cache(maxsize=4)
def tokenizer(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Tokenizer:
    return Tokenizer(os.path.join(folder, f"{name}.tiktoken"))


@dataclass
class Chunk:
    """An encoded chunk: its ids, and of its text only what a join may need.

    ``head`` are the ends of the first pieces by character, from 0, with the ids up to there, and
    ``start`` is the text that they and the next pieces cover. ``safe`` is an end that holds whatever
    text follows (every piece before it ends before the chunk does, and starts ``REACH`` or more before
    that) with the ids up to there, and ``end`` is the text from there on. ``size`` is the whole length.
    """

    size: int
    start: str
    end: str
    ids: list[int]
    head: dict[int, int]
    safe: tuple[int, int]


def _sure_end(text: str, before: int) -> int:
    """A place before ``before`` where a piece ends in any case: between a letter and a space. 0 if none is near."""
    at = text.rfind(" ", 1, max(before, 0))
    while at > 0 and not text[at - 1].isalpha():
        at = text.rfind(" ", 1, at)
    return max(at, 0)


def encode_chunk(text: str, tok: Tokenizer) -> Chunk:
    ids = tok.encode(text)
    ends = np.concatenate([[0], np.cumsum(tok.size[ids])]) if ids else np.zeros(1, dtype=np.int64)
    ids_before = lambda place: int(np.searchsorted(ends, len(text[:place].encode())))
    places, cover = [0], len(text)
    for i, piece in enumerate(tok.split.finditer(text)):
        if i < HEAD and piece.end() < len(text) and piece.start() + REACH <= len(text):
            places.append(piece.end())
        if i == HEAD + 2:
            cover = min(len(text), piece.end() + REACH)
            break
    safe = _sure_end(text, len(text) - 48) if len(text) > 96 else 0
    for piece in tok.split.finditer(text, safe):
        if piece.end() >= len(text) or piece.start() + REACH > len(text):
            break
        safe = piece.end()
    return Chunk(len(text), text[:cover], text[safe:], ids, {p: ids_before(p) for p in places}, (safe, ids_before(safe)))


def join_chunks(chunks: list[Chunk], tok: Tokenizer) -> list[int]:
    """Ids of the joined text, exactly as if it were encoded whole.

    From an end of a piece on, the split depends on the following text alone. So a chunk's own ids
    hold from any of its piece ends that is one of the whole text, up to its safe end. From there
    pieces are split and encoded anew over the join until one ends where the next chunk's own split
    has an end too. That is so after two pieces at most: where a run of letters, of digits, of other
    signs or of white space ends, every split has an end. A chunk that isn't met within its head would
    be an error, which is raised.
    """
    out: list[int] = []
    i, start = 0, 0
    while i < len(chunks):
        chunk = chunks[i]
        if i + 1 == len(chunks):
            out += chunk.ids[chunk.head[start] :]
            break
        safe, safe_ids = chunk.safe
        if safe >= start:
            out += chunk.ids[chunk.head[start] : safe_ids]
            window = chunk.end
        elif len(chunk.start) == chunk.size:
            safe, window = start, chunk.start[start:]
        else:
            raise RuntimeError("a chunk was met behind its safe end")
        j, at, met = i, 0, None
        begins = [(-safe, i)]
        while met is None:
            piece = tok.split.match(window, at)
            while (piece is None or piece.end() >= len(window) or at + REACH > len(window)) and j + 1 < len(chunks):
                if j > i and len(chunks[j].start) < chunks[j].size:
                    raise RuntimeError("a chunk was not met within its head")
                j += 1
                begins.append((len(window), j))
                window += chunks[j].start
                piece = tok.split.match(window, at)
            if piece is None:
                met = (len(chunks), 0)
                break
            if j > i and piece.end() >= len(window) and len(chunks[j].start) < chunks[j].size:
                raise RuntimeError("a chunk was not met within its head")
            out += tok.encode(piece.group())
            at = piece.end()
            if at >= len(window) and j + 1 == len(chunks):
                met = (len(chunks), 0)
                break
            for base, k in reversed(begins):
                if at >= base:
                    if k > i and at - base in chunks[k].head and at - base < chunks[k].size:
                        met = (k, at - base)
                    break
        i, start = met
    return out


# --- Content-defined chunks -------------------------------------------------------------------

_WINDOW = 16
_GEAR = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=7) for i in range(1 << 12)], dtype=np.uint64)


def cut_many(texts: list[str], mean: int = 512, least: int = 64, most: int = 4096) -> list[list[int]]:
    """Ends of the content-defined chunks of each text.

    A chunk ends after a character at which the rolling hash of the last 16 characters has its low
    bits zero, so equal passages are cut alike wherever they stand. ``mean`` must be a power of two;
    ends nearer than ``least`` to the one before are passed over and no chunk exceeds ``most``. All texts
    are hashed in one go: a window that reaches into the text before lies within ``least`` of the start.
    """
    whole = "".join(texts)
    n = len(whole)
    codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32) & np.uint32((1 << 12) - 1)
    gear = _GEAR[codes]
    rolled = np.zeros(n, dtype=np.uint64)
    for back in range(min(_WINDOW, n)):
        rolled[back:] += gear[: n - back] << np.uint64(2 * back)
    # The highest bits have seen the whole window.
    cuts = np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(mean - 1) == 0) + 1
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    low, high = np.searchsorted(cuts, starts[:-1], side="right"), np.searchsorted(cuts, starts[1:], side="left")
    out = []
    for k, text in enumerate(texts):
        ends, at, size = [], 0, len(text)
        for cut in [*(cuts[low[k] : high[k]] - starts[k]).tolist(), size]:
            while cut - at > most:
                at += most
                ends.append(at)
            if cut - at >= least or cut == size and cut > at:
                ends.append(cut)
                at = cut
        out.append(ends)
    return out


def cut_points(text: str) -> list[int]:
    return cut_many([text])[0]


def chunk_key(text: str) -> bytes:
    """128 bits that stand for the text of a chunk."""
    return xxhash.xxh3_128_digest(text.encode())
