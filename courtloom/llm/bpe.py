"""Byte-level BPE encoding with content-defined chunks that are encoded once and joined exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODES = "n_tokens long, ids_sha256 string, decoded_sha256 string, chunks long, reused long"
#: Fixed value: the pattern that byte-level BPE splits a text with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs that all Unicode versions class alike.
_COMMON = re.compile(r"[\t\n\r -~\xa1-\u024f]+")
#: A space after white space: its join is doubtful.
_DOUBT = re.compile(r"[\s\x1c-\x1f\x85] ")
#: A join that always agrees: before a space that follows a sign that is no white space.
_JOIN = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= )")


def cut_before(text: str, at: int) -> bool:
    """Whether the encodings of text[:at] and text[at:] always join to that of the text: the pre-tokenizer takes white
    space only at the start of a word or as a run of its own, so a word ends before a space that follows a non-space."""
    return 0 < at < len(text) and text[at] == " " and _JOIN.match(text, at) is not None


def chunks_of(text: str, mean: int = 64, exact: bool = False, window: int = 8) -> Iterator[str]:
    """Content-defined chunks: a rolling hash of `window` code points proposes cuts, on average every `mean` points, and
    each is moved on to the next exact join. Equal passages so fall into equal chunks wherever they stand. exact: every
    space is such a join, so they need not be looked at."""
    if len(text) <= mean:
        if text:
            yield text
        return
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    rolled = np.zeros(max(len(points) - window + 1, 0), np.uint32)
    for k in range(window):
        rolled = rolled * np.uint32(0x01000193) + points[k : k + len(rolled)]
    rolled = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    wanted = np.flatnonzero((rolled >> np.uint32(16)) % np.uint32(mean) == 0) + window
    low = 0
    for at in wanted.tolist():
        if at <= low:
            continue
        at = text.find(" ", at)
        while not exact and at != -1 and not cut_before(text, at):      # a doubtful join: encode both sides as one chunk
            at = text.find(" ", at + 1)
        if at == -1:
            break
        yield text[low:at]
        low = at
    yield text[low:]


class ChunkCoder:
    """Encodes through two memos, of chunks and of the words in them; each is emptied when it has its number of entries
    (about 0.3 kB for a word and 0.4 kB for a chunk) or when long ones fill it.

    A word's ids are kept as text, joined by commas, and only once they have been decoded to the word again. New words
    of common letters go through the faster of the two libraries, if both encode every entry of the vocabulary alike.
    """

    def __init__(self, path: str, mean: int = 64, words: int = 250_000, chunks: int = 40_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mean, self.most, self.size = mean, (words, chunks), [0, 0]
        self.spaced: dict[str, str] = {}        # of " word"
        self.plain: dict[str, str] = {}
        self.chunks: dict[str, str] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        back = self._alphabet()
        special = {k for k in self.tokenizer.get_added_tokens_decoder()}
        self.bytes_of = {k: t.encode() if k in special else bytes(back[c] for c in t) for t, k in vocabulary.items()}
        self.fast = self._fast({k: b for k, b in self.bytes_of.items() if k not in special})

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}

    def _fast(self, bytes_of: dict[int, bytes]):
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: k for k, b in bytes_of.items()}, special_tokens={}).encode_ordinary
        texts = [t for t in (b.decode("utf-8", "ignore") for b in bytes_of.values()) if _COMMON.fullmatch(t)]
        alike = all(e.ids == coder(t) for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True))
        return coder if alike else None

    def encode(self, pieces: list[str]) -> list[str]:
        """Ids of each piece joined by commas; an error if they do not decode to the piece."""
        slow = [x for x in pieces if self.fast is None or not _COMMON.fullmatch(x) or "<|" in x]
        known = dict(zip(slow, (e.ids for e in self.tokenizer.encode_batch_fast(slow, add_special_tokens=False)), strict=True)) if slow else {}
        out, table = [], self.bytes_of
        for piece in pieces:
            ids = known[piece] if piece in known else self.fast(piece)
            if b"".join([table[k] for k in ids]) != piece.encode():
                raise ValueError("this tokenizer does not give back the text it encodes")
            out.append(",".join(map(str, ids)))
        return out

    def _learn(self, memo: dict[str, str], words: list[str], lead: str) -> None:
        new = [w for w in dict.fromkeys(words) if w not in memo]
        memo.update(zip(new, self.encode([lead + w for w in new]), strict=True))
        self.size[0] += len(new) + sum(map(len, new)) // 64

    def _chunk(self, chunk: str, exact: bool) -> str:
        """Ids of a chunk from those of its words. exact: every space in the text is an exact join."""
        if exact and chunk[0] == " ":
            memo, words, lead = self.spaced, chunk[1:].split(" "), " "
        else:
            memo, words, lead = self.plain, _JOIN.split(chunk), ""
        try:
            return ",".join([memo[w] for w in words])
        except KeyError:
            self._learn(memo, words, lead)
            return ",".join([memo[w] for w in words])

    def code(self, text: str | None) -> tuple[int, str, str, int, int]:
        """(tokens, digest of the ids, digest of the decoded text, chunks, chunks that were known)."""
        text = text or ""
        exact, ids, decoded, commas, n, old = not _DOUBT.search(text), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for some in self._some(chunks_of(text, self.mean, exact)):
            if self.size[0] > self.most[0]:
                self.spaced, self.plain, self.size[0] = {}, {}, 0
            if self.size[1] > self.most[1]:
                self.chunks, self.size[1] = {}, 0
            got = []
            for chunk in some:
                have = self.chunks.get(chunk)
                if have is None:
                    have = self.chunks[chunk] = self._chunk(chunk, exact)
                    self.size[1] += 1 + len(chunk) // 1024
                else:
                    old += 1
                got.append(have)
            joined = ("," if n else "") + ",".join(got)
            ids.update(joined.encode())
            decoded.update("".join(some).encode())      # each word's ids have been decoded to the word
            commas, n = commas + joined.count(","), n + len(some)
        return commas + 1 if n else 0, ids.hexdigest(), decoded.hexdigest(), n, old

    @staticmethod
    def _some(chunks: Iterator[str]) -> Iterator[list[str]]:
        held: list[str] = []
        for chunk in chunks:
            held.append(chunk)
            if len(held) == 1024:
                yield held
                held = []
        if held:
            yield held


@lru_cache(maxsize=1)
def _coder(path: str, mean: int) -> ChunkCoder:
    return ChunkCoder(path, mean)


def encode_narrations(narrations: DataFrame, tokenizer_path: str, mean: int = 64) -> DataFrame:
    """The columns of `narrations` and the struct `codes` (CODES) of each whole summary.

    Exactly the ids that the tokenizer gives for the whole text without added special tokens (a special token's string
    in a text is that token), and the text that they decode to. Each task keeps what it has encoded, so a chunk shared
    by narrations is encoded once while the memo holds it; the memo changes the time, never the result. A null summary
    counts as empty: no token, digests of the empty string. `tokenizer_path` must be readable on every machine.
    """
    @F.pandas_udf(CODES)
    def encode(texts: pd.Series) -> pd.DataFrame:
        coder = _coder(tokenizer_path, mean)
        return pd.DataFrame([coder.code(x) for x in texts], columns=[c.split()[0] for c in CODES.split(", ")])

    return narrations.withColumn("codes", encode("summary"))
