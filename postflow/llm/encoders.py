"""Token ids of whole texts, as little-endian unsigned 32-bit integers in ``bytes``."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

ID = np.dtype("<u4")


class ByteEncoder:
    """Ranks of a byte-level vocabulary.  A rank file names no added tokens, so they are the caller's:
    ``added`` holds (content, id).  Texts are cut at them as the tokenizers library does by default;
    ``plain`` takes them as ordinary text."""

    def __init__(self, path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        self.added = dict(added)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, text: str) -> bytes:
        parts = self.cut(text) if self.cut else [text]
        if len(parts) == 1:
            return np.array(self.plain(text), ID).tobytes()
        ids: list[int] = []
        for k, part in enumerate(parts):
            ids += [self.added[part]] if k % 2 else self.plain(part)
        return np.array(ids, ID).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes of the tokens, one after another."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, ID).tolist()])


class WordEncoder:
    """A vocabulary file whose words end in a mark and whose white space carries no id.

    Texts of Latin letters (code points 1 to U+024F) are lower-cased and cut into words here, and the
    merges run in the faster rank encoder, with a zero byte as the mark.  Both ways give the same ids
    when every entry of the vocabulary encodes to itself, which a test asserts.  Any other text, and one
    that holds an added token, goes to the tokenizers library as it is.
    """

    LATIN = re.compile("[\x01-ɏ]*")
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\x09-\x0d\x20\x85\xa0\p{L}\p{N}]+"
    MARK = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        with open(path) as f:
            entries = json.load(f)
        special = {t["content"] for t in entries["added_tokens"]}
        self.added = tuple(special)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        char = {}
        for byte in range(128):
            char[level.pre_tokenize_str(chr(byte))[0][0]] = byte
        for point in range(128, 2048):
            for c, byte in zip(level.pre_tokenize_str(chr(point))[0][0], chr(point).encode()):
                char[c] = byte
        ranks, rest = {}, iter(sorted(set(range(256)) - set(char.values())))
        self.entries = {}
        for entry, rank in entries["model"]["vocab"].items():
            if entry not in special:
                marked = entry.endswith(self.MARK) and entry != self.MARK
                plain = entry.removesuffix(self.MARK) if marked else entry
                for c in plain:
                    if c not in char:  # bytes that no code point below U+0800 holds
                        char[c] = next(rest)
                token = bytes(char[c] for c in plain) + b"\0" * marked
                ranks.setdefault(token, rank)
                self.entries[entry] = rank
        self.cut = regex.compile(self.WORDS).findall
        self.merge = tiktoken.Encoding(path, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.LATIN.fullmatch(text) or any(t in text for t in self.added):
            return self.whole(text)
        words = self.cut(text.lower())
        return np.array(self.merge("\0".join(words) + "\0"), ID).tobytes() if words else b""


@lru_cache(maxsize=4)
def byte_encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> ByteEncoder:
    return ByteEncoder(path, pattern, added)


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(content, id) of the added tokens that a tokenizers file names."""
    with open(path) as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
