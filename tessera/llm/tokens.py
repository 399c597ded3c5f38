"""Token ids of whole texts through the tokenizers library, with each distinct white-space-delimited chunk encoded once.

The public word-level vocabulary normalises with NFC, white-space folding and lower case, and its pre-tokenizer never
lets a piece span white space. The ids of a text are therefore those of its chunks in a row, which lets a worker keep
the ids of chunks that it has met. test_tokens.py compares the result with encoding whole texts.
"""

from __future__ import annotations

import os
from itertools import islice, repeat

import numpy as np

#: What the pre-tokenizer cuts off after letters. Without the apostrophe, which can begin a piece with letters.
PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """encode(texts) gives all ids in a row and how many each text has.

    most: distinct chunks remembered before the later half goes, which bounds the memory.
    """

    def __init__(self, path: str | None = None, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.most = most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Drops all chunks but the first half of `most`: frequent ones are met early."""
        n = min(self.most // 2, len(self.known))
        self.known = dict(islice(self.known.items(), n))
        self.at, self.size = self.at[:n].copy(), self.size[:n].copy()
        self.flat = self.flat[: self.size.sum()].copy()

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are one pre-token each, in a row, and how many each has: an id that ends a word ends the text."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(texts), 4_000):
            part = texts[a : a + 4_000]
            got = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            size = np.diff(np.flatnonzero(self.ends[got]), prepend=-1)
            if len(size) != len(part) or size.sum() != len(got):
                own = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                got, size = np.asarray([i for x in own for i in x], np.uint32), np.fromiter(map(len, own), np.int64, len(own))
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, chunks: list[bytes]) -> None:
        """Letters and the punctuation after them are pre-tokens of their own, so each distinct one is encoded once."""
        parts: dict[str, int] = {}
        head, tail, rest = [], [], []
        order = []
        for c in chunks:
            base = c.rstrip(PUNCTUATION)
            text = base.decode("utf-8", "replace")
            if text.isalpha():
                order.append(c)
                head.append(parts.setdefault(text, len(parts)))
                tail.append(parts.setdefault(c[len(base) :].decode(), len(parts)) if len(base) < len(c) else -1)
            else:
                rest.append(c)
        flat, size = self.pieces(list(parts))
        at = np.cumsum(size) - size
        at, size = np.append(at, 0), np.append(size, 0)  # the last stands for no punctuation
        both = np.empty((len(head), 2), np.int64)
        both[:, 0], both[:, 1] = head, tail
        both = both.ravel()
        own = [gather(flat, at[both], size[both])]
        sizes = [size[both].reshape(-1, 2).sum(axis=1)]
        for a in range(0, len(rest), 4_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in rest[a : a + 4_000]], add_special_tokens=False)]
            own.append(np.asarray([i for x in ids for i in x], np.uint32))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        new = np.concatenate(sizes)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(new) - new])
        self.size = np.concatenate([self.size, new])
        self.flat = np.concatenate([self.flat, *own])
        self.known.update(zip(order + rest, range(len(self.known), len(self.known) + len(chunks)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self.forget()
        chunks: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = (text if b"<|" in text else text.lower()).split()  # the names of special tokens keep their case
            counts[i] = len(own)
            chunks += own
        k = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(unknown := np.flatnonzero(k < 0)):
            new = [chunks[i] for i in unknown.tolist()]
            self.learn(list(set(new)))
            k[unknown] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        size = self.size[k]
        bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return gather(self.flat, self.at[k], size), np.diff(bounds)


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[at[0] : at[0] + size[0]], flat[at[1] : ...], ... in a row."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(at - (ends - size), size)]


_held: dict[str, ChunkTokenizer] = {}


def held(path: str | None = None) -> ChunkTokenizer:
    """The tokenizer that this worker process keeps for the path."""
    key = path or ""
    if key not in _held:
        _held[key] = ChunkTokenizer(path)
    return _held[key]
