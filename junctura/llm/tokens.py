"""Token ids of whole texts, by the ``tokenizers`` library.

A byte-level pre-tokenizer of this kind never lets a token span the border between a character that is no white
space and a following single blank (or line feed) that is followed by no white space again, and what it
does right of such a border does not depend on what stands left of it. So a text can be cut there, and
each distinct fragment is encoded by the library once per worker. Texts with doubled or outer white space in a
line, or with a special token's string in them, are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

from . import hashing

END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_STEP = 1 << 20
_BLANK = np.isin(np.arange(256), [10, 32])
#: Bytes that make a text irregular: other white space of ASCII.
_ODD = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
#: White space above ASCII, as UTF-8; fixed values.
_WIDE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class FragmentEncoder:
    """Ids of texts; keeps the ids of at most about ``most`` fragments in one array.

    A fragment is a blank or a line feed and the word after it. Distinct words of a batch are looked up by hashes, and only new ones are
    encoded. Each word's bytes are compared with those of the word whose ids it gets; where they differ, the text is encoded whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.most = most
        self.feed = self._library("\n")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.used = np.empty(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.empty(1 << 14, "i8"), np.empty(1 << 14, "i4")
        # the bytes of known words, behind one another
        self.bytes, self.filled = np.zeros(1 << 20, "u1"), 0
        self.begins, self.lengths = np.empty(1 << 14, "i8"), np.empty(1 << 14, "i8")

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, hashes: np.ndarray, words: list[bytes], before: bytes) -> None:
        """Encode new words, all in one text where line feeds part them, and keep their ids."""
        text = (b"\n".join(b" " + w for w in words) if before == b" " else b"\n" + b"\n".join(words)).decode()
        ids = self._library(text)
        at = np.flatnonzero(ids == self.feed[0])
        if len(self.feed) == 1 and len(at) == len(words) - (before == b" "):
            starts = np.concatenate([[0], at + 1]) if before == b" " else at
            ends = np.concatenate([at, [len(ids)]]) if before == b" " else np.concatenate([at[1:], [len(ids)]])
        else:
            each = [self._library((before + w).decode()) for w in words]
            ids = np.concatenate(each)
            ends = np.cumsum([len(x) for x in each])
            starts = ends - [len(x) for x in each]
        n, m = len(self.known), len(words)
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while len(self.starts) < n + m:
            for name in ("starts", "sizes", "begins", "lengths"):
                setattr(self, name, np.concatenate([getattr(self, name), np.empty_like(getattr(self, name))]))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m], self.sizes[n : n + m] = starts + self.used, ends - starts
        self.used += len(ids)
        self.lengths[n : n + m] = np.fromiter(map(len, words), "i8", m)
        ends = self.filled + np.cumsum(self.lengths[n : n + m])
        while len(self.bytes) < ends[-1] + 16:
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.filled : ends[-1]] = np.frombuffer(b"".join(words), "u1")
        self.begins[n : n + m], self.filled = ends - self.lengths[n : n + m], int(ends[-1])
        self.known.update(zip(hashes.tolist(), range(n, n + m)))

    def _same(self, blocks: hashing.Blocks, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether the parts of a buffer are, byte by byte, the known words."""
        same = self.lengths[word] == ends - starts
        some = np.flatnonzero(same)
        same[some] = hashing.equal(blocks, starts[some], hashing.Blocks(self.bytes), self.begins[word[some]], ends[some] - starts[some])
        return same

    def _fragments(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that are regular: words, single blanks and line feeds between them."""
        buf = b"\n".join(parts)
        a = np.frombuffer(buf, "u1")
        lengths = np.fromiter(map(len, parts), "i8", len(parts)) + 1
        begins = np.cumsum(lengths) - lengths
        gaps = np.flatnonzero(_BLANK[a])
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(a)]])
        first = np.concatenate([[True], a[gaps] == 10])
        blocks = hashing.Blocks(buf)
        h = hashing.hashes(buf, blocks, starts, ends) | np.uint64(1)
        h ^= first  # the lowest bit tells what stands before
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._forget()
        get = self.known.get
        index = np.fromiter((get(x, -1) for x in distinct.tolist()), "i8", len(distinct))
        for before, side in ((b" ", 1), (b"\n", 0)):
            new = np.flatnonzero((index < 0) & ((distinct & np.uint64(1)) == side))
            for k in range(0, len(new), 8192):
                some = new[k : k + 8192]
                n = len(self.known)
                self._learn(distinct[some], [buf[p:q] for p, q in zip(starts[where[some]].tolist(), ends[where[some]].tolist())], before)
                index[some] = np.arange(n, n + len(some))
        word = index[back]
        size = self.sizes[word].astype("i8")
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(self.starts[word] - (stop - size), size) + np.arange(int(stop[-1]))]
        # a text's first word was encoded after a line feed that is not there
        head = np.searchsorted(starts, begins)
        a0 = (stop - size)[head] + len(self.feed)
        a1 = np.concatenate([(stop - size)[head[1:]], stop[-1:]])
        out = [ids[p:q] for p, q in zip(a0.tolist(), a1.tolist())]
        other = np.flatnonzero(~self._same(blocks, starts, ends, word))
        for k in np.unique(np.searchsorted(begins, starts[other], side="right") - 1).tolist():
            out[k] = self._library(parts[k].decode())
        return out

    def _regular(self, part: bytes) -> bool:
        if not part or b"  " in part or b"\n\n" in part or b" \n" in part or b"\n " in part or part[0] in b" \n" or part[-1] in b" \n":
            return False
        return not _ODD[np.frombuffer(part, "u1")].any() and not _WIDE.search(part) and not any(s in part for s in self.specials)

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text, as ``<u4``."""
        out: list[np.ndarray | None] = []
        held: list[bytes] = []
        places: list[int] = []
        size = 0

        def flush() -> None:
            for k, ids in zip(places, self._fragments(held)):
                out[k] = ids
            held.clear()
            places.clear()

        for t in texts:
            part = t.encode()
            if not self._regular(part):
                out.append(self._library(t) if t else np.empty(0, "<u4"))
                continue
            if held and size + len(part) >= _STEP:
                flush()
                size = 0
            places.append(len(out))
            out.append(None)
            held.append(part)
            size += len(part) + 1
        if held:
            flush()
        return out


_ENCODERS: dict[str, FragmentEncoder] = {}


def encoder(path: str) -> FragmentEncoder:
    """The worker's encoder; Python workers are kept between tasks, and so is what it has encoded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = FragmentEncoder(path)
    return _ENCODERS[path]


def encoded(path: str, texts: Iterable[str | None], end_id: int | None = END_ID, batch: int = 1000) -> Iterable[bytes]:
    """Ids of each text (null: empty) and the end id, as bytes of ``<u4``."""
    enc, end = encoder(path), b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    texts = list(texts)
    for i in range(0, len(texts), batch):
        for ids in enc.encode(["" if t is None else t for t in texts[i : i + batch]]):
            yield ids.tobytes() + end
