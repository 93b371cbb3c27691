"""BPE encoding and decoding with contiguous rank arrays.

A word (a piece that the pre-tokenizer's pattern cuts) of up to ``SHORT`` bytes is held as two contiguous arrays: the
boundaries of its parts, and for each inner boundary the rank of the merge that would delete it. The least rank is
found by scanning, its boundary is deleted, and the ranks of the two neighbouring boundaries are looked up again.
Longer words would cost time in the square of their length that way; they go through a heap of (rank, place) with
linked parts, which merges in the same order. A task remembers the ids of the words it has seen, two generations of
``WORDS`` at most, and forgets them and the file's tables when its partition ends.

Results equal the tokenizers library's for byte-level BPE files with its GPT-2 pattern: strings of special tokens in
a text are those tokens (as there, without encode_special_tokens), no others are added, nothing is cut or padded.
Decoding joins the bytes of the ids and replaces what isn't UTF-8. Null text counts as empty and has no ids; rows
that repeat are each encoded; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from edgeloom.llm.rows import of_texts

SHORT = 128
WORDS = 120_000
NEVER = 1 << 60

#: The pre-tokenizer's pattern. The second form has the letters, numbers and white space of Latin-1 spelt out, and runs in the faster module.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_L, _N, _S = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc\xbd\xbe", "\t-\r \x85\xa0"
LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class Bpe(dict):
    """Word to tuple of ids, worked out when first asked for. file: a tokenizer.json with a byte-level BPE model."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # Byte-level files spell each byte as a printable character: Latin-1's own where it prints, else from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        as_bytes = lambda token: bytes(spelt[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {}
        self.left = []
        for r, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            if a + b in self.rank:
                raise ValueError("two merges make the same token")
            self.rank[a + b] = r
            self.left.append(len(a))
        self.before: dict[str, tuple[int, ...]] = {}
        self.find = re.compile(LATIN).findall
        self.find_any = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _rank(self, w: bytes, a: int, b: int, c: int) -> int:
        """Of the merge of w[a:b] and w[b:c]."""
        r = self.rank.get(w[a:c], NEVER)
        return r if r == NEVER or self.left[r] == b - a else NEVER

    def _short(self, w: bytes) -> list[int]:
        at = list(range(len(w) + 1))
        ranks = [self._rank(w, i, i + 1, i + 2) for i in range(len(w) - 1)]  # ranks[i]: for deleting at[i + 1]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            del at[i + 1], ranks[i]
            if i:
                ranks[i - 1] = self._rank(w, at[i - 1], at[i], at[i + 1])
            if i < len(ranks):
                ranks[i] = self._rank(w, at[i], at[i + 1], at[i + 2])
        return at

    def _long(self, w: bytes) -> list[int]:
        n = len(w)
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self._rank(w, i, i + 1, i + 2)) != NEVER]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if gone[a] or gone[b] or after[a] != b or after[b] != c:
                continue
            gone[b] = 1
            after[a], before[c] = c, a
            if a and (r := self._rank(w, before[a], a, c)) != NEVER:
                heapq.heappush(heap, (r, before[a], a, c))
            if c < n and (r := self._rank(w, a, c, after[c])) != NEVER:
                heapq.heappush(heap, (r, a, c, after[c]))
        return [i for i in range(n + 1) if not gone[i]]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (ids := self.before.get(word)) is None:
            w = word.encode()
            if w in self.id_of and len(w) == 1:
                ids = (self.id_of[w],)
            else:
                at = self._short(w) if len(w) <= SHORT else self._long(w)
                ids = tuple(self.id_of[w[a:b]] for a, b in zip(at, at[1:]))
            if len(w) > SHORT:
                return ids
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        try:
            text.encode("latin-1")
            find = self.find
        except UnicodeEncodeError:
            find = self.find_any
        return map(self.__getitem__, find(text))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not any(t in text for t in self.special):
            return list(chain.from_iterable(self._plain(text)))
        out: list[int] = []
        for piece in self.cut.split(text):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out.extend(chain.from_iterable(self._plain(piece)))
        return out

    def encode_plain(self, text: str | None) -> list[int]:
        """As encode, but that strings of special tokens are ordinary text."""
        return list(chain.from_iterable(self._plain(text or "")))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, file: str, tokens: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs(doc_id, text); and with tokens, ids as an array of int."""

    def start():
        bpe = Bpe(file)

        def run(texts: list) -> list:
            n, shas, decoded, kept = [], [], [], []
            for text in texts:
                ids = bpe.encode(text)
                n.append(len(ids))
                shas.append(_sha(",".join(map(bpe.text_of.__getitem__, ids))))
                decoded.append(_sha(bpe.decode(ids)))
                if tokens:
                    kept.append(np.array(ids, np.int32))
            return [n, shas, decoded, *([kept] if tokens else [])]

        return run

    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return of_texts(docs, fields | ({"ids": pa.list_(pa.int32())} if tokens else {}), start, 64)
