"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of text in it; a text is encoded with each language's
dictionary, and the smallest result names the language. Case and what isn't a letter carry little, so texts and
dictionaries are lowered and everything but letters becomes one space. A text is encoded in pieces of ``PIECE`` bytes, all
of them, so that what a long or repetitive text says about itself doesn't outweigh what the dictionaries know.

A prediction is marked ``rejected`` where the margin, the share by which the second smallest result is larger, is
under ``MARGIN``; the language is given all the same. ``score`` is the softmax of minus the bits for each character,
times ``SHARP``, at the winner. Dictionaries are the whole texts of at most ``DOCS`` documents a language (smallest
hashes of doc_id, none longer than ``LONGEST`` bytes), while these have ``SIZE`` bytes together; predictions use whole texts.
More than ``LANGUAGES`` languages raise ValueError, as every task holds a dictionary for each.

Letters are what Unicode calls so: digits, fractions and other numbers aren't. Text that is null or has no letter is
``und`` with score 0, as is all text where no language was learnt. Ties go to
the name that comes first. Rows with null doc_id are predicted and not learnt from; rows that repeat get equal
predictions; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.rows import of_texts, remainder
from edgeloom.llm.sampling import bounded

DOCS, LONGEST, SIZE = 64, 16_000, 96_000
LANGUAGES = 200
LEVEL = 6
PIECE = 2048
MARGIN = 0.02
SHARP = 40.0
#: The first does for ASCII, in the faster module.
_NOT_ASCII_LETTERS = re.compile(r"[^a-z]+")
_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str | None) -> bytes:
    low = (text or "").lower()
    if low.isascii():
        return _NOT_ASCII_LETTERS.sub(" ", low).strip().encode()
    out = _NOT_LETTERS.sub(" ", low)
    if not out.replace(" ", "").isalpha():  # that module may know letters of a later Unicode
        out = " ".join("".join(c if c.isalpha() else " " for c in out).split())
    return out.strip().encode()


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Language to dictionary, from rows of docs(doc_id, text, lang) whose crc32(doc_id as text) mod 3 is not 1."""
    known = docs.select("doc_id", "text", F.col("lang").alias("__lang")).where("doc_id is not null and __lang is not null and length(text) > 0")
    known = known.where(F.octet_length("text") <= LONGEST).where(remainder(F.col("doc_id"), 3) != 1)
    if known.select("__lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    out: dict[str, bytes] = {}
    rows = bounded(known, "__lang", DOCS, F.col("doc_id")).select("doc_id", "text", "__lang", "__h").collect()
    for r in sorted(rows, key=lambda r: (r["__lang"], r["__h"], r["doc_id"], r["text"])):
        more = letters(r["text"]) + b" "
        if len(now := out.setdefault(r["__lang"], b"")) + len(more) <= SIZE:
            out[r["__lang"]] = now + more
    return dict(sorted(out.items()))


class Compressors:
    """One for each language, with its dictionary digested once."""

    def __init__(self, dicts: dict[str, bytes]):
        self.names = list(dicts)
        self.by = []
        for raw in dicts.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        raw = letters(text)
        if not raw or not self.by:
            return "und", 0.0, True
        pieces = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in self.by], float)
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        margin = (rest.min() - sizes[best]) / sizes[best] if len(rest) else 1.0
        share = np.exp(-SHARP * (sizes - sizes[best]) / len(raw))
        return self.names[best], float(1 / share.sum()), bool(margin < MARGIN)


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs(doc_id, text); learn_from(doc_id, text, lang) is docs unless given."""
    dicts = dictionaries(docs if learn_from is None else learn_from)

    def start():
        by = Compressors(dicts)
        return lambda texts: [list(c) for c in zip(*map(by.predict, texts), strict=True)]

    out = of_texts(docs, {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}, start)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
