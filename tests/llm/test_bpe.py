import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from edgeloom.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
OWN, THEIRS = bpe.Bpe(FILE), Tokenizer.from_file(FILE)
TEXTS = [
    "", " ", "  \n\n x", "it's we'll  I'D 'sx", "Äpfel übers ç ½ ²³ 123 4５ \x85\xa0\x1c\x1d x", "<|endoftext|>a <|endoftext|><|endoft", "日本語 тест 🙂‍🙂 é",
    "x" * 1000, "ab" * 5000 + " ***%%%" * 40, "THTHES!! REWH!!\t\t\r\n", "a\u0000b", " 　  ",
]


def same(text):
    ids = OWN.encode(text)
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert OWN.decode(ids) == THEIRS.decode(want, skip_special_tokens=False)


def test_like_the_library():
    for t in TEXTS:
        same(t)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeioutnrs THE'sl 12½é\n\t.,* ́ж字🙂"), max_size=300) | st.text(max_size=60))
def test_like_the_library_on_any_text(text):
    same(text)


def test_short_and_long_words_merge_alike():
    for w in (b"a", b"the", b"internationalization" * 6, bytes(range(128))):
        assert OWN._short(w) == OWN._long(w)


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y"), (0, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(docs, FILE, tokens=True).collect()
    assert len(got) == len(rows)
    for r in got:
        t = TEXTS[r.doc_id] if r.doc_id is not None else ""
        ids = THEIRS.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (
            len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(),
        )
    assert bpe.encode_documents(docs.limit(0), FILE).count() == 0
