"""Token operators against the public libraries, and exact round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import bpe, token_counts

ODD = ["", "a", " ", "  a", "\n\n x", "'re 're'll don't", "a\x1cb \x85 c", "é" * 70, "漢字かな交じり文", "🙂🏽" * 9, "aaaa" * 60, "x" * 1500, "!" * 400, "<|endoftext|> hi<|endoftext|>", "\x00\x1f　 .", "THE QUICK", "1234567890 ½"]


@pytest.fixture(scope="module")
def mine():
    return bpe.tokenizer(P.path(bpe.RANKS_FILE), P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(P.path(token_counts.MODEL_FILE), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path(token_counts.MODEL_FILE))


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def test_encoding(mine, theirs):
    got = mine.encode_batch(ODD)
    assert [ids(x) for x in got] == [theirs.encode_ordinary(x) for x in ODD]
    assert mine.decode_batch(got) == [x.encode() for x in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=50) | st.text("aeinst rlh'\n", max_size=120), max_size=6))
def test_encoding_of_any_text(mine, theirs, texts):
    assert [ids(x) for x in mine.encode_batch(texts)] == [theirs.encode_ordinary(x) for x in texts]


def test_both_trees_agree(mine):
    words = [w.encode() for w in ("internationalisation", "zzzzzzzz", "thtioninor", "é" * 12)]
    assert [ids(x) for x in mine.merge_forest(words, 32)] == [mine.merge_long(w) for w in words]


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=40) | st.text("aeinst rlh'<|endoftx>\n ", max_size=80))
def test_counts_at_every_prefix(counter, library, text):
    prefixes = [text[:i] for i in range(len(text) + 1)]
    want = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
    assert counter.prefix_counts(text).tolist() == want and counter.count_batch([text]) == [want[-1]]


def test_budget(counter, library):
    text = "The quick brown fox jumps over the lazy dog. " * 5
    n = counter.fits(text, 17)
    assert len(library.encode(text[:n], add_special_tokens=False).ids) <= 17 < len(library.encode(text[: n + 1], add_special_tokens=False).ids)


def test_operators(spark, theirs, library):
    rows = [(i, t, "clash", 5) for i, t in enumerate(ODD)] + [(None, None, None, None), (3, "x", "y", 1), (3, "x", "y", 1), (99, "lorem ipsum " * 20000, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.digests(bpe.encode_documents(df, decode=True)).collect()
    assert len(got) == len(rows)
    for r, (i, t, *_) in zip(got, rows, strict=True):
        want = theirs.encode_ordinary(t or "")
        assert (r["doc_id"], r["n_tokens"]) == (i, len(want))
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert [bytes(r["decoded"]).decode() for r in back] == [t or "" for _, t, *_ in rows]
    counts = token_counts.count_tokens(df, limit=3, prefix=True).collect()
    for r, (i, t, *_) in zip(counts, rows, strict=True):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) == (i, len((t or "").encode()), n, n > 3) and r["fits_chars"] <= len(t or "")
    empty = df.limit(0)
    assert bpe.encode_documents(empty).count() == 0 and token_counts.count_tokens(empty).count() == 0
