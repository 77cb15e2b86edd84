"""The encoder of whole batches against the library."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazeline.llm import batch_encoder
from hazeline.llm.bpe_automaton import Automaton
from hazeline.llm.queries import BYTE_BPE

LIB = Tokenizer.from_file(BYTE_BPE)
ENCODER = batch_encoder.BatchEncoder(Automaton(BYTE_BPE), memo=50)
LETTERS = "aethn is'1\n\t.,!-▁é日😀<|>　  \u0085ñ\x1c\x7f "
TEXT = st.lists(
    st.one_of(st.text(alphabet=st.sampled_from(LETTERS), max_size=12), st.sampled_from(["<|endoftext|>", "don't", " word.", "  "])),
    max_size=6,
).map("".join)


def ids_of(texts, encoder=ENCODER):
    ids, n = encoder(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_ids_equal_the_library(texts):
    assert ids_of(texts) == [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_and_slices():
    texts = ["", "a" * 9000, " " * 300 + "x", "word " * 4000, "\n".join(["line."] * 500), "日本" * 900, ""]
    assert ids_of(texts) == [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]
    part = pa.array(texts).slice(2, 3)
    ids, n = ENCODER(part)
    assert len(n) == 3 and ids.tolist() == sum(ids_of(texts[2:5]), [])
    ids, n = ENCODER(pa.array([], pa.string()))
    assert len(ids) == len(n) == 0


def test_plain_special_strings():
    tok = Automaton(BYTE_BPE)
    tok.special, tok.split_special = {}, None
    lib = Tokenizer.from_file(BYTE_BPE)
    lib.encode_special_tokens = True
    texts = ["<|endoftext|>", "a <|endoftext|> b"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(texts, batch_encoder.BatchEncoder(tok)) == want
