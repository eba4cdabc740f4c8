"""Pieces of many texts are looked up once, and encoded as the public library does."""

import random

import pyarrow as pa
from epispan.llm import tokenfile as T
from epispan.llm.pretokens import PieceEncoder


def test_a_piece_of_many_texts_is_looked_up_once():
    asked = []
    encoder = PieceEncoder(lambda piece: [piece], lambda tokens: [t.upper().encode() for t in tokens])
    table = encoder.known.table
    encoder.known.table = lambda wanted: (asked.extend(wanted), table(wanted))[1]
    texts = ["one two two", "", "two one\nthree", "one  two\tfour", "a\0b two"] * 150
    assert encoder.encode(texts) == [t.upper().encode() for t in texts]
    assert len(asked) == len(set(asked))


def test_batches_are_encoded_together_up_to_a_size():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 10})
    assert [len(g) for g in T.grouped(iter([batch] * 5), 2 * batch.nbytes)] == [2, 2, 1]


def test_odd_pieces_equal_the_library():
    encoder = T.Encoder(T.default_definition())
    draw = random.Random(1)
    letters = "ab' \n!.,#$é中1²½ⅷ_́😀\t"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(14))) for _ in range(3000)]
    texts += ["it's 'll we'll!'s", "word$$$ word,### <|endoftext|>", " ", "\0", "a\0b"]
    assert encoder.encode(texts, 2) == [encoder.encode_text(t) + b"\2\0" for t in texts]
    assert encoder.split(" word,###") == [" word", ",###"]
