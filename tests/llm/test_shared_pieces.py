"""Words that differ only in what stands around them share their pieces."""

from millrace.llm.bpe import Encoder


def test_a_piece_is_encoded_once():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b" ab": 257, b"abab": 258}
    encoder = Encoder(ranks, r" ?\w+|\s+|[^\w\s]+")
    asked = []
    encode = encoder.transducer.encode
    encoder.transducer.encode = lambda piece: asked.append(piece) or encode(piece)
    ids = encoder.encode("x abab, abab. abab; abab, (abab")
    assert asked.count(b" abab") == 1
    assert ids.split(" ")[1:3] == ids.split(" ")[4:6]
    encoder.close()
    assert not encoder.parts and encoder.encode("x abab, abab. abab; abab, (abab") == ids
