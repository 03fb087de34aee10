"""What the byte-level encoder remembers changes neither ids nor decoded bytes."""

import pytest

from millrace.llm import bpe

TEXTS = [
    "", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\n", "plain words plain words", "word, word. word", "naïve 🙂🙂 日本語 naïve",
    "x" * 300, "1234567 12345678", "don't don't", "a b  c", "internationalisation internationalise rationalise",
]


def _plain(ranks, piece):
    """Merge the pair of least rank, the leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        best = min(range(len(found)), key=found.__getitem__)
        if found[best] == 1 << 60:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def made():
    path, pattern = bpe._public()
    ranks = bpe.read_ranks(path)
    return ranks, bpe.Encoder(ranks, pattern)


@pytest.mark.parametrize("limits", [{}, {"HEADS": 2, "TAILS": 2, "PARTS": 2, "PIECES": 2}, {"TAIL": 1}, {"TAIL": 64}])
def test_ids_and_bytes_with_any_memory(made, monkeypatch, limits):
    ranks, e = made
    for name, value in limits.items():
        monkeypatch.setattr(bpe, name, value)
    e.close()
    for text in TEXTS * 2:
        runs = e.runs(text)
        ids = " ".join(r[0] for r in runs)
        assert ids == " ".join(str(i) for p in e.pieces(text) for i in _plain(ranks, p.encode())) == e.encode(text)
        assert b"".join(r[1] for r in runs) == text.encode()
    e.close()
    assert not (e.known or e.parts or e.transducer.heads or e.transducer.tails)
