import pytest

from prospecta.llm import piece_bpe
from prospecta.llm.queries import model_path


def test_a_difference_in_any_text_raises():
    own = piece_bpe.PieceCodec(model_path())
    texts = [f"text number {i}" for i in range(30)] + [""]
    assert [n for n, _, _ in piece_bpe.checked(own, texts)] == [len(own.library.encode(t)) + 1 for t in texts]
    chunk = own.chunks(texts[7])[-1]
    own.memory[chunk] = (1, "5", "x")
    with pytest.raises(ValueError, match="text number 7"):
        piece_bpe.checked(own, texts)
