import random
import time
import tracemalloc

from prospecta.llm import piece_bpe
from prospecta.llm.queries import model_path


def new_words(seed, texts):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 11)))
    return [" ".join(word() + rng.choice(["", "", ".", ",", ".\nThe"]) for _ in range(500)) for _ in range(texts)]


def test_what_a_worker_remembers_is_bounded():
    own = piece_bpe.PieceCodec(model_path())
    tracemalloc.start()
    try:
        for seed in range(4):
            for text in new_words(seed, 100):
                own.encode(text)
        assert tracemalloc.get_traced_memory()[0] < 30e6
    finally:
        tracemalloc.stop()


def test_new_words_cost_less_than_the_check_by_the_library():
    own, texts = piece_bpe.PieceCodec(model_path()), new_words(9, 300)
    piece_bpe.checked(own, texts[:20])
    began = time.process_time()
    own.library.decode(own.library.encode(texts, num_threads=1), num_threads=1)
    library = time.process_time() - began
    began = time.process_time()
    piece_bpe.checked(own, texts)
    assert time.process_time() - began < 4 * library


def test_unknown_characters_long_chunks_and_evicted_chunks():
    own = piece_bpe.PieceCodec(model_path())
    own.memory = piece_bpe.Memory(64)  # chunks put each other out
    texts = ["", " ", "中文😀 é é", "a" * 500, "x▁y  z\n\n", *new_words(1, 20), "Öß" * 90]
    for _ in range(2):
        ids, bounds = own.ids_of(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [own.library.encode(t) for t in texts]
    assert own.surface([own.byte[0xE4], own.byte[0xB8], own.ids["a"], own.byte[0xFF]]) == "�a�"
