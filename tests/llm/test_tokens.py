import numpy as np
import pytest

from tessera.llm.tokens import ChunkTokenizer, default_path

from .samples import texts

ODD = ["don't we'll I'M it's", "a'b ''s x's.", "naïve café é   nbsp em", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ. İstanbul ﬁ K", "12,345.67 -- ... !!! #tag @x", "日本語 テキスト", "word. word, (word) [word] word'", "퟿�\x00\x1f", "x" * 3000]


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_same_as_whole_texts(most):
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(default_path()), ChunkTokenizer(most=most)
    every = [t or "" for t in texts()] + ODD
    for a in range(0, len(every), 9):
        part = every[a : a + 9]
        ids, counts = ours.encode([t.encode() for t in part])
        want = [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_few_chunks_are_held_and_the_first_ones_stay():
    ours = ChunkTokenizer(most=100)
    ours.encode([" ".join(f"often{i}" for i in range(40)).encode()])
    for k in range(5):
        ids, counts = ours.encode([" ".join(f"seldom{k}x{i}" for i in range(90)).encode(), b"often7 often39"])
        assert all(f"often{i}".encode() in ours.known for i in range(40)) and len(ours.known) <= 100 // 2 + 90
        assert len(ours.known) == len(ours.at) == len(ours.size) and len(ours.flat) == ours.size.sum()
        assert np.array_equal(ids[-counts[1] :], ChunkTokenizer().encode([b"often7 often39"])[0])
    assert ChunkTokenizer().most <= 400_000  # of about 150 bytes each, in every worker of an executor
