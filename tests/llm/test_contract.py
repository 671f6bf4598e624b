import random

import numpy as np
from tokenizers import Tokenizer

from omiclattice.llm import tokens

PATH = tokens.tokenizer_path()


def test_special_strings_are_single_tokens():
    """The tokenizer as its file says, with nothing set but add_special_tokens=False."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|> ", "a  <|endoftext|>  b", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "<|endoftext |> <|endoftext|>"]
    rng = random.Random(5)
    texts += ["".join(rng.choice(["<|endoftext|>", " ", " ", "a", "b.", "\n", "\u3000", "1"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(PATH).encode(texts)]
    assert got == [e.ids for e in want]
    assert got[0] == [64, 220, 50256, 275]
