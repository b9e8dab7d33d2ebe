"""What is learnt covers the training texts whole."""

import numpy as np

from evidentia.llm import attention_lm
from evidentia.llm.queries import tokenizer_path


def test_every_word_of_a_text_is_learnt():
    """one in six windows of a text was learnt."""
    path = tokenizer_path()
    texts = [b" ".join(b"w%d" % k for k in range(1000)), b"one two", b""]
    symbols, sizes = attention_lm.learnt_windows(texts, path)
    whole, _, _ = attention_lm.symbols_of(texts, path)
    assert len(sizes) == -(-1000 // attention_lm.SPAN) + 2 and sizes.sum() == len(symbols)
    assert np.array_equal(symbols[symbols != attention_lm.END], whole[whole != attention_lm.END])
    assert (symbols == attention_lm.END).sum() == 3
