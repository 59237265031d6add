import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def vocabulary():
    from wickerframe.llm.queries import tokenizer_file

    return tokenizer_file()


@pytest.fixture(scope="session")
def prose():
    """Documents (id, text): copies, near copies, a chain, shared passages, short, empty and null texts, junk."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = line(60)
    texts = [line(rng.randint(1, 120)) for _ in range(60)]
    base = line(100).split()
    texts += [" ".join(base)] * 5 + ["  ".join(base).upper(), "\n".join(base)]
    for _ in range(25):
        near = base.copy()
        for _ in range(rng.randint(1, 3)):
            near[rng.randrange(100)] = rng.choice(vocab)
        texts.append(" ".join(near))
    chain = line(80).split()
    for _ in range(8):
        chain = chain[4:] + line(4).split()
        texts.append(" ".join(chain))
    texts += [passage + " " + line(25) for _ in range(15)]
    texts += ["", None, " \n\t", "one", "one", "One two", "one two three four", "x" * 5000, "é ü 汉字 \u00a0 nbsp", None, "a b c d e", "A b c d e"]
    texts.append(" ".join(line(50) for _ in range(200)))
    return [(3 * i + 1, t) for i, t in enumerate(texts)]
