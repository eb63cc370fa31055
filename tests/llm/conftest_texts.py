"""Texts for the tests of this folder."""


def sentence(rng, n=12, vocabulary=400):
    return " ".join("w" + format(rng.randrange(vocabulary), "x") + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def body(rng, lines=6):
    return "\n".join(sentence(rng) for _ in range(lines))
