"""A toy embedding model: shares of letters."""


def load():
    return lambda texts: [[t.count(c) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
