import random


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["w" + "".join(r2.choice("aeioustrnlm") for _ in range(2 + k % 6)) for k in range(vocabulary) for r2 in [random.Random(k)]]
    out = [r.choice(words) for _ in range(n)]
    for i in range(11, n, 12):
        out[i] += ".\n" if i % 36 == 11 else "."
    return " ".join(out).replace("\n ", "\n")
