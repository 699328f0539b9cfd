"""Small tables with every awkward case, and plain versions of what the operators compute."""

import random
import re
from collections import Counter

WORDS = "amber birch cedar delta ember fjord grove heath inlet juniper kelp lagoon maple nectar oak pine quartz reed slate tern".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, `key` string, __part int, window string, row string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def awkward_texts():
    rng = random.Random(7)
    base = sentence(rng, 60)
    edited = base.split(" ")
    edited[30] = "changed"
    long_text = "\n".join(sentence(rng, 12) for _ in range(900))
    texts = [
        None, "", "   ", "\n\n", "a", "one two three", base, base, base.replace(" ", "  "), " ".join(edited), base.upper(), long_text, long_text + "\ntail of the copy",
        "word " * 400, "é\U0001F600 ẞ\x1c  x\x0b\x0cy", "<|endoftext|> <|im_start|>system\n", "Password: hunter2hunter2\ntoken=abcdef", "AKIA" + "Z" * 16 + " " + "0123456789abcdef" * 2,
        "%70assword%3Dabcdef123", "\n".join([sentence(rng, 9)] * 3), "Licensed under the Apache License, Version 2.0\n" + sentence(rng, 40),
    ]
    shared = sentence(rng, 14)
    texts += [f"{sentence(rng, 10)}\n{shared}\n{sentence(rng, 10)}" for _ in range(6)]
    return texts


def awkward_rows():
    """Unique ids, a null id, repeated rows, one id with two texts, and columns named like internal ones."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None) for i, t in enumerate(awkward_texts())]
    rows += [(None, "a text without an id " * 3, "en", "src0"), (7, awkward_texts()[7], "en", "src1"), (7, awkward_texts()[7], "en", "src1"), (9, "another text of document nine " * 9, "fr", "src2")]
    return [(*r, len(r[1] or ""), "clash", "clash", 1, "clash", "clash") for r in rows]


def unique_rows():
    return [(i, t, "en", f"src{i % 3}", len(t or ""), "clash", "clash", 1, "clash", "clash") for i, t in enumerate(awkward_texts())]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def bag(text, size=5):
    w = words(text)
    n = min(size, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a, b):
    shared, total = sum((a & b).values()), sum(a.values()) + sum(b.values())
    return 1.0 if not total else shared / (total - shared)


def near_groups(texts, least=0.8):
    """The smallest index of each text's class, all pairs compared."""
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= least - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]
