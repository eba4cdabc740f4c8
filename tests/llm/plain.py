"""Plain versions of whole-corpus steps, for small tables."""

import re
from collections import defaultdict

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_texts(texts: dict[int, str], least: int) -> dict[int, str | None]:
    """Texts without lines that an earlier document holds; None where no line is left."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            first.setdefault(key(line), i)
    out = {}
    for i, text in texts.items():
        kept = [x for x in text.split("\n") if len(key(x)) < least or first[key(x)] == i]
        out[i] = "\n".join(kept) if kept else None
    return out


def components_of(texts: dict[int, str], similarity: int = 85) -> dict[int, int]:
    """Smallest id linked with each id, by all pairs that share a 5-word shingle; ``similarity`` in percent."""
    sets, holders = {}, defaultdict(list)
    for i, text in texts.items():
        words = [w.translate(LOWER) for w in WORDS.findall(text)]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for s in sets[i]:
            holders[s].append(i)
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        if 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in texts}
