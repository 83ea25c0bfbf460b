"""Brute-force versions that several tests of this folder use."""

import re

import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_fingerprint(text, words=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def near(fps, k):
    fps = sorted(set(fps))
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= k]
