"""Brute-force forms shared by the tests of this folder."""

import re

import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        n = min(len(words), width)
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in names}


def check_packed(rows, docs, capacity, per_source):
    """Every word is in one place, no bin is too full, and no conflict is broken."""
    want = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    text = {r["doc_id"]: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs}
    seen, bins = {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append((r["start"], r["size"]))
        if r["size"]:
            bins.setdefault(r["bin_id"], []).append(r)
        else:
            assert r["bin_id"] is None
    times = {i: sum(a == 0 for a, _ in v) for i, v in seen.items()}
    for i, parts in seen.items():
        assert sum(n for _, n in parts) == want[i] * times[i]
    for held in bins.values():
        assert sum(r["size"] for r in held) <= capacity
        assert len({text[r["doc_id"]] for r in held}) == len(held)
        counts = pd.Series([str(source[r["doc_id"]]) for r in held]).value_counts()
        assert counts.max() <= per_source
