"""Plain versions that the operators are held against."""

import re
from collections import Counter, defaultdict

WORD = re.compile("[^ \t-\r]+").findall
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union(nodes, edges):
    """{node: smallest node of its component}."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n):
    words = WORD((text or "").translate(ASCII_LOWER))
    return frozenset([tuple(words)] if 0 < len(words) < n else [tuple(words[k:k + n]) for k in range(len(words) - n + 1)])


def similar(rows, n, percent):
    """{doc_id: (set size, component)} by counting shared shingles pair by pair."""
    sets, having, edges = {i: shingles(t, n) for i, t in rows}, defaultdict(list), []
    for i in sorted(sets):
        for j, both in Counter(j for g in sets[i] for j in having[g]).items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                edges.append((i, j))
        for g in sets[i]:
            having[g].append(i)
    at = union(sets, edges)
    return {i: (len(sets[i]), at[i]) for i in sets}


def base_rule(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed."""
    text = text or ""
    words = WORD(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {k + d for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words))
