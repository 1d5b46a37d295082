"""Slow, plain versions of what the operators compute."""


def greedy_tiles(doc, item, width):
    """Greedy string tiling by its definition: mark the longest common run of unmarked words (first in the document, then in the item),
    again and again, until none of ``width`` words is left."""
    free_doc, free_item, made = [True] * len(doc), [True] * len(item), []
    where = {}
    for j, w in enumerate(item):
        where.setdefault(w, []).append(j)
    pairs = [(i, j) for i, w in enumerate(doc) for j in where.get(w, ())]
    while True:
        best = (0, 0, 0)
        for i, j in pairs:
            n = 0
            while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
        n, i, j = best
        if n < width or not n:
            return sorted(made)
        free_doc[i : i + n], free_item[j : j + n] = [False] * n, [False] * n
        made.append((i, j, n))


def plain_words(text):
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    out, word = [], ""
    for c in (text or "") + " ":
        if c >= "\x80" or c.isalnum():
            word += c.lower() if c < "\x80" else c
        elif word:
            out.append(word)
            word = ""
    return out


def contaminations(docs, items, width=5):
    """(doc, item): (item words, tiles) of every pair that shares a run of ``width`` words (or a whole shorter item)."""
    found = {}
    words = {i: plain_words(t) for i, t in items}
    seeds = {}
    for i, w in words.items():
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if n else ():
            seeds.setdefault(tuple(w[k : k + n]), set()).add(i)
    for d, text in docs:
        own = plain_words(text)
        hit = set()
        for n in {len(s) for s in seeds}:
            for k in range(len(own) - n + 1):
                hit |= seeds.get(tuple(own[k : k + n]), set())
        for i in hit:
            found[d, i] = len(words[i]), greedy_tiles(own, words[i], min(width, len(words[i])))
    return found
