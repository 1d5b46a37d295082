"""Single-threaded miners in plain Python, written apart from the package, that its results are compared with."""

import math


def drain(lines, threshold=0.3, depth=3):
    """lines: (lid, words) in order -> {lid: cluster}, {cluster: template}."""
    leaves, templates, member = {}, [], {}
    for lid, words in lines:
        tokens = ["**" if w.isascii() and w.isdigit() else w for w in words]
        leaf = leaves.setdefault((len(tokens), tuple([t for t in tokens if t != "**"][: depth - 2])), [])
        scored = [(sum(a == b for a, b in zip(templates[c], tokens)) / len(tokens), -c) for c in leaf]
        good = [s for s in scored if s[0] >= threshold and s[0] > 0]
        if good:
            c = -max(good)[1]
            templates[c] = [a if a == b else "**" for a, b in zip(templates[c], tokens)]
        else:
            c = len(templates)
            templates.append(tokens)
            leaf.append(c)
        member[lid] = c
    return member, templates


def lenma(lines, threshold=0.9, n_same=3):
    first, templates, member = [], [], {}
    for lid, words in lines:
        best = None
        for c, own in enumerate(first):
            if len(own) != len(words) or own[0] != words[0]:
                continue
            same = sum(a == b for a, b in zip(own, words))
            if same + own.count("**") == len(own):
                score = 1.0
            elif same < n_same:
                score = 0.0
            else:
                x, y = [len(w) for w in own], [len(w) for w in words]
                score = sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x)) / math.sqrt(sum(b * b for b in y))
            if score >= threshold and (best is None or score > best[0]):
                best = (score, c)
        if best:
            c = best[1]
            templates[c] = [a if a == b else "**" for a, b in zip(templates[c], words)]
        else:
            c = len(first)
            first.append(words)
            templates.append(words)
        member[lid] = c
    return member, templates


def frequent_tree(lines, max_child=6, cut_depth=3):
    count = {}
    for _, words in lines:
        for w in words:
            count[w] = count.get(w, 0) + 1
    roots, out = {}, {}
    for lid, words in lines:
        node, depth, kept = roots.setdefault(len(words), {"c": {}}), 0, set()
        for w in sorted(words, key=lambda w: (count[w], w), reverse=True):
            if node["c"] is None:
                break
            if w not in node["c"]:
                node["c"][w] = {"c": {}}
                if len(node["c"]) >= max_child and depth >= cut_depth:
                    node["c"] = None
                    break
            kept.add(w)
            node, depth = node["c"][w], depth + 1
        out[lid] = [w if w in kept else "**" for w in words]
    return out


def merged_prefixes(lines):
    """A place is kept if it, or a later one, stands in all messages below an earlier (or this) prefix."""
    primary = {lid: ["**" if w.isascii() and w.isdigit() else w for w in words] for lid, words in lines}
    lits = {lid: [t for t in p if t != "**"] for lid, p in primary.items()}
    below, pairs = {}, {}
    for ls in lits.values():
        for d in range(len(ls)):
            u = tuple(ls[: d + 1])
            below[u] = below.get(u, 0) + 1
            for e in range(d + 1, len(ls)):
                pairs[u, e, ls[e]] = pairs.get((u, e, ls[e]), 0) + 1
    out = {}
    for lid, p in primary.items():
        ls, kept = lits[lid], set()
        for d in range(len(ls)):
            for e in range(d + 1, len(ls)):
                n = pairs[tuple(ls[: d + 1]), e, ls[e]]
                if n > 1 and n == below[tuple(ls[: d + 1])]:
                    kept |= {d, e}
        tpl, i = [], 0
        for t in p:
            if t == "**":
                tpl.append(t)
            else:
                tpl.append(t if i in kept else "**")
                i += 1
        out[lid] = tpl
    return out
