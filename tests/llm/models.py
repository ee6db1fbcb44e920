"""One-row-at-a-time versions of the corpus operators, for small inputs."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def roots(nodes, links):
    """Smallest node reachable from each node."""
    near = {n: {n} for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            k = todo.pop()
            if k not in out:
                out[k] = n
                todo += near[k]
    return out


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(docs):
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def cut_passages(docs, least=15, window=50):
    """{id: (text, removed words, spans)}: runs of repeated units of ``least`` words or more go, and every
    window of words that an earlier document holds; the earliest stays."""
    docs = sorted(docs, key=lambda d: d[0])
    holder = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            holder.setdefault(tuple(w[k:k + window]), i)
    seen, out = {}, {}
    for i, t in docs:
        spots = [m.span() for m in WORD.finditer(t)]
        groups = []
        for k, (a, b) in enumerate(spots):
            if not k or t[spots[k - 1][1] - 1] in ".!?,;:" or "\n" in t[spots[k - 1][1]:a]:
                groups.append([])
            groups[-1].append(k)
        w, gone = words(t), set()
        marks = []
        for g in groups:
            key = tuple(w[k] for k in g)
            marks.append(key in seen)
            seen.setdefault(key, i)
        for mark, run in itertools.groupby(range(len(groups)), marks.__getitem__):
            run = [k for g in run for k in groups[g]]
            if mark and len(run) >= least:
                gone.update(run)
        for k in range(len(w) - window + 1):
            if holder[tuple(w[k:k + window])] != i:
                gone.update(range(k, k + window))
        spans = []
        for cut, run in itertools.groupby(range(len(w)), gone.__contains__):
            run = list(run)
            if cut:
                behind = run[-1] + 1
                spans.append((spots[run[0]][0], spots[behind][0] if behind < len(w) else len(t)))
        kept = "".join(t[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(t)], strict=True))
        out[i] = (kept, len(gone), spans)
    return out
