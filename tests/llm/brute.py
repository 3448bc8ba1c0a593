"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Documents with everything that may trouble an operator: nulls in each column, texts without
# words, repeated rows, ties and a very long text.
TROUBLE = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "eins zwei drei vier fünf sechs", "de", "b", 30),
    (None, None, None, None, None),
    (4, "... !!! ???", "en", "b", 11),
    (5, "mot " * 30_000, "fr", "a", 120_000),
    (6, "\n\n\t \n", "en", None, 5),
    (7, "ONE two Three FOUR five six SEVEN", "en", "c", 33),
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - 12) if own else 0):
            windows[tuple(own[k : k + 13])].add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(own) - size + 1):
                window = tuple(own[k : k + size])
                if window in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[window] - {None}
        yield doc, len(own), len(hit), sorted(found)


def grams(text, n=5):
    own = words(text)
    return {tuple(own[k : k + n]) for k in range(max(1, len(own) - n + 1))} if own else set()


def near_duplicates(docs, threshold=0.8):
    """Links and class of each place in the list of (id, text)."""
    sets = [grams(text) for _, text in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = Counter()
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if shared >= threshold * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    return [links[k] for k in range(len(docs))], [root(k) for k in range(len(docs))]


def statistics(text):
    text = text or ""
    own = SPACE.findall(text)
    lines = [line for line in text.split("\n") if SPACE.search(line)]
    triples = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
    counts, covered = Counter(triples), set()
    for k, triple in enumerate(triples):
        if counts[triple] > 1:
            covered |= {k, k + 1, k + 2}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered)


ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def targets(sizes, cycle=(5, 2, 1), cap=3):
    """Token target of each source from {source: size}."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {name: cycle[k % len(cycle)] for k, name in enumerate(names)}
    full: set = set()
    while True:
        free = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        result = {s: cap * sizes[s] if s in full else free * weight[s] / share for s in names}
        above = {s for s in names if s not in full and result[s] > cap * sizes[s]}
        if not above:
            return result
        full |= above
