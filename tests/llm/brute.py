"""Plain one-machine versions of the text operators, for small inputs."""

import hashlib
import re
import unicodedata
import zlib

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").encode())


def substring(rows, k=20):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, sha)}."""
    first, out = {}, {}
    rows = sorted(rows, key=lambda r: r[0])
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), (i, s))
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] != (i, s):
                gone.update(range(s, s + k))
        out[i] = (len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def shingle_set(text, size=5):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    if not w:
        return set()
    size = min(size, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near(rows, percent=85, size=5):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = {}
    for i, s in sets.items():
        for g in s:
            owners.setdefault(g, []).append(i)
    pairs = {(a, b) for own in owners.values() for n, a in enumerate(own) for b in own[n + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_by_prefixes(rows, percent=85, size=5):
    """({doc_id: component}, links between different sets) by an exact join of all rows: linked sets share one of their rarest shingles."""
    alike, seen = {}, {}
    for i, t in rows:
        s = frozenset(hash(g) for g in shingle_set(t, size))
        alike.setdefault(s, []).append(i)
        for g in s:
            seen[g] = seen.get(g, 0) + 1
    root = {i: min(own) for s, own in alike.items() for i in own} | {i: i for i in alike.get(frozenset(), [])}
    links, holders, own_sets = 0, {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for s in sorted((s for s in alike if s), key=len):
        a, candidates = min(alike[s]), set()
        least = -(-percent * len(s) // 100)
        for g in sorted(s, key=lambda g: (seen[g], g))[: len(s) - least + 1]:
            candidates.update(holders.get(g, ()))
            holders.setdefault(g, []).append(a)
        own_sets[a] = s
        for b in candidates:
            t = own_sets[b]
            if 100 * len(t) >= percent * len(s):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y], links = x, links + 1
    return {i: find(i) for i in root}, links


def lines(rows, run=3, long=50):
    """{doc_id: kept text} of line dedup."""
    first, numbered, out = {}, {}, {}

    def runs(own):
        for s in range(len(own)):
            for n in range(1, min(run, len(own) - s) + 1):
                text = tuple(x for _, x in own[s : s + n])
                if n == run or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in text) >= long:
                    yield s, n, text

    for i, t in sorted(rows):
        if t is None:
            continue
        numbered[i] = [(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\f\v")]
        for s, _, text in runs(numbered[i]):
            first.setdefault(text, (i, s))
    for i, t in rows:
        if t is None:
            out[i] = None
            continue
        gone = {k for s, n, text in runs(numbered[i]) if first[text] != (i, s) for k, _ in numbered[i][s : s + n]}
        out[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


def distance(pattern, text):
    """Least edit distance of pattern to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def crc_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def fold(text):
    return unicodedata.normalize("NFC", text)
