"""Plain versions of the operators, for small inputs."""

import re
import zlib

import xxhash

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_dedup(rows, min_docs=5, min_chars=40):
    """rows: (doc_id, text). For each: (n_lines, n_dropped, kept text)."""
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACES).translate(LOWER)
            if doc is not None and len(key) >= min_chars:
                holders.setdefault(key, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            docs = holders.get(line.strip(SPACES).translate(LOWER), set())
            if not (doc is not None and len(docs) >= min_docs and doc != max(docs)):
                kept.append(line)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def simhash(text, width=3):
    ws = words(text)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest node reachable from each."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_copies(rows, distance=3):
    """doc_id -> (fingerprint, component id)."""
    prints = {d: simhash(t) for d, t in rows}
    fps = components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= distance)
    first = {}
    for d, p in prints.items():
        first[fps[p]] = min(first.get(fps[p], d), d)
    return {d: (f"{p:016x}", first[fps[p]]) for d, p in prints.items()}


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text, width=5):
    ws = tokens(text)
    return {" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def contained(docs, items, threshold=0.8):
    """{(doc_id, item_id): containment}."""
    sets = {i: shingles(t) for i, t in items}
    out = {}
    for d, t in docs:
        own = shingles(t)
        for i, s in sets.items():
            if s and len(s & own) >= threshold * len(s):
                out[d, i] = len(s & own) / len(s)
    return out


def pieces(tokenizer, text, size=4096):
    """(piece, start, length, crc32) of each piece."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    out = []
    for n, at in enumerate(range(0, len(ids), size)):
        part = ids[at : at + size]
        out.append((n, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    return out


def best_fit(lengths, capacity):
    """Sequences that best-fit decreasing opens, item by item."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in range(len(room)) if room[r] >= length]
        if fits:
            room[min(fits, key=lambda r: room[r])] -= length
        else:
            room.append(capacity - length)
    return len(room)


def greedy_pieces(word, vocab):
    """Longest match from the left over symbol tuples."""
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if tuple(word[at:e]) in vocab), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def five_word_set(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset([()])


def similar_groups(rows, similarity=0.8):
    """rows: doc_id -> text. The smallest id of each one's group by Jaccard similarity of five-word shingles."""
    sets = {d: five_word_set(t) for d, t in rows.items()}
    group = {d: d for d in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and group[a] != group[b]:
                shared = len(sets[a] & sets[b])
                if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                    low, high = sorted((group[a], group[b]))
                    group = {d: low if g == high else g for d, g in group.items()}
    return group
