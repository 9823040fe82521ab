"""Plain restatements of the contracts, one text or one small table at a time."""

import re
from collections import Counter

import xxhash

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    text = text or ""
    ws = words(text)
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = Counter(wins)
    hit = {i + k for i, w in enumerate(wins) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    n, chars, dup = len(ws), sum(map(len, ws)), len(lines) - len(set(lines))
    bits = (
        (n < 50)
        | (100 * len(hit) > 50 * n) << 1
        | (100 * symbols > 20 * n) << 2
        | (n > 0 and not 1.5 <= chars / n <= 20) << 3
        | (100 * dup > 50 * len(lines)) << 4
    )
    return n, chars, symbols, dup, len(hit), int(bits)


def fingerprint(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = words(lowered)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + shingle]) for i in range(len(ws) - shingle + 1)] or [" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest member of each node's component."""
    label = {}
    for n in sorted(nodes):
        if n in label:
            continue
        todo = [n]
        label[n] = n
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in label and linked(x, y):
                    label[y] = n
                    todo.append(y)
    return label


def contamination_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contamination(text, items, window=10):
    """Words of the text, words hit, ids of items that occur."""
    ws = contamination_words(text)
    hit, ids = set(), set()
    for item_id, item in items:
        iw = contamination_words(item)
        size = min(window, len(iw))
        wins = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1):
            if tuple(ws[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                ids.add(item_id)
    return len(ws), len(hit), sorted(str(x) for x in ids if x is not None)


def luhn(digits):
    total = 0
    for k, d in enumerate(int(c) for c in digits[::-1]):
        if k % 2:
            d = 2 * d
            d = d - 9 if d > 9 else d
        total += d
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m)]


def byte_pairs(piece, ranks):
    """Ids of one word: lowest rank first, leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def chats(rows):
    """(conv, turns, copies, rendered) of maximal conversations from (conv, turn, role, text)."""
    convs = {}
    none_first = lambda x: (x is not None, x if x is not None else 0)
    text_first = lambda x: (x is not None, x or "")
    for c, t, r, x in sorted(set(rows), key=lambda q: (none_first(q[0]), none_first(q[1]), text_first(q[2]), text_first(q[3]))):
        convs.setdefault(c, []).append((r, x))
    out = []
    for c, turns in convs.items():
        others = [(d, u) for d, u in convs.items() if d != c]
        if any(len(u) > len(turns) and u[: len(turns)] == turns for _, u in others):
            continue
        same = [d for d, u in convs.items() if u == turns]
        first = min((d for d in same if d is not None), default=None)
        if c == first:
            body = "".join(f"<|{'unknown' if r is None else r}|>\n{x or ''}\n<|end|>\n" for r, x in turns)
            out.append((c, len(turns), len(same), body))
    return out
