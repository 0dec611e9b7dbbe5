"""Plain versions of the operators, and rows that are hard on them."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, kept boolean, bits long, words string, spans string, line string, lost string"


def words(text):
    return [word for word in SPACE.split(text or "") if word]


def odd_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and
    further columns with names the operators use themselves."""
    prose = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.\nUt labore et dolore magna aliqua today."
    texts = {
        1: prose,
        2: prose,
        3: None,
        4: "",
        5: " \t\n\x0b\r ",
        6: "one two",
        7: "x" * 50_000,
        8: " ".join(f"word{k % 977}" for k in range(40_000)),
        9: "Ünïcödé ßtraße 東京 🎉🎉 é  \x1c| ! don't   stop\n\n\nit's",
        10: prose + "\nAnother closing line with number 17 of them.",
        11: "Entirely different words here\nAnother closing line with number 93 of them.",
    }
    rows = [(key, text, "en" if key % 2 else None, True, 7, "w", "s", "l", "x") for key, text in texts.items()]
    rows.append(rows[0])
    rows.append((None, prose, None, None, None, None, None, None, None))
    rows.append((None, "text of nobody", "de", None, None, None, None, None, None))
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def fingerprint(text):
    found = [re.sub("[A-Z]", lambda x: x.group().lower(), word) for word in words(text)]
    shingles = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(prints, bits=3):
    """Smallest id reachable, from ``id -> fingerprint``."""
    ids = sorted(prints)
    parent = {key: key for key in ids}

    def find(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {key: find(key) for key in ids}


def base_counts(text):
    text = text or ""
    found = words(text)
    windows = Counter(tuple(found[k : k + 3]) for k in range(len(found) - 2))
    covered = {k + j for k in range(len(found) - 2) if windows[tuple(found[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


_PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def good(kind, match):
        digits = [int(x) for x in re.findall("[0-9]", match)]
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        if kind == "card":
            doubled = [sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(digits[::-1])]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(kind, *found.span()) for kind, pattern in _PLAIN.items() for found in pattern.finditer(text or "") if good(kind, found.group())]


def unigram(token, scores, byte):
    """Best division by trying every end of every piece: score, then fewest."""
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        width = len(token[end - 1].encode())
        ways = [(best[-1][0] + width * byte, best[-1][1] - width)]
        ways += [(best[k][0] + scores[token[k:end]], best[k][1] - 1) for k in range(end) if token[k:end] in scores]
        best.append(max(ways))
    return -best[-1][1]


def top_products(vectors, step, k=5):
    """``query -> [(candidate, score), ...]``"""
    codes = [(key, np.floor(256 * np.array(x, float)).astype(int)) for key, x in vectors if key is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    found = {}
    for query, own in codes:
        if query % step == 0:
            scored = sorted((-int(own @ other), key) for key, other in codes if key != query)
            found[query] = [(key, -score) for score, key in scored[:k]]
    return found


def aligned(texts, tokens):
    """``n_a, n_b, groups, links`` of each text, token by token."""
    found = []
    for text in texts:
        a = tokens.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = tokens.b.encode(text or "")
        joined = [b"".join(x[k] for k in ids) for x, ids in ((tokens.bytes_a, a), (tokens.bytes_b, b))]
        if not text or any(x != f" {text}".encode() for x in joined):
            a, b = [], []
        spans = []
        for ids, parts in ((a, tokens.bytes_a), (b, tokens.bytes_b)):
            at, own = 0, []
            for k in ids:
                own.append((at, at + len(parts[k]), k))
                at += len(parts[k])
            spans.append(own)
        borders = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups = []
        for low, high in zip([0, *borders], borders):
            sides = [",".join(str(k) for start, end, k in own if low < end <= high) for own in spans]
            groups.append("|".join(sides))
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        found.append((len(a), len(b), groups, links))
    return found


def rebuilt(rows, every=20, most=4):
    """``conv_id -> turns`` from rows ``conv_id, turn, role, text``."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    turns = {conv: [x[3:] for x in sorted(rows)] for conv, rows in own.items()}
    found = {}
    for conv, given in turns.items():
        taken = zlib.crc32(str(conv).encode()) % most
        found[conv] = turns.get(conv - conv % every, [])[:taken] + given[taken:]
    return found


def prefix_nodes(conversations):
    """Rows as of the operator from ``conv_id -> turns``."""
    members = {}
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv)
    below = {}
    for node in members:
        for depth in range(len(node) + 1):
            below.setdefault(node[:depth], []).append(node)
    children = Counter(node[:-1] for node in members if node)
    found = set()
    for node, own in members.items():
        ends = ",".join(str(conv) for conv in sorted(own) if len(conversations[conv]) == len(node))
        found.add(
            (
                min(own),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(own),
                children[node],
                sum(not children[x] for x in below[node]),
                sum((len(members[x]) - 1) * len(words(x[-1][1])) for x in below[node] if x),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return found
