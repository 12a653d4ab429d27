"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return host.translate(UPPER), path


def url_rule(host, path):
    rules = {
        "org/": "allow",
        "example.org/es/": "block",
        "example.org/en/1": "block",
        "com/fr/": "allow",
        "com/de/": "block",
    }
    fits = []
    for rule in rules:
        site, _, start = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start):
            fits.append(rule)
    best = max(fits, key=len, default=None)
    return best, rules.get(best)


def fingerprint(text):
    low = (text or "").translate(UPPER)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows):
    """(doc_id, text) rows to {doc_id: (fingerprint, component)}."""
    prints = {d: fingerprint(t) for d, t in rows}
    ids = sorted(prints)
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (f"{prints[d]:016x}", root(d)) for d in ids}


def base_secrets(text):
    text = text or ""
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A,
    )
    found = [("assign", m.span()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    n = len(found)
    access = [("access", m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    hexes = [("hex", m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    spans = sorted(found + access + hexes, key=lambda s: (s[1][0], order[s[0]]))
    written = ",".join(f"{k}:{a}:{b}" for k, (a, b) in spans)
    return n, len(access), len(hexes), sha(written), written


def repeats(rows, width=50):
    """(doc_id, text) rows, unique ids, to {doc_id: (bytes, removed, spans, sha of the rest)}."""
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            part = data[i : i + width]
            least[part] = min(least.get(part, doc), doc)
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if least[data[i : i + width]] < doc:
                gone[i : i + width] = b"\x01" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), spans, sha(kept))
    return out


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(rows, items, size=10):
    windows = {}
    for item, text in items:
        words = item_words(text)
        if words and item is not None:
            n = min(size, len(words))
            for i in range(len(words) - n + 1):
                windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words, hit, found = item_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                ids = windows.get(tuple(words[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        names = ",".join(sorted(str(i) for i in found))
        out.append((doc, len(words), len(hit), len(found), sha(names), bool(hit)))
    return out


def neighbours(vectors, every, k=5):
    """{vec_id: vector} to {(query, rank): (vec_id, score)}."""
    fine = {
        i: v
        for i, v in vectors.items()
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    norm = {i: math.sqrt(math.fsum(x * x for x in v)) for i, v in fine.items()}
    out = {}
    for q in fine:
        if q % every:
            continue
        scored = [
            (-math.fsum(a * b for a, b in zip(fine[q], v)) / norm[q] / norm[i], i)
            for i, v in fine.items()
            if i != q
        ]
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out[q, rank] = (i, -s)
    return out


def pieces(rows, tokenizer, capacity=4096):
    out = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            data = b"".join(i.to_bytes(4, "little") for i in part)
            out.append((doc, n, start, len(part), zlib.crc32(data)))
    return out
