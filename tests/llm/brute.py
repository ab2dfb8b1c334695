"""Plain single-process versions of the queries' contracts, over pandas tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def decontamination(docs, items, n=10):
    """``docs``: (doc_id, text); ``items``: (item_id, text)."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UPPER))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[i : i + m])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (at := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[at]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def edits(docs):
    """(doc_id, n_chars, edited_sha256) by descending id."""
    rows = sorted(((d, t or "") for d, t in docs), reverse=True)
    out = []
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        out.append((doc, len(text), sha(text[: len(text) - third] + following[:third])))
    return out


def conversations(rows):
    """``rows``: (conv_id, turn, role, text) → turns and learned text."""
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: r[:2]):
        turns, learned, n = out.get(conv, ("", "", 0))
        out[conv] = (f"{turns}{role}\n{text or ''}\n", learned + (text or "") * (role == "assistant"), n + 1)
    return {conv: (n, sha(turns), len(learned), sha(learned)) for conv, (turns, learned, n) in out.items()}


def simhash(text):
    from xxhash import xxh64_intdigest

    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest node reachable, by flooding."""
    root = {}
    for start in sorted(nodes):
        if start not in root:
            todo = [start]
            while todo:
                node = todo.pop()
                if node not in root:
                    root[node] = start
                    todo += linked(node)
    return root


def simhash_components(docs, radius=3):
    prints = {doc: simhash(text) for doc, text in docs}
    near = lambda a: [b for b in prints if (prints[a] ^ prints[b]).bit_count() <= radius]
    roots = components(prints, near)
    return {doc: (f"{prints[doc]:016x}", roots[doc]) for doc in prints}


def warc(pages):
    first = {}
    for page, html in sorted(pages):
        first.setdefault((html or "").encode(), page)
    out = []
    for page, html in pages:
        payload = (html or "").encode()
        to = first[payload] if len(payload) >= 100 and first[payload] != page else None
        out.append((page, len(payload), sha(payload), "response" if to is None else "revisit", to))
    return out


def token_pieces(docs, path, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = {}
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[doc, piece] = (at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    return out


def repeats(docs, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    texts = [(doc, (text or "").encode()) for doc, text in docs]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near_lines(lines, edits=2):
    """For each different line, the others within so many edits."""
    import numpy as np

    lines = sorted(set(lines), key=len)
    near = {line: [] for line in lines}
    signs = np.zeros((len(lines), 256), dtype=np.int16)
    for i, line in enumerate(lines):
        for c in line:
            signs[i, ord(c) % 256] += 1
    sizes = np.array([len(line) for line in lines])
    for i, a in enumerate(lines):
        after = i + 1 + np.flatnonzero(sizes[i + 1 :] - sizes[i] <= edits)
        after = after[np.abs(signs[after] - signs[i]).sum(axis=1) <= 2 * edits]  # each edit changes two counts
        for j in after.tolist():
            if edit_distance(a, lines[j]) <= edits:
                near[a].append(lines[j])
                near[lines[j]].append(a)
    return near


def line_dedup(docs, edits=2, least=24):
    """doc_id → (lines, removed, sources, links); ``docs`` have different ids."""
    held = {doc: [(at, line) for at, line in enumerate((text or "").split("\n")) if line.strip()] for doc, text in docs}
    first = {}
    for doc in sorted(held, key=lambda d: (d is None, d or 0)):
        for _, line in held[doc]:
            first.setdefault(line, doc)
    near = {line: [] for line in first} | near_lines([line for line in first if len(line) >= least], edits)
    root = components(near, near.get)
    order = lambda line: (-len(near[line]), first[line] is None, first[line] or 0, hashlib.md5(line.encode()).digest())
    stay, classes = {}, defaultdict(list)
    for line in near:
        classes[root[line]].append(line)
    for lines in classes.values():
        keep = []
        for line in sorted(lines, key=order):
            stay[line] = next((k for k in keep if edit_distance(k, line) <= edits), line)
            keep += [line] * (stay[line] == line)
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        removed, sources = [], []
        for at, line in held[doc]:
            if stay[line] == line and first[line] == doc and line not in seen:
                seen.add(line)
            else:
                removed.append(at)
                sources.append(first[stay[line]])
        out[doc] = (len((text or "").split("\n")), removed, sources, sum(len(near[line]) for line in {line for _, line in held[doc]}))
    return out


def alignments(docs, path_a, path_b):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256); every row is a document."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    first, second = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    first.encode_special_tokens = True
    shown = ByteLevel.__name__ and {chr(c): b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)])}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown.values()))}
    held = []
    for doc, text in docs:
        want = f" {text or ''}".encode()
        a = [(i, bytes(shown[c] for c in first.id_to_token(i))) for i in first.encode(f" {text or ''}", add_special_tokens=False).ids]
        b = [(i, second.id_to_piece(i)) for i in second.encode(text or "")]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            held.append((doc, [], [], [], []))
            continue
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, data in tokens:
                out.append((i, at, at + len(data)))
                at += len(data)
            spans.append(out)
        links, k = [], 0
        for i, low, high in spans[0]:
            while spans[1][k][2] <= low:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][1] < high:
                links.append((i, spans[1][j][0]))
                j += 1
        cuts = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in spans) if len(cuts) < 400 else None)
            low = high
        if len(cuts) >= 400:
            where = {c: g for g, c in enumerate(cuts)}
            parts, at = [[], []], 0
            groups = [[[], []] for _ in cuts]
            for side, tokens in enumerate(spans):
                g = 0
                for i, _, e in tokens:
                    groups[g][side].append(str(i))
                    g = where.get(e, g - 1) + 1 if e in where else g
            groups = ["|".join(",".join(side) for side in group) for group in groups]
        held.append((doc, a, b, groups, links))
    count = Counter(pair for *_, links in held for pair in set(links))
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    return [
        (doc, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha(";".join(groups)) if a else "")
        for doc, a, b, groups, links in held
    ]
