"""The results of the operators, worked out plainly in Python."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def without_passages(rows, window=50):
    """Per row its words and the positions removed."""
    first = {}
    for doc_id, text in rows:
        if doc_id is not None:
            w = words(text)
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, w, gone))
    return out


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(rows, threshold=0.8):
    """Links and class per row; rows without id or words are alone."""
    sets = [shingles(t) if d is not None else set() for d, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for held in holders.values():
        for a in range(len(held)):
            for b in range(a):
                common[held[b], held[a]] += 1
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, links[i], least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def alphanumeric(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(rows, items):
    """Words, hits and items per row."""
    windows = defaultdict(set)
    for item_id, text in items:
        w = alphanumeric(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item_id)
    out = []
    for doc_id, text in rows:
        w, hit, found = alphanumeric(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def tokenizer():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def encoded(rows, encode):
    out = []
    for doc_id, text in rows:
        ids = encode(text or "")
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    return out


def quality(text, limits):
    """The counts of a text and whether it fails at once."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return counts, len(w) < limits.min_words or 100 * len(covered) > limits.repeat_percent * len(w), len(lines)


def exact(rows):
    """Per row the id that stays, rows of its text, and the digest; null ids come last."""
    held = defaultdict(list)
    for doc_id, text in rows:
        held[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in held.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), n == 0, sha(text)) for n, i in enumerate(ids)]
    return out


def _leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def merkle(rows):
    """Per row (doc_id, source, lang, n_chars, text) what the manifest says of it."""
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for held in by.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = {s: _levels([_leaf(r) for r in by[s]]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for j, row in enumerate(by[s]):
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            digest, proof = _leaf((*row[:4], text)), []
            for levels, at in ((trees[s], j), (top, i)):
                for level in levels[:-1]:
                    run = list(level[at // 3 * 3 : at // 3 * 3 + 3])
                    proof += run[: at % 3] + run[at % 3 + 1 :]
                    run[at % 3] = digest
                    digest, at = sha("".join(run)), at // 3
            root = top[-1][0]
            out.append((row[0], _leaf(row), trees[s][-1][0], root, sha("".join(proof)), digest, digest == root))
    return out


def token_tables():
    """Both tokenizers, and the bytes of each of their ids."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable, code, more = {*range(33, 127), *range(161, 173), *range(174, 256)}, {}, 256
    for byte in range(256):
        if byte in printable:
            code[chr(byte)] = byte
        else:
            code[chr(more)] = byte
            more += 1
    bytes_a = {i: bytes(code[c] for c in entry) for entry, i in a.get_vocab(with_added_tokens=False).items()}
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("\u2581", " ").encode() for p in pieces]
    return a, b, bytes_a, bytes_b


def token_alignment(rows):
    a, b, bytes_a, bytes_b = token_tables()
    docs, holders = [], defaultdict(int)
    for doc_id, text in rows:
        sides = ([], [])
        if text:
            sides = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
            if any(b"".join(t[i] for i in ids) != (" " + text).encode() for t, ids in zip((bytes_a, bytes_b), sides)):
                sides = ([], [])
        spans = []
        for table, ids in zip((bytes_a, bytes_b), sides):
            at, held = 0, []
            for i in ids:
                held.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(held)
        links, low = [], 0
        for start, end, i in spans[0]:
            while spans[1][low][1] <= start:
                low += 1
            j = low
            while j < len(spans[1]) and spans[1][j][0] < end:
                links.append((i, spans[1][j][2]))
                j += 1
        groups, at = [], [0, 0]
        for end in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
            parts = []
            for n, side in enumerate(spans):
                first = at[n]
                while at[n] < len(side) and side[at[n]][1] <= end:
                    at[n] += 1
                parts.append(",".join(str(i) for _, _, i in side[first : at[n]]))
            groups.append("|".join(parts))
        for pair in set(links):
            holders[pair] += 1
        docs.append((doc_id, len(sides[0]), len(sides[1]), len(groups), links, sha(";".join(groups)) if groups else ""))
    most = defaultdict(int)
    for (i, _), n in holders.items():
        most[i] = max(most[i], n)
    return [
        (d, na, nb, n, len(ls), sum(holders[p] == most[p[0]] for p in ls), sum(holders[p] for p in ls), h)
        for d, na, nb, n, ls, h in docs
    ]
