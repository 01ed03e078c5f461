"""Tables with every awkward row, and plain re-statements of the contracts."""

from __future__ import annotations

import hashlib
import random
import re
import string

ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folded(text):
    return FOLDED.findall((text or "").translate(ASCII_LOWER))


def spaced(text):
    return SPACED.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.choice('abc')}" for _ in range(n))


def awkward_documents(seed=5):
    """NULLs, blanks, odd white space, one very long text, exact and near copies, shared passages, repeated ids and rows."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \n\t\x0b\x0c\r ", "one", "a b c", "   ÉTÉ été\u0085x\x1cy", base, base, " ".join(near), base.upper(),
        f"{prose(rng, 40)} {passage} {prose(rng, 30)}", f"{prose(rng, 25)}\n{passage}", passage, passage + " tail", prose(rng, 30_000, 50_000),
        "same line here\nsame line here\n\nother\nsame line here", "x " * 200, prose(rng, 19), " ".join(["tick tock"] * 40), "!!! ### | | |",
        "Released under the MIT License. " + prose(rng, 80), "mit license apache license general public license mit license",
        "👩‍👩‍👧 emoji 😀 " + prose(rng, 60), passage[: len(passage) // 2] + "\n" + passage,
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (None, base, "en", "src0", 1), (3, "another text under id three " + passage, "en", "src0", 2)]
    rows += [rows[6], rows[6], rows[12]]
    rng.shuffle(rows)
    return rows


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: [(x is not None, str(type(x)), x) for x in t])


def ordered(rows):
    return sorted(rows, key=lambda t: [(x is not None, str(type(x)), x) for x in t])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut_repeats(rows, window=20):
    """Per row (in order): n_words, n_removed, and the hash of what is left."""
    last = 1 << 63
    words = [spaced(t) for _, t in rows]
    places = [last if i is None else i for i, _ in rows]
    first = {}
    for place, ws in zip(places, words, strict=True):
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s : s + window])
            first[key] = min(first.get(key, (last + 1, 0)), (place, s))
    out = []
    for place, ws in zip(places, words, strict=True):
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] != (place, s):
                gone.update(range(s, s + window))
        out.append((len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def shingle_set(text, size=5):
    ws = spaced(text)
    return frozenset(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))) if ws else frozenset()


def near_classes(rows, threshold=0.8):
    """Per row: the indices of its class, and its number of links; every pair is compared."""
    sets = [shingle_set(t) for _, t in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[i].add(j)
                links[j].add(i)
    classes = [None] * len(rows)
    for i in range(len(rows)):
        if classes[i] is None:
            todo, found = [i], {i}
            while todo:
                for j in links[todo.pop()] - found:
                    found.add(j)
                    todo.append(j)
            for j in found:
                classes[j] = found
    return classes, [len(x) for x in links]
