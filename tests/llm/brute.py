"""Plain versions of the operators' contracts, over rows in memory: slow, short, and without a line of the operators' own."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
INDEX = lambda d: (d is not None, d or 0)  # noqa: E731 - null ids come first


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(windows)
    covered = {k + i for k, x in enumerate(windows) if n[x] > 1 for i in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


#: Of each measure: reach, least ratio of the quartiles, and whether it has a lower fence.
RULES = {"symbols": (1.5, 3.0, False), "dup_lines": (1.5, 3.0, False), "repeats": (2.0, 6.0, False), "word_length": (4.0, 1.035, True)}


def quality_kept(rows: list[tuple], prior: float = 25.0) -> dict[int, tuple[bool, bool]]:
    """doc_id -> (kept, near a fence) of rows (doc_id, text, lang, source), with quartiles of sorted values."""
    value, past = {}, []
    for d, text, lang, source in rows:
        n, chars, signs, dup, rep = measures(text)
        if n >= 50 and 100 * rep <= 50 * n:
            value[d] = {"symbols": (signs + 1) / (n + 1), "dup_lines": (dup + 1) / (n + 1), "repeats": (rep + 1) / (n + 1), "word_length": chars / n}
            past.append((d, lang, source))

    def quartiles(name: str, fits) -> tuple[int, list[float]]:
        v = sorted(value[d][name] for d, lang, source in past if fits(lang, source))
        return len(v), [math.log(v[math.ceil(len(v) * q) - 1]) for q in (0.25, 0.75)]

    out = {d: (False, False) for d, *_ in rows}
    for lang, source in {(x, y) for _, x, y in past}:
        of = [d for d, x, y in past if (x, y) == (lang, source)]
        bad, near = set(), set()
        for name, (reach, least, lower) in RULES.items():
            (n, own), (m, wider), (_, every) = quartiles(name, lambda x, y: (x, y) == (lang, source)), quartiles(name, lambda x, y: x == lang), quartiles(name, lambda x, y: True)
            w, u = n / (n + prior), m / (m + prior)
            a, b = (math.exp(w * o + (1 - w) * (u * x + (1 - u) * e)) for o, x, e in zip(own, wider, every, strict=True))
            beyond = max(b / a, least) ** reach
            limits = [(b * beyond, 1), *[(a / beyond, -1)] * lower]
            for d in of:
                bad |= {d for at, way in limits if way * (value[d][name] - at) > 0}
                near |= {d for at, _ in limits if abs(math.log(value[d][name] / at)) < 0.02 * (1 + 2 * reach)}
        out |= {d: (d not in bad, d in near) for d in of}
    return out


def fingerprint(text: str | None, size: int = 3) -> int:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows: list[tuple[int | None, str | None]], roots: bool = False) -> list[tuple]:
    """(doc_id, fingerprint, component id) of each row, by comparing all fingerprints; with `roots` the component's least fingerprint too."""
    fps = [fingerprint(t) for _, t in rows]
    each = sorted(set(fps))
    root = {f: f for f in each}

    def find(f: int) -> int:
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(each):
        for b in each[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least: dict[int, int | None] = {}
    for (d, _), f in zip(rows, fps, strict=True):
        r = find(f)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, f"{f:016x}", least[find(f)], *[find(f)] * roots) for (d, _), f in zip(rows, fps, strict=True)]


def substring_kept(rows: list[tuple[int | None, str | None]], window: int = 20) -> list[tuple[int | None, int, int, str]]:
    """(doc_id, words, words that go, kept words joined); rows of equal id and text are one document."""
    docs = [(d, t, words(t)) for d, t in sorted(set(rows), key=lambda r: (INDEX(r[0]), r[1] or ""))]
    first: dict[tuple, tuple] = {}
    for d, _, w in docs:
        for k in range(len(w) - window + 1):
            place = (INDEX(d), k)
            first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), place), place)
    out = {}
    for d, t, w in docs:
        gone = {k + i for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (INDEX(d), k) for i in range(window)}
        out[d, t] = (d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return [out[r] for r in rows]


def media(text: str | None) -> tuple[int, int, str, int]:
    raw = (text or "").encode()
    payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
    return len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:])


def chats(rows: list[tuple]) -> dict[int | None, tuple]:
    """conv_id -> (turns, hash of turns, learned characters, their hash) of rows (conv_id, turn, role, text)."""
    out: dict[int | None, list] = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (INDEX(r[0]), INDEX(r[1]), r[2] or "", r[3] or "")):
        x = out.setdefault(conv, [0, "", ""])
        x[0] += 1
        x[1] += f"{role or ''}\n{text or ''}\n"
        x[2] += (text or "") if role == "assistant" else ""
    return {k: (n, sha(a.encode()), len(b), sha(b.encode())) for k, (n, a, b) in out.items()}


def written_chats(rows: list[tuple]) -> dict[int | None, str]:
    """Conversations as written: markers around texts in which every control string is an escape sign, its number, and ";"."""
    around = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>\n")}
    controls = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>"]
    part = re.compile("|".join(re.escape(c) for c in ["\\", *controls]))
    hidden = lambda x: part.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\{controls.index(m[0])};", x)
    out: dict[int | None, str] = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (INDEX(r[0]), INDEX(r[1]), r[2] or "", r[3] or "")):
        before, after = around.get(role or "", (f"<<ROLE>>{hidden(role or '')}<</ROLE>>", "<</TURN>>"))
        out[conv] = out.get(conv, "") + before + hidden(text or "") + after
    return out
