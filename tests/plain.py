"""Plain-Python statements of the scoring contract, used as the brute-force side of tests."""

import math
import re

# Fixed values, stated here once more by hand so that a wrong one in the engine shows.
SOUND_GROUPS = [
    "EI", "AE", "OU", "BP", "DT", "GKC", "FV", "SZC", "MN", "LR", "JY", "XKS",
]
PHONETIC_REWRITES = [
    ("PH", "F"), ("CK", "K"), ("Q", "K"), ("X", "KS"), ("Z", "S"), ("DG", "J"),
    ("GH", "G"), ("KN", "N"), ("WR", "R"), ("EE", "I"), ("EA", "I"), ("IE", "I"),
    ("EY", "I"), ("AY", "I"), ("OO", "U"), ("OU", "U"), ("ISN", "SN"), ("YSN", "SN"),
    ("Y", "I"),
]
SKELETON_REWRITES = [("PH", "F"), ("CK", "K"), ("Q", "K"), ("Z", "S")]


def _squeeze(s):
    return re.sub(r"(.)\1+", r"\1", s)


def phonetic(s, collapse=True):
    s = re.sub("[^A-Z]", "", s.upper())
    for old, new in PHONETIC_REWRITES:
        s = s.replace(old, new)
    s = _squeeze(s) if collapse else s
    return s[:1] + re.sub("[AEIOU]", "", s[1:])


def skeleton(s, collapse=True):
    s = re.sub("[AEIOU]", "", re.sub("[^A-Z]", "", s.upper()))
    for old, new in SKELETON_REWRITES:
        s = s.replace(old, new)
    return _squeeze(s) if collapse else s


def char_sim(a, b):
    if a == b:
        return 1.0
    return 0.6 if any(a in g and b in g for g in SOUND_GROUPS) else 0.0


def similarity(a, b):
    if not a or not b:
        return 0
    longest, shortest = max(len(a), len(b)), min(len(a), len(b))
    total = 0.0
    for x, y in zip(a, b):
        total += char_sim(x, y)
    return math.floor(total / longest * 100 * (1 - (longest - shortest) / longest) + 0.5)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def subsequence(text, pattern):
    it = iter(text)
    return bool(pattern) and all(ch in it for ch in pattern)


def score(text, query):
    t, q = text.upper(), query.upper()
    if not t or not q:
        return 0
    tp, qp, ts, qs = phonetic(t), phonetic(q), skeleton(t), skeleton(q)
    raw = edit(t, q)
    return (
        similarity(t, q) * 3
        + 200 * (tp == qp)
        + 180 * (ts == qs and len(ts) >= 2)
        + 120 * (qp in tp or tp in qp)
        + 80 * (qs in ts or ts in qs)
        + 100 * (t == q)
        + 80 * t.startswith(q)
        + 50 * (q in t)
        + 40 * subsequence(t, q)
        + max(0, 40 - 6 * edit(tp, qp))
        + ([300, 200, 120, 60][raw] if raw <= 3 else 0)
    )


def haversine(lat1, lon1, lat2, lon2):
    rad = math.radians
    a = (
        math.sin(rad(lat2 - lat1) / 2) ** 2
        + math.cos(rad(lat1)) * math.cos(rad(lat2)) * math.sin(rad(lon2 - lon1) / 2) ** 2
    )
    return 3440.065 * 2 * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


def segment_distance(a, b, p):
    d = (b[0] - a[0], b[1] - a[1])
    len2 = d[0] ** 2 + d[1] ** 2
    t = 0.0 if len2 == 0 else max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / len2))
    return haversine(*p, a[0] + t * d[0], a[1] + t * d[1])
