"""Inferred formats, scores and spans equal a plain version that shares no code with them."""

import hashlib
import math
import random
import re
import zlib

import pytest

from loomfield.llm import secrets

UPPER, DIGITS, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "abcdefghijklmnopqrstuvwxyz"


class Node:
    """A state: how many strings came by and ended, and where each character leads with what count."""

    def __init__(self, number):
        self.number, self.came, self.ended, self.ways = number, 0, 0, {}


def plain_format(strings):
    nodes = [Node(0)]
    for s in strings:
        at = nodes[0]
        at.came += 1
        for c in s:
            if c not in at.ways:
                nodes.append(Node(len(nodes)))
                at.ways[c] = [0, nodes[-1]]
            at.ways[c][0] += 1
            at = at.ways[c][1]
            at.came += 1
        at.ended += 1

    def far(x, m, y, n):
        return abs(x / m - y / n) > math.sqrt(math.log(2 / 0.05) / 2) * (m**-0.5 + n**-0.5)

    def alike(a, b):
        if far(a.ended, a.came, b.ended, b.came) or any(far(a.ways.get(c, [0])[0], a.came, b.ways.get(c, [0])[0], b.came) for c in {*a.ways, *b.ways}):
            return False
        return all(alike(a.ways[c][1], b.ways[c][1]) for c in a.ways if c in b.ways)

    def join(a, b):
        a.came, a.ended = a.came + b.came, a.ended + b.ended
        for c, (n, target) in b.ways.items():
            if c in a.ways:
                a.ways[c][0] += n
                join(a.ways[c][1], target)
            else:
                a.ways[c] = [n, target]

    sure = [nodes[0]]
    while True:
        open_ = [(-t.came, k.number, c, k, t) for k in sure for c, (_, t) in k.ways.items() if t not in sure]
        if not open_:
            return nodes[0]
        *_, c, parent, state = min(open_, key=lambda x: x[:3])
        like = [k for k in sure if alike(k, state)]
        if like:
            parent.ways[c][1] = like[0]
            join(like[0], state)
        else:
            sure.append(state)


def plain_bits(root, token, floor):
    at, total = root, 0.0
    for c in token:
        p, to = (at.ways[c][0] / at.came, at.ways[c][1]) if at and c in at.ways else (0.0, root if at else None)
        total, at = total + math.log2(max(floor, p)), to
    return (total + math.log2(max(floor, at.ended / at.came if at else 0.0))) / (len(token) + 1)


def plain_classes(token):
    return re.sub("[0-9]", "0", re.sub("[A-Z]", "U", "".join("h" if c in "abcdef" else "l" if c in "ghijklmnopqrstuvwxyz" else c for c in token)))


def plain_base(text):
    found = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) > 7]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) > 15]
    return sorted(found + [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 31])


def plain_rest(text, base):
    """Runs of 8 and more token characters with none of a base span."""
    free = list(text)
    for s, _, e, _ in base:
        free[s:e] = " " * (e - s)
    return [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_.=-]{8,}", "".join(free))]


def plain_scan(texts, size=1000):
    kinds, held = ["assign", "access", "hex", "learned"], [set() for _ in range(4)]
    for t in texts:
        base = plain_base(t or "")
        for _, k, _, v in base:
            held[k].add(v)
        held[3] |= {v for *_, v in plain_rest(t or "", base)}
    formats = [plain_format([plain_classes(v) for v in sorted(sorted((v for v in own if len(v) <= 256), key=lambda v: (zlib.crc32(v.encode()), v))[:size])]) if own else None for own in held]
    out = []
    for t in texts:
        base = plain_base(t or "")
        spans = [(s, k, e) for s, k, e, _ in base]
        for s, e, v in plain_rest(t or "", base) if formats[3] and any(formats[:3]) else ():
            c = plain_classes(v)
            if max(plain_bits(f, c, 1e-9) for f in formats[:3] if f) > plain_bits(formats[3], c, 0.05) + 0.5:
                spans.append((s, 3, e))
        said = lambda own: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(own))
        out.append((*[sum(b[1] == k for b in base) for k in range(3)], hashlib.sha256(said(x for x in spans if x[1] < 3).encode()).hexdigest(), said(spans)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    take = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    word = lambda: take("etaoinsrhl", rng.randint(3, 14))
    made = []
    for n in range(260):
        words = [word() for _ in range(rng.randint(5, 40))]
        words += {0: ["AKIA" + take(UPPER + DIGITS, 16)], 1: [take(DIGITS + "abcdef", rng.choice([32, 40]))], 2: ["password=" + take(LOWER + UPPER + DIGITS, rng.randint(8, 24))], 3: [take(LOWER + UPPER + DIGITS, 11)]}.get(n % 8, [])
        words += [f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}"] * (n % 5 == 4)
        rng.shuffle(words)
        made.append(" ".join(words))
    return [*made, None, "", "é ", "x" * 400, "AKIA" + "B" * 20 + "ghijklmnop", "token:" + "z" * 300]


def test_formats_and_scores_equal_the_plain_version(texts):
    values = [v for t in texts for *_, v in plain_base(t or "")]
    for own in ([v for v in values if v.startswith("AKIA")], [v for v in values if len(v) in (32, 40)], [v for v in values if len(v) < 25]):
        mine, plain = secrets.Automaton([secrets.classes(v) for v in sorted(own)]), plain_format([plain_classes(v) for v in sorted(own)])
        for token in [*values[:80], "abcdefgh", "12.34.56.78", "UUUUUUUUUU", ""]:
            assert secrets.classes(token) == plain_classes(token)
            for floor in (1e-9, 0.05):
                assert math.isclose(mine.bits(plain_classes(token), floor), plain_bits(plain, plain_classes(token), floor), rel_tol=1e-12)


def test_scans_equal_the_plain_version(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, secrets.scan_secrets(df).collect()))
    want = [(n, *row) for n, row in enumerate(plain_scan(texts))]
    assert got == want
    planted = [n for n in range(260) if n % 8 == 3]
    found = sum("learned" in got[n][5] for n in planted)
    assert found > 0.6 * len(planted) and not any("learned" in got[n][5] for n in range(260) if n not in planted)


def test_a_sample_that_is_cut_equals_the_plain_version(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, secrets.scan_secrets(df, size=25).collect())) == [(n, *row) for n, row in enumerate(plain_scan(texts, 25))]
