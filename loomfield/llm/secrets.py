"""Secret scans: fixed patterns, and automata inferred from labelled credentials.

The base patterns find assignments, access keys and hex strings. Their values
are the labelled credentials: from a bounded sample of each kind, and of other
long tokens as the background, prefix trees over character classes are built and
states whose continuations agree statistically are merged (Hoeffding bound) into
probabilistic automata. Every other long token of every text is then a candidate;
it is added where some credential automaton makes it far likelier, per
character, than the background does.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.tables import bound_batches, materialise, tidy

#: The base patterns, their kinds in order, and the least lengths of what must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, as [0-9a-f]+ would take them
KINDS = ("assign", "access", "hex", "learned")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: Other tokens, or what base spans leave of them, are scored if they have at least so many characters, as the shortest labelled ones have.
TOKEN, CANDIDATE_LEAST = r"[A-Za-z0-9+/_.=-]", ASSIGN_LEAST
#: Tokens whose verdict a worker remembers twice over, and characters of the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 50_000, 24
#: Labelled strings of each kind, and background tokens, that the automata are fitted on at most (smallest hashes of
#: all that have at most so many characters; longer ones are scored, not learned).
SAMPLE, LONGEST_FITTED = 1000, 256
#: Hashes are counted by ranges of so many bits, and then by ranges within the one that holds the last one wanted.
RANGE_BITS = (20, 8, 0)
#: Confidence of the merge test, and bits per character by which a candidate must be likelier than the background.
ALPHA, MARGIN = 0.05, 0.5
#: Probabilities of what an automaton never saw: hardly possible in a format, merely unusual in other tokens.
FORMAT_FLOOR, OTHER_FLOOR = 1e-9, 0.05


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind's place, end, value) of the base patterns; code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


@lru_cache
def _long_tokens(least: int) -> re.Pattern:
    return re.compile(f"{TOKEN}{{{least},}}")


def candidates(text: str, taken: list[tuple[int, int, str, str]], least: int = CANDIDATE_LEAST) -> list[tuple[int, int, str]]:
    """(start, end, token) of tokens, and of what base spans leave of tokens, of at least ``least`` characters."""
    out, n, reach = [], 0, 0
    spans = sorted((s, e) for s, _, e, _ in taken)
    for m in _long_tokens(least).finditer(text):
        while n < len(spans) and spans[n][0] < m.end():
            start = max(m.start(), reach)
            if spans[n][0] - start >= least:
                out.append((start, spans[n][0], text[start : spans[n][0]]))
            reach = max(reach, spans[n][1])
            n += 1
        start = max(m.start(), reach)
        if m.end() - start >= least:
            out.append((start, m.end(), text[start : m.end()]))
    return out


def classes(token: str) -> str:
    """Character classes: digit 0, a-f h, other lower case l, upper case U; other characters themselves."""
    return "".join("0" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "U" if "A" <= c <= "Z" else c for c in token)


class Automaton:
    """A probabilistic automaton: counts of arrivals, ends and moves of each state."""

    def __init__(self, strings: list[str]):
        self.seen, self.ends, self.moves = [0], [0], [defaultdict(int)]
        self.next: list[dict[str, int]] = [{}]
        for s in strings:
            at = 0
            self.seen[0] += 1
            for c in s:
                self.moves[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.moves.append(defaultdict(int))
                    self.next.append({})
                at = self.next[at][c]
                self.seen[at] += 1
            self.ends[at] += 1
        self._merge_all()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two states and all that follows them agree within the bound."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b]):
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                if self._differ(self.moves[a].get(c, 0), self.seen[a], self.moves[b].get(c, 0), self.seen[b]):
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, n in self.moves[b].items():
                self.moves[a][c] += n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        """The most visited state next to a kept one merges into the first kept state that is compatible, else is kept."""
        kept = {0: None}  # in order
        while edge := [(-self.seen[t], k, c) for k in kept for c, t in self.next[k].items() if t not in kept]:
            _, parent, c = min(edge)
            state = self.next[parent][c]
            into = next((k for k in kept if self._compatible(k, state)), None)
            if into is None:
                kept[state] = None
            else:
                self.next[parent][c] = into
                self._fold(into, state)

    def bits(self, token: str, floor: float) -> float:
        """Log2 likelihood of a token's classes, per character; moves that were never seen, and rarer ones, have probability ``floor``."""
        at, total = 0, 0.0
        for c in token:
            if at is not None and c in self.next[at]:
                total += math.log2(max(floor, self.moves[at][c] / self.seen[at]))
                at = self.next[at][c]
            else:
                total, at = total + math.log2(floor), None if at is None else 0
        stop = floor if at is None else max(floor, self.ends[at] / max(1, self.seen[at]))
        return (total + math.log2(stop)) / (len(token) + 1)


def labelled_sample(documents: DataFrame, size: int = SAMPLE, longest: int = LONGEST_FITTED, least: int = CANDIDATE_LEAST) -> DataFrame:
    """kind, value: of each kind's distinct values of at most ``longest`` characters in all texts, those with the ``size`` smallest hashes.

    Equal hashes go by value. Each task keeps its own smallest; then values are
    counted by ranges of hashes, which are refined around the last one wanted, so
    no task gathers a kind and what the driver gets does not grow with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {k: {} for k in KINDS}

        def cut(kind: str) -> None:
            held[kind] = dict(sorted(held[kind].items(), key=lambda x: (x[1], x[0]))[:size])

        for b in batches:
            for text in b.column(0):
                t = text.as_py() or ""
                spans = base_spans(t)
                for kind, value in [(KINDS[k], v) for _, k, _, v in spans] + [(KINDS[3], v) for _, _, v in candidates(t, spans, least)]:
                    if len(value) <= longest and value not in held[kind]:
                        held[kind][value] = zlib.crc32(value.encode())
                        if len(held[kind]) > 4 * size:
                            cut(kind)
        for kind in KINDS:
            cut(kind)
        rows = [(k, v, h) for k, values in held.items() for v, h in values.items()]
        kinds, values, hashes = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(hashes, pa.int64())], ["kind", "value", "h"])

    found = documents.select("text").mapInArrow(tidy(run), "kind string, value string, h long").distinct()
    found = materialise(found, "labelled")
    within = {k: (0, size) for k in KINDS}  # of each kind the range at hand, and how many of it are wanted
    bits_before = 32
    for bits in RANGE_BITS:
        inside = reduce(Column.__or__, [(F.col("kind") == k) & (F.shiftright("h", bits_before) == r) for k, (r, _) in within.items()])
        counts = sorted(map(tuple, found.where(inside).groupBy("kind", F.shiftright("h", bits).alias("range")).count().collect()))
        within = {kind: _range_of_last(list(own), within[kind][1]) for kind, own in groupby(counts, key=lambda c: c[0])}
        bits_before = bits
        if not within:
            return found.select("kind", "value")
    keep = F.lit(False)
    for kind, (h, wanted) in within.items():  # the range is one hash by now
        last = [r["value"] for r in found.where((F.col("kind") == kind) & (F.col("h") == h)).orderBy("value").limit(wanted).collect()]
        keep = keep | (F.col("kind") == kind) & ((F.col("h") < h) | (F.col("h") == h) & (F.col("value") <= last[-1]))
    return found.where(keep).select("kind", "value")


def _range_of_last(counts: list[tuple[str, int, int]], wanted: int) -> tuple[int, int]:
    """The range (of kind, range, count in order) that holds the last one wanted, and how many of it are wanted; the last range if there are fewer."""
    for n, (_, at, count) in enumerate(counts):
        if wanted <= count or n + 1 == len(counts):
            return at, min(wanted, count)
        wanted -= count
    raise ValueError("no counts")


def learn_formats(documents: DataFrame, size: int = SAMPLE, longest: int = LONGEST_FITTED, least: int = CANDIDATE_LEAST) -> dict[str, Automaton]:
    """An automaton for each kind that occurs, and for the background under ``learned``."""
    bound_batches(documents.sparkSession)
    by_kind = defaultdict(list)
    for kind, value in sorted(map(tuple, labelled_sample(documents, size, longest, least).collect())):
        by_kind[kind].append(classes(value))
    return {kind: Automaton(values) for kind, values in by_kind.items()}


class Scorer:
    """Whether some format explains a token better than the background; verdicts of short tokens are remembered."""

    def __init__(self, formats: dict[str, Automaton]):
        self.models, self.rest = [m for k, m in formats.items() if k != KINDS[3]], formats.get(KINDS[3])
        # two generations: when the newer one is full it becomes the older one, and tokens met again come back from there
        self.newer: dict[str, bool] = {}
        self.older: dict[str, bool] = {}

    def __call__(self, token: str) -> bool:
        known = self.newer.get(token)
        if known is None:
            known = self.older.get(token)
            if known is None:
                c = classes(token)
                known = max(m.bits(c, FORMAT_FLOOR) for m in self.models) > self.rest.bits(c, OTHER_FLOOR) + MARGIN
            if len(token) <= LONGEST_REMEMBERED:
                if len(self.newer) >= REMEMBERED:
                    self.older, self.newer = self.newer, {}
                self.newer[token] = known
        return known


def all_spans(text: str, scorer: Scorer, least: int = CANDIDATE_LEAST) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of base spans and of candidates that a format explains better than the background."""
    base = base_spans(text)
    out = [(s, k, e) for s, k, e, _ in base]
    if scorer.models and scorer.rest:
        out += [(start, 3, end) for start, end, token in candidates(text, base, least) if scorer(token)]
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def scan_secrets(documents: DataFrame, size: int = SAMPLE, longest: int = LONGEST_FITTED, least: int = CANDIDATE_LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document.

    Spans read kind:start:end in code points, in order of start and kind
    (assign, access, hex, learned). Formats are learned from at most ``size`` strings
    of each kind, of at most ``longest`` characters; tokens of at least ``least``
    characters are scored. Defined cases: a null text is empty and has no
    spans; repeated rows are scanned each; texts and tokens of any length are
    scanned whole; without labelled credentials only the base patterns apply; an
    empty table gives no rows; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learn_formats(documents, size, longest, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            rows = []
            for text in b.column(1):
                spans = all_spans(text.as_py() or "", scorer, least)
                base = [s for s in spans if s[1] < 3]
                rows.append((*[sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(documents: DataFrame, mask: str = "[SECRET]", size: int = SAMPLE, longest: int = LONGEST_FITTED, least: int = CANDIDATE_LEAST) -> DataFrame:
    """Documents with every span replaced by ``mask`` (overlapping spans by one) and n_chars, if there, set anew.

    Other parameters are those of ``scan_secrets``. Defined cases: a null text stays null, an empty one empty; repeated rows are
    masked each; a very long text is masked whole; without labelled credentials
    only base spans are masked; an empty table gives no rows; all columns stay.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learn_formats(documents, size, longest, least))

    def redact(text: str | None, scorer: Scorer) -> str | None:
        spans = all_spans(text, scorer, least) if text else []
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array([redact(t.as_py(), scorer) for t in b.column(at)], b.schema.field(at).type))

    done = documents.mapInArrow(tidy(run), documents.schema)
    return done.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else done
