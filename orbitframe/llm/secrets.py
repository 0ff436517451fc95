"""Secret scans: base patterns and probabilistic automata inferred from found credentials (operator 9)."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, sampled, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
HINTS = ("password", "passwd", "secret", "token", "api")
#: Greedy runs of at least the length equal the runs that stay after shorter ones are dropped.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: The runs that the automata score: no shorter than the shortest value of a base pattern.
SHORTEST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: Bits a character of a run that ordinary ones are quite unlike: below characters drawn evenly (-6).
FOREIGN = -8.0
#: Judged runs that a task remembers.
REMEMBERED = 200_000
KINDS = ("assign", "access", "hex", "grammar")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order; kind is an index of KINDS."""
    out = []
    low = text.lower() if text.isascii() else text.translate(_LOW)
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_LOW = {i: i + 32 for i in range(65, 91)}


#: The characters of values, their classes (a-f apart, as in hexadecimal numbers), and the sign for a value's end.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
END = ""
CLASS = {c: "U" if c.isupper() else "h" if c in "abcdef" else "l" if c.islower() else "0" if c.isdigit() else c for c in ALPHABET}
SIZE = Counter(CLASS.values())
_CODE = np.full(256, len(ALPHABET), np.uint8)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
#: From characters and the end (last) to characters, the end and the classes of several characters.
_SIGNS = np.hstack([np.eye(len(ALPHABET) + 1), np.array([[CLASS.get(c) == k for k in SIZE if SIZE[k] > 1] for c in (*ALPHABET, END)], float)])


class Suffixes:
    """What follows a state: the rests of some examples, with how often each character and class is at each place."""

    def __init__(self, codes: list[np.ndarray], rests: list[tuple[int, int]], evidence: int):
        self.rests = rests
        self.shares = np.zeros((0, _SIGNS.shape[1]))
        if len(rests) >= evidence:
            left = np.sort([len(codes[i]) - at for i, at in rests])[::-1]
            places = int(left[max(2, len(left) // 20) - 1]) + 1  # what fewer than a twentieth reach can't differ
            signs = [np.append(codes[i][at:], len(ALPHABET))[:places] for i, at in rests]
            spot = np.concatenate([np.arange(len(x)) * len(_SIGNS) + x for x in signs])
            self.shares = np.bincount(spot, minlength=places * len(_SIGNS)).reshape(places, -1) @ _SIGNS / len(rests)

    def agrees(self, other: Suffixes, alpha: float) -> bool:
        """Hoeffding's bound on the frequency of every character and class, and of the end, at every place."""
        n = max(len(self.shares), len(other.shares))
        one, two = (np.pad(x.shares, ((0, n - len(x.shares)), (0, 0))) for x in (self, other))
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (len(self.rests) ** -0.5 + len(other.rests) ** -0.5)
        return bool((np.abs(one - two) <= bound).all())


class Automaton:
    """Probabilistic deterministic automaton: state i has counts {character or END: visits} and moves {character: state}.

    A character's probability is its share of the visits, interpolated (Witten and Bell) with that of its class and with
    evenly drawn characters. A character never seen in a state moves as the most visited of its class, or of all, does.
    """

    def __init__(self, counts: list[dict[str, int]], moves: list[dict[str, int]], floor: float = -math.inf):
        self.counts, self.moves, self.floor = counts, moves, floor
        self.known: list[dict[str, tuple[float, int]]] = [{} for _ in counts]

    @property
    def states(self) -> list[tuple[dict[str, int], dict[str, int]]]:
        return list(zip(self.counts, self.moves, strict=True))

    @classmethod
    def infer(cls, examples: list[str], alpha: float = 0.05, evidence: int = 30, fit: float = 0.05, slack: float = 0.25) -> Automaton:
        """Merges compatible states of the examples' prefix tree, level by level.

        The successors of a level are merged with each other and with earlier states (which makes loops) where the rests
        of their examples agree by Hoeffding's bound at each place. States with fewer than ``evidence`` visits cannot be
        tested: siblings of one class are pooled first, then all rare siblings, and only a pool with enough visits is
        tested. Where a single example is left, its rest is one state with a loop. Whole examples are read. ``floor`` is
        the score a character that all but ``fit`` of the examples reach, each scored without itself, less ``slack``.
        """
        examples = sorted(set(examples))
        codes = [_CODE[np.frombuffer(x.encode("latin-1", "replace"), np.uint8)] for x in examples]
        counts: list[dict[str, int]] = []
        moves: list[dict[str, int]] = []
        states: list[Suffixes | None] = []

        def new(suffixes) -> int:
            counts.append({})
            moves.append({})
            states.append(suffixes)
            return len(counts) - 1

        def tail(i: int, at: int) -> int:
            state = new(None)
            counts[state] = dict(Counter(examples[i][at:])) | {END: 1}
            moves[state] = dict.fromkeys(examples[i][at:], state)
            return state

        def walk(state: int, rests: list[tuple[int, int]]) -> None:
            """Count rests that join a state known before along its moves; where none is known, as a loop's last resort, stay."""
            for i, at in rests:
                here = state
                for c in examples[i][at:]:
                    counts[here][c] = counts[here].get(c, 0) + 1
                    here = moves[here].setdefault(c, here)
                counts[here][END] = counts[here].get(END, 0) + 1

        level = [new(Suffixes(codes, [(i, 0) for i in range(len(examples))], evidence))] if examples else []
        late: list[tuple[int, list]] = []
        while level:
            nodes: list[tuple[list, list]] = []  # ([(state, character)], rests)
            for state in level:
                by: dict[str, list] = {}
                for i, at in states[state].rests:
                    c = examples[i][at] if at < len(examples[i]) else END
                    counts[state][c] = counts[state].get(c, 0) + 1
                    if c:
                        by.setdefault(c, []).append((i, at + 1))
                pools: dict[str, list] = {}
                for c in sorted(by):
                    if len(by[c]) >= evidence:
                        nodes.append(([(state, c)], by[c]))
                    else:
                        pools.setdefault(CLASS.get(c, c), []).append(c)
                rest = []
                for own in pools.values():
                    if sum(len(by[c]) for c in own) >= evidence:
                        nodes.append(([(state, c) for c in own], [r for c in own for r in by[c]]))
                    else:
                        rest += own
                if rest:
                    nodes.append(([(state, c) for c in rest], [r for c in rest for r in by[c]]))
            known, level = len(states), []
            for edges, rests in sorted(nodes, key=lambda x: (-len(x[1]), x[0])):
                to = None
                if len(rests) == 1:
                    to = tail(*rests[0])
                else:
                    found = Suffixes(codes, rests, evidence)
                    if len(rests) >= evidence:
                        for other in [*level, *range(known)]:
                            own = states[other]
                            if own is not None and len(own.rests) >= evidence and own.agrees(found, alpha):
                                to = other
                                break
                    if to is None:
                        level.append(to := new(found))
                    elif to < known:
                        late.append((to, rests))
                    else:
                        states[to] = Suffixes(codes, states[to].rests + rests, evidence)
                for state, c in edges:
                    moves[state][c] = to
        for state, rests in late:
            walk(state, rests)
        out = cls(counts, moves)
        scores = sorted(out.bits(x, without=1) / max(1, len(x)) for x in examples)
        out.floor = scores[int(fit * len(scores))] - slack if scores else math.inf
        return out

    def _move(self, at: int, c: str, without: int = 0) -> tuple[float, int]:
        counts, moves = self.counts[at], self.moves[at]
        own = max(0, counts.get(c, 0) - without)
        n, kinds = sum(counts.values()) - without, len(counts) - (c in counts and not own)
        like = [x for x in counts if x and CLASS.get(x, x) == CLASS.get(c, c)] if c else []
        of_class = max(0, sum(counts[x] for x in like) - without) if c else own
        classes = len({CLASS.get(x, x) for x in counts}) or 1
        size = SIZE.get(CLASS.get(c, c), 1) if c else 1
        even = size / (len(ALPHABET) + 1)
        by_class = (of_class + classes * even) / (max(n, 0) + classes) / size
        p = (own + max(kinds, 1) * by_class) / (max(n, 0) + max(kinds, 1))
        return math.log2(p), moves.get(c, max([(counts[x], moves[x]) for x in like if x in moves] or [(counts.get(x, 0), to) for x, to in moves.items()], default=(0, at))[1])

    def bits(self, s: str, least: float = -math.inf, without: int = 0) -> float:
        """log2 of the likelihood of a whole value; stops, with minus infinity, once that must fall below ``least``."""
        at, total = 0, 0.0
        for c in (*s, END):
            if without:
                step = self._move(at, c, without)
            else:
                step = self.known[at].get(c)
                if step is None:
                    step = self.known[at][c] = self._move(at, c)
            total += step[0]
            if total < least:
                return -math.inf
            at = step[1]
        return total

    def bits_per_char(self, s: str) -> float:
        return self.bits(s) / max(1, len(s))


class Untouched:
    """The gaps between spans (start, kind, end), sorted by start, that may overlap."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.reach, far = [], [], 0
        for start, _, end in spans:
            far = max(far, end)
            self.starts.append(start)
            self.reach.append(far)

    def holds(self, start: int, end: int) -> bool:
        """Does no span share a character with start..end? Of those that begin before its end, none may reach beyond its start."""
        before = bisect_left(self.starts, end)
        return not before or self.reach[before - 1] <= start


def secret_like(s: str, credentials: list[Automaton], plain: Automaton | None, margin: float) -> bool:
    """Does a credential automaton find s typical and at least ``margin`` bits likelier than ordinary runs of characters?"""
    for automaton in credentials:
        score = automaton.bits(s, automaton.floor * len(s))
        if score > -math.inf and score - max(plain.bits(s) if plain else -math.inf, FOREIGN * len(s)) >= margin:
            return True
    return False


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, examples: int = 2_000, margin: float = 20.0) -> dict[str, Automaton]:
    """An automaton per base kind and one of ordinary runs, from about ``sample_docs`` documents chosen by a hash of id
    and text; of rows equal in both, one is taken.

    What the base patterns find there are the labelled credentials, at most ``examples`` of each kind (the least by hash),
    whole. Ordinary runs are those that touch no base span: ``examples`` of letters only and as many others, again the
    least by hash; of those others, runs that a credential automaton takes for its own are left out. One scan of the
    sample finds all of them. A kind that does not occur has no automaton.
    """
    sample = sampled(docs.where(F.col(text_col).isNotNull()), 9, id_col, text_col, max(1, docs.count() // sample_docs)).select(text_col)
    kinds = (*KINDS[:3], "word", "other")

    def run(batches):
        for batch in batches:
            seen = {kind: set() for kind in kinds}
            for text in batch.column(0):
                text = text.as_py()
                spans = base_spans(text)
                for start, kind, end in spans:
                    value = text[start:end]
                    seen[KINDS[kind]].add(ASSIGN.match(value)[2] if kind == 0 else value)
                free = Untouched(spans)
                for m in CANDIDATE.finditer(text):
                    if free.holds(m.start(), m.end()):
                        seen["word" if m[0].isalpha() else "other"].add(m[0])
            # what is not among the least of a batch is not among the least of all
            chosen = [(kind, h, v) for kind, own in seen.items() for h, v in heapq.nsmallest(2 * examples, ((xxhash.xxh3_64_intdigest(v) >> 1, v) for v in own))]
            columns = list(zip(*chosen, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["kind", "hash", "value"])

    found = materialize(sample.mapInArrow(run, "kind string, hash long, value string").distinct(), "runs")
    least = {kind: [r["value"] for r in found.where(F.col("kind") == kind).orderBy("hash", "value").limit(2 * examples).collect()] for kind in kinds}
    automata = {kind: Automaton.infer(least[kind][:examples]) for kind in KINDS[:3] if least[kind]}
    if not automata:
        return automata
    others = [x for x in least["other"] if not secret_like(x, list(automata.values()), None, margin)]
    usual = least["word"][:examples] + others[:examples]
    return automata | ({"word": Automaton.infer(usual)} if usual else {})


def scan(docs: DataFrame, automata: dict[str, Automaton], text_col: str = "text", margin: float = 20.0) -> DataFrame:
    """docs with ``spans``: array of (kind, start, end), code points, end exclusive, by start and then kind.

    Base spans come from the fixed patterns. Every run of at least ``SHORTEST`` candidate characters that touches none of
    them is scored, whole; it gets kind ``grammar`` when some credential automaton finds it typical (its score a character
    reaches the automaton's floor) and at least ``margin`` bits likelier than the automaton of ordinary runs does.

    A text of any length is scanned once: each run is looked up among the base spans by bisection, and scored in time that
    grows with its length. Null text has no spans; rows are judged one by one, so repeated rows agree and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({k: (a.counts, a.moves, a.floor) for k, a in automata.items()})
    keep = [c for c in docs.columns if c != "spans"]

    def run(batches):
        models = {k: Automaton(*x) for k, x in shared.value.items()}
        plain = models.pop("word", None)
        credentials = list(models.values())
        known: dict[str, bool] = {}
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.names.index(text_col)):
                text = text.as_py() or ""
                spans = base_spans(text)
                found, free = [], Untouched(spans)
                for m in CANDIDATE.finditer(text) if models else ():
                    if not free.holds(m.start(), m.end()):
                        continue
                    s = m[0]
                    hit = known.get(s)
                    if hit is None:
                        hit = secret_like(s, credentials, plain, margin)
                        if len(known) >= REMEMBERED:
                            known.clear()
                        if len(s) <= 64:  # longer ones hardly repeat
                            known[s] = hit
                    if hit:
                        found.append((m.start(), 3, m.end()))
                spans += found
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in keep], pa.array(out, kind)], names=[*keep, "spans"])
        release_memory()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", spans array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(*keep).mapInArrow(run, schema)


def base_digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def op9(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    found = scan(docs, learn(docs))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
