"""Secret scans by grammar inference.

Fixed patterns find the base secrets. Their distinct values in all documents are the labelled
credentials: their characters, as classes, make a prefix tree, and states of the tree whose
continuations are statistically compatible (Hoeffding bounds at ``ALPHA``, on the next ``AHEAD`` characters) are merged into a probabilistic
automaton. The tree is never built: round by round all credentials run through the states that there are, what follows on them and on their
new neighbours is counted, and each neighbour is merged or becomes a state. A second automaton is inferred in the same way one level up, from where the kind of character (digit, lower, upper, mark)
changes in the credentials: how often key material changes kind is much the same in all formats, so it knows formats whose characters
the first has not seen. Characters are then as likely as one another among those of the same kind, or of the others, in the token's alphabet. The other
long tokens are unlabelled, not ordinary: a background chain over the classes starts from a prior
(ordinary tokens are runs of one kind of character) and is refitted to each token by its probability of being
ordinary. Any other token of at least ``MIN_TOKEN`` characters is a secret too if its likelihood ratio per character
is above the threshold: the score that a share of ``FALSE_RATE`` of the background reaches, or the evidence that
held-out credentials allow to ask for, within ``EVIDENCE``, whichever is more.

One pass finds all distinct credentials and long tokens and stores what their classes are; every count, weight and threshold is a sum over them, in
whole numbers, made by tasks. The driver gets sums only: windows of ``AHEAD`` characters by state, steps of the background, and weights by level of
score. The model is small (states by classes); the scan is one pass over the documents without a shuffle.

Cases: a null or empty text has no secrets; very long texts are scanned whole, in time that grows with their length; overlapping
kinds are all kept; a token that touches a base span is not
scored again; without labelled credentials the method adds nothing; ordinary tokens that look drawn at random (encoded
images, identifiers) cannot be told from keys and are reported; repeated rows are scanned once each; an empty table gives
no rows; other columns are never read. Places are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.common import sliced, small_batches, stored, table

#: The base patterns.
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
MIN_ASSIGN, MIN_ACCESS = 12, 18

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_TOKEN = 16
ALPHA = 0.05
#: Symbols that two states' continuations are compared on: classes, and changes of the kind.
AHEAD = (3, 6)
#: Characters that count after one another when a likelihood is taken; longer tokens are judged on their classes alike.
_CLASS_OF = {c: k for k, s in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")) for c in s}
_CLASS_SIZE = (10, 6, 20, 6, 20, 1, 1, 1, 1, 1, 1)
N_CLASSES = len(_CLASS_SIZE)
#: A token's classes as letters, of which the one after the last is its end.
_LETTERS = "abcdefghijk"
END = "l"
_SHAPE = str.maketrans({c: _LETTERS[k] for c, k in _CLASS_OF.items()})
_PLACE = {c: k for k, c in enumerate(_LETTERS + END)}
#: Kinds of classes (digit, lower, upper, mark), and the prior of the background: kind after kind, the last row at the start, worth PRIOR characters a row.
_KIND_OF = (0, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3)
_KIND_STEPS = ((0.80, 0.04, 0.04, 0.12), (0.01, 0.91, 0.04, 0.04), (0.01, 0.25, 0.70, 0.04), (0.15, 0.50, 0.15, 0.20), (0.15, 0.50, 0.30, 0.05))
PRIOR = 200
#: Share of ordinary tokens that may be taken for secrets, share of held-out credentials that may be lost for more evidence, and that evidence at least and at most.
FALSE_RATE, LOST, EVIDENCE = 0.001, 0.02, (0.15, 0.25)
#: Characters of each kind, and of each that holds letters of hexadecimal numbers alone.
_KIND_SIZE, _HEX_SIZE = (10, 26, 26, 6), 6
#: What a token's alphabet costs: digits with small letters, with capitals, with both, or with marks.
ALPHABET_COST = math.log(4)
#: Probability that a long token is a secret, before it is looked at, and rounds of refitting.
SECRET_SHARE, ROUNDS = 0.01, 5
#: Weights are summed up in parts of WHOLE, and scores by levels of 1 / LEVELS.
WHOLE, LEVELS = 1 << 20, 10_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base secrets, kinds by their place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def other_tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long tokens that touch no base span; spans are in the order of their starts."""
    out, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= a:
            out.append((a, b))
    return out


def credentials(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The values of the base secrets."""
    return [text[a:b] if k else ASSIGN.match(text, a)[1] for a, k, b in spans]


def classes(token: str) -> list[int]:
    return [_CLASS_OF[c] for c in token]


@dataclass
class Automaton:
    """A probabilistic automaton over symbols; the end is the last column of counts, and -1 stands where nothing follows."""

    count: list[list[int]] = field(default_factory=list)
    to: list[list[int]] = field(default_factory=lambda: [[-1] * N_CLASSES])


def changed(word: list[int]) -> list[int]:
    """Of a token's classes after the first: 1 where the kind is another than before, else 0."""
    return [int(_KIND_OF[a] != _KIND_OF[b]) for a, b in zip(word, word[1:], strict=False)]


def changes(shape: str) -> str:
    """The same of classes as letters, in letters."""
    return "".join(map(_LETTERS.__getitem__, changed([_PLACE[c] for c in shape])))


def _follow(word: str, n: int, machine: Automaton, ahead: int, which: int, total: Counter) -> None:
    """Adds what follows on each state that a word comes to, up to the first that is none yet; such a one is known by the state and symbol before it."""
    at, to, word = 0, machine.to, word + END
    for k, c in enumerate(word):
        total[which, at * (N_CLASSES + 1) + N_CLASSES, word[k : k + ahead]] += n
        if c == END:
            return
        c = _PLACE[c]
        if to[at][c] < 0:
            total[which, at * (N_CLASSES + 1) + c, word[k + 1 : k + 1 + ahead]] += n
            return
        at = to[at][c]


def _tree(windows: dict[str, int]) -> dict[str, list[int]]:
    """Counts of the next symbol after each beginning of the windows."""
    out: dict[str, list[int]] = {}
    for w, n in windows.items():
        for k, c in enumerate(w):
            out.setdefault(w[:k], [0] * (N_CLASSES + 1))[_PLACE[c]] += n
    return out


def compatible(a: dict[str, list[int]], b: dict[str, list[int]], alpha: float) -> bool:
    """Whether the continuations of two states may be the same, by Hoeffding bounds on every step."""
    factor = math.sqrt(0.5 * math.log(2 / alpha))
    for begin, cb in b.items():
        if ca := a.get(begin):
            na, nb = sum(ca), sum(cb)
            bound = factor * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if any(abs(x / na - y / nb) > bound for x, y in zip(ca, cb, strict=True)):
                return False
    return True


def _grow(machine: Automaton, follows: dict[int, dict[str, int]], alpha: float) -> bool:
    """Merges each neighbour of the states with the first state that it may be the same as, or makes it one; whether there was any."""
    trees = {key: _tree(windows) for key, windows in follows.items()}
    red = [trees.pop(r * (N_CLASSES + 1) + N_CLASSES, {}) for r in range(len(machine.to))]
    machine.count = [list(t.get("", [0] * (N_CLASSES + 1))) for t in red]
    for key in sorted(trees):
        r, c = divmod(key, N_CLASSES + 1)
        same = next((k for k, t in enumerate(red) if compatible(t, trees[key], alpha)), None)
        if same is None:
            machine.to[r][c] = len(red)
            red.append(trees[key])
            machine.to.append([-1] * N_CLASSES)
            continue
        machine.to[r][c] = same
        for begin, own in trees[key].items():
            red[same][begin] = [x + y for x, y in zip(red[same].get(begin, [0] * (N_CLASSES + 1)), own, strict=True)]
    return bool(trees)


def infer_all(sums, alpha: float = ALPHA, with_held: bool = False) -> tuple[Automaton, Automaton]:
    """The automata of classes and of changes of all credentials, without those held out. sums: see fit."""
    machines = (Automaton(), Automaton())
    todo = [0, 1]
    while todo:

        def count(rows, total, todo=tuple(todo)):
            for shape, secret, held, n in rows:
                if secret and (with_held or not held):
                    for k in todo:
                        _follow(changes(shape) if k else shape, n, machines[k], AHEAD[k], k, total)

        follows: dict[int, dict[int, dict[str, int]]] = {k: {} for k in todo}
        for (k, key, window), n in sums(count).items():
            follows[k].setdefault(key, {})[window] = n
        todo = [k for k in todo if _grow(machines[k], follows[k], alpha)]
    return machines


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of the classes of labelled words."""
    return infer_all(_summed_here(_shapes(words, [])), alpha, with_held=True)[0]


def background(steps: dict[tuple[int, int], float]) -> list[list[float]]:
    """Log-likelihood steps of ordinary tokens from weights of steps: class after class, the last row at the start."""
    size = [sum(n for n, k in zip(_CLASS_SIZE, _KIND_OF, strict=True) if k == kind) for kind in range(4)]
    rows = [[PRIOR * _KIND_STEPS[k][_KIND_OF[c]] * n / size[_KIND_OF[c]] for c, n in enumerate(_CLASS_SIZE)] for k in (*_KIND_OF, 4)]
    for (at, c), weight in steps.items():
        rows[at][c] += weight
    return [[math.log(x / sum(row) / n) for x, n in zip(row, _CLASS_SIZE, strict=True)] for row in rows]


@dataclass
class FormatModel:
    """Log-likelihood steps of both automata and of ordinary tokens, and the threshold between them."""

    steps: list[list[float]]
    to: list[list[int]]
    kind_steps: list[list[float]]
    kind_to: list[list[int]]
    ordinary: list[list[float]]
    threshold: float

    def by_kinds(self, word: list[int]) -> float:
        """The log-likelihood of a token's classes by the automaton of kinds; a token of one kind shows no change, so it has none."""
        held = {_KIND_OF[c]: set() for c in word}
        for c in word:
            held[_KIND_OF[c]].add(c)
        if len(held) == 1:
            return -math.inf
        size = {k: _HEX_SIZE if k in (1, 2) and own <= {1, 3} else _KIND_SIZE[k] for k, own in held.items()}
        every, at = sum(size.values()), 0
        # the next character is any of its kind, or if the kind changes any of the others
        same, other = {k: -math.log(n) for k, n in size.items()}, {k: -math.log(every - n) for k, n in size.items()}
        out = -math.log(every) - ALPHABET_COST
        for c, x in zip(word, changed(word), strict=False):
            out += self.kind_steps[at][x] + (other if x else same)[_KIND_OF[c]]
            at = self.kind_to[at][x]
        return out

    def score(self, token: str) -> float:
        """Log-likelihood ratio per character: either automaton, one as likely as the other, against ordinary."""
        return self.score_classes(classes(token))

    def score_classes(self, word: list[int]) -> float:
        at, before, own, other = 0, N_CLASSES, 0.0, 0.0
        for c in word:
            other += self.ordinary[before][c]
            before = c
            if at < 0:
                own += math.log(1e-4)
                continue
            own += self.steps[at][c]
            at = self.to[at][c]
        general = self.by_kinds(word)
        high, low = max(own, general), min(own, general)
        return (high + math.log1p(math.exp(low - high)) - math.log(2) - other) / len(word)


def _closed(kinds: Automaton) -> list[list[int]]:
    """The automaton's steps; a state that no credential went on from with a symbol goes on as the start would, so tokens may be longer."""
    return [[t if t >= 0 else 0 for t in row[:2]] for row in kinds.to]


def _held(word: str) -> bool:
    """A fifth of the credentials is held out."""
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:8]) % 5 == 0


def _shapes(positive: list[str], unlabelled: list[str]) -> list[tuple[str, bool, bool, int]]:
    """(classes, secret, held out, n) of words."""
    return [(*k, n) for k, n in sorted(Counter((w.translate(_SHAPE), s, s and _held(w)) for words, s in ((positive, True), (unlabelled, False)) for w in words).items())]


def _summed_here(rows):
    """sums of fit over a list."""

    def sums(count):
        total = Counter()
        count(rows, total)
        return total

    return sums


def _summed(words: DataFrame):
    """sums of fit over a table of shape, secret, held, n, made by tasks."""

    def sums(count):
        def run(batches):
            total = Counter()
            for b in sliced(batches):
                count(list(zip(*(c.to_pylist() for c in b.columns), strict=True)), total)
            keys = list(total)
            columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.string()), pa.array(total.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "c", "n"])

        return {(r.a, r.b, r.c): r.n for r in words.mapInArrow(run, "a long, b long, c string, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).collect()}

    return sums


def _ordinary(score: float, length: int) -> float:
    """A token's probability of being ordinary."""
    return 1 / (1 + math.exp(min(score * length + math.log(SECRET_SHARE / (1 - SECRET_SHARE)), 500.0)))


def fit(sums, alpha: float = ALPHA) -> FormatModel | None:
    """The model of all words; None if there are no credentials.

    sums(count) calls count(rows, total) on all rows (shape, secret, held, n), part by part, and returns the sums of what it adds to total, whose keys are (number, number, string).
    """

    def credentials_of(rows, total):
        for _, secret, held, n in rows:
            if secret:
                total[0, int(held), ""] += n

    there = sums(credentials_of)
    if not there:
        return None
    with_held = (0, 0, "") not in there  # too few to hold any out
    machine, kinds = infer_all(sums, alpha, with_held)
    steps = [[math.log((c + 1e-3) / (sum(row) + 1e-3 * (N_CLASSES + 1)) / size) for c, size in zip(row, _CLASS_SIZE, strict=False)] for row in machine.count]
    # one of the two follows, so ends are left out
    kind_steps = [[math.log((c + 0.5) / (sum(row[:2]) + 1)) for c in row[:2]] for row in kinds.count]
    model = FormatModel(steps, machine.to, kind_steps, _closed(kinds), background({}), 0.0)

    def steps_of(rows, total):
        for shape, secret, _, n in rows:
            if not secret:
                word = [_PLACE[c] for c in shape]
                weight = n * round(WHOLE * _ordinary(model.score_classes(word), len(word)))
                for a, b in zip([N_CLASSES, *word], word, strict=False):
                    total[a, b, ""] += weight

    for _ in range(ROUNDS):
        model.ordinary = background({(a, b): n / WHOLE for (a, b, _), n in sums(steps_of).items()})
    least, most = EVIDENCE

    def levels_of(rows, total):
        for shape, secret, held, n in rows:
            if secret and (with_held or not held):
                continue
            word = [_PLACE[c] for c in shape]
            score = model.score_classes(word)
            level = math.floor(score * LEVELS)
            if secret:
                total[0, max(math.floor(least * LEVELS), min(math.floor(most * LEVELS), level)), ""] += n
            else:
                weight = n * round(WHOLE * _ordinary(score, len(word)))
                total[1, 0, "all"] += weight
                if score >= least:
                    total[1, level, ""] += weight

    found = sums(levels_of)
    held = sorted((level, n) for (k, level, _), n in found.items() if k == 0)
    place, asked = int(LOST * sum(n for _, n in held)), most
    for level, n in held:
        place -= n
        if place < 0:
            asked = max(least, min(most, level / LEVELS))
            break
    every = found.get((1, 0, "all"), 0)
    room = FALSE_RATE * every
    # less than one ordinary token says nothing about their share
    for level, weight in [] if every < WHOLE else sorted(((level, n) for (k, level, c), n in found.items() if k == 1 and not c), reverse=True):
        room -= weight
        if room < 0:
            asked = max(asked, (level + 1) / LEVELS)
            break
    model.threshold = asked
    return model


def fit_formats(positive: list[str], unlabelled: list[str], alpha: float = ALPHA) -> FormatModel | None:
    """The model of lists of words."""
    return fit(_summed_here(_shapes(positive, unlabelled)), alpha)


def _learn(batches):
    for batch in sliced(batches):
        rows = set()
        for text in batch.column(0).to_pylist():
            text = text or ""
            base = base_spans(text)
            rows |= {(w, True) for w in credentials(text, base)}
            rows |= {(text[a:b], False) for a, b in other_tokens(text, base)}
        if rows:
            words = sorted(rows)
            shapes, held = [w.translate(_SHAPE) for w, _ in words], [s and _held(w) for w, s in words]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(w.encode()).digest() for w, _ in words]), pa.array(shapes), pa.array([s for _, s in words]), pa.array(held)], names=["word", "shape", "secret", "held"])


def train_formats(docs: DataFrame, text_col: str = "text") -> FormatModel | None:
    """The model of the distinct credentials and other long tokens of all documents."""
    small_batches(docs.sparkSession)
    words = docs.select(F.col(text_col).alias("text")).mapInArrow(_learn, "word binary, shape string, secret boolean, held boolean").distinct()
    # read many times below
    words = stored(words.groupBy("shape", "secret", "held").agg(F.count("*").alias("n")))
    return fit(_summed(words))


def _scan(batches, model: FormatModel | None, with_values: bool):
    for batch in sliced(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            base = base_spans(text)
            more = [(a, 3, b) for a, b in other_tokens(text, base) if model.score(text[a:b]) >= model.threshold] if model else []
            said = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans) for spans in (base, sorted(base + more))]
            n = [sum(s[1] == k for s in base) for k in range(3)]
            rows.append((doc, *n, hashlib.sha256(said[0].encode()).hexdigest(), said[1], *([[text[a:b] for a, _, b in sorted(base + more)]] if with_values else [])))
        if rows:
            types = [batch.schema.field(0).type, *[pa.int64()] * 3, pa.string(), pa.string(), *[pa.list_(pa.string())] * with_values]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[str(k) for k in range(len(types))])


def scan_secrets(docs: DataFrame, model: FormatModel | None, with_values: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and, if asked for, the found texts, per row of docs."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", found array<string>" * with_values
    return base.mapInArrow(lambda it: _scan(it, model, with_values), schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train_formats(docs), with_values=False)


QUERIES = {"op7_secrets": op7_secrets}
ORACLE_SQL: dict[str, str] = {}
