"""Secret scans: exact base formats, and formats inferred as probabilistic automata.

The grammar of each labelled credential family is inferred by state merging: a prefix tree of
its examples' symbols (character classes; literals where a family's prefix fixes them). States are
taken up breadth first, those of most visits first. A state merges with an accepted one only if
nothing tells them apart: by the Hoeffding bound its frequencies of symbols and ends, and those of
the states below, and by the Kolmogorov-Smirnov bound the lengths of what may follow, pooled over
all examples that pass. Of several such states it joins the one under which its own tails are
likeliest, so a state with few visits, which no bound tells from anything, goes where its tails
occur. A state with a tail that no accepted state has seen is accepted itself.
So an automaton keeps the positions of a format of fixed length, and a narrow range of lengths.

Every candidate token of a text is scored by each automaton's log-likelihood a symbol, against a
character-class model of ordinary tokens; the best family above MARGIN adds a span. A token that
ends where the automaton has seen no end isn't of that format, whatever its letters. Families with a
prefix are tried wherever it stands after no letter or digit, or after a percent escape, over the
run of their own letters; the others on the parts of a candidate between '=' and '.', whole and
without the plain words of a path. A candidate has LEAST letters or more (the shortest published
format has 20), and without a prefix at least one digit and one letter, as all but a vanishing share
of random tokens of these lengths do.

The labelled credentials are examples drawn from published credential formats by a seeded
generator, so that no real secret is stored here; the negative class is ordinary words. The driver
infers the automata and sends them to the tasks.

Defined cases: a null or empty text has no spans; a very long text is read whole, by patterns that
take linear time; spans are code points with exclusive ends; of families of equal score (a tie) the
name decides, which spans don't show; repeated rows and null ids give one row each; an empty table
gives an empty result; other columns, also of the names put out, are ignored by the scan and kept by
``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}+(?:\.[A-Za-z0-9+/_=-]{16,}+){0,2}+")
#: Linear-time prefilters: a superset of the texts in which the pattern of that kind can match.
GATES = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]", "hex": r"[0-9a-f]{24}", "grammar": r"[A-Za-z0-9+/_=-]{16}"}

EXAMPLES, SEED = 1200, 11
ALPHA, MARGIN, DEPTH = 0.05, 0.25, 2

# Published prefixes and lengths of credential formats.
FORMATS = {
    "cloud_access": ("AKIA", string.ascii_uppercase + string.digits, 16, 16),
    "forge_token": ("ghp_", string.ascii_letters + string.digits, 36, 36),
    "chat_token": ("xoxb-", string.digits + string.ascii_letters + "-", 40, 56),
    "payment_key": ("sk_live_", string.ascii_letters + string.digits, 24, 32),
    "maps_key": ("AIza", string.ascii_letters + string.digits + "-_", 35, 35),
    "web_token": ("eyJ", string.ascii_letters + string.digits + "-_", 60, 120),
    "hex_digest": ("", string.digits + "abcdef", 32, 40),
    "base64_key": ("", string.ascii_letters + string.digits + "+/", 40, 64),
}


def labelled_credentials(family: str, n: int = EXAMPLES) -> list[str]:
    """Seeded examples of a family; the same on every machine."""
    prefix, letters, low, high = FORMATS[family]
    rng = random.Random(f"{SEED}:{family}")
    words = [prefix + "".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(n)]
    if family == "web_token":  # all but every third: header, payload and signature
        words = [w if i % 3 == 0 else f"{w[:20]}.{prefix}{w[20:-24]}.{w[-24:]}" for i, w in enumerate(words)]
    return words


#: A family's prefix and the run of its letters, after no letter or digit or after a percent escape.
RUNS = {f: re.escape(p) + f"[{re.escape(letters)}]++" for f, (p, letters, _, _) in FORMATS.items() if p}
RUNS["web_token"] += r"(?:\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)?+"
PREFIXED = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=%[0-9A-Fa-f]{2}))(?:" + "|".join(f"(?P<{f}>{r})" for f, r in RUNS.items()) + ")")
PART = re.compile(r"[A-Za-z0-9+/_-]++=*+")
LEAST = 16


def _symbol(c: str) -> str:
    return "a" if c in "abcdef" else "z" if "g" <= c <= "z" else "0" if c.isdigit() else "A" if "A" <= c <= "Z" else c


class Automaton:
    """A probabilistic automaton: the visits, ends, symbol counts and next states of each state."""

    def __init__(self, words: list[list[str]]):
        self.ends, self.seen = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.tails: list[dict[int, int]] = [{}]  # how many letters may follow: how often
        for word in words:
            at = 0
            for i, c in enumerate([*word, None]):
                self.seen[at] += 1
                self.tails[at][len(word) - i] = self.tails[at].get(len(word) - i, 0) + 1
                if c is None:
                    self.ends[at] += 1
                    break
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    for column in (self.ends, self.seen):
                        column.append(0)
                    for column in (self.next, self.count, self.tails):
                        column.append({})
                at = self.next[at][c]
        self._merge_states()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _alike(self, a: int, b: int, depth: int = DEPTH) -> bool:
        na, nb = self.seen[a], self.seen[b]
        if self._differ(self.ends[a], na, self.ends[b], nb):
            return False
        for c in self.count[a].keys() | self.count[b].keys():
            if self._differ(self.count[a].get(c, 0), na, self.count[b].get(c, 0), nb):
                return False
            if depth and c in self.next[a] and c in self.next[b] and not self._alike(self.next[a][c], self.next[b][c], depth - 1):
                return False
        return True

    def _same_tails(self, a: int, b: int) -> bool:
        """Kolmogorov-Smirnov: whether the lengths of what follows may be of one distribution."""
        ta, tb, na, nb = self.tails[a], self.tails[b], self.seen[a], self.seen[b]
        total, most = 0.0, math.sqrt(-0.5 * math.log(ALPHA / 2) * (na + nb) / (na * nb))
        for n in sorted(ta.keys() | tb.keys()):
            total += ta.get(n, 0) / na - tb.get(n, 0) / nb
            if abs(total) > most:
                return False
        return True

    def _evidence(self, red: int, state: int) -> float:
        """Log-likelihood of the state's tails under those of an accepted one; none if one never occurred there."""
        tails, n = self.tails[red], self.seen[red]
        return sum(k * math.log(tails[t] / n) if t in tails else -math.inf for t, k in self.tails[state].items())

    def _fold(self, into: int, gone: int) -> None:
        """Add the tree below ``gone`` to ``into``'s states."""
        todo = [(into, gone)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for mine, more in ((self.count[a], self.count[b]), (self.tails[a], self.tails[b])):
                for k, n in more.items():
                    mine[k] = mine.get(k, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    if self.next[a][c] != to:
                        todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge_states(self) -> None:
        """Red states are accepted; each blue one (a red one's child) merges with one of them or turns red."""
        red, depth = {0: 0}, 0
        while True:
            blue = [(d + 1, -self.seen[to], r, c) for r, d in red.items() for c, to in self.next[r].items() if to not in red]
            if not blue:
                break
            depth, _, parent, c = min(blue)
            state = self.next[parent][c]
            fit = [(self._evidence(r, state), -r) for r in red if self._same_tails(r, state) and self._alike(r, state)]
            best, into = max(fit, default=(-math.inf, 0))
            if best == -math.inf:
                red[state] = depth
            else:
                self.next[parent][c] = -into
                self._fold(-into, state)
        place = {r: i for i, r in enumerate(red)}
        self.next = [{c: place[to] for c, to in self.next[r].items()} for r in red]
        self.count, self.ends, self.seen = ([column[r] for r in red] for column in (self.count, self.ends, self.seen))
        del self.tails

    def loglik(self, word: list[str]) -> float:
        """Natural log-likelihood a symbol, with the end. An unseen symbol gets a small share and takes
        the commonest step; a symbol after the last one, or an end where none was seen, gets none."""
        at, total = 0, 0.0
        for c in word:
            if not self.count[at]:
                return -math.inf
            total += math.log((self.count[at].get(c) or 0.05) / (self.seen[at] + 0.1))
            at = self.next[at][c if c in self.next[at] else max(self.count[at], key=self.count[at].get)]
        if not self.ends[at]:
            return -math.inf
        return (total + math.log(self.ends[at] / self.seen[at])) / (len(word) + 1)


_LEARNED: dict[str, tuple[str, Automaton]] = {}


def grammars() -> dict[str, tuple[str, Automaton]]:
    """The automata, inferred on first use unless the driver sent them."""
    if not _LEARNED:
        _LEARNED.update({f: (p := FORMATS[f][0], Automaton([_marked(w, p) for w in labelled_credentials(f)])) for f in FORMATS})
    return _LEARNED


def _marked(token: str, prefix: str) -> list[str]:
    return [f"={c}" for c in prefix] + [_symbol(c) for c in token[len(prefix) :]]


#: Shares of classes among ordinary letters and digits, and how likely a token stays in a class.
BACKGROUND = {"a": 0.42, "z": 0.52, "A": 0.03, "0": 0.02}


def background(token: str) -> float:
    return sum(math.log(BACKGROUND.get(_symbol(c), 0.01)) for c in token) / (len(token) + 1)


def format_score(token: str) -> tuple[float, str]:
    """The best family's log-likelihood a symbol over that of ordinary text; 0 and up is format-like."""
    if token.isalpha() and (token.islower() or token.isupper() or token.istitle()):
        return -9.0, ""
    base = background(token)
    best = (-9.0, "")
    for family, (prefix, auto) in grammars().items():
        if token.startswith(prefix) and len(token) > len(prefix):
            best = max(best, (max(-9.0, auto.loglik(_marked(token, prefix)) - base), family))
    return best


def base_spans(text: str, gates: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds."""
    out = []
    if gates[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if gates[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if gates[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def grammar_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of credential-like format outside the base spans."""
    out, free = [], Free(taken)
    for m in PREFIXED.finditer(text):
        for a, b in dict.fromkeys([m.span(), (m.start(), m.start() + len(m[0].split(".")[0]))]):
            if b - a >= LEAST and free.holds(a, b) and format_score(text[a:b])[0] >= MARGIN:
                out.append((a, 3, b))
                break
    free = Free(taken + out)
    for m in CANDIDATE.finditer(text):
        for p in PART.finditer(text, *m.span()):
            a, b = p.span()
            if b - a >= LEAST and free.holds(a, b):
                c, d = plain_ends(p[0])
                if credential(p[0]):
                    out.append((a, 3, b))
                elif d - c >= LEAST and credential(p[0][c:d]):
                    out.append((a + c, 3, a + d))
    return out


class Free:
    """Whether spans, asked in the order of their starts, meet none of the taken ones."""

    def __init__(self, taken: list[tuple[int, int, int]]):
        self.taken, self.i = sorted((s, e) for s, _, e in taken), 0

    def holds(self, a: int, b: int) -> bool:
        while self.i < len(self.taken) and self.taken[self.i][1] <= a:
            self.i += 1
        return self.i == len(self.taken) or self.taken[self.i][0] >= b


def credential(part: str) -> bool:
    if not any(c.isdigit() for c in part) or not any(c.isalpha() for c in part):
        return False
    return any(format_score(t)[0] >= MARGIN for t in dict.fromkeys([part.strip("=-_/"), part.rstrip("="), part]))


def plain_ends(part: str) -> tuple[int, int]:
    """The part without leading and trailing plain words between slashes."""
    words = part.split("/")
    plain = [not w or w.isalpha() and (w.islower() or w.isupper() or w.istitle()) for w in words]
    if all(plain):
        return 0, 0
    first, last = plain.index(False), plain[::-1].index(False)
    return sum(len(w) + 1 for w in words[:first]), len(part) - sum(len(w) + 1 for w in words[len(words) - last :])


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(texts: list[str | None]) -> tuple[list[list], list[list]]:
    """Base spans and all spans of each text."""
    texts = [t or "" for t in texts]
    column = pa.array(texts, pa.large_string())
    gate = [pc.match_substring_regex(column, g).to_pylist() for g in GATES.values()]
    base, full = [], []
    for i, t in enumerate(texts):
        b = base_spans(t, (gate[0][i], gate[1][i], gate[2][i]))
        base.append(b)
        full.append(sorted(b + grammar_spans(t, b)) if gate[3][i] else b)
    return base, full


def _rows(blocks):
    for block in blocks:
        base, full = scan(block["text"])
        count = lambda k: [sum(x[1] == k for x in s) for s in full]
        yield {"doc_id": block["id"], "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": [hashlib.sha256(_join(s).encode()).hexdigest() for s in base], "spans": [_join(s) for s in full], "n_grammar": count(3)}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar) for every row."""
    docs, learned = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), dict(grammars())

    def rows(blocks):
        _LEARNED.update(learned)
        return _rows(blocks)

    return map_arrow(docs, ["id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long", rows)


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by ``mark``."""
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` redacted; all other columns and all rows stay."""
    schema, at = docs.schema, docs.columns.index(text_col)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, learned = to_arrow_schema(schema), dict(grammars())

    def run(batches):
        _LEARNED.update(learned)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(at).to_pylist()
                clean = [redact(t, s) for t, s in zip(texts, scan(texts)[1], strict=True)]
                columns = [pa.array(clean, f.type) if j == at else part.column(j).cast(f.type) for j, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        settle()

    return docs.mapInArrow(run, schema)
