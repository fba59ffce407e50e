"""Secret scans with one deterministic automaton for all rules.

Rule regexes are parsed, united into one non-deterministic automaton over
bytes, made deterministic by subset construction and minimised by partition
refinement.  The result is a flat array of transitions; a text is scanned in
one pass over its UTF-8 bytes, whatever the number of rules.  Where the pass
meets an accepting state, the rule's reversed automaton finds where the match
begins and its own automaton how far it reaches.

Supported syntax: literals, escapes (``\\d \\w \\s`` and escaped signs),
classes, ``.``, groups, ``|``, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from segmill.llm.common import mapped

#: Rule names and regexes.
RULES: tuple[tuple[str, str], ...] = (
    ("aws_access_key", "AKIA[0-9A-Z]{16}"),
    ("github_token", "gh[pousr]_[A-Za-z0-9]+"),
    ("slack_token", "xox[abprs]-[0-9]+-[0-9A-Za-z-]+"),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("json_web_token", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
    ("password", "[Pp]ass(word|wd)[ ]*[=:][ ]*[^ \\t\\n\\r\"']+"),
    ("assigned_secret", "([Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi_?[Kk]ey|API_?KEY)[ ]*[=:][ ]*[\"']?[0-9A-Za-z_-]+"),
    ("quoted_hex_40", "\"[0-9a-f]{40}\""),
)

_ALL = (1 << 256) - 1
_NAMED = {"d": "0-9", "w": "0-9A-Za-z_", "s": " \t\n\x0b\x0c\r"}


class _Parser:
    """Recursive descent to a tree: ('set', mask), ('cat', list), ('or', list), ('rep', node, low, high or None)."""

    def __init__(self, text: str):
        self.t, self.i = text, 0

    def parse(self):
        node = self.either()
        if self.i != len(self.t):
            raise ValueError(f"unexpected {self.t[self.i]!r} at {self.i} in {self.t!r}")
        return node

    def either(self):
        parts = [self.sequence()]
        while self.i < len(self.t) and self.t[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.i < len(self.t) and self.t[self.i] not in "|)":
            node = self.atom()
            while self.i < len(self.t) and self.t[self.i] in "?*+{":
                node = self.repeat(node)
            parts.append(node)
        return ("cat", parts)

    def repeat(self, node):
        sign = self.t[self.i]
        self.i += 1
        if sign != "{":
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            return ("rep", node, low, high)
        end = self.t.index("}", self.i)
        low, comma, high = self.t[self.i : end].partition(",")
        self.i = end + 1
        return ("rep", node, int(low), (int(high) if high else None) if comma else int(low))

    def atom(self):
        c = self.t[self.i]
        self.i += 1
        if c == "(":
            if self.t.startswith("?:", self.i):
                self.i += 2
            node = self.either()
            if self.t[self.i : self.i + 1] != ")":
                raise ValueError(f"unclosed group in {self.t!r}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.bracket())
        if c == ".":
            return ("set", _ALL & ~(1 << 10))
        if c == "\\":
            return self.escape()
        if c in "*+?{":
            raise ValueError(f"nothing to repeat in {self.t!r}")
        return ("cat", [("set", 1 << b) for b in c.encode()])

    def escape(self):
        c = self.t[self.i]
        self.i += 1
        if c.lower() in _NAMED:
            m = _Parser(_NAMED[c.lower()] + "]").bracket()
            return ("set", m if c.islower() else _ALL & ~m)
        c = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}.get(c, c)
        return ("cat", [("set", 1 << b) for b in c.encode()])

    def bracket(self):
        mask, negate = 0, False
        if self.t[self.i] == "^":
            negate, self.i = True, self.i + 1
        first = True
        while first or self.t[self.i] != "]":
            first = False
            c = self.t[self.i]
            self.i += 1
            if c == "\\":
                kind, m = self.escape()
                if kind == "set":
                    mask |= m
                    continue
                c = bytes([m[0][1].bit_length() - 1]).decode("latin-1")
            if ord(c) > 127:
                raise ValueError("classes hold ASCII only")
            if self.t[self.i] == "-" and self.t[self.i + 1] != "]":
                to = self.t[self.i + 1]
                self.i += 2
                for b in range(ord(c), ord(to) + 1):
                    mask |= 1 << b
            else:
                mask |= 1 << ord(c)
        self.i += 1
        return _ALL & ~mask if negate else mask


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[list[tuple[int, int]]] = []
        self.chain: dict[int, tuple[int, int]] = {}
        self.tail = None

    def state(self) -> int:
        self.empty.append([])
        self.step.append([])
        return len(self.empty) - 1

    def add(self, node, at: int, reverse: bool) -> int:
        """Adds the node behind a state; returns the state after it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.step[at].append((node[1], end))
            return end
        if kind == "cat":
            for part in reversed(node[1]) if reverse else node[1]:
                at = self.add(part, at, reverse)
            return at
        if kind == "or":
            end = self.state()
            for part in node[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self.add(part, begin, reverse)].append(end)
            return end
        _, part, low, high = node
        name = len(self.empty)
        for count in range(low):
            at = self.add(part, at, reverse)
            if node is self.tail:
                self.chain[at] = (name, count)
        if high is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(part, loop, reverse)].append(loop)
            end = self.state()
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[at].append(end)
        for _ in range(high - low):
            at = self.add(part, at, reverse)
            self.empty[at].append(end)
        return end

    def kept(self, states) -> frozenset[int]:
        """Of the states that count one class at a rule's end, the furthest.

        A thread that began later stays behind until the earlier one ends: both
        die of the same byte, and its match would overlap the earlier one's.
        """
        most: dict[int, int] = {}
        for s in states:
            if s in self.chain:
                name, count = self.chain[s]
                most[name] = max(most.get(name, -1), count)
        return frozenset(s for s in states if s not in self.chain or most[self.chain[s][0]] == self.chain[s][1])

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """``next[state + class]`` is the next state; states are multiples of ``classes`` and 0 begins.

    ``of[byte]`` is the class of a byte, ``accept[state // classes]`` the rules that end there.
    Accepting states have the highest numbers, from ``accepting`` on.
    """

    def __init__(self, trees, search: bool, reverse: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        if search:
            nfa.step[start].append((_ALL, start))
        ends = {}
        for rule, tree in enumerate(trees):
            begin = nfa.state()
            nfa.empty[start].append(begin)
            last = tree[1][-1] if tree[0] == "cat" and tree[1] else None
            nfa.tail = last if search and last and last[0] == "rep" and last[1][0] == "set" and last[3] in (None, last[2]) else None
            ends.setdefault(nfa.add(tree, begin, reverse), set()).add(rule)
        self._determine(nfa, start, ends)

    def _determine(self, nfa: _Nfa, start: int, ends: dict[int, set[int]]) -> None:
        masks = sorted({m for step in nfa.step for m, _ in step})
        classes: dict[tuple[bool, ...], int] = {}
        of = [classes.setdefault(tuple(bool(m >> b & 1) for m in masks), len(classes)) for b in range(256)]
        sample = [of.index(k) for k in range(len(classes))]
        moves = [[nfa.closure([t for m, t in step if m >> b & 1]) for b in sample] if step else None for step in nfa.step]
        first = nfa.closure([start])
        number, rows, todo = {first: 0}, [], [first]
        for subset in todo:
            row, live = [], [moves[s] for s in subset if moves[s]]
            for k in range(len(sample)):
                to = nfa.kept(frozenset().union(*[m[k] for m in live]))
                if to not in number:
                    number[to] = len(todo)
                    todo.append(to)
                    if len(todo) > 200_000:
                        raise ValueError("the rules need more than 200,000 states")
                row.append(number[to])
            rows.append(row)
        accepts = [frozenset().union(*[ends[s] for s in subset if s in ends]) for subset in todo]
        part = {}
        block = [part.setdefault(a, len(part)) for a in accepts]
        while True:  # refines the partition until it is stable
            sign: dict[tuple, int] = {}
            new = [sign.setdefault((block[i], *[block[t] for t in row]), len(sign)) for i, row in enumerate(rows)]
            if len(sign) == len(set(block)):
                break
            block = new
        order = {}
        for i in sorted(range(len(rows)), key=lambda i: (bool(accepts[i]), i != 0, i)):
            order.setdefault(block[i], len(order))
        if accepts[0]:
            raise ValueError("a rule matches the empty text")
        self.states, self.classes, self.of = len(order), len(classes), bytes(of)
        n = len(classes)
        table, self.accept = [0] * (n * len(order)), [frozenset()] * len(order)
        for i, row in enumerate(rows):
            s = order[block[i]]
            self.accept[s] = accepts[i]
            table[s * n : s * n + n] = [order[block[t]] * n for t in row]
        self.next = table
        self.accepting = n * next((s for s in range(self.states) if self.accept[s]), self.states)
        self.dead = next((s * n for s in range(self.states) if not self.accept[s] and set(table[s * n : s * n + n]) == {s * n}), -1)

    def __getstate__(self):
        return self.__dict__ | {"next": array("i", self.next)}

    def __setstate__(self, state):
        self.__dict__.update(state | {"next": state["next"].tolist()})

    def longest(self, coded: bytes, at: int, stop: int, step: int = 1) -> int:
        """Bytes of the longest match that begins at a place and goes to ``stop`` at most, or -1; coded: the text's classes."""
        s, best, table, limit, dead = 0, -1, self.next, self.accepting, self.dead
        for i in range(at, stop, step):
            s = table[s + coded[i]]
            if s >= limit:
                best = i
            elif s == dead:
                break
        return -1 if best < 0 else abs(best - at) + 1


class Scanner:
    def __init__(self, rules=RULES):
        self.names = [name for name, _ in rules]
        trees = [_Parser(regex).parse() for _, regex in rules]
        self.all = Dfa(trees, search=True)
        self.ahead = [Dfa([t], search=False) for t in trees]
        self.back = [Dfa([t], search=False, reverse=True) for t in trees]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, begin, end) in bytes: for each rule, the leftmost longest matches that don't overlap."""
        table, limit, accept, classes = self.all.next, self.all.accepting, self.all.accept, self.all.classes
        s, found, last = 0, [], [0] * len(self.names)
        coded: dict[int, tuple[bytes, bytes]] = {}  # the text in the classes of a rule's own automata, once a text
        for i, b in enumerate(data.translate(self.all.of)):
            s = table[s + b]
            if s >= limit:
                for rule in accept[s // classes]:
                    if i >= last[rule]:
                        if rule not in coded:
                            coded[rule] = data.translate(self.back[rule].of), data.translate(self.ahead[rule].of)
                        back, ahead = coded[rule]
                        reach = self.back[rule].longest(back, i, last[rule] - 1, -1)
                        if reach < 0:  # it began inside the match before
                            continue
                        begin = i + 1 - reach
                        last[rule] = end = begin + self.ahead[rule].longest(ahead, begin, len(data))
                        found.append((rule, begin, end))
        return sorted(found, key=lambda m: (m[1], m[0]))


@lru_cache(maxsize=4)
def scanner(rules=RULES) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row for each match: doc_id, rule, nth (per document and rule, from 1), start and n_chars in characters, sha256 of the match.

    For each rule the leftmost longest matches are reported that don't overlap
    one another; matches of different rules may.  Null and empty texts have
    none.  Rows that repeat are scanned each for itself.  A null doc_id stays
    null.  Other columns are ignored, whatever their names.
    """
    rules = tuple(map(tuple, rules))
    machine = scanner(rules)  # compiled once, here; tasks get the arrays

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            data, nth, at, start = text.encode(), {}, 0, 0
            for rule, begin, end in machine.scan(data):  # by where they begin
                nth[rule] = nth.get(rule, 0) + 1
                start, at = start + len(data[at:begin].decode()), begin
                rows.append((doc, machine.names[rule], nth[rule], start, len(data[begin:end].decode("utf-8", "replace")), hashlib.sha256(data[begin:end]).hexdigest()))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "rule", "nth", "start", "n_chars", "match_sha256"])

    return mapped(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), "doc_id long, rule string, nth long, start long, n_chars long, match_sha256 string", piece)
