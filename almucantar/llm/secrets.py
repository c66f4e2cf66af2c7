"""Secret scan by assignment-aware lexing.

Every text is searched for three base kinds (``assign``, ``access``, ``hex``), whose spans are always
kept. A lexer then reads source and configuration syntax in one pass from left to right: comments, string
literals of all quotes, names that something is assigned to, braces and tags. From its tokens a parser makes
bindings: a name, and the literals and names on its right, which ``+``, ``.`` or mere adjacency join. It reads

* ``name = "x"``, ``name: type = "x"``, ``name := x``, ``name => x``, ``name += x``, calls around literals
* ``"name": 'x'`` in objects, and ``{"name": "n", "value": "x"}`` or ``- name: n`` / ``value: x`` as ``n`` bound to ``x``
* ``name: |`` with an indented block, triple quotes, backticks
* ``<name>x</name>`` and ``<item name="n" value="x">``

Constants are propagated through names, wherever in the text these are bound: a name means its last binding
before the place of use, or else its first one after it. A literal's score is how sensitive the most
sensitive name is that it reaches, times how much the value that reaches it looks like a key. What scores
enough and is in no base span becomes a span of kind ``lexed``. What stands in comments is read by itself:
commented-out assignments are found, but do not bind names of the code.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almucantar.llm import shared

KINDS = ("assign", "access", "hex", "lexed")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_STRINGS = r'''"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|(?<![A-Za-z0-9])\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'''
_NAME = r"[A-Za-z_$][\w$]*(?:[.-][\w$]+)*"
#: The lexer: everything that it does not match is passed over.
_TOKEN = re.compile(
    rf"""(?P<comment>/\*(?:[^*]|\*(?!/))*\*/|<!--(?:[^-]|-(?!->))*-->|(?:(?<=\s)|^)\#[^\n]*|(?:(?<=[\s;{{}}])|^)//[^\n]*)"""
    rf"""|(?P<string>{_STRINGS})"""
    rf"""|<(?P<tag>{_NAME})>(?P<inner>[^<>\s]+)</(?P=tag)>"""
    rf"""|<{_NAME}(?P<attributes>(?:\s+{_NAME}\s*=\s*(?:"[^"<>]*"|'[^'<>]*'))+)\s*/?>"""
    rf"""|(?P<name>(?<![\w.$-]){_NAME})(?P<index>\[[^\]\n]{{1,80}}\])?(?=[ \t]*(?::=|=>|\+=|=(?!=)|:(?!:)))"""
    rf"""|(?P<brace>[{{}}])""",
    re.ASCII | re.MULTILINE | re.DOTALL,
)
_OPERATOR = re.compile(r"[ \t]*(:=|=>|\+=|=(?!=)|:(?!:))[ \t]*")
_TYPE = re.compile(r"[ \t]*[A-Za-z_&?][\w.&?|<>\[\], ]{0,80}?[ \t]*=(?![=>])[ \t]*", re.ASCII)
_TERM = re.compile(rf"""(?:(?:[rbufRBUFL]{{1,2}}|@|\$)?(?P<string>{_STRINGS})|(?P<call>(?:{_NAME}[ \t]*)?\()|(?P<bare>[^\s"'`,;(){{}}\[\]<>|]+))""", re.ASCII | re.DOTALL)
_JOIN = re.compile(r"""[ \t]*(?:(?:\+|\.\.?|&|\|\|)[ \t]*(?:\\?\n[ \t]*)?|(?:\\?\n)?[ \t]*(?=["'`]))""")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*(?:#[^\n]*)?\n")
_ATTRIBUTE = re.compile(rf"""({_NAME})\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)')""", re.ASCII)
_IN_CALL = re.compile(rf"(?P<string>{_STRINGS})|[()]|\n", re.ASCII | re.DOTALL)
_ITEM = re.compile(r"[ \t]*-[ \t]+")
_LINE = re.compile(r"([ \t]*)([^\n]*)(?:\n|$)")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)example|sample|changeme|placeholder|dummy|your[_-]|xxxx|\*\*\*|\$\{|%\(|\{\{")
_NO_VALUE = re.compile(r"(?i)<|(?:none|null|true|false|undefined)$")
#: Characters of the longest placeholder.
_LONGEST = 11

#: How sensitive a name is that holds this word, and this pair of words.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "signature": 0.6, "bearer": 0.8, "authorization": 0.8,
}
KEY_BEFORE = {"api", "access", "private", "secret", "signing", "encryption", "auth", "master", "client", "account", "storage"}
#: Keys of an object whose value names what another key of it holds, and those other keys.
NAMING, HOLDING = {"name", "key", "id", "field", "variable", "label"}, {"value", "val", "content", "data", "default"}

SPAN_SCORE = 0.5


def name_score(name: str) -> float:
    """How sensitive a variable, key or tag of this name is, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max((NAME_WORDS.get(w, 0.0) for w in words), default=0.0)
    if any(b == "key" and a in KEY_BEFORE for a, b in zip(words, words[1:], strict=False)):
        best = max(best, 1.0)
    return best


class _Value:
    """What a whole value's score depends on. Values are joined by it: names of names may mean more than any memory holds."""

    __slots__ = ("size", "counts", "kinds", "never", "head", "tail")

    def __init__(self, text: str = ""):
        self.size, self.counts = len(text), Counter(text)
        self.head, self.tail = text[:_LONGEST], text[-_LONGEST:]
        self.kinds = [any(map(f, self.counts)) for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum())]
        self.never = any(map(str.isspace, self.counts)) or _PLACEHOLDER.search(text) is not None  # whatever is joined to it
        if self.never:
            self.counts = Counter()

    def copy(self) -> _Value:
        out = _Value()
        out += self
        return out

    def __iadd__(self, other: _Value) -> _Value:
        self.never = self.never or other.never or _PLACEHOLDER.search(self.tail + other.head) is not None
        self.kinds = [a or b for a, b in zip(self.kinds, other.kinds, strict=True)]
        self.head, self.tail = (self.head + other.head)[:_LONGEST], (self.tail + other.tail)[-_LONGEST:]
        self.size += other.size
        if self.never:
            self.counts = Counter()
            return self
        own, by = self.counts, 0
        for c, n in other.counts.items():
            own[c] = own.get(c, 0) + n
        if self.size >> 256:  # shares far below what a double tells apart go
            by = self.size.bit_length() - 192
            self.size >>= by
            self.counts = Counter({c: n >> by for c, n in own.items() if n >> by})
        return self

    def score(self) -> float:
        if self.size < 8 or self.never or _NO_VALUE.match(self.head):
            return 0.0
        entropy = -sum(n / self.size * math.log2(n / self.size) for n in self.counts.values())
        return min(1.0, entropy / 3.0) * (0.55 + 0.15 * sum(self.kinds))


def literal_score(value: str) -> float:
    """How much a literal, all of it, looks like a key rather than prose or a placeholder, 0 to 1."""
    return _Value(value).score()


@dataclass
class Binding:
    """A name, where it is bound, and what it is bound to: literals (value, start, end) and names (as text, start, end)."""

    name: str
    at: int
    parts: list[tuple[bool, str, int, int]] = field(default_factory=list)  # whether it may be a name


class _Lexer:
    """Bindings of one text, or of one comment in it."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.end = text, end
        self.bindings: list[Binding] = []
        self.comments: list[tuple[int, int]] = []
        self.objects: list[list[Binding]] = [[]]  # of the braces that are open
        self.columns: list[tuple[int, list[Binding]]] = []  # of the blocks that indentation opens
        self.line, self.next_line = start, start - 1  # where the line at hand begins and ends
        self.listed = False  # whether it is a list's item
        self._read(start)

    def _read(self, at: int) -> None:
        text, quoted = self.text, None
        while at < self.end:
            m = _TOKEN.search(text, at, self.end)
            if m is None:
                break
            kind, at = m.lastgroup, m.end()
            if kind == "comment":
                self.comments.append(m.span())
            elif kind == "brace":
                if m["brace"] == "{":
                    self.objects.append([])
                elif len(self.objects) > 1:
                    self._pair(self.objects.pop())
            elif m["string"] is not None:  # a key, if an operator follows
                after = _OPERATOR.match(text, at, self.end)
                if after and after[1] in (":", "=>", "=") and "\n" not in m["string"]:
                    at = self._bind(m["string"].strip("\"'`"), m.start(), after.end(), after[1])
            elif m["tag"] is not None:
                self._add(Binding(m["tag"], m.start(), [(False, m["inner"], *m.span("inner"))]))
            elif m["attributes"] is not None:
                own = [Binding(a[1], a.start(), [(False, a[2] if a[2] is not None else a[3], *(a.span(2) if a[2] is not None else a.span(3)))]) for a in _ATTRIBUTE.finditer(text, *m.span("attributes"))]
                for b in own:
                    self._add(b, alone=True)
                self._pair(own)
            else:
                after = _OPERATOR.match(text, at, self.end)
                name = m["name"] if m["index"] is None else m["name"] + "." + m["index"].strip("[]\"'")
                at = self._bind(name, m.start(), after.end(), after[1])
        while len(self.objects) > 1:
            self._pair(self.objects.pop())
        for _, own in self.columns:
            self._pair(own)

    def _bind(self, name: str, start: int, at: int, operator: str) -> int:
        """Reads what stands right of an operator; returns where to go on."""
        text, end = self.text, self.end
        if operator == ":":
            kind = _TYPE.match(text, at, end)
            if kind and "\n" not in kind[0]:
                at = kind.end()
            elif block := _BLOCK.match(text, at, end):
                return self._block(name, start, block.end())
        binding, joined = Binding(name, start), True
        while joined and (m := _TERM.match(text, at, end)):
            if m["string"] is not None:
                quote = 3 if m["string"][:3] in ('"""', "\'\'\'") else 1
                a, b = m.span("string")
                binding.parts.append((False, text[a + quote : b - quote], a, b))
            elif m["call"] is not None:  # each literal that a call is given
                at = self._arguments(name, start, m.end())
                joined = _JOIN.match(text, at, end)
                at = joined.end() if joined else at
                continue
            else:
                binding.parts.append((True, m["bare"], *m.span("bare")))
            at = m.end()
            joined = _JOIN.match(text, at, end)
            if joined and _TERM.match(text, joined.end(), end):
                at = joined.end()
            else:
                break
        if binding.parts:
            self._add(binding)
        return at

    def _arguments(self, name: str, start: int, at: int) -> int:
        """Binds a name to each literal of a call, up to its end or the line's; returns where that is."""
        depth, own = 1, []
        for m in _IN_CALL.finditer(self.text, at, self.end):
            at = m.end()
            if m["string"] is not None:
                quote = 3 if m["string"][:3] in ('"""', "\'\'\'") else 1
                a, b = m.span("string")
                own.append(Binding(name, start, [(False, self.text[a + quote : b - quote], a, b)]))
            elif m[0] == "\n":
                at = m.start()
                break
            else:
                depth += 1 if m[0] == "(" else -1
                if not depth:
                    break
        self.bindings += own
        return at

    def _indent(self, at: int) -> int:
        """The column of a place; places come in ascending order."""
        while self.next_line < at:
            self.line = self.next_line + 1
            found = self.text.find("\n", self.line, self.end)
            self.next_line = self.end if found < 0 else found
            self.listed = _ITEM.match(self.text, self.line) is not None
        return at - self.line

    def _block(self, name: str, start: int, at: int) -> int:
        """An indented block as one literal, its lines put together."""
        text = self.text
        indent = self._indent(start)
        first, last, value = None, None, []
        while at < self.end and (m := _LINE.match(text, at, self.end)) and m.end() > at:
            if m[2].strip():
                if len(m[1]) <= indent:
                    break
                first = m.start(2) if first is None else first
                last = m.start(2) + len(m[2].rstrip())
                value.append(m[2].strip())
            at = m.end()
        if value:
            self._add(Binding(name, start, [(False, "".join(value), first, last)]))
        return at

    def _add(self, binding: Binding, alone: bool = False) -> None:
        self.bindings.append(binding)
        if alone:
            return
        if len(self.objects) > 1:
            self.objects[-1].append(binding)
            return
        # the keys of one block stand in one column; a list's mark opens a new block
        column = self._indent(binding.at)
        opens = self.listed and _ITEM.match(self.text, self.line).end() == binding.at
        while self.columns and (self.columns[-1][0] > column or opens and self.columns[-1][0] == column):
            self._pair(self.columns.pop()[1])
        if not self.columns or self.columns[-1][0] < column:
            self.columns.append((column, []))
        self.columns[-1][1].append(binding)
        if len(self.columns[-1][1]) > 64:  # far more keys than an object that names and holds a value has
            self._pair(self.columns[-1][1])
            del self.columns[-1][1][:32]

    def _pair(self, own: list[Binding]) -> None:
        """Binds the name that one key of an object gives to the value that another one holds."""
        names = [b for b in own if b.name.lower() in NAMING and len(b.parts) == 1]
        for b in own:
            if b.name.lower() in HOLDING and names:
                near = min(names, key=lambda n: abs(n.at - b.at))
                self.bindings.append(Binding(near.parts[0][1], b.at, b.parts))


def bindings(text: str) -> list[list[Binding]]:
    """The bindings of a text's code, and those of each of its comments."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    code = _Lexer(text, 0, len(text))
    out = [code.bindings]
    for a, b in code.comments:
        if "=" in (comment := text[a:b]) or ":" in comment:
            skip = len(re.match(r"/\*+|<!--|#+|//+", comment)[0])
            out.append(_Lexer(text, a + skip, b).bindings)
    return [own for own in out if own]


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, directly or through other names."""
    spans: set[tuple[int, int]] = set()
    for own in bindings(text):
        spans |= _reaching(own)
    return sorted(spans)


def _reaching(own: list[Binding]) -> set[tuple[int, int]]:
    own = sorted(own, key=lambda b: b.at)
    by_name: dict[str, list[int]] = {}
    for k, b in enumerate(own):
        by_name.setdefault(b.name, []).append(k)
    places = {name: [own[k].at for k in ks] for name, ks in by_name.items()}

    def meant(name: str, at: int) -> int | None:
        """The binding that a name means at a place, but not the one that it is part of."""
        ks = by_name.get(name)
        if ks is None:
            return None
        i = bisect_left(places[name], at) - 1
        return ks[i] if i >= 0 else ks[0]

    uses = [[(meant(value, b.at) if is_name else None, value, s, e) for is_name, value, s, e in b.parts] for b in own]
    left = Counter(u for k, parts in enumerate(uses) for u, *_ in parts if u is not None and u != k)  # uses to come
    values: list[_Value | None] = [None] * len(own)
    done, hot = [False] * len(own), []
    for root in range(len(own)):  # each value once, without recursion; what a cycle adds is empty
        todo, open_ = [root], set()
        while todo:
            k = todo[-1]
            if done[k]:
                todo.pop()
                continue
            missing = [u for u, *_ in uses[k] if u is not None and u != k and not done[u] and u not in open_]
            if missing and k not in open_:
                open_.add(k)
                todo += missing
                continue
            out = None
            for u, value, _, _ in uses[k]:
                if u is None or u == k:
                    part, mine = _Value(value), True
                else:
                    left[u] -= 1
                    part, mine = values[u], not left[u]
                    if mine:
                        values[u] = None
                if part is not None:
                    if out is None:
                        out = part if mine else part.copy()
                    else:
                        out += part
            out = out or _Value()
            done[k], values[k] = True, out if left[k] else None
            n = name_score(own[k].name)
            if n and n * out.score() >= SPAN_SCORE:
                hot.append(k)
            todo.pop()
    spans, seen = set(), set(hot)
    while hot:
        for u, _, s, e in uses[hot.pop()]:
            if u is None:
                spans.add((s, e))
            elif u not in seen:
                seen.add(u)
                hot.append(u)
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind's place in ``KINDS`` and end of the base matches."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and those of the lexer that, but for their quotes, no base span covers."""
    starts, reach, most = [b for b, _, _ in base], [], 0
    for _, _, end in base:  # how far the spans that begin up to here reach
        most = max(most, end)
        reach.append(most)
    more = []
    for s, e in lexed_spans(text):
        k = bisect_right(starts, s + 1) - 1
        if k < 0 or reach[k] < e - 1:
            more.append((s, 3, e))
    return sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches):
    for batch in shared.text_batches(batches, 1 << 20):
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_spans(text or "", base))))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield shared.record_batch(dict(zip(_SCHEMA.names, [batch.column(0), *columns], strict=True)), _SCHEMA)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (code points, end exclusive).

    Null texts count as empty; null ids stay null; equal rows give equal rows; texts of any length are read as a
    whole, in time linear in it; an empty table gives an empty one; further columns, whatever their names, are
    not read.
    """
    shared.small_arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with ``mark`` in place of every secret, overlapping ones together."""
    out, at = [], 0
    for start, _, end in all_spans(text, base_spans(text)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` masked; all rows and columns stay, whatever their names. Null texts stay null."""
    shared.small_arrow_batches(docs.sparkSession)

    def masked(batches):
        for batch in shared.text_batches(batches, 1 << 20):
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([t if t is None else redact_text(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(masked, docs.schema)
