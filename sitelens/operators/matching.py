"""CSS selectors: reading them, and matching them while a page is read.

A selector list is chains of compounds (``div.a > p:nth-child(2)``) joined by the
combinators descendant, ``>``, ``+`` and ``~``. Every compound of every chain owns one
bit. An element's bits tell which beginnings of chains end at it; they follow from its
own tests and from the bits of its parent, ancestors and earlier siblings, which the
reader has at hand when the element starts. So the depth of a page costs nothing.

What counts from the end of the parent (``:last-child`` and the like) is known only
when the parent ends; such tests wait for it where they stand in the last compound of a
chain. Selectors that look further ahead (``:has``, ``:empty``, ``:is`` and ``:not`` of
whole chains, ``nth-child(… of …)``, tests from the end in an inner compound) are settled
when the page ends: ``PageTree`` keeps its elements, and passes from the first element on
and from the last one back mark for each compound what it matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""\s*(?P<comma>,)\s*|\s*(?P<sign>[>+~])\s*|(?P<space>\s+)|(?P<tag>\*|[A-Za-z][\w\-]*)"""
    r"""|\.(?P<cls>-?[A-Za-z_][\w\-]*)|\#(?P<id>[\w\-]+)"""
    r"""|\[\s*(?P<attr>[A-Za-z_][\w:\-]*)\s*(?:(?P<op>[~^$*|]?=)\s*"""
    r"""(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[iIsS])?\s*)?\]"""
    r"""|:(?P<pseudo>[a-zA-Z\-]+)(?P<open>\()?"""
)
_NTH = re.compile(r"\s*(?:(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*$")
# (counted among children of one tag, counted from the end, step, offset)
_PLACES = {
    "first-child": (False, False, 0, 1),
    "last-child": (False, True, 0, 1),
    "first-of-type": (True, False, 0, 1),
    "last-of-type": (True, True, 0, 1),
}
_NTH_PLACES = {
    "nth-child": (False, False),
    "nth-last-child": (False, True),
    "nth-of-type": (True, False),
    "nth-last-of-type": (True, True),
}


@dataclass
class Compound:
    tag: str | None = None
    tests: list = field(default_factory=list)  # (attribute, operator or "", value, any case)
    places: list = field(default_factory=list)  # (of type, from end, step, offset)
    nots: list = field(default_factory=list)  # compounds that must not match
    combinator: str = ""  # how it hangs on the compound to its left
    # What only the whole page can tell:
    one_of: list = field(default_factory=list)  # selector lists of which each must match
    none_of: list = field(default_factory=list)  # selector lists that must not match
    holds: list = field(default_factory=list)  # relative selector lists that must be found
    counted: list = field(default_factory=list)  # (selector list, from end, step, offset)
    empty: bool = False
    root: bool = False

    @property
    def late(self) -> list:
        return [p for p in self.places if p[1]]

    @property
    def ahead(self) -> bool:
        return bool(self.one_of or self.none_of or self.holds or self.counted or self.empty or self.root)

    def matches(self, tag: str, attrs: Mapping[str, str], child: int, of_type: int) -> bool:
        if not self.is_like(tag, attrs):
            return False
        for typed, from_end, step, offset in self.places:
            if not from_end and not on_grid(of_type if typed else child, step, offset):
                return False
        return not any(n.matches(tag, attrs, child, of_type) for n in self.nots)

    def is_like(self, tag: str, attrs: Mapping[str, str]) -> bool:
        """Whether the name and the attributes fit."""
        if self.tag and tag != self.tag:
            return False
        for name, op, value, any_case in self.tests:
            actual = attrs.get(name)
            if actual is None:
                return False
            if any_case:
                actual, value = actual.lower(), value.lower()
            if op and not _holds(actual, op, value):
                return False
        return True


def _holds(actual: str, op: str, value: str) -> bool:
    if op == "=":
        return actual == value
    if op == "|=":
        return actual == value or actual.startswith(value + "-")
    if not value or (op == "~=" and re.search(r"\s", value)):
        return False  # these operators never match an empty value
    if op == "~=":
        return f" {value} " in f" {actual} "
    if op == "^=":
        return actual.startswith(value)
    if op == "$=":
        return actual.endswith(value)
    return value in actual


def on_grid(place: int, step: int, offset: int) -> bool:
    """Whether ``place`` is ``step * n + offset`` for some n from 0 on."""
    if step == 0:
        return place == offset
    return (place - offset) % step == 0 and (place - offset) // step >= 0


def _grid(text: str) -> tuple[int, int] | None:
    word = text.strip().lower()
    if word in ("odd", "even"):
        return (2, 1) if word == "odd" else (2, 0)
    found = _NTH.match(word)
    if not found:
        return None
    if found["only"]:
        return 0, int(found["only"])
    step = {"": 1, "+": 1, "-": -1}.get(found["a"]) or int(found["a"] or 0)
    return step, int((found["sign"] or "") + (found["b"] or "0"))


def _argument(text: str, at: int) -> int:
    """Where the bracket that opened before ``at`` closes; -1 if it does not."""
    depth, quote = 1, ""
    for end in range(at, len(text)):
        char = text[end]
        if quote:
            quote = "" if char == quote else quote
        elif char in "\"'":
            quote = char
        elif char in "()":
            depth += 1 if char == "(" else -1
            if not depth:
                return end
    return -1


def parse(source: str, relative: bool = False) -> list[list[Compound]]:
    """The chains of a selector list; ValueError for what is not supported. In a
    ``relative`` list each chain may begin with a combinator (else: descendant)."""

    def refuse(rest: str = "") -> ValueError:
        return ValueError(f"Unsupported CSS selector {source!r}" + (f" at {rest!r}" if rest else ""))

    def new_chain() -> list[Compound]:
        return [Compound(combinator=" " if relative else "")]

    chains: list[list[Compound]] = [new_chain()]
    used = False  # whether the current compound has any content
    signed = False  # whether a relative chain has its own combinator
    at, text = 0, source.strip()
    while at < len(text):
        token = _TOKEN.match(text, at)
        if not token:
            raise refuse(text[at:])
        rest, at = text[at:], token.end()
        current = chains[-1][-1]
        if token["comma"] or token["sign"] or token["space"]:
            if not used:
                first = relative and len(chains[-1]) == 1
                if first and token["space"]:
                    continue
                if not first or not token["sign"] or signed:
                    raise refuse()
                current.combinator, signed = token["sign"], True
                continue
            if token["comma"]:
                chains.append(new_chain())
                signed = False
            else:
                chains[-1].append(Compound(combinator=token["sign"] or " "))
            used = False
            continue
        if token["tag"]:
            if used:
                raise refuse(rest)
            current.tag = None if token["tag"] == "*" else token["tag"].lower()
        elif token["cls"]:
            current.tests.append(("class", "~=", token["cls"], False))
        elif token["id"]:
            current.tests.append(("id", "=", token["id"], False))
        elif token["attr"]:
            value = next((v for v in (token["dq"], token["sq"], token["bare"]) if v is not None), "")
            any_case = (token["flag"] or "").lower() == "i"
            current.tests.append((token["attr"].lower(), token["op"] or "", value, any_case))
        else:
            argument = None
            if token["open"]:
                end = _argument(text, at)
                if end < 0:
                    raise refuse(rest)
                argument, at = text[at:end], end + 1
            if not _add_pseudo(current, token["pseudo"].lower(), argument):
                raise refuse(rest)
        used = True
    if not used:
        raise refuse()
    return chains


def looks_ahead(chains: list[list[Compound]]) -> bool:
    """Whether a selector can only be settled when the page has ended."""
    return any(
        compound.ahead or (compound.late and compound is not chain[-1])
        for chain in chains
        for compound in chain
    )


def _add_pseudo(compound: Compound, name: str, argument: str | None) -> bool:
    if argument is None:
        if name in _PLACES:
            compound.places.append(_PLACES[name])
        elif name in ("only-child", "only-of-type"):
            end = name.removeprefix("only-")
            compound.places += [_PLACES[f"first-{end}"], _PLACES[f"last-{end}"]]
        elif name in ("empty", "root"):
            setattr(compound, name, True)
        elif name in ("link", "any-link"):
            compound.one_of.append(parse("a[href], area[href]"))
        else:
            return False
        return True
    if name in _NTH_PLACES:
        place, of, among = argument.partition(" of ")
        grid = _grid(place)
        if not grid or (of and name.endswith("-of-type")):
            return False
        if of:
            compound.counted.append((parse(among), _NTH_PLACES[name][1], *grid))
        else:
            compound.places.append((*_NTH_PLACES[name], *grid))
        return True
    if name == "not":
        inner = parse(argument)
        if any(len(chain) > 1 or chain[0].late or chain[0].ahead for chain in inner):
            compound.none_of.append(inner)
        else:
            compound.nots += [chain[0] for chain in inner]
        return True
    if name in ("is", "where", "matches"):
        compound.one_of.append(parse(argument))
        return True
    if name == "has":
        compound.holds.append(parse(argument, relative=True))
        return True
    return False


class Frame:
    """What the children of an open element can ask about it and about one another."""

    __slots__ = ("own", "above", "previous", "before", "children", "types", "waiting")

    def __init__(self, own: int = 0, above: int = 0) -> None:
        self.own, self.above = own, above
        self.previous = self.before = self.children = 0
        self.types: dict[str, int] = {}
        self.waiting: list[tuple] = []


class Matcher:
    """Selectors by their source text, matched element by element."""

    def __init__(self, sources: Iterable[str]) -> None:
        self.by_tag: dict[str, list[tuple]] = {}
        self.any_tag: list[tuple] = []
        self.ahead: list[tuple[str, list[list[Compound]]]] = []  # settled when the page ends
        bit = 1
        for source in sorted(sources):
            chains = parse(source)
            if looks_ahead(chains):
                self.ahead.append((source, chains))
                continue
            for chain in chains:
                before = 0
                for k, compound in enumerate(chain):
                    last = source if k == len(chain) - 1 else None
                    step = (compound, before, bit, last)
                    if compound.tag:
                        self.by_tag.setdefault(compound.tag, []).append(step)
                    else:
                        self.any_tag.append(step)
                    before, bit = bit, bit << 1

    def enter(self, parent: Frame, tag: str, attrs: Mapping[str, str]) -> tuple[Frame, list[str], list]:
        """The element's frame, the selectors it satisfies, and those still open."""
        parent.children += 1
        of_type = parent.types[tag] = parent.types.get(tag, 0) + 1
        bits, hits, late = 0, [], []
        for steps in (self.by_tag.get(tag, ()), self.any_tag):
            for compound, before, bit, source in steps:
                if before:
                    sign = compound.combinator
                    reach = (
                        parent.above if sign == " " else parent.own if sign == ">"
                        else parent.previous if sign == "+" else parent.before
                    )
                    if not reach & before:
                        continue
                if compound.matches(tag, attrs, parent.children, of_type):
                    bits |= bit
                    if source is None or source in hits:
                        continue
                    if compound.late:
                        late.append((source, compound.late, parent.children, of_type, tag))
                    else:
                        hits.append(source)
        parent.previous = bits
        parent.before |= bits
        return Frame(bits, parent.above | bits), hits, late

    @staticmethod
    def settled(frame: Frame) -> Iterable[tuple[int, str]]:
        """(element, selector) of waiting children, when their parent ends."""
        for element, (source, late, child, of_type, tag) in frame.waiting:
            counts = (frame.children - child + 1, frame.types[tag] - of_type + 1)
            if all(on_grid(counts[typed], step, offset) for typed, _, step, offset in late):
                yield element, source

    def may_match(self, tag: str, attrs: Mapping[str, str]) -> bool:
        """Whether a selector that looks ahead may turn out to match the element."""
        return any(chain[-1].is_like(tag, attrs) for _, chains in self.ahead for chain in chains)


class PageTree:
    """The elements of a page in document order, to match selectors that look ahead."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.attrs: list[Mapping[str, str]] = []
        self.parents: list[int] = []  # -1 at the top
        self.filled: list[bool] = []  # has a child element or text
        self.kept: list[int] = []  # place in the output, or -1

    def add(self, tag: str, attrs: Mapping[str, str], parent: int, kept: int) -> int:
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parents.append(parent)
        self.filled.append(False)
        self.kept.append(kept)
        if parent >= 0:
            self.filled[parent] = True
        return len(self.tags) - 1

    def settle(self, selectors: Iterable[tuple[str, list[list[Compound]]]]) -> Iterable[tuple[int, str]]:
        """(element, selector) of all matches of selectors that look ahead."""
        self._count()
        for source, chains in selectors:
            for element in self._matching(chains):
                yield element, source

    def _count(self) -> None:
        """Earlier siblings, and the place of each element among all and among its type."""
        n = len(self.tags)
        self.previous = [-1] * n
        self.place, self.of_type = [0] * n, [0] * n
        last: dict[int, int] = {}
        counts: dict[tuple[int, str], int] = {}
        for i, (tag, parent) in enumerate(zip(self.tags, self.parents, strict=True)):
            self.previous[i] = before = last.get(parent, -1)
            self.place[i] = self.place[before] + 1 if before >= 0 else 1
            last[parent] = i
            self.of_type[i] = counts[parent, tag] = counts.get((parent, tag), 0) + 1
        self.total = {parent: self.place[i] for parent, i in last.items()}
        self.total_of_type = counts

    def _matching(self, chains: list[list[Compound]]) -> list[int]:
        """Elements that some chain matches, in order."""
        found: set[int] = set()
        for chain in chains:
            left: list[bool] = []
            for compound in chain:
                own = self._alone(compound)
                left = self._after(left, compound.combinator, own) if left else own
            found.update(i for i, matches in enumerate(left) if matches)
        return sorted(found)

    def _after(self, left: list[bool], combinator: str, own: list[bool]) -> list[bool]:
        """``own`` where the combinator leads to it from ``left``; from the first element on."""
        near = self.parents if combinator in (" ", ">") else self.previous
        reach = [False] * len(own)
        for i, j in enumerate(near):
            if j >= 0:
                reach[i] = left[j] or (combinator in (" ", "~") and reach[j])
        return [a and b for a, b in zip(own, reach, strict=True)]

    def _before(self, right: list[bool], combinator: str) -> list[bool]:
        """Where the combinator leads to some element of ``right``; from the last one back."""
        near = self.parents if combinator in (" ", ">") else self.previous
        reach = [False] * len(right)
        for i in range(len(right) - 1, -1, -1):
            j = near[i]
            if j >= 0 and (right[i] or (combinator in (" ", "~") and reach[i])):
                reach[j] = True
        return reach

    def _alone(self, compound: Compound) -> list[bool]:
        """Elements that a compound matches, whatever stands to its left."""
        out = [compound.is_like(t, a) for t, a in zip(self.tags, self.attrs, strict=True)]

        def keep(test) -> None:
            for i, still in enumerate(out):
                if still and not test(i):
                    out[i] = False

        for typed, from_end, step, offset in compound.places:
            keep(lambda i: on_grid(self._place(i, typed, from_end), step, offset))
        for inner in compound.nots:
            others = self._alone(inner)
            keep(lambda i: not others[i])
        if compound.empty:
            keep(lambda i: not self.filled[i])
        if compound.root:
            keep(lambda i: self.parents[i] < 0)
        for chains in compound.one_of:
            wanted = set(self._matching(chains))
            keep(wanted.__contains__)
        for chains in compound.none_of:
            unwanted = set(self._matching(chains))
            keep(lambda i: i not in unwanted)
        for chains in compound.holds:
            holders: set[int] = set()
            for chain in chains:
                right = [True] * len(out)
                for inner in reversed(chain):
                    right = [a and b for a, b in zip(self._alone(inner), right, strict=True)]
                    right = self._before(right, inner.combinator)
                holders.update(i for i, holds in enumerate(right) if holds)
            keep(holders.__contains__)
        for chains, from_end, step, offset in compound.counted:
            among = self._matching(chains)
            seen: dict[int, int] = {}
            nth: dict[int, int] = {}
            for i in reversed(among) if from_end else among:
                nth[i] = seen[self.parents[i]] = seen.get(self.parents[i], 0) + 1
            keep(lambda i: i in nth and on_grid(nth[i], step, offset))
        return out

    def _place(self, i: int, typed: bool, from_end: bool) -> int:
        place = self.of_type[i] if typed else self.place[i]
        if not from_end:
            return place
        parent = self.parents[i]
        total = self.total_of_type[parent, self.tags[i]] if typed else self.total[parent]
        return total - place + 1
