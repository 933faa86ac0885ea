"""Many patterns in one pass over a text: an automaton of the words that their alternatives begin with.

A pattern is a list of alternatives. Most begin with plain letters; these go into one Aho-Corasick automaton for all
patterns together. Where the automaton hits, an alternative that is plain letters has matched, and any other is tried by its
regex at that place only. An alternative that begins otherwise ("[0-9]+ rupees") is searched for by its regex, and only in
texts that hold one of the words it must end with. Results are those of the patterns themselves: whether one matches
somewhere, its first match, or the number of its matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Whitespace, digits and letters of the patterns are ASCII; a pattern may be bounded by what is a word in any script.
_BOUNDED, _PLAIN = r"(?<!\w)(?ai:%s)(?!\w)", r"(?ai:%s)"
_SPECIAL = set("\\.[](){}?*+|^$")


def alternatives(pattern: str) -> list[str]:
    """The parts between the bars of the outermost level."""
    out, depth, in_set, at, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_set:
            in_set = c != "]"
        elif c == "[":
            in_set = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


def lead(alternative: str) -> tuple[str, bool]:
    """The plain letters that an alternative begins with, and whether they are all of it."""
    out, i = "", 0
    while i < len(alternative):
        c, step = alternative[i], 1
        if c == "\\" and i + 1 < len(alternative) and not alternative[i + 1].isalnum():
            c, step = alternative[i + 1], 2
        elif c in _SPECIAL:
            break
        if alternative[i + step : i + step + 1] in ("?", "*", "{"):
            break
        out, i = out + c, i + step
    return out, i == len(alternative)


def gates(alternative: str) -> list[str]:
    """Texts of which one stands in every match of an alternative that ends with a group of plain ones; none if unknown."""
    found = re.search(r"((?:\\?[@.])?)\(\?:([^()\[\]*+?{}\\]*)\)$", alternative)
    return [found[1].lstrip("\\") + x for x in found[2].split("|")] if found else []


@dataclass
class Detector:
    """kind: any (matches somewhere), first (what it finds first), count (number of matches)."""

    name: str
    pattern: str
    kind: str = "any"
    bounded: bool = False
    regex: re.Pattern = field(init=False)
    open: list[tuple[re.Pattern, list[str]]] = field(init=False)
    leads: list[tuple[str, bool]] = field(init=False)

    def __post_init__(self):
        form = _BOUNDED if self.bounded else _PLAIN
        self.regex = re.compile(form % self.pattern)
        begun = [(a, *lead(a)) for a in alternatives(self.pattern)]
        self.leads = [(word, whole and not self.bounded) for _, word, whole in begun if word]
        self.open = [(re.compile(form % a), gates(a)) for a, word, _ in begun if not word]


class Scanner:
    """All detectors in one pass. Built once in each Python worker."""

    def __init__(self, detectors: list[Detector]):
        import ahocorasick

        self.detectors = detectors
        words: dict[str, dict[int, bool]] = {}
        for d, detector in enumerate(detectors):
            for word, whole in detector.leads:
                known = words.setdefault(word.lower(), {})
                known[d] = known.get(d, False) or whole
        self.automaton = ahocorasick.Automaton()
        for word, uses in words.items():
            self.automaton.add_word(word, (len(word), tuple(uses.items())))
        self.automaton.make_automaton()
        self.plain = [d.kind == "any" for d in detectors]

    def scan(self, text: str, done: list | None = None) -> list:
        """For each detector True or False, the first match or None, or a number; a result in `done` that is there (true)
        already is kept and not looked for again."""
        if not self.detectors:
            return []
        low = text.lower()
        if len(low) != len(text):  # places of hits would be off
            return [was or self._whole(d, text) for d, was in zip(self.detectors, done or [None] * len(self.detectors), strict=True)]
        out = list(done) if done else [False if p else None for p in self.plain]
        places: dict[int, set[int]] = {}
        for end, (n, uses) in self.automaton.iter(low):
            for d, whole in uses:
                if out[d]:
                    continue
                if self.plain[d]:
                    if whole or self.detectors[d].regex.match(text, end - n + 1):
                        out[d] = True
                else:
                    places.setdefault(d, set()).add(end - n + 1)
        for d, detector in enumerate(self.detectors):
            if out[d]:
                continue
            ajar = [regex for regex, words in detector.open if not words or any(w in low for w in words)]
            if detector.kind == "any":
                out[d] = any(regex.search(text) for regex in ajar)
            elif ajar:
                out[d] = self._whole(detector, text)
            elif detector.kind == "first":
                found = (detector.regex.match(text, at) for at in sorted(places.get(d, ())))
                out[d] = next((m[0] for m in found if m), None)
            else:
                n, after = 0, 0
                for at in sorted(places.get(d, ())):
                    if at >= after and (m := detector.regex.match(text, at)):
                        n, after = n + 1, m.end()
                out[d] = n
        return out

    @staticmethod
    def _whole(detector: Detector, text: str):
        if detector.kind == "count":
            return sum(1 for _ in detector.regex.finditer(text))
        found = detector.regex.search(text)
        return found is not None if detector.kind == "any" else found and found[0]
