"""Importing printed reports: final templates and component counts."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions.tokens import ANSI

_HEAD = re.compile(r"Label: C(\d+) \((\d+)\)")
_MEMBERS = re.compile(r"Contributors C(\d+):(.*)")
_LOST = re.compile(r"\s*Excluded (\d+)\s*")
_FINAL = re.compile(r"\s*C(\d+) (?:● ?)?(.*?)\s*")


@dataclass
class Counts:
    members: int
    lof_excluded: int = 0
    #: None where the report does not list contributors
    contributors: frozenset[int] | None = None

    @property
    def support(self) -> int | None:
        return None if self.contributors is None else len(self.contributors)

    @property
    def excluded(self) -> int | None:
        return None if self.contributors is None else self.members - len(self.contributors)

    @property
    def accidental(self) -> int | None:
        return None if self.contributors is None else self.members - self.lof_excluded - len(self.contributors)


def plain(text: str) -> str:
    return re.sub(ANSI + r"|\r", "", text)


def final_templates(text: str) -> dict[int, str]:
    """Label -> text of the last cluster summary, blanks at the end dropped."""
    lines = plain(text).split("\n")
    heads = [i for i, x in enumerate(lines) if re.fullmatch(r"Summary: \d+ clusters", x.strip())]
    if not heads:
        raise ValueError("no cluster summary")
    out: dict[int, str] = {}
    for x in lines[heads[-1] + 1 :]:
        if x.strip(" -") and (m := _FINAL.fullmatch(x)):
            if int(m[1]) in out:
                raise ValueError(f"template C{m[1]} appears twice")
            out[int(m[1])] = m[2]
    if len(out) != int(re.search(r"\d+", lines[heads[-1]])[0]):
        raise ValueError("the number of templates differs from the summary's")
    return out


@dataclass
class _Section:
    """What a report says between one component's header and the next."""

    label: int
    members: int
    lost: list[int]
    named: list[tuple[int, list[str]]]

    def counts(self) -> Counts:
        name = f"C{self.label}"
        if len(self.lost) > 1 or len(self.named) > 1:
            raise ValueError(f"{name} lists exclusions or contributors twice")
        lost = sum(self.lost)
        if not self.named:
            rows = None
        elif self.named[0][0] != self.label:
            raise ValueError(f"contributors of C{self.named[0][0]} are out of place")
        elif not all(map(str.isdigit, self.named[0][1])):
            raise ValueError(f"a contributor of {name} is not a row")
        else:
            rows = frozenset(map(int, self.named[0][1]))
            if len(rows) < len(self.named[0][1]):
                raise ValueError(f"a contributor of {name} appears twice")
        if lost + len(rows or ()) > self.members:
            raise ValueError(f"{name} has more contributors and exclusions than rows")
        return Counts(self.members, lost, rows)


def _sections(lines: list[str]) -> list[_Section]:
    heads = [k for k, x in enumerate(lines) if _HEAD.fullmatch(x)]
    before = lines[: heads[0]] if heads else lines
    if not heads or any(_MEMBERS.fullmatch(x) or _LOST.fullmatch(x) for x in before):
        raise ValueError("no component header, or lines of a component before the first")
    out = []
    for a, b in zip(heads, [*heads[1:], len(lines)]):
        label, members = map(int, _HEAD.fullmatch(lines[a]).groups())
        lost = [int(m[1]) for m in map(_LOST.fullmatch, lines[a:b]) if m]
        named = [(int(m[1]), m[2].split()) for m in map(_MEMBERS.fullmatch, lines[a:b]) if m]
        out.append(_Section(label, members, lost, named))
    return out


def may_count(line: Column) -> Column:
    """Whether a line of a report can matter to component_counts: it has a word of theirs, or what plain takes out."""
    return line.rlike("Label: C|Contributors C|Excluded |[\\x1b\\r]")


def component_counts(text: str) -> dict[int, Counts]:
    """Label -> counts; ValueError where headers, exclusions and contributors do not fit together."""
    sections = _sections(plain(text).split("\n"))
    out = {s.label: s.counts() for s in sections}
    if len(out) < len(sections):
        raise ValueError("a component has two headers")
    known = [c.contributors for c in out.values() if c.contributors is not None]
    if known and len(known) < len(out):
        raise ValueError("some components list no contributors")
    if len(frozenset().union(*known)) < sum(map(len, known)):
        raise ValueError("a row contributes to two components")
    return out


def manifest_value(manifest: dict, paths: list[str]):
    """First value that is there at one of the dotted paths of a JSON manifest."""
    for path in paths:
        value = manifest
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        if value is not None:
            return value
    raise KeyError(f"none of {', '.join(paths)} in the manifest")


def result_path(root: str, path: str) -> str:
    """A manifest's path, which has to stay under the results folder."""
    import os

    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"{path} lies outside the results")
    return full
