"""What a page's own <style> sheets and closed <details> hide, written into the tree before it is rendered.

Of a sheet, display and visibility count, by importance, specificity and order. Selectors are elements, classes, ids and their
compounds, one inside another by blanks. Left out: other selectors (attributes, states, siblings, `>`), rules for other
media than screens and those under other conditions.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING, NamedTuple

if TYPE_CHECKING:
    from logloom.llm.html_text import Node

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_BRACE = re.compile(r"[{}]")
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_PART = re.compile(r"([.#])([\w-]+)")
_SAYS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.IGNORECASE)
_SCREEN = re.compile(r"\s*(all|screen|only screen)?\s*", re.IGNORECASE)


class Compound(NamedTuple):
    """One part of a selector: an element name (or none), an id (or none) and classes."""

    name: str
    ids: frozenset[str]
    classes: frozenset[str]

    def fits(self, name: str, own: str, classes: frozenset[str]) -> bool:
        return self.name in ("", name) and self.ids <= {own} and self.classes <= classes


class Rule(NamedTuple):
    chain: tuple[Compound, ...]
    weight: tuple[int, int, int]
    says: tuple[tuple[str, str, bool], ...]


def _selector(text: str) -> Rule | None:
    chain, weight = [], [0, 0, 0]
    for word in text.split():
        m = _COMPOUND.fullmatch(word)
        if m is None:
            return None
        parts = _PART.findall(m[2])
        name = "" if m[1] in (None, "*") else m[1].lower()
        chain.append(Compound(name, frozenset(v for k, v in parts if k == "#"), frozenset(v for k, v in parts if k == ".")))
        weight = [weight[0] + len(chain[-1].ids), weight[1] + len(chain[-1].classes), weight[2] + bool(name)]
    return Rule(tuple(chain), tuple(weight), ()) if chain else None


def _said(text: str) -> tuple[tuple[str, str, bool], ...]:
    return tuple((k.lower(), v.lower(), bool(w)) for k, v, w in _SAYS.findall(text))


def rules(sheet: str) -> list[Rule]:
    """Rules of a sheet that say anything of display or visibility, in time linear in its length."""
    out, at, sheet = [], 0, _COMMENT.sub(" ", sheet)
    open_: list[bool] = []  # whether each block that is open around this place counts
    while True:
        brace = _BRACE.search(sheet, at)
        if brace is None:
            return out
        end = brace.start()
        head, at = sheet[at:end].rsplit(";", 1)[-1].strip(), end + 1
        if sheet[end] == "}":
            if open_:
                open_.pop()
        elif head.startswith("@"):
            open_.append(head[:6].lower() == "@media" and _SCREEN.fullmatch(head[6:]) is not None)
        else:
            close = sheet.find("}", at)
            body = sheet[at : close if close >= 0 else len(sheet)]
            at = close + 1 if close >= 0 else len(sheet)
            if all(open_) and (says := _said(body)):
                out += [r._replace(says=says) for s in head.split(",") if (r := _selector(s))]


def _sheets(root: Node) -> str:
    found, work = [], [root]
    while work:
        x = work.pop()
        if isinstance(x, str) or x.name in ("template", "noscript"):
            continue
        if x.name == "style" and _SCREEN.fullmatch(x.attrs.get("media", "")):
            found.append("".join(c for c in x.children if isinstance(c, str)))
        work.extend(reversed(x.children))
    return "\n".join(found)


def apply(root: Node) -> None:
    """Sets what is shown by the sheets in each node's style, and leaves a closed <details> its summary."""
    given = rules(_sheets(root))
    plain: dict[str, list[tuple[int, Rule]]] = {}
    chained: list[tuple[int, Rule]] = []
    for i, r in enumerate(given):
        last = r.chain[-1]
        key = next((f"#{x}" for x in last.ids), None) or next((f".{x}" for x in last.classes), None) or last.name
        if len(r.chain) == 1:
            plain.setdefault(key, []).append((i, r))
        else:
            chained.append((i, r))
    #: parts of each chained selector that the elements around a node fit, from the left
    work: list[tuple[Node, tuple[int, ...]]] = [(root, (0,) * len(chained))]
    while work:
        node, met = work.pop()
        if node.name == "details" and "open" not in node.attrs:
            node.children = [c for c in node.children if not isinstance(c, str) and c.name == "summary"][:1]
        if given:
            met = _judge(node, met, plain, chained)
        work.extend((c, met) for c in node.children if not isinstance(c, str))


def _judge(node: Node, met: tuple[int, ...], plain: dict[str, list[tuple[int, Rule]]], chained: list[tuple[int, Rule]]) -> tuple[int, ...]:
    own, classes = node.attrs.get("id", ""), frozenset(node.attrs.get("class", "").split())
    fits = lambda c: c.fits(node.name, own, classes)
    found = [(i, r) for k in {f"#{own}", node.name, "", *(f".{c}" for c in classes)} for i, r in plain.get(k, ()) if fits(r.chain[0])]
    inside = met
    for j, (i, r) in enumerate(chained):
        if met[j] == len(r.chain) - 1:
            if fits(r.chain[-1]):
                found.append((i, r))
        elif fits(r.chain[met[j]]):
            inside = (*inside[:j], met[j] + 1, *inside[j + 1 :])
    if found:
        style = node.attrs.get("style", "")
        said = [((important, 0, r.weight, i, n), k, v) for i, r in found for n, (k, v, important) in enumerate(r.says)]
        said += [((important, 1, (0, 0, 0), 0, n), k, v) for n, (k, v, important) in enumerate(_said(style))]
        last = {k: v for _, k, v in sorted(said)}
        node.attrs["style"] = ";".join(f"{k}:{v}" for k, v in sorted(last.items()))
        if "display" in last and last["display"] != "none":
            node.attrs.pop("hidden", None)
    return inside
